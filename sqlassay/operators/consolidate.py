"""Consolidation of strategies: like ones merge, used ones learn from what went wrong and right."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged
from .strategies import ema, strategy_similarity

# Similarity from which strategies merge; lessons taken from failures and kept; frequent words looked at, their least length, and how many are taken.
MERGE_OVER, NEW_PITFALLS, MOST_PITFALLS, FREQUENT, LONG_WORD, NEW_KEYWORDS = 0.9, 5, 10, 10, 4, 5
NO_LESSON, NO_FIX = "Query failure", "Review query structure"
PITFALLS = "array<struct<mistake:string,consequence:string,fix:string,frequency:double>>"

# ---- merging -----------------------------------------------------------------------------


def _prefix(tokens: Column, over: float) -> Column:
    """Tokens of which two sets whose Jaccard similarity is greater than ``over`` share one: the first by hash, as many as they may differ in and one."""
    tokens = F.array_distinct(tokens)
    order = F.transform(F.array_sort(F.transform(tokens, lambda t: F.struct(F.xxhash64(t).alias("h"), t.alias("t")))), lambda x: x["t"])
    return F.slice(order, 1, F.greatest(F.size(tokens) - F.floor(F.lit(over) * F.size(tokens) + 1e-9).cast("int"), F.lit(0)))


def similar_pairs(kinds: DataFrame, over: float) -> DataFrame:
    """(a, b) of kinds (place, pattern, keywords, steps) alike, a before b: each pair once.

    A part that the similarity cannot do without is a prefix filter: of the pattern from 0.5, of
    the keywords from 0.7, of the steps from 0.8 on; kinds meet where they share one of each.
    """
    if over < 0.5:
        raise ValueError("below 0.5 strategies merge that share nothing of their patterns")
    cells = kinds.withColumn("k1", F.explode(_prefix(F.split("pattern", "_"), (over - 0.5) / 0.5)))
    keys = ["k1"]
    for part, weight, least in (("keywords", 0.3, 0.7), ("steps", 0.2, 0.8)):
        if over >= least:
            keys.append(f"k{len(keys) + 1}")
            cells = cells.withColumn(keys[-1], F.explode(_prefix(F.col(part), (over - 1 + weight) / weight)))
    x, y = cells.alias("x"), cells.alias("y")
    met = x.join(y, [F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys] + [F.col("x.place") < F.col("y.place")])
    columns = ("pattern", "keywords", "steps")
    alike = strategy_similarity({c: F.col(f"x.{c}") for c in columns}, {c: F.col(f"y.{c}") for c in columns})
    return met.filter(F.round(alike, 9) > over).select(F.col("x.place").alias("a"), F.col("y.place").alias("b")).distinct()


def _taken_in(pairs: DataFrame) -> DataFrame:
    """(p) of those that an earlier one takes in: of pairs (a, b), a before b, b is one if any such a is not.

    Rows (p, on, stays) say what p hangs on: p stays if each of its ``on`` is as ``stays`` says. In a
    round what is known is put in, and another that hangs on one alone is replaced by that one. So
    a chain of n takes some log2(n) rounds, not n / 2.
    """
    left = pairs.select(F.col("b").alias("p"), F.col("a").alias("on"), F.lit(False).alias("stays"))
    known = staged(pairs.select(F.col("a").alias("p")).distinct().join(left.select("p").distinct(), "p", "left_anti").withColumn("state", F.lit(True)), "primaries")
    gone = []
    while not left.isEmpty():
        # p with its one condition, if it has no other
        single = left.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.min("on").alias("next"), F.min("stays").alias("as")).filter("n = 1").drop("n")
        single = single.join(known.select(F.col("p").alias("next")), "next", "left_anti")  # what hangs on a known one is known itself in a moment
        seen = left.join(known.withColumnRenamed("p", "on"), "on", "left").join(single.withColumnRenamed("p", "on"), "on", "left")
        on = F.when(F.col("state").isNull(), F.coalesce("next", "on"))
        stays = F.when(F.col("next").isNull(), F.col("stays")).otherwise(F.col("stays") == F.col("as"))
        met = F.when(F.col("state").isNotNull(), F.col("state") == F.col("stays"))
        seen = staged(seen.select("p", on.alias("on"), F.when(F.col("state").isNull(), stays).alias("stays"), met.alias("met")).distinct(), "conditions")
        open_, both = F.count("on"), F.count_distinct("on")
        state = F.when((F.min("met") == False) | (open_ > both), False).when(open_ == 0, True)  # noqa: E712  (one as staying and as gone: neither can be)
        known = staged(seen.groupBy("p").agg(state.alias("state")).filter("state IS NOT NULL"), "known")
        gone.append(known.filter("NOT state").select("p"))
        left = staged(seen.filter("on IS NOT NULL").join(known.select("p"), "p", "left_anti").select("p", "on", "stays"), "left")
    return reduce(DataFrame.unionByName, gone) if gone else pairs.select(F.col("b").alias("p"))


def merge_plan(store: DataFrame, over: float = MERGE_OVER) -> DataFrame:
    """(primary, secondary): which strategy takes in which others, as if each in turn, the most successful first, took in all later ones like it that are left.

    Strategies are compared as they are in the store, whatever a primary has taken in before. In each round those that no
    earlier one can take in any more become primaries, and what is like them is taken in; where
    that hangs on one other alone, rounds double how far they see. Strategies of equal pattern, keywords and steps count as one kind: copies make no pairs.
    """
    place = F.struct((-F.col("success_rate")).alias("rate"), F.col("strategy_id").alias("id"))
    rows = store.select("strategy_id", place.alias("place"), "pattern", F.array_sort(F.array_distinct("keywords")).alias("keywords"), F.array_sort(F.array_distinct("steps")).alias("steps"))
    kind = ["pattern", "keywords", "steps"]
    rows = staged(rows, "strategies")
    kinds = rows.groupBy(*kind).agg(F.min("place").alias("place"))
    own = 0.5 + F.when(F.size("keywords") > 0, 0.3).otherwise(0.0) + F.when(F.size("steps") > 0, 0.2).otherwise(0.0)
    kinds = staged(kinds.withColumn("self", F.round(own, 9) > over), "kinds")
    # kinds whose copies are not like each other keep every strategy apart
    apart = rows.join(kinds.filter("NOT self").select(*kind), kind).select("place", *kind)
    pairs = staged(similar_pairs(kinds.filter("self").select("place", *kind).unionByName(apart), over), "pairs")
    every = _taken_in(pairs)
    # the earliest of the primaries like it takes it in
    of = pairs.join(every.withColumnRenamed("p", "a"), "a", "left_anti").join(every.withColumnRenamed("p", "b"), "b", "left_semi").groupBy("b").agg(F.min("a").alias("a"))
    heads = kinds.filter("self").select(*kind, F.col("place").alias("head"))
    members = rows.join(heads, kind, "left").withColumn("head", F.coalesce("head", "place"))
    primary = members.join(of.withColumnRenamed("b", "head"), "head", "left").select(F.coalesce("a.id", "head.id").alias("primary"), F.col("strategy_id").alias("secondary"))
    return primary.filter("primary <> secondary")


def merge_similar(store: DataFrame, over: float = MERGE_OVER) -> tuple[DataFrame, DataFrame]:
    """(store, log): the store after merge_plan(), and (primary_id, secondary_id, new_success_rate, new_sample_count).

    A primary gets all samples, the mean rate by samples, all keywords and, where the store has
    them, the common pitfalls that it lacks; its version grows by one for each merge. Secondaries go.
    """
    plan = staged(merge_plan(store, over), "merges")
    named = store.join(plan.withColumnRenamed("secondary", "strategy_id"), "strategy_id", "left").withColumn("into", F.coalesce("primary", "strategy_id"))
    weight = F.col("sample_count").cast("double")
    sums = [F.sum(F.col("success_rate") * weight).alias("__rate"), F.avg("success_rate").alias("__mean"), F.sum("sample_count").alias("__n"), F.count("primary").alias("__merged"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("keywords")))).alias("__keywords")]
    if "common_pitfalls" in store.columns:
        ordered = F.array_sort(F.collect_list(F.struct(F.col("primary").isNotNull(), F.col("strategy_id"), F.col("common_pitfalls").alias("p"))))
        sums.append(distinct_pitfalls(F.flatten(F.transform(ordered, lambda x: x["p"]))).alias("__pitfalls"))
    per = named.join(plan.select(F.col("primary").alias("into")).distinct(), "into", "left_semi").groupBy("into").agg(*sums)
    rows = store.join(plan.select(F.col("secondary").alias("strategy_id")), "strategy_id", "left_anti").join(per.withColumnRenamed("into", "strategy_id"), "strategy_id", "left")
    changed = F.col("__n").isNotNull()
    new = {"success_rate": F.when(F.col("__n") > 0, F.col("__rate") / F.nullif("__n", F.lit(0))).otherwise(F.col("__mean")), "sample_count": F.col("__n"), "keywords": F.col("__keywords"), "version": F.col("version") + F.col("__merged")}
    if "common_pitfalls" in store.columns:
        new["common_pitfalls"] = F.col("__pitfalls")
    out = rows.select(*[(F.when(changed, new[c]).otherwise(F.col(c)) if c in new else F.col(c)).cast(t).alias(c) for c, t in store.dtypes])
    log = plan.join(out.select(F.col("strategy_id").alias("primary"), F.col("success_rate").alias("new_success_rate"), F.col("sample_count").alias("new_sample_count")), "primary")
    return out, log.select(F.col("primary").alias("primary_id"), F.col("secondary").alias("secondary_id"), "new_success_rate", "new_sample_count")


# ---- refining ----------------------------------------------------------------------------


def distinct_pitfalls(pitfalls: Column) -> Column:
    """The first pitfall of each mistake."""
    none = F.array().cast(PITFALLS)
    return F.aggregate(pitfalls, none, lambda s, p: F.when(F.exists(s, lambda x: x["mistake"] == p["mistake"]), s).otherwise(F.concat(s, F.array(p))))


def lessons(uses: DataFrame) -> DataFrame:
    """(strategy_id, new): the most frequent patterns of insights with a lesson in failed uses, as pitfalls; earlier by name among equals.

    uses: strategy_id, trajectory_id, outcome, insights (pattern, lesson, key_elements).
    """
    failed = uses.filter(~F.col("outcome").endswith("SUCCESS"))
    totals = failed.groupBy("strategy_id").agg(F.count(F.lit(1)).alias("failures"))
    each = failed.select("strategy_id", "trajectory_id", F.posexplode("insights").alias("at", "i"))
    per = each.groupBy("strategy_id", F.col("i.pattern").alias("mistake")).agg(F.count(F.nullif(F.col("i.lesson"), F.lit(""))).alias("n"), F.min_by("i", F.struct("trajectory_id", "at")).alias("i")).filter("n > 0")
    ranked = per.withColumn("rank", F.row_number().over(Window.partitionBy("strategy_id").orderBy(F.desc("n"), "mistake"))).filter(F.col("rank") <= NEW_PITFALLS)
    pitfall = F.struct("mistake", F.coalesce(F.nullif(F.col("i.lesson"), F.lit("")), F.lit(NO_LESSON)).alias("consequence"), F.coalesce(F.get("i.key_elements", F.lit(0)), F.lit(NO_FIX)).alias("fix"), (F.col("n") / F.col("failures")).alias("frequency"))
    rows = ranked.join(totals, "strategy_id").groupBy("strategy_id").agg(F.array_sort(F.collect_list(F.struct("rank", pitfall.alias("p")))).alias("x"))
    return rows.select("strategy_id", F.transform("x", lambda x: x["p"]).cast(PITFALLS).alias("new"))


def success_words(uses: DataFrame) -> DataFrame:
    """(strategy_id, words): the most frequent words of questions that were a full success; earlier by name among equals."""
    good = uses.filter(F.col("outcome") == "COMPLETE_SUCCESS").select("strategy_id", F.explode(F.filter(F.split(F.lower("question"), r"\s+"), lambda w: w != "")).alias("word"))
    per = good.groupBy("strategy_id", "word").agg(F.count(F.lit(1)).alias("n"))
    ranked = per.withColumn("rank", F.row_number().over(Window.partitionBy("strategy_id").orderBy(F.desc("n"), "word"))).filter(F.col("rank") <= FREQUENT)
    words = ranked.groupBy("strategy_id").agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("x"))
    return words.select("strategy_id", F.transform("x", lambda x: x["word"]).alias("words"))


def refine_strategies(store: DataFrame, uses: DataFrame) -> DataFrame:
    """The store after refining what ``uses`` (strategy_id, trajectory_id, question, outcome, insights) tells about.

    Rates move by EMA towards the share of full successes, samples grow by the uses, failures add
    pitfalls (of more than ten those of highest frequency stay, earlier ones among equals),
    successes add up to five long frequent words to the keywords, versions grow by one.
    Strategies without a use stay as they are.
    """
    per = uses.groupBy("strategy_id").agg(F.count(F.lit(1)).alias("uses"), F.avg((F.col("outcome") == "COMPLETE_SUCCESS").cast("double")).alias("rate"))
    rows = store.join(per, "strategy_id", "left").join(lessons(uses), "strategy_id", "left").join(success_words(uses), "strategy_id", "left")
    used, none = F.col("uses").isNotNull(), F.array().cast(PITFALLS)
    pitfalls = distinct_pitfalls(F.concat(F.coalesce("common_pitfalls", none), F.coalesce("new", none)))
    numbered = F.transform(pitfalls, lambda p, k: F.struct((-F.coalesce(p["frequency"], F.lit(0.0))).alias("less"), k.alias("k"), p.alias("p")))
    best = F.transform(F.slice(F.array_sort(numbered), 1, MOST_PITFALLS), lambda x: x["p"])
    words = F.filter(F.coalesce("words", F.array().cast("array<string>")), lambda w: (F.length(w) >= LONG_WORD) & ~F.array_contains("keywords", w))
    new = {
        "success_rate": ema(F.col("success_rate"), F.col("rate")), "sample_count": F.col("sample_count") + F.col("uses"), "version": F.col("version") + 1,
        "common_pitfalls": F.when(F.size(pitfalls) > MOST_PITFALLS, best).otherwise(pitfalls), "keywords": F.concat("keywords", F.slice(words, 1, NEW_KEYWORDS)),
    }
    return rows.select(*[(F.when(used, new[c]).otherwise(F.col(c)) if c in new else F.col(c)).cast(t).alias(c) for c, t in store.dtypes])


# ---- trying again ------------------------------------------------------------------------


def refine_with_feedback(questions: DataFrame, attempt, judge, feedback, rounds: int = 3) -> DataFrame:
    """Attempt, judge, and try again with what was wrong, until an attempt is right or ``rounds`` are over; one job a round for all questions.

    attempt(df, round) adds ``sql`` to questions with their last ``previous_sql`` and ``feedback``
    (null at first); judge(df) adds ``score``, ``exact_match`` and ``execution_match``;
    feedback(sql, score) is a column. Returns for each question its best attempt (the earliest
    of the highest score): its columns, sql, score, round, with ``attempts``, ``initial_score`` and ``improvement``.
    """
    left, tried = questions.withColumns({"previous_sql": F.lit(None).cast("string"), "feedback": F.lit(None).cast("string")}), []
    for k in range(rounds):
        tried.append(staged(judge(attempt(left, k)).withColumn("round", F.lit(k)), "attempts"))
        wrong = tried[-1].filter(~(F.col("exact_match") & F.col("execution_match")))
        if k + 1 == rounds or wrong.isEmpty():
            break
        left = wrong.select(*questions.columns, F.col("sql").alias("previous_sql"), feedback(F.col("sql"), F.col("score")).alias("feedback"))
    every = reduce(DataFrame.unionByName, tried)
    best = every.groupBy("q_id").agg(F.max_by(F.struct(*[c for c in every.columns if c != "q_id"]), F.struct("score", -F.col("round"))).alias("b"), F.count(F.lit(1)).alias("attempts"), F.min_by("score", "round").alias("initial_score"))
    return best.select("q_id", "b.*", "attempts", "initial_score", (F.col("b.score") - F.col("initial_score")).alias("improvement"))
