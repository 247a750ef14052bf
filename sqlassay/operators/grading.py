"""Clause-by-clause grading of parsed queries, difficulty, and score tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import common

#: The components, in report order.
COMPONENTS = ("select", "select(no AGG)", "where", "where(no OP)", "group(no Having)", "group", "order", "and/or", "IUEN", "keywords")
LEVELS = ("easy", "medium", "hard", "extra", "all")


def all_or_nothing(count: Column, pred: Column, label: Column) -> Column:
    """1 if prediction and label have as many parts as they share, else 0."""
    return F.when((pred == label) & (count == pred), F.lit(1.0)).otherwise(F.lit(0.0))


def _totals(pred: Column, gold: Column) -> dict[str, tuple[Column, Column, Column]]:
    """Per component: parts in common, of the prediction, of the label."""

    def bag(name: str) -> tuple[Column, Column, Column]:
        a, b = pred[name], gold[name]
        return common(a, b), F.size(a), F.size(b)

    def flag(c: Column) -> Column:
        return c.cast("int")

    def both(name: str) -> Column:
        return flag(F.coalesce(pred[name] == gold[name], F.lit(False)))

    grouped = [flag(F.size(x["group_ids"]) > 0) for x in (pred, gold)]
    same_group = flag((grouped[0] == 1) & (grouped[1] == 1) & (pred["group_ids"] == gold["group_ids"]) & (pred["having"] == gold["having"]))
    ordered = [flag(x["order_by"] != "") for x in (pred, gold)]
    same_order = flag((ordered[1] == 1) & (pred["order_by"] == gold["order_by"]) & (pred["has_limit"] == gold["has_limit"]))
    same_words = pred["connectors"] == gold["connectors"]
    words = [F.size(x["connectors"]) for x in (gold, pred)]  # totals of a mismatch come swapped
    sets = ("intersect_node", "except_node", "union_node")
    iuen = [sum(f) for f in zip(*((both(s), flag(pred[s].isNotNull()), flag(gold[s].isNotNull())) for s in sets))]
    return {
        "select": bag("select_items"), "select(no AGG)": bag("select_columns"), "where": bag("where_conds"), "where(no OP)": bag("where_units"),
        "group(no Having)": bag("group_names"), "group": (same_group, *grouped), "order": (same_order, *ordered),
        "and/or": (flag(same_words), F.when(same_words, 1).otherwise(words[0]), F.when(same_words, 1).otherwise(words[1])),
        "IUEN": tuple(iuen), "keywords": (F.size(F.array_intersect(pred["keywords"], gold["keywords"])), F.size(pred["keywords"]), F.size(gold["keywords"])),
    }


def partial_scores(pred: Column, gold: Column) -> Column:
    """Array of (component, score, pred_total, label_total); acc, rec and f1 are all the score."""
    return F.array(*[
        F.struct(F.lit(name).alias("component"), all_or_nothing(c, p, g).alias("score"), p.cast("int").alias("pred_total"), g.cast("int").alias("label_total"))
        for name, (c, p, g) in _totals(pred, gold).items()
    ])


def exact_match(scores: Column, pred: Column, gold: Column) -> Column:
    """All components match, and the tables do."""
    return F.forall(scores, lambda s: s["score"] == 1.0) & (F.array_sort(pred["table_units"]) == F.array_sort(gold["table_units"]))


def hardness(clauses: Column, nested: Column, others: Column) -> Column:
    """Difficulty from the counts of clauses, of nested queries, and of other complications."""
    flat = nested == 0
    easy = (clauses <= 1) & (others == 0) & flat
    medium = ((others <= 2) & (clauses <= 1) & flat) | ((clauses <= 2) & (others < 2) & flat)
    hard = ((others > 2) & (clauses <= 2) & flat) | ((clauses > 2) & (clauses <= 3) & (others <= 2) & flat) | ((clauses <= 1) & (others == 0) & (nested <= 1))
    return F.when(easy, "easy").when(medium, "medium").when(hard, "hard").otherwise("extra")


def hardness_of(gold: Column) -> Column:
    return hardness(gold["n_clauses"], gold["n_nested"], gold["n_others"])


def simple_difficulty(sql: Column) -> Column:
    """Of single-table SQL, by what occurs in its text."""
    up = F.upper(sql)
    parts = [up.rlike(r"COUNT|SUM|AVG|MAX|MIN").cast("int"), up.contains("GROUP BY").cast("int"), up.contains("ORDER BY").cast("int"), F.regexp_count(up, F.lit(" AND ")), F.regexp_count(up, F.lit(" OR "))]
    score = sum(parts[1:], parts[0])
    return F.when(score == 0, "easy").when(score <= 2, "medium").otherwise("hard")


#: What a statement without any clause looks like, for grading in place of one that does not parse.
EMPTY = {
    "select_items": "array()", "select_columns": "array()", "table_units": "array()", "where_conds": "array()", "where_units": "array()", "connectors": "array()", "group_names": "array()",
    "group_ids": "array()", "having": "'[]'", "order_by": "''", "has_limit": "false", "keywords": "array()",
}


def grade_turns(pairs: DataFrame, unparsed: str = "zero") -> DataFrame:
    """Grade rows with structs ``pred`` and ``gold`` (see functions.parser) and text ``pred_sql``.

    Adds hardness ('unknown' for placeholders), partial (array), exact_match, counted (false
    where the gold did not parse). A prediction that does not parse scores 0 or, with
    ``unparsed`` "empty", is graded as a statement without any clause.
    """
    placeholder = F.upper(F.trim(F.col("pred_sql"))) == "SELECT 1"
    counted = F.col("gold.error").isNull()
    graded = counted & ~placeholder
    if unparsed == "empty":
        kinds = {f.name: f.dataType.simpleString() for f in pairs.schema["pred"].dataType.fields}
        blank = [F.coalesce(f"pred.{c}", F.expr(v).cast(kinds[c])).alias(c) if (v := EMPTY.get(c)) else F.col(f"pred.{c}") for c in kinds]
        pairs = pairs.withColumn("pred", F.struct(*blank))
    else:
        graded = graded & F.col("pred.error").isNull()
    scores = F.when(graded, partial_scores(F.col("pred"), F.col("gold")))
    out = pairs.withColumn("counted", counted | placeholder).withColumn("hardness", F.when(placeholder, "unknown").when(counted, hardness_of(F.col("gold"))))
    out = out.withColumn("partial", scores)
    return out.withColumn("exact_match", F.coalesce(exact_match(F.col("partial"), F.col("pred"), F.col("gold")), F.lit(False)))


def score_table(graded: DataFrame, level: str = "hardness", **means: str) -> DataFrame:
    """Counts and means of the given columns by level and over all; one shuffle of partial sums."""
    levels = F.explode(F.array_distinct(F.array(F.col(level), F.lit("all")))).alias("level")
    aggs = [F.round(F.avg(F.col(c).cast("double")), 6).alias(name) for name, c in means.items()]
    return graded.select(levels, *sorted(set(means.values()))).groupBy("level").agg(F.count(F.lit(1)).alias("count"), *aggs)


def component_table(graded: DataFrame) -> DataFrame:
    """Mean score of each component by level; rows without scores count as zeros."""
    every = F.array(*[F.lit(c) for c in COMPONENTS])
    rows = graded.filter("counted").select(F.explode(F.array("hardness", F.lit("all"))).alias("level"), "partial")
    zero = F.transform(every, lambda c: F.struct(c.alias("component"), F.lit(0.0).alias("score")))
    scores = F.coalesce(F.transform("partial", lambda s: F.struct(s["component"].alias("component"), s["score"].alias("score"))), zero)
    each = rows.select("level", F.explode(scores).alias("s")).groupBy(F.col("s.component").alias("component")).pivot("level", list(LEVELS))
    return each.agg(F.round(F.avg("s.score"), 6))
