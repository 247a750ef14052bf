"""Rules that say what a question asks for, and SQL from patterns alone."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default metrics, dimensions, entities and intents with the words that show them.
METRICS = {
    "record_count": ("how many", "count", "number of", "total"), "distinct_count": ("unique", "distinct", "different"), "average_value": ("average", "mean", "avg"),
    "sum_value": ("total", "sum", "amount"), "max_value": ("maximum", "max", "highest", "largest", "top"), "min_value": ("minimum", "min", "lowest", "smallest", "bottom"),
}
DIMENSIONS = {"temporal": ("by year", "by month", "by day", "over time", "yearly", "monthly", "daily", "temporal"), "categorical": ("by category", "by type", "by group", "by class", "categorical")}
ENTITIES = {"car": ("car", "cars", "vehicle", "automobile"), "student": ("student", "students", "pupil"), "customer": ("customer", "customers", "client")}
INTENTS = {
    "aggregation": ("count", "total", "sum", "average", "max", "min"), "grouping": ("by", "per", "group", "each", "every"), "filtering": ("where", "with", "having", "that", "which"),
    "ordering": ("top", "bottom", "highest", "lowest", "first", "last"), "comparison": ("greater", "less", "more", "fewer", "above", "below"),
}
# Whole words that call for an aggregate, in the order they are tried.
AGGREGATE_HINTS = {
    "COUNT": ("how many", "number of", "count", "total number"),
    "SUM": ("total", "sum"),
    "MAX": ("highest", "most", "largest", "maximum", "max", "latest"),
    "MIN": ("lowest", "fewest", "smallest", "minimum", "min", "earli", "first"),
    "AVG": ("average", "mean", "avg"),
}


def matched(question: Column, rules: dict[str, tuple[str, ...]]) -> Column:
    """Names of the rules of which a word occurs, in rule order."""
    q = F.lower(question)
    # one search a rule: whichever of its words comes first ends it
    return F.array_compact(F.array(*[F.when(q.rlike("|".join(re.escape(x) for x in w)), F.lit(k)) for k, w in rules.items()]))


def rules_from_config(spark, config: dict) -> DataFrame:
    """Rules (kind, name, keyword) from a configuration: metrics' *_patterns, dimensions, entities with their keywords.

    A configuration may be wrapped in ``semantic_layer_config``. Without any rule the default ones apply.
    """
    config = config.get("semantic_layer_config", config)
    names = {"count_patterns": "record_count", "distinct_count_patterns": "distinct_count", "avg_patterns": "average_value", "sum_patterns": "sum_value", "max_patterns": "max_value", "min_patterns": "min_value"}
    rows = [("metric", names.get(k, k.removesuffix("_patterns")), w) for k, ws in config.get("metrics", {}).items() for w in ws]
    rows += [("dimension", k.removesuffix("_patterns"), w) for k, ws in config.get("dimensions", {}).items() for w in ws]
    rows += [("entity", k, w) for k, ws in config.get("entities", {}).items() for w in (ws.get("keywords", [k]) if isinstance(ws, dict) else ws)]
    if not rows:
        rows = [(kind, k, w) for kind, rules in (("metric", METRICS), ("dimension", DIMENSIONS), ("entity", ENTITIES)) for k, ws in rules.items() for w in ws]
    return spark.createDataFrame(rows, "kind string, name string, keyword string")


def with_rule(rules: DataFrame, kind: str, name: str, *keywords: str) -> DataFrame:
    """The rules and one more."""
    return rules.unionByName(rules.sparkSession.createDataFrame([(kind, name, w) for w in keywords], "kind string, name string, keyword string"))


def rule_matches(questions: DataFrame, rules: DataFrame, key: str = "q_id", text: str = "question", most_broadcast: int = 10_000) -> DataFrame:
    """The same with rules as a table (name, keyword): one row per question and rule that matches.

    Up to ``most_broadcast`` rules are broadcast. Of more, a question meets those alone that
    begin with three letters it has in a row, by a hash join.
    """
    if rules.limit(most_broadcast + 1).count() <= most_broadcast:
        pairs = questions.join(F.broadcast(rules), F.lower(text).contains(F.lower("keyword")))
        return pairs.select(key, "name").distinct()
    heads = rules.select("name", F.lower("keyword").alias("__word")).withColumn("__head", F.substring("__word", 1, 3))
    sizes = [r["n"] for r in heads.select(F.length("__head").alias("n")).distinct().collect() if r["n"]]  # of 1, 2 and 3
    asked = questions.select(key, F.lower(text).alias("__text"))
    grams = [F.array_distinct(F.regexp_extract_all("__text", F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1))) for n in sizes]
    # texts stay out of the exploded rows, and are joined to what came through
    met = asked.select(key, F.explode(F.flatten(F.array(*grams))).alias("__head")).join(heads, "__head").select(key, "name", "__word")
    return met.join(asked, key).filter(F.col("__text").contains(F.col("__word"))).select(key, "name").distinct()


def schema_entities(question: Column, tables: Column) -> Column:
    """Tables whose name, singular or plural, or a part of it, is a word of the question."""
    words = F.filter(F.split(F.lower(question), "[^a-z]+"), lambda w: w != "")

    def names(t: Column) -> Column:
        low = F.lower(t)
        forms = F.array(low, F.regexp_replace(low, "s$", ""), F.concat(low, F.lit("s")))
        return F.concat(forms, F.filter(F.split(low, "_"), lambda p: F.length(p) > 2))

    return F.filter(tables, lambda t: F.arrays_overlap(names(t), words))


def analyse(question: Column) -> Column:
    """struct(metrics, dimensions, entities, intents, complexity, complexity_text, label)."""
    m, d, e, i = (matched(question, r) for r in (METRICS, DIMENSIONS, ENTITIES, INTENTS))
    score = 2 * F.size(m) + F.size(d) + F.size(e)
    return F.struct(m.alias("metrics"), d.alias("dimensions"), e.alias("entities"), i.alias("intents"), score.alias("complexity"), complexity_text(score).alias("complexity_text"), difficulty_label(F.size(m), F.size(d)).alias("label"))


def complexity_text(score: Column) -> Column:
    return F.when(score <= 2, "simple").when(score <= 5, "medium").when(score <= 8, "complex").otherwise("very complex")


def difficulty_label(metrics: Column, dimensions: Column) -> Column:
    return F.when((metrics == 0) & (dimensions <= 1), "easy").when((metrics > 2) | (dimensions > 3), "hard").otherwise("medium")


def suggested_patterns(a: Column) -> Column:
    tests = [
        (F.array_contains(a["metrics"], "record_count"), "SELECT COUNT(*) FROM t"), (F.array_contains(a["metrics"], "average_value"), "SELECT AVG(c) FROM t"),
        (F.array_contains(a["metrics"], "sum_value"), "SELECT SUM(c) FROM t"), (F.size(a["dimensions"]) > 0, "GROUP BY dimension"), (F.array_contains(a["intents"], "ordering"), "ORDER BY c LIMIT n"),
        (F.array_contains(a["intents"], "filtering"), "WHERE condition"),
    ]
    return F.array_distinct(F.array_compact(F.array(*[F.when(t, F.lit(p)) for t, p in tests])))


def enhance(sql: Column, a: Column) -> Column:
    """SELECT * becomes a count where one is asked for; hints follow as a comment."""
    counted = F.when(F.array_contains(a["metrics"], "record_count"), F.regexp_replace(sql, r"(?i)^\s*SELECT\s+\*", "SELECT COUNT(*)")).otherwise(sql)
    hints = F.concat_ws(", ", F.when(F.size(a["dimensions"]) > 0, "group by dimension"), F.when(F.array_contains(a["intents"], "ordering"), "order the result"))
    return F.when(hints != "", F.concat(counted, F.lit(" -- "), hints)).otherwise(counted)


def approach(a: Column) -> Column:
    return F.when(F.size(a["dimensions"]) > 0, "group and aggregate").when(F.size(a["metrics"]) > 0, "aggregate").when(F.array_contains(a["intents"], "ordering"), "sort and cut").otherwise("select and filter")


def relevant_columns(columns: DataFrame, question: Column) -> DataFrame:
    """Catalog rows (.., column) of which a part occurs in the question of the same row."""
    parts = F.filter(F.split(F.lower("column"), "_"), lambda p: F.length(p) > 2)
    return columns.filter(F.exists(parts, lambda p: F.lower(question).contains(p)))


def hints(a: Column) -> Column:
    line = lambda name, x: F.when(F.size(x) > 0, F.concat(F.lit(f"{name}: "), F.array_join(x, ", ")))
    return F.concat_ws("\n", line("Metrics", a["metrics"]), line("Dimensions", a["dimensions"]), line("Entities", a["entities"]), F.concat(F.lit("Complexity: "), a["complexity_text"]))


def bundle(question: Column, sql: Column) -> Column:
    """All that is said of a question in one struct: analysis, hints, approach, patterns, and the statement enhanced."""
    a = analyse(question)
    return F.struct(a.alias("analysis"), hints(a).alias("hints"), approach(a).alias("approach"), suggested_patterns(a).alias("patterns"), enhance(sql, a).alias("sql"))


def with_hints(prompt: Column, a: Column) -> Column:
    """A prompt with the hints of its question after it."""
    return F.concat(prompt, F.lit("\n\nHints:\n"), hints(a))


def batch_statistics(analysed: DataFrame, a: str = "analysis") -> DataFrame:
    c = F.col(f"{a}.complexity")
    return analysed.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(c), 6).alias("avg_complexity"), F.min(c).alias("min_complexity"), F.max(c).alias("max_complexity"), F.sum(F.size(f"{a}.entities")).alias("entities"))


def aggregate_hint(question: Column) -> Column:
    q, out = F.lower(question), F.lit("NONE")
    for name, words in reversed(AGGREGATE_HINTS.items()):
        out = F.when(q.rlike(rf"\b({'|'.join(words)})\b"), name).otherwise(out)
    return out


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def best_column(question: Column, columns: Column) -> Column:
    """The column with most words in the question; the first among equals; null without any."""
    hits = F.transform(columns, lambda c: F.size(F.array_intersect(_words(c), _words(question))))
    most = F.array_max(hits)
    return F.when(most > 0, F.element_at(columns, F.array_position(hits, most).cast("int")))


# Whole words that ask for an aggregate, in the order they are tried, and those between a column and its value.
ASKED = {
    "COUNT": ("how many", "total number", "count"),
    "MAX": ("highest", "most", "maximum", "largest"),
    "MIN": ("lowest", "minimum", "smallest", "fewest"),
    "AVG": ("average", "mean"),
    "SUM": ("total", "sum"),
}
EQUALS = ("is", "was", "are", "=")


def generate(question: Column, table: Column, columns: Column) -> Column:
    """SQL over one table from patterns alone: the generator that needs no model.

    Words count as whole words. Without an aggregate, the first column that the question names
    right before ``is`` or the like gives a condition; values are in lower case.
    """
    q, best = F.lower(question), best_column(question, columns)
    col = F.coalesce(best, F.get(columns, F.lit(0)), F.lit("*"))
    agg = F.lit("")
    for name, words in reversed(ASKED.items()):
        agg = F.when(q.rlike(rf"\b(?:{'|'.join(words)})\b"), name).otherwise(agg)

    def said(c: Column) -> Column:
        name = F.translate(F.lower(c), "_-", "  ")
        pattern = F.concat(F.lit("\\b\\Q"), name, F.lit(rf"\E\b\s+(?:{'|'.join(EQUALS)})\s+['\"]?([^'\"?,]+)"))
        return F.struct(c.alias("column"), F.trim(F.call_function("regexp_extract", q, pattern, F.lit(1))).alias("value"))

    named = F.get(F.filter(F.transform(columns, said), lambda x: x["value"] != ""), F.lit(0))
    where = F.coalesce(F.concat(F.lit(" WHERE "), named["column"], F.lit(" = '"), named["value"], F.lit("'")), F.lit(""))
    plain = F.concat(F.lit("SELECT "), F.coalesce(best, F.lit("*")), F.lit(" FROM "), table, where)
    return F.when(agg == "", plain).otherwise(F.concat(F.lit("SELECT "), agg, F.lit("("), col, F.lit(") FROM "), table))
