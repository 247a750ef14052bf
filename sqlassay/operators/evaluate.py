"""Grading a file of predictions end to end: read, normalise, parse, grade, execute, report."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parser, quotes, semantic, sqltext, statements
from ..sources import corpora
from ..staging import staged
from . import execute, grading, results

TURNS = ("turn 1", "turn 2", "turn 3", "turn 4", "turn > 4")


def pair_lines(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(line, session, sql, db_id) of gold and prediction -> line, session, turn, db_id, gold_sql, pred_sql.

    Lines without a prediction have an empty one. Turns count from 1 in a session, whose lines
    follow one another.
    """
    g = gold.select("line", "session", "db_id", F.col("sql").alias("gold_sql"))
    first = g.groupBy("session").agg(F.min("line").alias("__first"))
    rows = g.join(first, "session").withColumn("turn", (F.col("line") - F.col("__first") + 1).cast("int")).drop("__first")
    return rows.join(pred.select("line", F.col("sql").alias("pred_sql")), "line", "left").withColumn("pred_sql", F.coalesce("pred_sql", F.lit("")))


def normalised_pairs(pairs: DataFrame) -> DataFrame:
    """gold_sql and pred_sql in the form that is parsed and executed; needs column catalog (JSON {table: [columns]}).

    The gold: canonical, NOT and NULL tests. The prediction: canonical, without backticks,
    the single table named, NOT and NULL tests repaired, underscores as the schema has them. A
    placeholder stays one.
    """
    known = F.flatten(F.map_values(F.from_json("catalog", "map<string,array<string>>")))
    gold = statements.null_form(quotes.canonical(F.col("gold_sql")))
    pred = F.regexp_replace(F.replace(quotes.canonical(F.col("pred_sql")), F.lit("`"), F.lit("")), r"(?i)\b(from|join)\s+table\b", f"$1 {sqltext.SINGLE_TABLE}")
    pred = sqltext.collapse_underscores(quotes.repair_prediction(pred), F.transform(F.coalesce(known, F.array().cast("array<string>")), F.lower))
    holds = sqltext.is_placeholder(F.col("pred_sql"))
    return pairs.withColumns({"raw_gold": F.col("gold_sql"), "raw_pred": F.col("pred_sql")}).withColumns({"gold_sql": gold, "pred_sql": F.when(holds, sqltext.PLACEHOLDER).otherwise(pred)})


def grade(pairs: DataFrame, catalogs: DataFrame, verdicts: DataFrame | None = None, compat: bool = True) -> DataFrame:
    """Grade rows (line, db_id, gold_sql, pred_sql, ...) under the catalogs (db_id, catalog).

    Adds gold, pred (parsed), counted, hardness, partial, exact_match and, from verdicts (line,
    equal), execution_match. Equal statements of a database are parsed once. A gold that does
    not parse leaves the denominator; rows without a database do not appear.
    """
    rows = staged(normalised_pairs(pairs.join(catalogs, "db_id")), "normalised")  # read for the texts, and for each side
    texts = rows.select("db_id", "catalog", F.explode(F.array("gold_sql", "pred_sql")).alias("sql")).distinct()
    parsed = parser.parse_statements(texts, "sql", "catalog", "parsed", compat).select("db_id", "sql", "parsed")
    for side in ("gold", "pred"):
        rows = rows.join(parsed.toDF("db_id", f"{side}_sql", side), ["db_id", f"{side}_sql"])
    out = grading.grade_turns(rows)
    if verdicts is None:
        return out.withColumn("execution_match", F.lit(False))
    return out.join(verdicts.select("line", F.col("equal").alias("execution_match")), "line", "left").withColumn("execution_match", F.coalesce("execution_match", F.lit(False)))


# What may stand between two words that a statement is made of: literals and quoted names, kept as they are.
_DISTINCT = re.compile(r"('(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`)|\bdistinct\b", re.I)
_YEAR = re.compile(r"year\s*\(\s*curdate\s*\(\s*\)\s*\)\s*", re.I)


def without_distinct(sql: str) -> str:
    """The statement without the word DISTINCT, wherever it is not part of a literal or a quoted name."""
    return _DISTINCT.sub(lambda m: m[1] or "", sql)


def executable(sql: str, keep_distinct: bool = False) -> str:
    """A statement as it is run: operators joined, the current year fixed, DISTINCT dropped unless kept."""
    for a, b in (("> =", ">="), ("< =", "<="), ("! =", "!=")):
        sql = sql.replace(a, b)
    return _YEAR.sub("2020", sql if keep_distinct else without_distinct(sql))


def execution_verdicts(
    spark: SparkSession, pairs: Iterable[tuple], keep_distinct: bool = False, prepare: Callable[[str], str] | None = None, seconds: float = execute.SECONDS, workers: int = execute.WORKERS
) -> DataFrame:
    """(line, equal, status, error) of (line, gold_sql, pred_sql): whether both give the same rows; in order where the gold sorts.

    Every statement runs by itself (see execute.run_statements): one that fails or never ends
    costs its own pair, whose status and error are then the gold's, or else the prediction's.
    DISTINCT is dropped on both sides unless kept; ``prepare`` may put a statement into Spark's
    dialect. The driver holds the statements, not their rows.
    """
    pairs = [(line, executable(g, keep_distinct), executable(p, keep_distinct)) for line, g, p in pairs]
    rows, outcomes = execute.run_statements(spark, ((line, side, sql) for line, g, p in pairs for side, sql in ((-1, g), (1, p))), prepare, seconds, workers)
    asked = spark.createDataFrame([(line, "order by" in g.lower()) for line, g, _ in pairs], "query_id long, ordered boolean")
    failed = outcomes.filter(F.col("status") != execute.RESULT)
    failed = failed.groupBy("query_id").agg(F.min_by(F.struct("status", "error"), "side").alias("f"))
    out = results.results_equal(asked, results.placed(rows)).join(failed, "query_id", "left")
    good = F.col("f").isNull()
    return out.select(F.col("query_id").alias("line"), (F.col("equal") & good).alias("equal"), F.when(good, execute.RESULT).otherwise(F.col("f.status")).alias("status"), F.col("f.error").alias("error"))


# ---- reports -----------------------------------------------------------------------------


def report(graded: DataFrame) -> DataFrame:
    """(level, count, exact, exec): by difficulty, over all, by turn, and over whole sessions (joint_all)."""
    rows = graded.filter("counted").withColumns({"exact": F.col("exact_match").cast("double"), "exec": F.col("execution_match").cast("double")})
    rows = staged(rows.select("session", "turn", "hardness", "exact", "exec"), "grades")  # read twice
    turn = F.when(F.col("turn") > 4, TURNS[4]).otherwise(F.concat(F.lit("turn "), F.col("turn").cast("string")))
    each = rows.select("session", F.explode(F.array("hardness", F.lit("all"), turn)).alias("level"), "exact", "exec")
    joint = rows.groupBy("session").agg(F.min("exact").alias("exact"), F.min("exec").alias("exec")).select(F.lit("joint_all").alias("level"), "exact", "exec")
    per = each.select("level", "exact", "exec").unionByName(joint).groupBy("level")
    return per.agg(F.count(F.lit(1)).alias("count"), F.round(F.avg("exact"), 6).alias("exact"), F.round(F.avg("exec"), 6).alias("exec"))


def summary_lines(scores: DataFrame, title: str, extra: dict[str, dict] | None = None) -> DataFrame:
    """The summary report as rows (place, text): main metrics, further sections, a line for each level."""
    share = lambda c: F.format_string("%.2f%%", 100 * F.coalesce(c, F.lit(0.0)))
    spark = scores.sparkSession
    head = [(0, f"{title} EVALUATION SUMMARY"), (1, "MAIN METRICS")]
    tail = [(100 + k, t) for k, t in enumerate(t for name, values in (extra or {}).items() for t in (name.upper(), *(f"  {a}: {b}" for a, b in values.items())))]
    whole = scores.filter("level = 'all'")
    main = whole.select(F.explode(F.array(
        F.struct(F.lit(2).alias("place"), F.concat(F.lit("  Exact Match Accuracy : "), share(F.col("exact"))).alias("text")),
        F.struct(F.lit(3).alias("place"), F.concat(F.lit("  Execution Accuracy   : "), share(F.col("exec"))).alias("text")),
        F.struct(F.lit(4).alias("place"), F.concat(F.lit("  Total Evaluated      : "), F.col("count").cast("string")).alias("text")),
    )).alias("x")).select("x.*")
    order = F.array_position(F.array(*map(F.lit, grading.LEVELS)), F.col("level"))
    line = F.concat(F.lit("  "), F.rpad("level", 8, " "), F.lit(" | count="), F.rpad(F.col("count").cast("string"), 5, " "), F.lit(" | EM="), share(F.col("exact")), F.lit(" | EX="), share(F.col("exec")))
    levels = scores.filter(order > 0).select((1000 + order).cast("int").alias("place"), line.alias("text"))
    fixed = spark.createDataFrame([*head, *tail, (1000, "PER-DIFFICULTY BREAKDOWN")], "place int, text string")
    return fixed.unionByName(main).unionByName(levels)


def summary_text(scores: DataFrame, title: str, extra: dict[str, dict] | None = None) -> str:
    """summary_lines() as one text: some twenty lines."""
    return "\n".join(r["text"] for r in summary_lines(scores, title, extra).orderBy("place").collect())


def structural_lines(accuracy: DataFrame, failures: DataFrame) -> DataFrame:
    """Rows (place, text) of the structural report: totals, component accuracies, failure counts from the most frequent on."""
    share = lambda c: F.format_string("%.2f%%", 100 * F.col(c))
    names = (("Structural EM", "em"), ("AGG accuracy", "agg_accuracy"), ("SEL accuracy", "sel_accuracy"), ("COND accuracy", "cond_accuracy"), ("Parse rate", "parse_rate"))
    parts = [F.struct(F.lit(k).alias("place"), F.concat(F.lit(f"{name:<16}: "), share(c)).alias("text")) for k, (name, c) in enumerate(names)]
    parts.append(F.struct(F.lit(len(names)).alias("place"), F.concat(F.lit(f"{'Parse failures':<16}: "), F.col("parse_failures").cast("string")).alias("text")))
    head = accuracy.select(F.explode(F.array(*parts)).alias("x")).select("x.*")
    from pyspark.sql import Window

    rank = F.row_number().over(Window.orderBy(F.desc("count"), "category"))  # one row a category
    rest = failures.filter("category <> 'ok'").select((100 + rank).cast("int").alias("place"), F.concat(F.rpad("category", 22, " "), F.lit(": "), F.col("count").cast("string")).alias("text"))
    return head.unionByName(rest)


def printed_table(wide: DataFrame, label: str, columns: tuple[str, ...] = grading.LEVELS) -> DataFrame:
    """A table with a column for each level as lines of fixed width: (label, line)."""
    cells = [F.rpad(F.format_string("%.3f", F.coalesce(F.col(c), F.lit(0.0))), 20, " ") for c in columns]
    return wide.select(label, F.rtrim(F.concat(F.rpad(label, 20, " "), F.lit(" "), F.concat_ws(" ", *cells))).alias("line"))


# ---- wrapping ----------------------------------------------------------------------------


def grade_with_analysis(graded: DataFrame, question: str = "question") -> tuple[DataFrame, DataFrame]:
    """Graded rows with the analysis of their question, and statistics of the analyses of all."""
    rows = graded.withColumn("analysis", semantic.analyse(F.col(question)))
    return rows, semantic.batch_statistics(rows)


def grader(kind: str) -> Callable[..., DataFrame]:
    """The grading function of a kind of corpus: 'multi' (several tables) or 'single'."""
    from . import singletable

    kinds = {"multi": grade, "single": singletable.accuracy}
    if kind not in kinds:
        raise ValueError(f"unknown kind {kind!r}; there are {', '.join(kinds)}")
    return kinds[kind]


def clean_question(question: Column) -> Column:
    return sqltext.one_space(question)


def grade_files(spark: SparkSession, gold: str, pred: str, catalog: str, execute: bool = False) -> tuple[DataFrame, DataFrame]:
    """Graded rows and report of two files of lines ``sql<TAB>db_id`` and a catalog file (JSON).

    With ``execute``, both statements of each line run on the session's tables.
    """
    catalogs = corpora.catalog_json(corpora.catalog_rows(corpora.read_json(spark, catalog, corpora.CATALOG)))
    pairs = pair_lines(corpora.read_sessions(spark, gold), corpora.read_sessions(spark, pred))
    verdicts = None
    if execute:
        found = normalised_pairs(pairs.join(catalogs, "db_id")).select("line", "gold_sql", "pred_sql")
        verdicts = execution_verdicts(spark, map(tuple, found.toLocalIterator()))
    graded = grade(pairs, catalogs, verdicts)
    return graded, report(graded)
