"""Grading of single-table queries as {agg, sel, conds}: fuzzy columns and values, failures by kind."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import jaccard, once
from ..staging import staged

# Aggregate numbers of single-table queries, months, and what separates words in headers.
AGGREGATES = ("", "MAX", "MIN", "COUNT", "SUM", "AVG")
MONTHS = "january february march april may june july august september october november december".split()
SEPARATORS = r"""[\s_/.()\-,;:#&'"!?%@$]+"""


def column_name(c: Column) -> Column:
    """A header for comparing: lower case, separators to spaces, digits on their own."""
    spaced = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), SEPARATORS, " "), r"(\d+)", " $1 ")
    return F.trim(F.regexp_replace(spaced, r"\s+", " "))


def safe_headers(df: DataFrame, key: str, headers: str, reserved: tuple[str, ...] = ("group", "order", "table", "select", "from", "where", "index", "limit", "join", "to", "by")) -> DataFrame:
    """(key, idx, header, safe): headers as identifiers, repeated ones numbered from _1 on."""
    rows = df.select(key, F.posexplode(headers).alias("idx", "header"))
    name = F.regexp_replace(F.regexp_replace("header", r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", "")
    name = F.when(name == "", F.lit("col")).otherwise(F.when(F.lower(name).isin(*reserved), F.concat(name, F.lit("_col"))).otherwise(name))
    rows = rows.withColumn("__name", name)
    before = F.row_number().over(Window.partitionBy(key, F.lower("__name")).orderBy("idx")) - 1
    return rows.withColumn("safe", F.when(before > 0, F.concat_ws("_", "__name", before.cast("string"))).otherwise(F.col("__name"))).drop("__name")


def value_lite(c: Column) -> Column:
    """value() without dates, number formats, articles and leftovers of cards: quotes and percent signs go, case too."""
    v = F.lower(F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(c, "[−–]", "-")), "^[\"']+|[\"']+$", ""), "%+$", ""))
    return once(v, lambda x: once(F.when(x.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)$"), x.try_cast("double")), lambda n: F.struct(n.alias("num"), F.when(n.isNull(), x).alias("str"))))


def resolve_column(name: Column, headers: Column, least: float = 0.6, min_tokens: int = 1, lite: bool = False, names: Column | None = None) -> Column:
    """Index of the header that ``name`` means, or null; ``lite`` does not look inside AGG(...) or behind col_.

    ``names`` are the normalised headers, where they have been made already.

    colN; the very name; the normalised name; the name without AGG(...) or col_; the most
    alike by words, from ``least`` on; the first that begins like it, or it like that.
    """
    bare = F.regexp_replace(F.trim(name), r"(?i)^(?:MAX|MIN|COUNT|SUM|AVG)\s*\(\s*(?:DISTINCT\s+)?(.*?)\s*\)$", "$1") if not lite else F.trim(name)
    names = F.transform(headers, column_name) if names is None else names

    def resolve(x: Column) -> Column:
        """x: number (of colN), bare, want (the normalised name), words, names (the normalised headers)."""
        want, words, known = x["want"], x["words"], x["names"]

        def first(test) -> Column:
            return once(F.array_position(F.transform(known, test), True), lambda hit: F.when(hit > 0, hit - 1))

        exact = F.array_position(headers, x["bare"])
        alike = F.transform(known, lambda h: F.when((F.size(words) >= min_tokens), jaccard(F.split(h, " "), words)).otherwise(F.lit(0.0)))
        near = once(alike, lambda a: F.when(F.array_max(a) >= least, F.array_position(a, F.array_max(a)) - 1))
        numbered = F.when(x["number"].cast("int") < F.size(headers), x["number"].cast("int"))
        found = F.coalesce(
            F.when(exact > 0, exact - 1), first(lambda h: h == want), near,
            F.when(want != "", first(lambda h: h.startswith(want) | want.startswith(h))),
        )
        return F.when(x["number"] != "", numbered).otherwise(found).cast("int")

    def described(b: Column) -> Column:
        plain = b if lite else F.regexp_replace(b, r"(?i)^col_", "")
        return once(column_name(plain), lambda w: F.struct(F.regexp_extract(F.lower(b), r"^col(\d{1,6})$", 1).alias("number"), plain.alias("bare"), w.alias("want"), F.split(w, " ").alias("words"), names.alias("names")))

    return once(once(bare, described), resolve)


def operator_index(op: Column) -> Column:
    return F.when(op == "=", 0).when(op.isin(">", ">="), 1).when(op.isin("<", "<="), 2).otherwise(3)


def iso_date(c: Column) -> Column:
    """Month D, YYYY and D Month YYYY as YYYY-MM-DD; other text as it is."""
    us, uk = r"^([a-z]+) (\d{1,2}), (\d{4})$", r"^(\d{1,2}) ([a-z]+) (\d{4})$"
    months = F.array(*map(F.lit, MONTHS))

    def build(low: Column, pattern: str, m: int, d: int) -> Column:
        number = lambda n: F.when(n > 0, F.concat_ws("-", F.regexp_extract(low, pattern, 3), F.lpad(n.cast("string"), 2, "0"), F.lpad(F.regexp_extract(low, pattern, d), 2, "0")))
        return F.when(low.rlike(pattern), once(F.array_position(months, F.regexp_extract(low, pattern, m)), number))

    return F.coalesce(once(F.lower(F.trim(c)), lambda low: F.coalesce(build(low, us, 1, 2), build(low, uk, 2, 1))), c)


def number_text(c: Column) -> Column:
    """A decimal comma becomes a point; thousands commas go."""
    return F.when(c.rlike(r"^\d+,\d{1,2}$"), F.replace(c, F.lit(","), F.lit("."))).when(c.rlike(r"^\d{1,3}(,\d{3})+(\.\d+)?$"), F.replace(c, F.lit(","), F.lit(""))).otherwise(c)


def value(c: Column) -> Column:
    """struct(num, str) of a condition's value: num if it reads as a number, else normalised text."""
    v = F.regexp_replace(F.trim(c), "%+$", "")
    v = F.regexp_replace(v, "[−–]", "-")
    v = F.regexp_replace(F.regexp_replace(v, '^"+|"+$', ""), "^'+|'+$", "")
    v = F.lower(F.regexp_replace(F.regexp_replace(v, r"(?i)\s*category:articles with hcards$", ""), r"(?i)^the\s+", ""))

    def shown(plain: Column) -> Column:
        num = F.when(plain.rlike(r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"), plain.try_cast("double"))
        text = F.when(plain.rlike(r"[a-z]"), F.trim(F.regexp_replace(plain, r"\s+", " "))).otherwise(F.regexp_replace(plain, r"[\s,]+", ""))
        return once(num, lambda n: F.struct(n.alias("num"), F.when(n.isNull(), text).alias("str")))

    def read(x: Column) -> Column:
        dated = lambda d: F.when(d != x, F.struct(F.lit(None).cast("double").alias("num"), d.alias("str"))).otherwise(once(number_text(x), shown))
        return once(iso_date(x), dated)

    return once(v, read)


def values_match(a: Column, b: Column) -> Column:
    """Relaxed: equal, numbers within 1e-9, or one text begins with the other (an empty one with any)."""
    texts = a["str"].startswith(b["str"]) | b["str"].startswith(a["str"])
    return F.coalesce(F.abs(a["num"] - b["num"]) < 1e-9, texts, F.lit(False))


def values_match_strict(a: Column, b: Column) -> Column:
    """Numbers within 1e-6; digits in text; a prefix of 4 or more and 0.6 of the length; a part of 6 or more and 0.5; the part before a comma."""
    x, y = a["str"], b["str"]
    short, long = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
    share = F.length(short) / F.greatest(F.length(long), F.lit(1))
    texts = (x == y) | (long.startswith(short) & (F.length(short) >= 4) & (share >= 0.6)) | (long.contains(short) & (F.length(short) >= 6) & (share >= 0.5)) | (F.trim(F.substring_index(x, ",", 1)) == y) | (F.trim(F.substring_index(y, ",", 1)) == x)

    def digits(n: Column, s: Column) -> Column:
        shown = F.when(n == F.floor(n), F.format_string("%.0f", n)).otherwise(n.cast("string"))
        return shown == F.regexp_replace(s, "[, ]", "")

    return F.coalesce(F.abs(a["num"] - b["num"]) < 1e-6, texts, digits(a["num"], y), digits(b["num"], x), F.lit(False))


def conditions_match(pred: Column, gold: Column, match=values_match, relaxed: bool = True) -> Column:
    """Whether every gold condition finds a prediction of its own; arrays of struct(col, op, val: struct(num, str)).

    For each gold condition in turn, the first free prediction with its column, operator and
    value; else with operator and value; else, relaxed, with column and value.
    """

    def rank(p: Column, g: Column) -> Column:
        """1, 2 or 3 by what the two have in common beside the value, which is compared once and last."""
        col, op = p["col"] == g["col"], p["op"] == g["op"]
        kind = F.when(col & op, 1).when(op, 2)
        kind = kind.when(col, 3) if relaxed else kind
        return F.when(op | col if relaxed else op, F.when(match(p["val"], g["val"]), kind))

    def compare(x: Column) -> Column:
        def take(acc: Column, g: Column) -> Column:
            ranks = F.zip_with(acc["free"], x["p"], lambda f, p: F.when(f, rank(p, g)))
            found = once(ranks, lambda r: F.coalesce(F.array_position(r, F.array_min(r)), F.lit(0)))
            return once(found, lambda n: F.struct(F.transform(acc["free"], lambda f, k: f & (k + 1 != n)).alias("free"), (acc["ok"] & (n > 0)).alias("ok")))

        start = F.struct(F.transform(x["p"], lambda p: F.lit(True)).alias("free"), (F.size(x["p"]) >= F.size(x["g"])).alias("ok"))
        return F.aggregate(x["g"], start, take, lambda a: a["ok"])

    # both are worked out once a row, not once for each pair of their conditions
    return once(F.struct(pred.alias("p"), gold.alias("g")), compare)


def structural(pred: Column, gold: Column, match=values_match, relaxed: bool = True) -> Column:
    """struct(agg_ok, sel_ok, cond_ok, em) of {agg, sel, conds} structs; COUNT ignores the column; a missing MAX or MIN is forgiven if gold has conditions."""

    def compare(x: Column) -> Column:
        p, g = x["p"], x["g"]
        agg = p["agg"] == g["agg"]
        if relaxed:
            agg = agg | ((p["agg"] == 0) & g["agg"].isin(1, 2) & (F.size(g["conds"]) > 0))
        sel = (p["sel"] == g["sel"]) | ((p["agg"] == 3) & (g["agg"] == 3))
        made = F.struct(agg.alias("agg"), sel.alias("sel"), conditions_match(p["conds"], g["conds"], match, relaxed).alias("cond"))
        return once(made, lambda m: F.struct(m["agg"].alias("agg_ok"), m["sel"].alias("sel_ok"), m["cond"].alias("cond_ok"), (m["agg"] & m["sel"] & m["cond"]).alias("em")))

    return once(F.struct(pred.alias("p"), gold.alias("g")), compare)


def parse_single(sql: Column, headers: Column) -> Column:
    """{agg, sel, conds, count_star} of a statement over one table with these headers; null if its column is unknown."""
    return once(F.transform(headers, column_name), lambda names: _parse_single(sql, headers, names))


def _parse_single(sql: Column, headers: Column, names: Column) -> Column:
    """parse_single() with the normalised headers."""
    fn = r"(?i)\b(MAX|MIN|COUNT|SUM|AVG)\s*\(\s*(?:DISTINCT\s+)?([^)]*?)\s*\)"
    agg = F.array_position(F.array(*map(F.lit, AGGREGATES)), F.upper(F.regexp_extract(sql, fn, 1))) - 1
    inner = F.regexp_extract(sql, fn, 2)
    listed = F.trim(F.regexp_extract(sql, r"(?is)^\s*SELECT\s+(?:DISTINCT\s+)?(.+?)\s+FROM\b", 1))
    where = F.regexp_extract(F.regexp_replace(sql, r"\(\s*(?i:SELECT)[^()]*\)", "?"), r"(?is)\bWHERE\b\s*(.*?)\s*(?:\bORDER\b|\bGROUP\b|\bHAVING\b|\bLIMIT\b|;|$)", 1)
    cond = r"""(?i)([\w`."]+(?:\s*\([^)]*\))?)\s*(>=|<=|!=|<>|=|>|<|\bLIKE\b)\s*('(?:[^']|'')*'|"[^"]*"|[^\s'"]+)"""
    def build(x: Column) -> Column:
        name = F.regexp_replace(F.regexp_replace(x["c"], '[`"]', ""), r"^\w+\.", "")
        plain_like = (F.upper(x["o"]) == "LIKE") & ~x["v"].rlike("[%_]")
        op = F.when(plain_like, 0).otherwise(operator_index(x["o"]))
        return F.struct(resolve_column(name, headers, names=names).alias("col"), op.alias("op"), value(x["v"]).alias("val"))

    def read(r: Column) -> Column:
        agg, inner, listed, where = (r[c] for c in ("agg", "inner", "listed", "where"))
        star = (agg > 0) & (inner == "*")
        sel = F.when(star, F.lit(-999)).when(agg > 0, resolve_column(inner, headers, names=names)).when(listed == "*", F.lit(0)).otherwise(resolve_column(listed, headers, names=names))
        found = F.zip_with(F.regexp_extract_all(where, F.lit(cond), F.lit(1)), F.arrays_zip(F.regexp_extract_all(where, F.lit(cond), F.lit(2)).alias("o"), F.regexp_extract_all(where, F.lit(cond), F.lit(3)).alias("v")), lambda c, ov: F.struct(c.alias("c"), ov["o"].alias("o"), ov["v"].alias("v")))
        conds = F.filter(F.transform(found, build), lambda c: c["col"].isNotNull())
        return once(sel, lambda s: F.when(s.isNotNull(), F.struct(F.greatest(agg, F.lit(0)).cast("int").alias("agg"), s.cast("int").alias("sel"), conds.alias("conds"), star.alias("count_star"))))

    return once(F.struct(agg.alias("agg"), inner.alias("inner"), listed.alias("listed"), where.alias("where")), read)


def failure_category(gold_ok: Column, pred_ok: Column, agg: Column, sel: Column, cond: Column) -> Column:
    parts = F.concat_ws("+", F.when(~agg, "agg"), F.when(~sel, "sel"), F.when(~cond, "cond"))
    return F.when(~gold_ok, "gold_parse").when(~pred_ok, "parse").when(parts == "", "ok").otherwise(parts)


def condition_failure(pred: Column, gold: Column, headers: Column, match=values_match) -> Column:
    """Why conditions did not match: a reason for each gold condition, joined by `` | ``."""

    def reason(g: Column) -> Column:
        name = F.coalesce(F.get(headers, g["col"]), F.concat(F.lit("col"), g["col"].cast("string")))
        col_val = F.exists(pred, lambda p: (p["col"] == g["col"]) & match(p["val"], g["val"]))
        any_val = F.exists(pred, lambda p: match(p["val"], g["val"]))
        col_only = F.exists(pred, lambda p: p["col"] == g["col"])
        kind = F.when(col_val, "op_mismatch").when(col_only, "wrong_val").when(any_val, "wrong_col").otherwise("no_match")
        return F.concat(kind, F.lit("("), name, F.lit(")"))

    gone = F.size(gold) - F.size(pred)
    missing = F.concat(F.lit("missing_cond("), gone.cast("string"), F.lit(" of "), F.size(gold).cast("string"), F.lit(" absent)"))
    return F.when(gone > 0, missing).otherwise(F.when(F.size(gold) == 0, "unknown").otherwise(F.array_join(F.transform(gold, reason), " | ")))


def accuracy(rows: DataFrame) -> DataFrame:
    """One row of totals from (gold_ok, pred_ok, agg_ok, sel_ok, cond_ok, em): components over what parsed, em over all."""
    parsed = F.col("gold_ok") & F.col("pred_ok")

    def hits(c: str) -> Column:
        return F.sum(F.when(parsed & F.col(c), 1).otherwise(0))

    n, ok = F.count(F.lit(1)), F.sum(F.when(parsed, 1).otherwise(0))
    share = [F.round(F.when(ok > 0, hits(c) / ok).otherwise(0.0), 6).alias(f"{c[:-3]}_accuracy") for c in ("agg_ok", "sel_ok", "cond_ok")]
    return rows.agg(n.alias("total"), (n - ok).alias("parse_failures"), F.round(F.when(n > 0, ok / n).otherwise(0.0), 6).alias("parse_rate"), *share, F.round(F.when(n > 0, hits("em") / n).otherwise(0.0), 6).alias("em"))


def failure_report(rows: DataFrame, category: str = "category", ok: str = "ok") -> DataFrame:
    """Per category: count, share of all in percent, and share of failures."""
    per = rows.groupBy(F.col(category).alias("category")).agg(F.count(F.lit(1)).alias("count"))
    every = Window.partitionBy()
    failed = F.sum(F.when(F.col("category") != ok, F.col("count")).otherwise(0)).over(every)
    return per.select("category", "count", F.round(100 * F.col("count") / F.sum("count").over(every), 4).alias("pct_total"), F.when(F.col("category") != ok, F.round(100 * F.col("count") / failed, 4)).alias("pct_failures"))


def examples(rows: DataFrame, category: str, order: str, most: int = 15) -> DataFrame:
    """The first ``most`` rows of each category: a report, cut by design."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(category).orderBy(order))).filter(F.col("rank") <= most)


def dominant_failure(report: DataFrame, ok: str = "ok") -> DataFrame:
    """The most frequent failure category, first by name among equals."""
    return report.filter(F.col("category") != ok).groupBy().agg(F.min_by("category", F.struct(-F.col("count"), F.col("category"))).alias("category"), F.max("count").alias("count"))


def readable(conds: Column, headers: Column) -> Column:
    """Conditions as text: header, operator and value of each, joined by AND."""
    operators = F.array(*map(F.lit, ("=", ">", "<", "OP")))

    def show(c: Column) -> Column:
        name = F.coalesce(F.get(headers, c["col"]), F.concat(F.lit("col"), c["col"].cast("string")))
        return F.concat_ws(" ", name, F.element_at(operators, c["op"] + 1), F.coalesce(c["val"]["num"].cast("string"), c["val"]["str"]))

    return F.array_join(F.transform(conds, show), " AND ")


def accuracy_by(rows: DataFrame, key: str) -> DataFrame:
    """accuracy() for each value of a column."""
    parsed = F.col("gold_ok") & F.col("pred_ok")
    n, ok = F.count(F.lit(1)), F.sum(F.when(parsed, 1).otherwise(0))
    hits = lambda c: F.sum(F.when(parsed & F.col(c), 1).otherwise(0))
    return rows.groupBy(key).agg(n.alias("total"), (n - ok).alias("parse_failures"), F.round(hits("em") / n, 6).alias("em"))


#: Operators of conditions by their number in a structure; a structure does not say what its last one was.
OPERATORS = ("=", ">", "<")
#: Queries and conditions that are sent to every task, in place of moving the cells to them; with more, a column's cells are dealt over so many tasks.
SENT, DEALT = 20_000, 32


def _beside_cells(few: DataFrame, cells: DataFrame, on: list[str], sent: bool) -> DataFrame:
    """``few`` (conditions, queries) joined with cells, which are never sent to every task, however small their file."""
    if sent:
        return F.broadcast(few).join(cells, on)
    few = few.withColumn("__deal", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    cells = cells.withColumn("__deal", F.pmod(F.xxhash64("row_id"), F.lit(DEALT)).cast("int"))
    return few.join(cells.hint("merge"), [*on, "__deal"]).drop("__deal")


def single_rows(queries: DataFrame, cells: DataFrame) -> DataFrame:
    """(query_id, row_id) of the rows that each single-table query keeps.

    queries: query_id, db_id, conds; cells: db_id, row_id, col, value. A condition's op is one of
    = > < >= <= != <> LIKE and NOT LIKE, or a number of OPERATORS; a row has to meet all. Values that
    read as numbers compare as numbers, others as text, and any text is greater than any
    number; patterns ignore case. A cell without a value meets no condition, nor does any cell one with another operator.

    A condition that several queries share is looked up once; one for equality by a hash join on
    what cells hold, others along their column. Few conditions are sent to the cells, many meet
    them in a column dealt over tasks.
    """
    conds = queries.select("query_id", "db_id", F.explode(F.array_distinct("conds")).alias("c"), F.size(F.array_distinct("conds")).alias("differ"))
    kinds = conds.schema["c"].dataType
    op = F.lower(F.trim(F.col("c.op"))) if kinds["op"].dataType.typeName() == "string" else F.get(F.array(*map(F.lit, OPERATORS)), F.col("c.op"))
    pattern = F.col("c.text") if "text" in kinds.names else F.coalesce("c.val.str", F.col("c.val.num").cast("string"))
    wanted = conds.select("query_id", "db_id", "differ", F.col("c.col").alias("col"), op.alias("op"), F.col("c.val").alias("val"), pattern.alias("pattern"), mark(F.col("c.val")).alias("mark"))
    wanted = staged(wanted, "conditions")
    sent = wanted.count() <= SENT
    tested = wanted.select("db_id", "col").distinct()
    ready = cells.join(F.broadcast(tested) if sent else tested.hint("merge"), ["db_id", "col"], "left_semi")
    ready = ready.withColumn("have", value(F.col("value"))).select("db_id", "row_id", "col", "value", "have", mark(F.col("have")).alias("mark"))
    ready = staged(ready, "cells")  # values are read once
    what = ["db_id", "col", "op", "mark", "pattern"]
    each = wanted.groupBy(*what).agg(F.first("val").alias("val"))
    equal = _beside_cells(each.filter("op = '='"), ready.select("db_id", "row_id", "col", "mark"), ["db_id", "col", "mark"], sent).select(*what, "row_id")
    place = lambda v: F.struct(v["num"].isNull().alias("text"), v["num"].alias("num"), v["str"].alias("str"))
    have, want, like = place(F.col("have")), place(F.col("val")), F.expr("value ILIKE pattern")
    same = F.col("seen") == F.col("mark")
    holds = F.when(F.col("op") == ">", (have > want) & ~same).when(F.col("op") == "<", (have < want) & ~same).when(F.col("op") == ">=", (have > want) | same).when(F.col("op") == "<=", (have < want) | same)
    holds = holds.when(F.col("op").isin("!=", "<>"), ~same).when(F.col("op") == "like", like).when(F.col("op") == "not like", ~like)
    along = _beside_cells(each.filter("op <> '='"), ready.filter("value IS NOT NULL").withColumnRenamed("mark", "seen"), ["db_id", "col"], sent).filter(holds).select(*what, "row_id")
    asked, found = wanted.select("query_id", "differ", *what), equal.unionByName(along)
    met = F.broadcast(asked).join(found, what) if sent else asked.join(found.hint("merge"), what)
    kept = met.groupBy("query_id", "row_id", "differ").agg(F.count(F.lit(1)).alias("n")).filter("n = differ").select("query_id", "row_id")
    free = queries.filter(F.size("conds") == 0).select("query_id", "db_id").join(cells.select("db_id", "row_id").distinct().hint("merge"), "db_id").select("query_id", "row_id")
    return kept.unionByName(free)


def run_single(queries: DataFrame, cells: DataFrame) -> DataFrame:
    """Execute all single-table queries in one job.

    queries: query_id, db_id, agg, sel, conds; cells: db_id, row_id, col, value. Returns for every query
    query_id, n_rows and, by aggregate number, the result (rounded; 0 for a count of nothing,
    null for another aggregate of nothing) or, without one, the sorted array of values. Rows are
    kept as single_rows() says, once for all queries with the same conditions. Values are collected for
    queries without aggregate alone, whose result they are, each once with its count; repeats are written out at the end.
    """
    first = F.min("query_id").over(Window.partitionBy("db_id", "conds"))
    asked = staged(queries.select("query_id", "db_id", "conds", "agg", F.greatest("sel", F.lit(0)).alias("col"), first.alias("first")), "asked")
    few = F.broadcast if asked.count() <= SENT else lambda df: df.hint("merge")
    kept = single_rows(asked.filter("query_id = first").select("query_id", "db_id", "conds"), cells).withColumnRenamed("query_id", "first")
    kept = kept.join(few(asked.groupBy("first", "db_id", "col").agg(F.max(F.col("agg") == 0).alias("listed"))), "first")
    shown = cells.select("db_id", "row_id", "col", "value").join(few(asked.select("db_id", "col").distinct()), ["db_id", "col"], "left_semi")
    rows = staged(kept.join(shown.hint("merge"), ["db_id", "row_id", "col"]).select("first", "col", "listed", "value"), "kept-values")
    n, of = F.col("value").try_cast("double"), ["first", "col"]
    found = rows.groupBy(*of).agg(F.count(F.lit(1)).alias("n"), F.max(n).alias("x1"), F.min(n).alias("x2"), F.sum(n).alias("x4"), F.avg(n).alias("x5"))
    lists = rows.filter("listed AND value IS NOT NULL").groupBy(*of, "value").agg(F.count(F.lit(1)).cast("int").alias("times"))
    lists = lists.groupBy(*of).agg(F.array_sort(F.collect_list(F.struct("value", "times"))).alias("x0"))
    out = asked.join(found.hint("merge"), of, "left").join(lists.hint("merge"), of, "left").withColumn("n_rows", F.coalesce("n", F.lit(0)).cast("long"))
    pick = F.when(F.col("agg") == 3, F.col("n_rows").cast("double")).when(F.col("agg") == 1, F.col("x1")).when(F.col("agg") == 2, F.col("x2")).when(F.col("agg") == 4, F.col("x4")).when(F.col("agg") == 5, F.col("x5"))
    repeated = F.flatten(F.transform("x0", lambda x: F.array_repeat(x["value"], x["times"])))
    values = F.when(F.col("agg") == 0, F.coalesce(repeated, F.array().cast("array<string>")))
    return out.select("query_id", "n_rows", F.round(pick, 6).alias("result"), values.alias("values"))


def mark(v: Column) -> Column:
    """What values that are equal have in common: the number to nine places, or the text."""
    return F.coalesce(F.concat(F.lit("n"), F.round(v["num"], 9).cast("string")), F.concat(F.lit("s"), v["str"]))
