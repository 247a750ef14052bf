"""The strict reading of single-table statements, and of their gold in either format.

Strict: a statement is one SELECT of one column or aggregate; conditions with symbols are read
before those with words (LIKE, IN and their negations), and a comparison with a nested query is
left out, however deep its parentheses go.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import singletable
from ..shipping import ship
from .statements import Tokens

SYMBOLS = ("=", "!=", "<>", ">", "<", ">=", "<=")
GOLD = "agg int, sel int, conds array<array<string>>"
_ENDS = ("group", "order", "limit")
_PARTS = "struct<agg:int,sel:string,star:boolean,conds:array<struct<c:string,o:string,v:string>>>"


def _group(t: Tokens, k: int) -> int:
    """The place after the parenthesis that matches the one at k."""
    depth = 0
    while k < len(t):
        depth += (t.text[k] == "(") - (t.text[k] == ")")
        k += 1
        if not depth:
            return k
    return k


def _operator(t: Tokens, k: int) -> tuple[str, int]:
    """The operator at k and how many tokens it has; none is 0."""
    two = t.text[k] + t.text[k + 1] if k + 1 < len(t) and not t.gap[k + 1] else ""
    if two in SYMBOLS:
        return two, 2
    if t.text[k] in SYMBOLS:
        return t.text[k], 1
    if t.word(k) in ("like", "in"):
        return t.word(k), 1
    if t.word(k) == "not" and t.word(k + 1) in ("like", "in"):
        return f"not {t.word(k + 1)}", 2
    return "", 0


def _name(t: Tokens, first: int, last: int) -> str:
    """The words that end at ``last``, back to a connector or anything but a word."""
    k = last
    while k > first and re.fullmatch(r"[\w\]\[\"]+|\"[^\"]*\"", t.text[k - 1]) and t.word(k - 1) not in ("and", "or", "not"):
        k -= 1
    return " ".join(x.strip("`\"[]") for x in t.text[k:last]).strip()


def _value(t: Tokens, k: int) -> tuple[str, int]:
    """The value at k, and the place after it: a literal, a list in parentheses, or whatever stands without a gap."""
    if t.text[k] == "(":
        end = _group(t, k)
        return t.shown(k, end), end
    end = k + 1
    if t.text[k][0] not in "'\"":
        while end < len(t) and not t.gap[end] and t.text[end] not in ",)":
            end += 1
    return t.shown(k, end), end


def conditions(t: Tokens, first: int, last: int) -> list[tuple[str, str, str]]:
    """(name, operator, value) of tokens first..last-1: symbols first, then words."""
    found: tuple[list, list] = [], []
    k = begin = first
    while k < last:
        op, many = _operator(t, k)
        if not many or k + many >= last:
            k += 1
            continue
        name = _name(t, begin, k)
        if t.text[k + many] == "(" and t.word(k + many + 1) == "select" and op in SYMBOLS:
            k = begin = _group(t, k + many)
            continue
        value, k = _value(t, k + many)
        begin = k
        if name:
            found[op not in SYMBOLS].append((name, op, value))
    return found[0] + found[1]


def parts(sql: str | None) -> tuple | None:
    """(agg, selected name, is COUNT(*), conditions) of a statement, or nothing."""
    t = Tokens((sql or "").strip().rstrip(";"))
    if not len(t):
        return None
    at = next((k for k in range(len(t)) if t.word(k) == "select"), None)
    if at is None:
        return None
    # the first aggregate right after a SELECT, wherever that stands, else the first selected item
    agg = next((k + 1 for k in range(at, len(t) - 2) if t.word(k) == "select" and t.text[k + 1].upper() in singletable.AGGREGATES[1:] and t.text[k + 2] == "("), None)
    if agg is not None:
        inside = [x for k, x in enumerate(t.text[agg + 2 : _group(t, agg + 1) - 1]) if k or x.lower() != "distinct"]
        name, number = " ".join(x.strip("`\"[]") for x in inside).strip(), singletable.AGGREGATES.index(t.text[agg].upper())
    else:
        first = at + 1 + (t.word(at + 1) == "distinct")
        end = next((k for k in range(first, len(t)) if t.word(k) == "from"), None)
        if end is None or "," in t.text[first:end]:
            return None
        name, number = t.shown(first, end).strip("`\"[]"), 0
    if not name:
        return None
    where = next((k for k in range(at, len(t)) if t.word(k) == "where"), None)
    stop = next((k for k in range(where or 0, len(t)) if t.word(k) in _ENDS), len(t))
    return number, name, bool(number) and name == "*", conditions(t, where + 1, stop) if where is not None else []


def _read(sql: Column) -> Column:
    @F.pandas_udf(_PARTS)
    def run(s: pd.Series) -> pd.DataFrame:
        rows = [parts(x) or (None, None, None, None) for x in s]
        rows = [(a, n, st, c if c is None else [dict(zip("cov", x)) for x in c]) for a, n, st, c in rows]
        return pd.DataFrame(rows, columns=["agg", "sel", "star", "conds"], dtype=object)

    return run(sql)


def parse_strict(df, sql: str, headers: str, out: str = "strict"):
    """Add struct(agg, sel, conds, count_star), as singletable.parse_single() gives it, or null."""
    ship(df.sparkSession)
    names = F.col(headers)
    rows = df.withColumn("__parts", _read(F.col(sql)))
    p = F.col("__parts")
    plain = F.col("__names")
    rows = rows.withColumn("__names", F.transform(names, singletable.column_name))
    sel = F.when(p["star"], F.lit(-999)).when(p["sel"] == "*", F.when(F.size(names) > 0, F.lit(0))).otherwise(singletable.resolve_column(p["sel"], names, min_tokens=2, names=plain))
    build = lambda x: F.struct(singletable.resolve_column(x["c"], names, min_tokens=2, names=plain).alias("col"), singletable.operator_index(x["o"]).alias("op"), singletable.value(x["v"]).alias("val"))
    conds = F.filter(F.transform(p["conds"], build), lambda c: c["col"].isNotNull())
    whole = lambda s: F.when(p["agg"].isNotNull() & s.isNotNull(), F.struct(p["agg"].cast("int").alias("agg"), s.cast("int").alias("sel"), conds.alias("conds"), p["star"].alias("count_star")))
    return rows.withColumn(out, singletable.once(sel, whole)).drop("__parts", "__names")


def gold_struct(df, gold: str, headers: str, out: str = "gold"):
    """Add the gold struct of column ``gold``: JSON {agg, sel, conds}, or SQL text; null where it is neither.

    Conditions of a structured gold that lack a part are left out.
    """
    rows = parse_strict(df, gold, headers, "__text")
    x = F.from_json(F.col(gold), GOLD)
    whole = F.filter(F.coalesce(x["conds"], F.array().cast("array<array<string>>")), lambda c: F.size(c) >= 3)
    conds = F.transform(whole, lambda c: F.struct(c[0].cast("int").alias("col"), c[1].cast("int").alias("op"), singletable.value(c[2]).alias("val")))
    agg = F.coalesce(x["agg"], F.lit(0))
    made = F.struct(agg.alias("agg"), F.coalesce(x["sel"], F.lit(0)).alias("sel"), conds.alias("conds"), (agg == 3).alias("count_star"))
    return rows.withColumn(out, F.when(F.ltrim(gold).startswith("{"), made).otherwise(F.col("__text"))).drop("__text")


def structural_strict(pred: Column, gold: Column) -> Column:
    """struct(agg_ok, sel_ok, cond_ok, em) without leniency; COUNT(*) ignores the column when both count."""
    agg = pred["agg"] == gold["agg"]
    sel = (pred["sel"] == gold["sel"]) | (pred["count_star"] & (pred["agg"] == 3) & (gold["agg"] == 3))
    cond = singletable.conditions_match(pred["conds"], gold["conds"], singletable.values_match_strict, False)
    return F.struct(agg.alias("agg_ok"), sel.alias("sel_ok"), cond.alias("cond_ok"), (agg & sel & cond).alias("em"))
