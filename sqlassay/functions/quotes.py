"""Steps on SQL text that must scan quotes from left to right (Arrow UDFs)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from . import sqltext, statements

#: What may follow a closing quote.
_FOLLOWS = re.compile(r"\s*(?:$|and|or|not|from|where|order|group|having|limit|union|intersect|except|join|on|[);,])", re.I)


def repair(sql: str) -> str:
    """Doubles a lone apostrophe inside a literal: one closes only before a structural word, ``) ; ,`` or the end."""
    out, inside, at = [], False, 0
    for m in re.finditer(r"''|'", sql):
        if m.start() < at:
            continue
        out.append(sql[at : m.start()])
        at = m.end()
        if m.group() == "''":
            out.append("''")
        elif not inside or _FOLLOWS.match(sql, at):
            out.append("'")
            inside = not inside
        else:
            out.append("''")
    return "".join(out) + sql[at:]


_LITERAL = re.compile(r"""'(?:[^']|'')*'?|"[^"]*"?""")


def lower_literals(sql: str) -> str:
    """Lower-cases what is in quotes; a double quote inside single quotes is data."""
    return _LITERAL.sub(lambda m: m.group().lower(), sql)


def drop_stray_quotes(sql: str) -> str:
    """Backslashed apostrophes become doubled ones; double quotes inside single quotes go."""
    return re.sub(r"'(?:[^']|'')*'?", lambda m: m.group().replace('"', ""), sql.replace("\\'", "''"))


def _udf(f):
    ship(SparkSession.active())

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return run


def repair_apostrophes(col: Column) -> Column:
    return _udf(repair)(col)


def lower_string_literals(col: Column) -> Column:
    return _udf(lower_literals)(col)


def repair_prediction(col: Column) -> Column:
    return statements.null_form(_udf(drop_stray_quotes)(col))


def canonical(col: Column) -> Column:
    """The canonical form of a SQL statement, all steps."""
    body = _udf(lambda s: lower_literals(repair(s)))(sqltext.before_literals(col))
    return F.when(sqltext.is_placeholder(col), F.lit(sqltext.PLACEHOLDER.lower())).otherwise(sqltext.after_literals(body))
