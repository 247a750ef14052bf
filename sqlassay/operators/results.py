"""Equality of result sets, for many queries at once.

Results are long tables (query_id, side, row_id, cells): side 1 is the prediction, -1 the
label, cells an array of normalised strings. No result is collected: every test is a sum of
+1 and -1 over equal keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import cell, once
from ..staging import staged


def result_rows(df: DataFrame, query_id: str, side: int, row_id: str, columns: list[str]) -> DataFrame:
    cells = F.array(*[cell(F.col(c).cast("string")) for c in columns])
    return df.select(F.col(query_id).alias("query_id"), F.lit(side).alias("side"), F.col(row_id).alias("row_id"), cells.alias("cells"))


def multisets_equal(rows: DataFrame, key: str = "cells") -> DataFrame:
    """(query_id, equal): whether both sides have the same rows as often."""
    per = rows.groupBy("query_id", key).agg(F.sum("side").alias("__d"))
    return per.groupBy("query_id").agg((F.max(F.abs("__d")) == 0).alias("equal"))


def shapes(rows: DataFrame) -> DataFrame:
    """Per query: rows and columns of each side, and whether rows agree as bags of cells (as sets of them, for quick rejection)."""
    sides = {1: "pred", -1: "gold"}
    counts = [F.sum(F.when(F.col("side") == s, 1).otherwise(0)).alias(f"{n}_rows") for s, n in sides.items()]
    widths = [F.max(F.when(F.col("side") == s, F.size("cells"))).alias(f"{n}_cols") for s, n in sides.items()]
    bags = rows.groupBy("query_id", F.array_sort("cells").alias("bag")).agg(F.collect_set("side").alias("__sides"))
    quick = bags.groupBy("query_id").agg(F.min(F.size("__sides")).alias("__both")).select("query_id", (F.col("__both") == 2).alias("bags_agree"))
    return rows.groupBy("query_id").agg(*counts, *widths).join(quick, "query_id")


def _sum_of(*cols: str) -> Column:
    """A number for a multiset: hashes of its members, added in halves that no result is large enough to overflow."""
    h = F.xxhash64(*cols)
    return F.xxhash64(F.sum(F.shiftrightunsigned(h, 32)), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))))


def _by_column(value: str, side: int) -> Column:
    """A side's values by column, as an array."""
    return F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("col", value)))), lambda x: x[value])


def _colours(rows: DataFrame) -> DataFrame:
    """Per query the columns of both sides by their values: equal colours (gold, pred) where the values are, equal marks (gold_id, pred_id) where they are row by row."""
    # rows that share a row_id are told apart by what they hold
    cells = rows.select("query_id", "side", "place", "row_id", F.xxhash64(_packed(F.col("cells"))).alias("row"), F.posexplode("cells").alias("col", "v"))
    each = cells.groupBy("query_id", "side", "col").agg(_sum_of("place", "v").alias("colour"), _sum_of("row_id", "row", "v").alias("mark"))
    lists = [_by_column(v, s).alias(n) for v, s, n in (("colour", -1, "gold"), ("colour", 1, "pred"), ("mark", -1, "gold_id"), ("mark", 1, "pred_id"))]
    return each.groupBy("query_id").agg(*lists)


def _refined(rows: DataFrame, states: DataFrame) -> DataFrame:
    """The states with each column's colour told apart further, by the rows that its values stand in."""
    own = F.when(F.col("side") == -1, F.col("gold")).otherwise(F.col("pred"))
    seen = rows.join(states.select("query_id", "gold", "pred"), "query_id").select("query_id", "side", "place", "cells", own.alias("colours"))
    row = F.xxhash64("place", F.array_sort(F.zip_with("cells", "colours", lambda v, c: F.xxhash64(v, c))))
    each = seen.select("query_id", "side", row.alias("row"), F.posexplode(F.arrays_zip("cells", "colours")).alias("col", "x"))
    each = each.groupBy("query_id", "side", "col", F.col("x.colours").alias("colour")).agg(_sum_of("row", "x.cells").alias("more"))
    each = each.withColumn("colour", F.xxhash64("colour", "more"))
    lists = each.groupBy("query_id").agg(_by_column("colour", -1).alias("gold"), _by_column("colour", 1).alias("pred"))
    return states.drop("gold", "pred").join(lists, "query_id")


def _open_column() -> Column:
    """Place of the first gold column that is not alone in its colour, columns equal row by row aside; null if there is none."""
    at = F.sequence(F.lit(0), F.size("gold") - 1)
    def unlike(k):
        return F.exists(at, lambda j: (F.get("gold", j) == F.get("gold", k)) & (F.get("gold_id", j) != F.get("gold_id", k)))
    return F.get(F.filter(at, unlike), F.lit(0))


def _same_rows(rows: DataFrame, states: DataFrame) -> DataFrame:
    """query_id of the states whose colours, put in order on both sides, make the rows agree, value by value."""
    own = F.when(F.col("side") == -1, F.col("gold")).otherwise(F.col("pred"))
    put = rows.join(states.select("query_id", "gold", "pred"), "query_id")
    cells = F.transform(F.array_sort(F.arrays_zip(own.alias("colour"), F.sequence(F.lit(0), F.size("cells") - 1).alias("k"), F.col("cells").alias("v"))), lambda x: x["v"])
    per = put.groupBy("query_id", "place", cells.alias("cells")).agg(F.sum("side").alias("d"))
    return per.groupBy("query_id").agg(F.max(F.abs("d")).alias("d")).filter("d = 0").select("query_id")


def placed(rows: DataFrame) -> DataFrame:
    """Rows whose row_id is monotonically_increasing_id(): row_id becomes the place in the whole result, however it was partitioned."""
    part, inside = F.shiftright("row_id", 33), F.col("row_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = rows.groupBy("query_id", "side", part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("query_id", "side").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    counts = counts.select("query_id", "side", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    out = rows.withColumn("part", part).join(counts, ["query_id", "side", "part"])
    return out.withColumn("row_id", F.col("before") + inside).select(*rows.columns)


#: Cells of a result that is compared whole, in a row.
SMALL = 4096
#: Between the cells of a row that travels as one string; what looks like it in a cell is told apart.
_END, _NULL = "\x00\x01", "\x00\x03"


def _packed(cells: Column) -> Column:
    """Cells as one string, others for other cells."""
    return F.array_join(F.transform(cells, lambda c: F.coalesce(F.replace(c, F.lit("\x00"), F.lit("\x00\x02")), F.lit(_NULL))), _END)


def _small_verdicts(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """query_id and equal, null where it stays open: of small results, by their columns in order of what they hold.

    Each query's rows meet once, as strings. Ordered results are equal if their columns, put in
    order, are. Others are put in order by their columns' sorted values; where columns that
    agree in those are the same row by row, or there is one of each, the rows decide. Ordered
    results with rows that share a place go as these, the place being part of every cell.
    """
    each = rows.select("query_id", "side", F.when(F.col("ordered"), F.col("row_id")).alias("place"), _packed(F.col("cells")).alias("row"))
    met = each.groupBy("query_id").agg(F.collect_list(F.struct("side", "place", "row")).alias("rows"))
    tied = F.col("ordered") & (F.size(F.array_distinct(F.transform("rows", lambda r: F.struct(r["side"], r["place"])))) < F.size("rows"))
    def split(side: int) -> Column:
        own = F.array_sort(F.filter("rows", lambda r: r["side"] == side))
        def row(r: Column) -> Column:
            here = F.coalesce(r["place"].cast("string"), F.lit(""))
            return F.when(F.col("tied"), F.transform(F.split(r["row"], _END), lambda v: F.concat(here, F.lit(_END), v))).otherwise(F.split(r["row"], _END))
        table = F.transform(own, row)
        return once(table, lambda t: F.transform(F.sequence(F.lit(0), F.size(F.get(t, F.lit(0))) - 1), lambda k: F.transform(t, lambda r: F.get(r, k))))
    met = met.join(queries.select("query_id", "ordered"), "query_id").withColumn("tied", tied)
    places = lambda side: F.array_sort(F.transform(F.filter("rows", lambda r: r["side"] == side), lambda r: r["place"]))
    columns = met.select("query_id", "ordered", "tied", (places(-1) == places(1)).alias("like"), split(-1).alias("gold"), split(1).alias("pred"))
    def rows_of(cols: Column) -> Column:
        return F.array_sort(F.transform(F.sequence(F.lit(0), F.size(F.get(cols, F.lit(0))) - 1), lambda i: F.transform(cols, lambda c: F.get(c, i))))
    def shaded(cols: str) -> Column:
        return F.array_sort(F.transform(cols, lambda c: F.struct(F.array_sort(c).alias("shade"), c.alias("cells"))))
    def decided(g: Column, p: Column) -> Column:
        shades = lambda x: F.transform(x, lambda c: c["shade"])
        cells = lambda x: F.transform(x, lambda c: c["cells"])
        unlike = F.coalesce(F.exists(F.sequence(F.lit(1), F.size(g)), lambda k: (F.get(g, k)["shade"] == F.get(g, k - 1)["shade"]) & (F.get(g, k)["cells"] != F.get(g, k - 1)["cells"])), F.lit(False))  # beyond the last column there is none
        return F.when(shades(g) != shades(p), False).when(~unlike, rows_of(cells(g)) == rows_of(cells(p)))
    free = once(F.struct(shaded("gold").alias("g"), shaded("pred").alias("p")), lambda x: decided(x["g"], x["p"]))
    same = F.col("like") & (F.array_sort("gold") == F.array_sort("pred"))
    return columns.select("query_id", F.when(F.col("ordered") & ~F.col("tied"), same).otherwise(free).alias("equal"))


def results_equal(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, equal) for each row of queries (query_id, ordered).

    Equal are: both empty; or as many rows and columns, and some order of the prediction's
    columns under which the rows agree, as a multiset or, if ordered, one by one by row_id; of
    rows that share a row_id, each with any.

    No order of columns is tried that the data exclude. Columns get a colour from their values,
    with their places if ordered, and then, round by round, from the rows these stand in; only
    like colours can belong together. Where unlike columns keep the same colour, one of them is
    matched with each candidate in turn, deepest first, and colours are refined again. What
    is matched at the end is compared value by value.

    Small results, of SMALL cells at most on a side, are compared whole, in one shuffle; what
    that leaves open, and large ones, go the way above.
    """
    ordered = queries.select("query_id", F.coalesce("ordered", F.lit(False)).alias("ordered")).distinct()
    counts = [F.count_if(F.col("side") == s).alias(n) for n, s in (("gold", -1), ("pred", 1))]
    spans = [f(F.when(F.col("side") == s, F.size("cells"))).alias(n) for n, f, s in (("least", F.min, -1), ("most", F.max, -1), ("p_least", F.min, 1), ("p_most", F.max, 1))]
    sizes = staged(rows.groupBy("query_id").agg(*counts, *spans).filter("gold > 0 OR pred > 0"), "result-sizes")
    # rows of one width, as many on both sides, and few cells
    like = F.coalesce(F.expr("gold = pred AND least > 0 AND least = most AND least = p_least AND least = p_most"), F.lit(False))
    small = sizes.filter(like & (F.col("gold") * F.col("most") <= SMALL)).select("query_id").join(ordered, "query_id")
    first = staged(_small_verdicts(small, rows.hint("merge").join(small, "query_id")), "small-verdicts")
    left = sizes.select("query_id").join(first.filter("equal IS NOT NULL"), "query_id", "left_anti")
    left = staged(left.join(sizes.filter("gold = pred").select("query_id"), "query_id", "left_semi"), "open-results")
    fits = first.filter("equal").select("query_id")
    if not left.isEmpty():
        later = _by_colours(left.join(ordered, "query_id"), rows.join(left, "query_id", "left_semi"))
        fits = fits.unionByName(later.filter("equal").select("query_id"))
    out = queries.select("query_id").join(fits.distinct().withColumn("__fits", F.lit(True)), "query_id", "left")
    out = out.join(sizes.select("query_id", F.lit(True).alias("__rows")), "query_id", "left")
    return out.select("query_id", F.coalesce("__fits", F.col("__rows").isNull()).alias("equal"))


def _by_colours(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """results_equal() by colours of columns, whatever the size of results."""
    s = shapes(rows)
    same = s.filter("pred_rows = gold_rows AND pred_cols = gold_cols AND bags_agree").select("query_id")
    ordered = queries.select("query_id", F.coalesce("ordered", F.lit(False)).alias("ordered"))
    rows = rows.join(same, "query_id").join(ordered, "query_id")
    rows = staged(rows.select("query_id", "side", "row_id", F.when(F.col("ordered"), F.col("row_id")).alias("place"), "cells"), "results")
    alike = F.array_sort("gold") == F.array_sort("pred")
    states = staged(_colours(rows).withColumns({"depth": F.lit(0), "turn": F.lit(0)}).filter(alike), "colours")
    # where order counts and places are no row's alone, like columns agree place by place and nothing is left to refine
    fits = [staged(_same_rows(rows, states.filter(_open_column().isNull())), "equal")]
    states = states.filter(_open_column().isNotNull())
    while not states.isEmpty():
        top = Window.partitionBy("query_id").orderBy(F.desc("depth"), "turn")
        ranked = states.withColumn("rank", F.row_number().over(top))
        active, waiting = ranked.filter("rank = 1").drop("rank"), ranked.filter("rank > 1").drop("rank")
        done = _colour_classes(rows, staged(active, "active"))
        closed, still = done.filter(_open_column().isNull()), done.filter(_open_column().isNotNull())
        fits.append(staged(_same_rows(rows, closed), "equal"))
        states = staged(waiting.join(fits[-1], "query_id", "left_anti").unionByName(_branches(still)), "states")
    out = queries.select("query_id").join(reduce(DataFrame.unionByName, fits).distinct().withColumn("__fits", F.lit(True)), "query_id", "left")
    out = out.join(s.select("query_id", F.lit(True).alias("__rows")), "query_id", "left")
    return out.select("query_id", F.coalesce("__fits", F.col("__rows").isNull()).alias("equal"))


def _colour_classes(rows: DataFrame, states: DataFrame) -> DataFrame:
    """The states refined until no colour splits any more; those whose colours differ between the sides are dropped."""
    kinds = F.size(F.array_distinct("gold"))
    done, left = [], states
    while True:
        done.append(left.filter(_open_column().isNull()))
        left = left.filter(_open_column().isNotNull())
        if left.isEmpty():
            break
        more = staged(_refined(rows, left.withColumn("kinds", kinds)).filter(F.array_sort("gold") == F.array_sort("pred")), "refined")
        done.append(more.filter(kinds == F.col("kinds")).drop("kinds"))
        left = more.filter(kinds > F.col("kinds")).drop("kinds")
    return reduce(DataFrame.unionByName, done)


def _branches(states: DataFrame) -> DataFrame:
    """For each state, its open gold column matched with every candidate of its colour, one of those that are equal row by row."""
    states = states.withColumn("open", _open_column()).withColumn("shade", F.get("gold", F.col("open")))
    at = F.sequence(F.lit(0), F.size("pred") - 1)
    first = F.filter(at, lambda k: (F.get("pred", k) == F.col("shade")) & ~F.exists(at, lambda j: (j < k) & (F.get("pred", j) == F.col("shade")) & (F.get("pred_id", j) == F.get("pred_id", k))))
    # columns that are equal row by row are matched together
    picked = states.select("*", F.posexplode(first).alias("next", "pick"))
    def paint(side: str, mark: Column) -> Column:
        own = F.transform(F.arrays_zip(side, f"{side}_id"), lambda x: F.when((x[side] == F.col("shade")) & (x[f"{side}_id"] == mark), F.xxhash64(x[side], F.lit("picked"))).otherwise(x[side]))
        return own.alias(side)
    gold, pred = paint("gold", F.get("gold_id", F.col("open"))), paint("pred", F.get("pred_id", F.col("pick")))
    out = picked.select("query_id", gold, pred, "gold_id", "pred_id", (F.col("depth") + 1).alias("depth"), F.col("next").alias("turn"))
    return out.filter(F.array_sort("gold") == F.array_sort("pred"))


def failure_scan(verdicts: DataFrame) -> DataFrame:
    """Rows (query_id, pred_error, equal, ...) that failed, errors before mismatches."""
    kind = F.when(F.col("pred_error").isNotNull(), "error").when(~F.col("equal"), "mismatch").otherwise("ok")
    return verdicts.withColumn("kind", kind).filter("kind <> 'ok'").orderBy(F.when(F.col("kind") == "error", 0).otherwise(1), "query_id")


def regression_scan(before: DataFrame, after: DataFrame, lines: DataFrame) -> DataFrame:
    """Of the listed lines (query_id), those whose results before and after, (query_id, cells), are not the same rows as often."""
    rows = before.select("query_id", F.lit(-1).alias("side"), "cells").unionByName(after.select("query_id", F.lit(1).alias("side"), "cells"))
    found = multisets_equal(rows.join(lines.select("query_id"), "query_id", "left_semi"))
    return lines.select("query_id").join(found.filter("NOT equal"), "query_id", "left_semi")
