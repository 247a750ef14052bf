"""Readers and writers of question/SQL corpora, schemas, predictions and results."""

from __future__ import annotations

import json
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sqltext
from . import commits

EXAMPLES = "db_id string, question string, query string, sql string, query_toks array<string>, query_toks_no_value array<string>, question_toks array<string>"
SINGLE = "question_id long, db_id string, question string, sql string, query string, table_id string, table struct<header:array<string>,rows:array<array<string>>,name:string,types:array<string>>"
CATALOG = "db_id string, table_names array<string>, table_names_original array<string>, column_names array<array<string>>, column_names_original array<array<string>>, column_types array<string>, primary_keys array<int>, foreign_keys array<array<int>>"
TABLE_RECORD = "id string, name string, header array<string>, types array<string>, rows array<array<string>>"
SPLITS = ("train", "dev", "test")
CORRUPT = "__unreadable"
#: Aggregates and operators of structured single-table gold, by number.
AGGREGATES, OPERATORS = ("", "MAX", "MIN", "COUNT", "SUM", "AVG"), ("=", ">", "<", "OP")


def read_json(spark: SparkSession, path: str, schema: str | None = None, lines: bool | None = None) -> DataFrame:
    """A JSON array, or JSON lines (by default for .jsonl); an empty table when there is nothing that can be read.

    A file that is no JSON counts as nothing to read, as a missing one does. A bad line among
    JSON lines is refused: no row is dropped in silence.
    """
    lines = path.endswith(".jsonl") if lines is None else lines
    none = spark.createDataFrame([], schema or "value string")
    reader = spark.read.option("multiLine", not lines).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    try:
        rows = (reader.schema(f"{schema}, {CORRUPT} string") if schema else reader).json(path)
    except Exception as e:  # AnalysisException of a missing path; anything else is a fault
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return none
    if CORRUPT not in rows.columns:
        return rows
    if rows.columns == [CORRUPT] or rows.filter(F.col(CORRUPT).isNotNull()).limit(1).collect():
        if lines:
            raise ValueError(f"{path} has lines that are no JSON records")
        return none
    return rows.drop(CORRUPT)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_text(df: DataFrame, path: str, column: str = "value") -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def table_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of single tables, from a JSON array or JSON lines: id, header, rows, types, name."""
    return read_json(spark, path, TABLE_RECORD)


def load_split(spark: SparkSession, folder: str, split: str, schema: str = EXAMPLES) -> DataFrame:
    """A corpus split, with example_id in file order; unknown splits are refused, missing files are empty."""
    if split not in SPLITS:
        raise ValueError(f"unknown split {split!r}; there are {', '.join(SPLITS)}")
    rows = read_json(spark, f"{folder}/{split}.json", schema)
    return numbered(rows, "example_id").withColumn("split", F.lit(split))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Row numbers from 0 in file order, by partition offsets and not by one sorted task."""
    rows = df.withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftright("__at", 33)
    sizes = rows.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    first = sizes.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__first"))
    out = rows.withColumn("__p", part).join(first, "__p")
    return out.withColumn(name, F.col("__first") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at", "__p", "__first")


def split_statistics(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("size"), F.countDistinct("db_id").alias("databases"))


def catalog_rows(tables: DataFrame) -> DataFrame:
    """Catalog entries as rows: db_id, table_idx, table, col_idx, column, type, is_pk; the ``*`` entry left out."""
    e = tables.select("db_id", "table_names_original", "column_types", "primary_keys", F.posexplode("column_names_original").alias("col_idx", "c"))
    idx = F.col("c")[0].cast("int")
    e = e.withColumn("table_idx", idx).filter("table_idx >= 0")
    kind = F.lower(F.coalesce(F.get("column_types", F.col("col_idx")), F.lit("text")))
    return e.select("db_id", "table_idx", F.lower(F.get("table_names_original", F.col("table_idx"))).alias("table"), "col_idx", F.lower(F.col("c")[1]).alias("column"), kind.alias("type"), F.coalesce(F.array_contains("primary_keys", F.col("col_idx")), F.lit(False)).alias("is_pk"))


def foreign_keys(tables: DataFrame) -> DataFrame:
    """db_id, from_table, from_column, to_table, to_column."""
    cols = catalog_rows(tables).select("db_id", "col_idx", "table", "column")
    keys = tables.select("db_id", F.explode("foreign_keys").alias("k")).select("db_id", F.col("k")[0].alias("a"), F.col("k")[1].alias("b"))
    a, b = cols.toDF("db_id", "a", "from_table", "from_column"), cols.toDF("db_id", "b", "to_table", "to_column")
    return keys.join(a, ["db_id", "a"]).join(b, ["db_id", "b"]).select("db_id", "from_table", "from_column", "to_table", "to_column")


def catalog_json(catalog: DataFrame) -> DataFrame:
    """(db_id, catalog): JSON {table: [columns]}, as the parser takes it."""
    per = catalog.groupBy("db_id", "table").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "column"))), lambda x: x["column"]).alias("cols"))
    return per.groupBy("db_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("table", "cols"))))).alias("catalog"))


def canonical_keys(tables: DataFrame) -> DataFrame:
    """(db_id, col_idx, canonical): each foreign-key column and the smallest of its set.

    Sets are made in one pass over the pairs; a later pair that joins two sets does not merge them.
    """
    import pandas as pd

    def one(f: pd.DataFrame) -> pd.DataFrame:
        out = []
        for db, pairs in zip(f["db_id"], f["foreign_keys"]):
            sets: list[set] = []
            for a, b in [] if pairs is None else pairs:
                found = next((s for s in sets if a in s or b in s), None)
                if found is None:
                    sets.append({a, b})
                else:
                    found |= {a, b}
            out += [(db, c, min(s)) for s in sets for c in sorted(s)]
        return pd.DataFrame(out, columns=["db_id", "col_idx", "canonical"])

    return tables.select("db_id", "foreign_keys").mapInPandas(lambda fs: map(one, fs), "db_id string, col_idx int, canonical int")


def single_examples(questions: DataFrame, tables: DataFrame, most_rows: int = 5) -> DataFrame:
    """Questions with their tables; of repeated table ids the first stays, and a few rows as a sample."""
    first = F.row_number().over(Window.partitionBy("id").orderBy(F.monotonically_increasing_id()))
    once = tables.withColumn("__n", first).filter("__n = 1").drop("__n")
    t = once.select(F.col("id").alias("table_id"), F.struct("header", F.slice("rows", 1, most_rows).alias("rows"), F.coalesce("name", F.col("id").cast("string")).alias("name"), "types").alias("table"))
    return questions.join(t, "table_id", "left").withColumn("db_id", F.col("table_id"))


def render_gold(agg: Column, sel: Column, conds: Column, table: str = "table") -> Column:
    """SELECT AGG(colN) FROM table WHERE colI op v AND ... from structured gold.

    conds: array of struct(col, op, val, is_text); values that are text are quoted, others not.
    """
    name = F.concat(F.lit("col"), sel.cast("string"))
    fn = F.element_at(F.array(*map(F.lit, AGGREGATES)), agg + 1)
    head = F.concat(F.lit("SELECT "), F.when(fn != "", F.concat(fn, F.lit("("), name, F.lit(")"))).otherwise(name), F.lit(f" FROM {table}"))

    def shown(c: Column) -> Column:
        quoted = F.concat(F.lit("'"), F.replace(c["val"], F.lit("'"), F.lit("''")), F.lit("'"))
        return F.when(c["is_text"], quoted).otherwise(c["val"])

    each = F.transform(conds, lambda c: F.concat(F.lit("col"), c["col"].cast("string"), F.lit(" "), F.element_at(F.array(*map(F.lit, OPERATORS)), c["op"] + 1), F.lit(" "), shown(c)))
    return F.when(F.size(conds) > 0, F.concat(head, F.lit(" WHERE "), F.array_join(each, " AND "))).otherwise(head)


def single_catalog(tables: DataFrame) -> DataFrame:
    """Table records as catalog entries; the first column is the key."""
    return tables.select(F.col("id").alias("db_id"), F.array(F.coalesce("name", F.col("id").cast("string"))).alias("table_names_original"), F.transform("header", lambda c: F.array(F.lit("0"), c)).alias("column_names_original"), F.col("types").alias("column_types"), F.array(F.lit(0)).alias("primary_keys"), F.array().cast("array<array<int>>").alias("foreign_keys"))


def column_kinds(rows: Column, header: Column) -> Column:
    """number or text for each column, by the first row."""
    return F.transform(header, lambda _, i: F.when(F.get(F.get(rows, F.lit(0)), i).try_cast("double").isNotNull(), "number").otherwise("text"))


def cells(tables: DataFrame, key: str = "id") -> DataFrame:
    """All tables' cells as one long table (db_id, row_id, col, value): no database per table."""
    rows = tables.select(F.col(key).alias("db_id"), F.posexplode("rows").alias("row_id", "r"))
    return rows.select("db_id", "row_id", F.posexplode("r").alias("col", "value"))


def sql_type(kind: Column) -> Column:
    return F.when(F.lower(kind).isin("real", "float", "number"), "REAL").otherwise("TEXT")


def export_tsv(df: DataFrame, path: str, *columns: str) -> None:
    """Tab-separated lines of the columns; rows that lack one are left out."""
    write_text(tsv_lines(df, *columns), path)


def export_csv(df: DataFrame, path: str) -> None:
    """Single-table examples with their number of columns."""
    df.select("question_id", "db_id", "question", F.coalesce("query", "sql").alias("sql"), F.size("table.header").alias("num_columns")).write.mode("overwrite").option("header", True).csv(path)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``sql<TAB>db_id``: line, session (counted by blank lines), sql, db_id; empty lines end a session."""
    return sessions(numbered(spark.read.text(path), "line"))


def sessions(lines: DataFrame, order: str = "line") -> DataFrame:
    """Sessions of one file's lines (order, value): the running count of blank lines, summed by blocks of lines."""
    blank = (F.trim("value") == "").cast("int")
    rows = lines.withColumn("__b", F.floor(F.col(order) / 100_000)).withColumn("__blank", blank)
    before = rows.groupBy("__b").agg(F.sum("__blank").alias("__s"))
    before = before.select("__b", F.coalesce(F.sum("__s").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    here = F.sum("__blank").over(Window.partitionBy("__b").orderBy(order))
    out = rows.withColumn("__here", here).join(before, "__b").withColumn("session", F.col("__before") + F.col("__here")).filter("__blank = 0")
    parts = F.split("value", "\t")
    return out.select(order, "session", F.trim(parts[0]).alias("sql"), F.trim(F.get(parts, F.lit(1))).alias("db_id"))


def unfinished(todo: DataFrame, done: DataFrame, key: str = "example_id") -> DataFrame:
    """What a run that is taken up again has left to do."""
    return todo.join(done.select(key), key, "left_anti")


def failed(predictions: DataFrame) -> DataFrame:
    return predictions.filter(sqltext.is_failed(F.col("sql")))


def replace_failed(predictions: DataFrame, again: DataFrame, key: str = "line") -> DataFrame:
    """Predictions with those generated again put in."""
    new = again.select(key, F.col("sql").alias("__sql"))
    return predictions.join(new, key, "left").withColumn("sql", F.coalesce("__sql", "sql")).drop("__sql")


def hash_split(df: DataFrame, key: str, shares: dict[str, float], seed: int = 7) -> DataFrame:
    """Add ``split``: by a digest of ``key`` that any engine can work out, so equal keys stay together and reruns agree."""
    digest = F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, 8)
    u = F.conv(digest, 16, 10).cast("double") / float(2**32)
    total, edge, out = sum(shares.values()), 1.0, None
    for name in reversed(list(shares)):
        out = F.lit(name) if out is None else F.when(u < edge, F.lit(name)).otherwise(out)
        edge -= shares[name] / total
    return df.withColumn("split", out)


def few_shot(df: DataFrame, per: str, k: int, order: str) -> DataFrame:
    """The first k rows of each group, as examples."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(per).orderBy(order))).filter(F.col("__n") <= k).drop("__n")


def database_split(df: DataFrame, shares: dict[str, float], seed: int = 7) -> DataFrame:
    """A database's examples all go to one split."""
    return hash_split(df, "db_id", shares, seed)


def difficulty_split(df: DataFrame, shares: dict[str, float], key: str = "example_id", level: str = "hardness", seed: int = 7) -> DataFrame:
    """Every difficulty is split by the same shares: dealt by a hash of key and level."""
    return hash_split(df.withColumn("__level", F.concat_ws("/", level, F.col(key).cast("string"))), "__level", shares, seed).drop("__level")


def cross_domain_split(df: DataFrame, test: list[str]) -> DataFrame:
    """The named databases are the test split; the others train."""
    return df.withColumn("split", F.when(F.col("db_id").isin(test), "test").otherwise("train"))


def samples(df: DataFrame, n: int, order: str = "example_id") -> DataFrame:
    """The first n examples: a look at a split."""
    return df.orderBy(order).limit(n)


def databases(df: DataFrame) -> DataFrame:
    return df.select("db_id").distinct()


def database_schema(tables: DataFrame, db_id: str) -> DataFrame:
    return catalog_rows(tables.filter(F.col("db_id") == db_id))


def verified_counts(examples: DataFrame, expected: DataFrame) -> DataFrame:
    """(split, expected, found, ok) of the expected sizes of splits."""
    found = examples.groupBy("split").agg(F.count(F.lit(1)).alias("found"))
    out = expected.join(found, "split", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return out.select("split", "expected", "found", (F.col("expected") == F.col("found")).alias("ok"))


def headers_for(rows: DataFrame, key: str, *sources: DataFrame) -> DataFrame:
    """Add headers: of the first of the sources (key, headers) that has any."""
    out = rows
    for k, s in enumerate(sources):
        out = out.join(s.select(key, F.col("headers").alias(f"__h{k}")), key, "left")
    some = [F.when(F.size(f"__h{k}") > 0, F.col(f"__h{k}")) for k in range(len(sources))]
    return out.withColumn("headers", F.coalesce(*some)).drop(*[f"__h{k}" for k in range(len(sources))])


def catalog_headers(tables: DataFrame) -> DataFrame:
    """(db_id, headers) of catalog entries: the first table's columns in order."""
    rows = catalog_rows(tables).filter("table_idx = 0")
    return rows.groupBy("db_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "column"))), lambda x: x["column"]).alias("headers"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(line, sql) of lines ``sql<TAB>db_id``: a blank line is an empty prediction and keeps its number."""
    return predictions(numbered(spark.read.text(path), "line"))


def predictions(lines: DataFrame) -> DataFrame:
    return lines.select("line", F.trim(F.split(F.trim("value"), "\t")[0]).alias("sql"))


def first_pair(gold: DataFrame, pred: DataFrame, headers: DataFrame) -> DataFrame:
    """One row that shows what is compared: the first line's database, headers (eight at most), gold and prediction."""
    g = gold.orderBy("line").limit(1)
    shown = g.join(headers, "db_id", "left").join(pred.withColumnRenamed("sql", "pred_sql"), "line", "left")
    return shown.select("db_id", F.slice("headers", 1, 8).alias("headers"), F.substring("sql", 1, 100).alias("gold_sql"), F.substring("pred_sql", 1, 100).alias("pred_sql"))


def prefilled(sql: Column) -> Column:
    """What a truncated prediction is continued from: its text and FROM; complete ones stay."""
    return F.when(sqltext.is_complete(sql), sql).otherwise(F.concat(F.rtrim(sql), F.lit(" FROM ")))


def tsv_lines(df: DataFrame, *columns: str) -> DataFrame:
    """(value): tab-separated lines of the columns; rows that lack one are left out."""
    for c in columns:
        df = df.filter(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""))
    return df.select("*", F.concat_ws("\t", *[F.regexp_replace(F.col(c).cast("string"), r"[\t\r\n]+", " ") for c in columns]).alias("value"))


def convert_split(spark: SparkSession, folder: str, split: str, out: str) -> dict[str, int]:
    """A split as three files of lines: sql and database, question and database, all three; lines in each."""
    rows = load_split(spark, folder, split).withColumn("sql", F.coalesce("query", "sql"))
    kinds = {"sql": ("sql", "db_id"), "questions": ("question", "db_id"), "full": ("question", "sql", "db_id")}
    sizes = {}
    for name, columns in kinds.items():
        lines = tsv_lines(rows, *columns)
        write_text(lines, f"{out}/{split}_{name}")
        sizes[name] = lines.count()
    return sizes


def inferred_schema(queries: DataFrame) -> DataFrame:
    """Per db_id: names of tables and columns that its statements use."""
    t = queries.select("db_id", F.explode(sqltext.tables_in(F.col("query"))).alias("name"), F.lit("table").alias("kind"))
    c = queries.select("db_id", F.explode(sqltext.columns_in(F.col("query"))).alias("name"), F.lit("column").alias("kind"))
    return t.union(c).groupBy("db_id").agg(F.array_sort(F.collect_set(F.when(F.col("kind") == "table", F.col("name")))).alias("tables"), F.array_sort(F.collect_set(F.when(F.col("kind") == "column", F.col("name")))).alias("columns"))


# ---- vector collections ------------------------------------------------------------------


def collection_path(path: str, name: str, dataset: str | None = None) -> str:
    """Where a collection lies; a dataset's collections bear its name."""
    return f"{path}/collection={dataset + '_' if dataset else ''}{name}"


def _collection(rows_of: DataFrame | None, spark: SparkSession, path: str, name: str, dataset: str | None) -> commits.CommitLog:
    """A collection's log; its columns are those of ``rows_of``, or those that were written."""
    where = collection_path(path, name, dataset)
    log = commits.CommitLog(spark, where, {})
    folders = log.snapshot()["tables"].get("rows", []) if rows_of is None else []
    known = rows_of if rows_of is not None else spark.read.parquet(f"{where}/{folders[-1]}") if folders else None
    if known is not None:
        log.tables["rows"] = ", ".join(f"`{n}` {t}" for n, t in known.dtypes)
    return log


def write_collection(rows: DataFrame, path: str, name: str, reset: bool = True, dataset: str | None = None) -> int:
    """A collection of (id, document, embedding, metadata columns): written anew, or rows put in by id. The number of the commit.

    Of rows with one id any one is kept; a row whose id is there already replaces the old one.
    Writers at the same time lose nothing, and readers see whole writes.
    """
    new = rows.dropDuplicates(["id"])

    def change(read) -> dict:
        if reset:
            return {"rows": (commits.REPLACE, new)}
        old = read("rows").join(new.select("id"), "id", "left_anti").select(*new.columns)
        return {"rows": (commits.REPLACE, old.unionByName(new))}

    return _collection(rows, rows.sparkSession, path, name, dataset).update(change)


def read_collections(spark: SparkSession, path: str) -> DataFrame:
    """All collections under a path as one table, with the name in column ``collection``; columns that one lacks are null."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    names = sorted(n.split("=", 1)[1] for n in (s.getPath().getName() for s in found) if n.startswith("collection="))
    tables = [_collection(None, spark, path, n, None).read("rows").withColumn("collection", F.lit(n)) for n in names]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def read_collection(spark: SparkSession, path: str, name: str, dataset: str | None = None) -> DataFrame | None:
    """One collection; none where it is missing or empty."""
    log = _collection(None, spark, path, name, dataset)
    if not log.tables:
        return None
    rows = log.read("rows")
    return None if rows.isEmpty() else rows


def delete_collection(spark: SparkSession, path: str, name: str, dataset: str | None = None) -> bool:
    """Whether there was one to delete."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(collection_path(path, name, dataset))
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def first_readable(*loaders) -> DataFrame | None:
    """The first table that a loader gives with a row in it: the corpus on disk, a converted one, a sample."""
    for load in loaders:
        try:
            rows = load()
        except Exception as e:  # a loader without its files
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        if rows is not None and not rows.isEmpty():
            return rows
    return None


def index_rows(examples: DataFrame, kind: str, document: Column, embedding: Column) -> DataFrame:
    """Records for a collection: ids ``split_number``, the text and its vector, and metadata."""
    return examples.select(F.concat_ws("_", "split", F.col("example_id").cast("string")).alias("id"), document.alias("document"), embedding.alias("embedding"), "db_id", "question", "query", "split", F.lit(kind).alias("type"))


def resolved(examples: DataFrame, sql: str = "query") -> DataFrame:
    """Without statements that still have a bare ``col``."""
    return examples.filter(~F.col(sql).rlike(r"\bcol\b"))


# ---- small driver-side files -------------------------------------------------------------


def load_config(path: str) -> dict:
    """YAML or JSON by suffix; others are refused."""
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(text) or {}
    if path.endswith(".json"):
        return json.loads(text)
    raise ValueError(f"neither YAML nor JSON: {path}")


def introspect(spark: SparkSession, tables: list[str]) -> DataFrame:
    """Catalog rows of temporary views or tables, lower-cased."""
    rows = [(t.lower(), i, f.name.lower(), f.dataType.simpleString(), f.nullable) for t in tables for i, f in enumerate(spark.table(t).schema.fields)]
    return spark.createDataFrame(rows, "table string, col_idx int, column string, type string, nullable boolean")



def sample_rows(spark: SparkSession, table: str, n: int = 3) -> DataFrame:
    """The first rows of a table as JSON: a look at it, for a prompt."""
    return spark.table(table).limit(n).select(F.to_json(F.struct("*")).alias("row"))
