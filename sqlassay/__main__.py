"""Command line: python -m sqlassay <command> ...

grade GOLD PREDICTIONS CATALOG   graded rows and the summary report of two files of lines sql<TAB>database
structural GOLD PREDICTIONS TABLES   the strict structural report of single-table predictions
convert FOLDER SPLIT OUT   a split as three files of lines
index FOLDER SPLIT OUT   the split's questions and statements as vector collections
failed PREDICTIONS OUT   lines to be generated again, with what to continue from
search COLLECTIONS TEXT   what a typed line asks for, answered from the collections
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import strict
from .operators import evaluate, retrieval, singletable
from .session import build_session
from .sources import corpora


def grade(spark: SparkSession, args) -> str:
    graded, scores = evaluate.grade_files(spark, args.gold, args.predictions, args.catalog, args.execute)
    if args.out:
        graded.select("line", "db_id", "raw_gold", "raw_pred", "hardness", "exact_match", "execution_match", "partial").write.mode("overwrite").parquet(args.out)
    return evaluate.summary_text(scores, args.title)


def structural_rows(gold: DataFrame, predictions: DataFrame, headers: DataFrame) -> DataFrame:
    """(line, db_id, sql) and (line, sql) under headers (db_id, headers): the rows that singletable.accuracy() counts."""
    pairs = gold.withColumnRenamed("sql", "gold_text").join(predictions.withColumnRenamed("sql", "pred_sql"), "line", "left").join(headers, "db_id", "left")
    rows = strict.parse_strict(strict.gold_struct(pairs, "gold_text", "headers"), "pred_sql", "headers", "pred")
    s = strict.structural_strict(F.col("pred"), F.col("gold"))
    ok = [F.coalesce(s[c], F.lit(False)).alias(c) for c in ("agg_ok", "sel_ok", "cond_ok", "em")]
    return rows.select("line", F.col("gold").isNotNull().alias("gold_ok"), F.col("pred").isNotNull().alias("pred_ok"), *ok)


def structural(spark: SparkSession, args) -> str:
    gold = corpora.numbered(corpora.read_json(spark, args.gold, "db_id string, question string, sql string"), "line").select("line", "db_id", "sql")
    headers = corpora.table_records(spark, args.tables).select(F.col("id").alias("db_id"), F.col("header").alias("headers"))
    rows = structural_rows(gold, corpora.read_predictions(spark, args.predictions), headers)
    category = singletable.failure_category(*[F.col(c) for c in ("gold_ok", "pred_ok", "agg_ok", "sel_ok", "cond_ok")])
    lines = evaluate.structural_lines(singletable.accuracy(rows), singletable.failure_report(rows.select(category.alias("category"))))
    return "\n".join(r["text"] for r in lines.orderBy("place").collect())


def convert(spark: SparkSession, args) -> str:
    return "\n".join(f"{name}: {n} lines" for name, n in corpora.convert_split(spark, args.folder, args.split, args.out).items())


def index(spark: SparkSession, args) -> str:
    rows = corpora.load_split(spark, args.folder, args.split)
    texts = {"questions": F.concat(F.lit("Database: "), "db_id", F.lit("\nQuestion: "), "question"), "statements": F.col("query")}
    for kind, document in texts.items():
        corpora.write_collection(corpora.index_rows(rows, kind, document, retrieval.hashed_embedding(document)), args.out, kind, dataset=args.dataset)
    return ", ".join(texts)


def failed(spark: SparkSession, args) -> str:
    lines = corpora.failed(corpora.read_predictions(spark, args.predictions)).select("line", corpora.prefilled(F.col("sql")).alias("prefill"))
    corpora.write_json(lines, args.out)
    return f"{lines.count()} lines"


def search(spark: SparkSession, args) -> str:
    asked = spark.createDataFrame([(0, args.text)], "q_id long, typed string").select("q_id", retrieval.command(F.col("typed")).alias("c")).first()["c"]
    if asked["kind"] in ("leave", "help", "empty"):
        return __doc__ if asked["kind"] == "help" else ""
    name = {"sql": "statements"}.get(asked["kind"], "questions")
    rows = corpora.read_collection(spark, args.collections, name, args.dataset)
    if rows is None:
        return f"there is no collection {name}"
    query = spark.createDataFrame([(0, asked["text"])], "q_id long, t string").select("q_id", retrieval.hashed_embedding(F.col("t")).alias("q_vec"))
    pairs = retrieval.scored(query, rows.select("id", F.col("embedding").alias("vec"), "document"))
    return "\n".join(r["line"] for r in retrieval.shown(retrieval.top(pairs, args.most, F.desc("similarity"), F.col("id")), "document").orderBy("rank").collect())


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    parser = argparse.ArgumentParser(prog="sqlassay", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    shapes = {grade: ("gold", "predictions", "catalog"), structural: ("gold", "predictions", "tables"), convert: ("folder", "split", "out"), index: ("folder", "split", "out"), failed: ("predictions", "out"), search: ("collections", "text")}
    for f, names in shapes.items():
        sub = commands.add_parser(f.__name__)
        sub.set_defaults(run=f)
        for n in names:
            sub.add_argument(n)
        if f in (index, search):
            sub.add_argument("--dataset")
        if f is search:
            sub.add_argument("--most", type=int, default=5)
        if f is grade:
            sub.add_argument("--execute", action="store_true")
            sub.add_argument("--out")
            sub.add_argument("--title", default="CORPUS")
    args = parser.parse_args(argv)
    return args.run(spark or build_session(), args)


if __name__ == "__main__":
    print(main())
