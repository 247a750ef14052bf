import pytest
from pyspark.sql import functions as F

BIG = 2**63 - 5
LONG = " ".join(f"word{i * 7919 % 5000} naïve {i}." for i in range(9000))


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns that clash with names the operators use."""
    same = "The quick brown fox jumps over the lazy dog while seven grey wolves sleep beside the frozen river bank tonight." * 3
    rows = [
        (1, same, "en", "a"), (2, same, "en", "b"), (2, same, "en", "b"), (3, None, "en", "a"), (4, "", None, "b"), (5, " \t\n", "de", None), (6, LONG, "en", "a"), (7, LONG + " tail", "en", "b"),
        (None, "a row without a name but with quite ordinary words in it", "en", None), (None, None, None, None), (8, "one two three", "fr", "c"), (9, "ONE two THREE", "fr", "c"), (10, "日本語のテキスト、空白なし。" * 30, "de", "é"),
        (11, "....---1234", "en", "a"), (12, "x" * 700, "en", "a"), (13, "ab" * 400, "en", "a"),
        # ids that no double holds, beside nulls; near copies that share an id or have none
        (BIG, "ids near the end of what a long holds must come back as they were", "en", "a"), (BIG - 2, same + " end", "en", "b"), (2, same + " tail", "en", "b"), (None, same + " tail end", "en", "b"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    clash = "row doc at label found lang_pred step name h hash number __words __text_sha __found __text_crc __key __n size rows target shard slot key sid tid family level component keep_id recipe length piece digest score n_shingles set_id"
    for name in clash.split():
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]
