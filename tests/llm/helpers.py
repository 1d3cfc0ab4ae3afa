from pyspark.sql import functions as F

EDGE_DOCS = [
    (1, "the cat sat on the mat and looked at the dog", "en", "web", 44),
    (2, None, "en", "web", None),
    (3, "", None, None, 0),
    (None, "a row without an id", "fr", "books", 19),
    (4, "long " * 30_000, "en", "web", 150_000),
    (5, "the cat sat on the mat and looked at the dog", "de", None, 44),
    (5, "the cat sat on the mat and looked at the dog", "de", None, 44),
    (6, "  \n\t ", "en", "web", 5),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edge_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and extra columns that clash with results."""
    df = spark.createDataFrame(EDGE_DOCS, SCHEMA)
    for name in ("size", "kept", "rank", "digest", "content", "label", "key", "shard", "n_replaced", "block", "target"):
        df = df.withColumn(name, F.lit("x"))
    return df


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def table(spark, name, sf="sf0.001"):
    return spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet")
