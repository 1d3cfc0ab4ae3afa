"""An index of paragraphs that follows a stream of files.

Each micro-batch writes its files' pieces under its own number, so a batch that runs
twice writes the same folder again. Of a path the pieces of the latest batch are live.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.operators import chunks


def follow(files: DataFrame, target: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keeps target up to date with a stream of files (path, text); once: with what is there now, then it ends."""

    def write(batch: DataFrame, number: int) -> None:
        pieces = chunks.pack(chunks.paragraphs(batch, "path"), "path")
        pieces.write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = files.select("path", "text").writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def live(spark: SparkSession, target: str) -> DataFrame:
    """(path, chunk, content, n_bytes) of the latest batch of each path."""
    rows = spark.read.parquet(target)
    last = rows.groupBy("path").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["path", "batch"], "left_semi").drop("batch")
