"""What the operators share: tables cut from their lineage, and column names that do not clash."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; only where it is unset, one of our own."""
    sc = spark.sparkContext
    if found := sc.getConf().get("spark.checkpoint.dir"):
        return found.rstrip("/")
    if (current := sc._jsc.sc().getCheckpointDir()).isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="codeloom-")
    sc.setCheckpointDir(made)
    return made


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage is cut, and a lost executor costs no recomputation.

    The shuffle files of the write are removed at its end, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/codeloom/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Deletes tables that written() made, once no further plan reads them."""
    for df in frames:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df_or_names, wanted: str) -> str:
    """A column name that no column of the input has, compared without case."""
    taken = {c.lower() for c in (df_or_names.columns if isinstance(df_or_names, DataFrame) else df_or_names)}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted
