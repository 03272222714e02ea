"""Reading tables and small plan helpers for the queries of this subpackage."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regex for what separates words.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Materialises df in the folder the cluster shares, cutting its lineage.

    spark.checkpoint.dir is read from the session; only where it is unset and the master is local (tests) a temporary
    folder is chosen. On a cluster an unset folder is an error, as executors could not share one of the driver's.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        place = spark.conf.get("spark.checkpoint.dir", None)
        if not place:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
            import tempfile

            place = tempfile.mkdtemp(prefix="quillstack-")
        context.setCheckpointDir(place)
    return df.checkpoint()


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lets Spark send at most `rows` rows at a time to Python workers, where the session has no smaller bound.

    Texts have kilobytes each, and Spark's default of 10,000 rows keeps tens of megabytes of each task in several copies.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def release_shuffles(spark: SparkSession) -> None:
    """Lets the cluster delete shuffle files of finished rounds now.

    Spark deletes them when the driver's JVM collects the plans that wrote them, by default at the latest after half an
    hour; a loop of checkpointed rounds would keep those of all its rounds on the executors' disks until then.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def words(text: Column) -> Column:
    """The words of a text as an array; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def text_bytes(df: DataFrame, text_col: str) -> int:
    """UTF-8 bytes of all texts: one narrow aggregate, used to choose how many buckets to deal to."""
    return df.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("n")).head().n
