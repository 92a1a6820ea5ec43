"""Written intermediate tables: they cut lineage, survive lost executors and are deleted when nothing reads them."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whether a query's shuffle files go when it has ended; a written table doesn't need them again.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A key with more than one in so many rows is dealt out to SALTS places; there are fewer such keys than this.
HOT, SALTS = 500, 16


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="tidewatch-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; on a local master alone another will do."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        return f"file://{_local_folder()}"
    if ":" not in found:  # a bare path lies in the default file system
        store = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").rstrip("/")
        found = ("file://" if store == "file:" else store) + found
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path, compression="zstd")
    finally:
        spark.conf.unset(_CLEANUP) if was is None else spark.conf.set(_CLEANUP, was)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.folder)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """The keys, fewer than ``HOT``, that more than one in ``HOT`` rows have; ``rows`` is a written table."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") * HOT > rows.count()).select(key)


def salted(rows: DataFrame, hot: DataFrame, key: str, place: Column) -> DataFrame:
    """``rows`` with ``_salt``, by which rows of a hot key are dealt out after the hash of ``place``; others have 0."""
    found = rows.join(F.broadcast(hot.select(F.col(key).alias("_hot"))), F.col(key) == F.col("_hot"), "left")
    return found.withColumn("_salt", F.when(F.col("_hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(place), F.lit(SALTS))).cast("int")).drop("_hot")


def at_each_salt(facts: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """``facts``, one row a key, with ``_salt``: a hot key's at every place that ``salted`` may give its rows."""
    found = facts.join(F.broadcast(hot.select(F.col(key).alias("_hot"))), F.col(key) == F.col("_hot"), "left")
    places = F.when(F.col("_hot").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return found.withColumn("_salt", F.explode(places)).drop("_hot")
