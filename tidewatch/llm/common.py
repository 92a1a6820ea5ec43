"""Shared plumbing: the shared folder, lineage cuts and ordered buckets."""

from __future__ import annotations

import functools
import math
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and the control characters 9 to 13.  Exactly what bytes.split() uses.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"



def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset a local folder will do on one machine only: on any other master this raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        return f"file://{_local_work()}"
    if ":" not in found:  # a bare path lies in the default file system
        store = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").rstrip("/")
        found = ("file://" if store == "file:" else store) + found
    return found.rstrip("/")


@functools.cache
def _local_work() -> str:
    return tempfile.mkdtemp(prefix="tidewatch-")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Whether a query's shuffle files go when it has ended; a written table doesn't need them again.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
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
    """Delete tables that ``stored`` has written and that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.folder)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """The names, or others like them, that no column of ``frame`` has in any spelling."""
    taken, out = {c.lower() for c in frame.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def tasks(spark: SparkSession) -> int:
    """The number of partitions that a shuffle makes."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package where it lies, whatever folder the driver was started in."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    if root not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [environment.get("PYTHONPATH"), root]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def row_id(*columns: str) -> Column:
    """A 64-bit tie-breaker for rows; with the key it tells rows of one key apart unless they are equal."""
    return F.xxhash64(*columns)


def key_buckets(df: DataFrame, key: str, count: int) -> tuple[Column, int]:
    """A column that cuts the rows into ordered ranges of ``key`` of about equal counts, and the number of ranges.

    Only ``count`` boundaries reach the driver.  Null keys go to range 0 with the smallest ones.
    """
    steps = [i / count for i in range(1, count)]
    if not steps:
        return F.lit(0), 1
    found = df.select(F.percentile_approx(F.col(key), steps, 100 * count).alias("b")).first()["b"]
    bounds = sorted(set(found or []))
    if not bounds:
        return F.lit(0), 1
    # the number of boundaries that are <= key, by arithmetic on constant arrays: first among every step-th
    # boundary, then among those of one step, so that a row looks at about twice the root of their number
    step = math.isqrt(len(bounds) - 1) + 1
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    at_most = lambda edges: F.size(F.filter(edges, lambda e: e <= F.col(key)))
    coarse = at_most(F.array(*[F.lit(p[0]) for p in parts[1:]])) if len(parts) > 1 else F.lit(0)
    fine = F.element_at(F.array(*[F.array(*[F.lit(b) for b in p]) for p in parts]), coarse + 1)
    # a null key compares to nothing: it is in range 0
    return F.coalesce(coarse * step + at_most(fine), F.lit(0)), len(bounds) + 1
