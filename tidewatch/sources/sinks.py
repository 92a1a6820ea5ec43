"""Sinks: atomic Parquet writes, upserts by key, replaced partitions, guarded uploads and dead letters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import forget, stored

#: What an upload may be called and weigh, and first bytes of archives.
SUFFIXES, MOST_BYTES = (".log", ".txt", ".csv", ".tsv", ".jsonl"), 200 << 20
ARCHIVES = ("504B0304", "1F8B", "425A68", "FD377A58", "377ABCAF", "52617221", "28B52FFD")


def append(df: DataFrame, path: str, *by: str) -> None:
    (df.write.partitionBy(*by) if by else df.write).mode("append").parquet(path)


def replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Delete and insert: the partitions that ``df`` has are replaced, others stay."""
    df.write.partitionBy(*by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` in place of those of ``old`` with the same keys; of several new ones the last by content."""
    rows = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in old.columns if c not in keys]
    w = Window.partitionBy(*keys).orderBy(F.desc("_v"), *[F.desc(c) for c in rest])
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_v", "_r")


def merge_in_place(new: DataFrame, path: str, keys: list[str], *by: str) -> None:
    """Upsert into the partitioned table at ``path`` by copy on write: only partitions that ``new`` has rows of are rewritten.

    The merged partitions are written to the shared folder first, then replace the old ones, so that nothing reads
    what it overwrites and a run that broke off can be run again.  A key lies in one partition; a table that isn't
    there yet begins empty.  ``new`` may have fewer columns, not others.
    """
    spark = new.sparkSession
    new = stored(new, "merge")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place):
        old = spark.read.parquet(path)
        touched = old.join(new.select(*by).distinct(), list(by), "left_semi").select(*old.columns)
        merged = stored(upserted(touched, new, keys), "merged")
        replace_partitions(merged, path, *by)
        forget(merged)
    else:
        replace_partitions(upserted(new.limit(0), new, keys), path, *by)
    forget(new)


def once_a_batch(path: str):
    """For ``foreachBatch``: each batch's rows in a folder of its number, which a batch that is sent again overwrites."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def checked_uploads(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256, refused) of files: by name, size, archive magic, tar or NUL bytes."""
    files = spark.read.format("binaryFile").load(path)
    # a bound on the length reaches the reader: what is too large is never loaded
    small = files.filter(F.col("length") <= MOST_BYTES)
    head = F.hex(F.substring("content", 1, 6))
    archive = F.lit(False)
    for magic in ARCHIVES:
        archive = archive | head.startswith(magic)
    tar = F.hex(F.substring("content", 258, 5)) == "7573746172"
    name_ok = F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in SUFFIXES) + ")$")
    reason = F.when(~name_ok, "suffix").when(archive | tar, "archive").when(F.hex(F.substring("content", 1, 65536)).rlike("^(..)*00"), "binary")
    checked = small.select("path", "length", F.sha2("content", 256).alias("sha256"), reason.alias("refused"))
    large = files.select("path", "length").filter(F.col("length") > MOST_BYTES)
    return checked.unionByName(large.select("path", "length", F.lit(None).cast("string").alias("sha256"), F.when(~name_ok, "suffix").otherwise("too large").alias("refused")))


def dead_letters(df: DataFrame, path: str, stage: str) -> None:
    df.withColumn("stage", F.lit(stage)).write.mode("append").json(path)


def sorted_text(df: DataFrame, order: list[str], column: str, path: str, files: int | None = None) -> None:
    """Text in order: files in the order of their names, each sorted, as many as the range sort makes, or one if asked for."""
    rows = df.orderBy(*order).select(column)
    (rows.coalesce(1) if files == 1 else rows).write.mode("overwrite").text(path)
