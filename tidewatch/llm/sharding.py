"""Sharding by extendible hashing, with DataFrame operations only.

A directory of ``depth`` bits maps a hash's first bits to a bucket; a bucket with more bytes than the limit
splits on its next bit, others stay.  So a row's bucket is the shortest prefix of its hash whose rows fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Bits of the hash, bits that one pass looks at, and the byte limit of a shard.
BITS, STEP, LIMIT = 60, 10, 16 << 20


def hash_bits(key: Column) -> Column:
    """60 bits of the MD5 of the key as text; a null key hashes as empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def directory(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(depth, prefix, bytes, rows) of every bucket for rows of (h, size).

    Each pass sums what is still too large at STEP further bits and looks at all depths between, so only the
    rows of oversized buckets are summed again.  Rows whose whole hash is equal cannot be parted: their
    bucket stays at BITS bits, whatever its size.
    """
    done = None
    left = rows.select("h", "size")
    known = 0
    while True:
        deep = min(BITS, known + STEP)
        # all depths of this pass at once: a cell counts towards each of its prefixes
        first = 0 if known == 0 else known + 1
        cells = stored(left.groupBy(F.shiftrightunsigned("h", BITS - deep).alias("cell")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")), "cells")
        depth = F.explode(F.sequence(F.lit(first), F.lit(deep))).alias("depth")
        sums = cells.select("*", depth).withColumn("prefix", F.expr(f"shiftrightunsigned(cell, {deep} - depth)")).groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
        fits = F.col("bytes") <= limit if deep < BITS else (F.col("bytes") <= limit) | (F.col("depth") == BITS)
        fitting = sums.filter(fits)
        # of nested prefixes that fit the shortest is the bucket: its parent doesn't fit
        parent = sums.filter(F.col("bytes") > limit).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("_parent"))
        if first:
            top = fitting.filter(F.col("depth") == first)  # the parents were too large in the pass before
        else:
            top = fitting.filter(F.col("depth") == 0)
        below = fitting.withColumn("_parent", F.shiftrightunsigned("prefix", 1)).join(parent, ["depth", "_parent"], "left_semi").drop("_parent")
        found = top.unionByName(below.filter(F.col("depth") > first)).select(F.col("depth").cast("int").alias("depth"), "prefix", "bytes", "rows")
        done = found if done is None else done.unionByName(found)
        over = sums.filter((F.col("depth") == deep) & (F.col("bytes") > limit)).select(F.col("prefix").alias("_prefix"))
        if deep == BITS or over.limit(1).count() == 0:
            return stored(done, "directory")
        over = stored(over, "over")
        left = left.join(over, F.shiftrightunsigned("h", BITS - deep) == F.col("_prefix"), "left_semi")
        known = deep


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """(h, key, n_bytes, page, page_bytes) of rows (h, key, n_bytes) whose whole hash they share with too many others.

    A row above half of the limit has a page by itself.  The others, laid end to end in the order of n_bytes and
    key, are cut each half limit: a page begins with at most the rest of a row below half, so it is below the
    limit.  Rows that are equal in all that counts may change places; only where they lie in the table numbers
    them, a slice of the table at a time, so that no key comes to one task.
    """
    half = limit / 2
    marked = stored(rows.withColumn("slice", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "crowded")
    kinds = marked.groupBy("h", "key", "n_bytes", "slice").agg(F.count(F.lit(1)).alias("many"))
    kinds = kinds.withColumn("many_before", F.coalesce(F.sum("many").over(Window.partitionBy("h", "key", "n_bytes").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sizes = kinds.groupBy("h", "key", "n_bytes").agg(F.sum("many").alias("all"))
    earlier = Window.partitionBy("h", F.col("n_bytes") > half).orderBy("n_bytes", "key").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("rows_before", F.coalesce(F.sum("all").over(earlier), F.lit(0))).withColumn("bytes_before", F.coalesce(F.sum(F.col("all") * F.col("n_bytes")).over(earlier), F.lit(0)))
    small = sizes.filter(F.col("n_bytes") <= half).groupBy("h").agg(F.sum(F.col("all") * F.col("n_bytes")).alias("small_bytes"))
    named = lambda df, *more: df.select(F.col("h").alias("_h"), F.col("key").alias("_key"), F.col("n_bytes").alias("_n"), *more)
    match = (F.col("h") == F.col("_h")) & F.col("key").eqNullSafe(F.col("_key")) & (F.col("n_bytes") == F.col("_n"))
    about = kinds.select("h", "key", "n_bytes", "slice", "many_before").join(named(sizes, "rows_before", "bytes_before"), match).drop("_h", "_key", "_n").join(small, "h", "left")
    own = F.row_number().over(Window.partitionBy("h", "key", "n_bytes", "slice").orderBy("at")) - 1
    about = named(about, F.col("slice").alias("_slice"), "many_before", "rows_before", "bytes_before", "small_bytes")
    placed = marked.withColumn("own", own).join(about, match & (F.col("slice") == F.col("_slice"))).withColumn("place", F.col("own") + F.col("many_before"))
    first_big = F.when(F.col("small_bytes").isNull(), F.lit(0)).otherwise(F.floor(F.greatest(F.lit(0), F.col("small_bytes") - 1) / half) + 1)
    page = F.when(F.col("n_bytes") > half, first_big + F.col("rows_before") + F.col("place")).otherwise(F.floor((F.col("bytes_before") + F.col("place") * F.col("n_bytes")) / half))
    out = stored(placed.withColumn("page", page.cast("int")).select("h", "key", "n_bytes", "page"), "paged")
    filled = out.groupBy("h", "page").agg(F.sum("n_bytes").alias("page_bytes"))
    return out.join(filled, ["h", "page"])


def sharded(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(key, n_bytes, depth, prefix, shard, shard_bytes, page, page_bytes) of every row.

    ``shard`` is the prefix as a string of bits and shard_bytes what its bucket holds.  Rows of equal hash, that
    is of repeated (or null) keys, cannot be parted by bits: where they exceed the limit together they
    overflow into pages, none of which exceeds it; page_bytes is what the row's own page holds.  A single row
    above the limit is a page by itself.  Elsewhere page is 0 and page_bytes the bucket's.  Null text has no
    bytes.  An empty table has no shard.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long").alias("n_bytes"))
    rows = rows.withColumn("h", hash_bits(F.col("key")))
    found = directory(rows.select("h", F.col("n_bytes").alias("size")), limit)
    depths = [r["depth"] for r in found.select("depth").distinct().collect()]  # BITS + 1 at most
    # rows look their prefix up at each depth that some bucket has; a prefix of a row is a bucket exactly once
    options = rows.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in sorted(depths)]) if depths else F.array().cast("array<int>")))
    options = options.withColumn("prefix", F.expr(f"shiftrightunsigned(h, {BITS} - depth)"))
    joined = options.join(found.select("depth", "prefix", F.col("bytes").alias("shard_bytes"), F.col("rows").alias("shard_rows")), ["depth", "prefix"])
    crowded = (F.col("depth") == BITS) & (F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1)
    out = joined.filter(~crowded).withColumn("page", F.lit(0)).withColumn("page_bytes", F.col("shard_bytes"))
    names = ["key", "n_bytes", "h", "depth", "prefix", "shard_bytes", "page", "page_bytes"]
    out = out.select(*names)
    if BITS in depths and found.filter((F.col("depth") == BITS) & (F.col("bytes") > limit) & (F.col("rows") > 1)).limit(1).count():
        paged = _pages(joined.filter(crowded).select("h", "key", "n_bytes"), limit)
        whole = found.filter(F.col("depth") == BITS).select(F.col("prefix").alias("h"), F.col("bytes").alias("shard_bytes"))
        out = out.unionByName(paged.join(whole, "h").withColumn("depth", F.lit(BITS)).withColumn("prefix", F.col("h")).select(*names))
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    return out.select(F.col("key").alias(key), "n_bytes", "depth", "prefix", bits.alias("shard"), "shard_bytes", "page", "page_bytes")
