"""Joins in time that split one key: as-of joins, the K rows before, greedy claims of intervals, dense numbers.

A key's rows are cut into buckets of time.  What a row needs from its own bucket a window over (key, bucket) finds;
what it needs from before is carried by a small table with one row a bucket.  So a key with a third of all rows is as many
groups as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import forget, stored

DAY_US = 86_400_000_000


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str], strict: bool = False, tolerance: int | None = None, bucket: int = DAY_US) -> DataFrame:
    """``left`` with the ``values`` of the last row of ``right`` of its key at or before its time (before it, if ``strict``).

    Of right rows at one time the largest by ``values`` counts.  Without such a row, with one further back than
    ``tolerance``, or with a null key or time, the values are null.  No left row is lost or repeated.
    """
    place = F.floor(F.col(time) / bucket).alias("_bucket")
    found = F.struct(F.col(time).alias("_at"), *[F.col(v) for v in values])
    r = right.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).groupBy(F.col(key), F.col(time)).agg(F.max(F.struct(*values)).alias("_v")).select(key, time, *[F.col(f"_v.{v}").alias(v) for v in values])
    r = r.select(F.col(key), F.col(time), place, found.alias("_right"))
    names = [c for c in left.columns if c not in (key, time)]
    rows = left.select(F.col(key), F.col(time), place, F.lit(None).cast(r.schema["_right"].dataType).alias("_right"), F.struct(F.lit(1).alias("_"), *[F.col(c) for c in names]).alias("_left"))
    both = rows.unionByName(r.withColumn("_left", F.lit(None).cast(rows.schema["_left"].dataType)))
    # at one time right rows come first, or last if they must be earlier
    order = [F.col(time), F.col("_left").isNotNull() if not strict else F.col("_left").isNull()]
    here = F.last("_right", ignorenulls=True).over(Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    seen = both.withColumn("_here", here).filter(F.col("_left").isNotNull())
    ends = both.groupBy(key, "_bucket").agg(F.max("_right").alias("_end"))  # a bucket's last row is its largest
    before = F.last("_end", ignorenulls=True).over(Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    carry = ends.select(F.col(key).alias("_k"), F.col("_bucket").alias("_b"), before.alias("_carry")).filter(F.col("_carry").isNotNull())
    out = seen.join(carry, (F.col(key) == F.col("_k")) & (F.col("_bucket") == F.col("_b")), "left")
    known = F.when(F.col(key).isNotNull() & F.col(time).isNotNull(), F.coalesce("_here", "_carry"))
    if tolerance is not None:
        known = F.when(F.col(time) - known["_at"] <= tolerance, known)
    out = out.withColumn("_known", known)
    restored = {c: F.col(f"_left.{c}") for c in names}
    return out.select(*[restored.get(c, F.col(c)).alias(c) for c in left.columns], *[F.col(f"_known.{v}").alias(v) for v in values])


def k_preceding(rows: DataFrame, key: str, order: list[str], values: list[str], k: int, bucket: int = DAY_US) -> DataFrame:
    """``rows`` with ``preceding``, the ``values`` of the K rows of its key before it, oldest first; fewer at the start.

    ``order`` begins with a time in whole numbers and must tell a key's rows apart.  Rows with a null key have none before them.
    """
    rows = rows.withColumn("_bucket", F.floor(F.col(order[0]) / bucket))
    w = Window.partitionBy(key, "_bucket").orderBy(*order)
    item = F.struct(*values)
    here = rows.withColumn("_here", F.collect_list(item).over(w.rowsBetween(-k, -1)))
    last = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(*[F.desc(o) for o in order]))
    tails = rows.withColumn("_r", last).filter(F.col("_r") <= k).groupBy(key, "_bucket").agg(F.sort_array(F.collect_list(F.struct(-F.col("_r"), item.alias("v")))).alias("_t"))
    # every bucket in the table has a row, so the K buckets before hold K rows if there are so many
    past = F.flatten(F.collect_list(F.transform("_t", lambda x: x["v"])).over(Window.partitionBy(key).orderBy("_bucket").rowsBetween(-k, -1)))
    carry = tails.select(F.col(key).alias("_k"), F.col("_bucket").alias("_b"), past.alias("_past")).filter(F.size("_past") > 0)
    out = here.join(carry, (F.col(key) == F.col("_k")) & (F.col("_bucket") == F.col("_b")), "left")
    all_ = F.concat(F.coalesce("_past", F.expr("filter(_here, x -> false)")), F.col("_here"))
    kept = F.slice(all_, F.greatest(F.size(all_) - k, F.lit(0)) + 1, F.lit(k))
    nobody = F.expr("filter(_here, x -> false)")
    return out.withColumn("preceding", F.when(F.col(key).isNull(), nobody).otherwise(kept)).drop("_bucket", "_here", "_k", "_b", "_past")


def numbered(rows: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """``rows`` with dense numbers from 1 in ``order``: sorted by range, each range counts, a small table adds the ranges before."""
    sorted_ = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    counts = sorted_.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))  # a row a range
    starts = counts.select("_range", "_first", (F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).alias("_before"))
    out = sorted_.join(F.broadcast(starts), "_range")
    return out.withColumn(name, F.col("_at") - F.col("_first") + F.coalesce("_before", F.lit(0)) + 1).drop("_range", "_at", "_first", "_before")


def _first_after(rows: DataFrame, bucket: int) -> DataFrame:
    """(_key, _id, _next): the row with the smallest (start, end, id) that starts after this one's end."""
    left = rows.select("_key", F.col("_id").alias("_from"), (-F.col("_end")).alias("_t"))
    right = rows.select("_key", (-F.col("_start")).alias("_t"), (-F.col("_end")).alias("_e"), (-F.col("_id")).alias("_n"))
    found = asof_join(left, right, "_key", "_t", ["_e", "_n"], strict=True, bucket=bucket)
    return found.select("_key", F.col("_from").alias("_id"), (-F.col("_n")).alias("_next"))


def claimed(rows: DataFrame, key: str, start: str, end: str, bucket: int = DAY_US) -> DataFrame:
    """``rows`` with ``claimed``: going through a key's intervals by start, then end, each that meets none taken before.

    Intervals meet if they share a moment, ends included.  The next one to be taken is the first that starts after this
    one's end, so the taken ones are a chain; pointers along it are doubled, so that a chain of n takes log n rounds,
    however many rows one key has.  Rows with a null key or bound are never taken.  Whole rows must differ.
    """
    kept = stored(numbered(rows, [key, start, end], "_id"), "intervals")
    good = kept.filter(F.col(key).isNotNull() & F.col(start).isNotNull() & F.col(end).isNotNull()).select(F.col(key).alias("_key"), "_id", F.col(start).alias("_start"), F.col(end).alias("_end"))
    jump = stored(_first_after(good, bucket), "jumps")
    taken = stored(good.groupBy("_key").agg(F.min("_id").alias("_id")).select("_id"), "taken")
    while True:  # after round k, what is reached in under 2^k steps is taken and the pointers go 2^k steps
        reached = taken.join(jump, "_id").select(F.col("_next").alias("_id")).filter("_id is not null")
        more = stored(taken.unionByName(reached).distinct(), "taken")
        far = jump.select(F.col("_id").alias("_next"), F.col("_next").alias("_far"))
        longer = stored(jump.join(far, "_next").select("_key", "_id", F.col("_far").alias("_next")).filter("_next is not null"), "jumps")
        forget(taken, jump)
        taken, jump = more, longer
        if not jump.limit(1).count():
            forget(jump)
            break
    marks = taken.withColumn("claimed", F.lit(True))
    return kept.join(marks, "_id", "left").withColumn("claimed", F.coalesce("claimed", F.lit(False))).drop("_id")


def _meets(rows: DataFrame, claims: DataFrame, key: str, start: str, end: str, bucket: int) -> DataFrame:
    """``rows`` with ``_met``: whether one of the claims of its key shares a moment with it; claims of a key never overlap."""
    # claims don't overlap, so of those that start by this one's end the last one ends last
    right = claims.select(F.col(key), F.col(start).alias("_t"), F.col(end).alias("_claim_end"))
    found = asof_join(rows.withColumn("_t", F.col(end)), right, key, "_t", ["_claim_end"], bucket=bucket)
    return found.withColumn("_met", F.coalesce(F.col("_claim_end") >= F.col(start), F.lit(False))).drop("_t", "_claim_end")


def finalized(drafts: DataFrame, extractors: list[str], existing: DataFrame | None = None, bucket: int = DAY_US) -> DataFrame:
    """Drafts (extractor, entity_type, entity_value, start_us, end_us, eligible, score) with their evidence_id and nomination.

    Numbers go by extractor in the given order, unknown ones last by name, then entity, start and end.  In that order an
    eligible draft is nominated unless its entity's time is claimed already, by ``existing`` windows (entity_type,
    entity_value, start_us, end_us; they don't overlap within an entity) or an earlier nomination; only a nominated draft keeps its score.  Extractors
    are few and gone through one after the other; within one, ``claimed`` does the work.
    """
    entity = F.to_json(F.struct("entity_type", "entity_value"))
    place = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in extractors]), F.col("extractor")), F.lit(0))
    rows = stored(numbered(drafts.withColumn("_rank", F.when(place > 0, place).otherwise(len(extractors) + 1)), ["_rank", "extractor", "entity_type", "entity_value", "start_us", "end_us"], "_number").withColumn("_entity", entity), "drafts")
    claims = existing.select(entity.alias("_entity"), "start_us", "end_us") if existing is not None else rows.limit(0).select("_entity", "start_us", "end_us")
    known = [r["extractor"] for r in rows.filter("eligible").select("_rank", "extractor").distinct().orderBy("_rank", "extractor").collect()]  # one for each extractor
    taken = rows.limit(0).select("_number")
    for name in known:
        own = rows.filter((F.col("extractor") == name) & F.col("eligible")).select("_number", "_entity", "start_us", "end_us")
        free = _meets(own, claims, "_entity", "start_us", "end_us", bucket).filter(~F.col("_met")).drop("_met")
        new = stored(claimed(free, "_entity", "start_us", "end_us", bucket).filter("claimed").select("_number", "_entity", "start_us", "end_us"), "claims")
        claims, taken = claims.unionByName(new.drop("_number")), taken.unionByName(new.select("_number"))
    out = rows.join(taken.withColumn("nominated", F.lit(True)), "_number", "left").withColumn("nominated", F.coalesce("nominated", F.lit(False)))
    out = out.withColumn("evidence_id", F.concat(F.lit("EVIDENCE-"), F.col("_number"))).withColumn("score", F.when(F.col("nominated"), F.col("score")))
    return out.drop("_rank", "_number", "_entity")
