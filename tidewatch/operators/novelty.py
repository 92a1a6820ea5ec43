"""Scores of novelty over whole tables: tails, neighbours, densities, robust distances and their confidence, by joins and aggregates.

Rows have a unique whole number ``id``, an array ``f`` of one length and ``fit``: whether they belong to the part that the others are
measured by.  Nothing is sampled, so a score is the same however many rows there are; what reaches the driver is a few numbers for
each coordinate or pair of coordinates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import HOT, forget, stored

#: The later part of the time, which calibrates; neighbours; rows of a block that is compared at once; share and steps of the robust fit; share of variance that axes hold.
HELD, NEIGHBOURS, BLOCK, SUPPORT, STEPS, SHARE = 0.1, 20, 4096, 0.75, 10, 0.95
#: Blocks from which on they grow instead of being more, up to so many rows: each block goes to all others, so fewer exchange less.
BLOCKS, LARGE_BLOCK = 16, 32_768


def parted(rows: DataFrame, ident: str, column: str, order: str, held: float = HELD) -> DataFrame:
    """(id, f, fit) of rows: fitted are those up to the point that leaves the last ``held`` of the time that ``order`` spans."""
    low, high = rows.agg(F.min(order), F.max(order)).first()
    cut = F.lit(low + (high - low) * (1 - held)) if low is not None else F.lit(None)
    return rows.select(F.col(ident).cast("long").alias("id"), F.transform(column, lambda x: x.cast("double")).alias("f"), F.coalesce(F.col(order) <= cut, F.lit(False)).alias("fit"))


def scaled(rows: DataFrame) -> DataFrame:
    """Each coordinate less its mean over its deviation, both of the fitted rows; one that doesn't vary is only centred."""
    found = rows.filter("fit").select(F.posexplode("f").alias("k", "x")).groupBy("k").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("k").collect()  # a row a coordinate
    if not found:
        return rows
    mean, sd = F.array(*[F.lit(r["m"]) for r in found]), F.array(*[F.lit(r["s"] or 1.0) for r in found])
    return rows.withColumn("f", F.transform("f", lambda x, i: (x - F.element_at(mean, i + 1)) / F.element_at(sd, i + 1)))


def with_ranks(rows: DataFrame, group: str, value: str, weight: Column) -> DataFrame:
    """``rows`` with ``le``, ``lt`` and ``total``: the weight in its group of values up to its own, below it, and of all.

    Values are counted first and sorted by ranges; a range's sums and those before it give the counts.  Counts go back to the rows by
    value: those of values that one in ``HOT`` rows or more have are few and broadcast.
    """
    per = rows.groupBy(group, value).agg(F.sum(weight).cast("long").alias("_n"), F.count(F.lit(1)).alias("_rows"))
    cells = stored(per.repartitionByRange(group, value).sortWithinPartitions(group, value).withColumn("_range", F.spark_partition_id()), "ranges")
    ranges = cells.groupBy(group, "_range").agg(F.sum("_n").alias("_m"))  # a row a range and group
    w = Window.partitionBy(group).orderBy("_range")
    ranges = ranges.select(group, "_range", F.coalesce(F.sum("_m").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_m").over(Window.partitionBy(group)).alias("total"))
    run = F.sum("_n").over(Window.partitionBy(group, "_range").orderBy(value))
    counts = cells.withColumn("_run", run).join(F.broadcast(ranges), [group, "_range"]).select(F.col(group).alias("_g"), F.col(value).alias("_v"), (F.col("_before") + F.col("_run")).alias("le"), (F.col("_before") + F.col("_run") - F.col("_n")).alias("lt"), "total", "_rows")
    counts = stored(counts, "ranks")
    n = counts.agg(F.sum("_rows")).first()[0] or 0
    groups = max(1, ranges.select(group).distinct().count())
    hot = counts.filter(F.col("_rows") * HOT * groups > n).drop("_rows")
    on = lambda left, right: (left[group] == right["_g"]) & (left[value] == right["_v"])
    marked = rows.join(F.broadcast(hot), on(rows, hot), "left")
    often = marked.filter(F.col("le").isNotNull()).drop("_g", "_v")
    rest = marked.filter(F.col("le").isNull()).select(*rows.columns)
    seldom = counts.filter(F.col("_rows") * HOT * groups <= n).drop("_rows")
    forget(cells)
    return often.unionByName(rest.join(seldom, on(rest, seldom)).drop("_g", "_v"))


def confident(scores: DataFrame) -> DataFrame:
    """(id, raw, confidence) of (id, raw, fit): the share of the later rows' scores not above one's own; of all, if there are no later rows."""
    alone = not scores.filter("not fit").limit(1).count()
    ranks = with_ranks(scores.withColumn("_one", F.lit(0)), "_one", "raw", F.lit(1) if alone else (~F.col("fit")).cast("int"))
    return ranks.select("id", "raw", (F.col("le") / F.col("total")).alias("confidence"))


# -- tails ---------------------------------------------------------------------------------------------------


def tails(rows: DataFrame) -> DataFrame:
    """(id, fit, raw, parts): the largest of the sums over coordinates of the logarithms of left, right and skewed tails.

    ``parts`` holds each coordinate's rarer tail.
    """
    x = rows.select("id", "fit", F.posexplode("f").alias("k", "x"))
    mean = x.filter("fit").groupBy("k").agg(F.avg("x").alias("_m"))
    skew = x.filter("fit").join(F.broadcast(mean), "k").groupBy("k").agg(F.signum(F.avg(F.pow(F.col("x") - F.col("_m"), 3))).alias("skew"))  # a row a coordinate
    t = with_ranks(x, "k", "x", F.col("fit").cast("int")).join(F.broadcast(skew), "k")
    left, right = -F.log((F.col("le") + 1) / (F.col("total") + 1)), -F.log((F.col("total") - F.col("lt") + 1) / (F.col("total") + 1))
    t = t.select("id", "fit", "k", left.alias("lo"), right.alias("hi"), F.when(F.col("skew") < 0, left).otherwise(right).alias("sk"))
    sums = t.groupBy("id", "fit").agg(F.greatest(F.sum("lo"), F.sum("hi"), F.sum("sk")).alias("raw"), F.array_sort(F.collect_list(F.struct("k", F.greatest("lo", "hi").alias("p")))).alias("_p"))
    return sums.select("id", "fit", "raw", F.transform("_p", lambda p: p["p"]).alias("parts"))


# -- neighbours ----------------------------------------------------------------------------------------------


def _packed(table: pa.Table) -> pa.Table:
    f = np.array(table.column("f").to_pylist(), np.float64)
    return pa.table({"b": table.column("b").slice(0, 1), "ids": pa.array([table.column("id").to_pylist()], pa.list_(pa.int64())), "rows": pa.array([f.tobytes()], pa.binary())})


def _blocks(rows: DataFrame) -> tuple[DataFrame, int]:
    """A written table (b, ids, rows) of blocks of BLOCK to LARGE_BLOCK rows, dealt by a hash, and their number."""
    count = rows.count()
    n = max(min(BLOCKS, -(-count // BLOCK)), -(-count // LARGE_BLOCK))
    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(max(1, n))).cast("int").alias("b"), "id", "f")
    return stored(dealt.groupBy("b").applyInArrow(_packed, "b int, ids array<long>, rows binary"), "blocks"), n


def _near_rows(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Of each row of a block the k nearest of another block; ties go to the smaller id."""
    for batch in batches:
        for ids, raw, others, base in zip(*(batch.column(c).to_pylist() for c in ("ids", "rows", "other_ids", "other_rows")), strict=True):
            x, y, other = np.frombuffer(raw).reshape(len(ids), -1), np.frombuffer(base).reshape(len(others), -1), np.array(others)
            order = np.argsort(other)
            y, other = y[order], other[order]
            norm, most = (y**2).sum(1), min(len(other), k)
            some = min(len(other), most + 8)
            step = max(16, (1 << 20) // max(1, len(y)))  # so that distances at once are as many for any block
            for at in range(0, len(x), step):
                part = x[at : at + step]
                far = (part**2).sum(1)[:, None] + norm - 2 * part @ y.T
                # candidates come from products of matrices; all that could be among the nearest are then measured one by one
                edge = np.partition(far, some - 1, axis=1)[:, some - 1]
                picked = np.sort(np.argpartition(far, some - 1, axis=1)[:, :some], axis=1)
                apart = part[:, None, :] - y[picked]
                near = np.sqrt(np.einsum("ijk,ijk->ij", apart, apart))
                best = np.argsort(near, axis=1, kind="stable")[:, :most]
                d, o = np.take_along_axis(near, best, 1), other[np.take_along_axis(picked, best, 1)]
                for i in np.flatnonzero((d[:, -1] ** 2 >= edge - 1e-6 * (1 + np.abs(edge))) & (some < len(other))):  # too many are about as far
                    exact = np.sqrt(((part[i] - y) ** 2).sum(1))
                    first = np.argsort(exact, kind="stable")[:most]
                    d[i], o[i] = exact[first], other[first]
                pairs = pa.StructArray.from_arrays([pa.array(d.ravel()), pa.array(o.ravel())], names=["d", "other"])
                yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + step], pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * most), pairs)], names=["id", "near"])


def neighbours(rows: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(id, near): the k nearest fitted rows of each row, itself among them if it is fitted, as (d, other), nearest first.

    Rows lie in blocks; each block meets each block of fitted rows in a task of its own, which keeps k for each row, and these are
    merged.  That is all pairs of rows in time, and in what is exchanged each row, with k of its neighbours, as often as there are blocks.
    """
    base, n = _blocks(rows.filter("fit"))
    own, m = _blocks(rows)
    # a pair of blocks is much work for few bytes: each is a partition's worth, and either block goes there once
    places = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(10_000, m * n))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(max(0, k - 1))))
    left = own.select("ids", "rows", "b", every(n).alias("other_b")).repartition(places, "b", "other_b")
    right = base.select(F.col("ids").alias("other_ids"), F.col("rows").alias("other_rows"), F.col("b").alias("other_b"), every(m).alias("b")).repartition(places, "b", "other_b")
    dealt = left.join(right.hint("merge"), ["b", "other_b"]).drop("b", "other_b")
    found = dealt.mapInArrow(lambda b: _near_rows(b, k), "id long, near array<struct<d: double, other: long>>")
    return found.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))


def kth_neighbour(rows: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(id, fit, raw, parts): the distance of the k-th nearest fitted row, and the way to it coordinate by coordinate."""
    near = neighbours(rows, k).select("id", F.element_at("near", -1).alias("n"))
    there = near.select("id", F.col("n.d").alias("raw"), F.col("n.other").alias("_o")).join(rows.select(F.col("id").alias("_o"), F.col("f").alias("_f")), "_o")
    return rows.join(there, "id").select("id", "fit", "raw", F.zip_with("f", "_f", lambda a, b: a - b).alias("parts"))


def local_outlier_factor(rows: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(id, fit, raw, parts): the mean density of the k nearest fitted rows over one's own, and the way from their mean.

    A fitted row's own density is taken without itself, its neighbours' against all rows with itself: the form for new rows.
    """
    n = rows.filter("fit").count()
    k = max(1, min(k, n - 1))
    near = stored(neighbours(rows, k + 1), "neighbours")
    others = rows.filter("fit").select("id").join(near, "id").select("id", F.slice(F.filter("near", lambda x: x["other"] != F.col("id")), 1, k).alias("near"))
    reach = stored(others.select(F.col("id").alias("other"), F.element_at("near", -1)["d"].alias("reach")), "reach")
    # of the other rows' distances none counts for less than their own reach
    smooth = lambda df: df.select("id", F.explode("near").alias("x")).select("id", "x.other", "x.d").join(reach, "other")
    away = F.avg(F.greatest("d", "reach")) + 1e-10
    density = stored(smooth(others).groupBy("id").agg((1 / away).alias("density")).withColumnRenamed("id", "other"), "density")
    first = near.select("id", F.slice("near", 1, k).alias("near"))
    about = smooth(first).join(density, "other").join(rows.select(F.col("id").alias("other"), "f"), "other")
    mean = F.array(*[F.avg(F.col("f")[i]) for i in range(_width(rows))])
    scores = about.groupBy("id").agg((F.avg("density") * away).alias("raw"), mean.alias("_m"))
    return rows.join(scores, "id").select("id", "fit", "raw", F.zip_with("f", "_m", lambda a, b: a - b).alias("parts"))


# -- distances from a robust centre, principal axes ------------------------------------------------------------


def _width(rows: DataFrame) -> int:
    first = rows.select(F.size("f").alias("n")).first()
    return first["n"] if first else 0


def _sum_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, s, q = 0, None, None
    for batch in batches:
        if len(batch):
            x = np.array(batch.column(0).to_pylist(), np.float64)
            n, s, q = n + len(x), x.sum(0) + (0 if s is None else s), x.T @ x + (0 if q is None else q)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([[n], s, q.ravel()])], pa.list_(pa.float64()))], names=["sums"])


def moments(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and covariance of ``f``: sums of each task, added coordinate by coordinate."""
    sums = rows.select("f").mapInArrow(_sum_rows, "sums array<double>").select(F.posexplode("sums").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).orderBy("k").collect()
    d = int(round(((1 + 4 * (len(sums) - 1)) ** 0.5 - 1) / 2)) if sums else 0
    v = np.array([r["x"] for r in sums])
    n, mean = (int(v[0]), v[1 : d + 1] / v[0]) if d else (0, np.zeros(0))
    return n, mean, (v[d + 1 :].reshape(d, d) - n * np.outer(mean, mean)) / max(1, n - 1) if d else np.zeros((0, 0))


def _distance_rows(batches: Iterator[pa.RecordBatch], centre: np.ndarray, precision: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        d = np.array(batch.column("f").to_pylist(), np.float64).reshape(len(batch), -1) - centre
        parts = d * (d @ precision)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("f"), batch.column("fit"), pa.array(np.sqrt(np.maximum(0, parts.sum(1)))), pa.array(list(parts), pa.list_(pa.float64()))], names=["id", "f", "fit", "raw", "parts"])


def robust_distance(rows: DataFrame, support: float = SUPPORT, steps: int = STEPS) -> DataFrame:
    """(id, fit, raw, parts): Mahalanobis distance from the ``support`` share of fitted rows that lie closest to their own centre.

    It begins with the rows closest to the medians and repeats: fit to the closest, take the closest again.  The bound of the closest is
    a quantile with an error of under one in a hundred thousand of the rows.
    """
    fit = rows.filter("fit")
    width = _width(rows)
    if not width:
        return rows.select("id", "fit", F.lit(None).cast("double").alias("raw"), F.col("f").alias("parts"))
    quantile = lambda c, q: F.percentile_approx(c, q, 100_000)
    medians = fit.agg(*[quantile(F.col("f")[i], 0.5).alias(f"m{i}") for i in range(width)]).first()
    spread = F.aggregate(F.transform("f", lambda x, i: F.abs(x - F.element_at(F.array(*[F.lit(m) for m in medians]), i + 1))), F.lit(0.0), lambda a, x: a + x)
    known = fit.withColumn("raw", spread)
    before = None
    for _ in range(steps):
        bound = known.agg(quantile("raw", support)).first()[0]
        n, centre, cov = moments(known.filter(F.col("raw") <= bound))
        precision = np.linalg.inv(cov + 1e-6 * np.eye(width))
        if before is not None and np.allclose(before, centre, rtol=0, atol=1e-12):
            break
        before = centre
        known = _distances(fit, centre, precision)
    return _distances(rows, centre, precision).select("id", "fit", "raw", "parts")


def _distances(rows: DataFrame, centre: np.ndarray, precision: np.ndarray) -> DataFrame:
    return rows.select("id", "f", "fit").mapInArrow(lambda b: _distance_rows(b, centre, precision), "id long, f array<double>, fit boolean, raw double, parts array<double>")


def axes(rows: DataFrame, share: float = SHARE) -> tuple[np.ndarray, np.ndarray]:
    """(mean, axes): the principal axes, most varying first, that together hold ``share`` of the fitted rows' variance."""
    _, mean, cov = moments(rows.filter("fit"))
    value, vector = np.linalg.eigh(cov)
    value, vector = value[::-1], vector[:, ::-1]
    return mean, vector[:, : int(np.searchsorted(np.cumsum(value) / max(1e-12, value.sum()), share) + 1)]


def _projected_rows(batches: Iterator[pa.RecordBatch], mean: np.ndarray, vector: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = (np.array(batch.column("f").to_pylist(), np.float64).reshape(len(batch), -1) - mean) @ vector
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(x), pa.list_(pa.float64())), batch.column("fit")], names=["id", "f", "fit"])


def projected(rows: DataFrame, mean: np.ndarray, vector: np.ndarray) -> DataFrame:
    return rows.select("id", "f", "fit").mapInArrow(lambda b: _projected_rows(b, mean, vector), "id long, f array<double>, fit boolean")


def behind_axes(score) -> object:
    """A neighbour score of the rows on their principal axes, its parts dealt back to the coordinates by the axes' weights."""

    def run(rows: DataFrame) -> DataFrame:
        mean, vector = axes(rows)
        found = score(stored(projected(rows, mean, vector), "projected"))
        weight = F.array(*[F.array(*[F.lit(float(abs(v))) for v in row]) for row in vector])
        return found.withColumn("parts", F.transform(weight, lambda row: F.aggregate(F.zip_with("parts", row, lambda p, v: F.abs(p) * v), F.lit(0.0), lambda a, x: a + x)))

    return run


SCORES = {"kth_nn": kth_neighbour, "lof": local_outlier_factor, "mahalanobis": robust_distance, "ecod": tails, "kth_nn_pca": behind_axes(kth_neighbour), "lof_pca": behind_axes(local_outlier_factor)}


def scored(rows: DataFrame, kind: str, ident: str, column: str, order: str, names: list[str] | None = None, explain: int = 0) -> DataFrame:
    """(id, raw_score, confidence) of all rows by one of ``SCORES``, and with ``explain`` the names of the coordinates that speak most.

    Rows without a finite score count as 0 or as far as can be.  An empty table gives no row.
    """
    x = stored(scaled(parted(rows, ident, column, order)), "scaled")
    if not x.limit(1).count():
        none = x.select("id", F.lit(0.0).alias("raw_score"), F.lit(0.0).alias("confidence"))
        return none.withColumn("contributions", F.array().cast("array<string>")) if explain else none
    raw = F.when(F.isnan("raw"), 0.0).otherwise(F.least(F.greatest(F.col("raw"), F.lit(-1e12)), F.lit(1e12)))
    found = stored(SCORES[kind](x).withColumn("raw", F.coalesce(raw, F.lit(0.0))), "scores")
    out = confident(found.select("id", "raw", "fit")).withColumnRenamed("raw", "raw_score")
    if explain:
        order_ = F.array_sort(F.transform("parts", lambda p, i: F.struct((-F.abs(p)).alias("p"), i.alias("i"))))
        labels = F.array(*[F.lit(n) for n in names or [f"x{i}" for i in range(_width(x))]])
        top = found.select("id", F.transform(F.slice(order_, 1, explain), lambda s: F.element_at(labels, s["i"] + 1)).alias("contributions"))
        out = out.join(top, "id")
    return out
