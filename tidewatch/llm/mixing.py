"""Mixing sources to target weights by cube-method balanced sampling.

A source's documents are all wanted ``m = target / size`` times: the whole part for sure, the fraction as
an inclusion probability.  The cube method moves the probabilities of three documents at a time along the
direction that keeps both the number of documents and the number of words, until one of them is 0 or 1.
Each block of a source is moved by itself and leaves two documents at most; these go on to further rounds,
until what is left of a source is settled in a landing.  A dozen documents of each source are kept out of
the flight for it: the landing takes the choice among them, and the two left, that comes nearest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, fresh, row_id, stored, tasks, text_or_empty

#: Weights of the sources in their order, repeating; most times that a document may be taken; documents of a block.
WEIGHTS, MOST, BLOCK = (5.0, 2.0, 1.0), 3.0, 2_000
#: Documents of a source that wait for the landing.
RESERVE = 12


def fly(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move probabilities along the null space of (1, size) until two at most are neither 0 nor 1.

    Each move keeps every expectation: the step's direction is drawn by the lengths of its two ends.
    """
    p = p.copy()
    draws = rng.random(2 * len(p) + 4)
    used = 0
    waiting = [int(i) for i in np.flatnonzero((p > 0) & (p < 1))]
    active: list[int] = []
    at = 0
    while True:
        while len(active) < 3 and at < len(waiting):
            active.append(waiting[at])
            at += 1
        if len(active) < 2:
            break
        if len(active) == 3:
            a, b, c = (float(size[i]) for i in active)
            v = (b - c, c - a, a - b)
            if v == (0.0, 0.0, 0.0):
                v = (1.0, -1.0, 0.0)
        elif size[active[0]] == size[active[1]]:
            v = (1.0, -1.0)
        else:
            break
        up = down = np.inf
        for i, d in zip(active, v, strict=True):
            if d > 0:
                up, down = min(up, (1 - p[i]) / d), min(down, p[i] / d)
            elif d < 0:
                up, down = min(up, -p[i] / d), min(down, -(1 - p[i]) / d)
        step = up if draws[used] * (up + down) < down else -down
        used += 1
        for i, d in zip(active, v, strict=True):
            x = p[i] + step * d
            p[i] = 0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x
        active = [i for i in active if 0 < p[i] < 1]
    return p


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The 0-1 choice for the few that are left whose words, and then number, come nearest to what was wanted."""
    left = np.flatnonzero((p > 0) & (p < 1))
    out = p.copy()
    if len(left):
        picks = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
        words = np.abs(picks @ size[left] - float((p[left] * size[left]).sum()))
        number = np.abs(picks.sum(1) - float(p[left].sum()))
        out[left] = picks[int(np.argmin(words + 2 * number))]
    return out


def waiting(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The documents that wait for the landing: spread over the upper half of the sizes, so that they can make up much or little."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    order = open_[np.argsort(size[open_], kind="stable")]
    out = np.zeros(len(p), bool)
    if len(order):
        out[order[np.unique((np.linspace(0.4, 0.97, RESERVE) * (len(order) - 1)).astype(int))]] = True
    return out


def ranked_sources(by_source: DataFrame) -> DataFrame:
    """Add ``place`` (from 0) in the order of code points, null last: ranges are numbered each by itself, then shifted."""
    rows = by_source.withColumn("_null", F.col("source").isNull())

    def numbered(batches):
        pid, at = TaskContext.get().partitionId(), 0
        for part in batches:
            part["_part"], part["place"] = pid, np.arange(at, at + len(part), dtype=np.int64)
            at += len(part)
            yield part

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", _part int, place long"
    split = rows.repartitionByRange(tasks(rows.sparkSession), "_null", "source").sortWithinPartitions("_null", "source")
    split = stored(split.mapInPandas(numbered, schema), "sources")
    before, total = {}, 0
    for r in sorted(split.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()):  # a row a range
        before[r["_part"]] = total
        total += r["n"]
    shift = F.lit(0)
    for part, n in before.items():
        shift = F.when(F.col("_part") == part, F.lit(n)).otherwise(shift)
    return split.withColumn("place", F.col("place") + shift).drop("_part", "_null")


def targets(by_source: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Add ``target`` to rows of (source, source_size): shares by weight of all words, none above ``most`` times its size.

    What a source cannot take is shared again by weight among the others, until none is above; each pass is
    one sum over the sources.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = stored(ranked_sources(by_source).withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(most)), "shares")
    total = float(rows.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        over = F.col("_w") * F.lit(level) > F.col("_cap")
        r = rows.agg(F.sum(F.when(over, F.col("_cap"))).alias("cap"), F.sum(F.when(~over, F.col("_w"))).alias("w"), F.count(F.when(over, 1)).alias("n")).first()
        if r["n"] == full or not r["w"]:
            break
        full = r["n"]
        level = (total - (r["cap"] or 0.0)) / r["w"]
    return rows.withColumn("target", F.least(F.col("_w") * F.lit(level), F.col("_cap"))).drop("_w", "_cap", "place")


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, block: int = BLOCK, seed: int = 11) -> DataFrame:
    """(doc_id, tie, source, size, source_size, target, times) of every row: how often the mix takes it.

    Size is the number of words; null text has none.  Rows of a null source are a source, the last.  Repeated
    rows are drawn each by itself.  The same rows give the same mix, however they are stored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text_or_empty().alias("text"))
    rows = stored(rows.select("doc_id", "source", row_id("text").alias("tie"), F.regexp_count("text", F.lit(WORD_PATTERN)).cast("long").alias("size")), "sizes")
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    shares = targets(by_source, weights, most).select(F.col("source").alias("_source"), "source_size", "n", "target")
    joined = rows.join(shares, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(wanted + F.lit(1e-12))
    units = joined.withColumn("whole", whole).withColumn("p", F.greatest(F.lit(0.0), wanted - whole))
    dealt = units.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "tie"), F.ceil(F.col("n") / block)).cast("long")).withColumn("waits", F.lit(False))
    names = ["doc_id", "tie", "source", "size", "source_size", "n", "target", "whole", "p", "block", "waits"]
    schema = "doc_id long, tie long, source string, size long, source_size long, n long, target double, whole long, p double, block long, waits boolean"

    def mover(start: bool, last: bool):
        def move(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(["tie", "doc_id", "size"], kind="stable", na_position="first").reset_index(drop=True)
            size, p = part["size"].to_numpy(np.float64), part["p"].to_numpy(np.float64)
            first = part.iloc[0]
            rng = np.random.default_rng([seed, int(first["block"]), int(first["source_size"]), int(first["tie"]) & 0xFFFFFFFF])
            if start:
                part["waits"] = waiting(p, size) if int(first["block"]) == 0 else False
            waits = part["waits"].to_numpy(bool)
            p[~waits] = fly(p[~waits], size[~waits], rng)
            part["p"] = land(p, size) if last else p
            return part[names]

        return move

    flown = stored(dealt.select(*names).groupBy("source", "block").applyInPandas(mover(True, False), schema), "flown")
    settled, left = flown.filter("p <= 0 or p >= 1"), flown.filter("p > 0 and p < 1")
    while True:
        # two documents a block at most, and the few that wait
        most_left = left.groupBy("source").agg(F.count(F.lit(1)).alias("k")).agg(F.max("k")).first()[0] or 0
        last = most_left <= block
        again = left.withColumn("block", F.floor(F.col("block") / (block // 2)))
        moved = stored(again.groupBy("source", "block").applyInPandas(mover(False, last), schema), "flown")
        settled = settled.unionByName(moved.filter("p <= 0 or p >= 1"))
        left = moved.filter("p > 0 and p < 1")
        if last:
            break
    return settled.select("doc_id", "tie", "source", "size", "source_size", "target", (F.col("whole") + F.col("p").cast("long")).alias("times"))


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """The documents, all columns, as often as the mix takes them.

    Null texts and texts without a word have no size and are taken as their source's fraction falls.  Equal
    rows are drawn each by itself and come as often as they do together.  An empty table stays empty.
    """
    names = docs.columns
    key, void, own, place, its_id, no_id, its_tie, times, copy = fresh(docs, "key", "void", "own", "place", "its_id", "no_id", "its_tie", "times", "copy")
    wanted = mixed(docs, weights, most).groupBy("doc_id", "tie").agg(F.sum("times").alias(times)).filter(F.col(times) > 0)
    wanted = wanted.select(F.coalesce("doc_id", F.lit(0)).alias(its_id), F.col("doc_id").isNull().alias(no_id), F.col("tie").alias(its_tie), times)
    named = F.col("doc_id").cast("long")
    keyed = docs.withColumns({key: F.coalesce(named, F.lit(0)), void: named.isNull(), own: row_id(text_or_empty())})
    # plain equality, so that numbering equal rows needs no other exchange of the texts than the join
    joined = keyed.join(wanted, (F.col(key) == F.col(its_id)) & (F.col(void) == F.col(no_id)) & (F.col(own) == F.col(its_tie)))
    first = joined.withColumn(place, F.row_number().over(Window.partitionBy(key, void, own).orderBy(F.lit(0)))).filter(F.col(place) == 1)
    return first.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(*names)
