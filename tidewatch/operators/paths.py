"""Shortest paths and betweenness over an edge table: blocks of sources meet the edges in pieces, no graph in a task's memory."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import forget, stored

#: Lengths that differ by less than this share are equal, and copies of edges that one batch of sources is sent at most.
SAME, BATCH_ROWS = 1e-9, 250_000_000
#: Nodes of a bucket, about; cells of (node, source) that a task holds of a kind; sources of a block at least, where cells allow.
BLOCK, CELLS, SOURCES = 512, 1 << 22, 64
#: Edges that lie together in a task's file; cells that are looked at together; rows that a Python worker gets at once.
PIECE, TOGETHER, ROWS = 1 << 16, 1 << 17, 32
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


class _Edges:
    """A block's edges (end, start, weight): written as they come to a file of the task's own, read in pieces, each in the order of its ends."""

    def __init__(self):
        self.file, self.pieces, self.open, self.least = tempfile.TemporaryFile(), [], [], np.inf

    def add(self, *piece: np.ndarray) -> None:
        self.open.append(piece)
        if sum(len(p[0]) for p in self.open) >= PIECE:
            self.close()

    def close(self) -> None:
        if not self.open:
            return
        t, o, w = (np.concatenate(c) for c in zip(*self.open, strict=True))
        order, at = np.argsort(t, kind="stable"), self.file.tell()
        for x in (t, o, w):
            self.file.write(x[order].tobytes())
        self.least = min(self.least, w.min())
        self.pieces.append((at, len(t)))
        self.open = []

    def along(self, active: np.ndarray, width: int) -> Iterator[tuple]:
        """(ends, starts, weights, first places of equal ends) of edges from ``active`` nodes, some at a time."""
        self.file.flush()
        step = max(16, TOGETHER // width)
        for at, m in self.pieces:
            o = np.memmap(self.file, np.int32, "r", at + 4 * m, (m,))
            kept = np.flatnonzero(active[o])
            t, w = np.memmap(self.file, np.int32, "r", at, (m,)), np.memmap(self.file, np.float64, "r", at + 8 * m, (m,))
            t, o, w = t[kept], o[kept], w[kept, None]
            for k in range(0, len(t), step):
                part = t[k : k + step]
                yield part, o[k : k + step], w[k : k + step], np.flatnonzero(np.r_[True, part[1:] != part[:-1]])


def _distances(edges: _Edges, nodes: int, low: int, width: int) -> np.ndarray:
    """Least lengths, a row for each node, a column for each of the sources ``low`` to ``low + width - 1``."""
    d = np.full((nodes, width), np.inf)
    d[np.arange(low, low + width), np.arange(width)] = 0.0
    active = np.zeros(nodes, bool)
    active[low : low + width] = True
    while active.any():
        after = np.zeros(nodes, bool)
        for t, o, w, first in edges.along(active, width):
            new, at = np.minimum.reduceat(d.take(o, axis=0) + w, first), t[first]
            old = d[at]
            less = new < old * (1 - SAME)
            moved = less.any(1)
            d[at[moved]] = np.where(less[moved], new[moved], old[moved])
            after[at[moved]] = True
        active = after
    return d


def _passed_on(edges: _Edges, d: np.ndarray, start: np.ndarray, back: bool) -> np.ndarray:
    """What comes of ``start`` when it is handed on along shortest paths, away from the sources or ``back``, and added at each node; without ``start``."""
    # no edge is a shortcut any more, so that one that is no longer than the way round is on a shortest path
    limit = d + SAME * np.maximum(1.0, d)
    tiny = edges.least <= 4 * SAME * max(1.0, d.max(initial=0.0, where=np.isfinite(d)))  # such an edge might seem to lead both ways
    total, sent = np.zeros_like(d), start
    active = sent.any(1)
    while active.any():
        after = np.zeros_like(d)
        for t, o, w, first in edges.along(active, d.shape[1]):
            low, high = (t, o) if back else (o, t)
            near = d.take(low, axis=0)
            tight = near + w <= limit.take(high, axis=0)
            if tiny:
                tight &= near < d.take(high, axis=0)
            after[t[first]] += np.add.reduceat(sent.take(o, axis=0) * tight, first)
        total += after
        sent, active = after, after.any(1)
    return total


def _parts(edges: _Edges, nodes: int, low: int, width: int) -> np.ndarray:
    """Each node's shares in the shortest paths from the sources ``low`` to ``low + width - 1``, other than itself, added up."""
    edges.close()
    d = _distances(edges, nodes, low, width)
    own = np.arange(low, low + width), np.arange(width)
    n = np.zeros_like(d)
    n[own] = 1.0
    n += _passed_on(edges, d, n, False)
    # a node's share over its paths is the sum of (1 + share) / paths of the nodes behind
    share = n * _passed_on(edges, d, np.divide(1.0, n, out=np.zeros_like(n), where=n > 0), True)
    share[own] = 0.0
    return share.sum(1)


def _shares(batches: Iterator[pa.RecordBatch], nodes: int, width: int) -> Iterator[pa.RecordBatch]:
    """(i, part) of each block of sources; rows come block by block, a row is some of the edges."""
    made = lambda sb, e: pa.RecordBatch.from_arrays([pa.array(np.arange(nodes)), pa.array(_parts(e, nodes, sb * width, min(width, nodes - sb * width)))], names=["i", "part"])
    block, edges = None, None
    for batch in batches:
        for i in range(len(batch)):
            sb = batch.column("sb")[i].as_py()
            if sb != block:
                if edges:
                    yield made(block, edges)
                block, edges = sb, _Edges()
            edges.add(*(batch.column(c)[i].values.to_numpy() for c in ("t", "o", "w")))
    if edges:
        yield made(block, edges)


def betweenness(g: DataFrame) -> DataFrame:
    """(node, betweenness): the share of all other pairs' shortest paths that go through a node, weights being distances.

    ``g`` has (a, b, weight), weights above 0; loops and all but the shortest of parallel edges count for nothing.
    Every node is a source, which is exact and takes nodes times edges of work in all.  A task has a block of sources and holds their
    cells, one for each node; the edges come to it in pieces and lie in a file of its own, so that nothing goes between tasks until
    the shares are added.  Blocks go in batches, so that what is sent stays bounded.
    """
    spark = g.sparkSession
    rows = g.filter("a <> b").groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.min(F.col("weight").cast("double")).alias("w"))
    names = stored(g.select(F.explode(F.array("a", "b")).alias("s")).distinct(), "names")
    n = names.count()
    placed = names.withColumn("b", F.pmod(F.xxhash64("s"), F.lit(max(1, -(-n // BLOCK)))).cast("int"))
    # nodes are numbered bucket by bucket
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("b").agg(F.count(F.lit(1)).alias("m")).select("b", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("start"))
    numbered = placed.join(F.broadcast(starts), "b").select("s", "b", (F.col("start") + F.row_number().over(Window.partitionBy("b").orderBy("s")) - 1).cast("int").alias("i"))
    nodes = stored(numbered, "nodes")
    of = lambda end, b, i: nodes.select(F.col("s").alias(end), F.col("b").alias(b), F.col("i").alias(i))
    adj = rows.unionByName(rows.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    packed = adj.join(of("u", "b", "o"), "u").join(of("v", "tb", "t"), "v").groupBy("b", "tb").agg(F.array_sort(F.collect_list(F.struct("t", "o", "w"))).alias("e"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = stored(packed.select("b", "tb", F.col("e.t").alias("t"), F.col("e.o").alias("o"), F.col("e.w").alias("w")).repartition(tasks, "b", "tb"), "edges")
    width = max(1, min(CELLS // max(1, n), max(SOURCES, -(-n // (32 * tasks)))))
    per = max(1, BATCH_ROWS // max(1, edges.agg(F.sum(F.size("t"))).first()[0] or 0))
    blocks, total = -(-n // width), None
    was = spark.conf.get(_ARROW_ROWS)
    spark.conf.set(_ARROW_ROWS, str(ROWS))  # a row is up to some megabytes
    try:
        for k in range(0, max(1, blocks), per):
            some = spark.range(k, max(k, min(k + per, blocks))).select(F.col("id").alias("sb"))
            dealt = edges.crossJoin(F.broadcast(some)).repartition(max(tasks, min(per, blocks)), "sb").sortWithinPartitions("sb", "tb", "b")
            part = stored(dealt.select("sb", "t", "o", "w").mapInArrow(lambda b: _shares(b, n, width), "i long, part double").groupBy("i").agg(F.sum("part").alias("part")), "dependencies")
            total = part if total is None else total.unionByName(part)
    finally:
        spark.conf.set(_ARROW_ROWS, was)
    forget(names, edges)
    scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    sums = total.groupBy("i").agg(F.sum("part").alias("part"))
    return nodes.join(sums, "i", "left").select(F.col("s").alias("node"), (F.coalesce("part", F.lit(0.0)) * scale).alias("betweenness"))
