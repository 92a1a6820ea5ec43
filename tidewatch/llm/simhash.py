"""SimHash near-dedup with covering locality-sensitive hashing.

Bit i of a fingerprint has a fixed vector m(i) of r + 1 bits; table v (1 <= v < 2^(r+1)) keeps the bits
whose vector has an odd overlap with v.  The vectors of r differing bits cannot span r + 1 dimensions, so
some v is orthogonal to all of them: every pair within radius r agrees on all kept bits of some table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, row_id, stored, tasks, text_or_empty
from .components import components
from .tokens import release

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Fingerprints in one bucket beyond which it is divided further, and rows of one task's group.
LARGE, GROUP = 20_000, 300_000
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str, width: int = SHINGLE) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    h = partial(xxhash.xxh64_intdigest, seed=SEED)
    joined = b" ".join(words)
    if len(words) < width:
        return np.array([h(joined)] if words else [], np.uint64)
    ends = list(accumulate([len(w) + 1 for w in words]))
    starts = [0, *ends]
    return np.fromiter(map(h, [joined[s : e - 1] for s, e in zip(starts, ends[width - 1 :], strict=False)]), np.uint64, len(words) - width + 1)


def fingerprints(texts: list[str], width: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprints: a bit is 1 if it is set in over half of the shingles' hashes; no word, no bit."""
    return majorities([shingle_hashes(t, width) for t in texts])


def majorities(hashes: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each list of hashes."""
    sizes = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(hashes), np.uint64)
    have = np.flatnonzero(sizes)
    if not len(have):
        return out
    flat, sizes = np.concatenate([hashes[i] for i in have]), sizes[have]
    first = np.cumsum(sizes) - sizes
    # eight bits at a time are counted in the eight bytes of a word, for 255 hashes at most
    parts = -(-sizes // 255)
    part_first = np.cumsum(parts) - parts
    starts = np.repeat(first, parts) + 255 * (np.arange(parts.sum()) - np.repeat(part_first, parts))
    for k in range(8):
        lanes = np.add.reduceat((flat >> np.uint64(k)) & _LANES, starts).view(np.uint8).reshape(-1, 8)
        counts = np.add.reduceat(lanes.astype(np.int64), part_first, axis=0)
        for byte in range(8):
            out[have] |= (2 * counts[:, byte] > sizes).astype(np.uint64) << np.uint64(8 * byte + k)
    return out


def _fingerprint_rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        texts = batch.column(2).to_pylist()
        found = []
        for at in range(0, len(texts), 200):
            found.append(fingerprints(texts[at : at + 200], width))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64())], names=["doc_id", "tie", "fp"])


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The kept bits of each table, as signed 64-bit numbers; bit i has the vector 1 + i mod (2^(radius+1) - 1)."""
    n = (1 << (radius + 1)) - 1
    out = []
    for v in range(1, n + 1):
        m = sum(1 << i for i in range(bits) if bin((1 + i % n) & v).count("1") % 2)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each node's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new[new], new):
            new = new[new]
        new = new[label]
        if np.array_equal(new, label):
            return label
        label = new


def _near(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of linked pairs inside the buckets; within a large bucket, only enough pairs to connect what links."""
    small = sizes <= 64
    left = np.repeat(np.where(small, sizes, 0), sizes) - (np.arange(len(fps)) - np.repeat(starts, sizes))
    for d in range(1, int(sizes[small].max(initial=1))):
        i = np.flatnonzero(left > d)
        i = i[np.bitwise_count(fps[i] ^ fps[i + d]) <= radius]
        yield i, i + d
    for s, n in zip(starts[~small].tolist(), sizes[~small].tolist(), strict=True):
        part = fps[s : s + n]
        label = np.arange(n)
        for at in range(0, n, 512):
            i, j = np.nonzero(np.bitwise_count(part[at : at + 512, None] ^ part[None, :]) <= radius)
            i += at
            keep = label[i] != label[j]
            if keep.any():
                label = _roots(n, np.concatenate([i[keep], np.arange(n)]), np.concatenate([j[keep], label]))
        own = np.flatnonzero(label != np.arange(n))
        yield s + own, s + label[own]


def _links(batches: pa.Table, radius: int) -> pa.Table:
    """Links between the fingerprints of one group of buckets: each to the first of those that it reaches here."""
    rows = batches.select(["t", "key", "part", "sub", "fp"])
    t, key, part, sub, fp = (rows.column(k).to_numpy() for k in range(5))
    order = np.lexsort((fp, sub, part, key, t))
    t, key, part, sub, fp = t[order], key[order], part[order], sub[order], fp[order]
    new = np.ones(len(fp), bool)
    new[1:] = (t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (part[1:] != part[:-1]) | (sub[1:] != sub[:-1])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(fp)))
    several = np.repeat(sizes > 1, sizes)
    fp, sizes = fp[several].view(np.uint64), sizes[sizes > 1]
    starts = np.cumsum(sizes) - sizes
    pairs = list(_near(fp, starts, sizes, radius))
    values, place = np.unique(fp, return_inverse=True)
    a = np.concatenate([place[i] for i, _ in pairs]) if pairs else np.zeros(0, np.int64)
    b = np.concatenate([place[j] for _, j in pairs]) if pairs else np.zeros(0, np.int64)
    label = _roots(len(values), a, b)
    own = np.flatnonzero(label != np.arange(len(values)))
    return pa.table({"a": values[own].view(np.int64), "b": values[label[own]].view(np.int64)})


def near_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that connect whatever distinct fingerprints ``fps`` (fp) differ in ``radius`` bits or fewer.

    A bucket of over ``LARGE`` fingerprints is divided: the bits that its table drops are cut into radius + 1
    parts, and near pairs agree on one of them.  No pair of a bucket is lost and no bucket's pairs are listed.
    """
    spark = fps.sparkSession
    n = fps.count()
    kept = masks(radius)
    tables = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(m).alias("m")) for t, m in enumerate(kept)])).alias("x"))
    rows = tables.select("fp", F.col("x.t").alias("t"), F.col("x.m").alias("m"), F.col("fp").bitwiseAND(F.col("x.m")).alias("key"))
    hot = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LARGE).select("t", "key", F.lit(True).alias("hot"))
    hot = stored(hot, "hot")
    names = ["t", "key", "part", "sub", "fp"]
    cold = rows
    if hot.count():
        cold = rows.join(hot, ["t", "key"], "left")
        parts = [[i for i in range(64) if i % (radius + 1) == p] for p in range(radius + 1)]
        bits = [sum(1 << i for i in own) - ((1 << 64) if 63 in own else 0) for own in parts]
        split = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col("fp").bitwiseAND(F.bitwise_not("m")).bitwiseAND(F.lit(b)).alias("sub")) for p, b in enumerate(bits)]))
        warm = cold.filter("hot").select("t", "key", "fp", split.alias("y")).select("t", "key", "y.part", "y.sub", "fp")
        cold = cold.filter("hot is null")
        rows = cold.select("t", "key", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("sub"), "fp").unionByName(warm.select(*names))
    else:
        rows = rows.select("t", "key", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("sub"), "fp")
    groups = max(tasks(spark), -(-n * len(kept) // GROUP))
    dealt = rows.withColumn("g", F.pmod(F.xxhash64("t", "key", "part", "sub"), F.lit(groups)).cast("int"))
    return dealt.groupBy("g").applyInArrow(lambda x: _links(x, radius), "a long, b long")


def near_groups(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, tie, fp, component_id, first_tie) of every row; a component is what links reach.

    Null text and text without a word have fingerprint zero and link like any other.  Repeated rows share
    fingerprint and component.  A null doc_id never is a component's smallest one unless it is the only one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.select("doc_id", row_id("text").alias("tie"), "text")
    marked = stored(rows.mapInArrow(lambda b: _fingerprint_rows(b, width), "doc_id long, tie long, fp long"), "fingerprints")
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "tie"))).alias("head")
    fps = stored(marked.groupBy("fp").agg(first), "distinct")
    roots = components(near_links(fps.select("fp"), radius))
    rooted = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "head")
    heads = rooted.groupBy("root").agg(F.min("head").alias("head"))
    named = rooted.select("fp", "root").join(heads, "root").select(F.col("fp").alias("_fp"), "head")
    return marked.join(named, marked["fp"] == named["_fp"]).select("doc_id", "tie", "fp", F.col("head.doc_id").alias("component_id"), F.col("head.tie").alias("first_tie"))


def near_dedup(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The documents, all columns, without those that link to another: of each component the smallest doc_id stays.

    Of rows with that id the first by the hash of its text stays, once.  Rows without an id stay.
    """
    return first_of_groups(docs, near_groups(docs, width, radius))


def first_of_groups(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are first of their component in ``groups`` (doc_id, tie, component_id, first_tie), once, and those without an id."""
    names = docs.columns
    key, void, own, place, first_id, no_id, first_tie = fresh(docs, "key", "void", "own", "place", "first_id", "no_id", "first_tie")
    keep = groups.filter("doc_id is null or (doc_id = component_id and tie = first_tie)")
    keep = keep.select(F.coalesce("doc_id", F.lit(0)).alias(first_id), F.col("doc_id").isNull().alias(no_id), F.col("tie").alias(first_tie)).distinct()
    named = F.col("doc_id").cast("long")
    marked = docs.withColumns({key: F.coalesce(named, F.lit(0)), void: named.isNull(), own: row_id(text_or_empty())})
    # plain equality, so that numbering equal rows needs no other exchange of the texts than the join
    kept = marked.join(keep, (F.col(key) == F.col(first_id)) & (F.col(void) == F.col(no_id)) & (F.col(own) == F.col(first_tie)), "left_semi")
    order = F.row_number().over(Window.partitionBy(key, void, own).orderBy(F.lit(0)))
    return kept.withColumn(place, order).filter((F.col(place) == 1) | F.col(void)).select(*names)
