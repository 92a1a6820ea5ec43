"""SimHash near-dedup of word shingles at a Jaccard likeness of 0.8, complete at that threshold.

The covering hash tables of ``simhash`` find the texts whose fingerprints of five-word shingles differ in
three bits or fewer: the bulk of the copies, which an exact comparison then confirms.  At a likeness of 0.8
fingerprints differ in about ten of 64 bits, for which covering would take thousands of tables.  So the sets
that are left apart go on to a filter that loses no pair:

All sets are sorted in one order.  Sets of n and m shingles with a likeness of 0.8 or more share one of the
first n - ceil(0.8 n) + 1 of the one and of the m - ceil(0.8 m) + 1 of the other, so rows of these prefixes
that meet are all candidates.  Any order is right; the rarest shingles come first, so that sets meet at a shared
passage only where they have next to nothing of their own.  How often a shingle occurs is told by a table of
2^24 counts over all documents, to which hashes are mapped by their upper bits: of one size whatever the input.
Two filters lose no pair: what can still be shared before and after the meeting shingle, and the parities of
the shingles per cell of a hash, of which no more can differ than shingles do.  What passes is compared whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, row_id, stored, tasks, text_or_empty
from .components import components
from .simhash import GROUP, first_of_groups, majorities, near_links, shingle_hashes
from .tokens import give_back, release

#: Words of a shingle.
SHINGLE = 5
#: Bits of a hash that name its count, counts of a chunk that travels as one row, hashes that are counted at a time.
LOAD_BITS, CHUNK, COUNTED = 24, 1 << 16, 1 << 20
#: Pairs whose parities are held at once.
COMPARED = 20_000
#: Cells of parities for each shingle, and bits that a table of them is folded to where it goes with each of a set's shingles.
SPARE, FOLD = 4, 4096
#: Bits of the table that tells which texts are needed: 2^24, in rows of 2^15.
_CELLS = 1 << 24


def shingle_set(text: str) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles; of fewer words than a shingle has the hash of all."""
    return np.unique(shingle_hashes(text, SHINGLE))


def prefix_length(n: int) -> int:
    return n - -(-4 * n // 5) + 1 if n else 0


def parities(hashes: np.ndarray) -> bytes:
    """A bit for each cell, FOLD and at least SPARE times as many as shingles: whether an odd number of them falls into it."""
    cells = FOLD
    while cells < SPARE * len(hashes):
        cells *= 2
    return np.packbits(np.bincount((hashes & np.uint64(cells - 1)).astype(np.int64), minlength=cells) % 2 == 1, bitorder="little").tobytes()


def fewest_apart(a: bytes, b: bytes) -> int:
    """A lower bound of the number of shingles in one set only; the longer table is folded to the shorter."""
    x, y = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _load_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, packed counts) of a task's texts, a row for each chunk that has any."""
    release()
    counts, waiting, held = np.zeros(1 << LOAD_BITS, np.uint32), [], 0

    def add() -> None:
        cells, n = np.unique(np.concatenate(waiting), return_counts=True)
        counts[cells] += n.astype(np.uint32)
        waiting.clear()

    for batch in batches:
        for text in batch.column(0).to_pylist():
            waiting.append((shingle_set(text) >> np.uint64(64 - LOAD_BITS)).astype(np.int64))
            held += len(waiting[-1])
            if held >= COUNTED:
                add()
                held = 0
    if waiting:
        add()
    for k, part in enumerate(counts.reshape(-1, CHUNK)):
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["chunk", "counts"])
    give_back()


def _sum_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of each chunk's counts, at most 65,535; rows of a chunk are all in one task and are added as they come."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total.setdefault(k, np.zeros(CHUNK, np.int64))[:] += np.frombuffer(zlib.decompress(data), np.uint32)
    for k, sums in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.minimum(sums, 65_535).astype("<u2").tobytes()], pa.binary())], names=["chunk", "counts"])


def shingle_loads(docs: DataFrame) -> np.ndarray:
    """For each value of a hash's upper bits how many documents' shingles have it: 32 MB for any input.

    A task's counts are packed before they are exchanged, at most a fixed size for each task.  Only the order of shingles depends on them.
    """
    rows = docs.select(text_or_empty().alias("text")).mapInArrow(_load_rows, "chunk int, counts binary")
    found = rows.repartition(tasks(docs.sparkSession), "chunk").mapInArrow(_sum_rows, "chunk int, counts binary").collect()
    out = np.zeros((1 << LOAD_BITS) // CHUNK * CHUNK, np.uint16).reshape(-1, CHUNK)
    for r in found:  # one row a chunk
        out[r["chunk"]] = np.frombuffer(r["counts"], "<u2")
    return out.ravel()


def _set_rows(batches: Iterator[pa.RecordBatch], loads: np.ndarray) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for at in range(0, len(texts), 500):
            sigs, sizes, prefixes, bits, sets = [], [], [], [], []
            for t in texts[at : at + 500]:
                s = shingle_set(t)
                sets.append(s)
                often = loads[(s >> np.uint64(64 - LOAD_BITS)).astype(np.int64)]
                sigs.append(xxhash.xxh64_intdigest(s.tobytes()) if len(s) else 0)
                sizes.append(len(s))
                prefixes.append(s[np.argsort(often, kind="stable")[: prefix_length(len(s))]].view(np.int64))
                bits.append(parities(s))
            offsets = np.cumsum([0, *map(len, prefixes)])
            arrays = [pa.array(np.array(sigs, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(prefixes), pa.int64())), pa.array(bits, pa.binary()), pa.array(majorities(sets).view(np.int64))]
            part = batch.slice(at, 500)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *arrays], names=["doc_id", "tie", "sig", "n", "prefix", "bits", "fp"])
    give_back()


def _fits(n: np.ndarray, p: np.ndarray, m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether sets of n and m that meet at places p and q can reach 0.8: 4 / 9 of n + m must be shared."""
    most = np.minimum(p, q) + 1 + np.minimum(n - p, m - q) - 1
    return (5 * np.minimum(n, m) >= 4 * np.maximum(n, m)) & (9 * most >= 4 * (n + m))


def _buckets(rows: pa.Table, names: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    columns = [rows.column(k).to_numpy().astype(np.int64) for k in names]
    order = np.lexsort((columns[1], columns[2], columns[0]))
    columns = [c[order] for c in columns]
    h = columns[0]
    starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    return starts, np.diff(np.append(starts, len(h))), columns


def _shared(rows: pa.Table) -> pa.Table:
    """The rows whose shingle others have as well, with the set of middle size as ``lead`` where that can be near."""
    starts, sizes, (h, sig, n, pos) = _buckets(rows, ["h", "sig", "n", "pos"])
    middle = np.repeat(starts + sizes // 2, sizes)
    lead = np.where(_fits(n, pos, n[middle], pos[middle]), sig[middle], sig)
    several = np.repeat(sizes > 1, sizes)
    return pa.table({"h": h[several], "sig": sig[several], "n": n[several].astype(np.int32), "pos": pos[several].astype(np.int32), "lead": lead[several]})


def _pairs(rows: pa.Table) -> pa.Table:
    """All pairs of sets that share a shingle here, can be near, by their parities too, and are not connected yet."""
    starts, sizes, (_, sig, n, pos, root, own) = _buckets(rows.append_column("own", pa.array(np.arange(len(rows)))), ["h", "sig", "n", "pos", "root", "own"])
    mixed = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
    in_mixed = np.repeat(mixed, sizes)
    # only rows of mixed buckets are compared: theirs alone are taken, FOLD bits each
    bits = np.frombuffer(b"".join(x.as_py() for x in rows.column("bits").take(pa.array(own[in_mixed]))), np.uint64).reshape(-1, FOLD // 64)
    place = np.cumsum(in_mixed) - 1
    left = np.repeat(np.where(mixed, sizes, 0), sizes) - (np.arange(len(sig)) - np.repeat(starts, sizes))
    found = [np.zeros((0, 2), np.int64)]
    i, d = np.flatnonzero(left > 1), 1
    while len(i):
        i = i[5 * n[i] >= 4 * n[i + d]]  # sizes ascend: larger ones further on don't fit either
        k = i[(root[i] != root[i + d]) & _fits(n[i], pos[i], n[i + d], pos[i + d])]
        if len(k):
            k = k[np.concatenate([9 * np.bitwise_count(bits[place[c]] ^ bits[place[c + d]]).sum(axis=1) <= n[c] + n[c + d] for c in np.array_split(k, -(-len(k) // COMPARED))])]
            found.append(np.sort(np.stack([sig[k], sig[k + d]], axis=1), axis=1))
        d += 1
        i = i[left[i] > d]
    out = np.unique(np.concatenate(found), axis=0)
    return pa.table({"a": out[:, 0], "b": out[:, 1]})


def _near_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, m = batch.column("n").to_pylist(), batch.column("m").to_pylist()
        x, y = batch.column("bits").to_pylist(), batch.column("other").to_pylist()
        keep = [9 * fewest_apart(p, q) <= s + t for s, t, p, q in zip(n, m, x, y, strict=True)]
        yield batch.select(["a", "b", "tie_a", "tie_b"]).filter(pa.array(keep, pa.bool_()))


def _whole_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        ties, texts = batch.column(0), batch.column(1).to_pylist()
        for at in range(0, len(texts), 200):
            sets = [shingle_set(t).view(np.int64) for t in texts[at : at + 200]]
            offsets = np.cumsum([0, *map(len, sets)])
            yield pa.RecordBatch.from_arrays([ties.slice(at, 200), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(sets), pa.int64()))], names=["tie", "whole"])
    give_back()


def _needed(texts: DataFrame, ties: DataFrame) -> DataFrame:
    """The rows of (tie, text) whose tie is in ``ties``, once; a table of bits spares the others the exchange."""
    cell = F.pmod(F.col("tie"), F.lit(_CELLS)).cast("long") + 1
    bits = stored(ties.groupBy(F.bitmap_bucket_number(cell).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(cell)).alias("_bits")), "bits")
    at = F.bitmap_bit_position(cell)
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    marked = texts.withColumn("_bucket", F.bitmap_bucket_number(cell)).withColumn("_at", at).join(F.broadcast(bits), "_bucket")
    marked = marked.filter(byte.bitwiseAND(F.expr("shiftleft(1, cast(_at % 8 as int))")) != 0)
    return marked.select("tie", "text").join(ties, "tie", "left_semi").dropDuplicates(["tie"])


def verified(pairs: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of ``pairs`` whose sets have a likeness of 0.8 or more."""
    side = reps.select("sig", "n", "tie", "bits")
    joined = pairs.join(side.select(F.col("sig").alias("a"), "n", F.col("tie").alias("tie_a"), "bits"), "a")
    joined = joined.join(side.select(F.col("sig").alias("b"), F.col("n").alias("m"), F.col("tie").alias("tie_b"), F.col("bits").alias("other")), "b")
    near = stored(joined.mapInArrow(_near_rows, "a long, b long, tie_a long, tie_b long"), "near")
    ties = stored(near.select(F.explode(F.array("tie_a", "tie_b")).alias("tie")).distinct(), "ties")
    sets = stored(_needed(texts, ties).mapInArrow(_whole_rows, "tie long, whole array<long>"), "sets")
    forget(ties)
    both = near.join(sets.select(F.col("tie").alias("tie_a"), F.col("whole").alias("x")), "tie_a").join(sets.select(F.col("tie").alias("tie_b"), F.col("whole").alias("y")), "tie_b")
    out = stored(both.filter(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b"), "links")
    forget(near, sets)
    return out


def _with_folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for x in batch.column(1).to_pylist():
            row = np.frombuffer(x, np.uint64)
            while len(row) > FOLD // 64:  # folding adds cells, so that no more can differ than before
                row = row[: len(row) // 2] ^ row[len(row) // 2 :]
            out.append(row.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["sig", "bits"])


def covered(reps: DataFrame) -> DataFrame:
    """Candidates (sig, lead) by fingerprint: sets of one fingerprint, and those that share a covering table's bucket within the radius."""
    by_fp = stored(reps.filter("n > 0").groupBy("fp").agg(F.min("sig").alias("lead")), "fingerprints")
    same = reps.join(by_fp, "fp").filter("sig <> lead").select("sig", "lead")
    links = near_links(by_fp.select("fp"))
    near = links.join(by_fp.select(F.col("fp").alias("a"), F.col("lead").alias("sig")), "a").join(by_fp.select(F.col("fp").alias("b"), "lead"), "b")
    return same.unionByName(near.select("sig", "lead"))


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, sig, component_id, first_tie) of every row; a component is what pairs of 0.8 or more reach.

    Texts without a word are one component.  In a first round the pairs that the covering tables find are
    compared, and each set with one that shares a shingle, so that a large group of near copies is connected
    before its pairs are listed; in the second all pairs are compared that the first did not connect.  Repeated
    rows share a component; rows without an id never name one.
    """
    spark = docs.sparkSession
    texts = docs.select(text_or_empty().alias("text")).select(row_id("text").alias("tie"), "text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).select("doc_id", row_id("text").alias("tie"), "text")
    loads = spark.sparkContext.broadcast(shingle_loads(docs))
    marked = stored(rows.mapInArrow(lambda b: _set_rows(b, loads.value), "doc_id long, tie long, sig long, n int, prefix array<long>, bits binary, fp long"), "shingles")
    loads.destroy()  # a copy in every worker, which nothing reads any more
    head = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "tie"))).alias("head")
    reps = stored(marked.groupBy("sig").agg(head, F.min("tie").alias("tie"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"), F.first("fp").alias("fp")), "sets")
    total = reps.agg(F.sum(F.size("prefix"))).first()[0] or 0
    groups = max(tasks(spark), -(-total // (GROUP // 4)))  # a row goes with FOLD bits
    dealt = F.pmod(F.xxhash64("h"), F.lit(groups)).cast("int").alias("g")
    heads = reps.select("sig", "n", F.posexplode("prefix").alias("pos", "h")).select(dealt, "h", "sig", "n", "pos")
    shared = stored(heads.groupBy("g").applyInArrow(_shared, "h long, sig long, n int, pos int, lead long"), "shared")
    alike = shared.filter("sig <> lead").select("sig", "lead")
    first = covered(reps).unionByName(alike).select(F.least("sig", "lead").alias("a"), F.greatest("sig", "lead").alias("b")).distinct()
    links = verified(first, reps, texts)
    roots = stored(components(links), "roots")
    rooted = shared.join(roots, shared["sig"] == roots["node"], "left").select("h", "sig", "n", "pos", F.coalesce("root", "sig").alias("root"))
    # only shingles that sets of different components share are looked at again, with the sets' parities
    open_ = rooted.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("h")
    rooted = rooted.join(open_, "h", "left_semi").join(reps.select("sig", "bits").mapInArrow(_with_folded, "sig long, bits binary"), "sig").select(dealt, "h", "sig", "n", "pos", "root", "bits")
    second = rooted.groupBy("g").applyInArrow(_pairs, "a long, b long").distinct()
    more = verified(second, reps, texts)
    forget(shared, roots)
    roots = components(links.unionByName(more))
    named = reps.join(roots, reps["sig"] == roots["node"], "left").select("sig", "head", F.coalesce("root", "sig").alias("root"))
    firsts = named.groupBy("root").agg(F.min("head").alias("head"))
    named = named.select("sig", "root").join(firsts, "root").select(F.col("sig").alias("_sig"), "head")
    out = stored(marked.select("doc_id", "tie", "sig").join(named, F.col("sig") == F.col("_sig")).select("doc_id", "tie", "sig", F.col("head.doc_id").alias("component_id"), F.col("head.tie").alias("first_tie")), "groups")
    forget(marked, reps, links, more)
    return out


def near_dedup(docs: DataFrame) -> DataFrame:
    """The documents, all columns, without those that link to another: of each component the smallest doc_id stays."""
    return first_of_groups(docs, near_groups(docs))
