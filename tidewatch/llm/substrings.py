"""Substring dedup with prefix-partitioned suffix trees over words.

A suffix is a place in a document with at least ``WINDOW`` words from there on.  Its prefix runs to the end
of its anchor, the smallest hashed run of ``GRAM`` words that starts and ends within its first WINDOW words;
so a prefix has GRAM to WINDOW words, and suffixes that share their first WINDOW words share their prefix.
Anchors that occur once hold no branching suffix and go.  A prefix that too many suffixes share is lengthened
to WINDOW words; one that is common even so is a node already, and its leaves are split over several subtrees
of which each gets a leaf of another as witness, so that a leaf by itself still meets another.

Prefixes are dealt whole into groups that fit one task.  There the words themselves, not their hashes, are
numbered, the suffixes sorted, and the common prefixes of neighbours measured.  Runs of neighbours with
WINDOW words or more in common are the deep internal nodes; a leaf's deepest one gives how far its repeat
reaches to the right, as far as the words at hand go.  What leaves of neighbouring prefixes cover together are
the maximal repeats, as spans of words.

Equal texts are told apart by number alone: a text that occurs twice repeats each of its windows, so one
copy of it stands for all in the trees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, fresh, stored, tasks, text_or_empty
from .tokens import release, slices

WINDOW, GRAM = 35, 12
#: Places of a prefix beyond which it is lengthened, and then split; places in one task's group.
LARGE, GROUP = 2_000, 30_000
#: Words that a suffix has in a tree at most: its window and what follows as long as it has the same anchor.
REACH = 2 * WINDOW - GRAM
#: Bytes beyond which a word stands as a digest of 128 bits in a suffix.
_LONG = 32
_BASE = 0x9E3779B97F4A7C15


def _hashed(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _rolled(h: np.ndarray, width: int, base: int = _BASE) -> np.ndarray:
    """Polynomial hashes modulo 2^64 of all runs of ``width`` numbers, by doubling; one for each start."""
    out, have, power, length = None, 0, h, 1
    while width:
        if width & 1:
            if out is None:
                out, have = power, length
            else:
                n = len(power) - have if len(power) > have else 0
                out = out[:n] * np.uint64(pow(base, length, 1 << 64)) + power[have : have + n]
                have += length
        width >>= 1
        if width:
            power = power[: max(0, len(power) - length)] * np.uint64(pow(base, length, 1 << 64)) + power[length:]
            length *= 2
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def anchors(h: np.ndarray, sizes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """For words' hashes ``h`` of documents of ``sizes`` words: (hash, document, place, lo, hi) of each anchor.

    ``place`` is within the document; the anchor is that of the suffixes at place - lo to place - hi.
    """
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.int64))
    if len(h) < window:
        return none
    grams = _mixed(_rolled(h, gram))
    low = np.uint64((1 << 24) - 1)
    if len(grams) > int(low):
        raise ValueError("too many words at once")
    key = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    span, least, have = window - gram + 1, key, 1
    while have * 2 <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[: len(key) - span + 1], least[span - have :][: len(key) - span + 1])
    ends = np.cumsum(sizes)
    document = np.repeat(np.arange(len(sizes)), sizes)[: len(least)]
    start = np.arange(len(least))
    valid = start + window <= ends[document]
    start, document, place = start[valid], document[valid], (least[valid] & low).astype(np.int64)
    if not len(start):
        return none
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (document[1:] != document[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    at, who = place[first], document[first]
    return grams[at], who, at - (ends - sizes)[who], at - start[first], at - start[last]


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        table = {}
        for a, b, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            table[a, b] = text  # equal texts of a batch once
        keys, texts = list(table), list(table.values())
        for i, j in slices(texts, 1 << 20):
            words = [t.encode("utf-8", "surrogatepass").split() for t in texts[i:j]]
            sizes = np.array([len(w) for w in words], np.int64)
            for k in np.flatnonzero(sizes > 1 << 22):  # a document of millions of words by itself, in overlapping parts
                yield from _long_rows(keys[i + k], _hashed(words[k]))
                words[k], sizes[k] = [], 0
            h, who, place, lo, hi = anchors(_hashed([w for d in words for w in d]), sizes)
            own = np.array(keys[i:j], np.int64).reshape(-1, 2)[who]
            yield _anchor_batch(h, own, place, lo, hi)


def _anchor_batch(h, own, place, lo, hi) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(h.view(np.int64)), pa.array(own[:, 0]), pa.array(own[:, 1]), pa.array(place.astype(np.int32)), pa.array(lo.astype(np.int8)), pa.array(hi.astype(np.int8))],
        names=["h", "t1", "t2", "p", "lo", "hi"],
    )


def _long_rows(key: tuple[int, int], h: np.ndarray, step: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Anchors of a very long document: each part has the suffixes that start in it, with all their words."""
    for at in range(0, max(1, len(h) - WINDOW + 1), step):
        part = h[at : at + step + WINDOW - 1]
        g, who, place, lo, hi = anchors(part, np.array([len(part)]))
        yield _anchor_batch(g, np.tile(np.array(key, np.int64), (len(g), 1)), place + at, lo, hi)


def _token(word: bytes) -> bytes:
    """A word as it stands in a suffix: a long one by its digest, which is longer than any word that stands as it is."""
    return word if len(word) <= _LONG else b"#" + hashlib.blake2b(word, digest_size=16).hexdigest().encode()


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each listed anchor of a text the words of its suffixes; a suffix with a common anchor is a row by itself, by a longer prefix."""
    release()
    names = ["h", "t1", "t2", "s", "n", "words", "deep"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()]
    for batch in batches:
        t1, t2, texts, lists = (batch.column(k).to_pylist() for k in range(4))
        for i, j in slices(texts, 1 << 20):
            out: list[list] = [[] for _ in names]
            for a, b, text, found in zip(t1[i:j], t2[i:j], texts[i:j], lists[i:j], strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                if max(map(len, words)) > _LONG:
                    words = list(map(_token, words))
                joined = b" ".join(words)
                ends = list(accumulate(map(len, words)))
                longer = _mixed(_rolled(_hashed(words), WINDOW)).view(np.int64) if any(x["deep"] for x in found) else None
                rows = []
                for x in found:
                    s, n = x["p"] - x["lo"], x["lo"] - x["hi"] + 1
                    if x["deep"]:
                        rows += [(int(longer[k]), k, 1, True) for k in range(s, s + n)]
                    else:
                        rows.append((x["h"], s, n, False))
                for h, s, n, deep in rows:
                    last = s + n + WINDOW - 2
                    part = joined[(ends[s - 1] + s if s else 0) : ends[last] + last]
                    for column, value in zip(out, (h, a, b, s, n, part, deep), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)


def common_prefixes(words: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of contexts, ``counts`` of each, in sorted order, and the words that each has in common with the next.

    The k-th suffix of a context starts at its k-th word and goes on to the context's end.
    """
    split = [w.split(b" ") for w in words]
    number: dict[bytes, int] = {}
    sizes = np.array([len(w) for w in split], np.int64)
    flat = np.fromiter((number.setdefault(w, len(number) + 1) for d in split for w in d), np.int64, int(sizes.sum()))
    flat = np.append(flat, np.zeros(REACH, np.int64)).astype(">u4")
    first, ends = np.cumsum(sizes) - sizes, np.cumsum(sizes)
    own = np.repeat(np.arange(len(words)), counts)
    start = first[own] + np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
    rows = np.lib.stride_tricks.sliding_window_view(flat, REACH)[start]
    rows[np.arange(REACH) >= (ends[own] - start)[:, None]] = 0
    order = np.argsort(rows.view(f"S{4 * REACH}").ravel(), kind="stable")
    ranked = rows[order]
    same = (ranked[1:] == ranked[:-1]) & (ranked[1:] != 0)
    return order, np.where(same.all(axis=1), REACH, np.argmin(same, axis=1)) if len(rows) > 1 else np.zeros(0, np.int64)


def internal_nodes(common: np.ndarray, least: int = WINDOW) -> list[tuple[int, int, int]]:
    """(first leaf, last leaf, depth) of the tree's internal nodes of ``least`` words or more, by the common prefixes of sorted neighbours."""
    out, open_ = [], []  # nodes that are open: first leaf and depth, depths ascending
    for i, d in enumerate([*common.tolist(), 0]):
        left = i
        while open_ and open_[-1][1] > d:
            left, depth = open_.pop()
            out.append((left, i, depth))
        if d >= least and (not open_ or open_[-1][1] < d):
            open_.append((left, d))
    return out


def deepest(common: np.ndarray) -> np.ndarray:
    """The depth of each sorted leaf's deepest node: what it has in common with the nearer of its neighbours."""
    edge = np.zeros(1, common.dtype)
    return np.maximum(np.concatenate([edge, common]), np.concatenate([common, edge]))


def _subtrees(group: pa.Table) -> pa.Table:
    """Spans (start, stop) of repeated words of one group of prefixes, some ten thousand suffixes at a time."""
    group = group.sort_by([("h", "ascending"), ("part", "ascending")])
    h, part = group.column("h").to_numpy(), group.column("part").to_numpy()
    counts, s = group.column("n").to_numpy().astype(np.int64), group.column("s").to_numpy().astype(np.int64)
    words = group.column("words").to_pylist()
    edges = np.append(np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (part[1:] != part[:-1]))), len(h))
    total = np.append(0, np.cumsum(counts))
    rows, starts, stops = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    k = 0
    while k < len(edges) - 1:
        stop = max(k + 1, int(np.searchsorted(total[edges], total[edges[k]] + 50_000)))
        stop = min(stop, len(edges) - 1)
        a, b = edges[k], edges[stop]
        order, common = common_prefixes(words[a:b], counts[a:b])
        depth = np.zeros(len(order), np.int64)
        depth[order] = deepest(common)
        own = np.repeat(np.arange(a, b), counts[a:b])
        begin = s[own] + np.arange(len(own)) - np.repeat(total[a:b] - total[a], counts[a:b])
        hit = np.flatnonzero(depth >= WINDOW)
        # a context's repeats that meet are one span
        own, begin, end = own[hit], begin[hit], (begin + depth)[hit]
        new = np.append(True, (own[1:] != own[:-1]) | (begin[1:] > end[:-1]))[: len(own)]
        at = np.flatnonzero(new)
        if len(at):
            rows.append(own[at])
            starts.append(begin[at])
            stops.append(np.maximum.reduceat(end, at))
        k = stop
    where = np.concatenate(rows)
    found = pa.table({"t1": group.column("t1").take(pa.array(where)), "t2": group.column("t2").take(pa.array(where)), "start": pa.array(np.concatenate(starts).astype(np.int32)), "stop": pa.array(np.concatenate(stops).astype(np.int32)), "witness": group.column("witness").take(pa.array(where))})
    return found.filter(pa.compute.invert(found.column("witness"))).drop_columns(["witness"])


def _kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        ids, ties, texts, many, lists = (batch.column(k).to_pylist() for k in range(5))
        for i, j in slices(texts, 1 << 20):
            total, removed, kept = [], [], []
            for text, all_of_it, found in zip(texts[i:j], many[i:j], lists[i:j], strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                n = len(words)
                gone = 0
                if all_of_it and n >= WINDOW:
                    words, gone = [], n
                elif found:
                    edge = np.zeros(n + 1, np.int32)
                    for x in found:
                        edge[x["start"]] += 1
                        edge[x["stop"]] -= 1
                    free = np.cumsum(edge[:n]) == 0
                    gone = n - int(free.sum())
                    words = [words[k] for k in np.flatnonzero(free)]
                total.append(n)
                removed.append(gone)
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "t1", "n_words", "n_removed", "kept"])


def _text_key() -> list[Column]:
    return [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")]


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, t1, n_words, n_removed, kept) of every row: its words without those in repeated windows.

    Words are runs of bytes other than space and 9 to 13; ``kept`` has them joined by one space.  All
    occurrences of a repeated window go, in repeated rows too.  Null text has no words; texts shorter than a
    window lose nothing.  ``t1`` hashes the text, so that (doc_id, t1) names a row but for equal rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("did"), *_text_key(), "text")
    keys = stored(rows.select("did", "t1", "t2"), "keys")
    several = keys.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("m"), F.min("did").alias("did"))
    found = stored(rows.select("t1", "t2", "text").mapInArrow(_anchor_rows, "h long, t1 long, t2 long, p int, lo byte, hi byte"), "anchors")
    anchors_ = found
    found = found.distinct()
    # written, so that the join stands right above its exchanges and a common anchor's rows can be split
    again = stored(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "again")
    lists = found.join(again, "h").groupBy("t1", "t2").agg(F.collect_list(F.struct("h", "p", "lo", "hi", (F.col("n") > LARGE).alias("deep"))).alias("found"))
    lists = stored(lists.join(several.select("t1", "t2", "did"), ["t1", "t2"]), "lists")
    forget(anchors_, again)
    one = rows.join(lists.select("did", "t1", F.col("t2").alias("_t2"), "found"), ["did", "t1"]).filter("t2 = _t2")
    contexts = one.select("t1", "t2", "text", "found").mapInArrow(_context_rows, "h long, t1 long, t2 long, s int, n int, words binary, deep boolean")
    contexts = stored(contexts, "contexts")
    forget(lists)
    # lengthened prefixes: one that occurs once goes, one that is common even so is split, each part with a witness:
    place = F.struct("t1", "t2", "s")
    longer = stored(contexts.filter("deep").groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min(place).alias("first"), F.max(place).alias("last")).filter("m > 1"), "longer")
    names = ["h", "part", "t1", "t2", "s", "n", "words", "witness"]
    parts = F.ceil(F.col("m") / LARGE).cast("int")
    deep = contexts.filter("deep").join(longer, "h")
    lone = F.lit(False).alias("witness")
    dealt = contexts.filter("not deep").select("h", F.lit(-1).alias("part"), "t1", "t2", "s", "n", "words", lone)
    dealt = dealt.unionByName(deep.select("h", F.pmod(F.xxhash64("t1", "t2", "s"), parts).cast("int").alias("part"), "t1", "t2", "s", "n", "words", lone))
    # the first leaf goes to all other parts, the last one to the first one's
    part_of = lambda x: F.pmod(F.xxhash64(x["t1"], x["t2"], x["s"]), parts).cast("int")
    all_parts = F.sequence(F.lit(0), parts - 1)
    to = F.when(place == F.col("first"), F.filter(all_parts, lambda p: p != part_of(F.col("first")))).when(place == F.col("last"), F.array_except(F.array(part_of(F.col("first"))), F.array(part_of(F.col("last")))))
    witness = deep.filter(parts > 1).filter((place == F.col("first")) | (place == F.col("last"))).withColumn("part", F.explode(to)).withColumn("witness", F.lit(True))
    dealt = dealt.unionByName(witness.select(*names))
    groups = max(tasks(spark), -(-contexts.count() // GROUP))
    dealt = dealt.withColumn("g", F.pmod(F.xxhash64("h", "part"), F.lit(groups)).cast("int"))
    leaves = stored(dealt.groupBy("g").applyInArrow(lambda x: _subtrees(x.drop_columns(["g"])), "t1 long, t2 long, start int, stop int"), "spans")
    forget(contexts, longer)
    marks = leaves.groupBy("t1", "t2").agg(F.collect_list(F.struct("start", "stop")).alias("marks"))
    texts = several.join(marks, ["t1", "t2"], "left").filter("m > 1 or marks is not null")
    by_row = keys.distinct().join(texts.select("t1", "t2", (F.col("m") > 1).alias("all"), F.when(F.col("m") == 1, F.col("marks")).alias("marks")), ["t1", "t2"])
    marked = rows.join(by_row.withColumnRenamed("t2", "_t2"), ["did", "t1"], "left")
    ready = marked.select("doc_id", "t1", "text", (F.coalesce("all", F.lit(False)) & (F.col("t2") == F.col("_t2"))).alias("all"), F.when(F.col("t2") == F.col("_t2"), F.col("marks")).alias("marks"))
    return ready.mapInArrow(_kept_rows, "doc_id long, t1 long, n_words long, n_removed long, kept string")


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with the kept words as text; a document that keeps no word of some goes.

    A text that loses nothing stays as it is.  ``n_chars``, where there is one, is counted anew.
    """
    names = docs.columns
    did, own, its_id, its_text, kept = fresh(docs, "did", "own", "its_id", "its_text", "kept")
    done = without_repeats(docs).filter("n_removed > 0").select(F.coalesce("doc_id", F.lit(0)).alias(its_id), F.col("t1").alias(its_text), F.col("kept").alias(kept))
    done = done.dropDuplicates([its_id, its_text])
    keyed = docs.withColumn(did, F.coalesce(F.col("doc_id").cast("long"), F.lit(0))).withColumn(own, F.xxhash64(text_or_empty()))
    joined = keyed.join(done, (F.col(did) == F.col(its_id)) & (F.col(own) == F.col(its_text)), "left").filter(F.col(kept).isNull() | (F.col(kept) != ""))
    out = joined.withColumn("text", F.coalesce(kept, "text"))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col(kept).isNull(), F.col("n_chars")).otherwise(F.char_length(kept)).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*names)
