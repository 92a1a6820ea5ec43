"""Best-fit packing: sum-of-squares packing of token pieces into sequences of a fixed capacity.

Each piece goes where the sum of the squared numbers of open sequences per residual gap becomes smallest.
Pieces are dealt into groups that fit one task; what the groups leave open is packed again in further
rounds, whole open sequences as pieces, until one group holds all that is left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_id, stored, text_or_empty
from .tokens import encoder, slices

#: Tokens in a sequence, and pieces that one task packs.
CAPACITY, GROUP = 2048, 40_000


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece (1 <= size <= capacity) by the sum-of-squares rule; ties go to the smallest gap.

    Large pieces come first, and a sequence is opened only where no open one has room: the rule is
    online and keeps a stock of all gaps, which costs sequences when all pieces are known beforehand.
    """
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.int64)
    bins, offsets, made = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        now = count[s:capacity]  # open sequences with gaps s, s + 1, ...
        best = -1
        if now.any():
            after = 2 * count[: capacity - s] + 1
            after[0] = 0  # a full sequence is not open
            change = np.where(now > 0, after - 2 * now + 1, np.iinfo(np.int64).max)
            best = s + int(change.argmin())
        if best < 0:
            b, gap = made, capacity
            made += 1
        else:
            b, gap = open_bins[best].pop(), best
            count[best] -= 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            open_bins[gap - s].append(b)
            count[gap - s] += 1
    return bins, offsets


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    end = np.array([end_id], enc.dtype).tobytes()
    names = ["doc_id", "tie", "piece", "start", "length", "ids_crc32"]
    for batch in batches:
        ids, ties, texts = (batch.column(k).to_pylist() for k in range(3))
        for a, b in slices(texts):
            rows = []
            for doc_id, tie, encoded in zip(ids[a:b], ties[a:b], enc.encode(texts[a:b]), strict=True):
                tokens = np.frombuffer(encoded + end, enc.dtype).astype("<u4")
                first = len(tokens) % capacity or capacity  # only the first piece may be shorter
                edges = [0, *range(first, len(tokens) + 1, capacity)]
                rows += [(doc_id, tie, k, s, e - s, zlib.crc32(tokens[s:e].tobytes())) for k, (s, e) in enumerate(zip(edges, edges[1:], strict=False))]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, tie, piece, start, length, ids_crc32) of every document's ids, cut only where longer than ``capacity``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.select("doc_id", row_id("text").alias("tie"), "text")
    return rows.mapInArrow(lambda b: _pieces(b, path, capacity, end_id), "doc_id long, tie long, piece int, start long, length long, ids_crc32 long")


def packed(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Add (sequence_id, offset) to rows of (key, ..., length); equal rows are told apart by their place in their group.

    A round packs groups of about ``group`` pieces each by itself.  Sequences that a round fills to nine
    tenths are closed; the others become single pieces of the next round, the last of which is one group.
    """
    spark = pieces.sparkSession
    names = pieces.columns
    todo = pieces.filter(F.col("length") < capacity)
    whole = pieces.filter(F.col("length") >= capacity)
    n = todo.count()
    groups = max(1, -(-n // group))
    used = groups  # groups are numbered on through all rounds, so that no two share a sequence's number

    def place(part: pd.DataFrame, keep: list[str]) -> pd.DataFrame:
        part = part.sort_values([c for c in part.columns], kind="stable", na_position="first").reset_index(drop=True)
        bins, offsets = pack(part["length"].to_numpy(np.int64), capacity)
        part["sequence_id"] = (part["g"].to_numpy(np.int64) << 32) + bins
        part["offset"] = offsets
        return part[keep]

    kinds = dict(pieces.dtypes)
    dealt = todo.withColumn("g", F.pmod(F.xxhash64("doc_id", "tie", "piece"), F.lit(groups)).cast("long"))
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", sequence_id long, offset long"
    rows = stored(dealt.groupBy("g").applyInPandas(lambda p: place(p, [*names, "sequence_id", "offset"]), schema), "packed")
    while groups > 1:
        filled = rows.groupBy("sequence_id").agg(F.sum("length").alias("length"))
        left = filled.filter(F.col("length") < capacity * 9 // 10)
        m = left.count()
        fewer = max(1, -(-m // group))
        if fewer >= groups:  # nearly all is closed or nothing can be joined
            break
        again = left.withColumn("g", F.pmod(F.xxhash64("sequence_id"), F.lit(fewer)).cast("long") + F.lit(used))
        moved = again.groupBy("g").applyInPandas(lambda p: place(p.rename(columns={"sequence_id": "sequence_id_old"}), ["sequence_id_old", "sequence_id", "offset"]), "sequence_id_old long, sequence_id long, offset long")
        moved = stored(moved.select("sequence_id_old", F.col("sequence_id").alias("_new"), F.col("offset").alias("_shift")), "moved")
        rows = rows.join(moved, rows["sequence_id"] == moved["sequence_id_old"], "left").select(
            *[rows[c] for c in names], F.coalesce("_new", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("_shift", F.lit(0))).alias("offset")
        )
        rows = stored(rows, "packed")
        groups, used = fewer, used + fewer
    # a piece as long as a sequence is one; its number is negative, so that it meets no other
    alone = whole.withColumn("sequence_id", -F.monotonically_increasing_id() - 1).withColumn("offset", F.lit(0).cast("long"))
    return rows.unionByName(alone)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Pieces of all documents with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text is empty (its sequence is the end id alone).  Repeated rows are packed as often as they occur.
    An empty table gives an empty result.
    """
    pieces = stored(token_pieces(docs, path, capacity), "pieces")
    return packed(pieces, capacity, group).drop("tie")
