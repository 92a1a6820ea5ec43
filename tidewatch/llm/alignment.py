"""Cross-tokenizer alignment: how the tokens of two tokenizers cover the same bytes.

Both tokenizers cut one byte axis.  The union of their token ends splits it into elementary intervals; a
search for each interval's end among either tokenizer's ends gives the one token of each that owns it, so every
interval is one overlap of two tokens.  Where both end, a group closes: the tokens between two such places
cover the same bytes, and the product of a group's tokens is what either side may stand for.

A pair of ids can only be linked if one token's bytes are a suffix of the other's.  A token has as many
suffixes as bytes, so there are no more linked pairs than bytes in both vocabularies, times the ids that spell
one byte string (two, in vocabularies with byte fallback): about a million for vocabularies of 50,000 and
32,000, whatever the corpus.  That bounds the table of counts, which is the only thing broadcast.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored
from .tokens import WordEncoder, release, slices

#: SentencePiece's mark of a space.
SPACE_MARK = "▁"
#: Words that the byte-level encoder of a task remembers.
KEEP = 600_000
_TOKENIZERS: dict[tuple[str, str, int], "TwoTokenizers"] = {}


def byte_level_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for: printable ones themselves, the others from 256 up."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class TwoTokenizers:
    """A byte-level BPE file (A) and a SentencePiece model (B), with every id's bytes and its decimal text."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = WordEncoder(path_a, KEEP)
        self.a.tokenizer.encode_special_tokens = True  # their strings in a text are plain text
        alphabet = byte_level_alphabet()
        vocabulary = self.a.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_a: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(map(alphabet.get, token)) if all(c in alphabet for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.size_a, self.size_b = np.array([*map(len, self.bytes_a)]), np.array([*map(len, self.bytes_b)])
        # id + "," inside a group; "|" after its A ids; ";" after its B ids
        self.text_a = np.array([str(i).encode() + s for s in (b",", b"|") for i in range(len(self.bytes_a))], object)
        self.text_b = np.array([str(i).encode() + s for s in (b",", b";") for i in range(len(self.bytes_b))], object)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(SPACE_MARK, " ").encode()

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(A ids, B ids) of each text with a space before it; none where either side doesn't spell those bytes."""
        none = np.zeros(0, np.int64)
        whole = [" " + t for t in texts]
        out = []
        for text, x, y in zip(whole, self.a.encode(whole), self.b.encode(texts, num_threads=1), strict=True):
            a, raw = np.frombuffer(x, self.a.dtype).astype(np.int64), text.encode()
            # a byte-level vocabulary without a normalizer spells what it is given, if it spells it in full
            good = len(text) > 1 and b"".join(map(self.bytes_b.__getitem__, y)) == raw and int(self.size_a[a].sum()) == len(raw)
            out.append((a, np.array(y, np.int64)) if good else (none, none))
        return out


def two_tokenizers(path_a: str, path_b: str) -> TwoTokenizers:
    """One pair for each process and pair of files."""
    key = (path_a, path_b, os.getpid())
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = TwoTokenizers(path_a, path_b)
    return _TOKENIZERS[key]


class Aligned(NamedTuple):
    """Elementary intervals in order: where each ends, its owners' positions, and whether it closes a group."""

    ends: np.ndarray
    owner_a: np.ndarray
    owner_b: np.ndarray
    closes: np.ndarray


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> Aligned:
    """The intervals of two ascending arrays of token ends over the same bytes; no token may be empty."""
    ends = np.union1d(ends_a, ends_b)
    owner_a, owner_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    closes = (ends_a[owner_a] == ends) & (ends_b[owner_b] == ends) if len(ends) else np.zeros(0, bool)
    return Aligned(ends, owner_a, owner_b, closes)


class Batch(NamedTuple):
    """Texts laid end to end on one byte axis: of each side ids, ends, group and text; of each link its ids and text."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_overlaps: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    link_text: np.ndarray
    aligned: Aligned


def batch_of(tokenizers: TwoTokenizers, texts: list[str]) -> Batch:
    found = tokenizers.encode(texts)
    n_a, n_b = (np.array([len(f[k]) for f in found], np.int64) for k in (0, 1))
    ids_a, ids_b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    ends_a, ends_b = np.cumsum(tokenizers.size_a[ids_a]), np.cumsum(tokenizers.size_b[ids_b])
    cut = align(ends_a, ends_b)
    shared = cut.ends[cut.closes]
    group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
    link_a, link_b = ids_a[cut.owner_a[cut.closes]], ids_b[cut.owner_b[cut.closes]]
    # a text's last token ends at its end, so each text's intervals and links are a run
    stops = np.append(0, ends_a)[np.cumsum(n_a)]
    groups, overlaps = np.searchsorted(shared, stops, "right"), np.searchsorted(cut.ends, stops, "right")
    n_groups, n_overlaps = np.diff(np.append(0, groups)), np.diff(np.append(0, overlaps))
    link_text = np.repeat(np.arange(len(texts)), n_groups)
    return Batch(ids_a, ids_b, ends_a, ends_b, group_a, group_b, n_a, n_b, n_groups, n_overlaps, link_a, link_b, link_text, cut)


def group_texts(tokenizers: TwoTokenizers, batch: Batch) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each text: a group's A ids, then its B ids."""
    last_a, last_b = (np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool) for g in (batch.group_a, batch.group_b))
    size_a, size_b = np.bincount(batch.group_a), np.bincount(batch.group_b)
    parts = np.empty(len(batch.ids_a) + len(batch.ids_b), object)
    # before an A token stand the B tokens of earlier groups, before a B token the A tokens of its group and earlier ones
    parts[np.arange(len(batch.ids_a)) + (np.cumsum(size_b) - size_b)[batch.group_a]] = tokenizers.text_a[batch.ids_a + last_a * len(tokenizers.bytes_a)]
    parts[np.arange(len(batch.ids_b)) + np.cumsum(size_a)[batch.group_b]] = tokenizers.text_b[batch.ids_b + last_b * len(tokenizers.bytes_b)]
    listed, out, at = parts.tolist(), [], 0
    for n in (batch.n_a + batch.n_b).tolist():
        out.append(b"".join(listed[at : at + n])[:-1])
        at += n
    return out


_DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, n_products long, groups_sha256 string, pairs array<long>, times array<long>"


def _document_rows(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    release()
    both = two_tokenizers(path_a, path_b)
    width = len(both.bytes_b)
    for rows in batches:
        texts = [t or "" for t in rows.column(1).to_pylist()]
        for lo, hi in slices(texts, 1 << 18):
            x = batch_of(both, texts[lo:hi])
            code = x.link_a * width + x.link_b
            order = np.lexsort((code, x.link_text))
            code, owner = code[order], x.link_text[order]
            first = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])) if len(code) else np.zeros(0, bool))
            times = np.diff(np.append(first, len(code)))
            offsets = np.searchsorted(owner[first], np.arange(hi - lo + 1)).astype(np.int32)
            products = np.bincount(x.group_a) * np.bincount(x.group_b)
            running = np.append(0, np.cumsum(products))[np.append(0, np.cumsum(x.n_groups))]
            digests = [hashlib.sha256(g).hexdigest() if g else "" for g in group_texts(both, x)]
            arrays = [rows.column(0).slice(lo, hi - lo), *map(pa.array, (x.n_a, x.n_b, x.n_groups, x.n_groups, x.n_overlaps, np.diff(running))), pa.array(digests)]
            arrays += [pa.ListArray.from_arrays(pa.array(offsets), pa.array(v.astype(np.int64))) for v in (code[first], times)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_overlaps", "n_products", "groups_sha256", "pairs", "times"])


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def document_alignments(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row a document: tokens of either side, groups, links, overlaps, products, the groups' digest, and its linked pairs.

    A pair is ``A id * size of B + B id``, with the times it is linked here.  A text that is null, empty or that either
    tokenizer doesn't spell byte for byte with a space before it has no tokens: zeros and empty values.  Repeated rows
    give repeated rows, a null doc_id is kept, an empty table gives none, other columns are ignored.  A very long text
    is encoded in one piece; what is kept of it is no larger than the vocabularies.
    """
    return _rows(docs).mapInArrow(lambda b: _document_rows(b, path_a, path_b), _DOCUMENT)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best) over all documents: how many links hold the pair, and whether none of its B id's pairs has more."""
    width = F.lit(aligned.width)
    rows = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    counts = rows.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))
    counts = counts.withColumn("b", F.col("pair") % width)
    highest = counts.groupBy("b").agg(F.max("n").alias("highest"))
    return counts.join(highest, "b").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def _scored_rows(batches: Iterator[pa.RecordBatch], pairs: np.ndarray, n: np.ndarray, best: np.ndarray) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        listed, times = (rows.column(k).flatten().to_numpy(zero_copy_only=False) for k in ("pairs", "times"))
        ends = np.append(0, np.cumsum(rows.column("pairs").value_lengths().to_numpy(zero_copy_only=False)))
        at = np.searchsorted(pairs, listed)
        sums = [np.diff(np.append(0, np.cumsum(v))[ends]) for v in ((best[at] * times, n[at] * times) if len(listed) else (np.zeros(0, np.int64),) * 2)]
        kept = rows.select([c for c in rows.schema.names if c not in ("pairs", "times")])
        yield pa.RecordBatch.from_arrays([*kept.columns, *map(pa.array, sums)], names=[*kept.schema.names, "n_best", "count_sum"])


def alignments(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``document_alignments`` with ``n_best``, the links whose pair is the likeliest of its B id over all documents, and
    ``count_sum``, the sum of their pairs' counts; ties are all likeliest.  Defined for the same cases."""
    spark = docs.sparkSession
    aligned = stored(document_alignments(docs, path_a, path_b), "alignments")
    aligned.width = two_tokenizers(path_a, path_b).b.get_piece_size()
    counts = pair_counts(aligned).toArrow().sort_by("pair")  # bounded by the vocabularies, see above
    held = [counts.column(k).to_numpy() for k in ("pair", "n", "best")]
    shared = spark.sparkContext.broadcast((held[0], held[1], held[2].astype(np.int64)))
    out = aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_overlaps", "n_products", "groups_sha256", "pairs", "times")
    kind = _DOCUMENT.replace(", pairs array<long>, times array<long>", ", n_best long, count_sum long")
    return out.mapInArrow(lambda b: _scored_rows(b, *shared.value), kind)


def vocabulary_map(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(b_id, a_id, n, best): for each id of B the ids of A that end where it ends, with counts over all documents."""
    aligned = stored(document_alignments(docs, path_a, path_b).select("pairs", "times"), "alignments")
    aligned.width = two_tokenizers(path_a, path_b).b.get_piece_size()
    width = F.lit(aligned.width)
    out = stored(pair_counts(aligned).select((F.col("pair") % width).alias("b_id"), F.floor(F.col("pair") / width).alias("a_id"), "n", "best"), "vocabulary-map")
    forget(aligned)
    return out


def _group_rows(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    release()
    both = two_tokenizers(path_a, path_b)
    for rows in batches:
        texts = [t or "" for t in rows.column(1).to_pylist()]
        for lo, hi in slices(texts, 1 << 18):
            x = batch_of(both, texts[lo:hi])
            ends = x.aligned.ends[x.aligned.closes]
            first = np.append(0, np.cumsum(x.n_groups))[x.link_text]  # the first group of the group's text
            base = np.append(0, ends)[first]
            stops_a, stops_b = (np.append(0, np.cumsum(np.bincount(g, minlength=len(ends)))).astype(np.int32) for g in (x.group_a, x.group_b))
            arrays = [rows.column(0).slice(lo, hi - lo).take(pa.array(x.link_text)), pa.array(np.arange(len(ends)) - first), pa.array(np.append(0, ends)[:-1] - base if len(ends) else ends), pa.array(ends - base)]
            arrays += [pa.ListArray.from_arrays(pa.array(s), pa.array(v)) for s, v in ((stops_a, x.ids_a), (stops_b, x.ids_b))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "group", "start", "end", "a_ids", "b_ids"])


def token_groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row a group: doc_id, group from 0, its byte range in space + text, and the ids of either side, in order."""
    return _rows(docs).mapInArrow(lambda b: _group_rows(b, path_a, path_b), "doc_id long, group long, start long, end long, a_ids array<long>, b_ids array<long>")


def token_products(groups: DataFrame) -> DataFrame:
    """The groups' products: each A id of a group with each of its B ids."""
    return groups.select("doc_id", "group", F.explode("a_ids").alias("a_id"), "b_ids").select("doc_id", "group", "a_id", F.explode("b_ids").alias("b_id"))
