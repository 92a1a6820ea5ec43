"""Language identification by rank-order profiles of n-grams.

A profile lists a language's ``PROFILE`` most frequent runs of 1 to 3 characters, words with a space at
either end.  A document is ranked likewise over its whole text, and each of its n-grams is out of place by
the distance of its two ranks, or by PROFILE where the language's profile lacks it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_id
from .tokens import give_back, release, slices

#: N-grams of a profile.
PROFILE = 400
UNKNOWN = "und"
#: Letters at which a text's length counts as another class, and learning rows that a class needs to have its own limit.
LENGTHS, ENOUGH = (50, 100, 300, 1000), 100
#: Characters that are counted at once: their n-grams take some hundred bytes each, in every worker.
SLICE = 1 << 18
_B = 0x110000
_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(_B)), bool, _B)
    return _LETTER


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, count) of all n-grams, sorted by text and key, and (alphabet, texts' numbers of letters)."""
    codes = np.frombuffer(" ".join(["", *[t.lower() for t in texts], ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.array([len(t.lower()) + 1 for t in texts], np.int64)
    who = np.append(np.repeat(np.arange(len(texts)), sizes), [len(texts)] * 2)[: len(codes)] if texts else np.zeros(0, np.int64)
    who = np.append([0], who)[: len(codes)]
    codes = np.where(_letters()[codes], codes, 0)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)  # one space between words
    codes, who = codes[keep], np.minimum(who[keep], max(0, len(texts) - 1))
    alphabet, c = np.unique(np.append(codes, 0), return_inverse=True)
    c, a = c[:-1].astype(np.int64), len(alphabet)
    one = c != 0
    letters = np.bincount(who[one], minlength=len(texts))
    cells = a**3
    unit = np.int64(3 * cells)
    # a gram belongs to the text of its letters: the space before the first word counts to that word's text
    parts = [who[one] * unit + c[one]]
    lead, trail = c[:-1], c[1:]
    owner = np.where(lead != 0, who[:-1], who[1:])
    two = (lead != 0) | (trail != 0)
    parts.append((owner * unit + cells + lead * a + trail)[two])
    if len(c) > 2:
        three = c[1:-1] != 0
        parts.append((who[1:-1] * unit + 2 * cells + (c[:-2] * a + c[1:-1]) * a + c[2:])[three])
    flat = np.sort(np.concatenate(parts))
    first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(flat)))
    flat = flat[first]
    return flat // unit, flat % unit, counts, alphabet.astype(np.int64), letters


def _global_keys(key: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """The n-gram as a number that does not depend on the texts around it, in the order of code points."""
    a = len(alphabet)
    order, rest = key // a**3, key % a**3
    return ((order * _B + alphabet[rest // a**2]) * _B + alphabet[rest // a % a]) * _B + alphabet[rest % a]


def ranked(texts: list[str], size: int = PROFILE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, rank, key) of each text's most frequent n-grams, ties by the n-gram; and the texts' numbers of letters."""
    who, key, counts, alphabet, letters = _grams(texts)
    starts = np.flatnonzero(np.append(True, who[1:] != who[:-1])) if len(who) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(who)))
    place = np.arange(len(who)) - np.repeat(starts, sizes)
    if counts.max(initial=0) < 1 << 20 and sizes.max(initial=0) < 1 << 23:
        packed = np.sort((((who << 20) | ((1 << 20) - 1 - counts)) << 23) | place)
        by, place = packed >> 43, packed & ((1 << 23) - 1)
    else:  # the same order for numbers that don't fit beside each other
        order = np.lexsort((place, -counts, who))
        by, place = who[order], place[order]
    rank = np.arange(len(who)) - np.repeat(starts, sizes)
    top = rank < size
    text, place = by[top], place[top]
    first = np.zeros(len(texts) + 1, np.int64)
    first[who[starts]] = starts
    return text, rank[top], _global_keys(key[first[text] + place], alphabet), letters


class Profiles:
    """Ranks of n-grams by language; languages in the order of their names."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int = PROFILE):
        self.size = size
        self.languages = sorted({r[0] for r in rows})
        self.keys = np.unique(np.array([r[1] for r in rows], np.int64))
        self.ranks = np.full((len(self.keys) + 1, len(self.languages)), -1, np.int64)
        place = {l: i for i, l in enumerate(self.languages)}
        for language, key, rank in rows:
            self.ranks[np.searchsorted(self.keys, key), place[language]] = rank

    def predict(self, texts: list[str]) -> list[tuple[str, float, float]]:
        """(language, score, distance): score is d2 / (d1 + d2) of the two smallest distances; distance d1 is from 0 to 1."""
        return [found[:3] for found in self.measured(texts)]

    def measured(self, texts: list[str]) -> list[tuple[str, float, float, int]]:
        """What ``predict`` finds, and the class of the text's number of letters."""
        out = [(UNKNOWN, 0.0, 1.0, 0)] * len(texts)
        if not self.languages or not texts:
            return out
        text, rank, key, letters = ranked(texts, self.size)
        at = np.searchsorted(self.keys, key)
        at = np.where((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == key), at, len(self.keys))
        theirs = self.ranks[at]
        apart = np.where(theirs < 0, self.size, np.abs(theirs - rank[:, None]))
        starts = np.flatnonzero(np.append(True, text[1:] != text[:-1])) if len(text) else np.zeros(0, np.int64)
        if not len(starts):
            return out
        total = np.add.reduceat(apart, starts, axis=0) / (np.diff(np.append(starts, len(text))) * float(self.size))[:, None]
        order = np.argsort(total, axis=1, kind="stable")
        for k, i in enumerate(text[starts].tolist()):
            if letters[i]:
                d1 = float(total[k, order[k, 0]])
                d2 = float(total[k, order[k, 1]]) if len(self.languages) > 1 else 1.0
                out[i] = (self.languages[order[k, 0]], d2 / (d1 + d2) if d1 + d2 else 0.5, d1, int(np.searchsorted(LENGTHS, letters[i], side="right")))
        return out


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that nothing is learned from; a null id is not held out, and nothing is learned from it either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i, j in slices(texts, SLICE):
            by: dict[str, list[str]] = {}
            for l, t in zip(langs[i:j], texts[i:j], strict=True):
                by.setdefault(l, []).append(t)
            for l, group in by.items():
                _, key, counts, alphabet, _ = _grams([" ".join(group)])
                yield pa.RecordBatch.from_arrays([pa.array([l] * len(key)), pa.array(_global_keys(key, alphabet), pa.int64()), pa.array(counts, pa.int64())], names=["lang", "key", "n"])
    give_back()


def learning_rows(docs: DataFrame) -> DataFrame:
    """(lang, text) of all rows that are learned from: not held out, with an id, a language and a text."""
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.filter(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")


def learn(docs: DataFrame, size: int = PROFILE) -> Profiles:
    """Profiles from the text and non-null lang of all rows that are not held out.

    N-grams are counted over all of them; the profiles, ``size`` rows a language, reach the driver.  Null texts and ids teach nothing.
    """
    totals = learning_rows(docs).mapInArrow(_count_rows, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "key")
    top = totals.withColumn("rank", F.row_number().over(best) - 1).filter(F.col("rank") < size)
    return Profiles([(r["lang"], r["key"], r["rank"]) for r in top.collect()], size)


def _predicted_rows(batches: Iterator[pa.RecordBatch], profiles: Profiles) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
        found: list[tuple[str, float, float]] = []
        for i, j in slices(texts, SLICE):
            found += profiles.predict(texts[i:j])
        columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch.num_columns - 1)), *columns], names=["doc_id", "held_out", "tie", "lang_pred", "score", "distance"])


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """(doc_id, held_out, tie, lang_pred, score, distance) of every row; ``und`` with score 0 where no letter is."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    return rows.select("doc_id", "held_out", row_id("text").alias("tie"), "text").mapInArrow(lambda b: _predicted_rows(b, shared.value), "doc_id long, held_out boolean, tie long, lang_pred string, score double, distance double")


def _distance_rows(batches: Iterator[pa.RecordBatch], profiles: Profiles) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for i, j in slices(texts, SLICE):
            found = [(kind, d) for language, _, d, kind in profiles.measured(texts[i:j]) if language != UNKNOWN]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([d for _, d in found], pa.float64())], names=["kind", "distance"])
    give_back()


def limits(docs: DataFrame, profiles: Profiles) -> list[float]:
    """The largest distance that counts as a learned language, for each class of lengths.

    It lies as far beyond the 99th percentile of all learning rows' distances as that lies beyond their median; distances are
    counted to five digits first, so that what is sorted is bounded.  A class of fewer than ENOUGH learning rows takes the limit of all.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    rows = learning_rows(docs).select("text").mapInArrow(lambda b: _distance_rows(b, shared.value), "kind int, distance double")
    per = rows.groupBy("kind", F.round("distance", 5).alias("distance")).agg(F.count(F.lit(1)).alias("n"))
    found = per.rollup("kind").agg(F.sum("n").alias("n"), F.percentile("distance", F.lit(0.5), F.col("n")).alias("middle"), F.percentile("distance", F.lit(0.99), F.col("n")).alias("far")).collect()
    far = {r["kind"]: 2 * r["far"] - r["middle"] for r in found if r["n"] >= ENOUGH or (r["kind"] is None and r["n"])}
    return [far.get(k, far.get(None, 0.0)) for k in range(len(LENGTHS) + 1)]


def _accepted_rows(batches: Iterator[pa.RecordBatch], profiles: Profiles, farthest: list[float], column: int) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        texts = [t or "" for t in batch.column(column).to_pylist()]
        keep: list[bool] = []
        for i, j in slices(texts, SLICE):
            keep += [language != UNKNOWN and distance <= farthest[kind] for language, _, distance, kind in profiles.measured(texts[i:j])]
        yield batch.filter(pa.array(keep, pa.bool_()))
    give_back()


def with_language(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """The documents, all columns, whose text has a letter and lies within the ``limits`` of some profile."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    column, farthest = docs.columns.index("text"), limits(docs, profiles)
    return docs.mapInArrow(lambda b: _accepted_rows(b, shared.value, farthest, column), docs.schema)
