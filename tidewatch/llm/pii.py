"""Personal data by candidate gradient boosting: base rules, high-recall proposals, boosted trees, calibrated thresholds.

Base rules find e-mail addresses, IP addresses, card and phone numbers in their plain forms; their spans always stay.
Generators propose whatever may be one of these in another form (``(at)``, ``[.]``, other separators, no plus sign),
overlapping and far too often.  Boosted trees judge a proposal by its format and by what stands around it.

Nobody has labelled such spans, so labels come from the rules: a base span of a learning document, rewritten into one
of ``DISGUISES`` where it stands, is an example; what the generators propose beside base spans in those documents, and
written-in ``DECOYS``, are counterexamples.  A third fold calibrates: scores become probabilities by a logistic
curve, and a kind's threshold is where at most ``FALSE_SHARE`` of its counterexamples pass and the probability is
``SURE`` or more.  A kind with fewer than ``LEAST`` examples adds nothing.

All windows of all documents are learned from.  They stay in a written table: cuts, trees, curve and thresholds come
from sums over it by cells, whose number is fixed by the features' range and the trees' shape, whatever the input.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored
from .tokens import release

KINDS = ("email", "ip", "card", "phone")
#: Characters before and after a span that are looked at.
BEFORE, AFTER = 40, 12
LEAST, SURE, FALSE_SHARE = 50, 0.9, 0.001
#: Features are whole numbers below VALUES and cut into BINS; derivatives are summed as whole multiples of 1 / SCALE.
VALUES, BINS, SCALE = 256, 32, 1 << 24
#: Margins are told apart by steps of 1 / GRAIN up to REACH on either side.
GRAIN, REACH = 1024, 32
#: Different examples that a task sums over.
TASK_ROWS = 50_000

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+){3,}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){13,}")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


class Span(NamedTuple):
    start: int
    kind: int
    end: int


def luhn(digits: str) -> bool:
    """Whether the check digit is right: from the right every second digit counts double, in its digits."""
    twice = sum(map(int, digits[-1::-2])) + sum(int(d) * 2 - 9 * (d > "4") for d in digits[-2::-2])
    return twice % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """The base rules' spans in order, each kind leftmost and without overlap, in time linear in the text.

    An address's local part is the run of its characters up to an @ that a domain follows; no @ is in either, so each @
    is judged by itself.  Addresses of numbers are the consecutive fours of a dotted run.  Runs that fail are dropped.
    """
    out, low = [], 0
    for m in _DOMAIN.finditer(text):
        head = text[low : m.start()]
        start = low + len(head.rstrip(LOCAL))
        if start < m.start():
            out.append(Span(start, 0, m.end()))
        low = m.end() if start < m.start() else m.start() + 1
    if _DIGIT.search(text):
        for m in _NUMBERS.finditer(text):
            parts, at = m.group().split("."), m.start()
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                end = at + sum(map(len, four)) + 3
                if all(map(_octet, four)):
                    out.append(Span(at, 1, end))
                at = end + 1
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if len(digits) <= 19 and luhn(digits):
                out.append(Span(m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGIT.findall(m.group())) <= 15:
                    out.append(Span(m.start(), 3, m.end()))
    return sorted(out)


# What the generators look for.  Each repetition is bounded or deterministic, so a text is read in linear time.
_AT = re.compile(r"\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?|\sat\s|\s?@\s?", re.I)
_DOTTED = re.compile(r"[a-z0-9-]{1,63}(?:(?:\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\sdot\s|\.)[a-z0-9-]{1,63}){1,8}", re.I)
_OCTETS = re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\sdot\s|\s?[.,:_-]\s?)[0-9]{1,3}){3}(?![0-9])", re.I)
_SIX = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_TIGHT = re.compile(r"[+(]{0,2}[0-9](?:[\s().\-/_–]?[0-9])+")
_LOOSE = re.compile(r"[+(]{0,2}[0-9](?:[\s().\-/_–]{0,3}[0-9])+")


def proposals(text: str) -> list[Span]:
    """Spans that may be personal data; they overlap, and most are none."""
    found, low = set(), 0
    for m in _AT.finditer(text):
        domain = _DOTTED.match(text, m.end())
        head = text[max(low, m.start() - 64) : m.start()]
        start = m.start() - len(head) + len(head.rstrip(LOCAL))
        if domain and start < m.start():
            found.add(Span(start, 0, domain.end()))
        low = m.end()
    if _DIGIT.search(text):
        for pattern in (_OCTETS, _SIX):
            found.update(Span(m.start(), 1, m.end()) for m in pattern.finditer(text))
        for pattern in (_TIGHT, _LOOSE):
            for m in pattern.finditer(text):
                n = len(_DIGIT.findall(m.group()[:80]))
                if 13 <= n <= 20:
                    found.add(Span(m.start(), 2, m.end()))
                if 7 <= n <= 16:
                    found.add(Span(m.start(), 3, m.end()))
    return sorted(found)


def apart_from(spans: list[Span], base: list[Span]) -> list[Span]:
    """The spans that no base span overlaps."""
    reach, top = [], -1
    for b in base:
        top = max(top, b.end)
        reach.append(top)
    starts = [b.start for b in base]
    out = []
    for s in spans:
        k = bisect.bisect_left(starts, s.end)
        if not k or reach[k - 1] <= s.start:
            out.append(s)
    return out


_HINTS = [re.compile(x, re.I) for x in (r"mail|contact|write|mél|correo|schreib", r"\bip\b|host|server|addr|ping|adress|direcc", r"card|visa|master|amex|pay|karte|carte|tarjeta", r"phone|tel|call|mobil|fax|cell|ruf|appel|llam", r"version|release|\bv$|isbn|order|date|page|total|token|password|hash|\bno\.? ?$|\bid\b|[=\"#$€]\s?$")]
_RUNS = re.compile("[0-9]+")
_MARKED = re.compile(r"[\[({<]\s?(?:at|@|dot|\.)\s?[\])}>]|\s(?:at|dot)\s", re.I)


def features(text: str, span: Span) -> list[float]:
    """Numbers that say how a span is written and what stands around it."""
    body, before, after = text[span.start : span.end][:160], text[max(0, span.start - BEFORE) : span.start], text[span.end : span.end + AFTER]
    runs = _RUNS.findall(body)
    sizes = [len(r) for r in runs] or [0]
    digits = "".join(runs)
    marks = [c for c in body if not c.isalnum()]
    kinds = set(marks)
    side = lambda c: 0 if not c or c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3
    labels = re.split(r"[^A-Za-z0-9-]+", body)
    return [
        *[float(span.kind == k) for k in range(len(KINDS))],
        len(body), len(digits), len(runs), max(sizes), min(sizes), sizes[0], sizes[-1], len(set(sizes)),
        sum(c.isalpha() for c in body), len(marks), len(kinds), sum(c.isspace() for c in marks), marks.count("."), marks.count(","), marks.count(":"), marks.count("-"), sum(c in "()[]{}<>" for c in marks),
        float(len(runs) == 4 and all(map(_octet, runs))), float(bool(digits) and luhn(digits[:40])), float(body[:1] == "+"), float(digits[:2] == "00"), float("@" in body), len(_MARKED.findall(body)), len(labels[-1]),
        side(before[-1:]), side(after[:1]), float(after[:1] in ".,;:!?)" and side(after[1:2]) == 0),
        *[float(bool(h.search(before[-24:]))) for h in _HINTS],
    ]


class Trees(NamedTuple):
    """Boosted trees of one depth, one a round and kind: a feature and cut for each inner node, heap order, and leaf values."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        out, kind = np.zeros(len(x)), x[:, : len(KINDS)].argmax(1)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            out += leaf[kind, _place(x, kind, feature, cut, leaf.shape[1].bit_length() - 1)]
        return np.clip(np.rint(out * GRAIN) / GRAIN, -REACH, REACH)


def _place(x: np.ndarray, kind: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """Which node of the level ``depth`` each row comes to, from the left."""
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range(depth):
        at = 2 * at + 1 + (x[rows, feature[kind, at]] > cut[kind, at])
    return at - (2**depth - 1)


Cells = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _sums(rows: DataFrame, cells: Cells, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers of each of ``size`` cells, added over all examples; ``cells`` gives (cell, one, other) of (features, n, positives).

    They are whole, so that their sums don't depend on the order.
    """

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, other = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                at, a, b = cells(x, batch.column(1).to_numpy(), batch.column(2).to_numpy())
                one += np.bincount(at.ravel(), a.ravel(), size).astype(np.int64)
                other += np.bincount(at.ravel(), b.ravel(), size).astype(np.int64)
        own = np.flatnonzero((one != 0) | (other != 0))
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(one[own]), pa.array(other[own])], names=["cell", "one", "other"])

    found = rows.select("x", "n", "positives").mapInArrow(added, "cell long, one long, other long").groupBy("cell").agg(F.sum("one").alias("one"), F.sum("other").alias("other")).toArrow()
    out = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for name, full in zip(("one", "other"), out, strict=True):
        full[found["cell"].to_numpy()] = found[name].to_numpy()
    return out


def _values(x: np.ndarray, n: np.ndarray, positives: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By feature and value: examples and positive ones."""
    return x + VALUES * np.arange(x.shape[1]), *(np.repeat(v, x.shape[1]) for v in (n, positives))


def _derivatives(x: np.ndarray, n: np.ndarray, positives: np.ndarray, trees: Trees, feature: np.ndarray, cut: np.ndarray, level: int, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By kind, node of the level, feature and bin: first and second derivatives of the logistic loss."""
    kind = x[:, : len(KINDS)].argmax(1)
    p = 1 / (1 + np.exp(-trees.margins(x)))
    g, h = SCALE * positives - n * np.rint(SCALE * p), n * np.rint(SCALE * p * (1 - p))
    j = np.arange(x.shape[1])
    node = (kind << level) + _place(x, kind, feature, cut, level)
    return (node[:, None] * len(j) + j) * BINS + bins[j, x], *(np.repeat(v, len(j)) for v in (g, h))


def _margins(x: np.ndarray, n: np.ndarray, positives: np.ndarray, trees: Trees) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By kind and margin: examples and positive ones."""
    step = np.rint(GRAIN * (trees.margins(x) + REACH)).astype(np.int64)
    return x[:, : len(KINDS)].argmax(1) * (2 * GRAIN * REACH + 1) + step, n, positives


def boost(rows: DataFrame, counts: np.ndarray, rounds: int = 20, depth: int = 4, rate: float = 0.4, ridge: float = 2.0, least: float = 2.0) -> Trees:
    """Newton boosting of the logistic loss, for each kind apart, by sums over at most ``BINS`` bins a feature; equal gains take the first cut.

    ``counts`` says how many of the rows have each value of each feature; cuts are its quantiles.  A level of a round's
    trees, of all kinds, is one aggregate over all rows.
    """
    many = counts[0].sum()
    ranks = np.floor(np.linspace(0, 1, BINS + 1)[1:-1] * (many - 1))
    edges = [np.unique(np.searchsorted(c.cumsum(), ranks, "right")) for c in counts]
    bins = np.array([np.searchsorted(e, np.arange(VALUES)) for e in edges])  # bin k: edges[k - 1] < value <= edges[k]
    width, kinds, inner = len(edges), len(KINDS), 2**depth - 1
    trees = Trees(np.zeros((0, kinds, inner), np.int64), np.zeros((0, kinds, inner)), np.zeros((0, kinds, inner + 1)))
    for _ in range(rounds):
        feature, cut = np.zeros((kinds, inner), np.int64), np.full((kinds, inner), np.inf)  # a node without a gain sends all to the left
        leaf = np.zeros((kinds, inner + 1))
        for level in range(depth):
            cells = functools.partial(_derivatives, trees=trees, feature=feature, cut=cut, level=level, bins=bins)
            sums = _sums(rows, cells, (kinds << level) * width * BINS)
            gs, hs = (v.reshape(kinds << level, width, BINS).cumsum(2) / SCALE for v in sums)
            total_g, total_h = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + ridge) + (total_g - gs) ** 2 / (total_h - hs + ridge) - total_g**2 / (total_h + ridge)
            gain[(hs < least) | (total_h - hs < least)] = 0
            for node, own in enumerate(gain.reshape(len(gain), -1)):
                kind, place = divmod(node, 1 << level)
                j, k = divmod(int(own.argmax()), BINS)
                split = own[j * BINS + k] > 1e-9
                if split:
                    at = (1 << level) - 1 + place
                    feature[kind, at], cut[kind, at] = j, edges[j][k]
                if level == depth - 1:
                    g, h = np.array([gs[node, 0, -1], 0.0]), np.array([hs[node, 0, -1], 0.0])
                    if split:
                        g, h = np.array([gs[node, j, k], g[0] - gs[node, j, k]]), np.array([hs[node, j, k], h[0] - hs[node, j, k]])
                    leaf[kind, 2 * place : 2 * place + 2] = rate * g / (h + ridge)
            if np.isinf(cut).all():
                return trees  # no kind gains by any cut
        trees = Trees(*(np.concatenate([old, new[None]]) for old, new in zip(trees, (feature, cut, leaf), strict=True)))
    return trees


class Model(NamedTuple):
    """Trees, the logistic curve over their margins, and each kind's threshold; above 1 it adds nothing."""

    trees: Trees | None
    slope: float
    offset: float
    thresholds: tuple[float, ...]

    def of(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * margins + self.offset)))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self.of(self.trees.margins(x))


#: Ways to write what the base rules find otherwise: (between the parts of a name and its domain, or of a number).
DISGUISES = {
    "email": [(" at ", " dot "), ("(at)", "."), (" (at) ", " (dot) "), (" [at] ", "."), ("[at]", "[dot]"), (" @ ", "."), ("{at}", "."), (" AT ", " DOT "), ("@", "[.]"), ("@", " dot ")],
    "ip": ["[.]", "(.)", " dot ", " . ", "[dot]", " [.] "],
    "card": [".", "/", "_", "  ", " - ", " / "],
    "phone": ["({1}) {2}-{3}", "{0}-{1}-{2}-{3}", "00{0} {1} {2} {3}", "{1}.{2}.{3}", "+{0}/{1}/{2}/{3}", "{1}-{2}-{3}", "00{0}-{1}-{2}{3}", "+{0} – {1} – {2} – {3}"],
}
#: What is like personal data and isn't.  9 stands for a digit, 0 in front of a number for a check digit that is wrong.
DECOYS = ["9999-99-99", "99.99.9999", "99:99:99", "9999-99-99 99:99", "ISBN 999-9-99-999999-9", "order 9999-9999-99", "999,999,999", "9.999.999,99", "$ 9,999.99", "9999-9999", "99 9 999 99", "9, 9, 99, 9", "999[.]999[.]999[.]999", "99999999999999", "no. 99999999", "page 99-999", "look at this. Then", "it is at home. We", "at 99.9", "arrived at gate dot", "0x99999999", "999-99-99-9", "9.9.9", "token 9999999999", "id 999999999999"]


def disguised(rng: np.random.Generator, kind: str, body: str) -> str | None:
    """A base span's text in another form; None where it has no parts to write otherwise."""
    ways = DISGUISES[kind]
    way = ways[int(rng.integers(len(ways)))]
    if kind == "email":
        name, domain = body.split("@", 1)
        return name + way[0] + domain.replace(".", way[1])
    if kind == "ip":
        return body.replace(".", way)
    digits = "".join(_RUNS.findall(body))
    if kind == "card":
        return way.join(digits[k : k + 4] for k in range(0, len(digits), 4))
    if len(digits) < 11:
        return None
    return way.format(digits[:-10], digits[-10:-7], digits[-7:-4], digits[-4:])


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each base span, and of each proposal beside them, the span with its surroundings."""
    release()
    for batch in batches:
        rows = []
        for text in batch.column(0).to_pylist():
            base = base_spans(text or "")
            other = apart_from(proposals(text or ""), base)
            for known, spans in ((True, base), (False, other)):
                for s in spans:
                    low, body = max(0, s.start - BEFORE), text[s.start : s.end]
                    if len(body) <= 200:
                        rows.append((known, s.kind, text[low : s.start], body, text[s.end : s.end + AFTER]))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.bool_(), pa.int32(), pa.string(), pa.string(), pa.string()), strict=True)], names=["known", "kind", "before", "body", "after"])


def examples(windows: list[tuple[bool, int, str, str, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, label, kind, whether it calibrates) of all examples and counterexamples; draws depend on the window only."""
    x, y, kinds, later = [], [], [], []

    def add(text: str, span: Span, label: bool, fold: bool) -> None:
        x.append(features(text, span)), y.append(label), kinds.append(span.kind), later.append(fold)

    for known, kind, before, body, after in windows:
        seed = xxhash.xxh64_intdigest(body, 7)
        rng, fold = np.random.default_rng(seed), seed % 4 == 3
        if not known:
            add(before + body + after, Span(len(before), kind, len(before) + len(body)), False, fold)
            continue
        decoy = "".join(str(rng.integers(10)) if c == "9" else c for c in DECOYS[int(rng.integers(len(DECOYS)))])
        for s in proposals(before + decoy + after):
            if s.start < len(before) + len(decoy) and s.end > len(before) and not base_spans(decoy):
                add(before + decoy + after, s, False, fold)
        new = disguised(rng, KINDS[kind], body)
        if new is None:
            continue
        text, low, high = before + new + after, len(before), len(before) + len(new)
        for s in apart_from(proposals(text), base_spans(text)):
            if s.start < high and s.end > low:  # all of it and nothing else, as the same kind
                add(text, s, s.kind == kind and (s.start, s.end) == (low, high), fold)
    return np.array(x, float).reshape(len(x), -1 if x else 0), np.array(y, float), np.array(kinds, int), np.array(later, bool)


def _example_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of windows the examples: whether it calibrates, features as bytes, and whether it is a positive one."""
    release()
    for batch in batches:
        x, y, _, later = examples(list(zip(*(c.to_pylist() for c in batch.columns), strict=True)))
        columns = [pa.array(later, pa.bool_()), pa.array([r.tobytes() for r in x.astype(np.uint8)], pa.binary()), pa.array(y.astype(np.int64), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["later", "x", "positive"])


def fitted(rows: DataFrame) -> Model:
    """The model of all rows (later, x, n, positives), a written table; trees from those that aren't later, the rest from those that are."""
    few = 1 + rows.count() // TASK_ROWS  # each task gives its own sums of cells
    learning, later = rows.filter("not later").coalesce(few), rows.filter("later").coalesce(few)
    width = len(features("1", Span(0, 0, 1)))
    counts, good = (v.reshape(width, VALUES) for v in _sums(learning, _values, width * VALUES))
    right = good[: len(KINDS), 1]
    nothing = Model(None, 1.0, 0.0, (2.0,) * len(KINDS))
    if right.sum() < LEAST or (later.agg(F.sum("positives")).first()[0] or 0) < 1:
        return nothing
    trees = boost(learning, counts)
    if not len(trees.leaf):
        return nothing
    steps = 2 * GRAIN * REACH + 1
    n, true = (v.reshape(len(KINDS), steps) for v in _sums(later, functools.partial(_margins, trees=trees), len(KINDS) * steps))
    all_n, all_true, margin = n.sum(0), true.sum(0), np.arange(steps) / GRAIN - REACH
    slope, offset = 1.0, 0.0
    for _ in range(30):  # Newton steps of a logistic curve, with a weak pull to the margins themselves
        p = 1 / (1 + np.exp(-(slope * margin + offset)))
        w, miss = all_n * p * (1 - p), all_true - all_n * p
        grad = np.array([np.sum(miss * margin) - (slope - 1), np.sum(miss) - offset])
        curve = np.array([[np.sum(w * margin**2) + 1, np.sum(w * margin)], [np.sum(w * margin), np.sum(w) + 1]])
        slope, offset = np.array([slope, offset]) + np.linalg.solve(curve, grad)
    model, thresholds = Model(trees, float(slope), float(offset), ()), []
    p = model.of(margin)
    falling = np.argsort(-p, kind="stable")
    for k in range(len(KINDS)):
        passed = (n[k] - true[k])[falling].cumsum()
        allowed = int(FALSE_SHARE * passed[-1])  # as many counterexamples may pass
        level = float(p[falling[np.searchsorted(passed, allowed, "right")]]) if allowed < passed[-1] else 0.0
        thresholds.append(max(SURE, np.nextafter(level, 1.0)) if right[k] >= LEAST else 2.0)
    return model._replace(thresholds=tuple(thresholds))


def learn(docs: DataFrame) -> Model:
    """A model from all of the documents' own base spans and proposals; sums by cells reach the driver, no window does.

    Windows that occur often count once.  Rows with null or empty text give none; an empty table gives a model that adds
    nothing.
    """
    windows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_window_rows, "known boolean, kind int, before string, body string, after string").distinct()
    each = windows.mapInArrow(_example_rows, "later boolean, x binary, positive long")
    rows = stored(each.groupBy("later", "x").agg(F.count(F.lit(1)).alias("n"), F.sum("positive").alias("positives")), "examples")
    model = fitted(rows)
    forget(rows)
    return model


def all_spans(text: str, model: Model) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans): of proposals apart from base spans those above their threshold, the surest first, none overlapping."""
    base = base_spans(text)
    if model.trees is None:
        return base, base
    found = apart_from(proposals(text), base)
    if not found:
        return base, base
    sure = model.probabilities(np.array([features(text, s) for s in found])) - np.array(model.thresholds)[[s.kind for s in found]]
    chosen: list[Span] = []
    for i in sorted(np.flatnonzero(sure >= 0).tolist(), key=lambda i: (-sure[i], found[i].start - found[i].end, found[i])):
        at = bisect.bisect_left(chosen, found[i])
        if (not at or chosen[at - 1].end <= found[i].start) and (at == len(chosen) or found[i].end <= chosen[at].start):
            chosen.insert(at, found[i])
    return base, sorted(base + chosen)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in spans)


def _span_rows(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        found = [all_spans(t or "", model) for t in batch.column(1).to_pylist()]
        counts = [pa.array([sum(s.kind == k for s in base) for base, _ in found], pa.int64()) for k in range(len(KINDS))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array([hashlib.sha256(listed(b).encode()).hexdigest() for b, _ in found], pa.string()), pa.array([listed(a) for _, a in found], pa.string())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])


def personal_data(docs: DataFrame, model: Model) -> DataFrame:
    """One row a document: how many base spans of each kind, their digest, and all spans as ``kind:start:end``.

    Null and empty texts have none; repeated rows give repeated rows, a null doc_id is kept, an empty table gives no row,
    other columns are ignored.  A very long text is read whole, in linear time; of equally sure proposals that overlap the
    longer stays, then the first.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some hundred kilobytes, whatever the input
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda b: _span_rows(b, shared.value), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def _redacted_rows(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        out = []
        for text in batch.column(1).to_pylist():
            parts, at = [], 0
            for s in all_spans(text or "", model)[1]:
                if s.end > at:  # base spans of two kinds may overlap
                    parts += [(text[at : s.start]), f"[{KINDS[s.kind].upper()}]"] if s.start >= at else []
                    at = s.end
            out.append(None if text is None else "".join([*parts, text[at:]]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])


def redacted(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) with every span replaced by its kind in brackets; overlapping spans by the first's.  Null stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda b: _redacted_rows(b, shared.value), "doc_id long, text string")
