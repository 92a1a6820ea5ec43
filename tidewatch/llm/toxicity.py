"""Toxicity by a subsequence string kernel with Nyström landmarks and a linear support vector machine.

The kernel of two words counts the subsequences of three characters that they share, gaps of up to two
characters between neighbours, each weighed by ``DECAY`` to the number of characters skipped; it is
normalized and raised to each of ``POWERS``, and the results are added: a low power forgives gaps and
inserted characters, a high one keeps the many clean words of a sentence from adding up.  The kernel of two sentences is the sum over
their distinct words.  Landmarks are words of the training sentences, drawn by weighted k-means++ in the kernel's own
distance.  The linear machine works on the Nyström features K_mm^(-1/2) k(x) of a sentence.  Labels are those
of texts, so a toxic text is a bag: its sentences count as toxic where the machine itself finds them so.  A text scores by the machine's decisions for its ``TOP`` highest sentences: a logistic
curve over them, since a chance likeness comes alone where an insulting text insults again.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_id, stored
from .langid import held_out
from .tokens import slices

#: The kernel: weight of a skipped character, powers of the normalized kernel, characters of a word looked at at once.
DECAY, POWERS, PIECE = 0.8, (3,), 32
#: Words of a sentence that has no end mark, after which it is cut.
LONGEST = 24
#: The training sample: characters of text and sentences of either label; words that landmarks are drawn from; landmarks of either side.
TRAIN_CHARS, TRAIN_SENTENCES, CANDIDATES, LANDMARKS = 3_000_000, 15_000, 3_000, 160
#: Sentences that a text is judged by.
TOP = 3
#: How much more the clean sentences near the line weigh in training, the weight of the machine's norm, and that of
#: a toxic text's hidden form beside its plain one in the curve.
HARD, RIDGE, HIDDEN = 20.0, 5e-4, 0.1
#: Rounds in which a toxic text's sentences are chosen anew; of them those in which its highest one always counts.
ROUNDS, FORCED = 5, 2
_ENDS = (".", "!", "?", "…")
_NOT_LETTER = re.compile(r"[\W\d_]+")
_BITS = 12


def unit(token: str) -> str:
    """A token's letters, lower-cased: what stands between them is gone."""
    return _NOT_LETTER.sub("", token).lower()


def pieces(word: str) -> list[str]:
    """A long unit in overlapping parts of PIECE characters; a short one whole."""
    return [word] if len(word) <= PIECE else [word[k : k + PIECE] for k in range(0, len(word) - PIECE // 2, PIECE // 2)]


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")


def _subsequences(words: list[str], alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence, weight) of words, each at most PIECE characters, with a mark at either end; sorted, summed.

    A subsequence is three numbers of characters: those of ``alphabet`` by their place in it, others by their
    place among the others of these words, beyond all of the alphabet's.
    """
    n = len(words)
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    width = int(lengths.max(initial=2))
    c = np.zeros((n, width + 4), np.int64)
    flat = _codes(words)
    place = np.searchsorted(alphabet, flat)
    known = alphabet[np.minimum(place, len(alphabet) - 1)] == flat if len(alphabet) else np.zeros(len(flat), bool)
    others = np.unique(flat[~known])
    code = np.where(known, place, len(alphabet) + np.searchsorted(others, flat)) + 3
    if len(alphabet) + len(others) + 3 >= 1 << _BITS:
        if n == 1:
            raise ValueError("too many characters in the landmarks")
        a, b = _subsequences(words[: n // 2], alphabet), _subsequences(words[n // 2 :], alphabet)
        return np.concatenate([a[0], b[0] + n // 2]), np.concatenate([a[1], b[1]]), np.concatenate([a[2], b[2]])
    rows = np.repeat(np.arange(n), lengths - 2)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths - 2) - (lengths - 2), lengths - 2)
    c[rows, at + 1] = code
    c[:, 0] = 1
    c[np.arange(n), lengths - 1] = 2
    keys = []
    for g1 in (1, 2, 3):
        for g2 in (1, 2, 3):
            m = width + 4 - g1 - g2
            if m <= 0:
                continue
            a, b, d = c[:, :m], c[:, g1 : g1 + m], c[:, g1 + g2 : g1 + g2 + m]
            r, k = np.nonzero(d)
            ok = (a[r, k] != 0) & (b[r, k] != 0)
            r, k = r[ok], k[ok]
            keys.append((((((r << _BITS) | a[r, k]) << _BITS | b[r, k]) << _BITS | d[r, k]) << 3) | (g1 + g2 - 2))
    key = np.sort(np.concatenate(keys))
    weight = (DECAY ** np.arange(8))[key & 7]
    key >>= 3
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    weight = np.add.reduceat(weight, first) if len(first) else weight
    key = key[first]
    return key >> 3 * _BITS, key & ((1 << 3 * _BITS) - 1), weight


class Kernel:
    """Normalized kernel values of words against fixed landmarks; a subsequence knows the landmarks that have it."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.alphabet = np.unique(_codes(landmarks))
        who, sub, weight = _subsequences(landmarks, self.alphabet)
        norm = np.sqrt(np.bincount(who, weight**2, minlength=len(landmarks)))
        order = np.argsort(sub, kind="stable")
        self.subs, self.first, self.many = np.unique(sub[order], return_index=True, return_counts=True)
        self.column, self.part = who[order], (weight / np.maximum(1e-9, norm[who]))[order]

    def plain(self, words: list[str]) -> np.ndarray:
        """The normalized kernel of each word (at most PIECE characters) with each landmark."""
        m = len(self.landmarks)
        out = np.zeros((len(words), m), np.float32)
        for at in range(0, len(words), 2000):
            n = len(words[at : at + 2000])
            who, sub, weight = _subsequences(words[at : at + 2000], self.alphabet)
            norm = np.sqrt(np.bincount(who, weight**2, minlength=n))
            place = np.minimum(np.searchsorted(self.subs, sub), len(self.subs) - 1)
            hit = self.subs[place] == sub
            who, place, weight = who[hit], place[hit], weight[hit]
            many = self.many[place]
            entry = np.repeat(self.first[place] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            shared = np.bincount(np.repeat(who, many) * m + self.column[entry], np.repeat(weight, many) * self.part[entry], minlength=n * m)
            out[at : at + n] = shared.reshape(n, m) / np.maximum(1e-9, norm)[:, None]
        return out

    def values(self, words: list[str]) -> np.ndarray:
        """The kernel of each word with each landmark: the sum of the powers."""
        p = self.plain(words)
        return sum(p**power for power in POWERS)


class Model:
    """Landmarks with a number each, a bias, and a logistic curve over a text's highest decisions."""

    def __init__(self, kernel: Kernel | None, alpha: np.ndarray, bias: float, slopes: np.ndarray, shift: float):
        self.kernel, self.alpha, self.bias, self.slopes, self.shift = kernel, alpha.astype(np.float32), bias, slopes, shift
        self.known: dict[str, int] = {}  # a token's unit, by number
        self.units: dict[str, int] = {}
        self.value = np.zeros(1 << 16, np.float64)
        self.single = np.zeros(1 << 16, bool)

    def __getstate__(self):
        return self.kernel and self.kernel.landmarks, self.alpha, self.bias, self.slopes, self.shift

    def __setstate__(self, state):
        self.__init__(Kernel(state[0]) if state[0] else None, *state[1:])

    def word_values(self, words: list[str]) -> np.ndarray:
        """What each unit adds to its sentence's decision; a long one is the sum of its pieces, as in training."""
        split = [pieces(w) for w in words]
        flat = [p for s in split for p in s]
        out = np.zeros(len(flat))
        for at in range(0, len(flat), 2000):
            out[at : at + 2000] = np.einsum("ij,j->i", self.kernel.values(flat[at : at + 2000]).astype(np.float64), self.alpha.astype(np.float64))
        return np.add.reduceat(out, np.cumsum([0, *map(len, split[:-1])])) if words else out

    def _learn(self, tokens: list[str], keep: int = 1_000_000) -> None:
        missing = set(tokens).difference(self.known)
        if len(self.known) + len(missing) > keep:
            self.known, self.units, missing = {}, {}, set(tokens)
        if not missing:
            return
        new = sorted(missing)
        units = [unit(t) for t in new]
        fresh = sorted(set(units).difference(self.units))
        start, need = len(self.units), len(self.units) + len(fresh)
        if need > len(self.value):
            size = 1 << need.bit_length()
            self.value, self.single = (np.concatenate([old, np.zeros(size - len(old), old.dtype)]) for old in (self.value, self.single))
        whole = [u for u in fresh if u]
        numbers = dict(zip(whole, self.word_values(whole).tolist(), strict=True)) | {"": 0.0}
        self.value[start:need] = [numbers[u] for u in fresh]
        self.single[start:need] = [len(u) == 1 for u in fresh]
        self.units.update(zip(fresh, range(start, need), strict=True))
        self.known.update(zip(new, map(self.units.__getitem__, units), strict=True))

    def decisions(self, texts: list[str]) -> np.ndarray:
        """The machine's decisions for each text's TOP highest sentences, highest first; a sentence without a word has the bias."""
        out = np.full((len(texts), TOP), self.bias, np.float64)
        if self.kernel is None:
            return out
        split = [t.split() for t in texts]
        tokens = [w for d in split for w in d]
        if not tokens:
            return out
        self._learn(tokens)
        index = np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))
        single = self.single[index]
        sizes = np.array([len(d) for d in split], np.int64)
        first = np.cumsum(sizes) - sizes
        start = sentence_starts(tokens, first[sizes > 0])
        sentence = np.cumsum(start) - 1
        # a word counts once in a sentence
        once = np.unique(sentence << 32 | index)
        sums = np.bincount(once >> 32, self.value[once & 0xFFFFFFFF], minlength=int(start.sum()))
        if single.sum() >= 3:
            # letters that stand alone, three or more in a row, are also read as one word
            run = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
            for a, b in zip(run[::2].tolist(), run[1::2].tolist(), strict=True):
                if b - a >= 3:
                    sums[sentence[a]] += max(0.0, float(self.word_values(["".join(unit(t) for t in tokens[a:b])])[0]))
        owner = np.repeat(np.arange(len(texts)), sizes)[start]
        order = np.lexsort((-sums, owner))
        place = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        top = place < TOP
        out[owner[order][top], place[top]] += sums[order][top]
        return -np.sort(-out, axis=1)

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.decisions(texts) @ self.slopes + self.shift, -30, 30)))


def sentence_starts(tokens: list[str], first: np.ndarray) -> np.ndarray:
    """Whether a token starts a sentence: a text's first, one after an end mark, and each LONGEST-th of a sentence without one."""
    n = len(tokens)
    start = np.zeros(n, bool)
    ends = np.fromiter((t.endswith(_ENDS) for t in tokens), bool, n)
    start[1:] = ends[:-1]
    start[first] = True
    begin = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    return start | ((np.arange(n) - begin) % LONGEST == 0)


def sentences(text: str) -> list[tuple[str, ...]]:
    """The units of each sentence, long ones in pieces."""
    tokens = text.split()
    if not tokens:
        return []
    begins = np.flatnonzero(sentence_starts(tokens, np.zeros(1, np.int64))).tolist()
    parts = [tokens[a:b] for a, b in zip(begins, [*begins[1:], len(tokens)], strict=True)]
    return [s for part in parts if (s := tuple(dict.fromkeys(p for t in part if (u := unit(t)) for p in pieces(u))))]


def _spoiled(word: str, rng: np.random.Generator, letters: list[str]) -> str:
    at = int(rng.integers(1, max(2, len(word))))
    return (word[:at] + letters[int(rng.integers(len(letters)))] + word[at:])[:PIECE]


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, start: np.ndarray, ridge: float, steps: int = 300) -> np.ndarray:
    """Weights and bias (the last) of a linear machine with squared hinge loss, by accelerated gradient steps."""
    scale = (weight / weight.sum()).astype(np.float32)
    norm = np.full(z.shape[1], ridge)
    norm[-1] = 1e-6
    gram = sum(((z[i : i + 4000] * scale[i : i + 4000, None]).T @ z[i : i + 4000] for i in range(0, len(z), 4000)), np.zeros((z.shape[1],) * 2))
    step = 1 / (2 * float(np.linalg.eigvalsh(gram)[-1]) + ridge)
    v, u, t = start.copy(), start.copy(), 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (z @ u.astype(np.float32)))
        new = u - step * (norm * u - 2 * (z.T @ (scale * y * slack).astype(np.float32)))
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        u, v, t = new + (t - 1) / t2 * (new - v), new, t2
    return v


def _lean(rows: list[tuple[int, tuple[str, ...]]]) -> tuple[dict[str, float], Counter]:
    """How many standard errors a word is oftener in toxic than in clean sentences, and its number in clean ones.

    A word counts once for each word that it follows, so that copies of a text add nothing.
    """
    seen = [Counter(), Counter()]
    met: list[set[int]] = [set(), set()]
    for label, s in rows:
        for v, u in zip(("", *s), s, strict=False):
            if (h := hash((v, u))) not in met[label]:
                met[label].add(h)
                seen[label][u] += 1
    part = len(met[1]) / max(1, len(met[0]) + len(met[1]))
    del met
    z = {u: (n - (n + seen[0][u]) * part) / math.sqrt((n + seen[0][u]) * part + 1) for u, n in seen[1].items()}
    return z, seen[0]


def _drawn(words: list[str], weight: np.ndarray, k: np.ndarray, count: int, rng: np.random.Generator) -> list[int]:
    """Weighted k-means++: each next landmark by its weight times its squared distance 2 - 2 k from those before."""
    far, out = np.full(len(words), 2.0), []
    while len(out) < min(count, len(words)):
        p = weight * far
        if p.sum() <= 1e-9:
            break
        i = int(np.searchsorted(np.cumsum(p), rng.random() * p.sum())) if out else int(np.argmax(p))
        i = min(i, len(words) - 1)
        out.append(i)
        far = np.minimum(far, np.maximum(0, 2 - 2 * k[i]))
        far[i] = 0
    return out


def landmarks_of(rows: list[tuple[int, tuple[str, ...]]], count: int, rng: np.random.Generator) -> tuple[list[str], dict[str, float]]:
    """Landmarks, ``count`` for each side, and how strongly each candidate speaks for toxic text.

    The candidates' leans are pooled over the kernel, so that the forms of one stem speak together; a form
    that stands alone, as rare words do by chance, stays weak.  Landmarks of the toxic side are drawn by that
    strength; those of the clean side from the clean sentences' words, by how near they come to the first and
    how often they are seen.
    """
    z, clean = _lean(rows)
    words = sorted(z, key=lambda u: (-z[u], u))[:CANDIDATES]
    kernel = Kernel(words)
    k = np.vstack([kernel.plain(words[i : i + 500]) for i in range(0, len(words), 500)])
    lean = np.array([z[u] for u in words])
    cubed = k**3
    pooled = (cubed @ lean.astype(np.float32)).astype(np.float64) / np.sqrt(np.einsum("ij,ij->i", cubed, cubed))
    del cubed
    strong = np.maximum(1e-3, pooled - np.quantile(pooled, 0.75))
    chosen = [words[i] for i in _drawn(words, strong**2, k, count, rng)]
    near = Kernel(chosen)
    seen = sorted((u for u in clean if u not in set(chosen)), key=lambda u: (-clean[u], u))
    close = np.concatenate([near.plain(seen[i : i + 5000]).max(1) for i in range(0, len(seen), 5000)]) if seen else np.zeros(0)
    order = np.argsort(-close * np.log1p([clean[u] for u in seen]), kind="stable")[:CANDIDATES].tolist() if seen else []
    pool = [seen[i] for i in order]
    if pool:
        other = Kernel(pool)
        k = np.vstack([other.plain(pool[i : i + 500]) for i in range(0, len(pool), 500)])
        chosen += [pool[i] for i in _drawn(pool, (close[order].astype(np.float64) * np.log1p([clean[u] for u in pool])) ** 2, k, count, rng)]
    return chosen, dict(zip(words, strong.tolist(), strict=True))


def fit(texts: list[str], toxic: list[int], landmarks: int = LANDMARKS, most: int = TRAIN_SENTENCES, ridge: float = RIDGE) -> Model:
    """Train on sentences of labelled texts; within a toxic text, the sentences that the machine itself finds count.

    With one label only, or no word at all, the model scores every text as the labels' mean (one half without any).
    """
    y = np.array(toxic, np.int64)
    once: dict[tuple[int, tuple[str, ...]], int] = {}
    same: dict[str, str] = {}
    for i, t in enumerate(texts):
        for s in sentences(t):
            once.setdefault((int(y[i]), tuple([same.setdefault(u, u) for u in s])), i)
    del same
    if not len(y) or y.min() == y.max() or {label for label, _ in once} != {0, 1}:
        p = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        return Model(None, np.zeros(0), 0.0, np.zeros(TOP), math.log(p / (1 - p)))
    rng = np.random.default_rng(7)
    rows, owner = list(once), np.array(list(once.values()), np.int64)
    del once
    chosen, strong = landmarks_of(rows, landmarks, rng)
    # a bounded sample of sentences; of toxic texts those with the strongest words are sure to be in it
    label = np.array([l for l, _ in rows])
    best = np.array([max((strong.get(u, 0.0) for u in s), default=0.0) for _, s in rows])
    pick = []
    for side in (0, 1):
        at = np.flatnonzero(label == side)
        key = rng.random(len(at)) + (best[at] if side else 0)
        pick.append(at[np.argsort(-key, kind="stable")[:most]])
    pick = np.concatenate(pick)
    rows, owner, label, best = [rows[i][1] for i in pick.tolist()], owner[pick], label[pick], best[pick]
    kernel = Kernel(chosen)
    kmm = kernel.values(chosen).astype(np.float64)
    size, axes = np.linalg.eigh((kmm + kmm.T) / 2)
    use = size > 1e-4 * size[-1]
    root = (axes[:, use] / np.sqrt(size[use])).astype(np.float32)

    def features(group: list[tuple[str, ...]]) -> np.ndarray:
        words = sorted({u for s in group for u in s})
        place = {u: i for i, u in enumerate(words)}
        z = np.vstack([kernel.values(words[i : i + 5000]) @ root for i in range(0, len(words), 5000)])
        out = np.ones((len(group), z.shape[1] + 1), np.float32)
        for at in range(0, len(group), 2000):
            part = group[at : at + 2000]
            flat = np.fromiter((place[u] for s in part for u in s), np.int64)
            out[at : at + 2000, :-1] = np.add.reduceat(z[flat], np.cumsum([0, *(len(s) for s in part[:-1])]), axis=0)
        return out

    clean, bad = np.flatnonzero(label == 0), np.flatnonzero(label == 1)
    zc, zb = features([rows[i] for i in clean]), features([rows[i] for i in bad])
    bag = owner[bad]
    letters = sorted({c for u in chosen[:landmarks] for c in u})
    f = best[bad]
    w = np.zeros(zc.shape[1])
    line = np.quantile(f, 0.5)
    for turn in range(ROUNDS):
        # those above nearly all clean ones; at first also the highest of each toxic text, which need not hold an insult
        top = np.zeros(len(bad), bool)
        if turn < FORCED:
            order = np.lexsort((f, bag))
            top[order[np.append(bag[order][1:] != bag[order][:-1], True)]] = True
        sure = np.flatnonzero(top | (f > line))
        if not len(sure):
            break
        hides = np.zeros((0, zc.shape[1]), np.float32)
        if turn:
            # the words that speak most for toxic text are also read with a character put into them, as they are hidden
            words = sorted({u for i in sure for u in rows[bad[i]]})
            worth = np.concatenate([kernel.values(words[i : i + 5000]) @ (root @ w[:-1].astype(np.float32)) for i in range(0, len(words), 5000)])
            own = dict(zip(words, worth.tolist(), strict=True))
            hidden = []
            for i in sure.tolist():
                s = rows[bad[i]]
                least = 0.5 * max(own[u] for u in s)
                hidden.append(tuple(_spoiled(u, rng, letters) if own[u] >= least else u for u in s))
            hides = features(hidden)
        z = np.vstack([zc, zb[sure], hides])
        side = np.where(np.arange(len(z)) < len(zc), -1.0, 1.0)
        weight = np.where(side < 0, 1 / (side < 0).sum(), 1 / (side > 0).sum())
        if turn:
            g = zc @ w.astype(np.float32)
            weight[: len(zc)] *= 1 + HARD * (g > np.quantile(g, 0.99))
        w = _svm(z, side, weight, w, ridge)
        del z
        f = zb @ w.astype(np.float32)
        line = np.quantile(zc @ w.astype(np.float32), 0.995)
    model = Model(kernel, root @ w[:-1], float(w[-1]), np.zeros(TOP), 0.0)
    d = np.concatenate([model.decisions(texts[i : i + 500]) for i in range(0, len(texts), 500)])
    # the curve also sees each toxic text by its sentences with the hidden words
    h = np.full((len(y), TOP), model.bias)
    worth = hides @ w.astype(np.float32)
    sure = sure[: len(worth)]
    order = np.lexsort((-worth, bag[sure]))
    place = np.arange(len(order)) - np.searchsorted(bag[sure][order], bag[sure][order])
    h[bag[sure][order][place < TOP], place[place < TOP]] = worth[order][place < TOP]
    model.slopes, model.shift = _logistic(np.concatenate([d, h[y == 1]]), np.concatenate([y, y[y == 1]]), np.concatenate([np.ones(len(y)), np.full(int(y.sum()), HIDDEN)]))
    model.known, model.units = {}, {}
    return model


def _logistic(f: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Slopes, none below 0, and shift of a logistic curve by projected Newton steps, with labels drawn in a little."""
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    z = np.hstack([f, np.ones((len(f), 1))])
    v = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ v, -30, 30)))
        g = z.T @ (weight * (p - t)) + ridge * v
        free = (v > 0) | (g < 0)  # a slope at 0 that would go below is held
        free[-1] = True
        h = (z[:, free] * (weight * p * (1 - p))[:, None]).T @ z[:, free] + ridge * np.eye(int(free.sum()))
        d = np.zeros(len(v))
        d[free] = np.linalg.solve(h, g[free])
        new = v - d * min(1.0, 3 / max(1e-9, float(np.abs(d).max())))
        new[:-1] = np.maximum(0, new[:-1])
        done, v = np.abs(new - v).max() < 1e-8, new
        if done:
            break
    return v[:-1], float(v[-1])


def learn(docs: DataFrame, labels: DataFrame, characters: int = TRAIN_CHARS) -> Model:
    """A model from the labelled rows that are not held out.

    Of each label about ``characters`` characters of text are used, whole texts with the smallest hashes of
    their ids; they reach the driver.  An id with several labels is toxic if one of them says so; null texts,
    ids and labels teach nothing.
    """
    marks = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic is not null").groupBy("_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(~held_out() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    # only ids and lengths meet the labels; the texts of the sample, some thousands, are picked in a scan
    sizes = rows.select("doc_id", F.char_length("text").alias("n")).filter("n > 0")
    marked = stored(sizes.join(marks, sizes["doc_id"] == marks["_id"]).select("doc_id", "n", (F.col("toxic") > 0).cast("int").alias("toxic")), "marked")
    sums = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.sum("n").alias("n")).collect()}
    share = F.lit(0.0)
    for label in (0, 1):
        share = F.when(F.col("toxic") == label, F.lit(min(1.0, characters / max(1, sums.get(label) or 1)))).otherwise(share)
    hashed = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 20))
    chosen = marked.filter(hashed < share * (1 << 20)).select(F.col("doc_id").alias("_id"), "toxic").distinct()
    found = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "toxic").collect()
    found.sort(key=lambda r: (r["doc_id"], r["text"], r["toxic"]))
    return fit([r["text"] for r in found], [r["toxic"] for r in found])


def _scored_rows(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch.column(3).to_pylist()]
        found = [model.scores(texts[i:j]) for i, j in slices(texts, 1 << 20)]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(np.concatenate(found) if found else [], pa.float64())], names=["doc_id", "held_out", "tie", "score"])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, tie, score) of every row; empty and null texts get the score of no word at all."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), row_id("text").alias("tie"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(lambda b: _scored_rows(b, shared.value), "doc_id long, held_out boolean, tie long, score double")
