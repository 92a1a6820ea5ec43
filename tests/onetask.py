"""Forms that hold a whole graph in one task: what the distributed operators are compared with."""

import heapq
from collections import defaultdict

import numpy as np


def modularity(edges, member):
    """Of a partition of edges (a, b, weight) without loops."""
    total, load = sum(w for *_, w in edges), defaultdict(float)
    for a, b, w in edges:
        load[member[a]] += w
        load[member[b]] += w
    return sum(w for a, b, w in edges if member[a] == member[b]) / total - sum((x / (2 * total)) ** 2 for x in load.values())


def louvain(graph: list[tuple[str, str, float]], seed: int = 42) -> dict[str, int]:
    """Communities by greedy modularity, level by level; nodes are visited in an order drawn from the seed."""
    rng = np.random.default_rng(seed)
    near: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    for a, b, w in sorted(graph):
        near[a][b] += w
        if a != b:
            near[b][a] += w
    member = {n: n for n in sorted(near)}
    while True:
        total = sum(w for n in near for m, w in near[n].items()) / 2 or 1.0
        load = {n: sum(near[n].values()) for n in near}
        place = {n: n for n in near}
        heavy = dict(load)
        moved = True
        while moved:
            moved = False
            for n in rng.permutation(sorted(near)).tolist():
                links: dict[str, float] = defaultdict(float)
                for m, w in near[n].items():
                    if m != n:
                        links[place[m]] += w
                heavy[place[n]] -= load[n]
                gain = {c: w - load[n] * heavy[c] / (2 * total) for c, w in links.items()}
                stay = gain.get(place[n], -load[n] * heavy[place[n]] / (2 * total))
                best = max(sorted(gain), key=lambda c: gain[c], default=place[n])
                if gain.get(best, stay) > stay + 1e-12:
                    place[n], moved = best, True
                heavy[place[n]] += load[n]
        if len(set(place.values())) == len(near):
            break
        member = {n: place[c] for n, c in member.items()}
        up: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        for n in near:
            for m, w in near[n].items():
                up[place[n]][place[m]] += w
        near = up
    names = {c: i for i, c in enumerate(sorted(set(member.values())))}
    return {n: names[c] for n, c in member.items()}


def betweenness(graph: list[tuple[str, str, float]]) -> dict[str, float]:
    """Share of shortest paths through each node, weights being distances, halved and normalized."""
    near: dict[str, dict[str, float]] = defaultdict(dict)
    for a, b, w in graph:
        near[a][b] = near[b][a] = w
    score = dict.fromkeys(near, 0.0)
    for source in sorted(near):
        paths, before, done, far = defaultdict(float), defaultdict(list), [], {source: 0.0}
        paths[source] = 1.0
        heap, closed = [(0.0, source)], set()
        while heap:
            d, v = heapq.heappop(heap)
            if v in closed:
                continue
            closed.add(v)
            done.append(v)
            for w, length in near[v].items():
                step = d + length
                if w not in far or step < far[w] - 1e-12:
                    far[w], paths[w], before[w] = step, paths[v], [v]
                    heapq.heappush(heap, (step, w))
                elif abs(step - far[w]) <= 1e-12 and w not in closed:
                    paths[w] += paths[v]
                    before[w].append(v)
        part = defaultdict(float)
        for w in reversed(done):
            for v in before[w]:
                part[v] += paths[v] / paths[w] * (1 + part[w])
            if w != source:
                score[w] += part[w]
    n = len(near)
    scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    return {v: s * scale for v, s in score.items()}


def _nearest(x: np.ndarray, base: np.ndarray, k: int, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Distances and places of the k nearest rows of ``base``, in blocks.

    Candidates, some more than k, come from products of matrices; their distances are then taken one by one, so
    that a row's do not depend on the rows that it is asked with.
    """
    k = min(k, len(base))
    more = min(len(base), k + 8)
    dist, place = np.empty((len(x), k)), np.empty((len(x), k), np.int64)
    norm = (base**2).sum(1)
    for a in range(0, len(x), block):
        part = x[a : a + block]
        d = (part**2).sum(1)[:, None] + norm - 2 * part @ base.T
        at = np.sort(np.argpartition(d, more - 1, axis=1)[:, :more], axis=1)
        apart = part[:, None, :] - base[at]
        near = np.sqrt(np.einsum("ijk,ijk->ij", apart, apart))
        order = np.argsort(near, axis=1, kind="stable")[:, :k]
        dist[a : a + block] = np.take_along_axis(near, order, 1)
        place[a : a + block] = np.take_along_axis(at, order, 1)
    return dist, place


class KthNeighbour:
    def __init__(self, x: np.ndarray, k: int = 20):
        self.base, self.k = x, k

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x, self.base, self.k)[0][:, -1]

    def parts(self, x: np.ndarray) -> np.ndarray:
        """The way to the k-th neighbour, coordinate by coordinate."""
        return x - self.base[_nearest(x, self.base, self.k)[1][:, -1]]


class LocalOutlierFactor:
    """Novelty form: density of a row's neighbours over its own."""

    def __init__(self, x: np.ndarray, k: int = 20):
        self.base, self.k = x, min(k, len(x) - 1)
        dist, place = _nearest(x, x, self.k + 1)
        dist, place = dist[:, 1:], place[:, 1:]
        self.reach = dist[:, -1]
        self.density = 1 / (np.maximum(dist, self.reach[place]).mean(1) + 1e-10)

    def scores(self, x: np.ndarray) -> np.ndarray:
        dist, place = _nearest(x, self.base, self.k)
        own = 1 / (np.maximum(dist, self.reach[place]).mean(1) + 1e-10)
        return self.density[place].mean(1) / own

    def parts(self, x: np.ndarray) -> np.ndarray:
        """The way from the neighbours' mean."""
        return x - self.base[_nearest(x, self.base, self.k)[1]].mean(1)


class Mahalanobis:
    """Distance from a robust centre: the covariance of the ``support`` share of rows closest to it, refined in steps."""

    def __init__(self, x: np.ndarray, support: float = 0.75, steps: int = 10):
        h = max(2, int(support * len(x)))
        rows = np.argsort(np.abs(x - np.median(x, 0)).sum(1), kind="stable")[:h]
        for _ in range(steps):
            self.centre = x[rows].mean(0)
            cov = np.cov(x[rows].T).reshape(x.shape[1], -1) + 1e-6 * np.eye(x.shape[1])
            self.precision = np.linalg.inv(cov)
            new = np.argsort(self.scores(x), kind="stable")[:h]
            if np.array_equal(np.sort(new), np.sort(rows)):
                break
            rows = new

    def scores(self, x: np.ndarray) -> np.ndarray:
        d = x - self.centre
        return np.sqrt(np.maximum(0, np.einsum("ij,jk,ik->i", d, self.precision, d)))

    def parts(self, x: np.ndarray) -> np.ndarray:
        """Each coordinate's share of the squared distance."""
        d = x - self.centre
        return d * (d @ self.precision)


class TailProbability:
    """Sum over columns of the negative log of the tail beyond a value; the tail by the column's skew."""

    def __init__(self, x: np.ndarray):
        self.columns = np.sort(x, 0)
        c = x - x.mean(0)
        self.skew = np.sign((c**3).mean(0))

    def _tails(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.columns)
        left, right = np.empty_like(x), np.empty_like(x)
        for j in range(x.shape[1]):
            left[:, j] = -np.log((np.searchsorted(self.columns[:, j], x[:, j], "right") + 1) / (n + 1))
            right[:, j] = -np.log((n - np.searchsorted(self.columns[:, j], x[:, j], "left") + 1) / (n + 1))
        return left, right

    def scores(self, x: np.ndarray) -> np.ndarray:
        left, right = self._tails(x)
        skewed = np.where(self.skew < 0, left, right)
        return np.maximum.reduce([left.sum(1), right.sum(1), skewed.sum(1)])

    def parts(self, x: np.ndarray) -> np.ndarray:
        """Each column's rarer tail."""
        return np.maximum(*self._tails(x))


class Reduced:
    """Another model behind the principal axes that hold ``share`` of the variance."""

    def __init__(self, x: np.ndarray, model, share: float = 0.95):
        self.mean = x.mean(0)
        _, s, v = np.linalg.svd(x - self.mean, full_matrices=False)
        k = int(np.searchsorted(np.cumsum(s**2) / max(1e-12, (s**2).sum()), share) + 1)
        self.axes = v[:k].T
        self.model = model((x - self.mean) @ self.axes)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.model.scores((x - self.mean) @ self.axes)

    def parts(self, x: np.ndarray) -> np.ndarray:
        """The axes' parts, dealt back to the columns by their weights."""
        return np.abs(self.model.parts((x - self.mean) @ self.axes)) @ np.abs(self.axes.T)
