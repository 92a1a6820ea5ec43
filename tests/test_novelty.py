"""Novelty over whole tables against forms that hold all rows in one task, beyond one block and with values that many rows share."""

import numpy as np
import pytest
from onetask import KthNeighbour, LocalOutlierFactor, TailProbability
from pyspark.sql import functions as F

from tidewatch.operators import novelty


def frame(spark, x, fit):
    return spark.createDataFrame([(i, [float(v) for v in row], bool(f)) for i, (row, f) in enumerate(zip(x, fit, strict=True))], "id long, f array<double>, fit boolean")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((500, 3))
    x[:170, 1] = 0.0  # a third of all rows has one value
    x[10:14] = x[9]  # rows that are the same
    return x, np.arange(500) < 450


@pytest.mark.parametrize("block", [4096, 64])
def test_neighbours(spark, rows, monkeypatch, block):
    monkeypatch.setattr(novelty, "BLOCK", block)
    x, fit = rows
    got = {r.id: r.raw for r in novelty.kth_neighbour(frame(spark, x, fit), 7).collect()}
    assert np.allclose([got[i] for i in range(500)], KthNeighbour(x[fit], 7).scores(x))
    full = np.sqrt(((x[:, None] - x[None, fit]) ** 2).sum(2))
    near = {r.id: r.near for r in novelty.neighbours(frame(spark, x, fit), 5).collect()}
    for i in range(500):
        want = sorted(zip(full[i], np.flatnonzero(fit), strict=True))[:5]
        assert [n.other for n in near[i]] == [o for _, o in want] and np.allclose([n.d for n in near[i]], [d for d, _ in want])


def test_local_outlier_factor(spark):
    rng = np.random.default_rng(2)
    x, fit = rng.standard_normal((300, 3)), np.arange(300) < 250
    got = {r.id: r.raw for r in novelty.local_outlier_factor(frame(spark, x, fit), 10).collect()}
    assert np.allclose([got[i] for i in range(300)], LocalOutlierFactor(x[fit], 10).scores(x))


def test_tails(spark, rows):
    x, fit = rows
    got = {r.id: r for r in novelty.tails(frame(spark, x, fit)).collect()}
    brute = TailProbability(x[fit])
    assert np.allclose([got[i].raw for i in range(500)], brute.scores(x)) and np.allclose([got[i].parts for i in range(500)], brute.parts(x))


def test_ranks_and_confidence(spark):
    rng = np.random.default_rng(3)
    values = [(int(g), float(v), int(w)) for g, v, w in zip(rng.integers(0, 3, 3000), np.where(rng.random(3000) < 0.4, 5.0, rng.integers(0, 400, 3000)), rng.integers(0, 2, 3000), strict=True)]
    got = novelty.with_ranks(spark.createDataFrame(values, "g int, v double, w int"), "g", "v", F.col("w")).collect()
    assert len(got) == len(values)
    for r in got[::37]:
        own = [(v, w) for g, v, w in values if g == r.g]
        assert (r.le, r.lt, r.total) == (sum(w for v, w in own if v <= r.v), sum(w for v, w in own if v < r.v), sum(w for _, w in own))
    scores = spark.createDataFrame([(i, float(i % 7), i < 60) for i in range(80)], "id long, raw double, fit boolean")
    late = [i % 7 for i in range(60, 80)]
    assert all(r.confidence == pytest.approx(sum(v <= r.raw for v in late) / 20) for r in novelty.confident(scores).collect())
    assert all(r.confidence == pytest.approx(sum(i % 7 <= r.raw for i in range(60)) / 60) for r in novelty.confident(scores.filter("fit")).collect())


@pytest.mark.parametrize("kind", sorted(novelty.SCORES))
def test_the_outlier_is_found_and_explained(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 4))
    x[299] = [4.5, 4.5, 12.0, 4.5]
    rows = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, features array<double>")
    got = {r.id: r for r in novelty.scored(rows, kind, "id", "features", "id", list("abcd"), explain=2).collect()}
    assert len(got) == 300 and max(got, key=lambda i: got[i].raw_score) == 299 and got[299].confidence == 1.0
    assert kind == "ecod" or kind.endswith("pca") or got[299].contributions[0] == "c"
    assert not novelty.scored(rows.limit(0), kind, "id", "features", "id").collect()


def test_moments(spark):
    x = np.random.default_rng(5).standard_normal((200, 3))
    n, mean, cov = novelty.moments(frame(spark, x, np.ones(200)))
    assert n == 200 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T))


def test_blocks_grow_before_they_are_many(spark, monkeypatch):
    for name, value in (("BLOCK", 20), ("BLOCKS", 3), ("LARGE_BLOCK", 64)):
        monkeypatch.setattr(novelty, name, value, raising=False)
    x = np.random.default_rng(4).normal(size=(200, 3))
    rows = spark.createDataFrame([(i, v.tolist(), i < 150) for i, v in enumerate(x)], "id long, f array<double>, fit boolean")
    assert [novelty._blocks(rows.limit(k))[1] for k in (15, 50, 120, 200)] == [1, 3, 3, 4]
    got = {r.id: [n.other for n in r.near] for r in novelty.neighbours(rows, 5).collect()}
    far = np.sqrt(((x[:, None] - x[None, :150]) ** 2).sum(2))
    assert got == {i: np.argsort(far[i], kind="stable")[:5].tolist() for i in range(200)}
