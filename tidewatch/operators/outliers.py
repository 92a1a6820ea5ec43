"""Isolation forests over feature vectors, their confidence and explanations; curves that calibrate scores; measures of quality.

The rows before a point of time are fitted on, those after it tell how high scores go by themselves.  Means and
deviations are aggregates over all fitted rows.  A forest looks at TREES times SIZE of them at most, which is how it is
defined; it reaches the executors once and scores all rows in batches.  ``novelty`` has the scores that need all rows.
"""

from __future__ import annotations

import io
import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .asof import asof_join

#: Trees of a forest and rows that each is grown on, the confidence from which a window is reported, the later part of the time.
TREES, SIZE, REPORT, HELD = 200, 256, 0.995, 0.1
#: Quantiles of all later rows' scores that a model is calibrated by: confidences are right to one in so many.
GRID = 4000


def sample(rows: DataFrame, column: str = "features", most: int = TREES * SIZE, seed: int = 7) -> np.ndarray:
    """About ``most`` vectors by the smallest hashes of their content; all of them if there are fewer.  In the order of their hashes."""
    place = F.xxhash64(F.lit(seed), column)
    n = rows.count()
    if n > most:
        rows = rows.filter(F.pmod(place, F.lit(1 << 30)) < F.lit(int(most / n * (1 << 30))))
    found = [(r[0], r[1]) for r in rows.select(place, column).collect()]
    return np.array([v for _, v in sorted(found)], np.float64)


def moments(rows: DataFrame, column: str = "features") -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of each coordinate over all rows; a row a coordinate reaches the driver."""
    found = rows.select(F.posexplode(column).alias("k", "x")).groupBy("k").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("k").collect()
    return np.array([r["m"] for r in found], np.float64), np.array([r["s"] for r in found], np.float64)


class Scaler:
    def __init__(self, mean: np.ndarray, sd: np.ndarray):
        self.mean, self.sd = mean, np.where(sd > 0, sd, 1.0)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.sd


def _unsuccessful(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, np.float64)
    long = 2 * (np.log(np.maximum(n, 3) - 1) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n < 2, 0.0, np.where(n == 2, 1.0, long))


class ExtendedForest:
    """Isolation by random hyperplanes: normals keep ``free`` coordinates, all by default.

    All trees lie in flat arrays; node i has its children at 2i + 1 and 2i + 2.  Trees are cut level by level,
    and all rows of a batch go down a tree together.
    """

    def __init__(self, x: np.ndarray, trees: int = TREES, size: int = SIZE, seed: int = 42, free: int | None = None):
        rng = np.random.default_rng(seed)
        d = x.shape[1]
        self.size = min(size, len(x))
        self.height = max(1, math.ceil(math.log2(max(2, self.size))))
        nodes = 2**self.height - 1
        self.normal, self.point = np.zeros((trees, nodes, d), np.float32), np.zeros((trees, nodes, d), np.float32)
        self.cut = np.zeros((trees, nodes), bool)
        self.held = np.zeros((trees, 2 * nodes + 1), np.int64)  # rows of a node
        for t in range(trees):
            own = x[rng.choice(len(x), self.size, replace=False)].astype(np.float32)
            at = np.zeros(len(own), np.int64)
            self.held[t, 0] = len(own)
            for level in range(self.height):
                for node in range(2**level - 1, 2 ** (level + 1) - 1):
                    rows = np.flatnonzero(at == node)
                    if len(rows) < 2:
                        continue
                    low, high = own[rows].min(0), own[rows].max(0)
                    normal = rng.standard_normal(d).astype(np.float32)
                    normal[rng.permutation(d)[free or d :]] = 0
                    point = (low + rng.random(d) * (high - low)).astype(np.float32)
                    right = (own[rows] - point) @ normal > 0
                    if right.all() or not right.any():
                        continue  # a cut that parts nothing leaves a leaf
                    self.normal[t, node], self.point[t, node], self.cut[t, node] = normal, point, True
                    at[rows] = 2 * node + 1 + right
                    self.held[t, 2 * node + 1], self.held[t, 2 * node + 2] = (~right).sum(), right.sum()

    def _descend(self, x: np.ndarray, weigh: bool) -> tuple[np.ndarray, np.ndarray]:
        x = x.astype(np.float32)
        depth, parts = np.zeros(len(x)), np.zeros(x.shape if weigh else (0, 0))
        offset = np.einsum("tnd,tnd->tn", self.normal, self.point)
        for t in range(len(self.cut)):
            at, level = np.zeros(len(x), np.int64), np.zeros(len(x))
            for _ in range(self.height):
                go = np.flatnonzero((at < self.cut.shape[1]) & self.cut[t, np.minimum(at, self.cut.shape[1] - 1)])
                if not len(go):
                    break
                node = at[go]
                normal = self.normal[t, node]
                side = np.einsum("ij,ij->i", x[go], normal) - offset[t, node]
                if weigh:  # a coordinate speaks by its part in the cut, more where few rows are left beyond it
                    step = np.abs((x[go] - self.point[t, node]) * normal)
                    child = 2 * node + 1 + (side > 0)
                    share = 1 - self.held[t, child] / np.maximum(1, self.held[t, node])
                    parts[go] += step / np.maximum(1e-12, step.sum(1))[:, None] * share[:, None]
                at[go] = 2 * node + 1 + (side > 0)
                level[go] += 1
            depth += level + _unsuccessful(self.held[t, at])
        return depth, parts

    def scores(self, x: np.ndarray) -> np.ndarray:
        depth, _ = self._descend(x, False)
        return 2.0 ** (-depth / len(self.cut) / max(1e-12, float(_unsuccessful(self.size))))

    def parts(self, x: np.ndarray) -> np.ndarray:
        """How much each coordinate cuts the rows off, over all trees."""
        return self._descend(x, True)[1] / len(self.cut)


class IsolationForest(ExtendedForest):
    """Axis-parallel cuts: one free coordinate."""

    def __init__(self, x: np.ndarray, trees: int = TREES, size: int = SIZE, seed: int = 42):
        super().__init__(x, trees, size, seed, free=1)


MODELS = {"eif": ExtendedForest, "iforest": IsolationForest}


class Detector:
    """Scaler, forest and the sorted quantiles of a calibration part's scores; confidence is the share of those not above a score."""

    def __init__(self, kind: str, names: list[str], fitted: np.ndarray, scale: Scaler | None = None):
        self.kind, self.names = kind, names
        self.scale = scale or Scaler(fitted.mean(0), fitted.std(0))
        self.model = MODELS[kind](self.scale(fitted))
        self.calibration = np.sort(self.raw(fitted))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.nan_to_num(self.model.scores(self.scale(x)), nan=0.0, posinf=1e12, neginf=-1e12)

    def scores(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = self.raw(x)
        return s, np.searchsorted(self.calibration, s, "right") / len(self.calibration)

    def contributions(self, x: np.ndarray, top: int = 10) -> list[list[tuple[str, float]]]:
        """Of each row the columns that speak most for its score, as the model itself weighs them."""
        parts = self.model.parts(self.scale(x))
        return [[(self.names[j], round(float(row[j]), 6)) for j in np.argsort(-np.abs(row), kind="stable")[:top]] for row in parts]


def fitted(rows: DataFrame, kinds: list[str], names: list[str] | None = None, column: str = "features", order: str = "hour_us", held: float = HELD) -> dict[str, Detector]:
    """Forests fitted on the rows of the earlier part of the time that ``order`` spans, calibrated on all rows of the last ``held`` of it.

    Without later rows the calibration is on the fitted ones.
    """
    low, high = rows.agg(F.min(order), F.max(order)).first()
    if low is None:
        raise ValueError("no rows to fit on")
    cut = low + (high - low) * (1 - held)
    early, late = rows.filter(F.col(order) <= F.lit(cut)), rows.filter(F.col(order) > F.lit(cut))
    late = late if late.limit(1).count() else early
    scale = Scaler(*moments(early, column))
    x = sample(early, column)
    out = {k: Detector(k, names or [f"x{i}" for i in range(x.shape[1])], x, scale) for k in kinds}
    for d in out.values():
        steps = [(i + 0.5) / GRID for i in range(GRID)]
        d.calibration = np.array(score(late.select(column), d, column).agg(F.percentile_approx("raw_score", steps, 100 * GRID)).first()[0])
    return out


def score(rows: DataFrame, detector: Detector, column: str = "features", explain: int = 0) -> DataFrame:
    """Add raw_score and confidence, and with ``explain`` the names of that many columns that speak most; the model is broadcast once."""
    shared = rows.sparkSession.sparkContext.broadcast(detector)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                x = np.stack(part[column].to_numpy()).astype(np.float64)
                s, c = shared.value.scores(x)
                more = {"contributions": [[n for n, _ in row] for row in shared.value.contributions(x, explain)]} if explain else {}
                yield part.assign(raw_score=s, confidence=c, **more)

    from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType

    schema = StructType(rows.schema.fields + []).add("raw_score", DoubleType()).add("confidence", DoubleType())
    if explain:
        schema = schema.add("contributions", ArrayType(StringType()))
    return rows.mapInPandas(run, schema)


def explained(rows: DataFrame, detector: Detector, top: int = 10, column: str = "features") -> DataFrame:
    """Add the names of the ``top`` columns that speak most for each row's score.  That is many times the work of a score: for rows that are reported."""
    shared = rows.sparkSession.sparkContext.broadcast(detector)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                x = np.stack(part[column].to_numpy()).astype(np.float64)
                yield part.assign(contributions=[[n for n, _ in row] for row in shared.value.contributions(x, top)])

    from pyspark.sql.types import ArrayType, StringType, StructType

    return rows.mapInPandas(run, StructType(rows.schema.fields + []).add("contributions", ArrayType(StringType())))


def reported(scored: DataFrame, least: float = REPORT) -> DataFrame:
    """The windows whose confidence is high enough to be a signal."""
    return scored.filter(F.col("confidence") >= least)


def _packed(x: object) -> bytes:
    out = io.BytesIO()
    np.savez(out, **{k: v for k, v in vars(x).items() if isinstance(v, (np.ndarray, int, float, np.generic))})
    return out.getvalue()


def _filled(cls: type, data: bytes) -> object:
    x = object.__new__(cls)
    for k, v in np.load(io.BytesIO(data)).items():
        setattr(x, k, v if v.ndim else v.item())
    return x


def save(spark: SparkSession, path: str, detectors: dict[str, Detector]) -> None:
    """Detectors as rows of (kind, names, arrays) in a table that driver and executors share."""
    rows = [(kind, json.dumps(d.names), _packed(d.scale), _packed(d.model), d.calibration.tolist()) for kind, d in detectors.items()]
    spark.createDataFrame(rows, "kind string, names string, scale binary, model binary, calibration array<double>").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, names: list[str]) -> dict[str, Detector]:
    """The detectors of a table; raises if they were fitted on other columns."""
    out = {}
    for r in spark.read.parquet(path).collect():  # a row a model
        if json.loads(r["names"]) != names:
            raise ValueError("the models were fitted on other columns")
        d = object.__new__(Detector)
        d.kind, d.names, d.scale, d.model, d.calibration = r["kind"], names, _filled(Scaler, r["scale"]), _filled(MODELS[r["kind"]], r["model"]), np.array(r["calibration"])
        out[r["kind"]] = d
    return out


# -- calibration --------------------------------------------------------------------------------------------


def isotonic(scores: np.ndarray, labels: np.ndarray, least: int = 8) -> tuple[np.ndarray, np.ndarray] | None:
    """Non-decreasing steps by pooling neighbours, classes weighted alike; None below ``least`` rows or with one class."""
    if len(scores) < least or len(set(labels.tolist())) < 2:
        return None
    y = labels.astype(float)
    w = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    x, place = np.unique(scores.astype(float), return_inverse=True)  # rows of one score are one point
    pools: list[list[float]] = []
    for xi, yi, wi in zip(x, np.bincount(place, w * y), np.bincount(place, w), strict=True):
        pools.append([xi, xi, yi, wi])
        while len(pools) > 1 and pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]:
            b = pools.pop()
            a = pools[-1]
            pools[-1] = [a[0], b[1], a[2] + b[2], a[3] + b[3]]
    xs = np.array([v for p in pools for v in (p[0], p[1])])
    ys = np.array([v for p in pools for v in (p[2] / p[3],) * 2])
    return xs, ys


def isotonic_fit(rows: DataFrame, score_: str, y: str, least: int = 8) -> tuple[np.ndarray, np.ndarray] | None:
    """The same curve by Spark's own pooling, over one row for each distinct score: only its corners reach the driver.

    Classes weigh alike.  None below ``least`` rows or with one class.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    total = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(y).cast("double")).alias("rate")).first()
    if total["n"] < least or total["rate"] in (0.0, 1.0):
        return None
    w = F.when(F.col(y) == 1, F.lit(0.5 / total["rate"])).otherwise(F.lit(0.5 / (1 - total["rate"])))
    per = rows.groupBy(F.col(score_).cast("double").alias("_x")).agg(F.sum(w).alias("weight"), (F.sum(w * F.col(y)) / F.sum(w)).alias("label"))
    model = IsotonicRegression(weightCol="weight").fit(VectorAssembler(inputCols=["_x"], outputCol="features").transform(per))
    return model.boundaries.toArray(), model.predictions.toArray()


def calibrated(score: Column, curve: tuple[np.ndarray, np.ndarray] | None, absolute: bool = False) -> Column:
    """A score on its curve, between points on the line; without one, held between 0 and 1."""
    x = F.when(score.isNull() | F.isnan(score), F.lit(0.0)).when(score == float("inf"), F.lit(1e6)).when(score == float("-inf"), F.lit(-1e6)).otherwise(score)
    x = F.abs(x) if absolute else x
    if curve is None:
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    xs, ys = (a.tolist() for a in curve)
    # the number of corners below x, by two looks at constant arrays: among every step-th corner, then among one step's
    step = math.isqrt(len(xs) - 1) + 1
    parts = [xs[i : i + step] for i in range(0, len(xs), step)]
    literal = lambda v: F.array(*[F.lit(float(u)) for u in v])
    below = lambda edges: F.size(F.filter(edges, lambda e: e < x))
    coarse = below(literal([p[0] for p in parts[1:]])) if len(parts) > 1 else F.lit(0)
    at = coarse * step + below(F.element_at(F.array(*[literal(p) for p in parts]), coarse + 1))
    corner = lambda v, i: F.element_at(literal(v), i)
    return F.when(at == 0, F.lit(ys[0])).when(at == len(xs), F.lit(ys[-1])).otherwise(_between(x, corner(xs, at), corner(ys, at), corner(xs, at + 1), corner(ys, at + 1)))


def _between(x: Column, a: Column, fa: Column, b: Column, fb: Column) -> Column:
    return F.when(b > a, fa + (fb - fa) * (x - a) / (b - a)).otherwise(fb)


def isotonic_curves(rows: DataFrame, key: str, score_: str, y: str, least: int = 8) -> DataFrame:
    """(key, x0, y0, x1, y1): of each detector with a curve its segments, the first and last open; detectors are few.

    The curves are a table: how many corners they have is no matter to a plan that reads them.
    """
    spark = rows.sparkSession
    segments = []
    for r in rows.select(key).distinct().orderBy(key).collect():
        curve = isotonic_fit(rows.filter(F.col(key) == r[0]), score_, y, least)
        if curve is not None:
            xs, ys = [-math.inf, *curve[0].tolist(), math.inf], [float(curve[1][0]), *curve[1].tolist(), float(curve[1][-1])]
            # of corners at one score the last holds from it on
            segments += [(r[0], a, fa, b, fb) for a, fa, b, fb in zip(xs, ys, xs[1:], ys[1:], strict=False) if b > a]
    return spark.createDataFrame(segments, f"{key} string, x0 double, y0 double, x1 double, y1 double")


def recalibrated(signals: DataFrame, curves: DataFrame, key: str, score_: str) -> DataFrame:
    """``signals`` with ``confidence`` on its detector's curve and ``calibrated``; without a curve the score held in 0 to 1, and false.

    A missing or undefined score counts as 0.  The segment is found by an as-of join on the score.
    """
    x = F.col("_x")
    clean = F.when(F.col(score_).isNull() | F.isnan(score_), F.lit(0.0)).otherwise(F.col(score_).cast("double"))
    low = F.greatest(F.col("x0"), F.lit(-1e6)).alias("_x")
    found = asof_join(signals.withColumn("_x", F.least(F.greatest(clean, F.lit(-1e6)), F.lit(1e6))), curves.select(key, low, "x0", "y0", "x1", "y1"), key, "_x", ["x0", "y0", "x1", "y1"], bucket=1)
    inside = F.when((F.col("x0") == -math.inf) | (F.col("x1") == math.inf), F.col("y0")).otherwise(_between(x, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
    known = F.col("y0").isNotNull()
    out = found.withColumn("confidence", F.when(known, inside).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))))
    return out.withColumn("calibrated", known).drop("_x", "x0", "y0", "x1", "y1")


# -- measures of quality ------------------------------------------------------------------------------------


def reliability(rows: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_p, rate) of equal bins of the probability, the last one closed."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate"))


def brier(rows: DataFrame, p: str, y: str) -> DataFrame:
    return rows.agg(F.avg((F.col(p) - F.col(y)) ** 2).alias("brier"), F.count(F.lit(1)).alias("n"))


def confusion(rows: DataFrame, keys: list[str], predicted: str, y: str, beta: float = 2.0) -> DataFrame:
    """tp, fp, fn, precision, recall, f1, f_beta and the rate of false alarms for each key."""
    p, t = F.col(predicted), F.col(y)
    a = rows.groupBy(*keys).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"))
    safe = lambda n, d: F.when(d > 0, n / F.when(d > 0, d)).otherwise(F.lit(0.0))
    a = a.withColumn("precision", safe(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", safe(F.col("tp"), F.col("tp") + F.col("fn")))
    f = lambda b2: safe((1 + b2) * F.col("precision") * F.col("recall"), b2 * F.col("precision") + F.col("recall"))
    return a.withColumn("f1", f(1.0)).withColumn("f_beta", f(beta * beta)).withColumn("fp_rate", safe(F.col("fp"), F.col("fp") + F.col("tn")))


def average_precision(rows: DataFrame, score_: str, y: str, ranges: int = 64) -> DataFrame:
    """Area under precision and recall, rows of equal score taken together.

    Rows are counted per score first.  Ranges of scores are summed apart and then each by itself, so that no
    task gets all scores; one row a range reaches the driver.
    """
    per = rows.groupBy(score_).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("pos"))
    cuts = sorted(set(per.agg(F.percentile_approx(score_, [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0] or []))
    cell = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(score_))) if cuts else F.lit(0)
    per = per.withColumn("_cell", cell)
    above, tp, seen = {}, 0, 0
    for r in sorted(per.groupBy("_cell").agg(F.sum("pos").alias("p"), F.sum("n").alias("n")).collect(), reverse=True):
        above[r["_cell"]] = (tp, seen)
        tp, seen = tp + r["p"], seen + r["n"]
    base = [F.lit(0), F.lit(0)]
    for c, both in above.items():
        base = [F.when(F.col("_cell") == c, F.lit(v)).otherwise(b) for v, b in zip(both, base, strict=True)]
    w = Window.partitionBy("_cell").orderBy(F.desc(score_)).rowsBetween(Window.unboundedPreceding, 0)
    run = per.select("pos", (F.sum("pos").over(w) + base[0]).alias("tp"), (F.sum("n").over(w) + base[1]).alias("seen"))
    return run.agg(F.sum(F.col("pos") / F.lit(max(1, tp)) * F.col("tp") / F.col("seen")).alias("average_precision"))
