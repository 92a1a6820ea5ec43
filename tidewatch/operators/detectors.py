"""Statistical detectors: bursts, beacons, rarity, seasonal residuals, path entropy and generated names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import clamp01, entropy_bits, robust_z, text_entropy, with_robust_z
from ..functions.web import is_random_segment, path_segments
from ..scratch import stored
from .asof import claimed

#: Bins of a key that lie together, and frequencies that are looked at together; rows that a Python worker gets at once.
STRETCH, ROWS = 1 << 18, 32
#: Up to so many bins for each place of the chirp transform are multiplied out; powers that differ by less than this share are equal.
FEW_BINS, NEAR = 64, 1e-9
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def buckets(ev: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """Counts of the active time buckets, aligned to the epoch."""
    width = seconds * 1_000_000
    return ev.groupBy(*keys, (F.floor(F.col("us") / width) * width).cast("long").alias("bucket_us")).agg(F.count(F.lit(1)).alias("n"))


def bursts(ev: DataFrame, key: str, seconds: int = 300, least: int = 4, bound: float = 3.5) -> DataFrame:
    """Buckets far from their entity's median in either direction; confidence |z| / 10, 1 at most.

    Entities with fewer than ``least`` active buckets have no opinion.
    """
    counted = buckets(ev, [key], seconds).withColumn("x", F.col("n").cast("double"))
    enough = counted.groupBy(key).agg(F.count(F.lit(1)).alias("n_buckets")).filter(F.col("n_buckets") >= least)
    scored = with_robust_z(counted.join(enough, key), [key], "x")
    fired = scored.filter(F.abs("z") > bound)
    return fired.select(F.col(key).alias("entity_value"), "bucket_us", "n", "median", "mad", F.when(F.abs("z") == float("inf"), F.lit(None)).otherwise(F.col("z")).alias("z"), (F.abs("z") == float("inf")).alias("z_is_infinite"), F.least(F.lit(1.0), F.abs("z") / 10).alias("confidence"))


def beacons(ev: DataFrame, keys: list[str], least: int = 8, bound: float = 0.3) -> DataFrame:
    """Pairs whose requests come at even intervals: regularity times volume times duration."""
    gap = (F.col("us") - F.lag("us").over(Window.partitionBy(*keys).orderBy("us", "id"))) / 1e6
    rows = ev.withColumn("gap", gap)
    a = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("gap").alias("mean_gap"), F.stddev_pop("gap").alias("sd_gap"), F.median("gap").alias("median_gap"), ((F.max("us") - F.min("us")) / 3.6e9).alias("hours")).filter(F.col("n") >= least)
    cv = F.when(F.col("mean_gap") > 0, F.col("sd_gap") / F.when(F.col("mean_gap") > 0, F.col("mean_gap"))).otherwise(F.lit(1.0))
    score = (1 - F.least(F.lit(1.0), cv)) * F.least(F.lit(1.0), F.col("n") / 50.0) * F.least(F.lit(1.0), F.col("hours") / 4.0)
    return a.withColumn("cv", cv).withColumn("score", score).filter(F.col("score") >= bound)


def _transform(at: np.ndarray, n: np.ndarray, size: int, low: int, width: int) -> np.ndarray:
    """Frequencies ``low`` to ``low + width - 1`` of the Fourier transform of a series of ``size`` bins that has ``n`` in the bins ``at``, in order, and else 0.

    Phases are reduced as whole numbers.  Few bins are two small tables of phases multiplied; many go by the chirp transform, whose
    length is that of this stretch of bins and frequencies, not that of the series.
    """
    turn = lambda steps: np.exp(-2j * np.pi / size * (steps % size))
    length = int(at[-1] - at[0]) + 1
    whole = 1 << (length + width - 2).bit_length()
    if len(at) * width <= FEW_BINS * whole:
        k = int(width**0.5) + 1
        starts = low + k * np.arange(-(-width // k))
        return ((turn(starts[:, None] * at) * n) @ turn(at[:, None] * np.arange(k))).ravel()[:width]
    chirp = np.exp(-1j * np.pi / size * (np.arange(max(length, width)) ** 2 % (2 * size)))
    there, back = np.zeros(whole, complex), np.zeros(whole, complex)
    own = at - at[0]
    there[own] = n * turn(low * own) * chirp[own]
    back[:width] = chirp[:width].conj()
    back[whole - length + 1 :] = chirp[1:length][::-1].conj()
    return np.fft.ifft(np.fft.fft(there) * np.fft.fft(back))[:width] * chirp[:width] * turn((low + np.arange(width)) * at[0])


def _spectra(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Of each key and range of frequencies (k, peak, total, flat): rows are stretches of a key's bins, in order, and are added up.

    ``k`` is the least frequency whose power is the range's greatest, to nine digits.
    """
    names, held, done = [*keys, "bucket_s", "size", "low", "width"], None, []

    def finished(key: tuple, sums: np.ndarray, bins: int, least: int, most: int) -> tuple:
        power = sums.real**2 + sums.imag**2
        peak = float(power.max(initial=0.0))
        k = int(key[-2] + (power >= peak * (1 - NEAR)).argmax()) if len(power) else 0
        return *key, k, peak, float(power.sum()), bins == key[-3] and least == most

    for batch in batches:
        kinds = [batch.schema.field(c).type for c in names]
        for i in range(len(batch)):
            key = tuple(batch.column(c)[i].as_py() for c in names)
            at, n = (batch.column(c)[i].values.to_numpy() for c in ("at", "n"))
            size, low, width = key[-3:]
            sums = _transform(at, n, size, low, width)
            if held and held[0] == key:
                held = key, held[1] + sums, held[2] + len(at), min(held[3], int(n.min())), max(held[4], int(n.max()))
                continue
            if held:
                done.append(finished(*held))
            held = key, sums, len(at), int(n.min()), int(n.max())
        types = [*kinds, pa.int64(), pa.float64(), pa.float64(), pa.bool_()]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], names=[*names, "k", "peak", "total", "flat"])
        if done:
            yield made(done)
            done = []
    if held:
        yield made([finished(*held)])


def dominant_period(ev: DataFrame, keys: list[str], width: int = 60, most: int | None = None) -> DataFrame:
    """The strongest period of each key's counts per ``width`` seconds: (period_s, ratio, strength, bucket_s); null where counts are flat.

    The spectrum is whole however long a key lasts.  Stretches of ``STRETCH`` bins and ranges of as many frequencies, which are a task's
    work each, bound what a task holds; a key that lasts longer has several of either.  Equal powers, to nine digits, give the longest period.
    With ``most``, a key that spans more bins has bins of a multiple of ``width``, as few as will do: no event is left out, but shorter periods are.
    """
    spark = ev.sparkSession
    first = ev.groupBy(*keys).agg(F.min("us").alias("_t0"), F.max("us").alias("_t1"))
    bins = F.floor((F.col("_t1") - F.col("_t0")) / (width * 1_000_000)) + 1
    first = first.select(*keys, "_t0", "_t1", ((F.ceil(bins / most) if most else F.lit(1)) * width).cast("long").alias("bucket_s"))
    place = lambda t: F.expr(f"({t} - _t0) div (bucket_s * 1000000)")
    binned = ev.join(first, keys).groupBy(*keys, "bucket_s", (place("_t1") + 1).alias("size"), place("us").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    stretches = binned.groupBy(*keys, "bucket_s", "size", F.expr(f"bin div {STRETCH}").alias("stretch")).agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("x"))
    ranges = stretches.withColumn("low", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), F.expr("size div 2")), F.lit(STRETCH).cast("long"))))
    rows = ranges.select(*keys, "bucket_s", "size", "low", F.least(F.lit(STRETCH).cast("long"), F.expr("size div 2 - low + 1")).alias("width"), "stretch", F.col("x.bin").alias("at"), F.col("x.n").alias("n"))
    # a few bytes are much work: no fewer tasks than asked for
    placed = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys, "low").sortWithinPartitions(*keys, "low", "stretch")
    kinds = dict(ev.dtypes)
    was = spark.conf.get(_ARROW_ROWS)
    spark.conf.set(_ARROW_ROWS, str(ROWS))  # a row is up to some megabytes
    try:
        found = stored(placed.mapInArrow(lambda b: _spectra(b, keys), ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", bucket_s long, size long, low long, width long, k long, peak double, total double, flat boolean"), "spectra")
    finally:
        spark.conf.set(_ARROW_ROWS, was)
    whole = found.groupBy(*keys, "bucket_s", "size").agg(F.max("peak").alias("peak"), F.sum("total").alias("total"), F.bool_and("flat").alias("flat"), F.collect_list(F.struct("k", "peak")).alias("ranges"))
    k = F.array_min(F.transform(F.filter("ranges", lambda r: r["peak"] >= F.col("peak") * (1 - NEAR)), lambda r: r["k"]))
    n = F.expr("size div 2")
    rest = (F.col("total") - F.col("peak")) / F.when(n > 1, n - 1)
    known = lambda x: F.when((n > 1) & ~F.col("flat"), x)
    ratio = F.when(rest > 0, F.col("peak") / F.when(rest > 0, rest)).otherwise(F.lit(float("inf")))
    strength = F.col("peak") / F.when(F.col("total") > 0, F.col("total"))
    return whole.select(*keys, "bucket_s", known(F.col("size") * F.col("bucket_s") / F.when(k > 0, k)).alias("period_s"), known(ratio).alias("ratio"), known(strength).alias("strength"))


def beacon_findings(ev: DataFrame, keys: tuple[str, str] = ("src_ip", "domain"), least: int = 8, bound: float = 0.3, width: int = 60, peak: float = 6.0, most: int | None = 43_200) -> DataFrame:
    """Beacons of an address to a domain, whole: regularity, jitter about the median, spectrum and the events that show it.

    ``mad_jitter`` is the median distance of the intervals from their median, over that median; 0 where it is not above 0.  The spectrum
    is taken of what scores high enough only, with bins of ``width`` throughout if ``most`` is None, else with bins as wide as ``most``
    of them need.  Of the events the first and last hundred are named, all are counted.
    """
    keys = list(keys)
    rows = ev.filter(F.col(keys[0]).isNotNull() & F.col(keys[1]).isNotNull() & (F.col(keys[1]) != ""))
    found = stored(beacons(rows, keys, least, bound), "beacons")
    own = stored(rows.join(found.select(*keys, "median_gap"), keys).select(*keys, "us", "id", "median_gap"), "beacon-events")
    w = Window.partitionBy(*keys).orderBy("us", "id")
    spread = own.withColumn("_gap", (F.col("us") - F.lag("us").over(w)) / 1e6)
    ends = F.row_number().over(w)
    shown = spread.withColumn("_r", ends).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    kept = F.when((F.col("_r") <= 100) | (F.col("_r") > F.col("_n") - 100), F.struct("us", "id"))
    about = shown.groupBy(*keys).agg(F.median(F.abs(F.col("_gap") - F.col("median_gap"))).alias("mad"), F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["id"]).alias("event_ids"))
    out = found.join(about, keys).join(dominant_period(own.select(*keys, "us"), keys, width, most), keys, "left")
    out = out.withColumn("mad_jitter", F.when(F.col("median_gap") > 0, F.col("mad") / F.when(F.col("median_gap") > 0, F.col("median_gap"))).otherwise(F.lit(0.0)))
    return out.withColumn("has_peak", F.coalesce(F.col("ratio") >= peak, F.lit(False))).drop("mad")


def rare_domains(ev: DataFrame, most: int = 10) -> DataFrame:
    """(user, domain) pairs of domains that the whole log has few events of; score 1 / (1 + count)."""
    org = ev.groupBy("domain").agg(F.count(F.lit(1)).alias("org_count")).filter(F.col("org_count") <= most)
    pairs = ev.filter("principal is not null").groupBy("principal", "domain").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("first_us"))
    return pairs.join(org, "domain").withColumn("score", 1 / (1 + F.col("org_count")))


def hourly(ev: DataFrame, key: str) -> DataFrame:
    return buckets(ev, [key], 3600)


def residual_fallback(ev: DataFrame, key: str, least: int = 4, bound: float = 3.5) -> DataFrame:
    """Active hours far from their entity's median: the detector for series too short for seasons."""
    counted = hourly(ev, key).withColumn("x", F.col("n").cast("double"))
    enough = counted.groupBy(key).agg(F.count(F.lit(1)).alias("hours")).filter(F.col("hours") >= least)
    scored = with_robust_z(counted.join(enough, key), [key], "x")
    return scored.filter(F.abs("z") > bound).select(F.col(key).alias("entity_value"), "bucket_us", "n", "hours", F.when(F.abs("z") == float("inf"), F.lit(None)).otherwise(F.col("z")).alias("z"))


def _loess(y: np.ndarray, span: int) -> np.ndarray:
    """Locally linear smoothing with tricube weights over the ``span`` nearest points of an even grid."""
    n = len(y)
    span = min(span | 1, n if n % 2 else n - 1)
    if span < 3:
        return y.copy()
    half = span // 2
    offset = np.arange(-half, half + 1)
    w = (1 - np.abs(offset / (half + 1)) ** 3) ** 3
    padded = np.concatenate([2 * y[0] - y[half:0:-1], y, 2 * y[-1] - y[-2 : -half - 2 : -1]])
    return np.convolve(padded, w[::-1] / w.sum(), "valid")


def seasonal_residuals(y: np.ndarray, periods: tuple[int, ...], rounds: int = 3) -> np.ndarray:
    """What is left of a series after its smoothed seasons, one for each period, and its trend."""
    seasons = {p: np.zeros_like(y) for p in periods if len(y) >= 2 * p}
    trend = np.full_like(y, y.mean())
    for _ in range(rounds):
        for p in seasons:
            rest = y - trend - sum(s for q, s in seasons.items() if q != p)
            season = np.zeros_like(y)
            for k in range(p):
                season[k::p] = _loess(rest[k::p], 7)
            level = np.convolve(np.pad(season, (p // 2, p - 1 - p // 2), mode="edge"), np.full(p, 1 / p), "valid")
            seasons[p] = season - level
        flat = y - sum(seasons.values()) if seasons else y
        trend = _loess(flat, int(1.5 * max(seasons, default=24)) | 1)
    return np.round(y - trend - sum(seasons.values()) if seasons else y - trend, 6)


def seasonal_outliers(ev: DataFrame, key: str, bound: float = 3.5) -> DataFrame:
    """Hours whose residual lies far from those of the entity's active hours.

    From 336 hours on a day and a week are taken out, from 72 a day; shorter series go to the fallback.
    """
    counted = hourly(ev, key).filter(F.col(key).isNotNull())
    span = counted.groupBy(key).agg(((F.max("bucket_us") - F.min("bucket_us")) / 3.6e9 + 1).alias("span"))
    long_ = counted.join(span.filter("span >= 72"), key)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("bucket_us")
        at = ((part["bucket_us"] - part["bucket_us"].iloc[0]) // 3_600_000_000).to_numpy()
        y = np.zeros(int(at[-1]) + 1)
        y[at] = part["n"].to_numpy()
        r = seasonal_residuals(y, (24, 168) if len(y) >= 336 else (24,))[at]
        sd = r.std()
        out = part[[key, "bucket_us", "n"]].copy()
        out["z"] = (r - r.mean()) / sd if sd > 0 else 0.0
        return out[np.abs(out["z"]) > bound]

    kind = dict(ev.dtypes)[key]
    return long_.groupBy(key).applyInPandas(fit, f"`{key}` {kind}, bucket_us long, n long, z double")


def path_entropy(ev: DataFrame, keys: list[str], least: int = 5) -> DataFrame:
    """Mean character entropy of the paths of each pair, and mean share of random-looking segments."""
    paths = ev.filter("url_path is not null").groupBy(*keys, "url_path").agg(F.count(F.lit(1)).alias("times"))
    segments = path_segments(F.col("url_path"))
    n = F.size(segments)
    random_share = F.when(n > 0, F.size(F.filter(segments, is_random_segment)) / F.when(n > 0, n)).otherwise(F.lit(0.0))
    scored = paths.withColumn("h", text_entropy(F.col("url_path"))).withColumn("r", random_share)
    total = F.sum("times")
    return scored.groupBy(*keys).agg(total.alias("n"), (F.sum(F.col("h") * F.col("times")) / total).alias("mean_entropy"), (F.sum(F.col("r") * F.col("times")) / total).alias("random_share")).filter(F.col("n") >= least)


def path_outliers(pairs: DataFrame, domain: str = "domain", least: int = 20, q: float = 0.995) -> DataFrame:
    """Pairs above the exact percentile of their domain's pairs in either measure, for domains with enough pairs."""
    limits = pairs.groupBy(domain).agg(F.count(F.lit(1)).alias("pairs"), F.percentile("mean_entropy", q).alias("h_limit"), F.percentile("random_share", q).alias("r_limit")).filter(F.col("pairs") >= least)
    over = lambda x, lim: F.when(lim > 0, (x - lim) / F.when(lim > 0, lim)).otherwise(x)
    joined = pairs.join(limits, domain)
    score = F.greatest(over(F.col("mean_entropy"), F.col("h_limit")), over(F.col("random_share"), F.col("r_limit")))
    return joined.filter((F.col("mean_entropy") > F.col("h_limit")) | (F.col("random_share") > F.col("r_limit"))).withColumn("score", clamp01(score))


# -- generated names: a logistic score over five traits of a label ---------------------------------------


def label_traits(label: Column, bigrams: dict[str, float], unseen: float) -> list[Column]:
    """Entropy, mean negative log-probability of letter pairs, digit share, longest run of consonants, length / 32."""
    marked = F.concat(F.lit("^"), label, F.lit("$"))
    chars = F.filter(F.split(marked, ""), lambda c: c != "")
    # a map is looked through from its beginning: one for each first letter, so that a pair meets those of its own letter only
    firsts = "".join(sorted({p[0] for p in bigrams}))
    seconds = [sorted((p[1:], v) for p, v in bigrams.items() if p[0] == c) for c in firsts]
    table = F.array(*[F.create_map(*[F.lit(v) for pair in found for v in pair]) for found in seconds]) if bigrams else F.array(F.create_map(F.lit("?"), F.lit(unseen)))
    pairs = F.zip_with(chars, F.slice(chars, 2, F.size(chars) - 1), lambda a, b: F.coalesce(F.try_element_at(F.get(table, F.instr(F.lit(firsts), a) - 1), b), F.lit(unseen)))
    known = F.slice(pairs, 1, F.size(chars) - 1)  # the last letter has none after it
    surprise = -F.aggregate(known, F.lit(0.0), lambda acc, v: acc + v) / F.size(known)
    n = F.char_length(label)
    digits = F.when(n > 0, F.regexp_count(label, F.lit("[0-9]")) / F.when(n > 0, n)).otherwise(F.lit(0.0))
    runs = F.transform(F.regexp_extract_all(F.lower(label), F.lit("([b-df-hj-np-tv-z]+)"), 1), lambda r: F.char_length(r))
    longest = F.coalesce(F.array_max(runs), F.lit(0)).cast("double")
    return [text_entropy(label), surprise, digits, longest, n / 32.0]


def bigram_table(labels: DataFrame, column: str = "label") -> tuple[dict[str, float], float]:
    """Laplace-smoothed log-probabilities of letter pairs, ends marked; at most some thousand pairs reach the driver."""
    chars = F.filter(F.split(F.concat(F.lit("^"), F.col(column), F.lit("$")), ""), lambda c: c != "")
    pairs = labels.select(F.explode(F.zip_with(chars, F.slice(chars, 2, F.size(chars) - 1), lambda a, b: F.concat(a, b))).alias("p")).filter("p is not null")
    counts = {r["p"]: r["n"] for r in pairs.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, kinds = sum(counts.values()), len(counts) + 1
    return {p: float(np.log((n + 1) / (total + kinds))) for p, n in counts.items()}, float(np.log(1 / (total + kinds)))


def trained_names(labels: DataFrame, column: str = "label", y: str = "y") -> tuple[dict[str, float], float, list[float], float]:
    """(pairs, unseen, weights, bias) of labelled names: letter pairs from the benign ones only, then a balanced logistic machine."""
    pairs, unseen = bigram_table(labels.filter(F.col(y) == 0), column)
    traits = label_traits(F.col(column), pairs, unseen)
    named = labels.select(y, *[t.alias(f"t{i}") for i, t in enumerate(traits)])
    weights, bias = train_logistic(named, [f"t{i}" for i in range(len(traits))], y)
    return pairs, unseen, weights, bias


def logistic_scores(rows: DataFrame, traits: list[Column], weights: list[float], bias: float) -> DataFrame:
    z = F.lit(bias)
    for x, w in zip(traits, weights, strict=True):
        z = z + x * w
    return rows.withColumn("score", 1 / (1 + F.exp(-z)))


def train_logistic(rows: DataFrame, traits: list[str], label: str) -> tuple[list[float], float]:
    """Class-balanced logistic regression with Spark ML."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    share = rows.agg(F.avg(F.col(label).cast("double"))).first()[0]
    weighted = VectorAssembler(inputCols=traits, outputCol="features").transform(rows).withColumn("w", F.when(F.col(label) == 1, 0.5 / share).otherwise(0.5 / (1 - share))).withColumn("label", F.col(label).cast("double"))
    model = LogisticRegression(weightCol="w", maxIter=100).fit(weighted)
    return [float(v) for v in model.coefficients], float(model.intercept)


# -- evidence: order, claims ------------------------------------------------------------------------------


def nominate(rows: DataFrame, keys: list[str], start: str, end: str, eligible: str) -> DataFrame:
    """Add ``nominated``: eligible rows by start, then end, each unless an earlier one claimed an overlapping time of its key."""
    marked = rows.withColumn("_entity", F.to_json(F.struct(*keys)))
    taken = claimed(marked.filter(F.col(eligible)), "_entity", start, end).withColumnRenamed("claimed", "nominated")
    rest = marked.filter(~F.coalesce(F.col(eligible), F.lit(False))).withColumn("nominated", F.lit(False))
    return taken.unionByName(rest).drop("_entity")


def symbol_entropy(rows: DataFrame, keys: list[str], symbol: str) -> DataFrame:
    """Shannon entropy in bits of the symbols of each key."""
    counts = rows.groupBy(*keys, symbol).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    return counts.join(totals, keys).groupBy(*keys).agg(F.sum(entropy_bits(F.col("n"), F.col("total"))).alias("entropy"))


def z_columns(rows: DataFrame, keys: list[str], names: list[str], suffix: str, of: DataFrame | None = None) -> DataFrame:
    """Robust z of several columns over each key, medians of all of them in two aggregates.

    Medians are taken of the rows of ``of``, which are the same without columns that were joined to them since.
    """
    bare = (rows if of is None else of).select(*keys, *names)
    on = lambda a, b: [a[k].eqNullSafe(b[f"_k_{k}"]) for k in keys]
    med = bare.groupBy(*keys).agg(*[F.median(n).alias(f"_m_{n}") for n in names])
    med = med.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[f"_m_{n}" for n in names])
    off = [F.median(F.abs(F.col(n) - F.col(f"_m_{n}"))).alias(f"_d_{n}") for n in names]
    both = bare.join(med, on(bare, med)).groupBy(*[f"_k_{k}" for k in keys]).agg(*[F.first(f"_m_{n}").alias(f"_m_{n}") for n in names], *off)
    out = rows.join(both, on(rows, both)).drop(*[f"_k_{k}" for k in keys])
    for n in names:
        out = out.withColumn(f"{n}{suffix}", robust_z(F.col(n).cast("double"), F.col(f"_m_{n}"), F.col(f"_d_{n}")))
    return out.drop(*[f"_m_{n}" for n in names], *[f"_d_{n}" for n in names])
