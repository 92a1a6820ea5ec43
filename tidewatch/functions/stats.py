"""Statistics as columns: robust z, entropy, nearest-rank percentiles, normal distribution, finite numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: 0.6745: the normal distribution's quartile, which scales a median absolute deviation to a standard one.
QUARTILE = 0.6745


def finite(x: Column, nan: float = 0.0, infinite: float = 100.0) -> Column:
    """NaN and null become ``nan``, infinities ``infinite`` with their sign; Spark sorts NaN above all numbers."""
    big = F.when(x == float("inf"), F.lit(infinite)).when(x == float("-inf"), F.lit(-infinite)).otherwise(x)
    return F.when(x.isNull() | F.isnan(x), F.lit(nan)).otherwise(big)


def rounded(x: Column, digits: int) -> Column:
    """To so many digits, halves away from zero, by arithmetic on doubles as DuckDB rounds them; ``F.round`` goes by way of decimal text."""
    scaled = F.abs(x) * F.lit(10.0**digits)
    return F.when(scaled < 2.0**52, F.signum(x) * F.floor(scaled + 0.5) / F.lit(10.0**digits)).otherwise(x)  # whole beyond that; NaN and null stay


def clamp01(x: Column) -> Column:
    """To the range 0 to 1; NaN is 0."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), finite(x, 0.0, 2.0)))


def robust_z(x: Column, median: Column, mad: Column) -> Column:
    """0.6745 (x - median) / MAD; where the MAD is 0, 0 at the median and unsigned infinity off it."""
    flat = F.when(x == median, F.lit(0.0)).otherwise(F.lit(float("inf")))
    return F.when(mad == 0, flat).otherwise(F.lit(QUARTILE) * (x - median) / F.when(mad != 0, mad))


def with_robust_z(rows: DataFrame, keys: list[str], value: str, name: str = "z") -> DataFrame:
    """Add median, mad and ``name`` over all rows of each key, the row itself included.

    Two aggregates joined back, not two window passes: a key with very many rows is reduced before it meets
    its rows, and its rows may stay in several tasks.
    """
    med = rows.groupBy(*keys).agg(F.median(value).alias("median"))
    with_median = rows.join(med, keys)
    mad = with_median.groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))
    return with_median.join(mad, keys).withColumn(name, robust_z(F.col(value), F.col("median"), F.col("mad")))


def entropy_bits(counts: Column, total: Column) -> Column:
    """One symbol's part of Shannon's entropy: sum it over the symbols."""
    p = counts / total
    return -p * F.log2(p)


def text_entropy(text: Column) -> Column:
    """Shannon entropy in bits of a text's characters; 0 for the empty one."""
    n = F.char_length(text)
    parts = F.transform(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")), lambda c: (n - F.char_length(F.replace(text, c, F.lit("")))) / n)
    return F.aggregate(parts, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))


def nearest_rank(values: Column, q: float) -> Column:
    """Element at place floor(q n) of the sorted values (from 0), the last one at most."""
    s = F.array_sort(values)
    at = F.least(F.floor(F.size(s) * F.lit(q)), F.size(s) - 1).cast("int")
    return F.element_at(s, at + 1)


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution function; absolute error under 7.5e-8.

    Fixed values: the five coefficients and p of Abramowitz and Stegun 26.2.17.
    """
    p = 0.2316419
    b = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1 / (1 + p * F.abs(x))
    poly = t * (b[0] + t * (b[1] + t * (b[2] + t * (b[3] + t * b[4]))))
    upper = poly * F.exp(-x * x / 2) / F.lit(2.5066282746310002)
    return F.when(x >= 0, 1 - upper).otherwise(upper)


def percentile_of(x: Column, p50: Column, mad: Column, n: Column, least: int = 20) -> Column:
    """Where x lies in a profile, in percent; null where the profile has fewer than ``least`` windows."""
    z = F.when(mad == 0, F.when(x == p50, F.lit(0.0)).when(x > p50, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))).otherwise(QUARTILE * (x - p50) / F.when(mad != 0, mad))
    cdf = F.when(z == float("inf"), F.lit(1.0)).when(z == float("-inf"), F.lit(0.0)).otherwise(normal_cdf(z))
    return F.when(n >= least, cdf * 100)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0088) -> Column:
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def share(condition: Column) -> Column:
    """The share of rows where the condition holds; null counts as no."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def running_share(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Add ``rank`` (from 1) and ``part`` of each row within its key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return rows.withColumn("rank", F.row_number().over(w)).withColumn("part", F.col("rank") / n)
