"""Historical baselines: windows, profiles, contacts; and where a value lies in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import nearest_rank, percentile_of


def baseline_windows(ev: DataFrame, key: str, seconds: int = 21_600) -> DataFrame:
    """(entity_value, window_us, metric, value) per active window."""
    width = seconds * 1_000_000
    w = ev.groupBy(F.col(key).alias("entity_value"), (F.floor(F.col("us") / width) * width).cast("long").alias("window_us")).agg(F.count(F.lit(1)).cast("double").alias("requests"), F.sum("bytes_out").cast("double").alias("bytes_out"), F.count_distinct("domain").cast("double").alias("domains"))
    return w.unpivot(["entity_value", "window_us"], ["requests", "bytes_out", "domains"], "metric", "value")


def profiles(windows: DataFrame) -> DataFrame:
    """(entity_value, metric, p50, p95, p99, mean, mad, n_windows); percentiles are elements, not interpolated.

    An entity has few windows (four a day), so their values fit an array; events are never collected.
    """
    a = windows.groupBy("entity_value", "metric").agg(F.array_sort(F.collect_list("value")).alias("v"), F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n_windows"))
    a = a.withColumn("p50", nearest_rank(F.col("v"), 0.5)).withColumn("p95", nearest_rank(F.col("v"), 0.95)).withColumn("p99", nearest_rank(F.col("v"), 0.99))
    mad = nearest_rank(F.transform("v", lambda x: F.abs(x - F.col("p50"))), 0.5)
    return a.withColumn("mad", mad).drop("v")


def contacts(ev: DataFrame) -> DataFrame:
    """(scope, scope_value, domain, contact_count, first_us, last_us) for users, departments and the organisation, from one count of pairs."""
    pairs = ev.groupBy("principal", "department", "domain").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    each = F.array(F.struct(F.lit("user").alias("scope"), F.col("principal").alias("scope_value")), F.struct(F.lit("department").alias("scope"), F.col("department").alias("scope_value")), F.struct(F.lit("org").alias("scope"), F.lit("org").alias("scope_value")))
    rows = pairs.select("domain", "n", "first_us", "last_us", F.explode(each).alias("s")).select("s.*", "domain", "n", "first_us", "last_us").filter("scope_value is not null")
    return rows.groupBy("scope", "scope_value", "domain").agg(F.sum("n").alias("contact_count"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))


def resolved(values: DataFrame, prof: DataFrame, least: int = 20) -> DataFrame:
    """Add percentile and status to rows of (entity_value, metric, value): ok, insufficient_history or no_baseline."""
    p = prof.select("entity_value", "metric", "p50", "mad", "n_windows")
    joined = values.join(p, ["entity_value", "metric"], "left")
    status = F.when(F.col("n_windows").isNull(), "no_baseline").when(F.col("n_windows") < least, "insufficient_history").otherwise("ok")
    return joined.withColumn("status", status).withColumn("percentile", percentile_of(F.col("value"), F.col("p50"), F.col("mad"), F.col("n_windows"), least))


def contact_history(pairs: DataFrame, seen: DataFrame) -> DataFrame:
    """Add the counts of a (principal, department, domain) at its three scopes, first-contact flags and rarity."""
    out = pairs
    for scope, key in (("user", "principal"), ("department", "department"), ("org", None)):
        c = seen.filter(F.col("scope") == scope).select(F.col("domain").alias("_d"), F.col("scope_value").alias("_v"), F.col("contact_count").alias(f"{scope}_count"))
        on = F.col("domain") == F.col("_d")
        out = out.join(c, on & (F.col(key) == F.col("_v")) if key else on, "left").drop("_d", "_v").withColumn(f"{scope}_count", F.coalesce(f"{scope}_count", F.lit(0))).withColumn(f"first_{scope}_contact", F.col(f"{scope}_count") == 0)
    return out.withColumn("baseline_rarity", 1 / (1 + F.col("org_count")))


def entity_baseline(ev: DataFrame, key: str, before_us: int, hours: int = 168) -> DataFrame:
    """(entity, mean, p95, sd, n_hours) of the hourly counts in the hours before a time."""
    past = ev.filter((F.col("us") < before_us) & (F.col("us") >= before_us - hours * 3_600_000_000))
    h = past.groupBy(key, F.floor(F.col("us") / 3_600_000_000).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return h.groupBy(key).agg(F.avg("n").alias("mean"), F.percentile("n", 0.95).alias("p95"), F.stddev_pop("n").alias("sd"), F.count(F.lit(1)).alias("n_hours"))
