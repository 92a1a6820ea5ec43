"""Incidents in words and tags, signatures for sharing, re-scoring and measures of whole runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import stored
from .graph import fused, severity

#: Techniques with their tactic and the incident type that they stand for.
TECHNIQUES = {
    "T1071": ("command-and-control", "c2"), "T1071.001": ("command-and-control", "c2"), "T1568.002": ("command-and-control", "c2"), "T1090": ("command-and-control", "proxy_evasion"), "T1048": ("exfiltration", "exfiltration"),
    "T1567": ("exfiltration", "exfiltration"), "T1567.002": ("exfiltration", "exfiltration"), "T1204": ("execution", "malware"), "T1105": ("command-and-control", "malware"), "T1566": ("initial-access", "phishing"), "T1078": ("defense-evasion", "account_misuse"),
    "T1530": ("collection", "mass_download"), "T1595": ("reconnaissance", "scanning"),
}


def shortened(value: Column, longest: int = 24) -> Column:
    return F.when(F.char_length(value) > longest, F.concat(F.substring(value, 1, longest - 1), F.lit("…"))).otherwise(value)


def titles(incidents: DataFrame) -> DataFrame:
    """Add ``title`` to rows of (incident_id, technique, entity_value, severity)."""
    kind = F.coalesce(_lookup(F.col("technique"), 1), F.lit("suspicious activity"))
    return incidents.withColumn("title", F.concat(F.initcap(F.replace(kind, F.lit("_"), F.lit(" "))), F.lit(": "), shortened(F.col("entity_value"))))


def _lookup(technique: Column, part: int) -> Column:
    """A technique's tactic or type; a sub-technique without its own falls back to its base."""
    table = F.create_map(*[F.lit(v) for t, pair in TECHNIQUES.items() for v in (t, pair[part])])
    return F.coalesce(F.try_element_at(table, technique), F.try_element_at(table, F.substring_index(technique, ".", 1)))


def main_technique(signals: DataFrame) -> DataFrame:
    """(incident_id, technique): the most frequent one, the smallest of equals."""
    n = signals.filter("technique is not null").groupBy("incident_id", "technique").agg(F.count(F.lit(1)).alias("n"))
    first = n.groupBy("incident_id").agg(F.max("n").alias("n")).join(n, ["incident_id", "n"])
    return first.groupBy("incident_id").agg(F.min("technique").alias("technique"))


def summaries(signals: DataFrame) -> DataFrame:
    """(incident_id, summary): three sentences from counts, detectors and the time spanned."""
    a = signals.groupBy("incident_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("detector_key")).alias("d"), F.count_distinct("entity_value").alias("e"), F.min("start_us").alias("s"), F.max("end_us").alias("t"))
    plural = lambda n, word: F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))
    k = F.size("d")
    listed = F.when(k == 1, F.element_at("d", 1)).when(k == 2, F.array_join("d", " and ")).otherwise(F.concat(F.array_join(F.slice("d", F.lit(1), F.greatest(k - 1, F.lit(1))), ", "), F.lit(", and "), F.element_at("d", -1)))
    when = F.when(F.col("s").isNull(), F.lit("No time is known.")).otherwise(F.concat(F.lit("It spans "), F.format_number((F.col("t") - F.col("s")) / 3.6e9, 1), F.lit(" hours.")))
    return a.select("incident_id", F.concat_ws(" ", F.concat(plural(F.col("n"), "signal"), F.lit(" on "), F.when(F.col("e") == 1, "1 entity").otherwise(F.concat(F.col("e").cast("string"), F.lit(" entities"))), F.lit(".")), F.concat(F.lit("Raised by "), listed, F.lit(".")), when).alias("summary"))


def asset_tags(rows: DataFrame) -> DataFrame:
    """(incident_id, tags) of evidence events: device, system, department, location, application, risk, bypass, shared devices."""
    version = F.regexp_extract("os_version", r"^(\d+(?:\.\d+)?)", 1)
    risk = F.when(F.col("risk_score") >= 75, "risk:high").when(F.col("risk_score") >= 40, "risk:medium").when(F.col("risk_score").isNotNull(), "risk:low")
    slug = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")
    tag = lambda name, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{name}:"), slug(c)))
    each = F.array_compact(F.array(tag("device", F.col("device_name")), tag("os", F.col("os_type")), F.when(version != "", F.concat(F.lit("os-version:"), version)), tag("dept", F.col("department")), tag("location", F.col("location")), tag("app", F.col("app_name")), risk, F.when(F.col("bypassed_traffic"), F.lit("bypassed")), tag("flow", F.col("flow_type"))))
    plain = rows.select("incident_id", F.explode(each).alias("tag"))
    shared = rows.filter("device_name is not null").groupBy("incident_id", "device_name").agg(F.count_distinct("principal").alias("n")).filter("n > 1").select("incident_id", F.lit("shared-device").alias("tag"))
    return plain.unionByName(shared).groupBy("incident_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def signatures(verdicts: DataFrame) -> DataFrame:
    """Rows fit to be shared: true positives and those that need review, with a known type; identities are not among the columns."""
    kind = _lookup(F.col("technique"), 1)
    rows = verdicts.filter(F.col("disposition").isin("true_positive", "needs_review")).withColumn("incident_type", kind).filter("incident_type is not null")
    return rows.select("incident_id", "tenant_hash", "incident_type", "technique", "confidence", "indicator_hashes")


def rescored(signals: DataFrame, stored: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(incident_id, old, new, severity_changed): fusion again, with each incident's real density."""
    now = fused(signals, weights).select("incident_id", F.col("fused_score").alias("new"))
    joined = stored.select("incident_id", F.col("fused_score").alias("old")).join(now, "incident_id")
    return joined.withColumn("severity_changed", severity(F.col("old")) != severity(F.col("new")))


def recall_and_fragmentation(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(recall, fragmentation) over rows (scenario_id, incident_id) and all scenarios: share found, incidents for each found one."""
    per = found.distinct().groupBy("scenario_id").agg(F.count_distinct("incident_id").alias("n"))
    return truth.select("scenario_id").distinct().join(per, "scenario_id", "left").agg((F.count("n") / F.count(F.lit(1))).alias("recall"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("fragmentation"))


def latency(rows: DataFrame, column: str) -> DataFrame:
    """(p50, p95, n): exact percentiles, between two values by their distance, of what is not null.

    Values are counted, dealt into ranges and numbered in each, so that no task holds more than a range: one row a range tells what lies before.
    """
    counted = rows.select(F.col(column).cast("double").alias("x")).filter("x is not null").groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    values = stored(counted.repartitionByRange("x").withColumn("part", F.spark_partition_id()), "values")
    by_part = Window.orderBy("part")
    parts = values.groupBy("part").agg(F.sum("n").alias("in")).select("part", (F.sum("in").over(by_part) - F.col("in")).alias("before"), F.sum("in").over(Window.partitionBy()).alias("total"))
    stop = F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("x"))
    placed = values.join(F.broadcast(parts), "part").withColumn("stop", stop)

    def percentile(q: float) -> Column:
        place = (F.col("total") - 1) * F.lit(q)
        at = lambda p: F.max(F.when((F.col("stop") > p) & (F.col("stop") - F.col("n") <= p), F.col("x")))
        low, high, exact = at(F.floor(place)), at(F.ceil(place)), F.max(place)
        return F.when(F.floor(exact) == F.ceil(exact), low).otherwise((F.ceil(exact) - exact) * low + (exact - F.floor(exact)) * high)

    return placed.agg(percentile(0.5).alias("p50"), percentile(0.95).alias("p95"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def best_model(rows: DataFrame) -> DataFrame:
    """The model with the highest mean F2, then average precision, then name."""
    return rows.groupBy("model").agg(F.avg("f2").alias("f2"), F.avg("average_precision").alias("average_precision")).orderBy(F.desc("f2"), F.desc("average_precision"), "model").limit(1)
