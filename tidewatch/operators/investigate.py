"""What an analyst or an agent asks for: timelines, related signals, evidence and queues of work, all of bounded size."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that one answer has at most, minutes that a timeline is padded by at most, percentile from which a row is nominated, incidents that are triaged.
ROWS, PAD_MINUTES, NOMINATED, TRIAGED = 200, 24 * 60, 99.5, 20
#: Domains looked at for their meaning, and contacts of the organisation up to which one is rare.
CANDIDATES, RARE_CONTACTS = 20, 2
#: Columns that all layers' signals share.
SIGNAL = {"layer": "string", "detector_key": "string", "entity_type": "string", "entity_value": "string", "start_us": "long", "end_us": "long", "raw_score": "double", "confidence": "double", "technique": "string", "event_ids": "array<bigint>"}


def clamped(n: int | None, most: int = ROWS) -> int:
    """A wanted number of rows between 1 and ``most``; without one, ``most``."""
    return max(1, min(int(n or most), most))


def selected(ev: DataFrame, limit: int | None = None, from_us: int | None = None, to_us: int | None = None, **equal: object) -> DataFrame:
    """Events by equal columns and times, the first by time, a bounded number; a null value asks for nothing."""
    tests = [F.col(c) == F.lit(v) for c, v in equal.items() if v is not None]
    tests += [F.col("us") >= from_us] if from_us is not None else []
    tests += [F.col("us") <= to_us] if to_us is not None else []
    rows = ev.filter(functools.reduce(operator.and_, tests)) if tests else ev
    return rows.orderBy("us", "id").limit(clamped(limit))


def timeline(ev: DataFrame, column: str, value: str, start_us: int, end_us: int, minutes: int = 120) -> DataFrame:
    """An entity's events from before a window to after it, padded by minutes within a day, the first ROWS."""
    pad = max(1, min(int(minutes or 120), PAD_MINUTES)) * 60_000_000
    return selected(ev, None, start_us - pad, end_us + pad, **{column: value})


def related(signals: DataFrame, entity_type: str, value: str) -> DataFrame:
    """All signals of an entity, the most confident first."""
    return signals.filter((F.col("entity_type") == entity_type) & (F.col("entity_value") == value)).orderBy(F.desc("confidence"))


def accessed(e: DataFrame, users: DataFrame, most: int = ROWS) -> DataFrame:
    """The domains that the users (type, value) reached, by weight: entity, edge, entity."""
    own = users.filter("type = 'user'").select(F.col("value").alias("src"))
    return e.filter("relation = 'accessed'").join(own, "src", "left_semi").orderBy(F.desc("weight"), "src", "dst").limit(clamped(most)).select("src", "dst", "event_count", "weight")


def proxied(ev: DataFrame) -> DataFrame:
    """Events of the proxy: those with a domain."""
    return ev.filter("domain is not null and domain <> ''")


def any_percentile(measures: Column, least: float) -> Column:
    """Whether some measure whose name ends in ``percentile`` reaches ``least``."""
    return F.size(F.map_filter(measures, lambda k, v: k.endswith("percentile") & (v >= least))) > 0


def eligible(measures: Column, first_contact: Column) -> Column:
    """Whether evidence may be nominated: a percentile above NOMINATED, or the organisation's first contact."""
    above = F.size(F.map_filter(measures, lambda k, v: k.endswith("percentile") & (v > NOMINATED))) > 0
    return F.coalesce(above, F.lit(False)) | F.coalesce(first_contact, F.lit(False))


def evidence(rows: DataFrame, extractor: str | None = None, entity: str | None = None, line: int | None = None, least: float | None = None) -> DataFrame:
    """Evidence by extractor, entity, a line that it cites and the least of any percentile."""
    tests = [F.lit(True)]
    tests += [F.col("extractor") == extractor] if extractor is not None else []
    tests += [F.col("entity_value") == entity] if entity is not None else []
    tests += [F.array_contains("lines", F.lit(line).cast("long"))] if line is not None else []
    tests += [any_percentile(F.col("measures"), least)] if least is not None else []
    return rows.filter(functools.reduce(operator.and_, tests))


def needs_attention(disposition: Column, citation_valid: Column) -> Column:
    """No verdict, a verdict that asks for review, or one whose citations do not hold."""
    return disposition.isNull() | (disposition == "needs_review") | F.coalesce(~citation_valid, F.lit(False))


def to_triage(incidents: DataFrame, most: int = TRIAGED) -> DataFrame:
    """The incidents with the highest scores, ties by id."""
    return incidents.orderBy(F.desc("fused_score"), "incident_id").limit(most)


def semantic_candidates(destinations: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """Destinations seen for the first time, then those with few contacts of the organisation, fewest first."""
    key = F.when(F.col("first_observed"), F.lit(0)).when(F.col("org_count").between(1, RARE_CONTACTS), F.col("org_count"))
    return destinations.withColumn("_k", key).filter("_k is not null").orderBy("_k", "domain").limit(most).drop("_k")


def to_event_ids(rows: DataFrame, ev: DataFrame, keys: list[str], lines: str = "lines") -> DataFrame:
    """(keys, event_ids): cited line numbers as ids of events, lines without an event left out."""
    cited = rows.select(*keys, F.explode(lines).alias("line_no"))
    found = cited.join(ev.select("line_no", "id"), "line_no").groupBy(*keys).agg(F.array_sort(F.collect_set("id")).alias("event_ids"))
    return rows.select(*keys).distinct().join(found, keys, "left").withColumn("event_ids", F.coalesce("event_ids", F.array().cast("array<bigint>")))


def malicious(windows: DataFrame, labels: DataFrame, lines: str = "lines") -> DataFrame:
    """Add ``malicious``: whether a window holds a labelled line; ``labels`` has line_no."""
    keyed = windows.withColumn("_row", F.xxhash64(*windows.columns))
    bad = keyed.select("_row", F.explode(lines).alias("line_no")).join(labels.select("line_no").distinct(), "line_no", "left_semi").select("_row").distinct().withColumn("malicious", F.lit(True))
    return keyed.join(bad, "_row", "left").withColumn("malicious", F.coalesce("malicious", F.lit(False))).drop("_row")


def caught(evidence_lines: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled lines that some evidence cites: the intersection of both, each once."""
    return evidence_lines.select("line_no").intersect(labels.select("line_no"))


def all_signals(*layers: DataFrame) -> DataFrame:
    """Signals of several layers under SIGNAL's columns; a column that a layer lacks is null."""
    shaped = [df.select(*[F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in SIGNAL.items()]) for df in layers]
    return functools.reduce(DataFrame.unionByName, shaped)


def confident_entities(scored: DataFrame, key: str, least: float = 0.7) -> DataFrame:
    """(key, max_confidence, windows): the highest confidence of each entity and how many of its windows reach ``least``."""
    return scored.groupBy(key).agg(F.max("confidence").alias("max_confidence"), F.count_distinct(F.when(F.col("confidence") >= least, F.col("hour_us"))).alias("windows"))
