"""Written claims against evidence, by joins: do cited things exist, are numbers in the evidence, is all of it in scope.

A claim's numbers, in all their readings, meet the evidence's numeric leaves in an equi-join on buckets of their logarithm.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import forget, stored

#: Units with their readings in bytes or seconds; percentages are read as they stand.
BYTES = {"b": 0, "byte": 0, "bytes": 0, "kb": 1, "mb": 2, "gb": 3, "tb": 4}
SECONDS = {
    "ms": 1e-3, "millisecond": 1e-3, "milliseconds": 1e-3, "s": 1, "sec": 1, "secs": 1, "second": 1, "seconds": 1, "min": 60, "mins": 60, "minute": 60, "minutes": 60,
    "h": 3600, "hr": 3600, "hrs": 3600, "hour": 3600, "hours": 3600,
}
PERCENT = ("%", "percent", "percentile")
#: What looks like a number and isn't (techniques, citations, times, pseudonyms, addresses), keys whose numbers name things.
NOISE = (
    r"\bT\d{4}(?:\.\d{3})?\b", r"\b(?:EVIDENCE|BASELINE|LOG)-\d+\b", r"\bMITRE-T\d{4}(?:\.\d{3})?\b", r"\b[A-Z]+-KB-[\w-]+\b", r"\b\d{4}-\d{2}-\d{2}(?:T[\d:.]+Z?)?\b",
    r"\b\d{1,2}:\d{2}(?::\d{2})?\b", r"(?i)\b(?:u|ip|h|sess|dev|d|fh|j)_[0-9a-f]{6,}\b", r"\b\d{1,3}(?:\.\d{1,3}){3}\b",
)
NAMES = ("id", "evidence_id", "log_id", "baseline_id", "raw_line_no")
#: How far a number that is no plain count may be off, the least size that it is compared with, hours around an incident.
TOLERANCE, LEAST, SLACK_US = 0.01, 1e-9, 3_600_000_000

_UNITS = sorted([*BYTES, *SECONDS, *PERCENT[1:]], key=lambda u: (-len(u), u))
_NUMBER = r"[-+]?\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+\.\d+|\d+"
_MEASURE = rf"(?i)({_NUMBER})\s*(%|(?:{'|'.join(_UNITS)})(?![A-Za-z]))?"
_BUCKET = math.log(1 + 2 * TOLERANCE)


def numbers(text: Column) -> Column:
    """Of each number of a text (raw, unit, is_count, readings): an array of structs, in order; noise is taken out first.

    A whole number without a unit is a count.  A size has its decimal and its binary reading, a time is in seconds.
    """
    clean = text
    for pattern in NOISE:
        clean = F.regexp_replace(clean, pattern, " ")
    found = F.regexp_extract_all(clean, F.lit(_MEASURE), F.lit(0))
    powers = F.create_map(*[F.lit(x) for u, k in BYTES.items() for x in (u, float(k))])
    factors = F.create_map(*[F.lit(x) for u, k in SECONDS.items() for x in (u, float(k))])

    def read(raw: Column) -> Column:
        digits, unit = F.regexp_extract(raw, _MEASURE, 1), F.lower(F.regexp_extract(raw, _MEASURE, 2))
        value = F.regexp_replace(digits, ",", "").cast("double")
        power, factor = F.try_element_at(powers, unit), F.try_element_at(factors, unit)
        readings = F.when(power > 0, F.array(value * F.pow(F.lit(1000.0), power), value * F.pow(F.lit(1024.0), power))).otherwise(F.array(value * F.coalesce(factor, F.lit(1.0))))
        return F.struct(F.trim(raw).alias("raw"), F.nullif(unit, F.lit("")).alias("unit"), ((unit == "") & ~F.contains(digits, F.lit("."))).alias("is_count"), readings.alias("readings"))

    return F.transform(found, read)


def numeric_leaves(rows: DataFrame, body: str, keys: list[str]) -> DataFrame:
    """(keys, value) of each number in a JSON text, however deep; what stands under one of ``NAMES`` is left out.

    Texts of digits, booleans and nulls are no numbers.  Each round opens one level of objects and lists, so there are as many
    rounds as levels.  A text that is no JSON has no leaves.
    """
    spark = rows.sparkSession
    open_ = rows.select(*keys, F.try_parse_json(F.col(body)).alias("_v"), F.lit(None).cast("string").alias("_key"))
    found, held = None, []
    while True:
        kind, named = F.schema_of_variant("_v"), F.col("_key").isNotNull() & F.col("_key").isin(*NAMES)
        value = F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get("_v", "$", "double"))
        inside = F.when(kind.rlike("^(OBJECT|ARRAY)"), F.to_json("_v"))
        level = stored(open_.filter(F.col("_v").isNotNull() & ~named).select(*keys, value.alias("value"), inside.alias("_inside")), "leaves")
        held.append(level)
        here = level.select(*keys, "value").filter("value is not null")
        found = here if found is None else found.unionByName(here)
        inner = level.filter("_inside is not null")
        if not inner.limit(1).count():
            break
        open_ = inner.select(*keys, F.parse_json("_inside").alias("_o")).lateralJoin(spark.tvf.variant_explode(F.col("_o").outer())).select(*keys, F.col("value").alias("_v"), F.col("key").alias("_key"))
    out = stored(found, "numbers")
    forget(*held)
    return out


def _bucket(x: Column) -> Column:
    return F.floor(F.log(F.greatest(F.abs(x), F.lit(LEAST))) / _BUCKET)


def matched(wanted: DataFrame, pool: DataFrame, key: str, number: str) -> DataFrame:
    """The ids ``number`` of wanted (key, number, is_count, readings) that the pool (key, value) bears out.

    A count must be there exactly, anything else within one hundredth.  Values that close lie in one bucket of their logarithm
    or in neighbouring ones, so the join is on equality; the pool is made distinct first.
    """
    leaves = pool.select(key, "value").distinct().withColumn("_b", F.explode(F.array(*[_bucket(F.col("value")) + d for d in (-1, 0, 1)])))
    rows = wanted.select(key, number, "is_count", F.explode("readings").alias("_r")).withColumn("_b", _bucket(F.col("_r")))
    near = F.abs(F.col("_r") - F.col("value")) / F.greatest(F.abs(F.col("value")), F.lit(LEAST)) <= TOLERANCE
    return rows.join(leaves, [key, "_b"]).filter(F.when(F.col("is_count"), F.col("_r") == F.col("value")).otherwise(near)).select(number).distinct()


def citations(claims: DataFrame) -> DataFrame:
    """(claim_id, incident_id, cited, namespace, name) of each cited id: evidence, log, technique, knowledge, signal or unknown."""
    rows = claims.select("claim_id", "incident_id", F.explode(F.array_distinct("cited")).alias("cited"))
    c = F.col("cited")
    technique = F.regexp_extract(c, r"^(?:MITRE-)?(T\d{4}(?:\.\d{3})?)$", 1)
    namespace = F.when(c.rlike(r"^(EVIDENCE|BASELINE)-\d+$"), "evidence").when(c.rlike(r"^LOG-\d+$"), "log").when(technique != "", "technique").when(c.rlike(r"^[A-Z]+-KB-[\w-]+$"), "knowledge").when(c.rlike(r"^\d+$"), "signal").otherwise("unknown")
    return rows.select("claim_id", "incident_id", "cited", namespace.alias("namespace"), F.when(technique != "", technique).when(c.startswith("LOG-"), F.substring(c, 5, 40)).otherwise(c).alias("name"))


def checked(claims: DataFrame, evidence: DataFrame, events: DataFrame, scope: DataFrame, techniques: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Claims (claim_id, incident_id, text, cited) with existence_ok, numeric_ok, retrieval_ok, scope_ok and a status.

    ``evidence`` has (incident_id, evidence_id, body), bodies in JSON; ``events`` (line_no, us, entity, numbers), one row a line and
    entity of it, with its numbers; ``scope`` (incident_id, entity, from_us, to_us), one row an entity; ``techniques`` (technique),
    ``retrieved`` (incident_id, technique).  Numbers are looked for in all evidence of the incident and in cited lines.  A line is in
    scope if one of its entities is the incident's and its time at most an hour outside.  The status is the first that fails of uncited,
    unknown_evidence, unsupported_number, unretrieved_technique and out_of_scope, or valid.
    """
    cites = stored(citations(claims), "citations")
    lines = cites.filter("namespace = 'log'").withColumn("line_no", F.expr("try_cast(name as bigint)"))
    used = stored(lines.join(events, "line_no").select("claim_id", "incident_id", "cited", "us", "entity", "numbers"), "lines")
    found = evidence.select("incident_id", F.col("evidence_id").alias("name")).distinct().withColumn("namespace", F.lit("evidence")).withColumn("_there", F.lit(True))
    there = cites.join(found, ["incident_id", "name", "namespace"], "left").join(techniques.select(F.col("technique").alias("name")).distinct().withColumn("_known", F.lit(True)), "name", "left")
    there = there.join(used.select("claim_id", "cited").distinct().withColumn("_line", F.lit(True)), ["claim_id", "cited"], "left")
    there = there.join(retrieved.select("incident_id", F.col("technique").alias("name")).distinct().withColumn("_got", F.lit(True)), ["incident_id", "name"], "left")
    kind = F.col("namespace")
    exists = F.when(kind == "evidence", F.col("_there")).when(kind == "log", F.col("_line")).when(kind == "technique", F.col("_known")).otherwise(kind.isin("knowledge", "signal"))
    held = F.coalesce(exists, F.lit(False))
    by_claim = there.groupBy("claim_id").agg(F.count_if(~held).alias("missing"), F.count_if(held & (kind == "technique") & F.col("_got").isNull()).alias("unretrieved"))
    inside = used.join(scope, ["incident_id", "entity"], "left").groupBy("claim_id", "cited").agg(F.max(F.col("us").between(F.col("from_us") - SLACK_US, F.col("to_us") + SLACK_US)).alias("inside"))
    by_line = inside.groupBy("claim_id").agg(F.count_if(~F.coalesce("inside", F.lit(False))).alias("outside"))
    wanted = stored(claims.select("claim_id", "incident_id", F.posexplode(numbers(F.col("text"))).alias("at", "n")).select("claim_id", "incident_id", F.struct("claim_id", "at").alias("number"), "n.*"), "wanted")
    pool = stored(numeric_leaves(evidence, "body", ["incident_id"]).distinct(), "pool")
    own = used.select("claim_id", F.explode("numbers").alias("value"))
    held_up = matched(wanted, pool, "incident_id", "number").unionByName(matched(wanted, own, "claim_id", "number")).distinct()
    by_number = wanted.join(held_up.withColumn("_ok", F.lit(True)), "number", "left").groupBy("claim_id").agg(F.count_if(F.col("_ok").isNull()).alias("mismatched"))
    out = claims
    for part, name in ((by_claim, "missing"), (by_claim, "unretrieved"), (by_line, "outside"), (by_number, "mismatched")):
        out = out.join(part.select("claim_id", name), "claim_id", "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))
    ok = {"existence_ok": F.col("missing") == 0, "numeric_ok": F.col("mismatched") == 0, "retrieval_ok": F.col("unretrieved") == 0, "scope_ok": F.col("outside") == 0}
    status = F.when(F.coalesce(F.size("cited"), F.lit(0)) <= 0, "uncited").when(~ok["existence_ok"], "unknown_evidence").when(~ok["numeric_ok"], "unsupported_number").when(~ok["retrieval_ok"], "unretrieved_technique").when(~ok["scope_ok"], "out_of_scope").otherwise("valid")
    return out.select(*claims.columns, *[c.alias(n) for n, c in ok.items()], status.alias("status"))


def invalid_share(claims: DataFrame) -> DataFrame:
    """(incident_id, claims, invalid, rate)."""
    a = claims.groupBy("incident_id").agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("status") != "valid").alias("invalid"))
    return a.withColumn("rate", F.col("invalid") / F.col("claims"))


def evidence_confidence(items: DataFrame, capped: dict[int, float]) -> DataFrame:
    """(evidence_id, confidence, band) of rubric rows (evidence_id, item, weight, met); a missed item may cap the result."""
    met = F.sum(F.when(F.col("met"), F.col("weight")).otherwise(F.lit(0.0)))
    cap = F.lit(1.0)
    for item, bound in capped.items():
        cap = F.least(cap, F.min(F.when((F.col("item") == item) & ~F.col("met"), F.lit(bound)).otherwise(F.lit(1.0))))
    a = items.groupBy("evidence_id").agg(met.alias("_met"), F.sum("weight").alias("_all"), cap.alias("_cap"))
    c = F.least(F.col("_met") / F.col("_all"), F.col("_cap"))
    return a.select("evidence_id", c.alias("confidence"), F.when(c >= 0.75, "high").when(c >= 0.5, "medium").otherwise("low").alias("band"))
