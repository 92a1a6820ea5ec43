"""What tenants share: signatures without identities, overlap of indicators, prevalence and privacy transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.privacy import NAMES, hmac_sha256, pseudonym, with_redacted

#: Identity columns with the prefix of their pseudonyms.
IDENTITIES = {"principal": "u", "src_ip": "ip", "hostname": "h", "session_id": "sess", "device_name": "dev", "device_owner": "u"}


def pseudonymised(ev: DataFrame, key: bytes) -> DataFrame:
    """Identity columns replaced by keyed pseudonyms; domains stay."""
    return ev.withColumns({c: pseudonym(key, p, F.col(c).cast("string")) for c, p in IDENTITIES.items() if c in ev.columns})


def reverse_map(ev: DataFrame, key: bytes) -> DataFrame:
    """(kind, pseudonym, value) of every identity, and whether two values share a pseudonym."""
    each = F.array(*[F.struct(F.lit(p).alias("kind"), F.col(c).cast("string").alias("value")) for c, p in IDENTITIES.items() if c in ev.columns])
    rows = ev.select(F.explode(each).alias("x")).select("x.*").filter("value is not null").distinct()
    named = rows.withColumn("pseudonym", F.concat("kind", F.lit("_"), F.substring(hmac_sha256(key, F.col("value")), 1, 12)))
    many = named.groupBy("pseudonym").agg(F.count_distinct("value").alias("n")).filter("n > 1").select("pseudonym", F.lit(True).alias("conflict"))
    return named.join(many, "pseudonym", "left").withColumn("conflict", F.coalesce("conflict", F.lit(False)))


def redacted_events(ev: DataFrame, columns: tuple[str, ...] = ("url_path", "user_agent"), longest: int = 256) -> DataFrame:
    """The columns redacted and cut to length, with the number of redactions."""
    out, total = ev, F.lit(0)
    for c in columns:
        out = with_redacted(out, c, f"_{c}", longest)
        total = total + sum((F.col(f"_{c}.{n}") for n in NAMES), F.lit(0))
    return out.withColumn("redactions", total).drop(*[f"_{c}" for c in columns])


def indicator_overlap(signatures: DataFrame, least: int = 2) -> DataFrame:
    """(indicator, sightings, tenants, types, first, last) of indicators that several tenants have."""
    rows = signatures.select("tenant_hash", "incident_type", "observed_us", F.explode("indicator_hashes").alias("indicator"))
    a = rows.groupBy("indicator").agg(F.count(F.lit(1)).alias("sightings"), F.count_distinct("tenant_hash").alias("tenants"), F.array_join(F.array_sort(F.collect_set("incident_type")), ",").alias("types"), F.min("observed_us").alias("first_us"), F.max("observed_us").alias("last_us"))
    return a.filter(F.col("tenants") >= least)


def overlap_histogram(signatures: DataFrame) -> DataFrame:
    """How many indicators one, two, three or more tenants have; every bucket has a row."""
    n = signatures.select("tenant_hash", F.explode("indicator_hashes").alias("indicator")).groupBy("indicator").agg(F.count_distinct("tenant_hash").alias("t"))
    b = n.groupBy(F.when(F.col("t") >= 3, "3+").otherwise(F.col("t").cast("string")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    names = signatures.sparkSession.sql("select explode(array('1', '2', '3+')) as bucket")
    return names.join(b, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def technique_prevalence(signatures: DataFrame, techniques: list[str]) -> DataFrame:
    """(technique, tenants) over signatures with an indicator; listed ones without any have 0."""
    rows = signatures.filter(F.size("indicator_hashes") > 0).select("tenant_hash", F.explode("mitre_techniques").alias("technique"))
    counted = rows.groupBy("technique").agg(F.count_distinct("tenant_hash").alias("tenants"))
    names = signatures.sparkSession.createDataFrame([(t,) for t in techniques], "technique string")
    return names.join(counted, "technique", "left").select("technique", F.coalesce("tenants", F.lit(0)).alias("tenants"))


def sharing_overview(signatures: DataFrame) -> DataFrame:
    """Per type: signatures, tenants, mean confidence, mean and number of the evidence confidences there are."""
    return signatures.groupBy("incident_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("tenant_hash").alias("tenants"), F.avg("confidence").alias("confidence"), F.avg("evidence_confidence").alias("evidence_confidence"), F.count("evidence_confidence").alias("with_evidence"))


def similar(signatures: DataFrame, query: list[float], k: int = 10, column: str = "embedding") -> DataFrame:
    """The k most similar vectors by cosine, none at or below 0; ties by id."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    q = F.array(*[F.lit(float(v)) for v in query])
    norm = F.sqrt(dot(F.col(column), F.col(column))) * float(sum(v * v for v in query) ** 0.5)
    rows = signatures.withColumn("cosine", F.when(norm > 0, dot(F.col(column), q) / norm).otherwise(F.lit(0.0)))
    return rows.filter("cosine > 0").orderBy(F.desc("cosine"), rows.columns[0]).limit(k)
