"""Registrable domains by public suffix rules: a host's endings are joined to the rules, the longest match wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.web import is_ipv4

#: Rules up to so many are sent to every task; more are joined by shuffle.
SENT = 100_000
PLAIN, WILDCARD, EXCEPTION = 0, 1, 2


def parsed_rules(lines: DataFrame) -> DataFrame:
    """(suffix, kind) of text lines in the form of the public suffix list: ``//`` begins a comment, ``*.`` a wildcard, ``!`` an exception."""
    rule = F.lower(F.regexp_extract("value", r"^\s*(\S+)", 1))
    rows = lines.select(rule.alias("r")).filter("r <> '' and not startswith(r, '//')")
    kind = F.when(F.col("r").startswith("*."), WILDCARD).when(F.col("r").startswith("!"), EXCEPTION).otherwise(PLAIN)
    return rows.select(F.regexp_replace("r", r"^(\*\.|!)", "").alias("suffix"), kind.alias("kind")).distinct()


def suffix_rules(spark: SparkSession, path: str) -> DataFrame:
    return parsed_rules(spark.read.text(path))


def clean_host(host: Column) -> Column:
    return F.nullif(F.rtrim(F.lower(F.trim(host)), F.lit(".")), F.lit(""))


def registrable_domains(hosts: DataFrame, rules: DataFrame, host: str = "host") -> DataFrame:
    """(host, registrable_domain, public_suffix) of each different host: the public suffix and one label more.

    An exception beats all other rules, then the rule with most labels wins.  A host that no rule fits, that is
    itself a public suffix or that is an address stays as it is; without a fitting rule ``public_suffix`` is null.
    Null and empty hosts are left out.  ``host`` is given as it was, results are lower-cased without a last dot.
    """
    each = hosts.select(F.col(host).alias("host")).distinct().withColumn("_clean", clean_host(F.col("host"))).filter("_clean is not null")
    labels = F.when(is_ipv4(F.col("_clean")), F.array().cast("array<string>")).otherwise(F.split("_clean", r"\."))
    tails = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_labels"), F.lit(1))), lambda n: F.struct(n.alias("n"), F.array_join(F.slice("_labels", -n, n), ".").alias("tail")))
    ends = each.withColumn("_labels", labels).filter(F.size("_labels") > 0).select("host", F.size("_labels").alias("all"), F.explode(tails).alias("t")).select("host", "all", "t.n", "t.tail")
    few = rules.count() <= SENT
    found = ends.join(F.broadcast(rules) if few else rules, F.col("tail") == F.col("suffix")).filter((F.col("kind") != WILDCARD) | (F.col("n") < F.col("all")))
    length = F.col("n") + F.when(F.col("kind") == WILDCARD, 1).when(F.col("kind") == EXCEPTION, -1).otherwise(0)
    best = found.groupBy("host").agg(F.max(F.struct((F.col("kind") == EXCEPTION).alias("exception"), length.alias("n"))).alias("b")).select("host", F.col("b.n").alias("n"))
    out = each.join(best, "host", "left")
    parts = F.split("_clean", r"\.")
    last = lambda n: F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), F.least(n, F.size(parts))), ".")
    return out.select("host", F.when(F.col("n").isNull() | (F.size(parts) <= F.col("n")), F.col("_clean")).otherwise(last(F.col("n") + 1)).alias("registrable_domain"), F.when(F.col("n").isNotNull(), last(F.col("n"))).alias("public_suffix"))


def with_registrable(rows: DataFrame, host: str, rules: DataFrame, name: str = "registrable_domain") -> DataFrame:
    """``rows`` with the registrable domain of their host, looked up once for each different host."""
    found = registrable_domains(rows.select(host), rules, host).select(F.col("host").alias("_host"), F.col("registrable_domain").alias(name))
    return rows.drop(name).join(found, F.col(host) == F.col("_host"), "left").drop("_host")
