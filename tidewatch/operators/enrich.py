"""Enrichment: addresses by ranges, domains by dimensions, user agents and tags, as one struct."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import web

#: Rows of a range or domain table that may be broadcast; above, the join runs on blocks or by hash.
BROADCAST_ROWS, BLOCK_BITS = 200_000, 16


def with_ip(rows: DataFrame, ip: str, ranges: DataFrame, name: str) -> DataFrame:
    """Add ``name``: struct(asn, org, country, is_hosting, is_special_use) of the narrowest-starting range that holds the address.

    Ranges are cut into blocks of 2^16 addresses and joined by block, so that it is an equi-join whatever the
    table's size; of several ranges the one that starts last wins.  Special-use addresses match no range;
    anything but IPv4 is all null.
    """
    step = 1 << BLOCK_BITS
    cut = ranges.withColumn("_block", F.explode(F.sequence((F.col("start") / step).cast("long"), (F.col("end") / step).cast("long"))))
    # the number is made once for a row and stands behind the exchange as a column
    wanted = rows.select(F.col(ip).alias("_ip"), web.ip_number(F.col(ip)).alias("_n")).groupBy("_ip").agg(F.max("_n").alias("_n")).filter("_n is not null").withColumn("_special", web.is_special_number(F.col("_n")))
    found = wanted.withColumn("_block", (F.col("_n") / step).cast("long")).join(cut, "_block").filter((F.col("_n") >= F.col("start")) & (F.col("_n") <= F.col("end")) & ~F.col("_special"))
    best = found.groupBy("_ip").agg(F.max(F.struct("start", "asn", "org", "country", "is_hosting")).alias("_r"))
    info = wanted.select("_ip", "_special").join(best, "_ip", "left").select("_ip", F.struct("_r.asn", "_r.org", "_r.country", "_r.is_hosting", F.col("_special").alias("is_special_use")).alias(name))
    return rows.join(info, F.col(ip) == F.col("_ip"), "left").drop("_ip")


def with_domain(rows: DataFrame, domain: str, ages: DataFrame, ranks: DataFrame, risks: dict[str, str], today: str, name: str, new_days: int = 30, top: int = 10_000) -> DataFrame:
    """Add ``name``: registrable domain, TLD and its risk, age and rank with their flags."""
    d = rows.select(F.col(domain).alias("_d")).distinct().withColumn("_reg", web.registrable_domain(F.col("_d")))
    d = d.join(ages.select(F.col("domain").alias("_reg"), "first_seen"), "_reg", "left").join(ranks.select(F.col("domain").alias("_reg"), "rank"), "_reg", "left")
    tld = web.top_level(F.col("_d"))
    tier = functools.reduce(lambda acc, kv: F.when(tld == kv[0], F.lit(kv[1])).otherwise(acc), sorted(risks.items()), F.lit("unknown"))
    age = F.datediff(F.lit(today).cast("date"), F.col("first_seen").cast("date"))
    info = F.struct(F.col("_reg").alias("registrable_domain"), tld.alias("tld"), tier.alias("tld_risk_tier"), age.alias("age_days"), age.isNotNull().alias("age_known"), F.coalesce(age <= new_days, F.lit(False)).alias("newly_registered"), F.col("rank").alias("popularity_rank"), F.coalesce(F.col("rank") <= top, F.lit(False)).alias("is_top_site"))
    return rows.join(d.select("_d", info.alias(name)), F.col(domain) == F.col("_d"), "left").drop("_d")


def tags(rules: list[dict], domain: Column, tld: Column, agent: Column, hosting: Column) -> Column:
    """The sorted tags whose conditions all hold; a rule's conditions are domain_in, domain_regex, tld_in, ua_contains, is_hosting."""
    parts = []
    for rule in rules:
        m = rule["match"]
        tests = {
            "domain_in": lambda v: F.lower(domain).isin(*[x.lower() for x in v]), "domain_regex": lambda v: domain.rlike(v), "tld_in": lambda v: tld.isin(*[x.lower() for x in v]),
            "ua_contains": lambda v: functools.reduce(operator.or_, [F.lower(agent).contains(x.lower()) for x in ([v] if isinstance(v, str) else v)]), "is_hosting": lambda v: hosting == v,
        }
        unknown = set(m) - set(tests)
        if unknown or not m:
            raise ValueError(f"conditions {sorted(unknown)} of tag {rule['tag']}")
        parts.append(F.when(functools.reduce(operator.and_, [tests[k](v) for k, v in m.items()]), F.lit(rule["tag"])))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*parts)))) if parts else F.array().cast("array<string>")
