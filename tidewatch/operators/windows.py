"""Features of (entity, hour) windows: one aggregate over events that were tagged once, then z columns."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import finite, share, text_entropy
from ..functions.web import is_ipv4
from ..scratch import stored
from .detectors import z_columns

HOUR = 3_600_000_000
# The vector's columns in their order, by family; bounds of a rare domain and of a large upload.
FAMILIES = {
    "volume": ("n_events", "n_events_z_vs_own_history", "n_events_z_vs_cohort"),
    "temporal": ("off_hours_ratio", "weekend_ratio", "iat_mean", "iat_cv", "iat_min", "hour_entropy", "burstiness", "night_ratio"),
    "domain": ("n_unique_domains", "n_rare_domains", "rare_domain_ratio", "rare_domain_ratio_z_vs_own_history", "rare_domain_ratio_z_vs_cohort", "n_new_domains_for_user", "mean_domain_entropy", "max_domain_entropy", "n_newly_registered_domains", "high_risk_tld_ratio", "non_top_site_ratio"),
    "transfer": ("bytes_out_sum", "bytes_in_sum", "out_in_ratio", "bytes_out_max", "bytes_out_sum_z_vs_own_history", "bytes_out_sum_z_vs_cohort", "n_large_uploads", "bytes_in_max", "bytes_out_cv"),
    "http": ("post_ratio", "blocked_ratio", "error_ratio", "n_unique_status_codes", "direct_ip_ratio", "n_unique_url_paths", "threat_category_ratio"),
    "device": ("n_unique_user_agents", "automation_ua_ratio", "n_unique_asns", "n_unique_countries", "hosting_provider_ratio", "n_unique_src_ips", "ua_diversity_ratio"),
    "identity": ("n_auth_failures", "n_auth_successes", "auth_failure_ratio", "n_mfa_challenges", "n_distinct_geos", "privilege_events", "mfa_failure_ratio", "session_start_events"),
    "navigation": ("referer_less_deep_path_ratio", "navigation_depth_mean", "n_unique_entry_domains", "cross_domain_redirect_chain_ratio", "download_without_navigation_ratio"),
}
FEATURES = tuple(name for names in FAMILIES.values() for name in names)
RARE_EVENTS, LARGE_UPLOAD = 10, 1_000_000
#: Columns whose z is taken against the entity's own windows and its cohort's.
Z_BASES = ("n_events", "bytes_out_sum", "rare_domain_ratio")
#: Columns whose values in an hour are counted, with the features that count them.
BESIDE = {"newly_registered": ("n_newly_registered_domains",), "status_code": ("n_unique_status_codes",), "user_agent": ("n_unique_user_agents", "ua_diversity_ratio"), "asn": ("n_unique_asns",), "country": ("n_unique_countries",), "src_ip": ("n_unique_src_ips",), "entry_domain": ("n_unique_entry_domains",)}
#: Columns that events may lack, with the type of the null that stands for them.
OPTIONAL = {"department": "string", "registrable_domain": "string", "bytes_out": "long", "bytes_in": "long", "http_method": "string", "action": "string", "status_code": "long", "url_path": "string", "user_agent": "string", "src_ip": "string", "asn": "long", "country": "string", "is_hosting": "boolean", "is_automation": "boolean", "newly_registered": "boolean", "high_risk_tld": "boolean", "is_top_site": "boolean", "threat": "boolean",
            "depth": "int", "entry_domain": "string", "refererless_deep": "boolean", "cross_chain": "boolean", "direct_download": "boolean"}


def work_hours(ev: DataFrame, key: str, span: int = 9, least: int = 5) -> DataFrame:
    """(key, work_start, work_end): the busiest ``span`` hours of the day around the clock, the first of equals; 9 to 17.5 below ``least`` events."""
    hours = ev.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.pmod(F.floor(F.col("us") / HOUR), F.lit(24)) == h).alias(f"h{h}") for h in range(24)])
    sums = F.array(*[sum((F.col(f"h{(s + i) % 24}") for i in range(span)), F.lit(0)) for s in range(24)])
    start = (F.array_position(sums, F.array_max(sums)) - 1).cast("double")
    return hours.select(key, F.when(F.col("n") < least, F.lit(9.0)).otherwise(start).alias("work_start"), F.when(F.col("n") < least, F.lit(17.5)).otherwise(start + span).alias("work_end"))


def entity_windows(ev: DataFrame, key: str, wanted: tuple[str, ...] = FEATURES) -> DataFrame:
    """(key, hour_us, department, event_ids and the features asked for) of each hour of each entity; z columns aside.

    ``ev`` needs id, us, domain and whatever of OPTIONAL it knows; a domain is its registrable_domain where that is
    known.  Only what the wanted columns need is joined, windowed and summed, in one aggregate.  What spans more
    than an hour (a domain's events, an entity's first sight of a domain, its working hours) is a small aggregate
    that is joined back.
    """
    need = set(wanted) | {b for b in Z_BASES if any(w.startswith(b) for w in wanted)}
    missing = {c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in ev.columns}
    rows = ev.filter(F.col(key).isNotNull()).withColumns(missing).withColumn("hour_us", (F.floor(F.col("us") / HOUR) * HOUR).cast("long")).withColumn("reg", F.coalesce("registrable_domain", "domain"))
    about_domains = need & {"n_rare_domains", "rare_domain_ratio", "n_new_domains_for_user", "mean_domain_entropy", "max_domain_entropy"}
    if about_domains:
        pair = rows.groupBy(key, "reg").agg(F.min("hour_us").alias("first_hour"), F.count(F.lit(1)).alias("_n"))
        counts = pair.groupBy("reg").agg(F.sum("_n").alias("domain_events")).withColumn("entropy", text_entropy(F.element_at(F.split("reg", r"\."), 1)))
        pair = pair.drop("_n").join(counts, "reg").select(F.col(key).alias("_k"), F.col("reg").alias("_reg"), "first_hour", "domain_events", "entropy")
        rows = rows.join(pair, (F.col(key) == F.col("_k")) & (F.col("reg") == F.col("_reg")), "left").drop("_k", "_reg")
    if "off_hours_ratio" in need:
        rows = rows.join(work_hours(rows, key), key)
    by = Window.partitionBy(key, "hour_us").orderBy("us", "id")
    if need & {"iat_mean", "iat_cv", "iat_min", "burstiness"}:
        rows = rows.withColumn("gap", (F.col("us") - F.lag("us").over(by)) / 1e6)
    hour = (F.col("us") % (24 * HOUR)) / HOUR
    day = F.pmod(F.floor(F.col("us") / (24 * HOUR)) + 3, F.lit(7))  # Monday is 0
    slot = F.floor((F.col("us") - F.col("hour_us")) / (HOUR // 12))
    n = F.count(F.lit(1))
    over = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(F.lit(0.0))
    # two sets, of an hour's domains and of what else its events have, where a set a column costs most of the time; paths may be many
    known = {"reg": F.col("reg")} | ({"entropy": F.col("entropy"), "rare": F.when(F.col("domain_events") <= RARE_EVENTS, 1), "new": F.when(F.col("first_hour") == F.col("hour_us"), 1)} if about_domains else {})
    domains = F.collect_set(F.when(F.col("reg").isNotNull(), F.struct(*[v.alias(k) for k, v in known.items()])))
    of_domains = lambda c: F.size(F.array_compact(domains.getField(c))).cast("double")
    beside = [c for c, names in BESIDE.items() if need & set(names)]
    others = F.collect_set(F.struct(*[(F.when(F.col("newly_registered"), F.col("reg")) if c == "newly_registered" else F.col(c)).alias(c) for c in beside]))
    unique = lambda c: F.size(F.array_distinct(F.array_compact(others.getField(c)))).cast("double")
    labels = domains.getField("entropy")
    gaps, mean, sd = F.count("gap"), F.avg("gap"), F.stddev_pop("gap")
    sent, got = F.coalesce(F.col("bytes_out"), F.lit(0)), F.coalesce(F.col("bytes_in"), F.lit(0))
    spread = F.when((gaps >= 2) & (mean > 0), F.lit(True)).otherwise(F.lit(False))
    slots = [F.count_if(slot == i) for i in range(12)]
    made = {
        "n_events": n.cast("double"),
        "off_hours_ratio": share(~hour.between(F.col("work_start"), F.col("work_end"))), "weekend_ratio": share(day >= 5), "night_ratio": share(hour < 5),
        "iat_mean": F.coalesce(mean, F.lit(0.0)), "iat_min": F.coalesce(F.min("gap"), F.lit(0.0)), "iat_cv": F.when(spread, sd / F.when(mean > 0, mean)).otherwise(F.lit(0.0)), "burstiness": F.when(spread, (sd - mean) / F.when(mean > 0, sd + mean)).otherwise(F.lit(0.0)),
        "hour_entropy": F.log2(n.cast("double")) - sum((F.when(c > 0, c * F.log2(F.when(c > 0, c))).otherwise(F.lit(0.0)) for c in slots), F.lit(0.0)) / n,
        "n_unique_domains": of_domains("reg"), "n_rare_domains": of_domains("rare"), "rare_domain_ratio": over(of_domains("rare"), of_domains("reg")), "n_new_domains_for_user": of_domains("new"),
        "mean_domain_entropy": F.when(F.size(labels) > 0, F.aggregate(labels, F.lit(0.0), lambda a, x: a + x) / F.size(labels)).otherwise(F.lit(0.0)), "max_domain_entropy": F.coalesce(F.array_max(labels), F.lit(0.0)), "n_newly_registered_domains": unique("newly_registered"),
        "high_risk_tld_ratio": share(F.col("high_risk_tld")), "non_top_site_ratio": share(~F.coalesce("is_top_site", F.lit(False))),
        "bytes_out_sum": F.sum(sent).cast("double"), "bytes_in_sum": F.sum(got).cast("double"), "out_in_ratio": F.sum(sent) / F.greatest(F.sum(got), F.lit(1)), "bytes_out_max": F.max(sent).cast("double"), "bytes_in_max": F.max(got).cast("double"), "n_large_uploads": F.count_if(sent >= LARGE_UPLOAD).cast("double"), "bytes_out_cv": over(F.stddev_pop(sent), F.avg(sent)),
        "post_ratio": share(F.col("http_method") == "POST"), "blocked_ratio": share(F.col("action") == "blocked"), "error_ratio": F.coalesce(F.avg((F.col("status_code") >= 400).cast("double")), F.lit(0.0)), "n_unique_status_codes": unique("status_code"), "direct_ip_ratio": share(is_ipv4(F.col("domain"))), "n_unique_url_paths": F.count_distinct("url_path").cast("double"), "threat_category_ratio": share(F.col("threat")),
        "n_unique_user_agents": unique("user_agent"), "automation_ua_ratio": share(F.col("is_automation")), "n_unique_asns": unique("asn"), "n_unique_countries": unique("country"), "hosting_provider_ratio": share(F.col("is_hosting")), "n_unique_src_ips": unique("src_ip"), "ua_diversity_ratio": unique("user_agent") / n,
        **{c: F.lit(0.0) for c in FAMILIES["identity"]},  # events of that kind do not occur in these logs
        "referer_less_deep_path_ratio": share(F.col("refererless_deep")), "navigation_depth_mean": F.coalesce(F.avg("depth"), F.lit(0.0)), "n_unique_entry_domains": unique("entry_domain"), "cross_domain_redirect_chain_ratio": share(F.col("cross_chain")), "download_without_navigation_ratio": share(F.col("direct_download")),
    }
    ids = [F.array_sort(F.collect_list("id")).alias("event_ids")] if "event_ids" in need else []
    constant = [c for c in FEATURES if c in need and c in FAMILIES["identity"]]
    summed = [c for c in FEATURES if c in need and c in made and c not in constant]
    first = F.min_by("department", F.when(F.col("department").isNotNull(), F.struct("us", "id"))).alias("department")
    out = rows.groupBy(key, "hour_us").agg(first, *ids, *[made[c].alias(c) for c in summed])
    return out.withColumns({c: made[c] for c in constant}) if constant else out


def with_z(windows: DataFrame, key: str, names: tuple[str, ...] = Z_BASES, cohort: tuple[str, ...] = ("department", "hour_us")) -> DataFrame:
    """Robust z of the named columns against the entity's own windows, and against its cohort's in the same hour."""
    own = z_columns(windows, [key], list(names), "_z_vs_own_history")
    return z_columns(own, list(cohort), list(names), "_z_vs_cohort", windows)


def vectors(ev: DataFrame, user: str = "principal", address: str = "src_ip", idle: int = 1800) -> DataFrame:
    """(entity_type, entity_value, hour_us, department, event_ids, FEATURES and features) of users and addresses.

    Navigation is told of users only and is 0 for addresses; users' cohorts are their department's windows of
    the hour, addresses' all of the hour.  ``features`` is the matrix row: finite numbers in the order of FEATURES.
    """
    known = navigation(ev, user, idle).drop(user) if "referrer_domain" in ev.columns else None
    of_users = ev.join(known, "id", "left") if known is not None else ev
    wanted = (*FEATURES, "event_ids")
    # windows are written once: each of the z's medians reads them again
    u = with_z(stored(entity_windows(of_users, user, wanted), "windows"), user).withColumn("entity_type", F.lit("user")).withColumnRenamed(user, "entity_value")
    a = with_z(stored(entity_windows(ev, address, wanted), "windows"), address, cohort=("hour_us",)).withColumn("entity_type", F.lit("src_ip")).withColumnRenamed(address, "entity_value")
    columns = ["entity_type", "entity_value", "hour_us", "department", "event_ids", *FEATURES]
    return matrix(u.select(*columns).unionByName(a.select(*columns)), list(FEATURES))


def matrix(windows: DataFrame, names: list[str]) -> DataFrame:
    """Add ``features``: finite doubles in the order of ``names``."""
    return windows.withColumn("features", F.array(*[finite(F.col(n).cast("double")) for n in names]))


def navigation(ev: DataFrame, key: str = "principal", idle: int = 1800) -> DataFrame:
    """Hops along referrers of each user: depth, entry domain and flags for every event.

    ``ev`` needs id, us, domain, url_path and referrer_domain.  A pause above ``idle`` seconds forgets all
    domains, so that a user's events are cut there first: a task takes whole episodes, in the order of time, and
    holds one's domains at once.
    """
    import pandas as pd

    from ..functions.web import has_download, path_segments

    rows = ev.select("id", "us", key, "domain", "referrer_domain", (F.size(path_segments(F.coalesce("url_path", F.lit("")))) >= 2).alias("deep"), has_download(F.coalesce("url_path", F.lit(""))).alias("download"))
    by = Window.partitionBy(key).orderBy("us", "id")
    pause = F.coalesce(F.col("us") - F.lag("us").over(by) > idle * 1_000_000, F.lit(False)).cast("int")
    rows = rows.filter(F.col(key).isNotNull()).withColumn("_pause", pause).withColumn("episode", F.sum("_pause").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_pause")
    ordered = rows.repartition(key, "episode").sortWithinPartitions(key, "episode", "us", "id")
    schema = f"id long, {key} {dict(ev.dtypes)[key]}, depth int, entry_domain string, refererless_deep boolean, cross_chain boolean, direct_download boolean"

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, seen = None, {}
        for part in parts:
            out = []
            for i, who, episode, domain, referrer, deep, download in zip(*(part[c].tolist() for c in ("id", key, "episode", "domain", "referrer_domain", "deep", "download")), strict=True):
                if (who, episode) != at:
                    at, seen = (who, episode), {}
                named = isinstance(referrer, str)
                known = seen.get(referrer) if named else None
                depth, entry = (known[0] + 1, known[1]) if known else (0, domain)
                seen[domain] = (depth, entry)
                out.append((i, who, depth, entry, not named and deep, bool(known and entry != domain), download and not known))
            yield pd.DataFrame(out, columns=["id", key, "depth", "entry_domain", "refererless_deep", "cross_chain", "direct_download"])

    return ordered.mapInPandas(walk, schema)
