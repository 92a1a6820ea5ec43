"""Overviews, time windows, top lists, paging and the event explorer."""

from __future__ import annotations

import base64
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overview(ev: DataFrame) -> DataFrame:
    """One row about a log: events, users, addresses, domains, blocked ones, bytes and the time spanned."""
    return ev.agg(
        F.count(F.lit(1)).alias("n_events"), F.count_distinct("principal").alias("n_users"), F.count_distinct("src_ip").alias("n_ips"), F.count_distinct("domain").alias("n_domains"),
        F.count_if(F.col("action") == "blocked").alias("n_blocked"), F.count_if(F.col("http_method") == "POST").alias("n_posts"),
        F.coalesce(F.sum("bytes_out"), F.lit(0)).alias("bytes_out"), F.coalesce(F.sum("bytes_in"), F.lit(0)).alias("bytes_in"), F.min("us").alias("first_us"), F.max("us").alias("last_us"),
    )


def time_windows(ev: DataFrame, parts: int = 24, top: int = 5, ids: int = 6) -> DataFrame:
    """Equal half-open windows over the whole span: totals, blocked, the top domains and the first ids; empty ones are left out.

    The span is two numbers; top domains come from a count per (window, domain), so events are never collected.
    """
    span = ev.agg(F.coalesce(F.min("us"), F.lit(0)).alias("lo"), F.coalesce(F.max("us") + 1_000_000, F.lit(1)).alias("hi")).first()
    rows = ev.withColumn("w", F.least(F.floor((F.col("us") - F.lit(span["lo"])) * parts / F.lit(span["hi"] - span["lo"])), F.lit(parts - 1)).cast("int"))
    totals = rows.groupBy("w").agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("action") == "blocked").alias("n_blocked"))
    by_domain = rows.groupBy("w", "domain").agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("w").orderBy(F.desc("n"), "domain")
    named = by_domain.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= top).groupBy("w").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "domain"))), lambda x: x["domain"]), ",").alias("top_domains"))
    order = Window.partitionBy("w").orderBy("us", "id")
    first = rows.select("w", "us", "id").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= ids).groupBy("w").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x["id"].cast("string")), ",").alias("first_ids"))
    return totals.join(named, "w").join(first, "w")


def ranked(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key, with ``rank``."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def notable(ev: DataFrame, scores: DataFrame, key: str, n: int = 20) -> DataFrame:
    """The top entities by highest score, nulls last, then volume: a report of ``n`` rows."""
    volume = ev.groupBy(key).agg(F.count(F.lit(1)).alias("n_events"))
    best = scores.groupBy("entity_value").agg(F.max("score").alias("max_score"))
    joined = volume.join(best, volume[key] == best["entity_value"], "left").select(key, "n_events", "max_score")
    return joined.orderBy(F.desc_nulls_last("max_score"), F.desc("n_events"), key).limit(n)


def round_robin(rows: DataFrame, group: str, score: str, key: str, n: int) -> DataFrame:
    """Best row of each group first, groups by their best, then all second rows, and so on; the first ``n`` rows."""
    w = Window.partitionBy(group).orderBy(F.desc(score), key)
    best = F.max(score).over(Window.partitionBy(group))
    turned = rows.withColumn("turn", F.row_number().over(w)).withColumn("best", best).filter(F.col("turn") <= n)
    return turned.orderBy("turn", F.desc("best"), group, key).limit(n)


def encode_cursor(values: list) -> str:
    return base64.urlsafe_b64encode(json.dumps(values).encode()).decode()


def decode_cursor(cursor: str) -> list:
    return json.loads(base64.urlsafe_b64decode(cursor.encode()))


def page(rows: DataFrame, keys: list[tuple[str, bool]], limit: int, cursor: str | None = None) -> DataFrame:
    """A page of limit + 1 rows after the cursor; keys are (column, descending) and end with a unique one.

    The bound is a chain of comparisons on the keys, so that it reaches the scan.
    """
    if cursor:
        after = decode_cursor(cursor)
        bound = F.lit(False)
        same = F.lit(True)
        for (name, down), value in zip(keys, after, strict=True):
            bound = bound | (same & ((F.col(name) < F.lit(value)) if down else (F.col(name) > F.lit(value))))
            same = same & (F.col(name) == F.lit(value))
        rows = rows.filter(bound)
    return rows.orderBy(*[F.desc(n) if down else F.asc(n) for n, down in keys]).limit(limit + 1)


def explore(ev: DataFrame, principal: str | None = None, domain: str | None = None, src_ip: str | None = None, action: str | None = None, from_us: int | None = None, to_us: int | None = None) -> DataFrame:
    """Events by any of the filters; all of them reach the scan."""
    for name, value in (("principal", principal), ("domain", domain), ("src_ip", src_ip), ("action", action)):
        if value is not None:
            ev = ev.filter(F.col(name) == value)
    if from_us is not None:
        ev = ev.filter(F.col("us") >= from_us)
    if to_us is not None:
        ev = ev.filter(F.col("us") < to_us)
    return ev


def with_signal(ev: DataFrame, signals: DataFrame, has: bool = True) -> DataFrame:
    """Events that some signal names as evidence, or that none does: a semi or anti join on the exploded ids."""
    ids = signals.select(F.explode("event_ids").alias("_id")).distinct()
    return ev.join(ids, F.col("id") == F.col("_id"), "left_semi" if has else "left_anti")


def signal_counts(signals: DataFrame) -> DataFrame:
    """For each event the number of signals on it, their highest score and their detectors."""
    rows = signals.select(F.explode("event_ids").alias("id"), "score", "detector_key")
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("n_signals"), F.max("score").alias("max_score"), F.array_join(F.array_sort(F.collect_set("detector_key")), ",").alias("detectors"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: a maximum of a struct, so rows are reduced before they are shuffled."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    top = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_top"))
    return top.select(*keys, *[F.col(f"_top.{c}").alias(c) for c in [*order, *rest]])


def head_and_tail(rows: DataFrame, keys: list[str], order: list[str], n: int = 100) -> DataFrame:
    """The first and last ``n`` rows of each key, and whether any were left out; ranked, not collected."""
    up = Window.partitionBy(*keys).orderBy(*order)
    ranked_rows = rows.withColumn("_r", F.row_number().over(up)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return ranked_rows.filter((F.col("_r") <= n) | (F.col("_r") > F.col("_n") - n)).withColumn("truncated", F.col("_n") > 2 * n).drop("_r", "_n")
