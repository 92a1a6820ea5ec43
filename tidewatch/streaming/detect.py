"""Structured Streaming forms: bursts over watermarked windows, presence sessions, navigation state per user."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(stream: DataFrame, key: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts per key and tumbling window; rows later than ``late`` are dropped with the window's state."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), key).agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", key, "n")


def sliding_bursts(stream: DataFrame, key: str, least: int, width: str = "10 minutes", step: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Keys with at least ``least`` events in a sliding window."""
    counted = stream.withWatermark("ts", late).groupBy(F.window("ts", width, step), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= least).select("window.start", "window.end", key, "n")


def sessions(stream: DataFrame, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Episodes of a key; a pause of ``gap`` ends one (the batch form ends it above the gap)."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("n")).select("session_window.start", "session_window.end", key, "n")


HOPS = "id long, principal string, depth int, entry_domain string"
STATE = "domains array<string>, depths array<int>, entries array<string>, last_ms long"


def navigation_stream(stream: DataFrame, idle_s: int = 1800, late: str = "10 minutes") -> DataFrame:
    """Hops along referrers with the domains of each user since its last pause kept as state; state goes after the idle time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        domains, depths, entries, last = state.get if state.exists else ([], [], [], None)
        seen = {d: (n, e) for d, n, e in zip(domains, depths, entries, strict=True)}
        part = pd.concat(list(batches)).sort_values(["ts", "id"])
        out = []
        for r in part.itertuples(index=False):
            now = int(r.ts.timestamp() * 1000)
            if last is not None and now - last > idle_s * 1000:
                seen = {}
            last = now
            known = seen.get(r.referrer_domain) if isinstance(r.referrer_domain, str) else None
            depth, entry = (known[0] + 1, known[1]) if known else (0, r.domain)
            seen.pop(r.domain, None)
            seen[r.domain] = (depth, entry)
            out.append((r.id, key[0], depth, entry))
        kept = list(seen.items())
        state.update(([d for d, _ in kept], [int(v[0]) for _, v in kept], [v[1] for _, v in kept], last))
        state.setTimeoutTimestamp(max(last + idle_s * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["id", "principal", "depth", "entry_domain"])

    rows = stream.withWatermark("ts", late).select("id", "ts", "principal", "domain", "referrer_domain")
    return rows.groupBy("principal").applyInPandasWithState(step, HOPS, STATE, "append", GroupStateTimeout.EventTimeTimeout)
