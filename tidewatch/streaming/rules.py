"""Rules on a stream: rows wait for the watermark, then each group is judged in the order of time as in batch."""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..rules import compiler
from ..rules import language as L
from ..rules.fields import PER_DOMAIN, with_fields
from ..rules.rule import Rule

MATCH = "entity_value string, start_us long, end_us long, event_ids array<long>, truncated boolean, n_events long, observed double"
_WAITING = "us long, id long, entity string, value string, base boolean, anchor boolean"
_NAMES = [c.split()[0] for c in MATCH.split(", ")]
EDGE = compiler.EDGE


def _ids(held: list[int]) -> list[int]:
    """The first and the last EDGE of ids in order of time."""
    return sorted(held if len(held) <= 2 * EDGE else held[:EDGE] + held[-EDGE:])


class RuleState(StatefulProcessor):
    """One group of a rule.  Its state: rows that wait for the watermark, and what the rule remembers.

    A count remembers the rows of its window until it has fired once, an anchored count those of its window
    always, presence the open episode with its outermost ids.
    """

    def __init__(self, rule: Rule) -> None:
        c = rule.condition
        self.us = rule.timeframe * 1_000_000
        self.kind = "presence" if not isinstance(c, L.Count) else "anchored" if c.anchor is not None else "count"
        self.distinct = isinstance(c, L.Count) and c.field is not None
        self.most = c.max_each if isinstance(c, L.Count) else None
        self.compare, self.number = (c.compare, c.number) if isinstance(c, L.Count) else (None, None)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.memory = handle.getValueState("memory", "text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = None
        for part in rows:
            self.waiting.appendList([(int(r.us), int(r.id), r.entity_value, r.value, bool(r.base), bool(r.anchor)) for r in part.itertuples(index=False)])
            last = int(part["us"].max()) if last is None else max(last, int(part["us"].max()))
        if last is not None:
            self.handle.registerTimer(last // 1000 + 1)  # fires when the watermark has passed all of these rows
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get(), key=lambda r: (r[0], r[1]))
        ready = [r for r in rows if r[0] < due]
        later = [tuple(r) for r in rows if r[0] >= due]
        memory = json.loads(self.memory.get()[0]) if self.memory.exists() else {}
        out = getattr(self, "_" + self.kind)(memory, ready, due)
        self.waiting.clear()
        if later and not memory.get("fired"):
            self.waiting.appendList(later)
        self.memory.update((json.dumps(memory),)) if memory else self.memory.clear()
        if out:
            yield pd.DataFrame(out, columns=_NAMES)

    def close(self) -> None:
        pass

    # -- the rules' shapes; each changes its memory and returns matches ----------------------------------------

    def _presence(self, memory: dict, ready: list, due: int) -> list[tuple]:
        out = []

        def end() -> None:
            n = memory["n"]
            out.append((memory["entity"], memory["start"], memory["end"], sorted(set(memory["head"] + memory["tail"])), n > 2 * EDGE, n, float(n)))
            memory.clear()

        for us, id_, entity, *_ in ready:
            if memory and us - memory["end"] > self.us:
                end()
            if not memory:
                memory.update(entity=entity, start=us, n=0, head=[], tail=[])
            memory.update(end=us, n=memory["n"] + 1, tail=[*memory["tail"], id_][-EDGE:])
            if len(memory["head"]) < EDGE:
                memory["head"].append(id_)
        if memory and due > memory["end"] + self.us:
            end()
        elif memory:
            self.handle.registerTimer((memory["end"] + self.us) // 1000 + 1)
        return out

    def _seen(self, window: list, column: int, flag: int) -> int:
        held = [r for r in window if r[flag]]
        return len({r[column] for r in held if r[column] is not None}) if self.distinct else len(held)

    def _count(self, memory: dict, ready: list, due: int) -> list[tuple]:
        if memory.get("fired"):
            return []
        window = memory.get("window", [])  # (us, id, entity, value, counted)
        at = 0
        while at < len(ready):
            us, until = ready[at][0], at
            while until < len(ready) and ready[until][0] == us:
                until += 1
            window = [r for r in window if r[0] >= us - self.us]
            fresh = [[r[0], r[1], r[2], r[3], True] for r in ready[at:until]]
            if self.most is not None:
                for r in fresh:
                    r[4] = sum(x[3] == r[3] for x in window) + sum(x[3] == r[3] for x in fresh) <= self.most
            window, at = window + fresh, until
            now = [r for r in fresh if r[4]]
            seen = self._seen(window, 3, 4)
            if now and compiler.SIGNS[self.compare](seen, self.number):
                held = [r[1] for r in window if r[4]]
                first = [r[0] for r in window if r[4]]
                memory.clear()
                memory["fired"] = True
                return [(now[0][2], first[0], us, _ids(held), len(held) > 2 * EDGE, len(held), float(seen))]
        memory["window"] = window
        return []

    def _anchored(self, memory: dict, ready: list, due: int) -> list[tuple]:
        base = memory.get("window", []) + [[r[0], r[1], r[2], r[3], True] for r in ready if r[4]]
        times, out = [r[0] for r in base], []
        for us, id_, entity, _, is_base, is_anchor in ready:
            if not is_anchor:
                continue
            window = base[bisect.bisect_left(times, us - self.us) : bisect.bisect_right(times, us)]
            seen, held = self._seen(window, 3, 4), len(window)
            if compiler.SIGNS[self.compare](seen, self.number):
                ids = sorted({*_ids([r[1] for r in window]), id_})
                out.append((entity, us - self.us, us, ids, held > 2 * EDGE, held + (not is_base), float(seen)))
        memory["window"] = base[bisect.bisect_left(times, due - self.us) :]
        return out


def matches_stream(stream: DataFrame, rule: Rule, late: str = "10 minutes") -> DataFrame:
    """Matches of a presence, count or anchored rule over a stream with ``id`` and ``us``, each once, as ``compiler.matches`` gives.

    Rows of any order within ``late`` give what batch gives; later ones are left out.  A match comes when the
    watermark has passed it.  Needs the RocksDB state store.  Rules that look at the whole history (not_seen_before,
    counts per domain) or at speed have no stream form and raise.  Of two rows equal in all columns both count.
    """
    c = rule.condition
    names = compiler.fields_of(rule)
    if isinstance(c, (L.NotSeenBefore, L.Speed)) or PER_DOMAIN in names:
        raise L.RuleError(f"{rule.id} has no form for streams")
    counted = isinstance(c, L.Count)
    rows = with_fields(stream, names)
    base = compiler._holds(c.base if counted else c, rule)
    anchor = compiler._holds(c.anchor, rule) if counted and c.anchor is not None else F.lit(False)
    entity = compiler.column(rule.entity_field).cast("string")
    group = compiler._key(c.by) if counted else entity
    value = compiler.column(c.field).cast("string") if counted and c.field is not None else F.lit(None).cast("string")
    asked = rows.select(group.alias("grp"), "us", "id", entity.alias("entity_value"), value.alias("value"), base.alias("base"), anchor.alias("anchor"), F.timestamp_micros("us").alias("at"))
    asked = asked.filter("grp is not null and (base or anchor)").withWatermark("at", late)
    return asked.groupBy("grp").transformWithStateInPandas(RuleState(rule), MATCH, "append", "EventTime")
