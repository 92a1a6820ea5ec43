"""Rules to DataFrames: predicates are columns, aggregates are windows over time, nothing unbounded is collected.

Every shape gives rows of (entity_value, start_us, end_us, event_ids, truncated, n_events, observed); times are
microseconds.  ``event_ids`` is sorted and holds the EDGE earliest and latest events of a match, ``truncated``
tells whether others were left out, and ``n_events`` counts all.
"""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import haversine_km
from . import language as L
from .fields import column, with_fields
from .rule import Filter, Rule

SIGNS = {">=": operator.ge, "<=": operator.le, ">": operator.gt, "<": operator.lt, "==": operator.eq}
#: Earliest and latest events of a match that are listed.
EDGE = 100


def _like(value: str) -> str:
    """A pattern with * and ? as a LIKE pattern."""
    escaped = re.sub(r"([\\%_])", r"\\\1", value)
    return escaped.replace("*", "%").replace("?", "_")


def _one(c: Column, modifier: str, value: object) -> Column:
    if isinstance(value, bool):
        return c.cast("boolean") == value
    if modifier in ("gt", "gte", "lt", "lte"):
        sign = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<="}[modifier]
        return SIGNS[sign](c.cast("double"), F.lit(float(value)))
    if modifier == "re":
        return c.cast("string").rlike(str(value))
    text = str(value)
    if modifier == "contains":
        return c.isNotNull() if not text else F.lower(c.cast("string")).contains(text.lower())
    if modifier == "startswith":
        return F.lower(c.cast("string")).startswith(text.lower())
    if modifier == "endswith":
        return F.lower(c.cast("string")).endswith(text.lower())
    if value is None:
        return c.isNull()
    if isinstance(value, str) and re.search(r"[*?]", value):
        return F.ilike(c.cast("string"), F.lit(_like(value)))
    return c == F.lit(value)


def filter_column(f: Filter) -> Column:
    c = column(f.field)
    plain = f.modifier == "eq" and len(f.values) > 1 and all(isinstance(v, str) and not re.search(r"[*?]", v) for v in f.values)
    if plain:
        return c.isin(*f.values)
    parts = [_one(c, f.modifier, v) for v in f.values]
    return functools.reduce(operator.and_ if f.every else operator.or_, parts)


def predicate(node: object, rule: Rule) -> Column:
    if isinstance(node, L.Block):
        return functools.reduce(operator.and_, [filter_column(f) for f in rule.blocks[node.name]])
    if isinstance(node, L.Not):
        return ~predicate(node.part, rule)
    if isinstance(node, L.All):
        return functools.reduce(operator.and_, [predicate(p, rule) for p in node.parts])
    if isinstance(node, L.Any):
        return functools.reduce(operator.or_, [predicate(p, rule) for p in node.parts])
    raise L.RuleError(f"{type(node).__name__} cannot stand inside a condition")


def _holds(node: object, rule: Rule) -> Column:
    return F.coalesce(predicate(node, rule), F.lit(False))


def _key(fields: tuple[str, ...]) -> Column:
    """One field as it is; several joined, nulls left out."""
    if len(fields) == 1:
        return column(fields[0]).cast("string")
    return F.concat_ws("\x1f", *[column(f).cast("string") for f in fields])


def _evidence(rows: DataFrame, keys: list[str], observed: Column) -> DataFrame:
    """Group matched rows; of each match the earliest and the latest events, ranked before they are collected."""
    by = Window.partitionBy(*keys)
    ranked = rows.withColumn("_place", F.row_number().over(by.orderBy("us", "id"))).withColumn("_all", F.count(F.lit(1)).over(by))
    listed = (F.col("_place") <= EDGE) | (F.col("_place") > F.col("_all") - EDGE)
    return ranked.groupBy(*keys).agg(
        F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.array_sort(F.collect_list(F.when(listed, F.col("id")))).alias("event_ids"),
        (F.count(F.lit(1)) > 2 * EDGE).alias("truncated"), F.count(F.lit(1)).alias("n_events"), observed.alias("observed"),
    )


def trailing(rows: DataFrame, keys: list[str], us: int, counted: Column, name: str, distinct: str | None = None, upto: str | None = None) -> DataFrame:
    """Add ``name``: how many counted rows of the same keys lie in the ``us`` microseconds up to each row, both ends included.

    Counted rows arrive at their time and leave just after it has passed; a running sum over both is the count,
    so a row costs the same however many its window holds.  With ``distinct`` the different values of that
    column are counted: a value arrives where it was absent and leaves where it does not come again in time.
    ``upto`` adds the number of counted rows up to each row's time.
    """
    marked = rows.withColumn("_in", F.coalesce(counted, F.lit(False)))
    arrives, leaves = F.col("_in"), F.col("_in")
    if distinct:
        same = Window.partitionBy(*keys, distinct, "_in").orderBy("us", "id")
        marked = marked.withColumn("_before", F.lag("us").over(same)).withColumn("_after", F.lead("us").over(same))
        known = F.col("_in") & F.col(distinct).isNotNull()
        arrives = known & (F.col("_before").isNull() | (F.col("us") - F.col("_before") > us))
        leaves = known & (F.col("_after").isNull() | (F.col("_after") - F.col("us") > us))
    real = marked.withColumns({"_at": F.col("us"), "_step": arrives.cast("int"), "_one": F.col("_in").cast("int"), "_real": F.lit(True)})
    gone = marked.filter(leaves).select(*keys, (F.col("us") + us + 1).alias("_at"), F.lit(-1).alias("_step"), F.lit(0).alias("_one"), F.lit(False).alias("_real"))
    by = Window.partitionBy(*keys).orderBy("_at")  # rows of one time count for each other
    both = real.unionByName(gone, allowMissingColumns=True).withColumn(name, F.sum("_step").over(by))
    if upto:
        both = both.withColumn(upto, F.sum("_one").over(by))
    return both.filter("_real").drop("_in", "_before", "_after", "_at", "_step", "_one", "_real")


def presence(events: DataFrame, rule: Rule) -> DataFrame:
    """Episodes of matching rows of an entity; a gap above the timeframe begins the next one."""
    rows = events.withColumn("entity_value", column(rule.entity_field).cast("string")).filter(_holds(rule.condition, rule) & F.col("entity_value").isNotNull())
    by = Window.partitionBy("entity_value").orderBy("us")
    gap = F.col("us") - F.lag("us").over(by)
    fresh = rows.withColumn("_new", F.coalesce((gap > rule.timeframe * 1_000_000).cast("int"), F.lit(0)))
    episodes = fresh.withColumn("episode", F.sum("_new").over(by))
    return _evidence(episodes, ["entity_value", "episode"], F.count(F.lit(1)).cast("double")).drop("episode")


def count(events: DataFrame, rule: Rule) -> DataFrame:
    """The first row of each group whose trailing window, both ends included, holds enough."""
    c = rule.condition
    us = rule.timeframe * 1_000_000
    rows = events.filter(_holds(c.base, rule)).withColumn("grp", _key(c.by)).filter("grp is not null").withColumn("entity_value", column(rule.entity_field).cast("string"))
    if c.field is None:
        rows = trailing(rows, ["grp"], us, F.lit(True), "seen")
    else:
        rows = rows.withColumn("_value", column(c.field).cast("string"))
        if c.max_each is not None:
            rows = trailing(rows, ["grp", "_value"], us, F.lit(True), "_own").filter(F.col("_own") <= c.max_each)
        rows = trailing(rows, ["grp"], us, F.lit(True), "seen", distinct="_value")
    hits = rows.filter(SIGNS[c.compare](F.col("seen"), F.lit(c.number)))
    first = hits.groupBy("grp").agg(F.min("us").alias("at"), F.min_by("seen", F.struct("us", "id")).alias("first_seen"), F.min_by("entity_value", F.struct("us", "id")).alias("who"))
    inside = rows.drop("entity_value").join(first, "grp").filter(F.col("us").between(F.col("at") - us, F.col("at")))
    return _evidence(inside, ["grp", "who", "first_seen"], F.first("first_seen").cast("double")).withColumnRenamed("who", "entity_value").drop("grp", "first_seen")


def anchored(events: DataFrame, rule: Rule) -> DataFrame:
    """Every anchor row whose group holds enough base rows in the trailing window."""
    c = rule.condition
    us = rule.timeframe * 1_000_000
    rows = events.withColumn("_base", _holds(c.base, rule)).withColumn("_anchor", _holds(c.anchor, rule)).filter("_base or _anchor").withColumn("grp", _key(c.by)).filter("grp is not null")
    rows = rows.withColumn("entity_value", column(rule.entity_field).cast("string"))
    if c.field is None:
        rows = trailing(rows, ["grp"], us, F.col("_base"), "seen", upto="_upto").withColumn("_held", F.col("seen"))
    else:
        rows = rows.withColumn("_value", column(c.field).cast("string"))
        rows = trailing(trailing(rows, ["grp"], us, F.col("_base"), "seen", distinct="_value"), ["grp"], us, F.col("_base"), "_held", upto="_upto")
    hit = rows.filter(F.col("_anchor") & SIGNS[c.compare](F.col("seen"), F.lit(c.number)))
    # base rows are numbered by time: a hit's are the last ones up to it, of which it looks the outer ones up
    place = F.row_number().over(Window.partitionBy("grp").orderBy("us", "id"))
    based = rows.filter("_base").select("grp", F.col("id").alias("_id"), place.alias("_place"))
    low = F.col("_upto") - F.col("_held") + 1
    wanted = F.when(F.col("_held") <= 2 * EDGE, F.sequence(low, F.col("_upto"))).otherwise(F.concat(F.sequence(low, low + EDGE - 1), F.sequence(F.col("_upto") - EDGE + 1, F.col("_upto"))))
    kept = ["grp", "entity_value", "id", "us", "_base", "_held", "seen"]
    listed = hit.withColumn("_place", F.explode_outer(F.when(F.col("_held") > 0, wanted))).select(*kept, F.col("_place").cast("int").alias("_place"))
    found = listed.join(based, ["grp", "_place"], "left").groupBy(*kept).agg(F.collect_set("_id").alias("_ids"))
    ids = F.array_sort(F.array_union("_ids", F.array("id")))
    n = F.col("_held") + F.when(F.col("_base"), F.lit(0)).otherwise(F.lit(1))
    return found.select("entity_value", (F.col("us") - F.lit(us)).alias("start_us"), F.col("us").alias("end_us"), ids.alias("event_ids"), (F.col("_held") > 2 * EDGE).alias("truncated"), n.cast("long").alias("n_events"), F.col("seen").cast("double").alias("observed"))


def not_seen_before(events: DataFrame, rule: Rule) -> DataFrame:
    """Rows whose first field has an earlier row in the history, but no earlier one equal in all fields."""
    c = rule.condition
    names = [f"_f{i}" for i in range(len(c.fields))]
    rows = events.withColumn("_base", _holds(c.base, rule)).withColumn("_past", _holds(c.history, rule))
    for n, f in zip(names, c.fields, strict=True):
        rows = rows.withColumn(n, column(f).cast("string"))
    past = rows.filter("_past")
    first = past.filter(F.col(names[0]).isNotNull()).groupBy(names[0]).agg(F.min("us").alias("first_any"))
    exact = past.na.drop(subset=names).groupBy(*names).agg(F.min("us").alias("first_same"))
    base = rows.filter("_base").withColumn("entity_value", column(rule.entity_field).cast("string"))
    joined = base.join(first, names[0]).filter("first_any < us").join(exact, names, "left").filter("first_same is null or first_same >= us")
    return joined.select("entity_value", F.col("us").alias("start_us"), F.col("us").alias("end_us"), F.array("id").alias("event_ids"), F.lit(False).alias("truncated"), F.lit(1).cast("long").alias("n_events"), F.lit(1.0).alias("observed"))


def speed(events: DataFrame, rule: Rule) -> DataFrame:
    """Consecutive rows of a group that would need a speed above the bound; no time between them counts as 10^7 km/h."""
    c = rule.condition
    rows = events.filter(_holds(c.base, rule)).withColumn("grp", _key(c.by)).withColumn("_lat", column(c.lat).cast("double")).withColumn("_lon", column(c.lon).cast("double"))
    rows = rows.filter("grp is not null and _lat is not null and _lon is not null").withColumn("entity_value", column(rule.entity_field).cast("string"))
    w = Window.partitionBy("grp").orderBy("us", "id")
    rows = rows.withColumns({"p_us": F.lag("us").over(w), "p_id": F.lag("id").over(w), "p_lat": F.lag("_lat").over(w), "p_lon": F.lag("_lon").over(w)}).filter("p_us is not null")
    km = haversine_km(F.col("p_lat"), F.col("p_lon"), F.col("_lat"), F.col("_lon"))
    rows = rows.withColumn("km", km).withColumn("_h", (F.col("us") - F.col("p_us")) / 3.6e9)
    kmh = F.when(F.col("_h") > 0, F.col("km") / F.col("_h")).when(F.col("km") > 1, F.lit(1e7)).otherwise(F.lit(0.0))
    hit = rows.withColumn("observed", kmh).filter((F.col("km") >= c.least_km) & SIGNS[c.compare](F.col("observed"), F.lit(c.number)))
    return hit.select("entity_value", F.col("p_us").alias("start_us"), F.col("us").alias("end_us"), F.array_sort(F.array("p_id", "id")).alias("event_ids"), F.lit(False).alias("truncated"), F.lit(2).cast("long").alias("n_events"), "observed")


def fields_of(rule: Rule) -> list[str]:
    """All fields that a rule names: in its blocks, its aggregate and as its entity."""
    c = rule.condition
    names = [rule.entity_field, *(f.field for block in rule.blocks.values() for f in block)]
    if isinstance(c, L.Count):
        names += [*c.by, *([c.field] if c.field else [])]
    elif isinstance(c, L.NotSeenBefore):
        names += c.fields
    elif isinstance(c, L.Speed):
        names += [c.lat, c.lon, *c.by]
    return names


def selected(events: DataFrame, rule: Rule) -> DataFrame:
    """The events for which a rule's plain condition holds."""
    return with_fields(events, fields_of(rule)).filter(_holds(rule.condition, rule)).select(*events.columns)


def matches(events: DataFrame, rule: Rule) -> DataFrame:
    """The matches of one rule over events with ``id`` and ``us``."""
    c = rule.condition
    events = with_fields(events, fields_of(rule))
    if isinstance(c, L.Count):
        return anchored(events, rule) if c.anchor is not None else count(events, rule)
    if isinstance(c, L.NotSeenBefore):
        return not_seen_before(events, rule)
    if isinstance(c, L.Speed):
        return speed(events, rule)
    return presence(events, rule)


def signals(events: DataFrame, rules: list[Rule], suppressions: list[Rule] = ()) -> DataFrame:
    """All rules' matches as signals, scored; suppressed entities of covered detectors are left out.

    A score is the level's base plus a tenth for each event above an anchored rule's bound, a quarter at most.
    """
    parts = []
    for rule in rules:
        c = rule.condition
        excess = F.col("observed") - F.lit(float(c.number)) if isinstance(c, L.Count) and c.anchor is not None else F.lit(0.0)
        score = F.least(F.lit(0.99), F.lit(rule.base_score) + F.greatest(F.lit(0.0), F.least(F.lit(0.25), 0.1 * excess)))
        parts.append(matches(events, rule).withColumns({"detector_key": F.lit(rule.detector_key), "entity_type": F.lit(rule.entity_type), "raw_score": score, "technique": F.lit(rule.techniques[0] if rule.techniques else None).cast("string")}))
    found = functools.reduce(DataFrame.unionByName, parts)
    for s in suppressions:
        hidden = matches(events, s).select(F.col("entity_value").alias("_v")).distinct()
        covered = F.lit(True) if "*" in s.applies_to else F.col("detector_key").isin(*s.applies_to)
        found = found.join(hidden, covered & (F.col("entity_type") == F.lit(s.entity_type)) & (F.col("entity_value") == F.col("_v")), "left_anti")
    return found
