"""Entity graph, node features, communities, incidents and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import clamp01, with_robust_z
from ..scratch import forget, stored
from .communities import communities, merged_by_overlap

#: Node types with their columns, relations between them, severity bounds, fusion bounds.
ENTITIES = (("user", "principal"), ("src_ip", "src_ip"), ("domain", "domain"), ("dst_ip", "dst_ip"), ("asn", "asn"), ("country", "country"))
RELATIONS = (("user", "domain", "accessed"), ("user", "src_ip", "from"), ("src_ip", "asn", "resolves_to"), ("domain", "dst_ip", "hosted_at"), ("src_ip", "country", "located_in"))
#: A feature fires beyond this z, shared infrastructure only with so many users; a rare node has so many events at most.
FIRE_Z, SHARED_USERS, RARE_EVENTS = 3.5, 3, 10
SEVERITIES = ((0.85, "critical"), (0.65, "high"), (0.40, "medium"), (0.0, "low"))
WEIGHT_RANGE = (0.25, 1.5)


def entities(ev: DataFrame, kinds=ENTITIES) -> DataFrame:
    """(type, value, first_us, last_us, event_count) of every entity: one pass, counted before the shuffle.

    Types whose column the events lack have no entity; empty values are none either.
    """
    each = F.array(*[F.struct(F.lit(t).alias("type"), F.nullif(F.col(c).cast("string"), F.lit("")).alias("value")) for t, c in kinds if c in ev.columns])
    rows = ev.select("us", F.explode(each).alias("e")).select("us", "e.type", "e.value").filter("value is not null")
    return rows.groupBy("type", "value").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count(F.lit(1)).alias("event_count"))


def edges(ev: DataFrame, least: int = 2, kinds=ENTITIES, relations=RELATIONS) -> DataFrame:
    """(src_type, src, dst_type, dst, relation, event_count, weight) of pairs seen together at least ``least`` times."""
    columns = {t: c for t, c in kinds if c in ev.columns}
    known = lambda t: F.nullif(F.col(columns[t]).cast("string"), F.lit(""))
    each = F.array(*[F.struct(F.lit(a).alias("src_type"), known(a).alias("src"), F.lit(b).alias("dst_type"), known(b).alias("dst"), F.lit(r).alias("relation")) for a, b, r in relations if a in columns and b in columns])
    rows = ev.select(F.explode(each).alias("e")).select("e.*").filter("src is not null and dst is not null")
    counted = rows.groupBy("src_type", "src", "dst_type", "dst", "relation").agg(F.count(F.lit(1)).alias("event_count"))
    return counted.filter(F.col("event_count") >= least).withColumn("weight", F.log1p(F.col("event_count").cast("double")))


def simple_graph(e: DataFrame) -> DataFrame:
    """Undirected (a, b, weight), weights of parallel edges added."""
    a, b = F.concat_ws(":", "src_type", "src"), F.concat_ws(":", "dst_type", "dst")
    return e.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), "weight").groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def degrees(g: DataFrame) -> DataFrame:
    """(node, degree, weighted_degree)."""
    both = g.select(F.explode(F.array("a", "b")).alias("node"), "weight")
    return both.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("weighted_degree"))


def fan_out(ev: DataFrame, most: int = 10) -> DataFrame:
    """How many domains with few events each user reaches."""
    rare = ev.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most).select("domain")
    return ev.select("principal", "domain").distinct().join(rare, "domain").groupBy("principal").agg(F.count(F.lit(1)).alias("fan_out"))


def shared_infrastructure(ev: DataFrame, least: int = 3, most: int = 10) -> DataFrame:
    """Rare domains that several users share."""
    return ev.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("principal").alias("users")).filter((F.col("n") <= most) & (F.col("users") >= least))


def clustering(g: DataFrame) -> DataFrame:
    """(node, clustering): the weighted clustering coefficient of nodes with two neighbours or more.

    Over a node's triangles the cubic roots of the three weights, each over the largest weight, are added and
    divided by its pairs of neighbours.  Edges point from the end with fewer neighbours to the other, so that a
    node with very many is the corner of no more pairs than edges allow.
    """
    g = g.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight")
    size = degrees(g).select("node", "degree")
    top = g.agg(F.max("weight").alias("top"))
    w = F.pow(F.col("weight") / F.col("top"), F.lit(1 / 3))
    e = g.filter("a <> b").join(F.broadcast(top)).select("a", "b", w.alias("w"))
    e = e.join(size.select(F.col("node").alias("a"), F.col("degree").alias("da")), "a").join(size.select(F.col("node").alias("b"), F.col("degree").alias("db")), "b")
    up = F.struct("da", "a") < F.struct("db", "b")
    e = e.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("y"), "w")
    left, right = e.select("x", F.col("y").alias("y1"), F.col("w").alias("w1")), e.select("x", F.col("y").alias("y2"), F.col("w").alias("w2"))
    pairs = left.join(right, "x").filter("y1 < y2")
    closed = g.filter("a <> b").join(F.broadcast(top)).select(F.col("a").alias("y1"), F.col("b").alias("y2"), w.alias("w3"))
    found = pairs.join(closed, ["y1", "y2"]).select(F.explode(F.array("x", "y1", "y2")).alias("node"), (F.col("w1") * F.col("w2") * F.col("w3")).alias("t"))
    total = found.groupBy("node").agg(F.sum("t").alias("t"))
    d = F.col("degree").cast("double")
    return size.join(total, "node", "left").select("node", F.when(d > 1, 2 * F.coalesce("t", F.lit(0.0)) / (d * (d - 1))).otherwise(F.lit(0.0)).alias("clustering"))


def node_features(ev: DataFrame) -> DataFrame:
    """(type, value, degree, weighted_degree, fan_out, shared_infra, clustering) of every entity of the events.

    fan_out counts a user's neighbours among rare domains and addresses; shared_infra the users of a rare domain,
    or of a rare address by way of its domains.
    """
    nodes, e = entities(ev), edges(ev)
    g = simple_graph(e)
    key = F.concat_ws(":", "type", "value")
    rare = nodes.filter((F.col("event_count") <= RARE_EVENTS) & F.col("type").isin("domain", "dst_ip")).select(F.col("type").alias("_t"), F.col("value").alias("_v"))
    accessed = e.filter("relation = 'accessed'").select(F.col("src").alias("user"), F.col("dst").alias("domain"))
    hosted = e.filter("relation = 'hosted_at'").select(F.col("src").alias("domain"), F.col("dst").alias("address"))
    out = accessed.join(rare.filter("_t = 'domain'"), F.col("domain") == F.col("_v"), "left_semi").groupBy("user").agg(F.count(F.lit(1)).cast("double").alias("fan_out"))
    by_name = accessed.select(F.lit("domain").alias("type"), F.col("domain").alias("value"), "user")
    by_address = accessed.join(hosted, "domain").select(F.lit("dst_ip").alias("type"), F.col("address").alias("value"), "user")
    users = by_name.unionByName(by_address).join(rare, (F.col("type") == F.col("_t")) & (F.col("value") == F.col("_v")), "left_semi").groupBy("type", "value").agg(F.count_distinct("user").cast("double").alias("shared_infra"))
    about = degrees(g).join(clustering(g), "node").withColumnRenamed("node", "_key")
    rows = nodes.withColumn("_key", key).join(about, "_key", "left").drop("_key")
    rows = rows.join(out.select(F.lit("user").alias("type"), F.col("user").alias("value"), "fan_out"), ["type", "value"], "left").join(users, ["type", "value"], "left")
    zero = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("degree", "weighted_degree", "clustering")}
    zero["fan_out"] = F.when(F.col("type") == "user", F.coalesce("fan_out", F.lit(0.0)))
    zero["shared_infra"] = F.when(F.col("type").isin("domain", "dst_ip"), F.coalesce("shared_infra", F.lit(0.0)))
    return rows.withColumns(zero)


def graph_signals(features: DataFrame, names: tuple[str, ...] = ("degree", "weighted_degree", "fan_out", "shared_infra", "clustering")) -> DataFrame:
    """(detector_key, entity_type, entity_value, raw_score, z) of features far from their population's median.

    The population is what has the feature: all nodes, users for fan_out, domains and addresses for shared_infra.
    """
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names])).alias("f")
    rows = features.select(F.col("type").alias("entity_type"), F.col("value").alias("entity_value"), each).select("entity_type", "entity_value", "f.feature", F.col("f.value").alias("raw_score")).filter("raw_score is not null")
    scored = with_robust_z(rows, ["feature"], "raw_score")
    fired = (F.abs("z") > FIRE_Z) & ((F.col("feature") != "shared_infra") | (F.col("raw_score") >= SHARED_USERS))
    return scored.filter(fired).select(F.concat(F.lit("graph."), "feature").alias("detector_key"), "entity_type", "entity_value", "raw_score", "z")


def merge_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert: the earliest first, the latest last sight, the newer count where there is one."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, (F.col("o.type") == F.col("n.type")) & (F.col("o.value") == F.col("n.value")), "full")
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))
    return joined.select(pick("type").alias("type"), pick("value").alias("value"), F.least("o.first_us", "n.first_us").alias("first_us"), F.greatest("o.last_us", "n.last_us").alias("last_us"), pick("event_count").alias("event_count"))


def incident_groups(g: DataFrame, seeds: DataFrame) -> DataFrame:
    """(incident_id, seeds, entities): communities with a seed in the graph one step around the seeds.

    The neighbourhood is cut out by joins.  Communities whose seeds overlap by half of the smaller are one incident.
    incident_id is the smallest entity.
    """
    on = seeds.select(F.col("node").alias("_s")).distinct()
    ends = g.withColumn("node", F.explode(F.array("a", "b"))).join(on, F.col("node") == F.col("_s"), "left_semi")
    around = ends.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    inner = stored(g.join(around.withColumnRenamed("node", "a"), "a", "left_semi").join(around.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b", "weight"), "neighbourhood")
    marked = stored(communities(inner).join(on.withColumnRenamed("_s", "node").withColumn("seed", F.lit(True)), "node", "left"), "communities")
    forget(inner)
    held = merged_by_overlap(marked.filter("seed").select(F.col("community").alias("set"), F.col("node").alias("element")))
    grouped = marked.join(held.withColumnRenamed("set", "community"), "community").groupBy("merged").agg(F.array_sort(F.collect_set(F.when(F.col("seed"), F.col("node")))).alias("seeds"), F.array_sort(F.collect_set("node")).alias("entities"))
    return grouped.select(F.element_at("entities", 1).alias("incident_id"), "seeds", "entities")


def incident_signals(groups: DataFrame, signals: DataFrame) -> DataFrame:
    """The signals of each incident's seeds, with its density (seeds among entities); ``signals`` has entity_type and entity_value."""
    seeds = groups.select("incident_id", (F.size("seeds") / F.size("entities")).alias("density"), F.explode("seeds").alias("_node"))
    return seeds.join(signals.withColumn("_node", F.concat_ws(":", "entity_type", "entity_value")), "_node").drop("_node")


def incident_graph(e: DataFrame, groups: DataFrame, most: int = 60) -> DataFrame:
    """(incident_id, src, dst, relation, weight): edges at an incident's seeds, its ``most`` nearest neighbours by weight, none dangling.

    ``e`` is as ``edges`` makes it.  A neighbour's place is that of its heaviest edge, ties by name.
    """
    keyed = e.select(F.concat_ws(":", "src_type", "src").alias("src"), F.concat_ws(":", "dst_type", "dst").alias("dst"), "relation", "weight")
    seed = groups.select("incident_id", F.explode("seeds").alias("_seed"))
    ends = keyed.withColumn("_end", F.explode(F.array("src", "dst")))
    touching = ends.join(seed, F.col("_end") == F.col("_seed")).select("incident_id", "src", "dst", "relation", "weight").distinct()
    marked = seed.select("incident_id", F.col("_seed").alias("node"), F.lit(True).alias("is_seed"))
    others = touching.select("incident_id", F.explode(F.array("src", "dst")).alias("node"), "weight").join(marked, ["incident_id", "node"], "left_anti").groupBy("incident_id", "node").agg(F.max("weight").alias("w"))
    rank = F.row_number().over(Window.partitionBy("incident_id").orderBy(F.desc("w"), "node"))
    kept = others.withColumn("_r", rank).filter(F.col("_r") <= most).select("incident_id", "node").unionByName(marked.select("incident_id", "node"))
    for end in ("src", "dst"):
        touching = touching.join(kept.withColumnRenamed("node", end), ["incident_id", end], "left_semi")
    return touching.select("incident_id", "src", "dst", "relation", "weight")


# -- fusion ------------------------------------------------------------------------------------------------


def strongest(signals: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Of each incident and detector the signal with the highest confidence times weight; ties go to the smallest id."""
    s = signals
    s = s.join(weights, "detector_key", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0))) if weights is not None else s.withColumn("weight", F.lit(1.0))
    top = F.max_by(F.struct("signal_id", "confidence", "weight"), F.struct(F.col("confidence") * F.col("weight"), -F.col("signal_id"))).alias("t")
    return s.groupBy("incident_id", "detector_key").agg(top).select("incident_id", "detector_key", "t.*")


def fused(signals: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(incident_id, fused_score, severity, anomaly_confidence): noisy-or of the strongest signals, lifted by layers and density.

    ``signals`` has incident_id, signal_id, detector_key, layer, confidence and density.  Layers are counted
    over all signals.
    """
    best = strongest(signals, weights)
    miss = 1 - clamp01(F.col("weight") * F.greatest(F.lit(0.0), 2 * F.col("confidence") - 1))
    base = best.groupBy("incident_id").agg((1 - F.product(miss)).alias("base"))
    about = signals.groupBy("incident_id").agg(F.count_distinct("layer").alias("layers"), F.max("density").alias("density"))
    lift = 1 + 0.15 * F.log(1 + F.col("layers").cast("double")) + 0.10 * F.least(F.col("density"), F.lit(1.0))
    score = F.least(F.lit(0.99), F.col("base") * lift)
    return base.join(about, "incident_id").withColumn("fused_score", score).withColumn("severity", severity(F.col("fused_score"))).withColumn("anomaly_confidence", F.bround(100 * F.col("fused_score"), 1)).drop("base")


def severity(score: Column) -> Column:
    out = F.lit(SEVERITIES[-1][1])
    for bound, name in reversed(SEVERITIES[:-1]):
        out = F.when(score >= bound, F.lit(name)).otherwise(out)
    return out


def fusion_weights(precision: DataFrame) -> DataFrame:
    """(detector_key, weight) of rows (detector_key, tp, fired): precision over the pooled one, held in a range."""
    pooled = precision.agg(F.sum("tp") / F.sum("fired")).first()[0] or 1.0
    w = F.least(F.lit(WEIGHT_RANGE[1]), F.greatest(F.lit(WEIGHT_RANGE[0]), F.col("tp") / F.col("fired") / F.lit(float(pooled))))
    return precision.select("detector_key", w.alias("weight"))


def incident_tags(signals: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """(incident_id, tags): layers, detectors, allowed techniques, and multi-layer, sorted."""
    tags = F.filter(F.array(F.concat(F.lit("layer:"), "layer"), F.concat(F.lit("detector:"), "detector_key"), F.when(F.col("technique").isin(*allowed), F.concat(F.lit("technique:"), "technique"))), lambda t: t.isNotNull())
    rows = signals.select("incident_id", F.explode(tags).alias("tag"))
    many = signals.groupBy("incident_id").agg(F.count_distinct("layer").alias("n")).filter("n > 1").select("incident_id", F.lit("multi-layer").alias("tag"))
    return rows.unionByName(many).groupBy("incident_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))


def timeline(signals: DataFrame) -> DataFrame:
    """Signals in the order of their start, those without one last, then by their first event."""
    return signals.withColumn("place", F.row_number().over(Window.partitionBy("incident_id").orderBy(F.asc_nulls_last("start_us"), F.array_min("event_ids"), "signal_id")))
