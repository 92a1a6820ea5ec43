"""Communities of a graph by modularity, with joins and aggregates only: no part of a graph meets one task.

A level moves nodes between communities in synchronous rounds.  Each round half of the nodes, dealt anew by a hash,
may go to the neighbouring community with the largest gain; a node that is alone joins another that is alone only
under a smaller name, so that two never swap places for ever.  When rounds move nobody the communities become the
nodes of the next level's graph.  Where more want to
join a community than still gain there together, a share of them does.  A level that doesn't raise modularity isn't kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import at_each_salt, forget, hot_keys, salted, stored

#: Rounds of a level, two for every node to be asked once, and levels at most.
ROUNDS, LEVELS = 14, 10
#: A round that moves no more than one node in so many is taken for none.
FEW = 1000
#: A gain, and a rise of modularity, below this is none.
LEAST_GAIN = 1e-9


def directed(g: DataFrame) -> DataFrame:
    """(u, v, w): each edge (a, b, weight) both ways, a loop once."""
    rows = g.select("a", "b", F.col("weight").cast("double").alias("w"))
    back = rows.filter("a <> b").select(F.col("b").alias("u"), F.col("a").alias("v"), "w")
    return rows.select(F.col("a").alias("u"), F.col("b").alias("v"), "w").unionByName(back)


def modularity(adj: DataFrame, place: DataFrame) -> float:
    """Modularity of a partition (u, c) of the directed rows (u, v, w)."""
    ends = adj.join(place.withColumnRenamed("c", "cu"), "u").join(place.select(F.col("u").alias("v"), F.col("c").alias("cv")), "v")
    inside = ends.groupBy("cu").agg(F.sum(F.when(F.col("cu") == F.col("cv"), F.col("w")).otherwise(0.0)).alias("inside"), F.sum("w").alias("all"))
    r = inside.agg(F.sum("inside").alias("i"), F.sum(F.col("all") * F.col("all")).alias("s"), F.sum("all").alias("t")).first()
    return r["i"] / r["t"] - r["s"] / r["t"] ** 2 if r["t"] else 0.0


def _moves(adj: DataFrame, place: DataFrame, hot: DataFrame, total: float, turn: int) -> DataFrame:
    """(u, c, k, moved): where each node stands after one round; ``adj`` is salted by v, ``place`` has (u, c, k)."""
    half = F.pmod(F.xxhash64("u", F.lit(turn // 2)), F.lit(2)) == turn % 2
    sums = place.groupBy("c").agg(F.sum("k").alias("tot"), F.count(F.lit(1)).alias("size"))
    own = place.filter(half).join(sums, "c").select("u", F.col("c").alias("own"), "k", F.col("tot").alias("own_tot"), F.col("size").alias("own_size"))
    beside = at_each_salt(place.select(F.col("u").alias("v"), "c"), hot, "v")
    links = adj.filter(half & (F.col("u") != F.col("v"))).join(beside, ["v", "_salt"]).groupBy("u", "c").agg(F.sum("w").alias("w"))
    asked = links.join(own, "u").join(sums, "c")
    inside = F.col("c") == F.col("own")
    gain = F.col("w") - F.col("k") * (F.col("tot") - F.when(inside, F.col("k")).otherwise(0.0)) / total
    # whose best place is closed to it waits: the one that is alone there will come
    open_ = inside | (F.col("own_size") > 1) | (F.col("size") > 1) | (F.col("c") < F.col("own"))
    # of equal gains, to nine digits, the smallest name
    best = F.min(F.when(~inside, F.struct((-F.round(gain, 9)).alias("loss"), F.col("c").alias("to"), open_.alias("open")))).alias("best")
    about = asked.groupBy("u").agg(best, F.max(F.when(inside, gain)).alias("stay"), F.first("k").alias("k"), F.first("own_tot").alias("own_tot"))
    alone = -F.col("k") * (F.col("own_tot") - F.col("k")) / total
    wanted = about.select("u", "k", F.col("best.to").alias("to"), (-F.col("best.loss") - F.coalesce("stay", alone)).alias("rise"), "best").filter(F.col("best.open") & (F.col("rise") > LEAST_GAIN)).drop("best")
    # gains hold for a community as it was: as many may come as leave the mean newcomer a gain, drawn by a hash
    room = wanted.groupBy("to").agg((F.avg(F.col("rise") * total / F.col("k")) / F.sum("k")).alias("share"), F.min("u").alias("first"))
    drawn = F.pmod(F.xxhash64("u", F.lit(turn)), F.lit(1 << 20)) < F.col("share") * (1 << 20)
    chosen = wanted.join(room, "to").filter(drawn | (F.col("u") == F.col("first"))).select("u", "to")
    return place.join(chosen, "u", "left").select("u", F.coalesce("to", "c").alias("c"), "k", F.col("to").isNotNull().alias("moved"))


def _level(adj: DataFrame, total: float) -> DataFrame:
    """A written table (u, c) after the rounds of one level over a written table (u, v, w)."""
    hot = stored(hot_keys(adj, "v"), "hot")
    dealt = stored(salted(adj, hot, "v", F.col("u")), "edges")
    place = stored(adj.groupBy("u").agg(F.sum("w").alias("k")).select("u", F.col("u").alias("c"), "k", F.lit(False).alias("moved")), "place")
    still = 0
    for turn in range(ROUNDS):
        after = stored(_moves(dealt, place.drop("moved"), hot, total, turn), "place")
        forget(place)
        place = after
        r = place.agg(F.count_if("moved").alias("moved"), F.count(F.lit(1)).alias("n")).first()
        still = still + 1 if r["moved"] * FEW <= r["n"] else 0
        if still == 2:  # either half was asked, and next to nobody moved
            break
    forget(hot, dealt)
    return place


def communities(g: DataFrame) -> DataFrame:
    """(node, community) of every node of the edges (a, b, weight); a community is named by its smallest node.

    A node with an edge to itself only is by itself.  Weights must be positive; parallel edges add up.  The same edges
    give the same communities, up to the order in which equal sums are added.
    """
    adj = stored(directed(g).groupBy("u", "v").agg(F.sum("w").alias("w")), "graph")
    total = adj.agg(F.sum("w")).first()[0] or 0.0
    member = stored(adj.select(F.col("u").alias("node"), F.col("u").alias("community")).distinct(), "member")
    if not total:
        return member
    alone = member.select(F.col("node").alias("u"), F.col("community").alias("c"))
    reached = modularity(adj, alone)
    for _ in range(LEVELS):
        place = _level(adj, total)
        now = modularity(adj, place.select("u", "c"))
        if now <= reached + LEAST_GAIN:
            forget(place)
            break
        reached = now
        up = member.join(place.select(F.col("u").alias("community"), "c"), "community").select("node", F.col("c").alias("community"))
        ends = adj.join(place.select("u", F.col("c").alias("cu")), "u").join(place.select(F.col("u").alias("v"), F.col("c").alias("cv")), "v")
        new_member, new_adj = stored(up, "member"), stored(ends.groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w")), "graph")
        forget(member, adj, place)
        member, adj = new_member, new_adj
    # a node that others' community is named after may have left it itself
    name = member.groupBy("community").agg(F.min("node").alias("name"))
    named = stored(member.join(name, "community").select("node", F.col("name").alias("community")), "member")
    forget(member, adj)
    return named


def _exchanged(rows: DataFrame) -> DataFrame:
    """``rows`` for a join that exchanges both sides: tables of a row a node pack so well that Spark takes big ones for small and sends them through the driver."""
    return rows.hint("merge")


def connected(g: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected part of edges (a, b), by minima of neighbours and jumps to roots' roots."""
    both = stored(g.select("a", "b").union(g.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).select(F.col("a").alias("node"), "root"), "label")
    while True:
        near = both.join(_exchanged(label.select(F.col("node").alias("b"), F.col("root").alias("near"))), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        new = stored(label.join(_exchanged(near), "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root")), "label")
        # a node takes its root's root as well, so that long chains shrink by halves
        jump = new.select(F.col("node").alias("root"), F.col("root").alias("far"))
        after = stored(new.join(_exchanged(jump), "root").select("node", "was", F.least("root", "far").alias("root")), "label")
        forget(label, new)
        label = after
        if not label.filter("root <> was").limit(1).count():
            forget(both)
            return label.select("node", "root")
        label = label.select("node", "root")
        label.folder = after.folder


def _overlapping(pairs: DataFrame, listed: DataFrame, least: float) -> DataFrame:
    """Of rows with (set, other) those whose sets share ``least`` of the smaller one's elements."""
    a, b = listed.select("set", F.col("e").alias("_e")), listed.select(F.col("set").alias("other"), F.col("e").alias("_f"))
    shared = F.size(F.array_intersect("_e", "_f"))
    return pairs.join(_exchanged(a), "set").join(_exchanged(b), "other").filter(shared >= F.lit(float(least)) * F.least(F.size("_e"), F.size("_f"))).drop("_e", "_f")


def merged_by_overlap(sets: DataFrame, least: float = 0.5) -> DataFrame:
    """(set, merged) of rows (set, element): sets that share ``least`` of the smaller one's elements become one, transitively.

    ``merged`` is the smallest name.  What is asked for is who hangs together, not all links.  So first each set is compared with one
    other at each of its elements, the smallest set that has it, which is no more pairs than rows.  Then only sets that are not
    together yet are compared: those outside the largest part with each other and with the part.  If two share that much, one of the
    smaller set's first n - ceil(least * n) + 1 elements, rarest first, is in the other; only pairs that meet at such an element are
    compared, so what all sets have in common makes no pairs.  A set with none but common elements still meets each set at least as
    large that has them.
    """
    rows = stored(sets.select("set", "element").distinct(), "sets")
    often = rows.groupBy("element").agg(F.count(F.lit(1)).alias("often"))
    ranked = rows.join(_exchanged(often), "element").groupBy("set").agg(F.array_sort(F.collect_list(F.struct("often", "element"))).alias("e"))
    listed = stored(ranked.select("set", F.transform("e", lambda x: x["element"]).alias("e"), F.size("e").cast("long").alias("n")), "listed")
    held = listed.select("set", "n", F.explode("e").alias("element"))
    centre = held.groupBy("element").agg(F.min(F.struct("n", "set")).alias("c")).select("element", F.col("c.set").alias("other"))
    near = held.join(_exchanged(centre), "element").filter("set <> other").select("set", "other").distinct()
    links = stored(_overlapping(near, listed, least).select(F.col("set").alias("a"), F.col("other").alias("b")), "links")
    part = stored(listed.select("set", "n", "e").join(_exchanged(connected(links)), F.col("set") == F.col("node"), "left").select("set", "n", "e", F.coalesce("root", "set").alias("root")), "parts")
    largest = part.groupBy("root").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "root").limit(1).select("root", F.lit(True).alias("_large"))
    part = part.join(F.broadcast(largest), "root", "left").withColumn("_open", F.col("_large").isNull())
    keep = F.size("e") - F.ceil(F.size("e") * F.lit(float(least))).cast("int") + 1
    heads = part.select("set", "n", "root", "_open", F.explode(F.slice("e", F.lit(1), keep)).alias("element"))
    others = part.select(F.col("set").alias("other"), F.col("n").alias("m"), F.col("root").alias("far"), F.col("_open").alias("_far_open"), F.explode("e").alias("element"))
    larger = (F.col("m") > F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("other") > F.col("set")))
    met = heads.filter("_open").join(_exchanged(others), "element").unionByName(heads.filter("not _open").join(_exchanged(others.filter("_far_open")), "element"))
    pairs = stored(met.filter(larger & (F.col("root") != F.col("far"))).select("set", "other", "root", "far").distinct(), "pairs")
    between = stored(_overlapping(pairs, listed, least).select(F.col("root").alias("a"), F.col("far").alias("b")).distinct(), "links")
    roots = connected(between).withColumnRenamed("root", "_last")
    merged = part.join(_exchanged(roots), F.col("root") == F.col("node"), "left").select("set", F.coalesce("_last", "root").alias("merged"))
    out = stored(rows.select("set").distinct().join(_exchanged(merged), "set", "left").select("set", F.coalesce("merged", "set").alias("merged")), "merged")
    forget(rows, listed, links, pairs, between)
    return out
