"""Filter interaction audit: what each filter of a set removes, in every order in which they may be applied.

The orders of n filters are the paths of a trie.  What survives a prefix depends on which filters it holds, not on
their order, so the n! paths share 2^n states.  The trie is walked depth first: a state's surviving documents are a
written table, each edge to one more filter counts what that filter removes from it, and a state that another order
has reached before is not entered again.  A state's table is deleted when all its edges are done, so no more tables
than filters exist at once.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, forget, stored, text_or_empty

#: A key that more than one in so many rows have is looked up by broadcast: there are fewer such keys than this.
HOT = 1000
#: More filters would have too many orders to list.
MOST_FILTERS = 7


def text_filters(text: Column, words: Column) -> dict[str, Column]:
    """The four filters of the query that one document decides: true where it fails."""
    n, distinct, capitals = F.size(words), F.size(F.array_distinct(words)), F.length(F.regexp_replace(text, "[^A-Z]", ""))
    return {"A": n < 50, "B": 100 * distinct < 65 * n, "C": 100 * capitals > 5 * F.length(text), "D": text.rlike("[#$%&*|]")}


def looked_up(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """``rows`` left-joined to ``facts``, which has one row a ``key``, though one key may hold a large part of the rows.

    Keys of more than a thousandth of the rows are fewer than a thousand: their facts are broadcast, and their rows
    dealt out evenly in the join of the others.  ``rows`` must be a written table.
    """
    names = [c for c in facts.columns if c != key]
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") * HOT > rows.count()).select(key, F.lit(True).alias("_hot"))
    known = hot.join(facts, key, "left").select(F.col(key).alias("_hot_key"), "_hot", *[F.col(c).alias(f"_hot_{c}") for c in names])
    marked = rows.join(F.broadcast(known), F.col(key).eqNullSafe(F.col("_hot_key")), "left").drop("_hot_key")
    spread = F.when(F.col("_hot") | F.col(key).isNull(), 1 + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(4096))).otherwise(0)
    # always 0, but no literal: the optimizer would take a literal out of the join's keys, and the salt with it
    cold = facts.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(1)))
    out = marked.withColumn("_salt", spread.cast("long")).join(cold, [key, "_salt"], "left")
    return out.select(*rows.columns, *[F.coalesce(F.col(f"_hot_{c}"), F.col(c)).alias(c) for c in names])


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, fails, good, toxic) of every document; bit k of ``fails`` is filter k of ABCDE.

    E fails where the same whole text stands under a smaller doc_id; a null doc_id is no smaller and fails nothing.
    A document is good or toxic if any of its label rows says so.  Texts are told apart by their SHA-256.
    """
    text = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD_PATTERN), F.lit(0)))
    bits = [F.when(c, 1 << k).otherwise(0) for k, c in enumerate(text_filters(F.col("text"), F.col("words")).values())]
    seen = stored(rows.select("doc_id", "part", sum(bits[1:], bits[0]).alias("fails"), F.unhex(F.sha2("text", 256)).alias("digest")), "judged")
    firsts = seen.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last")
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    copies = stored(looked_up(seen, firsts, "digest"), "copies")
    known = looked_up(copies, marks.filter(F.col("doc_id").isNotNull()), "doc_id")
    copied = F.when(F.col("doc_id") > F.col("first"), 16).otherwise(0)
    out = stored(known.select("doc_id", "part", (F.col("fails") + copied).alias("fails"), *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("good", "toxic")]), "survivors")
    forget(seen, copies)
    return out


def trie_edges(rows: DataFrame, letters: str) -> DataFrame:
    """(part, state, filter, kept, removed, good_lost, toxic_lost) of each edge of the trie that removes or keeps a row.

    ``rows`` is a written table of (part, fails, good, toxic); it is deleted.  A state is the set of filters applied
    before, as bits; parts of which nothing has survived a state have no row there.
    """
    n, found = len(letters), []
    full, entered = (1 << n) - 1, {0}

    def walk(state: int, survivors: DataFrame) -> None:
        left = [k for k in range(n) if not state >> k & 1]
        fails = {k: F.col("fails").bitwiseAND(F.lit(1 << k)) != 0 for k in left}
        counts = [F.count(F.lit(1)).alias("n")]
        for k in left:
            counts += [F.count_if(fails[k]).alias(f"removed{k}"), F.count_if(fails[k] & (F.col("good") == 1)).alias(f"good{k}"), F.count_if(fails[k] & (F.col("toxic") == 1)).alias(f"toxic{k}")]
        edges = [F.struct(F.lit(letters[k]).alias("filter"), (F.col("n") - F.col(f"removed{k}")).alias("kept"), F.col(f"removed{k}").alias("removed"), F.col(f"good{k}").alias("good_lost"), F.col(f"toxic{k}").alias("toxic_lost")) for k in left]
        counted = survivors.groupBy("part").agg(*counts).select("part", F.lit(state).alias("state"), F.explode(F.array(*edges)).alias("e")).select("part", "state", "e.*")
        found.append(stored(counted, "edges"))
        for k in left:
            after = state | 1 << k
            if after != full and after not in entered:  # of the last state only its edges' counts are asked for
                entered.add(after)
                walk(after, stored(survivors.filter(~fails[k]), f"survivors-{after}"))
        forget(survivors)

    walk(0, rows)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    kept = stored(out, "trie")
    forget(*found)
    return kept


def audit(rows: DataFrame, letters: str) -> DataFrame:
    """Every order of the filters, step by step, for each part: what its filter keeps, removes and would have removed.

    ``rows`` is a written table of (part, fails, good, toxic), bit k of ``fails`` for filter k of ``letters``; it is
    deleted.  An empty table gives no row; otherwise each part has all orders and steps, zeros included.
    """
    n, spark = len(letters), rows.sparkSession
    if n > MOST_FILTERS:
        raise ValueError(f"{n} filters have too many orders")
    bit = {c: 1 << k for k, c in enumerate(letters)}
    fails = [F.col("fails").bitwiseAND(F.lit(1 << k)) != 0 for k in range(n)]
    sums = [F.struct(F.lit(c).alias("filter"), F.col(f"f{k}").alias("fails"), F.col(f"u{k}").alias("unique_fails")) for k, c in enumerate(letters)]
    totals = rows.groupBy("part").agg(*[F.count_if(fails[k]).alias(f"f{k}") for k in range(n)], *[F.count_if(F.col("fails") == 1 << k).alias(f"u{k}") for k in range(n)])
    totals = stored(totals.select("part", F.explode(F.array(*sums)).alias("t")).select("part", "t.*"), "totals")
    edges = trie_edges(rows, letters)
    # all edges of each part: a filter's totals times the states without it, of which n filters have 2^(n - 1)
    states = F.array(*[F.lit(s) for s in range(1 << n)])
    own = F.element_at(F.create_map(*[F.lit(x) for c in letters for x in (c, bit[c])]), F.col("filter"))
    all_ = totals.withColumn("state", F.explode(states)).filter(F.col("state").bitwiseAND(own) == 0)
    filled = all_.join(edges, ["part", "state", "filter"], "left").fillna(0, ["kept", "removed", "good_lost", "toxic_lost"])
    before = F.bit_count("state")
    orders = F.element_at(F.array(*[F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n)]), before + 1)
    worth = filled.groupBy("part", "filter").agg(F.sum(F.col("removed") * orders).cast("long").alias("shapley"))
    steps = [("".join(order), k + 1, order[k], sum(bit[c] for c in order[:k])) for order in itertools.permutations(letters) for k in range(n)]
    paths = spark.createDataFrame(steps, "filter_order string, step int, filter string, state int")  # n! times n rows, whatever the input
    out = filled.join(worth, ["part", "filter"]).join(F.broadcast(paths), ["state", "filter"])
    counts = ["kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return out.select("part", "filter_order", "step", *counts)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E over whole documents, by source; null sources and empty ones are one part.

    Null texts are empty and fail A; of repeated rows with one doc_id none is a copy of another; a very long text is
    judged whole; other columns are ignored.
    """
    return audit(judged(docs, labels), "ABCDE")
