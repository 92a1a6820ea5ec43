"""Document fingerprints: a homomorphic multiset hash of paragraphs, with DataFrame operations only.

A paragraph's vector has EXACT lanes hashed from the whole paragraph and LIKE lanes that add +1 or -1 for each
of its pairs of neighbouring words.  A document's fingerprint is the sum of its paragraphs' vectors modulo
2^32, lane by lane: the order of paragraphs doesn't count, and a paragraph is put in or taken out by adding
or subtracting its vector.  Equal exact lanes mean equal multisets of paragraphs; the angle between like
lanes tells how much of two documents is shared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import key_buckets, row_id, tasks, text_or_empty

#: Lanes of either kind, and the modulus of each.
EXACT, LIKE, MODULUS = 32, 128, 1 << 32
#: Ranges of ids for each task: many, so that long texts that meet in one do not make a task large.
RANGES = 16
_LOW = MODULUS - 1
_PAIR = 0x0000000100000001  # bit 0 and bit 32: two counts in one number


def paragraphs(text: Column) -> Column:
    """The text's lines, empty ones too: the multiset that is hashed."""
    return F.split(text, "\n", -1)


def exact_lanes(text: Column) -> Column:
    """EXACT sums modulo 2^32 of hashes drawn from the SHA-512 of each paragraph."""
    zero = F.array(*[F.lit(0).cast("long")] * EXACT)
    lanes = F.array(*[F.lit(i) for i in range(EXACT)])
    digests = F.transform(paragraphs(text), lambda p: F.sha2(p, 512))
    add = lambda acc, d: F.zip_with(acc, lanes, lambda a, i: (a + F.xxhash64(i, d).bitwiseAND(F.lit(_LOW))).bitwiseAND(F.lit(_LOW)))
    return F.aggregate(digests, zero, add)


def word_pairs(text: Column) -> Column:
    """A hash of each word with the next one of its paragraph, of the last word alone."""

    def of(p: Column) -> Column:
        words = F.split(p, " ", -1)
        return F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))

    return F.flatten(F.transform(paragraphs(text), of))


def like_sums(h: Column) -> list[Column]:
    """Sums that count, for each of LIKE bits of ``h`` and a second hash of it, the pairs that have it set; two counts a sum."""
    both = [h, F.xxhash64(h)]
    return [F.sum(F.shiftrightunsigned(x, k).bitwiseAND(F.lit(_PAIR))).alias(f"s{32 * j + k}") for j, x in enumerate(both) for k in range(32)]


def like_lanes(pairs: Column, names: list[str]) -> Column:
    """Signed LIKE lanes: times a bit was set less times it was not, of ``pairs`` pairs."""
    counts = [F.coalesce(x, F.lit(0)) for n in names for x in (F.col(n).bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(F.col(n), 32))]
    return F.array(*[c * 2 - F.coalesce(pairs, F.lit(0)) for c in counts])


def narrow(lanes: Column) -> Column:
    """Lanes modulo 2^32 as 32-bit numbers with a sign."""
    return F.transform(lanes, lambda x: (x - F.lit(1 << 31)).cast("int"))


def wide(lanes: Column) -> Column:
    return F.transform(lanes, lambda x: x.cast("long") + F.lit(1 << 31))


def packed(exact: Column, like: Column) -> Column:
    """The fingerprint as hex, eight digits a lane; like lanes modulo 2^32."""
    lanes = F.concat(exact, F.transform(like, lambda x: x.cast("long").bitwiseAND(F.lit(_LOW))))
    return F.lower(F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """The lanes of both multisets together (sign 1), or of the first without the second (-1)."""
    return F.zip_with(a, b, lambda x, y: (x + F.lit(sign) * y + F.lit(MODULUS)).bitwiseAND(F.lit(_LOW)))


def likeness(like_a: Column, like_b: Column) -> Column:
    """The cosine of two like vectors, from 0 to 1."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)

    norm = F.sqrt(dot(like_a, like_a) * dot(like_b, like_b))
    return F.when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(like_a, like_b) / norm))).otherwise(F.lit(0.0))


def with_fingerprints(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, exact, like) of rows; ``key`` must tell rows apart.  Only keys and hashes are regrouped, never text."""
    pairs = rows.select(*key, F.explode_outer(word_pairs(F.col(text))).alias("h"))
    sums = like_sums(F.col("h"))
    names = [f"s{i}" for i in range(LIKE // 2)]
    counted = pairs.groupBy(*key).agg(F.count("h").alias("pairs"), *sums)
    like = counted.select(*key, like_lanes(F.col("pairs"), names).alias("like"))
    return rows.select(*key, exact_lanes(F.col(text)).alias("exact")).join(like, key)


def _ranges(rows: DataFrame, count: int) -> Column:
    """The range of each row by (doc_id, tie): about ``count`` of them; rows of one id that would fill several are cut by ``tie``.

    A range holds its least id's repeats and what lies between two boundaries, so that only the repeats can make
    it large.  A row a range reaches the driver.  Rows equal in both stay together.
    """
    bucket, _ = key_buckets(rows, "doc_id", count)
    least = F.coalesce("doc_id", F.lit(-(1 << 63)))
    found = rows.groupBy(bucket.cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(least).alias("least")).collect()
    even = max(1, -(-sum(r["n"] for r in found) // count))
    cuts = {r["b"]: (-(-r["n"] // even) if r["n"] > 2 * even else 0, r["least"]) for r in found}
    starts, at = [], 0
    for b in range(max(cuts, default=0) + 1):
        starts.append(at)
        at += cuts.get(b, (0, 0))[0] + 1
    own = bucket.cast("int") + 1
    of = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), own)
    parts = of([cuts.get(b, (0, 0))[0] for b in range(len(starts))], "int")
    part = F.least(parts - 1, F.floor((F.col("tie") / 2.0**64 + 0.5) * parts))
    repeats = (parts > 0) & (least == of([cuts.get(b, (0, 0))[1] for b in range(len(starts))], "long"))
    return (of(starts, "int") + F.when(repeats, part).otherwise(parts)).cast("int")


def edited_fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Each document and its edited text: the last half replaced by the beginning of the next one's text.

    The next document is that of the next smaller doc_id; after the smallest comes the largest.  Null ids
    come after all others, equal ids go by a hash of their text; null text is empty.  A lone document is its
    own next one.  Rows are dealt into ranges of doc_id; the first row of a range is also sent to the range
    before it, so that no range needs another.  An id with very many rows is cut into ranges by that hash.
    An empty table gives none; a very long text is one row of its range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    count = parts or max(2 * tasks(spark), min(RANGES * tasks(spark), 4096))
    rows = rows.withColumn("tie", row_id("text"))
    rows = rows.withColumn("bucket", _ranges(rows, count))
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie").desc()]
    head = F.max(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), "tie")).alias("head")
    heads = sorted((r["bucket"], r["head"]["d"], r["head"]["tie"]) for r in rows.groupBy("bucket").agg(head).collect())  # a row a range
    if not heads:
        heads = [(0, 0, 0)]
    top = heads[-1][0]
    after = {b: heads[i + 1][0] if i + 1 < len(heads) else heads[0][0] for i, (b, _, _) in enumerate(heads)}  # where a range's head is needed: the range above; the top's in the lowest
    size = top + 1
    by = {b: (d, t, after[b]) for b, d, t in heads}
    column = lambda k, kind: F.array(*[F.lit(by[b][k]).cast(kind) if b in by else F.lit(None).cast(kind) for b in range(size)])
    own = F.col("bucket") + 1
    is_head = (F.coalesce("doc_id", F.lit(-(1 << 63))) == F.element_at(column(0, "long"), own)) & (F.col("tie") == F.element_at(column(1, "long"), own))
    places = F.when(is_head, F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("ghost")), F.struct(F.element_at(column(2, "int"), own).alias("b"), F.lit(1).alias("ghost")))).otherwise(F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("ghost"))))
    sent = rows.withColumn("x", F.explode(places)).select(F.col("x.b").alias("b"), F.col("x.ghost").alias("ghost"), "doc_id", "tie", "text")
    within = Window.partitionBy("b").orderBy("ghost", *order)
    sent = sent.repartition(tasks(spark), "b")
    placed = sent.withColumn("rn", F.row_number().over(within)).withColumn("next_text", F.lead("text").over(within))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    texts = placed.withColumn("n_chars", n.cast("long")).withColumn("edited", F.when(F.col("ghost") == 0, edited))
    step = Window.partitionBy("b").orderBy("rn")
    # lanes travel as 32-bit numbers; both sides hang on the one exchange of the texts
    exact = texts.select("b", "rn", "ghost", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), narrow(exact_lanes(F.col("text"))).alias("e0"), narrow(exact_lanes(F.col("edited"))).alias("e1"))
    exact = exact.withColumn("same_edited", F.col("e0") == F.col("e1")).withColumn("same_next", F.col("e0") == F.lead("e0").over(step)).filter("ghost = 0")
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t"))))
    each = texts.select("b", "rn", kinds.alias("x")).select("b", "rn", F.col("x.kind").alias("kind"), F.col("x.t").alias("t")).filter("t is not null")
    pairs = each.select("b", "rn", "kind", F.explode_outer(word_pairs(F.col("t"))).alias("h"))
    counted = pairs.groupBy("b", "rn", "kind").agg(F.count("h").alias("pairs"), *like_sums(F.col("h")))
    lanes = F.transform(like_lanes(F.col("pairs"), [f"s{i}" for i in range(LIKE // 2)]), lambda x: x.cast("int"))
    like = counted.select("b", "rn", "kind", lanes.alias("like")).groupBy("b", "rn").agg(F.max(F.when(F.col("kind") == 0, F.col("like"))).alias("l0"), F.max(F.when(F.col("kind") == 1, F.col("like"))).alias("l1"))
    like = like.withColumn("l2", F.lead("l0").over(step)).withColumns({"near_edited": likeness(F.col("l0"), F.col("l1")), "near_next": likeness(F.col("l0"), F.col("l2"))}).drop("l2")
    done = exact.join(like, ["b", "rn"])
    near = lambda same, c: F.when(F.col(same), F.lit(1.0)).otherwise(F.col(c)).alias(c)
    return done.select("doc_id", "n_chars", "edited_sha256", packed(wide(F.col("e0")), F.col("l0")).alias("fingerprint"), packed(wide(F.col("e1")), F.col("l1")).alias("edited_fingerprint"), near("same_edited", "near_edited"), near("same_next", "near_next"))
