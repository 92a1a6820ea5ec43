"""Alignment, filter audit and personal data against brute force, on whole small tables and on awkward rows."""

import collections
import hashlib
import itertools
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm import AWKWARD, AWKWARD_IDS, DATA, LONG, SCHEMA, awkward, documents, frame, pytestmark  # noqa: F401

from tidewatch.llm import alignment, filter_audit, pii, queries

A, B = queries.TOKENIZER, queries.PIECES


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- 11


def slow_alignment(text):
    """(A ids, B ids, groups, links) by positions, one token after the other."""
    both = alignment.two_tokenizers(A, B)
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(A)
    plain.encode_special_tokens = True
    a, b = plain.encode(" " + (text or ""), add_special_tokens=False).ids, both.b.encode(text or "")
    raw = (" " + (text or "")).encode()
    if not text or b"".join(both.bytes_a[i] for i in a) != raw or b"".join(both.bytes_b[i] for i in b) != raw:
        return [], [], "", []
    ends_a, ends_b = (list(itertools.accumulate(len(t[i]) for i in ids)) for t, ids in ((both.bytes_a, a), (both.bytes_b, b)))
    at_a, at_b = dict(zip(ends_a, a, strict=True)), dict(zip(ends_b, b, strict=True))
    shared = sorted(set(ends_a) & set(ends_b))
    groups, x, y = [], 0, 0
    for e in shared:
        p, q = ends_a.index(e) + 1, ends_b.index(e) + 1
        groups.append(",".join(map(str, a[x:p])) + "|" + ",".join(map(str, b[y:q])))
        x, y = p, q
    return a, b, ";".join(groups), [(at_a[e], at_b[e]) for e in shared]


def slow_alignments(rows):
    found = [(i, *slow_alignment(t)) for i, t in rows]
    counts = collections.Counter(link for *_, links in found for link in links)
    highest = collections.defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    out = []
    for i, a, b, groups, links in found:
        best = sum(counts[x] == highest[x[1]] for x in links)
        out.append((i, len(a), len(b), len(links), len(links), best, sum(counts[x] for x in links), hashlib.sha256(groups.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("n_chars < 3000")
    got = sorted_rows(alignment.alignments(docs, A, B).select(ALIGNED))
    assert got == slow_alignments([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_alignment_of_awkward_rows(spark, awkward):  # noqa: F811
    short = awkward.filter(F.length(F.coalesce("text", F.lit(""))) < 5000)
    extra = spark.createDataFrame([(50, "x▁y"), (51, "<|endoftext|></s>"), (52, "a\x00b\tc  "), (53, "🙂🙂é"), (51, "<|endoftext|></s>")], "doc_id long, text string")
    rows = short.select("doc_id", "text").unionByName(extra)
    got = sorted_rows(alignment.alignments(rows.withColumn("pairs", F.lit("clash")), A, B).select(ALIGNED))
    assert got == slow_alignments([(r["doc_id"], r["text"]) for r in rows.collect()])
    assert alignment.alignments(frame(spark, [LONG], [1]), A, B).first()["n_a"] > 40_000
    assert not alignment.alignments(frame(spark, []), A, B).collect()


def test_intervals_are_overlaps_and_products_expand(spark):
    cut = alignment.align(np.array([2, 5, 9]), np.array([3, 5, 6, 9]))
    assert cut.ends.tolist() == [2, 3, 5, 6, 9] and cut.closes.tolist() == [False, False, True, False, True]
    assert list(zip(cut.owner_a.tolist(), cut.owner_b.tolist(), strict=True)) == [(0, 0), (1, 0), (1, 1), (2, 2), (2, 3)]
    docs = frame(spark, ["the unbelievable tokenization of 日本", "", None, "x"], [7, 8, 9, 10])
    groups = alignment.token_groups(docs, A, B).orderBy("doc_id", "group").collect()
    for i, text in ((7, "the unbelievable tokenization of 日本"), (10, "x")):
        a, b, listed, _ = slow_alignment(text)
        own = [g for g in groups if g["doc_id"] == i]
        assert ";".join(",".join(map(str, g["a_ids"])) + "|" + ",".join(map(str, g["b_ids"])) for g in own) == listed
        assert [g["start"] for g in own] == [0, *[g["end"] for g in own[:-1]]] and own[-1]["end"] == len(text.encode()) + 1
    products = alignment.token_products(alignment.token_groups(docs, A, B))
    assert products.count() == sum(len(g["a_ids"]) * len(g["b_ids"]) for g in groups) == alignment.alignments(docs, A, B).agg(F.sum("n_products")).first()[0]
    by_id = alignment.vocabulary_map(docs, A, B).collect()
    assert len(by_id) == len({(r["a_id"], r["b_id"]) for r in by_id}) and sum(r["n"] for r in by_id) == len(groups)


# --- 12


def slow_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1} - {None}  # a null id is nobody's
    toxic = {i for i, _, t in labels if t == 1} - {None}
    firsts = {}
    for i, t, _ in rows:
        if i is not None:
            firsts[t or ""] = min(i, firsts.get(t or "", i))
    judged = []
    for i, t, source in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > firsts[t]}
        judged.append((source or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out, shapley = {}, collections.Counter()
    for part in {j[0] for j in judged}:
        own = [j for j in judged if j[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [j for j in left if f in j[1]]
                left = [j for j in left if f not in j[1]]
                failing = sum(f in j[1] for j in own)
                out[part, order, step] = [len(left), len(gone), failing - len(gone), sum(j[1] == {f} for j in own), sum(j[2] for j in gone), sum(j[3] for j in gone)]
                shapley[part, f] += len(gone)
    return sorted(((p, o, s, *v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()), key=str)


def test_audit_against_brute_force(spark, awkward):  # noqa: F811
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 1), (16, None, 1), (None, 1, 1), (13, 1, None)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash")).withColumn("part", F.lit(1))
    more = frame(spark, ["same # text"] * 6 + ["SHOUT " * 60, " ".join(map(str, range(70)))], [30, 31, 31, None, 29, 40, 41, 42]).withColumn("source", F.lit(None).cast("string"))
    rows = awkward.select("doc_id", "text", "source").unionByName(more.select("doc_id", "text", "source")).withColumn("fails", F.lit("clash")).withColumn("digest", F.lit(3))
    got = sorted_rows(filter_audit.filter_audit(rows, labels))
    want = slow_audit([(r["doc_id"], r["text"], r["source"]) for r in rows.collect()], [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    assert got == want and len(got) == 2 * 600
    assert not filter_audit.filter_audit(rows.limit(0), labels).collect()
    assert len(filter_audit.filter_audit(rows, labels.limit(0)).collect()) == 1200


def test_audit_against_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    got = queries.op12_filter_audit(spark, DATA)
    want = con.sql(queries.ORACLE_SQL["op12_filter_audit"]).select(*got.columns).fetchall()
    assert sorted_rows(got) == sorted(want, key=str)


def test_a_hot_key_is_looked_up_by_broadcast(spark):
    rows = filter_audit.stored(spark.range(4000).select(F.when(F.col("id") < 3000, F.when(F.col("id") < 1500, 7)).otherwise(F.col("id")).alias("k")), "rows")
    facts = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = filter_audit.looked_up(rows, facts, "k")
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter([(7, 14)] * 1500 + [(None, None)] * 1500 + [(i, 2 * i) for i in range(3000, 4000)])


def test_each_state_is_entered_once(spark, monkeypatch):
    names = []
    keep = filter_audit.stored
    monkeypatch.setattr(filter_audit, "stored", lambda df, name: names.append(name) or keep(df, name))
    rows = keep(spark.createDataFrame([("p", 5, 1, 0), ("p", 2, 0, 1)], "part string, fails int, good int, toxic int"), "rows")
    assert len(filter_audit.audit(rows, "ABCD").collect()) == 24 * 4
    states = [n for n in names if n.startswith("survivors")]
    assert len(states) == len(set(states)) == 2**4 - 2


# --- 13


def slow_base(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()]
        if 14 <= len(digits) <= 19 and sum(sum(divmod(d * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


def test_base_spans_against_the_patterns():
    rng = np.random.default_rng(3)
    for letters in ("0123456789..@@+- ()ab  \n", "012.", "1.@ab", "+123 ()-", "49 -"):
        for _ in range(4000):
            text = "".join(rng.choice(list(letters), int(rng.integers(1, 60))))
            assert [tuple(s) for s in pii.base_spans(text)] == slow_base(text), text
    for long in ("1" * 200_000, "a" * 200_000, "1." * 100_000, "@" * 200_000, "a@b " * 50_000, "+1" * 100_000, " at a" * 40_000, "1:" * 100_000):
        pii.proposals(long), pii.base_spans(long)  # linear: any of these would take minutes otherwise


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(9)
    words = ["the", "order", "came", "late", "for", "us", "and", "so", "it", "goes"]

    def digits(n):
        return "".join(map(str, rng.integers(0, 10, n)))

    def card():
        body = "4" + digits(14)
        return body + next(c for c in "0123456789" if pii.luhn(body + c))

    made = [lambda: f"name{digits(2)}@mail{digits(1)}.example.com", lambda: ".".join(str(rng.integers(256)) for _ in range(4)), card, lambda: f"+1 ({digits(3)}) 555-{digits(4)}"]
    texts = [" ".join(rng.choice(words, 8)) + " " + made[k % 4]() + " " + " ".join(rng.choice(words, 8)) for k in range(1200)]
    return frame(spark, texts)


def test_learned_spans_on_held_out_rows(spark, people):
    model = pii.learn(people)
    assert max(model.thresholds) <= 1
    again = pii.learn(people.repartition(7))
    assert np.array_equal(model.trees.leaf, again.trees.leaf) and model.thresholds == again.thresholds
    rng = np.random.default_rng(77)  # other numbers than the model has seen
    made = {
        "email": lambda: f"jo{rng.integers(99)} (at) post{rng.integers(9)}.example.org",
        "ip": lambda: "[.]".join(str(rng.integers(256)) for _ in range(4)),
        "phone": lambda: f"{rng.integers(200, 999)}.{rng.integers(200, 999)}.{rng.integers(1000, 9999)}",
    }
    for kind, make in made.items():
        hits = 0
        for _ in range(100):
            body = make()
            base, found = pii.all_spans(f"so it goes {body} and late", model)
            hits += not base and f"{kind}:11:{11 + len(body)}" in pii.listed(found)
        assert hits >= 80, (kind, hits)
    clean = ["it came on 2024-03-17 at 12:30:45 and left", "page 12-14 of version 3.14", "order 1234-5678-90 is late", "we met at noon. Then home", "it cost $ 1,234.50 in all", "token = \"f17524f7594f8e408f2f741070\""]
    assert not [t for t in clean if pii.all_spans(t, model)[1]]


def test_all_windows_are_learned_from(spark):
    docs = frame(spark, [f"write to jo{k} of name{k}@post{k % 7}.example.com or so" for k in range(4000)])  # more than 3,000 of a kind
    windows = [tuple(r) for b in pii._window_rows(iter([pa.RecordBatch.from_pydict({"text": [r["text"] for r in docs.collect()]})])) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    x, y, kinds, later = pii.examples(windows)
    x, y = x[~later & (kinds == 0)], y[~later & (kinds == 0)]
    trees = pii.learn(docs).trees
    place = pii._place(x, np.zeros(len(x), int), trees.feature[0], trees.cut[0], 4)  # the first round's tree of one kind
    g, h = np.bincount(place, y - 0.5, 16), np.bincount(place, np.full(len(x), 0.25), 16)
    assert len(x) > 3000 and np.allclose(trees.leaf[0, 0], 0.4 * g / (h + 2), atol=1e-9)
    gain = max((np.sum(y[m] - 0.5) ** 2 / (m.sum() / 4 + 2) + np.sum(y[~m] - 0.5) ** 2 / ((~m).sum() / 4 + 2) for j in range(x.shape[1]) for m in (x[:, j] <= c for c in np.unique(x[:, j])[:-1])), default=0)
    m = x[:, trees.feature[0, 0, 0]] <= trees.cut[0, 0, 0]
    assert np.sum(y[m] - 0.5) ** 2 / (m.sum() / 4 + 2) + np.sum(y[~m] - 0.5) ** 2 / ((~m).sum() / 4 + 2) >= gain * 0.99  # the best cut, up to the bins


def test_personal_data_of_awkward_rows(spark, awkward, people):  # noqa: F811
    model = pii.learn(people)
    extra = frame(spark, ["a@b.c 1.2.3.4 x 4111111111111111 x +1 (234) 555-0000", "é🙂 x@y.zz", "jo (at) mail1.example.com, 10[.]0[.]0[.]1"], [60, 61, 62])
    rows = awkward.select("doc_id", "text").unionByName(extra.select("doc_id", "text")).withColumn("spans", F.lit("clash"))
    got = pii.personal_data(rows, model).collect()
    assert len(got) == len(AWKWARD) + 3 and collections.Counter(r["doc_id"] for r in got) == collections.Counter([*AWKWARD_IDS, 60, 61, 62])
    texts = {r["doc_id"]: r["text"] or "" for r in rows.collect()}
    for r in got:
        base = [pii.Span(*s) for s in slow_base(texts[r["doc_id"]])]
        assert r["base_sha256"] == hashlib.sha256(pii.listed(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s.kind == i for s in base) for i in range(4)]
        assert not base or set(pii.listed(base).split(",")) <= set(r["spans"].split(","))
    assert next(r["spans"] for r in got if r["doc_id"] == 61) == "email:3:9"
    assert not pii.personal_data(rows.limit(0), model).collect()
    nothing = pii.learn(rows.limit(0))
    assert nothing.trees is None and pii.all_spans("jo (at) a.b 1.2.3.4", nothing)[1] == [pii.Span(12, 1, 19)]
    hidden = {r["doc_id"]: r["text"] for r in pii.redacted(extra, model).collect()}
    assert hidden[60] == "[EMAIL] [IP] x [CARD] x [PHONE]" and hidden[61] == "é🙂 [EMAIL]"


def test_op13_on_the_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in queries.op13_personal_data(spark, DATA).collect():
        base = pii.listed([pii.Span(*s) for s in slow_base(texts[r["doc_id"]])])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()


# --- the pipeline's near-dedup


def test_a_shared_passage_makes_no_square_of_pairs(spark, monkeypatch):
    """Texts that share a passage, at a likeness of 0.77, are in one bucket; next to none of their pairs is compared."""
    from tidewatch.llm import jaccard

    rng, words, seen = np.random.default_rng(0), [f"w{i}" for i in range(5000)], []
    keep = jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, reps, texts: seen.append((kept := jaccard.stored(pairs, "pairs")).count()) or keep(kept, reps, texts))
    passage = " ".join(rng.choice(words, 56))
    for n in (150, 300, 600):
        texts = [passage + " " + " ".join(rng.choice(words, 8)) for _ in range(n)]
        near = [texts[0] + " more", texts[1] + " more"]
        seen.clear()
        groups = jaccard.near_groups(frame(spark, texts + near))
        assert groups.select("component_id").distinct().count() == n
        assert sum(seen) <= 4 * n  # of n^2 / 2 pairs


def test_loads_are_counts_of_texts(spark):
    from tidewatch.llm import jaccard

    texts = ["a b c d e f", "a b c d e f", "x a b c d e", None, "", "one"]
    loads = jaccard.shingle_loads(frame(spark, texts))
    want = collections.Counter(int(h >> np.uint64(40)) for t in texts for h in jaccard.shingle_set(t or ""))
    assert {i: int(loads[i]) for i in np.flatnonzero(loads)} == want
    assert not jaccard.shingle_loads(frame(spark, [])).any()


def test_languages_are_learned_from_all_rows(spark):
    from tidewatch.llm import langid

    docs = spark.range(5200).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.concat(F.lit("the "), F.lower(F.md5(F.col("id").cast("string")))).alias("text"))
    learned = docs.filter(~langid.held_out()).select("lang", "text")
    assert learned.count() > 3500 and langid.learning_rows(docs).count() == learned.count()
    # a word of one row in the learning part is counted, wherever its id's hash lies
    words = docs.filter(~langid.held_out()).withColumn("text", F.concat(F.lit("q"), F.col("doc_id").cast("string"), F.lit("q")))
    pairs = langid.learning_rows(words).mapInArrow(langid._count_rows, "lang string, key long, n long").agg(F.sum("n").alias("n")).first().n
    alone = langid._grams(["q q"])[2].sum()
    assert pairs == alone * words.count()


def test_a_worker_gives_its_free_memory_back():
    """A worker that has cut texts keeps no more than it began with, so that the next stage has it."""
    import subprocess
    import sys

    code = """
import pyarrow as pa
from tidewatch.llm import langid
held = lambda: int(open('/proc/self/statm').read().split()[1]) * 4096 >> 20
texts = [' '.join(str(i * k) + chr(97 + (i * k) % 26) * 5 for k in range(200)) for i in range(4000)]
batch = pa.RecordBatch.from_arrays([pa.array(['en'] * len(texts)), pa.array(texts)], names=['lang', 'text'])
list(langid._count_rows(iter([batch.slice(0, 10)])))
before = held()
for _ in langid._count_rows(iter([batch])):
    pass
print(held() - before, langid.SLICE)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, check=True, env={**__import__("os").environ})
    more, size = map(int, out.stdout.split())
    assert more < 60 and size <= 1 << 18
