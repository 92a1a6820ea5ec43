"""The ten operators and the pipeline against brute force, on whole small tables and on rows made to be awkward."""

import base64
import bisect
import collections
import hashlib
import os
import re
import struct
import subprocess
import sys
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidewatch.llm import audio, common, components, fingerprints, jaccard, langid, mixing, packing, queries, records, sharding, simhash, substrings, toxicity
from tidewatch.llm.tokens import WordEncoder

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(200)]
rng = np.random.default_rng(5)
LONG = " ".join(rng.choice(WORDS, 40_000))
PASSAGE = " ".join(rng.choice(WORDS, 60))


def frame(spark, texts, ids=None, **columns):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in zip(ids, texts, strict=True)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name, value in columns.items():
        df = df.withColumn(name, F.lit(value))
    return df


#: Nulls, empty and white texts, repeated rows, ties, a very long text, odd characters, shared passages.
AWKWARD = [None, "", " ", "a", "a", "\n\n", "x  y\t z\r\n", "é ß 日本語 🙂", "No letters? 123", "<|endoftext|> mid <|endoftext|>", "nul\0byte  here", LONG, "one " + PASSAGE + " two", PASSAGE + " three", "A b C d", "a B c D", "w " * 100, "tail\n", "  lead"]
AWKWARD_IDS = [3, 1, 2, 5, 5, 4, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, None, 18, 19]


@pytest.fixture(scope="module")
def awkward(spark):
    clash = {"fp": 1, "h": "x", "tie": 2.0, "bucket": 1, "g": 5, "size": "no", "b": 1, "rn": 2, "t1": 0, "did": 9, "p": 1, "piece": 3, "n": 1, "target": 2, "words": "w", "_n": 77, "_key": 88, "_own": 3, "_copy": 4, "_d": 5, "_t": 6, "key": 7, "own": 8, "place": 9, "copy": 10, "times": 11, "slice": 12, "kept": "k", "found": 1}
    return frame(spark, AWKWARD, AWKWARD_IDS, **clash)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(queries.TOKENIZER)


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# -- 1 fingerprints ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("which", ["awkward", "documents"])
def test_fingerprints_and_edits(request, which):
    df = request.getfixturevalue(which)
    got = fingerprints.edited_fingerprints(df, parts=4).collect()
    rows = texts_of(df)
    assert len(got) == len(rows)
    if which == "documents":
        rows.sort(key=lambda r: -r[0])
        want = {}
        for i, (doc_id, t) in enumerate(rows):
            k = len(t) // 2
            want[doc_id] = hashlib.sha256((t[: len(t) - k] + rows[(i + 1) % len(rows)][1][:k]).encode()).hexdigest()
        assert {r.doc_id: r.edited_sha256 for r in got} == want
        by_text = collections.defaultdict(set)
        for r in got:
            by_text[dict(rows)[r.doc_id]].add(r.fingerprint)
        assert all(len(v) == 1 for v in by_text.values()) and len(set.union(*by_text.values())) == len(by_text)
        assert np.mean([r.near_edited > r.near_next for r in got]) > 0.95
    assert sorted(r.n_chars for r in got) == sorted(len(t) for _, t in rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def brute_lanes(text):
    """A document's lanes by the definition: hashes of paragraphs' SHA-512, signs of bits of word pairs' hashes."""
    exact, like, pairs = [0] * fingerprints.EXACT, [0] * fingerprints.LIKE, 0
    for p in text.split("\n"):
        digest = hashlib.sha512(p.encode()).hexdigest().encode()
        for i in range(fingerprints.EXACT):
            exact[i] = (exact[i] + (xxhash.xxh64_intdigest(digest, xxhash.xxh64_intdigest(struct.pack("<i", i), 42)) & 0xFFFFFFFF)) % (1 << 32)
        words = p.split(" ")
        for a, b in zip(words, [*words[1:], None], strict=True):
            h = xxhash.xxh64_intdigest(a.encode(), 42)
            h = h if b is None else xxhash.xxh64_intdigest(b.encode(), h)
            for j, x in enumerate((h, xxhash.xxh64_intdigest(struct.pack("<Q", h), 42))):
                for k in range(32):
                    for half in (0, 1):
                        like[64 * j + 2 * k + half] += 1 if x >> (k + 32 * half) & 1 else -1
            pairs += 1
    return exact, like


def cosine(a, b):
    norm = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    return max(0.0, min(1.0, sum(x * y for x, y in zip(a, b, strict=True)) / norm)) if norm else 0.0


def test_fingerprints_by_brute_force(spark):
    texts = ["a b\nc", "c\na b", "", None, "x " * 40, "one two three four\nfive six", "one two three four\nfive seven", "é ß\n\n日本 語", "a b\nc"]
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(frame(spark, texts), parts=3).collect()}
    order = sorted(range(len(texts)), reverse=True)
    for at, i in enumerate(order):
        own, after = texts[i] or "", texts[order[(at + 1) % len(order)]] or ""
        k = len(own) // 2
        edited = own[: len(own) - k] + after[:k]
        lanes = [brute_lanes(t) for t in (own, edited, after)]
        r = got[i]
        for have, (exact, like) in zip((r.fingerprint, r.edited_fingerprint), lanes, strict=False):
            assert have == "".join(f"{x % (1 << 32):08x}" for x in [*exact, *like])
        for have, other in ((r.near_edited, lanes[1]), (r.near_next, lanes[2])):
            assert have == pytest.approx(1.0 if other[0] == lanes[0][0] else cosine(lanes[0][1], other[1]), abs=1e-9)
    assert got[0].fingerprint == got[1].fingerprint == got[8].fingerprint


def test_fingerprint_of_lone_and_empty(spark):
    assert fingerprints.edited_fingerprints(empty(spark)).count() == 0
    r = fingerprints.edited_fingerprints(frame(spark, ["abcd efgh"])).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcd abcd").hexdigest() and r.near_next == 1.0


@pytest.mark.parametrize("count", [1, 2, 3, 7, 50])
def test_key_buckets(spark, count):
    keys = [None, *sorted(int(v) for v in rng.integers(0, 1000, 300))]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    column, n = common.key_buckets(df, "k", count)
    got = [(r.b, -1 if r.k is None else r.k) for r in df.select("k", column.alias("b")).collect()]
    assert [b for b, _ in sorted(got, key=lambda x: x[1])] == sorted(b for b, _ in got)
    assert {b for b, _ in got} <= set(range(n)) and n <= count and max(collections.Counter(b for b, _ in got).values()) <= 2 * 301 // count + 3


def test_fingerprints_are_homomorphic(spark):
    df = spark.createDataFrame([("a\nb c\nd", "d\na\nb c", "a\nd", "b c")], "x string, y string, z string, p string")
    e = {c: fingerprints.exact_lanes(F.col(c)) for c in "xyzp"}
    r = df.select((e["x"] == e["y"]).alias("order"), (fingerprints.combined(e["z"], e["p"]) == e["x"]).alias("add"), (fingerprints.combined(e["x"], e["p"], -1) == e["z"]).alias("take"), (e["z"] == e["x"]).alias("other")).first()
    assert (r.order, r.add, r.take, r.other) == (True, True, True, False)


@pytest.mark.parametrize("hot", [7, None])
def test_fingerprints_of_one_id(spark, hot):
    ids = [hot] * 400 + [1, 3, 9, 12]
    texts = [f"text {i} of {len(ids)} " * (1 + i % 3) for i in range(len(ids))]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    rows = df.withColumn("tie", common.row_id("text"))
    sizes = [r["count"] for r in rows.groupBy(fingerprints._ranges(rows, 16)).count().collect()]
    assert len(sizes) >= 12 and max(sizes) < 80
    tie = {t: xxhash.xxh64_intdigest(t.encode(), 42) for t in texts}
    order = sorted(zip(ids, texts, strict=True), key=lambda r: (-(1 << 63) if r[0] is None else r[0], tie[r[1]] - (1 << 64) * (tie[r[1]] >> 63)), reverse=True)
    want = sorted(hashlib.sha256((t[: len(t) - len(t) // 2] + order[(i + 1) % len(order)][1][: len(t) // 2]).encode()).hexdigest() for i, (_, t) in enumerate(order))
    assert sorted(r.edited_sha256 for r in fingerprints.edited_fingerprints(df, parts=16).collect()) == want


# -- 2 media -----------------------------------------------------------------------------------------------


def test_media_round_trip(awkward):
    got = {(r.doc_id, r.n_bytes): r for r in audio.media_features(awkward).collect()}
    for doc_id, t in texts_of(awkward):
        raw = t.encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r = got[doc_id, len(raw)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        media = audio.to_wav(payload)
        assert audio.from_wav(media)[0] == payload and r.media_bytes == len(media) and r.media_sha256 == hashlib.sha256(media).hexdigest()


def brute_feature(payload):
    """The description of a sound, a frame at a time: convolution, a sum over bins for each band, a state machine."""
    x = (np.frombuffer(payload, np.uint8) - 128.0) / 128
    n = audio.UP * audio.TAPS
    h = np.sinc((np.arange(n) - (n - 1) / 2) / 4) / 4 * np.hamming(n) * audio.UP
    up = np.zeros(len(x) * audio.UP + 4 * n)
    up[: len(x) * audio.UP : audio.UP] = x
    y = np.convolve(up, h)[24:][:: audio.DOWN][: len(x) * 3 // 4]
    frames = -(-len(y) // audio.HOP)
    y = np.append(y, np.zeros(audio.FRAME))
    hz = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + 3000 / 700), audio.BANDS + 2) / 2595) - 1)
    bins = np.arange(audio.FRAME // 2 + 1) * 6000 / audio.FRAME
    mel, on, spans = [], False, []
    for f in range(frames):
        part = y[f * audio.HOP : f * audio.HOP + audio.FRAME]
        power = np.abs(np.fft.rfft(part * np.hanning(audio.FRAME))) ** 2
        mel.append([np.log10(max(1e-6, sum(p * max(0, min((b - lo) / (mid - lo), (hi - b) / (hi - mid))) for p, b in zip(power, bins, strict=True)))) for lo, mid, hi in zip(hz, hz[1:], hz[2:], strict=False)])
        db = 10 * np.log10(max(1e-6, (part**2).mean()))
        if not on and db > audio.BEGIN_DB:
            on = True
            spans.append([f, frames])
        elif on and db < audio.END_DB:
            on, spans[-1][1] = False, f
    mel = np.array(mel)
    seconds = sum(b - a for a, b in spans) * audio.HOP / 6000
    return [frames, len(spans), seconds, *mel.mean(0), *mel.std(0)]


def feature_numbers(feature):
    frames, count, seconds, mel = (x.split("=")[1] for x in feature.split(";"))
    pairs = [p.split("~") for p in mel.split(",")]
    return [int(frames), int(count), float(seconds), *(float(m) for m, _ in pairs), *(float(s) for _, s in pairs)]


def test_features_by_brute_force(spark, awkward, documents):
    loud = ["".join(own) for own in ("\x7f\x00" * 700 + "@" * 4000 + "\x01~" * 900, "a\u00ff" * 3000)]
    for df in (frame(spark, [None, "", "x y", *loud]), documents.orderBy("doc_id").limit(25)):
        texts = dict(texts_of(df))
        for r in audio.media_features(df).collect():
            got, want = feature_numbers(r.feature), brute_feature(audio.payload_of(texts[r.doc_id])[0])
            assert got[:2] == want[:2] and np.abs(np.array(got) - want).max() < 0.0101
    assert audio.media_features(empty(spark)).count() == 0


def test_media_parts_and_resampling(monkeypatch):
    sound = bytes(rng.integers(0, 256, 192 * 700, np.uint8))
    whole = audio.features(sound)
    monkeypatch.setattr(audio, "PART", 192 * 64)
    for a, b in zip(audio.features(sound), whole, strict=True):
        assert np.array_equal(a, b)
    x = rng.standard_normal(400)
    n = audio.UP * audio.TAPS
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / 4) / 4 * np.hamming(n) * audio.UP
    up = np.zeros(400 * audio.UP)
    up[:: audio.UP] = x
    full = np.convolve(up, h)
    assert np.abs(audio.resampled(x, 0, 300)[30:200] - full[4 * np.arange(30, 200) + 24]).max() < 1e-5


@pytest.mark.parametrize("threads", ["1", "2", "4", "8"])
def test_same_bits_whatever_the_threads(threads):
    code = "import sys, hashlib; sys.path.insert(0, sys.argv[1]); from tidewatch.llm import audio; p = bytes(i * i % 251 for i in range(192 * 500)); print(hashlib.sha256(b''.join(bytes(a.tobytes()) + b.tobytes() for a, b in audio.log_mel(p))).hexdigest())"
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = os.environ | dict.fromkeys(("OPENBLAS_NUM_THREADS", "OMP_NUM_THREADS", "MKL_NUM_THREADS"), threads)
    got = subprocess.run([sys.executable, "-c", code, root], env=env, capture_output=True, text=True, check=True).stdout.strip()
    p = bytes(i * i % 251 for i in range(192 * 500))
    assert got == hashlib.sha256(b"".join(a.tobytes() + b.tobytes() for a, b in audio.log_mel(p))).hexdigest()


def test_segments_and_tensors(spark):
    db = np.array([-20, -6, -7.5, -9, -7.5, -6, -6.0])
    assert audio.segments(db).tolist() == [[1, 3], [5, 7]]
    media = common.stored(audio.media_columns(frame(spark, ["x" * 192 * 200, None])), "media")
    out = audio.feature_tensors(media.filter("doc_id = 0")).toArrow().sort_by("block")
    tensors = audio.as_tensor_array(out.column("log_mel"))
    assert tensors.type.shape == [audio.TENSOR_FRAMES, audio.BANDS] and len(tensors) == out.num_rows
    mel = np.vstack([m for m, _ in audio.log_mel(b"x" * 192 * 200)])
    assert np.array_equal(tensors.to_numpy_ndarray().reshape(-1, audio.BANDS)[: len(mel)], mel)
    starts, ends = out.column("start_s").to_pylist(), out.column("end_s").to_pylist()
    assert starts[0] == 0 and starts[1:] == ends[:-1] and ends[-1] == pytest.approx(len(mel) / audio.PACE)
    whole = audio.as_tensor_array(media.toArrow().column("log_mel"))
    assert len(whole) == len(tensors) + 1  # the null text has one tensor


# -- 3 sharding --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [500, 20_000, 10**9])
def test_shards(awkward, documents, limit):
    for df in (documents, awkward):
        rows = sharding.sharded(df, limit=limit).collect()
        data = texts_of(df)
        assert len(rows) == len(data)
        bits = {i: format(int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16), "060b") for i, _ in data}

        def size(prefix, data=data, bits=bits):
            return sum(len(t.encode()) for i, t in data if bits[i].startswith(prefix))

        for r in rows:
            assert bits[r.doc_id].startswith(r.shard) and r.depth == len(r.shard) and r.shard_bytes == size(r.shard)
            assert r.shard_bytes <= limit or r.depth == sharding.BITS
            assert r.depth == 0 or size(r.shard[:-1]) > limit


def test_pages_hold_the_limit(spark, monkeypatch):
    """Rows of one id, of the null id, of several sizes and equal ones; the query's SQL gives the same rows."""
    sizes = [300] * 60 + [501, 700, 1000] + [7] * 200 + [0, 0]
    rows = [(5, "x" * n) for n in sizes] + [(None, "y" * 400)] * 9 + [(None, None)] * 3 + [(6, "z" * 5000), (7, "é" * 500), (8, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.sharded(df, limit=1000).collect()
    assert len(got) == len(rows)
    pages = collections.defaultdict(list)
    for r in got:
        pages[r.shard, r.page].append(r)
    for own in pages.values():
        total = sum(r.n_bytes for r in own)
        assert {r.page_bytes for r in own if r.depth == 60 and len({(x.doc_id) for x in own}) == 1} <= {total, own[0].shard_bytes}
        assert total <= 1000 or len(own) == 1
    assert {(r.page, r.page_bytes) for r in got if r.doc_id == 6} == {(0, 5000)}
    half_full = [sum(r.n_bytes for r in own) for (shard, _), own in pages.items() if len(shard) == 60]
    assert len(half_full) <= 2 * sum(half_full) / 1000 + 5
    duck = duckdb.connect()
    documents = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows])})
    duck.register("documents", documents)
    sql = queries.ORACLE_SQL["op3_extendible_sharding"].replace(str(queries.SHARD_BYTES), "1000")
    names = ["doc_id", "n_bytes", "depth", "shard", "shard_bytes", "page", "page_bytes"]
    assert collections.Counter(tuple(r[n] for n in names) for r in got) == collections.Counter(duck.execute(sql).fetchall())


def test_no_shards(spark):
    assert sharding.sharded(empty(spark)).count() == 0


# -- 4 substrings ------------------------------------------------------------------------------------------


def brute_substrings(texts):
    split = [re.findall(rb"[^\x20\x09-\x0D]+", t.encode()) for t in texts]
    n = substrings.WINDOW
    seen = collections.Counter(tuple(w[i : i + n]) for w in split for i in range(len(w) - n + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((len(w), sum(gone), b" ".join(kept).decode()))
    return out


def test_common_prefixes_and_nodes():
    """Neighbours' common prefixes, internal nodes and their depths against all pairs of suffixes."""
    own = np.random.default_rng(2)
    base = own.choice(["a", "b", "c"], 80).tolist()
    contexts = [" ".join(base[i : i + n + 34]).encode() for i, n in ((0, 24), (3, 10), (20, 12), (0, 24))] + [b" ".join([b"x"] * 50), " ".join(own.choice(WORDS, 40)).encode()]
    counts = np.array([len(c.split()) - 34 for c in contexts])
    order, common = substrings.common_prefixes(contexts, counts)
    suffixes = [c.split()[k:] for c, n in zip(contexts, counts, strict=True) for k in range(n)]

    def shared(x, y):
        return next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))

    ranked = [suffixes[i] for i in order]
    assert common.tolist() == [shared(x, y) for x, y in zip(ranked, ranked[1:], strict=False)]
    best = [max(shared(x, y) for j, y in enumerate(ranked) if i != j) for i, x in enumerate(ranked)]
    assert [d if d >= 35 else 0 for d in substrings.deepest(common)] == [d if d >= 35 else 0 for d in best]
    nodes = substrings.internal_nodes(common)
    want = set()
    for i in range(len(ranked)):
        for j in range(i + 1, len(ranked)):
            d = min(shared(ranked[k], ranked[k + 1]) for k in range(i, j))
            lower = (i == 0 or shared(ranked[i - 1], ranked[i]) < d) and (j == len(ranked) - 1 or shared(ranked[j], ranked[j + 1]) < d)
            if d >= 35 and lower:
                want.add((i, j, d))
    assert len(nodes) == len(set(nodes)) and set(nodes) == want


@pytest.mark.parametrize("large", [20_000, 2, 1])
def test_substrings(spark, awkward, documents, monkeypatch, large):
    monkeypatch.setattr(substrings, "LARGE", large)  # 2: all prefixes are lengthened, 1: and split
    near = [" ".join(rng.choice(WORDS, 30)) + " " + PASSAGE[: 40 + 5 * i] + " end" + str(i) for i in range(6)]
    extra = frame(spark, [*near, near[0], "r " * 200, LONG, *(" ".join([*own, "q" * 40 + str(i), *own]) for i in (1, 1, 2) for own in (["v" * 50 + str(k) for k in range(20)],))], range(100, 112))
    for df in (documents.limit(150) if large < 3 else documents, awkward.select(*SCHEMA.replace(" long", "").replace(" string", "").split(", ")).unionByName(extra)):
        rows = texts_of(df)
        want = sorted((-1 if i is None else i, *b) for (i, _), b in zip(rows, brute_substrings([t for _, t in rows]), strict=True))
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.without_repeats(df).collect())
        assert got == want


def test_no_substrings(spark):
    assert substrings.without_repeats(empty(spark)).count() == 0
    assert substrings.dedup_substrings(empty(spark)).columns == empty(spark).columns


def test_anchors_in_parts_agree():
    h = substrings._hashed([w.encode() for w in LONG.split()[:3000]])
    whole = {tuple(map(int, x)) for x in zip(*[c for k, c in enumerate(substrings.anchors(h, np.array([len(h)]))) if k != 1], strict=True)}
    covered = {p - lo + k for _, p, lo, hi in whole for k in range(lo - hi + 1)}
    assert covered == set(range(3000 - substrings.WINDOW + 1))
    parts = [b for b in substrings._long_rows((1, 2), h, step=700)]
    got = {p - lo + k for b in parts for p, lo, hi in zip(b.column("p").to_pylist(), b.column("lo").to_pylist(), b.column("hi").to_pylist(), strict=True) for k in range(lo - hi + 1)}
    assert got == covered


# -- 5 language --------------------------------------------------------------------------------------------


def brute_rank(text, size):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    s = f" {' '.join(words)} " if words else ""
    grams = collections.Counter(s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1))
    key = lambda g: (len(g), [0 if c == " " else ord(c) for c in g])
    ok = [g for g in grams if g != " " and not (len(g) == 3 and g[1] == " ")]
    return sorted(ok, key=lambda g: (-grams[g], key(g)))[:size]


def gram_number(g):
    value = len(g) - 1
    for c in [0] * (3 - len(g)) + [0 if c == " " else ord(c) for c in g]:
        value = value * 0x110000 + c
    return value


def test_ranks(documents):
    texts = [t for _, t in texts_of(documents.limit(40))] + [t or "" for t in AWKWARD]
    who, rank, key, letters = langid.ranked(texts, 50)
    for i, t in enumerate(texts):
        mine = who == i
        assert key[mine][np.argsort(rank[mine])].tolist() == [gram_number(g) for g in brute_rank(t, 50)]
        assert letters[i] == sum(c.isalpha() for c in t.lower())


def test_counts_of_any_size():
    """Ranks do not depend on how large the counts are."""
    text = " ".join(["ab"] * 700_000 + ["cd"] * 600_000 + ["ef"] * 3)
    who, rank, key, letters = langid.ranked([text, "x yy"], 50)
    assert key[who == 0][np.argsort(rank[who == 0])].tolist() == [gram_number(g) for g in brute_rank(text, 50)]
    assert letters.tolist() == [2_600_006, 3]


def brute_prediction(profiles, text):
    """The language by Cavnar and Trenkle's out-of-place distance, rank by rank."""
    mine = brute_rank(text, profiles.size)
    if not any(c.isalpha() for c in text.lower()):
        return "und"
    ranks = [{int(k): int(r) for k, r in zip(profiles.keys, column, strict=False) if r >= 0} for column in profiles.ranks[:-1].T]
    far = [sum(abs(own[gram_number(g)] - i) if gram_number(g) in own else profiles.size for i, g in enumerate(mine)) for own in ranks]
    return profiles.languages[int(np.argmin(far))]


def test_predictions_by_brute_force(spark, awkward):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    profiles = langid.learn(docs)
    rows = awkward.select("doc_id", "text").unionByName(docs.select("doc_id", "text").orderBy("doc_id").limit(80))
    got = [(r.doc_id, r.lang_pred) for r in langid.predict(rows, profiles).collect()]
    want = [(i, brute_prediction(profiles, t)) for i, t in texts_of(rows)]
    assert collections.Counter(got) == collections.Counter(want)
    assert langid.predict(empty(spark), profiles).count() == 0


def test_language_held_out(spark, awkward):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    profiles = langid.learn(docs)
    got = langid.predict(docs, profiles).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    odd = {(r.doc_id, r.tie): r for r in langid.predict(awkward, profiles).collect()}
    assert len([r for r in odd.values() if r.lang_pred == "und"]) == 4 and all(0 <= r.score <= 1 for r in odd.values())
    assert {r.lang_pred for r in langid.predict(docs.limit(3), langid.learn(empty(spark))).collect()} == {"und"}
    assert langid.with_language(docs, profiles).count() == docs.count()
    assert langid.with_language(awkward, profiles).columns == awkward.columns


# -- 6 toxicity --------------------------------------------------------------------------------------------


def test_kernel_matches_brute_force():
    def brute(a, b):
        def sub(w):
            c = ["^", *w, "$"]
            out = collections.Counter()
            for i in range(len(c)):
                for j in range(i + 1, min(len(c), i + 4)):
                    for k in range(j + 1, min(len(c), j + 4)):
                        out[c[i], c[j], c[k]] += toxicity.DECAY ** (k - i - 2)
            return out

        x, y = sub(a), sub(b)
        norm = sum(v * v for v in x.values()) * sum(v * v for v in y.values())
        return sum(v * y[k] for k, v in x.items()) / norm**0.5 if norm else 0.0

    words = ["abc", "a", "abxc", "éclat", "aaaa", "stupid", "stuxpid", "глупый", "глупыйй", "日本"]
    want = np.array([[brute(a, b) for b in words] for a in words])
    for landmarks in (words, words[:3]):  # characters that no landmark has count in the norm only
        kernel, n = toxicity.Kernel(landmarks), len(landmarks)
        assert np.abs(kernel.plain(words) - want[:, :n]).max() < 1e-5
        assert np.abs(kernel.values(words) - sum(want[:, :n] ** p for p in toxicity.POWERS)).max() < 1e-5


def test_decision_is_the_machines():
    """A text's decisions against sums of kernel values over the distinct words of each sentence."""
    kernel = toxicity.Kernel(["stupid", "clown", "tree"])
    m = toxicity.Model(kernel, np.array([2.0, 1.5, -0.5]), -0.7, np.array([1.0, 0.5, 0.25]), -0.2)
    text = "A st.upid stupid clowns tree. No words here! " + " ".join(f"w{i}x" for i in range(60)) + " clown… 12 34"
    found = []
    for part in ("A st.upid stupid clowns tree.".split(), "No words here!".split(), *(lambda w: [w[i : i + toxicity.LONGEST] for i in range(0, len(w), toxicity.LONGEST)])([f"w{i}x" for i in range(60)] + ["clown…"]), ["12", "34"]):
        words = dict.fromkeys(toxicity.unit(t) for t in part)  # "st.upid" and "stupid" are one word
        found.append(-0.7 + sum(float((kernel.plain([w]) ** 3 @ m.alpha)[0]) for w in words if w))
    want = sorted(found, reverse=True)[: toxicity.TOP]
    assert np.allclose(m.decisions([text, ""]), [want, [-0.7] * 3], atol=1e-5)
    assert np.allclose(m.scores([text])[0], 1 / (1 + np.exp(-(np.dot(want, m.slopes) - 0.2))), atol=1e-5)
    long = "z" * 20 + "stupid" + "z" * 30
    assert m.word_values([long])[0] == pytest.approx(sum(m.word_values(toxicity.pieces(long))), abs=1e-6)


def test_toxicity_learns_and_tolerates_gaps():
    names = [f"{a}{b}" for a in ("mor", "len", "tas", "vil", "dor", "kep") for b in ("an", "ith", "oma", "ed", "uns")]
    clean = [" ".join(rng.choice(names, 12)) + "." for _ in range(400)]
    bad = [" ".join([*rng.choice(names, 6), "stupid", *rng.choice(names, 5)]) + "." for _ in range(120)]
    m = toxicity.fit(clean + bad, [0] * 400 + [1] * 120)
    test = [" ".join([*rng.choice(names, 6), w, *rng.choice(names, 3)]) for w in ("stupid", "st.upid", "s t u p i d", "Stu-pid", "stuxpid")]
    assert (m.scores(test)[:4] > 0.5).all() and m.scores(test)[4] > m.scores(clean[:50]).max()
    assert (m.scores(clean[:100]) < 0.3).all() and 0 <= m.scores([""])[0] < 0.3
    assert np.allclose(toxicity.fit(clean[:3], [0, 0, 0]).scores(["x", ""]), 1e-3)


def test_toxicity_held_out(spark, awkward):
    path = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    m = toxicity.learn(docs, labels)
    got = toxicity.scored(docs, m).join(labels, "doc_id").filter("held_out").collect()
    s, y = np.array([r.score for r in got]), np.array([r.toxic for r in got])
    assert y[s >= 0.3].mean() > 0.9 and (s[y == 1] >= 0.3).mean() > 0.5  # 40 toxic texts to learn from
    odd = toxicity.scored(awkward, m).collect()
    assert len(odd) == len(AWKWARD) and all(0 <= r.score <= 1 for r in odd)
    none = toxicity.learn(empty(spark), labels)
    assert toxicity.scored(docs.limit(2), none).first().score == pytest.approx(0.5)


# -- 7 mixing ----------------------------------------------------------------------------------------------


def test_mix(spark, documents, awkward):
    for df in (documents, awkward.withColumn("source", F.when(F.col("doc_id") > 9, "b").when(F.col("doc_id") > 3, "a"))):
        rows = mixing.mixed(df).collect()
        again = mixing.mixed(df.repartition(3)).collect()
        key = lambda r: (r.doc_id is None, r.doc_id or 0, r.tie, r.times)
        assert [tuple(r) for r in sorted(rows, key=key)] == [tuple(r) for r in sorted(again, key=key)]
        sources = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
        size = {s: sum(r["size"] for r in rows if r.source == s) for s in sources}
        weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sources)}
        total, full = sum(size.values()), set()
        while True:  # the excess of sources that are full is shared among the others
            left = total - sum(3 * size[s] for s in full)
            share = {s: left * weight[s] / sum(weight[x] for x in sources if x not in full) for s in sources if s not in full}
            more = {s for s, v in share.items() if v > 3 * size[s]}
            if not more:
                break
            full |= more
        for s in sources:
            mine = [r for r in rows if r.source == s]
            assert all(r.source_size == size[s] for r in mine)
            assert mine[0].target == pytest.approx(3 * size[s] if s in full else share[s])
            taken = sum(r["size"] * r.times for r in mine)
            assert abs(taken - mine[0].target) <= max(30, max(r["size"] for r in mine) if len(mine) < 30 else 0.01 * mine[0].target)
        assert all(0 <= r.times <= 3 for r in rows)
    assert mixing.mixed(empty(spark)).count() == 0


def test_flight_keeps_both_totals():
    size = rng.integers(1, 900, 500).astype(float)
    p = np.full(500, 0.37)
    moved = mixing.fly(p, size, np.random.default_rng(1))
    open_ = (moved > 0) & (moved < 1)
    assert open_.sum() <= 2
    assert abs(moved.sum() - p.sum()) < 1e-5 and abs(moved @ size - p @ size) < 1e-3
    picks = np.mean([mixing.fly(np.full(6, 0.5), np.arange(1.0, 7), np.random.default_rng(k)) for k in range(3000)], axis=0)
    assert np.abs(picks - 0.5).max() < 0.04


# -- 8 packing and 10 records ------------------------------------------------------------------------------


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")


def test_word_encoder(tokenizer, documents):
    e = WordEncoder(queries.TOKENIZER, keep=50)
    texts = [t for _, t in texts_of(documents.limit(60))] + [t or "" for t in AWKWARD]
    for _ in range(2):
        for t, got in zip(texts, e.encode(texts), strict=True):
            assert np.frombuffer(got, e.dtype).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("which,group", [("awkward", 40_000), ("documents", 40_000), ("documents", 20)])
def test_packing(request, tokenizer, which, group):
    df = request.getfixturevalue(which)
    got = packing.pack_documents(df, queries.TOKENIZER, group=group).collect()
    want = collections.Counter()
    tokens = 0
    for doc_id, t in texts_of(df):
        ids = ids_of(tokenizer, t)
        tokens += len(ids)
        first = len(ids) % 2048 or 2048
        edges = [0, *range(first, len(ids) + 1, 2048)]
        want.update((doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False)) and sum(parts[-1]) <= 2048
    assert len(sequences) <= -(-tokens // 2048) * 1.03 + 2


def test_packing_in_many_rounds(spark):
    sizes = np.random.default_rng(3).integers(20, 50, 300).tolist()
    pieces = spark.createDataFrame([(i, 7, 0, s) for i, s in enumerate(sizes)], "doc_id long, tie long, piece int, length long")
    rows = packing.packed(pieces, capacity=100, group=5).collect()
    assert sorted(r.doc_id for r in rows) == list(range(300))
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        assert sum(n for _, n in parts) <= 100
        assert all(a + n <= b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:], strict=False))


def test_pack_rule():
    sizes = rng.integers(1, 2048, 3000)
    bins, offsets = packing.pack(sizes)
    fill = np.bincount(bins, sizes)
    assert fill.max() <= 2048 and len(fill) <= sizes.sum() / 2048 * 1.05 + 1
    for b in range(5):
        at = np.flatnonzero(bins == b)
        at = at[np.argsort(offsets[at])]
        assert offsets[at].tolist() == (np.cumsum(sizes[at]) - sizes[at]).tolist()


def test_pack_by_the_rule():
    """Each piece, largest first, against the sum of squares tried out for every open sequence."""
    sizes = np.random.default_rng(8).integers(1, 40, 250)
    bins, offsets = packing.pack(sizes, 40)
    fill, made = {}, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        fits = [b for b, f in fill.items() if f < 40 and f + sizes[i] <= 40]

        def squares(b, i=i):
            gaps = collections.Counter(40 - (f + sizes[i] if x == b else f) for x, f in fill.items())
            return sum(n * n for g, n in gaps.items() if g)

        if fits:
            best = min(squares(b) for b in fits)
            gap = min(40 - fill[b] for b in fits if squares(b) == best)
            assert 40 - fill[bins[i]] == gap and offsets[i] == fill[bins[i]]
        else:
            assert bins[i] not in fill and offsets[i] == 0
            made += 1
        fill[bins[i]] = fill.get(bins[i], 0) + int(sizes[i])
    assert made == len(fill)


@pytest.mark.parametrize("shape", ["uniform", "lognormal"])
def test_sequences_against_the_bound_and_best_fit(shape):
    own = np.random.default_rng(9)
    sizes = own.integers(1, 2049, 6000) if shape == "uniform" else np.clip(own.lognormal(5.5, 1.0, 6000), 1, 2048).astype(int)
    used = packing.pack(sizes)[0].max() + 1
    gaps, best_fit = [], 0  # plain best fit, largest first
    for s in sorted(sizes.tolist(), reverse=True):
        at = bisect.bisect_left(gaps, s)
        best_fit += at == len(gaps)
        gap = gaps.pop(at) if at < len(gaps) else 2048
        if gap > s:
            bisect.insort(gaps, gap - s)
    bound = -(-int(sizes.sum()) // 2048)
    assert bound <= used <= bound * 1.02 + 1 and used <= best_fit * 1.005 + 1


@pytest.mark.parametrize("which", ["awkward", "documents"])
def test_records(request, spark, tokenizer, which):
    df = request.getfixturevalue(which)
    out, shards = records.write_records(df, queries.TOKENIZER, shards=3)
    got = sorted(records.read_records(spark, out).collect(), key=lambda r: r.start)
    rows = texts_of(df)
    assert sum(s[1] for s in shards) == len(rows)
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)
    want = collections.Counter((i, len(ids_of(tokenizer, t)), zlib.crc32(ids_of(tokenizer, t).tobytes())) for i, t in rows)
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    shard = next(s for s, n, _ in shards if n)
    doc_id, ids = records.read_record(out, shard, 0)
    assert doc_id == got[0].doc_id and zlib.crc32(ids.astype("<u4").tobytes()) == got[0].ids_crc32


def test_empty_records(spark):
    out, _ = records.write_records(empty(spark), queries.TOKENIZER)
    assert records.read_records(spark, out).count() == 0
    assert packing.pack_documents(empty(spark), queries.TOKENIZER).count() == 0


def test_checksums_and_damage():
    def slow(data):
        c = 0xFFFFFFFF
        for x in data:
            c ^= x
            for _ in range(8):
                c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    assert slow(b"123456789") == 0xE3069283
    data = [rng.bytes(n) for n in (4, 6, 8, 510, 512, 514, 1024, 3000)]
    assert records.crc32c(data).tolist() == [slow(d) for d in data]
    frame_ = records.frames([data[-1]])[0]
    assert struct.unpack("<Q", frame_[:8])[0] == 3000 and records.unframed([frame_]) == [data[-1]]
    for at in (9, 100, len(frame_) - 1):
        broken = bytearray(frame_)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            records.unframed([bytes(broken)])


# -- 9 simhash ---------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode()
    w = re.findall(rb"[^\x20\x09-\x0D]+", lower)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(values, radius=3):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= radius:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("which", ["awkward", "documents"])
def test_near_groups(request, which):
    df = request.getfixturevalue(which)
    rows = texts_of(df)
    values = [brute_fingerprint(t) for _, t in rows]
    groups = brute_groups(values)
    least = {g: min(i for (i, _), x in zip(rows, groups, strict=True) if x == g and i is not None) if any(i is not None for (i, _), x in zip(rows, groups, strict=True) if x == g) else None for g in set(groups)}
    want = collections.Counter((i, v, least[g]) for (i, _), v, g in zip(rows, values, groups, strict=True))
    assert collections.Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_groups(df).collect()) == want
    kept = simhash.near_dedup(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None]
    assert sorted(ids) == sorted({v for v in least.values() if v is not None})


def test_columns_that_clash_stay(awkward):
    """Stages that return the documents leave a user's columns as they are, whatever their names."""
    extra = [c for c in awkward.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    want = {tuple(awkward.first()[c] for c in extra)}
    for out in (simhash.near_dedup(awkward), jaccard.near_dedup(awkward), mixing.mix_documents(awkward), substrings.dedup_substrings(awkward)):
        assert out.columns == awkward.columns
        assert {tuple(r[c] for c in extra) for r in out.collect()} == want
    assert {tuple(f.collect()) for f in (simhash.near_dedup(awkward.limit(0)), jaccard.near_dedup(awkward.limit(0)), mixing.mix_documents(awkward.limit(0)), substrings.dedup_substrings(awkward.limit(0)))} == {()}


def test_every_near_pair_meets():
    m = [x & (1 << 64) - 1 for x in simhash.masks()]
    for _ in range(2000):
        d = sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 4)), replace=False))
        assert any(d & x == 0 for x in m)


@pytest.mark.parametrize("large", [20_000, 3])
def test_links_of_a_dense_cluster(spark, monkeypatch, large):
    monkeypatch.setattr(simhash, "LARGE", large)  # 3: every bucket is divided
    centre = int(rng.integers(1 << 62))
    values = {centre ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 7)), replace=False)) for _ in range(150)} | {int(x) for x in rng.integers(0, 1 << 62, 50)}
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = components.components(simhash.near_links(fps)).collect()
    root = {r.node: r.root for r in found}
    mine = [root.get(v, v) for v in signed]
    pairs = {(a == b) == (x == y) for a, x in zip(mine, brute_groups(values), strict=True) for b, y in zip(mine, brute_groups(values), strict=True)}
    assert pairs == {True}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_no_groups(spark):
    assert simhash.near_groups(empty(spark)).count() == 0


# -- the pipeline ------------------------------------------------------------------------------------------


def test_pipeline(spark, documents, tokenizer):
    docs = documents
    before = dict(texts_of(docs))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        path = corpus_pipeline.stored(out, f"test-{k}")
        if k < 4:
            assert path.columns == documents.columns
        rows = path.collect()
        if k == 0:
            assert len(rows) == docs.count()  # all of these have letters of a known language
        if k == 1:
            assert len(rows) == len(set(brute_likeness([r.text or "" for r in docs.collect()])))
        if k == 2:
            was = texts_of(docs)
            want = {i: b for (i, _), b in zip(was, brute_substrings([t for _, t in was]), strict=True)}
            assert {r.doc_id: r.text for r in rows} == {i: b[2] if b[1] else dict(was)[i] for i, b in want.items() if b[2] or not b[1]}
            assert all(r.n_chars == len(r.text) for r in rows if r.text != before[r.doc_id])
        if k == 3:
            assert max(collections.Counter(r.doc_id for r in rows).values()) <= 3
        if k == 4:
            assert sum(r.length for r in rows) == sum(len(ids_of(tokenizer, r.text or "")) for r in docs.collect())
        docs = path
    key = lambda rows: collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert key(corpus_pipeline.run(spark, DATA).collect()) == key(docs.collect())


def test_pipeline_drops_what_has_no_language(spark, documents):
    odd = frame(spark, ["123 456 !!", None, "", documents.first().text], [900, 901, 902, 903])
    kept = corpus_pipeline.identify_language(spark, documents.unionByName(odd), DATA)
    assert {r.doc_id for r in kept.filter("doc_id >= 900").collect()} == {903}


def test_pipeline_drops_unlearned_languages_and_noise(spark):
    own = np.random.default_rng(12)
    odd = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
        "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek.",
        " ".join("".join(own.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(60)),
        base64.b64encode(own.bytes(300)).decode(),
        own.bytes(300).hex(),
    ]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    clean = docs.filter(F.col("text").rlike("[A-Za-z]"))
    planted = frame(spark, odd + [o * 10 for o in odd], range(10**6, 10**6 + 2 * len(odd)))
    planted = planted.withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.identify_language(spark, clean.unionByName(planted), DATA)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in clean.select("doc_id").collect()}


def brute_likeness(texts):
    """Groups by a Jaccard likeness of 0.8 or more of five-word shingles, all pairs compared."""
    sets = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t).encode())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if root[i] != root[j] and (5 * len(a & b) >= 4 * len(a | b)):
                root = [root[j] if r == root[i] else r for r in root]
    return root


@pytest.mark.parametrize("common", [4, 1])
def test_pipeline_drops_every_near_copy(spark, documents, awkward, monkeypatch, common):
    monkeypatch.setattr(jaccard, "COMMON", common)  # 1: the order comes from the sample alone
    own = np.random.default_rng(11)
    texts = []
    for n in (5, 9, 40, 300, 1500):
        base = own.choice(WORDS, n).tolist()
        for changes in (0, 0, *(max(1, n // k) for k in (80, 60, 50, 45, 40, 30))):
            w = list(base)
            for at in own.choice(n, changes, replace=False) if changes else ():
                w[at] = f"new{own.integers(1 << 30)}"
            texts.append(" ".join(w))
    planted = frame(spark, texts, range(1000, 1000 + len(texts)))
    values = [brute_fingerprint(t) for t in texts]
    assert len(set(brute_likeness(texts))) < len(set(brute_groups(values)))  # the old links miss some
    for df in (planted, documents.unionByName(planted), awkward):
        rows = texts_of(df)
        groups = brute_likeness([t for _, t in rows])
        want = {min((i for (i, _), x in zip(rows, groups, strict=True) if x == g and i is not None), default=None) for g in set(groups)} - {None}
        kept = corpus_pipeline.drop_near_copies(spark, df, DATA)
        assert kept.columns == df.columns
        assert sorted(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None) == sorted(want)
