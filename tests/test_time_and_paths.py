"""Joins in time, claims, communities, paths and checked claims against brute force, with one key for all rows among the cases."""

import numpy as np
import pytest
from onetask import betweenness, louvain, modularity
from pyspark.sql import functions as F

from tidewatch import scratch
from tidewatch.operators import asof, communities, paths, verify


@pytest.mark.parametrize("keys", [3, 1])
def test_asof_join(spark, keys):
    rng = np.random.default_rng(2)
    left = [(f"k{rng.integers(keys)}" if rng.random() < 0.95 else None, int(rng.integers(0, 300)) if rng.random() < 0.98 else None, i) for i in range(400)]
    right = [(f"k{rng.integers(keys)}", int(rng.integers(0, 300)), i) for i in range(60)] + [(None, 5, 99)]
    a, b = spark.createDataFrame(left, "k string, t long, id long"), spark.createDataFrame(right, "k string, t long, v long")

    def brute(k, t, strict, tolerance):
        seen = [(at, v) for other, at, v in right if k is not None and t is not None and other == k and (at < t or (at == t and not strict))]
        return max(seen)[1] if seen and (tolerance is None or t - max(seen)[0] <= tolerance) else None

    for strict, tolerance in ((False, None), (True, None), (False, 9), (True, 9)):
        got = asof.asof_join(a, b, "k", "t", ["v"], strict, tolerance, bucket=13)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(((k, t, i, brute(k, t, strict, tolerance)) for k, t, i in left), key=str)
    found = {r.id: [x.id for x in r.preceding] for r in asof.k_preceding(a.filter("t is not null"), "k", ["t", "id"], ["id"], 4, bucket=13).collect()}
    for k, t, i in left:
        if t is not None:
            before = sorted((at, j) for other, at, j in left if at is not None and k is not None and other == k and (at, j) < (t, i))
            assert found[i] == [j for _, j in before[-4:]]
    assert not asof.asof_join(a.limit(0), b, "k", "t", ["v"]).collect() and asof.asof_join(a, b.limit(0), "k", "t", ["v"]).filter("v is not null").count() == 0


def test_numbered(spark):
    rows = spark.createDataFrame([(i * 7 % 100, "same") for i in range(100)], "x int, k string")
    assert sorted((r.x, r.n) for r in asof.numbered(rows, ["k", "x"], "n").collect()) == [(i, i + 1) for i in range(100)]
    assert not asof.numbered(rows.limit(0), ["x"], "n").collect()


def greedy(rows, claims):
    """Rows in order of (key, start, end, ok): each that meets no claim of its key claims."""
    out = []
    for key, start, end, ok in rows:
        take = ok and not any(k == key and a <= end and start <= b for k, a, b in claims)
        if take:
            claims.append((key, start, end))
        out.append(take)
    return out


@pytest.mark.parametrize("keys", [2, 1])
def test_claimed(spark, keys):
    rng = np.random.default_rng(3)
    rows = sorted({(f"k{rng.integers(keys)}", int(s), int(s + rng.integers(0, 40)), True) for s in rng.integers(0, 3000, 300)})
    got = {(r.k, r.s, r.e): r.claimed for r in asof.claimed(spark.createDataFrame([*rows, (None, 1, 2, True), ("k0", None, 2, True)], "k string, s long, e long, ok boolean"), "k", "s", "e", bucket=50).collect()}
    assert not got.pop((None, 1, 2)) and not got.pop(("k0", None, 2))
    assert [got[r[:3]] for r in rows] == greedy(rows, [])


def test_finalized(spark):
    rng = np.random.default_rng(5)
    names = ["stl", "burst", "other"]
    drafts = sorted({(names[rng.integers(3)], "user", f"u{rng.integers(2)}", int(s), int(s + rng.integers(1, 30)), float(s), bool(rng.random() < 0.7)) for s in rng.integers(0, 900, 150)}, key=lambda d: (["burst", "stl", "other"].index(d[0]), *d[1:5]))
    existing = [("user", "u0", 100, 200)]
    schema = "extractor string, entity_type string, entity_value string, start_us long, end_us long, score double, eligible boolean"
    shuffled = [drafts[i] for i in rng.permutation(len(drafts))]
    got = asof.finalized(spark.createDataFrame(shuffled, schema), ["burst", "stl"], spark.createDataFrame(existing, "entity_type string, entity_value string, start_us long, end_us long"), bucket=40)
    found = sorted(got.collect(), key=lambda r: int(r.evidence_id.split("-")[1]))
    assert [tuple(r)[:5] for r in found] == [d[:5] for d in drafts] and [r.evidence_id for r in found] == [f"EVIDENCE-{i + 1}" for i in range(len(drafts))]
    want = greedy([(d[2], d[3], d[4], d[6]) for d in drafts], [("u0", 100, 200)])
    assert [r.nominated for r in found] == want and [r.score for r in found] == [d[5] if w else None for d, w in zip(drafts, want, strict=True)]


def planted(rng, groups, size, edges, noise):
    found = {}
    for _ in range(edges):
        c = int(rng.integers(groups))
        a, b = rng.integers(0, groups * size, 2) if rng.random() < noise else c * size + rng.integers(0, size, 2)
        if a != b:
            found[min(a, b), max(a, b)] = 1.0
    return [(f"n{a:04}", f"n{b:04}", w) for (a, b), w in found.items()]


@pytest.mark.parametrize("shape", ["planted", "hub"])
def test_communities_are_as_good_as_in_one_task(spark, shape):
    if shape == "planted":
        g = planted(np.random.default_rng(1), 12, 20, 900, 0.2)
    else:  # one node has an edge to all others
        g = [("hub", f"x{i:03}", 1.0) for i in range(200)] + [(f"x{i:03}", f"x{i + 1:03}", 1.0) for i in range(0, 200, 2)]
    df = spark.createDataFrame(g, "a string, b string, weight double")
    got = {r.node: r.community for r in communities.communities(df).collect()}
    assert set(got) == {n for a, b, _ in g for n in (a, b)} and set(got.values()) <= set(got)
    assert modularity(g, got) >= 0.98 * modularity(g, louvain(g))
    place = spark.createDataFrame(list(got.items()), "u string, c string")
    assert communities.modularity(communities.directed(df), place) == pytest.approx(modularity(g, got))


def test_communities_of_odd_graphs(spark):
    none = spark.createDataFrame([], "a string, b string, weight double")
    assert not communities.communities(none).collect()
    loop = spark.createDataFrame([("a", "a", 1.0), ("b", "c", 1.0), ("b", "c", 2.0)], "a string, b string, weight double")
    got = {r.node: r.community for r in communities.communities(loop).collect()}
    assert got["a"] == "a" and got["b"] == got["c"] != "a"


def test_communities_are_named_by_their_smallest_nodes(spark):
    g = planted(np.random.default_rng(1), 12, 20, 900, 0.2)
    got = {r.node: r.community for r in communities.communities(spark.createDataFrame(g, "a string, b string, weight double")).collect()}
    first = {}
    for node in sorted(got):
        first.setdefault(got[node], node)
    assert all(name == node for name, node in first.items())


def test_merged_by_overlap(spark):
    rng = np.random.default_rng(8)
    sets = {f"s{i:02}": set(rng.integers(0, 60, rng.integers(1, 9)).tolist()) | {999} for i in range(40)}  # 999 is in all of them
    for least in (0.5, 0.75):
        got = {r["set"]: r["merged"] for r in communities.merged_by_overlap(spark.createDataFrame([(k, e) for k, v in sets.items() for e in v for _ in range(2)], "set string, element long"), least).collect()}
        root = {k: k for k in sets}
        for _ in sets:
            for a in sets:
                for b in sets:
                    if len(sets[a] & sets[b]) >= least * min(len(sets[a]), len(sets[b])):
                        root[a] = root[b] = min(root[a], root[b])
        assert got == root


def test_sets_that_are_together_make_no_more_pairs(spark, monkeypatch):
    rng = np.random.default_rng(9)
    sets = {k: set(rng.integers(0, 12, rng.integers(2, 9)).tolist()) for k in range(300)} | {1000 + k: set(range(100 + 9 * k, 109 + 9 * k)) for k in range(20)} | {2000 + k: {100 + 9 * k, 101 + 9 * k, 102 + 9 * k} | set(range(900 + 9 * k, 909 + 9 * k)) for k in range(20)}
    sizes, written = {}, communities.stored

    def kept(df, name):
        out = written(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(communities, "stored", kept)
    found = communities.merged_by_overlap(spark.createDataFrame([(k, e) for k, v in sets.items() for e in sorted(v)], "set long, element long"), 0.3)
    got = {r["set"]: r["merged"] for r in found.collect()}
    root = {k: k for k in sets}
    for _ in range(6):
        for a in sets:
            for b in sets:
                if len(sets[a] & sets[b]) >= 0.3 * min(len(sets[a]), len(sets[b])):
                    root[a] = root[b] = min(root[a], root[b])
    assert got == root and sizes["pairs"] < 3000  # 300 sets have 44,850 pairs


def test_sets_are_not_sent_through_the_driver(spark, monkeypatch):
    """Tables of a row a set pack so well that they pass for small: their joins exchange both sides whatever their size on disk."""
    plans, written = {}, communities.stored
    monkeypatch.setattr(communities, "stored", lambda df, name: (plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString()), written(df, name))[1])
    rows = [(k, e) for k in range(60) for e in (k, k + 1, 100 + k % 7, 200 + k)]
    got = {r["set"]: r["merged"] for r in communities.merged_by_overlap(spark.createDataFrame(rows, "set long, element long"), 0.4).collect()}
    assert len(got) == 60
    for name in ("listed", "links", "label", "parts"):
        assert plans[name] and not any("BroadcastHashJoin" in p for p in plans[name]), name


def test_betweenness(spark):
    rng = np.random.default_rng(2)
    g = {tuple(sorted((f"n{a:02}", f"n{b:02}"))): float(rng.integers(1, 4)) for a, b in rng.integers(0, 20, (45, 2)) if a != b} | {("p", "q"): 1.0}
    rows = [(a, b, w) for (a, b), w in g.items()]
    got = {r.node: r.betweenness for r in paths.betweenness(spark.createDataFrame(rows, "a string, b string, weight double")).collect()}
    want = betweenness(rows)
    assert set(got) == set(want) and max(abs(got[n] - want[n]) for n in want) < 1e-12


def test_betweenness_in_blocks(spark, monkeypatch):
    """Several blocks of sources and nodes give the same, and no row stands for a pair of nodes."""
    rng = np.random.default_rng(3)
    g = {tuple(sorted((f"n{a:02}", f"n{b:02}"))): float(rng.integers(1, 4)) for a, b in rng.integers(0, 40, (60, 2)) if a != b} | {("p", "q"): 1.0, ("p", "p"): 1.0}
    rows = [(a, b, w) for (a, b), w in g.items()]
    sizes = []
    monkeypatch.setattr(paths, "BLOCK", 16, raising=False)
    monkeypatch.setattr(paths, "stored", lambda df, name: (out := scratch.stored(df, name), sizes.append(out.count()))[0])
    got = {r.node: r.betweenness for r in paths.betweenness(spark.createDataFrame(rows, "a string, b string, weight double")).collect()}
    want = betweenness([r for r in rows if r[0] != r[1]])
    assert set(got) == set(want) and max(abs(got[n] - want[n]) for n in want) < 1e-12
    assert max(sizes) <= 2 * len(rows)  # pairs of nodes would be up to 1,700


def test_long_paths_take_no_more_tables(spark, monkeypatch):
    """A chain of forty nodes: its rounds lie in the tasks, where each wrote and exchanged all cells."""
    names = []
    monkeypatch.setattr(paths, "stored", lambda df, name: (names.append(name), scratch.stored(df, name))[1])
    got = {r.node: r.betweenness for r in paths.betweenness(spark.createDataFrame([(i, i + 1, 1.0 + i % 3) for i in range(39)], "a int, b int, weight double")).collect()}
    assert got == {i: pytest.approx(2 * i * (39 - i) / (39 * 38)) for i in range(40)} and len(names) <= 4


def test_edges_in_pieces(monkeypatch):
    """Edges that fill several pieces, some of next to no length, and blocks of sources of several widths give the same."""
    rng = np.random.default_rng(5)
    g = {tuple(sorted((int(a), int(b)))): float(rng.integers(1, 4)) for a, b in rng.integers(0, 50, (160, 2)) if a != b}
    monkeypatch.setattr(paths, "PIECE", 32)
    monkeypatch.setattr(paths, "TOGETHER", 160)
    for tiny in (1.0, 1e-10):
        rows = [(a, b, w if a % 9 else w * tiny) for (a, b), w in g.items()]
        both = sorted([(b, a, w) for a, b, w in rows] + rows, key=lambda r: r[0] // 10)
        for width in (7, 50):
            total = np.zeros(50)
            for low in range(0, 50, width):
                edges = paths._Edges()
                for k in range(0, len(both), 5):
                    edges.add(*(np.array(c, kind) for c, kind in zip(zip(*both[k : k + 5], strict=True), (np.int32, np.int32, np.float64), strict=True)))
                total += paths._parts(edges, 50, low, min(width, 50 - low))
            if tiny == 1.0:
                want = betweenness(rows)
                assert max(abs(total[n] / (49 * 48) - want[n]) for n in want) < 1e-12 and len(want) == 50
            else:
                assert np.isfinite(total).all()  # and it ends


def test_sources_in_batches(spark, monkeypatch):
    rows = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0), ("d", "a", 1.0)], "a string, b string, weight double")
    monkeypatch.setattr(paths, "BATCH_ROWS", 12)
    assert {r.node: r.betweenness for r in paths.betweenness(rows).collect()} == {n: pytest.approx(1 / 6) for n in "abcd"}


def test_numbers_of_a_claim(spark):
    text = "99.7th percentile, 2.4 GB in 15 highest, 1,000 events 2 hours 5 ms T1567.002 EVIDENCE-14 203.0.113.13 16:19 u_ed805926e82b 3 percent 50%"
    got = spark.createDataFrame([(text,)], "t string").select(F.explode(verify.numbers(F.col("t"))).alias("n")).select("n.*").collect()
    assert [(r.raw, r.is_count, r.readings) for r in got] == [
        ("99.7", False, [99.7]), ("2.4 GB", False, [2.4e9, pytest.approx(2.4 * 2**30)]), ("15", True, [15.0]), ("1,000", True, [1000.0]), ("2 hours", False, [7200.0]), ("5 ms", False, [0.005]), ("3 percent", False, [3.0]), ("50%", False, [50.0]),
    ]


def test_leaves_and_matches(spark):
    body = '{"id": 7, "a": {"p": 99.5, "list": [1, {"x": 2400000000, "flag": true, "s": "12", "n": null, "log_id": {"y": 3}}]}, "n": 42}'
    rows = spark.createDataFrame([("i", body), ("j", "no json"), ("k", None), ("l", "5")], "i string, body string")
    assert sorted((r.i, r.value) for r in verify.numeric_leaves(rows, "body", ["i"]).collect()) == [("i", 1.0), ("i", 42.0), ("i", 99.5), ("i", 2.4e9), ("l", 5.0)]
    rng = np.random.default_rng(6)
    pool = [float(x) for x in 10 ** rng.uniform(-3, 9, 60) * rng.choice([-1, 1], 60)] + [0.0, 5.0]
    asked = [(i, bool(rng.random() < 0.2), [float(v * (1 + rng.normal() * 0.01)) for v in rng.choice(pool, 2)]) for i in range(300)] + [(900, True, [5.0]), (901, False, [0.0]), (902, True, [4.0])]
    got = verify.matched(spark.createDataFrame([("x", *a) for a in asked], "k string, number long, is_count boolean, readings array<double>"), spark.createDataFrame([("x", v) for v in pool], "k string, value double"), "k", "number")
    want = {i for i, exact, readings in asked if any((r == v) if exact else abs(r - v) / max(abs(v), 1e-9) <= 0.01 for r in readings for v in pool)}
    assert {r.number for r in got.collect()} == want


def test_checked_claims(spark):
    evidence = spark.createDataFrame([("i", "EVIDENCE-1", '{"id": 7, "p": 99.5, "b": [2400000000], "n": 42}')], "incident_id string, evidence_id string, body string")
    cases = [
        ("99.5% of 42 requests, 2.41 GB", ["EVIDENCE-1"], "valid"), ("43 requests", ["EVIDENCE-1"], "unsupported_number"), ("42", ["EVIDENCE-9"], "unknown_evidence"), ("42", [], "uncited"), ("42", None, "uncited"), ("42", ["T1048"], "unretrieved_technique"),
        ("77 bytes", ["LOG-5"], "valid"), ("42", ["LOG-6"], "out_of_scope"), ("42", ["LOG-77"], "unknown_evidence"), ("42", ["T9999"], "unknown_evidence"), ("7", ["EVIDENCE-1"], "unsupported_number"), ("2.35 GB", ["EVIDENCE-1"], "unsupported_number"),
        ("2.235 GB", ["EVIDENCE-1"], "valid"), (None, ["17", "X-KB-a"], "valid"), ("0.5 hours", ["LOG-5"], "unsupported_number"),
    ]
    claims = spark.createDataFrame([(k, "i", text, cited) for k, (text, cited, _) in enumerate(cases)], "claim_id int, incident_id string, text string, cited array<string>")
    lines = spark.createDataFrame([(5, 1000, "user:u1", [77.0]), (5, 1000, "domain:d", [77.0]), (6, 9_000_000_000_000, "user:u1", [1.0])], "line_no long, us long, entity string, numbers array<double>")
    scope = spark.createDataFrame([("i", "user:u1", 0, 5000)], "incident_id string, entity string, from_us long, to_us long")
    out = verify.checked(claims, evidence, lines, scope, spark.createDataFrame([("T1048",)], "technique string"), spark.createDataFrame([("i", "T1")], "incident_id string, technique string"))
    assert [r.status for r in sorted(out.collect(), key=lambda r: r.claim_id)] == [c[2] for c in cases]


def test_salt_keeps_all_rows(spark):
    rows = scratch.stored(spark.range(5000).select(F.when(F.col("id") < 2000, 1).otherwise(F.col("id")).alias("k"), "id"), "rows")
    hot = scratch.hot_keys(rows, "k")
    assert [r.k for r in hot.collect()] == [1]
    joined = scratch.salted(rows, hot, "k", F.col("id")).join(scratch.at_each_salt(spark.range(6000).select(F.col("id").alias("k"), (F.col("id") + 1).alias("v")), hot, "k"), ["k", "_salt"])
    assert joined.count() == 5000 and joined.filter("v <> k + 1").count() == 0


def test_beacon_findings(spark):
    """A beacon every ten minutes for ninety days is longer than the bins of a minute reach: bins of three minutes, no event left out."""
    from tidewatch.operators import detectors

    rows = [("10.0.0.1", "c2.example", 600_000_000 * i, i) for i in range(90 * 144)] + [("10.0.0.2", "d.example", 60_000_000 * t, 20_000 + t) for t in (0, 1, 7, 9, 100, 1000, 1001, 1500, 1501)]
    ev = spark.createDataFrame([*rows, (None, "c2.example", 1, 1), ("10.0.0.1", "", 1, 2)], "src_ip string, domain string, us long, id long")
    found = detectors.beacon_findings(ev).collect()
    assert [(r.src_ip, r.domain, r.n) for r in found] == [("10.0.0.1", "c2.example", 90 * 144)]
    b = found[0]
    assert b.cv == 0 and b.mad_jitter == 0 and b.bucket_s == 180 and b.has_peak and b.event_ids == [*range(100), *range(90 * 144 - 100, 90 * 144)]
    counts = np.zeros(int(rows[90 * 144 - 1][2] // 180_000_000) + 1)
    np.add.at(counts, [r[2] // 180_000_000 for r in rows[: 90 * 144]], 1)
    power = np.abs(np.fft.rfft(counts - counts.mean()))[1:] ** 2
    assert b.period_s == pytest.approx(len(counts) * 180 / (power.argmax() + 1)) and b.strength == pytest.approx(power.max() / power.sum())


def test_long_beacon_keeps_its_bins(spark):
    """Ninety days of a beacon are looked at minute by minute, so that its second period of four minutes is seen."""
    from tidewatch.operators import detectors

    times = sorted([600_000_000 * i for i in range(90 * 144)] + [240_000_000 * i for i in range(90 * 360)])
    ev = spark.createDataFrame([("10.0.0.1", "c2.example", t, i) for i, t in enumerate(times)], "src_ip string, domain string, us long, id long")
    b = detectors.beacon_findings(ev, bound=0.0, most=None).first()
    counts = np.bincount([t // 60_000_000 for t in times]).astype(float)
    power = np.abs(np.fft.rfft(counts - counts.mean()))[1:] ** 2
    k = int((power >= power.max() * (1 - 1e-9)).argmax())
    assert b.bucket_s == 60 and b.n == len(times) and b.period_s == pytest.approx(len(counts) * 60 / (k + 1)) and b.strength == pytest.approx(power[k] / power.sum())
    assert abs(b.period_s - 240) < 0.1  # bins of three minutes end at six


def test_spectrum_in_stretches(spark, monkeypatch):
    """A key that lasts longer than a stretch has the same spectrum, and few bytes are dealt to as many tasks as asked for."""
    from tidewatch.operators import detectors

    rng = np.random.default_rng(4)
    series = {"few": rng.choice(5000, 9, replace=False), "many": rng.choice(7001, 6000), "flat": np.arange(900), "one": np.array([0]), "two": np.array([0, 1]), "even": np.arange(0, 3000, 50)} | {f"k{i}": rng.choice(400, 5, replace=False) for i in range(40)}
    ev = spark.createDataFrame([(k, int(b) * 60_000_000) for k, bins in series.items() for b in bins], "who string, us long")
    files, written = {}, detectors.stored
    monkeypatch.setattr(detectors, "stored", lambda df, name: (out := written(df, name), files.update({name: len(out.inputFiles())}))[0])
    monkeypatch.setattr(detectors, "STRETCH", 700)
    got = {r.who: r for r in detectors.dominant_period(ev, ["who"], 60).collect()}
    assert set(got) == set(series) and files["spectra"] == int(spark.conf.get("spark.sql.shuffle.partitions"))
    for who, bins in series.items():
        x = np.bincount(bins - bins.min()).astype(float)
        power = np.abs(np.fft.rfft(x - x.mean()))[1:] ** 2
        r = got[who]
        if len(power) < 2 or x.min() == x.max():
            assert r.period_s is None and r.ratio is None and r.strength is None
            continue
        k = int((power >= power.max() * (1 - 1e-9)).argmax())
        rest = (power.sum() - power[k]) / (len(power) - 1)
        assert r.period_s == pytest.approx(len(x) * 60 / (k + 1)) and r.strength == pytest.approx(power[k] / power.sum()) and r.ratio == pytest.approx(power[k] / rest)


def test_an_hour_keeps_two_sets(spark):
    from tidewatch.operators import windows

    names = ("n_unique_domains", "n_rare_domains", "n_new_domains_for_user", "n_newly_registered_domains", "mean_domain_entropy", "n_unique_status_codes", "n_unique_user_agents", "ua_diversity_ratio")
    rows = [(0, 5, "u", "ab.c", 200, "x", True), (1, 6, "u", "ab.c", 404, "x", False), (2, 7, "u", "aa.c", None, None, None), (3, 8, "u", None, 200, "y", True), (4, windows.HOUR, "u", "ab.c", 200, "x", None)]
    ev = spark.createDataFrame(rows, "id long, us long, who string, domain string, status_code long, user_agent string, newly_registered boolean")
    found = windows.entity_windows(ev, "who", names)
    first, second = (tuple(r[n] for n in names) for r in found.orderBy("hour_us").collect())
    assert first == (2.0, 2.0, 2.0, 1.0, 0.5, 2.0, 2.0, 0.5) and second == (1.0, 1.0, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0)
    assert str(found._jdf.queryExecution().sparkPlan().toString()).count("partial_collect_set(") == 2  # one a column before


def test_rounded_halves_go_away_from_zero(spark):
    from tidewatch.functions import stats

    got = spark.createDataFrame([(0.0078125,), (-0.0078125,), (1e300,), (float("nan"),), (None,)], "x double").select(stats.rounded(F.col("x"), 6).alias("r")).collect()
    assert [r.r for r in got[:3]] == [0.007813, -0.007813, 1e300] and got[3].r != got[3].r and got[4].r is None


def test_windows_are_made_once_for_their_z(spark):
    from tidewatch.operators import windows

    sent = {"a": (1, 2, 9), "b": (4, 4, 4)}
    ev = spark.createDataFrame([(i, h * windows.HOUR, who, f"10.0.0.{i % 2}", "x.c", n) for who, ns in sent.items() for i, (h, n) in enumerate(enumerate(ns))], "id long, us long, principal string, src_ip string, domain string, bytes_out long")
    found = windows.vectors(ev)
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    own = {(r.entity_value, r.hour_us // windows.HOUR): r for r in found.filter("entity_type = 'user'").collect()}
    assert np.allclose([own["a", h].bytes_out_sum_z_vs_own_history for h in range(3)], [-0.6745, 0, 7 * 0.6745]) and own["b", 1].bytes_out_sum_z_vs_own_history == 0
    assert np.allclose([own[k].bytes_out_sum_z_vs_cohort for k in (("a", 0), ("b", 0))], [-0.6745, 0.6745])  # no department: a null cohort is one
