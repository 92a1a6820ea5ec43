"""Incident texts, tags, signatures, re-scoring, retrieval and the synthetic logs with the detectors that must find them."""

import math
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.functions import col as F_col

from tidewatch.operators import detectors, incidents, retrieval
from tidewatch.sources import synthetic


def test_texts(spark):
    s = spark.createDataFrame([(1, "T1071", "a", "u1", 0, 3_600_000_000), (1, "T1048", "b", "u1", 0, 7_200_000_000), (1, "T1071", "c", "u2", 0, 1), (2, None, "a", "u1", None, None)], "incident_id int, technique string, detector_key string, entity_value string, start_us long, end_us long")
    got = {r.incident_id: r.summary for r in incidents.summaries(s).collect()}
    assert got == {1: "3 signals on 2 entities. Raised by a, b, and c. It spans 2.0 hours.", 2: "1 signal on 1 entity. Raised by a. No time is known."}
    assert [tuple(r) for r in incidents.main_technique(s).collect()] == [(1, "T1071")]
    rows = spark.createDataFrame([(1, "T1048.003", "x" * 30), (2, None, "short")], "incident_id int, technique string, entity_value string")
    got = {r.incident_id: r.title for r in incidents.titles(rows).collect()}
    assert got == {1: "Exfiltration: " + "x" * 23 + "…", 2: "Suspicious Activity: short"}


def test_asset_tags(spark):
    schema = "incident_id int, principal string, device_name string, os_type string, os_version string, department string, location string, app_name string, risk_score int, bypassed_traffic boolean, flow_type string"
    rows = spark.createDataFrame([(1, "a", "PC 1", "Windows", "10.0.19045", "R&D", None, "", 80, True, "SSL tunnel"), (1, "b", "PC 1", None, None, None, None, None, None, False, None)], schema)
    assert incidents.asset_tags(rows).first().tags == ["bypassed", "dept:r-d", "device:pc-1", "flow:ssl-tunnel", "os-version:10.0", "os:windows", "risk:high", "shared-device"]


def test_signatures_and_rescoring(spark):
    v = spark.createDataFrame([(1, "t", "true_positive", "T1071.009", 0.9, ["x"]), (2, "t", "false_positive", "T1071", 0.9, ["x"]), (3, "t", "needs_review", "T9999", 0.9, ["x"])], "incident_id int, tenant_hash string, disposition string, technique string, confidence double, indicator_hashes array<string>")
    assert [(r.incident_id, r.incident_type) for r in incidents.signatures(v).collect()] == [(1, "c2")]
    s = spark.createDataFrame([(1, 1, "a", "rule", 0.95, 0.5)], "incident_id int, signal_id int, detector_key string, layer string, confidence double, density double")
    old = spark.createDataFrame([(1, 0.5)], "incident_id int, fused_score double")
    r = incidents.rescored(s, old).first()
    assert r.severity_changed and r.new > 0.9


def test_run_measures(spark):
    truth = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "scenario_id string")
    found = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "scenario_id string, incident_id int")
    r = incidents.recall_and_fragmentation(found, truth).first()
    assert (r.recall, round(r.fragmentation, 4)) == (0.75, 1.3333)
    m = spark.createDataFrame([("x", 0.5, 0.1), ("y", 0.5, 0.2), ("z", 0.1, 0.9)], "model string, f2 double, average_precision double")
    assert incidents.best_model(m).first().model == "y"


def test_retrieval(spark):
    kb = spark.createDataFrame([("c2", "beaconing to a command server"), ("exfil", "large upload of data to a drop server"), ("phish", "mail with a link"), ("none", "the of")], "technique string, text string")
    idf, vectors = retrieval.index(kb, "technique", "text")
    asked = spark.createDataFrame([(1, "data upload"), (2, "the of"), (3, "server"), (4, "nothing known")], "q int, text string")
    found = retrieval.ranked(asked, "q", "text", idf, vectors, "technique")
    got = {(r.q, r.place): (r.technique, r.score) for r in found.collect()}
    assert got[1, 1][0] == "exfil" and {q for q, _ in got} == {1, 3} and {got[3, 1][0], got[3, 2][0]} == {"c2", "exfil"}
    # by hand: "data upload" has data and upload, each in one of four documents
    rare, shared = math.log(5 / 2) + 1, math.log(5 / 3) + 1
    norm = math.sqrt(10 * rare**2 - rare**2 + shared**2 + 0)
    words = ["large", "upload", "data", "drop", "server"]
    pairs = len(words) - 1
    norm = math.sqrt(4 * rare**2 + shared**2 + pairs * rare**2)
    assert got[1, 1][1] == pytest.approx(2 * rare * rare / (norm * math.sqrt(2) * rare), abs=1e-8)
    verdict = spark.createDataFrame([(1, "c2", 0.9, 1), (1, "exfil", 0.1, 2)], "q int, technique string, score double, place int")
    both = {(r.q, r.place): (r.technique, r.score, r.sources) for r in retrieval.fused({"model": found, "verdict": verdict}, "q", "technique").collect()}
    assert both[1, 1] == ("c2", 0.9, ["verdict"]) and both[1, 2][0] == "exfil" and both[1, 2][1] == got[1, 1][1] and both[1, 2][2] == ["model", "verdict"]
    v = retrieval.hashed_vector("Data, data and mail")
    assert sum(x * x for x in v) == pytest.approx(1)
    got = spark.range(1).select(retrieval.hashed_counts(F.lit("Data, data and mail")).alias("m")).first().m
    assert sorted(got.values()) == [1, 2] and {k for k in got} == {i for i, x in enumerate(v) if x}


def test_synthetic_logs_are_found(spark):
    quiet = synthetic.benign(spark, 30, 3, 40)
    log = synthetic.merged([quiet, synthetic.beacon(spark, 3, 600, 60), synthetic.exfiltration(spark, 5, 20, 20_000_000), synthetic.mass_download(spark, 7, 400)]).cache()
    again = synthetic.merged([quiet.repartition(3), synthetic.beacon(spark, 3, 600, 60), synthetic.exfiltration(spark, 5, 20, 20_000_000), synthetic.mass_download(spark, 7, 400)])
    assert log.exceptAll(again).count() == 0
    ids = [r.id for r in log.select("id").orderBy("id").collect()]
    assert ids == list(range(1, 30 * 3 * 40 + 481))
    top = detectors.beacons(log, ["src_ip", "domain"]).orderBy(F.desc("score")).first()
    assert (top.src_ip, top.domain) == ("10.0.0.3", "cdn-sync.example.net")
    burst = detectors.bursts(log, "principal").orderBy(F.desc("n")).first()
    assert burst.entity_value == "u7" and burst.confidence == 1.0
    assert {r.principal for r in log.filter("bytes_out >= 10000000").select("principal").distinct().collect()} == {"u5"}
    assert [r.value for r in synthetic.sweep(spark, 0.0, 0.3, 0.1).collect()] == pytest.approx([0, 0.1, 0.2, 0.3])
    parts = synthetic.split(spark.range(1000), "id", 1, {"train": 0.8, "test": 0.2}).groupBy("part").count().collect()
    assert abs({r.part: r["count"] for r in parts}["train"] - 800) < 60


def test_latency_is_exact_and_no_task_takes_all_values(spark):
    """As Spark's own percentile, of repeated, negative, missing and no values; no aggregate of a whole column's values."""
    from pyspark.sql import functions as F

    for values in ([3.5, None, -1.0, 3.5, 7.25, 0.1], [float(i * i % 101) for i in range(997)], [2.0], [None], []):
        rows = spark.createDataFrame([(v,) for v in values], "x double")
        want = rows.agg(F.percentile("x", 0.5), F.percentile("x", 0.95), F.count("x")).first()
        found = incidents.latency(rows, "x")
        assert [tuple(r) for r in found.collect()] == [(want[0] if want[0] is None else pytest.approx(want[0]), want[1] if want[1] is None else pytest.approx(want[1]), want[2])]
        assert " percentile(" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_traits_of_names_look_a_pair_up_among_those_of_its_first_letter(spark):
    rows = spark.createDataFrame([("abca",), ("b",), ("",), ("äb😀",)], "label string")
    pairs = {"ab": -1.0, "bc": -2.0, "^a": -0.5, "a$": -0.25, "äb": -4.0, "b😀": -8.0}
    got = {r.label: r.s for r in rows.select("label", detectors.label_traits(F_col("label"), pairs, -9.0)[1].alias("s")).collect()}
    assert got == {"abca": pytest.approx((0.5 + 1 + 2 + 9 + 0.25) / 5), "b": 9.0, "": 9.0, "äb😀": pytest.approx((9 + 4 + 8 + 9) / 4)}
    plan = rows.select(detectors.label_traits(F_col("label"), pairs, -9.0)[1].alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert "keys: [ab,bc" not in plan


def test_terms_of_a_long_text(spark):
    """Pairs of words take time in proportion to the text: words are cut once, not again at each pair."""
    words = [f"w{i % 97}" for i in range(20_000)]
    began = time.monotonic()
    got = spark.createDataFrame([(" ".join(words),), ("the",), (None,)], "t string").select(retrieval.terms(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == [[*words, *map(" ".join, zip(words, words[1:], strict=False))], [], None]
    assert time.monotonic() - began < 20
