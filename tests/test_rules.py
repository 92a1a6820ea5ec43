"""The rule language: parsing, loading errors, and the meaning of each condition shape on small events."""

import json

import pytest
from pyspark.sql import functions as F

from tidewatch.rules import compiler
from tidewatch.rules.language import All, Any, Block, Count, Not, NotSeenBefore, RuleError, Speed, parse
from tidewatch.rules.rule import load, load_all, seconds, shipped

MINUTE = 60_000_000


def test_precedence_and_quantifiers():
    assert parse("a or b and not c", ["a", "b", "c"]) == Any((Block("a"), All((Block("b"), Not(Block("c"))))))
    assert parse("1 of s*", ["s1", "s2"]) == Any((Block("s1"), Block("s2")))
    assert parse("all of them", ["a", "b"]) == All((Block("a"), Block("b")))


def test_aggregates():
    assert parse("a | count() by x, y >= 3", ["a"]) == Count(Block("a"), None, None, ("x", "y"), ">=", 3.0, None)
    assert parse("a | count(d, max_each=2) by x > 1 and b", ["a", "b"]) == Count(Block("a"), "d", 2, ("x",), ">", 1.0, Block("b"))
    assert parse("a | not_seen_before(x, y) in b", ["a", "b"]) == NotSeenBefore(Block("a"), ("x", "y"), Block("b"))
    assert parse("a | speed_kmh(lat, lon) by u = 9", ["a"]) == Speed(Block("a"), "lat", "lon", 0.0, ("u",), "==", 9.0)


@pytest.mark.parametrize("text", ["", "missing", "a and", "(a", "a | count() by", "a | count() by x >= b", "a b", "a | sum(x) by y > 1", "none of z*"])
def test_bad_conditions(text):
    with pytest.raises(RuleError):
        parse(text, ["a"])


def rule(detection, field="principal", **more):
    return load({"id": "r", "title": "t", "level": "high", "entity": {"type": "user", "field": field}, "detection": detection} | more)


def test_loading():
    assert seconds("15m") == 900
    r = rule({"b": {"action": "blocked"}, "condition": "b", "timeframe": "2h"}, tags=["attack.t1071.001", "other"])
    assert (r.timeframe, r.techniques, r.base_score, r.detector_key) == (7200, ("T1071.001",), 0.75, "rule.r")
    for bad in ({"condition": "b"}, {"b": {"a|near": 1}, "condition": "b"}, {"b": {"a": 1}, "condition": "b", "timeframe": "2w"}, {"b": {"a": 1}}):
        with pytest.raises(RuleError):
            rule(bad)
    text = "\n---\n".join(["{id: x, title: t, level: low, entity: {type: a, field: b}, detection: {b: {c: 1}, condition: b}}"] * 2)
    with pytest.raises(RuleError):
        load_all(text)


COLUMNS = "id long, us long, principal string, domain string, action string, n int, lat double, lon double"


def events(spark, *rows):
    return spark.createDataFrame([(i, m * MINUTE, *r) for i, (m, *r) in enumerate(rows)], COLUMNS)


def ev(minute, who="u", domain="a.com", action="allowed", n=0, lat=0.0, lon=0.0):
    return (minute, who, domain, action, n, lat, lon)


def test_presence_splits_only_above_the_gap(spark):
    r = rule({"b": {"action": "blocked"}, "condition": "b"})
    e = events(spark, ev(0, action="blocked"), ev(30, action="blocked"), ev(61, action="blocked"), ev(62), ev(5, who=None, action="blocked"))
    got = sorted((x.start_us // MINUTE, x.end_us // MINUTE, x.event_ids) for x in compiler.matches(e, r).collect())
    assert got == [(0, 30, [0, 1]), (61, 61, [2])]


def test_count_fires_once_and_includes_the_edge(spark):
    r = rule({"b": {"domain|contains": ""}, "condition": "b | count() by principal >= 3", "timeframe": "10m"})
    e = events(spark, ev(0), ev(5), ev(10), ev(11), ev(0, who="v"), ev(11, who="v"), ev(22, who="v"))
    got = [(x.entity_value, x.event_ids) for x in compiler.matches(e, r).collect()]
    assert got == [("u", [0, 1, 2])]


def test_distinct_count_with_max_each(spark):
    r = rule({"b": {"domain|contains": ""}, "condition": "b | count(domain, max_each=1) by principal >= 2", "timeframe": "10m"})
    e = events(spark, ev(0, domain="a"), ev(1, domain="a"), ev(2, domain="b"))
    assert [x.event_ids for x in compiler.matches(e, r).collect()] == [[0, 2]]


def test_anchor_and_history(spark):
    r = rule({"b": {"action": "blocked"}, "ok": {"action": "allowed"}, "condition": "b | count() by domain, principal >= 1 and ok", "timeframe": "5m"})
    e = events(spark, ev(0, action="blocked"), ev(2), ev(20))
    assert [x.event_ids for x in compiler.matches(e, r).collect()] == [[0, 1]]
    r = rule({"b": {"action": "blocked"}, "ok": {"n|gte": 0}, "condition": "b | not_seen_before(principal, domain) in ok"})
    e = events(spark, ev(0, domain="a"), ev(1, domain="b", action="blocked"), ev(2, domain="a", action="blocked"), ev(0, who="v", action="blocked"))
    assert [x.event_ids for x in compiler.matches(e, r).collect()] == [[1]]


def test_speed(spark):
    r = rule({"b": {"n|gte": 0}, "condition": "b | speed_kmh(lat, lon, 100) by principal > 900"})
    e = events(spark, ev(0), ev(60, lat=5.0), ev(120, lat=20.0))
    got = compiler.matches(e, r).collect()
    assert [x.event_ids for x in got] == [[1, 2]] and 1660 < got[0].observed < 1675


@pytest.mark.parametrize(
    "filters,ids",
    [({"domain": "A*.com"}, [0, 3]), ({"domain|startswith": "AB"}, [3]), ({"domain|re": "^a"}, [0, 3]), ({"domain": "A.com"}, []), ({"domain": ["a.com", "b%com"]}, [0, 1]), ({"domain|contains": "%"}, [1]), ({"domain": None}, [2]), ({"n|gt": 2, "n|lte": 3}, [3]), ({"domain|contains|all": ["a", "b"]}, [3])],
)
def test_filters(spark, filters, ids):
    r = rule({"b": filters, "condition": "b"})
    e = events(spark, ev(0, domain="a.com"), ev(1, domain="b%com"), ev(2, domain=None), ev(3, domain="ab.com", n=3))
    assert sorted(x.id for x in e.filter(compiler.predicate(r.condition, r)).collect()) == ids


def test_scores_and_suppression(spark):
    a = rule({"b": {"action": "blocked"}, "ok": {"action": "allowed"}, "condition": "b | count() by principal >= 1 and ok", "timeframe": "60m"})
    e = events(spark, *[ev(i, action="blocked") for i in range(5)], ev(6), ev(7, who="v", action="blocked"), ev(8, who="v"))
    got = {x.entity_value: round(x.raw_score, 6) for x in compiler.signals(e, [a]).collect()}
    assert got == {"u": 0.99, "v": 0.75}
    hide = rule({"b": {"principal": "u"}, "condition": "b"}, applies_to=["rule.r"])
    assert [x.entity_value for x in compiler.signals(e, [a], [hide]).collect()] == ["v"]


def proxy(spark, *rows):
    """Events with a nested document, by minute and fields."""
    nested = ("url_category", "url_supercategory", "threat_name", "dlp_engine", "risk_score")
    out = []
    for i, (minute, domain, fields) in enumerate(rows):
        f = {"principal": "vic", "src_ip": "203.0.113.9", "action": "allowed", "http_method": "GET", "bytes_out": 10, "url_path": "/", "user_agent": "Mozilla/5.0"} | fields
        g = {k: f.get(k) for k in nested}
        ocsf = {"risk_score": g["risk_score"], "unmapped": {"url_supercategory": g["url_supercategory"], "dlp_engine": g["dlp_engine"]}, "malware": [{"name": g["threat_name"]}] if g["threat_name"] else [], "http_request": {"url": {"category_ids": [g["url_category"]] if g["url_category"] else []}}}
        out.append((i, minute * MINUTE, domain, *(f[c] for c in ("principal", "src_ip", "action", "http_method", "bytes_out", "url_path", "user_agent")), ocsf, json.dumps({"domain": {"newly_registered": f.get("young", False)}, "user_agent": {"is_automation_tool": f.get("tool", False)}})))
    kind = "struct<risk_score: int, unmapped: struct<url_supercategory: string, dlp_engine: string>, malware: array<struct<name: string>>, http_request: struct<url: struct<category_ids: array<string>>>>"
    return spark.createDataFrame(out, f"id long, us long, domain string, principal string, src_ip string, action string, http_method string, bytes_out long, url_path string, user_agent string, ocsf {kind}, enrichment string")


NEW = "Newly Registered and Revived Domains"
#: For each shipped rule rows that it must match with their ids, and rows that it must not.
TWO_SIDES = {
    "malicious-url-category": ([(0, "bad.top", {"url_supercategory": "Security"})], [0], [(0, "docs.example", {"url_supercategory": "Business and Economy"})]),
    "threat-name-present": ([(0, "bad.top", {"threat_name": "Backdoor"})], [0], [(0, "example.com", {})]),
    "credentials-in-url": ([(0, "old.example", {"url_path": "/login?user=vic&password=x"})], [0], [(0, "old.example", {"url_path": "/login?user=vic"})]),
    "blocked-then-allowed": ([(0, "e.example", {"action": "blocked"}), (2, "e.example", {})], [0, 1], [(0, "e.example", {"action": "blocked"}), (20, "e.example", {}), (1, "f.example", {})]),
    "non-browser-user-agent": ([(0, "example.com", {"user_agent": "CURL/8.4.0"}), (1, "example.com", {"tool": True})], [0, 1], [(0, "example.com", {})]),
    "large-post-to-new-domain": ([(0, "new.top", {"http_method": "POST", "bytes_out": 15_000_000, "url_category": NEW}), (1, "x.top", {"http_method": "POST", "bytes_out": 10_000_000, "young": True})], [0, 1], [(0, "drive.example", {"http_method": "POST", "bytes_out": 15_000_000, "url_category": "Apps"}), (0, "new.top", {"http_method": "POST", "bytes_out": 9_999_999, "url_category": NEW})]),
    "direct-to-ip-request": ([(0, "198.51.100.77", {})], [0], [(0, "example.com", {}), (0, "198.51.100.777", {})]),
    "dlp-engine-triggered": ([(0, "store.example", {"dlp_engine": "Confidential"})], [0], [(0, "store.example", {})]),
    "executable-archive-download-new-domain": ([(0, "new.top", {"url_path": "/dl/update.EXE?x=1", "url_category": NEW})], [0], [(0, "new.top", {"url_path": "/index.html", "url_category": NEW})]),
    "anonymizer-proxy-avoidance-category": ([(0, "hide.example", {"url_category": "Proxy Avoidance and Anonymizers"})], [0], [(0, "docs.example", {"url_category": "Apps"})]),
    "high-risk-score-allowed": ([(0, "risky.example", {"risk_score": 80})], [0], [(0, "risky.example", {"risk_score": 95, "action": "blocked"}), (0, "risky.example", {"risk_score": 79})]),
}


@pytest.mark.parametrize("rule_id", sorted(TWO_SIDES))
def test_shipped_rule(spark, rule_id):
    r = {x.id: x for x in shipped()}[rule_id]
    hit, ids, miss = TWO_SIDES[rule_id]
    found = compiler.matches(proxy(spark, *hit), r).collect()
    assert [(x.event_ids, x.n_events, x.truncated) for x in found] == [(ids, len(ids), False)]
    assert compiler.matches(proxy(spark, *miss), r).count() == 0


def test_all_shipped_rules_are_tested():
    assert {r.id for r in shipped()} == set(TWO_SIDES)


def test_evidence_has_both_ends_and_all_are_counted(spark):
    e = events(spark, *[ev(0, action="blocked") for _ in range(500)], ev(1))
    a = rule({"b": {"action": "blocked"}, "ok": {"action": "allowed"}, "condition": "b | count() by principal >= 1 and ok", "timeframe": "60m"})
    found = compiler.matches(e, a).collect()
    assert [(x.n_events, x.observed, x.truncated) for x in found] == [(501, 500.0, True)]
    assert found[0].event_ids == [*range(100), *range(400, 501)]
    found = compiler.matches(e, rule({"b": {"action": "blocked"}, "condition": "b"})).collect()
    assert [(x.event_ids, x.n_events, x.truncated) for x in found] == [([*range(100), *range(400, 500)], 500, True)]


def test_anchored_distinct(spark):
    r = rule({"b": {"action": "blocked"}, "ok": {"action": "allowed"}, "condition": "b | count(domain) by principal >= 2 and ok", "timeframe": "10m"})
    e = events(spark, ev(0, domain="a", action="blocked"), ev(1, domain="a", action="blocked"), ev(2), ev(5, domain="b", action="blocked"), ev(11), ev(12))
    assert [(x.event_ids, x.n_events, x.observed) for x in compiler.matches(e, r).collect()] == [([1, 3, 4], 3, 2.0)]


def test_fields(spark):
    e = proxy(spark, (90, "a.com", {}), (91, "a.com", {}), (92, "b.com", {}))
    r = rule({"b": {"domain_event_count": 1}, "condition": "b"})
    assert [x.event_ids for x in compiler.matches(e, r).collect()] == [[2]]
    r = rule({"b": {"hour_utc|gte": 1.51}, "condition": "b"})
    assert [x.event_ids for x in compiler.matches(e, r).collect()] == [[1, 2]]
    with pytest.raises(RuleError):
        compiler.matches(e, rule({"b": {"no_such_field": 1}, "condition": "b"}))
    text = e.withColumn("ocsf", F.to_json("ocsf")).withColumn("enrichment", F.parse_json("enrichment"))
    for x in shipped():
        both = [sorted((y.entity_value, y.n_events) for y in compiler.matches(t, x).collect()) for t in (e, text)]
        assert both[0] == both[1]
