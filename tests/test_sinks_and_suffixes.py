"""Copy on write, batches that come twice, and registrable domains against the list's own test cases."""

import os

import pytest

from tidewatch.operators import suffixes
from tidewatch.sources import sinks

RULES = ["// a comment", "", "com", "uk", "co.uk  and a remark", "*.ck", "!www.ck", "jp", "kobe.jp", "*.kawasaki.jp", "!city.kawasaki.jp"]
CASES = {
    "com": "com", "a.com": "a.com", "x.A.com.": "a.com", "b.co.uk": "b.co.uk", "a.b.co.uk": "b.co.uk", "co.uk": "co.uk", "x.uk": "x.uk", "ck": "ck", "b.ck": "b.ck", "a.b.ck": "a.b.ck", "x.a.b.ck": "a.b.ck", "www.ck": "www.ck", "x.www.ck": "www.ck",
    "c.kobe.jp": "c.kobe.jp", "b.c.kobe.jp": "c.kobe.jp", "city.kawasaki.jp": "city.kawasaki.jp", "x.city.kawasaki.jp": "city.kawasaki.jp", "y.x.kawasaki.jp": "y.x.kawasaki.jp", "a.b.local": "a.b.local", "10.0.0.1": "10.0.0.1",
}


@pytest.mark.parametrize("sent", [0, 100])
def test_registrable_domains(spark, monkeypatch, sent):
    monkeypatch.setattr(suffixes, "SENT", sent)
    rules = suffixes.parsed_rules(spark.createDataFrame([(x,) for x in RULES], "value string"))
    rows = spark.createDataFrame([(h, 1) for h in [*CASES, *CASES, None, ""]], "host string, registrable_domain int")
    got = suffixes.registrable_domains(rows, rules).collect()
    assert {r.host: r.registrable_domain for r in got} == CASES and len(got) == len(CASES)
    assert {r.host: r.public_suffix for r in got}["x.city.kawasaki.jp"] == "kawasaki.jp" and {r.host: r.public_suffix for r in got}["a.b.local"] is None
    joined = suffixes.with_registrable(rows, "host", rules).collect()
    assert len(joined) == 2 * len(CASES) + 2 and all(r.registrable_domain == CASES.get(r.host) for r in joined)


def test_merge_rewrites_only_what_changed(spark, tmp_path):
    path = str(tmp_path / "t")
    kind = "k int, v string, day int"
    sinks.merge_in_place(spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", 2)], kind), path, ["k"], "day")
    files = {d: sorted(os.listdir(f"{path}/day={d}")) for d in (1, 2)}
    new = spark.createDataFrame([(2, "B", 1), (4, "d", 3)], kind)
    for _ in range(2):  # a second time changes nothing
        sinks.merge_in_place(new, path, ["k"], "day")
        assert sorted(map(tuple, spark.read.parquet(path).select("k", "v", "day").collect())) == [(1, "a", 1), (2, "B", 1), (3, "c", 2), (4, "d", 3)]
    assert sorted(os.listdir(f"{path}/day=2")) == files[2] and sorted(os.listdir(f"{path}/day=1")) != files[1]


def test_a_batch_that_comes_twice_counts_once(spark, tmp_path):
    write = sinks.once_a_batch(str(tmp_path / "b"))
    df = spark.createDataFrame([("u", 2)], "k string, n int")
    for batch in (0, 1, 1, 0):
        write(df, batch)
    assert spark.read.parquet(str(tmp_path / "b")).groupBy("k").sum("n").collect()[0][1] == 4
