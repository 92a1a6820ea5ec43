"""The streaming forms against what their batch forms give on the same rows."""

from datetime import datetime, timedelta

from tidewatch.streaming import detect

START = datetime(2024, 1, 1)


def stream(spark, tmp_path, rows, schema):
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def drained(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def at(minutes):
    return START + timedelta(minutes=minutes)


def test_windowed_counts_and_sessions(spark, tmp_path):
    rows = [("u", at(0)), ("u", at(1)), ("u", at(7)), ("v", at(2)), ("u", at(200))]
    s = stream(spark, tmp_path, rows, "principal string, ts timestamp")
    got = {(r.principal, r.start): r.n for r in drained(detect.windowed_counts(s, "principal"), "counts")}
    assert got[("u", at(0))] == 2 and got[("u", at(5))] == 1 and got[("v", at(0))] == 1
    got = {(r.principal, r.n) for r in drained(detect.sessions(s, "principal"), "sessions")}
    assert ("u", 3) in got and ("v", 1) in got
    assert {r.principal for r in drained(detect.sliding_bursts(s, "principal", 3), "bursts")} == {"u"}


def test_navigation_state(spark, tmp_path):
    rows = [(1, at(0), "u", "a.com", None), (2, at(1), "u", "b.com", "a.com"), (3, at(2), "u", "c.com", "b.com"), (4, at(100), "u", "d.com", "c.com")]
    s = stream(spark, tmp_path, rows, "id long, ts timestamp, principal string, domain string, referrer_domain string")
    got = {r.id: (r.depth, r.entry_domain) for r in drained(detect.navigation_stream(s), "hops")}
    assert got == {1: (0, "a.com"), 2: (1, "a.com"), 3: (2, "a.com"), 4: (0, "d.com")}
