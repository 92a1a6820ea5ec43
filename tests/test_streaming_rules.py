"""Rules on a replayed stream, late and out of order, against their batch form on the same rows."""

import os
import random

import pytest

from tidewatch.rules import compiler
from tidewatch.rules.language import RuleError
from tidewatch.rules.rule import load
from tidewatch.streaming.rules import matches_stream

START = 1_700_000_000_000_000  # the watermark of a new stream is 1970; what isn't after it is late
ROWS = "id long, us long, principal string, domain string, action string"
RULES = {
    "presence": ("blocked", "10m"),
    "count": ("blocked | count() by principal >= 4", "30m"),
    "distinct": ("blocked | count(domain) by principal >= 3", "20m"),
    "each": ("blocked | count(domain, max_each=2) by principal >= 3", "30m"),
    "anchored": ("blocked | count() by principal >= 3 and rest", "15m"),
}


def rule(name):
    condition, frame = RULES[name]
    return load({"id": name, "title": name, "level": "low", "entity": {"type": "user", "field": "principal"}, "detection": {"blocked": {"action": "blocked"}, "rest": {"action": "allowed"}, "condition": condition, "timeframe": frame}})


def replayed():
    """Six hours of three users, times shared by rows; files hold rows up to eight minutes out of order, one user has most rows."""
    r = random.Random(5)
    rows = [(i, START + r.randrange(0, 360) * 60_000_000, r.choice("uuuuuvw"), f"d{r.randrange(6)}.com", r.choice(["blocked", "allowed", "blocked"])) for i in range(260)]
    return sorted(rows, key=lambda x: x[1] + r.randrange(0, 480_000_000))


@pytest.mark.parametrize("name", sorted(RULES))
def test_a_stream_gives_what_batch_gives(spark, tmp_path, name):
    rows = replayed()
    folder = tmp_path / "in"
    folder.mkdir()
    end = (10**7, START + 10**12, "z", "end.com", "blocked")  # moves the watermark past all other rows
    parts = [rows[i : i + 65] for i in range(0, len(rows), 65)] + [[end]]
    for n, part in enumerate(parts):
        spark.createDataFrame(part, ROWS).coalesce(1).write.parquet(str(folder / f"p{n}"))
        name_of = next(f for f in os.listdir(folder / f"p{n}") if f.endswith(".parquet"))
        os.rename(folder / f"p{n}" / name_of, folder / f"{n}.parquet")
        os.utime(folder / f"{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(str(folder / "*.parquet"))
        q = matches_stream(stream, rule(name)).writeStream.format("memory").queryName(f"rule_{name}").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(150)
        assert q.exception() is None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted(map(str, spark.table(f"rule_{name}").collect()))
    columns = spark.table(f"rule_{name}").columns
    want = sorted(map(str, compiler.matches(spark.createDataFrame(rows, ROWS), rule(name)).select(*columns).collect()))
    assert got == want and got


def test_rules_over_all_history_have_no_stream_form(spark):
    old = load({"id": "n", "title": "n", "level": "low", "entity": {"type": "user", "field": "principal"}, "detection": {"a": {"action": "blocked"}, "condition": "a | not_seen_before(principal, domain) in a"}})
    with pytest.raises(RuleError):
        matches_stream(spark.createDataFrame([], ROWS), old)
