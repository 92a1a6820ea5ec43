"""Lines by byte ranges, the registry of parsers and folders of several formats."""

import gzip
import io

import pytest

from tidewatch.sources import formats, logs

HEADER = "datetime\tuser\tclientip\thost\turl\taction"
ROW = "2024-01-01T00:00:0{}Z\tu{}\t10.0.0.1\ta.com\thttp://a.com/{}\tAllowed"
TEXT = "\n".join([HEADER, ROW.format(1, 1, "x"), "", ROW.format(2, 2, "é" * 40) + "\r", "cut", ROW.format(3, 3, "z")])


@pytest.mark.parametrize("text", [TEXT, TEXT + "\n", "", "\n", "\n\n", "a", "ab\n\ncd"])
def test_ranges_have_each_line_once(text):
    data = text.encode()
    want = [x.removesuffix(b"\r") for x in (data[:-1] if data.endswith(b"\n") else data).split(b"\n")] if data else []
    for size in (1, 2, 3, 7, 50, 10**6):
        got = [x for at in range(0, len(data), size) for x in formats.ranged(io.BytesIO(data), at, min(at + size, len(data)))]
        assert [line for _, line in got] == want
        assert all(data[at : at + len(line)] == line for at, line in got)


@pytest.mark.parametrize("split", [11, 64, 1 << 20])
def test_numbers_do_not_depend_on_ranges(spark, tmp_path, split):
    (tmp_path / "a.log").write_bytes(TEXT.encode())
    with gzip.open(tmp_path / "b.log.gz", "wb") as f:
        f.write(TEXT.encode())
    (tmp_path / "_SUCCESS").write_text("no lines")
    (tmp_path / "empty.log").write_text("")
    rows = formats.numbered(formats.text_lines(spark, str(tmp_path), split)).collect()
    want = list(enumerate((x.removesuffix("\r") for x in TEXT.split("\n")), 1))
    for name in ("a.log", "b.log.gz"):
        assert sorted((r.line_no, r.raw) for r in rows if r.file.endswith(name)) == want
    assert len(rows) == 2 * len(want)


def test_folder_of_formats(spark, tmp_path):
    (tmp_path / "a.log").write_text(TEXT)
    (tmp_path / "b.csv").write_text("DateTime,login,user,clientip,action,url\n2024-01-02T00:00:00Z,x,v,10.0.0.2,blocked,http://b.com/\n")
    (tmp_path / "c.txt").write_text("nothing\nto see\n")
    got = {(r.file.rsplit("/", 1)[1], r.line_no): r for r in formats.read_logs(spark, str(tmp_path), split=40).collect()}
    assert set(got) == {("a.log", 2), ("a.log", 4), ("a.log", 5), ("a.log", 6), ("b.csv", 2), ("c.txt", 0)}
    assert got["a.log", 4].event.user == "u2" and got["b.csv", 2].event.user == "v" and got["b.csv", 2].event.host == "b.com"
    assert got["a.log", 5].failure.reason == "too few fields" and got["c.txt", 0].failure.reason == "unknown format"
    with pytest.raises(Exception, match="nowhere"):
        formats.read_logs(spark, str(tmp_path / "nowhere")).collect()


def test_registry(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(formats, "PARSERS", dict(formats.PARSERS))
    assert formats.detected([HEADER]) == [logs.SOURCE] and formats.detected(["hello"]) == [] and formats.detected([]) == []
    pairs = formats.Parser("pairs", lambda lines: 0.6 if all("=" in x for x in lines) else 0.59, lambda rows, first: logs.parsed(rows.selectExpr("file", "line_no + 1 as line_no", "replace(raw, 'at=', '') || ',' as raw"), logs.header_of("datetime,user")))
    formats.register(pairs)
    with pytest.raises(ValueError):
        formats.register(pairs)
    with pytest.raises(KeyError):
        formats.parser_of("other")
    assert formats.detected(["at=1", "at=2"]) == ["pairs"]
    (tmp_path / "p.log").write_text("at=2024-01-01T00:00:00Z\nat=soon\n")
    got = formats.read_logs(spark, str(tmp_path)).orderBy("line_no").collect()
    assert got[0].event is not None and got[1].failure.reason == "bad datetime"


def test_a_line_is_cut_and_typed_once_however_often_its_fields_are_read(spark):
    """The plan of a filter on parsed lines names the cut of a line once, the time's conversion as often as the columns need it."""
    rows = spark.createDataFrame([(2, "2024-01-01T00:00:00Z\tu\t10.0.0.1\thttp://a.b.co.uk/x\tGET\t200")], "line_no long, raw string").filter("length(raw) < 100")
    found = logs.parsed(rows, logs.header_of("DateTime\tuser\tclientip\turl\trequestmethod\tstatus"))
    plan = found.filter("event is not null").select("event.*", "ocsf.*")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(raw#") == 1 and plan.count("try_cast") <= 4 and len(plan) < 60_000
    assert found.filter("event is not null").first().event.registrable_domain == "b.co.uk"


def test_equal_names_in_a_header_and_a_header_without_known_names(spark):
    rows = spark.createDataFrame([(2, "2024-01-01T00:00:00Z,u,v"), (3, "x")], "line_no long, raw string")
    got = {r.line_no: r for r in logs.parsed(rows, logs.header_of("datetime,user,user")).collect()}
    assert got[2].event.user == "u" and got[3].failure.reason == "too few fields"
    assert {r.failure.reason for r in logs.parsed(rows, logs.header_of("p,q")).collect()} == {"no datetime", "too few fields"}
