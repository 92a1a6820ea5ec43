"""Log formats: a data source of lines by byte ranges, a registry of parsers that sniff, and folders parsed by it."""

from __future__ import annotations

import io
import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import logs

#: Lines that are sniffed, and the score from which a parser is taken.
SNIFFED, THRESHOLD = 50, 0.6
#: Bytes of a range, bytes of a batch, and names of files that are read in one piece.
SPLIT, BATCH, WHOLE = 64 << 20, 4 << 20, (".gz", ".bz2", ".zst", ".lz4")


# -- lines by byte ranges ------------------------------------------------------------------------------------


class Range(InputPartition):
    """The lines of a file that begin from ``start`` on and before ``stop``; without ``stop`` all."""

    def __init__(self, file: str, start: int, stop: int | None) -> None:
        super().__init__((file, start, stop))
        self.file, self.start, self.stop = file, start, stop


def ranged(handle: io.BufferedIOBase, start: int, stop: int | None) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in [start, stop); what began before ``start`` is its own range's."""
    at = start
    if start:
        handle.seek(start - 1)
        at += len(handle.readline()) - 1
    while stop is None or at < stop:
        line = handle.readline()
        if not line:
            return
        yield at, line.rstrip(b"\n").removesuffix(b"\r")
        at += len(line)


class _Lines(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.split, self.head = options["path"], int(options.get("split", SPLIT)), int(options.get("head", 0))

    def partitions(self) -> list[Range]:
        system, root = pafs.FileSystem.from_uri(self.path) if ":" in self.path else (pafs.LocalFileSystem(), self.path)
        info = system.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else [f for f in system.get_file_info(pafs.FileSelector(root, recursive=True)) if f.is_file and f.base_name[0] not in "_."]
        out = []
        for f in sorted(found, key=lambda f: f.path):
            if f.path.endswith(WHOLE) or self.head:
                out.append(Range(f.path, 0, None))
            else:
                out += [Range(f.path, at, min(at + self.split, f.size)) for at in range(0, f.size, self.split)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system = pafs.FileSystem.from_uri(self.path)[0] if ":" in self.path else pafs.LocalFileSystem()
        raw = system.open_input_stream(partition.file) if partition.stop is None else system.open_input_file(partition.file)
        with raw, io.BufferedReader(raw, 1 << 20) as handle:
            rows = enumerate(ranged(handle, partition.start, partition.stop), 1)
            batch, size = [], 0
            for n, (at, line) in itertools.islice(rows, self.head or None):
                batch.append((n, at, line.removeprefix(b"\xef\xbb\xbf") if at == 0 else line))
                size += len(line) + 64
                if size >= BATCH:
                    yield _batch(partition, batch)
                    batch, size = [], 0
            if batch:
                yield _batch(partition, batch)


def _batch(part: Range, rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    n = len(rows)
    columns = [pa.array([part.file] * n), pa.array([part.start] * n, pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2].decode("utf-8", "replace") for r in rows])]
    return pa.RecordBatch.from_arrays(columns, names=["file", "split", "line", "offset", "raw"])


class LineSource(DataSource):
    """``spark.read.format("log_lines")``: (file, split, line, offset, raw) of a file's or a folder's text.

    Files are cut into ranges of ``split`` bytes, each a task, and ``line`` counts from 1 in each; packed files are
    one range.  ``head`` asks for the first so many lines of each file alone.
    """

    @classmethod
    def name(cls) -> str:
        return "log_lines"

    def schema(self) -> str:
        return "file string, split long, line long, offset long, raw string"

    def reader(self, schema) -> DataSourceReader:
        return _Lines(dict(self.options))


def text_lines(spark: SparkSession, path: str, split: int = SPLIT, head: int = 0) -> DataFrame:
    spark.dataSource.register(LineSource)
    return spark.read.format("log_lines").option("split", split).option("head", head).load(path)


def numbered(rows: DataFrame) -> DataFrame:
    """(file, line_no from 1, raw): lines of a range are shifted by those of the file's ranges before it.

    The shifts are one row a range, summed file by file.
    """
    counts = rows.groupBy("file", "split").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(counts.select("file", "split", before.alias("before")), ["file", "split"]).select("file", (F.col("line") + F.col("before")).alias("line_no"), "raw")


# -- parsers -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Parser:
    """What a format needs: how surely some first lines are its own, and rows (file, line_no, raw) as (..., event, ocsf, failure)."""

    name: str
    sniff: Callable[[list[str]], float]
    parsed: Callable[[DataFrame, str], DataFrame]


PARSERS: dict[str, Parser] = {}


def register(parser: Parser) -> Parser:
    """Add a parser; a name can be taken once."""
    if parser.name in PARSERS:
        raise ValueError(f"a parser {parser.name} is there")
    PARSERS[parser.name] = parser
    return parser


def parser_of(name: str) -> Parser:
    if name not in PARSERS:
        raise KeyError(f"no parser {name}")
    return PARSERS[name]


def detected(lines: list[str], parsers: list[Parser] | None = None) -> list[str]:
    """Names of all parsers whose score for the first lines reaches THRESHOLD, the surest first."""
    scores = [(p.sniff(lines[:SNIFFED]), p.name) for p in (parsers if parsers is not None else PARSERS.values())]
    return [name for score, name in sorted(scores, key=lambda x: -x[0]) if score >= THRESHOLD]


register(Parser(logs.SOURCE, logs.sniff, lambda rows, first: logs.parsed(rows, logs.header_of(first))))


def formats(spark: SparkSession, path: str) -> DataFrame:
    """(file, format, first): the surest parser of each file by its first lines, null if none is sure, and its first line."""
    parsers = list(PARSERS.values())

    @F.pandas_udf("string")
    def surest(heads: pd.Series) -> pd.Series:
        return pd.Series([next(iter(detected(list(h), parsers)), None) for h in heads], dtype=object)

    head = F.transform(F.array_sort(F.collect_list(F.struct("line", "raw"))), lambda x: x["raw"])
    heads = text_lines(spark, path, head=SNIFFED).groupBy("file").agg(head.alias("head"))
    return heads.select("file", surest("head").alias("format"), F.get("head", F.lit(0)).alias("first"))


def read_logs(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(file, line_no, event, ocsf, failure) of every file below ``path``, each parsed by its own format and header.

    A file that no parser is sure of is one failure of line 0.  The driver sees different formats and first lines,
    not files.
    """
    found = formats(spark, path)
    kinds = found.filter("format is not null").select("format", "first").distinct().collect()
    rows = numbered(text_lines(spark, path, split)).join(found, "file")
    parts = [parser_of(k["format"]).parsed(rows.filter((F.col("format") == k["format"]) & (F.col("first") == k["first"])).select("file", "line_no", "raw"), k["first"]) for k in kinds]
    empty = logs.parsed(rows.filter(F.lit(False)).select("file", "line_no", "raw"), logs.header_of("datetime"))
    unknown = found.filter("format is null").select("file", F.lit(0).cast("long").alias("line_no"), F.struct(F.lit("unknown format").alias("reason"), F.substring("first", 1, 200).alias("excerpt")).alias("failure"))
    out = empty.unionByName(unknown, allowMissingColumns=True)
    for part in parts:
        out = out.unionByName(part)
    return out
