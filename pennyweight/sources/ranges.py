"""CSV files of any size, read by byte ranges, with the line that each record starts at.

A quoted cell may hold line ends, so neither the line numbers nor the
records of a range are known from its bytes alone.  A first pass counts the
quotes and line ends of every range; prefix sums over a file's ranges give
whether a range begins inside quotes and the number of its first line.  The
second pass parses the records that begin after the line ends in its range,
reading on beyond it for the last.  A task holds one range and one record.

Defined results: records end at line feeds outside quotes, with or without
a carriage return; a byte-order mark is ignored; a file without bytes, or
with a header only, gives no rows; cells that a record lacks, and columns
that the header lacks, are null.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.lineage import cut

RANGE_BYTES = 64 << 20
#: Bytes read at a time beyond a range, and records in a batch.
MORE_BYTES = 1 << 20
TOGETHER = 4096
_BOM = b"\xef\xbb\xbf"


def _ends(data: bytes, quoted: bool) -> np.ndarray:
    """Where line feeds outside quotes are; ``quoted`` says whether the data begin inside."""
    raw = np.frombuffer(data, np.uint8)
    feeds = np.flatnonzero(raw == 10)
    quotes = np.flatnonzero(raw == 34)
    return feeds[(np.searchsorted(quotes, feeds) + quoted) % 2 == 0]


def _until_record_ends(file, at: int, quoted: bool) -> bytes:
    """The bytes from ``at`` to the end of the record there, or of the file."""
    parts = []
    while data := file.read_at(MORE_BYTES, at):
        ends = _ends(data, quoted)
        if len(ends):
            parts.append(data[: ends[0] + 1])
            break
        parts.append(data)
        quoted ^= data.count(b'"') % 2 == 1
        at += len(data)
    return b"".join(parts)


def _cells(data: bytes) -> Iterator[tuple[int, list[str]]]:
    """The records of some bytes, with the number of lines before each."""
    reader, line = csv.reader(io.TextIOWrapper(io.BytesIO(data), "utf-8", newline="")), 0
    for row in reader:
        if row:
            yield line, row
        line = reader.line_num


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {"quotes": [], "feeds": [], "header": []}
        for path, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            fs, name = pafs.FileSystem.from_uri(path)
            with fs.open_input_file(name) as file:
                data = file.read_at(end - start, start)
                out["quotes"].append(data.count(b'"'))
                out["feeds"].append(data.count(b"\n"))
                header = next(_cells(_until_record_ends(file, 0, False).removeprefix(_BOM)), (0, []))[1] if not start else None
                out["header"].append(header)
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], ["path", "start", "end", *out])


def _parsed(columns: list[str]):
    schema = pa.schema([("file", pa.string()), ("csv_line", pa.int64()), *((c, pa.string()) for c in columns)])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end, quoted, line, header in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = {c: header.index(c) if c in header else None for c in columns}
                fs, name = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(name) as file:
                    data = file.read_at(end - start, start)
                    ends = _ends(data, quoted)
                    if not len(ends):
                        continue
                    # the header, and what the range before began, end at the first
                    first = int(ends[0]) + 1
                    line += data.count(b"\n", 0, first) + 1
                    after_last = quoted ^ (data.count(b'"') % 2 == 1)
                    tail = _until_record_ends(file, end, after_last)
                rows = []
                for before, cells in _cells(data[first:] + tail):
                    rows.append((path, line + before, *(cells[k] if k is not None and k < len(cells) else None for k in at.values())))
                    if len(rows) == TOGETHER:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    return run


def csv_by_ranges(spark: SparkSession, path: str, columns: list[str], range_bytes: int = RANGE_BYTES, pattern: str = "*.csv") -> DataFrame:
    """``file, csv_line`` and the ``columns`` (as text) of all records of the CSV files below ``path``."""
    # names and sizes only: the content of a file is not read here
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length").where("length > 0")
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start")
    ranges = files.select("path", "length", start).select("path", "start", F.least(F.col("start") + range_bytes, "length").alias("end"))
    many = max(1, files.agg(F.sum(F.ceil(F.col("length") / range_bytes)).alias("n")).first()["n"] or 1)
    counted = cut(ranges.repartition(many, "path", "start").mapInArrow(_counted, "path string, start long, end long, quotes long, feeds long, header array<string>"))
    of = W.partitionBy("path").orderBy("start")  # a row for each range
    before = of.rowsBetween(W.unboundedPreceding, -1)
    quoted = (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("quoted")
    placed = counted.select("path", "start", "end", quoted, F.coalesce(F.sum("feeds").over(before), F.lit(0)).alias("line"), F.first("header").over(of).alias("header"))
    schema = ", ".join(["file string", "csv_line long", *(f"`{c}` string" for c in columns)])
    return placed.repartition(many, "path", "start").mapInArrow(_parsed(columns), schema)
