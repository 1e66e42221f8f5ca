"""Sources: delimited and line files with receipts, archives, workbooks, pages and listings.

Where a record stands in its file is its receipt, so readers number lines
themselves; files are units of work, and Spark spreads them.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import money


def strings(*columns: str) -> T.StructType:
    """A schema of texts: dirty cells are cast later, by rules."""
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """A CSV file with a header, all cells as text, a byte-order mark ignored."""
    return spark.read.csv(path, header=True, schema=strings(*columns) if columns else None, quote='"', escape='"', multiLine=True, encoding="UTF-8")


def csv_with_lines(files: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of CSV files (``path, content`` as ``binaryFile`` gives them) with the line each starts at.

    A quoted cell may hold line ends, so numbering needs the parser; it
    reads a file as a stream of lines.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                reader = csv.reader(io.TextIOWrapper(io.BytesIO(content), "utf-8-sig", newline=""))
                header = next(reader, [])
                at = {c: header.index(c) if c in header else None for c in columns}
                rows, line = [], reader.line_num + 1
                for row in reader:
                    rows.append((path, line, *(row[k] if k is not None and k < len(row) else None for k in at.values())))
                    line = reader.line_num + 1
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=["file", "csv_line", *columns])
                        rows = []
                yield pd.DataFrame(rows, columns=["file", "csv_line", *columns])

    return files.select("path", "content").mapInPandas(run, ", ".join(["file string", "csv_line long", *(f"`{c}` string" for c in columns)]))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def zipped_members(files: DataFrame, ending: str = ".csv") -> DataFrame:
    """Members of zip files as ``path, content``, one row each."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for name in archive.namelist():
                        if name.lower().endswith(ending):
                            yield pd.DataFrame({"path": [f"{path}!{name}"], "content": [archive.read(name)]})

    return files.select("path", "content").mapInPandas(run, "path string, content binary")


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def _sheet_rows(archive: zipfile.ZipFile, name: str, shared: list[str]) -> Iterator[tuple[int, list[str | None]]]:
    for row in ElementTree.fromstring(archive.read(name)).iterfind(".//m:row", _NS):
        cells: dict[int, str | None] = {}
        for cell in row.iterfind("m:c", _NS):
            column = 0
            for letter in re.match("[A-Z]+", cell.get("r", "A1"))[0]:
                column = column * 26 + ord(letter) - 64
            value = cell.find("m:v", _NS)
            text = value.text if value is not None else "".join(t.text or "" for t in cell.iterfind(".//m:t", _NS))
            cells[column - 1] = shared[int(text)] if cell.get("t") == "s" and text else text
        yield int(row.get("r", 0)), [cells.get(k) for k in range(max(cells, default=-1) + 1)]


def workbook_rows(files: DataFrame) -> DataFrame:
    """All rows of all sheets of spreadsheet workbooks: ``file, sheet, row, cells``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    names = archive.namelist()
                    shared = []
                    if "xl/sharedStrings.xml" in names:
                        shared = ["".join(t.text or "" for t in si.iterfind(".//m:t", _NS)) for si in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")).iterfind("m:si", _NS)]
                    for sheet in sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
                        rows = [(path, sheet[14:-4], r, cells) for r, cells in _sheet_rows(archive, sheet, shared)]
                        yield pd.DataFrame(rows, columns=["file", "sheet", "row", "cells"])

    return files.select("path", "content").mapInPandas(run, "file string, sheet string, row long, cells array<string>")


def map_header(cells: list[str | None], keywords: dict[str, list[str]]) -> dict[str, int]:
    """Which column holds which field: the first heading with one of its words, each column and field once."""
    found: dict[str, int] = {}
    for k, cell in enumerate(cells):
        heading = " ".join((cell or "").lower().split())
        for field, words in keywords.items():
            if field not in found and any(w in heading for w in words):
                found[field] = k
                break
    return found


def table_rows(rows: DataFrame, keywords: dict[str, list[str]], needed: int = 2, within: int = 40) -> DataFrame:
    """Sheet rows below a header as fields; the header is the first of ``within`` rows that names enough of them."""
    def named(words: list[str]):
        return lambda cell: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(F.coalesce(cell, F.lit(""))), w))

    hits = sum((F.exists("cells", named(ws)).cast("int") for ws in keywords.values()), F.lit(0))
    headers = rows.where((F.col("row") <= within) & (hits >= needed)).groupBy("file", "sheet").agg(F.min_by("cells", "row").alias("header"), F.min("row").alias("at"))
    place = lambda ws: F.array_position(F.transform("header", named(ws)), True)
    joined = rows.join(headers, ["file", "sheet"]).where("row > at")
    return joined.select("file", "sheet", "row", *(F.get("cells", (place(ws) - 1).cast("int")).alias(field) for field, ws in keywords.items()))


def links(pages: DataFrame, html: str = "html", endings: tuple[str, ...] = ("pdf", "xlsx")) -> DataFrame:
    """Links to files of the given kinds, in order of appearance."""
    pattern = rf'(?i)href\s*=\s*["\']([^"\']+\.(?:{"|".join(endings)}))["\']'
    found = F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
    return pages.select("*", F.posexplode(found).alias("place", "href")).drop(html)


def strip_tags(html: Column) -> Column:
    """Text of a page: scripts and tags as spaces, white space once."""
    plain = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def cells(html: Column) -> Column:
    """Table cells of a page, as text."""
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), strip_tags)


def text_pages(text: DataFrame, column: str = "content") -> DataFrame:
    """Pages of layout text, which form feeds part: ``path, page, text``, numbered from 1."""
    return text.select("path", F.posexplode(F.split(column, "\f")).alias("p", "text")).select("path", (F.col("p") + 1).alias("page"), "text")


def allowance_lines(lines: DataFrame) -> DataFrame:
    """Summary lines of an allowance report: category, limit, spent, available, percent; ``--`` is missing."""
    number = r"\(?-?\$?[\d,]+\.\d\d\)?|--"
    pattern = rf"^\s*(\S.*?)\s{{2,}}({number})\s+({number})\s+({number})(?:\s+([\d.]+)\s*%|\s+--)?\s*$"
    part = lambda k: F.regexp_extract("value", pattern, k)
    value = lambda k: money.money(F.nullif(part(k), F.lit("--")))
    return lines.where(F.col("value").rlike(pattern)).select(part(1).alias("category"), value(2).alias("allowance"), value(3).alias("spent"), value(4).alias("available"), F.nullif(part(5), F.lit("")).try_cast("double").alias("percent"))


def carried(lines: DataFrame, heading: Column, key: str, order: str, name: str = "section") -> DataFrame:
    """Lines with the last heading above them."""
    above = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn(name, F.last(heading, ignorenulls=True).over(above))


def budget_facts(pages: DataFrame, title: str) -> DataFrame:
    """Labelled amounts in thousands on the pages of a title, as dollars."""
    on = pages.where(F.col("text").ilike(f"%{title}%"))
    rows = on.select("path", "page", F.explode(F.split("text", "\n")).alias("value"))
    pattern = r"^\s*([A-Za-z][A-Za-z ,&'-]+?)[\s.]{2,}(\(?[\d,]+\)?|-)\s*$"
    return rows.where(F.col("value").rlike(pattern)).select("path", "page", F.regexp_extract("value", pattern, 1).alias("label"), (money.document_number(F.regexp_extract("value", pattern, 2)) * 1000).alias("amount"))


def program_lines(lines: DataFrame) -> DataFrame:
    """A program report's lines: departments and programs carry forward, objects hold amounts.

    ``lines``: ``path, line, value``.  A department stands in capitals, a
    program begins with its code, an object with two digits; details are
    indented below the object they add to.
    """
    department = F.when(F.col("value").rlike(r"^[A-Z][A-Z ,&]{4,}$"), F.initcap(F.trim("value")))
    program = F.when(F.col("value").rlike(r"^\d\.\d\.\d{2}\.?\s"), F.regexp_extract("value", r"^(\d\.\d\.\d{2})", 1))
    out = carried(carried(lines, department, "path", "line", "department"), program, "path", "line", "program_code")
    pattern = r"^\s*(\d{2})\.?\s+(\S.*?)\s{2,}(\(?[\d,]+\)?|-)\s*$"
    return out.where(F.col("value").rlike(pattern)).select("path", "line", "department", "program_code", F.regexp_extract("value", pattern, 1).alias("object_code"), F.regexp_extract("value", pattern, 2).alias("object"), money.document_number(F.regexp_extract("value", pattern, 3)).alias("amount"))


def manifest(files: DataFrame) -> DataFrame:
    """``path, sha256, length, modified`` of files that ``binaryFile`` reads."""
    return files.select("path", F.sha2("content", 256).alias("sha256"), "length", F.col("modificationTime").alias("modified"))


def latest_scalar(rows: DataFrame, where: Column, when: str, value: str) -> DataFrame:
    """The newest value of a statistics table that fits a filter, with its date."""
    return rows.where(where & F.col(value).isNotNull()).agg(F.max(when).alias("at"), F.max_by(value, when).alias("value"))
