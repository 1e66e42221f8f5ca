"""CSV files by byte ranges against one reader for the whole file."""

import csv
import io
import random

import pytest

from pennyweight.sources import ranges


def whole(text):
    reader = csv.reader(io.StringIO(text.removeprefix("﻿"), newline=""))
    header, out, line = next(reader, []), [], reader.line_num + 1
    for row in reader:
        if row:
            out.append((line, *(row[header.index(c)] if c in header and header.index(c) < len(row) else None for c in ("a", "b", "z"))))
        line = reader.line_num + 1
    return out


def awkward(seed):
    r = random.Random(seed)
    cell = lambda: r.choice(["", "x", "é" * r.randint(1, 40), '"he said ""no"" ,\n\r\n twice"', '"\n\n\n"', '""', '"' + "long, " * r.randint(1, 60) + '"', "12.5"])
    end = r.choice(["\n", "\r\n"])
    lines = [",".join(cell() for _ in range(r.choice([3, 3, 3, 2, 1]))) for _ in range(40)]
    return r.choice(["", "﻿"]) + end.join(["a,b,c", *lines]) + r.choice(["", end])


@pytest.mark.parametrize("size", [64, 1000])
def test_ranges_are_the_whole(spark, tmp_path, size, monkeypatch):
    monkeypatch.setattr(ranges, "MORE_BYTES", 50)
    texts = {f"{k}.csv": awkward(k) for k in range(3)} | {"empty.csv": "", "header.csv": "a,b,c\n", "bare.csv": 'a,b\n"x\ny"'}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    got = {}
    for x in ranges.csv_by_ranges(spark, f"file://{tmp_path}", ["a", "b", "z"], size).collect():
        got.setdefault(x["file"].rsplit("/", 1)[1], []).append((x["csv_line"], x["a"], x["b"], x["z"]))
    want = {n: whole(t) for n, t in texts.items()}
    assert {n: sorted(v, key=lambda r: r[0]) for n, v in got.items()} == {n: v for n, v in want.items() if v}
