"""Pairs of texts that few slips separate, without comparing all of them.

Each edit (a letter put in, left out or changed, or two neighbours swapped)
is undone by deleting at most one letter on either side.  So texts that are
``k`` edits apart share what is left of them after at most ``k`` letters are
deleted from each, and meet under a hash of it.  Such remains hold nearly
the whole text: common beginnings or endings bring no texts together, as
blocks by them would.  A text of n letters has n * (n + 1) / 2 + 1 remains
for two edits.  What meets is a candidate, to be compared in full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import cut

#: Lengths from which a text may have one edit, and two.
ONE, TWO = 8, 12
#: Hashes that are made at once.
AT_ONCE = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK, _BACK2 = (np.uint64(pow(_BASE, -k, 1 << 64)) for k in (1, 2))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def remains(letters: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Hashes of texts of one length (a row of code points each) without 0, 1 and 2 of their letters; longer lengths allow more."""
    n, size = letters.shape
    powers = np.cumprod(np.full(size, _BASE, np.uint64), dtype=np.uint64)
    upto = np.zeros((n, size + 1), np.uint64)
    np.cumsum(_mixed(letters.astype(np.uint64) + np.uint64(1)) * powers, axis=1, out=upto[:, 1:])
    whole, found = upto[:, -1:], [upto[:, -1:]]
    if size >= ONE:  # what stands behind a deleted letter moves up by one place
        found.append(upto[:, :-1] + (whole - upto[:, 1:]) * _BACK)
    if size >= TWO:
        i, k = np.triu_indices(size, 1)
        found.append(upto[:, i] + (upto[:, k] - upto[:, i + 1]) * _BACK + (whole - upto[:, k + 1]) * _BACK2)
    return _mixed(np.concatenate(found, axis=1) ^ seeds[:, None])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # digits are never edited, so texts with others need not meet
    for batch in batches:
        texts, numbers = batch.column("text").to_pylist(), batch.column("n").to_numpy()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            step = max(1, AT_ONCE // int(1 + size * (size + 1) // 2))
            for start in range(0, len(at), step):
                some = at[start : start + step]
                mine = [texts[k] for k in some]
                letters = np.frombuffer("".join(mine).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(mine), size)
                seeds = np.fromiter((zlib.crc32("".join(c for c in t if "0" <= c <= "9").encode()) for t in mine), np.uint64, len(mine))
                hashes = np.sort(remains(letters, seeds), axis=1)
                first = np.ones(hashes.shape, bool)  # double letters leave the same text twice
                first[:, 1:] = hashes[:, 1:] != hashes[:, :-1]
                yield pa.RecordBatch.from_arrays([pa.array(hashes[first].view(np.int64)), pa.array(np.repeat(numbers[some], first.sum(axis=1)))], ["h", "n"])


def candidates(texts: DataFrame, column: str) -> DataFrame:
    """``x, y``, ``x < y`` or equal: different texts of ``column`` that may be two edits apart (one below 12 letters, none below 8), and each text with itself."""
    told = cut(texts.select(F.col(column).alias("text")).where("text IS NOT NULL").distinct().withColumn("n", F.monotonically_increasing_id()))
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # set, since little is dealt out and much made of it
    hashes = told.repartition(parts, "n").mapInArrow(_hashed, "h long, n long")
    # most remains are met once; the others are written, and joined with themselves
    met = cut(hashes.withColumn("_c", F.count("*").over(W.partitionBy("h"))).where("_c > 1").select("h", "n"))
    pairs = met.withColumnRenamed("n", "a").join(met.withColumnRenamed("n", "b"), "h").where("a <> b").select("a", "b").distinct()
    ends = [told.select(F.col("n").alias(c), F.col("text").alias(t)) for c, t in (("a", "x"), ("b", "y"))]
    found = pairs.join(ends[0], "a").join(ends[1], "b").where("x < y").select("x", "y")
    return found.unionByName(told.select(F.col("text").alias("x"), F.col("text").alias("y")))
