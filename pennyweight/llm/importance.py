"""Target-distribution importance resampling over hashed n-grams.

Features are all runs of 1 to ``n`` consecutive words; their bytes are
hashed (CRC-32) into buckets.  A bucket's gain is the logarithm of its
smoothed share in the target over that in the source; a document's weight
is the mean gain of its features.  Documents are drawn without
replacement by the highest sums of weight and Gumbel noise, the noise
being a function of the ``doc_id`` alone.

**Overlap chunking.**  A text over ``CHUNK_BYTES`` is cut at word
boundaries into chunks that are dealt out anew; each carries the ``n-1``
words after it, and owns the features that start at its own words, so
each feature is in exactly one chunk.  Features are written once as packed
bucket numbers; counts are added up by task, weights and feature counts
by document.  What all tasks hold of the corpus is a number to a bucket.

Defined results: a null or empty text has no words, weight 0, and is not
drawn while ``least_words`` is over 0; rows with a repeated ``doc_id``
are documents of their own with the same noise; a null ``doc_id`` has the
noise of an empty id and loses ties; an empty table gives no rows, and an
empty target leaves its smoothing.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release, texts
from .ordering import numbered
from .tokenfiles import slices

BUCKETS = 10_000
N = 2
#: Bytes from which a text is cut, and words that a chunk owns.
CHUNK_BYTES = 64 << 10
CHUNK_WORDS = 8192
#: Words whose hashes a process remembers.
REMEMBERED = 300_000
#: Letters and digits of ASCII and all other characters make words; A-Z are lower-cased, nothing else.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Longest word (with the space before it) whose hash is joined by table.
_JOINED = 64

_hashes: list[Hashes] = []


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _step(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A CRC register after one more byte of zero."""
    return x >> np.uint32(8) ^ table[x & np.uint32(255)]


class Hashes:
    """CRC-32 of words, and of runs of words from those of their parts.

    ``crc(a + b)`` is ``crc(a)`` moved on by the length of ``b``, xor
    ``crc(b)``.  Moving on is linear in the bits, so it is four lookups,
    one for each byte, in a table made for that length.
    """

    def __init__(self) -> None:
        table = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            table = np.where(table & 1, table >> np.uint32(1) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
        moved = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
        self.moves = np.empty((_JOINED, 4, 256), np.uint32)
        for k in range(_JOINED):
            self.moves[k] = moved
            moved = _step(moved, table)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.rows = np.zeros((1024, 3), np.uint32)  # of the word, of a space and the word, and the length of that

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The row of each word."""
        if len(self.known) > REMEMBERED:
            self.forget()
        found = list(map(self.known.get, words))
        if None in found:
            new = list({w for w, x in zip(words, found, strict=True) if x is None})
            first = len(self.known)
            while len(self.rows) < first + len(new):
                self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
            self.rows[first : first + len(new)] = [(zlib.crc32(w), zlib.crc32(b" " + w), len(w) + 1) for w in new]
            self.known.update(zip(new, range(first, first + len(new)), strict=True))
            found = list(map(self.known.__getitem__, words))
        return np.array(found, np.int64)

    def join(self, left: np.ndarray, more: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The hash of a run and, after it, a space and a word of that hash and length."""
        at = np.minimum(lengths, _JOINED - 1).astype(np.int64)
        out = more.copy()
        for k in range(4):
            out ^= self.moves[at, k, (left >> np.uint32(8 * k)) & np.uint32(255)]
        for k in np.flatnonzero(lengths >= _JOINED):  # longer words move on by steps of the table
            x, rest = left[k : k + 1], int(lengths[k])
            while rest:
                by = min(rest, _JOINED - 1)
                x = np.bitwise_xor.reduce([self.moves[by, j, (x >> np.uint32(8 * j)) & np.uint32(255)] for j in range(4)])
                rest -= by
            out[k] = more[k] ^ x[0]
        return out

    def features(self, words: list[bytes], owned: int, n: int) -> np.ndarray:
        """The hashes of all runs of 1 to ``n`` words that start at the first ``owned`` of them."""
        if not words:
            return np.zeros(0, np.uint32)
        at = self.numbers(words)
        rows = self.rows[at]
        run, out = rows[:, 0], []
        for k in range(n):
            if k:
                run = self.join(run[:-1], rows[k:, 1], rows[k:, 2])
            out.append(run[:owned])
            if len(run) < 2:
                break
        return np.concatenate(out)


def hashes() -> Hashes:
    if not _hashes:
        _hashes.append(Hashes())
    return _hashes[0]


def features(docs: DataFrame, n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """``(row, doc_id, n_words, n_features, packed)`` of each chunk, written: ``packed`` holds bucket numbers.

    ``row`` tells documents apart, also those of one ``doc_id``.
    """
    rows = texts(docs).withColumn("row", F.monotonically_increasing_id())
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")
    chunk = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("chunk", pa.int64()), ("owned", pa.int64()), ("words", pa.binary())])
    schema = "row long, doc_id long, n_words long, n_features long, packed binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            (doc,) = batch.cast(pa.schema([("doc_id", pa.int64()), ("text", pa.binary()), ("row", pa.int64())])).to_pylist()
            words = words_of(doc["text"])
            for k, at in enumerate(range(0, max(1, len(words)), CHUNK_WORDS)):
                row = {"row": doc["row"], "doc_id": doc["doc_id"], "chunk": k, "owned": min(CHUNK_WORDS, len(words) - at), "words": b" ".join(words[at : at + CHUNK_WORDS + n - 1])}
                yield pa.RecordBatch.from_pylist([row], chunk)
        release()

    def pack(row: list, doc_id: list, owned: list[int | None], raw: list[bytes]) -> pa.RecordBatch:
        made, found, n_words = hashes(), [], []
        for own, text in zip(owned, raw, strict=True):
            words = words_of(text)
            n_words.append(len(words) if own is None else own)
            found.append((made.features(words, n_words[-1], n) % np.uint32(buckets)).astype(kind))
        columns = [row, doc_id, n_words, [len(x) for x in found]]
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array([x.tobytes() for x in found], pa.binary())], ["row", "doc_id", "n_words", "n_features", "packed"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            yield pack(batch.column(2).to_pylist(), batch.column(0).to_pylist(), [None] * batch.num_rows, batch.column(1).cast(pa.binary()).to_pylist())

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 16):
            row, doc_id, _, owned, raw = (c.to_pylist() for c in batch.columns)
            yield pack(row, doc_id, owned, raw)

    size = F.octet_length("text")
    short = rows.where(size <= CHUNK_BYTES).mapInArrow(whole, schema)
    long_ = rows.where(size > CHUNK_BYTES).mapInArrow(cut, "row long, doc_id long, chunk long, owned long, words binary")
    return materialise(short.unionByName(long_.repartition("row", "chunk").mapInArrow(chunks, schema)), "features")


def counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features lie in each bucket: one row a bucket and task is added up."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches, 128):
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "times"])

    out = np.zeros(buckets, np.int64)
    # at most a row to a bucket comes to the driver
    for r in found.select("packed").mapInArrow(add, "bucket long, times long").groupBy("bucket").agg(F.sum("times").alias("times")).toLocalIterator():
        out[r["bucket"]] = r["times"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of a bucket's smoothed share in the target over that in the source."""
    more, from_, to = float(len(source)), float(source.sum()), float(target.sum())
    ratio = ((t + 1.0) * (from_ + more) / ((s + 1.0) * (to + more)) for s, t in zip(source.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weigh(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)`` of each document; sums over its chunks."""
    kind = np.dtype("<u2" if len(gain) <= 1 << 16 else "<u4")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            total = [int(gain[np.frombuffer(x, kind)].sum()) for x in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(total, pa.int64())], ["row", "doc_id", "n_words", "n_features", "total"])

    parts = found.mapInArrow(sums, "row long, doc_id long, n_words long, n_features long, total long")
    whole = parts.groupBy("row").agg(F.min("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("n_words", "n_features", "total")))
    mean = F.expr("CASE WHEN n_features = 0 THEN 0L ELSE (total - pmod(total, n_features)) DIV n_features END")
    return whole.select("doc_id", "n_words", "n_features", mean.alias("weight"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, seed: int = 7, least_words: int = 20, n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score, rank)`` of every document.

    ``target`` is a table of ``doc_id`` and ``text`` too.  ``rank`` is 1, 2, 3, ...
    for the ``percent`` of documents of ``least_words`` words or more that are
    drawn, null for the rest.
    """
    found = features(docs, n, buckets)
    gain = gains(counts(found, buckets), counts(features(target, n, buckets), buckets))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    noise = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.ln(-F.ln((noise + 0.5) / 4294967296.0)))
    scored = materialise(weigh(found, gain).withColumns({"score": F.col("weight") + gumbel, "_short": (F.col("n_words") < least_words).cast("int")}), "scored")
    take = percent * scored.where("_short = 0").count() // 100
    ranked = numbered(scored, [], [F.col("_short"), F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "_index")
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("_index") < take, F.col("_index") + 1).alias("rank"))
