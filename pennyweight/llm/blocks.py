"""Documents in blocks, and packed messages between blocks and shards of keys.

Dedup operators look at every position of every text.  A row per position
would cost a shuffle several times the input, so documents travel as
blocks of a few megabytes (compressed), and what a block has to ask goes
as one packed row to each shard of the key space.  Shards answer with a
few bits per record, again one row per block.  A block sends each key
once, whatever number of its documents hold it, so a passage in a third
of all documents costs no more than a record per block.

Blocks are written to the shared folder before use: whoever reads them
again, after a lost executor too, numbers the same records the same way.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import input_bytes, materialise, pack_uint, release, unpack_uint

#: Least bytes of text to a block, and to each shard of the key space.
BLOCK_BYTES = 6 << 20
SHARD_BYTES = 12 << 20
#: Bytes of text, about 64 keys, that a message between a block and a shard stands for at least.
MESSAGE_BYTES = 512
SCHEMA = "block long, n_bytes long, doc_ids binary, sizes binary, body binary, rest binary"
REPLY = "block long, shard long, phase int, answer binary"
#: Stands for a null doc_id; no id is larger, so such a document is never the earlier one.
NO_ID = np.iinfo(np.int64).max


def sizes_for(total: int) -> tuple[int, int]:
    """Bytes of text to a block and to a shard for an input of so many bytes.

    There is a message for each block and shard, so both grow as the root of
    the input once messages would become small: below 70 GB
    they stay at their least, at 1 TB they are 23 MB, at 100 TB 230 MB each.
    Messages are then a fixed part of the input at any size, and a task's
    memory (some ten times its block or shard) grows with the root only.
    """
    least = int((MESSAGE_BYTES * max(0, total)) ** 0.5)
    return max(BLOCK_BYTES, least), max(SHARD_BYTES, least)


def shards_for(total: int) -> int:
    """Shards of the key space for an input of so many bytes of text."""
    return max(1, -(-total // sizes_for(total)[1]))


@dataclass
class Block:
    number: int
    doc_ids: np.ndarray  # ascending
    starts: np.ndarray  # one more than documents
    body: np.ndarray  # bytes of all texts
    rest: pa.RecordBatch | None

    def text(self, k: int) -> bytes:
        return self.body[self.starts[k] : self.starts[k + 1]].tobytes()


def write_blocks(docs: DataFrame, keep: tuple[str, ...] = (), block_bytes: int = 0) -> tuple[DataFrame, int]:
    """The blocks of ``docs`` (of ``block_bytes`` at least) and their bytes of text; columns ``keep`` ride along."""
    block_bytes = block_bytes or sizes_for(input_bytes(docs))[0]

    def seal(parts: list[pa.RecordBatch], number: int) -> dict:
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        ids = rows.column(0).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        rows = rows.take(pa.array(order))
        raw = [t.as_py().encode("utf-8", "surrogatepass") for t in rows.column(1)]
        sink = pa.BufferOutputStream()
        if keep:
            rest = rows.select(list(keep))
            with pa.ipc.new_stream(sink, rest.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(rest)
        return {
            "block": (TaskContext.get().partitionId() << 32) + number,
            "n_bytes": sum(map(len, raw)),
            "doc_ids": ids[order].astype("<i8").tobytes(),
            "sizes": np.array([len(x) for x in raw], "<i8").tobytes(),
            "body": zstandard.ZstdCompressor(level=3).compress(b"".join(raw)),
            "rest": sink.getvalue().to_pybytes(),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, 0
        kind = pa.schema([("block", pa.int64()), ("n_bytes", pa.int64()), *((c, pa.binary()) for c in ("doc_ids", "sizes", "body", "rest"))])
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                held.append(part)
                size += sum(len(t) for t in part.column(1).to_pylist())
                if size >= block_bytes:
                    yield pa.RecordBatch.from_pylist([seal(held, number)], kind)
                    held, size, number = [], 0, number + 1
        if held:
            yield pa.RecordBatch.from_pylist([seal(held, number)], kind)
        held = []
        release()

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *keep)
    spark = docs.sparkSession
    blocks = materialise(chosen.mapInArrow(run, SCHEMA), "blocks")
    total = blocks.agg(F.sum("n_bytes").alias("n")).first()["n"] or 0
    del spark
    return blocks, int(total)


def opened(row: dict) -> Block:
    sizes = np.frombuffer(row["sizes"], "<i8")
    body = zstandard.ZstdDecompressor().decompress(row["body"], max_output_size=max(1, row["n_bytes"]))
    rest = None
    if row["rest"]:
        with pa.ipc.open_stream(row["rest"]) as reader:
            rest = reader.read_all().combine_chunks().to_batches()[0] if len(sizes) else None
    return Block(row["block"], np.frombuffer(row["doc_ids"], "<i8"), np.r_[0, np.cumsum(sizes)], np.frombuffer(body, np.uint8), rest)


def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield opened(batch.slice(k, 1).to_pylist()[0])
    release()


def pack_docs(docs: np.ndarray) -> tuple[bytes, bytes]:
    """An ascending column of doc_ids as distinct ids and how often each comes."""
    if not len(docs):
        return b"", b""
    at = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
    base = docs[:1].astype("<i8")
    return base.tobytes() + pack_uint((docs[at] - base[0]).astype(np.uint64)), pack_uint(np.diff(np.r_[at, len(docs)]).astype(np.uint64))


def unpack_docs(ids: bytes, times: bytes) -> np.ndarray:
    if not ids:
        return np.zeros(0, np.int64)
    base = np.frombuffer(ids[:8], "<i8")[0]
    return np.repeat(unpack_uint(ids[8:]).astype(np.int64) + base, unpack_uint(times).astype(np.int64))


def by_shard(shard: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard that has records, with their numbers ascending."""
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    for k in np.flatnonzero(np.diff(cuts)):
        yield int(k), order[cuts[k] : cuts[k + 1]]


def messages(rows: list[dict], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_pylist(rows, pa.schema([(n, kinds[t]) for n, t in fields]))


def answer(values: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(values, np.uint8).tobytes(), 1)


def answered(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


def first_of(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Where, in sorted order, a record differs from the one before it in some key."""
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
        for key in keys:
            k = key[order]
            new[1:] |= k[1:] != k[:-1]
    return new
