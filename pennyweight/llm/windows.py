"""Substring dedup by Rabin-Karp hashes of every fixed-length word window.

Every window of ``width`` words has two rolling polynomials over the halves
of 128-bit word hashes: one names the shard that counts the window, the
other is its key there.  Shards grow in number with the input, so the bits
that tell windows apart do too: 64 and those of the shard's number, 87 for
100 TB, where less than one false match is expected.  Spark brings equal
keys of all blocks together and counts them by document.  A window is
repeated if a document with a smaller id holds it; overlapping repeated
windows merge into maximal intervals of words, which go.

Defined results: a null text has no words; texts shorter than a window
lose nothing; windows repeated only within documents of one id stay;
documents without an id come last, so they never count as the earlier
one; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from . import blocks as B
from .common import mix64, release

WIDTH = 13
_BASE = 0xD6E8FEB86659FD93

_SENT = "shard long, block long, docs binary, times binary, keys binary"
OUT = "doc_id long, n_words long, n_removed long, kept string"


def words_of(block: B.Block) -> tuple[list[list[bytes]], np.ndarray]:
    """The words of each document, and the two halves of a hash for each word in turn."""
    found = [block.text(k).split() for k in range(len(block.doc_ids))]
    number: dict[bytes, int] = {}
    at = np.fromiter((number.setdefault(w, len(number)) for ws in found for w in ws), np.int64, sum(map(len, found)))
    hashes = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w, 17) for w in number), np.uint64).reshape(-1, 2)
    return found, hashes[at]


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """The polynomial hash of each ``width`` consecutive values."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out *= np.uint64(_BASE)
        out += hashes[k : k + n]
    return mix64(out)


def _windows(block: B.Block, width: int) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words; starts of windows, their documents, keys and marks; distinct windows' first record; each window's number among them."""
    words, hashes = words_of(block)
    sizes = np.array([len(w) for w in words], np.int64)
    doc = np.repeat(np.arange(len(words)), sizes)
    keys, marks = rolling(hashes[:, 0], width), rolling(hashes[:, 1], width)
    inside = np.flatnonzero(doc[: len(keys)] == doc[width - 1 : width - 1 + len(keys)]) if len(keys) else np.zeros(0, np.int64)
    keys, marks, doc = keys[inside], marks[inside], doc[inside]
    order = np.argsort(keys, kind="stable")  # documents ascend, so the first of a run is the earliest
    new = B.first_of(order, keys, marks)
    group = np.empty(len(keys), np.int64)
    group[order] = np.cumsum(new) - 1
    return words, inside, doc, keys, marks, order[new], group


def removals(docs: DataFrame, width: int = WIDTH, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` (the words that stay, joined by a space), plus ``keep``."""
    blocks, total = B.write_blocks(docs, keep)
    shards = B.shards_for(total)
    cut = np.uint64(shards)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in B.each_block(batches):
            _, _, doc, keys, marks, reps, _ = _windows(block, width)
            reps = np.sort(reps)  # by document
            sent = keys[reps]
            rows = []
            for shard, at in B.by_shard((marks[reps] % cut).astype(np.int64), shards):
                ids, times = B.pack_docs(block.doc_ids[doc[reps[at]]])
                rows.append({"shard": shard, "block": block.number, "docs": ids, "times": times, "keys": sent[at].tobytes()})
            if rows:
                yield B.messages(rows, _SENT)

    def count(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in rows])
        docs = np.concatenate([B.unpack_docs(r["docs"], r["times"]) for r in rows])
        order = np.lexsort((docs, keys))
        new = B.first_of(order, keys)
        least = docs[order][new][np.cumsum(new) - 1]
        again = np.empty(len(keys), bool)
        again[order] = docs[order] > least
        out, at = [], 0
        for r in rows:
            n = len(r["keys"]) // 8
            out.append({"block": r["block"], "shard": r["shard"], "phase": 1, "answer": B.answer(np.packbits(again[at : at + n]))})
            at += n
        return pa.Table.from_batches([B.messages(out, B.REPLY)])

    def remove(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        got = {r["shard"]: r["answer"] for r in replies.to_pylist()}
        for row in blocks.to_pylist():
            block = B.opened(row)
            words, starts, doc, keys, marks, reps, group = _windows(block, width)
            by_doc = np.sort(reps)
            known = np.zeros(len(keys), bool)
            for shard, at in B.by_shard((marks[by_doc] % cut).astype(np.int64), shards):
                known[by_doc[at]] = np.unpackbits(B.answered(got[shard]), count=len(at)).astype(bool)
            ids = block.doc_ids[doc]
            gone = known[reps][group] | (ids > ids[reps][group]) if len(keys) else known
            sizes = np.array([len(w) for w in words], np.int64)
            edge = np.zeros(int(sizes.sum()) + 1, np.int64)
            np.add.at(edge, starts[gone], 1)
            np.add.at(edge, starts[gone] + width, -1)
            covered = np.cumsum(edge)[:-1] > 0
            ends = np.r_[0, np.cumsum(sizes)]
            kept, removed = [], []
            for k, ws in enumerate(words):
                drop = covered[ends[k] : ends[k + 1]]
                removed.append(int(drop.sum()))
                kept.append(b" ".join([w for w, d in zip(ws, drop.tolist(), strict=True) if not d] if removed[-1] else ws).decode("utf-8", "replace"))
            ids = block.doc_ids
            columns = [pa.array(ids, mask=ids == B.NO_ID), pa.array(sizes), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept"]
            if block.rest is not None:
                columns, names = [*columns, *block.rest.columns], [*names, *block.rest.schema.names]
            out.append(pa.RecordBatch.from_arrays(columns, names))
        release()
        return pa.Table.from_batches(out) if out else pa.table({"doc_id": pa.array([], pa.int64())})

    replies = blocks.mapInArrow(send, _SENT).groupBy("shard").applyInArrow(count, B.REPLY)
    kinds = dict(docs.dtypes)
    schema = ", ".join([OUT, *(f"`{c}` {kinds[c]}" for c in keep)])
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(remove, schema)
