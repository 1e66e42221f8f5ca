"""Packing documents into sequences with bounded space, best-fit, online.

A task keeps at most ``windows`` open windows.  A document that fills
whole windows gives them at once; its rest goes into the open window that
it fills best.  If none has room and all places are taken, the fullest is
emitted.  What is open at a task's end is packed again, largest first,
with that of a bounded number of other tasks.

Defined results: a null or empty text is one piece with the end id only;
repeated rows are packed each on their own; an empty table gives none.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release, texts
from .encoding import default_vocabulary, encoder
from .tokenfiles import END_ID, slices

LENGTH = 1024
WINDOWS = 256
#: Tasks whose open windows are packed together.
TASKS_TOGETHER = 64

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, window long, offset long, open boolean"
_SCHEMA = pa.schema([(c, pa.bool_() if c == "open" else pa.int64()) for c in (x.split()[0] for x in PIECE.split(", "))])


class _Packer:
    """Open windows by free room; ``emit`` gets the pieces of a closed one."""

    def __init__(self, length: int, windows: int):
        self.length, self.windows, self.made = length, windows, 0
        self.free: list[tuple[int, int]] = []  # (room, window), ascending
        self.held: dict[int, list[tuple]] = {}
        self.out: list[tuple] = []

    def _close(self, window: int, still_open: bool = False) -> None:
        at = 0
        for piece in self.held.pop(window):
            self.out.append((*piece, window, at, still_open))
            at += piece[2]

    def place(self, piece: tuple) -> None:
        size = piece[2]
        k = bisect_left(self.free, (size, -1))
        if k < len(self.free):
            room, window = self.free.pop(k)
        else:
            if len(self.free) >= self.windows:
                self._close(self.free.pop(0)[1])
            room, window, self.made = self.length, self.made, self.made + 1
            self.held[window] = []
        self.held[window].append(piece)
        if room == size:
            self._close(window)
        else:
            insort(self.free, (room - size, window))

    def end(self) -> None:
        for _, window in self.free:
            self._close(window, True)
        self.free = []

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def _merge(length: int):
    def run(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        packer = _Packer(length, len(pieces) + 1)
        pieces = pieces.sort_values(["length", "doc_id", "task", "window", "offset"], ascending=[False, True, True, True, True])
        for row in pieces[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].itertuples(index=False):
            packer.place(tuple(row))
        packer.end()
        done = packer.taken()
        columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "window", "offset", "open"]
        out = pd.DataFrame(done, columns=columns)
        out["sequence_id"] = (1 << 62) + (int(key[0]) << 32) + out["window"]
        return out[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return run


def pack(docs: DataFrame, length: int = LENGTH, windows: int = WINDOWS, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """The pieces: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(forget=False)
        enc, packer = encoder(vocabulary), _Packer(length, windows)
        end = np.array([end_id], enc.dtype).tobytes()
        task = TaskContext.get().partitionId()

        def rows() -> pa.RecordBatch:
            done = [(*x[:5], task, *x[5:]) for x in packer.taken()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), _SCHEMA.types, strict=True)] if done else [pa.array([], t) for t in _SCHEMA.types], schema=_SCHEMA)

        for batch in slices(batches):
            for doc_id, coded in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1)), strict=True):
                ids = np.frombuffer(coded + end, enc.dtype).astype("<u4")
                for at in range(0, len(ids), length):
                    part = ids[at : at + length]
                    packer.place((doc_id, at, len(part), zlib.crc32(part.tobytes()), len(ids)))
            yield rows()
        packer.end()
        yield rows()

    placed = materialise(texts(docs).mapInArrow(run, PIECE), "pieces")
    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    closed = placed.where("not open").select(*kept, F.expr("shiftleft(task, 32) + window").alias("sequence_id"), "offset")
    together = placed.where("open").groupBy(F.expr(f"task div {TASKS_TOGETHER}").alias("together"))
    merged = together.applyInPandas(_merge(length), ", ".join(f"{c} long" for c in [*kept, "sequence_id", "offset"]))
    return closed.unionByName(merged)
