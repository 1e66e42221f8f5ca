"""Sets of word shingles as 64-bit hashes, for many texts at once.

Words are runs of anything but ASCII white space, A-Z lower-cased.  A word
is hashed as a polynomial of its bytes, a shingle as a polynomial of its
words' hashes, all in array operations.  Texts of fewer words than a shingle
have their whole sequence as the only one; texts without words share one
that stands for "no words".
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import mix64, ranges

_WORD_BASE, _SHINGLE_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_NO_WORDS = np.uint64(0x5851F42D4C957F2D)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text looked at together.
CHUNK = 1 << 20


def _word_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word: sums of weighted bytes, brought back to power zero."""
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK, side="right")))
        low, high = int(starts[at]), int(ends[to - 1])
        up, down = (np.full(high - low, x, np.uint64) for x in (_WORD_BASE, pow(_WORD_BASE, -1, 1 << 64)))
        up[0] = down[0] = 1
        part = body[low:high].astype(np.uint64) + np.uint64(1)
        part *= np.cumprod(up, out=up)
        sums = np.r_[np.uint64(0), np.cumsum(part, dtype=np.uint64)]
        total = sums[ends[at:to] - low] - sums[starts[at:to] - low]
        out[at:to] = total * np.cumprod(down, out=down)[starts[at:to] - low]
        at = to
    return mix64(out)


def sets(texts: list[str], width: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    body = _LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
    word = np.r_[False, ~_BLANK[body]]
    edge = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edge[0::2], edge[1::2]
    hashes = _word_hashes(body, starts, ends)
    limits = np.searchsorted(starts, np.r_[0, np.cumsum([len(r) + 1 for r in raw])])
    n = max(0, len(hashes) - width + 1)
    rolled = hashes[:n].copy()
    for k in range(1, width):
        rolled *= np.uint64(_SHINGLE_BASE)
        rolled += hashes[k : k + n]
    rolled = mix64(rolled)
    out = []
    for a, b in zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
            continue
        total = np.uint64(b - a)
        with np.errstate(over="ignore"):
            for h in hashes[a:b]:
                total = total * np.uint64(_SHINGLE_BASE) + h
        out.append(mix64(np.array([total])) if b > a else np.array([_NO_WORDS]))
    return out


def each_set(batch: pa.RecordBatch, ids: int, texts: int, width: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """The batch's ids and sets, some megabytes of text at a time."""
    names, said = batch.column(ids).to_pylist(), batch.column(texts)
    sizes = np.cumsum([len(t) for t in (x.as_py() or "" for x in said)])
    at = 0
    while at < batch.num_rows:
        before = int(sizes[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, before + CHUNK, side="right")))
        yield names[at:to], sets([x.as_py() or "" for x in said[at:to]], width)
        at = to


def flat(bags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All members one after the other, and the size of each bag."""
    return (np.concatenate(bags) if bags else np.zeros(0, np.uint64)), np.array([len(b) for b in bags], np.int64)


class Sketch:
    """Counts of hashes in two rows of a fixed number of counters: an upper estimate of each count."""

    BITS = 20

    def __init__(self) -> None:
        self.rows = np.zeros((2, 1 << self.BITS), np.int64)

    @classmethod
    def places(cls, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (hashes >> np.uint64(64 - cls.BITS)).astype(np.int64), (hashes & np.uint64((1 << cls.BITS) - 1)).astype(np.int64)

    def add(self, hashes: np.ndarray) -> None:
        for row, place in zip(self.rows, self.places(hashes), strict=True):
            row += np.bincount(place, minlength=len(row))


def classes_of_counts(rows: np.ndarray) -> np.ndarray:
    """Counts as steps of their logarithm, one byte each: all that the order of shingles needs."""
    return np.floor(4 * np.log2(np.maximum(rows, 1))).astype(np.uint8)


def rarest_first(bag: np.ndarray, steps: np.ndarray, many: int) -> np.ndarray:
    """The ``many`` first members in the order that all texts share: by estimated count, then by hash."""
    first, second = Sketch.places(bag)
    return bag[np.lexsort((bag, np.minimum(steps[0][first], steps[1][second])))[:many]]


__all__ = ["CHUNK", "Sketch", "classes_of_counts", "each_set", "flat", "ranges", "rarest_first", "sets"]
