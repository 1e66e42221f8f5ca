"""Substring dedup of bytes by suffix sorting with bucket-pointer refinement.

Equal strings of ``length`` bytes must meet to be compared.  Each window
of that length is filed under its anchor: the ``gram``-byte string inside
it with the least hash.  Equal windows have equal anchors, so Spark deals
anchors out to shards.  Consecutive windows with one anchor form a unit.

1.  Shards compare units as wholes.  A unit that an earlier document holds
    goes; one whose anchor no other text shares stays.  Both are decided
    by a few bits.
2.  What is left are units that share an anchor but differ somewhere.
    Only their bytes travel.  A shard sorts their suffixes by
    bucket-pointer refinement: buckets of equal ``q``-grams first, each then
    refined by sorting on the bucket identifiers found ``h`` bytes later,
    refined buckets serving as the pointers of the next step, until they
    agree on ``length`` bytes.  Buckets left with one member drop out.  A
    window goes if its final bucket has a member of an earlier document.

Defined results: a null text is empty; texts shorter than ``length`` lose
nothing; strings repeated only within documents of one id stay; documents
without an id come last; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import materialise, mix64, ranges, release

LENGTH = 50
GRAM = 20
_BASE = 0x9E3779B97F4A7C15
#: Windows looked at together: their hashes stay in a core's cache.
CHUNK = 1 << 17

_UNITS = "shard long, block long, docs binary, times binary, anchors binary, bodies binary"
_BYTES = "shard long, block long, docs binary, times binary, sizes binary, body binary"
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
#: What a shard says of a unit.
STAYS, GOES, ASKS = 0, 1, 2


def gram_hashes(body: np.ndarray, width: int) -> np.ndarray:
    """A polynomial hash of every ``width`` bytes, by doubling."""
    have, power = body.astype(np.uint64) + np.uint64(1), 1
    out, done, left = None, 0, width
    while True:
        if left & 1:
            if out is None:
                out = have
            else:
                n = len(body) - done - power + 1
                out = out[:n] * np.uint64(pow(_BASE, power, 1 << 64)) + have[done : done + n]
            done += power
        left >>= 1
        if not left:
            return mix64(out)
        n = len(have) - power
        have = have[:n] * np.uint64(pow(_BASE, power, 1 << 64)) + have[power : power + n]
        power *= 2


def run_hashes(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of each run ``hashes[first..last]``, of all its members and their order.

    Differences of prefix sums weighted by powers, brought back to power zero.
    """
    up, down = (np.full(len(hashes), x, np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
    up[:1] = down[:1] = 1
    sums = np.cumsum(hashes * np.cumprod(up, out=up), dtype=np.uint64)
    total = sums[last] - sums[first] + hashes[first] * up[first]
    return mix64(total * np.cumprod(down, out=down)[first] + mix64((last - first).astype(np.uint64)))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


class Units:
    """The units of a block: first and last window, document, anchor, and a hash of all its bytes."""

    def __init__(self, block: B.Block, length: int, gram: int):
        self.block, self.length = block, length
        sizes = np.diff(block.starts)
        n = max(0, len(block.body) - length + 1)
        parts = []
        doc_of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        for at in range(0, n, CHUNK):
            to = min(n, at + CHUNK)
            body = block.body[at : to + length - 1]
            inside = doc_of[at:to] == doc_of[at + length - 1 : to + length - 1]
            where = np.flatnonzero(inside)
            if not len(where):
                continue
            anchor = sliding_least(gram_hashes(body, gram), length - gram + 1)[where]
            new = np.r_[True, (anchor[1:] != anchor[:-1]) | (np.diff(where) != 1) | (np.diff(doc_of[at:to][where]) != 0)]
            first = np.flatnonzero(new)
            last = np.r_[first[1:], len(where)] - 1
            s, e = where[first], where[last]
            name = run_hashes(gram_hashes(body, length), s, e)
            parts.append((s + at, e + at, doc_of[s + at].astype(np.int64), anchor[first], name))
        if parts:
            self.first, self.last, self.doc, self.anchor, self.name = (np.concatenate(x) for x in zip(*parts, strict=True))
        else:
            self.first = self.last = self.doc = np.zeros(0, np.int64)
            self.anchor = self.name = np.zeros(0, np.uint64)
        order = np.lexsort((self.name, self.anchor))  # stable, and documents ascend
        new = B.first_of(order, self.anchor, self.name)
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.reps = order[new]

    def dealt(self, shards: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """The distinct units by document, and for each shard which of them it gets."""
        by_doc = np.sort(self.reps)
        shard = (mix64(self.anchor[by_doc]) % np.uint64(shards)).astype(np.int64)
        return by_doc, list(B.by_shard(shard, shards))

    def answers(self, shards: int, replies: dict[int, bytes]) -> np.ndarray:
        """The shards' answers by unit number; only those of distinct units are set."""
        by_doc, dealt = self.dealt(shards)
        said = np.zeros(len(self.first), np.uint8)
        for shard, at in dealt:
            said[by_doc[at]] = B.answered(replies[shard])
        return said


def refine(body: np.ndarray, starts: np.ndarray, length: int, q: int = 7) -> np.ndarray:
    """Buckets of the suffixes at ``starts``: equal numbers where ``length`` bytes are equal.

    Numbers are those of the suffix order among what is still unresolved;
    suffixes that are alone get numbers of their own.
    """
    q = min(q, length)
    n = len(body) - q + 1
    if n <= 0 or not len(starts):
        return np.zeros(len(starts), np.int64)
    code = np.zeros(n, np.int64)
    for k in range(q):
        code = (code << 8) | body[k : k + n]
    pointer = np.unique(code, return_inverse=True)[1].astype(np.int64)
    depth = q
    while depth < length:
        step = min(depth, length - depth)
        alive = np.flatnonzero(np.bincount(pointer)[pointer] > 1)  # the others are sorted already
        alive = alive[alive + step < len(pointer)]
        later = pointer[alive + step]
        order = np.lexsort((later, pointer[alive]))
        new = B.first_of(order, pointer[alive], later)
        refined = pointer.copy()
        # a bucket's first part keeps its number, further parts get new ones
        head = B.first_of(order, pointer[alive])
        extra = new & ~head
        numbers = pointer[alive][order]
        fresh = np.cumsum(extra) + int(pointer.max())
        run = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        numbers = np.where(extra[run], fresh[run], numbers)
        refined[alive[order]] = numbers
        pointer, depth = refined, depth + step
    return pointer[starts]


def _compare(table: pa.Table) -> pa.Table:
    """Whole units of one shard: which go, which stay, and which need their bytes compared."""
    rows = table.to_pylist()
    anchors = np.concatenate([_five(r["anchors"]) for r in rows])
    names = np.concatenate([np.frombuffer(r["bodies"], np.uint64) for r in rows])
    docs = np.concatenate([B.unpack_docs(r["docs"], r["times"]) for r in rows])
    order = np.lexsort((docs, names, anchors))
    new = B.first_of(order, anchors, names)
    head = B.first_of(order, anchors)
    unit, file = np.cumsum(new) - 1, np.cumsum(head) - 1
    sorted_docs = docs[order]
    first = sorted_docs[new][unit]
    forms = np.bincount(file[new])[file]
    at = np.flatnonzero(head)
    spread = np.minimum.reduceat(sorted_docs, at)[file] < np.maximum.reduceat(sorted_docs, at)[file]
    said = np.empty(len(order), np.uint8)
    said[order] = np.where(sorted_docs > first, GOES, np.where((forms > 1) & spread, ASKS, STAYS))
    out, k = [], 0
    for r in rows:
        n = len(r["bodies"]) // 8
        out.append({"block": r["block"], "shard": r["shard"], "phase": 1, "answer": B.answer(said[k : k + n])})
        k += n
    return pa.Table.from_batches([B.messages(out, B.REPLY)])


def _five(packed: bytes) -> np.ndarray:
    raw = np.zeros((len(packed) // 5, 8), np.uint8)
    raw[:, :5] = np.frombuffer(packed, np.uint8).reshape(-1, 5)
    return raw.view("<u8").ravel()


def _sort(length: int):
    def run(table: pa.Table) -> pa.Table:
        """Suffixes of the units that share an anchor: which windows an earlier document holds."""
        rows = table.to_pylist()
        sizes = np.concatenate([np.frombuffer(r["sizes"], "<i4") for r in rows]).astype(np.int64)
        docs = np.concatenate([B.unpack_docs(r["docs"], r["times"]) for r in rows])
        body = np.frombuffer(b"".join(r["body"] for r in rows), np.uint8)
        starts = np.r_[0, np.cumsum(sizes)[:-1]] if len(sizes) else sizes
        windows = sizes - length + 1
        at = ranges(starts, windows)
        bucket = refine(body, at, length)
        who = np.repeat(docs, windows)
        least = np.full(int(bucket.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, bucket, who)
        goes = who > least[bucket]
        out, k, w = [], 0, np.r_[0, np.cumsum(windows)]
        for r in rows:
            n = len(r["sizes"]) // 4
            out.append({"block": r["block"], "shard": r["shard"], "phase": 2, "answer": B.answer(np.packbits(goes[w[k] : w[k + n]]))})
            k += n
        return pa.Table.from_batches([B.messages(out, B.REPLY)])

    return run


def removals(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (the bytes that stay), plus columns ``keep``."""
    return _removed(docs, length, gram, keep, OUT, lambda cut: cut)


def _removed(docs: DataFrame, length: int, gram: int, keep: tuple[str, ...], out: str, make: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """What ``make`` gives (columns ``out`` and ``keep``) of a block's cut documents, in the task that cuts them."""
    blocks, total = B.write_blocks(docs, keep)
    shards = B.shards_for(total)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in B.each_block(batches):
            units, rows = Units(block, length, gram), []
            by_doc, dealt = units.dealt(shards)
            for shard, at in dealt:
                some = by_doc[at]
                ids, times = B.pack_docs(block.doc_ids[units.doc[some]])
                low = units.anchor[some].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                rows.append({"shard": shard, "block": block.number, "docs": ids, "times": times, "anchors": low.tobytes(), "bodies": units.name[some].tobytes()})
            if rows:
                yield B.messages(rows, _UNITS)

    def show(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        got = {r["shard"]: r["answer"] for r in replies.to_pylist()}
        rows = []
        for row in blocks.to_pylist():
            block = B.opened(row)
            units = Units(block, length, gram)
            said = units.answers(shards, got)
            by_doc, dealt = units.dealt(shards)
            for shard, at in dealt:
                some = by_doc[at]
                some = some[said[some] == ASKS]
                if not len(some):
                    continue
                ids, times = B.pack_docs(block.doc_ids[units.doc[some]])
                sizes = units.last[some] - units.first[some] + length
                rows.append(
                    {
                        "shard": shard, "block": block.number, "docs": ids, "times": times,
                        "sizes": sizes.astype("<i4").tobytes(), "body": block.body[ranges(units.first[some], sizes)].tobytes(),
                    }
                )
        release()
        return pa.Table.from_batches([B.messages(rows, _BYTES)])

    def remove(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        got: dict[int, dict[int, bytes]] = {1: {}, 2: {}}
        for r in replies.to_pylist():
            got[r["phase"]][r["shard"]] = r["answer"]
        done = []
        for row in blocks.to_pylist():
            block = B.opened(row)
            units = Units(block, length, gram)
            gone = _gone(units, shards, got, length)
            del units
            done.append(make(_cut(block, gone)))
            del block, gone
            release()
        return pa.Table.from_batches(done)

    first = blocks.mapInArrow(send, _UNITS).groupBy("shard").applyInArrow(_compare, B.REPLY)
    first = materialise(first, "units")
    asked = blocks.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(show, _BYTES)
    second = asked.groupBy("shard").applyInArrow(_sort(length), B.REPLY)
    kinds = dict(docs.dtypes)
    schema = ", ".join([out, *(f"`{c}` {kinds[c]}" for c in keep)])
    return blocks.groupBy("block").cogroup(first.union(second).groupBy("block")).applyInArrow(remove, schema)


def _gone(units: Units, shards: int, got: dict[int, dict[int, bytes]], length: int) -> np.ndarray:
    """Which bytes of the block go."""
    said = units.answers(shards, got[1])
    marks = np.zeros(len(units.block.body) + 1, np.int8)  # where windows that go begin and end; no two units share one
    if len(units.first):
        rep = units.reps[units.group]
        ids = units.block.doc_ids[units.doc]
        whole = (said[rep] == GOES) | (ids > ids[rep])
        marks[units.first[whole]] += 1
        marks[units.last[whole] + 1] -= 1
    starts = np.cumsum(marks, dtype=np.int8, out=marks).view(bool)
    if len(units.first):
        # windows of the units that asked, in the order in which they were sent
        n_windows = units.last - units.first + 1
        begin = np.full(len(units.first), -1, np.int64)
        by_doc, dealt = units.dealt(shards)
        bits, at0 = [], 0
        for shard, at in dealt:
            some = by_doc[at]
            some = some[said[some] == ASKS]
            if len(some):
                n = n_windows[some]
                begin[some] = at0 + np.r_[0, np.cumsum(n)[:-1]]
                bits.append(np.unpackbits(B.answered(got[2][shard]), count=int(n.sum())).astype(bool))
                at0 += int(n.sum())
        if bits:
            flags = np.concatenate(bits)
            part = np.flatnonzero(~whole & (begin[rep] >= 0))
            starts[ranges(units.first[part], n_windows[part])] = flags[ranges(begin[rep[part]], n_windows[part])]
    total = np.cumsum(starts[:-1], dtype=np.int32)
    gone = total > 0
    gone[length:] = total[length:] > total[:-length]
    return gone


def dedup_text(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` without repeated strings: ``text`` (and ``n_chars``, if there) are what stays.

    Bytes of a character that lost others go too.
    """
    keep = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    plain = docs.select("doc_id", "text", *(F.col(c).alias(f"_keep_{c}") for c in keep))
    held = tuple(f"_keep_{c}" for c in keep)

    def decode(cut: pa.RecordBatch) -> pa.RecordBatch:
        kept = pa.array([x.as_py().decode("utf-8", "ignore") for x in cut.column("kept")], pa.string())
        return pa.RecordBatch.from_arrays([cut.column("doc_id"), kept, *(cut.column(c) for c in held)], ["doc_id", "text", *held])

    kinds = dict(docs.dtypes)
    found = _removed(plain, length, gram, held, "doc_id long, text string", decode)
    out = found.toDF("doc_id", "text", *keep)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(kinds["n_chars"]))
    return out.select(*docs.columns)


def _cut(block: B.Block, gone: np.ndarray) -> pa.RecordBatch:
    n = len(block.doc_ids)
    sizes = np.diff(block.starts)
    doc = np.repeat(np.arange(n, dtype=np.int32), sizes)
    removed = np.bincount(doc[gone], minlength=n)
    opens = gone.copy()
    opens[1:] &= ~gone[:-1] | (doc[1:] != doc[:-1])
    spans = np.bincount(doc[opens], minlength=n)
    kept = [(block.text(k) if not removed[k] else block.body[a:b][~gone[a:b]].tobytes()) for k, (a, b) in enumerate(zip(block.starts[:-1], block.starts[1:], strict=True))]
    ids = block.doc_ids
    columns = [pa.array(ids, mask=ids == B.NO_ID), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(kept, pa.binary())]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    if block.rest is not None:
        columns, names = [*columns, *block.rest.columns], [*names, *block.rest.schema.names]
    return pa.RecordBatch.from_arrays(columns, names)
