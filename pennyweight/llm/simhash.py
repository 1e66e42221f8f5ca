"""SimHash near-duplicates by multi-index hashing.

A fingerprint is the bitwise majority of its shingles' XXH64 values.  To
link fingerprints at most ``radius`` bits apart, the 64 bits are cut into
segments, each with a small radius, such that any linked pair is within
the small radius in at least one segment (the radii plus one add up to
more than ``radius``).  Each fingerprint goes into the table of each
segment under its own value and probes the values of the Hamming ball
around it; what meets there is verified by its complete distance.

Only distinct fingerprints take part, so exact copies cost nothing.
Records travel packed: a map task sends one row to each shard, with all
its fingerprints for it.  A shard reports a spanning forest of the links
that it found, never all pairs of a group, which keeps components whole.

Defined results: a null or wordless text has fingerprint zero and is
linked like any other; repeated rows and ids stay as they are; an empty
table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, mix64, ranges, texts
from .graph import components

SEED = 42
#: Shift, width and small radius of each segment, for links at 2 bits or fewer.
SEGMENTS = ((0, 32, 1), (32, 32, 0))
#: Pairs compared at once in a shard.
CHUNK = 1 << 21


def shingles(text: str, width: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words, lower-cased (A-Z), joined by one space, and the shingles' bounds there."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(words)
    if not words:
        return joined, np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    width = min(width, len(words))
    return joined, starts[: len(words) - width + 1], ends[width - 1 :]


def shingle_hashes(text: str, width: int) -> np.ndarray:
    joined, starts, ends = shingles(text, width)
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts)
    )


def majority(hashes: np.ndarray) -> int:
    """Each bit is set if it is set in over half the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``(doc_id, fp)``: the fingerprint as a signed long with the same bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([majority(shingle_hashes(t.as_py(), width)) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def _masks(width: int, radius: int) -> np.ndarray:
    """All masks of ``width`` bits with at most ``radius`` set, the empty one first."""
    out = [0]
    for r in range(1, radius + 1):
        out += [sum(1 << k for k in bits) for bits in combinations(range(width), r)]
    return np.array(out, np.uint64)


def _records(fps: np.ndarray, segments: tuple) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys, fingerprints and whether they are probes, for tables and balls."""
    for k, (shift, width, small) in enumerate(segments):
        part = (fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        tag = np.uint64(k) << np.uint64(58)
        yield part | tag, fps, np.zeros(len(fps), bool)
        if small == 1:
            # of two values one bit apart, one has the bit set: that one probes
            for bit in range(width):
                flip = np.uint64(1 << bit)
                on = (part & flip) != 0
                yield (part[on] ^ flip) | tag, fps[on], np.ones(int(on.sum()), bool)
        elif small > 1:
            for mask in _masks(width, small)[1:]:
                yield (part ^ mask) | tag, fps, np.ones(len(fps), bool)


def _unite(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the components of ``a[i]`` and ``b[i]``; labels point to least members."""
    while True:
        la, lb = labels[a], labels[b]
        least = np.minimum(la, lb)
        if np.array_equal(la, lb):
            return
        np.minimum.at(labels, la, least)
        np.minimum.at(labels, lb, least)
        while not np.array_equal(up := labels[labels], labels):
            labels[:] = up


def _pairs_by_mask(table: np.ndarray, asks: np.ndarray, shift: int, width: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Fingerprints of a crowded group within ``radius``, by look-ups of the remaining bits.

    Linear in the group for a fixed radius, where comparing all would be square.
    Probes differ from the table inside the segment too, so the complete distance is checked.
    """
    inside = np.uint64(((1 << width) - 1) << shift)
    rest = [k for k in range(64) if not (shift <= k < shift + width)]
    order = np.argsort(table & ~inside, kind="stable")
    keys = (table & ~inside)[order]
    for mask in _masks(len(rest), radius):
        spread = np.uint64(sum(1 << rest[k] for k in range(len(rest)) if int(mask) >> k & 1))
        wanted = (asks & ~inside) ^ spread
        at = np.searchsorted(keys, wanted)
        hit = at < len(keys)
        hit[hit] = keys[at[hit]] == wanted[hit]
        a, b = asks[hit], table[order[at[hit]]]
        near = np.bitwise_count(a ^ b) <= radius
        yield a[near], b[near]


def _group_links(keys: np.ndarray, fps: np.ndarray, probes: np.ndarray, segments: tuple, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified links between records of one shard that meet under a key."""
    order = np.lexsort((fps, probes, keys))
    keys, fps, probes = keys[order], fps[order], probes[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    ends = np.r_[starts[1:], len(keys)]
    members = np.add.reduceat(~probes, starts) if len(starts) else np.zeros(0, np.int64)
    crowded = members > 4096
    for s, e, n in zip(starts[crowded], ends[crowded], members[crowded], strict=True):
        shift, width, small = segments[int(keys[s] >> np.uint64(58))]
        if comb(64 - width + radius, radius) < n:
            yield from _pairs_by_mask(fps[s : s + n], fps[s:e], shift, width, radius)
        else:
            crowded[np.searchsorted(starts, s)] = False
    calm = ~crowded & (members > 0) & (ends - starts > 1)
    s, e, n = starts[calm], ends[calm], members[calm].astype(np.int64)
    # each record is compared with the table members that stand before it in its group
    first = np.repeat(s, e - s)
    rows = ranges(s, e - s)
    before = np.minimum(rows - first, np.repeat(n, e - s))
    edges = np.r_[0, np.cumsum(before)]
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + CHUNK, side="right")) - 1)
        a = np.repeat(rows[at:to], before[at:to])
        b = ranges(first[at:to], before[at:to])
        near = np.bitwise_count(fps[a] ^ fps[b]) <= radius
        yield fps[a[near]], fps[b[near]]
        at = to


def _forest(keys: np.ndarray, fps: np.ndarray, probes: np.ndarray, segments: tuple, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A star of links for each local component."""
    nodes = np.unique(fps)
    labels = np.arange(len(nodes))
    for a, b in _group_links(keys, fps, probes, segments, radius):
        if len(a):
            _unite(labels, np.searchsorted(nodes, a), np.searchsorted(nodes, b))
    far = labels != np.arange(len(nodes))
    return nodes[far], nodes[labels[far]]


def links(distinct: DataFrame, count: int, radius: int = 2, segments: tuple = SEGMENTS, per_shard: int = 1 << 18) -> DataFrame:
    """Edges ``(a, b)`` that connect all of ``distinct`` (column ``fp``) at most ``radius`` bits apart.

    ``count`` is the number of rows; shards hold about ``per_shard`` records.
    """
    if sum(small + 1 for *_, small in segments) <= radius:
        raise ValueError("the segments' radii leave pairs at this distance unseen")
    balls = sum(1 + (width / 2 if small == 1 else len(_masks(width, small)) - 1 if small else 0) for _, width, small in segments)
    shards = max(1, int(count * balls / per_shard))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            found = list(_records(fps, segments))
            keys, who, probes = (np.concatenate(x) for x in zip(*found, strict=True))
            shard = (mix64(keys) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            keys, who, probes = keys[order], who[order], probes[order]
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            full = np.flatnonzero(np.diff(cuts))
            pack = lambda x: [x[cuts[k] : cuts[k + 1]].tobytes() for k in full]
            yield pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int64()), *(pa.array(pack(x), pa.binary()) for x in (keys, who, probes))], ["shard", "keys", "fps", "probes"]
            )

    def meet(table: pa.Table) -> pa.Table:
        join = lambda name, kind: np.frombuffer(b"".join(x.as_py() for x in table.column(name)), kind)
        a, b = _forest(join("keys", np.uint64), join("fps", np.uint64), join("probes", np.bool_), segments, radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    sent = distinct.select("fp").mapInArrow(send, "shard long, keys binary, fps binary, probes binary")
    return sent.groupBy("shard").applyInArrow(meet, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, segments: tuple = SEGMENTS) -> DataFrame:
    """``(doc_id, fp, component_id)``: the smallest ``doc_id`` that links reach from each document."""
    prints = materialise(fingerprints(docs, width), "prints")
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    found = components(links(classes, classes.count(), radius, segments))
    joined = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    heads = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    members = joined.join(heads, "component").select("fp", "component_id")
    return prints.join(members, "fp").select("doc_id", "fp", "component_id")
