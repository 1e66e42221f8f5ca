"""Groups of near-duplicate texts: SimHash by multi-index hashing, with an exact way for the rest.

Texts are alike if their sets of five-word shingles have a Jaccard
similarity of at least 0.8; groups are what such links connect.

1.  Equal texts become one node, the row of least ``doc_id``.
2.  Each node's SimHash is cut into segments; it goes into the table of
    every segment and probes the Hamming ball of radius one around it.
    What meets is checked by a complete distance of further bits, a strict
    one, then by the exact similarity.  Crowded buckets report a star, a
    pair per member.  This connects most groups, and may miss pairs near
    the threshold: it is a shortcut that keeps the next step small.
3.  The exact way finds what is left.  All texts order their shingles
    alike, by an estimated count, the rarest first.  Sets of similarity 0.8
    share one of their first fifth (prefix filter), and where they first
    meet, what follows must be enough to get there (positional filter), so
    the members of a large family whose own shingles set them apart are
    no candidates of each other.  Pairs already connected are left out;
    no fingerprint is looked at.
    A crowded bucket compares its centres in rounds, 8 at first, then
    eight times as many, with all members; centres are the members with the
    fewest rare shingles, so families collapse to one label early and
    later rounds have little left.  It ends when no bucket holds an open pair,
    so no link between different texts is lost.

The order of shingles comes from a sketch of fixed size.  It decides how
many candidates there are, never which pairs are linked.

Defined results: a null text is empty and a text like any other; texts
without words are alike; texts of fewer than five words have the whole
sequence as their only shingle; documents without an id come last; of
repeated rows one stays; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import simhash
from .blocks import by_shard
from .common import delete, made_since, materialise, mix64, pack_uint, ranges, release, settled, unpack_uint
from .graph import components
from .shingles import Sketch, classes_of_counts, each_set, flat, rarest_first

WIDTH, SIMILARITY = 5, 0.8
#: Segments and their bits; of 128 further bits, so many may differ in the tables.  At similarity 0.8 they are
#: 19 +- 4, at 0.9 13 +- 3, at 0.66 27 +- 5: strict, because what the tables leave out is found by the prefixes.
SEGMENTS, BITS, FURTHER = 8, 24, 22
WORDS = SEGMENTS * BITS // 64 + 2
#: Buckets up to this size list their pairs; larger ones report stars of centres.
CROWDED = 16
FIRST_CENTRES, MORE_CENTRES = 8, 8
SHARD_RECORDS = 1 << 20
#: Records that a task gathers before it sends, and pairs compared at once.
GATHERED, AT_ONCE = 1 << 18, 1 << 20

NODE = "_near_node"
_SENT = "shard long, tokens binary, probes binary, doc binary, places binary, refs binary, labels binary, sizes binary, further binary"


def distinct(docs: DataFrame) -> DataFrame:
    """The row of least ``doc_id`` of each different text, and its number ``NODE``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hashed = docs.withColumn("_near_text", text).withColumn("_near_hash", F.xxhash64("_near_text"))
    first = W.partitionBy("_near_hash", "_near_text").orderBy(F.col("doc_id").isNull(), "doc_id")
    heads = hashed.withColumn("_near_rank", F.row_number().over(first)).where("_near_rank = 1")
    return materialise(heads.drop("_near_text", "_near_hash", "_near_rank").withColumn(NODE, F.monotonically_increasing_id()), "distinct")


def _texts(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col(NODE).alias("ref"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def prints(nodes: DataFrame, width: int = WIDTH) -> tuple[DataFrame, np.ndarray]:
    """``ref, fp, n``: fingerprints and set sizes; and the steps of the sketch of all shingles."""
    salts = [np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64)) for k in range(WORDS)]
    parts = 32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # of what earlier stages remember, too
        sketch, schema = Sketch(), pa.schema([("ref", pa.int64()), ("fp", pa.binary()), ("n", pa.int32()), ("part", pa.int32())])
        for batch in batches:
            for refs, bags in each_set(batch, 0, 1, width):
                sketch.add(np.concatenate(bags))
                fps = [b"".join(int(simhash.majority(mix64(bag + s))).to_bytes(8, "little") for s in salts) for bag in bags]
                yield pa.RecordBatch.from_arrays([pa.array(refs), pa.array(fps), pa.array([len(b) for b in bags], pa.int32()), pa.nulls(len(refs), pa.int32())], schema=schema)
        counts = [pack_uint(x.astype(np.uint64)) for x in np.split(sketch.rows.ravel(), parts)]
        yield pa.RecordBatch.from_arrays([pa.nulls(parts, pa.int64()), pa.array(counts), pa.nulls(parts, pa.int32()), pa.array(range(parts), pa.int32())], schema=schema)
        release()

    def add(table: pa.Table) -> pa.Table:
        total = sum(unpack_uint(x.as_py()).astype(np.int64) for x in table.column("fp"))
        steps = classes_of_counts(total)
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "steps": pa.array([steps.tobytes()])})

    found = materialise(_texts(nodes).mapInArrow(run, "ref long, fp binary, n int, part int"), "prints")
    sums = found.where("part IS NOT NULL").groupBy("part").applyInArrow(add, "part int, steps binary")
    rows = sorted(sums.collect(), key=lambda r: r["part"])  # two million bytes, whatever the input
    steps = np.concatenate([np.frombuffer(r["steps"], np.uint8) for r in rows]) if rows else np.zeros(2 << Sketch.BITS, np.uint8)
    return found.where("ref IS NOT NULL").select("ref", "fp", "n"), steps.reshape(2, -1)


class _Outbox:
    """Records on their way to shards: one packed row for each shard, once enough have gathered."""

    def __init__(self, shards: int):
        self.shards, self.enough = shards, min(max(GATHERED, 64 * shards), 1 << 24)
        self.held: list[tuple[np.ndarray, ...]] = []
        self.docs: list[tuple[np.ndarray, ...]] = []
        self.n = self.n_docs = 0

    def put(self, tokens: np.ndarray, rows: np.ndarray, places: np.ndarray, probes: np.ndarray, docs: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        """``rows`` number the columns of ``docs``: refs, labels, set sizes, further bits."""
        self.held.append((tokens, rows + self.n_docs, places, probes))
        self.docs.append(docs)
        self.n, self.n_docs = self.n + len(tokens), self.n_docs + len(docs[0])
        if self.n >= self.enough:
            yield from self.sent()

    def sent(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        tokens, rows, places, probes = (np.concatenate(x) for x in zip(*self.held, strict=True))
        refs, labels, sizes, further = (np.concatenate(x) for x in zip(*self.docs, strict=True))
        self.held, self.docs, self.n, self.n_docs = [], [], 0, 0
        out: dict[str, list] = {c.split()[0]: [] for c in _SENT.split(", ")}
        shard = (mix64(tokens) % np.uint64(self.shards)).astype(np.int64)
        for k, mine in by_shard(shard, self.shards):
            some, place = np.unique(rows[mine], return_inverse=True)
            low = tokens[mine].astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]
            packed = {
                "shard": k, "tokens": low.tobytes(), "probes": np.packbits(probes[mine]).tobytes(),
                "doc": pack_uint(place.astype(np.uint64)), "places": pack_uint(places[mine].astype(np.uint64)), "refs": refs[some].tobytes(),
                "labels": (labels[some] ^ refs[some]).tobytes(), "sizes": pack_uint(sizes[some].astype(np.uint64)), "further": further[some].tobytes(),
            }
            for name, value in packed.items():
                out[name].append(value)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if n == "shard" else pa.binary()) for n, v in out.items()], list(out))


class _Met:
    """The records of a shard in buckets of equal tokens; of a bucket, those that may be centres stand first."""

    def __init__(self, table: pa.Table):
        rows = table.to_pylist()
        doc = [unpack_uint(r["doc"]).astype(np.int64) for r in rows]
        each = lambda name, kind: np.concatenate([np.frombuffer(r[name], kind)[d] for r, d in zip(rows, doc, strict=True)])
        raw = np.zeros((sum(map(len, doc)), 8), np.uint8)
        raw[:, :6] = np.concatenate([np.frombuffer(r["tokens"], np.uint8) for r in rows]).reshape(-1, 6)
        tokens = raw.view("<u8").ravel()
        later = np.concatenate([np.unpackbits(np.frombuffer(r["probes"], np.uint8), count=len(d)) for r, d in zip(rows, doc, strict=True)]).astype(bool)
        place = np.concatenate([unpack_uint(r["places"]).astype(np.int64) for r in rows])
        refs = each("refs", np.int64)
        order = np.lexsort((refs, place, later, tokens))
        self.refs, later, tokens = refs[order], later[order], tokens[order]
        self.labels = (each("labels", np.int64) ^ refs)[order]
        self.sizes = np.concatenate([unpack_uint(r["sizes"]).astype(np.int64)[d] for r, d in zip(rows, doc, strict=True)])[order]
        self.left = self.sizes - place[order]
        bits = [np.frombuffer(r["further"], "<u8").reshape(len(np.frombuffer(r["refs"], np.int64)), -1)[d] for r, d in zip(rows, doc, strict=True)]
        self.further = np.concatenate(bits)[order]
        self.starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        self.n = np.diff(np.r_[self.starts, len(tokens)])
        self.centres = np.add.reduceat((~later).astype(np.int64), self.starts)
        self.out: list[np.ndarray] = []

    def open(self, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
        """Which pairs may reach the similarity, and are not connected yet."""
        x, y = self.sizes[a], self.sizes[b]
        may = (self.labels[a] != self.labels[b]) & (np.minimum(x, y) >= similarity * np.maximum(x, y) - 1e-6)
        return may & ((1 + similarity) * np.minimum(self.left[a], self.left[b]) >= similarity * (x + y) - 1e-6)

    def near(self, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
        """Which of the open pairs differ in few of the further bits."""
        return self.open(a, b, similarity) & (np.bitwise_count(self.further[a] ^ self.further[b]).sum(axis=1) <= FURTHER)

    def pairs(self, which: np.ndarray, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """In some buckets, centres from ``low`` up to ``high`` with every member after them."""
        to = np.minimum(self.centres[which], high)
        many = np.maximum(0, to - low)
        first = ranges(self.starts[which] + low, many)
        after = np.repeat(self.starts[which] + self.n[which], many) - first - 1
        edges, at = np.r_[0, np.cumsum(after)], 0
        while at < len(first):
            upto = max(at + 1, int(np.searchsorted(edges, edges[at] + AT_ONCE, side="right")) - 1)
            yield np.repeat(first[at:upto], after[at:upto]), ranges(first[at:upto] + 1, after[at:upto])
            at = upto

    def report(self, a: np.ndarray, b: np.ndarray) -> None:
        pair = np.stack([np.minimum(self.refs[a], self.refs[b]), np.maximum(self.refs[a], self.refs[b])], axis=1)
        self.out.append(np.unique(pair, axis=0))

    def table(self) -> pa.Table:
        found = np.concatenate(self.out) if self.out else np.zeros((0, 2), np.int64)
        found = np.unique(found, axis=0)
        release()
        return pa.table({"a": found[:, 0], "b": found[:, 1]})


def _keys(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Keys of table entries and probes, and the rows they are of.

    Of two values one bit apart, one has the bit set: only that one probes.
    """
    rows = np.arange(len(fps))
    bits = np.unpackbits(fps.view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")
    weights = (1 << np.arange(BITS)).astype(np.uint64)
    for s in range(SEGMENTS):
        mine = bits[:, s * BITS : (s + 1) * BITS]
        value = (mine * weights).sum(axis=1, dtype=np.uint64) | np.uint64(s << BITS)
        yield value, rows, False
        for b in range(BITS):
            on = np.flatnonzero(mine[:, b])
            yield value[on] ^ np.uint64(1 << b), on, True


def by_tables(known: DataFrame, count: int, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs ``a, b`` that meet in a segment's table: all of calm buckets, a star of crowded ones."""
    shards = max(1, int(count * SEGMENTS * (1 + BITS / 2) / SHARD_RECORDS))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = _Outbox(shards)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                refs = batch.column(0).to_numpy(zero_copy_only=False)
                fps = np.stack([np.frombuffer(x.as_py(), "<u8") for x in batch.column(1)])
                found = list(_keys(fps))
                keys, rows = (np.concatenate([x[k] for x in found]) for k in (0, 1))
                probes = np.repeat([x[2] for x in found], [len(x[0]) for x in found])
                sizes = batch.column(2).to_numpy(zero_copy_only=False)
                # keys travel without their two lowest bytes, so these are the ones that a hash makes of them
                yield from box.put(mix64(keys), rows, np.zeros(len(rows), np.int64), probes, (refs, refs, sizes, fps[:, -2:]))
        yield from box.sent()
        release()

    def meet(table: pa.Table) -> pa.Table:
        met = _Met(table)
        some = met.centres > 0
        crowded = some & (met.n > CROWDED)
        # the same rule in all buckets, so that a group's stars mostly share their middle
        for s, n, m in zip(met.starts[crowded], met.n[crowded], met.centres[crowded], strict=True):
            centre = s + int(np.argmin(mix64(met.refs[s : s + m].astype(np.uint64))))
            others = np.arange(s, s + n)
            others = others[others != centre]
            a = np.full(len(others), centre)
            good = met.near(a, others, similarity)
            met.report(a[good], others[good])
        for a, b in met.pairs(np.flatnonzero(some & ~crowded & (met.n > 1)), 0, CROWDED):
            good = met.near(a, b, similarity)
            met.report(a[good], b[good])
        return met.table()

    return known.select("ref", "fp", "n").mapInArrow(send, _SENT).groupBy("shard").applyInArrow(meet, "a long, b long").distinct()


def firsts(nodes: DataFrame, steps: np.ndarray, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """``ref, n, tokens``: each text's rarest shingles, one of which it shares with every text of that similarity; set size ``n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for refs, bags in each_set(batch, 0, 1, width):
                some = [rarest_first(b, steps, int(len(b) - np.ceil(similarity * len(b) - 1e-6)) + 1).astype("<u8").tobytes() for b in bags]
                yield pa.RecordBatch.from_arrays([pa.array(refs, pa.int64()), pa.array([len(b) for b in bags], pa.int64()), pa.array(some, pa.binary())], ["ref", "n", "tokens"])
        release()

    return _texts(nodes).mapInArrow(run, "ref long, n long, tokens binary")


def by_prefixes(rare: DataFrame, labels: DataFrame, records: int, low: int, high: int, similarity: float = SIMILARITY) -> DataFrame:
    """Open pairs of texts that first meet in a rare shingle.  ``rare``: of :func:`firsts`; ``labels``: ``ref, label``.

    Crowded buckets compare centres from ``low`` up to ``high``; calm ones
    all members, in the first round only.  A loop ``a, a`` marks a member of
    a bucket with open pairs beyond ``high``.
    """
    shards = max(1, records // SHARD_RECORDS)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = _Outbox(shards)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                refs, sizes, held, labelled = whole.slice(at, 1024).columns
                refs, sizes, labelled = (c.to_numpy(zero_copy_only=False) for c in (refs, sizes, labelled))
                tokens, many = flat([np.frombuffer(x.as_py(), "<u8") for x in held])
                rows, places = np.repeat(np.arange(len(refs)), many), ranges(np.zeros(len(refs), np.int64), many)
                # two similar sets meet where the smaller has enough left to reach the similarity with its like
                late = (1 + similarity) * (sizes[rows] - places) < 2 * similarity * sizes[rows] - 1e-6
                yield from box.put(tokens, rows, places, late, (refs, labelled, sizes, np.zeros((len(refs), 0), np.uint64)))
        yield from box.sent()
        release()

    def meet(table: pa.Table) -> pa.Table:
        met = _Met(table)
        many = (met.centres > 0) & (met.n > 1)
        mixed = many & (np.minimum.reduceat(met.labels, met.starts) != np.maximum.reduceat(met.labels, met.starts))
        crowded = mixed & (met.n > CROWDED)
        if not low:
            for a, b in met.pairs(np.flatnonzero(mixed & ~crowded), 0, CROWDED):
                good = met.open(a, b, similarity)
                met.report(a[good], b[good])
        for a, b in met.pairs(np.flatnonzero(crowded), low, high):
            good = met.open(a, b, similarity)
            met.report(a[good], b[good])
        for k in np.flatnonzero(crowded & (met.centres > high)):
            looked = 0
            for a, b in met.pairs(np.array([k]), high, int(met.centres[k])):
                looked += len(a)
                if looked > AT_ONCE * 16 or met.open(a, b, similarity).any():
                    members = np.arange(met.starts[k], met.starts[k] + met.n[k])
                    met.report(members, members)
                    break
        return met.table()

    return rare.join(labels, "ref").select("ref", "n", "tokens", "label").mapInArrow(send, _SENT).groupBy("shard").applyInArrow(meet, "a long, b long").distinct()


def verified(pairs: DataFrame, nodes: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs whose shingle sets have a Jaccard similarity of at least ``similarity``."""
    ends = materialise(pairs.select(F.explode(F.array("a", "b")).alias("ref")).distinct(), "ends")

    def bags_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for refs, bags in each_set(batch, 0, 1, width):
                yield pa.RecordBatch.from_arrays([pa.array(refs, pa.int64()), pa.array([b.tobytes() for b in bags], pa.binary())], ["ref", "bag"])
        release()

    bags = materialise(_texts(nodes).join(ends, "ref", "left_semi").mapInArrow(bags_of, "ref long, bag binary"), "bags")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append((1 + similarity) * both >= similarity * (len(x) + len(y)) - 1e-6)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))
        release()

    x = bags.select(F.col("ref").alias("a"), F.col("bag").alias("x"))
    y = bags.select(F.col("ref").alias("b"), F.col("bag").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(judge, "a long, b long")


def links(nodes: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """``node, component`` of every node that is linked to another."""
    known, steps = prints(nodes, width)
    sums = known.agg(F.count("*").alias("n"), F.sum("n").alias("members")).first()
    records = int((sums["members"] or 0) * (1 - similarity)) + sums["n"]
    check = lambda pairs: verified(pairs, nodes, width, similarity)
    found = settled(lambda: check(materialise(by_tables(known, sums["n"], similarity), "met")), "links")
    joined = settled(lambda: components(found), "joined")
    rare = materialise(firsts(nodes, steps, width, similarity), "firsts")
    some, low, high = known.select("ref"), 0, FIRST_CENTRES
    while True:
        mark = len(made_since(0))
        label = F.coalesce("component", "ref").alias("label")
        labels = materialise(some.join(joined.withColumnRenamed("node", "ref"), "ref", "left").select("ref", label), "labels")
        met = materialise(by_prefixes(rare, labels, records, low, high, similarity), "met")
        over = made_since(mark)
        pairs = met.where("a <> b")
        if pairs.take(1):
            found = found.union(settled(lambda: check(pairs), "links"))  # noqa: B023
            joined = settled(lambda: components(found), "joined")  # noqa: B023
        crowd = met.where("a = b").select(F.col("a").alias("ref"))
        left = crowd.count()
        if not left:
            return joined
        some, low, high = materialise(labels.join(crowd, "ref", "left_semi").select("ref"), "crowd"), high, high * MORE_CENTRES
        records = max(1, records * left // max(1, sums["n"]))
        delete(nodes.sparkSession, over)


def keep_one(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """The document of least ``doc_id`` of each group, with its own columns."""
    own = docs.columns
    # whatever the other columns are called, they don't meet names used here
    nodes = distinct(docs.toDF(*(c if c in ("doc_id", "text") else f"_own{k}" for k, c in enumerate(own))))
    joined = settled(lambda: links(nodes, width, similarity), "joined")
    members = nodes.select(NODE, "doc_id").join(joined, F.col(NODE) == F.col("node")).select("node", "component", "doc_id")
    heads = members.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node"))["node"].alias("node"))
    # those that go are fewer than those that stay
    gone = materialise(joined.select("node").join(heads.select("node"), "node", "left_anti").withColumnRenamed("node", NODE), "gone")
    return nodes.join(gone, NODE, "left_anti").drop(NODE).toDF(*own)
