"""Exact top-k inner products by KD-trees per shard.

Vectors are dealt to shards by a hash of their id.  A shard splits its
vectors at medians of the widest dimension, down to leaves, and keeps a tight
box for every node.  Queries come in blocks; a box bounds a query's inner
products from above.  Going down the tree, a node's bound is worked out only
for the queries whose kth result its parent can still beat; the leaves that
are left are visited best bound first, until no bound can beat the kth result.
That kth result starts from one shard searched beforehand, and goes on from
shard to shard within a task.

A task takes a few shards and one block of queries, both of bounded size, so
that its memory is bounded and each side is sent once for many of the other.

Components become integers, ``floor(256 x)``.  Vectors whose integers
are small enough for doubles to hold every inner product exactly go the way
above.  The others, if there are any, are compared as unbounded integers,
ranked by them, and their scores shown as the nearest long.

Defined results: a vector that is null or holds a null or non-finite
component takes no part; shorter vectors are padded with zeros; rows with
the query's own id are no candidates of it; an id that is a query several
times counts once; fewer than k candidates give fewer rows; an empty table
gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

K = 5
LEAF = 128
SHARD_ROWS = 8192
QUERY_ROWS = 4096
#: Shards that meet a query block in one task.
TOGETHER = 4
SCALE = 256.0
#: Inner products of integers up to ``2**22`` in 512 dimensions are below ``2**53``.
SMALL = 1 << 22
LONG = 1 << 63

FOUND = "query_id long, vec_id long, score long, wide string"
_PACKED = "size int, ids binary, body binary"
_NONE = np.iinfo(np.int64).max


def usable(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``vec_id, v`` with ``v`` as doubles, without the vectors that take no part."""
    v = F.col(column).cast("array<double>")
    whole = v.isNotNull() & F.forall(v, lambda x: F.coalesce((x > float("-inf")) & (x < float("inf")) & ~F.isnan(x), F.lit(False)))
    return vectors.where(whole & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("vec_id"), v.cast("array<float>" if dict(vectors.dtypes)[column] == "array<float>" else "array<double>").alias("v"))


def _pack(table: pa.Table) -> dict:
    rows = [np.asarray(x, np.float64) for x in table.column("v").to_pylist()]
    width = max(map(len, rows), default=0)
    out = np.zeros((len(rows), width))
    for k, row in enumerate(rows):
        out[k, : len(row)] = row
    return {"size": width, "ids": table.column("vec_id").to_numpy().astype("<i8").tobytes(), "body": out.tobytes()}


def _unpack(row: dict, width: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], "<i8")
    out = np.zeros((len(ids), width))
    out[:, : row["size"]] = np.frombuffer(row["body"]).reshape(len(ids), row["size"])
    return ids, out


def _parted(ids: np.ndarray, body: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, list[list[int]]]]:
    """Vectors of small integers as doubles, and the others as Python integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(SCALE * body)
    small = (np.abs(scaled) <= SMALL).all(axis=1)
    if body.shape[1] > 512:
        small[:] = False
    # a double from 2**53 on is an integer itself
    large = [[math.floor(SCALE * x) if abs(x) < 2.0**53 else int(x) * int(SCALE) for x in row] for row in body[~small].tolist()]
    return (ids[small], scaled[small]), (ids[~small], large)


class Tree:
    """A KD-tree in rows: nodes by level with boxes and least ids; leaves are ranges of the rows."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        order, todo = np.arange(len(ids)), [(0, len(ids), -1)]
        self.cuts, self.parent = [], []
        for a, b, up in todo:  # breadth first: parents before children
            self.cuts.append((a, b))
            self.parent.append(up)
            if b - a > leaf:
                part = points[order[a:b]]
                spread = part.max(axis=0) - part.min(axis=0)
                middle = (b - a) // 2
                if spread.max(initial=0) > 0:
                    order[a:b] = order[a:b][np.argpartition(part[:, int(spread.argmax())], middle)]
                else:  # all alike: by id, so the leaves with smaller ids win ties early
                    order[a:b] = order[a:b][np.argsort(ids[order[a:b]], kind="stable")]
                me = len(self.cuts) - 1
                todo += [(a, a + middle, me), (a + middle, b, me)]
        self.ids, self.points = ids[order], points[order]
        box = lambda pick, what: np.array([pick(what[a:b], axis=0) for a, b in self.cuts])
        self.low, self.high, self.least_id = box(np.min, self.points), box(np.max, self.points), box(np.min, self.ids)
        self.leaf = np.array([b - a <= leaf for a, b in self.cuts])

    def bounds(self, queries: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaves, and each query's bound for them; minus infinity below a node that cannot beat the query's limit."""
        plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
        found = np.full((len(self.cuts), len(queries)), -np.inf)
        for k, up in enumerate(self.parent):
            may = np.arange(len(queries)) if up < 0 else np.flatnonzero(found[up] >= limit)
            some = slice(None) if len(may) == len(queries) else may
            if len(may):
                found[k, some] = plus[some] @ self.high[k] + minus[some] @ self.low[k]
        at = np.flatnonzero(self.leaf)
        return at, found[at].T


class Best:
    """The best ``k`` of each query so far, and the score and id that a candidate must beat."""

    def __init__(self, n: int, k: int, limit: np.ndarray | None = None, limit_id: np.ndarray | None = None):
        self.k = k
        self.scores, self.ids = np.full((n, k), -np.inf), np.full((n, k), _NONE)
        self.limit = np.full(n, -np.inf) if limit is None else limit.astype(np.float64)
        self.limit_id = np.full(n, _NONE) if limit_id is None else limit_id.copy()

    def offer(self, who: np.ndarray, got: np.ndarray, ids: np.ndarray) -> None:
        scores = np.concatenate([self.scores[who], got], axis=1)
        all_ids = np.concatenate([self.ids[who], np.broadcast_to(ids, got.shape)], axis=1)
        all_ids[scores == -np.inf] = _NONE
        best = np.lexsort((all_ids, -scores), axis=1)[:, : self.k]
        self.scores[who], self.ids[who] = np.take_along_axis(scores, best, 1), np.take_along_axis(all_ids, best, 1)
        s, i = self.scores[who, -1], self.ids[who, -1]
        better = (s > self.limit[who]) | ((s == self.limit[who]) & (i < self.limit_id[who]))
        self.limit[who[better]], self.limit_id[who[better]] = s[better], i[better]


def search(tree: Tree, ids: np.ndarray, queries: np.ndarray, best: Best) -> None:
    """Offer the tree's points to the queries, leaves of the best bound first."""
    if not len(tree.ids) or not len(ids):
        return
    leaves, bounds = tree.bounds(queries, best.limit)
    visit = np.argsort(-bounds, axis=1, kind="stable")
    active = np.arange(len(ids))
    for turn in range(len(leaves)):
        at = visit[active, turn]
        bound = bounds[active, at]
        may = (bound >= best.limit[active]) & (bound > -np.inf)  # bounds only fall from here, so a query below its limit is done
        active, at, bound = active[may], at[may], bound[may]
        if not len(active):
            break
        look = (bound > best.limit[active]) | (tree.least_id[leaves[at]] <= best.limit_id[active])
        who, where = active[look], at[look]
        for x in np.unique(where):
            mine = who[where == x]
            a, b = tree.cuts[leaves[x]]
            got = queries[mine] @ tree.points[a:b].T
            got[ids[mine][:, None] == tree.ids[a:b][None]] = -np.inf
            best.offer(mine, got, tree.ids[a:b])


def _shown(score: int) -> int:
    return max(-LONG, min(LONG - 1, score))


def _wide(score: int) -> str:
    """A text whose order is that of the integers; inner products of doubles stay below it."""
    return f"{score + (1 << 2200):0555x}"


def _large_pairs(points: list[tuple[np.ndarray, list[list[int]]]], ids: np.ndarray, queries: list[list[int]], k: int) -> Iterator[tuple[int, int, int]]:
    """The best ``k`` of unbounded integers for each query."""
    for q, mine in zip(ids.tolist(), queries, strict=True):
        scored = [(-sum(map(int.__mul__, mine, p)), i) for who, rows in points for i, p in zip(who.tolist(), rows, strict=True) if i != q]
        for s, i in sorted(scored)[:k]:
            yield q, i, -s


def top_k(vectors: DataFrame, is_query: str, k: int = K, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows of ``vec_id, v`` that ``is_query`` selects."""
    vectors = materialise(vectors, "vectors")
    count = vectors.agg(F.count("*").alias("n"), F.count_if(F.expr(is_query)).alias("q")).first()
    shards, blocks = max(1, -(-count["n"] // shard_rows)), max(1, -(-count["q"] // query_rows))
    hands = -(-shards // TOGETHER)

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        row = {"group": key[0].as_py()} | _pack(table)
        return pa.Table.from_pylist([row], pa.schema([("group", pa.int64()), ("size", pa.int32()), ("ids", pa.binary()), ("body", pa.binary())]))

    def grouped(df: DataFrame, n: int) -> DataFrame:
        return df.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("long").alias("group")).applyInArrow(packed, f"group long, {_PACKED}")

    points = materialise(grouped(vectors, shards), "shards")
    asked = materialise(grouped(vectors.where(is_query).dropDuplicates(["vec_id"]), blocks), "queries")

    def find(mine: pa.Table, queries: pa.Table) -> tuple[np.ndarray, Best, list[tuple[int, int, int]]] | None:
        """The ids of the block's small queries with their best, and what unbounded integers give."""
        mine, queries = mine.to_pylist(), queries.to_pylist()
        if not mine or not queries:
            return None
        width = max(r["size"] for r in mine + queries)
        asks = queries[0]
        (ids, body), (large_ids, large) = _parted(*_unpack(asks, width))
        limits = [None, None]
        if asks.get("limits"):
            score, who = np.frombuffer(asks["limits"], "<i8").reshape(2, -1)
            limits = [np.where(who >= 0, score.astype(np.float64), -np.inf), np.where(who >= 0, who, _NONE)]
        best, wide = Best(len(ids), k, *limits), []
        plain: list[tuple[np.ndarray, list[list[int]]]] = []
        for r in sorted(mine, key=lambda r: r["group"]):
            (some, rows), others = _parted(*_unpack(r, width))
            search(Tree(some, rows) if len(some) else Tree(np.zeros(0, np.int64), np.zeros((0, width))), ids, body, best)
            if len(others[0]):
                wide += _large_pairs([others], ids, [[int(x) for x in row] for row in body.tolist()], k)
            if len(large_ids):
                plain += [others, (some, [[int(x) for x in row] for row in rows.tolist()])]
        wide += _large_pairs(plain, large_ids, large, k)
        return ids, best, wide

    def seed(key: tuple, mine: pa.Table, queries: pa.Table) -> pa.Table:
        rows, found = [], find(mine, queries)
        if found:
            _, best, _ = found
            full = best.ids[:, -1] != _NONE
            limits = np.stack([np.where(full, best.scores[:, -1], 0).astype("<i8"), np.where(full, best.ids[:, -1], -1).astype("<i8")])
            rows.append({"group": key[1].as_py(), "limits": limits.tobytes()})
        return pa.Table.from_pylist(rows, pa.schema([("group", pa.int64()), ("limits", pa.binary())]))

    def answer(key: tuple, mine: pa.Table, queries: pa.Table) -> pa.Table:
        found = find(mine, queries)
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("wide", pa.string())])
        if not found:
            return schema.empty_table()
        ids, best, wide = found
        there = best.ids != _NONE
        columns = [np.repeat(ids, there.sum(axis=1)), best.ids[there], best.scores[there].astype(np.int64)]
        plain = pa.Table.from_arrays([*map(pa.array, columns), pa.nulls(len(columns[0]), pa.string())], schema=schema)
        far = pa.Table.from_pylist([{"query_id": q, "vec_id": i, "score": _shown(s), "wide": _wide(s) if _shown(s) != s else None} for q, i, s in wide], schema)
        return pa.concat_tables([plain, far])

    def met(points: DataFrame, queries: DataFrame, some_hands: list[int] | None, task, schema: str) -> DataFrame:
        hand = F.pmod("group", F.lit(hands))
        left = points.withColumns({"hand": hand, "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>"))})
        each = F.array(*map(F.lit, some_hands)) if some_hands else F.sequence(F.lit(0), F.lit(hands - 1))
        right = queries.withColumn("hand", F.explode(each.cast("array<long>")))
        return left.groupBy("hand", "block").cogroup(right.groupBy("hand", "group")).applyInArrow(task, schema)

    first = points.agg(F.min("group").alias("g")).first()["g"] or 0
    limits = met(points.where(F.col("group") == F.lit(first)), asked, [first % hands], seed, "group long, limits binary")
    asked = asked.join(materialise(limits, "limits"), "group", "left")
    rows = met(points, asked, None, answer, FOUND)
    # scores beyond a long are ordered by their texts: those above it come first, those below it last
    beyond = F.when(F.col("wide").isNotNull() & (F.col("score") > 0), 1).when(F.col("wide").isNotNull(), -1).otherwise(0)
    order = W.partitionBy("query_id").orderBy(beyond.desc(), F.desc("score"), F.col("wide").desc(), "vec_id")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
