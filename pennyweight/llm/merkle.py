"""A Merkle manifest of a dataset: digests of rows, trees by language, and proofs.

Each row is a leaf.  Per language the leaves, ascending by ``doc_id``, are
hashed in runs of ``ARITY`` up to a subroot; subroots in order of language
(null first) are hashed likewise up to the root.

**Event-driven combining.**  A node that becomes known is an event: its
digest is put in its slot of the partial parent.  A parent whose slots are
as many as the size of its tree allows is complete, is hashed, and is an
event itself.  Tasks combine what they read (leaves lie in order, so
nearly all completes there); partial parents that are left, the frontier,
are shuffled by the block of ``ARITY ** LEVELS`` leaves they lie in and
combined again.  Blocks then stand for leaves, in rounds, up to one node a
tree.  **Reverse links** go the other way: a block hands down to the block
below each of its leaves the siblings from there to the root.

A task holds one block, its partial parents (at most ``HELD`` of them
before it passes them on) and the links of one block.

Defined results: every column may be null and has then the mark ``-`` in
the leaf; a null language is a tree of its own, before the empty one; a
null ``doc_id`` comes first in its tree; rows with the same ``doc_id`` are
leaves of their own, ordered by digest; a table of one row has its leaf as
root and empty proofs; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import materialise, release
from .ordering import numbered

ARITY = 2
#: Levels of a block: a task holds ``ARITY ** LEVELS`` nodes at most.
LEVELS = 12
#: Partial parents that a task holds before it passes them on.
HELD = 100_000
#: Rows of proofs made into one batch.
TOGETHER = 1024
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "struct<slot:int,others:array<string>>"
_typed = StructType.fromDDL
_NODE = "tree string, size long, level int, index long, digest string"


def H(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(**values: Column) -> Column:
    """The digest of a row; ``values`` take the place of its columns."""
    fields = []
    for name in FIELDS:
        text = values.get(name, F.col(name)).cast("string")
        fields.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*fields).cast("binary"), 256)


def width(size: int, level: int, arity: int) -> int:
    """Nodes of a tree at a level."""
    return -(-size // arity**level)


class Partials:
    """Partial parents: digests by slot until the arity that the tree's size gives is met."""

    def __init__(self, arity: int, top: int):
        self.arity, self.top = arity, top
        self.open: dict[tuple[str, int, int, int], dict[int, str]] = {}
        self.complete: list[tuple] = []  # nodes at the top level, or alone at theirs

    def event(self, tree: str, size: int, level: int, index: int, digest: str) -> None:
        while level < self.top and width(size, level, self.arity) > 1:
            parent, slot = divmod(index, self.arity)
            key = (tree, size, level, parent)
            due = min(self.arity, width(size, level, self.arity) - parent * self.arity)
            children = self.open.setdefault(key, {})
            children[slot] = digest
            if len(children) < due:
                return
            del self.open[key]
            digest = H(children[k] for k in range(due))
            level, index = level + 1, parent
        self.complete.append((tree, size, level, index, digest))

    def drain(self) -> list[tuple]:
        """The frontier: what is complete, and children that wait for their siblings."""
        out = self.complete + [(t, s, level, p * self.arity + slot, d) for (t, s, level, p), children in self.open.items() for slot, d in children.items()]
        self.open, self.complete = {}, []
        return out


def _nodes(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("tree", pa.string()), ("size", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("digest", pa.string()))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)], [n for n, _ in kinds])


def climb(nodes: DataFrame, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """The nodes ``levels`` above ``(tree, size, index, digest)``, in the same form; ``size`` counts them."""
    span = arity**levels

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Partials(arity, levels)
        for batch in batches:
            for node in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.event(*node)
                if len(held.open) > HELD or len(held.complete) > HELD:
                    yield _nodes(held.drain())
        yield _nodes(held.drain())
        release()

    def finish(table: pa.Table) -> pa.Table:
        held = Partials(arity, levels)
        for node in zip(*(table.column(n).to_pylist() for n in ("tree", "size", "level", "index", "digest")), strict=True):
            held.event(*node)
        if held.open:
            raise ValueError(f"a block lacks {len(held.open)} nodes")
        return pa.Table.from_batches([_nodes(held.complete)])

    some = nodes.select("tree", "size", F.lit(0).alias("level"), "index", "digest").mapInArrow(combine, _NODE)
    block = F.floor(F.col("index") / F.pow(F.lit(arity), F.lit(levels) - F.col("level"))).cast("long")
    merged = some.groupBy("tree", block.alias("block")).applyInArrow(finish, _NODE)
    small = F.col("size") <= span  # such a tree ends within its block
    size = F.when(small, 1).otherwise(F.expr(f"(size + {span - 1}) DIV {span}")).cast("long")
    return materialise(merged.select("tree", size.alias("size"), "index", "digest"), "climbed")


def _proof(rows: list[list[tuple[int, list[str]]]]) -> pa.Array:
    return pa.array([[{"slot": s, "others": o} for s, o in steps] for steps in rows], pa.list_(pa.struct([("slot", pa.int32()), ("others", pa.list_(pa.string()))])))


def descend(nodes: DataFrame, links: DataFrame, carry: tuple[str, ...] = (), arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """``(tree, index, steps, subroot, root)`` of each node, and its columns ``carry``.

    ``links`` has the same of the nodes ``levels`` above; each block gets the
    link of its top.
    """
    span = arity**levels
    schema = StructType([*_typed(f"tree string, index long, steps array<{_STEP}>, subroot string, root string"), *(nodes.schema[c] for c in carry)])
    names = ["tree", "index", "steps", "subroot", "root"]

    def down(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            raise ValueError("a link without its block")
        order = left.sort_by("index")
        tree, size = order.column("tree")[0].as_py(), order.column("size")[0].as_py()
        index, row = order.column("index").to_pylist(), order.column("digest").to_pylist()
        first = index[0]
        ((_, _, above, subroot, root),) = zip(*(right.column(n).to_pylist() for n in names), strict=True)
        above = [(s["slot"], s["others"]) for s in above]
        floors = [row]  # digests of the block by level
        while len(floors) <= levels and width(size, len(floors) - 1, arity) > 1:
            below = floors[-1]
            floors.append([H(below[k : k + arity]) for k in range(0, len(below), arity)])
        carried = [order.column(c).combine_chunks() for c in carry]
        out = []
        for start in range(0, len(row), TOGETHER):
            steps = []
            for k in range(start, min(len(row), start + TOGETHER)):
                path = []
                for nodes_ in floors[:-1]:
                    run = k - k % arity
                    path.append((k - run, nodes_[run:k] + nodes_[k + 1 : run + arity]))
                    k //= arity
                steps.append(path + above)
            n = len(steps)
            at = pa.array(range(first + start, first + start + n), pa.int64())
            out.append(pa.RecordBatch.from_arrays([pa.array([tree] * n, pa.string()), at, _proof(steps), pa.array([subroot] * n), pa.array([root] * n), *(c.slice(start, n) for c in carried)], [*names, *carry]))
        return pa.Table.from_batches(out)

    block = F.expr(f"index DIV {span}")
    left = nodes.select("tree", "size", "index", "digest", *(c for c in carry if c != "digest"), block.alias("block")).groupBy("tree", "block")
    right = links.select(*names, F.col("index").alias("block")).groupBy("tree", "block")
    return left.cogroup(right).applyInArrow(down, schema)


def _rounds(nodes: DataFrame, arity: int, levels: int) -> list[DataFrame]:
    """The nodes of each round, the last with one node a tree."""
    out = [nodes, climb(nodes, arity, levels)]
    while (out[-1].agg(F.max("size").alias("n")).first()["n"] or 0) > 1:
        out.append(climb(out[-1], arity, levels))
    return out


def _hand_down(rounds: list[DataFrame], links: DataFrame, carry: tuple[str, ...], arity: int, levels: int) -> DataFrame:
    """Links of the first round's nodes from those of the last."""
    for nodes in reversed(rounds[1:-1]):
        links = materialise(descend(nodes, links, (), arity, levels), "links")
    return descend(rounds[0], links, carry, arity, levels)


def manifest(docs: DataFrame, keep: tuple[str, ...] = (), arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """``(doc_id, leaf, steps, subroot, root)`` of each row, and columns ``keep``.

    ``steps`` is the proof, from the leaf to the root: the siblings at each
    level, left to right, and the slot among them that the node itself takes.
    """
    keep_as = {c: f"_keep{k}" for k, c in enumerate(keep)}
    # languages by name, so that null comes before the empty one and all sort bytewise
    tree = F.coalesce(F.concat(F.lit("l"), F.col("lang").cast("string")), F.lit(""))
    leaves = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), leaf().alias("digest"), *(F.col(c).alias(n) for c, n in keep_as.items())), "leaves")
    placed = numbered(leaves, ["tree"], [F.col("doc_id"), F.col("digest")], "index")
    sizes = leaves.groupBy("tree").agg(F.count("*").alias("size"))
    nodes = materialise(placed.join(sizes, "tree"), "nodes")
    below = _rounds(nodes, arity, levels)
    subroots = below[-1].select("tree", "digest")
    n_trees = subroots.count()
    tops = numbered(subroots.withColumn("_all", F.lit("")), ["_all"], [F.col("tree")], "index").withColumnRenamed("tree", "of")
    above = _rounds(materialise(tops.select(F.lit("").alias("tree"), F.lit(n_trees).cast("long").alias("size"), "index", "digest", "of"), "tops"), arity, levels)

    end = above[-1].select("tree", "index", F.expr(f"CAST(array() AS array<{_STEP}>)").alias("steps"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    top = _hand_down(above, end, ("of", "digest"), arity, levels)
    links = materialise(top.select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("index"), "steps", F.col("digest").alias("subroot"), "root"), "links")
    proofs = _hand_down(below, links, ("doc_id", "digest", *keep_as.values()), arity, levels)
    return proofs.select("doc_id", F.col("digest").alias("leaf"), "steps", "subroot", "root", *(F.col(n).alias(c) for c, n in keep_as.items()))


def folded(leaf_: Column, steps: Column) -> Column:
    """The root that a leaf and its proof give."""

    def up(node: Column, step: Column) -> Column:
        before, after = F.slice(step.others, F.lit(1), step.slot), F.slice(step.others, step.slot + 1, F.greatest(F.size(step.others) - step.slot, F.lit(0)))
        return F.sha2(F.concat(F.array_join(before, ""), node, F.array_join(after, "")).cast("binary"), 256)

    return F.aggregate(steps, leaf_, up)


def siblings(steps: Column) -> Column:
    """All siblings of a proof in one text, as a digest is made of."""
    return F.array_join(F.flatten(F.transform(steps, lambda s: s.others)), "")
