"""Mixing sources to target weights by temperature.

A source's weight is its share of tokens to the power of an exponent,
normalised.  The exponent is found by bisection (several points at once,
each an aggregate over the sources), as the largest departure from the
natural shares that a repetition limit allows, or where the weights reach
a target entropy.  The weights become token budgets, and each budget is
spent on permutations of the source's blocks: whole passes over all its
blocks, then one over the first blocks of a new permutation, down to the
document that still fits.

Blocks are dealt by a hash of ``doc_id``, so a source with a third of all
rows is spread as evenly as any other; prefix sums run over blocks, and
over the documents of the one block in which a budget ends.

Defined results: a document's tokens are its words and one end (null text:
the end only); null sources are one source; repeated rows are documents
of their own; an empty table gives none; columns with clashing names do
not matter, as the operator returns the input's own columns unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, materialise

REPETITIONS = 2.0
BLOCK_TOKENS = 8192
#: Beyond so many blocks a source has as many as the root of its tokens: then a pass orders no more blocks, and
#: the block in which a budget ends holds no more tokens, than that root.
BLOCKS = 4096
#: Exponents tried at once, and rounds of them: 16 ** 13 is more than a double can tell apart.
POINTS, ROUNDS = 16, 13


def _hash(*parts: Column) -> Column:
    """32 bits of md5 over the parts' text, joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def shares(docs: DataFrame) -> DataFrame:
    """``source, tokens, share`` and the number of blocks of each source."""
    totals = docs.groupBy("_source").agg(F.sum("_tokens").alias("tokens"))
    whole = totals.agg(F.sum("tokens").alias("all_tokens"))
    blocks = F.least(F.greatest(F.ceil(F.col("tokens") / BLOCK_TOKENS), F.lit(1)), F.greatest(F.lit(BLOCKS), F.floor(F.sqrt("tokens")))).cast("long")
    return totals.join(F.broadcast(whole)).select("_source", "tokens", (F.col("tokens") / F.col("all_tokens")).alias("share"), blocks.alias("blocks"))


def _at(a: float, k: int) -> list[Column]:
    """For an exponent: the normaliser, and what entropy and repetition follow from."""
    p, power = F.col("share"), F.pow("share", F.lit(a))
    return [
        F.sum(power).alias(f"z{k}"),
        F.sum(power * a * F.log(p)).alias(f"l{k}"),
        F.max(power / p).alias(f"top{k}"),
        F.min(power / p).alias(f"low{k}"),
    ]


def exponent(sources: DataFrame, repetitions: float | None = REPETITIONS, entropy: float | None = None) -> float:
    """The least exponent in [0, 1] whose passes per source stay within ``repetitions``
    times the fewest, or whose entropy (as a part of the largest) is at most ``entropy``."""
    from math import log

    n = sources.count()
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        points = [low + (high - low) * k / POINTS for k in range(POINTS + 1)]
        row = sources.agg(*(c for k, a in enumerate(points) for c in _at(a, k))).first()

        def meets(k: int, row=row) -> bool:
            if entropy is not None:
                h = log(row[f"z{k}"]) - row[f"l{k}"] / row[f"z{k}"]
                return h <= entropy * log(n) if n > 1 else True
            return row[f"top{k}"] / row[f"low{k}"] <= repetitions

        at = next((k for k in range(POINTS + 1) if meets(k)), POINTS)
        if at == 0:
            return points[0]
        low, high = points[at - 1], points[at]
    return high


def plan(docs: DataFrame, repetitions: float | None = REPETITIONS, entropy: float | None = None, budget: float | None = None) -> DataFrame:
    """A row for each source: its weight and token budget.

    ``budget`` is the whole budget in tokens; without one it is the least
    that uses every document at least once.
    """
    sources = materialise(shares(docs), "sources")
    if not sources.take(1):
        return sources.withColumns({"weight": F.lit(0.0), "budget": F.lit(0).cast("long")})
    a = exponent(sources, repetitions, entropy)
    weighed = sources.withColumn("power", F.pow("share", F.lit(a)))
    z = weighed.agg(F.sum("power").alias("z"))
    weighed = weighed.join(F.broadcast(z)).withColumn("weight", F.col("power") / F.col("z"))
    if budget is None:
        whole = weighed.agg(F.max(F.col("tokens") / F.col("weight")).alias("whole"))
    else:
        whole = docs.sparkSession.range(1).select(F.lit(float(budget)).alias("whole"))
    return weighed.join(F.broadcast(whole)).select("_source", "tokens", "blocks", "weight", F.round(F.col("weight") * F.col("whole")).cast("long").alias("budget"))


def mix(docs: DataFrame, repetitions: float | None = REPETITIONS, entropy: float | None = None, budget: float | None = None) -> DataFrame:
    """``docs``, each row once for every pass that takes it, with
    ``_epoch``, ``_block``, ``_block_rank`` and ``_tokens`` added, in place of columns of these names."""
    given = {c: f"_given_{k}" for k, c in enumerate(docs.columns)}  # so that no name clashes
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    counted = docs.select(
        *(F.col(f"`{c}`").alias(g) for c, g in given.items()),
        F.col("source").cast("string").alias("_source"),
        (F.regexp_count(text, F.lit(WORD)) + 1).cast("long").alias("_tokens"),
    )
    key = F.col(given["doc_id"]).cast("string")
    sources = materialise(plan(counted, repetitions, entropy, budget), "plan")
    sources = sources.withColumnRenamed("_source", "s")
    placed = counted.join(sources.select("s", "blocks"), F.col("_source").eqNullSafe(F.col("s"))).drop("s")
    placed = placed.withColumn("_block", F.pmod(_hash(F.coalesce(key, F.lit("-"))), F.col("blocks"))).drop("blocks")

    # which blocks each pass takes
    named = F.coalesce(F.col("_source"), F.lit("-"))
    sizes = placed.groupBy("_source", "_block").agg(F.sum("_tokens").alias("size"))
    passes = sizes.join(sources.drop("blocks"), F.col("_source").eqNullSafe(F.col("s"))).drop("s")
    passes = passes.withColumn("_epoch", F.explode(F.expr("sequence(0L, budget div tokens)")))
    order = W.partitionBy("_source", "_epoch").orderBy(_hash(named, F.col("_epoch").cast("string"), F.col("_block").cast("string")), "_block")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.when(F.col("_epoch") < F.expr("budget div tokens"), F.col("size")).otherwise(F.expr("budget % tokens") - before)
    passes = passes.select("_source", "_block", "_epoch", "size", F.row_number().over(order).cast("long").alias("_block_rank"), left.cast("long").alias("left")).where("left > 0")
    passes = materialise(passes, "passes")

    taken = passes.select(F.col("_source").alias("s"), F.col("_block").alias("b"), "_epoch", "_block_rank", "left", "size")
    met = placed.join(taken, F.col("_source").eqNullSafe(F.col("s")) & (F.col("_block") == F.col("b"))).drop("s", "b")
    whole = met.where("left >= size")
    # the block in which a budget ends: its documents in hash order while they fit
    ends = W.partitionBy("_source", "_epoch").orderBy(_hash(F.coalesce(key, F.lit("-")), F.col("_epoch").cast("string")), given["doc_id"], given["text"])
    part = met.where("left < size").withColumn("_sum", F.sum("_tokens").over(ends.rowsBetween(W.unboundedPreceding, 0))).where("_sum <= left").drop("_sum")
    added = ["_epoch", "_block", "_block_rank", "_tokens"]
    return whole.unionByName(part).select(*(F.col(g).alias(c) for c, g in given.items() if c not in added), *added)
