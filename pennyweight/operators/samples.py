"""A sample of the ledger that is closed over its references.

Items are chosen by a seeded hash of their id, so one seed gives the same
rows wherever it runs.  What refers to a chosen item, or is referred to by
one, comes along by semi joins; nothing in the sample points outside it.
What is small and read several times (the first ranks, the chosen ids, the
chosen items) is written, so that each join of all items is made once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import settle, written


def chosen(items: DataFrame, flags: DataFrame, keep: dict[str, int], seed: int) -> DataFrame:
    """``id`` of the items of a sample: ``keep`` of each dataset, half of them flagged where so many are.

    ``items``: ``id, dataset, buyer_key, supplier_key, name_key, amount``.  ``flags``: ``flag, id, subject_type, subject_key``.
    Every body that a flag names keeps its largest record, and the three
    largest suppliers of several names and at most 60 records keep all.
    """
    flagged = flags.where("id IS NOT NULL").select("id").distinct().withColumn("_flagged", F.lit(True))
    marked = items.select("id", "dataset").where(F.col("dataset").isin(*keep)).join(flagged, "id", "left").withColumn("_flagged", F.coalesce("_flagged", F.lit(False)))
    draw = W.partitionBy("dataset", "_flagged").orderBy(F.md5(F.concat(F.col("id"), F.lit(f":{seed}"))), "id")
    # the constant bound lets Spark cut each task's rows before they are shuffled
    ranked, _ = written(marked.withColumn("_rank", F.row_number().over(draw)).where(F.col("_rank") <= max(keep.values())))
    settle(ranked.sparkSession)
    share = F.coalesce(*(F.when(F.col("dataset") == d, n) for d, n in keep.items()))
    first = ranked.where(F.col("_flagged") & (F.col("_rank") <= F.floor(share / 2)))
    taken = first.groupBy("dataset").agg(F.count("*").alias("_taken"))
    rest = ranked.where("NOT _flagged").join(taken, "dataset", "left").where(F.col("_rank") <= share - F.coalesce("_taken", F.lit(0)))
    named = flags.where("subject_type = 'buyer'").select(F.col("subject_key").alias("buyer_key")).distinct()
    largest = items.join(named, "buyer_key", "left_semi").groupBy("buyer_key").agg(F.max_by("id", F.struct(F.coalesce("amount", F.lit(0)), "id")).alias("id"))
    suppliers = items.where("supplier_key IS NOT NULL").groupBy("supplier_key").agg(F.countDistinct("name_key").alias("names"), F.count("*").alias("n"), F.coalesce(F.sum("amount"), F.lit(0)).alias("sum"))
    combined = suppliers.where("names > 1 AND n <= 60").orderBy(F.desc("sum"), "supplier_key").limit(3)
    theirs = items.join(F.broadcast(combined.select("supplier_key")), "supplier_key", "left_semi")  # three rows
    ids = [df.select("id") for df in (first, rest, largest, theirs)]
    found, _ = written(ids[0].union(ids[1]).union(ids[2]).union(ids[3]).distinct())
    settle(found.sparkSession)
    return found


def closed(ids: DataFrame, items: DataFrame, flags: DataFrame, **dimensions: tuple[DataFrame, str]) -> dict[str, DataFrame]:
    """The tables of a sample: its items, the flags on them or on no item, and each dimension's rows that they refer to."""
    kept, _ = written(items.join(ids, "id", "left_semi"))
    settle(kept.sparkSession)
    on_items = flags.where("id IS NOT NULL").join(ids, "id", "left_semi")
    out = {"items": kept, "flags": on_items.unionByName(flags.where("id IS NULL"))}
    for name, (table, key) in dimensions.items():
        out[name] = table.join(kept.select(key).distinct(), key, "left_semi")
    return out
