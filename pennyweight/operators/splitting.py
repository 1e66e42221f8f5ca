"""Splitting one printed name into several suppliers, on evidence only.

Places are first pooled per identifier over its spellings.  Then, within a
name, identifiers that conflict with the same others are one piece, and a
name with several pieces is split.  A record without an identifier joins
the only piece that shares its place, or stays apart.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.closeness import close
from .identity import PLACES, connected, opposed


def profiles(records: DataFrame) -> DataFrame:
    """``base, code`` with the places and anchors printed beside them."""
    stated = records.where(F.col("code").isNotNull())
    return stated.groupBy("base", "code").agg(F.collect_set("postal").alias("postal"), F.collect_set("locality").alias("locality"), F.collect_set("anchor").alias("anchors"))


def pooled(known: DataFrame) -> DataFrame:
    """Profiles of one identifier, pooled over spellings that are close: a slip apart, one inside the other, or a unit of it.

    Spellings of an identifier meet in pairs; chains of close ones are components.
    """
    named = known.withColumn("node", F.concat_ws("|", "code", "base"))
    a, b = (named.select("code", F.col("base").alias(f"base_{c}"), F.col("node").alias(c)) for c in "ab")
    met = a.join(b, "code").where("base_a < base_b").where(close(F.col("base_a"), F.col("base_b"), "any")).select("a", "b")
    joined = named.join(connected(met).withColumnRenamed("key", "node"), "node", "left").withColumn("_part", F.coalesce("component", "node"))
    bags = joined.groupBy("_part").agg(*(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in PLACES))
    return joined.select("base", "code", "_part").join(bags, "_part").select("base", "code", *PLACES)


def pieces(known: DataFrame) -> DataFrame:
    """``base, code, piece`` for names that split."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        per = {r["code"]: {"code": r["code"], **{c: set(r[c]) for c in PLACES}} for r in rows.to_dict("records")}
        against = {a: frozenset(others) for a, others in opposed(per).items()}
        piece = {a: min(b for b in per if against[b] == against[a]) for a in per}
        split = len(set(piece.values())) > 1
        out = [(key[0], a, p) for a, p in sorted(piece.items())] if split else []
        return pd.DataFrame(out, columns=["base", "code", "piece"])

    return known.groupBy("base").applyInPandas(run, "base string, code string, piece string")


def node_keys(records: DataFrame) -> DataFrame:
    """Records with the ``node`` they belong to: the name, or a piece of it."""
    known = pooled(profiles(records))
    cut = pieces(known)
    marked = records.join(cut, ["base", "code"], "left")
    places = known.join(cut, ["base", "code"])
    where = lambda c: places.select("base", F.explode(c).alias("_place"), "piece")
    seen = where("postal").union(where("locality")).distinct()
    loose = records.where("code IS NULL").select("base", F.explode(F.array_compact(F.array("postal", "locality"))).alias("_place")).distinct()
    only = loose.join(seen, ["base", "_place"]).select("base", "_place", F.col("piece").alias("_found"))
    fits = lambda c: only.select("base", F.col("_place").alias(c), F.col("_found")).groupBy("base", c).agg(F.collect_set("_found").alias(f"_by_{c}"))
    joined = marked.join(fits("postal"), ["base", "postal"], "left").join(fits("locality"), ["base", "locality"], "left")
    both = F.array_union(F.coalesce("_by_postal", F.array().cast("array<string>")), F.coalesce("_by_locality", F.array().cast("array<string>")))
    found = F.coalesce("piece", F.when(F.col("code").isNull() & (F.size(both) == 1), both[0]))
    return joined.withColumn("node", F.when(found.isNotNull(), F.concat("base", F.lit(" [bn "), found, F.lit("]"))).otherwise(F.col("base"))).drop("piece", "_by_postal", "_by_locality")
