"""Pages of suppliers: what each printed name, source, year, body and flag adds up to, and the largest records.

The ledger is read once into cells, one for each supplier, printed name,
source, body, year and currency; every part of a page is a sum of cells,
so a supplier with a third of all records is no larger than its cells.
Overlapping sources are shown and not added to the total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ids, names
from .lineage import cut

TOP = 40


def _listed(df: DataFrame, by: str, order: list[Column], fields: list[str], name: str) -> DataFrame:
    """The rows of each supplier as an array of structs in ``order``."""
    keys = [o.alias(f"_o{k}") for k, o in enumerate(order)]
    rows = df.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(*keys, *fields))).alias("_all"))
    return rows.select(by, F.transform("_all", lambda r: F.struct(*(r[f].alias(f) for f in fields))).alias(name))


def supplier_pages(items: DataFrame, flags: DataFrame, overlap: tuple[str, ...], top: int = TOP) -> DataFrame:
    """``supplier_key, name, total, overlap, n, by_source, by_year, buyers, flags, combined, top`` of each supplier.

    ``items``: ``id, supplier_key, supplier, name_key, dataset, buyer, year, currency, amount``.
    ``flags``: ``flag, id``.  Amounts in other currencies count as 0.
    ``combined`` lists the printed names where several keys were joined.
    """
    known = items.where("supplier_key IS NOT NULL").withColumn("a", F.when(F.col("currency") == "CAD", F.coalesce("amount", F.lit(0))).otherwise(F.lit(0)))
    cells = cut(known.groupBy("supplier_key", "supplier", "name_key", "dataset", "buyer", "year").agg(F.count("*").alias("n"), F.sum("a").alias("a")))
    double = F.col("dataset").isin(*overlap)
    counted = F.sum(F.when(~double, F.col("a")).otherwise(F.lit(0)))
    base = cells.groupBy("supplier_key").agg(counted.alias("total"), F.sum(F.when(double, F.col("a")).otherwise(F.lit(0))).alias("overlap"), F.sum("n").alias("n"))
    printed = cells.groupBy("supplier_key", "supplier").agg(F.sum("n").alias("n"))
    shown = printed.groupBy("supplier_key").agg(F.min_by("supplier", F.struct(-F.col("n"), "supplier")).alias("name"))
    key = "supplier_key"
    sources = _listed(cells.groupBy(key, "dataset").agg(F.sum("n").alias("n"), F.sum("a").alias("a")), key, [F.col("dataset")], ["dataset", "n", "a"], "by_source")
    years = _listed(cells.where(~double & F.col("year").isNotNull()).groupBy(key, "year").agg(F.sum("a").alias("a")), key, [F.col("year")], ["year", "a"], "by_year")
    buyers = _listed(cells.groupBy(key, "buyer").agg(F.sum("n").alias("n"), F.sum("a").alias("a"), counted.alias("included")), key, [-F.col("a"), F.col("buyer")], ["buyer", "n", "a", "included"], "buyers")
    variants = cells.groupBy(key, "name_key").agg(F.sum("n").alias("n"), counted.alias("a"))
    named = cells.groupBy(key, "name_key", "supplier").agg(F.sum("n").alias("n")).groupBy(key, "name_key").agg(F.min_by("supplier", F.struct(-F.col("n"), "supplier")).alias("supplier"))
    combined = _listed(variants.join(named, [key, "name_key"]), key, [-F.col("n"), F.col("name_key")], ["supplier", "name_key", "n", "a"], "combined")
    said = flags.join(known.select("id", key), "id").groupBy(key, "flag").agg(F.count("*").alias("n"))
    flagged = _listed(said, key, [F.col("flag")], ["flag", "n"], "flags")
    largest = W.partitionBy(key).orderBy(F.coalesce("amount", F.lit(0)).desc(), "id")
    records = known.select(key, "id", "amount").withColumn("rank", F.row_number().over(largest)).where(F.col("rank") <= top)
    tops = _listed(records, key, [F.col("rank")], ["id", "amount"], "top")
    out = base.join(shown, key)
    for part in (sources, years, buyers, combined, flagged, tops):
        out = out.join(part, key, "left")
    return out.withColumn("combined", F.when(F.size("combined") > 1, F.col("combined")))


def redirects(items: DataFrame) -> DataFrame:
    """``alias, supplier_key``: hashes of printed names that lead to the supplier they were joined into.

    A name whose key is a supplier's own, or that several suppliers print, leads nowhere.
    """
    pairs = items.where("supplier_key IS NOT NULL").select("supplier_key", "name_key").distinct()
    owners = pairs.groupBy("name_key").agg(F.count("*").alias("n"), F.min("supplier_key").alias("supplier_key")).where("n = 1").drop("n")
    own = pairs.select(F.col("supplier_key").cast("string").alias("name_key")).distinct()
    return owners.join(own, "name_key", "left_anti").select(ids.text_hash(F.col("name_key"), 10).alias("alias"), "supplier_key")


def close_names(suppliers: DataFrame, asked: str, shown: int = 5) -> DataFrame:
    """``name, how`` of suppliers that a name may mean: all its words first, then names that begin alike and are a slip away."""
    words = names.entity_key(asked).split()
    keyed = names.with_keys(suppliers.select("name").distinct(), "name")
    holds = F.lit(bool(words))
    for w in words:
        holds = holds & F.array_contains(F.split("name_key", " "), w)
    # only names that share their first letters are compared letter by letter
    start = F.startswith("name_key", F.lit("".join(words)[:3] if len(words) == 1 else " ".join(words)[:3]))
    near = start & (names.slips_udf(F.col("name_key"), F.lit(" ".join(words))) <= 2)
    how = F.when(holds, 0).when(near, 1)
    return keyed.select("name", how.alias("how")).where("how IS NOT NULL").orderBy("how", "name").limit(shown)
