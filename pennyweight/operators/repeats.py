"""Repeated printings of an award: what each is counted with, and an audit of near pairs.

Printings that agree on contract number, supplier and price are one group,
read in printed order.  A printing is compared with those that stand so
far: a reviewed pair is decided by its review, others are a repeat where
all printed details agree.  A correction takes the place of what it
corrects, so links form chains; their ends come from pointer jumping.

Most groups have no review, and each class of equal details points to its
first printing.  Only groups with a reviewed printing are replayed in
order, streamed from sorted partitions, with the printings that stand as
the only state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import codes
from .lineage import cut, settle
from .once import near_in_time

# What is said of each decision.
AGREES = "Same full contract/PO number, matched supplier, buyer, CAD price, printed award date and description."
TOGETHER = "Matching full identifiers and award details; both source printings remain on the counted record."
NUMBERS = "Different full contract/PO numbers; equal amounts and nearby dates do not establish a repeat."
DETAILS = "Different printed award details; kept separately."

_KEYS = ["_contract", "supplier_key", "amount"]
_LINK = "id long, to long, decision string, evidence string"


def details() -> Column:
    """All printed details of an award as one text; null where some are missing, which never agrees."""
    parts = [F.col("award_date").cast("string"), F.col("buyer_key").cast("string"), F.nullif(codes.text_key(F.col("description")), F.lit("")), codes.detail_key(F.col("term")), codes.detail_key(F.col("renewal"))]
    return F.concat(*(x for p in parts for x in (p, F.lit("\x1f"))))


def links(printings: DataFrame, reviews: DataFrame) -> DataFrame:
    """``id, to, decision, evidence``: each printing that is counted with another, ``to``.

    ``printings``: ``id`` (long, ascending in printed order), ``contract_no, supplier_key,
    amount, currency, award_date, buyer_key, description, term, renewal``.
    ``reviews``: ``id_a, id_b, decision, evidence``, decision being repeat, correction
    (of a, by b) or keep.  Only priced printings in CAD of a known supplier
    with a contract number can be repeats.
    """
    marked = printings.select("id", codes.contract_key(F.col("contract_no")).alias("_contract"), "supplier_key", "amount", "currency", details().alias("_class"))
    marked = marked.where("_contract <> '' AND currency = 'CAD' AND amount IS NOT NULL AND supplier_key IS NOT NULL").drop("currency")
    side = lambda me, other: reviews.select(F.col(me).alias("id"), F.struct(F.col(other).alias("other"), "decision", F.col("id_b").alias("right"), "evidence").alias("_review"))
    told = side("id_a", "id_b").union(side("id_b", "id_a")).groupBy("id").agg(F.collect_list("_review").alias("_reviews"))
    known = marked.join(told, "id", "left")
    # one shuffle by the group serves the flag, the classes and the replay
    group = W.partitionBy(*_KEYS)
    known = known.withColumn("_told", F.max(F.col("_reviews").isNotNull()).over(group))
    first = F.min("id").over(W.partitionBy(*_KEYS, "_class"))
    placed = known.withColumn("to", first).where("_told OR (_class IS NOT NULL AND id <> to)").sortWithinPartitions(*_KEYS, "id")  # the windows left each group in one partition
    return placed.select("id", F.concat_ws("|", *_KEYS).alias("_group"), "_class", "_reviews", "_told", "to").mapInArrow(_replay, _LINK)


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    group, standing = None, {}  # id: class, in the order of places
    for batch in batches:
        told, out = batch.column("_told"), []
        quiet = batch.filter(pc.invert(told))
        said = [pa.array([x] * quiet.num_rows, pa.string()) for x in ("repeat", AGREES)]
        yield pa.RecordBatch.from_arrays([quiet.column("id"), quiet.column("to"), *said], ["id", "to", "decision", "evidence"])
        for row in batch.filter(told).to_pylist():
            if row["_group"] != group:
                group, standing = row["_group"], {}
            me, said = row["id"], {r["other"]: r for r in row["_reviews"] or ()}
            for other, details_ in standing.items():
                review = said.get(other)
                if review is None and (row["_class"] is None or row["_class"] != details_):
                    continue
                decision, why = (review["decision"], review["evidence"]) if review else ("repeat", AGREES)
                if decision == "keep":
                    continue
                if decision == "correction" and review["right"] == me:
                    out.append((other, me, decision, why))
                    standing = {(me if k == other else k): (row["_class"] if k == other else v) for k, v in standing.items()}
                else:  # of a correction that was printed first, the later one is the repeat
                    out.append((me, other, "repeat", why))
                break
            else:
                standing[me] = row["_class"]
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["id", "to", "decision", "evidence"])


def roots(pointers: DataFrame, most_rounds: int = 40) -> DataFrame:
    """``id, root``: where a chain of ``id`` to ``to`` ends.

    Every round joins the table with itself, so what a row has jumped over
    doubles; chains of any length end after the logarithm of it.
    """
    now = cut(pointers.select("id", "to"))
    settle(now.sparkSession)
    for _ in range(most_rounds):
        further = now.select(F.col("id").alias("to"), F.col("to").alias("_next"))
        new = cut(now.join(further, "to", "left").select("id", F.coalesce("_next", "to").alias("to"), F.col("_next").isNotNull().alias("_moved")))
        now = new.select("id", "to")
        if not new.where("_moved").take(1):
            settle(now.sparkSession)
            return now.withColumnRenamed("to", "root")
    raise RuntimeError("links run in a circle")


def pair_audit(printings: DataFrame, reviews: DataFrame, days: int = 31) -> DataFrame:
    """``a, b, supplier_key, amount, currency, days_apart, decision, evidence``: all printings of one
    supplier, price and currency that lie near in time, before counting once, and what came of them."""
    made = roots(links(printings, reviews))
    priced = printings.where("award_date IS NOT NULL AND amount IS NOT NULL AND supplier_key IS NOT NULL")
    # a pair's review travels with its lesser printing, so that pairs, of which there are more, need no join
    least = reviews.groupBy(F.least("id_a", "id_b").alias("id")).agg(F.collect_list(F.struct(F.greatest("id_a", "id_b").alias("other"), "evidence")).alias("said"))
    dated = priced.select("id", "supplier_key", "amount", "currency", "award_date", codes.contract_key(F.col("contract_no")).alias("number")).join(made, "id", "left").join(least, "id", "left")
    known = dated.select("id", "supplier_key", "amount", "currency", "award_date", F.struct("id", "number", F.coalesce("root", "id").alias("root"), "said").alias("who"))
    met = near_in_time(known, ["supplier_key", "amount", "currency"], "award_date", days, "who")
    a, b = F.col("a.id"), F.col("b.id")
    of = lambda side, other: F.filter(F.coalesce(F.col(f"{side}.said"), F.array().cast("array<struct<other:bigint,evidence:string>>")), lambda r: r["other"] == other)
    judged = met.withColumn("_once", F.col("a.root") == F.col("b.root")).withColumn("_said", F.explode_outer(F.when(a < b, of("a", b)).otherwise(of("b", a))))
    why = F.coalesce("_said.evidence", F.when(F.col("_once"), TOGETHER).when(F.col("a.number") != F.col("b.number"), NUMBERS).otherwise(DETAILS))
    apart = F.abs(F.datediff("day_a", "day_b")).alias("days_apart")
    return judged.select(a.alias("a"), b.alias("b"), "supplier_key", "amount", "currency", apart, F.when(F.col("_once"), "count once").otherwise("keep both").alias("decision"), why.alias("evidence"))
