"""Supplier identity over planted spellings, with the outcome known (D-series).

Each supplier of the table prints two names; what kind of evidence joins
them, or keeps them apart, goes by its number.  The names are made of ten
letters drawn from a hash, so that names of different suppliers are far apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..functions.closeness import close
from ..operators import identity, splitting
from ..operators.lineage import cut
from .registry import query, table

_WORD = "translate(substr(md5(CAST(s_suppkey AS {text})), 1, 10), '0123456789abcdef', 'ghijklmnopqrstuv')"
#: By the number's remainder: the endings of the two names, and the evidence.
KINDS = {
    0: (" fisheries", "fisheries", "same name"),
    1: (" community board", None, "bilingual"),
    2: (" harbour works", " harbour works association", "business number"),
    3: (" trading", " tradnig", "postal code"),
    4: (" marine", " marien", "same award"),
    5: (" university", " university faculty of arts", "unit"),
    6: (" books", " library press", "reviewed"),
    7: (" foundry", " fuondry", None),
    8: (" motors", " mtoors", None),
}
_FIRST = "CASE " + " ".join(f"WHEN k = {k} THEN w || '{a}'" for k, (a, _, _) in KINDS.items()) + " END"
_SECOND = "CASE " + " ".join(f"WHEN k = {k} THEN {'w' if b else chr(39) + 'conseil de ' + chr(39)} || {chr(39) + b + chr(39) if b else 'w'}" for k, (_, b, _) in KINDS.items()) + " END"
_S = f"s AS (SELECT s_suppkey AS id, s_suppkey % 9 AS k, {_WORD.format(text='VARCHAR')} AS w FROM supplier), n AS (SELECT *, {_FIRST} AS first, {_SECOND} AS second FROM s)"
_CHAPEL = "w || ' chapel [bn ' || c || lpad(CAST(id AS VARCHAR), 8, '0') || ']'"


def _printed(spark: SparkSession, sf: str) -> DataFrame:
    word = F.expr(_WORD.format(text="STRING"))
    base = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 9).alias("k"), word.alias("w"))
    return base.withColumns({"first": F.expr(_FIRST), "second": F.expr(_SECOND)})


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Printed records: ``printed, other, code, postal, locality, anchor, dataset, day, amount``."""
    rows = _printed(spark, sf)
    text, k = "string", F.col("k")
    shown = lambda c: F.concat(F.initcap(c), F.lit(" Ltd."))
    number = lambda digit: F.concat(F.lit(str(digit)), F.lpad(F.col("id").cast(text), 8, "0"))
    place = F.concat(F.lit("A"), F.col("id").cast(text))
    none = F.lit(None).cast(text)

    def line(printed, other=none, code=none, postal=none, locality=none, dataset="grant", day=None, amount=100.0):
        return F.struct(
            printed.alias("printed"), other.alias("other"), code.alias("code"), postal.alias("postal"), locality.alias("locality"), none.alias("anchor"),
            F.lit(dataset).alias("dataset"), (none if day is None else day).cast("date").alias("day"), (amount if not isinstance(amount, float) else F.lit(amount)).cast("double").alias("amount"),
        )

    code = lambda digit: F.when(k == 2, number(1)).when(k == 8, number(digit))
    where = F.when(k.isin(3, 8), place)
    town = lambda name: F.when(k == 8, F.lit(name))
    value = F.when(k == 4, 1000.25 + F.col("id")).otherwise(100.0)
    day = F.when(k == 4, "2024-05-01")
    second = F.when(k != 1, shown("second"))
    lines = [
        line(shown("first"), F.when(k == 1, F.col("second")), code(1), where, town("gander"), "contract", day, value),
        line(shown("first"), none, code(1), where, town("gander")),
        line(second, none, code(2), where, town("corner brook"), "notice", day, value),
        line(F.when(k == 8, F.concat(F.initcap("w"), F.lit(" Chapel"))), none, number(3), none, F.lit("gander")),
        line(F.when(k == 8, F.concat(F.initcap("w"), F.lit(" Chapel"))), none, number(4), none, F.lit("corner brook")),
    ]
    return rows.select(F.explode(F.array(*lines)).alias("r")).select("r.*").where("printed IS NOT NULL")


def identities(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, the outcome of resolving them, and pairs of one number with unlike names."""
    keyed = names.with_keys(names.with_keys(records(spark, sf), "printed", "base"), "other", "other_base")
    named = splitting.node_keys(keyed).withColumnRenamed("node", "key").withColumn("other", F.nullif("other_base", F.lit("")))
    named = cut(named)
    mine = named.groupBy("key", "base").agg(F.count("*").alias("n"), F.sum("amount").alias("shown"))
    theirs = named.where("other IS NOT NULL").select(F.col("other").alias("key"), F.col("other_base").alias("base"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("shown"))
    sums = mine.union(theirs).groupBy("key", "base").agg(F.sum("n").alias("n"), F.sum("shown").alias("shown"))
    coded = named.where("code IS NOT NULL").groupBy("key", "code").agg(*(F.collect_set(c).alias(t) for c, t in (("postal", "postal"), ("locality", "locality"), ("anchor", "anchors"))))
    profiles = coded.groupBy("key").agg(F.collect_list(F.struct("code", "postal", "locality", "anchors")).alias("profiles"))
    nodes = cut(sums.join(profiles, "key", "left"))
    pairs = _printed(spark, sf).where("k = 6").select(F.col("first").alias("a"), F.col("second").alias("b"), F.lit("the same press").alias("detail"))
    edges, unlike = identity.evidence_edges(named, pairs)
    return nodes, cut(identity.resolve(nodes, cut(edges))), unlike


_BOTH = "SELECT first AS key, first AS supplier_key FROM n UNION ALL SELECT second, CASE WHEN k IN (7, 8) THEN second ELSE first END FROM n UNION ALL SELECT {c}, {c} FROM s, (VALUES ('3'), ('4')) t(c) WHERE k = 8".replace("{c}", _CHAPEL)


@query("d14_identities", f"WITH {_S} {_BOTH}")
def d14(spark, sf):
    return identity.groups(identities(spark, sf)[1])


@query("d14_evidence_used", f"WITH {_S} SELECT first AS a, second AS b, CASE " + " ".join(f"WHEN k = {k} THEN '{e}'" for k, (_, _, e) in KINDS.items() if e) + " END AS evidence FROM n WHERE k < 7")
def d14b(spark, sf):
    """Every join made, with the kind of evidence that made it."""
    kinds = F.element_at(F.array(*map(F.lit, identity.EVIDENCE)), F.col("rank") + 1)
    made = identities(spark, sf)[1].where("kind = 'joined'")
    # the first name has more records, whatever the order in the pair
    ends = made.select(kinds.alias("evidence"), F.explode(F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("end"))
    return ends.select("end.*", "evidence").join(_printed(spark, sf).select(F.col("first").alias("a")), "a").select("a", "b", "evidence")


_PAIR = "least(first, second) AS a, greatest(first, second) AS b"
_BLOCKED = f"SELECT {_PAIR} FROM n WHERE k = 8 UNION ALL SELECT {_CHAPEL.replace('|| c ||', chr(124) * 2 + chr(39) + '3' + chr(39) + chr(124) * 2)}, {_CHAPEL.replace('|| c ||', chr(124) * 2 + chr(39) + '4' + chr(39) + chr(124) * 2)} FROM s WHERE k = 8"


@query("d14_blocked_joins", f"WITH {_S} SELECT a, b, 'conflicting identifiers and disjoint locality evidence' AS detail FROM ({_BLOCKED})")
def d14c(spark, sf):
    """Joins that were refused, with the reason."""
    return identities(spark, sf)[1].where("kind = 'blocked'").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "detail").distinct()


@query("d16_near_matches_apart", f"WITH {_S} SELECT {_PAIR}, 'a spelling slip apart, with no business number, postal code or review to confirm it' AS reason FROM n WHERE k = 7 UNION ALL SELECT a, b, 'conflicting identifiers and disjoint locality evidence' FROM ({_BLOCKED})")
def d16(spark, sf):
    """Close names that stay apart, and refused joins."""
    nodes, outcome, unlike = identities(spark, sf)
    return identity.near_matches(nodes, outcome, unlike)


@query("d17_related_pieces", f"WITH {_S} SELECT a AS supplier_key, b AS related FROM ({_BLOCKED}) UNION ALL SELECT b, a FROM ({_BLOCKED})")
def d17(spark, sf):
    return identity.related(identities(spark, sf)[1]).select("supplier_key", F.array_join("related", "; ").alias("related"))


@query("d18_merge_report", f"WITH {_S} SELECT second AS name, first AS joined_to, CASE " + " ".join(f"WHEN k = {k} THEN '{e}'" for k, (_, _, e) in KINDS.items() if e) + " END AS evidence, CAST(CASE WHEN k = 1 THEN 0 ELSE 1 END AS BIGINT) AS n FROM n WHERE k < 7")
def d18(spark, sf):
    nodes, outcome, _ = identities(spark, sf)
    return identity.merges(nodes, outcome)


@query("d18_split_report", f"WITH {_S} SELECT w || ' chapel' AS base, string_agg({_CHAPEL}, '; ' ORDER BY c) AS pieces FROM s, (VALUES ('3'), ('4')) t(c) WHERE k = 8 GROUP BY w")
def d18b(spark, sf):
    nodes, outcome, _ = identities(spark, sf)
    return identity.splits(nodes, outcome).select("base", F.array_join("pieces", "; ").alias("pieces"))


@query("d10_contained_names", f"WITH {_S} SELECT first AS a, second AS b FROM n WHERE k = 2")
def d10(spark, sf):
    """One name inside the other, the longer adding only words of kind or place; names meet by their first word."""
    rows = _printed(spark, sf).select(F.explode(F.array("first", "second")).alias("name")).withColumn("word", F.split("name", " ")[0])
    a, b = rows.withColumnRenamed("name", "a"), rows.withColumnRenamed("name", "b")
    return a.join(b, "word").where("a <> b AND length(a) < length(b)").where(close(F.col("a"), F.col("b"), "contained")).select("a", "b")


@query("d11_unit_of", f"WITH {_S} SELECT first AS body, second AS name FROM n WHERE k = 5")
def d11(spark, sf):
    rows = _printed(spark, sf).select(F.explode(F.array("first", "second")).alias("name")).withColumn("word", F.split("name", " ")[0])
    a, b = rows.withColumnRenamed("name", "body"), rows
    return a.join(b, "word").where("length(body) < length(name)").where(close(F.col("body"), F.col("name"), "unit")).select("body", "name")


@query("j12_first_token_block", f"WITH {_S} SELECT first AS a, second AS b FROM n WHERE k = 5")
def j12(spark, sf):
    """Names meet under the beginnings of the longer one, which gives the same as blocks of a first word and no block to compare."""
    rows = _printed(spark, sf).select(F.explode(F.array("first", "second")).alias("name"))
    return identity.unit_pairs(rows.select(F.col("name").alias("key"), F.col("name").alias("base")))


_SLIP = "((length(replace(a, ' ', '')) >= 12 AND damerau_levenshtein(replace(a, ' ', ''), replace(b, ' ', '')) <= 2))"


@query("d08_edit_distance", f"WITH {_S}, x AS (SELECT first AS name FROM n UNION SELECT second FROM n) SELECT p.name AS a, q.name AS b FROM x p JOIN x q ON p.name < q.name AND {_SLIP.replace('(a,', '(p.name,').replace('(b,', '(q.name,')}")
def d08(spark, sf):
    """All pairs of names one or two slips apart, whatever letters they share."""
    rows = _printed(spark, sf).select(F.explode(F.array("first", "second")).alias("name"))
    return identity.near_names(rows, "name", largest=None)


@query("j11_similar_in_blocks", f"WITH {_S} SELECT {_PAIR} FROM n WHERE k IN (0, 3, 4, 7, 8)")
def j11(spark, sf):
    """Names of one block that lie a slip apart, by the published block size."""
    rows = _printed(spark, sf).select(F.explode(F.array("first", "second")).alias("name"))
    return identity.near_names(rows, "name")
