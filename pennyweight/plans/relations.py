"""Joins (J-series)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import once, totals
from .ledger import items, with_items
from .registry import query, table


@query("j01_inner", with_items("SELECT i.id, o_orderstatus FROM items i JOIN orders ON l_orderkey = o_orderkey WHERE method = 'Emergency'"))
def j01(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return items(spark, sf, "id", "method", "l_orderkey").where("method = 'Emergency'").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("id", "o_orderstatus")


@query("j03_scalar_subquery", with_items("SELECT s_suppkey, s_name, (SELECT max(award_date) FROM items WHERE supplier_key = s_suppkey) AS last_award FROM supplier"))
def j03(spark, sf):
    last = items(spark, sf, "supplier_key", "supplier", "award_date").groupBy("supplier_key").agg(F.max("award_date").alias("last_award"))
    return table(spark, sf, "supplier").join(last, F.col("s_suppkey") == F.col("supplier_key"), "left").select("s_suppkey", "s_name", "last_award")


@query("j04_semi", with_items("SELECT id FROM items WHERE supplier_key IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)"))
def j04(spark, sf):
    low = table(spark, sf, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("supplier_key"))
    return items(spark, sf, "id", "supplier_key", "supplier").join(low, "supplier_key", "left_semi").select("id")


@query("j05_anti", "SELECT p_partkey FROM part ANTI JOIN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48) ON p_partkey = l_partkey")
def j05(spark, sf):
    sold = table(spark, sf, "lineitem").where("l_quantity > 48").select("l_partkey")
    return table(spark, sf, "part").join(sold, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


_STORED = "SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 7 <> 0"
_WANTED = "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN md5(text || '!') ELSE md5(text) END AS h FROM documents WHERE doc_id % 3 <> 0"


@query("j06_sync_plan", f"SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.h IS NULL THEN 'delete' WHEN a.h IS NULL THEN 'insert' ELSE 'update' END AS action FROM ({_STORED}) a FULL JOIN ({_WANTED}) b ON a.doc_id = b.doc_id WHERE a.h IS DISTINCT FROM b.h")
def j06(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    stored = docs.where("doc_id % 7 <> 0").select("doc_id", F.md5("text").alias("h"))
    marked = F.when(F.col("doc_id") % 5 == 0, F.md5(F.concat("text", F.lit("!")))).otherwise(F.md5("text"))
    return once.sync_plan(stored, docs.where("doc_id % 3 <> 0").select("doc_id", marked.alias("h")), "doc_id", "h")


@query("j07_snapshot_changes", "SELECT coalesce(a.s, b.s) AS l_suppkey, coalesce(a.f, b.f) AS l_returnflag, a.v AS before, b.v AS after, coalesce(b.v, 0) - coalesce(a.v, 0) AS change FROM (SELECT l_suppkey AS s, l_returnflag AS f, CAST(sum(l_quantity) AS BIGINT) AS v FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL) a FULL JOIN (SELECT l_suppkey AS s, l_returnflag AS f, CAST(sum(l_quantity) AS BIGINT) AS v FROM lineitem WHERE l_linenumber <> 2 GROUP BY ALL) b ON a.s = b.s AND a.f = b.f WHERE a.v IS DISTINCT FROM b.v")
def j07(spark, sf):
    def snapshot(where: str):
        return table(spark, sf, "lineitem").where(where).groupBy("l_suppkey", "l_returnflag").agg(F.sum("l_quantity").cast("long").alias("v"))

    return once.changed(snapshot("l_linenumber <= 3"), snapshot("l_linenumber <> 2"), ["l_suppkey", "l_returnflag"], "v")


@query("j08_lookup", with_items("SELECT place, r_name, count(*) AS n FROM items JOIN nation ON place = n_name JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"))
def j08(spark, sf):
    # two dimension tables of fixed size
    places = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("place"), "r_name")
    return items(spark, sf, "place").join(places, "place").groupBy("place", "r_name").agg(F.count("*").alias("n"))


@query("j09_collect_to_item", "SELECT o_orderkey, coalesce(flags, '') AS flags FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lineitem WHERE l_quantity > 30 GROUP BY 1) ON o_orderkey = l_orderkey")
def j09(spark, sf):
    flags = table(spark, sf, "lineitem").where("l_quantity > 30").groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("flags"))
    return table(spark, sf, "orders").join(flags, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("flags", F.lit("")).alias("flags"))


@query("j10_self_join_in_block", "SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND CAST(a.o_orderdate AS DATE) = CAST(b.o_orderdate AS DATE) AND a.o_orderkey < b.o_orderkey")
def j10(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"), "o_orderkey")
    a, b = rows.withColumnRenamed("o_orderkey", "a"), rows.withColumnRenamed("o_orderkey", "b")
    return a.join(b, ["o_custkey", "day"]).where("a < b").select("a", "b")


@query("j13_within_31_days", "SELECT a.o_custkey, a.o_orderkey AS a, b.o_orderkey AS b, abs(a.d - b.d)::INTEGER AS apart FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders) a JOIN (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders) b ON a.o_custkey = b.o_custkey AND (a.d, a.o_orderkey) < (b.d, b.o_orderkey) AND b.d - a.d <= 31")
def j13(spark, sf):
    rows = table(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate"))
    out = once.near_in_time(rows, ["o_custkey"], "day", 31, "o_orderkey")
    return out.select("o_custkey", "a", "b", F.abs(F.datediff("day_a", "day_b")).alias("apart"))


@query("j14_cross_dataset", with_items("SELECT a.id AS award_id, b.id AS notice_id FROM items a JOIN items b ON a.dataset = 'award' AND b.dataset = 'notice' AND a.award_date = b.award_date AND a.amount % 100 = b.amount % 100 AND a.amount <> 0 AND b.amount <> 0"))
def j14(spark, sf):
    """A contract and a notice of one day whose values agree to the cent; here in what is above whole hundreds."""
    rows = items(spark, sf, "id", "dataset", "amount", "award_date").where("amount <> 0").withColumn("cents", F.col("amount") % 100)
    a = rows.where("dataset = 'award'").select(F.col("id").alias("award_id"), "award_date", "cents")
    b = rows.where("dataset = 'notice'").select(F.col("id").alias("notice_id"), "award_date", "cents")
    return a.join(b, ["award_date", "cents"]).select("award_id", "notice_id")


@query("j15_unordered_pairs", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'reviewed' AS decision FROM lineitem JOIN (SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE l_linenumber = 7) r ON least(l_partkey, l_suppkey) = a AND greatest(l_partkey, l_suppkey) = b")
def j15(spark, sf):
    """Pairs meet their review whichever way round either is written."""
    rows = table(spark, sf, "lineitem")
    ends = [F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b")]
    reviews = rows.where("l_linenumber = 7").select(F.col("l_suppkey").alias("x"), F.col("l_partkey").alias("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *ends).join(reviews, ["a", "b"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.lit("reviewed").alias("decision"))


@query("j16_densify", with_items("SELECT g.method, g.fiscal_year, n FROM (SELECT m.method, y.fiscal_year FROM (SELECT DISTINCT method FROM items) m, (SELECT DISTINCT fiscal_year FROM items) y) g LEFT JOIN (SELECT method, fiscal_year, count(*) AS n FROM items WHERE dataset = 'award' GROUP BY ALL) c ON g.method = c.method AND g.fiscal_year = c.fiscal_year"))
def j16(spark, sf):
    rows = items(spark, sf, "dataset", "method", "fiscal_year")
    counts = rows.groupBy("method", "fiscal_year").agg(F.nullif(F.count_if(F.col("dataset") == "award"), F.lit(0)).alias("n"))
    return totals.densify(counts, "method", "fiscal_year")


@query("j17_first_of_documents", with_items("SELECT place, fiscal_year, CAST(coalesce(sum(amount) FILTER (dataset = 'contract'), sum(amount) FILTER (dataset = 'notice'), sum(amount) FILTER (dataset = 'award')) AS DOUBLE) AS value FROM items WHERE l_quantity > 45 GROUP BY ALL"))
def j17(spark, sf):
    wide = items(spark, sf, "dataset", "place", "amount", "fiscal_year", "l_quantity").where("l_quantity > 45").groupBy("place", "fiscal_year").pivot("dataset", ["contract", "notice", "award"]).agg(F.sum("amount"))
    return wide.select("place", "fiscal_year", F.coalesce("contract", "notice", "award").cast("double").alias("value"))


@query("j18_next_year", with_items("SELECT a.place, a.y, CAST(a.v AS DOUBLE) AS now, CAST(b.v AS DOUBLE) AS next FROM (SELECT place, year(award_date) AS y, sum(amount) AS v FROM items GROUP BY ALL) a JOIN (SELECT place, year(award_date) AS y, sum(amount) AS v FROM items GROUP BY ALL) b ON a.place = b.place AND b.y = a.y + 1"))
def j18(spark, sf):
    by = items(spark, sf, "place", "amount", "award_date").groupBy("place", F.year("award_date").alias("y")).agg(F.sum("amount").cast("double").alias("v"))
    a = by.select("place", "y", F.col("v").alias("now"))
    b = by.select("place", (F.col("y") - 1).alias("y"), F.col("v").alias("next"))
    return a.join(b, ["place", "y"]).select("place", F.col("y").cast("long").alias("y"), "now", "next")


@query("j19_any_case", "SELECT n_name, r_name FROM nation JOIN region ON lower(n_name) LIKE lower(substr(r_name, 1, 1)) || '%'")
def j19(spark, sf):
    left = table(spark, sf, "nation").withColumn("k", F.lower(F.substring("n_name", 1, 1)))
    right = table(spark, sf, "region").withColumn("k", F.lower(F.substring("r_name", 1, 1)))
    return left.join(right, "k").select("n_name", "r_name")


@query("j21_single_owner_alias", "SELECT p_name AS alias, min(l_suppkey) AS owner FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 49 GROUP BY p_name HAVING count(DISTINCT l_suppkey) = 1")
def j21(spark, sf):
    rows = table(spark, sf, "lineitem").where("l_quantity > 49").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    out = rows.groupBy(F.col("p_name").alias("alias")).agg(F.min("l_suppkey").alias("owner"), F.countDistinct("l_suppkey").alias("owners"))
    return out.where("owners = 1").drop("owners")


@query("j22_contains_small_side", "SELECT DISTINCT n_name, p_type FROM part JOIN nation ON contains(p_type, substr(n_name, 1, 2))")
def j22(spark, sf):
    # nation has 25 rows in every size of the schema; types are distinct first
    types = table(spark, sf, "part").select("p_type").distinct()
    return types.join(F.broadcast(table(spark, sf, "nation")), F.contains("p_type", F.substring("n_name", 1, 2))).select("n_name", "p_type").distinct()


@query("j24_left_join_details", "SELECT o_orderkey, count(l_orderkey) AS details, CAST(coalesce(sum(l_quantity), 0) AS BIGINT) AS quantity FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_linenumber > 5) ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def j24(spark, sf):
    details = table(spark, sf, "lineitem").where("l_linenumber > 5").groupBy("l_orderkey").agg(F.count("*").alias("details"), F.sum("l_quantity").alias("q"))
    out = table(spark, sf, "orders").join(details, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return out.select("o_orderkey", F.coalesce("details", F.lit(0)).cast("long").alias("details"), F.coalesce("q", F.lit(0.0)).cast("long").alias("quantity"))


_PROGRAM = "CASE WHEN l_partkey % 5 = 0 THEN NULL WHEN l_partkey % 2 = 0 THEN 'Fisheries and wharves ' || l_linestatus ELSE l_linestatus || ' fund' END"


@query("j25_fold_renamed", f"""
WITH g AS (SELECT l_suppkey AS org, l_partkey % 50 AS number, l_returnflag || l_linenumber AS name, min(CAST(l_shipdate AS DATE)) AS start, min({_PROGRAM}) AS program, bool_or(l_quantity >= 45) AS is_original FROM lineitem GROUP BY ALL),
p AS (SELECT *, left(regexp_replace(lower(coalesce(program, '')), '[^a-z0-9]', '', 'g'), 15) AS p FROM g),
h AS (SELECT org, number, arg_min({{'n': name, 's': start, 'p': p}}, (CASE WHEN is_original THEN 0 ELSE 1 END, name)) AS h FROM p GROUP BY ALL HAVING count(*) FILTER (is_original) <= 1)
SELECT p.org, p.number, p.name, CASE WHEN h IS NOT NULL AND (p.start IS NOT DISTINCT FROM h.s OR p.p = h.p OR p.p = '' OR h.p = '') THEN h.n ELSE p.name END AS folded_into FROM p LEFT JOIN h USING (org, number)""")
def j25(spark, sf):
    groups = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("org"), (F.col("l_partkey") % 50).alias("number"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("name"))
    groups = groups.agg(F.min(F.to_date("l_shipdate")).alias("start"), F.min(F.expr(_PROGRAM)).alias("program"), F.bool_or(F.col("l_quantity") >= 45).alias("is_original"))
    return once.fold_renamed(groups, "org", "number", "start", "program", "name").select("org", "number", "name", "folded_into")
