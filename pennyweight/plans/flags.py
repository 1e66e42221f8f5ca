"""Pattern flags over the ledger (P-series)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes
from ..operators import patterns
from .ledger import items, with_items
from .registry import query, table


def _r(c, n=6):
    return F.round(F.col(c), n).alias(c)


@query("p01_no_competition_items", with_items("SELECT id, method, CAST(amount AS DOUBLE) AS value FROM items WHERE dataset = 'award' AND method IN ('Sole source', 'Emergency')"))
def p01(spark, sf):
    return patterns.by_method(items(spark, sf, "id", "dataset", "amount", "method").where("dataset = 'award'"), patterns.EXCEPTIONS).withColumn("value", F.col("value").cast("double"))


@query("p01_no_competition_buyers", with_items("SELECT buyer_key, count(*) AS awards, count(*) FILTER (method <> 'Open call') AS exception_awards, round(CAST(coalesce(sum(amount) FILTER (method <> 'Open call'), 0) AS DOUBLE) / nullif(CAST(sum(amount) AS DOUBLE), 0), 6) AS value FROM items WHERE dataset = 'award' GROUP BY buyer_key HAVING count(*) FILTER (method <> 'Open call') > 0"))
def p01b(spark, sf):
    return patterns.exception_share(items(spark, sf, "dataset", "buyer_key", "buyer", "amount", "method").where("dataset = 'award'")).select("buyer_key", "awards", "exception_awards", _r("value"))


@query("p02_emergency", with_items("SELECT id, method, CAST(amount AS DOUBLE) AS value FROM items WHERE dataset = 'award' AND method = 'Emergency'"))
def p02(spark, sf):
    return patterns.by_method(items(spark, sf, "id", "dataset", "amount", "method").where("dataset = 'award'"), ("Emergency",)).withColumn("value", F.col("value").cast("double"))


@query("p03_repeat_sole_source", with_items("SELECT buyer_key, supplier_key, count(*) AS awards, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS value, min(award_date) AS first, max(award_date) AS last FROM items WHERE method = 'Sole source' GROUP BY ALL HAVING count(*) >= 3"))
def p03(spark, sf):
    return patterns.repeat_pairs(items(spark, sf, "buyer_key", "supplier_key", "amount", "award_date", "method"))


_K = "l_shipdate, l_partkey, l_linenumber, l_quantity, l_extendedprice"


@query("p04_contract_growth", f"SELECT l_orderkey, l_suppkey, CAST(o AS DOUBLE) AS original, CAST(a AS DOUBLE) AS amount, round(CAST(a AS DOUBLE) / CAST(o AS DOUBLE), 6) AS value FROM (SELECT l_orderkey, l_suppkey, arg_min(p, ({_K})) AS o, arg_max(p, ({_K})) AS a FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(18,2)) AS p FROM lineitem) GROUP BY ALL) WHERE o > 0 AND a >= 2 * o AND a - o >= 25000")
def p04(spark, sf):
    key = F.struct(*_K.split(", "))
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    ends = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.min_by(price, key).alias("original"), F.max_by(price, key).alias("amount"))
    out = patterns.growth(ends)
    return out.select("l_orderkey", "l_suppkey", F.col("original").cast("double").alias("original"), F.col("amount").cast("double").alias("amount"), _r("value"))


_LIMITS = "(VALUES ('a', CAST(34700 AS DECIMAL(18,2))), ('a', 50000), ('b', 25000)) t(body_type, limit_value)"


def _near(spark, sf):
    rows = items(spark, sf, "id", "buyer_key", "amount").select("id", "amount", F.when(F.col("buyer_key") % 2 == 0, "a").otherwise("b").alias("body_type"))
    limits = spark.sql("SELECT body_type, CAST(limit_value AS DECIMAL(18,2)) AS limit_value FROM VALUES ('a', 34700), ('a', 50000), ('b', 25000) AS t(body_type, limit_value)")
    return patterns.near_limits(rows, limits)


_NEAR = f"FROM items JOIN {_LIMITS} ON body_type = CASE WHEN buyer_key % 2 = 0 THEN 'a' ELSE 'b' END"


@query("p05_just_under_limit", with_items(f"SELECT id, CAST(limit_value AS DOUBLE) AS limit_value, CAST(amount AS DOUBLE) AS value {_NEAR} WHERE amount >= 0.95 * limit_value AND amount < limit_value"))
def p05(spark, sf):
    return _near(spark, sf)[0].select("id", F.col("limit_value").cast("double").alias("limit_value"), F.col("value").cast("double").alias("value"))


@query("p05_limit_histogram", with_items(f"SELECT body_type, CAST(limit_value AS DOUBLE) AS limit_value, count(*) FILTER (amount >= 0.95 * limit_value AND amount < limit_value) AS below, count(*) FILTER (amount >= limit_value AND amount < 1.05 * limit_value) AS above {_NEAR} WHERE amount IS NOT NULL GROUP BY ALL"))
def p05b(spark, sf):
    return _near(spark, sf)[1].withColumn("limit_value", F.col("limit_value").cast("double"))


@query("p06a_split_same_day", with_items("SELECT supplier_key, period_end AS day, category AS what, count(*) AS invoices, CAST(sum(amount) AS DOUBLE) AS value FROM items WHERE amount > 0 AND amount < 34700 AND supplier_key % 3 <> 0 GROUP BY ALL HAVING count(*) >= 2 AND sum(amount) >= 34700"))
def p06a(spark, sf):
    """Small bills of one firm on one day; payees whose names are people's are left out."""
    rows = items(spark, sf, "supplier_key", "category", "amount", "period_end").withColumnsRenamed({"period_end": "day", "category": "what"})
    payee = F.when(F.col("supplier_key") % 3 == 0, F.concat(F.lit("Pat Number"), "supplier_key")).otherwise(F.concat(F.lit("Supplier "), "supplier_key", F.lit(" Ltd")))
    return patterns.split_same_day(rows, 34700, codes.looks_like_person(F.regexp_replace(payee, "[0-9]", "x")))


P06B = """
WITH RECURSIVE s AS (SELECT user_id, CAST(ts AS DATE) AS day, CAST(value AS DECIMAL(18,2)) AS v FROM events WHERE event_type = 'purchase' AND CAST(value AS DECIMAL(18,2)) < 80 AND CAST(value AS DECIMAL(18,2)) <> 0),
d AS (SELECT user_id, day, row_number() OVER (PARTITION BY user_id ORDER BY day) AS r FROM (SELECT DISTINCT user_id, day FROM s)),
c AS (SELECT user_id, day, r, day AS anchor FROM d WHERE r = 1 UNION ALL SELECT d.user_id, d.day, d.r, CASE WHEN d.day - c.anchor <= 7 THEN c.anchor ELSE d.day END FROM c JOIN d ON d.user_id = c.user_id AND d.r = c.r + 1)
SELECT user_id, anchor, count(*) AS invoices, CAST(sum(v) AS DOUBLE) AS value FROM s JOIN c USING (user_id, day) GROUP BY ALL HAVING count(*) >= 2 AND sum(v) >= 80
"""


@query("p06b_split_clusters", P06B)
def p06b(spark, sf):
    rows = table(spark, sf, "events").where("event_type = 'purchase'").select("user_id", F.to_date("ts").alias("day"), F.col("value").cast("decimal(18,2)").alias("amount"))
    return patterns.split_clusters(rows, ["user_id"], "day", 80).withColumn("value", F.col("value").cast("double"))


_YE = "FROM items WHERE award_date IS NOT NULL AND amount <> 0 GROUP BY buyer, buyer_key HAVING count(*) >= 20 AND sum(amount) > 0"
_LATE = "coalesce(sum(amount) FILTER (month(award_date) = 3), 0)"


@query("p07_year_end_buyers", with_items(f"SELECT buyer_key, count(*) AS items, count(*) FILTER (month(award_date) = 3) AS last_month_items, round(CAST({_LATE} AS DOUBLE) / CAST(sum(amount) AS DOUBLE) * 12, 6) AS value {_YE} AND CAST({_LATE} AS DOUBLE) / CAST(sum(amount) AS DOUBLE) * 12 >= 1.5"))
def p07(spark, sf):
    return patterns.year_end(items(spark, sf, "id", "buyer_key", "buyer", "amount", "award_date"), ratio=1.5)[0].select("buyer_key", "items", "last_month_items", _r("value"))


@query("p07_year_end_items", with_items(f"SELECT id, CAST(amount AS DOUBLE) AS value FROM items WHERE month(award_date) = 3 AND (buyer, buyer_key) IN (SELECT (buyer, buyer_key) {_YE} AND CAST({_LATE} AS DOUBLE) / greatest(CAST(sum(amount) AS DOUBLE), 1) * 12 >= 1.5)"))
def p07b(spark, sf):
    return patterns.year_end(items(spark, sf, "id", "buyer_key", "buyer", "amount", "award_date"), ratio=1.5)[1].withColumn("value", F.col("value").cast("double"))


@query("p08_dominant_supplier", with_items("""
SELECT buyer_key, supplier_key, n AS part_count, round(CAST(a AS DOUBLE) / CAST(t AS DOUBLE), 6) AS value FROM (
  SELECT *, sum(a) OVER (PARTITION BY buyer, buyer_key) AS t, row_number() OVER (PARTITION BY buyer, buyer_key ORDER BY a DESC, supplier_key) AS r
  FROM (SELECT buyer, buyer_key, supplier_key, sum(amount) AS a, count(*) AS n FROM items WHERE amount <> 0 GROUP BY ALL))
WHERE r = 1 AND t >= 250000 AND CAST(a AS DOUBLE) / CAST(t AS DOUBLE) >= 0.1 AND n >= 2"""))
def p08(spark, sf):
    return patterns.dominant(items(spark, sf, "buyer_key", "buyer", "supplier_key", "amount"), share=0.1, awards=2).select("buyer_key", "supplier_key", "part_count", _r("value"))


_ODD = "(award_date > period_end OR (period_end - 14) - award_date > 1095)"


@query("p09_late_publication", with_items(f"SELECT id, CAST(period_end - award_date AS INTEGER) AS value FROM items WHERE NOT {_ODD} AND period_end - award_date > 90"))
def p09(spark, sf):
    return patterns.late_publication(items(spark, sf, "id", "award_date", "period_end").withColumn("period_start", F.date_sub("period_end", 14)))


@query("p10_date_check", with_items(f"SELECT id, award_date FROM items WHERE {_ODD}"))
def p10(spark, sf):
    rows = items(spark, sf, "id", "award_date", "period_end").withColumn("period_start", F.date_sub("period_end", 14))
    return rows.where(patterns.odd_dates(rows)).select("id", "award_date")


@query("p11_possible_duplicate", "SELECT l_suppkey AS supplier_key, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS invoice, CAST(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS DOUBLE) AS amount, count(DISTINCT l_orderkey) AS payments, count(*) AS times FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_orderkey) >= 2")
def p11(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("supplier_key"), F.col("l_quantity").cast("long").cast("string").alias("invoice"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"), F.col("l_orderkey").alias("payment_no"))
    return patterns.possible_duplicates(rows).withColumn("amount", F.col("amount").cast("double"))


@query("p12_over_allowance", "SELECT c_custkey, round(s - a, 2) AS value FROM (SELECT o_custkey AS c, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS s FROM orders GROUP BY 1) JOIN (SELECT c_custkey, c_acctbal * 100 AS a FROM customer) ON c = c_custkey WHERE s - a > 1")
def p12(spark, sf):
    spent = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("spent"))
    rows = table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") * 100).alias("allowance")).join(spent, "c_custkey")
    return patterns.over_allowance(rows).select("c_custkey", _r("value", 2))


def _pay(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("employer"), F.col("l_returnflag").alias("title"), F.year("l_shipdate").cast("long").alias("year"), F.col("l_quantity").cast("long").alias("overtime"), (F.col("l_tax") * 1000).cast("long").alias("base"), F.when(F.col("l_linenumber") == 7, F.col("l_quantity").cast("long")).alias("severance"))


_PAY = "(SELECT l_suppkey AS employer, l_returnflag AS title, year(l_shipdate) AS year, CAST(l_quantity AS BIGINT) AS overtime, CAST(trunc(l_tax * 1000) AS BIGINT) AS base, CASE WHEN l_linenumber = 7 THEN CAST(l_quantity AS BIGINT) END AS severance FROM lineitem)"


@query("p13_overtime_over_base", f"SELECT employer, title, year, count(*) AS people, CAST(sum(overtime) AS BIGINT) AS value FROM {_PAY} WHERE overtime > coalesce(base, 0) GROUP BY ALL")
def p13(spark, sf):
    pay = _pay(spark, sf)
    return patterns.pay_counts(pay, F.col("overtime") > F.coalesce("base", F.lit(0)), "overtime")


@query("p14_severance", f"SELECT employer, title, year, count(*) AS people, CAST(sum(severance) AS BIGINT) AS value FROM {_PAY} WHERE severance > 0 GROUP BY ALL")
def p14(spark, sf):
    return patterns.pay_counts(_pay(spark, sf), F.col("severance") > 0, "severance")


@query("p15_vague_description", "SELECT p_partkey FROM part WHERE len(string_split(p_type, ' ')) <= 2 AND length(p_type) < 18 AND NOT regexp_matches(p_type, '[0-9]')")
def p15(spark, sf):
    from ..functions.codes import vague

    return table(spark, sf, "part").where(vague(F.col("p_type"))).select("p_partkey")


@query("p16_flag_summary", with_items("SELECT method AS flag, count(*) AS items, count(DISTINCT buyer_key) AS subjects, CAST(sum(amount) FILTER (currency = 'CAD') AS DOUBLE) AS amount FROM items WHERE dataset = 'award' AND method <> 'Open call' GROUP BY method"))
def p16(spark, sf):
    rows = items(spark, sf, "id", "dataset", "currency", "buyer_key", "amount", "method")
    flagged = patterns.by_method(rows.where("dataset = 'award'"), patterns.EXCEPTIONS).select("id", F.col("method").alias("flag"))
    joined = rows.select("id", "buyer_key", "currency", "amount").join(flagged, "id")
    cad = F.sum(F.when(F.col("currency") == "CAD", F.col("amount"))).cast("double")
    return joined.groupBy("flag").agg(F.count("*").alias("items"), F.countDistinct("buyer_key").alias("subjects"), cad.alias("amount"))
