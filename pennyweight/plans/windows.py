"""Windows, ranks, limits and set operations (W, L and U)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import once, totals
from .ledger import items, with_items
from .registry import query, table

_L = "l_shipdate, l_partkey, l_linenumber, l_quantity, l_extendedprice"


@query("w01_canonical_buyer", with_items("SELECT place, buyer FROM (SELECT place, buyer, row_number() OVER (PARTITION BY place ORDER BY count(*) DESC, buyer) AS r FROM items GROUP BY place, buyer) WHERE r = 1"))
def w01(spark, sf):
    counted = items(spark, sf, "buyer", "place").groupBy("place", "buyer").agg(F.count("*").alias("n"))
    order = W.partitionBy("place").orderBy(F.desc("n"), "buyer")
    return counted.withColumn("r", F.row_number().over(order)).where("r = 1").select("place", "buyer")


@query("w02_canonical_supplier", with_items("SELECT supplier_key, supplier FROM (SELECT supplier_key, supplier, row_number() OVER (PARTITION BY supplier_key ORDER BY count(*) DESC, supplier) AS r FROM items GROUP BY supplier_key, supplier) WHERE r = 1"))
def w02(spark, sf):
    return totals.most_common(items(spark, sf, "supplier_key", "supplier"), "supplier_key", "supplier")


@query("w03_keep_latest_contract", f"SELECT l_orderkey, l_suppkey, arg_max(CAST(l_extendedprice AS DECIMAL(18,2)), ({_L}))::DOUBLE AS amount, count(*) AS versions FROM lineitem GROUP BY ALL")
def w03(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("amount", F.col("l_extendedprice").cast("decimal(18,2)"))
    out = once.keep_latest(rows, ["l_orderkey", "l_suppkey"], [F.col(c) for c in _L.split(", ")], ["amount"])
    return out.withColumn("amount", F.col("amount").cast("double"))


@query("w04_keep_latest_notice", "SELECT user_id, event_type, event_id, versions FROM (SELECT user_id, event_type, event_id, count(*) OVER (PARTITION BY user_id, event_type) AS versions, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def w04(spark, sf):
    return once.keep_latest(table(spark, sf, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")], ["event_id"])


@query("w05_ordered_amendments", "SELECT user_id, event_type, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS chain FROM events GROUP BY ALL")
def w05(spark, sf):
    out = once.with_history(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"], [])
    return out.select("user_id", "event_type", F.size("history").cast("long").alias("n"), F.array_join(F.transform("history", lambda h: h["event_id"].cast("string")), ",").alias("chain"))


W06 = """
WITH RECURSIVE d AS (
  SELECT user_id, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE)) AS r
  FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS ts FROM events WHERE event_type = 'purchase')
), c AS (
  SELECT user_id, day, r, day AS anchor FROM d WHERE r = 1
  UNION ALL
  SELECT d.user_id, d.day, d.r, CASE WHEN d.day - c.anchor <= 7 THEN c.anchor ELSE d.day END FROM c JOIN d ON d.user_id = c.user_id AND d.r = c.r + 1
)
SELECT e.user_id, c.anchor, count(*) AS n FROM events e JOIN c ON e.user_id = c.user_id AND CAST(e.ts AS DATE) = c.day WHERE event_type = 'purchase' GROUP BY ALL
"""


@query("w06_anchored_clusters", W06)
def w06(spark, sf):
    rows = table(spark, sf, "events").where("event_type = 'purchase'").withColumn("day", F.to_date("ts"))
    return once.anchored_clusters(rows, ["user_id"], "day", 7, []).groupBy("user_id", "anchor").agg(F.count("*").alias("n"))


@query("w07_carry_forward", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS section FROM events")
def w07(spark, sf):
    order = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    heading = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return table(spark, sf, "events").select("event_id", F.last(heading, ignorenulls=True).over(order).alias("section"))


@query("w08_number_on_page", "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS BIGINT) AS line FROM events")
def w08(spark, sf):
    order = W.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    return table(spark, sf, "events").select("event_id", F.row_number().over(order).cast("long").alias("line"))


@query("w09_chunks", with_items("SELECT supplier_key, CAST((r - 1) // 40 AS BIGINT) AS chunk, count(*) AS n, min(id) AS first_id FROM (SELECT supplier_key, id, row_number() OVER (PARTITION BY supplier_key ORDER BY id) AS r FROM items) GROUP BY ALL"))
def w09(spark, sf):
    order = W.partitionBy("supplier_key").orderBy("id")
    rows = items(spark, sf, "id", "supplier_key").select("supplier_key", "id", F.floor((F.row_number().over(order) - 1) / 40).alias("chunk"))
    return rows.groupBy("supplier_key", "chunk").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("w10_year_over_year", with_items("SELECT place, fiscal_year, CAST(v AS DOUBLE) AS value, CAST(v - lag(v) OVER (PARTITION BY place ORDER BY fiscal_year) AS DOUBLE) AS change FROM (SELECT place, fiscal_year, sum(amount) AS v FROM items GROUP BY ALL)"))
def w10(spark, sf):
    by = items(spark, sf, "place", "amount", "fiscal_year").groupBy("place", "fiscal_year").agg(F.sum("amount").alias("v"))
    before = F.lag("v").over(W.partitionBy("place").orderBy("fiscal_year"))
    return by.select("place", "fiscal_year", F.col("v").cast("double").alias("value"), (F.col("v") - before).cast("double").alias("change"))


@query("w11_share_of_total", with_items("SELECT place, method, round(CAST(v AS DOUBLE) / CAST(sum(v) OVER (PARTITION BY place) AS DOUBLE), 6) AS share FROM (SELECT place, method, sum(amount) AS v FROM items GROUP BY ALL)"))
def w11(spark, sf):
    by = items(spark, sf, "place", "amount", "method").groupBy("place", "method").agg(F.sum("amount").alias("v"))
    return by.select("place", "method", F.round(F.col("v").cast("double") / F.sum("v").over(W.partitionBy("place")).cast("double"), 6).alias("share"))


@query("w12_rank_in_currency", with_items("""
SELECT dataset, currency, supplier_key, value, CAST(rank AS BIGINT) AS rank, total_groups, total_groups > 10 AS truncated FROM (
  SELECT dataset, currency, supplier_key, CAST(sum(amount) AS DOUBLE) AS value,
         row_number() OVER (PARTITION BY dataset, currency ORDER BY CAST(sum(amount) AS DOUBLE) DESC NULLS LAST, supplier_key) AS rank,
         count(*) OVER (PARTITION BY dataset, currency) AS total_groups
  FROM items GROUP BY dataset, currency, supplier_key) WHERE rank <= 10"""))
def w12(spark, sf):
    out = totals.ranked(totals.group_totals(items(spark, sf, "dataset", "currency", "supplier_key", "amount"), "supplier_key"), 10, "supplier_key")
    return out.select("dataset", "currency", "supplier_key", "value", F.col("rank").cast("long").alias("rank"), "total_groups", "truncated")


@query("l01_largest", with_items("SELECT id, CAST(amount AS DOUBLE) AS amount FROM items ORDER BY items.amount DESC NULLS LAST, id LIMIT 100"))
def l01(spark, sf):
    return items(spark, sf, "id", "amount").orderBy(F.col("amount").desc_nulls_last(), "id").limit(100).select("id", F.col("amount").cast("double").alias("amount"))


@query("l02_offset", with_items("SELECT id FROM items ORDER BY id LIMIT 1 OFFSET 500"))
def l02(spark, sf):
    return items(spark, sf, "id").select("id").orderBy("id").offset(500).limit(1)


@query("l03_page_plus_one", with_items("SELECT id FROM items WHERE method = 'Emergency' ORDER BY award_date DESC, id LIMIT 26"))
def l03(spark, sf):
    return items(spark, sf, "id", "award_date", "method").where("method = 'Emergency'").orderBy(F.desc("award_date"), "id").limit(26).select("id")


@query("l05_top_per_group", with_items("SELECT supplier_key, id FROM (SELECT supplier_key, id, row_number() OVER (PARTITION BY supplier_key ORDER BY amount DESC NULLS LAST, id) AS r FROM items) WHERE r <= 40"))
def l05(spark, sf):
    order = W.partitionBy("supplier_key").orderBy(F.col("amount").desc_nulls_last(), "id")
    return items(spark, sf, "id", "supplier_key", "amount").withColumn("r", F.row_number().over(order)).where("r <= 40").select("supplier_key", "id")


@query("l06_by_difference", with_items("SELECT place, CAST(d AS DOUBLE) AS difference FROM (SELECT place, sum(CASE WHEN dataset = 'award' THEN amount ELSE 0 END) - sum(CASE WHEN dataset = 'contract' THEN amount ELSE 0 END) AS d FROM items GROUP BY place) ORDER BY abs(d) DESC, place LIMIT 10"))
def l06(spark, sf):
    part = lambda d: F.sum(F.when(F.col("dataset") == d, F.col("amount")).otherwise(0))
    out = items(spark, sf, "dataset", "place", "amount").groupBy("place").agg((part("award") - part("contract")).alias("d"))
    return out.orderBy(F.desc(F.abs("d")), "place").limit(10).select("place", F.col("d").cast("double").alias("difference"))


@query("l07_remainder_row", with_items("""
SELECT CASE WHEN k <= 5 THEN place ELSE 'more' END AS name, count(*) AS places, CAST(sum(v) AS DOUBLE) AS value
FROM (SELECT place, sum(amount) AS v, row_number() OVER (ORDER BY sum(amount) DESC, place) AS k FROM items GROUP BY place) GROUP BY 1"""))
def l07(spark, sf):
    by = items(spark, sf, "place", "amount").groupBy("place").agg(F.sum("amount").alias("v"))
    top = by.orderBy(F.desc("v"), "place").limit(5).select(F.col("place").alias("top"))
    named = by.join(top, F.col("place") == F.col("top"), "left").withColumn("name", F.coalesce("top", F.lit("more")))
    return named.groupBy("name").agg(F.count("*").alias("places"), F.sum("v").cast("double").alias("value"))


@query("u01_union_sources", "SELECT source, key, count(*) AS n FROM (SELECT 'orders' AS source, o_orderstatus AS key FROM orders UNION ALL SELECT 'lines', l_returnflag FROM lineitem UNION ALL SELECT 'events', event_type FROM events) GROUP BY ALL")
def u01(spark, sf):
    one = lambda name, source, key: table(spark, sf, name).select(F.lit(source).alias("source"), F.col(key).alias("key"))
    rows = one("orders", "orders", "o_orderstatus").unionByName(one("lineitem", "lines", "l_returnflag"), allowMissingColumns=True).unionByName(one("events", "events", "event_type"))
    return rows.groupBy("source", "key").agg(F.count("*").alias("n"))


@query("u02_distinct", with_items("SELECT DISTINCT place, method FROM items"))
def u02(spark, sf):
    return items(spark, sf, "place", "method").select("place", "method").distinct()


@query("u03_key_union", "SELECT coalesce(a.k, b.k) AS key, a.n AS before, b.n AS after FROM (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) a FULL JOIN (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40 GROUP BY 1) b ON a.k = b.k")
def u03(spark, sf):
    rows = table(spark, sf, "lineitem")
    a = rows.where("l_returnflag = 'A'").groupBy(F.col("l_suppkey").alias("key")).agg(F.count("*").alias("before"))
    b = rows.where("l_returnflag = 'R' AND l_quantity > 40").groupBy(F.col("l_suppkey").alias("key")).agg(F.count("*").alias("after"))
    return a.join(b, "key", "full_outer")


@query("u04_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def u04(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("u05_intersection", "SELECT c_custkey FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def u05(spark, sf):
    rich = table(spark, sf, "customer").where("c_acctbal > 5000").select("c_custkey")
    return rich.intersect(table(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")))


@query("u06_content_dedupe", "SELECT sha256(text) AS sha, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def u06(spark, sf):
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("u07_revised_supersedes", "SELECT o_custkey, o_orderdate, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY (o_orderstatus = 'F') DESC, o_orderkey DESC) AS r FROM (SELECT o_custkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderkey, o_orderstatus FROM orders)) WHERE r = 1")
def u07(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", F.to_date("o_orderdate").alias("o_orderdate"), "o_orderkey", (F.col("o_orderstatus") == "F").alias("revised"))
    return once.keep_latest(rows, ["o_custkey", "o_orderdate"], [F.col("revised"), F.col("o_orderkey")], ["o_orderkey"]).drop("versions")
