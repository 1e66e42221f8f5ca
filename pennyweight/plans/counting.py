"""Counting once, and the identity operators (D-series)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes
from ..operators import agreements, once, repeats
from .ledger import items, with_items
from .registry import query, table

_L = "l_shipdate, l_partkey, l_linenumber, l_quantity, l_extendedprice"
_CON = "CASE WHEN l_quantity % 4 = 0 THEN '' WHEN l_quantity % 4 = 1 THEN 'PO# ' || l_suppkey WHEN l_quantity % 4 = 2 THEN 'po' || l_suppkey ELSE CAST(l_suppkey AS VARCHAR) END"
_KEY = "CASE WHEN l_quantity % 4 = 0 THEN '' ELSE CAST(l_suppkey AS VARCHAR) END"


def _contracts(spark, sf):
    """Items with a contract number in several spellings, and terms stated or missing."""
    q = F.col("l_quantity") % 4
    number = F.when(q == 0, "").when(q == 1, F.concat(F.lit("PO# "), "l_suppkey")).when(q == 2, F.concat(F.lit("po"), "l_suppkey")).otherwise(F.col("l_suppkey").cast("string"))
    return items(spark, sf, "id", "currency", "buyer_key", "supplier_key", "amount", "award_date", "method", "l_suppkey", "l_linenumber", "l_quantity").select(
        "id", "currency", "supplier_key", "buyer_key", "award_date", "amount", F.col("method").alias("description"), number.alias("contract_no"),
        F.when(F.col("l_linenumber") % 2 == 0, "N/A").otherwise("").alias("term"), F.lit("").alias("renewal"),
    )


@query("d01_latest_amendment", f"SELECT l_orderkey, l_suppkey, price AS amount, versions FROM (SELECT l_orderkey, l_suppkey, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS price, l_quantity, count(*) OVER w AS versions, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_shipdate DESC, l_partkey DESC, l_linenumber DESC, l_quantity DESC, l_extendedprice DESC) AS r FROM lineitem WHERE l_tax <= 0.06 OR l_suppkey % 10 = 0 WINDOW w AS (PARTITION BY l_orderkey, l_suppkey)) JOIN (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s, arg_max(l_tax, ({_L})) AS tax FROM lineitem WHERE l_tax <= 0.06 OR l_suppkey % 10 = 0 GROUP BY ALL) ON l_orderkey = o AND l_suppkey = s WHERE r = 1 AND tax <= 0.06")
def d01(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("amount", F.col("l_extendedprice").cast("decimal(18,2)"))
    out = once.latest_in_region(rows, ["l_orderkey", "l_suppkey"], [F.col(c) for c in _L.split(", ")], ["amount"], F.col("l_tax") <= 0.06, F.col("l_suppkey") % 10 == 0)
    return out.withColumn("amount", F.col("amount").cast("double"))


#: Grant rows: every order four times, as amendments; which rule joins them goes by the order's number.
_ROWS = """
SELECT o_orderkey * 10 + j AS seq, 'org' || o_custkey % 7 AS org,
       CASE WHEN k >= 6 THEN '' WHEN j % 2 = 0 THEN ' A-' || o_orderkey ELSE 'A-' || o_orderkey || ' ' END AS number,
       CASE WHEN k IN (1, 2, 3, 4, 5) AND j > 1 THEN 'new name of ' || o_custkey ELSE 'name of ' || o_custkey END AS recipient,
       CASE WHEN k IN (2, 6) THEN j + 1 WHEN k = 7 OR (k = 5 AND j = 3) THEN 0 ELSE j END AS amendment,
       CASE WHEN j = 3 THEN NULL ELSE '2024-0' || (9 - j) || '-01' END AS amended_on,
       'R' || (o_orderkey * 10 + CASE WHEN k = 0 THEN 9 - j ELSE j END) AS ref,
       CASE WHEN k IN (3, 4) AND j > 1 THEN '2021-01-01' WHEN k = 6 AND j = 3 THEN NULL ELSE '2020-01-01' END AS start,
       CASE WHEN k = 3 AND j = 2 THEN NULL WHEN k = 3 THEN 'Another Fund' WHEN k = 4 AND j > 1 THEN 'Another Fund' WHEN k = 6 AND j = 2 THEN 'HARBOUR works (' || o_custkey || ') | Travaux' ELSE 'Harbour Works ' || o_custkey || ' of ' || o_orderpriority END AS program,
       'Wharf' || CASE WHEN j = 1 THEN ' DBA' ELSE '' END AS title,
       CASE WHEN o_custkey % 7 IN (0, 3) AND j = 2 THEN -1 ELSE 1 END * (price + j) AS value,
       CASE WHEN j = 1 THEN 'B' || o_custkey WHEN j = 3 THEN ' ' END AS business_number
FROM (SELECT o_orderkey, o_custkey, o_orderpriority, CAST(o_totalprice AS DECIMAL(18,2)) AS price, o_orderkey % 8 AS k, unnest(range(4)) AS j FROM orders)"""
_CHANGING = ("org0", "org3")
_LETTERS = "regexp_replace(lower(split_part(coalesce({}, ''), '|', 1)), '[^a-z0-9]', '', 'g')"


@query("d02_agreements", f"""
WITH rows_ AS ({_ROWS}), content AS (
  SELECT *, trim(number) AS n, [recipient, coalesce(start, '?'), {_LETTERS.format("program")}, regexp_replace({_LETTERS.format("title")}, 'dba$', '')] AS content FROM rows_
), keyed AS (
  SELECT *, CASE WHEN n <> '' THEN 'n:' || n WHEN max(CASE WHEN n = '' AND amendment > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY org, n, content) = 1 THEN 'c:' || CAST(content AS VARCHAR) ELSE 'r:' || ref END AS agreement FROM content
), g AS (
  SELECT org, agreement, recipient, min(amendment) AS least, min(seq) AS seq, list(DISTINCT coalesce(start, '')) AS starts, list(DISTINCT left({_LETTERS.format("program")}, 15)) AS programs FROM keyed GROUP BY ALL
), homes AS (
  SELECT org, agreement, arg_min({{'r': recipient, 's': starts, 'p': programs}}, (CASE WHEN least > 0 THEN 1 ELSE 0 END, seq)) AS h FROM g
  WHERE agreement LIKE 'n:%' GROUP BY ALL HAVING count(*) FILTER (least <= 0) <= 1
), moved AS (
  SELECT g.org, g.agreement, recipient, CASE WHEN list_has_any(starts, h.s) OR list_has_any(programs, h.p) OR list_contains(programs, '') OR list_contains(h.p, '') THEN h.r ELSE recipient END AS into_
  FROM g LEFT JOIN homes ON g.org = homes.org AND g.agreement = homes.agreement
)
SELECT k.org, CASE WHEN k.agreement LIKE 'n:%' THEN substr(k.agreement, 3) ELSE '' END AS agreement_number,
       arg_max(k.recipient, (amendment, coalesce(amended_on, ''), ref, k.seq)) AS recipient, arg_max(ref, (amendment, coalesce(amended_on, ''), ref, k.seq)) AS ref, max(amendment) AS amendment,
       count(*) AS n_rows, CASE WHEN k.org IN {_CHANGING} THEN 'sum of ' || count(*) || ' amendment rows (department reports changes)' ELSE 'latest of ' || count(*) || ' rows (department reports running totals)' END AS how,
       CAST(CASE WHEN k.org IN {_CHANGING} THEN sum(value) ELSE arg_max(value, (amendment, coalesce(amended_on, ''), ref, k.seq)) END AS DOUBLE) AS amount,
       min(coalesce(start, '')) AS start, coalesce(arg_max(business_number, (amendment, coalesce(amended_on, ''), ref, k.seq)) FILTER (trim(business_number) <> ''), '') AS business_number
FROM keyed k JOIN moved m ON k.org = m.org AND k.agreement = m.agreement AND k.recipient = m.recipient
GROUP BY k.org, k.agreement, into_""")
def d02(spark, sf):
    """Grants to agreements: re-issued rows without a number, renamed recipients, changes or running totals."""
    table(spark, sf, "orders").createOrReplaceTempView("_d02_orders")
    sql = _ROWS.replace("FROM orders", "FROM _d02_orders").replace("unnest(range(4))", "explode(sequence(0, 3))")
    return agreements.agreements(spark.sql(sql), _CHANGING).withColumn("amount", F.col("amount").cast("double"))


@query("d03_latest_notice", "SELECT o_custkey, o_orderpriority, max(o_orderkey) AS o_orderkey, count(*) AS versions FROM orders GROUP BY ALL")
def d03(spark, sf):
    return once.keep_latest(table(spark, sf, "orders"), ["o_custkey", "o_orderpriority"], [F.col("o_orderkey")], ["o_orderkey"])


@query("d04_unit_scaling", with_items("SELECT place, fiscal_year, CAST(sum(amount) * 1000000 AS DOUBLE) AS amount FROM items WHERE dataset = 'notice' AND currency = 'CAD' GROUP BY ALL"))
def d04(spark, sf):
    return items(spark, sf, "dataset", "currency", "place", "amount", "fiscal_year").where("dataset = 'notice' AND currency = 'CAD'").groupBy("place", "fiscal_year").agg((F.sum("amount") * 1_000_000).cast("double").alias("amount"))


@query("d05_count_once", with_items(f"""
SELECT id, counted_id, CAST(printing AS INTEGER) AS printing FROM (
  SELECT id, first_value(id) OVER w AS counted_id, row_number() OVER w AS printing
  FROM (SELECT *, CASE WHEN k = '' OR currency <> 'CAD' OR amount IS NULL THEN id END AS alone FROM (SELECT *, {_KEY} AS k FROM items))
  WINDOW w AS (PARTITION BY k, supplier_key, amount, buyer_key, award_date, method, alone ORDER BY id))"""))
def d05(spark, sf):
    return once.repeats(_contracts(spark, sf), ["id"]).select("id", "counted_id", "printing")


@query("d05b_contract_keys", with_items(f"SELECT DISTINCT {_CON} AS printed, {_KEY} AS contract_key FROM items"))
def d05b(spark, sf):
    return _contracts(spark, sf).select(F.col("contract_no").alias("printed"), codes.contract_key(F.col("contract_no")).alias("contract_key")).distinct()


#: Printings: every order four times; which of them are one award goes by the order's number.
_PRINTINGS = """
SELECT o_orderkey * 10 + j AS id, o_orderkey, j, k, o_custkey AS supplier_key, price AS amount, CASE WHEN o_orderkey % 10 = 9 THEN 'USD' ELSE 'CAD' END AS currency,
       CASE WHEN k = 1 THEN o_orderkey || '-' || j WHEN j % 2 = 1 THEN 'PO# ' || o_orderkey ELSE CAST(o_orderkey AS TEXT) END AS contract_no,
       CAST(o_orderdate AS DATE) + CAST(CASE WHEN k = 0 THEN 0 ELSE 12 * j END AS INT) AS award_date, o_custkey % 7 AS buyer_key,
       CASE WHEN k = 0 THEN CASE WHEN j = 2 THEN 'SUPPLY, of ' ELSE 'Supply of ' END || o_orderpriority ELSE 'Part ' || j END AS description,
       CASE WHEN j = 3 THEN 'N/A' ELSE '' END AS term, '' AS renewal
FROM (SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority, CAST(o_totalprice AS DECIMAL(18,2)) AS price, o_orderkey % 4 AS k, unnest(range(1, 5)) AS j FROM orders)"""
#: Reviews: chains of corrections in every fourth order; in others 2 repeats 1, and 3 repeats 2, which no longer stands.
_REVIEWS = "SELECT id AS id_a, id + 1 AS id_b, CASE WHEN k = 2 THEN 'correction' ELSE 'repeat' END AS decision, 'review of ' || id AS evidence FROM printings WHERE (k = 2 AND j < 4) OR (k = 3 AND j < 3)"
_LINKED = f"""printings AS ({_PRINTINGS}), reviews AS ({_REVIEWS}), links AS (
  SELECT id, id - j + 1 AS "to", 'repeat' AS decision, '{repeats.AGREES}' AS evidence FROM printings WHERE k = 0 AND j > 1 AND currency = 'CAD'
  UNION ALL SELECT id, id + 1, 'correction', 'review of ' || id FROM printings WHERE k = 2 AND j < 4 AND currency = 'CAD'
  UNION ALL SELECT id, id - 1, 'repeat', 'review of ' || (id - 1) FROM printings WHERE k = 3 AND j = 2 AND currency = 'CAD'
)"""


def _printings(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("_printed_orders")
    sql = _PRINTINGS.replace("FROM orders", "FROM _printed_orders").replace("unnest(range(1, 5))", "explode(sequence(1, 4))").replace("AS TEXT", "AS STRING")
    rows = spark.sql(sql)
    rows.createOrReplaceTempView("_printings")
    return rows, spark.sql(_REVIEWS.replace("FROM printings", "FROM _printings"))


@query("d06_reviewed_decisions", f'WITH {_LINKED} SELECT id, "to", decision, evidence FROM links')
def d06(spark, sf):
    """What every repeated printing is counted with: reviewed pairs, corrections in chains, and equal details."""
    return repeats.links(*_printings(spark, sf))


@query("d07_pair_audit", f"""
WITH RECURSIVE {_LINKED}, walk(id, stop) AS (
  SELECT id, "to" FROM links UNION ALL SELECT w.id, l."to" FROM walk w JOIN links l ON w.stop = l.id
), roots AS (
  SELECT id, stop AS root FROM walk WHERE stop NOT IN (SELECT id FROM links)
), p AS (
  SELECT printings.*, coalesce(root, id) AS root, CASE WHEN k = 1 THEN contract_no ELSE CAST(o_orderkey AS VARCHAR) END AS number FROM printings LEFT JOIN roots USING (id)
)
SELECT a.id AS a, b.id AS b, a.supplier_key, CAST(a.amount AS DOUBLE) AS amount, a.currency, CAST(b.award_date - a.award_date AS INTEGER) AS days_apart,
       CASE WHEN a.root = b.root THEN 'count once' ELSE 'keep both' END AS decision,
       coalesce(r.evidence, CASE WHEN a.root = b.root THEN '{repeats.TOGETHER}' WHEN a.number <> b.number THEN '{repeats.NUMBERS}' ELSE '{repeats.DETAILS}' END) AS evidence
FROM p a JOIN p b ON a.supplier_key = b.supplier_key AND a.amount = b.amount AND a.currency = b.currency
 AND (a.award_date, a.id) < (b.award_date, b.id) AND b.award_date - a.award_date <= 31
LEFT JOIN reviews r ON r.id_a = least(a.id, b.id) AND r.id_b = greatest(a.id, b.id)""")
def d07(spark, sf):
    """Printings of one supplier, price and currency within 31 days, with the end of the chain each is counted with."""
    return repeats.pair_audit(*_printings(spark, sf)).withColumn("amount", F.col("amount").cast("double"))


@query("d15_group_key", with_items("SELECT place, arg_max(supplier_key, (n, v, -supplier_key)) AS supplier_key FROM (SELECT place, supplier_key, count(*) AS n, coalesce(sum(amount), 0) AS v FROM items GROUP BY ALL) GROUP BY place"))
def d15(spark, sf):
    by = items(spark, sf, "place", "supplier_key", "amount").groupBy("place", "supplier_key").agg(F.count("*").alias("n"), F.coalesce(F.sum("amount"), F.lit(0)).alias("v"))
    return by.groupBy("place").agg(F.max_by("supplier_key", F.struct("n", "v", -F.col("supplier_key"))).alias("supplier_key"))


@query("d19_net_change", with_items("SELECT supplier_key, CAST(sum(amount) AS DOUBLE) AS before, CAST(sum(CASE WHEN l_linenumber <> 1 THEN amount END) AS DOUBLE) AS after FROM items GROUP BY supplier_key HAVING sum(amount) IS DISTINCT FROM sum(CASE WHEN l_linenumber <> 1 THEN amount END)"))
def d19(spark, sf):
    rows = items(spark, sf, "supplier_key", "amount", "l_linenumber")
    total = lambda df: df.groupBy("supplier_key").agg(F.sum("amount").cast("double").alias("v"))
    return once.changed(total(rows), total(rows.where("l_linenumber <> 1")), ["supplier_key"], "v").drop("change")


@query("d19_split_movements", with_items("SELECT key, CAST(sum(before) AS DOUBLE) AS before, CAST(sum(after) AS DOUBLE) AS after, CAST(sum(coalesce(after, 0) - coalesce(before, 0)) AS DOUBLE) AS change FROM (SELECT CAST(supplier_key AS VARCHAR) AS key, amount AS before, NULL AS after FROM items WHERE amount IS NOT NULL UNION ALL SELECT supplier_key || CASE WHEN supplier_key % 5 = 0 AND l_linenumber < 3 THEN ' [split]' ELSE '' END, NULL, amount FROM items WHERE amount IS NOT NULL) GROUP BY key HAVING sum(before) IS DISTINCT FROM sum(after)"))
def d19b(spark, sf):
    """Two ledgers before and after suppliers were split: what moved, which must cancel out."""
    rows = items(spark, sf, "supplier_key", "amount", "l_linenumber").where("amount IS NOT NULL")
    own = F.col("supplier_key").cast("string")
    split = F.concat(own, F.when((F.col("supplier_key") % 5 == 0) & (F.col("l_linenumber") < 3), " [split]").otherwise(""))
    total = lambda key: rows.groupBy(key.alias("key")).agg(F.sum("amount").alias("v"))
    out = once.net_changes(total(own), total(split), ["key"], "v")
    return out.select("key", *(F.col(c).cast("double").alias(c) for c in ("before", "after", "change")))
