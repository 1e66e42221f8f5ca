"""The ledger: one line item per row, with a receipt, built from the star schema.

``items(spark, folder)`` gives the conformed model; ``ITEMS`` is the same
for SQL, and ``with_items`` puts it before a query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, ids
from .registry import table

#: Datasets that repeat what others already count; shown, never added up.
OVERLAP = ("notice",)

ITEMS = """
SELECT dataset || '-' || substr(sha1(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS BIGINT), price)), 1, 12) AS id, *
FROM (
  SELECT CASE l_returnflag WHEN 'A' THEN 'award' WHEN 'N' THEN 'contract' ELSE 'notice' END AS dataset,
         CASE l_linestatus WHEN 'F' THEN 'CAD' ELSE 'USD' END AS currency,
         c_custkey AS buyer_key, c_name AS buyer, n_name AS place, s_suppkey AS supplier_key, s_name AS supplier,
         p_name AS description, p_type AS category,
         CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 AND l_quantity < 10 THEN CAST(0 AS DECIMAL(18,2)) ELSE price END AS amount,
         CAST(o_orderdate AS DATE) AS award_date, CAST(l_shipdate AS DATE) AS period_end,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'Emergency' WHEN '4-NOT SPECIFIED' THEN 'Sole source' ELSE 'Open call' END AS method,
         year(CAST(l_shipdate AS DATE) - INTERVAL 3 MONTH) || '-' || lpad(CAST((year(CAST(l_shipdate AS DATE) - INTERVAL 3 MONTH) + 1) % 100 AS VARCHAR), 2, '0') AS fiscal_year,
         l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, price
  FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(18,2)) AS price FROM lineitem)
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN part ON l_partkey = p_partkey
)
"""


def with_items(sql: str) -> str:
    return f"WITH items AS ({ITEMS})\n{sql}"


#: What each dimension is needed for; keys have no orphans, so a join left out drops no row.
_FROM_ORDERS = {"buyer_key", "buyer", "place", "award_date", "method"}
_FROM_CUSTOMER = {"buyer", "place"}
_FROM_PART = {"description", "category"}


def items(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The conformed line items, or some of their columns.

    Spark does not drop an inner join whose columns go unused, so a query
    that names its columns gets only the joins that these need.
    """
    read = lambda name: table(spark, sf_dir, name)
    flag, line, priority = F.col("l_returnflag"), F.col("l_linenumber"), F.col("o_orderpriority")
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    dataset = F.when(flag == "A", "award").when(flag == "N", "contract").otherwise("notice")
    receipt = [F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")] + [F.col("l_quantity").cast("long"), price]
    fields = {
        "id": ids.item_id(dataset, *receipt),
        "dataset": dataset,
        "currency": F.when(F.col("l_linestatus") == "F", "CAD").otherwise("USD"),
        "buyer_key": F.col("o_custkey"),
        "buyer": F.col("c_name"),
        "place": F.col("n_name"),
        "supplier_key": F.col("l_suppkey"),
        "supplier": F.col("s_name"),
        "description": F.col("p_name"),
        "category": F.col("p_type"),
        "amount": F.when(line == 7, None).when((line == 6) & (F.col("l_quantity") < 10), F.lit(0).cast("decimal(18,2)")).otherwise(price),
        "award_date": F.to_date("o_orderdate"),
        "period_end": F.to_date("l_shipdate"),
        "method": F.when(priority == "1-URGENT", "Emergency").when(priority == "4-NOT SPECIFIED", "Sole source").otherwise("Open call"),
        "fiscal_year": dates.fiscal_year(F.to_date("l_shipdate")),
        **{c: F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")},
        "price": price,
    }
    wanted = set(columns or fields)
    # what adds least to a row comes first, and orders get what they refer to before: they are fewer than line items
    rows = read("lineitem")
    if wanted & _FROM_PART:
        rows = rows.join(read("part"), F.col("l_partkey") == F.col("p_partkey"))
    if "supplier" in wanted:
        rows = rows.join(read("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    if wanted & _FROM_ORDERS:
        orders = read("orders")
        if wanted & _FROM_CUSTOMER:
            customers = read("customer")
            if "place" in wanted:
                customers = customers.join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            orders = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        rows = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(*(c.alias(n) for n, c in fields.items() if n in wanted))
