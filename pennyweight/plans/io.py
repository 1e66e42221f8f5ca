"""Sources and sinks, read and written for real (S- and K-series)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import once, samples
from ..operators.lineage import dropped, settle, shared_base, written
from ..sources import programs, ranges, readers, sinks, vectors
from ..streaming import incremental
from .ledger import items, with_items
from .registry import query, table


def _folder(spark) -> str:
    return f"{shared_base(spark).rstrip('/')}/io-{uuid.uuid4().hex}"


@query("s05_links", "SELECT page_id, len(regexp_extract_all(html, '(?i)href\\s*=\\s*[\"'']([^\"'']+)[\"'']')) AS n, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\\b.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS chars FROM pages")
def s05(spark, sf):
    n = F.size(F.regexp_extract_all("html", F.lit(r"""(?i)href\s*=\s*["']([^"']+)["']"""), F.lit(1)))
    return table(spark, sf, "pages").select("page_id", n.cast("long").alias("n"), F.length(readers.strip_tags(F.col("html"))).cast("long").alias("chars"))


#: Names with quotes, commas and line ends in them.
_AWKWARD = "CASE c_custkey % 5 WHEN 0 THEN c_name || ' \"' || c_mktsegment || '\"\n' || c_nationkey WHEN 1 THEN c_name || ',\n\n' WHEN 2 THEN '' ELSE c_name END"


@query("s06_csv_with_lines", f"SELECT c_custkey, name, CAST(row_number() OVER w + 1 + coalesce(sum(length(name) - length(replace(name, chr(10), ''))) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS csv_line FROM (SELECT c_custkey, {_AWKWARD.replace(chr(92) + 'n', chr(10))} AS name FROM customer) WINDOW w AS (ORDER BY c_custkey)")
def s06(spark, sf):
    """One file, read by many ranges: records with the lines they start at."""
    path = _folder(spark)
    rows = table(spark, sf, "customer").select("c_custkey", F.expr(_AWKWARD).alias("name"))
    rows.orderBy("c_custkey").coalesce(1).write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    read = ranges.csv_by_ranges(spark, path, ["c_custkey", "name"], range_bytes=4096)
    return read.select(F.col("c_custkey").cast("long").alias("c_custkey"), F.coalesce(F.nullif("name", F.lit('""')), F.lit("")).alias("name"), "csv_line")


@query("s07_json_lines", "SELECT p_partkey, p_name FROM part")
def s07(spark, sf):
    path = _folder(spark)
    sinks.write_json_lines(table(spark, sf, "part").select("p_partkey", "p_name"), path)
    return readers.json_lines(spark, path, "p_partkey long, p_name string")


@query("s14_latest_scalar", "SELECT max(ts) AS at, arg_max(value, (ts, event_id)) AS value FROM events WHERE event_type = 'purchase'")
def s14(spark, sf):
    rows = table(spark, sf, "events")
    return rows.where("event_type = 'purchase'").agg(F.max("ts").alias("at"), F.max_by("value", F.struct("ts", "event_id")).alias("value"))


@query("k01_csv_round_trip", "SELECT s_suppkey, s_name FROM supplier")
def k01(spark, sf):
    path = _folder(spark)
    sinks.write_csv(table(spark, sf, "supplier").select("s_suppkey", "s_name"), path)
    return readers.read_csv(spark, path, "s_suppkey", "s_name").select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name")


@query("k02_partitioned_table", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def k02(spark, sf):
    path = _folder(spark)
    sinks.write_table(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), path, "o_orderstatus")
    return spark.read.parquet(path).where("o_orderstatus = 'F'").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("k04_sync_twice", "SELECT 0 AS writes")
def k04(spark, sf):
    """A second synchronisation has nothing to write."""
    docs = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("h"))
    stored, wanted = docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 5 <> 0")
    after = sinks.apply_plan(stored, wanted, once.sync_plan(stored, wanted, "doc_id", "h"), "doc_id")
    return once.sync_plan(after, wanted, "doc_id", "h").agg(F.count("*").cast("int").alias("writes"))


@query("k06_json_shards", "SELECT CAST(CAST('0x' || substr(sha1(p_name), 1, 4) AS BIGINT) % 8 AS INTEGER) AS shard, count(*) AS n FROM part GROUP BY 1")
def k06(spark, sf):
    path = _folder(spark)
    sinks.write_shards(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", path, 8)
    return spark.read.json(path).groupBy("shard").agg(F.count("*").alias("n"))


@query("k09_baseline", "SELECT l_returnflag AS dataset, count(*) AS n FROM lineitem GROUP BY 1")
def k09(spark, sf):
    path = f"{_folder(spark)}/baseline"
    counts = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("dataset")).agg(F.count("*").alias("n"))
    sinks.commit_baseline(counts, path)
    return sinks.read_baseline(spark, path)


@query("x01_stream_keep_latest", "SELECT user_id, event_type, max(event_id) AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 GROUP BY ALL")
def x01(spark, sf):
    """The stream's table after all files is the batch's."""
    folder = _folder(spark)
    rows = table(spark, sf, "events").select(F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("key"), "user_id", "event_type", "ts", "event_id")
    rows.repartition(3).write.parquet(f"{folder}/in")
    lines = incremental.new_lines(spark, f"{folder}/in", "key string, user_id long, event_type string, ts timestamp_ntz, event_id long", files=2)
    incremental.keep_latest_into(lines, "key", "ts", f"{folder}/out", f"{folder}/state").awaitTermination()
    return sinks.read_baseline(spark, f"{folder}/out").select("user_id", "event_type", "event_id")


@query("k05_vector_store", "SELECT doc_id AS id, md5(t) AS hash, CAST(length(t) AS DOUBLE) AS x, CAST(length(t) - length(replace(t, 'e', '')) AS DOUBLE) AS y, 0 AS writes FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN text || '!' ELSE text END AS t FROM documents WHERE doc_id % 5 <> 0)")
def k05(spark, sf):
    """A store of vectors after documents were added, changed and taken away, each in batches; a run without changes writes nothing."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    hashed = lambda df: df.withColumn("hash", F.md5("text"))
    embed = lambda df: df.withColumn("vector", F.array(F.length("text").cast("double"), (F.length("text") - F.length(F.replace("text", F.lit("e")))).cast("double")))
    store, some = vectors.VectorStore(spark, f"{_folder(spark)}/vectors"), max(1, docs.count() // 2)
    store.sync(hashed(docs.where("id % 3 <> 0")), embed, some)
    wanted = hashed(docs.where("id % 5 <> 0").withColumn("text", F.when(F.col("id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))))
    store.sync(wanted, embed, some)
    writes = store.sync(wanted, embed, some)["batches"]
    return store.held().select("id", "hash", F.col("vector")[0].alias("x"), F.col("vector")[1].alias("y"), F.lit(writes).alias("writes"))


_KEEP = {"award": 40, "contract": 60, "notice": 20}
_SAMPLED = with_items(f"""
, i AS (SELECT id, dataset, buyer_key, supplier_key, CASE WHEN supplier_key % 3 = 0 THEN supplier || l_linenumber % 2 ELSE supplier END AS name_key, coalesce(amount, 0) AS amount, method, l_quantity FROM items),
f AS (SELECT 'sole-source' AS flag, id, 'item' AS subject_type, NULL AS subject_key FROM i WHERE method = 'Sole source' AND l_quantity > 45 UNION ALL SELECT 'busy-buyer', NULL, 'buyer', CAST(buyer_key AS VARCHAR) FROM i GROUP BY buyer_key HAVING count(*) >= 70),
m AS (SELECT id, dataset, id IN (SELECT id FROM f WHERE id IS NOT NULL) AS flagged, CASE dataset WHEN 'award' THEN 40 WHEN 'contract' THEN 60 ELSE 20 END AS n FROM i),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset, flagged ORDER BY md5(id || ':7'), id) AS r FROM m),
a AS (SELECT * FROM r WHERE flagged AND r <= n // 2),
b AS (SELECT r.* FROM r LEFT JOIN (SELECT dataset, count(*) AS taken FROM a GROUP BY 1) t USING (dataset) WHERE NOT flagged AND r <= n - coalesce(taken, 0)),
c AS (SELECT arg_max(id, (amount, id)) AS id FROM i WHERE CAST(buyer_key AS VARCHAR) IN (SELECT subject_key FROM f WHERE subject_type = 'buyer') GROUP BY buyer_key),
s AS (SELECT supplier_key FROM i GROUP BY 1 HAVING count(DISTINCT name_key) > 1 AND count(*) <= 60 ORDER BY sum(amount) DESC, supplier_key LIMIT 3),
k AS (SELECT id FROM a UNION SELECT id FROM b UNION SELECT id FROM c UNION SELECT id FROM i WHERE supplier_key IN (SELECT supplier_key FROM s))
""")


@query("k10_closed_sample", f"{_SAMPLED} SELECT 'items' AS what, id AS key FROM i WHERE id IN (SELECT id FROM k) UNION ALL SELECT 'flags', flag || ':' || coalesce(id, subject_key) FROM f WHERE id IS NULL OR id IN (SELECT id FROM k) UNION ALL SELECT DISTINCT 'buyers', CAST(buyer_key AS VARCHAR) FROM i WHERE id IN (SELECT id FROM k) UNION ALL SELECT DISTINCT 'suppliers', CAST(supplier_key AS VARCHAR) FROM i WHERE id IN (SELECT id FROM k)")
def k10(spark, sf):
    """A seeded sample with its flags, buyers and suppliers, written and read back."""
    read = items(spark, sf, "id", "dataset", "buyer_key", "supplier_key", "supplier", "amount", "method", "l_quantity", "l_linenumber")
    name = F.when(F.col("supplier_key") % 3 == 0, F.concat("supplier", (F.col("l_linenumber") % 2).cast("string"))).otherwise(F.col("supplier"))
    # the ledger's joins are made once, and the columns written that the sample is drawn from
    rows, step = written(read.select("id", "dataset", "buyer_key", "supplier_key", name.alias("name_key"), F.coalesce("amount", F.lit(0)).alias("amount"), "method", "l_quantity"))
    settle(spark)
    none = F.lit(None).cast("string")
    on_items = rows.where("method = 'Sole source' AND l_quantity > 45").select(F.lit("sole-source").alias("flag"), "id", F.lit("item").alias("subject_type"), none.alias("subject_key"))
    on_buyers = rows.groupBy("buyer_key").count().where("count >= 70").select(F.lit("busy-buyer").alias("flag"), none.alias("id"), F.lit("buyer").alias("subject_type"), F.col("buyer_key").cast("string").alias("subject_key"))
    flags, _ = written(on_items.unionByName(on_buyers))
    keyed = rows.withColumn("buyer_key", F.col("buyer_key").cast("string"))
    ids = samples.chosen(keyed, flags, _KEEP, 7)
    buyers = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("buyer_key"))
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("supplier_key"))
    path, out = _folder(spark), None
    keys = {"items": F.col("id"), "flags": F.concat_ws(":", "flag", F.coalesce("id", "subject_key")), "buyers": F.col("buyer_key"), "suppliers": F.col("supplier_key").cast("string")}
    for name_, df in samples.closed(ids, keyed, flags, buyers=(buyers, "buyer_key"), suppliers=(suppliers, "supplier_key")).items():
        sinks.write_table(df, f"{path}/{name_}")
        part = spark.read.parquet(f"{path}/{name_}").select(F.lit(name_).alias("what"), keys[name_].alias("key"))
        out = part if out is None else out.unionByName(part)
    dropped(spark, step)
    return out


@query("s20_program_reports", """
WITH o AS (SELECT o_orderkey AS id, o_custkey, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders),
p AS (
  SELECT id, 'CURRENT' AS account, '1.1.' || lpad(CAST(id % 100 AS VARCHAR), 2, '0') AS program_code, 'Roads And Bridges Northern Region' AS program, v + (v + 10) + (v * 2 + 10) - 500 AS parsed, 4 * v - 480 + CASE WHEN id % 7 = 0 THEN 90 ELSE 0 END AS printed, 3 AS details FROM o
  UNION ALL SELECT id, 'CAPITAL', '2.1.01', 'Wharves', v * 3, v * 3, 1 FROM o WHERE id % 2 = 0
)
SELECT 'report ' || id AS path, 'Department Of Works' AS department, account, program_code, program, CAST(parsed AS DOUBLE) AS parsed, CAST(printed AS DOUBLE) AS printed, CAST(details AS BIGINT) AS details, parsed = printed AS ok FROM p""")
def s20(spark, sf):
    """A report for every order: details below open objects, revenue, wrapped names, and totals of which some are wrong."""
    v, id_ = F.floor("o_totalprice").cast("long"), F.col("o_orderkey")
    wrong = F.when(id_ % 7 == 0, 90).otherwise(0)
    printed = {"v": v, "bay": v * 2 + 10, "gander": v + 10, "total": 4 * v - 480 + wrong, "three": v * 3, "extra": F.lit(5), "back": F.lit(-500)}
    amount = lambda label, x: F.concat(F.lit(label), F.lit("      "), F.col(x), F.lit("   "), F.col(x), F.lit("  "), programs.printed(F.lit(0)))
    first = [
        F.lit("DEPARTMENT OF WORKS"), F.lit("CURRENT"), F.concat(F.lit("    1.1."), F.lpad((id_ % 100).cast("string"), 2, "0"), F.lit(". ROADS AND BRIDGES")), F.lit("      - NORTHERN"), F.lit("        REGION"), F.lit(""),
        amount("      01. Salaries", "v"), amount("                  Overtime", "extra"), F.lit("      10. Grants and Subsidies:"), amount("                  Town of Gander", "gander"), amount("                  Town of Bay", "bay"),
        amount("      02. Revenue - Provincial", "back"), amount("      Total: Roads", "total"), amount("      AMOUNT TO BE VOTED", "v"),
    ]
    second = [F.lit("CAPITAL"), F.lit("  2.1.01. WHARVES"), F.lit("      11. Debt Expenses"), amount("                  Interest", "three"), amount("      Total: Wharves", "three")]
    texts = F.when(id_ % 2 == 0, F.array(*first, *second)).otherwise(F.array(*first))
    # reports are dealt out while each is one row, so their lines are not shuffled; in a set number of parts, since little is
    # shuffled and much is made of it
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    orders = table(spark, sf, "orders").select(F.concat(F.lit("report "), id_.cast("string")).alias("path"), "o_orderkey", "o_totalprice").repartition(parts, "path")
    shown = orders.select("path", "o_orderkey", *(programs.printed(x).alias(c) for c, x in printed.items()))
    lines = shown.select("path", F.posexplode(texts).alias("line", "value"))
    found = programs.program_checks(programs.program_rows(lines))
    return found.select("path", "department", "account", "program_code", "program", F.col("parsed_col1").alias("parsed"), F.col("printed_col1").alias("printed"), "details", "ok")
