"""Search (Q-series)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import ids
from ..operators import index
from ..operators import searching as S
from ..operators.lineage import shared_base, sorted_table
from .ledger import items, with_items
from .registry import query, table

_TOK = "list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^a-z0-9]+'), lambda w: w <> '')"
_POST = f"posted AS (SELECT word, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK}) AS word FROM documents) GROUP BY ALL)"


def posted(spark, sf, kept=False):
    """Postings of the documents; ``kept``: written once, for queries that read them several times."""
    found = S.postings(table(spark, sf, "documents"))
    return sorted_table(found, "word") if kept else found


@query("q01_pack_documents", with_items("SELECT supplier_key, currency, CAST((r - 1) // 40 AS BIGINT) AS part, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT supplier_key, currency, id, row_number() OVER (PARTITION BY supplier_key, currency ORDER BY id) AS r FROM items) GROUP BY ALL"))
def q01(spark, sf):
    packed = S.pack(items(spark, sf, "id", "currency", "supplier_key"), ["supplier_key", "currency"], 40, ["id"], [])
    return packed.select("supplier_key", "currency", "part", F.size("items").cast("long").alias("n"), F.array_join(F.transform("items", lambda i: i["id"]), ",").alias("ids"))


_N45 = with_items("""
, numbered AS (SELECT *, row_number() OVER (PARTITION BY dataset, supplier_key ORDER BY id) AS r FROM items),
parts AS (SELECT *, CAST((r - 1) // 40 AS BIGINT) AS part FROM numbered),
said AS (SELECT dataset, supplier_key, part, supplier, unnest([{'o': r, 'v': description}, {'o': 1000000000 + r, 'v': category}, {'o': 2000000000 + r, 'v': method}, {'o': 3000000000 + r, 'v': supplier}, {'o': 4000000000 + r, 'v': 'in ' || place}]) AS s FROM parts),
new AS (SELECT dataset, supplier_key, part, supplier, arg_min(s.v, s.o) AS v, min(s.o) AS o FROM said WHERE lower(s.v) NOT IN (lower(dataset), lower(supplier)) GROUP BY dataset, supplier_key, part, supplier, lower(s.v))
SELECT dataset, supplier_key, part, substr(dataset || '. ' || supplier || '. ' || string_agg(v, '. ' ORDER BY o), 1, 1200) AS text FROM new GROUP BY dataset, supplier_key, part, supplier
""")


@query("n45_embed_text", _N45)
def n45(spark, sf):
    rows = items(spark, sf, "id", "dataset", "supplier_key", "supplier", "description", "category", "method", "place")
    packed = S.pack(rows, ["dataset", "supplier_key"], 40, ["id"], ["supplier", "description", "category", "method", "place"])
    each = lambda c: F.col(f"items.{c}")
    places = F.transform("items.place", lambda p: F.concat(F.lit("in "), p))
    text = S.embedding_text([F.col("dataset"), F.col("items")[0]["supplier"]], [each("description"), each("category"), each("method"), each("supplier"), places])
    return packed.select("dataset", "supplier_key", "part", text.alias("text"))


_N54 = with_items("""
, docs AS (SELECT supplier_key, min(buyer) AS doc_buyer FROM items GROUP BY 1),
rows AS (SELECT *, dataset = 'contract' AS federal, CASE WHEN l_linenumber < 7 THEN award_date END AS day FROM items JOIN docs USING (supplier_key))
SELECT id, supplier, CASE WHEN buyer <> doc_buyer THEN buyer END AS buyer,
  CASE WHEN federal OR length(description) <= 20 THEN description ELSE regexp_replace(substr(description, 1, 20), '\\s+\\S*$', '') || '…' END AS description,
  CAST(amount AS DOUBLE) AS amount, CASE WHEN currency <> 'CAD' THEN currency END AS currency, day AS date, CASE WHEN day IS NULL THEN fiscal_year END AS fiscal_year,
  concat_ws(';', 'category=' || category, CASE WHEN federal OR l_linenumber > 1 THEN 'line=' || (l_linenumber - 1) END) AS evidence
FROM rows
""")


@query("n54_packed_item", _N54)
def n54(spark, sf):
    rows = items(spark, sf, "id", "dataset", "supplier_key", "supplier", "buyer", "description", "category", "amount", "currency", "award_date", "fiscal_year", "l_linenumber")
    own = items(spark, sf, "supplier_key", "buyer").groupBy("supplier_key").agg(F.min("buyer").alias("doc_buyer"))
    fields = {c: F.col(c) for c in ("supplier", "buyer", "description", "amount", "currency", "fiscal_year")} | {"date": F.when(F.col("l_linenumber") < 7, F.col("award_date"))}
    evidence = F.create_map(F.lit("category"), F.col("category"), F.lit("line"), (F.col("l_linenumber") - 1).cast("string"))
    packed = S.packed_item(fields, F.col("doc_buyer"), F.col("dataset") == "contract", evidence, 20)
    out = rows.join(own, "supplier_key").select("id", packed.alias("p")).select("id", "p.*")
    listed = F.array_join(F.transform(F.map_entries("evidence"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return out.withColumn("amount", F.col("amount").cast("double")).withColumn("evidence", listed)


@query("q02_tags", with_items("SELECT id, concat_ws(' ', 'd' || substr(sha1(dataset), 1, 10), 'b' || substr(sha1(CAST(buyer_key AS VARCHAR)), 1, 10), 's' || substr(sha1(CAST(supplier_key AS VARCHAR)), 1, 10), 'y' || substr(sha1(CAST(year(award_date) AS VARCHAR)), 1, 10)) AS tags FROM items"))
def q02(spark, sf):
    year = F.year("award_date").cast("string")
    return items(spark, sf, "id", "dataset", "buyer_key", "supplier_key", "award_date").select("id", F.concat_ws(" ", ids.tag("d", F.col("dataset")), ids.tag("b", F.col("buyer_key")), ids.tag("s", F.col("supplier_key")), ids.tag("y", year)).alias("tags"))


@query("q03_tokens", f"SELECT doc_id, len({_TOK}) AS n, len(list_distinct({_TOK})) AS n_distinct FROM documents")
def q03(spark, sf):
    t = S.tokens(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query("q03_decomposed_words", f"SELECT doc_id, len({_TOK}) AS n, len(list_distinct({_TOK})) AS n_distinct FROM documents")
def q03b(spark, sf):
    """Words by Unicode decomposition of the corpus's own characters."""
    found = S.decomposed_words(table(spark, sf, "documents").select("doc_id", "text"), "text")
    return found.select("doc_id", F.size("words").cast("long").alias("n"), F.size(F.array_distinct("words")).cast("long").alias("n_distinct"))


@query("q05_match_all_prefixes", f"WITH {_POST} SELECT doc_id FROM posted GROUP BY doc_id HAVING bool_or(starts_with(word, 'th')) AND bool_or(starts_with(word, 'erin'))")
def q05(spark, sf):
    return S.matching(posted(spark, sf), ["th", "erin"])


@query("q06_bm25", f"""
WITH {_POST}, sizes AS (SELECT doc_id, sum(tf) AS size FROM posted GROUP BY 1), t AS (SELECT count(*) AS docs, avg(size) AS mean FROM sizes),
h AS (SELECT *, count(*) OVER (PARTITION BY word) AS df FROM posted WHERE word IN ('the', 'erin', 'thin'))
SELECT doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score FROM h JOIN sizes USING (doc_id), t GROUP BY doc_id""")
def q06(spark, sf):
    return S.bm25(posted(spark, sf, kept=True), ["the", "erin", "thin"]).select("doc_id", F.round("score", 6).alias("score"))


@query("q07_items_in_documents", with_items("SELECT id FROM items WHERE currency = 'CAD' AND lower(description) LIKE '%a%' AND regexp_matches(lower(description), '(^|[^a-z0-9])b') AND dataset = 'award'"))
def q07(spark, sf):
    words = S.tokens(F.col("description"))
    rows = items(spark, sf, "id", "dataset", "currency", "description").where("currency = 'CAD' AND dataset = 'award'")
    return rows.where(F.contains("description", F.lit("a")) & F.exists(words, lambda w: F.startswith(w, F.lit("b")))).select("id")


_ASKED = ("thta", "wiht", "whcih", "andd", "teh")


@query("q08_spelling", f"""
WITH {_POST}, vocab AS (SELECT word, count(*) AS df FROM posted WHERE length(word) >= 3 AND NOT regexp_matches(word, '[0-9]') GROUP BY word),
asked AS (SELECT unnest({list(_ASKED)}) AS asked),
near AS (SELECT word, df, asked, damerau_levenshtein(word, asked) AS slips FROM vocab, asked
  WHERE length(asked) >= 4 AND damerau_levenshtein(word, asked) <= CASE WHEN length(asked) <= 5 THEN 1 ELSE 2 END
  AND NOT EXISTS (SELECT 1 FROM vocab v WHERE starts_with(v.word, asked)))
SELECT word, df, slips, asked FROM near QUALIFY row_number() OVER (PARTITION BY asked ORDER BY slips, df DESC, word) = 1""")
def q08(spark, sf):
    vocab = S.vocabulary(posted(spark, sf, kept=True))
    out = None
    for word in _ASKED:
        row = S.spelling(vocab, word).withColumn("asked", F.lit(word))
        out = row if out is None else out.unionByName(row)
    return out


@query("q09_cosine", "SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS cosine FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q WHERE list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) >= 0.42 ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, vec_id LIMIT 50")
def q09(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return S.similar(vectors, vectors.where("vec_id = 7").select(F.col("embedding").alias("q"))).select("vec_id", F.round("cosine", 6).alias("cosine"))


@query("q10_find", f"WITH {_POST} SELECT doc_id FROM posted GROUP BY doc_id HAVING bool_or(starts_with(word, 'that')) AND bool_or(starts_with(word, 'this'))")
def q10(spark, sf):
    return S.find(spark, posted(spark, sf, kept=True), "that this")[0]


@query("q11_suggestions", f"""
WITH {_POST}, d AS (SELECT doc_id, bool_or(starts_with(word, 'the')) AS a, bool_or(starts_with(word, 'das')) AS b, bool_or(starts_with(word, 'zzz')) AS c FROM posted GROUP BY 1)
SELECT query, results FROM (SELECT 'the das' AS query, count(*) FILTER (a AND b) AS results FROM d UNION ALL SELECT 'the', count(*) FILTER (a) FROM d UNION ALL SELECT 'das', count(*) FILTER (b) FROM d) WHERE results > 0""")
def q11(spark, sf):
    return S.suggestions(posted(spark, sf), ["the", "das", "zzz"])


@query("q12_get_item", with_items("SELECT id, supplier, CAST(amount AS DOUBLE) AS amount FROM items WHERE id = (SELECT min(id) FROM items)"))
def q12(spark, sf):
    rows = items(spark, sf, "id", "supplier", "amount")
    return rows.join(rows.agg(F.min("id").alias("id")), "id", "left_semi").select("id", "supplier", F.col("amount").cast("double").alias("amount"))


#: What makes a document, by dataset: the columns of a group, and the items it holds at most.
_RULES = {"award": (("supplier_key", "place"), 25), "contract": (("supplier_key",), 40), "notice": ((), 1)}
_PACKED = with_items("""
, g AS (
  SELECT *, concat_ws('|', dataset, CASE dataset WHEN 'award' THEN supplier_key || '|' || place WHEN 'contract' THEN CAST(supplier_key AS VARCHAR) ELSE id END) AS grp,
         CASE dataset WHEN 'award' THEN 25 WHEN 'contract' THEN 40 ELSE 1 END AS cap FROM items
), numbered AS (
  SELECT *, (row_number() OVER (PARTITION BY grp ORDER BY id) - 1) // cap AS part, count(*) OVER (PARTITION BY grp) AS size FROM g
), p AS (
  SELECT *, dataset || ':' || substr(sha1(grp), 1, 12) || CASE WHEN size > cap THEN ':' || part ELSE '' END AS doc_id FROM numbered
), said AS (
  SELECT doc_id, list_distinct(regexp_split_to_array(lower(string_agg(buyer || ' ' || supplier || ' ' || description || ' ' || method, ' ' ORDER BY id)), '[^a-z0-9]+')) AS words FROM p GROUP BY doc_id
), tagged AS (
  SELECT DISTINCT doc_id, unnest(list_concat(['#zds' || dataset, '#zlv' || CASE dataset WHEN 'award' THEN 'prov' ELSE 'fede' END, '#zb' || substr(sha1(CAST(buyer_key AS VARCHAR)), 1, 10), '#zs' || substr(sha1(CAST(supplier_key AS VARCHAR)), 1, 10),
    '#zy' || year(award_date), '#zi' || substr(sha1(id), 1, 10)],
    CASE WHEN supplier_key % 5 = 0 THEN ['#zn' || substr(sha1(lower(supplier)), 1, 10)] ELSE [] END, CASE WHEN dataset = 'award' THEN ['#zp' || substr(sha1(lower(buyer)), 1, 10)] ELSE [] END,
    CASE WHEN method = 'Sole source' THEN ['#zfsolesource'] ELSE [] END, CASE WHEN l_quantity >= 45 THEN ['#zflargeorder'] ELSE [] END)) AS tag FROM p
)""")


def _documents(spark, sf):
    rows = items(spark, sf, "id", "dataset", "buyer_key", "buyer", "place", "supplier_key", "supplier", "description", "method", "award_date", "l_quantity")
    tags = {
        "dataset": F.col("dataset"), "level": F.when(F.col("dataset") == "award", "provincial").otherwise("federal"), "buyer": F.col("buyer_key"), "supplier": F.col("supplier_key"),
        "name": F.when(F.col("supplier_key") % 5 == 0, F.col("supplier")), "person": F.when(F.col("dataset") == "award", F.col("buyer")), "year": F.year("award_date"), "item": F.col("id"),
    }
    flags = F.array_compact(F.array(F.when(F.col("method") == "Sole source", "sole-source"), F.when(F.col("l_quantity") >= 45, "large-order")))
    return index.documents(index.packed(rows, _RULES), [F.col(c) for c in ("buyer", "supplier", "description", "method")], tags, flags)


@query("q02_document_terms", f"{_PACKED} SELECT s.doc_id, n_words, tags FROM (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words FROM said) s JOIN (SELECT doc_id, string_agg(tag, ' ' ORDER BY tag) AS tags FROM tagged GROUP BY doc_id) t USING (doc_id)")
def q02b(spark, sf):
    """Documents by the rule of their dataset, with the words of their bodies and all kinds of tags."""
    words = F.size(F.array_distinct(S.tokens(F.col("body")))).cast("long")
    return _documents(spark, sf).select("doc_id", words.alias("n_words"), F.array_join("tags", " ").alias("tags"))


@query("q05_words_and_tags", f"{_PACKED} SELECT doc_id FROM said WHERE len(list_filter(words, lambda w: starts_with(w, 'so'))) > 0 AND len(list_filter(words, lambda w: starts_with(w, 'customer'))) > 0 AND doc_id IN (SELECT doc_id FROM tagged WHERE tag = '#zy1997') AND doc_id IN (SELECT doc_id FROM tagged WHERE tag = '#zflargeorder') AND doc_id IN (SELECT doc_id FROM tagged WHERE tag = '#zdscontract')")
def q05b(spark, sf):
    """Every word by prefix and every tag, from the index on disk."""
    found = index.build(_documents(spark, sf), f"{shared_base(spark).rstrip('/')}/index-{uuid.uuid4().hex}")
    tags = [index.written_tag(k, v) for k, v in (("year", "1997"), ("flag", "large-order"), ("dataset", "contract"))]
    return index.search(found, ["so", "customer"], tags)
