"""Full-text search over postings, spelling, similarity and suggestions."""

from __future__ import annotations

import unicodedata
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import codes, ids, names

# Words that a query does not ask for.
STOP = "the and of for to in a an on at by with".split()
MOST_WORDS = 8
#: Similarity below this is no hit.
LEAST_COSINE = 0.42


def tokens(text: Column) -> Column:
    """Words of a text: marks taken off, lower case, split at all but letters and digits."""
    return F.filter(F.split(F.lower(codes.plain_letters(text)), "[^a-z0-9]+"), lambda w: w != "")


def query_words(q: str) -> list[str]:
    """What a query asks for: up to eight different words of two letters or more, without stop words."""
    found = [w for w in "".join(c if c.isalnum() else " " for c in names.ascii_letters(q).lower()).split() if len(w) >= 2 and w not in STOP]
    return list(dict.fromkeys(found))[:MOST_WORDS]


def decompositions(docs: DataFrame, text: str) -> dict[str, str]:
    """What each character beyond ASCII that the texts hold is read as: its letters without marks, or a break between words.

    The characters of a corpus are some thousand at most, whatever its size
    (Unicode itself bounds them), so they are collected and decomposed once.
    """
    found = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit("([^\\x00-\\x7F])"), F.lit(1)))).alias("c")).distinct()
    out = {}
    for (c,) in found.collect():
        parts = [x for x in unicodedata.normalize("NFKD", c) if not "\u0300" <= x <= "\u036f"]
        out[c] = "".join(x if x.isascii() else " " for x in parts)
    return out


def decomposed_words(docs: DataFrame, text: str, name: str = "words") -> DataFrame:
    """``docs`` with the words of a text by Unicode decomposition: letters that do not decompose split words."""
    read = decompositions(docs, text)
    single = {c: x for c, x in read.items() if len(x) == 1}
    gone = "".join(c for c, x in read.items() if not x)  # marks standing alone
    plain = F.translate(F.col(text), "".join(single) + gone, "".join(single.values()))
    for c, x in read.items():
        if len(x) > 1:
            plain = F.replace(plain, F.lit(c), F.lit(x))
    return docs.withColumn(name, F.filter(F.split(F.lower(plain), "[^a-z0-9]+"), lambda w: w != ""))


def asked(text: Column) -> Column:
    """The query words of a column of queries."""
    words = F.array_distinct(F.filter(tokens(text), lambda w: (F.length(w) >= 2) & ~w.isin(*STOP)))
    return F.slice(words, 1, MOST_WORDS)


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, doc_id, tf``: how often each word stands in each document."""
    return docs.select(key, F.explode(tokens(F.col(text))).alias("word")).groupBy("word", key).agg(F.count("*").alias("tf"))


def vocabulary(posted: DataFrame) -> DataFrame:
    """Words of three letters or more, without digits, with their document frequency."""
    return posted.groupBy("word").agg(F.count("*").alias("df")).where((F.length("word") >= 3) & ~F.col("word").rlike("[0-9]"))


def matching(posted: DataFrame, words: list[str], key: str = "doc_id") -> DataFrame:
    """Documents with every word, each as a prefix. Words meet postings by a filter of at most eight prefixes."""
    hit = F.array_compact(F.array(*(F.when(F.startswith("word", F.lit(w)), F.lit(k)) for k, w in enumerate(words))))
    hits = posted.where(" OR ".join(f"startswith(word, '{w}')" for w in words)).select(key, F.explode(hit).alias("k"))
    return hits.groupBy(key).agg(F.countDistinct("k").alias("n")).where(F.col("n") == len(words)).select(key)


def bm25(posted: DataFrame, words: list[str], key: str = "doc_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The published BM25 formula over postings, for whole words: ``doc_id, score``."""
    sizes = posted.groupBy(key).agg(F.sum("tf").alias("size"))
    whole = sizes.agg(F.count("*").alias("docs"), F.avg("size").alias("mean"))
    hits = posted.where(F.col("word").isin(words))
    df = hits.groupBy("word").agg(F.count("*").alias("df"))
    rows = hits.join(F.broadcast(df), "word").join(sizes, key).crossJoin(F.broadcast(whole))  # one row of totals
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    return rows.groupBy(key).agg(F.sum(idf * norm).alias("score"))


def spelling(vocab: DataFrame, word: str) -> DataFrame:
    """Known words near one that is not: one slip up to five letters, else two; the more frequent wins.

    Words under four letters, with digits, or known as a prefix have no suggestion.
    """
    most = 1 if len(word) <= 5 else 2
    if len(word) < 4 or any(c.isdigit() for c in word):
        return vocab.limit(0).select("word", "df", F.lit(0).alias("slips"))
    known = vocab.where(F.startswith("word", F.lit(word))).limit(1)
    near = vocab.where(F.abs(F.length("word") - len(word)) <= most).join(known.select(F.lit(1).alias("_k")), F.lit(True), "left_anti")
    near = near.withColumn("slips", names.slips_udf(F.col("word"), F.lit(word))).where(F.col("slips") <= most)
    return near.orderBy("slips", F.desc("df"), "word").limit(1).select("word", "df", "slips")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def similar(vectors: DataFrame, query: DataFrame, k: int = 50, least: float = LEAST_COSINE) -> DataFrame:
    """The ``k`` nearest rows by cosine of one query vector (a single row ``q``)."""
    scored = vectors.crossJoin(F.broadcast(query.limit(1)))  # one row
    out = scored.withColumn("cosine", cosine(F.col("embedding"), F.col("q"))).where(F.col("cosine") >= least)
    return out.orderBy(F.desc("cosine"), "vec_id").limit(k).drop("q")


def shorter_queries(words: list[str], most: int = 10) -> list[list[str]]:
    """Subsets of a query's words, longest first."""
    return [list(c) for n in range(len(words) - 1, 0, -1) for c in combinations(words, n)][:most]


def suggestions(posted: DataFrame, words: list[str], shown: int = 4) -> DataFrame:
    """Shorter queries that find something, in one pass over the postings of their words."""
    if len(words) < 2:
        return posted.sparkSession.createDataFrame([], "query string, results long")
    masks = F.array_compact(F.array(*(F.when(F.startswith("word", F.lit(w)), F.lit(w)) for w in words)))
    held = posted.where(" OR ".join(f"startswith(word, '{w}')" for w in words)).select("doc_id", F.explode(masks).alias("w")).groupBy("doc_id").agg(F.collect_set("w").alias("has"))
    tries = shorter_queries(words)
    each = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(" ".join(t)).alias("query"), (F.size(F.array_except(F.array(*map(F.lit, t)), "has")) == 0).alias("ok")) for k, t in enumerate(tries)))
    counted = held.select(F.inline(each)).where("ok").groupBy("k", "query").agg(F.count("*").alias("results"))
    return counted.orderBy("k").limit(shown).select("query", "results")


def pack(items: DataFrame, group: list[str], cap: int, order: list[str], fields: list[str]) -> DataFrame:
    """Search documents: at most ``cap`` items of a group each, with a content hash."""
    numbered = items.withColumn("_part", F.floor((F.row_number().over(W.partitionBy(*group).orderBy(*order)) - 1) / cap))
    out = numbered.groupBy(*group, "_part").agg(F.sort_array(F.collect_list(F.struct(*order, *fields))).alias("items"))
    return out.withColumn("doc_id", ids.text_hash(F.concat_ws("|", *group, "_part"), 16)).withColumn("hash", ids.text_hash(F.to_json("items"), 16)).withColumnRenamed("_part", "part")


def find(spark: SparkSession, posted: DataFrame, text: str, fallback: bool = True) -> tuple[DataFrame, list[str]]:
    """Exact search, then with spelling corrected where a word finds nothing."""
    words = query_words(text)
    if not words:
        return posted.limit(0).select("doc_id"), []
    hits = matching(posted, words)
    if fallback and not hits.take(1):
        vocab = vocabulary(posted)
        fixed = [(spelling(vocab, w).first() or {"word": w})["word"] for w in words]
        if fixed != words:
            return matching(posted, fixed), fixed
    return hits, words


def embedding_text(heads: list[Column], lists: list[Column], limit: int = 1200) -> Column:
    """What a document is about, most telling parts first: ``heads``, then each value of ``lists`` that is new in any case of letters.

    Values are sorted by their small letters, so that equal ones are neighbours, and back into their order.
    """
    some = lambda xs: F.filter(xs, lambda x: F.coalesce(F.trim(x) != "", F.lit(False)))
    once = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731  # a lambda makes what it names anew for each element, but not its own argument
    in_order = lambda rest: F.sort_array(F.transform(rest, lambda x, i: F.struct(F.lower(x).alias("low"), i.alias("at"), x.alias("x"))))
    leading = lambda s: F.filter(s, lambda e, i: ~F.get(s, i - 1)["low"].eqNullSafe(e["low"]))
    unsaid = lambda rest, said: F.filter(once(in_order(rest), leading), lambda e: ~F.array_contains(said, e["low"]))
    first = some(F.array(*heads))
    new = once(F.transform(first, lambda x: F.lower(x)), lambda said: F.sort_array(F.transform(unsaid(F.array_distinct(some(F.concat(*lists))), said), lambda e: F.struct(e["at"], e["x"]))))
    return F.substring(F.array_join(F.transform(F.concat(first, F.transform(new, lambda e: e["x"])), lambda x: F.trim(x)), ". "), 1, limit)


def packed_item(item: dict[str, Column], doc_buyer: Column, federal: Column, evidence: Column, longest: int = 320) -> Column:
    """An item as it is kept inside a document, without what the document says or what goes without saying.

    Null are the document's own buyer, the home currency, a fiscal year
    beside a date, and blanks.  Descriptions are clipped and empty or zero
    evidence is left out, except of federal items, which keep all of it.
    """
    said = lambda c: F.when(c != "", c)
    kept = F.map_filter(evidence, lambda _, v: federal | ~F.coalesce(v, F.lit("")).isin("", "0"))
    return F.struct(
        said(item["supplier"]).alias("supplier"),
        said(F.when(~item["buyer"].eqNullSafe(doc_buyer), item["buyer"])).alias("buyer"),
        said(F.when(federal, item["description"]).otherwise(codes.clip(item["description"], longest))).alias("description"),
        item["amount"].alias("amount"),
        F.when(item["currency"] != "CAD", item["currency"]).alias("currency"),
        item["date"].alias("date"),
        F.when(item["date"].isNull(), item["fiscal_year"]).alias("fiscal_year"),
        F.when(F.size(kept) > 0, kept).alias("evidence"),
    )
