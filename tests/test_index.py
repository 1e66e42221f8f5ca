"""The index of terms on disk: what it finds, and what it reads."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from pennyweight.operators import index, searching


def test_search_finds_words_and_tags(spark, tmp_path):
    r = random.Random(2)
    words = ["road", "roads", "bridge", "éclair", "a1", "harbour", "har"]
    rows = [(f"d{k}", " ".join(r.choices(words, k=6)), r.sample([index.written_tag("year", str(y)) for y in (2020, 2021)] + [index.written_tag("flag", "sole-source")], 2)) for k in range(60)]
    docs = spark.createDataFrame([*rows, ("none", None, None), ("bare", "", [])], "doc_id string, body string, tags array<string>")
    found = index.build(docs, f"file://{tmp_path}/index")
    for asked, tags in ((["road"], []), (["har", "bridge"], [index.written_tag("year", "2021")]), (["eclair"], [index.written_tag("flag", "sole-source"), index.written_tag("year", "2020")]), ([], [index.written_tag("year", "2020")]), (["zzz"], [])):
        plain = {d: b.replace("é", "e").split() for d, b, _ in rows}
        want = {d for d, _, t in rows if all(any(w.startswith(a) for w in plain[d]) for a in asked) and set(tags) <= set(t)}
        assert {x["doc_id"] for x in index.search(found, asked, tags).collect()} == want
    assert index.search(found, []).collect() == []


def test_prefixes_reach_the_scan_and_files_hold_ranges(spark, tmp_path):
    docs = spark.range(3000).select(F.concat(F.lit("d"), "id").alias("doc_id"), F.concat_ws(" ", F.lit("common"), F.sha1(F.col("id").cast("string"))).alias("body"), F.array(F.lit("#zy2020")).alias("tags"))
    found = index.build(docs, f"file://{tmp_path}/index")
    plan = index.search(found, ["abc"], ["#zy2020"])._jdf.queryExecution().toString()
    assert "StringStartsWith(term,abc)" in plan and "EqualTo(term,#zy2020)" in plan
    ends = found.groupBy(F.input_file_name().alias("f")).agg(F.min("term").alias("low"), F.max("term").alias("high")).orderBy("low").collect()
    assert all(a["high"] <= b["low"] for a, b in zip(ends, ends[1:], strict=False))


def test_tags_are_what_is_asked_for(spark):
    values = {"dataset": "pa_tp", "level": "federal", "buyer": "Works", "supplier": "Acme", "name": "acme ltd", "person": "Jane Roe", "year": "2021", "item": "x-1", "flag": "sole-source"}
    row = spark.range(1).select(*(index.tag(k, F.lit(v)).alias(k) for k, v in values.items()), index.tag("year", F.lit("n/a")).alias("odd"), index.tag("buyer", F.lit("")).alias("blank")).first()
    assert {k: row[k] for k in values} == {k: index.written_tag(k, v) for k, v in values.items()}
    assert row["odd"] is None and row["blank"] is None


def test_words_by_decomposition(spark):
    texts = ["Évêque ﬁn ½ cup", "smørbrød straße", "I\u0307stanbul e\u0301t ㎏", "ŉ日本go", "plain", "", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "k long, text string")

    def words(t):
        kept = "".join(c for c in unicodedata.normalize("NFKD", t) if not "\u0300" <= c <= "\u036f").lower()
        return [w for w in re.split("[^a-z0-9]+", kept) if w]

    for x in searching.decomposed_words(frame, "text").collect():
        assert x["words"] == (None if x["text"] is None else words(x["text"])), x["text"]
