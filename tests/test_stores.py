"""The vector store through failures, and samples without dangling keys."""

import pytest
from pyspark.sql import functions as F

from pennyweight.operators import conform, samples
from pennyweight.sources import vectors


def wanted(spark, rows):
    return spark.createDataFrame(rows, "id long, text string").withColumn("hash", F.md5("text"))


def embed(df):
    return df.withColumn("vector", F.array(F.length("text").cast("double")))


def content(store):
    return {r["id"]: (r["vector"][0]) for r in store.held().collect()}


def test_a_failure_between_batches_is_resumed(spark, tmp_path):
    store = vectors.VectorStore(spark, f"file://{tmp_path}/v")
    assert content(store) == {}
    rows = [(k, "x" * (k + 1)) for k in range(40)]
    calls = []

    def failing(df):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("the service is down")
        return embed(df)

    with pytest.raises(RuntimeError):
        store.sync(wanted(spark, rows), failing, 10)
    before = content(store)
    assert 0 < len(before) < 40 and all(v == k + 1 for k, v in before.items())
    left = store.sync(wanted(spark, rows), embed, 10)
    assert left["embedded"] == 40 - len(before) and content(store) == {k: k + 1 for k in range(40)}
    assert store.sync(wanted(spark, rows), embed, 10) == {"embedded": 0, "deleted": 0, "batches": 0}


def test_changes_tombstones_and_refusals(spark, tmp_path):
    store = vectors.VectorStore(spark, f"file://{tmp_path}/v")
    store.sync(wanted(spark, [(1, "a"), (2, "bb"), (3, "c")]), embed)
    with pytest.raises(ValueError):
        store.sync(wanted(spark, [(k, "new") for k in range(9)]), embed, most=8)
    assert store.sync(wanted(spark, [(2, "bbb"), (3, "c"), (4, "")]), embed) == {"embedded": 2, "deleted": 1, "batches": 2}
    assert content(store) == {2: 3, 3: 1, 4: 0}
    half = tmp_path / "v" / "b000000000099"  # a batch that was not finished does not count
    half.mkdir()
    assert store.sync(wanted(spark, [(1, "a")]), embed)["deleted"] == 3 and content(store) == {1: 1}
    store.compact()
    assert content(store) == {1: 1} and len(store.batches()) == 1
    assert store.sync(wanted(spark, []), embed)["deleted"] == 1 and content(store) == {}


def test_samples_are_closed_and_repeatable(spark):
    rows = [(f"i{k}", "ab"[k % 2], k % 7, k % 5 or None, f"n{k % 5}{k % 2 if k % 5 == 1 else ''}", float(k)) for k in range(300)]
    items = spark.createDataFrame(rows, "id string, dataset string, buyer_key long, supplier_key long, name_key string, amount double").repartition(5)
    flags = spark.createDataFrame([("f", f"i{k}", "item", None) for k in range(0, 300, 10)] + [("g", None, "buyer", 3)], "flag string, id string, subject_type string, subject_key long")
    made = [{r["id"] for r in samples.chosen(items, flags, {"a": 12, "b": 6}, seed).collect()} for seed in (1, 1, 2)]
    assert made[0] == made[1] != made[2]
    assert "i297" in made[0]  # the largest record of buyer 3
    assert {f"i{k}" for k in range(300) if k % 5 == 1} <= made[0]  # a supplier of two names keeps all
    ids = spark.createDataFrame([(i,) for i in made[0]], "id string")
    buyers = spark.createDataFrame([(k,) for k in range(9)], "buyer_key long")
    out = samples.closed(ids, items, flags, buyers=(buyers, "buyer_key"))
    there = {r["id"] for r in out["items"].collect()}
    assert there == made[0] and all(r["id"] is None or r["id"] in there for r in out["flags"].collect())
    assert {r["buyer_key"] for r in out["buyers"].collect()} == {r["buyer_key"] for r in out["items"].collect()}


def test_projections_are_checked(spark):
    rows = spark.createDataFrame([(1, 0, "", None, "x")], "k long, n int, blank string, none string, name string")
    out = conform.conform(rows, "pay", {"person": "name", "amount": F.lit(None)}, ["k"], {"count": "n", "blank": "blank", "none": "none", "said": "name"}).first()
    assert out["extra"] == {"count": "0", "said": "x"} and out["person"] == "x" and out["buyer"] is None and out["id"].startswith("pay-")
    with pytest.raises(ValueError, match="vendor"):
        conform.conform(rows, "pay", {"vendor": "name"}, ["k"])
