"""The corpus pipeline: five stages, each written as Parquet and read again.

1. Quality rules; rejected documents go.
2. Near-duplicates by SimHash (five words, similarity 0.8); the document of
   least id of each group stays.
3. Strings of 50 bytes or more that an earlier document holds go.
4. Sources are mixed to temperature weights: every document is used at
   least once, and no source more than twice as often as another.
5. Documents are packed into sequences of 1,024 tokens.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from pennyweight.llm import mixing, packing, quality, similar, suffixes
from pennyweight.llm.common import delete, made_since, materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Folders that the last stage's result is read from; they go when the next stage begins, whose input is written.
_held: list[str] = []


def _stage(make: Stage) -> Stage:
    @wraps(make)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        delete(spark, _held)
        mark = len(made_since(0))
        out = make(spark, docs, sf_dir)
        _held[:] = made_since(mark)
        return out

    return run_stage


@_stage
def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.keep_one(docs)


@_stage
def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.dedup_text(docs)


@_stage
def weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select(*docs.columns)


@_stage
def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality rules", rules),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("mixing to target weights", weights),
    ("packing", sequences),
]

#: Suffix sorting, XXH64 and the tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        mark = len(made_since(0))
        docs = materialise(made, "stage")
        delete(spark, before)
        before = made_since(mark)
    delete(spark, _held)
    return docs
