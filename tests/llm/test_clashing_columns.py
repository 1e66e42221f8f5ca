"""Extra columns, whatever their names, change nothing."""

import pytest
from pyspark.sql import functions as F

from pennyweight.llm import bpe, chat, importance, merkle, topk

from .test_operators import OPERATORS

NAMES = (
    "fp kept block n_words ref _t label tokens size s a b n k r at ids words chunk part shard kind answer body rest node component rank score weight row "
    "_tokens _block _epoch _block_rank _near_node _near_text _near_hash _part _at _index _base tree index digest level steps root subroot leaf message"
).split()
TEXT = "one two three four five six seven of the and " * 30
ROWS = [(1, TEXT, None), (1, TEXT, None), (2, TEXT + "more words of another end", "s"), (None, TEXT, "s"), (None, None, None), (3, "", "s"), (3, "x", "s"), (8, "a word of its own " * 20, "t")]
MORE = {
    "bpe": lambda d: bpe.decode(bpe.encode(d)),
    "importance": lambda d: importance.resample(d, d.sparkSession.createDataFrame([(1, TEXT)], "doc_id long, text string")),
    "merkle": lambda d: merkle.manifest(d),
}


def plain(df, columns):
    return sorted((tuple(str(r[c]) for c in columns) for r in df.collect()), key=repr)


def with_clashes(df):
    return df.withColumns({c: F.lit(7) for c in NAMES if c not in df.columns})


@pytest.mark.parametrize("name", sorted({*OPERATORS, *MORE} - {"scoring"}))
def test_values_with_clashing_columns(spark, name):
    run = {**OPERATORS, **MORE}[name]
    frame = spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumns({"lang": F.lit("en"), "n_chars": F.length("text")})
    bare, more = run(frame.coalesce(1)), run(with_clashes(frame.coalesce(1)))
    # numbers of pieces, sequences and paths are not the same from run to run
    own = [c for c in bare.columns if c not in ("sequence_id", "offset", "start", "length", "ids_crc32")] if name == "packing" else bare.columns
    if name == "packing":
        bare, more = (df.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("tokens")) for df in (bare, more))
        own = bare.columns
    assert plain(bare, own) == plain(more, own)


def test_chat_and_search_with_clashing_columns(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "[INST] x"), (None, 0, None, None), (2, 5, "assistant", "")], "conv_id long, turn long, role string, text string")
    bare, more = (chat.digests(chat.format_turns(df)) for df in (turns, with_clashes(turns)))
    assert plain(bare, bare.columns) == plain(more, bare.columns) and bare.count() == 3
    vectors = spark.createDataFrame([(k, [float(k % 5), 1.0, -0.5 * k]) for k in range(120)] + [(50, None), (None, [1.0, 2.0, 3.0])], "vec_id long, embedding array<double>")
    bare, more = (topk.top_k(topk.usable(df), "vec_id % 50 = 0") for df in (vectors, with_clashes(vectors)))
    assert plain(bare, bare.columns) == plain(more, bare.columns) and bare.count() == 15
