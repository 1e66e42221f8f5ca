"""Encoding cuts columns at spaces and single line ends, and learns new pieces together."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pennyweight.llm import encoding
from pennyweight.llm.encoding import default_vocabulary

from .test_encoding_resampling_manifest import AWKWARD

SIGNS = [" ", " ", " ", "\n", "\n", "  ", "\n\n", " \n", "\r\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "　", "a", "the", "é", "ß", "日本", "՘", "🙂", "1", "²", ".", ",", "'", "'s", "’s", "n't", "*", "***", "|", "_", "-", "<|endoftext|>"]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(default_vocabulary())


def ids(raw):
    return np.frombuffer(raw, "<u2").tolist()


@pytest.mark.parametrize("remembered, together", [(500_000, 8 << 20), (40, 100), (0, 1)])
def test_columns_give_the_ids_of_whole_texts(monkeypatch, reference, remembered, together):
    monkeypatch.setattr(encoding, "REMEMBERED", remembered)
    monkeypatch.setattr(encoding, "TOGETHER", together)
    made, r = encoding.Encoder(default_vocabulary()), random.Random(8)
    texts = AWKWARD + ["\n", "\na", "a\n", "\n\na", "a\n\n", "\n\n", "a\n\nb", "a\n\n\nb", "a \n\nb", "a\n\n b", "a\n\n's", "\n's", "a\n's b\n c\n", "a.\nB,\nc's\nd!?", "it's,", "x'", "x'.", "x.'s y"]
    texts += ["".join(r.choices(SIGNS, k=r.randint(1, 25))) for _ in range(2000)]
    want = [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]
    column = pa.array(["not taken", *texts]).slice(1)
    for given in (texts, column, column.cast(pa.large_string())):
        got = made.encode(given)
        assert [t for t, x, y in zip(texts, map(ids, got), want, strict=True) if x != y] == []
    assert len(made.known) <= remembered and made.encode([]) == []


def test_line_ends_need_no_call_each(reference):
    made, calls, r = encoding.Encoder(default_vocabulary()), [], random.Random(9)
    call = made._ids
    made._ids = lambda text: calls.append(text) or call(text)
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    text = "\n".join(f"{word()} {word()}.***" for _ in range(3000))
    assert ids(made.encode([text])[0]) == reference.encode(text, add_special_tokens=False).ids
    assert len(calls) <= 5
    blank = text.replace("\n", "\n\n")
    assert ids(made.encode([blank])[0]) == reference.encode(blank, add_special_tokens=False).ids
    assert len(calls) <= 10
    assert not any("\n" in p for p in [*made.known, *made.first])
