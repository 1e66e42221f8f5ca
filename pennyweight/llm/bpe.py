"""Byte-level BPE: whole texts to identifiers, and identifiers back to texts.

A text is cut where the vocabulary's pattern cuts it; the merges of a word
(one piece of the pattern) run on a contiguous array.  A word's parts lie
side by side, so the boundaries are the gaps between neighbours; beside
them stands the rank of joining each part with the next.  The least rank
is found by scanning, its boundary is deleted, and the ranks of the two
neighbouring gaps are refreshed, until no gap has a rank.  New words of a
batch take their steps together, one row of the array to a word.  Scanning
takes the square of a word's length, so words over ``LONG`` bytes keep the
same order of merges (least rank, leftmost first) in a heap over linked
parts.

A process remembers a bounded number of words; the rest are merged anew.
Tables come from the tokenizer file, and texts are encoded whole: strings
of added tokens become their single identifiers, as the library does it.

Defined results: a null text is an empty one, which has no identifiers;
rows with a null or repeated ``doc_id`` are encoded each for itself; an
empty table gives none.  Decoding leaves out null and unknown identifiers,
as the library does, and writes bytes that are no UTF-8 as U+FFFD.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import ranges, release, texts
from .encoding import default_vocabulary
from .tokenfiles import slices

#: The pattern of the byte-level pre-tokenizer of this family of files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes from which the heap takes over, words a process remembers, a rank above all.
LONG = 64
REMEMBERED = 400_000
NEVER = np.iinfo(np.int32).max
#: Words that take their steps together, and documents encoded together.
ROWS = 4096
TOGETHER = 256
#: Identifiers decoded at once.
GATHERED = 200_000
#: The pattern always cuts before a single space between two other characters.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_RUN = re.compile(r"\s\s")

_made: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The process's codec for a vocabulary file."""
    if path not in _made:
        _made[path] = Codec(path)
    return _made[path]


def shown_bytes() -> dict[int, str]:
    """How such files write bytes: printable ones as themselves, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in plain else next(others)) for b in range(256)}


class Codec:
    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        model, pre = parts["model"], parts.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model.get("type") != "BPE" or odd or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or parts.get("normalizer"):
            raise ValueError(f"{path}: not a plain byte-level BPE file ({', '.join(odd) or 'kind of model'})")
        byte_of = {c: b for b, c in shown_bytes().items()}
        vocab = model["vocab"]
        added = {t["content"]: t["id"] for t in parts.get("added_tokens") or ()}
        table: list[bytes] = [b""] * (1 + max([*vocab.values(), *added.values()]))
        for token, number in vocab.items():
            table[number] = bytes(byte_of[c] for c in token)
        for token, number in added.items():
            table[number] = token.encode()
        self.row = np.frombuffer(b"".join(table), np.uint8)
        self.starts = np.r_[0, np.cumsum(np.fromiter(map(len, table), np.int64, len(table)))]
        self.bytes = np.array([vocab[c] for _, c in sorted(shown_bytes().items())], np.int32)
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        self.joined = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self._place(np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64))
        self.added = added
        self.stops = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.pattern = regex.compile(PATTERN)
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        self.agreed = set(map(chr, range(128)))
        self.pieces: dict[str, bytes] = {}  # of the pattern
        self.known: dict[str, bytes] = {}  # by word, without the space before it
        self.first: dict[str, bytes] = {}  # of words that start a text

    def _place(self, keys: np.ndarray) -> None:
        """The ranks of pairs of neighbours, in an open table with few collisions."""
        bits = max(8, int(len(keys)).bit_length() + 3)
        self.shift = np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NEVER, np.int32)
        self.probes, left = 0, np.arange(len(keys))
        while len(left):  # all that meet at a place but one go on to the next
            at = (self._hash(keys[left]) + self.probes) & (len(self.keys) - 1)
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left[free]]
            in_ = self.keys[at] == keys[left]
            self.values[at[in_]] = left[in_]
            left = left[~in_]
            self.probes += 1

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of joining each part with its neighbour; ``NEVER`` where they don't join."""
        keys = (left.astype(np.int64) << 32 | right).ravel()
        home = self._hash(keys)
        out = np.full(len(keys), NEVER, np.int32)
        todo = np.arange(len(keys))
        for step in range(self.probes):
            at = (home[todo] + step) & (len(self.keys) - 1)
            there = self.keys[at]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            todo = todo[~hit & (there >= 0)]
            if not len(todo):
                break
        return out.reshape(left.shape)

    def scan(self, words: list[bytes]) -> list[bytes]:
        """All merges of short words: a column of parts and ranks to each, a merge in each column at a step."""
        out = [b""] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        for start in range(0, len(order), ROWS):
            some = order[start : start + ROWS]
            sizes = lengths[some]
            width = int(sizes[-1])
            parts = np.full((len(some), width), -1, np.int32)
            parts[np.arange(width) < sizes[:, None]] = self.bytes[np.frombuffer(b"".join([words[k] for k in some]), np.uint8)]
            parts = np.vstack([parts.T, np.full((1, len(some)), -1, np.int32)])
            ranks = np.full(parts.shape, NEVER, np.int32)  # a part without a next one has no rank
            pairs = parts[1:] >= 0
            ranks[:-1][pairs] = self.rank(parts[:-1][pairs], parts[1:][pairs])
            place = np.arange(width, dtype=np.int32)[:, None]
            while True:
                least = ranks.min(axis=0)
                going = np.flatnonzero(least < NEVER)
                if not len(going):
                    break
                gap = np.full(parts.shape[1], width, np.int32)  # nothing goes where a word is done
                gap[going] = ranks[:, going].argmin(axis=0)
                at = gap[going]
                parts[at, going] = self.joined[least[going]]
                parts[:-1] = np.where(place > gap, parts[1:], parts[:-1])  # the boundary goes,
                ranks[:-1] = np.where(place >= gap, ranks[1:], ranks[:-1])  # and the rank that stood at it
                for where, inside in ((at - 1, at > 0), (at, parts[at + 1, going] >= 0)):
                    r, c = where[inside], going[inside]
                    ranks[r, c] = self.rank(parts[r, c], parts[r + 1, c])
            flat, held = parts.T, (parts >= 0).sum(axis=0)
            raw = flat[flat >= 0].astype("<i4").tobytes()
            ends = (4 * np.cumsum(held)).tolist()
            for k, a, b in zip(some.tolist(), [0, *ends], ends, strict=False):
                out[k] = raw[a:b]
        return out

    def heap(self, word: bytes) -> bytes:
        """The same merges for a long word: gaps wait in a heap, some 100 bytes of memory to a byte of word."""
        parts = self.bytes[np.frombuffer(word, np.uint8)]
        end = len(parts)
        ranks = self.rank(parts[:-1], parts[1:])
        at = np.flatnonzero(ranks < NEVER)
        waiting = (ranks[at].astype(np.int64) << 32 | at).tolist()
        heapq.heapify(waiting)
        parts, after, before = parts.tolist(), list(range(1, end + 1)), list(range(-1, end - 1))
        joined, seen = self.joined, {}

        def rank(left: int, right: int) -> int:
            key = parts[left] << 32 | parts[right]
            if key not in seen:
                seen[key] = int(self.rank(np.array([parts[left]]), np.array([parts[right]]))[0])
            return seen[key]

        while waiting:
            least, k = divmod(heapq.heappop(waiting), 1 << 32)
            other = after[k]
            if parts[k] < 0 or other == end or rank(k, other) != least:
                continue  # one of the two has been merged since
            parts[k], parts[other] = int(joined[least]), -1
            after[k] = other = after[other]
            if other < end:
                before[other] = k
            for left, right in ((before[k], k), (k, other)):
                if left >= 0 and right < end and (r := rank(left, right)) < NEVER:
                    heapq.heappush(waiting, r << 32 | left)
        return np.array([p for p in parts if p >= 0], "<i4").tobytes()

    def cut(self, text: str) -> list[str]:
        """The pieces of the pattern.  Where the regex library's Unicode tables and the
        tokenizer's differ on a character of the text, the tokenizer's own splitter cuts it."""
        if not text.isascii():
            for c in set(text) - self.agreed:
                probe = f"a{c}1{c}!{c} {c}z"
                if self.pattern.findall(probe) != self._by_splitter(probe):
                    return self._by_splitter(text)
                self.agreed.add(c)
        return self.pattern.findall(text)

    def _by_splitter(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]

    def _merge(self, pieces: list[str]) -> dict[str, bytes]:
        """The identifiers of pieces; some of the new ones are remembered."""
        known = self.pieces
        all_ = set(pieces)
        out = {p: known[p] for p in all_ if p in known}
        new = list(all_.difference(out))
        raw = [p.encode("utf-8", "surrogatepass") for p in new]
        if len(long_ := [k for k, x in enumerate(raw) if len(x) > LONG]):
            for k in long_:
                out[new[k]] = self.heap(raw[k])
            gone = set(long_)
            new, raw = ([x for k, x in enumerate(some) if k not in gone] for some in (new, raw))
        merged = dict(zip(new, self.scan(raw), strict=True))
        if len(known) + len(merged) <= REMEMBERED // 2:
            known.update(merged)
        out.update(merged)
        return out

    def _learn(self, words: list[str], space: str) -> dict[str, bytes]:
        """The identifiers of words (with the space before them), each cut by the pattern."""
        apart = {w for w in words if " " in w or w.strip() != w or not w} if space else set(words)
        plain = [w for w in words if w not in apart] if apart else words
        # in a row, every piece that starts with a space starts the next word
        pieces = self.cut(space + space.join(plain)) if plain else []
        starts = [k for k, p in enumerate(pieces) if p[0] == " "]
        if len(starts) != len(plain):
            raise AssertionError("pieces and words do not fit")
        others = {w: self.cut(space + w) for w in apart}
        ids = self._merge(pieces + [p for some in others.values() for p in some])
        codes = list(map(ids.__getitem__, pieces))
        out = {w: codes[a] if b - a == 1 else b"".join(codes[a:b]) for w, a, b in zip(plain, starts, [*starts[1:], len(pieces)], strict=False)}
        out.update((w, b"".join(map(ids.__getitem__, some))) for w, some in others.items())
        return out

    def _fill(self, table: dict[str, bytes], words: list[str], space: str, most: int) -> dict[str, bytes]:
        new = self._learn(words, space)
        if len(table) + len(new) <= most:
            table.update(new)
        return new

    def encode(self, texts: list[str]) -> list[bytes]:
        """The identifiers of whole texts, as little-endian integers of 32 bits."""
        if self.stops is None or not any(a in t for t in texts for a in self.added):
            return self._plain(texts)
        cut = [self.stops.split(t) for t in texts]  # every other one is an added token
        between = iter(self._plain([x for some in cut for x in some[::2]]))
        return [b"".join(np.array([self.added[x]], "<i4").tobytes() if k % 2 else next(between) for k, x in enumerate(some)) for some in cut]

    def _plain(self, texts: list[str]) -> list[bytes]:
        words = [(_CUT.split(t) if _RUN.search(t) else t.split(" ")) if t else [""] for t in texts]
        heads = [w.pop(0) for w in words]
        found = [list(map(self.known.get, w)) for w in words]
        gaps = [[k for k, x in enumerate(got) if x is None] if None in got else () for got in found]
        new = self._fill(self.known, list({some[k] for some, at in zip(words, gaps, strict=True) for k in at}), " ", REMEMBERED)
        for some, got, at in zip(words, found, gaps, strict=True):
            for k in at:
                got[k] = new[some[k]]
        first = self._fill(self.first, [h for h in set(heads) if h and h not in self.first], "", REMEMBERED // 8)
        return [b"".join([first.get(h) or self.first.get(h, b""), *got]) for h, got in zip(heads, found, strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of identifiers, all of them known, gathered from one row of bytes."""
        out = []
        for k in range(0, len(ids), GATHERED):
            some = ids[k : k + GATHERED]
            out.append(self.row[ranges(self.starts[some], self.starts[some + 1] - self.starts[some])].tobytes())
        return b"".join(out)


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, ids)``: the identifiers of each whole text, without special ones."""
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        made = codec(vocabulary)
        for batch in slices(batches, TOGETHER):
            raw = made.encode(batch.column(1).to_pylist())
            ends = np.cumsum([0, *(len(x) // 4 for x in raw)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, ids, text)``: what the identifiers of each row stand for; null identifiers give a null text."""
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        made = codec(vocabulary)
        for batch in slices(batches, TOGETHER):
            column = batch.column(1)
            ids = column.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            known = (ids >= 0) & (ids < len(made.starts) - 1)
            upto = np.r_[0, np.cumsum(known)]  # identifiers to decode before each
            ends = upto[np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))]]
            ids = ids[known]
            found = [made.decode(ids[a:b]).decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
            text = pa.array(found, pa.string(), mask=column.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns, text], ["doc_id", "ids", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")
