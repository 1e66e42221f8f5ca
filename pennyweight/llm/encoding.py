"""Token identifiers of whole texts, by a tokenizer file of the ``tokenizers`` library.

Byte-level BPE cuts a text into pieces before merging, and always before
a single space between two other characters.  So pieces between such
spaces can be encoded apart and kept: each process holds a bounded table
of pieces seen, and only new ones go through the library.  A single line
end between two other characters is a piece of its own, and two are one
each, so lines are cut as well.  Arrow cuts a column and numbers its pieces, and each different
piece is looked up once.  The result is that of encoding the whole text;
texts that hold an added token of the vocabulary, and all texts for other
kinds of tokenizer, are encoded whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import remembered

#: Spaces at which a byte-level text can be cut; runs of white space stay together.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space as Python has it, without the line end, for Arrow's expressions.
_OTHER = r"\x09\x0B-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Runs of white space, but for two line ends before another character: these are a piece each.
_RUN = rf"[{_OTHER}][\n{_OTHER}]|\n[{_OTHER}]|\n\n\n|\n\n\z"
_BLANK = re.compile(r"\s")
#: Signs that are pieces of their own after letters: not the apostrophe, which may begin one with letters.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: How byte-level vocabularies write bytes: visible ones as they are, the others from 256 on.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_SHOWN_AS = np.array([ord(_BYTES.get(b, chr(b))) for b in range(256)], "<u2")
#: Pieces that a process remembers, and pieces encoded in one call.
REMEMBERED = 500_000
AT_ONCE = 2_000
#: Bytes of text whose pieces are numbered together (one text, if it is longer).
TOGETHER = 8 << 20

def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str) -> Encoder:
    """The process's encoder for a vocabulary file, kept until ``common.release`` forgets it."""
    if path not in remembered:
        remembered[path] = Encoder(path)
    return remembered[path]


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        self.added = [t["content"] for t in parts.get("added_tokens") or ()]  # found in a text before it is cut
        pre = parts.get("pre_tokenizer") or {}
        line_end = self._ids("\n")
        self.piecewise = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not parts.get("normalizer") and len(line_end) == 1
        self.line_end = line_end[0] if self.piecewise else None
        self.end_of_line = self._raw(line_end)
        self.merges = Tokenizer(self.tokenizer.model)  # of pieces as the vocabulary writes them, with line ends between
        self.merges.pre_tokenizer = Split(_BYTES[10], "isolated")
        self.known: dict[str, bytes] = {}  # by piece, without the space before it
        self.first: dict[str, bytes] = {}  # pieces that start a text

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _raw(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _words(self, pieces: list[str]) -> list[bytes]:
        """The merges of texts that are each one piece for the tokenizer's own pattern, and hold no line end."""
        out: list[bytes] = []
        for k in range(0, len(pieces), AT_ONCE):
            some = pieces[k : k + AT_ONCE]
            shown = _SHOWN_AS[np.frombuffer("\n".join(some).encode(), np.uint8)].tobytes().decode("utf-16-le")
            out += self._between(self.merges.encode_batch_fast([shown], add_special_tokens=False)[0].ids, len(some))
        return out

    def _between(self, ids: list[int], n: int) -> list[bytes]:
        """The identifiers of each of ``n`` pieces with a line end between them; none if there are other line ends."""
        flat = np.array(ids, self.dtype)
        cuts = np.flatnonzero(flat == self.line_end)
        if len(cuts) != n - 1:
            return []
        raw, width = flat.tobytes(), self.dtype.itemsize
        starts, ends = np.r_[0, cuts + 1] * width, np.r_[cuts, len(flat)] * width
        return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]

    def _learn(self, pieces: list[str], table: dict[str, bytes], into: dict[str, bytes], before: str) -> None:
        hard, easy, letters, ends = [], [], [], []
        for p in pieces:
            word = p if p.isalpha() else p.rstrip(_MARKS)
            # letters are one piece with the space before them, and signs after them are one of their own
            if word.isalpha():
                easy.append(p)
                letters.append(word)
                ends.append(p[len(word) :])
            else:
                hard.append(p)
        words = list({w for w in letters if w not in table})
        raw = dict(zip(words, self._words([before + w for w in words]), strict=True))
        marks = list({m for m in ends if m})
        signs = dict(zip(marks, self._words(marks), strict=True)) | {"": b""}
        for p, w, m in zip(easy, letters, ends, strict=True):
            into[p] = (raw[w] if w in raw else table[w]) + signs[m]
        plain = [p for p in hard if p and not _BLANK.search(p)]
        for k in range(0, len(plain), AT_ONCE):
            some = plain[k : k + AT_ONCE]
            if got := self._between(self._ids("\n".join(before + p for p in some)), len(some)):
                into.update(zip(some, got, strict=True))
        for p in hard:
            if p not in into:
                into[p] = self._raw(self._ids(before + p))

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [self._raw(e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The identifiers of each text, as little-endian integers of ``dtype``."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        if not self.piecewise:
            return self._whole(column.to_pylist())
        column = column.cast(pa.large_string())
        out: list[bytes] = [b""] * len(column)
        held = np.zeros(len(column), bool)
        for token in self.added:
            held |= pc.match_substring(column, token).to_numpy(zero_copy_only=False)
        runs = pc.match_substring_regex(column, _RUN).to_numpy(zero_copy_only=False) & ~held
        for some, code in ((held, lambda x: self._whole(x.to_pylist())), (runs, self._by_runs), (~held & ~runs, self._by_lines)):
            if (rows := np.flatnonzero(some)).size:
                # texts that start in the same stretch of bytes
                sizes = pc.binary_length(mine := column.take(pa.array(rows))).to_numpy()
                cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // TOGETHER)) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)], strict=True):
                    for k, raw in zip(rows[a:b].tolist(), code(mine.slice(a, b - a)), strict=True):
                        out[k] = raw
        return out

    def _by_runs(self, texts: pa.Array) -> list[bytes]:
        """Texts with white space in runs: cut at single spaces only."""
        cut = [_CUT.split(t) for t in texts.to_pylist()]
        starts = np.cumsum([0, *map(len, cut)])
        return self._joined(pa.array([p for pieces in cut for p in pieces], pa.large_string()), starts, starts[:0])

    def _by_lines(self, texts: pa.Array) -> list[bytes]:
        """Texts in which each space and one or two line ends are between other characters, or first or (one only) last."""
        lines = pc.split_pattern(texts, "\n")
        words = pc.split_pattern(lines.flatten(), " ")
        heads = words.offsets.to_numpy() - words.offsets[0].as_py()
        starts = lines.offsets.to_numpy() - lines.offsets[0].as_py()
        after = np.ones(len(heads), bool)
        after[starts] = False
        return self._joined(words.flatten(), heads[starts], heads[after])

    def _joined(self, pieces: pa.Array, starts: np.ndarray, lines: np.ndarray) -> list[bytes]:
        """The identifiers of pieces from each start to the next; those at ``lines`` follow a line end, others a space."""
        coded = pieces.dictionary_encode()
        several = len(coded.dictionary)
        numbers = coded.indices.to_numpy().astype(np.int64)
        numbers[starts[:-1]] += several
        numbers[lines] += 2 * several
        used = np.zeros(3 * several, bool)
        used[numbers] = True
        found: list[bytes] = []
        for k, (table, before, most) in enumerate(((self.known, " ", REMEMBERED), (self.first, "", REMEMBERED // 10), (self.first, "", REMEMBERED // 10))):
            mine = coded.dictionary.filter(pa.array(used[k * several : (k + 1) * several])).to_numpy(zero_copy_only=False).tolist()
            raw = self._look(table, mine, before, most)
            found += [self.end_of_line + x for x in raw] if k == 2 else raw
        place = (np.cumsum(used) - 1)[numbers]
        ids = pa.array(found, pa.large_binary()).take(pa.array(place))
        at = np.frombuffer(ids.buffers()[1], np.int64)[starts].tolist() if len(ids) else [0] * len(starts)
        raw = memoryview(ids.buffers()[2] or b"")
        return [bytes(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]

    def _look(self, table: dict[str, bytes], pieces: list[str], before: str, most: int) -> list[bytes]:
        """The identifiers of different pieces; new ones are remembered while there is room."""
        got = list(map(table.get, pieces))
        new = [p for p, x in zip(pieces, got, strict=True) if x is None]
        if not new:
            return got
        into = table if len(table) + len(new) <= most else {}
        self._learn(new, table, into, before)
        return [into[p] if x is None else x for p, x in zip(pieces, got, strict=True)]
