r"""Chat formatting with a grammar round trip.

The template marks turns:

    conversation := turn*
    turn         := "[INST " role "]" text "[/INST]"        (context)
                  | "<s>" text "</s>"                        (assistant, under the loss mask)

A text may hold these control strings itself.  Each turn is rendered as it
is, reparsed by a deterministic parser and compared with its source; on a
difference its conflicting parts are escaped and it is tried again, until
it comes back identical.  The escape puts one more backslash after the
bracket that opens a control string (``</s>`` becomes ``<\/s>``); text
that already looks so gets one more too, so taking one away undoes it.

Rows are sorted by conversation and turn, and each task keeps only the
turn at hand, however long its conversation is.

Defined results: a null text or role is the empty string; turns follow
``turn`` (null first), then role and text, repeated rows all stay; a null
``conv_id`` is a conversation of its own; an empty table gives none;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"
#: A control string, or one that was escaped before: bracket, backslashes, the rest.
_CONTROL = re.compile(r"([\[<])(\\*)(/?INST(?=[\]\s])|/?s>)")
#: How a turn begins; in a role, a backslash stands before a backslash or closing bracket that is meant.
_HEAD = re.compile(r"\[INST (?P<role>(?:[^\]\\]|\\.)*)\]|<s>", re.DOTALL)
#: What ends a text: the first control string in it, which must be the turn's own end.
_TAIL = re.compile(r"\[INST |\[/INST\]|<s>|</s>")

TURN = "conv_id long, place long, role string, rendered string, loss_start int, loss_length int"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[1]}\\{m[2]}{m[3]}", text)


def unescape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[1]}{m[2][1:]}{m[3]}", text)


def _role_out(role: str) -> str:
    return re.sub(r"([\\\]])", r"\\\1", role)


def _role_in(role: str) -> str:
    return re.sub(r"\\(.)", r"\1", role, flags=re.DOTALL)


def parse(rendered: str) -> list[tuple[str, str, tuple[int, int] | None]]:
    """Turns of a rendered text: role, text as written back, and the span under the loss mask.

    Raises ``ValueError`` where the text does not follow the grammar.
    """
    turns, at = [], 0
    while at < len(rendered):
        head = _HEAD.match(rendered, at)
        if head is None:
            raise ValueError(f"no turn begins at {at}")
        start, masked = head.end(), head["role"] is None
        tail = _TAIL.search(rendered, start)
        if tail is None or tail[0] != ("</s>" if masked else "[/INST]"):
            raise ValueError(f"the turn at {at} has no end of its kind")
        text = unescape(rendered[start : tail.start()])
        turns.append((ASSISTANT, text, (start, tail.start())) if masked else (_role_in(head["role"]), text, None))
        at = tail.end()
    return turns


def render(role: str, text: str) -> tuple[str, tuple[int, int] | None]:
    """One turn, escaped as far as its round trip needs, and its loss span."""
    for forms in ((role, text), (role, escape(text)), (_role_out(role), escape(text))):
        if role == ASSISTANT:
            out, span = f"<s>{forms[1]}</s>", (3, 3 + len(forms[1]))
        else:
            out, span = f"[INST {forms[0]}]{forms[1]}[/INST]", None
        try:
            if parse(out) == [(role, text, span)]:
                return out, span
        except ValueError:
            pass
    raise ValueError(f"a turn of role {role!r} does not survive the round trip")


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row per turn, in order: its rendered text and the part under the loss mask.

    A conversation's formatted text is its rows' ``rendered`` in order of
    ``place``.  Rows of a conversation lie together in a partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, place = object(), 0
        for batch in batches:
            ids, places, roles, out, starts, lengths = [], [], [], [], [], []
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                place = place + 1 if conv == now else 0
                now = conv
                rendered, span = render(role, text)
                ids.append(conv)
                places.append(place)
                roles.append(role)
                out.append(rendered)
                starts.append(span[0] if span else None)
                lengths.append(span[1] - span[0] if span else None)
            columns = zip((ids, places, roles, out, starts, lengths), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], [x.split()[0] for x in TURN.split(", ")])

    blank = F.lit("")
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("role").cast("string"), blank).alias("role"),
        F.coalesce(F.col("text").cast("string"), blank).alias("text"),
        F.col("turn").cast("long").alias("turn"),
    )
    spread = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return spread.drop("turn").mapInArrow(run, TURN)


def digests(turns: DataFrame) -> DataFrame:
    """What the formatted text says when parsed again, a row per conversation.

    ``turns`` comes from :func:`format_turns`, whose order within
    partitions it keeps; hashes run along, so no conversation is held.
    """
    out_schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None

        def done(rows: list) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in out_schema.split(", ")])

        close = lambda s: (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5])
        for batch in batches:
            rows = []
            for conv, place, rendered, start, length in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5)), strict=True):
                if place == 0:
                    if state:
                        rows.append(close(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _ in parse(rendered):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if start is not None:
                    masked = unescape(rendered[start : start + length])
                    state[3] += len(masked)
                    state[4].update(masked.encode("utf-8", "surrogatepass"))
                state[5] += len(rendered)
            yield done(rows)
        if state:
            yield done([close(state)])

    return turns.mapInArrow(run, out_schema)
