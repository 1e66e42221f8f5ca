"""Identifiers made from content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_hash(x: Column, n: int = 10) -> Column:
    """The first ``n`` hex digits of the sha1 of a text."""
    return F.substring(F.sha1(x.cast("string")), 1, n)


def row_number_id(x: Column) -> Column:
    """A 60-bit integer from a text: 15 hex digits of its sha1."""
    return F.conv(text_hash(x, 15), 16, 10).cast("long")


def item_id(dataset: Column, *parts: Column) -> Column:
    """``dataset-<12 hex>`` over the parts; a missing part is the text ``None``, not skipped."""
    joined = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts))
    return F.concat(dataset, F.lit("-"), text_hash(joined, 12))


def short_id(x: Column) -> Column:
    """What follows the last hyphen."""
    return F.element_at(F.split(x, "-"), -1)


def tag(prefix: str, x: Column) -> Column:
    """A search tag: a prefix letter and a hash of the value."""
    return F.concat(F.lit(prefix), text_hash(x))


def shard(x: Column, shards: int = 512, digits: int = 4) -> Column:
    """The shard of a key: leading hex digits of its hash, modulo the number of shards."""
    return F.pmod(F.conv(text_hash(x, digits), 16, 10).cast("long"), F.lit(shards))
