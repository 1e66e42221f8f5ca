"""When two keys name one body: rules on arrays of words, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import names, tables


def _listed(words) -> Column:
    return F.array(*map(F.lit, sorted(set(words))))


def words(key: Column) -> Column:
    return F.split(key, " ")


def numbers(key: Column) -> Column:
    return F.regexp_extract_all(key, F.lit(r"(\d+)"), F.lit(1))


def telling(key_words: Column) -> Column:
    """Some word of four letters or more is not one that many bodies share."""
    return F.exists(F.array_except(key_words, _listed(tables.GENERIC_WORDS)), lambda w: F.length(w) >= 4)


def contained(a: Column, b: Column) -> Column:
    """The words of the key with fewer are all in the other, which adds words of kind or place only."""
    x, y = words(a), words(b)
    fewer = F.when(F.size(x) <= F.size(y), x).otherwise(y)
    more = F.when(F.size(x) <= F.size(y), y).otherwise(x)
    lacking, added = F.array_except(fewer, more), F.array_except(more, F.concat(fewer, _listed([*tables.GENERIC_WORDS, *tables.KIND_WORDS])))
    return (F.size(F.concat(lacking, added)) == 0) & (numbers(a) == numbers(b)) & telling(fewer)


def unit_of(a: Column, b: Column) -> Column:
    """The longer key is the shorter one, a body with a name to itself, and the name of one of its units."""
    body, whole = (F.when((F.length(a) <= F.length(b)) == first, a).otherwise(b) for first in (F.lit(True), F.lit(False)))
    stem, after = words(body), words(F.substring(whole, F.length(body) + 2, F.length(whole)))
    placed = F.size(F.filter(stem, lambda w: w.isin(*tables.PLACE_WORDS)))
    who = telling(stem) | (placed >= 3)
    only_place = F.size(F.array_except(stem, _listed(tables.PLACE_WORDS))) == 0
    return F.startswith(whole, F.concat(body, F.lit(" "))) & F.arrays_overlap(after, _listed(tables.UNIT_WORDS)) & (F.size(stem) > 1) & ~only_place & who & (numbers(a) == numbers(b))


def town(key: Column) -> Column:
    """The key of a town without the province printed after it; null where no town is named."""
    parts = words(key)
    left = _without_tail(parts, [t.split() for t in tables.PROVINCE_TAILS])
    name = F.array_join(left, " ")
    return F.when((name != "") & ~name.isin(*tables.PLACEHOLDERS, "nl", "newfoundland and labrador"), name)


def _without_tail(parts: Column, tails: list[list[str]]) -> Column:
    ends = F.when(F.lit(False), parts)
    for tail in tails:
        n = len(tail)
        ends = ends.when((F.size(parts) >= n) & (F.slice(parts, F.greatest(F.size(parts) - (n - 1), F.lit(1)), F.lit(n)) == F.array(*map(F.lit, tail))), F.slice(parts, F.lit(1), F.greatest(F.size(parts) - n, F.lit(0))))
    return ends.otherwise(parts)


def close(a: Column, b: Column, how: str) -> Column:
    """``slip``: a slip of the pen apart; ``contained``, ``unit``: as above; ``either``: a slip or contained; ``any``: one of all."""
    rules = {"slip": "s", "contained": "c", "unit": "u", "either": "cs", "any": "cus"}[how]
    made = {"c": contained, "u": unit_of, "s": names.slip_apart_udf}
    first, *others = (made[r](a, b) for r in rules)
    for rule in others:
        first = first | rule
    return first
