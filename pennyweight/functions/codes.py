"""Codes and short texts: numbers of businesses, postal codes, keys of contracts, kinds of bodies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables

# Spellings of a missing detail.
MISSING_DETAIL = ("", "n a", "na", "not stated")
# Parts of names that only firms and bodies have.
BUSINESS = (
    r"(?i)\d|&|\b(inc|ltd|limited|corp|co|company|llp|lp|ulc|services|group|consult|engineer|associates|solutions|systems|society|"
    r"association|centre|center|canada|construction|contracting|enterprises|technolog|industr|holdings|partners|agency|marine|electric|"
    r"university|college|government|club|church|foundation|trust|bank|clinic|pharmacy|law|legal)"
)


def business_number(x: Column) -> Column:
    """A business number: nine digits that pass the Luhn check, with the account if printed.

    Publishers' own placeholders are no numbers: one digit repeated,
    numbers that start with 1000, and accounts marked XX.
    """
    full = F.regexp_replace(F.upper(F.coalesce(x, F.lit(""))), r"[^0-9A-Z]", "")
    root = F.substring(full, 1, 9)
    good = full.rlike(r"^\d{9}([A-Z]{2}\d{4})?$") & (F.substring(full, 10, 2) != "XX") & ~root.rlike(r"^(\d)\1{8}$") & ~root.startswith("1000") & F.call_function("luhn_check", root)
    return F.when(good, full)


def postal(x: Column) -> Column:
    """``A1A1A1``, or null."""
    p = F.regexp_replace(F.upper(F.coalesce(x, F.lit(""))), r"[^A-Z0-9]", "")
    return F.when(p.rlike(r"^[A-Z]\d[A-Z]\d[A-Z]\d$"), p)


def canadian_code(x: Column) -> Column:
    """Whether a text is a postal code of the country, whole or its first three characters only."""
    return F.coalesce(F.upper(F.trim(x)).rlike(f"^(?:{tables.POSTAL_CODE})$"), F.lit(False))


def in_region(x: Column, letter: str = "A") -> Column:
    """Whether a postal code, whole or its first half, lies in the region of a letter."""
    return canadian_code(x) & F.startswith(F.upper(F.trim(F.coalesce(x, F.lit("")))), F.lit(letter))


def text_key(x: Column) -> Column:
    """Lower case, runs of anything but letters, digits and underscores as one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"(?U)\W+", " "))


def description_key(x: Column) -> Column:
    """Compares descriptions without numbers, case or punctuation."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^a-z]+", " "))


def contract_key(x: Column) -> Column:
    """A contract number without order labels; empty where none is stated.

    The number is cut before each ``PO`` that a digit follows; a label that
    opens the number goes, one inside loses a ``#`` after it and the slash before it.
    """
    plain = F.upper(F.array_join(F.split(F.coalesce(x, F.lit("")), r"\s+"), ""))
    parts = F.split(plain, r"(?=PO#?\d)")
    tidy = lambda part, k: F.when(
        part.rlike(r"^PO#?\d"), F.concat(F.when(k == 0, "").otherwise("PO"), F.ltrim(F.substring(part, 3, 1 << 20), F.lit("#")))
    ).otherwise(part)
    tail = lambda part, k: F.when((k < F.size(parts) - 1) & part.endswith("/"), F.rtrim(part, F.lit("/"))).otherwise(part)
    joined = F.array_join(F.transform(parts, lambda part, k: tail(tidy(part, k), k)), "")
    return F.when(joined.isin("", "-", "NA", "N/A", "TBC", "TBD"), "").otherwise(joined)


def locator(*parts: Column) -> Column:
    """Where a row is printed: file, page and row."""
    return F.struct(*(p.cast("string").alias(n) for p, n in zip(parts, ("source_file", "page", "row"), strict=True)))


def same_detail(a: Column, b: Column) -> Column:
    """Equal as keys, or both spelled as missing."""
    canon = lambda x: F.when(text_key(x).isin(*MISSING_DETAIL), "").otherwise(text_key(x))
    return canon(a) == canon(b)


def detail_key(x: Column) -> Column:
    return F.when(text_key(x).isin(*MISSING_DETAIL), "").otherwise(text_key(x))


def vague(x: Column) -> Column:
    """Empty, a generic word, or at most two words without a digit in under 18 characters."""
    d = F.regexp_replace(F.lower(F.trim(F.coalesce(x, F.lit("")))), r"\.+$", "")
    few = (F.size(F.filter(F.split(d, r"\s+"), lambda w: w != "")) <= 2) & ~d.rlike(r"\d") & (F.length(d) < 18)
    return (d == "") | d.isin(*tables.VAGUE_DESCRIPTIONS) | few


def looks_like_person(x: Column) -> Column:
    """Two or three words, none of which only firms have."""
    n = F.trim(F.coalesce(x, F.lit("")))
    words = F.size(F.filter(F.split(F.regexp_replace(n, ",", " "), r"\s+"), lambda w: w != ""))
    return ~n.rlike(BUSINESS) & words.between(2, 3)


def first_match(x: Column, rules: list[tuple[str, str]], default: str | None) -> Column:
    """The label of the first pattern found: an ordered rule table as one CASE."""
    out = None
    for pattern, label in rules:
        out = F.when(x.rlike(pattern), label) if out is None else out.when(x.rlike(pattern), label)
    return out.otherwise(default)


def code_name(x: Column, names: dict[str, str]) -> Column:
    """A code's name; unknown codes stay as they are."""
    table = F.create_map(*(F.lit(v) for pair in names.items() for v in pair))
    return F.coalesce(F.try_element_at(table, x), x)


def clip(x: Column, n: int) -> Column:
    """At most ``n`` characters, cut at the last space, with an ellipsis."""
    cut = F.regexp_replace(F.substring(x, 1, n), r"\s+\S*\z", "")
    return F.when(F.length(x) <= n, x).otherwise(F.concat(cut, F.lit("…")))


def place_of(x: Column) -> Column:
    """Payee and place from a text that ends in "town, province"; null unless the province is the one.

    Only the last two commas count: a name may have commas of its own.
    """
    parts = F.split(F.coalesce(x, F.lit("")), ",")
    n = F.size(parts)
    last = lambda k: F.trim(F.get(parts, n - k))
    name = F.trim(F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 2, F.lit(0))), ","))
    found = F.struct(name.alias("name"), F.concat(last(2), F.lit(", "), last(1)).alias("place"))
    return F.when((n >= 3) & F.lower(last(1)).isin(*tables.PROVINCES), found)


def canonical_body(printed: Column) -> Column:
    """The public body that a printed name stands for: the first pattern of the table that is found."""
    tidy = F.trim(F.regexp_replace(F.translate(F.coalesce(printed, F.lit("")), "\u2010", "-"), r"\s+", " "))
    named = first_match(tidy, [(f"(?i){pattern}", name) for pattern, name in tables.BODIES], None)
    return F.coalesce(named, F.nullif(tidy, F.lit("")), F.lit(tables.NO_BODY))


def body_type(name: Column) -> Column:
    """Local bodies first, then crown corporations; the rest are departments."""
    shown = F.coalesce(name, F.lit(""))
    return F.when(shown.rlike(f"(?i){tables.LOCAL_BODY}"), "local").when(shown.rlike(f"(?i){tables.CROWN_BODY}"), "crown").otherwise("department")


def english_letters(x: Column) -> Column:
    """Letters and digits of the part before the bar, in lower case."""
    return F.regexp_replace(F.lower(F.split_part(F.coalesce(x, F.lit("")), F.lit("|"), F.lit(1))), "[^a-z0-9]", "")


def name_order(x: Column) -> Column:
    """``Dinn, Paul`` as ``Paul Dinn``."""
    first, rest = F.substring_index(x, ",", 1), F.ltrim(F.substring(x, F.instr(x, ",") + 1, 1 << 20))
    return F.when((F.instr(x, ",") > 1) & (F.length(rest) > 0), F.concat(rest, F.lit(" "), first)).otherwise(x)


def without_title(x: Column) -> Column:
    """A minister's name without the title before it."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"^(Honourable|Hon\.|Mr\.|Ms\.|Mrs\.|Dr\.)\s+", ""))


def reasons(*pairs: tuple[Column, str]) -> Column:
    """The texts whose conditions hold, joined; null where none does."""
    return F.nullif(F.concat_ws("; ", *(F.when(c, t) for c, t in pairs)), F.lit(""))


def compact(x: Column) -> Column:
    """Letters without spaces or ``of``."""
    return F.regexp_replace(x, r"\bof\b|\s", "")


def digit_runs(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"\d+"), F.lit(0))


def title_case(x: Column) -> Column:
    """Each word capitalised; words all in capitals of two to four letters stay."""
    return F.array_join(F.transform(F.split(x, " "), lambda w: F.when(w.rlike(r"^[A-Z]{2,4}$"), w).otherwise(F.initcap(w))), " ")


def plain_letters(x: Column) -> Column:
    """Latin letters without their marks, by a table; letters that do not decompose are left."""
    return F.translate(x, "àâäáãåçéèêëíìîïñóòôöõúùûüýÿÀÂÄÁÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY")


def slug(x: Column) -> Column:
    """Lower-case words joined by hyphens, ``&`` as ``and``, 80 characters at most."""
    t = F.regexp_replace(F.lower(plain_letters(F.coalesce(x, F.lit("")))), "&", " and ")
    return F.substring(F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9]+", "-"), r"^-|-$", ""), 1, 80)
