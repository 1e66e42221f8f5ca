"""Amounts: reading them, writing them, putting them in proportion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain(x: Column) -> Column:
    return F.regexp_replace(F.trim(x), r"[$,\s]", "")


def money(x: Column) -> Column:
    """``$(1,234.50)`` and the like; blank and dashes are missing, not zero."""
    t = _plain(x)
    value = F.regexp_replace(t, r"^\(+|\)+$", "").try_cast("double")
    return F.when(t.rlike(r"^\(.*\)$"), -value).otherwise(value)


def document_number(x: Column) -> Column:
    """In budget documents a dash or blank is zero."""
    t = _plain(x)
    return F.when(t.isNull() | t.isin("", "-", "--", "–", "—"), 0.0).otherwise(money(x))


def cell(x: Column) -> Column:
    """A table cell as a number; blanks, ``None`` and text are missing."""
    return F.trim(x).try_cast("double")


def currency_code(x: Column) -> Column:
    """Three capitals, or ``unstated``."""
    t = F.trim(x)
    return F.when(t.rlike(r"^[A-Z]{3}$"), t).otherwise("unstated")


def parse_amount(x: Column) -> Column:
    """A printed amount as ``(cad, currency, original)``.

    An empty cell has no currency.  Rates, ranges and prose stay text unless
    the cell speaks of CAD; an amount in Canadian dollars wins over one in US
    dollars, which is kept as printed and never converted; a lone amount is
    Canadian; of several points only the last is a decimal point.
    """
    t = F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))
    number = r"\$?\s?S?(\d{1,3}(?:[,.]\d{3})+(?:\.\d{1,2})?|\d+(?:\.\d{1,2})?)"
    up = F.upper(t)
    rate = up.rlike(r"\bTO\b|PER\b|/|HOURLY|RATE|EACH|DETERMINED") & ~up.contains("CAD")

    def value(said: Column) -> Column:
        pieces = F.split(F.replace(said, F.lit(","), F.lit("")), r"\.")
        whole = F.array_join(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1))), "")
        return F.when(F.size(pieces) > 1, F.concat(whole, F.lit("."), F.element_at(pieces, -1))).otherwise(whole).try_cast("double")

    found = lambda after: F.nullif(F.regexp_extract(t, f"(?i){number}{after}", 1), F.lit(""))
    canadian, american = found(r"\s*\(?(?:CAD|CDN)\)?"), found(r"\s*\(?(?:USD|US)\b")
    all_ = F.regexp_extract_all(t, F.lit(number), F.lit(1))
    lone = F.size(all_) == 1
    kind = F.when(t == "", "").when(rate, "text").when(canadian.isNotNull(), "CAD").when(american.isNotNull(), "USD").when(lone, "CAD").otherwise("text")
    return F.struct(F.when(kind == "CAD", value(F.coalesce(canadian, F.get(all_, F.lit(0))))).alias("cad"), kind.alias("currency"), F.when(kind == "USD", value(american)).alias("original"))


def _trim_zero(x: Column) -> Column:
    return F.regexp_replace(x, r"\.0$", "")


def _whole(x: Column) -> Column:
    """Rounded to whole units, halves away from zero."""
    return F.format_number(F.floor(F.abs(x) + F.lit(0.5)), 0)


def _fixed(x: Column, digits: int) -> Column:
    """So many decimals, halves away from zero, without separators."""
    scale = 10**digits
    rounded = F.floor(F.abs(x) * scale + F.lit(0.5)) / scale
    return F.concat(F.when((x < 0) & (rounded > 0), "-").otherwise(""), F.format_string(f"%.{digits}f", rounded.cast("double")))


def money_text(x: Column, cents: bool = False) -> Column:
    """``$1,234``; negatives in brackets; ``n/a`` for a missing amount."""
    shown = F.concat(F.lit("$"), F.format_number(F.abs(x), 2) if cents else _whole(x))
    return F.when(x.isNull(), "n/a").when(x < 0, F.concat(F.lit("("), shown, F.lit(")"))).otherwise(shown)


def money_words(x: Column) -> Column:
    """``$3.0 billion``, ``$3 million``, ``$459 million``, or the plain amount below a million; ``n/a`` where none is.

    Billions keep their decimal, millions drop a zero and have none from a
    hundred on; the sign of these stands after the dollar.
    """
    a, plain = F.abs(x), _fixed
    millions = F.when(a >= 1e8, plain(x / 1e6, 0)).otherwise(_trim_zero(plain(x / 1e6, 1)))
    large = F.when(a >= 1e9, F.concat(F.lit("$"), plain(x / 1e9, 1), F.lit(" billion"))).when(a >= 1e6, F.concat(F.lit("$"), millions, F.lit(" million")))
    return F.coalesce(large, money_text(x))


def money_short(x: Column) -> Column:
    """``$10.6B``, ``$459M``, ``$45K``: one decimal below a hundred units, none from there on."""
    a = F.abs(x)
    part = lambda unit, name: F.concat(F.lit("$"), F.when(a >= 100 * unit, _fixed(x / unit, 0)).otherwise(_trim_zero(_fixed(x / unit, 1))), F.lit(name))
    billions = F.concat(F.lit("$"), _trim_zero(_fixed(x / 1e9, 1)), F.lit("B"))
    return F.when(a >= 1e9, billions).when(a >= 1e6, part(1e6, "M")).when(a >= 1e3, part(1e3, "K")).otherwise(money_text(x))


def percent(x: Column, digits: int = 0) -> Column:
    return F.concat(F.format_number(x * 100, digits), F.lit("%"))


def whole_number(x: Column) -> Column:
    """With separators, no decimals, halves away from zero."""
    return F.concat(F.when(x <= -0.5, "-").otherwise(""), _whole(x))


def per_head(x: Column, heads: float) -> Column:
    return x / F.lit(float(heads))


def work_time(x: Column, yearly_wage: float) -> Column:
    """How long a median wage takes to earn it.

    Years of 52 weeks (whole from a hundred on, with one decimal from two on),
    weeks from eight on, else working days, five to a week, from two on, else
    working hours, seven and a half to a day, else minutes.
    """
    years = x / F.lit(float(yearly_wage))
    weeks, days, hours = years * 52, years * 260, years * 1950
    half_up = lambda v: F.floor(v + F.lit(0.5)).cast("long")
    say = lambda v, unit: F.concat(v.cast("string"), F.lit(f" {unit}"))
    return (
        F.when(years >= 100, F.concat(F.format_number(half_up(years), 0), F.lit(" years")))
        .when(years >= 2, F.concat(_trim_zero(F.format_number(years, 1)), F.lit(" years")))
        .when(weeks >= 8, say(half_up(weeks), "weeks"))
        .when(days >= 2, say(half_up(days), "working days"))
        .when(hours >= 1, F.concat(say(half_up(hours), "working hour"), F.when(half_up(hours) == 1, "").otherwise("s")))
        .otherwise(say(F.greatest(half_up(hours * 60), F.lit(1)), "working minutes"))
    )


def bracket_tax(income: Column, brackets: list[tuple[float, float]]) -> Column:
    """Tax by brackets ``(from, rate)``, as a fold over them."""
    table = F.array(*(F.struct(F.lit(float(a)).alias("low"), F.lit(float(r)).alias("rate"), F.lit(float(b)).alias("high")) for (a, r), b in zip(brackets, [b for b, _ in brackets[1:]] + [1e18], strict=True)))
    return F.aggregate(table, F.lit(0.0), lambda acc, b: acc + F.greatest(F.least(income, b["high"]) - b["low"], F.lit(0.0)) * b["rate"])


def income_tax(income: Column, brackets: list[tuple[float, float]], credits: float | Column, reduction: tuple[float, float, float]) -> Column:
    """Bracket tax less credits at the lowest rate and a reduction that fades with income; never below zero."""
    most, fade_from, fade = reduction
    credit = credits * brackets[0][1]
    owed = bracket_tax(income, brackets) - (credit if isinstance(credit, Column) else F.lit(credit))
    relief = F.greatest(F.lit(float(most)) - F.greatest(income - F.lit(float(fade_from)), F.lit(0.0)) * F.lit(fade), F.lit(0.0))
    return F.greatest(owed - relief, F.lit(0.0))


def payroll(income: Column, pension: dict[str, float], insurance: dict[str, float]) -> Column:
    """An employee's contributions of a year: ``base`` (a credit), ``deduction`` (from income) and ``premium`` (a credit), to the cent.

    ``pension`` has ``exempt``, ``first`` and ``second`` (the two ceilings)
    and the rates ``base``, ``enhanced`` and ``upper``; ``insurance`` has
    ``most`` and ``rate``.
    """
    zero = F.lit(0.0)
    cents = lambda x: F.floor(x * 100 + 0.5) / 100
    between = lambda low, high: F.least(F.greatest(income - low, zero), F.lit(float(high - low)))
    lower, upper = between(pension["exempt"], pension["first"]), between(pension["first"], pension["second"])
    return F.struct(
        cents(lower * pension["base"]).alias("base"),
        (cents(lower * pension["enhanced"]) + cents(upper * pension["upper"])).alias("deduction"),
        cents(F.least(income, F.lit(float(insurance["most"]))) * insurance["rate"]).alias("premium"),
    )


def employee_tax(income: Column, brackets: list[tuple[float, float]], personal: float, reduction: tuple[float, float, float], pension: dict[str, float], insurance: dict[str, float]) -> Column:
    """Income tax of someone whose income is all employment: contributions lower the income or count as credits."""
    paid = payroll(income, pension, insurance)
    net = F.greatest(income - paid["deduction"], F.lit(0.0))
    return income_tax(net, brackets, paid["base"] + paid["premium"] + personal, reduction)
