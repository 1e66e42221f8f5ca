"""Quality rules: a threshold table compiled into one projection of built-in functions.

Each rule names a ratio and the range in which a document may lie.  The
ratios come from a few per-document counts (lengths, symbols, stop words,
lines, repeated word triples), all computed by Spark's own functions; no
row leaves the JVM and nothing is shuffled.

Defined results: a null text counts as the empty text (all counts zero,
``base_failed`` true); ratios with a zero denominator are zero; other
columns of the input pass through untouched, and those whose names clash
with a computed one are replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from has in is it of on or that the this to was were with "
    "auf das dem den der des die ein eine einer für ist im mit nicht sich und von zu "
    "au aux avec dans de des du elle en est et la le les par pas pour que qui sur un une "
    "al como con del el ella es la las lo los más no para por que se su sus un una y"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a document only if ``low <= ratio <= high``."""

    name: str
    ratio: str
    low: float
    high: float


#: Ratios by name, as SQL over the counts of :func:`counts`.
RATIOS = {
    "length": "n_words",
    "word_length": "word_chars / n_words",
    "symbols": "n_symbols / n_words",
    "shouting": "n_marks / n_words",
    "stop_words": "n_stop_words / n_words",
    "repeated_words": "n_repeat_words / n_words",
    "repeated_lines": "n_dup_lines / n_lines",
}

RULES = (
    Rule("length", "length", 50, float("inf")),
    Rule("word length", "word_length", 2.0, 20.0),
    Rule("symbols", "symbols", 0.0, 0.25),
    Rule("shouting", "shouting", 0.0, 0.25),
    Rule("stop words", "stop_words", 0.04, 1.0),
    Rule("repeated words", "repeated_words", 0.0, 0.5),
    Rule("repeated lines", "repeated_lines", 0.0, 0.5),
)


#: Neighbours on each side that a window is compared with, while their hashes agree.
REACH = 3


def _repeat_words(words: str, n: str) -> dict[str, str]:
    """Steps (column -> SQL) that count words in 3-word windows found twice or more.

    Each window becomes one long: its hash above, its start below; sorted,
    windows of one hash are neighbours.  They count as equal only if their
    words are, so hash collisions add nothing.  Nor do they hide anything
    to speak of: in a text of ten million words 40 bits of hash are left, some
    dozens of its windows share one with another, and ``REACH`` such
    strangers would have to stand between two equal windows.
    The starts of repeated windows, sorted, then cover ``min(3, gap)`` words each.
    """
    start = lambda x: f"slice({words}, CAST({x} & _m AS INT) + 1, 3)"

    def alike(sign: str, step: int = 1) -> str:
        """An equal window among the next ``REACH`` on one side, as long as hashes agree."""
        y = f"get(_w, k {sign} {step})"
        found = f"{start('x')} = {start(y)}"
        more = f" OR {alike(sign, step + 1)}" if step < REACH else ""
        return f"(shiftright(x, _b) = shiftright({y}, _b) AND ({found}{more}))"

    before, after = alike("-"), alike("+")
    return {
        "_b": f"CAST(length(bin({n})) AS INT)",
        "_m": f"shiftleft(1L, CAST(length(bin({n})) AS INT)) - 1L",
        "_w": f"""IF({n} < 3, array_repeat(0L, 0), sort_array(transform(sequence(0, CAST(greatest({n}, 3) AS INT) - 3), i ->
            shiftleft(xxhash64(get({words}, i), get({words}, i + 1), get({words}, i + 2)), _b) | CAST(i AS BIGINT))))""",
        "_p": f"sort_array(transform(filter(_w, (x, k) -> coalesce({before}, false) OR coalesce({after}, false)), x -> x & _m))",
        "n_repeat_words": "aggregate(transform(_p, (x, k) -> least(3L, coalesce(get(_p, k + 1) - x, 3L))), 0L, (a, x) -> a + x)",
    }


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts on which the rules rest; ``_``-columns are dropped again."""
    stops = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    quoted = WORD.replace("\\", "\\\\")
    steps: list[dict[str, str]] = [
        {"_t": f"coalesce(CAST(`{text}` AS STRING), '')"},
        {"_words": f"regexp_extract_all(_t, '{quoted}', 0)", "_lines": f"filter(split(_t, '\\n'), l -> l RLIKE '{quoted}')"},
        {"n_words": "CAST(size(_words) AS BIGINT)"},
    ]
    repeat = _repeat_words("_words", "n_words")
    steps += [{k: repeat[k] for k in ("_b", "_m")}, {"_w": repeat["_w"]}, {"_p": repeat["_p"]}]
    steps += [
        {
            "n_repeat_words": repeat["n_repeat_words"],
            "n_symbols": "CAST(regexp_count(_t, '[#*$%&|<>]') AS BIGINT)",
            "n_marks": "CAST(regexp_count(_t, '[!?]') AS BIGINT)",
            "n_lines": "CAST(size(_lines) AS BIGINT)",
            "n_dup_lines": "CAST(size(_lines) - size(array_distinct(_lines)) AS BIGINT)",
            "n_stop_words": f"CAST(size(filter(_words, w -> lower(w) IN ({stops}))) AS BIGINT)",
        }
    ]
    out = docs
    for step in steps:
        out = out.withColumns({k: F.expr(v) for k, v in step.items()})
    out = out.withColumn("word_chars", F.char_length(F.translate("_t", SPACES, "")).cast("long"))
    return out.drop("_t", "_words", "_lines", "_b", "_m", "_w", "_p")


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The threshold table as one boolean expression over the counts."""
    out = F.lit(True)
    for rule in rules:
        ratio = F.expr(" / ".join(f"nullif({part.strip()}, 0)" if k else part.strip() for k, part in enumerate(RATIOS[rule.ratio].split("/"))))
        ratio = F.coalesce(ratio.cast("double"), F.lit(0.0))
        out = out & (ratio >= rule.low) & (ratio <= rule.high)
    return out


def assess(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with counts, ``base_failed`` and ``kept``."""
    out = counts(docs)
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with the columns they came with.

    The optimizer would push the filter below the projections, and so copy
    each count's expression into every place that uses it.  A column that
    is not deterministic keeps the filter above them.
    """
    clash = {c: f"_given_{k}" for k, c in enumerate(docs.columns)}
    held = docs.select(F.col("text"), *(F.col(f"`{c}`").alias(n) for c, n in clash.items()))
    judged = assess(held, rules).withColumn("_row", F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col("_row") >= 0)).select(*(F.col(n).alias(c) for c, n in clash.items()))
