"""Quality rules as a bitmask ledger, in DataFrame functions alone.

``ledger`` measures every text once and evaluates every rule once: a row per document with
the measurements and a bit for each rule that failed; ``stored_ledger`` writes that to the shared
folder. A policy is a version and a mask of rules that count; applying one, or asking what
each rule of it costs, reads the ledger only (``verdicts``, ``ablation``) and works on the bits.

Defined results: null is an empty text; an empty text has no words and all counts zero, and
fails the shortness rule; equal rows give equal results, a row for each; of equal lines or
windows the later ones, or all, count as said; very long texts are measured whole; an empty table
gives no rows. Only doc_id, of any type, and text are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import store

_SPACES = r"[\x20\x09-\x0D]+"
#: Words in a window whose repetition counts.
WINDOW = 5

MEASURES = ("n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words")

#: Rules by bit; a rule fails where its condition holds. A bit is never given to another rule.
RULES: dict[str, str] = {
    "too_short": "n_words < 10",
    "repetitive": "100 * n_repeat_words > 20 * n_words",
    "long_words": "word_chars > 25 * n_words",
    "symbols": "100 * n_symbols > 8 * word_chars",
    "shouting": "100 * n_upper > 60 * word_chars",
    "dup_lines": "n_lines >= 5 and 100 * n_dup_lines > 50 * n_lines",
}

#: Policies by version: names of the rules that count.
POLICIES: dict[int, tuple[str, ...]] = {1: ("too_short", "repetitive"), 2: tuple(RULES)}


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _covered(windows: Column) -> Column:
    """Words in windows that occur twice or more; windows: each window's text, by its first word."""

    def of_sorted(s: Column) -> Column:
        twin = lambda e, k: F.when((F.get(s, k - 1)["v"] == e["v"]) | (F.get(s, k + 1)["v"] == e["v"]), e["i"])
        places = F.sort_array(F.filter(F.transform(s, twin), lambda p: p.isNotNull()))
        return _let(places, lambda p: F.aggregate(F.transform(p, lambda a, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - a, F.lit(WINDOW)))), F.lit(0), lambda x, y: x + y))

    repeated = _let(F.sort_array(F.transform(windows, lambda v, i: F.struct(v.alias("v"), i.alias("i")))), of_sorted)
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(repeated)


def _measures(text: Column) -> Column:
    words = F.filter(F.split(text, _SPACES), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> list[Column]:
        n = F.size(w)
        windows = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.concat_ws(" ", *[F.get(w, i + j) for j in range(WINDOW)]))
        return [
            n.cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.when(n <= WINDOW, F.lit(0)).otherwise(_let(windows, _covered)).cast("long").alias("n_repeat_words"),
        ]

    def without(chars: str) -> Column:
        return (F.char_length(text) - F.char_length(F.regexp_replace(text, chars, ""))).cast("long")

    of_lines = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return F.struct(
        _let(words, lambda w: F.struct(*of_words(w))).alias("w"), of_lines.alias("l"), without("[#*$%&|<>]").alias("n_symbols"), without("[A-Z]").alias("n_upper")
    )


def ledger(docs: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """doc_id, the measurements and fail_bits: bit i is set where rule i fails."""
    rules = RULES if rules is None else rules
    measured = docs.select("doc_id", _measures(F.coalesce("text", F.lit(""))).alias("m"))
    places = {"n_words": "m.w", "word_chars": "m.w", "n_repeat_words": "m.w", "n_lines": "m.l", "n_dup_lines": "m.l"}
    flat = measured.select("doc_id", *[F.col(f"{places.get(c, 'm')}.{c}") for c in MEASURES])
    bits = F.lit(0).cast("long")
    for i, condition in enumerate(rules.values()):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return flat.withColumn("fail_bits", bits)


def stored_ledger(docs: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """The ledger, written once: policies and ablations of any version read it again without the texts."""
    return store(ledger(docs, rules), "ledger")[0]


def mask_of(names: tuple[str, ...], rules: dict[str, str] | None = None) -> int:
    order = list(RULES if rules is None else rules)
    return sum(1 << order.index(n) for n in names)


def verdicts(found: DataFrame, version: int, policies: dict[int, tuple[str, ...]] | None = None) -> DataFrame:
    """A ledger with policy_version and kept: none of the policy's rules failed."""
    mask = mask_of((POLICIES if policies is None else policies)[version])
    kept = F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")) == 0
    return found.withColumns({"policy_version": F.lit(version), "kept": kept})


def ablation(found: DataFrame, version: int, policies: dict[int, tuple[str, ...]] | None = None) -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail it alone, and that stay without it.

    Bit patterns are counted first (2 ** rules at most), so only counts are spread over the rules.
    """
    names = (POLICIES if policies is None else policies)[version]
    mask = F.lit(mask_of(names)).cast("long")
    patterns = found.groupBy(F.col("fail_bits").bitwiseAND(mask).alias("bits")).agg(F.count("*").alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(mask_of((n,))).cast("long").alias("bit")) for n in names]))
    spread = patterns.select("bits", "n", each.alias("r")).select("bits", "n", "r.rule", "r.bit")
    fails = F.col("bits").bitwiseAND(F.col("bit")) != 0
    kept_without = F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0
    count = lambda c, name: F.sum(F.when(c, F.col("n")).otherwise(0)).alias(name)
    return spread.groupBy("rule").agg(count(fails, "n_failed"), count(F.col("bits") == F.col("bit"), "n_only"), count(kept_without, "n_kept_without"), count(F.col("bits") == 0, "n_kept"))
