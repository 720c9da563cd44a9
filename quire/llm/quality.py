"""Quality rules: a threshold table compiled into one projection of built-in functions.

Definitions. A word is a run of characters other than ASCII white space; a line is a piece between
newlines; a null text has no words. Empty and null texts fail the base rule (fewer than 50 words).
Rows are judged one by one, so ties, repeated rows and further columns need no special case;
output columns replace input columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "\\x20\\x09-\\x0D"

# Frequent function words of the four languages that the stop-word rule knows.
STOP_WORDS = {
    "en": ["the", "and", "of", "is", "to", "in", "that", "it", "on", "for", "with", "as", "be", "are", "was", "this", "by", "at", "from", "or"],
    "fr": ["le", "la", "de", "et", "les", "un", "une", "que", "des", "en", "du", "qui", "est", "pour", "dans", "par", "sur", "au", "avec", "elle"],
    "de": ["der", "die", "und", "von", "zu", "mit", "den", "das", "ist", "in", "ein", "eine", "nicht", "es", "auf", "für", "sich", "dem", "des", "im"],
    "es": ["el", "la", "de", "que", "y", "los", "las", "por", "un", "una", "para", "con", "es", "en", "se", "del", "al", "lo", "su", "como"],
}


@dataclass(frozen=True)
class Rule:
    """A document passes where ``low <= metric <= high``; a null metric passes."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: Wide limits: they are meant for text that no reader would call prose.
RULES = (
    Rule("mean_word_length", "mean_word_chars", 1.5, 25.0),
    Rule("symbol_ratio", "symbols_per_word", None, 0.25),
    Rule("upper_ratio", "upper_per_char", None, 0.40),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.60),
    Rule("stop_words", "stop_word_ratio", 0.02, None),
)


def base_columns(text: Column) -> dict[str, Column]:
    """The measures of the base rules, each an expression over the whole text."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, f"[{SPACE}]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    return {
        "_words": words,
        "_lines": lines,
        "_chars": F.length(F.regexp_replace(t, f"[{SPACE}]+", "")).cast("long"),
        "_symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
        "_upper": (F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long"),
    }


def repeated_words(words: Column) -> Column:
    """Number of words covered by three-word windows that occur at least twice.

    Windows are told apart by 64-bit hashes alone and sorted with their positions; a window with an equal neighbour
    is repeated. The positions, sorted again, each cover three words less the overlap with the next.
    """
    n = F.size(words)
    windows = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.struct(
            F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")
        ),
    )
    ordered = F.sort_array(windows)

    def positions(s: Column) -> Column:
        twice = F.filter(
            s,
            lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]),
        )
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        gaps = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, g: acc + g)

    # let-bindings by a one-element array keep each array evaluated once
    found = F.transform(F.transform(F.array(ordered), positions), covered)
    return F.when(n >= 3, F.get(found, F.lit(0))).otherwise(F.lit(0).cast("long"))


def _free(df: DataFrame) -> str:
    """A suffix that no column of ``df`` has, whatever the case."""
    tag = "_"
    while any(c.lower().endswith(tag) for c in df.columns):
        tag += "_"
    return tag


def measure(df: DataFrame, text: str = "text", lang: str | None = "lang") -> DataFrame:
    """Add the base measures, the ratios and ``base_failed``. No shuffle, no Python."""
    own, tag = df.columns, _free(df)
    base = base_columns(F.col(text))
    out = df.select("*", *[c.alias(k + tag) for k, c in base.items()])
    keep = [F.col(f"`{c}`") for c in own if c not in _MEASURES]
    words, lines_, chars, symbols, upper = (F.col(f"`{k}{tag}`") for k in base)
    n = F.size(words).cast("long")
    stop = sorted({w for ws in STOP_WORDS.values() for w in ws})
    hits = F.size(F.filter(words, lambda w: F.lower(w).isin(stop)))
    known = F.col(lang).isin(*STOP_WORDS) if lang and lang in own else F.lit(True)
    some = n > 0
    lines = F.size(lines_)
    dup = (lines - F.size(F.array_distinct(lines_))).cast("long")
    out = out.select(
        *keep,
        n.alias("n_words"),
        chars.alias("word_chars"),
        symbols.alias("n_symbols"),
        dup.alias("n_dup_lines"),
        repeated_words(words).alias("n_repeat_words"),
        F.when(some, chars / n).alias("mean_word_chars"),
        F.when(some, symbols / n).alias("symbols_per_word"),
        F.when(some, upper / chars).alias("upper_per_char"),
        F.when(lines > 0, dup / lines).alias("dup_line_ratio"),
        F.when(some & known, hits / n).alias("stop_word_ratio"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


_MEASURES = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "mean_word_chars", "symbols_per_word", "upper_per_char", "dup_line_ratio", "stop_word_ratio", "base_failed", "kept", "failed_rules"}


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """The threshold table as one array-valued expression: the names of the rules that fail."""
    checks = []
    for r in rules:
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (F.col(r.metric) < F.lit(float(r.low)))
        if r.high is not None:
            bad = bad | (F.col(r.metric) > F.lit(float(r.high)))
        checks.append(F.when(F.coalesce(bad, F.lit(False)), F.lit(r.name)))
    return F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")


def apply_rules(df: DataFrame, text: str = "text", lang: str | None = "lang", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All measures, ``failed_rules`` and ``kept`` for each row.

    The measures of a row come as the one element of an exploded array, behind which no filter on them can be pushed,
    so each is made once.
    """
    measured = measure(df, text, lang)
    own = [c for c in measured.columns if c not in _MEASURES]
    made, name = F.struct(*[F.col(c) for c in measured.columns if c in _MEASURES]), "made" + _free(measured)
    out = measured.select(*[F.col(f"`{c}`") for c in own], F.explode(F.array(made)).alias(name)).select(*[F.col(f"`{c}`") for c in own], f"{name}.*")
    out = out.withColumn("failed_rules", compile_rules(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def good_documents(df: DataFrame, text: str = "text", lang: str | None = "lang", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that all rules keep, with their columns as they were."""
    own = df.columns
    whole = F.struct(*[F.col(f"`{c}`") for c in own])
    slim = df.select(whole.alias("_row"), F.col(text).alias("_text"), (F.col(lang) if lang in own else F.lit(None).cast("string")).alias("_lang"))
    kept = apply_rules(slim, "_text", "_lang" if lang in own else None, rules).where("kept")
    return kept.select("_row.*")
