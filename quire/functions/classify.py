"""Classifiers of blocks, each one ``when`` chain that stays inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.geometry import Box
from quire.functions.text import capitals, letters, squeeze, strip, words

# What starts a list item, a key-value line (only a newline ends a line), a numeric expression. A vertical tab
# is no white space and U+0085 ends no line, as in SQL.
_S = r"\t\n\f\r "
LIST_ITEM = rf"^[{_S}]*(?:[-*•◦–—]|\(?\d+[).]|\(?[A-Za-z][).])[{_S}]+"
KEY_VALUE = rf"(?d)^[{_S}]*([^:\n]{{1,50}}):[{_S}]*([^{_S}].+)$"
COLUMNS = rf"\t+|\|+|[{_S}]{{2,}}"
NUMERIC = rf"^[\d{_S}.,:/\-+$€£%()#№]+\z"


def _columns(t: Column) -> Column:
    return F.size(F.filter(F.split(t, COLUMNS), lambda x: strip(x) != ""))


def _prominent(t: Column, max_chars: int, max_words: int) -> Column:
    """Short, one line, no closing mark, mostly capitals or titled words."""
    w = words(t)
    titled = F.size(F.filter(w, lambda x: x.rlike(r"^\p{Lu}")))
    n = letters(t)
    ok = ~F.contains(t, F.lit("\n")) & (F.length(t) <= max_chars) & (F.size(w) <= max_words) & ~t.rlike("[.,;:]\\z") & (n > 0)
    return ok & ((capitals(t) / F.greatest(n, F.lit(1)) >= 0.65) | (titled >= F.greatest(F.lit(1), F.floor(F.size(w) / 2))))


def structure_kind(text: Column) -> Column:
    """empty, list_item, key_value, table_candidate, heading or paragraph; the first that fits (STR-01, STR-02)."""
    t = strip(text)
    key = F.regexp_extract(t, KEY_VALUE, 1)
    return (
        F.when(t == "", "empty")
        .when(t.rlike(LIST_ITEM), "list_item")
        .when((key != "") & (F.size(words(key)) <= 6), "key_value")
        .when(_columns(t) >= 3, "table_candidate")
        .when(_prominent(t, 90, 12), "heading")
        .otherwise("paragraph")
    )


def kind_of(metadata: Column, kind: Column) -> Column:
    """The kind that the structure part of a block's metadata names, else its own (PRJ-08). ``metadata``: JSON text."""
    return F.coalesce(F.from_json(metadata, "structure struct<kind:string>")["structure"]["kind"], kind)


# Confidence and signal of each kind.
STRUCTURE = {
    "empty": (1.0, "blank_text"),
    "list_item": (0.86, "list_marker"),
    "key_value": (0.84, "colon_key_value"),
    "table_candidate": (0.76, "column_separators"),
    "heading": (0.68, "short_prominent_text"),
    "paragraph": (0.55, "default_text"),
}


def structure(kind: Column) -> Column:
    """struct(kind, confidence, signals) of a kind."""
    conf, signal = F.lit(0.0), F.lit("")
    for k, (c, s) in STRUCTURE.items():
        conf, signal = F.when(kind == k, F.lit(c)).otherwise(conf), F.when(kind == k, F.lit(s)).otherwise(signal)
    return F.struct(kind.alias("kind"), conf.alias("confidence"), F.array(signal).alias("signals"))


def is_section_heading(text: Column, kind: Column) -> Column:
    """A heading, or plain text that looks like one under wider limits (STR-03)."""
    t = strip(text)
    plain = kind.isin("text", "paragraph") & (t != "") & _prominent(t, 120, 14)
    plain = plain & ~t.rlike(LIST_ITEM) & ~t.rlike(KEY_VALUE) & (_columns(t) < 3)
    return (kind == "heading") | plain


def layout_role(text: Column, kind: Column, box: Box) -> Column:
    """header, page_number, footer, caption, title_block, figure or body (STR-04)."""
    t = squeeze(text)
    low, region = F.lower(t), box.region
    return (
        F.when((region == "header") & (t != "") & (F.length(t) <= 120), "header")
        .when((region == "footer") & (t.rlike(r"^\p{Nd}+\z") | low.startswith("page ") | low.startswith("p. ")), "page_number")
        .when((region == "footer") & (t != "") & (F.length(t) <= 140), "footer")
        .when(low.rlike(r"^(?:figure |fig\. |table |caption:)"), "caption")
        .when((kind == "heading") & (box.y0 < 0.28), "title_block")
        .when((t == "") & (box.area >= 0.08), "figure")
        .otherwise("body")
    )


# Confidence and second signal of each role.
LAYOUT = {
    "header": (0.72, "top_short_text"),
    "page_number": (0.82, "footer_page_number"),
    "footer": (0.7, "bottom_short_text"),
    "caption": (0.82, "caption_prefix"),
    "title_block": (0.76, "early_heading"),
    "figure": (0.58, "large_empty_region"),
    "body": (0.5, None),
}


def layout(role: Column, box: Box) -> Column:
    """struct(role, region, confidence, signals); narrow body blocks are side columns."""
    narrow = (role == "body") & (box.width < 0.32)
    region = F.when(narrow, F.concat(box.region, F.lit("_side"))).otherwise(box.region)
    conf, signal = F.lit(0.5), F.lit(None).cast("string")
    for k, (c, s) in LAYOUT.items():
        conf = F.when(role == k, F.lit(c)).otherwise(conf)
        if s:
            signal = F.when(role == k, F.lit(s)).otherwise(signal)
    signal = F.when(narrow, F.lit("narrow_column")).otherwise(signal)
    signals = F.array_compact(F.array(F.concat(F.lit("region:"), box.region), signal))
    return F.struct(role.alias("role"), region.alias("region"), conf.alias("confidence"), signals.alias("signals"))


def simple_type(text: Column) -> Column:
    """section_header for short text in capitals, else paragraph (STR-05)."""
    t = strip(text)
    n = letters(t)
    return F.when((F.length(t) <= 80) & (n > 0) & (capitals(t) / F.greatest(n, F.lit(1)) >= 0.65), "section_header").otherwise("paragraph")


def is_table_cell(text: Column, box: Box) -> Column:
    """Has a column mark, or is short and small (STR-06)."""
    t = squeeze(text)
    return (t != "") & (F.contains(t, F.lit("|")) | ((F.length(t) <= 24) & (box.width < 0.35) & (box.area < 0.08)))


def estimate_confidence(text: Column) -> Column:
    """Cheap confidence of recognised text (STR-07)."""
    t = strip(F.coalesce(text, F.lit("")))
    alpha, n = letters(t), F.size(words(t))
    return (
        F.when(t == "", 0.0)
        .when(alpha == 0, F.when(t.rlike(NUMERIC), 0.99).otherwise(0.3))
        .when(n >= 3, F.when(alpha / F.length(t) >= 0.6, 0.99).otherwise(0.85))
        .when(alpha >= 3, 0.7)
        .otherwise(0.4)
    )


def recogniser_confidence(text: Column) -> Column:
    """0 empty, .2 without vowel, ideograph or Arabic letter, .85 from three words, else .7 (STR-42)."""
    t = strip(text)
    seen = t.rlike("[aeiouyAEIOUY\\x{4e00}-\\x{9fff}\\x{0600}-\\x{06ff}]")
    return F.when(text == "", 0.0).when(~seen, 0.2).when(F.size(words(t)) >= 3, 0.85).otherwise(0.7)
