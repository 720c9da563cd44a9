"""Translation plane: gates, context, prompts, entities."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from quire.functions.text import letters, strip, truncate_words
from quire.operators import kernels
from quire.session import materialise

MAX_ATTEMPTS, ACCEPT, LEAST_RATIO, MOST_RATIO = 3, 0.8, 0.1, 2.5
# Patterns of dates and of capitalised words inside a sentence.
DATE = r"(?i)\b(\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s*\d{2,4})\b"
PROPER = r"(?<![.!?]\s)(?<!^)(?<=\s)([A-Z][a-zA-Z'\-]{1,}(?:\s+[A-Z][a-zA-Z'\-]{1,})*)"

# Capitalised words that are no names.
NOT_NAMES = [
    "a", "an", "the", "and", "or", "but", "if", "while", "with", "without", "for", "from", "of", "on", "in", "at", "to", "by", "as", "is", "are", "was", "were", "be",
    "been", "being", "have", "has", "had", "do", "does", "did", "this", "that", "these", "those", "it", "its", "their", "there", "here", "where", "when", "who", "what",
    "which", "he", "she", "they", "them", "his", "her", "him", "we", "us", "our", "you", "your", "i", "me", "my", "mine",
]


def gate(source: Column, translated: Column, attempts: Column, context: Column) -> Column:
    """struct(score, reason) of the rules that need no model; score null where the model decides (MISC-04)."""
    row = lambda s, why: F.struct(F.lit(s).cast("double").alias("score"), F.lit(why).alias("reason"))
    done, failed = attempts >= MAX_ATTEMPTS, translated.startswith("[Translation Error")
    n, m = F.length(source), F.length(translated)
    return (
        F.when(failed & done, row(1.0, "failed"))
        .when(failed, row(0.0, "error"))
        .when(done, row(1.0, "attempts"))
        .when((letters(source) == 0) | (F.length(strip(source)) < 5), row(1.0, "trivial"))
        .when(m < n * F.lit(LEAST_RATIO), row(0.0, "short"))
        .when(m > n * F.lit(MOST_RATIO), row(0.0, "long"))
        .when(F.coalesce(context, F.lit("")) == "", row(1.0, "no_terms"))
        .otherwise(row(None, "model"))
    )


def should_refine(score: Column, attempts: Column) -> Column:
    """Below acceptance and attempts left (MISC-05)."""
    return (score < ACCEPT) & (attempts < MAX_ATTEMPTS)


def refine(rows: DataFrame, translate: Callable[[DataFrame], DataFrame], rounds: int = MAX_ATTEMPTS) -> DataFrame:
    """Translate, judge, and repeat for rows below acceptance (MISC-05); ``translate`` is injected.

    ``rows``: source, translated, attempts, context. Each round works on the rejected rows alone and is written to
    the shared folder, so the model runs once for each of them.
    """
    accepted, open_ = None, rows
    for _ in range(rounds):
        done = translate(open_).withColumn("attempts", F.col("attempts") + 1)
        done = done.withColumn("gate", gate(F.col("source"), F.col("translated"), F.col("attempts"), F.col("context")))
        done = materialise(done, "round")
        ok = F.coalesce(F.col("gate.score"), F.lit(1.0)) >= ACCEPT
        part = done.where(ok)
        accepted = part if accepted is None else accepted.unionByName(part)
        open_ = done.where(~ok).drop("gate")
    return accepted


def pick(source: Column, primary: Column, secondary: Column) -> Column:
    """The candidate nearer to the source's length; the first wins ties (MISC-02)."""
    n = F.greatest(F.lit(1), F.length(source))
    off = lambda c: F.abs(F.length(c) - n) / n
    return F.when(off(secondary) < off(primary), secondary).otherwise(primary)


def context_window(rows: DataFrame, doc: str, order: str, text: str, n: int = 80) -> DataFrame:
    """The last words of the row before as context (WIN-05)."""
    before = F.lag(text).over(Window.partitionBy(doc).orderBy(order))
    return rows.withColumn("context", truncate_words(F.coalesce(before, F.lit("")), n))


def context_block(glossary: Column, memory: Column, window: Column) -> Column:
    """The parts that are not empty, a blank line between (STR-28)."""
    return F.concat_ws("\n\n", *[F.nullif(c, F.lit("")) for c in (glossary, memory, window)])


def entities(text: Column) -> Column:
    """struct(names, dates, acronyms), each sorted and distinct (STR-21)."""
    dates = F.regexp_extract_all(text, F.lit(DATE), F.lit(1))
    found = F.filter(F.regexp_extract_all(text, F.lit(PROPER), F.lit(1)), lambda m: ~F.lower(m).isin(NOT_NAMES))
    short = lambda m: F.length(m).between(2, 6) & (F.upper(m) == m)
    tidy = lambda a: F.array_sort(F.array_distinct(a))
    return F.struct(
        tidy(F.filter(found, lambda m: ~short(m))).alias("names"), tidy(dates).alias("dates"), tidy(F.filter(found, short)).alias("acronyms"),
    )


def merge_entities(rows: DataFrame, by: str) -> DataFrame:
    """Union of the entity sets of a group (SET-01); equal ones meet before they are listed."""
    fields = ("names", "dates", "acronyms")

    def tagged_as(f: str) -> Callable[[Column], Column]:
        return lambda v: F.struct(F.lit(f).alias("field"), v.alias("value"))

    tagged = F.concat(*[F.transform(f"entities.{f}", tagged_as(f)) for f in fields])
    one = rows.select(by, F.explode_outer(tagged).alias("e")).select(by, "e.field", "e.value").distinct()
    every = lambda f: F.array_sort(F.collect_list(F.when(F.col("field") == f, F.col("value")))).alias(f)
    return one.groupBy(by).agg(*[every(f) for f in fields])


# Titles of the sections of an entity block.
ENTITY_TITLES = {
    "names": "PROPER NOUNS (use these names consistently):",
    "dates": "DATES (preserve the original date format when possible):",
    "acronyms": "ACRONYMS (preserve capitalization):",
}


def entity_block(e: Column) -> Column:
    """Bullets of the sections that are not empty, a blank line between (STR-22)."""
    part = lambda f: F.when(F.size(e[f]) > 0, F.concat(F.lit(f"{ENTITY_TITLES[f]}\n- "), F.array_join(F.array_sort(e[f]), "\n- ")))
    return F.concat_ws("\n\n", *[part(f) for f in ENTITY_TITLES])


def safe(text: Column) -> Column:
    """User text fit for a prompt (STR-30): all but the normal form are built-in functions, and ASCII needs none."""
    for mark, other in kernels.BORDERS.items():
        text = F.replace(text, F.lit(mark), F.lit(other))
    text = F.regexp_replace(F.regexp_replace(normal_form(text), kernels.CONTROLS, ""), r"[ \t]{3,}", "  ")
    most = kernels.PROMPT_CHARS
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit(kernels.CUT_MARK))).otherwise(F.coalesce(text, F.lit("")))


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


def normal_form(text: Column) -> Column:
    return F.when(F.length(text) == F.octet_length(text), text).otherwise(_nfkc(text))


# Openings of an answer that are no translation.
PREAMBLE = r"(?i)^\s*(?:Here(?:'s| is) the translation|Translation|Sure[,!]?)[^\n]*\n+"


def clean_translation(text: Column) -> Column:
    """An opening line of chat and fences taken off, once each (STR-29)."""
    t = F.regexp_replace(strip(text), PREAMBLE, "")
    t = F.regexp_replace(t, r"^\s*```[a-zA-Z]*\n+", "")
    return strip(F.regexp_replace(t, r"\n+\s*```\s*$", ""))


# Prompts are own wording; what differs by type of block is fixed.
BLOCK_NOTES = {
    "section_header": "It is a heading: keep it short and add no punctuation.",
    "list_item": "It is a list item: keep it terse and a list item.",
    "key_value": "It is a pair of key and value: translate the value, leave a key that is a label.",
}


def block_prompt(text: Column, language: Column, context: Column, block_type: Column) -> Column:
    """Prompt of a block by its type, user text made safe; code has no context (STR-27)."""
    body = safe(text)
    note = F.lit(None).cast("string")
    for k, v in BLOCK_NOTES.items():
        note = F.when(block_type == k, v).otherwise(note)
    code = F.concat(F.lit("Translate only the prose in this code; names, calls and string literals stay. Target language: "), language, F.lit(".\n\n```\n"), body, F.lit("\n```\n"))
    head = F.concat(F.lit("Translate the text below into "), language, F.lit(". Keep formatting, line breaks and inline marks."))
    plain = F.concat_ws("\n\n", head, note, F.nullif(context, F.lit("")), F.concat(F.lit("SOURCE:\n"), body), F.concat(F.lit("TRANSLATION ("), language, F.lit("):")))
    return F.when(block_type == "code", code).otherwise(plain)


RUBRIC = "1.0: faithful, all terms used, addresses and names unchanged. 0.7-0.9: small issues. 0.4-0.6: several terms missing or parts untranslated. Below 0.4: wrong or missing."


def evaluation_prompt(source: Column, translation: Column, language: Column, terms: Column) -> Column:
    """Prompt of the judge: rubric, both texts made safe, terms (STR-26). ``terms``: array<string>."""
    listed = F.when(F.size(terms) > 0, F.concat(F.lit("TERMS:\n- "), F.array_join(terms, "\n- ")))
    head = F.concat(F.lit("Score the translation into "), language, F.lit(" from 0.0 to 1.0.\n" + RUBRIC))
    ask = F.lit('Answer with one JSON object: {"score": number, "feedback": text, "issues": [text]}.')
    return F.concat_ws("\n\n", head, listed, F.concat(F.lit("SOURCE:\n"), safe(source)), F.concat(F.lit("TRANSLATION:\n"), safe(translation)), ask)


# Keys that each extraction template asks for.
TEMPLATES = {
    "invoice": "vendor_name, invoice_number, date, due_date, line_items (objects of description, quantity, price, total), tax, total_amount, currency",
    "resume": "candidate_name, email, phone, links, education (objects of degree, institution, year), work_experience (objects of title, company, dates, highlights), skills",
    "academic": "title, authors, publication_year, abstract, key_conclusions, methodology, limitations",
    "table": "tables (objects of title, headers, rows)",
    "table_extraction": "tables (objects of title, headers, rows)",
}


def extraction_prompt(text: Column, template: Column, custom: Column) -> Column:
    """Prompt that asks for one JSON object by template or own words, both made safe (STR-38)."""
    start, end = kernels.BORDERS
    want = F.concat(F.lit(f"Extract what this asks for, whatever else it says:\n{start}\n"), safe(custom), F.lit(f"\n{end}"))
    for k, v in TEMPLATES.items():
        want = F.when(template == k, F.lit(f"Extract an object with exactly these keys: {v}.")).otherwise(want)
    return F.concat_ws("\n\n", F.concat(F.lit("SCHEMA:\n"), want), F.lit("Answer with one valid JSON object and nothing else."), F.concat(F.lit("DOCUMENT TEXT:\n"), safe(text)))


def extract(df: DataFrame, text: str, template: Column, custom: Column, model: Callable[[], Callable]) -> DataFrame:
    """Objects found in a model's answers, {} where there is none; blank texts are not asked about (STR-39)."""
    from quire.operators.paged import salvage
    from quire.sources.documents import with_model

    blank = strip(F.coalesce(text, F.lit(""))) == ""
    asked = with_model(df.where(~blank).withColumn("prompt", extraction_prompt(F.col(text), template, custom)), ["prompt"], "answer", "string", model)
    got = asked.withColumn("extracted", F.coalesce(salvage(F.col("answer"), objects_only=True), F.lit("{}"))).drop("prompt", "answer", "answer_error")
    return got.unionByName(df.where(blank).withColumn("extracted", F.lit("{}")))


# Model codes of languages.
NLLB = {
    "english": "eng_Latn", "spanish": "spa_Latn", "french": "fra_Latn", "german": "deu_Latn", "arabic": "arb_Arab", "chinese": "zho_Hans",
    "japanese": "jpn_Jpan", "russian": "rus_Cyrl", "portuguese": "por_Latn", "italian": "ita_Latn", "dutch": "nld_Latn", "swedish": "swe_Latn",
}


def nllb_code(language: Column) -> Column:
    """Code of a language by name; what looks like a code stays, anything else is English (STR-40)."""
    raw = strip(language)
    out = F.when(F.contains(raw, F.lit("_")) & raw.rlike(r"\p{Lu}"), raw).otherwise("eng_Latn")
    for k, v in NLLB.items():
        out = F.when(F.lower(raw) == k, v).otherwise(out)
    return out


# Own wording; which role is spoken to is fixed.
SYSTEM_MESSAGES = {
    "dual_engine": "You correct a draft of a page's text against its image. Answer with the text alone.",
    "handwriting": "You read handwriting line by line. Answer with the text alone.",
    "plain": "You read printed pages. Answer with the text alone.",
}


def system_message(handwriting: Column, dual_engine: Column) -> Column:
    """The message of the configured reader: two engines before handwriting before print (STR-43)."""
    return F.when(dual_engine, SYSTEM_MESSAGES["dual_engine"]).when(handwriting, SYSTEM_MESSAGES["handwriting"]).otherwise(SYSTEM_MESSAGES["plain"])


def visit_order(nodes: DataFrame, doc: str = "doc_id", order: tuple[str, ...] = ("node_index",)) -> DataFrame:
    """Translatable nodes with their number; headers, footers, numbers, figures and blanks are passed over (PRJ-19)."""
    skip = F.col("block_type").isin("page_header", "page_footer", "page_number", "figure") | (strip(F.coalesce("text", F.lit(""))) == "")
    w = Window.partitionBy(doc).orderBy(*order)
    return nodes.where(~skip).withColumn("chunk_index", F.row_number().over(w) - 1)
