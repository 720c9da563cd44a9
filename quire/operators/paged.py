"""Kernels run over pages and documents: one Arrow group at a time, sorted by explicit indices."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.classify import is_table_cell
from quire.functions.geometry import Box
from quire.functions.text import strip
from quire.operators import kernels as k
from quire.operators.blocks import PAGE
from quire.session import materialise

_BOX = ["x0", "y0", "x1", "y1"]
_KINDS = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
_AT = "doc_id long, page_index long, block_index long"


def by_group(df: DataFrame, keys: list[str], order: list[str], kernel: Callable[[tuple, list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """Rows of each group, in order, through a kernel that gives output rows.

    One exchange on the keys and a sort inside partitions; groups stream past, many to an Arrow batch, so small
    groups cost no set-up each. A group is a page, or a document's page edges: never more than one fits.
    """
    return by_groups(df, keys, order, lambda groups: (row for key, rows in groups for row in kernel(key, rows)), schema, 1)


def by_groups(df: DataFrame, keys: list[str], order: list[str], kernel: Callable[[list[tuple[tuple, list[tuple]]]], Iterable[tuple]], schema: str, most: int = 4096) -> DataFrame:
    """``by_group`` for kernels that take a list of (key, rows), groups of about ``most`` rows together."""
    fields = [f.split() for f in schema.split(", ")]
    n = len(keys)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[kind]) for c, (_, kind) in zip(zip(*rows), fields)], [name for name, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns))

        out: list[tuple] = []
        groups: list[tuple[tuple, list[tuple]]] = []
        waiting = 0
        for key, group in groupby(rows(), key=lambda r: r[:n]):
            groups.append((key, list(group)))
            waiting += len(groups[-1][1])
            if waiting >= most:
                out.extend(kernel(groups))
                groups, waiting = [], 0
            if len(out) >= 4096:
                yield batch(out)
                out = []
        if groups:
            out.extend(kernel(groups))
        if out:
            yield batch(out)

    rest = [c for c in df.columns if c not in keys]
    dealt = df.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(run, schema)


def _box(r: tuple, at: int) -> tuple[float, ...]:
    """Four columns of a row as a box, a missing one as zeros."""
    return tuple(0.0 if v is None else v for v in r[at : at + 4])


def column_order(blocks: DataFrame) -> DataFrame:
    """Rank of each block in column-major order (WIN-03)."""

    def kernel(key: tuple, rows: list[tuple]) -> list[tuple]:
        order = k.column_major([_box(r, 3) for r in rows])
        return [(*rows[i][:3], rank) for rank, i in enumerate(order)]

    return by_group(blocks.select(*PAGE, "block_index", *_BOX), list(PAGE), ["block_index"], kernel, f"{_AT}, column_rank long")


def table_cells(blocks: DataFrame) -> DataFrame:
    """Cells of the one table of a page (WIN-04). Pages without candidates don't reach Python."""
    slim = blocks.where(is_table_cell(F.col("text"), Box.of())).select(*PAGE, "block_index", *_BOX, "text")

    def kernel(key: tuple, rows: list[tuple]) -> list[tuple]:
        cells = k.table_grid([_box(r, 3) for r in rows], list(range(len(rows))))
        return [(*rows[i][:3], rows[i][7], 0, r, c) for r, c, i in cells]

    return by_group(slim, list(PAGE), ["block_index"], kernel, f"{_AT}, text string, table_index long, row_index long, column_index long")


def greedy_match(truth: DataFrame, found: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Greedy best-IoU match per page; unmatched truth keeps its best IoU (JN-01)."""

    def kernel(key: tuple, rows: list[tuple]) -> list[tuple]:
        a, b = ([r for r in rows if r[2] == side] for side in (0, 1))
        got = k.greedy_match([_box(r, 4) for r in a], [_box(r, 4) for r in b], threshold)
        return [(*key, r[3], None if i is None else b[i][3], v) for r, (i, v) in zip(a, got)]

    side = lambda df, n: df.select(*PAGE, F.lit(n).alias("side"), "block_index", *_BOX)
    return by_group(side(truth, 0).union(side(found, 1)), list(PAGE), ["side", "block_index"], kernel, f"{_AT}, match_index long, iou double")


def align(boxes: DataFrame, texts: DataFrame) -> DataFrame:
    """Text of a page (doc_id, page_index, llm_text) bound to its boxes (JN-10)."""

    def kernel(groups: list[tuple[tuple, list[tuple]]]) -> Iterator[tuple]:
        pages = [([_box(r, 4) for r in rows if r[2] == 0], "\n".join(r[8] for r in rows if r[2] == 1 and r[8])) for _, rows in groups]
        for (key, _), found in zip(groups, k.align_pages(pages)):
            yield from ((*key, i, *box, t) for i, (box, t) in enumerate(found))

    none = F.lit(None).cast("double")
    left = boxes.select(*PAGE, F.lit(0).alias("side"), "block_index", *_BOX, F.lit(None).cast("string").alias("llm_text"))
    right = texts.select(*PAGE, F.lit(1).alias("side"), F.lit(0).cast("long").alias("block_index"), *[none.alias(c) for c in _BOX], "llm_text")
    return by_groups(left.union(right), list(PAGE), ["side", "block_index", "llm_text"], kernel, f"{_AT}, x0 double, y0 double, x1 double, y1 double, text string")


def cross_page_merge(blocks: DataFrame) -> DataFrame:
    """Unfinished last lines moved to the next page, along each document (JN-09).

    Only the first non-blank and the last block of a page can change, so only those reach the kernel.
    """
    page = Window.partitionBy(*PAGE)
    blank = strip(F.col("text")) == ""
    b = blocks.withColumn("_first", F.min(F.when(~blank, F.col("block_index"))).over(page)).withColumn("_last", F.max("block_index").over(page))
    edge = (F.col("block_index") == F.col("_first")) | (F.col("block_index") == F.col("_last"))

    def kernel(key: tuple, rows: list[tuple]) -> list[tuple]:
        pages = [list(g) for _, g in groupby(rows, key=lambda r: r[1])]
        merged = k.merge_pages([[r[3] or "" for r in p] for p in pages])
        return [(*r[:3], t if t or r[3] is not None else None) for p, ts in zip(pages, merged) for r, t in zip(p, ts)]  # no text stays none

    moved = by_group(b.where(edge).select(*PAGE, "block_index", "text"), ["doc_id"], ["page_index", "block_index"], kernel, f"{_AT}, text string")
    out = blocks.join(moved.withColumnRenamed("text", "_text"), [*PAGE, "block_index"], "left")
    return out.withColumn("text", F.coalesce("_text", "text")).drop("_text")


def mapped(c: Column, f: Callable, kind: str) -> Column:
    """A kernel of one text as an Arrow-batched function."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: None if x is None else f(x))

    return run(c)


# Scripts by the name that the regular expressions of Java know them under.
NAMED = {"Latin": "Latin", "CJK": "Han", "Hiragana": "Hiragana", "Katakana": "Katakana", "Arabic": "Arabic", "Devanagari": "Devanagari", "Cyrillic": "Cyrillic", "Greek": "Greek", "Hebrew": "Hebrew", "Hangul": "Hangul"}


def script(c: Column) -> Column:
    """struct(script, confidence): the script of most letters and its share; kana and hangul are named CJK (STR-17).

    Letters are counted per range, and beyond all ranges by their script property. Of equals the one seen first wins.
    A text whose letters are all of the Latin range is counted once.
    """
    spans = "".join(f"\\x{{{lo:x}}}-\\x{{{hi:x}}}" for lo, hi in k.SCRIPTS.values())
    counts = []
    for name, (lo, hi) in k.SCRIPTS.items():
        mine = F.lit(f"[\\p{{L}}&&[[\\x{{{lo:x}}}-\\x{{{hi:x}}}]" + f"[\\p{{Is{NAMED[name]}}}&&[^{spans}]]]]")
        n = F.regexp_count(c, mine)
        counts.append(F.struct(n.alias("n"), F.when(n > 0, -F.regexp_instr(c, mine)).alias("first"), F.lit(name).alias("name")))

    def best(s: Column) -> Column:
        total = F.aggregate(s, F.lit(0), lambda a, x: a + x["n"])
        top = F.array_max(s)
        named = F.when(top["name"].isin("Hiragana", "Katakana", "Hangul"), "CJK").otherwise(top["name"])
        return F.struct(F.when(total > 0, named).alias("script"), F.when(total > 0, top["n"] / total).alias("confidence"))

    lo, hi = k.SCRIPTS["Latin"]
    some = c.rlike(r"\p{L}")
    latin = F.struct(F.when(some, "Latin").alias("script"), F.when(some, 1.0).alias("confidence"))
    return F.when(~c.rlike(f"[\\p{{L}}&&[^\\x{{{lo:x}}}-\\x{{{hi:x}}}]]"), latin).otherwise(F.get(F.transform(F.array(F.array(*counts)), best), F.lit(0)))


def similarity(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else k.similarity(p, q) for p, q in zip(x, y)], dtype="float64")

    return run(a, b)


def chunk_documents(docs: DataFrame, most: int = 4000) -> DataFrame:
    """(doc_id, chunk_index, chunk) (STR-23), for a few documents of a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            rows = [(d, i, c) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i, c in enumerate(k.chunks(t or "", most))]
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["doc_id", "chunk_index", "chunk"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, chunk_index long, chunk string")


def repair_blocks(blocks: DataFrame, retry: Callable[[str], tuple[str, float]], target: float = 0.98, attempts: int = 2) -> DataFrame:
    """Blocks below the target read again by an injected callable (MISC-06); others don't reach Python."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            got = [k.repair(x, c, retry, target, attempts) for x, c in zip(t["text"], t["confidence"])]
            yield t.assign(text=[g[0] for g in got], confidence=[g[1] for g in got], attempts=[g[2] for g in got])

    low = F.coalesce("confidence", F.lit(0.0)) < target
    some = blocks.where(low).withColumn("confidence", F.coalesce("confidence", F.lit(0.0))).withColumn("attempts", F.lit(0).cast("long"))
    done = some.mapInPandas(run, some.schema)
    return done.unionByName(blocks.where(~low).withColumn("attempts", F.lit(0).cast("long")))


MAX_TERMS = 100_000
FOLDED = 64  # so few terms become one expression of built-in functions
SENT = 200_000  # so few corrections are sent along with the texts' words


def without_one(word: Column) -> Column:
    """The word and what is left of it when one letter goes: words one edit apart have one of these in common."""
    n = F.length(word)
    shorter = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n)))
    return F.array_distinct(F.when(n > 0, F.concat(F.array(word), shorter)).otherwise(F.array(word)))


def one_apart(a: Column, b: Column) -> Column:
    """One letter more, less, other, or two neighbours swapped."""
    other = F.filter(F.sequence(F.lit(1), F.length(a)), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    at = lambda c, k: F.substring(c, F.get(other, F.lit(k)), F.lit(1))
    swapped = (F.length(a) == F.length(b)) & (F.size(other) == 2) & (F.get(other, F.lit(1)) - F.get(other, F.lit(0)) == 1) & (at(a, 0) == at(b, 1)) & (at(a, 1) == at(b, 0))
    return (F.levenshtein(a, b) == 1) | swapped


def corrections(unknown: DataFrame, words: DataFrame) -> DataFrame:
    """(word, new) of the ``word`` rows that aren't known and have exactly one known word at one edit.

    Both sides are indexed by what is left without one letter and meet there, so the dictionary may have any size and no word
    is held against all of it.
    """
    known = materialise(words.select("word").where("word IS NOT NULL").distinct(), "known")
    lost = unknown.select("word").distinct().join(known, "word", "left_anti")
    index = known.select(F.col("word").alias("new"), F.explode(without_one(F.col("word"))).alias("key"))
    tried = lost.select("word", F.explode(without_one(F.col("word"))).alias("key"))
    near = tried.join(index, "key").where(one_apart(F.col("word"), F.col("new"))).select("word", "new").distinct()
    return near.groupBy("word").agg(F.count("*").alias("n"), F.first("new").alias("new")).where("n = 1").select("word", "new")


def spell(texts: DataFrame, words: DataFrame, text: str = "text", word: str = "word") -> DataFrame:
    """Texts with certain misspellings replaced, casing kept (STR-31).

    Corrections are made once for each different word of all texts and joined to the words of each; a text with some
    gets its own few along.
    """

    @F.pandas_udf("array<string>")
    def different(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [] if x is None else sorted({w.lower() for w in k.WORD.findall(x)}))

    @F.pandas_udf("string")
    def run(s: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([x if x is None or f is None else k.respell(x, {p["word"]: p["new"] for p in f}) for x, f in zip(s, found)], dtype=object)

    rows = materialise(texts.withColumn("_row", F.monotonically_increasing_id()).withColumn("_words", different(F.col(text))), "texts")
    each = rows.select("_row", F.explode("_words").alias("word"))
    fixes = materialise(corrections(each, words.select(F.col(word).alias("word"))), "corrections")
    few = fixes.limit(SENT + 1).count() <= SENT
    hits = each.join(F.broadcast(fixes) if few else fixes, "word").groupBy("_row").agg(F.collect_list(F.struct("word", "new")).alias("_fixes"))
    return rows.join(hits, "_row", "left").withColumn(text, run(F.col(text), F.col("_fixes"))).select(*[F.col(f"`{c}`") for c in texts.columns])


def apply_glossary(texts: DataFrame, entries: DataFrame, text: str = "text") -> DataFrame:
    """Terms replaced one after another (STR-18); the glossary is sent along, behind a check of its size."""
    rows = entries.select("source", "target", "case_sensitive").limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"a glossary to apply has at most {MAX_TERMS} terms")
    terms = sorted((tuple(r) for r in rows), key=lambda e: (-len(e[0]), e))
    if len(terms) <= FOLDED and not any(set(t) & set("\\$") for _, t, _ in terms):
        out = F.col(text)
        for source, target, case in terms:
            if source.strip():
                out = F.regexp_replace(out, ("" if case else "(?iu)") + re.escape(source), target)
        return texts.withColumn(text, out)
    return texts.withColumn(text, mapped(F.col(text), lambda x: k.apply_glossary(x, terms), "string"))


def evaluation_answer(c: Column) -> Column:
    """struct(score, feedback) of a judge's answer (STR-24)."""

    @F.pandas_udf("score double, feedback string")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([k.parse_evaluation(x or "") for x in s], columns=["score", "feedback"])

    return run(c)


def redacted(c: Column, mask: Callable) -> Column:
    """A JSON text with sensitive values masked by ``redact_report`` or ``redact_error`` (PRJ-20, PRJ-22)."""
    import json

    return mapped(c, lambda x: json.dumps(mask(json.loads(x)), ensure_ascii=False, separators=(",", ":")), "string")


def salvage(c: Column, objects_only: bool = False) -> Column:
    """The JSON in a model's answer as text, null where there is none (STR-25, STR-44)."""
    import json

    def found(x: str) -> str | None:
        v = k.find_json(x, objects_only)
        return None if v is None else json.dumps(v, ensure_ascii=False, separators=(",", ":"))

    return mapped(c, found, "string")
