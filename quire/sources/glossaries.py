"""Readers of glossary files into (source, target, case_sensitive, notes, grp) rows with ``pos``.

Files are read by Spark's own sources (csv, json, xml, text, jdbc), so any store that Spark reads will do.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.text import language_matches, parse_bool, squeeze, strip
from quire.sources.documents import decode

MAX_ENTRIES = 1_000_000
FIELDS = ["source", "target", "case_sensitive", "notes", "grp"]


def _tidy(df: DataFrame) -> DataFrame:
    """Trimmed pairs with both sides, numbered in order of the file."""
    df = df.withColumn("source", strip(F.col("source"))).withColumn("target", strip(F.col("target")))
    return df.where((F.col("source") != "") & (F.col("target") != ""))


def sniff(head: str) -> str:
    """Delimiter of a table's first lines: the most frequent of four in the header, tab before comma in doubt."""
    first = head[:8192].split("\n", 1)[0]
    counts = {d: first.count(d) for d in ",\t;|"}
    best = max(counts, key=counts.get)
    return best if counts[best] else "\t" if "\t" in head[:8192] else ","


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """CSV or TSV with a header of any case; source and target are needed (SRC-10 to SRC-12)."""
    if delimiter is None:
        delimiter = sniff("\n".join(r[0] for r in spark.read.text(path).limit(20).collect()))
    df = spark.read.csv(path, header=True, sep=delimiter, encoding=encoding, multiLine=True, escape='"')
    df = df.toDF(*[c.replace("﻿", "").strip().lower() for c in df.columns])
    if not {"source", "target"} <= set(df.columns):
        raise ValueError("a glossary table needs source and target columns")
    get = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    df = df.withColumn("pos", F.monotonically_increasing_id())
    return _tidy(df.select("pos", get("source").alias("source"), get("target").alias("target"), parse_bool(get("case_sensitive")).alias("case_sensitive"), F.coalesce(get("notes"), F.lit("")).alias("notes"), get("group").alias("grp")))


def read_json_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Object with a list of entries; invalid ones are dropped (SRC-13)."""
    kind = "entries array<struct<source:string,target:string,case_sensitive:boolean,notes:string,group:string>>"
    e = spark.read.schema(kind).json(path, multiLine=True).select(F.posexplode("entries").alias("pos", "e"))
    return _tidy(e.select("pos", "e.source", "e.target", F.coalesce("e.case_sensitive", F.lit(False)).alias("case_sensitive"), F.coalesce("e.notes", F.lit("")).alias("notes"), F.col("e.group").alias("grp")))


def _pairs(df: DataFrame) -> DataFrame:
    return _tidy(df.select("pos", "source", "target", F.lit(False).alias("case_sensitive"), F.lit("").alias("notes"), F.lit(None).cast("string").alias("grp")))


def read_tbx(spark: SparkSession, path: str, source_lang: str = "en") -> DataFrame:
    """Per entry every source-language term with the first term of another language (SRC-14)."""
    kind = "langSet array<struct<`_xml:lang`:string,tig:array<struct<term:string>>,ntig:array<struct<termGrp:struct<term:string>>>>>"
    e = spark.read.format("xml").options(rowTag="termEntry").schema(kind).load(path).withColumn("pos", F.monotonically_increasing_id())
    sets = F.transform("langSet", lambda s: F.struct(s["_xml:lang"].alias("lang"), F.coalesce(F.transform(s["tig"], lambda t: t["term"]), F.transform(s["ntig"], lambda t: t["termGrp"]["term"])).alias("terms")))
    e = e.withColumn("sets", sets)
    mine = F.filter("sets", lambda s: language_matches(s["lang"], F.lit(source_lang)))
    rest = F.filter("sets", lambda s: ~F.coalesce(language_matches(s["lang"], F.lit(source_lang)), F.lit(False)))
    two = (F.size(mine) == 0) & (F.size("sets") >= 2)
    src = F.when(two, F.slice("sets", 1, 1)).otherwise(mine)
    tgt = F.when(two, F.slice("sets", 2, 1)).otherwise(rest)
    target = F.get(F.flatten(F.transform(tgt, lambda s: s["terms"])), F.lit(0))
    return _pairs(e.select("pos", F.explode(F.flatten(F.transform(src, lambda s: s["terms"]))).alias("source"), target.alias("target")))


def read_tmx(spark: SparkSession, path: str, source_lang: str = "en") -> DataFrame:
    """Per unit the first variant in the source language and the first other value in another (SRC-15)."""
    kind = "tuv array<struct<`_xml:lang`:string,_lang:string,seg:string>>"
    u = spark.read.format("xml").options(rowTag="tu").schema(kind).load(path).withColumn("pos", F.monotonically_increasing_id())
    v = F.transform("tuv", lambda t: F.struct(F.coalesce(t["_xml:lang"], t["_lang"]).alias("lang"), t["seg"].alias("seg")))
    u = u.withColumn("v", v)
    mine = F.filter("v", lambda x: F.coalesce(language_matches(x["lang"], F.lit(source_lang)), F.lit(False)))
    u = u.withColumn("s", F.coalesce(F.get(mine, F.lit(0)), F.get("v", F.lit(0))))
    other = F.filter("v", lambda x: ~F.coalesce(language_matches(x["lang"], F.col("s.lang")), F.lit(False)) & (x["seg"] != F.col("s.seg")))
    return _pairs(u.select("pos", F.col("s.seg").alias("source"), F.get(other, F.lit(0))["seg"].alias("target")))


def read_xliff(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of version 1.2 units, or of version 2 segments where there are none (SRC-16)."""
    one = spark.read.format("xml").options(rowTag="trans-unit").schema("source string, target string").load(path)
    if not one.limit(1).count():
        one = spark.read.format("xml").options(rowTag="segment").schema("source string, target string").load(path)
    return _pairs(one.withColumn("pos", F.monotonically_increasing_id()))


def parse_text(lines: DataFrame) -> DataFrame:
    """Rows (doc, pos, line): ``a = b`` lines; where a document has none, table rows and ``a -> b`` (SRC-20)."""
    w = Window.partitionBy("doc").orderBy("pos")
    line = strip(F.col("line"))
    r = lines.withColumn("line", line).withColumn("next", F.lead(line).over(w))
    eq = r.withColumn("source", F.regexp_extract("line", r"^([^=#|]+?)\s*=\s*(.+)$", 1)).withColumn("target", F.regexp_extract("line", r"^([^=#|]+?)\s*=\s*(.+)$", 2)).where("source <> ''")
    rule = r"^\|?\s*:?-{2,}"
    cells = F.filter(F.transform(F.split("line", r"\|"), squeeze), lambda x: x != "")
    row = F.col("line").startswith("|") & ~F.col("line").rlike(rule) & ~F.coalesce(F.col("next").rlike(rule), F.lit(False))
    other = r.withColumn("source", F.when(row, F.get(cells, F.lit(0))).otherwise(F.regexp_extract("line", r"^[-*]?\s*(.+?)\s*->\s*(.+)$", 1)))
    other = other.withColumn("target", F.when(row, F.get(cells, F.lit(1))).otherwise(F.regexp_extract("line", r"^[-*]?\s*(.+?)\s*->\s*(.+)$", 2)))
    other = other.where("source <> '' and target <> ''").join(eq.select("doc").distinct(), "doc", "left_anti")
    return eq.select("doc", "pos", "source", "target").unionByName(other.select("doc", "pos", "source", "target"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.input_file_name().alias("doc"), F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))
    return _pairs(parse_text(lines))


# --- a small language of predicates (SRC-17, SRC-18)

_TERM = re.compile(r"\s*([A-Za-z_]\w*)\s*(<=|>=|<>|!=|=|<|>|LIKE\b)\s*('(?:[^']|'')*'|-?\d+(?:\.\d+)?|NULL\b)\s*(?:(AND)\b|$)", re.I)


def where(df: DataFrame, clause: str | None) -> DataFrame:
    """Filter by ``col op literal AND ...``; each term becomes a column predicate that can reach the source.

    A comparison with NULL is IS NULL whatever its operator.
    """
    if not clause or not clause.strip():
        return df
    at, more = 0, True
    while more:
        m = _TERM.match(clause, at)
        if not m or m[1] not in df.columns:
            raise ValueError(f"bad predicate at {clause[at:]!r}")
        c, op, lit = F.col(m[1]), m[2].upper(), m[3]
        if lit.upper() == "NULL":
            p = c.isNull()
        else:
            v = lit[1:-1].replace("''", "'") if lit[0] == "'" else float(lit) if "." in lit else int(lit)
            p = {"=": c == v, "!=": c != v, "<>": c != v, "<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}[op] if op != "LIKE" else c.like(str(v))
        df, at, more = df.where(p), m.end(), bool(m[4])
    if clause[at:].strip():
        raise ValueError(f"bad predicate at {clause[at:]!r}")
    return df


_NAME = re.compile(r"[A-Za-z_][\w.]*")


def read_table(table: DataFrame, source: str, target: str, clause: str | None = None, most: int | None = None) -> DataFrame:
    """Pairs of a table, from jdbc or the catalog, refused beyond ``most`` rows, if given (SRC-17)."""
    for n in (source, target):
        if not _NAME.fullmatch(n):
            raise ValueError(f"bad identifier {n!r}")
    out = where(table, clause).select(F.col(source).cast("string").alias("source"), F.col(target).cast("string").alias("target"))
    if most is not None and out.limit(most + 1).count() > most:
        raise ValueError(f"over {most} rows")
    return _pairs(out.withColumn("pos", F.monotonically_increasing_id()))


def read_jdbc(spark: SparkSession, url: str, table: str, source: str, target: str, clause: str | None = None, **options: str) -> DataFrame:
    return read_table(spark.read.format("jdbc").options(url=url, dbtable=table, **options).load(), source, target, clause)


_REF = re.compile(r"[A-Za-z0-9_./][A-Za-z0-9_./-]*")


def read_git(spark: SparkSession, checkout: str, ref: str = "HEAD", path: str = "GLOSSARY.md") -> DataFrame:
    """Pairs of one file of a local git repository at a revision (SRC-19); the file is text of bounded size."""
    import subprocess

    if not checkout.strip() or not _REF.fullmatch(ref):
        raise ValueError("bad git repository or revision")
    if path.startswith("/") or ".." in path.split("/"):
        raise ValueError("a path in a repository is relative and stays inside it")
    done = subprocess.run(["git", "-C", checkout, "show", f"{ref}:{path}"], capture_output=True, timeout=30)
    if done.returncode:
        raise ValueError("the file could not be read from git")
    text = spark.createDataFrame([(path, bytearray(done.stdout))], "doc string, data binary").select("doc", decode(F.col("data"))["text"].alias("text"))
    lines = text.select("doc", F.posexplode(F.split("text", "\r?\n")).alias("pos", "line"))
    out = _pairs(parse_text(lines))
    if not out.limit(1).count():
        raise ValueError("the file has no valid pairs")
    return out


READERS: dict[str, Callable[..., DataFrame]] = {
    "csv": lambda s, p, **k: read_delimited(s, p, ",", **k), "tsv": lambda s, p, **k: read_delimited(s, p, "\t", **k), "delimited": read_delimited,
    "json": read_json_pairs, "tbx": read_tbx, "tmx": read_tmx, "xliff": read_xliff, "text": read_text, "git": read_git,
}


def read(spark: SparkSession, format: str, path: str, max_entries: int | None = None, **options) -> DataFrame:  # noqa: A002
    """Dispatch by format; more than ``max_entries`` entries, if given, are an error (SRC-27)."""
    if max_entries is not None and not 1 <= max_entries <= MAX_ENTRIES:
        raise ValueError("max_entries is 1 to 1,000,000")
    if format not in READERS:
        raise ValueError(f"unknown format {format!r}")
    out = READERS[format](spark, path, **options)
    if max_entries is not None and out.limit(max_entries + 1).count() > max_entries:
        raise ValueError(f"over {max_entries} entries")
    return out.withColumn("format", F.lit(format))


def read_library(spark: SparkSession, path: str) -> DataFrame:
    """Stored glossaries as JSON; malformed records are passed over, missing settings get defaults (SRC-22, SRC-31)."""
    kind = "id string, name string, enabled boolean, priority int, `group` string, entries array<struct<source:string,target:string,case_sensitive:boolean,notes:string>>"
    df = spark.read.schema(kind).json(path, mode="DROPMALFORMED").where("id is not null and name is not null")
    return df.select("id", "name", F.coalesce("enabled", F.lit(True)).alias("enabled"), F.coalesce("priority", F.lit(0)).alias("priority"), F.coalesce("group", F.lit("default")).alias("grp"), "entries")


def write_library(glossaries: DataFrame, path: str) -> None:
    """The whole library anew; the committer makes it one step (SNK-12)."""
    glossaries.write.mode("overwrite").json(path)


def migrate(spark: SparkSession, library: str, store: str, dry_run: bool = False) -> dict[str, int]:
    """Legacy library to entries in Parquet, ids kept (SET-08); refuses a store that already has rows."""
    lib = read_library(spark, library)
    e = lib.select(F.col("id").alias("glossary_id"), "name", "enabled", "priority", "grp", F.posexplode("entries").alias("pos", "e")).select("glossary_id", "name", "enabled", "priority", "grp", "pos", "e.*")
    report = {"glossaries": lib.count(), "entries": e.count()}
    if not dry_run:
        e.write.mode("errorifexists").parquet(store)
        if spark.read.parquet(store).count() != report["entries"]:
            raise ValueError("the store differs from the library")
    return report


def read_tei(spark: SparkSession, path: str) -> DataFrame:
    """Lexicon entries: first orthography as root, all text as definition (SRC-28)."""
    kind = "_id string, `_xml:id` string, form array<struct<orth:array<string>>>, orth array<string>, def array<string>, sense array<string>"
    e = spark.read.format("xml").options(rowTag="entryFree", ignoreSurroundingSpaces=True).schema(kind).load(path).withColumn("pos", F.monotonically_increasing_id())
    orth = F.coalesce(F.get("orth", F.lit(0)), F.get(F.get("form", F.lit(0))["orth"], F.lit(0)))
    text = squeeze(F.concat_ws(" ", orth, F.array_join("def", " "), F.array_join("sense", " ")))
    id_ = F.coalesce(F.col("_id"), F.col("`_xml:id`"), F.concat(F.lit("entry_"), F.sha2(text, 256).substr(1, 12)))
    return e.select("pos", id_.alias("id"), orth.alias("root"), text.alias("definition"))
