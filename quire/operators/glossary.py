"""Glossaries, entries and lexicon terms.

entries: glossary_id, pos, source, target, case_sensitive; glossaries: id, name, enabled, priority, grp.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.text import squeeze
from quire.operators import metric
from quire.session import materialise, rank, rank_within


def clean_entries(entries: DataFrame) -> DataFrame:
    """Trimmed pairs, those without source or target dropped (STR-37)."""
    e = entries.withColumn("source", squeeze(F.col("source"))).withColumn("target", squeeze(F.col("target")))
    return e.where((F.col("source") != "") & (F.col("target") != ""))


def merge(entries: DataFrame, by: list[str] | None = None, rank: list[Column] | None = None) -> DataFrame:
    """One entry per lower-case source: the last by ``rank``, in the place of the first (AGG-13).

    Ordered aggregates, so hot terms are combined before the shuffle.
    """
    at = F.struct(*(rank or [F.col("pos")]))
    return (
        entries.withColumn("term", F.lower("source")).groupBy(*(by or []), "term")
        .agg(F.max_by(F.struct("source", "target"), at).alias("e"), F.min(at).alias("first"))
        .select(*(by or []), "term", "e.source", "e.target", F.col("first").getField("pos").alias("pos"))
    )


def merged_enabled(entries: DataFrame, glossaries: DataFrame) -> DataFrame:
    """Entries of enabled glossaries, the highest priority wins a term (AGG-14)."""
    on = glossaries.where("enabled").select(F.col("id").alias("glossary_id"), "priority")
    e = entries.join(on, "glossary_id").withColumn("term", F.lower("source"))
    best = F.struct(F.col("priority"), F.col("glossary_id"), F.col("pos"))
    return e.groupBy("term").agg(F.max_by(F.struct("source", "target", "glossary_id"), best).alias("e")).select("term", "e.*")


def conflicts(entries: DataFrame, by: str = "target") -> DataFrame:
    """Terms with at least two distinct values, in order of first sight (AGG-15, JN-16).

    Equal values meet first; only the distinct ones of a term with a conflict are listed, which is what a preview shows.
    """
    first = entries.withColumn("term", F.lower("source")).groupBy("term", by).agg(F.min("pos").alias("pos"))
    some = first.groupBy("term").agg(F.count("*").alias("n")).where("n >= 2").select("term")
    return first.join(some, "term").groupBy("term").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", by))), lambda r: r[by]).alias("values"))


def glossary_list(entries: DataFrame, glossaries: DataFrame) -> DataFrame:
    """Glossaries with their number of entries; order: priority down, group, name, id (AGG-10, SRT-01)."""
    n = entries.groupBy(F.col("glossary_id").alias("id")).agg(F.count("*").alias("entry_count"))
    out = glossaries.join(n, "id", "left").withColumn("entry_count", F.coalesce("entry_count", F.lit(0)))
    return rank(out, [F.desc("priority"), F.lower("grp"), F.lower("name"), F.col("id")], "position")


def duplicates(entries: DataFrame, by: str = "glossary_id") -> DataFrame:
    """Entries beyond the first of each lower-case source (AGG-12)."""
    n = entries.groupBy(by, F.lower("source").alias("term")).agg(F.count("*").alias("n"))
    return n.groupBy(by).agg(F.sum(F.col("n") - 1).alias("duplicate_count"), F.sum("n").alias("entry_count"))


def health(terms: DataFrame) -> DataFrame:
    """Number of rows and of distinct glossaries (AGG-11)."""
    return terms.agg(F.count("*").alias("rows"), F.count_distinct("glossary_id").alias("glossaries"))


def reorder(glossaries: DataFrame, ids: list[str], strict: bool = True) -> DataFrame:
    """Priorities total - index for listed ids; the rest keep their order below them (SRT-08), or stay (SRT-09)."""
    if strict:
        known = {r[0] for r in glossaries.where(F.col("id").isin(ids)).select("id").collect()} if ids else set()
        if len(set(ids)) != len(ids) or known != set(ids):
            raise ValueError("repeated or unknown glossary id")
    at = F.array_position(F.array(*[F.lit(i) for i in ids]).cast("array<string>"), F.col("id").cast("string")) if ids else F.lit(0)
    listed = at > 0
    if not strict:
        return glossaries.withColumn("priority", F.when(listed, len(ids) - at + 1).otherwise(F.col("priority")).cast("int"))
    n = glossaries.count()
    ranked = rank(glossaries, [(~listed).cast("int"), F.when(listed, at), F.desc("priority"), F.lower("grp"), F.lower("name"), F.col("id")], "_k")
    return ranked.withColumn("priority", (n - F.col("_k")).cast("int")).drop("_k")


class LexiconStore(Protocol):
    """What a lexicon store offers (UDF-06); ``ParquetLexicon`` is one."""

    def list_glossaries(self) -> DataFrame: ...
    def get_glossary(self, glossary_id: str) -> DataFrame: ...
    def save_glossary(self, entries: DataFrame, glossary_id: str, name: str, group: str = "default", priority: int = 0) -> None: ...
    def toggle_glossary(self, glossary_id: str, enabled: bool) -> None: ...
    def reorder_glossaries(self, ids: list[str]) -> None: ...
    def delete_glossary(self, glossary_id: str) -> bool: ...
    def exact_lookup(self, queries: DataFrame) -> DataFrame: ...
    def hybrid_query(self, queries: DataFrame, k: int = 3) -> DataFrame: ...
    def list_entries(self, glossary_id: str) -> DataFrame: ...
    def health(self) -> DataFrame: ...


class Conflict(Exception):
    """Another writer was first."""


class ParquetLexicon:
    """A lexicon in Parquet: entries in folders that are written once, and versions of the small table of glossaries.

    A version is a folder and a file of its number that names it; who creates that file first has made the version,
    atomically, and any other writer then tries again on top of it. Stores on one path see each other's changes, and a reader
    keeps to one version. Entries belong to the save that wrote them, so those of a deleted glossary never come back
    under its id; what a lost writer left behind is never named.
    """

    META = "id string, name string, enabled boolean, priority int, grp string, save string"
    TRIES = 10

    def __init__(self, spark: SparkSession, path: str, embed: Column | None = None) -> None:
        self.spark, self.path, self.embed = spark, path.rstrip("/"), embed

    # the log of versions: a file each

    def _hadoop(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    @property
    def version(self) -> int:
        """The number of the last version, 0 before the first."""
        files, p = self._hadoop(f"{self.path}/log")
        return max((int(f.getPath().getName()) for f in files.listStatus(p)), default=0) if files.exists(p) else 0

    def _meta(self, version: int | None = None) -> DataFrame:
        version = self.version if version is None else version
        if not version:
            return self.spark.createDataFrame([], self.META)
        for _ in range(self.TRIES):
            files, p = self._hadoop(f"{self.path}/log/{version}")
            stream = files.open(p)
            try:
                name = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            if name.endswith("\n"):  # whole: its writer may only just have made it
                return self.spark.read.schema(self.META).parquet(f"{self.path}/meta/{name.strip()}")
            time.sleep(0.5)
        raise OSError(f"version {version} of {self.path} is broken")

    def _change(self, change: Callable[[DataFrame], DataFrame]) -> None:
        """The next version: ``change`` of the last one, made again if another writer was first."""
        for _ in range(self.TRIES):
            version = self.version
            name = uuid.uuid4().hex
            change(self._meta(version)).coalesce(1).write.parquet(f"{self.path}/meta/{name}")
            files, p = self._hadoop(f"{self.path}/log/{version + 1}")
            try:
                stream = files.create(p, False)
            except Exception as e:
                if "AlreadyExists" not in str(e):
                    raise
                continue
            stream.write(bytearray(f"{name}\n".encode()))
            stream.close()
            return
        raise Conflict(f"{self.path} was changed by others {self.TRIES} times in a row")

    def _entries(self) -> DataFrame:
        meta = self._meta().select(F.col("id").alias("glossary_id"), "save")
        files, p = self._hadoop(f"{self.path}/entries")
        if not files.exists(p):
            return self.spark.createDataFrame([], "glossary_id string, pos long, source string, target string, case_sensitive boolean")
        return self.spark.read.parquet(f"{self.path}/entries").join(meta, ["glossary_id", "save"], "left_semi").drop("save")

    def list_glossaries(self) -> DataFrame:
        return glossary_list(self._entries(), self._meta().drop("save"))

    def get_glossary(self, glossary_id: str) -> DataFrame:
        return self._meta().where(F.col("id") == glossary_id).drop("save")

    def save_glossary(self, entries: DataFrame, glossary_id: str, name: str, group: str = "default", priority: int = 0) -> None:
        name = name.strip()
        self.save_glossaries(entries.withColumn("glossary_id", F.lit(glossary_id)), self.spark.createDataFrame([(glossary_id, name, priority, group)], "id string, name string, priority int, grp string"))

    def save_glossaries(self, entries: DataFrame, glossaries: DataFrame) -> None:
        """Any number of new glossaries (id, name, priority, grp) with their entries (glossary_id and so on), in one write."""
        if glossaries.where(~F.length(F.trim("name")).between(1, 200) | F.col("name").isNull()).count():
            raise ValueError("a glossary's name has 1 to 200 characters")
        save_ = uuid.uuid4().hex
        named = entries.join(glossaries.select(F.col("id").alias("glossary_id"), F.trim("name").alias("glossary_name")), "glossary_id")
        out = clean_entries(named)
        out = out if self.embed is None else out.withColumn("vector", self.embed)
        out.write.parquet(f"{self.path}/entries/save={save_}")
        new = glossaries.select("id", F.trim("name").alias("name"), F.lit(True).alias("enabled"), F.col("priority").cast("int"), "grp", F.lit(save_).alias("save"))

        def add(meta: DataFrame) -> DataFrame:
            both = meta.unionByName(new)
            twice = both.groupBy("id").count().where("count > 1").first()
            if twice:
                raise ValueError(f"glossary {twice[0]!r} exists")
            return both

        self._change(add)

    def toggle_glossary(self, glossary_id: str, enabled: bool) -> None:
        self._change(lambda meta: toggle(meta, glossary_id, enabled))

    def reorder_glossaries(self, ids: list[str]) -> None:
        self._change(lambda meta: reorder(meta, ids, strict=False).select(*meta.columns))

    def delete_glossary(self, glossary_id: str) -> bool:
        """Whether there was one; its entries stay on disk and are no longer seen."""
        found = bool(self.get_glossary(glossary_id).count())
        if found:
            self._change(lambda meta: meta.where(F.col("id") != glossary_id))
        return found

    def exact_lookup(self, queries: DataFrame) -> DataFrame:
        return exact_lookup(self._entries(), queries)

    def hybrid_query(self, queries: DataFrame, k: int = 3) -> DataFrame:
        return nearest(self._entries(), queries, k)

    def list_entries(self, glossary_id: str) -> DataFrame:
        return list_entries(self._entries(), glossary_id)

    def health(self) -> DataFrame:
        return health(self._entries())


def list_entries(entries: DataFrame, glossary_id: str) -> DataFrame:
    """Entries of one glossary in their order (JN-18)."""
    return entries.where(F.col("glossary_id") == glossary_id).orderBy("pos")


def toggle(glossaries: DataFrame, glossary_id: str, enabled: bool, now: Column | None = None) -> DataFrame:
    hit = F.col("id") == glossary_id
    out = glossaries.withColumn("enabled", F.when(hit, enabled).otherwise(F.col("enabled")))
    return out.withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at"))) if now is not None else out


def delete(entries: DataFrame, glossary_id: str) -> DataFrame:
    return entries.where(F.col("glossary_id") != glossary_id)


def save(entries: DataFrame, path: str, name: str, embed: Column | None = None, **meta: object) -> DataFrame:
    """Append a named glossary's clean entries with its settings to a Parquet table (SET-05)."""
    name = name.strip()
    if not name or len(name) > 200:
        raise ValueError("a glossary's name has 1 to 200 characters")
    out = clean_entries(entries).withColumn("glossary_name", F.lit(name))
    for k, v in meta.items():
        out = out.withColumn(k, F.lit(v))
    if embed is not None:
        out = out.withColumn("vector", embed)
    out.write.mode("append").parquet(path)
    return out


def prompt_block(entries: DataFrame, by: list[str]) -> DataFrame:
    """Lines ``- source -> target``, longest source first (STR-19)."""
    row = F.struct((-F.length("source")).alias("k"), F.col("pos").alias("pos"), F.concat(F.lit("- "), "source", F.lit(" -> "), "target").alias("line"))
    lines = F.transform(F.sort_array(F.collect_list(row)), lambda r: r["line"])
    head = F.lit("GLOSSARY (use these exact translations for the listed terms):\n")
    some = entries.where((squeeze(F.col("source")) != "") & (squeeze(F.col("target")) != ""))
    return some.groupBy(*by).agg(F.concat(head, F.array_join(lines, "\n")).alias("block"))


def exact_lookup(terms: DataFrame, queries: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """Terms equal to a query after trim and lower-casing; blank queries find nothing (JN-12)."""
    q = queries.withColumn("_key", F.lower(squeeze(F.col(text)))).where("_key <> ''")
    return q.join(terms.withColumn("_key", F.lower(squeeze(F.col(source)))), "_key").drop("_key")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-12)


def nearest(terms: DataFrame, queries: DataFrame, k: int = 3, least: float | None = None, vector: str = "vector", max_queries: int = 10_000) -> DataFrame:
    """Exact cosine top k of each query over terms that pass its filters (JN-13, JN-14), by an index over chords.

    ``queries``: query_id, qvec, and lang to filter by where not null; they go out in blocks of about ``max_queries``.
    """
    return metric.search(metric.build(terms, vector), queries, k, max_queries, least)


def suffix_ids(rows: DataFrame, id_: str = "id", pos: str = "pos") -> DataFrame:
    """Repeated ids get _1, _2, in order of arrival (SET-10). An id may hold any share of the rows: it is ranked range by range."""
    k = F.col("_k")
    ranked = rank_within(rows, id_, [F.col(pos)], "_k")
    return ranked.withColumn("unique_id", F.concat(F.col(id_), F.when(k > 0, F.concat(F.lit("_"), k.cast("string"))).otherwise(""))).drop("_k")
