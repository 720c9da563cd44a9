"""Pages data, document trees, overlays, evaluation and the trust plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import classify, trust
from quire.functions.geometry import Box
from quire.functions.text import is_blank, strip
from quire.operators.blocks import PAGE
from quire.operators.overlap import pairs
from quire.session import rank


def from_pages_data(pages: DataFrame) -> DataFrame:
    """Blocks of (doc_id, page_index, items: array<struct<x0,y0,x1,y1,text>>), reading order by position (PRJ-14)."""
    b = pages.select(*PAGE, F.posexplode("items").alias("block_index", "i"))
    return b.select(*PAGE, F.col("block_index").cast("long").alias("block_index"), "i.*", F.col("block_index").cast("long").alias("reading_order"))


def to_pages_data(blocks: DataFrame) -> DataFrame:
    """Items per page, by reading order where every block of the page has one, else as they lie (PRJ-15)."""
    all_ordered = F.count_if(F.col("reading_order").isNull()).over(Window.partitionBy(*PAGE)) == 0
    at = F.when(all_ordered, F.col("reading_order")).otherwise(F.col("block_index"))
    item = F.struct(at.alias("at"), "block_index", "x0", "y0", "x1", "y1", "text")
    b = blocks.withColumn("_item", item)
    rows = F.sort_array(F.collect_list("_item"))
    return b.groupBy(*PAGE).agg(F.transform(rows, lambda r: F.struct(r["x0"].alias("x0"), r["y0"].alias("y0"), r["x1"].alias("x1"), r["y1"].alias("y1"), r["text"].alias("text"))).alias("items"))


def page_lines(blocks: DataFrame) -> DataFrame:
    """The non-blank texts of each page in order (AGG-22)."""
    rows = F.filter(F.sort_array(F.collect_list(F.struct("block_index", "text"))), lambda r: ~is_blank(r["text"]))
    return blocks.groupBy(*PAGE).agg(F.transform(rows, lambda r: r["text"]).alias("lines"))


# Node types that labels and kinds stand for.
NODE_TYPES = {"heading": "section_header", "section_header": "section_header", "title": "section_header", "list_item": "list_item", "key_value": "key_value", "table": "table", "figure": "figure", "image": "figure", "caption": "caption", "equation": "equation", "code": "code", "header": "page_header", "footer": "page_footer", "page_number": "page_number"}


def node_type(label: Column, kind: Column) -> Column:
    """Type of a node: label over kind, unknown ones are paragraphs (PRJ-17)."""
    name, out = F.lower(F.coalesce(label, kind)), F.lit("paragraph")
    for k, v in NODE_TYPES.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def tree_nodes(blocks: DataFrame, label: Column | None = None) -> DataFrame:
    """Adjacency rows of a document tree with a stable id for each node (PRJ-16, PRJ-17)."""
    kind = F.col("kind") if "kind" in blocks.columns else classify.simple_type(F.col("text"))
    t = node_type(label if label is not None else F.lit(None).cast("string"), kind)
    id_ = F.substring(F.sha2(F.concat_ws("/", *[F.col(c) for c in (*PAGE, "block_index")]), 256), 1, 16)
    rows = blocks.where(~is_blank(F.col("text")) | (t == "figure"))
    return rows.withColumn("node_type", t).withColumn("block_id", id_).withColumn("level", F.when(t == "section_header", 1).otherwise(0)).withColumn("text", strip(F.coalesce("text", F.lit(""))))


def leaf_texts(nodes: DataFrame) -> DataFrame:
    """Nodes with text of their own, tables left out, in order (PRJ-18)."""
    return nodes.where((F.col("node_type") != "table") & ~is_blank(F.col("text"))).orderBy("doc_id", "page_index", "block_index")


def overlay(blocks: DataFrame, extra: DataFrame) -> DataFrame:
    """Columns of ``extra`` laid over blocks of the same place; missing ones stay null (JN-15)."""
    return blocks.join(extra, [*PAGE, "block_index"], "left")


def evaluation(blocks: DataFrame) -> DataFrame:
    """Per document: blocks, invalid boxes, share of blocks with a reading order, candidates of tables (AGG-06)."""
    return blocks.groupBy("doc_id").agg(
        F.count("*").alias("block_count"), F.count_if(~F.coalesce(Box.of().valid(), F.lit(False))).alias("invalid_bbox_count"),
        F.avg(F.when(F.col("reading_order").isNotNull(), 1.0).otherwise(0.0)).alias("reading_order_coverage"),
    )


def recall_report(matches: DataFrame) -> DataFrame:
    """Recall over all truth blocks, mean IoU over the matched (AGG-07). ``matches``: match_index, iou."""
    hit = F.col("match_index").isNotNull()
    n = F.count_if(hit)
    return matches.agg(
        F.count("*").alias("gt_blocks"), n.alias("matched"), (n / F.greatest(F.lit(1), F.count("*"))).alias("block_recall"),
        F.coalesce(F.avg(F.when(hit, F.col("iou"))), F.lit(0.0)).alias("average_iou"),
    )


def arbitrate(first: Column, first_conf: Column, second: Column, second_conf: Column) -> Column:
    """The second reader wins only with strictly higher confidence (JN-19)."""
    return F.when(second_conf > first_conf, second).otherwise(first)


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lower-case alphabetic words of a list, marks left out of account (STR-32)."""
    w = F.lower(strip(F.col("value")))
    return spark.read.text(path).select(w.alias("word")).where(r"word rlike '^[\\p{L}\\p{M}]+$'").distinct()


def normal_page_text(pages: DataFrame) -> DataFrame:
    """Page texts keyed by non-negative numbers; anything else raises (STR-45). ``pages``: key string, lines."""
    good = F.col("key").rlike(r"^\d+$") & F.col("lines").isNotNull()
    bad = F.raise_error(F.lit("page text keys are numbers from 0")).cast("long")
    return pages.select(F.when(good, F.col("key").cast("long")).otherwise(bad).alias("page_index"), "lines")


def hash_split(rows: DataFrame, key: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """The first ``share`` of the rows, to a whole row, in an order of hashes that any run and layout repeats (MATH-08)."""
    placed = rank(rows.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed))), ["_h", key], "_place")
    return placed.withColumn("is_train", F.col("_place") < int(rows.count() * share)).drop("_h", "_place")


# Statuses and wordings of errors that may pass, wordings of those that never do, kinds that are mistakes.
RETRY_STATUS = [408, 425, 429, 500, 502, 503, 504]
TRANSIENT = [
    "rate limit", "rate_limit", "too many requests", "overloaded", "server overloaded", "connection reset", "connection refused", "connection aborted", "connection error",
    "connecterror", "remote end closed connection", "eof occurred", "broken pipe", "temporarily unavailable", "service unavailable", "bad gateway", "gateway timeout",
    "internal server error", "readtimeout", "connecttimeout", "network failure", "econnreset", "econnrefused", "timeout", "timed out",
]
PERMANENT = ["context size", "context_length_exceeded", "context length", "maximum context", "invalid api key", "unauthorized", "authentication", "permission denied", "model not found", "does not exist", "invalid request"]
MISTAKES = ["KeyError", "TypeError", "AttributeError", "NameError", "IndexError", "ValueError", "AssertionError"]


def is_transient(kind: Column, status: Column, message: Column) -> Column:
    """Whether a failed call is worth another try (MISC-08): kind, then status, then wording; unknown ones are, but for RuntimeError."""
    low = F.lower(F.coalesce(message, F.lit("")))
    says = lambda terms: F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(low, t))
    return (
        F.when(F.coalesce(kind.isin(MISTAKES), F.lit(False)), False).when(status.isin(RETRY_STATUS), True).when(status.between(400, 499), False)
        .when(says(PERMANENT), False).when(says(TRANSIENT), True).otherwise(F.coalesce(kind != "RuntimeError", F.lit(True)))
    )


def workflow(settings: dict[str, bool]) -> list[str]:
    """Ordered stages that settings turn on (MISC-10)."""
    order = [("scan", True), ("preprocess", settings.get("preprocess", False)), ("detect", not settings.get("grounded", False)), ("recognise", True), ("align", not settings.get("grounded", False)), ("repair", settings.get("repair", False)), ("cross_page", settings.get("cross_page", False)), ("spellcheck", settings.get("spellcheck", False)), ("processors", settings.get("processors", True)), ("trust", settings.get("trust", False)), ("sink", True)]
    return [name for name, on in order if on]


def prepared(pages: DataFrame, image: str, steps: list[tuple[str, Callable[[Column], Column]]]) -> DataFrame:
    """Preprocessors one after another on the image column, the names of those that ran joined in ``done`` (UDF-12)."""
    out = pages
    for _, step in steps:
        out = out.withColumn(image, step(F.col(image)))
    return out.withColumn("done", F.lit(",".join(name for name, _ in steps)))


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, object]:
    """The frame and an observation filled while it runs (MISC-11, UDF-09)."""
    from pyspark.sql import Observation

    o = Observation(name)
    return df.observe(o, *[c.alias(k) for k, c in metrics.items()]), o


def score_trust(blocks: DataFrame, watermarks: DataFrame | None = None, script: Column | None = None, calibration: tuple[float, float] | None = None, pixels: int = 500_000, hallucination: bool = True) -> DataFrame:
    """Trust layer of a page composed from the parts that are on; nothing where all are off (MISC-07, MATH-06, UDF-08).

    ``watermarks``: boxes of pages. ``script``: struct(script, confidence) of a block; the page's is its most
    frequent, and a block differs only where its own confidence is at least one half.
    """
    if watermarks is None and script is None and calibration is None and not hallucination:
        return blocks
    t = F.col("text")
    out = blocks
    if watermarks is not None:
        hit = pairs(blocks, watermarks).select(*[F.col(f"a.{c}").alias(c) for c in (*PAGE, "block_index")]).distinct().withColumn("_mark", F.lit(True))
        out = out.join(hit, [*PAGE, "block_index"], "left")
    else:
        out = out.withColumn("_mark", F.lit(False))
    if script is not None:
        out = out.withColumn("_script", script)
        out = out.withColumn("_page", F.mode("_script.script", deterministic=True).over(Window.partitionBy(*PAGE)))
        odd = F.coalesce((F.col("_script.confidence") >= 0.5) & (F.col("_script.script") != F.col("_page")), F.lit(False))
    else:
        odd = F.lit(False)
    level = trust.risk_level(t, trust.gave_up(t), trust.repeats(t), ~trust.plausible_length(t, Box.of().area, F.lit(pixels))) if hallucination else F.lit(0)
    conf = trust.calibrate(F.coalesce("confidence", F.lit(0.0)), *(calibration or (None, None)))
    out = out.withColumn("_odd", odd).withColumn("_level", level).withColumn("_conf", conf)
    args = (F.col("_conf"), F.col("_level"), F.coalesce("_mark", F.lit(False)), F.col("_odd"))
    return out.withColumn("trust_score", trust.trust_score(*args)).withColumn("trust_flags", trust.trust_flags(*args)).select(*blocks.columns, "trust_score", "trust_flags")
