"""Views over the standard tables that the document operators run on, in both dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import blocks as B
from quire.operators import jobs as J
from quire.session import rank, spread, table


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    return B.blocks_view(spread(table(spark, sf, "documents")))


def structured(spark: SparkSession, sf: str) -> DataFrame:
    return B.with_structure(blocks(spark, sf))


def log(spark: SparkSession, sf: str) -> DataFrame:
    return J.log_view(table(spark, sf, "events"))


def paired(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with one test item: those take turns in order of id, so each takes part whatever its id is."""
    items = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("item"))
    n = max(1, items.count())
    items = rank(items, ["item_id", "item"], "_turn")
    turn = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(n))
    return spread(table(spark, sf, "documents")).select("doc_id", "text", turn.alias("_turn")).join(items, "_turn").drop("_turn")


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of odd documents, moved to the documents before them."""
    b = blocks(spark, sf).where("doc_id % 2 = 1")
    return b.withColumn("doc_id", F.col("doc_id") - 1)


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    return blocks(spark, sf).where("doc_id % 2 = 0")


def entries(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(F.col("p_type").alias("glossary_id"), F.col("p_partkey").cast("long").alias("pos"), F.col("p_name").alias("source"), F.col("p_brand").alias("target"), F.lit(False).alias("case_sensitive"))


def glossaries(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    g = p.groupBy(F.col("p_type").alias("id")).agg(F.min("p_size").cast("int").alias("priority"), (F.sum("p_size") % 2 == 0).alias("enabled"))
    return g.withColumn("name", F.col("id")).withColumn("grp", F.substring("id", 1, 3))


def terms(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("term_id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("lang"))


STRIP = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
SQUEEZE = r"trim(regexp_replace({0}, '[\s\p{{Z}}]+', ' ', 'g'))"


def strip(c: str) -> str:
    return STRIP.format(c)


def squeeze(c: str) -> str:
    return SQUEEZE.format(c)


def words(c: str) -> str:
    return f"CASE WHEN {squeeze(c)} = '' THEN [] ELSE string_split({squeeze(c)}, ' ') END"


AREA = "(greatest(0.0::DOUBLE, x1 - x0) * greatest(0.0::DOUBLE, y1 - y0))"
REGION = "CASE WHEN y1 <= 0.16::DOUBLE THEN 'header' WHEN y0 >= 0.84::DOUBLE THEN 'footer' ELSE 'body' END"
LIST_ITEM = r"^\s*(?:[-*•◦–—]|\(?\d+[).]|\(?[A-Za-z][).])\s+"
KEY_VALUE = r"^\s*([^:\n]{1,50}):\s*(\S.+)$"

BLOCKS = """
l AS (SELECT doc_id, lang, source, n_chars, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
d AS (SELECT doc_id, n // 8 AS page_index, n % 8 AS block_index,
    CASE WHEN n%8=0 AND doc_id%2=0 AND lang='en' THEN upper(rtrim(substr(t,1,40),'.,;: '))
         WHEN n%8=1 AND doc_id%3=0 THEN 'Source: ' || source || ' ' || lang
         WHEN n%8=2 AND doc_id%4=0 THEN '- ' || t
         WHEN n%8=3 AND doc_id%7=0 THEN ''
         WHEN n%8=4 AND doc_id%6=0 THEN 'Figure ' || (n//8+1)::VARCHAR
         WHEN n%8=5 AND doc_id%5=0 THEN lang || ' | ' || source || ' | ' || n_chars::VARCHAR
         WHEN n%8=7 AND doc_id%2=1 THEN 'Page ' || (n//8+1)::VARCHAR
         ELSE t END AS text FROM l),
g AS (SELECT *, 0.05::DOUBLE + 0.5::DOUBLE*(block_index%2) + 0.001::DOUBLE*(length(text)%5) AS x0,
            0.02::DOUBLE + 0.28::DOUBLE*(block_index//2) + 0.004::DOUBLE*(length(text)%7) AS y0,
            CASE WHEN length(text)=0 THEN 0.44::DOUBLE ELSE least(0.4::DOUBLE, 0.05::DOUBLE + 0.004::DOUBLE*length(text)) END AS w,
            CASE WHEN length(text)=0 THEN 0.2::DOUBLE ELSE 0.1::DOUBLE + 0.02::DOUBLE*(length(text)%5) END AS h FROM d),
blocks AS (SELECT doc_id, page_index, block_index, x0, y0, x0+w AS x1, least(1.0::DOUBLE, y0+h) AS y1, text FROM g)"""


def prominent(chars: int, most: int) -> str:
    return rf"""NOT contains(t, chr(10)) AND length(t) <= {chars} AND len(ws) <= {most} AND NOT regexp_matches(t, '[.,;:]$') AND nl > 0
      AND (nu / nl >= 0.65::DOUBLE OR len(list_filter(ws, lambda x: regexp_matches(x, '^\p{{Lu}}'))) >= greatest(1, len(ws) // 2))"""


STRUCTURED = rf"""{BLOCKS},
s0 AS (SELECT *, {strip('text')} AS t, {words('text')} AS ws, len(regexp_extract_all(text, '\p{{L}}')) AS nl, len(regexp_extract_all(text, '\p{{Lu}}')) AS nu,
   len(list_filter(regexp_split_to_array({strip('text')}, '\t+|\|+|\s{{2,}}'), lambda x: {strip('x')} <> '')) AS nc FROM blocks),
structured AS (SELECT *, CASE WHEN t = '' THEN 'empty' WHEN regexp_matches(t, '{LIST_ITEM}') THEN 'list_item'
   WHEN regexp_extract(t, '{KEY_VALUE}', 1) <> '' AND len({words("regexp_extract(t, '" + KEY_VALUE + "', 1)")}) <= 6 THEN 'key_value'
   WHEN nc >= 3 THEN 'table_candidate' WHEN {prominent(90, 12)} THEN 'heading' ELSE 'paragraph' END AS kind FROM s0)"""

LAID_OUT = rf"""{STRUCTURED},
q0 AS (SELECT *, {squeeze('text')} AS sq, {REGION} AS region0, {AREA} AS area FROM structured),
laid AS (SELECT *, CASE WHEN region0 = 'header' AND sq <> '' AND length(sq) <= 120 THEN 'header'
   WHEN region0 = 'footer' AND (regexp_matches(sq, '^\p{{Nd}}+$') OR starts_with(lower(sq), 'page ') OR starts_with(lower(sq), 'p. ')) THEN 'page_number'
   WHEN region0 = 'footer' AND sq <> '' AND length(sq) <= 140 THEN 'footer'
   WHEN regexp_matches(lower(sq), '^(?:figure |fig\. |table |caption:)') THEN 'caption'
   WHEN kind = 'heading' AND y0 < 0.28::DOUBLE THEN 'title_block' WHEN sq = '' AND area >= 0.08::DOUBLE THEN 'figure' ELSE 'body' END AS role FROM q0)"""

PAGES = rf"""{BLOCKS},
pages_ AS (SELECT doc_id, page_index, coalesce(string_agg(text, chr(10) ORDER BY block_index) FILTER ({strip('text')} <> ''), '') AS page_text FROM blocks GROUP BY doc_id, page_index)"""

LOG = """log AS (SELECT event_id AS seq, user_id AS job_id, ts, CASE event_type WHEN 'view' THEN 'ocr.job.submitted' WHEN 'click' THEN 'ocr.job.started' WHEN 'purchase' THEN 'ocr.job.completed' WHEN 'error' THEN 'ocr.job.completed' WHEN 'signup' THEN 'artifact.created' END AS kind,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'complete' END AS status, value AS duration_s, CASE WHEN event_type = 'error' THEN json_extract(props, '$.k')::BIGINT END AS failed_page, json_extract(props, '$.k')::BIGINT AS k FROM events)"""

BOXES = f"""{BLOCKS},
a AS (SELECT * REPLACE (doc_id - 1 AS doc_id) FROM blocks WHERE doc_id % 2 = 1), b AS (SELECT * FROM blocks WHERE doc_id % 2 = 0),
o AS (SELECT a.doc_id, a.page_index, a.block_index, b.block_index AS other, greatest(0.0::DOUBLE, a.x1 - a.x0) * greatest(0.0::DOUBLE, a.y1 - a.y0) AS aa, greatest(0.0::DOUBLE, b.x1 - b.x0) * greatest(0.0::DOUBLE, b.y1 - b.y0) AS ba,
  (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS inter
  FROM a JOIN b USING (doc_id, page_index) WHERE a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)"""

ENTRIES = """entries AS (SELECT p_type AS glossary_id, p_partkey::BIGINT AS pos, p_name AS source, p_brand AS target FROM part),
glossaries AS (SELECT p_type AS id, min(p_size) AS priority, sum(p_size) % 2 = 0 AS enabled, p_type AS name, substr(p_type, 1, 3) AS grp FROM part GROUP BY p_type)"""
