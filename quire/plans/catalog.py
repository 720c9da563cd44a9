"""Catalogue of queries over the standard tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import classify, geometry, text, trust
from quire.operators import blocks as B
from quire.operators import glossary as G
from quire.operators import jobs as J
from quire.operators import overlap as O
from quire.operators import pages as P
from quire.operators import paged, translate
from quire.plans import views as V
from quire.plans import oracles
from quire.session import spread, table
from quire.sources import documents as D
from quire.sources import exports as X
from quire.sources import glossaries as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
KEY = ["doc_id", "page_index", "block_index"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- pages and blocks


@query(f"WITH {V.BLOCKS} SELECT * FROM blocks")
def blocks_view(spark, sf):
    return V.blocks(spark, sf)


@query(f"WITH {V.PAGES} SELECT * FROM pages_")
def page_text(spark, sf):
    return B.page_text(V.blocks(spark, sf))


@query(f"WITH {V.PAGES} SELECT doc_id, coalesce(string_agg(page_text, chr(10) || chr(10) ORDER BY page_index) FILTER (page_text <> ''), '') AS document_text FROM pages_ GROUP BY doc_id")
def document_text(spark, sf):
    return B.document_text(B.page_text(V.blocks(spark, sf)))


@query(f"WITH {V.BLOCKS} SELECT doc_id, page_index, block_index, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY round_even(y0 / 0.02::DOUBLE, 0), x0, y0, block_index) - 1 AS reading_order FROM blocks")
def reading_order(spark, sf):
    return B.reading_order(V.blocks(spark, sf)).select(*KEY, "reading_order")


@query(f"WITH {V.STRUCTURED} SELECT doc_id, page_index, block_index, kind FROM structured")
def structure_classify(spark, sf):
    return V.structured(spark, sf).select(*KEY, "kind")


@query(f"""WITH {V.STRUCTURED} SELECT doc_id, page_index, count(*) FILTER (kind = 'heading') AS headings, count(*) FILTER (kind = 'paragraph') AS paragraphs,
  bool_or(kind = 'key_value') AS has_key_values, bool_or(kind = 'table_candidate') AS has_tables FROM structured GROUP BY doc_id, page_index""")
def structure_page_summary(spark, sf):
    out = B.structure_summary(V.blocks(spark, sf))
    n = lambda k: F.coalesce(F.col("block_kinds")[k], F.lit(0))
    return out.select("doc_id", "page_index", n("heading").alias("headings"), n("paragraph").alias("paragraphs"), "has_key_values", "has_tables")


_QUALITY = f"""WITH {V.BLOCKS}, p AS (SELECT doc_id, page_index, count(*) AS n, sum(length({V.strip('text')}))::BIGINT AS c, count(*) FILTER ({V.strip('text')} = '' AND {V.AREA} >= 0.05::DOUBLE) AS holes FROM blocks GROUP BY doc_id, page_index),
f AS (SELECT *, c = 0 AS empty, n >= 20 AND c / n < 2 AS sparse FROM p)"""


@query(f"{_QUALITY} SELECT doc_id, page_index, n AS block_count, c AS text_char_count, (empty::INT + sparse::INT + holes)::BIGINT AS finding_count FROM f")
def quality_findings(spark, sf):
    q = B.quality(V.blocks(spark, sf))
    return q.select("doc_id", "page_index", "block_count", "text_char_count", F.size("findings").cast("long").alias("finding_count"))


@query(f"""{_QUALITY}, r AS (SELECT 'retry_empty_page' AS action, empty::INT AS k FROM f UNION ALL SELECT 'switch_dense_mode', sparse::INT FROM f UNION ALL SELECT 'retry_block_or_grounded', holes FROM f)
  SELECT action, sum(k)::BIGINT AS decisions FROM r GROUP BY action HAVING sum(k) > 0""")
def routing_decisions(spark, sf):
    """Documents to blocks, reading order, quality findings, routing: one exchange on the page."""
    pages = B.routing(B.quality(B.with_structure(B.reading_order(V.blocks(spark, sf)))))
    return pages.select(F.explode("decisions").alias("d")).groupBy(F.col("d.action").alias("action")).agg(F.count("*").alias("decisions"))


_HEAD = rf"(kind = 'heading' OR (kind = 'paragraph' AND t <> '' AND {V.prominent(120, 14)} AND NOT regexp_matches(t, '{V.LIST_ITEM}') AND NOT regexp_matches(t, '{V.KEY_VALUE}') AND nc < 3))"
_SECTIONS = f"""WITH {V.STRUCTURED}, h AS (SELECT *, coalesce({_HEAD}, false) AS h FROM structured),
n AS (SELECT *, sum(h::INT) OVER w - 1 AS k, last_value(CASE WHEN h THEN {V.squeeze('text')} END IGNORE NULLS) OVER w AS title FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY page_index, block_index ROWS UNBOUNDED PRECEDING)),
sec AS (SELECT doc_id, page_index, block_index, CASE WHEN k >= 0 THEN k::BIGINT END AS section_index, title AS section_title, CASE WHEN h THEN 'heading' WHEN k < 0 THEN 'unsectioned' ELSE 'body' END AS section_role FROM n)"""


@query(f"{_SECTIONS} SELECT * FROM sec")
def section_assign(spark, sf):
    return B.sections(V.structured(spark, sf)).select(*KEY, "section_index", "section_title", "section_role")


@query(f"{_SECTIONS} SELECT doc_id, page_index, count(*) FILTER (section_role = 'heading') AS section_count, arg_max(section_title, block_index) FILTER (section_title IS NOT NULL) AS active_section FROM sec GROUP BY doc_id, page_index")
def section_page_summary(spark, sf):
    return B.section_summary(B.sections(V.structured(spark, sf)))


@query(f"""WITH {V.LAID_OUT} SELECT doc_id, page_index, block_index, role, CASE WHEN role = 'body' AND x1 - x0 < 0.32::DOUBLE THEN region0 || '_side' ELSE region0 END AS region,
  CASE role WHEN 'header' THEN 0.72 WHEN 'page_number' THEN 0.82 WHEN 'footer' THEN 0.7 WHEN 'caption' THEN 0.82 WHEN 'title_block' THEN 0.76 WHEN 'figure' THEN 0.58 ELSE 0.5 END::DOUBLE AS confidence FROM laid""")
def layout_roles(spark, sf):
    b = B.with_layout(V.structured(spark, sf)).withColumn("l", classify.layout(F.col("role"), geometry.Box.of()))
    return b.select(*KEY, "role", "l.region", "l.confidence")


@query(f"""WITH {V.LAID_OUT} SELECT doc_id, page_index, count(*) FILTER (role = 'body') AS body, bool_or(role = 'figure') AS has_figures, bool_or(role = 'caption') AS has_captions,
  bool_or(role = 'header') AS has_headers, bool_or(role = 'footer') AS has_footers FROM laid GROUP BY doc_id, page_index""")
def layout_page_summary(spark, sf):
    out = B.layout_summary(B.with_layout(V.structured(spark, sf)))
    return out.select("doc_id", "page_index", F.coalesce(F.col("roles")["body"], F.lit(0)).alias("body"), "has_figures", "has_captions", "has_headers", "has_footers")


@query(f"WITH {V.BLOCKS}, q AS (SELECT *, {V.squeeze('text')} AS sq FROM blocks) SELECT doc_id, page_index, block_index FROM q WHERE sq <> '' AND (contains(sq, '|') OR (length(sq) <= 24 AND x1 - x0 < 0.35::DOUBLE AND {V.AREA} < 0.08::DOUBLE))")
def table_candidates(spark, sf):
    return B.table_candidates(V.blocks(spark, sf)).select(*KEY)


@query()
def table_grid(spark, sf):
    return paged.table_cells(V.blocks(spark, sf))


@query(f"WITH {V.BLOCKS} SELECT doc_id, page_index, count(*) AS box_count FROM blocks GROUP BY doc_id, page_index HAVING count(*) > 6")
def dense_pages(spark, sf):
    return B.dense_pages(V.blocks(spark, sf), threshold=6)


@query(f"WITH {V.BLOCKS} SELECT doc_id, page_index, block_index, CASE WHEN length({V.strip('text')}) <= 80 AND len(regexp_extract_all(text, '\\p{{L}}')) > 0 AND len(regexp_extract_all(text, '\\p{{Lu}}')) / len(regexp_extract_all(text, '\\p{{L}}')) >= 0.65::DOUBLE THEN 'section_header' ELSE 'paragraph' END AS block_type FROM blocks WHERE {V.strip('text')} <> ''")
def tree_nodes(spark, sf):
    b = V.blocks(spark, sf).where(~text.is_blank(F.col("text")))
    return b.select(*KEY, classify.simple_type(F.col("text")).alias("block_type"))


@query(rf"""WITH {V.BLOCKS}, k AS (SELECT *, lower({V.squeeze('text')}) AS key, block_index % 3 = 0 AS ref FROM blocks)
SELECT a.doc_id, a.page_index, a.block_index, a.ref AND a.key <> '' AND EXISTS (SELECT 1 FROM k b WHERE a.doc_id = b.doc_id AND a.page_index = b.page_index AND NOT b.ref AND b.key <> '' AND abs(a.block_index - b.block_index) <= 4 AND contains(b.key, a.key)) AS dropped FROM k a""")
def dedup_band_join(spark, sf):
    return B.dedup_refined(V.blocks(spark, sf), F.col("block_index") % 3 == 0).select(*KEY, "dropped")


# --- overlap joins


@query(f"WITH {V.BOXES}, hit AS (SELECT DISTINCT doc_id, page_index, block_index FROM o WHERE inter / greatest(1e-9, aa) >= 0.5 OR inter / (aa + ba - inter) >= 0.3) SELECT doc_id, page_index, block_index FROM a ANTI JOIN hit USING (doc_id, page_index, block_index)")
def box_overlap_antijoin(spark, sf):
    return O.drop_explained(V.candidates(spark, sf), V.boxes(spark, sf)).select(*KEY)


@query(f"WITH {V.BOXES}, hit AS (SELECT doc_id, page_index, block_index FROM o WHERE inter / greatest(1e-9, aa) >= 0.15 GROUP BY ALL HAVING count(*) >= 2) SELECT doc_id, page_index, block_index FROM a ANTI JOIN hit USING (doc_id, page_index, block_index)")
def box_straddle_antijoin(spark, sf):
    return O.drop_straddling(V.candidates(spark, sf), V.boxes(spark, sf)).select(*KEY)


@query(f"WITH {V.BOXES} SELECT DISTINCT doc_id, page_index, block_index FROM o")
def region_semijoin(spark, sf):
    return O.touched(V.candidates(spark, sf), V.boxes(spark, sf)).select(*KEY)


@query(f"WITH {V.BOXES} SELECT doc_id, page_index, block_index, other, inter / (aa + ba - inter) AS iou FROM o")
def box_iou_pairs(spark, sf):
    p = O.pairs(V.candidates(spark, sf), V.boxes(spark, sf))
    return p.select("a.doc_id", "a.page_index", "a.block_index", F.col("b.block_index").alias("other"), geometry.iou(geometry.Box.of("a"), geometry.Box.of("b")).alias("iou"))


@query(f"WITH {V.BOXES} SELECT doc_id, page_index, block_index, other, inter AS overlap FROM o")
def box_grid_pairs(spark, sf):
    p = O.pairs(V.candidates(spark, sf), V.boxes(spark, sf), grid=4)
    area = geometry.overlap(geometry.Box.of("a"), geometry.Box.of("b"))
    return p.select("a.doc_id", "a.page_index", "a.block_index", F.col("b.block_index").alias("other"), area.alias("overlap"))


@query(f"""WITH {V.BOXES}, hit AS (SELECT DISTINCT doc_id, page_index, block_index FROM o WHERE inter / greatest(1e-9, aa) >= 0.5 OR inter / (aa + ba - inter) >= 0.3),
x AS (SELECT * FROM a ANTI JOIN hit USING (doc_id, page_index, block_index) QUALIFY row_number() OVER (PARTITION BY doc_id, page_index ORDER BY block_index) <= 3),
u AS (SELECT doc_id, page_index, x0, y0, text FROM b UNION ALL SELECT doc_id, page_index, x0, y0, text FROM x)
SELECT *, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY y0, x0, text) - 1 AS position FROM u""")
def union_boxes_topk(spark, sf):
    """Detected boxes and at most three new ones a page, sorted again (SET-02, SET-03)."""
    from pyspark.sql.window import Window

    cols = ["doc_id", "page_index", "x0", "y0", "text"]
    w = Window.partitionBy("doc_id", "page_index")
    fresh = O.drop_explained(V.candidates(spark, sf), V.boxes(spark, sf)).withColumn("k", F.row_number().over(w.orderBy("block_index"))).where("k <= 3")
    both = V.boxes(spark, sf).select(*cols).unionByName(fresh.select(*cols))
    return both.withColumn("position", F.row_number().over(w.orderBy("y0", "x0", "text")) - 1)


@query()
def greedy_iou_match(spark, sf):
    return paged.greedy_match(V.candidates(spark, sf), V.boxes(spark, sf))


@query()
def align_lines(spark, sf):
    texts = B.page_text(V.candidates(spark, sf)).withColumnRenamed("page_text", "llm_text")
    return paged.align(V.boxes(spark, sf), texts)


@query()
def column_major_order(spark, sf):
    return paged.column_order(V.blocks(spark, sf))


@query()
def cross_page_merge(spark, sf):
    return paged.cross_page_merge(V.blocks(spark, sf)).select(*KEY, "text")


@query()
def grid_coverage(spark, sf):
    return O.grid_coverage(V.candidates(spark, sf), V.boxes(spark, sf))


# --- trust


_CONF = rf"""CASE WHEN t = '' THEN 0.0 WHEN nl = 0 THEN CASE WHEN regexp_matches(t, '^[\d\s.,:/\-+$€£%()#№]+$') THEN 0.99 ELSE 0.3 END
  WHEN len(ws) >= 3 THEN CASE WHEN nl / length(t) >= 0.6::DOUBLE THEN 0.99 ELSE 0.85 END WHEN nl >= 3 THEN 0.7 ELSE 0.4 END::DOUBLE"""


@query(f"WITH {V.STRUCTURED} SELECT doc_id, page_index, block_index, {_CONF} AS confidence FROM structured")
def confidence_estimate(spark, sf):
    return V.blocks(spark, sf).select(*KEY, classify.estimate_confidence(F.col("text")).alias("confidence"))


@query(rf"""WITH {V.STRUCTURED} SELECT doc_id, page_index, block_index, CASE WHEN text = '' THEN 0.0 WHEN NOT regexp_matches(t, '[aeiouyAEIOUY\x{{4e00}}-\x{{9fff}}\x{{0600}}-\x{{06ff}}]') THEN 0.2 WHEN len(ws) >= 3 THEN 0.85 ELSE 0.7 END::DOUBLE AS confidence FROM structured""")
def recogniser_confidence(spark, sf):
    return V.blocks(spark, sf).select(*KEY, classify.recogniser_confidence(F.col("text")).alias("confidence"))


_GAVE_UP = " OR ".join(f"contains(lower(text), '{m}')" for m in trust.GIVE_UP)
_SHORT_AREA = f"length({V.strip('text')}) >= greatest(1.0::DOUBLE, {V.AREA} * 500000) * 0.0001::DOUBLE"


@query(f"WITH {V.BLOCKS} SELECT doc_id, page_index, block_index, {_GAVE_UP} AS gave_up FROM blocks")
def giveup_flag(spark, sf):
    return V.blocks(spark, sf).select(*KEY, trust.gave_up(F.col("text")).alias("gave_up"))


@query(f"""WITH {V.BLOCKS}, c AS (SELECT doc_id, page_index, block_index, substr(text, i, 6) AS s FROM blocks, LATERAL unnest(range(1, length(text) - 4)) AS t(i) WHERE length(text) >= 18),
r AS (SELECT DISTINCT doc_id, page_index, block_index FROM (SELECT doc_id, page_index, block_index, s FROM c GROUP BY ALL HAVING count(*) >= 3))
SELECT b.doc_id, b.page_index, b.block_index, r.doc_id IS NOT NULL AS repeats FROM blocks b LEFT JOIN r USING (doc_id, page_index, block_index)""")
def repetition_flag(spark, sf):
    return V.blocks(spark, sf).select(*KEY, trust.repeats(F.col("text")).alias("repeats"))


@query(f"WITH {V.BLOCKS} SELECT doc_id, page_index, block_index, {_SHORT_AREA} AS plausible FROM blocks")
def length_plausible(spark, sf):
    ok = trust.plausible_length(F.col("text"), geometry.Box.of().area, F.lit(500000))
    return V.blocks(spark, sf).select(*KEY, ok.alias("plausible"))


_LEVEL = f"CASE WHEN {V.strip('text')} = '' THEN 0 ELSE least(3, 2 * (({_GAVE_UP})::INT + (NOT ({_SHORT_AREA}))::INT)) END"


@query()
def hallucination_level(spark, sf):
    b = V.blocks(spark, sf)
    level = trust.risk_level(F.col("text"), trust.gave_up(F.col("text")), trust.repeats(F.col("text")), ~trust.plausible_length(F.col("text"), geometry.Box.of().area, F.lit(500000)))
    return b.select(*KEY, level.alias("level"))


_CAL = "1 / (1 + exp(-(1.5::DOUBLE * raw + 0.1::DOUBLE)))"


@query(f"WITH c AS (SELECT l.doc_id, least(1.0::DOUBLE, n_chars / 2000.0::DOUBLE) AS raw FROM labels l JOIN documents d USING (doc_id)) SELECT doc_id, {_CAL} AS calibrated FROM c")
def calibrate_scores(spark, sf):
    c = _calibration(spark, sf)
    return c.select("doc_id", trust.calibrate(F.col("raw"), 1.5, 0.1).alias("calibrated"))


def _calibration(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    return table(spark, sf, "labels").join(d, "doc_id").select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / 2000.0).alias("raw"), F.col("quality").cast("double").alias("target"))


@query(f"""WITH c AS (SELECT least(1.0::DOUBLE, n_chars / 2000.0::DOUBLE) AS raw, quality::DOUBLE AS target FROM labels l JOIN documents d USING (doc_id)),
p AS (SELECT {_CAL} AS p, target FROM c), b AS (SELECT least(9, floor(p * 10)) AS bin, count(*) AS n, avg(p) AS mp, avg(target) AS mt FROM p GROUP BY 1)
SELECT sum(n * abs(mp - mt)) / sum(n) AS ece FROM b""")
def ece(spark, sf):
    """Expected calibration error in ten bins (AGG-09)."""
    p = _calibration(spark, sf).select(trust.calibrate(F.col("raw"), 1.5, 0.1).alias("p"), "target")
    b = p.groupBy(F.least(F.lit(9), F.floor(F.col("p") * 10)).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mp"), F.avg("target").alias("mt"))
    return b.agg(F.coalesce(F.sum(F.col("n") * F.abs(F.col("mp") - F.col("mt"))) / F.sum("n"), F.lit(0.0)).alias("ece"))


_TRUST = f"""WITH {V.STRUCTURED}, c AS (SELECT *, {_CONF} AS conf, {_LEVEL} AS level, block_index = 3 AS mark, block_index = 5 AS odd FROM structured),
s AS (SELECT *, conf * (1.0 - 0.5 * CASE level WHEN 2 THEN 0.5 WHEN 3 THEN 1.0 ELSE 0.0 END) * CASE WHEN mark THEN 0.7 ELSE 1.0 END * CASE WHEN odd THEN 0.8 ELSE 1.0 END AS trust_score,
  (level > 0)::INT + mark::INT + odd::INT + (conf < 0.5)::INT AS flags FROM c)"""


def _trusted(spark, sf):
    b = V.blocks(spark, sf)
    t = F.col("text")
    level = trust.risk_level(t, trust.gave_up(t), ~trust.plausible_length(t, geometry.Box.of().area, F.lit(500000)))
    b = b.withColumn("conf", classify.estimate_confidence(t)).withColumn("level", level)
    args = (F.col("conf"), F.col("level"), F.col("block_index") == 3, F.col("block_index") == 5)
    return b.withColumn("trust_score", trust.trust_score(*args)).withColumn("trust_flags", trust.trust_flags(*args))


@query(f"{_TRUST} SELECT doc_id, page_index, block_index, trust_score::DOUBLE AS trust_score, flags::BIGINT AS flags FROM s")
def trust_score(spark, sf):
    return _trusted(spark, sf).select(*KEY, "trust_score", F.coalesce(F.size("trust_flags"), F.lit(0)).cast("long").alias("flags"))


@query(f"""{_TRUST} SELECT count(*) AS block_count, count(*) AS scored_blocks, count(*) FILTER (flags > 0) AS flagged_blocks, round(avg(trust_score), 6)::DOUBLE AS average_trust,
  count(*) FILTER (trust_score < 0.2) AS bin_0, count(*) FILTER (trust_score >= 0.2 AND trust_score < 0.4) AS bin_1, count(*) FILTER (trust_score >= 0.4 AND trust_score < 0.6) AS bin_2,
  count(*) FILTER (trust_score >= 0.6 AND trust_score < 0.8) AS bin_3, count(*) FILTER (trust_score >= 0.8) AS bin_4 FROM (SELECT * REPLACE (trust_score::DOUBLE AS trust_score) FROM s)""")
def trust_summary(spark, sf):
    return B.trust_summary(_trusted(spark, sf))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
SELECT doc_id, line, pos FROM l QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) <= 2""")
def runaway_filter(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return B.runaway_filter(lines, 2).select("doc_id", "line", "pos")


# DuckDB's distance counts bytes, so accented letters become control characters there, one byte each
_LETTERS = "ÀÄÇÈÉÊÍÑÓÖÚÜßàáâäçèéêíîñóöúüù"
_BYTES = " || ".join(f"chr({c})" for c in [*range(1, 9), 11, 12, *range(14, 32), 127][: len(_LETTERS)])
_DISTANCE = f"""WITH i AS (SELECT item_id, substr(text, 1, 1024) AS y, row_number() OVER (ORDER BY item_id, text) - 1 AS turn FROM benchmark),
p AS (SELECT doc_id, item_id, translate(substr(d.text, 1, 1024), '{_LETTERS}', {_BYTES}) AS x, translate(y, '{_LETTERS}', {_BYTES}) AS y FROM documents d JOIN i ON turn = coalesce(doc_id, 0) % (SELECT greatest(1, count(*)) FROM benchmark))
SELECT doc_id, item_id, CASE WHEN x = '' AND y = '' THEN 0.0 WHEN x = '' OR y = '' THEN 1.0 ELSE levenshtein(x, y) / greatest(length(x), length(y)) END::DOUBLE AS distance FROM p"""


@query(_DISTANCE)
def norm_levenshtein(spark, sf):
    """Distance of every document to one test item, in characters, all items in turn."""
    p = V.paired(spark, sf)
    return p.select("doc_id", "item_id", trust.normalised_distance(F.col("text"), F.col("item")).alias("distance"))


@query(_DISTANCE)
def norm_levenshtein_all(spark, sf):
    """An older name of norm_levenshtein."""
    return norm_levenshtein(spark, sf)


@query()
def script_detect(spark, sf):
    d = spread(table(spark, sf, "documents"))
    return d.select("doc_id", paged.script(F.col("text")).alias("s")).select("doc_id", "s.*")


@query()
def similarity(spark, sf):
    """Whole documents with one test item each, all items in turn."""
    p = V.paired(spark, sf)
    return p.select("doc_id", "item_id", paged.similarity(F.col("text"), F.col("item")).alias("ratio"))


# --- glossaries and lexicon


@query(f"WITH {V.ENTRIES} SELECT glossary_id, lower(source) AS term, arg_max(target, pos) AS target, min(pos) AS pos FROM entries GROUP BY 1, 2")
def glossary_merge(spark, sf):
    return G.merge(V.entries(spark, sf), by=["glossary_id"]).select("glossary_id", "term", "target", "pos")


@query(f"WITH {V.ENTRIES}, e AS (SELECT *, lower(source) AS term, row_number() OVER (PARTITION BY lower(source) ORDER BY priority DESC, glossary_id DESC, pos DESC) AS k FROM entries JOIN glossaries g ON g.id = glossary_id WHERE enabled) SELECT term, source, target, glossary_id FROM e WHERE k = 1")
def glossary_merged_enabled(spark, sf):
    return G.merged_enabled(V.entries(spark, sf), V.glossaries(spark, sf))


@query(f"WITH {V.ENTRIES}, f AS (SELECT lower(source) AS term, target, min(pos) AS pos FROM entries GROUP BY 1, 2) SELECT term, string_agg(target, '|' ORDER BY pos) AS targets FROM f GROUP BY term HAVING count(*) >= 2")
def glossary_conflicts(spark, sf):
    return G.conflicts(V.entries(spark, sf)).select("term", F.array_join("values", "|").alias("targets"))


@query(f"WITH {V.ENTRIES} SELECT *, row_number() OVER (ORDER BY priority DESC, lower(grp), lower(name), id) - 1 AS position FROM (SELECT g.id, name, grp, priority, count(*) AS entry_count FROM glossaries g JOIN entries e ON e.glossary_id = g.id GROUP BY ALL)")
def glossary_list(spark, sf):
    return G.glossary_list(V.entries(spark, sf), V.glossaries(spark, sf)).select("id", "name", "grp", "priority", "entry_count", "position")


@query(f"WITH {V.ENTRIES}, n AS (SELECT glossary_id, lower(source) AS term, count(*) AS n FROM entries GROUP BY 1, 2) SELECT glossary_id, sum(n - 1)::BIGINT AS duplicate_count, sum(n)::BIGINT AS entry_count FROM n GROUP BY 1")
def glossary_duplicates(spark, sf):
    return G.duplicates(V.entries(spark, sf))


@query(f"""WITH {V.ENTRIES}, o AS (SELECT *, CASE id WHEN 'STANDARD' THEN 1 WHEN 'ECONOMY' THEN 2 END AS place FROM glossaries),
r AS (SELECT *, row_number() OVER (ORDER BY (place IS NULL)::INT, place, o.priority DESC, lower(grp), lower(name), id) - 1 AS k FROM o) SELECT id, ((SELECT count(*) FROM r) - k)::INT AS priority FROM r""")
def glossary_reorder(spark, sf):
    return G.reorder(V.glossaries(spark, sf), ["STANDARD", "ECONOMY"]).select("id", "priority")


@query(f"WITH {V.ENTRIES}, q AS (SELECT n_nationkey AS query_id, '  ' || upper((SELECT min(source) FROM entries WHERE pos % 25 = n_nationkey)) || ' ' AS text FROM nation) SELECT query_id, source, target FROM q JOIN entries e ON lower(trim(e.source)) = lower(trim(q.text))")
def lexicon_exact(spark, sf):
    e = V.entries(spark, sf)
    first = e.groupBy((F.col("pos") % 25).alias("k")).agg(F.min("source").alias("s"))
    q = table(spark, sf, "nation").join(first, F.col("n_nationkey") == F.col("k")).select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("  "), F.upper("s"), F.lit(" ")).alias("text"))
    return G.exact_lookup(e, q).select("query_id", "source", "target")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS qvec, label AS qlang FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id AS term_id, list_inner_product(qvec::DOUBLE[], embedding::DOUBLE[]) / (sqrt(list_inner_product(qvec::DOUBLE[], qvec::DOUBLE[])) * sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-12) AS score FROM q JOIN embeddings ON label = qlang)
SELECT query_id, term_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, term_id) AS rank FROM s) WHERE rank <= 3""")
def lexicon_knn(spark, sf):
    """Top three terms of the stated query set within its own label."""
    t = V.terms(spark, sf)
    q = t.where("term_id % 50 = 0").select(F.col("term_id").alias("query_id"), F.col("vector").alias("qvec"), "lang")
    return G.nearest(t, q).select("query_id", "term_id", "rank")


@query(f"WITH {V.ENTRIES} SELECT count(*) AS rows, count(DISTINCT glossary_id) AS glossaries FROM entries")
def lexicon_health(spark, sf):
    return G.health(V.entries(spark, sf))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 100000.5 AND o_orderpriority LIKE '1%'")
def where_minilang(spark, sf):
    return S.where(table(spark, sf, "orders"), "o_orderstatus = 'O' AND o_totalprice >= 100000.5 AND o_orderpriority LIKE '1%'").select("o_orderkey", "o_totalprice")


@query(f"WITH {V.ENTRIES}, k AS (SELECT pos, target, row_number() OVER (PARTITION BY target ORDER BY pos) - 1 AS k FROM entries) SELECT pos, target || CASE WHEN k > 0 THEN '_' || k ELSE '' END AS unique_id FROM k")
def unique_ids(spark, sf):
    return G.suffix_ids(V.entries(spark, sf), "target", "pos").select("pos", "unique_id")


# --- translation


@query()
def chunk_documents(spark, sf):
    return paged.chunk_documents(table(spark, sf, "documents"), 1000)


@query(rf"""WITH w AS (SELECT conv_id, turn, text AS translated, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS source FROM conversations), s AS (SELECT *, turn % 4 AS attempts, CASE WHEN turn % 3 = 0 THEN 'x' ELSE '' END AS context FROM w WHERE source IS NOT NULL)
SELECT conv_id, turn, CASE WHEN attempts >= 3 THEN 'attempts' WHEN len(regexp_extract_all(source, '\p{{L}}')) = 0 OR length({V.strip('source')}) < 5 THEN 'trivial'
  WHEN length(translated) < length(source) * 0.1::DOUBLE THEN 'short' WHEN length(translated) > length(source) * 2.5::DOUBLE THEN 'long' WHEN context = '' THEN 'no_terms' ELSE 'model' END AS reason FROM s""")
def translation_gate(spark, sf):
    from pyspark.sql.window import Window

    c = table(spark, sf, "conversations").withColumn("source", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("source is not null")
    g = translate.gate(F.col("source"), F.col("text"), F.col("turn") % 4, F.when(F.col("turn") % 3 == 0, "x").otherwise(""))
    return c.select("conv_id", "turn", g["reason"].alias("reason"))


@query("""WITH w AS (SELECT conv_id, turn, text, lag(text) OVER v AS a, lead(text) OVER v AS b FROM conversations WINDOW v AS (PARTITION BY conv_id ORDER BY turn)), s AS (SELECT *, greatest(1, length(text)) AS n FROM w WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT conv_id, turn, CASE WHEN abs(length(b) - n) / n < abs(length(a) - n) / n THEN b ELSE a END AS chosen FROM s""")
def dual_pick(spark, sf):
    from pyspark.sql.window import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").withColumn("a", F.lag("text").over(w)).withColumn("b", F.lead("text").over(w)).where("a is not null and b is not null")
    return c.select("conv_id", "turn", translate.pick(F.col("text"), F.col("a"), F.col("b")).alias("chosen"))


@query(f"""WITH w AS (SELECT conv_id, turn, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS p FROM conversations), s AS (SELECT *, {V.words('p')} AS ws FROM w)
SELECT conv_id, turn, coalesce(array_to_string(ws[greatest(1, len(ws) - 79) : len(ws)], ' '), '') AS context FROM s""")
def context_window(spark, sf):
    return translate.context_window(table(spark, sf, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "context")


@query()
def entities(spark, sf):
    return table(spark, sf, "documents").select("doc_id", translate.entities(F.col("text")).alias("e")).select("doc_id", "e.*")


@query(f"""WITH n AS (SELECT *, CASE role WHEN 'system' THEN 'page_header' ELSE 'paragraph' END AS block_type FROM conversations)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS chunk_index FROM n WHERE block_type <> 'page_header' AND {V.strip('text')} <> ''""")
def visit_order(spark, sf):
    n = table(spark, sf, "conversations").withColumn("block_type", F.when(F.col("role") == "system", "page_header").otherwise("paragraph"))
    return translate.visit_order(n, "conv_id", ("turn",)).select("conv_id", "turn", "chunk_index")


# --- jobs


@query(f"""WITH {V.LOG}, j AS (SELECT *, CASE WHEN kind = 'ocr.job.submitted' THEN 'pending' WHEN kind = 'ocr.job.started' THEN 'processing' WHEN status = 'error' THEN 'error' ELSE 'complete' END AS st FROM log WHERE starts_with(kind, 'ocr.job.'))
SELECT job_id, arg_max(st, seq) AS status, min(seq) AS position, arg_max(failed_page, seq) FILTER (kind = 'ocr.job.completed' AND failed_page IS NOT NULL) AS failed_page FROM j GROUP BY job_id""")
def job_history(spark, sf):
    return J.job_history(V.log(spark, sf)).select("job_id", "status", "position", "failed_page")


@query(f"WITH {V.LOG} SELECT k, arg_max(job_id, seq) AS job_id, max(seq) AS seq, min(seq) AS first_seq FROM log WHERE kind = 'artifact.created' GROUP BY k")
def artifact_latest(spark, sf):
    return J.latest(V.log(spark, sf), "k").select("k", "job_id", "seq", "first_seq")


@query(f"WITH {V.LOG} SELECT seq, job_id, kind FROM log WHERE kind IN ('ocr.job.started', 'ocr.job.completed') AND ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00'")
def log_filter(spark, sf):
    t = lambda s: F.lit(s).cast("timestamp")
    return J.log_filter(V.log(spark, sf), ["ocr.job.started", "ocr.job.completed"], since=t("2024-01-10 00:00:00"), until=t("2024-01-20 00:00:00")).select("seq", "job_id", "kind")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate + INTERVAL 30 DAY > TIMESTAMP '1995-06-01 00:00:00'")
def ttl_expire(spark, sf):
    o = table(spark, sf, "orders").withColumn("expires_at", F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"))
    return J.expire(o, F.lit("1995-06-01 00:00:00").cast("timestamp")).select("o_orderkey")


@query("SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 2")
def cap_evict(spark, sf):
    return J.keep_newest(table(spark, sf, "orders"), 2, "o_orderdate", "o_orderkey", by=["o_custkey"]).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1000")
def newest_jobs(spark, sf):
    return J.newest_first(table(spark, sf, "orders"), "o_orderdate", "o_orderkey", 1000).select("o_orderkey")


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) AS in_window FROM events""")
def rate_window(spark, sf):
    return J.hot_rate_window(table(spark, sf, "events"), "user_id", "ts", 10).select("event_id", "in_window")


@query(f"""WITH {V.BLOCKS}, p AS (SELECT DISTINCT doc_id, page_index + 1 AS p FROM blocks WHERE length(text) % 3 > 0 OR page_index % 2 = 0), i AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS g FROM p),
r AS (SELECT doc_id, min(p) AS a, max(p) AS b FROM i GROUP BY doc_id, g) SELECT doc_id, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) AS page_range FROM r GROUP BY doc_id""")
def page_runs(spark, sf):
    return J.page_runs(V.blocks(spark, sf).where("length(text) % 3 > 0 or page_index % 2 = 0"))


@query(f"""WITH {V.BLOCKS}, p AS (SELECT doc_id, page_index, sum(length(text)) AS chars FROM blocks GROUP BY ALL), c AS (SELECT doc_id, page_index // 2 AS chunk, count(*) AS pages, sum(chars)::BIGINT AS chars FROM p GROUP BY ALL)
SELECT *, sum(chars) OVER w::BIGINT AS total_chars, floor(sum(pages) OVER w * 100 / sum(pages) OVER (PARTITION BY doc_id))::BIGINT AS percent FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY chunk ROWS UNBOUNDED PRECEDING)""".replace("OVER w::BIGINT", "OVER w"))
def chunk_progress(spark, sf):
    p = V.blocks(spark, sf).groupBy("doc_id", "page_index").agg(F.sum(F.length("text")).alias("chars"))
    return J.chunk_progress(p, 2)


# --- exports


@query(f"WITH {V.PAGES} SELECT doc_id, string_agg(page_text, chr(10) || chr(10) ORDER BY page_index) AS body FROM pages_ GROUP BY doc_id")
def export_text(spark, sf):
    return X.export(B.page_text(V.blocks(spark, sf)), "text")


@query(f"WITH {V.PAGES} SELECT doc_id, {V.strip('''string_agg('## Page ' || (page_index + 1) || chr(10) || chr(10) || page_text, chr(10) || chr(10) ORDER BY page_index)''')} || chr(10) AS body FROM pages_ GROUP BY doc_id")
def export_markdown(spark, sf):
    return X.export(B.page_text(V.blocks(spark, sf)), "markdown")


@query()
def export_json(spark, sf):
    return X.export(B.page_text(V.blocks(spark, sf)), "json")


@query()
def export_html(spark, sf):
    b = B.with_layout(V.structured(spark, sf))
    kind = F.when(F.col("role") == "header", "page_header").when(F.col("role") == "footer", "page_footer").when(F.col("role") == "page_number", "page_number").when(F.col("role") == "figure", "figure").when(F.col("kind") == "heading", "section_header").when(F.col("kind") == "list_item", "list_item").otherwise("paragraph")
    b = b.withColumn("node_type", kind)
    id_ = F.substring(F.sha2(F.concat_ws("/", *[F.col(c) for c in KEY]), 256), 1, 16)
    html = X.render_block(F.col("node_type"), F.col("text"), id_, [F.col(c) for c in ("x0", "y0", "x1", "y1")])
    b = b.withColumn("html", F.when(F.col("text").isNotNull(), html))  # a block without text has no box either
    return X.html(b)


@query()
def metadata_report(spark, sf):
    pages = B.routing(B.quality(V.blocks(spark, sf))).select("doc_id", "page_index", F.struct("block_count", "text_char_count", "findings").alias("quality"), F.struct("decision_count", "decisions").alias("routing"))
    return X.metadata_report(pages, ["quality", "routing"])


@query(f"WITH {V.BLOCKS} SELECT doc_id, page_index, block_index, 'paragraph' AS node_type, text, x0, y0, x1, y1 FROM blocks")
def tree_round_trip(spark, sf):
    nodes = V.blocks(spark, sf).withColumn("node_type", F.lit("paragraph"))
    return X.read_tree(X.tree_json(nodes)).select(*KEY, "node_type", "text", "x0", "y0", "x1", "y1")


@query("""WITH s AS (SELECT doc_id, (doc_id % 7 + 1) || '-' || (doc_id % 7 + 3) || ',' || (doc_id % 5 + 2) AS spec FROM documents) SELECT doc_id, list_sort(list_distinct(list_concat(range(doc_id % 7, least(10, doc_id % 7 + 3)), CASE WHEN doc_id % 5 + 1 < 10 THEN [doc_id % 5 + 1] ELSE [] END)))::VARCHAR AS pages FROM s""")
def page_selection(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    spec = F.concat((F.col("doc_id") % 7 + 1).cast("string"), F.lit("-"), (F.col("doc_id") % 7 + 3).cast("string"), F.lit(","), (F.col("doc_id") % 5 + 2).cast("string"))
    return d.select("doc_id", D.selected_pages(spec, F.lit(10)).cast("string").alias("pages"))


# --- trees, overlays, evaluation


@query(f"""WITH {V.BLOCKS} SELECT doc_id, count(*) AS block_count, count(*) FILTER (NOT (x0 >= 0 AND x0 < x1 AND x1 <= 1 AND y0 >= 0 AND y0 < y1 AND y1 <= 1)) AS invalid_bbox_count,
  avg(CASE WHEN block_index % 2 = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS reading_order_coverage FROM blocks GROUP BY doc_id""")
def evaluation(spark, sf):
    b = V.blocks(spark, sf).withColumn("reading_order", F.when(F.col("block_index") % 2 == 0, F.col("block_index")))
    return P.evaluation(b)


@query(f"WITH {V.BLOCKS} SELECT doc_id, page_index, string_agg(text, chr(10) ORDER BY CASE WHEN page_index % 2 = 0 THEN 7 - block_index ELSE block_index END) AS texts FROM blocks GROUP BY doc_id, page_index")
def pages_data(spark, sf):
    """Pages with a full reading order go by it, the others as they lie; every even page is read backwards."""
    order = F.when((F.col("page_index") % 2 == 0) | (F.col("block_index") % 2 == 0), 7 - F.col("block_index"))
    b = V.blocks(spark, sf).withColumn("reading_order", F.when((F.col("page_index") % 2 == 1) & (F.col("block_index") == 0), None).otherwise(F.coalesce(order, F.col("block_index"))))
    return P.to_pages_data(b).select("doc_id", "page_index", F.array_join(F.transform("items", lambda r: r["text"]), "\n").alias("texts"))


@query(f"WITH {V.BLOCKS} SELECT b.doc_id, b.page_index, b.block_index, p.page_size FROM blocks b LEFT JOIN (SELECT doc_id, page_index, 0 AS block_index, count(*) AS page_size FROM blocks GROUP BY ALL) p USING (doc_id, page_index, block_index)")
def overlay_join(spark, sf):
    b = V.blocks(spark, sf)
    extra = b.groupBy("doc_id", "page_index").agg(F.count("*").alias("page_size")).withColumn("block_index", F.lit(0).cast("long"))
    return P.overlay(b.select(*KEY), extra)


@query()
def recall_report(spark, sf):
    return P.recall_report(paged.greedy_match(V.candidates(spark, sf), V.boxes(spark, sf)))


@query()
def trust_layer(spark, sf):
    b = V.blocks(spark, sf).withColumn("confidence", classify.estimate_confidence(F.col("text")))
    return P.score_trust(b, watermarks=V.boxes(spark, sf).where("block_index = 3"), script=paged.script(F.col("text")), calibration=(1.5, 0.1)).select(*KEY, "trust_score", "trust_flags")


@query(f"WITH {V.BLOCKS}, pl AS (SELECT doc_id, page_index, list(text ORDER BY block_index) FILTER ({V.strip('text')} <> '') AS lines FROM blocks GROUP BY ALL) SELECT doc_id, page_index, coalesce(len(lines), 0)::BIGINT AS n, coalesce(array_to_string(lines, chr(10)), '') AS lines FROM pl")
def page_lines(spark, sf):
    out = P.page_lines(V.blocks(spark, sf))
    return out.select("doc_id", "page_index", F.size("lines").cast("long").alias("n"), F.array_join("lines", "\n").alias("lines"))


@query("""WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS other FROM conversations) SELECT conv_id, turn, CASE WHEN length(other) > length(text) THEN other ELSE text END AS chosen FROM p""")
def arbitration(spark, sf):
    from pyspark.sql.window import Window

    c = table(spark, sf, "conversations").withColumn("other", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.select("conv_id", "turn", P.arbitrate(F.col("text"), F.length("text"), F.col("other"), F.length("other")).alias("chosen"))


# --- kernels over whole tables


@query()
def spell_suggest(spark, sf):
    """Conversations against the words of the test items."""
    w = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("word")).where("length(word) > 4")
    return paged.spell(table(spark, sf, "conversations").select("conv_id", "turn", "text"), w)


@query()
def glossary_apply(spark, sf):
    terms = spark.createDataFrame([("the", "THE", True), ("le", "LE", True), ("the and", "BOTH", False)], "source string, target string, case_sensitive boolean")
    return paged.apply_glossary(table(spark, sf, "conversations").select("conv_id", "turn", "text"), terms)


@query("SELECT event_id, '{\"k\":' || json_extract(props, '$.k') || '}' AS found FROM events")
def json_salvage(spark, sf):
    """Objects found again in prose around them."""
    e = table(spark, sf, "events")
    said = F.concat(F.lit("Sure, here it is [ok]:\n```json\n"), "props", F.lit("\n```"))
    return e.select("event_id", paged.salvage(said, objects_only=True).alias("found"))


@query()
def prompt_safety(spark, sf):
    return spread(table(spark, sf, "pages")).select("page_id", translate.safe(F.col("html")).alias("safe"))


@query()
def line_slices(spark, sf):
    b = V.blocks(spark, sf).where(~text.is_blank(F.col("text")))
    return b.select(*KEY, F.posexplode(geometry.line_slices(F.col("text"), geometry.Box.of())).alias("line", "s")).select(*KEY, "line", "s.*")


@query()
def repaired_blocks(spark, sf):
    """Blocks below the quality target through a stub reader that adds a word."""
    b = V.blocks(spark, sf).select(*KEY, "text", classify.estimate_confidence(F.col("text")).alias("confidence"))
    return paged.repair_blocks(b, lambda t: (f"{t} again", 0.99))


@query(r"""SELECT doc_id, (i - 1)::INT AS line, CASE WHEN regexp_matches(x, '^#{1,6}\s') THEN 'heading' WHEN regexp_matches(x, '^\s*[-*+]\s') THEN 'bullet' WHEN regexp_matches(x, '^\s*\d+\.\s') THEN 'number' WHEN regexp_matches(x, '^---+$') THEN 'break' WHEN x = '' THEN 'blank' ELSE 'text' END AS kind,
  regexp_replace(x, '^(#{1,6}|\s*[-*+]|\s*\d+\.)\s+', '') AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)""")
def markdown_kinds(spark, sf):
    m = spread(table(spark, sf, "documents")).select("doc_id", F.posexplode(X.markdown_lines(F.col("text"))).alias("line", "m"))
    return m.select("doc_id", "line", "m.*")


SQL |= oracles.more({"gave_up": _GAVE_UP, "short": _SHORT_AREA, "conf": _CONF, "quality": _QUALITY}, translate)
