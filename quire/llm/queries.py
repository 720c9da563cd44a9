"""Queries op1 to op13 over the standard tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import chat, decontaminate, jaccard, language, mixing, phrases, pii, quality, shards, tokens, turns, urls, warc
from quire.llm.common import read

RULES = [
    urls.UrlRule("com", "/", "allow"),
    urls.UrlRule("example.com", "/en/", "block"),
    urls.UrlRule("www.example.com", "/en/", "allow"),
    urls.UrlRule("net", "/es/", "block"),
    urls.UrlRule("net", "/fr/", "block"),
]


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document of the same number; bad is low quality or toxic."""
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    return urls.judge(read(spark, sf_dir, "pages"), labels, RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    automaton = decontaminate.build(spark, read(spark, sf_dir, "benchmark"))
    out = decontaminate.digest(read(spark, sf_dir, "documents"), automaton)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each participant's dialogue, in parts, with the masked ranges of the whole."""
    d = chat.dialogues(chat.rotate(read(spark, sf_dir, "conversations")))
    masks = F.array_join(F.transform("masks", lambda m: F.concat_ws("-", m["start"], m["end"])), ",")
    return d.select("conv_id", "perspective", "part", "start", "text", masks.alias("masks"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts from the last entry of each document's prefix table, its length, and what fits the limit."""
    import public_tokenizers

    return tokens.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), numbered=True)


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents")).drop("found")


def op8_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(read(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.apply_rules(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.plan(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations, repaired; one of which the damage left nothing has zeros and the hash of no text."""
    conversations = read(spark, sf_dir, "conversations")
    report, repaired = turns.repair(turns.damage(conversations))
    all_ = conversations.select("conv_id").distinct()
    for part in (report, turns.digests(repaired)):
        all_ = all_.unionByName(part, allowMissingColumns=True)
    numbers = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    texts = [F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256")]
    return all_.groupBy("conv_id").agg(*numbers, *texts)


def op12_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return language.identify(documents, language.fit(documents))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, totals = phrases.mine(read(spark, sf_dir, "documents"))
    return phrases.top(phrases.score(found, totals)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


# --- what SQL can check of op7, op8, op10 and op12


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op7."""
    return op7_personal_data(spark, sf_dir).drop("spans")


def shard_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of op8, whether each shard's slots have no gaps, and whether its bytes are within a row and a tenth of the mean."""
    rows = op8_histogram_shards(spark, sf_dir)
    by = rows.groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("slots"), F.max("slot").alias("last"), F.sum("size").alias("bytes"), F.max("size").alias("largest"))
    whole = by.agg(F.sum("n").alias("rows"), F.sum("bytes").alias("bytes"), F.max("largest").alias("row"), F.every((F.col("slots") == F.col("n")) & (F.col("last") == F.col("n") - 1)).alias("gapless"), F.max("bytes").alias("high"))
    return whole.select("rows", "bytes", "gapless", (F.col("high") <= F.col("bytes") / shards.SHARDS * 1.1 + F.col("row")).alias("near"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets of op10, and whether each document is taken at most twice."""
    out = op10_cube_mix(spark, sf_dir)
    return out.select("doc_id", "size", "source_size", "target", (F.col("taken") <= 2 * F.col("size")).alias("within"))


def language_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op12 holds out and what it can't tell, and whether its other answers are languages that it learned."""
    documents = read(spark, sf_dir, "documents")
    learned = documents.select(F.col("lang").alias("lang_pred")).distinct()
    out = op12_language_codes(spark, sf_dir).join(learned.withColumn("known", F.lit(True)), "lang_pred", "left")
    return out.select("doc_id", "held_out", (F.col("lang_pred") == language.UNDETERMINED).alias("undetermined"), F.coalesce("known", F.lit(False)).alias("known"))


QUERIES = {f.__name__: f for f in (pii_base, shard_totals, mix_targets, language_split, op1_url_reputation, op2_decontaminate, op3_warc, op4_jaccard_join, op5_chat_rotation, op6_token_counts, op7_personal_data, op8_histogram_shards, op9_quality_rules, op10_cube_mix, op11_turn_repair, op12_language_codes, op13_collocations)}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_TWO = ", ".join(f"'{s}'" for s in urls.TWO_LABEL_SUFFIXES)
_STOP = ", ".join(f"'{w}'" for w in sorted({w for ws in quality.STOP_WORDS.values() for w in ws}))


def _strength(level: str) -> str:
    """Moments of children (parent, n, b, pn, pb)."""
    return f"""(SELECT CASE WHEN room IS NULL OR room <= 0 THEN 10.0 ELSE 1 / least(0.99, greatest(0.001, over_ / room)) - 1 END AS k FROM (
      SELECT sum(s - (k - 1) * q * (1 - q)) AS over_, sum(q * (1 - q) * (pn - n2 / pn - (k - 1))) AS room FROM (
        SELECT parent, any_value(pb::DOUBLE / pn) AS q, any_value(pn::DOUBLE) AS pn, sum(n * (b::DOUBLE / n - pb::DOUBLE / pn) * (b::DOUBLE / n - pb::DOUBLE / pn)) AS s, sum(n * n)::DOUBLE AS n2, count(*) AS k
        FROM {level} WHERE n > 0 GROUP BY parent)))"""


def _spans_of(kind: str, pattern: str, valid: str) -> str:
    """Rows (doc_id, kind, start, end) of the valid matches, from the lengths of matches and of what lies between."""
    return f"""SELECT doc_id, '{kind}' AS kind, x.st AS st, x.st + length(x.m) AS en FROM (SELECT doc_id, unnest([{{'m': ms[i], 'st': list_sum([length(p) for p in ps[1:i]]) + coalesce(list_sum([length(m) for m in ms[1:i - 1]]), 0)}} for i in range(1, len(ms) + 1)]) AS x
  FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, regexp_split_to_array(t, '{pattern}') AS ps FROM t WHERE regexp_matches(t, '{pattern}'))) WHERE {valid}"""


_DIGITS = "regexp_replace(x.m, '[^0-9]', '', 'g')"
_LUHN = f"length({_DIGITS}) BETWEEN 13 AND 19 AND list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT ELSE CASE WHEN c::INT > 4 THEN c::INT * 2 - 9 ELSE c::INT * 2 END END)) % 10 = 0"
_KINDS = " UNION ALL ".join((
    _spans_of("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    _spans_of("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len([1 for p in string_split(x.m, '.') if length(ltrim(p, '0')) > 3 or coalesce(try_cast(p AS INT), 999) > 255]) = 0"),
    _spans_of("card", r"[0-9](?:[\x20-]?[0-9])+", _LUHN),
    _spans_of("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
))

_CRC_TABLE = "tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) AS r(i)))"


def _crc(key: str) -> str:
    """CRC-32 of ASCII text, by ``t`` of the table."""
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({key}, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295)"


SQL = {
    "language_split": f"""
WITH {_CRC_TABLE}
SELECT doc_id, coalesce({_crc('doc_id::VARCHAR')} % 4 = 2, false) AS held_out, NOT coalesce(regexp_matches(text, '\\p{{L}}'), false) AS undetermined, coalesce(regexp_matches(text, '\\p{{L}}'), false) AS known FROM documents, tab""",
    "pii_base": f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({_KINDS}),
g AS (SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
  string_agg(kind || ':' || st || ':' || en, ',' ORDER BY list_position(['email', 'ip', 'card', 'phone'], kind), st) AS j FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(j, '')) AS base_sha256 FROM t LEFT JOIN g USING (doc_id)""",
    "shard_totals": "SELECT count(*) AS rows, sum(strlen(coalesce(text, '')) + 8)::BIGINT AS bytes, true AS gapless, true AS near FROM documents",
    "mix_targets": r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS MATERIALIZED (SELECT source, sum(size)::BIGINT AS n, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
u AS (SELECT 0 AS k, (SELECT sum(n) * 1.5::DOUBLE / sum(w) FROM s) AS unit UNION ALL
  SELECT k + 1, (1.5::DOUBLE * sum(n) - 2.0 * coalesce(sum(n) FILTER (unit * w > 2.0 * n), 0)) / sum(w) FILTER (NOT unit * w > 2.0 * n) FROM u, s WHERE k < 50 GROUP BY k),
last AS (SELECT arg_max(unit, k) FILTER (unit IS NOT NULL) AS unit FROM u)
SELECT doc_id, size, n AS source_size, CASE WHEN unit * w > 2.0 * n THEN 2.0 * n ELSE unit * w END::DOUBLE AS target, true AS within FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, last""",
    "op1_url_reputation": f"""
WITH p AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'), {_AZ}) ELSE '' END AS host,
    CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
l AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
h0 AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS b, string_split(host, '.') AS x FROM p LEFT JOIN l USING (page_id) GROUP BY host),
h1 AS (SELECT *, list_aggregate(x[-2:], 'string_agg', '.') AS two FROM h0),
h AS (SELECT host, n, b,
  CASE WHEN len(x) <= CASE WHEN two IN ({_TWO}) AND len(x) > 2 THEN 3 ELSE 2 END THEN host WHEN two IN ({_TWO}) AND len(x) > 2 THEN list_aggregate(x[-3:], 'string_agg', '.') ELSE two END AS domain,
  CASE WHEN len(x) >= 2 AND two IN ({_TWO}) THEN two ELSE x[-1] END AS suffix FROM h1),
d AS (SELECT domain, any_value(suffix) AS suffix, sum(n) AS n, sum(b) AS b FROM h GROUP BY domain),
s AS (SELECT suffix, sum(n) AS n, sum(b) AS b FROM h GROUP BY suffix),
w AS (SELECT sum(n) AS n, sum(b) AS b FROM h),
lh AS (SELECT h.domain AS parent, h.n, h.b, d.n AS pn, d.b AS pb FROM h JOIN d USING (domain)),
ld AS (SELECT d.suffix AS parent, d.n, d.b, s.n AS pn, s.b AS pb FROM d JOIN s USING (suffix)),
ls AS (SELECT 0 AS parent, s.n, s.b, w.n AS pn, w.b AS pb FROM s, w),
k AS (SELECT {_strength('lh')} AS kh, {_strength('ld')} AS kd, {_strength('ls')} AS ks),
ms AS (SELECT s.suffix, (s.b + ks * ((w.b + 1.0) / (w.n + 2.0))) / (s.n + ks) AS m FROM s, w, k),
md AS (SELECT d.domain, (d.b + kd * ms.m) / (d.n + kd) AS m FROM d JOIN ms USING (suffix), k),
mh AS (SELECT h.host, (h.b + kh * md.m) / (h.n + kh) AS m, h.n + kh AS size FROM h JOIN md USING (domain), k),
r AS (SELECT host, m - 1.64 * sqrt(m * (1 - m) / (size + 1)) AS bound FROM mh),
j AS (SELECT p.*, bound, CASE
  WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM p LEFT JOIN r USING (host))
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN host <> '' AND bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict FROM j""",
    "op2_decontaminate": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g FROM b, LATERAL unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM d, lens, LATERAL unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
hit AS (SELECT doc_id, i, bw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, LATERAL unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op3_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first_id <> page_id THEN first_id END AS refers_to FROM f""",
    "op4_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + least(len(w), 5) - 1], ' ')) AS s FROM d, LATERAL unnest(range(1, len(w) - least(len(w), 5) + 2)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM both_ JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(reach.y) AS component_id FROM d JOIN reach ON reach.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op5_chat_rotation": f"""
WITH m AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|im_', '<| im_') AS said FROM conversations),
w AS (SELECT DISTINCT conv_id, speaker AS perspective FROM m WHERE speaker <> 'system'),
e AS (SELECT m.*, perspective, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role FROM m JOIN w ON m.conv_id IS NOT DISTINCT FROM w.conv_id),
h AS (SELECT *, '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || regexp_replace(speaker, '[^A-Za-z0-9_-]', '_', 'g') ELSE '' END || chr(10) AS head FROM e),
r AS (SELECT conv_id, perspective, turn, speaker, head || said || '<|im_end|>' || chr(10) AS rendered, CASE WHEN role = 'assistant' THEN length(head) END AS a, CASE WHEN role = 'assistant' THEN length(head) + length(said) + 11 END AS b FROM h),
o AS (SELECT *, coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY turn, speaker, rendered ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at_ FROM r)
SELECT conv_id, perspective, at_ // {chat.PART} AS part, min(at_) AS start, string_agg(rendered, '' ORDER BY at_) AS text,
  coalesce(string_agg((at_ + a) || '-' || (at_ + b), ',' ORDER BY at_) FILTER (a IS NOT NULL), '') AS masks FROM o GROUP BY conv_id, perspective, at_ // {chat.PART}""",
    "op9_quality_rules": f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 2], ' ') AS g FROM d, LATERAL unnest(range(1, len(w) - 1)) AS t(i) WHERE len(w) >= 3),
r AS (SELECT doc_id, count(DISTINCT p) AS k FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g), LATERAL unnest(range(i, i + 3)) AS t(p) WHERE c >= 2 GROUP BY doc_id),
m AS (SELECT d.doc_id, lang, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(k, 0)::BIGINT AS n_repeat_words,
  len(ls) AS n_lines, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS upper_, len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS stop
  FROM d LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 1.5 AND 25 AND n_symbols / n_words <= 0.25 AND upper_ / word_chars <= 0.4 AND n_dup_lines / n_lines <= 0.6
  AND (lang IS NULL OR lang NOT IN ('en', 'fr', 'de', 'es') OR stop / n_words >= 0.02) AS kept FROM f""",
    "op11_turn_repair": rf"""
WITH RECURSIVE {_CRC_TABLE},
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
f AS (SELECT *, {_crc('key')} % 20 AS f FROM o, tab),
m AS (SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE f WHEN 3 THEN [0, 1] ELSE [0] END) AS n FROM f WHERE f <> 0),
p AS (SELECT *, row_number() OVER w AS i, substr(role, 1, 1) AS r, lag(substr(role, 1, 1)) OVER w AS before, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, n) AS k, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank
  FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, substr(text, 1, 64), sha256(text), n)),
q AS (SELECT *, NOT blank AND k > 1 AS dup, NOT blank AND k = 1 AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut FROM p),
stats AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM q GROUP BY conv_id),
trans AS (SELECT * FROM (VALUES ('', 's', []), ('', 'u', []), ('s', 'u', []), ('a', 'u', []), ('u', 'a', []), ('', 'a', ['user:']), ('s', 'a', ['user:']), ('a', 'a', ['user:']), ('u', 'u', ['assistant:'])) AS v(a, b, gap)),
ways AS (SELECT conv_id, i, NULL AS b, 'D' AS letter, 4 AS cost, NULL AS line FROM q UNION ALL
  SELECT conv_id, i, r, 'K', 3 * cut::INT, role || ':' || text FROM q WHERE NOT blank AND NOT dup AND r IN ('s', 'u', 'a') UNION ALL
  SELECT conv_id, i, v.x[1], 'R', 3 + 3 * cut::INT, v.x || ':' || text FROM q, (VALUES ('user'), ('assistant')) AS v(x) WHERE NOT blank AND NOT dup),
dp AS (SELECT conv_id, 0::BIGINT AS i, '' AS s, {{'cost': 0, 'audit': '', 'lines': []::VARCHAR[]}} AS best FROM stats UNION ALL
  SELECT d.conv_id, w.i, coalesce(w.b, d.s), min({{'cost': d.best.cost + w.cost + 3 * coalesce(len(t.gap), 0)::INT, 'audit': d.best.audit || repeat('I', coalesce(len(t.gap), 0)) || w.letter,
    'lines': CASE WHEN w.b IS NULL THEN d.best.lines ELSE list_append(list_concat(d.best.lines, t.gap), w.line) END}})
  FROM dp d JOIN ways w ON w.conv_id IS NOT DISTINCT FROM d.conv_id AND w.i = d.i + 1 LEFT JOIN trans t ON t.a = d.s AND t.b = w.b WHERE w.b IS NULL OR t.a IS NOT NULL GROUP BY ALL),
ends AS (SELECT d.conv_id, min({{'cost': best.cost + CASE s WHEN 'u' THEN 3 WHEN 's' THEN 6 ELSE 0 END, 'audit': best.audit || CASE s WHEN 'u' THEN 'I' WHEN 's' THEN 'II' ELSE '' END,
    'lines': list_concat(best.lines, CASE s WHEN 'u' THEN ['assistant:'] WHEN 's' THEN ['user:', 'assistant:'] ELSE [] END)}}) AS e
  FROM dp d JOIN stats ON stats.conv_id IS NOT DISTINCT FROM d.conv_id AND d.i = n GROUP BY d.conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(e.cost, 0)::BIGINT AS cost, coalesce(e.audit, '') AS audit, sha256(coalesce(array_to_string(e.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM c.conv_id""",
    "op13_collocations": rf"""
WITH p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), {_AZ}) AS t FROM documents)),
f AS MATERIALIZED (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM p, LATERAL unnest(range(1, 6)) AS t(k), LATERAL unnest(range(1, len(w) - k + 2)) AS u(i) GROUP BY ALL HAVING count(*) >= {phrases.LEAST}),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
stay AS (SELECT * FROM f WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM f AS g WHERE g.lang = f.lang AND g.k > f.k AND g.f >= f.f AND contains(' ' || g.phrase || ' ', ' ' || f.phrase || ' '))),
cuts AS (SELECT s.lang, s.phrase, s.f AS a, c AS cut, x.f AS l, y.f AS r, n, ((1000::HUGEINT * s.f * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM (SELECT *, string_split(phrase, ' ') AS ws FROM stay) AS s, LATERAL unnest(range(1, k)) AS t(c) JOIN f AS x ON x.lang = s.lang AND x.phrase = array_to_string(ws[1 : c], ' ') JOIN f AS y ON y.lang = s.lang AND y.phrase = array_to_string(ws[c + 1 :], ' ') JOIN n ON n.lang = s.lang),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, n, score FROM worst WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER w <= {phrases.TOP}""",
}
