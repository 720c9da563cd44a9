"""DuckDB SQL of queries whose order-dependent kernels take recursion there."""

from __future__ import annotations

from quire.plans import views as V

_OUT = f"WITH RECURSIVE {V.BOXES}"

_IOU = """((least(t.x1, b.x1) - greatest(t.x0, b.x0)) * (least(t.y1, b.y1) - greatest(t.y0, b.y0))
  / (greatest(0.0::DOUBLE, t.x1 - t.x0) * greatest(0.0::DOUBLE, t.y1 - t.y0) + greatest(0.0::DOUBLE, b.x1 - b.x0) * greatest(0.0::DOUBLE, b.y1 - b.y0) - (least(t.x1, b.x1) - greatest(t.x0, b.x0)) * (least(t.y1, b.y1) - greatest(t.y0, b.y0))))"""

_MATCH = f"""{_OUT},
t AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY block_index) AS k FROM a),
f AS MATERIALIZED (SELECT doc_id, page_index, list({{'i': block_index, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}} ORDER BY block_index) AS boxes FROM b GROUP BY ALL),
m AS (SELECT DISTINCT doc_id, page_index, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS block_index, NULL::BIGINT AS match_index, NULL::DOUBLE AS iou FROM t
  UNION ALL SELECT doc_id, page_index, k, CASE WHEN best.v >= 0.3::DOUBLE THEN list_append(used, best.i) ELSE used END, block_index, CASE WHEN best.v >= 0.3::DOUBLE THEN best.i END, coalesce(best.v, 0.0)::DOUBLE
  FROM (SELECT t.doc_id, t.page_index, t.k, m.used, t.block_index,
      list_max([{{'v': {_IOU}, 'n': -b.i, 'i': b.i}} for b in coalesce(boxes, []) if not list_contains(m.used, b.i) and t.x0 < b.x1 and b.x0 < t.x1 and t.y0 < b.y1 and b.y0 < t.y1]) AS best
    FROM m JOIN t ON m.doc_id = t.doc_id AND m.page_index = t.page_index AND t.k = m.k + 1 LEFT JOIN f ON f.doc_id = t.doc_id AND f.page_index = t.page_index))"""

# parts of a page, each split at its widest gap until none can be
_PARTS = f"""p AS (SELECT doc_id, page_index, '' AS path, list({{'m': (x0 + x1) / 2, 'i': block_index, 'x': x0, 'y': y0}} ORDER BY (x0 + x1) / 2, block_index) AS ms FROM blocks GROUP BY doc_id, page_index
  UNION ALL SELECT doc_id, page_index, path || c.s, c.ms FROM (SELECT *, unnest([{{'s': '0', 'ms': ms[1:cut]}}, {{'s': '1', 'ms': ms[cut + 1:]}}]) AS c
    FROM (SELECT *, list_position(gaps, list_max(gaps)) AS cut FROM (SELECT *, [ms[k + 1].m - ms[k].m for k in range(1, len(ms))] AS gaps FROM p)) WHERE len(ms) >= 4 AND gaps[cut] >= 0.2::DOUBLE AND cut >= 2 AND cut <= len(ms) - 2)),
leaf AS (SELECT doc_id, page_index, path, unnest(ms) AS b FROM (SELECT *, list_position(gaps, list_max(gaps)) AS cut FROM (SELECT *, [ms[k + 1].m - ms[k].m for k in range(1, len(ms))] AS gaps FROM p)) WHERE NOT coalesce(len(ms) >= 4 AND gaps[cut] >= 0.2::DOUBLE AND cut >= 2 AND cut <= len(ms) - 2, false)),
ranks AS (SELECT doc_id, page_index, b.i AS block_index, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY path, b.y, b.x, CASE WHEN path = '' THEN 0 ELSE b.m END, b.i) - 1 AS column_rank FROM leaf)"""

_COLUMNS = f"WITH RECURSIVE {V.BLOCKS}, {_PARTS} SELECT * FROM ranks"

_MERGE = f"""WITH RECURSIVE {V.BLOCKS},
e0 AS (SELECT doc_id, page_index, min(block_index) FILTER ({V.strip('text')} <> '') AS fi, max(block_index) AS li, arg_min(text, block_index) FILTER ({V.strip('text')} <> '') AS ft, arg_max(text, block_index) AS lt FROM blocks GROUP BY ALL),
e AS MATERIALIZED (SELECT *, row_number() OVER w AS k, lead(fi) OVER w AS nfi FROM e0 WINDOW w AS (PARTITION BY doc_id ORDER BY page_index)),
r AS (SELECT DISTINCT doc_id, NULL::BIGINT AS page_index, 0::BIGINT AS k, NULL::BIGINT AS fi, NULL::BIGINT AS li, NULL::VARCHAR AS head, NULL::VARCHAR AS carry FROM e
  UNION ALL SELECT doc_id, page_index, k, fi, li, head, CASE WHEN nfi IS NOT NULL AND tail <> '' AND right(tail, 1) NOT IN ('.', '!', '?') THEN tail END
  FROM (SELECT *, {V.strip('CASE WHEN li = fi AND head IS NOT NULL THEN head ELSE lt END')} AS tail FROM (SELECT e.*, r.carry || ' ' || {V.strip('ft')} AS head FROM r JOIN e ON e.doc_id = r.doc_id AND e.k = r.k + 1)))
SELECT b.doc_id, b.page_index, b.block_index, CASE WHEN b.block_index = r.li AND r.carry IS NOT NULL THEN '' WHEN b.block_index = r.fi AND r.head IS NOT NULL THEN r.head ELSE b.text END AS text
FROM blocks b JOIN r ON r.doc_id = b.doc_id AND r.page_index = b.page_index"""

# both orders of a page's boxes; the table of each, a cell at a time; the way back through the cheaper one
_ALIGN = f"""WITH RECURSIVE {V.BOXES}, {_PARTS},
bx AS MATERIALIZED (SELECT b.*, column_rank, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY block_index) - 1 AS i FROM b JOIN ranks USING (doc_id, page_index, block_index)),
bl AS (SELECT doc_id, page_index, list({{'i': i, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}} ORDER BY y0, x0, i) AS rows_, list({{'i': i, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}} ORDER BY column_rank) AS columns_ FROM bx GROUP BY ALL),
tx AS (SELECT doc_id, page_index, list({V.strip('text')} ORDER BY block_index) AS lines FROM a WHERE {V.strip('text')} <> '' GROUP BY ALL),
pg AS MATERIALIZED (SELECT *, len(lines) AS n, len(rows_) AS m FROM bl JOIN tx USING (doc_id, page_index)),
ins AS MATERIALIZED (SELECT *, [greatest(1, length(x)) FOR x IN lines] AS chars, [greatest(1.0::DOUBLE, greatest(1e-6::DOUBLE, abs(x.x1 - x.x0) * abs(x.y1 - x.y0)) * (greatest(1, list_sum([length(l) FOR l IN lines])) / list_aggregate([greatest(1e-6::DOUBLE, abs(y.x1 - y.x0) * abs(y.y1 - y.y0)) FOR y IN boxes], 'fsum'))) FOR x IN boxes] AS room
  FROM (SELECT doc_id, page_index, n, m, lines, 0 AS o, rows_ AS boxes FROM pg UNION ALL SELECT doc_id, page_index, n, m, lines, 1, columns_ FROM pg WHERE rows_ <> columns_)),
dp AS (SELECT doc_id, page_index, o, 1::BIGINT AS t, [0::BIGINT] AS c, [0] AS mv FROM ins UNION ALL
  SELECT doc_id, page_index, o, t + 1, list_append(c, least(pair, line, box)), list_append(mv, CASE WHEN pair <= line AND pair <= box THEN 0 WHEN line <= box THEN 1 ELSE 2 END)
  FROM (SELECT doc_id, page_index, o, t, c, mv, CASE WHEN i > 0 AND j > 0 THEN c[t - m - 1] + round(1e9::DOUBLE * CASE WHEN chars[i] > room[j] THEN (chars[i] - room[j]) / chars[i] ELSE (room[j] - chars[i]) / room[j] / 2 END)::BIGINT ELSE 1::BIGINT << 60 END AS pair,
      CASE WHEN i > 0 THEN c[t - m] + 1000000000 ELSE 1::BIGINT << 60 END AS line, CASE WHEN j > 0 THEN c[t] + 400000000 ELSE 1::BIGINT << 60 END AS box
    FROM (SELECT dp.*, n, m, chars, room, t // (m + 1) AS i, t % (m + 1) AS j FROM dp JOIN ins USING (doc_id, page_index, o) WHERE t < (n + 1) * (m + 1)))),
best AS MATERIALIZED (SELECT doc_id, page_index, o, mv, boxes, lines, n, m FROM dp JOIN ins USING (doc_id, page_index, o) WHERE t = (n + 1) * (m + 1) QUALIFY row_number() OVER (PARTITION BY doc_id, page_index ORDER BY c[-1], o) = 1),
bk AS (SELECT doc_id, page_index, n AS i, m AS j, NULL::BIGINT AS line, NULL::BIGINT AS box FROM best UNION ALL
  SELECT doc_id, page_index, i - (k <> 2)::INT, j - (k <> 1)::INT, CASE WHEN k <> 2 THEN i END, CASE WHEN k = 0 THEN j END FROM (SELECT bk.doc_id, bk.page_index, i, j, mv[i * (m + 1) + j + 1] AS k FROM bk JOIN best ON bk.doc_id = best.doc_id AND bk.page_index = best.page_index WHERE i > 0 OR j > 0)),
put AS (SELECT doc_id, page_index, line, coalesce(max(box) OVER (PARTITION BY doc_id, page_index ORDER BY line), 1) AS box FROM bk WHERE line IS NOT NULL),
cn AS (SELECT doc_id, page_index, count(box) AS pairs FROM bk GROUP BY ALL),
whole AS (SELECT doc_id, page_index, array_to_string(lines, chr(10)) AS text FROM best JOIN cn USING (doc_id, page_index) WHERE (pairs = 0 AND n > 1) OR (n = 1 AND m >= 5) UNION ALL SELECT doc_id, page_index, array_to_string(lines, chr(10)) FROM tx ANTI JOIN bl USING (doc_id, page_index)),
got AS (SELECT put.doc_id, put.page_index, boxes[box].i AS i, string_agg(lines[line], ' ' ORDER BY line) AS text FROM put JOIN best ON put.doc_id = best.doc_id AND put.page_index = best.page_index GROUP BY ALL)
SELECT doc_id, page_index, 0::BIGINT AS block_index, 0.0::DOUBLE AS x0, 0.0::DOUBLE AS y0, 1.0::DOUBLE AS x1, 1.0::DOUBLE AS y1, text FROM whole UNION ALL
SELECT bx.doc_id, bx.page_index, bx.i, x0, y0, x1, y1, coalesce(got.text, '') FROM (SELECT * FROM bx ANTI JOIN whole USING (doc_id, page_index)) AS bx LEFT JOIN got ON got.doc_id = bx.doc_id AND got.page_index = bx.page_index AND got.i = bx.i"""

_CELL = f"sq <> '' AND (contains(sq, '|') OR (length(sq) <= 24 AND x1 - x0 < 0.35::DOUBLE AND {V.AREA} < 0.08::DOUBLE))"
_TABLE = f"""WITH RECURSIVE {V.BLOCKS}, q AS (SELECT *, {V.squeeze('text')} AS sq FROM blocks),
c AS MATERIALIZED (SELECT *, (y0 + y1) / 2 AS y, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY block_index) AS k, count(*) OVER (PARTITION BY doc_id, page_index) AS n FROM q WHERE {_CELL}),
r AS (SELECT DISTINCT doc_id, page_index, 0::BIGINT AS k, n, []::STRUCT(s DOUBLE, n BIGINT, m BIGINT[])[] AS rows FROM c
  UNION ALL SELECT doc_id, page_index, k, n, CASE WHEN coalesce(found, 0) = 0 THEN list_append(rows, {{'s': y, 'n': 1::BIGINT, 'm': [k]}}) ELSE [CASE WHEN j = found THEN {{'s': rows[j].s + y, 'n': rows[j].n + 1, 'm': list_append(rows[j].m, k)}} ELSE rows[j] END for j in range(1, len(rows) + 1)] END
  FROM (SELECT c.doc_id, c.page_index, c.k, c.n, c.y, r.rows, list_position([abs(c.y - x.s / x.n) <= 0.018::DOUBLE for x in r.rows], true) AS found FROM r JOIN c ON c.doc_id = r.doc_id AND c.page_index = r.page_index AND c.k = r.k + 1)),
u AS (SELECT doc_id, page_index, unnest(rows) AS x, generate_subscripts(rows, 1) AS ri FROM r WHERE k = n),
v AS (SELECT doc_id, page_index, ri, unnest(x.m) AS k FROM u),
w AS (SELECT v.ri, c.*, row_number() OVER (PARTITION BY c.doc_id, c.page_index, ri ORDER BY x0, c.k) - 1 AS column_index, first_value(y0) OVER (PARTITION BY c.doc_id, c.page_index, ri ORDER BY x0, c.k) AS head FROM v JOIN c ON c.doc_id = v.doc_id AND c.page_index = v.page_index AND c.k = v.k)
SELECT doc_id, page_index, block_index, text, 0::BIGINT AS table_index, row_index, column_index FROM (SELECT *, dense_rank() OVER (PARTITION BY doc_id, page_index ORDER BY head, ri) - 1 AS row_index, max(column_index) OVER (PARTITION BY doc_id, page_index) AS wide, max(ri) OVER (PARTITION BY doc_id, page_index) AS deep FROM w) WHERE wide >= 1 AND deep >= 2"""

_CHUNKS = f"""WITH RECURSIVE p0 AS (SELECT doc_id, text, [x for x in flatten([CASE WHEN length(p) <= 996 THEN [{{'w': p, 'd': chr(10) || chr(10)}}]
    ELSE flatten([CASE WHEN length(l) <= 998 THEN [{{'w': l, 'd': chr(10)}}] ELSE [{{'w': w, 'd': ' '}} for w in string_split(l, ' ')] END for l in string_split(p, chr(10))]) END for p in string_split(text, chr(10) || chr(10))]) if x.w <> ''] AS ps FROM documents WHERE length(text) > 1000),
p AS MATERIALIZED (SELECT doc_id, len(ps) AS n, unnest(ps) AS x, generate_subscripts(ps, 1) AS k FROM p0),
r AS (SELECT doc_id, k, n, x.w AS cur, NULL::VARCHAR AS done FROM p WHERE k = 1
  UNION ALL SELECT p.doc_id, p.k, p.n, CASE WHEN length(cur) + length(x.d) + length(x.w) > 1000 THEN x.w ELSE cur || x.d || x.w END, CASE WHEN length(cur) + length(x.d) + length(x.w) > 1000 THEN cur END FROM r JOIN p ON p.doc_id = r.doc_id AND p.k = r.k + 1),
c AS (SELECT doc_id, k, done AS chunk FROM r WHERE done IS NOT NULL UNION ALL SELECT doc_id, n + 1, cur FROM r WHERE k = n UNION ALL SELECT doc_id, 1, text FROM documents WHERE text <> '' AND length(text) <= 1000)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS chunk_index, chunk FROM c WHERE {V.strip('chunk')} <> '' OR length(chunk) <= 1000 AND k = 1 AND doc_id NOT IN (SELECT doc_id FROM p0)"""

# the scripts of letters by range, with the place of the first for ties
_SCRIPTS = {"Latin": (0x0041, 0x024F), "CJK": (0x4E00, 0x9FFF), "Hiragana": (0x3040, 0x309F), "Katakana": (0x30A0, 0x30FF), "Arabic": (0x0600, 0x06FF), "Devanagari": (0x0900, 0x097F), "Cyrillic": (0x0400, 0x04FF), "Greek": (0x0370, 0x03FF), "Hebrew": (0x0590, 0x05FF), "Hangul": (0xAC00, 0xD7AF)}


def script(text: str) -> str:
    """struct(name, n, total) of the most frequent script."""
    each = ", ".join(f"{{'n': len([1 for ch in ls if unicode(ch) between {lo} and {hi}]), 'o': {-i}, 'name': '{'CJK' if s in ('Hiragana', 'Katakana', 'Hangul') else s}'}}" for i, (s, (lo, hi)) in enumerate(_SCRIPTS.items()))
    return f"(SELECT {{'top': list_max(c), 'total': list_sum([x.n for x in c])}} FROM (SELECT [{each}] AS c FROM (SELECT regexp_extract_all({text}, '\\p{{L}}') AS ls)))"


def escape(c: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        c = f"replace({c}, '{a}', '{b}')"
    return c


_HTML = f"""WITH {V.LAID_OUT},
h AS (SELECT *, CASE role WHEN 'header' THEN 'page_header' WHEN 'footer' THEN 'page_footer' WHEN 'page_number' THEN 'page_number' WHEN 'figure' THEN 'figure' ELSE CASE kind WHEN 'heading' THEN 'section_header' WHEN 'list_item' THEN 'list_item' ELSE 'paragraph' END END AS nt,
  {escape('text')} AS e, ' data-block-id="' || substr(sha256(doc_id || '/' || page_index || '/' || block_index), 1, 16) || '" data-bbox="' || printf('%.4f,%.4f,%.4f,%.4f', x0, y0, x1, y1) || '"' AS data FROM laid),
i AS (SELECT *, nt = 'list_item' AS li, CASE nt WHEN 'section_header' THEN '<h1' || data || '>' || e || '</h1>' WHEN 'list_item' THEN '<li' || data || '>' || e || '</li>' WHEN 'figure' THEN '<figure' || data || '><figcaption>' || e || '</figcaption></figure>'
  WHEN 'page_header' THEN '<!-- PageHeader=' || e || ' -->' WHEN 'page_footer' THEN '<!-- PageFooter=' || e || ' -->' WHEN 'page_number' THEN '<!-- PageNumber=' || e || ' -->' ELSE '<p' || data || '>' || e || '</p>' END AS html FROM h),
j AS (SELECT *, CASE WHEN li AND NOT coalesce(lag(li) OVER w, false) THEN '<ul>' || chr(10) ELSE '' END || html || CASE WHEN li AND NOT coalesce(lead(li) OVER w, false) THEN chr(10) || '</ul>' ELSE '' END AS line FROM i WINDOW w AS (PARTITION BY doc_id, page_index ORDER BY block_index)),
s AS (SELECT doc_id, page_index, '<section data-page-idx="' || page_index || '">' || chr(10) || string_agg(line, chr(10) ORDER BY block_index) || chr(10) || '</section>' AS section FROM j GROUP BY doc_id, page_index)
SELECT doc_id, '<!DOCTYPE html>' || chr(10) || '<html lang="en">' || chr(10) || '<head>' || chr(10) || '<meta charset="utf-8">' || chr(10) || '<title>Document</title>' || chr(10) || '</head><body>' || chr(10) || string_agg(section, chr(10) || '<!-- PageBreak -->' || chr(10) ORDER BY page_index) || chr(10) || '</body></html>' AS body FROM s GROUP BY doc_id"""

_ENTITY = r"""SELECT doc_id, list_sort(list_distinct(regexp_extract_all(coalesce(text, ''), '(?i)\b(\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s*\d{2,4})\b', 1))) AS dates,
  [x for x in regexp_extract_all(text, '(?:^|[^.!?])\s([A-Z][a-zA-Z''\-]{1,}(?:\s+[A-Z][a-zA-Z''\-]{1,})*)', 1) if not list_contains(stop, lower(x))] AS found"""


def more(trust, translate) -> dict[str, str]:
    """SQL by query; ``trust`` holds the SQL pieces of the trust queries, ``translate`` the fixed word list."""
    stop = "[" + ", ".join(f"'{w}'" for w in translate.NOT_NAMES) + "]"
    short = "length(x) BETWEEN 2 AND 6 AND upper(x) = x"
    repeats = """SELECT DISTINCT doc_id, page_index, block_index FROM (SELECT doc_id, page_index, block_index, s FROM (SELECT doc_id, page_index, block_index, substr(text, i, 6) AS s FROM blocks, LATERAL unnest(range(1, length(text) - 4)) AS t(i) WHERE length(text) >= 18) GROUP BY ALL HAVING count(*) >= 3)"""
    level = f"CASE WHEN {V.strip('text')} = '' THEN 0 ELSE least(3, 2 * (({trust['gave_up']})::INT + (NOT ({trust['short']}))::INT + (rep.doc_id IS NOT NULL)::INT)) END"
    quality = trust["quality"]
    return {
        "greedy_iou_match": f"{_MATCH} SELECT doc_id, page_index, block_index, match_index, iou FROM m WHERE k > 0",
        "recall_report": f"{_MATCH} SELECT count(*) AS gt_blocks, count(match_index) AS matched, count(match_index) / greatest(1, count(*)) AS block_recall, coalesce(avg(iou) FILTER (match_index IS NOT NULL), 0.0)::DOUBLE AS average_iou FROM m WHERE k > 0",
        "align_lines": _ALIGN,
        "column_major_order": _COLUMNS,
        "cross_page_merge": _MERGE,
        "table_grid": _TABLE,
        "chunk_documents": _CHUNKS,
        "script_detect": f"SELECT doc_id, CASE WHEN s.total > 0 THEN s.top.name END AS script, CASE WHEN s.total > 0 THEN s.top.n / s.total END AS confidence FROM (SELECT doc_id, {script('text')} AS s FROM documents)",
        "grid_coverage": f"""WITH {V.BOXES}, g1 AS (SELECT doc_id, page_index, list({{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}) AS boxes FROM b GROUP BY ALL),
pt AS (SELECT a.doc_id, a.page_index, a.block_index, x0 + (x1 - x0) * (i + 0.5::DOUBLE) / 20 AS px, y0 + (y1 - y0) * (j + 0.5::DOUBLE) / 20 AS py FROM a, range(20) AS t(i), range(20) AS u(j))
SELECT doc_id, page_index, block_index, avg(CASE WHEN len([1 for q in coalesce(boxes, []) if q.x0 <= px and px <= q.x1 and q.y0 <= py and py <= q.y1]) > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS coverage FROM pt LEFT JOIN g1 USING (doc_id, page_index) GROUP BY ALL""",
        "export_json": f"WITH {V.PAGES} SELECT doc_id, to_json({{'pages': list({{'page_index': page_index, 'lines': string_split(page_text, chr(10)), 'text': page_text}} ORDER BY page_index)}})::VARCHAR AS body FROM pages_ GROUP BY doc_id",
        "export_html": _HTML,
        "metadata_report": f"""{quality}, hb AS (SELECT doc_id, page_index, string_agg('{{"code":"empty_large_block","severity":"warning","block_index":' || block_index || '}}', ',' ORDER BY block_index) AS hf,
  string_agg('{{"action":"retry_block_or_grounded","status":"recommended","reason":"empty_large_block","block_index":' || block_index || '}}', ',' ORDER BY block_index) AS hd FROM blocks WHERE {V.strip('text')} = '' AND {V.AREA} >= 0.05::DOUBLE GROUP BY ALL),
x AS (SELECT doc_id, page_index, n, c, empty::INT + sparse::INT + holes AS k, concat_ws(',', CASE WHEN empty THEN '{{"code":"empty_page","severity":"warning"}}' END, CASE WHEN sparse THEN '{{"code":"sparse_text","severity":"warning"}}' END, hf) AS fs,
  concat_ws(',', CASE WHEN empty THEN '{{"action":"retry_empty_page","status":"recommended","reason":"empty_page"}}' END, CASE WHEN sparse THEN '{{"action":"switch_dense_mode","status":"recommended","reason":"sparse_text"}}' END, hd) AS ds FROM f LEFT JOIN hb USING (doc_id, page_index))
SELECT doc_id, '{{"pages":[' || string_agg('{{"page_index":' || page_index || ',"quality":{{"block_count":' || n || ',"text_char_count":' || c || ',"findings":[' || fs || ']}},"routing":{{"decision_count":' || k || ',"decisions":[' || ds || ']}}}}', ',' ORDER BY page_index) || ']}}' AS report FROM x GROUP BY doc_id""",
        "entities": f"SELECT doc_id, list_sort(list_distinct([x for x in found if not ({short})])) AS names, dates, list_sort(list_distinct([x for x in found if {short}])) AS acronyms FROM ({_ENTITY} FROM documents, (SELECT {stop} AS stop))",
        "glossary_apply": "SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(text, 'the and', 'BOTH', 'gi'), 'the', 'THE', 'g'), 'le', 'LE', 'g') AS text FROM conversations",
        "prompt_safety": r"""SELECT page_id, CASE WHEN length(t) > 16384 THEN left(t, 16384) || ' …[truncated]' ELSE t END AS safe FROM (SELECT page_id, regexp_replace(regexp_replace(nfc_normalize(html), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}\x{feff}\x{200b}-\x{200d}\x{2060}\x{2028}]', '', 'g'), '[ \t]{3,}', '  ', 'g') AS t FROM pages)""",
        "line_slices": f"""WITH {V.BLOCKS}, w AS (SELECT *, [x for x in string_split(text, chr(10)) if x <> ''] AS given, y1 - y0 AS h FROM blocks WHERE {V.strip('text')} <> ''),
v AS (SELECT *, [x for x in string_split(given[1], ' ') if x <> ''] AS ws FROM w), n AS (SELECT *, len(ws) AS nw, CASE WHEN h > 0.13::DOUBLE THEN least(3, len(ws)) ELSE 2 END AS parts FROM v),
c AS (SELECT *, CASE WHEN len(given) = 1 AND h > 0.07::DOUBLE AND h / (x1 - x0) > 0.20::DOUBLE AND nw >= 2 THEN [array_to_string(ws[round_even(i * nw / parts, 0)::INT + 1 : round_even((i + 1) * nw / parts, 0)::INT], ' ') for i in range(parts)] ELSE given END AS ls FROM n)
SELECT doc_id, page_index, block_index, (i - 1)::INT AS line, t AS text, yy0 + h * (i - 1) / k AS y0, yy0 + h * i / k AS y1 FROM (SELECT doc_id, page_index, block_index, y0 AS yy0, h, len(ls) AS k, unnest(ls) AS t, generate_subscripts(ls, 1) AS i FROM c)""",
        "repaired_blocks": f"WITH {V.STRUCTURED}, c AS (SELECT doc_id, page_index, block_index, text, {trust['conf']} AS conf FROM structured) SELECT doc_id, page_index, block_index, CASE WHEN conf < 0.98 THEN text || ' again' ELSE text END AS text, CASE WHEN conf < 0.98 THEN 0.99 ELSE conf END::DOUBLE AS confidence, (conf < 0.98)::BIGINT AS attempts FROM c",
        "hallucination_level": f"WITH {V.BLOCKS}, rep AS ({repeats}) SELECT blocks.doc_id, blocks.page_index, blocks.block_index, {level} AS level FROM blocks LEFT JOIN rep USING (doc_id, page_index, block_index)",
        "trust_layer": f"""WITH {V.STRUCTURED}, rep AS ({repeats}), mk AS (SELECT DISTINCT a.doc_id, a.page_index, a.block_index FROM blocks a JOIN blocks b USING (doc_id, page_index) WHERE b.block_index = 3 AND b.doc_id % 2 = 0 AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1),
s1 AS (SELECT structured.*, {trust['conf']} AS raw, {level} AS level, mk.doc_id IS NOT NULL AS mark, {script('text')} AS sc FROM structured LEFT JOIN rep USING (doc_id, page_index, block_index) LEFT JOIN mk USING (doc_id, page_index, block_index)),
s2 AS (SELECT *, CASE WHEN sc.total > 0 THEN sc.top.name END AS script, 1 / (1 + exp(-(1.5::DOUBLE * raw + 0.1::DOUBLE))) AS conf FROM s1),
cn AS (SELECT doc_id, page_index, script, count(*) AS n FROM s2 WHERE script IS NOT NULL GROUP BY ALL), pg AS (SELECT doc_id, page_index, arg_min(script, {{'n': -n, 's': script}}) AS page_script FROM cn GROUP BY ALL),
s3 AS (SELECT s2.*, coalesce(sc.top.n / sc.total >= 0.5 AND script <> page_script, false) AS odd FROM s2 LEFT JOIN pg USING (doc_id, page_index)),
fl AS (SELECT *, [x for x in [CASE WHEN level > 0 THEN 'hallucination_risk' END, CASE WHEN mark THEN 'watermark_hit' END, CASE WHEN odd THEN 'script_mismatch' END, CASE WHEN conf < 0.5 THEN 'low_calibrated_conf' END] if x is not null] AS f FROM s3)
SELECT doc_id, page_index, block_index, (conf * (1.0 - 0.5 * CASE level WHEN 2 THEN 0.5 WHEN 3 THEN 1.0 ELSE 0.0 END) * CASE WHEN mark THEN 0.7 ELSE 1.0 END * CASE WHEN odd THEN 0.8 ELSE 1.0 END)::DOUBLE AS trust_score, CASE WHEN len(f) > 0 THEN f END AS trust_flags FROM fl""",
        "spell_suggest": r"""WITH kn AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS w FROM benchmark) WHERE length(w) > 4),
tok AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '\p{L}+|\P{L}+')) AS t, generate_subscripts(regexp_extract_all(text, '\p{L}+|\P{L}+'), 1) AS i FROM conversations),
lo AS (SELECT DISTINCT lower(t) AS w FROM tok WHERE regexp_matches(t, '^\p{L}')),
near AS (SELECT lo.w, kn.w AS new, CASE WHEN length(lo.w) <= length(kn.w) THEN lo.w ELSE kn.w END AS a, CASE WHEN length(lo.w) <= length(kn.w) THEN kn.w ELSE lo.w END AS b FROM lo JOIN kn ON abs(length(lo.w) - length(kn.w)) <= 1 WHERE lo.w NOT IN (SELECT w FROM kn)),
pre AS (SELECT *, coalesce(list_min([i for i in range(1, length(a) + 1) if substr(a, i, 1) <> substr(b, i, 1)]), length(a) + 1) - 1 AS k FROM near),
fix AS (SELECT w, any_value(new) AS new FROM pre WHERE CASE WHEN length(a) < length(b) THEN substr(a, k + 1) = substr(b, k + 2) ELSE substr(a, k + 2) = substr(b, k + 2) OR (substr(a, k + 1, 2) = reverse(substr(b, k + 1, 2)) AND substr(a, k + 3) = substr(b, k + 3)) END GROUP BY w HAVING count(*) = 1),
o AS (SELECT conv_id, turn, i, CASE WHEN new IS NULL THEN t WHEN upper(t) = t AND length(t) > 1 THEN replace(upper(new), 'ẞ', 'SS') WHEN upper(left(t, 1)) = left(t, 1) THEN replace(upper(left(new, 1)), 'ẞ', 'Ss') || substr(new, 2) ELSE new END AS t FROM tok LEFT JOIN fix ON fix.w = lower(tok.t))
SELECT c.conv_id, c.turn, coalesce(string_agg(t, '' ORDER BY i), '') AS text FROM conversations c LEFT JOIN o USING (conv_id, turn) GROUP BY ALL""",
    }
