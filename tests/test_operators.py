"""Operators on small frames, with nulls, blanks and edges."""

import pytest
from pyspark.sql import functions as F

from quire.functions import classify, geometry, text, trust
from quire.operators import blocks as B
from quire.operators import glossary as G
from quire.operators import jobs as J
from quire.operators import overlap as O
from quire.operators import paged, translate
from quire.sources import documents as D
from quire.sources import exports as X
from quire.sources import glossaries as S


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


BLOCK = "doc_id long, page_index long, block_index long, x0 double, y0 double, x1 double, y1 double, text string"


def page(spark, *rows):
    return spark.createDataFrame([(1, 0, i, *r) for i, r in enumerate(rows)], BLOCK)


@pytest.mark.parametrize("value,kind", [("", "empty"), ("  ", "empty"), ("- item", "list_item"), ("(a) item", "list_item"), ("Name: Ann", "key_value"), ("a | b | c", "table_candidate"), ("BIG TITLE", "heading"), ("A Title Here", "heading"), ("plain words that end.", "paragraph"), ("one\ttwo\tthree", "table_candidate")])
def test_structure(spark, value, kind):
    assert one(spark, classify.structure_kind(F.lit(value))) == kind


def test_layout_by_place(spark):
    box = lambda y0, y1, w=0.5: geometry.Box(F.lit(0.1), F.lit(y0), F.lit(0.1 + w), F.lit(y1))
    role = lambda t, k, b: one(spark, classify.layout_role(F.lit(t), F.lit(k), b))
    assert role("Top", "paragraph", box(0.0, 0.1)) == "header"
    assert role("12", "paragraph", box(0.9, 0.95)) == "page_number"
    assert role("note", "paragraph", box(0.9, 0.95)) == "footer"
    assert role("Figure 1", "paragraph", box(0.4, 0.5)) == "caption"
    assert role("Title", "heading", box(0.2, 0.27)) == "title_block"
    assert role("", "empty", box(0.3, 0.6)) == "figure"
    assert one(spark, classify.layout(F.lit("body"), box(0.4, 0.5, 0.2)))["region"] == "body_side"


def test_reading_order_rounds_half_to_even_and_takes_a_missing_box_first(spark):
    b = page(spark, (0.5, 0.05, 0.9, 0.1, "b"), (0.1, 0.05, 0.4, 0.1, "a"), (None, None, None, None, "n"))
    assert [r.text for r in B.reading_order(b).orderBy("reading_order").collect()] == ["n", "a", "b"]


def test_quality_and_routing(spark):
    b = page(spark, (0.0, 0.0, 0.5, 0.5, " "), (0.5, 0.5, 0.6, 0.6, None))
    r = B.routing(B.quality(b)).first()
    assert [f.code for f in r.findings] == ["empty_page", "empty_large_block"]
    assert [d.action for d in r.decisions] == ["retry_empty_page", "retry_block_or_grounded"]


def test_sections_run_over_pages(spark):
    rows = [(1, 0, 0, 0.1, 0.1, 0.5, 0.2, "text before."), (1, 0, 1, 0.1, 0.2, 0.5, 0.3, "TITLE"), (1, 1, 0, 0.1, 0.1, 0.5, 0.2, "text after.")]
    out = B.sections(B.with_structure(spark.createDataFrame(rows, BLOCK))).orderBy("page_index", "block_index").collect()
    assert [r.section_role for r in out] == ["unsectioned", "heading", "body"]
    assert [r.section_title for r in out] == [None, "TITLE", "TITLE"]


def test_boxes(spark):
    a, b = (geometry.Box(*map(F.lit, v)) for v in ((0.0, 0.0, 1.0, 1.0), (0.5, 0.0, 1.0, 1.0)))
    assert one(spark, geometry.iou(a, b)) == 0.5
    c = geometry.clamp(geometry.Box(*map(F.lit, (1.5, 0.2, 0.5, -1.0))))
    assert one(spark, F.array(c.x0, c.y0, c.x1, c.y1)) == [0.5, 0.0, 1.0, 0.2]
    px = lambda *v: one(spark, geometry.from_pixels(geometry.Box(*[F.lit(float(x)) for x in v]), F.lit(100.0), F.lit(200.0)))
    assert tuple(px(0.1, 0.1, 0.2, 0.2)) == (0.1, 0.1, 0.2, 0.2)
    assert tuple(px(10, 20, 50, 100)) == (0.1, 0.1, 0.5, 0.5)
    assert tuple(px(50, 100, 20, 40)) == (0.5, 0.5, 0.7, 0.7)
    assert px(-1, 0, 1, 1) is None
    with pytest.raises(Exception, match="outside"):
        one(spark, geometry.widen(geometry.Box(*map(F.lit, (0.0, 0.0, 2.0, 1.0)))).x1)
    assert one(spark, geometry.safe_dpi(F.lit(612.0), F.lit(792.0), F.lit(200))) == 200
    assert one(spark, geometry.safe_dpi(F.lit(90000.0), F.lit(90000.0), F.lit(200))) == 72


def test_grid_join_finds_the_same_pairs(spark, sf):
    from quire.plans import views as V

    a, b = V.candidates(spark, sf), V.boxes(spark, sf)
    keys = lambda df: sorted(tuple(r) for r in df.select("a.doc_id", "a.page_index", "a.block_index", F.col("b.block_index")).collect())
    assert keys(O.pairs(a, b)) == keys(O.pairs(a, b, grid=5))


def test_longest_band(spark):
    rows = [(1, 0, i, 0.9 if i in (2, 3, 4, 7, 8, 9) else 0.1, 100) for i in range(12)]
    out = O.longest_band(spark.createDataFrame(rows, "doc_id long, page_index long, row long, fraction double, height long")).collect()
    assert [(r.y0, r.y1) for r in out] == [(0.02, 0.05)]


def test_contracts(spark):
    b = page(spark, (0.0, 0.0, 0.1, 0.1, "a"), (0.0, 0.2, 0.1, 0.3, "b"))
    assert B.keeps(b, B.with_structure(b), "annotate_only")
    assert not B.keeps(b, b.where("text = 'a'"), "may_reorder")
    reg = B.Registry()
    reg.register("structure", lambda: B.with_structure)
    assert reg.names == ["structure"] and "kind" in B.run_processors(b, reg.create_many(["structure"]), "annotate_only").columns
    with pytest.raises(ValueError):
        reg.register("structure", lambda: B.with_structure)
    with pytest.raises(KeyError):
        reg.create("none")


def test_trust(spark):
    assert one(spark, trust.repeats(F.lit("abcabc" * 4))) and not one(spark, trust.repeats(F.lit("abcdefghijklmnopqrstuvwxyz")))
    assert one(spark, trust.trust_score(F.lit(None).cast("double"), F.lit(0), F.lit(False), F.lit(False))) == 0.0
    assert one(spark, trust.trust_flags(F.lit(0.4), F.lit(2), F.lit(True), F.lit(True))) == ["hallucination_risk", "watermark_hit", "script_mismatch", "low_calibrated_conf"]
    assert one(spark, trust.trust_flags(F.lit(0.9), F.lit(0), F.lit(False), F.lit(False))) is None
    assert one(spark, trust.calibrate(F.lit(2.0), None, None)) == 1.0
    assert [one(spark, trust.trust_bin(F.lit(x))) for x in (0.6, 1.0)] == ["0.6-0.8", "0.8-1"]


def test_texts(spark):
    assert one(spark, text.squeeze(F.lit(" a \t\n b "))) == "a b"
    assert one(spark, text.is_filler(F.lit(' "Lorem ipsum." ')))
    assert one(spark, text.strip_front_matter(F.lit("---\na: 1\n---\nbody\n"))) == "body"
    assert one(spark, text.strip_front_matter(F.lit("--- open"))) == "--- open"
    assert one(spark, text.redact_dsn(F.lit("pg://u:secret@h/db"))) == "pg://u:***@h/db"
    assert one(spark, text.language_matches(F.lit("en_US"), F.lit("EN-gb")))
    runs = one(spark, text.inline_runs(F.lit("a **b** *c* `d`")))
    assert [(r.text, r.bold, r.italic, r.code) for r in runs if r.text.strip()] == [("a ", False, False, False), ("b", True, False, False), ("c", False, True, False), ("d", False, False, True)]


def test_page_ranges(spark):
    got = lambda s: one(spark, D.page_ranges(F.lit(s)))
    assert [tuple(r) for r in got("1-3,5")] == [(1, 3), (5, 5)]
    assert got("") == [] and got("1,x") is None and got("3-1") is None and got("0") is None
    assert one(spark, D.selected_pages(F.lit("2-3,3,99"), F.lit(10))) == [1, 2]


def test_uploads_and_encodings(spark):
    assert one(spark, D.upload_suffix(F.lit(b"%PDF-1.7"))) == ".pdf"
    assert one(spark, D.decode(F.lit(b"\xef\xbb\xbfhi"))).asDict() == {"text": "hi", "encoding": "utf-8-sig"}
    assert one(spark, D.decode(F.lit(b"\xe9"))).asDict() == {"text": "é", "encoding": "latin-1"}
    assert one(spark, D.audio_status(F.lit("a.mp3"), F.lit("audio/mpeg"), F.lit(5))) == 200
    assert one(spark, D.audio_status(F.lit("a.exe"), F.lit(None), F.lit(5))) == 415
    assert one(spark, D.model_ids(F.lit('{"data": [{"id": "a"}, {"name": "b"}, {"id": "a"}]}'))) == ["a", "b"]


def test_grounded_answers(spark):
    rows = [(1, 0, 'Here:\n```json\n[{"bbox": [10, 10, 50, 50], "text": "a"}, {"bbox": [1], "text": "b"}, {"bbox": [10, 10, 50, 50]}, 5, {"bbox": [90, 90, 500, 500], "text": "c"}]\n```', 100.0, 100.0)]
    out = D.grounded_blocks(spark.createDataFrame(rows, "doc_id long, page_index long, answer string, width double, height double")).orderBy("item").collect()
    assert [r.reason for r in out] == [None, "missing_or_bad_bbox", "empty_content", "not_dict", "invalid_bbox_coords"]
    assert (out[0].x0, out[0].y1) == (0.1, 0.5)


def test_layout_answers(spark):
    payload = '{"layout_details": [[{"bbox_2d": [0, 0, 50, 50], "content": "a", "label": "text"}, {"bbox_2d": [0, 0, 1, 1], "content": "b", "label": "image"}]], "data_info": {"pages": [{"width": 100, "height": 200}]}}'
    got = one(spark, D.layout_blocks(F.lit(payload)))
    assert [(b.text, b.x1, b.y1) for b in got] == [("a", 0.5, 0.25)]


def test_transcripts(spark):
    df = spark.createDataFrame([(1, '{"segments": [{"start": 0.0, "end": 1.5, "text": " hi there "}]}'), (2, '{"text": "all"}')], "doc_id long, payload string")
    out = D.transcript_blocks(df).orderBy("doc_id").collect()
    assert [(r.text, r.duration, r.words) for r in out] == [("hi there", 1.5, 2), ("all", None, 1)]


def test_models_fail_by_row(spark):
    def model():
        return lambda x: 1 / x

    out = D.with_model(spark.createDataFrame([(1.0,), (0.0,)], "x double"), ["x"], "y", "double", model).orderBy("x").collect()
    assert out[0].y is None and "zero" in out[0].y_error and out[1].y == 1.0


def test_glossary_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Source,Target,case_sensitive,notes\ncat,chat,yes,x\n,,,\ndog,chien,,\n", encoding="utf-8")
    got = S.read(spark, "delimited", str(tmp_path / "a.csv")).orderBy("pos").collect()
    assert [(r.source, r.target, r.case_sensitive) for r in got] == [("cat", "chat", True), ("dog", "chien", False)]
    (tmp_path / "a.json").write_text('{"entries": [{"source": "a", "target": "b"}, {"source": "", "target": "c"}]}')
    assert [(r.source, r.target) for r in S.read(spark, "json", str(tmp_path / "a.json")).collect()] == [("a", "b")]
    (tmp_path / "a.xliff").write_text('<xliff><file><body><trans-unit id="1"><source>yes</source><target>oui</target></trans-unit></body></file></xliff>')
    assert [(r.source, r.target) for r in S.read(spark, "xliff", str(tmp_path / "a.xliff")).collect()] == [("yes", "oui")]
    (tmp_path / "a.tmx").write_text('<tmx><body><tu><tuv xml:lang="en-US"><seg>yes</seg></tuv><tuv xml:lang="fr"><seg>oui</seg></tuv></tu></body></tmx>')
    assert [(r.source, r.target) for r in S.read(spark, "tmx", str(tmp_path / "a.tmx")).collect()] == [("yes", "oui")]
    (tmp_path / "a.tbx").write_text('<tbx><termEntry><langSet xml:lang="en"><tig><term>yes</term></tig><tig><term>yep</term></tig></langSet><langSet xml:lang="fr"><tig><term>oui</term></tig></langSet></termEntry></tbx>')
    assert [(r.source, r.target) for r in S.read(spark, "tbx", str(tmp_path / "a.tbx")).collect()] == [("yes", "oui"), ("yep", "oui")]
    (tmp_path / "a.md").write_text("| source | target |\n|---|---|\n| cat | chat |\n- dog -> chien\n")
    assert sorted((r.source, r.target) for r in S.read(spark, "text", str(tmp_path / "a.md")).collect()) == [("cat", "chat"), ("dog", "chien")]
    with pytest.raises(ValueError):
        S.read(spark, "nope", "x")
    with pytest.raises(ValueError):
        S.read(spark, "json", str(tmp_path / "a.json"), max_entries=0)


def test_predicates_reach_the_scan_and_reject_the_rest(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (None, "b")], "n int, s string")
    assert S.where(df, "n != NULL").count() == 1
    assert S.where(df, "n >= 1 AND s LIKE 'a%'").count() == 1
    for bad in ("n = 1 OR s = 'a'", "n = 1; DROP", "other = 1", "n = 1 AND"):
        with pytest.raises(ValueError):
            S.where(df, bad)


def test_library_round_trip_and_migration(spark, tmp_path):
    lib = tmp_path / "lib.json"
    lib.write_text('{"id": "g", "name": "G", "entries": [{"source": "a", "target": "b"}]}\nnot json\n')
    assert S.read_library(spark, str(lib)).count() == 1
    assert S.migrate(spark, str(lib), str(tmp_path / "store"), dry_run=True) == {"glossaries": 1, "entries": 1}
    S.migrate(spark, str(lib), str(tmp_path / "store"))
    with pytest.raises(Exception, match="exist"):
        S.migrate(spark, str(lib), str(tmp_path / "store"))


def test_glossary_order(spark):
    g = spark.createDataFrame([("a", "A", "x", 1), ("b", "B", "x", 5), ("c", "C", "x", 3)], "id string, name string, grp string, priority int")
    got = {r.id: r.priority for r in G.reorder(g, ["c"]).collect()}
    assert got == {"c": 3, "b": 2, "a": 1}
    assert {r.id: r.priority for r in G.reorder(g, ["a"], strict=False).collect()} == {"a": 1, "b": 5, "c": 3}
    with pytest.raises(ValueError):
        G.reorder(g, ["a", "a"])


def test_prompt_block_is_longest_first(spark):
    e = spark.createDataFrame([("g", 0, "a", "b"), ("g", 1, "abc", "d")], "glossary_id string, pos long, source string, target string")
    assert G.prompt_block(e, ["glossary_id"]).first().block.split("\n")[1:] == ["- abc -> d", "- a -> b"]


def test_entities(spark):
    e = one(spark, translate.entities(F.lit("We met Ann Lee and the NATO team on 2024-01-09, near Paris.")))
    assert e.names == ["Ann Lee", "Paris"] and e.dates == ["2024-01-09"] and e.acronyms == ["NATO"]


def test_refine_repeats_only_what_was_rejected(spark):
    df = spark.createDataFrame([("a long source text", "", 0, "")], "source string, translated string, attempts int, context string")
    seen = []

    def run(d):
        seen.append(1)
        return d.withColumn("translated", F.when(F.col("attempts") > 0, "a good translation").otherwise("x"))

    out = translate.refine(df, run).collect()
    assert [r.attempts for r in out] == [2]


def test_exports(spark):
    nodes = page(spark, (0.1, 0.1, 0.5, 0.2, "a <b>"), (0.1, 0.2, 0.5, 0.3, "x"), (0.1, 0.3, 0.5, 0.4, "y"))
    kind = F.when(F.col("block_index") > 0, "list_item").otherwise("paragraph")
    n = nodes.withColumn("node_type", kind)
    n = n.withColumn("html", X.render_block(F.col("node_type"), F.col("text"), F.lit("id"), [F.col(c) for c in ("x0", "y0", "x1", "y1")]))
    body = X.html(n).first().body
    assert "a &lt;b&gt;" in body and body.count("<ul>") == 1 and body.index("<ul>") < body.index(">x<") < body.index(">y<") < body.index("</ul>")
    cells = spark.createDataFrame([(1, 0, 0, "h"), (1, 1, 0, "c")], "t long, row_index long, column_index long, text string")
    assert X.table_html(cells, ["t"]).first().html == "<table>\n<tr><th>h</th></tr>\n<tr><td>c</td></tr>\n</table>"
    with pytest.raises(ValueError):
        X.export(nodes, "pdf")
    with pytest.raises(Exception, match="finite"):
        one(spark, X.finite(F.lit(float("nan"))))


def test_jobs(spark):
    assert one(spark, J.clean_failed_pages(F.array(*map(F.lit, (3, -1, 3, 2))))) == [3, 2]
    assert one(spark, J.stage_percent(F.lit(1), F.lit(3), 10, 40)) == 20
    t = spark.createDataFrame([(1, 1, "a"), (2, 2, "b")], "id long, seq long, v string")
    new = spark.createDataFrame([(1, 3, "c")], "id long, seq long, v string")
    assert sorted((r.id, r.v) for r in J.upsert(t, new, "id", "seq", 1).collect()) == [(1, "c")]


def test_empty_tables(spark):
    b = spark.createDataFrame([], BLOCK)
    for f in (B.reading_order, B.page_text, B.quality, B.with_structure, paged.column_order, paged.table_cells, paged.cross_page_merge, lambda d: B.sections(B.with_structure(d))):
        assert f(b).count() == 0
