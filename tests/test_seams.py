"""Detector post-processing, cross-checks and JSON values against plain Python."""

import json
import math

import pytest
from pyspark.sql import functions as F

from quire.functions import trust
from quire.functions.geometry import detected_boxes
from quire.sources import documents as D
from quire.sources import exports as X

NAN, INF = float("nan"), float("inf")


def test_boxes_of_a_detector(spark):
    def plain(boxes, w, h):
        nan = inf = 0
        out = []
        for b in boxes or []:
            if any(v is not None and math.isnan(v) for v in b):
                nan += 1
            elif any(v is not None and math.isinf(v) for v in b):
                inf += 1
            elif len(b) == 4 and None not in b:
                x0, y0, x1, y1 = (min(1.0, max(0.0, v / s)) for v, s in zip(b, (w, h, w, h)))
                if x1 > x0 and y1 > y0:
                    out.append((x0, y0, x1, y1))
        return sorted(out, key=lambda b: (b[1], b[0], b[2], b[3])), nan, inf

    rows = [
        (1, [[10.0, 20.0, 30.0, 40.0], [5.0, 20.0, 30.0, 40.0], [0.0, 0.0, 500.0, 10.0]]), (2, [[NAN, 0.0, INF, 1.0], [0.0, INF, 1.0, 2.0], [0.0, -INF, 1.0, NAN]]), (3, None), (4, []),
        (5, [[30.0, 0.0, 10.0, 5.0], [-9.0, -9.0, 5.0, 5.0], [200.0, 0.0, 300.0, 5.0], [1.0, 1.0, 1.0, 5.0]]), (6, [[1.0, 2.0, 3.0], [None, 1.0, 2.0, 3.0], []]), (7, [[1.0, 1.0, 2.0, 2.0]] * 2),
    ]
    df = spark.createDataFrame([(i, b, 100.0, 50.0) for i, b in rows], "i int, boxes array<array<double>>, w double, h double")
    got = {r.i: ([tuple(b) for b in r.d.boxes], r.d.nan, r.d.inf) for r in df.select("i", detected_boxes(F.col("boxes"), F.col("w"), F.col("h")).alias("d")).collect()}
    assert got == {i: plain(b, 100.0, 50.0) for i, b in rows}


def test_detection_of_batches(spark):
    pages = [(d, p, p // 2, f"{d}.{p}", 10.0, 10.0) for d in range(6) for p in range(4)]
    df = spark.createDataFrame(pages, "doc_id long, page_index long, batch long, image string, width double, height double")

    def detector():
        calls = {}

        def f(images):
            assert 1 <= len(images) <= 2
            doc = images[0][0]
            calls[images[0]] = calls.get(images[0], 0) + 1
            if doc == "1":
                return [[[0, 0, 5, 5]]]  # one short, or long
            if doc == "2":
                raise RuntimeError("broken")
            if doc == "3":
                return [[[NAN, 0, 1, 1]]] * len(images) if calls[images[0]] < 3 else [[[1, 1, 2, 2]], None]
            if doc == "4":
                return [[] for _ in images]
            return [[[0, 0, 5, 5]] for _ in images]

        return f

    got = {(r.doc_id, r.page_index): (len(r.boxes), r.nan, r.fault, r.tries) for r in D.detect(df, detector).collect()}
    assert got[0, 0] == (1, 0, None, 1) and len(got) == 24
    assert {got[1, p] for p in range(4)} == {(0, 0, "predictions_mismatch", 1)}
    assert {got[2, p] for p in range(4)} == {(0, 0, "broken", 1)}
    assert [got[3, p] for p in range(4)] == [(1, 0, None, 3), (0, 0, None, 3)] * 2
    assert {got[4, p] for p in range(4)} == {(0, 0, None, 4)}


@pytest.mark.parametrize("level,text,second,error,want", [
    (0, "same text", "same text", None, 0), (0, "same text", "other words", None, 2), (2, "same text", "", None, 3), (0, "same text", None, "timeout", 1),
    (2, "same text", None, "timeout", 2), (0, "same text", None, None, 1), (2, " ", "x", None, 0), (0, None, None, "e", 0), (0, "abcdefghij", "abcdefXXXX", None, 0), (0, "abcdefghij", "abcdeXXXXX", None, 2),
])
def test_cross_check(spark, level, text, second, error, want):
    df = spark.createDataFrame([(level, text, second, error)], "level int, text string, second string, error string")
    assert df.select(trust.cross_checked(*[F.col(c) for c in df.columns])).first()[0] == want


def test_json_values_deep_inside(spark):
    kind = "i int, v struct<a:array<map<string,double>>,b:float,c:string,d:array<struct<x:double>>>"
    rows = [(1, ([{"k": 1.5}], 2.5, "s", [(0.5,)])), (2, ([{"k": 1.0, "l": NAN}], 0.0, None, None)), (3, (None, INF, None, [])), (4, ([], None, None, [(1.0,), (-INF,)])), (5, None)]
    got = {r.i: (r.json, r.fault) for r in X.safe_json(spark.createDataFrame(rows, kind), "v").collect()}
    assert json.loads(got[1][0]) == {"a": [{"k": 1.5}], "b": 2.5, "c": "s", "d": [{"x": 0.5}]} and got[1][1] is None
    assert {got[i] for i in (2, 3, 4)} == {(None, "number is not finite")}
    assert got[5] == (None, None)
    for bad in ("binary('x')", "current_timestamp()", "map(1, 2)", "array(struct(current_date() AS d))"):
        with pytest.raises(TypeError):
            X.safe_json(spark.range(1).selectExpr(f"{bad} AS v"), "v")


def test_crops(spark):
    import numpy as np

    from quire.operators import crops

    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (30, 50)).astype(np.uint8)
    image[:10] = 7
    boxes = [(0, 0.0, 0.0, 1.0, 0.3), (1, 0.2, 0.5, 0.4, 0.9), (2, 0.5, 0.5, 0.5, 0.5), (3, -1.0, 0.9, 2.0, 3.0), (4, 0.9, 0.9, 0.1, 0.1), (5, 0.4, 0.3, 0.43, 0.6)]
    pages = spark.createDataFrame([(1, 0, 50, 30, bytearray(image.tobytes())), (2, 0, 1, 1, bytearray(b"x"))], "doc_id long, page_index long, width long, height long, gray binary")
    b = spark.createDataFrame([(1, 0, *x) for x in boxes] + [(9, 9, 0, 0.0, 0.0, 1.0, 1.0)], "doc_id long, page_index long, block_index long, x0 double, y0 double, x1 double, y1 double")
    got = {r.block_index: r for r in crops.crop_boxes(pages, b).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 5}
    for k, x0, y0, x1, y1 in boxes:
        l, t, r, d = (int(max(0.0, x0 - 0.005) * 50), int(max(0.0, y0 - 0.005) * 30), int(min(1.0, x1 + 0.005) * 50), int(min(1.0, y1 + 0.005) * 30))
        part = image[t:d, l:r] if r > l and d > t else np.empty(0)
        if not part.size:
            assert (got[k].deviation, got[k].crop) == (None, None)
            continue
        assert abs(got[k].deviation - part.std()) < 1e-9
        assert (got[k].crop is None) == (part.std() < 12) and (got[k].crop is None or bytes(got[k].crop) == part.tobytes())
    assert got[0].crop is None and got[1].crop is not None
    scale = min(16.0, max(256 / 11, 256 / 13))
    assert (got[1].to_width, got[1].to_height) == (int((got[1].right - got[1].left) * min(16.0, max(256 / (got[1].right - got[1].left), 256 / (got[1].bottom - got[1].top)))), int((got[1].bottom - got[1].top) * min(16.0, scale)))
    rows = spark.createDataFrame([(0.05, 3.0), (0.005, 3.0), (0.1, 3.0), (0.05, 1.5), (0.05, 12.0), (None, 3.0)], "ink double, stroke double")
    assert [r[0] for r in rows.select(crops.handwritten(F.col("ink"), F.col("stroke"))).collect()] == [True, False, False, False, False, False]


def test_many_small_pages_leave_in_few_frames(spark, tmp_path):
    import time

    for name, n in (("good", 100_000), ("bad", 3)):
        (tmp_path / name).write_bytes(b"\n".join(b"%d" % i for i in range(n)))

    def decoder(data):
        yield from enumerate(data.split(b"\n"))
        if len(data) < 10:
            raise ValueError("broken")

    began = time.time()
    rows = D.decode_pages(spark, str(tmp_path), decoder).groupBy(F.element_at(F.split("path", "/"), -1).alias("file"), "error").agg(F.count("*"), F.sum(F.col("image").cast("string").cast("long") - F.col("page_index"))).collect()
    assert sorted(map(tuple, rows), key=str) == [("bad", "broken", 1, None), ("bad", None, 3, 0), ("good", None, 100_000, 0)]
    assert time.time() - began < 30


def test_crops_of_many_pages_leave_together(spark):
    from pyspark.sql import functions as F

    from quire.operators import crops

    pages = spark.range(600).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("page_index"), F.lit(2).alias("width"), F.lit(2).alias("height"), F.unhex(F.lit("00ff00ff")).alias("gray")).coalesce(1)
    b = pages.select("doc_id", "page_index", F.explode(F.expr("array(0L, 1L)")).alias("block_index"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(1.0).alias("x1"), F.lit(1.0).alias("y1"))
    got = crops.crop_boxes(pages, b)
    assert got.select("doc_id", "block_index").distinct().count() == 1200 and got.where("hex(crop) = '00FF00FF' and deviation = 127.5").count() == 1200


def test_models_share_a_worker(spark):
    from quire.sources import documents as D

    def fails():
        def f(t):
            raise ValueError(f"no {t}")

        return f

    df = spark.createDataFrame([("ab",), (None,)], "text string").coalesce(1)
    out = D.with_models(df, ["text"], {"n": ("int", lambda: lambda t: len(t)), "v": ("array<double>", lambda: lambda t: [1.0]), "bad": ("string", fails)})
    assert out.columns == ["text", "n", "n_error", "v", "v_error", "bad", "bad_error"]
    rows = out.collect()
    assert tuple(rows[0]) == ("ab", 2, None, [1.0], None, None, "no ab") and rows[1].n is None and rows[1].n_error and rows[1].v == [1.0]
    assert out._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count("ArrowEvalPython") == 1
