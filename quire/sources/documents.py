"""Readers of model output, ground truth, transcripts and uploads; page ranges."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.geometry import Box, from_pixels
from quire.functions.text import squeeze, strip
from quire.operators.kernels import SPACE


def page_ranges(spec: Column) -> Column:
    """Inclusive ranges of ``1-3,5``; blank is empty, one bad token makes all null (SRC-05)."""
    tokens = F.transform(F.split(spec, ","), squeeze)
    ok = F.forall(tokens, lambda t: t.rlike(r"^\d{1,9}(\s*-\s*\d{1,9})?$"))
    part = lambda t, k: F.get(F.split(t, r"\s*-\s*"), F.lit(k)).cast("int")
    ranges = F.transform(tokens, lambda t: F.struct(part(t, 0).alias("first"), F.coalesce(part(t, 1), part(t, 0)).alias("last")))
    sane = F.forall(ranges, lambda r: (r["first"] >= 1) & (r["last"] >= r["first"]))
    empty = F.array().cast("array<struct<first:int,last:int>>")
    return F.when(squeeze(spec) == "", empty).when(ok & sane, ranges)


def selected_pages(spec: Column, total: Column) -> Column:
    """Sorted distinct pages from 0, those out of range left out; an invalid range raises (SRC-06)."""
    ranges = page_ranges(spec)
    bad = F.raise_error(F.lit("bad page range")).cast("array<int>")
    pages = F.flatten(F.transform(ranges, lambda r: F.when(r["first"] <= total, F.sequence(r["first"], F.least(r["last"], total))).otherwise(F.array().cast("array<int>"))))
    return F.when(ranges.isNull(), bad).otherwise(F.transform(F.array_sort(F.array_distinct(pages)), lambda p: p - 1))


def batches(pages: DataFrame, size: int = 8) -> DataFrame:
    """Number of the batch of each page (SRC-02): pages of a document in order, ``size`` to a batch."""
    from pyspark.sql.window import Window

    k = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_index")) - 1
    return pages.withColumn("batch", F.floor(k / size))


def layout_blocks(payload: Column, page: int = 0) -> Column:
    """Blocks of a layout answer: nested or flat, divided by page size and clamped (SRC-09)."""
    item = "struct<bbox_2d:array<double>,content:string,label:string>"
    size = "data_info struct<pages:array<struct<width:double,height:double>>>"
    nested = F.from_json(payload, f"layout_details array<array<{item}>>, {size}")
    flat = F.from_json(payload, f"layout_details array<{item}>, {size}")
    rows = F.coalesce(F.when(F.size(F.flatten(nested["layout_details"])) > 0, nested["layout_details"]), F.array(flat["layout_details"]))
    dims = F.coalesce(nested["data_info"]["pages"], flat["data_info"]["pages"])
    dims = F.when(dims.isNull(), F.raise_error(F.lit("data_info.pages is missing")).cast("array<struct<width:double,height:double>>")).otherwise(dims)

    def block(i: Column, x: Column) -> Column:
        w, h = F.get(dims, i)["width"], F.get(dims, i)["height"]
        side = lambda k, s: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x["bbox_2d"][k] / s))
        return F.struct((i + page).alias("page_index"), side(0, w).alias("x0"), side(1, h).alias("y0"), side(2, w).alias("x1"), side(3, h).alias("y1"), x["content"].alias("text"), x["label"].alias("label"))

    keep = lambda x: ~F.coalesce(x["label"].isin("image", "figure", "seal", "chart"), F.lit(False)) & (strip(F.coalesce(x["content"], F.lit(""))) != "")
    return F.flatten(F.transform(rows, lambda p, i: F.transform(F.filter(p, keep), lambda x: block(i, x))))


BOX_KEYS, TEXT_KEYS = ("bbox", "bbox_2d", "box", "bounding_box", "coordinates"), ("text", "content", "text_content", "value")


def grounded_items(answer: str) -> list[dict]:
    """Items (bbox, text, label, reason) of the JSON in a model's answer (SRC-08)."""
    from quire.operators.kernels import find_json

    v = find_json(answer)
    if isinstance(v, dict):
        v = next((v[k] for k in ("results", "blocks", "layout", "layout_details", "items") if isinstance(v.get(k), list)), [v])
    out = []
    for x in v or []:
        if not isinstance(x, dict):
            out.append({"reason": "not_dict"})
            continue
        b = next((x[k] for k in BOX_KEYS if isinstance(x.get(k), list) and len(x[k]) == 4), None)
        t = next((x[k] for k in TEXT_KEYS if isinstance(x.get(k), str) and x[k].strip(SPACE)), None)
        try:
            b = [float(c) for c in b] if b else None
        except (TypeError, ValueError):
            b = None
        out.append({"bbox": b, "text": t, "label": x.get("label"), "reason": "missing_or_bad_bbox" if b is None else "empty_content" if t is None else None})
    return out


def placed_boxes(items: DataFrame, *more: str) -> DataFrame:
    """Items with their boxes in fractions of the page, and the reason where they are dropped."""
    at = lambda i: F.get("bbox", F.lit(i))
    got = items.withColumn("box", from_pixels(Box(at(0), at(1), at(2), at(3)), F.col("width"), F.col("height")))
    bad = F.when(F.col("box").isNull() & F.col("item").isNotNull(), "invalid_bbox_coords")
    return got.select("doc_id", "page_index", "item", "box.*", "text", "label", F.coalesce("reason", bad).alias("reason"), *more)


def grounded_blocks(answers: DataFrame) -> DataFrame:
    """Blocks of a model's JSON answers, and the reason where an item is dropped (SRC-08, PRJ-04).

    ``answers``: doc_id, page_index, answer, width, height. Only finding the JSON in prose is Python; the boxes are
    normalised by expressions.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in parts:
            found = [(r.doc_id, r.page_index, i, r.width, r.height, x.get("bbox"), x.get("text"), x.get("label"), x.get("reason")) for r in t.itertuples() for i, x in enumerate(grounded_items(r.answer or ""))]
            yield pd.DataFrame(found, columns=["doc_id", "page_index", "item", "width", "height", "bbox", "text", "label", "reason"])

    kind = "doc_id long, page_index long, item long, width double, height double, bbox array<double>, text string, label string, reason string"
    slim = answers.select("doc_id", "page_index", "answer", F.col("width").cast("double"), F.col("height").cast("double"))
    return placed_boxes(slim.mapInPandas(run, kind))


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of ground-truth files in fractions of their page (SRC-26)."""
    item = "struct<block_content:string,bbox:array<double>,block_id:int,page_index:int,block_label:string,score:double>"
    df = spark.read.schema(f"data struct<file_name:string,layout:array<{item}>,data_info:struct<pages:array<struct<width:double,height:double>>>>").json(path, multiLine=True)
    b = df.select("data.file_name", "data.data_info.pages", F.explode("data.layout").alias("b"))
    page = F.get("pages", F.coalesce("b.page_index", F.lit(0)))
    side = lambda i, s: (F.col("b.bbox")[i] / page[s])
    drop = F.coalesce(F.col("b.block_label").isin("diagram", "diagram_node", "signature_line", "empty_line", "list_marker"), F.lit(False))
    return b.where(~drop).select("file_name", "b.page_index", "b.block_id", side(0, "width").alias("x0"), side(1, "height").alias("y0"), side(2, "width").alias("x1"), side(3, "height").alias("y1"), F.col("b.block_content").alias("text"), F.col("b.block_label").alias("label"))


def transcript_blocks(df: DataFrame) -> DataFrame:
    """Blocks of speech from verbose JSON (SRC-23, SRC-24). ``df``: doc_id, payload."""
    p = F.from_json("payload", "text string, language string, segments array<struct<start:double,end:double,text:string>>")
    seg = df.select("doc_id", p.alias("p")).select("doc_id", "p.text", F.posexplode_outer("p.segments").alias("i", "s"))
    text = strip(F.coalesce("s.text", "text", F.lit("")))
    return seg.select(
        "doc_id", F.lit(0).cast("long").alias("page_index"), F.coalesce("i", F.lit(0)).cast("long").alias("block_index"), F.lit("speech").alias("kind"), text.alias("text"),
        F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.round(F.col("s.end") - F.col("s.start"), 3).alias("duration"), F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).alias("words"),
    ).where("text <> ''")


# Audio kinds that are accepted.
AUDIO = [".mp3", ".wav", ".m4a", ".ogg", ".flac", ".webm", ".mp4", ".mpeg", ".mpga"]


def audio_status(name: Column, content_type: Column, size: Column, most: int = 25 << 20) -> Column:
    """200, or 400, 413, 415 for an empty, too large or unknown upload (SRC-25)."""
    known = F.lit(False)
    for e in AUDIO:
        known = known | F.lower(name).endswith(e)
    typed = content_type.isNull() | content_type.startswith("audio/") | content_type.isin("video/mp4", "video/webm", "application/octet-stream")
    return F.when(F.coalesce(name, F.lit("")) == "", 400).when(~known | ~typed, 415).when(size == 0, 400).when(size > most, 413).otherwise(200)


def upload_suffix(header: Column) -> Column:
    """File kind by its first bytes, in this order (SRC-30)."""
    h = F.hex(F.substring(header, 1, 16))
    return (
        F.when(h.startswith("25504446"), ".pdf").when(h.startswith("89504E470D0A1A0A"), ".png").when(h.startswith("FFD8FF"), ".jpg")
        .when(h.startswith("49492A00") | h.startswith("4D4D002A"), ".tiff").when(h.startswith("424D"), ".bmp")
        .when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), ".webp").when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57415645"), ".wav")
        .when(h.startswith("494433") | h.rlike("^FF[EF][2-7A-F]"), ".mp3").when(h.startswith("664C6143"), ".flac").when(h.startswith("4F676753"), ".ogg")
        .when(F.substring(h, 9, 8) == "66747970", ".m4a").when(h.startswith("1A45DFA3"), ".webm")
    )


def decode(data: Column) -> Column:
    """struct(text, encoding): UTF-8 with or without mark, else Latin-1 (SRC-21)."""
    mark = F.hex(F.substring(data, 1, 3)) == "EFBBBF"
    body = F.when(mark, F.substring(data, 4, 2_000_000_000)).otherwise(data)
    row = lambda t, e: F.struct(t.alias("text"), F.lit(e).alias("encoding"))
    good = F.is_valid_utf8(body.cast("string"))
    return F.when(good & mark, row(body.cast("string"), "utf-8-sig")).when(good, row(body.cast("string"), "utf-8")).otherwise(row(F.decode(data, "ISO-8859-1"), "latin-1"))


def model_ids(payload: Column) -> Column:
    """Distinct ids in order of a list of models in any of its known shapes (SRC-29)."""
    kind = "array<struct<id:string,name:string,model:string,model_id:string,display_name:string>>"
    wrapped = F.from_json(payload, f"data {kind}, models {kind}, items {kind}, results {kind}")
    rows = F.coalesce(wrapped["data"], wrapped["models"], wrapped["items"], wrapped["results"], F.from_json(payload, kind))
    names = F.from_json(payload, "data array<string>, models array<string>")
    first = lambda r: F.coalesce(*[F.nullif(strip(r[k]), F.lit("")) for k in ("id", "name", "model", "model_id", "display_name")])
    got = F.array_compact(F.transform(rows, first))
    plain = F.filter(F.coalesce(names["data"], names["models"], F.from_json(payload, "array<string>")), lambda x: ~x.startswith("{"))
    return F.array_distinct(F.when(F.size(got) > 0, got).otherwise(F.coalesce(plain, F.array().cast("array<string>"))))


def calibration_records(df: DataFrame) -> DataFrame:
    """Grades 1 to 4 as targets, malformed records dropped (MATH-09). ``df``: raw_confidence, quality_score; other columns stay."""
    target = F.element_at(F.array(*[F.lit(x) for x in (0.90, 0.65, 0.30, 0.10)]), F.col("quality_score").cast("int"))
    ok = F.col("raw_confidence").between(0, 1) & F.col("quality_score").isin(1, 2, 3, 4)
    rest = [F.col(f"`{c}`") for c in df.columns if c not in ("raw_confidence", "quality_score", "raw", "target")]
    return df.where(ok).select(*rest, F.col("raw_confidence").alias("raw"), target.alias("target"))


# --- seams: what the caller injects


def decode_pages(spark: SparkSession, path: str, decoder: Callable[[bytes], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """Pages of binary files by an injected decoder (SRC-01); a file that fails gives one row with its error.

    Pages leave in frames of up to 10,000 or some 16 MB, as a frame of its own costs more than a small page.
    """

    def pages(parts: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for t in parts:
            for p, data in zip(t["path"], t["content"]):
                try:
                    for i, image in decoder(data):
                        yield p, i, image, None
                except Exception as e:  # a bad file must not fail the others
                    yield p, -1, None, str(e)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for page in pages(parts):
            held.append(page)
            size += len(page[2] or b"")
            if len(held) == 10_000 or size > 1 << 24:
                yield pd.DataFrame(held, columns=["path", "page_index", "image", "error"])
                held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=["path", "page_index", "image", "error"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, page_index int, image binary, error string")


def with_model(df: DataFrame, inputs: list[str], output: str, kind: str, model: Callable[[], Callable]) -> DataFrame:
    """A column by an injected model, made once per Python worker; its failures land in ``<output>_error``.

    The seam of recognisers, translators, embedders, judges and crops (EXT-*, UDF-05, UDF-10).
    """
    return with_models(df, inputs, {output: (kind, model)})


def with_models(df: DataFrame, inputs: list[str], models: dict[str, tuple[str, Callable[[], Callable]]]) -> DataFrame:
    """``with_model`` for several models (output: type, model) of the same inputs, which share a Python worker: one each would stay up at once."""

    @F.pandas_udf(", ".join(f"`{name}` {kind}, `{name}_error` string" for name, (kind, _) in models.items()))
    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        made = {name: model() for name, (_, model) in models.items()}
        for cols in parts:
            cols, out = cols if isinstance(cols, tuple) else (cols,), {}
            for name, f in made.items():
                values, errors = [], []
                for row in zip(*cols):
                    value = error = None
                    try:
                        value = f(*row)
                    except Exception as e:  # an error is a value here, not a lost task
                        error = str(e)
                    values.append(value)
                    errors.append(error)
                out |= {name: values, f"{name}_error": errors}
            yield pd.DataFrame(out)

    tmp = df.withColumn("_m", run(*[F.col(c) for c in inputs]))
    return tmp.withColumns({c: F.col(f"_m.`{c}`") for name in models for c in (name, f"{name}_error")}).drop("_m")


def detect(pages: DataFrame, detector: Callable[[], Callable[[list], list]], tries: int = 4) -> DataFrame:
    """Boxes of pages (doc_id, page_index, batch, image, width, height) by an injected detector of whole batches (EXT-01).

    A batch of a document goes to the detector at once. One whose answer hasn't a list for each page, or that fails, gives its
    pages no boxes and ``fault``; one without a single box is tried again, as a detector that has just started may see nothing. What
    comes back is put in fractions of the page and in order by expressions.
    """
    from quire.functions.geometry import detected_boxes

    def usable(b) -> bool:
        return b is not None and len(b) == 4 and all(v is not None and math.isfinite(v) for v in b) and b[2] > b[0] and b[3] > b[1]

    def run(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = detector()
        for g in groups:
            out, faults, times = [], [], []
            for images in g.column("images").to_pylist():
                found, fault, n = [None] * len(images), None, 0
                try:
                    while n < tries:
                        n += 1
                        found = [None if b is None else [[None if v is None else float(v) for v in x] for x in b] for b in f(images)]
                        if len(found) != len(images):
                            found, fault = [None] * len(images), "predictions_mismatch"
                        if fault or any(usable(x) for b in found for x in b or []):
                            break
                except Exception as e:  # a failing batch must not fail the others
                    found, fault = [None] * len(images), str(e)
                out.append(found)
                faults.append(fault)
                times.append(n)
            kinds = (pa.list_(pa.list_(pa.list_(pa.float64()))), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([*(g.column(c) for c in ("doc_id", "batch", "pages")), *(pa.array(c, k) for c, k in zip((out, faults, times), kinds))], names=["doc_id", "batch", "pages", "found", "fault", "tries"])

    one = F.struct("page_index", "width", "height", "image")
    groups = pages.groupBy("doc_id", "batch").agg(F.sort_array(F.collect_list(one)).alias("g"))
    page = "struct<page_index:bigint,width:double,height:double>"
    groups = groups.select("doc_id", F.col("batch").cast("long"), F.transform("g", lambda r: F.struct(r["page_index"].cast("long").alias("page_index"), r["width"].cast("double").alias("width"), r["height"].cast("double").alias("height"))).alias("pages"), F.transform("g", lambda r: r["image"]).alias("images"))
    got = groups.mapInArrow(run, f"doc_id long, batch long, pages array<{page}>, found array<array<array<double>>>, fault string, tries long")
    rows = got.select("doc_id", "fault", "tries", F.inline(F.arrays_zip("pages", "found"))).select("doc_id", "pages.*", "found", "fault", "tries")
    placed = rows.withColumn("_d", detected_boxes(F.col("found"), F.col("width"), F.col("height")))
    return placed.select("doc_id", "page_index", "_d.boxes", "_d.nan", "_d.inf", "fault", "tries")
