"""Crops of page images for a reader: padded rectangles, blank ones left out (EXT-07), and the handwriting rule (EXT-14).

A page's image goes to Python once, with all its boxes; sums of its pixels and their squares give every box's deviation.
Resizing and encoding stay with the caller: a crop comes as grey bytes with the size it should be brought to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.blocks import PAGE

PADDING, LEAST_SIDE, MOST_SCALE, BLANK = 0.005, 256, 16.0, 12.0
CROP = pa.schema([
    ("doc_id", pa.int64()), ("page_index", pa.int64()), ("block_index", pa.int64()), ("left", pa.int64()), ("top", pa.int64()), ("right", pa.int64()), ("bottom", pa.int64()),
    ("deviation", pa.float64()), ("crop", pa.binary()), ("to_width", pa.int64()), ("to_height", pa.int64()),
])
CROP_DDL = "doc_id long, page_index long, block_index long, left long, top long, right long, bottom long, deviation double, crop binary, to_width long, to_height long"


def rectangles(boxes: np.ndarray, width: int, height: int, padding: float = PADDING) -> np.ndarray:
    """Pixel rectangles of boxes in fractions, padded and cut at the page's edges; toward zero, as integers are."""
    low, high = np.maximum(0.0, boxes[:, :2] - padding), np.minimum(1.0, boxes[:, 2:] + padding)
    return (np.concatenate([low, high], axis=1) * [width, height, width, height]).astype(np.int64)


def deviations(gray: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Standard deviation of the pixels in each rectangle, NaN where it has none."""
    sums = []
    for values in (gray.astype(np.int64), gray.astype(np.int64) ** 2):
        total = np.zeros((gray.shape[0] + 1, gray.shape[1] + 1), np.int64)
        total[1:, 1:] = values.cumsum(axis=0).cumsum(axis=1)
        x0, y0, x1, y1 = where.T
        sums.append(total[y1, x1] - total[y0, x1] - total[y1, x0] + total[y0, x0])
    n = np.maximum(0, where[:, 2] - where[:, 0]) * np.maximum(0, where[:, 3] - where[:, 1])
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(n > 0, np.sqrt((n * sums[1] - sums[0] ** 2).astype(float)) / n, np.nan)


def crop_boxes(pages: DataFrame, boxes: DataFrame, padding: float = PADDING, least_side: int = LEAST_SIDE, blank: float = BLANK) -> DataFrame:
    """A row per box: its rectangle, deviation, and ``crop`` with the size to bring it to; null where it is empty or blank.

    ``pages``: doc_id, page_index, width, height, gray (a byte a pixel, row by row). ``boxes``: doc_id, page_index, block_index, x0,
    y0, x1, y1. A box without a page is left out; an image of another size than stated fails.
    """
    box = F.struct("block_index", F.array("x0", "y0", "x1", "y1").alias("box"))
    lists = boxes.groupBy(*PAGE).agg(F.sort_array(F.collect_list(box)).alias("boxes"))
    met = pages.select(*PAGE, F.col("width").cast("int"), F.col("height").cast("int"), "gray").join(lists, list(PAGE))

    def cut(page: dict, out: dict[str, list]) -> int:
        """The rows of a page's boxes; the size of their crops."""
        width, height = page["width"], page["height"]
        gray, size = np.frombuffer(page["gray"], np.uint8).reshape(height, width), 0
        where = rectangles(np.array([x["box"] for x in page["boxes"]], float), width, height, padding)
        for x, (l, t, r, d), dev in zip(page["boxes"], where.tolist(), deviations(gray, where).tolist()):
            crop = to = None
            if dev == dev and not (blank > 0 and dev < blank):
                w, h = r - l, d - t
                scale = min(MOST_SCALE, max(least_side / w, least_side / h)) if min(w, h) < least_side else 1.0
                crop, to = gray[t:d, l:r].tobytes(), (int(w * scale), int(h * scale))
                size += len(crop)
            row = (page["doc_id"], page["page_index"], x["block_index"], l, t, r, d, dev if dev == dev else None, crop, *(to or (None, None)))
            for values, v in zip(out.values(), row):
                values.append(v)
        return size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            out, size = {c: [] for c in CROP.names}, 0
            for row in range(b.num_rows):
                size += cut({c: b.column(c)[row].as_py() for c in b.schema.names}, out)
                if size > 1 << 24 or row == b.num_rows - 1:  # a batch of its own costs more than a small page
                    yield pa.RecordBatch.from_pydict(out, schema=CROP)
                    out, size = {c: [] for c in CROP.names}, 0

    return met.mapInArrow(run, CROP_DDL)


def handwritten(ink: Column, stroke: Column) -> Column:
    """Little ink in strokes of middling width (EXT-14); what can't be measured isn't."""
    return F.coalesce((ink > 0.005) & (ink < 0.10) & (stroke > 1.5) & (stroke < 12.0), F.lit(False))
