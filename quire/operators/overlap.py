"""Joins of boxes. The page is always an equi key; a hot page is dealt by cells of a grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.geometry import Box, intersects, iou, overlap
from quire.operators.blocks import PAGE


def pairs(a: DataFrame, b: DataFrame, grid: int | None = None) -> DataFrame:
    """Overlapping pairs of the same page, columns a.* and b.* (JN-07).

    With ``grid`` the join is on page and grid cell; each pair is kept in the cell of its upper left corner
    only. For pages with many boxes, where page alone would compare all with all.
    """
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in PAGE]
    if not grid:
        return a.alias("a").join(b.alias("b"), on + [intersects(Box.of("a"), Box.of("b"))])

    def cells(df: DataFrame) -> DataFrame:
        span = lambda lo, hi: F.sequence(F.floor(F.col(lo) * grid), F.floor(F.col(hi) * grid))
        return df.withColumn("cx", F.explode(span("x0", "x1"))).withColumn("cy", F.explode(span("y0", "y1")))

    x, y = F.greatest("a.x0", "b.x0"), F.greatest("a.y0", "b.y0")
    home = (F.floor(x * grid) == F.col("a.cx")) & (F.floor(y * grid) == F.col("a.cy"))
    on += [F.col("a.cx") == F.col("b.cx"), F.col("a.cy") == F.col("b.cy"), intersects(Box.of("a"), Box.of("b")), home]
    return cells(a).alias("a").join(cells(b).alias("b"), on)


def explained(containment: float = 0.5, least_iou: float = 0.3) -> Column:
    """Candidate a is covered by box b (JN-03, JN-05)."""
    a, b = Box.of("a"), Box.of("b")
    return (overlap(a, b) / F.greatest(F.lit(1e-9), a.area) >= containment) | (iou(a, b) >= least_iou)


def drop_explained(candidates: DataFrame, boxes: DataFrame, containment: float = 0.5, least_iou: float = 0.3) -> DataFrame:
    """Candidates that no box of their page covers: a left anti join (JN-03, JN-05)."""
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in PAGE] + [intersects(Box.of("a"), Box.of("b")), explained(containment, least_iou)]
    return candidates.alias("a").join(boxes.alias("b"), on, "left_anti")


def drop_straddling(candidates: DataFrame, boxes: DataFrame, share: float = 0.15, key: str = "block_index") -> DataFrame:
    """Candidates of which fewer than two boxes cover ``share`` (JN-04, JN-06)."""
    a = Box.of("a")
    hits = pairs(candidates, boxes).where(overlap(a, Box.of("b")) / F.greatest(F.lit(1e-9), a.area) >= share)
    twice = hits.groupBy(*[F.col(f"a.{k}").alias(k) for k in (*PAGE, key)]).count().where("count >= 2")
    return candidates.join(twice, [*PAGE, key], "left_anti")


def touched(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """Blocks that overlap a region of their page: a left semi join (JN-07)."""
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in PAGE] + [intersects(Box.of("a"), Box.of("b"))]
    return blocks.alias("a").join(regions.alias("b"), on, "left_semi")


def line_boxes(words: DataFrame, existing: DataFrame, most: int = 10, least_words: int = 3) -> DataFrame:
    """Words to lines by union of boxes, those already covered dropped, at most ``most`` a page (SRC-07).

    ``words``: doc_id, page_index, block_no, line_no, x0..y1, in pixels of (width, height).
    """
    n = F.count("*").over(Window.partitionBy(*PAGE))
    norm = lambda c, side: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c) / F.col(side)))
    boxes = words.withColumn("_n", n).where(F.col("_n") >= least_words).groupBy(*PAGE, "block_no", "line_no").agg(
        F.min(norm("x0", "width")).alias("x0"), F.min(norm("y0", "height")).alias("y0"),
        F.max(norm("x1", "width")).alias("x1"), F.max(norm("y1", "height")).alias("y1"),
    )
    fresh = drop_explained(boxes.where("x1 > x0 and y1 > y0"), existing, containment=0.6)
    order = Window.partitionBy(*PAGE).orderBy("block_no", "line_no")
    return fresh.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most).drop("_k")


def recall_boxes(candidates: DataFrame, boxes: DataFrame, most: int = 10) -> DataFrame:
    """Candidates of plausible height, shape and density, the densest ``most`` of a page (AGG-20)."""
    median = boxes.where("y1 > y0").groupBy(*PAGE).agg(F.median(F.col("y1") - F.col("y0")).alias("_m"))
    h, w = F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")
    fit = (h >= 0.45 * F.col("_m")) & (h <= 2.5 * F.col("_m")) & (w / h >= 2) & F.col("density").between(0.10, 0.75) & (w * h <= 0.25)
    order = Window.partitionBy(*PAGE).orderBy(F.desc("density"), "block_index")
    out = candidates.join(median, list(PAGE)).where((h > 0) & fit)
    return out.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most).drop("_k", "_m")


def grid_coverage(blocks: DataFrame, boxes: DataFrame, grid: int = 20) -> DataFrame:
    """Share of a grid of points of each block that lies in any box of its page (AGG-19).

    The boxes of a page meet its blocks once; points are counted within the row and never become rows.
    """
    page = boxes.groupBy(*PAGE).agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("boxes"))
    met = blocks.select(*PAGE, "block_index", *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")]).join(page, list(PAGE), "left")
    # only boxes that touch the block can hold its points
    near = F.filter("boxes", lambda b: (b["x0"] <= F.col("_x1")) & (F.col("_x0") <= b["x1"]) & (b["y0"] <= F.col("_y1")) & (F.col("_y0") <= b["y1"]))
    met = met.withColumn("boxes", near)
    point = lambda lo, hi, i: F.col(lo) + (F.col(hi) - F.col(lo)) * (i + 0.5) / grid

    def row_hits(j: Column) -> Column:
        y = point("_y0", "_y1", j)
        across = F.filter("boxes", lambda b: (b["y0"] <= y) & (y <= b["y1"]))
        held = lambda s, x: F.exists(s, lambda b: (b["x0"] <= x) & (x <= b["x1"]))
        return F.get(F.transform(F.array(across), lambda s: F.size(F.filter(steps, lambda i: held(s, point("_x0", "_x1", i))))), F.lit(0))

    steps = F.sequence(F.lit(0), F.lit(grid - 1))
    hits = F.aggregate(steps, F.lit(0), lambda acc, j: acc + row_hits(j))
    share = F.when(F.size("boxes") > 0, hits / float(grid * grid)).otherwise(0.0)
    return met.select(*PAGE, "block_index", share.alias("coverage"))


def longest_band(rows: DataFrame, level: float = 0.80, least_rows: int = 3, least_share: float = 0.02) -> DataFrame:
    """Longest run of pixel rows with a fraction of at least ``level``, the first of equals (AGG-21).

    ``rows``: doc_id, page_index, row, fraction, height.
    """
    high = rows.where(F.col("fraction") >= level)
    island = F.col("row") - F.row_number().over(Window.partitionBy(*PAGE).orderBy("row"))
    runs = high.withColumn("_g", island).groupBy(*PAGE, "_g").agg(F.min("row").alias("first"), F.max("row").alias("last"), F.first("height").alias("height"))
    size = F.col("last") - F.col("first") + 1
    best = Window.partitionBy(*PAGE).orderBy(F.desc(size), "first")
    ok = (size >= least_rows) & (size / F.col("height") >= least_share)
    out = runs.withColumn("_k", F.row_number().over(best)).where((F.col("_k") == 1) & ok)
    return out.select(*PAGE, F.lit(0.0).alias("x0"), (F.col("first") / F.col("height")).alias("y0"), F.lit(1.0).alias("x1"), ((F.col("last") + 1) / F.col("height")).alias("y1"))
