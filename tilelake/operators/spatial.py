"""Joins of boxes and points by grid buckets: range predicates become equi-joins that Spark can shuffle and split.

Boxes go to every bucket they touch, points to one.  A pair of boxes counts only in the bucket that holds the greater
of their lower corners, so no distinct is needed.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilelake.functions.geometry import contains, iou, overlaps


def to_buckets(df: DataFrame, box, size: int, bx: str = "bx", by: str = "by") -> DataFrame:
    x1, y1, x2, y2 = box
    cell = lambda c: F.floor(F.col(c) / size).cast("int")
    return df.withColumn(bx, F.explode(F.sequence(cell(x1), cell(x2)))).withColumn(by, F.explode(F.sequence(cell(y1), cell(y2))))


def box_pairs(a: DataFrame, b: DataFrame, keys: list[str], size: int, where: Column | None = None) -> DataFrame:
    """Pairs of boxes a (ax1..ay2) and b (bx1..by2) with equal keys that share a bucket; columns of both must differ."""
    left = to_buckets(a, ("ax1", "ay1", "ax2", "ay2"), size, "_u", "_v")
    right = to_buckets(b, ("bx1", "by1", "bx2", "by2"), size, "_u", "_v")
    own = (F.floor(F.greatest("ax1", "bx1") / size) == F.col("_u")) & (F.floor(F.greatest("ay1", "by1") / size) == F.col("_v"))
    out = left.join(right, [*keys, "_u", "_v"]).where(own & overlaps(("ax1", "ay1", "ax2", "ay2"), ("bx1", "by1", "bx2", "by2"), closed=True))
    return (out.where(where) if where is not None else out).drop("_u", "_v")


def points_in_boxes(points: DataFrame, boxes: DataFrame, keys: list[str], size: int, closed: bool = False) -> DataFrame:
    """Points (x, y) with every box (x1, y1, x2, y2) that covers them; half-open unless closed."""
    p = points.withColumn("_u", F.floor(F.col("x") / size).cast("int")).withColumn("_v", F.floor(F.col("y") / size).cast("int"))
    b = to_buckets(boxes, ("x1", "y1", "x2", "y2"), size, "_u", "_v")
    return p.join(b, [*keys, "_u", "_v"]).where(contains(("x1", "y1", "x2", "y2"), "x", "y", closed)).drop("_u", "_v")


def first_cover(points: DataFrame, boxes: DataFrame, keys: list[str], point_id: str, rank: str, size: int) -> DataFrame:
    """Each covered point with the lowest-ranked box that covers it."""
    return points_in_boxes(points, boxes, keys, size).groupBy(*keys, point_id).agg(F.min(rank).alias(rank))


def overlapping_pairs(boxes: DataFrame, keys: list[str], box_id: str, size: int, above: float) -> DataFrame:
    """Pairs (a, b), a < b, of one set of boxes whose IoU is above a threshold."""
    side = lambda p: boxes.select(*keys, F.col(box_id).alias(p), *(F.col(c).alias(p + c) for c in ("x1", "y1", "x2", "y2")))
    a, b = (tuple(p + c for c in ("x1", "y1", "x2", "y2")) for p in "ab")
    return box_pairs(side("a"), side("b"), keys, size, F.col("a") < F.col("b")).withColumn("iou", iou(a, b)).where(F.col("iou") > above)


def adjacent_tiles(tiles: DataFrame) -> DataFrame:
    """Each pair of 8-neighbours once: (ti, tj) at offsets (0,1), (-1,0), (-1,1), (-1,-1) of (row, column)."""
    offsets = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((0, 1), (-1, 0), (-1, 1), (-1, -1))))
    a = tiles.select("slide_id", F.col("tile_idx").alias("ti"), F.col("row_index").alias("r0"), F.col("col_index").alias("c0"),
                     F.col("position_x").alias("ix"), F.col("position_y").alias("iy")).withColumn("o", F.explode(offsets))
    a = a.select("slide_id", "ti", "ix", "iy", (F.col("r0") + F.col("o.r")).alias("row_index"), (F.col("c0") + F.col("o.c")).alias("col_index"))
    b = tiles.select("slide_id", "row_index", "col_index", F.col("tile_idx").alias("tj"), F.col("position_x").alias("jx"), F.col("position_y").alias("jy"))
    return a.join(b, ["slide_id", "row_index", "col_index"]).select("slide_id", "ti", "tj", "ix", "iy", "jx", "jy")


def halo(selected: DataFrame, tiles: DataFrame, reach: int = 1) -> DataFrame:
    """Tiles within `reach` rows and columns of a selected tile, itself included, that exist."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    near = selected.select("slide_id", "row_index", "col_index").withColumn("dr", F.explode(steps)).withColumn("dc", F.explode(steps)).select(
        "slide_id", (F.col("row_index") + F.col("dr")).alias("row_index"), (F.col("col_index") + F.col("dc")).alias("col_index")).distinct()
    return near.join(tiles.select("slide_id", "row_index", "col_index"), ["slide_id", "row_index", "col_index"], "left_semi")


def bounds(boxes: DataFrame, keys: list[str], pad: int = 0) -> DataFrame:
    """Bounding box (x1..y2) of each key's boxes, padded, and the span: the wider range of their origins."""
    span = F.greatest(F.max("x1") - F.min("x1"), F.max("y1") - F.min("y1")).alias("span")
    return boxes.groupBy(*keys).agg((F.min("x1") - pad).alias("x1"), (F.min("y1") - pad).alias("y1"), (F.max("x2") + pad).alias("x2"), (F.max("y2") + pad).alias("y2"), span)


def tightened(points: DataFrame, keys: list[str], view: tuple[int, int], share: float = 0.1) -> DataFrame:
    """Box (x, y, w, h) around each key's points, padded by a share of its range on each side, and no smaller than a view."""
    g = points.groupBy(*keys).agg(*(f(c).alias(f"_{n}{c}") for c in "xy" for n, f in (("a", F.min), ("z", F.max))))
    for c, size, v in (("x", "w", view[0]), ("y", "h", view[1])):
        pad = (F.col(f"_z{c}") - F.col(f"_a{c}")) * share
        g = g.withColumn(c, F.floor(F.col(f"_a{c}") - pad)).withColumn(size, F.greatest(F.ceil(F.col(f"_z{c}") + pad) - F.col(c), F.lit(v)))
    return g.select(*keys, "x", "y", "w", "h")
