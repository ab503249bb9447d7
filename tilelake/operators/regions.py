"""Regions of slides: which boxes, points and tiles belong to them, and how good they are."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilelake.functions.geometry import contains, intersection, over_smaller
from tilelake.operators.spatial import box_pairs, first_cover, points_in_boxes, to_buckets
from tilelake.operators.tiles import TILE_H, TILE_W

BOX = ("x1", "y1", "x2", "y2")
# Places of the four scored blocks in a tile (fixed values): x and y by dx and dy, and the side.
BLOCK_X, BLOCK_Y, BLOCK_SIDE = (0, 848), (352, 1152), 896


AREA_COLUMNS = ("_min_row", "_max_row", "_min_col", "_max_col")


def at_area(df: DataFrame, area) -> DataFrame:
    """df with the bounds of its slide's user area as columns.

    area: one dict for all slides, or a table (slide_id, min_row, max_row, min_col, max_col) with a row for each slide;
    slides that the table lacks go.
    """
    if isinstance(area, dict):
        return df.withColumns({c: F.lit(area[c[1:]]) for c in AREA_COLUMNS})
    return df.join(area.select("slide_id", *(F.col(c[1:]).alias(c) for c in AREA_COLUMNS)), "slide_id")


def tile_boxes(tiles: DataFrame) -> DataFrame:
    return tiles.select("slide_id", "tile_idx", F.col("position_x").alias("x1"), F.col("position_y").alias("y1"),
                        (F.col("position_x") + TILE_W).alias("x2"), (F.col("position_y") + TILE_H).alias("y2"))


def containing_tile(points: DataFrame, tiles: DataFrame, point_id: str) -> DataFrame:
    """The first tile that holds each point; points outside all tiles are left out."""
    return first_cover(points, tile_boxes(tiles), ["slide_id"], point_id, "tile_idx", TILE_H)


def in_union(points: DataFrame, boxes: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Points (x, y) that any box holds, each once; a point lies in one bucket, so a semi-join is enough."""
    p = points.withColumn("_u", F.floor(F.col("x") / size).cast("int")).withColumn("_v", F.floor(F.col("y") / size).cast("int"))
    b = to_buckets(boxes.select(*keys, *(F.col(c).alias("_" + c) for c in BOX)), tuple("_" + c for c in BOX), size, "_bu", "_bv")
    b = b.select(*(F.col(k).alias("_k" + k) for k in keys), "_bu", "_bv", *("_" + c for c in BOX))
    on = (F.col("_u") == F.col("_bu")) & (F.col("_v") == F.col("_bv")) & contains(tuple("_" + c for c in BOX), "x", "y")
    for k in keys:
        on = on & (F.col(k) == F.col("_k" + k))
    return p.join(b, on, "left_semi").drop("_u", "_v")


def bad_regions(blocks: DataFrame, tiles: DataFrame, label: int = 5) -> DataFrame:
    """Boxes, in slide coordinates, of the blocks of a label."""
    pick = lambda c, v: F.when(F.col(c) == 0, v[0]).otherwise(v[1])
    b = blocks.where(F.col("label") == label).select("slide_id", "tile_idx", pick("dx", BLOCK_X).alias("ox"), pick("dy", BLOCK_Y).alias("oy"))
    b = b.join(tiles.select("slide_id", "tile_idx", "position_x", "position_y"), ["slide_id", "tile_idx"])
    x, y = F.col("position_x") + F.col("ox"), F.col("position_y") + F.col("oy")
    return b.select("slide_id", x.alias("x1"), y.alias("y1"), (x + BLOCK_SIDE).alias("x2"), (y + BLOCK_SIDE).alias("y2"))


def off_bad_regions(boxes: DataFrame, bad: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Boxes (id, x1..y2) whose centre is in no bad box and whose overlap with each is below a share of the smaller of both."""
    a, b = (tuple(p + c for c in BOX) for p in "ab")
    side = lambda df, p, *more: df.select(*keys, *more, *(F.col(c).alias(p + c) for c in BOX))
    centre = contains(b, (F.col("ax1") + F.col("ax2")) * 0.5, (F.col("ay1") + F.col("ay2")) * 0.5)
    hit = box_pairs(side(boxes, "a", "id"), side(bad, "b"), keys, 1024, centre | (over_smaller(a, b) >= threshold))
    return boxes.join(hit.select(*keys, "id"), [*keys, "id"], "left_anti")


def assign_regions(rects: DataFrame, regions: DataFrame, keys: list[str], size: int = 1024) -> DataFrame:
    """rects (keys, id, x1..y2) with region: the first whose boxes hold the centre, else the one with most overlap, else null."""
    a, b = (tuple(p + c for c in BOX) for p in "ab")
    centres = rects.select(*keys, "id", ((F.col("x1") + F.col("x2")) * 0.5).alias("x"), ((F.col("y1") + F.col("y2")) * 0.5).alias("y"))
    first = points_in_boxes(centres, regions, keys, size).groupBy(*keys, "id").agg(F.min("region").alias("by_centre"))
    side = lambda df, p, c: df.select(*keys, c, *(F.col(n).alias(p + n) for n in BOX))
    area = box_pairs(side(rects, "a", "id"), side(regions, "b", "region"), keys, size).groupBy(*keys, "id", "region").agg(F.sum(intersection(a, b)).alias("area"))
    most = area.where("area > 0").groupBy(*keys, "id").agg(F.max_by("region", F.struct("area", -F.col("region"))).alias("by_area"))
    out = rects.join(first, [*keys, "id"], "left").join(most, [*keys, "id"], "left")
    return out.withColumn("region", F.coalesce("by_centre", "by_area")).drop("by_centre", "by_area")


def removed_points(raw: DataFrame, kept: DataFrame, keys: list[str], tolerance: int) -> DataFrame:
    """Points of raw (x, y) farther than tolerance from every kept point of equal keys; each looks into its nine cells."""
    cell = lambda c: F.floor(F.col(c) / tolerance).cast("int")
    step = F.sequence(F.lit(-1), F.lit(1))
    near = kept.select(*(F.col(k).alias("_k" + k) for k in keys), F.col("x").alias("_x"), F.col("y").alias("_y"), cell("x").alias("_i"), cell("y").alias("_j"))
    near = near.withColumn("_a", F.explode(step)).withColumn("_b", F.explode(step)).withColumn("_i", F.col("_i") + F.col("_a")).withColumn("_j", F.col("_j") + F.col("_b")).drop("_a", "_b")
    dx, dy = F.col("x") - F.col("_x"), F.col("y") - F.col("_y")
    on = (F.col("_u") == F.col("_i")) & (F.col("_v") == F.col("_j")) & (dx * dx + dy * dy <= tolerance * tolerance)
    for k in keys:
        on = on & (F.col(k) == F.col("_k" + k))
    return raw.withColumn("_u", cell("x")).withColumn("_v", cell("y")).join(near, on, "left_anti").drop("_u", "_v")


def dedup_report(raw: DataFrame, kept: DataFrame, keys: list[str], tolerance: int) -> DataFrame:
    """Raw, kept and removed points of each key."""
    removed = removed_points(raw, kept, keys, tolerance)
    n = lambda df, c: df.select(*keys, *(F.lit(int(c == k)).alias(k) for k in ("raw", "kept", "removed")))
    return n(raw, "raw").unionByName(n(kept, "kept")).unionByName(n(removed, "removed")).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("raw", "kept", "removed")))


def tile_of_grid(points: DataFrame, area) -> DataFrame:
    """ix, iy of the tile that a grid point (gx, gy) of a user area lies on, with the rows flipped."""
    ix, iy = F.expr("gx div 2").cast("int") + F.col("_min_col"), F.col("_max_row") - F.expr("gy div 2").cast("int")
    return at_area(points, area).withColumn("ix", ix).withColumn("iy", iy).drop(*AREA_COLUMNS)


def cells_of_regions(points: DataFrame, cells_per_tile: DataFrame, keys: list[str], area) -> DataFrame:
    """Cells of the tiles that the grid points of each region touch, each tile once."""
    tiles = tile_of_grid(points, area).select(*keys, "ix", "iy").distinct()
    return tiles.join(cells_per_tile, ["slide_id", "ix", "iy"], "left").groupBy(*keys).agg(F.coalesce(F.sum("cells"), F.lit(0)).alias("cells"))


def grid_to_pixels(rects: DataFrame, tiles: DataFrame, area, patch: tuple[int, int] = (1224, 1024), off_x=(0, 1224), off_y=(0, 1024)) -> DataFrame:
    """Pixel boxes of grid rectangles (gx, gy, gw, gh), by the tile under their first corner."""
    t = tiles.select("slide_id", F.col("col_index").alias("ix"), F.col("row_index").alias("iy"), "position_x", "position_y")
    pick = lambda c, v: F.when(F.col(c) % 2 == 0, v[0]).otherwise(v[1])
    return tile_of_grid(rects, area).join(t, ["slide_id", "ix", "iy"]).withColumn("x", F.col("position_x") + pick("gx", off_x)).withColumn(
        "y", F.col("position_y") + pick("gy", off_y)).withColumn("w", F.col("gw") * patch[0]).withColumn("h", F.col("gh") * patch[1]).drop("ix", "iy", "position_x", "position_y")


def mosaic(tiles: DataFrame, keys: list[str], longest: int = 4000) -> DataFrame:
    """Scaled place of each tile in a mosaic of its key whose longer side is at most `longest`."""
    ext = tiles.groupBy(*keys).agg(F.min("position_x").alias("_x0"), F.min("position_y").alias("_y0"), (F.max("position_x") + TILE_W).alias("_x1"), (F.max("position_y") + TILE_H).alias("_y1"))
    out = tiles.join(ext, keys).withColumn("scale", F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"))))
    at = lambda c, o: F.round((F.col(c) - F.col(o)) * F.col("scale"), 3)
    side = lambda a, b: F.ceil((F.col(b) - F.col(a)) * F.col("scale")).cast("int")
    return out.withColumn("mx", at("position_x", "_x0")).withColumn("my", at("position_y", "_y0")).withColumn("out_w", side("_x0", "_x1")).withColumn("out_h", side("_y0", "_y1")).drop("_x0", "_y0", "_x1", "_y1")


def kernel_mean(grid: DataFrame, w: int, h: int, missing: float = -1000.0) -> DataFrame:
    """Mean score of every w x h window of a sparse grid that touches it; absent cells count as `missing`.

    Sums of score - missing are spread along one axis and then along the other, so a cell is copied w + h times.
    """
    s = grid.select("slide_id", "gx", "gy", (F.col("score") - missing).alias("s"))
    s = s.select("slide_id", F.explode(F.sequence(F.col("gx") - (w - 1), F.col("gx"))).alias("wx"), "gy", "s").groupBy("slide_id", "wx", "gy").agg(F.sum("s").alias("s"))
    s = s.select("slide_id", "wx", F.explode(F.sequence(F.col("gy") - (h - 1), F.col("gy"))).alias("wy"), "s").groupBy("slide_id", "wx", "wy").agg(F.sum("s").alias("s"))
    return s.select("slide_id", "wx", "wy", (F.col("s") / (w * h) + missing).alias("mean"))


def near_target(candidates: DataFrame, totals: DataFrame, keys: list[str], target: int, ratio: float = 0.2, levels: int = 40) -> DataFrame:
    """Candidates (id, cells) with at least target cells and no more than the first allowance that any meets.

    The allowance target * (1 + ratio) doubles its ratio while it stays within the slide's total; where none is met,
    the candidate with most cells is taken.
    """
    limit = lambda k: target * (1 + ratio * F.pow(F.lit(2.0), k))
    fits = F.filter(F.sequence(F.lit(0), F.lit(levels)), lambda k: (F.col("cells") <= limit(k)) & ((k == 0) | (limit(k) <= F.col("total"))))
    c = candidates.join(totals, keys).withColumn("level", F.when(F.col("cells") >= target, F.array_min(fits)))
    best = c.groupBy(*keys).agg(F.min("level").alias("_level"), F.min_by("id", F.struct(-F.col("cells"), "id")).alias("_most"))
    return c.join(best, keys).where((F.col("level") == F.col("_level")) | (F.col("_level").isNull() & (F.col("id") == F.col("_most")))).drop("_level", "_most", "total")


def most_uniform(regions: DataFrame, keys: list[str], top: int = 3) -> DataFrame:
    """Of the `top` regions by area_score the one with the best uniformity."""
    best = regions.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("area_score"), "id"))).where(F.col("_n") <= top)
    return best.groupBy(*keys).agg(F.max_by(F.struct("id", "area_score", "uniformity"), F.struct("uniformity", -F.col("_n"))).alias("r")).select(*keys, "r.*")


def in_quad(x, y, corners) -> F.Column:
    """Point in a convex quadrilateral given by four (x, y) in either order of turning; borders included."""
    sides = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for (ax, ay), (bx, by) in zip(corners, [*corners[1:], corners[0]])]
    every = lambda cond: cond[0] & cond[1] & cond[2] & cond[3]
    return every([s >= 0 for s in sides]) | every([s <= 0 for s in sides])


def cells_in_quad(slides: DataFrame, corners: list[tuple[float, float]], width: int, height: int) -> DataFrame:
    """Grid cells of each slide inside a rotated rectangle."""
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    rng = lambda v, n: F.explode(F.sequence(F.lit(max(0, int(min(v)))), F.lit(min(n - 1, int(max(v)) + 1))))
    return slides.select("slide_id", rng(xs, width).alias("gx")).select("slide_id", "gx", rng(ys, height).alias("gy")).where(in_quad(F.col("gx"), F.col("gy"), corners))


def uniformity(cells: DataFrame, keys: list[str], corners: list[tuple[int, int]], bin_px: int = 20, view: tuple[int, int] = (384, 283)) -> DataFrame:
    """Share of a convex region's bins that have a cell of the region within a view around them.

    A cell's bin lights kw bins in each of kh rows.  Lit bins of a row are counted without spelling them out: sorted by
    place, each adds the smaller of kw and the distance to the next.
    """
    kw, kh = view[0] // bin_px, view[1] // bin_px
    x0, y1 = min(c[0] for c in corners), max(c[1] for c in corners)
    area = abs(sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(corners, [*corners[1:], corners[0]]))) / 2 / (bin_px * bin_px)
    bins = cells.where(in_quad(F.col("x"), F.col("y"), corners)).select(
        *keys, F.floor((F.col("x") - x0) / bin_px).alias("mx"), F.floor((y1 - F.col("y")) / bin_px).alias("my")).distinct()
    rows = bins.select(*keys, "mx", F.explode(F.sequence(F.col("my") - (kh - 1 - kh // 2), F.col("my") + kh // 2)).alias("row")).distinct()
    gap = F.lead("mx").over(Window.partitionBy(*keys, "row").orderBy("mx")) - F.col("mx")
    return rows.withColumn("n", F.least(F.coalesce(gap, F.lit(kw)), F.lit(kw))).groupBy(*keys).agg((F.sum("n") / max(area, 1.0)).alias("uniformity"))
