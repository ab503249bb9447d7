"""Camera views of a slide: over its nucleated cells, over its megakaryocytes, and the whole way from detections to task records."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilelake.operators import heatmap
from tilelake.operators.capture import capture
from tilelake.operators.cover import cover, recentre
from tilelake.operators.regions import assign_regions, at_area, bad_regions, grid_to_pixels, in_union, off_bad_regions, tile_of_grid
from tilelake.operators.search import all_sizes, best_region, search
from tilelake.operators.spatial import first_cover, halo
from tilelake.operators.suppress import cross_tile_dedup, meg_boxes
from tilelake.operators.tasks import records
from tilelake.operators.tiles import TILE_H, TILE_W, clamp_view, nearest_tile
from tilelake.session import cut as _cut

VIEW_W, VIEW_H, STRIDE = 384, 283, 0.25


def views_over(points: DataFrame, keys: list[str], point_id: str, w: int = VIEW_W, h: int = VIEW_H, ratio: float = STRIDE) -> tuple[DataFrame, DataFrame]:
    """Views (keys, view_id, x, y) that cover every point (x, y), few by cover(), and re-centred; and the view of each point."""
    points = points.select(*keys, point_id, "x", "y")
    chosen = cover(points, keys, point_id, w, h, ratio, closed=False).withColumn("view_id", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("points"), "wx", "wy")).cast("long"))
    views = _cut(recentre(chosen.select(*keys, "view_id", F.col("wx").alias("x"), F.col("wy").alias("y")), points, keys, "view_id", point_id, w, h))
    boxes = views.select(*keys, "view_id", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + w).alias("x2"), (F.col("y") + h).alias("y2"))
    return views, first_cover(points, boxes, keys, point_id, "view_id", max(w, h))


def selected_cells(selected: DataFrame, cells: DataFrame, tiles: DataFrame, area, reach: int = 1) -> DataFrame:
    """Cells (slide_id, tile_idx, x, y) of the selected tiles and their neighbours that lie in the quadrants of selected grid points."""
    rects = grid_to_pixels(selected.select("slide_id", "gx", "gy", F.lit(1).alias("gw"), F.lit(1).alias("gh")), tiles, area)
    boxes = rects.select("slide_id", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"))
    own = tile_of_grid(selected, area).select("slide_id", F.col("iy").cast("int").alias("row_index"), F.col("ix").cast("int").alias("col_index")).distinct()
    near = halo(own, tiles, reach).join(tiles.select("slide_id", "row_index", "col_index", "tile_idx"), ["slide_id", "row_index", "col_index"]).select("slide_id", "tile_idx")
    return in_union(cells.join(near, ["slide_id", "tile_idx"], "left_semi"), boxes, ["slide_id"], TILE_H // 2)


def middles(boxes: DataFrame) -> DataFrame:
    """boxes (x1..y2) as points x, y with sizes cw, ch of at least one pixel."""
    return boxes.withColumn("x", 0.5 * (F.col("x1") + F.col("x2"))).withColumn("y", 0.5 * (F.col("y1") + F.col("y2"))).withColumn(
        "cw", F.greatest(F.col("x2") - F.col("x1") + 1, F.lit(1)).cast("double")).withColumn("ch", F.greatest(F.col("y2") - F.col("y1") + 1, F.lit(1)).cast("double"))


def wbc_views(selected: DataFrame, cells: DataFrame, tiles: DataFrame, area) -> tuple[DataFrame, DataFrame]:
    """Views over the nucleated cells (slide_id, tile_idx, cell_id, x1..y2) at selected grid points; and those cells with their view."""
    points = _cut(selected_cells(selected, middles(cells), tiles, area).withColumn("point", F.struct("tile_idx", "cell_id")))
    views, owner = views_over(points, ["slide_id"], "point")
    return views, points.join(owner, ["slide_id", "point"])


def meg_views(megs: DataFrame, blocks: DataFrame, tiles: DataFrame, first: DataFrame, overlap: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Views over the megakaryocytes (slide_id, id, x1..y2) off bad regions, and those boxes with their view.

    view_id counts by distance from the first view over nucleated cells (first: slide_id, x, y).  Every view has the tile whose centre
    is nearest, and its place there (view_pos_x, view_pos_y), moved inside it.
    """
    kept = meg_boxes(off_bad_regions(megs, bad_regions(blocks, tiles), ["slide_id"], overlap), ["slide_id"])
    points = _cut(middles(kept).select("slide_id", "id", "x", "y", "cw", "ch"))
    views, _ = views_over(points, ["slide_id"], "id")
    v = views.join(first.select("slide_id", F.col("x").alias("fx"), F.col("y").alias("fy")), "slide_id", "left")
    d = (F.col("x") - F.col("fx")) * (F.col("x") - F.col("fx")) + (F.col("y") - F.col("fy")) * (F.col("y") - F.col("fy"))
    v = v.withColumn("n", F.row_number().over(Window.partitionBy("slide_id").orderBy(F.coalesce(d, F.lit(0)), "view_id")).cast("long")).select("slide_id", F.col("n").alias("view_id"), "x", "y")
    boxes = v.select("slide_id", "view_id", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + VIEW_W).alias("x2"), (F.col("y") + VIEW_H).alias("y2"))
    owner = first_cover(points, boxes, ["slide_id"], "id", "view_id", VIEW_W)
    mid = v.select("slide_id", "view_id", (F.col("x") + VIEW_W / 2).alias("x"), (F.col("y") + VIEW_H / 2).alias("y"))
    tile = nearest_tile(mid, tiles, ["view_id"]).drop("dist2").join(tiles.select("slide_id", "tile_idx", "row_index", "col_index", "position_x", "position_y"), ["slide_id", "tile_idx"])
    v = v.join(tile, ["slide_id", "view_id"]).withColumn("view_pos_x", clamp_view(F.col("x"), F.col("position_x"), VIEW_W, TILE_W)).withColumn(
        "view_pos_y", clamp_view(F.col("y"), F.col("position_y"), VIEW_H, TILE_H))
    return v, points.join(owner, ["slide_id", "id"])


def meg_records(views: DataFrame, boxes: DataFrame, area) -> DataFrame:
    """Task records of meg_views(); rows count from the last one of the area."""
    half = lambda c: F.floor(F.bround(c) / 2)
    at = boxes.join(views.select("slide_id", "view_id", "position_x", "position_y"), ["slide_id", "view_id"])
    cell = F.struct((F.col("x") - F.col("position_x") - half("cw")).cast("int").alias("cell_x"), (F.col("y") - F.col("position_y") - half("ch")).cast("int").alias("cell_y"),
                    F.bround("cw").cast("int").alias("cell_width"), F.bround("ch").cast("int").alias("cell_height"))
    lists = at.groupBy("slide_id", "view_id").agg(F.array_sort(F.collect_list(cell)).alias("cell_list"))  # as many as fit in one view
    return at_area(views.join(lists, ["slide_id", "view_id"]), area).select(
        "slide_id", F.lit(None).cast("int").alias("region"), F.col("view_id").cast("int").alias("sort_id"), F.lit("False").alias("Adition_shooting_flag"), (F.col("_max_row") - F.col("row_index")).alias("row_index"),
        "col_index", "view_pos_x", "view_pos_y", F.lit(VIEW_W).alias("view_width"), F.lit(VIEW_H).alias("view_height"), F.lit("meg").alias("view_type"), "cell_list")


def grouped(*parts: DataFrame) -> DataFrame:
    """Task records of several kinds, one after the other, with `group`: a number for each region and kind, in that order."""
    rows = None
    for k, p in enumerate(parts):
        p = p.withColumn("_kind", F.lit(k))
        rows = p if rows is None else rows.unionByName(p)
    return rows.withColumn("group", F.dense_rank().over(Window.partitionBy("slide_id").orderBy("_kind", F.coalesce("region", F.lit(0))))).drop("_kind")


def neighbours(selected: DataFrame, tiles: DataFrame, reach: int = 1) -> DataFrame:
    """Selected tiles and all around them, of which the existing ones stay."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    keys = ["slide_id", "row_index", "col_index"]
    around = selected.select(*keys).withColumn("_r", F.explode(steps)).withColumn("_c", F.explode(steps)).select(
        "slide_id", (F.col("row_index") + F.col("_r")).alias("row_index"), (F.col("col_index") + F.col("_c")).alias("col_index"))
    return selected.select(*keys).union(around).distinct().intersect(tiles.select(*keys))


def task_list(detections: DataFrame, tiles: DataFrame, blocks: DataFrame, megs: DataFrame, area, target: int, orientation: int = 1, least: float = -6.0,
              sizes: list[tuple[int, int]] | None = None) -> DataFrame:
    """The whole way: detections of all slides to task records in groups, those of nucleated cells by region, megakaryocytes last.

    detections: tile-local boxes; blocks: scored, with labels; megs: boxes of the slide.  area: a user area for all slides, or a table with each
    one's.  The search looks for three times the target, in windows of all sizes.
    """
    kept = _cut(cross_tile_dedup(detections, tiles))
    held = kept.groupBy("slide_id", "tile_idx").agg(F.count("*").alias("n"))  # a row a tile is joined, not a row a cell
    per_tile = _cut(held.join(tiles.select("slide_id", "tile_idx", F.col("col_index").alias("ix"), F.col("row_index").alias("iy")), ["slide_id", "tile_idx"]).groupBy("slide_id", "ix", "iy").agg(F.sum("n").alias("cells")))
    grid = _cut(heatmap.heat_map(blocks, tiles))
    found = _cut(search(grid, heatmap.head_crop(grid, least, area=area), per_tile, sizes or all_sizes(), area, 3 * target, orientation))
    region = _cut(best_region(found, middles(kept), tiles, area, 3 * target))
    parts = _cut(capture(region, grid, per_tile, area, target))
    views, cells = wbc_views(parts.select("slide_id", "gx", "gy"), kept, tiles, area)
    rects = grid_to_pixels(parts.select("slide_id", F.col("part").alias("region"), "gx", "gy", F.lit(1).alias("gw"), F.lit(1).alias("gh")), tiles, area)
    rects = rects.select("slide_id", "region", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"))
    placed = views.select("slide_id", F.col("view_id").alias("id"), F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + VIEW_W).alias("x2"), (F.col("y") + VIEW_H).alias("y2"))
    placed = assign_regions(placed, rects, ["slide_id"]).where(F.col("region").isNotNull()).select(
        "slide_id", "region", F.col("id").alias("view_id"), F.col("x1").alias("x"), F.col("y1").alias("y"), F.lit(VIEW_W).alias("w"), F.lit(VIEW_H).alias("h"))
    wbc = records(placed, cells.select("slide_id", "view_id", F.col("x").alias("cx"), F.col("y").alias("cy"), "cw", "ch"), tiles, area)
    first = placed.groupBy("slide_id").agg(F.min_by(F.struct("x", "y"), F.struct("region", "x", "y", "view_id")).alias("f")).select("slide_id", "f.x", "f.y")
    return grouped(wbc, meg_records(*meg_views(megs, blocks, tiles, first), area))


def kept_task_lists(path: str, detections: DataFrame, tiles: DataFrame, blocks: DataFrame, megs: DataFrame, area, target: int, orientation: int = 1, least: float = -6.0) -> DataFrame:
    """task_list(), kept in a store by slide, user area, settings and the slide's rows: a slide that is there is read, not searched."""
    from tilelake.sources.saved import kept_results

    def compute(t, own_area):
        return task_list(t["detections"], t["tiles"], t["blocks"], t["megs"], own_area, target, orientation, least)

    return kept_results(path, {"detections": detections, "tiles": tiles, "blocks": blocks, "megs": megs}, compute, area, target=target, orientation=orientation, least=least)
