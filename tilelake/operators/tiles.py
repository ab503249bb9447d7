"""Tiles of a slide: completeness, coordinates, regions of interest and the boxes of model output."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilelake.session import cut as _cut

TILE_W, TILE_H = 2448, 2048


def missing_tiles(tiles: DataFrame, rows: int, cols: int, order: str | None = None) -> DataFrame:
    """missing_by_layer() for slides that all have a grid of rows x cols."""
    return missing_by_layer(tiles, tiles.select("slide_id").distinct().select("slide_id", F.lit(rows).alias("rows"), F.lit(cols).alias("cols")), order)


def missing_by_layer(tiles: DataFrame, layers: DataFrame, order: str | None = None) -> DataFrame:
    """Places of each slide's grid that have no tile, or a tile without image; of tiles added again, the last by `order` counts.

    layers: (slide_id, rows, cols).  A sparse layer (0 rows or columns) has no places of its own: it reports its tiles without image.
    Slides that layers lacks are left out; one without any tile lacks them all.
    """
    key = ["slide_id", "row_index", "col_index"]
    if order:
        tiles = latest(tiles, key, order)
    own = tiles.select(*key, "image_uid", F.lit(1).alias("here"))
    dense = (F.col("rows") > 0) & (F.col("cols") > 0)
    grid = layers.where(dense).withColumn("row_index", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).select(
        "slide_id", "row_index", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col_index"))
    places = grid.join(own, key, "left").unionByName(own.join(layers.where(~dense), "slide_id").select(*key, "image_uid", "here"))
    return places.where("here is null or image_uid is null").select(
        *key, F.col("here").isNull().cast("int").alias("position_missing"), F.col("image_uid").isNull().cast("int").alias("image_missing"))


def to_global(boxes: DataFrame, tiles: DataFrame) -> DataFrame:
    out = boxes.join(tiles.select("slide_id", "tile_idx", "position_x", "position_y"), ["slide_id", "tile_idx"])
    for c, p in (("x1", "position_x"), ("x2", "position_x"), ("y1", "position_y"), ("y2", "position_y")):
        out = out.withColumn(c, F.col(c) + F.col(p))
    return out.drop("position_x", "position_y")


def in_user_area(df: DataFrame, area: dict) -> DataFrame:
    return df.where(F.col("row_index").between(area["min_row"], area["max_row"]) & F.col("col_index").between(area["min_col"], area["max_col"]))


def in_roi(boxes: DataFrame, x1=None, y1=None, x2=None, y2=None) -> DataFrame:
    """Boxes that touch a region, borders included; an open side is not limited."""
    lo, hi = -(1 << 31), 1 << 31
    pick = lambda v, d: d if v is None else v
    return boxes.where((F.col("x1") <= pick(x2, hi)) & (F.col("x2") >= pick(x1, lo)) & (F.col("y1") <= pick(y2, hi)) & (F.col("y2") >= pick(y1, lo)))


def centre(boxes: DataFrame) -> DataFrame:
    return boxes.withColumn("cx", F.floor((F.col("x1") + F.col("x2")) / 2).cast("int")).withColumn("cy", F.floor((F.col("y1") + F.col("y2")) / 2).cast("int")).withColumn(
        "w", F.greatest(F.col("x2") - F.col("x1") + 1, F.lit(1))).withColumn("h", F.greatest(F.col("y2") - F.col("y1") + 1, F.lit(1)))


def on_white(cells: DataFrame, mask: DataFrame, least: int) -> DataFrame:
    """Cells whose centre, at a quarter of the scale, is a white pixel of the mask."""
    c = cells.withColumn("px", F.floor((F.col("x1") + F.col("x2")) / 8).cast("int")).withColumn("py", F.floor((F.col("y1") + F.col("y2")) / 8).cast("int"))
    return c.join(mask.where(F.col("white") > least), ["slide_id", "tile_idx", "px", "py"], "left_semi")


def unpad(boxes: DataFrame, ratio: float, pad_x: float, pad_y: float, width: int, height: int) -> DataFrame:
    """Boxes of a padded, scaled image on the original: (x - pad) / ratio, clipped; inverted boxes go."""
    out = boxes
    for c, p, m in (("x1", pad_x, width), ("x2", pad_x, width), ("y1", pad_y, height), ("y2", pad_y, height)):
        out = out.withColumn(c, F.greatest(F.lit(0.0), F.least((F.col(c) - p) / ratio, F.lit(float(m)))))
    return out.where("x2 >= x1 and y2 >= y1")


def widen(boxes: DataFrame, factor: int, width: int, height: int, scale: int) -> DataFrame:
    """Boxes (x, y, w, h) grown about their centre, clipped to the image, and scaled; xyxy."""
    half = lambda a, n: (F.col(a) + F.col(n) / 2, F.col(n) * factor / 2)
    (cx, rw), (cy, rh) = half("x", "w"), half("y", "h")
    fit = lambda v, m: F.greatest(F.lit(0), F.least(v.cast("int"), F.lit(m))) * scale
    return boxes.withColumn("x1", fit(cx - rw, width)).withColumn("y1", fit(cy - rh, height)).withColumn("x2", fit(cx + rw, width)).withColumn("y2", fit(cy + rh, height))


def big_cell_peaks(peaks: DataFrame, least: float, stride: int, width: int, height: int) -> DataFrame:
    """Peaks of a pooled map with decoded size (w, h) and offset (ox, oy), in cells of `stride` pixels, as boxes clipped to the image."""
    p = peaks.where((F.col("center") == F.col("center_pool")) & (F.col("center") >= least))
    mid = lambda c, o: (F.col(c) + F.col(o)) * stride
    fit = lambda v, m: F.greatest(F.lit(0), F.least(v.cast("int"), F.lit(m)))
    return p.withColumn("x1", fit(mid("px", "ox") - F.col("w") / 2, width)).withColumn("y1", fit(mid("py", "oy") - F.col("h") / 2, height)).withColumn(
        "x2", fit(mid("px", "ox") + F.col("w") / 2, width)).withColumn("y2", fit(mid("py", "oy") + F.col("h") / 2, height))


def windows_to_tile(boxes: DataFrame) -> DataFrame:
    """Boxes found in sub-tile windows (wx, wy: the window's origin) in the coordinates of the tile."""
    out = boxes
    for c, o in (("x1", "wx"), ("x2", "wx"), ("y1", "wy"), ("y2", "wy")):
        out = out.withColumn(c, F.col(c) + F.col(o))
    return out


def local_peaks(peaks: DataFrame, least: float, white: float, side: int, width: int, height: int) -> DataFrame:
    """Peaks of a pooled map as boxes of a fixed side, clipped to the image."""
    r = side // 2
    p = peaks.where((F.col("center") == F.col("center_pool")) & (F.col("center") >= least) & (F.col("white") >= white))
    fit = lambda v, m: F.greatest(F.lit(0), F.least(v, F.lit(m)))
    return p.withColumn("x1", fit(F.col("px") - r, width)).withColumn("y1", fit(F.col("py") - r, height)).withColumn("x2", fit(F.col("px") + r, width)).withColumn(
        "y2", fit(F.col("py") + r, height))


def windows(tiles: DataFrame, side: int, n: int = 3) -> DataFrame:
    """n x n sub-tile windows; the last of a row or column is flush with the tile's edge."""
    start = lambda k, total: F.when(F.col(k) == n - 1, total - side).otherwise((F.col(k) * (side * 0.9)).cast("int"))
    steps = F.sequence(F.lit(0), F.lit(n - 1))
    return tiles.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps)).withColumn("wx", start("j", TILE_W).cast("int")).withColumn("wy", start("i", TILE_H).cast("int"))


def flip_rows(df: DataFrame, rows: int, row: str = "row_index", to: str = "flipped") -> DataFrame:
    """Row numbers that grow downwards as ones that grow upwards, or back."""
    return df.withColumn(to, (F.lit(rows - 1) - F.col(row)).cast("int"))


def of_label(cells: DataFrame, label: int = 0) -> DataFrame:
    """Cells of a label; 0 is nucleated."""
    return cells.where(F.col("label") == label)


def of_classes(cells: DataFrame, classes: DataFrame, column: str = "label") -> DataFrame:
    """Cells whose class is in a table of allowed classes."""
    return cells.join(classes.select(column), column, "left_semi")


def visible(tiles: DataFrame, x1: float, y1: float, x2: float, y2: float) -> DataFrame:
    """Tiles that a viewport shows part of."""
    return tiles.where((F.col("position_x") + TILE_W > x1) & (F.col("position_x") < x2) & (F.col("position_y") + TILE_H > y1) & (F.col("position_y") < y2))


def viewport(offset_x: float, offset_y: float, zoom: float, width: int, height: int) -> tuple[float, float, float, float]:
    """The part of a slide that a window of width x height shows at a zoom, moved by an offset of window pixels."""
    return -offset_x / zoom, -offset_y / zoom, (width - offset_x) / zoom, (height - offset_y) / zoom


def cells_per_tile(cells: DataFrame) -> DataFrame:
    return cells.groupBy("slide_id", "tile_idx").agg(F.count("*").alias("cells"), F.sum(F.col("label").cast("long")).alias("megs"))


def remaining(all_rows: DataFrame, taken: DataFrame, keys: list[str]) -> DataFrame:
    return all_rows.join(taken, keys, "left_anti")


def letterbox(w: Column, h: Column, side: int = 1248, stride: int = 32, exact: bool = False) -> tuple[Column, Column, Column]:
    """Scale, left and top padding of an image of w x h fitted into a square; padding is cut to whole strides unless exact.

    Halves of the padding are rounded after taking off a tenth, so the odd pixel goes to the right and the bottom.
    """
    r = F.least(F.lit(float(side)) / h, F.lit(float(side)) / w)

    def pad(n: Column) -> Column:
        d = F.lit(float(side)) - F.round(n * r)
        d = (d if exact else d % stride) / 2 - 0.1
        return F.when(d < 0, -F.floor(0.5 - d)).otherwise(F.floor(d + 0.5)).cast("int")  # halves away from zero

    return r, pad(w), pad(h)


def unpad_by_size(boxes: DataFrame, width: int, height: int, side: int = 1248, stride: int = 32) -> DataFrame:
    """unpad() with the scale and padding that letterbox() gives for an image of width x height."""
    r, left, top = letterbox(F.lit(width), F.lit(height), side, stride)
    return unpad(boxes, r, left, top, width, height)


def latest(tiles: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    return tiles.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def clamp_view(x: Column, origin: Column, view: int, tile: int) -> Column:
    """Origin of a view inside its tile."""
    return F.greatest(F.lit(0), F.least(x - origin, F.lit(max(0, tile - view))))


def nearest_tile(points: DataFrame, tiles: DataFrame, keys: list[str], reach: int = max(TILE_W, TILE_H)) -> DataFrame:
    """Each point's tile with the nearest centre, the lower tile on ties, wherever the tiles lie.

    Tile centres go to the nine cells of width `reach` around them, so a point sees every tile within reach in its own cell.
    What it finds there is right if it is no farther than reach; points that found nothing so near look again at twice the reach.
    """
    t = tiles.select("slide_id", "tile_idx", (F.col("position_x") + TILE_W / 2).alias("tx"), (F.col("position_y") + TILE_H / 2).alias("ty"))
    ends = lambda df, *c: df.agg(*(f(x) for x in c for f in (F.min, F.max))).first()
    a, b = ends(t, "tx", "ty"), ends(points, "x", "y")
    if None in (*a, *b):
        return points.select("slide_id", *keys, F.lit(None).cast("int").alias("tile_idx"), F.lit(None).cast("double").alias("dist2")).limit(0)
    widest = max(max(a[k + 1], b[k + 1]) - min(a[k], b[k]) for k in (0, 2))
    step, out, left = F.sequence(F.lit(-1), F.lit(1)), None, points
    while True:
        cell = lambda c: F.floor(F.col(c) / reach)  # noqa: B023, E731
        around = t.withColumn("_a", F.explode(step)).withColumn("_b", F.explode(step)).select("slide_id", "tile_idx", "tx", "ty", (cell("tx") + F.col("_a")).alias("_u"), (cell("ty") + F.col("_b")).alias("_v"))
        dist = (F.col("x") - F.col("tx")) * (F.col("x") - F.col("tx")) + (F.col("y") - F.col("ty")) * (F.col("y") - F.col("ty"))
        seen = left.withColumn("_u", cell("x")).withColumn("_v", cell("y")).join(around, ["slide_id", "_u", "_v"])
        found = seen.groupBy("slide_id", *keys).agg(F.min(F.struct(dist.alias("d"), "tile_idx")).alias("m")).select("slide_id", *keys, F.col("m.tile_idx").alias("tile_idx"), F.col("m.d").alias("dist2"))
        last = reach > widest
        found = found if last else found.where(F.col("dist2") <= float(reach) * reach)
        if last and out is None:
            return found
        found = _cut(found)
        out = found if out is None else out.unionByName(found)
        left = left.join(found, ["slide_id", *keys], "left_anti")
        if last or left.isEmpty():
            return out
        reach *= 2


def received() -> Column:
    """Places that an upload with a payload has filled."""
    return F.count_distinct(F.when(F.col("n_bytes") > 0, F.struct("row_index", "col_index")))


def of_grid(uploads: DataFrame, grid) -> DataFrame:
    """uploads with rows and cols of their task's grid.  grid: (rows, cols) for all tasks, or a table (task_id, rows, cols); tasks that it lacks go."""
    if isinstance(grid, tuple):
        return uploads.withColumn("rows", F.lit(grid[0])).withColumn("cols", F.lit(grid[1]))
    return uploads.join(grid.select("task_id", "rows", "cols"), "task_id")


def upload_complete(uploads: DataFrame, rows, cols: int | None = None) -> DataFrame:
    """Whether every place of a task's grid has an upload with a payload.  rows: a number, or a table as of_grid() takes it."""
    own = of_grid(uploads, rows if cols is None else (rows, cols))
    return own.groupBy("task_id").agg((received() == F.max(F.col("rows") * F.col("cols"))).alias("complete"))


def upload_status(uploads: DataFrame) -> DataFrame:
    """Each upload's code: 201 without payload, 103 for a place already filled, else 0."""
    full = Window.partitionBy("task_id", "row_index", "col_index", F.col("n_bytes") > 0).orderBy("ts", "event_id")
    return uploads.withColumn("code", F.when(F.col("n_bytes") == 0, 201).when(F.row_number().over(full) > 1, 103).otherwise(0))


def progress(uploads: DataFrame, rows, cols: int | None = None) -> DataFrame:
    """Received, expected and missing places of each task, and its status (100 when complete, else 101).  rows: a number, or a table as of_grid() takes it."""
    own = of_grid(uploads, rows if cols is None else (rows, cols))
    got = own.groupBy("task_id").agg(received().alias("received"), F.max(F.col("rows") * F.col("cols")).cast("long").alias("expected"))
    return got.withColumn("missing", F.col("expected") - F.col("received")).withColumn("status", F.when(F.col("missing") == 0, 100).otherwise(101))
