"""Lists of camera tasks: clean-up of values, order, selection and records."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Status codes and their names (fixed values).
STATUS = {100: "TASK_FINISHED", 101: "TASK_RUNNING", 102: "TASK_TIMEOUT", 103: "IMAGE_ALREADY_UPLOADED", 104: "IMAGE_DAMAGED", 105: "TASK_IN_PROGRESS",
          200: "API_SUCCESS", 201: "CLIENT_ERROR"}


def to_int(c: Column, default=None) -> Column:
    return F.coalesce(c.try_cast("int"), F.lit(default).cast("int"))


def to_float(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(default))


def view_type(c: Column) -> Column:
    """wbc or meg if the text holds it, else null."""
    v = F.lower(F.trim(c))
    return F.when(v.contains("wbc"), "wbc").when(v.contains("meg"), "meg")


def status_name(code: Column, unknown: str = "UNKNOWN") -> Column:
    return F.coalesce(*(F.when(code == k, v) for k, v in STATUS.items()), F.lit(unknown))


def pairs_of(flat: Column) -> Column:
    """[x1, y1, x2, y2, ...] as pairs; a list of odd length gives none."""
    none = F.array().cast("array<array<double>>")
    pairs = F.transform(F.sequence(F.lit(1), F.size(flat), F.lit(2)), lambda i: F.slice(flat, i, F.lit(2)))
    return F.when((F.size(flat) == 0) | (F.size(flat) % 2 == 1), none).otherwise(pairs)


def points_of(rows: Column) -> Column:
    """First two values of each row of at least two; boxes (four values or more) give their centres."""
    mid = lambda r, i: (F.get(r, F.lit(i)) + F.get(r, F.lit(i + 2))) / 2
    return F.transform(F.filter(rows, lambda r: F.size(r) >= 2), lambda r: F.when(F.size(r) >= 4, F.array(mid(r, 0), mid(r, 1))).otherwise(F.slice(r, 1, 2)))


def point_of_map(m: Column) -> Column:
    """(x, y) of a map with x, cx or cell_x and the like; null where one is absent."""
    at = lambda c: F.coalesce(*(F.try_element_at(m, F.lit(p + c)) for p in ("", "c", "cell_")))
    return F.when(at("x").isNotNull() & at("y").isNotNull(), F.array(at("x"), at("y")))


def edge_action(response: Column) -> Column:
    """What happens to a matched edge by its response."""
    return F.when(response < -1.5, "retry").when(response < -0.5, "drop").otherwise("keep")


def display_order(tasks: DataFrame, keys: list[str]) -> DataFrame:
    """display: the place by sort_id (tasks without one last), then y, then x."""
    by = (to_int(F.col("sort_id"), 10**9), to_float(F.col("view_pos_y")), to_float(F.col("view_pos_x")), F.col("task_id"))
    return tasks.withColumn("display", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)))


def shown_tasks(tasks: DataFrame, keys: list[str], most_meg: int = 50) -> DataFrame:
    """All wbc tasks and the first meg tasks in display order."""
    return display_order(tasks, [*keys, "view_type"]).where((F.col("view_type") == "wbc") | ((F.col("view_type") == "meg") & (F.col("display") <= most_meg)))


def tasks_by_tile(tasks: DataFrame) -> DataFrame:
    """Tasks of each kind on each tile, with the rows and columns that the slide's tasks span."""
    kind = lambda k: F.count_if(F.col("view_type") == k).alias(k)
    per = tasks.where(F.col("row_index").isNotNull() & F.col("col_index").isNotNull() & F.col("view_type").isNotNull()).groupBy("slide_id", "row_index", "col_index").agg(kind("wbc"), kind("meg"))
    span = per.groupBy("slide_id").agg(*(f(c).alias(f"{n}_{c[:3]}") for c in ("row_index", "col_index") for n, f in (("min", F.min), ("max", F.max))))
    return per.join(span, "slide_id")


def on_wbc_tiles(tasks: DataFrame, tiles: DataFrame) -> DataFrame:
    """Tasks with the places of their tiles, for the tiles that have a wbc task."""
    keys = ["slide_id", "row_index", "col_index"]
    return tasks.join(tiles.select(*keys, "tile_idx", "position_x", "position_y"), keys).join(tasks.where("view_type = 'wbc'").select(*keys), keys, "left_semi")


def records(views: DataFrame, cells: DataFrame, tiles: DataFrame, last_row, kind: str = "wbc") -> DataFrame:
    """Task records of views (slide_id, region, view_id, x, y, w, h) and the cells assigned to them (slide_id, view_id, cx, cy, cw, ch).

    sort_id counts by x, y within a region before views outside all tiles are left out, so it may have gaps.  Cell boxes
    start half their rounded size before the centre.  A view's cells are few by its size.  last_row: the row from which
    rows count, or the user area whose last one it is.
    """
    from tilelake.operators.regions import at_area, containing_tile

    v = views.withColumn("sort_id", F.row_number().over(Window.partitionBy("slide_id", "region").orderBy("x", "y", "view_id")))
    mid = v.select("slide_id", "view_id", (F.col("x") + 0.5 * F.col("w")).alias("x"), (F.col("y") + 0.5 * F.col("h")).alias("y"))
    v = v.join(containing_tile(mid, tiles, "view_id"), ["slide_id", "view_id"]).join(tiles.select("slide_id", "tile_idx", "row_index", "col_index", "position_x", "position_y"), ["slide_id", "tile_idx"])
    half = lambda c: F.floor(F.bround(c) / 2)
    box = F.struct((F.col("cx") - F.col("position_x") - half("cw")).cast("int").alias("cell_x"), (F.col("cy") - F.col("position_y") - half("ch")).cast("int").alias("cell_y"),
                   F.bround("cw").cast("int").alias("cell_width"), F.bround("ch").cast("int").alias("cell_height"))
    lists = cells.join(v.select("slide_id", "view_id", "position_x", "position_y"), ["slide_id", "view_id"]).groupBy("slide_id", "view_id").agg(F.array_sort(F.collect_list(box)).alias("cell_list"))
    empty = F.array().cast("array<struct<cell_x:int,cell_y:int,cell_width:int,cell_height:int>>")
    v = v.withColumn("_max_row", F.lit(last_row)) if isinstance(last_row, int) else at_area(v, last_row)
    return v.join(lists, ["slide_id", "view_id"], "left").select(
        "slide_id", "region", "sort_id", F.when(F.col("region") == 0, "False").otherwise("True").alias("Adition_shooting_flag"), (F.col("_max_row") - F.col("row_index")).alias("row_index"), "col_index",
        (F.col("x") - F.col("position_x")).cast("int").alias("view_pos_x"), (F.col("y") - F.col("position_y")).cast("int").alias("view_pos_y"), F.col("w").cast("int").alias("view_width"),
        F.col("h").cast("int").alias("view_height"), F.lit(kind).alias("view_type"), F.coalesce("cell_list", empty).alias("cell_list"))


def square_up(boxes: DataFrame, cols: int, rows: int) -> DataFrame:
    """Boxes (x, y, w, h) made square: the shorter side grows on both ends, moved to an edge it would cross, then cut by the image."""
    side, thin = F.greatest("w", "h"), F.col("h") > F.col("w")

    def moved(pos: str, short: str, limit: int) -> Column:
        grow = side - F.col(short)
        low, high = F.col(pos) - F.ceil(grow / 2), F.col(pos) + F.col(short) + F.floor(grow / 2)
        return F.when((low >= 0) & (high <= limit), low).when(high <= limit, 0).when(low >= 0, limit - side).otherwise(F.col(pos))

    x, y = F.when(thin, moved("x", "w", cols)).otherwise(F.col("x")), F.when(thin, F.col("y")).otherwise(moved("y", "h", rows))
    clip = lambda v, m: F.greatest(F.lit(0), F.least(v, F.lit(m))).cast("int")
    return boxes.select("*", clip(x, cols).alias("x1"), clip(y, rows).alias("y1"), clip(x + side, cols).alias("x2"), clip(y + side, rows).alias("y2"))


def anchors(spark, width: int = 512, height: int = 384, levels=(4, 5, 6)) -> DataFrame:
    """Anchor boxes of a detector, numbered by level, row, column, scale and ratio; a fixed small table."""
    rows, n = [], 0
    for level in levels:
        stride = 2**level
        down, across = -(-(height - stride // 2) // stride), -(-(width - stride // 2) // stride)
        rows.append((n, stride, down, across))
        n += down * across * 6
    t = spark.createDataFrame(rows, "first int, stride int, down int, across int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    t = t.withColumn("n", each("down")).withColumn("m", each("across")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5))))
    size = 2.0 * F.col("stride") * F.when(F.col("k") < 3, 1.0).otherwise(1.4142135623730951)
    share = lambda a, b: F.when(F.col("k") % 3 == 0, 1.0).when(F.col("k") % 3 == 1, a).otherwise(b)
    mid = lambda c: (F.col("stride") / 2 + F.col(c) * F.col("stride"))
    return t.select((F.col("first") + (F.col("n") * F.col("across") + F.col("m")) * 6 + F.col("k")).alias("anchor"), mid("m").alias("ax"), mid("n").alias("ay"),
                    (size * share(1.2, 0.8)).alias("aw"), (size * share(0.8, 1.2)).alias("ah"))


def decode_boxes(raw: DataFrame, least: float, cols: int, rows: int, width: int = 512, height: int = 384) -> DataFrame:
    """Boxes on the image from (anchor, score, r0..r3) of a detector; both centres move by the anchor's height."""
    a = raw.where(F.col("score") > least).join(F.broadcast(anchors(raw.sparkSession, width, height)), "anchor")
    w, h = F.exp("r3") * F.col("aw"), F.exp("r2") * F.col("ah")
    x, y = F.col("r1") * F.col("ah") + F.col("ax"), F.col("r0") * F.col("ah") + F.col("ay")
    whole = lambda c: c.cast("int")
    a = a.withColumn("_x", whole(F.greatest(x - w / 2, F.lit(0.0)))).withColumn("_y", whole(F.greatest(y - h / 2, F.lit(0.0))))
    a = a.withColumn("_w", whole(F.least(w, F.lit(height - 1.0)))).withColumn("_h", whole(F.least(h, F.lit(width - 1.0))))
    at = lambda e, n, m: F.expr(f"cast(({e}) * {n} div {m} as int)")
    return a.withColumn("x1", at("_x", cols, width)).withColumn("y1", at("_y", rows, height)).withColumn("x2", at("_x + _w", cols, width)).withColumn("y2", at("_y + _h", rows, height)).drop(
        "_x", "_y", "_w", "_h", "ax", "ay", "aw", "ah")


def roi_tasks(cells: DataFrame, box: tuple[int, int, int, int], kind: str = "WBC", page: int = 1000, offset: int = 0, tasks: int = 100) -> DataFrame:
    """The simple task list: one view a slide, a region with all its cells, in pages of its list.

    (slide_id, task_index, view_type, x1..y2 of the region, page, cell_list): cells (slide_id, cell_id, x1..y2, label, score) that touch the region, in
    order of id and tile, `page` of them a row, so no row grows with the region.  A slide without cells there has one page with an empty
    list.  Tasks are counted from 0; `offset` and `tasks` cut the list of tasks.
    """
    from tilelake.operators.tiles import in_roi

    order = Window.partitionBy("slide_id").orderBy("cell_id", "tile_idx")
    held = in_roi(cells, *box).withColumn("_n", F.row_number().over(order) - 1)
    cell = F.struct("_n", "cell_id", "tile_idx", "label", "score", "x1", "y1", "x2", "y2")
    pages = held.groupBy("slide_id", F.expr(f"cast(_n div {page} as int)").alias("page")).agg(F.array_sort(F.collect_list(cell)).alias("c"))
    pages = pages.select("slide_id", "page", F.transform("c", lambda c: c.dropFields("_n")).alias("cell_list"))
    out = cells.select("slide_id").distinct().join(pages, "slide_id", "left")
    lits = [F.lit(v).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), box)]
    out = out.select("slide_id", F.lit(0).alias("task_index"), F.lit(kind).alias("view_type"), *lits, F.coalesce("page", F.lit(0)).alias("page"), F.coalesce("cell_list", F.array().cast(pages.schema["cell_list"].dataType)).alias("cell_list"))
    return out.where((F.col("task_index") >= offset) & (F.col("task_index") < offset + tasks))
