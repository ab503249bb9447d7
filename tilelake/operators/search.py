"""Search for regions of a slide's score grid: rotated windows of many sizes, and the best region among them."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tilelake.operators.cover import rect_sizes
from tilelake.operators.regions import AREA_COLUMNS, at_area, cells_of_regions, in_quad, most_uniform, near_target
from tilelake.operators.tiles import TILE_H, TILE_W
from tilelake.session import cut as _cut
from tilelake.session import ship

ANGLES = (0, 15, 75)
MISSING = -1000.0
CORNERS = ("lt", "rt", "rb", "lb")
# Window areas in tiles (fixed values): 4 to 20, then wider steps.
MAGNITUDES = (*range(4, 21), 25, 30, 40, 60, 80, 100, 120, 160, 200, 300, 400)


def all_sizes() -> list[tuple[int, int]]:
    """Every window size that is searched, in grid cells."""
    return rect_sizes(MAGNITUDES)


def runs(w: int, h: int, angle: float) -> list[tuple[int, int, int]]:
    """The cells of a rotated window around its middle as one interval a row: (dy, first dx, last dx)."""
    reach = int(math.hypot(w, h) / 2 + 1)
    dx, dy = np.meshgrid(np.arange(-reach, reach + 1), np.arange(-reach, reach + 1))
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    inside = (np.abs(dx * c + dy * s) <= w / 2) & (np.abs(dy * c - dx * s) <= h / 2)
    return [(int(y[0]), int(x[on].min()), int(x[on].max())) for x, y, on in zip(dx, dy, inside) if on.any()]


def best_place(value: np.ndarray, there: np.ndarray, w: int, h: int, angle: float) -> tuple[int, int, float]:
    """(cx, cy, mean) of the best place of one window on a grid; value and there are row-wise running sums, a zero first.

    Every row of the window takes two look-ups in the running sums at each place.
    """
    height, width = value.shape[0], value.shape[1] - 1
    own = runs(w, h, angle)
    r = max(max(abs(v) for v in run) for run in own)
    cx = np.arange(-r, width + r)
    total, count = np.zeros((height + 2 * r, width + 2 * r)), np.zeros((height + 2 * r, width + 2 * r), np.int64)
    for dy, lo, hi in own:
        start, end = np.clip(cx + lo, 0, width), np.clip(cx + hi + 1, 0, width)
        at = slice(r - dy, r - dy + height)  # the places whose row dy is a row of the grid
        total[at] += value[:, end] - value[:, start]
        count[at] += there[:, end] - there[:, start]
    mean = (total + MISSING * (sum(hi - lo + 1 for _, lo, hi in own) - count)) / (w * h)
    y, x = np.unravel_index(np.round(mean, 9).argmax(), mean.shape)
    return int(x) - r, int(y) - r, float(mean[y, x])


def rotated_windows(grid: DataFrame, sizes: list[tuple[int, int]], area, angles=ANGLES, together: int = 48) -> DataFrame:
    """Where each window's mean score is greatest: (slide_id, kernel, w, h, angle, cx, cy, area_score).

    Absent cells count as MISSING, and the mean is over w * h; of equal means the first in order of rows counts.  Windows whose
    side exceeds a slide's grid are left out for that slide.  A slide's grid is a scanner's table of blocks; it goes
    to several tasks with `together` windows each, so the work is spread over slides and sizes.
    """
    ship(grid.sparkSession)
    table = [(k, w, h, a) for k, (w, h, a) in enumerate((w, h, a) for w, h in sizes for a in angles)]
    cells = grid.where("score is not null").groupBy("slide_id").agg(F.collect_list(F.struct("gx", "gy", "score")).alias("c"))
    packed = at_area(cells, area).select("slide_id", (2 * (F.col("_max_col") - F.col("_min_col") + 1)).alias("width"), (2 * (F.col("_max_row") - F.col("_min_row") + 1)).alias("height"),
                                         "c.gx", "c.gy", "c.score")
    needs = [(int(math.hypot(w, h)) + 4) | 1 for _, w, h, _ in table]  # the least side of a grid that a window is searched on
    least = F.array(*(F.lit(min(needs[k:k + together])) for k in range(0, len(table), together)))
    held = F.filter(F.transform(least, lambda n, k: F.when(n <= F.least("width", "height"), k)), lambda k: k.isNotNull())
    n = int(grid.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = packed.withColumn("block", F.explode(held)).repartition(n, "slide_id", "block")
    key = grid.schema["slide_id"]
    place = best_place

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                width, height = r["width"], r["height"]
                gx, gy, score = (np.array(r[c]) for c in ("gx", "gy", "score"))
                on = (gx >= 0) & (gx < width) & (gy >= 0) & (gy < height)
                value, there = np.zeros((height, width + 1)), np.zeros((height, width + 1), np.int64)
                value[gy[on], gx[on] + 1] = score[on]
                there[gy[on], gx[on] + 1] = 1
                value, there = value.cumsum(1), there.cumsum(1)
                for k, w, h, a in table[r["block"] * together:(r["block"] + 1) * together]:
                    if needs[k] <= min(width, height):
                        out.append((r["slide_id"], k, w, h, a, *place(value, there, w, h, a)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (b.schema.field("slide_id").type, *[pa.int32()] * 6, pa.float64()))],
                                                 ["slide_id", "kernel", "w", "h", "angle", "cx", "cy", "area_score"])

    return tasks.mapInArrow(run, StructType([key]).add("kernel", "integer").add("w", "integer").add("h", "integer").add("angle", "integer").add("cx", "integer").add("cy", "integer").add("area_score", "double"))


def with_corners(windows: DataFrame) -> DataFrame:
    """windows with their corners lt, rt, rb, lb (structs x, y), clipped to the grid (_width, _height); sorted by y, then by x in each half."""
    c, s = F.cos(F.radians("angle")), F.sin(F.radians("angle"))
    fit = lambda v, n: F.greatest(F.lit(0.0), F.least(v, n - 1.0))

    def corner(a, b):
        u, v = F.col("w") * (a / 2), F.col("h") * (b / 2)
        return F.struct(fit(F.col("cy") + u * s + v * c, F.col("_height")).alias("y"), fit(F.col("cx") + u * c - v * s, F.col("_width")).alias("x"))

    pts = F.array_sort(F.array(*(corner(a, b) for a in (-1, 1) for b in (-1, 1))))
    by_x = lambda half: F.array_sort(F.transform(half, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))
    t = windows.withColumn("_t", by_x(F.slice(pts, 1, 2))).withColumn("_b", by_x(F.slice(pts, 3, 2)))
    at = lambda c, i: F.get(c, F.lit(i))
    return t.select(*windows.columns, at("_t", 0).alias("lt"), at("_t", 1).alias("rt"), at("_b", 1).alias("rb"), at("_b", 0).alias("lb"))


def corner_pairs(prefix: str = "") -> list[tuple[Column, Column]]:
    return [(F.col(f"{prefix}{c}.x"), F.col(f"{prefix}{c}.y")) for c in CORNERS]


def cells_of_windows(windows: DataFrame) -> DataFrame:
    """(slide_id, id, gx, gy): grid cells inside each window with corners, borders included."""
    end = lambda f, n: f(*(F.col(f"{c}.{n}") for c in CORNERS))
    rng = lambda n: F.explode(F.sequence(F.floor(end(F.least, n)).cast("int"), F.ceil(end(F.greatest, n)).cast("int")))
    w = windows.select("slide_id", "id", *CORNERS, rng("x").alias("gx")).select("slide_id", "id", *CORNERS, "gx", rng("y").alias("gy"))
    return w.where(in_quad(F.col("gx"), F.col("gy"), corner_pairs())).select("slide_id", "id", "gx", "gy")


def search(grid: DataFrame, crop: DataFrame, cells_per_tile: DataFrame, sizes: list[tuple[int, int]], area, target: int, orientation: int = 1) -> DataFrame:
    """Candidate regions of every slide: one for each size and angle, with its cells, and `head`: whether its end lies in the head crop.

    A slide with no more cells than the target has one candidate, its whole grid.  crop: (slide_id, lo, hi, crop_w); the head is
    on the right for orientation 0, on the left for 1.  area: a user area for all slides (dict), or a table with each one's.
    """
    sized = lambda df: at_area(df, area).withColumn("_width", 2 * (F.col("_max_col") - F.col("_min_col") + 1)).withColumn("_height", 2 * (F.col("_max_row") - F.col("_min_row") + 1)).drop(*AREA_COLUMNS)
    totals = cells_per_tile.groupBy("slide_id").agg(F.sum("cells").alias("total"))
    found = with_corners(sized(_cut(rotated_windows(grid, sizes, area)))).drop("_width", "_height")
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    zero, right, low = F.lit(0), F.col("_width") - 1, F.col("_height") - 1
    whole = sized(grid.groupBy("slide_id").agg(F.avg("score").alias("area_score"))).select(
        "slide_id", F.lit(-1).alias("kernel"), F.col("_width").alias("w"), F.col("_height").alias("h"), F.lit(0).alias("angle"), F.expr("_width div 2").cast("int").alias("cx"), F.expr("_height div 2").cast("int").alias("cy"), "area_score",
        *(point(x, y).alias(c) for c, (x, y) in zip(CORNERS, ((zero, zero), (right, zero), (right, low), (zero, low)))))
    small = F.col("total") <= target
    c = found.join(totals.where(~small), "slide_id").unionByName(whole.join(totals.where(small), "slide_id")).withColumnRenamed("kernel", "id")
    counted = cells_of_regions(cells_of_windows(c), cells_per_tile, ["slide_id", "id"], area)
    c = c.join(counted, ["slide_id", "id"]).join(crop.select("slide_id", "lo", "hi", "crop_w"), "slide_id", "left")
    xs = [F.col(f"{k}.x") for k in CORNERS]
    start = F.col("hi") - F.col("crop_w") + F.col("lo") if orientation == 0 else F.col("lo")
    end = F.greatest(*xs) if orientation == 0 else F.least(*xs) if orientation == 1 else F.lit(-1.0)
    head = (F.col("id") < 0) | F.coalesce((end >= start) & (end <= start + F.col("crop_w")), F.lit(False))
    return c.withColumn("head", head).withColumn("diff", F.col("cells") - target).drop("lo", "hi", "crop_w")


def pixel_corners(regions: DataFrame, tiles: DataFrame, area) -> DataFrame:
    """regions with the corners lt, rt, rb, lb in pixels: those of the tiles under them, the far ones by a tile more."""
    t = tiles.select("slide_id", F.col("col_index").alias("_ix"), F.col("row_index").alias("_iy"), "position_x", "position_y")
    out = at_area(regions, area)
    for c in CORNERS:
        far_x, far_y = TILE_W * (c[1] == "t" and c[0] == "r" or c == "rb"), TILE_H * ("b" in c)
        out = out.withColumn("_ix", F.floor(F.col(f"{c}.x") / 2).cast("int") + F.col("_min_col")).withColumn("_iy", F.col("_max_row") - F.floor(F.col(f"{c}.y") / 2).cast("int"))
        out = out.join(t, ["slide_id", "_ix", "_iy"], "left")
        # where a tile is missing, its place on the regular grid stands for it
        x, y = F.coalesce("position_x", F.col("_ix") * (TILE_W * 9 // 10)), F.coalesce("position_y", F.col("_iy") * (TILE_H * 9 // 10))
        out = out.withColumn(f"p{c}", F.struct((x + far_x).alias("x"), (y + far_y).alias("y"))).drop("_ix", "_iy", "position_x", "position_y")
    return out.drop(*AREA_COLUMNS)


def region_uniformity(regions: DataFrame, cells: DataFrame, bin_px: int = 20, view: tuple[int, int] = (384, 283)) -> DataFrame:
    """uniformity of each region (slide_id, id, plt, prt, prb, plb): share of its bins with a cell of it in the view around them."""
    kw, kh = view[0] // bin_px, view[1] // bin_px
    corner = [F.col(f"p{c}") for c in CORNERS]
    turn = list(zip(corner, [*corner[1:], corner[0]]))
    size = F.abs(sum(a["x"].cast("double") * b["y"] - b["x"].cast("double") * a["y"] for a, b in turn)) / 2 / (bin_px * bin_px)
    r = regions.select("slide_id", "id", *(f"p{c}" for c in CORNERS), F.greatest(size, F.lit(1.0)).alias("_bins"))
    inside = cells.join(r, "slide_id").where(in_quad(F.col("x"), F.col("y"), corner_pairs("p")))
    bins = inside.select("slide_id", "id", "_bins", F.floor(F.col("x") / bin_px).alias("mx"), F.floor(F.col("y") / bin_px).alias("my")).distinct()
    rows = bins.select("slide_id", "id", "_bins", "mx", F.explode(F.sequence(F.col("my") - (kh - 1 - kh // 2), F.col("my") + kh // 2)).alias("row"))  # of a bin that comes twice in a row the first counts for nothing, as the gap is 0
    gap = F.lead("mx").over(Window.partitionBy("slide_id", "id", "row").orderBy("mx")) - F.col("mx")
    lit = rows.withColumn("n", F.least(F.coalesce(gap, F.lit(kw)), F.lit(kw))).groupBy("slide_id", "id").agg((F.sum("n") / F.first("_bins")).alias("uniformity"))
    return regions.join(lit, ["slide_id", "id"], "left").withColumn("uniformity", F.coalesce("uniformity", F.lit(0.0)))


def best_region(candidates: DataFrame, cells: DataFrame, tiles: DataFrame, area, target: int, top: int = 3) -> DataFrame:
    """The region of each slide: of its candidates off the head (of all, where there is none) those nearest the target, of these the
    `top` of the best area score, and of these the most uniform one."""
    off = candidates.groupBy("slide_id").agg(F.max((~F.col("head")).cast("int")).alias("_off"))
    c = candidates.join(off, "slide_id").where(~F.col("head") | (F.col("_off") == 0)).drop("_off")
    near = near_target(c.drop("total"), candidates.select("slide_id", "total").distinct(), ["slide_id"], target)
    leading = near.withColumn("_n", F.row_number().over(Window.partitionBy("slide_id").orderBy(F.desc("area_score"), "id"))).where(F.col("_n") <= top).drop("_n")
    scored = region_uniformity(pixel_corners(leading, tiles, area), cells)
    return scored.join(most_uniform(scored, ["slide_id"], top).select("slide_id", "id"), ["slide_id", "id"], "left_semi")
