"""Block scores, score heat maps and what is read off them."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilelake.operators.spatial import points_in_boxes

# What the grades 0 to 6 of a block weigh (fixed values).
WEIGHTS = [64.0, 32.0, 16.0, 8.0, 4.0, 2.0, 1.0]


def softmax(logits: Column, most: float = 32.0) -> Column:
    e = F.transform(logits, lambda x: F.exp(F.least(x, F.lit(most))))
    total = F.aggregate(e, F.lit(0.0), lambda a, b: a + b)
    return F.transform(e, lambda x: x / total)


def top_k(p: Column, k: int) -> Column:
    """Array of (class, percent), the most likely first, the lower class on ties; zero shares are left out."""
    pairs = F.transform(p, lambda x, i: F.struct((-x).alias("m"), i.alias("c")))
    best = F.slice(F.array_sort(F.filter(pairs, lambda x: x["m"] < 0)), 1, k)
    return F.transform(best, lambda x: F.struct(x["c"].cast("int").alias("type"), (-x["m"]).alias("percent")))


def argmax(a: Column) -> Column:
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def classes(df: DataFrame, scores: Column, least) -> DataFrame:
    """Rows whose best class scores at least `least`, with that class (the first on ties) as label."""
    return df.where(F.array_max(scores) >= least).withColumn("label", argmax(scores))


def mean_score(grid: DataFrame, missing: float = -1000.0) -> DataFrame:
    """Mean of each slide's valid scores, and their number."""
    valid = F.when(F.col("score") != missing, F.col("score"))
    return grid.groupBy("slide_id").agg(F.avg(valid).alias("mean_score"), F.count(valid).alias("cells"))


def off_label(blocks: DataFrame, label: int = 5) -> DataFrame:
    """Blocks of a known label other than one; 5 is a marrow particle."""
    return blocks.where(F.col("label").isNotNull() & (F.col("label") != label))


def pixel_areas(pixels: DataFrame, rects: DataFrame, keys: list[str], names: list[str], white: int = 200, red: int = 128, size: int = 256) -> DataFrame:
    """White and red pixels (px, py, white, red) of each rectangle (keys, names, x1..y2) that holds any pixel."""
    hit = points_in_boxes(pixels.withColumn("x", F.col("px")).withColumn("y", F.col("py")), rects, keys, size)
    return hit.groupBy(*keys, *names).agg(F.count_if(F.col("white") > white).alias("white_px"), F.count_if(F.col("red") > red).alias("red_px"))


def complete_blocks(blocks: DataFrame, tiles: DataFrame, rows: int, cols: int) -> DataFrame:
    """Slides that break what a full grid promises: their tiles and places, and their tiles without just four blocks."""
    four = blocks.groupBy("slide_id", "tile_idx").agg(F.count_distinct("dx", "dy").alias("n"))
    t = tiles.select("slide_id", "tile_idx").join(four, ["slide_id", "tile_idx"], "left").groupBy("slide_id").agg(F.count("*").alias("tiles"), F.count_if(F.coalesce("n", F.lit(0)) != 4).alias("odd_tiles"))
    return t.withColumn("places", F.lit(rows * cols).cast("long")).where("tiles <> places or odd_tiles > 0")


def grade(p: Column) -> Column:
    return argmax(p)


def expected_weight(p: Column) -> Column:
    """Grades 0 to 2 score their expected weight, higher grades the weight of the grade."""
    w = F.array(*map(F.lit, WEIGHTS))
    mean = F.aggregate(F.zip_with(p, w, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return F.when(argmax(p) <= 2, mean).otherwise(F.get(w, argmax(p)))


def log_score(g: Column, white: Column, red: Column) -> Column:
    """Log prior of a block from its weight, white and red pixel areas.  The constants are fixed values."""
    nine = F.when((g > 45) & (g <= 64), 0.0085 * g).when((g > 24) & (g <= 45), 0.0055 * g).otherwise(0.00016875 * g)
    s = 5.52 / 5526
    t = (s * white + (0.08 - 78 * s)) / 0.55
    total = F.greatest((0.25 * t * F.exp(-t / 2)) / 0.55, F.lit(0.0257)) + 0.1
    s = 15 / 14710
    z = s * red + (3 - 3076 * s)
    mu, sigma = 9.120618882524237 - 0.5, 4.886065801133071 - 2.5
    v = F.exp(-((z - mu) * (z - mu)) / (2 * sigma * sigma)) / (sigma * math.sqrt(2 * math.pi))
    return F.log(nine) + F.log(total) + F.log(F.greatest(v, F.lit(0.01)) + 0.15)


def heat_map(blocks: DataFrame, tiles: DataFrame) -> DataFrame:
    """Sparse score grid (slide_id, gx, gy, score, label): two cells a tile in each direction, rows flipped."""
    ext = tiles.groupBy("slide_id").agg(F.min("col_index").alias("c0"), F.max("row_index").alias("r1"))
    t = tiles.select("slide_id", "tile_idx", "row_index", "col_index").join(ext, "slide_id")
    return blocks.join(t, ["slide_id", "tile_idx"]).select(
        "slide_id", (F.col("dx") + 2 * (F.col("col_index") - F.col("c0"))).alias("gx"), (F.col("dy") + 2 * (F.col("r1") - F.col("row_index"))).alias("gy"),
        "score", "label")


def head_crop(grid: DataFrame, least: float, height: int = 0, area=None) -> DataFrame:
    """Columns with more than height // 10 cells above a score, and the width of the head crop.  The height is that of the area, if one is given."""
    from tilelake.operators.regions import at_area

    per = grid.where(F.col("score") > least).groupBy("slide_id", "gx").agg(F.count("*").alias("n"))
    per = per.where(F.col("n") > height // 10) if area is None else at_area(per, area).where(F.col("n") > F.expr("2 * (_max_row - _min_row + 1) div 10"))
    return per.groupBy("slide_id").agg(F.min("gx").alias("lo"), F.max("gx").alias("hi")).withColumn(
        "crop_w", F.expr("cast((hi - lo + 1) div 5 + lo as int)"))


def grey(grid: DataFrame) -> DataFrame:
    """Scores stretched to 0..255 by slide."""
    r = grid.groupBy("slide_id").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    return grid.join(r, "slide_id").select("slide_id", "gx", "gy", ((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-5) * 255).cast("int").alias("grey"))
