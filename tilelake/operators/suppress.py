"""Greedy suppression of overlapping boxes, exact and parallel.

An edge u -> v says that u outranks v and overlaps it too much.  Greedy suppression keeps u unless something kept
outranks it.  A round keeps every box without a live edge into it, suppresses what those point at, and drops the edges
of suppressed boxes; the result equals the sequential one, in as many rounds as the longest chain of suppressions.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilelake.functions.geometry import area, iou, over_smaller
from tilelake.operators.spatial import adjacent_tiles, box_pairs
from tilelake.session import cut as _cut

BOX = ("x1", "y1", "x2", "y2")


def suppressed(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, v) of the suppressed boxes.

    One checkpoint a round: the live edges, marked where nothing live points at their source.  Every round settles the
    best box of each group of live edges at least, so the rounds end however long a chain is.
    """
    live, out = _cut(edges.select(*keys, "u", "v")), None  # found once: a round reads them twice
    while True:
        low = live.select(*keys, F.col("v").alias("u")).distinct().withColumn("_low", F.lit(True))
        marked = _cut(live.join(low, [*keys, "u"], "left").withColumn("_low", F.col("_low").isNotNull()))
        new = marked.where("not _low").select(*keys, "v").distinct()
        out = new if out is None else out.unionByName(new)
        rest = marked.where("_low").drop("_low")
        if rest.isEmpty():
            return out
        live = rest.join(new.withColumnRenamed("v", "u"), [*keys, "u"], "left_anti").join(new, [*keys, "v"], "left_anti")


def conflicts(boxes: DataFrame, keys: list[str], threshold: float, size: int, measure=iou) -> DataFrame:
    """Edges among boxes (keys, id, score, x1..y2) of equal keys; ties of score go to the smaller id."""
    side = lambda p, n: boxes.select(*keys, F.col("id").alias(n), F.col("score").alias(p + "s"), *(F.col(c).alias(p + c) for c in BOX))
    higher = (F.col("as") > F.col("bs")) | ((F.col("as") == F.col("bs")) & (F.col("u") < F.col("v")))
    a, b = (tuple(p + c for c in BOX) for p in "ab")
    return box_pairs(side("a", "u"), side("b", "v"), keys, size, higher & (measure(a, b) > threshold)).select(*keys, "u", "v")


def nms(boxes: DataFrame, keys: list[str], threshold: float, size: int, measure=iou) -> DataFrame:
    """The boxes that greedy suppression keeps within each key."""
    gone = suppressed(conflicts(boxes, keys, threshold, size, measure), keys).withColumnRenamed("v", "id")
    return boxes.join(gone, [*keys, "id"], "left_anti")


def contained(boxes: DataFrame, keys: list[str], threshold: float, size: int) -> DataFrame:
    """Larger boxes first; a box goes if its overlap with a kept one exceeds a share of the smaller of both."""
    return nms(boxes.withColumn("score", area(BOX)), keys, threshold, size, over_smaller)


def first_of_equal(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Of exactly equal boxes the one with the smallest id."""
    return boxes.groupBy(*keys, *BOX).agg(F.min("id").alias("id"))


def cross_tile_dedup(detections: DataFrame, tiles: DataFrame, threshold: float = 0.2, width: int = 2448, height: int = 2048) -> DataFrame:
    """Detections (nucleated, global boxes) that survive in every pair of neighbouring tiles.

    In each pair only boxes that touch the overlap of both tiles take part, and pairs are independent of each other.
    """
    place = tiles.select("slide_id", "tile_idx", "position_x", "position_y")
    boxes = detections.where("label = 0").join(place, ["slide_id", "tile_idx"]).select(
        "slide_id", "tile_idx", "cell_id", "score", (F.col("x1") + F.col("position_x")).alias("x1"), (F.col("y1") + F.col("position_y")).alias("y1"),
        (F.col("x2") + F.col("position_x")).alias("x2"), (F.col("y2") + F.col("position_y")).alias("y2"),
        F.struct("tile_idx", "cell_id").alias("id"))
    pairs = adjacent_tiles(tiles).select(
        "slide_id", "ti", "tj", F.greatest("ix", "jx").alias("_l"), F.greatest("iy", "jy").alias("_t"),
        (F.least("ix", "jx") + width).alias("_r"), (F.least("iy", "jy") + height).alias("_b"))
    both = pairs.withColumn("tile_idx", F.explode(F.array("ti", "tj")))
    touch: Column = (F.col("x1") < F.col("_r")) & (F.col("x2") > F.col("_l")) & (F.col("y1") < F.col("_b")) & (F.col("y2") > F.col("_t"))
    band = both.join(boxes, ["slide_id", "tile_idx"]).where(touch & (F.col("_l") < F.col("_r")) & (F.col("_t") < F.col("_b")))
    gone = suppressed(conflicts(band, ["slide_id", "ti", "tj"], threshold, 64), ["slide_id", "ti", "tj"])
    return boxes.join(gone.select("slide_id", F.col("v").alias("id")).distinct(), ["slide_id", "id"], "left_anti").drop("id")


# Least score and threshold of each preset (fixed values).
PRESETS = {"meg_40x": (0.45, 0.7), "meg_100x": (0.6, 0.3), "wbc_100x": (0.3, 0.2), "sub_tile": (0.5, 0.45)}


def per_class(boxes: DataFrame, keys: list[str], threshold: float, size: int, agnostic: bool = False) -> DataFrame:
    """nms() within each label (regardless of it if agnostic), numbered by score, then place: `place` from 1 in each key."""
    kept = nms(boxes, keys if agnostic else [*keys, "label"], threshold, size)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), *BOX, "id")))


def meg_boxes(boxes: DataFrame, keys: list[str], threshold: float = 0.9, size: int = 512) -> DataFrame:
    """Of exactly equal boxes the first one; then larger boxes suppress those that they overlap almost wholly."""
    first = boxes.join(first_of_equal(boxes, keys).select(*keys, "id"), [*keys, "id"], "left_semi")
    return nms(first.withColumn("score", area(BOX)), keys, threshold, size)


def preset(boxes: DataFrame, keys: list[str], name: str, size: int = 512) -> DataFrame:
    """Boxes above a preset's score, suppressed at its threshold."""
    least, threshold = PRESETS[name]
    return nms(boxes.where(F.col("score") > least), keys, threshold, size)


def best_scores(boxes: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The `most` boxes of the best score in each key, the smaller id on ties, with their rank."""
    return boxes.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))).where(F.col("rank") <= most)


def post_process(raw: DataFrame, keys: list[str], least: float = 0.4, threshold: float = 0.6, most: int = 30000, most_kept: int = 2000, agnostic: bool = True,
                 size: int = 64) -> DataFrame:
    """Boxes from a detector's output (id, cx, cy, w, h, p: the score of each class).

    Each takes its best class and that score; those of at least `least` and, of these, the best `most` of an image, are suppressed
    (regardless of class if agnostic), and the first `most_kept` by score and place stay, numbered by `place`.
    """
    score = F.array_max("p")
    boxes = raw.where(score >= least).select(
        *keys, "id", score.alias("score"), (F.array_position("p", score) - 1).cast("int").alias("label"), (F.col("cx") - F.col("w") / 2).alias("x1"), (F.col("cy") - F.col("h") / 2).alias("y1"),
        (F.col("cx") + F.col("w") / 2).alias("x2"), (F.col("cy") + F.col("h") / 2).alias("y2"))
    return per_class(best_scores(boxes, keys, most).drop("rank"), keys, threshold, size, agnostic).where(F.col("place") <= most_kept)
