"""The part of a region to capture first, and the strips that extend it to the rest.

Cells of the region are taken in order of score, best first, and joined to the parts of their eight neighbours (a component tree, kept by
union-find with the size and bounds of each part).  After each level of equal scores the largest part is known, so the
level whose largest part holds the wanted number of cells is found exactly, in one pass.

The strips come from running sums over the grid in both directions: what the rectangle grows by is all inside it
afterwards, so the cells left beside it are counted by four look-ups a side, and nothing is ever marked as taken.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilelake.operators.regions import AREA_COLUMNS, at_area
from tilelake.operators.search import cells_of_windows
from tilelake.session import ship, spread


class Parts:
    """Union-find over grid cells that come one after the other; each part has its size, bounds and first cell in order of rows."""

    def __init__(self, height: int, width: int):
        self.width, self.height = width, height
        self.above: dict[int, int] = {}
        self.size: dict[int, int] = {}
        self.bounds: dict[int, tuple[int, int, int, int]] = {}
        self.first: dict[int, int] = {}
        self.largest: int | None = None

    def root(self, c: int) -> int:
        while self.above[c] != c:
            self.above[c] = c = self.above[self.above[c]]
        return c

    def add(self, c: int) -> None:
        y, x = divmod(c, self.width)
        self.above[c], self.size[c], self.bounds[c], self.first[c] = c, 1, (x, y, x, y), c
        for v in range(max(0, y - 1), min(self.height, y + 2)):
            for u in range(max(0, x - 1), min(self.width, x + 2)):
                if v * self.width + u in self.above:
                    self.join(c, v * self.width + u)
        self.lead(self.root(c))

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a == b:
            return
        if self.size[a] < self.size[b]:
            a, b = b, a
        self.above[b] = a
        self.size[a] += self.size[b]
        p, q = self.bounds[a], self.bounds[b]
        self.bounds[a] = (min(p[0], q[0]), min(p[1], q[1]), max(p[2], q[2]), max(p[3], q[3]))
        self.first[a] = min(self.first[a], self.first[b])

    def lead(self, r: int) -> None:
        """r is the largest part if it is larger than the one so far, or as large and begins before it."""
        old = self.largest if self.largest is None else self.root(self.largest)
        if old is None or (-self.size[r], self.first[r]) < (-self.size[old], self.first[old]):
            old = r
        self.largest = old


def levels(score: np.ndarray, inside: np.ndarray, low: float, high: float):
    """For each score above `low`, best first (all above `high` together): (score, bounds of the largest part of cells at least as good)."""
    at = np.flatnonzero(inside & (score > low))
    value = np.minimum(score.ravel()[at], high)
    order = np.lexsort((at, -value))
    parts = Parts(*score.shape)
    for k, i in enumerate(order):
        parts.add(int(at[i]))
        if k + 1 == len(order) or value[order[k + 1]] != value[i]:
            yield float(value[i]), parts.bounds[parts.root(parts.largest)]


def first_part(score, inside, usable, tile, cells, area_score: float, target: int, ratio: float):
    """(level, bounds) of the part to capture first, or None.

    Of the levels whose part holds the target within `ratio` the one nearest to it, the higher one on ties; where there is none the
    first that holds the target, else the last.  Levels lie between the region's score less 7 and 0.
    """
    best, seen, held, last = None, None, 0, None
    for level, box in levels(score, inside, area_score - 7, 0.0):
        if box != seen:
            x1, y1, x2, y2 = seen = box
            on = usable[y1:y2 + 1, x1:x2 + 1]
            held = int(cells[np.unique(tile[y1:y2 + 1, x1:x2 + 1][on])].sum())
        within = abs(held - target) <= ratio * target
        rank = (0, abs(held - target)) if within else (1, 0) if held >= target else (2, 0)
        if best is None or rank < best[0]:
            best = (rank, level, box)
        if rank[0] == 2:
            last = (level, box)
    if best is None:
        return None
    return last if best[0][0] == 2 else best[1:]


def grown(box, marked: np.ndarray, usable: np.ndarray):
    """Strips of one cell's width (bounds) around box, until no side has anything: the side with most marked cells, else with most usable ones."""
    sums = [np.pad(a.astype(np.int64).cumsum(0).cumsum(1), ((1, 0), (1, 0))) for a in (marked, usable)]
    height, width = usable.shape

    def held(s, x1, y1, x2, y2):
        return 0 if x1 < 0 or y1 < 0 or x2 >= width or y2 >= height else int(s[y2 + 1, x2 + 1] - s[y1, x2 + 1] - s[y2 + 1, x1] + s[y1, x1])

    x1, y1, x2, y2 = box
    while True:
        sides = ((x1, y1 - 1, x2, y1 - 1), (x1, y2 + 1, x2, y2 + 1), (x1 - 1, y1, x1 - 1, y2), (x2 + 1, y1, x2 + 1, y2))
        for s in sums:
            most, neg = max((held(s, *side), -k) for k, side in enumerate(sides))
            if most:
                break
        else:
            return
        strip = sides[-neg]
        x1, y1, x2, y2 = min(x1, strip[0]), min(y1, strip[1]), max(x2, strip[2]), max(y2, strip[3])
        if held(sums[1], *strip):
            yield strip


def strips(first: DataFrame, grid: DataFrame, area) -> DataFrame:
    """(slide_id, step, x1, y1, x2, y2): the strips by which each slide's first rectangle (x1..y2, ends included) grows over its grid.

    grid: (slide_id, gx, gy, marked, usable); see grown().  One slide's grid is one group, as in capture().
    """
    ship(grid.sparkSession)
    box = first.select("slide_id", *(F.col(c).alias(f"_{c}") for c in ("x1", "y1", "x2", "y2")))
    rows = at_area(grid.select("slide_id", "gx", "gy", "marked", "usable").join(box, "slide_id"), area)
    grow = grown

    def one(key, t):
        bound = {c: int(t[c].iloc[0]) for c in AREA_COLUMNS}
        width, height = 2 * (bound["_max_col"] - bound["_min_col"] + 1), 2 * (bound["_max_row"] - bound["_min_row"] + 1)
        start = tuple(int(t[f"_{c}"].iloc[0]) for c in ("x1", "y1", "x2", "y2"))
        t = t[(t.gx >= 0) & (t.gx < width) & (t.gy >= 0) & (t.gy < height)]
        marked, usable = np.zeros((height, width), bool), np.zeros((height, width), bool)
        marked[t.gy, t.gx], usable[t.gy, t.gx] = t.marked, t.usable
        out = [(key[0], k + 1, *s) for k, s in enumerate(grow(start, marked, usable))]
        return pd.DataFrame(out, columns=["slide_id", "step", "x1", "y1", "x2", "y2"])

    return spread(rows, "slide_id").groupBy("slide_id").applyInPandas(one, "slide_id long, step int, x1 int, y1 int, x2 int, y2 int")


def rectangles(score, inside, usable, tile, cells, area_score: float, target: int, ratio: float) -> list[tuple[int, int, int, int]]:
    """Bounds (x1, y1, x2, y2, ends included) of what is captured, in order."""
    found = first_part(score, inside, usable, tile, cells, area_score, target, ratio)
    if found is None or not usable.any():
        return []
    level, box = found
    return [box, *grown(box, inside & (np.minimum(score, 0.0) >= level), usable)]


def capture(region: DataFrame, grid: DataFrame, cells_per_tile: DataFrame, area, target: int, ratio: float = 0.3) -> DataFrame:
    """(slide_id, part, x, y, w, h, gx, gy): the grid cells of each rectangle to capture, part 0 first.

    Part 0 is around the largest connected part of good cells that holds the target (first_part); strips extend it (grown).
    Cells without a label or of label 5 are left out.  One slide's grid is one group: its size is that of the scanner's table.
    """
    ship(grid.sparkSession)
    members = cells_of_windows(region).select("slide_id", "gx", "gy", F.lit(True).alias("inside"))
    rows = at_area(grid.join(members, ["slide_id", "gx", "gy"], "left"), area)
    rows = rows.withColumn("ix", F.expr("gx div 2").cast("int") + F.col("_min_col")).withColumn("iy", F.col("_max_row") - F.expr("gy div 2").cast("int"))
    rows = rows.join(cells_per_tile.select("slide_id", "ix", "iy", "cells"), ["slide_id", "ix", "iy"], "left").join(region.select("slide_id", "area_score"), "slide_id")
    rows = rows.select("slide_id", "gx", "gy", "score", F.coalesce("label", F.lit(5)).alias("label"), F.coalesce("inside", F.lit(False)).alias("inside"), F.coalesce("cells", F.lit(0)).alias("cells"), "area_score", *AREA_COLUMNS)
    find = rectangles

    def one(key, t):
        bound = {c: int(t[c].iloc[0]) for c in AREA_COLUMNS}
        cols, lines = bound["_max_col"] - bound["_min_col"] + 1, bound["_max_row"] - bound["_min_row"] + 1
        width, height = 2 * cols, 2 * lines
        t = t[(t.gx >= 0) & (t.gx < width) & (t.gy >= 0) & (t.gy < height)]
        at = (t.gy.to_numpy(), t.gx.to_numpy())
        score, inside, usable = np.full((height, width), -1000.0), np.zeros((height, width), bool), np.zeros((height, width), bool)
        tile, cells = np.add.outer(np.arange(height) // 2 * cols, np.arange(width) // 2), np.zeros(cols * lines, int)
        score[at], inside[at], usable[at] = t.score, t.inside, t.inside & (t.label != 5)
        cells[tile[at]] = t.cells
        out, left = [], usable.copy()
        for k, (x1, y1, x2, y2) in enumerate(find(score, inside, usable, tile, cells, float(t.area_score.iloc[0]), target, ratio) if len(t) else []):
            ys, xs = np.nonzero(left[y1:y2 + 1, x1:x2 + 1])
            left[y1:y2 + 1, x1:x2 + 1] = False
            out += [(key[0], k, x1, y1, x2 - x1 + 1, y2 - y1 + 1, int(x1 + b), int(y1 + a)) for a, b in zip(ys, xs)]
        return pd.DataFrame(out, columns=["slide_id", "part", "x", "y", "w", "h", "gx", "gy"])

    return spread(rows, "slide_id").groupBy("slide_id").applyInPandas(one, "slide_id long, part int, x int, y int, w int, h int, gx int, gy int")
