"""Covering points with camera views, and giving points to views.

cover() divides and conquers.  Points are counted in bins of a view's size; bins that touch form components, and no view holds points of
two components.  Components of many points are split along bins; each part is covered by a task of its own, greedily and
without views to spare; and where a component was split, views whose points all have another view go.  Two shuffles of points in all,
however many views there are.
"""

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tilelake.operators.spatial import overlapping_pairs, points_in_boxes
from tilelake.session import cut as _cut
from tilelake.session import ship, spread

# Width and height shares of the candidate rectangles (fixed values).
ASPECTS = ((1.25, 1.0), (2.0, 1.0), (3.5, 1.0), (5.0, 1.0), (1.0, 1.25), (1.0, 2.0), (1.0, 3.5), (1.0, 5.0))


def rect_sizes(magnitudes, aspects=ASPECTS) -> list[tuple[int, int]]:
    """Odd rectangle sizes for each magnitude and aspect, distinct and sorted; a small table on the driver."""
    odd = lambda n: n + 1 - n % 2
    return sorted({tuple(odd(round(math.sqrt(8 * m / (a[0] * a[1])) * side)) for side in a) for m in magnitudes for a in aspects})


def _windows(x0, x1, y0, y1, w: int, h: int, ratio: float):
    """Windows at a stride ratio within bounds; of numbers or columns."""
    side = lambda a, z, size: (z - a) / max(1, int(size * ratio)) + 1
    return side(x0, x1, w) * side(y0, y1, h)


def stride_ratios(points: DataFrame, keys: list[str], w: int, h: int, ratio: float = 0.25, most: int = 20_000) -> DataFrame:
    """(keys, ratio): for each key the stride ratio at which about `most` windows lie within its points' bounds.

    A key with fewer keeps `ratio`; a wider one gets ratio times the root of the excess, at most 1.  Keys don't change one another's.
    """
    g = points.groupBy(*keys).agg(*(f(c).alias(n + c) for c in "xy" for n, f in (("a", F.min), ("z", F.max))))
    n = _windows(*(F.col(c) for c in ("ax", "zx", "ay", "zy")), w, h, ratio)
    return g.select(*keys, F.when(n <= most, F.lit(ratio)).otherwise(F.least(F.lit(1.0), ratio * F.sqrt(n / most))).alias("ratio"))


def windows_of(points: DataFrame, keys: list[str], point_id: str, w: int, h: int, ratio, closed: bool = True) -> DataFrame:
    """(keys, point_id, wx, wy): the windows of a stride grid that cover each point, borders included (the lower ones only unless closed).

    A window k starts at k * step, so those that cover x are a range of k; no window without points is ever made.  ratio:
    a number, or a column of points, such as stride_ratios() gives.
    """
    step = lambda size: F.greatest(F.lit(1), F.floor(size * ratio).cast("int")) if isinstance(ratio, Column) else F.lit(max(1, int(size * ratio)))
    low = lambda c, size, s: F.ceil((F.col(c) - size) / s) if closed else F.floor((F.col(c) - size) / s) + 1
    rng = lambda c, size, s: F.sequence(low(c, size, F.col(s)).cast("int"), F.floor(F.col(c) / F.col(s)).cast("int"))
    p = points.withColumn("_sx", step(w)).withColumn("_sy", step(h))
    return p.select(*keys, point_id, F.explode(rng("x", w, "_sx")).alias("i"), "y", "_sx", "_sy").select(*keys, point_id, "i", F.explode(rng("y", h, "_sy")).alias("j"), "_sx", "_sy").select(
        *keys, point_id, (F.col("i") * F.col("_sx")).alias("wx"), (F.col("j") * F.col("_sy")).alias("wy"))


def divide(u: np.ndarray, v: np.ndarray, n: np.ndarray, w: int, h: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(component, part) of bins (u, v) with n points each: bins that touch are one component; parts have at most `most` points, or one bin."""
    at = {(int(a), int(b)): k for k, (a, b) in enumerate(zip(u, v))}
    component = np.full(len(u), -1)
    found: list[list[int]] = []
    for start in range(len(u)):
        if component[start] < 0:
            component[start], todo, own = len(found), [start], []
            while todo:
                k = todo.pop()
                own.append(k)
                for a in (-1, 0, 1):
                    for b in (-1, 0, 1):
                        k2 = at.get((int(u[k]) + a, int(v[k]) + b))
                        if k2 is not None and component[k2] < 0:
                            component[k2] = len(found)
                            todo.append(k2)
            found.append(own)
    part, parts, todo2 = np.zeros(len(u), np.int64), 0, [np.array(own) for own in found]
    while todo2:
        own = todo2.pop()
        wide, tall = (np.ptp(u[own]) + 1) * w, (np.ptp(v[own]) + 1) * h
        axis = u if wide >= tall else v
        if n[own].sum() <= most or len(own) == 1:
            part[own] = parts
            parts += 1
            continue
        places = np.unique(axis[own])  # two at least, as the longer side has them
        if len(places) == 1:
            axis = v if axis is u else u
            places = np.unique(axis[own])
        below = np.array([n[own][axis[own] < p].sum() for p in places[1:]])
        border = places[1:][np.abs(2 * below - n[own].sum()).argmin()]
        todo2 += [own[axis[own] < border], own[axis[own] >= border]]
    return component, part


def together(part: np.ndarray, n: np.ndarray, most: int) -> np.ndarray:
    """A number for each bin, by its part (0, 1, ...): parts put together in order until they hold `most` points; no part is torn."""
    size = np.bincount(part, weights=n)
    return ((size.cumsum() - size) // most).astype(np.int64)[part]


def cover_part(x: np.ndarray, y: np.ndarray, w: int, h: int, ratio: float, most: int, closed: bool) -> list[tuple[int, int, int]]:
    """(wx, wy, points) of windows that cover all points: greedy, then without those whose points all have another window."""
    count = _windows(x.min(), x.max(), y.min(), y.max(), w, h, ratio)
    if count > most:
        ratio = min(1.0, ratio * math.sqrt(count / most))
    sx, sy = max(1, int(w * ratio)), max(1, int(h * ratio))
    first = lambda c, size, s: np.ceil((c - size) / s) if closed else np.floor((c - size) / s) + 1
    (ax, zx), (ay, zy) = ((first(c, size, s).astype(np.int64), np.floor(c / s).astype(np.int64)) for c, size, s in ((x, w, sx), (y, h, sy)))
    point, i, j = [], [], []
    for a in range(int((zx - ax).max()) + 1):
        for b in range(int((zy - ay).max()) + 1):
            on = np.flatnonzero((ax + a <= zx) & (ay + b <= zy))
            point.append(on)
            i.append(ax[on] + a)
            j.append(ay[on] + b)
    point, i, j = map(np.concatenate, (point, i, j))
    low, tall = j.min(), int(np.ptp(j)) + 1
    windows, name = np.unique(i * tall + (j - low), return_inverse=True)  # in order of i, then j
    windows = np.stack([windows // tall, windows % tall + low], 1)
    sizes = np.bincount(name, minlength=len(windows))
    holds = np.split(point[np.argsort(name, kind="stable")], np.cumsum(sizes)[:-1])
    held_by = np.split(name[np.argsort(point, kind="stable")], np.cumsum(np.bincount(point, minlength=len(x)))[:-1])
    heap = [(-n, k) for k, n in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    gains, covered, chosen = sizes.copy(), np.zeros(len(x), np.int64), []
    left = len(x)
    while left:
        gain, k = heapq.heappop(heap)
        now = -int(gains[k])
        if now == gain:
            chosen.append(k)
            for p in holds[k][covered[holds[k]] == 0]:
                gains[held_by[p]] -= 1
            covered[holds[k]] += 1
            left += now
        elif now:
            heapq.heappush(heap, (now, k))
    kept = []
    for k in reversed(chosen):
        if (covered[holds[k]] > 1).all():
            covered[holds[k]] -= 1
        else:
            kept.append(k)
    return [(int(windows[k][0]) * sx, int(windows[k][1]) * sy, len(holds[k])) for k in reversed(kept)]


def cover(points: DataFrame, keys: list[str], point_id: str, w: int, h: int, ratio: float = 0.25, most: int = 20_000, closed: bool = True, at_once: int = 4000) -> DataFrame:
    """Windows (keys, wx, wy, points) that together cover every point (x, y) of each key.

    Parts of at most `at_once` points are covered one by one; small ones come to a task together (together).  The stride of the windows is that of the part: `ratio`, or more where
    over `most` windows would lie within its bounds.  points: how many of its parts' points a window holds.  No part has more windows than the
    greedy cover of it.
    """
    spark = points.sparkSession
    ship(spark)
    bins = points.select(*keys, point_id, "x", "y").withColumn("_u", F.floor(F.col("x") / w).cast("int")).withColumn("_v", F.floor(F.col("y") / h).cast("int"))
    key_fields = [points.schema[k] for k in keys]

    def placed(key, t):
        component, part = divide(t["_u"].to_numpy(), t["_v"].to_numpy(), t["_n"].to_numpy(), w, h, at_once)
        parts = pd.Series(part).groupby(component).transform("nunique").to_numpy()
        return t.assign(_part=part, _batch=put(part, t["_n"].to_numpy(), at_once), _split=parts > 1)[[*keys, "_u", "_v", "_part", "_batch", "_split"]]

    put = together

    # bins are as many as a slide's area has views
    counted = bins.groupBy(*keys, "_u", "_v").agg(F.count("*").alias("_n"))
    parts = spread(counted, *keys).groupBy(*keys).applyInPandas(placed, StructType([*key_fields]).add("_u", "integer").add("_v", "integer").add("_part", "long").add("_batch", "long").add("_split", "boolean"))
    rows = bins.join(parts, [*keys, "_u", "_v"])
    batch = spread(rows.select(*keys, "_batch", "_part", "_split", "x", "y"), *keys, "_batch")

    def solved(key, t):
        part, split, x, y = t["_part"].to_numpy(), t["_split"].to_numpy(), t["x"].to_numpy(np.float64), t["y"].to_numpy(np.float64)
        order = np.argsort(part, kind="stable")
        found = []
        for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            found += [(*view, bool(split[own[0]])) for view in cover_part(x[own], y[own], w, h, ratio, most, closed)]
        out = pd.DataFrame(found, columns=["wx", "wy", "points", "_split"])
        for name, value in zip(keys, key):
            out[name] = value
        return out[[*keys, "wx", "wy", "points", "_split"]]

    kinds = StructType([*key_fields]).add("wx", "integer").add("wy", "integer").add("points", "long").add("_split", "boolean")
    found = batch.groupBy(*keys, "_batch").applyInPandas(lambda key, t: solved(key[:-1], t), kinds)
    found = _cut(found.groupBy(*keys, "wx", "wy").agg(F.sum("points").alias("points"), F.every("_split").alias("_split")))
    at_seams = found.where("_split")
    if at_seams.isEmpty():
        return found.drop("_split")
    near = rows.where("_split").select(*keys, point_id, "x", "y")
    return found.join(spare(near, at_seams, keys, point_id, w, h, closed), [*keys, "wx", "wy"], "left_anti").drop("_split")


def spare(points: DataFrame, windows: DataFrame, keys: list[str], point_id: str, w: int, h: int, closed: bool = True) -> DataFrame:
    """(keys, wx, wy) of windows that can go together: every point keeps a window.

    A window is a candidate while all its points have another one.  Each round drops the candidates that come first (fewest points,
    then place) among the candidates of every point of theirs, so a point loses one window a round at most.
    """
    view = [*keys, "wx", "wy"]
    boxes = windows.select(*view, F.col("wx").alias("x1"), F.col("wy").alias("y1"), (F.col("wx") + w).alias("x2"), (F.col("wy") + h).alias("y2"))
    left = _cut(points_in_boxes(points, boxes, keys, max(w, h), closed).select(*view, point_id))
    gone = None
    while True:
        many = left.groupBy(*keys, point_id).agg(F.count("*").alias("n"))
        marked = left.join(many, [*keys, point_id]).withColumn("size", F.count("*").over(Window.partitionBy(*view))).withColumn("low", F.min("n").over(Window.partitionBy(*view)))
        ready = marked.where("low > 1").withColumn("rank", F.struct("size", "wx", "wy"))
        first = ready.groupBy(*keys, point_id).agg(F.min("rank").alias("best"))
        drop = ready.join(first, [*keys, point_id]).groupBy(*view).agg(F.every(F.col("rank") == F.col("best")).alias("go")).where("go").drop("go")
        drop = _cut(drop)
        gone = drop if gone is None else gone.unionByName(drop)
        if drop.isEmpty():
            return gone
        left = _cut(left.join(drop, view, "left_anti"))


def greedy_cover(cand: DataFrame, keys: list[str], point_id: str) -> DataFrame:
    """Windows (keys, wx, wy, gain) that together cover every point of cand (keys, point_id, wx, wy).

    Each round takes every window that gains most among the windows sharing one of its uncovered points; ties go to
    the smaller window.  The result is the sequential greedy cover.  The window of the greatest gain is always taken, so the
    rounds end.
    """
    left, chosen = _cut(cand), None
    while True:
        if left.isEmpty():
            return chosen if chosen is not None else cand.select(*keys, "wx", "wy").withColumn("gain", F.lit(0).cast("long")).limit(0)
        gain = left.groupBy(*keys, "wx", "wy").agg(F.count("*").alias("gain"))
        scored = left.join(gain, [*keys, "wx", "wy"])
        best = scored.groupBy(*keys, point_id).agg(F.min(F.struct((-F.col("gain")).alias("g"), "wx", "wy")).alias("b"))
        votes = best.groupBy(*keys, F.col("b.wx").alias("wx"), F.col("b.wy").alias("wy")).agg(F.count("*").alias("votes"))
        take = _cut(votes.join(gain, [*keys, "wx", "wy"]).where("votes = gain").select(*keys, "wx", "wy", "gain"))
        chosen = take if chosen is None else chosen.unionByName(take)
        done = left.join(take, [*keys, "wx", "wy"], "left_semi").select(*keys, point_id).distinct()
        left = _cut(left.join(done, [*keys, point_id], "left_anti"))


def _turn(a, b):
    """The place of a pair of views in the order in which pairs are settled; a mixing of the numbers, so that neighbours seldom wait for each other."""
    return (a * 7919 + b * 104729) % 1000003


def settled_part(view: np.ndarray, point: np.ndarray, x: np.ndarray, y: np.ndarray, vx: np.ndarray, vy: np.ndarray, w: int, h: int, above: float) -> np.ndarray:
    """Which memberships (view, point) stay once all overlapping pairs of views have been settled in turn.  vx, vy: the view's place, of each row."""
    by_view: dict[int, dict] = {}
    place = {}
    for k in range(len(view)):
        by_view.setdefault(int(view[k]), {})[point[k]] = k
        place[int(view[k])] = (vx[k], vy[k])
    shared = set()
    of_point: dict = {}
    for k in range(len(view)):
        of_point.setdefault(point[k], []).append(int(view[k]))
    for views in of_point.values():
        views = sorted(views)
        shared.update((a, b) for i, a in enumerate(views) for b in views[i + 1:])
    pairs = []
    for a, b in shared:
        (ax, ay), (bx, by) = place[a], place[b]
        i = max(0, w - abs(ax - bx)) * max(0, h - abs(ay - by))
        if i / (2 * w * h - i) > above:
            pairs.append((_turn(a, b), a, b))
    span = lambda ks: max(np.ptp(x[ks]), np.ptp(y[ks])) if len(ks) else 0
    for _, a, b in sorted(pairs):
        own = [by_view[a], by_view[b]]
        mutual = own[0].keys() & own[1].keys()
        if mutual:
            grows = [span(list(o.values())) - span([k for p, k in o.items() if p not in mutual]) for o in own]
            for p in mutual:
                del own[1 if grows[1] > grows[0] else 0][p]
    stay = np.zeros(len(view), bool)
    stay[[k for o in by_view.values() for k in o.values()]] = True
    return stay


def settled(members: DataFrame, pairs: DataFrame, keys: list[str], view_id: str, point_id: str) -> DataFrame:
    """members (keys, view_id, point_id, x, y) once overlapping pairs (keys, a, b) have been settled in turn, all at once where they can.

    A pair is settled when it comes first among the pairs left of both its views; pairs of a round share no view.  It gives the points of both to
    the view whose span grows less by them.  The result is that of a loop over all pairs in order of _turn().
    """
    view = [*keys, view_id]
    pairs = _cut(pairs.select(*keys, "a", "b", _turn(F.col("a"), F.col("b")).alias("t")))
    while not pairs.isEmpty():
        each = pairs.select(*keys, F.explode(F.array("a", "b")).alias(view_id), F.struct("t", "a", "b").alias("p"))
        first = each.groupBy(*view).agg(F.min("p").alias("p"))
        ready = first.groupBy(*keys, "p").agg(F.count("*").alias("n")).where("n = 2").select(*keys, F.explode(F.array("p.a", "p.b")).alias(view_id), "p")
        ready = _cut(ready)
        own = members.join(ready, view).withColumn("mutual", F.count("*").over(Window.partitionBy(*keys, "p", point_id)) > 1)
        span = lambda on: F.coalesce(F.greatest(*(F.max(F.when(on, F.col(c))) - F.min(F.when(on, F.col(c))) for c in "xy")), F.lit(0))
        grow = own.groupBy(*view, "p").agg((span(F.lit(True)) - span(~F.col("mutual"))).alias("g"), F.max("mutual").alias("any"))
        pick = grow.where("any").groupBy(*keys, "p").agg(F.max(F.when(F.col(view_id) == F.col("p.a"), F.col("g"))).alias("ga"), F.max(F.when(F.col(view_id) == F.col("p.b"), F.col("g"))).alias("gb"))
        loser = pick.select(*keys, "p", F.when(F.col("gb") > F.col("ga"), F.col("p.b")).otherwise(F.col("p.a")).alias(view_id))
        lost = own.where("mutual").join(loser, [*keys, "p", view_id]).select(*view, point_id)
        members = _cut(members.join(lost, [*view, point_id], "left_anti"))
        done = ready.select(*keys, "p.a", "p.b").distinct()
        pairs = _cut(pairs.join(done, [*keys, "a", "b"], "left_anti"))
    return members


def owned(views: DataFrame, points: DataFrame, keys: list[str], view_id: str, point_id: str, w: int, h: int, above: float = 0.01, at_once: int = 20_000) -> DataFrame:
    """(keys, view_id, point_id, x, y): the points of each view (x, y), after overlapping views have settled whose the shared ones are.

    Views that touch through others form components; one with at most `at_once` memberships is settled by one task, and small ones by
    the same one (together), larger ones in rounds (settled).  Both give the same.
    """
    ship(views.sparkSession)
    boxes = views.select(*keys, view_id, F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + w).alias("x2"), (F.col("y") + h).alias("y2"))
    hit = points_in_boxes(points.select(*keys, point_id, "x", "y"), boxes, keys, max(w, h))
    hit = hit.withColumn("_u", F.floor(F.col("x1") / w).cast("int")).withColumn("_v", F.floor(F.col("y1") / h).cast("int")).select(*keys, view_id, point_id, "x", "y", "x1", "y1", "_u", "_v")
    hit = _cut(hit)
    fields = [hit.schema[k] for k in keys]

    def placed(key, t):
        component, _ = divide(t["_u"].to_numpy(), t["_v"].to_numpy(), t["_n"].to_numpy(), w, h, 2**62)
        size = t["_n"].groupby(component).transform("sum")
        return t.assign(_c=put(component, t["_n"].where(size <= at_once, 0).to_numpy(), at_once), _size=size)[[*keys, "_u", "_v", "_c", "_size"]]

    put = together
    bins = hit.groupBy(*keys, "_u", "_v").agg(F.count("*").alias("_n"))
    bins = spread(bins, *keys).groupBy(*keys).applyInPandas(placed, StructType([*fields]).add("_u", "integer").add("_v", "integer").add("_c", "long").add("_size", "long"))
    rows = _cut(hit.join(bins, [*keys, "_u", "_v"]).drop("_u", "_v"))
    rows = rows.withColumn("_p", F.to_json(F.struct(F.col(point_id).alias("p"))))  # a name of the point, of whatever type it is
    own = [*keys, view_id, point_id, "x", "y"]
    settle = settled_part

    def solved(t):
        stay = settle(t[view_id].to_numpy(), t["_p"].to_numpy(), t["x"].to_numpy(np.float64), t["y"].to_numpy(np.float64), t["x1"].to_numpy(), t["y1"].to_numpy(), w, h, above)
        return t.loc[stay, [*keys, view_id, "_p"]]

    small, large = rows.where(F.col("_size") <= at_once), rows.where(F.col("_size") > at_once)
    kept = spread(small.select(*keys, "_c", view_id, "_p", "x", "y", "x1", "y1"), *keys, "_c").groupBy(*keys, "_c").applyInPandas(solved, StructType([*fields, hit.schema[view_id]]).add("_p", "string"))
    out = small.join(kept, [*keys, view_id, "_p"], "left_semi").select(*own)
    if large.isEmpty():
        return out
    pairs = overlapping_pairs(boxes.join(large.select(*keys, view_id).distinct(), [*keys, view_id], "left_semi"), keys, view_id, max(w, h), above)
    return out.unionByName(settled(large.select(*own), pairs, keys, view_id, point_id))


def recentre(views: DataFrame, points: DataFrame, keys: list[str], view_id: str, point_id: str, w: int, h: int) -> DataFrame:
    """Views (keys, view_id, x, y), each moved to the middle of the points that it owns (owned); views that own none go.  Points stay inside."""
    low = owned(views, points, keys, view_id, point_id, w, h).groupBy(*keys, view_id).agg(*(f(F.floor(c)).alias(n + c) for c in "xy" for n, f in (("a", F.min), ("z", F.max))))
    mid = lambda c, size: F.floor((F.col("a" + c) + F.col("z" + c) + 1 - size) / 2).cast("int")
    return low.select(*keys, view_id, mid("x", w).alias("x"), mid("y", h).alias("y"))


def order_from_first(rects: DataFrame, keys: list[str], rect_id: str) -> DataFrame:
    """Number rectangles by squared distance of their centres to the first one's."""
    first = rects.groupBy(*keys).agg(F.min(F.struct(rect_id, "x", "y")).alias("f"))
    d = rects.join(first, keys).withColumn("dist2", (F.col("x") - F.col("f.x")) * (F.col("x") - F.col("f.x")) + (F.col("y") - F.col("f.y")) * (F.col("y") - F.col("f.y")))
    return d.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy("dist2", rect_id))).drop("f")


def number_tasks(tasks: DataFrame, keys: list[str], *ties: str) -> DataFrame:
    """sort_id from 1 within each region, by x then y; tasks at one place in order of the columns ties."""
    return tasks.withColumn("sort_id", F.row_number().over(Window.partitionBy(*keys).orderBy("x", "y", *ties)))


def sizes_of(magnitudes: DataFrame) -> DataFrame:
    """rect_sizes() of a table of magnitudes m."""
    a = F.explode(F.array(*(F.struct(F.lit(w).alias("rw"), F.lit(h).alias("rh")) for w, h in ASPECTS)))
    step = F.sqrt(F.col("m") * 8 / (F.col("a.rw") * F.col("a.rh")))
    odd = lambda c: (c + 1 - c % 2)
    t = magnitudes.select("m", a.alias("a")).select(F.bround(step * F.col("a.rw")).cast("int").alias("w"), F.bround(step * F.col("a.rh")).cast("int").alias("h"))
    return t.select(odd(F.col("w")).alias("w"), odd(F.col("h")).alias("h")).distinct()
