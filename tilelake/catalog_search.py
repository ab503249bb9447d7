"""Registered queries over region search, camera views and whole task lists, and of operators that lists and streams share."""

import math

from pyspark.sql import functions as F

from tilelake.catalog import _GLOBAL, _GRID, _MEGS, _blocks, _box_cells, _grid, _iou, _megs, _r, _scored, _settle, query
from tilelake.catalog_regions import _BAD, _INTER, AREA
from tilelake.fixtures import load
from tilelake.operators import capture as C, cover, heatmap, regions as R, search as Q, spatial, suppress, tasks as K, tiles as T, views as V
from tilelake.sources import files
from tilelake.streaming import uploads as S

TARGET = 600


# ---- predicates, joins and sets --------------------------------------------------------------------------------------------

@query("select slide_id, tile_idx, cell_id from detections where cell_id % 7 in (select p_size % 7 from part where p_size < 4)", "detections")
def f6_allowed_classes(s, d):
    allowed = load(s, d, "part").where("p_size < 4").select((F.col("p_size") % 7).cast("long").alias("kind")).distinct()
    return T.of_classes(load(s, d, "detections").withColumn("kind", F.col("cell_id") % 7), allowed, "kind").select("slide_id", "tile_idx", "cell_id")


@query("""with r as (select slide_id, meg_id, least(1248.0::double / h, 1248.0::double / w) as r, w, h from megs)
    select slide_id, meg_id, round(r, 6) as ratio, cast(round((1248 - round(w * r)) % 32 / 2 - 0.1::double) as int) as pad_x, cast(round((1248 - round(h * r)) % 32 / 2 - 0.1::double) as int) as pad_y from r""", "megs")
def f12_letterbox(s, d):
    r, left, top = T.letterbox(F.col("w"), F.col("h"))
    return load(s, d, "megs").select("slide_id", "meg_id", _r(r).alias("ratio"), left.alias("pad_x"), top.alias("pad_y"))


@query("""select slide_id, tile_idx, px, py, greatest(0, least(cast(trunc((px + white) * 4 - p_partkey % 30 / 2.0::double) as int), 612)) as x1, greatest(0, least(cast(trunc((py + white) * 4 - p_partkey % 40 / 2.0::double) as int), 512)) as y1,
    greatest(0, least(cast(trunc((px + white) * 4 + p_partkey % 30 / 2.0::double) as int), 612)) as x2, greatest(0, least(cast(trunc((py + white) * 4 + p_partkey % 40 / 2.0::double) as int), 512)) as y2
    from peaks where center = center_pool and center >= 0.3""", "peaks")
def f18_big_cell_peaks(s, d):
    p = load(s, d, "peaks").select("*", (F.col("p_partkey") % 30).alias("w"), (F.col("p_partkey") % 40).alias("h"), F.col("white").alias("ox"), F.col("white").alias("oy"))
    return T.big_cell_peaks(p, 0.3, 4, 612, 512).select("slide_id", "tile_idx", "px", "py", "x1", "y1", "x2", "y2")


@query("""select slide_id, tile_idx, cell_id, x1 + cell_id % 3 * 835 as x1, y1 + cell_id % 2 * 835 as y1, x2 + cell_id % 3 * 835 as x2, y2 + cell_id % 2 * 835 as y2 from detections""", "detections")
def f20_windows_to_tile(s, d):
    w = load(s, d, "detections").withColumn("wx", F.col("cell_id") % 3 * 835).withColumn("wy", F.col("cell_id") % 2 * 835)
    return T.windows_to_tile(w).select("slide_id", "tile_idx", "cell_id", "x1", "y1", "x2", "y2")


@query("""select slide_id, row_index, col_index, 0 as position_missing, 1 as image_missing from tiles where image_uid is null""", "tiles")
def j1_sparse_layer(s, d):
    return T.missing_tiles(load(s, d, "tiles"), 0, 0)


@query(f"""with {_GRID} select g.slide_id, gx, gy, t.tile_idx, cast(g.label as int) as label from grid g join tiles t on g.slide_id = t.slide_id and t.col_index = gx // 2 and t.row_index = 7 - gy // 2""", "blocks_raw", "tiles")
def j2_tile_of_grid(s, d):
    t = load(s, d, "tiles").select("slide_id", F.col("col_index").alias("ix"), F.col("row_index").alias("iy"), "tile_idx")
    return R.tile_of_grid(_grid(s, d), AREA).join(t, ["slide_id", "ix", "iy"]).select("slide_id", "gx", "gy", "tile_idx", "label")


_SELECTED = """select distinct t.slide_id, t.row_index, t.col_index from tiles t join tiles c on c.slide_id = t.slide_id and c.tile_idx % 17 = 3
    and abs(t.row_index - c.row_index) <= 2 and abs(t.col_index - c.col_index) <= 2"""


@query(_SELECTED, "tiles")
def o1_neighbours(s, d):
    t = load(s, d, "tiles")
    return V.neighbours(t.where("tile_idx % 17 = 3"), t, 2)


@query("""with r as (select slide_id, view_id as id, 0 as kind, cast(view_id % 3 as int) as region from views union all select slide_id, meg_id, 1, 0 from megs)
    select slide_id, id, kind, cast(dense_rank() over (partition by slide_id order by kind, region) as int) as "group" from r""", "views", "megs")
def o4_groups(s, d):
    a = load(s, d, "views").select("slide_id", F.col("view_id").alias("id"), F.lit(0).alias("kind"), (F.col("view_id") % 3).cast("int").alias("region"))
    b = load(s, d, "megs").select("slide_id", F.col("meg_id").alias("id"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("region"))
    return V.grouped(a, b).select("slide_id", "id", "kind", "group")


# ---- suppression -----------------------------------------------------------------------------------------------------------

@query(f"""with {_MEGS}, nb as (select *, id % 2 as label, slide_id * 2 + id % 2 as g from mg), edges as materialized (select a.g, a.id as u, b.id as v from nb a join nb b on a.g = b.g
      and (a.rate > b.rate or (a.rate = b.rate and a.id < b.id)) where {_iou('a', 'b')} > 0.3), {_settle()}
    select n.slide_id, n.id as meg_id, cast(n.label as int) as label, cast(row_number() over (partition by n.slide_id order by rate desc, x1, y1, x2, y2, n.id) as int) as place
    from nb n left join s5 s on n.g = s.g and n.id = s.v where s.v is null""", "megs", "tiles")
def n3_per_class(s, d):
    m = _megs(s, d).withColumnRenamed("rate", "score").withColumn("label", (F.col("id") % 2).cast("int"))
    return suppress.per_class(m, ["slide_id"], 0.3, 512).select("slide_id", F.col("id").alias("meg_id"), "label", "place")


# ---- region search ---------------------------------------------------------------------------------------------------------

def _kernel_sql() -> str:
    rows = []
    for w, h in Q.all_sizes():
        if (int(math.hypot(w, h)) + 4) | 1 <= 16:
            rows += [f"({len(rows) + i}, {w}, {h}, {a})" for i, a in enumerate(Q.ANGLES)]
    return f"""k as (select * from (values {', '.join(rows)}) t(kernel, w, h, angle)), kc as (select kernel, w, h, angle, dx, dy from k, range(-9, 10) a(dx), range(-9, 10) b(dy)
        where abs(dx * cos(radians(angle)) + dy * sin(radians(angle))) <= w / 2.0::double and abs(dy * cos(radians(angle)) - dx * sin(radians(angle))) <= h / 2.0::double),
        kn as (select *, count(*) over (partition by kernel) as cells from kc)"""


@query(f"""with {_GRID}, {_kernel_sql()}, m as (select slide_id, kernel, w, h, angle, gx - dx as cx, gy - dy as cy, (sum(score + 1000) - 1000 * any_value(cells)) / (w * h) as mean
      from grid, kn group by 1, 2, 3, 4, 5, 6, 7)
    select slide_id, w, h, angle, cast(cx as int) as cx, cast(cy as int) as cy, round(mean, 6) as area_score from m
    qualify row_number() over (partition by slide_id, kernel order by round(mean, 9) desc, cy, cx) = 1""", "blocks_raw", "tiles")
def r2_rotated_windows(s, d):
    found = Q.rotated_windows(_grid(s, d), Q.all_sizes(), AREA)
    return found.select("slide_id", "w", "h", "angle", "cx", "cy", _r("area_score").alias("area_score"))


def _tile_cells(s, d):
    return load(s, d, "detections").groupBy("slide_id", F.col("col_index").alias("ix"), F.col("row_index").alias("iy")).agg(F.count("*").alias("cells"))


def _region(s, d):
    grid, cells = suppress._cut(_grid(s, d)), _tile_cells(s, d)
    found = suppress._cut(Q.search(grid, heatmap.head_crop(grid, -6.0, 16), cells, Q.all_sizes(), AREA, 3 * TARGET))
    return grid, cells, found, Q.best_region(found, V.middles(_box_cells(s, d)), load(s, d, "tiles"), AREA, 3 * TARGET)


def _inside_sql(x: str, y: str, corners: str) -> str:
    """in_quad() over the structs lt, rt, rb, lb (with a prefix)."""
    pts = [f"{corners}{c}" for c in Q.CORNERS]
    sides = [f"(({b}.x - {a}.x) * ({y} - {a}.y) - ({b}.y - {a}.y) * ({x} - {a}.x))" for a, b in zip(pts, [*pts[1:], pts[0]])]
    return f"(least({', '.join(sides)}) >= 0 or greatest({', '.join(sides)}) <= 0)"


def _corner_sql(c: str) -> str:
    ix, iy = f"cast(floor(n.{c}.x / 2) as int)", f"(7 - cast(floor(n.{c}.y / 2) as int))"
    far_x, far_y = T.TILE_W * (c in ("rt", "rb")), T.TILE_H * (c in ("rb", "lb"))
    at = lambda what, other: f"coalesce((select {what} from tiles t where t.slide_id = n.slide_id and t.col_index = {ix} and t.row_index = {iy}), {other})"
    return f"{{'x': {at('position_x', f'{ix} * {T.TILE_W * 9 // 10}')} + {far_x}, 'y': {at('position_y', f'{iy} * {T.TILE_H * 9 // 10}')} + {far_y}}} as p{c}"


_TURN = list(zip(Q.CORNERS, [*Q.CORNERS[1:], Q.CORNERS[0]]))
_REGION = f"""{_GRID}, {_kernel_sql()}, m as (select slide_id, kernel, w, h, angle, gx - dx as cx, gy - dy as cy, (sum(score + 1000) - 1000 * any_value(cells)) / (w * h) as mean
      from grid, kn group by 1, 2, 3, 4, 5, 6, 7),
    win as (select *, cos(radians(angle)) as c, sin(radians(angle)) as s from m qualify row_number() over (partition by slide_id, kernel order by round(mean, 9) desc, cy, cx) = 1),
    pt as (select *, list_sort([{', '.join(f"{{'y': greatest(0.0::double, least(cy + w * {a / 2}::double * s + h * {b / 2}::double * c, 15.0::double)), 'x': greatest(0.0::double, least(cx + w * {a / 2}::double * c - h * {b / 2}::double * s, 19.0::double))}}" for a in (-1, 1) for b in (-1, 1))}]) as q from win),
    cand as materialized (select slide_id, kernel, w, h, angle, cx, cy, mean, case when q[1].x <= q[2].x then q[1] else q[2] end as lt, case when q[1].x <= q[2].x then q[2] else q[1] end as rt,
      case when q[3].x <= q[4].x then q[3] else q[4] end as lb, case when q[3].x <= q[4].x then q[4] else q[3] end as rb from pt),
    per as (select slide_id, col_index as ix, row_index as iy, count(*) as n from detections group by 1, 2, 3), tot as (select slide_id, sum(n) as total from per group by 1),
    xs as (select *, unnest(range(cast(floor(least(lt.x, rt.x, rb.x, lb.x)) as int), cast(ceil(greatest(lt.x, rt.x, rb.x, lb.x)) as int) + 1)) as x from cand),
    xy as (select *, unnest(range(cast(floor(least(lt.y, rt.y, rb.y, lb.y)) as int), cast(ceil(greatest(lt.y, rt.y, rb.y, lb.y)) as int) + 1)) as y from xs),
    hit as (select distinct slide_id, kernel, x // 2 as ix, 7 - y // 2 as iy from xy where {_inside_sql('x', 'y', '')}),
    cnt as (select slide_id, kernel, coalesce(sum(n), 0) as cells from hit left join per using (slide_id, ix, iy) group by 1, 2),
    hc as (select slide_id, min(gx) as lo, (max(gx) - min(gx) + 1) // 5 + min(gx) as cw from (select slide_id, gx from grid where score > -6 group by 1, 2 having count(*) > 1) group by 1),
    ch as (select c.*, cells, total, coalesce(least(lt.x, rt.x, rb.x, lb.x) >= lo and least(lt.x, rt.x, rb.x, lb.x) <= lo + cw, false) as head from cand c join cnt using (slide_id, kernel) join tot using (slide_id) left join hc using (slide_id)),
    off as (select * from ch qualify not head or bool_and(head) over (partition by slide_id)),
    lv as (select *, case when cells >= {3 * TARGET} then list_min(list_filter(range(41), lambda k: cells <= {3 * TARGET} * (1 + 0.2::double * pow(2.0::double, k)) and (k = 0 or {3 * TARGET} * (1 + 0.2::double * pow(2.0::double, k)) <= total))) end as level from off),
    fit as (select * from lv qualify level = min(level) over (partition by slide_id) or (min(level) over (partition by slide_id) is null and row_number() over (partition by slide_id order by cells desc, kernel) = 1)),
    top as (select * from fit qualify row_number() over (partition by slide_id order by mean desc, kernel) <= 3), px as materialized (select n.*, {', '.join(map(_corner_sql, Q.CORNERS))} from top n),
    sz as (select *, greatest(abs({' + '.join(f"(p{a}.x::double * p{b}.y - p{b}.x::double * p{a}.y)" for a, b in _TURN)}) / 2 / 400, 1.0::double) as size from px),
    cell as (select d.slide_id, (d.x1 + d.x2) / 2.0::double + t.position_x as x, (d.y1 + d.y2) / 2.0::double + t.position_y as y from detections d join tiles t using (slide_id, tile_idx)),
    bin as (select distinct z.slide_id, kernel, size, floor(x / 20) as mx, cast(floor(y / 20) as int) as my from sz z join cell e on e.slide_id = z.slide_id and {_inside_sql('e.x', 'e.y', 'z.p')}),
    ro as (select distinct slide_id, kernel, size, mx, unnest(range(my - 6, my + 8)) as r from bin),
    un as (select slide_id, kernel, sum(n) / any_value(size) as uniformity from (select *, least(coalesce(lead(mx) over (partition by slide_id, kernel, r order by mx) - mx, 19), 19) as n from ro) group by 1, 2),
    chosen as (select t.*, coalesce(uniformity, 0) as uniformity from top t left join un using (slide_id, kernel) qualify row_number() over (partition by slide_id order by coalesce(uniformity, 0) desc, mean desc, kernel) = 1)"""


@query(f"""with {_REGION} select slide_id, cast(w as int) as w, cast(h as int) as h, cast(angle as int) as angle, cast(cx as int) as cx, cast(cy as int) as cy, cast(cells as bigint) as cells, round(mean, 6) as area_score, round(uniformity, 6) as uniformity from chosen""", "blocks_raw", "tiles", "detections")
def r5_best_region(s, d):
    """The region of each slide: where it lies, how many cells it holds, its score and uniformity."""
    best = _region(s, d)[3]
    return best.select("slide_id", "w", "h", "angle", "cx", "cy", "cells", _r("area_score").alias("area_score"), _r("uniformity").alias("uniformity"))


@query("""select slide_id, true as any_cell, cast(0 as bigint) as repeated, cast(0 as bigint) as particles, cast(0 as bigint) as outside from tiles group by 1""", "tiles")
def r6_capture(s, d):
    """Cells to capture: none twice, none of label 5, each in its rectangle."""
    grid, cells, _, best = _region(s, d)
    parts = suppress._cut(C.capture(best, grid, cells, AREA, TARGET)).join(grid.select("slide_id", "gx", "gy", "label"), ["slide_id", "gx", "gy"])
    inside = spatial.contains((F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")), "gx", "gy")
    return parts.groupBy("slide_id").agg((F.count("*") > 0).alias("any_cell"), (F.count("*") - F.count_distinct("gx", "gy")).alias("repeated"), F.count_if(F.col("label") == 5).alias("particles"),
                                         F.count_if(~inside).alias("outside"))


@query(f"""with recursive {_GRID}, g as (select slide_id, gx, gy, score > -6 as marked, label <> 5 as usable from grid),
    st as (select distinct slide_id, 0 as n, 8 as x1, 6 as y1, 11 as x2, 9 as y2, 0 as a1, 0 as b1, 0 as a2, 0 as b2, 1 as held from tiles
      union all select slide_id, n + 1, least(x1, a1), least(y1, b1), greatest(x2, a2), greatest(y2, b2), a1, b1, a2, b2, u from (
        select *, row_number() over (partition by slide_id order by case when any_m > 0 then m else u end desc, k) as place from (select *, sum(m) over (partition by slide_id) as any_m from (
          select t.slide_id, t.n, t.x1, t.y1, t.x2, t.y2, s.k, s.a1, s.b1, s.a2, s.b2, count(case when g.marked then 1 end) as m, count(case when g.usable then 1 end) as u
          from st t cross join lateral (select unnest([0, 1, 2, 3]) as k, unnest([x1, x1, x1 - 1, x2 + 1]) as a1, unnest([y1 - 1, y2 + 1, y1, y1]) as b1, unnest([x2, x2, x1 - 1, x2 + 1]) as a2, unnest([y1 - 1, y2 + 1, y2, y2]) as b2) s
          left join g on g.slide_id = t.slide_id and gx between s.a1 and s.a2 and gy between s.b1 and s.b2 and s.a1 >= 0 and s.b1 >= 0 and s.a2 < 20 and s.b2 < 16 group by all))) where place = 1 and case when any_m > 0 then m else u end > 0)
    select slide_id, cast(row_number() over (partition by slide_id order by n) as int) as step, a1 as x1, b1 as y1, a2 as x2, b2 as y2 from st where n > 0 and held > 0""", "blocks_raw", "tiles")
def r7_strips(s, d):
    """The strips by which a rectangle in the middle of each slide's grid grows."""
    first = load(s, d, "tiles").select("slide_id").distinct().selectExpr("slide_id", "8 as x1", "6 as y1", "11 as x2", "9 as y2")
    return C.strips(first, _grid(s, d).select("slide_id", "gx", "gy", (F.col("score") > -6).alias("marked"), (F.col("label") != 5).alias("usable")), AREA)


# ---- views and task lists --------------------------------------------------------------------------------------------------

@query(f"with {_MEGS} select slide_id, count(*) as points, cast(0 as bigint) as uncovered from mg group by 1", "megs", "tiles")
def r11_recentred_views(s, d):
    """Views over all megakaryocytes, moved to the middle of their own: no point is left out."""
    p = V.middles(_megs(s, d)).select("slide_id", "id", "x", "y")
    _, owner = V.views_over(p, ["slide_id"], "id")
    return p.join(owner, ["slide_id", "id"], "left").groupBy("slide_id").agg(F.count("*").alias("points"), F.count_if(F.col("view_id").isNull()).alias("uncovered"))


@query(f"""with {_GRID}, q as (select g.slide_id, t.position_x + case when gx % 2 = 0 then 0 else 1224 end as x, t.position_y + case when gy % 2 = 0 then 0 else 1024 end as y, t.row_index, t.col_index
      from grid g join tiles t on g.slide_id = t.slide_id and t.col_index = gx // 2 and t.row_index = 7 - gy // 2 where score > -6),
    n as (select distinct t.slide_id, t.tile_idx from tiles t join q on q.slide_id = t.slide_id and abs(q.row_index - t.row_index) <= 1 and abs(q.col_index - t.col_index) <= 1),
    c as (select d.slide_id, d.tile_idx, d.cell_id, (d.x1 + d.x2) / 2.0::double + t.position_x as x, (d.y1 + d.y2) / 2.0::double + t.position_y as y from detections d join tiles t using (slide_id, tile_idx)
      join n using (slide_id, tile_idx) where d.label = 0)
    select slide_id, count(*) as cells, cast(0 as bigint) as unassigned, true as in_view from c where exists (select 1 from q where q.slide_id = c.slide_id and c.x >= q.x and c.x < q.x + 1224 and c.y >= q.y and c.y < q.y + 1024)
    group by 1""", "blocks_raw", "tiles", "detections")
def r12_wbc_views(s, d):
    """Nucleated cells at selected grid points: each has one view, and lies in it."""
    t, good, boxes = (suppress._cut(x) for x in (load(s, d, "tiles"), _grid(s, d).where("score > -6"), _box_cells(s, d).where("label = 0")))
    views, cells = V.wbc_views(good, boxes, t, AREA)
    chosen = V.selected_cells(good, V.middles(boxes), t, AREA)
    own = cells.join(views.select("slide_id", "view_id", F.col("x").alias("vx"), F.col("y").alias("vy")), ["slide_id", "view_id"])
    inside = spatial.contains((F.col("vx"), F.col("vy"), F.col("vx") + V.VIEW_W, F.col("vy") + V.VIEW_H), "x", "y")
    seen = own.groupBy("slide_id").agg(F.count("*").alias("n"), F.every(inside).alias("in_view"))
    return chosen.groupBy("slide_id").agg(F.count("*").alias("cells")).join(seen, "slide_id").select("slide_id", "cells", (F.col("cells") - F.col("n")).alias("unassigned"), "in_view")


@query(f"""with {_BAD}, {_MEGS}, ok as (select * from mg a where not exists (select 1 from bad b where b.slide_id = a.slide_id
    and (((a.x1 + a.x2) * 0.5::double >= b.x1 and (a.x1 + a.x2) * 0.5::double < b.x2 and (a.y1 + a.y2) * 0.5::double >= b.y1 and (a.y1 + a.y2) * 0.5::double < b.y2)
      or {_INTER} / least((a.x2 - a.x1)::double * (a.y2 - a.y1), (b.x2 - b.x1)::double * (b.y2 - b.y1)) >= 0.2))),
    nb as (select slide_id, slide_id as g, min(id) as id, x1, y1, x2, y2, (x2 - x1)::double * (y2 - y1) as sc from ok group by all),
    edges as materialized (select a.g, a.id as u, b.id as v from nb a join nb b on a.g = b.g and (a.sc > b.sc or (a.sc = b.sc and a.id < b.id)) where {_iou('a', 'b')} > 0.9), {_settle()}
    select n.slide_id, count(*) as megs, cast(0 as bigint) as unassigned, true as on_tile from nb n left join s5 s on n.g = s.g and n.id = s.v where s.v is null group by 1""", "blocks_raw", "tiles", "megs")
def r13_meg_views(s, d):
    """Megakaryocytes off bad regions, duplicates suppressed: each has a view, and every view lies on its tile."""
    t, blocks, megs = map(suppress._cut, (load(s, d, "tiles"), _blocks(s, d), _megs(s, d)))
    first = t.groupBy("slide_id").agg(F.min("position_x").alias("x"), F.min("position_y").alias("y"))
    kept = suppress.meg_boxes(R.off_bad_regions(megs, R.bad_regions(blocks, t), ["slide_id"], 0.2), ["slide_id"])
    views, boxes = V.meg_views(megs, blocks, t, first)
    on_tile = (F.col("view_pos_x").between(0, T.TILE_W - V.VIEW_W)) & F.col("view_pos_y").between(0, T.TILE_H - V.VIEW_H)
    n = kept.groupBy("slide_id").agg(F.count("*").alias("megs")).join(boxes.groupBy("slide_id").agg(F.count("*").alias("n")), "slide_id")
    return n.join(views.groupBy("slide_id").agg(F.every(on_tile).alias("on_tile")), "slide_id").select("slide_id", "megs", (F.col("megs") - F.col("n")).alias("unassigned"), "on_tile")


@query("""select slide_id, true as any_wbc, true as any_meg, true as meg_last, cast(0 as bigint) as repeated, cast(0 as bigint) as off_view from tiles group by 1""", "tiles")
def r15_task_list(s, d):
    """Detections to task records: groups of nucleated cells first, megakaryocytes last, no task twice, and every cell's middle in its view."""
    tables = (load(s, d, "detections"), load(s, d, "tiles"), _scored(s, d).select("slide_id", "tile_idx", "dx", "dy", "score", "label"), _megs(s, d))
    r = suppress._cut(V.task_list(*map(suppress._cut, tables), AREA, TARGET))
    off = F.size(F.filter("cell_list", lambda c: (F.abs(c["cell_x"] + c["cell_width"] / 2 - F.col("view_pos_x") - F.col("view_width") / 2) > F.col("view_width") / 2 + 1)
                          | (F.abs(c["cell_y"] + c["cell_height"] / 2 - F.col("view_pos_y") - F.col("view_height") / 2) > F.col("view_height") / 2 + 1)))
    wbc, key = F.col("view_type") == "wbc", F.struct("group", "sort_id")
    return r.groupBy("slide_id").agg(
        (F.count_if(wbc) > 0).alias("any_wbc"), (F.count_if(~wbc) > 0).alias("any_meg"), (F.max(F.when(wbc, F.col("group"))) < F.min(F.when(~wbc, F.col("group")))).alias("meg_last"),
        (F.count("*") - F.count_distinct(key)).alias("repeated"), F.coalesce(F.sum(F.when(wbc, off).cast("long")), F.lit(0).cast("long")).alias("off_view"))


# ---- documents and streams -------------------------------------------------------------------------------------------------

@query("""with l as (select doc_id, path, seq, unnest([scalar_value, -scalar_value]) as v, unnest([0, 1]) as k from doc_updates) select doc_id, path, round(list(v order by seq, k)[3], 6) as third, count(*) as n from l group by 1, 2""", "doc_updates")
def s11_merge_lists(s, d):
    u = load(s, d, "doc_updates").select("doc_id", "path", "seq", F.array("scalar_value", -F.col("scalar_value")).alias("value"))
    return files.merge_lists(u, ["doc_id"]).select("doc_id", "path", _r(F.get("value", F.lit(2))).alias("third"), F.size("value").cast("long").alias("n"))


@query("""with v as (select doc_id, path, arg_max(seq, seq) as v from doc_updates group by 1, 2) select doc_id, '{' || string_agg('"k":{"' || path || '":' || v || '}', ',' order by path) || '}' as json
    from (select doc_id, path, v from v where path = 'error') group by 1""", "doc_updates")
def s11_nested_documents(s, d):
    u = load(s, d, "doc_updates").where("path = 'error'").select("doc_id", F.concat(F.lit("k."), "path").alias("path"), "seq", F.col("seq").alias("value"))
    return files.nested(files.merge_scalars(u, ["doc_id"]), ["doc_id"])


@query("""select task_id, 100 as status from uploads group by 1 having count(distinct case when n_bytes > 0 then row_index * 2 + col_index end) = 4""", "uploads")
def st3_completions(s, d):
    return T.upload_complete(load(s, d, "uploads"), 2, 2).where("complete").select("task_id", F.lit(100).alias("status"))


@query("select event_id, case when n_bytes = 0 then 201 else 0 end as code from uploads", "uploads")
def st2_empty_uploads(s, d):
    u = T.upload_status(load(s, d, "uploads"))
    return u.select("event_id", F.when(F.col("code") == 201, 201).otherwise(0).alias("code"))


@query("""select u.task_id, u.row_index, u.col_index, count(*) as n, cast(sum(r.event_id % 200) as bigint) as cells from uploads u join uploads r on u.task_id = r.task_id and u.row_index = r.row_index and u.col_index = r.col_index
    and r.event_id % 9 <> 0 and r.ts >= u.ts and r.ts <= u.ts + interval 1 hour group by 1, 2, 3""", "uploads")
def j15_results_of_uploads(s, d):
    """Uploads with the results that come within an hour (the join of st5 over tables)."""
    u = load(s, d, "uploads")
    results = u.where("event_id % 9 <> 0").select("task_id", "row_index", "col_index", "ts", (F.col("event_id") % 200).alias("n_cells"))
    return S.with_results(u, results).groupBy("task_id", "row_index", "col_index").agg(F.count("*").alias("n"), F.sum("n_cells").alias("cells"))
