"""Registered queries over regions, task lists and decoded boxes."""

from pyspark.sql import functions as F

from tilelake.catalog import _BLOCKS, _GLOBAL, _GRID, _MEGS, _blocks, _grid, _iou, _megs, _r, _settle, query
from tilelake.fixtures import load
from tilelake.operators import cover, regions as R, spatial, suppress, tasks as K, tiles as T

AREA = {"min_row": 0, "max_row": 7, "min_col": 0, "max_col": 9}
QUAD = [(3000, 3000), (14000, 2000), (15000, 9000), (4000, 10000)]


def _points(s, d):
    return load(s, d, "cells_true").selectExpr("slide_id", "cell_id", "gx as x", "gy as y")


def _view_boxes(s, d):
    return load(s, d, "views").selectExpr("slide_id", "view_id", "x as x1", "y as y1", "x + w as x2", "y + h as y2")


def _slides(s, d):
    return load(s, d, "tiles").select("slide_id").distinct()


# ---- predicates and boxes ----------------------------------------------------------------------------------------------

@query("""select slide_id, cell_id, cast(gx < 12000 and gy < 9000 as int) as half_open from cells_true where gx between 3000 and 12000 and gy between 2000 and 9000""", "cells_true")
def f10_points_in_rect(s, d):
    from tilelake.functions.geometry import contains

    box = (F.lit(3000), F.lit(2000), F.lit(12000), F.lit(9000))
    return _points(s, d).where(contains(box, "x", "y", closed=True)).select("slide_id", "cell_id", contains(box, "x", "y").cast("int").alias("half_open"))


@query("select slide_id, tile_idx, cell_id from detections where x1 < 2448 and x2 > 2204 and y1 < 2048 and y2 > 0", "detections")
def f11_touches_band(s, d):
    from tilelake.functions.geometry import overlaps

    return load(s, d, "detections").where(overlaps(R.BOX, (F.lit(2204), F.lit(0), F.lit(2448), F.lit(2048)))).select("slide_id", "tile_idx", "cell_id")


@query("""with m as (select *, greatest(w, h) as s, greatest(w, h) - least(w, h) as g, h > w as thin from megs),
    p as (select *, case when thin then x else y end as pos, case when thin then w else h end as short, case when thin then 1900 else 1500 end as lim from m),
    q as (select *, pos - (g + 1) // 2 as lo, pos + short + g // 2 as hi from p),
    n as (select *, case when lo >= 0 and hi <= lim then lo when lo < 0 and hi <= lim then 0 when lo >= 0 and hi > lim then lim - s else pos end as moved from q),
    o as (select *, case when thin then moved else x end as nx, case when thin then y else moved end as ny from n)
    select slide_id, meg_id, cast(least(greatest(nx, 0), 1900) as int) as x1, cast(least(greatest(ny, 0), 1500) as int) as y1, cast(least(nx + s, 1900) as int) as x2, cast(least(ny + s, 1500) as int) as y2 from o""", "megs")
def f14_square_up(s, d):
    return K.square_up(load(s, d, "megs"), 1900, 1500).select("slide_id", "meg_id", "x1", "y1", "x2", "y2")


_RAW = "cell_id * 7 % 200 / 100.0::double - 1 as r0, cell_id * 11 % 200 / 100.0::double - 1 as r1, cell_id * 13 % 100 / 100.0::double - 0.5 as r2, cell_id * 17 % 100 / 100.0::double - 0.5 as r3"


@query(f"""with lv as (select 0 as f, 16 as st, 24 as dn, 32 as ac union all select 4608, 32, 12, 16 union all select 5760, 64, 6, 8),
    an as (select f + (n.i * ac + m.i) * 6 + k.i as anchor, st / 2 + m.i * st as ax, st / 2 + n.i * st as ay, 2.0::double * st * case when k.i < 3 then 1.0::double else 1.4142135623730951::double end as b, k.i % 3 as q
      from lv, range(24) n(i), range(32) m(i), range(6) k(i) where n.i < dn and m.i < ac),
    ax as (select anchor, ax, ay, b * case q when 0 then 1.0::double when 1 then 1.2::double else 0.8::double end as aw, b * case q when 0 then 1.0::double when 1 then 0.8::double else 1.2::double end as ah from an),
    r as (select slide_id, tile_idx, cell_id, cell_id % 6048 as anchor, {_RAW} from detections where score > 0.6),
    e as (select *, exp(r3) * aw as bw, exp(r2) * ah as bh, r1 * ah + ax as cx, r0 * ah + ay as cy from r join ax using (anchor)),
    i as (select *, cast(trunc(greatest(cx - bw / 2, 0)) as int) as x, cast(trunc(greatest(cy - bh / 2, 0)) as int) as y, cast(trunc(least(bw, 383)) as int) as iw, cast(trunc(least(bh, 511)) as int) as ih from e)
    select slide_id, tile_idx, cell_id, cast(x * 1920 // 512 as int) as x1, cast(y * 1440 // 384 as int) as y1, cast((x + iw) * 1920 // 512 as int) as x2, cast((y + ih) * 1440 // 384 as int) as y2 from i""", "detections")
def f19_decode_anchors(s, d):
    c = lambda m, n, o: (F.col("cell_id") * m % n / 100.0 - o)
    raw = load(s, d, "detections").select("slide_id", "tile_idx", "cell_id", "score", (F.col("cell_id") % 6048).cast("int").alias("anchor"),
                                          c(7, 200, 1).alias("r0"), c(11, 200, 1).alias("r1"), c(13, 100, 0.5).alias("r2"), c(17, 100, 0.5).alias("r3"))
    return K.decode_boxes(raw, 0.6, 1920, 1440).select("slide_id", "tile_idx", "cell_id", "x1", "y1", "x2", "y2")


# ---- joins ---------------------------------------------------------------------------------------------------------------

@query("""select c.slide_id, c.cell_id, min(t.tile_idx) as tile_idx from cells_true c join tiles t on c.slide_id = t.slide_id and c.gx >= t.position_x and c.gx < t.position_x + 2448
    and c.gy >= t.position_y and c.gy < t.position_y + 2048 group by 1, 2""", "cells_true", "tiles")
def j3_containing_tile(s, d):
    return R.containing_tile(_points(s, d), load(s, d, "tiles"), "cell_id")


@query("""select slide_id, cell_id from cells_true c where exists (select 1 from views v where v.slide_id = c.slide_id and c.gx >= v.x and c.gx < v.x + v.w and c.gy >= v.y and c.gy < v.y + v.h)""", "cells_true", "views")
def j8_points_in_union(s, d):
    return R.in_union(_points(s, d), _view_boxes(s, d), ["slide_id"], 512).select("slide_id", "cell_id")


_INTER = "(greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0)::double * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0))"
_BAD = f"""{_BLOCKS}, bad as (select slide_id, x as x1, y as y1, x + 896 as x2, y + 896 as y2 from (select slide_id, position_x + case when dx = 0 then 0 else 848 end as x,
    position_y + case when dy = 0 then 352 else 1152 end as y from bl join tiles using (slide_id, tile_idx) where grade = 5))"""


@query(f"""with {_BAD}, {_MEGS} select slide_id, id as meg_id from mg a where not exists (select 1 from bad b where b.slide_id = a.slide_id
    and (((a.x1 + a.x2) * 0.5::double >= b.x1 and (a.x1 + a.x2) * 0.5::double < b.x2 and (a.y1 + a.y2) * 0.5::double >= b.y1 and (a.y1 + a.y2) * 0.5::double < b.y2)
      or {_INTER} / least((a.x2 - a.x1)::double * (a.y2 - a.y1), (b.x2 - b.x1)::double * (b.y2 - b.y1)) >= 0.2))""", "blocks_raw", "tiles", "megs")
def j9_off_bad_regions(s, d):
    bad = R.bad_regions(_blocks(s, d), load(s, d, "tiles"))
    return R.off_bad_regions(_megs(s, d), bad, ["slide_id"], 0.2).select("slide_id", F.col("id").alias("meg_id"))


@query(f"""with {_MEGS}, rg as (select slide_id, tile_idx // 7 as region, position_x as x1, position_y as y1, position_x + 1224 as x2, position_y + 1024 as y2 from tiles where tile_idx % 3 = 0),
    c as (select a.slide_id, a.id, min(b.region) as region from mg a join rg b on a.slide_id = b.slide_id and (a.x1 + a.x2) * 0.5::double >= b.x1 and (a.x1 + a.x2) * 0.5::double < b.x2
      and (a.y1 + a.y2) * 0.5::double >= b.y1 and (a.y1 + a.y2) * 0.5::double < b.y2 group by 1, 2),
    ar as (select a.slide_id, a.id, b.region, sum({_INTER}) as area from mg a join rg b on a.slide_id = b.slide_id group by 1, 2, 3),
    mo as (select slide_id, id, region from ar where area > 0 qualify row_number() over (partition by slide_id, id order by area desc, region) = 1)
    select m.slide_id, m.id as meg_id, cast(coalesce(c.region, mo.region) as int) as region from mg m left join c using (slide_id, id) left join mo using (slide_id, id)""", "megs", "tiles")
def j11_assign_regions(s, d):
    x, y = F.col("position_x"), F.col("position_y")
    rg = load(s, d, "tiles").where("tile_idx % 3 = 0").select("slide_id", F.expr("cast(tile_idx div 7 as int)").alias("region"), x.alias("x1"), y.alias("y1"), (x + 1224).alias("x2"), (y + 1024).alias("y2"))
    return R.assign_regions(_megs(s, d), rg, ["slide_id"]).select("slide_id", F.col("id").alias("meg_id"), "region")


_RAWKEPT = """with r as (select slide_id, tile_idx, cell_id, x1 as x, y1 as y from detections), k as (select * from r where cell_id % 3 = 0),
    g as (select * from r where not exists (select 1 from k where k.slide_id = r.slide_id and k.tile_idx = r.tile_idx and (k.x - r.x) * (k.x - r.x) + (k.y - r.y) * (k.y - r.y) <= 36))"""


def _raw_kept(s, d):
    r = load(s, d, "detections").selectExpr("slide_id", "tile_idx", "cell_id", "x1 as x", "y1 as y")
    return r, r.where("cell_id % 3 = 0")


@query(_RAWKEPT + " select slide_id, tile_idx, cell_id from g", "detections")
def j12_removed_points(s, d):
    return R.removed_points(*_raw_kept(s, d), ["slide_id", "tile_idx"], 6).select("slide_id", "tile_idx", "cell_id")


@query(_RAWKEPT + """, n as (select slide_id, tile_idx, 1 as a, 0 as b, 0 as c from r union all select slide_id, tile_idx, 0, 1, 0 from k union all select slide_id, tile_idx, 0, 0, 1 from g)
    select slide_id, tile_idx, cast(sum(a) as bigint) as raw, cast(sum(b) as bigint) as kept, cast(sum(c) as bigint) as removed from n group by 1, 2""", "detections")
def a14_dedup_report(s, d):
    return R.dedup_report(*_raw_kept(s, d), ["slide_id", "tile_idx"], 6)


_TASKS = """tk as (select slide_id, meg_id as task_id, tile_idx // 10 as row_index, tile_idx % 10 as col_index, case meg_id % 3 when 0 then ' WBC view' when 1 then 'meg' else 'other' end as kind,
    case when meg_id % 5 = 0 then 'none' else cast(x % 90 as varchar(20)) end as sort_id, cast(x as varchar(20)) as view_pos_x, cast(y as varchar(20)) as view_pos_y from megs)"""
_TYPED = _TASKS.replace("varchar(20)", "varchar") + """, tt as (select *, case when kind like '%WBC%' then 'wbc' when kind = 'meg' then 'meg' end as view_type,
    coalesce(try_cast(sort_id as int), 1000000000) as so from tk)"""


def _tasks(s, d):
    t = s.sql(f"with {_TASKS.replace('tile_idx // 10', 'cast(tile_idx div 10 as int)')} select * from tk".replace("from megs", "from {megs}"), megs=load(s, d, "megs"))
    return t.withColumn("view_type", K.view_type(F.col("kind")))


@query(f"""with {_TYPED} select t.slide_id, t.task_id, i.tile_idx, i.position_x, i.position_y from tt t join tiles i using (slide_id, row_index, col_index)
    where exists (select 1 from tt u where u.slide_id = t.slide_id and u.row_index = t.row_index and u.col_index = t.col_index and u.view_type = 'wbc')""", "megs", "tiles")
def j14_tasks_on_wbc_tiles(s, d):
    return K.on_wbc_tiles(_tasks(s, d), load(s, d, "tiles")).select("slide_id", "task_id", "tile_idx", "position_x", "position_y")


# ---- order and selection of tasks ------------------------------------------------------------------------------------------

@query(f"""with {_TYPED} select slide_id, task_id, cast(row_number() over (partition by slide_id order by so, view_pos_y::double, view_pos_x::double, task_id) as int) as display from tt""", "megs")
def w6_display_order(s, d):
    return K.display_order(_tasks(s, d), ["slide_id"]).select("slide_id", "task_id", "display")


@query(f"""with {_TYPED}, o as (select *, row_number() over (partition by slide_id, view_type order by so, view_pos_y::double, view_pos_x::double, task_id) as n from tt)
    select slide_id, task_id, view_type from o where view_type = 'wbc' or (view_type = 'meg' and n <= 50)""", "megs")
def w8_shown_tasks(s, d):
    return K.shown_tasks(_tasks(s, d), ["slide_id"]).select("slide_id", "task_id", "view_type")


@query(f"""with {_TYPED}, p as (select slide_id, row_index, col_index, count(*) filter (where view_type = 'wbc') as wbc, count(*) filter (where view_type = 'meg') as meg from tt where view_type is not null group by 1, 2, 3)
    select *, min(row_index) over (partition by slide_id) as min_row, max(row_index) over (partition by slide_id) as max_row, min(col_index) over (partition by slide_id) as min_col,
    max(col_index) over (partition by slide_id) as max_col from p""", "megs")
def a8_tasks_by_tile(s, d):
    return K.tasks_by_tile(_tasks(s, d))


@query(f"with {_TYPED} select slide_id, task_id, case when so = 1000000000 then -1 else so end as sort_id, view_pos_x::double as view_x, view_type from tt", "megs")
def x3_safe_casts(s, d):
    return _tasks(s, d).select("slide_id", "task_id", K.to_int(F.col("sort_id"), -1).alias("sort_id"), K.to_float(F.col("view_pos_x")).alias("view_x"), "view_type")


# ---- scalar functions ------------------------------------------------------------------------------------------------------

_F = "[x::double, y::double, w::double, h::double]"


@query(f"""with p as (select slide_id, meg_id, x::double as x, y::double as y, w::double as w, h::double as h from megs)
    select slide_id, meg_id, case when meg_id % 3 = 0 then 0 else 2 end as pairs, case when meg_id % 3 = 0 then null else w end as second_x, (x + w) / 2 as mid_x, (y + h) / 2 as mid_y,
    case when meg_id % 4 = 0 then null else y end as map_y from p""", "megs")
def x5_point_lists(s, d):
    m = load(s, d, "megs").select("slide_id", "meg_id", *(F.col(c).cast("double") for c in "xywh"))
    flat = F.when(F.col("meg_id") % 3 == 0, F.array("x", "y", "w")).otherwise(F.array("x", "y", "w", "h"))
    maps = F.when(F.col("meg_id") % 4 == 0, F.create_map(F.lit("x"), "x")).otherwise(F.create_map(F.lit("cx"), "x", F.lit("cell_y"), "y"))
    m = m.select("slide_id", "meg_id", K.pairs_of(flat).alias("p"), K.points_of(F.array(F.array("x", "y", "w", "h"))).alias("c"), K.point_of_map(maps).alias("m"))
    at = lambda c, i, k: F.get(F.get(c, F.lit(i)), F.lit(k))
    return m.select("slide_id", "meg_id", F.size("p").alias("pairs"), at("p", 1, 0).alias("second_x"), at("c", 0, 0).alias("mid_x"), at("c", 0, 1).alias("mid_y"), F.get("m", F.lit(1)).alias("map_y"))


@query("""select event_id, n_bytes, case (100 + event_id % 8) when 100 then 'TASK_FINISHED' when 101 then 'TASK_RUNNING' when 102 then 'TASK_TIMEOUT' when 103 then 'IMAGE_ALREADY_UPLOADED'
    when 104 then 'IMAGE_DAMAGED' when 105 then 'TASK_IN_PROGRESS' else 'UNKNOWN' end as name from uploads""", "uploads")
def x6_status_names(s, d):
    return load(s, d, "uploads").select("event_id", "n_bytes", K.status_name(100 + F.col("event_id") % 8).alias("name"))


@query("select slide_id, cell_id, cast(trunc((gx - gy) / 4.0::double) as int) as cut, cast(round_even((gx - gy) / 4.0::double, 0) as int) as near from cells_true", "cells_true")
def x7_rounding(s, d):
    v = (F.col("gx") - F.col("gy")) / 4.0
    return load(s, d, "cells_true").select("slide_id", "cell_id", v.cast("int").alias("cut"), F.bround(v).cast("int").alias("near"))


@query("""select p_partkey, case when center * 3 - 2 < -1.5 then 'retry' when center * 3 - 2 < -0.5 then 'drop' else 'keep' end as action, case when center * 3 - 2 >= -0.5 then px * 4 end as dx from peaks""", "peaks")
def x8_edge_action(s, d):
    p = load(s, d, "peaks").withColumn("action", K.edge_action(F.col("center") * 3 - 2))
    return p.select("p_partkey", "action", F.when(F.col("action") == "keep", F.col("px") * 4).alias("dx"))


# ---- suppression presets ---------------------------------------------------------------------------------------------------

def _preset(least: float, threshold: float) -> str:
    return f"""with {_MEGS}, nb as (select *, slide_id as g from mg where rate > {least}), edges as materialized (select a.g, a.id as u, b.id as v from nb a join nb b on a.g = b.g
      and (a.rate > b.rate or (a.rate = b.rate and a.id < b.id)) where {_iou('a', 'b')} > {threshold}), {_settle()}
    select n.slide_id, n.id as meg_id from nb n left join s5 s on n.g = s.g and n.id = s.v where s.v is null"""


@query(_preset(0.6, 0.3), "megs", "tiles")
def n4_meg_100x(s, d):
    return suppress.preset(_megs(s, d).withColumnRenamed("rate", "score"), ["slide_id"], "meg_100x").select("slide_id", F.col("id").alias("meg_id"))


for _name, _f in (("meg_40x", (0.45, 0.7)), ("wbc_100x", (0.3, 0.2)), ("sub_tile", (0.5, 0.45))):
    def _run(s, d, name=_name):
        return suppress.preset(_megs(s, d).withColumnRenamed("rate", "score"), ["slide_id"], name).select("slide_id", F.col("id").alias("meg_id"))

    _run.__name__ = f"n4_{_name}"
    query(_preset(*_f), "megs", "tiles")(_run)


@query(f"""with nb as (select *, cell_id as id, slide_id * 100 + tile_idx as g from detections where score >= 0.4 qualify row_number() over (partition by slide_id, tile_idx order by score desc, cell_id) <= 30000),
    edges as materialized (select a.g, a.id as u, b.id as v from nb a join nb b on a.g = b.g and a.x1 < b.x2 and b.x1 < a.x2 and a.y1 < b.y2 and b.y1 < a.y2
      and (a.score > b.score or (a.score = b.score and a.id < b.id)) where {_iou('a', 'b')} > 0.6), {_settle()},
    kept as (select n.*, row_number() over (partition by n.g order by score desc, x1, y1, x2, y2, n.id) as place from nb n left join s5 s on n.g = s.g and n.id = s.v where s.v is null)
    select slide_id, tile_idx, cell_id, cast(label as int) as label, cast(place as int) as place, round(greatest(0, least((x1 - 12.0::double) / 0.5::double, 2448)), 6) as x1,
    round(greatest(0, least((y1 - 8.0::double) / 0.5::double, 2048)), 6) as y1 from kept where place <= 2000""", "detections")
def n7_post_process(s, d):
    each = lambda c: F.when(F.col("label") == c, F.col("score")).otherwise(F.col("score") - 0.25)
    raw = load(s, d, "detections").select("slide_id", "tile_idx", F.col("cell_id").alias("id"), ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"),
                                          (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"), F.array(each(0), each(1)).alias("p"))
    out = T.unpad(suppress.post_process(raw, ["slide_id", "tile_idx"]), 0.5, 12.0, 8.0, 2448, 2048)
    return out.select("slide_id", "tile_idx", F.col("id").alias("cell_id"), "label", "place", _r("x1").alias("x1"), _r("y1").alias("y1"))


# ---- regions ---------------------------------------------------------------------------------------------------------------

@query(f"""with {_GRID}, t as (select distinct slide_id, gx // 2 as ix, 7 - gy // 2 as iy from grid where score > -6),
    n as (select slide_id, col_index as ix, row_index as iy, count(*) as cells from detections group by 1, 2, 3)
    select t.slide_id, cast(coalesce(sum(n.cells), 0) as bigint) as cells from t left join n using (slide_id, ix, iy) group by 1""", "blocks_raw", "tiles", "detections")
def a2_cells_of_regions(s, d):
    n = load(s, d, "detections").groupBy("slide_id", F.col("col_index").alias("ix"), F.col("row_index").alias("iy")).agg(F.count("*").alias("cells"))
    return R.cells_of_regions(_grid(s, d).where("score > -6"), n, ["slide_id"], AREA)


@query("select task_id, count(distinct case when n_bytes > 0 then row_index * 2 + col_index end) = 4 as complete from uploads group by 1", "uploads")
def a7_upload_complete(s, d):
    return T.upload_complete(load(s, d, "uploads"), 2, 2)


def _quad_sql(x: str, y: str, corners) -> str:
    sides = [f"({bx - ax} * ({y} - {ay}) - {by - ay} * ({x} - {ax}))" for (ax, ay), (bx, by) in zip(corners, [*corners[1:], corners[0]])]
    return "((" + " and ".join(f"{c} >= 0" for c in sides) + ") or (" + " and ".join(f"{c} <= 0" for c in sides) + "))"


@query(f"""with b as (select distinct slide_id, (gx - 3000) // 20 as mx, (10000 - gy) // 20 as my from cells_true where {_quad_sql('gx', 'gy', QUAD)}),
    l as (select distinct slide_id, mx + i.i as x, my + j.i as y from b, range(19) i(i), range(14) j(i))
    select slide_id, round(count(*) / ({abs(sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(QUAD, [*QUAD[1:], QUAD[0]]))) / 2 / 400}::double), 6) as uniformity from l group by 1""", "cells_true")
def a10_uniformity(s, d):
    return R.uniformity(_points(s, d), ["slide_id"], QUAD).withColumn("uniformity", _r("uniformity"))


@query(f"""with {_GRID}, m as (select slide_id, gx - i.i as wx, gy - j.i as wy, sum(score + 1000) / 15 - 1000 as mean from grid, range(5) i(i), range(3) j(i) group by 1, 2, 3)
    select slide_id, cast(wx as int) as wx, cast(wy as int) as wy, round(mean, 6) as mean from m""", "blocks_raw", "tiles")
def a11_kernel_mean(s, d):
    return R.kernel_mean(_grid(s, d), 5, 3).withColumn("mean", _r("mean"))


@query("""with e as (select slide_id, min(position_x) as x0, min(position_y) as y0, max(position_x) + 2448 as x1, max(position_y) + 2048 as y1 from tiles group by 1),
    c as (select *, least(1.0::double, 4000.0::double / greatest(x1 - x0, y1 - y0)) as s from e)
    select slide_id, tile_idx, round((position_x - x0) * s, 3) as mx, round((position_y - y0) * s, 3) as my, cast(ceil((x1 - x0) * s) as int) as out_w, cast(ceil((y1 - y0) * s) as int) as out_h
    from tiles join c using (slide_id)""", "tiles")
def a13_mosaic(s, d):
    return R.mosaic(load(s, d, "tiles"), ["slide_id"]).select("slide_id", "tile_idx", "mx", "my", "out_w", "out_h")


_CAND = "select slide_id, view_id % 40 as id, count(*) as cells, avg(x)::double as area_score, count(*) filter (where y % 2 = 0) / count(*)::double as uniformity from views group by 1, 2"


def _cand(s, d):
    return load(s, d, "views").groupBy("slide_id", (F.col("view_id") % 40).alias("id")).agg(
        F.count("*").alias("cells"), F.avg("x").alias("area_score"), (F.count_if(F.col("y") % 2 == 0) / F.count("*")).alias("uniformity"))


@query(f"""with c as ({_CAND}), b as (select *, row_number() over (partition by slide_id order by area_score desc, id) as n from c)
    select slide_id, id, round(area_score, 6) as area_score, round(uniformity, 6) as uniformity from b where n <= 3 qualify row_number() over (partition by slide_id order by uniformity desc, n) = 1""", "views")
def w1_most_uniform(s, d):
    return R.most_uniform(_cand(s, d), ["slide_id"]).select("slide_id", "id", _r("area_score").alias("area_score"), _r("uniformity").alias("uniformity"))


_SIZES = [(f"{rw}::double", f"{rh}::double") for rw, rh in cover.ASPECTS]


@query(f"""with m as (select distinct p_size as m from part), a as (select unnest([{', '.join(a for a, _ in _SIZES)}]) as rw, unnest([{', '.join(b for _, b in _SIZES)}]) as rh),
    s as (select cast(round_even(sqrt(m * 8 / (rw * rh)) * rw, 0) as int) as w, cast(round_even(sqrt(m * 8 / (rw * rh)) * rh, 0) as int) as h from m, a)
    select distinct w + 1 - w % 2 as w, h + 1 - h % 2 as h from s""")
def r1_rect_sizes(s, d):
    return cover.sizes_of(load(s, d, "part").select(F.col("p_size").alias("m")).distinct())


_RQ = [(4, 1), (17, 3), (15, 13), (2, 11)]


@query(f"select slide_id, cast(x.i as int) as gx, cast(y.i as int) as gy from (select distinct slide_id from tiles), range(20) x(i), range(16) y(i) where {_quad_sql('x.i', 'y.i', _RQ)}", "tiles")
def r3_cells_in_quad(s, d):
    return R.cells_in_quad(_slides(s, d), _RQ, 20, 16)


@query("""with c as (select slide_id, tile_idx as id, count(*) as cells from detections group by 1, 2), t as (select slide_id, sum(cells) as total from c group by 1),
    l as (select *, case when cells >= 60 then list_min(list_filter(range(41), lambda k: cells <= 60 * (1 + 0.2::double * pow(2.0::double, k)) and (k = 0 or 60 * (1 + 0.2::double * pow(2.0::double, k)) <= total))) end as level from c join t using (slide_id)),
    b as (select slide_id, min(level) as best, arg_min(id, cells * -1000 + id) as most from l group by 1)
    select slide_id, id, cells from l join b using (slide_id) where level = best or (best is null and id = most)""", "detections")
def r4_near_target(s, d):
    c = load(s, d, "detections").groupBy("slide_id", F.col("tile_idx").alias("id")).agg(F.count("*").alias("cells"))
    return R.near_target(c, c.groupBy("slide_id").agg(F.sum("cells").alias("total")), ["slide_id"], 60).select("slide_id", "id", "cells")


@query(f"""with {_GRID} select g.slide_id, gx, gy, t.position_x + case when gx % 2 = 0 then 0 else 1224 end as x, t.position_y + case when gy % 2 = 0 then 0 else 1024 end as y, 3 * 1224 as w, 2 * 1024 as h
    from grid g join tiles t on g.slide_id = t.slide_id and t.col_index = g.gx // 2 and t.row_index = 7 - g.gy // 2""", "blocks_raw", "tiles")
def r8_grid_to_pixels(s, d):
    g = _grid(s, d).withColumn("gw", F.lit(3)).withColumn("gh", F.lit(2))
    return R.grid_to_pixels(g, load(s, d, "tiles"), AREA).select("slide_id", "gx", "gy", "x", "y", "w", "h")


@query("""with v as (select *, view_id % 5 as region, row_number() over (partition by slide_id, view_id % 5 order by x, y, view_id) as n, x + 192.0::double as mx, y + 141.5::double as my from views),
    t as (select v.slide_id, v.view_id, min(t.tile_idx) as tile_idx from v join tiles t on v.slide_id = t.slide_id and mx >= position_x and mx < position_x + 2448 and my >= position_y and my < position_y + 2048 group by 1, 2),
    f as (select c.slide_id, min(v.view_id) as view_id, c.cell_id, any_value(c.gx) as cx, any_value(c.gy) as cy, any_value(c.w) as cw from cells_true c join views v on v.slide_id = c.slide_id
      and c.gx >= v.x and c.gx < v.x + v.w and c.gy >= v.y and c.gy < v.y + v.h group by 1, 3),
    n as (select f.slide_id, f.view_id, count(*) as cells, sum(cx - i.position_x - cast(round_even(cw + 0.5::double, 0) as int) // 2) as sum_x from f join t using (slide_id, view_id) join tiles i using (slide_id, tile_idx) group by 1, 2)
    select v.slide_id, cast(v.region as int) as region, cast(v.n as int) as sort_id, case when v.region = 0 then 'False' else 'True' end as flag, 7 - i.row_index as row_index, i.col_index, v.x - i.position_x as view_pos_x,
    v.y - i.position_y as view_pos_y, cast(coalesce(n.cells, 0) as int) as cells, cast(coalesce(n.sum_x, 0) as bigint) as sum_x from v join t using (slide_id, view_id) join tiles i using (slide_id, tile_idx)
    left join n on n.slide_id = v.slide_id and n.view_id = v.view_id""", "views", "tiles", "cells_true")
def r14_task_records(s, d):
    cells = load(s, d, "cells_true").selectExpr("slide_id", "cell_id", "gx as cx", "gy as cy", "w + 0.5D as cw", "h + 0.5D as ch")
    owner = spatial.first_cover(_points(s, d), _view_boxes(s, d), ["slide_id"], "cell_id", "view_id", 512)
    r = K.records(load(s, d, "views").withColumn("region", (F.col("view_id") % 5).cast("int")), cells.join(owner, ["slide_id", "cell_id"]), load(s, d, "tiles"), 7)
    return r.select("slide_id", "region", "sort_id", F.col("Adition_shooting_flag").alias("flag"), "row_index", "col_index", "view_pos_x", "view_pos_y", F.size("cell_list").alias("cells"),
                    F.aggregate("cell_list", F.lit(0).cast("long"), lambda a, c: a + c["cell_x"]).alias("sum_x"))


@query(f"""with {_GLOBAL}, l as (select slide_id, cell_id, tile_idx, X1g, Y1g, X2g, Y2g, row_number() over (partition by slide_id order by cell_id, tile_idx) - 1 as n from g where X1g <= 12000 and X2g >= 3000 and Y1g <= 9000 and Y2g >= 2000)
    select slide_id, 'WBC' as view_type, cast(n // 500 as int) as page, cast(n % 500 as int) as place, cell_id, tile_idx, X1g as x1, Y1g as y1, X2g as x2, Y2g as y2 from l""", "detections", "tiles")
def r16_roi_task(s, d):
    """One view over a region, with the list of its cells in pages of 500."""
    t = K.roi_tasks(T.to_global(load(s, d, "detections"), load(s, d, "tiles")), (3000, 2000, 12000, 9000), page=500)
    return t.select("slide_id", "view_type", "page", F.posexplode("cell_list").alias("place", "c")).select("slide_id", "view_type", "page", "place", *(f"c.{n}" for n in ("cell_id", "tile_idx", "x1", "y1", "x2", "y2")))
