"""The registered queries over derived slide tables, each with DuckDB SQL that gives the same rows."""

from pyspark.sql import functions as F
from tilelake.fixtures import load, oracle
from tilelake.functions.geometry import area, iou, over_smaller
from tilelake.operators import cover, heatmap, spatial, suppress, tiles as T
from tilelake.sources import files
from tilelake.streaming import uploads as S

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
ROI = (3000, 2000, 12000, 9000)
USER_AREA = {"min_row": 1, "max_row": 6, "min_col": 1, "max_col": 8}


def query(sql: str | None = None, *tables: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = oracle(sql, *tables)
        return f

    return add


def _r(c, n: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def _box_cells(s, d):
    return T.to_global(load(s, d, "detections"), load(s, d, "tiles"))


_GLOBAL = """g as (select d.*, d.x1 + t.position_x as X1g, d.y1 + t.position_y as Y1g, d.x2 + t.position_x as X2g, d.y2 + t.position_y as Y2g
    from detections d join tiles t using (slide_id, tile_idx))"""


def _settle(rounds: int = 5) -> str:
    """Common table expressions k1, s1, ... over nodes(g, id) and edges(g, u, v); s{rounds} holds the suppressed."""
    out = ["k1 as materialized (select g, u from edges where (g, u) not in (select (g, v) from edges))".replace("(select (g, v)", "(select g, v"),
           "s1 as materialized (select distinct e.g, e.v from edges e join k1 using (g, u))"]
    for i in range(2, rounds + 1):
        p = i - 1
        out.append(f"b{i} as materialized (select distinct e.g, e.v from edges e left join s{p} s on e.g = s.g and e.u = s.v where s.v is null)")
        out.append(f"k{i} as materialized (select distinct e.g, e.u from edges e left join s{p} s on e.g = s.g and e.u = s.v left join b{i} b on e.g = b.g and e.u = b.v where s.v is null and b.v is null)")
        out.append(f"s{i} as materialized (select distinct e.g, e.v from edges e join k{i} using (g, u))")
    return ", ".join(out)


def _iou(a: str, b: str) -> str:
    i = f"(greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0)::double * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0))"
    area = lambda p: f"(({p}.x2 - {p}.x1)::double * ({p}.y2 - {p}.y1))"
    return f"({i} / ({area(a)} + {area(b)} - {i}))"


# ---- suppression ---------------------------------------------------------------------------------------------------

@query(f"""with bx as (select d.slide_id, d.tile_idx, d.cell_id, d.score, d.x1 + t.position_x as x1, d.y1 + t.position_y as y1, d.x2 + t.position_x as x2, d.y2 + t.position_y as y2,
      d.tile_idx::bigint * 1000000000000000 + d.cell_id as id from detections d join tiles t using (slide_id, tile_idx) where d.label = 0),
    pr as (select a.slide_id, a.tile_idx as ti, b.tile_idx as tj, greatest(a.position_x, b.position_x) as l, greatest(a.position_y, b.position_y) as t,
      least(a.position_x, b.position_x) + 2448 as r, least(a.position_y, b.position_y) + 2048 as bt from tiles a join tiles b on a.slide_id = b.slide_id
      and ((b.row_index = a.row_index and b.col_index = a.col_index + 1) or (b.row_index = a.row_index - 1 and abs(b.col_index - a.col_index) <= 1))),
    band as (select p.slide_id * 10000 + p.ti * 100 + p.tj as g, p.slide_id, x.id, x.score, x.x1, x.y1, x.x2, x.y2 from pr p join bx x on x.slide_id = p.slide_id and x.tile_idx in (p.ti, p.tj)
      where x.x1 < r and x.x2 > l and x.y1 < bt and x.y2 > t and l < r and t < bt),
    edges as materialized (select a.g, a.id as u, b.id as v from band a join band b on a.g = b.g and (a.score > b.score or (a.score = b.score and a.id < b.id)) where {_iou('a', 'b')} > 0.2),
    {_settle()}, gone as (select distinct g // 10000 as slide_id, v as id from s5)
    select x.slide_id, x.tile_idx, count(*) as kept, cast(sum(x.cell_id % 1000003) as bigint) as id_sum from bx x left join gone using (slide_id, id) where gone.id is null group by 1, 2""", "detections", "tiles")
def n2_cross_tile_dedup(s, d):
    kept = suppress.cross_tile_dedup(load(s, d, "detections"), load(s, d, "tiles"))
    return kept.groupBy("slide_id", "tile_idx").agg(F.count("*").alias("kept"), F.sum(F.col("cell_id") % 1000003).alias("id_sum"))


def _megs(s, d):
    m = load(s, d, "megs").join(load(s, d, "tiles").select("slide_id", "tile_idx", "position_x", "position_y"), ["slide_id", "tile_idx"])
    return m.select("slide_id", F.col("meg_id").alias("id"), "rate", (F.col("x") + F.col("position_x")).alias("x1"), (F.col("y") + F.col("position_y")).alias("y1"),
                    (F.col("x") + F.col("position_x") + F.col("w")).alias("x2"), (F.col("y") + F.col("position_y") + F.col("h")).alias("y2"))


_MEGS = """mg as (select m.slide_id, m.meg_id as id, m.rate, m.x + t.position_x as x1, m.y + t.position_y as y1, m.x + t.position_x + m.w as x2, m.y + t.position_y + m.h as y2
    from megs m join tiles t using (slide_id, tile_idx))"""


def _nms_sql(score: str, where: str) -> str:
    return f"""with {_MEGS}, nb as (select *, slide_id as g, {score} as sc from mg),
    edges as materialized (select a.g, a.id as u, b.id as v from nb a join nb b on a.g = b.g and (a.sc > b.sc or (a.sc = b.sc and a.id < b.id)) where {where}), {_settle()}
    select n.slide_id, n.id as meg_id, n.x1, n.y1, n.x2, n.y2 from nb n left join s5 s on n.g = s.g and n.id = s.v where s.v is null"""


def _kept(df):
    return df.select("slide_id", F.col("id").alias("meg_id"), "x1", "y1", "x2", "y2")


@query(_nms_sql("rate", _iou("a", "b") + " > 0.7"), "megs", "tiles")
def n3_greedy_nms(s, d):
    return _kept(suppress.nms(_megs(s, d).withColumn("score", F.col("rate")), ["slide_id"], 0.7, 512))


@query(_nms_sql("(x2 - x1)::double * (y2 - y1)", _iou("a", "b") + " > 0.9"), "megs", "tiles")
def n5_meg_global_nms(s, d):
    return _kept(suppress.meg_boxes(_megs(s, d), ["slide_id"]))


@query(_nms_sql("(x2 - x1)::double * (y2 - y1)", """(greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0)::double * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0))
    / least((a.x2 - a.x1)::double * (a.y2 - a.y1), (b.x2 - b.x1)::double * (b.y2 - b.y1)) > 0.45"""), "megs", "tiles")
def n6_containment(s, d):
    return _kept(suppress.contained(_megs(s, d), ["slide_id"], 0.45, 512))


@query("""select slide_id, x // 50 as x1, y // 50 as y1, w // 50 as x2, h // 50 as y2, min(meg_id) as id from megs group by 1, 2, 3, 4, 5""", "megs")
def o3_first_of_equal(s, d):
    m = load(s, d, "megs").selectExpr("slide_id", "meg_id as id", *(f"cast({c} div 50 as int) as {n}" for c, n in zip("xywh", suppress.BOX)))
    return suppress.first_of_equal(m, ["slide_id"])


@query(f"""with b as (select cast(0 as bigint) as slide_id, view_id as id, x as x1, y as y1, x + w as x2, y + h as y2 from views)
    select a.slide_id, a.id as a, b.id as b, round({_iou('a', 'b')}, 6) as iou from b a join b on a.slide_id = b.slide_id and a.id < b.id where {_iou('a', 'b')} > 0.01""", "views")
def j13_pairwise_iou(s, d):
    # every view against every other: all of them lie on one slide here
    v = load(s, d, "views").selectExpr("cast(0 as bigint) as slide_id", "view_id", "x as x1", "y as y1", "x + w as x2", "y + h as y2")
    v = v.hint("merge")  # shuffled by bucket: broadcast, a part file of a few MB is joined by the one or two tasks that read it
    return spatial.overlapping_pairs(v, ["slide_id"], "view_id", 512, 0.01).select("slide_id", "a", "b", _r("iou").alias("iou"))


# ---- tiles and coordinates -------------------------------------------------------------------------------------------

@query("""with g as (select s.slide_id, r.r as row_index, c.c as col_index from (select distinct slide_id from tiles) s, range(8) r(r), range(10) c(c))
    select g.slide_id, cast(g.row_index as int) as row_index, cast(g.col_index as int) as col_index, cast(t.slide_id is null as int) as position_missing, cast(t.image_uid is null as int) as image_missing
    from g left join tiles t using (slide_id, row_index, col_index) where t.slide_id is null or t.image_uid is null""", "tiles")
def j1_missing_tiles(s, d):
    return T.missing_tiles(load(s, d, "tiles"), 8, 10)


@query("""with l as (select slide_id, case when slide_id % 3 = 2 then 0 else cast(7 + slide_id % 3 as int) end as rows, cast(9 + slide_id % 2 as int) as cols from (select distinct slide_id from tiles)),
    g as (select l.slide_id, r.r as row_index, c.c as col_index from l, range(9) r(r), range(10) c(c) where r.r < rows and c.c < cols)
    select g.slide_id, cast(g.row_index as int) as row_index, cast(g.col_index as int) as col_index, cast(t.slide_id is null as int) as position_missing, cast(t.image_uid is null as int) as image_missing
    from g left join tiles t using (slide_id, row_index, col_index) where t.slide_id is null or t.image_uid is null
    union all select slide_id, row_index, col_index, 0, 1 from tiles join l using (slide_id) where rows = 0 and image_uid is null""", "tiles")
def j1_layers_of_slides(s, d):
    """Slides of different grids, sparse ones among them, in one call."""
    t = load(s, d, "tiles")
    layers = t.select("slide_id").distinct().selectExpr("slide_id", "case when slide_id % 3 = 2 then 0 else cast(7 + slide_id % 3 as int) end as rows", "cast(9 + slide_id % 2 as int) as cols")
    return T.missing_by_layer(t, layers)


@query(f"with {_GLOBAL} select slide_id, tile_idx, cell_id, X1g as x1, Y1g as y1, X2g as x2, Y2g as y2 from g", "detections", "tiles")
def f3_global_boxes(s, d):
    return _box_cells(s, d).select("slide_id", "tile_idx", "cell_id", "x1", "y1", "x2", "y2")


@query("select slide_id, tile_idx, row_index, cast(7 - row_index as int) as flipped from tiles", "tiles")
def f4_row_flip(s, d):
    return T.flip_rows(load(s, d, "tiles"), 8).select("slide_id", "tile_idx", "row_index", "flipped")


@query("select slide_id, tile_idx, cell_id, score from detections where row_index between 1 and 6 and col_index between 1 and 8", "detections")
def f1_user_area(s, d):
    return T.in_user_area(load(s, d, "detections"), USER_AREA).select("slide_id", "tile_idx", "cell_id", "score")


@query(f"with {_GLOBAL} select slide_id, tile_idx, cell_id from g where X1g <= 12000 and X2g >= 3000 and Y1g <= 9000 and Y2g >= 2000", "detections", "tiles")
def f2_roi_cells(s, d):
    return T.in_roi(_box_cells(s, d), *ROI).select("slide_id", "tile_idx", "cell_id")


@query("select slide_id, tile_idx, cell_id, score from detections where label = 0", "detections")
def f7_nucleated(s, d):
    return T.of_label(load(s, d, "detections")).select("slide_id", "tile_idx", "cell_id", "score")


@query("""select d.slide_id, d.tile_idx, d.cell_id from detections d where exists (select 1 from mask_pixels m where m.slide_id = d.slide_id and m.tile_idx = d.tile_idx
    and m.px = cast(floor((d.x1 + d.x2) / 8.0::double) as int) and m.py = cast(floor((d.y1 + d.y2) / 8.0::double) as int) and m.white > 128)""", "detections", "mask_pixels")
def f8_on_white(s, d):
    return T.on_white(load(s, d, "detections"), load(s, d, "mask_pixels"), 128).select("slide_id", "tile_idx", "cell_id")


@query("""select slide_id, tile_idx, cell_id, round(greatest(0, least((x1 - 12.0::double) / 0.5::double, 2448)), 6) as x1, round(greatest(0, least((y1 - 8.0::double) / 0.5::double, 2048)), 6) as y1,
    round(greatest(0, least((x2 - 12.0::double) / 0.5::double, 2448)), 6) as x2, round(greatest(0, least((y2 - 8.0::double) / 0.5::double, 2048)), 6) as y2 from detections""", "detections")
def f12_unpad(s, d):
    return T.unpad(load(s, d, "detections"), 0.5, 12.0, 8.0, 2448, 2048).select("slide_id", "tile_idx", "cell_id", *(_r(c).alias(c) for c in ("x1", "y1", "x2", "y2")))


@query("""select slide_id, meg_id, greatest(0, least(cast(trunc(x + w / 2.0::double - w) as int), 612)) * 4 as x1, greatest(0, least(cast(trunc(y + h / 2.0::double - h) as int), 512)) * 4 as y1,
    greatest(0, least(cast(trunc(x + w / 2.0::double + w) as int), 612)) * 4 as x2, greatest(0, least(cast(trunc(y + h / 2.0::double + h) as int), 512)) * 4 as y2 from megs""", "megs")
def f13_widen(s, d):
    return T.widen(load(s, d, "megs"), 2, 612, 512, 4).select("slide_id", "meg_id", "x1", "y1", "x2", "y2")


@query("""select slide_id, tile_idx, cell_id, cast(floor((x1 + x2) / 2.0::double) as int) as cx, cast(floor((y1 + y2) / 2.0::double) as int) as cy, greatest(x2 - x1 + 1, 1) as w, greatest(y2 - y1 + 1, 1) as h
    from detections""", "detections")
def f15_centres(s, d):
    return T.centre(load(s, d, "detections")).select("slide_id", "tile_idx", "cell_id", "cx", "cy", "w", "h")


@query("""select slide_id, tile_idx, px, py, greatest(0, least(px - 12, 612)) as x1, greatest(0, least(py - 12, 512)) as y1, greatest(0, least(px + 12, 612)) as x2, greatest(0, least(py + 12, 512)) as y2
    from peaks where center = center_pool and center >= 0.2 and white >= 0.3""", "peaks")
def f18_local_peaks(s, d):
    return T.local_peaks(load(s, d, "peaks"), 0.2, 0.3, 25, 612, 512).select("slide_id", "tile_idx", "px", "py", "x1", "y1", "x2", "y2")


@query("""select slide_id, tile_idx, cast(i.i as int) as i, cast(j.j as int) as j, cast(case when j.j = 2 then 2448 - 928 else trunc(j.j * (928 * 0.9::double)) end as int) as wx,
    cast(case when i.i = 2 then 2048 - 928 else trunc(i.i * (928 * 0.9::double)) end as int) as wy from tiles, range(3) i(i), range(3) j(j)""", "tiles")
def f20_windows(s, d):
    return T.windows(load(s, d, "tiles"), 928).select("slide_id", "tile_idx", "i", "j", "wx", "wy")


@query("""select slide_id, tile_idx, position_x, position_y from tiles where position_x + 2448 > 3000 and position_x < 12000 and position_y + 2048 > 2000 and position_y < 9000""", "tiles")
def f17_visible_tiles(s, d):
    return T.visible(load(s, d, "tiles"), *T.viewport(-1500, -1000, 0.5, 4500, 3500)).select("slide_id", "tile_idx", "position_x", "position_y")


@query("""select m.slide_id, m.meg_id, greatest(0, least(m.x - 40, 2448 - 384)) as vx, greatest(0, least(m.y - 40, 2048 - 283)) as vy from megs m""", "megs")
def f16_clamp_view(s, d):
    return load(s, d, "megs").select("slide_id", "meg_id", T.clamp_view(F.col("x"), F.lit(40), 384, 2448).alias("vx"), T.clamp_view(F.col("y"), F.lit(40), 283, 2048).alias("vy"))


@query("""select a.slide_id, a.tile_idx as ti, b.tile_idx as tj from tiles a join tiles b on a.slide_id = b.slide_id
    and ((b.row_index = a.row_index and b.col_index = a.col_index + 1) or (b.row_index = a.row_index - 1 and abs(b.col_index - a.col_index) <= 1))""", "tiles")
def j5_adjacent_tiles(s, d):
    return spatial.adjacent_tiles(load(s, d, "tiles")).select("slide_id", "ti", "tj")


@query("""select distinct t.slide_id, t.row_index, t.col_index from tiles t join tiles c on c.slide_id = t.slide_id and c.tile_idx % 17 = 3
    and abs(t.row_index - c.row_index) <= 1 and abs(t.col_index - c.col_index) <= 1""", "tiles")
def j6_halo(s, d):
    t = load(s, d, "tiles")
    return spatial.halo(t.where("tile_idx % 17 = 3"), t)


@query("""select p.slide_id, p.cell_id, v.view_id from (select slide_id, cell_id, gx as x, gy as y from cells_true) p join views v
    on v.slide_id = p.slide_id and p.x between v.x and v.x + v.w and p.y between v.y and v.y + v.h""", "cells_true", "views")
def j7_rect_covers_point(s, d):
    v = load(s, d, "views").selectExpr("slide_id", "view_id", "x as x1", "y as y1", "x + w as x2", "y + h as y2")
    return spatial.points_in_boxes(load(s, d, "cells_true").selectExpr("slide_id", "cell_id", "gx as x", "gy as y"), v, ["slide_id"], 512, closed=True).select("slide_id", "cell_id", "view_id")


@query("""select p.slide_id, p.cell_id, min(v.view_id) as view_id from cells_true p join views v
    on v.slide_id = p.slide_id and p.gx >= v.x and p.gx < v.x + v.w and p.gy >= v.y and p.gy < v.y + v.h group by 1, 2""", "cells_true", "views")
def j10_first_cover(s, d):
    v = load(s, d, "views").selectExpr("slide_id", "view_id", "x as x1", "y as y1", "x + w as x2", "y + h as y2")
    return spatial.first_cover(load(s, d, "cells_true").selectExpr("slide_id", "cell_id", "gx as x", "gy as y"), v, ["slide_id"], "cell_id", "view_id", 512)


@query("""select slide_id, view_id, tile_idx, dist2 from (select v.slide_id, v.view_id, t.tile_idx, (v.x - t.position_x - 1224.0::double) * (v.x - t.position_x - 1224.0::double)
      + (v.y - t.position_y - 1024.0::double) * (v.y - t.position_y - 1024.0::double) as dist2,
      row_number() over (partition by v.slide_id, v.view_id order by (v.x - t.position_x - 1224.0::double) * (v.x - t.position_x - 1224.0::double)
      + (v.y - t.position_y - 1024.0::double) * (v.y - t.position_y - 1024.0::double), t.tile_idx) as n from views v join tiles t using (slide_id)) where n = 1""", "views", "tiles")
def j4_nearest_tile(s, d):
    return T.nearest_tile(load(s, d, "views").select("slide_id", "view_id", "x", "y"), load(s, d, "tiles"), ["view_id"])


# ---- scores ------------------------------------------------------------------------------------------------------------

_SM = ", ".join(f"exp(least(l{i}, 32)) / (" + " + ".join(f"exp(least(l{k}, 32))" for k in range(7)) + f") as p{i}" for i in range(7))
_TOP = "greatest(" + ", ".join(f"p{i}" for i in range(7)) + ")"
_ARG = "case " + " ".join(f"when p{i} = {_TOP} then {i}" for i in range(7)) + " end"
_W = [64, 32, 16, 8, 4, 2, 1]
_BLOCKS = f"""p as (select *, {_SM} from blocks_raw), gr as (select *, {_ARG} as grade from p),
    bl as (select *, case when grade <= 2 then {' + '.join(f'p{i} * {w}' for i, w in enumerate(_W))} {' '.join(f'when grade = {i} then {w}' for i, w in enumerate(_W))} end as g from gr)"""


def _blocks(s, d):
    b = load(s, d, "blocks_raw").withColumn("p", heatmap.softmax(F.array(*(f"l{i}" for i in range(7)))))
    return b.withColumn("label", heatmap.grade(F.col("p"))).withColumn("g", heatmap.expected_weight(F.col("p")))


@query(f"with {_BLOCKS} select slide_id, tile_idx, dx, dy, cast(grade as int) as grade, round(g, 6) as weight from bl", "blocks_raw")
def x1_block_grade(s, d):
    return _blocks(s, d).select("slide_id", "tile_idx", "dx", "dy", F.col("label").alias("grade"), _r("g").alias("weight"))


_LOG = """ln(case when g > 45 and g <= 64 then 0.0085::double * g when g > 24 and g <= 45 then 0.0055::double * g else 0.00016875::double * g end)
    + ln(greatest(0.25::double * t * exp(-t / 2) / 0.55::double, 0.0257::double) + 0.1::double)
    + ln(greatest(exp(-((z - 8.620618882524237::double) * (z - 8.620618882524237::double)) / (2 * 2.386065801133071::double * 2.386065801133071::double)) / (2.386065801133071::double * sqrt(2 * pi())), 0.01::double) + 0.15::double)"""
_SCORED = f"""{_BLOCKS}, tz as (select *, (5.52::double / 5526 * nuc_area + (0.08::double - 78 * (5.52::double / 5526))) / 0.55::double as t,
    15.0::double / 14710 * red_area + (3 - 3076 * (15.0::double / 14710)) as z from bl), sc as (select *, {_LOG} as score from tz)"""


def _scored(s, d):
    return _blocks(s, d).withColumn("score", heatmap.log_score(F.col("g"), F.col("nuc_area"), F.col("red_area")))


@query(f"with {_SCORED} select slide_id, tile_idx, dx, dy, round(score, 6) as score from sc", "blocks_raw")
def x2_block_log_score(s, d):
    return _scored(s, d).select("slide_id", "tile_idx", "dx", "dy", _r("score").alias("score"))


_GRID = f"""{_SCORED}, ex as (select slide_id, min(col_index) as c0, max(row_index) as r1 from tiles group by 1),
    grid as (select t.slide_id, dx + 2 * (col_index - c0) as gx, dy + 2 * (r1 - row_index) as gy, score, grade as label from sc join tiles t using (slide_id, tile_idx) join ex using (slide_id))"""


def _grid(s, d):
    return heatmap.heat_map(_scored(s, d), load(s, d, "tiles"))


@query(f"with {_GRID} select slide_id, gx, gy, round(score, 6) as score, cast(label as int) as label from grid", "blocks_raw", "tiles")
def a1_heat_map(s, d):
    return _grid(s, d).select("slide_id", "gx", "gy", _r("score").alias("score"), "label")


@query(f"""with {_GRID}, per as (select slide_id, gx, count(*) as n from grid where score > -6 group by 1, 2 having count(*) > 1)
    select slide_id, min(gx) as lo, max(gx) as hi, cast((max(gx) - min(gx) + 1) // 5 + min(gx) as int) as crop_w from per group by 1""", "blocks_raw", "tiles")
def a4_head_crop(s, d):
    return heatmap.head_crop(_grid(s, d), -6.0, 16)


@query(f"with {_GRID} select slide_id, round(avg(score), 6) as mean_score, count(*) as cells from grid where score <> -1000 group by 1", "blocks_raw", "tiles")
def a5_mean_score(s, d):
    return heatmap.mean_score(_grid(s, d)).withColumn("mean_score", _r("mean_score"))


@query(f"""with {_GRID}, r as (select slide_id, min(score) as lo, max(score) as hi from grid group by 1)
    select slide_id, gx, gy, cast(trunc((score - lo) / (hi - lo + 0.00001::double) * 255) as int) as grey from grid join r using (slide_id)""", "blocks_raw", "tiles")
def a12_grey(s, d):
    return heatmap.grey(_grid(s, d))


@query(f"with {_SCORED} select slide_id, tile_idx, dx, dy from sc where grade <> 5", "blocks_raw")
def f9_not_particle(s, d):
    return heatmap.off_label(_scored(s, d)).select("slide_id", "tile_idx", "dx", "dy")


@query(f"""with e as (select vec_id, unnest(range(len(embedding))) as type, exp(least(cast(unnest(embedding) as double) * 8, 32)) as x from embeddings),
    p as (select vec_id, type, x / sum(x) over (partition by vec_id) as percent from e)
    select vec_id, cast(row_number() over (partition by vec_id order by percent desc, type) as int) as rank, cast(type as int) as type, round(percent, 6) as percent from p
    qualify row_number() over (partition by vec_id order by percent desc, type) <= 5""")
def w2_softmax_top_k(s, d):
    e = load(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 8).alias("l"))
    t = e.select("vec_id", F.posexplode(heatmap.top_k(heatmap.softmax(F.col("l")), 5)).alias("rank", "t"))
    return t.select("vec_id", (F.col("rank") + 1).alias("rank"), F.col("t.type").alias("type"), _r(F.col("t.percent")).alias("percent"))


@query("""select vec_id, cast(list_position(embedding, list_max(embedding)) - 1 as int) as label from embeddings where list_max(embedding) >= 0.1::float""")
def f5_class_argmax(s, d):
    return heatmap.classes(load(s, d, "embeddings"), F.col("embedding"), F.lit(0.1).cast("float")).select("vec_id", "label")


@query("""select slide_id, tile_idx, cell_id, cast(row_number() over (partition by slide_id, tile_idx order by score desc, cell_id) as int) as rank from detections
    qualify row_number() over (partition by slide_id, tile_idx order by score desc, cell_id) <= 20""", "detections")
def w3_top_k_boxes(s, d):
    return suppress.best_scores(load(s, d, "detections").withColumnRenamed("cell_id", "id"), ["slide_id", "tile_idx"], 20).select("slide_id", "tile_idx", F.col("id").alias("cell_id"), "rank")


# ---- aggregates, order and sets ----------------------------------------------------------------------------------------

@query("select slide_id, tile_idx, count(*) as cells, cast(sum(label) as bigint) as megs from detections group by 1, 2", "detections")
def a3_cells_per_tile(s, d):
    return T.cells_per_tile(load(s, d, "detections"))


@query("""select slide_id, min(gx) as x1, min(gy) as y1, max(gx + w) as x2, max(gy + h) as y2, greatest(max(gx) - min(gx), max(gy) - min(gy)) as span from cells_true group by 1""", "cells_true")
def a6_bounding_box(s, d):
    return spatial.bounds(load(s, d, "cells_true").selectExpr("slide_id", "gx as x1", "gy as y1", "gx + w as x2", "gy + h as y2"), ["slide_id"])


@query("""select slide_id, tile_idx, px // 306 as dx, py // 256 as dy, count(*) filter (where white > 200) as white_px, count(*) filter (where red > 128) as red_px from mask_pixels group by 1, 2, 3, 4""", "mask_pixels")
def a9_block_areas(s, d):
    m = load(s, d, "mask_pixels")
    blocks = m.select("slide_id", "tile_idx").distinct().withColumn("dx", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("dy", F.explode(F.array(F.lit(0), F.lit(1))))
    rects = blocks.select("*", (F.col("dx") * 306).alias("x1"), (F.col("dy") * 256).alias("y1"), (F.col("dx") * 306 + 306).alias("x2"), (F.col("dy") * 256 + 256).alias("y2"))
    return heatmap.pixel_areas(m, rects, ["slide_id", "tile_idx"], ["dx", "dy"])


@query("""select slide_id, view_id, x, y, cast(row_number() over (partition by slide_id order by x, y) as int) as sort_id from views""", "views")
def w4_sort_id(s, d):
    # the SQL leaves the order of views at one place open: here it is that of their numbers, the same in every run
    return cover.number_tasks(load(s, d, "views"), ["slide_id"], "view_id").select("slide_id", "view_id", "x", "y", "sort_id")


@query("""with f as (select slide_id, min_by(x, view_id) as fx, min_by(y, view_id) as fy from views group by 1)
    select slide_id, view_id, cast(row_number() over (partition by slide_id order by (x - fx) * (x - fx) + (y - fy) * (y - fy), view_id) as int) as pos from views join f using (slide_id)""", "views")
def w5_order_from_first(s, d):
    return cover.order_from_first(load(s, d, "views"), ["slide_id"], "view_id").select("slide_id", "view_id", "pos")


@query("select view_id, x, y from views order by x, y, view_id limit 50 offset 20", "views")
def w7_paging(s, d):
    return load(s, d, "views").orderBy("x", "y", "view_id").offset(20).limit(50).select("view_id", "x", "y")


@query("""select task_id, row_index, col_index, event_id from uploads qualify row_number() over (partition by task_id, row_index, col_index order by event_id desc) = 1""", "uploads")
def w9_latest_tile(s, d):
    return T.latest(load(s, d, "uploads"), ["task_id", "row_index", "col_index"], "event_id").select("task_id", "row_index", "col_index", "event_id")


@query("select slide_id, tile_idx from tiles except select slide_id, tile_idx from megs where rate > 0.7", "tiles", "megs")
def o2_remaining(s, d):
    return T.remaining(load(s, d, "tiles").select("slide_id", "tile_idx"), load(s, d, "megs").where("rate > 0.7"), ["slide_id", "tile_idx"])


@query("""with d as (select distinct doc_id, path, last_value(scalar_value) over (partition by doc_id, path order by seq rows between unbounded preceding and unbounded following) as v,
    count(*) over (partition by doc_id, path) as n from doc_updates) select doc_id, path, v as value, n from d""", "doc_updates")
def s11_merge_updates(s, d):
    u = load(s, d, "doc_updates")
    return files.merge_scalars(u.withColumnRenamed("scalar_value", "value"), ["doc_id"]).join(u.groupBy("doc_id", "path").agg(F.count("*").alias("n")), ["doc_id", "path"])


# ---- views and uploads ---------------------------------------------------------------------------------------------------

@query("""with i as (select slide_id, cell_id, gy, unnest(range(cast(ceil((gx - 384) / 96.0::double) as int), gx // 96 + 1)) as i from cells_true),
    j as (select slide_id, cell_id, i, unnest(range(cast(ceil((gy - 283) / 70.0::double) as int), gy // 70 + 1)) as j from i)
    select slide_id, cell_id, cast(i * 96 as int) as wx, cast(j * 70 as int) as wy from j""", "cells_true")
def r9_candidate_views(s, d):
    p = load(s, d, "cells_true").selectExpr("slide_id", "cell_id", "gx as x", "gy as y")
    return cover.windows_of(p, ["slide_id"], "cell_id", 384, 283, 0.25)


@query("""with b as (select slide_id, min(gx)::double as ax, max(gx)::double as zx, min(gy)::double as ay, max(gy)::double as zy from cells_true group by 1),
    n as (select slide_id, ((zx - ax) / 96 + 1) * ((zy - ay) / 70 + 1) as n from b), r as (select slide_id, case when n <= 20000 then 0.25::double else least(1.0::double, 0.25::double * sqrt(n / 20000)) end as ratio from n),
    st as (select slide_id, ratio, greatest(1, cast(floor(384 * ratio) as int)) as sx, greatest(1, cast(floor(283 * ratio) as int)) as sy from r),
    i as (select c.slide_id, cell_id, gy, sx, sy, unnest(range(cast(floor((gx - 384) / sx::double) as int) + 1, gx // sx + 1)) as i from cells_true c join st using (slide_id)),
    j as (select slide_id, cell_id, i * sx as wx, sy, unnest(range(cast(floor((gy - 283) / sy::double) as int) + 1, gy // sy + 1)) as j from i)
    select slide_id, wx, cast(j * sy as int) as wy, count(*) as points from j group by all""", "cells_true")
def r9_windows_by_slide(s, d):
    """Candidate windows with their points, at the stride of each slide."""
    p = load(s, d, "cells_true").selectExpr("slide_id", "cell_id", "gx as x", "gy as y")
    p = p.join(cover.stride_ratios(p, ["slide_id"], 384, 283), "slide_id")
    return cover.windows_of(p, ["slide_id"], "cell_id", 384, 283, F.col("ratio"), closed=False).groupBy("slide_id", "wx", "wy").agg(F.count("*").alias("points"))


@query("select slide_id, count(*) as points, count(*) as gained, cast(0 as bigint) as idle, cast(0 as bigint) as uncovered from cells_true group by 1", "cells_true")
def r10_set_cover(s, d):
    """Cover of all cells.  Each cell belongs to the first of the windows that hold it (`gained`); none is without a cell of its own (`idle`), no cell is left out."""
    p = load(s, d, "cells_true").selectExpr("slide_id", "cell_id", "gx as x", "gy as y")
    chosen = suppress._cut(cover.cover(p, ["slide_id"], "cell_id", 1224, 1024, 0.5))
    boxes = chosen.selectExpr("slide_id", "wx as x1", "wy as y1", "wx + 1224 as x2", "wy + 1024 as y2", "struct(-points as n, wx, wy) as view")
    first = spatial.points_in_boxes(p, boxes, ["slide_id"], 1024, closed=True).groupBy("slide_id", "cell_id").agg(F.min("view").alias("view"))
    gains = boxes.select("slide_id", "view").join(first.groupBy("slide_id", "view").agg(F.count("*").alias("gain")), ["slide_id", "view"], "left")
    gains = gains.groupBy("slide_id").agg(F.sum("gain").alias("gained"), F.count_if(F.col("gain").isNull()).alias("idle"))
    return p.join(first, ["slide_id", "cell_id"], "left").groupBy("slide_id").agg(F.count("*").alias("points"), F.count_if(F.col("view").isNull()).alias("uncovered")).join(gains, "slide_id")


@query("""select event_id, task_id, cast(case when n_bytes = 0 then 201 when row_number() over (partition by task_id, row_index, col_index, n_bytes > 0 order by ts, event_id) > 1 then 103 else 0 end as int) as code
    from uploads""", "uploads")
def st1_upload_codes(s, d):
    return T.upload_status(load(s, d, "uploads")).select("event_id", "task_id", "code")


@query("""select task_id, count(distinct case when n_bytes > 0 then row_index * 2 + col_index end) as received, cast(4 as bigint) as expected,
    4 - count(distinct case when n_bytes > 0 then row_index * 2 + col_index end) as missing,
    cast(case when count(distinct case when n_bytes > 0 then row_index * 2 + col_index end) = 4 then 100 else 101 end as int) as status from uploads group by 1""", "uploads")
def st6_progress(s, d):
    return T.progress(load(s, d, "uploads"), 2, 2)


@query("""with l as (select task_id, ts, case when ts - lag(ts) over (partition by task_id order by ts) < interval 6 hours then 0 else 1 end as new from uploads),
    g as (select task_id, ts, sum(new) over (partition by task_id order by ts rows unbounded preceding) as k from l)
    select task_id, min(ts) as start_ts, max(ts) + interval 6 hours as end_ts, count(*) as n from g group by task_id, k""", "uploads")
def st4_idle_sessions(s, d):
    return S.idle_sessions(load(s, d, "uploads"), "6 hours")
