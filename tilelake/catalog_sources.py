"""Registered queries that write and read files of slides, and flatten the output of models."""

from pyspark.sql import functions as F

from tilelake.catalog import _r, query
from tilelake.fixtures import load
from tilelake.operators import heatmap
from tilelake.session import shared_folder
from tilelake.sources import documents, files, models, saved


def _text_cells(s, d):
    c = files.by_slide(load(s, d, "detections").join(load(s, d, "tiles").select("slide_id", "tile_idx", "position_x", "position_y"), ["slide_id", "tile_idx"]))
    fields = ["col_index", "row_index", "position_x + 1224", "position_y + 1024", "1", "x1", "y1", "x1 + position_x", "y1 + position_y"]
    line = F.concat_ws(" ", *(F.expr(f"cast({e} as string)") for e in fields))
    path = shared_folder(s, "cells")
    files.write_lines(c.select("slide_id", F.when(F.col("cell_id") % 97 == 0, F.concat(line, F.lit(" 0"))).otherwise(line).alias("value")), path)
    return files.read_cells(s, path)


_CELLS = """select d.slide_id, d.col_index as ix, d.row_index as iy, t.position_x as abs_x, t.position_y as abs_y, cast(d.x1 as double) as local_x, cast(d.y1 as double) as local_y,
    cast(d.x1 + t.position_x as double) as global_x, cast(d.y1 + t.position_y as double) as global_y from detections d join tiles t using (slide_id, tile_idx) where d.cell_id % 97 <> 0"""


@query(_CELLS, "detections", "tiles")
def s1_cell_text(s, d):
    return _text_cells(s, d).drop("line_no")


def _text_blocks(s, d):
    b = files.by_slide(load(s, d, "blocks_raw")).withColumn("v", F.explode(F.array(F.col("l0") - 1, F.col("l0"))))
    fields = ["tile_idx % 10", "tile_idx div 10", "dx * 612", "if(dy = 0, 352, 864)", "1", "v"]
    line = F.concat_ws(" ", *(F.expr(f"cast({e} as string)") for e in fields))
    path = shared_folder(s, "blocks")
    files.write_lines(b.select("slide_id", F.when(F.col("nuc_area") % 53 == 0, F.lit("1 2 3")).otherwise(line).alias("value")), path)
    return files.read_blocks(s, path)


@query("select slide_id, cast(tile_idx % 10 as int) as ix, cast(tile_idx // 10 as int) as iy, dx, dy, round(l0, 6) as score from blocks_raw where nuc_area % 53 <> 0", "blocks_raw")
def s2_block_text(s, d):
    return _text_blocks(s, d).withColumn("score", _r("score"))


@query(f"""with c as ({_CELLS}), n as (select slide_id, ix, iy, min(abs_x) as ax, min(abs_y) as ay, count(*) as n, sum(global_x) as sx from c group by 1, 2, 3),
    b as (select slide_id, cast(tile_idx % 10 as int) as ix, cast(tile_idx // 10 as int) as iy, count(*) as nb from blocks_raw where nuc_area % 53 <> 0 group by 1, 2, 3)
    select slide_id, ix, iy, coalesce(ax, 0) as abs_x, coalesce(ay, 0) as abs_y, cast(nb as int) as blocks, cast(coalesce(n, 0) as int) as cells, coalesce(sx, 0.0::double) as sum_x from b left join n using (slide_id, ix, iy)""",
       "detections", "tiles", "blocks_raw")
def s3_tiles_from_text(s, d):
    t = files.combine(_text_blocks(s, d), files.cells_by_tile(_text_cells(s, d)))
    return t.select("slide_id", "ix", "iy", "abs_x", "abs_y", F.size("scores").alias("blocks"), F.size("global_centers").alias("cells"),
                    F.aggregate("global_centers", F.lit(0.0), lambda a, p: a + p[0]).alias("sum_x"))


def _project(s, d):
    """Project files as JSON, one record a slide, read again."""
    floats = lambda *e: F.array(*(F.expr(f"cast({x} as double)") for x in e))
    lists = lambda df, c, name: df.groupBy("slide_id", "tile_idx").agg(F.collect_list(c).alias(name))
    wbc = lists(load(s, d, "detections").where("label = 0"), floats("x1", "y1", "x2", "y2", "score"), "wbc_center_pt")
    meg = lists(load(s, d, "megs"), floats("x", "y", "w", "h", "rate"), "meg_center_pt")
    area = lists(load(s, d, "blocks_raw"), floats("dx * 612", "if(dy = 0, 88, 600)", "612", "512", "l0", "dx + dy"), "area_score_info")
    t = load(s, d, "tiles").join(area, ["slide_id", "tile_idx"]).join(wbc, ["slide_id", "tile_idx"], "left").join(meg, ["slide_id", "tile_idx"], "left")
    node = F.struct(F.col("row_index").alias("row"), F.col("col_index").alias("col"), F.struct(
        floats("position_x", "position_y").alias("position"), "area_score_info", "wbc_center_pt", "meg_center_pt").alias("data"))
    path = shared_folder(s, "project")
    t.groupBy("slide_id").agg(F.collect_list(node).alias("nodes")).select(
        "slide_id", F.struct(F.lit(8).alias("row_num"), F.lit(10).alias("col_num")).alias("task_info"), "nodes").write.json(path)
    return files.read_project(s, path, multi_line=False)


@query("""select d.slide_id, d.col_index as ix, 7 - d.row_index as iy, cast(d.x1 + t.position_x as double) as x1, cast(d.y1 + t.position_y as double) as y1, cast(d.x2 + t.position_x as double) as x2,
    cast(d.y2 + t.position_y as double) as y2, round(d.score, 6) as score from detections d join tiles t using (slide_id, tile_idx) where d.label = 0""", "detections", "tiles")
def s4_project_cells(s, d):
    return files.project_cells(_project(s, d)).withColumn("score", _r("score"))


@query("""select slide_id, t.col_index as ix, 7 - t.row_index as iy, cast(x + position_x as double) as x1, cast(y + position_y as double) as y1, cast(x + w + position_x as double) as x2, cast(y + h + position_y as double) as y2,
    round(rate, 6) as score from megs join tiles t using (slide_id, tile_idx) where exists (select 1 from blocks_raw b where b.slide_id = t.slide_id and b.tile_idx = t.tile_idx)""", "megs", "tiles", "blocks_raw")
def s4_project_megs(s, d):
    return files.project_megs(_project(s, d)).withColumn("score", _r("score"))


@query("""select slide_id, t.col_index as ix, 7 - t.row_index as iy, dx, dy, round(l0, 6) as score, dx + dy as label from blocks_raw join tiles t using (slide_id, tile_idx)""", "blocks_raw", "tiles")
def s4_project_blocks(s, d):
    return files.project_blocks(_project(s, d)).withColumn("score", _r("score"))


@query("""select slide_id, tile_idx, x1, y1, x2, y2, 0 as cell_type, round(score, 6) as confidence from detections where label = 0
    union all select slide_id, tile_idx, x, y, x + w, y + h, 1, round(rate, 6) from megs""", "detections", "megs")
def s5_cells_of_40x(s, d):
    floats = lambda *c: F.collect_list(F.array(*(F.col(x).cast("double") for x in c)))
    a = load(s, d, "detections").where("label = 0").groupBy("slide_id", "tile_idx").agg(floats("x1", "y1", "x2", "y2", "score").alias("haveCellCenterPoints"))
    b = load(s, d, "megs").groupBy("slide_id", "tile_idx").agg(floats("x", "y", "w", "h", "rate").alias("bigCellRects"))
    return models.cells_of_40x(a.join(b, ["slide_id", "tile_idx"], "full"), ["slide_id", "tile_idx"]).withColumn("confidence", _r("confidence"))


def _images100(s, d):
    e = load(s, d, "embeddings")
    logits = F.transform(F.slice("embedding", 1, 14), lambda x: x.cast("double") * 8)
    e = e.select(F.expr("vec_id div 10").alias("image_id"), F.array(*(F.expr(f"cast({x} as int)") for x in ("(vec_id * 131) % 1900", "(vec_id * 197) % 1400", "20 + vec_id % 60", "20 + (vec_id * 7) % 60"))).alias("r"),
                 F.when(F.col("vec_id") % 5 == 0, F.slice(heatmap.top_k(heatmap.softmax(logits), 5), 1, 0)).otherwise(heatmap.top_k(heatmap.softmax(logits), 5)).alias("t"))
    return e.groupBy("image_id").agg(F.collect_list(F.struct("r", "t")).alias("c")).select(
        "image_id", (F.col("image_id") * 10).cast("int").alias("offset_x"), (F.col("image_id") * 20).cast("int").alias("offset_y"), F.col("c.r").alias("cellRects"),
        F.transform("c", lambda c: c["t"]["type"]).alias("cellTypes"), F.transform("c", lambda c: c["t"]["percent"]).alias("cellRatios"))


_E14 = [f"exp(least(cast(embedding[{i + 1}] as double) * 8, 32))" for i in range(14)]
_TOP14 = f"""e as (select vec_id, {', '.join(f'{x} as e{i}' for i, x in enumerate(_E14))} from embeddings), p as (select vec_id, unnest(range(14)) as type, unnest([{', '.join(f'e{i}' for i in range(14))}])
    / ({' + '.join(f'e{i}' for i in range(14))}) as percent from e), k as (select vec_id, type, percent, row_number() over (partition by vec_id order by percent desc, type) as n from p)"""
_RECT = "(vec_id * 131) % 1900 as x, (vec_id * 197) % 1400 as y, 20 + vec_id % 60 as w, 20 + (vec_id * 7) % 60 as h, vec_id // 10 as image_id"


@query(f"""with {_TOP14}, r as (select vec_id, {_RECT} from embeddings) select image_id, cast(x + image_id * 10 as int) as x1, cast(y + image_id * 20 as int) as y1, cast(x + image_id * 10 + w as int) as x2,
    cast(y + image_id * 20 + h as int) as y2, cast(case when vec_id % 5 = 0 then -1 else type end as int) as cell_type, round(case when vec_id % 5 = 0 then 1.0::double else percent end, 6) as confidence
    from r join k using (vec_id) where n = 1""")
def s6_cells_of_100x(s, d):
    return models.cells_of_100x(_images100(s, d), ["image_id"]).withColumn("confidence", _r("confidence"))


@query(f"""with {_TOP14}, r as (select vec_id, {_RECT} from embeddings) select image_id, cast(x as int) as x, cast(y as int) as y, 'top' || n as name, cast(type as int) as type, round(percent, 6) as percent
    from r join k using (vec_id) where n <= 5 and vec_id % 5 <> 0""")
def s7_records_of_100x(s, d):
    r = models.records_of_100x(_images100(s, d), ["image_id"]).select("image_id", "cell_pos.x", "cell_pos.y", F.explode("cell_types").alias("name", "t"))
    return r.select("image_id", "x", "y", "name", F.col("t.type").alias("type"), _r("t.percent").alias("percent"))


@query("select slide_id, row_index, col_index from tiles where image_uid is null", "tiles")
def s8_without_image(s, d):
    t = load(s, d, "tiles")
    paths = t.where("image_uid is not null").select("slide_id", F.concat(F.lit("/images/Pos["), "col_index", F.lit("]["), "row_index", F.lit("].jpg")).alias("path"))
    return files.without_image(t, files.image_places(paths)).select("slide_id", "row_index", "col_index")


@query("""select slide_id, cast(view_id % 7 as int) as region, cast(row_number() over (partition by slide_id, view_id % 7 order by x, y) as int) as sort_id, x as view_pos_x, y as view_pos_y from views""", "views")
def s9_task_list(s, d):
    from tilelake.operators.cover import number_tasks

    v = number_tasks(load(s, d, "views").withColumn("region", (F.col("view_id") % 7).cast("int")), ["slide_id", "region"])
    path = shared_folder(s, "tasks")
    files.write_task_list(v.select("slide_id", "region", "sort_id", F.col("x").alias("view_pos_x"), F.col("y").alias("view_pos_y")), path)
    back = s.read.schema("slide_id long, region int, tasks array<struct<sort_id: int, view_pos_x: int, view_pos_y: int>>").json(path)
    return back.select("slide_id", "region", F.inline("tasks"))


@query("""select slide_id, tile_idx, cell_id, x1 + case when slide_id % 2 = 0 then 1000 else 0 end as x1, y1 from detections where slide_id % 2 = 1 or label = 0""", "detections")
def s10_saved_project(s, d):
    """A project saved, half of its slides changed and saved again, and read."""
    path, cells = shared_folder(s, "saved"), load(s, d, "detections")
    saved.save_project(cells, path)
    saved.save_project(cells.where("slide_id % 2 = 0 and label = 0").withColumn("x1", F.col("x1") + 1000), path)
    return saved.load_project(s, path).select("slide_id", "tile_idx", "cell_id", "x1", "y1")


@query("select slide_id, tile_idx, cell_id, x1, y1 from detections where slide_id = 0", "detections")
def s10_one_slide(s, d):
    path = shared_folder(s, "saved")
    saved.save_project(load(s, d, "detections"), path)
    return saved.load_project(s, path, 0).select("slide_id", "tile_idx", "cell_id", "x1", "y1")


@query("""select p_partkey, case when p_partkey % 7 = 0 then null else center end as center, case when p_partkey % 5 = 0 then null else white end as second, case when p_partkey % 3 = 0 then null else white end as deep,
    case when p_partkey % 4 = 0 then null else center end as held from peaks""", "peaks")
def s12_json_safe(s, d):
    """Numbers that are none, by themselves and inside arrays, structs and maps."""
    bad = lambda k, c: F.when(F.col("p_partkey") % k == 0, float("nan")).otherwise(F.col(c))
    p = load(s, d, "peaks").select("p_partkey", bad(7, "center").alias("center"), F.array(F.col("white"), bad(5, "white")).alias("list"),
                                   F.struct(F.lit(1).alias("n"), F.array(F.struct(bad(3, "white").alias("x"))).alias("parts")).alias("tree"), F.create_map(F.lit("k"), bad(4, "center")).alias("map"))
    return documents.json_safe(p).select("p_partkey", "center", F.get("list", F.lit(1)).alias("second"), F.get("tree.parts", F.lit(0))["x"].alias("deep"), F.col("map")["k"].alias("held"))


@query("""with u as (select doc_id, path, seq, lag(seq) over (partition by doc_id order by seq) as before from doc_updates), l as (select *, max(case when seq % 5 = 0 then seq end) over (partition by doc_id) as flat, max(seq) over (partition by doc_id) as top from u),
    leaf as (select doc_id, string_agg('"' || path || '":' || v, ',' order by path) as t from (select doc_id, path, max(seq) as v from u group by 1, 2) group by 1),
    k as (select doc_id, string_agg('"x' || i || '":' || v, ',' order by i) as t from (select doc_id, seq % 3 as i, max(seq) as v from l where flat is null or seq > flat group by 1, 2) group by 1),
    n as (select doc_id, string_agg(seq || ',{"s":' || seq || '}', ',' order by seq) as t, any_value(flat) as flat, any_value(top) as top from l group by 1)
    select doc_id, '{"a":{"b":{"c":{' || leaf.t || '}},"list":[' || n.t || ']},"k":' || case when flat = top then flat::varchar else '{' || k.t || '}' end || '}' as json from n join leaf using (doc_id) left join k using (doc_id)""", "doc_updates")
def s11_deep_merge(s, d):
    """Updates four levels deep, with lists that grow and a key that is now a number and now an object."""
    u = load(s, d, "doc_updates")
    key = F.when(F.col("seq") % 5 == 0, F.col("seq").cast("string")).otherwise(F.concat(F.lit('{"x'), F.col("seq") % 3, F.lit('":'), "seq", F.lit("}")))
    text = F.concat(F.lit('{"a":{"b":{"c":{"'), "path", F.lit('":'), "seq", F.lit('}},"list":['), "seq", F.lit(',{"s":'), "seq", F.lit('}]},"k":'), key, F.lit("}"))
    return documents.merge_documents(u.select("doc_id", "seq", text.alias("json")), ["doc_id"])


@query("select slide_id, tile_idx, cell_id, round((x2 - x1) * (y2 - y1) * score, 6) as ink from detections", "detections")
def s13_user_model(s, d):
    def ink(frames):  # sent by value, so executors need not have this package
        for f in frames:
            yield f.assign(ink=(f.x2 - f.x1) * (f.y2 - f.y1) * f.score)[["slide_id", "tile_idx", "cell_id", "ink"]]

    models.register_adapter(40, ink, "slide_id long, tile_idx int, cell_id long, ink double")
    return models.score_tiles(load(s, d, "detections").select("slide_id", "tile_idx", "cell_id", "x1", "y1", "x2", "y2", "score"), 40).withColumn("ink", _r("ink"))
