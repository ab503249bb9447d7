"""Tables of slides, derived from the driver tables by integer formulas.

Each formula is SQL that Spark and DuckDB both read; `div` is Spark's integer division (DuckDB: //).
"""

from pyspark.sql import DataFrame, SparkSession

_K = "(o_orderkey % 3750)"
FORMULAS = {
    "tiles": f"""select cast(o_orderkey div 3750 as bigint) as slide_id, cast({_K} div 10 as int) as row_index, cast({_K} % 10 as int) as col_index,
        cast({_K} as int) as tile_idx, cast(({_K} % 10) * 2204 + o_custkey % 9 - 4 as int) as position_x,
        cast(({_K} div 10) * 1844 + (o_custkey div 9) % 9 - 4 as int) as position_y,
        case when {_K} % 41 = 7 then null else concat('img-', cast(o_orderkey as varchar(20))) end as image_uid
        from orders where {_K} < 80 and {_K} % 37 <> 5""",
    "blocks_raw": f"""select cast(o_orderkey div 3750 as bigint) as slide_id, cast(({_K} - 80) div 4 as int) as tile_idx, cast(({_K} - 80) % 2 as int) as dx,
        cast((({_K} - 80) % 4) div 2 as int) as dy, """ + ", ".join(
        f"cast((o_custkey * {i + 3} * 131 + {_K} * 17) % 700 as double) / 100.0 as l{i}" for i in range(7)) + f""",
        cast(78 + (o_custkey * 53 + {_K} * 29) % 5527 as int) as nuc_area, cast(3076 + (o_custkey * 71 + {_K} * 13) % 14711 as int) as red_area
        from orders where {_K} >= 80 and {_K} < 400""",
    "cells_true": """select distinct cast(l_orderkey div 3750 as bigint) as slide_id,
        cast(((cast(l_orderkey as bigint) * 8 + l_linenumber) * 20000 + l_partkey) * 1000 + l_suppkey as bigint) as cell_id,
        cast((cast(l_partkey as bigint) * 7919 + cast(l_orderkey as bigint) * 104729 + cast(l_linenumber as bigint) * 1299709 + cast(l_suppkey as bigint) * 15485863) % 22200 as int) as gx,
        cast((cast(l_partkey as bigint) * 32452843 + cast(l_orderkey as bigint) * 49979687 + cast(l_linenumber as bigint) * 67867967 + cast(l_suppkey as bigint) * 86028121) % 14880 as int) as gy,
        cast(24 + (l_orderkey + l_partkey) % 24 as int) as w, cast(24 + (l_orderkey + l_suppkey) % 24 as int) as h,
        case when l_returnflag = 'R' then 1 else 0 end as label from lineitem""",
    "detections": """select c.slide_id, t.row_index, t.col_index, t.tile_idx, c.cell_id, c.label,
        cast(c.gx - t.position_x + (c.cell_id + t.tile_idx * 3) % 3 - 1 as int) as x1, cast(c.gy - t.position_y + (c.cell_id + t.tile_idx * 5) % 3 - 1 as int) as y1,
        cast(c.gx - t.position_x + (c.cell_id + t.tile_idx * 3) % 3 - 1 + c.w as int) as x2, cast(c.gy - t.position_y + (c.cell_id + t.tile_idx * 5) % 3 - 1 + c.h as int) as y2,
        cast(0.4 as double) + cast((c.cell_id * 31 + t.tile_idx * 17) % 6000 as double) / 10000.0 as score
        from cells_true c join tiles t on c.slide_id = t.slide_id and t.row_index between c.gy div 1844 - 1 and c.gy div 1844 + 1
            and t.col_index between c.gx div 2204 - 1 and c.gx div 2204 + 1
        where c.gx >= t.position_x and c.gy >= t.position_y and c.gx + c.w <= t.position_x + 2448 and c.gy + c.h <= t.position_y + 2048""",
    "megs": f"""select cast(o_orderkey div 3750 as bigint) as slide_id, cast({_K} % 80 as int) as tile_idx, cast(o_orderkey as bigint) as meg_id,
        cast((({_K} % 80) * 997) % 2000 + case when {_K} >= 480 then 3 else 0 end as int) as x, cast((({_K} % 80) * 613) % 1600 + case when {_K} >= 480 then 3 else 0 end as int) as y,
        cast(100 + (({_K} % 80) * 37) % 300 as int) as w, cast(100 + (({_K} % 80) * 53) % 300 as int) as h, cast(0.45 as double) + cast(o_custkey % 55 as double) / 100.0 as rate
        from orders where {_K} >= 400 and {_K} < 560""",
    "uploads": """select event_id, ts, cast(user_id as bigint) as task_id, cast(event_id % 2 as int) as row_index, cast((event_id div 2) % 2 as int) as col_index,
        case when event_type = 'error' then cast(0 as bigint) else cast(floor(value * 100) as bigint) end as n_bytes from events""",
    "peaks": """select cast(p_partkey % 4 as bigint) as slide_id, cast(p_partkey div 25 as int) as tile_idx, cast((p_partkey * 37) % 640 as int) as px, cast((p_partkey * 59) % 512 as int) as py,
        cast((p_partkey * 7) % 100 as double) / 100.0 as center, cast((p_partkey * 7) % 100 as double) / 100.0 + case when p_partkey % 3 = 0 then cast(0 as double) else cast(0.1 as double) end as center_pool,
        cast(p_size * 2 as double) / 100.0 as white, p_partkey from part""",
    "views": """select cast(p_partkey % 4 as bigint) as slide_id, cast(p_partkey as bigint) as view_id, cast((cast(p_partkey as bigint) * 7919) % 21900 as int) as x,
        cast((cast(p_partkey as bigint) * 104729) % 14600 as int) as y, 384 as w, 283 as h from part""",
    "mask_pixels": """select slide_id, tile_idx, cast(floor((x1 + x2) / cast(8 as double)) as int) as px, cast(floor((y1 + y2) / cast(8 as double)) as int) as py,
        cast(max((cell_id * 13) % 256) as int) as white, cast(max((cell_id * 29) % 256) as int) as red from detections group by 1, 2, 3, 4""",
    "doc_updates": "select cast(user_id as bigint) as doc_id, event_type as path, event_id as seq, value as scalar_value from events",
}
NEEDS = {"tiles": ["orders"], "blocks_raw": ["orders"], "cells_true": ["lineitem"], "detections": ["cells_true", "tiles"], "megs": ["orders"],
         "uploads": ["events"], "peaks": ["part"], "views": ["part"], "mask_pixels": ["detections"], "doc_updates": ["events"]}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in FORMULAS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = FORMULAS[name]
    inputs = {}
    for need in NEEDS[name]:
        for word in ("from", "join"):
            sql = sql.replace(f"{word} {need}", f"{word} {{{need}}}")
        inputs[need] = load(spark, sf_dir, need)
    return spark.sql(sql, **inputs)


def oracle(body: str, *names: str) -> str:
    """DuckDB SQL: the formulas of names (and what they need) as common table expressions before body."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in FORMULAS and name not in order:
            for need in NEEDS[name]:
                add(need)
            order.append(name)

    for n in names:
        add(n)
    ctes = [f"{n} as ({FORMULAS[n].replace(' div ', ' // ').replace('varchar(20)', 'varchar')})" for n in order]
    if not ctes:
        return body
    for start in ("with recursive ", "with "):
        if body.lstrip().startswith(start):
            return f"{start}{', '.join(ctes)}, {body.lstrip()[len(start):]}"
    return f"with {', '.join(ctes)} {body}"
