"""Every registered query of the slide tables against DuckDB, and properties of suppression and cover."""

import duckdb
import pytest

from tilelake.registered import ORACLE_SQL, QUERIES
from tilelake.operators import spatial, suppress

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("orders", "lineitem", "events", "part", "embeddings"):
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def _rows(rows):
    return sorted(repr(tuple(round(v, 5) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    want = duck.execute(ORACLE_SQL[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(df.columns)
    assert _rows(df.select(cols).collect()) == _rows(want.fetchall())


def test_nms_equals_sequential(spark):
    import random

    rng = random.Random(3)
    rows = [(0, i, rng.random(), x, y, x + 30, y + 30) for i in range(150) for x, y in [(rng.randrange(200), rng.randrange(200))]]
    df = spark.createDataFrame(rows, "k int, id long, score double, x1 int, y1 int, x2 int, y2 int")
    got = {r["id"] for r in suppress.nms(df, ["k"], 0.2, 64).collect()}
    kept = []
    for r in sorted(rows, key=lambda r: (-r[2], r[1])):
        def iou(a, b):
            i = max(0, min(a[5], b[5]) - max(a[3], b[3])) * max(0, min(a[6], b[6]) - max(a[4], b[4]))
            return i / (1800 - i)
        if all(iou(r, k) <= 0.2 for k in kept):
            kept.append(r)
    assert got == {r[1] for r in kept}


def test_pairwise_iou_compares_all_views(spark):
    d = "/root/testdata/sf0.01"
    keys = [r[0] for r in spark.read.parquet(f"{d}/part.parquet").select("p_partkey").collect()]
    views = [(k, k * 7919 % 21900, k * 104729 % 14600) for k in sorted(keys)]
    want = {}
    for i, (a, ax, ay) in enumerate(views):
        for b, bx, by in views[i + 1:]:
            part = max(0, 384 - abs(ax - bx)) * max(0, 283 - abs(ay - by))
            if part / (2 * 384 * 283 - part) > 0.01:
                want[0, a, b] = round(part / (2 * 384 * 283 - part), 5)
    got = {(r["slide_id"], r["a"], r["b"]): round(r["iou"], 5) for r in QUERIES["j13_pairwise_iou"](spark, d).collect()}
    assert len({(a % 4, b % 4) for _, a, b in want}) > 4  # views whose keys differ modulo 4 are compared too
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 2e-5 for k in want)


def test_overlapping_pairs_keep_slides_apart(spark):
    boxes = spark.createDataFrame([(g, 10 * g + i, 300 * i, 0, 300 * i + 384, 283) for g in (0, 1) for i in range(3)],
                                  "slide_id long, view_id long, x1 int, y1 int, x2 int, y2 int")
    got = {(r["slide_id"], r["a"], r["b"]) for r in spatial.overlapping_pairs(boxes, ["slide_id"], "view_id", 512, 0.01).collect()}
    assert got == {(0, 0, 1), (0, 1, 2), (1, 10, 11), (1, 11, 12)}


def test_views_at_one_place_are_numbered_by_id(spark, duck, tmp_path):
    keys = [k * 43800 for k in range(40, -1, -1)] + [4, 8]  # all but two at (0, 0) of slide 0
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    got = {r["view_id"]: r["sort_id"] for r in QUERIES["w4_sort_id"](spark, str(tmp_path)).collect()}
    assert [v for v, _ in sorted(got.items(), key=lambda r: r[1])] == sorted(keys, key=lambda k: (k * 7919 % 21900, k * 104729 % 14600, k))
