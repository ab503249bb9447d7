"""Saved projects, kept results, merged documents and JSON-safe columns, against plain Python."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tilelake.operators import tasks as K, views
from tilelake.sources import documents, saved


def files_of(path):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(path) for n in names}


def test_one_slide_is_replaced_and_the_others_files_stay(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.createDataFrame([(s, i, s * 10 + i) for s in range(3) for i in range(4)], "slide_id long, n int, v int")
    saved.save_project(df, path)
    before = files_of(f"{path}/data")
    saved.save_project(spark.createDataFrame([(1, 7, 99)], "slide_id long, n int, v int"), path)
    assert before.items() <= files_of(f"{path}/data").items()
    rows = lambda **k: sorted(tuple(r) for r in saved.load_project(spark, path, **k).select("slide_id", "n", "v").collect())
    assert rows() == sorted([(s, i, s * 10 + i) for s in (0, 2) for i in range(4)] + [(1, 7, 99)])
    assert rows(slide_id=1) == [(1, 7, 99)] and rows(slide_id=5) == [] and len(rows(number=0)) == 12
    # a save that broke off leaves data and an unfinished manifest, which no reader sees
    df.withColumn("v", F.lit(-1)).write.partitionBy("slide_id").parquet(f"{path}/data/version=broken")
    os.makedirs(f"{path}/manifest/2")
    assert (1, 7, 99) in rows() and all(v >= 0 for _, _, v in rows())


def test_no_project(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        saved.load_project(spark, str(tmp_path / "none"))


def test_results_are_kept_by_slide_area_and_rows(spark, tmp_path):
    path, asked = str(tmp_path / "store"), []
    rows = [(s, i) for s in range(3) for i in range(5)]
    table = lambda rows: spark.createDataFrame(rows, "slide_id long, n int")

    def compute(t, area):
        asked.append(sorted(r[0] for r in t["cells"].select("slide_id").distinct().collect()))
        return t["cells"].groupBy("slide_id").agg(F.sum("n").alias("total"))

    def ask(rows, area, **settings):
        return {r["slide_id"]: r["total"] for r in saved.kept_results(path, {"cells": table(rows)}, compute, area, **settings).collect()}

    area = {"min_row": 0}
    assert ask(rows, area) == {0: 10, 1: 10, 2: 10} and asked == [[0, 1, 2]]
    assert ask(rows[::-1], area) == {0: 10, 1: 10, 2: 10} and len(asked) == 1  # read, not computed
    changed = [r for r in rows if r != (1, 4)] + [(1, 40)]
    assert ask(changed, area) == {0: 10, 1: 46, 2: 10} and asked[1:] == [[1]]
    assert ask(rows, area) == {0: 10, 1: 10, 2: 10} and len(asked) == 2
    assert ask(rows, area, target=5)[0] == 10 and asked[2:] == [[0, 1, 2]]
    by_slide = spark.createDataFrame([(s, 0) for s in range(3)], "slide_id long, min_row int")
    ask(rows, by_slide)
    ask(rows, by_slide.withColumn("min_row", F.when(F.col("slide_id") == 2, 1).otherwise(0)))
    assert asked[3:] == [[0, 1, 2], [2]]


def test_kept_task_lists_search_once(spark, tmp_path, monkeypatch):
    seen = []
    t = spark.createDataFrame([(0, 1), (1, 2)], "slide_id long, n int")
    monkeypatch.setattr(views, "task_list", lambda d, *rest: (seen.append(d.count()), d.select("slide_id", F.col("n").alias("group")))[1])
    for _ in range(2):
        got = views.kept_task_lists(str(tmp_path / "s"), t, t, t, t, {"min_row": 0}, 500)
        assert sorted(tuple(r) for r in got.collect()) == [(0, 1), (1, 2)]
    assert seen == [2]


def merged(a, b):
    """Recursive merge: objects by key, lists appended, anything else replaced."""
    for k, v in b.items():
        if isinstance(v, dict) and isinstance(a.get(k), dict):
            merged(a[k], v)
        elif isinstance(v, list) and isinstance(a.get(k), list):
            a[k] = a[k] + v
        else:
            a[k] = json.loads(json.dumps(v))
    return a


def some_json(rng, depth):
    kind = rng.random()
    if depth and kind < 0.55:
        return {rng.choice("abcd"): some_json(rng, depth - 1) for _ in range(rng.randrange(0, 4))}
    if kind < 0.75:
        return [some_json(rng, max(0, depth - 1)) for _ in range(rng.randrange(0, 3))]
    return rng.choice([1, -7, 2.5, True, None, "x", 'q"\\', "", "null", "é\n"])


def test_deep_merge_equals_a_recursive_one(spark):
    rng = random.Random(12)
    rows, want = [], {}
    for doc in range(40):
        want[doc] = {}
        for seq in range(rng.randrange(1, 9)):
            u = {k: some_json(rng, 4) for k in rng.sample(["a", "b", 'c"."', "d"], rng.randrange(0, 4))}
            rows.append((doc, seq, json.dumps(u)))
            merged(want[doc], u)
    rows += [(0, 100, "not json"), (0, 101, None), (0, 102, "[1]"), (99, 0, "7")]
    got = {r["doc"]: json.loads(r["json"]) for r in documents.merge_documents(spark.createDataFrame(rows, "doc long, seq long, json string").repartition(4), ["doc"]).collect()}
    assert got == want
    assert documents.merge_documents(spark.createDataFrame([], "doc long, seq long, json string"), ["doc"]).count() == 0


def test_merging_documents_sends_no_table_through_the_driver(spark, monkeypatch, capsys):
    cut = documents.cut
    monkeypatch.setattr(documents, "cut", lambda df: (df.explain(), cut(df))[1])
    u = spark.range(60).selectExpr("id % 7 as doc", "id as seq", """concat('{"a":{"b":', id, '},"k":', if(id % 5 = 0, '1', '{"x":2}'), '}') as json""")
    got = documents.merge_documents(u, ["doc"])
    got.explain()
    assert got.count() == 7 and got.where("doc = 0").collect()[0]["json"] == '{"a":{"b":56},"k":{"x":2}}'
    plans = capsys.readouterr().out
    assert "SortMergeJoin" in plans and "Broadcast" not in plans


def test_json_safe_goes_into_every_type(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.sql("""select double('nan') as a, struct(double('nan') as a, array(map('k', double('-infinity'), 'l', 1.5D)) as b, date'2024-01-02' as c) as s, map('x', struct(float('nan') as f, 2 as g)) as m,
        array(array(double('nan'), 2D)) as l, cast(null as struct<a: double>) as n, binary('ab') as bin, interval 3 days as i, 'NaN' as t, map(1.5D, 1) as keyed""")
    r = documents.json_safe(df).collect()[0].asDict(recursive=True)
    assert r["a"] is None and r["s"] == {"a": None, "b": [{"k": None, "l": 1.5}], "c": "2024-01-02"} and r["m"] == {"x": {"f": None, "g": 2}} and r["l"] == [[None, 2.0]]
    assert r["n"] is None and r["bin"] == "YWI=" and isinstance(r["i"], str) and r["t"] == "NaN" and r["keyed"] == {"1.5": 1}
    assert json.loads(json.dumps(r, allow_nan=False)) and nan != nan and inf > 0


def test_roi_tasks_page_their_cells(spark):
    cells = spark.createDataFrame([(0, i, 0, 0, 0.5, i * 10, 0, i * 10 + 5, 5) for i in range(25)] + [(1, 1, 0, 0, 0.5, 900, 0, 905, 5)],
                                  "slide_id long, cell_id long, tile_idx int, label int, score double, x1 int, y1 int, x2 int, y2 int")
    got = K.roi_tasks(cells, (45, 0, 200, 10), page=7).orderBy("slide_id", "page").collect()
    assert [(r["slide_id"], r["page"], [c["cell_id"] for c in r["cell_list"]]) for r in got] == [(0, 0, [*range(4, 11)]), (0, 1, [*range(11, 18)]), (0, 2, [18, 19, 20]), (1, 0, [])]
    assert K.roi_tasks(cells, (45, 0, 200, 10), offset=1).count() == 0


def test_text_of_slides_is_few_files(spark, tmp_path, monkeypatch):
    from tilelake import catalog_sources

    monkeypatch.setattr(catalog_sources, "shared_folder", lambda s, n: str(tmp_path / n))
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "12"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        catalog_sources._text_cells(spark, "/root/testdata/sf0.01")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [len(list(p.glob("part-*"))) for p in sorted((tmp_path / "cells").glob("slide_id=*"))] == [1] * 4
