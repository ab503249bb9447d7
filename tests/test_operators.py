"""Slide operators on small tables made for the case, against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilelake.operators import capture, cover, heatmap, regions, search, suppress, tiles as T, views
from tilelake.sources import files


def test_cells_of_many_tiles_are_told_apart(spark):
    """Cell 10 of tile 81 and cell 11 of tile 1 once shared a key."""
    tiles = spark.createDataFrame([(0, 0, 0, 0, 0, 0), (0, 1, 0, 1, 400, 0), (0, 81, 9, 0, 0, 9000)], "slide_id long, tile_idx int, row_index int, col_index int, position_x int, position_y int")
    rows = [(0, 0, 1, 0.9, 500, 10, 540, 50, 0), (0, 1, 11, 0.5, 101, 11, 141, 51, 0), (0, 81, 10, 0.7, 5, 5, 45, 45, 0)]
    det = spark.createDataFrame(rows, "slide_id long, tile_idx int, cell_id long, score double, x1 int, y1 int, x2 int, y2 int, label int")
    assert {(r["tile_idx"], r["cell_id"]) for r in suppress.cross_tile_dedup(det, tiles).collect()} == {(0, 1), (81, 10)}


def test_long_chains_settle(spark):
    """A chain of 130 boxes, each suppressed or freed by the one before, takes as many rounds."""
    n = 130
    edges = spark.createDataFrame([(0, i, i + 1) for i in range(n)], "k int, u long, v long")
    assert {r["v"] for r in suppress.suppressed(edges, ["k"]).collect()} == set(range(1, n + 1, 2))


@pytest.mark.parametrize("step", [500, 2204, 30_000])
def test_nearest_tile_on_any_grid(spark, step):
    rng = np.random.default_rng(step)
    place = [(0, i, int(i % 8 * step + rng.integers(-9, 9)), int(i // 8 * step + rng.integers(-9, 9))) for i in range(64) if i % 5] + [(1, 3, -50_000, 70_000)]
    tiles = spark.createDataFrame(place, "slide_id long, tile_idx int, position_x int, position_y int")
    pts = [(s, i, int(x), int(y)) for s in (0, 1) for i, (x, y) in enumerate(rng.integers(-2 * step, 9 * step, (40, 2)))] + [(2, 0, 5, 5)]
    got = {(r["slide_id"], r["view_id"]): (r["tile_idx"], r["dist2"]) for r in T.nearest_tile(spark.createDataFrame(pts, "slide_id long, view_id long, x int, y int"), tiles, ["view_id"]).collect()}
    want = {}
    for s, i, x, y in pts:
        near = [((x - px - 1224) ** 2 + (y - py - 1024) ** 2, t) for k, t, px, py in place if k == s]
        if near:
            want[s, i] = (min(near)[1], min(near)[0])
    assert got == want


def test_cover_equals_sequential_greedy(spark):
    rng = np.random.default_rng(2)
    pts = [(k, i, int(x), int(y)) for k in (0, 1) for i, (x, y) in enumerate(rng.integers(-50, 400, (60, 2)))]
    df = spark.createDataFrame(pts, "k int, id long, x int, y int")
    got = {(r["k"], r["wx"], r["wy"]): r["gain"] for r in cover.greedy_cover(cover.windows_of(df, ["k"], "id", 100, 80, 0.5), ["k"], "id").collect()}
    want = {}
    for k in (0, 1):
        left = {(x, y, i) for kk, i, x, y in pts if kk == k}
        grid = [(a, b) for a in range(-200, 450, 50) for b in range(-200, 450, 40)]
        while left:
            hit = {w: {p for p in left if w[0] <= p[0] <= w[0] + 100 and w[1] <= p[1] <= w[1] + 80} for w in grid}
            best = min(grid, key=lambda w: (-len(hit[w]), w))
            want[k, *best] = len(hit[best])
            left -= hit[best]
    assert got == want


def test_views_hold_their_points(spark):
    rng = np.random.default_rng(4)
    pts = [(0, i, float(x) / 2, float(y) / 2) for i, (x, y) in enumerate(rng.integers(-300, 3000, (80, 2)))]
    v, owner = views.views_over(spark.createDataFrame(pts, "slide_id long, id long, x double, y double"), ["slide_id"], "id")
    box = {r["view_id"]: (r["x"], r["y"]) for r in v.collect()}
    own = {r["id"]: r["view_id"] for r in owner.collect()}
    assert set(own) == {p[1] for p in pts}
    for _, i, x, y in pts:
        a, b = box[own[i]]
        assert a <= x < a + views.VIEW_W and b <= y < b + views.VIEW_H


def test_rotated_windows_against_every_place(spark):
    rng = np.random.default_rng(6)
    grid = {(x, y): float(rng.normal()) for x in range(14) for y in range(12) if rng.random() < 0.9}
    df = spark.createDataFrame([(0, x, y, s) for (x, y), s in grid.items()], "slide_id long, gx int, gy int, score double")
    got = {(r["w"], r["h"], r["angle"]): (r["cx"], r["cy"], round(r["area_score"], 6)) for r in search.rotated_windows(df, [(3, 5), (5, 1), (99, 3)], {"min_row": 0, "max_row": 5, "min_col": 0, "max_col": 6}).collect()}
    assert len(got) == 6
    for (w, h, angle), (cx, cy, mean) in got.items():
        c, s = np.cos(np.radians(angle)), np.sin(np.radians(angle))
        cells = [(a, b) for a in range(-6, 7) for b in range(-6, 7) if abs(a * c + b * s) <= w / 2 and abs(b * c - a * s) <= h / 2]
        value = {(x, y): sum(grid.get((x + a, y + b), -1000.0) for a, b in cells) / (w * h) for x in range(-3, 17) for y in range(-3, 15)}
        assert abs(value[cx, cy] - mean) < 1e-5 and value[cx, cy] >= max(value.values()) - 1e-9


def by_flooding(on):
    """Bounds of the largest of the 8-connected parts of on, the one that begins first in order of rows on ties."""
    left, best = {(int(y), int(x)) for y, x in zip(*np.nonzero(on))}, None
    for start in sorted(left):
        if start in left:
            part, todo = set(), [start]
            left.discard(start)
            while todo:
                y, x = todo.pop()
                part.add((y, x))
                for q in [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                    if q in left:
                        left.discard(q)
                        todo.append(q)
            if best is None or len(part) > len(best):
                best = part
    ys, xs = zip(*best)
    return min(xs), min(ys), max(xs), max(ys)


def test_capture_chooses_the_part_of_every_threshold_tried():
    """Every score is tried as a threshold, its largest part found by flooding, its cells counted one by one; strips are grown cell by cell."""
    rng = np.random.default_rng(11)
    held_first = 0
    for trial in range(60):
        h, w = 2 * int(rng.integers(1, 5)), 2 * int(rng.integers(1, 6))
        score = np.round(rng.normal(-4, 2, (h, w)), 1)
        inside, label = rng.random((h, w)) < 0.8, rng.integers(0, 7, (h, w))
        usable = inside & (label != 5)
        tile = np.add.outer(np.arange(h) // 2 * (w // 2), np.arange(w) // 2)
        cells = rng.integers(0, 30, h * w // 4)
        area_score, target = float(rng.normal(-3, 1)), int(rng.integers(5, 200))
        found = []
        for v in sorted({min(float(s), 0.0) for s in score[inside] if s > area_score - 7}, reverse=True):
            box = x1, y1, x2, y2 = by_flooding(inside & (np.minimum(score, 0.0) >= v))
            seen = {int(tile[y, x]) for y in range(y1, y2 + 1) for x in range(x1, x2 + 1) if usable[y, x]}
            found.append((v, box, int(sum(cells[t] for t in seen))))
        near = [f for f in found if target * 0.7 <= f[2] <= target * 1.3]
        over = [f for f in found if f[2] >= target]
        want = min(near, key=lambda f: (abs(f[2] - target), -f[0])) if near else over[0] if over else found[-1] if found else None
        got = capture.first_part(score, inside, usable, tile, cells, area_score, target, 0.3)
        assert got == (want and (want[0], want[1]))
        held_first += bool(near)
        if want is None or not usable.any():
            continue
        marked = {(x, y) for y, x in zip(*np.nonzero(inside & (np.minimum(score, 0.0) >= want[0])))}
        left = {(x, y) for y, x in zip(*np.nonzero(usable))}
        x1, y1, x2, y2 = want[1]
        left -= {(x, y) for x in range(x1, x2 + 1) for y in range(y1, y2 + 1)}
        strips = [want[1]]
        while left:
            sides = [(x1, y1 - 1, x2, y1 - 1), (x1, y2 + 1, x2, y2 + 1), (x1 - 1, y1, x1 - 1, y2), (x2 + 1, y1, x2 + 1, y2)]
            whole = [(a, b, c, e) if a >= 0 and b >= 0 and c < w and e < h else None for a, b, c, e in sides]
            count = lambda s, cells: sum(s[0] <= x <= s[2] and s[1] <= y <= s[3] for x, y in cells) if s else 0
            for cells_of in (marked, left):
                n = [count(s, cells_of) for s in whole]
                if max(n):
                    break
            else:
                break
            s = whole[n.index(max(n))]
            if count(s, left):
                strips.append(s)
            left -= {(x, y) for x in range(s[0], s[2] + 1) for y in range(s[1], s[3] + 1)}
            x1, y1, x2, y2 = min(x1, s[0]), min(y1, s[1]), max(x2, s[2]), max(y2, s[3])
        assert capture.rectangles(score, inside, usable, tile, cells, area_score, target, 0.3) == strips
    assert held_first > 10


def test_runs_are_the_cells_of_the_window():
    for w, h in search.all_sizes()[::9]:
        for angle in search.ANGLES:
            c, s = np.cos(np.radians(angle)), np.sin(np.radians(angle))
            r = int(np.hypot(w, h) / 2) + 2
            want = {(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1) if abs(a * c + b * s) <= w / 2 and abs(b * c - a * s) <= h / 2}
            assert {(x, y) for y, lo, hi in search.runs(w, h, angle) for x in range(lo, hi + 1)} == want


def test_windows_of_slides_of_different_grids(spark):
    """One call over two slides of different grids gives what a call for each gives."""
    rng = np.random.default_rng(8)
    rows = [(s, x, y, float(rng.normal())) for s, w, h in ((0, 12, 10), (1, 18, 14)) for x in range(w) for y in range(h)]
    grid = spark.createDataFrame(rows, "slide_id long, gx int, gy int, score double")
    areas = [{"min_row": 0, "max_row": 4, "min_col": 2, "max_col": 7}, {"min_row": 1, "max_row": 7, "min_col": 0, "max_col": 8}]
    table = spark.createDataFrame([(s, *a.values()) for s, a in enumerate(areas)], "slide_id long, min_row int, max_row int, min_col int, max_col int")
    sizes = [(3, 3), (5, 3), (7, 9), (5, 11)]
    got = {tuple(r) for r in search.rotated_windows(grid, sizes, table).collect()}
    want = {tuple(r) for s, a in enumerate(areas) for r in search.rotated_windows(grid.where(f"slide_id = {s}"), sizes, a).collect()}
    assert got == want and {r[0] for r in got} == {0, 1}
    pts = grid.select("slide_id", "gx", "gy")
    assert {tuple(r) for r in regions.tile_of_grid(pts, table).collect()} == {tuple(r) for s, a in enumerate(areas) for r in regions.tile_of_grid(pts.where(f"slide_id = {s}"), a).collect()}


@pytest.mark.parametrize("at_once", [4000, 25])
def test_cover_is_whole_and_no_larger_than_greedy(spark, at_once):
    rng = np.random.default_rng(3)
    pts = [(k, i, float(x), float(y)) for k in (0, 1) for i, (x, y) in enumerate(rng.integers(-300, 2500 if k else 900, (160, 2)))] + [(0, 900, 5.0, 5.0), (0, 901, 5.0, 5.0)]
    df = spark.createDataFrame(pts, "k int, id long, x double, y double")
    got = [tuple(r)[:3] for r in cover.cover(df, ["k"], "id", 200, 150, 0.5, at_once=at_once).collect()]
    assert len(got) == len(set(got))
    hold = {v: {i for k, i, x, y in pts if k == v[0] and v[1] <= x <= v[1] + 200 and v[2] <= y <= v[2] + 150} for v in got}
    for k in (0, 1):
        held = [i for v, own in hold.items() if v[0] == k for i in own]
        assert set(held) == {p[1] for p in pts if p[0] == k}
        assert all(any(held.count(i) == 1 for i in own) for v, own in hold.items() if v[0] == k)  # none to spare
    greedy = cover.greedy_cover(cover.windows_of(df, ["k"], "id", 200, 150, 0.5), ["k"], "id").count()
    assert len(got) <= greedy if at_once == 4000 else len(got) <= 1.2 * greedy


def test_parts_of_bins():
    rng = np.random.default_rng(4)
    bins = np.unique(rng.integers(0, 14, (70, 2)), axis=0)
    n = rng.integers(1, 9, len(bins))
    component, part = cover.divide(bins[:, 0], bins[:, 1], n, 3, 2, 20)
    for a in range(len(bins)):
        for b in range(len(bins)):
            if np.abs(bins[a] - bins[b]).max() <= 1:
                assert component[a] == component[b]
    for p in set(part):
        own = part == p
        assert len(set(component[own])) == 1 and (n[own].sum() <= 20 or own.sum() == 1)


def in_turn(views, points, w, h):
    """Owners of points by one loop over all overlapping pairs in their order."""
    hold = {v: {i for i, (x, y) in points.items() if a <= x < a + w and b <= y < b + h} for v, (a, b) in views.items()}
    span = lambda own: max(max(points[i][c] for i in own) - min(points[i][c] for i in own) for c in (0, 1)) if own else 0
    pairs = []
    for a in views:
        for b in views:
            i = max(0, w - abs(views[a][0] - views[b][0])) * max(0, h - abs(views[a][1] - views[b][1]))
            if a < b and i / (2 * w * h - i) > 0.01:
                pairs.append((cover._turn(a, b), a, b))
    for _, a, b in sorted(pairs):
        both = hold[a] & hold[b]
        if both:
            more = [span(hold[v]) - span(hold[v] - both) for v in (a, b)]
            hold[b if more[1] > more[0] else a] -= both
    return {(v, i) for v, own in hold.items() for i in own}


@pytest.mark.parametrize("at_once", [20_000, 40])
def test_shared_points_go_to_the_view_that_grows_less(spark, at_once):
    rng = np.random.default_rng(7)
    views = {i + 1: (int(x), int(y)) for i, (x, y) in enumerate(rng.integers(0, 700, (40, 2)))}
    points = {i: (float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 800, (150, 2)))}
    v = spark.createDataFrame([(0, i, x, y) for i, (x, y) in views.items()], "k int, view_id long, x int, y int")
    p = spark.createDataFrame([(0, i, x, y) for i, (x, y) in points.items()], "k int, id long, x double, y double")
    got = {(r["view_id"], r["id"]) for r in cover.owned(v, p, ["k"], "view_id", "id", 120, 90, at_once=at_once).collect()}
    assert got == in_turn(views, points, 120, 90)


def test_stride_of_a_slide_is_its_own(spark):
    pts = [(0, i, float(40 * i), float(30 * i)) for i in range(20)] + [(1, i, float(9000 * i), float(7000 * i)) for i in range(20)]
    df = spark.createDataFrame(pts, "k int, id long, x double, y double")
    alone = {r["k"]: r["ratio"] for k in (0, 1) for r in cover.stride_ratios(df.where(f"k = {k}"), ["k"], 384, 283).collect()}
    assert {r["k"]: r["ratio"] for r in cover.stride_ratios(df, ["k"], 384, 283).collect()} == alone
    n = ((19 * 9000) / int(384 * 0.25) + 1) * ((19 * 7000) / int(283 * 0.25) + 1)
    assert alone[0] == 0.25 and abs(alone[1] - min(1.0, 0.25 * (n / 20_000) ** 0.5)) < 1e-9


def test_boxes_without_area_overlap_nothing(spark):
    rows = [(0, 1, 0.9, 5, 5, 5, 5), (0, 2, 0.8, 5, 5, 5, 5), (0, 3, 0.7, 0, 0, 10, 10), (0, 4, 0.6, 2, 2, 2, 8), (0, 5, 0.5, 0, 0, 10, 10)]
    df = spark.createDataFrame(rows, "k int, id long, score double, x1 int, y1 int, x2 int, y2 int")
    assert {r["id"] for r in suppress.nms(df, ["k"], 0.2, 64).collect()} == {1, 2, 3, 4}
    assert {r["id"] for r in suppress.contained(df, ["k"], 0.45, 64).collect()} == {1, 2, 3, 4}
    assert {r["id"] for r in regions.off_bad_regions(df.drop("score"), spark.createDataFrame([(0, 4, 4, 4, 9)], "k int, x1 int, y1 int, x2 int, y2 int"), ["k"]).collect()} == {1, 2, 3, 4, 5}


def test_letterbox(spark):
    """Scale and padding of a padded detector input; halves go away from zero, and the odd pixel to the far side."""
    import math

    sizes = [(2448, 2048), (100, 100), (1248, 700), (333, 1000), (1247, 1243)]
    df = spark.createDataFrame(sizes, "w int, h int")
    got = {(r["w"], r["h"]): (r["r"], r["x"], r["y"]) for r in df.select("w", "h", *(c.alias(n) for c, n in zip(T.letterbox(F.col("w"), F.col("h")), "rxy"))).collect()}
    for w, h in sizes:
        r = min(1248 / h, 1248 / w)
        pads = [max(0, math.floor((1248 - math.floor(n * r + 0.5)) % 32 / 2 - 0.1 + 0.5)) for n in (w, h)]
        assert got[w, h] == (r, *pads)


def test_missing_tiles_of_sparse_and_repeated_layers(spark):
    t = spark.createDataFrame([(0, 0, 0, "a", 1), (0, 0, 0, None, 2), (0, 1, 1, "b", 3)], "slide_id long, row_index int, col_index int, image_uid string, seq int")
    dense = {(r["row_index"], r["col_index"], r["position_missing"], r["image_missing"]) for r in T.missing_tiles(t, 2, 2, "seq").collect()}
    assert dense == {(0, 0, 0, 1), (0, 1, 1, 1), (1, 0, 1, 1)}
    assert [(r["row_index"], r["image_missing"]) for r in T.missing_tiles(t, 0, 0, "seq").collect()] == [(0, 1)]


def test_missing_tiles_and_progress_by_slide(spark):
    t = spark.createDataFrame([(0, 0, 0, "a"), (1, 0, 0, "b"), (1, 0, 1, None), (2, 5, 5, None), (2, 5, 6, "c")], "slide_id long, row_index int, col_index int, image_uid string")
    layers = spark.createDataFrame([(0, 1, 1), (1, 1, 3), (2, 0, 0), (3, 1, 1)], "slide_id long, rows int, cols int")
    assert {tuple(r) for r in T.missing_by_layer(t, layers).collect()} == {(1, 0, 1, 0, 1), (1, 0, 2, 1, 1), (2, 5, 5, 0, 1), (3, 0, 0, 1, 1)}
    u = spark.createDataFrame([(1, 0, 0, 5), (1, 0, 1, 5), (2, 0, 0, 5), (2, 1, 0, 0)], "task_id long, row_index int, col_index int, n_bytes long")
    grids = spark.createDataFrame([(1, 1, 2), (2, 2, 1)], "task_id long, rows int, cols int")
    assert {tuple(r) for r in T.progress(u, grids).collect()} == {(1, 2, 2, 0, 100), (2, 1, 2, 1, 101)}
    assert {tuple(r) for r in T.upload_complete(u, grids).collect()} == {(1, True), (2, False)}


def test_checks_of_full_grids(spark):
    t = spark.createDataFrame([(0, 0), (0, 1), (1, 0)], "slide_id long, tile_idx int")
    b = spark.createDataFrame([(0, 0, x, y) for x in (0, 1) for y in (0, 1)] + [(0, 1, 0, 0)] + [(1, 0, x, y) for x in (0, 1) for y in (0, 1)], "slide_id long, tile_idx int, dx int, dy int")
    assert [(r["slide_id"], r["odd_tiles"]) for r in heatmap.complete_blocks(b, t, 1, 2).collect()] == [(0, 1), (1, 0)]
    assert heatmap.complete_blocks(b.where("slide_id = 1"), t.where("slide_id = 1"), 1, 1).count() == 0


def test_image_folder(spark, tmp_path):
    for name in ("Pos[0][1].jpg", "Pos[2][0].jpg", "other.jpg"):
        (tmp_path / name).write_bytes(b"x")
    got = {(r["col_index"], r["row_index"]) for r in files.read_images(spark, str(tmp_path)).collect()}
    assert got == {(0, 1), (2, 0)}


def test_nested_documents(spark):
    import json

    u = spark.createDataFrame([(1, "a.x", 1, 1.5), (1, "a.x", 2, 2.5), (1, "a.y", 1, None), (1, "b", 1, 4.0), (2, 'q"t', 1, 1.0)], "doc_id long, path string, seq long, value double")
    got = {r["doc_id"]: json.loads(r["json"]) for r in files.nested(files.merge_scalars(u, ["doc_id"]), ["doc_id"]).collect()}
    assert got == {1: {"a": {"x": 2.5, "y": None}, "b": 4.0}, 2: {'q"t': 1.0}}


def test_points_and_bounds(spark):
    from tilelake.operators import spatial

    p = spark.createDataFrame([(0, 10.0, 20.0), (0, 110.0, 25.0)], "k int, x double, y double")
    assert [tuple(r) for r in spatial.tightened(p, ["k"], (50, 40)).collect()] == [(0, 0, 19, 120, 40)]
    assert regions.near_target(spark.createDataFrame([(0, 1, 70), (0, 2, 90), (0, 3, 10)], "k int, id int, cells int"), spark.createDataFrame([(0, 500)], "k int, total int"), ["k"], 60).select("id").collect()[0]["id"] == 1


def test_written_tables_are_not_taken_for_small_by_their_files(spark, capsys):
    from tilelake.session import cut

    small_file = cut(spark.range(3_000_000).selectExpr("pmod(hash(id), 3) as a", "pmod(hash(id), 5) as b"))
    spark.range(10_000_000).selectExpr("id as a").join(small_file, "a", "left").explain()
    assert "Broadcast" not in capsys.readouterr().out
    tiny = cut(spark.range(3).selectExpr("id as a"))
    spark.range(10_000_000).selectExpr("id as a").join(tiny, "a", "left_semi").explain()
    assert "Broadcast" in capsys.readouterr().out


def test_small_parts_come_to_a_task_together():
    rng = np.random.default_rng(5)
    part, n = np.repeat(np.arange(500), 2), rng.integers(1, 40, 1000)
    batch = cover.together(part, n, 400)
    assert all(len(set(batch[part == p])) == 1 for p in range(500))  # no part is torn
    held = np.bincount(batch, weights=n)
    assert held.max() <= 400 + 80 and len(held) <= n.sum() / 400 + 1


def test_cover_of_many_small_parts_is_that_of_each(spark):
    rng = np.random.default_rng(6)
    places = [(s, i, 5000 * (i // 3 % 40) + int(a), 4000 * (i // 120) + int(b)) for s in (0, 1) for i, (a, b) in enumerate(rng.integers(0, 900, (360, 2)))]
    df = spark.createDataFrame(places, "slide_id long, id long, x int, y int")
    got = sorted((r["slide_id"], r["wx"], r["wy"], r["points"]) for r in cover.cover(df, ["slide_id"], "id", 384, 283, closed=False, at_once=50).collect())
    want = []
    for s in (0, 1):
        own = np.array([p[2:] for p in places if p[0] == s])
        u, v = own[:, 0] // 384, own[:, 1] // 283
        bins, name, n = np.unique(np.stack([u, v], 1), axis=0, return_inverse=True, return_counts=True)
        component, part = cover.divide(bins[:, 0], bins[:, 1], n, 384, 283, 50)
        for p in set(part):
            on = part[name.reshape(-1)] == p
            want += [(s, *w) for w in cover.cover_part(own[on, 0].astype(float), own[on, 1].astype(float), 384, 283, 0.25, 20_000, False)]
    assert len(want) > 200 and got == sorted(want)


def test_edges_are_found_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def edges(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    e = spark.createDataFrame([(0, 1, 2), (0, 2, 3), (0, 3, 4), (1, 5, 6)], "k int, u long, v long").mapInPandas(edges, "k int, u long, v long")
    assert sorted(tuple(r) for r in suppress.suppressed(e, ["k"]).collect()) == [(0, 2), (0, 4), (1, 6)]
    assert seen.value == 4
