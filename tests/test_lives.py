"""The life of tasks on real streams: completion, time-out, rejected uploads, restarts, and an empty state afterwards."""

import datetime as dt
import random

import pytest

from tilelake.streaming import lives

T0 = dt.datetime(2024, 1, 1)
UPLOADS = "event_id long, task_id long, row_index int, col_index int, n_bytes long, ts timestamp"


@pytest.fixture()
def session(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    lives.rocksdb_state(spark)
    yield spark
    spark.conf.unset(key)


def put(spark, folder, rows):
    """One file of uploads (event_id, task_id, row, col, bytes, second)."""
    df = spark.createDataFrame([(*r[:5], T0 + dt.timedelta(seconds=r[5])) for r in rows], UPLOADS)
    df.coalesce(1).write.mode("append").parquet(folder)


def go(spark, tmp_path, **settings):
    src = spark.readStream.schema(UPLOADS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    grid = settings.pop("grid", (2, 2))
    events = lives.task_events(src, grid, **settings)
    q = lives.keep_tables(events, str(tmp_path / "out"), str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return q


def table(spark, tmp_path, name):
    return lives.read_table(spark, str(tmp_path / "out"), name)


def test_every_exit_and_no_state_afterwards(session, tmp_path):
    spark, src = session, str(tmp_path / "in")
    full = [(i, 1, i // 2, i % 2, 5, i) for i in range(4)]
    put(spark, src, [*full[:3], (10, 1, 0, 0, 5, 2), (11, 1, 0, 1, 0, 2), (12, 1, 7, 0, 5, 2), (20, 2, 0, 0, 5, 3)])
    put(spark, src, [full[3], (13, 1, 1, 1, 5, 9)])
    put(spark, src, [(30, 3, 0, 0, 5, 1000)])  # the watermark passes: task 2 has been idle
    put(spark, src, [(21, 2, 0, 1, 5, 1001), (31, 3, 0, 1, 5, 1002)])
    settings = {"idle_seconds": 300, "remember_seconds": 2000, "watermark": "10 seconds"}
    go(spark, tmp_path, **settings)
    status = {r["task_id"]: (r["code"], r["received"]) for r in table(spark, tmp_path, "status").collect()}
    assert status == {1: (100, 4), 2: (102, 1)}
    assert {r["event_id"]: r["code"] for r in table(spark, tmp_path, "rejected").collect()} == {10: 103, 11: 201, 12: 201, 13: 100, 21: 102}
    assert sorted(r["event_id"] for r in table(spark, tmp_path, "accepted").collect()) == [0, 1, 2, 3, 20, 30, 31]
    assert {r["task_id"]: (r["code"], r["received"], r["expected"]) for r in table(spark, tmp_path, "progress").collect()} == {1: (100, 4, 4), 2: (102, 1, 4), 3: (101, 2, 4)}
    # later still: all marks are dropped, and task 1 may begin anew
    put(spark, src, [(40, 4, 0, 0, 5, 90_000)])
    put(spark, src, [(41, 4, 0, 1, 5, 190_000)])
    put(spark, src, [(42, 5, 0, 1, 5, 290_000)])
    q = go(spark, tmp_path, **settings)
    kept = sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"])
    assert {r["task_id"]: r["code"] for r in table(spark, tmp_path, "status").collect()} == {1: 100, 2: 102, 3: 102, 4: 102}
    put(spark, src, [(43, 1, 0, 0, 5, 290_001)])
    go(spark, tmp_path, **settings)
    assert 43 in {r["event_id"] for r in table(spark, tmp_path, "accepted").collect()}
    assert kept <= 12  # tasks 4 and 5 with their timers; nothing of 1, 2 and 3


def test_tasks_of_different_grids(session, tmp_path):
    spark = session
    grids = spark.createDataFrame([(1, 1, 2), (2, 3, 1)], "task_id long, rows int, cols int")
    put(spark, str(tmp_path / "in"), [(0, 1, 0, 0, 5, 0), (1, 1, 0, 1, 5, 1), (2, 2, 0, 0, 5, 2), (3, 2, 2, 0, 5, 3), (4, 2, 0, 1, 5, 3), (5, 7, 0, 0, 5, 4)])
    go(spark, tmp_path, grid=grids)
    assert {r["task_id"]: (r["code"], r["received"], r["expected"]) for r in table(spark, tmp_path, "progress").collect()} == {1: (100, 2, 2), 2: (101, 2, 3)}
    assert {r["event_id"]: r["code"] for r in table(spark, tmp_path, "rejected").collect()} == {4: 201}


def test_restart_repeats_and_loses_nothing(session, tmp_path):
    """The query is stopped after each file and a batch's folders are left half written; the tables end as those of one run."""
    spark, src = session, str(tmp_path / "in")
    rng = random.Random(4)
    rows = [(i, rng.randrange(6), rng.randrange(2), rng.randrange(2), rng.choice([0, 5, 5, 5]), i) for i in range(60)]
    for k in range(3):
        put(spark, src, rows[20 * k:20 * k + 20])
        go(spark, tmp_path)
    # what a stop in the middle of a batch leaves: the commit is gone, the batch's output is there
    import glob
    import os
    commits = sorted(glob.glob(str(tmp_path / "check/commits/*")), key=lambda p: int(os.path.basename(p)))
    last = commits[-1]
    os.remove(last)
    crc = os.path.join(os.path.dirname(last), f".{os.path.basename(last)}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    go(spark, tmp_path)
    seen, want = set(), {}
    closed: dict = {}
    for i, task, r, c, n, _ in rows:
        full = {(t, a, b) for t, a, b in seen if t == task}
        code = 100 if len(full) == 4 else 201 if not n else 103 if (task, r, c) in seen else 0
        if code == 0:
            seen.add((task, r, c))
        want[i] = code
    got = {r["event_id"]: 0 for r in table(spark, tmp_path, "accepted").collect()} | {r["event_id"]: r["code"] for r in table(spark, tmp_path, "rejected").collect()}
    n = table(spark, tmp_path, "accepted").count() + table(spark, tmp_path, "rejected").count()
    assert got == want and n == len(rows) and not closed
    assert {r["task_id"]: r["received"] for r in table(spark, tmp_path, "progress").collect()} == {t: sum(s[0] == t for s in seen) for t in {s[0] for s in seen}}
