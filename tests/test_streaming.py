"""The streaming operators on real streams of the upload events, against their batch results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tilelake.fixtures import load
from tilelake.operators import tiles as T
from tilelake.streaming import uploads as S

DIR = "/root/testdata/sf0.001"


@pytest.fixture()
def run(spark, tmp_path):
    """A frame as a stream of one or more files, an operator on it, and the rows that it gave."""

    def go(df, op, mode, files=3):
        src = str(tmp_path / "in")
        df.orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", max(1, -(-df.count() // files))).parquet(src)
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
        name = f"t{abs(hash(src))}"
        q = op(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    return go


def test_accepted_drops_repeats(spark, run):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(seconds=i), i % 2, 0, i % 3, 0 if i % 7 == 0 else 5) for i in range(60)]
    u = spark.createDataFrame(rows, "event_id long, ts timestamp, task_id long, row_index int, col_index int, n_bytes long")
    got = {(r["task_id"], r["row_index"], r["col_index"]) for r in run(u, lambda s: S.accepted(s, "1 hour"), "append").collect()}
    assert got == {(i % 2, 0, i % 3) for i in range(60) if i % 7}


def test_running_progress_ends_at_batch_result(spark, run):
    u = load(spark, DIR, "uploads")
    seen = run(u, lambda s: S.running_progress(s, 2, 2), "update").groupBy("task_id").agg(F.max("received").alias("received"), F.min("missing").alias("missing"))
    want = T.progress(u, 2, 2).select("task_id", "received", "missing")
    assert sorted(seen.collect()) == sorted(want.collect())


def test_completion_is_told_once(spark, run):
    u = load(spark, DIR, "uploads").where("n_bytes > 0")
    got = run(u, lambda s: S.completions(s, 2, 2), "append").collect()
    want = {r["task_id"] for r in T.progress(u, 2, 2).where("status = 100").collect()}
    assert sorted(r["task_id"] for r in got) == sorted(want)
    assert all(r["status"] == 100 for r in got)


def test_idle_sessions_are_those_of_the_batch(spark, run):
    u = load(spark, DIR, "uploads")
    got = {tuple(r) for r in run(u, lambda s: S.idle_sessions(s, "6 hours", "6 hours"), "append").collect()}
    want = {tuple(r) for r in S.idle_sessions(u.withColumn("ts", F.col("ts").cast("timestamp")), "6 hours").collect()}
    assert got and got <= want  # sessions still open at the end are not given out


def test_results_join_their_uploads(spark, run, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(minutes=i), i % 5, i % 2, i % 3) for i in range(30)]
    u = spark.createDataFrame(rows, "event_id long, ts timestamp, task_id long, row_index int, col_index int")
    r = u.where("event_id % 9 <> 0").select((F.col("ts") + F.expr("interval 20 seconds")).alias("ts"), "task_id", "row_index", "col_index", F.col("event_id").cast("int").alias("n_cells"))
    r.write.parquet(str(tmp_path / "results"))
    results = spark.readStream.schema(r.schema).parquet(str(tmp_path / "results"))
    got = run(u, lambda s: S.with_results(s, results, "25 minutes"), "append", files=1).collect()
    assert sorted(x["n_cells"] for x in got) == [i for i in range(30) if i % 9]
