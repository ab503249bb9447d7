"""Tile uploads as streams: duplicates, completion, idle time-out, and joining asynchronous results."""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(df: DataFrame, column: str, delay: str) -> DataFrame:
    """df with a watermark; event times must be timestamps with a time zone, which the session's zone gives to others."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def accepted(uploads: DataFrame, delay: str = "300 seconds") -> DataFrame:
    """First upload with payload of each (task, row, column) within the watermark."""
    return _timed(uploads.where("n_bytes > 0"), "ts", delay).dropDuplicatesWithinWatermark(["task_id", "row_index", "col_index"])


def running_progress(uploads: DataFrame, rows: int, cols: int) -> DataFrame:
    """Received and missing places of each task; the set of places is bounded by the grid.  Update mode."""
    place = F.when(F.col("n_bytes") > 0, F.col("row_index") * cols + F.col("col_index"))
    return uploads.groupBy("task_id").agg(F.size(F.collect_set(place)).cast("long").alias("received")).withColumn(
        "missing", F.lit(rows * cols).cast("long") - F.col("received"))


def idle_sessions(uploads: DataFrame, gap: str = "300 seconds", watermark: str = "300 seconds") -> DataFrame:
    """Sessions of uploads of each task that end after `gap` without an upload."""
    if uploads.isStreaming:
        uploads = _timed(uploads, "ts", watermark)
    return uploads.groupBy("task_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select(
        "task_id", F.col("s.start").alias("start_ts"), F.col("s.end").alias("end_ts"), "n")


def with_results(uploads: DataFrame, results: DataFrame, bound: str = "1 hour") -> DataFrame:
    """Uploads joined with results that come within a bound; results without upload are dropped."""
    u = _timed(uploads, "ts", bound).alias("u")
    r = _timed(results.withColumnRenamed("ts", "result_ts"), "result_ts", bound).alias("r")
    on = (F.col("u.task_id") == F.col("r.task_id")) & (F.col("u.row_index") == F.col("r.row_index")) & (F.col("u.col_index") == F.col("r.col_index"))
    return u.join(r, on & F.expr(f"r.result_ts >= u.ts and r.result_ts <= u.ts + interval {bound}")).select(
        "u.task_id", "u.row_index", "u.col_index", "u.ts", "r.result_ts", "r.n_cells")


def completions(uploads: DataFrame, rows: int, cols: int) -> DataFrame:
    """(task_id, status 100) once, when every place of a task's grid has come; the state is one bit a place."""

    def step(key, frames, state):
        seen, told = state.get if state.exists else (b"\0" * (-(-rows * cols // 8)), False)
        bits = bytearray(seen)
        for f in frames:
            for p in (f["row_index"] * cols + f["col_index"]).unique():
                bits[int(p) // 8] |= 1 << int(p) % 8
        full = sum(b.bit_count() for b in bits) == rows * cols
        state.update((bytes(bits), bool(told or full)))
        if full and not told:
            yield pd.DataFrame({"task_id": [key[0]], "status": [100]})

    inside = (F.col("row_index").between(0, rows - 1)) & F.col("col_index").between(0, cols - 1)
    rows_in = uploads.where((F.col("n_bytes") > 0) & inside).select("task_id", "row_index", "col_index")
    return rows_in.groupBy("task_id").applyInPandasWithState(step, "task_id long, status int", "seen binary, told boolean", "append", "NoTimeout")
