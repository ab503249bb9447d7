"""The life of upload tasks on a stream, and tables that survive a restart.

task_events() follows every task with one state: the places of its grid that have come, until the grid is full (status 100) or nothing has come for
`idle` (status 102).  A closed task keeps a mark for `remember`, so that what comes later is rejected, and then nothing.  keep_tables()
writes what it gives out in micro-batches: accepted and rejected uploads, statuses and progress, each under its batch's number, so
a batch that is run again after a restart replaces what it had written.
"""

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tilelake.operators.tiles import of_grid
from tilelake.session import ship

# Status and answer codes (fixed values): complete, collecting, timed out; place already filled, no payload.
COMPLETE, COLLECTING, TIMED_OUT, REPEATED, EMPTY = 100, 101, 102, 103, 201
EVENTS = "task_id long, kind string, event_id long, row_index int, col_index int, ts timestamp, code int, received long, expected long"


class TaskLife(StatefulProcessor):
    """State of one task: its status, a bit for each place of the grid, and how many are set; dropped `remember_ms` after it closed."""

    def __init__(self, idle_ms: int, remember_ms: int):
        self.idle_ms, self.remember_ms = idle_ms, remember_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("task", "status int, seen binary, received int, expected int, until long")

    def _wait(self, until: int) -> int:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(until)
        return until

    def handleInputRows(self, key, rows, timerValues):
        rows = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        down, across = int(rows["rows"].iloc[0]), int(rows["cols"].iloc[0])
        n = down * across
        status, seen, received, n, until = self.state.get() if self.state.exists() else (COLLECTING, b"\0" * (-(-n // 8)), 0, n, 0)
        took, out = False, []
        if until and until <= timerValues.getCurrentWatermarkInMs():  # its timer was due before these rows
            if status == COLLECTING:
                out += self._closed(key, TIMED_OUT, received, n, until)
                status, until = TIMED_OUT, until + self.remember_ms
            if until <= timerValues.getCurrentWatermarkInMs():
                n = down * across
                status, seen, received, until = COLLECTING, b"\0" * (-(-n // 8)), 0, 0
        bits = bytearray(seen)
        for r in rows.itertuples():
            place = r.row_index * across + r.col_index
            inside = 0 <= r.row_index < down and 0 <= r.col_index < across and place < n
            if status != COLLECTING:
                code = status
            elif not r.n_bytes or not inside:
                code = EMPTY
            elif bits[place // 8] >> place % 8 & 1:
                code = REPEATED
            else:
                bits[place // 8] |= 1 << place % 8
                received, code, took = received + 1, 0, True
            out.append((key[0], "accepted" if code == 0 else "rejected", r.event_id, r.row_index, r.col_index, r.ts, code, None, None))
            if status == COLLECTING:
                until = max(until, int(r.ts.timestamp() * 1000) + self.idle_ms)
                if received == n:
                    status, until = COMPLETE, int(r.ts.timestamp() * 1000) + self.remember_ms
                    out.append((key[0], "status", None, None, None, r.ts, COMPLETE, received, n))
        if took:
            out.append((key[0], "progress", None, None, None, None, status, received, n))
        self.state.update((status, bytes(bits) if status == COLLECTING else b"", received, n, self._wait(max(until, timerValues.getCurrentWatermarkInMs() + 1))))
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self.state.exists():
            return
        status, _, received, n, until = self.state.get()
        if status != COLLECTING:
            self.state.clear()
            return
        self.state.update((TIMED_OUT, b"", received, n, self._wait(until + self.remember_ms)))
        yield _frame(self._closed(key, TIMED_OUT, received, n, until))

    def _closed(self, key, status: int, received: int, n: int, until: int) -> list[tuple]:
        return [(key[0], "status", None, None, None, pd.Timestamp(until, unit="ms"), status, received, n), (key[0], "progress", None, None, None, None, status, received, n)]

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    f = pd.DataFrame(rows, columns=[c.split()[0] for c in EVENTS.split(", ")])
    f["ts"] = pd.to_datetime(f["ts"])
    return f.astype({"event_id": "Int64", "row_index": "Int32", "col_index": "Int32", "received": "Int64", "expected": "Int64", "code": "int32"})


def task_events(uploads: DataFrame, grid, idle_seconds: int = 300, remember_seconds: int = 3600, watermark: str = "60 seconds") -> DataFrame:
    """What happens to tasks (EVENTS) by a stream of uploads (event_id, task_id, row_index, col_index, n_bytes, ts).

    grid: (rows, cols) for all tasks, or a table (task_id, rows, cols), which a task's first upload fixes.

    kind accepted or rejected: one row for each upload, code 0, or 103 (its place is filled), 201 (no payload, or a place off the grid), 100 or 102
    (its task is closed).  kind status: once for each task that closes, 100 or 102.  kind progress: places received whenever that has
    changed.  Rows of a batch are taken in order of ts, then event_id.  The session's state store must be RocksDB's (rocksdb_state()).
    """
    ship(uploads.sparkSession)
    u = uploads.select("event_id", F.col("task_id").cast("long").alias("task_id"), "row_index", "col_index", "n_bytes", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", watermark)
    return of_grid(u, grid).groupBy("task_id").transformWithStateInPandas(TaskLife(1000 * idle_seconds, 1000 * remember_seconds), outputStructType=EVENTS, outputMode="Append", timeMode="EventTime")


def rocksdb_state(spark: SparkSession) -> None:
    """Choose the state store that task_events() needs, for the queries that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Tables of keep_tables() and the columns of each.
TABLES = {"accepted": ("task_id", "event_id", "row_index", "col_index", "ts"), "rejected": ("task_id", "event_id", "row_index", "col_index", "ts", "code"),
          "status": ("task_id", "code", "ts", "received", "expected"), "progress": ("task_id", "code", "received", "expected")}


def keep_tables(events: DataFrame, path: str, checkpoint: str):
    """A stream writer that keeps the tables of task_events() below path; start it, with the same checkpoint folder after a stop.

    A batch writes the folder batch=n of each table and replaces it if it is there already; so a batch that is repeated adds nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for name, cols in TABLES.items():
            batch.where(F.col("kind") == name).select(*cols).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        batch.unpersist()

    return events.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint)


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of keep_tables(); of progress the latest row of each task."""
    df = spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")
    if name != "progress":
        return df.drop("batch")
    cols = TABLES[name]
    return df.groupBy("task_id").agg(F.max_by(F.struct(*cols[1:]), F.struct("batch", "received", "code")).alias("r")).select("task_id", "r.*")
