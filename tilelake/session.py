"""What jobs need of their session: the shared folder, tables written on the way, and this package on the workers."""

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def base_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; a temporary one only where Spark runs in this process alone."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return base or tempfile.mkdtemp(prefix="spark-")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name that the driver and every executor see."""
    return f"{base_folder(spark)}/{name}-{uuid.uuid4().hex}"


def until_end(spark: SparkSession, path: str) -> None:
    """Have a folder, which must be there, removed when the driver ends."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


#: Bytes that a row takes in memory for each byte in Parquet files; for joins of tables that repeat themselves, such as places and tile numbers.
UNPACKED = 30


def true_sizes(spark: SparkSession) -> None:
    """Have Spark take tables for as large as their rows are in memory; a factor that the session has set itself stays.

    Left to itself, it goes by the bytes of the files, and sends tables of a million rows through the driver to all tasks.
    """
    name = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(name)) == 1:
        spark.conf.set(name, str(UNPACKED))


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder, and read from there: a plan without lineage, whose size Spark knows.

    The copy stays until the driver ends.
    """
    true_sizes(df.sparkSession)
    path = shared_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    until_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """df dealt by columns over all shuffle partitions of the session, for work in Python that is long for few bytes.

    Left to itself, Spark joins partitions of few bytes, and the work of thousands of groups falls to one or two tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each Spark context; they need not have it installed."""
    sc = spark.sparkContext
    if not getattr(sc, "_tilelake_sent", False):
        root = os.path.dirname(os.path.abspath(__file__))
        made = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "tilelake"), "zip", os.path.dirname(root), os.path.basename(root))
        sc.addPyFile(made)
        sc._tilelake_sent = True
