"""Saved projects that can be saved again, and results kept by what they were made from.

A project is a folder of versions and manifests.  A version holds the slides of one save, a manifest says for every slide which version is
its latest.  A manifest counts once Spark has finished it, so readers see a save as a whole or not at all; and a save writes its own slides
only.  Two savers at once write the same manifest number, and the second one fails.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilelake.session import cut


def _finished(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the finished tables in a folder, in order."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath() for s in fs.listStatus(path)]
    return sorted(int(p.getName()) for p in names if p.getName().isdigit() and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def _manifest(spark: SparkSession, path: str, number: int) -> DataFrame:
    return spark.read.schema("slide_id long, version string").parquet(f"{path}/manifest/{number}")


def save_project(df: DataFrame, path: str) -> None:
    """Save the slides of df; slides saved before that df lacks stay as they are, those that it has are replaced."""
    spark = df.sparkSession
    known = _finished(spark, f"{path}/manifest")
    version = uuid.uuid4().hex
    df.write.partitionBy("slide_id").parquet(f"{path}/data/version={version}")
    now = spark.read.parquet(f"{path}/data/version={version}").select(F.col("slide_id").cast("long")).distinct().withColumn("version", F.lit(version))
    if known:
        old = _manifest(spark, path, known[-1])
        now = now.unionByName(old.join(now, "slide_id", "left_anti"))
    now.write.parquet(f"{path}/manifest/{known[-1] + 1 if known else 0}")


def load_project(spark: SparkSession, path: str, slide_id: int | None = None, number: int | None = None) -> DataFrame:
    """A saved table, or one slide of it, as of the latest save (or of the one with that number, from 0); only its folders are read."""
    known = _finished(spark, f"{path}/manifest")
    if not known:
        raise FileNotFoundError(f"no project was saved in {path}")
    places = _manifest(spark, path, known[-1] if number is None else number)
    if slide_id is not None:
        places = places.where(F.col("slide_id") == slide_id)
    versions = sorted(r[0] for r in places.select("version").distinct().collect())  # saves that still count
    data = spark.read.option("basePath", f"{path}/data").parquet(*(f"{path}/data/version={v}" for v in versions)) if versions else spark.read.parquet(f"{path}/data").limit(0)
    data = data.withColumn("slide_id", F.col("slide_id").cast("long"))
    if slide_id is not None:
        data = data.where(F.col("slide_id") == slide_id)
    return data.join(places, ["slide_id", "version"], "left_semi").drop("version")


def fingerprints(tables: dict[str, DataFrame], **settings) -> DataFrame:
    """(slide_id, key): for each slide of any table a key that changes with its rows (in any order) in any table, and with the settings."""
    rows = None
    for name, t in sorted(tables.items()):
        cols = sorted(c for c in t.columns if c != "slide_id")
        each = t.select("slide_id", F.lit(name).alias("t"), F.md5(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).cast("binary")).alias("h"))
        half = lambda i: F.sum(F.conv(F.substring("h", i, 16), 16, 10).cast("decimal(38,0)")).cast("string")
        each = each.groupBy("slide_id", "t").agg(F.concat_ws(",", F.count("*").cast("string"), half(1), half(17)).alias("sum"))
        rows = each if rows is None else rows.unionByName(each)
    text = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "t", "sum"))), ";")
    return rows.groupBy("slide_id").agg(F.md5(F.concat(text, F.lit(repr(sorted(settings.items())))).cast("binary")).alias("key"))


def kept_results(path: str, tables: dict[str, DataFrame], compute, area, **settings) -> DataFrame:
    """compute(tables, area) of every slide, from a store where it is there.

    A result is kept by its slide, the user area (one for all slides, or a table with each one's), the settings and a fingerprint of the slide's rows
    in all tables.  Only slides without a result are computed, together, and only their rows are read for it.  The list of results is
    written after them, so a run that broke off leaves nothing that counts.
    """
    spark = next(iter(tables.values())).sparkSession
    inputs = dict(tables) if isinstance(area, dict) else {**tables, "area": area}
    wanted = fingerprints(inputs, area=sorted(area.items()) if isinstance(area, dict) else None, **settings)
    known = _finished(spark, f"{path}/done")
    done = spark.read.schema("slide_id long, key string, run string").parquet(*(f"{path}/done/{n}" for n in known)) if known else spark.createDataFrame([], "slide_id long, key string, run string")
    missing = wanted.join(done, ["slide_id", "key"], "left_anti").withColumn("run", F.lit(uuid.uuid4().hex))
    if not missing.isEmpty():
        number = known[-1] + 1 if known else 0
        missing = cut(missing)  # read again and again below
        run = missing.first()["run"]
        own = {name: t.join(missing.select("slide_id"), "slide_id", "left_semi") for name, t in inputs.items()}
        found = compute({name: own[name] for name in tables}, area if isinstance(area, dict) else own["area"])
        found.write.parquet(f"{path}/results/run={run}")
        missing.write.parquet(f"{path}/done/{number}")
        done = done.unionByName(missing.select("slide_id", "key", "run"))
    use = wanted.join(done, ["slide_id", "key"])
    return spark.read.option("basePath", f"{path}/results").parquet(f"{path}/results").join(use.select("slide_id", "run"), ["slide_id", "run"], "left_semi").drop("run")
