"""Files of slides: cell and block text files, project JSON, image folders, task lists and saved projects.

Readers keep slide_id from the folder name `slide_id=...`, so that one read covers any number of slides.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROJECT = """slide_id long, task_info struct<row_num: int, col_num: int>, nodes array<struct<row: int, col: int, data: struct<position: array<double>,
    area_score_info: array<array<double>>, wbc_center_pt: array<array<double>>, meg_center_pt: array<array<double>>>>>"""
TILE_CENTRE = (1224, 1024)


def by_slide(df: DataFrame) -> DataFrame:
    """df dealt by slide, small slides together and large ones over several tasks; so that what is written by slide is not as many files as
    tasks times slides.  Rows come in any order: lines whose order counts are made after it.
    """
    return df.hint("rebalance", "slide_id")


def write_lines(df: DataFrame, path: str) -> None:
    """Text files of (slide_id, value), one folder a slide, in the order in which the rows come (see by_slide)."""
    df.select("slide_id", "value").write.partitionBy("slide_id").text(path)


def read_lines(spark: SparkSession, path: str, n_fields: int) -> DataFrame:
    """(slide_id, line_no, f) of the lines that have n_fields fields; line_no sorts the lines of a file."""
    order = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))
    lines = spark.read.text(path).select(F.col("slide_id").cast("long"), order.alias("line_no"), F.split(F.trim("value"), r"\s+").alias("f"))
    return lines.where(F.size("f") == n_fields)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """One row a cell; the tile's origin is its centre less half a tile."""
    f = lambda i, t: F.get("f", F.lit(i)).try_cast(t)
    return read_lines(spark, path, 9).select(
        "slide_id", f(0, "int").alias("ix"), f(1, "int").alias("iy"), (f(2, "int") - TILE_CENTRE[0]).alias("abs_x"), (f(3, "int") - TILE_CENTRE[1]).alias("abs_y"),
        f(5, "double").alias("local_x"), f(6, "double").alias("local_y"), f(7, "double").alias("global_x"), f(8, "double").alias("global_y"), "line_no")


def cells_by_tile(cells: DataFrame) -> DataFrame:
    """Lists of local and global centres of each tile (bounded by the cells of one tile); the origin comes from its first row."""
    row = F.struct("line_no", F.array("local_x", "local_y").alias("l"), F.array("global_x", "global_y").alias("g"))
    out = cells.groupBy("slide_id", "ix", "iy").agg(
        F.min_by("abs_x", "line_no").alias("abs_x"), F.min_by("abs_y", "line_no").alias("abs_y"), F.array_sort(F.collect_list(row)).alias("r"))
    return out.select("slide_id", "ix", "iy", "abs_x", "abs_y", F.col("r.l").alias("local_centers"), F.col("r.g").alias("global_centers"))


def read_blocks(spark: SparkSession, path: str, y_of_first: int = 352) -> DataFrame:
    """One score for each quadrant of a tile; of repeated lines the last counts."""
    f = lambda i, t: F.get("f", F.lit(i)).try_cast(t)
    rows = read_lines(spark, path, 6).select(
        "slide_id", f(0, "int").alias("ix"), f(1, "int").alias("iy"), F.when(f(2, "int") == 0, 0).otherwise(1).alias("dx"),
        F.when(f(3, "int") == y_of_first, 0).otherwise(1).alias("dy"), f(5, "double").alias("score"), "line_no")
    return rows.groupBy("slide_id", "ix", "iy", "dx", "dy").agg(F.max_by("score", "line_no").alias("score"))


def combine(blocks: DataFrame, tile_cells: DataFrame) -> DataFrame:
    """Tiles that have blocks, with their scores by quadrant and their cells; tiles without cells get origin 0 and empty lists."""
    key = F.concat_ws("_", "dx", "dy")
    scores = blocks.groupBy("slide_id", "ix", "iy").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "score")))).alias("scores"))
    none = F.array().cast("array<array<double>>")
    out = scores.join(tile_cells, ["slide_id", "ix", "iy"], "left")
    return out.select("slide_id", "ix", "iy", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("abs_x", "abs_y")),
                      *(F.coalesce(c, none).alias(c) for c in ("local_centers", "global_centers")), "scores")


def read_project(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Tiles of project files: one row a node, the row index flipped.  A node without exactly four block rows is an error."""
    p = spark.read.schema(PROJECT).json(path, multiLine=multi_line)
    n = p.select("slide_id", F.col("task_info.row_num").alias("rows"), F.explode("nodes").alias("n"))
    checked = F.when(F.size("n.data.area_score_info") == 4, F.col("n.data.area_score_info")).otherwise(F.raise_error(F.lit("a tile needs four block scores")))
    return n.select("slide_id", F.col("n.col").alias("ix"), (F.col("rows") - 1 - F.col("n.row")).alias("iy"), F.get("n.data.position", F.lit(0)).alias("abs_x"),
                    F.get("n.data.position", F.lit(1)).alias("abs_y"), checked.alias("blocks"), F.col("n.data.wbc_center_pt").alias("wbc"), F.col("n.data.meg_center_pt").alias("meg"))


def project_cells(tiles: DataFrame) -> DataFrame:
    """Nucleated boxes of read_project() in slide coordinates."""
    at = lambda i: F.get("b", F.lit(i))
    rows = tiles.select("slide_id", "ix", "iy", "abs_x", "abs_y", F.explode("wbc").alias("b"))
    return rows.select("slide_id", "ix", "iy", *((at(i) + F.col(p)).alias(c) for i, (c, p) in enumerate(zip(("x1", "y1", "x2", "y2"), ("abs_x", "abs_y") * 2))), at(4).alias("score"))


def project_megs(tiles: DataFrame) -> DataFrame:
    """Megakaryocytes of read_project(), given as x, y, width, height in their tile, as boxes in slide coordinates."""
    at = lambda i: F.get("b", F.lit(i))
    rows = tiles.select("slide_id", "ix", "iy", "abs_x", "abs_y", F.explode("meg").alias("b"))
    x, y = at(0) + F.col("abs_x"), at(1) + F.col("abs_y")
    return rows.select("slide_id", "ix", "iy", x.alias("x1"), y.alias("y1"), (x + at(2)).alias("x2"), (y + at(3)).alias("y2"), at(4).alias("score"))


def project_blocks(tiles: DataFrame, y_of_first: int = 88) -> DataFrame:
    """Score and label of every quadrant of read_project()."""
    at = lambda i: F.get("b", F.lit(i))
    return tiles.select("slide_id", "ix", "iy", F.explode("blocks").alias("b")).select(
        "slide_id", "ix", "iy", F.when(at(0).cast("int") == 0, 0).otherwise(1).alias("dx"), F.when(at(1).cast("int") == y_of_first, 0).otherwise(1).alias("dy"),
        at(4).alias("score"), at(5).cast("int").alias("label"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files below a folder, contents not read."""
    return image_places(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length"))


def image_places(files: DataFrame) -> DataFrame:
    """col_index and row_index from paths that end in Pos[col][row].jpg; other files go."""
    pattern = r"Pos\[(\d+)\]\[(\d+)\]\.jpg$"
    name = F.regexp_replace(F.regexp_replace("path", "%5B", "["), "%5D", "]")
    return files.where(name.rlike(pattern)).withColumn("col_index", F.regexp_extract(name, pattern, 1).cast("int")).withColumn("row_index", F.regexp_extract(name, pattern, 2).cast("int"))


def without_image(tiles: DataFrame, images: DataFrame, keys=("slide_id", "row_index", "col_index")) -> DataFrame:
    return tiles.join(images.select(*keys), list(keys), "left_anti")


def write_task_list(tasks: DataFrame, path: str) -> None:
    """One JSON record for each slide and region, its tasks in order of sort_id; tasks of a region are few by design."""
    rest = [c for c in tasks.columns if c not in ("slide_id", "region", "sort_id")]
    groups = tasks.groupBy("slide_id", "region").agg(F.array_sort(F.collect_list(F.struct("sort_id", *rest))).alias("tasks"))
    groups.write.partitionBy("slide_id").json(path)


def merge_scalars(updates: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, value): of each path the value of the last update (greatest seq)."""
    return updates.groupBy(*keys, "path").agg(F.max_by("value", "seq").alias("value"))


def merge_lists(updates: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, value): the lists of all updates of a path, appended in order of seq.  A path's list is one value of a document."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "value")))
    return updates.groupBy(*keys, "path").agg(F.flatten(F.transform(ordered, lambda s: s["value"])).alias("value"))


def nested(merged: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, json): paths of two segments `a.b` (or one) and their values as a JSON document with one object for each first segment."""
    part = F.split("path", "[.]", 2)
    leaf = merged.select(*keys, F.get(part, F.lit(0)).alias("a"), F.get(part, F.lit(1)).alias("b"), F.to_json(F.struct(F.col("value").alias("v"))).alias("v"))
    # the value's own JSON, without the object around it
    leaf = leaf.withColumn("v", F.when(F.col("v") == "{}", "null").otherwise(F.expr("substring(v, 6, length(v) - 6)")))
    text = lambda name, value: F.concat(F.expr(f"regexp_replace(to_json(array({name})), '^.|.$', '')"), F.lit(":"), value)
    joined = lambda c: F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(c)), ","), F.lit("}"))
    inner = leaf.where(F.col("b").isNotNull()).groupBy(*keys, "a").agg(joined(text("b", F.col("v"))).alias("v"))
    top = inner.unionByName(leaf.where(F.col("b").isNull()).select(*keys, "a", "v"))
    return top.groupBy(*keys).agg(joined(text("a", F.col("v"))).alias("json"))
