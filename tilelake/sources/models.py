"""Output of detection models as rows of cells, and models supplied by the user."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOX = ("x1", "y1", "x2", "y2")
ADAPTERS: dict[int, tuple[Callable, str]] = {}


def cells_of_40x(results: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of haveCellCenterPoints (x1, y1, x2, y2, score; type 0) and of bigCellRects (x, y, w, h, rate; type 1)."""
    at = lambda i: F.get("r", F.lit(i))
    rows = lambda c: results.select(*keys, F.explode(c).alias("r"))
    out = lambda df, box, kind: df.select(*keys, *(v.cast("int").alias(n) for v, n in zip(box, BOX)), F.lit(kind).alias("cell_type"), at(4).alias("confidence"))
    return out(rows("haveCellCenterPoints"), [at(i) for i in range(4)], 0).unionByName(
        out(rows("bigCellRects"), [at(0), at(1), at(0) + at(2), at(1) + at(3)], 1))


def _zipped(results: DataFrame, keys: list[str]) -> DataFrame:
    return results.select(*keys, F.explode(F.arrays_zip("cellRects", "cellTypes", "cellRatios")).alias("z"))


def cells_of_100x(results: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes moved by (offset_x, offset_y), with the first type (-1 if none) and its share (1.0 if none)."""
    at = lambda i: F.get("z.cellRects", F.lit(i))
    x, y = at(0) + F.col("offset_x"), at(1) + F.col("offset_y")
    return _zipped(results, [*keys, "offset_x", "offset_y"]).select(
        *keys, x.alias("x1"), y.alias("y1"), (x + at(2)).alias("x2"), (y + at(3)).alias("y2"),
        F.coalesce(F.get("z.cellTypes", F.lit(0)), F.lit(-1)).alias("cell_type"), F.coalesce(F.get("z.cellRatios", F.lit(0)), F.lit(1.0)).alias("confidence"))


def records_of_100x(results: DataFrame, keys: list[str]) -> DataFrame:
    """Each box with a map top1, top2, ... of (type, percent)."""
    names = F.transform(F.col("z.cellTypes"), lambda _, i: F.concat(F.lit("top"), (i + 1).cast("string")))
    pairs = F.zip_with("z.cellTypes", "z.cellRatios", lambda t, p: F.struct(t.alias("type"), p.alias("percent")))
    box = F.struct(*(F.get("z.cellRects", F.lit(i)).alias(n) for i, n in enumerate(("x", "y", "width", "height"))))
    return _zipped(results, keys).select(*keys, box.alias("cell_pos"), F.map_from_arrays(names, pairs).alias("cell_types"))


def register_adapter(magnification: int, fn: Callable, schema: str) -> None:
    """fn takes an iterator of pandas frames of tiles and gives frames of schema."""
    ADAPTERS[magnification] = (fn, schema)


def score_tiles(tiles: DataFrame, magnification: int) -> DataFrame:
    """Tiles through the adapter of a magnification, in Arrow batches."""
    fn, schema = ADAPTERS[magnification]
    return tiles.mapInPandas(fn, schema)
