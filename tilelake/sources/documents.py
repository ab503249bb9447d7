"""JSON documents: values that JSON can hold, and documents merged from updates at any depth."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K

from tilelake.session import cut

AS_TEXT = (K.DateType, K.TimestampType, K.TimestampNTZType, K.DayTimeIntervalType, K.YearMonthIntervalType, K.CalendarIntervalType)


def _odd(kind: K.DataType) -> bool:
    """Whether a value of the type can hold something that JSON can't."""
    if isinstance(kind, K.StructType):
        return any(_odd(f.dataType) for f in kind)
    if isinstance(kind, K.ArrayType):
        return _odd(kind.elementType)
    return _odd(kind.valueType) or _odd(kind.keyType) if isinstance(kind, K.MapType) else isinstance(kind, (K.DoubleType, K.FloatType, K.BinaryType, *AS_TEXT))


def _safe(c: Column, kind: K.DataType) -> Column:
    if not _odd(kind):
        return c
    if isinstance(kind, K.StructType):
        return F.when(c.isNotNull(), F.struct(*(_safe(c.getField(f.name), f.dataType).alias(f.name) for f in kind)))
    if isinstance(kind, K.ArrayType):
        return F.transform(c, lambda x: _safe(x, kind.elementType))
    if isinstance(kind, K.MapType):
        # keys become text, as they are in JSON
        pairs = F.transform(F.map_entries(c), lambda e: F.struct(e["key"].cast("string").alias("key"), _safe(e["value"], kind.valueType).alias("value")))
        return F.map_from_entries(pairs)
    if isinstance(kind, (K.DoubleType, K.FloatType)):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    return F.base64(c) if isinstance(kind, K.BinaryType) else c.cast("string")


def json_safe(df: DataFrame) -> DataFrame:
    """Columns that JSON can hold: NaN and infinities become null, dates, binaries and intervals text, inside structs, arrays and maps too.

    One expression a column, made from its type; columns that are safe already stay as they are.
    """
    return df.select(*(_safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema))


def _nodes(updates: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """(keys, seq, path, kind, text) of everything in the updates: objects (o), lists (l) and other values (s); and the greatest depth."""
    spark = updates.sparkSession
    level = updates.select(*keys, "seq", F.array().cast("array<string>").alias("path"), F.try_parse_json("json").alias("v"))
    out, depth = None, 0
    while True:
        first = F.substring("text", 1, 1)  # of a value's own JSON
        rows = cut(level.select(*keys, "seq", "path", F.to_json("v").alias("text"))).withColumn("kind", F.when(first == "{", "o").when(first == "[", "l").otherwise("s"))
        if depth == 0:
            rows = rows.where("kind = 'o' and text is not null")  # an update is an object
        out = rows if out is None else out.unionByName(rows)
        objects = rows.where("kind = 'o'")
        if objects.where("text <> '{}'").isEmpty():
            return out, depth
        named = ", ".join(f"t.`{k}`" for k in keys)
        level = spark.sql(f"select {named}, t.seq, array_append(t.path, e.key) as path, e.value as v from {{t}} t, lateral variant_explode(parse_json(t.text)) e", t=objects)
        depth += 1


def merge_documents(updates: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, json): all updates (keys, seq, json) of each document merged in order of seq, at any depth.

    Objects merge key by key, lists are appended, anything else is replaced by what comes later; and so is a value by one of another
    kind (an object by a number, a list by an object), with all that was in it.  Equal seq: in order of the text.  Updates that are not JSON objects
    are left out; a document of only such ones is not there.

    No document is folded update by update: a path's last kind and the last seq at which it, or a path above it, was of another kind say
    what of it still counts, and both are aggregates.

    Joins are by merging: paths repeat, so a table's files are a small part of what its rows take in memory, and by their size Spark would
    send tables of millions of rows through the driver.
    """
    rows, depth = _nodes(updates, keys)
    node = [*keys, "path"]
    ordered = F.struct("seq", "text")
    last = lambda k: F.max(F.when(F.col("kind") == k, F.col("seq")))
    kinds = cut(rows.groupBy(*node).agg(F.max_by("kind", ordered).alias("last"), *(last(k).alias(k) for k in "ols")).select(
        *node, "last", F.greatest(*(F.when(F.col("last") != k, F.col(k)) for k in "ols")).alias("other")))
    # what lies at or below a path of another kind before is gone
    above = kinds.select(*node, F.explode(F.transform(F.sequence(F.lit(0), F.size("path")), lambda n: F.slice("path", F.lit(1), n))).alias("up"))
    bounds = above.join(kinds.where("other is not null").select(*keys, F.col("path").alias("up"), "other").hint("merge"), [*keys, "up"]).groupBy(*node).agg(F.max("other").alias("bound"))
    live = rows.join(bounds.hint("merge"), node, "left").where("bound is null or seq > bound")
    inner = F.expr("substring(text, 2, length(text) - 2)")
    lists = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("kind") == "l") & (F.col("text") != "[]"), F.struct("seq", inner.alias("text"))))), lambda x: x["text"]), ","), F.lit("]"))
    merged = live.groupBy(*node).agg(F.max_by("kind", ordered).alias("kind"), F.max_by(F.when(F.col("kind") == "s", F.coalesce("text", F.lit("null"))), ordered).alias("value"), lists.alias("list"))
    merged = cut(merged.select(*node, "kind", F.when(F.col("kind") == "l", F.col("list")).otherwise(F.col("value")).alias("text")))
    name = F.expr("regexp_replace(to_json(array(element_at(path, -1))), '^.|.$', '')")
    body, level = None, None
    for d in range(depth, -1, -1):  # from the deepest objects up
        level = merged.where(F.size("path") == d)
        level = level.withColumn("body", F.lit("")) if body is None else level.join(body.hint("merge"), node, "left")
        level = level.withColumn("text", F.when(F.col("kind") == "o", F.concat(F.lit("{"), F.coalesce("body", F.lit("")), F.lit("}"))).otherwise(F.col("text")))
        if d:
            pair = F.concat(name, F.lit(":"), "text")
            body = level.select(*keys, F.slice("path", F.lit(1), F.lit(d - 1)).alias("path"), pair.alias("p")).groupBy(*node).agg(F.array_join(F.array_sort(F.collect_list("p")), ",").alias("body"))
    return level.select(*keys, F.col("text").alias("json"))
