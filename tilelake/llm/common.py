"""Helpers shared by the operators of this folder."""

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilelake.session import base_folder as shared_folder
from tilelake.session import ship


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from the written copy.

    Lost executors lose nothing: the copy is on shared storage.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame, **columns: F.Column) -> DataFrame:
    """df with columns that are computed once a row.

    Spark moves the expression of a projected column to where the column is used, and inside a lambda function that
    is once for each element.  A generator that makes one row of one row keeps it in place.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


#: Bits of the filter of among(); they make 4 MB, whatever the number of rows.
BITS = 1 << 25


def among(df: DataFrame, members: DataFrame, *keys: str) -> DataFrame:
    """df with _may: false for rows whose keys are surely not in members, told by a bitmap of their hashes.

    The bitmap is broadcast, and bounded; a full one lets more rows through, which costs time and changes nothing else.
    """
    slot = F.pmod(F.xxhash64(*keys), F.lit(BITS)) + 1
    bits = members.select(slot.alias("_slot")).groupBy(F.bitmap_bucket_number("_slot").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bits"))
    df = df.withColumn("_bucket", F.bitmap_bucket_number(slot)).withColumn("_bit", F.bitmap_bit_position(slot)).join(F.broadcast(bits), "_bucket", "left")
    byte = "cast(conv(hex(substring(_bits, cast(_bit div 8 as int) + 1, 1)), 16, 10) as int)"
    return df.withColumn("_may", F.expr(f"_bits is not null and shiftright({byte}, cast(_bit % 8 as int)) % 2 = 1")).drop("_bucket", "_bit", "_bits")


def fold(id_col: str, k: int) -> F.Column:
    """crc32 of the id as text, modulo k; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % k


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): one row (v, label) per vertex, label the least vertex of its component.

    Each round every vertex points at its least neighbour, pointers are followed, and the edges are contracted to
    the vertices pointed at; the edge table shrinks quickly and is checkpointed.  Hub vertices are summed by partial
    aggregation, and joins on them can be split by adaptive execution.
    """
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    label = None
    while True:
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(
            edges.select(F.col("b").alias("v"), F.col("a").alias("w"))
        )
        step = both.groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("p"))
        up = step.select(F.col("v").alias("p"), F.col("p").alias("q"))
        step = cut(step.join(up, "p").select("v", F.col("q").alias("p")))
        label = step.select("v", F.col("p").alias("label")) if label is None else cut(
            label.join(step.select(F.col("v").alias("label"), "p"), "label", "left").select(
                "v", F.coalesce("p", "label").alias("label")
            )
        )
        pa = step.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        pb = step.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        edges = cut(
            edges.join(pa, "a").join(pb, "b").where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        )
        if edges.isEmpty():
            return label


# ---- words of UTF-8 text, hashed with numpy -------------------------------------------------------------------

_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_VALUE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64)[_LOWER]
_POWER = np.ones(4096, np.uint64)
_POWER[1:] = np.uint64(0x9E3779B97F4A7C15)
_POWER = np.multiply.accumulate(_POWER)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (an xor-shift and multiply finaliser)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA24BAED4963EE407)
    h ^= h >> np.uint64(32)
    return h


def text_buffer(array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string array and the n + 1 offsets of its rows; null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = pc.fill_null(array, "").cast(pa.large_string())
    _, off, data = array.buffers()
    off = np.frombuffer(off, np.int64)[array.offset:array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    lo, hi = int(off[0]), int(off[-1])
    raw = np.frombuffer(data, np.uint8)[lo:hi] if data is not None and hi > lo else np.zeros(0, np.uint8)
    return raw, off - lo


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of every row (lower-cased A-Z, split at white space) and each word's row.

    Hashes of 64 bits stand for words: with 10 million distinct words two coincide with probability 3e-6.
    """
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = ~_SEP[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    start = np.flatnonzero(first)
    at = np.flatnonzero(word)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ordinal = np.cumsum(first)[at] - 1
    place = at - start[ordinal]
    value = _VALUE[raw[at]]
    value *= _POWER[place & 4095] + (place >> 12).astype(np.uint64)
    h = mix(np.add.reduceat(value, np.flatnonzero(first[at])))
    return h, np.searchsorted(off, start, "right") - 1


def slices(off: np.ndarray, limit: int = 2_000_000):
    """Row ranges of at most limit bytes (or one row)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
