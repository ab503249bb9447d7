"""Product codes of vectors in integer arithmetic, with exact early elimination in the Walsh-Hadamard domain.

Vectors become integers, floor(scale * x), and are cut into PARTS equal consecutive parts.  Each part position has a codebook of at most
ENTRIES entries, learned in ROUNDS of assigning every part to its nearest entry and replacing each entry by the componentwise floor
of its parts' mean.  All of it is exact: results don't depend on how rows are spread.

Nearest entry.  A part and all entries, padded with zeros to a power of two P, go through the integer Walsh-Hadamard transform H
(additions only).  H keeps distances up to a factor, |Ha - Hb|^2 = P |a - b|^2, and gathers what is smooth in the first
coefficients in order of sequency (number of sign changes).  So the squared differences of coefficients are added in that order; every partial sum
is a lower bound of P times the distance, and an entry goes as soon as its sum exceeds the whole sum of the entry that the
first coefficients favour.  Of those that are left at the end the least wins, ties to the lower index.

Spark.  Each round is one pass over the rows; a task sends one sum for each part, entry and position, and the driver gets these
summed up: at most PARTS x ENTRIES x length rows, whatever the number of vectors.  Rows are never shuffled by value, so a vector
that a third of all rows hold is no burden.  Sums travel in limbs of 32 bits, so none can overflow.

Cases.  A vector that is null or holds null or non-finite components is dropped.  Shorter vectors are filled with zeros up to the longest
one, and all up to a multiple of PARTS (an empty vector is all zeros; if all are empty, parts have one component).  The first entries
are those of the smallest distinct ids, of rows that share an id the least vector; null ids come last.  Fewer ids, fewer entries.
Repeated rows count each and get equal codes.  Integers too large for 64-bit sums of squares take Python's; an error beyond 2^63 - 1
is given as that number.  Labels that are null belong together.  An empty table gives no rows.  Other columns are not read.
"""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
MOST = 2**63 - 1


def hadamard(x: np.ndarray) -> np.ndarray:
    """Integer Walsh-Hadamard transform along the last axis, coefficients in order of sequency."""
    size, out = x.shape[-1], x.copy()
    step = 1
    while step < size:
        v = out.reshape(*x.shape[:-1], size // (2 * step), 2, step)
        out = np.stack([v[..., 0, :] + v[..., 1, :], v[..., 0, :] - v[..., 1, :]], -2).reshape(x.shape)
        step *= 2
    return out[..., sequency(size)]


def sequency(size: int) -> np.ndarray:
    """Rows of the Hadamard matrix of natural order by their number of sign changes."""
    i = np.arange(size)
    sign = np.array([[bin(a & b).count("1") & 1 for b in i] for a in i])
    return np.argsort((sign[:, 1:] != sign[:, :-1]).sum(1), kind="stable")


def padded(x: np.ndarray) -> np.ndarray:
    size = 1 << max(0, x.shape[-1] - 1).bit_length()
    return np.concatenate([x, np.zeros((*x.shape[:-1], size - x.shape[-1]), x.dtype)], -1)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest of entries (m, p) for each of parts (n, p), and its squared distance; both exact."""
    bound = max((abs(int(f())) for a in (parts, entries) if a.size for f in (a.min, a.max)), default=0)
    size = 1 << max(0, parts.shape[-1] - 1).bit_length()
    kind = np.int64 if 4 * size * size * bound * bound <= MOST else object
    t, e = hadamard(padded(parts.astype(kind))), hadamard(padded(entries.astype(kind)))
    lead = min(2, size)
    acc = np.zeros((len(t), len(e)), kind)
    for k in range(lead):
        d = t[:, k, None] - e[None, :, k]
        acc += d * d
    guess = acc.argmin(1)
    d = t - e[guess]
    best = (d * d).sum(1)
    row, col = np.nonzero(acc <= best[:, None])  # the guess itself always stays
    acc = acc[row, col]
    for k in range(lead, size):
        d = t[row, k] - e[col, k]
        acc = acc + d * d
        stay = acc <= best[row]
        row, col, acc = row[stay], col[stay], acc[stay]
    index, least = np.full(len(t), -1), best
    for r in np.unique(col)[::-1]:  # from the highest index down: an equal one further down wins
        own = col == r
        at, sums = row[own], acc[own]
        better = sums <= least[at]
        index[at[better]], least[at[better]] = r, sums[better]
    return index, least // size


def _integers(column, length: int, scale: int):
    """(n, length) integers of an Arrow list column, short vectors filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.array(pc.list_value_length(column).to_numpy(zero_copy_only=False), np.int64)
    flat = np.asarray(pc.list_flatten(column).to_numpy(zero_copy_only=False), np.float64)
    if len(flat) and np.abs(flat).max() * scale >= 2.0**62:
        out, flat = np.zeros((len(n), length), object), np.array([math.floor(Fraction(v) * scale) for v in flat], object)
    else:
        out, flat = np.zeros((len(n), length), np.int64), np.floor(flat * scale).astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _coded(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, parts) and squared distances (n, parts)."""
    parts = x.reshape(len(x), len(books), -1)
    found = [nearest(parts[:, j], books[j]) for j in range(len(books))]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _limbs(value: int) -> list[int]:
    """value as a sum of limbs times powers of 2^32; the last is signed."""
    out = []
    while not -2**31 <= value < 2**31:
        out.append(value & 0xFFFFFFFF)
        value >>= 32
    return [*out, value]


def kept(vectors: DataFrame, column: str) -> DataFrame:
    odd = f"exists(`{column}`, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    return vectors.where(f"`{column}` is not null and not {odd}")


def _least(n: int):
    """The n least ids of a task (nulls last), each once."""

    def run(batches):
        ids, kind = set(), None
        for b in batches:
            kind = b.schema
            ids = set(sorted(ids | set(pc.unique(b.column(0)).to_pylist()), key=lambda i: (i is None, i or 0))[:n])
        if kind:
            yield pa.RecordBatch.from_arrays([pa.array(list(ids), kind.field(0).type)], schema=kind)

    return run


def learn(vectors: DataFrame, id_col: str, column: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray | None:
    """Codebooks (part, entry, position) as integers; None where no vector is kept."""
    vectors = kept(vectors, column).select(F.col(id_col).alias("id"), F.col(column).cast("array<double>").alias("v"))
    longest = vectors.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return None
    length = max(parts, -(-longest // parts) * parts)
    order = F.col("id").asc_nulls_last()
    ids = vectors.select("id").mapInArrow(_least(entries), vectors.select("id").schema).distinct().orderBy(order).limit(entries)
    own = vectors.join(F.broadcast(ids.withColumnRenamed("id", "_i")), F.col("id").eqNullSafe(F.col("_i")))  # at most ENTRIES ids
    first = own.groupBy("id").agg(F.min("v").alias("v")).orderBy(order).collect()
    books = np.array([[math.floor(Fraction(x) * scale) for x in r["v"]] + [0] * (length - len(r["v"])) for r in first], object)
    books = np.stack(np.split(books, parts, 1))
    books = books if max(abs(v) for v in books.flat) >= 2**62 else books.astype(np.int64)
    for _ in range(rounds):
        now = books

        def sums(batches):
            for b in batches:
                x = _integers(b.column(0), length, scale)
                if not len(x):
                    continue
                code, _ = _coded(x, now)
                cut_up = x.reshape(len(x), parts, -1)
                out = []
                for j in range(parts):
                    for e in np.unique(code[:, j]):
                        own = cut_up[code[:, j] == e, j]
                        total = [int(v) for v in own.sum(0)] if own.dtype == object or np.abs(own).max() < 2**62 // len(own) else [sum(map(int, c)) for c in own.T]
                        out += [(j, int(e), k, i, limb, len(own)) for k, v in enumerate(total) for i, limb in enumerate(_limbs(v))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["part", "entry", "pos", "limb", "value", "n"])

        found = vectors.select("v").mapInArrow(sums, "part long, entry long, pos long, limb long, value long, n long")
        found = found.groupBy("part", "entry", "pos", "limb").agg(F.sum("value").alias("value"), F.sum("n").alias("n")).collect()
        total, count = {}, {}
        for r in found:
            at = (r["part"], r["entry"], r["pos"])
            total[at] = total.get(at, 0) + (r["value"] << (32 * r["limb"]))
            if r["limb"] == 0:  # every sum has one
                count[at] = r["n"]
        books = books.astype(object)
        for at, v in total.items():
            books[at] = v // count[at]
        books = books if max(abs(v) for v in books.flat) >= 2**62 else books.astype(np.int64)
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in books.flat).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every kept vector."""
    ship(vectors.sparkSession)
    books = learn(vectors, id_col, column, parts, entries, rounds, scale)
    own = kept(vectors, column).select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), F.col(column).cast("array<double>").alias("_v"))
    length = parts if books is None else parts * books.shape[2]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema if f.name != "_v") + ", _code string, _error long"

    def run(batches):
        for b in batches:
            x = _integers(b.column(2), length, scale)
            code, error = _coded(x, books) if len(x) else (np.zeros((0, parts), int), np.zeros((0, parts), int))
            hexes = ["".join(f"{c:02x}" for c in row) for row in code]
            total = [min(sum(map(int, row)), MOST) for row in error]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hexes, pa.string()), pa.array(total, pa.int64())], ["_id", "_label", "_code", "_error"])

    coded = own.mapInArrow(run, schema)
    by_label = coded.groupBy("_label").agg(F.least(F.sum(F.col("_error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long").alias("_sum"))
    # a label can hold a third of all rows, so they aren't shuffled: its few sums go to them, or, where there are many labels, Spark joins by label
    out = coded.join(by_label.withColumnRenamed("_label", "_l"), F.col("_label").eqNullSafe(F.col("_l")))
    return out.select(F.col("_id").cast("long").alias(id_col), F.col("_code").alias("code"), F.col("_error").alias("error"), F.col("_sum").alias("label_error"), F.lit(digest(books) if books is not None else None).cast("string").alias("codebooks_sha256"))


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """compress() in DuckDB's SQL, rounds unrolled, by plain distances."""
    steps = [f"""x as materialized (select vec_id, label, embedding, list_transform(embedding, lambda v: floor({scale} * v::double)::bigint) as ints from embeddings
          where embedding is not null and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0),
        wide as materialized (select (greatest(1, max(ceil(len(ints) / {float(parts)})))::int) as p from x),
        u as materialized (select row_number() over () as r, vec_id, label, list_resize(ints, {parts} * p, 0::bigint) as ints, p from x, wide),
        q as materialized (select r, j, ints[j * p + 1:j * p + p] as v from u, range({parts}) t(j)),
        first as (select ints, p, row_number() over (order by vec_id nulls last) - 1 as e from (select vec_id, p, arg_min(ints, embedding) as ints from u join (select vec_id as i, min(embedding) as embedding from x group by 1) m on u.vec_id is not distinct from m.i group by 1, 2)
          qualify e < {entries}),
        b0 as materialized (select j, e, ints[j * p + 1:j * p + p] as v from first, range({parts}) t(j))"""]
    near = lambda k: f"""select q.r, q.j, q.v, min(struct_pack(d := list_sum(list_transform(list_zip(q.v, b.v), lambda z: ((z[1] - z[2])::hugeint) * (z[1] - z[2]))), e := b.e)) as m from q join b{k} b on q.j = b.j group by all"""
    for k in range(rounds):
        steps.append(f"""a{k} as materialized ({near(k)}),
        s{k} as (select j, m.e as e, i, floor_div(sum(v[i]), count(*)) as c from a{k}, wide, range(1, p + 1) t(i) group by 1, 2, 3),
        g{k} as (select j, e, list(c order by i) as v from s{k} group by 1, 2),
        b{k + 1} as materialized (select o.j, o.e, coalesce(g.v, o.v) as v from b{k} o left join g{k} g on o.j = g.j and o.e = g.e)""".replace(
            f"floor_div(sum(v[i]), count(*))", "((sum(v[i]) - (((sum(v[i]) % count(*)) + count(*)) % count(*))) // count(*))::bigint"))
    return f"""with {', '.join(steps)}, z as ({near(rounds)}), t as (select r, string_agg(printf('%02x', m.e), '' order by j) as code, sum(m.d)::bigint as error from z group by 1),
        h as (select sha256(string_agg(array_to_string(v, ','), ',' order by j, e)) as codebooks_sha256 from b{rounds})
        select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from t join u using (r), h"""
