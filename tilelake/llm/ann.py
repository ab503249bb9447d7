"""Nearest neighbours by cosine: inverted lists, and an adaptive scan of dimensions within each probed list.

Vectors are scaled to length one and turned by a random rotation, so that any leading block of columns estimates a
squared distance without bias.  Lists belong to centroids fitted on a bounded sample (SAMPLE rows); every row is put in
its COPIES nearest lists, since many rows lie between lists.  A query probes its PROBES share of the lists, nearest first,
and further ones until they hold 4 k rows besides those that may share its id.  In a list, after a head of a few
candidates, candidates are scanned in blocks of COLUMNS columns: after each block a hypothesis test compares the scaled
partial distance with the query's k-th best so far, and abandons the candidate if a smaller true distance is implausible.
The lists nearest to a query are scanned first; the k-th best that they give is carried to its other lists.  Survivors
are scored exactly, in double precision on the original vectors.

Rows of a list are dealt to blocks of bounded size, candidates and queries alike, so a list that holds a third of all
rows is many tasks.  Of identical vectors in a block only the k + 1 with the smallest ids can be among anyone's k
nearest, so only those are compared.  Vectors that are null, zero, or hold null or non-finite parts take no part, nor
do vectors whose number of dimensions is not the commonest, nor rows with a null id.  Of rows with one id each is a row of
its own, as query and as candidate, and a query never finds its own id.  Ties of score go to the smaller id.  Other
columns are not read, so their names do not matter.  Empty tables give empty results.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut
from .ngram_join import _groups

SAMPLE, PROBES, COPIES, COLUMNS, EPSILON = 20_000, 0.25, 3, 16, 2.1
#: The share of the probed lists that is scanned before the others.
FIRST = 0.2
CANDIDATES, QUERIES = 4096, 512


def _centroids(x: np.ndarray, n: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(11)
    c = x[rng.choice(len(x), min(n, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        empty = np.bincount(near, minlength=len(c)) == 0
        total[empty] = x[rng.integers(0, len(x), empty.sum())]
        c = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
    return c


def usable(df: DataFrame, vec_col: str) -> DataFrame:
    """Rows whose vectors take part, as array<double>."""
    v = F.col(vec_col).cast("array<double>")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(fine).withColumn(vec_col, v)


def _adaptive(q: np.ndarray, c: np.ndarray, k: int, carried: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) that the scan does not abandon; rows of unit length, rotated; carried: distances known to be enough."""
    dims = q.shape[1]
    head = min(len(c), 2 * k)
    d = 2 - 2 * (q @ c[:head].T)
    best = np.partition(d, k - 1, 1)[:, :k] if head >= k else np.c_[d, np.full((len(q), k - head), np.inf)]
    rows, cols = [np.repeat(np.arange(len(q)), head)], [np.tile(np.arange(head), len(q))]
    dist = [d.reshape(-1)]
    for lo in range(head, len(c), 1024):
        part = c[lo:lo + 1024]
        tau = np.minimum(best.max(1), carried)
        i = j = None
        acc = None
        for a in range(0, dims, COLUMNS):
            z = min(a + COLUMNS, dims)
            if i is None:
                full = (q[:, a:z] ** 2).sum(1)[:, None] + (part[:, a:z] ** 2).sum(1)[None] - 2 * (q[:, a:z] @ part[:, a:z].T)
                acc_all = full
                i, j = np.nonzero(acc_all * (dims / z) <= tau[:, None] * (1 + EPSILON / np.sqrt(z)) ** 2 if z < dims else acc_all <= tau[:, None] + 1e-5)
                acc = acc_all[i, j]
            else:
                acc = acc + ((q[i, a:z] - part[j, a:z]) ** 2).sum(1)
                keep = acc * (dims / z) <= tau[i] * (1 + EPSILON / np.sqrt(z)) ** 2 if z < dims else acc <= tau[i] + 1e-5
                i, j, acc = i[keep], j[keep], acc[keep]
        rows.append(i)
        cols.append(j + lo)
        dist.append(acc)
        if len(i):  # the k best of each query so far
            order = np.lexsort((acc, i))
            i, acc = i[order], acc[order]
            first = np.searchsorted(i, np.arange(len(q)))
            place = np.arange(len(i)) - first[i]
            add = np.full((len(q), k), np.inf)
            on = place < k
            add[i[on], place[on]] = acc[on]
            best = np.partition(np.concatenate([best, add], 1), k - 1, 1)[:, :k]
    rows, cols, dist = (np.concatenate(x) for x in (rows, cols, dist))
    keep = dist <= np.minimum(best.max(1), carried)[rows] + 1e-5
    return rows[keep], cols[keep]


def search(df: DataFrame, id_col: str, vec_col: str, is_query: F.Column, k: int = 5, probes: float = PROBES, lists: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query row, ties to the smaller vec_id."""
    spark = df.sparkSession
    rows = usable(df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), is_query.alias("q")), "v")
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, n = sizes
    rows = rows.where(F.size("v") == dims)
    sample = rows.select("v").orderBy(F.xxhash64("id", "v")).limit(SAMPLE).collect()
    x = np.array([r["v"] for r in sample])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn = np.linalg.qr(np.random.default_rng(12).normal(size=(dims, dims)))[0]
    lists = lists or int(min(2048, max(1, round(n**0.5))))
    centres = spark.sparkContext.broadcast(_centroids(x, lists))
    probed = max(1, round(len(centres.value) * probes))
    copies = min(COPIES, len(centres.value))

    import pyarrow.compute  # noqa: F401

    def nearness(column):
        v = np.asarray(pa.compute.list_flatten(column), float).reshape(-1, dims)
        return v, (v / np.linalg.norm(v, axis=1, keepdims=True)) @ centres.value.T

    def nearest(batches):
        for b in batches:
            own = np.argsort(-nearness(b.column(0))[1], 1, kind="stable")[:, :copies]
            yield pa.RecordBatch.from_arrays([pa.array(own.reshape(-1))], ["list"])

    # one row for each list: at most 2048
    sizes = np.zeros(len(centres.value), np.int64)
    for r in rows.select("v").mapInArrow(nearest, "list long").groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    need = copies * (4 * k + rows.groupBy("id").count().agg(F.max("count")).first()[0])

    def assign(batches):
        for b in batches:
            v, near = nearness(b.column(1))
            asks = np.asarray(b.column(2).fill_null(False).to_numpy(zero_copy_only=False), bool)
            order = np.argsort(-near, 1, kind="stable")
            held = sizes[order[asks]]
            use = (np.arange(order.shape[1]) < probed) | (held.cumsum(1) - held < need)
            raw = pa.array([r.tobytes() for r in v], pa.binary())
            at = pa.array(np.r_[np.repeat(np.arange(len(v)), copies), np.repeat(np.flatnonzero(asks), use.sum(1))])
            mine = len(v) * copies
            yield pa.RecordBatch.from_arrays(
                [b.column(3).take(at), b.column(0).take(at), raw.take(at), pa.array(np.r_[order[:, :copies].reshape(-1), order[asks][use]]),
                 pa.array(np.arange(len(at)) >= mine), pa.array(np.r_[np.zeros(mine, int), np.nonzero(use)[1]].astype(np.int32))], ["row", "id", "v", "list", "q", "place"])

    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    dealt = cut(numbered.mapInArrow(assign, "row long, id long, v binary, list long, q boolean, place int"))

    def blocks(part: DataFrame) -> DataFrame:
        """Rows of part (with `bound`) in every pair of a block of candidates and a block of queries of a list."""
        # one row for each list: at most 2048
        load = part.groupBy("list").agg(F.ceil(F.sum(F.when(~F.col("q"), 1).otherwise(0)) / CANDIDATES).cast("int").alias("nc"),
                                        F.ceil(F.sum(F.when(F.col("q"), 1).otherwise(0)) / QUERIES).cast("int").alias("nq"))
        placed = part.join(F.broadcast(load), "list").where("nc > 0 and nq > 0").select(
            "row", "id", "v", "q", "list", "bound", F.pmod(F.xxhash64("id", "v"), F.when(F.col("q"), F.col("nq")).otherwise(F.col("nc"))).cast("int").alias("own"),
            F.explode(F.expr("sequence(0, if(q, nc, nq) - 1)")).alias("other"))
        keyed = placed.select("row", "id", "v", "q", "list", "bound", F.when(F.col("q"), F.col("other")).otherwise(F.col("own")).alias("c"),
                              F.when(F.col("q"), F.col("own")).otherwise(F.col("other")).alias("a"))
        return keyed.repartition("list", "c", "a").sortWithinPartitions("list", "c", "a", "q", "id", "row")

    def scan(batches):
        for t in _groups(batches, ["list", "c", "a"]):
            row, ids, bound = (np.asarray(t.column(c)) for c in ("row", "id", "bound"))
            asks = np.asarray(t.column("q").to_numpy(), bool)
            v = np.frombuffer(b"".join(t.column("v").to_pylist()), float).reshape(-1, dims)
            cand, cid, crow, q, qid, qrow = v[~asks], ids[~asks], row[~asks], v[asks], ids[asks], row[asks]
            if not len(q) or not len(cand):
                continue
            # rows are in order of id: of equal vectors the first k + 1 stay
            order = np.argsort(np.ascontiguousarray(cand).view(f"V{8 * dims}").reshape(-1), kind="stable") if len(cand) > 1 else np.zeros(1, int)
            same = np.r_[False, (cand[order][1:] == cand[order][:-1]).all(1)]
            start = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
            keep = np.sort(order[np.arange(len(order)) - start <= k])
            cand, cid, crow = cand[keep], cid[keep], crow[keep]
            norm = lambda m: np.sqrt((m * m).sum(1))
            nq, nc = norm(q), norm(cand)
            i, j = _adaptive((q / nq[:, None]) @ turn, (cand / nc[:, None]) @ turn, k + 1, 2 - 2 * bound[asks])
            score = np.empty(len(i))
            for a in range(0, len(i), 100_000):
                z = slice(a, a + 100_000)
                score[z] = (q[i[z]] * cand[j[z]]).sum(1) / (nq[i[z]] * nc[j[z]])
            other = qid[i] != cid[j]
            i, j, score = i[other], j[other], score[other]
            order = np.lexsort((cid[j], -score, i))
            i, j, score = i[order], j[order], score[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            on = place < k
            i, j = i[on], j[on]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in (qrow[i], qid[i], crow[j], cid[j], score[on])], ["qrow", "query_id", "row", "vec_id", "score"])

    def best(found: DataFrame) -> DataFrame:
        once = found.dropDuplicates(["qrow", "row"])  # a row may be found in several lists
        by = Window.partitionBy("qrow").orderBy(F.desc("score"), "vec_id", "row")
        return once.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)

    shape = "qrow long, query_id long, row long, vec_id long, score double"
    first = max(1, round(probed * FIRST))
    near = dealt.where((~F.col("q")) | (F.col("place") < first)).withColumn("bound", F.lit(float("-inf")))
    found = cut(best(blocks(near).mapInArrow(scan, shape)))
    bound = found.where(F.col("rank") == k).select(F.col("qrow").alias("row"), F.lit(True).alias("q"), F.col("score").alias("bound"))
    far = dealt.where((~F.col("q")) | (F.col("place") >= first)).join(bound, ["row", "q"], "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    more = blocks(far).mapInArrow(scan, shape)
    return best(found.drop("rank").unionByName(more)).select("query_id", "rank", "vec_id", "score")
