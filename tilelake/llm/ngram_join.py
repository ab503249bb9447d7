"""Similarity self-join of documents on the Jaccard similarity of their sets of five-word shingles.

1. Documents with equal text are one text.  Every text gets HASHES min-hashes of its shingles; `bands_for` chooses the
   number of rows a band has, the largest whose recall at the threshold reaches the target.
2. Texts are shuffled on band hashes (narrow rows).  Within a bucket, one-byte sketches of the min-hashes drop pairs
   far below the threshold; what a task emits is a spanning tree of its similar texts, never its pairs.  Buckets of
   many texts are dealt to several tasks as pairs of blocks.
3. The trees' components hold all texts that can be similar.  Within a component, every pair is verified on its full
   shingle sets, in pairs of blocks of BLOCK texts, by a product of the blocks' shingle matrices; each task returns, for
   each text, the number of documents linked to it, and a spanning tree of the links.
4. Classes are the components of the verified links.

Words are split at white space and lower-cased (A-Z).  A text of one to four words has one shingle, all its words.
Null text is empty; empty texts are equal texts.  A text is named by a 64-bit hash of its MD5; ids are attributes of
texts only.  Rows sharing a doc_id count as one document, linked where any of its texts is; every row with a null id is
a document of its own.  class_id is the least id of the class that is not null; it is null where a class has no other.
Repeated rows have one class and count each as a document only where their id is null; ties of ids do not matter, as texts are the
vertices.  Other columns are not read by join() and stay, whatever their names, in representatives().  An empty table gives
no rows.  Texts are read whole, in slices of about 2 MB or one longer text; a text's shingle set is one value.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, components, cut, mix, slices, text_buffer, word_hashes

WORDS, THRESHOLD, RECALL, HASHES = 5, 0.8, 0.995, 256
BLOCK = 256
#: A sketch of 256 hashes estimates the similarity with a standard deviation of 0.025 at 0.8.
MARGIN = 0.13
_A = np.random.default_rng(7).integers(1, 2**32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = np.random.default_rng(8).integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)


def bands_for(threshold: float, recall: float, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which a pair at the threshold meets with the target probability."""
    good = [r for r in range(1, hashes + 1) if 1 - (1 - threshold**r) ** (hashes // r) >= recall]
    rows = max(good, default=1)
    return hashes // rows, rows


def _shingles(raw, off, words):
    """Shingle hashes of every row, in order (repeats included), and the number of shingles of each row."""
    h, row = word_hashes(raw, off)
    n = np.bincount(row, minlength=len(off) - 1)
    if not len(h):
        return h, n
    acc = h.copy()
    at = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)  # place in the row
    left = n[row] - at
    for k in range(1, words):
        nxt = np.zeros_like(h)
        nxt[:-k or None] = h[k:]
        acc = np.where(left > k, mix(acc * np.uint64(3) + nxt), acc)
    whole = (left >= words) | (at == 0)
    return acc[whole], np.where(n > 0, np.maximum(n - words + 1, 1), 0)


def sketches(docs: DataFrame, bands: int, rows: int, words: int = WORDS) -> DataFrame:
    """(_d, rep, bands, sketch): rep names the text; bands and sketch are null for texts without words."""

    def run(batches):
        for batch in batches:
            raw, off = text_buffer(batch.column(2))
            for lo, hi in slices(off):
                s, n = _shingles(raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], words)
                has = n > 0
                out = np.zeros((int(has.sum()), HASHES), np.uint32)
                if has.any():
                    start = (np.cumsum(n) - n)[has]
                    x = (mix(s) >> np.uint64(16)).astype(np.uint32)
                    for k in range(HASHES):
                        y = (x ^ _B[k]) * _A[k]
                        y ^= y >> np.uint32(15)
                        out[:, k] = np.minimum.reduceat(y, start)
                mine = out[:, :bands * rows].reshape(len(out), bands, rows).astype(np.uint64)
                b = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(out), bands)).copy()
                for r in range(rows):
                    b = mix(b * np.uint64(5) + mine[:, :, r])
                byte = ((out * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
                at = np.cumsum(has) - 1
                pick = pa.array(at, pa.int64(), mask=~has)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * bands, pa.int32()), pa.array(b.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], batch.column(1)[lo:hi], lists.take(pick), pa.array([r.tobytes() for r in byte], pa.binary()).take(pick)],
                    ["_d", "rep", "bands", "sketch"])

    return _source(docs).mapInArrow(run, "_d long, rep long, bands array<long>, sketch binary")


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("_d"), text_name("text").alias("rep"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def text_name(text: str) -> F.Column:
    """64 bits that stand for a text: with 10 million distinct texts two coincide with probability 3e-6."""
    return F.xxhash64(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))


def _blocks(members: DataFrame, key: str, n: str, by: str, size: int) -> DataFrame:
    """Deal the members of a key to pairs of blocks: columns i, j (i <= j) and mine (the block of the row)."""
    m = members.withColumn("_m", F.ceil(F.col(n) / size).cast("int")).withColumn("mine", F.pmod(F.xxhash64(by), F.col("_m")).cast("int"))
    other = F.explode(F.expr("sequence(0, _m - 1)")).alias("_o")
    return m.select("*", other).withColumn("i", F.least("mine", "_o")).withColumn("j", F.greatest("mine", "_o")).drop("_m", "_o")


def _trees(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Label (least member) of each of n vertices under edges a, b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _groups(batches, keys):
    """Consecutive rows with equal key columns, over a stream sorted by them."""
    held: list = []
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        k = np.stack([np.asarray(t.column(c)) for c in keys], 1)
        edge = np.r_[0, np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1, len(k)]
        for lo, hi in zip(edge, edge[1:]):
            part = t.slice(lo, hi - lo)
            if held and held[0] != tuple(k[lo]):
                yield pa.concat_tables(held[1])
                held = []
            if held:
                held[1].append(part)
            else:
                held = [tuple(k[lo]), [part]]
    if held:
        yield pa.concat_tables(held[1])


def _similar(threshold: float):
    """Within pairs of blocks of a bucket: edges of a spanning tree of the texts whose sketches are near enough."""
    need = np.ceil(HASHES * (threshold - MARGIN)).astype(int)

    def run(batches):
        a_out, b_out, total = [], [], 0
        for t in _groups(batches, ["bucket", "i", "j"]):
            ids = np.asarray(t.column("rep"))
            sk = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, HASHES)
            if len(ids) == 2:
                if (sk[0] == sk[1]).sum() >= need:
                    a_out.append(ids[:1])
                    b_out.append(ids[1:])
            else:
                ea, eb = [], []
                for k in range(len(ids) - 1):
                    hit = np.flatnonzero((sk[k + 1:] == sk[k]).sum(1) >= need)
                    ea.append(np.full(len(hit), k))
                    eb.append(hit + k + 1)
                label = _trees(len(ids), np.concatenate(ea), np.concatenate(eb))
                on = np.flatnonzero(label != np.arange(len(ids)))
                a_out.append(ids[label[on]])
                b_out.append(ids[on])
            total += 1
            if total % 2000 == 0:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (a_out, b_out)], ["a", "b"])
                a_out, b_out = [], []
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (a_out, b_out)], ["a", "b"])

    return run


def _verify(threshold: float):
    """Within pairs of blocks of a component: links of each text over the pairs that the task owns.

    Rows with `other` are single links, given only where one of the texts has a document of several texts.
    """

    def run(batches):
        out: list = []
        for t in _groups(batches, ["comp", "i", "j"]):
            ids, mine, weight = (np.asarray(t.column(c)) for c in ("rep", "mine", "n"))
            sets = [np.frombuffer(b, np.uint64) for b in t.column("shingles").to_pylist()]
            size = np.array([len(s) for s in sets])
            u, inv, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            row = np.repeat(np.arange(len(ids)), size)
            shared = many[inv] > 1
            col = (np.cumsum(many > 1) - 1)[inv[shared]]
            row = row[shared]
            both = np.zeros((len(ids), len(ids)), np.float32)
            order = np.argsort(col, kind="stable")
            col, row = col[order], row[order]
            for lo in range(0, int(col[-1]) + 1 if len(col) else 0, 8192):  # the matrices take some columns at a time
                a, b = np.searchsorted(col, [lo, lo + 8192])
                m = np.zeros((len(ids), 8192), np.float32)
                m[row[a:b], col[a:b] - lo] = 1
                both += m @ m.T
            link = both >= threshold * (size[:, None] + size[None] - both) - 1e-6
            np.fill_diagonal(link, False)
            i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
            if i != j:
                link &= mine[:, None] != mine[None]  # pairs inside one block belong to that block's own task
            label = _trees(len(ids), *np.nonzero(np.triu(link)))
            out.append((ids, link @ weight, ids[label], None))
            several = np.asarray(t.column("several").to_numpy(), bool)
            if several.any():
                x, y = np.nonzero(link & (several[:, None] | several[None]))
                out.append((ids[x], np.zeros(len(x)), ids[x], ids[y]))
            if len(out) >= 500:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    return run


def _rows(out):
    other = pa.chunked_array([pa.nulls(len(o[0]), pa.int64()) if o[3] is None else pa.array(o[3], pa.int64()) for o in out]).combine_chunks()
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out]).astype(np.int64)) for k in range(3)] + [other], ["rep", "links", "label", "other"])


def of_first(df: DataFrame, first: DataFrame) -> DataFrame:
    """Rows of df (rep, _d) with the row of first (rep, f) of their text, where they have the id that stands for it."""
    other = first.withColumnRenamed("rep", "_rep")
    return df.join(other, (F.col("rep") == F.col("_rep")) & F.col("_d").eqNullSafe(F.col("f._d"))).drop("_rep")


def once(df: DataFrame, repeated: bool) -> DataFrame:
    """df with one of the f.m rows that repeat both id and text; repeated: whether there are any."""
    one = df.where("f.m = 1")
    return one.unionByName(df.where("f.m > 1").dropDuplicates(["rep"])) if repeated else one


def _verified(docs: DataFrame, threshold: float, recall: float, words: int):
    """(_d, rep) of every row; carried (rep, _d) of documents of several texts, None if there are none; texts (rep, n, several):
    the number of documents with that text alone, and whether there are others; and the output of _verify."""
    bands, rows = bands_for(threshold, recall)
    every = cut(sketches(docs, bands, rows, words))
    held = cut(every.groupBy("rep", "_d").agg(F.count("*").alias("m"), F.first(F.col("bands").isNotNull()).alias("words")))
    lone = held.where("_d is not null").groupBy("_d").agg(F.count("*").alias("texts")).where("texts > 1")
    carried = cut(held.join(lone, "_d").select("rep", "_d"))
    carried = None if carried.isEmpty() else carried
    text = held.groupBy("rep").agg(F.sum(F.when(F.col("_d").isNull(), F.col("m")).otherwise(1)).alias("n"))
    if carried is None:
        text = text.withColumn("several", F.lit(False))
    else:
        text = text.join(carried.groupBy("rep").agg(F.count("*").alias("m")), "rep", "left").select(
            "rep", (F.col("n") - F.coalesce("m", F.lit(0))).alias("n"), F.col("m").isNotNull().alias("several"))
    text = cut(text)
    # one row stands for the rows with its text
    first = held.where("words").groupBy("rep").agg(F.min(F.struct(F.col("_d").isNull().alias("z"), "_d", "m")).alias("f"))
    first = cut(first)
    repeated = not first.where("f.m > 1").isEmpty()
    own = of_first(every.where("bands is not null"), first).select("rep", "bands", "sketch", "f")
    reps = cut(once(own, repeated).drop("f"))
    band = reps.select("rep", F.explode("bands").alias("bucket"))
    full = band.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    dealt = _blocks(band.join(full, "bucket").join(reps.select("rep", "sketch"), "rep"), "bucket", "size", "rep", 2 * BLOCK)
    near = dealt.select("bucket", "i", "j", "rep", "sketch").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "rep")
    comp = components(near.mapInArrow(_similar(threshold), "a long, b long"))
    sizes = comp.groupBy("label").agg(F.count("*").alias("size"))
    cand = comp.join(sizes, "label").select(F.col("v").alias("rep"), F.col("label").alias("comp"), "size")
    cand = cut(cand.join(text, "rep").join(first, "rep"))

    def sets(batches):
        for batch in batches:
            raw, off = text_buffer(batch.column(5))
            for lo, hi in slices(off):
                s, n = _shingles(raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], words)
                yield pa.RecordBatch.from_arrays([batch.column(k)[lo:hi] for k in range(5)] + [
                    pa.array([np.unique(x).tobytes() for x in np.split(s, np.cumsum(n)[:-1])], pa.binary())], ["rep", "comp", "size", "n", "several", "shingles"])

    # only the candidates' texts are shuffled, and copies of one text by their ids
    near = among(_source(docs), cand.select("rep", F.col("f._d").alias("_d")), "rep", "_d").where("_may").drop("_may")
    texts = once(of_first(near, cand), repeated).select("rep", "comp", "size", "n", "several", "text")
    shingled = texts.mapInArrow(sets, "rep long, comp long, size long, n long, several boolean, shingles binary")
    pairs = _blocks(shingled, "comp", "size", "rep", BLOCK)
    pairs = pairs.select("comp", "i", "j", "mine", "rep", "n", "several", "shingles").repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "rep")
    return every.select("_d", "rep"), carried, text, cut(pairs.mapInArrow(_verify(threshold), "rep long, links long, label long, other long"))


def _labels(every: DataFrame, edges: DataFrame) -> DataFrame:
    """(_d, rep, label) of every row: label names the class of its text."""
    return every.join(components(edges).withColumnRenamed("v", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, words: int = WORDS) -> DataFrame:
    """One row per row: doc_id, class_id (the least doc_id of its class), n_links (other documents linked to it)."""
    every, carried, text, verified = _verified(docs, threshold, recall, words)
    links = verified.groupBy("rep").agg(F.sum("links").alias("links"))
    count = text.join(links, "rep", "left").select("rep", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    edges = verified.select(F.col("rep").alias("a"), F.col("label").alias("b"))
    if carried is not None:
        edges = edges.unionByName(carried.join(carried.groupBy("_d").agg(F.min("rep").alias("b")), "_d").select(F.col("rep").alias("a"), "b"))
        # pairs of linked or equal texts of which one has a document of several texts
        pair = cut(verified.where("other is not null").select("rep", "other").unionByName(carried.select("rep", F.col("rep").alias("other"))).distinct())
        of_other = carried.withColumnRenamed("rep", "other").withColumnRenamed("_d", "e")
        extra = pair.join(of_other, "other").select("rep", "e").distinct().groupBy("rep").agg(F.count("*").alias("extra"))
        count = count.join(extra, "rep", "left").select("rep", (F.col("n_links") + F.coalesce("extra", F.lit(0))).alias("n_links"))
        reach = cut(carried.join(pair, "rep").select("_d", "other").distinct())
        alone = reach.join(text.select(F.col("rep").alias("other"), "n"), "other").groupBy("_d").agg(F.sum("n").alias("alone"))
        mixed = reach.join(of_other, "other").select("_d", "e").distinct().groupBy("_d").agg(F.count("*").alias("mixed"))
        whole = alone.join(mixed, "_d").select("_d", (F.col("alone") + F.col("mixed") - 1).alias("whole"))
    member = cut(_labels(every, edges))
    label = member.groupBy("label").agg(F.min("_d").alias("class_id"))
    out = member.join(label, "label").join(count, "rep")
    if carried is not None:
        out = out.join(whole, "_d", "left").withColumn("n_links", F.coalesce("whole", "n_links"))
    return out.select(F.col("_d").alias("doc_id"), "class_id", "n_links")


def representatives(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, words: int = WORDS) -> DataFrame:
    """One row of docs, with all columns, for each class of texts: that of the least id, null ids last.

    Texts are not joined by sharing an id here: a text goes only where a text of its class stays.
    """
    every, _, _, verified = _verified(docs, threshold, recall, words)
    member = _labels(every, verified.select(F.col("rep").alias("a"), F.col("label").alias("b")))
    rows = member.groupBy("label", "_d", "rep").agg(F.count("*").alias("m"))
    kept = cut(rows.groupBy("label").agg(F.min(F.struct(F.col("_d").isNull().alias("z"), "_d", "rep", "m")).alias("f")))
    src = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("_d"), text_name("text").alias("rep"))
    found = src.join(kept, F.col("_d").eqNullSafe(F.col("f._d")) & (F.col("rep") == F.col("f.rep")))
    return once(found, not kept.where("f.m > 1").isEmpty()).select("row.*")
