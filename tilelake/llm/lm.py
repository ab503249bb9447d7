"""Language-model scores of documents by a weighted backoff automaton over words.

The automaton.  Its states are the histories of the training documents, of none (the root) up to ORDER - 1 words; a
document starts in the history of ORDER - 1 start marks.  With p the probability at the next shorter history h':

    an arc      from h by w:  log10((c(h w) + m p(w | h')) / (c(h) + m)), for every w that follows h in training
    a failure arc from h:     log10(m / (c(h) + m)), to the state of h'
    at the root               log10((c(w) - d) / N) for training words, log10(d V / N) for all others together

m is the history's prior count (PRIORS).  The weights of a state, followed through its failure arcs, sum to one.  No
history and no arc is left out: the automaton grows with the corpus, and so it is never in one place.

The traversal.  Tasks cut the documents into blocks.  A block's distinct n-grams (of each order, as 40-bit fingerprints
within a bucket, with their counts in the block) go to the partitions that own them; those return the counts over all
training documents.  Documents are read a second time for it and meet the counts by block; where docs is more than a
read of files, it is written first, so that both times give the same blocks (which a checksum makes sure of).  These make the part of the automaton that the block can reach, and the block's documents are read
from left to right: the state in which a token finds the automaton is the one that the token before left behind, an arc
is taken if there is one and failure arcs until there is.  Since a state is named by its last words, this is done for
all documents of a block at once, in arrays.  However common an n-gram is, a block sends it once.

Fingerprints.  A bucket holds about STEPS n-grams, so two n-grams of one bucket share a fingerprint with a probability of
2e-6 at any size of the corpus; the counts of such a pair would be added.

Tokens are words of A-Z lower-cased text between white space, and one end token a document.  Null text is empty: its
only token is the end.  Repeated rows, also with equal ids, are scored each; equal texts get equal scores.  A null id
stays null.  Columns other than doc_id and text are not read, so their names do not matter.  A text is read whole;
a task holds one block, of BLOCK_BYTES or of one longer text.  An empty table gives no rows.  Without training documents,
base and score follow the same formulas with N = V = 0: base log10(0.5/0.5) = 0 a token, and score 0.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix, shuffle_width, slices, text_buffer, word_hashes

ORDER = 3
DISCOUNT = 0.75
#: Prior counts m of histories of one word, two words, and so on.
PRIORS = (1000.0, 3.0)
END, START = np.uint64(0x5EED0000000000E1), np.uint64(0x5EED0000000000A5)
#: Training tokens whose n-grams one bucket holds.
STEPS = 1_000_000
BLOCK_BYTES = 4_000_000


def _tokens(raw, off):
    """Word hashes with an end token after each row's words, which of them are the first of a row, and their numbers."""
    h, row = word_hashes(raw, off)
    n = len(off) - 1
    counts = np.bincount(row, minlength=n) + 1
    stop = np.cumsum(counts) - 1
    out = np.empty(len(h) + n, np.uint64)
    is_end = np.zeros(len(out), bool)
    is_end[stop] = True
    out[~is_end], out[is_end] = h, END
    first = np.zeros(len(out), bool)
    first[stop - counts + 1] = True
    return out, first, counts


def _ngrams(h, first, order):
    """Keys of the n-grams that end at each token, for n = 1 to order."""
    keys, before = [mix(h)], h
    for _ in range(order - 1):
        shifted = np.empty_like(before)
        shifted[1:] = before[:-1]
        shifted[first] = START
        before = shifted
        keys.append(mix(keys[-1] * np.uint64(3) + before))
    return keys


def _bucket(keys, buckets):
    """Buckets are ranges of keys, so sorted keys are sorted by bucket."""
    b, low = np.uint64(buckets), np.uint64(0xFFFFFFFF)
    return (((keys >> np.uint64(32)) * b + ((keys & low) * b >> np.uint64(32))) >> np.uint64(32)).astype(np.int64)


def _prints(keys, buckets):
    """40 bits for each key, in the order of the keys within a bucket."""
    return keys * np.uint64(buckets) >> np.uint64(24)


def _steps(prints) -> bytes:
    """Sorted fingerprints as differences, of four bytes where that is enough, the first bytes of all before the second ones."""
    d = np.diff(prints, prepend=np.uint64(0)).astype("<u8")
    width = 4 if d.max(initial=0) < 1 << 32 else 5
    return bytes([width]) + d.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unsteps(data: bytes) -> np.ndarray:
    width = data[0]
    out = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1).T
    return np.cumsum(out.view("<u8").reshape(-1), dtype=np.uint64)


def _small(a) -> bytes:
    """Counts, mostly small: a byte each, and those from 255 on once more at the end."""
    return np.minimum(a, 255).astype(np.uint8).tobytes() + a[a >= 255].astype("<i8").tobytes()


def _unsmall(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<i8", offset=n)
    return out


def _blob(parts: list[bytes]) -> bytes:
    """Byte strings, compressed together."""
    sizes = np.array([len(parts), *map(len, parts)], "<u4").tobytes()
    return sizes + pa.compress(b"".join(parts), codec="zstd", asbytes=True)


def _unblob(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    ends = np.cumsum(np.frombuffer(data, "<u4", n, 4), dtype=np.int64).tolist()
    body = pa.decompress(data[4 * n + 4:], ends[-1], codec="zstd", asbytes=True)
    return [body[a:z] for a, z in zip([0, *ends], ends)]


def vocabulary(docs: DataFrame) -> tuple[int, int]:
    """Number of tokens, and of distinct ones, of all documents; summed in each task before the shuffle."""

    def run(batches):
        held: list = []
        size = 0

        def flush():
            u, inv = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
            n = np.bincount(inv, weights=np.concatenate([x[1] for x in held])).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], ["h", "c"])

        for batch in batches:
            raw, off = text_buffer(batch.column(0))
            for lo, hi in slices(off):
                u, c = np.unique(_tokens(raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])[0], return_counts=True)
                held.append((u, c))
                size += len(u)
                if size > 2_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    words = docs.select(F.col("text").cast("string")).mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    return words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()


_MESSAGE = "bucket long, block long, data binary"


def _blocks(batches):
    """(number of the first row, text bytes, sizes of the texts, ids with a mark for null, held) of stretches of documents."""
    pending: list = []
    size = 0

    def block():
        return pending[0][4], *(np.concatenate([p[k] for p in pending]) for k in range(4))

    for batch in batches:
        raw, off = text_buffer(batch.column(1))
        ids = np.stack([np.asarray(batch.column(0).fill_null(0)), np.asarray(batch.column(0).is_null().cast(pa.int64()))], 1)
        held = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool)
        keys = np.asarray(batch.column(3))
        for lo, hi in slices(off, BLOCK_BYTES // 4):
            if pending and size + off[hi] - off[lo] > BLOCK_BYTES:
                yield block()
                pending, size = [], 0
            pending.append((raw[off[lo]:off[hi]].copy(), np.diff(off[lo:hi + 1]), ids[lo:hi], held[lo:hi], int(keys[lo])))
            size += int(off[hi] - off[lo]) + 64 * (hi - lo)
    if pending:
        yield block()


def _rows(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["bucket", "block", "data"])


def _same(raw) -> bytes:
    return zlib.crc32(raw).to_bytes(4, "little")


def _steady(docs: DataFrame) -> DataFrame:
    """docs if it reads files and no more; else a written copy, as its rows might come in another order the next time."""
    return cut(docs) if "Exchange" in docs._jdf.queryExecution().toString() else docs


def traverse(counts: list, first, starts: int, total: int, distinct: int, discount: float, priors) -> np.ndarray:
    """log10 probability of each token: counts[n - 1] is the count of the n-gram that ends at it.

    `state` is the length of the history in which a token finds the automaton: that of the longest n-gram which the
    token before completed, cut to the longest history; a document starts in the longest one.
    """
    longest = len(counts) - 1
    matched = sum((c > 0).astype(np.int8) for c in counts)
    state = np.empty(len(first), np.int64)
    state[1:] = np.minimum(matched[:-1], longest)
    state[first] = longest if starts else 0
    root = np.where(counts[0] > 0, counts[0] - discount, discount * distinct)
    gain = np.log10(root / total) if total else np.zeros(len(root))
    for n in range(1, longest + 1):
        m = priors[n - 1]
        history = np.empty(len(first), float)
        history[1:] = counts[n - 1][:-1]
        history[first] = starts
        here = state >= n
        arc, fail = here & (counts[n] > 0), here & (counts[n] == 0)
        gain[arc] = np.log10((counts[n][arc] + m * 10 ** gain[arc]) / (history[arc] + m))
        gain[fail] += np.log10(m / (history[fail] + m))
    return gain


def score(docs: DataFrame, held: F.Column, order: int = ORDER, discount: float = DISCOUNT, priors=PRIORS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learns where held is false."""
    spark = docs.sparkSession
    src = _steady(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held")))
    n_all, v_all = vocabulary(src.where(~F.col("held")))
    buckets = max(24, -(-n_all // STEPS))
    tasks = max(shuffle_width(spark), buckets)

    def ask(batches):
        for key, raw, sizes, _, held in _blocks(batches):
            h, first, counts = _tokens(raw, np.r_[0, np.cumsum(sizes)])
            train = np.repeat(~held, counts).astype(float)
            parts = []
            for keys in _ngrams(h, first, order):
                u, inv = np.unique(keys, return_inverse=True)
                parts.append((_prints(u, buckets), np.bincount(inv, weights=train).astype(np.int64), np.searchsorted(_bucket(u, buckets), np.arange(buckets + 1))))
            rows = []
            for b in np.flatnonzero(sum(np.diff(e) for _, _, e in parts)).tolist():
                own = [slice(e[b], e[b + 1]) for _, _, e in parts]
                rows.append((b, key, _blob([_same(raw), *(_steps(p[s]) for (p, _, _), s in zip(parts, own)), *(_small(c[s]) for (_, c, _), s in zip(parts, own))])))
            yield _rows(rows)

    def bring(batches):
        for key, raw, sizes, ids, held in _blocks(batches):
            yield _rows([(-1, key, _blob([sizes.astype("<i8").tobytes(), ids.astype("<i8").tobytes(), held.tobytes(), raw.tobytes()]))])

    def totals(part):
        found = [_unblob(d) for d in part.column("data").to_pylist()]
        out: list = [[f[0]] for f in found]
        for n in range(1, order + 1):
            keys = [_unsteps(f[n]) for f in found]
            _, inv = np.unique(np.concatenate(keys), return_inverse=True)
            sizes = np.array([len(k) for k in keys])
            own = np.concatenate([_unsmall(f[order + n], k) for f, k in zip(found, sizes.tolist())])
            every = np.bincount(inv, weights=own).astype(np.int64)[inv]
            for row, x in zip(out, np.split(every, np.cumsum(sizes)[:-1])):
                row.append(_small(x))
        return pa.table({"bucket": part.column("bucket"), "block": part.column("block"), "data": pa.array([_blob(o) for o in out], pa.binary())})

    def read(part):
        part = part.sort_by("bucket")
        names, (own, *back) = np.asarray(part.column("bucket")), [_unblob(d) for d in part.column("data").to_pylist()]
        sizes, raw = np.frombuffer(own[0], "<i8"), np.frombuffer(own[3], np.uint8)
        ids, held_rows = np.frombuffer(own[1], "<i8").reshape(-1, 2), np.frombuffer(own[2], bool)
        if names[0] >= 0 or any(b[0] != _same(raw) for b in back):
            raise RuntimeError("the documents came in another order when read again; write them to files first")
        h, first, tokens = _tokens(raw, np.r_[0, np.cumsum(sizes)])
        counts = []
        for n, keys in enumerate(_ngrams(h, first, order)):
            u, inv = np.unique(keys, return_inverse=True)
            many = np.bincount(_bucket(u, buckets), minlength=buckets)[names[1:]]
            counts.append(np.concatenate([_unsmall(b[n + 1], k) for b, k in zip(back, many.tolist())])[inv].astype(float))
        starts = counts[0][tokens[0] - 1]  # the end token occurs once a document
        gain = traverse(counts, first, starts, n_all, v_all, discount, priors)
        at = np.flatnonzero(first)
        add = lambda x: np.add.reduceat(x, at)
        return pa.table({"doc_id": pa.array(ids[:, 0], pa.int64(), mask=ids[:, 1] > 0), "held_out": held_rows, "n_tokens": tokens.astype(np.int64),
                         "n_known": add((counts[0] > 0).astype(np.int64)), "base": add(np.log10(counts[0] + 0.5)), "gain": add(gain)})

    # a block is named by the number of its first row; its documents do not travel with its n-grams
    numbered = src.withColumn("key", F.monotonically_increasing_id())
    asked = numbered.mapInArrow(ask, _MESSAGE).repartition(tasks, "bucket").groupBy("bucket").applyInArrow(totals, _MESSAGE)
    both = asked.unionByName(numbered.mapInArrow(bring, _MESSAGE)).repartition(tasks, "block")
    rows = both.groupBy("block").applyInArrow(read, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, gain double")
    return rows.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.log10(F.lit(n_all + 0.5 * (v_all + 1)))).alias("base_score"), F.col("gain").alias("score"))
