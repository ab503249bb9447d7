"""Toxicity scores: subword-bag embeddings, averaged into a linear softmax, trained jointly in numpy.

Every word is the bag of its character n-grams (SHORT to LONG of them, with marks at both ends) and of itself, hashed into BUCKETS rows of
an embedding table; so a misspelling that was never seen shares most of its vectors with the word it comes from.  The vectors of a
passage of WIDTH words are averaged and go into a softmax over two classes.  A text is as toxic as its worst passage: a few words
in a text of any length must not drown in its average.  Passages overlap by half, and the last one is as short as it falls.

Training knows only the label of a whole text.  A toxic text pulls up the passages that are taken for toxic most, shared by a
softmax over them; a clean one pushes down its worst passages the same way.  Table and softmax are trained together, by
Adagrad on the rows touched.  The sample is bounded: of each label the ids with the least hash in each of TOXIC or CLEAN cells
of hashes, texts of at most BLOCK bytes, in the order of their hashes up to SAMPLE_BYTES of text together.

Scoring takes whole texts.  As the softmax is linear, the average's margin is the average of each bucket's margin, so a text costs a
look-up for each n-gram.  A task reads texts in slices of bytes, and a text of over BLOCK characters in blocks that end at white
space (a word of over BLOCK characters counts as several).

Cases.  Null text is empty text; a text without words scores the softmax of its bias alone.  Without labels of both kinds every
text scores the share of toxic labels (0 without any).  A null label is no label; of labels of one id the largest counts.  Repeated rows are scored
each, alike; an id held by several texts is learned from the least of them.  A null id is scored but never sampled.  A score
of just 0.5 is predicted 1.  Empty tables give no rows; other columns are not read.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, ship, slices

TOXIC, CLEAN, SAMPLE_BYTES, BLOCK = 3000, 6000, 24_000_000, 500_000
SHORT, LONG, BUCKETS, SIZE, WIDTH = 3, 5, 1 << 17, 8, 4
EPOCHS, STEPS, BATCH, RATE, SHARP, BALANCE = 5, 300, 64, 6.0, 1.0, 0.5
_POWER = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407], np.uint64)
_SPACE = " \t\n\x0b\x0c\r"


def blocks(text: str):
    """text in parts of at most BLOCK characters that end at white space; of a longer word every BLOCK characters are a word."""
    at = 0
    while at < len(text):
        if len(text) - at <= BLOCK:
            yield text[at:]
            return
        if text[at] in _SPACE:
            at += 1
            continue
        end = at + BLOCK
        last = end if text[end] in _SPACE else max(text.rfind(c, at, end) for c in _SPACE)
        end = last if last > at else end
        yield text[at:end]
        at = end


def bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words' n-grams, where each word's begin and the last one's end, and the number of words of each text.

    A word's n-grams reach over the white space on either side of it, which marks its ends; one more bucket stands for the word.
    """
    low = [t.lower() for t in texts]
    code = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    space = (code == 32) | ((code >= 9) & (code <= 13))
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    border = 1 + np.cumsum([len(t) + 1 for t in low])  # where the next text begins
    n = np.bincount(np.searchsorted(border, start, "right"), minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(1, np.int64), n
    value = mix(np.where(space, np.uint32(32), code).astype(np.uint64) + np.uint64(1))
    length = end - start
    count = [np.maximum(length + 3 - k, 0) for k in range(SHORT, LONG + 1)]  # of the word with a mark at both ends
    at = np.concatenate([[0], np.cumsum(1 + sum(count))])
    out = np.empty(at[-1], np.int64)
    inside = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    letters = value[np.repeat(start, length) + inside] * (_POWER[inside % 5] + (inside // 5).astype(np.uint64))
    out[at[:-1]] = mix(np.add.reduceat(letters, np.cumsum(length) - length)) % np.uint64(BUCKETS)
    done, h = at[:-1] + 1, np.zeros(len(value), np.uint64)
    for k in range(1, min(LONG, len(value)) + 1):
        h[:len(value) - k + 1] += value[k - 1:] * _POWER[k - 1]
        if k >= SHORT:
            c = count[k - SHORT]
            i = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            out[np.repeat(done, c) + i] = mix(h[np.repeat(start - 1, c) + i] + np.uint64(k)) % np.uint64(BUCKETS)
            done = done + c
    return out, at, n


class Model:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.1, (BUCKETS, SIZE)).astype(np.float32)
        self.soft = rng.normal(0, 0.1, (2, SIZE)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)

    def margins(self) -> tuple[np.ndarray, float]:
        """What each bucket adds to the margin of class 1 over class 0, and the bias's part."""
        return self.table @ (self.soft[1] - self.soft[0]), float(self.bias[1] - self.bias[0])

    def fit(self, texts: list[str], toxic: np.ndarray, seed: int = 6) -> "Model":
        rng = np.random.default_rng(seed)
        seen = [np.full(BUCKETS, 1e-10, np.float32), np.full(SIZE, 1e-4, np.float32), 1e-4]
        order = np.arange(len(texts))
        share = max(float(np.mean(toxic)), 1e-3)
        weight = np.where(toxic == 1, 0.5 / share, 0.5 / (1 - share)) ** BALANCE
        per_epoch = -(-len(order) // BATCH)
        steps, done = max(STEPS, EPOCHS * per_epoch), 0
        for _ in range(-(-steps // per_epoch)):
            rng.shuffle(order)
            for lo in range(0, len(order), BATCH):
                rate = RATE * max(0.05, 1 - 0.95 * done / steps)
                done += 1
                own = np.sort(order[lo:lo + BATCH])
                way = self.soft[1] - self.soft[0]
                gram, at, n = bags([texts[t] for t in own])
                if not n.any():
                    continue
                size = np.diff(at)
                vector = np.add.reduceat(self.table[gram], at[:-1], 0) / size[:, None]
                text_of, lows, highs = spans(n)
                total = np.concatenate([np.zeros((1, SIZE), np.float64), np.cumsum(vector, 0, np.float64)])
                mean = ((total[highs] - total[lows]) / (highs - lows)[:, None]).astype(np.float32)
                margin = mean @ way + (self.bias[1] - self.bias[0])
                begin = np.flatnonzero(np.diff(text_of, prepend=-1))
                top = np.maximum.reduceat(margin, begin)
                part = np.exp(SHARP * (margin - np.repeat(top, np.diff([*begin, len(margin)]))))
                part /= np.repeat(np.add.reduceat(part, begin), np.diff([*begin, len(margin)]))
                y, w = toxic[own][text_of], weight[own][text_of]
                pull = (part * w * (1 / (1 + np.exp(-margin)) - y) / len(own)).astype(np.float32)  # softmax of two classes: the slope by the margin
                to_way = pull @ mean
                # each word gets the pull of the passages that hold it, each n-gram its word's share
                spread = np.zeros(len(size) + 1, np.float64)
                np.add.at(spread, lows, pull / (highs - lows))
                np.add.at(spread, highs, -pull / (highs - lows))
                to_word = np.cumsum(spread[:-1])
                slope = np.bincount(gram, np.repeat(to_word / size, size), BUCKETS)
                hit = np.flatnonzero(slope)
                g = slope[hit].astype(np.float32) * len(own)
                seen[0][hit] += g * g * float(way @ way)
                self.table[hit] -= rate * (g / np.sqrt(seen[0][hit]))[:, None] * way
                seen[1] += to_way * to_way
                step = 0.1 * rate * to_way / np.sqrt(seen[1])
                self.soft[1] -= step
                self.soft[0] += step
                b = float(pull.sum())
                seen[2] += b * b
                self.bias += np.array([1, -1], np.float32) * (0.1 * rate * b / np.sqrt(seen[2]))
        return self


def spans(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passages of texts with n words each: text, first word and end, words counted over all texts; none for a text without words."""
    step = WIDTH // 2
    many = np.where(n > 0, np.maximum(1, -(-(n - WIDTH) // step) + 1), 0)
    text = np.repeat(np.arange(len(n)), many)
    k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    base = np.cumsum(n) - n
    low = base[text] + k * step
    return text, low, np.minimum(low + WIDTH, base[text] + n[text])


def scores(texts: list[str], margins: np.ndarray, bias: float, at_once: int = 1_000_000) -> np.ndarray:
    """Score of each text; at_once: characters that are worked on together."""
    margins = np.rint(margins * 2.0**24).astype(np.int64)  # whole numbers, so that equal texts score alike wherever they stand
    parts = [(k, b) for k, t in enumerate(texts) for b in blocks(t)]
    word, n, lo = [], np.zeros(len(texts), np.int64), 0
    while lo < len(parts):
        hi, size = lo + 1, len(parts[lo][1])
        while hi < len(parts) and size + len(parts[hi][1]) <= at_once:
            size += len(parts[hi][1])
            hi += 1
        grams, at, count = bags([b for _, b in parts[lo:hi]])
        if len(at) > 1:
            word.append(np.add.reduceat(margins[grams], at[:-1]) * 256 // np.diff(at))
        np.add.at(n, [k for k, _ in parts[lo:hi]], count)
        lo = hi
    best = np.where(n > 0, -np.inf, 0.0)
    total = np.cumsum(np.concatenate([np.zeros(1, np.int64), *word]))
    text, low, high = spans(n)
    np.maximum.at(best, text, (total[high] - total[low]) / 2.0**32 / (high - low))
    return 1 / (1 + np.exp(-np.clip(best + bias, -50, 50)))


def _sample(docs: DataFrame, labels: DataFrame, train: F.Column, label_col: str):
    """Texts and labels to learn from: bounded in number and in bytes."""
    marks = labels.where(train & F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    h = F.xxhash64("doc_id")
    kinds = [marks.where("y = 1" if y else "y <> 1").groupBy(F.pmod(h, F.lit(n)).alias("cell")).agg(F.min_by("doc_id", h).alias("doc_id")).select("doc_id", F.lit(y).alias("y")) for y, n in ((1, TOXIC), (0, CLEAN))]
    ids = kinds[0].unionByName(kinds[1])
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") <= BLOCK)
    rows = rows.join(F.broadcast(ids), "doc_id")  # at most TOXIC + CLEAN ids
    sizes = rows.groupBy("doc_id", "y").agg(F.min(F.octet_length("text")).alias("n")).orderBy(F.xxhash64("doc_id")).collect()
    left, wanted = SAMPLE_BYTES, []
    for r in sizes:
        if r["n"] > left:
            break
        left -= r["n"]
        wanted.append((r["doc_id"], r["n"]))
    chosen = docs.sparkSession.createDataFrame(wanted, "doc_id long, n int")
    # of an id's texts the least of the shortest ones
    own = rows.join(F.broadcast(chosen), "doc_id").where(F.octet_length("text") == F.col("n"))
    return own.groupBy("doc_id", "y").agg(F.min("text").alias("text")).orderBy(F.xxhash64("doc_id")).collect()


def learn(docs: DataFrame, labels: DataFrame, train: F.Column, label_col: str = "toxic") -> tuple[np.ndarray, float]:
    """Margins of the buckets, and of the bias."""
    rows = _sample(docs, labels, train, label_col)
    y = np.array([r["y"] for r in rows], np.int64)
    if not len(y) or y.min() == y.max():
        return np.zeros(BUCKETS, np.float32), 50.0 if len(y) and y.min() else -50.0
    return Model().fit([r["text"] for r in rows], y).margins()


def score(docs: DataFrame, labels: DataFrame, held: F.Column, label_col: str = "toxic", slice_bytes: int = 2_000_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    ship(docs.sparkSession)
    margins, bias = learn(docs, labels, ~held, label_col)

    def run(batches):
        for b in batches:
            size = pc.fill_null(pc.binary_length(b.column(2)), 0).to_numpy(zero_copy_only=False)
            for lo, hi in slices(np.concatenate([[0], np.cumsum(size, dtype=np.int64)]), slice_bytes):
                part = b.slice(lo, hi - lo)
                s = scores([t or "" for t in part.column(2).to_pylist()], margins, bias)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s, pa.float64())], ["doc_id", "held_out", "score"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("_text"))
    out = src.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
