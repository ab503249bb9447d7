"""Quality scores by positive-unlabelled learning with the non-negative risk estimator.

Positives are trusted documents (label 1); everything else in the training fold is unlabelled web text.  Label 0 is not used.
The class prior pi, the share of positives in the unlabelled text, is estimated from the two samples alone: a first network
tells positives from unlabelled text; on the halves of the samples that it has not seen, pi is the share of unlabelled
text over that of positives above a threshold, at the threshold where the upper confidence bound of that ratio is least
(the best bin: there, unlabelled text is nearly all positive).  A second network over the same text statistics minimises
pi R_p(+) + max(0, R_u(-) - pi R_p(-)),  with the sigmoid loss; where the bracket is negative, the step goes against it.
The score is the sigmoid of its margin, so 0.5 is where that risk puts the border.

The sample is bounded: of each kind the ids with the least hash in each of POSITIVES or UNLABELLED cells of hashes.  Every
document is scored over its whole text.  Null text is empty text and gets the score of its all-zero statistics.  Without
positives, every document scores 0.5.  Repeated rows are scored each, alike; rows that share an id count once in the sample;
a null id is scored but never sampled.  A score of just 0.5 is predicted 1.  keep_good() keeps every column, whatever its name.
Empty tables give no rows.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import slices

POSITIVES, UNLABELLED = 3000, 6000
HIDDEN, STEPS, BATCH, RATE = 16, 1500, 512, 0.01
#: Part of the bound by Hoeffding's inequality that best_bin() takes; the whole one is wide for samples of hundreds.
SLACK = 1.0

_UPPER, _LOWER, _DIGIT, _SPACE, _HIGH, _MARK = (np.zeros(256, bool) for _ in range(6))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = _HIGH[128:] = True
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MARK[:] = ~(_UPPER | _LOWER | _DIGIT | _SPACE | _HIGH)
_GROUPS = np.stack([_UPPER, _LOWER, _DIGIT, _SPACE, _HIGH, _MARK]).astype(float)
_SINGLE = [ord(c) for c in ".,!?;:|#$%&*@/\\=<>(){}[]\"'-_+~^"]
N_FEATURES = len(_GROUPS) + len(_SINGLE) + 14


def features(text: str) -> np.ndarray:
    """Statistics of a whole text."""
    data = text.encode()
    out = np.zeros(N_FEATURES)
    words = text.split()
    if not words:
        return out
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = len(words)
    out[:len(_GROUPS)] = _GROUPS @ hist / len(data)
    out[len(_GROUPS):len(_GROUPS) + len(_SINGLE)] = np.sqrt(hist[_SINGLE] / len(data))
    counts = Counter(words)
    lines = text.split("\n")
    by_line = Counter(lines)
    same = sum(map(str.__eq__, words, words[1:]))
    lengths = np.fromiter(map(len, words), float, n)
    whole = sum(map(str.isupper, words))
    edge = sum(not w[-1].isalnum() for w in words)
    doubled = sum(len(w) > 2 and w[-1] == w[-2] and not w[-1].isalnum() for w in words)
    title = sum(w[0].isupper() for w in words)
    single = sum(map((1).__eq__, map(len, words)))
    out[len(_GROUPS) + len(_SINGLE):] = (
        np.log1p(n) / 10, len(counts) / n, max(counts.values()) / n, same / n, lengths.mean() / 10, lengths.std() / 10, lengths.max() / 100,
        whole / n, edge / n, doubled / n, title / n, single / n, len(by_line) / len(lines), max(by_line.values()) / len(lines))
    return out


class Net:
    def __init__(self, mean, std, weights=None, seed=3):
        rng = np.random.default_rng(seed)
        self.mean, self.std = mean, std
        self.w = weights or [rng.normal(0, 1 / np.sqrt(N_FEATURES), (N_FEATURES, HIDDEN)), np.zeros(HIDDEN),
                             rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]

    def _margin(self, x):
        h = np.tanh(x @ self.w[0] + self.w[1])
        return h, h @ self.w[2] + self.w[3]

    def _pull(self, x, h, d):
        """Gradients for d = the loss's derivative by each margin."""
        dh = d[:, None] * self.w[2] * (1 - h * h)
        return [x.T @ dh, dh.sum(0), h.T @ d, np.array([d.sum()])]

    def scaled(self, x):
        return np.clip((x - self.mean) / self.std, -8, 8)

    def score(self, x):
        m = self._margin(self.scaled(x))[1]
        return 1 / (1 + np.exp(-np.clip(m, -50, 50)))

    def fit(self, pos, unl, prior: float | None, steps=STEPS, decay=1e-4, seed=4):
        """Least non-negative risk for a prior; without one, the logistic loss of telling positives from unlabelled text."""
        pos, unl = self.scaled(pos), self.scaled(unl)
        rng = np.random.default_rng(seed)
        m, v = [[np.zeros_like(w) for w in self.w] for _ in range(2)]
        for i in range(1, steps + 1):
            p, u = pos[rng.integers(0, len(pos), BATCH)], unl[rng.integers(0, len(unl), BATCH)]
            hp, mp = self._margin(p)
            hu, mu = self._margin(u)
            lp, lu = 1 / (1 + np.exp(-mp)), 1 / (1 + np.exp(-mu))  # loss of calling it positive wrongly; 1 - loss the other way
            add = lambda a, b, sign=1: [sign * (x + y) for x, y in zip(a, b)]
            dp, du = lp * (1 - lp) / len(p), lu * (1 - lu) / len(u)
            if prior is None:
                g = add(self._pull(p, hp, (lp - 1) / len(p)), self._pull(u, hu, lu / len(u)))
            elif lu.mean() >= prior * lp.mean():
                g = add(self._pull(p, hp, -2 * prior * dp), self._pull(u, hu, du))
            else:
                g = add(self._pull(u, hu, du), self._pull(p, hp, -prior * dp), -1)
            lr = RATE * (1 - 0.9 * i / steps)
            for k, w in enumerate(self.w):
                d = g[k] + decay * w
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.99 * v[k] + 0.01 * d * d
                self.w[k] = w - lr * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)
        return self


def best_bin(pos: np.ndarray, unl: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives in unlabelled text, from scores that are high for positives."""
    cut = np.sort(pos)[::-1]
    share_p = np.arange(1, len(cut) + 1) / len(cut)
    share_u = 1 - np.searchsorted(np.sort(unl), cut, "left") / len(unl)
    slack = SLACK * np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(unl)) + 1.01 / np.sqrt(len(pos)))
    at = int(((share_u + slack) / share_p).argmin())
    return float(min(share_u[at] / share_p[at], 1.0))


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """best_bin() on one half of each sample, scored by a network that learned from the other half."""
    net = Net(unl.mean(0), unl.std(0) + 1e-3).fit(pos[::2], unl[::2], None, decay=3e-3)
    rest = [x[1::2] if len(x) > 1 else x for x in (pos, unl)]
    return float(np.clip(best_bin(*map(net.score, rest)), 0.01, 0.99))


def _sampled(df: DataFrame, n: int) -> DataFrame:
    """Of the ids the one with the least hash in each of n cells of hashes."""
    h = F.xxhash64("doc_id")
    return df.where(F.col("doc_id").isNotNull()).groupBy(F.pmod(h, F.lit(n)).alias("cell")).agg(F.min_by("doc_id", h).alias("doc_id")).select("doc_id")


def learn(docs: DataFrame, labels: DataFrame, train: F.Column, label_col: str = "quality") -> Net | None:
    """Labels of ids that `docs` lacks are not used."""
    spark = docs.sparkSession
    trusted = labels.where(train & (F.col(label_col).cast("int") == 1)).select(F.col("doc_id").cast("long").alias("doc_id"))
    kinds = (("p", trusted, POSITIVES), ("u", docs.where(train).select(F.col("doc_id").cast("long").alias("doc_id")), UNLABELLED))
    ids = [(r["doc_id"], k) for k, df, n in kinds for r in _sampled(df, n).collect()]  # at most 9000
    wanted = spark.createDataFrame(ids, "doc_id long, kind string")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([features(t.as_py() or "").tolist() for t in b.column(2)],
                                                                                pa.list_(pa.float64()))], ["doc_id", "kind", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(wanted), "doc_id").select("doc_id", "kind", "text")
    found: dict[str, list] = {"p": [], "u": []}
    for r in rows.mapInArrow(run, "doc_id long, kind string, x array<double>").groupBy("kind", "doc_id").agg(F.min("x").alias("x")).orderBy("kind", F.xxhash64("doc_id")).collect():
        found[r["kind"]].append(r["x"])
    pos, unl = (np.array(found[k]).reshape(-1, N_FEATURES) for k in "pu")
    if not len(pos):
        return None
    unl = unl if len(unl) else pos
    return Net(unl.mean(0), unl.std(0) + 1e-3).fit(pos, unl, estimate_prior(pos, unl))


def _scored(docs: DataFrame, net: Net | None, column: str) -> DataFrame:
    """docs, all columns kept, with a score column."""

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index(column)
            for lo, hi in slices(np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])):
                part = b.slice(lo, hi - lo)
                texts = part.column(at).to_pylist()
                s = net.score(np.array([features(t or "") for t in texts])) if net else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays([*part.columns[:at], *part.columns[at + 1:], pa.array(s)],
                                                 [*part.schema.names[:at], *part.schema.names[at + 1:], "_score"])

    return docs.mapInArrow(run, StructType([*(f for f in docs.schema if f.name != column), StructField("_score", DoubleType())]))


def score(docs: DataFrame, labels: DataFrame, held: F.Column) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    net = learn(docs, labels, ~held)
    src = docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), F.col("text").cast("string").alias("_text"))
    return _scored(src, net, "_text").select(
        "doc_id", "held_out", F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, held: F.Column, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, unchanged, that score at least threshold."""
    net = learn(docs, labels, ~held)
    rows = docs.select(*(F.col(f"`{c}`").alias(f"in_{k}") for k, c in enumerate(docs.columns)), F.col("text").cast("string").alias("_text"))
    return _scored(rows, net, "_text").where(F.col("_score") >= threshold).select(*(F.col(f"in_{k}").alias(c) for k, c in enumerate(docs.columns)))
