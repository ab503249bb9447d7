"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

The network reads a text's UTF-8 bytes, white space included, in both directions and gives every position a
distribution over the languages.  Long texts are read in windows of WINDOW bytes; each direction starts CONTEXT bytes
before the window (or at the text's end), so that its state has settled where labels count, and no window parts a
character.  Every position of the whole text is labelled once.  A document's probability of a language is the softmax
of the mean over its positions of the log-probabilities, sharpened by a factor that is fitted, by maximum likelihood,
on sampled documents that the network was not trained on; so the score is a probability.

Training is backpropagation through time over spans of SPAN bytes, on a bounded sample: for every language the texts
with the least hash in each of SAMPLE cells of hashes (so equal texts count once, and at most SAMPLE texts a language),
and of each text SPANS spans at random places of the whole text.  The LANGS commonest languages are learned.

Null text and text without letters (str.isalpha) get `und`, score 0.  If there is nothing to learn from, every document
does.  Repeated rows are labelled each, alike; ties of probability go to the language first in alphabetical order.  A
null id stays null, and an empty table gives no rows.  Other columns are not read, so their names do not matter.  A
task holds one slice of about 2 MB of texts, or one longer text.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_buffer

HIDDEN, WINDOW, CONTEXT, BATCH = 10, 480, 24, 2048
SAMPLE, SPANS, SPAN, LANGS = 400, 10, 64, 200
STEPS, STEP_SPANS, RATE = 300, 128, 0.02
#: The byte number that stands for nothing.
STILL = 256


class BiGRU:
    """Both directions share nothing; weights are rows of `p`, a dict of float32 arrays."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 1, weights: dict | None = None, sharp: float = 1.0):
        self.langs, self.h, self.sharp = langs, hidden, sharp
        rng = np.random.default_rng(seed)
        f = lambda *s: rng.normal(0, 0.3, s).astype("f4")
        self.p = weights or {f"{n}{d}": x for d in "fb" for n, x in (
            ("E", f(257, 3 * hidden)), ("U", f(hidden, 2 * hidden)), ("C", f(hidden, hidden)), ("O", f(hidden, len(langs))))} | {
            "o": np.zeros(len(langs), "f4")}

    def _run(self, d: str, x: np.ndarray, visit):
        """x: (time, batch), in this direction's order.  A state stands still at STILL.  visit(t, state, tape)."""
        p, H = self.p, self.h
        E, U, C = p["E" + d], p["U" + d], p["C" + d]
        one = lambda m, k: np.ascontiguousarray(m[:, k * H:(k + 1) * H])
        (ez, er, ec), (uz, ur) = (one(E, k) for k in range(3)), (one(U, k) for k in range(2))
        ez[STILL] = -60.0
        for w in (ez, er, uz, ur):
            w *= 0.5
        h = np.zeros((x.shape[1], H), E.dtype)
        for t in range(len(x)):
            z, r = h @ uz, h @ ur
            z += np.take(ez, x[t], axis=0)
            r += np.take(er, x[t], axis=0)
            for gate in (z, r):  # the sigmoid, whose inner half is in the weights
                np.tanh(gate, out=gate)
                gate *= 0.5
                gate += 0.5
            c = (r * h) @ C
            c += np.take(ec, x[t], axis=0)
            np.tanh(c, out=c)
            new = c - h
            new *= z
            new += h
            visit(t, new, (h, z, r, c))
            h = new

    def positions(self, x):
        """Log-probabilities (language, time, batch) of every position."""
        y = np.empty((len(self.langs), *x.shape), self.p["o"].dtype)
        y[:] = self.p["o"][:, None, None]
        last = len(x) - 1

        def forward(t, s, _):
            y[:, t] += (s @ self.p["Of"]).T

        def backward(t, s, _):
            y[:, last - t] += (s @ self.p["Ob"]).T

        self._run("f", x, forward)
        self._run("b", x[::-1], backward)
        y -= y.max(0)
        y -= np.log(np.exp(y).sum(0))
        return y

    def gradients(self, x, on, want):
        """Loss and gradients of the mean cross-entropy over positions; want: (batch,) language numbers."""
        states, tapes = {}, {}
        for d, xs in (("f", x), ("b", x[::-1])):
            states[d], tapes[d] = [], []
            self._run(d, xs, lambda t, s, tape, d=d: (states[d].append(s), tapes[d].append(tape)))
        sf, sb = np.stack(states["f"]), np.stack(states["b"])
        y = sf @ self.p["Of"] + sb[::-1] @ self.p["Ob"] + self.p["o"]
        y = np.exp(y - y.max(2, keepdims=True))
        y /= y.sum(2, keepdims=True)
        n = on.sum()
        hit = y[:, np.arange(len(want)), want]
        loss = -(np.log(hit + 1e-9) * on).sum() / n
        y[:, np.arange(len(want)), want] -= 1
        y *= (on / n)[:, :, None]
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        grads["o"] = y.sum((0, 1))
        for d, s, xs, ys in (("f", sf, x, y), ("b", sb, x[::-1], y[::-1])):
            U, C, O = self.p["U" + d], self.p["C" + d], self.p["O" + d]
            grads["O" + d] = np.tensordot(s, ys, ((0, 1), (0, 1)))
            back = ys @ O.T
            dh = np.zeros_like(s[0])
            bytes_at = np.empty((*xs.shape, 3 * self.h), s.dtype)
            for t in range(len(xs) - 1, -1, -1):
                h, z, r, c = tapes[d][t]
                dh = dh + back[t]
                dc = dh * z * (1 - c * c)
                dz = dh * (c - h) * z * (1 - z)
                dhr = dc @ C.T
                dr = dhr * h * r * (1 - r)
                dg = np.concatenate([dz, dr], 1)
                grads["C" + d] += (r * h).T @ dc
                grads["U" + d] += h.T @ dg
                bytes_at[t, :, :2 * self.h], bytes_at[t, :, 2 * self.h:] = dg, dc
                dh = dh * (1 - z) + dhr * r + dg @ U.T
            flat, of = bytes_at.reshape(-1, 3 * self.h), xs.reshape(-1)
            grads["E" + d] = np.stack([np.bincount(of, weights=flat[:, k], minlength=257) for k in range(3 * self.h)], 1).astype(s.dtype)
        return loss, grads

    def fit(self, x, on, want, steps=STEPS, batch=STEP_SPANS, rate=RATE, seed=2):
        """Adam over random batches; x, on: (time, examples); languages count alike."""
        rng = np.random.default_rng(seed)
        order = [np.flatnonzero(want == k) for k in range(len(self.langs))]
        order = [o for o in order if len(o)]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        for i in range(1, steps + 1):
            group = rng.integers(0, len(order), batch)
            pick = np.array([order[g][int(u * len(order[g]))] for g, u in zip(group, rng.random(batch))])
            _, g = self.gradients(x[:, pick], on[:, pick], want[pick])
            lr = rate * (1 - 0.9 * i / steps)
            for k in self.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] * g[k]
                self.p[k] -= (lr * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)).astype(self.p[k].dtype)
        return self

    def documents(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Mean log-probabilities (text, language) of whole texts, given as bytes and the offsets of the texts."""
        size = np.diff(off)
        total = np.zeros((len(size), len(self.langs)))
        start, end, low, high, text = windows(raw, off)
        order = np.argsort(high - low, kind="stable")
        step = max(16, BATCH * 4 // max(4, len(self.langs)))
        for a in range(0, len(order), step):
            at = order[a:a + step]
            place = low[at] + np.arange(int((high - low)[at].max()))[:, None]
            x = np.where(place < high[at], raw[np.minimum(place, len(raw) - 1)], STILL)
            count = (place >= start[at]) & (place < end[at])
            np.add.at(total, text[at], (self.positions(x) * count).sum(1).T)
        return total / np.maximum(size, 1)[:, None]

    def probabilities(self, mean: np.ndarray) -> np.ndarray:
        p = np.exp(self.sharp * (mean - mean.max(1, keepdims=True)))
        return p / p.sum(1, keepdims=True)

    def sharpen(self, mean: np.ndarray, want: np.ndarray) -> "BiGRU":
        """Fit the factor of probabilities() to documents of known language."""
        def loss(sharp):
            y = sharp * (mean - mean.max(1, keepdims=True))
            return (np.log(np.exp(y).sum(1)) - y[np.arange(len(want)), want]).mean()

        if len(want):
            self.sharp = float(min(np.geomspace(0.5, 200, 120), key=loss))
        return self


def windows(raw: np.ndarray, off: np.ndarray, window: int = WINDOW, context: int = CONTEXT):
    """start, end (the bytes to label), low, high (the bytes to read) and text of each window; no character is parted."""
    many = -(-np.diff(off) // window)
    text = np.repeat(np.arange(len(many)), many)
    k = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    inside = np.zeros(len(raw) + 1, bool)
    inside[:-1] = (raw & 0xC0) == 0x80

    def whole(at):
        at = at.copy()
        for _ in range(3):
            at -= (inside[at] & (at > off[text]) & (at < off[text + 1])).astype(at.dtype)
        return at

    start = whole(off[text] + k * window)
    end = whole(np.minimum(off[text] + (k + 1) * window, off[text + 1]))
    return start, end, whole(np.maximum(start - context, off[text])), whole(np.minimum(end + context, off[text + 1])), text


def spans(data: bytes, seed: int, many: int = SPANS, size: int = SPAN) -> list[bytes]:
    """Spans of a text at random places, from the start of a character to the end of one."""
    if len(data) <= size:
        return [data]
    rng = np.random.default_rng(seed & 0x7FFFFFFF)
    out = []
    for at in rng.integers(0, len(data) - size + 1, min(many, -(-len(data) // size))).tolist():
        out.append(data[at:at + size].decode("utf-8", "ignore").encode())
    return out


def _arrays(words: list[bytes]):
    """(time, words) byte numbers, and which stand for something."""
    n = np.array([len(w) for w in words])
    x = np.full((len(words), max(n.max(initial=1), 1)), STILL, np.int64)
    on = np.arange(x.shape[1])[None] < n[:, None]
    x[on] = np.frombuffer(b"".join(words), np.uint8)
    return np.ascontiguousarray(x.T), np.ascontiguousarray(on.T).astype("f4")


def has_letters(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def learn(docs: DataFrame, train: F.Column, lang_col: str = "lang") -> BiGRU | None:
    known = docs.where(train & F.col(lang_col).isNotNull() & F.col("text").isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h"))
    cells = known.groupBy("lang", F.pmod("h", F.lit(SAMPLE)).alias("cell")).agg(F.min("h").alias("h"), F.count("*").alias("n"))
    common = cells.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGS).select("lang")
    chosen = F.broadcast(cells.join(common, "lang").select("lang", "h"))  # at most SAMPLE * LANGS rows

    def take(batches):
        for b in batches:
            langs, hashes, found = [], [], []
            for lang, h, t in zip(*(b.column(k).to_pylist() for k in range(3))):
                if has_letters(t):
                    langs.append(lang)
                    hashes.append(h)
                    found.append(spans(t.encode(), h))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(hashes, pa.int64()), pa.array(found, pa.list_(pa.binary()))], ["lang", "h", "spans"])

    taken = known.join(chosen, ["lang", "h"]).select("lang", "h", "text").mapInArrow(take, "lang string, h long, spans array<binary>")
    sample = sorted((r["lang"], r["h"], r["spans"]) for r in taken.groupBy("lang", "h").agg(F.first("spans").alias("spans")).collect())
    langs = sorted({r[0] for r in sample})
    if not langs:
        return None
    fit, check = [r for k, r in enumerate(sample) if k % 4], [r for k, r in enumerate(sample) if k % 4 == 0]
    fit = fit or check
    flat = [(bytes(w), langs.index(lang)) for lang, _, found in fit for w in found]
    x, on = _arrays([w for w, _ in flat])
    net = BiGRU(langs).fit(x, on, np.array([k for _, k in flat]))
    raw = [b"".join(map(bytes, found)) for _, _, found in check]
    mean = net.documents(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64))
    return net.sharpen(mean, np.array([langs.index(r[0]) for r in check]))


def identify(docs: DataFrame, held: F.Column, lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns where held is false and the language is not null."""
    model = learn(docs, ~held, lang_col)
    langs, weights, sharp = (model.langs, model.p, model.sharp) if model else ([], {}, 1.0)

    def run(batches):
        net = BiGRU(langs, weights=weights, sharp=sharp) if langs else None
        for batch in batches:
            raw, off = text_buffer(batch.column(2))
            for lo, hi in slices(off):
                named, odds = np.full(hi - lo, "und", object), np.zeros(hi - lo)
                letters = np.array([has_letters(t) for t in batch.column(2)[lo:hi].to_pylist()], bool)
                if net and letters.any():
                    p = net.probabilities(net.documents(raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]))
                    best = p.argmax(1)
                    named = np.where(letters, np.array(langs, object)[best], "und")
                    odds = np.where(letters, p[np.arange(len(p)), best], 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array(named, pa.string()), pa.array(odds)],
                                                 ["doc_id", "held_out", "lang_pred", "score"])

    src = docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), F.col("text").cast("string"))
    return src.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
