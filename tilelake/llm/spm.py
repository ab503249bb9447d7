"""SentencePiece encoding and decoding (byte-pair models with byte fallback) by suffix-array matching.

The distinct segments of a batch of texts (a segment ends before a space mark that follows another character, and at
line breaks; no piece crosses either) are concatenated and indexed by a suffix array over their first MAX_PIECE
characters.  Every piece of the vocabulary is found by binary search for its range of suffixes; each occurrence is an
edge from its start to its end, and edges are sorted by position.

Relaxing.  For a unigram model one would relax the edges left to right to the best path.  The public model is a
byte-pair model, for which the best path by scores is not the right result: the right one merges neighbours in order of
rank.  So the edges are relaxed in order of rank: a round takes, in every segment at once, the edge of the best rank
(leftmost on ties) that joins two neighbouring tokens, until none is left.  Characters without a piece become bytes.

Null text is the empty text, which has no ids.  Repeated rows are encoded each; ties of rank do not occur, and of equal pairs the
leftmost merges first.  A null id stays null.  Other columns are not read, so their names do not matter.  An empty table gives no
rows.  A task takes 1500 texts at a time; an unbroken text of over BATCH_CHARS characters is one batch, of about 200 bytes a character.
"""

import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PIECE = 16
SPACE = "▁"
BATCH_CHARS = 250_000
#: Segments longer than this are merged with a heap instead of in rounds.
LONG = 400
WORDS = 300_000
_models: dict = {}


class Model:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte = {}
        self.text: list[bytes] = []
        pieces: list[tuple[str, int]] = []
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
                self.text.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.text.append(b"")
            else:
                self.text.append(p.encode())
                pieces.append((p, i))
        if any(len(p) > MAX_PIECE or re.search(f"[^{SPACE}]{SPACE}|\n", p) for p, _ in pieces):
            raise ValueError("a piece is too long, or crosses a segment")
        letters = sorted({c for p, _ in pieces for c in p})
        self.rank = np.zeros(0x110000, np.uint16)  # 0: in no piece
        self.rank[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.single = np.full(len(letters) + 1, -1)
        for p, i in pieces:
            if len(p) == 1:
                self.single[self.rank[ord(p)]] = i
        pieces = [x for x in pieces if len(x[0]) > 1]
        self.ids = np.array([i for _, i in pieces])
        self.score = np.zeros(n)
        self.score[self.ids] = [sp.get_score(int(i)) for i in self.ids]
        order = np.argsort(-self.score[self.ids], kind="stable")
        self.order = np.full(n, n, np.int64)  # place in the order of merging
        self.order[self.ids[order]] = np.arange(len(order))
        self.length = np.array([len(p) for p, _ in pieces])
        codes = np.zeros((len(pieces), MAX_PIECE), np.uint64)
        for k, (p, _) in enumerate(pieces):
            codes[k, :len(p)] = self.rank[[ord(c) for c in p]]
        self.keys = _packed(codes)
        full = np.uint64(0xFFFF)
        on = np.arange(MAX_PIECE)[None] < self.length[:, None]
        self.mask = _packed(np.where(on, full, np.uint64(0)))
        self.known: dict[str, bytes] = {}

    def edges(self, codes: np.ndarray) -> np.ndarray:
        """table[s, m]: the piece that covers m characters from s on, or -1.  codes end with MAX_PIECE zeros."""
        n = len(codes) - MAX_PIECE
        window = np.lib.stride_tricks.sliding_window_view(codes, MAX_PIECE)[:n].astype(np.uint64)
        keys = _packed(window)
        suffix = np.lexsort(keys.T[::-1])
        keys = keys[suffix]

        def bound(upper: bool) -> np.ndarray:
            lo, hi = np.zeros(len(self.ids), np.int64), np.full(len(self.ids), n)
            while (lo < hi).any():
                mid = (lo + hi) >> 1
                at = keys[np.minimum(mid, n - 1)] & self.mask
                less, same = np.zeros(len(mid), bool), np.ones(len(mid), bool)
                for k in range(keys.shape[1]):
                    less |= same & (at[:, k] < self.keys[:, k])
                    same &= at[:, k] == self.keys[:, k]
                go = (less | same if upper else less) & (lo < hi)
                lo, hi = np.where(go, mid + 1, lo), np.where(go, hi, np.minimum(mid, hi))
            return lo

        first, last = bound(False), bound(True)
        many = last - first
        piece = np.repeat(np.arange(len(self.ids)), many)
        at = suffix[np.repeat(first - (np.cumsum(many) - many), many) + np.arange(len(piece))]
        table = np.full((n + 1, MAX_PIECE + 1), -1, np.int32)
        table[at, self.length[piece]] = self.ids[piece]  # sorted by position: one row for each start
        return table

    def _bytes(self, c: str) -> list[int]:
        return [self.byte[b] for b in c.encode()]

    def segments(self, words: list[str]) -> list[bytes]:
        """Ids (little-endian 32-bit) of distinct segments."""
        out: list[bytes] = [b""] * len(words)
        lo = 0
        while lo < len(words):
            hi, total = lo, 0
            while hi < len(words) and (hi == lo or total + len(words[hi]) < BATCH_CHARS):
                total += len(words[hi]) + 1
                hi += 1
            out[lo:hi] = self._relax(words[lo:hi])
            lo = hi
        return out

    def _relax(self, words: list[str]) -> list[bytes]:
        joined = "\n".join(words) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.r_[self.rank[points], np.zeros(MAX_PIECE, np.uint16)]
        table = self.edges(codes)
        size = np.array([len(w) for w in words])
        start = np.cumsum(size + 1) - size - 1
        n = len(points)
        end = np.arange(1, n + 2)  # end of the token that starts here
        alive = np.ones(n + 1, bool)
        for k in np.flatnonzero(size > LONG):
            self._by_heap(table, end, alive, int(start[k]), int(start[k] + size[k]))
        word = np.repeat(np.arange(len(words)), size + 1)
        stop = (start + size)[word]
        work = np.flatnonzero((size <= LONG)[word] & (np.arange(n) < stop))  # tokens of segments that may still merge
        big = np.int64(1) << 60
        while len(work):
            nxt = end[work]
            inside = nxt < stop[work]
            far = np.where(inside, end[np.minimum(nxt, n)], work)
            span = far - work
            piece = np.where(inside & (span <= MAX_PIECE), table[work, np.minimum(span, MAX_PIECE)], -1)
            key = np.where(piece >= 0, (self.order[piece] << 24) + (work - start[word[work]]), big)
            edge = np.flatnonzero(np.r_[True, word[work][1:] != word[work][:-1]])
            best = np.minimum.reduceat(key, edge)
            many = np.diff(np.r_[edge, len(work)])
            chosen = (key == np.repeat(best, many)) & (key < big)
            at = work[chosen]
            alive[end[at]] = False
            end[at] = end[end[at]]
            work = work[np.repeat(best < big, many)]
            work = work[alive[work]]
        ids: list[bytes] = []
        tokens = np.flatnonzero(alive[:n])
        tokens = tokens[tokens < stop[tokens]]
        span = end[tokens] - tokens
        value = np.where(span > 1, table[tokens, np.minimum(span, MAX_PIECE)], self.single[self.rank[points[tokens]]])
        edge = np.searchsorted(tokens, np.r_[start, n])
        missing = value < 0
        raw = value.astype("<u4")
        has = np.zeros(len(words) + 1, np.int64)
        np.add.at(has, word[tokens[missing]], 1)
        for k in range(len(words)):
            a, b = edge[k], edge[k + 1]
            if not has[k]:
                ids.append(raw[a:b].tobytes())
            else:
                flat: list[int] = []
                for t, v in zip(tokens[a:b].tolist(), value[a:b].tolist()):
                    flat.extend([v] if v >= 0 else self._bytes(joined[t]))
                ids.append(np.array(flat, "<u4").tobytes())
        return ids

    def _by_heap(self, table, end, alive, lo: int, hi: int) -> None:
        prev = {p + 1: p for p in range(lo, hi)}
        heap: list = []

        def offer(p):
            q = end[p]
            if q < hi and end[q] - p <= MAX_PIECE:
                piece = table[p, end[q] - p]
                if piece >= 0:
                    heapq.heappush(heap, (int(self.order[piece]), p, int(end[q]), int(q)))

        for p in range(lo, hi):
            offer(p)
        while heap:
            _, p, far, q = heapq.heappop(heap)
            if not alive[p] or end[p] != q or q >= hi or not alive[q] or end[q] != far:
                continue
            alive[q] = False
            end[p] = far
            prev[far] = p
            offer(p)
            if p > lo:
                offer(prev[p])

    def encode(self, texts: list[str]) -> list[bytes]:
        lists, new = [], {}
        for t in texts:
            parts = _segments(t)
            lists.append(parts)
            for p in parts:
                if p not in self.known:
                    new[p] = None
        if len(self.known) + len(new) > WORDS:
            self.known.clear()
            new = {p: None for parts in lists for p in parts}
        words = list(new)
        self.known.update(zip(words, self.segments(words)))
        get = self.known.__getitem__
        return [b"".join(map(get, parts)) for parts in lists]

    def decode(self, ids: np.ndarray) -> str:
        out = b"".join(map(self.text.__getitem__, ids.tolist()))
        text = out.decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def _packed(codes: np.ndarray) -> np.ndarray:
    """Four 16-bit codes to a 64-bit key, the first uppermost."""
    c = codes.reshape(len(codes), -1, 4)
    s = np.uint64(16)
    return ((c[:, :, 0] << s | c[:, :, 1]) << s | c[:, :, 2]) << s | c[:, :, 3]


_SEGMENT = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")


def _segments(text: str) -> list[str]:
    return _SEGMENT.findall((" " + text).replace(" ", SPACE)) if text else []


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids binary): little-endian 32-bit ids of the whole text."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1500):
                part = b.slice(lo, 1500)
                ids = model(path).encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1500):
                part = b.slice(lo, 1500)
                text = [model(path).decode(np.frombuffer(i or b"", "<u4")) for i in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32, n_chars and text_crc32 of the decoded text."""

    def run(batches):
        for b in batches:
            m = model(path)
            for lo in range(0, b.num_rows, 1500):
                part = b.slice(lo, 1500)
                ids = part.column(1).to_pylist()
                text = [m.decode(np.frombuffer(i, "<u4")) for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([zlib.crc32(i) for i in ids], pa.int64()),
                     pa.array([len(t) for t in text], pa.int64()), pa.array([zlib.crc32(t.encode()) for t in text], pa.int64())],
                    ["doc_id", "n_ids", "ids_crc32", "n_chars", "text_crc32"])

    return encode(docs, path).mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, n_chars long, text_crc32 long")
