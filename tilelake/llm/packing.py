"""Best-fit packing of tokenised documents into sequences of a fixed number of tokens.

Documents are tokenised once and cut into pieces; pieces of UNIT tokens or fewer are joined, within a task, to units of at
least UNIT, so that the number of rounds does not depend on how short documents are.  Then, bulk-synchronously:

1. As many sequences open as the tokens (or the pieces of over half a sequence) need at least; each is one gap.
2. Units and gaps are range-sorted together by size.  A sweep in ascending order gives every gap the longest unit before it
   that is still free, which is the unit whose successor the gap is; a conflict for a gap goes by that rank, and the unit
   that loses has the next gap as its successor.  Each range is swept by its own task.  What a range leaves over (units
   with no gap behind them, gaps with no unit before them) is matched between ranges by counting: the numbers left over
   by each range, swept in turn, say which stretch of units meets which stretch of gaps, and the rows meet by rank.
3. Filled gaps shrink or close, and the next round begins.  When hardly any unit finds a gap, further sequences open;
   when those that find none hold less than REST of all tokens, every task packs its share of them best-fit into new sequences.

Null text is an empty document, which still holds its end id and so has one token.  Repeated rows are packed each, a null
id stays null, and ties of length go by row number.  An empty table gives an empty result.  Columns other than the two
named are not read, so their names do not matter.  Texts are tokenised whole, in slices of about 2 MB or one longer text.
"""

import json
import re
import zlib
from bisect import bisect_left, insort
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, text_buffer

CAPACITY, UNIT = 2048, 64
#: Rows that one task sweeps; the share of all tokens that is packed without sweeps; the share of gaps that ends a phase.
ROWS, REST, FEW = 100_000, 0.02, 0.004
_encoders: dict = {}


_RUN = re.compile(r" (?:\s|\Z)")
#: The public pattern by which byte-level BPE vocabularies of this kind split text before they merge.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class _Encoder:
    """Token ids of whole texts, with the vocabulary of a tokenizers file.

    The library tokenizers needs 900 CPU seconds a GB; tiktoken merges by the same ranks (the ids of this vocabulary)
    four times as fast, so the file's vocabulary is handed to it, and tests hold its ids against tokenizers'.

    Text is split before merging, and always before a space that is followed by something other than white space.  So
    a text without white space (or its end) after a space is the concatenation of its space-separated parts.  Parts
    repeat: the distinct ones of a batch are encoded once, and the texts put together from them.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocabulary = file["model"]["vocab"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes written as themselves
        odd = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(odd)}
        ranks = {bytes(map(byte_of.__getitem__, w)): i for w, i in vocabulary.items() if not w.startswith("<|")}
        self.t = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path, self.special = path, [t["content"] for t in file.get("added_tokens", [])]
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for w, i in ranks.items():
            self.bytes[i] = len(w)

    def _special(self, text: str) -> bool:
        return any(w in text for w in self.special)

    def _whole(self, text: str) -> list[int]:
        """Ids of a text taken as it is.  Texts that spell a special token are left to tokenizers, which gives its id."""
        if not self._special(text):
            return self.t.encode_ordinary(text)
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path).encode(text, add_special_tokens=False).ids

    def __call__(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by end_id, and the n + 1 offsets of the texts."""
        n = len(texts)
        whole = np.array([_RUN.search(t) is not None or self._special(t) for t in texts], bool)
        lists = pc.split_pattern(pa.array(["" if w else t for t, w in zip(texts, whole)], pa.large_string()), " ")
        starts = np.asarray(lists.offsets)
        first = np.zeros(int(starts[-1]), bool)
        first[starts[:-1]] = True  # a text's first part has no space before it
        coded = lists.flatten().filter(pa.array(~first)).dictionary_encode()
        words = coded.dictionary
        ids = np.array(self.t.encode_ordinary("".join([" " + w for w in words.to_pylist()])), np.int64)
        ends = np.cumsum(np.asarray(pc.binary_length(words)).astype(np.int64) + 1)
        last = np.searchsorted(np.cumsum(self.bytes[ids]), ends) + 1 if len(words) else np.zeros(0, np.int64)
        heads = [self._whole(t) if w else self.t.encode_ordinary(t.split(" ", 1)[0]) for t, w in zip(texts, whole)]
        size = np.r_[np.diff(np.r_[0, last]), np.fromiter(map(len, heads), np.int64, n)]
        at = np.cumsum(size) - size
        flat = np.r_[ids, np.fromiter(chain.from_iterable(heads), np.int64)].astype("<u4")
        use = np.empty(len(first), np.int64)
        use[~first], use[first] = np.asarray(coded.indices), len(words) + np.arange(n)
        many = size[use]
        total = int(many.sum())
        text_of = np.repeat(np.arange(n), np.diff(starts))
        out = np.full(total + n, end_id, "<u4")
        place = np.arange(total)
        source = np.repeat(at[use] - np.cumsum(many) + many, many) + place
        out[place + np.repeat(text_of, many)] = flat[source]
        return out, np.r_[0, np.cumsum(np.bincount(text_of, weights=many, minlength=n).astype(np.int64) + 1)]


def encoder(path: str) -> _Encoder:
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32.  Only the first piece may be shorter than capacity."""
    def run(batches):
        for batch in batches:
            ids_col, texts = batch.column(0), batch.column(1)
            for lo, hi in slices(text_buffer(texts)[1]):  # by bytes, as 4000 long texts would fill a worker's memory
                part = [t or "" for t in texts[lo:hi].to_pylist()]
                rows, piece, start, length, crc = [], [], [], [], []
                ids, off = encoder(tokenizer)(part, end_id)
                for i, (a, z) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
                    raw = memoryview(ids[a:z]).cast("B")
                    n, at, k = z - a, 0, 0
                    size = n % capacity or capacity
                    while at < n:
                        rows.append(i)
                        piece.append(k)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(raw[4 * at:4 * (at + size)]))
                        at, k, size = at + size, k + 1, capacity
                yield pa.RecordBatch.from_arrays(
                    [ids_col[lo:hi].take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])

    src = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return src.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


_UNITS = "row long, length long, unit long, at long, total long"


def _units(batches):
    """Rows (row, length) with the unit they belong to (named by its first row), their place in it, and, at its first row, its size."""
    for batch in batches:
        row, length = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        short = length <= UNIT
        order = np.r_[np.flatnonzero(~short), np.flatnonzero(short)]
        row, length, short = row[order], length[order], short[order]
        n = int((~short).sum())
        # short pieces join until they are over UNIT
        ends = np.cumsum(length[n:])
        first, k = [*range(n)], 0
        while k < len(ends):
            first.append(n + k)
            k = int(np.searchsorted(ends, (ends[k - 1] if k else 0) + UNIT, "right")) + 1
        first = np.array(first, np.int64)
        total = np.zeros(len(row), np.int64)
        if len(first):
            total[first] = np.add.reduceat(length, first)
        own = np.repeat(first, np.diff(np.r_[first, len(row)]))
        before = np.cumsum(length) - length
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (row, length, row[own], before - before[own], total)], ["row", "length", "unit", "at", "total"])


#: kind 0: a unit (id, size); 1: a gap (id of its sequence, size); 2: a unit with its place (id, other: its sequence, at).
_STATE = "part int, kind int, id long, size long, other long, at long, n long"


def _state(rows: list) -> pa.RecordBatch:
    names = ["part", "kind", "id", "size", "other", "at", "n"]
    types = [pa.int32(), pa.int32(), *[pa.int64()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.broadcast_to(r[k], len(r[2])) for r in rows]), t) for k, t in enumerate(types)], names)


def _sweep(capacity: int):
    """Match units and gaps of one range, which come sorted.  Those left over are numbered: units from the last, gaps from the first."""

    def run(batches):
        t = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if t is None or not t.num_rows:
            return
        part, kind, ids, size = (np.asarray(t.column(c)) for c in ("part", "kind", "id", "size"))
        gap = kind == 1
        height = np.cumsum(np.where(gap, -1, 1))
        floor = np.minimum.accumulate(np.minimum(height, 0))
        depth = height - floor  # free units after each row
        lost = gap & (np.diff(floor, prepend=0) < 0)  # gaps that meet no free unit
        level = np.where(gap, depth + 1, depth)
        on = np.flatnonzero(~lost)
        order = on[np.argsort(level[on], kind="stable")]  # on a level, units and the gaps that take them alternate
        nxt = np.r_[order[1:], -1] if len(order) else order
        pair = (~gap[order]) & (nxt >= 0) & gap[nxt] & (level[order] == level[nxt]) if len(order) else np.zeros(0, bool)
        unit, taker = order[pair], nxt[pair]
        free = np.ones(len(ids), bool)
        free[unit] = free[taker] = False
        rest = size[taker] - size[unit]
        left, spare = np.flatnonzero(free & ~gap)[::-1], np.flatnonzero(free & gap)
        p, open_ = int(part[0]), rest > 0
        yield _state([
            (p, 2, ids[unit], size[unit], ids[taker], capacity - size[taker], 0), (p, 3, ids[taker][open_], rest[open_], 0, 0, 0),
            (p, 0, ids[left], size[left], 0, 0, np.arange(len(left))), (p, 1, ids[spare], size[spare], 0, 0, np.arange(len(spare)))])

    return run


def _meetings(left: dict, spare: dict) -> list[tuple[int, int, int, int, int]]:
    """(part of units, first unit, part of gaps, first gap, number) by which ranges, in turn, give gaps the units nearest before."""
    out, stack = [], []
    for p in sorted({*left, *spare}):
        taken, want = 0, spare.get(p, 0)
        while stack and taken < want:
            q, first, n = stack.pop()
            m = min(n, want - taken)
            out.append((q, first, p, taken, m))
            taken += m
            if m < n:
                stack.append((q, first + m, n - m))
        if left.get(p):
            stack.append((p, 0, left[p]))
    return out


def _best_fit(capacity: int):
    """A share of the units that are left, packed into sequences of its own."""

    def run(batches):
        for batch in batches:
            ids, size = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            gaps: list[tuple[int, int]] = []  # (size, number of the sequence), sorted
            other, at = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
            opened = []
            for k in np.lexsort((ids, -size)).tolist():
                n = int(size[k])
                j = bisect_left(gaps, (n, -1))
                if j == len(gaps):
                    gaps.append((capacity, len(opened)))
                    opened.append(-2 - int(ids[k]))  # named by its first unit
                    j = len(gaps) - 1
                room, s = gaps.pop(j)
                other[k], at[k] = opened[s], capacity - room
                if room > n:
                    insort(gaps, (room - n, s))
            yield _state([(0, 2, ids, size, other, at, 0)])

    return run


def seats(units: DataFrame, capacity: int = CAPACITY, rows: int = ROWS) -> DataFrame:
    """(id, other, at): the sequence of every unit (id, size; sizes below capacity), and its place there."""
    spark = units.sparkSession
    none = F.lit(0).cast("long")
    units = units.select(F.lit(0).alias("part"), F.lit(0).alias("kind"), "id", "size", none.alias("other"), none.alias("at"), none.alias("n"))
    gaps = lambda lo, hi: spark.range(lo, hi).select(F.lit(0).alias("part"), F.lit(1).alias("kind"), "id", F.lit(capacity).cast("long").alias("size"), none.alias("other"), none.alias("at"), none.alias("n"))
    count, tokens, large = units.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.count_if(F.col("size") * 2 > capacity)).first()
    left, total, opened, placed, open_gaps = count, tokens, 0, [], 0
    state, stuck = units, True
    while left and not (stuck and opened and total <= REST * tokens):
        if stuck:
            many = max(-(-total // capacity), large)
            state, opened, open_gaps = state.unionByName(gaps(opened, opened + many)), opened + many, open_gaps + many
        tasks = -(-(left + open_gaps) // rows)
        ranged = state.repartitionByRange(tasks, "size", "kind", "id").sortWithinPartitions("size", "kind", "id").withColumn("part", F.spark_partition_id())
        swept = cut(ranged.mapInArrow(_sweep(capacity), _STATE))
        # one row for each range
        told = {(r["part"], r["kind"]): r["n"] for r in swept.where("kind < 2").groupBy("part", "kind").agg(F.count("*").alias("n")).collect()}
        meet = _meetings(*({p: n for (p, k), n in told.items() if k == kind} for kind in (0, 1)))
        placed.append(swept.where("kind = 2"))
        state = swept.where("kind = 0 or kind = 1 or kind = 3").withColumn("kind", F.when(F.col("kind") == 0, 0).otherwise(1))
        if meet:
            met = F.broadcast(spark.createDataFrame([(i, *m) for i, m in enumerate(meet)], "m long, p int, u long, q int, g long, k long"))
            rest = swept.where("kind < 2").join(met, ((F.col("kind") == 0) & (F.col("part") == F.col("p")) & (F.col("n") >= F.col("u")) & (F.col("n") < F.col("u") + F.col("k")))
                                                | ((F.col("kind") == 1) & (F.col("part") == F.col("q")) & (F.col("n") >= F.col("g")) & (F.col("n") < F.col("g") + F.col("k"))), "left")
            rank = F.col("n") - F.when(F.col("kind") == 0, F.col("u")).otherwise(F.col("g"))
            side = lambda kind, c: rest.where((F.col("kind") == kind) & F.col("m").isNotNull()).select("m", rank.alias("r"), F.col("id").alias(c), F.col("size").alias(c + "_size"))
            pair = cut(side(0, "unit").join(side(1, "gap"), ["m", "r"]))
            row = lambda kind, i, size, other, at: pair.select(F.lit(0).alias("part"), F.lit(kind).alias("kind"), F.col(i).alias("id"), size.alias("size"), other.alias("other"), at.alias("at"), none.alias("n"))
            placed.append(row(2, "unit", F.col("unit_size"), F.col("gap"), capacity - F.col("gap_size")))
            shrunk = row(1, "gap", F.col("gap_size") - F.col("unit_size"), none, none).where("size > 0")
            alone = rest.where(F.col("m").isNull()).select(*swept.columns)
            state = cut(alone.unionByName(shrunk).unionByName(swept.where("kind = 3").withColumn("kind", F.lit(1))))
        before = left
        left, total, large, open_gaps = state.agg(F.count_if(F.col("kind") == 0), F.coalesce(F.sum(F.when(F.col("kind") == 0, F.col("size"))), F.lit(0)),
                                                  F.count_if((F.col("kind") == 0) & (F.col("size") * 2 > capacity)), F.count_if(F.col("kind") == 1)).first()
        stuck = before - left <= FEW * open_gaps
    if left:
        last = state.where("kind = 0").select("id", "size").repartition(-(-left // rows), "id")
        placed.append(last.mapInArrow(_best_fit(capacity), _STATE))
    out = units if not placed else placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return out.select("id", "other", "at")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, rows: int = ROWS) -> DataFrame:
    """pieces() with sequence_id and offset; no sequence holds more than capacity tokens, and none has a hole."""
    made = cut(pieces(docs, tokenizer, capacity, end_id).withColumn("row", F.monotonically_increasing_id()))
    units = cut(made.where(F.col("length") < capacity).select("row", "length").mapInArrow(_units, _UNITS))
    seat = seats(units.where("total > 0").select(F.col("unit").alias("id"), F.col("total").alias("size")), capacity, rows)
    where = units.select("row", "unit", F.col("at").alias("inside")).join(seat.withColumnRenamed("id", "unit"), "unit").select("row", "other", (F.col("at") + F.col("inside")).alias("offset"))
    out = ["doc_id", "piece", "start", "length", "ids_crc32"]
    seated = made.join(where, "row").select(*out, F.col("other").alias("sequence_id"), "offset")
    whole = made.where(F.col("length") == capacity).select(*out, (F.lit(-2 - 2**62) - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return seated.unionByName(whole)
