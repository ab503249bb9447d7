"""Structure faults of conversations, and their cheapest repair by generalised LR parsing over the grammar of roles.

Grammar.  A conversation is empty, or an optional system turn and then pairs of a user's and an assistant's turn: C -> (empty) | T |
s T, T -> P | T P, P -> u a, over the initials of the roles.  SLR tables are built from these productions (Tables).

Repair.  Rows are read in order.  Each one is kept, given the role that the parse needs (R), or deleted (D); empty turns are
inserted (I) wherever that helps.  All of these are followed at once on a graph-structured stack: a level for each row, a node
for each state on top of a stack, a link to the node and letters it came by.  Stacks with equal tops are merged, and the one of the
least (cost, audit) stays; Tables proves for the grammar that equal tops accept the same continuations, so nothing is lost.  Audits
of one level all end in the letter of its row, so none is the beginning of another, and comparing them needs only the rank of the
node below and the letters added: a row takes constant time, however long the conversation is.

Spread.  Rows are range-sorted by conversation, turn, role, MD5 of text and place, so a conversation of any size is spread over as many
tasks as it needs, copies of one row too.  Conversations inside a task's range are repaired at once.  Those at its ends may go
on in the next range: each range's part of them is parsed from every state on top, which gives a small matrix of (cost, audit); the
matrices of a conversation are multiplied in order, and then each part knows its edits.  Repaired text is hashed as a stream in
order (SHA-256 can only be taken in order: this is the one step that takes a large conversation's lines through one task, and it
keeps none of them).

Cases.  A null conv_id is a conversation of its own; a null turn comes first and counts in no gap; null role or text is one space.
Rows of one turn are in order of role, then of the MD5 of the text.  Equal rows: all but the first are duplicates, unless they are
blank.  A role that starts with none of s, u, a can only be rerolled or deleted.  An empty role has no initial.  A conversation without
rows has zeros, an empty audit and the hash of the empty string; an empty table gives no rows.  Other columns are not read.
"""

import hashlib
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship, shuffle_width

GRAMMAR = (("G", ("C",)), ("C", ()), ("C", ("T",)), ("C", ("s", "T")), ("T", ("P",)), ("T", ("T", "P")), ("P", ("u", "a")))
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
END = "$"


class Tables:
    """SLR(1) tables of a grammar whose first production is its start, and what its stacks do, by the state on top."""

    def __init__(self, grammar=GRAMMAR):
        self.grammar, heads = grammar, {h for h, _ in grammar}
        empty, first, follow = set(), {h: set() for h in heads}, {h: set() for h in heads}
        follow[grammar[0][0]].add(END)
        starts = lambda x: first[x] if x in heads else {x}
        size = -1
        while size != (size := len(empty) + sum(map(len, [*first.values(), *follow.values()]))):
            for head, body in grammar:
                if all(x in empty for x in body):
                    empty.add(head)
                for x in body:
                    first[head] |= starts(x)
                    if x not in empty:
                        break
                for i, x in enumerate(body):
                    if x in heads:
                        rest = body[i + 1:]
                        for y in rest:
                            follow[x] |= starts(y)
                            if y not in empty:
                                break
                        else:
                            follow[x] |= follow[head]

        def closed(items):
            items, todo = set(items), list(items)
            while todo:
                p, dot = todo.pop()
                body = grammar[p][1]
                for q, (head, _) in enumerate(grammar):
                    if dot < len(body) and head == body[dot] and (q, 0) not in items:
                        items.add((q, 0))
                        todo.append((q, 0))
            return frozenset(items)

        states, self.moves, self.reductions = [closed({(0, 0)})], [], []
        for items in states:
            moves: dict[str, set] = {}
            for p, dot in items:
                if dot < len(grammar[p][1]):
                    moves.setdefault(grammar[p][1][dot], set()).add((p, dot + 1))
            row = {}
            for x, kernel in sorted(moves.items()):
                target = closed(kernel)
                if target not in states:
                    states.append(target)
                row[x] = states.index(target)
            done = {}
            for p, dot in sorted(items):
                if dot == len(grammar[p][1]):
                    for x in follow[grammar[p][0]]:
                        if x in done or x in row:
                            raise ValueError("the grammar is not SLR(1)")
                        done[x] = p
            self.moves.append(row)
            self.reductions.append(done)
        terminals = sorted({x for _, b in grammar for x in b} - heads)
        #: top -> terminal -> top, and the tops that may end; a stack is followed with all that lies below
        self.step: dict[int, dict[str, int]] = {}
        self.ends: dict[int, bool] = {}
        todo, seen = [(0,)], {(0,)}
        while todo:
            stack = todo.pop()
            after = {x: self.advance(stack, x) for x in terminals}
            mine = {x: s[-1] for x, s in after.items() if s}
            over = self.advance(stack, END) is not None
            if self.step.setdefault(stack[-1], mine) != mine or self.ends.setdefault(stack[-1], over) != over:
                raise ValueError("stacks with equal tops differ in what they accept")
            for s in after.values():
                if s and s not in seen:
                    seen.add(s)
                    todo.append(s)

    def advance(self, stack, x):
        """The stack after terminal x, reductions first; None if x cannot come."""
        while True:
            if x in self.moves[stack[-1]]:
                return (*stack, self.moves[stack[-1]][x])
            p = self.reductions[stack[-1]].get(x)
            if p is None:
                return None
            if p == 0:
                return stack
            head, body = self.grammar[p]
            stack = stack[:len(stack) - len(body)]
            stack = (*stack, self.moves[stack[-1]][head])

    def inserted(self, top: int) -> list[tuple[int, int]]:
        """(n, top): what n inserted turns lead to, for every top that they reach."""
        out, level, n = [(0, top)], [top], 0
        while level:
            n += 1
            level = sorted({self.step[t][x] for t in level for x in ROLES if x in self.step[t]} - {t for _, t in out})
            out += [(n, t) for t in level]
        return out


@cache
def tables() -> Tables:
    return Tables()


@cache
def actions(initial: str, drop: bool, truncated: bool) -> dict[int, list[tuple[int, int, str]]]:
    """For each top what a row may do: (cost, letters, top); the least (cost, letters) to each top."""
    t, out = tables(), {}
    for top in t.step:
        best = {top: (DELETE, "D")}
        for n, at in () if drop else t.inserted(top):
            choices = [(0, "K", initial)] * (initial in t.step[at]) + [(REROLE, "R", x) for x in ROLES if x in t.step[at]]
            for cost, letter, x in choices:
                new = (cost + INSERT * n + TRUNCATED * truncated, "I" * n + letter)
                to = t.step[at][x]
                best[to] = min(best.get(to, new), new)
        out[top] = [(c, w, to) for to, (c, w) in best.items()]
    return out


def parse(rows, start: int = 0):
    """The levels of the stack over rows (initial, drop, truncated): each {top: (cost, rank, node below, letters)}."""
    level = {start: (0, 0, None, "")}
    levels = [level]
    for row in rows:
        reached = actions(*row)
        new: dict[int, tuple] = {}
        for top, (cost, rank, _, _) in level.items():
            for c, letters, to in reached[top]:
                at = (cost + c, rank, top, letters)
                if to not in new or (at[0], rank, letters) < (new[to][0], new[to][1], new[to][3]):
                    new[to] = at
        order = {to: k for k, to in enumerate(sorted(new, key=lambda to: (new[to][1], new[to][3])))}
        level = {to: (cost, order[to], below, letters) for to, (cost, _, below, letters) in new.items()}
        levels.append(level)
    return levels


def back(levels, top: int) -> list[str]:
    """Letters of each row on the way to a top of the last level."""
    out = []
    for level in reversed(levels[1:]):
        _, _, below, letters = level[top]
        out.append(letters)
        top = below
    return out[::-1]


def ending(tops) -> tuple[int, int]:
    """(top, turns to insert at the end) of the cheapest whole parse; tops: {top: (cost, something that orders audits)}."""
    t = tables()
    ways = [(cost + INSERT * n, order, "I" * n, top, n) for top, (cost, order) in tops.items() for n, at in t.inserted(top) if t.ends[at]]
    return min(ways)[3:]


def lines(rows, letters, top: int = 0):
    """Repaired `role:text` of each row (role, text, initial) in a list of its own, inserted turns before it."""
    t = tables()
    for (role, text, initial), edits in zip(rows, letters):
        out = []
        for e in edits:
            if e != "D":
                x = initial if e == "K" else next(x for x in ROLES if x in t.step[top])
                out.append(f"{role}:{text}" if e == "K" else f"{ROLES[x]}:{text if e == 'R' else ''}")
                top = t.step[top][x]
        yield out, top


def damaged(conv: DataFrame) -> DataFrame:
    """Rows with their faults made, by crc32 of `conv_id:turn` modulo 20; a row that is to be dropped keeps only its conv_id."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    df = conv.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), kind.alias("_kind"),
                     F.when(kind == 4, F.lit("user")).otherwise(text("role")).alias("role"),
                     F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text")).alias("text"))
    df = df.withColumn("_copy", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    gone = F.col("_kind") == 0
    return df.select("conv_id", *(F.when(~gone, F.col(c)).alias(c) for c in ("turn", "role", "text")), gone.alias("gone"))


def faults(rows: DataFrame) -> DataFrame:
    """rows with what each shows by itself: blank, truncated, initial, and the name of its role and text (name)."""
    body = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    return rows.withColumn("blank", ~F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("truncated", ~F.substring(body, -1, 1).isin(".", "!", "?")).withColumn(
        "initial", F.substring("role", 1, 1)).withColumn("name", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))))


_IN = ("conv_id", "turn", "role", "text", "gone", "blank", "truncated", "initial", "name")
_LEFT = "part int, seq long, turn long, role string, text string, gone boolean, blank boolean, truncated boolean, initial string, name binary"
_FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_RESULT = "conv_id long, " + ", ".join(f"n_{c} long" for c in _FIGURES) + ", audit string, repaired_sha256 string"


def _counts(rows, doubles):
    """Turns and faults of rows in order: least turn, greatest, distinct ones, blank, duplicate, truncated, illegal pairs, initials at the ends."""
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    initials = [r["initial"] for r in rows]
    return [min(turns, default=None), max(turns, default=None), len(set(turns)), sum(r["blank"] for r in rows), sum(doubles), sum(r["truncated"] and not (r["blank"] or d) for r, d in zip(rows, doubles)),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))]


def _kinds(rows, doubles):
    return [(r["initial"], r["blank"] or d, r["truncated"] and not (r["blank"] or d)) for r, d in zip(rows, doubles)]


def repair_rows(rows: list[dict]) -> dict:
    """Figures, audit and hash of one conversation's rows in order."""
    rows = [r for r in rows if not r["gone"]]
    seen, doubles = set(), []
    for r in rows:
        doubles.append(r["name"] in seen and not r["blank"])
        seen.add(r["name"])
    low, high, distinct, *figures = _counts(rows, doubles)
    levels = parse(_kinds(rows, doubles))
    top, n = ending({top: (v[0], v[1]) for top, v in levels[-1].items()})
    letters = back(levels, top)
    out, at = [], 0
    for more, at in lines([(r["role"], r["text"], r["initial"]) for r in rows], letters):
        out += more
    out += [f"{role}:" for role in _added(at, n)]
    return {"n_gaps": high - low + 1 - distinct if distinct else 0, **dict(zip(("n_blank", "n_duplicate", "n_truncated", "n_illegal"), figures)), "n_cost": levels[-1][top][0] + INSERT * n,
            "audit": "".join(letters) + "I" * n, "repaired_sha256": hashlib.sha256("\n".join(out).encode()).hexdigest()}


def _added(top: int, n: int) -> list[str]:
    t, out = tables(), []
    for _ in range(n):
        x = next(x for x in ROLES if x in t.step[top])
        out.append(ROLES[x])
        top = t.step[top][x]
    return out


def _inner(batches):
    """Results of the conversations inside a sorted partition; the rows of those at its ends, numbered."""
    names, part = ("conv_id", *_IN[1:]), TaskContext.get().partitionId()
    whole = pa.schema([("conv_id", pa.int64()), *((f"n_{c}", pa.int64()) for c in _FIGURES), ("audit", pa.string()), ("repaired_sha256", pa.string()), ("part", pa.int32()), ("seq", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()),
                       ("gone", pa.bool_()), ("blank", pa.bool_()), ("truncated", pa.bool_()), ("initial", pa.string()), ("name", pa.binary())])
    held: list[dict] = []
    seq, first = 0, True

    def left(rows):
        nonlocal seq
        out = []
        for r in rows:
            out.append({**r, "part": part, "seq": seq})
            seq += 1
        return out

    for b in batches:
        out = []
        for r in b.select(list(names)).to_pylist():
            if held and (held[0]["conv_id"] != r["conv_id"]):
                out += left(held) if first else [{"conv_id": held[0]["conv_id"], **repair_rows(held)}]
                held, first = [], False
            held.append(r)
            if first and len(held) >= 1000:  # rows at the lower end are passed on as they come
                out += left(held[:-1])
                held = held[-1:]
        if out:
            yield pa.RecordBatch.from_pylist(out, whole)
    if held:
        yield pa.RecordBatch.from_pylist(left(held), whole)


def _matrix(t):
    """One range's part of a conversation, parsed from every top: figures, and the way (cost, audit) from each top to each."""
    rows = t.to_pylist()
    rows.sort(key=lambda r: r["seq"])
    kept = [r for r in rows if not r["gone"]]
    kinds = _kinds(kept, [r["double"] for r in kept])
    ways = []
    for start in tables().step:
        levels = parse(kinds, start)
        ways += [{"start": start, "top": top, "cost": v[0], "audit": back(levels, top)} for top, v in levels[-1].items()]
    low, high, distinct, *figures = _counts(kept, [r["double"] for r in kept])
    return rows[0]["conv_id"], rows[0]["part"], ways, [low, high, distinct, *figures], kept


_WAY = "array<struct<start:int,top:int,cost:long,audit:array<string>>>"


def _part(t):
    conv, part, ways, numbers, kept = _matrix(t)
    ends = [kept[0], kept[-1]] if kept else []
    row = {"conv_id": conv, "part": part, "ways": ways, "numbers": numbers, "turns": [r["turn"] for r in ends], "initials": [r["initial"] for r in ends]}
    kind = pa.struct([("start", pa.int32()), ("top", pa.int32()), ("cost", pa.int64()), ("audit", pa.list_(pa.string()))])
    return pa.Table.from_pylist([row], pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("ways", pa.list_(kind)), ("numbers", pa.list_(pa.int64())), ("turns", pa.list_(pa.int64())), ("initials", pa.list_(pa.string()))]))


def _joined(t):
    """The parts of one conversation multiplied in order: its figures, and a row for each part with its start and its letters."""
    parts = sorted(t.to_pylist(), key=lambda r: r["part"])
    tops = {0: (0, "")}
    links, total, distinct, low, high = [], [0] * 4, 0, None, None
    last = None
    for p in parts:
        new = {}
        for w in p["ways"]:
            if w["start"] in tops:
                cost, audit = tops[w["start"]]
                way = (cost + w["cost"], audit + "".join(w["audit"]), w["start"])
                new[w["top"]] = min(new.get(w["top"], way), way)
        links.append({top: start for top, (_, _, start) in new.items()})
        tops = {top: v[:2] for top, v in new.items()}
        a, z, n, *figures = p["numbers"]
        total = [x + y for x, y in zip(total, figures)]
        if p["initials"]:
            total[3] += last is not None and last[1] + p["initials"][0] not in ("su", "ua", "au")
            # parts are in order of turns, nulls first: of equal turns only those at a border are counted twice
            distinct += n - (last is not None and last[0] is not None and last[0] == p["turns"][0])
            last = (p["turns"][1], p["initials"][1])
        low, high = (f([x for x in pair if x is not None], default=None) for f, pair in ((min, (low, a)), (max, (high, z))))
    top, n = ending(tops)
    cost, audit = tops[top]
    rows, end = [], top
    for p, link in zip(reversed(parts), reversed(links)):
        start = link[top]
        rows.append({"conv_id": p["conv_id"], "part": p["part"], "start": start, "letters": next(w["audit"] for w in p["ways"] if (w["start"], w["top"]) == (start, top)), "added": []})
        top = start
    rows[0]["added"] = [f"{x}:" for x in _added(end, n)]
    figures = [high - low + 1 - distinct if distinct else 0, *total, cost + INSERT * n]
    rows[0] |= {"figures": figures, "audit": audit + "I" * n}
    return pa.Table.from_pylist(rows, pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("start", pa.int32()), ("letters", pa.list_(pa.string())), ("added", pa.list_(pa.string())), ("figures", pa.list_(pa.int64())), ("audit", pa.string())]))


def _spoken(key, rows, edits):
    """Repaired lines of one part, with their place."""
    kept = sorted((r for r in rows.to_pylist() if not r["gone"]), key=lambda r: r["seq"])
    e = edits.to_pylist()[0]
    out = [{"seq": r["seq"], "lines": more} for r, (more, _) in zip(kept, lines([(r["role"], r["text"], r["initial"]) for r in kept], e["letters"], e["start"]))]
    out.append({"seq": 2**62, "lines": e["added"], "figures": e["figures"], "audit": e["audit"]})
    out = [{"conv_id": e["conv_id"], "part": e["part"], "figures": None, "audit": None} | r for r in out]
    return pa.Table.from_pylist(out, pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("lines", pa.list_(pa.string())), ("figures", pa.list_(pa.int64())), ("audit", pa.string())]))


def _hashed(batches):
    """A result for each conversation of a sorted partition, its lines hashed as they come."""
    schema = pa.schema([("conv_id", pa.int64()), *((f"n_{c}", pa.int64()) for c in _FIGURES), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    state = None
    for b in batches:
        out = []
        for r in b.to_pylist():
            state = state or [hashlib.sha256(), True]
            for x in r["lines"]:
                state[0].update(x.encode() if state[1] else b"\n" + x.encode())
                state[1] = False
            if r["figures"] is not None:  # the last row of a conversation
                out.append({"conv_id": r["conv_id"], **{f"n_{c}": v for c, v in zip(_FIGURES, r["figures"])}, "audit": r["audit"], "repaired_sha256": state[0].hexdigest()})
                state = None
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)


def _across(left: DataFrame) -> DataFrame:
    """Results of conversations whose rows (conv_id, part, seq, ...) stand in one or more ranges."""
    first = left.groupBy("conv_id", "name").agg(F.min(F.struct("part", "seq")).alias("first")).select(F.col("conv_id").alias("_c"), F.col("name").alias("_n"), "first")
    # a row of no name (dropped) has no first one
    rows = left.join(first, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("name") == F.col("_n")), "left").withColumn(
        "double", F.coalesce((F.struct("part", "seq") > F.col("first")) & ~F.col("blank"), F.lit(False))).drop("_c", "_n", "first")
    rows = cut(rows)
    parts = cut(rows.groupBy("conv_id", "part").applyInArrow(_part, f"conv_id long, part int, ways {_WAY}, numbers array<long>, turns array<long>, initials array<string>"))
    edits = cut(parts.groupBy("conv_id").applyInArrow(_joined, "conv_id long, part int, start int, letters array<string>, added array<string>, figures array<long>, audit string"))
    spoken = rows.groupBy("conv_id", "part").cogroup(edits.groupBy("conv_id", "part")).applyInArrow(_spoken, "conv_id long, part int, seq long, lines array<string>, figures array<long>, audit string")
    return spoken.repartition(shuffle_width(left.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(_hashed, _RESULT)


def repair(rows: DataFrame) -> DataFrame:
    """The report of each conversation of rows (conv_id, turn, role, text, gone): faults, gaps, cheapest repair and its hash."""
    spark = rows.sparkSession
    ship(spark)
    order = ("conv_id", "turn", "role", "name", "_place")
    df = faults(rows).withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order).select(*_IN)
    found = cut(df.mapInArrow(_inner, f"{_RESULT}, {_LEFT}"))
    done = found.where("part is null").select("conv_id", *(f"n_{c}" for c in _FIGURES), "audit", "repaired_sha256")
    left = found.where("part is not null").select("conv_id", *(c.split()[0] for c in _LEFT.split(", ")))
    return done.unionByName(_across(left)).select("conv_id", *(F.col(f"n_{c}").alias(c) for c in _FIGURES), "audit", "repaired_sha256")
