"""Vector codes, conversation repair and toxicity against plain Python, and their odd cases."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tilelake.llm import codes, repair, toxicity
from tilelake.llm.common import fold, ship
from tilelake.llm.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


# ---- vector codes ----------------------------------------------------------------------------------------------------------

def plain_codes(rows, parts=8, entries=16, rounds=6):
    """rows of (id, vector, label), by the rule and nothing else."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    size = max(1, -(-max(len(v) for _, v, _ in kept) // parts))
    ints = [[int(np.floor(float(x) * 4096)) for x in v] + [0] * (size * parts - len(v)) for _, v, _ in kept]
    first = {}
    for k in sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1])):
        first.setdefault(kept[k][0], ints[k])
    books = [[x[j * size:(j + 1) * size] for x in list(first.values())[:entries]] for j in range(parts)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))
    cut = [[x[j * size:(j + 1) * size] for j in range(parts)] for x in ints]
    for _ in range(rounds):
        for j in range(parts):
            own: dict = {}
            for c in cut:
                own.setdefault(near(c[j], books[j])[1], []).append(c[j])
            for k, vs in own.items():
                books[j][k] = [sum(x) // len(vs) for x in zip(*vs)]
    name = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by_label = [], {}
    for (i, _, lab), c in zip(kept, cut):
        found = [near(c[j], books[j]) for j in range(parts)]
        error = min(sum(d for d, _ in found), codes.MOST)
        by_label[lab] = by_label.get(lab, 0) + error
        out.append([i, "".join(f"{k:02x}" for _, k in found), error, lab])
    return sorted(((i, c, e, min(by_label[lab], codes.MOST), name) for i, c, e, lab in out), key=repr)


def coded(spark, rows, length="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{length}>, label int").repartition(3)
    return sorted((tuple(r) for r in codes.compress(df).collect()), key=repr)


def test_codes_against_plain_python(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.3, 20)], [0, 1, None][i % 3]) for i in rng.permutation(150)]
    rows += [rows[0], (7, [0.5] * 20, 2), (None, [0.1] * 20, 2), (900, None, 1), (901, [1.0, None], 1), (902, [float("nan")] * 20, 1), (903, [float("inf")] * 20, 1), (904, [0.25] * 3, 0), (905, [], 0)]
    rows += [(1000 + k, [0.125, -0.5] * 10, 3) for k in range(100)]
    assert coded(spark, rows) == plain_codes(rows)


def test_codes_of_odd_tables(spark):
    assert coded(spark, []) == []
    few = [(1, [0.5, -0.25], None), (2, [0.5, -0.25], None)]
    assert coded(spark, few) == plain_codes(few)
    huge = [(k, [1e30 * (k + 1), -3e37, 0.5, 2.0**40 * k, 1.0], 1) for k in range(20)]
    huge = [(i, [float(np.float32(x)) for x in v], lab) for i, v, lab in huge]
    assert coded(spark, huge) == plain_codes(huge)
    large = [(k, [2.0**33 + k * 1000.0, 1.0 * k], 1) for k in range(40)]
    assert coded(spark, large, "double") == plain_codes(large)


def test_nearest_is_exact_for_every_size():
    rng = np.random.default_rng(2)
    for p in (1, 2, 3, 5, 8, 13):
        a, b = rng.integers(-40, 40, (60, p)), rng.integers(-40, 40, (16, p))
        b[3] = b[9]
        index, d = codes.nearest(a, b)
        whole = ((a[:, None] - b[None]) ** 2).sum(2)
        assert (index == whole.argmin(1)).all() and (d == whole.min(1)).all()


def test_codes_query_equals_sql(spark):
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{DIR}/embeddings.parquet'")
    want = c.execute(ORACLE_SQL["op11_vector_codes"])
    cols = [d[0] for d in want.description]
    assert sorted(map(tuple, QUERIES["op11_vector_codes"](spark, DIR).select(cols).collect())) == sorted(want.fetchall())


# ---- conversation repair ---------------------------------------------------------------------------------------------------

def plain_repair(rows):
    """rows (turn, role, text) as they come, undamaged or damaged: figures, audit and hash by a search over all edits."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
    fault, seen = [], set()
    for t, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    legal = re.compile(r"(s?(ua)+)?")
    begins = re.compile(r"(s|s?(ua)*u?)?")
    # cheapest first, ties by audit; every whole string of edits and roles is a state
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, k, roles, out = heapq.heappop(heap)
        if (k, roles) in done:
            continue
        done.add((k, roles))
        if k == len(rows) and legal.fullmatch(roles):
            break
        for x in ("user", "assistant"):
            if begins.fullmatch(roles + x[0]) and len(roles) < 2 * len(rows) + 3:
                heapq.heappush(heap, (cost + 2, audit + "I", k, roles + x[0], (*out, f"{x}:")))
        if k < len(rows):
            _, role, text = rows[k]
            heapq.heappush(heap, (cost + 3, audit + "D", k + 1, roles, out))
            if fault[k] not in ("b", "d"):
                more = fault[k] == "t"
                for letter, c, x in (("K", 0, role), ("R", 2, "user"), ("R", 2, "assistant")):
                    if x[:1] and begins.fullmatch(roles + x[:1]):
                        heapq.heappush(heap, (cost + c + more, audit + letter, k + 1, roles + x[:1], (*out, f"{x}:{text}")))
    return (gaps, fault.count("b"), fault.count("d"), fault.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def plain_damage(rows):
    out: dict = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        row = (turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
        own += [row] * (2 if k == 3 else 1)
    return out


def repaired(spark, rows, width=4, damage=True):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit(1)).repartition(3)
    df = repair.damaged(df) if damage else df.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), F.lit(False).alias("gone"))
    found = repair.repair(df).collect()
    assert len(found) == len({r["conv_id"] for r in found})
    return {r["conv_id"]: tuple(r[1:]) for r in found}


def some(rng, conv, n):
    texts = ["Yes.", "no", "", "  \t", "What? ", "Fine!\n", "é.", None, "a b"]
    return [(conv, rng.choice([None, *range(9)]) if rng.random() < 0.2 else k, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), rng.choice(texts)) for k in range(n)]


def test_repair_against_all_edits(spark):
    rng = random.Random(5)
    rows = [r for conv in [None, *range(60)] for r in some(rng, conv, rng.randrange(1, 8))]
    rows += [rows[3], rows[3], (500, 3, "user", "x."), (501, None, None, None)]
    want = {conv: plain_repair(own) for conv, own in plain_damage(rows).items()}
    assert repaired(spark, rows) == want


def test_long_conversation_over_many_ranges(spark):
    """One conversation of most rows is parsed in parts; the parts give what one parse gives."""
    rng = random.Random(6)
    rows = [(9, k, rng.choice(["user", "assistant"]), f"line {rng.randrange(300)}{rng.choice('.. ')}") for k in range(700)] + [r for c in (8, 10) for r in some(rng, c, 6)]
    rows += [(9, 350, "user", "same.")] * 200
    got = repaired(spark, rows, damage=False)
    own = sorted((r for r in rows if r[0] == 9), key=lambda r: (r[1], r[2], hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))
    dicts = []
    for _, turn, role, text in own:
        dicts.append({"turn": turn, "gone": False, "blank": not text.strip(), "truncated": text.rstrip()[-1:] not in (".", "!", "?"), "initial": role[:1], "name": (role, text), "role": role, "text": text})
    r = repair.repair_rows(dicts)
    assert got[9] == tuple(r[k] for k in ("n_gaps", "n_blank", "n_duplicate", "n_truncated", "n_illegal", "n_cost", "audit", "repaired_sha256"))
    assert got[8] == plain_repair([r[1:] for r in rows if r[0] == 8]) and got[10] == plain_repair([r[1:] for r in rows if r[0] == 10])


def test_repair_of_odd_tables(spark):
    assert repaired(spark, []) == {}
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    assert repaired(spark, [(gone, 0, "user", "Hi.")]) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_tables_refuse_other_grammars():
    with pytest.raises(ValueError):
        repair.Tables((("G", ("C",)), ("C", ("T",)), ("C", ("U",)), ("T", ("u",)), ("U", ("u",))))
    with pytest.raises(ValueError):  # what may follow u depends on the bracket below it
        repair.Tables((("G", ("C",)), ("C", ("s", "T", "s")), ("C", ("a", "T", "a")), ("T", ("u",))))
    t = repair.Tables()
    word = lambda s: [st := (0,), *[st := t.advance(st, x) if st else None for x in s]][-1]
    for s, good in (("", True), ("ua", True), ("sua", True), ("suaua", True), ("s", False), ("u", False), ("au", False), ("ss", False), ("uas", False)):
        assert bool((st := word(s)) and t.advance(st, "$")) == good


# ---- toxicity --------------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(3)
    syllables = ["ta", "re", "mo", "li", "an", "so", "ve", "du", "ki", "or"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    bad = ["scoundrel", "blockhead", "nincompoop", "wretched"]
    rows = []
    for i in range(900):
        text = [word() for _ in range(rng.randrange(5, 120))]
        toxic = i % 6 == 0
        for _ in range(rng.randrange(1, 3) if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_toxicity_held_out_and_misspelled(spark, spoken):
    ship(spark)
    more = [(5000, "tare moli scoundrell anso", 1), (5001, "veduki blokhead tare", 1), (5002, "you nincompooop so ve", 1), (5003, "tare moli an", 0), (None, "so an scoundrel", 1), (5004, None, None), (5005, "", None), (5006, "\n\t ", None),
            (5007, "tare mo " * 90_000 + "wretched li an " + "so du " * 90_000, 1), (5008, "x" * 1_200_000, 0)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in [*spoken, *more]] + [(3, spoken[3][1], "y")], "doc_id long, text string, score string").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in [*spoken, *more[:4]]] + [(5, None), (6, 0)], "doc_id long, toxic int")
    got = toxicity.score(docs, labels, fold("doc_id", 5) == 0).collect()
    assert len(got) == len(spoken) + len(more) + 1
    by = {r["doc_id"]: r for r in got}
    held = [(by[i]["predicted"], y) for i, _, y in spoken if by[i]["held_out"]]
    assert len(held) > 100 and sum(p == y for p, y in held) / len(held) > 0.97
    assert all(by[i]["predicted"] == 1 for i in (None, 5007)) and sum(by[i]["predicted"] for i in (5000, 5001, 5002)) >= 2
    assert by[5003]["predicted"] == 0 and len({by[i]["score"] for i in (5004, 5005, 5006)}) == 1 and len({r["score"] for r in got if r["doc_id"] == 3}) == 1
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_toxicity_without_labels(spark, spoken):
    docs = spark.createDataFrame([(i, t) for i, t, _ in spoken[:20]], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r["score"] < 1e-6 for r in toxicity.score(docs, none, fold("doc_id", 5) == 0).collect())
    assert toxicity.score(docs.limit(0), none, fold("doc_id", 5) == 0).count() == 0


def test_score_is_the_mean_of_the_bag_in_the_worst_passage(spoken):
    """scores() against one word and one passage at a time through the softmax."""
    m = toxicity.Model(seed=1)
    margins, bias = m.margins()
    texts = [t for _, t, _ in spoken[:12]] + ["", "one", "Two  words\n", "É 日本 x"]
    for text, got in zip(texts, toxicity.scores(texts, margins.astype(float), bias)):
        words = text.split()
        vectors = []
        for w in words:
            grams, at, n = toxicity.bags([w])
            assert len(at) == 2 and len(grams) == 1 + sum(max(len(w) + 3 - k, 0) for k in (3, 4, 5))
            vectors.append(m.table[grams].mean(0))
        best = [0.0]
        if words:
            starts = range(0, max(1, len(words) - toxicity.WIDTH + toxicity.WIDTH // 2), toxicity.WIDTH // 2)
            best = []
            for s in starts:
                logits = m.soft @ np.mean(vectors[s:s + toxicity.WIDTH], 0) + m.bias
                best.append(logits[1] - logits[0])
        assert abs(1 / (1 + np.exp(-max(best))) - got) < 1e-5


def test_blocks_hold_all_words():
    text = ("ab cde\tf " * 150_000) + "y" * 1_300_000 + " z\n"
    out = list(toxicity.blocks(text))
    assert max(map(len, out)) <= toxicity.BLOCK and "".join("".join(b.split()) for b in out) == "".join(text.split())
    words = [w for b in out for w in b.split()]
    assert words[:450_000] == text.split()[:450_000] and len(words) == 450_000 + 3 + 1
