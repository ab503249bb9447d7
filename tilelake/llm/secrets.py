"""Secrets in texts: candidates by pattern, false positives removed by a random forest; DataFrame functions only.

Candidates are all values of a text that follow a key (`password=`, `"token": "`, `pwd = `), all keys of known form (AKIA, web
tokens), all values of other assignments, and all other runs of eight or more characters of keys with a digit; a word may hold
many.  Their features are native expressions over the value and its neighbours: length, shares of
character classes, character transitions, dictionary coverage, path-like shape and neighbouring words.  The forest is
grown in numpy on a bounded table of labelled findings (before, word, after, secret) and flattened to arrays of
nodes, along which an expression walks inside the projection that reads the text: no shuffle and no Python on the executors.

Labelled findings are a parameter; `labelled_findings()` makes the default table by rule, of the kinds of keys that services
issue, and of the kinds of text that is taken for them.  Null and empty text has no findings.  A value that occurs several times in
a text is one finding for each occurrence; repeated rows, also with equal ids, give theirs each; a forest whose trees are
divided evenly (a tie at the threshold) calls a candidate a secret.  scan() reads doc_id and text only; redact() keeps
every column, whatever its name.  An empty table gives no rows.  The patterns read a text once from left to right and take no
second look at what they have passed, so an unbroken word of megabytes takes time in proportion to its length.
"""

import string

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled

TREES, DEPTH, LEAF = 24, 7, 3
KEYS = "pass|pwd|secret|token|api.?key|access.?key|auth|credential|private"
PLAIN = "commit|sha|hash|uuid|version|build|order|phone|tel|call|card|isbn|id|ref|checksum|example|sample|dummy|placeholder"
KEY = rf"(?i:{KEYS})[A-Za-z0-9_.\-]{{0,40}}+(?:\\?[\"'])?[ \t]{{0,8}}+(?:=>|:=|[=:]{{1,2}}|>)[ \t]{{0,8}}+(?:(?i:bearer|basic)[ ]{{1,4}})?+"
# named groups k.: what stands before a value; v.: the value
CANDIDATE = "|".join((
    rf'(?=[AaCcPpSsTt])(?=(?i:{KEYS}))(?:(?<ka>{KEY}\\")(?<va>[^"\\\r\n]{{3,}}+)(?=\\")', rf'(?<kb>{KEY}")(?<vb>(?=[^"\r\n]{{3}})(?:[^"\\\r\n]++|\\[^\r\n]){{1,400}}+)(?=")',
    rf"(?<kc>{KEY}')(?<vc>[^'\r\n]{{3,}}+)(?=')", rf"(?<kd>{KEY}[\"'(]?)(?<vd>[^\s\"'<>{{}}(),;&]{{2,}}[A-Za-z0-9+/_=\-]))",
    r"(?<ve>(?=[Ae])(?<![A-Za-z0-9])(?:A[KS]IA[A-Z0-9]{12,}|eyJ[A-Za-z0-9_\-]{5,}(?:\.[A-Za-z0-9_\-]+){1,4}))",
    rf"(?<kf>(?<![A-Za-z_])(?=[A-Za-z_]{{3,}}+[\"']?[=:])(?![A-Za-z_]*(?i:{KEYS}))[A-Za-z_]{{3,}}+[\"']?[=:][\"']?)(?<vf>(?!//)(?:(?!(?i:{KEYS}))[^\s\"'?&=,;{{}}<>]){{4,}}[A-Za-z0-9+/_\-])",
    rf"(?<vg>(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*+[0-9])(?=[A-Za-z0-9+/_\-]{{8}})(?![A-Za-z0-9+/_\-]{{0,80}}{KEY})[A-Za-z0-9+/_\-]{{8,}})",
    r"(?<kh>://[^\s/:@]++:)(?<vh>[^\s/@:]{3,}+)(?=@)"))
# noncharacters that part the pieces of a text; in a text itself MARK is written ESCAPE 0 and ESCAPE is written ESCAPE 1
MARK, ESCAPE = "\ufdd0", "\ufdd1"
BEFORE_VALUE = rf"{KEY}[\\\"'(]*$"
# A fixed list of common words for dictionary coverage; another one can be given.
DICTIONARY = ("the and for that with this from have you not are was but they his her she will one all would there their what "
              "out about who get which when make can like time just him know take people into year your good some could them see "
              "other than then now look only come its over think also back after use two how our work first well way even new "
              "want because any these give day most very been has had more where does should between under through great world "
              "house place water right small large name home hand number part sound long little show every live found answer study "
              "still learn plant cover food sun four thought let keep eye never last door city tree cross farm hard start might "
              "story saw far sea draw left late run while press close night real life few open seem together next white children "
              "pass word change user test admin value data file sample mail com net org www login server host local page index "
              "image version order phone street title note city lang list item type code text line key table date class true false").split()
# over a finding x: the value v in the word w, after the text p (b without the start of w) and before the words a
FEATURES = {
    "n": "length(x.v)",
    "digits": "regexp_count(x.v, '[0-9]') / length(x.v)",
    "upper": "regexp_count(x.v, '[A-Z]') / length(x.v)",
    "vowels": "regexp_count(x.v, '[aeiouAEIOU]') / length(x.v)",
    "steps": "regexp_count(x.v, '[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])|[a-z](?=[A-Z])|[A-Z](?=[a-z])') / length(x.v)",
    "pairs": "regexp_count(lower(x.v), '(?=(?:th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ch|de|le|ou|ei|ie))') / length(x.v)",
    "kinds": "size(array_distinct(split(x.v, ''))) / length(x.v)",
    "known": f"1 - length(regexp_replace(lower(x.v), '{'|'.join(sorted(DICTIONARY, key=len, reverse=True))}', '')) / length(x.v)",
    "hex": "if(x.v rlike '^[0-9a-f]+$', 1, 0)",
    "number": "if(x.v rlike '^[0-9+/_-]+$', 1, 0)",
    "prefix": "if(x.v rlike '^(AKIA|ASIA|gh[pousr]_|xox[baprs]-|sk_|pk_|glpat-|AIza|eyJ)', 1, 0)",
    "key": "if(x.p rlike {before_value}, 1, 0)",
    "near": f"if(x.b rlike '(?i)(?:{KEYS})', 1, 0)",
    "assigned": "if(x.b rlike '[=:][ ]*$' or x.w rlike '[=:]', 1, 0)",
    "plain": f"if(concat(x.b, ' ', x.a) rlike '(?i)(?:^|[^a-z])(?:{PLAIN})(?:[^a-z]|$)', 1, 0)",
    "path": "if(x.w rlike '/[^/]+/' or x.w rlike '://' or x.w rlike '[.][a-z]{2,4}$', 1, 0)",
    "mail": "if(x.w rlike '@|[.].*[.]', 1, 0)",
    "quoted": "if(x.w rlike '[\"]' or x.p rlike '[\"\\']$', 1, 0)",
    "url": "if(x.p rlike '://[^/ ]*:$', 1, 0)",
    "stand_in": "if(lower(x.v) rlike '^(x+|[*]+|[.]+)$|your|change.?me|example|placeholder|redacted|dummy|[$]|^(null|none|true|false|nil|undefined|required|optional|string|str)$', 1, 0)",
}


def labelled_findings(n: int = 4000, seed: int = 5) -> list[tuple[str, str, str, int]]:
    """(before, word, after, secret) made by rule: keys as services issue them and as people set them, and look-alikes."""
    rng = np.random.default_rng(seed)
    pick = lambda s, k: "".join(rng.choice(list(s), k))
    one = lambda *s: s[rng.integers(len(s))]
    span = lambda a, z: int(rng.integers(a, z))
    lower, digits, hexes = string.ascii_lowercase, string.digits, "0123456789abcdef"
    alnum, upper = string.ascii_letters + digits, string.ascii_uppercase + digits
    sounds = [c + v for c in "bcdfghklmnprstvw" for v in "aeiou"] + ["th", "er", "on", "an", "in", "st", "ion", "ung", "eau", "que"]
    word = lambda: one(one(*DICTIONARY), "".join(one(*sounds) for _ in range(span(1, 5))))
    key = lambda: one("password", "passwd", "pwd", "passphrase", "secret", "token", "api_key", "apikey", "access_key", "auth_token", "client_secret", "private_key", "credential")
    name = lambda: one("title", "name", "note", "class", "id", "page", "width", "color", "lang", "city", "next", "sort", "level", "count", word())
    phrase = lambda: one("", "", "-", "_").join(word() for _ in range(span(2, 5))) + one("", "", pick(digits, span(1, 5)))
    chosen = lambda: one(pick(alnum, span(6, 30)), pick(alnum + "!#%^", span(8, 24)), pick(lower + digits, span(6, 16)), phrase(), pick(lower, span(4, 9)) + pick(digits, span(2, 5)))
    issued = lambda: one(
        lambda: one("AKIA", "ASIA") + pick(upper, 16), lambda: one("ghp_", "gho_", "ghs_") + pick(alnum, 36), lambda: "glpat-" + pick(alnum, 20),
        lambda: one("sk_live_", "pk_live_", "sk_test_") + pick(alnum, 24), lambda: one("xoxb-", "xoxp-") + pick(digits, 11) + "-" + pick(alnum, 24),
        lambda: "AIza" + pick(alnum + "_-", 35), lambda: "eyJ%s.eyJ%s.%s" % tuple(pick(alnum + "_-", span(12, 60)) for _ in "abc"))()
    quoted = lambda v: one("%s", "'%s'", '"%s"') % v
    stop = lambda: one("", "", "", pick(string.punctuation.replace("=", ""), span(1, 4)), ",", ".", ";")
    secret = (
        lambda: ((word(), one(key(), key().upper()), one("=", ":", "is", "=>", ":=")), quoted(chosen()) + stop()),
        lambda: ((word(), word(), key()), one("=", ":", "= ", ": ").strip() + quoted(one(pick(hexes, one(32, 40, 64)), pick(alnum, span(16, 44))))),
        lambda: ((word(), word()), one("%s=%s", "%s:%s", "--%s=%s") % (one(key(), key().upper()), quoted(chosen())) + stop()),
        lambda: ((word(), word()), issued() + stop()),
        lambda: ((word(), key(), one("=", ":")), quoted(issued()) + stop()),
        lambda: ((word(), word()), one(",", ";").join(issued() for _ in "ab")),
        lambda: ((word(), one("Authorization:", "auth:")), one("Bearer ", "Basic ") + pick(alnum + "+/", span(20, 60))),
        lambda: ((word(),), '{"%s":"%s","%s":"%s"}' % (one(name(), key()), chosen(), key(), chosen()) + stop()),
        lambda: ((word(), word()), "https://%s.%s/%s?%s=%s&%s=%s" % (word(), one("com", "io", "net"), word(), key(), pick(alnum, span(12, 40)), name(), word())),
        lambda: ((word(),), "%s://%s:%s@%s.%s" % (one("https", "postgres", "mysql", "redis", "ftp"), word(), chosen(), word(), one("com", "net", "local"))),
    )
    stand_in = lambda: one("null", "None", "true", "false", "string", "required", "optional", "changeme", "xxxxxxxx", "<your-token>", "your_api_key_here", "${SECRET}", "********", "os.environ", "example")
    harmless = (
        lambda: ((word(), one("commit", "sha", "hash", "checksum", "etag", "digest", "rev")), one("", "", ":").join(("", "")) + pick(hexes, one(7, 12, 32, 40, 64)) + stop()),
        lambda: ((word(), word()), "/".join(("", word(), one(word(), pick(hexes, one(6, 8, 32))), word())) + one("", ".html", ".png", ".js", ".py")),
        lambda: ((word(), one("order", "call", "isbn", "card", "account", "tel", word())), one("", "+", "#") + pick(digits, span(8, 20)) + stop()),
        lambda: ((word(), word()), one("-", " ", ".").join(pick(digits, k) for k in (3, one(3, 4), 4)) + stop()),
        lambda: ((word(), word()), "%s%s@%s.%s" % (word(), one("", "." + word(), pick(digits, span(1, 5)), "." + pick(digits, 2)), one(word() + pick(digits, 1), word() + "." + word()), one("com", "org", "de", "example"))),
        lambda: ((word(), one("id", "uuid", "request", word())), "-".join(pick(hexes, m) for m in (8, 4, 4, 4, 12)) + stop()),
        lambda: ((word(), word()), word() + word() + pick(digits, span(1, 5)) + stop()),
        lambda: ((word(), one("on", "at", "since", word())), "20%s-0%s-1%s" % (pick(digits, 2), pick("123456789", 1), pick(digits, 1)) + one("", "T10:30:00", "T08") + stop()),
        lambda: ((word(), word()), "https://%s.%s/%s/%s?%s=%s" % (word(), one("com", "org"), word(), one(word(), pick(digits, 5)), name(), one(word(), pick(digits, 2), pick(digits, 6)))),
        lambda: ((word(), word()), "%s%s%s" % (name(), one("=", ":"), quoted(one(word() + word(), pick(digits, span(1, 7)), word() + pick(digits, span(1, 4)), pick(hexes, 6)))) + stop()),
        lambda: ((word(), word()), one(f"v{pick(digits, 1)}.{pick(digits, 2)}.{pick(digits, 2)}-{word()}{pick(digits, 2)}", (word() + word() + word()).upper(), (word() + "_" + word() + "_" + pick(digits, 2)).upper(), f"{pick(digits, 3)}.{pick(digits, 2)}.{pick(digits, 1)}.{pick(digits, 3)}")),
        lambda: ((word(), key(), one("=", ":")), quoted(stand_in()) + stop()),
        lambda: ((word(),), one("%s=%s", "%s:%s") % (key(), stand_in()) + stop()),
        lambda: ((word(), one("the", "a", "his", "our", "their"), one("secret:", "pass:", "token:", "private:", "password:")), word() + stop()),
        lambda: ((word(),), '{"%s":"%s %s","%s":"%s"}' % (name(), word(), word(), name(), one(word() + word(), pick(digits, 5)))),
        lambda: ((word(), word()), "data:image/png;base64," + pick(alnum + "+/", 40)),
    )
    rows = []
    for k in range(n):
        kinds = secret if k % 2 else harmless
        before, w = kinds[rng.integers(len(kinds))]()
        rows.append((" ".join((word(), *before)), w, f"{word()} {word()}", k % 2))
    return rows


# ---- the forest --------------------------------------------------------------------------------------------------

def _grow(x, y, rng, depth):
    if depth == 0 or len(y) < 2 * LEAF or y.min() == y.max():
        return float(y.mean())
    best = (1e9, None, None)
    for f in rng.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1])) + 1), replace=False):
        values = np.unique(x[:, f])
        if len(values) < 2:
            continue
        cuts = (values[1:] + values[:-1]) / 2
        for c in cuts if len(cuts) <= 24 else np.quantile(cuts, np.linspace(0, 1, 24)):
            left = x[:, f] <= c
            m = left.sum()
            if LEAF <= m <= len(y) - LEAF:
                a, b = y[left].mean(), y[~left].mean()
                gini = m * a * (1 - a) + (len(y) - m) * b * (1 - b)
                if gini < best[0]:
                    best = (gini, f, float(c))
    if best[1] is None:
        return float(y.mean())
    left = x[:, best[1]] <= best[2]
    return (int(best[1]), best[2], _grow(x[left], y[left], rng, depth - 1), _grow(x[~left], y[~left], rng, depth - 1))


def grow_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 6) -> list:
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        pick = rng.integers(0, len(y), len(y))
        out.append(_grow(x[pick], y[pick], rng, depth))
    return out


def flat_forest(forest: list) -> dict[str, list]:
    """The forest as parallel arrays over its nodes; a leaf points at itself."""
    out: dict[str, list] = {k: [] for k in ("feature", "cut", "left", "right", "share", "roots")}

    def add(tree) -> int:
        at = len(out["cut"])
        for k in ("feature", "cut", "left", "right", "share"):
            out[k].append(0)
        if isinstance(tree, float):
            out["cut"][at], out["left"][at], out["right"][at], out["share"][at] = 0.0, at, at, tree
        else:
            out["feature"][at], out["cut"][at], out["share"][at] = tree[0], tree[1], 0.0
            out["left"][at], out["right"][at] = add(tree[2]), add(tree[3])
        return at

    for tree in forest:
        out["roots"].append(add(tree))
    return out


def forest_score(model: dict[str, list], features: F.Column) -> F.Column:
    """Mean over the trees of the share at the leaf that the features (an array) lead to."""
    get = lambda k, at: F.get(F.lit(model[k]), at)
    step = lambda node, _: F.when(F.get(features, get("feature", node)) <= get("cut", node), get("left", node)).otherwise(get("right", node))
    leaf = lambda root: F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), root, step)
    return F.aggregate(F.lit(model["roots"]), F.lit(0.0), lambda total, root: total + get("share", leaf(root))) / len(model["roots"])


# ---- native expressions ------------------------------------------------------------------------------------------

def _sql(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def parted(text: F.Column) -> F.Column:
    """The pieces of text: every second one, from the second on, is a candidate.  MARK and ESCAPE are written as above."""
    safe = F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "1")), F.lit(MARK), F.lit(ESCAPE + "0"))
    keys, values = ("".join(f"${{{c}{k}}}" for k in names) for c, names in (("k", "abcdfh"), ("v", "abcdefgh")))
    return F.split(F.regexp_replace(safe, CANDIDATE, f"{keys}{MARK}{values}{MARK}"), MARK, -1)


def plain(text: F.Column) -> F.Column:
    return F.replace(F.replace(text, F.lit(ESCAPE + "0"), F.lit(MARK)), F.lit(ESCAPE + "1"), F.lit(ESCAPE))


def _candidates(df: DataFrame, text: F.Column) -> DataFrame:
    """df with _parts, and _x: the candidates, in order, as FEATURES want them."""
    df = settled(df, _parts=parted(F.coalesce(text, F.lit(""))))
    part = lambda k: f"coalesce(get(_parts, 2 * i + {k}), '')"
    before = f"right(concat(right({part(-2)}, 120), right({part(-1)}, 120), right({part(0)}, 120)), 120)"
    df = settled(df, _y=F.expr(f"""
        transform(filter(sequence(0, size(_parts) div 2), i -> 2 * i + 1 < size(_parts)), i -> named_struct('v', get(_parts, 2 * i + 1), 'p', {before},
            'after', left({part(2)}, 120)))"""))
    return df.withColumn("_x", F.expr(rf"""
        transform(_y, y -> named_struct('v', y.v, 'p', y.p, 'w', concat(regexp_extract(y.p, {_sql(r"(\S*)$")}, 1), y.v, regexp_extract(y.after, {_sql(r"^(\S*)")}, 1)),
            'b', regexp_extract(y.p, {_sql(r"((?:\S+\s+){0,3})\S*$")}, 1),
            'a', regexp_extract(y.after, {_sql(r"^\S*\s+(\S+(?:\s+\S+)?)")}, 1)))""")).drop("_y")


def features_sql() -> str:
    """The features of a finding x as an array."""
    return "array(" + ", ".join(f"cast({e.replace('{before_value}', _sql(BEFORE_VALUE))} as double)" for e in FEATURES.values()) + ")"


def train(spark: SparkSession, findings: list[tuple] | None = None) -> dict[str, list]:
    """The forest for labelled findings (a bounded list)."""
    rows = findings or labelled_findings()
    df = spark.createDataFrame(rows, "b string, w string, a string, y int")
    df = _candidates(df, F.concat_ws(" ", "b", "w", "a")).select("w", "y", F.explode("_x").alias("x")).where("instr(w, x.v) > 0")
    got = df.select(F.expr(features_sql()).alias("f"), "y").collect()
    data = np.array(sorted((*r["f"], r["y"]) for r in got), float)
    return flat_forest(grow_forest(data[:, :-1], data[:, -1]))


def _found(docs: DataFrame, model: dict[str, list], threshold: float) -> DataFrame:
    """docs with _parts, _x and _score: the score of each candidate."""
    df = _candidates(docs, F.col("text").cast("string"))
    df = df.withColumn("_f", F.expr(f"transform(_x, x -> {features_sql()})"))
    return settled(df, _score=F.transform("_f", lambda f: forest_score(model, f))).withColumn("_any", F.exists("_score", lambda s: s >= threshold))


def scan(docs: DataFrame, findings: list[tuple] | None = None, threshold: float = 0.5) -> DataFrame:
    """One row a finding: doc_id, word (number of the word in the text in which it starts), value, score."""
    found = _found(docs.select("doc_id", "text"), train(docs.sparkSession, findings), threshold).where("_any")
    found = settled(found.select("doc_id", "_parts", "_score"), _on=F.expr(f"filter(sequence(0, size(_score) - 1), i -> get(_score, i) >= {threshold})"),
                    _spaces=F.expr("transform(_parts, p -> regexp_count(p, " + _sql(r"\s+") + "))"))
    step = "s.n + aggregate(slice(_spaces, s.at + 1, 2 * i + 1 - s.at), 0, (n, k) -> n + k)"
    found = settled(found, _words=F.expr(f"""aggregate(_on, named_struct('n', 0, 'at', 0, 'words', cast(array() as array<int>)),
        (s, i) -> named_struct('n', {step}, 'at', 2 * i + 1, 'words', concat(s.words, array({step}))), s -> s.words)"""))
    found = found.select("doc_id", F.explode(F.expr("transform(_on, (i, k) -> named_struct('word', get(_words, k), 'value', get(_parts, 2 * i + 1), 'score', get(_score, i)))")).alias("s"))
    return found.select("doc_id", F.col("s.word").alias("word"), plain(F.col("s.value")).alias("value"), F.col("s.score").alias("score"))


def redact(docs: DataFrame, mark: str = "<secret>", findings: list[tuple] | None = None, threshold: float = 0.5) -> DataFrame:
    """docs, every row and column kept, with each secret value in text replaced, where it stands, by mark."""
    cols = docs.columns
    rows = docs.select(*(F.col(f"`{c}`").alias(f"in_{k}") for k, c in enumerate(cols)), F.col("text").cast("string").alias("text"))
    found = _found(rows, train(docs.sparkSession, findings), threshold)
    safe_mark = mark.replace(ESCAPE, ESCAPE + "1").replace(MARK, ESCAPE + "0")
    clean = plain(F.array_join(F.expr(f"transform(_parts, (p, i) -> if(i % 2 = 1 and get(_score, i div 2) >= {threshold}, {_sql(safe_mark)}, p))"), ""))
    return found.select(*(F.when(F.col("_any"), clean).otherwise(F.col("text")).alias(c) if c == "text" else F.col(f"in_{k}").alias(c) for k, c in enumerate(cols)))
