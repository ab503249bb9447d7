"""Removal of multi-line chunks that repeat anywhere in the corpus; DataFrame functions only.

Chunks.  Lines are hashed.  Line i ends a coarse chunk when a hash rolled over lines i-1 and i is even and that of lines
i-2 and i-1 is not; this depends on three lines, so borders move with the text, and no two borders touch.  A chunk of over
MOST lines is split every MOST lines.  A passage that two documents share in the middle of different coarse chunks has
borders of its own: from every line with a word on, a fine chunk ends where a count of words rolled over the lines first reaches
LONG, however many lines that takes; so every shared run of LONG words or more holds a whole chunk, whatever stands around it.  A line of
LONG words or more is such a run by itself, and one line: it is the only kind of single line that is ever removed.  Words are what stands
between white space (blanks, tabs, line breaks, form feeds).

Repeats.  Hashes of chunks, counted with partial aggregation, tell which chunks may repeat; these are then told apart by the
whole sequence of their lines' hashes, and all lines of repeated chunks that share a hash are compared byte by byte (least and
greatest text of each line hash, aggregated before the shuffle).  Chunks with lines that differ are not touched.  So a chunk goes only
if the same bytes stay elsewhere: the first occurrence, by document id and place, stays, and the lines of every other one go.  Every line
that is removed stays somewhere: the line it repeats comes earlier in the order of ids and places.  At the end of a repeated run
a rest of fewer than LONG words may stay.

Documents without repeated chunks are told by a bitmap of hashes (bounded; a full one lets more through, and changes nothing
else) and are not shuffled.

Null text stays null.  A document whose every line goes keeps its row with an empty text.  Rows with equal id and
text (by its MD5) are one document and get the same result.  A null id sorts first.  Other columns stay as they are, whatever their
names; `counts` names the two columns to add, and raises if the table has one of that name.  An empty table gives no rows.
A text is handled by one task as arrays of its lines, however long it is.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, cut, settled

LONG, MOST = 50, 32
#: Lines that a fine chunk is first looked for in, by plain sums; longer ones are counted on.
NEAR = 8
#: The number of words of a line x: one more than its blanks where these stand one by one between words; else each word is written as
#: one character with the white space around it.
WORDS = r"""if(x = '', 0, if(instr(x, '  ') = 0 and not startswith(x, ' ') and not endswith(x, ' ') and instr(x, '\t') = 0 and instr(x, '\r') = 0 and instr(x, '\u000B') = 0 and instr(x, '\u000C') = 0,
    octet_length(x) - octet_length(replace(x, ' ', '')) + 1,
    if(x rlike '[^\\x20\\x09-\\x0D]', length(regexp_replace(x, '[\\x20\\x09-\\x0D]*+[^\\x20\\x09-\\x0D]++[\\x20\\x09-\\x0D]*+', 'w')), 0)))"""
#: What chunks are first told apart by, from the array q of their lines' hashes.
CHUNK_HASH = "xxhash64(q)"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-2**63)).alias("_d"), _name().alias("_t"), F.col("text").cast("string").alias("_text"))


def _name() -> F.Column:
    """The name of a text among those of one id."""
    return F.unhex(F.md5(F.col("text").cast("string").cast("binary")))


def _split(df: DataFrame) -> DataFrame:
    """_lines, their number _n and their hashes _h."""
    df = settled(df, _lines=F.split("_text", "\n", -1))
    return settled(df.withColumn("_n", F.size("_lines")), _h=F.expr("transform(_lines, x -> xxhash64(x))"))


def chunks(docs: DataFrame, long_words: int = LONG, most: int = MOST) -> DataFrame:
    """(_d, _t, s, e, q): lines s to e of a document are a chunk, q their hashes; only chunks that may be removed."""
    df = _split(_keyed(docs).where("_text is not null"))
    df = settled(df, _w=F.expr(rf"transform(_lines, x -> {WORDS})"),
                 _even=F.expr("transform(_h, (x, i) -> i > 0 and pmod(xxhash64(get(_h, i - 1), x), 2) = 0)"))
    df = settled(df.drop("_lines", "_text"), _ends=F.expr(f"""
        filter(sequence(0, _n - 1), i -> i = _n - 1 or get(_w, i) >= {long_words} or get(_w, i + 1) >= {long_words}
            or (i >= 1 and i < _n - 2 and get(_even, i) and not get(_even, i - 1)))"""), _at=F.expr("filter(sequence(0, _n - 1), i -> get(_w, i) > 0)"))
    df = settled(df, _v=F.expr("transform(_at, i -> get(_w, i))"))
    words, ends = "get(_v, k)", []
    for d in range(1, NEAR):
        words += f" + coalesce(get(_v, k + {d}), 0)"
        ends.append(f"when {words} >= {long_words} then k + {d}")
    # every line of _v has a word, so the count is reached within long_words of them
    further = f"""aggregate(slice(_v, k + 1, {long_words}), struct(0 as c, 0 as n), (a, x) -> if(a.c >= {long_words}, a, struct(a.c + x as c, a.n + 1 as n)), a -> if(a.c >= {long_words}, k + a.n - 1, null))"""
    fine = f"transform(filter(sequence(0, size(_at) - 1), k -> k >= 0 and get(_v, k) < {long_words}), k -> struct(get(_at, k) as s, get(_at, case {' '.join(ends)} else {further} end) as e))"
    df = settled(df, _coarse=F.expr(f"""
        flatten(transform(_ends, (e, k) -> transform(sequence(if(k = 0, 0, get(_ends, k - 1) + 1), e, {most}), s -> struct(s as s, least(s + {most - 1}, e) as e))))"""),
                 _fine=F.expr(f"if(size(_at) = 0, cast(array() as array<struct<s:int,e:int>>), {fine})"))
    df = df.select("_d", "_t", "_h", F.expr(f"inline(array_distinct(concat(filter(_coarse, c -> c.e > c.s or get(_w, c.s) >= {long_words}), filter(_fine, c -> c.e is not null))))"))
    return df.select("_d", "_t", "s", "e", F.expr("slice(_h, s + 1, e - s + 1)").alias("q"))


def _repeated(docs: DataFrame, long_words: int) -> DataFrame:
    """(_d, _t, cs): for each document with repeated chunks their places (s, e), and whether each is a first occurrence."""
    found = chunks(docs, long_words).withColumn("h", F.expr(CHUNK_HASH))
    twice = cut(found.select("h").groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    place = F.struct("_d", "_t", "s")
    again = cut(among(found, twice, "h").where("_may").drop("_may"))
    first = again.groupBy("h", "q").agg(F.count("*").alias("n"), F.min(place).alias("keep")).where("n > 1").drop("n")
    again = again.join(first, ["h", "q"]).select("_d", "_t", F.struct("s", "e", (place == F.col("keep")).alias("first")).alias("c"))
    return again.groupBy("_d", "_t").agg(F.collect_set("c").alias("cs"))


def _spans(which: str) -> str:
    """Numbers of the lines that chunks of cs cover, each once."""
    return f"array_distinct(flatten(transform(filter(cs, c -> {which}), c -> sequence(c.s, c.e))))"


def differing(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """(line): hashes under which repeated chunks hold lines of different bytes."""
    texts = _split(among(_keyed(docs), repeated, "_d", "_t").where("_may").join(repeated, ["_d", "_t"]))
    lines = texts.select(F.expr(f"inline(transform({_spans('true')}, i -> struct(get(_h, i) as line, get(_lines, i) as body)))"))
    return lines.groupBy("line").agg(F.min("body").alias("a"), F.max("body").alias("z")).where("a <> z").select("line")


def dedup(docs: DataFrame, long_words: int = LONG, counts: tuple[str, str] | None = None) -> DataFrame:
    """docs with the repeated chunks cut out of text; counts names two more columns: lines, and lines removed."""
    cols = docs.columns
    if set(counts or ()) & set(cols):
        raise ValueError(f"the table has a column {set(counts) & set(cols)}; name the counts differently")
    repeated = cut(_repeated(docs, long_words))
    bad = cut(differing(docs, repeated))
    src = docs.select(*(F.col(f"`{c}`").alias(f"in_{k}") for k, c in enumerate(cols)), F.coalesce(F.col("doc_id").cast("long"), F.lit(-2**63)).alias("_d"), _name().alias("_t"))
    src = among(src, repeated, "_d", "_t")
    text = F.col(f"in_{cols.index('text')}")
    lines = F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)

    def shown(df: DataFrame, new: F.Column, removed: F.Column) -> DataFrame:
        more = [c.alias(name) for name, c in zip(counts or (), (lines, removed))]
        return df.select(*((new if c == "text" else F.col(f"in_{k}")).alias(c) for k, c in enumerate(cols)), *more)

    df = src.where("_may").join(repeated, ["_d", "_t"], "left").withColumn("_text", F.when(F.expr("exists(cs, c -> not c.first)"), text.cast("string")))
    df = _split(df)  # only texts that lose something are taken apart again
    if not bad.isEmpty():
        hit = _split(_keyed(docs).join(repeated, ["_d", "_t"])).select("_d", "_t", F.expr("posexplode(_h)").alias("at", "line")).join(bad, "line")
        df = df.join(hit.groupBy("_d", "_t").agg(F.collect_set("at").alias("_bad")), ["_d", "_t"], "left")
        df = df.withColumn("cs", F.expr("filter(cs, c -> not exists(coalesce(_bad, array()), i -> i between c.s and c.e))"))
    df = df.withColumn("_left", F.expr(f"transform(array_except(sequence(0, _n - 1), {_spans('not c.first')}), i -> get(_lines, i))"))
    gone = F.col("_text").isNotNull()
    touched = shown(df, F.when(gone, F.array_join("_left", "\n")).otherwise(text), F.when(gone, F.col("_n") - F.size("_left")).otherwise(0))
    return touched.unionByName(shown(src.where("not _may"), text, F.lit(0)))
