"""Line dedup by an exact set-similarity join, with DataFrame operations only.

A line's tokens are its distinct lower-cased words. A line is removed where an earlier line of the
corpus (smaller document, or smaller line number in one document) has a Jaccard similarity of
``percent`` or more to it. Every line with at least one word is compared, whatever its length.

Equal lines are settled by counting, and only the first of each goes on. Whole texts are cut into
words once, into a table of hashed tokens. Tokens are ordered by rarity: occurrences over the whole
corpus are counted in a fixed number of counters, quarter octaves of the counts make the order, ties
go by hash. Any fixed order gives exact results; the counts only
make it fast.

For similar lines of n <= m tokens the first token that both hold stands among the first
n - ceil(2 * 0.75 * n / 1.75) + 1 of the shorter and the first m - ceil(0.75 * m) + 1 of the longer
(prefix filter). There the tokens before it are unmatched, so their number and what is left behind it
bound the overlap (positional filter), the sizes bound it as well (length filter), and so does the
number of positions in which parity bitmaps of the whole lines differ. All of this is asked inside the
join; what passes is verified on the words of both lines.

The earliest lines of a few of a line's tokens are tried first, which settles groups of near copies in
as many comparisons as they have lines. These tokens are the last of the shorter prefix: in a large
group the rarest ones are what its lines do not share. Lines that are gone are then compared as earlier
ones only. The join runs in passes over slices of the tokens, so its shuffle never holds more than a
part of the prefixes; adaptive execution can split every one of its keys.

Defined results: a null or empty text stays as it is; line breaks are \\n, and the lines kept are
joined by \\n again; lines without a word are neither compared nor removed; equal rows are rows of
their own, of which all but the first lose their lines; null ids come last; an empty table gives an
empty result; other columns are carried, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, forget, numbered, packed, release, stored

#: Counters of the token counts; a power of two. They are joined to each document as one array of bytes.
COUNTERS = 1 << 17
#: Passes of the join over slices of the tokens; how many of its tokens bring a line to early ones, and how many early lines a token has.
PASSES, HEADS, EARLY = 4, 2, 24
#: Tables keyed by line or document are broadcast only up to so many rows.
BROADCAST_ROWS = 300_000
#: Lines of at most so many tokens have bitmaps of 64 bits, longer ones have 256.
NARROW = 40
_SPACE = r"[\x20\x09-\x0D]+"
_BLANKS = " \t\x0b\x0c\r"
_BITS = ("b0", "b1", "b2", "b3")


def _tokens(line: Column) -> Column:
    """The distinct words of a lower-cased line as 64-bit hashes."""
    trimmed = F.btrim(line, F.lit(_BLANKS))
    return F.array_distinct(F.transform(F.split(trimmed, _SPACE), lambda w: F.xxhash64(w)))


def token_tiers(tokens: DataFrame) -> DataFrame:
    """One row: the frequency class of every counter. ``tokens`` has a token column t."""
    counts = tokens.groupBy(F.col("t").bitwiseAND(F.lit(COUNTERS - 1)).alias("at")).agg(F.count("*").alias("n"))
    tier = F.least(F.lit(127), F.floor(4 * F.log2("n"))).cast("tinyint")
    every = tokens.sparkSession.range(COUNTERS).select(F.col("id").alias("at"), F.lit(0).cast("tinyint").alias("tier"))
    tiers = counts.select("at", tier.alias("tier")).unionByName(every).groupBy("at").agg(F.max("tier").alias("tier"))
    return tiers.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "tier"))), lambda x: x["tier"]).alias("tiers"))


def _numbered_tokens(tokens: Column, tiers: Column) -> Column:
    """The tokens as whole numbers, rarest first: frequency class in the high bits, then 56 bits of hash."""

    def number(h: Column) -> Column:
        tier = F.get(tiers, h.bitwiseAND(F.lit(COUNTERS - 1)).cast("int")).cast("long")
        return F.shiftleft(tier, 56).bitwiseOR(F.shiftrightunsigned(h, 8))

    return F.sort_array(F.transform(tokens, number))


def _bitmap(tokens: Column, size: Column, word: int) -> Column:
    """One long of a line's parity bitmap; short lines use the first only."""
    none = F.lit(0).cast("long")

    def flip(bits: Column, t: Column) -> Column:
        return bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(F.lit(63)).cast("int")))

    part = F.aggregate(F.filter(tokens, lambda t: t.bitwiseAND(F.lit(192)) == 64 * word), none, flip)
    return F.when(size > NARROW, part).otherwise(none if word else F.aggregate(tokens, none, flip))


def _likely(percent: int) -> Column:
    """Whether sizes and bitmaps of x and y leave room for the similarity."""
    bits = lambda *names: F.bit_count(_xor(*(F.col(f"{s}.{b}") for b in names for s in ("x", "y"))))
    n, m = F.col("x.n"), F.col("y.n")
    apart = _apart(n, m, percent)
    ok = (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (bits(*_BITS) <= apart)
    return ok & ((F.least(n, m) <= NARROW) | (bits("b0") + bits("b1") + bits("b2") + bits("b3") <= apart))


def _xor(first: Column, *more: Column) -> Column:
    for c in more:
        first = first.bitwiseXOR(c)
    return first


def _need(n: Column, m: Column, percent: int) -> Column:
    """The least number of common tokens."""
    return F.ceil(percent * (n + m) / (100 + percent))


def _apart(n: Column, m: Column, percent: int) -> Column:
    """The largest number of tokens that only one of them has."""
    return n + m - 2 * _need(n, m, percent)


def _before(a: str, b: str) -> Column:
    return (F.col(f"{a}.row_id") < F.col(f"{b}.row_id")) | ((F.col(f"{a}.row_id") == F.col(f"{b}.row_id")) & (F.col(f"{a}.line_no") < F.col(f"{b}.line_no")))


#: Later and earlier line of a pair.
_PAIR = ("l.row_id", "l.line_no", "e.row_id as e_row", "e.line_no as e_line")


def _verified(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """row_id, line_no of the later lines of the pairs that are similar, by the words of both."""
    spark, gone = docs.sparkSession, []
    ends = pairs.select("row_id", "line_no").unionByName(pairs.select(F.col("e_row").alias("row_id"), F.col("e_line").alias("line_no")))
    texts = stored(ends.groupBy(F.col("row_id").alias("asked_row")).agg(F.collect_set("line_no").alias("asked")), gone)
    lines = docs.join(bounded(texts, BROADCAST_ROWS), F.expr("row_id = asked_row")).withColumn("lines", F.split(F.lower("text"), "\n"))
    picked = lines.select("row_id", F.explode("asked").alias("line_no"), "lines").select("row_id", "line_no", F.get("lines", F.col("line_no")).alias("line"))
    asked = stored(picked.select("row_id", "line_no", F.array_distinct(F.split(F.btrim("line", F.lit(_BLANKS)), _SPACE)).alias("w")), gone)
    release(spark)
    later = asked.select(F.col("row_id").alias("x"), F.col("line_no").alias("x_line"), F.col("w").alias("a"))
    earlier = asked.select(F.col("row_id").alias("y"), F.col("line_no").alias("y_line"), F.col("w").alias("b"))
    both = pairs.join(later, F.expr("row_id = x and line_no = x_line")).join(earlier, F.expr("e_row = y and e_line = y_line"))
    common = F.size(F.array_intersect("a", "b"))
    found = stored(both.where(100 * common >= percent * (F.size("a") + F.size("b") - common)).select("row_id", "line_no").distinct())
    forget(spark, gone)
    release(spark)
    return found


def _copies(docs: DataFrame) -> DataFrame:
    """row_id, line_no of every line that equals an earlier one."""
    spark, gone = docs.sparkSession, []
    split = docs.select("row_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.length(F.btrim("line", F.lit(_BLANKS))) > 0)
    keyed = stored(split.select("row_id", "line_no", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g")), gone)
    first = F.min(F.struct("row_id", "line_no"))
    copies = keyed.groupBy("h", "g").agg(F.count("*").alias("c"), first.alias("first")).where("c > 1")
    copies = stored(copies.select(F.col("h").alias("ch"), F.col("g").alias("cg"), "first"), gone)
    met = keyed.join(bounded(copies, BROADCAST_ROWS), F.expr("h = ch and g = cg")).where(F.struct("row_id", "line_no") != F.col("first"))
    copied = stored(met.select("row_id", "line_no"))
    forget(spark, gone)
    release(spark)
    return copied


def repeated_lines(docs: DataFrame, percent: int = 75) -> DataFrame:
    """row_id, line_no of every line that goes. ``docs`` has row_id (long, unique) and text."""
    spark, done = docs.sparkSession, []
    copied = _copies(docs)
    per = stored(copied.groupBy(F.col("row_id").alias("copied_row")).agg(F.collect_set("line_no").alias("copied")), done)
    marked = docs.select("row_id", "text").where("text is not null").join(bounded(per, BROADCAST_ROWS), F.expr("row_id = copied_row"), "left")
    none = F.array().cast("array<bigint>")
    cut = lambda x, i: F.when(F.coalesce(F.array_contains("copied", i), F.lit(False)) | (F.length(F.btrim(x, F.lit(_BLANKS))) == 0), none).otherwise(_tokens(x))
    first: list[str] = []
    tokens = stored(marked.select("row_id", F.transform(F.split(F.lower("text"), "\n"), cut).alias("lines")), first)
    release(spark)
    tiers = stored(token_tiers(tokens.select(F.explode("lines").alias("w")).select(F.explode("w").alias("t"))), first)
    ordered = tokens.join(F.broadcast(tiers), how="left").select(  # tiers is one row
        "row_id", F.posexplode(F.transform("lines", lambda x: _numbered_tokens(x, F.col("tiers")))).alias("line_no", "s")
    )
    n = F.size("s")
    longest = n - F.ceil(percent * n / 100).cast("int") + 1
    bitmap = [_bitmap(F.col("s"), n, k).alias(b) for k, b in enumerate(_BITS)]
    prefixes = stored(ordered.where(n > 0).select("row_id", "line_no", n.alias("n"), *bitmap, F.slice("s", 1, longest).alias("s")), done)
    forget(spark, first)
    release(spark)
    pairs = stored(_with_earliest(prefixes, percent, done), done)
    release(spark)
    gone = _verified(docs, pairs, percent)
    rest = stored(_with_all(prefixes, gone, percent, done).join(pairs, ["row_id", "line_no", "e_row", "e_line"], "left_anti"), done)
    found = gone.unionByName(_verified(docs, rest, percent))
    forget(spark, done)
    return copied.unionByName(found)


def _index_size(percent: int) -> Column:
    """How many tokens of a line stand in the prefix that it has as the shorter one."""
    return F.col("n") - F.ceil(2 * percent * F.col("n") / (100 + percent)).cast("int") + 1


def _with_earliest(prefixes: DataFrame, percent: int, done: list[str]) -> DataFrame:
    """Likely pairs of a line and the earliest lines of one of its tokens, one for each part of the lines that have it."""
    begin = F.greatest(_index_size(percent) - HEADS + 1, F.lit(1))
    rare = prefixes.select("row_id", "line_no", "n", *_BITS, F.explode(F.slice("s", begin, F.lit(HEADS))).alias("t"))
    part = F.pmod(F.xxhash64("row_id", "line_no"), F.lit(EARLY))
    heads = rare.groupBy("t", part.alias("part")).agg(F.min(F.struct("row_id", "line_no", "n", *_BITS)).alias("head"))
    heads = stored(heads.select("t", "head.*"), done)
    release(prefixes.sparkSession)
    met = rare.alias("x").join(heads.alias("y"), (F.col("x.t") == F.col("y.t")) & _before("y", "x") & _likely(percent))
    return met.select(F.struct("x.row_id", "x.line_no").alias("l"), F.struct("y.row_id", "y.line_no").alias("e")).selectExpr(*_PAIR).distinct()


def _with_all(prefixes: DataFrame, gone: DataFrame, percent: int, done: list[str]) -> DataFrame:
    """All likely pairs whose later line is not gone."""
    spark = prefixes.sparkSession
    known = bounded(gone.select(F.col("row_id").alias("gone_row"), F.col("line_no").alias("gone_line"), F.lit(True).alias("is_gone")), BROADCAST_ROWS)
    lines = prefixes.join(known, F.expr("row_id = gone_row and line_no = gone_line"), "left").withColumn("gone", F.coalesce("is_gone", F.lit(False)))
    rows = lines.select("row_id", "line_no", "n", *_BITS, "gone", F.posexplode("s").alias("p", "t"))
    rows = rows.where(F.shiftright("t", 56) > 0)  # where a counter holds one occurrence its class is 0, and the token has no partner
    n, m = F.col("x.n"), F.col("y.n")
    shorter = (n < m) | ((n == m) & _before("x", "y"))
    room = (F.col("x.p") + F.col("y.p") <= _apart(n, m, percent)) & (F.least(n - F.col("x.p"), m - F.col("y.p")) >= _need(n, m, percent))
    stays = F.when(_before("x", "y"), ~F.col("y.gone")).otherwise(~F.col("x.gone"))
    x, y = F.struct("x.row_id", "x.line_no"), F.struct("y.row_id", "y.line_no")
    found = None
    for k in range(PASSES):
        here = rows.where(F.pmod("t", F.lit(PASSES)) == k)
        index = here.where(F.col("p") < _index_size(percent))
        met = index.alias("x").join(here.alias("y"), (F.col("x.t") == F.col("y.t")) & shorter & room & _likely(percent) & stays)
        ends = met.select(F.when(_before("x", "y"), y).otherwise(x).alias("l"), F.when(_before("x", "y"), x).otherwise(y).alias("e"))
        part = stored(ends.selectExpr(*_PAIR).distinct(), done)
        release(spark)
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def cut_lines(docs: DataFrame, percent: int = 75) -> DataFrame:
    """row (all columns of docs as a struct), cut (the text that stays), n_lines, n_removed."""
    base = numbered(docs.select("doc_id", "text", packed(docs)))
    gone = repeated_lines(base.select("row_id", "text"), percent)
    per = stored(gone.groupBy(F.col("row_id").alias("of")).agg(F.collect_set("line_no").alias("gone")))
    release(docs.sparkSession)
    joined = base.select("row_id", "row", "text").join(bounded(per, BROADCAST_ROWS), F.expr("row_id = of"), "left")
    lines = F.split("text", "\n")
    kept = F.filter(F.transform(lines, lambda x, i: F.when(~F.array_contains("gone", i), x)), lambda x: x.isNotNull())
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    n_removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    return joined.select("row", text.alias("cut"), n_lines.alias("n_lines"), n_removed.alias("n_removed"))


def remove_lines(docs: DataFrame, percent: int = 75) -> DataFrame:
    """docs with their text cut and, besides, n_lines and n_removed (in place of own columns of these names)."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    out = [F.col("cut").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names]
    return cut_lines(docs, percent).select(*out, "n_lines", "n_removed")
