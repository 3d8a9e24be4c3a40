"""Benchmark decontamination by a prefix-filtered set join, with DataFrame operations only.

Every benchmark item gives windows of 13 consecutive words (a shorter item is one window). A window
can only occur where its rarest word occurs, so the prefix of the ordered window is that one word:
words are ordered by how often the whole corpus holds them. A document word that equals a window's
prefix word fixes the position of the window; windows that would begin before the text or end after
it are dropped (positional and length bounds); the words in place are then compared exactly.

Words are runs of a-z, 0-9 and everything beyond ASCII, after lower-casing A-Z only.

Defined results: a null text has no words and no hits; an item without words gives no window; equal
items count as often as they have ids; rows with equal doc_id are told apart by a row number; empty
tables give empty results; other columns are ignored or carried, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, lower_ascii, numbered, stored

WINDOW = 13
#: The benchmark's vocabulary and its windows' prefix words are broadcast only up to so many rows.
BROADCAST_ROWS = 200_000
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _GAP), lambda w: w != "")


def windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """item_id, tokens for every window of every item, repeated windows of an item once."""
    w = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1)))
    return w.select("item_id", F.explode(starts).alias("i"), "w").select("item_id", F.slice("w", F.col("i"), width).alias("tokens")).distinct()


def word_counts(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """How often all texts hold each word of the vocabulary: summed before the shuffle."""
    return (
        texts.select(F.explode(words(F.col("text"))).alias("token")).join(bounded(vocabulary, BROADCAST_ROWS), "token").groupBy("token").agg(F.count("*").alias("n"))
    )


def occurrences(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(occ, win): occ(row_id, start, shape) for each place of a window; win(shape, item_id).

    ``docs`` has row_id and text. shape is the window's words joined by blanks.
    """
    win = stored(windows(items, width))
    vocabulary = stored(win.select(F.explode("tokens").alias("token")).distinct())
    counts = stored(word_counts(docs, vocabulary))
    shapes = win.select("tokens").distinct().withColumn("shape", F.array_join("tokens", " "))
    placed = shapes.select("shape", F.size("tokens").alias("len"), F.posexplode("tokens").alias("at", "token"))
    rarest = (
        placed.join(bounded(counts, BROADCAST_ROWS), "token", "left")
        .groupBy("shape", "len")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "at")).alias("least"))
        .where("least.n > 0")
        .select(F.col("least.token").alias("token"), F.col("least.at").alias("at"), "len")
    )
    prefixes = stored(rarest.groupBy("token").agg(F.collect_set(F.struct("at", "len")).alias("places")))
    spots = docs.select("row_id", F.posexplode(words(F.col("text"))).alias("p", "token"))
    starts = spots.join(bounded(prefixes, BROADCAST_ROWS), "token").select("row_id", F.explode("places").alias("at"), "p").select(
        "row_id", (F.col("p") - F.col("at.at")).alias("start"), F.col("at.len").alias("len")
    )
    found = stored(starts.where("start >= 0").groupBy("row_id", "start", "len").agg(F.lit(1).alias("one")).drop("one"))
    per_doc = found.groupBy("row_id").agg(F.collect_list(F.struct("start", "len")).alias("starts"))
    texts = docs.join(per_doc, "row_id").select("row_id", words(F.col("text")).alias("w"), "starts")
    fits = F.filter("starts", lambda s: s["start"] + s["len"] <= F.size("w"))
    cut = F.transform(fits, lambda s: F.struct(s["start"].alias("start"), s["len"].alias("len"), F.array_join(F.slice("w", s["start"] + 1, s["len"]), " ").alias("shape")))
    candidates = texts.select("row_id", F.explode(cut).alias("c")).select("row_id", "c.*")
    known = bounded(stored(shapes.select("shape")), BROADCAST_ROWS)
    occ = stored(candidates.join(known, "shape", "left_semi"))
    return occ, win.select(F.array_join("tokens", " ").alias("shape"), "item_id")


def decontaminate(
    docs: DataFrame, items: DataFrame, width: int = WINDOW, percent: int = 5, carry: list[str] | None = None
) -> DataFrame:
    """doc_id (or ``carry``), n_words, n_hit, n_items, items_sha256, contaminated for every document.

    A document is contaminated where hit words make up ``percent`` in a hundred of its words.
    """
    carry = carry or ["doc_id"]
    base = numbered(docs.select("text", "doc_id", F.struct(*carry).alias("row")))
    occ, win = occurrences(base.select("row_id", "text"), items, width)
    before = Window.partitionBy("row_id").orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("len")
    fresh = F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(F.max(end).over(before), F.lit(0))))
    hits = occ.withColumn("fresh", fresh).groupBy("row_id").agg(F.sum("fresh").alias("n_hit"))
    pairs = occ.select("row_id", "shape").distinct().join(bounded(stored(win), BROADCAST_ROWS), "shape").select("row_id", "item_id").distinct()
    named = pairs.groupBy("row_id").agg(
        F.count("*").alias("n_items"), F.sort_array(F.collect_list(F.coalesce(F.col("item_id").cast("string"), F.lit("")))).alias("ids")
    )
    found = stored(hits.join(named, "row_id"))
    per = base.select("row_id", "row", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return per.join(found, "row_id", "left").select(
        "row.*", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("ids", F.array().cast("array<string>")), ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (100 * n_hit >= percent * F.col("n_words"))).alias("contaminated"),
    )
