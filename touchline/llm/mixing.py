"""Mix sources to target weights by entropy balancing, with DataFrame operations only.

Each source gets a target of words; its documents get rates that are an exponential tilt of the
uniform rate, rate = min(cap, exp(lambda * size / scale)), with one dual variable lambda for each
source's token constraint. Newton steps over a histogram of (source, size), all sources at once,
solve the convex dual; a bracket keeps every step safe. Rates are then rounded into whole copies:
along falling sizes the words still owed are carried from one size to the next, so a source ends
within a few words of its target.

Rows of one size and source are alike, so only (source, size) cells move through the iterations.
A cell's extra copies go to the documents whose ids hash lowest; large cells are ranked in chunks.

Defined results: a null or empty text has size 0 and takes 0 words; a null source is a source of
its own, ordered last; rows with equal ids are mixed independently; an empty table gives an empty
result; other columns are ignored or carried, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, forget, stored

WORD = r"[^\x20\x09-\x0D]+"
#: A row of the cell table is broadcast only where the table has at most so many rows.
BROADCAST_ROWS = 200_000
_CHUNK = 512
#: Sizes of a source that are rounded one after the other in one part.
_PART = 500


def _bounded(df: DataFrame) -> DataFrame:
    return bounded(df, BROADCAST_ROWS)


def sizes(docs: DataFrame) -> DataFrame:
    """docs with the number of words of each text."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def ranked_sources(cells: DataFrame) -> DataFrame:
    """source, source_size, position: 0, 1, 2, ... by code point, null last, without one task for all.

    Ranges of sources are numbered on their own and shifted by the counts of earlier ranges.
    """
    per = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    parted = stored(
        per.repartitionByRange(F.col("source").isNull().cast("int"), "source").withColumn("part", F.spark_partition_id())
    )
    counts = parted.groupBy("part").agg(F.count("*").alias("n"))
    shift = counts.withColumn("shift", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    at = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return parted.join(F.broadcast(shift.select("part", "shift")), "part").select(
        "source", "source_size", (F.row_number().over(at) - 1 + F.coalesce("shift", F.lit(0))).alias("position")
    )


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """Water-filling: each source's share by weight of all words, none above ``cap`` times its size."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("position") % len(weights) + 1).cast("int")).cast("double")
    rows = sources.withColumn("weight", weight).withColumn("most", cap * F.col("source_size"))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, None
    while True:  # the level of words per weight only rises, and each round fills a source or ends
        over = F.col("weight") * level >= F.col("most")
        got = rows.agg(
            F.sum(F.when(over, F.col("most"))).alias("used"), F.sum(F.when(~over, F.col("weight"))).alias("open"), F.count_if(over).alias("full")
        ).first()
        if not got["open"] or got["full"] == full:
            break
        full = got["full"]
        level = (total - (got["used"] or 0.0)) / got["open"]
    return rows.withColumn("target", F.least(F.col("most"), F.col("weight") * level)).drop("most")


def rates(cells: DataFrame, wanted: DataFrame, cap: float = 3.0, steps: int = 40, tolerance: float = 1e-9) -> DataFrame:
    """cells with the rate of their documents, from safeguarded Newton steps on the dual."""
    spark, paths = cells.sparkSession, []
    moments = cells.groupBy("source").agg(
        F.try_divide(F.sum((F.col("n") * F.col("size")).cast("double") * F.col("size")), F.sum(F.col("n") * F.col("size"))).alias("scale")
    )
    duals = wanted.join(moments, F.expr("wanted_source <=> source")).select(
        "wanted_source", "target", "scale", F.lit(0.0).alias("dual"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"),
        F.coalesce(~(F.col("scale") > 0), F.lit(True)).alias("done"),
    )
    duals = stored(duals, paths)
    log_cap = F.log(F.lit(float(cap)))
    for _ in range(steps):
        x = F.col("size") / F.col("scale")
        free = F.col("dual") * x < log_cap
        rate = F.exp(F.least(F.col("dual") * x, log_cap))
        words = (F.col("n") * F.col("size")).cast("double")
        now = (
            cells.join(_bounded(duals.where("not done")), F.expr("wanted_source <=> source")).groupBy("wanted_source")
            .agg(F.sum(words * rate).alias("f"), F.sum(F.when(free, words * rate * x).otherwise(0.0)).alias("slope"))
            .withColumnRenamed("wanted_source", "at")
        )
        joined = duals.join(now, F.expr("wanted_source <=> at"), "left")
        high = F.when(F.col("f") >= F.col("target"), F.col("dual")).otherwise(F.col("high"))
        low = F.when(F.col("f") < F.col("target"), F.col("dual")).otherwise(F.col("low"))
        newton = F.col("dual") - F.try_divide(F.col("f") * F.log(F.try_divide("f", "target")), "slope")
        widen = F.when(F.col("high").isNull(), F.coalesce(2 * F.abs("low"), F.lit(0.0)) + 1).when(F.col("low").isNull(), F.lit(-1.0) - 2 * F.abs("high"))
        inside = (newton > F.coalesce("low", F.lit(float("-inf")))) & (newton < F.coalesce("high", F.lit(float("inf")))) & (F.abs(newton) < 1e12)
        close = F.abs(F.col("f") - F.col("target")) <= tolerance * F.greatest(F.col("target"), F.lit(1.0))
        following = F.when(inside & (F.col("slope") > 0), newton).otherwise(F.coalesce(widen, (F.col("low") + F.col("high")) / 2))
        stepped = joined.withColumn("high", high).withColumn("low", low)
        before, kept = paths, []
        duals = stored(
            stepped.select(
                "wanted_source", "target", "scale",
                F.when(F.col("done") | close, F.col("dual")).otherwise(following).alias("dual"), "low", "high",
                (F.col("done") | close).alias("done"),
            ), kept,
        )
        forget(spark, before)
        paths = kept
        if duals.where("not done").isEmpty():
            break
    found = _bounded(duals.select("wanted_source", "dual", "scale"))
    x = F.try_divide(F.col("dual") * F.col("size"), F.col("scale"))
    rate = F.when(F.col("size") > 0, F.exp(F.least(x, log_cap))).otherwise(0.0)
    return cells.join(found, F.expr("wanted_source <=> source")).select("source", "size", "n", rate.alias("rate"))


def copies_per_cell(rated: DataFrame, cap: int = 3) -> DataFrame:
    """source, size, n, copies: whole copies of each cell, words owed carried to the next smaller size.

    A source's list holds one entry for each distinct size of its documents, not one for each document. It is
    folded in parts of ``_PART`` sizes, since each size that is added copies the copies of its part only.
    """
    entry = F.struct(F.col("size"), F.col("n"), F.col("rate"))
    lists = rated.where("size > 0").groupBy("source").agg(F.sort_array(F.collect_list(entry), asc=False).alias("cells"))
    starts = F.sequence(F.lit(1), F.size("cells"), F.lit(_PART))
    lists = lists.withColumn("parts", F.transform(starts, lambda i: F.slice("cells", i, _PART)))
    words = "a.owed + c.n * c.size * c.rate"
    copies = f"greatest(0L, least({cap}L * c.n, cast(floor(({words}) / c.size + 0.5D) as bigint)))"
    folded = f"""
        aggregate(parts,
          named_struct('owed', 0.0D, 'copies', cast(array() as array<array<bigint>>)),
          (whole, part) -> transform(array(aggregate(part,
              named_struct('owed', whole.owed, 'copies', cast(array() as array<bigint>)),
              (a, c) -> named_struct('owed', {words} - c.size * {copies}, 'copies', array_append(a.copies, {copies})))),
            done -> named_struct('owed', done.owed, 'copies', array_append(whole.copies, done.copies)))[0],
          whole -> flatten(whole.copies))"""
    return (
        lists.withColumn("copies", F.expr(folded))
        .select("source", F.explode(F.arrays_zip("cells", "copies")).alias("z"))
        .select("source", F.col("z.cells.size").alias("size"), F.col("z.cells.n").alias("n"), F.col("z.copies").alias("copies"))
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, carry: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id (or ``carry``), size, source_size, target, copies and taken = copies * size."""
    carry = carry or ["doc_id"]
    sized = stored(sizes(docs.select("doc_id", "source", "text", F.struct(*carry).alias("row"))).select("row", "doc_id", "source", "size"))
    cells = stored(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    wanted = stored(targets(ranked_sources(cells), weights, cap))
    rated = rates(cells, wanted.select(F.col("source").alias("wanted_source"), "target"), float(cap))
    dealt = stored(
        copies_per_cell(rated, cap).select(
            F.col("source").alias("cell_source"), F.col("size").alias("cell_size"), F.ceil(F.col("n") / _CHUNK).alias("chunks"),
            F.floor(F.col("copies") / F.col("n")).alias("base"), (F.col("copies") % F.col("n")).alias("extra"),
        )
    )
    joined = sized.join(_bounded(dealt), F.expr("cell_source <=> source and cell_size = size"), "left").join(
        _bounded(wanted.select(F.col("source").alias("wanted_source"), "source_size", "target")), F.expr("wanted_source <=> source")
    )
    mark = F.xxhash64("doc_id")
    joined = joined.withColumn("mark", mark).withColumn("chunk", F.when(F.col("extra") > 0, F.pmod("mark", F.col("chunks"))))
    some = joined.where("extra > 0")
    counts = stored(some.groupBy("source", "size", "chunk").agg(F.count("*").alias("m")))
    before = Window.partitionBy("source", "size").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(
        F.col("source").alias("s"), F.col("size").alias("z"), F.col("chunk").alias("c"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("shift")
    )
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("source", "size", "chunk").orderBy("mark", "doc_id")))
    ranked = ranked.join(_bounded(stored(shifts)), F.expr("s <=> source and z = size and c = chunk"))
    got = F.col("base") + (F.col("rank") + F.col("shift") <= F.col("extra")).cast("long")
    out = ["row", "size", "source_size", "target"]
    rest = joined.where("extra is null or extra = 0").select(*out, F.coalesce("base", F.lit(0)).cast("long").alias("copies"))
    return ranked.select(*out, got.cast("long").alias("copies")).unionByName(rest).select(
        "row.*", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )
