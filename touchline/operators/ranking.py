"""Top-k, first-n, best-of, suppression, retrieval, sampling order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import frames as in_frames
from . import ordered


def top_k(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; adds ``rank``. Spark keeps only k rows of a group in each task."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_row(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """One row of each group."""
    return top_k(rows, group, order, 1).drop("rank")


def suppress(boxes: DataFrame, frame: str, threshold: float) -> DataFrame:
    """Greedy non-maximum suppression by score within each frame; boxes are (frame, box_id, score, box ltrb).

    The greedy rule is sequential; a frame's boxes are one small group, and a call takes many frames.
    """

    def fold(pdf: pd.DataFrame, firsts: np.ndarray) -> pd.DataFrame:
        group = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, len(pdf))))
        order = pdf.assign(__g=group).sort_values(["__g", "score", "box_id"], ascending=[True, False, True], kind="stable").index.to_numpy()
        sides = np.array(pdf["box"].tolist(), float)[order]
        keep = np.ones(len(pdf), bool)
        chosen: list[list[float]] = []
        at = -1
        for n, (g, a) in enumerate(zip(group[order].tolist(), sides.tolist(), strict=True)):
            if g != at:
                chosen, at = [], g
            for b in chosen:
                w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
                common = max(w, 0.0) * max(h, 0.0)
                union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - common
                if union > 0 and common / union > threshold:
                    keep[n] = False
                    break
            else:
                chosen.append(a)
        return pdf.iloc[order[keep]]

    return in_frames.by_group(boxes, [frame], fold, boxes.schema)


def painted(pixels: DataFrame, frame: str, pixel: str) -> DataFrame:
    """The mask of the highest score owns each pixel; ties go to the smaller id."""
    return pixels.groupBy(frame, pixel).agg(F.max_by("mask_id", F.struct(F.col("score"), -F.col("mask_id"))).alias("mask_id"))


def retrieval_accuracy(pairs: DataFrame, query: str, score: str, hit: Column, ks: tuple[int, ...], tie: str) -> DataFrame:
    """The share of queries with a hit among their k most similar candidates, for each k."""
    ranked = top_k(pairs.withColumn("__hit", hit), [query], [F.desc(score), F.asc(tie)], max(ks))
    per = ranked.groupBy(query).agg(*(F.max(F.when(F.col("rank") <= k, F.col("__hit").cast("int")).otherwise(0)).alias(f"top{k}") for k in ks))
    return per.agg(*(F.avg(f"top{k}").alias(f"top{k}") for k in ks))


def shuffled_groups(rows: DataFrame, group: str, key: str, epoch: int, shards: int) -> DataFrame:
    """Groups in order, each shuffled by a seeded hash, dealt to shards in turn; adds position and shard."""
    w = Window.partitionBy(group).orderBy(F.xxhash64(F.col(key), F.lit(epoch)), key)
    place = F.row_number().over(w) - 1
    return rows.withColumn("position", place).withColumn("shard", F.pmod("position", F.lit(shards)))


def precision_recall(rows: DataFrame, score: str, positive: Column, tie: str, group: str | None = None, spread: str | None = None) -> DataFrame:
    """Running precision and recall by falling score, over ranges of the scores.

    A score that many rows share is cut by ``spread``, a number that ``tie`` is ordered by first: ``tie`` itself where it is one.
    """
    numeric = dict(rows.dtypes)[tie].split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    out = ordered.running(rows, score, [tie], {"tp": positive.cast("int"), "seen": F.lit(1)}, True, group, spread or (tie if numeric else None))
    out = out.withColumnRenamed("tp_all", "positives").drop("seen_all")
    return out.withColumn("precision", F.col("tp") / F.col("seen")).withColumn("recall", F.col("tp") / F.col("positives"))


def interpolated_ap(curve: DataFrame, levels: int = 101) -> DataFrame:
    """The mean over recall levels of the best precision at that recall or beyond.

    The best precision from a recall on only changes at points of the curve, so each level looks up
    the envelope by the index of the level that a point first covers.
    """
    step = levels - 1
    reach = curve.withColumn("__l", F.floor(F.col("recall") * step + F.lit(1e-9)).cast("int")).groupBy("__l").agg(F.max("precision").alias("p"))
    grid = curve.sparkSession.range(levels).select(F.col("id").cast("int").alias("level"))
    per = grid.join(reach, F.col("level") == F.col("__l"), "left").coalesce(1)  # one row for each level
    best = F.max("p").over(Window.orderBy("level").rowsBetween(0, Window.unboundedFollowing))
    return per.select(F.coalesce(best, F.lit(0.0)).alias("p")).agg(F.avg("p").alias("ap"))


def stepwise_ap(curve: DataFrame, group: str | None = None) -> DataFrame:
    """Area under the monotone envelope of precision. ``curve`` has recall and precision, as ``precision_recall`` gives them.

    Precision only counts where recall rises, that is at the best point of each recall; the envelope over these is taken
    along ranges of recall: within a range by a window, from the ranges beyond by their best.
    """
    own = [group] if group else []
    steps = curve.where("recall > 0").groupBy(*own, "recall").agg(F.max("precision").alias("p"))
    steps = steps.withColumn("__k", F.floor(F.col("recall") * ordered.RANGES))
    here = Window.partitionBy(*own, "__k").orderBy("recall")
    ends = steps.groupBy(*own, "__k").agg(F.max("p").alias("__p"), F.max("recall").alias("__r"))  # one row for each range
    along = Window.partitionBy(*own).orderBy("__k")
    ends = ends.select(
        *(F.col(c).alias("__g") for c in own), F.col("__k").alias("__at"), F.max("__p").over(along.rowsBetween(1, Window.unboundedFollowing)).alias("__beyond"), F.lag("__r").over(along).alias("__from")
    )
    # the best from a row on is taken in falling order: a frame that ends at the last row is computed anew for each row
    back = Window.partitionBy(*own, "__k").orderBy(F.desc("recall")).rowsBetween(Window.unboundedPreceding, 0)
    inside = steps.withColumn("__e", F.max("p").over(back)).withColumn("__l", F.lag("recall").over(here))
    rise = F.col("recall") - F.coalesce("__l", "__from", F.lit(0.0))
    same = F.expr("__k = __at")
    met = inside.join(ends, same & F.col(group).eqNullSafe(F.col("__g")) if group else same)
    return met.groupBy(*own).agg(F.sum(F.greatest("__e", F.coalesce("__beyond", "__e")) * rise).alias("ap"))


def diverse_slots(candidates: DataFrame, slot: str, team: str, edition: str, most: int = 6) -> DataFrame:
    """Per slot repeatedly the best candidate by (no evidence, gaps, -spans, -confidence, team used, edition used, duration, path).

    Candidates have n_spans, n_gaps, confidence, duration, path; the choice depends on earlier ones, so a
    slot's candidates, a short list, are one group. Adds ``place``.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rest, used_t, used_e, out = pdf.to_dict("records"), set(), set(), []
        while rest and len(out) < most:
            key = lambda r: (r["n_spans"] == 0, r["n_gaps"], -r["n_spans"], -r["confidence"], r[team] in used_t, r[edition] in used_e, r["duration"], r["path"])  # noqa: B023, E731
            one = min(rest, key=key)
            rest.remove(one)
            used_t.add(one[team])
            used_e.add(one[edition])
            out.append({**one, "place": len(out)})
        return pd.DataFrame(out)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema)
    return candidates.groupBy(slot).applyInPandas(fold, f"{kinds}, place int")


def skyline(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Rows that no other row beats in both x and y; of rows equal in both one stays.

    The best y of each x comes first; then x is cut in ranges, and a range has to beat the best of all ranges beyond it.
    """
    names = [c for c in rows.columns if c not in (x, y)]
    best = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x).agg(F.max_by(F.struct(y, *names), y).alias("__b")).select(x, "__b.*")
    placed = ordered.ranged(best, x, "__k")
    tops = placed.groupBy("__k").agg(F.max(y).alias("__t"))  # one row for each range
    beyond = tops.select(F.col("__k").alias("__at"), F.max("__t").over(Window.orderBy(F.desc("__k")).rowsBetween(Window.unboundedPreceding, -1)).alias("__far"))
    near = F.max(y).over(Window.partitionBy("__k").orderBy(F.desc(x)).rowsBetween(Window.unboundedPreceding, -1))
    met = placed.withColumn("__near", near).join(beyond, F.expr("__k = __at"))
    top = F.greatest("__near", "__far")
    return met.where(top.isNull() | (F.col(y) > top)).select(*rows.columns)


def ordered_detections(rows: DataFrame) -> DataFrame:
    """By video, image and track, over the whole table: ranges of the order, one after the other in the partitions; null tracks last."""
    return rows.orderBy("video_id", "image_id", F.asc_nulls_last("track_id"))


def by_score(rows: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """The rows of each group by falling score as ``rank`` from 1, equal scores by ``tie``; null scores last."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(score), tie)))
