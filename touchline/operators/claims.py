"""Claims, votes and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import half_even


def sample_vote(samples: DataFrame, card: list[str], verdict: str, confidence: str, pos: str, ordered: bool = False) -> DataFrame:
    """Modal verdict, half-even rounded mean confidence of its samples, nearest sample as representative.

    An even number of samples of a card is an error. A sum of doubles depends on the order of its rows: a mean some bits
    beside a tie is taken for one, or, with ``ordered``, confidences are added in the order of ``pos`` and rounded as they come.
    """
    if ordered:
        before = Window.partitionBy(*card, verdict).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
        summed = samples.select("*", F.sum(confidence).over(before).alias("__sum"), F.count("*").over(before).alias("__at"))
        mean, slack = F.try_divide(F.max_by("__sum", "__at"), F.count(confidence)), 0
    else:
        summed, mean, slack = samples, F.avg(confidence), 4
    per = summed.groupBy(*card, verdict).agg(F.count("*").alias("n"), mean.alias("mean"), F.min(pos).alias("first"))
    total = per.groupBy(*card).agg(F.sum("n").alias("all"), F.max_by(F.struct(verdict, "mean"), F.struct(F.col("n"), -F.col("first"))).alias("best"))
    odd = F.when(F.col("all") % 2 == 1, F.col("all")).otherwise(F.raise_error(F.lit("an odd number of samples is needed")).cast("long"))
    won = total.select(*card, odd.alias("samples"), F.col(f"best.{verdict}").alias(verdict), half_even(F.col("best.mean"), slack=slack).alias(confidence))
    own = samples.withColumnRenamed(confidence, "__c")
    near = won.join(own, [*card, verdict]).groupBy(*card, verdict, confidence, "samples")
    return near.agg(F.min_by(pos, F.struct(F.abs(F.col("__c") - F.col(confidence)), F.col(pos))).alias("representative"))


def matched_claims(claims: DataFrame, runs: DataFrame, threshold: float) -> DataFrame:
    """Claims (clip_uid, tactic_id, start_s, end_s, truth) with covered and predicted.

    A claim is predicted when its tactic is assessed present with enough confidence and some evidence
    span strictly overlaps its window. runs has clip_uid and assessments.
    """
    said = runs.select(F.col("clip_uid").alias("__clip"), F.explode_outer("assessments").alias("a"))
    per = said.groupBy("__clip", F.col("a.tactic_id").alias("__tactic")).agg(
        F.collect_list(F.when((F.col("a.verdict") == "present") & (F.col("a.confidence") >= threshold), F.col("a.evidence_spans"))).alias("spans")
    )
    clips = runs.select(F.col("clip_uid").alias("__covered")).distinct()
    joined = claims.join(per, (F.col("clip_uid") == F.col("__clip")) & (F.col("tactic_id") == F.col("__tactic")), "left").join(
        clips, F.col("clip_uid") == F.col("__covered"), "left"
    )
    hit = F.exists(F.flatten("spans"), lambda s: F.least(s["end_s"], F.col("end_s")) > F.greatest(s["start_s"], F.col("start_s")))
    return joined.select(*claims.columns, F.col("__covered").isNotNull().alias("covered"), F.coalesce(hit, F.lit(False)).alias("predicted"))


def claim_metrics(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1, accuracy, coverage and the baseline of truth, covered, predicted.

    Precision is null when nothing is predicted, accuracy unless all rows are covered; F1 is 0 where it
    is undefined but null without rows.
    """
    tp, fp = F.count_if(F.col("predicted") & F.col("truth")), F.count_if(F.col("predicted") & ~F.col("truth"))
    fn = F.count_if(~F.col("predicted") & F.col("truth"))
    counted = rows.groupBy(*(keys or [])).agg(
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.count_if(F.col("predicted") == F.col("truth")).alias("right"),
        F.count_if("covered").alias("covered"), F.count("*").alias("n"), F.count_if("truth").alias("positives"),
    )
    precision = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))
    recall = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    f1 = F.when(F.col("n") > 0, F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)))
    accuracy = F.when(F.col("covered") == F.col("n"), F.try_divide(F.col("right").cast("double"), F.col("n")))
    return counted.select(
        *(keys or []), "tp", "fp", "fn", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), accuracy.alias("accuracy"),
        F.try_divide(F.col("covered").cast("double"), F.col("n")).alias("coverage"), F.try_divide(F.col("positives").cast("double"), F.col("n")).alias("baseline"),
    )


def threshold_curve(rows: DataFrame, score: str, truth: Column, thresholds: list[float]) -> DataFrame:
    """A17 at many thresholds in one pass: each row counts for the thresholds that it reaches."""
    reached = F.filter(F.array(*map(F.lit, thresholds)), lambda t: t <= F.col(score))
    long = rows.select(F.explode(reached).alias("threshold"), truth.alias("y"))
    counts = long.groupBy("threshold").agg(F.count_if("y").alias("tp"), F.count_if(~F.col("y")).alias("fp"))
    total = rows.agg(F.count_if(truth).alias("positives"))
    grid = rows.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    full = grid.join(counts, "threshold", "left").join(F.broadcast(total))  # one row of totals
    tp, fp = F.coalesce("tp", F.lit(0)), F.coalesce("fp", F.lit(0))
    return full.select("threshold", tp.alias("tp"), fp.alias("fp"), (F.col("positives") - tp).alias("fn"))


def macro_scores(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Accuracy, macro precision, recall and F1 over all classes; an empty class counts as 0.

    Macro accuracy is over classes that occur in the truth.
    """
    t = rows.groupBy(F.col(truth).alias("c")).agg(F.count("*").alias("t"), F.count_if(F.col(truth) == F.col(predicted)).alias("tp"))
    p = rows.groupBy(F.col(predicted).alias("c")).agg(F.count("*").alias("p"))
    both = t.join(p, "c", "full_outer").select("c", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("t", "p", "tp")))
    precision = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("p")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("t")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("t") + F.col("p")), F.lit(0.0))
    return both.agg(
        (F.sum("tp") / F.sum("t")).alias("accuracy"), F.avg(precision).alias("macro_precision"), F.avg(recall).alias("macro_recall"),
        F.avg(f1).alias("macro_f1"), F.avg(F.when(F.col("t") > 0, recall)).alias("macro_accuracy"),
    )


def class_confusion(detected: DataFrame, truth: DataFrame, image: str, kind: str, ok: str) -> DataFrame:
    """Per image true positives, false positives and false negatives of line classes.

    A class on one side only counts by presence; a common one by its ``ok`` flag of the detected side.
    """
    d, t = detected.select(image, kind, F.col(ok).alias("__ok")), truth.select(image, kind).withColumn("__t", F.lit(True))
    both = d.join(t, [image, kind], "full_outer")
    hit = F.col("__t").isNotNull() & F.coalesce("__ok", F.lit(False))
    wrong = F.col("__ok").isNotNull() & ~hit
    return both.groupBy(image).agg(F.count_if(hit).alias("tp"), F.count_if(wrong).alias("fp"), F.count_if(F.col("__t").isNotNull() & ~hit).alias("fn"))


def mean_and_spread(rows: DataFrame, value: str) -> DataFrame:
    """Mean and sample deviation."""
    return rows.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def screened(assessments: DataFrame, clip: str, confidence: str, card: str, most: int = 8) -> DataFrame:
    """At most so many cards of a clip go on, the most confident first."""
    w = Window.partitionBy(clip).orderBy(F.desc(confidence), card)
    return assessments.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).drop("__r")


def mapping_status(exact: Column, mapped: Column, candidate: Column) -> Column:
    """Exact before mapped before candidate before not applicable."""
    return F.when(exact, "exact").when(mapped, "model_mapped").when(candidate, "candidate").otherwise("not_applicable")
