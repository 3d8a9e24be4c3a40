"""Sinks (K01-K06, K09, K10, K15): partitioned tables, tracking text, label JSON, wide summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import boxes, geometry


def append_state(rows: DataFrame, path: str) -> int:
    """Write the videos that the table does not hold yet, one partition each; the number of them."""
    spark = rows.sparkSession
    fresh = rows
    if exists(spark, path):
        done = spark.read.parquet(path).select("video_id").distinct()
        fresh = rows.join(done, "video_id", "left_anti")
    n = fresh.select("video_id").distinct().count()
    if n:
        fresh.repartition("video_id").write.mode("append").partitionBy("video_id").parquet(path)
    return n


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def mot_rows(detections: DataFrame, images: DataFrame, box: str = "bbox_ltwh") -> DataFrame:
    """Frame, id, box, confidence and -1 three times; frames from 0 become from 1, per video."""
    joined = detections.join(images.select("image_id", "video_id", "frame"), ["image_id"] + (["video_id"] if "video_id" in detections.columns else []))
    whole = joined.where(F.col("frame").isNotNull() & F.col("track_id").isNotNull() & F.col(box).isNotNull())
    shift = (F.min("frame").over(Window.partitionBy("video_id")) == 0).cast("long")
    part = [F.col(box)[k].alias(n) for k, n in enumerate(("bb_left", "bb_top", "bb_width", "bb_height"))]
    return whole.select("video_id", (F.col("frame") + shift).alias("frame"), F.col("track_id").alias("id"), *part, F.col("bbox_conf").alias("conf"), *(F.lit(-1).alias(c) for c in "xyz"))


def write_mot(rows: DataFrame, path: str) -> None:
    """A folder of CSV for each video, in order of frame."""
    rows.repartition("video_id").sortWithinPartitions("video_id", "frame", "id").write.mode("overwrite").partitionBy("video_id").csv(path)


def label_annotations(detections: DataFrame, homographies: DataFrame) -> DataFrame:
    """Annotations to export: with a pitch box, or with an image box where the camera is invalid."""
    joined = detections.join(homographies.select("image_id", F.col("valid").alias("__v")), "image_id", "left")
    pitch = geometry.sane_pitch_box(F.col("bbox_pitch"))
    image = geometry.image_box(F.col("bbox_ltwh"))
    keep = pitch.isNotNull() | (image.isNotNull() & ~F.coalesce("__v", F.lit(False)))
    attributes = F.struct("role", "team", F.col("jersey_number").cast("string").alias("jersey"))
    ids = [F.col(c).cast("string").alias(c) for c in ("video_id", "image_id")]
    return joined.where(keep & F.col("track_id").isNotNull()).select(*ids, "track_id", image.alias("bbox_image"), pitch.alias("bbox_pitch"), attributes.alias("attributes"))


def with_label_balls(annotations: DataFrame, label_balls: DataFrame) -> DataFrame:
    """Balls of the labels join in where a video has no predicted ball."""
    have = annotations.where("attributes.role = 'ball'").select("video_id").distinct()
    return annotations.unionByName(label_balls.join(have, "video_id", "left_anti"), allowMissingColumns=True)


def write_label_json(annotations: DataFrame, path: str) -> None:
    """One JSON object for each annotation by video, null fields left out."""
    body = F.to_json(F.struct(*(c for c in annotations.columns if c != "video_id"))).alias("value")
    annotations.select("video_id", body).repartition("video_id").write.mode("overwrite").partitionBy("video_id").text(path)


def evaluation_documents(annotations: DataFrame, *more: DataFrame) -> DataFrame:
    """video_id and ``value``, one JSON document of all rows of a video, object, camera and pitch ones, sorted by id as text; null fields are left out."""
    rows = annotations
    for other in more:
        rows = rows.unionByName(other, allowMissingColumns=True)
    names = [c for c in rows.columns if c not in ("video_id", "id")]
    listed = rows.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), *names))).alias("predictions"))
    return listed.select("video_id", F.to_json(F.struct("predictions")).alias("value"))


def write_evaluation_documents(documents: DataFrame, path: str) -> None:
    """A folder for each video with one file in it."""
    documents.repartition("video_id").write.mode("overwrite").partitionBy("video_id").text(path)


def refined(rows: DataFrame, matched: DataFrame, inserted: DataFrame, key: str, video: str) -> DataFrame:
    """Matched rows get new track ids, other rows of refined videos go, inserted rows come, other videos stay."""
    videos = matched.select(video).unionByName(inserted.select(video)).distinct()
    untouched = rows.join(videos, video, "left_anti")
    updated = rows.drop("track_id").join(matched.select(key, F.col("new_track_id").alias("track_id")), key).select(*rows.columns)
    return untouched.unionByName(updated).unionByName(inserted.select(*rows.columns))


def merged_results(results: list[DataFrame], exempt: DataFrame, key: str) -> DataFrame:
    """All results but those of exempt keys."""
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out.join(exempt.select(key), key, "left_anti")


def write_wide_summary(rows: DataFrame, keys: list[str], field: str, value: str, path: str) -> None:
    """One column for each metric."""
    rows.groupBy(*keys).pivot(field).agg(F.first(value)).write.mode("overwrite").csv(path, header=True)


def write_rle(rows: DataFrame, path: str) -> None:
    """K10."""
    rows.select("t", "id", "class_id", "h", "w", "rle").write.mode("overwrite").csv(path, sep=" ")


def area_ltwh(box: str):
    return boxes.area(boxes.ltwh_to_ltrb(F.col(box)))
