"""Sources (S01-S14, S16, S19-S26, S30, S31, S33, S39, S42): every reader states its schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import geometry
from ..operators import ordered


def labels(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Whole label documents, one row for each file, with the file's path."""
    return spark.read.json(path, schema=schemas.LABELS, multiLine=True).withColumn("path", F.input_file_name())


def positions(documents: DataFrame, video: Column | None = None) -> DataFrame:
    """Pitch positions: annotations with both foot coordinates.

    The frame is the number in the file name of the annotation's image, else the image id as a number;
    track_id falls back to the annotation's id, role to other, an empty jersey to null.
    """
    key = (video if video is not None else F.coalesce("info.name", "path")).alias("clip")
    doc = documents.select(key, "images", "annotations")
    frame = F.regexp_extract("i.file_name", r"([0-9]+)\.[^.]*$", 1).try_cast("long").alias("__f")
    images = doc.select("clip", F.explode("images").alias("i")).select("clip", F.col("i.image_id").alias("image_id"), frame)
    rows = doc.select("clip", F.posexplode("annotations").alias("pos", "a")).where(F.col("a.bbox_pitch.x_bottom_middle").isNotNull() & F.col("a.bbox_pitch.y_bottom_middle").isNotNull())
    flat = rows.select(
        "clip", "pos", F.col("a.image_id").alias("image_id"), F.coalesce("a.track_id", F.expr("try_cast(a.id as bigint)")).alias("track_id"), F.col("a.attributes.team").alias("team"),
        F.coalesce("a.attributes.role", F.lit("other")).alias("role"), F.expr("try_cast(nullif(a.attributes.jersey, '') as int)").alias("jersey_number"),
        F.col("a.bbox_pitch.x_bottom_middle").alias("x"), F.col("a.bbox_pitch.y_bottom_middle").alias("y"),
    )
    joined = flat.join(images, ["clip", "image_id"], "left")
    return joined.withColumn("frame", F.coalesce("__f", F.expr("try_cast(image_id as bigint)"))).drop("__f", "image_id")


def flattened_annotations(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Object rows with attributes as columns, boxes and team cluster; and all other annotations."""
    rows = documents.select(F.col("info.id").alias("video_id"), F.explode("annotations").alias("a"))
    box = F.array("a.bbox_image.x", "a.bbox_image.y", "a.bbox_image.w", "a.bbox_image.h")
    objects = rows.where("a.supercategory = 'object'").select(
        "video_id", "a.id", "a.image_id", "a.track_id", "a.category_id", F.when(F.col("a.bbox_image").isNotNull(), box).alias("bbox_ltwh"),
        geometry.sane_pitch_box(F.col("a.bbox_pitch")).alias("bbox_pitch"), "a.attributes.role", "a.attributes.team", F.expr("nullif(a.attributes.jersey, '')").alias("jersey_number"),
        F.expr("case when a.attributes.team is not null then cast(a.attributes.team = 'left' as double) end").alias("team_cluster"),
    )
    return objects, rows.where("not (a.supercategory <=> 'object')").select("video_id", "a.*")


def numbered_frames(spark: SparkSession, video_id: str, n: int) -> DataFrame:
    """S03 without a label file: frames from 0 with padded names from 1."""
    return spark.range(n).select(F.lit(video_id).alias("video_id"), F.col("id").alias("frame"), F.format_string("%06d", F.col("id") + 1).alias("image_id"))


def with_person_keys(rows: DataFrame, category: str) -> DataFrame:
    """A dense category number over sorted names, and a key of video, image and track."""
    names = ordered.numbered(rows.select(category).distinct(), [category], "category_no")
    key = F.concat_ws("_", "video_id", "image_id", F.col("track_id").cast("string"))
    return rows.join(names, category, "left").withColumn("person_key", key)


def jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """One object for each line that is not blank."""
    return spark.read.schema(schema).json(path)


def all_string_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """String columns under a header; a missing required column is an error."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    found = [c.lstrip("﻿") for c in rows.columns]
    missing = set(columns) - set(found)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    return rows.toDF(*found).select(*columns)


def glossary(spark: SparkSession, path: str, key: str, lists: list[str], confusable: list[tuple[str, str]]) -> DataFrame:
    """Cells of several lines as arrays, pairs of columns as one array of structs, the last row of an id."""
    from ..functions.text import split_lines

    names = [key, *lists, *(c for pair in confusable for c in pair)]
    rows = all_string_csv(spark, path, names).withColumn("__n", F.monotonically_increasing_id()).where(F.trim(key) != "")
    last = rows.groupBy(key).agg(F.max_by(F.struct(*names[1:]), "__n").alias("r"))
    pairs = F.array(*(F.struct(F.col(f"r.{a}").alias("id"), F.col(f"r.{b}").alias("difference")) for a, b in confusable))
    return last.select(key, *(split_lines(F.col(f"r.{c}")).alias(c) for c in lists), F.filter(pairs, lambda p: F.trim(p["id"]) != "").alias("confusable"))


def mot_text(spark: SparkSession, path: str, min_confidence: float = -1.0) -> DataFrame:
    """Comma or blank separated tracks; x and y from 1 become from 0."""
    v = F.split(F.trim("value"), r"[\s,]+")
    number = lambda k: F.try_element_at(v, F.lit(k)).try_cast("double")
    rows = spark.read.text(path).where(F.trim("value") != "").select(
        number(1).cast("long").alias("frame"), number(2).cast("long").alias("id"), (number(3) - 1).alias("x"), (number(4) - 1).alias("y"), number(5).alias("w"), number(6).alias("h"),
        number(7).alias("confidence"), number(8).cast("int").alias("class_id"), number(9).alias("visibility"),
    )
    return rows.where(F.coalesce("confidence", F.lit(1.0)) >= min_confidence)


def vatic_text(spark: SparkSession, path: str) -> DataFrame:
    """Blank separated tracks with activity names at the end, one flag column for each name."""
    v = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(v.alias("v"))
    flat = rows.select(
        F.col("v")[0].cast("long").alias("id"), F.col("v")[5].cast("long").alias("frame"), F.col("v")[1].cast("double").alias("x"), F.col("v")[2].cast("double").alias("y"),
        (F.col("v")[3].cast("double") - F.col("v")[1].cast("double")).alias("w"), (F.col("v")[4].cast("double") - F.col("v")[2].cast("double")).alias("h"),
        *((F.col("v")[k] == "1").alias(n) for k, n in ((6, "lost"), (7, "occluded"), (8, "generated"))), F.trim(F.col("v")[9], F.lit('"')).alias("label"),
        F.transform(F.slice("v", 11, 1000), lambda a: F.trim(a, F.lit('"'))).alias("activities"),
    )
    names = sorted(r[0] for r in flat.select(F.explode("activities")).distinct().collect())  # names of activities, not rows
    return flat.select(*[c for c in flat.columns if c != "activities"], *(F.array_contains("activities", n).alias(n) for n in names))


def detrac_xml(spark: SparkSession, path: str) -> DataFrame:
    """XML frames with target boxes."""
    schema = "_num long, target_list struct<target: array<struct<_id: long, box: struct<_left: double, _top: double, _width: double, _height: double>>>>"
    rows = spark.read.format("xml").option("rowTag", "frame").schema(schema).load(path)
    t = F.explode("target_list.target").alias("t")
    return rows.select(F.col("_num").alias("frame"), t).select(
        "frame", F.col("t._id").alias("id"), F.col("t.box._left").alias("x"), F.col("t.box._top").alias("y"), F.col("t.box._width").alias("w"), F.col("t.box._height").alias("h")
    )


FORMATS = {"mot": mot_text, "vatic": vatic_text, "detrac": detrac_xml}


def tracks(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    """By name of the format."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}; known: {sorted(FORMATS)}")
    return FORMATS[kind](spark, path, **options)


def rle_sequence(spark: SparkSession, path: str) -> DataFrame:
    """Masks by class and timestep, in order of id."""
    schema = "t long, id long, class_id int, score double, h int, w int, rle string"
    rows = spark.read.csv(path, schema=schema, sep=" ")
    return rows.groupBy("class_id", "t").agg(F.sort_array(F.collect_list(F.struct("id", "score", "h", "w", "rle"))).alias("masks"))


def state(spark: SparkSession, path: str, videos: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """The stored table of videos, with pruned partitions and columns."""
    rows = spark.read.parquet(path)
    if videos is not None:
        rows = rows.where(F.col("video_id").isin(videos))
    return rows.select(*columns) if columns else rows


def ground_truth(rows: DataFrame, columns: list[str], drop_ball: bool) -> DataFrame:
    """The wanted columns that exist; the ball goes on demand, rows without a role stay."""
    out = rows.where("role is distinct from 'ball'") if drop_ball and "role" in rows.columns else rows
    return out.select(*(c for c in columns if c in rows.columns))


def external_detections(rows: DataFrame, images: DataFrame) -> DataFrame:
    """Confidence from keypoints, or from scores when no keypoint of the table has any; video by image."""
    mean = F.aggregate("keypoints", F.lit(0.0), lambda s, k: s + k["c"]) / F.size("keypoints")
    conf = rows.withColumn("__k", F.coalesce(mean, F.lit(0.0)))
    total = conf.agg(F.sum("__k").alias("__t"))
    scores = F.aggregate("scores", F.lit(0.0), lambda s, v: s + v) / F.size("scores")
    full = conf.join(F.broadcast(total)).withColumn("bbox_conf", F.when(F.col("__t") == 0, scores).otherwise(F.col("__k"))).drop("__k", "__t")  # one row of one sum
    return full.join(images.select("image_id", "video_id"), "image_id", "left")


def homographies(spark: SparkSession, path: str) -> DataFrame:
    """image_id to matrix, inverse and validity."""
    body = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, struct<H: array<array<double>>, H_inv: array<array<double>>, valid: boolean>>").alias("m"))
    return body.select(F.explode("m").alias("image_id", "e")).select("image_id", F.col("e.H").alias("h"), F.col("e.H_inv").alias("h_inverse"), F.col("e.valid").alias("valid"))


def files(spark: SparkSession, root: str, pattern: str = "*.mp4", digest: bool = False) -> DataFrame:
    """Paths and sizes of files below a folder, in order of path; contents only for a digest."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    out = [F.col("path"), F.col("length")] + ([F.sha2("content", 256).alias("sha256")] if digest else [])
    return rows.select(*out)


def effect_events(rows: DataFrame, importance: dict[str, int]) -> DataFrame:
    """Importance at least the event code's own; a missing or zero time is the middle of the span."""
    known = F.create_map(*(F.lit(x) for pair in importance.items() for x in pair))
    at = F.coalesce(F.nullif("timestamp_s", F.lit(0.0)), (F.col("start_s") + F.col("end_s")) / 2)
    return rows.withColumn("importance", F.greatest(F.coalesce("importance", F.lit(0)), F.coalesce(known[F.col("event")], F.lit(0)))).withColumn("timestamp_s", at)


def commentary_segments(rows: DataFrame) -> DataFrame:
    """Two record shapes (start_s, end_s, text) and (timestamp_s, duration_s, commentary) as segments."""
    start = F.coalesce("start_s", "timestamp_s")
    return rows.select(start.alias("start_s"), F.coalesce("end_s", start + F.col("duration_s")).alias("end_s"), F.coalesce("text", "commentary").alias("text"))


def preferred_source(candidates: DataFrame, key: str) -> DataFrame:
    """The candidate of highest priority (smallest number); two of one priority are an error."""
    first = candidates.groupBy(key).agg(F.min("priority").alias("priority"))
    picked = candidates.join(first, [key, "priority"])
    twice = F.raise_error(F.concat(F.lit("several sources for "), F.col(key).cast("string"))).cast("string")
    per = picked.groupBy(key, "priority").agg(F.count("*").alias("n"), F.min("path").alias("path"))
    return per.select(key, "priority", F.when(F.col("n") == 1, F.col("path")).otherwise(twice).alias("path"))


def legible_jersey(jersey: Column, legibility: Column, least: float = 0.5) -> Column:
    """The number as (head, tail) digits when it is legible and within 0 to 99."""
    ok = (legibility > least) & jersey.between(0, 99)
    return F.when(ok, F.struct(F.when(jersey >= 10, F.floor(jersey / 10)).cast("int").alias("head"), (jersey % 10).cast("int").alias("tail")))


def with_defaults(overrides: Column, defaults: dict[str, float], low: float, high: float) -> Column:
    """A map of defaults in which known keys take given values, clipped."""
    base = F.create_map(*(F.lit(x) for pair in defaults.items() for x in (pair[0], float(pair[1]))))
    known = F.map_filter(overrides, lambda k, v: k.isin(list(defaults)) & v.isNotNull() & ~F.isnan(v))
    return F.transform_values(base, lambda k, v: F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce(known[k], v))))


def public_detections(state_rows: DataFrame, columns: list[str]) -> DataFrame:
    """The detections that come with the data, as if they were predicted: wanted columns that exist, truth ids left out."""
    return state_rows.drop("track_id").select(*(c for c in columns if c in state_rows.columns and c != "track_id"))


def predictions_index(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Frame, image_id and the annotations of each image in their stored order (``pos``); images without any have an empty list.

    The frame is the number in the image's file name; images without one are left out.
    """
    names = [c for c in annotations.columns if c not in ("image_id", "pos")]
    per = annotations.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("pos", *names))).alias("annotations"))
    frame = F.regexp_extract("file_name", r"([0-9]+)\.[^.]*$", 1).try_cast("long")
    listed = images.select(frame.alias("frame"), "image_id").where("frame is not null").join(per, "image_id", "left")
    return listed.withColumn("annotations", F.coalesce("annotations", F.array().cast(dict(per.dtypes)["annotations"]))).select("frame", "image_id", "annotations")


def metric_details(spark: SparkSession, paths: dict[str, str], seq: str = "seq") -> DataFrame:
    """Tracker, seq, field, value from the wide CSV files of several trackers; files may have different columns."""
    out = None
    for tracker, path in paths.items():
        rows = spark.read.csv(path, header=True)
        fields = [c for c in rows.columns if c != seq]
        pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").try_cast("double").alias("value")) for c in fields))
        long = rows.select(F.lit(tracker).alias("tracker"), seq, F.explode(pairs).alias("z")).select("tracker", seq, "z.*")
        out = long if out is None else out.unionByName(long)
    if out is None:
        raise ValueError("no tracker is given")
    return out.where("value is not null")
