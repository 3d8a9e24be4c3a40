"""Reports as files and as text: summaries, evidence, tables and window digests.

Text is made by aggregation in Spark, one line a row, and joined in a stated order; only a report,
whose number of rows is checked, becomes one file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a report that become one file.
REPORT_ROWS = 100_000


def _bounded(rows: DataFrame, most: int) -> DataFrame:
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"a report holds at most {most} rows")
    return rows.coalesce(1)


def _cell(value: Column) -> Column:
    """A value as text of a table cell: null is a dash, bars and line ends are escaped."""
    text = F.regexp_replace(F.regexp_replace(value.cast("string"), r"\|", r"\\|"), r"[\r\n]+", " ")
    return F.coalesce(text, F.lit("-"))


def markdown(rows: DataFrame, columns: list[str], order: list[str], keys: list[str] | None = None) -> DataFrame:
    """Keys and ``text``, a table of the columns with one line for each row in order; without rows there is no text."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(_cell(F.col(f"`{c}`")) for c in columns)), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns)
    listed = rows.select(*(keys or []), F.struct(*(F.col(f"`{c}`") for c in order), line.alias("__line")).alias("__l"))
    lines = F.transform(F.sort_array(F.collect_list("__l")), lambda x: x["__line"])
    return listed.groupBy(*(keys or [])).agg(lines.alias("__lines")).where(F.size("__lines") > 0).select(*(keys or []), F.concat_ws("\n", F.lit(head), "__lines").alias("text"))


def write_text(text: DataFrame, path: str) -> None:
    """Rows of ``text`` as one text file, in their order."""
    _bounded(text.select("text"), REPORT_ROWS).write.mode("overwrite").text(path)


def write_json(rows: DataFrame, path: str) -> None:
    """A report's rows as one file of JSON lines; null fields are written."""
    _bounded(rows, REPORT_ROWS).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(rows: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Evidence rows as CSV with a header, quoted where needed, in order: one file, or for more rows one after the other."""
    small = rows.limit(REPORT_ROWS + 1).count() <= REPORT_ROWS
    kept = rows.coalesce(1) if small else rows
    kept = (kept.sortWithinPartitions(*order) if small else kept.orderBy(*order)) if order else kept
    kept.write.mode("overwrite").option("header", True).option("escape", '"').option("maxRecordsPerFile", REPORT_ROWS).csv(path)


def calibration_report(frames: DataFrame, runs: DataFrame, group: str, valid: Column) -> DataFrame:
    """For each group its frames, the valid ones, their share, and the drop-outs (first, last, n, mean) in order."""
    per = frames.groupBy(group).agg(F.count("*").alias("n_frames"), F.count_if(valid).alias("n_valid"))
    lost = runs.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("first", "last", "n", "mean"))).alias("dropouts"))
    none = F.array().cast(dict(lost.dtypes)["dropouts"])
    full = per.join(lost, group, "left").withColumn("dropouts", F.coalesce("dropouts", none))
    return full.withColumn("valid_share", F.col("n_valid") / F.col("n_frames")).withColumn("status", F.when(F.size("dropouts") > 0, "dropout").otherwise("ok"))


def image_list(images: DataFrame, videos: DataFrame) -> DataFrame:
    """file_name, id, frame_id, vid_id and labelled of the images of known videos, as an outside evaluator reads them.

    images: id, video_id, frame, file_path, is_labeled; videos: id, name. Paths are kept from the video's name on.
    """
    named = images.join(videos.select(F.col("id").alias("video_id"), "name"), "video_id")
    tail = F.regexp_extract("file_path", r"([^/]+)$", 1)
    labelled = F.coalesce(F.col("is_labeled"), F.lit(False)) if "is_labeled" in images.columns else F.lit(False)
    return named.select(F.concat_ws("/", "name", tail).alias("file_name"), "id", F.col("id").alias("frame_id"), F.col("video_id").alias("vid_id"), labelled.alias("is_labeled"))


# Digest of visible topology

LINES = {"forward": "attacking_forward", "midfield": "attacking_midfield", "last_line": "defending_defensive"}


def digest_rows(lines: DataFrame, zones: DataFrame, balls: DataFrame, stride_s: float = 0.5) -> DataFrame:
    """Clip, window, t, attacking_team, each line's team, x_m and span_m, inter_line_gap_m, ball and the sorted distinct gaps.

    Only renderable lines with members are told; the gap is the depth of the space between the attacking lines.
    """
    mean = F.aggregate(F.transform("members", lambda m: m["x_m"]), F.lit(0.0), lambda s, v: s + v) / F.size("members")
    told = F.when((F.col("status") == "renderable") & (F.size("members") > 0), F.struct("team", F.bround(mean, 1).alias("x_m"), F.col("lateral_span_m").alias("span_m")))
    pick = lambda line: F.max(F.when(F.col("line") == line, told))
    gaps = F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_gaps"))))
    per = lines.groupBy("clip", "window", "attacking_team").agg(*(pick(line).alias(n) for n, line in LINES.items()), gaps.alias("gaps"))
    xs = F.transform("polygon", lambda p: p[0])
    space = zones.where("type = 'inter_line_space'").select("clip", "window", F.bround(F.array_max(xs) - F.array_min(xs), 1).alias("inter_line_gap_m"))
    ball = balls.select("clip", "window", F.struct("x_m", "y_m", "displacement_m").alias("ball"))
    full = per.join(space, ["clip", "window"], "left").join(ball, ["clip", "window"], "left")
    return full.select("clip", "window", (F.col("window") * stride_s).alias("t"), "attacking_team", *LINES, "inter_line_gap_m", "ball", "gaps")


def digest_text(rows: DataFrame, clips: DataFrame) -> DataFrame:
    """Clip and ``text``: a head with the source of positions, then one line for each window in order; clips has clip, position_source.

    A clip without windows says so.
    """
    number = lambda c: c.cast("string")
    part = lambda n: F.when(F.col(n).isNotNull(), F.concat(F.lit(f"{n}["), F.col(n)["team"], F.lit("]=x"), number(F.col(n)["x_m"]), F.lit("m/span"), number(F.col(n)["span_m"]), F.lit("m")))
    b = F.col("ball")
    line = F.concat_ws(
        " ", F.format_string("t=%.1fs", "t"), F.concat(F.lit("attack="), F.nullif(F.col("attacking_team"), F.lit(""))), *(part(n) for n in LINES),
        F.concat(F.lit("gap="), number(F.col("inter_line_gap_m")), F.lit("m")),
        F.when(b.isNotNull(), F.concat(F.lit("ball=x"), number(b["x_m"]), F.lit("m/y"), number(b["y_m"]), F.lit("m/move"), number(b["displacement_m"]), F.lit("m"))),
        F.when(F.size("gaps") > 0, F.concat(F.lit("gaps="), F.array_join("gaps", "|"))),
    )
    listed = rows.select("clip", F.struct("window", line.alias("line")).alias("l")).groupBy("clip").agg(F.transform(F.sort_array(F.collect_list("l")), lambda x: x["line"]).alias("lines"))
    none = F.array(F.lit("no renderable topology windows (insufficient ball/goalkeeper/possession evidence)"))
    head = F.concat(F.lit("position_source="), F.coalesce("position_source", F.lit("")))
    return clips.join(listed, "clip", "left").select("clip", F.concat_ws("\n", head, F.coalesce("lines", none)).alias("text"))
