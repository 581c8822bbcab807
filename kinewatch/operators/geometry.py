"""Per-row detection work: conversion, filters, box geometry and record validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinewatch.functions.scalars import half_even, resolve_class_name


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected); a row is rejected when any rule is true, `_errors` lists which ones."""
    hits = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()])
    marked = df.withColumn("_errors", F.array_compact(hits))
    return marked.filter(F.size("_errors") == 0).drop("_errors"), marked.filter(F.size("_errors") > 0)


def convert_raw_detections(raw: DataFrame, class_names: dict[int, str],
                           aliases: dict[str, str]) -> DataFrame:
    """Names every raw box; a model's own `raw_class_name` column wins where the table has it."""
    own = F.col("raw_class_name") if "raw_class_name" in raw.columns else None
    return raw.withColumn(
        "class_name", resolve_class_name(F.col("class_id"), class_names, aliases, own))


def filter_person_classes(df: DataFrame, names: list[str]) -> DataFrame:
    return df.filter(F.col("class_name").isin(*names))


def filter_confidence(df: DataFrame, threshold: float) -> DataFrame:
    """Keeps rows at or above the threshold."""
    if not 0.0 <= threshold <= 1.0:
        raise ValueError("the detector threshold must be in [0, 1]")
    return df.filter(F.col("confidence") >= F.lit(float(threshold)))


def detection_rules() -> dict[str, Column]:
    c = F.col
    box = ["x1", "y1", "x2", "y2"]
    missing = c(box[0]).isNull()
    for b in box[1:]:
        missing = missing | c(b).isNull()
    return {
        "missing_box": missing,
        "empty_box": (c("x2") <= c("x1")) | (c("y2") <= c("y1")),
        "negative_corner": (c("x1") < 0) | (c("y1") < 0),
        "beyond_frame": (c("x2") > c("frame_width")) | (c("y2") > c("frame_height")),
        "bad_frame_size": ~((c("frame_width") > 0) & (c("frame_height") > 0))
        | c("frame_width").isNull() | c("frame_height").isNull(),
        "bad_confidence": c("confidence").isNull() | ~c("confidence").between(0.0, 1.0),
        "bad_id": c("frame_id").isNull() | (c("frame_id") < 0)
        | c("class_id").isNull() | (c("class_id") < 0),
        "missing_scope": (F.coalesce(F.length("source_id"), F.lit(0)) == 0)
        | (F.coalesce(F.length("session_id"), F.lit(0)) == 0),
    }


def validate_detections(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    rules = detection_rules()
    if "timestamp_seconds" in df.columns:
        t = F.col("timestamp_seconds")
        rules["bad_time"] = t.isNull() | (t < 0)
    if "class_name" in df.columns:
        rules["missing_class"] = F.coalesce(F.length("class_name"), F.lit(0)) == 0
    if "track_id" in df.columns:
        rules["bad_track"] = F.col("track_id").isNull() | (F.col("track_id") < 0)
    return split_valid(df, rules)


def validate_intervals(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ground truth, predictions and negative windows: non-negative start, positive duration."""
    start, end = F.col("start_time"), F.col("end_time")
    return split_valid(df, {
        "negative_start": start.isNull() | (start < 0),
        "non_positive_duration": end.isNull() | (end <= start),
    })


def validate_events(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ends come as a pair and never precede the start."""
    return split_valid(df, {
        "half_open_end": F.col("end_frame").isNull() != F.col("end_time").isNull(),
        "end_frame_before_start": F.col("end_frame") < F.col("start_frame"),
        "end_time_before_start": F.col("end_time") < F.col("start_time"),
    })


def with_bbox_geometry(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "width": F.col("x2") - F.col("x1"),
        "height": F.col("y2") - F.col("y1"),
        "center_x": (F.col("x1") + F.col("x2")) / 2.0,
        "center_y": (F.col("y1") + F.col("y2")) / 2.0,
    })


def crop_rect(df: DataFrame) -> DataFrame:
    """Whole-pixel crop of the box inside its frame; missing boxes and empty crops are dropped."""
    out = df.dropna(subset=["x1", "y1", "x2", "y2"]).withColumns({
        "crop_x1": F.greatest(F.lit(0), half_even(F.col("x1"))),
        "crop_y1": F.greatest(F.lit(0), half_even(F.col("y1"))),
        "crop_x2": F.least(F.col("frame_width").cast("long"), half_even(F.col("x2"))),
        "crop_y2": F.least(F.col("frame_height").cast("long"), half_even(F.col("y2"))),
    })
    return out.filter("crop_x2 > crop_x1 and crop_y2 > crop_y1")


def restore_posture(tracker_out: DataFrame, detections: DataFrame) -> DataFrame:
    """Joins track ids back to the full detection rows."""
    keys = ["source_id", "session_id", "frame_id", "detection_id"]
    return detections.join(tracker_out.select(*keys, "track_id"), keys)
