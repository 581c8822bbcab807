"""Sinks. Spark's commit protocol makes every batch write all-or-nothing."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinewatch.operators.lineage import cut
from kinewatch.operators.slices import small


def write_events(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Appends event snapshots or alerts."""
    df.write.mode("append").format(fmt).save(path)


def stream_events(df: DataFrame, path: str, checkpoint: str, kind: str, fmt: str = "json"
                  ) -> StreamingQuery:
    """Appends one kind of cascade rows from a stream, exactly once."""
    return (df.filter(F.col("kind") == kind).writeStream.format(fmt).outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def write_manifest(clips: DataFrame, path: str) -> None:
    """Manifest in the order of video ids as JSON and CSV lines, plus the small subset; existing output is refused.

    Files hold ranges of ids and are named in their order, so read by name they are the same bytes however the rows were
    spread before. The first line of each CSV table is in `columns` beside it. The clips are worked out once for all three.
    """
    clips = cut(clips)
    ordered = clips.orderBy("video_id")
    subset = clips.filter("small_validation_subset").orderBy("video_id")
    ordered.write.mode("errorifexists").json(f"{path}/manifest_json")
    for name, df in (("manifest_csv", ordered), ("small_subset_csv", subset)):
        df.write.mode("errorifexists").csv(f"{path}/{name}")
        head = clips.sparkSession.createDataFrame([(",".join(df.columns),)], "value string")
        head.coalesce(1).write.mode("errorifexists").text(f"{path}/{name}_columns")


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """position (from 0) and value of the lines of a table that was written in order, by file name and place within."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"),
                                         F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("_id"))
    splits = lines.groupBy("file", "start").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    # a row for each split; names count up with their ranges
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "start", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return lines.join(small(splits), ["file", "start"]).select((F.col("_id") + F.col("_shift")).alias("position"), "value")


def write_normalized_coco(images: DataFrame, annotations: DataFrame, categories: DataFrame,
                          path: str) -> None:
    """All tables or none: they go to a folder of their own, which one marker publishes in the end.

    Existing output is refused, before the work and once more by the marker. What a failed run leaves is never read.
    """
    spark = images.sparkSession
    marker = f"{path}/published"
    if _exists(spark, marker):
        raise FileExistsError(f"{path} exists already")
    folder = f"data-{uuid.uuid4().hex}"
    for name, df in (("images", images), ("annotations", annotations), ("categories", categories)):
        df.write.mode("errorifexists").json(f"{path}/{folder}/{name}")
    spark.createDataFrame([(folder,)], "value string").coalesce(1).write.mode("errorifexists").text(marker)


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path).schema  # noqa: B018  listing is what is asked for
    except AnalysisException:
        return False
    return True
