"""Review training samples: validation, packing into chat turns, group-isolated splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinewatch.operators.geometry import split_valid

# The target fields a packed answer carries, in order.
TARGET_FIELDS = ("decision", "confidence", "reason", "attempt_to_stand", "risk_level",
                 "model_recommends_alert")


def validate_samples(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): at least one image, text, a split group and a verified target."""
    verified = (F.col("target.ground_truth_verified") if "target" in samples.columns
                else F.col("ground_truth_verified"))
    images = F.size("image_refs") if "image_refs" in samples.columns else F.col("image_count")
    return split_valid(samples, {
        "no_images": images < 1,
        "no_text": F.coalesce(F.length("text_context"), F.lit(0)) == 0,
        "no_split_group": F.coalesce(F.length("split_group"), F.lit(0)) == 0,
        "target_not_verified": ~F.coalesce(verified, F.lit(False)),
    })


def pack_messages(samples: DataFrame) -> DataFrame:
    """Adds `messages`: a user turn (images, then text) and an assistant turn (target as JSON)."""
    part = "struct<type:string,image:string,text:string>"
    none = F.lit(None).cast("string")
    images = F.transform("image_refs", lambda x: F.struct(
        F.lit("image").alias("type"), x["path"].alias("image"), none.alias("text")).cast(part))
    text = F.array(F.struct(F.lit("text").alias("type"), none.alias("image"),
                            F.col("text_context").alias("text")).cast(part))
    answer = F.to_json(F.struct(*[F.col(f"target.{f}").alias(f) for f in TARGET_FIELDS]),
                       {"ignoreNullFields": "false"})
    no_parts = F.array().cast(f"array<{part}>")
    return samples.withColumn("messages", F.array(
        F.struct(F.lit("user").alias("role"), F.concat(images, text).alias("content"),
                 none.alias("answer")),
        F.struct(F.lit("assistant").alias("role"), no_parts.alias("content"),
                 answer.alias("answer"))))


def message_turns(packed: DataFrame) -> DataFrame:
    """One row per turn."""
    return packed.select("sample_id", F.posexplode("messages").alias("turn", "m")).select(
        "sample_id", "turn", "m.role", "m.content", "m.answer")


def missing_image_refs(samples: DataFrame, files: DataFrame) -> DataFrame:
    """(sample_id, path) of images that are not in the file list."""
    used = samples.select("sample_id", F.explode("image_refs.path").alias("path"))
    return used.join(files.select("path"), "path", "left_anti")


def split_by_group(df: DataFrame, group: str, ratios: tuple[float, float, float] = (0.7, 0.15, 0.15),
                   seed: int = 42) -> DataFrame:
    """Adds `split`; every group lies in one split and split sizes are fixed shares of the groups.

    Groups are ordered by a seeded hash. The cut points between splits are found with two small
    aggregations over the hashes, so groups are never sorted in one task.
    """
    if any(r < 0 for r in ratios) or abs(sum(ratios) - 1.0) > 1e-9:
        raise ValueError("split ratios must be non-negative and sum to one")
    groups = df.select(group).distinct().withColumn("_h", F.xxhash64(F.lit(seed), F.col(group)))
    # position = groups in lower buckets + position inside the bucket
    buckets = groups.withColumn("_b", F.shiftright("_h", 48))
    per = buckets.groupBy("_b").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # at most 65,536 rows
    offsets = per.withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    w = Window.partitionBy("_b").orderBy("_h", group)
    placed = buckets.withColumn("_i", F.row_number().over(w)).join(offsets, "_b").withColumn(
        "_pos", F.col("_o") + F.col("_i"))
    n = per.agg(F.sum("_n").alias("_total"))
    train = F.bround(F.col("_total") * F.lit(ratios[0]))
    validation = train + F.bround(F.col("_total") * F.lit(ratios[1]))
    split = (F.when(F.col("_pos") <= train, F.lit("train"))
             .when(F.col("_pos") <= validation, F.lit("validation")).otherwise(F.lit("test")))
    chosen = placed.crossJoin(n).select(group, split.alias("split"))  # n is one row
    return df.drop("split").join(chosen, group)
