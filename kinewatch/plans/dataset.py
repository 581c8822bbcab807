"""Dataset plans: normalize, audit, and the gate before training."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinewatch.operators import quality as Q
from kinewatch.operators import samples as S
from kinewatch.operators.manifests import group_leakage
from kinewatch.operators.reporting import manifest_counts


class Audit(NamedTuple):
    violations: DataFrame
    splits: DataFrame
    exact_duplicates: DataFrame
    near_groups: DataFrame
    verdict: DataFrame


class Normalized(NamedTuple):
    images: DataFrame
    annotations: DataFrame
    categories: DataFrame
    mapping: DataFrame
    rejects: DataFrame
    summary: DataFrame


# Posture groups of the audited classes.
SEMANTIC_MAPPING = {"upright": ("standing", "sitting"), "fall": ("fallen",), "lying": ("lying",)}


def audit_violations(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """Every broken structure or label rule as (split, item, rule)."""
    _, bad_images = Q.validate_coco_images(images)
    _, bad_boxes = Q.validate_coco_annotations(annotations, images, categories)
    named = Q.class_set_check(categories).filter(~F.col("as_expected"))
    return (
        bad_images.select("split", F.col("image_id").cast("string").alias("item"),
                          F.explode("_errors").alias("rule"))
        .unionByName(bad_boxes.select("split", F.col("annotation_id").cast("string").alias("item"),
                                      F.explode("_errors").alias("rule")))
        .unionByName(Q.check_category_schema(categories).select(
            "split", F.col("category_id").cast("string").alias("item"),
            F.concat(F.lit("category_"), "rule").alias("rule")))
        .unionByName(named.select("split", F.col("names").alias("item"),
                                  F.lit("unexpected_classes").alias("rule"))))


def audit_dataset(images: DataFrame, annotations: DataFrame, categories: DataFrame,
                  files: DataFrame, distance: int = 4, order: tuple = Q.SPLIT_ORDER,
                  bucket_limit: int = 20_000) -> Audit:
    """files: image_id, split, relative_path, sha256, dhash. Eligible only without any duplicates."""
    exact = Q.cross_split_exact_duplicates(files)
    near = Q.near_duplicate_groups(files, distance, order, bucket_limit)
    counts = (
        files.agg(F.count("*").alias("images_total"))
        .crossJoin(exact.agg(F.countDistinct("sha256").alias("exact_duplicate_contents")))
        .crossJoin(near.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("near_duplicate_pairs"))))
    verdict = counts.withColumn(
        "original_split_evaluation_eligible",
        (F.col("exact_duplicate_contents") == 0) & (F.col("near_duplicate_pairs") == 0))
    return Audit(audit_violations(images, annotations, categories),
                 Q.split_summary(images, annotations, categories), exact, near, verdict)


def posture_profile(mapping: DataFrame) -> DataFrame:
    """Contiguous class ids with name and posture group."""
    rows = mapping.filter(~F.col("dropped"))
    group = F.lit("ambiguous")
    for name, members in SEMANTIC_MAPPING.items():
        group = F.when(F.lower("name").isin(*members), F.lit(name)).otherwise(group)
    return rows.select(F.col("new_category_id").alias("class_id"), "name", group.alias("posture_group"))


def normalize_dataset(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> Normalized:
    """Collapses duplicate names, renumbers classes, clips rounding overflow; originals stay."""
    mapping, ambiguous = Q.category_keepers(annotations, categories)
    clipped, rejects = Q.clip_bbox_rounding(annotations, images)
    renamed = Q.remap_categories(clipped, mapping)
    new_categories = mapping.filter(~F.col("dropped")).select(
        F.col("new_category_id").alias("category_id"), "name", F.lit("none").alias("supercategory"))
    rows = rejects.select("split", F.col("annotation_id").cast("string").alias("item"),
                          F.explode("_errors").alias("rule"))
    unclear = ambiguous.select(F.lit(None).cast("string").alias("split"), F.col("key").alias("item"),
                               F.lit("ambiguous_category").alias("rule"))
    differs = Q.check_category_schema(categories).select(
        "split", F.col("category_id").cast("string").alias("item"),
        F.lit("category_schema_differs").alias("rule"))
    return Normalized(images, renamed, new_categories, mapping,
                      rows.unionByName(unclear).unionByName(differs),
                      Q.bbox_adjustment_summary(clipped))


def training_gate(violations: DataFrame, audited_classes: DataFrame, configured: dict[int, str],
                  audited_files: DataFrame, current_files: DataFrame) -> DataFrame:
    """(rule, detail) rows that keep a dataset from training; empty means it may be used.

    audited_classes: class_id, name. Files the audit never saw are reported but do not block.
    """
    want = audited_classes.sparkSession.createDataFrame(
        [(int(k), v) for k, v in configured.items()], "class_id int, name string")
    have = audited_classes.select(F.col("class_id").cast("int").alias("class_id"), "name")
    n = have.agg(F.count("*").alias("n"), F.min("class_id").alias("lo"), F.max("class_id").alias("hi"),
                 F.countDistinct("class_id").alias("d"))
    none = F.lit(None).cast("string").alias("detail")
    gaps = n.filter((F.col("n") == 0) | (F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1)
                    | (F.col("d") != F.col("n")))
    text = F.concat_ws("=", F.col("class_id").cast("string"), "name").alias("detail")
    drift = Q.manifest_drift(audited_files, current_files).filter("status <> 'unaudited'")
    return (
        violations.groupBy("rule").agg(F.count("*").alias("_n")).select(
            F.concat(F.lit("audit_"), "rule").alias("rule"), F.col("_n").cast("string").alias("detail"))
        .unionByName(gaps.select(F.lit("classes_not_contiguous").alias("rule"), none))
        .unionByName(have.exceptAll(want).select(F.lit("class_not_configured").alias("rule"), text))
        .unionByName(want.exceptAll(have).select(F.lit("class_not_audited").alias("rule"), text))
        .unionByName(drift.select(F.concat(F.lit("file_"), "status").alias("rule"),
                                  F.col("path").alias("detail"))))


def validate_semantic_manifests(samples: DataFrame, max_images: int,
                                files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(violations, counts per split) of labelled samples with a `split` column."""
    _, bad = S.validate_samples(samples)
    images = F.size("image_refs") if "image_refs" in samples.columns else F.col("image_count")
    out = (
        bad.select(F.explode("_errors").alias("rule"), F.col("sample_id").alias("detail"))
        .unionByName(Q.repeated(samples, ["sample_id"]).select(
            F.lit("duplicate_sample_id").alias("rule"), F.col("sample_id").alias("detail")))
        .unionByName(group_leakage(samples, "split_group", "split").select(
            F.lit("group_in_two_splits").alias("rule"), F.col("split_group").alias("detail")))
        .unionByName(samples.filter(images > max_images).select(
            F.lit("too_many_images").alias("rule"), F.col("sample_id").alias("detail"))))
    if files is not None:
        out = out.unionByName(S.missing_image_refs(samples, files).select(
            F.lit("image_missing").alias("rule"),
            F.concat_ws(":", "sample_id", "path").alias("detail")))
    return out, manifest_counts(samples)
