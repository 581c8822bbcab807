"""Clip manifest from a file listing."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinewatch.operators import manifests as MF


class Manifest(NamedTuple):
    clips: DataFrame
    excluded: DataFrame
    auxiliary: DataFrame
    violations: DataFrame
    audit: DataFrame


def build_clip_manifest(files: DataFrame, subjects: dict[str, tuple[int, ...]] = MF.SUBJECTS,
                        n: int = 3, require_full_groups: bool = True,
                        layout: str = "component") -> Manifest:
    """Parses paths, assigns partitions, drops copies, flags the small subset and reports problems."""
    parse = {"component": MF.parse_clip_path, "folder": MF.parse_subject_folder}[layout]
    clips, auxiliary = parse(files)
    clips = clips.withColumn("partition", MF.partition_of(F.col("subject_id"), subjects))
    expected = tuple(s for members in subjects.values() for s in members)
    kept, excluded, conflicts = MF.dedupe_clips(clips)
    marked, short = MF.first_n_per_group(kept, n)
    if "frames" in files.columns and "fps" in files.columns:
        marked = marked.withColumn("duration_seconds", F.try_divide(F.col("frames"), F.col("fps")))
    subject = F.col("subject_id").cast("string")
    problems = [
        MF.subject_inventory(clips, expected).select(
            F.concat(F.lit("subject_"), "status").alias("rule"), subject.alias("detail")),
        conflicts.select(F.lit("content_in_two_groups").alias("rule"), F.col("sha256").alias("detail")),
        MF.group_leakage(kept, "subject_id", "partition").select(
            F.lit("subject_in_two_partitions").alias("rule"), subject.alias("detail")),
    ]
    if require_full_groups:
        problems.append(short.select(F.lit("group_too_small").alias("rule"),
                                     F.concat_ws("/", subject, "label").alias("detail")))
    violations = problems[0]
    for p in problems[1:]:
        violations = violations.unionByName(p)
    return Manifest(marked, excluded, auxiliary, violations, MF.manifest_audit(kept))
