"""Clip manifests: paths to records, duplicates, subsets, subjects and partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinewatch.functions.scalars import portable_path
from kinewatch.params import DEVELOPMENT, LOCKED, VALIDATION

# Subjects of each partition, in ascending order.
SUBJECTS = {
    DEVELOPMENT: (1, 2, 3, 4, 5, 6, 7, 11, 12, 15, 16, 17, 19, 23, 24, 25, 26),
    VALIDATION: (8, 9, 10, 18, 21, 27, 28),
    LOCKED: (13, 14, 20, 22, 29),
}


def partition_of(subject: Column, subjects: dict[str, tuple[int, ...]] = SUBJECTS) -> Column:
    """Partition name of a subject, null for a subject no partition names."""
    pairs = [F.lit(x) for name, members in subjects.items() for m in members for x in (m, name)]
    return F.try_element_at(F.create_map(*pairs), subject.cast("int"))


def parse_clip_path(files: DataFrame, prefix: str = "fall29/") -> tuple[DataFrame, DataFrame]:
    """(clips, auxiliary). A whole path component SBJ_<n>_LOC<n> names subject and place."""
    path = portable_path(F.col("relative_path"))
    pattern = r"(?:^|/)SBJ_(\d+)_LOC(\d+)(?:/|$)"
    rows = files.withColumn("relative_path", path).withColumns({
        "subject_id": F.regexp_extract(path, pattern, 1).try_cast("int"),
        "location_id": F.regexp_extract(path, pattern, 2).try_cast("int"),
        "label": F.lower(F.substring_index(path, "/", 1)),
        "video_id": F.concat(F.lit(prefix), F.regexp_replace(path, r"\.[^./]+$", "")),
    })
    clips = rows.filter(F.col("subject_id").isNotNull())
    return clips, rows.filter(F.col("subject_id").isNull()).select("relative_path")


def parse_subject_folder(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clips, auxiliary) of the layout `Subject N/ADL|Fall/<clip>.mp4`."""
    path = portable_path(F.col("relative_path"))
    pattern = r"^Subject (\d+)/(ADL|Fall)/([^/]+)\.mp4$"
    number = F.nullif(F.regexp_extract(path, pattern, 1), F.lit(""))
    label = F.lower(F.regexp_extract(path, pattern, 2))
    rows = files.withColumn("relative_path", path).withColumns({
        "subject_id": number.try_cast("int"), "label": label,
        "video_id": F.concat(F.lit("subject-"), number, F.lit("/"), label, F.lit("/"),
                             F.regexp_extract(path, pattern, 3))})
    return (rows.filter(F.col("subject_id").isNotNull()),
            rows.filter(F.col("subject_id").isNull()).select("relative_path"))


def dedupe_clips(clips: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, excluded, conflicts): the lowest path per content stays.

    Content found under different subject, label or partition is a conflict. The kept row is an
    aggregate, so a content with very many copies combines before the shuffle.
    """
    who = F.struct("subject_id", "label", "partition")
    best = clips.groupBy("sha256").agg(
        F.min_by(F.struct(*clips.columns), "relative_path").alias("row"),
        F.min("relative_path").alias("kept"), F.min(who).alias("_lo"), F.max(who).alias("_hi"))
    excluded = clips.select("sha256", F.col("relative_path").alias("excluded")).join(
        best.select("sha256", "kept"), "sha256").filter("excluded <> kept")
    conflicts = best.filter(F.col("_lo") != F.col("_hi")).select("sha256")
    return best.select("row.*"), excluded, conflicts


def first_n_per_group(clips: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(clips with small_validation_subset, groups smaller than n) by subject and label.

    Only each group's n-th lowest path is looked up; row_number <= n is cut before the shuffle.
    """
    group = ["subject_id", "label"]
    w = Window.partitionBy(*group).orderBy("relative_path")
    top = clips.select(*group, "relative_path").withColumn("_r", F.row_number().over(w)).filter(
        F.col("_r") <= n).groupBy(*group).agg(F.max("relative_path").alias("_last"),
                                             F.count("*").alias("clips"))
    marked = clips.join(top, group).withColumn(
        "small_validation_subset", F.col("relative_path") <= F.col("_last")).drop("_last", "clips")
    return marked, top.filter(F.col("clips") < n).select(*group, "clips")


def subject_inventory(clips: DataFrame, expected: tuple[int, ...]) -> DataFrame:
    """Expected subjects without clips and observed subjects nobody expected."""
    spark = clips.sparkSession
    want = spark.range(1).select(F.explode(F.array(*[F.lit(e).cast("int") for e in expected]))
                                 .alias("subject_id"))
    have = clips.select(F.col("subject_id").cast("int")).distinct()
    return (want.subtract(have).withColumn("status", F.lit("missing"))
            .unionByName(have.subtract(want).withColumn("status", F.lit("extra"))))


def group_leakage(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that occur in more than one split; distinct pairs are formed before grouping."""
    pairs = df.select(group, split).distinct()
    return pairs.groupBy(group).agg(
        F.array_join(F.array_sort(F.collect_list(split)), ",").alias("splits"),
        F.count("*").alias("_n")).filter("_n > 1").drop("_n")


def manifest_audit(clips: DataFrame) -> DataFrame:
    """Counts by label, by partition, by subject and overall in one pass, as (kind, value, clips)."""
    sets = clips.groupingSets(
        [["label"], ["partition"], ["subject_id", "label"], []], "label", "partition", "subject_id")
    g = sets.agg(F.count("*").alias("clips"), F.grouping_id().alias("g"))
    kind = (F.when(F.col("g") == 3, F.lit("label")).when(F.col("g") == 5, F.lit("partition"))
            .when(F.col("g") == 2, F.lit("subject_label")).otherwise(F.lit("all")))
    value = F.concat_ws("/", F.col("subject_id").cast("string"), F.col("label"), F.col("partition"))
    return g.select(kind.alias("kind"), value.alias("value"), "clips")


def subject_labels(clips: DataFrame) -> DataFrame:
    """Labels available for each subject."""
    return clips.select("subject_id", "label").distinct().groupBy("subject_id").agg(
        F.array_join(F.array_sort(F.collect_list("label")), ",").alias("labels"))


def duplicate_hashes(clips: DataFrame) -> DataFrame:
    return clips.groupBy("sha256").agg(F.count("*").alias("copies")).filter("copies > 1")


def declared_counts_check(clips: DataFrame, declared: DataFrame) -> DataFrame:
    """Declared against real clip counts per partition and label; only differences are returned."""
    key = ["partition", "label"]
    real = clips.groupBy(*key).agg(F.count("*").alias("clips"))
    both = declared.select(*key, F.col("clips").alias("declared")).join(real, key, "full").select(
        *key, F.coalesce("declared", F.lit(0)).alias("declared"),
        F.coalesce("clips", F.lit(0)).alias("clips"))
    return both.filter("declared <> clips")


def select_clips(clips: DataFrame, partition: str, small_only: bool = False) -> DataFrame:
    out = clips.filter(F.col("partition") == partition)
    return out.filter("small_validation_subset") if small_only else out
