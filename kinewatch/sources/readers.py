"""File readers. Record readers return (rows, rejects); a reject keeps its file and raw text."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from kinewatch.operators.protocol import canonical_json
from kinewatch.operators.slices import small
from kinewatch.sources import schemas as S
from kinewatch.sources.json_ranges import RANGE, read_record_lists

# Logical split -> directory of a three-split export.
SPLITS = {"train": "train", "validation": "valid", "test": "test"}


class Coco(NamedTuple):
    images: DataFrame
    annotations: DataFrame
    categories: DataFrame


def _type(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


def _strict_lines(lines: DataFrame, ddl: str) -> tuple[DataFrame, DataFrame]:
    """Parses one JSON record per line; unparsable lines and unknown keys are rejected."""
    fields = [f.name for f in _type(ddl).fields]
    text = F.col("value")
    parsed = lines.filter(F.trim(text) != "").withColumn(
        "_r", F.from_json(text, f"{ddl}, {S.CORRUPT} string",
                          {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": S.CORRUPT}))
    keys = F.json_object_keys(text)
    extra = F.array_except(keys, F.array(*[F.lit(f) for f in fields]))
    error = (F.when(F.col(f"_r.{S.CORRUPT}").isNotNull() | keys.isNull(), F.lit("not a valid record"))
             .when(F.size(extra) > 0, F.concat(F.lit("unknown keys: "), F.array_join(extra, ","))))
    parsed = parsed.withColumn("_error", error)
    good = parsed.filter("_error is null").select(*[F.col(f"_r.{f}").alias(f) for f in fields])
    number = ["number"] if "number" in lines.columns else []
    bad = parsed.filter("_error is not null").select("file", *number, F.col("value").alias("line"),
                                                     F.col("_error").alias("error"))
    return good, bad


def _lines(spark: SparkSession, path: str, stream: bool) -> DataFrame:
    """Lines with their file, and their number (from 1) unless they come from a stream.

    A large file is read as splits. A first pass counts the lines of each split, sums over the splits before
    it give where its own numbering starts; rows of a split are read in order by one task.
    """
    if stream:
        return spark.readStream.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"))
    splits = lines.groupBy("file", "_start").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "_start", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    numbered = lines.join(small(splits), ["file", "_start"])
    return numbered.select("value", "file", (F.col("_id") + F.col("_shift") + 1).alias("number"))


def read_detections(spark: SparkSession, path: str, tracked: bool = False,
                    stream: bool = False) -> tuple[DataFrame, DataFrame]:
    """Detection JSON lines, with the box as four columns."""
    return parse_detections(_lines(spark, path, stream), tracked)


def parse_detections(lines: DataFrame, tracked: bool = False) -> tuple[DataFrame, DataFrame]:
    """The same from a table of (file, value) lines."""
    good, bad = _strict_lines(lines, S.TRACKED if tracked else S.DETECTION)
    box = F.col("bbox_xyxy")
    names = ["x1", "y1", "x2", "y2"]
    out = good.withColumns({n: F.get(box, F.lit(i)) for i, n in enumerate(names)})
    return out.drop("bbox_xyxy"), bad


def read_frames(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return _strict_lines(_lines(spark, path, False), S.FRAME)


def read_coco(spark: SparkSession, root: str, splits: dict[str, str] = SPLITS, size: int = RANGE) -> Coco:
    """Annotation files of all splits; see `read_coco_files`."""
    return read_coco_files(spark, {split: f"{root}/{folder}/_annotations.coco.json" for split, folder in splits.items()}, size)


def read_coco_files(spark: SparkSession, paths: dict[str, str], size: int = RANGE) -> Coco:
    """Annotation documents by split, each read by as many tasks as it has byte ranges of `size`.

    A file without one of the three lists stops with its split's name, as does a record of the wrong shape.
    """
    kinds = {f.name: f.dataType.elementType for f in _type(S.COCO).fields}
    records = read_record_lists(spark, paths, list(kinds), size)

    def each(name: str) -> DataFrame:
        return records[name].select(F.col("name").alias("split"), F.from_json("value", kinds[name], {"mode": "FAILFAST"}).alias("x"))

    images = each("images").select("split", F.col("x.id").alias("image_id"), "x.file_name",
                                   "x.width", "x.height")
    annotations = each("annotations").select(
        "split", F.col("x.id").alias("annotation_id"), "x.image_id", "x.category_id",
        *[F.get(F.col("x.bbox"), F.lit(i)).alias(n) for i, n in enumerate(("x", "y", "w", "h"))],
        "x.area")
    categories = each("categories").select(
        "split", F.col("x.id").alias("category_id"), F.trim("x.name").alias("name"),
        "x.supercategory")
    return Coco(images, annotations, categories)


def read_clip_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest JSON (`records`) or CSV with a header."""
    if path.endswith(".csv"):
        return spark.read.schema(_type(S.CLIP)).csv(path, header=True)
    fields = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in _type(S.CLIP).fields)
    doc = spark.read.schema(f"records array<struct<{fields}>>").option("multiLine", True).json(path)
    return doc.select(F.inline("records"))


def _files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    raw = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
           .option("recursiveFileLookup", True).load(root))
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"  # however many slashes follow a scheme
    relative: Column = F.substring_index(F.col("path"), base, -1)
    # content is dropped right after hashing
    return raw.select("path", relative.alias("relative_path"), F.col("length").alias("bytes"),
                      F.sha2("content", 256).alias("sha256"))


def scan_clip_files(spark: SparkSession, root: str) -> DataFrame:
    """mp4 files under ADL/ and Fall/ with size and digest."""
    return _files(spark, root, "*.mp4").filter(F.col("relative_path").rlike("^(ADL|Fall)/"))


def scan_image_files(spark: SparkSession, root: str, glob: str = "*.{png,jpg,jpeg}") -> DataFrame:
    return _files(spark, root, glob)


def read_semantic_samples(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Strict JSON lines; blank lines are skipped, broken ones come back with file, line number and text."""
    return _strict_lines(_lines(spark, path, False), S.SAMPLE)


def read_reports(spark: SparkSession, path: str, cycle_id: str = "cycle"
                 ) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(headers, rows, selected, protocol) of every report document under the path."""
    raw = spark.read.text(path, wholetext=True).select(
        F.lit(cycle_id).alias("cycle_id"), F.col("_metadata.file_path").alias("report_id"),
        F.col("value").alias("text"))
    r = F.from_json("text", S.REPORT)

    def part(name: str) -> Column:
        return canonical_json(F.get_json_object("text", f"$.{name}"))

    docs = raw.withColumn("r", r).withColumns({
        "pipeline_parameters": part("pipeline_parameters"),
        "config_snapshot": part("config_snapshot"),
        "protocol_json": part("protocol")})
    candidate = F.sha2(F.concat_ws(
        "|", "r.weights_sha256", "r.model_variant", "r.pipeline_implementation_sha256",
        "pipeline_parameters"), 256)
    plain = [c for c in ("validation_kind", "implementation_git_commit",
                         "pipeline_implementation_sha256", "partition", "model_variant",
                         "weights_sha256", "weights_path", "config_sha256", "manifest_sha256")]
    headers = docs.select(
        "cycle_id", "report_id", candidate.alias("candidate_id"), *[f"r.{c}" for c in plain],
        F.sha2("protocol_json", 256).alias("protocol_sha256"),
        F.sha2(canonical_json(F.col("text")), 256).alias("report_sha256"),
        F.map_keys("r.metrics_by_partition").alias("metrics_partitions"),
        F.try_element_at("r.metrics_by_partition", F.col("r.partition")).alias("metrics"),
        "pipeline_parameters", "config_snapshot")
    rows = docs.select("cycle_id", "report_id", F.inline("r.rows"))
    selected = docs.select("cycle_id", "report_id",
                           F.posexplode("r.selected_video_ids").alias("position", "video_id"))
    named = F.from_json("protocol_json", "map<string,string>")
    protocol = docs.select("cycle_id", F.explode(named).alias("partition", "_s")).filter(
        F.col("partition").isin("threshold_development", "threshold_validation", "locked_test"))
    protocol = protocol.select("cycle_id", "partition",
                               F.explode(F.from_json("_s", "array<int>")).alias("subject_id"))
    # reports of one cycle repeat their protocol
    return headers, rows, selected, protocol.distinct()


def read_normalized_coco(spark: SparkSession, path: str, schemas: dict[str, StructType]) -> Coco:
    """Tables that `write_normalized_coco` has published; without its marker there is nothing to read."""
    folder = spark.read.text(f"{path}/published").first()[0]
    return Coco(**{name: spark.read.schema(schemas[name]).json(f"{path}/{folder}/{name}") for name in Coco._fields})
