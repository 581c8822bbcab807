"""Large documents in ranges, line numbers in split files, publication of all tables or none."""

import json
import random

import pytest
from pyspark.sql import functions as F

from kinewatch.functions import scalars as FN
from kinewatch.sources import json_ranges as JR
from kinewatch.sources import readers as RD
from kinewatch.sources import writers as WR


def tricky(rng, n):
    words = ['a"b', "\\", '\\"', "[", "}", "{[", "ä€😀", '":[', "x\\\\", "plain"]
    return [{"id": i, "name": "".join(rng.choices(words, k=rng.randint(0, 4))), "more": {"deep": [[1, {"q": rng.choice(words)}]]}} for i in range(n)]


@pytest.mark.parametrize("indent, size", [(None, 7), (None, 64), (2, 50), (1, 1 << 20)])
def test_records_whatever_the_ranges(spark, tmp_path, monkeypatch, indent, size):
    """Strings full of quotes, brackets and backslashes, cut at every place, give the records of a plain parser."""
    monkeypatch.setattr(JR, "MORE", 5)
    rng = random.Random(size)
    docs = {"one": {"info": {"images": [1]}, "images": tricky(rng, 12), "other": [{"id": 9}], "annotations": tricky(rng, 9)},
            "two": {"annotations": [], "nested": {"images": [{"id": 77}]}, "images": tricky(rng, 3)}}
    for name, doc in docs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=rng.random() < 0.5))
    paths = {name: str(tmp_path / f"{name}.json") for name in docs}
    got = JR.read_records(spark, paths, ["images", "annotations"], size).collect()
    for name, doc in docs.items():
        for key in ("images", "annotations"):
            rows = sorted((r["place"], r["value"]) for r in got if (r["name"], r["key"]) == (name, key))
            assert [json.loads(v) for _, v in rows] == doc[key]
    with pytest.raises(ValueError, match="two: 'other'"):
        JR.read_records(spark, paths, ["other"], size)


def test_one_document_is_many_tasks(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"images": [{"id": i, "file_name": "f" * 50} for i in range(2000)]}))
    parts = JR.ranges(spark, {"d": str(tmp_path / "d.json")}, 1 << 14)
    assert parts.rdd.getNumPartitions() == parts.count() > 5
    assert JR.read_records(spark, {"d": str(tmp_path / "d.json")}, ["images"], 1 << 14).count() == 2000


def test_small_ranges_share_tasks_and_tables_read_their_own_lists(spark, tmp_path):
    """More ranges don't mean more tasks, and a list's table holds no record of another list."""
    doc = {"images": [{"id": i, "file_name": "f" * 50} for i in range(500)], "annotations": [{"id": i} for i in range(20)]}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    paths = {"d": str(tmp_path / "d.json")}
    parts = JR.ranges(spark, paths, 64)
    assert parts.count() > 400 and parts.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert JR._tasks(spark, [JR.RANGE] * 100, 1 << 18) == 100
    tables = JR.read_record_lists(spark, paths, ["images", "annotations"], 64)
    for key, table in tables.items():
        assert [json.loads(r["value"]) for r in table.orderBy("place").collect()] == doc[key]


def test_line_numbers_in_a_file_of_many_splits(spark, tmp_path):
    """The number of a bad line is the one a plain loop finds, though the file is read in pieces."""
    rng, lines = random.Random(2), []
    for i in range(3000):
        lines.append(rng.choice(["", "{broken %d" % i, json.dumps({"sample_id": str(i)})]))
    (tmp_path / "s.jsonl").write_text("\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        good, bad = RD.read_semantic_samples(spark, str(tmp_path))
        got = sorted((r["number"], r["line"]) for r in bad.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(i + 1, x) for i, x in enumerate(lines) if x.startswith("{broken")]
    assert good.count() == sum(x.startswith('{"') for x in lines)


def coco_of(spark, n):
    images = spark.range(n).select(F.col("id").alias("image_id"), F.lit("train").alias("split"))
    return images, images.withColumnRenamed("image_id", "annotation_id"), spark.createDataFrame([(1, "x", "train")], "category_id long, name string, split string")


def test_all_tables_or_none(spark, tmp_path):
    images, annotations, categories = coco_of(spark, 20)
    schemas = {"images": images.schema, "annotations": annotations.schema, "categories": categories.schema}
    broken = annotations.withColumn("x", F.when(F.col("annotation_id") == 7, F.raise_error(F.lit("no"))).otherwise(F.lit("1")))
    at = str(tmp_path / "out")
    with pytest.raises(Exception, match="no"):
        WR.write_normalized_coco(images, broken, categories, at)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        RD.read_normalized_coco(spark, at, schemas)  # the first table was written, and can't be read
    WR.write_normalized_coco(images, annotations, categories, at)
    back = RD.read_normalized_coco(spark, at, schemas)
    assert (back.images.count(), back.annotations.count(), back.categories.count()) == (20, 20, 1)
    with pytest.raises(FileExistsError):
        WR.write_normalized_coco(images, annotations, categories, at)


def test_manifest_bytes_do_not_depend_on_partitions(spark, tmp_path):
    clips = spark.range(500).select(F.format_string("v%04d", F.col("id") * 37 % 500).alias("video_id"), (F.col("id") % 3 == 0).alias("small_validation_subset"))
    whole = []
    for i, df in enumerate((clips.repartition(7), clips.repartition(2, "video_id"))):
        WR.write_manifest(df, str(tmp_path / str(i)))
        text = [b"".join(p.read_bytes() for p in sorted((tmp_path / str(i) / t).glob("part-*"))) for t in ("manifest_json", "manifest_csv", "small_subset_csv")]
        whole.append(text)
        assert [r["position"] for r in WR.ordered_lines(spark, str(tmp_path / str(i) / "manifest_csv")).orderBy("value").collect()] == list(range(500))
    assert whole[0] == whole[1]
    with pytest.raises(Exception, match="(?i)exist"):
        WR.write_manifest(clips, str(tmp_path / "0"))


def test_canonical_text_is_the_sorted_one(spark):
    import hashlib

    values = [{"b": [1, {"z": None, "a": "ü\n"}], "a": 1.50}, [], "x", 1e30, {"é": {"2": 1, "10": True}}, None, -0.0, 12345678901234567890]
    texts = [json.dumps(v, indent=1) for v in values] + ["{broken", None]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(FN.canonical_text_sha256(F.col("t"))).collect()]
    want = [hashlib.sha256(json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest() for v in values]
    assert got == [*want, None, None]


def test_the_clips_of_a_manifest_are_worked_out_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    clips = spark.range(40).selectExpr("concat('v', id) as video_id", "id % 2 = 0 as small_validation_subset")
    WR.write_manifest(clips.mapInPandas(count, clips.schema), str(tmp_path / "out"))
    assert seen.value == 40
    assert spark.read.csv(str(tmp_path / "out/small_subset_csv")).count() == 20
