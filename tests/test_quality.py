import random

import pytest
from pyspark.sql import functions as F

from kinewatch.functions import scalars as FN
from kinewatch.operators import quality as Q
from kinewatch.plans import dataset as D


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def files_of(spark, seed, n=160):
    """Clustered hashes: many exact copies of one hash, near copies, and shared bit ranges."""
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(6)]
    rows = []
    for i in range(n):
        h = base[0] if rng.random() < 0.3 else rng.choice(base)
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            h ^= 1 << rng.randrange(64)
        if rng.random() < 0.1:
            h &= (1 << 40) - 1
        rows.append((i, rng.choice(Q.SPLIT_ORDER), signed(h), f"c{h}" if rng.random() < 0.6 else f"i{i}"))
    return rows, spark.createDataFrame(rows, "image_id long, split string, dhash long, sha256 string")


@pytest.mark.parametrize("limit, distance", [(20_000, 4), (6, 4), (2, 2), (2, 0)])
def test_near_duplicates_equal_all_pairs(spark, limit, distance):
    rows, files = files_of(spark, distance)
    rank = {s: i for i, s in enumerate(Q.SPLIT_ORDER)}
    want = sorted((rank[a[1]], rank[b[1]], a[0], b[0], bin((a[2] ^ b[2]) & (1 << 64) - 1).count("1"))
                  for a in rows for b in rows
                  if rank[a[1]] < rank[b[1]] and a[3] != b[3]
                  and bin((a[2] ^ b[2]) & (1 << 64) - 1).count("1") <= distance)
    groups = Q.near_duplicate_groups(files, distance, bucket_limit=limit).cache()
    assert groups.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0] == len(want)
    keys = ["first_split", "second_split", "first_hash", "second_hash"]
    assert groups.count() == groups.select(*keys).distinct().count()
    shown = Q.near_duplicate_examples(files, groups, 25).collect()
    got = [(rank[r.first_split], rank[r.second_split], r.first_id, r.second_id, r.distance) for r in shown]
    assert sorted(got) == want[:25]


def test_difference_hash_bits(spark):
    up = list(range(72))
    down = up[::-1]
    df = spark.createDataFrame([(1, [float(x) for x in up]), (2, [float(x) for x in down]),
                                (3, [1.0] + [0.0] * 71)], "id int, px array<double>")
    got = {r.id: r.h for r in df.select("id", FN.hash_hex(FN.difference_hash(F.col("px"))).alias("h")).collect()}
    assert got == {1: "0" * 16, 2: "f" * 16, 3: "8" + "0" * 15}


IMG = "split string, image_id long, file_name string, width int, height int, actual_width int, actual_height int"
ANN = "split string, annotation_id long, image_id long, category_id long, x double, y double, w double, h double, area double"
CAT = "split string, category_id long, name string"


def test_structure_rules(spark):
    images = spark.createDataFrame([
        ("train", 1, "a.png", 32, 24, 32, 24), ("train", 2, "../b.png", 32, 24, 32, 24),
        ("train", 3, "sub/../c.png", 32, 24, 31, 24), ("train", 4, "d.png", 0, 24, 0, 24),
        ("train", 5, "e.png", 9, 9, 9, 9), ("train", 5, "f.png", 9, 9, 9, 9), ("test", 1, "a.png", 32, 24, 32, 24)], IMG)
    bad = {r.image_id: set(r._errors) for r in Q.validate_coco_images(images)[1].collect()}
    assert bad == {2: {"path_escapes_split"}, 3: {"size_disagrees"}, 4: {"bad_size"}, 5: {"duplicate_image_id"}}
    cats = spark.createDataFrame([("train", 0, "fallen"), ("test", 0, "fallen")], CAT)
    nan = float("nan")
    ann = spark.createDataFrame([
        ("train", 1, 1, 0, 1.0, 1.0, 31.0 + 5e-7, 5.0, None), ("train", 2, 1, 0, 1.0, 1.0, 31.1, 5.0, None),
        ("train", 3, 99, 0, 1.0, 1.0, 3.0, 5.0, None), ("train", 4, 1, 7, 1.0, 1.0, 3.0, 5.0, None),
        ("train", 5, 1, 0, nan, 1.0, 3.0, 5.0, None), ("train", 6, 1, 0, -1.0, 1.0, 3.0, 5.0, None)], ANN)
    good, bad = Q.validate_coco_annotations(ann, images.filter("image_id = 1"), cats)
    assert [r.annotation_id for r in good.collect()] == [1]
    by = {r.annotation_id: set(r._errors) for r in bad.collect()}
    assert by[2] == {"box_outside_image"} and by[3] == {"unknown_image"} and by[4] == {"unknown_category"}
    assert "bad_box" in by[5] and by[6] == {"box_outside_image"}
    splits = spark.createDataFrame([("train",), ("test",)], "split string")
    assert [r.split for r in Q.empty_splits(images, ann, splits).collect()] == ["test"]


def test_box_clip_of_a_hundredth_pixel(spark):
    images = spark.createDataFrame([("train", 1, "a", 32, 24, 32, 24)], IMG)
    ann = spark.createDataFrame([("train", 1, 1, 1, 1.0, 1.0, 31.01, 23.0, 1.0), ("train", 2, 1, 1, 1.0, 1.0, 31.2, 23.0, 1.0),
                                 ("train", 3, 1, 1, 1.0, 1.0, 0.0, 2.0, 1.0), ("train", 4, 1, 1, 1.0, 1.0, 2.0, 2.0, 7.0)], ANN)
    good, bad = Q.clip_bbox_rounding(ann, images)
    g = {r.annotation_id: r for r in good.collect()}
    assert (g[1].x, g[1].y, g[1].w, g[1].h, g[1].area) == (1.0, 1.0, 31.0, 23.0, 713.0)
    assert g[1].clip_pixels == pytest.approx(0.01) and g[4].area == 7.0
    assert {r.annotation_id: r._errors[0] for r in bad.collect()} == {2: "clip_too_large", 3: "non_positive_box"}


def test_duplicate_category_names_collapse_or_are_ambiguous(spark):
    rows = [(s, i, n) for s in ("train", "test") for i, n in
            ((0, "Fallen"), (1, "fallen"), (2, "lying"), (3, "sitting"), (4, "standing"))]
    cats = spark.createDataFrame(rows, CAT)
    ann = spark.createDataFrame([("train", 1, 1, 1, 0.0, 0.0, 1.0, 1.0, None), ("test", 2, 1, 4, 0.0, 0.0, 1.0, 1.0, None)], ANN)
    mapping, unclear = Q.category_keepers(ann, cats)
    got = {r.category_id: (r.keeper_id, r.new_category_id, r.dropped) for r in mapping.collect()}
    assert got == {0: (1, 0, True), 1: (1, 0, False), 2: (2, 1, False), 3: (3, 2, False), 4: (4, 3, False)}
    assert unclear.count() == 0
    both = ann.unionByName(spark.createDataFrame([("train", 3, 1, 0, 0.0, 0.0, 1.0, 1.0, None)], ANN))
    assert [r.key for r in Q.category_keepers(both, cats)[1].collect()] == ["fallen"]
    profile = {r.name: r.posture_group for r in D.posture_profile(mapping).collect()}
    assert profile == {"fallen": "fall", "lying": "lying", "sitting": "upright", "standing": "upright"}
    assert all(r.as_expected for r in Q.class_set_check(cats).collect())
    assert Q.check_category_schema(cats).count() == 0


def test_file_drift_and_gate(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256 string")
    new = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4")], "path string, sha256 string")
    assert {r.path: r.status for r in Q.manifest_drift(old, new).collect()} == {
        "b": "changed", "c": "missing", "d": "unaudited"}
    none = spark.createDataFrame([], "split string, item string, rule string")
    classes = spark.createDataFrame([(0, "x"), (2, "y")], "class_id int, name string")
    rules = {r.rule for r in D.training_gate(none, classes, {0: "x", 1: "y"}, old, new).collect()}
    assert rules == {"classes_not_contiguous", "class_not_configured", "class_not_audited",
                     "file_changed", "file_missing"}
    fine = spark.createDataFrame([(0, "x"), (1, "y")], "class_id int, name string")
    assert D.training_gate(none, fine, {0: "x", 1: "y"}, old, old).count() == 0


@pytest.mark.parametrize("levels, limit", [(1, 6), (1, 1000), (2, 4)])
def test_a_bucket_that_no_band_splits_is_dealt_into_blocks(spark, monkeypatch, levels, limit):
    """All hashes share most bits, so the last level keeps large buckets: blocks of them give every pair once."""
    rng = random.Random(levels * 100 + limit)
    monkeypatch.setattr(Q, "LEVELS", levels)
    hashes = sorted({(1 << 62) | sum(1 << rng.randrange(20) for _ in range(3)) for _ in range(90)})
    got = Q.near_duplicate_hashes(spark.createDataFrame([(h,) for h in hashes], "dhash long"), 2, limit)
    want = sorted((a, b, (a ^ b).bit_count()) for i, a in enumerate(hashes) for b in hashes[i:] if (a ^ b).bit_count() <= 2)
    assert sorted((r["a_hash"], r["b_hash"], r["distance"]) for r in got.collect()) == want


def test_blocks_bound_what_a_group_compares(spark):


    keyed = spark.range(20_000).select(F.col("id").alias("dhash"), F.lit(0).alias("_node"), F.array(F.lit(1).cast("long")).alias("_key"))
    sizes = keyed.groupBy("_node", "_key").agg(F.count("*").alias("_n"))
    blocks = Q._in_blocks(keyed, sizes, 1000).groupBy("_own").count().collect()
    assert len(blocks) == 40 and max(r["count"] for r in blocks) <= 1000
