import json

import pytest
from pyspark.sql import functions as F

from kinewatch.operators import episodes as E
from kinewatch.operators import protocol as PR
from kinewatch.params import DEVELOPMENT, LOCKED, VALIDATION
from kinewatch.sources import readers as RD
from kinewatch.sources import writers as WR


def test_detection_lines(spark, tmp_path):
    ok = {"detection_id": "a", "frame_id": 1, "timestamp_seconds": 0.5, "bbox_xyxy": [1, 2, 3, 4],
          "frame_width": 10, "frame_height": 10, "class_id": 0, "class_name": "x", "confidence": 0.5,
          "source_id": "s", "session_id": "t"}
    lines = [json.dumps(ok), "", "{broken", json.dumps({**ok, "extra": 1})]
    (tmp_path / "d.jsonl").write_text("\n".join(lines))
    good, bad = RD.read_detections(spark, str(tmp_path / "d.jsonl"))
    row = good.collect()
    assert len(row) == 1 and (row[0].x1, row[0].y2) == (1.0, 4.0)
    assert sorted(r.error for r in bad.collect()) == ["not a valid record", "unknown keys: extra"]
    assert all(r.file.endswith("d.jsonl") for r in bad.collect())


def test_coco_splits(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "a.png", "width": 4, "height": 3}],
           "annotations": [{"id": 1, "image_id": 1, "category_id": 0, "bbox": [0, 0, 2, 2], "area": 4.0}],
           "categories": [{"id": 0, "name": " fallen "}]}
    for folder in RD.SPLITS.values():
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "_annotations.coco.json").write_text(json.dumps(doc, indent=1))
    coco = RD.read_coco(spark, str(tmp_path))
    assert coco.images.count() == 3 and coco.annotations.filter("w = 2 and area = 4").count() == 3
    assert {r.name for r in coco.categories.collect()} == {"fallen"}
    WR.write_normalized_coco(coco.images, coco.annotations, coco.categories, str(tmp_path / "out"))
    back = RD.read_normalized_coco(spark, str(tmp_path / "out"), {n: t.schema for n, t in coco._asdict().items()})
    assert back.images.count() == 3
    with pytest.raises(Exception, match="(?i)exist"):
        WR.write_normalized_coco(coco.images, coco.annotations, coco.categories, str(tmp_path / "out"))
    del doc["categories"]
    (tmp_path / "test" / "_annotations.coco.json").write_text(json.dumps(doc))
    with pytest.raises(Exception, match="categories"):
        RD.read_coco(spark, str(tmp_path)).categories.collect()


def test_file_scans_and_manifests(spark, tmp_path):
    for name in ("ADL/SBJ_01_LOC1/a.mp4", "Fall/SBJ_01_LOC1/b.mp4", "other/c.mp4", "ADL/d.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    clips = RD.scan_clip_files(spark, str(tmp_path))
    got = {r.relative_path: r.bytes for r in clips.collect()}
    assert got == {"ADL/SBJ_01_LOC1/a.mp4": 21, "Fall/SBJ_01_LOC1/b.mp4": 22}
    assert RD.scan_image_files(spark, str(tmp_path)).count() == 1
    from kinewatch.plans.manifest import build_clip_manifest

    m = build_clip_manifest(clips, {"p": (1,)}, 1)
    assert m.violations.count() == 0
    WR.write_manifest(m.clips, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out/small_subset_csv")).count() == 2
    (tmp_path / "m.json").write_text(json.dumps({"records": [{"video_id": "v", "subject_id": 3, "label": "adl"}]}))
    assert RD.read_clip_manifest(spark, str(tmp_path / "m.json")).first().subject_id == 3


def test_samples(spark, tmp_path):
    sample = {"sample_id": "1", "source_id": "a", "session_id": "b", "event_id": "c", "text_context": "t",
              "split_group": "g", "image_refs": [{"path": "p", "sha256": "0" * 64, "width": 1, "height": 1, "kind": "full_frame"}],
              "target": {"decision": "fall", "reason": "r", "ground_truth_verified": True}}
    (tmp_path / "s.jsonl").write_text(json.dumps(sample) + "\n\n" + '{"sample_id": 5')
    good, bad = RD.read_semantic_samples(spark, str(tmp_path / "s.jsonl"))
    assert good.first().target.decision == "fall" and bad.count() == 1


def test_reports_round_trip_without_violations(spark, tmp_path):
    sha = "a" * 64
    rows = [{"video_id": f"v{i}", "subject_id": 1, "partition": DEVELOPMENT, "expected_fall": i % 2 == 0,
             "predicted_fall": i % 2 == 0, "predicted_event_count": 1} for i in range(4)]
    metrics = dict(zip(PR.COUNTS, (4, 2, 0, 0, 2))) | {k: 1.0 for k in PR.RATIOS}
    detector = {"confidence_threshold": 0.4, "class_names": {"1": "b", "0": "a"}, "posture_groups": {}}
    parameters = {"detector": detector, "tracking": {"x": 1, "a": 2}, "temporal": {}, "event": {}}
    snapshot = {"detector": {**detector, "mode": "posture_multiclass", "model_variant": "nano", "weights_path": "w"},
                "tracking": {"a": 2, "x": 1}, "temporal": {}, "event": {}, "runtime": {}}
    report = {"validation_kind": PR.REPORT_KIND, "implementation_git_commit": "b" * 40,
              "pipeline_implementation_sha256": sha, "partition": DEVELOPMENT, "model_variant": "nano",
              "weights_sha256": sha, "weights_path": "w", "config_sha256": sha, "manifest_sha256": sha,
              "selected_video_ids": [r["video_id"] for r in rows], "metrics_by_partition": {DEVELOPMENT: metrics},
              "rows": rows, "pipeline_parameters": parameters, "config_snapshot": snapshot,
              "protocol": {"partition_unit": "subject", DEVELOPMENT: [1], VALIDATION: [2], LOCKED: [3]}}
    (tmp_path / "r.json").write_text(json.dumps(report, indent=1))
    t = RD.read_reports(spark, str(tmp_path / "r.json"))
    assert [tuple(r) for r in PR.report_violations(*t, DEVELOPMENT).collect()] == []
    lock, _ = PR.select_candidate(*t, PR.Gate(0.9, 0))
    assert lock.first().confidence_threshold == 0.4


def test_event_log_appends(spark, tmp_path):
    df = spark.createDataFrame([("e", 1, "active")], "event_id string, seq int, status string")
    for i in (1, 2):
        WR.write_events(df.withColumn("seq", F.lit(i)), str(tmp_path / "log"))
    back = spark.read.schema(df.schema).json(str(tmp_path / "log"))
    assert back.count() == 2 and E.latest_event_state(back).first().seq == 2
