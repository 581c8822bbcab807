"""Manifests, samples, reporting, review, alerts and scalar helpers."""

import pytest
from pyspark.sql import functions as F

from kinewatch.functions import scalars as FN
from kinewatch.operators import geometry as G
from kinewatch.operators import manifests as MF
from kinewatch.operators import reporting as R
from kinewatch.operators import review as RV
from kinewatch.operators import samples as S
from kinewatch.params import AlertPolicy, ReviewPolicy
from kinewatch.plans import dataset as D
from kinewatch.plans import manifest as MN


def test_manifest_of_all_subjects(spark):
    """84 records from 85 source clips: one copy and one auxiliary file are left out."""
    rows = []
    for s in range(1, 22):
        for label in ("ADL", "Fall"):
            for i in (1, 2):
                rows.append((f"{label}/SBJ_{s:02d}_LOC1/ACT1/clip{i}.mp4", f"{s}{label}{i}"))
    rows += [("Fall/SBJ_01_LOC1/ACT9/zz.mp4", "1Fall1"), ("ADL/other.mp4", "aux")]
    files = spark.createDataFrame(rows, "relative_path string, sha256 string")
    subjects = {"p": tuple(range(1, 13)), "q": tuple(range(13, 18)), "r": tuple(range(18, 22))}
    m = MN.build_clip_manifest(files, subjects, 2)
    assert m.clips.count() == 84 and m.violations.count() == 0
    assert {r.partition: r["count"] for r in m.clips.groupBy("partition").count().collect()} == {
        "p": 48, "q": 20, "r": 16}
    assert [(r.kept, r.excluded) for r in m.excluded.collect()] == [
        ("Fall/SBJ_01_LOC1/ACT1/clip1.mp4", "Fall/SBJ_01_LOC1/ACT9/zz.mp4")]
    assert [r.relative_path for r in m.auxiliary.collect()] == ["ADL/other.mp4"]
    assert m.clips.filter("video_id = 'fall29/ADL/SBJ_03_LOC1/ACT1/clip2'").count() == 1
    audit = {(r.kind, r.value): r.clips for r in m.audit.collect()}
    assert audit[("label", "adl")] == 42 and audit[("all", "")] == 84 and audit[("subject_label", "5/fall")] == 2


def test_manifest_problems(spark):
    rows = [("Fall/SBJ_01_LOC1/a.mp4", "h"), ("ADL/SBJ_01_LOC1/b.mp4", "h"), ("ADL/SBJ_09_LOC1/c.mp4", "k"),
            ("ADL\\SBJ_02_LOC3\\d.mp4", "m"), ("ADL/xSBJ_02_LOC3/e.mp4", "n")]
    files = spark.createDataFrame(rows, "relative_path string, sha256 string")
    m = MN.build_clip_manifest(files, {"p": (1, 2, 3)}, 2)
    got = {(r.rule, r.detail) for r in m.violations.collect()}
    assert {("subject_missing", "3"), ("subject_extra", "9"), ("content_in_two_groups", "h"),
            ("group_too_small", "2/adl")} <= got
    assert [r.relative_path for r in m.auxiliary.collect()] == ["ADL/xSBJ_02_LOC3/e.mp4"]
    relaxed = MN.build_clip_manifest(files, {"p": (1, 2, 3)}, 2, require_full_groups=False)
    assert relaxed.violations.filter("rule = 'group_too_small'").count() == 0


def test_folder_layout(spark):
    files = spark.createDataFrame([("Subject 3/ADL/01.mp4",), ("Subject 3/Other/02.mp4",)], "relative_path string")
    clips, aux = MF.parse_subject_folder(files)
    assert [(r.subject_id, r.label, r.video_id) for r in clips.collect()] == [(3, "adl", "subject-3/adl/01")]
    assert aux.count() == 1


def test_small_groups_and_first_n(spark):
    clips = spark.createDataFrame([(1, "fall", f"p{i}") for i in range(5)] + [(2, "adl", "q")],
                                  "subject_id int, label string, relative_path string")
    marked, short = MF.first_n_per_group(clips, 3)
    assert sorted(r.relative_path for r in marked.filter("small_validation_subset").collect()) == [
        "p0", "p1", "p2", "q"]
    assert [(r.subject_id, r.clips) for r in short.collect()] == [(2, 1)]


def test_group_split_sizes_and_isolation(spark):
    df = spark.range(1000).select((F.col("id") % 37).alias("g"), F.col("id").alias("x"))
    out = S.split_by_group(df, "g", (0.7, 0.15, 0.15), 7).cache()
    assert out.count() == 1000
    n = {r.split: r.n for r in out.groupBy("split").agg(F.countDistinct("g").alias("n")).collect()}
    assert n == {"train": 26, "validation": 6, "test": 5}  # 37 * 0.7 = 25.9, 37 * 0.15 = 5.55
    assert MF.group_leakage(out, "g", "split").count() == 0
    other = S.split_by_group(df, "g", seed=8).filter("split = 'test'").select("g").distinct()
    assert other.subtract(out.filter("split = 'test'").select("g")).count() > 0
    with pytest.raises(ValueError):
        S.split_by_group(df, "g", (0.5, 0.1, 0.1))


def test_semantic_manifest_rules(spark):
    rows = [("a", "g1", "train", "t", 1, True), ("a", "g2", "test", "t", 1, True), ("b", "g1", "test", "", 9, False)]
    df = spark.createDataFrame(rows, "sample_id string, split_group string, split string, text_context string, "
                                     "image_count int, ground_truth_verified boolean")
    bad, counts = D.validate_semantic_manifests(df, 3)
    assert {(r.rule, r.detail) for r in bad.collect()} == {
        ("duplicate_sample_id", "a"), ("group_in_two_splits", "g1"), ("too_many_images", "b"),
        ("no_text", "b"), ("target_not_verified", "b")}
    assert {r.split: r.records for r in counts.collect()} == {"train": 1, "test": 2}


@pytest.mark.parametrize("limit", [1000, 3])
def test_percentiles(spark, limit):
    df = spark.createDataFrame([("s", float(v)) for v in (1, 2, 4, 9)] + [("one", 5.0)] * 3, "stage string, latency_ms double")
    got = {r.stage: r for r in R.stage_latency_summary(df, limit).collect()}
    assert got["s"].p50_ms == 3.0 and got["s"].p95_ms == pytest.approx(8.25) and got["one"].p95_ms == 5.0
    near = {r.stage: r for r in R.nearest_rank_latency(df, limit).collect()}
    assert near["s"].p95_ms == 9.0 and near["s"].median_ms == 3.0 and near["s"].minimum_ms == 1.0
    assert R.negative_latencies(df).count() == 0


def test_percentile_over_many_values_in_several_partitions(spark):
    df = spark.range(20_000).select(F.lit("s").alias("stage"), F.hash("id").cast("double").alias("latency_ms"))
    a = R.stage_latency_summary(df).first()
    b = R.stage_latency_summary(df, 100).first()
    want = df.agg(F.percentile("latency_ms", F.array(F.lit(0.5), F.lit(0.95)))).first()[0]
    assert [a.p50_ms, a.p95_ms] == pytest.approx(want) and [b.p50_ms, b.p95_ms] == pytest.approx(want)


@pytest.mark.parametrize("limit", [1000, 3])
def test_latencies_are_read_once(spark, limit):
    """The rows behind the latencies may be a whole cascade, so each runs through one time only."""
    seen = spark.sparkContext.accumulator(0)

    def passing(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    rows = [("s", float(v)) for v in (1, 2, 4, 9)] + [("one", 5.0)] * 3 + [("one", None)]
    for summary in (R.stage_latency_summary, R.nearest_rank_latency):
        seen.value = 0
        df = spark.createDataFrame(rows, "stage string, latency_ms double").mapInPandas(passing, "stage string, latency_ms double")
        got = {r.stage: r for r in summary(df, limit).collect()}
        assert seen.value == len(rows)
        assert got["s"].mean_ms == 4.0 and got["one"]["count"] == 4 and got["one"].mean_ms == 5.0


def test_throughput_and_fingerprint(spark):
    df = spark.createDataFrame([("detection", 20.0), ("tracking", 0.0), ("review", 1.0)], "stage string, latency_ms double")
    assert [(r.stage, r.per_second) for r in R.stage_throughput(df).collect()] == [("detection", 50.0)]
    files = spark.range(300).select(F.concat(F.lit("p"), "id").alias("path"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"))
    one = R.content_fingerprint(files).first()[0]
    assert one == R.content_fingerprint(files.orderBy(F.rand(1)).repartition(5)).first()[0]
    assert one != R.content_fingerprint(files.filter("path <> 'p7'")).first()[0]


def test_provider_chain(spark):
    rows = [(1, "a", False, "d", "a: x", False), (1, "b", True, "fall", "", False),
            (2, "a", False, "d", "a: x", False), (2, "b", False, "d", "b: y", False),
            (3, "a", False, "d", "a: no consent", True), (3, "b", True, "fall", "", False),
            (4, "b", True, "fall", "", False), (4, "mock", True, "fall", "", False), (5, "mock", True, "fall", "", False)]
    df = spark.createDataFrame(rows, "event_id int, provider string, ok boolean, decision string, error string, blocked boolean")

    def go(policy):
        return {r.event_id: (r.provider, r.fallback_reason, r.failure) for r in RV.resolve_assessments(df, policy).collect()}

    got = go(ReviewPolicy(("a", "b", "mock"), allow_fallback=True))
    assert got[1] == ("b", "a: x", None) and got[2] == (None, None, "a: x")
    assert got[3] == (None, None, "a: no consent")
    assert got[4] == ("b", "provider not registered: a", None)
    assert got[5] == (None, None, "provider not registered: a")
    assert go(ReviewPolicy(("mock",), True))[5] == (None, None, "mock provider is disabled")
    assert go(ReviewPolicy(("mock",), True, True))[5] == ("mock", None, None)
    assert go(ReviewPolicy(("a", "b"), False))[1] == (None, None, "a: x")


def test_images_need_both_consents(spark):
    req = spark.createDataFrame([(1, ["x"] * 5, True), (2, ["x"], False), (3, [], False)],
                                "event_id int, image_refs array<string>, cloud_image_consent boolean")
    cloud = [RV.Provider("cloud", True, True, 4)]
    ok, no = RV.gate_review_requests(req, cloud, ReviewPolicy(allow_cloud_images=True, max_images=3))
    assert {r.event_id: len(r.image_refs) for r in ok.collect()} == {1: 3, 3: 0}
    assert [r.event_id for r in no.collect()] == [2]
    assert RV.gate_review_requests(req, cloud, ReviewPolicy())[1].count() == 2
    text = RV.gate_review_requests(req, [RV.Provider("t", False, False, 0)], ReviewPolicy())[0]
    assert all(r.image_refs == [] for r in text.collect())


def test_payload_types(spark):
    cases = {
        '{"decision":"fall","reason":"x"}': True, '{"decision":"fall","reason":"x","risk_level":null}': False,
        '{"decision":"fall","reason":"x","confidence":"high"}': False, 'no json': False, '[]': False,
        '{"decision":"fall","reason":"x","attempt_to_stand":"yes"}': False,
        '{"decision":"not_fall","reason":"x","confidence":null,"attempt_to_stand":false}': True,
        '{"reason":"x"}': False, '{"decision":"fall","reason":"x","b":1}': False}
    df = spark.createDataFrame([(k,) for k in cases], "answer string")
    got = {r.answer: r.schema_valid for r in RV.validate_payload(df, "answer").collect()}
    assert got == cases
    row = RV.validate_payload(df, "answer").filter("answer like '%\"reason\":\"x\"}' and schema_valid").first()
    assert row.payload.risk_level == "unknown"


def test_unexpected_provider_errors_propagate(spark):
    def factory():
        def review(request):
            raise RuntimeError("boom")
        return review

    req = spark.createDataFrame([("1",)], "event_id string")
    with pytest.raises(Exception, match="boom"):
        RV.review_with(req, "p", factory).collect()


def test_model_recommendation_never_decides(spark):
    ev = spark.createDataFrame([("1", "lying"), ("2", "upright")], "event_id string, temporal_state string")
    a = spark.createDataFrame([("2", "not_fall", True, True, True)],
                              "event_id string, decision string, provider_success boolean, schema_valid boolean, model_recommends_alert boolean")
    got = {r.event_id: r for r in RV.decide_alerts(ev, a, AlertPolicy(high_temporal_risk_can_alert=True)).collect()}
    assert got["1"].should_alert and len(got["1"].reasons) == 2
    assert not got["2"].should_alert and got["2"].reasons[-1].endswith("evidence=true")
    assert not RV.decide_alerts(ev, a, AlertPolicy()).filter("event_id = '1'").first().should_alert


def test_redaction_and_small_helpers(spark):
    text = "Authorization: Bearer abc, API-key = k1; data:image/png;base64,AAA= sk-abcdefghijklmn token:zz"
    df = spark.createDataFrame([(text, " a  b ", "A\\b", 2.5, 3.5)], "t string, p string, w string, x double, y double")
    r = df.select(FN.redact_text(F.col("t")).alias("t"), FN.session_id(F.col("p"), F.lit(1)).alias("s"),
                  FN.session_id(F.lit("  "), F.lit(1)).alias("e"), FN.portable_path(F.col("w")).alias("w"),
                  FN.half_even(F.col("x")).alias("x"), FN.half_even(F.col("y")).alias("y"),
                  FN.canonical_sha256(b=F.col("x"), a=F.col("y")).alias("c1"),
                  FN.canonical_sha256(a=F.col("y"), b=F.col("x")).alias("c2"),
                  FN.file_digest(F.lit("a"), "md5").alias("m")).first()
    assert r.t == ("Authorization: Bearer [REDACTED], API-key = [REDACTED]; [REDACTED_IMAGE] [REDACTED_IMAGE] token:[REDACTED]")
    assert r.s.startswith("a-b-") and len(r.s) == 16 and r.e.startswith("run-")
    assert (r.w, r.x, r.y) == ("A/b", 2, 4) and r.c1 == r.c2
    assert r.m == "0cc175b9c0f1b6a831c399e269772661"


def test_crops_and_event_rules(spark):
    df = spark.createDataFrame([(0.5, 1.5, 200.0, 50.0, 100, 40), (90.0, 0.0, 90.2, 5.0, 100, 40), (None, None, None, None, 100, 40)],
                               "x1 double, y1 double, x2 double, y2 double, frame_width int, frame_height int")
    assert [(r.crop_x1, r.crop_y1, r.crop_x2, r.crop_y2) for r in G.crop_rect(df).collect()] == [(0, 2, 100, 40)]
    ev = spark.createDataFrame([(5, 1.0, 4, 0.5), (5, 1.0, 6, None), (5, 1.0, None, None)],
                               "start_frame int, start_time double, end_frame int, end_time double")
    bad = [set(r._errors) for r in G.validate_events(ev)[1].collect()]
    assert {"end_frame_before_start", "end_time_before_start"} in bad and {"half_open_end"} in bad and len(bad) == 2
