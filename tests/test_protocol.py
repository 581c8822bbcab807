import pytest
from pyspark.sql import functions as F

from kinewatch.operators import protocol as PR
from kinewatch.params import DEVELOPMENT, LOCKED, VALIDATION, Gate

ROW = ("cycle_id string, report_id string, video_id string, subject_id int, partition string, "
       "expected_fall boolean, predicted_fall boolean")
SHA = "a" * 64
PARTS = {DEVELOPMENT: (1, 2), VALIDATION: (3,), LOCKED: (4,)}
PARAMS = '{"detector":{"class_names":{"0":"x"},"confidence_threshold":%s,"posture_groups":{}},"event":{"a":1},"temporal":{"b":1},"tracking":{"c":1}}'
SNAP = '{"detector":{"class_names":{"0":"x"},"confidence_threshold":%s,"mode":"posture_multiclass","model_variant":"%s","posture_groups":{},"weights_path":"w"},"event":{"a":1},"temporal":{"b":1},"tracking":{"c":1}}'


def rows_of(report, counts, partition=DEVELOPMENT, cycle="c", start=0):
    tp, fp, fn, tn = counts
    labels = [(True, True)] * tp + [(False, True)] * fp + [(True, False)] * fn + [(False, False)] * tn
    subjects = PARTS[partition]
    return [(cycle, report, f"v{start + i:04d}", subjects[i % len(subjects)], partition, e, p)
            for i, (e, p) in enumerate(labels)]


def tables(spark, reports, partition=DEVELOPMENT, cycle="c", start=0):
    """reports: {report_id: (counts, variant, confidence)}"""
    rows = [r for k, v in reports.items() for r in rows_of(k, v[0], partition, cycle, start)]
    rows = spark.createDataFrame(rows, ROW)
    spec = spark.createDataFrame([(k, v[1], v[2]) for k, v in reports.items()],
                                 "report_id string, model_variant string, conf double")
    m = PR.clip_metrics(rows, PR.KEY).join(spec, "report_id")
    lit = F.lit
    headers = m.select(
        "cycle_id", "report_id", F.concat("report_id").alias("candidate_id"),
        lit(PR.REPORT_KIND).alias("validation_kind"), lit("b" * 40).alias("implementation_git_commit"),
        lit(SHA).alias("pipeline_implementation_sha256"), lit(partition).alias("partition"),
        "model_variant", lit(SHA).alias("weights_sha256"), lit("w").alias("weights_path"),
        lit(SHA).alias("config_sha256"), lit(SHA).alias("manifest_sha256"),
        lit(SHA).alias("protocol_sha256"), F.array(lit(partition)).alias("metrics_partitions"),
        F.struct(*PR.COUNTS, *PR.RATIOS).alias("metrics"),
        F.format_string(PARAMS, F.col("conf").cast("string")).alias("pipeline_parameters"),
        F.format_string(SNAP, F.col("conf").cast("string"), "model_variant").alias("config_snapshot"))
    selected = rows.select("cycle_id", "report_id", F.substring("video_id", 2, 4).cast("long").alias("position"), "video_id")
    protocol = spark.createDataFrame([(cycle, p, s) for p, m in PARTS.items() for s in m],
                                     "cycle_id string, partition string, subject_id int")
    return headers.cache(), rows, selected, protocol


@pytest.mark.parametrize("counts, ratios", [
    ((24, 0, 0, 24), (1.0, 1.0, 1.0, 1.0)),
    ((9, 0, 1, 10), (1.0, 0.9, 1.0, 0.9474)),
    ((139, 19, 64, 152), (0.8797, 0.6847, 0.8889, 0.7701)),
    ((0, 0, 3, 2), (None, 0.0, 1.0, None)),
    ((0, 2, 3, 0), (0.0, 0.0, 0.0, None)),
])
def test_published_confusion_counts(spark, counts, ratios):
    m = PR.clip_metrics(spark.createDataFrame(rows_of("r", counts), ROW), ["report_id"]).first()
    got = [None if m[k] is None else round(m[k], 4) for k in PR.RATIOS]
    assert got == list(ratios) and m.clips == sum(counts)


def test_clean_reports_select_by_every_tie_break(spark):
    gate = Gate(0.5, 1)
    same = (8, 0, 2, 10)
    reports = {"a": (same, "small", 0.4), "b": (same, "nano", 0.6), "c": (same, "nano", 0.5),
               "d": ((10, 1, 0, 9), "nano", 0.4), "e": ((3, 0, 7, 10), "nano", 0.1)}
    t = tables(spark, reports)
    lock, broken = PR.select_candidate(*t, gate, "nano")
    assert broken.count() == 0
    row = lock.first()
    assert row.report_id == "c" and row.eligible_candidates == 4
    assert PR.select_candidate(*t, gate, "small")[0].first().report_id == "a"
    none, why = PR.select_candidate(*t, Gate(1.0, 0), "nano")
    assert none.count() == 0 and [r.rule for r in why.collect()] == ["no_eligible_candidate"]
    with pytest.raises(ValueError):
        PR.require_clean(why)
    with pytest.raises(ValueError):
        PR.select_candidate(*t, gate, "large")


def test_each_fault_is_named(spark):
    h, rows, selected, protocol = tables(spark, {"a": ((4, 0, 0, 4), "nano", 0.4)})
    base = [h, rows, selected, protocol]

    def rules(**change):
        t = {**dict(zip(("h", "rows", "selected", "protocol"), base)), **change}
        out = PR.report_violations(t["h"], t["rows"], t["selected"], t["protocol"], DEVELOPMENT)
        return {r.rule for r in out.collect()}

    assert rules() == set()
    for column, value, rule in [
        ("validation_kind", "x", "wrong_report_kind"), ("implementation_git_commit", "B" * 40, "bad_commit"),
        ("pipeline_implementation_sha256", SHA + "\n", "bad_implementation_hash"), ("weights_sha256", None, "bad_weights_hash"),
        ("config_sha256", "q", "bad_config_hash"), ("manifest_sha256", "q", "bad_manifest_hash"),
        ("config_snapshot", None, "no_snapshot"), ("pipeline_parameters", '{"detector":{}}', "incomplete_parameters"),
    ]:
        assert rule in rules(h=h.withColumn(column, F.lit(value).cast("string"))), rule
    assert rules(h=h.withColumn("model_variant", F.lit("big"))) == {"bad_variant", "variant_differs_from_snapshot"}
    assert rules(h=h.withColumn("partition", F.lit(VALIDATION))) == {"wrong_partition"}
    assert rules(h=h.withColumn("metrics_partitions", F.array(F.lit("p"), F.lit("q")))) == {"metrics_for_other_partition"}
    changed = F.regexp_replace("pipeline_parameters", '"b":1', '"b":2')
    assert rules(h=h.withColumn("pipeline_parameters", changed)) == {"parameters_differ_from_snapshot"}
    near = h.withColumn("metrics", F.col("metrics").withField("recall", F.lit(1.0 - 1e-13)))
    assert rules(h=near) == set()
    far = h.withColumn("metrics", F.col("metrics").withField("f1", F.lit(None).cast("double")))
    assert rules(h=far) == {"metrics_differ"}
    assert "no_clip_rows" in rules(rows=rows.limit(0))
    assert "subject_not_covered" in rules(rows=rows.filter("subject_id = 1"))
    assert "subject_outside_partition" in rules(rows=rows.withColumn("subject_id", F.lit(3)))
    assert {"duplicate_video_id", "selected_ids_differ"} <= rules(rows=rows.unionByName(rows.limit(1)))
    assert rules(selected=selected.withColumn("position", -F.col("position"))) == {"selected_ids_unsorted"}
    assert "label_not_boolean" in rules(rows=rows.withColumn("predicted_fall", F.lit(None).cast("boolean")))
    leak = protocol.unionByName(spark.createDataFrame([("c", LOCKED, 1)], protocol.schema))
    assert rules(protocol=leak) == {"subject_in_two_partitions"}
    assert "empty_partition" in rules(protocol=protocol.filter(F.col("partition") != LOCKED))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ids_are_compared_without_sorting_the_clips(spark):
    """Positions and counts of ids come from aggregates; null ids equal nothing, a doubled position gives every pair."""
    h, rows, selected, protocol = tables(spark, {"a": ((4, 0, 0, 4), "nano", 0.4)})
    listed = [("c", "a", p, v) for p, v in [(1, "d"), (1, "b"), (2, "c"), (2, "a"), (3, "z"), (None, "q"), (4, None), (9, "x"), (10, "x")]]
    table = spark.createDataFrame(listed, selected.schema)
    want = sorted(v for _, _, p, v in listed for _, _, q, w in listed
                  if None not in (p, q, v, w) and q == p + 1 and w < v)
    assert sorted(r.detail for r in PR.unsorted_ids(table).collect()) == want == ["b", "d", "d"]
    plan = plan_of(PR.unsorted_ids(selected))
    assert "SortMergeJoin" not in plan and "Sort " not in plan
    assert "FullOuter" not in plan_of(PR.report_violations(h, rows, selected, protocol, DEVELOPMENT))
    odd = rows.withColumn("video_id", F.when(F.col("video_id") != rows.first().video_id, F.col("video_id")))
    none = selected.withColumn("video_id", F.when(F.col("video_id") != rows.first().video_id, F.col("video_id")))
    found = PR.report_violations(h, odd, none, protocol, DEVELOPMENT).filter("rule = 'selected_ids_differ'")
    assert [r.detail for r in found.collect()] == [None, None]


def test_reports_must_be_comparable(spark):
    h, rows, _, _ = tables(spark, {"a": ((4, 0, 0, 4), "nano", 0.4), "b": ((3, 0, 1, 4), "nano", 0.5)})
    assert PR.report_comparability(h, rows).count() == 0
    other = h.withColumn("manifest_sha256", F.when(F.col("report_id") == "a", "x").otherwise("y"))
    assert [r.rule for r in PR.report_comparability(other, rows).collect()] == ["different_manifests"]
    twice = h.withColumn("candidate_id", F.lit("same"))
    assert [r.rule for r in PR.report_comparability(twice, rows).collect()] == ["duplicate_candidate"]
    fewer = rows.filter("not (report_id = 'b' and video_id = 'v0003')")
    assert [(r.rule, r.detail) for r in PR.report_comparability(h, fewer).collect()] == [
        ("clip_not_in_all_reports", "v0003")]


def test_confirm_and_unlock(spark):
    gate = Gate(0.8, 0)
    dev = tables(spark, {"a": ((9, 0, 1, 10), "nano", 0.4)})
    lock = PR.select_candidate(*dev, gate)[0].cache()
    val = tables(spark, {"v": ((9, 0, 1, 10), "nano", 0.4)}, VALIDATION, start=500)
    ok, broken = PR.confirm_candidate(lock, dev[1], *val, gate)
    ok = ok.cache()
    assert broken.count() == 0 and ok.count() == 1
    weak = tables(spark, {"v": ((1, 0, 1, 2), "nano", 0.4)}, VALIDATION, start=500)
    assert {r.rule for r in PR.confirm_candidate(lock, dev[1], *weak, gate)[1].collect()} == {"gate_not_met"}
    tuned = tables(spark, {"v": ((9, 0, 1, 10), "nano", 0.5)}, VALIDATION, start=500)
    assert {r.rule for r in PR.confirm_candidate(lock, dev[1], *tuned, gate)[1].collect()} == {
        "pipeline_parameters_differs_from_lock"}
    reused = tables(spark, {"v": ((9, 0, 1, 10), "nano", 0.4)}, VALIDATION, start=10)
    assert {r.rule for r in PR.confirm_candidate(lock, dev[1], *reused, gate)[1].collect()} == {
        "development_clip_reused"}

    clips = spark.createDataFrame([("c", "v1", LOCKED), ("c", "v2", DEVELOPMENT)],
                                  "cycle_id string, video_id string, partition string")
    confirmed = ok.withColumn("confirmation_sha256", F.lit("k"))
    run = ok.select("cycle_id", "manifest_sha256", "protocol_sha256", "model_variant", "weights_sha256",
                    "pipeline_parameters", "pipeline_implementation_sha256").withColumn("runtime_core_sha256", F.lit("core"))
    assert PR.unlocked_clips(clips, confirmed, run).count() == 2
    moved = run.withColumn("pipeline_implementation_sha256", F.lit("new"))
    assert [r.video_id for r in PR.unlocked_clips(clips, confirmed, moved).collect()] == ["v2"]
    fields = ("migration_kind string, original_confirmation_sha256 string, from_pipeline_implementation_sha256 string, "
              "to_pipeline_implementation_sha256 string, runtime_core_sha256_before string, runtime_core_sha256_after string, "
              "model_or_threshold_parameter_changed boolean, validation_partition_reused boolean")

    def migration(**change):
        row = dict(zip([f.split()[0] for f in fields.split(",")],
                       (PR.MIGRATION_KIND, "k", SHA, "new", "core", "core", False, False)))
        row.update(change)
        return spark.createDataFrame([tuple(row.values())], fields)

    assert PR.unlocked_clips(clips, confirmed, moved, migration()).count() == 2
    for change in ({"migration_kind": "x"}, {"runtime_core_sha256_before": "q"}, {"validation_partition_reused": True},
                   {"model_or_threshold_parameter_changed": None}, {"original_confirmation_sha256": "z"}):
        assert PR.unlocked_clips(clips, confirmed, moved, migration(**change)).count() == 1, change


def test_presets_and_gate(spark):
    assert len(PR.preset_values("base")) == 4 and len(PR.preset_values("precision")) == 6
    both = {r.preset: r for r in PR.candidate_grid(spark, presets="both").collect()}
    assert len(both) == 10
    assert both["precision_075"].confidence_threshold == 0.75 and both["precision_075"].smoothing_window == 7
    with pytest.raises(ValueError):
        Gate(1.2, 0)
    with pytest.raises(ValueError):
        PR.preset_values("all")


def test_clip_rollup(spark):
    clips = spark.createDataFrame([("a",), ("b",)], "video_id string")
    events = spark.createDataFrame([("a", 3.0), ("a", 1.0)], "video_id string, start_time double")
    got = {r.video_id: (r.predicted_fall, r.predicted_event_count, r.first_event_start_seconds)
           for r in PR.clip_predictions(clips, events).collect()}
    assert got == {"a": (True, 2, 1.0), "b": (False, 0, None)}
