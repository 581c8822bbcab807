"""Threshold candidates, clip metrics, and the select / confirm / unlock protocol.

Tables, keyed by (cycle_id, report_id):
  headers   one row per report; parameters and snapshot are canonical JSON text
  rows      one row per clip of a report
  selected  the declared clip list: (position, video_id)
  protocol  (cycle_id, partition, subject_id)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinewatch.functions.scalars import f1, is_commit, is_sha256, safe_ratio
from kinewatch.operators.lineage import cut
from kinewatch.operators.slices import small
from kinewatch.params import DEVELOPMENT, LOCKED, VALIDATION, Gate

KEY = ["cycle_id", "report_id"]

# Artifact kinds, variants, parameter sections and the metric fields of a report.
REPORT_KIND = "GROUPED_CLIP_LEVEL_INTERNAL_VALIDATION"
MIGRATION_KIND = "JSON_KEY_CANONICALIZATION_ONLY"
VARIANTS = ("nano", "small")
SECTIONS = ("detector", "event", "temporal", "tracking")
COUNTS = ("clips", "true_positive_clips", "false_positive_clips", "false_negative_clips",
          "true_negative_clips")
RATIOS = ("precision", "recall", "specificity", "f1")

# Preset name -> detector confidence, track activation, smoothing window, ratio,
# speed, suspect seconds, lying seconds, upright ratio, track timeout.
PRESET_FIELDS = (
    "confidence_threshold", "track_activation_threshold", "smoothing_window",
    "aspect_ratio_fall_min", "vertical_speed_min", "suspect_duration", "lying_duration",
    "upright_aspect_ratio_max", "track_timeout")
PRESETS = {
    "high_recall": (0.18, 0.18, 3, 0.80, 0.15, 0.25, 0.5, 0.78, 1.2),
    "balanced_short": (0.25, 0.25, 5, 0.85, 0.20, 0.30, 0.6, 0.75, 1.2),
    "balanced_duration": (0.30, 0.25, 5, 0.95, 0.25, 0.40, 0.8, 0.72, 1.0),
    "high_precision": (0.40, 0.30, 7, 1.05, 0.35, 0.60, 1.0, 0.68, 0.8),
}
PRECISION_STEPS = (0.40, 0.50, 0.60, 0.70, 0.75, 0.80)


def preset_values(presets: str = "base") -> dict[str, tuple]:
    """'base', 'precision' (six confidence steps on high_precision) or 'both'."""
    steps = {f"precision_{round(c * 100):03d}": (c, c, *PRESETS["high_precision"][2:])
             for c in PRECISION_STEPS}
    if presets not in ("base", "precision", "both"):
        raise ValueError("presets must be base, precision or both")
    return {**(PRESETS if presets != "precision" else {}), **(steps if presets != "base" else {})}


def candidate_grid(spark: SparkSession, variants: tuple[str, ...] = ("small",),
                   presets: str = "base") -> DataFrame:
    """One row per variant and preset: at most 20 rows, whatever the data."""
    rows = [(f"{v}-{name}", v, name, *map(float, p[:2]), int(p[2]), *map(float, p[3:]))
            for v in variants for name, p in preset_values(presets).items()]
    types = ["int" if f == "smoothing_window" else "double" for f in PRESET_FIELDS]
    schema = "candidate_id string, variant string, preset string, " + ", ".join(
        f"{f} {t}" for f, t in zip(PRESET_FIELDS, types))
    return spark.createDataFrame(rows, schema)


def canonical_json(text: Column) -> Column:
    """JSON text with sorted keys and no blanks, so that equal values are equal texts."""
    return F.to_json(F.parse_json(text))


def clip_metrics(rows: DataFrame, by: list[str], extra: dict[str, Column] | None = None) -> DataFrame:
    """Confusion counts and ratios per group; a ratio without denominator is null.

    `extra` aggregates are taken in the same pass.
    """
    e, p = F.col("expected_fall"), F.col("predicted_fall")
    out = rows.groupBy(*by).agg(
        F.count("*").alias("clips"),
        F.count_if(e & p).alias("true_positive_clips"),
        F.count_if(~e & p).alias("false_positive_clips"),
        F.count_if(e & ~p).alias("false_negative_clips"),
        F.count_if(~e & ~p).alias("true_negative_clips"),
        *[c.alias(n) for n, c in (extra or {}).items()])
    tp, fp = F.col("true_positive_clips"), F.col("false_positive_clips")
    fn, tn = F.col("false_negative_clips"), F.col("true_negative_clips")
    out = out.withColumns({
        "precision": safe_ratio(tp, tp + fp), "recall": safe_ratio(tp, tp + fn),
        "specificity": safe_ratio(tn, tn + fp)})
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def clip_rollup(events: DataFrame) -> DataFrame:
    """Events per clip: count and earliest start."""
    return events.groupBy("video_id").agg(
        F.count("*").alias("predicted_event_count"),
        F.min("start_time").alias("first_event_start_seconds"))


def clip_predictions(clips: DataFrame, events: DataFrame) -> DataFrame:
    """Every clip with its predicted flag, event count and first start."""
    out = clips.join(clip_rollup(events), "video_id", "left")
    n = F.coalesce("predicted_event_count", F.lit(0))
    return out.withColumns({"predicted_event_count": n, "predicted_fall": n > 0})


def partition_overlap(protocol: DataFrame) -> DataFrame:
    """Subjects that one cycle names in more than one partition, or twice in one."""
    g = protocol.groupBy("cycle_id", "subject_id").agg(
        F.count("*").alias("_n"), F.array_join(F.array_sort(F.collect_list("partition")), ",")
        .alias("partitions"))
    return g.filter("_n > 1").drop("_n")


def empty_partitions(protocol: DataFrame) -> DataFrame:
    """Partitions a cycle leaves without subjects."""
    names = F.explode(F.array(*[F.lit(n) for n in (DEVELOPMENT, VALIDATION, LOCKED)]))
    want = protocol.select("cycle_id").distinct().withColumn("partition", names)
    have = protocol.filter(F.col("subject_id").isNotNull()).select("cycle_id", "partition")
    return want.join(have, ["cycle_id", "partition"], "left_anti")


def protocol_subjects(rows: DataFrame, protocol: DataFrame, partition: str) -> DataFrame:
    """Violations: a subject outside the partition, or a subject of the partition not covered."""
    seen = rows.select(*KEY, "subject_id").distinct()
    allowed = protocol.filter(F.col("partition") == partition).select("cycle_id", "subject_id")
    outside = seen.join(allowed, ["cycle_id", "subject_id"], "left_anti").select(
        *KEY, F.lit("subject_outside_partition").alias("rule"), F.col("subject_id").cast("string")
        .alias("detail"))
    wanted = seen.select(*KEY).distinct().join(allowed, "cycle_id")
    absent = wanted.join(seen, [*KEY, "subject_id"], "left_anti").select(
        *KEY, F.lit("subject_not_covered").alias("rule"), F.col("subject_id").cast("string")
        .alias("detail"))
    return outside.unionByName(absent)


def _close(a: Column, b: Column) -> Column:
    gap = F.greatest(F.lit(1e-12), 1e-12 * F.greatest(F.abs(a), F.abs(b)))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.abs(a - b) <= gap)


def _section(json: Column, path: str) -> Column:
    return F.coalesce(F.get_json_object(json, f"$.{path}"), F.lit("null"))


def header_rules(partition: str) -> dict[str, Column]:
    c = F.col
    params, snap = c("pipeline_parameters"), c("config_snapshot")
    differs = F.lit(False)
    for field in ("confidence_threshold", "class_names", "posture_groups"):
        differs = differs | (_section(params, f"detector.{field}") != _section(snap, f"detector.{field}"))
    for section in ("tracking", "temporal", "event"):
        differs = differs | (_section(params, section) != _section(snap, section))
    keys = F.array_sort(F.coalesce(F.json_object_keys(params), F.array().cast("array<string>")))

    def differ(a: Column, b: Column) -> Column:
        return ~a.eqNullSafe(b)

    return {
        "wrong_report_kind": differ(c("validation_kind"), F.lit(REPORT_KIND)),
        "bad_commit": ~is_commit(c("implementation_git_commit")),
        "bad_implementation_hash": ~is_sha256(c("pipeline_implementation_sha256")),
        "wrong_partition": differ(c("partition"), F.lit(partition)),
        "metrics_for_other_partition": differ(F.array_join("metrics_partitions", ","), F.lit(partition)),
        "bad_variant": ~F.coalesce(c("model_variant").isin(*VARIANTS), F.lit(False)),
        "bad_weights_hash": ~is_sha256(c("weights_sha256")),
        "bad_config_hash": ~is_sha256(c("config_sha256")),
        "bad_manifest_hash": ~is_sha256(c("manifest_sha256")),
        "no_weights_path": F.coalesce(F.length("weights_path"), F.lit(0)) == 0,
        "incomplete_parameters": keys != F.array(*[F.lit(s) for s in sorted(SECTIONS)]),
        "no_snapshot": snap.isNull(),
        "wrong_mode": _section(snap, "detector.mode") != "posture_multiclass",
        "variant_differs_from_snapshot": differ(
            F.get_json_object(snap, "$.detector.model_variant"), c("model_variant")),
        "weights_differ_from_snapshot": differ(
            F.get_json_object(snap, "$.detector.weights_path"), c("weights_path")),
        "parameters_differ_from_snapshot": differs,
    }


def unsorted_ids(selected: DataFrame) -> DataFrame:
    """Listed ids (`detail`) that are above the id at the next position, once for each such neighbor.

    Every id goes to its own position and to the one before, where one aggregate compares them. The places
    found are written; only where a position is listed twice are the ids themselves joined.
    """
    place = [*KEY, "position"]
    known = selected.select(*place, "video_id").dropna(subset=place)
    none = F.lit(None).cast(dict(selected.dtypes)["video_id"])
    own = known.select(*place, F.col("video_id").alias("own"), none.alias("next"))
    ahead = known.select(*KEY, (F.col("position") - 1).alias("position"), none.alias("own"), F.col("video_id").alias("next"))
    found = cut(own.unionByName(ahead).groupBy(*place).agg(
        F.max("own").alias("own"), F.min("next").alias("next"), F.count("own").alias("a"), F.count("next").alias("b")).filter("next < own"))
    out = found.filter("a = 1 and b = 1").select(*KEY, F.col("own").alias("detail"))
    twice = found.filter("a > 1 or b > 1").select(*place)
    if twice.isEmpty():
        return out
    lower = known.join(small(twice), place)
    upper = known.withColumn("position", F.col("position") - 1).join(small(twice), place).withColumnRenamed("video_id", "next")
    return out.unionByName(lower.join(upper, place).filter("next < video_id").select(*KEY, F.col("video_id").alias("detail")))


def report_violations(headers: DataFrame, rows: DataFrame, selected: DataFrame,
                      protocol: DataFrame, partition: str) -> DataFrame:
    """All broken rules of all reports as (cycle_id, report_id, rule, detail)."""
    none = F.lit(None).cast("string")
    rules = header_rules(partition)
    hit = F.array_compact(F.array(*[
        F.when(F.coalesce(cond, F.lit(True)), F.lit(name)) for name, cond in rules.items()]))
    out = [headers.select(*KEY, F.explode(hit).alias("rule"), none.alias("detail"))]

    # one pass over the clip rows: row rules, and the metrics to compare with the saved ones
    bad = {
        "row_in_other_partition": ~F.col("partition").eqNullSafe(F.lit(partition)),
        "bad_video_id": F.coalesce(F.length("video_id"), F.lit(0)) == 0,
        "label_not_boolean": F.col("expected_fall").isNull() | F.col("predicted_fall").isNull(),
    }
    again = clip_metrics(rows, KEY, {n: F.count_if(cond) for n, cond in bad.items()})
    now = {n: F.col(n) for n in (*COUNTS, *RATIOS)}
    saved = {n: F.col(f"metrics.{n}") for n in (*COUNTS, *RATIOS)}
    same = F.lit(True)
    for n in COUNTS:
        same = same & saved[n].eqNullSafe(now[n])
    for n in RATIOS:
        same = same & _close(saved[n], now[n])
    both = headers.select(*KEY, "metrics").join(again, KEY, "left")
    found = F.array_compact(F.array(
        *[F.when(F.col(n) > 0, F.struct(F.lit(n).alias("rule"), F.col(n).cast("string").alias("detail")))
          for n in bad],
        F.when(F.col("clips").isNull(), F.struct(F.lit("no_clip_rows").alias("rule"), none.alias("detail")))
        .when(~same, F.struct(F.lit("metrics_differ").alias("rule"), none.alias("detail")))))
    out.append(both.select(*KEY, F.explode(found).alias("x")).select(*KEY, "x.rule", "x.detail"))

    # rows and listed ids meet in one aggregate, without sorts; a null key equals nothing, not even its like
    one, no = F.lit(1).cast("long"), F.lit(0).cast("long")
    both_ids = rows.select(*KEY, "video_id", one.alias("n"), no.alias("m")).unionByName(
        selected.select(*KEY, "video_id", no.alias("n"), one.alias("m")))
    counts = both_ids.groupBy(*KEY, "video_id").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    n, m = F.col("n"), F.col("m")
    unknown = F.col(KEY[0]).isNull() | F.col(KEY[1]).isNull() | F.col("video_id").isNull()
    wrong = F.array_compact(F.array(
        F.when(n > 1, F.lit("duplicate_video_id")),
        F.when(F.when(unknown, n > 0).otherwise(n != m), F.lit("selected_ids_differ")),
        F.when(unknown & (m > 0), F.lit("selected_ids_differ"))))
    out.append(counts.select(*KEY, F.explode(wrong).alias("rule"), F.col("video_id").alias("detail")))
    out.append(unsorted_ids(selected).select(*KEY, F.lit("selected_ids_unsorted").alias("rule"), "detail"))

    out.append(protocol_subjects(rows, protocol, partition))
    leak = partition_overlap(protocol).select("cycle_id", F.col("subject_id").cast("string").alias("detail"))
    out.append(headers.select(*KEY).join(leak, "cycle_id").select(
        *KEY, F.lit("subject_in_two_partitions").alias("rule"), "detail"))
    hollow = empty_partitions(protocol).select("cycle_id", F.col("partition").alias("detail"))
    out.append(headers.select(*KEY).join(hollow, "cycle_id").select(
        *KEY, F.lit("empty_partition").alias("rule"), "detail"))

    total = out[0]
    for part in out[1:]:
        total = total.unionByName(part)
    return total


def report_comparability(headers: DataFrame, rows: DataFrame) -> DataFrame:
    """Per cycle: reports must share manifest, protocol, implementation and clips; ids are unique."""
    def mixed(col: str, rule: str) -> Column:
        return F.when((F.min(col) != F.max(col)) | (F.count(col) != F.count("*")), F.lit(rule))

    g = headers.groupBy("cycle_id").agg(
        mixed("manifest_sha256", "different_manifests").alias("a"),
        mixed("protocol_sha256", "different_protocols").alias("b"),
        mixed("pipeline_implementation_sha256", "different_implementations").alias("c"),
        F.count("*").alias("reports"))
    out = g.select("cycle_id", F.explode(F.array_compact(F.array("a", "b", "c"))).alias("rule"),
                   F.lit(None).cast("string").alias("detail"))
    dup = headers.groupBy("cycle_id", "candidate_id").agg(F.count("*").alias("n")).filter("n > 1")
    out = out.unionByName(dup.select(
        "cycle_id", F.lit("duplicate_candidate").alias("rule"), F.col("candidate_id").alias("detail")))
    # every clip must be in all reports of its cycle
    clips = rows.select(*KEY, "video_id").repartition("cycle_id", "video_id").distinct().groupBy(  # one shuffle serves both
        "cycle_id", "video_id").agg(F.count("*").alias("k"))
    uneven = clips.join(g.select("cycle_id", "reports"), "cycle_id").filter("k <> reports")
    return out.unionByName(uneven.select(
        "cycle_id", F.lit("clip_not_in_all_reports").alias("rule"), F.col("video_id").alias("detail")))


def gate_passes(gate: Gate) -> Column:
    return F.coalesce(
        (F.col("recall") >= gate.minimum_recall)
        & (F.col("false_positive_clips") <= gate.maximum_false_positives), F.lit(False))


def candidate_order(preferred: str) -> Column:
    """Fewest false positives, best F1, recall and specificity, preferred variant, lowest confidence."""
    def high(c: str) -> Column:
        return -F.coalesce(F.col(c), F.lit(-1.0))

    return F.struct(
        F.col("false_positive_clips").alias("k1"), high("f1").alias("k2"), high("recall").alias("k3"),
        high("specificity").alias("k4"),
        F.when(F.col("model_variant") == preferred, 0).otherwise(1).alias("k5"),
        F.col("confidence_threshold").alias("k6"), F.col("model_variant").alias("k7"),
        F.col("candidate_id").alias("k8"))


def rank_candidates(metrics: DataFrame, gate: Gate, preferred: str = "nano",
                    by: list[str] | None = None) -> DataFrame:
    """Eligible candidates with their 1-based position; metrics has one row per candidate."""
    from pyspark.sql import Window

    if preferred not in VARIANTS:
        raise ValueError("preferred variant must be nano or small")
    w = Window.partitionBy(*(by or [])).orderBy(candidate_order(preferred))
    return metrics.filter(gate_passes(gate)).withColumn("position", F.row_number().over(w))


def select_candidate(headers: DataFrame, rows: DataFrame, selected: DataFrame, protocol: DataFrame,
                     gate: Gate, preferred: str = "nano") -> tuple[DataFrame, DataFrame]:
    """(lock, violations): the best eligible development report of every cycle without violations."""
    if preferred not in VARIANTS:
        raise ValueError("preferred variant must be nano or small")
    broken = report_violations(headers, rows, selected, protocol, DEVELOPMENT).unionByName(
        report_comparability(headers, rows).withColumn("report_id", F.lit(None).cast("string")))
    m = clip_metrics(rows, KEY).join(headers.drop("metrics"), KEY)
    m = m.withColumn("confidence_threshold", F.get_json_object(
        "pipeline_parameters", "$.detector.confidence_threshold").cast("double"))
    eligible = m.filter(gate_passes(gate))
    nobody = headers.select("cycle_id").distinct().join(eligible, "cycle_id", "left_anti").select(
        "cycle_id", F.lit(None).cast("string").alias("report_id"),
        F.lit("no_eligible_candidate").alias("rule"), F.lit(None).cast("string").alias("detail"))
    keep = ["report_id", "candidate_id", "model_variant", "confidence_threshold", "manifest_sha256",
            "protocol_sha256", "pipeline_implementation_sha256", "weights_sha256",
            "pipeline_parameters", *COUNTS, *RATIOS]
    best = eligible.groupBy("cycle_id").agg(
        F.min_by(F.struct(*keep), candidate_order(preferred)).alias("s"),
        F.count("*").alias("eligible_candidates"))
    lock = best.join(broken.select("cycle_id"), "cycle_id", "left_anti").select(
        "cycle_id", "s.*", "eligible_candidates")
    return lock, broken.unionByName(nobody)


def reused_clips(development: DataFrame, validation: DataFrame) -> DataFrame:
    """Validation clips already used for development in the same cycle."""
    return validation.select("cycle_id", "video_id").distinct().join(
        development.select("cycle_id", "video_id").distinct(), ["cycle_id", "video_id"], "left_semi")


def confirm_candidate(lock: DataFrame, development: DataFrame, headers: DataFrame, rows: DataFrame,
                      selected: DataFrame, protocol: DataFrame, gate: Gate
                      ) -> tuple[DataFrame, DataFrame]:
    """(confirmations, violations) of one validation report per cycle against its lock."""
    out = report_violations(headers, rows, selected, protocol, VALIDATION)
    same = ["manifest_sha256", "protocol_sha256", "pipeline_implementation_sha256", "model_variant",
            "weights_sha256", "pipeline_parameters"]
    pair = headers.select(*KEY, *same).join(
        lock.select("cycle_id", *[F.col(c).alias(f"lock_{c}") for c in same]), "cycle_id", "left")
    differs = F.array_compact(F.array(*[
        F.when(~F.col(c).eqNullSafe(F.col(f"lock_{c}")), F.lit(f"{c}_differs_from_lock"))
        for c in same]))
    none = F.lit(None).cast("string").alias("detail")
    out = out.unionByName(pair.select(*KEY, F.explode(differs).alias("rule"), none))
    reports = headers.select(*KEY)
    out = out.unionByName(reused_clips(development, rows).join(reports, "cycle_id").select(
        *KEY, F.lit("development_clip_reused").alias("rule"), F.col("video_id").alias("detail")))
    m = clip_metrics(rows, KEY)
    out = out.unionByName(m.filter(~gate_passes(gate)).select(
        *KEY, F.lit("gate_not_met").alias("rule"), none))
    good = headers.drop("metrics").join(out.select(*KEY), KEY, "left_anti").join(m, KEY)
    return good, out


def unlocked_clips(clips: DataFrame, confirmations: DataFrame, run: DataFrame,
                   migrations: DataFrame | None = None) -> DataFrame:
    """Clips outside the locked partition, plus locked clips whose run was confirmed.

    run: per cycle the hashes, variant and parameters about to be used. A changed implementation
    needs a migration row that links both hashes and declares that nothing else changed.
    """
    same = ["cycle_id", "manifest_sha256", "protocol_sha256", "model_variant", "weights_sha256",
            "pipeline_parameters"]
    impl = "pipeline_implementation_sha256"
    pair = run.join(confirmations.select(*same, F.col(impl).alias("confirmed_impl"),
                                         *[c for c in ("confirmation_sha256",)
                                           if c in confirmations.columns]), same)
    direct = pair.filter(F.col(impl) == F.col("confirmed_impl")).select("cycle_id")
    if migrations is not None:
        ok = migrations.filter(
            (F.col("migration_kind") == MIGRATION_KIND)
            & (F.col("model_or_threshold_parameter_changed") == F.lit(False))
            & (F.col("validation_partition_reused") == F.lit(False))
            & F.col("runtime_core_sha256_before").eqNullSafe(F.col("runtime_core_sha256_after")))
        moved = pair.join(ok.select(
            F.col("original_confirmation_sha256").alias("confirmation_sha256"),
            F.col("from_pipeline_implementation_sha256").alias("confirmed_impl"),
            F.col("to_pipeline_implementation_sha256").alias(impl),
            F.col("runtime_core_sha256_after").alias("runtime_core_sha256")),
            ["confirmation_sha256", "confirmed_impl", impl, "runtime_core_sha256"], "left_semi")
        direct = direct.unionByName(moved.select("cycle_id"))
    locked = F.col("partition") == LOCKED
    return clips.filter(~locked).unionByName(
        clips.filter(locked).join(direct, "cycle_id", "left_semi"))


def require_clean(violations: DataFrame) -> None:
    """Raises on the first violation."""
    first = violations.first()
    if first is not None:
        raise ValueError(f"protocol violation: {first.asDict()}")
