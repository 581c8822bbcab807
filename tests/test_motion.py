import pytest
from pyspark.sql import functions as F

from kinewatch.operators import motion as M
from kinewatch.params import SCOPE, TRACK, CascadeParams, PostureGroups, Thresholds
from kinewatch.plans import cascade as C
from tests.makers import FRAME, OBS, frame_row, obs_row, random_video, replay

P = CascadeParams()


def tables(spark, seeds):
    obs, frames = [], []
    for s in seeds:
        o, f = random_video(s)
        obs += o
        frames += f
    return spark.createDataFrame(obs, OBS), spark.createDataFrame(frames, FRAME)


def test_speed_in_seconds_and_frame_heights(spark):
    obs = spark.createDataFrame([obs_row(0, 0.0, (40, 10, 60, 30), "standing"),
                                 obs_row(1, 0.5, (40, 20, 60, 40), "standing")], OBS)
    row = M.temporal_features(obs).orderBy("frame_id").collect()[1]
    assert row.vertical_speed_pixels_per_second == pytest.approx(20.0)
    assert row.vertical_speed_frame_height_per_second == pytest.approx(0.2)
    assert row.elapsed_seconds == pytest.approx(0.5)


def test_first_row_is_raw_and_left_out_of_the_mean(spark):
    boxes = [(0, 0, 10, 10), (0, 0, 20, 10), (0, 0, 40, 10)]
    obs = spark.createDataFrame([obs_row(i, i * 0.5, b, "standing") for i, b in enumerate(boxes)], OBS)
    out = M.smooth_features(M.temporal_features(obs), 5).orderBy("frame_id").collect()
    assert [r.aspect_ratio_width_over_height for r in out] == [1.0, 2.0, 3.0]


@pytest.mark.parametrize("window", [1, 2, 5])
def test_sliced_features_equal_plain_windows(spark, window):
    obs, _ = tables(spark, range(3))
    plain = M.smooth_features(M.temporal_features(obs), window).drop("detection_id")
    for width in (0.3, 2.0):
        cut = M.smooth_features(M.temporal_features(obs, width), window, width).select(plain.columns)
        keys = [*TRACK, "frame_id"]
        a = {tuple(r[k] for k in keys): r for r in plain.collect()}
        b = {tuple(r[k] for k in keys): r for r in cut.collect()}
        assert a.keys() == b.keys()
        for k, r in a.items():
            for c in M.SMOOTHED:
                assert b[k][c] == pytest.approx(r[c], abs=1e-12), (k, c)


def test_posture_groups_ignore_case_and_static_boxes_do_not_trigger(spark):
    obs = spark.createDataFrame([obs_row(0, 0.0, (0, 0, 90, 30), "LYING"),
                                 obs_row(1, 0.5, (0, 0, 90, 30), "Lying")], OBS)
    rows = C.motion_signals(obs, P).collect()
    assert all(r.lying_posture and r.fall_signal and not r.candidate_trigger for r in rows)


def test_synthetic_slice_gives_three_changes(spark):
    obs, frames = [], []
    for f in range(13):
        if f < 2:
            box, name = (40, 10 + 2 * f, 60, 90 + 2 * f), "standing"
        elif f < 5:
            top = 20 + (f - 2) * 10
            box, name = (25, top, 85, min(100, top + 55)), "falling"
        else:
            box, name = (10, 65, 95, 95), "lying"
        obs.append(obs_row(f, f * 0.2, box, name, 1, "m", "m", (120, 120)))
        frames.append(frame_row(f, f * 0.2, "m", "m", (120, 120)))
    run = C.run_cascade(spark.createDataFrame(frames, FRAME), spark.createDataFrame(obs, OBS), P)
    moves = [(r.next_state, r.frame_id) for r in run.transitions.orderBy("frame_id").collect()]
    assert moves == [("suspected", 2), ("falling", 4), ("lying", 5)]
    event = run.events.collect()
    assert len(event) == 1 and event[0].start_time == pytest.approx(0.4)
    assert [r.frame_id for r in run.reviews.collect()] == [10]
    roles = [r.role for r in run.keyframes.orderBy("role_order").collect()]
    assert roles == ["before", "during", "after"]


@pytest.mark.parametrize("width", [None, 2.0, 5.0])
def test_states_events_and_reviews_equal_a_plain_loop(spark, width):
    seeds = range(6)
    obs, frames = tables(spark, seeds)
    moves = C.transitions_of(obs, frames, P, width).cache()
    from kinewatch.operators import episodes as E

    log = E.fall_events(moves, frames, P.events, width).cache()
    got_moves = {(r.source_id, r.track_id, r.frame_id, r.previous_state, r.next_state, r.reason)
                 for r in moves.collect()}
    changes, reviews = [], []
    for r in log.collect():
        snap = (r.track_id, r.start_frame, r.start_time, r.end_frame, r.end_time, r.status,
                r.lying_started_at_seconds, r.cooldown_suppressed_candidate_at,
                tuple(r.transition_reasons))
        if r.kind == "change":
            changes.append((r.source_id, r.frame_id, snap))
        else:
            reviews.append((r.source_id, r.frame_id, snap, r.temporal_state))
    want_moves, want_changes, want_reviews = set(), [], []
    for s in seeds:
        m, c, v = replay(*random_video(s))
        want_moves |= {(f"cam{s}", *x) for x in m}
        want_changes += [(f"cam{s}", *x) for x in c]
        want_reviews += [(f"cam{s}", *x) for x in v]
    assert got_moves == want_moves and len(want_moves) > 200
    assert sorted(changes, key=repr) == sorted(want_changes, key=repr)
    assert sorted(reviews, key=repr) == sorted(want_reviews, key=repr) and want_reviews


def test_empty_frame_expires_a_track_and_reappearance_is_differenced_across_the_gap(spark):
    obs = spark.createDataFrame([
        obs_row(0, 0.0, (0, 0, 20, 60), "falling"), obs_row(4, 4.0, (0, 40, 20, 100), "standing")], OBS)
    frames = spark.createDataFrame([frame_row(i, float(i)) for i in range(5)], FRAME)
    expiry = M.track_expiry(obs, frames, 1.0).collect()
    assert [(r.frame_id, r.gap) for r in expiry] == [(2, 2.0)]
    moves = C.transitions_of(obs, frames, P).orderBy("frame_id").collect()
    assert [(r.frame_id, r.next_state) for r in moves] == [(0, "suspected"), (2, "resolved")]
    again = M.temporal_features(obs).orderBy("frame_id").collect()[1]
    assert again.elapsed_seconds == 4.0 and again.center_dy_pixels == 40.0


def test_time_violations_are_reported_in_frame_order(spark):
    obs = spark.createDataFrame([obs_row(0, 0.0, (0, 0, 1, 1), "a"), obs_row(1, 1.0, (0, 0, 1, 1), "a"),
                                 obs_row(2, 1.0, (0, 0, 1, 1), "a"), obs_row(3, 0.5, (0, 0, 1, 1), "a")], OBS)
    for width in (None, 2.0):
        bad = M.monotonicity_violations(obs, TRACK, width).orderBy("frame_id").collect()
        assert [r.frame_id for r in bad] == [2, 3]


def test_expiry_comparison_is_the_subtraction(spark):
    # 1.4 - 0.4 is below one in doubles, so 1.4 is not beyond the timeout
    obs = spark.createDataFrame([obs_row(0, 0.4, (0, 0, 20, 60), "falling")], OBS)
    frames = spark.createDataFrame([frame_row(0, 0.4), frame_row(1, 1.4), frame_row(2, 1.6)], FRAME)
    assert [r.frame_id for r in M.track_expiry(obs, frames, 1.0).collect()] == [2]


def test_candidate_sweep_equals_single_runs(spark):
    from kinewatch.operators.protocol import PRESETS, candidate_grid

    obs, frames = tables(spark, range(3))
    obs = obs.withColumn("confidence", 0.2 + F.col("frame_id") % 7 / 10.0)
    for width in (None, 4.0):
        sweep = C.candidate_events(obs, frames, candidate_grid(spark), width=width).cache()
        for name, v in PRESETS.items():
            one = CascadeParams(Thresholds(*v[2:]), PostureGroups(), P.events)
            run = C.run_cascade(frames, obs.filter(F.col("confidence") >= v[0]), one, "temporal")
            cols = [*TRACK, "start_frame", "end_frame", "status"]
            a = sorted(map(tuple, run.events.select(*cols).collect()), key=repr)
            b = sorted(map(tuple, sweep.filter(F.col("candidate_id") == f"small-{name}")
                           .select(*cols).collect()), key=repr)
            assert a == b and a


def test_levels_stop_early(spark):
    obs, frames = tables(spark, [0])
    assert C.run_cascade(frames, obs, P, "detector_only").tracked is None
    assert C.run_cascade(frames, obs, P, "detector_tracking").transitions is None
    part = C.run_cascade(frames, obs, P, "temporal")
    assert part.events is not None and part.reviews is None
    with pytest.raises(ValueError):
        C.run_cascade(frames, obs, P, "everything")


def test_active_tracks_and_frame_motion(spark):
    obs, frames = tables(spark, [1])
    assert M.active_tracks(obs, 1e9, 1.0).count() == 0
    motion = M.frame_motion(C.motion_signals(obs, P), frames)
    assert motion.count() == frames.count()
    assert motion.filter("bbox is null and motion_score <> 0").count() == 0
    assert motion.select(*SCOPE).distinct().count() == 1


def test_a_sweep_moves_observations_once(spark):
    """The rows of each candidate never go through a shuffle, only its state changes, by episode."""
    from kinewatch.operators.protocol import candidate_grid

    obs, frames = tables(spark, range(2))
    obs = obs.withColumn("confidence", F.lit(0.9))
    plan = C.candidate_events(obs, frames, candidate_grid(spark))._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.split("\n")
             if "Exchange hashpartitioning" in line and "candidate_id#" in line and "track_id#" in line]
    assert len(moved) == 1 and "REPARTITION_BY_COL" in moved[0]


def test_tasks_grow_with_the_observations(spark, monkeypatch):
    obs, frames = tables(spark, range(2))
    monkeypatch.setattr(C, "ROWS_A_TASK", 10)
    want = -(-obs.count() * 3 // 10)
    assert [df.rdd.getNumPartitions() for df in C.together(obs, frames, None, 3)] == [want, want]
    assert C.together(obs, frames, 4.0) == (obs, frames)


def test_tables_of_one_run_keep_their_rows_in_one_plan(spark):
    """Events, reviews and transitions counted in one plan, over tables that are subqueries, as each counted alone."""
    from kinewatch.operators.reporting import run_summary

    obs, frames = [spark.sql("select * from (select 'at-' || source_id as source_id, * except (source_id) from {t})", t=t)
                   for t in tables(spark, range(6))]
    run = C.run_cascade(frames, obs, P)
    alone = {"events": run.events.count(), "alerts": run.reviews.count(), "transitions": run.transitions.count()}
    assert min(alone.values()) > 0
    assert {r.kind: r.rows for r in run_summary(run.events, run.reviews, run.transitions).collect()} == alone
