import pytest

from kinewatch.operators import episodes as E
from kinewatch.params import EventParams
from tests.makers import FRAME, frame_row

MOVE = ("source_id string, session_id string, track_id int, frame_id long, timestamp_seconds double, "
        "previous_state string, next_state string, reason string")
P = EventParams()


def run(spark, moves, last=40, step=0.5, p=P, width=None):
    rows = [("source", "session", 7, int(t / step), float(t), "x", s, f"{s} at {t}") for t, s in moves]
    frames = spark.createDataFrame([frame_row(i, i * step) for i in range(last)], FRAME)
    return E.fall_events(spark.createDataFrame(rows, MOVE), frames, p, width).cache()


def final(log):
    return E.latest_event_state(E.event_changes(log)).orderBy("start_time").collect()


def test_gap_of_one_second_merges(spark):
    e = final(run(spark, [(0, "suspected"), (0.5, "falling"), (1, "resolved"), (2, "suspected"), (2.5, "falling")]))
    assert len(e) == 1 and e[0].transition_reasons[-3:-1] == [
        "merged: suspected at 2", "merged: falling at 2.5"]
    assert e[0].status == "timed_out" and e[0].start_time == 0.0


def test_gap_of_three_seconds_is_suppressed(spark):
    e = final(run(spark, [(0, "suspected"), (0.5, "falling"), (1, "resolved"), (4, "suspected"), (4.5, "falling")]))
    assert len(e) == 1 and e[0].cooldown_suppressed_candidate_at == 4.0 and e[0].status == "resolved"


def test_suppressed_falling_may_be_followed_by_a_new_event_on_lying(spark):
    e = final(run(spark, [(0, "suspected"), (0.5, "falling"), (1, "resolved"), (5.5, "suspected"),
                          (6, "falling"), (6.5, "lying")]))
    assert [x.start_time for x in e] == [0.0, 6.5] and e[0].cooldown_suppressed_candidate_at == 5.5
    assert e[1].lying_started_at_seconds == 6.5


def test_pending_candidate_is_dropped_by_upright(spark):
    assert final(run(spark, [(0, "suspected"), (1, "upright")])) == []
    e = final(run(spark, [(0, "suspected"), (1, "upright"), (2, "suspected"), (3, "falling")]))
    assert [x.start_time for x in e] == [2.0]


def test_timeout_sets_both_ends(spark):
    e = final(run(spark, [(0, "suspected"), (0.5, "falling")]))[0]
    assert (e.end_frame, e.end_time, e.status) == (21, 10.5, "timed_out")
    assert e.transition_reasons[-1] == "event timeout reached"


def test_merged_event_keeps_its_start_and_may_time_out_at_once(spark):
    moves = [(0, "suspected"), (0.5, "falling"), (9.5, "resolved"), (10.5, "suspected"), (11, "falling")]
    log = run(spark, moves, 60)
    e = final(log)[0]
    assert (e.status, e.end_time) == ("timed_out", 11.0)
    assert [r.frame_id for r in E.review_ready(log).collect()] == [19]  # reviewed once, on its first end


def test_merge_on_lying_keeps_the_old_lying_time(spark):
    moves = [(0, "suspected"), (0.5, "falling"), (1, "lying"), (2, "resolved"), (3, "lying")]
    e = final(run(spark, moves))[0]
    assert e.lying_started_at_seconds == 1.0


def test_second_lying_pushes_the_review(spark):
    moves = [(0, "suspected"), (0.5, "falling"), (1, "lying"), (1.5, "recovering"), (1.75, "falling"),
             (1.8, "lying")]
    log = run(spark, moves, step=0.05, last=400)
    assert [round(r.timestamp_seconds, 2) for r in E.review_ready(log).collect()] == [2.8]


@pytest.mark.parametrize("width", [2.0, 7.0])
def test_slices_do_not_change_events(spark, width):
    moves, t = [], 0.0
    for i in range(30):
        for s, d in (("suspected", 0.5), ("falling", 0.5), ("lying", 1.5), ("resolved", 0.5 + i % 9)):
            moves.append((t, s))
            t += d
    a, b = run(spark, moves, 600), run(spark, moves, 600, width=width)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0 and a.count() > 100


def test_keyframes_use_a_frame_once_and_look_at_the_ring_only(spark):
    p = EventParams(ring_buffer_frames=4)
    log = run(spark, [(0, "suspected"), (0.5, "falling"), (5, "lying"), (6, "recovering"), (7, "resolved")],
              last=60, p=p)
    from pyspark.sql import functions as F

    frames = spark.createDataFrame([frame_row(i, i * 0.5) for i in range(60)], FRAME).withColumns({
        "motion_score": (F.col("frame_id") == 9).cast("double"),
        "bbox": F.struct(*[F.lit(1.0).alias(c) for c in ("x1", "y1", "x2", "y2")])})
    review = E.review_ready(log).collect()[0]
    assert review.frame_id == 12
    for width in (None, 3.0):
        rows = E.select_keyframes(E.review_ready(log), frames, p, width).orderBy("role_order").collect()
        assert [(r.role, r.frame_id) for r in rows] == [("before", 9), ("during", 10), ("after", 12)]
    few = E.select_keyframes(E.review_ready(log), frames.filter("frame_id = 12"), p)
    assert [r.role for r in few.collect()] == ["before"]


def test_event_ids_are_repeatable(spark):
    moves = [(0, "suspected"), (0.5, "falling")]
    assert final(run(spark, moves))[0].event_id == final(run(spark, moves))[0].event_id
