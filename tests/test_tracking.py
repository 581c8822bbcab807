import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinewatch.operators import tracking as TR
from kinewatch.operators.geometry import restore_posture
from kinewatch.params import TrackingParams
from tests.makers import FRAME, frame_row

DET = ("source_id string, session_id string, frame_id long, detection_id string, x1 double, y1 double, "
       "x2 double, y2 double, confidence double, class_name string")


def det(f, i, box, name="standing", score=0.9, source="a"):
    return (source, "s", f, i, *map(float, box), score, name)


def test_id_survives_posture_change_and_a_short_gap(spark):
    rows = [det(0, "d0", (10, 10, 30, 90)), det(1, "d1", (11, 10, 31, 90), "falling"),
            det(3, "d2", (12, 10, 32, 90), "lying"), det(0, "d3", (200, 10, 230, 90)),
            det(0, "e0", (10, 10, 30, 90), source="b"), det(60, "d4", (12, 10, 32, 90))]
    df = spark.createDataFrame(rows, DET)
    out = restore_posture(TR.associate_tracks(df), df)
    ids = {r.detection_id: r.track_id for r in out.collect()}
    assert ids["d0"] == ids["d1"] == ids["d2"] and ids["d3"] != ids["d0"]
    assert ids["d4"] != ids["d0"]  # lost for longer than the buffer
    names = {r.detection_id: r.class_name for r in out.collect()}
    assert names["d1"] == "falling" and len(ids) == 6


def test_weak_detections_continue_but_never_start_a_track(spark):
    df = spark.createDataFrame([det(0, "w", (300, 10, 330, 90), score=0.15), det(0, "a", (10, 10, 30, 90)),
                                det(1, "b", (10, 10, 30, 90), score=0.15)], DET)
    ids = {r.detection_id: r.track_id for r in TR.associate_tracks(df).collect()}
    assert set(ids) == {"a", "b"} and ids["a"] == ids["b"]


@pytest.mark.parametrize("params, width", [
    (TrackingParams(lost_track_buffer=8), 20), (TrackingParams(lost_track_buffer=5, minimum_consecutive_frames=3), 25)])
def test_slices_give_the_sequential_result(spark, params, width):
    rng, rows, n = random.Random(5), [], 0
    for cam in ("a", "b"):
        people = [[rng.uniform(0, 500), rng.uniform(0, 300), rng.uniform(-6, 6), rng.uniform(-4, 4)] for _ in range(4)]
        for f in range(160):
            if cam == "b" and 60 < f < 80:
                continue
            for p in people:
                p[0], p[1] = (p[0] + p[2]) % 600, (p[1] + p[3]) % 400
                if rng.random() < 0.15:
                    continue
                n += 1
                rows.append(det(f, f"d{n:06d}", (p[0], p[1], p[0] + 60 + rng.random() * 5, p[1] + 90),
                                score=rng.choice([0.2, 0.6, 0.9]), source=cam))
    df = spark.createDataFrame(rows, DET).cache()
    one, cut = TR.associate_tracks(df, params).cache(), TR.associate_tracks(df, params, width).cache()
    assert one.count() == cut.count() > 500
    assert one.exceptAll(cut).count() == 0


@pytest.mark.parametrize("fps", [8.0, 2.0, None])
def test_repaired_times_equal_a_loop(spark, fps):
    rng = random.Random(11)
    frames, want, last = [], {}, -1.0
    for f in range(300):
        t = rng.choice([f / 5, f / 5, f / 5, f / 5 - 1.0, 0.0, f / 5 + (3.0 if f % 50 == 0 else 0)])
        frames.append(frame_row(f, t))
        if not t > last and fps:
            t = f / fps
        if t > last:
            want[f], last = t, t
    df = spark.createDataFrame(frames, FRAME)
    for width in (None, 7, 100):
        good, bad = TR.repair_timestamps(df, fps, width)
        assert {r.frame_id: r.timestamp_seconds for r in good.collect()} == want
        assert bad.count() == 300 - len(want)
    assert good.filter(F.col("timestamp_seconds").isNull()).count() == 0


def test_cascade_from_untracked_detections(spark, monkeypatch):
    from kinewatch.operators import slices
    from kinewatch.plans.cascade import run_cascade
    from tests.makers import OBS, random_video

    obs, frames = random_video(2, 120)
    detections = spark.createDataFrame(obs, OBS).drop("track_id")
    frames = spark.createDataFrame(frames, FRAME)
    plain = run_cascade(frames, detections, level="temporal").transitions.cache()
    assert plain.count() > 0
    monkeypatch.setattr(slices, "MAX_GROUP_ROWS", 60)
    cut = run_cascade(frames, detections, level="temporal").transitions
    assert plain.exceptAll(cut).count() == 0 and cut.count() == plain.count()


def test_crowded_frames_and_large_frame_ids():
    """20,000 boxes a frame, frame ids as epoch microseconds: every box keeps its track, names differ."""
    n, start = 20_000, 1_700_000_000_000_000
    x, y = np.arange(n) % 200 * 10.0, np.arange(n) // 200 * 10.0
    boxes = np.stack([x, y, x + 8, y + 8], axis=1)
    one = TR.Associator(TR.TrackingParams())
    first = one.step(start, boxes, np.full(n, 0.9))
    assert len(set(first)) == n and (first >= 0).all()
    assert (one.step(start + 1, boxes + 0.2, np.full(n, 0.9)) == first).all()


def test_blocks_find_the_pairs_of_the_whole_matrix(monkeypatch):
    rng = np.random.default_rng(3)
    corner = rng.uniform(0, 60, (80, 2))
    boxes = np.hstack([corner, corner + rng.uniform(1, 30, (80, 2))])
    one, weight = TR.Associator(TR.TrackingParams()), rng.uniform(0.2, 1, 50)
    one.boxes = boxes[:30]
    for limit in (0.5, 0.8, 1.0):
        cost = 1.0 - one._iou(boxes[:30], boxes[30:]) * weight[None, :]
        monkeypatch.setattr(TR, "CELLS", 200)
        got = one._near(np.arange(30), boxes[30:], weight, limit)
        assert sorted(zip(*got)) == sorted((r, c, cost[r, c]) for r, c in zip(*np.nonzero(cost <= limit)))


def plain_best(gain: dict) -> float:
    """Largest total over all ways to pair rows with columns or leave them alone."""
    rows, cols = sorted({r for r, _ in gain}), sorted({c for _, c in gain})
    return max(sum(gain.get((r, c), 0.0) for r, c in zip(rows, way))
               for way in itertools.permutations([*cols, *[-1] * len(rows)], len(rows)))


def test_pairs_are_the_best_in_total():
    rng = random.Random(7)
    for turn in range(150):
        n, m = rng.randint(1, 4), rng.randint(1, 4)
        edges = [(r, c) for r in range(n) for c in range(m) if rng.random() < 0.7] or [(0, 0)]
        gain = {e: rng.choice([0.25, 0.5, 0.75, rng.random()]) for e in edges}
        r, c = TR.best_pairs(np.array([e[0] for e in edges]), np.array([e[1] for e in edges]), np.array([gain[e] for e in edges]))
        assert len(set(r)) == len(r) and len(set(c)) == len(c) and set(zip(r.tolist(), c.tolist())) <= set(edges)
        assert sum(gain[e] for e in zip(r.tolist(), c.tolist())) == pytest.approx(plain_best(gain), abs=1e-9), turn


def dual_bound(r, c, gain, n, m, rounds=3000):
    """An upper bound of any total, from prices: sum of prices and of each row's best gain after its column's price."""
    price, best = np.zeros(m), np.inf
    for k in range(rounds):
        left = np.zeros(n)
        np.maximum.at(left, r, gain - price[c])
        best = min(best, left.sum() + price.sum())
        pick = np.array([i for i in np.flatnonzero(gain - price[c] == left[r]) if left[r[i]] > 0], int)
        pick = pick[np.unique(r[pick], return_index=True)[1]]
        over = np.bincount(c[pick], minlength=m) - 1.0
        price = np.maximum(0, price + over * 0.5 / (k + 5))
    return best


def test_many_crossing_edges_reach_the_dual_bound():
    rng = np.random.default_rng(4)
    n = m = 60
    r, c = np.nonzero(rng.random((n, m)) < 0.1)
    gain = rng.random(len(r))
    pr, pc = TR.best_pairs(r, c, gain)
    at = {(a, b): g for a, b, g in zip(r.tolist(), c.tolist(), gain.tolist())}
    total = sum(at[e] for e in zip(pr.tolist(), pc.tolist()))
    bound = dual_bound(r, c, gain, n, m)
    assert total <= bound + 1e-9 and bound - total < 0.02 * bound


def test_a_frame_where_the_nearest_pair_first_would_lose_a_track(spark):
    """Track a overlaps both new boxes, b only the one that a fits best: taking a's best first leaves b alone."""
    rows = [det(0, "a0", (0, 0, 100, 100)), det(0, "b0", (52, 0, 152, 100)),
            det(1, "x", (25, 0, 125, 100)), det(1, "y", (-30, 0, 70, 100))]
    one = TR.Associator(TrackingParams())
    boxes = lambda f: np.array([r[4:8] for r in rows if r[2] == f])
    one.step(0, boxes(0), np.full(2, 0.9))
    cost = 1 - one._iou(boxes(0), boxes(1)) * 0.9
    assert cost[0, 0] == cost.min() and cost[1, 1] > 0.8 and cost[0, 1] <= 0.8
    ids = {r.detection_id: r.track_id for r in TR.associate_tracks(spark.createDataFrame(rows, DET)).collect()}
    assert ids["y"] == ids["a0"] and ids["x"] == ids["b0"]


def test_a_crowd_of_overlapping_boxes():
    """20,000 boxes that overlap their neighbours and move: a frame is one large component and still done."""
    rng = np.random.default_rng(8)
    n = 20_000
    x, y = np.arange(n) % 200 * 10.0, np.arange(n) // 200 * 10.0
    boxes = np.stack([x, y, x + 13, y + 13], axis=1)
    one = TR.Associator(TrackingParams())
    first = one.step(0, boxes, np.full(n, 0.9))
    moved = boxes + rng.uniform(-1.5, 1.5, (n, 1))
    assert (one.step(1, moved, np.full(n, 0.9)) == first).mean() > 0.99


def test_a_path_costs_what_it_touches(monkeypatch):
    """A long chain is one component; the columns are laid out once, not once for each row."""
    n, calls, plain = 3000, [], np.full
    rows, cols = np.repeat(np.arange(n), 2), np.stack([np.arange(n), np.arange(n) + 1], 1).ravel()
    monkeypatch.setattr(np, "full", lambda *a, **k: (calls.append(a), plain(*a, **k))[1])
    r, c = TR.best_pairs(rows, cols, np.tile([0.5, 0.6], n))
    assert (r == np.arange(n)).all() and (c == r + 1).all()
    assert len(calls) < 20


def test_pairs_between_kinds_are_as_good_as_between_members():
    rng = np.random.default_rng(6)
    for turn in range(60):
        row_kind = rng.permutation(np.r_[np.arange(4), rng.integers(0, 4, rng.integers(0, 25))])
        col_kind = rng.permutation(np.r_[np.arange(5), rng.integers(0, 5, rng.integers(0, 25))])
        r, c = np.nonzero(rng.random((4, 5)) < 0.6)
        gain = rng.choice([0.25, 0.5, 0.75, rng.random()], len(r))
        if not len(r):
            continue
        at = {(a, b): g for a, b, g in zip(r.tolist(), c.tolist(), gain.tolist())}
        edges = [(i, j, at[a, b]) for i, a in enumerate(row_kind.tolist()) for j, b in enumerate(col_kind.tolist()) if (a, b) in at]
        pr, pc = TR.best_pairs(r, c, gain, row_kind, col_kind)
        assert len(set(pr)) == len(pr) and len(set(pc)) == len(pc)
        got = sum(at[e] for e in zip(row_kind[pr].tolist(), col_kind[pc].tolist()))
        n, m = len(row_kind), len(col_kind)
        plain = [np.array(x) for x in zip(*edges)] or [np.zeros(0, int)] * 3
        qr, qc = TR.best_pairs(*plain)
        every = {(i, j): g for i, j, g in edges}
        want = sum(every[e] for e in zip(qr.tolist(), qc.tolist()))
        assert got == pytest.approx(want, abs=1e-9) and (not edges or want <= dual_bound(*plain, n, m, 200) + 1e-9), turn


def test_copies_of_boxes_meet_as_kinds(monkeypatch):
    """50 places with 40 equal boxes each: pairs are found between places, and every copy goes on as a track."""
    counts, plain = [], TR.best_pairs
    monkeypatch.setattr(TR, "best_pairs", lambda r, *rest: (counts.append(len(r)), plain(r, *rest))[1])
    x = np.repeat(np.arange(50) * 4.0, 40)
    boxes = np.stack([x, x * 0, x + 20, x * 0 + 20], axis=1)
    one = TR.Associator(TrackingParams())
    first = one.step(0, boxes, np.full(2000, 0.9))
    again = one.step(1, boxes[::-1], np.full(2000, 0.9))
    assert sorted(first) == sorted(again) and len(set(first)) == 2000
    assert max(counts) <= 50 * 50


def test_boxes_far_below_a_block_are_not_compared(monkeypatch):
    """Boxes in one column of the picture: a block meets those at its height."""
    cells, plain = [], TR.Associator._iou
    monkeypatch.setattr(TR.Associator, "_iou", staticmethod(lambda a, b: (cells.append(len(a) * len(b)), plain(a, b))[1]))
    y = np.arange(3000) * 5.0
    boxes = np.stack([y * 0, y, y * 0 + 50, y + 20], axis=1)
    one = TR.Associator(TrackingParams())
    first = one.step(0, boxes, np.full(3000, 0.9))
    assert (one.step(1, boxes, np.full(3000, 0.9)) == first).all()
    assert sum(cells) < 3000 * 300


def test_a_busy_scope_of_few_frames_is_not_cut(spark, monkeypatch):
    from kinewatch.operators import slices

    monkeypatch.setattr(slices, "MAX_GROUP_ROWS", 20)
    rows = [det(f, f"{f}-{k}", (k * 50, 0, k * 50 + 40, 40)) for f in range(7) for k in range(10)]
    assert TR.association_width(spark.createDataFrame(rows, DET)) is None
    rows += [det(f, f"{f}-{k}", (k * 50, 0, k * 50 + 40, 40)) for f in range(60, 90) for k in range(10)]
    assert TR.association_width(spark.createDataFrame(rows, DET)) is not None
