import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from kinewatch.operators import matching as MT
from kinewatch.params import MatchProtocol

IV = ("event_id string, source_id string, session_id string, track_id int, start_time double, "
      "end_time double, ord int")


def table(spark, rows, prefix):
    return spark.createDataFrame(
        [(f"{prefix}{i}", "a", s, k, a, b, i) for i, (s, k, a, b) in enumerate(rows)], IV)


def iou(a, b):
    hull = max(a[3], b[3]) - min(a[2], b[2])
    return max(0.0, min(a[3], b[3]) - max(a[2], b[2])) / hull if hull > 0 else 0.0


def greedy(truth, pred, p):
    cand = []
    for i, g in enumerate(truth):
        for j, q in enumerate(pred):
            if g[0] != q[0]:
                continue
            if p.same_track and g[1] is not None and q[1] is not None and g[1] != q[1]:
                continue
            checks = []
            if p.temporal_iou_min is not None:
                checks.append(iou(g, q) >= p.temporal_iou_min)
            if p.start_tolerance is not None:
                checks.append(abs(q[2] - g[2]) <= p.start_tolerance)
            if all(checks) if p.rule == "and" else any(checks):
                cand.append((-iou(g, q), abs(q[2] - g[2]), i, j))
    used_g, used_p, out = set(), set(), set()
    for _, _, i, j in sorted(cand):
        if i not in used_g and j not in used_p:
            used_g.add(i)
            used_p.add(j)
            out.add((f"g{i}", f"p{j}"))
    return out, {(f"g{i}", f"p{j}") for _, _, i, j in cand}


# coarse numbers, so that ties are common
TIMES = st.integers(0, 20).map(lambda x: x / 4)
ROW = st.tuples(st.sampled_from(["s", "t"]), st.sampled_from([None, 0, 1]), TIMES,
                st.sampled_from([0.25, 0.5, 1.0, 3.0, 12.0])).map(lambda r: (r[0], r[1], r[2], r[2] + r[3]))
PROTOCOLS = st.builds(
    MatchProtocol, st.sampled_from([0.0, 0.1, 0.3, 0.7]), st.sampled_from([None, 0.0, 0.5, 2.0]),
    st.sampled_from(["and", "or"]), st.booleans())


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(ROW, min_size=1, max_size=10), st.lists(ROW, min_size=1, max_size=10), PROTOCOLS)
def test_matches_equal_global_greedy(spark, truth, pred, p):
    g, q = table(spark, truth, "g"), table(spark, pred, "p")
    want, pairs = greedy(truth, pred, p)
    cols = ["ground_truth_id", "predicted_id"]
    got = [tuple(r) for r in MT.event_match_candidates(g, q, p).select(*cols).collect()]
    assert sorted(got) == sorted(pairs)  # every pair once
    assert {tuple(r) for r in MT.match_events(g, q, p).select(*cols).collect()} == want


def test_only_a_start_tolerance(spark):
    p = MatchProtocol(None, 0.5)
    truth, pred = [("s", None, 0.0, 1.0)], [("s", 3, 0.5, 9.0), ("s", 3, 0.6, 9.0)]
    got = MT.event_match_candidates(table(spark, truth, "g"), table(spark, pred, "p"), p).collect()
    assert [r.predicted_id for r in got] == ["p0"]


def test_metrics_and_missing_inputs(spark):
    truth = [("s", 0, 1.0, 3.0), ("s", 0, 10.0, 12.0)]
    pred = [("s", 0, 1.2, 3.0), ("s", 0, 10.1, 12.0), ("s", 0, 20.0, 21.0)]
    m = MT.event_metrics(table(spark, truth, "g"), table(spark, pred, "p"), MatchProtocol(), 0.5).first()
    assert (m.true_positive_events, m.false_positive_events, m.false_negative_events) == (2, 1, 0)
    assert m.false_alarms_per_hour == 2.0 and m.specificity is None
    assert m.specificity_unavailable_reason == "negative event windows were not defined"
    assert m.mean_detection_delay_seconds == pytest.approx(0.15)
    win = table(spark, [("s", 0, 20.5, 22.0), ("s", 0, 30.0, 31.0)], "w")
    m = MT.event_metrics(table(spark, truth, "g"), table(spark, pred, "p"), MatchProtocol(), None, win).first()
    assert m.specificity == 0.5 and m.false_alarms_per_hour is None
    none = MT.window_specificity(win.limit(0), table(spark, pred, "p")).first()
    assert none.specificity is None and none.specificity_unavailable_reason is None
    with pytest.raises(ValueError):
        MT.event_metrics(win, win, MatchProtocol(), 0.0)
    with pytest.raises(ValueError):
        MatchProtocol(None, None)


@pytest.mark.parametrize("width", [None, 0.5, 3.0])
def test_window_hits_equal_all_pairs(spark, width):
    rng = random.Random(3)

    def make(n):
        out = []
        for _ in range(n):
            a = rng.randrange(0, 80) / 4
            out.append((rng.choice("st"), None, a, a + rng.choice([0.25, 0.5, 6.0])))
        return out

    win, pred = make(60), make(25)
    want = {f"w{i}" for i, w in enumerate(win)
            if any(w[0] == q[0] and q[2] < w[3] and w[2] < q[3] for q in pred)}
    got = MT.negative_window_hits(table(spark, win, "w"), table(spark, pred, "p"), width)
    assert {r.event_id for r in got.collect()} == want


def jobs_of(spark, name, work):
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    out = work()
    sc.setLocalProperty("spark.jobGroup.id", None)
    return len(sc.statusTracker().getJobIdsForGroup(name)), out


def test_a_chain_of_better_and_better_pairs_takes_no_more_jobs(spark):
    """Each pair blocks the one before it, so rounds of mutual best pairs would need one round for each link."""
    def chain(n):
        at, truth, pred = 0.0, [], []
        for i in range(n):  # lengths grow, so every interval fits the next one better than the last
            size = 10.0 + i * 0.5
            (truth if i % 2 == 0 else pred).append(("s", 0, at, at + size))
            at += 3.0
        return truth, pred

    counts = []
    for n in (4, 90):
        truth, pred = chain(n)
        want, pairs = greedy(truth, pred, MatchProtocol(0.3, None))
        assert len(pairs) >= n - 1
        count, got = jobs_of(spark, f"chain{n}", lambda: MT.match_events(  # noqa: B023
            table(spark, truth, "g"), table(spark, pred, "p"), MatchProtocol(0.3, None)).collect())  # noqa: B023
        counts.append(count)
        assert {(r.ground_truth_id, r.predicted_id) for r in got} == want
    assert abs(counts[0] - counts[1]) <= 1  # a broadcast more or less


def test_islands_on_slices(spark, monkeypatch):
    from kinewatch.operators import slices

    rng = random.Random(4)
    rows = lambda n: [("s", rng.choice([0, 1]), t, t + rng.choice([0.5, 2.0, 4.0])) for t in (rng.uniform(0, 300) for _ in range(n))]
    truth, pred = rows(150), rows(150)
    monkeypatch.setattr(slices, "MAX_GROUP_ROWS", 25)
    want, _ = greedy(truth, pred, MatchProtocol())
    got = MT.match_events(table(spark, truth, "g"), table(spark, pred, "p"), MatchProtocol()).collect()
    assert {(r.ground_truth_id, r.predicted_id) for r in got} == want
