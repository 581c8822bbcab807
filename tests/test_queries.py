"""Every registered query against its SQL, and the driver's entry point."""

import pytest

import __spark_entry__ as entry
from kinewatch.operators import motion, slices
from kinewatch.plans import queries as plans
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert difference(df, con, sql) is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["previous_state", "next_state", "transitions"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


SLICED = ["temporal_features", "smooth_features", "monotonicity_violations", "track_expiry",
          "motion_states_with_expiry", "repair_timestamps", "fall_events", "review_ready",
          "select_keyframes", "negative_window_hits"]


@pytest.mark.parametrize("name", SLICED)
def test_query_on_slices(spark, con, name, monkeypatch):
    """The same rows when even small keys are cut into slices."""
    monkeypatch.setattr(slices, "MAX_GROUP_ROWS", 20)
    df = entry.queries()[name](spark, SF)
    assert difference(df, con, entry.oracle_sql()[name]) is None


@pytest.mark.parametrize("limit", [None, 20])
@pytest.mark.parametrize("name", ["burst_transitions", "burst_features"])
def test_tracks_of_a_large_camera(spark, con, monkeypatch, name, limit):
    """Tracks that a count shows to be small stay whole in a camera that is cut; larger ones are cut too."""
    cuts = []
    for module in (motion, slices):
        monkeypatch.setattr(module, "place", lambda df, *args, place=module.place: cuts.append(df.columns) or place(df, *args))
    if limit:
        monkeypatch.setattr(plans, "BURST_LIMIT", limit)
    df = entry.queries()[name](spark, SF)
    assert difference(df, con, entry.oracle_sql()[name]) is None
    assert any("track_id" in columns for columns in cuts) == bool(limit)
