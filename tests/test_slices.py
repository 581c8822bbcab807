"""Slices that follow where the rows of a key lie."""

import random

import pytest
from pyspark.sql import functions as F

from kinewatch.operators import slices as SL

KEYS = ["source_id", "session_id"]


def largest(rows, found):
    placed = SL.place(rows, F.col("timestamp_seconds"), found)
    return placed.groupBy(*KEYS, "_slice").agg(F.count("*").alias("n"), F.min("timestamp_seconds").alias("a"), F.max("timestamp_seconds").alias("b"))


def cam(spark, n, time, source="a"):
    return spark.range(n).select(F.lit(source).alias("source_id"), F.lit("s").alias("session_id"), time.cast("double").alias("timestamp_seconds"))


def test_a_burst_in_an_idle_key_is_cut(spark):
    """199,999 of 200,000 rows lie within 20 s of eleven days: no slice is over the limit, none shorter than allowed."""
    i = F.col("id")
    rows = cam(spark, 200_000, F.when(i == 0, F.lit(0.0)).otherwise(1e6 + i / 10_000)).unionByName(cam(spark, 1000, i, "b"))
    found = SL.plan_slices([rows], KEYS)
    got = largest(rows, found).collect()
    assert max(r["n"] for r in got) <= SL.MAX_GROUP_ROWS and len(got) > 4
    assert [r["_slice"] for r in got if r["source_id"] == "b"] == [0]
    widths = [p["width"] for r in found.pieces.collect() for p in r["_pieces"]]
    assert min(widths) >= SL.SHORTEST_SECONDS


def test_frames_and_observations_are_counted_together(spark):
    i = F.col("id")
    obs, frames = cam(spark, 400, i / 40), cam(spark, 30_000, i / 10)
    assert SL.plan_slices([obs], KEYS, limit=1000) is None
    found = SL.plan_slices([obs, frames], KEYS, limit=1000)
    assert largest(frames, found).agg(F.max("n")).first()[0] <= 1000


@pytest.mark.parametrize("seed", range(3))
def test_slices_are_ordered_and_within_the_limit(spark, seed):
    """Bursts of any shape: numbers never fall along time; a slice over the limit is as short as allowed."""
    rng = random.Random(seed)
    times = [rng.uniform(0, 5000) for _ in range(2000)]
    for _ in range(6):
        at, length = rng.uniform(0, 5000), rng.choice([0.01, 0.5, 3, 40])
        times += [at + rng.uniform(0, length) for _ in range(3000)]
    rows = spark.createDataFrame([("a", "s", t) for t in times], "source_id string, session_id string, timestamp_seconds double")
    found = SL.plan_slices([rows], KEYS, limit=1000)
    got = sorted(largest(rows, found).collect(), key=lambda r: r["_slice"])
    assert all(x["b"] < y["a"] for x, y in zip(got, got[1:]))
    for r in got:
        assert r["n"] <= 1000 or r["b"] - r["a"] < 2 * SL.SHORTEST_SECONDS + 1e-6


def test_running_values_on_slices(spark):
    rng = random.Random(9)
    data = [("a", "s", float(t), rng.choice([None, t])) for t in [*range(0, 400, 7), *range(400, 900)]]
    rows = spark.createDataFrame(data, "source_id string, session_id string, timestamp_seconds double, v long")
    found = SL.plan_slices([rows], KEYS, limit=50)
    for how in ("last", "max", "sum"):
        for down in (False, True):
            args = dict(order="timestamp_seconds", values={"r": (how, F.col("v"))}, descending=down)
            plain, cut = SL.carry(rows, KEYS, **args), SL.carry(rows, KEYS, width=found, **args)
            assert sorted(map(tuple, plain.collect()), key=repr) == sorted(map(tuple, cut.select(plain.columns).collect()), key=repr)
