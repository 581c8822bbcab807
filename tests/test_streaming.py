import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinewatch.operators import episodes as E
from kinewatch.params import TRACK, CascadeParams
from kinewatch.plans import cascade as C
from kinewatch.sources.writers import stream_events
from kinewatch.streaming.cascade import Cascade, frame_rows, read_kind, route, stream_cascade
from tests.makers import FRAME, OBS, random_video

P = CascadeParams()


@pytest.mark.parametrize("files", [1, 6])
def test_stream_equals_batch(spark, tmp_path, files):
    obs, frames = [], []
    for s in range(2):
        o, f = random_video(s, 80)
        obs, frames = obs + o, frames + f
    obs, frames = spark.createDataFrame(obs, OBS), spark.createDataFrame(frames, FRAME)
    rows = frame_rows(frames, obs).orderBy("timestamp_seconds").toPandas()
    step = len(rows) // files + 1
    for i in range(files):
        # files arrive in time order; the last one repeats an old frame
        part = rows.iloc[i * step:(i + 1) * step]
        path = tmp_path / "in"
        path.mkdir(exist_ok=True)
        part.to_parquet(path / f"{i}.parquet")
        os.utime(path / f"{i}.parquet", (1.7e9 + i, 1.7e9 + i))
    rows.iloc[:1].to_parquet(tmp_path / "in" / "late.parquet")
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (stream_cascade(source, P).writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    query.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).cache()
    moves = C.transitions_of(obs, frames, P).cache()
    log = E.fall_events(moves, frames, P.events).cache()
    cols = [*TRACK, "frame_id", "previous_state", "next_state", "reason"]
    got = out.filter("kind = 'transition'").select(*cols)
    assert got.exceptAll(moves.select(*cols)).count() == 0 and got.count() == moves.count() > 50
    both = out.filter("kind in ('change', 'review')").select(*log.columns)
    assert both.exceptAll(log).count() == 0 and both.count() == log.count()
    assert out.filter("kind = 'late'").count() == 1
    per = out.groupBy("source_id").agg({"out_seq": "max", "*": "count"}).collect()
    assert all(r["max(out_seq)"] == r["count(1)"] for r in per)


def test_stream_sink_by_kind(spark, tmp_path):
    obs, frames = random_video(3, 40)
    rows = frame_rows(spark.createDataFrame(frames, FRAME), spark.createDataFrame(obs, OBS))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    stream_events(stream_cascade(source, P), str(tmp_path / "out"), str(tmp_path / "ck"), "change").awaitTermination()
    back = spark.read.json(str(tmp_path / "out"))
    assert back.select("kind").distinct().count() == 1


class Held:
    """State in memory, for looking at what a processor keeps."""

    def __init__(self):
        self.value, self.map = None, {}

    def getValueState(self, *_):
        return self

    getMapState = getValueState

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def containsKey(self, key):
        return key in self.map

    def getValue(self, key):
        return self.map[key]

    def updateValue(self, key, value):
        self.map[key] = value

    def removeKey(self, key):
        del self.map[key]


def batch(start, tracks, name="standing", frames=4):
    rows = []
    for f in range(frames):
        obs = [{"track_id": i, "x1": 0, "y1": 0, "x2": 20, "y2": 60, "class_name": name} for i in tracks]
        rows.append(("a", "s", start * 10 + f, start * 10.0 + f, 640, 480, json.dumps(obs)))
    return pd.DataFrame(rows, columns=["source_id", "session_id", "frame_id", "timestamp_seconds", "frame_width", "frame_height", "obs"])


def test_state_stays_flat_over_new_tracks():
    """100 micro-batches, each with five new track ids: old ones are forgotten once nothing of theirs is open."""
    one, held, sizes, clock = Cascade(P, retention=60.0), Held(), [], []
    one.init(held)
    for b in range(100):
        list(one.handleInputRows(("a", "s"), iter([batch(b, range(5 * b, 5 * b + 5))]), None))
        sizes.append(len(held.map))
        clock.append(len(held.value[0]))
    assert max(sizes) == max(sizes[:12]) <= 5 * 8 and max(clock[50:]) <= max(clock[:50]) + 20
    kept = Cascade(P), Held()
    kept[0].init(kept[1])
    for b in range(20):
        list(kept[0].handleInputRows(("a", "s"), iter([batch(b, range(5 * b, 5 * b + 5))]), None))
    assert len(kept[1].map) == 100  # within the retention time all stay


def test_a_track_costs_one_read_and_one_write(monkeypatch):
    """A micro-batch of a scope reads and writes each track's row once, and asks for nothing else."""
    calls, (one, held) = [], (Cascade(P), Held())
    for name in ("getValue", "updateValue", "containsKey"):
        plain = getattr(Held, name)
        monkeypatch.setattr(Held, name, lambda self, *a, plain=plain, name=name: (calls.append(name), plain(self, *a))[1])
    one.init(held)
    list(one.handleInputRows(("a", "s"), iter([batch(0, range(3))]), None))
    assert sorted(calls) == ["updateValue"] * 3
    calls.clear()
    halves = batch(1, range(3))
    out = list(one.handleInputRows(("a", "s"), iter([halves[2:], halves[:2]]), None))  # pieces in any order
    assert sorted(calls) == ["getValue"] * 3 + ["updateValue"] * 3
    assert not any((x["kind"] == "late").any() for x in out)


def test_an_open_event_is_not_forgotten():
    one, held = Cascade(P, retention=5.0), Held()
    one.init(held)
    out = [next(one.handleInputRows(("a", "s"), iter([batch(b, [1], "falling") if b == 0 else batch(b, [100 + b])]), None)) for b in range(6)]
    rows = pd.concat([x for x in out if len(x)])
    assert {"transition", "change", "review"} <= set(rows["kind"])
    assert rows[(rows["kind"] == "change") & rows["end_time"].notna()]["track_id"].tolist() == [1]
    assert (1,) not in held.map  # its event has ended and was reviewed


def test_kinds_go_to_tables_of_their_own_and_scopes_expire(spark, tmp_path):
    """With wall-clock times a watermark clears scopes whose frames have ended; every kind is read back alone."""
    obs, frames = random_video(3, 60)
    rows = frame_rows(spark.createDataFrame(frames, FRAME), spark.createDataFrame(obs, OBS)).toPandas()
    rows["at"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(rows["timestamp_seconds"], unit="s")
    later = rows.copy()
    later["source_id"], later["at"] = "later", later["at"] + pd.Timedelta(days=1)
    (tmp_path / "in").mkdir()
    for i, part in enumerate((rows, later, later.iloc[-1:].assign(at=later["at"].max() + pd.Timedelta(days=1)))):
        part.to_parquet(tmp_path / "in" / f"{i}.parquet", coerce_timestamps="us")
        os.utime(tmp_path / "in" / f"{i}.parquet", (1.7e9 + i, 1.7e9 + i))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = stream_cascade(source, P, retention=60.0, event_time="at", lateness="1 hour")
    query = route(out, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    kept = [x["stateOperators"][0]["numRowsTotal"] for x in query.recentProgress if x["stateOperators"]]
    assert kept[-1] < kept[1]  # the first scope has gone
    folder = str(tmp_path / "out")
    moves = C.transitions_of(spark.createDataFrame(obs, OBS), spark.createDataFrame(frames, FRAME), P)
    got = {k: read_kind(spark, folder, k, out.schema) for k in ("transition", "change", "review", "late")}
    assert got["transition"].count() == 2 * moves.count() > 0
    assert got["late"].count() == 1 and got["late"].first().source_id == "later"
    assert got["review"].columns[:2] == got["change"].columns[:2]
    log = E.fall_events(moves, spark.createDataFrame(frames, FRAME), P.events)
    assert got["change"].filter(F.col("source_id") != "later").count() == log.filter("kind = 'change'").count()
