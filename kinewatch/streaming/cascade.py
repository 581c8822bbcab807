"""The cascade on a stream: one state per scope, frames in, state changes, events and reviews out."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from kinewatch.operators.automaton import evidence_of, reason_text, step
from kinewatch.operators.episodes import event_id
from kinewatch.operators.lifecycle import LIFECYCLE_COLUMNS, LIFECYCLE_TYPES, Episodes, Mark
from kinewatch.operators.motion import FIRST_ELAPSED
from kinewatch.params import RESOLVED, SCOPE, STATES, TRACK, UPRIGHT, CascadeParams

#: State before, state after, reason.
Change = tuple[str, str, str]
#: Seconds of a scope's own clock after which an unseen track with nothing open is forgotten.
RETENTION = 3600.0

OUTPUT = ("source_id string, session_id string, track_id long, out_seq long, " + LIFECYCLE_TYPES
          + ", previous_state string, next_state string, reason string")
FRAME_COLUMNS = ["timestamp_seconds", "frame_id", "frame_height", "obs"]
OUT_COLUMNS = [*TRACK, "out_seq", *LIFECYCLE_COLUMNS, "previous_state", "next_state", "reason"]


def frame_rows(frames: DataFrame, obs: DataFrame) -> DataFrame:
    """One row per frame with its observations (possibly none), the stream's input shape."""
    seen = F.struct("track_id", "x1", "y1", "x2", "y2", "class_name")
    packed = obs.groupBy(*SCOPE, "frame_id").agg(F.to_json(F.collect_list(seen)).alias("obs"))
    return frames.select(*SCOPE, "frame_id", "timestamp_seconds", "frame_width", "frame_height").join(
        packed, [*SCOPE, "frame_id"], "left").withColumn("obs", F.coalesce("obs", F.lit("[]")))


def in_time(frame: tuple) -> tuple:
    """Sorts frames by time and number, those without a time last."""
    return (frame[0] != frame[0], *frame[:2])


class TrackState:
    """Last observation, short feature history, automaton state and events of one track."""

    def __init__(self, params: CascadeParams, saved: dict | None = None) -> None:
        self.p = params
        saved = saved or {}
        self.last = saved.get("last")
        self.history = saved.get("history", [])
        self.state = saved.get("state", UPRIGHT)
        self.entered = saved.get("entered", 0.0)
        self.episodes = (Episodes.load(params.events, saved["episodes"]) if saved
                         else Episodes(params.events))

    def dump(self) -> str:
        return json.dumps({"last": self.last, "history": self.history, "state": self.state,
                           "entered": self.entered, "episodes": self.episodes.dump()})

    def observe(self, o: dict, frame: dict) -> Change | None:
        """Feeds one observation; returns (before, after, reason) on a state change."""
        th, t = self.p.thresholds, frame["t"]
        w, h = o["x2"] - o["x1"], o["y2"] - o["y1"]
        center = (o["y1"] + o["y2"]) / 2.0
        aspect, speed, elapsed = w / h if h else 0.0, 0.0, FIRST_ELAPSED
        if self.last is None:
            self.entered = t
        else:
            elapsed = t - self.last["t"]
            speed = ((center - self.last["center"]) / frame["height"]) / elapsed
            self.history = [*self.history, [aspect, speed]][-th.smoothing_window:]
            aspect = sum(x[0] for x in self.history) / len(self.history)
            speed = sum(x[1] for x in self.history) / len(self.history)
        self.last = {"t": t, "center": center}
        return self.move(o["class_name"].lower(), aspect, speed, t)

    def move(self, name: str, aspect: float, speed: float, t: float) -> Change | None:
        th, g = self.p.thresholds, self.p.groups
        found = {"speed": speed >= th.vertical_speed_min, "falling": name in g.fall}
        trigger = [s for s, on in found.items() if on]
        lying = name in g.lying
        fall = bool(trigger) or lying or aspect >= th.aspect_ratio_fall_min
        upright = name in g.upright and aspect <= th.upright_aspect_ratio_max
        return self.take({"expired": False, "trigger": bool(trigger), "fall": fall, "upright": upright, "lying": lying}, t,
                         t - self.entered, trigger)

    def expire(self, t: float) -> Change | None:
        gone = dict.fromkeys(("trigger", "fall", "upright", "lying"), False) | {"expired": True}
        return self.take(gone, t, t - self.last["t"], [])

    def take(self, signals: dict[str, bool], t: float, seconds: float, trigger: list[str]) -> Change | None:
        """Follows the edge of the automaton that the signals open."""
        edge = step(self.state, evidence_of(signals, t - self.entered, self.p.thresholds))
        if edge is None:
            return None
        self.state, self.entered = edge.target, t
        return STATES[edge.source], STATES[edge.target], reason_text(edge, seconds, trigger)

    def done(self, t: float) -> bool:
        """Whether nothing of this track is open any more: no event runs or waits for its review, and none can be merged with or suppressed."""
        e, p = self.episodes.event, self.p.events
        if self.episodes.active or self.episodes.pending or self.state not in (UPRIGHT, RESOLVED):
            return False
        return e is None or (e.reviewed and t - e.end_time > max(p.merge_gap, p.cooldown))


class Cascade(StatefulProcessor):
    """State per scope: a clock row, and one row per track, so a long stream stays in small pieces.

    The rows of tracks unseen for the retention time go, unless an event of theirs is open; an id that returns
    later starts afresh. With an event-time column a timer also clears a scope whose frames have ended.
    """

    def __init__(self, params: CascadeParams, retention: float = RETENTION, event_time: str | None = None) -> None:
        self.params, self.retention, self.event_time = params, retention, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "saved string")
        self.tracks = handle.getMapState("tracks", "track_id long", "saved string")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer: Any
                        ) -> Iterator[pd.DataFrame]:
        saved = json.loads(self.clock.get()[0]) if self.clock.exists() else {}
        last, seq = saved.get("last"), saved.get("seq", 0)
        live = dict.fromkeys(saved.get("live", []))  # tracks in view or with an open event
        idle = {int(i): t for i, t in saved.get("idle", {}).items()}  # the others, by the time they left, oldest first
        stored = {*live, *idle}  # the tracks that have a row; asking for each costs a round trip
        loaded: dict[int, TrackState] = {}
        out: list[tuple] = []

        def track(i: int) -> TrackState:
            if i not in loaded:
                old = self.tracks.getValue((i,)) if i in stored else None
                loaded[i] = TrackState(self.params, json.loads(old[0]) if old else None)
            return loaded[i]

        def put(i: int, values: list) -> None:
            nonlocal seq
            seq += 1
            out.append((*key, i, seq, *values))

        def changed(i: int, change: Change | None, frame: dict) -> None:
            if change is None:
                return
            blank = [None] * (len(LIFECYCLE_COLUMNS) - 4)
            put(i, ["transition", None, frame["id"], frame["t"], *blank, *change])
            track(i).episodes.transition(Mark(frame["id"], frame["t"], change[2]), change[1])

        # plain lists: with many scopes of a few frames each, tables of their own would cost more than the frames
        parts = [pdf for pdf in rows if len(pdf)]
        table = sorted(((t, n, h, obs) for pdf in parts for t, n, h, obs in zip(*[pdf[c].tolist() for c in FRAME_COLUMNS])), key=in_time)
        for t, n, height, seen in table:
            frame = {"id": int(n), "t": float(t), "height": float(height)}
            if last is not None and frame["t"] <= last:
                put(None, ["late", None, frame["id"], frame["t"]]
                    + [None] * (len(OUT_COLUMNS) - 8))
                continue
            last = frame["t"]
            present = set()
            for o in json.loads(seen):
                i = int(o["track_id"])
                present.add(i)
                live[i] = None
                idle.pop(i, None)
                changed(i, track(i).observe(o, frame), frame)
            for i in list(live):
                one = track(i)
                gone = i not in present and (
                    frame["t"] - one.last["t"] > self.params.thresholds.track_timeout)
                if gone:
                    changed(i, one.expire(frame["t"]), frame)
                one.episodes.on_frame(frame["id"], frame["t"])
                for log in one.episodes.out:
                    put(i, [*log, None, None, None])
                one.episodes.out = []
                if gone and not one.episodes.active:
                    del live[i]
                    idle[i] = frame["t"]
        for i, left in list(idle.items()):
            if last - left <= self.retention:
                break  # those after it left later
            if track(i).done(last):
                del idle[i], loaded[i]
                if i in stored:
                    self.tracks.removeKey((i,))
        for i, one in loaded.items():
            self.tracks.updateValue((i,), (one.dump(),))
        self.clock.update((json.dumps({"last": last, "seq": seq, "live": list(live), "idle": idle}),))
        self.handle_timer(parts)
        yield self.output(out)

    def handle_timer(self, parts: list[pd.DataFrame]) -> None:
        """One timer for each scope: the retention time after its newest frame."""
        if not self.event_time:
            return
        at = int(max(pdf[self.event_time].max() for pdf in parts).timestamp() * 1000 + self.retention * 1000)
        pending = list(self.handle.listTimers())
        if pending and max(pending) >= at:
            return
        for t in pending:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """The scope is over: its clock and tracks go. Events still open then have no frame that could end them."""
        self.clock.clear()
        self.tracks.clear()
        yield self.output([])

    @staticmethod
    def output(rows: list[tuple]) -> pd.DataFrame:
        # objects as they are: whole numbers stay whole beside nulls, and Arrow gives every column its type
        return pd.DataFrame(rows, columns=OUT_COLUMNS, dtype=object)


def stream_cascade(rows: DataFrame, params: CascadeParams = CascadeParams(), retention: float = RETENTION,
                   event_time: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """Continuous cascade over frame rows; kinds are transition, change, review and late.

    Unseen tracks are kept for `retention` seconds of their scope. `event_time` names a timestamp column of wall-clock
    time: its watermark then clears scopes without frames for as long, and rows later than `lateness` are left out.

    Times that do not increase come back as `late` rows. `out_seq` numbers the output of a scope
    without gaps and survives restarts, so a sink can drop repeats.
    """
    if event_time:
        rows = rows.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, lateness)
    out = rows.groupBy(*SCOPE).transformWithStateInPandas(
        Cascade(params, retention, event_time), outputStructType=OUTPUT, outputMode="Append",
        timeMode="EventTime" if event_time else "None")
    return out.withColumn("event_id", F.when(F.col("start_frame").isNotNull(), event_id(TRACK)))


KINDS = ("transition", "change", "review", "late")


def route(out: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Sends each kind of rows to a table of its own, all kinds of a micro-batch together.

    A batch writes below its own number and replaces what an attempt that failed has left there, so a repeated batch
    changes nothing; `read_kind` reads a kind back.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("kind", "batch").parquet(folder)

    return out.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_kind(spark: SparkSession, folder: str, kind: str, schema: StructType) -> DataFrame:
    """The rows of one kind that `route` has written, none if there are none; only that kind's files are read."""
    with_batch = StructType([f for f in schema.fields if f.name != "kind"]).add("batch", "long").add("kind", "string")
    return spark.read.schema(with_batch).parquet(folder).filter(F.col("kind") == kind)
