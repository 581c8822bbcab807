"""Motion features per track, posture signals, and the motion-state automaton."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinewatch.functions.scalars import in_group, strictly_after, transition_reason
from kinewatch.operators.automaton import evidence_of, next_state
from kinewatch.operators.geometry import with_bbox_geometry
from kinewatch.operators.lineage import cut
from kinewatch.operators.slices import Width, nearest_frame, neighbor, place, shortest, with_halo, within
from kinewatch.params import (
    FALLING, RECOVERING, SCOPE, STATES, SUSPECTED, TRACK, UPRIGHT, PostureGroups, Thresholds,
)

SMOOTHED = [
    "aspect_ratio_width_over_height", "center_dx_pixels", "center_dy_pixels",
    "center_dx_frame_width", "center_dy_frame_height", "center_dy_person_height",
    "vertical_speed_pixels_per_second", "vertical_speed_frame_height_per_second",
]
FIRST_ELAPSED = 1e-9
T = "timestamp_seconds"


def temporal_features(obs: DataFrame, width: Width = None,
                      keys: list[str] = TRACK) -> DataFrame:
    """Motion against the previous observation of the track; a first observation has none."""
    here = F.struct("timestamp_seconds", "center_x", "center_y", "height")
    rows = neighbor(with_bbox_geometry(obs), keys, T, {"_p": here}, width)
    p = F.col("_p")
    first = p.isNull()
    elapsed = F.col(T) - p[T]
    dx, dy = F.col("center_x") - p["center_x"], F.col("center_y") - p["center_y"]
    dy_frame = dy / F.col("frame_height")

    def moving(c: Column) -> Column:
        return F.when(first, F.lit(0.0)).otherwise(c)

    return rows.withColumns({
        "is_first": first,
        "aspect_ratio_width_over_height": F.try_divide(F.col("width"), F.col("height")),
        "center_dx_pixels": moving(dx),
        "center_dy_pixels": moving(dy),
        "center_dx_frame_width": moving(dx / F.col("frame_width")),
        "center_dy_frame_height": moving(dy_frame),
        "center_dy_person_height": moving(dy / F.greatest(p["height"], F.lit(1.0))),
        # equal timestamps have no speed; monotonicity_violations reports them
        "vertical_speed_pixels_per_second": moving(F.try_divide(dy, elapsed)),
        "vertical_speed_frame_height_per_second": moving(F.try_divide(dy_frame, elapsed)),
        "elapsed_seconds": F.when(first, F.lit(FIRST_ELAPSED)).otherwise(elapsed),
    }).drop("_p", "width", "height", "center_x", "center_y")


def smooth_features(features: DataFrame, window: int | Column, width: Width = None,
                    keys: list[str] = TRACK, sizes: tuple[int, ...] | None = None) -> DataFrame:
    """Mean of the last `window` moving rows; the first observation stays raw and is not averaged.

    In a sweep `window` is a column and `sizes` lists the values it takes.
    """
    sizes = sizes or (window,)
    if min(sizes) <= 0:
        raise ValueError("the smoothing window must be positive")
    part = keys
    width = within(width, keys)
    if width is not None:
        n = max(sizes) - 1
        features = with_halo(features, keys, T, n, width) if n else (
            place(features.withColumn("_halo", F.lit(False)), F.col(T), width))
        part = [*keys, "_slice"]

    def mean(c: str) -> Column:
        moving, out = F.when(~F.col("is_first"), F.col(c)), None
        for n in sizes:
            w = Window.partitionBy(*part).orderBy(T).rowsBetween(-(n - 1), 0)
            m = F.avg(moving).over(w)
            out = m if out is None else F.when(window == n, m).otherwise(out)
        return out

    smoothed = features.withColumns(
        {c: F.when(F.col("is_first"), F.col(c)).otherwise(mean(c)) for c in SMOOTHED})
    return smoothed if width is None else smoothed.filter("not _halo").drop("_halo", "_slice")


def monotonicity_violations(df: DataFrame, keys: list[str], width: Width = None) -> DataFrame:
    """Rows, in frame order, whose time does not exceed the previous row's."""
    out = neighbor(df, keys, "frame_id", {"previous_timestamp": F.col(T)}, width)
    return out.filter(F.col(T) <= F.col("previous_timestamp"))


def with_postures(obs: DataFrame, groups: PostureGroups) -> DataFrame:
    """What the class name alone says; a sweep asks it before its candidates multiply the rows."""
    name = F.col("class_name")
    return obs.withColumns({"falling_posture": in_group(name, groups.fall), "lying_posture": in_group(name, groups.lying),
                            "_upright": in_group(name, groups.upright)})


def with_signals(features: DataFrame, groups: PostureGroups, th: Thresholds) -> DataFrame:
    if "_upright" not in features.columns:
        features = with_postures(features, groups)
    aspect = F.col("aspect_ratio_width_over_height")
    falling, lying = F.col("falling_posture"), F.col("lying_posture")
    ratio = aspect >= th.aspect_ratio_fall_min
    speed = F.col("vertical_speed_frame_height_per_second") >= th.vertical_speed_min
    return features.withColumns({
        "ratio_signal": ratio,
        "speed_signal": speed,
        "fall_signal": ratio | speed | falling | lying,
        "candidate_trigger": speed | falling,
        "upright_signal": F.col("_upright") & (aspect <= th.upright_aspect_ratio_max),
    }).drop("_upright")


def track_expiry(obs: DataFrame, frames: DataFrame, timeout: float | Column,
                 width: Width = None, keys: list[str] = TRACK) -> DataFrame:
    """First frame beyond each gap longer than the timeout, if the track is not back by then."""
    ends = neighbor(obs.select(*keys, F.col(T).cast("double").alias("last_seen")), keys,
                    "last_seen", {"_next": F.col("last_seen")}, width, following=True)
    gaps = ends.filter(F.col("_next").isNull() | (F.col("_next") - F.col("last_seen") > timeout))
    hit = nearest_frame(gaps, frames, SCOPE, strictly_after(F.col("last_seen"), timeout), "_f",
                        ["frame_id", T], width)
    return hit.filter(
        F.col("_f").isNotNull() & (F.col("_next").isNull() | (F.col("_f")[T] < F.col("_next")))
    ).select(*keys, "last_seen", F.col("_f")["frame_id"].alias("frame_id"),
             F.col("_f")[T].alias(T), (F.col("_f")[T] - F.col("last_seen")).alias("gap"))


# --- motion states -------------------------------------------------------------------------------

_TIMED = (SUSPECTED, FALLING, RECOVERING)
_ROW = ["t", "frame_id", "expired", "gap", "trigger", "fall", "upright", "lying", "speed", "falling"]
_OUT = ("array<struct<frame_id:bigint,t:double,before:int,after:int,elapsed:double,"
        "speed:boolean,falling:boolean,lying:boolean,expired:boolean,gap:double>>")


def _fold(rows: Column, state: Column, entered: Column, th: Thresholds, keep: bool) -> Column:
    """Runs the automaton over one sorted array; keep=True also collects the state changes."""

    def step(acc: Column, r: Column) -> Column:
        elapsed = r["t"] - acc["e"]

        def moved(n: Column) -> Column:
            parts = [n.alias("s"), r["t"].alias("e")]
            if keep:
                change = F.struct(
                    r["frame_id"].alias("frame_id"), r["t"].alias("t"), acc["s"].alias("before"),
                    n.alias("after"), elapsed.alias("elapsed"), r["speed"].alias("speed"),
                    r["falling"].alias("falling"), r["lying"].alias("lying"),
                    r["expired"].alias("expired"), r["gap"].alias("gap"))
                parts.append(F.concat(acc["out"], F.array(change)).cast(_OUT).alias("out"))
            return F.when(n == acc["s"], acc).otherwise(F.struct(*parts))

        # a one-element array binds the next state once
        signals = {n: r[n] for n in ("expired", "trigger", "fall", "upright", "lying")}
        once = F.array(next_state(acc["s"], evidence_of(signals, elapsed, th)))
        return F.element_at(F.transform(once, moved), 1)

    start = [state.cast("int").alias("s"), entered.cast("double").alias("e")]
    if keep:
        start.append(F.array().cast(_OUT).alias("out"))
    return F.aggregate(rows, F.struct(*start), step)


def _timeline(signals: DataFrame, expiry: DataFrame | None, keys: list[str]) -> DataFrame:
    no = F.lit(False)
    rows = signals.select(
        *keys, F.col(T).cast("double").alias("t"), F.col("frame_id").cast("long").alias("frame_id"),
        no.alias("expired"), F.lit(0.0).alias("gap"), F.col("candidate_trigger").alias("trigger"),
        F.col("fall_signal").alias("fall"), F.col("upright_signal").alias("upright"),
        F.col("lying_posture").alias("lying"), F.col("speed_signal").alias("speed"),
        F.col("falling_posture").alias("falling"))
    # a missing comparison is no evidence
    rows = rows.fillna(False, ["trigger", "fall", "upright", "lying", "speed", "falling"])
    if expiry is None:
        return rows
    gone = expiry.select(
        *keys, F.col(T).cast("double").alias("t"), F.col("frame_id").cast("long").alias("frame_id"),
        F.lit(True).alias("expired"), F.col("gap"), *[no.alias(c) for c in _ROW[4:]])
    return rows.unionByName(gone)


def motion_states(signals: DataFrame, th: Thresholds, expiry: DataFrame | None = None,
                  width: Width = None, keys: list[str] = TRACK) -> DataFrame:
    """State changes per track, from rows with signals and optional expiry rows.

    In a sweep the durations are columns, and `keys` then includes them.

    width=None folds each track's sorted array. Otherwise tracks are cut into time slices: every
    slice is folded in parallel from each state it could start in, one small row per slice is chained
    per track, and the slices are folded once more from their known start.
    """
    rows = _timeline(signals, expiry, keys)
    width = within(width, keys)
    packed = F.array_sort(F.collect_list(F.struct(*_ROW))).alias("rows")
    if width is None:
        done = rows.groupBy(*keys).agg(packed).select(
            *keys, _fold(F.col("rows"), F.lit(UPRIGHT), F.col("rows")[0]["t"], th, True).alias("r"))
        return _changes(done, keys)

    longest = th.longest + 1e-6
    if shortest(width) <= longest:
        raise ValueError("a slice must be longer than the longest state duration")
    part = [*keys, "_slice"]
    sliced = cut(place(rows, F.col("t"), width))  # read three times below
    groups = sliced.groupBy(*part).agg(packed)
    # times just before a slice: the only entry times whose duration guard may still be open in it
    recent = (
        place(sliced, F.col("t") + longest, width, "_ahead").filter(F.col("_ahead") > F.col("_slice"))
        .withColumn("_slice", F.col("_slice") + 1)
        .groupBy(*part).agg(F.collect_set("t").alias("recent")))
    never = F.lit(float("-inf"))
    open_starts = F.flatten(F.transform(
        F.coalesce(F.col("recent"), F.array().cast("array<double>")),
        lambda e: F.array(*[F.struct(F.lit(s).alias("s"), e.alias("e")) for s in _TIMED])))
    starts = F.concat(
        F.array(*[F.struct(F.lit(s).alias("s"), never.alias("e")) for s in range(6)]), open_starts)
    ends = F.transform(starts, lambda h: F.struct(
        h["s"].alias("s0"), h["e"].alias("e0"),
        _fold(F.col("rows"), h["s"], h["e"], th, False).alias("to")))
    hypotheses = groups.join(recent, part, "left").select(
        *part, F.col("rows")[0]["t"].alias("t0"), ends.alias("_ends"))
    flat = hypotheses.select(
        *part, "t0", _seconds(th.suspect_duration).alias("suspect"),
        _seconds(th.lying_duration).alias("lying"), F.transform("_ends", lambda x: x["s0"]).alias("s0"),
        F.transform("_ends", lambda x: x["e0"]).alias("e0"),
        F.transform("_ends", lambda x: x["to"]["s"]).alias("s1"),
        F.transform("_ends", lambda x: x["to"]["e"]).alias("e1"))
    known = chain_slices(flat, keys)
    done = groups.join(known, part).select(
        *keys, _fold(F.col("rows"), F.col("state"), F.col("entered"), th, True).alias("r"))
    return _changes(done, keys)


def _seconds(value: float | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def chain_slices(flat: DataFrame, keys: list[str]) -> DataFrame:
    """Start state of every slice, from one row per slice with the outcome of every start.

    Rows stream through in track and slice order; only the running state is held.
    """
    need = {SUSPECTED: "suspect", FALLING: "lying", RECOVERING: "suspect"}
    never = float("-inf")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, entered = None, UPRIGHT, 0.0
        for pdf in batches:
            states, entries = [], []
            for row in pdf.itertuples(index=False):
                here = tuple(row[: len(keys)])
                if here != key:
                    key, state, entered = here, UPRIGHT, row.t0
                states.append(state)
                entries.append(entered)
                open_guard = state in need and (
                    row.t0 - entered + 1e-9 < getattr(row, need[state]))
                wanted = entered if open_guard else never
                for s0, e0, s1, e1 in zip(row.s0, row.e0, row.s1, row.e1):
                    if s0 == state and e0 == wanted:
                        state, entered = int(s1), (entered if e1 == never else float(e1))
                        break
                else:
                    raise ValueError("no outcome for the start state of a slice")
            out = pdf[[*keys, "_slice"]].copy()
            out["state"], out["entered"] = states, entries
            yield out

    types = dict(flat.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", _slice long, state int, entered double"
    ordered = flat.repartition(*keys).sortWithinPartitions(*keys, "_slice")
    return ordered.mapInPandas(run, schema)


def state_name(code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in STATES]), code + 1)


def _changes(done: DataFrame, keys: list[str]) -> DataFrame:
    # a plain explode would add a filter on the array's size, and run the fold a second time for it
    c = done.select(*keys, F.explode_outer("r.out").alias("c")).filter("c is not null")
    before, after = state_name(F.col("c.before")), state_name(F.col("c.after"))
    return c.select(
        *keys, F.col("c.frame_id").alias("frame_id"), F.col("c.t").alias(T),
        before.alias("previous_state"), after.alias("next_state"),
        transition_reason(before, after, F.col("c.elapsed"), F.col("c.speed"), F.col("c.falling"),
                          F.col("c.lying"), F.col("c.expired"), F.col("c.gap")).alias("reason"))


def active_tracks(obs: DataFrame, now: float, timeout: float) -> DataFrame:
    """Tracks last seen within the timeout at the given time."""
    seen = obs.filter(F.col(T) <= now).groupBy(*TRACK).agg(F.max(T).alias("last_seen"))
    return seen.filter(F.lit(float(now)) - F.col("last_seen") <= timeout)


def frame_motion(features: DataFrame, frames: DataFrame) -> DataFrame:
    """Largest absolute smoothed vertical speed per frame and the first detection's box."""
    box = F.struct("x1", "y1", "x2", "y2")
    per_frame = features.groupBy(*SCOPE, "frame_id").agg(
        F.max(F.abs("vertical_speed_frame_height_per_second")).alias("motion_score"),
        F.min_by(box, "detection_id").alias("bbox"))
    return frames.join(per_frame, [*SCOPE, "frame_id"], "left").withColumn(
        "motion_score", F.coalesce("motion_score", F.lit(0.0)))
