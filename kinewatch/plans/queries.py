"""Registered queries: one per operator, each with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from kinewatch.functions import scalars as FN
from kinewatch.operators import episodes as E
from kinewatch.operators import geometry as G
from kinewatch.operators import manifests as MF
from kinewatch.operators import matching as MT
from kinewatch.operators import motion as M
from kinewatch.operators import protocol as PR
from kinewatch.operators import quality as Q
from kinewatch.operators import reporting as R
from kinewatch.operators import review as RV
from kinewatch.operators import samples as S
from kinewatch.operators import slices as SL
from kinewatch.operators import tracking as TR
from kinewatch.plans import cascade as C
from kinewatch.plans import dataset as D
from kinewatch.plans import fixtures as X
from kinewatch.plans import manifest as MN
from kinewatch.plans import oracles as O
from kinewatch.params import (
    DEVELOPMENT, LOCKED, SCOPE, TRACK, VALIDATION, AlertPolicy, CascadeParams, EventParams, Gate,
    MatchProtocol, ReviewPolicy, Thresholds,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

P = CascadeParams()
T = "timestamp_seconds"
CLASS_NAMES = {0: "standing", 1: "sitting", 2: "falling", 3: "lying"}
ALIASES = {"sitting": "seated"}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


# Pixel sizes have two decimals, so shares of them can end exactly on a rounding tie at six decimals.
FINE = {"center_dx_frame_width": 9, "center_dy_frame_height": 9, "center_dy_person_height": 9}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals (shares of pixels to nine), as the SQL does."""
    cols = {f.name: F.round(F.col(f.name).cast("double"), FINE.get(f.name, 6)) for f in df.schema.fields
            if isinstance(f.dataType, (DoubleType, FloatType))}
    return df.withColumns(cols) if cols else df


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, {FINE.get(n, 6)}) as {n}" for n in names)


def cam(spark: SparkSession, sf: str, sparse: bool = True, gather: bool = True) -> tuple[DataFrame, DataFrame, SL.Slices | None]:
    """Observations, frames and the slices that their large scopes ask for; scopes gathered unless a sweep does so."""
    obs = X.load(spark, sf, X.SPARSE if sparse else X.TRACKED)
    frames = X.load(spark, sf, X.FRAMES)
    w = SL.plan_slices([obs, frames], SCOPE, finer=TRACK)
    return (*C.together(obs, frames, w), w) if gather else (obs, frames, w)


# --- detections ----------------------------------------------------------------------------------

NAME_SQL = """coalesce(case class_id when 1 then 'seated' end, case class_id when 0 then 'standing'
  when 1 then 'sitting' when 2 then 'falling' when 3 then 'lying' end, 'class_' || class_id)"""
BOXES = f"(select *, {NAME_SQL} as class_name from ({X.RAW_BOXES}))"


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    return G.convert_raw_detections(X.load(spark, sf, X.RAW_BOXES), CLASS_NAMES, ALIASES)


@query("convert_raw_detections", f"select detection_id, class_id, class_name from {BOXES}")
def _(spark, sf):
    return boxes(spark, sf).select("detection_id", "class_id", "class_name")


@query("filter_person_classes", f"""select class_name, count(*) as detections from {BOXES}
  where class_name in ('standing', 'seated') group by class_name""")
def _(spark, sf):
    return R.class_counts(G.filter_person_classes(boxes(spark, sf), ["standing", "seated"]))


@query("filter_confidence", f"select detection_id, round(confidence, 6) as confidence from {BOXES} where confidence >= 0.5")
def _(spark, sf):
    return rounded(G.filter_confidence(boxes(spark, sf), 0.5).select("detection_id", "confidence"))


DET_BAD = """x2 <= x1 or y2 <= y1 or x1 < 0 or y1 < 0 or x2 > frame_width or y2 > frame_height
  or confidence not between 0 and 1"""


@query("validate_detections", f"""select detection_id, concat_ws(',',
    case when x2 <= x1 or y2 <= y1 then 'empty_box' end,
    case when x1 < 0 or y1 < 0 then 'negative_corner' end,
    case when x2 > frame_width or y2 > frame_height then 'beyond_frame' end,
    case when confidence not between 0 and 1 then 'bad_confidence' end) as errors
  from {BOXES} where {DET_BAD}""")
def _(spark, sf):
    _, bad = G.validate_detections(boxes(spark, sf))
    return bad.select("detection_id", F.array_join("_errors", ",").alias("errors"))


@query("bbox_geometry", f"""select detection_id, round(x2 - x1, 6) as width, round(y2 - y1, 6) as height,
    round((x1 + x2) / 2, 6) as center_x, round((y1 + y2) / 2, 6) as center_y
  from {BOXES} where not ({DET_BAD})""")
def _(spark, sf):
    good, _ = G.validate_detections(boxes(spark, sf))
    return rounded(G.with_bbox_geometry(good).select(
        "detection_id", "width", "height", "center_x", "center_y"))


@query("crop_rect", f"""select * from (select detection_id,
    greatest(0, cast(round_even(x1 + 0.5, 0) as bigint)) as crop_x1,
    greatest(0, cast(round_even(y1 + 0.5, 0) as bigint)) as crop_y1,
    least(600, cast(round_even(x2 + 0.5, 0) as bigint)) as crop_x2,
    least(400, cast(round_even(y2 + 0.5, 0) as bigint)) as crop_y2 from {BOXES})
  where crop_x2 > crop_x1 and crop_y2 > crop_y1""")
def _(spark, sf):
    shifted = boxes(spark, sf).withColumns(
        {c: F.col(c) + 0.5 for c in ("x1", "y1", "x2", "y2")}
        | {"frame_width": F.lit(600), "frame_height": F.lit(400)})
    return G.crop_rect(shifted).select("detection_id", "crop_x1", "crop_y1", "crop_x2", "crop_y2")


@query("restore_posture", f"""select b.detection_id, b.class_name, cast(t.detection_id % 5 as int) as track_id
  from {BOXES} b join {BOXES} t on t.confidence >= 0.5 and t.detection_id = b.detection_id and t.source_id = b.source_id
    and t.session_id = b.session_id and t.frame_id = b.frame_id""")
def _(spark, sf):
    all_boxes = boxes(spark, sf)
    ids = all_boxes.filter("confidence >= 0.5").select(
        *SCOPE, "frame_id", "detection_id", (F.col("detection_id") % 5).cast("int").alias("track_id"))
    return G.restore_posture(ids, all_boxes).select("detection_id", "class_name", "track_id")


@query("class_counts", f"select class_name, count(*) as detections from {BOXES} group by class_name")
def _(spark, sf):
    return R.class_counts(boxes(spark, sf))


@query("associate_tracks")
def _(spark, sf):
    good, _ = G.validate_detections(boxes(spark, sf))
    return TR.associate_tracks(good, width=TR.association_width(good))


@query("detection_lines", f"""select case when bad then 'rejected' else class_name end as kind,
    count(*) as lines from (select *, detection_id % 97 = 0 as bad from ({X.duck(X.TRACKED)})) group by 1""")
def _(spark, sf):
    """Detection records written as JSON lines, some broken or with unknown keys, and read back."""
    from kinewatch.sources.readers import parse_detections

    obs = X.load(spark, sf, X.TRACKED).withColumn("bbox_xyxy", F.array("x1", "y1", "x2", "y2"))
    obs = obs.withColumn("detection_id", F.col("detection_id").cast("string")).drop("x1", "y1", "x2", "y2")
    bad = F.col("detection_id").cast("long") % 97 == 0
    line = F.to_json(F.struct(*obs.columns))
    broken = F.when(F.col("detection_id").cast("long") % 2 == 0, F.substring(line, 1, 20)).otherwise(
        F.concat(F.lit('{"extra":1,'), F.expr("substring(line_, 2)")))
    lines = obs.withColumn("line_", line).select(
        F.when(bad, broken).otherwise(F.col("line_")).alias("value"), F.lit("lines").alias("file"))
    good, rejects = parse_detections(lines, tracked=True)
    return good.select(F.col("class_name").alias("kind")).unionByName(
        rejects.select(F.lit("rejected").alias("kind"))).groupBy("kind").agg(F.count("*").alias("lines"))


# --- motion --------------------------------------------------------------------------------------

FEATURES = ["aspect_ratio_width_over_height", "center_dx_pixels", "center_dy_pixels",
            "center_dx_frame_width", "center_dy_frame_height", "center_dy_person_height",
            "vertical_speed_pixels_per_second", "vertical_speed_frame_height_per_second"]
FEAT_SQL = O.ctes(*O.features())


@query("temporal_features", f"{FEAT_SQL} select detection_id, is_first, {r6('elapsed_seconds', *FEATURES)} from named")
def _(spark, sf):
    obs, _, w = cam(spark, sf, sparse=False)
    return rounded(M.temporal_features(obs, w).select(
        "detection_id", "is_first", "elapsed_seconds", *FEATURES))


@query("initial_features", f"{FEAT_SQL} select detection_id, {r6('elapsed_seconds', *FEATURES)} from named where is_first")
def _(spark, sf):
    obs, _, w = cam(spark, sf, sparse=False)
    return rounded(M.temporal_features(obs, w).filter("is_first").select(
        "detection_id", "elapsed_seconds", *FEATURES))


@query("smooth_features", f"{FEAT_SQL} select detection_id, {r6(*FEATURES)} from smooth")
def _(spark, sf):
    obs, _, w = cam(spark, sf, sparse=False)
    return rounded(M.smooth_features(M.temporal_features(obs, w), 5, w).select("detection_id", *FEATURES))


SIGNALS = ["ratio_signal", "speed_signal", "falling_posture", "lying_posture", "fall_signal",
           "candidate_trigger", "upright_signal"]


@query("posture_signals", f"{FEAT_SQL} select detection_id, {', '.join(SIGNALS)} from sig")
def _(spark, sf):
    obs, _, w = cam(spark, sf, sparse=False)
    return C.motion_signals(obs, P, w).select("detection_id", *SIGNALS)


@query("monotonicity_violations", f"""select detection_id, {r6('timestamp_seconds', 'previous_timestamp')} from (
  select *, lag(timestamp_seconds) over (partition by {O.K} order by frame_id, detection_id) as previous_timestamp from (
    select * replace (case when detection_id % 11 = 0 then timestamp_seconds - 0.5 else timestamp_seconds end as timestamp_seconds)
    from ({X.duck(X.TRACKED)}))) where timestamp_seconds <= previous_timestamp""")
def _(spark, sf):
    obs, _, _ = cam(spark, sf, sparse=False)
    late = F.when(F.col("detection_id") % 11 == 0, F.col(T) - 0.5).otherwise(F.col(T))
    width = SL.plan_slices([obs], TRACK, "frame_id", 1.0)
    return rounded(M.monotonicity_violations(obs.withColumn(T, late), TRACK, width).select(
        "detection_id", T, "previous_timestamp"))


@query("track_expiry", f"""{O.ctes(*O.motion())} select {O.K}, frame_id, {r6('timestamp_seconds', 'gap')} from expiry""")
def _(spark, sf):
    obs, frames, w = cam(spark, sf)
    return rounded(M.track_expiry(obs, frames, 1.0, w).select(*TRACK, "frame_id", T, "gap"))


@query("motion_states", f"""{O.ctes(*O.motion(X.TRACKED, expire=False))}
  select {O.K}, frame_id, previous_state, next_state, reason from moves""")
def _(spark, sf):
    obs, _, w = cam(spark, sf, sparse=False)
    return M.motion_states(C.motion_signals(obs, P, w), P.thresholds, None, w).drop(T)


@query("motion_states_with_expiry", f"""{O.ctes(*O.motion())}
  select {O.K}, frame_id, previous_state, next_state, reason from moves""")
def _(spark, sf):
    obs, frames, w = cam(spark, sf)
    return C.transitions_of(obs, frames, P, w).drop(T)


BURST_LIMIT = 300  # rows of a slice, small enough for the burst to be cut at every scale


def burst(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, SL.Slices]:
    """A camera whose rows nearly all lie within 20 s, on slices; its tracks stay whole while they are small."""
    obs, frames = X.load(spark, sf, X.BURST), X.load(spark, sf, X.BURST_FRAMES)
    return obs, frames, SL.plan_slices([obs, frames], SCOPE, limit=BURST_LIMIT, finer=TRACK)


@query("burst_transitions", f"""{O.ctes(*O.motion(X.BURST, frames=X.BURST_FRAMES))}
  select {O.K}, frame_id, previous_state, next_state, reason from moves""")
def _(spark, sf):
    obs, frames, w = burst(spark, sf)
    return C.transitions_of(obs, frames, P, w).drop(T)


@query("burst_features", f"""{O.ctes(*O.features(X.BURST, frames=X.BURST_FRAMES))}
  select detection_id, {', '.join(SIGNALS)} from sig""")
def _(spark, sf):
    obs, _, w = burst(spark, sf)
    return C.motion_signals(obs, P, w).select("detection_id", *SIGNALS)


@query("transition_counts", f"""{O.ctes(*O.motion())}
  select previous_state, next_state, count(*) as transitions from moves group by 1, 2""")
def transition_counts(spark, sf):
    obs, frames, w = cam(spark, sf)
    return C.transitions_of(obs, frames, P, w).groupBy("previous_state", "next_state").agg(
        F.count("*").alias("transitions"))


@query("active_tracks", f"""select {O.K}, round(max(timestamp_seconds), 6) as last_seen from ({X.duck(X.SPARSE)})
  where timestamp_seconds <= 15.0 group by {O.K} having 15.0 - max(timestamp_seconds) <= 1.0""")
def _(spark, sf):
    return rounded(M.active_tracks(X.load(spark, sf, X.SPARSE), 15.0, 1.0))


@query("frame_motion", f"""{O.ctes(*O.features(X.SPARSE))} select f.source_id, f.session_id, f.frame_id,
    round(coalesce(max(abs(s.vertical_speed_frame_height_per_second)), 0), 6) as motion_score,
    round(arg_min(s.x1, s.detection_id), 6) as x1
  from frames f left join sig s on s.source_id = f.source_id and s.session_id = f.session_id and s.frame_id = f.frame_id
  group by f.source_id, f.session_id, f.frame_id""")
def _(spark, sf):
    obs, frames, w = cam(spark, sf)
    return rounded(M.frame_motion(C.motion_signals(obs, P, w), frames).select(
        *SCOPE, "frame_id", "motion_score", F.col("bbox.x1").alias("x1")))


CLOCK = f"""select source_id, session_id, frame_id, timestamp_seconds from ({X.FRAMES})"""


@query("repair_timestamps", f"""with recursive f as (select source_id, session_id,
      row_number() over (partition by source_id, session_id order by frame_id) - 1 as n,
      case when frame_id % 9 = 0 then 0.0 when frame_id % 7 = 0 then timestamp_seconds - 0.4 else timestamp_seconds end as t
    from ({X.duck(X.FRAMES)})),
  run as (select source_id, session_id, cast(-1 as bigint) as n, cast(-1.0 as double) as m, cast(null as double) as v from f where n = 0
    union all
    select f.source_id, f.session_id, f.n, case when f.t > m then f.t when f.n / 8.0 > m then f.n / 8.0 else m end,
      case when f.t > m then f.t when f.n / 8.0 > m then f.n / 8.0 end
    from run r join f on f.source_id = r.source_id and f.session_id = r.session_id and f.n = r.n + 1)
  select source_id, session_id, n as frame_id, round(v, 6) as timestamp_seconds from run where v is not null""")
def _(spark, sf):
    frames = X.load(spark, sf, X.FRAMES)
    w = SL.plan_slices([frames], SCOPE, "frame_id", 1.0)
    n = SL.with_ordinal(frames, SCOPE, "frame_id", "n", w)
    bad = (F.when(F.col("frame_id") % 9 == 0, F.lit(0.0))
           .when(F.col("frame_id") % 7 == 0, F.col(T) - 0.4).otherwise(F.col(T)))
    shaky = n.withColumn(T, bad).withColumn("frame_id", F.col("n")).select(*SCOPE, "frame_id", T)
    good, _ = TR.repair_timestamps(shaky, 8.0, SL.slice_width(shaky, SCOPE, "frame_id", 10.0))
    return rounded(good)


# --- events --------------------------------------------------------------------------------------

LIFE = O.ctes(*O.lifecycle())
EVENT_COLS = ["start_frame", "start_time", "end_frame", "end_time", "status",
              "lying_started_at_seconds", "cooldown_suppressed_candidate_at"]
EVENT_SQL = f"""{O.K}, start_frame, round(start_time, 6) as start_time, end_frame, round(end_time, 6) as end_time,
  status, {r6('lying_started_at_seconds', 'cooldown_suppressed_candidate_at')}"""


def event_log(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame, float | None]:
    obs, frames, w = cam(spark, sf)
    moves = C.transitions_of(obs, frames, P, w)
    return E.fall_events(moves, frames, P.events, w), moves, frames, w


def events_of(spark, sf) -> DataFrame:
    return E.latest_event_state(E.event_changes(event_log(spark, sf)[0]))


@query("fall_events", f"{LIFE} select {EVENT_SQL} from events_out")
def _(spark, sf):
    return rounded(events_of(spark, sf).select(*TRACK, *EVENT_COLS))


@query("event_changes")
def _(spark, sf):
    return E.event_changes(event_log(spark, sf)[0]).withColumn(
        "transition_reasons", F.array_join("transition_reasons", "; "))


@query("latest_event_state", f"""{LIFE} select status, count(*) as events from events_out group by status""")
def _(spark, sf):
    return events_of(spark, sf).groupBy("status").agg(F.count("*").alias("events"))


@query("event_timeouts", f"""{LIFE} select {O.K}, start_frame, end_frame from events_out where status = 'timed_out'""")
def _(spark, sf):
    return events_of(spark, sf).filter("status = 'timed_out'").select(*TRACK, "start_frame", "end_frame")


@query("active_events", f"""{LIFE} select {O.K}, start_frame from events_out where end_time is null""")
def _(spark, sf):
    return E.active_events(events_of(spark, sf)).select(*TRACK, "start_frame")


@query("review_ready", f"""{LIFE} select {O.K}, start_frame, review_frame as frame_id,
  round(review_time, 6) as timestamp_seconds from events_out where review_frame is not null""")
def _(spark, sf):
    return rounded(E.review_ready(event_log(spark, sf)[0]).select(*TRACK, "start_frame", "frame_id", T))


@query("event_temporal_state", f"""{LIFE} select e.source_id, e.session_id, e.track_id, e.start_frame,
    coalesce(arg_max(m.next_state, m.timestamp_seconds), 'upright') as temporal_state
  from events_out e left join moves m on m.source_id = e.source_id and m.session_id = e.session_id
    and m.track_id = e.track_id and m.timestamp_seconds <= e.review_time
  where e.review_frame is not null group by 1, 2, 3, 4""")
def _(spark, sf):
    log, moves, _, w = event_log(spark, sf)
    reviews = E.review_ready(log).drop("temporal_state")
    return E.event_temporal_state(reviews, moves, w).select(*TRACK, "start_frame", "temporal_state")


@query("event_trigger_video_time", f"""{LIFE}, t as (select (review_time - start_time) * 1000 as ms from events_out where review_frame is not null)
  select count(*) as count, round(avg(ms), 6) as mean_ms, round(quantile_cont(ms, 0.5), 6) as p50_ms,
    round(quantile_cont(ms, 0.95), 6) as p95_ms, round(max(ms), 6) as maximum_ms from t""")
def _(spark, sf):
    times = E.event_trigger_video_time(E.review_ready(event_log(spark, sf)[0]))
    return rounded(R.stage_latency_summary(times).drop("stage"))


RING = """ords as (select *, row_number() over (partition by source_id, session_id order by timestamp_seconds) as ord from (
      select f.source_id, f.session_id, f.frame_id, f.timestamp_seconds,
        coalesce(max(abs(s.vertical_speed_frame_height_per_second)), 0) as score
      from frames f left join sig s on s.source_id = f.source_id and s.session_id = f.session_id and s.frame_id = f.frame_id
      group by 1, 2, 3, 4)),
  rev as (select e.*, o.ord as rord, greatest(0, start_time - 1.0) as tb,
      coalesce(review_lying, review_end, start_time) as anchor
    from events_out e join ords o on o.source_id = e.source_id and o.session_id = e.session_id and o.frame_id = e.review_frame),
  ring as (select r.track_id, r.start_frame, r.tb, r.anchor, o.* from rev r join ords o
    on o.source_id = r.source_id and o.session_id = r.session_id and o.ord > r.rord - 180 and o.ord <= r.rord)"""


@query("recent_frames", f"""{LIFE}, {RING} select {O.K}, start_frame, count(*) as frames, min(ord) - 1 as first_ord from ring group by 1, 2, 3, 4""")
def _(spark, sf):
    log, _, frames, w = event_log(spark, sf)
    near = E.recent_frames(frames, E.review_ready(log).select(
        *TRACK, "start_frame", "frame_id", T), P.events.ring_buffer_frames, w)
    return near.groupBy(*TRACK, "start_frame").agg(
        F.count("*").alias("frames"), F.min("ord").alias("first_ord"))


PICKS = f"""{LIFE}, {RING.replace('select r.track_id, r.start_frame', "select sha256(concat_ws('|', r.source_id, r.session_id, r.track_id, r.start_frame)) as event_id, r.track_id, r.start_frame")},
  b as (select *, tb as target from ring qualify row_number() over (partition by event_id order by abs(timestamp_seconds - tb), ord) = 1),
  d as (select r.*, r.anchor as target from ring r join b on b.event_id = r.event_id and b.ord <> r.ord
    qualify row_number() over (partition by r.event_id order by r.score desc, r.ord) = 1),
  a as (select r.*, r.anchor + 1.0 as target from ring r join b on b.event_id = r.event_id and b.ord <> r.ord
    join d on d.event_id = r.event_id and d.ord <> r.ord
    qualify row_number() over (partition by r.event_id order by abs(r.timestamp_seconds - (r.anchor + 1.0)), r.ord) = 1),
  picks as (select 'before' as role, 0 as role_order, * from b union all select 'during', 1, * from d union all select 'after', 2, * from a)"""


@query("select_keyframes", f"""{PICKS} select event_id, source_id, session_id, role, role_order, frame_id,
  round(timestamp_seconds, 6) as timestamp_seconds, round(score, 6) as score, round(target, 6) as target_timestamp_seconds,
  case when role = 'during' then 'maximum buffered motion score during candidate event'
    else printf('nearest buffered timestamp to %s target %.3fs', role, target) end as reason from picks""")
def select_keyframes(spark, sf):
    obs, frames, w = cam(spark, sf)
    log = E.fall_events(C.transitions_of(obs, frames, P, w), frames, P.events, w)
    motion = M.frame_motion(C.motion_signals(obs, P, w), frames)
    return rounded(E.select_keyframes(E.review_ready(log), motion, P.events, w).drop("bbox"))


@query("keyframe_crops", f"""{PICKS}, box as (select p.event_id, p.role, p.frame_id, arg_min(s.x1, s.detection_id) as x1, arg_min(s.y1, s.detection_id) as y1,
    arg_min(s.x2, s.detection_id) as x2, arg_min(s.y2, s.detection_id) as y2
  from picks p join sig s on s.source_id = p.source_id and s.session_id = p.session_id and s.frame_id = p.frame_id group by 1, 2, 3)
  select * from (select event_id, role, frame_id, greatest(0, cast(round_even(x1, 0) as bigint)) as crop_x1, greatest(0, cast(round_even(y1, 0) as bigint)) as crop_y1,
    least(640, cast(round_even(x2, 0) as bigint)) as crop_x2, least(480, cast(round_even(y2, 0) as bigint)) as crop_y2 from box)
  where crop_x2 > crop_x1 and crop_y2 > crop_y1""")
def _(spark, sf):
    picks = select_keyframes_boxes(spark, sf)
    return G.crop_rect(picks).select("event_id", "role", "frame_id", "crop_x1", "crop_y1", "crop_x2", "crop_y2")


def select_keyframes_boxes(spark, sf) -> DataFrame:
    obs, frames, w = cam(spark, sf)
    log = E.fall_events(C.transitions_of(obs, frames, P, w), frames, P.events, w)
    motion = M.frame_motion(C.motion_signals(obs, P, w), frames)
    picks = E.select_keyframes(E.review_ready(log), motion, P.events, w)
    return picks.select("event_id", "role", "frame_id", "bbox.*", F.lit(640).alias("frame_width"),
                        F.lit(480).alias("frame_height"))


@query("distinct_keyframes", f"{PICKS} select event_id, role, frame_id from picks")
def _(spark, sf):
    picks = select_keyframes_boxes(spark, sf).select("event_id", "role", "frame_id")
    old = picks.filter("role <> 'after'")
    return E.distinct_keyframes(old, picks)


@query("run_cascade", f"""{LIFE} select count(*) as events, count(review_frame) as reviews,
  count(end_time) as ended from events_out""")
def _(spark, sf):
    obs, frames, _ = cam(spark, sf)
    run = C.run_cascade(frames, obs, P)
    e = run.events.agg(F.count("*").alias("events"), F.count("end_time").alias("ended"))
    return e.crossJoin(run.reviews.agg(F.count("*").alias("reviews")))  # single rows


@query("run_summary", f"""{LIFE} select 'events' as kind, count(*) as rows from events_out
  union all select 'alerts', count(*) from events_out where review_frame is not null
  union all select 'transitions', count(*) from moves""")
def _(spark, sf):
    log, moves, _, _ = event_log(spark, sf)
    reviews = E.review_ready(log)
    found = RV.rule_provider(reviews.withColumn("image_refs", F.array()), "fall")
    alerts = RV.decide_alerts(reviews, found, AlertPolicy())
    return R.run_summary(E.latest_event_state(E.event_changes(log)), alerts, moves)


# --- review --------------------------------------------------------------------------------------

CHAIN = ReviewPolicy(providers=("openai", "deepseek", "local", "mock"), allow_fallback=True, allow_mock=True)


@query("resolve_assessments", f"""with a as ({X.ATTEMPTS}), p as (select event_id,
    max(case when provider = 'openai' then ok end) as o1, max(case when provider = 'deepseek' then ok end) as o2,
    max(case when provider = 'mock' then ok end) as o3, max(decision) as decision,
    max(case when provider = 'openai' then error end) as e1 from a group by event_id)
  select event_id, case when o1 then 'openai' when o2 then 'deepseek' when o3 then 'mock' end as provider,
    case when o1 or o2 or o3 then decision end as decision,
    case when not o1 and (o2 or o3) then e1 end as fallback_reason,
    case when not (o1 or o2 or o3) then e1 end as failure from p""")
def _(spark, sf):
    return RV.resolve_assessments(X.load(spark, sf, X.ATTEMPTS), CHAIN)


@query("rule_provider", f"""select cast(event_id as varchar) as event_id, case when event_id % 4 = 0 then 'text' else 'images_and_text' end as input_mode,
  'uncertain' as decision, 'unknown' as risk_level, false as model_recommends_alert from events""")
def _(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    req = ev.select(F.col("event_id").cast("string").alias("event_id"),
                    F.sequence(F.lit(1), (F.col("event_id") % 4).cast("int")).alias("image_refs"))
    req = req.withColumn("image_refs", F.when(F.col("event_id").cast("long") % 4 == 0, F.array().cast(
        "array<int>")).otherwise(F.col("image_refs")))
    return RV.rule_provider(req, "uncertain").select(
        "event_id", "input_mode", "decision", "risk_level", "model_recommends_alert")


def keyword_provider():
    """A stand-in client: fails on some requests as an expected provider error."""
    def review(request: dict) -> dict:
        k = int(request["event_id"])
        if k % 7 == 0:
            raise RV.ReviewError("no answer")
        return {"decision": "fall" if k % 2 else "not_fall", "confidence": 0.5, "reason": "parity",
                "risk_level": "low", "provider": "keyword", "model": "k1", "input_mode": "text",
                "latency_ms": 1.0, "schema_valid": True, "provider_success": True,
                "input_tokens": k % 100, "output_tokens": 2}
    return review


@query("review_with", """select cast(event_id as varchar) as event_id, event_id % 7 <> 0 as ok,
  case when event_id % 7 = 0 then null when event_id % 2 = 1 then 'fall' else 'not_fall' end as decision,
  case when event_id % 7 = 0 then 'keyword: ReviewError: no answer' end as error from events""")
def _(spark, sf):
    req = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").cast("string").alias("event_id"))
    return RV.review_with(req, "keyword", keyword_provider).select("event_id", "ok", "decision", "error")


@query("provider_usage", """select 'keyword' as provider, count(*) as calls, sum(event_id % 100)::bigint as input_tokens,
  (2 * count(*))::bigint as output_tokens, round(avg(1.0 + event_id % 13), 6) as mean_ms,
  round(quantile_cont(1.0 + event_id % 13, 0.95), 6) as p95_ms from events where event_id % 7 <> 0""")
def _(spark, sf):
    req = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").cast("string").alias("event_id"))
    done = RV.review_with(req, "keyword", keyword_provider).filter("ok")
    done = done.withColumn("latency_ms", 1.0 + F.col("event_id").cast("long") % 13)
    return rounded(R.provider_usage(done).select(
        "provider", "calls", "input_tokens", "output_tokens", "mean_ms", "p95_ms"))


@query("gate_review_requests", """with r as (select event_id, event_id % 5 as n, event_id % 2 = 0 as consent from events),
  p as (select * from (values ('openai', true, true, 4), ('deepseek', true, false, 0), ('local', false, true, 2)) as v(provider, cloud, images, most))
  select event_id, provider, case when cloud and n > 0 and not consent then 'blocked' else 'allowed' end as status,
    cast(case when cloud and n > 0 and not consent then n when not images then 0 else least(n, most, 3) end as int) as images
  from r cross join p""")
def _(spark, sf):
    req = spark.read.parquet(f"{sf}/events.parquet").select(
        "event_id", F.expr("if(event_id % 5 = 0, array(), transform(sequence(1, cast(event_id % 5 as int)), i -> cast(i as string)))")
        .cast("array<string>").alias("image_refs"), (F.col("event_id") % 2 == 0).alias("cloud_image_consent"))
    providers = [RV.Provider("openai", True, True, 4), RV.Provider("deepseek", True, False, 0),
                 RV.Provider("local", False, True, 2)]
    ok, blocked = RV.gate_review_requests(req, providers, ReviewPolicy(allow_cloud_images=True))
    cols = ["event_id", "provider", F.size("image_refs").alias("images")]
    return ok.select(*cols, F.lit("allowed").alias("status")).unionByName(
        blocked.select(*cols, F.lit("blocked").alias("status")))


@query("validate_payload", """select event_id, event_id % 6 in (0, 5) as schema_valid from events""")
def _(spark, sf):
    k = F.col("event_id") % 6
    text = (F.when(k == 0, F.lit('{"decision":"fall","confidence":0.5,"reason":"seen"}'))
            .when(k == 1, F.lit('{"decision":"maybe","reason":"seen"}'))
            .when(k == 2, F.lit('{"decision":"fall","confidence":1.5,"reason":"seen"}'))
            .when(k == 3, F.lit('{"decision":"fall","reason":"seen","extra":1}'))
            .when(k == 4, F.lit('{"decision":"fall","reason":"","risk_level":"low"}'))
            .otherwise(F.lit('{"decision":"uncertain","reason":"dark","attempt_to_stand":true,"risk_level":"high","model_recommends_alert":null}')))
    ev = spark.read.parquet(f"{sf}/events.parquet").select("event_id", text.alias("answer"))
    return RV.validate_payload(ev, "answer").select("event_id", "schema_valid")


@query("decide_alerts", """with a as (select event_id, case event_id % 5 when 0 then 'falling' when 1 then 'lying' when 2 then 'resolved' else 'upright' end as temporal_state,
    case event_id % 3 when 0 then 'fall' when 1 then 'not_fall' else 'uncertain' end as decision,
    event_id % 4 <> 0 as usable, case event_id % 6 when 0 then null when 1 then true else false end as rec from events)
  select event_id, temporal_state, case when not usable then temporal_state in ('falling', 'lying') else decision in ('fall', 'uncertain') end as should_alert,
    concat_ws('; ', case when not usable then 'no successful schema-valid semantic assessment'
        when decision = 'fall' then 'schema-valid semantic decision is fall'
        when decision = 'uncertain' then 'application policy alerts on semantic uncertainty'
        else 'application policy does not alert for semantic not_fall' end,
      case when not usable and temporal_state in ('falling', 'lying') then 'application policy allows high temporal risk without semantics' end,
      case when rec is not null then 'provider recommendation recorded as evidence=' || cast(rec as varchar) end) as reasons from a""")
def _(spark, sf):
    e = F.col("event_id")
    ev = spark.read.parquet(f"{sf}/events.parquet")
    states = ev.select("event_id", F.expr(
        "case event_id % 5 when 0 then 'falling' when 1 then 'lying' when 2 then 'resolved' else 'upright' end").alias("temporal_state"))
    found = ev.select(
        "event_id", F.expr("case event_id % 3 when 0 then 'fall' when 1 then 'not_fall' else 'uncertain' end").alias("decision"),
        (e % 4 != 0).alias("provider_success"), F.lit(True).alias("schema_valid"),
        F.expr("case event_id % 6 when 0 then null when 1 then true else false end").alias("model_recommends_alert"))
    policy = AlertPolicy(True, True, True)
    return RV.decide_alerts(states, found, policy).withColumn("reasons", F.array_join("reasons", "; "))


@query("event_context", f"""{LIFE} select count(*) as events, sum(case when end_time is null then 1 else 0 end)::bigint as open_ends from events_out""")
def _(spark, sf):
    out = RV.with_event_context(events_of(spark, sf))
    end = F.get_json_object("text_context", "$.end_time_seconds")
    has = F.array_contains(F.json_object_keys("text_context"), "end_time_seconds")
    return out.filter(has).agg(F.count("*").alias("events"), F.count_if(end.isNull()).alias("open_ends"))


@query("redact_text", f"""select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
    '(?i)(authorization\\s*[:=]\\s*(?:bearer\\s+)?)[^\\s,;]+', '\\1[REDACTED]', 'g'),
    '(?i)((?:api[_-]?key|token|secret|password)\\s*[:=]\\s*)[^\\s,;]+', '\\1[REDACTED]', 'g'),
    '(?i)data:image/[^;]+;base64,[A-Za-z0-9+/=]+', '[REDACTED_IMAGE]', 'g'),
    '\\bsk-[A-Za-z0-9_-]{{12,}}\\b', '[REDACTED_IMAGE]', 'g')) as redacted from ({X.REDACTION})""")
def _(spark, sf):
    docs = X.load(spark, sf, X.REDACTION)
    return docs.select("doc_id", F.md5(FN.redact_text(F.col("text"))).alias("redacted"))


# --- evaluation ----------------------------------------------------------------------------------

def intervals(spark, sf):
    truth, pred = X.load(spark, sf, X.TRUTH), X.load(spark, sf, X.PREDICTIONS)
    return truth, pred, X.load(spark, sf, X.WINDOWS)


HITS = """select w.* from win w where exists (select 1 from pr p where p.source_id = w.source_id
  and p.session_id = w.session_id and p.start_time < w.end_time and w.start_time < p.end_time)"""


@query("temporal_iou", f"{O.ctes(*O.pairs())} select ground_truth_id, predicted_id, round(temporal_iou, 6) as temporal_iou from cand where temporal_iou > 0")
def _(spark, sf):
    truth, pred, _ = intervals(spark, sf)
    return rounded(MT.event_match_candidates(truth, pred, MatchProtocol()).filter("temporal_iou > 0").select(
        "ground_truth_id", "predicted_id", "temporal_iou"))


@query("event_match_candidates", f"{O.ctes(*O.pairs())} select ground_truth_id, predicted_id, {r6('temporal_iou', 'start_delay_seconds')} from cand")
def _(spark, sf):
    truth, pred, _ = intervals(spark, sf)
    return rounded(MT.event_match_candidates(truth, pred, MatchProtocol()).select(
        "ground_truth_id", "predicted_id", "temporal_iou", "start_delay_seconds"))


@query("event_match_candidates_any_track", f"""with gt as ({X.duck(X.TRUTH)}), pr as ({X.duck(X.PREDICTIONS)})
  select ground_truth_id, predicted_id from ({O.PAIRS.replace(' and g.track_id = p.track_id', '')})
  where temporal_iou >= 0.2 and abs(start_delay_seconds) <= 0.4""")
def _(spark, sf):
    truth, pred, _ = intervals(spark, sf)
    return MT.event_match_candidates(truth, pred, MatchProtocol(0.2, 0.4, "and", False)).select(
        "ground_truth_id", "predicted_id")


@query("match_events", f"{O.ctes(*O.matches())} select ground_truth_id, predicted_id, {r6('temporal_iou', 'start_delay_seconds')} from matched")
def match_events(spark, sf):
    truth, pred, _ = intervals(spark, sf)
    return rounded(MT.match_events(truth, pred, MatchProtocol()).drop(*SCOPE))


@query("event_metrics", f"""{O.ctes(*O.matches(), ('win', X.duck(X.WINDOWS)), ('hits', HITS))},
  n as (select (select count(*) from matched) as tp, (select count(*) from gt) as g, (select count(*) from pr) as p,
    (select avg(start_delay_seconds) from matched) as d, (select count(*) from hits) as h, (select count(*) from win) as w)
  select tp as true_positive_events, p - tp as false_positive_events, g - tp as false_negative_events,
    round(tp / p::double, 6) as precision, round(tp / g::double, 6) as recall,
    round(2.0 * tp / (p + g), 6) as f1, round((g - tp) / g::double, 6) as miss_rate, round((w - h) / w::double, 6) as specificity,
    round((p - tp) / 12.5, 6) as false_alarms_per_hour, round(d, 6) as mean_detection_delay_seconds from n""")
def _(spark, sf):
    truth, pred, win = intervals(spark, sf)
    out = MT.event_metrics(truth, pred, MatchProtocol(), 12.5, win, SL.plan_slices([pred, win], SCOPE, "start_time"))
    return rounded(out.drop("specificity_unavailable_reason", "false_alarms_per_hour_unavailable_reason"))


@query("negative_window_hits", f"with win as ({X.duck(X.WINDOWS)}), pr as ({X.duck(X.PREDICTIONS)}) select event_id from ({HITS})")
def _(spark, sf):
    _, pred, win = intervals(spark, sf)
    return MT.negative_window_hits(win, pred, SL.plan_slices([pred, win], SCOPE, "start_time")).select("event_id")


@query("window_specificity", f"""with win as ({X.duck(X.WINDOWS)}), pr as ({X.duck(X.PREDICTIONS)})
  select round(1 - (select count(*) from ({HITS})) / (select count(*) from win)::double, 6) as specificity,
    cast(null as varchar) as specificity_unavailable_reason""")
def _(spark, sf):
    _, pred, win = intervals(spark, sf)
    return rounded(MT.window_specificity(win, pred, SL.plan_slices([pred, win], SCOPE, "start_time")))


@query("validate_intervals", f"""select event_id, concat_ws(',', case when s < 0 then 'negative_start' end,
    case when e <= s then 'non_positive_duration' end) as errors
  from (select event_id, start_time - 1 as s, case when cast(event_id as bigint) % 10 = 0 then start_time - 1 else end_time - 1 end as e
    from ({X.duck(X.TRUTH)})) where s < 0 or e <= s""")
def _(spark, sf):
    truth, _, _ = intervals(spark, sf)
    moved = truth.withColumns({
        "start_time": F.col("start_time") - 1,
        "end_time": F.when(F.col("event_id").cast("long") % 10 == 0, F.col("start_time") - 1)
        .otherwise(F.col("end_time") - 1)})
    return G.validate_intervals(moved)[1].select("event_id", F.array_join("_errors", ",").alias("errors"))


@query("validate_events", f"""{LIFE} select {O.K}, start_frame, concat_ws(',', 'half_open_end') as errors from events_out
  where end_frame is not null and start_frame % 3 = 0""")
def _(spark, sf):
    ev = events_of(spark, sf).withColumn(
        "end_time", F.when(F.col("start_frame") % 3 != 0, F.col("end_time")))
    return G.validate_events(ev)[1].select(*TRACK, "start_frame", F.array_join("_errors", ",").alias("errors"))


# --- threshold protocol --------------------------------------------------------------------------

PART = O.partition_sql("subject_id")
ROWS_SQL = f"""select c.*, {PART} as partition, 'v' || lpad(cast(video_key as string), 12, '0') as video_id from ({X.CANDIDATE_ROWS}) c"""


def sha(name: str):
    return F.sha2(F.lit(name), 256)


def clip_rows(spark, sf) -> DataFrame:
    rows = X.load(spark, sf, X.CANDIDATE_ROWS)
    return rows.withColumns({
        "partition": MF.partition_of(F.col("subject_id")), "report_id": F.col("candidate_id"),
        "video_id": F.concat(F.lit("v"), F.lpad(F.col("video_key").cast("string"), 12, "0"))})


def protocol_table(spark) -> DataFrame:
    rows = [(c, p, s) for c in ("clean", "faulty") for p, m in MF.SUBJECTS.items() for s in m]
    return spark.createDataFrame(rows, "cycle_id string, partition string, subject_id int")


def reports(spark, sf, partition: str, cycle: str = "clean"
            ) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(headers, rows, selected, protocol) built from the candidate rows of one partition."""
    rows = clip_rows(spark, sf).filter(F.col("partition") == partition).withColumn("cycle_id", F.lit(cycle))
    base = PR.clip_metrics(rows, ["cycle_id", "report_id", "variant", "conf"])
    path = F.concat(F.lit("weights/"), F.col("variant"))
    params = F.to_json(F.struct(
        F.struct(F.struct(F.lit("standing").alias("0")).alias("class_names"),
                 F.col("conf").alias("confidence_threshold"),
                 F.struct(F.array(F.lit("standing")).alias("upright")).alias("posture_groups")).alias("detector"),
        F.struct(F.lit(2.0).alias("merge_gap_seconds")).alias("event"),
        F.struct(F.lit(5).alias("smoothing_window")).alias("temporal"),
        F.struct(F.lit(30).alias("lost_track_buffer")).alias("tracking")))
    snap = F.to_json(F.struct(
        F.struct(F.struct(F.lit("standing").alias("0")).alias("class_names"),
                 F.col("conf").alias("confidence_threshold"), F.lit("posture_multiclass").alias("mode"),
                 F.col("variant").alias("model_variant"),
                 F.struct(F.array(F.lit("standing")).alias("upright")).alias("posture_groups"),
                 path.alias("weights_path")).alias("detector"),
        F.struct(F.lit(2.0).alias("merge_gap_seconds")).alias("event"),
        F.struct(F.lit(5).alias("smoothing_window")).alias("temporal"),
        F.struct(F.lit(30).alias("lost_track_buffer")).alias("tracking")))
    headers = base.select(
        "cycle_id", "report_id", F.col("report_id").alias("candidate_id"),
        F.lit(PR.REPORT_KIND).alias("validation_kind"), F.sha1(F.lit("commit")).alias("implementation_git_commit"),
        sha("impl").alias("pipeline_implementation_sha256"), F.lit(partition).alias("partition"),
        F.col("variant").alias("model_variant"), sha("weights").alias("weights_sha256"),
        path.alias("weights_path"), sha("config").alias("config_sha256"),
        sha("manifest").alias("manifest_sha256"), sha("protocol").alias("protocol_sha256"),
        F.array(F.lit(partition)).alias("metrics_partitions"),
        F.struct(*PR.COUNTS, *PR.RATIOS).alias("metrics"), params.alias("pipeline_parameters"),
        snap.alias("config_snapshot"))
    rows = rows.select("cycle_id", "report_id", "video_id", "subject_id", "partition", "expected_fall",
                       "predicted_fall")
    # clip ids have equal length, so their number is a position without a global sort
    selected = rows.select("cycle_id", "report_id",
                           F.substring("video_id", 2, 12).cast("long").alias("position"), "video_id")
    return headers, rows, selected, protocol_table(spark).filter(F.col("cycle_id") == cycle)


def faulty(spark, sf):
    """The development reports with one fault each in some reports."""
    h, rows, selected, protocol = reports(spark, sf, DEVELOPMENT, "faulty")
    at = F.col("report_id")
    n = F.substring("video_id", 2, 12).cast("long")
    h = h.withColumns({
        "implementation_git_commit": F.when(at == "nano-0.4", F.lit("zz")).otherwise(F.col("implementation_git_commit")),
        "weights_path": F.when(at == "nano-0.5", F.lit("")).otherwise(F.col("weights_path")),
        "manifest_sha256": F.when(at == "nano-0.6", sha("other")).otherwise(F.col("manifest_sha256")),
        "pipeline_parameters": F.when(at == "nano-0.7", F.replace(
            "pipeline_parameters", F.lit('"smoothing_window":5'), F.lit('"smoothing_window":7')))
        .otherwise(F.col("pipeline_parameters")),
        "metrics": F.when(at == "small-0.4", F.col("metrics").withField(
            "recall", F.lit(0.5).cast("double"))).otherwise(F.col("metrics"))})
    rows = rows.filter(~((at == "small-0.5") & (F.col("subject_id") == 26)))
    rows = rows.withColumn("partition", F.when(
        (at == "small-0.6") & (n % 100 == 1), F.lit(LOCKED)).otherwise(F.col("partition")))
    rows = rows.unionByName(rows.filter((at == "small-0.7") & (n % 500 == 2)))
    return h, rows, selected, protocol


FAULTS = f"""with r as ({ROWS_SQL}), d as (select * from r where partition = '{DEVELOPMENT}'),
  v as (select candidate_id as report_id, 'bad_commit' as rule, 1 as n from (select 'nano-0.4' as candidate_id)
    union all select 'nano-0.5', 'no_weights_path', 1 union all select 'nano-0.5', 'weights_differ_from_snapshot', 1
    union all select 'nano-0.7', 'parameters_differ_from_snapshot', 1
    union all select 'small-0.4', 'metrics_differ', 1 union all select 'small-0.5', 'metrics_differ', 1
    union all select 'small-0.7', 'metrics_differ', (count(*) > 0)::int from d where candidate_id = 'small-0.7' and video_key % 500 = 2
    union all select 'small-0.5', 'subject_not_covered', 1
    union all select 'small-0.5', 'selected_ids_differ', count(*) from d where candidate_id = 'small-0.5' and subject_id = 26
    union all select 'small-0.6', 'row_in_other_partition', (count(*) > 0)::int from d where candidate_id = 'small-0.6' and video_key % 100 = 1
    union all select 'small-0.7', 'duplicate_video_id', count(*) from d where candidate_id = 'small-0.7' and video_key % 500 = 2
    union all select 'small-0.7', 'selected_ids_differ', count(*) from d where candidate_id = 'small-0.7' and video_key % 500 = 2)
  select report_id, rule, n::bigint as violations from v where n > 0"""


@query("clip_metrics", f"""select candidate_id, partition, clips, true_positive_clips, false_positive_clips, false_negative_clips,
    true_negative_clips, {r6('precision', 'recall', 'specificity', 'f1')}
  from ({O.ratios(f"select candidate_id, partition, {O.METRICS} from ({ROWS_SQL}) group by 1, 2", "candidate_id, partition")})""")
def clip_metrics(spark, sf):
    return rounded(PR.clip_metrics(clip_rows(spark, sf), ["candidate_id", "partition"]))


GATE = Gate(0.40, 500_000_000)
RANKED = f"""select candidate_id, row_number() over (order by false_positive_clips, coalesce(f1, -1) desc, coalesce(recall, -1) desc,
    coalesce(specificity, -1) desc, case when variant = 'nano' then 0 else 1 end, conf, variant, candidate_id) as position
  from ({O.ratios(f"select candidate_id, variant, conf, {O.METRICS} from ({ROWS_SQL}) group by 1, 2, 3", "candidate_id, variant, conf")})
  where recall >= 0.4"""


@query("rank_candidates", f"select candidate_id, position::int as position from ({RANKED})")
def _(spark, sf):
    m = PR.clip_metrics(clip_rows(spark, sf), ["candidate_id", "variant", "conf"])
    m = m.withColumnsRenamed({"variant": "model_variant", "conf": "confidence_threshold"})
    return PR.rank_candidates(m, GATE).select("candidate_id", "position")


@query("candidate_order", f"select candidate_id from ({RANKED}) where position = 1")
def _(spark, sf):
    m = PR.clip_metrics(clip_rows(spark, sf), ["candidate_id", "variant", "conf"])
    m = m.withColumnsRenamed({"variant": "model_variant", "conf": "confidence_threshold"})
    return m.filter(PR.gate_passes(GATE)).orderBy(PR.candidate_order("nano")).limit(1).select("candidate_id")


@query("report_violations", FAULTS)
def _(spark, sf):
    h, rows, selected, protocol = faulty(spark, sf)
    found = PR.report_violations(h, rows, selected, protocol, DEVELOPMENT)
    return found.groupBy("report_id", "rule").agg(F.count("*").alias("violations"))


@query("report_comparability", f"""with r as ({ROWS_SQL}) select 'different_manifests' as rule, 1::bigint as violations
  union all select 'clip_not_in_all_reports', count(*) from r where partition = '{DEVELOPMENT}' and candidate_id = 'small-0.5' and subject_id = 26""")
def _(spark, sf):
    h, rows, _, _ = faulty(spark, sf)
    return PR.report_comparability(h, rows).groupBy("rule").agg(F.count("*").alias("violations"))


WINNER = f"""select candidate_id, false_positive_clips, round(f1, 6) as f1 from ({O.ratios(
    f"select candidate_id, variant, conf, {O.METRICS} from ({ROWS_SQL}) where partition = '{DEVELOPMENT}' group by 1, 2, 3", "candidate_id, variant, conf")})
  where recall >= 0.4 order by false_positive_clips, f1 desc, recall desc, specificity desc, case when variant = 'small' then 0 else 1 end, conf limit 1"""


@query("select_candidate", WINNER)
def _(spark, sf):
    lock, _ = PR.select_candidate(*reports(spark, sf, DEVELOPMENT), GATE, "small")
    return rounded(lock.select("candidate_id", "false_positive_clips", "f1"))


@query("confirm_candidate", f"""select candidate_id, false_positive_clips, round(recall, 6) as recall from ({O.ratios(
    f"select candidate_id, {O.METRICS} from ({ROWS_SQL}) where partition = '{VALIDATION}' and candidate_id = 'small-0.8' group by 1", "candidate_id")})
  where recall >= 0.4 and candidate_id = (select candidate_id from ({WINNER}))""")
def _(spark, sf):
    h, rows, selected, protocol = reports(spark, sf, VALIDATION)
    dev = reports(spark, sf, DEVELOPMENT)
    lock, _ = PR.select_candidate(*dev, GATE, "small")
    one = F.col("report_id") == "small-0.8"
    ok, _ = PR.confirm_candidate(lock, dev[1], h.filter(one), rows.filter(one), selected.filter(one),
                                 protocol, GATE)
    return rounded(ok.select("candidate_id", "false_positive_clips", "recall"))


@query("unlocked_clips", f"""select partition, count(*) as clips from ({ROWS_SQL}) where candidate_id = 'small-0.8' group by 1""")
def _(spark, sf):
    clips = clip_rows(spark, sf).filter("candidate_id = 'small-0.8'").withColumn("cycle_id", F.lit("clean"))
    h, *_ = reports(spark, sf, VALIDATION)
    confirmed = h.filter("report_id = 'small-0.8'")
    run = confirmed.select("cycle_id", "manifest_sha256", "protocol_sha256", "model_variant",
                           "weights_sha256", "pipeline_parameters", "pipeline_implementation_sha256")
    return PR.unlocked_clips(clips, confirmed, run).groupBy("partition").agg(F.count("*").alias("clips"))


@query("reused_clips", f"""select distinct video_id from ({ROWS_SQL}) where partition = '{VALIDATION}' and video_key % 10 = 3""")
def _(spark, sf):
    rows = clip_rows(spark, sf).withColumn("cycle_id", F.lit("clean"))
    val = rows.filter(F.col("partition") == VALIDATION)
    dev = rows.filter((F.col("partition") == DEVELOPMENT) | (F.col("video_key") % 10 == 3))
    return PR.reused_clips(dev, val).select("video_id")


@query("protocol_subjects", f"""select candidate_id as report_id, rule, detail from (
  select distinct candidate_id, 'subject_outside_partition' as rule, cast(subject_id as varchar) as detail from ({ROWS_SQL})
  where partition <> '{VALIDATION}')""")
def _(spark, sf):
    rows = clip_rows(spark, sf).withColumn("cycle_id", F.lit("clean"))
    return PR.protocol_subjects(rows, protocol_table(spark), VALIDATION).select("report_id", "rule", "detail")


@query("partition_overlap", """with s as (select distinct o_custkey % 29 + 1 as subject_id, o_custkey % 7 as p from orders)
  select cast(subject_id as int) as subject_id, string_agg('p' || p, ',' order by p) as partitions from s group by 1 having count(*) > 1""")
def _(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(
        F.lit("c").alias("cycle_id"), (F.col("o_custkey") % 29 + 1).cast("int").alias("subject_id"),
        F.concat(F.lit("p"), F.col("o_custkey") % 7).alias("partition")).distinct()
    return PR.partition_overlap(o).select("subject_id", "partitions")


@query("candidate_grid", f"""select c.variant, c.preset, count(*) as clips from ({X.CLIPS}) cross join (select v.variant, p.preset from
  (values ('nano'), ('small')) v(variant) cross join (values ('high_recall'), ('balanced_short'), ('balanced_duration'), ('high_precision'),
  ('precision_040'), ('precision_050'), ('precision_060'), ('precision_070'), ('precision_075'), ('precision_080')) p(preset)) c group by 1, 2""")
def _(spark, sf):
    grid = PR.candidate_grid(spark, ("nano", "small"), "both")
    clips = X.load(spark, sf, X.CLIPS).select("clip_key")
    return clips.crossJoin(SL.small(grid)).groupBy("variant", "preset").agg(F.count("*").alias("clips"))


def candidate_sql() -> str:
    """The whole cascade once per preset, each as its own subquery."""
    parts = []
    for name, v in PR.preset_values("both").items():
        th = Thresholds(*v[2:])
        obs = f"""select * from (select * replace (0.1 + (detection_id * 7 % 90) / 100.0::double as confidence) from ({X.SPARSE})) where confidence >= {v[0]}"""
        moves = O.motion(obs, True, th)
        parts.append(f"""select '{name}' as preset, {v[0]}::double as confidence_threshold, c.* from (
          {O.ctes(*O.lifecycle(moves))}, hit as (select distinct source_id, session_id from events_out),
          cl as (select distinct source_id, session_id from frames)
          select cl.session_id, hit.session_id is not null as predicted_fall from cl left join hit using (source_id, session_id)) c""")
    return " union all ".join(parts)


# the label of a clip is a digit of its session id
EVALUATED = f"""select variant || '-' || preset as candidate_id, variant, confidence_threshold, {O.METRICS} from (
  select *, cast(substr(session_id, 2) as bigint) % 2 = 0 as expected_fall from ({candidate_sql()}))
  cross join (values ('nano'), ('small')) as v(variant) group by 1, 2, 3"""


@query("evaluate_candidates", f"""select candidate_id, variant, confidence_threshold, clips, true_positive_clips, false_positive_clips,
  false_negative_clips, true_negative_clips, {r6('precision', 'recall', 'specificity', 'f1')}
  from ({O.ratios(EVALUATED, 'candidate_id, variant, confidence_threshold')})""")
def evaluate_candidates(spark, sf):
    obs, frames, w = cam(spark, sf, gather=False)
    obs = obs.withColumn("confidence", 0.1 + (F.col("detection_id") * 7 % 90) / 100.0)
    clips = frames.select(*SCOPE).distinct().withColumn(
        "expected_fall", F.substring("session_id", 2, 18).cast("long") % 2 == 0)
    _, metrics = C.evaluate_candidates(obs, frames, clips, PR.candidate_grid(spark, ("nano", "small"), "both"), w)
    return rounded(metrics)


CLIP_EVENTS = f"""{LIFE}, ce as (select source_id || '/' || session_id as video_id, count(*) as predicted_event_count,
    min(start_time) as first_event_start_seconds from events_out group by 1),
  cl as (select distinct source_id || '/' || session_id as video_id from frames)"""


def clip_table(frames: DataFrame) -> DataFrame:
    return frames.select(F.concat_ws("/", *SCOPE).alias("video_id")).distinct()


@query("clip_predictions", f"""{CLIP_EVENTS} select cl.video_id, coalesce(predicted_event_count, 0) as predicted_event_count,
  predicted_event_count is not null as predicted_fall, {r6('first_event_start_seconds')} from cl left join ce using (video_id)""")
def _(spark, sf):
    log, _, frames, _ = event_log(spark, sf)
    ev = E.latest_event_state(E.event_changes(log)).withColumn("video_id", F.concat_ws("/", *SCOPE))
    return rounded(PR.clip_predictions(clip_table(frames), ev))


@query("clip_rollup", f"{CLIP_EVENTS} select video_id, predicted_event_count, {r6('first_event_start_seconds')} from ce")
def _(spark, sf):
    return rounded(PR.clip_rollup(events_of(spark, sf).withColumn("video_id", F.concat_ws("/", *SCOPE))))


# --- dataset quality -----------------------------------------------------------------------------

def coco(spark, sf):
    return (X.load(spark, sf, X.IMAGES), X.load(spark, sf, X.ANNOTATIONS),
            X.load(spark, sf, X.CATEGORIES).withColumn("supercategory", F.lit("none")))


CLIPPED = f"""select *, greatest(abs(greatest(least(x, 640.0), 0) - x), abs(greatest(least(y, 480.0), 0) - y),
    abs(greatest(least(x + w, 640.0), 0) - (x + w)), abs(greatest(least(y + h, 480.0), 0) - (y + h))) as clip_pixels from ({X.ANNOTATIONS})"""
KEEP_CLIP = "clip_pixels <= 0.05 + 1e-9 and w > 0 and h > 0 and least(x + w, 640.0) - x > 0"


@query("clip_bbox_rounding", f"""select annotation_id, {r6('x', 'y')}, round(case when clip_pixels > 0 then least(x + w, 640.0) - x else w end, 6) as w,
  round(h, 6) as h, round(clip_pixels, 6) as clip_pixels from ({CLIPPED}) where {KEEP_CLIP}""")
def _(spark, sf):
    images, ann, _ = coco(spark, sf)
    return rounded(Q.clip_bbox_rounding(ann, images)[0].select("annotation_id", "x", "y", "w", "h", "clip_pixels"))


@query("clip_bbox_rejects", f"""select annotation_id from ({CLIPPED}) where not ({KEEP_CLIP})""")
def _(spark, sf):
    images, ann, _ = coco(spark, sf)
    return Q.clip_bbox_rounding(ann, images)[1].select("annotation_id")


@query("bbox_adjustment_summary", f"""select split, count(*) filter (where clip_pixels > 0) as adjusted,
  round(coalesce(max(case when clip_pixels > 0 then clip_pixels end), 0), 6) as maximum_clip_pixels from ({CLIPPED}) where {KEEP_CLIP} group by split""")
def _(spark, sf):
    images, ann, _ = coco(spark, sf)
    return rounded(Q.bbox_adjustment_summary(Q.clip_bbox_rounding(ann, images)[0]))


@query("bbox_adjustment_examples", f"""select split, annotation_id, position::int as position from (select *, row_number() over (partition by split order by annotation_id) as position
  from ({CLIPPED}) where {KEEP_CLIP} and clip_pixels > 0) where position <= 20""")
def _(spark, sf):
    images, ann, _ = coco(spark, sf)
    return Q.bbox_adjustment_examples(Q.clip_bbox_rounding(ann, images)[0]).select("split", "annotation_id", "position")


@query("remap_categories", f"select annotation_id, category_id - 1 as category_id from ({X.ANNOTATIONS})")
def _(spark, sf):
    _, ann, cats = coco(spark, sf)
    mapping, _ = Q.category_keepers(ann, cats)
    return Q.remap_categories(ann, mapping).select("annotation_id", "category_id")


@query("category_keepers", f"""select c.category_id, c.name, case c.category_id when 0 then 1 else c.category_id end as keeper_id,
    case c.category_id when 0 then 0 else c.category_id - 1 end as new_category_id, c.category_id = 0 as dropped,
    (select count(*) from ({X.ANNOTATIONS}) a where a.category_id = c.category_id) as annotations
  from ({X.CATEGORIES}) c where split = 'train'""")
def _(spark, sf):
    _, ann, cats = coco(spark, sf)
    return Q.category_keepers(ann, cats)[0]


@query("category_usage", f"""select c.split, c.category_id, c.name, count(a.annotation_id) as annotations from ({X.CATEGORIES}) c
  left join ({X.ANNOTATIONS}) a on a.split = c.split and a.category_id = c.category_id group by 1, 2, 3""")
def _(spark, sf):
    _, ann, cats = coco(spark, sf)
    return Q.category_usage(ann, cats)


@query("split_summary", f"""with a as (select split, category_id, count(*) as n from ({X.ANNOTATIONS}) group by 1, 2),
  s as (select split, sum(n)::bigint as annotations, string_agg(name || '=' || n, ',' order by category_id) as class_annotations
    from a join ({X.CATEGORIES}) c using (split, category_id) group by split)
  select s.split, i.images, s.annotations, s.class_annotations from s join (select split, count(*) as images from ({X.IMAGES}) group by split) i using (split)""")
def _(spark, sf):
    return Q.split_summary(*coco(spark, sf))


@query("union_splits", f"select split, count(*) as images from ({X.IMAGES}) group by split")
def _(spark, sf):
    images, _, _ = coco(spark, sf)
    parts = {s: images.filter(F.col("split") == s).drop("split") for s in Q.SPLIT_ORDER}
    return Q.union_splits(parts).groupBy("split").agg(F.count("*").alias("images"))


DUP = "count(*) over (partition by split, annotation_id) > 1 as dup"


@query("validate_coco", f"""select split, annotation_id, concat_ws(',', case when dup then 'duplicate_annotation_id' end,
    case when image_id % 40 = 0 then 'unknown_image' end,
    case when category_id = 4 then 'unknown_category' end,
    case when image_id % 40 <> 0 and (x + w > 640 + 1e-6 or y + h > 480 + 1e-6 or w <= 0) then 'box_outside_image' end) as errors
  from (select *, {DUP} from ({X.ANNOTATIONS})) where dup or image_id % 40 = 0 or category_id = 4 or x + w > 640 + 1e-6 or y + h > 480 + 1e-6 or w <= 0""")
def _(spark, sf):
    images, ann, cats = coco(spark, sf)
    _, bad = Q.validate_coco_annotations(ann, images.filter("image_id % 40 <> 0"), cats.filter("category_id <> 4"))
    return bad.select("split", "annotation_id", F.array_join("_errors", ",").alias("errors"))


@query("validate_coco_images", f"""select split, image_id, case when image_id % 9 = 0 then 'path_escapes_split' else 'bad_size' end as errors
  from ({X.IMAGES}) where image_id % 9 = 0 or image_id % 11 = 0 and image_id % 9 <> 0""")
def _(spark, sf):
    images, _, _ = coco(spark, sf)
    i = F.col("image_id")
    broken = images.withColumns({
        "file_name": F.when(i % 9 == 0, F.concat(F.lit("a/../../"), "file_name")).otherwise(F.col("file_name")),
        "width": F.when((i % 11 == 0) & (i % 9 != 0), F.lit(0)).otherwise(F.col("width"))})
    return Q.validate_coco_images(broken)[1].select("split", "image_id", F.array_join("_errors", ",").alias("errors"))


@query("annotation_integrity", f"""select split, annotation_id, 'unknown_image' as rule from ({X.ANNOTATIONS}) where image_id % 40 = 0
  union all select split, annotation_id, 'unknown_category' from ({X.ANNOTATIONS}) where category_id = 4""")
def _(spark, sf):
    images, ann, cats = coco(spark, sf)
    return Q.annotation_integrity(ann, images.filter("image_id % 40 <> 0"), cats.filter("category_id <> 4"))


@query("cross_split_exact_duplicates", f"""with i as ({X.IMAGES}), g as (select content_hash, string_agg(distinct split, ',' order by split) as splits,
    count(*) as copies from i group by 1 having count(distinct split) > 1)
  select i.content_hash, i.file_name, i.split, g.splits, g.copies from i join g using (content_hash)""")
def _(spark, sf):
    return Q.cross_split_exact_duplicates(X.load(spark, sf, X.IMAGES), "content_hash", "file_name").select(
        "content_hash", "file_name", "split", "splits", F.col("copies").cast("long").alias("copies"))


def hashes(spark, sf) -> DataFrame:
    px = spark.sql(X.PIXELS_SPARK.replace("from embeddings", "from {embeddings}"),
                   embeddings=spark.read.parquet(f"{sf}/embeddings.parquet"))
    return px.select("image_id", F.concat(F.lit("s"), F.col("split")).alias("split"),
                     FN.difference_hash(F.col("px")).alias("dhash"),
                     F.sha2(F.array_join(F.transform("px", lambda v: v.cast("string")), ","), 256).alias("sha256"))


ORDER = ("s0", "s1", "s2")


@query("difference_hash", f"""select image_id, array_to_string(list_transform(range(0, 16), lambda j:
    format('{{:x}}', bits[4 * j + 1] * 8 + bits[4 * j + 2] * 4 + bits[4 * j + 3] * 2 + bits[4 * j + 4])), '') as dhash64 from ({O.HASHED})""")
def _(spark, sf):
    return hashes(spark, sf).select("image_id", FN.hash_hex(F.col("dhash")).alias("dhash64"))


@query("near_duplicate_pairs", f"""with hashed as materialized ({O.HASHED}), near as ({O.NEAR})
  select 's' || first_split as first_split, 's' || second_split as second_split, distance::int as distance, count(*) as pairs
  from near where distance <= 4 group by 1, 2, 3""")
def near_duplicate_pairs(spark, sf):
    g = Q.near_duplicate_groups(hashes(spark, sf), 4, ORDER)
    return g.groupBy("first_split", "second_split", "distance").agg(F.sum("pairs").alias("pairs"))


@query("near_duplicate_examples", f"""with hashed as materialized ({O.HASHED}), near as ({O.NEAR})
  select 's' || first_split as first_split, 's' || second_split as second_split, first_id, second_id, distance::int as distance
  from near where distance <= 4 order by 1, 2, 3, 4 limit 100""")
def _(spark, sf):
    files = hashes(spark, sf)
    return Q.near_duplicate_examples(files, Q.near_duplicate_groups(files, 4, ORDER), 100, ORDER)


def audited(spark, sf) -> tuple[DataFrame, DataFrame]:
    images = X.load(spark, sf, X.IMAGES)
    old = images.filter("image_id % 13 <> 0").select(F.col("file_name").alias("path"), F.col("content_hash").alias("sha256"))
    changed = F.when(F.col("image_id") % 17 == 0, F.md5("file_name")).otherwise(F.col("content_hash"))
    new = images.filter("image_id % 19 <> 0").select(F.col("file_name").alias("path"), changed.alias("sha256"))
    return old, new


DRIFT = f"""select file_name as path, case when image_id % 19 = 0 then 'missing' when image_id % 13 = 0 then 'unaudited' else 'changed' end as status
  from ({X.IMAGES}) where (image_id % 13 <> 0 and image_id % 19 = 0) or (image_id % 13 = 0 and image_id % 19 <> 0)
    or (image_id % 13 <> 0 and image_id % 19 <> 0 and image_id % 17 = 0)"""


@query("manifest_drift", DRIFT)
def _(spark, sf):
    return Q.manifest_drift(*audited(spark, sf))


@query("schema_equality", f"""select 'test' as split, 3::bigint as category_id, 'sitting' as name, 'missing' as rule
  union all select 'test', 3, 'kneeling', 'unexpected'""")
def _(spark, sf):
    _, ann, cats = coco(spark, sf)
    # categories in use, with one renamed in one split
    used = cats.join(ann.select("split", "category_id").distinct(), ["split", "category_id"], "left_semi")
    other = F.when((F.col("split") == "test") & (F.col("category_id") == 3), F.lit("kneeling")).otherwise(F.col("name"))
    return Q.check_category_schema(used.withColumn("name", other))


@query("class_set_check", f"""select split, string_agg(distinct lower(name), ',' order by lower(name)) as names, true as as_expected
  from ({X.CATEGORIES}) join (select distinct split, category_id from ({X.ANNOTATIONS})) using (split, category_id) group by split""")
def _(spark, sf):
    _, ann, cats = coco(spark, sf)
    used = cats.join(ann.select("split", "category_id").distinct(), ["split", "category_id"], "left_semi")
    return Q.class_set_check(used)


@query("audit_dataset", f"""with hashed as materialized ({O.HASHED}), near as ({O.NEAR})
  select (select count(*) from hashed) as images_total, 0::bigint as exact_duplicate_contents,
    (select count(*) from near where distance <= 4) as near_duplicate_pairs, false as original_split_evaluation_eligible""")
def _(spark, sf):
    files = hashes(spark, sf).withColumn("relative_path", F.col("image_id").cast("string"))
    return D.audit_dataset(*coco(spark, sf), files, 4, ORDER).verdict


@query("audit_violations", f"""select rule, count(*) as rows from (select 'box_outside_image' as rule from ({X.ANNOTATIONS})
  where x + w > 640 + 1e-6 or y + h > 480 + 1e-6 or w <= 0
  union all select 'duplicate_annotation_id' from (select {DUP} from ({X.ANNOTATIONS})) where dup) group by rule""")
def _(spark, sf):
    return D.audit_violations(*coco(spark, sf)).groupBy("rule").agg(F.count("*").alias("rows"))


@query("normalize_dataset", f"""select split, category_id - 1 as category_id, count(*) as annotations, round(sum(case when clip_pixels > 0 then least(x + w, 640.0) - x else w end), 4) as total_width
  from ({CLIPPED}) where {KEEP_CLIP} group by 1, 2""")
def _(spark, sf):
    out = D.normalize_dataset(*coco(spark, sf)).annotations
    return out.groupBy("split", "category_id").agg(
        F.count("*").alias("annotations"), F.round(F.sum("w"), 4).alias("total_width"))


@query("training_gate", f"""select rule, count(*) as rows from (
    select case when image_id % 19 = 0 then 'file_missing' else 'file_changed' end as rule from ({X.IMAGES})
    where (image_id % 13 <> 0 and image_id % 19 = 0) or (image_id % 13 <> 0 and image_id % 19 <> 0 and image_id % 17 = 0)
    union all select 'audit_box_outside_image' union all select 'class_not_configured' union all select 'class_not_audited'
    union all select distinct 'audit_duplicate_annotation_id' from (select {DUP} from ({X.ANNOTATIONS})) where dup) group by rule""")
def _(spark, sf):
    images, ann, cats = coco(spark, sf)
    mapping, _ = Q.category_keepers(ann, cats)
    gate = D.training_gate(D.audit_violations(images, ann, cats), D.posture_profile(mapping),
                           {0: "fallen", 1: "lying", 2: "kneeling", 3: "standing"}, *audited(spark, sf))
    return gate.groupBy("rule").agg(F.count("*").alias("rows"))


# --- manifests -----------------------------------------------------------------------------------

def clips_of(spark, sf) -> DataFrame:
    clips, _ = MF.parse_clip_path(X.load(spark, sf, X.CLIPS))
    return clips.withColumn("partition", MF.partition_of(F.col("subject_id")))


@query("parse_clip_path", f"select video_id, subject_id, location_id, label from ({O.CLIPS})")
def _(spark, sf):
    return clips_of(spark, sf).select("video_id", "subject_id", "location_id", "label")


@query("auxiliary_clips", f"select relative_path from ({X.CLIPS}) where relative_path like '%timelapse%'")
def _(spark, sf):
    return MF.parse_clip_path(X.load(spark, sf, X.CLIPS))[1]


@query("dedupe_clips", f"""select c.relative_path as excluded, k.relative_path as kept from ({O.CLIPS}) c join ({O.KEPT}) k using (sha256)
  where c.relative_path <> k.relative_path""")
def _(spark, sf):
    return MF.dedupe_clips(clips_of(spark, sf))[1].select("excluded", "kept")


@query("dedupe_conflicts", f"""select sha256 from (select md5(label) as sha256, subject_id from ({O.CLIPS})) group by 1 having count(distinct subject_id) > 1""")
def _(spark, sf):
    merged = clips_of(spark, sf).withColumn("sha256", F.md5("label"))
    return MF.dedupe_clips(merged)[2]


@query("first_n_per_group", f"""select video_id from (select *, row_number() over (partition by subject_id, label order by relative_path) as r from ({O.KEPT})) where r <= 3""")
def _(spark, sf):
    kept, _, _ = MF.dedupe_clips(clips_of(spark, sf))
    return MF.first_n_per_group(kept, 3)[0].filter("small_validation_subset").select("video_id")


@query("subject_inventory", f"""select cast(30 as int) as subject_id, 'missing' as status
  union all select distinct subject_id, 'extra' from ({O.CLIPS}) where subject_id > 25 and subject_id < 30""")
def _(spark, sf):
    return MF.subject_inventory(clips_of(spark, sf), (*range(1, 26), 30))


@query("group_leakage", f"""select subject_id, string_agg(distinct p, ',' order by p) as splits from (select subject_id, case when clip_key % 100 = 3 then 'x' else partition end as p from ({O.CLIPS}))
  group by 1 having count(distinct p) > 1""")
def _(spark, sf):
    leaky = clips_of(spark, sf).withColumn(
        "partition", F.when(F.col("clip_key") % 100 == 3, F.lit("x")).otherwise(F.col("partition")))
    return MF.group_leakage(leaky, "subject_id", "partition")


@query("manifest_audit", f"""select 'label' as kind, label as value, count(*) as clips from ({O.KEPT}) group by label
  union all select 'partition', partition, count(*) from ({O.KEPT}) group by partition
  union all select 'subject_label', subject_id || '/' || label, count(*) from ({O.KEPT}) group by subject_id, label
  union all select 'all', '', count(*) from ({O.KEPT})""")
def manifest_audit(spark, sf):
    return MF.manifest_audit(MF.dedupe_clips(clips_of(spark, sf))[0])


@query("subject_labels", f"select subject_id, string_agg(distinct label, ',' order by label) as labels from ({O.CLIPS}) group by 1")
def _(spark, sf):
    return MF.subject_labels(clips_of(spark, sf))


@query("duplicate_hashes", f"select sha256, count(*) as copies from ({O.CLIPS}) group by 1 having count(*) > 1")
def _(spark, sf):
    return MF.duplicate_hashes(clips_of(spark, sf))


@query("declared_counts_check", f"""select partition, label, 10::bigint as declared, count(*) as clips from ({O.CLIPS}) group by 1, 2 having count(*) <> 10
  union all select 'holdout', 'fall', 10, 0""")
def _(spark, sf):
    clips = clips_of(spark, sf)
    declared = clips.select("partition", "label").distinct().withColumn("clips", F.lit(10).cast("long"))
    extra = declared.limit(1).select(F.lit("holdout").alias("partition"), F.lit("fall").alias("label"), "clips")
    return MF.declared_counts_check(clips, declared.unionByName(extra))


@query("select_clips", f"""select video_id from (select *, row_number() over (partition by subject_id, label order by relative_path) as r from ({O.KEPT}))
  where r <= 3 and partition = '{LOCKED}'""")
def _(spark, sf):
    kept, _, _ = MF.dedupe_clips(clips_of(spark, sf))
    return MF.select_clips(MF.first_n_per_group(kept, 3)[0], LOCKED, small_only=True).select("video_id")


@query("build_clip_manifest", f"""select video_id, subject_id, partition, r <= 3 as small_validation_subset, round(frames / fps, 6) as duration_seconds
  from (select *, row_number() over (partition by subject_id, label order by relative_path) as r from ({O.KEPT}))""")
def build_clip_manifest(spark, sf):
    out = MN.build_clip_manifest(X.load(spark, sf, X.CLIPS))
    return rounded(out.clips.select("video_id", "subject_id", "partition", "small_validation_subset", "duration_seconds"))


@query("content_fingerprint", """with leaf as (select sha256(part) as p, sha256(part || chr(10) || md5(part)) as d from (select p_name || '/' || p_partkey as part from part)),
  a as (select substr(p, 1, 4) as p, sha256(string_agg(d, '' order by d)) as d from leaf group by 1),
  b as (select substr(p, 1, 2) as p, sha256(string_agg(d, '' order by d)) as d from a group by 1)
  select sha256(string_agg(d, '' order by d)) as fingerprint from b""")
def _(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    path = F.concat_ws("/", "p_name", "p_partkey")
    return R.content_fingerprint(part.select(path.alias("path"), F.md5(path).alias("sha256")))


# --- samples -------------------------------------------------------------------------------------

def samples(spark, sf) -> DataFrame:
    return X.load(spark, sf, X.SAMPLES)


def full_samples(spark, sf) -> DataFrame:
    image = ("transform(sequence(1, image_count), i -> named_struct('path', concat('img/', conv_id, '-', turn, '-', i, '.jpg'), "
             "'sha256', sha2(concat(conv_id, i), 256), 'width', 64, 'height', 64, 'kind', 'person_crop', 'retained', true))")
    target = F.struct(
        "decision", F.lit(0.5).alias("confidence"), F.lit("label").alias("reason"),
        F.lit(None).cast("boolean").alias("attempt_to_stand"), F.lit("low").alias("risk_level"),
        (F.col("decision") == "fall").alias("model_recommends_alert"), "ground_truth_verified")
    return samples(spark, sf).withColumn("image_refs", F.expr(image)).withColumn("target", target)


@query("validate_samples", f"select sample_id, 'target_not_verified' as errors from ({X.SAMPLES}) where not ground_truth_verified")
def _(spark, sf):
    return S.validate_samples(samples(spark, sf))[1].select("sample_id", F.array_join("_errors", ",").alias("errors"))


@query("pack_messages", f"""select sample_id, 0 as turn, 'user' as role, image_count + 1 as parts, cast(null as varchar) as answer from ({X.SAMPLES})
  union all select sample_id, 1, 'assistant', 0, '{{"decision":"' || decision || '","confidence":0.5,"reason":"label","attempt_to_stand":null,"risk_level":"low","model_recommends_alert":'
    || (case when decision = 'fall' then 'true' else 'false' end) || '}}' from ({X.SAMPLES})""")
def _(spark, sf):
    turns = S.message_turns(S.pack_messages(full_samples(spark, sf)))
    return turns.select("sample_id", "turn", "role", F.size("content").alias("parts"), "answer")


@query("missing_image_refs", f"""select sample_id, 'img/' || conv_id || '-' || turn || '-' || i || '.jpg' as path
  from (select *, unnest(range(1, image_count + 1)) as i from ({X.SAMPLES})) where conv_id % 5 = 2""")
def _(spark, sf):
    full = full_samples(spark, sf)
    have = full.filter("conv_id % 5 <> 2").select(F.explode("image_refs.path").alias("path"))
    return S.missing_image_refs(full, have).select("sample_id", "path")


@query("validate_semantic_manifests", f"""select rule, count(*) as rows from (
    select 'target_not_verified' as rule from ({X.SAMPLES}) where not ground_truth_verified
    union all select 'too_many_images' from ({X.SAMPLES}) where image_count > 3
    union all select 'group_in_two_splits' from (select split_group from (select split_group, case when conv_id % 21 = 1 then 'test' else split end as s from ({X.SAMPLES})) group by 1 having count(distinct s) > 1))
  group by rule""")
def _(spark, sf):
    moved = samples(spark, sf).withColumn("split", F.when(F.col("conv_id") % 21 == 1, F.lit("test")).otherwise(F.col("split")))
    return D.validate_semantic_manifests(moved, 3)[0].groupBy("rule").agg(F.count("*").alias("rows"))


@query("manifest_counts", f"select split, count(*) as records from ({X.SAMPLES}) group by split")
def _(spark, sf):
    return R.manifest_counts(samples(spark, sf))


@query("split_by_group", """with g as (select distinct conv_id as g from conversations), n as (select count(*) as n from g)
  select 'train' as split, cast(round_even(n * 0.7, 0) as bigint) as groups from n
  union all select 'validation', cast(round_even(n * 0.15, 0) as bigint) from n
  union all select 'test', n - cast(round_even(n * 0.7, 0) as bigint) - cast(round_even(n * 0.15, 0) as bigint) from n""")
def _(spark, sf):
    out = S.split_by_group(samples(spark, sf), "conv_id")
    return out.select("conv_id", "split").distinct().groupBy("split").agg(F.count("*").alias("groups"))


# --- reporting -----------------------------------------------------------------------------------

@query("stage_latency_summary", f"""select stage, count(*) as count, round(avg(latency_ms), 6) as mean_ms, round(quantile_cont(latency_ms, 0.5), 6) as p50_ms,
  round(quantile_cont(latency_ms, 0.95), 6) as p95_ms, round(max(latency_ms), 6) as maximum_ms from ({X.LATENCY}) group by stage""")
def stage_latency_summary(spark, sf):
    return rounded(R.stage_latency_summary(X.load(spark, sf, X.LATENCY)))


@query("nearest_rank_latency", f"""select stage, count(*) as count, round(avg(latency_ms), 6) as mean_ms, round(quantile_cont(latency_ms, 0.5), 6) as median_ms,
  round(min(latency_ms), 6) as minimum_ms, round(max(latency_ms), 6) as maximum_ms,
  round(list_sort(list(latency_ms))[cast(round_even((count(*) - 1) * 0.95, 0) as bigint) + 1], 6) as p95_ms from ({X.LATENCY}) group by stage""")
def _(spark, sf):
    return rounded(R.nearest_rank_latency(X.load(spark, sf, X.LATENCY)))


@query("stage_throughput", f"""select stage, round(1000 / avg(latency_ms), 6) as per_second from ({X.LATENCY})
  where stage in ('detection', 'tracking', 'temporal') group by stage having avg(latency_ms) > 0""")
def _(spark, sf):
    return rounded(R.stage_throughput(X.load(spark, sf, X.LATENCY)))


@query("session_id", """select user_id, regexp_replace(trim(event_type || '  ' || user_id), '\\s+', '-', 'g') || '-' || substr(sha256(cast(user_id as varchar)), 1, 12) as session_id
  from (select distinct user_id, event_type from events)""")
def _(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_type").distinct()
    name = F.concat(F.lit(" "), F.col("event_type"), F.lit("  "), F.col("user_id").cast("string"))
    return ev.select("user_id", FN.session_id(name, F.col("user_id")).alias("session_id"))


@query("hash_formats", """select p_partkey, p_partkey % 3 = 0 as sha_ok, p_partkey % 3 = 1 as commit_ok from part""")
def _(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    k = F.col("p_partkey")
    text = (F.when(k % 3 == 0, F.sha2("p_name", 256)).when(k % 3 == 1, F.sha1("p_name"))
            .otherwise(F.upper(F.sha2("p_name", 256))))
    return part.select("p_partkey", FN.is_sha256(text).alias("sha_ok"), FN.is_commit(text).alias("commit_ok"))


# --- streaming -----------------------------------------------------------------------------------

def shared_folder(spark: SparkSession) -> str:
    """A new folder below the cluster's shared checkpoint folder."""
    from kinewatch.operators.lineage import checkpoint_folder

    return f"{checkpoint_folder(spark)}/run-{uuid.uuid4().hex}"


def stream_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a stream of frames with one observation each."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    raw.createOrReplaceTempView("kinewatch_stream_events")
    sql = X.TRACKED.replace("{US}", X.US_SPARK).replace("from events", "from kinewatch_stream_events")
    seen = F.struct("track_id", "x1", "y1", "x2", "y2", "class_name")
    return spark.sql(sql).select(*SCOPE, "frame_id", T, "frame_width", "frame_height",
                                 F.to_json(F.array(seen)).alias("obs"))


@query("stream_cascade", f"""{O.ctes(*O.motion(X.TRACKED))} select {O.K}, frame_id, previous_state, next_state, reason from moves""")
def stream_cascade(spark, sf):
    from kinewatch.streaming.cascade import stream_cascade as run

    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    at = shared_folder(spark)
    q = (run(stream_rows(spark, sf), P).writeStream.format("parquet").option("path", f"{at}/out")
         .option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.read.parquet(f"{at}/out").filter("kind = 'transition'")
    track = F.col("track_id").cast("int").alias("track_id")  # the type in the given tables
    return out.select(*SCOPE, track, "frame_id", "previous_state", "next_state", "reason")


LATE = "frame_id % 11 = 4"


def routed(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """Rows of one kind from a stream in time order whose last files repeat some old frames.

    Each step of time is written in one go with a scope in one file, and a trigger takes the files of about a step.
    There are two files for every core, so that no file grows with the input alone.
    """
    from kinewatch.operators.lineage import cut
    from kinewatch.streaming.cascade import frame_rows, read_kind, route, stream_cascade as run

    at, files = shared_folder(spark), max(4, 2 * spark.sparkContext.defaultParallelism)
    rows = cut(frame_rows(X.load(spark, sf, X.FRAMES), X.load(spark, sf, X.SPARSE)))  # read by every step
    for step in range(3):
        part = rows.filter((F.col(T) >= 10.0 * step) & (F.col(T) < 10.0 * (step + 1)))
        part.repartition(files, *SCOPE).write.mode("append").parquet(f"{at}/in")
    rows.filter(LATE).repartition(files, *SCOPE).write.mode("append").parquet(f"{at}/in")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{at}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = run(source, P)
    route(out, f"{at}/out", f"{at}/state").awaitTermination()
    return read_kind(spark, f"{at}/out", kind, out.schema).withColumn("track_id", F.col("track_id").cast("int"))


@query("stream_late_rows", f"""select source_id, session_id, frame_id, round(timestamp_seconds, 6) as timestamp_seconds
  from ({X.duck(X.FRAMES)}) where {LATE}""")
def _(spark, sf):
    return rounded(routed(spark, sf, "late").select(*SCOPE, "frame_id", T))


@query("stream_events", f"{LIFE} select {EVENT_SQL} from events_out")
def _(spark, sf):
    return rounded(E.latest_event_state(routed(spark, sf, "change")).select(*TRACK, *EVENT_COLS))


@query("stream_reviews", f"""{LIFE} select {O.K}, start_frame, review_frame as frame_id,
  round(review_time, 6) as timestamp_seconds from events_out where review_frame is not null""")
def _(spark, sf):
    return rounded(routed(spark, sf, "review").select(*TRACK, "start_frame", "frame_id", T))


@query("ablation_levels", f"""{LIFE}, per as (select 'detections' as stage, 0 as since, (select count(*) from obs) as n
    union all select 'tracked', 1, (select count(*) from obs) union all select 'transitions', 2, (select count(*) from moves)
    union all select 'events', 2, (select count(*) from events_out)
    union all select 'reviews', 3, (select count(*) from events_out where review_frame is not null))
  select l.level, per.stage, per.n as rows from (values ('detector_only', 0), ('detector_tracking', 1), ('temporal', 2), ('full', 3)) as l(level, depth)
  join per on per.since <= l.depth""")
def _(spark, sf):
    """Which tables each level of the cascade gives, and how many rows they hold."""
    obs, frames, _ = cam(spark, sf)
    out = None
    for level in C.LEVELS:
        run = C.run_cascade(frames, obs, P, level)
        for stage in ("detections", "tracked", "transitions", "events", "reviews"):
            table = getattr(run, stage)
            if table is not None:
                part = table.agg(F.count("*").alias("rows")).select(F.lit(level).alias("level"), F.lit(stage).alias("stage"), "rows")
                out = part if out is None else out.unionByName(part)
    return out


# --- files, written and read back ----------------------------------------------------------------

def detection_files(spark: SparkSession, obs: DataFrame, tracked: bool) -> DataFrame:
    """Detections written as JSON lines and read back."""
    from kinewatch.sources.readers import read_detections

    at = f"{shared_folder(spark)}/detections"
    rows = obs.withColumn("bbox_xyxy", F.array("x1", "y1", "x2", "y2")).withColumn(
        "detection_id", F.col("detection_id").cast("string")).drop("x1", "y1", "x2", "y2")
    rows.select(F.to_json(F.struct(*rows.columns))).write.text(at)
    return read_detections(spark, at, tracked)[0]


@query("detection_files", f"""select cast(detection_id as varchar) as detection_id, source_id, session_id, frame_id, class_name,
  {r6('x1', 'y1', 'x2', 'y2', 'confidence')} from {BOXES}""")
def _(spark, sf):
    return rounded(detection_files(spark, boxes(spark, sf), False).select(
        "detection_id", *SCOPE, "frame_id", "class_name", "x1", "y1", "x2", "y2", "confidence"))


@query("tracked_files", f"""select cast(detection_id as varchar) as detection_id, track_id, frame_id, {r6('timestamp_seconds', 'x1', 'y2')}
  from ({X.duck(X.TRACKED)})""")
def _(spark, sf):
    return rounded(detection_files(spark, X.load(spark, sf, X.TRACKED), True).select(
        "detection_id", "track_id", "frame_id", T, "x1", "y2"))


@query("sample_lines", """select case when event_id % 13 = 5 then 'rejected' else 'sample' end as kind, number,
    case when event_id % 13 = 5 then '{broken ' || event_id else cast(event_id as varchar) end as text
  from (select event_id, row_number() over (partition by user_id % 7 order by event_id) as number from events)
  where event_id % 17 <> 3 or event_id % 13 = 5""")
def _(spark, sf):
    """Training samples in a few files; lines are numbered in their file, blank ones counted and skipped, broken ones returned."""
    from kinewatch.sources.readers import read_semantic_samples

    at, e = f"{shared_folder(spark)}/samples", F.col("event_id")
    sample = F.struct(e.cast("string").alias("sample_id"), F.lit("a").alias("source_id"), F.lit("b").alias("session_id"),
                      F.lit("c").alias("event_id"), F.lit("t").alias("text_context"), F.lit("g").alias("split_group"))
    line = F.when(e % 13 == 5, F.concat(F.lit("{broken "), e.cast("string"))).when(e % 17 == 3, F.lit("")).otherwise(F.to_json(sample))
    rows = spark.read.parquet(f"{sf}/events.parquet").select(e, (F.col("user_id") % 7).alias("part"), line.alias("value"))
    rows.repartition("part").sortWithinPartitions("part", "event_id").select("part", "value").write.partitionBy("part").text(at)
    good, bad = read_semantic_samples(spark, at)
    lines = bad.select(F.lit("rejected").alias("kind"), "number", F.col("line").alias("text"))
    every = spark.read.parquet(f"{sf}/events.parquet").select(e, (F.col("user_id") % 7).alias("part"))
    place = every.select(e.cast("string").alias("text"), F.row_number().over(W.partitionBy("part").orderBy("event_id")).cast("long").alias("number"))
    return lines.unionByName(good.select(F.col("sample_id").alias("text")).join(place, "text").select(F.lit("sample").alias("kind"), "number", "text"))


def write_documents(images: DataFrame, annotations: DataFrame, categories: DataFrame, at: str, each: int = 50_000) -> dict[str, str]:
    """Annotation documents of about `each` annotations, one file each; gives their paths by name."""
    spark = images.sparkSession
    parts = max(1, -(-annotations.count() // each))
    doc = lambda c: F.concat(F.col("split"), F.lit("-"), F.pmod(F.col(c), F.lit(parts)).cast("string"))
    box = F.array("x", "y", "w", "h").alias("bbox")
    some = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    lists = [
        images.select(doc("image_id").alias("doc"), F.lit(1).alias("ord"), F.col("image_id").alias("id"),
                      F.to_json(F.struct(F.col("image_id").alias("id"), "file_name", "width", "height")).alias("value")),
        annotations.select(doc("image_id").alias("doc"), F.lit(3).alias("ord"), F.col("annotation_id").alias("id"),
                           F.to_json(F.struct(F.col("annotation_id").alias("id"), "image_id", "category_id", box)).alias("value")),
        categories.withColumn("part", some).select(F.concat_ws("-", "split", "part").alias("doc"), F.lit(5).alias("ord"), F.col("category_id").alias("id"),
                                                   F.to_json(F.struct(F.col("category_id").alias("id"), "name", "supercategory")).alias("value"))]
    rows = lists[0].unionByName(lists[1]).unionByName(lists[2])
    marks = spark.createDataFrame([(0, '{"info": {"note": "a [ in a string"}, "images": ['), (2, '], "annotations": ['), (4, '], "categories": ['), (6, "]}")], "ord int, value string")
    heads = rows.select("doc").distinct().join(F.broadcast(marks)).select("doc", "ord", F.lit(0).cast("long").alias("id"), "value")  # four lines a document
    every = rows.unionByName(heads).repartition("doc")
    before = F.lag("ord").over(W.partitionBy("doc").orderBy("ord", "id"))  # in a document's own rows, as they lie
    text = F.when(before == F.col("ord"), F.concat(F.lit(","), "value")).otherwise(F.col("value"))
    every.select("doc", text.alias("value"), "ord", "id").sortWithinPartitions("doc", "ord", "id").select("doc", "value").write.partitionBy("doc").text(at)
    paths = spark.read.text(at).inputFiles()  # one for each document
    return {path.rsplit("/", 2)[1].removeprefix("doc="): path for path in paths}


@query("coco_documents", f"""select a.split, annotation_id, i.file_name, c.name, {r6('x', 'y', 'w', 'h')}
  from ({X.ANNOTATIONS}) a join ({X.IMAGES}) i on i.split = a.split and i.image_id = a.image_id
  join ({X.CATEGORIES}) c on c.split = a.split and c.category_id = a.category_id""")
def _(spark, sf):
    """Annotation documents that are read in byte ranges, so that one document is many tasks."""
    from kinewatch.sources.readers import read_coco_files

    paths = write_documents(*coco(spark, sf), f"{shared_folder(spark)}/coco")
    got = read_coco_files(spark, paths, 1 << 18)
    rows = got.annotations.join(got.images.select("split", "image_id", "file_name"), ["split", "image_id"]).join(
        got.categories.select("split", "category_id", "name"), ["split", "category_id"])
    return rounded(rows.select(F.substring_index("split", "-", 1).alias("split"), "annotation_id", "file_name", "name", "x", "y", "w", "h"))


@query("normalized_round_trip", ORACLES["normalize_dataset"])
def _(spark, sf):
    from kinewatch.sources.readers import read_normalized_coco
    from kinewatch.sources.writers import write_normalized_coco

    at, out = f"{shared_folder(spark)}/normalized", D.normalize_dataset(*coco(spark, sf))
    write_normalized_coco(out.images, out.annotations, out.categories, at)
    back = read_normalized_coco(spark, at, {n: getattr(out, n).schema for n in ("images", "annotations", "categories")})
    return back.annotations.groupBy("split", "category_id").agg(
        F.count("*").alias("annotations"), F.round(F.sum("w"), 4).alias("total_width"))


@query("manifest_order", f"""select row_number() over (order by encode(video_id)) - 1 as position, video_id, subject_id from ({O.KEPT})""")
def _(spark, sf):
    """The written manifest holds its clips in the order of their ids, file after file."""
    from kinewatch.sources.writers import ordered_lines, write_manifest

    at, clips = shared_folder(spark), MN.build_clip_manifest(X.load(spark, sf, X.CLIPS)).clips
    write_manifest(clips, at)
    got = ordered_lines(spark, f"{at}/manifest_json").select("position", F.from_json("value", "video_id string, subject_id int").alias("r"))
    return got.select("position", "r.video_id", "r.subject_id")


@query("clip_manifest_documents", f"""select video_id, subject_id, label, bytes, {r6('fps')} from ({O.KEPT})""")
def _(spark, sf):
    """Manifest documents with a list of records each, read back."""
    from kinewatch.sources.readers import read_clip_manifest

    at, clips = f"{shared_folder(spark)}/manifest", MN.build_clip_manifest(X.load(spark, sf, X.CLIPS)).clips
    parts = max(1, clips.count() // 1000)
    row = F.struct("video_id", "subject_id", "label", "bytes", "fps")
    docs = clips.groupBy(F.pmod(F.xxhash64("video_id"), F.lit(parts)).alias("part")).agg(F.collect_list(row).alias("records"))  # about 1000 each
    docs.select(F.to_json(F.struct("records"))).write.option("maxRecordsPerFile", 1).text(at)
    return rounded(read_clip_manifest(spark, at).select("video_id", "subject_id", "label", "bytes", "fps"))


@query("clip_file_scan", """select (case when s_suppkey % 2 = 0 then 'Fall' else 'ADL' end) || '/SBJ_' || s_suppkey || '.mp4' as relative_path,
    length(s_name) as bytes, sha256(s_name) as sha256 from supplier where s_suppkey % 5 <> 2""")
def _(spark, sf):
    """Clip files with the names of suppliers as content, and other files beside them, found with size and digest."""
    from kinewatch.sources.json_ranges import file_at
    from kinewatch.sources.readers import scan_clip_files

    at = f"{shared_folder(spark)}/clips"
    key = F.col("s_suppkey")
    name = F.when(key % 5 == 2, F.concat(F.lit("other/x"), key.cast("string"), F.lit(".mp4"))).otherwise(F.concat(
        F.when(key % 2 == 0, F.lit("Fall")).otherwise(F.lit("ADL")), F.lit("\\SBJ_"), key.cast("string"), F.lit(".mp4")))
    rows = spark.read.parquet(f"{sf}/supplier.parquet").select(FN.portable_path(name).alias("name"), F.col("s_name").alias("content"))

    def write(batches):
        for pdf in batches:
            for path, content in zip(pdf["name"], pdf["content"]):
                fs, place = file_at(f"{at}/{path}")
                fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(place) as f:
                    f.write(content.encode())
            yield pdf[["name"]]

    rows.mapInPandas(write, "name string").count()
    return scan_clip_files(spark, at).select("relative_path", "bytes", "sha256")


@query("canonical_digests", """select o_orderkey, sha256('{"id":' || o_orderkey || ',"k":[1.5,{"x":true,"y":null}],"z":{"a":"ä ' || o_orderpriority
    || '","b":' || o_custkey || '}}') as digest, md5(o_orderpriority) as content_md5 from orders""")
def _(spark, sf):
    """Digests of nested JSON with keys in any order."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    text = F.format_string('{"z": {"b": %d, "a": "\\u00e4 %s"}, "k": [1.5, {"y": null, "x": true}], "id": %d}', "o_custkey", "o_orderpriority", "o_orderkey")
    return o.select("o_orderkey", FN.canonical_text_sha256(text).alias("digest"), FN.file_digest(F.col("o_orderpriority").cast("binary"), "md5").alias("content_md5"))


@query("events_round_trip", f"""{LIFE} select {EVENT_SQL} from events_out""")
def _(spark, sf):
    """Event change log appended as JSON, read back, and reduced to the final state of each event."""
    from kinewatch.sources.writers import write_events

    at = f"{shared_folder(spark)}/events"
    changes = E.event_changes(event_log(spark, sf)[0])
    write_events(changes, at)
    back = spark.read.schema(changes.schema).json(at)
    return rounded(E.latest_event_state(back).select(*TRACK, *EVENT_COLS))
