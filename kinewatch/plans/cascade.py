"""The monitoring cascade as one lazy plan, and the sweep of threshold candidates over it."""

from __future__ import annotations

import math
from types import SimpleNamespace
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinewatch.operators import episodes as E
from kinewatch.operators import motion as M
from kinewatch.operators.lineage import cut
from kinewatch.operators.protocol import clip_metrics
from kinewatch.operators.slices import SHORTEST_SECONDS, Width, plan_slices, small
from kinewatch.operators.tracking import associate_tracks, association_width
from kinewatch.operators.geometry import restore_posture
from kinewatch.params import SCOPE, TRACK, CascadeParams, EventParams, PostureGroups, TrackingParams

LEVELS = ("detector_only", "detector_tracking", "temporal", "full")


class CascadeResult(NamedTuple):
    """Tables of a run; stages beyond the requested level are None."""

    detections: DataFrame | None = None
    tracked: DataFrame | None = None
    signals: DataFrame | None = None
    transitions: DataFrame | None = None
    log: DataFrame | None = None
    events: DataFrame | None = None
    reviews: DataFrame | None = None
    keyframes: DataFrame | None = None


#: Rows that a task takes through all steps of the cascade; its sorts hold them in memory at the same time.
ROWS_A_TASK = 250_000


def together(obs: DataFrame, frames: DataFrame, width: Width = None, times: int = 1) -> tuple[DataFrame, DataFrame]:
    """Moves the rows of a scope to one task where scopes are small, so that the steps after it need not move them again.

    The number of tasks grows with the observations, each of which becomes up to `times` rows. Both tables are written
    and read back first: a plan that holds the cascade twice moves such rows once, and Spark compares where the sides
    of a union lie by column names that include a table's alias. Left in, the alias makes sides that were planned to
    lie alike look apart when the plan runs, and the rows of one track end up in two groups.
    """
    if width is not None:
        return obs, frames
    obs, frames = cut(obs), cut(frames)
    n = max(obs.sparkSession.sparkContext.defaultParallelism, math.ceil(obs.count() * times / ROWS_A_TASK))
    return obs.repartition(n, *SCOPE), frames.repartition(n, *SCOPE)


def motion_signals(obs: DataFrame, p: CascadeParams = CascadeParams(),
                   width: Width = None) -> DataFrame:
    smooth = M.smooth_features(M.temporal_features(obs, width), p.thresholds.smoothing_window, width)
    return M.with_signals(smooth, p.groups, p.thresholds)


def transitions_of(obs: DataFrame, frames: DataFrame, p: CascadeParams = CascadeParams(),
                   width: Width = None) -> DataFrame:
    expiry = M.track_expiry(obs, frames, p.thresholds.track_timeout, width)
    return M.motion_states(motion_signals(obs, p, width), p.thresholds, expiry, width)


def run_cascade(frames: DataFrame, detections: DataFrame, p: CascadeParams = CascadeParams(),
                level: str = "full", tracking: TrackingParams = TrackingParams()) -> CascadeResult:
    """Runs the stages up to the level; detections that already carry a track_id skip association."""
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}")
    if level == "detector_only":
        return CascadeResult(detections=detections)
    # a slice must be longer than any duration the states wait for
    finer = TRACK if "track_id" in detections.columns else None
    width = plan_slices([detections, frames], SCOPE, at_least=max(SHORTEST_SECONDS, 1.25 * p.thresholds.longest), finer=finer)
    if "track_id" in detections.columns:
        obs = detections
    else:
        obs = restore_posture(associate_tracks(
            detections, tracking, association_width(detections, tracking)), detections)
    if level == "detector_tracking":
        return CascadeResult(detections, obs)
    obs, frames = together(obs, frames, width)
    signals = motion_signals(obs, p, width)
    transitions = transitions_of(obs, frames, p, width)
    log = E.fall_events(transitions, frames, p.events, width)
    events = E.latest_event_state(E.event_changes(log))
    if level == "temporal":
        return CascadeResult(detections, obs, signals, transitions, log, events)
    reviews = E.review_ready(log)
    keyframes = E.select_keyframes(reviews, M.frame_motion(signals, frames), p.events, width)
    return CascadeResult(detections, obs, signals, transitions, log, events, reviews, keyframes)


#: What a candidate sets in the cascade.
SWEPT = ["confidence_threshold", "smoothing_window", "aspect_ratio_fall_min", "vertical_speed_min", "suspect_duration",
         "lying_duration", "upright_aspect_ratio_max", "track_timeout"]


def candidate_events(obs: DataFrame, frames: DataFrame, candidates: DataFrame,
                     groups: PostureGroups = PostureGroups(), events: EventParams = EventParams(),
                     width: Width = None) -> DataFrame:
    """Final events of every candidate; the grid is broadcast once its count shows it to be short.

    Observations that carry a `variant` meet the candidates of their variant alone. Candidates that agree in all
    else are followed once, under the smallest of their ids, and get its events in the end.
    """
    own = [c for c in ("variant",) if c in obs.columns]
    every = candidates.select("candidate_id", *own, *SWEPT)
    grid = every.groupBy(*own, *SWEPT).agg(F.min("candidate_id").alias("candidate_id"))
    same = every.join(grid.withColumnRenamed("candidate_id", "_first"), [*own, *SWEPT]).select("candidate_id", "_first")
    spec = grid.agg(F.count("*").alias("n"), F.sort_array(F.collect_set("smoothing_window")).alias("sizes"), F.max(
        F.greatest("suspect_duration", "lying_duration")).alias("longest")).first()
    th = SimpleNamespace(
        aspect_ratio_fall_min=F.col("aspect_ratio_fall_min"),
        vertical_speed_min=F.col("vertical_speed_min"),
        upright_aspect_ratio_max=F.col("upright_aspect_ratio_max"),
        suspect_duration=F.col("suspect_duration"), lying_duration=F.col("lying_duration"),
        longest=spec.longest)
    # a session's name tells more rows apart than its source's, so sorts look at it first
    keys = [*reversed(SCOPE), "track_id", "candidate_id", "suspect_duration", "lying_duration", "track_timeout"]
    # before the grid multiplies the rows
    obs, frames = together(M.with_postures(obs, groups), frames, width, spec.n)
    fits = obs["confidence"] >= grid["confidence_threshold"]
    for c in own:
        fits = fits & (obs[c] == grid[c])
    each = obs.join(small(grid), fits)
    for c in own:
        each = each.drop(grid[c])
    features = M.temporal_features(each, width, keys)
    smooth = M.smooth_features(features, F.col("smoothing_window"), width, keys,
                               tuple(spec.sizes))
    signals = M.with_signals(smooth, groups, th)
    expiry = M.track_expiry(each, frames, F.col("track_timeout"), width, keys)
    moves = M.motion_states(signals, th, expiry, width, keys)
    track = ["candidate_id", *TRACK]
    log = E.fall_events(moves.select(*track, "frame_id", M.T, "previous_state", "next_state",
                                     "reason"), frames, events, width, [*TRACK, "candidate_id"])
    found = E.latest_event_state(E.event_changes(log)).withColumnRenamed("candidate_id", "_first")
    named = found.join(small(same), "_first").drop("_first")
    # an id holds the candidate, as it does when every candidate is followed on its own
    return named.withColumn("event_id", E.event_id(track)).select("candidate_id", *[c for c in found.columns if c != "_first"])


def evaluate_candidates(obs: DataFrame, frames: DataFrame, clips: DataFrame, candidates: DataFrame,
                        width: Width = None) -> tuple[DataFrame, DataFrame]:
    """(clip rows, metrics) of every candidate; a clip is one scope with its expected label."""
    found = candidate_events(obs, frames, candidates, width=width)
    per_clip = found.groupBy("candidate_id", *SCOPE).agg(
        F.count("*").alias("predicted_event_count"),
        F.min("start_time").alias("first_event_start_seconds"))
    # the sweep itself: every clip under every candidate
    every = clips.crossJoin(small(candidates.select("candidate_id", "variant",
                                                    "confidence_threshold")))
    n = F.coalesce("predicted_event_count", F.lit(0))
    rows = every.join(per_clip, ["candidate_id", *SCOPE], "left").withColumns(
        {"predicted_event_count": n, "predicted_fall": n > 0})
    return rows, clip_metrics(rows, ["candidate_id", "variant", "confidence_threshold"])
