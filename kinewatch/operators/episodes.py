"""State changes to events: change log, reviews due, latest state and keyframes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinewatch.functions.scalars import strictly_after
from kinewatch.operators.lifecycle import (
    LIFECYCLE_COLUMNS, LIFECYCLE_TYPES, Episodes, Mark,
)
from kinewatch.operators.slices import Width, carry, nearest_frame, neighbor, with_ordinal
from kinewatch.params import SCOPE, TRACK, EventParams

T = "timestamp_seconds"


def event_id(keys: list[str]) -> Column:
    """Repeatable id: digest of the track key and the start frame."""
    return F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in keys],
                              F.col("start_frame").cast("string")), 256)


def with_deadlines(transitions: DataFrame, frames: DataFrame, p: EventParams, keys: list[str],
                   scope: list[str], width: Width) -> DataFrame:
    """Adds the first frame past the event timeout and the first frame after the lying wait."""
    t = F.col(T).cast("double")
    tx = transitions.withColumn(T, t)
    probes = tx.withColumn("_at", F.explode(F.array(
        F.struct(F.lit(0).alias("k"), strictly_after(t, p.timeout).alias("x")),
        F.struct(F.lit(1).alias("k"), (t + F.lit(float(p.after_offset))).alias("x")),
    ))).filter("_at.k = 0 or next_state = 'lying'")
    hits = nearest_frame(probes, frames, scope, F.col("_at.x"), "_f", ["frame_id", T], width)
    frame = F.struct(F.col("_f")["frame_id"].alias("frame_id"), F.col("_f")[T].alias("t"))
    found = F.when(F.col("_f").isNotNull(), frame)
    return hits.groupBy(*keys, "frame_id", T, "next_state", "reason").agg(
        F.max(F.when(F.col("_at.k") == 0, found)).alias("deadline"),
        F.max(F.when(F.col("_at.k") == 1, found)).alias("due"))


def with_episode_start(marked: DataFrame, p: EventParams, keys: list[str],
                       width: Width) -> DataFrame:
    """Adds `episode`: the time of the first state change after a quiet gap.

    Across a quiet gap nothing can be pending, active, merged or suppressed, so episodes are
    independent and a busy track spreads over many tasks.
    """
    ended = F.when(F.col("next_state") == "resolved", F.col(T)).otherwise(
        F.coalesce(F.col("deadline")["t"], F.lit(float("inf"))))
    # a pending candidate keeps the episode open
    until = F.when(F.col("next_state") == "suspected", F.lit(float("inf"))).otherwise(ended)
    out = neighbor(marked, keys, T, {"_until": until}, width)
    fresh = F.col("_until").isNull() | (
        F.col(T) - F.col("_until") > F.lit(float(max(p.merge_gap, p.cooldown))))
    out = carry(out, keys, T, {"episode": ("last", F.when(fresh, F.col(T)))}, width)
    return out.drop("_until")


def fall_events(transitions: DataFrame, frames: DataFrame, p: EventParams,
                width: Width = None, keys: list[str] = TRACK,
                scope: list[str] = SCOPE) -> DataFrame:
    """Event log of every track: `change` rows (one per snapshot) and `review` rows (one per event).

    Rows stream through in track and time order; a task holds one running event, never a group.
    """
    marked = with_deadlines(transitions, frames, p, keys, scope, width)
    rows = with_episode_start(marked, p, keys, width)
    group = [*keys, "episode"]
    flat = rows.select(
        *group, "frame_id", T, "next_state", "reason",
        F.col("deadline.frame_id").alias("d_frame"), F.col("deadline.t").alias("d_t"),
        F.col("due.frame_id").alias("w_frame"), F.col("due.t").alias("w_t"))
    n = len(group)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ep = None, None

        def table(rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=[*keys, *LIFECYCLE_COLUMNS])
            for c in ("end_frame", "frame_id", "start_frame"):
                out[c] = out[c].astype("Int64")
            return out

        def taken() -> list[tuple]:
            rows, ep.out = [(*key[:-1], *r) for r in ep.out], []
            return rows

        for pdf in batches:
            done: list[tuple] = []
            for row in zip(*[pdf[c].tolist() for c in pdf.columns]):
                here = row[:n]
                frame, t, state, reason, d_frame, d_t, w_frame, w_t = row[n:]
                if here != key:
                    if ep is not None:
                        ep.advance(float("inf"))
                        done += taken()
                    key, ep = here, Episodes(p)
                ep.advance(t)
                # a missing time arrives as NaN, which differs from itself
                deadline = None if d_t is None or d_t != d_t else (int(d_frame), d_t)
                due = None if w_t is None or w_t != w_t else (int(w_frame), w_t)
                mark = Mark(int(frame), t, reason, deadline)
                ep.transition(mark, state, due)
                ep.settle(mark.frame_id, mark.t)
            if ep is not None:
                done += taken()
            yield table(done)
        if ep is not None:
            ep.advance(float("inf"))
            yield table(taken())

    types = dict(flat.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", " + LIFECYCLE_TYPES
    ordered = flat.repartition(*group).sortWithinPartitions(*group, T)
    return ordered.mapInPandas(run, schema).withColumn("event_id", event_id(keys))


def event_changes(log: DataFrame) -> DataFrame:
    return log.filter("kind = 'change'")


def review_ready(log: DataFrame) -> DataFrame:
    """One row per reviewed event, as it stood on the review frame."""
    return log.filter("kind = 'review'")


def latest_event_state(changes: DataFrame) -> DataFrame:
    """Final snapshot per event; combines before the shuffle."""
    cols = changes.columns
    best = changes.groupBy("event_id").agg(F.max_by(F.struct(*cols), "seq").alias("e"))
    return best.select("e.*")


def active_events(events: DataFrame) -> DataFrame:
    return events.filter(F.col("end_time").isNull())


def event_temporal_state(reviews: DataFrame, transitions: DataFrame, width: Width = None,
                         keys: list[str] = TRACK) -> DataFrame:
    """State of the event's track at review time: latest change, upright before the first."""
    hit = nearest_frame(reviews, transitions, keys, F.col(T), "_s", ["next_state"], width,
                        backward=True)
    return hit.withColumn(
        "temporal_state", F.coalesce(F.col("_s.next_state"), F.lit("upright"))).drop("_s")


def recent_frames(frames: DataFrame, reviews: DataFrame, n: int,
                  width: Width = None, scope: list[str] = SCOPE) -> DataFrame:
    """Last n frames up to each review frame: reviews join two blocks of n frame positions."""
    placed = with_ordinal(frames, scope, T, "ord", width)
    at = placed.select(*scope, "frame_id", F.col("ord").alias("review_ord"))
    want = reviews.join(at, [*scope, "frame_id"]).withColumnRenamed("frame_id", "review_frame_id")
    want = want.withColumnRenamed(T, "review_timestamp")
    block = F.floor(F.col("review_ord") / n)
    want = want.withColumn("_block", F.explode(F.array(block, block - 1)))
    pool = placed.withColumn("_block", F.floor(F.col("ord") / n))
    hit = want.join(pool, [*scope, "_block"])
    return hit.filter(F.col("ord").between(F.col("review_ord") - n + 1, F.col("review_ord"))).drop("_block")


def select_keyframes(reviews: DataFrame, frames_motion: DataFrame, p: EventParams,
                     width: Width = None, scope: list[str] = SCOPE) -> DataFrame:
    """before / during / after frame of each reviewed event, taken from its recent frames.

    A frame is used once and ties go to the earliest frame. A review sees at most
    `ring_buffer_frames` frames, which bounds the collected array.
    """
    need = ["event_id", *scope, "frame_id", T, "start_time", "end_time", "lying_started_at_seconds"]
    near = recent_frames(frames_motion, reviews.select(*need).dropDuplicates(["event_id"]),
                         p.ring_buffer_frames, width, scope)
    anchor = F.coalesce("lying_started_at_seconds", "end_time", "start_time")
    frame = F.struct("ord", "frame_id", T, "motion_score", "bbox")
    got = near.groupBy("event_id", *scope).agg(
        F.first("start_time").alias("start_time"), F.first(anchor).alias("anchor"),
        F.collect_list(frame).alias("pool"))
    targets = got.withColumns({
        "t_before": F.greatest(F.lit(0.0), F.col("start_time") - p.before_offset),
        "t_during": F.col("anchor"),
        "t_after": F.col("anchor") + p.after_offset,
    })

    def best(pool: Column, score) -> Column:
        ranked = F.transform(pool, lambda x: F.struct(
            score(x).alias("k"), x["ord"].alias("o"), x.alias("f")))
        return F.array_min(ranked)["f"]

    def unused(*picks: str) -> Column:
        taken = [F.col(c)["ord"] for c in picks]
        return F.filter("pool", lambda x: ~x["ord"].isin(*taken))

    def nearest(target: str):
        return lambda x: F.abs(x[T] - F.col(target))

    picked = targets.withColumn("before", best(F.col("pool"), nearest("t_before")))
    picked = picked.withColumn("during", best(unused("before"), lambda x: -x["motion_score"]))
    picked = picked.withColumn("after", best(unused("before", "during"), nearest("t_after")))
    roles = F.array(*[
        F.struct(F.lit(r).alias("role"), F.lit(i).alias("role_order"), F.col(r).alias("frame"),
                 F.col(f"t_{r}").alias("target"))
        for i, r in enumerate(("before", "during", "after"))])
    rows = picked.select("event_id", *scope, F.explode(roles).alias("k")).filter("k.frame is not null")
    reason = F.when(
        F.col("k.role") == "during", F.lit("maximum buffered motion score during candidate event")
    ).otherwise(F.format_string("nearest buffered timestamp to %s target %.3fs",
                                F.col("k.role"), F.col("k.target")))
    return rows.select(
        "event_id", *scope, F.col("k.role").alias("role"), F.col("k.role_order").alias("role_order"),
        F.col("k.frame.frame_id").alias("frame_id"), F.col("k.frame")[T].alias(T),
        F.col("k.frame.motion_score").alias("score"),
        F.col("k.target").alias("target_timestamp_seconds"), reason.alias("reason"),
        F.col("k.frame.bbox").alias("bbox"))


def distinct_keyframes(existing: DataFrame, selected: DataFrame) -> DataFrame:
    """Adds only keyframes whose (event, role, frame) is new."""
    key = ["event_id", "role", "frame_id"]
    new = selected.join(existing.select(*key), key, "left_anti").dropDuplicates(key)
    return existing.unionByName(new)


def event_trigger_video_time(reviews: DataFrame) -> DataFrame:
    """Video milliseconds from event start to review."""
    ms = F.greatest(F.lit(0.0), F.col(T) - F.col("start_time")) * 1000.0
    return reviews.select("event_id", F.lit("event_trigger_video_time").alias("stage"),
                          ms.alias("latency_ms"))
