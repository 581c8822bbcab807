"""One-to-one matching of predicted to true intervals, and the event metrics built on it."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinewatch.functions.scalars import f1, safe_ratio, temporal_iou
from kinewatch.operators.lineage import cut
from kinewatch.operators.slices import Width, carry, plan_slices, small
from kinewatch.params import SCOPE, MatchProtocol


def _side(df: DataFrame, tag: str) -> DataFrame:
    order = F.col("ord") if "ord" in df.columns else F.col("event_id")
    return df.select(
        F.col("event_id").alias(f"{tag}_id"), *SCOPE, F.col("track_id").alias(f"{tag}_track"),
        F.col("start_time").alias(f"{tag}_start"), F.col("end_time").alias(f"{tag}_end"),
        order.alias(f"{tag}_ord"))


def _track_keys(track: Column, truth: bool, same_track: bool) -> Column:
    """Keys under which a pair may meet, each pair exactly once.

    Known tracks meet on the track; a missing track on either side meets everything.
    """
    if not same_track:
        return F.array(F.lit("*"))
    own = F.concat(F.lit("t"), track.cast("string"))
    if truth:
        return F.when(track.isNull(), F.array(F.lit("*"))).otherwise(F.array(own, F.lit("?")))
    return F.array(F.coalesce(own, F.lit("?")), F.lit("*"))


def event_match_candidates(truth: DataFrame, pred: DataFrame, protocol: MatchProtocol) -> DataFrame:
    """Eligible pairs within a scope."""
    return _pairs(truth, pred, protocol).select(*SCOPE, *PAIR)


#: What is known of a pair.
PAIR = ["ground_truth_id", "predicted_id", "temporal_iou", "start_delay_seconds", "g_ord", "p_ord"]


def _pairs(truth: DataFrame, pred: DataFrame, protocol: MatchProtocol) -> DataFrame:
    """Eligible pairs with their tracks and the time that both intervals span.

    Pairs are found by equi joins on time buckets: by start within the tolerance, and by overlap with
    buckets sized to the interval length (an IoU of m bounds the ratio of the lengths), so a scope
    of any size never forms its full cross product.
    """
    g = _side(truth, "g").withColumn(
        "_key", F.explode(_track_keys(F.col("g_track"), True, protocol.same_track)))
    p = _side(pred, "p").withColumn(
        "_key", F.explode(_track_keys(F.col("p_track"), False, protocol.same_track)))
    on = [*SCOPE, "_key"]
    iou = temporal_iou(F.col("g_start"), F.col("g_end"), F.col("p_start"), F.col("p_end"))
    error = F.abs(F.col("p_start") - F.col("g_start"))
    m, tol = protocol.temporal_iou_min, protocol.start_tolerance
    by_iou = None if m is None else iou >= F.lit(float(m))
    by_start = None if tol is None else error <= F.lit(float(tol))

    def near_start() -> DataFrame:
        w = max(float(tol), 1e-3)
        b = F.floor(F.col("g_start") / w)
        left = g.withColumn("_b", F.explode(F.array(b - 1, b, b + 1)))
        return left.join(p.withColumn("_b", F.floor(F.col("p_start") / w)), [*on, "_b"])

    def overlapping() -> DataFrame:
        if m == 0:  # every pair of the scope qualifies
            return g.join(p, on)
        spread = math.ceil(math.log2(1.0 / m) + 1e-9)

        def level(start: str, end: str) -> Column:
            return F.floor(F.log2(F.greatest(F.col(end) - F.col(start), F.lit(1e-9)))).cast("int")

        def size(c: Column) -> Column:
            return F.pow(F.lit(2.0), c + 1) * 1.0001

        left = g.withColumn("_l", level("g_start", "g_end"))
        left = left.withColumn("_l", F.explode(F.sequence(F.col("_l") - spread, F.col("_l") + spread)))
        first = F.floor(F.col("g_start") / size(F.col("_l"))) - 1
        last = F.floor(F.col("g_end") / size(F.col("_l")))
        left = left.withColumn("_b", F.explode(F.sequence(first, last)))
        right = p.withColumn("_l", level("p_start", "p_end"))
        right = right.withColumn("_b", F.floor(F.col("p_start") / size(F.col("_l"))))
        return left.join(right, [*on, "_l", "_b"])

    if by_iou is None:
        pairs = near_start().filter(by_start)
    elif by_start is None:
        pairs = overlapping().filter(by_iou)
    elif protocol.rule == "and":
        pairs = near_start().filter(by_start & by_iou)
    elif m == 0:
        pairs = overlapping()
    else:
        cols = [*g.columns, *[c for c in p.columns if c not in g.columns]]
        pairs = near_start().filter(by_start).select(cols).unionByName(
            overlapping().filter(by_iou & ~by_start).select(cols))
    return pairs.select(
        *SCOPE, F.col("g_id").alias("ground_truth_id"), F.col("p_id").alias("predicted_id"),
        iou.alias("temporal_iou"), (F.col("p_start") - F.col("g_start")).alias("start_delay_seconds"),
        "g_ord", "p_ord", "g_track", "p_track", F.least("g_start", "p_start").alias("_from"),
        F.greatest("g_end", "p_end", "g_start", "p_start").alias("_to"))


def match_events(truth: DataFrame, pred: DataFrame, protocol: MatchProtocol) -> DataFrame:
    """Greedy one-to-one matches: best IoU, then smallest start error, then input order.

    Pairs that share an interval overlap in time, so a scope (or track, where all its pairs name one) falls apart
    wherever no pair spans. Each such island is independent: its pairs stream through in order of rank, and a pair wins if
    neither of its ends is taken. A task holds the ids taken in one island. The number of passes doesn't depend on the data.
    """
    pairs = cut(_pairs(truth, pred, protocol))
    same = F.coalesce(F.col("g_track") == F.col("p_track"), F.lit(False))
    mixed = pairs.groupBy(*SCOPE).agg(F.max(~same).alias("_mixed"))
    named = F.when(F.col("_mixed"), F.lit("*")).otherwise(F.concat(F.lit("t"), F.col("g_track").cast("string")))
    edges = cut(pairs.join(small(mixed), SCOPE).withColumn("_key", named).drop("_mixed", "g_track", "p_track"))
    keys = [*SCOPE, "_key"]
    order = dict(order="_from", width=plan_slices([edges], keys, "_from", 1e-3), tie=["g_ord", "p_ord"])
    far = carry(edges, keys, values={"_reach": ("max", F.col("_to"))}, inclusive=False, **order)
    fresh = F.col("_reach").isNull() | (F.col("_from") > F.col("_reach"))
    islands = carry(far, keys, values={"_island": ("last", F.when(fresh, F.col("_from")))}, **order)
    group = [*keys, "_island"]
    rank = [F.desc("temporal_iou"), F.abs("start_delay_seconds"), "g_ord", "p_ord"]
    ordered = islands.repartition(*group).sortWithinPartitions(*group, *rank)
    out = [*SCOPE, *PAIR[:4]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        island, taken_g, taken_p = None, set(), set()
        for pdf in batches:
            keep = np.zeros(len(pdf), bool)
            for i, (g, p, *here) in enumerate(zip(pdf["ground_truth_id"], pdf["predicted_id"], *[pdf[c] for c in group])):
                if here != island:
                    island, taken_g, taken_p = here, set(), set()
                if g not in taken_g and p not in taken_p:
                    taken_g.add(g)
                    taken_p.add(p)
                    keep[i] = True
            yield pdf.loc[keep, out]

    return ordered.select(*out, "_key", "_island").mapInPandas(run, edges.select(*out).schema)


def negative_window_hits(windows: DataFrame, pred: DataFrame, width: Width = None) -> DataFrame:
    """Negative windows that overlap any prediction of their scope; tracks do not matter.

    A window is hit when the latest end among predictions starting before its end exceeds its start:
    one sorted pass, no pairs.
    """
    cols = windows.columns
    kind = windows.select(F.struct(*cols).alias("x")).schema["x"].dataType
    asked = windows.select(*SCOPE, F.col("end_time").alias("_t"), F.lit(0).alias("_k"),
                           F.lit(None).cast("double").alias("_end"), F.struct(*cols).alias("_w"))
    given = pred.select(*SCOPE, F.col("start_time").alias("_t"), F.lit(1).alias("_k"),
                        F.col("end_time").alias("_end"), F.lit(None).cast(kind).alias("_w"))
    both = carry(asked.unionByName(given), SCOPE, "_t", {"_far": ("max", F.col("_end"))}, width,
                 tie=["_k"])
    return both.filter((F.col("_k") == 0) & (F.col("_far") > F.col("_w.start_time"))).select("_w.*")


def window_specificity(windows: DataFrame | None, pred: DataFrame,
                       width: Width = None) -> DataFrame:
    """Share of negative windows without a prediction; null with a reason when none are defined."""
    if windows is None:
        return pred.sparkSession.range(1).select(
            F.lit(None).cast("double").alias("specificity"),
            F.lit("negative event windows were not defined").alias("specificity_unavailable_reason"))
    hits = negative_window_hits(windows, pred, width).agg(F.count("*").alias("hit"))
    total = windows.agg(F.count("*").alias("n"))
    return total.crossJoin(hits).select(  # one row each
        safe_ratio(F.col("n") - F.col("hit"), F.col("n")).alias("specificity"),
        F.lit(None).cast("string").alias("specificity_unavailable_reason"))


def event_metrics(truth: DataFrame, pred: DataFrame, protocol: MatchProtocol,
                  monitored_hours: float | None = None, windows: DataFrame | None = None,
                  width: Width = None) -> DataFrame:
    """One row of event counts, ratios, false alarms per hour, delay and window specificity."""
    if monitored_hours is not None and monitored_hours <= 0:
        raise ValueError("monitored hours must be positive")
    matches = match_events(truth, pred, protocol)
    one = (
        matches.agg(F.count("*").alias("tp"), F.avg("start_delay_seconds").alias("delay"))
        .crossJoin(truth.agg(F.count("*").alias("g")))
        .crossJoin(pred.agg(F.count("*").alias("p")))
        .crossJoin(window_specificity(windows, pred, width)))  # single rows throughout
    tp, fp, fn = F.col("tp"), F.col("p") - F.col("tp"), F.col("g") - F.col("tp")
    precision, recall = safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn)
    hours = F.lit(monitored_hours).cast("double")
    return one.select(
        tp.alias("true_positive_events"), fp.alias("false_positive_events"),
        fn.alias("false_negative_events"), precision.alias("precision"), recall.alias("recall"),
        f1(precision, recall).alias("f1"), safe_ratio(fn, F.col("g")).alias("miss_rate"),
        "specificity", "specificity_unavailable_reason",
        (fp / hours).alias("false_alarms_per_hour"),
        F.when(hours.isNull(), F.lit("monitored duration was not supplied"))
        .alias("false_alarms_per_hour_unavailable_reason"),
        F.col("delay").alias("mean_detection_delay_seconds"))
