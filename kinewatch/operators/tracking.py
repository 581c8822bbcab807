"""Frame times and class-agnostic association of detections into tracks."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from kinewatch.operators.lineage import cut
from kinewatch.operators.slices import carry, neighbor, slice_of, slice_width
from kinewatch.params import SCOPE, TrackingParams

T = "timestamp_seconds"

# Fixed values of the published two-stage method: lowest usable score, margin for a new track, and
# the cost limit of the second stage.
LOW_SCORE = 0.1
NEW_TRACK_MARGIN = 0.1
SECOND_STAGE_COST = 0.5
# A pair at the cost limit is still worth this much more than none.
MATCH_BONUS = 1e-4
#: Track x box cells that are compared at once.
CELLS = 1 << 20
#: Tracks of a block at most; larger ones lie farther apart and meet more boxes.
BLOCK = 64
#: Edges of a row that are sorted before a path asks for more.
LISTED = 16


def repair_timestamps(frames: DataFrame, fps: float | None, width: float | None = None,
                      keys: list[str] = SCOPE) -> tuple[DataFrame, DataFrame]:
    """(repaired, rejected). A time not after the previous accepted one becomes frame_id / fps.

    Every row depends on the accepted time before it. With a width (in frames) a scope is cut into
    slices that start from a guess, the highest time so far. Slices whose guess differs from the end
    of the slice before are run again from that end until all agree, which makes the result exact.
    """
    part = [*keys, "_slice"]
    place = slice_of(F.col("frame_id"), width) if width else F.lit(0).cast("long")
    rows = frames.withColumn("_slice", place)
    own = F.max(F.col(T).cast("double"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*part).agg(own.alias("_m")).select(
        *part, F.coalesce(F.max("_m").over(before), F.lit(-1.0)).alias("_start"))
    if width is None:
        done = _timed(rows.join(starts, part), fps, part)
    else:
        starts = cut(starts)
        done = cut(_timed(rows.join(starts, part), fps, part))
        while True:
            ends = done.groupBy(*part).agg(F.greatest(F.first("_start"), F.max("_value")).alias("_end"))
            follow = Window.partitionBy(*keys).orderBy("_slice")
            want = ends.select(*part, F.lag("_end").over(follow).alias("_want"))
            wrong = cut(starts.join(want, part).filter("_want <> _start").select(
                *part, F.col("_want").alias("_start")))
            if wrong.isEmpty():
                break
            keep = done.join(wrong.select(*part), part, "left_anti")
            again = _timed(rows.join(wrong, part), fps, part)
            done = cut(keep.unionByName(again))
            starts = cut(starts.join(wrong.select(*part), part, "left_anti").unionByName(wrong))
    good = done.filter("_value is not null").withColumn(T, F.col("_value"))
    bad = done.filter("_value is null")
    return good.select(*frames.columns), bad.select(*frames.columns)


def _timed(rows: DataFrame, fps: float | None, part: list[str]) -> DataFrame:
    """Adds `_value`, the accepted time (null where none fits); rows stream in frame order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, -1.0
        for pdf in batches:
            values = []
            for here, frame, t, start in zip(
                    zip(*[pdf[c] for c in part]), pdf["frame_id"], pdf[T], pdf["_start"]):
                if here != key:
                    key, last = here, start
                if not t > last and fps and fps > 0:
                    t = frame / fps
                ok = t > last
                last = t if ok else last
                values.append(t if ok else None)
            yield pdf.assign(_value=pd.array(values, dtype="Float64"))

    ordered = rows.repartition(*part).sortWithinPartitions(*part, "frame_id")
    return ordered.mapInPandas(run, StructType([*ordered.schema.fields, StructField("_value", DoubleType())]))


def track_names(frame: int, place: np.ndarray) -> np.ndarray:
    """Names of tracks: 63-bit digests of the frame and place of the detection each starts with."""
    def spread(x: np.ndarray) -> np.ndarray:  # the finalizer of splitmix64
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    base = spread(np.array([frame], np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return (spread(base + place.astype(np.uint64)) >> np.uint64(1)).astype(np.int64)


def kinds(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the first of each kind of equal rows, and the kind of each row."""
    order = np.lexsort(values.T)
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[order[1:]] != values[order[:-1]]).any(axis=1)
    kind = np.empty(len(values), np.int64)
    kind[order] = np.cumsum(fresh) - 1
    return order[fresh], kind


def best_pairs(rows: np.ndarray, cols: np.ndarray, gain: np.ndarray, row_kind: np.ndarray | None = None,
               col_kind: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of the edges (row, column, gain above 0) the pairs of largest total gain that use no row and no column twice.

    With `row_kind` and `col_kind`, the kind of each row and column, edges name kinds and hold for all of them. Edges that
    meet no other are taken at once, the rest by shortest augmenting paths. Only edges are held, never a matrix. Equal
    totals: always the same pairs for the same order of edges.
    """
    if not len(rows):
        return rows, cols
    rows_of, cols_of = _members(row_kind, rows), _members(col_kind, cols)
    alone = ((np.bincount(rows)[rows] == 1) & (np.bincount(cols)[cols] == 1)
             & (rows_of.size[rows] == 1) & (cols_of.size[cols] == 1))
    found_r, found_c = [rows_of.first[rows[alone]]], [cols_of.first[cols[alone]]]
    rows, cols, gain = rows[~alone], cols[~alone], gain[~alone]
    if len(rows):
        order = np.argsort(rows, kind="stable")
        rows, cols, gain = rows[order], cols[order], gain[order]
        some_r, some_c = np.flatnonzero(np.bincount(rows)), np.flatnonzero(np.bincount(cols))
        starts = np.concatenate([[0], np.flatnonzero(np.diff(rows)) + 1, [len(rows)]])
        place = np.zeros(some_c[-1] + 1, np.int64)
        place[some_c] = np.arange(len(some_c))
        each_r, kind = rows_of.every(some_r)
        match = _augment(starts, place[cols], -gain, kind, cols_of.size[some_c])
        each_c, taken = cols_of.every(some_c)
        # the rows that share a kind of columns take them one by one
        paired = np.argsort(match, kind="stable")[np.count_nonzero(match < 0):]
        nth = np.arange(len(paired)) - np.searchsorted(match[paired], match[paired])
        found_r.append(each_r[paired])
        found_c.append(each_c[np.searchsorted(taken, match[paired]) + nth])
    out_r, out_c = np.concatenate(found_r), np.concatenate(found_c)
    order = np.argsort(out_r)
    return out_r[order], out_c[order]


class _members:
    """The members of each kind, by kind and then by place; without kinds everything is a kind of its own."""

    def __init__(self, kind: np.ndarray | None, used: np.ndarray) -> None:
        kind = np.arange(int(used.max()) + 1) if kind is None else kind
        self.size = np.bincount(kind)
        self.order = np.argsort(kind, kind="stable")
        self.at = np.cumsum(self.size) - self.size
        self.first = self.order[np.minimum(self.at, len(kind) - 1)]

    def every(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All members of some kinds, and which of these kinds each belongs to."""
        nth = np.repeat(np.arange(len(some)), self.size[some])
        before = np.cumsum(self.size[some]) - self.size[some]
        return self.order[self.at[some][nth] + np.arange(len(nth)) - before[nth]], nth


def _augment(first: np.ndarray, cols: np.ndarray, cost: np.ndarray, kind: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Column of each row, or -1, at least total cost; a row may stay alone at cost 0.

    `kind` names the edges of each row, cols[first[k]:first[k + 1]], `room` says how many rows a column takes.
    Row after row is added along the cheapest path of changes, found by Dijkstra's method on reduced costs; the path may
    end at a column with room or by leaving one of its rows alone. A kind's edges are looked at cheapest first, up to
    what a path may still cost: only `LISTED` of them are sorted at first, more if a path asks for them. Prices of
    columns only fall, so a sorted value is never above the present one and later edges of the list can be left out. Of
    rows of one kind a path looks at the first.
    """
    n, inf = len(kind), float("inf")
    bounds, kind, room = first.tolist(), kind.tolist(), room.tolist()
    u, v, prices = [0.0] * n, [0.0] * len(room), np.zeros(len(room))
    col_of: list[int] = [-1] * n
    held: list[list[int]] = [[] for _ in room]
    listed: list[list[tuple[float, float, int]]] = [[] for _ in range(len(bounds) - 1)]
    beyond = [-inf] * len(listed)  # no edge that isn't listed is below

    def look_further(k: int) -> None:
        js, own = cols[bounds[k]:bounds[k + 1]], cost[bounds[k]:bounds[k + 1]]
        now, want = own - prices[js], max(LISTED, 2 * len(listed[k]))
        if want < len(js):
            some = np.argpartition(now, want)
            beyond[k] = float(now[some[want]])
            some = np.sort(some[:want])
        else:
            beyond[k], some = inf, np.arange(len(js))
        some = some[np.argsort(now[some], kind="stable")]
        listed[k] = list(zip(now[some].tolist(), own[some].tolist(), js[some].tolist()))

    for start in range(n):
        far: dict[int, float] = {}
        via: dict[int, int] = {}
        seen: dict[int, float] = {}  # kinds looked at, and from where
        left: list[tuple[int, float]] = []
        heap: list[tuple[float, int]] = []
        best, last, end = inf, -1, -1
        way, here = 0.0, (start,)
        while True:
            for row in here:
                base, k = way - u[row], kind[row]
                if base >= seen.get(k, inf):
                    continue
                seen[k] = base
                if base < best:
                    best, last, end = base, row, -1
                while True:
                    for least, own, j in listed[k]:
                        if base + least >= best:
                            break
                        to = base + (own - v[j])
                        if to < best and to < far.get(j, inf):
                            far[j], via[j] = to, row
                            if room[j]:
                                best, end = to, j
                            else:
                                heapq.heappush(heap, (to, j))
                    if base + beyond[k] >= best:
                        break
                    look_further(k)
            while heap and heap[0][0] != far[heap[0][1]]:
                heapq.heappop(heap)  # the column was left, or reached at less since
            if not heap or heap[0][0] >= best:
                break
            way, j = heapq.heappop(heap)
            far[j] = -inf
            left.append((j, way))
            here = held[j]
        u[start] += best
        for j, at in left:
            v[j] -= best - at
            prices[j] = v[j]
            for row in held[j]:
                u[row] += best - at
        if end >= 0:
            room[end] -= 1
        elif last == start:
            continue
        else:  # the last row of the path gives its column up
            end, col_of[last] = col_of[last], -1
            held[end].remove(last)
        while True:
            row = via[end]
            held[end].append(row)
            end, col_of[row] = col_of[row], end
            if row == start:
                break
            held[end].remove(row)
    return np.array(col_of)


class Associator:
    """Two-stage IoU association over the frames of one scope, in order; each stage takes the pairs of least total cost."""

    def __init__(self, params: TrackingParams) -> None:
        self.p = params
        self.boxes = np.zeros((0, 4))
        self.ids = np.zeros(0, dtype=np.int64)
        self.seen = np.zeros(0, dtype=np.int64)
        self.hits = np.zeros(0, dtype=np.int64)

    @staticmethod
    def _iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        sides = [np.minimum(a[:, None, i + 2], b[None, :, i + 2]) - np.maximum(a[:, None, i], b[None, :, i]) for i in (0, 1)]
        inter = np.clip(sides[0], 0, None) * np.clip(sides[1], 0, None)
        area = lambda x: (x[:, 2:] - x[:, :2]).prod(axis=1)
        total = area(a)[:, None] + area(b)[None, :] - inter
        return np.where(total > 0, inter / np.where(total > 0, total, 1), 0.0)

    def _near(self, tracks: np.ndarray, boxes: np.ndarray, weight: np.ndarray, limit: float
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Track, box and cost of the pairs within the limit.

        Tracks go in blocks that lie close to each other, strip by strip and from left to right, so a crowded frame needs
        no whole matrix. Below a cost of 1 a pair shares at least a part of the box's width and height, which its
        weight tells; only boxes that reach so far into a block can be within the limit.
        """
        step = max(1, min(BLOCK, CELLS // len(boxes)))
        own = self.boxes[tracks]
        strips = math.ceil(math.sqrt(len(tracks) / step))
        strip = np.empty(len(tracks), np.int64)
        strip[np.argsort(own[:, 1], kind="stable")] = np.arange(len(tracks)) * strips // len(tracks)
        close = np.lexsort((own[:, 0], strip))
        if limit < 1:  # a little less than the share, for rounding
            part = 0.99 * ((1 - limit) / np.maximum(weight, 1 - limit))[:, None] * (boxes[:, 2:] - boxes[:, :2])
        found = []
        for at in range(0, len(tracks), step):
            block = close[at:at + step]
            near = np.arange(len(boxes)) if limit >= 1 else np.nonzero(
                ((np.fmax.reduce(own[block, 2:]) - boxes[:, :2] >= part)
                 & (boxes[:, 2:] - np.fmin.reduce(own[block, :2]) >= part)).all(axis=1))[0]
            cost = 1.0 - self._iou(own[block], boxes[near]) * weight[near][None, :]
            r, c = np.nonzero(cost <= limit)
            found.append((block[r], near[c], cost[r, c]))
        return tuple(np.concatenate(part) for part in zip(*found))

    def forget(self, frame: int) -> None:
        """Drops tracks lost for longer than the buffer."""
        live = frame - self.seen <= self.p.lost_track_buffer
        self.boxes, self.ids = self.boxes[live], self.ids[live]
        self.seen, self.hits = self.seen[live], self.hits[live]

    def restore(self, boxes: np.ndarray, ids: np.ndarray, seen: np.ndarray, hits: np.ndarray) -> None:
        self.boxes, self.ids, self.seen, self.hits = boxes, ids, seen, hits

    def step(self, frame: int, boxes: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Track id per detection, -1 where none is assigned."""
        self.forget(frame)
        ids = np.full(len(boxes), -1, dtype=np.int64)
        taken = np.zeros(len(boxes), dtype=bool)
        strong = np.nonzero(scores >= self.p.track_activation_threshold)[0]
        weak = np.nonzero((scores > LOW_SCORE) & (scores < self.p.track_activation_threshold))[0]
        recent = self.seen >= frame - 1
        for dets, pool, limit, fuse in (
            (strong, np.ones(len(self.ids), dtype=bool), self.p.minimum_matching_threshold, True),
            (weak, recent, SECOND_STAGE_COST, False),
        ):
            tracks = np.nonzero(pool & (self.seen != frame))[0]
            if not len(dets) or not len(tracks):
                continue
            weight = scores[dets] if fuse else np.ones(len(dets))
            # equal tracks have equal pairs, and so have equal boxes of equal weight
            one_track, track_kind = kinds(self.boxes[tracks])
            one_box, box_kind = kinds(np.column_stack([boxes[dets], weight]))
            r, c, cost = self._near(tracks[one_track], boxes[dets[one_box]], weight[one_box], limit)
            r, c = best_pairs(r, c, limit + MATCH_BONUS - cost, track_kind, box_kind)
            t, d = tracks[r], dets[c]
            self.boxes[t], self.seen[t], taken[d] = boxes[d], frame, True
            self.hits[t] = np.minimum(self.hits[t] + 1, self.p.minimum_consecutive_frames)
            known = self.hits[t] >= self.p.minimum_consecutive_frames
            ids[d[known]] = self.ids[t[known]]
        born = strong[~taken[strong] & (scores[strong] >= self.p.track_activation_threshold + NEW_TRACK_MARGIN)]
        if len(born):
            new = track_names(frame, born)
            self.boxes = np.vstack([self.boxes, boxes[born]])
            self.ids = np.concatenate([self.ids, new])
            self.seen = np.concatenate([self.seen, np.full(len(born), frame)])
            self.hits = np.concatenate([self.hits, np.ones(len(born), dtype=np.int64)])
            if self.p.minimum_consecutive_frames <= 1:
                ids[born] = new
        return ids


PIECE = [*SCOPE, "_piece", "_slice"]
BOX = ["x1", "y1", "x2", "y2"]
SEED, WARM, OWN = 0, 1, 2


def association_width(detections: DataFrame, params: TrackingParams = TrackingParams()
                      ) -> int | None:
    """Slice width in frames for the busiest scope, None while no scope needs slices or none is longer than one."""
    width = slice_width(detections, SCOPE, "frame_id", 2 * params.lost_track_buffer + 1)
    return None if width is None else math.ceil(width)


def associate_tracks(detections: DataFrame, params: TrackingParams = TrackingParams(),
                     width: int | None = None) -> DataFrame:
    """Detections with a track_id, blind to the class; ids never cross a scope.

    A scope is cut wherever no detection is seen for longer than the lost-track buffer, because no
    track survives that. The pieces run in parallel, and rows stream through in frame order.

    With a width (in frames) a piece is cut further. Every slice first runs through the frames just
    before it; where the tracks it then holds equal the tracks the slice before ends with, its result
    is the sequential one up to names, and names are linked. Other slices run again from that end.
    """
    order = dict(order="frame_id", width=width, tie=["detection_id"])
    rows = neighbor(detections, SCOPE, values={"_before": F.col("frame_id")}, **order)
    fresh = F.col("_before").isNull() | (
        F.col("frame_id") - F.col("_before") > params.lost_track_buffer)
    rows = carry(rows.withColumn("_fresh", fresh), SCOPE,
                 values={"_piece": ("last", F.when(F.col("_fresh"), F.col("frame_id")))}, **order)
    rows = rows.select(*SCOPE, F.col("_piece").cast("long"), F.col("frame_id").cast("long"),
                       "detection_id", *[F.col(b).cast("double") for b in BOX],
                       F.col("confidence").cast("double"))
    kind, none = F.lit(OWN).alias("_kind"), F.lit(None).cast("long")
    tail = [kind, none.alias("_id"), none.alias("_seen"), none.alias("_hits"), none.alias("_pos")]
    if width is None:
        own = rows.select("*", F.lit(0).cast("long").alias("_slice"), *tail)
        out = _follow(own, params, None)
        return out.filter("kind = 'row'").select(*SCOPE, "frame_id", "detection_id", "track_id")

    warm_frames = 2 * params.lost_track_buffer
    if width <= warm_frames:
        raise ValueError("a slice must be longer than twice the lost-track buffer")
    at = F.col("frame_id") - F.col("_piece")
    own = rows.select("*", slice_of(at, width).alias("_slice"), *tail)
    early = own.filter(slice_of(at + warm_frames, width) > F.col("_slice")).withColumns(
        {"_slice": F.col("_slice") + 1, "_kind": F.lit(WARM)})
    # warm-up frames only matter to slices that exist
    live = own.select(*PIECE).distinct()
    done = cut(_follow(own.unionByName(early.join(live, PIECE, "left_semi")), params, width))
    while True:
        wrong = cut(_disagreeing(done))
        if wrong.isEmpty():
            break
        before = done.filter("kind = 'end'").withColumn("_slice", F.col("_slice") + 1)
        seeds = before.join(wrong, PIECE, "left_semi").select(
            *SCOPE, "_piece", (F.col("_piece") + F.col("_slice") * width - 1).alias("frame_id"),
            F.lit(None).cast(dict(rows.dtypes)["detection_id"]).alias("detection_id"), *BOX,
            F.lit(None).cast("double").alias("confidence"), "_slice", F.lit(SEED).alias("_kind"),
            F.col("track_id").alias("_id"), "_seen", "_hits", "_pos")
        again = _follow(own.join(wrong, PIECE, "left_semi").unionByName(seeds), params, width)
        done = cut(done.join(wrong, PIECE, "left_anti").unionByName(again))
    names = _linked_names(done)
    rows_out = done.filter("kind = 'row'").join(
        names, [*PIECE, "track_id"], "left").withColumn(
        "track_id", F.coalesce("_name", "track_id"))
    return rows_out.select(*SCOPE, "frame_id", "detection_id", "track_id")


STATE = [*BOX, "_seen", "_hits"]


def _disagreeing(done: DataFrame) -> DataFrame:
    """Slices whose first tracks differ from the last tracks of the slice before."""
    def listed(kind: str, name: str, shift: int) -> DataFrame:
        entry = F.struct("_pos", *STATE)
        return done.filter(F.col("kind") == kind).withColumn("_slice", F.col("_slice") + shift).groupBy(
            *PIECE).agg(F.array_sort(F.collect_list(entry)).alias(name))

    real = done.filter("kind = 'row' or kind = 'mark'").select(*PIECE).distinct()
    first = listed("start", "a", 0)
    last = listed("end", "b", 1)
    both = real.join(first, PIECE, "left").join(last, PIECE, "left")
    return both.filter((F.col("_slice") > 0) & ~F.col("a").eqNullSafe(F.col("b"))).select(*PIECE)


def _linked_names(done: DataFrame) -> DataFrame:
    """Final name of every track that was alive when its slice began, carried from slice to slice."""
    key = [*PIECE, "_pos"]
    ends = done.filter("kind = 'end'").withColumn("_slice", F.col("_slice") + 1).select(
        *key, F.col("track_id").alias("_prior"))
    links = done.filter("kind = 'start'").select(*key, "track_id").join(ends, key)
    ordered = links.repartition(*PIECE[:-1]).sortWithinPartitions(*PIECE, "_pos")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        piece, at, now, before = None, None, {}, {}
        for pdf in batches:
            names = []
            for row in pdf.itertuples(index=False):
                here = tuple(row[:3])
                if here != piece:
                    piece, at, now = here, None, {}
                if row[3] != at:
                    # names carry over only to the very next slice
                    before = now if at is not None and row[3] == at + 1 else {}
                    at, now = row[3], {}
                # columns: piece (3), slice, position, own name, name in the slice before
                name = before.get(row[6], row[6])
                now[row[5]] = name
                names.append(name)
            yield pdf[[*PIECE, "track_id"]].assign(_name=names)

    types = dict(links.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in [*PIECE, "track_id"]) + ", _name long"
    return ordered.mapInPandas(run, schema)


def _follow(rows: DataFrame, params: TrackingParams, width: int | None) -> DataFrame:
    """Runs the association over sorted pieces.

    Gives `row` (a detection and its track), `mark` (a slice that has rows), and with a width the
    tracks held at the `start` and `end` of every slice.
    """
    columns = [*PIECE, "kind", "frame_id", "detection_id", "track_id", *BOX, "_seen", "_hits", "_pos"]
    types = dict(rows.dtypes)
    schema = (", ".join(f"{c} {types[c]}" for c in PIECE)
              + f", kind string, frame_id long, detection_id {types['detection_id']}, track_id long, "
              + ", ".join(f"{b} double" for b in BOX) + ", _seen long, _hits long, _pos long")
    # few pieces may hold long work, so tasks stay more than cores and are not put together by their bytes
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    ordered = rows.repartition(tasks, *PIECE).sortWithinPartitions(
        *PIECE, "frame_id", "_kind", "_pos", "detection_id")
    step_by = [*PIECE, "frame_id", "_kind"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        piece, tracker, begun, rest = None, None, False, None
        out: list[tuple] = []  # (piece, kind, frame, detection ids, track ids, state or None)

        def held(kind: str, frame: int) -> None:
            tracker.forget(frame)
            if len(tracker.ids):
                out.append((piece, kind, frame, None, tracker.ids,
                            (tracker.boxes, tracker.seen, tracker.hits)))

        def boundary(ahead: int) -> int:
            return int(piece[2]) + (int(piece[3]) + ahead) * width

        def finish() -> None:
            if piece is not None and width is not None:
                held("end", boundary(1))

        def feed(cols: dict[str, np.ndarray], a: int, b: int) -> None:
            nonlocal piece, tracker, begun
            here = tuple(cols[c][a] for c in PIECE)
            if here != piece:
                finish()
                piece, tracker, begun = here, Associator(params), False
            kind, frame = int(cols["_kind"][a]), int(cols["frame_id"][a])
            boxes = cols["box"][a:b]
            if kind == SEED:
                tracker.restore(boxes.copy(), *(cols[c][a:b].astype(np.int64)
                                                for c in ("_id", "_seen", "_hits")))
                return
            if kind == OWN and not begun:
                begun = True
                if width is not None:
                    out.append((piece, "mark", frame, None, np.array([-1]), None))
                    if piece[3] > 0:
                        held("start", boundary(0))
            ids = tracker.step(frame, boxes, cols["confidence"][a:b])
            if kind == OWN and (ids >= 0).any():
                out.append((piece, "row", frame, cols["detection_id"][a:b][ids >= 0],
                            ids[ids >= 0], None))

        def flush() -> pd.DataFrame:
            sizes = [len(o[4]) for o in out]
            blank = [np.full(n, np.nan) for n in sizes]

            def state(i: int, pick) -> np.ndarray:
                return pick(out[i][5]) if out[i][5] is not None else blank[i]

            def each(pick) -> np.ndarray:
                return np.concatenate([state(i, pick) for i in range(len(out))])

            data = {c: np.repeat(np.array([o[0][i] for o in out], dtype=object), sizes)
                    for i, c in enumerate(PIECE)}
            data["kind"] = np.repeat(np.array([o[1] for o in out], dtype=object), sizes)
            data["frame_id"] = np.repeat([o[2] for o in out], sizes)
            data["detection_id"] = np.concatenate(
                [o[3] if o[3] is not None else np.full(n, None) for o, n in zip(out, sizes)])
            data["track_id"] = np.concatenate([o[4] for o in out])
            for i, b in enumerate(BOX):
                data[b] = each(lambda s, i=i: s[0][:, i])
            data["_seen"], data["_hits"] = each(lambda s: s[1]), each(lambda s: s[2])
            data["_pos"] = each(lambda s: np.arange(len(s[1])))
            done = pd.DataFrame(data, columns=columns)
            for c in ("_seen", "_hits", "_pos"):
                done[c] = done[c].astype("Int64")
            out.clear()
            return done

        def arrays(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
            cols = {c: pdf[c].to_numpy() for c in (*step_by, "detection_id", "_id", "_seen", "_hits")}
            cols["box"] = pdf[BOX].to_numpy(float)
            cols["confidence"] = pdf["confidence"].to_numpy(float)
            return cols

        for pdf in batches:
            if rest is not None:
                pdf = pd.concat([rest, pdf], ignore_index=True)
            marks = pdf[step_by]
            cuts = np.nonzero((marks != marks.shift()).any(axis=1).to_numpy())[0]
            cols = arrays(pdf)
            # the last step may go on in the next batch
            for a, b in zip(cuts, cuts[1:]):
                feed(cols, a, b)
            rest = pdf.iloc[cuts[-1]:] if len(cuts) else None
            if out:
                yield flush()
        if rest is not None and len(rest):
            feed(arrays(rest), 0, len(rest))
        finish()
        if out:
            yield flush()

    return ordered.mapInPandas(run, schema)
