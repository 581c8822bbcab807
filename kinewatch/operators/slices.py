"""Ordered work on keys of any size.

A window or fold over one key runs in one task, which is fine until a single camera or track holds
a large share of all rows. The helpers here take a `width`: with None they are plain Spark windows,
with `Slices` the large keys are cut along the order column where their rows lie, slices run in
parallel, and only one summary row per slice is carried from slice to slice. A number cuts every key
into slices of that width. All give equal rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinewatch.operators.lineage import cut

MAX_GROUP_ROWS = 50_000
SHORTEST_SECONDS = 2.0  # longer than any duration the motion states wait for


def slice_width(df: DataFrame, keys: list[str], order: str = "timestamp_seconds",
                at_least: float = SHORTEST_SECONDS, limit: int | None = None) -> float | None:
    """None while every key is small enough for one task, otherwise a width for the densest one.

    The width gives slices of about half the limit. One aggregation over the key columns and the
    order column; it combines before the shuffle. None as well if no large key is as long as a slice
    of `at_least` would be.
    """
    limit = limit or MAX_GROUP_ROWS
    sizes = df.groupBy(*keys).agg(
        F.count("*").alias("n"), (F.max(order) - F.min(order)).cast("double").alias("span"))
    width, longest = sizes.filter(F.col("n") > limit).agg(
        F.min(F.col("span") * limit / (2 * F.col("n"))), F.max("span")).first()
    return None if width is None or longest < at_least else max(width, float(at_least))


#: Points of a quantile sketch, and how finely it tells ranks apart.
GRID, ACCURACY = 64, 4096


@dataclass(frozen=True)
class Slices:
    """Where the large keys are cut: per key an array of pieces, each cut evenly into numbered slices.

    A key without an entry is one slice. No slice is shorter than `at_least`. Groups of the finer key `whole`, if
    there is one, have been counted and are all small, so steps within them need no slices.
    """

    keys: list[str]
    pieces: DataFrame  # keys, _pieces array<struct<start, width, first, last>>
    at_least: float
    whole: tuple[str, ...] = ()


Width = float | Slices | None


def within(width: Width, keys: list[str]) -> Width:
    """None if all groups of these keys are known to be small, otherwise the width as it is."""
    return None if isinstance(width, Slices) and width.whole and set(width.whole) <= set(keys) else width


def plan_slices(tables: list[DataFrame], keys: list[str], order: str = "timestamp_seconds",
                at_least: float = SHORTEST_SECONDS, limit: int | None = None,
                finer: list[str] | None = None) -> Slices | None:
    """None while every key is small enough for one task, otherwise slices of at most `limit` rows.

    `tables` share the keys and the order column and are counted together, because what is sorted
    together must fit together. Large keys get quantile sketches of the order column; ranges whose even
    slices still hold too many rows are sketched again on their own, so a dense burst within an idle
    key is cut as finely as it needs, down to slices of `at_least`. `finer` names a longer key of some of the
    tables: steps within its groups stay whole if a count shows all of them to be small.
    """
    limit = limit or MAX_GROUP_ROWS
    rows = None
    for df in tables:
        part = df.select(*keys, F.col(order).cast("double").alias("_x")).filter("_x is not null")
        rows = part if rows is None else rows.unionByName(part)
    large = cut(rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit).select(*keys))
    if large.isEmpty():
        return None
    rows = cut(rows.join(small(large), keys))  # read twice a round
    whole = ()
    having = [df.select(*finer) for df in tables if set(finer) <= set(df.columns)] if finer else []
    if having:
        groups = functools.reduce(DataFrame.unionByName, having).groupBy(*finer).agg(F.count("*").alias("_n"))
        whole = tuple(finer) if groups.filter(F.col("_n") > limit).isEmpty() else ()
    done, dense = None, rows.withColumn("_from", F.lit(float("-inf")))
    while True:
        sketch = dense.groupBy(*keys, "_from").agg(
            F.percentile_approx("_x", [i / GRID for i in range(GRID)], ACCURACY).alias("q"),
            F.max("_x").alias("top"), F.count("*").alias("n"))
        new = cut(sketch.select(*keys, "_from", "q", "top", "n").mapInPandas(_pieces(keys, limit, at_least), _piece_schema(rows, keys)))
        # a piece that was sketched again gives way to what replaces it
        gone = new.select(*keys, F.col("_from").alias("start")).distinct()
        done = new if done is None else cut(done.join(gone, [*keys, "start"], "left_anti").unionByName(new))
        found = Slices(keys, cut(_numbered(done, keys)), float(at_least), whole)
        counts = _placed(rows, found).groupBy(*keys, "_start", "_width", "_slice").agg(F.count("*").alias("n"))
        over = counts.filter((F.col("n") > limit) & (F.col("_width") >= 2 * at_least)).select(
            *keys, F.col("_start").alias("start")).distinct()
        again = cut(over.join(done.filter("final").select(*keys, "start"), [*keys, "start"], "left_anti"))
        if again.isEmpty():
            return found
        again = again.withColumnRenamed("start", "_start")
        dense = _placed(rows, found).join(small(again), [*keys, "_start"]).withColumnRenamed("_start", "_from")


def _piece_schema(rows: DataFrame, keys: list[str]) -> str:
    types = dict(rows.dtypes)
    return ", ".join(f"{k} {types[k]}" for k in keys) + ", _from double, start double, stop double, parts long, final boolean"


def piece_starts(begin: float, q: list[float], top: float, n: int, limit: int, at_least: float) -> list[float]:
    """Where to cut a range of n rows with the sketch q: at quantiles, or around a burst shorter than `at_least`."""
    want = min(GRID, max(2, math.ceil(2 * n / limit)))

    def thinned(points: Iterator[float]) -> list[float]:
        out = [begin if math.isfinite(begin) else q[0]]
        for x in points:
            if x - out[-1] >= at_least and top - x >= at_least:
                out.append(x)
        return out

    starts = thinned(q[i * GRID // want] for i in range(1, want))
    if len(starts) == 1:
        starts = thinned(sorted(x + d for x in q for d in (-at_least, at_least)))
    return starts


def _pieces(keys: list[str], limit: int, at_least: float):
    """Start, end and number of even slices of each piece, none shorter than `at_least`; final: can't be cut further."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                *key, begin, q, top, n = row
                starts = piece_starts(begin, list(q), top, n, limit, at_least)
                each = math.ceil(2 * n / min(GRID, max(2, math.ceil(2 * n / limit))) / limit)
                for a, b in zip(starts, [*starts[1:], top]):
                    parts = max(1, min(each, int((b - a) / at_least)))
                    out.append((*key, begin, a, b, parts, len(starts) == parts == 1 and math.isfinite(begin)))
            yield pd.DataFrame(out, columns=[*keys, "_from", "start", "stop", "parts", "final"])

    return run


def _numbered(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Pieces of each key as one sorted array; slices are numbered through."""
    row = F.struct("start", "stop", "parts")
    sorted_ = pieces.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("p"))

    def step(acc: Column, x: Column) -> Column:
        width = F.when(x["parts"] > 1, (x["stop"] - x["start"]) / x["parts"]).otherwise(
            F.greatest(x["stop"] - x["start"], F.lit(1e-9)))
        piece = F.struct(x["start"].alias("start"), width.alias("width"), acc["n"].alias("first"),
                         (acc["n"] + x["parts"] - 1).alias("last"))
        return F.struct((acc["n"] + x["parts"]).alias("n"), F.concat(acc["out"], F.array(piece)).alias("out"))

    kind = "array<struct<start:double,width:double,first:bigint,last:bigint>>"
    begin = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast(kind).alias("out"))
    return sorted_.select(*keys, F.aggregate("p", begin, step)["out"].alias("_pieces"))


def _slice_in(x: Column) -> tuple[Column, Column, Column]:
    """Slice number, start and slice width of the piece that x lies in; before all pieces is slice 0."""
    before = F.filter("_pieces", lambda p: p["start"] <= x)
    piece = F.get(before, F.size(before) - 1)
    step = F.least(F.floor((x - piece["start"]) / piece["width"]).cast("long"), piece["last"] - piece["first"])
    return F.coalesce(piece["first"] + step, F.lit(0).cast("long")), piece["start"], piece["width"]


def _placed(rows: DataFrame, slices: Slices) -> DataFrame:
    number, start, width = _slice_in(F.col("_x"))
    return rows.join(small(slices.pieces), slices.keys).select(
        *slices.keys, "_x", number.alias("_slice"), start.alias("_start"), width.alias("_width"))


def place(df: DataFrame, order: Column, width: float | Slices, name: str = "_slice") -> DataFrame:
    """Adds the number of the slice that a value of the order column falls into; later values never get smaller ones."""
    if not isinstance(width, Slices):
        return df.withColumn(name, slice_of(order, width))
    with_x = df.withColumn("_x", order.cast("double")).join(small(width.pieces), width.keys, "left")
    return with_x.withColumn(name, _slice_in(F.col("_x"))[0]).drop("_x", "_pieces")


def shortest(width: float | Slices) -> float:
    return width.at_least if isinstance(width, Slices) else width


def slice_of(order: Column, width: float) -> Column:
    return F.floor(order / F.lit(float(width))).cast("long")


def carry(df: DataFrame, keys: list[str], order: str, values: dict[str, tuple[str, Column]],
          width: Width = None, *, tie: list[str] | None = None,
          descending: bool = False, inclusive: bool = True) -> DataFrame:
    """Running value per key in the given order.

    `values` maps an output column to (how, column); how is 'last' (latest non-null), 'max' or 'sum'.
    `inclusive=False` leaves the current row out. `tie` always sorts ascending.
    """
    tie = tie or []
    first = F.col(order).desc() if descending else F.col(order).asc()
    sort = [first, *[F.col(t) for t in tie]]
    upto = 0 if inclusive else -1

    width = within(width, keys)

    def over(how: str, col: Column, w) -> Column:
        return {"last": lambda: F.last(col, True), "max": lambda: F.max(col),
                "sum": lambda: F.sum(col)}[how]().over(w)

    if width is None:
        w = Window.partitionBy(*keys).orderBy(*sort).rowsBetween(Window.unboundedPreceding, upto)
        return df.withColumns({n: over(how, c, w) for n, (how, c) in values.items()})

    tmp = {n: f"_in_{n}" for n in values}
    df = df.withColumns({tmp[n]: c for n, (_, c) in values.items()})
    df = cut(place(df, F.col(order), width))  # read twice below
    part = [*keys, "_slice"]
    w = Window.partitionBy(*part).orderBy(*sort).rowsBetween(Window.unboundedPreceding, upto)
    local = df.withColumns({n: over(how, F.col(tmp[n]), w) for n, (how, _) in values.items()})

    # position of a row in the running direction, as one comparable struct (ties ascend)
    rank = F.struct((-F.col(order) if descending else F.col(order)).alias("o"), *tie)
    aggs = []
    for n, (how, _) in values.items():
        c = F.col(tmp[n])
        agg = {"last": F.max_by(c, F.when(c.isNotNull(), rank)), "max": F.max(c), "sum": F.sum(c)}
        aggs.append(agg[how].alias(f"_own_{n}"))
    by = F.col("_slice").desc() if descending else F.col("_slice").asc()
    before = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    prior = df.groupBy(*part).agg(*aggs).select(
        *part, *[over(how, F.col(f"_own_{n}"), before).alias(f"_pre_{n}")
                 for n, (how, _) in values.items()])
    joined = local.join(prior, part)
    combine = {
        "last": lambda n: F.coalesce(F.col(n), F.col(f"_pre_{n}")),
        "max": lambda n: F.greatest(F.col(n), F.col(f"_pre_{n}")),
        "sum": lambda n: F.when(
            F.col(n).isNotNull() | F.col(f"_pre_{n}").isNotNull(),
            F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col(f"_pre_{n}"), F.lit(0))),
    }
    out = joined.withColumns({n: combine[how](n) for n, (how, _) in values.items()})
    return out.drop("_slice", *tmp.values(), *[f"_pre_{n}" for n in values])


def neighbor(df: DataFrame, keys: list[str], order: str, values: dict[str, Column],
             width: Width = None, *, tie: list[str] | None = None,
             following: bool = False) -> DataFrame:
    """Value of the previous (or following) row of the key; values must not be null."""
    width = within(width, keys)
    if width is None:
        w = Window.partitionBy(*keys).orderBy(order, *(tie or []))
        shift = F.lead if following else F.lag
        return df.withColumns({n: shift(c).over(w) for n, c in values.items()})
    if following and tie:
        raise ValueError("a following neighbor with ties is not supported on slices")
    return carry(df, keys, order, {n: ("last", c) for n, c in values.items()}, width, tie=tie,
                 descending=following, inclusive=False)


def with_ordinal(df: DataFrame, keys: list[str], order: str, name: str = "ord",
                 width: Width = None, tie: list[str] | None = None) -> DataFrame:
    """0-based position of each row within its key."""
    width = within(width, keys)
    if width is None:
        w = Window.partitionBy(*keys).orderBy(order, *(tie or []))
        return df.withColumn(name, (F.row_number().over(w) - 1).cast("long"))
    out = carry(df, keys, order, {name: ("sum", F.lit(1).cast("long"))}, width, tie=tie)
    return out.withColumn(name, F.col(name) - 1)


def with_halo(df: DataFrame, keys: list[str], order: str, n: int, width: float | Slices) -> DataFrame:
    """Adds to every slice the last n rows of the key before it, flagged `_halo`.

    Each earlier non-empty slice has at least one row, so the n slices before hold the n rows.
    """
    cols = df.columns
    df = cut(place(df, F.col(order), width))  # read twice below
    part = [*keys, "_slice"]
    newest = Window.partitionBy(*part).orderBy(F.col(order).desc())
    tails = (
        df.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= n)
        .groupBy(*part)
        .agg(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*cols).alias("_row")))
             .alias("_tail"))
    )
    prev = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(-n, -1)
    halo = (
        tails.withColumn("_prev", F.flatten(F.collect_list("_tail").over(prev)))
        .select("_slice", F.explode(F.slice(F.sort_array("_prev", asc=False), 1, n)).alias("_h"))
        .select("_h._row.*", "_slice", F.lit(True).alias("_halo"))
    )
    return df.withColumn("_halo", F.lit(False)).unionByName(halo)


def nearest_frame(probes: DataFrame, frames: DataFrame, keys: list[str], at: Column, name: str,
                  payload: list[str], width: Width = None, *, ts: str = "timestamp_seconds",
                  backward: bool = False) -> DataFrame:
    """As-of join: adds the first frame at or after `at` (or the last at or before it).

    Probes and frames are sorted together once, so no pairs are formed.
    """
    payload_type = frames.select(F.struct(*payload).alias("x")).schema["x"].dataType
    probe_cols = probes.columns
    probe_type = probes.select(F.struct(*probe_cols).alias("x")).schema["x"].dataType
    left = frames.select(
        *keys, F.col(ts).cast("double").alias("_t"), F.lit(0).alias("_k"),
        F.struct(*payload).alias("_f"), F.lit(None).cast(probe_type).alias("_p"))
    right = probes.select(
        *keys, at.cast("double").alias("_t"), F.lit(1).alias("_k"),
        F.lit(None).cast(payload_type).alias("_f"), F.struct(*probe_cols).alias("_p"))
    both = carry(left.unionByName(right), keys, "_t", {"_hit": ("last", F.col("_f"))}, width,
                 tie=["_k"], descending=not backward)
    # keys come from the sorted rows, so that later steps know them to lie together
    probe = [F.col(c) if c in keys else F.col("_p")[c].alias(c) for c in probe_cols]
    return both.filter("_k = 1").select(*probe, F.col("_hit").alias(name))


MAX_BROADCAST_ROWS = 10_000


def small(df: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcasts a table that a count shows to be short; a longer one is left to Spark."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
