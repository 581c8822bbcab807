"""Mixing sources to target weights: pivotal dependent rounding of copies, in a reduction tree."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinewatch.llm.common import ordinals, settle

#: Weights of the sources in order, repeating, and the most copies of a document.
WEIGHTS, MOST = (5.0, 2.0, 1.0), 3.0
#: Documents in a leaf of the tree, and leaves under a node.
LEAF, FAN = 4096, 256


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Adds target to (source, source_size): shares by weight of the size of all, none above `most` times its source's size."""
    ranked = settle(ordinals(sources, [F.col("source").asc_nulls_last()], "place"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * most)
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:  # each round fills one source more at least, and the rounds before the last share the excess
        is_full = F.col("weight") * level >= F.col("most")
        held, open_weight, now = ranked.agg(F.sum(F.when(is_full, F.col("most"))), F.sum(F.when(~is_full, F.col("weight"))), F.count(F.when(is_full, 1))).first()
        if now == full or not open_weight:
            break
        full, level = now, (total - float(held or 0)) / open_weight
    return ranked.withColumn("target", F.least(F.col("weight") * level, F.col("most")) if level else F.lit(0.0))


def _pair(frames):
    """Walks a part in order; the mass of a fractional document and of the next is moved until one is whole."""
    for key, level, rows in _runs(frames):
        carry = None
        out = []
        for row, size, part, luck in rows:
            if part <= 0.0 or part >= 1.0:
                out.append((*row, round(part), False))
                continue
            if carry is None:
                carry = (row, size, part)
                continue
            other, s0, p0 = carry
            up, down = min((1 - p0) * s0, part * size), min(p0 * s0, (1 - part) * size)
            move = up if luck * (up + down) < down else -down
            first, second = p0 + move / s0, part - move / size
            if abs(move) == (up if move > 0 else down) and ((move > 0 and up == (1 - p0) * s0) or (move < 0 and down == p0 * s0)):
                out.append((*other, 1 if move > 0 else 0, False))
                carry = (row, size, second) if 1e-12 < second < 1 - 1e-12 else None
                if carry is None:
                    out.append((*row, round(second), False))
            else:
                out.append((*row, 0 if move > 0 else 1, False))
                carry = (other, s0, first) if 1e-12 < first < 1 - 1e-12 else None
                if carry is None:
                    out.append((*other, round(first), False))
            if len(out) >= 20_000:
                yield _frame(out, key)
                out = []
        if carry is not None:
            out.append((*carry[0], carry[2], True))
        if out:
            yield _frame(out, key)


def _frame(out, key):
    frame = pd.DataFrame(out, columns=["row_id", "size", "part", "open"])
    frame["place"], frame["leaf"] = key
    return frame[["place", "leaf", "row_id", "size", "part", "open"]].astype({"part": float})


def _runs(frames):
    """Groups of a sorted partition, as (key, 0, rows); a group may go over several frames and is read as a stream."""
    def stream():
        for frame in frames:
            yield from zip(frame["place"], frame["leaf"], frame["row_id"], frame["size"], frame["part"], frame["luck"], strict=True)

    rows = stream()
    ahead = next(rows, None)
    while ahead is not None:
        key = ahead[:2]

        def group():
            nonlocal ahead
            while ahead is not None and ahead[:2] == key:
                yield (ahead[2], ahead[3]), ahead[3], ahead[4], ahead[5]
                ahead = next(rows, None)

        yield key, 0, group()


def round_copies(parts: DataFrame, leaves: int, seed: int) -> DataFrame:
    """parts: place, leaf, row_id, size, part (a fraction of a copy). Returns row_id, part: 0 or 1.

    The expected value of each part stays, and the sum of part * size by place changes only by the last open document.
    """
    shape = "place long, leaf long, row_id string, size long, part double, open boolean"
    done, level, frontier = [], 0, parts.filter(F.col("part") > 0)
    while True:
        luck = F.shiftrightunsigned(F.xxhash64(F.lit(seed + level), F.col("row_id")), 11) / float(1 << 53)
        dealt = frontier.withColumn("luck", luck).repartition("place", "leaf").sortWithinPartitions("place", "leaf", F.xxhash64(F.lit(seed), F.col("row_id")), "row_id")
        step = settle(dealt.select("place", "leaf", "row_id", "size", "part", "luck").mapInPandas(_pair, shape))
        done.append(step.filter(~F.col("open")))
        if leaves <= 1:
            last = step.filter("open").withColumn("part", (F.shiftrightunsigned(F.xxhash64(F.lit(seed - 1), F.col("row_id")), 11) / float(1 << 53) < F.col("part")).cast("double"))
            done.append(last)
            break
        leaves, level = -(-leaves // FAN), level + 1
        frontier = step.filter("open").withColumn("leaf", F.floor(F.col("leaf") / FAN).cast("long")).drop("open")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("row_id", "part")


def mark_of() -> Column:
    """A hash of doc_id, text and source; hashes skip nulls, so it also takes which of them are null."""
    names = ["doc_id", "text", "source"]
    return F.xxhash64(*names, *[F.col(c).isNull() for c in names])


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = 7) -> DataFrame:
    """A row for every row of docs: doc_id, source, size (words), mark (a hash of id, text and source), source_size, target, copies.

    Each document is due target / source_size copies; the whole part is sure, the rest is rounded. Null text: size 0 and
    no copy. Null source: a source of its own, the last. Repeated rows are documents of their own. Empty table: empty.
    Other columns of docs aren't read. Same rows, same result.
    """
    slim = settle(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), mark_of().alias("mark")))
    sources = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    by_source = settle(targets(sources, weights, most))
    most_docs = by_source.agg(F.max("n")).first()[0] or 0
    # rows that are equal in all of this are told apart by a number
    counted = slim.groupBy("doc_id", "source", "size", "mark").agg(F.count("*").alias("rows"))
    told = counted.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    told = told.withColumn("row_id", F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.hex("mark"), "nth"))
    due = F.least(F.col("target") / F.col("source_size"), F.lit(most))
    due = F.when(F.abs(due - F.round(due)) < 1e-12, F.round(due)).otherwise(due)
    plan = told.join(by_source.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    plan = settle(plan.withColumn("due", F.when(F.col("size") > 0, due).otherwise(0.0)).withColumn("sure", F.floor("due"))
                  .select("doc_id", "source", "size", "mark", "row_id", "place", "n", "source_size", "target", "sure", (F.col("due") - F.col("sure")).alias("part")))
    leaves = F.ceil(F.col("n") / LEAF)
    parts = plan.withColumn("leaf", F.pmod(F.xxhash64(F.lit(seed), F.col("row_id"), F.lit(1)), leaves).cast("long"))
    rounded = round_copies(parts.select("place", "leaf", "row_id", "size", "part"), -(-most_docs // LEAF), seed)
    done = plan.join(rounded.withColumnRenamed("part", "more"), "row_id", "left")
    return done.select("doc_id", "source", "size", "mark", "source_size", "target", (F.col("sure") + F.coalesce("more", F.lit(0))).cast("long").alias("copies"))


def repeat_documents(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    copies = mixed.filter(F.col("copies") > 0).groupBy("doc_id", "mark").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    keyed = docs.withColumn("_mark", mark_of())
    # equal rows share their copies: all but one of them go before the repetition
    joined = keyed.join(copies.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("mark")))
    once = joined.filter(F.col("rows") == 1).unionByName(joined.filter(F.col("rows") > 1).dropDuplicates(["doc_id", "_mark"]))
    return once.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(mixed: DataFrame) -> DataFrame:
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
