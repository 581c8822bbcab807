"""Best-fit packing by linear grouping: lengths are rounded up in equal groups, configurations of few sizes are chosen,
real pieces take the places, and small ones go where they fit best. All choices are made on the histogram of lengths,
which has a row for each length and no more, whatever the input."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinewatch.llm.common import rows_of, settle

#: Tokens of a sequence, and the id that ends a document.
CAPACITY, END_ID = 1024, 2
#: Numbers of groups that are tried; pieces under this share of a sequence are small.
GROUPS, SMALL = (16, 64, 256, 1024), 1 / 8
#: Pieces of one length that are numbered together, about.
NUMBERED = 1 << 13

_encoders: dict[str, object] = {}


class Encoder:
    """Ids as the tokenizer file gives them. Its byte-level merges are run by the faster of two libraries where both agree."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.plain = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.fast = None
        step, model = spec["pre_tokenizer"] or {}, spec["model"]
        split = step.get("type") == "ByteLevel" and step.get("use_regex") and not step.get("add_prefix_space")
        if split and model["type"] == "BPE" and not spec["normalizer"] and not any(model.get(k) for k in ("dropout", "byte_fallback", "fuse_unk", "ignore_merges")):
            import public_tokenizers

            shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
            to_byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
            skip = {t["id"] for t in spec["added_tokens"]}
            ranks = {bytes(to_byte[c] for c in token): i for token, i in model["vocab"].items() if i not in skip}
            pairs = ((m.split(" ") if isinstance(m, str) else m) for m in model["merges"])
            order = [model["vocab"][a + b] for a, b in pairs]
            if order == sorted(order):  # merges in the order of ids: a rank is an id
                self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and not any(s in text for s in self.special):
            try:
                return np.array(self.fast.encode_ordinary(text), np.uint32)
            except BaseException as e:  # noqa: BLE001  the library's panic on extreme runs of white space isn't an Exception
                if type(e).__name__ != "PanicException" and not isinstance(e, Exception):
                    raise
        return np.array(self.plain.encode(text, add_special_tokens=False).ids, np.uint32)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if wanted, ids: each document's ids and its end, cut from the back.

    Null text: the end alone. Only documents longer than `capacity` are cut; their first piece takes the remainder.
    """
    shape = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        code = encoder(tokenizer)
        for batch in batches:
            for part in rows_of(iter([batch]), "text", 1 << 22):
                out = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = np.append(code.ids(text or ""), np.uint32(end_id)).astype("<u4")
                    n = -(-len(ids) // capacity)
                    start = 0
                    for i in range(n):
                        stop = len(ids) - (n - 1 - i) * capacity
                        cut = ids[start:stop]
                        out.append((doc, i, start, stop - start, zlib.crc32(cut.tobytes()), *([cut.astype(np.int32)] if with_ids else [])))
                        start = stop
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
                columns = [list(c) for c in zip(*out, strict=True)]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())][: 5 + with_ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, shape)


def _groups(sizes: np.ndarray, counts: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """Large lengths, longest first, in k groups of equal count (a length may go to two): lists of (length, count)."""
    total, out, room = int(counts.sum()), [], 0
    per = max(1, -(-total // k))
    for size, n in zip(sizes.tolist(), counts.tolist(), strict=True):
        while n:
            if not room:
                out.append([])
                room = per
            take = min(n, room)
            out[-1].append((size, take))
            room, n = room - take, n - take
    return out


def _configurations(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(times, sizes of one sequence): the largest open size, then what fills the rest most, as often as the counts allow."""
    left, out = dict(counts), []
    while left:
        top = max(left)
        chosen = [top]
        for s in _fill([s for s in left if s <= capacity - top], capacity - top):
            if chosen.count(s) < left[s]:
                chosen.append(s)
        times = min(left[s] // chosen.count(s) for s in chosen)
        for s in chosen:
            left[s] -= times
        left = {s: n for s, n in left.items() if n}
        out.append((times, chosen))
    return out


def _fill(sizes: list[int], room: int) -> list[int]:
    """Sizes whose sum comes nearest to room from below, as few as do; bit r of a number says that the sum r is reached."""
    mask, steps = (1 << (room + 1)) - 1, [1]
    while sizes and len(steps) <= 8 and not steps[-1] >> room & 1:
        ways = steps[-1]
        for s in sizes:
            ways |= steps[-1] << s
        ways &= mask
        if ways == steps[-1]:
            break
        steps.append(ways)
    total, out = steps[-1].bit_length() - 1, []
    for depth in range(len(steps) - 1, 0, -1):
        if steps[depth - 1] >> total & 1:
            continue
        size = next(s for s in sizes if s <= total and steps[depth - 1] >> (total - s) & 1)
        out.append(size)
        total -= size
    return out


def _plan(lengths: dict[int, int], capacity: int, k: int) -> tuple[int, list[tuple[int, int, int, int, int]]]:
    """Number of sequences, and places: (length, first rank, count, first sequence, offset): ranks go to sequences one by one."""
    small_under = max(1, int(capacity * SMALL))
    sizes = np.array(sorted((s for s in lengths if s >= small_under and s < capacity), reverse=True), int)
    counts = np.array([lengths[s] for s in sizes], int)
    used: dict[int, int] = {}
    places, bins, next_id = [], [], 0  # bins: [first sequence, count, filled]

    def put(length: int, first: int, n: int, offset: int) -> None:
        places.append((length, used.get(length, 0), n, first, offset))
        used[length] = used.get(length, 0) + n

    groups = _groups(sizes, counts, k) if len(sizes) else []
    supply: dict[int, list[list[int]]] = {}
    for group in groups:  # rounded up to the longest of the group
        supply.setdefault(group[0][0], []).extend([list(x) for x in group])
    rounded = {size: sum(n for _, n in have) for size, have in supply.items()}
    for times, config in _configurations(rounded, capacity):
        first, next_id = next_id, next_id + times
        runs = [[first, times, 0]]
        for size in config:
            have, fresh = supply[size], []
            for start, n, filled in runs:
                while n:
                    length, there = have[0]
                    take = min(n, there)
                    put(length, start, take, filled)
                    fresh.append([start, take, filled + length])
                    start, n = start + take, n - take
                    have[0][1] -= take
                    if not have[0][1]:
                        have.pop(0)
            runs = fresh
        bins += runs
    full = lengths.get(capacity, 0)
    if full:
        put(capacity, next_id, full, 0)
        next_id += full
    by_room: dict[int, list[list[int]]] = {}
    for run in bins:
        by_room.setdefault(capacity - run[2], []).append(run)
    for length in sorted((s for s in lengths if s < small_under), reverse=True):
        n = lengths[length]
        while n:
            room = min((r for r, runs in by_room.items() if r >= length and runs), default=None)
            if room is None:  # new sequences, each with as many of this length as go in
                each = capacity // length
                many = max(1, n // each)
                run, per = [next_id, many, 0], min(each, n)
                next_id += many
            else:
                run = by_room[room].pop()
                per = min(room // length, max(1, n // run[1]))
            start, count, filled = run
            take = min(count, n // per) or 1
            for j in range(per):
                put(length, start, take, filled + j * length)
            n -= take * per
            if take < count:
                by_room.setdefault(capacity - filled, []).append([start + take, count - take, filled])
            by_room.setdefault(capacity - filled - per * length, []).append([start, take, filled + per * length])
    return next_id, places


def best_plan(lengths: dict[int, int], capacity: int = CAPACITY) -> tuple[int, list[tuple[int, int, int, int, int]]]:
    return min((_plan(lengths, capacity, k) for k in GROUPS), key=lambda p: p[0])


def assign(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset, and drops row, of settled pieces of 1 to `capacity` tokens that are told apart by row.

    A piece that fills a sequence is one, wherever it lies: no shuffle. The others of a length are numbered in parts of
    about NUMBERED, so a common length isn't one group; the driver gets a count for each length.
    """
    spark = cut.sparkSession
    kept = [c for c in cut.columns if c != "row"]
    short = cut.filter(F.col("length") < capacity)
    lengths = {r["length"]: r["count"] for r in short.groupBy("length").count().collect()}  # under `capacity` rows
    sequences, places = best_plan(lengths, capacity) if lengths else (0, [])
    full = cut.filter(F.col("length") == capacity).select(*kept, (F.col("row") + sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if not lengths:
        return full
    parts = -(-max(lengths.values()) // NUMBERED)
    numbered = short.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))
    counts = numbered.groupBy("length", "part").agg(F.count("*").alias("n"))
    earlier = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = numbered.withColumn("rank", F.row_number().over(W.partitionBy("length", "part").orderBy("row")) - 1).join(before, ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before"))
    starts: dict[int, list[tuple[int, int, int]]] = {}
    for length, first, _, sequence, offset in places:
        starts.setdefault(length, []).append((first, sequence, offset))
    table = {length: tuple(np.array(c, np.int64) for c in zip(*sorted(p), strict=True)) for length, p in starts.items()}
    shared = spark.sparkContext.broadcast(table)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        for size in np.unique(lengths):
            here = lengths == size
            first, to, at = shared.value[int(size)]
            i = np.searchsorted(first, ranks[here], side="right") - 1
            sequence[here], offset[here] = to[i] + ranks[here] - first[i], at[i]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = ranked.withColumn("_p", place("length", "rank")).select(*kept, "_p.sequence_id", "_p.offset")
    return placed.unionByName(full)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Pieces of all rows of docs with their sequence and offset.

    Null and empty text: one piece, the end. Repeated rows: pieces of their own. Null doc_id: kept. Empty table: empty.
    Other columns of docs aren't read.
    """
    cut = pieces(docs, tokenizer, capacity, end_id, with_ids)
    return assign(settle(cut.withColumn("row", F.monotonically_increasing_id())), capacity)


def digest(packed: DataFrame) -> DataFrame:
    """Packed pieces with ids_crc32 taken from the ids that arrived, in place of the ids."""

    @F.pandas_udf("long")
    def crc32(ids: pd.Series) -> pd.Series:
        return pd.Series([zlib.crc32(np.asarray(x, "<i4").tobytes()) for x in ids], dtype="int64")

    return packed.withColumn("ids_crc32", crc32("ids")).drop("ids")
