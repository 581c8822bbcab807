"""Large JSON documents as many tasks.

A document {"name": [record, ...], ...} is read in byte ranges. A first pass tells of each range how it changes the
nesting depth and whether a string is open, for either start (inside a string or not); running totals over the ranges give
every range its true start. With these a second pass finds where the top-level lists lie, and a third reads the records that begin
in each range. A record may be longer than a range; nobody holds more than a range and one record.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinewatch.operators.lineage import cut

#: Bytes of a range, and of one more read for a record that goes on behind it.
RANGE, MORE = 32 << 20, 1 << 20
QUOTE, BACKSLASH, COMMA = ord('"'), ord("\\"), ord(",")
OPEN, CLOSE = (ord("["), ord("{")), (ord("]"), ord("}"))


def file_at(path: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(path) if "://" in path else (LocalFileSystem(), path.removeprefix("file:"))


def _read(path: str, start: int, stop: int) -> bytes:
    fs, at = file_at(path)
    with fs.open_input_file(at) as f:
        return f.read_at(max(0, stop - start), start)


class Marks(NamedTuple):
    quotes: np.ndarray  # places of quotes that open or close a string
    brackets: np.ndarray  # places of all brackets, within strings too
    up: np.ndarray  # whether a bracket opens


def _marks(data: bytes, before: bytes) -> Marks:
    """before: what stands ahead of data, as far as backslashes reach."""
    flat = np.frombuffer(data, np.uint8)
    slash = flat == BACKSLASH
    quotes = np.flatnonzero(flat == QUOTE)
    if slash.any() or before.endswith(b"\\"):
        # a quote is escaped by an odd number of backslashes right before it
        last_other = np.maximum.accumulate(np.where(slash, -1, np.arange(len(flat))))
        last_other = np.concatenate([[-1], last_other[:-1]])
        run = np.arange(len(flat)) - 1 - last_other
        lead = len(before) - len(before.rstrip(b"\\"))
        run = np.where(last_other < 0, run + lead, run)
        quotes = quotes[run[quotes] % 2 == 0]
    up = (flat == OPEN[0]) | (flat == OPEN[1])
    brackets = np.flatnonzero(up | (flat == CLOSE[0]) | (flat == CLOSE[1]))
    return Marks(quotes, brackets, up[brackets])


def _outside(m: Marks, inside: int) -> np.ndarray:
    """Which brackets stand outside of strings, if the data begins inside of one (1) or not (0)."""
    return (np.searchsorted(m.quotes, m.brackets) + inside) % 2 == 0


def _before(path: str, start: int) -> bytes:
    """The bytes before start, back to the first that is no backslash."""
    size, data = 16, b""
    while start and (not data or not data.strip(b"\\")) and size // 2 <= start * 2:
        data = _read(path, max(0, start - size), start)
        size *= 16
    return data


def ranges(spark: SparkSession, paths: dict[str, str], size: int = RANGE) -> DataFrame:
    """name, path, start, stop: a row for each byte range, spread over tasks of about `RANGE` bytes, so that small ranges share one."""
    files = []
    for name, path in paths.items():
        fs, at = file_at(path)
        total = fs.get_file_info(at).size
        if total is None:
            raise FileNotFoundError(path)
        files.append((name, path, max(total, 1)))
    every = spark.createDataFrame(files, "name string, path string, total long").select(
        "name", "path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(size).cast("long"))).alias("start"), "total")
    return every.select("name", "path", "start", F.least(F.col("start") + size, "total").alias("stop")).repartition(
        _tasks(spark, [total for _, _, total in files], size), "name", "start")


def _tasks(spark: SparkSession, totals: list[int], size: int) -> int:
    """At least a few tasks for every core while there are as many ranges, and no more than one for `RANGE` bytes beyond that."""
    pieces = sum(-(-total // size) for total in totals)
    return max(1, min(pieces, max(4 * spark.sparkContext.defaultParallelism, -(-sum(totals) // RANGE))))


def _with_starts(parts: DataFrame) -> DataFrame:
    """Adds depth and inside (a string) at the start of each range: one small row for each of two cases and range."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for path, start, stop in zip(pdf["path"], pdf["start"], pdf["stop"]):
                m = _marks(_read(path, start, stop), _before(path, start))
                deltas = [int(np.where(m.up, 1, -1)[_outside(m, h)].sum()) for h in (0, 1)]
                found.append((len(m.quotes) % 2, *deltas))
            turns, plain, quoted = zip(*found)
            yield pdf.assign(turns=turns, plain=plain, quoted=quoted)

    told = parts.mapInPandas(measure, "name string, path string, start long, stop long, turns int, plain int, quoted int")
    before = Window.partitionBy("name").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    inside = (F.coalesce(F.sum("turns").over(before), F.lit(0)) % 2).cast("int")
    told = told.withColumn("inside", inside)
    change = F.when(F.col("inside") == 1, F.col("quoted")).otherwise(F.col("plain"))
    depth = F.coalesce(F.sum(change).over(before), F.lit(0)).cast("int")
    return told.withColumn("depth", depth).select("name", "path", "start", "stop", "inside", "depth")


def _levels(m: Marks, inside: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of brackets outside of strings, whether they open, and the depth after each."""
    real = _outside(m, inside)
    at, up = m.brackets[real], m.up[real]
    return at, up, depth + np.cumsum(np.where(up, 1, -1))


def _lists(parts: DataFrame) -> DataFrame:
    """name, key, begin, end: the top-level lists that begin or end in each range (end or begin null: elsewhere)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                data = _read(r.path, r.start, r.stop)
                at, up, level = _levels(_marks(data, _before(r.path, r.start)), r.inside, r.depth)
                for i in np.flatnonzero(up & (level == 2)):
                    if data[at[i]] == OPEN[0]:
                        out.append((r.name, _key_before(r.path, r.start + int(at[i])), r.start + int(at[i])))
                out += [(r.name, None, r.start + int(at[i])) for i in np.flatnonzero(~up & (level == 1)) if data[at[i]] == CLOSE[0]]
            yield pd.DataFrame(out, columns=["name", "key", "place"])

    return parts.mapInPandas(run, "name string, key string, place long")


def _key_before(path: str, place: int) -> str | None:
    """The name in front of a list, as in `"name": [`; None if there is none (a list in a list)."""
    size = 256
    while True:
        text = _read(path, max(0, place - size), place).rstrip()
        if not text.endswith(b":"):
            return None
        text = text[:-1].rstrip()
        end = len(text) - 1
        begin = end - 1
        while begin >= 0 and not (text[begin] == QUOTE and (len(text[:begin]) - len(text[:begin].rstrip(b"\\"))) % 2 == 0):
            begin -= 1
        if begin >= 0 or size > place:
            return json.loads(text[max(begin, 0):]) if text.endswith(b'"') else None
        size *= 4


def read_records(spark: SparkSession, paths: dict[str, str], keys: list[str], size: int = RANGE) -> DataFrame:
    """name, key, place and value: the text of every record of the named top-level lists of each document, by byte place.

    A document without one of the lists stops with its name. Records are objects; other entries of a list are left out.
    """
    return _read_lists(*_located(spark, paths, keys, size), keys)


def read_record_lists(spark: SparkSession, paths: dict[str, str], keys: list[str], size: int = RANGE) -> dict[str, DataFrame]:
    """The same as a table for each key. The lists are located once, and a table reads only the ranges that its list touches."""
    parts, found = _located(spark, paths, keys, size)
    return {key: _read_lists(parts, found, [key]) for key in keys}


def _located(spark: SparkSession, paths: dict[str, str], keys: list[str], size: int) -> tuple[DataFrame, dict[str, list]]:
    """The ranges with their starts, written once because each table reads them, and key, begin and end of each document's lists."""
    spread = ranges(spark, paths, size)
    tasks = spread.rdd.getNumPartitions()
    parts = cut(_with_starts(spread)).repartition(tasks, "name", "start")
    found = {name: [] for name in paths}
    for r in _lists(parts).orderBy("name", "place").collect():  # two rows for each top-level list
        if r["key"] is not None:
            found[r["name"]].append([r["key"], r["place"], None])
        elif found[r["name"]] and found[r["name"]][-1][2] is None:
            found[r["name"]][-1][2] = r["place"]
    for name, lists in found.items():
        for key in keys:
            if key not in {x[0] for x in lists}:
                raise ValueError(f"{name}: '{key}' is missing or not a list")
    return parts, found


def _read_lists(parts: DataFrame, found: dict[str, list], keys: list[str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                own = [x for x in found[r.name] if x[0] in keys and x[1] < r.stop and (x[2] is None or x[2] > r.start)]
                if not own:
                    continue
                out = []
                for place, text in _records(r.path, r.start, r.stop, r.inside, r.depth):
                    key = next((k for k, a, b in own if a < place and (b is None or place < b)), None)
                    if key is not None:
                        out.append((r.name, key, place, text.decode("utf-8")))
                yield pd.DataFrame(out, columns=["name", "key", "place", "value"])

    return parts.mapInPandas(run, "name string, key string, place long, value string")


def _records(path: str, start: int, stop: int, inside: int, depth: int) -> Iterator[tuple[int, bytes]]:
    """Place and text of the objects of depth 3 that begin in a range."""
    data, before = _read(path, start, stop), _before(path, start)
    while True:
        at, up, level = _levels(_marks(data, before), inside, depth)
        begins = at[up & (level == 3)]
        begins = begins[begins < stop - start]
        ends = at[~up & (level == 2)]
        if not len(begins) or len(ends) and ends[-1] > begins[-1]:
            break
        more = _read(path, start + len(data), start + len(data) + max(MORE, len(data)))
        if not more:
            break
        data += more
    follow = np.searchsorted(ends, begins)
    for a, i in zip(begins.tolist(), follow.tolist()):
        if i < len(ends) and data[a] == OPEN[1]:
            yield start + a, data[a : int(ends[i]) + 1]
