"""Shared pieces: tables, settled steps, ordinals, and byte-level views of Arrow text columns."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kinewatch.operators.lineage import checkpoint_folder

#: White space of the contracts: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that one numpy step looks at; a longer document is a step of its own.
STEP_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Writes a step to the shared checkpoint folder and reads it back: lineage ends here, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def key128(value: Column, prefix: str) -> list[Column]:
    """Two independent 64-bit hashes of a value."""
    return [F.xxhash64(value).alias(f"{prefix}1"), F.xxhash64(F.lit(5), value).alias(f"{prefix}2")]


def remainder_of_id(doc_id: Column, parts: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def ordinals(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds 0, 1, 2, ... in the given order: ranges are numbered apart and shifted by the counts before them."""
    ranged = settle(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_range", F.shiftright("_id", 33))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")
    return ranged.join(before, "_range").withColumn(name, place.cast("long")).drop("_id", "_range", "_before")


def rows_of(batches: Iterator[pa.RecordBatch], text: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each holds at most `limit` bytes of text, or one document."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            base = ends[start] - sizes[start]
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and the n + 1 offsets of its documents (null: empty)."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Documents as lower-cased words: joined by one space, each document ended by a line feed."""

    def __init__(self, column: pa.Array):
        data, offsets = raw_bytes(column)
        n = len(offsets) - 1
        flat = np.full(len(data) + n, 10, np.uint8)
        place = np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets))
        flat[place] = data
        flat[flat - np.uint8(65) < 26] += 32
        solid = ~((flat == 32) | (flat - np.uint8(9) < 5))
        ends = offsets[1:] + np.arange(n)
        seen = np.cumsum(solid)
        first = np.zeros(n, seen.dtype)
        first[1:] = seen[ends[:-1]] if n > 1 else first[1:]
        keep = solid.copy()
        keep[ends] = True
        gap = np.flatnonzero(~solid[:-1] & solid[1:])
        doc = np.searchsorted(ends, gap)
        gap = gap[(seen[gap] > first[doc]) & (ends[doc] != gap)]
        keep[gap] = True
        flat[gap] = 32
        self.bytes = flat[keep]
        stops = np.cumsum(keep)[ends]
        #: bytes[starts[i]:stops[i]] is document i with its line feed
        self.starts, self.stops = np.concatenate([[0], stops[:-1]]).astype(np.int64), stops.astype(np.int64)
        cut = np.flatnonzero((self.bytes == 32) | (self.bytes == 10))
        begin = np.concatenate([[0], cut[:-1] + 1])
        word = cut > begin
        self.word_start, self.word_stop = begin[word], cut[word]
        self.word_doc = np.searchsorted(self.stops, self.word_start, side="right")
        self.word_count = np.bincount(self.word_doc, minlength=n)

    def spans(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans."""
        n = len(self.bytes)
        power, back = powers(1 << max(16, int(n).bit_length()))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(scatter()[self.bytes] * power[:n], out=sums[1:])
        return mix((sums[stop] - sums[start]) * back[start])


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finalizer of splitmix64)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def scatter() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@lru_cache(2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    base = 0xD6E8FEB86659FD93
    both = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        both.append(np.cumprod(p, dtype=np.uint64))
    return both[0], both[1]
