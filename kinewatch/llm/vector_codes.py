"""Vector code compression: product codes whose codebooks are trained and searched by the equal-average method.

(sum(x) - sum(y))^2 / dimension never exceeds the squared distance of x and y. So entries are sorted by component sum,
and each part looks outward from its own sum until that bound strictly exceeds its best distance: ties are all seen.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinewatch.llm.common import settle
from kinewatch.llm.vectors import finite, matrix, packed

UNIT, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Rows that one numpy step looks at.
STEP = 4096
#: Components beyond this, times UNIT, have no 64-bit distances; an error above LONGEST is given as LONGEST.
LIMIT, LONGEST = 2.0**62, 2**63 - 1


def integers(blobs, dim: int, unit: int = UNIT) -> np.ndarray:
    """floor(unit * x) of each component: 64-bit numbers, or Python's where a squared sum of gaps could pass 64 bits."""
    x = np.floor(matrix(blobs, dim) * unit)
    if not x.size or 2 * np.abs(x).max() * dim < 2**31:
        return x.astype(np.int64)
    return np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry of each row, the lower index of equals."""
    if x.dtype == object or entries.dtype == object or not _narrow(entries):
        x, entries = x.astype(object), entries.astype(object)
    width, sums = x.shape[1], entries.sum(axis=1)
    order = np.array(sorted(range(len(entries)), key=lambda i: (sums[i], i)))
    sums, entries = sums[order], entries[order]
    own = x.sum(axis=1)
    middle = np.minimum(np.searchsorted(sums, own), len(sums) - 1)
    best, index = ((x - entries[middle]) ** 2).sum(axis=1), order[middle]
    sides = {step: (np.arange(len(x)), middle + step) for step in (-1, 1)}
    while sides:  # one entry farther on each side
        for step, (rows, at) in list(sides.items()):
            inside = (at >= 0) & (at < len(sums))
            rows, at = rows[inside], at[inside]
            # strictly beyond the best distance: nothing farther out can be nearer or as near
            open_ = ((sums[at] - own[rows]) ** 2 <= best[rows] * width).astype(bool)
            rows, at = rows[open_], at[open_]
            if not len(rows):
                del sides[step]
                continue
            far = ((x[rows] - entries[at]) ** 2).sum(axis=1)
            new = order[at]
            better = ((far < best[rows]) | ((far == best[rows]) & (new < index[rows]))).astype(bool)
            best[rows[better]], index[rows[better]] = far[better], new[better]
            sides[step] = rows, at + step
    return index, best


def _narrow(entries: np.ndarray) -> bool:
    return 2 * int(np.abs(entries).max()) * entries.shape[1] < 2**31


def _part_sums(rows: DataFrame, dim: int, books) -> DataFrame:
    """part, entry, position, n and total of the parts that a task's rows have nearest each entry, summed over tasks."""
    parts, width = len(books.value), dim // len(books.value)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = [np.zeros(len(b), np.int64) for b in books.value]
        total = [np.zeros(b.shape, object) for b in books.value]
        for f in frames:
            for at in range(0, len(f), STEP):
                x = integers(f["blob"].iloc[at : at + STEP], dim)
                for p in range(parts):
                    own = x[:, p * width : (p + 1) * width]
                    index, _ = nearest(own, books.value[p])
                    n[p] += np.bincount(index, minlength=len(n[p]))
                    step = np.zeros(total[p].shape, own.dtype)
                    np.add.at(step, index, own)  # STEP rows of under 2**31 each: no overflow
                    total[p] += step
        for p in range(parts):
            used = np.flatnonzero(n[p])
            if len(used):
                yield pd.DataFrame({"part": p, "entry": np.repeat(used, width), "position": np.tile(np.arange(width), len(used)), "n": np.repeat(n[p][used], width),
                                    "total": [Decimal(int(v)) for v in total[p][used].ravel()]})

    found = rows.select("blob").mapInPandas(run, "part int, entry int, position int, n long, total decimal(38,0)")
    return found.groupBy("part", "entry", "position").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def train(rows: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """One codebook a part, from rows (vec_id, blob) of one length; at most parts * entries * width numbers reach the driver in a round."""
    width = dim // parts
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "blob").limit(entries).select("blob").collect()
    start = integers([r[0] for r in first], dim)
    books = [start[:, p * width : (p + 1) * width] for p in range(parts)]
    for _ in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(books)  # parts * entries * width numbers
        found = _part_sums(rows, dim, shared).collect()
        shared.destroy()
        books = [b.astype(object) for b in books]
        for r in found:
            books[r["part"]][r["entry"], r["position"]] = int(r["total"]) // r["n"]
        books = [b.astype(np.int64) if _narrow(b) else b for b in books]
    return books


def encode(rows: DataFrame, dim: int, books: list[np.ndarray]) -> DataFrame:
    """rows with code (two hex digits a part) and error in place of blob."""
    keep = [c for c in rows.columns if c != "blob"]
    shared = rows.sparkSession.sparkContext.broadcast(books)
    width = dim // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                x = integers(part.column("blob").to_pylist(), dim)
                found = [nearest(x[:, p * width : (p + 1) * width], b) for p, b in enumerate(shared.value)]
                code = ["".join(f"{i:02x}" for i in c) for c in zip(*[i.tolist() for i, _ in found], strict=True)]
                error = [min(LONGEST, sum(int(v) for v in e)) for e in zip(*[d.tolist() for _, d in found], strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(code, pa.string()), pa.array(error, pa.int64())], names=[*keep, "code", "error"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return rows.select(*keep, "blob").mapInArrow(run, f"{fields}, code string, error long")


def decode(code: str, books: list[np.ndarray], unit: int = UNIT) -> list[float]:
    """The vector that a code stands for."""
    places = [int(code[i : i + 2], 16) for i in range(0, len(code), 2)]
    return [float(v) / unit for b, i in zip(books, places, strict=True) for v in b[i]]


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in books for row in b for v in row).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of every usable row.

    Vectors that are null, empty or hold null or non-finite components are left out, as are those whose length is no multiple of `parts`
    and those with components of 2**52 or more, whose distances pass 64 bits; an error or sum beyond 64 bits is given as the largest long. Vectors
    of different length are coded apart, each length with codebooks of its own. Fewer than `entries` rows: that many
    entries. Repeated ids are rows of their own and start the codebooks in order of id (null last), then components. Equal
    distances: the lower index. Null labels are one label. Empty table: empty result. Other columns aren't read.
    """
    usable = vectors.filter(finite(F.col("embedding"))).filter((F.size("embedding") > 0) & (F.size("embedding") % parts == 0))
    usable = usable.filter(~F.exists("embedding", lambda x: F.abs(x.cast("double")) >= F.lit(LIMIT / UNIT)))
    rows = settle(packed(usable, ["vec_id", "label"]))
    coded = None
    for r in sorted(rows.select("dim").distinct().collect()):
        of = rows.filter(F.col("dim") == r["dim"]).select("vec_id", "label", "blob")
        books = train(of, r["dim"], parts, entries, rounds)
        part = encode(of, r["dim"], books).withColumn("codebooks_sha256", F.lit(digest(books)))
        coded = part if coded is None else coded.unionByName(part)
    if coded is None:
        return vectors.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).limit(0)
    coded = settle(coded)
    most = F.lit(LONGEST).cast("decimal(38,0)")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(20,0)")).cast("decimal(38,0)"), most).cast("long").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")


def _sql() -> str:
    distance = "list_sum(list_transform(list_zip(p.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [f"""
v as (
  select vec_id, label, list_transform(embedding, lambda x: floor({UNIT} * x::double)::bigint) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
p as materialized (
  select vec_id, label, part, e[part * (len(e) // {PARTS}) + 1 : (part + 1) * (len(e) // {PARTS})] as e from v, (select unnest(range({PARTS})) as part)),
b0 as materialized (
  select part, row_number() over (partition by part order by vec_id) - 1 as entry, e from p
  where vec_id in (select vec_id from v order by vec_id limit {ENTRIES}))"""]
    for r in range(ROUNDS + 1):
        steps.append(f"""
a{r} as materialized (
  select p.vec_id, p.part, arg_min(b.entry, (({distance})::hugeint * 1000 + b.entry)) as entry, min({distance})::bigint as dist
  from p join b{r} b on p.part = b.part group by p.vec_id, p.part)""")
        if r < ROUNDS:
            steps.append(f"""
b{r + 1} as materialized (
  select b.part, b.entry, coalesce(n.e, b.e) as e from b{r} b left join (
    select part, entry, list(floor(s / n)::bigint order by pos) as e from (
      select part, entry, pos, sum(x)::double as s, count(*) as n from (
        select a.part, a.entry, unnest(p.e) as x, unnest(range(len(p.e))) as pos from a{r} a join p on a.vec_id = p.vec_id and a.part = p.part)
      group by part, entry, pos) group by part, entry) n on b.part = n.part and b.entry = n.entry)""")
    return "with " + ",".join(steps) + f""",
c as (
  select a.vec_id, string_agg(printf('%02x', a.entry), '' order by a.part) as code, sum(dist)::bigint as error
  from a{ROUNDS} a group by a.vec_id),
h as (select sha256(string_agg(array_to_string(e, ','), ',' order by part, entry)) as h from b{ROUNDS})
select c.vec_id, v.label, c.code, c.error, sum(c.error) over (partition by v.label)::bigint as label_error, h.h as codebooks_sha256
from c join v using (vec_id), h
"""


SQL = _sql()
