"""Exact top-k search without random access: sorted lists are read in steps, and bounds of the scores decide when to stop."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinewatch.llm.common import settle
from kinewatch.llm.vectors import finite, matrix, packed

K, EVERY, UNIT = 10, 100, 1024.0
#: Rows of a block of candidates and of queries, and the shares of the lists that are read step by step.
BLOCK, QUERIES, STEPS = 4096, 1024, (0.25, 0.5, 0.75, 1.0)


def _search(dim: int, k: int, unit: float):
    """The k best of a block of candidates for each query of a block of queries.

    For each component there is a list of the candidates by value, read from the top where the query's weight is positive
    and from the bottom where it is negative, all lists to the same depth. What is read adds to a score; an unread
    entry is worth at most the last one read of its list, and at least the list's last. When no more than 2 k candidates
    can reach the k-th lower bound, or the lists end, their final scores are summed up.
    """

    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        asks, rows = f[f["asks"]], f[~f["asks"]]
        none = pd.DataFrame({"query_id": [], "ask": [], "vec_id": [], "score": []}).astype("int64")
        if not len(asks) or not len(rows):
            return none
        x, q = np.floor(matrix(rows["blob"], dim) * unit), np.floor(matrix(asks["blob"], dim) * unit)
        ids, ask_ids, marks = rows["vec_id"].to_numpy(), asks["vec_id"].to_numpy(), asks["mark"].to_numpy()
        if dim and float(np.abs(x).max()) * float(np.abs(q).max()) * dim >= 2**53:
            x, q = x.astype(np.int64), q.astype(np.int64)  # beyond exact doubles
        n, want = len(x), min(k, len(x))
        order = np.argsort(-x, axis=0, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(n)[:, None], axis=0)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        best = np.take_along_axis(x, order, axis=0) if dim else x
        open_, out = np.arange(len(q)), []
        own = ids[None, :] == ask_ids[:, None]
        for share in STEPS:
            t = max(1, int(np.ceil(n * share)))
            top, low = place < t, place >= n - t
            p, m = up[open_].T, down[open_].T
            read = (x * top) @ p + (x * low) @ m
            if t < n:
                last_up, last_down = (best[t - 1], best[n - t]) if dim else (x[0], x[0])
                high = read + (~top).astype(x.dtype) @ (p * last_up[:, None]) + (~low).astype(x.dtype) @ (m * last_down[:, None])
                least = read + (~top).astype(x.dtype) @ (p * best[-1][:, None]) + (~low).astype(x.dtype) @ (m * best[0][:, None])
            else:
                high = least = read
            least = np.where(own[open_].T, np.iinfo(np.int64).min, least)
            bound = np.partition(least, n - want, axis=0)[n - want]
            may = (high >= bound) & ~own[open_].T
            still = []
            for j, i in enumerate(open_):
                some = np.flatnonzero(may[:, j])
                if len(some) > 2 * k and t < n:
                    still.append(i)
                    continue
                score = (x[some] @ q[i]).astype(np.int64)
                take = np.lexsort((ids[some], -score))[:k]
                out.append(pd.DataFrame({"query_id": ask_ids[i], "ask": marks[i], "vec_id": ids[some][take], "score": score[take]}))
            open_ = np.array(still, int)
            if not len(open_):
                break
        return pd.concat(out) if out else none

    return run


def search(vectors: DataFrame, k: int = K, every: int = EVERY, unit: float = UNIT, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score: the k best rows for each row whose vec_id is divisible by `every`.

    Scores are inner products of the components floor(unit * x). Ties go to the smaller vec_id. Vectors that are null or
    hold null or non-finite components take no part, nor do rows without a vec_id; vectors of another length than the
    query's aren't compared. A query isn't compared with rows of its own vec_id. Equal query rows are one query. Fewer
    candidates: all of them. Empty table: empty result. Queries and candidates meet in blocks, a task for each two.
    """
    usable = settle(packed(vectors.filter(F.col("vec_id").isNotNull() & finite(F.col("embedding"))), ["vec_id"]).withColumn("mark", F.xxhash64("blob")))
    asking = usable.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "mark"])
    found = None
    counts = {r["dim"]: r["n"] for r in usable.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    asked = {r["dim"]: r["n"] for r in asking.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    for dim, n in sorted(counts.items()):
        if dim not in asked:
            continue
        row_blocks, ask_blocks = -(-n // block), -(-asked[dim] // queries)
        spot = lambda parts: F.pmod(F.xxhash64("vec_id", "mark"), F.lit(parts)).cast("int")
        every_of = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
        rows = usable.filter(F.col("dim") == dim).select("vec_id", "mark", "blob", F.lit(False).alias("asks"), spot(row_blocks).alias("rb"), every_of(ask_blocks).alias("qb"))
        asks = asking.filter(F.col("dim") == dim).select("vec_id", "mark", "blob", F.lit(True).alias("asks"), every_of(row_blocks).alias("rb"), spot(ask_blocks).alias("qb"))
        part = rows.unionByName(asks).groupBy("rb", "qb").applyInPandas(_search(dim, k, unit), "query_id long, ask long, vec_id long, score long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = W.partitionBy("query_id", "ask").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = r"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 10
"""
