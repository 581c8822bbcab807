"""Embedding near-dedup: an exact metric range join over cells around pivots."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinewatch.llm.common import settle
from kinewatch.llm.components import components
from kinewatch.llm.vectors import finite, matrix, packed

MIN_COSINE = 0.9
#: Pivots, and rows of a block; a task joins two blocks.
PIVOTS, BLOCK = 16, 4096
#: Distances are compared with this slack, cosines near the bound are computed anew from the vectors as given.
SLACK = 1e-9


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable rows with the smallest id of their equals, and one row for each such class with its number of rows."""
    usable = vectors.filter(finite(F.col("embedding"))).filter(F.exists("embedding", lambda x: x != 0))
    usable = usable.select("vec_id", F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("embedding"))
    grouped = usable.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("rows"))
    return usable, settle(packed(grouped, ["rep", "rows"]))


def _assign(classes: DataFrame, dim: int, radius: float, pivots: int) -> DataFrame:
    """Rows of cells: cell, own (its nearest pivot's) or not, rep, rows, blob.

    If x is within r of a y of cell j, then d(x, p_j) <= d(y, p_j) + r <= d(y, p_i) + r <= d(x, p_i) + 2 r for every
    pivot p_i; so x goes also to the cells j whose pivot is at most 2 r farther than its own. A pair of different cells is
    met in the smaller one alone, so only those are needed.
    """
    chosen = classes.filter(F.col("dim") == dim).orderBy(F.xxhash64("rep"), "rep").limit(pivots).select("blob").collect()
    points = matrix([r[0] for r in chosen], dim)
    points = points / np.linalg.norm(points, axis=1, keepdims=True)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), 2048):
                part = f.iloc[at : at + 2048]
                x = matrix(part["blob"], dim)
                x = _unit(x)
                d = np.sqrt(np.maximum(0.0, 2 - 2 * (x @ points.T)))
                home = d.argmin(1)
                near = (d - d[np.arange(len(d)), home][:, None] <= 2 * radius + SLACK) & (np.arange(len(points)) < home[:, None])
                near[np.arange(len(d)), home] = True
                row, cell = np.nonzero(near)
                out = part.iloc[row]
                yield pd.DataFrame({"cell": cell, "own": cell == home[row], "rep": out["rep"].to_numpy(), "rows": out["rows"].to_numpy(), "blob": out["blob"].to_numpy()})

    return classes.filter(F.col("dim") == dim).select("rep", "rows", "blob").mapInPandas(run, "cell int, own boolean, rep long, rows long, blob binary")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))


def _join_blocks(dim: int, min_cosine: float):
    """Joins the two blocks of a task: link counts by rep, and a forest of the links (never all pairs)."""

    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        left, right = f[f["side"] == 0], f[f["side"] == 1]
        same = not len(right)
        right = left if same else right
        if not len(left):
            return pd.DataFrame(columns=["rep", "links", "other"])
        raw_a, raw_b = matrix(left["blob"], dim), matrix(right["blob"], dim)
        a, b = _unit(raw_a), _unit(raw_b)
        ids_a, ids_b, n_a, n_b = left["rep"].to_numpy(), right["rep"].to_numpy(), left["rows"].to_numpy(), right["rows"].to_numpy()
        links_a, links_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        parent = np.arange(len(a) + (0 if same else len(b)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        edges, shift = [], 0 if same else len(a)
        for at in range(0, len(a), 512):
            s = a[at : at + 512] @ b.T
            hit = s >= min_cosine
            for i, j in np.argwhere(np.abs(s - min_cosine) <= SLACK):
                hit[i, j] = _cosine(raw_a[at + i], raw_b[j]) >= min_cosine
            if same:
                hit &= np.arange(len(b)) > np.arange(at, at + len(s))[:, None]
            rows, cols = np.nonzero(hit)
            np.add.at(links_a, rows + at, n_b[cols])
            np.add.at(links_a if same else links_b, cols, n_a[rows + at])
            for i, j in zip((rows + at).tolist(), cols.tolist(), strict=True):
                x, y = root(i), root(j + shift)
                if x != y:
                    parent[x] = y
                    edges.append((ids_a[i], ids_b[j]))
        found = [pd.DataFrame({"rep": ids_a[links_a > 0], "links": links_a[links_a > 0], "other": None})]
        if not same:
            found.append(pd.DataFrame({"rep": ids_b[links_b > 0], "links": links_b[links_b > 0], "other": None}))
        if edges:
            found.append(pd.DataFrame({"rep": [e[0] for e in edges], "links": None, "other": [e[1] for e in edges]}))
        return pd.concat([x.astype({"rep": "Int64", "links": "Int64", "other": "Int64"}) for x in found])

    return run


def range_join(classes: DataFrame, min_cosine: float = MIN_COSINE, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """rep and links (rows of linked classes), and forest edges rep - other with links null, of all pairs within the bound."""
    radius = math.sqrt(max(0.0, 2 - 2 * min_cosine))
    out = None
    for (dim,) in classes.select("dim").distinct().collect():  # vectors of another length are never near
        cells = settle(_assign(classes, dim, radius, pivots))
        counts = {(r["cell"], r["own"]): r["n"] for r in cells.groupBy("cell", "own").agg(F.count("*").alias("n")).collect()}  # two a pivot
        blocks = lambda own: F.element_at(F.create_map(*[F.lit(v) for c in range(pivots) for v in (c, -(-counts.get((c, own), 0) // block))]), F.col("cell"))  # noqa: E731, B023
        placed = cells.withColumns({"own_blocks": blocks(True), "guest_blocks": blocks(False)})
        nth = F.pmod(F.xxhash64("rep"), F.when(F.col("own"), F.col("own_blocks")).otherwise(F.col("guest_blocks"))).cast("int")
        placed = placed.withColumn("b", nth)
        # own blocks meet each other once (a task for each pair), guests meet all own blocks
        with_own = F.transform(F.sequence(F.lit(0), F.col("own_blocks") - 1), lambda o: F.struct(
            F.least(o, F.col("b")).alias("a"), F.greatest(o, F.col("b")).alias("z"), F.lit(False).alias("guest"), (F.col("b") > o).cast("int").alias("side")))
        with_guests = F.when(F.col("guest_blocks") > 0, F.transform(F.sequence(F.lit(0), F.col("guest_blocks") - 1), lambda g: F.struct(
            F.col("b").alias("a"), g.alias("z"), F.lit(True).alias("guest"), F.lit(0).alias("side")))).otherwise(F.array().cast("array<struct<a:int,z:int,guest:boolean,side:int>>"))
        as_guest = F.transform(F.sequence(F.lit(0), F.col("own_blocks") - 1), lambda o: F.struct(
            o.alias("a"), F.col("b").alias("z"), F.lit(True).alias("guest"), F.lit(1).alias("side")))
        tasks = placed.filter(F.col("own_blocks") > 0).withColumn("t", F.explode(F.when(F.col("own"), F.concat(with_own, with_guests)).otherwise(as_guest)))
        found = tasks.select("cell", "t.*", "rep", "rows", "blob").groupBy("cell", "a", "z", "guest").applyInPandas(_guarded(dim, min_cosine), "rep long, links long, other long")
        out = found if out is None else out.unionByName(found)
    return out


def _guarded(dim: int, min_cosine: float):
    join = _join_blocks(dim, min_cosine)

    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        _, a, z, guest = key
        if (guest or a != z) and f["side"].nunique() < 2:  # one of the blocks is empty
            return pd.DataFrame({"rep": [], "links": [], "other": []}).astype({"rep": "Int64", "links": "Int64", "other": "Int64"})
        return join(key, f)

    return run


def link_vectors(vectors: DataFrame, min_cosine: float = MIN_COSINE, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors.

    Null, zero and non-finite vectors link with nothing; so do vectors of different length. Equal vectors are one class
    and link with each other. Repeated vec_ids are rows of their own that link if they are near. Null vec_id: no link.
    Empty table: empty result. Other columns aren't read.
    """
    usable, classes = _classes(vectors.filter(F.col("vec_id").isNotNull()))
    found = range_join(classes, min_cosine, pivots, block)
    keyed = usable.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("rows"))
    member = usable.join(keyed, "embedding").select("vec_id", "rep", "rows")
    if found is None:
        links = groups = None
    else:
        found = settle(found)
        links = found.filter(F.col("links").isNotNull()).groupBy("rep").agg(F.sum("links").alias("links"))
        groups = components(found.filter(F.col("other").isNotNull()).select(F.col("rep").alias("a"), F.col("other").alias("b"))).withColumnRenamed("vertex", "rep")
        member = member.join(links, "rep", "left").join(groups, "rep", "left")
    if links is None:
        member = member.withColumns({"links": F.lit(0).cast("long"), "component": F.lit(None).cast("long")})
    per_id = member.select("vec_id", (F.col("rows") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c"))
    per_id = per_id.groupBy("vec_id").agg(F.max("n").alias("n"), F.min("c").alias("c"))
    return vectors.select("vec_id").join(per_id, "vec_id", "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("c", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"))
