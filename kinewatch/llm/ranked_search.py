"""Ranked lexical search by per-term geometric blocking, with whole results.

Documents are taken in shards, each inside one task. In a shard the posting list of a term is clustered by document
similarity into small blocks. A block stores the largest weight that any of its documents has in each coordinate (term),
so the sum of an item's coordinates of this summary bounds the score of all documents in it. A block is skipped only if that bound is under the
item's bar; all others are scored exactly. Bars start from the k-th best score of a seeding pass over all shards, so that
what one shard has found spares work in every other. No term or document is left out of the lists.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinewatch.llm.common import mix, powers, raw_bytes, rows_of, scatter, settle

K = 10
#: Fixed values of the score.
LOG_UNIT, TF_UNIT, FLAT, LENGTH, TF_STEP, M_STEP = 1000, 1_000_000_000, 25, 75, 1000, 8
#: Items, and bytes of their texts, of one pass over the documents; more items make more passes.
ITEMS, BYTES = 4096, 1 << 22
#: Documents, and entries (document, term), of a shard; documents of a block; directions that similarity is measured in.
SHARD_DOCS, SHARD_ENTRIES, BLOCK, DIRECTIONS = 8192, 1 << 21, 32, 16
#: Documents that an item scores in a shard to seed its bar.
SEEDS = 64
#: Bytes that one step of hashing looks at.
WINDOW = 1 << 20

DOCUMENT, COUNT, TOTAL = 0, 1, 2

_SOLID = np.zeros(256, bool)
_SOLID[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def term_hashes(column: pa.Array, window: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Document number and 64-bit hash of every term, in pieces of about `window` bytes, whatever a text's length."""
    data, offsets = raw_bytes(column)
    at = 0
    while at < len(data):
        size = window
        while True:  # a piece ends where a text does or before what follows a break, so no term is cut
            stop = min(at + size, len(data))
            breaks = np.flatnonzero(~_SOLID[data[at:stop]])
            cut = stop if stop == len(data) else max(at + int(breaks[-1]) + 1 if len(breaks) else at, int(offsets[np.searchsorted(offsets, stop, "right") - 1]))
            if cut > at:
                break
            size *= 2
        part = _LOWER[data[at:cut]]
        solid = _SOLID[part]
        first = offsets[np.searchsorted(offsets, at, "left") : np.searchsorted(offsets, cut, "left")] - at
        begin, end = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1]
        begin[first] = solid[first]
        end[:-1] &= ~solid[1:]
        end[first[first > 0] - 1] = solid[first[first > 0] - 1]
        start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
        power, back = powers(1 << max(16, len(part).bit_length()))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(scatter()[part] * power[: len(part)], out=sums[1:])
        yield np.searchsorted(offsets, start + at, "right") - 1, mix((sums[stop] - sums[start]) * back[start])
        at = cut


class Items:
    """The items of a pass: their terms as numbers in a sorted vocabulary of hashes, and how often each is asked for."""

    def __init__(self, rows: list[tuple]):
        self.ids = [r[0] for r in rows]
        owner, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for doc, h in term_hashes(pa.array([r[1] for r in rows], pa.string())):
            owner.append(doc)
            hashes.append(h)
        owner, hashes = np.concatenate(owner), np.concatenate(hashes)
        self.vocabulary = np.unique(hashes)
        pair, self.times = np.unique(owner * max(1, len(self.vocabulary)) + np.searchsorted(self.vocabulary, hashes), return_counts=True)
        self.item, self.term = np.divmod(pair, max(1, len(self.vocabulary)))
        self.start = np.searchsorted(self.item, np.arange(len(rows) + 1))
        by_term = np.argsort(self.term, kind="stable")
        self.askers = self.item[by_term]  # items of each term
        self.asked = np.searchsorted(self.term[by_term], np.arange(len(self.vocabulary) + 1))

    def terms(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        span = slice(self.start[q], self.start[q + 1])
        return self.term[span], self.times[span]

    def beside(self, term: int) -> np.ndarray:
        """All terms of the items that ask for a term: the coordinates that a bound over its list can need."""
        return np.unique(np.concatenate([self.terms(q)[0] for q in self.askers[self.asked[term] : self.asked[term + 1]]]))


def postings(docs: DataFrame, asked) -> DataFrame:
    """kind DOCUMENT: doc_id, n (terms of the text), terms and tfs (asked terms it holds). COUNT: a term's number (doc_id)
    and documents (n) in a task. TOTAL: documents with a term (doc_id) and terms (n) in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = asked.value.vocabulary
        seen, total = np.zeros(len(vocabulary), np.int64), np.zeros(2, np.int64)
        for batch in rows_of(batches, "text", 1 << 21):
            n = np.zeros(batch.num_rows, np.int64)
            keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for doc, h in term_hashes(batch.column("text")):
                n += np.bincount(doc, minlength=len(n))
                if len(vocabulary):
                    spot = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                    hit = vocabulary[spot] == h
                    key, count = np.unique(doc[hit] * len(vocabulary) + spot[hit], return_counts=True)
                    keys.append(key)
                    counts.append(count)
            keys, back = np.unique(np.concatenate(keys), return_inverse=True)
            tf = np.bincount(back, weights=np.concatenate(counts), minlength=len(keys)).astype(np.int64)
            total += (int((n > 0).sum()), int(n.sum()))
            if not len(keys):
                continue
            doc, term = np.divmod(keys, len(vocabulary))
            np.add.at(seen, term, 1)
            some, start = np.unique(doc, return_index=True)
            ends = np.append(start[1:], len(doc))
            term, tf = term.astype(np.int32), tf.astype(np.int32)
            yield _record(DOCUMENT, batch.column("doc_id").take(pa.array(some)), n[some], [term[a:b].tobytes() for a, b in zip(start, ends, strict=True)], [tf[a:b].tobytes() for a, b in zip(start, ends, strict=True)])
        out = np.flatnonzero(seen)
        yield _record(COUNT, pa.array(out), seen[out])
        yield _record(TOTAL, pa.array(total[:1]), total[1:])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "kind int, doc_id long, n long, terms binary, tfs binary")


def _record(kind: int, key: pa.Array, n: np.ndarray, terms: list | None = None, tfs: list | None = None) -> pa.RecordBatch:
    blobs = [pa.array(x if x is not None else [None] * len(n), pa.binary()) for x in (terms, tfs)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), key, pa.array(n), *blobs], names=["kind", "doc_id", "n", "terms", "tfs"])


def length_weights(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    if len(n) and LENGTH * int(n.max()) * docs >= 2**63:
        return np.array([FLAT + LENGTH * int(x) * docs // terms for x in n], np.int64)
    return FLAT + LENGTH * n * docs // max(terms, 1)


def _spread(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All numbers of the ranges start to stop, one range after the other."""
    size = stop - start
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


class Shard:
    """Some documents: their entries by document and by term, and blocks of a term's list on demand."""

    def __init__(self, items: Items, weight: np.ndarray, docs: int, terms: int, ids: pa.Array, n: np.ndarray, term_blobs: list, tf_blobs: list, block: int):
        self.items, self.ids, self.block = items, ids, block
        term, tf = np.frombuffer(b"".join(term_blobs), np.int32).astype(np.int64), np.frombuffer(b"".join(tf_blobs), np.int32).astype(np.int64)
        size = np.array([len(b) // 4 for b in term_blobs], np.int64)
        self.stop = np.cumsum(size)
        self.start = self.stop - size
        self.term, self.doc = term, np.repeat(np.arange(len(size)), size)
        m = length_weights(n, docs, terms)
        self.value = weight[term] * ((TF_UNIT * tf) // (TF_STEP * tf + M_STEP * m[self.doc]))
        width = len(items.vocabulary)
        self.keys = self.doc * width + term  # ascending: a document's terms are
        by_term = np.argsort(term, kind="stable")
        self.listed = self.doc[by_term]
        self.list_start = np.searchsorted(term[by_term], np.arange(width + 1))
        self.peak = np.zeros(width, np.int64)
        held = np.flatnonzero(np.diff(self.list_start))
        if len(held):
            self.peak[held] = np.maximum.reduceat(self.value[by_term], self.list_start[held])
        self.place = np.full(width, -1, np.int64)
        self._points: np.ndarray | None = None
        self.met, self.skipped = 0, 0  # blocks

    def list_of(self, term: int) -> np.ndarray:
        return self.listed[self.list_start[term] : self.list_start[term + 1]]

    def points(self) -> np.ndarray:
        """Documents as unit vectors in a few random directions, so that an inner product tells how alike two are."""
        if self._points is None:
            turn = np.random.default_rng(11).standard_normal((DIRECTIONS, len(self.items.vocabulary)))
            rows = np.stack([np.bincount(self.doc, weights=self.value * t[self.term], minlength=len(self.start)) for t in turn], axis=1)
            self._points = (rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)).astype(np.float32)
        return self._points

    def blocks(self, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a term's list: documents in order of their blocks, where blocks start, the coordinates, and each block's largest weight in each."""
        docs = self.list_of(term)
        cuts = np.array([0])
        if len(docs) > self.block:
            centers = docs[:: self.block]
            near = (self.points()[docs] @ self.points()[centers].T).argmax(1)
            order = np.argsort(near, kind="stable")
            docs, near = docs[order], near[order]
            first = np.concatenate([[0], np.flatnonzero(np.diff(near)) + 1])
            size = np.diff(np.append(first, len(docs)))
            cuts = _spread(first, first + size)[(_spread(np.zeros_like(size), size) % self.block) == 0]
        coordinates = self.items.beside(term)
        self.place[coordinates] = np.arange(len(coordinates))
        entry = _spread(self.start[docs], self.stop[docs])
        block = np.repeat(np.searchsorted(cuts, np.arange(len(docs)), "right") - 1, self.stop[docs] - self.start[docs])
        spot = self.place[self.term[entry]]
        known = spot >= 0
        summary = np.zeros(len(cuts) * len(coordinates), np.int64)
        np.maximum.at(summary, (block * len(coordinates) + spot)[known], self.value[entry[known]])
        self.place[coordinates] = -1
        return docs, cuts, coordinates, summary.reshape(len(cuts), len(coordinates))

    def scores(self, docs: np.ndarray, terms: np.ndarray, times: np.ndarray) -> np.ndarray:
        want = docs[:, None] * len(self.items.vocabulary) + terms
        spot = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return (np.where(self.keys[spot] == want, self.value[spot], 0) * times).sum(1)

    def seeds(self, q: int) -> np.ndarray:
        """Documents from the lists that can weigh most for an item."""
        terms, times = self.items.terms(q)
        out, have = [np.zeros(0, np.int64)], 0
        for t in terms[np.argsort(-self.peak[terms] * times, kind="stable")]:
            out.append(self.list_of(t))
            have += len(out[-1])
            if have >= SEEDS:
                break
        return np.unique(np.concatenate(out))

    def search(self, bars: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Item, documents and scores that may be among the k best of all; bars: scores below them can't be."""
        items, count = self.items, len(self.items.ids)
        bar = np.maximum(bars, 1)
        best = [np.zeros(0, np.int64)] * count
        top = [np.zeros(0, np.int64)] * count
        fresh = np.ones((count, len(self.start)), bool)
        left = np.zeros(count, np.int64)  # what an item's lists that are still to come can add up to
        np.add.at(left, items.item, items.times * self.peak[items.term])
        asked = np.zeros(len(self.peak), np.int64)
        np.maximum.at(asked, items.term, items.times * self.peak[items.term])
        for term in np.argsort(-asked, kind="stable"):
            if not self.peak[term]:
                break
            waiting = items.askers[items.asked[term] : items.asked[term + 1]]
            still = waiting[left[waiting] >= bar[waiting]]  # else no document without an earlier term gets over the bar
            if len(still):
                docs, cuts, coordinates, summary = self.blocks(term)
                stops = np.append(cuts[1:], len(docs))
            for q in still:
                terms, times = items.terms(q)
                bound = (summary[:, np.searchsorted(coordinates, terms)] * times).sum(1)
                may = np.flatnonzero(bound >= bar[q])
                self.met, self.skipped = self.met + len(bound), self.skipped + len(bound) - len(may)
                some = docs[_spread(cuts[may], stops[may])]
                some = some[fresh[q, some]]
                if not len(some):
                    continue
                fresh[q, some] = False
                score = self.scores(some, terms, times)
                over = score >= bar[q]
                top[q], best[q] = np.concatenate([top[q], some[over]]), np.concatenate([best[q], score[over]])
                if len(best[q]) >= k:
                    bar[q] = max(bar[q], np.partition(best[q], len(best[q]) - k)[len(best[q]) - k])
                    keep = best[q] >= bar[q]
                    top[q], best[q] = top[q][keep], best[q][keep]
            for q in waiting:
                own, times = items.terms(q)
                left[q] -= int(times[np.searchsorted(own, term)]) * int(self.peak[term])
        for q in range(count):
            if len(top[q]):
                yield q, top[q], best[q]


def _shards(batches: Iterator[pa.RecordBatch], made) -> Iterator[Shard]:
    """Collects a task's documents to shards of bounded size."""
    ids, n, terms, tfs, entries = [], [], [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            ids.append(part.column("doc_id"))
            n.append(part.column("n").to_numpy())
            blobs = part.column("terms").to_pylist()
            terms += blobs
            tfs += part.column("tfs").to_pylist()
            entries += sum(map(len, blobs)) // 4
            if len(terms) >= SHARD_DOCS or entries >= SHARD_ENTRIES:
                yield made(pa.concat_arrays(ids), np.concatenate(n), terms, tfs)
                ids, n, terms, tfs, entries = [], [], [], [], 0
    if terms:
        yield made(pa.concat_arrays(ids), np.concatenate(n), terms, tfs)


def _pass(docs: DataFrame, rows: list[tuple], k: int, block: int) -> DataFrame:
    """The k best documents of the items of one pass."""
    spark = docs.sparkSession
    items = Items(rows)
    asked = spark.sparkContext.broadcast(items)  # at most ITEMS items and the terms of BYTES bytes, or of one item
    found = settle(postings(docs, asked))
    total = found.filter(F.col("kind") == TOTAL).agg(F.sum("doc_id"), F.sum("n")).first()
    count, terms = int(total[0] or 0), int(total[1] or 0)
    df = found.filter(F.col("kind") == COUNT).groupBy("doc_id").agg(F.sum("n").alias("n")).toPandas()  # a row for each asked term
    weight = np.zeros(max(1, len(items.vocabulary)), np.int64)
    for t, d in zip(df["doc_id"], df["n"], strict=True):
        weight[t] = math.floor(LOG_UNIT * math.log((2 * count + 2) / (2 * int(d) + 1)))
    names = ["q", "item_id", "doc_id", "score"]

    def out(shard: Shard, q: int, docs_: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        n = len(docs_)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, q, np.int32)), pa.array([asked.value.ids[q]] * n, pa.int64()), shard.ids.take(pa.array(docs_)), pa.array(score)], names=names)

    def made(ids, n, term_blobs, tf_blobs) -> Shard:
        return Shard(asked.value, weight, count, terms, ids, n, term_blobs, tf_blobs, block)

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, made):
            for q in range(len(asked.value.ids)):
                some = shard.seeds(q)
                if len(some):
                    score = shard.scores(some, *asked.value.terms(q))
                    best = np.argsort(-score, kind="stable")[:k]
                    yield out(shard, q, some[best], score[best])

    vectors = found.filter(F.col("kind") == DOCUMENT).select("doc_id", "n", "terms", "tfs")
    shape = "q int, item_id long, doc_id long, score long"
    seeded = vectors.mapInArrow(seed, shape).select("q", "score")
    ranked = seeded.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score")))).filter(F.col("r") <= k)
    bars = np.zeros(len(rows), np.int64)
    for r in ranked.filter(F.col("r") == k).select("q", "score").collect():  # a row for each item
        bars[r["q"]] = r["score"]

    def search_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, made):
            for q, some, score in shard.search(bars, k):
                yield out(shard, q, some, score)

    order = W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = vectors.mapInArrow(search_, shape).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    best = settle(best.select("item_id", "rank", "doc_id", "score"))
    asked.destroy()
    return best


def search(docs: DataFrame, items: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id and score: the k best documents with a score above 0 for each row of items (item_id, text).

    Null and empty texts hold no terms: as documents they count for nothing, as items they find nothing. Texts may be
    of any length: they are hashed piece by piece. Ties go to the smaller doc_id, a null one last. Repeated rows of docs
    are documents of their own; equal rows of items are one item, rows that share an item_id alone are items of their own. A null item_id
    is ranked as any other. Empty tables: empty result. Other columns aren't read. Terms are told apart by 64-bit hashes.
    """
    spark, parts, rows, size = docs.sparkSession, [], [], 0
    for r in items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().toLocalIterator():
        rows.append((r["item_id"], r["text"]))
        size += len(r["text"] or "")
        if len(rows) >= ITEMS or size >= BYTES:
            parts.append(_pass(docs, rows, k, block))
            rows, size = [], 0
    if rows:
        parts.append(_pass(docs, rows, k, block))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for p in parts:
        out = p if out is None or len(parts) == 1 else out.unionByName(p)
    return out


SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t
  from documents),
g as (select count(*) as n, sum(len(t))::bigint as l from d where len(t) > 0),
p as (select doc_id, any_value(len(t)) as n, term, count(*) as tf from (select doc_id, t, unnest(t) as term from d) group by doc_id, term),
w as (select term, floor(1000 * ln((2 * (select n from g) + 2)::double / (2 * count(*) + 1)))::bigint as w from p group by term),
q as (
  select item_id, term, count(*) as times from (
    select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from benchmark) group by item_id, term),
s as (
  select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * p.n * (select n from g)) // (select l from g)))))::bigint as score
  from q join p using (term) join w using (term) group by item_id, doc_id),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0)
select item_id, rank::int as rank, doc_id, score from r where rank <= 10
"""
