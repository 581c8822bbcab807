"""N-gram Jaccard join as a blocked sparse product of the document by n-gram matrix with its transpose.

Rows are classes of documents with equal n-gram sets. Its columns are first the leading n-grams that a size bound says a
pair must share, rarest first. Hub rows go before the rest, so that groups of near copies become components without all
of their pairs. Then the rows that are still apart are multiplied: columns whose smallest row is the same make a
column block, its rows are dealt into blocks of bounded size, and a task multiplies two of them. A product's overlap
counts are added up by pair over all column blocks, and pairs whose sizes ask for more are discarded (sketches of the
rows let most of them go where they arise). What is left has its overlap counted over whole rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinewatch.llm.common import Words, mix, rows_of, settle
from kinewatch.llm.components import components

#: Words of an n-gram, and the bound as a fraction.
WORDS, SHARE = 5, (4, 5)
#: Buckets for counting n-grams (a byte each when sent out), bits for filtering classes, parts of a frequent n-gram.
BUCKETS, BITS, PARTS = 1 << 22, 1 << 26, 64
#: Bits of a sketch for each n-gram, at least, and of any sketch.
SKETCH, LEAST = 2, 64
#: Levels are powers of two of a count; from this one on an n-gram is dealt out in parts.
FREQUENT = 10
#: Hub rounds before the rest of the product is formed, and at most; more than HUBS are made while the rest would be larger
#: than REST entries for each entry of the matrix. The links found are the same.
HUBS, ROUNDS, REST = 1, 12, 256
#: Rows of a block, and numbers of a dense piece of one.
BLOCK, PIECE = 256, 1 << 22

DOCUMENT, COUNT = 0, 1


def ngram_sets(column: pa.Array, width: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: first place in the last array, number of distinct n-grams, class (a hash of the set); and all hashes."""
    words = Words(column)
    count = words.word_count
    first = np.cumsum(count) - count
    place = np.arange(len(words.word_doc)) - first[words.word_doc]
    left = count[words.word_doc] - place
    starts = np.flatnonzero((left >= width) | (place == 0))
    last = starts + np.minimum(width, left[starts]) - 1
    grams, owner = words.spans(words.word_start[starts], words.word_stop[last]), words.word_doc[starts]
    pick = np.lexsort((grams, owner))
    grams, owner = grams[pick], owner[pick]
    if len(grams):
        new = np.concatenate([[True], (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])])
        grams, owner = grams[new], owner[new]
    n = np.bincount(owner, minlength=len(count))
    at = np.cumsum(n) - n
    kind = np.zeros(len(count), np.uint64)
    some = n > 0
    if some.any():
        kind[some] = mix(np.add.reduceat(mix(grams), at[some]) + n[some].astype(np.uint64)) >> np.uint64(1)
    return at, n, kind.astype(np.int64), grams


def _bucket(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - (BUCKETS.bit_length() - 1))).astype(np.int64)


def _sketch(grams: np.ndarray) -> bytes:
    """A set as bits: each n-gram turns one over. Of a power of two of bits, so that two halves laid over each other are the smaller sketch."""
    bits = np.zeros(max(LEAST, 1 << (SKETCH * len(grams) - 1).bit_length()), np.uint8)
    np.add.at(bits, (grams & np.uint64(len(bits) - 1)).astype(np.int64), 1)
    return np.packbits(bits & 1).tobytes()


def _apart(left: bytes, right: bytes) -> int:
    """Bits in which two sketches differ: at least so many n-grams are in one of the two sets alone."""
    x, y = np.frombuffer(left, np.uint8), np.frombuffer(right, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def classes(docs: DataFrame, width: int) -> DataFrame:
    """kind DOCUMENT: doc_id, class, n, and sketch (of a class, its first time in a task). kind COUNT: a bucket (as class) and how many n-grams a task has seen in it (n), if it stands out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, had = np.zeros(BUCKETS, np.int32), set()
        for batch in rows_of(batches, "text"):
            at, n, kind, grams = ngram_sets(batch.column("text"), width)
            np.add.at(seen, _bucket(grams), 1)
            sketches: list[bytes | None] = [None] * len(n)
            for i in _unseen(kind, np.flatnonzero(n), had).tolist():
                sketches[i] = _sketch(grams[at[i] : at[i] + n[i]])
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), batch.column("doc_id"), pa.array(kind), pa.array(n), pa.array(sketches, pa.binary())], names=names)
        out = np.flatnonzero(seen >= 8 + 4 * int(seen.mean()))
        if len(out):
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(out), np.int32)), pa.nulls(len(out), pa.int64()), pa.array(out), pa.array(seen[out].astype(np.int64)), pa.nulls(len(out), pa.binary())], names=names)

    names = ["kind", "doc_id", "class", "n", "sketch"]
    return docs.select("doc_id", "text").mapInArrow(run, "kind int, doc_id long, class long, n long, sketch binary")


def _levels(found: DataFrame) -> np.ndarray:
    """How frequent the n-grams of each bucket are, as a power of two: a byte a bucket."""
    rows = found.filter(F.col("kind") == COUNT).groupBy("class").agg(F.floor(F.log2(F.sum("n"))).cast("int").alias("l")).toPandas()  # at most BUCKETS rows
    out = np.zeros(BUCKETS, np.uint8)
    out[rows["class"]] = rows["l"]
    return out


def _unseen(kind: np.ndarray, some: np.ndarray, seen: set) -> np.ndarray:
    """Of `some` documents, those whose class this task hasn't had."""
    out = []
    for i in some.tolist():
        if (k := int(kind[i])) not in seen:
            seen.add(k)
            out.append(i)
    return np.array(out, np.int64)


def leading_columns(docs: DataFrame, levels: np.ndarray, width: int, share: tuple[int, int]) -> DataFrame:
    """gram, class, n, place (from 0): of each class the rarest n-grams, so many that a pair over the bound shares one; those of one class alone are left out.

    With |x| n-grams, a partner shares share * |x| of them at least, so it misses no more than the others, and one of
    |x| - ceil(share * |x|) + 1 is common. The order (level, hash) is the same for all documents.
    """
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in rows_of(batches, "text"):
            at, n, kind, grams = ngram_sets(batch.column("text"), width)
            some = _unseen(kind, np.flatnonzero(n), seen)
            if not len(some):
                continue
            row = np.repeat(some, n[some])
            place = np.arange(len(row)) - np.repeat(np.cumsum(n[some]) - n[some], n[some])
            gram = grams[at[row] + place]
            level = shared.value[_bucket(gram)]
            pick = np.lexsort((gram, level, row))
            gram, level = gram[pick], level[pick]
            lead = (n - -(-n * share[0] // share[1]) + 1)[row]
            keep = place < lead
            gram, row, level, place = gram[keep].astype(np.int64), row[keep], level[keep], place[keep]
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(kind[row]), pa.array(n[row].astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(level >= FREQUENT)], names=["gram", "class", "n", "place", "frequent"])

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of n-gram and class: drops repeats, and n-grams of one class unless their other parts are elsewhere."""
        held, had = None, False  # the last row so far, and whether the row before it has its n-gram
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            g, c = batch.column("gram").to_numpy(), batch.column("class").to_numpy()
            new = np.concatenate([[True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])])
            batch, g = batch.filter(pa.array(new)), g[new]
            same = np.concatenate([[had and held is not None], g[1:] == g[:-1]])
            keep = same | np.concatenate([g[1:] == g[:-1], [False]]) | np.asarray(batch.column("frequent"))
            held, had = batch.slice(len(g) - 1), bool(same[-1])
            keep[-1] = False
            out = batch.filter(pa.array(keep))
            if out.num_rows:
                yield out.select(["gram", "class", "n", "place"])
        if held is not None and (had or held.column("frequent")[0].as_py()):
            yield held.select(["gram", "class", "n", "place"])

    led = docs.select("text").mapInArrow(run, "gram long, class long, n int, place int, frequent boolean")
    part = F.when(F.col("frequent"), F.pmod(F.col("class"), F.lit(PARTS))).otherwise(0)
    return led.withColumn("part", part).repartition("gram", "part").drop("part").sortWithinPartitions("gram", "class").mapInArrow(several, "gram long, class long, n int, place int")


def full_rows(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """class and grams (sorted 64-bit hashes as bytes) of the wanted classes; a filter of BITS bits may let some more pass."""
    spot = F.col("class").bitwiseAND(F.lit(BITS - 1))  # a class is a hash already
    words = wanted.groupBy(F.shiftright(spot, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (spot % 64).cast("int"))).alias("b")).toPandas()  # at most BITS / 64 rows
    bits = np.zeros(BITS // 64, np.int64)
    bits[words["w"]] = words["b"]
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in rows_of(batches, "text"):
            at, n, kind, grams = ngram_sets(batch.column("text"), width)
            spots = kind & (BITS - 1)
            some = np.flatnonzero((n > 0) & ((shared.value[spots >> 6] >> (spots & 63)) & 1).astype(bool))
            some = _unseen(kind, some, seen)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(kind[some]), pa.array([grams[at[i] : at[i] + n[i]].tobytes() for i in some], pa.binary())], names=["class", "grams"])

    return docs.select("text").mapInArrow(run, "class long, grams binary")


def _with_both(pairs: DataFrame, rows: DataFrame, value: str) -> DataFrame:
    """The pairs with a value of a's and of b's row, as left and right."""
    both = pairs.join(rows.select(F.col("class").alias("b"), F.col(value).alias("right")), "b")
    return both.join(rows.select(F.col("class").alias("a"), F.col(value).alias("left")), "a")


def near_pairs(pairs: DataFrame, sketches: DataFrame, share: tuple[int, int]) -> DataFrame:
    """a, b, apart of the pairs (a, b, na, nb) that their sketches (class, sketch) let pass: all over the bound, and few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True)
            apart = np.array([_apart(x, y) for x, y in both], np.int64)
            total = batch.column("na").to_numpy().astype(np.int64) + batch.column("nb").to_numpy()
            need = -(-share[0] * total // sum(share))  # of a pair over the bound so many are common, and no more than the rest are not
            near = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(apart)], names=["a", "b", "apart"])
            yield near.filter(pa.array(apart <= total - 2 * need))

    return _with_both(pairs, sketches, "sketch").select("a", "b", "na", "nb", "left", "right").mapInArrow(run, "a long, b long, apart long")


def overlap(pairs: DataFrame, rows: DataFrame, share: tuple[int, int]) -> DataFrame:
    """a, b of the pairs whose counted overlap, of rows (class, grams), reaches the bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reach = np.zeros(batch.num_rows, bool)
            for i, (left, right) in enumerate(zip(batch.column("left"), batch.column("right"), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), np.int64) for v in (left, right))
                z = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((z[1:] == z[:-1]).sum())
                reach[i] = common * share[1] >= (len(z) - common) * share[0]
            yield batch.select(["a", "b"]).filter(pa.array(reach))

    return _with_both(pairs, rows, "grams").select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def _may_reach(common: Column, share: tuple[int, int]) -> Column:
    """Whether a pair with so many common leading n-grams, at most, can reach the bound: what follows in a row is the most that can be added."""
    p, q = share
    after = lambda n: F.ceil(n * p / q) - 1
    return common + F.greatest(after(F.col("na")), after(F.col("nb"))) >= _need(share)


def _need(share: tuple[int, int]) -> Column:
    return F.ceil(share[0] * (F.col("na") + F.col("nb")) / sum(share))


def _early(share: tuple[int, int]) -> Column:
    """Whether an n-gram stands so early in both rows that a pair over the bound could have it first in common."""
    return (F.col("pa") <= F.col("na") - _need(share)) & (F.col("pb") <= F.col("nb") - _need(share))


def _near_sizes(share: tuple[int, int]) -> Column:
    return F.least("na", "nb") * share[1] >= F.greatest("na", "nb") * share[0]


def _side(df: DataFrame, s: str) -> DataFrame:
    return df.select("gram", F.col("class").alias(s), *[F.col(c).alias(c[0] + s) for c in ("n", "c", "m", "place")])


def _cells(entries: DataFrame, tally: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs of row blocks, a cell (lo, i, j): class, n, c, m, grams and sketch of their rows.

    A column block holds the n-grams whose smallest row is lo. Up to BLOCK rows make one cell, all against all (side 3). More
    rows are dealt into blocks: those outside of the block's main component (side 1) meet all rows (side 2).
    """
    rows = entries.join(tally.select("gram", "lo"), "gram").groupBy("lo", "class").agg(
        F.first("n").alias("n"), F.first("c").alias("c"), F.first("m").alias("m"), F.collect_list("gram").alias("grams"))
    rows = settle(rows.join(sketches, "class"))
    by_group = rows.groupBy("lo", "c").agg(F.count("*").alias("k"))
    large = by_group.groupBy("lo").agg(F.sum("k").alias("k"), F.max(F.struct("k", "c")).alias("top")).filter(F.col("k") > BLOCK)
    parts = lambda k: F.ceil(k / BLOCK).cast("int")
    large = large.select("lo", F.col("top.c").alias("main"), parts(F.col("k")).alias("right"), F.greatest(F.lit(1), parts(F.col("k") - F.col("top.k"))).alias("left"))
    dealt = rows.join(large, "lo", "left")
    spot = lambda of: F.pmod(F.xxhash64("class"), F.col(of)).cast("int")
    cell = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    every = lambda of: F.sequence(F.lit(0), F.col(of) - 1)
    as_right = F.transform(every("left"), lambda i: cell(i, spot("right"), 2))
    as_left = F.transform(every("right"), lambda j: cell(spot("left"), j, 1))
    cells = F.when(F.col("main").isNull(), F.array(cell(F.lit(0), F.lit(0), 3))).when(F.col("c") == F.col("main"), as_right).otherwise(F.concat(as_left, as_right))
    return dealt.withColumn("cell", F.explode(cells)).select("lo", "cell.*", "class", "n", "c", "m", F.coalesce("main", F.lit(-1)).alias("main"), "grams", "sketch")


def _near_sketches(sketches: list[bytes], a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which pairs (a, b) of places differ in at most so many bits; sketches of other length are folded first."""
    near = np.zeros(len(a), bool)
    lengths = np.array([len(x) for x in sketches])
    size = np.minimum(lengths[a], lengths[b])
    for width in np.unique(size).tolist():
        some = np.flatnonzero(size == width)
        sides = []
        for at in (a[some], b[some]):
            used, back = np.unique(at, return_inverse=True)
            folded = [np.bitwise_xor.reduce(np.frombuffer(sketches[i], np.uint8).reshape(-1, width), axis=0) for i in used.tolist()]
            sides.append((np.stack(folded).view(np.uint64), back))
        (x, i), (y, j) = sides
        for at in range(0, len(some), 1 << 14):
            step = slice(at, at + (1 << 14))
            near[some[step]] = np.bitwise_count(x[i[step]] ^ y[j[step]]).sum(axis=1, dtype=np.int64) <= most[some[step]]
    return near


def _multiply(rows: pa.RecordBatch, share: tuple[int, int]) -> tuple[np.ndarray, ...]:
    """Of a cell's pairs that sizes and sketches let pass: a, b (a < b), na, nb, and how many of the cell's n-grams they share."""
    p, q = share
    kind, n, c, m, side, main = (rows.column(x).to_numpy().astype(np.int64) for x in ("class", "n", "c", "m", "side", "main"))
    none = (np.zeros(0, np.int64),) * 5
    left, right = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
    if not len(left) or not len(right) or (c == c[0]).all():
        return none
    lists = rows.column("grams")
    row = np.repeat(np.arange(len(kind)), np.diff(lists.offsets.to_numpy()))
    columns, code = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    common = np.zeros((len(left), len(right)), np.float32)
    wide = max(1, PIECE // len(kind))
    for at in range(0, len(columns), wide):
        first, last = np.searchsorted(code, [at, at + wide])
        piece = np.zeros((len(kind), min(wide, len(columns) - at)), np.float32)
        piece[row[first:last], code[first:last] - at] = 1
        common += piece[left] @ piece[right].T
    a, b = np.nonzero(common)
    count = common[a, b].astype(np.int64)
    x, y = left[a], right[b]
    total = n[x] + n[y]
    need = -(-p * total // (p + q))
    after = -(-np.maximum(n[x], n[y]) * p // q) - 1
    open_ = (c[x] != c[y]) & ((kind[x] < kind[y]) | (c[y] == main[y])) & (np.minimum(m[x], m[y]) + after >= need)
    open_ &= np.minimum(n[x], n[y]) * q >= np.maximum(n[x], n[y]) * p
    x, y, count, most = x[open_], y[open_], count[open_], (total - 2 * need)[open_]
    if len(x):
        near = _near_sketches(rows.column("sketch").to_pylist(), x, y, most)
        x, y, count = x[near], y[near], count[near]
    turned = kind[x] > kind[y]
    x, y = np.where(turned, y, x), np.where(turned, x, y)
    return kind[x], kind[y], n[x], n[y], count


def product(entries: DataFrame, tally: DataFrame, sketches: DataFrame, share: tuple[int, int]) -> DataFrame:
    """a, b of the rows in different components (c) whose overlap in leading n-grams, added up over all column blocks, can reach the bound."""
    names = ["a", "b", "na", "nb", "common"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of the last cell so far
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            keys = [batch.column(x).to_numpy() for x in ("lo", "i", "j")]
            starts = np.concatenate([[0], np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1])
            made = [_multiply(batch.slice(at, stop - at), share) for at, stop in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            held = batch.slice(int(starts[-1]))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*made, strict=True)], names=names)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _multiply(held, share)], names=names)

    cell = ["lo", "i", "j"]
    cells = _cells(entries, tally, sketches).repartition(*cell).sortWithinPartitions(*cell)
    counts = cells.mapInArrow(run, "a long, b long, na long, nb long, common long").groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
    return counts.filter(_may_reach(F.col("common"), share)).select("a", "b")


PAIR, TURNED = ["a", "b", "na", "nb"], ["b", "a", "nb", "na"]


def _in_order(pairs: DataFrame) -> DataFrame:
    """Each pair with the smaller class first."""
    return pairs.select(*[F.when(F.col("a") > F.col("b"), F.col(y)).otherwise(F.col(x)).alias(x) for x, y in zip(PAIR, TURNED, strict=True)])


def class_components(docs: DataFrame, found: DataFrame, width: int, share: tuple[int, int]) -> DataFrame:
    """vertex and component of the classes that are linked with others."""
    entries = settle(leading_columns(docs, _levels(found), width, share))
    size = entries.count()
    sketched = found.filter(F.col("sketch").isNotNull()).select("class", "sketch").join(entries.select("class").distinct(), "class", "left_semi")
    sketches = settle(sketched.dropDuplicates(["class"]))
    links, groups = None, None
    for turn in range(ROUNDS + 1):
        named = entries if groups is None else entries.join(groups.withColumnRenamed("vertex", "class"), "class", "left")
        named = named.withColumn("c", F.col("class") if groups is None else F.coalesce("component", "class")).select("gram", "class", "n", "place", "c")
        mixed = named.groupBy("gram").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter(F.col("lo") < F.col("hi")).select("gram")
        open_ = named.join(mixed, "gram", "left_semi")
        # m: how many leading n-grams a row has in common with anyone else, the most that a pair can count
        open_ = settle(open_.join(open_.groupBy("class").agg(F.count("*").alias("m")), "class"))
        by_group = open_.groupBy("gram", "c").agg(F.count("*").alias("k"), F.min("class").alias("lo"))
        tally = by_group.groupBy("gram").agg(F.sum("k").alias("k"), F.max(F.struct("k", "c")).alias("top"), F.min("lo").alias("lo"))
        tally = settle(tally.select("gram", "lo", F.col("k").alias("all"), F.col("top.c").alias("main"), (F.col("k") - F.col("top.k")).alias("others")))
        rest = tally.agg(F.sum(F.col("all") * F.col("others"))).first()[0] or 0
        if not rest:
            break
        last = turn >= HUBS and (turn == ROUNDS or rest <= REST * size)
        if last:  # all that differ in component
            pairs = product(open_, tally, sketches, share)
        else:  # hubs of each n-gram: its smallest row, a random one, and a random one outside of its main component
            fits = (F.col("ca") != F.col("cb")) & _near_sizes(share) & _early(share) & _may_reach(F.least("ma", "mb"), share)
            row = F.struct("class", "n", "c", "m", "place")
            luck = lambda k: F.xxhash64("class", "gram", F.lit(2 * turn + k))  # noqa: E731, B023
            hubs = open_.join(tally, "gram").groupBy("gram").agg(F.array(
                F.min_by(row, F.struct("n", luck(0))), F.min_by(row, luck(0)), F.min_by(row, F.when(F.col("c") != F.col("main"), luck(1)))).alias("hubs"))
            hubs = _side(hubs.select("gram", F.explode(F.array_distinct("hubs")).alias("hub")).filter(F.col("hub").isNotNull()).select("gram", "hub.*"), "a")
            pairs = hubs.join(_side(open_, "b"), "gram").filter(fits)
            pairs = near_pairs(_in_order(pairs).distinct(), sketches, share)
            # of a row's pairs the two that seem nearest; what they leave apart, the product joins
            both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "apart"))
            ranked = both.withColumn("r", F.row_number().over(W.partitionBy("a").orderBy("apart", "b"))).filter(F.col("r") <= 2)
            pairs = ranked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = settle(pairs.select("a", "b"))
        rows = full_rows(docs, pairs.select(F.explode(F.array("a", "b")).alias("class")), width)
        new = settle(overlap(pairs, settle(rows), share))
        links = new if links is None else links.unionByName(new)
        groups = settle(components(links))
        if last:
            break
    return groups if groups is not None else entries.sparkSession.createDataFrame([], "vertex long, component long")


def join_documents(docs: DataFrame, width: int = WORDS, share: tuple[int, int] = SHARE) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs.

    Texts without words (null, empty): no n-gram, no link, a component of their own. Fewer than `width` words: the whole
    sequence is the one n-gram. Equal sets link. Repeated rows are rows of their own and link. Null doc_id: takes part,
    never names a component (null if no other does). Empty table: empty. Other columns aren't read.
    """
    found = settle(classes(docs, width))
    groups = class_components(docs, found, width, share)
    rows = found.filter(F.col("kind") == DOCUMENT).select("doc_id", "class", "n")
    some = rows.filter(F.col("n") > 0).join(groups.withColumnRenamed("vertex", "class"), "class", "left").select("doc_id", "n", F.coalesce("component", "class").alias("c"))
    some = settle(some)
    least = some.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    out = some.join(least, "c").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(rows.filter(F.col("n") == 0).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
