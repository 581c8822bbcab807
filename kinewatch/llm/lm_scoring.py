"""LM scoring: prediction by partial matching over a trie of byte contexts, with escapes and symbol exclusion."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinewatch.llm.common import Words, remainder_of_id, rows_of, settle

#: Bytes of context; entries that tasks look up in memory (the rest are joined), 12 bytes in each of four slots an entry.
ORDER, IN_MEMORY = 5, 1 << 19
GRAM, WORD = 0, 1
#: The end of a document, as a word.
END = 0
ALL = (1 << 63) - 1


def _events(words: Words, order: int) -> np.ndarray:
    """For each byte, it and the `order` bytes before it in one number; before a document stand line feeds."""
    data = words.bytes
    key = data.astype(np.uint64)
    place = np.arange(len(data)) - np.repeat(words.starts, words.stops - words.starts)
    for back in range(1, order + 1):
        earlier = np.full(len(data), 10, np.uint64)
        earlier[back:] = data[:-back] if back < len(data) else data[:0]
        earlier[place < back] = 10
        key |= earlier << np.uint64(8 * back)
    return key.astype(np.int64)


def _tokens(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each word (62 bits, never END)."""
    return (words.spans(words.word_start, words.word_stop) >> np.uint64(2)).astype(np.int64) + 1, words.word_doc


def _merge(kept: tuple[np.ndarray, np.ndarray] | None, key: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(np.concatenate([kept[0], key]) if kept else key, return_inverse=True)
    n = np.ones(len(key), np.int64) if n is None else n
    return keys, np.bincount(place, np.concatenate([kept[1], n]) if kept else n, len(keys)).astype(np.int64)


def count_events(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """kind, key and n of all byte events and words of the texts; tasks sum up as they go and hold a bounded part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {GRAM: [None, []], WORD: [None, []]}

        def fold(kind: int) -> tuple[np.ndarray, np.ndarray]:
            total, parts = held[kind]
            key = np.concatenate([k for k, _ in parts])
            held[kind] = [_merge(total, key, np.concatenate([n for _, n in parts])), []]
            return held[kind][0]

        def out(kind: int) -> pa.RecordBatch:
            key, n = fold(kind) if held[kind][1] else held[kind][0]
            held[kind] = [None, []]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(n)], names=["kind", "key", "n"])

        for batch in rows_of(batches, "text"):
            words = Words(batch.column("text"))
            held[GRAM][1].append(_merge(None, _events(words, order)))
            tokens = _tokens(words)[0]
            held[WORD][1].append(_merge(None, np.concatenate([tokens, np.full(batch.num_rows, END)])))
            for kind, (total, parts) in held.items():
                if len(parts) >= 8 and len(fold(kind)[0]) > 4_000_000:
                    yield out(kind)
        for kind, (total, parts) in held.items():
            if parts or total:
                yield out(kind)

    return docs.select("text").mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def trie(grams: DataFrame, order: int) -> list[DataFrame]:
    """Level k: key (k bytes of context and a symbol) and n, for k from `order` down to 0.

    Below the longest, n counts the longer contexts that have seen the symbol: what they predict isn't learned again.
    """
    levels = [grams.select("key", "n")]
    for k in range(order - 1, -1, -1):
        levels.append(settle(levels[-1].withColumn("key", F.col("key").bitwiseAND(F.lit((1 << (8 * (k + 1))) - 1))).groupBy("key").agg(F.count("*").alias("n"))))
    return levels


def _context(key: Column) -> Column:
    return F.shiftright(key, 8)


def seen_costs(level: DataFrame) -> DataFrame:
    """log10 probability of what the longest context has seen: (n - 1/2) of all of the context (at most 256 rows each)."""
    total = level.groupBy(_context(F.col("key")).alias("context")).agg(F.sum("n").alias("total"))
    return level.withColumn("context", _context(F.col("key"))).join(total, "context").select("key", F.log10((F.col("n") - 0.5) / F.col("total")).alias("value"))


def unseen_costs(keys: DataFrame, levels: list[DataFrame], order: int) -> DataFrame:
    """log10 probability of events that the longest context hasn't seen.

    From a context to the next shorter one, an escape costs half the number of its symbols; the symbols that the longer
    context has seen are left out of the shorter one's sums. After the empty context, all bytes never seen are alike.
    """
    waiting = keys.select("key").withColumns({"cost": F.lit(0.0), "above": F.lit(None).cast("long")})  # above: the longer context, if known
    done = None
    for k in range(order, -1, -1):
        level = levels[order - k]
        own = level.groupBy(_context(F.col("key")).alias("context")).agg(F.sum("n").alias("t"), F.count("*").alias("d"))
        here = waiting.withColumn("short", F.col("key").bitwiseAND(F.lit((1 << (8 * (k + 1))) - 1))).withColumn("context", _context(F.col("short")))
        here = here.join(own, "context", "left").join(level.withColumnRenamed("key", "short"), "short", "left")
        if k < order:
            above = levels[order - k - 1]
            left_out = above.select(_context(F.col("key")).alias("above"), F.col("key").bitwiseAND(F.lit((1 << (8 * (k + 1))) - 1)).alias("short"))
            # only the contexts that someone waits under
            left_out = left_out.join(waiting.select("above").distinct(), "above", "left_semi").join(level.withColumnRenamed("key", "short"), "short")
            left_out = left_out.groupBy("above").agg(F.sum("n").alias("less_t"), F.count("*").alias("less_d"))
            here = here.join(left_out, "above", "left")
            t, d = F.col("t") - F.coalesce("less_t", F.lit(0)), F.col("d") - F.coalesce("less_d", F.lit(0))
        else:
            t, d = F.col("t"), F.col("d")
        here = here.withColumns({"t": t, "d": d})
        hit, escape = F.log10((F.col("n") - 0.5) / F.col("t")), F.when(F.col("d") > 0, F.log10(F.lit(0.5) * F.col("d") / F.col("t"))).otherwise(0.0)
        known = F.when(F.col("d").isNotNull(), F.col("context"))
        # one written table a level: what was found and what waits on are read from it, so that no plan holds all levels
        here = settle(here.select("key", F.col("n").isNotNull().alias("found"), (F.col("cost") + F.coalesce(hit, escape)).alias("cost"), known.alias("above")))
        found, waiting = here.filter("found").select("key", F.col("cost").alias("value")), here.filter("not found").select("key", "cost", "above")
        done = found if done is None else done.unionByName(found)
    seen = levels[order].count()  # at most 256
    rest = waiting.select("key", (F.col("cost") - F.log10(F.lit(float(max(1, 256 - seen))))).alias("value"))
    return done.unionByName(rest)


def _frequent(counts: DataFrame, kind: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The entries with the most events, at most `limit`: all of a size class or none."""
    size = F.floor(F.log2("n") * 8).cast("int")
    classes = sorted(((r[0], r[1]) for r in counts.filter(F.col("kind") == kind).groupBy(size).count().collect()), reverse=True)
    total, least = 0, None
    for c, n in classes:
        if (total := total + n) > limit:
            break
        least = c
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0)
    got = counts.filter((F.col("kind") == kind) & (size >= least)).select("key", "value").toArrow()
    return got["key"].to_numpy(), got["value"].to_numpy()


class Lookup:
    """Open addressing over numpy arrays; 2**bits slots hold at most a quarter of that."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        self.bits = max(8, int(4 * max(1, len(key)) - 1).bit_length())
        self.key, self.value = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits)
        open_, slot = np.arange(len(key)), self._slot(key)
        while len(open_):
            free = self.key[slot] == -1
            _, first = np.unique(slot[free], return_index=True)
            took = np.flatnonzero(free)[first]
            self.key[slot[took]], self.value[slot[took]] = key[open_[took]], value[open_[took]]
            left = np.ones(len(open_), bool)
            left[took] = False
            open_, slot = open_[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Value of each key (0 if none), and which have none."""
        slot = self._slot(key)
        there = self.key[slot]
        value, missing = self.value[slot], there != key
        value[missing] = 0.0
        look = np.flatnonzero(missing & (there != -1))
        at = slot[look]
        while len(look):
            at = (at + 1) & ((1 << self.bits) - 1)
            there = self.key[at]
            hit = there == key[look]
            value[look[hit]], missing[look[hit]] = self.value[at[hit]], False
            on = ~hit & (there != -1)
            look, at = look[on], at[on]
        return value, missing


_tables: dict[str, dict[int, Lookup]] = {}


def score_documents(docs: DataFrame, counts: DataFrame, levels: list[DataFrame], n: int, v: int, order: int = ORDER, in_memory: int = IN_MEMORY) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of each row of docs.

    counts: kind, key, n and value of what was learned. Frequent entries are looked up in the task that reads the text;
    the others are summed by document and joined, so no model must fit a machine.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast({kind: _frequent(counts, kind, in_memory) for kind in (GRAM, WORD)})
    floor = float(np.log10(0.5 / (n + 0.5 * (v + 1))))
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _tables:
            _tables.clear()
            _tables[name] = {kind: Lookup(*arrays) for kind, arrays in shared.value.items()}
        tables, row = _tables[name], TaskContext.get().partitionId() << 40
        for batch in rows_of(batches, "text"):
            rows = batch.num_rows
            words = Words(batch.column("text"))
            doc = np.repeat(np.arange(rows), words.stops - words.starts)
            events = _events(words, order)
            value, missing = tables[GRAM].get(events)
            score = np.bincount(doc, value, rows)
            tokens, owner = _tokens(words)
            tokens, owner = np.concatenate([tokens, np.full(rows, END)]), np.concatenate([owner, np.arange(rows)])
            base, unknown = tables[WORD].get(tokens)
            n_tokens, n_known = np.bincount(owner, minlength=rows), np.bincount(owner, ~unknown, rows).astype(np.int64)
            base_score = np.bincount(owner, np.where(unknown, floor, base), rows)
            ids = row + np.arange(rows)
            row += rows
            none = pa.nulls(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, -1, np.int32)), pa.array(ids), batch.column("doc_id"), none, none, pa.array(n_tokens), pa.array(n_known), pa.array(base_score), pa.array(score)], names=columns)
            for kind, key, who in ((GRAM, events[missing], doc[missing]), (WORD, tokens[unknown], owner[unknown])):
                if len(key):
                    pick = np.lexsort((key, who))
                    key, who = key[pick], who[pick]
                    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (who[1:] != who[:-1])]))
                    times = np.diff(np.append(first, len(key)))
                    m = len(first)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int32)), pa.array(ids[who[first]]), pa.nulls(m, pa.int64()), pa.array(key[first]), pa.array(times.astype(np.int64)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64())], names=columns)

    columns = ["kind", "row", "doc_id", "key", "times", "n_tokens", "n_known", "base_score", "score"]
    both = settle(docs.select("doc_id", "text").mapInArrow(run, "kind int, row long, doc_id long, key long, times long, n_tokens long, n_known long, base_score double, score double"))
    shared.destroy()  # `both` is written: nothing reads the tables again
    rare = both.filter(F.col("kind") >= 0).select("kind", "row", "key", "times")
    learned = counts.select("kind", "key", "value")
    met = settle(rare.join(learned, ["kind", "key"], "left"))
    new = settle(met.filter((F.col("kind") == GRAM) & F.col("value").isNull()).select("key").distinct())
    costs = unseen_costs(new, levels, order)
    known = met.filter(F.col("value").isNotNull() | (F.col("kind") == WORD))
    fresh = met.filter((F.col("kind") == GRAM) & F.col("value").isNull()).drop("value").join(costs, "key")
    gram, word = F.col("kind") == GRAM, (F.col("kind") == WORD) & F.col("value").isNotNull()
    more = known.unionByName(fresh).groupBy("row").agg(
        F.sum(F.when(gram, F.col("times") * F.col("value"))).alias("more_score"), F.sum(F.when(word, F.col("times") * (F.col("value") - floor))).alias("more_base"), F.sum(F.when(word, F.col("times"))).alias("more_known"))
    out = both.filter(F.col("kind") < 0).join(more, "row", "left")
    add = lambda name, more: (F.col(name) + F.coalesce(more, F.lit(0))).alias(name)
    return out.select("doc_id", "n_tokens", add("n_known", "more_known"), add("base_score", "more_base"), add("score", "more_score"))


def held_out(doc_id: Column) -> Column:
    """A null doc_id is learned from."""
    return F.coalesce(remainder_of_id(doc_id, 5) == 1, F.lit(False))


def score_corpus(docs: DataFrame, order: int = ORDER, in_memory: int = IN_MEMORY) -> DataFrame:
    """Learns from the rows of docs that aren't held out and scores all rows.

    The text that is modelled is its tokens: words in lower case (A-Z) with one space between them, then a line feed as
    the end. Null or empty text: the end alone. Repeated rows count and are scored each. Nothing to learn from: all bytes
    are alike. Empty table: empty result. Other columns aren't read.
    """
    learn = docs.filter(~held_out(F.col("doc_id")))
    counts = settle(count_events(learn, order))
    words = counts.filter(F.col("kind") == WORD)
    v, n = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    levels = trie(counts.filter(F.col("kind") == GRAM), order)
    base = words.withColumn("value", F.log10((F.col("n") + 0.5) / F.lit(n + 0.5 * (v + 1)))).select("kind", "key", "n", "value")
    seen = levels[0].join(seen_costs(levels[0]), "key").select(F.lit(GRAM).alias("kind"), "key", "n", "value")
    scored = score_documents(docs, settle(base.unionByName(seen)), levels, n, v, order, in_memory)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
