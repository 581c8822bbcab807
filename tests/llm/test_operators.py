"""The numbered operators on odd rows and against plain versions."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinewatch.llm import embedding_dedup, html_extraction, language_id, line_dedup, lm_scoring, mixing, ngram_join, packing, queries, top_k, url_rules
from kinewatch.llm.common import table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta gamma delta " * 4000
ODD = [(1, None, "en", "a", None), (2, "", "en", None, 0), (3, "One two three four five six", None, "a", 1), (4, "one TWO\x0bthree  four five six", "en", "b", 1),
       (4, "one TWO\x0bthree  four five six", "en", "b", 1), (None, "no id but words enough to count here", "de", "b", 1), (6, LONG, "en", "a", 1),
       (7, "123 ... !", "en", "a", 1), (8, "same line of text\n\nsame line of text", "fr", "b", 1), (9, "Same line of text \nother", "fr", None, 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumns({c: F.lit(1) for c in ("size", "key", "pos", "lines", "row", "class", "kind", "score")})


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def test_lines(spark, odd):
    got = sorted((r["doc_id"] or 0, r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in line_dedup.digest(line_dedup.drop_repeated_lines(odd)).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert [x[:3] for x in got if x[0] in (1, 2, 8, 9)] == [(1, 1, 0), (2, 1, 0), (8, 3, 0), (9, 2, 1)]
    assert (9, 2, 1, sha("other")) in got and got.count((4, 1, 0, sha(ODD[3][1]))) == 2
    assert line_dedup.drop_repeated_lines(odd.limit(0)).count() == 0
    assert line_dedup.drop_repeated_lines(odd).columns[: len(odd.columns)] == odd.columns


def test_lines_by_count_of_documents(spark):
    df = spark.createDataFrame([(i, "a line of three\nmine %d only here" % i) for i in range(3)], "doc_id long, text string")
    assert [r["n_dropped"] for r in line_dedup.drop_repeated_lines(df, min_docs=3).orderBy("doc_id").collect()] == [0, 1, 1]
    assert {r["n_dropped"] for r in line_dedup.drop_repeated_lines(df, min_docs=4).collect()} == {0}


def test_url_rules(spark):
    urls = [None, "", "no scheme/es/", "http://EXAMPLE.org/es/1", "https://a.example.org/en/17?x=/de/", "http://x.com/de/#a", "http://com/fr/", "http://xexample.org/es/",
            "http://example.org", "http://example.org?a/es/", "http://example.org:80/es/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"rule": F.lit(1), "token": F.lit(2)})
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge(df).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("example.org", "/es/1", "example.org/es/", "block") and got[4] == ("a.example.org", "/en/17", "example.org/en/1", "block")
    assert got[5][2:] == ("com/de/", "block") and got[6][2:] == ("com/fr/", "allow") and got[7][2:] == ("org/", "allow")
    assert got[8] == ("example.org", "", None, "allow") and got[9][1:] == ("", None, "allow") and got[10] == ("example.org:80", "/es/", None, "allow")
    bare = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_rules.judge(df, rules=[("block", "/e"), ("allow", "org/es/1")]).collect()}
    assert bare[3] == ("org/es/1", "allow") and bare[4] == bare[7] == bare[10] == ("/e", "block") and bare[5] == bare[2] == bare[9] == (None, "allow")
    assert url_rules.judge(df, rules=[]).filter("verdict = 'allow' and rule is null").count() == len(urls)
    assert url_rules.judge(df.limit(0)).count() == 0


def fill(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight, target, full = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}, {}, set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        level = left / (sum(weight[s] for s in order if s not in full) or 1)
        target = {s: 3 * sizes[s] if s in full else level * weight[s] for s in order}
        more = {s for s in order if s not in full and target[s] >= 3 * sizes[s]}
        if not more:
            return target
        full |= more


def mixed_right(rows, source_of):
    sizes, taken, top = collections.Counter(), collections.Counter(), collections.Counter()
    for r in rows:
        s = source_of[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        top[s] = max(top[s], r["size"])
        assert 0 <= r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
    target = fill(sizes)
    for r in rows:
        s = source_of[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= top[s] + 1e-6


def test_mixing(spark, odd, docs, monkeypatch):
    for leaf, fan in ((4096, 256), (3, 2)):
        monkeypatch.setattr(mixing, "LEAF", leaf)
        monkeypatch.setattr(mixing, "FAN", fan)
        first = mixing.digest(mixing.mix_sources(docs)).collect()
        assert sorted(first) == sorted(mixing.digest(mixing.mix_sources(docs.repartition(5))).collect())
        mixed_right(first, {r["doc_id"]: r["source"] for r in docs.collect()})
    mixed = mixing.mix_sources(odd)
    mixed_right(mixing.digest(mixed).collect(), {r[0]: r[3] for r in ODD})
    again = mixing.repeat_documents(odd, mixed)
    assert again.count() == mixed.agg(F.sum("copies")).first()[0] and again.columns == odd.columns
    assert mixing.mix_sources(odd.limit(0)).count() == 0
    assert mixing.mix_sources(odd.filter("doc_id < 3")).agg(F.sum("copies")).first()[0] == 0


def test_mixing_of_one_text_in_two_sources(spark):
    """Rows with equal doc_id and text but other sources are documents of their own, and so stay apart in the repetition."""
    text = "some words of a text"
    rows = [(1, text, "en", s, 20) for s in ("a", "b", "c", None)] + [(i, f"{text} {i}", "en", "abc"[i % 3], 22) for i in range(2, 40)] + [(None, None, "en", "a", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    mixed = mixing.mix_sources(docs).cache()
    assert mixed.count() == len(rows)
    copies = {r["source"]: r["copies"] for r in mixed.filter("doc_id = 1").collect()}
    taken = collections.Counter(r["source"] for r in mixing.repeat_documents(docs, mixed).filter("doc_id = 1").collect())
    assert len(copies) == 4 and taken == collections.Counter({s: n for s, n in copies.items() if n})
    assert len(mixed.filter("doc_id = 1").select("mark").distinct().collect()) == 4


def packed_right(rows, texts, capacity=packing.CAPACITY):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.tokenizer_file())
    want = collections.Counter()
    for doc, text in texts:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, packing.END_ID]
        cuts = [0, *range(len(ids) - (-(-len(ids) // capacity) - 1) * capacity, len(ids) + 1, capacity)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[doc, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), sum(r["length"] for r in rows) / capacity


def test_packing(spark, odd, docs):
    n, least = packed_right(packing.pack(docs, queries.tokenizer_file(), with_ids=False).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert n <= 1.06 * least + 1
    special = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(20, "a<|endoftext|>b" + " " * 3000 + "x")], "doc_id long, text string"))
    packed_right(packing.pack(special, queries.tokenizer_file()).collect(), [(r[0], r[1]) for r in ODD] + [(20, "a<|endoftext|>b" + " " * 3000 + "x")])
    assert packing.pack(odd.limit(0), queries.tokenizer_file()).count() == 0


def test_packing_of_one_length_and_full_pieces(spark, monkeypatch):
    """Rows that are equal in all they hold, many of one length and many that fill a sequence, are numbered in parts."""
    monkeypatch.setattr(packing, "NUMBERED", 16)
    texts = ["a b c"] * 300 + ["one two three " * 900] * 20 + [None] * 40
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(3)
    rows = packing.pack(docs, queries.tokenizer_file()).collect()
    n, least = packed_right(rows, [(None, t) for t in texts])
    assert sum(r["length"] == packing.CAPACITY for r in rows) >= 40 and n <= 1.1 * least + 2
    whole = packing.assign(spark.createDataFrame([(7, 4), (9, 4)], "row long, length long"), 4).collect()
    assert len({r["sequence_id"] for r in whole}) == 2 and all(r["offset"] == 0 for r in whole)


def test_packing_carries_ids(spark, docs, monkeypatch):
    """The pipeline's last stage gives the tokens of each piece, and op2's digests are taken from them."""
    rows = corpus_pipeline.pack(spark, docs, SF).collect()
    packed_right(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert all(len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)
    asked, pack = [], packing.pack
    monkeypatch.setattr(packing, "pack", lambda *a, **b: asked.append(b.get("with_ids", True)) or pack(*a, **b))
    df = queries.op2_best_fit_packing(spark, SF)
    assert asked == [True] and df.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert collections.Counter(df.select(kept).collect()) == collections.Counter(tuple(r[c] for c in kept) for r in rows)


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan(seed):
    rng = np.random.default_rng(seed)
    lengths = collections.Counter(rng.integers(1, 1025, 3000).tolist() if seed % 2 else (rng.integers(1, 200, 2000) ** 1).tolist())
    n, places = packing.best_plan(dict(lengths))
    used, ranks = collections.Counter(), collections.Counter()
    for length, first, count, sequence, offset in places:
        assert first == ranks[length] and offset + length <= 1024
        ranks[length] += count
        for i in range(count):
            used[sequence + i] += length
    assert ranks == lengths and max(used.values()) <= 1024 and len(used) == n
    assert n <= 1.02 * math.ceil(sum(k * v for k, v in lengths.items()) / 1024) + 1


def plain_components(ids, linked):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in linked:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {i: root(i) for i in ids}


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 8))
    near = base[rng.integers(0, 40, 160)] + rng.normal(size=(160, 8)) * rng.choice([0.05, 0.25], (160, 1))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(np.concatenate([base, near, base[:5], base[:5] * 2]))]
    bad = [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0] * 7), (904, [None] * 8), (905, [])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumns({"dim": F.lit(1), "blob": F.lit(2), "label": F.lit(0)})
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = np.argwhere(np.triu(x @ x.T >= 0.9, 1))
    count, comp = collections.Counter(links.ravel().tolist()), plain_components(range(len(rows)), links.tolist())
    for pivots, block in ((16, 4096), (5, 7), (1, 50)):
        got = {r["vec_id"]: r for r in embedding_dedup.link_vectors(df, pivots=pivots, block=block).collect()}
        assert len(got) == len(rows) + len(bad)
        for i in range(len(rows)):
            assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (count[i], comp[i], comp[i] == i)
        assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i, _ in bad)
    assert embedding_dedup.link_vectors(df.limit(0)).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(np.round(rng.normal(size=(330, 6)), 1).astype(np.float32))] + [(7, [1.0] * 6), (1000, None), (1100, [float("inf")] * 6), (1200, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"mark": F.lit(1), "dim": F.lit(2)})
    whole = [(i, np.floor(1024 * np.array(v, float)).astype(np.int64)) for i, v in rows if v is not None and np.isfinite(v).all()]
    want = set()
    for q, w in whole:
        if q % 100 == 0:
            best = sorted(((-int(w @ v), i) for i, v in whole if i != q and len(v) == len(w)))[:10]
            want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    for block, asks in ((4096, 1024), (13, 2), (331, 1)):
        assert {tuple(r) for r in top_k.search(df, block=block, queries=asks).collect()} == want
    assert top_k.search(df.limit(0)).count() == 0


def sets(text, width=5):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def joined_right(rows, texts):
    own = [(d, sets(t)) for d, t in texts]
    links = [(i, j) for i in range(len(own)) for j in range(i) if own[i][1] and own[j][1] and 100 * len(own[i][1] & own[j][1]) >= 80 * len(own[i][1] | own[j][1])]
    root = plain_components(range(len(own)), links)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(own):
        least[root[i]].append(d)
    want = collections.Counter((d, len(s), min((x for x in least[root[i]] if x is not None), default=None)) for i, (d, s) in enumerate(own))
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows) == want


def edited(rng, text, k):
    w = text.split()
    for i in rng.integers(0, len(w), k):
        w[i] = f"w{rng.integers(0, 50)}"
    return " ".join(w)


@pytest.mark.parametrize("seed", range(40))
def test_sketches_never_exceed_the_difference(seed):
    rng = np.random.default_rng(seed)
    n, m = (int(rng.integers(1, 1 << k)) for k in (seed % 12 + 1, (seed + seed // 20) % 12 + 1))
    pool = rng.integers(0, 1 << 63, n + m, np.uint64)
    a, b = set(pool[:n].tolist()), set(pool[int(rng.integers(0, n + 1)) :][:m].tolist())
    sketch = lambda x: ngram_join._sketch(np.array(sorted(x), np.uint64))
    apart = ngram_join._apart(sketch(a), sketch(b))
    assert apart == ngram_join._apart(sketch(b), sketch(a)) <= len(a ^ b)
    assert (apart - len(a ^ b)) % 2 == 0 and (apart > 0 or a == b or len(a ^ b) > 1)


@pytest.mark.parametrize("seed", range(4))
def test_a_cell_counts_as_sets_do(seed):
    rng = np.random.default_rng(seed)
    pool = rng.integers(1, 1 << 62, 60)
    drawn = [sorted(set(pool[:50].tolist()) ^ set(rng.choice(pool, int(rng.integers(0, 9))).tolist())) for _ in range(30)]
    kind, group = rng.permutation(30), rng.integers(0, 6, 30)
    side, main = (np.full(30, 3), -1) if seed % 2 else (np.where(group == 2, 2, rng.integers(1, 4, 30)), 2)
    cell = pa.RecordBatch.from_pydict({"class": kind, "n": [len(x) for x in drawn], "c": group, "m": [len(x) for x in drawn], "side": side, "main": np.full(30, main),
                                       "grams": pa.array(drawn, pa.list_(pa.int64())), "sketch": [ngram_join._sketch(np.array(x, np.uint64)) for x in drawn]})
    a, b, na, nb, common = ngram_join._multiply(cell, (4, 5))
    got = collections.Counter(zip(a.tolist(), b.tolist(), common.tolist(), strict=True))
    at = {int(k): i for i, k in enumerate(kind)}
    assert all(x < y and len(set(drawn[at[x]]) & set(drawn[at[y]])) == n for x, y, n in got) and set(got.values()) <= {1}
    want = {(min(kind[i], kind[j]), max(kind[i], kind[j])) for i in range(30) for j in range(30) if side[i] & 1 and side[j] & 2 and group[i] != group[j]
            and (group[j] == main or kind[i] < kind[j]) and 5 * len(set(drawn[i]) & set(drawn[j])) >= 4 * len(set(drawn[i]) | set(drawn[j]))}
    assert want <= {(x, y) for x, y, _ in got} and want


def test_ngram_join(spark, odd, monkeypatch):
    joined_right(ngram_join.join_documents(odd).collect(), [(r[0], r[1]) for r in ODD])
    rng = np.random.default_rng(5)
    bases = [" ".join(f"v{x}" for x in rng.integers(0, 300, n)) for n in (5, 9, 40, 120, 200)]
    passage = bases[3]
    texts = [edited(rng, bases[b], k) for b in range(5) for k in rng.integers(0, 7, 25)] + [passage + " " + " ".join(f"u{x}" for x in rng.integers(0, 999, n)) for n in rng.integers(0, 60, 40)] + bases * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for frequent, hubs, rest, block in ((10, 2, 256, 256), (1, 0, 10**9, 4), (1, 3, 0, 1), (10, 1, 10**9, 8)):
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
        monkeypatch.setattr(ngram_join, "HUBS", hubs)
        monkeypatch.setattr(ngram_join, "REST", rest)
        joined_right(ngram_join.join_documents(df.repartition(3)).collect(), list(enumerate(texts)))
    assert ngram_join.join_documents(odd.limit(0)).count() == 0


def plain_ppm(rows, order):
    """Counts by context; below the longest, of contexts one byte longer."""
    seqs = [(d, " ".join(words(t)).encode() + b"\n") for d, t in rows]
    counts = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    for d, s in seqs:
        if d is None or zlib.crc32(str(d).encode()) % 5 != 1:
            p = b"\n" * order + s
            for j in range(order, len(p)):
                counts[order][p[j - order : j]][p[j]] += 1
    for k in range(order - 1, -1, -1):
        for context, c in counts[k + 1].items():
            for symbol in c:
                counts[k][context[1:]][symbol] += 1
    out = []
    for d, s in seqs:
        p, total = b"\n" * order + s, 0.0
        for j in range(order, len(p)):
            out_of = set()
            for k in range(order, -1, -1):
                c = {x: n for x, n in counts[k].get(p[j - k : j], {}).items() if x not in out_of}
                t = sum(c.values())
                if p[j] in c:
                    total += math.log10((c[p[j]] - 0.5) / t)
                    break
                total += math.log10(0.5 * len(c) / t) if c else 0.0
                out_of |= set(counts[k].get(p[j - k : j], {}))
            else:
                total -= math.log10(256 - len(out_of))
        out.append((d, total))
    return out


def test_scores(spark, odd, docs):
    for df, rows, kept in ((odd, [(r[0], r[1]) for r in ODD if r[0] != 6], 1 << 19), (docs, None, 300)):
        df = df.filter("doc_id is null or doc_id != 6") if rows else df.filter("length(text) < 900")
        rows = rows or [(r["doc_id"], r["text"]) for r in df.collect()]
        got = lm_scoring.score_corpus(df, in_memory=kept).collect()
        counts = collections.Counter(x for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 5 != 1 for x in [*words(t), None])
        n, v = sum(counts.values()), len(counts)
        want = sorted(((d or 0, len(words(t)) + 1, sum(counts[x] > 0 for x in [*words(t), None]), n, sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in [*words(t), None]), s)
                       for (d, t), (_, s) in zip(rows, plain_ppm(rows, lm_scoring.ORDER), strict=True)))
        have = sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got)
        assert [x[:4] for x in have] == [x[:4] for x in want]
        assert np.allclose([x[4:] for x in have], [x[4:] for x in want])
    assert lm_scoring.score_corpus(odd.limit(0)).count() == 0
    lone = lm_scoring.score_corpus(spark.createDataFrame([(i, "a b") for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1], "doc_id long, text string")).first()
    assert lone["train_tokens"] == 0 and lone["score"] == pytest.approx(-4 * math.log10(256))


def test_languages(spark, odd, docs):
    got = language_id.identify(table(spark, "/root/testdata/sf0.01", "documents")).join(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) >= 0.97 and all(0 <= r["score"] <= 1 for r in got)
    told = {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"]) for r in language_id.identify(odd).collect()}
    assert told[1, None] == told[2, ""] == told[7, "123 ... !"] == ("und", 0.0) and told[6, LONG][0] in {"en", "fr", "de"}
    assert language_id.identify(odd.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_languages_of_equal_samples(spark):
    """As many documents of each language: all of them must be among those that train."""
    df = table(spark, "/root/testdata/sf0.1", "documents").filter("length(text) < 3000")
    model = language_id.train(df.filter(~language_id.held_out(F.col("doc_id"))), language_id.Settings(per_language=40))
    told = language_id.predict(df.filter(language_id.held_out(F.col("doc_id"))), model)
    right, score = told.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg("score")).first()
    assert right >= 0.97 and abs(score - right) < 0.1
    kept = corpus_pipeline.keep_languages(spark, df, SF)
    assert kept.count() >= 0.99 * df.count()


PAGE = """<html><body class="page"><div class="menu"><a href="/">Home</a> <a href="/x">All other things that we have</a></div><div class="content"><article class="post-12"><header><h1>Title &amp; more</h1>
<span class="by">by someone</span></header><p>First  paragraph, which is long enough to be read by anyone who comes along.<p>Second &lt;one&gt;, also of some length, and it has <b>bold</b> words<br>in it.
<script>if (a < b) { x("</p>") }</script><aside>By the way</aside><div class="ad">Buy this</div><form>Mail <input></form></article><div class="comments"><p>I don't agree, said a reader at great length, over and over.</p></div></div>
<div id="sidebar">Related things</div><footer>&copy; us</footer></body>"""


def test_pages(spark):
    rows = [(1, "http://a.org/1", PAGE), (2, "http://a.org/2", PAGE.replace("post-12", "post-7")), (3, None, None), (4, "http://b.org", ""), (5, "http://b.org", "plain words &nbsp; and more"),
            (6, "http://b.org", "<p>only <b>a</p><p>few"), (7, "x", "<div" * 50), (8, "http://a.org/3", "<article>" * 300 + "deep text" + "</div>" * 10)]
    df = spark.createDataFrame(rows + rows[:1], "page_id long, url string, html string").withColumns({"host": F.lit(1), "path": F.lit(2), "text": F.lit(3)})
    got = {r["page_id"]: r["text"] for r in html_extraction.extract_pages(df).collect()}
    body = "Title & more\nFirst paragraph, which is long enough to be read by anyone who comes along.\nSecond <one>, also of some length, and it has bold words in it."
    assert got[1] == got[2] == body
    assert got[3] == got[4] == "" and got[5] == "plain words and more" and got[6] == "only a\nfew" and got[8] == "deep text"
    assert html_extraction.extract_pages(df).count() == len(rows) + 1
    assert html_extraction.extract_pages(df.limit(0)).count() == 0


@pytest.mark.parametrize("html", [
    '<div class="wrap has-sidebar"><p>{0}</p><p>{1}</p></div>', '<div id="page" class="no-header"><p>{0}</p><p>{1}</p></div>',
    '<article class="post no-comments"><p>{0}</p><p>{1}</p></article>', '<article><p>{0}</p><section id="related-work"><p>{1}</p></section></article>',
    '<article><h2 id="notice">{0}</h2><p>{1}</p></article>', '<article><p>{0}</p><p class="share">{1}</p></article>',
    '<div class="sidebar"><p>{0}</p><p>{1}</p></div>', '<div class="comments"><p>{0}</p><p>{1}</p></div>', '<div class="search-active"><p>{0}</p><p>{1}</p></div>'])
def test_pages_named_by_layout(html):
    """A word of a name alone doesn't delete an article or a part of it; the same names still drop what is beside it."""
    first, second = "The first part of the text, which goes on for a while.", "A second part, and it is about as long as the first."
    for page in (html, f'<body><div class="menu"><a href="/">Home</a></div>{html}<div id="footer-links"><a href="/x">more</a></div></body>'):
        assert html_extraction.extract(page.format(first, second), None) == f"{first}\n{second}"
    around = '<article><p>{0}</p><p>{0}</p><p>{0}</p><div class="share-buttons">Send it</div><ul class="related-posts"><li><a href="/y">Another one</a></ul><div class="sidebar">Aside</div></article>'
    assert html_extraction.extract(around.format(first), None) == "\n".join([first] * 3)


SENTENCE = "A sentence of the article that goes on for quite a while, as they do."


@pytest.mark.parametrize("name", "post-comments article-sidebar main-navigation entry-related content-ad text-ad story-promo entry-footer post-share article-ads related-posts adsbygoogle".split())
def test_pages_without_what_an_article_word_names(name):
    """The last word of a name says what it is: comments of a post aren't the post."""
    html = f'<body><article>{f"<p>{SENTENCE}</p>" * 4}<div class="{name}"><p>Something else</p></div></article></body>'
    assert html_extraction.extract(html, None) == "\n".join([SENTENCE] * 4)
    for part in ("post-content", "article-body", "content-with-sidebar", "no-comments", "content-area"):
        assert html_extraction.extract(html.replace(name, part), None).endswith("Something else")


def test_pages_with_drawings_and_formulas():
    read = lambda html: html_extraction.extract(html, None)
    assert read("<article><p>one</p><svg><path/><p>two</p></article>") == "one\ntwo"
    assert read("<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds</p><math><p>then</article>") == "so x=2 holds\nthen"
    assert read("<p>a <svg><title>t</title><text>no</text></svg>b <button>Buy</button>c <select><option>1</select>d") == "a b c d"
    assert read('<p>a<b title="x>y">b</b> c<i title="z>d</i></p><p>e') == "ab cd\ne"


@pytest.mark.parametrize("seed", range(5))
def test_pages_of_planted_blocks(spark, seed):
    """Pages of one template with known articles: exactly their blocks come back."""
    rng = random.Random(seed)
    around = ['<nav><a href="/">Home</a> and more</nav>', '<div class="sidebar">Popular <p>Other news of the day</p></div>', "<script>var x = '<p>no</p>';</script>", "<style>p {}</style>",
              '<div class="cookie-notice">We use cookies</div>', "<form>Mail <input> please</form>", '<div id="comments"><p>I think so too</p></div>', "<footer>&copy; 2020</footer>", "<!-- <p>gone</p> -->"]
    rows, want = [], {}
    for i in range(30):
        said = [f"{SENTENCE} {rng.random()} &amp; more,  {'<b>bold</b> ' * rng.randrange(2)}<!-- x -->end" for _ in range(rng.randrange(3, 9))]
        inside = [f"<p>{t}</p>" if rng.random() < 0.7 else f"<div><h2>Part</h2>\n<p>{t}" + "</div>" for t in said]
        blocks = [b for t, html in zip(said, inside, strict=True) for b in (["Part"] if "<h2>" in html else []) + [" ".join(t.replace("&amp;", "&").replace("<b>", "").replace("</b>", "").replace("<!-- x -->", "").split())]]
        middle = [x for p in inside for x in ([p, rng.choice(around)] if rng.random() < 0.2 else [p])]
        html = f"<html><head><title>T</title></head><body>{rng.choice(around)}<div class='post-{i}'>{''.join(middle)}</div>{''.join(rng.sample(around, 4))}</body></html>"
        rows.append((i, f"http://h{i % 2}.org/{i}", html))
        want[i] = "\n".join(blocks)
    got = html_extraction.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == want


@pytest.mark.parametrize("html", ["<div>" * 100000, "<div>w" * 60000, "<a x=\"'" * 60000, "<a x=\"'>" * 60000, "<b>" * 60000 + "</i>" * 60000, "<i><div>" + "<b>" * 60000 + "</i>" * 60000,
                                  "<div>" * 60000 + "</section>" * 60000, "<a" * 300000, "<!--" * 200000, "<div>" * 2000 + "<div><p>a</p></div>" * 30000, "<p class" + " " * 100000 + ">x", f"<div><p>{SENTENCE}</p></div>" * 60000])
def test_pages_of_hostile_markup_in_linear_time(html):
    started = time.process_time()
    html_extraction.best_container(html)
    html_extraction.extract(html, None)
    assert time.process_time() - started < 15


def test_pages_in_nested_templates(spark):
    """Title, lead and short sections stay, whichever container of the article wins the vote."""
    many = "".join(f"<p>Paragraph {i} of the text, which goes on for a while, as they do.</p>" for i in range(8))
    body = "\n".join(f"Paragraph {i} of the text, which goes on for a while, as they do." for i in range(8))
    inner = f'<h1>T</h1><p>lead</p><div class="content">{many}</div>'
    cases = {"a": (f"<body><p>out</p><article>{inner}</article></body>", f"T\nlead\n{body}"), "b": (f"<body><p>out</p><article><section>{many}</section><section><p>Short one.</p></section></article></body>", f"{body}\nShort one."),
             "c": (f'<body><p>out</p><div class="post-5">{inner}</div></body>', f"T\nlead\n{body}"),
             "d": (f'<body><p>out</p><div><div class="x">{many}</div><h2>Between</h2><div class="x"><p>Short one.</p></div></div></body>', f"{body}\nBetween\nShort one."),
             "e": (f"<main><article>{inner}</article><article><p>Short one.</p></article></main>", f"T\nlead\n{body}\nShort one.")}
    rows = [(i, f"http://{host}.org/{i}", cases[host][0]) for host in cases for i in range(3)]
    got = html_extraction.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["text"] == cases[r["url"][7]][1], r["url"]


def test_pipeline(spark, docs, odd, monkeypatch):
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, kept = kept, stage(spark, kept, SF).cache()
        assert kept.columns == docs.columns and kept.count() > 0.5 * before.count(), name
        if name == "ngram_jaccard_join":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            own = [(d, sets(t)) for d, t in rows]
            links = [(i, j) for i in range(len(own)) for j in range(i) if own[i][1] and own[j][1] and 100 * len(own[i][1] & own[j][1]) >= 80 * len(own[i][1] | own[j][1])]
            assert kept.count() == len(set(plain_components(range(len(own)), links).values()))
    n, least = packed_right(corpus_pipeline.STAGES[4][1](spark, kept, SF).collect(), [(r["doc_id"], r["text"]) for r in kept.collect()])
    assert n <= 1.06 * least + 1
    assert corpus_pipeline.keep_languages(spark, odd.select(docs.columns), SF).count() == 7
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
