"""Language ID: multinomial logistic regression on TF-IDF character n-grams, trained with FTRL, then calibrated."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinewatch.llm.common import remainder_of_id, rows_of

UNKNOWN = "und"

#: Parts of a language while the end of its sample is sought.
SAMPLE_PARTS = 256


@dataclass(frozen=True)
class Settings:
    """buckets: features (a power of two); per_language: labelled documents to train and calibrate on, the bound of the sample."""

    longest: int = 3
    buckets: int = 1 << 16
    per_language: int = 400
    rounds: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-4
    l2: float = 1e-4
    scale: float = 40.0
    calibration_part: int = 4


@dataclass(frozen=True)
class Model:
    settings: Settings
    languages: list[str]
    table: np.ndarray  # bucket x language: idf times weight, over the temperature
    bias: np.ndarray


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.bool_, 0x110000)


def grams(texts: list[str | None], settings: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1, 2, ...: buckets of the n-grams of the texts' letters (other runs: one space), and the text of each."""
    points = np.frombuffer("\0".join(["", *((t or "").replace("\0", " ").lower() for t in texts), ""]).encode("utf-32-le"), np.uint32)
    letter, stop = _letters()[points], points == 0
    gap = ~letter & ~stop
    keep = letter | stop
    keep[1:] |= gap[1:] & letter[:-1]
    code = np.where(letter, points, np.uint32(32))
    code[stop] = 0
    code = code[keep]
    text = np.cumsum(code == 0) - 1
    value, whole = np.zeros(len(code), np.uint32), np.ones(len(code), bool)
    shift = 32 - (settings.buckets.bit_length() - 1)
    for n in range(1, settings.longest + 1):
        if len(code) < n:
            return
        size = len(code) - n + 1
        value = value[:size] * np.uint32(0x01000193) + (code[n - 1 :] + np.uint32(n)) * np.uint32(0x9E3779B1)
        whole = whole[:size] & (code[n - 1 :] != 0)
        mixed = value ^ (value >> np.uint32(15))
        yield ((mixed * np.uint32(0x85EBCA77)) >> np.uint32(shift))[whole], text[:size][whole]


def has_letter(texts: list[str | None]) -> np.ndarray:
    return np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for batch in rows_of(batches, "text", 1 << 20):
        yield batch, batch.column("text").to_pylist()


def document_frequency(docs: DataFrame, settings: Settings) -> tuple[np.ndarray, int]:
    """In how many documents each bucket is found. A row for each bucket, whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(settings.buckets + 1, np.int64), 0
        for _, texts in _texts(batches):
            n += len(texts)
            parts = list(grams(texts, settings))
            bounds = [np.searchsorted(t, np.arange(len(texts) + 1)) for _, t in parts]
            for i in range(len(texts)):
                seen = np.zeros(settings.buckets, bool)
                for (g, _), b in zip(parts, bounds, strict=True):
                    seen[g[b[i] : b[i + 1]]] = True
                total[:-1] += seen
        total[-1] = n
        used = np.flatnonzero(total)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    rows = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(settings.buckets + 1, np.int64)
    out[rows["bucket"]] = rows["n"]
    return out[:-1], int(out[-1])


def _sample(docs: DataFrame, settings: Settings) -> list[tuple[int, str, np.ndarray, np.ndarray]]:
    """Features of the documents with the smallest hashes, so many a language: (rank, language, buckets, share of each)."""
    rows = docs.select("doc_id", "lang", "text", F.xxhash64("doc_id", F.lit(11)).alias("_h")).filter(F.rlike("text", F.lit(r"\p{L}")))
    # where the sample of each language ends, from hashes alone and in parts: no task gets a language's texts or all its hashes
    ends = rows.select("lang", "_h", F.pmod("_h", F.lit(SAMPLE_PARTS)).alias("_part"))
    for by in (["lang", "_part"], ["lang"]):
        ends = ends.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy("_h"))).filter(F.col("_r") <= settings.per_language)
    ends = ends.groupBy("lang").agg(F.max("_h").alias("_end"))  # a row a language, of which the model holds all
    chosen = rows.join(F.broadcast(ends), "lang").filter(F.col("_h") <= F.col("_end"))
    order = W.partitionBy("lang").orderBy("_h", "doc_id")
    chosen = chosen.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= settings.per_language)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _texts(batches):
            buckets, shares = [], []
            for text in texts:
                found, n = np.unique(np.concatenate([g for g, _ in grams([text], settings)]), return_counts=True)
                buckets.append(found.astype(np.int32))
                shares.append((n / n.sum()).astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("_r"), pa.array(buckets, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], names=["lang", "r", "buckets", "shares"])

    rows = chosen.select("lang", "_r", "text").mapInArrow(features, "lang string, r int, buckets array<int>, shares array<float>")
    got = rows.toArrow().sort_by([("r", "ascending"), ("lang", "ascending")])
    return [(r, lang, b.values.to_numpy(), s.values.to_numpy()) for r, lang, b, s in zip(got["r"].to_pylist(), got["lang"].to_pylist(), got["buckets"], got["shares"], strict=True)]


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Learns from text and lang of docs (rows without a lang are left out). IDF counts all of them, weights the sample."""
    docs = docs.filter(F.col("lang").isNotNull())
    often, n = document_frequency(docs, settings)
    idf = np.log((1 + n) / (1 + often)) + 1
    sample = _sample(docs, settings)
    languages = sorted({lang for _, lang, _, _ in sample})
    kinds = len(languages)
    if not kinds:
        return Model(settings, [], np.zeros((settings.buckets, 0)), np.zeros(0))
    # of each language the 1st, 5th, ... document calibrates and the others train; both if there is only one
    fit = [x[1:] for x in sample if (x[0] - 1) % settings.calibration_part]
    fit += [x[1:] for x in sample if x[1] not in {lang for lang, _, _ in fit}]
    held = [x[1:] for x in sample if (x[0] - 1) % settings.calibration_part == 0]
    z, g2 = np.zeros((settings.buckets + 1, kinds)), np.zeros((settings.buckets + 1, kinds))

    def weights(rows) -> np.ndarray:
        rate = (settings.beta + np.sqrt(g2[rows])) / settings.alpha + settings.l2
        return np.where(np.abs(z[rows]) <= settings.l1, 0.0, -(z[rows] - np.sign(z[rows]) * settings.l1) / rate)

    order = np.random.default_rng(5)
    for _ in range(settings.rounds):
        for i in order.permutation(len(fit)):
            lang, buckets, shares = fit[i]
            rows = np.append(buckets, settings.buckets)  # the last row is the bias
            x = np.append(shares * idf[buckets] * settings.scale, 1.0)
            w = weights(rows)
            error = _softmax(x @ w)
            error[languages.index(lang)] -= 1
            g = x[:, None] * error
            z[rows] += g - (np.sqrt(g2[rows] + g * g) - np.sqrt(g2[rows])) / settings.alpha * w
            g2[rows] += g * g
    w = weights(np.arange(settings.buckets + 1))
    logits = np.array([(s * idf[b] * settings.scale) @ w[b] + w[-1] for _, b, s in held])
    truth = np.array([languages.index(lang) for lang, _, _ in held])
    heats = np.exp(np.linspace(-3, 3, 121))
    loss = [-np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in heats]
    heat = heats[int(np.argmin(loss))]
    return Model(settings, languages, (idf[:, None] * w[:-1] * settings.scale / heat).astype(np.float32), w[-1] / heat)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred and score to every row of docs. Null text or none with a letter: `und` and score 0; so if nothing was learned."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages
    fields = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        kinds = len(m.languages)
        for batch, texts in _texts(batches):
            known = has_letter(texts) & (kinds > 0)
            logits, n = np.zeros((len(texts), kinds)), np.zeros(len(texts))
            for buckets, text in grams(texts, m.settings) if kinds else ():
                n += np.bincount(text, minlength=len(texts))
                for k in range(kinds):
                    logits[:, k] += np.bincount(text, weights=m.table[:, k][buckets], minlength=len(texts))
            label, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            if known.any():
                p = _softmax(logits[known] / n[known][:, None] + m.bias)
                label[known], score[known] = np.array(m.languages, object)[p.argmax(1)], p.max(1)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(label, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, StructType([*fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def held_out(doc_id: Column) -> Column:
    """A null doc_id is learned from."""
    return F.coalesce(remainder_of_id(doc_id, 5) == 0, F.lit(False))


def identify(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, text, held_out, lang_pred and score of every row of docs, learned from those that aren't held out.

    Prediction reads the text alone. Empty table: empty result.
    """
    model = train(docs.filter(~held_out(F.col("doc_id"))), settings)
    return predict(docs.select("doc_id", "text"), model).withColumn("held_out", held_out(F.col("doc_id")))
