"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs. All but
the last return the columns of docs. SQL can't express them (learned weights, random rounding), so ORACLE_SQL is None and
tests compare the pipeline with a plain version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinewatch.llm import language_id, line_dedup, mixing, ngram_join, packing
from kinewatch.llm.common import settle, table
from kinewatch.llm.queries import tokenizer_file

#: A text whose likeliest language gets less than this is taken for none of the learned ones.
MIN_SCORE = 0.3
#: Rows of an Arrow batch: whole texts of any length come in batches, which Python workers hold at once.
BATCH_ROWS = 512


def _core(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns; all others, whatever their names, ride along in `row`."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return docs.select(*names, (F.struct(*rest) if rest else F.lit(None).cast("string")).alias("row"))


def _whole(core: DataFrame, docs: DataFrame, *names: str, **changed: Column) -> DataFrame:
    """The columns of docs again, some with new values; names: those that aren't in `row`."""
    def of(c: str) -> Column:
        return changed[c] if c in changed else F.col(c) if c in names else F.col("row").getField(c)

    return core.select(*[of(c).alias(c) for c in docs.columns])


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts in none of the learned languages; a missing lang is filled in.

    Null and empty texts hold no letter. Rows that repeat, null ids and other columns pass through as they are. Empty table: empty.
    """
    core = _core(docs, "doc_id", "text", "lang")
    model = language_id.train(core.filter(~language_id.held_out(F.col("doc_id"))))
    told = language_id.predict(core, model)
    kept = told.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_SCORE))
    return _whole(kept, docs, "doc_id", "text", lang=F.coalesce("lang", "lang_pred"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; the documents stay, if with less text.

    Null text becomes empty. Rows that repeat an id are cut apart; a null id comes last. Other columns pass through. Empty table: empty.
    """
    done = line_dedup.drop_repeated_lines(_core(docs, "doc_id", "text"))
    return _whole(done, docs, "doc_id", text=F.col("kept_text"), n_chars=F.char_length("kept_text").cast("long"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies exactly one row stays: the one with the smallest id, one without an id last.

    Rows are told apart by a mark, so null and repeated ids matter no more than others. Texts without words
    stay, all of them. Other columns pass through. Empty table: empty.
    """
    marked = settle(_core(docs, "doc_id", "text").withColumn("mark", F.monotonically_increasing_id()))
    found = ngram_join.join_documents(marked.select(F.col("mark").alias("doc_id"), "text"))
    grouped = marked.select("mark", "doc_id").join(found.select(F.col("doc_id").alias("mark"), "component_id"), "mark")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    stay = grouped.groupBy("component_id").agg(F.min(order)["mark"].alias("mark")).select("mark")
    return _whole(marked.join(stay, "mark", "left_semi"), docs, "doc_id", "text")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources want them.

    Texts without words are never taken. Rows equal in id, text and source are repeats of one document. Other columns pass through.
    Empty table: empty.
    """
    core = _core(docs, "doc_id", "text", "source")
    return _whole(mixing.repeat_documents(core, mixing.mix_sources(core)), docs, "doc_id", "text", "source")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents' pieces, with their places in sequences; null text: the end token alone."""
    return packing.pack(_core(docs, "doc_id", "text"), tokenizer_file())


STAGES = [("language_id", keep_languages), ("line_dedup", drop_lines), ("ngram_jaccard_join", drop_near_copies), ("source_mixing", mix), ("best_fit_packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
