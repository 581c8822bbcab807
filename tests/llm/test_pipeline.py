"""Pipeline stages on rows with null and repeated ids, and on columns whose names the operators use themselves."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
NAMES = ["score", "lang_pred", "kept_text", "_id", "_mark", "_n", "mark", "row", "copies", "component_id", "gone", "d"]
WORDS = "one two three four five six seven eight nine ten eleven twelve"
ROWS = [(5, WORDS, "en", "a"), (None, WORDS, "en", "a"), (None, WORDS + " more", "en", "b"), (5, "the same id with other words in another text", "en", "a"), (3, WORDS, "en", None),
        (7, None, "en", "a"), (8, "", "en", "a"), (None, "no group for this text because it has its own words", None, "b"), (9, "x" * 200_000, "en", "a")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, *r, len(r[1] or "")) for i, r in enumerate(ROWS)]
    df = spark.createDataFrame(rows, "at int, doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.concat(F.lit(c), F.col("at").cast("string")) for c in NAMES}).select("doc_id", "text", "lang", "source", "n_chars", "at", *NAMES)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:4])
def test_other_columns_pass_through(spark, docs, name, stage):
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns
    for r in out.collect():
        assert [r[c] for c in NAMES] == [f"{c}{r['at']}" for c in NAMES]
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_one_row_of_each_group_stays(spark, docs):
    kept = {r["at"]: r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()}
    assert sorted(kept) == [3, 4, 5, 6, 7, 8]  # of 0, 1, 2 and 4 the one with id 3; the other text with id 5 isn't touched
    nameless = docs.filter("doc_id is null")
    assert corpus_pipeline.drop_near_copies(spark, nameless, SF).count() == 2


def test_pieces_carry_all_documents(spark, docs):
    rows = corpus_pipeline.pack(spark, docs, SF).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 7) == 1 and all(len(r["ids"]) == r["length"] for r in rows)
