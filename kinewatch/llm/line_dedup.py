"""Line dedup: explode normalised lines, hash them, count documents by hash, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinewatch.llm.common import SPACES, key128, lower_ascii, settle

#: A key with this share of all lines or more is hot; so there are at most as many hot keys as its inverse.
HOT_SHARE, SALTS = 1 / 1000, 64
LAST_ID = (1 << 63) - 1


def _key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


def drop_repeated_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Adds n_lines, n_dropped and kept_text to every row of docs.

    A line goes if its key has min_chars code points or more, is found in min_docs documents or more, and the document
    isn't the smallest doc_id with it. Null or empty text: one empty line, kept. Null doc_id: one document after all
    others. Rows that repeat a doc_id count as one document but are cut apart. Lines inside the keeping document stay,
    repeats too. Empty table: empty result. Other columns pass through.
    """
    names = docs.columns
    work = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce("doc_id", F.lit(LAST_ID)).alias("d"),
                       F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"), *key128(F.struct("doc_id", "text"), "r"))
    lines = work.select("d", "r1", "r2", F.posexplode("lines").alias("pos", "line")).select("d", "r1", "r2", "pos", _key(F.col("line")).alias("key"))
    lines = lines.filter(F.char_length("key") >= min_chars).select("d", "r1", "r2", "pos", *key128(F.col("key"), "k"))
    if min_docs == 2:  # two documents or more: the smallest id isn't the largest
        found = lines.groupBy("k1", "k2").agg(F.min("d").alias("keeper"), F.max("d").alias("top"), F.count("*").alias("n"))
        found = found.filter(F.col("keeper") < F.col("top")).drop("top")
    else:
        per_doc = lines.groupBy("k1", "k2", "d").agg(F.count("*").alias("n"))
        found = per_doc.groupBy("k1", "k2").agg(F.min("d").alias("keeper"), F.count("*").alias("docs"), F.sum("n").alias("n"))
        found = found.filter(F.col("docs") >= min_docs).drop("docs")
    found = settle(found)
    total = found.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") >= max(1000, total * HOT_SHARE)
    hot_keys = found.filter(hot).select("k1", "k2", F.lit(True).alias("hot"))  # at most 1 / HOT_SHARE rows
    salted = lines.join(F.broadcast(hot_keys), ["k1", "k2"], "left").withColumn(
        "salt", F.when(F.col("hot"), F.pmod(F.col("r1"), F.lit(SALTS))).otherwise(0).cast("int")).drop("hot")
    spread = found.withColumn("salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    drops = (salted.join(spread.drop("n"), ["k1", "k2", "salt"]).filter(F.col("d") > F.col("keeper"))
             .groupBy("r1", "r2").agg(F.collect_set("pos").alias("gone")))
    whole = F.size("lines")
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(
        F.transform(F.array_except(F.sequence(F.lit(0), whole - 1), "gone"), lambda i: F.get("lines", i)))
    out = work.join(drops, ["r1", "r2"], "left").select(
        "row", whole.cast("long").alias("n"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("dropped"), F.array_join(kept, "\n").alias("text"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in names], F.col("n").alias("n_lines"), F.col("dropped").alias("n_dropped"), F.col("text").alias("kept_text"))


def digest(done: DataFrame) -> DataFrame:
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
with l as (
  select doc_id, u.i as pos, u.x as line,
         translate(trim(u.x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as a from documents),
       unnest(list_transform(a, lambda x, i: {'x': x, 'i': i})) as t(u)),
k as (select key, min(doc_id) as keeper from l where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
m as (select l.*, k.keeper is not null and l.doc_id > k.keeper as gone from l left join k using (key))
select doc_id, count(*) as n_lines, sum(gone::int)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from m group by doc_id
"""
