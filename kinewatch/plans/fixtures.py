"""Projections of the provided tables onto the operators' input schemas.

Each text is SQL that Spark and DuckDB both accept; {US} is microseconds since 2024-01-01.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

US_SPARK = "timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)"
US_DUCK = "(epoch_us(ts) - epoch_us(timestamp '2024-01-01'))"

_SCOPE = """'cam' || cast(cast(floor(user_id / 3) as bigint) % 4 as string) as source_id,
       's' || cast(cast(floor(user_id / 3) as bigint) as string) as session_id"""

# One month becomes 30 s; three users share a scope, each is a track; a frame id is the clock tick.
TRACKED = """
select event_id as detection_id, """ + _SCOPE + """,
       cast(user_id % 3 as int) as track_id,
       cast({US} as bigint) as frame_id,
       {US} / cast(86400000000 as double) as timestamp_seconds,
       640 as frame_width, 480 as frame_height,
       case event_type when 'view' then 'standing' when 'click' then 'sitting' when 'signup' then 'bending'
            when 'purchase' then 'lying' else 'falling' end as class_name,
       cast(100 + 4 * cast(regexp_extract(props, '([0-9]+)', 1) as int)
         - (case event_type when 'purchase' then 80 when 'error' then 60 else 30 end) as double) as x1,
       cast(100 + 4 * cast(regexp_extract(props, '([0-9]+)', 1) as int)
         + (case event_type when 'purchase' then 80 when 'error' then 60 else 30 end) as double) as x2,
       cast(120 as double) + (cast(round(value * 100) as bigint) % 24000) / cast(100 as double)
         - (case event_type when 'purchase' then 30 when 'error' then 50 else 80 end) as y1,
       cast(120 as double) + (cast(round(value * 100) as bigint) % 24000) / cast(100 as double)
         + (case event_type when 'purchase' then 30 when 'error' then 50 else 80 end) as y2,
       cast(0.9 as double) as confidence
from events
"""

FRAMES = """
select distinct """ + _SCOPE + """, cast({US} as bigint) as frame_id,
       {US} / cast(86400000000 as double) as timestamp_seconds, 640 as frame_width, 480 as frame_height
from events
"""

# Every seventh detection is dropped while its frame stays, which leaves frames without a person.
SPARSE = "select * from (" + TRACKED + ") where detection_id % 7 <> 3"

# One camera, a track for each user: an idle quarter of an hour, then all the rest of its rows within 20 s.
_BURST_TIME = """case when {US} < cast(86400000000 as bigint) then {US} / cast(96000000 as double)
            else 900 + ({US} - 86400000000) / cast(86400000000 as double) * 20 / 29 end"""
BURST = ("select * from (" + TRACKED.replace(_SCOPE, "'cam0' as source_id, 's0' as session_id").replace(
    "cast(user_id % 3 as int) as track_id", "cast(user_id as int) as track_id").replace(
    "{US} / cast(86400000000 as double)", _BURST_TIME) + ") where detection_id % 7 <> 3")
BURST_FRAMES = FRAMES.replace(_SCOPE, "'cam0' as source_id, 's0' as session_id").replace(
    "{US} / cast(86400000000 as double)", _BURST_TIME)

RAW_BOXES = """
select ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey as detection_id, l_linenumber as frame_id,
       'cam' || cast(l_orderkey % 4 as string) as source_id, 's' || cast(l_orderkey % 100 as string) as session_id,
       l_linenumber % 6 as class_id, round(1 - l_discount * 9, 2) as confidence,
       l_quantity * 10 as x1, cast((l_partkey % 40) * 10 as double) as y1,
       l_quantity * 10 + (l_suppkey % 7) * 20 - 20 as x2,
       cast((l_partkey % 40) * 10 + (l_orderkey % 9) * 20 as double) as y2,
       640 as frame_width, 480 as frame_height
from lineitem
"""

IMAGES = """
select p_partkey as image_id,
       case p_partkey % 3 when 0 then 'train' when 1 then 'validation' else 'test' end as split,
       'img-' || cast(p_partkey as string) || '.png' as file_name, 640 as width, 480 as height,
       md5(p_name || p_brand || cast(p_size as string)) as content_hash
from part
"""

ANNOTATIONS = """
select ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey as annotation_id, l_partkey as image_id,
       case l_partkey % 3 when 0 then 'train' when 1 then 'validation' else 'test' end as split,
       cast(1 + l_suppkey % 4 as bigint) as category_id, l_quantity * 10 as x, cast(10 as double) as y,
       case when l_linenumber = 1 then round(640.01 - l_quantity * 10, 2)
            when l_linenumber = 2 and l_partkey % 50 = 0 then 645 - l_quantity * 10
            else cast(40 as double) end as w,
       cast(100 + l_partkey % 50 as double) as h
from lineitem
"""

CATEGORIES = """
select cast(c.category_id as bigint) as category_id, c.name, s.split
from (values (0, 'fallen'), (1, 'fallen'), (2, 'lying'), (3, 'sitting'), (4, 'standing')) as c(category_id, name)
cross join (values ('train'), ('validation'), ('test')) as s(split)
"""

_INTERVAL = """
select cast(event_id as string) as event_id, """ + _SCOPE + """,
       cast(user_id % 3 as int) as track_id,
       {US} / cast(86400000000 as double) as start_time,
       {US} / cast(86400000000 as double) + 0.5 + value / 490 as end_time
from events where event_type = '%s'
"""
TRUTH = _INTERVAL.replace("%s", "error")
PREDICTIONS = _INTERVAL.replace("%s", "purchase")
WINDOWS = _INTERVAL.replace("%s", "signup")

CLIPS = """
select o_orderkey as clip_key, cast(o_custkey % 29 + 1 as int) as true_subject_id,
       case when o_orderkey % 50 = 7 then 'Fall/timelapse_' || cast(o_orderkey as string) || '.mp4'
            else (case when o_orderstatus = 'F' then 'Fall' else 'ADL' end) || '/SBJ_'
                 || lpad(cast(o_custkey % 29 + 1 as string), 2, '0') || '_LOC' || cast(o_custkey % 3 + 1 as string)
                 || '/clip' || cast(o_orderkey as string) || '.mp4' end as relative_path,
       md5(cast(o_custkey as string) || '|' || o_orderstatus || '|' || o_orderpriority) as sha256,
       cast(1000 + o_orderkey % 977 as bigint) as bytes,
       cast(25 as double) as fps, cast(25 * (1 + o_orderkey % 20) as bigint) as frames,
       640 as width, 480 as height
from orders
"""

CANDIDATE_ROWS = """
select c.variant || '-' || cast(c.conf as string) as candidate_id, c.variant, c.conf,
       o_orderkey as video_key, cast(o_custkey % 29 + 1 as int) as subject_id,
       o_orderstatus = 'F' as expected_fall,
       (cast(round(o_totalprice * 100) as bigint) % 1000) / cast(1000 as double)
         + (case when o_orderstatus = 'F' then 0.45 else 0.0 end)
         - (case when c.variant = 'nano' then 0.02 else 0.0 end) >= c.conf + 0.2 as predicted_fall
from orders cross join (
  select v.variant, t.conf from (values ('nano'), ('small')) as v(variant)
  cross join (values (cast(0.40 as double)), (cast(0.50 as double)), (cast(0.60 as double)),
                     (cast(0.70 as double)), (cast(0.75 as double)), (cast(0.80 as double))) as t(conf)) as c
"""

SAMPLES = """
select 'c' || cast(conv_id as string) || '-' || cast(turn as string) as sample_id,
       'g' || cast(conv_id % 7 as string) as split_group, role, text as text_context,
       case when conv_id % 7 < 5 then 'train' when conv_id % 7 = 5 then 'validation' else 'test' end as split,
       case conv_id % 3 when 0 then 'fall' when 1 then 'not_fall' else 'uncertain' end as decision,
       cast(1 + turn % 4 as int) as image_count, conv_id % 11 <> 0 as ground_truth_verified,
       conv_id, turn
from conversations
"""

PIXELS_SPARK = """
select vec_id as image_id, cast(vec_id % 3 as int) as split, concat(embedding, slice(embedding, 1, 8)) as px from embeddings
union all
select vec_id + 100000000000, cast((vec_id + 1) % 3 as int),
       transform(concat(embedding, slice(embedding, 1, 8)), (x, i) -> if(i = vec_id % 72, cast(9.0 as float), x)) from embeddings
"""
PIXELS_DUCK = """
select vec_id as image_id, cast(vec_id % 3 as int) as split, embedding || embedding[1:8] as px from embeddings
union all
select vec_id + 100000000000, cast((vec_id + 1) % 3 as int),
       list_transform(embedding || embedding[1:8], lambda x, i: case when i - 1 = vec_id % 72 then cast(9.0 as float) else x end) from embeddings
"""

LATENCY = """
select case event_type when 'view' then 'detection' when 'click' then 'tracking' when 'signup' then 'temporal'
            when 'purchase' then 'keyframe' else 'semantic' end as stage, value as latency_ms
from events
"""

# Whole document text, with a fixed secret line appended.
REDACTION = """
select doc_id, text || ' Authorization: Bearer abc' || cast(doc_id as string)
       || ' api_key=k' || cast(doc_id as string) || ', end' as text
from documents
"""

ATTEMPTS = """
select event_id, p.provider, (event_id + p.ord * 7) % 5 = 0 as ok,
       case event_id % 3 when 0 then 'fall' when 1 then 'not_fall' else 'uncertain' end as decision,
       p.provider || ' failed for ' || cast(event_id as string) as error
from events cross join (values ('openai', 1), ('deepseek', 2), ('mock', 3)) as p(provider, ord)
"""


def duck(sql: str) -> str:
    return sql.replace("{US}", US_DUCK)


def load(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Runs a projection over the one table (or few tables) it names."""
    text = sql.replace("{US}", US_SPARK)
    tables = {}
    for name in ("events", "lineitem", "part", "orders", "conversations", "embeddings", "documents"):
        if f"from {name}" in text:
            text = text.replace(f"from {name}", f"from {{{name}}}")
            tables[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(text, **tables)
