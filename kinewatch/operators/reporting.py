"""Latency summaries, run counts and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinewatch.functions.scalars import safe_ratio
from kinewatch.operators.lineage import cut
from kinewatch.operators.slices import MAX_GROUP_ROWS
from pyspark.sql import Window


def value_counts(df: DataFrame, key: str, value: str) -> DataFrame:
    """Distinct values per key with `n` (copies), written once: the rows behind them may be a whole cascade."""
    return cut(df.groupBy(key, value).agg(F.count("*").alias("n")))


def ranked_values(counts: DataFrame, key: str, value: str, limit: int = MAX_GROUP_ROWS) -> DataFrame:
    """Adds `rank` (0-based position of the first copy) to the counts of `value_counts`.

    A key with very many distinct values is range partitioned, ranked per partition and offset by the
    counts of the partitions before it.
    """
    top = counts.groupBy(key).count().agg(F.max("count")).first()[0]
    if top is None or top <= limit:
        w = Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        return counts.withColumn("rank", F.sum("n").over(w) - F.col("n"))
    placed = cut(counts.repartitionByRange(key, value).withColumn("_part", F.spark_partition_id()))
    w = Window.partitionBy(key, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(key, "_part").agg(F.sum("n").alias("_s")).select(
        key, "_part", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"))
    return (placed.withColumn("rank", F.sum("n").over(w) - F.col("n"))
            .join(offsets, [key, "_part"])
            .withColumn("rank", F.col("rank") + F.col("_o")).drop("_part", "_o"))


def _at_rank(rank: Column, value: str) -> Column:
    return F.max(F.when(F.col("rank") <= rank, F.col(value)))


def _linear(total: Column, q: float, value: str) -> Column:
    position = (total - 1) * F.lit(q)
    low, high = _at_rank(F.floor(position), value), _at_rank(F.ceil(position), value)
    share = F.max(position - F.floor(position))
    return low + (high - low) * share


def _totals(counts: DataFrame, v: str, *more: Column) -> DataFrame:
    # a null counts as a row, but not in the mean
    known = F.sum(F.when(F.col(v).isNotNull(), F.col("n")))
    return counts.groupBy("stage").agg(
        F.sum("n").alias("count"), F.try_divide(F.sum(F.col(v) * F.col("n")), known).alias("mean_ms"),
        F.max(v).alias("maximum_ms"), *more)


def stage_latency_summary(df: DataFrame, limit: int = MAX_GROUP_ROWS) -> DataFrame:
    """count, mean, p50, p95 and max per stage; percentiles are exact and linear."""
    v = "latency_ms"
    counts = value_counts(df, "stage", v)
    ranks = ranked_values(counts, "stage", v, limit).join(_totals(counts, v), "stage")
    n = F.col("count")
    return ranks.groupBy("stage").agg(
        F.first("count").alias("count"), F.first("mean_ms").alias("mean_ms"),
        _linear(n, 0.50, v).alias("p50_ms"), _linear(n, 0.95, v).alias("p95_ms"),
        F.first("maximum_ms").alias("maximum_ms"))


def negative_latencies(df: DataFrame) -> DataFrame:
    return df.filter(F.col("latency_ms") < 0)


def nearest_rank_latency(df: DataFrame, limit: int = MAX_GROUP_ROWS) -> DataFrame:
    """mean, median, min, max and the value at position round((n-1)*0.95), half to even."""
    v = "latency_ms"
    counts = value_counts(df, "stage", v)
    totals = _totals(counts, v, F.min(v).alias("minimum_ms"))
    ranks = ranked_values(counts, "stage", v, limit).join(totals, "stage")
    n = F.col("count")
    return ranks.groupBy("stage").agg(
        F.first("count").alias("count"), F.first("mean_ms").alias("mean_ms"),
        _linear(n, 0.5, v).alias("median_ms"), F.first("minimum_ms").alias("minimum_ms"),
        F.first("maximum_ms").alias("maximum_ms"),
        _at_rank(F.bround((n - 1) * F.lit(0.95)), v).alias("p95_ms"))


def stage_throughput(df: DataFrame, stages: tuple[str, ...] = ("detection", "tracking", "temporal")
                     ) -> DataFrame:
    """Items per second of the given stages, where the mean is positive."""
    mean = df.filter(F.col("stage").isin(*stages)).groupBy("stage").agg(
        F.avg("latency_ms").alias("mean_ms"))
    return mean.filter("mean_ms > 0").select(
        "stage", F.try_divide(F.lit(1000.0), F.col("mean_ms")).alias("per_second"))


def provider_usage(assessments: DataFrame, limit: int = MAX_GROUP_ROWS) -> DataFrame:
    """Calls, latency summary and tokens per provider; a missing token count is zero."""
    tokens = assessments.groupBy("provider").agg(
        F.count("*").alias("calls"),
        F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"),
        F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"))
    times = stage_latency_summary(
        assessments.select(F.col("provider").alias("stage"), "latency_ms"), limit)
    return tokens.join(times.withColumnRenamed("stage", "provider").drop("count"), "provider")


def class_counts(detections: DataFrame) -> DataFrame:
    return detections.groupBy("class_name").agg(F.count("*").alias("detections"))


def run_summary(events: DataFrame, alerts: DataFrame, transitions: DataFrame) -> DataFrame:
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("kind"), "rows")
             for name, df in (("events", events), ("alerts", alerts), ("transitions", transitions))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def manifest_counts(df: DataFrame) -> DataFrame:
    """Rows per split, and the size of the small subset where the table has that flag."""
    aggs = [F.count("*").alias("records")]
    if "small_validation_subset" in df.columns:
        aggs.append(F.count_if("small_validation_subset").alias("small_subset"))
    return df.groupBy("split").agg(*aggs)


def content_fingerprint(files: DataFrame, path: str = "path", digest: str = "sha256") -> DataFrame:
    """One digest over all (path, content digest) pairs, independent of row order.

    Digests combine as a tree over the leading hex digits of the path digest, so no task sees all
    files.
    """
    leaf = files.select(
        F.sha2(F.col(path), 256).alias("p"),
        F.sha2(F.concat_ws("\n", F.col(path), F.col(digest)), 256).alias("d"))
    for digits in (4, 2, 0):
        leaf = leaf.groupBy(F.substring("p", 1, digits).alias("p")).agg(
            F.sha2(F.concat_ws("", F.array_sort(F.collect_list("d"))), 256).alias("d"))
    return leaf.select(F.col("d").alias("fingerprint"))
