"""Ranking quality over a batch of judged queries, and latency percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written


def query_metrics(hits: DataFrame, queries: DataFrame, judgments: DataFrame, k: int) -> DataFrame:
    """(qid, ranking, precision, recall, reciprocal_rank) of each query (qid, ranking).

    hits: qid, id, rank. judgments: qid, id. Precision divides by k even where fewer were retrieved; recall by the relevant documents;
    the reciprocal rank looks at the first k. Queries without a judgment have no row, those without hits have zeros.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    relevant = judgments.select("qid", "id").where("qid is not null and id is not null").distinct()
    good = hits.where(F.col("rank") <= k).join(relevant, ["qid", "id"]).groupBy("qid").agg(F.count_distinct("id").alias("hit"), F.min("rank").alias("first"))
    size = relevant.groupBy("qid").agg(F.count("*").alias("relevant"))
    return (
        queries.select("qid", "ranking").join(size, "qid").join(good, "qid", "left")
        .select(
            "qid", "ranking", (F.coalesce("hit", F.lit(0)) / F.lit(k)).alias("precision"), (F.coalesce("hit", F.lit(0)) / F.col("relevant")).alias("recall"),
            F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        )
    )


def summary(metrics: DataFrame) -> DataFrame:
    """Means over all judged queries, for each ranking."""
    return metrics.groupBy("ranking").agg(
        F.count("*").alias("queries"), F.avg("precision").alias("mean_precision"), F.avg("recall").alias("mean_recall"), F.avg("reciprocal_rank").alias("mrr")
    )


def order_statistics(samples: DataFrame, value: str, ranks: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """For each group (columns ``by``) the values at given ranks; ``ranks`` are expressions of ``n``, the number of values that aren't null.

    Exact and without any group in one task: equal values are counted before the shuffle, the counts are cut by range and written once,
    running counts are summed within a range and offset by the totals of earlier ranges (a row for each task and group). Groups
    without values have nulls.
    """
    by = by or []
    keys = [F.struct(*by, F.lit(0)).alias("g")]
    counted = samples.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    kept = written(counted.repartitionByRange("g", "v").sortWithinPartitions("g", "v").withColumn("part", F.spark_partition_id()), "ordered")
    totals = kept.groupBy("g", "part").agg(F.sum("c").alias("t"))
    earlier = totals.select("g", "part", (F.sum("t").over(Window.partitionBy("g").orderBy("part")) - F.col("t")).alias("before"), F.sum("t").over(Window.partitionBy("g")).alias("n"))
    running = kept.withColumn("upto", F.sum("c").over(Window.partitionBy("g", "part").orderBy("v"))).join(F.broadcast(earlier), ["g", "part"])
    last = F.col("before") + F.col("upto")
    picked = running.groupBy("g").agg(*(F.max(F.when((last - F.col("c") < r) & (r <= last), F.col("v"))).alias(name) for name, r in ranks.items()))
    groups = samples.groupBy(*keys).agg(F.max(value).alias("max"))
    return groups.join(picked, "g", "left").select(*(F.col("g")[c].alias(c) for c in by), *ranks, "max")


def latencies(samples: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Median (between the middle two), nearest-rank 95th percentile and maximum of a column; nulls don't count."""
    n = F.col("n")
    found = order_statistics(samples, value, {"low": F.floor((n + 1) / 2), "high": F.floor((n + 2) / 2), "p95": F.floor((n * 95 + 99) / 100)}, by)
    return found.select(*(by or []), ((F.col("low") + F.col("high")) / 2).alias("median"), "p95", "max")
