"""Successive numbers for the rows of a table of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written


def numbered(rows: DataFrame, order: list[str], start: Column | int = 0, name: str = "number") -> DataFrame:
    """``rows`` with ``name`` (in place of a column of that name): successive numbers from ``start`` in ``order``; ties are numbered in no set order.

    Ranges are cut by order and written once with their range and place, so that the counts of the ranges and the rows they
    are joined with are one and the same partitioning, whatever the planner coalesces. A task sorts one range, and only the ranges'
    counts (a row for each task) meet. An empty table gives no rows.
    """
    part, place = "__part", "__place"
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id() - F.shiftleft(F.col(part).cast("long"), 33))
    kept = written(ranged, "numbered")
    sizes = kept.groupBy(part).agg(F.count("*").alias("n"))
    before = sizes.select(part, (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias("__before"))  # a row for each task of the write
    start = F.lit(start) if isinstance(start, int) else start
    return kept.join(F.broadcast(before), part).select(*[c for c in rows.columns if c != name], (start + F.col("__before") + F.col(place)).cast("long").alias(name))
