"""Places in a global order without a window over all rows: ranges, their counts, and running sums of the counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

_IN = (1 << 33) - 1  # monotonically_increasing_id has the task's number above these bits


def numbered(df: DataFrame, *order: Column | str, name: str = "rank", first: int = 1) -> DataFrame:
    """df with its place in the order, from `first` on.

    Rows are sorted by range partitions and written once with their place in their range, as ranges are
    drawn by sampling and might differ when drawn again; the ranges' counts, one row for each, are added
    up and joined back. Rows of equal keys share a range, in no stated order: end with a key that is unique.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    held = written(placed, "order")
    counts = held.groupBy(F.shiftright("_at", 33).alias("_part")).count().collect()  # as many rows as shuffle partitions
    rows, before = [], 0
    for part, n in sorted(counts):
        rows.append((part, before))
        before += n
    starts = df.sparkSession.createDataFrame(rows, "_part long, before long")
    met = held.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(starts), "_part")
    return met.select(*df.columns, (F.col("before") + F.col("_at").bitwiseAND(_IN) + first).alias(name))


def line_numbers(read: DataFrame, name: str = "line", first: int = 1, through: bool = False) -> DataFrame:
    """A text or CSV scan with each row's place in its file, however the file was split; through: in all files, in order of their paths.

    A task reads a split from its start to its end, so the least task-wide number of a split gives the
    places within; what comes before it in the file is a running sum over the file's splits. Only the
    numbers of rows of each split are shuffled.
    """
    split = read.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    counts = split.groupBy("_file", "_start").agg(F.count("*").alias("n"), F.min("_at").alias("_least"))
    w = (Window.orderBy("_file", "_start") if through else Window.partitionBy("_file").orderBy("_start")).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_file", "_start", "_least", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    met = split.join(F.broadcast(before), ["_file", "_start"])  # a row for each split
    return met.select(*read.columns, (F.col("before") + F.col("_at") - F.col("_least") + first).alias(name))
