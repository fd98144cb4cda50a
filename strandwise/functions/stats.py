"""Length and quality statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql import Window


def n50(lengths: DataFrame, column: str) -> DataFrame:
    """One row: ``n50`` (the customary one) and ``n50_early``.

    Lengths are first counted by value, so the running sum is over distinct
    lengths, not over records.  ``n50_early`` is the smallest length whose running
    sum, from the longest down, is still below half the total; else the longest.
    """
    each = lengths.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("long").alias("len")).agg(F.count("*").alias("n"))
    down = Window.orderBy(F.desc("len"))
    run = each.select("len", "n", F.sum(F.col("len") * F.col("n")).over(down.rowsBetween(Window.unboundedPreceding, 0)).alias("after"), F.sum(F.col("len") * F.col("n")).over(Window.partitionBy()).alias("total"))
    # Among equal lengths the running sum grows record by record: the first is the least.
    below = (F.col("after") - F.col("len") * (F.col("n") - 1)) < F.floor(F.col("total") / 2)
    return run.agg(F.max(F.when(F.col("after") * 2 >= F.col("total"), F.col("len"))).alias("n50"), F.coalesce(F.min(F.when(below, F.col("len"))), F.max("len")).alias("n50_early"))


def length_stats(lengths: DataFrame, column: str, long: int, circular: Column | None = None) -> DataFrame:
    """One row: ``size, n, n_long, n_long_circular``."""
    ring = circular if circular is not None else F.lit(False)
    return lengths.agg(F.sum(column).alias("size"), F.count(column).alias("n"), F.count_if(F.col(column) > long).alias("n_long"), F.count_if((F.col(column) > long) & ring).alias("n_long_circular"))
