"""k-min-mer counting over a stream of reads.

Counting is associative, so a stream of reads keeps one row of state a k-min-mer
and emits those that changed (output mode ``update``).  With a watermark, counts
over windows of arrival time are final once the watermark has passed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import kminmers as km
from ..operators import minimize


def stream_counts(reads: DataFrame, k: int = 4, length: int = 15, density: float = 0.005) -> DataFrame:
    """``km, abundance`` of a streaming ``reads`` frame."""
    return km.kminmer_counts(km.kminmer_rows(minimize.minimizer_reads(reads, length, density), k))


def windowed_counts(records: DataFrame, time: str = "seen_at", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``start, k, n, total``: records and abundance by arrival window; rows of null time are dropped."""
    timed = records.where(F.col(time).isNotNull()).withWatermark(time, late)
    return timed.groupBy(F.window(time, width).alias("w"), "k").agg(F.count("*").alias("n"), F.sum("abundance").alias("total")).select(F.col("w.start").alias("start"), "k", "n", "total")
