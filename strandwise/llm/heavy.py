"""Most frequent keys by iceberg multi-hash filtering, in bounded memory."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Abundance of a record whose count is unknown (the largest unsigned 32-bit number).
UNKNOWN_COUNT = 4294967295


def delivered_once(records: DataFrame, key: list[str], weight: str, delivery: list[str], unknown: int = UNKNOWN_COUNT) -> DataFrame:
    """Counting records (whole key, known weight), each delivery once.

    Deliveries repeat with equal content; should they differ, the smallest
    (key, weight) counts.  The group is reduced before the shuffle.  A record that
    lacks a part of ``delivery`` can't be a repeat and counts by itself.
    """
    counting = records.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*key, weight]]) & (F.col(weight) != unknown))
    named = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in delivery])
    once = counting.where(named).groupBy(*delivery).agg(F.min(F.struct(*key, weight)).alias("_r"))
    columns = [*key, weight]
    return once.select(*[F.col(f"_r.{c}").alias(c) for c in columns]).unionByName(counting.where(~named).select(*columns))


def _bucket(key: list[str], seed: int, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(buckets))


def iceberg(records: DataFrame, key: list[str], weight: str, share_inverse: int = 500, hashes: int = 3, buckets: int = 1 << 14) -> DataFrame:
    """Keys holding at least ``1 / share_inverse`` of the total weight.

    Columns: the key, ``estimate`` (least of its exact bucket sums, an upper
    bound) and ``total`` (exact).

    ``records`` are written once, as two passes read them.  Pass 1 sums the weight
    of ``buckets`` coarse buckets under each of ``hashes`` hash functions:
    ``hashes * buckets`` numbers however many keys there are.  A bucket is heavy
    from the threshold on, so each hash has at most ``share_inverse`` heavy
    buckets, and only these leave the engine.  Pass 2 keeps keys whose bucket is
    heavy under every hash and counts the survivors exactly, with partial sums
    before the shuffle, so a hot key costs one row a task.

    Weights must not be negative; a null weight counts as 0, null keys are
    dropped.  An empty table gives an empty result, as does a total of 0.
    Keys that meet the threshold exactly are in the result.
    """
    spark = records.sparkSession
    rows = materialize(records.select(*key, F.coalesce(F.col(weight), F.lit(0)).cast("long").alias("_w")).dropna(subset=key))
    spread = rows.select(F.posexplode(F.array(*[_bucket(key, h, buckets) for h in range(hashes)])).alias("_h", "_b"), "_w")
    sums = spread.groupBy("_h", "_b").agg(F.sum("_w").alias("_s"))
    # Each hash's buckets add up to the total, which comes with them.
    heavy = sums.withColumn("_total", F.sum("_s").over(Window.partitionBy("_h"))).where((F.col("_total") > 0) & (F.col("_s") * share_inverse >= F.col("_total")))
    found = heavy.collect()
    total = found[0]["_total"] if found else 0
    mine = [{r["_b"]: r["_s"] for r in found if r["_h"] == h} for h in range(hashes)]
    kept = rows.where(reduce(lambda a, b: a & b, [_bucket(key, h, buckets).isin(list(m)) for h, m in enumerate(mine)]))
    exact = kept.groupBy(*key).agg(F.sum("_w").alias("total")).where(F.col("total") * share_inverse >= F.lit(total))
    for h, m in enumerate(mine):
        # At most share_inverse rows.
        known = spark.createDataFrame(sorted(m.items()), f"_b{h} long, _s{h} long")
        exact = exact.withColumn(f"_b{h}", _bucket(key, h, buckets)).join(F.broadcast(known), f"_b{h}")
    estimate = F.least(*[F.col(f"_s{h}") for h in range(hashes)]) if hashes > 1 else F.col("_s0")
    return exact.select(*key, estimate.alias("estimate"), "total")
