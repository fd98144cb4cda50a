"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of the rows on, so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 1000


def hot_keys(df: DataFrame, key: str, rows: int, share: float = HOT_SHARE) -> list:
    """Keys that hold at least ``share`` of ``rows`` rows: at most ``1 / share`` values.

    The count is partially aggregated before its shuffle.  A null key is never hot,
    as it joins with nothing.
    """
    least = max(2, int(rows * share))
    counted = df.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") >= least)
    return [r[0] for r in counted.select(key).collect()]


def lookup_join(left: DataFrame, key: str, right: DataFrame, right_key: str, how: str = "inner", rows: int | None = None) -> DataFrame:
    """Join ``left`` with ``right``, whose ``right_key`` is unique, without a hot task.

    Rows of ``left`` with a hot key meet the broadcast of the matching rows of
    ``right`` (at most ``1 / HOT_SHARE`` of them, as the key is unique there);
    all others take a shuffled join.  ``left`` is scanned twice, so pass a written
    table; ``rows`` is its number of rows where that is known.  Null keys match
    nothing; with ``how='left'`` they are kept.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    right = right.withColumnRenamed(right_key, key)
    hot = hot_keys(left, key, left.count() if rows is None else rows)
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    balanced = left.where(~is_hot).join(right, key, how)
    spread = left.where(is_hot).join(F.broadcast(right.where(F.col(key).isin(hot))), key, how)
    return balanced.unionByName(spread)
