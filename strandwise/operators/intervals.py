"""Intervals on sequences: depth, covered regions, trimming and fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def depth_steps(intervals: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Stretches of equal depth: ``key, from_pos, to_pos, depth`` (half open).

    A +1/-1 sweep: two rows an interval, whatever its length, summed by position
    before the running sum.  Intervals that are empty or have nulls don't count.
    """
    good = intervals.where(F.col(key).isNotNull() & (F.col(start) < F.col(end)))
    events = good.select(key, F.explode(F.array(F.struct(F.col(start).alias("p"), F.lit(1).alias("d")), F.struct(F.col(end).alias("p"), F.lit(-1).alias("d")))).alias("e")).select(key, "e.p", "e.d")
    summed = events.groupBy(key, "p").agg(F.sum("d").alias("d"))
    order = Window.partitionBy(key).orderBy("p")
    swept = summed.select(key, F.col("p").alias("from_pos"), F.lead("p").over(order).alias("to_pos"), F.sum("d").over(order).alias("depth"))
    return swept.where("to_pos is not null")


def mean_depth(intervals: DataFrame, lengths: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """``key, coverage``: mean depth over all positions, 0 where nothing lies."""
    covered = intervals.where(F.col(start) < F.col(end)).groupBy(key).agg(F.sum(F.col(end) - F.col(start)).alias("_s"))
    return lengths.join(covered, key, "left").select(key, (F.coalesce("_s", F.lit(0)) / F.col("length")).alias("coverage"))


def inner_depth(intervals: DataFrame, lengths: DataFrame, key: str, start: str, end: str, margin: int = 75, shortest: int = 160) -> DataFrame:
    """``key, coverage``: depth summed over the positions ``margin`` away from either end, over the whole length, as an integer.

    Sequences shorter than ``shortest`` have coverage 1; positions nothing covers count 0.
    """
    good = intervals.where(F.col(key).isNotNull() & (F.col(start) < F.col(end))).select(key, F.col(start).alias("_s"), F.col(end).alias("_e"))
    inside = F.greatest(F.least("_e", F.col("length") - margin) - F.greatest("_s", F.lit(margin)), F.lit(0))
    summed = lengths.join(good, key, "left").groupBy(key, "length").agg(F.sum(inside).alias("_n"))
    return summed.select(key, F.when(F.col("length") < shortest, F.lit(1)).otherwise(F.floor(F.coalesce("_n", F.lit(0)) / F.col("length"))).cast("long").alias("coverage"))


def tenth(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``key, tenth``: of the n values in order the one at ``floor(n / 10)``; nulls don't count.

    Equal values are counted together before they are put in order.
    """
    each = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_m"))
    order = Window.partitionBy(key).orderBy(value)
    run = each.withColumn("_to", F.sum("_m").over(order)).withColumn("_all", F.sum("_m").over(Window.partitionBy(key)))
    return run.where(F.col("_to") > F.floor(F.col("_all") / 10)).groupBy(key).agg(F.min(value).alias("tenth"))


def end_runs(runs: DataFrame, last_a: str, last_b: str) -> DataFrame:
    """Runs of :func:`diagonal_runs` that touch an end of either sequence.

    ``last_a`` and ``last_b`` name the sequences' last positions; ``q_start`` is the
    run's least position on the second.
    """
    return runs.where((F.col("start") == 0) | (F.col("end") == F.col(last_a)) | (F.col("q_start") == 0) | (F.col("q_start") + F.col("end") - F.col("start") == F.col(last_b)))


def regions(steps: DataFrame, key: str, condition: Column) -> DataFrame:
    """Maximal stretches whose depth meets ``condition``: ``key, start, end``."""
    order = Window.partitionBy(key).orderBy("from_pos")
    kept = steps.where(condition)
    new = (F.lag("to_pos").over(order).isNull()) | (F.lag("to_pos").over(order) != F.col("from_pos"))
    marked = kept.withColumn("_new", new.cast("int")).withColumn("_i", F.sum("_new").over(order))
    return marked.groupBy(key, "_i").agg(F.min("from_pos").alias("start"), F.max("to_pos").alias("end")).drop("_i")


def trim_ends(intervals: DataFrame, lengths: DataFrame, key: str, start: str, end: str, ignore: int = 50) -> DataFrame:
    """First and last covered position of each sequence; ends nearer than ``ignore`` stay whole."""
    span = intervals.groupBy(key).agg(F.min(start).alias("_a"), F.max(end).alias("_b"))
    near = lengths.join(span, key)
    left = F.when(F.col("_a") < ignore, 0).otherwise(F.col("_a"))
    right = F.when(F.col("length") - F.col("_b") < ignore, F.col("length")).otherwise(F.col("_b"))
    return near.select(key, left.alias("trim_start"), right.alias("trim_end"))


def fragments(labels: DataFrame, key: str, pos: str, label: str) -> DataFrame:
    """Runs of equal labels along a sequence: ``key, frag_start, frag_end``.

    As the source of this operator has it, a change at the very last position
    doesn't open a fragment of its own but is merged into the closing one.
    A null label is a label of its own.
    """
    order = Window.partitionBy(key).orderBy(pos)
    whole = Window.partitionBy(key)
    known = F.coalesce(F.col(label).cast("string"), F.lit(""))
    change = (known != F.lag(known).over(order)) & (F.col(pos) != F.max(pos).over(whole))
    marked = labels.select(key, F.col(pos).alias("_p"), F.coalesce(change, F.lit(False)).cast("int").alias("_c"))
    numbered = marked.withColumn("_i", F.sum("_c").over(Window.partitionBy(key).orderBy("_p")))
    return numbered.groupBy(key, "_i").agg(F.min("_p").alias("frag_start"), F.max("_p").alias("frag_end")).drop("_i")


def run_deduplicated(path: DataFrame, key: str, pos: str, item: str) -> DataFrame:
    """A path without repeats of the previous item: ``key, pos, item``; nulls are passed over."""
    order = Window.partitionBy(key).orderBy(pos)
    known = path.where(F.col(item).isNotNull())
    marked = known.withColumn("_last", F.lag(item).over(order))
    return marked.where(F.col("_last").isNull() | (F.col("_last") != F.col(item))).select(key, pos, item)


def bridging(alignments: DataFrame, parts: DataFrame, key: str = "contig") -> DataFrame:
    """Alignments that overlap a fragment: ``alignment, fragment`` (strict inequalities).

    ``alignments``: ``key, alignment, start, end``; ``parts``: ``key, fragment, f_start, f_end``.
    """
    inside = ((F.col("start") < F.col("f_start")) & (F.col("end") > F.col("f_end"))) | ((F.col("start") > F.col("f_start")) & (F.col("start") < F.col("f_end"))) | ((F.col("end") > F.col("f_start")) & (F.col("end") < F.col("f_end")))
    return alignments.join(parts, key).where(inside).select(key, "alignment", "fragment")


def bridging_pairs(hits: DataFrame, key: str = "contig") -> DataFrame:
    """How many alignments touch both of two fragments: ``key, f1, f2, n``."""
    l, r = hits.withColumnRenamed("fragment", "f1"), hits.withColumnRenamed("fragment", "f2")
    return l.join(r, [key, "alignment"]).where("f1 < f2").groupBy(key, "f1", "f2").agg(F.count("*").alias("n"))


def diagonal_runs(hits: DataFrame, key: list[str], ref: str = "ref_pos", query: str = "query_pos", step: int = 1) -> DataFrame:
    """Runs of hits on one diagonal: ``key, start, end, q_start, n``.

    ``step`` is 1 for the same strand and -1 for the reverse strand, on which the
    query position falls as the reference position grows.
    """
    d = F.col(query) - step * F.col(ref)
    order = Window.partitionBy(*key, "_d").orderBy(ref)
    rows = hits.withColumn("_d", d).withColumn("_g", F.col(ref) - F.row_number().over(order))
    return rows.groupBy(*key, "_d", "_g").agg(F.min(ref).alias("start"), F.max(ref).alias("end"), F.min(query).alias("q_start"), F.count("*").alias("n")).drop("_d", "_g")
