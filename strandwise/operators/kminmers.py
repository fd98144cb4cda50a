"""k-min-mers: runs of k consecutive minimizers, counted and looked up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seq


def kminmer_rows(mreads: DataFrame, k: int, id_col: str = "read_id", minimizers: str = "minimizers") -> DataFrame:
    """``id, i, km, is_rev``: every k-min-mer in order, normalised."""
    each = mreads.select(id_col, F.posexplode(seq.kminmers(F.col(minimizers), k)).alias("i", "raw"))
    return each.select(id_col, "i", seq.normalized(F.col("raw")).alias("km"), seq.is_reversed(F.col("raw")).alias("is_rev"))


def kminmer_counts(rows: DataFrame) -> DataFrame:
    """``km, abundance``."""
    return rows.groupBy("km").agg(F.count("*").alias("abundance"))


def solid(counts: DataFrame, least: int = 2) -> DataFrame:
    return counts.where(F.col("abundance") >= least)


def sub_kminmers(km: DataFrame, k: int) -> DataFrame:
    """``km, sub``: the two k-min-mers of ``k`` within each of ``k + 1``."""
    both = F.array(F.slice("km", 1, k), F.slice("km", 2, k))
    return km.select("km", F.explode(F.transform(both, seq.normalized)).alias("sub"))


def refined_abundance(km: DataFrame, previous: DataFrame, k_previous: int) -> DataFrame:
    """Abundance of each k-min-mer from the k before: the least of its parts, 1 where unknown."""
    parts = sub_kminmers(km, k_previous)
    known = previous.select(F.col("km").alias("sub"), "abundance")
    return parts.join(known, "sub", "left").groupBy("km").agg(F.min(F.coalesce("abundance", F.lit(1))).alias("abundance"))


def path_abundances(rows: DataFrame, counts: DataFrame, id_col: str) -> DataFrame:
    """Abundance of every k-min-mer of a sequence, 1 where it isn't counted."""
    return rows.join(counts, "km", "left").select(id_col, "i", F.coalesce("abundance", F.lit(1)).alias("abundance"))


def median_abundance(abundances: DataFrame, id_col: str) -> DataFrame:
    """Integer median of each sequence (an even count's middle pair is averaged and cut)."""
    return abundances.groupBy(id_col).agg(F.floor(F.percentile("abundance", F.lit(0.5))).alias("median"), F.max("abundance").alias("largest"))


def rescue(rows: DataFrame, solid_counts: DataFrame, most: int = 10, id_col: str = "read_id") -> DataFrame:
    """k-min-mers to rescue, with abundance 1.

    Reads whose median abundance is at most ``most``, and which aren't made of
    unsupported k-min-mers alone, contribute the k-min-mers they have once.
    """
    found = rows.join(solid_counts, "km", "left").select(id_col, "km", F.coalesce("abundance", F.lit(1)).alias("abundance"))
    good = median_abundance(found, id_col).where((F.col("median") <= most) & (F.col("largest") > 1)).select(id_col)
    missing = found.where("abundance = 1").join(good, id_col, "left_semi").select("km").distinct()
    return missing.join(solid_counts.select("km"), "km", "left_anti").select("km", F.lit(1).cast("long").alias("abundance"))


def all_parts_solid(km: DataFrame, solid_counts: DataFrame, k_previous: int) -> DataFrame:
    """Those of the k-min-mers whose parts of the k before are all solid."""
    parts = sub_kminmers(km, k_previous)
    missing = parts.join(solid_counts.select(F.col("km").alias("sub")), "sub", "left_anti").select("km")
    return km.select("km").join(missing, "km", "left_anti")


def spelled_paths(rows: DataFrame, id_col: str = "read_id") -> DataFrame:
    """Minimizer sequence of a path of k-min-mers: the first whole, of the others the last element."""
    whole = F.when(F.col("is_rev"), F.reverse("km")).otherwise(F.col("km"))
    piece = F.struct("i", F.when(F.col("i") == 0, whole).otherwise(F.slice(whole, -1, 1)).alias("p"))
    walked = rows.groupBy(id_col).agg(F.array_sort(F.collect_list(piece)).alias("w"))
    return walked.select(id_col, F.flatten(F.transform("w", lambda x: x["p"])).alias("minimizers"))
