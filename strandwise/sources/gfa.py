"""GFA: segments and links as lines and as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _sign(rev: str) -> Column:
    return F.when(F.col(rev), "-").otherwise("+")


def segment_lines(segments: DataFrame) -> DataFrame:
    """``line`` of segments ``name, seq (null or text), length, depth``."""
    return segments.select(F.concat_ws("\t", F.lit("S"), "name", F.coalesce("seq", F.lit("*")), F.concat(F.lit("LN:i:"), F.col("length").cast("string")), F.concat(F.lit("dp:i:"), F.col("depth").cast("string"))).alias("line"))


def link_lines(links: DataFrame) -> DataFrame:
    """``line`` of links ``src, src_rev, dst, dst_rev, overlap``."""
    return links.select(F.concat_ws("\t", F.lit("L"), "src", _sign("src_rev"), "dst", _sign("dst_rev"), F.concat(F.col("overlap").cast("string"), F.lit("M"))).alias("line"))


def write_gfa(segments: DataFrame, links: DataFrame, path: str, compression: str | None = None) -> None:
    """A folder of GFA text; segments and links in no particular order."""
    segment_lines(segments).unionByName(link_lines(links)).write.text(path, compression=compression)


def parse_segments(lines: DataFrame) -> DataFrame:
    """``name, seq, length, depth`` of the S lines; missing tags are null, ``*`` is a null sequence."""
    f = F.split("value", "\t")
    tag = lambda t: F.regexp_extract("value", rf"\t{t}:i:(\d+)", 1)
    number = lambda t: F.when(tag(t) != "", tag(t).cast("long"))
    return lines.where(F.col("value").startswith("S\t") & (F.size(f) >= 3)).select(f[1].alias("name"), F.when(f[2] != "*", f[2]).alias("seq"), number("LN").alias("length"), number("dp").alias("depth"))


def parse_links(lines: DataFrame) -> DataFrame:
    """``src, src_rev, dst, dst_rev, overlap`` of the L lines."""
    f = F.split("value", "\t")
    return lines.where(F.col("value").startswith("L\t") & (F.size(f) >= 6)).select(f[1].alias("src"), (f[2] == "-").alias("src_rev"), f[3].alias("dst"), (f[4] == "-").alias("dst_rev"), F.regexp_extract(f[5], r"^(\d+)M", 1).cast("int").alias("overlap"))


def read_gfa(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Segments and links of a GFA file or folder."""
    lines = spark.read.text(path)
    return parse_segments(lines), parse_links(lines)
