"""Sequence functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Base codes (letter bits 1 and 2), in which k-mers are compared.
CODED = ("ACTG", "0123")
#: IUPAC letters and their complements.
IUPAC = ("ACGTUNRYSWKMBDHVacgtunryswkmbdhv", "TGCAANYRSWMKVHDBtgcaanyrswmkvhdb")


def clean(s: Column) -> Column:
    """Upper case; null as empty."""
    return F.coalesce(F.upper(s), F.lit(""))


def hpc(s: Column) -> Column:
    """Homopolymer compression: every run of a letter as one letter; '' of ''."""
    return F.regexp_replace(s, r"(.)\1+", "$1")


def revcomp(s: Column) -> Column:
    """Reverse complement of A, C, G, T; other letters stay."""
    return F.reverse(F.translate(s, "ACGT", "TGCA"))


def revcomp_iupac(s: Column) -> Column:
    """Reverse complement with ambiguity codes, in either case."""
    return F.reverse(F.translate(s, *IUPAC))


def base_codes(s: Column) -> Column:
    """Base numbers A 0, C 1, T 2, G 3 as digits."""
    return F.translate(s, *CODED)


def normalized(km: Column) -> Column:
    """The smaller of a k-min-mer and its reverse."""
    return F.least(km, F.reverse(km))


def is_reversed(km: Column) -> Column:
    """Whether normalisation reverses it; palindromes count as reversed."""
    return ~(km < F.reverse(km))


def kminmers(m: Column, k: int) -> Column:
    """All runs of ``k`` consecutive minimizers."""
    n = F.size(m)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.slice(m, i, k))).otherwise(F.array().cast("array<array<bigint>>"))


def longest_overlap(a: Column, b: Column) -> Column:
    """Length of the longest suffix of ``a`` that is a prefix of ``b``."""
    n = F.least(F.size(a), F.size(b))
    fits = F.filter(F.sequence(F.lit(1), n), lambda k: F.slice(a, F.size(a) - k + 1, k) == F.slice(b, F.lit(1), k))
    return F.when(n >= 1, F.coalesce(F.array_max(fits), F.lit(0))).otherwise(F.lit(0))


def longest_border(a: Column) -> Column:
    """Length of the longest proper prefix that is also a suffix."""
    n = F.size(a)
    fits = F.filter(F.sequence(F.lit(1), n - 1), lambda k: F.slice(a, F.lit(1), k) == F.slice(a, n - k + 1, k))
    return F.when(n >= 2, F.coalesce(F.array_max(fits), F.lit(0))).otherwise(F.lit(0))


def self_overlap_trimmed(a: Column) -> Column:
    """``a`` without all but the first element of its border; a border above half is halved."""
    n, b = F.size(a), longest_border(a)
    half = F.when(b > n / 2, F.floor(b / 2)).otherwise(b).cast("int")
    return F.when(half > 1, F.slice(a, F.lit(1), n - (half - 1))).otherwise(a)


def short_header(h: Column) -> Column:
    """A header up to its first white space."""
    return F.regexp_extract(h, r"^(\S*)", 1)


def contig_header(i: Column, length: Column, coverage: Column, circular: Column) -> Column:
    return F.format_string("ctg%d length=%d coverage=%.2f circular=%s", i, length, coverage, F.when(circular, "yes").otherwise("no"))


def extensions(q_start: Column, q_end: Column, q_len: Column, t_start: Column, t_end: Column, t_len: Column, rev: Column) -> tuple[Column, Column, Column, Column]:
    """Unaligned target ends seen from the query (5', 3'), and the overhangs both share."""
    tl5 = F.when(rev, t_len - t_end).otherwise(t_start)
    tl3 = F.when(rev, t_start).otherwise(t_len - t_end)
    return tl5, tl3, F.least(q_start, tl5), F.least(q_len - q_end, tl3)


def mappable_length(q_start: Column, q_end: Column, q_len: Column, t_start: Column, t_end: Column, t_len: Column, rev: Column) -> Column:
    """Length the alignment had if it went on to the nearer ends."""
    _, _, ext5, ext3 = extensions(q_start, q_end, q_len, t_start, t_end, t_len, rev)
    return F.greatest(q_end - q_start, t_end - t_start) + ext5 + ext3


def valid_overlap(q_start: Column, q_end: Column, q_len: Column, t_start: Column, t_end: Column, t_len: Column, rev: Column, max_hang: int = 200, fraction: float = 0.8, least: int = 500) -> Column:
    """Whether an alignment is a dovetail overlap that the query extends to the right."""
    tl5, tl3, ext5, ext3 = extensions(q_start, q_end, q_len, t_start, t_end, t_len, rev)
    span = q_end - q_start
    contained = ((q_start <= tl5) & (q_len - q_end <= tl3)) | ((q_start >= tl5) & (q_len - q_end >= tl3))
    hangs = (ext5 <= max_hang) & (ext3 <= max_hang) & (span >= (span + ext5 + ext3) * fraction)
    long = (span + ext5 + ext3 >= least) & (t_end - t_start + ext5 + ext3 >= least)
    return F.coalesce(~rev & (t_start >= q_start) & hangs & ~contained & long, F.lit(False))


def spans_overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column, tolerance: int = 0) -> Column:
    """Whether two spans have more than ``tolerance`` positions in common; false where one is unknown."""
    return F.coalesce(F.least(a_end, b_end) - F.greatest(a_start, b_start) > tolerance, F.lit(False))


def span_within(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether the first span lies in the second; false where one is unknown."""
    return F.coalesce((a_start >= b_start) & (a_end <= b_end), F.lit(False))


def maximal_mapping(q_start: Column, q_end: Column, q_len: Column, t_start: Column, t_end: Column, t_len: Column, rev: Column, tolerance: int = 300) -> Column:
    """Whether the alignment ends within ``tolerance`` of an end on both sides."""
    _, _, ext5, ext3 = extensions(q_start, q_end, q_len, t_start, t_end, t_len, rev)
    return (ext5 <= tolerance) & (ext3 <= tolerance)


def last_k(n50: float, density: float, max_k: int = 0, first_k: int = 4) -> int:
    """Largest k of the multi-k loop."""
    import numpy as np

    return max(first_k + 2, max_k if max_k > 0 else int(np.float32(n50) * np.float32(density) * np.float32(2)))


def k_to_bp(k: Column, density: float, length: int) -> Column:
    """Bases that ``k`` minimizers span on average."""
    return (1.0 / density) * (k - 1) + length
