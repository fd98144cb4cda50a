import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwise.functions import seq, stats
from strandwise.operators import minimize

CODE = {"A": 0, "C": 1, "T": 2, "G": 3}
COMPLEMENT = str.maketrans("ACGT", "TGCA")


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_goldens(spark):
    assert one(spark, seq.hpc(F.col("s")), s="AAACCGTTTA") == "ACGTA"
    assert one(spark, seq.hpc(F.col("s")), s="") == ""
    assert one(spark, seq.revcomp(F.col("s")), s="ACGTN") == "NACGT"
    assert one(spark, seq.normalized(F.col("a")), a=[3, 1, 2]) == [2, 1, 3]
    assert one(spark, seq.is_reversed(F.col("a")), a=[3, 1, 2]) and one(spark, seq.is_reversed(F.col("a")), a=[1, 2, 1])
    assert one(spark, seq.self_overlap_trimmed(F.col("a")), a=[1, 2, 9, 1, 2]) == [1, 2, 9, 1]
    assert one(spark, seq.longest_overlap(F.col("a"), F.col("b")), a=[5, 1, 2, 3], b=[2, 3, 4]) == 2
    assert one(spark, seq.contig_header(F.lit(112), F.lit(7013), F.lit(6.0), F.lit(True))) == "ctg112 length=7013 coverage=6.00 circular=yes"
    assert seq.last_k(10_000, 0.005) == 100 and seq.last_k(10, 0.005) == 6 and seq.last_k(10_000, 0.005, max_k=9) == 9


def test_n50(spark):
    r = stats.n50(spark.createDataFrame([(x,) for x in (10, 8, 5, 3, None)], "n int"), "n").first()
    assert (r["n50"], r["n50_early"]) == (8, 10)
    r = stats.n50(spark.createDataFrame([], "n int"), "n").first()
    assert (r["n50"], r["n50_early"]) == (None, None)


def murmur(value, seed=42):
    mask = (1 << 64) - 1
    rot = lambda x, r: ((x << r) | (x >> (64 - r))) & mask

    def mix(h):
        for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h = ((h ^ (h >> 33)) * c) & mask
        return h ^ (h >> 33)

    k = (rot((value * 0x87C37B91114253D5) & mask, 31) * 0x4CF5AD432745937F) & mask
    a = ((seed ^ k ^ 8) + (seed ^ 8)) & mask
    b = ((seed ^ 8) + a) & mask
    return (mix(a) + mix(b)) & mask


def selected(s, length, density):
    out = []
    for i in range(1, len(s) - length):
        w = s[i : i + length]
        if set(w) - set("ACGT"):
            continue
        value = lambda x: int("".join(str(CODE[c]) for c in x), 4)
        f, r = value(w), value(w.translate(COMPLEMENT)[::-1])
        if float(murmur(min(f, r))) < density * float(2**64 - 1):
            out.append((min(f, r), i, int(f >= r)))
    return out


SCHEMA = "read_id long, seq string, qual string, minimizers string"


def test_minimizers_against_brute_force(spark):
    rnd = random.Random(1)
    rows = [(i, "".join(rnd.choice("ACGTACGTACGTN") for _ in range(rnd.randint(0, 300))), None, "x") for i in range(40)] + [(90, None, None, None), (91, "", "", None), (92, "acgt" * 30, "I" * 120, None)]
    got = {r["read_id"]: list(zip(r["minimizers"], r["pos"], r["dir"])) for r in minimize.minimizer_reads(spark.createDataFrame(rows, SCHEMA), 9, 0.2).collect()}
    assert got == {i: selected((s or "").upper(), 9, 0.2) for i, s, *_ in rows}


def test_minimizers_mirror_on_the_other_strand(spark):
    s = "".join(np.random.default_rng(3).choice(list("ACGT"), 2000))
    rows = [(1, s, None, None), (2, s.translate(COMPLEMENT)[::-1], None, None)]
    a, b = (r["minimizers"] for r in minimize.minimizer_reads(spark.createDataFrame(rows, SCHEMA), 15, 0.1).orderBy("read_id").collect())
    assert a == b[::-1] and a


def test_compression_skipping_and_quality(spark):
    s = "AACCCGTTAGGCATTTACCGGGATCAAAGTCCCTTGA" * 8
    df = spark.createDataFrame([(1, s, "I" * len(s), None), (2, s, "#" * len(s), None)], SCHEMA)
    squeezed = "".join(c for c, p in zip(s, " " + s) if c != p)
    got = minimize.minimizer_reads(df, 7, 0.3, compress=True, min_quality=10).orderBy("read_id").collect()
    assert list(zip(got[0]["minimizers"], got[0]["pos"], got[0]["dir"])) == selected(squeezed, 7, 0.3)
    assert got[1]["minimizers"] == [] and got[0]["qual"] == [40] * len(got[0]["pos"])
    banned = got[0]["minimizers"][0]
    again = minimize.minimizer_reads(df, 7, 0.3, compress=True, repetitive=[banned]).first()["minimizers"]
    assert again == [m for m in got[0]["minimizers"] if m != banned]
    low = minimize.lower_density(minimize.minimizer_reads(df, 7, 0.3), 0.1).first()
    assert list(zip(low["minimizers"], low["pos"], low["dir"])) == selected(s, 7, 0.1)


def test_words(spark):
    df = spark.createDataFrame([(1, "ACGTNACGGT", None, None), (2, None, None, None)], SCHEMA)
    words = minimize.kmer_values(df, 4, canonical=False).select("read_id", F.explode("words").alias("w")).select(minimize.spelled(F.col("w"), 4).alias("w"))
    assert sorted(r[0] for r in words.collect()) == ["ACGG", "ACGT", "CGGT"]
    scores = {r[0]: r[1] for r in minimize.sequence_complexity(spark.createDataFrame([(1, "A" * 66, None, None), (2, "ACG", None, None), (3, None, None, None)], SCHEMA)).collect()}
    assert scores[1] == pytest.approx(64 * 63 / 2 / 61) and scores[2] is None and scores[3] is None
