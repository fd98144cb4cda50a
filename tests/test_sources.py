import gzip
import random

import pytest

from strandwise.plans import assembly
from strandwise.sources import fastx, gfa
from strandwise.streaming import counts


def test_fastx_round_trip(spark, tmp_path):
    a, b = tmp_path / "a.fq.gz", tmp_path / "b.fa"
    with gzip.open(a, "wt") as f:
        f.write("@r1 first\nACGT\n+\n@III\n\n@r2\nAC\nGT\n+r2\nII\nII\n@r3\n\n+\n\n@r4\nA\n+\n!\n")
    b.write_text(">x comment\nACGT\nTTTT\n>empty\n>y\nA\n")
    rows = fastx.scan(spark, [str(a), str(b)]).orderBy("read_id").collect()
    assert [tuple(r) for r in rows] == [
        (0, "r1 first", "ACGT", "@III"), (1, "r2", "ACGT", "IIII"), (2, "r3", "", ""), (3, "r4", "A", "!"),
        (4, "x comment", "ACGTTTTT", None), (5, "empty", "", None), (6, "y", "A", None),
    ]
    assert fastx.scan(spark, [str(a), str(b)], most_per_file=1).count() == 2
    fastx.write_fastq(fastx.scan(spark, [str(a)]), str(tmp_path / "out"), None)
    again = fastx.scan(spark, sorted(str(p) for p in (tmp_path / "out").glob("part-*")))
    assert sorted(tuple(r)[1:] for r in again.collect()) == sorted(tuple(r)[1:] for r in rows[:4])
    with pytest.raises(FileNotFoundError):
        fastx.manifest([str(tmp_path / "none")])
    with pytest.raises(IsADirectoryError):
        fastx.manifest([str(tmp_path)])


@pytest.mark.parametrize("kind", ["fastq", "fasta", "wrapped"])
def test_plain_files_are_read_in_ranges(spark, tmp_path, kind):
    rnd = random.Random(7)
    want, lines = [], []
    for i in range(60):
        s = "".join(rnd.choice("ACGT") for _ in range(rnd.randint(0, 50)))
        # Qualities that look like headers.
        q = "".join(rnd.choice("@+>I!") for _ in s)
        want.append((i, f"r{i} x", s, None if kind == "fasta" else q))
        half = len(s) // 2
        lines.append({"fastq": f"@r{i} x\n{s}\n+\n{q}\n", "fasta": f">r{i} x\n{s[:half]}\n{s[half:]}\n", "wrapped": f"@r{i} x\n{s[:half]}\n{s[half:]}\n+\n{q}\n"}[kind])
    path = tmp_path / f"x.{kind}"
    path.write_text("".join(lines))
    for split in (1 << 20, 97, 400):
        assert len(fastx.parts_of(0, str(path), split)) == (1 if kind == "wrapped" or split == 1 << 20 else -(-path.stat().st_size // split))
        rows = fastx.scan(spark, [str(path)], split=split).orderBy("read_id").collect()
        assert [tuple(r) for r in rows] == want
    assert [r["read_id"] for r in fastx.scan(spark, [str(path), str(path)], 3, 97).orderBy("read_id").collect()] == list(range(6))


def test_gfa_round_trip(spark, tmp_path):
    s = spark.createDataFrame([("u1", None, 10, 2), ("u2", "ACGT", 4, 7)], "name string, seq string, length long, depth long")
    links = spark.createDataFrame([("u1", False, "u2", True, 3), ("u2", False, "u1", True, 3)], "src string, src_rev boolean, dst string, dst_rev boolean, overlap int")
    gfa.write_gfa(s, links, str(tmp_path / "g"))
    back_s, back_l = gfa.read_gfa(spark, str(tmp_path / "g"))
    assert sorted(back_s.collect()) == sorted(s.collect()) and sorted(back_l.collect()) == sorted(links.collect())


def test_paf(spark, tmp_path):
    (tmp_path / "x.paf").write_text("q\t100\t1\t90\t+\tt\t200\t5\t95\t80\t90\t60\ttp:A:P\nbroken\n")
    assert [tuple(r) for r in fastx.read_paf(spark, str(tmp_path / "x.paf")).collect()] == [("q", 100, 1, 90, "+", "t", 200, 5, 95, 80, 90, 60)]


def test_command_writes_contigs_once(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(9)
    genome = "".join(rng.choice(list("ACGT"), 2500))
    (tmp_path / "r.fa").write_text("".join(f">r{i}\n{genome[a:a + 800]}\n" for i, a in enumerate(rng.integers(0, 1700, 40))))
    p = assembly.Parameters(density=0.06, compress=False, min_contig_coverage=0)
    out = str(tmp_path / "out")
    first = assembly.run_assembly(spark, [str(tmp_path / "r.fa")], out, p, most_k=4)
    assert first["n"] == 1 and first["size"] > 2000
    # Nothing is made again for the same inputs, and all of it for others.
    made = sorted(p_.stat().st_mtime_ns for p_ in (tmp_path / "out").rglob("part-*"))
    assert assembly.run_assembly(spark, [str(tmp_path / "r.fa")], out, p, most_k=4, with_graph=True) == first
    assert set(made) <= {p_.stat().st_mtime_ns for p_ in (tmp_path / "out").rglob("part-*")}
    saved = assembly.Assembly(spark, out)
    assert saved.parameters() == p and {r["unitig"] for r in assembly.contig_paths(saved).collect()} <= {r["node"] for r in saved.passes().unitigs.collect()}
    segments, links = gfa.read_gfa(spark, f"{out}/graph_k4.gfa")
    bases = [r["seq"] for r in segments.collect()]
    flip = lambda s: s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    assert bases and all(s in genome or flip(s) in genome for s in bases if s)
    places = assembly.graph_places(spark.createDataFrame([(5, genome, None)], "read_id long, seq string, qual string"), saved.passes().unitigs, 4, p)
    path = assembly.map_to_graph(places)
    assert all(0 <= r["position"] < 0.2 for r in assembly.colours(places).collect()) and assembly.mapped_subgraph(path, saved.passes().unitigs, 4, p).count() >= 1
    (tmp_path / "none.fa").write_text(">r\nACGT\n")
    assert assembly.run_assembly(spark, [str(tmp_path / "none.fa")], out, p, most_k=4)["n"] == 0
    with pytest.raises(FileNotFoundError):
        assembly.run_assembly(spark, [str(tmp_path / "missing.fa")], out, p)
    with pytest.raises(ValueError):
        assembly.Parameters(kmer_size=17)
    with pytest.raises(ValueError):
        assembly.Parameters(platform="other")


def test_streaming_counts_equal_the_batch(spark, tmp_path):
    from strandwise.operators import kminmers as km
    from strandwise.operators import minimize

    rows = [(i, "ACGTTGCAAGGCTTAACCGTATGCCGATAGGCTA" * 5, None) for i in range(6)]
    reads = spark.createDataFrame(rows, "read_id long, seq string, qual string")
    reads.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = counts.stream_counts(stream, 3, 9, 0.3).writeStream.outputMode("complete").format("memory").queryName("c").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    want = km.kminmer_counts(km.kminmer_rows(minimize.minimizer_reads(reads, 9, 0.3), 3))
    assert sorted(map(tuple, spark.table("c").collect())) == sorted(map(tuple, want.collect()))
