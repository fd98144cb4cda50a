"""FASTA and FASTQ, plain or gzip: a scan and a sink."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import materialize

SCHEMA = "file_no int, part_no int, row_no long, header string, seq string, qual string"
#: Bytes of a plain file that one task reads.
SPLIT = 128 << 20


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def manifest(paths: list[str]) -> list[str]:
    """The paths in the order given, normalised; raises where one is missing or a folder."""
    out = []
    for p in paths:
        system, where = located(p)
        info = system.get_file_info(system.normalize_path(where))
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(p)
        if info.type == fs.FileType.Directory:
            raise IsADirectoryError(p)
        out.append(p if "://" in p else info.path)
    return out


def records(lines: Iterator[str]) -> Iterator[tuple[str, str, str | None]]:
    """Header, sequence and quality of each record; quality is null in FASTA.

    Sequences and qualities may take several lines; white space within them is
    dropped.  A quality line may begin with ``@``.
    """
    line = next(lines, None)
    while line is not None:
        line = line.rstrip("\r\n")
        if not line or line[0] not in "@>":
            line = next(lines, None)
            continue
        fastq, header, parts = line[0] == "@", line[1:], []
        line = next(lines, None)
        while line is not None and line[:1] not in (("+",) if fastq else (">", "@")):
            parts.append("".join(line.split()))
            line = next(lines, None)
        sequence = "".join(parts)
        if not fastq:
            yield header, sequence, None
            continue
        quality, line = "", next(lines, None)
        while line is not None and (len(quality) < len(sequence) or not sequence and not line.strip()):
            quality += line.rstrip("\r\n")
            line = next(lines, None)
        yield header, sequence, quality


@dataclass
class Part(InputPartition):
    """Records of a file that begin within ``start`` and ``stop`` (bytes); a whole file where ``stop`` is none."""

    file: int
    number: int
    path: str
    start: int = 0
    stop: int | None = None
    fasta: bool = False


def _opened(path: str):
    system, where = located(path)
    return system.open_input_file(where)


def _begins(lines: list[bytes], at: int, fasta: bool) -> bool:
    """Whether a record begins at ``lines[at]``; one of FASTQ has four lines."""
    if fasta:
        return lines[at][:1] == b">"
    if lines[at][:1] != b"@" or len(lines) < at + 4:
        return False
    return lines[at + 2][:1] == b"+" and len(lines[at + 1].rstrip()) == len(lines[at + 3].rstrip())


def parts_of(number: int, path: str, split: int = SPLIT) -> list[Part]:
    """Byte ranges of a plain file of FASTA, or of FASTQ in four lines a record; other files are one part."""
    if path.endswith(".gz"):
        return [Part(number, 0, path)]
    with _opened(path) as f:
        size = f.size()
        head = f.read(min(size, 1 << 20)).split(b"\n")
    whole = head if len(head) < 8 else head[:-1]
    first = next((i for i, x in enumerate(whole) if x[:1] in (b"@", b">")), None)
    fasta = first is not None and whole[first][:1] == b">"
    # Every record in sight must have four lines, or a range's first record couldn't be told.
    simple = fasta or (first is not None and all(_begins(whole, i, False) for i in range(first, len(whole) - 3, 4)))
    if size <= split or not simple:
        return [Part(number, 0, path)]
    edges = [*range(0, size, split), size]
    return [Part(number, i, path, a, z, fasta) for i, (a, z) in enumerate(zip(edges, edges[1:]))]


def lines_of(part: Part) -> Iterator[str]:
    """Text lines of the records that begin in a part."""
    if part.path.endswith(".gz"):
        with _opened(part.path) as f, gzip.open(f, "rt") as text:
            yield from text
        return
    with _opened(part.path) as f:
        if part.stop is None:
            yield from io.TextIOWrapper(io.BufferedReader(f), "utf-8", "replace")
            return
        raw = io.BufferedReader(f, 1 << 20)
        raw.seek(max(0, part.start - 1))
        at = max(0, part.start - 1)
        if part.start:
            # To the first line that begins in the part.
            at += len(raw.readline())
        ahead: list[bytes] = []
        for _ in range(4):
            ahead.append(raw.readline())
        skipping, inside = True, 0
        while ahead[0]:
            line = ahead[0]
            begins = _begins(ahead, 0, part.fasta) if not inside else False
            if begins:
                if at >= part.stop:
                    return
                skipping = False
                # The four lines of FASTQ belong together, whatever they begin with.
                inside = 0 if part.fasta else 4
            inside = max(0, inside - 1)
            if not skipping:
                yield line.decode("utf-8", "replace")
            at += len(line)
            ahead = [*ahead[1:], raw.readline()]


class FastxReader(DataSourceReader):
    def __init__(self, paths: list[str], split: int = SPLIT):
        self.paths, self.split = paths, split

    def partitions(self) -> list[InputPartition]:
        return [part for i, p in enumerate(self.paths) for part in parts_of(i, p, self.split)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        names = ["file_no", "part_no", "row_no", "header", "seq", "qual"]

        def batch(rows: list, first: int) -> pa.RecordBatch:
            n = len(rows)
            columns = [pa.array([partition.file] * n, pa.int32()), pa.array([partition.number] * n, pa.int32()), pa.array(range(first, first + n), pa.int64()), *(pa.array([r[i] for r in rows], pa.string()) for i in range(3))]
            return pa.RecordBatch.from_arrays(columns, names=names)

        rows, first, size = [], 0, 0
        for r in records(iter(lines_of(partition))):
            rows.append(r)
            size += len(r[1])
            if size > 4_000_000 or len(rows) == 10_000:
                yield batch(rows, first)
                rows, first, size = [], first + len(rows), 0
        if rows:
            yield batch(rows, first)


class FastxSource(DataSource):
    """``spark.read.format("fastx").option("paths", "a.fq.gz,b.fa")``.

    A plain file is read in byte ranges of ``split`` bytes, one a task; a gzip file,
    or FASTQ whose records take several lines, by one task.
    """

    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastxReader:  # noqa: ANN001
        given = self.options.get("paths") or self.options.get("path") or ""
        return FastxReader(manifest([p for p in given.split(",") if p]), int(self.options.get("split") or SPLIT))


def scan(spark: SparkSession, paths: list[str], most_per_file: int | None = None, split: int = SPLIT) -> DataFrame:
    """``read_id, header, seq, qual``: reads numbered over all files in order.

    Files are parsed once; the table that this writes is counted and numbered.
    ``most_per_file`` keeps the first reads of each file.
    """
    spark.dataSource.register(FastxSource)
    rows = materialize(spark.read.format("fastx").option("paths", ",".join(manifest(paths))).option("split", str(split)).load())
    counts = rows.groupBy("file_no", "part_no").agg(F.count("*").alias("n"))
    so_far = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row a part.
    before = counts.select("file_no", "part_no", so_far(Window.orderBy("file_no", "part_no")).alias("before"), so_far(Window.partitionBy("file_no").orderBy("part_no")).alias("in_file"))
    joined = rows.join(before, ["file_no", "part_no"])
    if most_per_file is not None:
        joined = joined.where(F.col("in_file") + F.col("row_no") < most_per_file)
        kept = materialize(joined.drop("before"))
        left = kept.groupBy("file_no").agg(F.count("*").alias("n")).select("file_no", so_far(Window.orderBy("file_no")).alias("before"))
        joined = kept.join(left, "file_no").withColumn("row_no", F.col("in_file") + F.col("row_no"))
    return joined.select((F.col("before") + F.col("row_no")).alias("read_id"), "header", "seq", "qual")


def fasta_lines(contigs: DataFrame, header: str = "header", seq: str = "seq") -> DataFrame:
    """One text a record: the header line and the sequence line."""
    return contigs.select(F.concat(F.lit(">"), F.col(header), F.lit("\n"), F.coalesce(F.col(seq), F.lit(""))).alias("value"))


def write_fasta(contigs: DataFrame, path: str, compression: str | None = "gzip") -> None:
    """A folder of FASTA files, one a partition."""
    fasta_lines(contigs).write.text(path, compression=compression)


def in_order(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows range-partitioned and sorted: written, the parts follow each other in this order."""
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def write_fastq(reads: DataFrame, path: str, compression: str | None = "gzip") -> None:
    """A folder of FASTQ files; missing quality becomes the lowest."""
    s = F.coalesce("seq", F.lit(""))
    q = F.coalesce("qual", F.rpad(F.lit(""), F.length(s), F.lit("!")))
    reads.select(F.concat(F.lit("@"), F.col("header"), F.lit("\n"), s, F.lit("\n+\n"), q).alias("value")).write.text(path, compression=compression)


def read_paf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The twelve fixed columns of a PAF file."""
    names = ["q_name", "q_len", "q_start", "q_end", "strand", "t_name", "t_len", "t_start", "t_end", "n_match", "align_len", "mapq"]
    kinds = ["string", "int", "int", "int", "string", "string", "int", "int", "int", "int", "int", "int"]
    f = F.split("value", "\t")
    return spark.read.text(path).where(F.size(f) >= 12).select(*[f[i].cast(t).alias(n) for i, (n, t) in enumerate(zip(names, kinds))])
