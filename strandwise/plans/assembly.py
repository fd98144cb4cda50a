"""Whole dataflows: assemble reads, write the graph, map sequences onto it."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import seq, stats
from ..operators import align, graph, intervals, minimize, overlaps, regions
from ..operators import contigs as cleaning
from ..operators import kminmers as km
from ..session import Files, Scratch, materialize, scoped, tables_of_call
from ..sources import fastx, gfa


@dataclass(frozen=True)
class Parameters:
    """Options of an assembly; ``platform`` sets what isn't given.

    ``hifi``: homopolymer compression, no correction.  ``ont``: no compression,
    reads corrected from their overlaps.
    """

    platform: str = "hifi"
    kmer_size: int = 15
    density: float = 0.005
    density_correction: float = 0.025
    first_k: int = 4
    max_k: int = 0
    min_abundance: int = 0
    max_bubble: int = 50_000
    max_tip: int = 50_000
    min_read_quality: float = 0.0
    min_contig_length: int = 50
    min_contig_coverage: float = 1.0
    min_overlap: int = 1000
    min_identity: float = 0.96
    polish: bool = True
    least_minimizers: int = 10
    correction: bool | None = None
    compress: bool | None = None

    def __post_init__(self) -> None:
        if self.platform not in ("hifi", "ont"):
            raise ValueError("platform must be hifi or ont")
        if not 1 <= self.kmer_size <= 16:
            raise ValueError("kmer_size must be between 1 and 16")
        if self.corrects and self.density_correction < self.density:
            raise ValueError("density_correction must be at least density")

    @property
    def compresses(self) -> bool:
        return self.platform == "hifi" if self.compress is None else self.compress

    @property
    def corrects(self) -> bool:
        return self.platform == "ont" if self.correction is None else self.correction

    def minimizers_of(self, bp: int, k: int) -> int:
        """Minimizers that ``bp`` bases hold, at least those of 2.25 k-min-mers."""
        return int(max(bp * self.density, 2.25 * k))

    def longest(self, k: int) -> int:
        """Minimizers of the longest bubble or tip that goes."""
        return self.minimizers_of(min(self.max_bubble, self.max_tip), k)


def read_anchors(mreads: DataFrame, banned_fraction: float = minimize.REPETITIVE) -> DataFrame:
    """Pairs of neighbouring minimizers of reads, without repetitive ones, written for the joins to come."""
    kept = minimize.without_repetitive(mreads.select("read_id", "minimizers", "pos"), minimize.repetitive_minimizers(minimize.minimizer_counts(mreads), banned_fraction))
    return materialize(overlaps.pair_rows(kept))


@scoped
def find_neighbours(mreads: DataFrame, p: Parameters | None = None, most: int = 20, least: int = 3) -> DataFrame:
    """``read_id, other``: for each read those among the ``most`` best at any of its minimizers.

    Repetitive minimizers are left out first, as every read that has one would meet
    every other there.  With parameters, only alignments good enough for correction
    count: their length, identity and overhangs follow from the chain.
    """
    pairs = read_anchors(mreads)
    found = materialize(align.chained(overlaps.anchors(pairs, pairs, exclude_self=True), least))
    if p is not None:
        sizes = mreads.select(F.col("read_id").alias("query"), F.col("read_len").alias("query_len"), F.size("minimizers").alias("query_n"))
        good = align.good_alignments(align.chain_alignments(found, sizes, p.kmer_size), p.min_overlap, p.min_identity)
        found = found.join(good.select("query", "reference", "same_strand"), ["query", "reference", "same_strand"], "left_semi")
    places = F.sequence(F.array_min("q_at"), F.array_max("q_at"))
    spread = found.select(F.col("query").alias("read_id"), F.col("reference").alias("other"), "score", F.explode(places).alias("at"))
    return overlaps.top_per_position(spread, ["read_id", "at"], "score", "other", most).select("read_id", "other").distinct()


def selected_reads(reads: DataFrame, p: Parameters) -> DataFrame:
    """Minimizer reads before correction: ``read_id, minimizers, pos, qual, read_len``.

    Low-complexity reads (mean score above 5) are left out, as are reads of fewer
    than ``least_minimizers`` at the assembly's density; where nothing is corrected,
    palindromes are purged up to the last k that the reads' lengths give.
    """
    density = p.density_correction if p.corrects else p.density
    low = minimize.sequence_complexity(reads).where("mean_score > 5").select("read_id")
    mreads = minimize.minimizer_reads(reads, p.kmer_size, density, p.compresses, None, p.min_read_quality).join(low, "read_id", "left_anti")
    if p.corrects:
        thin = minimize.lower_density(mreads.select("read_id", "minimizers"), p.density).where(F.size("minimizers") < p.least_minimizers).select("read_id")
        return mreads.join(thin, "read_id", "left_anti").select("read_id", "minimizers", "pos", "qual", "read_len")
    purged = align.purged_reads(mreads.where(F.size("minimizers") >= p.least_minimizers), p.first_k, k_limit(reads, replace(p, max_k=0)))
    return purged


@scoped
def prepared_reads(reads: DataFrame, p: Parameters) -> DataFrame:
    """Minimizer reads ready for the graph: ``read_id, minimizers``."""
    mreads = materialize(selected_reads(reads, p))
    if not p.corrects:
        return mreads.select("read_id", "minimizers")
    fixed = align.corrected_reads(mreads, find_neighbours(mreads, p), p.first_k, k_limit(reads, p))
    return materialize(minimize.lower_density(fixed, p.density).where(F.size("minimizers") >= p.first_k))


def k_limit(reads: DataFrame, p: Parameters) -> int:
    n50 = stats.n50(reads.select(F.length("seq").alias("n")), "n").first()["n50_early"] or 0
    return seq.last_k(n50, p.density, p.max_k, p.first_k)


def counted(sequences: DataFrame, k: int, p: Parameters, previous: DataFrame | None = None) -> DataFrame:
    """Solid k-min-mers of a pass, with rescue where no least abundance is asked for.

    From the second pass on the abundance is that of the k-min-mers before, so that
    what earlier passes settled isn't counted anew: every k-min-mer of reads and
    contigs is solid whose parts both are, however often it occurs itself.
    """
    rows = km.kminmer_rows(sequences, k)
    if previous is not None:
        return km.refined_abundance(rows.select("km").distinct(), previous, k - 1).where("abundance > 1")
    rows = materialize(rows)
    solid = materialize(km.solid(km.kminmer_counts(rows), max(2, p.min_abundance)))
    return solid.unionByName(km.rescue(rows, solid)) if p.min_abundance <= 1 else solid


def refined(solid: DataFrame, contigs: DataFrame, k: int) -> DataFrame:
    """k-min-mer abundances with those of the contigs written back.

    A contig's k-min-mers take its abundance rounded up, 2 at least where it is
    longer than one k-min-mer; an abundance of 1 becomes 0.  In the others nothing
    changes.
    """
    ab = F.ceil("abundance").cast("long")
    parts = contigs.select(F.when(F.size("minimizers") > k, F.greatest(ab, F.lit(2))).otherwise(ab).alias("a"), F.explode(seq.kminmers(F.col("minimizers"), k)).alias("raw"))
    best = parts.select(seq.normalized(F.col("raw")).alias("km"), "a").groupBy("km").agg(F.max("a").alias("a"))
    # A contig seen once makes its k-min-mers unknown again.
    found = F.when(F.col("a") == 1, F.lit(0).cast("long")).otherwise(F.coalesce("a", "abundance"))
    return solid.join(best, "km", "left").select("km", found.alias("abundance"))


@scoped
def one_pass(sequences: DataFrame, k: int, p: Parameters, previous: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Graph of one k: solid k-min-mers (refined), simplified unitigs, contigs."""
    return graph_pass(graph.numbered(counted(sequences, k, p, previous)), k, p)


@scoped
def graph_pass(nodes: DataFrame, k: int, p: Parameters) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As :func:`one_pass`, from the k-min-mers as nodes."""
    solid = nodes.select(F.col("minimizers").alias("km"), F.col("abundances")[0].alias("abundance"))
    found = materialize(graph.states(nodes, k - 1, p.longest(k), kinds=("graph", "contig")).withColumn("contig", F.monotonically_increasing_id()))
    contigs = found.where("kind = 'contig'").drop("kind", "abundances")
    unitigs = found.where("kind = 'graph'").select(F.col("contig").alias("node"), "minimizers", "abundances", "abundance", "circular")
    return refined(solid, contigs, k), unitigs, contigs


@dataclass(frozen=True)
class Passes:
    """What the passes of growing k leave: the last k, its graph, contigs, abundances, and the reads they were made of."""

    k: int
    unitigs: DataFrame
    contigs: DataFrame
    solid: DataFrame
    mreads: DataFrame


def read_stretches(mreads: DataFrame, rows: DataFrame, marked: DataFrame, k: int) -> DataFrame:
    """``region, minimizers``: the stretches of reads of two k-min-mers or more that all are nodes; these lie in one component.

    ``rows``: the reads' k-min-mers; ``marked``: nodes with their ``region``.
    """
    known = rows.join(marked.select(F.col("minimizers").alias("km"), "region"), "km").select("read_id", "i", "region")
    island = F.col("i") - F.row_number().over(Window.partitionBy("read_id").orderBy("i"))
    spans = known.withColumn("island", island).groupBy("read_id", "island").agg(F.min("i").alias("i"), F.count("*").cast("int").alias("n"), F.min("region").alias("region")).where("n > 1")
    return spans.join(mreads, "read_id").select("region", F.slice("minimizers", F.col("i") + 1, F.col("n") + k - 1).alias("minimizers")).distinct()


@scoped
def far_passes(nodes: DataFrame, stretches: DataFrame, last: int, p: Parameters) -> DataFrame:
    """:func:`graph.grown` of components too large for a task, by rounds over the whole table.

    Each pass counts the stretches of reads together with the contigs of the pass
    before; a pass whose graph is empty is not taken.
    """
    rows, previous, now = [], None, None
    for k in range(p.first_k, last + 1):
        made = graph.numbered(nodes.select(F.col("minimizers").alias("km"), "abundance") if k == p.first_k else counted(now.select(F.monotonically_increasing_id().alias("read_id"), "minimizers"), k, p, previous))
        solid, unitigs, contigs = graph_pass(made, k, p)
        if unitigs.isEmpty():
            break
        told = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.lit(k).alias("k"), "cutoff", "minimizers", "abundances", "abundance", "circular")  # noqa: B023, E731
        plain = unitigs.withColumn("cutoff", F.lit(0.0))
        found = contigs.withColumn("abundances", F.lit(None).cast("array<bigint>"))
        of_solid = solid.select(F.lit(0.0).alias("cutoff"), F.col("km").alias("minimizers"), F.array("abundance").alias("abundances"), F.col("abundance").cast("double").alias("abundance"), F.lit(False).alias("circular"))
        final = [told(plain, "graph"), told(found, "contig"), told(of_solid, "solid")]
        if k == p.first_k:
            rows.append(told(plain.limit(1), "first"))
        if k >= regions.SMALL_K:
            rows.append(told(found.where((F.size("minimizers") <= k) & (F.ceil("abundance") > 1)), "short"))
        previous, now = solid, stretches.select("minimizers").unionByName(contigs.select("minimizers"))
    return materialize(reduce(DataFrame.unionByName, [*rows, *final])) if rows else nodes.sparkSession.createDataFrame([], graph.GROWN)


#: Minimizers of a component (k-min-mers and stretches of reads) that one task takes through the passes; larger ones take rounds over the whole table.
GROWN = 2_000_000


@scoped
def grown(mreads: DataFrame, last: int, p: Parameters, most: int = GROWN) -> DataFrame:
    """All passes of growing k over reads ``read_id, minimizers``: rows of :func:`graph.grown`.

    Whatever is solid in a later pass has only solid parts, so nothing links what
    isn't linked in the graph of the first k: its components are dealt to tasks,
    each of which takes them through all passes.
    """
    nodes = graph.numbered(counted(mreads, p.first_k, p))
    marked = materialize(graph.node_components(nodes, p.first_k - 1, nodes.count()).select("region", "minimizers", F.col("abundances")[0].alias("abundance")))
    pieces = read_stretches(mreads, km.kminmer_rows(mreads, p.first_k), marked, p.first_k)
    scratch = Scratch(mreads.sparkSession)
    _, work, n = scratch.counted(marked.unionByName(pieces.withColumn("abundance", F.lit(None).cast("long"))))
    # At most one in ``most`` minimizers.
    weight = work.groupBy("region").agg(F.sum(F.size("minimizers")).alias("n"))
    large = [r[0] for r in weight.where(F.col("n") > most).select("region").collect()]
    near = graph.grown(work.where(~F.col("region").isin(large)) if large else work, n, p.first_k, last, p.longest)
    if large:
        far = work.where(F.col("region").isin(large))
        near = near.unionByName(far_passes(materialize(far.where("abundance is not null")), materialize(far.where("abundance is null")), last, p))
    return scratch.keep(near.withColumn("id", F.monotonically_increasing_id()))


@scoped
def multi_k(reads: DataFrame, p: Parameters, most: int | None = None, region: int = GROWN) -> Passes:
    """The passes of growing k.

    Each pass counts the reads together with the contigs of the pass before, so
    what a smaller k joined survives where reads are too short for the larger one.
    Contigs too short for the next k are set aside and come back at the end, unless
    a longer one has all but three of their k-min-mers.  A pass whose graph is empty
    ends the loop.
    """
    mreads = prepared_reads(reads, p).select("read_id", "minimizers")
    last = k_limit(reads, p) if most is None else most
    found = grown(mreads, last, p, region)
    told = found.agg(F.max(F.when(F.col("kind") == "graph", F.col("k"))).alias("k"), F.count_if(F.col("kind") == "first").alias("first")).first()
    k = told["k"] if told["first"] else 0
    of = lambda kind: found.where((F.col("kind") == kind) & (F.col("k") == k))
    columns = ["cutoff", "minimizers", "abundance", "circular"]
    unitigs = of("graph").select(F.col("id").alias("node"), "minimizers", "abundances", "abundance", "circular")
    contigs = of("contig").select(*columns, F.col("id").alias("contig"))
    solid = of("solid").select(F.col("minimizers").alias("km"), F.col("abundances")[0].alias("abundance"))
    if not k:
        return Passes(p.first_k, unitigs, contigs, solid, mreads)
    small = found.where((F.col("kind") == "short") & (F.col("k") < k)).select(*columns, (-1 - F.col("id")).alias("contig"))
    return Passes(k, unitigs, materialize(contigs.unionByName(cleaning.without_contained(small, contigs, p.first_k))), solid, mreads)


def unitig_labels(rows: DataFrame, unitigs: DataFrame, k: int, id_col: str = "read_id") -> DataFrame:
    """k-min-mers of sequences with the unitig that has them, null where none has: ``id, i, unitig``."""
    parts = unitigs.select(F.col("node").alias("unitig"), F.explode(seq.kminmers(F.col("minimizers"), k)).alias("raw"))
    owner = parts.groupBy(seq.normalized(F.col("raw")).alias("km")).agg(F.min("unitig").alias("unitig"))
    return rows.join(owner, "km", "left").select(id_col, "i", "unitig")


def placed_minimizers(reads: DataFrame, p: Parameters) -> DataFrame:
    """Minimizers of reads with their letters' places: ``read_id, minimizers, start, stop``."""
    m = minimize.minimizer_reads(reads, p.kmer_size, p.density, p.compresses).select("read_id", "minimizers", "pos")
    if not p.compresses:
        return m.select("read_id", "minimizers", F.col("pos").alias("start"), F.transform("pos", lambda x: x + p.kmer_size).alias("stop"))
    # Places in the compressed read, translated to those in the read itself.
    joined = m.join(minimize.run_positions(reads), "read_id")
    return joined.select("read_id", "minimizers", F.transform("pos", lambda x: F.element_at("positions", x + 1)).alias("start"), F.transform("pos", lambda x: F.element_at("positions", x + p.kmer_size + 1)).alias("stop"))


@scoped
def broken_contigs(contigs: DataFrame, unitigs: DataFrame, solid: DataFrame, mreads: DataFrame, k: int, p: Parameters) -> DataFrame:
    """Contigs ``contig, minimizers, abundance, circular`` cut where repeats aren't bridged by a read.

    A contig's k-min-mers fall into fragments of one unitig each; the mean abundance
    of a fragment is its coverage, and reads laid along the contig bridge fragments.
    """
    scratch = Scratch(contigs.sparkSession)
    rows = scratch.keep(km.kminmer_rows(contigs, k, "contig"))
    parts = scratch.keep(intervals.fragments(unitig_labels(rows, unitigs, k, "contig"), "contig", "i", "unitig"))
    depth = km.path_abundances(rows, solid, "contig").withColumnRenamed("abundance", "depth")
    # A contig's fragments don't overlap, so each k-min-mer meets one of them.
    numbered = parts.withColumn("fragment", F.row_number().over(Window.partitionBy("contig").orderBy("frag_start")) - 1)
    covered = depth.join(numbered, "contig").where(F.col("i").between(F.col("frag_start"), F.col("frag_end")))
    measured = scratch.keep(covered.groupBy("contig", "fragment", F.col("frag_start").alias("f_start"), F.col("frag_end").alias("f_end")).agg(F.avg("depth").alias("coverage")))
    paths = cleaning.read_paths(contigs, mreads)
    lying = paths.select(F.col("reference").alias("contig"), F.col("query").alias("alignment"), F.array_min("r_at").alias("start"), F.array_max("r_at").alias("end"))
    bridges = intervals.bridging_pairs(intervals.bridging(lying, measured.select("contig", "fragment", "f_start", "f_end")))
    pieces = scratch.keep(cleaning.break_unbridged(measured, bridges, p.minimizers_of(10_000, 1)))
    several = F.count("*").over(Window.partitionBy("contig")) > 1
    cut_ = contigs.join(pieces.withColumn("several", several), "contig", "left")
    text = F.when(F.col("start").isNull() | ~F.col("several"), F.col("minimizers")).otherwise(F.slice("minimizers", F.col("start") + 1, F.col("end") - F.col("start") + k))
    return scratch.keep(cut_.select(F.monotonically_increasing_id().alias("contig"), text.alias("minimizers"), "abundance", (F.col("circular") & ~F.coalesce("several", F.lit(False))).alias("circular")))


@scoped
def cleaned_contigs(contigs: DataFrame, unitigs: DataFrame, solid: DataFrame, mreads: DataFrame, k: int, p: Parameters) -> DataFrame:
    """Contigs in minimizer space without overlapping ends, broken at unbridged repeats."""
    told = materialize(contigs.select("contig", "minimizers", "abundance", "circular"))
    trimmed = cleaning.trim_overlaps(told.select("contig", "minimizers"), p.first_k)
    return broken_contigs(trimmed.join(told.drop("minimizers"), "contig"), unitigs, solid, mreads, k, p)


@scoped
def base_contigs(contigs: DataFrame, reads: DataFrame, p: Parameters) -> DataFrame:
    """Contigs as bases: ``contig, seq, coverage, circular``.

    Suspect reads are left out of the layout, whose result is polished twice; then
    repetitive and low-complexity contigs go, ends that a better covered contig has
    are cut, and ends no read covers.
    """
    scratch = Scratch(reads.sparkSession)
    plain = scratch.keep(reads.select(F.col("read_id").cast("long").alias("read_id"), F.upper("seq").alias("seq"), "qual").where("seq is not null and seq <> ''"))
    as_id = lambda rows, name: rows.select(F.col(name).alias("id"), "seq")
    density = max(p.density, p.density_correction)
    among = scratch.keep(cleaning.mapped(as_id(plain, "read_id"), as_id(plain, "read_id"), p.kmer_size, density, itself=True))
    lying = among.select(F.col("reference").alias("read_id"), F.col("r_start").alias("start"), (F.col("r_end") + p.kmer_size).alias("end"))
    bad = cleaning.suspect_reads(lying, plain.select("read_id", F.length("seq").alias("length")), low=0)
    good = scratch.keep(plain.join(bad, "read_id", "left_anti"))
    text = scratch.keep(cleaning.laid_out(contigs, scratch.keep(placed_minimizers(good, p)), good))
    if p.polish:
        text = cleaning.polished(text, good, p.kmer_size, density)
    told = contigs.select("contig", F.col("abundance").cast("double").alias("coverage"), "circular")
    now = scratch.keep(text.join(told, "contig").where("seq <> ''"))
    now = scratch.keep(cleaning.without_low_complexity(cleaning.without_repetitive(now, p.kmer_size)))
    twins = scratch.keep(cleaning.mapped(as_id(now, "contig"), as_id(now, "contig"), p.kmer_size, density, itself=True))
    matches = twins.select(F.col("query").alias("a"), F.col("reference").alias("b"), F.col("q_start").alias("a_start"), (F.col("q_end") + p.kmer_size).alias("a_end"), "identity")
    now = scratch.keep(cleaning.dereplicated(now, matches))
    # A ring has no ends.
    lines = now.where(~F.col("circular"))
    cover = scratch.keep(cleaning.mapped(as_id(good, "read_id"), as_id(lines, "contig"), p.kmer_size, density))
    whole = cleaning.ends_without_cover(lines, cover, p.kmer_size).unionByName(now.where("circular"))
    return whole.select("contig", "seq", "coverage", "circular")


def assemble(reads: DataFrame, p: Parameters, most_k: int | None = None) -> DataFrame:
    """Contigs of ``reads`` (``read_id, seq, qual``): ``contig, header, seq, length, coverage, circular``.

    Contigs of small coverage or length are dropped: coverage at most
    ``min_contig_coverage``, length below ``min_contig_length``, or shorter than
    7,500 bases with coverage below 4.  Contigs are numbered by length.
    """
    return finished(reads, multi_k(reads, p, most_k), p)


@scoped
def finished(reads: DataFrame, passes: Passes, p: Parameters) -> DataFrame:
    """The contigs of the passes, cleaned, as bases, filtered and numbered."""
    clean = cleaned_contigs(passes.contigs, passes.unitigs, passes.solid, passes.mreads, passes.k, p)
    whole = base_contigs(clean, reads, p).withColumn("length", F.length("seq"))
    bad = (F.col("coverage") <= p.min_contig_coverage) | (F.col("length") < p.min_contig_length) | ((F.col("length") < 7500) & (F.col("coverage") < 4))
    numbered = graph.ordered_ids(whole.where(~bad).withColumn("shorter", -F.col("length")).drop("contig"), ["shorter", "seq"], "contig")
    return numbered.select("contig", seq.contig_header(F.col("contig"), F.col("length"), F.col("coverage"), F.col("circular")).alias("header"), "seq", "length", "coverage", "circular")


@scoped
def unitig_sequences(unitigs: DataFrame, reads: DataFrame, p: Parameters) -> DataFrame:
    """Unitigs ``node, minimizers`` as bases, where reads lie on them: ``node, seq``."""
    scratch = Scratch(reads.sparkSession)
    as_contigs = scratch.keep(unitigs.select(F.col("node").alias("contig"), "minimizers", F.lit(False).alias("circular")))
    return scratch.keep(cleaning.laid_out(as_contigs, scratch.keep(placed_minimizers(reads, p)), reads)).select(F.col("contig").alias("node"), "seq")


def graph_tables(unitigs: DataFrame, k: int, p: Parameters, sequences: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Segments and links of a unitig graph, ready for the GFA sink.

    With ``sequences`` (``node, seq``) lengths are those of the bases, and a link's
    overlap is what the source has from its last k - 1 minimizers on, by their places
    in its sequence.  Where these aren't known the mean distance of minimizers
    stands for them.
    """
    names = unitigs.withColumn("name", F.concat(F.lit("utg"), F.col("node").cast("string")))
    typical = lambda n: seq.k_to_bp(n, p.density, p.kmer_size).cast("long")
    bases = sequences if sequences is not None else unitigs.select("node", F.lit(None).cast("string").alias("seq"))
    told = names.join(bases, "node", "left")
    segments = told.select("name", "seq", F.coalesce(F.length("seq").cast("long"), typical(F.size("minimizers"))).alias("length"), F.round("abundance").cast("long").alias("depth"))
    links = graph.oriented_edges(names.select(F.col("name").alias("node"), "minimizers"), k - 1)
    if sequences is None:
        return segments, links.withColumn("overlap", typical(F.lit(k - 1)))
    # A sequence begins and ends with a minimizer, which extraction leaves out as its first and last word.
    places = placed_minimizers(bases.where("seq is not null").select(F.col("node").alias("read_id"), "seq", F.lit(None).cast("string").alias("qual")), p)
    known = names.join(places.select(F.col("read_id").alias("node"), F.col("minimizers").alias("inner"), "start", "stop"), "node").join(bases, "node")
    exact = F.col("inner") == F.slice("minimizers", F.lit(2), F.greatest(F.size("minimizers") - 2, F.lit(0)))
    n = F.size("minimizers")
    ends = known.where(exact & (n > k - 1)).select(F.col("name").alias("src"), (F.length("seq") - F.element_at("start", n - k + 1)).alias("right"), F.element_at("stop", F.lit(k - 2)).alias("left"))
    joined = links.join(ends, "src", "left")
    return segments, joined.select("src", "src_rev", "dst", "dst_rev", F.coalesce(F.when(F.col("src_rev"), F.col("left")).otherwise(F.col("right")).cast("long"), typical(F.lit(k - 1))).alias("overlap"))


class Assembly:
    """The ``asm`` command's folder: stages, each a table with a marker, and what they were made from.

    A stage is found again only for the same parameters and input files (path, size,
    time of change); anything else is another assembly and is made anew.
    """

    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.out, self.files = spark, out.rstrip("/"), Files(spark)

    def _json(self, name: str) -> dict:
        path = f"{self.out}/{name}.json"
        return json.loads(self.files.read(path)) if self.files.exists(path) else {}

    def begin(self, paths: list[str], p: Parameters, most_k: int | None) -> bool:
        """Whether earlier stages may be used; else they are deleted."""
        told = {"parameters": asdict(p), "most_k": most_k, "inputs": [list(self.files.describe(x)) for x in fastx.manifest(paths)]}
        if self._json("parameters") == told:
            return True
        for stage in ("stages", "contigs.fasta", "statistics.json"):
            self.files.delete(f"{self.out}/{stage}")
        self.files.write(f"{self.out}/parameters.json", json.dumps(told))
        return False

    def stage(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.out}/stages/{name}"
        if not self.files.exists(f"{path}/_SUCCESS"):
            with tables_of_call(self.spark):
                make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def parameters(self) -> Parameters:
        told = self._json("parameters")
        if not told:
            raise FileNotFoundError(f"{self.out} holds no assembly")
        return Parameters(**told["parameters"])

    def reads(self, paths: list[str]) -> DataFrame:
        return self.stage("reads", lambda: fastx.scan(self.spark, paths))

    def passes(self, make: Callable[[], Passes] | None = None) -> Passes:
        """The graph tables: made and written once, afterwards read."""
        last = f"{self.out}/stages/last_k.json"
        if not self.files.exists(last):
            if make is None:
                raise FileNotFoundError(f"{self.out} holds no finished passes")
            with tables_of_call(self.spark):
                made = make()
                for name in PASS_TABLES:
                    getattr(made, name).write.mode("overwrite").parquet(f"{self.out}/stages/{name}")
            self.files.write(last, json.dumps({"k": made.k}))
        k = json.loads(self.files.read(last))["k"]
        return Passes(k, *[self.spark.read.parquet(f"{self.out}/stages/{name}") for name in PASS_TABLES])


PASS_TABLES = ("unitigs", "contigs", "solid", "mreads")


def run_assembly(spark: SparkSession, paths: list[str], out: str, p: Parameters, most_k: int | None = None, with_graph: bool = False) -> dict:
    """The ``asm`` command: reads from FASTA/FASTQ files to contigs in ``out``; returns the statistics.

    Every stage (reads, passes, contigs) is written once; a run that was broken off
    goes on after the last finished one.
    """
    a = Assembly(spark, out)
    a.begin(paths, p, most_k)
    reads = a.reads(paths)
    passes = a.passes(lambda: multi_k(reads, p, most_k))
    contigs = a.stage("finished", lambda: finished(reads, passes, p))
    if not a.files.exists(f"{out}/contigs.fasta/_SUCCESS"):
        fastx.fasta_lines(fastx.in_order(contigs, ["contig"])).write.mode("overwrite").text(f"{out}/contigs.fasta", compression="gzip")
    if with_graph:
        write_graph(a, f"{out}/graph_k{passes.k}.gfa")
    if not a.files.exists(f"{out}/statistics.json"):
        found = stats.length_stats(contigs, "length", 1_000_000, F.col("circular")).first().asDict() | stats.n50(contigs, "length").first().asDict()
        a.files.write(f"{out}/statistics.json", json.dumps(found))
    return a._json("statistics")


def write_graph(a: Assembly, path: str, bare: bool = False) -> None:
    """The saved assembly's graph as GFA, with sequences unless ``bare``."""
    p, passes = a.parameters(), a.passes()
    sequences = None if bare else unitig_sequences(passes.unitigs, a.spark.read.parquet(f"{a.out}/stages/reads"), p)
    gfa.write_gfa(*graph_tables(passes.unitigs, passes.k, p, sequences), path)


def contig_paths(a: Assembly) -> DataFrame:
    """The saved contigs as paths of unitigs: ``contig, i, unitig``."""
    passes = a.passes()
    rows = km.kminmer_rows(passes.contigs, passes.k, "contig")
    return intervals.run_deduplicated(unitig_labels(rows, passes.unitigs, passes.k, "contig"), "contig", "i", "unitig")


def graph_places(sequences: DataFrame, unitigs: DataFrame, k: int, p: Parameters) -> DataFrame:
    """Where sequences (``read_id, seq, qual``) lie on a graph: ``read_id, i, unitig``, null where they don't."""
    rows = km.kminmer_rows(minimize.minimizer_reads(sequences, p.kmer_size, p.density, p.compresses), k)
    return unitig_labels(rows, unitigs, k)


def map_to_graph(places: DataFrame) -> DataFrame:
    """Paths of sequences on a graph: ``read_id, i, unitig``, runs as one."""
    return intervals.run_deduplicated(places, "read_id", "i", "unitig")


def colours(places: DataFrame) -> DataFrame:
    """How far along the mapped sequences each unitig lies: ``unitig, read_id, position`` (0 to 1, its first place)."""
    known = places.where("unitig is not null")
    first = known.groupBy("unitig", "read_id").agg(F.min("i").alias("at"))
    size = known.groupBy("read_id").agg(F.max("i").alias("last"))
    return first.join(size, "read_id").select("unitig", "read_id", (F.col("at") / F.greatest("last", F.lit(1))).alias("position"))


def mapped_subgraph(path: DataFrame, unitigs: DataFrame, k: int, p: Parameters, reach: int = 10_000) -> DataFrame:
    """Unitigs that a mapped path has, and those near them of similar abundance: rows of ``unitigs``."""
    edges = graph.oriented_edges(unitigs, k - 1)
    near = graph.abundant_neighbourhood(unitigs, edges, path.select(F.col("unitig").alias("node")), p.minimizers_of(reach, 1), k - 1)
    return unitigs.join(near.select("node").distinct(), "node", "left_semi")
