"""Cleaning and polishing of contigs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seq
from ..session import Scratch, scoped
from . import align, intervals, minimize, overlaps
from . import kminmers as km

FRAGMENT_PATHS = "contig long, start int, end int"


def repeat_level(words: np.ndarray) -> int:
    """-1 if nine tenths of the words occur again, the largest count if two fifths do, else 0."""
    if not len(words):
        return 0
    _, inverse, counts = np.unique(words, return_inverse=True, return_counts=True)
    share = (counts[inverse] > 1).mean()
    return -1 if share > 0.9 else int(counts.max()) if share > 0.4 else 0


def _unrepeated(length: int, most: int, shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            levels, ends = [], []
            for words in b.column(1):
                w = words.values.to_numpy() if words.is_valid else np.zeros(0, np.int64)
                level, end = repeat_level(w), len(w)
                while level >= most and end + length - 1 >= shortest:
                    end -= max(1, (end + length - 1) // 10)
                    level = repeat_level(w[:end])
                levels.append(level)
                ends.append(end + length - 1 if end else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(levels, pa.int32()), pa.array(ends, pa.int32())], names=["read_id", "level", "keep"])

    return run


def without_repetitive(contigs: DataFrame, length: int = 15, coverage: float = 10, most: int = 20, shortest: int = 1000) -> DataFrame:
    """Contigs ``contig, seq, coverage`` without those made of repeats, repeated ends cut.

    Contigs of level -1 (see :func:`repeat_level`) and coverage below ``coverage``
    go; while a word occurs ``most`` times or more and ``shortest`` bases remain, a
    tenth is cut off the end.
    """
    words = minimize.kmer_values(contigs.select(F.col("contig").alias("read_id"), "seq"), length)
    found = words.mapInArrow(_unrepeated(length, most, shortest), "read_id long, level int, keep int").withColumnRenamed("read_id", "contig")
    joined = contigs.join(found, "contig").where(~((F.col("level") == -1) & (F.col("coverage") < coverage)))
    return joined.withColumn("seq", F.when((F.col("keep") > 0) & (F.col("level") >= 0), F.substring("seq", F.lit(1), F.col("keep"))).otherwise(F.col("seq"))).drop("level", "keep")


def without_low_complexity(contigs: DataFrame, score: float = 8, coverage: float = 6, longest: int = 50_000) -> DataFrame:
    """Contigs without those of a window score above ``score`` that are weakly covered and short."""
    c = minimize.sequence_complexity(contigs.select(F.col("contig").alias("read_id"), "seq")).select(F.col("read_id").alias("contig"), "max_score")
    bad = (F.coalesce("max_score", F.lit(0.0)) > score) & (F.col("coverage") < coverage) & (F.length("seq") < longest)
    return contigs.join(c, "contig").where(~bad).drop("max_score")


@scoped
def trim_overlaps(contigs: DataFrame, k: int) -> DataFrame:
    """Contigs ``contig, minimizers`` with ends trimmed that a contig at least as long has.

    An end is trimmed by its run of k-min-mers on one diagonal of the other contig;
    a contig left with no more than ``k + 1`` minimizers goes.  Of equally long
    contigs the one of larger id is trimmed.  Repeated until no end overlaps.
    """
    scratch = Scratch(contigs.sparkSession)
    now = scratch.keep(contigs.select("contig", "minimizers"))
    while True:
        sized = now.select("contig", F.size("minimizers").alias("n"))
        rows = km.kminmer_rows(now, k, "contig").join(sized, "contig")
        a = rows.select(F.col("contig").alias("a"), F.col("i").alias("ref_pos"), "km", F.col("is_rev").alias("ra"), F.col("n").alias("na"))
        b = rows.select(F.col("contig").alias("b"), F.col("i").alias("query_pos"), "km", F.col("is_rev").alias("rb"), F.col("n").alias("nb"))
        hits = a.join(b, "km").where("a <> b and (nb > na or (nb = na and b < a))").withColumn("same", F.col("ra") == F.col("rb"))
        keys = ["a", "b", "na"]
        runs = intervals.diagonal_runs(hits.where("same"), keys).unionByName(intervals.diagonal_runs(hits.where("not same"), keys, step=-1))
        last = F.col("na") - k
        cuts = runs.groupBy("a").agg(F.max(F.when(F.col("start") == 0, F.col("end") + 1)).alias("left"), F.max(F.when(F.col("end") == last, F.col("na") - k + 1 - F.col("start"))).alias("right"))
        cuts = cuts.where("left is not null or right is not null").select(F.col("a").alias("contig"), F.coalesce("left", F.lit(0)).alias("left"), F.coalesce("right", F.lit(0)).alias("right"))
        _, cuts, n = scratch.counted(cuts)
        if not n:
            break
        size = F.size("minimizers")
        rest = size - F.coalesce("left", F.lit(0)) - F.coalesce("right", F.lit(0))
        now = scratch.keep(now.join(cuts, "contig", "left").where((rest > k + 1) | F.col("left").isNull()).select("contig", F.slice("minimizers", (F.coalesce("left", F.lit(0)) + 1).cast("int"), rest.cast("int")).alias("minimizers")))
    return now.withColumn("minimizers", seq.self_overlap_trimmed(F.col("minimizers")))


def without_contained(small: DataFrame, long: DataFrame, k: int, missing: int = 3) -> DataFrame:
    """Small contigs of whose k-min-mers no long one has all but ``missing`` on one diagonal."""
    a = km.kminmer_rows(small, k, "contig").select(F.col("contig").alias("a"), F.col("i").alias("ref_pos"), "km", F.col("is_rev").alias("ra"))
    b = km.kminmer_rows(long, k, "contig").select(F.col("contig").alias("b"), F.col("i").alias("query_pos"), "km", F.col("is_rev").alias("rb"))
    hits = a.join(b, "km").withColumn("same", F.col("ra") == F.col("rb"))
    best = hits.groupBy("a", "b", "same").agg(F.countDistinct("ref_pos").alias("n")).groupBy("a").agg(F.max("n").alias("n"))
    joined = small.join(best.withColumnRenamed("a", "contig"), "contig", "left")
    return joined.where(F.coalesce("n", F.lit(0)) < F.greatest(F.lit(1), F.size("minimizers") - (k - 1) - missing)).drop("n")


def fragment_paths(starts: list[int], ends: list[int], coverages: list[float], bridged: set[tuple[int, int]], least: int, factor: float = 2.0) -> list[tuple[int, int]]:
    """Pieces into which a contig falls at repeats that nothing bridges: first and last fragment of each.

    Every fragment of ``least`` length is a source.  Its path goes on, both ways, to
    the next fragment whose coverage is below ``factor`` times the source's, if that
    is adjacent or a read bridges the two.  Short paths claim their fragments first;
    the contig is split where the claims change.
    """
    n = len(starts)
    paths = []
    for source in range(n):
        if ends[source] - starts[source] + 1 < least:
            continue
        reach = [source, source]
        for side, step in ((0, -1), (1, 1)):
            at = source
            while True:
                nxt = at + step
                while 0 <= nxt < n and coverages[nxt] >= factor * coverages[source]:
                    nxt += step
                if not 0 <= nxt < n or (abs(nxt - at) > 1 and (min(at, nxt), max(at, nxt)) not in bridged):
                    break
                at = reach[side] = nxt
        paths.append((reach[1] - reach[0], reach[0], reach[1]))
    claim = [-1] * n
    for number, (_, a, b) in enumerate(sorted(set(paths))):
        for i in range(a, b + 1):
            if claim[i] < 0:
                claim[i] = number
    cuts = [0, *[i for i in range(1, n) if claim[i] != claim[i - 1]], n] if n else [0]
    return [(a, b - 1) for a, b in zip(cuts, cuts[1:])]


def break_unbridged(fragments: DataFrame, bridges: DataFrame, least: int = 10_000) -> DataFrame:
    """``contig, start, end`` of the pieces of each contig.

    ``fragments``: ``contig, fragment, f_start, f_end, coverage`` (numbered along the
    contig); ``bridges``: ``contig, f1, f2, n`` of :func:`intervals.bridging_pairs`.
    """
    f = fragments.groupBy("contig").agg(F.sort_array(F.collect_list(F.struct("fragment", "f_start", "f_end", "coverage"))).alias("f"))
    b = bridges.where("n >= 1").groupBy("contig").agg(F.collect_list(F.struct("f1", "f2")).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for contig, parts, pairs in zip(*(batch.column(i).to_pylist() for i in range(3))):
                number = {x["fragment"]: i for i, x in enumerate(parts)}
                joined = {(number[p["f1"]], number[p["f2"]]) for p in pairs or [] if p["f1"] in number and p["f2"] in number}
                s, e, c = ([x[key] for x in parts] for key in ("f_start", "f_end", "coverage"))
                out += [(contig, s[a], e[z]) for a, z in fragment_paths(s, e, c, joined, least)]
            columns = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(columns[0]), pa.int64()), *(pa.array(list(x), pa.int32()) for x in columns[1:])], names=["contig", "start", "end"])

    return f.join(b, "contig", "left").select(F.col("contig").cast("long").alias("contig"), "f", "b").mapInArrow(run, FRAGMENT_PATHS)


def suspect_reads(alignments: DataFrame, lengths: DataFrame, key: str = "read_id", low: int = 1, least: int = 200, margin: int = 200) -> DataFrame:
    """Reads with an inner stretch of ``least`` bases that at most ``low`` other reads cover: ``key``.

    ``alignments``: ``key, start, end``; ``lengths``: ``key, length``.  Stretches
    within ``margin`` of an end don't count.
    """
    whole = lengths.select(key, F.lit(0).alias("start"), F.col("length").alias("end"))
    steps = intervals.depth_steps(alignments.select(key, "start", "end").unionByName(whole), key, "start", "end")
    thin = intervals.regions(steps, key, F.col("depth") <= low + 1)
    inner = thin.join(lengths, key).withColumn("a", F.greatest("start", F.lit(margin))).withColumn("b", F.least("end", F.col("length") - margin))
    return inner.where(F.col("b") - F.col("a") >= least).select(key).distinct()


def dereplicated(contigs: DataFrame, matches: DataFrame, identity: float = 0.9, longest: int = 60_000, hang: int = 300) -> DataFrame:
    """Contigs ``contig, seq, coverage`` with ends cut that a better covered, longer contig has.

    ``matches``: ``a, b, a_start, a_end, identity``: where a lies on b.  Only ends
    (within ``hang``) of contigs below ``longest`` are cut, and only if their coverage
    is at most half that of the other.  A contig covered whole goes.
    """
    size = contigs.select("contig", F.length("seq").alias("n"), "coverage")
    a = size.select(F.col("contig").alias("a"), F.col("n").alias("na"), F.col("coverage").alias("ca"))
    b = size.select(F.col("contig").alias("b"), F.col("n").alias("nb"), F.col("coverage").alias("cb"))
    good = matches.join(a, "a").join(b, "b").where((F.col("identity") >= identity) & (F.col("na") < longest) & (F.col("na") < F.col("nb")) & (F.col("ca") <= F.col("cb") / 2))
    left = F.max(F.when(F.col("a_start") <= hang, F.col("a_end"))).alias("left")
    right = F.min(F.when(F.col("na") - F.col("a_end") <= hang, F.col("a_start"))).alias("right")
    ends = good.groupBy("a").agg(left, right).select(F.col("a").alias("contig"), "left", "right")
    joined = contigs.join(ends, "contig", "left")
    start, stop = F.coalesce("left", F.lit(0)), F.coalesce("right", F.length("seq"))
    return joined.where(start < stop).withColumn("seq", F.substring("seq", start + 1, stop - start)).drop("left", "right")


@scoped
def mapped(queries: DataFrame, references: DataFrame, length: int = 15, density: float = 0.05, least: int = 3, fraction: float = minimize.REPETITIVE, itself: bool = False) -> DataFrame:
    """Where sequences ``id, seq`` lie on others: chains of common minimizer pairs, measured.

    ``query, reference, same_strand, score, n_anchors, r_start, r_end, q_start,
    q_end`` (places of minimizers), and what :func:`align.chain_alignments` adds.
    Repetitive minimizers of the references anchor nothing.  Sequences are mapped to
    those of another id; ``itself`` says that both are the same table.
    """
    scratch = Scratch(queries.sparkSession)

    def minimized(rows: DataFrame) -> DataFrame:
        plain = rows.select(F.col("id").cast("long").alias("read_id"), "seq", F.lit(None).cast("string").alias("qual"))
        return scratch.keep(minimize.minimizer_reads(plain, length, density).select("read_id", "minimizers", "pos", "read_len"))

    r = minimized(references)
    q = r if itself else minimized(queries)
    banned = scratch.keep(minimize.repetitive_minimizers(scratch.keep(minimize.minimizer_counts(r)), fraction))
    pairs = scratch.keep(overlaps.pair_rows(minimize.without_repetitive(r, banned)))
    asked = pairs if itself else overlaps.pair_rows(minimize.without_repetitive(q, banned))
    found = align.chained(overlaps.anchors(asked, pairs, exclude_self=itself), least)
    sizes = lambda m, name: m.select(F.col("read_id").alias(name), F.col("read_len").alias(f"{name}_len"), F.size("minimizers").alias(f"{name}_n"))
    return align.chain_alignments(found, sizes(q, "query"), length, sizes(r, "reference"))


def rewritten(contigs: DataFrame, valid: DataFrame) -> DataFrame:
    """Contigs ``contig, seq`` with the letters of those that aren't ``valid`` (column ``contig``) emptied; every row stays."""
    told = valid.select("contig").distinct().withColumn("_valid", F.lit(True))
    return contigs.join(told, "contig", "left").withColumn("seq", F.when(F.col("_valid"), F.coalesce("seq", F.lit(""))).otherwise("")).drop("_valid")


@scoped
def self_overlaps(sequences: DataFrame, length: int = 15, density: float = 0.05, near: int = 50, least: int = 3) -> DataFrame:
    """Sequences ``id, seq`` whose end repeats their beginning: ``id, overlap`` in bases, up to ``near`` at either end."""
    rows = sequences.select(F.col("id").cast("long").alias("read_id"), "seq", F.lit(None).cast("string").alias("qual"))
    m = Scratch(sequences.sparkSession).keep(minimize.minimizer_reads(rows, length, density).select("read_id", "minimizers", "pos", "read_len"))
    pairs = overlaps.pair_rows(m)
    behind = overlaps.anchors(pairs, pairs).where("query = reference and same_strand and r_pos > q_pos")
    found = align.chained(behind, least).join(m.select(F.col("read_id").alias("query"), "read_len"), "query")
    ends = found.where((F.col("q_start") <= near + 1 / density) & (F.col("read_len") - F.col("r_end") <= near + length + 1 / density))
    return ends.groupBy(F.col("query").alias("id")).agg(F.max(F.col("read_len") - F.col("r_start") + F.col("q_start")).alias("overlap"))


def ends_without_cover(contigs: DataFrame, alignments: DataFrame, length: int = 15) -> DataFrame:
    """Contigs ``contig, seq`` cut to what alignments of :func:`mapped` cover; those nothing covers stay whole."""
    spans = alignments.select(F.col("reference").alias("contig"), F.greatest(F.col("r_start") - F.least("q_start", F.lit(length)), F.lit(0)).alias("start"), (F.col("r_end") + length).alias("end"))
    ends = intervals.trim_ends(spans, contigs.select("contig", F.length("seq").alias("length")), "contig", "start", "end")
    joined = contigs.join(ends, "contig", "left")
    return joined.withColumn("seq", F.when(F.col("trim_start").isNull(), F.col("seq")).otherwise(F.substring("seq", F.col("trim_start") + 1, F.col("trim_end") - F.col("trim_start")))).drop("trim_start", "trim_end")


@scoped
def read_paths(contigs: DataFrame, mreads: DataFrame, least: int = 2) -> DataFrame:
    """Reads on contigs ``contig, minimizers`` in minimizer space: chains with the places of their anchors.

    Positions are places in the sequences of minimizers; the best chain of a read
    counts (most anchors, then the smaller contig).
    """
    scratch = Scratch(contigs.sparkSession)
    numbered = lambda rows, name: rows.select(F.col(name).cast("long").alias("read_id"), "minimizers", F.transform("minimizers", lambda _, i: i).alias("pos"))
    r = scratch.keep(overlaps.pair_rows(numbered(contigs, "contig")))
    q = overlaps.pair_rows(numbered(mreads, "read_id"))
    found = align.chained(overlaps.anchors(q, r), least)
    return overlaps.best_mapping(found, "query", [F.desc("n_anchors"), F.desc("score"), F.asc("reference"), F.desc("same_strand")])


PIECE = "contig long, i int, j int, text string, lead int, tail int"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A read's letters between each two neighbouring anchors of its chain, on the contig's strand."""
    flip = str.maketrans("ACGT", "TGCA")
    for b in batches:
        out = []
        for contig, same, r_at, q_at, start, stop, text in zip(*(b.column(k).to_pylist() for k in range(7))):
            for i, j, a, z in zip(r_at, r_at[1:], q_at, q_at[1:]):
                first, last = (a, z) if same else (z, a)
                piece = text[start[first] : stop[last]]
                out.append((contig, i, j, piece if same else piece.translate(flip)[::-1], stop[a] - start[a], stop[z] - start[z]))
        columns = list(zip(*out)) or [[]] * 6
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["contig", "i", "j", "text", "lead", "tail"])


def _layout(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each contig's letters: the way over its pieces that gets farthest, then has most votes."""
    for b in batches:
        out = []
        for ring, pieces in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            ahead: dict[int, list] = {}
            for x in pieces:
                ahead.setdefault(x["i"], []).append(x)
            best: dict[int, tuple] = {}
            for i in sorted(ahead, reverse=True):
                ways = [((best[x["j"]][0] if x["j"] in best else x["j"]) - i, x["n"] + (best[x["j"]][1] if x["j"] in best else 0), -x["j"], x) for x in ahead[i]]
                far, n, _, x = max(ways, key=lambda w: w[:3])
                best[i] = (far + i, n, x)
            # The longest way begins where most is reached; the first of equal ones.
            at = max(best, key=lambda i: (best[i][0] - i, -i))
            text, x = [], None
            while at in best:
                x = best[at][2]
                text.append(x["text"] if not text else x["text"][x["lead"] :])
                at = x["j"]
            whole = "".join(text)
            out.append(whole[: len(whole) - x["tail"]] if ring else whole)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["contig", "seq"])


@scoped
def laid_out(contigs: DataFrame, mreads: DataFrame, reads: DataFrame) -> DataFrame:
    """Base sequences of contigs ``contig, minimizers, circular``: ``contig, seq``.

    ``mreads``: ``read_id, minimizers, start, stop``, the latter being where each
    minimizer lies in the read's letters.  Reads are laid along the contigs; what
    they have between two anchors counts as a vote for these letters there, and a
    contig is spelled along the pieces that lead farthest, by votes.  Pieces share
    their anchor's letters, whose number is known in each read.  A ring, whose first
    minimizer is repeated at its end, is closed there.  Contigs without a piece have
    no row.
    """
    paths = read_paths(contigs, mreads)
    letters = reads.select(F.col("read_id").alias("query"), F.upper("seq").alias("seq"))
    # An anchor names the first of two minimizers; the last anchor's second one matches too.
    ahead = F.element_at("q_at", -1) + F.when(F.col("same_strand"), 1).otherwise(-1)
    paths = paths.select("query", "reference", "same_strand", F.concat("r_at", F.array(F.element_at("r_at", -1) + 1)).alias("r_at"), F.concat("q_at", F.array(ahead)).alias("q_at"))
    rows = paths.join(mreads.select(F.col("read_id").alias("query"), "start", "stop"), "query").join(letters, "query")
    pieces = rows.select("reference", "same_strand", "r_at", "q_at", "start", "stop", "seq").mapInArrow(_pieces, PIECE)
    votes = pieces.where("j > i").groupBy("contig", "i", "j", "text").agg(F.count("*").alias("n"), F.min("lead").alias("lead"), F.min("tail").alias("tail"))
    best = votes.groupBy("contig", "i", "j").agg(F.min(F.struct((-F.col("n")).alias("m"), (-F.length("text")).alias("s"), "text", "lead", "tail")).alias("v"))
    gathered = best.groupBy("contig").agg(F.collect_list(F.struct("i", "j", (-F.col("v.m")).alias("n"), "v.text", "v.lead", "v.tail")).alias("pieces"))
    return gathered.join(contigs.select("contig", "circular"), "contig").select("contig", "circular", "pieces").mapInArrow(_layout, "contig long, seq string")


#: Mean quality that a piece of a read must have to count, where its qualities are known.
LEAST_QUALITY = 10


def window_pieces(contig_length: int, ref: np.ndarray, query: np.ndarray, same: bool, read: str, marks: str | None, window: int, anchor: int) -> Iterator[tuple[int, str, str | None]]:
    """A read's letters and qualities over each whole window its chain spans, cut at anchors by interpolation.

    Pieces shorter than half the window or of a mean quality below LEAST_QUALITY are left out.
    """
    if same is False:
        read = read.translate(str.maketrans("ACGT", "TGCA"))[::-1]
        marks = marks[::-1] if marks else None
        query = len(read) - anchor - query
    order = np.argsort(ref, kind="stable")
    ref, query = ref[order], query[order]
    first, last = -(-int(ref[0]) // window), int(ref[-1]) // window
    for w in range(max(0, first - 1), last + 1):
        start, stop = w * window, min((w + 1) * window, contig_length)
        # Beyond the outermost anchors the read goes on letter by letter.
        qa, qb = (np.interp(x, ref, query) + min(0, x - ref[0]) + max(0, x - ref[-1]) for x in (start, stop))
        if start < stop and qa > -0.1 * window and qb < len(read) + 0.1 * window:
            a, z = max(0, int(round(qa))), max(0, int(round(qb)))
            piece, quality = read[a:z], marks[a:z] if marks else None
            good = not quality or sum(map(ord, quality)) >= (33 + LEAST_QUALITY) * len(quality)
            if len(piece) > 0.5 * (stop - start) and good:
                yield w, piece, quality


@scoped
def polished(contigs: DataFrame, reads: DataFrame, length: int = 15, density: float = 0.1, window: int = 500, most: int = 100, rounds: int = 2) -> DataFrame:
    """Contigs ``contig, seq`` with bases settled by the reads' votes, window by window.

    Reads ``read_id, seq`` (and ``qual``, where it is as long as seq) are chained to
    contigs by common minimizer pairs; a read's letters over a window count for its
    best contig, by their qualities.  Windows no read covers stay as they are.
    """
    scratch = Scratch(contigs.sparkSession)
    now = scratch.keep(contigs.select(F.col("contig").cast("long").alias("contig"), "seq"))
    marks = F.when(F.length("qual") == F.length("seq"), F.col("qual")) if "qual" in reads.columns else F.lit(None).cast("string")
    base = reads.select(F.col("read_id").cast("long").alias("read_id"), F.upper("seq").alias("seq"), marks.alias("qual"))
    queries = scratch.keep(overlaps.pair_rows(minimize.minimizer_reads(base, length, density)))
    for _ in range(rounds):
        as_reads = now.select(F.col("contig").alias("read_id"), "seq", F.lit(None).cast("string").alias("qual"))
        hits = overlaps.anchors(queries, overlaps.pair_rows(minimize.minimizer_reads(as_reads, length, density)))
        gathered = hits.groupBy("query", "reference", "same_strand").agg(F.collect_list(F.struct("r_pos", "q_pos")).alias("hits")).where(F.size("hits") >= 3)
        best = overlaps.best_mapping(gathered.withColumn("n", F.size("hits")), "query", [F.desc("n"), F.asc("reference"), F.desc("same_strand")])
        rows = best.join(base.select(F.col("read_id").alias("query"), F.col("seq").alias("read"), F.col("qual").alias("marks")), "query").join(now.select(F.col("contig").alias("reference"), F.length("seq").alias("size")), "reference")

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out, hits = [], b.column(2)
                first = hits.offsets.to_numpy().astype(np.int64)
                first = first - first[0]
                ref, query = (hits.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                pair = np.repeat(np.arange(b.num_rows), np.diff(first))
                order = np.lexsort((query, ref, pair))
                ref, query = ref[order], query[order]
                strand = np.asarray(b.column(1).to_numpy(zero_copy_only=False), bool)
                scores, chains = align.chains(first, ref, np.where(strand[pair], query, -query))
                for contig, same, read, marks, size, score, members in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4, 5)), scores.tolist(), chains):
                    if len(members) >= 3:
                        out += [(contig, w, piece, quality, score) for w, piece, quality in window_pieces(size, ref[members], query[members], same, read, marks, window, length)]
                columns = list(zip(*out)) or [[]] * 5
                kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=["contig_id", "w", "seq", "qual", "score"])

        pieces = rows.select("reference", "same_strand", "hits", "read", "marks", "size").mapInArrow(cut, "contig_id long, w int, seq string, qual string, score double")
        cells = now.select(F.col("contig").alias("contig_id"), "seq", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("seq") - 1) / window).cast("int")))).alias("w"))
        backbone = cells.select("contig_id", "w", F.substring("seq", F.col("w") * window + 1, F.lit(window)).alias("backbone"))
        voted = align.window_consensus(pieces.join(backbone, ["contig_id", "w"]), most, trim=False)
        whole = backbone.join(voted, ["contig_id", "w"], "left").select("contig_id", "w", F.coalesce("seq", "backbone").alias("t"))
        joined = whole.groupBy("contig_id").agg(F.sort_array(F.collect_list(F.struct("w", "t"))).alias("x"))
        now = scratch.keep(joined.select(F.col("contig_id").alias("contig"), F.concat_ws("", F.transform("x", lambda x: x["t"])).alias("seq")))
    return now
