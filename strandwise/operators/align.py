"""Alignment and consensus of minimizer sequences and of bases.

The kernels work on one pair or one window at a time, whose size is bounded by a
read's length; what is joined and grouped around them is relational.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATCH, MISMATCH, GAP = 3, -1, -1


def chains(first: np.ndarray, ref: np.ndarray, query: np.ndarray, weight: float = 20.0, max_gap: int = 100, max_distance: int = 5000, band: int = 10) -> tuple[np.ndarray, list[np.ndarray]]:
    """Best chain of each pair's anchors, all pairs of a batch at once: scores and members.

    Anchors of pair i are ``first[i]`` to ``first[i + 1]``, sorted by reference
    position.  An anchor adds ``weight`` less the difference of the two distances to
    its predecessor, which must lie before it on both sequences, among the ``band``
    anchors before, within ``max_distance`` and ``max_gap``.  Of equal ones the first
    wins.  A step handles the n-th anchor of every pair that has one.
    """
    n = np.diff(first)
    score, before = np.full(len(ref), weight, np.float32), np.full(len(ref), -1)
    by = np.argsort(-n, kind="stable")
    for step in range(1, int(n.max(initial=0))):
        at = first[:-1][by[: np.searchsorted(-n[by], -step, "left")]] + step
        best, come = score[at], np.full(len(at), -1)
        for back in range(min(band, step), 0, -1):
            j = at - back
            dr, dq = ref[at] - ref[j], query[at] - query[j]
            gap = np.abs(dr - dq)
            s = score[j] + np.float32(weight) - gap.astype(np.float32)
            better = (dr > 0) & (dq > 0) & (dr <= max_distance) & (dq <= max_distance) & (gap <= max_gap) & (s > best)
            best, come = np.where(better, s, best), np.where(better, j, come)
        score[at], before[at] = best, come
    best, members = np.zeros(len(n), np.float32), []
    for i, (a, z) in enumerate(zip(first, first[1:])):
        walk = []
        if z > a:
            at = int(a + np.argmax(score[a:z]))
            best[i] = score[at]
            while at >= 0:
                walk.append(at)
                at = int(before[at])
        members.append(np.array(walk[::-1], np.int64))
    return best, members


def chain(ref: np.ndarray, query: np.ndarray, **limits) -> tuple[float, list[int]]:
    """Best chain of one pair's anchors: its score and members."""
    best, members = chains(np.array([0, len(ref)]), ref, query, **limits)
    return float(best[0]), members[0].tolist()


CHAINS = "query long, reference long, same_strand boolean, score float, n_anchors int, r_start int, r_end int, q_start int, q_end int, r_at array<int>, q_at array<int>"


def chained(anchors: DataFrame, least: int = 3, **limits) -> DataFrame:
    """Best chain of each (query, reference, strand) with ``least`` anchors or more.

    Anchors of :func:`overlaps.anchors`; those of a pair are gathered in one row,
    so a row is as large as two reads have common minimizer pairs.  ``r_at`` and
    ``q_at`` are the chain's minimizers by their place in either sequence.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = b.column(3)
            first = hits.offsets.to_numpy().astype(np.int64)
            flat = hits.flatten()
            rp, qp, ri, qi = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4))
            first = first - first[0]
            strand = np.asarray(b.column(2).to_numpy(zero_copy_only=False), bool)
            pair = np.repeat(np.arange(b.num_rows), np.diff(first))
            way = np.where(strand[pair], qp, -qp)
            order = np.lexsort((way, rp, pair))
            rp, qp, ri, qi, way = rp[order], qp[order], ri[order], qi[order], way[order]
            score, members = chains(first, rp, way, **limits)
            size = np.array([len(m) for m in members], np.int64)
            keep = np.flatnonzero(size >= least)
            flat_members = np.concatenate([members[i] for i in keep]) if len(keep) else np.zeros(0, np.int64)
            cuts = np.append(0, np.cumsum(size[keep]))
            ends = [x(v[members[i]]) for v in (rp, qp) for x in (np.min, np.max) for i in keep]
            ends = np.array(ends, np.int64).reshape(4, len(keep)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(v[flat_members].astype(np.int32))) for v in (ri, qi)]
            some = pa.array(keep)
            columns = [b.column(k).take(some) for k in range(3)] + [pa.array(score[keep]), pa.array(size[keep].astype(np.int32)), *(pa.array(x) for x in ends), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=["query", "reference", "same_strand", "score", "n_anchors", "r_start", "r_end", "q_start", "q_end", "r_at", "q_at"])

    q_at = F.when(F.col("same_strand"), F.col("q_i")).otherwise(F.col("q_i") + 1)
    gathered = anchors.groupBy("query", "reference", "same_strand").agg(F.collect_list(F.struct("r_pos", "q_pos", F.col("r_i").cast("int").alias("r_at"), q_at.cast("int").alias("q_at"))).alias("hits"))
    return gathered.where(F.size("hits") >= least).mapInArrow(run, CHAINS)


def chain_anchors(anchors: DataFrame, least: int = 3, **limits) -> DataFrame:
    """As :func:`chained`, without the places of its anchors."""
    return chained(anchors, least, **limits).drop("r_at", "q_at")


def chain_alignments(found: DataFrame, queries: DataFrame, length: int, references: DataFrame | None = None) -> DataFrame:
    """What chains of :func:`chained` say of the alignment they stand for.

    ``queries``: ``query, query_len, query_n`` (letters, minimizers); ``references``
    likewise, or those of the queries.  Added columns: ``matches``,
    ``mismatches``, ``insertions`` and ``deletions`` in minimizers (between two
    anchors as many mismatches as the shorter side has minimizers; before the first
    and after the last anchor mismatches up to the nearer end), ``align_length``
    on the reference, ``identity`` (share of matches in the shorter sequence, to
    the power of 1 / ``length``), and ``hang_start``, ``hang_end``: bases that both
    sequences have beyond the chain.
    """
    q = queries.select("query", F.col("query_len").alias("q_len"), F.col("query_n").alias("q_n"))
    r = references if references is not None else queries.select(*[F.col(c).alias(c.replace("query", "reference")) for c in ("query", "query_len", "query_n")])
    r = r.select("reference", F.col("reference_len").alias("r_len"), F.col("reference_n").alias("r_n"))
    n = F.size("r_at")
    step = lambda v: F.zip_with(F.slice(v, F.lit(2), n - 1), F.slice(v, F.lit(1), n - 1), lambda x, y: F.abs(x - y) - 1)
    gaps = F.zip_with(step("r_at"), step("q_at"), lambda x, y: F.struct(F.least(x, y).alias("both"), F.greatest(x - y, F.lit(0)).alias("only_r"), F.greatest(y - x, F.lit(0)).alias("only_q")))
    total = lambda part: F.aggregate("gaps", F.lit(0), lambda acc, g: acc + g[part])
    same = F.col("same_strand")
    first_r, last_r = F.element_at("r_at", 1), F.element_at("r_at", -1)
    first_q, last_q = F.element_at("q_at", 1), F.element_at("q_at", -1)
    head = F.least(first_r, F.when(same, first_q).otherwise(F.col("q_n") - 1 - first_q))
    tail = F.least(F.col("r_n") - 1 - last_r, F.when(same, F.col("q_n") - 1 - last_q).otherwise(last_q))
    rows = found.join(q, "query").join(r, "reference").withColumn("gaps", gaps)
    counted = rows.select("*", n.alias("matches"), (total("both") + head + tail).alias("mismatches"), total("only_q").alias("insertions"), total("only_r").alias("deletions"))
    shorter = F.col("matches") + F.col("mismatches") + F.least("insertions", "deletions")
    hang_start = F.least("r_start", F.when(same, F.col("q_start")).otherwise(F.col("q_len") - F.col("q_end") - length))
    hang_end = F.least(F.col("r_len") - F.col("r_end") - length, F.when(same, F.col("q_len") - F.col("q_end") - length).otherwise(F.col("q_start")))
    measured = counted.select("*", (F.col("r_end") - F.col("r_start")).alias("align_length"), F.pow(F.col("matches") / shorter, F.lit(1.0 / length)).alias("identity"), F.greatest(hang_start, F.lit(0)).alias("hang_start"), F.greatest(hang_end, F.lit(0)).alias("hang_end"))
    return measured.drop("gaps", "r_at", "q_at", "q_len", "r_len", "q_n", "r_n")


def good_alignments(alignments: DataFrame, min_overlap: int = 1000, min_identity: float = 0.96, max_hang: int = 1000, least: int = 4) -> DataFrame:
    """Alignments that may correct a read: long, alike, and without long overhangs on either side."""
    return alignments.where((F.col("matches") >= least) & (F.col("hang_start") <= max_hang) & (F.col("hang_end") <= max_hang) & (F.col("align_length") >= min_overlap) & (F.col("identity") >= min_identity))


def overlap_align(ref: list[int], query: list[int]) -> list[tuple[int, int]]:
    """Align two minimizer sequences, free gaps at both ends; -1 marks a gap.

    The best cell of the last row and column wins, later ties first; tracing back
    prefers the diagonal, then a gap in the reference.
    """
    n, m = len(ref), len(query)
    r, q = np.asarray(ref), np.asarray(query)
    table = np.zeros((n + 1, m + 1), np.int32)
    for i in range(1, n + 1):
        hit = np.where(q == r[i - 1], MATCH, MISMATCH)
        above = np.maximum(table[i - 1, :-1] + hit, table[i - 1, 1:] + GAP)
        # Gaps along the row: a running maximum over values freed of their own gap cost.
        steps = np.arange(m + 1)
        row = np.concatenate(([0], above)) - GAP * steps
        table[i] = np.maximum.accumulate(row) + GAP * steps
    best, at = -1, (n, m)
    for j in range(m + 1):
        if table[n, j] >= best:
            best, at = table[n, j], (n, j)
    for i in range(n + 1):
        if table[i, m] >= best:
            best, at = table[i, m], (i, m)
    i, j = at
    out = []
    while i > 0 and j > 0:
        if table[i, j] == table[i - 1, j - 1] + (MATCH if r[i - 1] == q[j - 1] else MISMATCH):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif table[i, j] == table[i, j - 1] + GAP:
            j -= 1
            out.append((-1, j))
        else:
            i -= 1
            out.append((i, -1))
    return out[::-1]


def unpalindromic(minimizers: list[int], first_k: int, last_k: int) -> list[int]:
    """Places that :func:`purge_palindromes` keeps."""
    m, at = list(minimizers), list(range(len(minimizers)))
    k, i = first_k, 0
    while k < last_k and k <= len(m):
        if i + k > len(m):
            k, i = k + 1, 0
        elif m[i] == m[i + k - 1] and m[i : i + k] == m[i : i + k][::-1]:
            del m[i], at[i]
            k, i = first_k, 0
        else:
            i += 1
    return at


def purge_palindromes(minimizers: list[int], first_k: int, last_k: int) -> list[int]:
    """Drop the first minimizer of the first palindromic window of the smallest k, and look again."""
    return [minimizers[i] for i in unpalindromic(minimizers, first_k, last_k)]


def purged_reads(mreads: DataFrame, first_k: int, last_k: int) -> DataFrame:
    """Reads freed of palindromes, with the places of what is left: ``read_id, minimizers, pos``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for m, pos in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                at = unpalindromic(m or [], first_k, last_k)
                out.append(([m[i] for i in at], [pos[i] for i in at]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m for m, _ in out], pa.list_(pa.int64())), pa.array([x for _, x in out], pa.list_(pa.int32()))], names=["read_id", "minimizers", "pos"])

    return mreads.select("read_id", "minimizers", "pos").mapInArrow(run, "read_id long, minimizers array<bigint>, pos array<int>")


class Votes:
    """Minimizers of a read and of those aligned with it, as a graph whose edges add up qualities.

    A node is a minimizer of the read, or one that another read has instead or in
    addition; those are one node if they follow the same node with the same
    minimizer.
    """

    def __init__(self, backbone: list[int]):
        self.value = list(backbone)
        self.out: list[dict[int, int]] = [{} for _ in backbone]
        self.entered = [False] * len(backbone)

    def _link(self, a: int | None, b: int, weight: int) -> int:
        if a is not None:
            self.out[a][b] = self.out[a].get(b, 0) + weight
            self.entered[b] = True
        return b

    def _other(self, a: int | None, m: int) -> int:
        if a is not None:
            for b in self.out[a]:
                if self.value[b] == m:
                    return b
        self.value.append(m)
        self.out.append({})
        self.entered.append(False)
        return len(self.value) - 1

    def add(self, columns: list[tuple[int, int]], other: list[int], quality: list[int]) -> None:
        """A read by its alignment columns ``(place in the backbone, place in the read)``, -1 for a gap."""
        at = None
        for i, j in columns:
            if j >= 0:
                b = i if i >= 0 and self.value[i] == other[j] else self._other(at, other[j])
                at = self._link(at, b, quality[j])

    def _support(self, a: int, b: int, known: set[int]) -> int:
        """Weight of an edge and of all that comes after it and leads to a minimizer the read has."""
        total, todo, seen = self.out[a][b], [b], {b}
        while todo:
            for v, w in self.out[todo.pop()].items():
                if self.value[v] in known:
                    total += w
                if v not in seen:
                    seen.add(v)
                    todo.append(v)
        return total

    def path(self, known: set[int], share: float) -> list[int] | None:
        """Minimizers of the best path, or none if no node begins one.

        It begins at the node without predecessor whose onward support is largest and
        follows, among the edges of ``share`` of the largest weight, the best supported
        one, until it ends or meets itself.
        """
        starts = [(self._support(a, b, known), -a) for a in range(len(self.value)) if not self.entered[a] for b in self.out[a]]
        best = max(starts, default=(0, 0))
        if best[0] <= 0:
            return None
        at, nodes = -best[1], {-best[1]: None}
        while True:
            ways = {b: w for b, w in self.out[at].items() if b != at}
            if not ways:
                break
            strong = [b for b, w in ways.items() if w >= share * max(ways.values())]
            nxt = strong[0] if len(strong) == 1 else max(strong, key=lambda b: (self._support(at, b, known), -b))  # noqa: B023
            if nxt in nodes:
                break
            nodes[nxt] = None
            at = nxt
        return [self.value[v] for v in nodes]


def correct(backbone: list[int], others: list[tuple[list[int], list[int]]], quality: list[int] | None = None, share: float = 0.75) -> list[int]:
    """Consensus minimizers of a read from the reads that overlap it.

    ``others``: minimizers and their qualities; each read is aligned on the strand
    that has more matches and added to :class:`Votes`; those with fewer than two
    matches are left out.  The best path is trimmed to its first and last minimizer
    that the read has.
    """
    if not backbone:
        return []
    votes, known = Votes(backbone), set(backbone)
    votes.add([(i, i) for i in range(len(backbone))], backbone, quality or [1] * len(backbone))
    for other, marks in others:
        ways = [(other, marks), (other[::-1], marks[::-1])]
        found = [overlap_align(backbone, w) for w, _ in ways]
        hits = [sum(i >= 0 and j >= 0 and backbone[i] == w[j] for i, j in a) for a, (w, _) in zip(found, ways)]
        way = int(hits[1] > hits[0])
        if hits[way] >= 2:
            votes.add(found[way], *ways[way])
    path = votes.path(known, share)
    if path is None:
        return list(backbone)
    has = [i for i, m in enumerate(path) if m in known]
    return path[has[0] : has[-1] + 1] if has else []


def corrected_reads(mreads: DataFrame, neighbours: DataFrame, first_k: int = 4, last_k: int = 20) -> DataFrame:
    """Reads corrected from their neighbours: ``read_id, minimizers``.

    ``mreads`` may have ``qual``, the least quality under each minimizer; a missing
    one counts as 1.  ``neighbours``: ``read_id, other``, at most a bounded number
    for each read (the top 20 a position).  Palindromes up to ``last_k`` are purged;
    corrected reads shorter than ``first_k`` are dropped.
    """
    marks = F.transform("qual", lambda q: F.greatest(F.coalesce(q, F.lit(1)).cast("int"), F.lit(1))) if "qual" in mreads.columns else F.transform("minimizers", lambda _: F.lit(1))
    own = mreads.select("read_id", "minimizers", marks.alias("q"))
    other = own.select(F.col("read_id").alias("other"), F.col("minimizers").alias("m"), F.col("q").alias("w"))
    gathered = neighbours.join(other, "other").groupBy("read_id").agg(F.sort_array(F.collect_list(F.struct("other", "m", "w"))).alias("o"))
    rows = own.join(gathered, "read_id", "left").select("read_id", "minimizers", "q", "o")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = []
            for m, q, o in zip(*(b.column(k).to_pylist() for k in (1, 2, 3))):
                fixed = correct(m or [], [(x["m"], x["w"]) for x in o or []], q)
                done.append(purge_palindromes(fixed, first_k, last_k))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(done, pa.list_(pa.int64()))], names=["read_id", "minimizers"])

    return rows.mapInArrow(run, "read_id long, minimizers array<bigint>").where(F.size("minimizers") >= first_k)


def edit_path(target: str, query: str) -> str:
    """CIGAR of a global alignment of least edits (``=``, ``X``, ``I`` of query letters, ``D``)."""
    t, q = np.frombuffer(target.encode(), np.uint8), np.frombuffer(query.encode(), np.uint8)
    # Equal letters at the end are always aligned.
    short = min(len(t), len(q))
    other = np.flatnonzero(t[len(t) - short :] != q[len(q) - short :])
    same = short - 1 - int(other[-1]) if len(other) else short
    n, m = len(t) - same, len(q) - same
    t, q = t[:n], q[:m]
    table = np.empty((n + 1, m + 1), np.int32)
    table[0] = steps = np.arange(m + 1)
    for i in range(1, n + 1):
        above = np.minimum(table[i - 1, :-1] + (q != t[i - 1]), table[i - 1, 1:] + 1)
        table[i] = np.minimum.accumulate(np.concatenate(([i], above)) - steps) + steps
    ops, i, j = ["="] * same, n, m
    while i or j:
        if i and j and table[i, j] == table[i - 1, j - 1] + (t[i - 1] != q[j - 1]):
            i, j = i - 1, j - 1
            ops.append("=" if t[i] == q[j] else "X")
        elif i and table[i, j] == table[i - 1, j] + 1:
            i -= 1
            ops.append("D")
        else:
            j -= 1
            ops.append("I")
    ops.reverse()
    out, k = [], 0
    while k < len(ops):
        z = k
        while z < len(ops) and ops[z] == ops[k]:
            z += 1
        out.append(f"{z - k}{ops[k]}")
        k = z
    return "".join(out)


def cigar_ops(cigar: str) -> list[tuple[int, str]]:
    out, n = [], 0
    for c in cigar:
        if c.isdigit():
            n = 10 * n + int(c)
        else:
            out.append((n, c))
            n = 0
    return out


def cigar_matches(cigar: str) -> int:
    """Letters in ``=`` and ``M`` stretches."""
    return sum(n for n, op in cigar_ops(cigar) if op in "=M")


def consensus(backbone: str, pieces: list[tuple[str, str]], trim: bool = True) -> str:
    """Consensus of a window from pieces ``(letters, quality or '')``.

    Every piece is aligned with the backbone; each column takes the letter, or gap,
    of most quality, and an insertion is taken where most of the pieces have it.
    The backbone only decides ties.  With ``trim``, ends that fewer than half the
    pieces cover are cut, unless that leaves less than four fifths of the window.
    """
    if all(letters == backbone for letters, _ in pieces):
        return backbone
    n = len(backbone)
    votes = [defaultdict(float) for _ in range(n)]
    inserts = [defaultdict(float) for _ in range(n + 1)]
    depth = np.zeros(n, int)
    for letters, quality in pieces:
        i = j = 0
        weight = lambda at: max(1, ord(quality[at]) - 33) if at < len(quality) else 1  # noqa: B023, E731
        ops = cigar_ops(edit_path(backbone, letters))
        for place, (length, op) in enumerate(ops):
            if op == "D" and place in (0, len(ops) - 1):
                # The piece doesn't reach so far.
                i += length
            elif op in "=X":
                for k in range(length):
                    votes[i + k][letters[j + k]] += weight(j + k)
                depth[i : i + length] += 1
                i, j = i + length, j + length
            elif op == "D":
                for k in range(length):
                    votes[i + k][""] += weight(min(j, len(letters) - 1))
                depth[i : i + length] += 1
                i += length
            else:
                inserts[i][letters[j : j + length]] += weight(j)
                j += length
    out = []
    for i in range(n):
        extra = max(inserts[i].items(), key=lambda x: (x[1], x[0]), default=("", 0.0))
        letter = max(votes[i].items(), key=lambda x: (x[1], x[0] == backbone[i], x[0]))[0] if votes[i] else backbone[i]
        out.append((extra[0] if extra[1] * 2 > sum(votes[i].values()) else "") + letter)
    covered = np.flatnonzero(depth >= len(pieces) / 2)
    if trim and len(covered) and covered[-1] - covered[0] + 1 > 0.8 * n:
        return "".join(out[covered[0] : covered[-1] + 1])
    return "".join(out)


def window_consensus(windows: DataFrame, most: int = 100, trim: bool = True) -> DataFrame:
    """``contig_id, w, seq``: each window's consensus from its ``most`` best pieces.

    ``windows``: ``contig_id, w, backbone, seq, qual, score``.  The best pieces are
    those whose length is nearest the window's, then of the highest score; ties by
    content.
    The best pieces are ranked in the engine, so a row holds at most ``most``.
    """
    from pyspark.sql import Window

    rank = Window.partitionBy("contig_id", "w").orderBy(F.abs(F.length("seq") - F.length("backbone")), F.desc("score"), "seq", "qual")
    best = windows.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= most)
    rows = best.groupBy("contig_id", "w").agg(F.first("backbone").alias("backbone"), F.sort_array(F.collect_list(F.struct("_r", "seq", "qual"))).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [consensus(base, [(x["seq"], x["qual"] or "") for x in p], trim) for base, p in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(done, pa.string())], names=["contig_id", "w", "seq"])

    return rows.select(F.col("contig_id").cast("long").alias("contig_id"), F.col("w").cast("int").alias("w"), "backbone", "p").mapInArrow(run, "contig_id long, w int, seq string")
