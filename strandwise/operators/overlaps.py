"""Anchor joins between sequences, and ranking of their mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seq


def pair_rows(mreads: DataFrame, id_col: str = "read_id") -> DataFrame:
    """``id, i, pos, next_pos, a, b, is_rev``: consecutive minimizers as a normalised pair."""
    m = F.col("minimizers")
    n = F.size(m)
    at = F.when(n >= 2, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    rows = mreads.select(id_col, m, F.col("pos").alias("_pos"), F.explode(at).alias("i"))
    x, y = F.element_at("minimizers", F.col("i")), F.element_at("minimizers", F.col("i") + 1)
    return rows.select(id_col, (F.col("i") - 1).alias("i"), F.element_at("_pos", F.col("i")).alias("pos"), F.element_at("_pos", F.col("i") + 1).alias("next_pos"), F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), (x >= y).alias("is_rev"))


def anchors(queries: DataFrame, references: DataFrame, query_id: str = "read_id", reference_id: str = "read_id", exclude_self: bool = False) -> DataFrame:
    """Pairs of positions at which query and reference have the same minimizer pair.

    ``query, reference, q_i, r_i, q_pos, r_pos, same_strand``; on the other strand
    ``q_pos`` is where the query has the pair's later minimizer, which is the one at
    ``r_pos`` (so that every anchor joins one minimizer to itself).  A shuffled equi
    join on the pair; drop repetitive minimizers first, as the reference aligners
    do, or a repeat's matches grow with its square.  What is frequent all the same
    is split by AQE's skew join.
    """
    q = queries.select(F.col(query_id).alias("query"), F.col("i").alias("q_i"), F.col("pos").alias("q_pos"), F.col("next_pos").alias("q_next"), F.col("is_rev").alias("q_rev"), "a", "b")
    r = references.select(F.col(reference_id).alias("reference"), F.col("i").alias("r_i"), F.col("pos").alias("r_pos"), F.col("is_rev").alias("r_rev"), "a", "b")
    joined = q.join(r, ["a", "b"])
    if exclude_self:
        joined = joined.where("query <> reference")
    same = F.col("q_rev") == F.col("r_rev")
    return joined.select("query", "reference", "q_i", "r_i", F.when(same, F.col("q_pos")).otherwise(F.col("q_next")).alias("q_pos"), "r_pos", same.alias("same_strand"))


def shared_kminmers(a: DataFrame, b: DataFrame, lengths_a: DataFrame | None = None, lengths_b: DataFrame | None = None) -> DataFrame:
    """Contigs that share k-min-mers with contigs at least as long: ``a, b, n``.

    Inputs ``contig, km`` (and ``contig, n_min``); occurrences are counted before
    the join, so that a repeat costs one row a contig.
    """
    left = a.groupBy("km", F.col("contig").alias("a")).agg(F.count("*").alias("na"))
    right = b.groupBy("km", F.col("contig").alias("b")).agg(F.count("*").alias("nb"))
    pairs = left.join(right, "km").where("a <> b").groupBy("a", "b").agg(F.sum(F.col("na") * F.col("nb")).alias("n"))
    if lengths_a is None:
        return pairs
    la = lengths_a.select(F.col("contig").alias("a"), F.col("n_min").alias("la"))
    lb = (lengths_b if lengths_b is not None else lengths_a).select(F.col("contig").alias("b"), F.col("n_min").alias("lb"))
    return pairs.join(la, "a").join(lb, "b").where("lb >= la").select("a", "b", "n")


def top_per_position(scored: DataFrame, position: list[str], score: str, other: str, n: int = 20) -> DataFrame:
    """The ``n`` best rows of each position (ties: smaller ``other``), as distinct pairs."""
    rank = Window.partitionBy(*position).orderBy(F.desc(score), F.asc(other))
    return scored.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= n).drop("_r")


def top_along(scored: DataFrame, key: str, start: str, end: str, score: str, other: str, n: int = 20) -> DataFrame:
    """Pairs ``key, other`` that are among the ``n`` best at some position of ``start`` to ``end`` (inclusive).

    Of rows of one ``other`` and score at a position one counts; ties: smaller
    ``other``.  Null keys, others or ends, and ends before starts, don't count; a
    null score is the worst.

    A span is put together from aligned blocks of 1, 2, 4, ... positions.  In each
    block all but the ``n`` best are beaten everywhere in it and dropped at once, so
    a block keeps ``n`` rows however deep the cover is.  A position lies in one block
    of each size; where a kept block begins or ends, what is left there is ranked.
    """
    rows = scored.where(F.col(key).isNotNull() & F.col(other).isNotNull() & (F.col(start) >= 0) & (F.col(start) <= F.col(end))).select(key, other, F.col(start).cast("long").alias("_s"), (F.col(end).cast("long") + 1).alias("_e"), F.col(score).alias("_w"))
    power = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)

    def at_level(k: Column) -> Column:
        low, high = F.floor((F.col("_s") + power(k) - 1) / power(k)), F.floor(F.col("_e") / power(k))
        one = F.when((low < high) & (low % 2 == 1), low)
        two = F.when((low < high) & (high % 2 == 1), high - 1)
        return F.transform(F.filter(F.array(one, two), lambda b: b.isNotNull()), lambda b: F.struct(k.alias("level"), b.alias("block")))

    blocks = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(40)), at_level))
    spread = rows.select(key, other, "_w", F.explode(blocks).alias("_b")).select(key, other, "_w", F.col("_b.level").alias("_k"), F.col("_b.block").alias("_n")).distinct()
    best = top_per_position(spread, [key, "_k", "_n"], "_w", other, n)
    edges = best.select(key, F.explode(F.array(F.col("_n"), F.col("_n") + 1)).alias("_n"), "_k").select(key, (F.col("_n") * power(F.col("_k"))).alias("_p")).distinct()
    seen = edges.select(key, "_p", F.explode(F.sequence(F.lit(0), F.lit(40))).alias("_k")).withColumn("_n", F.call_function("shiftright", F.col("_p"), F.col("_k")))
    ranked = seen.join(best, [key, "_k", "_n"]).select(key, "_p", other, "_w").distinct()
    return top_per_position(ranked, [key, "_p"], "_w", other, n).select(key, other).distinct()


def disjoint(alignments: DataFrame, key: str, start: str, end: str, score: str, order: list[str], slack: int = 0) -> DataFrame:
    """Of each sequence's alignments the best that don't overlap by more than ``slack``: rows of ``alignments``.

    Greedy by score (ties by ``order``, which should be total).  Of alignments over the same span only the
    best matters, so that one row a span reaches the choice, however many there are.
    """
    best = best_mapping(alignments.where(F.col(key).isNotNull() & (F.col(start) < F.col(end))), [key, start, end], [F.desc_nulls_last(score), *[F.asc(c) for c in order]])
    gathered = best.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.coalesce(F.col(score).cast("double"), F.lit(-1e300))).alias("w"), *order, F.col(start).alias("_s"), F.col(end).alias("_e")))).alias("a"))
    free = lambda taken, x: ~F.exists(taken, lambda t: F.least(t["_e"], x["_e"]) - F.greatest(t["_s"], x["_s"]) > slack)
    none = F.filter("a", lambda _: F.lit(False))
    chosen = F.aggregate("a", none, lambda taken, x: F.when(free(taken, x), F.concat(taken, F.array(x))).otherwise(taken))
    return gathered.select(key, F.explode(chosen).alias("x")).select(key, *[F.col(f"x.{c}") for c in order], F.col("x._s").alias(start), F.col("x._e").alias(end))


def thinned(alignments: DataFrame, key: str, start: str, end: str, score: str, order: list[str], depth: int = 10) -> DataFrame:
    """Alignments that are among the ``depth`` best at some position, so that every position keeps its best ones.

    Taking worst ones away one by one, as long as every position they cover keeps
    enough, gives a subset of these; this one doesn't depend on such an order and is
    found by :func:`top_along` without going through the alignments of a sequence.
    """
    ids = alignments.withColumn("_id", F.struct(*order))
    kept = top_along(ids.withColumn("_last", F.col(end) - 1), key, start, "_last", score, "_id", depth)
    return ids.join(kept, [key, "_id"], "left_semi").drop("_id")


def best_mapping(mappings: DataFrame, query: str | list[str], order: list) -> DataFrame:
    """One row a query: the first by ``order``, which should be total."""
    rank = Window.partitionBy(*([query] if isinstance(query, str) else query)).orderBy(*order)
    return mappings.withColumn("_r", F.row_number().over(rank)).where("_r = 1").drop("_r")


def jaccard_of_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Distances of given pairs ``a, b`` of sets ``id, xs`` (distinct values).

    ``shared, distance``, and ``distance_early``, whose denominator stops where
    either sorted list ends: elements after that aren't counted.  Pairs of which
    one has no set are left out; two empty sets have null distances.
    """
    sa = sets.select(F.col("id").alias("a"), "xs")
    sb = sets.select(F.col("id").alias("b"), F.col("xs").alias("ys"))
    both = pairs.select("a", "b").distinct().join(sa, "a").join(sb, "b")
    stop = F.least(F.array_max("xs"), F.array_max("ys"))
    seen = F.array_union(F.filter("xs", lambda v: v <= stop), F.filter("ys", lambda v: v <= stop))
    shared = F.size(F.array_intersect("xs", "ys"))
    share = lambda n: F.when(n > 0, 1 - shared / n)
    return both.select("a", "b", shared.alias("shared"), share(F.size(F.array_union("xs", "ys"))).alias("distance"), share(F.size(seen)).alias("distance_early"))


def with_lengths(matches: DataFrame, reads: DataFrame) -> DataFrame:
    """Matches of ``read_match`` form with both reads' lengths: ``q_len, r_len``."""
    n = reads.select("read_id", F.coalesce(F.length("seq"), F.lit(0)).alias("n"))
    q = n.select(F.col("read_id").alias("read_index"), F.col("n").alias("q_len"))
    r = n.select(F.col("read_id").alias("ref_read_index"), F.col("n").alias("r_len"))
    return matches.join(q, "read_index").join(r, "ref_read_index")


def overlap_columns() -> tuple:
    return tuple(F.col(c) for c in ("query_start", "query_end", "q_len", "reference_start", "reference_end", "r_len", "is_reversed"))


def valid_overlaps(matches: DataFrame, **limits) -> DataFrame:
    return matches.where(seq.valid_overlap(*overlap_columns(), **limits))
