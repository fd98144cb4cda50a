"""Queries over overlaps, intervals and the k-min-mer graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import seq, stats
from ..operators import align, graph, intervals, minimize, overlaps
from ..operators import contigs as cleaning
from ..operators import kminmers as km
from ..session import materialize, table
from ..sources import fastx, gfa
from . import assembly
from .read_queries import COMPLEXITY, TOP, mreads_of, reads_of, rows_of
from .registry import query
from .sql import DENSITY, GRAPH, K, LENGTH, MINIMIZERS, MREADS, PLANTED, READ_KMINMERS, SOLID, UNITIG_EDGES, UNITIGS, kminmers

LENGTHS = "ln as (select read_id, coalesce(length(seq), 0) n from reads), mt as (select m.*, q.n q_len, t.n r_len from read_match m join ln q on m.read_index = q.read_id join ln t on m.ref_read_index = t.read_id)"
EXT = f"""{LENGTHS}, ex as (select *, case when is_reversed then r_len - reference_end else reference_start end tl5, case when is_reversed then reference_start else r_len - reference_end end tl3 from mt),
    ey as (select *, least(query_start, tl5) ext5, least(q_len - query_end, tl3) ext3, query_end - query_start span, reference_end - reference_start tspan from ex)"""


def matches_of(spark, d):
    return overlaps.with_lengths(table(spark, d, "read_match"), table(spark, d, "reads").select("read_id", "seq"))


def graph_of(spark, d):
    """Nodes of the solid k-min-mers' graph and the planted one."""
    solid = km.solid(km.kminmer_counts(rows_of(spark, d)))
    return graph.numbered(solid.unionByName(spark.createDataFrame(PLANTED, "km array<long>, abundance long")))


def unitigs_of(spark, d):
    """Unitigs of that graph, known by their minimizers."""
    return graph.compact(graph_of(spark, d), K - 1).withColumn("unitig", F.col("minimizers"))


@query(f"with {EXT} select match_id from ey where not is_reversed and reference_start >= query_start and ext5 <= 200 and ext3 <= 200 and span >= (span + ext5 + ext3) * 0.8 and not (query_start <= tl5 and q_len - query_end <= tl3) and not (query_start >= tl5 and q_len - query_end >= tl3) and span + ext5 + ext3 >= 100 and tspan + ext5 + ext3 >= 100")
def valid_overlaps(spark, d):
    """Dovetail overlaps of at least 100 bases among the matches."""
    return overlaps.valid_overlaps(matches_of(spark, d), least=100).select("match_id")


@query(f"with {EXT} select match_id, greatest(span, tspan) + ext5 + ext3 as mappable, ext5 <= 100 and ext3 <= 100 as maximal from ey")
def mappable_len(spark, d):
    """Mappable length of each match, and whether it reaches the ends."""
    c = overlaps.overlap_columns()
    return matches_of(spark, d).select("match_id", seq.mappable_length(*c).alias("mappable"), seq.maximal_mapping(*c, tolerance=100).alias("maximal"))


@query(f"with {LENGTHS} select match_id, read_index from (select *, row_number() over (partition by read_index order by align_nb_matches - hang_left - hang_right desc nulls last, ref_read_index, reference_start, match_id) r from mt) where r = 1")
def best_mapping(spark, d):
    """Best match of each read by matches less overhangs."""
    m = matches_of(spark, d).withColumn("s", F.col("align_nb_matches") - F.col("hang_left") - F.col("hang_right"))
    order = [F.desc_nulls_last("s"), F.asc_nulls_first("ref_read_index"), F.asc_nulls_last("reference_start"), F.asc("match_id")]
    return overlaps.best_mapping(m, "read_index", order).select("match_id", "read_index")


@query("""with s as (select read_index, ref_read_index, sum(align_nb_matches) total, min(reference_start) a, max(reference_end) b from read_match where read_index is not null and ref_read_index is not null group by all)
          select read_index, ref_read_index, total::BIGINT as total, a as start, b as "end" from (select *, row_number() over (partition by read_index order by total desc nulls last, ref_read_index) r from s) where r = 1""")
def best_contig_by_sum(spark, d):
    """For each read the reference with most matches over all its alignments."""
    m = table(spark, d, "read_match").where("read_index is not null and ref_read_index is not null")
    s = m.groupBy("read_index", "ref_read_index").agg(F.sum("align_nb_matches").alias("total"), F.min("reference_start").alias("start"), F.max("reference_end").alias("end"))
    return overlaps.best_mapping(s, "read_index", [F.desc_nulls_last("total"), F.asc("ref_read_index")])


@query("""with e as (select distinct ref_read_index, read_index, align_nb_matches - hang_left - hang_right s, unnest(range(reference_start, reference_end + 1)) p from read_match where ref_read_index is not null and read_index is not null and reference_start <= reference_end),
          t as (select *, row_number() over (partition by ref_read_index, p order by s desc nulls last, read_index) r from e)
          select distinct ref_read_index, read_index from t where r <= 20""")
def topk_per_position(spark, d):
    """Reads among the 20 best at some position of a reference."""
    m = table(spark, d, "read_match").withColumn("s", F.col("align_nb_matches") - F.col("hang_left") - F.col("hang_right"))
    return overlaps.top_along(m, "ref_read_index", "reference_start", "reference_end", "s", "read_index", 20)


@query("""with e as (select match_id, ref_read_index k, align_nb_matches s, unnest(range(reference_start, reference_end)) p from read_match where ref_read_index is not null and reference_start < reference_end),
          t as (select *, row_number() over (partition by k, p order by s desc nulls last, match_id) r from e)
          select distinct match_id from t where r <= 10""")
def coverage_bounded(spark, d):
    """Matches left when every position of a reference keeps its ten best."""
    m = table(spark, d, "read_match").where("ref_read_index is not null and reference_start < reference_end")
    return overlaps.thinned(m, "ref_read_index", "reference_start", "reference_end", "align_nb_matches", ["match_id"]).select("match_id")


@query("""with recursive b as (select * from (select *, row_number() over (partition by read_index, query_start, query_end order by align_nb_matches desc nulls last, match_id) r from read_match where read_index is not null and query_start < query_end) where r = 1),
          o as (select read_index, match_id, query_start s, query_end e, row_number() over (partition by read_index order by align_nb_matches desc nulls last, match_id) n from b),
          t(read_index, n, taken) as (select distinct read_index, 0::BIGINT, []::STRUCT(match_id BIGINT, s INT, e INT)[] from o
            union all select t.read_index, o.n, case when len(list_filter(taken, lambda x: least(x.e, o.e) - greatest(x.s, o.s) > 20)) = 0 then list_append(taken, {'match_id': o.match_id, 's': o.s, 'e': o.e}) else taken end from t join o on o.read_index = t.read_index and o.n = t.n + 1),
          l as (select read_index, max_by(taken, n) taken from t group by read_index)
          select read_index, unnest(taken).match_id as match_id from l""")
def disjoint_alignments(spark, d):
    """Each read's best matches that overlap by no more than 20 bases."""
    m = table(spark, d, "read_match")
    return overlaps.disjoint(m, "read_index", "query_start", "query_end", "align_nb_matches", ["match_id"], 20).select("read_index", "match_id")


@query("""select match_id, coalesce(least(query_end, pe) - greatest(query_start, ps) > 50, false) as overlaps, coalesce(query_start >= ps and query_end <= pe, false) as contained
          from (select *, lag(query_start) over w ps, lag(query_end) over w pe from read_match where read_index is not null window w as (partition by read_index order by query_start, query_end, match_id))""")
def alignment_overlaps(spark, d):
    """Whether each match of a read overlaps the one before it on the read, or lies within it."""
    w = Window.partitionBy("read_index").orderBy("query_start", "query_end", "match_id")
    m = table(spark, d, "read_match").where("read_index is not null").select("match_id", "query_start", "query_end", F.lag("query_start").over(w).alias("ps"), F.lag("query_end").over(w).alias("pe"))
    c = [F.col(x) for x in ("query_start", "query_end", "ps", "pe")]
    return m.select("match_id", seq.spans_overlap(*c, 50).alias("overlaps"), seq.span_within(*c).alias("contained"))


@query("""select read_id, case when any_value(length(seq)) < 160 then 1 else coalesce(sum(greatest(least(reference_end, length(seq) - 75) - greatest(reference_start, 75), 0)), 0) // any_value(length(seq)) end::BIGINT as coverage
          from reads left join (select * from read_match where reference_start < reference_end) on ref_read_index = read_id where length(seq) > 0 group by read_id""")
def base_coverage(spark, d):
    """Whole-numbered depth of each read away from its ends."""
    lengths = table(spark, d, "reads").where(F.length("seq") > 0).select(F.col("read_id").alias("ref_read_index"), F.length("seq").alias("length"))
    return intervals.inner_depth(table(spark, d, "read_match"), lengths, "ref_read_index", "reference_start", "reference_end").select(F.col("ref_read_index").alias("read_id"), "coverage")


@query("select ref_read_index, list_sort(list(align_length))[len(list(align_length)) // 10 + 1] as tenth from read_match where ref_read_index is not null and align_length is not null group by ref_read_index")
def tenth_percentile(spark, d):
    """The match length at a tenth of each reference's matches in order."""
    return intervals.tenth(table(spark, d, "read_match").where("ref_read_index is not null"), "ref_read_index", "align_length")


STEPS = """iv as (select ref_read_index k, reference_start s, reference_end e from read_match where ref_read_index is not null and reference_start < reference_end),
    ev as (select k, p, sum(d) d from (select k, s p, 1 d from iv union all select k, e, -1 from iv) group by all),
    st as (select k, p f, lead(p) over w t, sum(d) over w dp from ev window w as (partition by k order by p))"""


def steps_of(spark, d):
    return intervals.depth_steps(table(spark, d, "read_match"), "ref_read_index", "reference_start", "reference_end")


@query(f"with {STEPS} select k as ref_read_index, f as from_pos, t as to_pos, dp::BIGINT as depth from st where t is not null")
def interval_coverage(spark, d):
    """Depth of matches along each reference."""
    return steps_of(spark, d)


@query("""select r.read_id as ref_read_index, round(coalesce(sum(greatest(m.reference_end - m.reference_start, 0)), 0) / length(any_value(r.seq)), 6) as coverage
          from reads r left join read_match m on m.ref_read_index = r.read_id and m.reference_start < m.reference_end where length(r.seq) > 0 group by r.read_id""")
def contig_coverage(spark, d):
    """Mean depth of each reference over all its positions."""
    lengths = table(spark, d, "reads").where(F.length("seq") > 0).select(F.col("read_id").alias("ref_read_index"), F.length("seq").alias("length"))
    c = intervals.mean_depth(table(spark, d, "read_match"), lengths, "ref_read_index", "reference_start", "reference_end")
    return c.select("ref_read_index", F.round("coverage", 6).alias("coverage"))


@query(f"""with {STEPS}, kp as (select k, f, t, lag(t) over (partition by k order by f) pt from st where t is not null and dp >= 2),
          g as (select *, sum((pt is null or pt <> f)::INT) over (partition by k order by f) i from kp)
          select k as ref_read_index, min(f) as start, max(t) as "end" from g group by k, i""")
def coverage_regions(spark, d):
    """Stretches of each reference with depth 2 or more."""
    return intervals.regions(steps_of(spark, d), "ref_read_index", F.col("depth") >= 2)


@query("""select ref_read_index, case when a < 50 then 0 else a end as trim_start, case when n - b < 50 then n else b end as trim_end
          from (select ref_read_index, min(reference_start) a, max(reference_end) b from read_match group by 1) join (select read_id, length(seq) n from reads where seq is not null) on read_id = ref_read_index""")
def trim_ends(spark, d):
    """First and last covered position of each reference."""
    lengths = table(spark, d, "reads").where("seq is not null").select(F.col("read_id").alias("ref_read_index"), F.length("seq").alias("length"))
    return intervals.trim_ends(table(spark, d, "read_match"), lengths, "ref_read_index", "reference_start", "reference_end")


@query("""with c as (select r.read_id, length(any_value(r.seq)) n, coalesce(sum(greatest(m.reference_end - m.reference_start, 0)), 0) / length(any_value(r.seq)) cov
          from reads r left join read_match m on m.ref_read_index = r.read_id and m.reference_start < m.reference_end where length(r.seq) > 0 group by r.read_id)
          select read_id from c where not (cov <= 1 or n < 50 or (n < 7500 and cov < 4))""")
def contig_filter(spark, d):
    """References that pass the output filter of length and coverage."""
    lengths = table(spark, d, "reads").where(F.length("seq") > 0).select(F.col("read_id").alias("ref_read_index"), F.length("seq").alias("length"))
    c = intervals.mean_depth(table(spark, d, "read_match"), lengths, "ref_read_index", "reference_start", "reference_end").join(lengths, "ref_read_index")
    bad = (F.col("coverage") <= 1) | (F.col("length") < 50) | ((F.col("length") < 7500) & (F.col("coverage") < 4))
    return c.where(~bad).select(F.col("ref_read_index").alias("read_id"))


@query("select sum(length(seq))::BIGINT as size, count(seq) as n, count_if(length(seq) > 1000) as n_long, count_if(length(seq) > 1000 and starts_with(upper(seq), 'A')) as n_long_circular from reads")
def contig_stats(spark, d):
    """Size and counts of sequences; those beginning with A stand for circular ones."""
    r = table(spark, d, "reads").select(F.length("seq").alias("n"), F.upper("seq").startswith("A").alias("ring"))
    return stats.length_stats(r, "n", 1000, F.coalesce("ring", F.lit(False)))


BRIDGE = f"""fr as (select read_id, i as fragment, i * 200 as f_start, least(i * 200 + 199, length(seq) - 1) as f_end from (select read_id, seq, unnest(range(0, (length(seq) + 199) // 200)) i from reads where length(seq) > 0)),
    al as (select ref_read_index contig, match_id alignment, reference_start s, reference_end e from read_match where ref_read_index is not null),
    ht as (select contig, alignment, fragment from al join fr on contig = read_id where (s < f_start and e > f_end) or (s > f_start and s < f_end) or (e > f_start and e < f_end))"""


@query(f"with {BRIDGE} select contig, a.fragment as f1, b.fragment as f2, count(*) as n from ht a join ht b using (contig, alignment) where a.fragment < b.fragment group by all")
def bridging_reads(spark, d):
    """Alignments that touch both of two fragments of a read (fragments of 200 bases)."""
    r = table(spark, d, "reads").where(F.length("seq") > 0).select(F.col("read_id").alias("contig"), F.length("seq").alias("n"))
    cells = r.select("contig", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") + 199) / 200).cast("int") - 1)).alias("i"))
    parts = cells.select("contig", F.col("i").alias("fragment"), (F.col("i") * 200).alias("f_start"), F.least(F.col("i") * 200 + 199, F.col("n") - 1).alias("f_end"))
    al = table(spark, d, "read_match").where("ref_read_index is not null").select(F.col("ref_read_index").alias("contig"), F.col("match_id").alias("alignment"), F.col("reference_start").alias("start"), F.col("reference_end").alias("end"))
    return intervals.bridging_pairs(intervals.bridging(al, parts))


PAIRS = f"""{MREADS}, {TOP}, fl as (select read_id, list(v order by pos) ms, list(pos order by pos) ps from mz where v not in (select v from top) group by read_id),
    pr as (select read_id, i::INT i, ps[i + 1]::INT pos, ps[i + 2]::INT npos, least(ms[i + 1], ms[i + 2]) a, greatest(ms[i + 1], ms[i + 2]) b, ms[i + 1] >= ms[i + 2] rev from (select *, unnest(range(0, len(ms) - 1)) i from fl))"""


def pairs_of(spark, d):
    return assembly.read_anchors(materialize(mreads_of(spark, d).select("read_id", "minimizers", "pos")))


@query(f"with {PAIRS} select p.read_id as query, q.read_id as reference, count(*) as anchors, sum((p.rev = q.rev)::INT)::BIGINT as same_strand from pr p join pr q using (a, b) where p.read_id < q.read_id group by all having count(*) >= 3")
def pair_selfjoin(spark, d):
    """Pairs of reads with at least three common minimizer pairs."""
    p = pairs_of(spark, d)
    found = overlaps.anchors(p, p).where("query < reference").groupBy("query", "reference").agg(F.count("*").alias("anchors"), F.count_if("same_strand").alias("same_strand"))
    return found.where("anchors >= 3")


#: Pairs of neighbouring minimizers of unitigs: name, i, a, b, rev.
UNITIG_PAIRS = f"{UNITIGS}, up as (select minimizers as name, i::INT i, least(minimizers[i + 1], minimizers[i + 2]) a, greatest(minimizers[i + 1], minimizers[i + 2]) b, minimizers[i + 1] >= minimizers[i + 2] rev from (select minimizers, unnest(range(0, len(minimizers) - 1)) i from un))"
READ_PAIRS = "rp as (select read_id, i::INT i, least(ms[i + 1], ms[i + 2]) a, greatest(ms[i + 1], ms[i + 2]) b, ms[i + 1] >= ms[i + 2] rev from (select *, unnest(range(0, len(ms) - 1)) i from mr))"


def unitig_pairs(spark, d):
    u = unitigs_of(spark, d)
    return overlaps.pair_rows(u.select("unitig", "minimizers", F.transform("minimizers", lambda _, i: i).alias("pos")), "unitig")


def read_pairs(spark, d):
    return overlaps.pair_rows(mreads_of(spark, d).select("read_id", "minimizers", F.transform("minimizers", lambda _, i: i).alias("pos")))


@query(f"with recursive {UNITIG_PAIRS}, {READ_PAIRS} select p.read_id as query, q.name as reference, p.i as q_i, q.i as r_i, p.rev = q.rev as same_strand from rp p join up q using (a, b)")
def read_contig_anchors(spark, d):
    """Anchors of all reads on the unitigs, in minimizer space."""
    found = overlaps.anchors(materialize(read_pairs(spark, d)), materialize(unitig_pairs(spark, d)), "read_id", "unitig")
    return found.select("query", "reference", "q_i", "r_i", "same_strand")


@query(f"with recursive {UNITIG_PAIRS} select p.name as query, q.name as reference, count(*) as anchors from up p join up q using (a, b) where len(p.name) < 8 and len(q.name) >= 8 group by all")
def small_vs_long(spark, d):
    """Anchors of short unitigs on long ones."""
    p = materialize(unitig_pairs(spark, d))
    n = F.size("unitig")
    return overlaps.anchors(p.where(n < 8), p.where(n >= 8), "unitig", "unitig").groupBy("query", "reference").agg(F.count("*").alias("anchors"))


def _parts_sql(k, source="un", name="minimizers"):
    return f"(select {name} as name, {name} as m, i, least({name}[i + 1 : i + {k}], list_reverse({name}[i + 1 : i + {k}])) x, not ({name}[i + 1 : i + {k}] < list_reverse({name}[i + 1 : i + {k}])) rev from (select {name}, unnest(range(0, len({name}) - {k - 1})) i from {source}))"


@query(f"with recursive {UNITIGS}, x as (select name, x, count(*) n from {_parts_sql(K - 1)} group by all) select p.name as a, q.name as b, sum(p.n * q.n)::BIGINT as n from x p join x q using (x) where p.name <> q.name and len(q.name) >= len(p.name) group by all")
def contig_overlap_join(spark, d):
    """(k-1)-min-mers that unitigs share with others at least as long."""
    u = unitigs_of(spark, d)
    rows = materialize(km.kminmer_rows(u, K - 1, "unitig").withColumnRenamed("unitig", "contig"))
    return overlaps.shared_kminmers(rows, rows, u.select(F.col("unitig").alias("contig"), F.size("unitig").alias("n_min")))


@query(f"with {MREADS}, p as (select distinct ref_read_index a, read_index b from read_match), s as (select read_id, list_sort(list_distinct(ms)) xs from mr), j as (select a, b, x.xs, y.xs ys, least(x.xs[len(x.xs)], y.xs[len(y.xs)]) stop from p join s x on x.read_id = a join s y on y.read_id = b) select a, b, len(list_intersect(xs, ys))::INT as shared, round(1 - len(list_intersect(xs, ys)) / len(list_distinct(list_concat(xs, ys))), 6) as distance, round(1 - len(list_intersect(xs, ys)) / len(list_filter(list_distinct(list_concat(xs, ys)), lambda v: v <= stop)), 6) as distance_early from j")
def jaccard_neighbors(spark, d):
    """Jaccard distance of the minimizer sets of matched reads."""
    sets = mreads_of(spark, d).where(F.size("minimizers") > 0).select(F.col("read_id").alias("id"), F.array_distinct("minimizers").alias("xs"))
    pairs = table(spark, d, "read_match").select(F.col("ref_read_index").alias("a"), F.col("read_index").alias("b"))
    j = overlaps.jaccard_of_pairs(pairs, sets)
    return j.select("a", "b", "shared", F.round("distance", 6).alias("distance"), F.round("distance_early", 6).alias("distance_early"))


@query(f"with recursive {UNITIGS} select minimizers as unitig, round(list_avg(abundances), 6) as mean_abundance, abundance as median_abundance from un")
def unitig_abundance(spark, d):
    """Mean and median abundance of the k-min-mers of each unitig."""
    u = unitigs_of(spark, d)
    mean = F.aggregate("abundances", F.lit(0.0), lambda acc, x: acc + x) / F.size("abundances")
    return u.select("unitig", F.round(mean, 6).alias("mean_abundance"), F.col("abundance").alias("median_abundance"))


OWNER = f"{UNITIGS}, ow as (select x km, min(name) unitig from {_parts_sql(K)} group by x), lb as (select read_id, i, unitig from km left join ow using (km))"


def labelled(spark, d):
    """Each read's k-min-mers with the unitig that has them."""
    u = unitigs_of(spark, d).withColumn("node", F.col("unitig"))
    return materialize(assembly.unitig_labels(rows_of(spark, d), u, K))


@query(f"with recursive {OWNER} select read_id, i::INT as i, unitig from lb where unitig is not null")
def kminmer_to_unitig(spark, d):
    return labelled(spark, d).where("unitig is not null")


FRAGMENTS = "ch as (select read_id, i, (coalesce(unitig::VARCHAR, '') <> lag(coalesce(unitig::VARCHAR, '')) over w and i <> max(i) over (partition by read_id))::INT c from lb window w as (partition by read_id order by i)), fg as (select read_id, i, sum(coalesce(c, 0)) over (partition by read_id order by i) f from ch), fr as (select read_id, min(i) a, max(i) b from fg group by read_id, f)"


@query(f"with recursive {OWNER}, {FRAGMENTS} select read_id, a::INT as frag_start, b::INT as frag_end from fr")
def fragments(spark, d):
    """Runs of k-min-mers of one unitig along each read."""
    return intervals.fragments(labelled(spark, d), "read_id", "i", "unitig")


@query(f"with recursive {OWNER}, {FRAGMENTS}, ab as (select read_id, i, coalesce(abundance, 1) v from km left join sc using (km)) select fr.read_id, a::INT as frag_start, b::INT as frag_end, round(avg(v), 6) as coverage from fr join ab on ab.read_id = fr.read_id and i between a and b group by all")
def fragment_coverage(spark, d):
    """Mean abundance of each fragment."""
    rows = materialize(rows_of(spark, d))
    ab = km.path_abundances(rows, km.solid(km.kminmer_counts(rows)), "read_id")
    return ab.join(fragments(spark, d), "read_id").where(F.col("i").between(F.col("frag_start"), F.col("frag_end"))).groupBy("read_id", "frag_start", "frag_end").agg(F.round(F.avg("abundance"), 6).alias("coverage"))


@query(f"with recursive {OWNER}, lp as (select *, lag(unitig) over (partition by read_id order by i) p from lb where unitig is not null) select read_id, i::INT as i, unitig from lp where p is null or p <> unitig")
def graph_path(spark, d):
    """Each read as a path of unitigs, without repeats of the previous one."""
    return intervals.run_deduplicated(labelled(spark, d), "read_id", "i", "unitig")


@query(f"with recursive {OWNER} select unitig, read_id, round(min(i) / greatest(max(max(i)) over (partition by read_id), 1), 6) as position from lb where unitig is not null group by unitig, read_id")
def map_to_graph(spark, d):
    """How far along each read its unitigs lie."""
    return assembly.colours(labelled(spark, d)).withColumn("position", F.round("position", 6))


RUNS = f"""{UNITIGS}, x as {_parts_sql(K - 1)},
    hit as (select p.name a, q.name b, p.rev = q.rev same, p.i x, q.i y, len(p.name) - {K - 1} la, len(q.name) - {K - 1} lb from x p join x q using (x) where p.name < q.name),
    dg as (select *, case when same then y - x else y + x end g from hit), gr as (select *, x - row_number() over (partition by a, b, same, g order by x) r from dg),
    rn as (select a, b, same, min(x)::INT as start, max(x)::INT as stop, min(y)::INT as q_start, count(*) as n, la, lb from gr group by a, b, same, g, r, la, lb)"""


@query(f"with recursive {RUNS} select a, b, same, start, stop as \"end\", q_start, n from rn where start = 0 or stop = la or q_start = 0 or q_start + stop - start = lb")
def end_overlap_runs(spark, d):
    """Diagonal runs of common (k-1)-min-mers of unitigs, on either strand, that touch an end."""
    u = unitigs_of(spark, d)
    rows = materialize(km.kminmer_rows(u, K - 1, "unitig").withColumn("last", F.size("unitig") - (K - 1)))
    p = rows.select(F.col("unitig").alias("a"), F.col("i").alias("ref_pos"), "km", F.col("is_rev").alias("ra"), F.col("last").alias("la"))
    q = rows.select(F.col("unitig").alias("b"), F.col("i").alias("query_pos"), "km", F.col("is_rev").alias("rb"), F.col("last").alias("lb"))
    hits = materialize(p.join(q, "km").where("a < b").withColumn("same", F.col("ra") == F.col("rb")))
    keys = ["a", "b", "same", "la", "lb"]
    runs = intervals.diagonal_runs(hits.where("same"), keys).unionByName(intervals.diagonal_runs(hits.where("not same"), keys, step=-1))
    return intervals.end_runs(runs, "la", "lb").drop("la", "lb")


WAYS = "ww as (select km, false rev, km p from sc union all select km, true, list_reverse(km) from sc where km <> list_reverse(km))"
EDGES = f"{SOLID}, {WAYS}, ed as (select x.km src, x.rev src_rev, y.km dst, y.rev dst_rev from ww x join ww y on x.p[2 : {K}] = y.p[1 : {K - 1}] where x.km <> y.km or x.rev = y.rev)"


def solid_nodes(spark, d):
    """Solid k-min-mers as nodes that are their own ids."""
    return km.solid(km.kminmer_counts(rows_of(spark, d))).select(F.col("km").alias("node"), F.col("km").alias("minimizers"), F.array("abundance").alias("abundances"))


@query(f"with {EDGES} select src, src_rev, dst, dst_rev from ed")
def dbg_edges(spark, d):
    """Oriented edges between solid k-min-mers."""
    return graph.oriented_edges(solid_nodes(spark, d), K - 1)


@query(f"with {EDGES} select src as node, src_rev as rev, count(*) as n_succ from ed group by all")
def node_degrees(spark, d):
    return graph.degrees(graph.oriented_edges(solid_nodes(spark, d), K - 1))


@query(f"with recursive {UNITIG_EDGES} select distinct minimizers as unitig, circular, exists (select 1 from ue where src = minimizers and dst = minimizers and src_rev = dst_rev) as follows_itself from un where circular or exists (select 1 from ue where src = minimizers and dst = minimizers)")
def circular_unitigs(spark, d):
    """Unitigs that are rings or follow themselves."""
    u = unitigs_of(spark, d).withColumn("node", F.col("unitig"))
    return graph.rings(u, graph.oriented_edges(u, K - 1)).select(F.col("node").alias("unitig"), "circular", "follows_itself")


@query(f"with {SOLID}, {kminmers(K + 1, 'kn')}, nx as (select distinct km from kn) select km from nx where least(km[1 : {K}], list_reverse(km[1 : {K}])) in (select km from sc) and least(km[2 : {K + 1}], list_reverse(km[2 : {K + 1}])) in (select km from sc)")
def supported_edges(spark, d):
    """(k+1)-min-mers both of whose parts are solid."""
    sc = km.solid(km.kminmer_counts(rows_of(spark, d)))
    return km.all_parts_solid(rows_of(spark, d, K + 1).select("km").distinct(), sc, K)


@query(f"with recursive {UNITIGS}, {kminmers(K + 1, 'kn')} select minimizers as unitig from un where len(minimizers) > {K} and minimizers not in (select name from {_parts_sql(K + 1)} where x not in (select km from kn))")
def unsupported_unitigs(spark, d):
    """Unitigs that stay when those with any (k+1)-min-mer that no read has go."""
    u = unitigs_of(spark, d).where(F.size("unitig") > K).withColumn("node", F.col("unitig"))
    return graph.supported(u, rows_of(spark, d, K + 1).select("km").distinct(), K + 1).select("unitig")


@query(f"with {MREADS} select read_id, ms as minimizers from mr where len(ms) >= {K}")
def path_to_minimizers(spark, d):
    """Minimizer sequences spelled from paths of k-min-mers."""
    return km.spelled_paths(rows_of(spark, d))


@query(f"with recursive {UNITIGS} select row_number() over (order by minimizers) - 1 as id, 'utg' || (row_number() over (order by minimizers) - 1) as name, minimizers as unitig from un")
def unitig_ids(spark, d):
    """Unitigs numbered in order, with their names."""
    ids = graph.ordered_ids(unitigs_of(spark, d).select("unitig"), ["unitig"])
    return ids.select("id", graph.unitig_name(F.col("id")).alias("name"), "unitig")


GFA_SQL = f"{EDGES}, nn as (select km, abundance, row_number() over (order by km) - 1 id from sc)"


def gfa_lines(spark, d):
    sc = km.solid(km.kminmer_counts(rows_of(spark, d)))
    named = materialize(graph.ordered_ids(sc, ["km"])).select(F.concat(F.lit("utg"), F.col("id").cast("string")).alias("name"), "km", "abundance")
    e = graph.oriented_edges(named.select(F.col("name").alias("node"), F.col("km").alias("minimizers")), K - 1)
    segments = named.select("name", F.lit(None).cast("string").alias("seq"), F.lit(K).alias("length"), F.col("abundance").alias("depth"))
    return gfa.segment_lines(segments).unionByName(gfa.link_lines(e.withColumn("overlap", F.lit(K - 1))))


@query(f"with {GFA_SQL} select 'S' || chr(9) || 'utg' || id || chr(9) || '*' || chr(9) || 'LN:i:{K}' || chr(9) || 'dp:i:' || abundance as line from nn union all select 'L' || chr(9) || 'utg' || a.id || chr(9) || case when src_rev then '-' else '+' end || chr(9) || 'utg' || b.id || chr(9) || case when dst_rev then '-' else '+' end || chr(9) || '{K - 1}M' from ed join nn a on src = a.km join nn b on dst = b.km")
def gfa_export(spark, d):
    """The solid graph as GFA lines."""
    return gfa_lines(spark, d)


@query(f"with {GFA_SQL} select 'utg' || a.id as name, abundance as depth, count(src) as n_links from nn a left join ed on src = a.km group by all")
def gfa_parse(spark, d):
    """Segments read back from GFA lines, with their links."""
    lines = gfa_lines(spark, d).withColumnRenamed("line", "value")
    links = gfa.parse_links(lines).groupBy(F.col("src").alias("name")).agg(F.count("*").alias("n"))
    return gfa.parse_segments(lines).join(links, "name", "left").select("name", "depth", F.coalesce("n", F.lit(0)).alias("n_links"))


@query("select '>' || printf('ctg%d length=%d coverage=%.2f circular=%s', read_id, length(seq), 1.0, 'no') || chr(10) || seq as value from reads where length(seq) >= 50")
def contigs_fasta(spark, d):
    """FASTA records with contig headers."""
    r = table(spark, d, "reads").where(F.length("seq") >= 50)
    return fastx.fasta_lines(r.select(seq.contig_header(F.col("read_id"), F.length("seq"), F.lit(1.0), F.lit(False)).alias("header"), "seq"))


@query(f"with {MREADS}, sl as (select 'short' src, read_id, ms from mr where len(ms) < 20 union all select 'long', read_id, ms from mr where len(ms) >= 20) select src, count(*) as n, sum(len(ms))::BIGINT as n_minimizers from sl group by src")
def union_small_long(spark, d):
    """Small and long sequences of several passes as one set."""
    m = mreads_of(spark, d).where(F.size("minimizers") > 0).select("minimizers")
    short = m.where(F.size("minimizers") < 20).select(F.lit("short").alias("src"), "minimizers")
    long = m.where(F.size("minimizers") >= 20).select(F.lit("long").alias("src"), "minimizers")
    return short.unionByName(long).groupBy("src").agg(F.count("*").alias("n"), F.sum(F.size("minimizers")).alias("n_minimizers"))


@query(f"with {MREADS}, p as (select distinct ref_read_index a, read_index b from read_match where ref_read_index <> read_index) select a, b, coalesce(list_max(list_filter(range(1, least(len(x.ms), len(y.ms)) + 1), lambda n: x.ms[len(x.ms) - n + 1 : len(x.ms)] = y.ms[1 : n])), 0)::INT as overlap from p join mr x on x.read_id = a join mr y on y.read_id = b")
def array_overlap(spark, d):
    """Longest suffix of a matched read's minimizers that begins the other's."""
    m = mreads_of(spark, d).where(F.size("minimizers") > 0).select("read_id", "minimizers")
    pairs = table(spark, d, "read_match").where("ref_read_index <> read_index").select(F.col("ref_read_index").alias("a"), F.col("read_index").alias("b")).distinct()
    both = pairs.join(m.select(F.col("read_id").alias("a"), F.col("minimizers").alias("x")), "a").join(m.select(F.col("read_id").alias("b"), F.col("minimizers").alias("y")), "b")
    return both.select("a", "b", seq.longest_overlap(F.col("x"), F.col("y")).alias("overlap"))


@query("""with t as (select rec_id, list_concat(km, km[1 : 2]) a from km_abundance where len(km) > 2),
          b as (select rec_id, a, coalesce(list_max(list_filter(range(1, len(a)), lambda n: a[1 : n] = a[len(a) - n + 1 : len(a)])), 0) b from t),
          h as (select rec_id, a, case when b > len(a) / 2 then b // 2 else b end b from b)
          select rec_id, case when b > 1 then a[1 : len(a) - (b - 1)] else a end as trimmed from h""")
def self_overlap_trim(spark, d):
    """Arrays that end as they begin, with the repeated end trimmed."""
    r = table(spark, d, "km_abundance").where(F.size("km") > 2).select("rec_id", F.concat("km", F.slice("km", 1, 2)).alias("a"))
    return r.select("rec_id", seq.self_overlap_trimmed(F.col("a")).alias("trimmed"))


@query("""with recursive e as (select distinct ref_read_index a, read_index b from read_match where ref_read_index is not null and read_index is not null and ref_read_index <> 4294967295 and read_index <> 4294967295),
          l as (select a, b from e union select b, a from e), t as (select min(a) node, 0 dist from l union select b, dist + 1 from t join l on a = node where dist < 3)
          select node, min(dist) as dist from t group by node""")
def bfs_neighbors(spark, d):
    """Reads within three matches of the smallest matched read."""
    e = table(spark, d, "read_match").where("ref_read_index is not null and read_index is not null and ref_read_index <> 4294967295 and read_index <> 4294967295").select(F.col("ref_read_index").alias("src"), F.col("read_index").alias("dst"))
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return graph.neighbourhood(both, both.agg(F.min("src").alias("node")), 3)


@query(f"with recursive {UNITIGS} select minimizers, abundances, abundance, circular from un")
def unitigs(spark, d):
    """Maximal unbranched paths of the graph, rings included."""
    return unitigs_of(spark, d).select("minimizers", "abundances", "abundance", "circular")


@query(f"with recursive {UNITIG_EDGES} select src, src_rev, dst, dst_rev from ue")
def unitig_edges(spark, d):
    """Oriented edges between unitigs, named by their minimizers."""
    return graph.oriented_edges(unitigs_of(spark, d).select(F.col("unitig").alias("node"), "minimizers"), K - 1)


@query(f"with recursive {UNITIGS}, e as (select unnest([minimizers[1 : {K - 1}], minimizers[len(minimizers) - {K - 2} : len(minimizers)]]) e from un) select distinct least(e, list_reverse(e)) as edge from e")
def end_edges(spark, d):
    """The distinct ends of unitigs."""
    return graph.end_edges(unitigs_of(spark, d), K - 1)


TIPS = f"""{UNITIG_EDGES}, tip as (select name, rev, len(name) n, abundance from uw where len(name) <= 50 and not exists (select 1 from ue where src = name and src_rev = rev)),
    hg as (select ue.*, tip.n, row_number() over (partition by src, src_rev order by tip.n is not null, tip.n desc, abundance desc, dst, dst_rev) r, count(*) over (partition by src, src_rev) c from ue left join tip on dst = name and dst_rev = rev)"""


@query(f"with recursive {TIPS} select distinct dst as unitig from hg where c > 1 and r > 1 and n is not null")
def tips(spark, d):
    """Unitigs that one round of tip clipping removes."""
    u = unitigs_of(spark, d).withColumn("node", F.col("unitig"))
    return graph.tips(u, graph.oriented_edges(u, K - 1), 50).select(F.col("node").alias("unitig"))


SIMPLE = f"""{UNITIG_EDGES}, one as (select src as name, src_rev as rev from ue group by all having count(*) = 1), inn as (select o.name, o.rev from one o join one p on o.name = p.name and o.rev <> p.rev),
    sd as (select i.src s, i.src_rev sr, o.dst t, o.dst_rev tr, inn.name, un.abundance from inn join ue i on i.dst = inn.name and i.dst_rev = inn.rev join ue o on o.src = inn.name and o.src_rev = inn.rev join un on un.minimizers = inn.name where len(inn.name) <= 50),
    rk as (select *, row_number() over (partition by s, sr, t, tr order by abundance desc, len(name) desc, name) r from sd where s < t or (s = t and sr <= tr))"""


@query(f"with recursive {SIMPLE} select distinct name as unitig from rk where r > 1")
def simple_bubbles(spark, d):
    """Unitigs that popping the bubbles of single unitigs removes."""
    u = unitigs_of(spark, d).withColumn("node", F.col("unitig"))
    return graph.simple_bubbles(u, graph.oriented_edges(u, K - 1), 50).select(F.col("node").alias("unitig"))


@query()
def superbubbles(spark, d):
    """Unitigs that one round of collapsing superbubbles to their heaviest way removes."""
    u = unitigs_of(spark, d)
    gone = graph.lost_sides(u, materialize(graph.oriented_edges(u, K - 1)), K - 1, 50)
    return u.join(gone, "node", "left_semi").select("unitig", "abundance")


@query()
def abundance_cutoffs(spark, d):
    """States of the graph as its weakest nodes are removed."""
    return graph.progressive(graph_of(spark, d), K - 1, 50).select("cutoff", "minimizers", "abundance", "circular")


@query()
def graph_contigs(spark, d):
    """Contigs chosen from the states of the graph."""
    return graph.states(graph_of(spark, d), K - 1, 50, kinds=("contig",)).select("cutoff", "minimizers", "abundance", "circular")


SHOTS = f"sh as (select ms, (read_id % 7)::DOUBLE cutoff, len(ms)::DOUBLE abundance from mr where len(ms) >= {K})"


@query(f"""with recursive {MREADS}, {SHOTS}, fit as (select *, row_number() over (order by cutoff desc, ms) n from (select distinct * from sh where abundance >= cutoff * 2)),
          pt as (select n, least(w, list_reverse(w)) w from (select n, ms[i + 1 : i + {K}] w from (select n, ms, unnest(range(0, len(ms) - {K - 1})) i from fit))),
          cf as materialized (select f.n, coalesce(list(distinct o.n) filter (where o.n is not null), []) before from fit f left join pt p on p.n = f.n left join pt o on o.w = p.w and o.n < p.n group by f.n),
          t(n, taken) as (select 0::BIGINT, []::BIGINT[] union all select cf.n, case when list_has_any(cf.before, taken) then taken else list_append(taken, cf.n) end from t join cf on cf.n = t.n + 1),
          ok as (select unnest(taken) n from t where n = (select max(n) from t))
          select cutoff, ms as minimizers, abundance from fit join ok using (n)""")
def select_contigs(spark, d):
    """Contigs from snapshots, strictest first; the reads' minimizers stand as unitigs of seven cutoffs."""
    m = mreads_of(spark, d).where(F.size("minimizers") >= K)
    shots = m.select((F.col("read_id") % 7).cast("double").alias("cutoff"), "minimizers", F.size("minimizers").cast("double").alias("abundance")).distinct()
    return graph.select_contigs(materialize(shots), K).select("cutoff", "minimizers", "abundance")


@query(f"""with {SOLID}, ct as (select len(ms) n, (read_id % 3 + 1)::BIGINT a, unnest(range(0, len(ms) - {K - 1})) i, ms from mr),
          bs as (select least(w, list_reverse(w)) km, max(a) a from (select ms[i + 1 : i + {K}] w, case when n > {K} then greatest(a, 2) else a end a from ct) group by 1)
          select km, case when a = 1 then 0 else coalesce(a, abundance) end as abundance from sc left join bs using (km)""")
def refine(spark, d):
    """Abundances of the solid k-min-mers after those of contigs are written back; the reads stand as contigs."""
    m = materialize(mreads_of(spark, d).select("read_id", "minimizers"))
    solid = km.solid(km.kminmer_counts(km.kminmer_rows(m, K)))
    return assembly.refined(solid, m.select("minimizers", (F.col("read_id") % 3 + 1).cast("double").alias("abundance")), K)


@query()
def next_k_graph(spark, d):
    """Simplified unitigs of the next k, over reads and the contigs before."""
    p = assembly.Parameters(density=DENSITY, compress=False, platform="hifi")
    m = materialize(mreads_of(spark, d).select("read_id", "minimizers"))
    solid, _, contigs = assembly.one_pass(m, K, p)
    more = m.select("minimizers").unionByName(contigs.select("minimizers")).withColumn("read_id", F.monotonically_increasing_id())
    return assembly.one_pass(more, K + 1, p, solid)[1].select("minimizers", "abundance", "circular")


#: Chains by recursion: cg (query, reference, same, rs, ws, ra, qa), bc (.., sc, members 1-based).
CHAINED = f"""{PAIRS},
    ac as (select p.read_id qu, q.read_id re, p.rev = q.rev same, q.pos r, case when p.rev = q.rev then p.pos else -p.npos end w, q.i ra, case when p.rev = q.rev then p.i else p.i + 1 end qa from pr p join pr q using (a, b) where p.read_id <> q.read_id),
    cg as (select qu, re, same, list(r order by r, w) rs, list(w order by r, w) ws, list(ra order by r, w) ra, list(qa order by r, w) qa from ac group by qu, re, same having count(*) >= 3),
    dp(qu, re, same, n, sc, bf) as (select qu, re, same, 1, [20], [0] from cg union all
        select qu, re, same, n + 1, list_append(sc, case when -b.m > 20 then -b.m else 20 end), list_append(bf, case when -b.m > 20 then b.j else 0 end) from (
        select dp.*, list_min(list_transform(list_filter(range(greatest(1, n - 9), n + 1), lambda j: rs[n + 1] > rs[j] and ws[n + 1] > ws[j] and rs[n + 1] - rs[j] <= 5000 and ws[n + 1] - ws[j] <= 5000 and abs((rs[n + 1] - rs[j]) - (ws[n + 1] - ws[j])) <= 100),
            lambda j: {{'m': -(sc[j] + 20 - abs((rs[n + 1] - rs[j]) - (ws[n + 1] - ws[j]))), 'j': j}})) b from dp join cg using (qu, re, same) where n < len(rs))),
    en as (select dp.*, list_position(sc, list_max(sc)) e from dp join cg using (qu, re, same) where n = len(rs)),
    bk(qu, re, same, e, ms) as (select qu, re, same, e::BIGINT, [e::BIGINT] from en union all select bk.qu, bk.re, bk.same, en.bf[bk.e]::BIGINT, list_prepend(en.bf[bk.e]::BIGINT, ms) from bk join en using (qu, re, same) where en.bf[bk.e] > 0),
    bc as (select en.qu, en.re, en.same, list_max(en.sc) sc, max_by(ms, len(ms)) ms from bk join en using (qu, re, same) group by en.qu, en.re, en.same, en.sc),
    ch as (select bc.*, list_transform(ms, lambda m: rs[m]) rs, list_transform(ms, lambda m: abs(ws[m])) ws, list_transform(ms, lambda m: ra[m]) ra, list_transform(ms, lambda m: qa[m]) qa from bc join cg using (qu, re, same) where len(ms) >= 3)"""


def chained_of(spark, d):
    p = pairs_of(spark, d)
    return align.chained(overlaps.anchors(p, p, exclude_self=True), 3)


@query(f"with recursive {CHAINED} select qu as query, re as reference, same as same_strand, sc::FLOAT as score, len(ms)::INT as n_anchors, list_min(rs)::INT as r_start, list_max(rs)::INT as r_end, list_min(ws)::INT as q_start, list_max(ws)::INT as q_end from ch")
def chain_anchors(spark, d):
    """Best chain of three anchors or more of every two reads on either strand."""
    return chained_of(spark, d).drop("r_at", "q_at")


ALIGNED = f"""{CHAINED}, st as (select ch.*, list_transform(range(2, len(ra) + 1), lambda i: ra[i] - ra[i - 1] - 1) gr, list_transform(range(2, len(qa) + 1), lambda i: abs(qa[i] - qa[i - 1]) - 1) gq from ch),
    sz as (select read_id, len(ms) n, length(seq) l from (select read_id, list(v) ms from mz where v not in (select v from top) group by read_id) join reads using (read_id)),
    al as (select qu, re, same, len(ra) mt, coalesce(list_sum(list_transform(list_zip(gr, gq), lambda g: least(g[1], g[2]))), 0) + least(ra[1], case when same then qa[1] else q.n - 1 - qa[1] end) + least(r.n - 1 - ra[len(ra)], case when same then q.n - 1 - qa[len(qa)] else qa[len(qa)] end) mi,
        coalesce(list_sum(list_transform(list_zip(gr, gq), lambda g: greatest(g[2] - g[1], 0))), 0) ins, coalesce(list_sum(list_transform(list_zip(gr, gq), lambda g: greatest(g[1] - g[2], 0))), 0) del, list_max(rs) - list_min(rs) len,
        greatest(least(list_min(rs), case when same then list_min(ws) else q.l - list_max(ws) - {LENGTH} end), 0) hs, greatest(least(r.l - list_max(rs) - {LENGTH}, case when same then q.l - list_max(ws) - {LENGTH} else list_min(ws) end), 0) he
        from st join sz q on q.read_id = qu join sz r on r.read_id = re),
    ai as (select *, pow(mt / (mt + mi + least(ins, del)), 1.0 / {LENGTH}) idn from al)"""


def alignments_of(spark, d):
    m = materialize(mreads_of(spark, d).select("read_id", "minimizers", "pos", "read_len"))
    kept = materialize(minimize.without_repetitive(m, minimize.repetitive_minimizers(materialize(minimize.minimizer_counts(m)))))
    p = materialize(overlaps.pair_rows(kept))
    sizes = kept.select(F.col("read_id").alias("query"), F.col("read_len").alias("query_len"), F.size("minimizers").alias("query_n"))
    return align.chain_alignments(align.chained(overlaps.anchors(p, p, exclude_self=True), 3), sizes, LENGTH)


@query(f"with recursive {ALIGNED} select qu as query, re as reference, same as same_strand, mt::INT as matches, mi::INT as mismatches, ins::INT as insertions, del::INT as deletions, len::INT as align_length, round(idn, 6) as identity, hs::INT as hang_start, he::INT as hang_end from ai")
def chain_alignments(spark, d):
    """What each chain says of its alignment: columns, identity, overhangs."""
    names = ["query", "reference", "same_strand", "matches", "mismatches", "insertions", "deletions", "align_length", "hang_start", "hang_end"]
    return alignments_of(spark, d).select(*names, F.round("identity", 6).alias("identity"))


@query(f"with recursive {ALIGNED} select qu as query, re as reference, same as same_strand from ai where mt >= 4 and hs <= 1000 and he <= 1000 and len >= 200 and idn >= 0.96")
def correcting_alignments(spark, d):
    """Alignments that may correct a read: 200 bases or more of identity 0.96."""
    return align.good_alignments(alignments_of(spark, d), 200).select("query", "reference", "same_strand")


@query()
def correct_reads(spark, d):
    """Reads corrected from the reads that overlap them well."""
    p = assembly.Parameters(density=DENSITY, compress=False, min_overlap=200)
    m = materialize(mreads_of(spark, d))
    return align.corrected_reads(m, assembly.find_neighbours(m, p))


@query()
def suspect_reads(spark, d):
    """Reads with an inner stretch that no other read covers."""
    r = reads_of(spark, d).where("seq is not null and seq <> ''").select(F.col("read_id").alias("id"), "seq")
    among = materialize(cleaning.mapped(r, r, LENGTH, DENSITY, itself=True))
    lying = among.select(F.col("reference").alias("read_id"), F.col("r_start").alias("start"), (F.col("r_end") + LENGTH).alias("end"))
    return cleaning.suspect_reads(lying, r.select(F.col("id").alias("read_id"), F.length("seq").alias("length")), low=0)


@query()
def self_overlaps(spark, d):
    """Reads whose end repeats their beginning."""
    return cleaning.self_overlaps(reads_of(spark, d).where("seq is not null").select(F.col("read_id").alias("id"), "seq"), LENGTH, DENSITY)


@query(f"with {COMPLEXITY}, mx as (select read_id, max(sc) m from sw group by read_id), cv as (select ref_read_index read_id, count(*) c from read_match group by 1) select r.read_id from reads r left join mx using (read_id) left join cv using (read_id) where seq is not null and not (coalesce(m, 0) > 8 and coalesce(c, 0) < 6 and length(seq) < 50000)")
def low_complexity_contigs(spark, d):
    """Sequences that stay when weakly covered, short ones of low complexity go; the reads stand as contigs."""
    depth = table(spark, d, "read_match").groupBy(F.col("ref_read_index").alias("contig")).agg(F.count("*").alias("coverage"))
    c = table(spark, d, "reads").where("seq is not null").select(F.col("read_id").alias("contig"), "seq").join(depth, "contig", "left").withColumn("coverage", F.coalesce("coverage", F.lit(0)))
    return cleaning.without_low_complexity(c).select(F.col("contig").alias("read_id"))


@query("select read_id, case when read_id in (select ref_read_index from read_match where ref_read_index is not null) then coalesce(seq, '') else '' end as seq from reads")
def rewrite_contigs(spark, d):
    """Sequences with the letters of those that aren't a reference of a match emptied."""
    c = table(spark, d, "reads").select(F.col("read_id").alias("contig"), "seq")
    valid = table(spark, d, "read_match").where("ref_read_index is not null").select(F.col("ref_read_index").alias("contig"))
    return cleaning.rewritten(c, valid).select(F.col("contig").alias("read_id"), "seq")


NEAR = f"""{UNITIG_EDGES}, li as (select distinct src, dst from ue),
    nb(node, source, dist, own) as (select minimizers, minimizers, 0::BIGINT, abundance from un union
        select li.dst, nb.source, nb.dist + len(li.dst) - {K - 1}, nb.own from nb join li on li.src = nb.node join un on un.minimizers = li.dst where un.abundance > 2 and un.abundance >= 0.5 * nb.own and nb.dist + len(li.dst) - {K - 1} <= 40)"""


@query(f"with recursive {NEAR} select node, source, min(dist)::INT as dist from nb group by all")
def abundant_neighbors(spark, d):
    """Unitigs of similar abundance within 40 minimizers of each."""
    u = unitigs_of(spark, d).withColumn("node", F.col("unitig"))
    return graph.abundant_neighbourhood(u, graph.oriented_edges(u, K - 1), u.select("node"), 40, K - 1)


@query()
def repetitive_contigs(spark, d):
    """Reads, as contigs, without those made of repeats, repeated ends cut."""
    c = table(spark, d, "reads").where("seq is not null").select(F.col("read_id").alias("contig"), "seq", F.lit(1.0).alias("coverage"))
    return cleaning.without_repetitive(c).select("contig", F.length("seq").alias("length"))


@query()
def trimmed_contigs(spark, d):
    """Unitigs, as contigs, without ends that a longer one has."""
    u = unitigs_of(spark, d).select(F.col("node").alias("contig"), "minimizers")
    return cleaning.trim_overlaps(u, K - 1)


def _assembly_parameters():
    return assembly.Parameters(density=DENSITY, compress=False, platform="hifi", min_contig_coverage=0)


@query()
def assemble(spark, d):
    """Contigs of the whole read set."""
    return assembly.assemble(table(spark, d, "reads").select("read_id", "seq", "qual"), _assembly_parameters())


@query()
def gfa_final(spark, d):
    """The graph of unitigs as GFA lines, with sequences, depths and overlaps from the reads laid on them."""
    p, u = _assembly_parameters(), unitigs_of(spark, d).drop("unitig")
    reads = table(spark, d, "reads").where("seq is not null").select("read_id", "seq", "qual")
    segments, links = assembly.graph_tables(u, K, p, assembly.unitig_sequences(u, reads, p))
    return gfa.segment_lines(segments).unionByName(gfa.link_lines(links))
