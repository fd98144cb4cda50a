"""Named queries of the training-data operators and their SQL."""

from __future__ import annotations

from ..session import cut, table
from . import encode, groups, heavy, pack, runs, seen, spans, subjects

KEY = ["vec_hash_hi", "vec_hash_lo"]


def _answers(spark, d):
    records = table(spark, d, "km_abundance").select("rec_id", *KEY)
    return seen.seen_before(records, table(spark, d, "km_known").select(*KEY))


def p1_found(spark, d):
    """Records whose key is known or occurred in a record of smaller id."""
    return seen.seen_ids(_answers(spark, d))


def p1_error_rate(spark, d):
    """The filters' measured rate of wrong answers."""
    return seen.error_rate(_answers(spark, d))


def _frequent(spark, d):
    columns = [*KEY, "abundance", "chunk_id", "chunk_row"]
    once = heavy.delivered_once(table(spark, d, "km_abundance").select(*columns), KEY, "abundance", ["chunk_id", "chunk_row"])
    return heavy.iceberg(once, KEY, "abundance")


def p2_found(spark, d):
    """Keys with at least 1/500 of the total abundance."""
    return _frequent(spark, d).select(*KEY)


def p2_totals(spark, d):
    """These keys with estimated and exact totals."""
    return _frequent(spark, d)


def p3_found(spark, d):
    """Runs of at least 10 equal bases."""
    reads = table(spark, d, "reads").select("read_id", "seq", "qual")
    return runs.base_runs(reads, least=10).select("read_id", "run_start", "run_len")


def p3_collapsed(spark, d):
    """Every read as its runs: letters, starts and lengths."""
    return runs.collapsed_reads(table(spark, d, "reads").select("read_id", "seq", "qual"))


def p4_found(spark, d):
    """Spans of each read covered by windows of 60 that other reads have."""
    return spans.covered_spans(spans.shared_stretches(table(spark, d, "reads").select("read_id", "seq")))


def p4_shared(spark, d):
    """Shared and repeated letters of each read."""
    reads = table(spark, d, "reads").select("read_id", "seq")
    return spans.shared_letters(reads, cut(spans.shared_stretches(reads)))


def p4_removed(spark, d):
    """Reads without the spans that a read of smaller id has."""
    reads = table(spark, d, "reads").select("read_id", "seq")
    return spans.without_repeated(reads, spans.shared_stretches(reads))


def p5_found(spark, d):
    """Group of each linked read."""
    every = groups.links([(table(spark, d, "read_match").select("ref_read_index", "read_index"), "ref_read_index", "read_index"), (table(spark, d, "read_match_bound").select("ref_read_index", "query_read_index"), "ref_read_index", "query_read_index")])
    return groups.connected_groups(every).select(groups.F.col("node").alias("read_index"), "group_id")


def p6_ids(spark, d):
    """Token ids of each document."""
    return encode.encoded(table(spark, d, "documents").select("doc_id", "text"))


def p6_round_trip(spark, d):
    """Whether streaming decode gives each text back."""
    return encode.round_trips(table(spark, d, "documents").select("doc_id", "text"))


def _containers(spark, d):
    sizes = encode.token_counts(table(spark, d, "documents").select("doc_id", "text").where("text is not null"))
    return pack.packed(sizes, 2048, [256, 512, 1024, 2048])


def p7_containers(spark, d):
    """Documents in containers of 2,048 tokens, downsized to their contents."""
    return _containers(spark, d)


def p7_unused(spark, d):
    """Share of unused space."""
    return pack.fill_report(_containers(spark, d))


def _subjects(spark, d):
    return subjects.subjects_of(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "subject_labels").select("doc_id", "subject"), table(spark, d, "subject_areas"))


def p8_found(spark, d):
    """Subject areas of each document."""
    return _subjects(spark, d).select("doc_id", "subject")


def p8_composition(spark, d):
    """Documents by subject, with their mean share of sentences and posterior."""
    F = groups.F
    return _subjects(spark, d).groupBy("subject").agg(F.countDistinct("doc_id").alias("documents"), F.avg(F.col("n_about") / F.col("n_content")).alias("mean_share"), F.avg("posterior").alias("mean_posterior"))


QUERIES = {f.__name__: f for f in (p1_found, p1_error_rate, p2_found, p2_totals, p3_found, p3_collapsed, p4_found, p4_shared, p4_removed, p5_found, p6_ids, p6_round_trip, p7_containers, p7_unused, p8_found, p8_composition)}

#: Every window of 60 bases: read_id, i (0-based), x; and how many reads have it, and the first of them.
_WINDOWS = """
    w as (select read_id, i - 1 as i, substr(s, i, 60) x from (select read_id, s, unnest(range(1, length(s) - 58)) i from (select read_id, upper(seq) s from reads where length(seq) >= 60))),
    v as (select * from w where translate(x, 'ACGT', '') = ''),
    h as (select x, min(read_id) first_read from v group by x having count(distinct read_id) > 1),
    hit as (select distinct read_id, i, read_id > first_read as later from v join h using (x))"""


def _islands(source: str) -> str:
    """Stretches of hit windows that overlap or adjoin: read_id, a (start), z (end)."""
    return f"""
    {source}_m as (select read_id, i, (lag(i) over o is null or i - lag(i) over o > 60)::INT fresh from {source} window o as (partition by read_id order by i)),
    {source}_g as (select read_id, i, sum(fresh) over (partition by read_id order by i) g from {source}_m),
    {source}_s as (select read_id, min(i) a, max(i) + 60 z from {source}_g group by read_id, g)"""


_LATER = f"{_WINDOWS}, later as (select read_id, i from hit where later), {_islands('later')}"

#: Counting records, each delivery once: h, l, a.
_ONCE = """
    c as (select vec_hash_hi h, vec_hash_lo l, abundance a, chunk_id, chunk_row from km_abundance where vec_hash_hi is not null and vec_hash_lo is not null and abundance is not null and abundance <> 4294967295),
    o as (select min({'h': h, 'l': l, 'a': a}) r from c where chunk_id is not null and chunk_row is not null group by chunk_id, chunk_row),
    d as (select r.h h, r.l l, r.a a from o union all select h, l, a from c where chunk_id is null or chunk_row is null)"""

ORACLES = {
    "p3_found": """
        with l as (select read_id, qual, length(seq) n, i - 1 as i, upper(substr(seq, i, 1)) c, upper(substr(seq, i - 1, 1)) b, upper(substr(seq, i + 1, 1)) e
                   from (select read_id, seq, qual, unnest(range(1, length(seq) + 1)) i from reads where length(seq) > 0)),
        m as (select read_id, i, case when i > 0 and i < n - 1 and length(qual) = n and ascii(substr(qual, i + 1, 1)) - 33 <= 5 and b = e and b in ('A', 'C', 'G', 'T') then b else c end c from l),
        g as (select read_id, i, c, i - row_number() over (partition by read_id, c order by i) k from m)
        select read_id, min(i)::INT as run_start, count(*)::INT as run_len from g where c in ('A', 'C', 'G', 'T') group by read_id, c, k having count(*) >= 10""",
    "p4_found": f"with {_WINDOWS}, every as (select read_id, i from hit), {_islands('every')} select read_id, a::INT as span_start, (z - a)::INT as span_len from every_s",
    "p4_shared": f"""with {_LATER}, every as (select read_id, i from hit), {_islands('every')}
        select read_id, coalesce(length(seq), 0)::BIGINT as n_letters, coalesce((select sum(z - a) from every_s e where e.read_id = r.read_id), 0)::BIGINT as n_shared,
        coalesce((select sum(z - a) from later_s e where e.read_id = r.read_id), 0)::BIGINT as n_repeated from reads r""",
    "p4_removed": f"""with {_LATER}, p as (select read_id, unnest(range(0, length(seq))) i, seq from reads where seq is not null),
        k as (select p.read_id, string_agg(substr(p.seq, (p.i + 1)::INT, 1), '' order by p.i) seq from p left join later_s s on s.read_id = p.read_id and p.i >= a and p.i < z where s.read_id is null group by p.read_id),
        n as (select read_id, sum(z - a)::INT n from later_s group by read_id)
        select r.read_id, case when r.seq is null then null else coalesce(k.seq, '') end as seq, coalesce(n, 0)::INT as n_removed from reads r left join k using (read_id) left join n using (read_id)""",
    "p5_found": """
        with recursive l as (select ref_read_index a, read_index b from read_match union select ref_read_index, query_read_index from read_match_bound),
        e as (select a, b from l where a <> 4294967295 and b <> 4294967295 union select b, a from l where a <> 4294967295 and b <> 4294967295),
        t as (select distinct a node, a g from e union select e.b, t.g from t join e on t.node = e.a where t.g < e.b)
        select node as read_index, min(g) as group_id from t group by node""",
    "p1_found": """
        select r.rec_id from km_abundance r
        left join (select vec_hash_hi h, vec_hash_lo l, min(rec_id) first_id from km_abundance group by all) f on r.vec_hash_hi = f.h and r.vec_hash_lo = f.l
        left join (select distinct vec_hash_hi h, vec_hash_lo l from km_known) n on r.vec_hash_hi = n.h and r.vec_hash_lo = n.l
        where r.vec_hash_hi is not null and r.vec_hash_lo is not null and (n.h is not null or f.first_id < r.rec_id)""",
    "p2_found": f"with {_ONCE} select h as vec_hash_hi, l as vec_hash_lo from d group by all having sum(a) * 500 >= (select sum(a) from d)",
}
