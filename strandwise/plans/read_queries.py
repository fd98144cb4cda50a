"""Queries over reads: scalars, statistics, minimizers and k-min-mers."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import seq, stats
from ..operators import align, minimize
from ..operators import kminmers as km
from ..session import Files, materialize, shared_dir, table
from ..sources import fastx
from .registry import query
from .sql import DENSITY, K, KMERS, LENGTH, MINIMIZERS, MREADS, READ_KMINMERS, SOLID, kminmers

#: Single letters of the reads: read_id, i (0-based), c.
LETTERS = "lt as (select read_id, i - 1 as i, substr(s, i, 1) c, substr(s, i - 1, 1) b from (select read_id, s, unnest(range(1, length(s) + 1)) i from (select read_id, upper(seq) s from reads where seq is not null)))"
#: Every read with its minimizers, [] where it has none: read_id, ms, ps, n (letters).
ALL_MREADS = f"with {MREADS}, am as (select r0.read_id, coalesce(ms, []) ms, coalesce(ps, []) ps, coalesce(length(seq), 0) n from reads r0 left join mr using (read_id))"


def reads_of(spark, d):
    return table(spark, d, "reads").select("read_id", "seq", "qual")


def mreads_of(spark, d, density=DENSITY):
    return minimize.minimizer_reads(reads_of(spark, d), LENGTH, density)


def rows_of(spark, d, k=K):
    return km.kminmer_rows(mreads_of(spark, d), k)


@query("select read_id, length(seq) as n from reads where read_id in (select ref_read_index from read_match) and seq is not null")
def subsample_reads(spark, d):
    """Reads that are a reference of a match."""
    wanted = table(spark, d, "read_match").select(F.col("ref_read_index").alias("read_id"))
    return table(spark, d, "reads").where("seq is not null").join(wanted, "read_id", "left_semi").select("read_id", F.length("seq").alias("n"))


@query(f"with {LETTERS}, h as (select read_id, string_agg(c, '' order by i) h from lt where i = 0 or b <> c group by read_id) select read_id, coalesce(h, '') as hpc from reads left join h using (read_id) where seq is not null")
def hpc(spark, d):
    """Homopolymer compression of the reads, whatever their letters."""
    return table(spark, d, "reads").where("seq is not null").select("read_id", seq.hpc(F.upper("seq")).alias("hpc"))


@query("select read_id, case when length(s) = 0 then []::INT[] else list_append(list_filter(range(0, length(s)), lambda i: i = 0 or substr(s, i + 1, 1) <> substr(s, i, 1)), length(s))::INT[] end as positions from (select read_id, upper(coalesce(seq, '')) s from reads)")
def hpc_positions(spark, d):
    """Starts of the runs of equal letters, and the length."""
    return minimize.run_positions(table(spark, d, "reads").select("read_id", "seq"))


@query("select read_id, reverse(translate(upper(seq), 'ACGT', 'TGCA')) as rc from reads")
def revcomp(spark, d):
    return table(spark, d, "reads").select("read_id", seq.revcomp(F.upper("seq")).alias("rc"))


@query("select read_id, reverse(translate(seq, 'ACGTUNRYSWKMBDHVacgtunryswkmbdhv', 'TGCAANYRSWMKVHDBtgcaanyrswmkvhdb')) as rc from reads")
def revcomp_iupac(spark, d):
    return table(spark, d, "reads").select("read_id", seq.revcomp_iupac(F.col("seq")).alias("rc"))


@query("select read_id, translate(upper(seq), 'ACTG', '0123') as codes from reads")
def base_codes(spark, d):
    return table(spark, d, "reads").select("read_id", seq.base_codes(F.upper("seq")).alias("codes"))


def _frequent_words(spark, d, canonical):
    words = minimize.kmer_values(reads_of(spark, d), 11, canonical).select(F.explode("words").alias("v"))
    return words.groupBy("v").agg(F.count("*").alias("n")).select(minimize.spelled(F.col("v"), 11).alias("w"), "n")


@query("select w, count(*) as n from (select substr(s, i, 11) w from (select s, unnest(range(1, length(s) - 9)) i from (select upper(seq) s from reads where length(seq) >= 11))) where translate(w, 'ACGT', '') = '' group by w")
def direct_kmers(spark, d):
    """All words of 11 bases with their number."""
    return _frequent_words(spark, d, False)


@query("""select w, count(*) as n from (select translate(least(translate(x, 'ACTG', '0123'), translate(reverse(x), 'ACTG', '2301')), '0123', 'ACTG') w
          from (select substr(s, i, 11) x from (select s, unnest(range(1, length(s) - 9)) i from (select upper(seq) s from reads where length(seq) >= 11))) where translate(x, 'ACGT', '') = '') group by w""")
def canonical_kmers(spark, d):
    """All canonical words of 11 bases with their number."""
    return _frequent_words(spark, d, True)


@query(f"with {KMERS} select count(*) as n_kmers, count(distinct v) as n_distinct, sum((h::DOUBLE < {DENSITY!r} * 18446744073709551615::DOUBLE)::BIGINT)::BIGINT as n_selected from a7")
def hash_density(spark, d):
    """Words, distinct words and words below the density bound."""
    everything = minimize.minimizer_reads(reads_of(spark, d), LENGTH, 1.01).select(F.explode("minimizers").alias("v"))
    chosen = mreads_of(spark, d).agg(F.sum(F.size("minimizers")).alias("n_selected"))
    counted = everything.groupBy("v").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n_kmers"), F.count("*").alias("n_distinct"))
    return counted.withColumn("_k", F.lit(0)).join(chosen.withColumn("_k", F.lit(0)), "_k").select("n_kmers", "n_distinct", "n_selected")


@query(f"with {MINIMIZERS} select read_id, pos::INT as pos, v as minimizer, dir from mz")
def minimizers(spark, d):
    """Every selected minimizer with its position and direction."""
    zipped = mreads_of(spark, d).select("read_id", F.explode(F.arrays_zip("minimizers", "pos", "dir")).alias("z"))
    return zipped.select("read_id", F.col("z.pos").alias("pos"), F.col("z.minimizers").alias("minimizer"), F.col("z.dir").alias("dir"))


@query(f"with {KMERS}, lo as (select read_id, list(v order by pos) m from a7 where h::DOUBLE < 0.01 * 18446744073709551615::DOUBLE group by read_id) select read_id, coalesce(m, []) as minimizers from reads left join lo using (read_id)")
def density_filter(spark, d):
    """Reads projected to a lower density; equal to selecting at that density at once."""
    return minimize.lower_density(mreads_of(spark, d), 0.01).select("read_id", "minimizers")


@query(f"with {MINIMIZERS} select v as minimizer, count(*) as n from mz group by v")
def minimizer_freq(spark, d):
    return minimize.minimizer_counts(mreads_of(spark, d))


TOP = "top as (select v, n from (select v, n, row_number() over (order by n desc, v) rk, count(*) over () total from (select v, count(*) n from mz group by v)) where rk <= greatest(1, floor(total * 0.00001)))"


@query(f"with {MINIMIZERS}, {TOP} select v as minimizer, n from top")
def repetitive_topk(spark, d):
    """The most frequent hundred-thousandth of the minimizers, one at least."""
    return minimize.repetitive_minimizers(materialize(minimize.minimizer_counts(mreads_of(spark, d))))


@query(f"with {MINIMIZERS}, {TOP}, kp as (select read_id, list(v order by pos) m, list(pos::INT order by pos) p from mz where v not in (select v from top) group by read_id) select read_id, coalesce(m, []) as minimizers, coalesce(p, []) as pos from reads left join kp using (read_id)")
def drop_repetitive(spark, d):
    """Reads without repetitive minimizers; positions stay with theirs."""
    m = materialize(mreads_of(spark, d).select("read_id", "minimizers", "pos"))
    return minimize.without_repetitive(m, minimize.repetitive_minimizers(materialize(minimize.minimizer_counts(m))))


@query(f"{ALL_MREADS} select read_id, len(ms)::INT as n from am where len(ms) < 10")
def short_reads(spark, d):
    """Reads of fewer than ten minimizers."""
    return mreads_of(spark, d).select("read_id", F.size("minimizers").alias("n")).where("n < 10")


PURGE = f"""with recursive {MREADS}, pu(read_id, m, k) as (
    select read_id, ms, 4 from mr
    union all
    select read_id, case when hit is null then m else list_concat(m[1 : hit], m[hit + 2 : len(m)]) end, case when hit is null then k + 1 else 4 end
    from (select read_id, m, k, list_min(list_filter(range(0, len(m) - k + 1), lambda i: m[i + 1] = m[i + k] and m[i + 1 : i + k] = list_reverse(m[i + 1 : i + k]))) hit from pu where k < 20 and k <= len(m)))"""


@query(f"{PURGE}, dn as (select read_id, m from pu where k >= 20 or k > len(m)) select read_id, coalesce(m, []) as minimizers from reads left join dn using (read_id)")
def purge_palindromes(spark, d):
    """Reads freed of palindromic windows of 4 to 19 minimizers."""
    return align.purged_reads(mreads_of(spark, d), 4, 20).select("read_id", "minimizers")


@query("select read_id, round(-10 * log10(list_avg(list_transform(range(1, length(qual) + 1), lambda i: pow(10.0, -(ascii(substr(qual, i, 1)) - 33) / 10.0)))), 6) as mean_q from reads where length(qual) > 0")
def mean_quality(spark, d):
    q = minimize.mean_qualities(reads_of(spark, d)).where("mean_q is not null")
    return q.select("read_id", F.round("mean_q", 6).alias("mean_q"))


COMPLEXITY = """
    t as (select read_id, upper(seq) s from reads where length(seq) >= 66),
    u as (select read_id, i, substr(s, i + 1, 3) x from (select read_id, s, unnest(range(0, length(s) - 2)) i from t)),
    p as (select read_id, row_number() over (partition by read_id order by i) - 1 as j, x from u where translate(x, 'ACGT', '') = ''),
    z as (select read_id, count(*) m from p group by read_id having count(*) >= 64),
    b as (select read_id, unnest(range(0, m - 63, 32)) st from z),
    q as (select b.read_id, b.st, p.x, count(*) n from b join p on p.read_id = b.read_id and p.j >= b.st and p.j < b.st + 64 group by all),
    sw as (select read_id, st, sum(n * (n - 1) / 2.0) / 61 sc from q group by all)"""


@query(f"with {COMPLEXITY} select read_id, round(avg(sc), 6) as mean_score, round(max(sc), 6) as max_score from sw group by read_id")
def complexity(spark, d):
    """Mean and largest window score of equal trinucleotides; low-complexity reads score high."""
    c = minimize.sequence_complexity(reads_of(spark, d)).where("mean_score is not null")
    return c.select("read_id", F.round("mean_score", 6).alias("mean_score"), F.round("max_score", 6).alias("max_score"))


@query(f"with {COMPLEXITY} select r.read_id from reads r left join (select read_id, avg(sc) m from sw group by read_id) using (read_id) where coalesce(m, 0) <= 5")
def complexity_filter(spark, d):
    """Reads that pass: mean score at most 5; reads without a full window pass."""
    return minimize.sequence_complexity(reads_of(spark, d)).where("coalesce(mean_score, 0) <= 5").select("read_id")


@query(f"with {MINIMIZERS} select read_id, pos::INT as pos, (select min(ascii(ch) - 33) from (select unnest(string_split(substr(r2.qual, pos + 1, {LENGTH}), '')) ch))::TINYINT as q from mz join reads r2 using (read_id) where length(r2.qual) = length(r2.seq)")
def kmer_min_quality(spark, d):
    """Least quality under each minimizer, for reads with usable quality."""
    z = mreads_of(spark, d).select("read_id", F.explode(F.arrays_zip("pos", "qual")).alias("z"))
    return z.select("read_id", F.col("z.pos").alias("pos"), F.col("z.qual").alias("q")).where("q is not null")


@query(f"{ALL_MREADS} select read_id, list_reverse(ms) as minimizers, list_transform(list_reverse(ps), lambda p: (n - p - {LENGTH})::INT) as pos from am")
def revcomp_mread(spark, d):
    """Minimizer reads on the other strand: arrays reversed, positions counted from the other end."""
    m = mreads_of(spark, d)
    return m.select("read_id", F.reverse("minimizers").alias("minimizers"), F.transform(F.reverse("pos"), lambda p: F.col("read_len") - p - LENGTH).alias("pos"))


@query("""with t as (select length(seq) n from reads where seq is not null),
          o as (select n, sum(n) over (order by n desc rows unbounded preceding) a, sum(n) over () total from t)
          select max(case when a * 2 >= total then n end) as n50, coalesce(min(case when a < total // 2 then n end), max(n)) as n50_early from o""")
def n50(spark, d):
    return stats.n50(table(spark, d, "reads").select(F.length("seq").alias("n")), "n")


@query(f"with {MREADS} select (select count(*) from reads) as n_reads, (select sum(length(seq))::BIGINT from reads) as bases, (select round(avg(coalesce(length(seq), 0)), 6) from reads) as mean_len, (select sum(len(ms))::BIGINT from mr) as n_minimizers, (select round(sum(len(ms)) / sum(length(seq)), 9) from reads left join mr using (read_id)) as density")
def read_stats(spark, d):
    m = mreads_of(spark, d).select(F.size("minimizers").alias("k"), "read_len")
    return m.agg(F.count("*").alias("n_reads"), F.sum("read_len").alias("bases"), F.round(F.avg("read_len"), 6).alias("mean_len"), F.sum("k").alias("n_minimizers"), F.round(F.sum("k") / F.sum("read_len"), 9).alias("density"))


@query("select header, regexp_extract(header, '^(\\S*)', 1) as name, trim(regexp_replace(header, '^\\S*', '')) as comment, try_cast(regexp_extract(header, '/([0-9]+)', 1) as INT) as number from reads")
def parse_header(spark, d):
    """Headers split into name, comment and number."""
    h = F.col("header")
    digits = F.regexp_extract(h, "/([0-9]+)", 1)
    return table(spark, d, "reads").select("header", seq.short_header(h).alias("name"), F.trim(F.regexp_replace(h, r"^\S*", "")).alias("comment"), F.when(digits != "", digits.cast("int")).alias("number"))


@query("select read_id, printf('ctg%d length=%d coverage=%.2f circular=%s', read_id, coalesce(length(seq), 0), dataset_id / 10.0, case when read_id % 2 = 0 then 'yes' else 'no' end) as header from reads where dataset_id is not null")
def format_header(spark, d):
    """Contig headers."""
    r = table(spark, d, "reads").where("dataset_id is not null")
    return r.select("read_id", seq.contig_header(F.col("read_id"), F.coalesce(F.length("seq"), F.lit(0)), F.col("dataset_id") / 10.0, F.col("read_id") % 2 == 0).alias("header"))


@query("""with t as (select length(seq) n from reads where seq is not null), o as (select n, sum(n) over (order by n desc rows unbounded preceding) a, sum(n) over () total from t)
          select greatest(6, floor(coalesce(min(case when a < total // 2 then n end), max(n))::FLOAT * 0.05::FLOAT * 2::FLOAT)::INT) as last_k from o""")
def last_k(spark, d):
    """Largest k of the multi-k loop."""
    return n50(spark, d).select(F.greatest(F.lit(6), (F.col("n50_early").cast("float") * F.lit(0.05).cast("float") * F.lit(2.0).cast("float")).cast("int")).alias("last_k"))


@query(f"select distinct k, round(1.0 / {DENSITY!r} * (k - 1) + {LENGTH}, 6) as bp from km_abundance where k is not null")
def k_to_bp(spark, d):
    k = table(spark, d, "km_abundance").where("k is not null").select("k").distinct()
    return k.select("k", F.round(seq.k_to_bp(F.col("k"), DENSITY, LENGTH), 6).alias("bp"))


@query(f"with {READ_KMINMERS} select read_id, i::INT as i, km, is_rev from km")
def kminmers_of_reads(spark, d):
    """All k-min-mers of all reads, normalised."""
    return rows_of(spark, d)


@query("select distinct least(km, list_reverse(km)) as km, not (km < list_reverse(km)) as is_rev, km = list_reverse(km) as palindrome, km[1 : len(km) - 1] as prefix, km[2 : len(km)] as suffix from km_abundance where km is not null and len(km) > 1")
def normalize_kminmer(spark, d):
    """Normalised k-min-mers with orientation, prefix and suffix."""
    v = F.col("km")
    rows = table(spark, d, "km_abundance").where(v.isNotNull() & (F.size(v) > 1)).select(v).distinct()
    return rows.select(seq.normalized(v).alias("km"), seq.is_reversed(v).alias("is_rev"), (v == F.reverse(v)).alias("palindrome"), F.slice(v, 1, F.size(v) - 1).alias("prefix"), F.slice(v, F.lit(2), F.size(v) - 1).alias("suffix")).distinct()


@query(f"with {READ_KMINMERS} select km, count(*) as abundance from km group by km")
def kminmer_count(spark, d):
    return km.kminmer_counts(rows_of(spark, d))


@query(f"with {SOLID} select km, abundance from sc")
def solid_kminmers(spark, d):
    """k-min-mers that occur more than once: the flagship query."""
    return km.solid(km.kminmer_counts(rows_of(spark, d)))


@query(f"with {READ_KMINMERS} select distinct least(e, list_reverse(e)) as edge from (select unnest([km[1 : {K - 1}], km[2 : {K}]]) e from km)")
def distinct_edges(spark, d):
    from ..operators import graph

    return graph.distinct_edges(rows_of(spark, d).select("km").distinct(), K)


@query(f"with {SOLID} select read_id, i::INT as i, coalesce(abundance, 1) as abundance from km left join sc using (km)")
def path_abundance(spark, d):
    """Abundance of each k-min-mer along each read, 1 where it isn't solid."""
    rows = materialize(rows_of(spark, d))
    return km.path_abundances(rows, km.solid(km.kminmer_counts(rows)), "read_id")


@query(f"with {SOLID} select read_id, floor(median(coalesce(abundance, 1)))::BIGINT as median, max(coalesce(abundance, 1)) as largest from km left join sc using (km) group by read_id")
def median_abundance(spark, d):
    return km.median_abundance(path_abundance(spark, d), "read_id")


@query(f"""with {SOLID}, ab as (select read_id, km, coalesce(abundance, 1) a from km left join sc using (km)),
          g as (select read_id from ab group by read_id having floor(median(a)) <= 10 and max(a) > 1)
          select distinct km, 1::BIGINT as abundance from ab where a = 1 and read_id in (select read_id from g) and km not in (select km from sc)""")
def rescue(spark, d):
    """k-min-mers rescued from reads of low but not minimal abundance."""
    rows = materialize(rows_of(spark, d))
    return km.rescue(rows, materialize(km.solid(km.kminmer_counts(rows))))


@query(f"""with {SOLID},{kminmers(K + 1, 'kn')}, nx as (select distinct km from kn),
          parts as (select km, unnest([least(km[1 : {K}], list_reverse(km[1 : {K}])), least(km[2 : {K + 1}], list_reverse(km[2 : {K + 1}]))]) sub from nx)
          select parts.km, min(coalesce(sc.abundance, 1)) as abundance from parts left join sc on parts.sub = sc.km group by parts.km""")
def refined_abundance(spark, d):
    """Abundance of the (k+1)-min-mers from the k-min-mers before."""
    m = materialize(mreads_of(spark, d).select("read_id", "minimizers"))
    counts = km.solid(km.kminmer_counts(km.kminmer_rows(m, K)))
    return km.refined_abundance(km.kminmer_rows(m, K + 1).select("km").distinct(), counts, K)


@query(f"""with {SOLID}, ab as (select read_id, i, coalesce(abundance, 1) a from km left join sc using (km))
          select read_id, i::INT as i, least(a, nx) as abundance from (select read_id, i, a, lead(a) over (partition by read_id order by i) nx from ab) where nx is not null""")
def min_adjacent(spark, d):
    """Least abundance of each two neighbouring k-min-mers."""
    order = Window.partitionBy("read_id").orderBy("i")
    ab = path_abundance(spark, d).withColumn("nx", F.lead("abundance").over(order))
    return ab.where("nx is not null").select("read_id", "i", F.least("abundance", "nx").alias("abundance"))


@query(f"""with {READ_KMINMERS}, given as (select 0 as src, km from km union all select 1, least(km, list_reverse(km)) from km_abundance where km is not null)
          select km, count(*) as n, sum(src)::BIGINT as n_given from given group by km""")
def union_reads_unitigs(spark, d):
    """Count over the reads' k-min-mers and those of earlier passes together."""
    earlier = table(spark, d, "km_abundance").where("km is not null").select(F.lit(1).alias("src"), seq.normalized(F.col("km")).alias("km"))
    both = rows_of(spark, d).select(F.lit(0).alias("src"), "km").unionByName(earlier)
    return both.groupBy("km").agg(F.count("*").alias("n"), F.sum("src").alias("n_given"))


@query(f"with {READ_KMINMERS} select count(*) as n, sum(i)::BIGINT as sum_i, bit_xor(km[1]) as xor_first, sum(km[{K}] % 1000003)::BIGINT as sum_last from km")
def checksum(spark, d):
    """Sums that don't depend on the order of rows."""
    r = rows_of(spark, d)
    return r.agg(F.count("*").alias("n"), F.sum("i").alias("sum_i"), F.bit_xor(F.element_at("km", 1)).alias("xor_first"), F.sum(F.element_at("km", K) % 1000003).alias("sum_last"))


@query(f"{ALL_MREADS} select read_id, len(ms)::INT as n_min from am where len(ms) < {K}")
def small_contigs(spark, d):
    """Sequences without a single k-min-mer."""
    return mreads_of(spark, d).select("read_id", F.size("minimizers").alias("n_min")).where(F.col("n_min") < K)


FASTQ = "select row_number() over (order by read_id) - 1 as read_id, coalesce(header, '') as header, coalesce(seq, '') as seq, case when length(qual) = length(seq) then qual else repeat('!', coalesce(length(seq), 0)) end as qual from reads"


@query(FASTQ)
def scan_reads(spark, d):
    """The reads written as FASTQ, in order, and scanned: numbered over all files."""
    r = table(spark, d, "reads").select("read_id", F.coalesce("header", F.lit("")).alias("header"), F.coalesce("seq", F.lit("")).alias("seq"), F.when(F.length("qual") == F.length("seq"), F.col("qual")).alias("qual"))
    return fastx.scan(spark, written(spark, fastx.in_order(r, ["read_id"]), "fastq"), split=1 << 20)


@query("select row_number() over (order by read_id) - 1 as read_id, coalesce(header, '') as header, coalesce(seq, '') as seq from reads")
def scan_fasta(spark, d):
    """The same as FASTA, compressed."""
    r = table(spark, d, "reads").select("read_id", F.coalesce("header", F.lit("")).alias("header"), "seq")
    return fastx.scan(spark, written(spark, fastx.in_order(r, ["read_id"]), "fasta")).select("read_id", "header", "seq")


def written(spark, rows, kind):
    """Files of a scratch folder that holds the rows as text, in order."""
    path = f"{shared_dir(spark)}/text-{uuid.uuid4().hex}"
    if kind == "fastq":
        fastx.write_fastq(rows, path, None)
    elif kind == "fasta":
        fastx.write_fasta(rows, path)
    else:
        rows.write.text(path)
    return Files(spark).listed(path, "part-")


@query("select 'r' || read_index as q_name, query_end as q_len, query_start as q_start, query_end as q_end, case when is_reversed then '-' else '+' end as strand, 'r' || ref_read_index as t_name, reference_end as t_len, reference_start as t_start, reference_end as t_end, align_nb_matches as n_match, align_length as align_len, 60 as mapq from read_match where read_index is not null and ref_read_index is not null")
def scan_paf(spark, d):
    """The matches written as PAF lines and parsed."""
    m = table(spark, d, "read_match").where("read_index is not null and ref_read_index is not null")
    name = lambda c: F.concat(F.lit("r"), F.col(c).cast("string"))
    columns = [name("read_index"), "query_end", "query_start", "query_end", F.when(F.col("is_reversed"), "-").otherwise("+"), name("ref_read_index"), "reference_end", "reference_start", "reference_end", "align_nb_matches", "align_length", F.lit(60)]
    lines = m.select(F.concat_ws("\t", *[F.coalesce(c if not isinstance(c, str) else F.col(c).cast("string"), F.lit("")) for c in columns]).alias("value"))
    return fastx.read_paf(spark, written(spark, lines, "text"))
