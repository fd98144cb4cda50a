"""Shared parts of the check SQL: minimizers and k-min-mers of the reads table."""

from __future__ import annotations

#: Parameters of the catalogue's queries over reads.
LENGTH, DENSITY, K = 15, 0.05, 4
_VALUE = " + ".join(f"(ascii(substr(m, {i + 1}, 1)) - 48)::UBIGINT * {4 ** (LENGTH - 1 - i)}" for i in range(LENGTH))
_LOW, _MAX = 0xFFFFFFFF, (1 << 64) - 1


def _add(x: str, y: str) -> str:
    """Sum modulo 2^64; both are columns."""
    return f"(case when {x} > {_MAX}::UBIGINT - {y} then {x} - ({_MAX}::UBIGINT - {y}) - 1::UBIGINT else {x} + {y} end)"


def _mul(stage: str, source: str, columns: dict[str, int], out: str) -> str:
    """Two CTEs: multiply columns of ``source`` by constants modulo 2^64, in halves of 32 bits."""
    kept = ", ".join(columns)
    parts = ", ".join(f"({c} & {_LOW}) * {m & _LOW}::UBIGINT {c}_p, (((({c} >> 32) * {m & _LOW}::UBIGINT) & {_LOW}) + ((({c} & {_LOW}) * {m >> 32}::UBIGINT) & {_LOW})) & {_LOW} {c}_q" for c, m in columns.items())
    whole = ", ".join(f"{_add(f'{c}_p', f'({c}_q * 4294967296::UBIGINT)')} {c}" for c in columns)
    drop = ", ".join(f"{c}_p, {c}_q" for c in columns)
    return f"{stage} as (select * exclude ({kept}), {parts} from {source}), {out} as (select * exclude ({drop}), {whole} from {stage})"


def _fold(x: str) -> str:
    return f"xor({x}, {x} >> 33)"


#: Canonical words with their hash: read_id, pos, v (value), dir, h.
KMERS = f"""
    r as (select read_id, upper(seq) s from reads where length(seq) > {LENGTH + 1}),
    w as (select read_id, s, unnest(range(1, length(s) - {LENGTH})) pos from r),
    o as (select read_id, pos, substr(s, pos + 1, {LENGTH}) x from w),
    c as (select read_id, pos, translate(x, 'ACTG', '0123') f, translate(reverse(x), 'ACTG', '2301') g from o where translate(x, 'ACGT', '') = ''),
    l as (select read_id, pos, least(f, g) m, (f >= g)::TINYINT dir from c),
    n as (select read_id, pos, dir, {_VALUE} v from l),
    k0 as (select read_id, pos, dir, v, v k from n),
    {_mul("k1", "k0", {"k": 0x87C37B91114253D5}, "k2")},
    k3 as (select * replace (((k & {(1 << 33) - 1}) << 31) | (k >> 33) as k) from k2),
    {_mul("k4", "k3", {"k": 0x4CF5AD432745937F}, "k5")},
    k6 as (select * exclude k, xor(xor(k, 42::UBIGINT), 8::UBIGINT) k, 34::UBIGINT j from k5),
    k7 as (select * exclude (k, j), {_add("k", "j")} h1, j from k6),
    k8 as (select * exclude j, {_add("h1", "j")} h2 from k7),
    f0 as (select * replace ({_fold("h1")} as h1, {_fold("h2")} as h2) from k8),
    {_mul("f1", "f0", {"h1": 0xFF51AFD7ED558CCD, "h2": 0xFF51AFD7ED558CCD}, "f2")},
    f3 as (select * replace ({_fold("h1")} as h1, {_fold("h2")} as h2) from f2),
    {_mul("f4", "f3", {"h1": 0xC4CEB9FE1A85EC53, "h2": 0xC4CEB9FE1A85EC53}, "f5")},
    f6 as (select * replace ({_fold("h1")} as h1, {_fold("h2")} as h2) from f5),
    a7 as (select read_id, pos, dir, v::BIGINT v, {_add("h1", "h2")} h from f6)"""

#: Minimizers: read_id, pos, v, dir.
MINIMIZERS = f"{KMERS},\n    mz as (select read_id, pos, v, dir from a7 where h::DOUBLE < {DENSITY!r} * 18446744073709551615::DOUBLE)"

#: Reads with at least one minimizer: read_id, ms, ps.
MREADS = f"{MINIMIZERS},\n    mr as (select read_id, list(v order by pos) ms, list(pos order by pos) ps from mz group by read_id)"


def kminmers(k: int = K, name: str = "km") -> str:
    """k-min-mers of the reads: read_id, i, km, is_rev."""
    return f"""
    {name}_raw as (select read_id, i, ms[i + 1 : i + {k}] x from (select read_id, ms, unnest(range(0, len(ms) - {k - 1})) i from mr)),
    {name} as (select read_id, i, least(x, list_reverse(x)) km, not (x < list_reverse(x)) is_rev from {name}_raw)"""


#: Minimizers and k-min-mers of size K.
READ_KMINMERS = f"{MREADS},{kminmers()}"
#: With solid counts: sc (km, abundance).
SOLID = f"{READ_KMINMERS},\n    sc as (select km, count(*) abundance from km group by km having count(*) > 1)"


def _planted() -> list[tuple[list[int], int]]:
    """A small graph beside that of the reads, so that no shape is missing: k-min-mers and abundances.

    A backbone of 60 with a bubble, a bubble whose side has a bubble itself, two tips
    and a turning; a ring; and a sequence of its own.
    """
    at = lambda *x: [5_000_000_000 + i for i in x]
    back = at(*range(60))
    ways = [
        (back, 20), (back[5:9] + at(500, 501, 502) + back[12:16], 6), (back[20:24] + at(510, 511, 512, 513, 514, 515, 516) + back[30:34], 9),
        (at(510, 511, 512, 520, 514, 515, 516), 4), (at(530, 531) + back[44:48], 3), (back[50:54] + at(540, 541), 5),
        (at(*range(200, 209), 200, 201, 202), 7), (at(*range(300, 312)), 2), (at(400, 401, 402, 402, 401, 400), 8),
    ]
    found: dict[tuple[int, ...], int] = {}
    for path, n in ways:
        for i in range(len(path) - K + 1):
            w = tuple(path[i : i + K])
            w = min(w, w[::-1])
            found[w] = max(n, found.get(w, 0))
    return [(list(m), n) for m, n in sorted(found.items())]


PLANTED = _planted()

#: The graph of the solid k-min-mers and the planted ones. Nodes: nn (id, km, abundance); oriented: wy (c, p, a); edges: ey (u, v).
GRAPH = f"""{SOLID},
    gn as (select km, abundance from sc union all select * from (values {", ".join(f"({m}::BIGINT[], {n}::BIGINT)" for m, n in PLANTED)})),
    nn as (select row_number() over (order by km) - 1 id, km, abundance from gn),
    wy as (select 2 * id c, km p, abundance a from nn union all select 2 * id + 1, list_reverse(km), abundance from nn where km <> list_reverse(km)),
    ey as (select x.c u, y.c v from wy x join wy y on x.p[2 : {K}] = y.p[1 : {K - 1}] where x.c // 2 <> y.c // 2 or x.c = y.c)"""

#: Its unitigs (start with "with recursive"): un (minimizers, abundances, abundance, circular), in rows of one orientation.
UNITIGS = f"""{GRAPH},
    lk as (select u, v from (select u, min(v) v from ey group by u having count(*) = 1) join (select v from ey group by v having count(*) = 1) using (v) where u <> v),
    walk(h, c, m, a) as (select c, c, p, [a] from wy where c not in (select v from lk)
        union all select h, lk.v, list_append(m, w.p[{K}]), list_append(walk.a, w.a) from walk join lk on walk.c = lk.u join wy w on w.c = lk.v),
    turn(s, c, m, a, low) as (select c, c, [p[1]], [a], c // 2 from wy where c not in (select c from walk)
        union all select s, lk.v, list_append(m, w.p[1]), list_append(turn.a, w.a), least(low, lk.v // 2) from turn join lk on turn.c = lk.u join wy w on w.c = lk.v where lk.v <> s),
    ut as (select m, a, false circular from walk where c not in (select u from lk)
        union all select x.m, x.a, true from (select min({{'m': list_concat(m, m, m, m)[1 : len(m) + {K - 1}], 'a': a}}) x from turn join lk on turn.c = lk.u where lk.v = s group by low)),
    un as (select distinct case when f then m else list_reverse(m) end minimizers, case when f then a else list_reverse(a) end abundances, greatest(list_aggregate(a, 'median'), 1)::DOUBLE abundance, circular
           from (select *, circular or m < list_reverse(m) or (m = list_reverse(m) and a <= list_reverse(a)) f from ut))"""

#: Edges between unitigs (start with "with recursive"): ue (u, v) over uw (name, rev, p, abundance).
UNITIG_EDGES = f"""{UNITIGS},
    uw as (select minimizers as name, false rev, minimizers p, abundance, abundances from un union all select minimizers, true, list_reverse(minimizers), abundance, abundances from un where minimizers <> list_reverse(minimizers)),
    ue as (select x.name src, x.rev src_rev, y.name dst, y.rev dst_rev from uw x join uw y on x.p[len(x.p) - {K - 2} : len(x.p)] = y.p[1 : {K - 1}] where x.name <> y.name or x.rev = y.rev)"""
