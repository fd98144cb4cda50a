"""Simplification of one region of a graph: a set of whole components that a task holds.

Components don't influence each other, so whatever simplifies a graph can be done
component by component.  The functions here take one as plain lists and give the
same rounds as the relational operators of :mod:`graph` do on a whole table: all
bubbles (tips) of a round are found on one state of the graph, a choice that
doesn't depend on any order is removed, and the graph is compacted again.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

Unitig = tuple[tuple[int, ...], tuple[int, ...], bool]

#: Shares of the weaker end's abundance below which a bubble's nodes aren't used, tried in order.
FLOORS = (1.0, 0.75, 0.5, 0.25, 0.0)
#: Thresholds grow by a tenth, by STEP at most, up to LIMIT.
FIRST_CUTOFF, GROWTH, STEP, LIMIT = 1.1, 0.1, 10.0, 10_000.0
#: Branches of a node from which on no bubble is sought behind it.
MANY = 5


def median(values) -> float:
    s = sorted(values)
    n = len(s)
    return (s[(n + 1) // 2 - 1] + s[n // 2]) / 2.0


def abundance_of(unitig: Unitig) -> float:
    return max(1.0, median(unitig[1]))


def after(threshold: float) -> float:
    return threshold + min(threshold * GROWTH, STEP)


class Region:
    """Oriented nodes ``2 i`` and ``2 i + 1`` (a palindrome only ``2 i``) with their neighbours."""

    def __init__(self, unitigs: list, overlap: int):
        self.overlap, self.unitigs = overlap, unitigs
        self.path: dict[int, tuple[int, ...]] = {}
        for i, u in enumerate(unitigs):
            m = tuple(u[0])
            self.path[2 * i] = m
            if m != m[::-1]:
                self.path[2 * i + 1] = m[::-1]
        starts = defaultdict(list)
        for c, m in self.path.items():
            starts[m[:overlap]].append(c)
        # No edge from a node's end to its own reverse.
        self.next = {c: [v for v in starts.get(m[-overlap:], ()) if v != c ^ 1] for c, m in self.path.items()}
        self.before = defaultdict(list)
        for c, found in self.next.items():
            for v in found:
                self.before[v].append(c)
        self.abundance = [abundance_of((u[0], u[1], False)) for u in unitigs]

    def flip(self, c: int) -> int:
        return c ^ 1 if c ^ 1 in self.path else c

    def weights(self, c: int) -> tuple[int, ...]:
        a = tuple(self.unitigs[c >> 1][1])
        return a[::-1] if c & 1 else a


def opened(path: tuple, weights: tuple, overlap: int) -> tuple[tuple, tuple]:
    """A cycle cut where its minimizers, read on the better strand, are the smallest array."""
    n = len(path) - overlap
    best = None
    for m, a in ((path, weights), (path[::-1], weights[::-1])):
        ring, least = m[:n], min(m[:n])
        for i in (i for i in range(n) if ring[i] == least):
            way = (tuple(ring[(i + j) % n] for j in range(n + overlap)), a[i:] + a[:i])
            best = way if best is None or way < best else best
    return best


def compacted(unitigs: list, overlap: int) -> list[Unitig]:
    """All unbranched paths merged; of a path and its reverse the smaller array, in order of content."""
    g = Region(unitigs, overlap)
    into = Counter(v for found in g.next.values() for v in found)
    link = {c: found[0] for c, found in g.next.items() if len(found) == 1 and into[found[0]] == 1 and found[0] != c}
    behind = {v: u for u, v in link.items()}
    found, seen = set(), set()
    # Heads first; what is left then lies on cycles.
    for head in [c for c in g.path if c not in behind] + sorted(behind):
        if head in seen:
            continue
        way, c = [], head
        while c is not None and c not in seen:
            seen.add(c)
            way.append(c)
            c = link.get(c)
        m, a = list(g.path[head]), list(g.weights(head))
        for c in way[1:]:
            m += g.path[c][overlap:]
            a += g.weights(c)
        m, a = tuple(m), tuple(a)
        if head in behind:
            found.add((*opened(m, a, overlap), True))
        else:
            # A single node that follows itself stays a ring.
            ring = len(way) == 1 and g.unitigs[head >> 1][2] if len(g.unitigs[head >> 1]) > 2 else False
            found.add((*min((m, a), (m[::-1], a[::-1])), bool(ring)))
    return sorted(found)


def superbubble(g: Region, source: int, longest: int) -> tuple[int, list[int]] | None:
    """Exit and inner nodes (in an order that respects edges) of the smallest superbubble behind ``source``.

    All ways from the source meet again in the exit, none leaves or ends before it,
    none returns to the source or to the other strand of what was seen, no node has
    more than MANY successors, and no way is longer than ``longest`` minimizers.
    """
    if not 1 < len(g.next[source]) <= MANY:
        return None
    visited: dict[int, None] = {}
    far, ready = {source: 0}, [source]
    while ready:
        v = ready.pop()
        visited[v] = None
        if not g.next[v] or len(g.next[v]) > MANY or far[v] > longest:
            return None
        for w in g.next[v]:
            if w == source or (g.flip(w) != w and g.flip(w) in far) or w in visited:
                return None
            step = far[v] + len(g.path[w]) - g.overlap
            if w not in far or far[w] < step:
                far[w] = step
            if all(u in visited for u in g.before[w]):
                ready.append(w)
        if len(ready) == 1 and len(far) == len(visited) + 1:
            exit_ = ready[0]
            inner = [v for v in visited if v != source]
            if source in g.next[exit_] or exit_ >> 1 == source >> 1:
                return None
            return exit_, inner
    return None


def heaviest(g: Region, source: int, exit_: int, inner: list[int]) -> set[int]:
    """Nodes of the heaviest way through a bubble, at the highest floor at which there is one."""
    least = min(g.abundance[source >> 1], g.abundance[exit_ >> 1])
    for floor in FLOORS:
        best: dict[int, tuple] = {source: (0.0, ())}
        for v in [*inner, exit_]:
            if v != exit_ and g.abundance[v >> 1] < floor * least:
                continue
            gain = 0.0 if v == exit_ else g.abundance[v >> 1]
            own = () if v == exit_ else (v,)
            for u in g.before[v]:
                if u in best:
                    way = (best[u][0] + gain, best[u][1] + own)
                    if v not in best or _better(g, way, best[v]):
                        best[v] = way
        if exit_ in best:
            return set(best[exit_][1])
    return set(inner)


def _better(g: Region, a: tuple, b: tuple) -> bool:
    """Heavier; of equally heavy ways the one whose sequence is the smaller on either strand."""
    if a[0] != b[0]:
        return a[0] > b[0]
    spell = lambda way: min(tuple(g.path[c] for c in way), tuple(g.path[g.flip(c)] for c in reversed(way)))
    return spell(a[1]) < spell(b[1])


def bubble_key(g: Region, source: int, exit_: int, inner: list[int]) -> tuple:
    """What orders bubbles and is the same for one and its mirror: size, inner contents, contents of the ends."""
    content = tuple(sorted(min(g.path[c], g.path[g.flip(c)]) for c in inner))
    return len(content), content, min((g.path[source], g.path[exit_]), (g.path[g.flip(exit_)], g.path[g.flip(source)]))


def bubbles(g: Region, longest: int) -> list[tuple[int, int, list[int]]]:
    """Bubbles to collapse in one round: ``(source, exit, inner)``, smaller ones first, none touching another's inside."""
    found = {}
    for source in g.path:
        b = superbubble(g, source, longest)
        if b:
            key = bubble_key(g, source, *b)
            # A bubble and its mirror are the same; the one whose source reads smaller speaks for both.
            if key not in found or g.path[source] < g.path[found[key][0]]:
                found[key] = (source, *b)
    taken, inside, ends = [], set(), set()
    for key in sorted(found):
        source, exit_, inner = found[key]
        nodes, tips_ = {c >> 1 for c in inner}, {source >> 1, exit_ >> 1}
        if not nodes & (inside | ends) and not tips_ & inside:
            taken.append(found[key])
            inside |= nodes
            ends |= tips_
    return taken


def lost_sides(g: Region, longest: int) -> set[int]:
    """Nodes that collapsing a round's bubbles removes."""
    gone = set()
    for source, exit_, inner in bubbles(g, longest):
        kept = {c >> 1 for c in heaviest(g, source, exit_, inner)}
        gone |= {c >> 1 for c in inner} - kept
    return gone


def tips(g: Region, longest: int) -> set[int]:
    """Nodes that a round of tip clipping removes; where all successors are tips the best one stays."""
    gone = set()
    for found in g.next.values():
        if len(found) > 1:
            short = [v for v in found if not g.next[v] and len(g.path[v]) <= longest]
            if len(short) == len(found):
                rank = lambda v: (-len(g.path[v]), -g.abundance[v >> 1], min(g.path[v], g.path[g.flip(v)]), v & 1)
                short.remove(min(short, key=rank))
            gone |= {v >> 1 for v in short}
    return gone


def simplified(unitigs: list, overlap: int, longest: int) -> list[Unitig]:
    """Bubbles, then tips, compacting after each, until neither is found."""
    now = compacted(unitigs, overlap)
    while True:
        changed = False
        for find in (lost_sides, tips):
            gone = find(Region(now, overlap), longest)
            if gone:
                now = compacted([u for i, u in enumerate(now) if i not in gone], overlap)
                changed = True
        if not changed:
            return now


def lasting(unitigs: list[Unitig], overlap: int) -> list[Unitig]:
    """Without unitigs that touch no other and were seen just once."""
    if all(abundance_of(u) > 1 for u in unitigs):
        return unitigs
    g = Region(unitigs, overlap)
    touched = {c >> 1 for c, found in g.next.items() for v in found if v >> 1 != c >> 1} | {v >> 1 for c, found in g.next.items() for v in found if v >> 1 != c >> 1}
    return [u for i, u in enumerate(unitigs) if i in touched or abundance_of(u) != 1]


def snapshots(unitigs: list, overlap: int, longest: int, first: float = FIRST_CUTOFF) -> list[tuple[float, list[Unitig]]]:
    """States of the region as its weakest unitigs go, each with the cutoff at which it came about (0 at first)."""
    now = simplified(unitigs, overlap, longest)
    shots, t = [(0.0, lasting(now, overlap))], first
    most = max(map(abundance_of, now), default=0.0)
    while now and t <= min(most, LIMIT):
        if min(map(abundance_of, now)) < t:
            now = simplified([u for u in now if abundance_of(u) >= t], overlap, longest)
            shots.append((t, lasting(now, overlap)))
        t = after(t)
    return shots


def chosen(shots: list[tuple[float, list[Unitig]]], k: int) -> list[tuple[float, Unitig]]:
    """Contigs from the strictest state down: unitigs of twice the cutoff, unless one taken before has a k-min-mer of theirs."""
    used: set[tuple[int, ...]] = set()
    out = []
    for cutoff, unitigs in sorted(shots, key=lambda s: -s[0]):
        for u in unitigs:
            if abundance_of(u) < cutoff * 2:
                continue
            windows = {min(w, w[::-1]) for w in (u[0][i : i + k] for i in range(len(u[0]) - k + 1))}
            if not windows & used:
                used |= windows
                out.append((cutoff, u))
    return out


def windows(path: tuple[int, ...], k: int) -> list[tuple[int, ...]]:
    """Normalised k-min-mers of a sequence, in order."""
    return [min(w, w[::-1]) for w in (path[i : i + k] for i in range(len(path) - k + 1))]


def connected(solid: dict[tuple[int, ...], int], sequences: Iterable[tuple[int, ...]], k: int) -> Iterator[tuple[dict, set]]:
    """Components of a graph of k-min-mers, each with the stretches of the sequences that lie in it.

    Stretches of a single k-min-mer are left out.
    """
    ends = defaultdict(list)
    sides = lambda m: (min(e, e[::-1]) for e in (m[:-1], m[1:]))
    for m in solid:
        for e in sides(m):
            ends[e].append(m)
    number, parts = {}, []
    for start in solid:
        if start in number:
            continue
        number[start], left, held = len(parts), [start], {}
        while left:
            m = left.pop()
            held[m] = solid[m]
            for e in sides(m):
                # Whoever comes second finds nothing more here.
                for other in ends.pop(e, ()):
                    if other not in number:
                        number[other] = len(parts)
                        left.append(other)
        parts.append((held, set()))
    for s in sequences:
        begin, last = 0, None
        for i, w in enumerate([*windows(s, k), None]):
            at = number.get(w)
            if at is None or last is None:
                if last is not None and i - begin > 1:
                    piece = s[begin : i + k - 1]
                    parts[last][1].add(min(piece, piece[::-1]))
                begin, last = i, at
    return iter(parts)


#: First k whose contigs are set aside where they are too short for the next.
SMALL_K = 8


def grown(solid: dict[tuple[int, ...], int], sequences: Iterable[tuple[int, ...]], first_k: int, last_k: int, longest: Callable[[int], int]) -> list[tuple[str, int, float, Unitig]]:
    """The passes of growing k over a component: rows ``kind, k, cutoff, unitig``.

    ``solid``: its k-min-mers of ``first_k`` with their abundances; ``sequences``: the
    stretches of reads that lie in it.  A k-min-mer of a later pass is solid if both
    its parts are, so a component of one pass only falls apart in the next, and each
    part goes on for itself.  ``graph``, ``contig``, ``solid``: what a part's last pass
    leaves; ``short``: contigs of no more than one k-min-mer, from SMALL_K on;
    ``first``: a unitig of the first pass, if it has any.
    """
    out, waiting = [], [(first_k, *part) for part in connected(solid, sequences, first_k)]
    while waiting:
        k, solid, sequences = waiting.pop()
        shots = snapshots([(m, (a,), False) for m, a in solid.items()], k - 1, longest(k))
        unitigs, contigs = shots[0][1], chosen(shots, k)
        if k == first_k and unitigs:
            out.append(("first", k, 0.0, unitigs[0]))
        told: dict[tuple[int, ...], int] = {}
        for _, u in contigs:
            a = math.ceil(abundance_of(u))
            for w in windows(u[0], k):
                told[w] = max(told.get(w, 0), a if len(u[0]) == k else max(a, 2))
        # A contig seen once makes its k-min-mers unknown again.
        solid = solid | {w: 0 if a == 1 else a for w, a in told.items()}
        deeper: dict[tuple[int, ...], int] = {}
        if k < last_k:
            for s in [*sequences, *(u[0] for _, u in contigs)]:
                known = [solid.get(w, 1) for w in windows(s, k)]
                for i in range(len(known) - 1):
                    a = min(known[i], known[i + 1])
                    if a > 1:
                        w = s[i : i + k + 1]
                        deeper[min(w, w[::-1])] = a
        if deeper and _is_path(solid, unitigs, contigs, deeper, k):
            # What is one path stays that path, with one abundance, until k exceeds it.
            path, a = unitigs[0][0], next(iter(deeper.values()))
            k, deeper = min(last_k, len(path)), {}
            unitigs = [(path, (a,) * (len(path) - k + 1), False)]
            contigs, solid = [(0.0, unitigs[0])], dict.fromkeys(windows(path, k), a)
        if k >= SMALL_K:
            out += [("short", k, t, u) for t, u in contigs if len(u[0]) <= k and abundance_of(u) > 1]
        if deeper:
            # Contigs count in the next pass alone; it has contigs of its own for the one after.
            waiting += [(k + 1, *part) for part in connected(deeper, sequences, k + 1)]
        else:
            out += [("graph", k, 0.0, u) for u in unitigs]
            out += [("contig", k, t, u) for t, u in contigs]
            out += [("solid", k, 0.0, (m, (a,), False)) for m, a in solid.items()]
    return out


def _is_path(solid: dict, unitigs: list[Unitig], contigs: list[tuple[float, Unitig]], deeper: dict, k: int) -> bool:
    """Whether a component is one unbranched path, which it has each k-min-mer of once, and the next pass has nothing else."""
    if len(unitigs) != 1 or contigs != [(0.0, unitigs[0])] or unitigs[0][2]:
        return False
    own = windows(unitigs[0][0], k)
    return len(own) == len(solid) == len(set(own)) and all(w != w[::-1] for w in own) and deeper.keys() == set(windows(unitigs[0][0], k + 1))
