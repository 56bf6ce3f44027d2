"""Cover and assignment planning over collected catalogue rows (chunks and holders, never cells)."""

from __future__ import annotations

import math
from collections import defaultdict, deque
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Piece:
    """One chunk on offer: interval [start, end) on the lattice (stride, offset), bytes and holders."""

    key: str
    start: int
    end: int
    size: float
    holders: tuple[str, ...]
    local: bool = False


@dataclass(frozen=True)
class Family:
    """All tiles that a time chunk of a layout needs: it covers its interval only as a whole."""

    key: str
    tiles: tuple[Piece, ...]

    @property
    def start(self) -> int:
        return max(p.start for p in self.tiles)

    @property
    def end(self) -> int:
        return min(p.end for p in self.tiles)

    @property
    def size(self) -> float:
        return sum(p.size for p in self.tiles)


def families(pieces: list[tuple[str, Piece]], needed: dict[str, int]) -> list[Family]:
    """Complete families of (family key, piece); needed: number of tiles by family key."""
    found: dict[str, list[Piece]] = defaultdict(list)
    for key, p in pieces:
        found[key].append(p)
    out = [Family(key, tuple(sorted(ps, key=lambda p: p.key))) for key, ps in sorted(found.items()) if len(ps) == needed[key]]
    return [f for f in out if f.start < f.end]


# fixed values of the joint plan: slack of the best time, seconds a piece costs besides its bytes, receiver's rate, rounds, weight step
SLACK, OVERHEAD, RECEIVER, ROUNDS, EPSILON = 0.1, 0.05, 30e6, 24, 0.5


def cheapest_cover(pieces: list[Family] | list[Piece], lo: int, hi: int, price, stride: int = 1, offset: int = 0) -> list:
    """Pieces of least total price that cover every sample of [lo, hi) that any piece covers.

    Shortest path over the sorted ends of the intervals.  An elementary cell without a sample, or
    that nobody covers, is crossed for nothing; a piece may be entered anywhere inside.
    """
    pieces = sorted((p for p in pieces if p.start < hi and p.end > lo), key=lambda p: (p.start, p.end, p.key))
    marks = sorted({lo, hi, *(min(max(e, lo), hi) for p in pieces for e in (p.start, p.end))})
    at = {m: i for i, m in enumerate(marks)}
    reach = [math.inf] * len(marks)
    came: list[tuple[int, Piece | None]] = [(0, None)] * len(marks)
    reach[0] = 0.0
    spans = [(at[max(p.start, lo)], at[min(p.end, hi)], p) for p in pieces]
    held = [0] * (len(marks) + 1)
    for a, b, _ in spans:
        held[a] += 1
        held[b] -= 1
    opening = defaultdict(list)
    for a, b, p in spans:
        opening[a].append((b, p))
    active: list[tuple[int, Piece]] = []
    depth = 0
    for i in range(len(marks) - 1):
        active = [x for x in active if x[0] > i] + opening[i]
        depth += held[i]
        samples = math.ceil((marks[i + 1] - offset) / stride) - math.ceil((marks[i] - offset) / stride)
        if (not depth or not samples) and reach[i] < reach[i + 1]:
            reach[i + 1], came[i + 1] = reach[i], (i, None)
        for b, p in active:
            cost = reach[i] + price(p)
            if cost < reach[b] - 1e-15:
                reach[b], came[b] = cost, (i, p)
    out, i = [], len(marks) - 1
    while i:
        i, p = came[i]
        if p:
            out.append(p)
    return sorted(set(out), key=lambda p: p.key)


def _flow(groups: list[tuple[tuple[str, ...], float]], capacity: dict[str, float]) -> tuple[dict[tuple[int, str], float], set[str] | None]:
    """Amounts by (group, holder), and None if all are placed, else holders that are full with what only they can serve."""
    placed: dict[tuple[int, str], float] = defaultdict(float)
    room = dict(capacity)
    for g, (holders, amount) in enumerate(groups):
        left = amount
        while left > 1e-9 * max(amount, 1):
            # shortest chain of moves that ends at a holder with room
            back: dict = {h: None for h in holders}
            queue, goal = deque(holders), None
            while queue and goal is None:
                h = queue.popleft()
                if room[h] > 1e-12 * max(capacity[h], 1e-9):
                    goal = h
                    break
                for (other, at), much in list(placed.items()):
                    if at == h and much > 1e-12:
                        for k in groups[other][0]:
                            if k not in back:
                                back[k] = (h, other)
                                queue.append(k)
            if goal is None:
                return placed, set(back)
            much, h = min(left, room[goal]), goal
            while back[h]:
                before, other = back[h]
                much, h = min(much, placed[other, before]), before
            h = goal
            room[goal] -= much
            while back[h]:
                before, other = back[h]
                placed[other, h] += much
                placed[other, before] -= much
                h = before
            placed[g, h] += much
            left -= much
    return placed, None


def split(groups: list[tuple[tuple[str, ...], float]], rates: dict[str, float]) -> tuple[float, dict[tuple[int, str], float]]:
    """Least makespan of amounts that groups of holders can serve, and the amounts by (group, holder).

    The least makespan is the largest quotient, over sets of holders, of what only they can serve
    and their rates.  Each flow that does not fit names such a set, so the time rises to its
    quotient until a flow fits; there are finitely many sets.
    """
    used = sorted({h for sig, _ in groups for h in sig})
    seconds = sum(a for _, a in groups) / sum(rates[h] for h in used)
    while True:
        placed, tight = _flow(groups, {h: rates[h] * seconds for h in used})
        if tight is None:
            return seconds, placed
        own = sum(a for sig, a in groups if tight.issuperset(sig)) / sum(rates[h] for h in tight)
        seconds = max(own, seconds * (1 + 1e-12))


def assign(pieces: list[Piece], rates: dict[str, float], relays: dict[str, tuple[str, float]] | None = None, client: float | None = None) -> tuple[float, dict[str, str]]:
    """Makespan and holder of each piece: parametric flow over holder signatures, then rounding and repair.

    relays: holder to (relay, its rate), which holders behind it share; client: receiver's rate.
    """
    relays, work = relays or {}, sorted((p for p in pieces if not p.local), key=lambda p: (-p.size, p.key))
    chosen: dict[str, str] = {p.key: "local" for p in pieces if p.local}
    if not work:
        return 0.0, chosen
    for p in work:
        if not any(rates.get(h, 0) > 0 for h in p.holders):
            raise ValueError(f"nobody serves {p.key}")
    groups_of: dict[tuple[str, ...], list[Piece]] = defaultdict(list)
    for p in work:
        groups_of[tuple(sorted(h for h in p.holders if rates.get(h, 0) > 0))].append(p)
    groups = [(sig, sum(p.size for p in ps)) for sig, ps in sorted(groups_of.items())]
    used = sorted({h for sig, _ in groups for h in sig})
    total = sum(a for _, a in groups)
    _, placed = split(groups, rates)
    load: dict[str, float] = defaultdict(float)
    for g, (sig, _) in enumerate(groups):
        want = {h: placed.get((g, h), 0.0) for h in sig}
        for p in groups_of[sig]:
            h = max(sig, key=lambda k: (want[k], -load[k] / rates[k], k))
            chosen[p.key] = h
            want[h] -= p.size
            load[h] += p.size
    by_key = {p.key: p for p in work}
    for _ in range(4 * len(work)):
        worst = max(used, key=lambda h: (load[h] / rates[h], h))
        now = load[worst] / rates[worst]
        best = None
        for k, h in chosen.items():
            if h != worst or k not in by_key:
                continue
            p = by_key[k]
            for to in p.holders:
                if to != worst and rates.get(to, 0) > 0:
                    then = max((load[to] + p.size) / rates[to], (load[worst] - p.size) / rates[worst])
                    if then < now - 1e-12 and (best is None or (then, k, to) < best):
                        best = (then, k, to)
        if best is None:
            break
        _, k, to = best
        load[worst] -= by_key[k].size
        load[to] += by_key[k].size
        chosen[k] = to
    bound = max(load[h] / rates[h] for h in used)
    shared: dict[str, float] = defaultdict(float)
    for h, amount in load.items():
        if h in relays:
            shared[relays[h][0]] += amount
    limits = {r: rate for r, rate in relays.values()}
    bound = max([bound, *(amount / limits[r] for r, amount in shared.items())])
    return max(bound, total / client) if client else bound, chosen


def joint_plan(
    chunks: list[Family], lo: int, hi: int, rates: dict[str, float], stride: int = 1, offset: int = 0, relays: dict[str, tuple[str, float]] | None = None, client: float | None = RECEIVER
) -> tuple[list[Family], dict[str, str], float]:
    """Cover chosen with its makespan in view: families, the holder of each of their pieces, and the time.

    Multiplicative weights give holders prices that rise with their load; each round's cheapest
    cover is a candidate, the one of fewest bytes always is.  Loads are measured against the time
    that all holders together would take for the first round's cover.  Of the covers within SLACK
    of the best time, fewest bytes wins, then time.
    """
    able = lambda p: p.local or any(rates.get(h, 0) > 0 for h in p.holders)
    serving = [f for f in chunks if all(map(able, f.tiles))]
    if not serving:
        return [], {}, 0.0
    known = sorted(r for r in rates.values() if r > 0) or [1.0]
    extra = OVERHEAD * known[len(known) // 2]
    charged = {f.key: [replace(p, size=p.size + extra) for p in f.tiles] for f in serving}
    weight = {h: 1 / r for h, r in rates.items() if r > 0}
    cheapest = lambda p: min((h for h in p.holders if h in weight), key=lambda h: (weight[h], h))
    asked = {h for ps in charged.values() for p in ps if not p.local for h in p.holders if h in weight}
    together = sum(rates[h] for h in asked) or 1.0

    def price(f: Family) -> float:
        return sum(p.size * weight[cheapest(p)] for p in charged[f.key] if not p.local)

    covers = {tuple(f.key for f in c): c for c in [cheapest_cover(serving, lo, hi, lambda f: sum(p.size for p in f.tiles if not p.local), stride, offset)]}
    reference = None
    for _ in range(ROUNDS):
        cover = cheapest_cover(serving, lo, hi, price, stride, offset)
        covers.setdefault(tuple(f.key for f in cover), cover)
        load: dict[str, float] = defaultdict(float)
        for f in cover:
            for p in charged[f.key]:
                if not p.local:
                    load[cheapest(p)] += p.size
        if not load:
            break
        reference = reference or max(sum(load.values()) / together, 1e-9)
        for h, amount in load.items():
            weight[h] *= 1 + EPSILON * amount / (rates[h] * reference)
    timed = []
    for key, c in covers.items():
        tiles = [p for f in c for p in charged[f.key]]
        seconds, holder = assign(tiles, rates, relays, client)
        timed.append((seconds, sum(p.size for p in tiles), key, holder))
    best = min(t for t, *_ in timed)
    seconds, _, key, holder = min((x for x in timed if x[0] <= (1 + SLACK) * best), key=lambda x: (x[1], x[0], x[2]))
    return covers[key], holder, seconds
