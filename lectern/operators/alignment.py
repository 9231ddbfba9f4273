"""Bounded alignment of two readers' records of a page, by place first and text last.

Each side's records with a place become fragments; fragments side by side make lines, lines of both sides that meet
make blocks. In a block, spans of one to four neighbours are paired by place, order and text, and a dynamic programme
over both sides' reading order picks the cheapest pairing without crossings. A pair is accepted only if it is cheap and
the next best pairing is clearly dearer; else it is reported with all its rivals. Nothing is guessed: records without a
place, blocks that are too large and records without a partner keep statuses of their own.

`align_page` is plain Python on one page; `align` gathers each page's records in one row and runs it over batches of these.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate, combinations, product
from statistics import median

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import text_distance

#: Fixed values of the matching rule region-match-v1.
VERSION = "region-match-v1"
WEIGHT_GEOMETRY, WEIGHT_ORDER, WEIGHT_TEXT = 0.65, 0.2, 0.15
ACCEPT_COST, MIN_MARGIN = 0.45, 0.12
MAX_SPAN, MAX_COMPONENT = 4, 64
OVERLAP_MIN, GAP_LINES, GAP_MAX = 0.5, 1.5, 24
UNMATCHED, PREFERENCE, EXPAND_Y = 0.5, 0.2, 0.25
PRECISE = ("exact", "estimated")

Box = tuple[float, float, float, float]


class AlignmentError(ValueError):
    """Input that no alignment is defined for; `code` says why."""

    def __init__(self, code: str, what: str) -> None:
        super().__init__(what)
        self.code = code


@dataclass(frozen=True)
class Record:
    id: str
    ordinal: int
    text: str
    polygon: Sequence[Sequence[float]] | None
    precision: str = "exact"
    page: int = 0


@dataclass(eq=False)
class Fragment:
    index: int
    record: Record
    box: Box
    rank: float = 0.0
    place: int = 0  # in its block's reading order

    @property
    def height(self) -> float:
        return self.box[3] - self.box[1]


@dataclass(eq=False)
class Run:
    members: list[Fragment]
    box: Box


@dataclass(eq=False)
class Span:
    members: list[Fragment]
    box: Box

    @property
    def start(self) -> int:
        return self.members[0].place

    @property
    def text(self) -> str:
        return "".join(f.record.text for f in self.members)

    def mean(self, what) -> float:
        return sum(map(what, self.members)) / len(self.members)


@dataclass(eq=False)
class Pair:
    left: Span
    right: Span
    geometry: float
    order: float
    text: float
    cost: float

    def sides(self) -> tuple[frozenset[int], frozenset[int]]:
        return self._sides

    def __post_init__(self) -> None:
        self._sides = tuple(frozenset(f.index for f in s.members) if s else frozenset() for s in (self.left, self.right))

    def scores(self) -> dict:
        return {"geometry_distance": self.geometry, "order_distance": self.order, "text_distance": self.text, "cost": self.cost}


def hull(boxes: Iterable[Box]) -> Box:
    a, b, c, d = zip(*boxes, strict=True)
    return min(a), min(b), max(c), max(d)


def _bounds(polygon) -> Box:
    xs, ys = zip(*polygon, strict=True)
    return min(xs), min(ys), max(xs), max(ys)


def band_overlap(a: Box, b: Box) -> float:
    shared, lower = min(a[3], b[3]) - max(a[1], b[1]), min(a[3] - a[1], b[3] - b[1])
    return shared / lower if shared > 0 and lower > 0 else 0.0


def gap(a: Box, b: Box) -> float:
    return max(0.0, a[0] - b[2], b[0] - a[2])


def meet(a: Box, b: Box) -> bool:
    return a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]


def _near(a: Box, b: Box, tolerance: float) -> bool:
    return meet(a, b) or band_overlap(a, b) >= OVERLAP_MIN and gap(a, b) <= tolerance


def _cross(o, a, b) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def _edges(p) -> list:
    return [(p[i], p[(i + 1) % len(p)]) for i in range(len(p))]


def _inside(point, polygon) -> bool:
    x, y = point
    odd = False
    for (ax, ay), (bx, by) in _edges(polygon):
        if abs(_cross((ax, ay), (bx, by), point)) <= 1e-9 and min(ax, bx) - 1e-9 <= x <= max(ax, bx) + 1e-9 and min(ay, by) - 1e-9 <= y <= max(ay, by) + 1e-9:
            return True
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def polygons_meet(p, q) -> bool:
    """Whether two polygons share a point: a corner of one in the other, or crossing edges."""
    if not meet(_bounds(p), _bounds(q)):
        return False
    if any(_inside(v, q) for v in p) or any(_inside(v, p) for v in q):
        return True
    opposite = lambda s, e: _cross(*s, e[0]) * _cross(*s, e[1]) <= 0
    return any(opposite(s, e) and opposite(e, s) for s, e in product(_edges(p), _edges(q)))


def _usable(polygon) -> bool:
    return len(polygon) >= 3 and all(len(v) == 2 and all(map(math.isfinite, v)) for v in polygon)


def _area(polygon) -> float:
    total, (ax, ay) = 0, polygon[0]
    for bx, by in (*polygon[1:], polygon[0]):
        total += ax * by - bx * ay
        ax, ay = bx, by
    return total / 2


def classify(record: Record, page: int, region) -> tuple[str, bool]:
    """localized, page_level or out_of_scope; and whether a place was given that is none."""
    if record.page != page:
        return "out_of_scope", False
    if record.polygon is None or record.precision not in PRECISE:
        return "page_level", False
    if not _usable(record.polygon) or _area(record.polygon) == 0:
        return "page_level", True
    if region is not None and not polygons_meet(record.polygon, region):
        return "out_of_scope", False
    return "localized", False


def runs(fragments: list[Fragment], tolerance: float) -> list[Run]:
    """Lines, cut where the next fragment is further right than the tolerance. Fragments are of one line if their
    bands overlap by half or a chain of others joins them; lines come in the order of their first fragments."""
    group = {f.index: [f] for f in fragments}
    downward = sorted(fragments, key=lambda f: f.box[1])
    for k, a in enumerate(downward):
        for n in range(k + 1, len(downward)):
            b = downward[n]
            if b.box[1] >= a.box[3]:
                break
            if band_overlap(a.box, b.box) >= OVERLAP_MIN and group[a.index] is not group[b.index]:
                into, of = group[a.index], group[b.index]
                into += of
                for f in of:
                    group[f.index] = into
    out: list[Run] = []
    done: set[int] = set()
    for first in fragments:
        line = group[first.index]
        if id(line) in done:
            continue
        done.add(id(line))
        now = None
        for f in sorted(line, key=lambda f: (f.box[0], f.index)):
            if now is None or gap(now.box, f.box) > tolerance:
                now = Run([], f.box)
                out.append(now)
            now.members.append(f)
            now.box = hull((now.box, f.box))
    return out


def blocks(left: list[Run], right: list[Run], tolerance: float) -> tuple[list[tuple[list[Run], list[Run]]], int, int, int]:
    """Connected runs of both sides, in the order of their first left runs; unlinked runs of either; tests made."""
    tests = 0
    links: dict[tuple, set[tuple]] = defaultdict(set)
    downward = sorted(range(len(right)), key=lambda j: right[j].box[1])
    tops = [right[j].box[1] for j in downward]
    lowest = list(accumulate((right[j].box[3] for j in downward), max))
    for i, a in enumerate(left):
        below = bisect_left(tops, a.box[3])  # from here on they begin below a
        tests += below
        for j in downward[bisect_left(lowest, a.box[1]) : below]:  # those before end above a
            b = right[j]
            if _near(a.box, b.box, tolerance):
                links["l", i].add(("r", j))
                links["r", j].add(("l", i))
    out, seen = [], set()
    for i in range(len(left)):
        if ("l", i) in seen or ("l", i) not in links:
            continue
        found, todo = set(), [("l", i)]
        while todo:
            node = todo.pop()
            if node not in found:
                found.add(node)
                todo += links[node] - found
        seen |= found
        out.append(([left[k] for s, k in sorted(found) if s == "l"], [right[k] for s, k in sorted(found) if s == "r"]))
    linked = {s: sum(1 for side, _ in links if side == s) for s in "lr"}
    return out, len(left) - linked["l"], len(right) - linked["r"], tests


def _spans(side: list[Run], region: Box | None) -> list[Span]:
    """Numbers the fragments in reading order, ranks them by ordinal, and lists spans of neighbours."""
    ordered = sorted(side, key=lambda r: (r.box[1], r.box[0]))
    members = [f for r in ordered for f in r.members]
    for place, f in enumerate(members):
        f.place = place
    # ties keep the order in which the block holds them
    for k, f in enumerate(sorted((f for r in side for f in r.members), key=lambda f: f.record.ordinal)):
        f.rank = k / (len(members) - 1) if len(members) > 1 else 0.0
    out = []
    for r in ordered:
        for s in range(len(r.members)):
            for n in range(1, min(MAX_SPAN, len(r.members) - s) + 1):
                own = r.members[s : s + n]
                box = hull(f.box for f in own)
                if region and not (box[0] >= region[0] and box[1] >= region[1] and box[2] <= region[2] and box[3] <= region[3]):
                    break
                out.append(Span(own, box))
    return out


def _geometry(a: Span, b: Span, tolerance: float, within: Box) -> float:
    dx, dy = tolerance / 2, EXPAND_Y * min(a.box[3] - a.box[1], b.box[3] - b.box[1])
    wide = [(s.box[0] - dx, s.box[1] - dy, s.box[2] + dx, s.box[3] + dy) for s in (a, b)]
    size = [max(0, w[2] - w[0]) * max(0, w[3] - w[1]) for w in wide]
    shared = max(0, min(w[2] for w in wide) - max(w[0] for w in wide)) * max(0, min(w[3] for w in wide) - max(w[1] for w in wide))
    union = size[0] + size[1] - shared
    if shared > 0 and union > 0:
        return min(1.0, max(0.0, 1 - shared / union))
    diagonal = math.hypot(within[2] - within[0], within[3] - within[1])
    apart = math.hypot((a.box[0] + a.box[2] - b.box[0] - b.box[2]) / 2, (a.box[1] + a.box[3] - b.box[1] - b.box[3]) / 2)
    return min(1.0, apart / diagonal) if diagonal > 0 else 1.0


def _pair(a: Span, b: Span, tolerance: float, within: Box) -> Pair:
    g = _geometry(a, b, tolerance, within)
    o = min(1.0, abs(a.mean(lambda f: f.rank) - b.mean(lambda f: f.rank)))
    t = text_distance(a.text, b.text)
    return Pair(a, b, g, o, t, min(1.0, max(0.0, WEIGHT_GEOMETRY * g + WEIGHT_ORDER * o + WEIGHT_TEXT * t)))


Moves = dict[tuple[int, int], list[tuple[int, int, Pair]]]


def _moves(pairs: Iterable[tuple[int, int, int, int, Pair]]) -> Moves:
    """Pairs by where they end: (fragments used on the left, on the right, pair), shorter ones first."""
    out: Moves = defaultdict(list)
    for i, a, j, b, p in pairs:
        out[i + a, j + b].append((a, b, p))
    for at in out.values():
        at.sort(key=lambda m: m[:2])
    return out


class Solver:
    """Cheapest pairings without crossings; counts what it does."""

    def __init__(self) -> None:
        self.cells = self.solves = 0

    def solve(self, n: int, m: int, moves: Moves, without: Pair | None = None) -> tuple[float, list[Pair]]:
        """Cost and pairs, last one first. Pairs win ties over leaving a fragment alone, shorter pairs over longer."""
        self.solves += 1
        self.cells += (n + 1) * (m + 1) - 1
        best = [[0.0] * (m + 1) for _ in range(n + 1)]
        came: dict[tuple[int, int], tuple[int, int, Pair | None]] = {}
        for at in product(range(n + 1), range(m + 1)):
            i, j = at
            if at == (0, 0):
                continue
            ways = [(best[i - a][j - b] + p.cost - PREFERENCE, a, b, p) for a, b, p in moves.get(at, ()) if p is not without]
            if i:
                ways.append((best[i - 1][j] + UNMATCHED, 1, 0, None))
            if j:
                ways.append((best[i][j - 1] + UNMATCHED, 0, 1, None))
            least = min(ways, key=lambda w: w[0])  # the first of equals
            best[i][j], came[at] = least[0], least[1:]
        out, at = [], (n, m)
        while at != (0, 0):
            a, b, p = came[at]
            if p is not None:
                out.append(p)
            at = at[0] - a, at[1] - b
        return best[n][m], out


def _positions(members: list[Fragment], order: dict[int, int]) -> int | None:
    """Where a span starts in a list of fragments, if it is there without a break."""
    at = [order.get(f.index) for f in members]
    if None in at or any(b != a + 1 for a, b in zip(at, at[1:])):
        return None
    return at[0]


class Rivals:
    """A block's candidate pairs by the fragments they use, on either side."""

    def __init__(self, pairs: list[Pair]) -> None:
        self.pairs = pairs
        self.using: tuple[dict, dict] = defaultdict(list), defaultdict(list)
        self.starting: dict[int, list[Pair]] = defaultdict(list)
        for k, p in enumerate(pairs):
            self.starting[p.left.members[0].index].append(p)
            for side in (0, 1):
                for x in p.sides()[side]:
                    self.using[side][x].append(k)

    def of(self, own: Pair) -> list[Pair]:
        """Pairs that share a fragment with `own`, itself too, in order."""
        return [self.pairs[k] for k in sorted({k for side in (0, 1) for x in own.sides()[side] for k in self.using[side][x]})]


def _exchange(own: Pair, rivals: Rivals, optimum: float, chosen: tuple[dict, dict], place: tuple[dict, dict], solver: Solver) -> float:
    """Least extra cost of taking another pair that shares a fragment with `own`, where that upsets two more chosen
    pairs at most; what these leave over is paired anew or stays alone."""
    least = math.inf
    for q in rivals.of(own):
        if q is own:
            continue
        theirs = q.sides()
        upset = {id(own): own}
        for side in (0, 1):
            for f in (q.left, q.right)[side].members:
                if f.index in chosen[side]:
                    upset[id(chosen[side][f.index])] = chosen[side][f.index]
        if len(upset) > 3:
            continue
        freed = [set().union(*(p.sides()[side] for p in upset.values())) for side in (0, 1)]
        covered = sum(len(theirs[side] - freed[side]) for side in (0, 1))
        order = [{x: k for k, x in enumerate(sorted(freed[side] - theirs[side], key=place[side].__getitem__))} for side in (0, 1)]
        again = []
        for x, i in order[0].items():
            for p in rivals.starting.get(x, ()):
                j = _positions(p.right.members, order[1])
                if j is not None and _positions(p.left.members, order[0]) is not None:
                    again.append((i, len(p.left.members), j, len(p.right.members), p))
        rescue, _ = solver.solve(len(order[0]), len(order[1]), _moves(again))
        removed = sum(PREFERENCE - p.cost for p in upset.values())
        other = optimum + removed + (q.cost - PREFERENCE) - UNMATCHED * covered + rescue
        least = min(least, other - optimum)
    return least


def _provenance(a: int, b: int) -> str:
    return ("one" if a == 1 else "many") + "_to_" + ("one" if b == 1 else "many")


def _ids(members: Iterable[Fragment]) -> list[str]:
    return [f.record.id for f in members]


def _match_single(left: Fragment, right: Fragment, tolerance: float, solver: Solver) -> dict:
    """match_block of one fragment a side: the pair is taken, for it costs less than two fragments alone."""
    left.place = right.place = 0
    left.rank = right.rank = 0.0
    a, b = left.box, right.box
    pair = _pair(Span([left], a), Span([right], b), tolerance, hull((a, b)))
    solver.solves += 2  # with the pair and without it
    solver.cells += 6
    margin = 2 * UNMATCHED - (pair.cost - PREFERENCE)
    out: dict = {"matches": [], "ambiguous": [], "spans": (1, 1), "pairs": 1}
    ids = {"left": [left.record.id], "right": [right.record.id]}
    unit = {**ids, "margin": margin, **pair.scores()}
    if pair.cost <= ACCEPT_COST and margin >= MIN_MARGIN:
        out["matches"].append(unit | {"provenance": "one_to_one", "extent_left": a, "extent_right": b})
    else:
        out["ambiguous"].append(unit | {"reason": "tie" if margin < MIN_MARGIN else "weak", "candidates": [{**ids, **pair.scores()}]})
    return out


def match_block(left: list[Run], right: list[Run], tolerance: float, region: Box | None, solver: Solver) -> dict:
    """Accepted and ambiguous units of a block, in the order in which the programme's path is read back."""
    if region is None and len(left) == len(right) == len(left[0].members) == len(right[0].members) == 1:
        return _match_single(left[0].members[0], right[0].members[0], tolerance, solver)
    within = hull(r.box for r in (*left, *right))
    spans = _spans(left, region), _spans(right, region)
    pairs = [_pair(a, b, tolerance, within) for a, b in product(*spans) if _near(a.box, b.box, tolerance)]
    sizes = [sum(len(r.members) for r in side) for side in (left, right)]
    moves = _moves((p.left.start, len(p.left.members), p.right.start, len(p.right.members), p) for p in pairs)
    optimum, path = solver.solve(*sizes, moves)
    chosen: tuple[dict, dict] = {}, {}
    for p in path:
        chosen[0].update((f.index, p) for f in p.left.members)
        chosen[1].update((f.index, p) for f in p.right.members)
    place = tuple({f.index: f.place for r in side for f in r.members} for side in (left, right))
    margins, rivals_of = {}, Rivals(pairs)
    for p in path:
        cost, _ = solver.solve(*sizes, moves, p)
        margins[id(p)] = min(cost - optimum, _exchange(p, rivals_of, optimum, chosen, place, solver))
    good = [p for p in path if p.cost <= ACCEPT_COST and margins[id(p)] >= MIN_MARGIN]
    turned = set()
    emitted = lambda s: s.mean(lambda f: f.record.ordinal)
    for p, q in combinations(good, 2):
        if (emitted(p.left) - emitted(q.left)) * (emitted(p.right) - emitted(q.right)) < 0:
            turned |= {id(p), id(q)}
    accepted = {id(p) for p in good} - turned
    out: dict = {"matches": [], "ambiguous": [], "spans": tuple(map(len, spans)), "pairs": len(pairs)}
    for p in path:
        unit = {"left": _ids(p.left.members), "right": _ids(p.right.members), "margin": margins[id(p)], **p.scores()}
        if id(p) in accepted:
            out["matches"].append(unit | {"provenance": _provenance(len(p.left.members), len(p.right.members)), "extent_left": p.left.box, "extent_right": p.right.box})
            continue
        rivals = rivals_of.of(p)
        reason = "order_conflict" if id(p) in turned else "tie" if margins[id(p)] < MIN_MARGIN else "weak"
        rivals = [{"left": _ids(q.left.members), "right": _ids(q.right.members), **q.scores()} for q in sorted(rivals, key=lambda q: q.cost)]
        out["ambiguous"].append(unit | {"reason": reason, "candidates": rivals})
    return out


def turned_places(values: list[int]) -> tuple[list[int], int]:
    """Places of a list that are in a pair whose first is greater, as a loop over all pairs would meet them; the number
    of such pairs."""
    highest = list(accumulate(values, max))
    if highest == values:
        return [], 0
    lowest = list(accumulate(reversed(values), min))[::-1]
    met, before, pairs = [], [], 0
    for k, v in enumerate(values):
        i = bisect_right(highest, v)  # the first place with a greater value, if that is before k
        if i < k:
            met.append((i, k))
        elif k + 1 < len(values) and lowest[k + 1] < v:
            met.append((k, k))
        pairs += k - bisect_right(before, v)
        insort(before, v)
    return [k for _, k in sorted(met)], pairs


def align_page(left: list[Record], right: list[Record], page: int | None = None, region=None) -> dict:
    """statuses of all records (left, right: id, status, detail), matches, ambiguous, abstentions, order_differences,
    page_level ids and diagnostics. `region` is a polygon: what does not meet it is out of scope."""
    for side, name in ((left, "left"), (right, "right")):
        if len({r.id for r in side}) < len(side):
            raise AlignmentError("ID", f"two {name} records have one id")
    if page is None:
        pages = {r.page for r in (*left, *right)}
        if len(pages) > 1:
            raise AlignmentError("PAGE", "records of several pages need a page")
        page = pages.pop() if pages else 0
    if region is not None and (not _usable(region) or _area(region) == 0):
        raise AlignmentError("GEOMETRY", "the region is no polygon with an area")
    kinds = [[classify(r, page, region) for r in side] for side in (left, right)]
    parts = [[Fragment(i, r, _bounds(r.polygon)) for i, (r, k) in enumerate(zip(side, kind, strict=True)) if k[0] == "localized"] for side, kind in zip((left, right), kinds, strict=True)]
    heights = [f.height for side in parts for f in side]
    middle = median(heights) if heights else 0.0
    tolerance = min(GAP_LINES * middle, GAP_MAX)
    lines = [runs(side, tolerance) for side in parts]
    found, alone_left, alone_right, tests = blocks(*lines, tolerance)
    solver = Solver()
    status: tuple[dict, dict] = {}, {}
    out: dict = {"algorithm": VERSION, "page": page, "region_scoped": region is not None, "matches": [], "ambiguous": [], "abstentions": []}
    totals = {"spans_left": 0, "spans_right": 0, "pairs": 0}
    bounds = None if region is None else _bounds(region)
    for own in found:
        members = [[f for r in side for f in r.members] for side in own]
        by_id = [{f.record.id: f.index for f in side} for side in members]
        if max(map(len, members)) > MAX_COMPONENT:
            for s in (0, 1):
                status[s].update((f.index, ("abstained", len(out["abstentions"]))) for f in members[s])
            out["abstentions"].append({"reason": "component_too_large", "left": _ids(members[0]), "right": _ids(members[1])})
            continue
        got = match_block(*own, tolerance, bounds, solver)
        for key, n in zip(totals, (*got["spans"], got["pairs"]), strict=True):
            totals[key] += n
        for unit in got["matches"]:
            for s, side in enumerate(("left", "right")):
                status[s].update((by_id[s][i], ("unique", len(out["matches"]))) for i in unit[side])
            out["matches"].append(unit)
        for unit in got["ambiguous"]:
            for touched in (unit, *unit["candidates"]):
                for s, side in enumerate(("left", "right")):
                    for i in touched[side]:
                        if status[s].get(by_id[s][i], ("",))[0] != "unique":
                            status[s][by_id[s][i]] = ("ambiguous", len(out["ambiguous"]))
            out["ambiguous"].append(unit)
    for s, (side, name) in enumerate(((left, "left"), (right, "right"))):
        out[name] = []
        for i, (r, (kind, _)) in enumerate(zip(side, kinds[s], strict=True)):
            own = status[s].get(i, ("unmatched", None)) if kind == "localized" else (kind, None)
            out[name].append({"id": r.id, "status": own[0], "detail": own[1]})
    out["page_level"] = {n: [r.id for r, k in zip(side, kinds[s], strict=True) if k[0] == "page_level"] for s, (side, n) in enumerate(((left, "left"), (right, "right")))}
    ordinal = [{r.id: r.ordinal for r in side} for side in (left, right)]
    first = sorted(((min(ordinal[0][i] for i in m["left"]), k, min(ordinal[1][i] for i in m["right"])) for k, m in enumerate(out["matches"])), key=lambda x: x[0])
    places, inversions = turned_places([x[2] for x in first])
    turned = [first[k][1] for k in places]
    out["order_differences"] = [{"match": k, "left": out["matches"][k]["left"], "right": out["matches"][k]["right"], "order_distance": out["matches"][k]["order_distance"]} for k in turned]
    tally = lambda s, what: sum(k[0] == what for k in kinds[s])
    out["diagnostics"] = {
        **{f"{what}_{n}": tally(s, what) for what in ("localized", "page_level", "out_of_scope") for s, n in enumerate(("left", "right"))},
        "degenerate_left": sum(k[1] for k in kinds[0]), "degenerate_right": sum(k[1] for k in kinds[1]),
        "runs_left": len(lines[0]), "runs_right": len(lines[1]), "unlinked_left": alone_left, "unlinked_right": alone_right,
        "blocks": len(found), "blocks_abstained": len(out["abstentions"]), **totals, "link_tests": tests, "cells": solver.cells, "solves": solver.solves,
        "matches_unique": len(out["matches"]), "matches_ambiguous": len(out["ambiguous"]),
        **{f"unmatched_{n}": sum(x["status"] == "unmatched" for x in out[n]) for n in ("left", "right")},
        "order_inversions": inversions, "median_height": middle, "gap_tolerance": tolerance,
    }
    return out


_UNITS = (
    "kind string, seq int, occurrence_id string, status string, detail int, left_ids array<string>, right_ids array<string>, provenance string, reason string, "
    "geometry_distance double, order_distance double, text_distance double, cost double, margin double, more string"
)
_IDS = pa.list_(pa.string())
_ARROW = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), _IDS, _IDS, pa.string(), pa.string(), *[pa.float64()] * 5, pa.string()]
#: Pages that a worker holds as records at a time.
PAGES = 64


def _polygons(column: pa.Array) -> list:
    """Polygons as lists of points; null stays None."""
    points = column.flatten()
    flat = points.flatten()
    if points.null_count or flat.null_count or len(flat) != 2 * len(points) or set(points.value_lengths().to_pylist()) - {2}:
        return [None if p is None else [tuple(map(float, v)) for v in p] for p in column.to_pylist()]
    numbers = iter(flat.to_pylist())
    rest = iter(list(zip(numbers, numbers, strict=True)))
    return [None if n is None else [next(rest) for _ in range(n)] for n in column.value_lengths().to_pylist()]


def _records(column: pa.Array, pages: list[int]) -> list[list[Record]]:
    """The records of each page, by ordinal."""
    rows = column.flatten()
    names = ("id", "ordinal", "text", "precision")
    parts = {n: rows.field(n).to_pylist() for n in names} if len(rows) else dict.fromkeys(names, [])
    every = zip(parts["id"], parts["ordinal"], parts["text"], _polygons(rows.field("polygon")) if len(rows) else [], parts["precision"], strict=True)
    out = []
    for n, page in zip(column.value_lengths().to_pylist(), pages, strict=True):
        own = [Record(i, int(o), t, p, q, page) for i, o, t, p, q in (next(every) for _ in range(n))]
        out.append(sorted(own, key=lambda r: r.ordinal))
    return out


def _rows(result: dict) -> Iterator[tuple]:
    """A page's rows in the order of _UNITS."""
    none = (None,) * 10
    for side in ("left", "right"):
        for k, x in enumerate(result[side]):
            yield (side, k, x["id"], x["status"], x["detail"], *none)
    scores = ("provenance", "reason", "geometry_distance", "order_distance", "text_distance", "cost", "margin")
    for kind, name in (("match", "matches"), ("ambiguous", "ambiguous"), ("abstention", "abstentions"), ("order", "order_differences")):
        for k, u in enumerate(result[name]):
            more = json.dumps(u["candidates"]) if "candidates" in u else None
            yield (kind, k, None, None, u.get("match"), u["left"], u["right"], *map(u.get, scores), more)
    page = result["page_level"]
    yield ("page_level", 0, None, None, None, page["left"], page["right"], *none[:8])
    yield ("diagnostics", 0, *(None,) * 12, json.dumps(result["diagnostics"]))


def align(left: DataFrame, right: DataFrame, key: str = "document", region=None) -> DataFrame:
    """Aligns two readers' records (key, page_index, id, ordinal, text, polygon, precision), page by page.

    One row for each record's status, match, ambiguous unit, abstention, order difference, and two of page-level ids and
    diagnostics (JSON). A page is one row with both sides' records: these are few, while documents and pages are what
    grows.
    """
    names = [f.split()[0] for f in _UNITS.split(", ")]
    kind = left.schema[key].dataType.simpleString()
    own = F.struct(F.col("id").cast("string").alias("id"), "ordinal", F.col("text").cast("string").alias("text"), F.col("polygon").cast("array<array<double>>").alias("polygon"), F.col("precision").cast("string").alias("precision"))
    side = lambda df, n: df.select(F.col(key).cast(kind).alias(key), F.col("page_index").cast("int").alias("page_index"), F.lit(n).alias("side"), own.alias("own"))
    each = lambda n: F.collect_list(F.when(F.col("side") == n, F.col("own"))).alias(f"side{n}")
    pages = side(left, 0).unionByName(side(right, 1)).groupBy(key, "page_index").agg(each(0), each(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, len(whole), PAGES):
                batch = whole.slice(k, PAGES)
                numbers = batch.column(1).to_pylist()
                rows, counts = [], []
                for n, a, b in zip(numbers, _records(batch.column(2), numbers), _records(batch.column(3), numbers), strict=True):
                    before = len(rows)
                    rows.extend(_rows(align_page(a, b, n, region)))
                    counts.append(len(rows) - before)
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)]
                page = pa.array([i for i, n in enumerate(counts) for _ in range(n)], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(page), batch.column(1).take(page), *columns], [key, "page_index", *names])

    return pages.mapInArrow(run, f"{key} {kind}, page_index int, {_UNITS}")
