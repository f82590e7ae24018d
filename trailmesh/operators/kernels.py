"""Order-sensitive searches over one compact graph in a worker.

A distributed fixpoint gives equal costs, but which predecessor wins a tie and the order of
events are part of a search's answer; so each search runs whole in one task, many searches
in parallel. Decisions that the published behaviour leaves open are noted where they are made.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np

from ..model import BACKWARD, EARTH_RADIUS, EXAMINE, IMPROVE, METRES_PER_DEGREE, RETURN, SETTLE, SOURCE_SHIFT


@dataclass
class Compact:
    """A graph as arrays: arcs sorted by (src, edge, reversed), node positions in 1e-5 degrees."""

    x: np.ndarray
    y: np.ndarray
    src: np.ndarray
    dst: np.ndarray
    edge: np.ndarray
    back: np.ndarray
    w: np.ndarray
    edges: tuple[np.ndarray, np.ndarray, np.ndarray] | Callable[[], tuple] | None = None  # u, v, length by edge id, or what reads them

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if isinstance(v, (np.ndarray, tuple, type(None)))}

    @property
    def n(self) -> int:
        return len(self.x)

    @cached_property
    def sides(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(self.edges()) if callable(self.edges) else self.edges

    @cached_property
    def first(self) -> np.ndarray:
        """For each node its first arc, and the number of arcs at the end."""
        return np.searchsorted(self.src, np.arange(self.n + 1))

    @cached_property
    def out(self) -> Beside:
        """For each node its (arc, destination, cost) in arc order."""
        return Beside(self.first, None, self.dst, self.w)

    @cached_property
    def into(self) -> Beside:
        """For each node its incoming (arc, source, cost), by source and arc."""
        return Beside(*_dealt(self.dst, self.n), self.src, self.w)

    @cached_property
    def around(self) -> Beside:
        """For each node its incident (edge, other end, length), directions ignored; a loop is there twice."""
        u, v, w = self.sides
        first, order = _dealt(np.column_stack((u, v)).ravel(), self.n)
        return Beside(first, order, np.column_stack((v, u)).ravel(), np.repeat(w, 2), 2)


@dataclass
class Beside:
    """What is beside each node as slices of arrays, so that a graph's rows are only made for the node that is asked for."""

    first: np.ndarray
    order: np.ndarray | None  # positions by node; None if they are by node already
    other: np.ndarray
    w: np.ndarray
    each: int = 1  # positions of one id

    def __getitem__(self, u: int) -> list[tuple[int, int, int]]:
        a, b = self.first[u], self.first[u + 1]
        if self.order is None:
            return list(zip(range(a, b), self.other[a:b].tolist(), self.w[a:b].tolist(), strict=True))
        at = self.order[a:b]
        return list(zip((at // self.each).tolist(), self.other[at].tolist(), self.w[at].tolist(), strict=True))


def _dealt(node: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each node's positions begin, and the positions by node, in order."""
    order = np.argsort(node, kind="stable")
    first = np.searchsorted(node[order], np.arange(n + 1))
    return first, order.astype(np.int32) if len(order) < 2**31 else order


def _longs(values: np.ndarray) -> array:
    """The same integers in an array that is quick to read one by one."""
    out = array("q")
    out.frombytes(np.ascontiguousarray(values, np.int64).tobytes())
    return out


def _filled(n: int, value: int = -1) -> array:
    return array("q", [value]) * n


@dataclass
class Found:
    """What a search returns."""

    cost: int | None = None
    arcs: list[int] = field(default_factory=list)
    words: array = field(default_factory=lambda: array("q"))
    max_queue: int = 0
    meeting: tuple[int, int] | None = None
    reached: tuple[bytearray, array | None, array | None] | None = None  # by node: whether it was, its cost, its owner
    tree: list[int] = field(default_factory=list)
    focus: list[int] = field(default_factory=list)
    corrected: int = 0
    route: tuple[list[int], list[int], list[bool], list[int]] | None = None

    def note(self, kind: int, id: int, side: int = 0) -> None:
        self.words.append(kind | id << 2 | side)

    def counts(self) -> tuple[int, int, int]:
        kinds = np.bincount(np.frombuffer(self.words, np.int64) & 3, minlength=3) if self.words else (0, 0, 0)
        return int(kinds[0]), int(kinds[1]), int(kinds[2])

    def _by_node(self, k: int) -> dict[int, int]:
        nodes = self.nodes().tolist()
        return dict.fromkeys(nodes, 0) if self.reached is None or self.reached[k] is None else {u: self.reached[k][u] for u in nodes}

    def nodes(self) -> np.ndarray:
        return np.flatnonzero(np.frombuffer(self.reached[0], np.uint8)) if self.reached and self.reached[0] else np.zeros(0, np.int64)

    @property
    def dist(self) -> dict[int, int]:
        return self._by_node(1)

    @property
    def owner(self) -> dict[int, int]:
        return self._by_node(2)


def _walk(g: Compact, parent: array, goal: int, start: int) -> list[int]:
    arcs, at, src = [], goal, g.src
    while at != start:
        arcs.append(parent[at])
        at = int(src[parent[at]])
    return arcs[::-1]


def _onwards(g: Compact, parent: array, at: int, goal: int) -> list[int]:
    """The same from a node to the goal, by arcs that lead onwards."""
    arcs = []
    while at != goal:
        arcs.append(parent[at])
        at = int(g.dst[parent[at]])
    return arcs


# ---------------------------------------------------------------- single front
def single_front(g: Compact, start: int, goal: int | None, h=None, scale: int = 1, reopen: bool = True) -> Found:
    """Best first by (cost + scale * h, node). Only a strictly smaller cost improves; ends on settling the goal."""
    out, f, dist, parent, closed = g.out, Found(), _filled(g.n), _filled(g.n), bytearray(g.n)
    f.reached = closed, dist, None
    dist[start] = 0
    heap = [(scale * h[start] if h is not None else 0, start)]
    f.max_queue = 1
    while heap:
        _, u = heapq.heappop(heap)
        if closed[u]:
            continue
        closed[u] = 1
        f.note(SETTLE, u)
        if u == goal:
            break
        base = dist[u]
        for arc, v, w in out[u]:
            f.note(EXAMINE, arc)
            if closed[v]:
                continue  # with a consistent bound a settled node can't improve; otherwise it isn't reopened
            d = base + w
            if dist[v] < 0 or d < dist[v]:
                dist[v], parent[v] = d, arc
                f.note(IMPROVE, arc)
                heapq.heappush(heap, (d + scale * h[v] if h is not None else d, v))
        f.max_queue = max(f.max_queue, len(heap))
    if goal is not None and closed[goal]:
        f.cost, f.arcs = dist[goal], _walk(g, parent, goal, start)
    return f


def dijkstra(g, start, goal):
    return single_front(g, start, goal)


# ---------------------------------------------------------------- bounds
def planar(g: Compact, goal: int) -> np.ndarray:
    """Whole centimetres, at least: straight distance with the narrowest meridian spacing of the graph."""
    narrow = math.cos(math.radians(np.abs(g.y).max() / 1e5)) if g.n else 1.0
    dx, dy = (g.x - g.x[goal]).astype(float) * narrow, (g.y - g.y[goal]).astype(float)
    return np.floor(np.hypot(dx, dy) * (METRES_PER_DEGREE / 1000)).astype(np.int64)


def lowered(g: Compact, h: np.ndarray, backward: bool = False) -> tuple[array, int]:
    """The greatest bound below h with h(u) <= w + h(v) on every arc; how many nodes were lowered.

    Only arcs that h itself breaks start it.
    """
    low = _longs(h)
    table, own, on = (g.out, g.dst, g.src) if backward else (g.into, g.src, g.dst)
    broken = np.flatnonzero(h[own] > h[on] + g.w)
    heap = list(zip((h[on[broken]] + g.w[broken]).tolist(), own[broken].tolist(), strict=True))
    heapq.heapify(heap)
    while heap:
        value, v = heapq.heappop(heap)
        if value >= low[v]:
            continue
        low[v] = value
        for _, u, w in table[v]:
            if value + w < low[u]:
                heapq.heappush(heap, (value + w, u))
    return low, int((np.frombuffer(low, np.int64) < h).sum()) if low else 0


def repair(g: Compact, h: np.ndarray, backward: bool = False) -> tuple[list[int], int]:
    low, corrected = lowered(g, h, backward)
    return low.tolist(), corrected


def astar(g, start, goal):
    h, corrected = lowered(g, planar(g, goal))
    f = single_front(g, start, goal, h)
    f.corrected = corrected
    return f


def weighted_astar(g, start, goal, scale: int = 2):
    h, corrected = lowered(g, planar(g, goal))
    f = single_front(g, start, goal, h, scale)
    f.corrected = corrected
    return f


@dataclass
class Landmarks:
    nodes: list[int]
    away: list[np.ndarray]  # cost from the landmark to each node, -1 where unreached
    towards: list[np.ndarray]


def cost_array(g: Compact, start: int, backward: bool = False) -> np.ndarray:
    """Least cost from the start to each node (backward: from each node to it), -1 where unreached."""
    table, dist, heap, done = g.into if backward else g.out, _filled(g.n), [(0, start)], bytearray(g.n)
    dist[start] = 0
    while heap:
        d, u = heapq.heappop(heap)
        if done[u]:
            continue
        done[u] = 1
        for _, v, w in table[u]:
            if dist[v] < 0 or d + w < dist[v]:
                dist[v] = d + w
                heapq.heappush(heap, (d + w, v))
    return np.frombuffer(dist, np.int64)


def costs(g: Compact, start: int, backward: bool = False) -> dict[int, int]:
    found = cost_array(g, start, backward)
    nodes = np.flatnonzero(found >= 0)
    return dict(zip(nodes.tolist(), found[nodes].tolist(), strict=True))


def choose(g: Compact, most: int = 4) -> list[int]:
    """Landmarks: the node of greatest degree, then farthest first among nodes mutually reachable with it; ties to low ids."""
    degree = np.bincount(g.src, minlength=g.n) + np.bincount(g.dst, minlength=g.n)
    chosen = [int(degree.argmax())]
    mutual = np.flatnonzero((cost_array(g, chosen[0]) >= 0) & (cost_array(g, chosen[0], True) >= 0))
    px, py = g.x.astype(np.int64), g.y.astype(np.int64)
    far = np.full(len(mutual), np.iinfo(np.int64).max)
    while len(chosen) < most:
        far = np.minimum(far, (px[mutual] - px[chosen[-1]]) ** 2 + (py[mutual] - py[chosen[-1]]) ** 2)
        if not far.max() > 0:
            break
        chosen.append(int(mutual[far.argmax()]))
    return chosen


def landmarks(g: Compact, most: int = 4) -> Landmarks:
    chosen = choose(g, most)
    return Landmarks(chosen, [cost_array(g, m) for m in chosen], [cost_array(g, m, True) for m in chosen])


def landmark_bound(g: Compact, marks: Landmarks, goal: int) -> np.ndarray:
    h = planar(g, goal)
    for away, towards in zip(marks.away, marks.towards, strict=True):
        if away[goal] >= 0:
            h = np.where(away >= 0, np.maximum(h, away[goal] - away), h)
        if towards[goal] >= 0:
            h = np.where(towards >= 0, np.maximum(h, towards - towards[goal]), h)
    return np.maximum(h, 0)


def alt(g, start, goal, marks: Landmarks | None = None):
    h, corrected = lowered(g, landmark_bound(g, marks or landmarks(g), goal))
    f = single_front(g, start, goal, h)
    f.corrected = corrected
    return f


# ---------------------------------------------------------------- two fronts
def bidirectional(g: Compact, start: int, goal: int, guided: bool = False) -> Found:
    """The front with the smaller least key advances, ties alternate from the start's.

    Decision: the best route is updated right after an improve event; the stop test comes
    before a node is taken. With guidance keys are doubled, as the balanced bound has halves.
    """
    f = Found()
    if start == goal:
        f.note(SETTLE, start)
        f.cost = 0
        return f
    p = _filled(g.n, 0)
    if guided:
        to, _ = lowered(g, planar(g, goal))
        back, _ = lowered(g, planar(g, start), True)
        p = _longs(np.frombuffer(to, np.int64) - np.frombuffer(back, np.int64))
    tables, ends, signs = (g.out, g.into), (start, goal), (1, -1)
    dist, parent, closed = (_filled(g.n), _filled(g.n)), (_filled(g.n), _filled(g.n)), (bytearray(g.n), bytearray(g.n))
    dist[0][start] = dist[1][goal] = 0
    heaps = [[(signs[k] * p[ends[k]], ends[k])] for k in (0, 1)]
    best, middle, turn = None, None, 0
    f.max_queue = 2
    while True:
        for k in (0, 1):
            while heaps[k] and closed[k][heaps[k][0][1]]:
                heapq.heappop(heaps[k])
        if not heaps[0] or not heaps[1]:
            break
        if best is not None and heaps[0][0][0] + heaps[1][0][0] >= 2 * best:
            break
        k = turn if heaps[0][0][0] == heaps[1][0][0] else int(heaps[1][0][0] < heaps[0][0][0])
        turn = 1 - k
        side = BACKWARD if k else 0
        _, u = heapq.heappop(heaps[k])
        closed[k][u] = 1
        f.note(SETTLE, u, side)
        for arc, v, w in tables[k][u]:
            f.note(EXAMINE, arc, side)
            d = dist[k][u] + w
            if not closed[k][v] and (dist[k][v] < 0 or d < dist[k][v]):
                dist[k][v], parent[k][v] = d, arc
                f.note(IMPROVE, arc, side)
                heapq.heappush(heaps[k], (2 * d + signs[k] * p[v], v))
                if dist[1 - k][v] >= 0:
                    total = d + dist[1 - k][v]
                    if f.meeting is None:
                        f.meeting = (v, total)
                    if best is None or total < best:
                        best, middle = total, v
        f.max_queue = max(f.max_queue, len(heaps[0]) + len(heaps[1]))
    if best is not None:
        f.cost, f.arcs = best, _walk(g, parent[0], middle, start) + _onwards(g, parent[1], middle, goal)
    return f


def bidirectional_breadth_first(g: Compact, start: int, goal: int) -> Found:
    """Two FIFO fronts; the one of smaller depth expands, ties alternate from the start's."""
    f = Found()
    if start == goal:
        f.note(SETTLE, start)
        f.cost = 0
        return f
    tables, depth, parent = (g.out, g.into), (_filled(g.n), _filled(g.n)), (_filled(g.n), _filled(g.n))
    depth[0][start] = depth[1][goal] = 0
    queues = (deque([start]), deque([goal]))
    best, middle, turn = None, None, 0
    f.max_queue = 2
    while queues[0] and queues[1]:
        tops = [depth[k][queues[k][0]] for k in (0, 1)]
        if best is not None and sum(tops) >= best:
            break
        k = turn if tops[0] == tops[1] else int(tops[1] < tops[0])
        turn = 1 - k
        side = BACKWARD if k else 0
        u = queues[k].popleft()
        f.note(SETTLE, u, side)
        for arc, v, _ in tables[k][u]:
            f.note(EXAMINE, arc, side)
            if depth[k][v] < 0:
                depth[k][v], parent[k][v] = depth[k][u] + 1, arc
                f.note(IMPROVE, arc, side)
                queues[k].append(v)
                if depth[1 - k][v] >= 0:
                    total = depth[k][v] + depth[1 - k][v]
                    if f.meeting is None:
                        f.meeting = (v, total)
                    if best is None or total < best:
                        best, middle = total, v
        f.max_queue = max(f.max_queue, len(queues[0]) + len(queues[1]))
    if best is not None:
        f.arcs = _walk(g, parent[0], middle, start) + _onwards(g, parent[1], middle, goal)
        f.cost = int(g.w[f.arcs].sum())
    return f


# ---------------------------------------------------------------- first-found
def proximity(g: Compact, goal: int) -> np.ndarray:
    """Great-circle centimetres to the goal; longitudes wrap."""
    lon, lat = np.radians(g.x / 1e5), np.radians(g.y / 1e5)
    dlon = (lon - lon[goal] + math.pi) % (2 * math.pi) - math.pi
    a = np.sin((lat - lat[goal]) / 2) ** 2 + np.cos(lat) * np.cos(lat[goal]) * np.sin(dlon / 2) ** 2
    return np.floor(2 * EARTH_RADIUS * np.arcsin(np.sqrt(np.minimum(1, a))) * 100 + 0.5).astype(np.int64)


def greedy(g: Compact, start: int, goal: int) -> Found:
    """Nearest to the goal first; a node keeps the arc that discovered it; ends on expanding the goal."""
    f, h = Found(), _longs(proximity(g, goal))
    parent, seen, heap = _filled(g.n), bytearray(g.n), [(h[start], start)]
    seen[start] = 1
    f.max_queue = 1
    while heap:
        _, u = heapq.heappop(heap)
        f.note(SETTLE, u)
        f.focus.append(u)
        if u == goal:
            f.arcs = _walk(g, parent, goal, start)
            f.cost = int(g.w[f.arcs].sum())
            break
        for arc, v, _ in g.out[u]:
            f.note(EXAMINE, arc)
            if not seen[v]:
                seen[v] = 1
                parent[v] = arc
                f.note(IMPROVE, arc)
                heapq.heappush(heap, (h[v], v))
        f.max_queue = max(f.max_queue, len(heap))
    return f


def depth_first(g: Compact, start: int, goal: int) -> Found:
    """Preorder in arc order; going back is a return event of the parent."""
    f, parent, seen, nexts = Found(), _filled(g.n), bytearray(g.n), _longs(g.first)
    stack = array("q", [start])
    seen[start] = 1
    f.note(SETTLE, start)
    f.focus.append(start)
    f.max_queue = 1
    while stack and stack[-1] != goal:
        u = stack[-1]
        while nexts[u] < g.first[u + 1]:
            arc = nexts[u]
            nexts[u] += 1
            v = int(g.dst[arc])
            f.note(EXAMINE, arc)
            if not seen[v]:
                seen[v] = 1
                parent[v] = arc
                f.note(IMPROVE, arc)
                f.note(SETTLE, v)
                f.focus.append(v)
                stack.append(v)
                f.max_queue = max(f.max_queue, len(stack))
                break
        else:
            stack.pop()
            if stack:
                f.note(RETURN, stack[-1])
                f.focus.append(stack[-1])
    if stack:
        f.arcs = _walk(g, parent, goal, start)
        f.cost = int(g.w[f.arcs].sum())
    return f


def breadth_first(g: Compact, start: int, goal: int | None) -> Found:
    """FIFO; ends when the goal is taken from the queue."""
    f, parent, depth, seen, queue = Found(), _filled(g.n), _filled(g.n), bytearray(g.n), deque([start])
    f.reached, f.max_queue = (seen, depth, None), 1
    depth[start], seen[start] = 0, 1
    while queue:
        u = queue.popleft()
        f.note(SETTLE, u)
        if u == goal:
            f.arcs = _walk(g, parent, goal, start)
            f.cost = int(g.w[f.arcs].sum())
            break
        for arc, v, _ in g.out[u]:
            f.note(EXAMINE, arc)
            if not seen[v]:
                depth[v], parent[v], seen[v] = depth[u] + 1, arc, 1
                f.note(IMPROVE, arc)
                queue.append(v)
        f.max_queue = max(f.max_queue, len(queue))
    return f


# ---------------------------------------------------------------- trees and territories
def spanning_tree(g: Compact, start: int, goal: int | None = None) -> Found:
    """Prim over the undirected multigraph, ties by (length, node, edge); an improve event is an accepted edge."""
    f, inside, via, came, heap = Found(), bytearray(g.n), _filled(g.n), _filled(g.n), [(0, start, -1, start)]
    f.reached = inside, None, None
    total = 0
    while heap:
        w, u, e, back = heapq.heappop(heap)
        if inside[u]:
            continue
        if e >= 0:
            f.note(IMPROVE, e)
            f.tree.append(e)
            total += w
            via[u], came[u] = e, back
        inside[u] = 1
        f.note(SETTLE, u)
        if u == goal:
            break
        for e, v, w in g.around[u]:
            f.note(EXAMINE, e)
            if not inside[v]:
                heapq.heappush(heap, (w, v, e, u))
        f.max_queue = max(f.max_queue, len(heap))
    if goal is None:
        f.cost = total
    elif inside[goal]:
        nodes, edges, flags, lengths = [goal], [], [], []
        while nodes[-1] != start:
            e, back = via[nodes[-1]], came[nodes[-1]]
            edges.append(e)
            flags.append(bool(int(g.sides[0][e]) != back))
            lengths.append(int(g.sides[2][e]))
            nodes.append(back)
        f.route = (nodes[::-1], edges[::-1], flags[::-1], lengths[::-1])
        f.cost = sum(lengths)
    return f


def multisource(g: Compact, sources: list[int]) -> Found:
    """Nearest source of every node; the first of equal costs stays. Words carry the source."""
    if len(set(sources)) != len(sources):
        raise ValueError("sources must be distinct nodes")
    f, closed, dist, owner = Found(), bytearray(g.n), _filled(g.n), _filled(g.n)
    f.reached = closed, dist, owner
    for k, s in enumerate(sources):
        dist[s], owner[s] = 0, k
    heap = [(0, s) for s in sources]
    heapq.heapify(heap)
    f.max_queue = len(heap)
    while heap:
        d, u = heapq.heappop(heap)
        if closed[u]:
            continue
        closed[u] = 1
        side = owner[u] << SOURCE_SHIFT
        f.note(SETTLE, u, side)
        for arc, v, w in g.out[u]:
            f.note(EXAMINE, arc, side)
            if not closed[v] and (dist[v] < 0 or d + w < dist[v]):
                dist[v], owner[v] = d + w, owner[u]
                f.note(IMPROVE, arc, side)
                heapq.heappush(heap, (d + w, v))
        f.max_queue = max(f.max_queue, len(heap))
    return f


SEARCHES = {
    "dijkstra": dijkstra,
    "time-dijkstra": dijkstra,
    "bidirectional": bidirectional,
    "astar": astar,
    "bidirectional-astar": lambda g, s, t: bidirectional(g, s, t, True),
    "weighted-astar": weighted_astar,
    "alt": alt,
    "greedy": greedy,
    "depth-first": depth_first,
    "breadth-first": breadth_first,
    "bidirectional-breadth-first": bidirectional_breadth_first,
    "spanning-tree": spanning_tree,
}
