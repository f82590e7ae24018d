"""Ordered searches: golden micro-graphs and seeded graphs against independent oracles."""

import heapq
import math
from itertools import combinations

import numpy as np
import pytest

from trailmesh.operators import kernels as k
from trailmesh.operators.kernels import Compact


def build(edges, xy=None, n=None):
    """edges: (from, to, cm, direction)."""
    n = n or 1 + max([max(e[:2]) for e in edges], default=0)
    xy = xy or [(i, i) for i in range(n)]
    half = [(u, v, e, False, w) for e, (u, v, w, d) in enumerate(edges) if d != 2] + [(v, u, e, True, w) for e, (u, v, w, d) in enumerate(edges) if d != 1]
    half.sort(key=lambda h: (h[0], h[2], h[3]))
    col = lambda i, t=np.int64: np.array([h[i] for h in half], t)
    e = tuple(np.array([x[i] for x in edges], np.int64) for i in range(3))
    return Compact(np.array([p[0] for p in xy], np.int64), np.array([p[1] for p in xy], np.int64), col(0), col(1), col(2), col(3, bool), col(4), e)


def lcg(seed):
    def step():
        nonlocal seed
        seed = (seed * 1664525 + 1013904223) % 2**32
        return seed

    return step


def nodes_of(g, f, start):
    return [start, *(int(g.dst[a]) for a in f.arcs)] if f.cost is not None else None


def relax(g, s):
    dist = {s: 0}
    for _ in range(g.n):
        for a in range(len(g.src)):
            u, v, w = int(g.src[a]), int(g.dst[a]), int(g.w[a])
            if u in dist and dist[u] + w < dist.get(v, math.inf):
                dist[v] = dist[u] + w
    return dist


def random_graph(r, n, m, most, span=None):
    edges = [(r() % n, r() % n, r() % most, r() % 3) for _ in range(m)]
    xy = [(r() % span, r() % span) for _ in range(n)] if span else None
    return build(edges, xy, n)


def test_ties_keep_the_first_predecessor():
    g = build([(0, 2, 100, 1), (0, 1, 100, 1), (2, 3, 100, 1), (1, 3, 100, 1)])
    assert nodes_of(g, k.dijkstra(g, 0, 3), 0) == [0, 1, 3]
    assert k.dijkstra(g, 3, 0).cost is None and k.dijkstra(g, 2, 2).cost == 0


def test_reverse_edges():
    assert k.dijkstra(build([(0, 1, 100, 2)]), 1, 0).cost == 100
    assert k.dijkstra(build([(0, 1, 100, 2)]), 0, 1).cost is None


def check_trace(g, f):
    settled, now, last = set(), {}, {}
    for word in f.words:
        kind, id, side = word & 3, (word & 0x7FFFFFFF) >> 2, word >> 31
        if kind == 0:
            assert (side, id) not in settled
            settled.add((side, id))
            now[side] = id
        elif kind == 1:
            assert (g.dst if side else g.src)[id] == now[side]
            last[side] = id
        elif kind == 2:
            assert last[side] == id


def test_event_order():
    g = build([(0, 1, 900, 0), (0, 2, 100, 0), (2, 1, 100, 0), (1, 3, 100, 0)])
    f = k.dijkstra(g, 0, 3)
    assert f.cost == 300
    check_trace(g, f)


@pytest.mark.parametrize("seed", range(8))
def test_costs_against_relaxation(seed):
    r = lcg(7 + seed)
    for n, m, most, span in ((12, 22, 500, 500), (9, 19, 8, 100), (9, 19, 1000, 500)):
        g = random_graph(r, n, m, most, span)
        want = {s: relax(g, s) for s in range(n)}
        marks = k.landmarks(g)
        for s in range(n):
            hops = relax(Compact(g.x, g.y, g.src, g.dst, g.edge, g.back, np.ones_like(g.w), g.edges), s)
            for t in range(n):
                cost = want[s].get(t)
                for f in (k.dijkstra(g, s, t), k.astar(g, s, t), k.bidirectional(g, s, t), k.bidirectional(g, s, t, True), k.alt(g, s, t, marks)):
                    assert f.cost == cost
                    check_trace(g, f)
                    if cost is not None:
                        assert sum(int(g.w[a]) for a in f.arcs) == cost
                        at = s
                        for a in f.arcs:
                            assert g.src[a] == at
                            at = int(g.dst[a])
                        assert at == t
                two = k.bidirectional_breadth_first(g, s, t)
                assert (len(two.arcs) if two.cost is not None else None) == hops.get(t)
                one = k.breadth_first(g, s, t)
                assert (len(one.arcs) if one.cost is not None else None) == hops.get(t)
                for f in (k.weighted_astar(g, s, t), k.greedy(g, s, t), k.depth_first(g, s, t)):
                    assert (f.cost is None) == (cost is None) and (cost is None or f.cost >= cost)
                low, _ = k.repair(g, k.landmark_bound(g, marks, t))
                assert all(low[u] <= d[t] for u, d in want.items() if t in d)
                assert all(low[int(a)] <= int(w) + low[int(b)] for a, b, w in zip(g.src, g.dst, g.w, strict=True))


def test_first_contact_is_not_the_optimum():
    g = build([(0, 3, 1000, 1), (0, 1, 100, 1), (1, 2, 100, 1), (2, 3, 100, 1)])
    f = k.bidirectional(g, 0, 3)
    assert nodes_of(g, f, 0) == [0, 1, 2, 3] and f.cost == 300 and f.meeting[1] == 1000
    assert k.bidirectional(g, 3, 0).cost is None and k.bidirectional(g, 2, 2).meeting is None


def test_bounds_are_repaired():
    g = build([(0, 2, 100, 1), (0, 1, 1, 1), (1, 2, 1, 1)], [(0, 0), (1000, 0), (0, 1)])
    f = k.astar(g, 0, 2)
    assert f.cost == 2 and nodes_of(g, f, 0) == [0, 1, 2] and f.corrected > 0
    zero = build([(0, 1, 0, 1), (1, 2, 0, 1)], [(0, 0), (1, 0), (2, 0)])
    assert k.astar(zero, 0, 2).cost == 0


def test_weighted_bound():
    g = build([(0, 1, 10, 1), (1, 2, 10, 1), (0, 2, 25, 1)], [(0, 0), (100, 0), (200, 0)])
    a, w = k.astar(g, 0, 2), k.weighted_astar(g, 0, 2)
    assert a.cost == 20 and w.cost == 25 and w.counts()[0] < a.counts()[0]
    assert k.weighted_astar(g, 2, 0).cost is None and k.weighted_astar(g, 1, 1).cost == 0


def test_greedy_takes_the_near_detour():
    g = build([(0, 1, 10000, 1), (1, 3, 10000, 1), (0, 2, 1, 1), (2, 3, 1, 1)], [(0, 0), (900, 0), (0, 1000), (1000, 0)])
    f = k.greedy(g, 0, 3)
    assert nodes_of(g, f, 0) == [0, 1, 3] and f.cost == 20000 and k.dijkstra(g, 0, 3).cost == 2


def test_proximity_wraps():
    h = k.proximity(build([], [(17990000, 0), (-17990000, 0), (0, 0)], 3), 1)
    assert 22000 < h[0] / 100 < 23000 and h[1] == 0 and h[0] < h[2]


def test_greedy_order():
    r = lcg(1759)
    for _ in range(20):
        g = random_graph(r, 10, 21, 100, 100)
        h = k.proximity(g, 9)
        want, front, seen = [], [0], {0}
        while front:
            front.sort(key=lambda u: (h[u], u))
            u = front.pop(0)
            want.append(u)
            if u == 9:
                break
            for _, v, _ in g.out[u]:
                if v not in seen:
                    seen.add(v)
                    front.append(v)
        assert k.greedy(g, 0, 9).focus == want


def test_depth_first_returns():
    g = build([(0, 1, 100, 1), (1, 2, 200, 0), (0, 3, 50, 1)])
    f = k.depth_first(g, 0, 3)
    kinds = [(w & 3, w >> 2) for w in f.words]
    assert [i for t, i in kinds if t == 0] == [0, 1, 2, 3] and [i for t, i in kinds if t == 3] == [1, 0]
    assert f.counts() == (4, 4, 3) and f.cost == 50 and f.focus == [0, 1, 2, 1, 0, 3]


def test_breadth_first_golden():
    g = build([(0, 3, 10000, 1), (0, 1, 100, 1), (1, 2, 100, 1), (2, 3, 100, 1)])
    f = k.breadth_first(g, 0, 3)
    assert f.cost == 10000 and f.counts() == (2, 2, 2) and k.dijkstra(g, 0, 3).cost == 300


def test_bidirectional_breadth_first_golden():
    g = build([(0, 1, 1000, 1), (1, 4, 1000, 1), (0, 2, 1, 1), (2, 3, 1, 1), (3, 4, 1, 1)])
    f = k.bidirectional_breadth_first(g, 0, 4)
    assert len(f.arcs) == 2 and f.cost == 2000


PRIM = [(0, 1, 10, 2), (1, 2, 20, 1), (0, 2, 100, 1), (2, 2, 0, 0), (0, 1, 10, 1), (3, 4, 7, 1)]


def test_spanning_tree_golden():
    f = k.spanning_tree(build(PRIM), 0)
    assert f.cost == 30 and len(f.dist) == 3 and f.tree == [0, 1] and f.counts() == (3, 10, 2)
    assert k.spanning_tree(build(PRIM), 4).cost == 7
    g = build([(0, 1, 10, 2), (1, 2, 10, 2), (0, 2, 15, 2), (2, 3, 100, 2)])
    f = k.spanning_tree(g, 0, 2)
    assert f.route == ([0, 1, 2], [0, 1], [False, False], [10, 10]) and f.cost == 20
    assert k.spanning_tree(g, 2, 0).route[2] == [True, True]


@pytest.mark.parametrize("seed", range(15))
def test_spanning_tree_against_kruskal(seed):
    r = lcg(seed)
    edges = [(u, v, r() % 20, 0) for u, v in combinations(range(7), 2) if r() % 3]
    if not edges:
        return
    g = build(edges, n=7)
    parent = list(range(7))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    total = 0
    for w, u, v in sorted((w, u, v) for u, v, w, _ in edges):
        if find(u) != find(v):
            parent[find(u)] = find(v)
            total += w
    roots = {find(i) for i in range(7)}
    assert sum(k.spanning_tree(g, x).cost for x in roots) == total


@pytest.mark.parametrize("seed", range(10))
def test_multisource_against_single_runs(seed):
    r = lcg(1741 + seed)
    g = random_graph(r, 9, 18, 15)
    f = k.multisource(g, [0, 3, 6])
    single = [relax(g, s) for s in (0, 3, 6)]
    for v in range(9):
        best = min((d[v] for d in single if v in d), default=None)
        assert f.dist.get(v) == best
        if best is not None:
            assert single[f.owner[v]].get(v) == best
    with pytest.raises(ValueError):
        k.multisource(g, [0, 0, 1])


def test_landmarks_spread():
    g = build([(i, i + 1, 10, 0) for i in range(9)], [(i * 100, 0) for i in range(10)])
    marks = k.landmarks(g)
    assert marks.nodes[0] == 1 and marks.nodes[1] == 9 and len(marks.nodes) == 4


def test_long_line():
    g = build([(i, i + 1, 10, 0) for i in range(3999)])
    f = k.dijkstra(g, 0, 3999)
    assert f.cost == 39990 and f.counts()[0] == 4000
    assert heapq.heappop([1]) == 1
