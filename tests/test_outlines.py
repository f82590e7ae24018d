"""Unions of outlines against inclusion and exclusion in exact fractions, and against cells."""

import random
from collections import defaultdict
from fractions import Fraction
from itertools import combinations

import pytest

from trailmesh.operators import outlines

SHAPES = "k string, polygons array<array<array<struct<x:double,y:double>>>>"


def ring(points):
    return [(float(x), float(y)) for x, y in [*points, points[0]]]


def square(x, y, w):
    return ring([(x, y), (x + w, y), (x + w, y + w), (x, y + w)])


def cross(a, b, p):
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def area(points):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, [*points[1:], *points[:1]], strict=True)) / 2 if points else 0


def clipped(p, q):
    """The part of a convex polygon in another one, both against the clock."""
    for a, b in zip(q, [*q[1:], q[0]], strict=True):
        out = []
        for c, d in zip(p, [*p[1:], *p[:1]], strict=True):
            s, t = cross(a, b, c), cross(a, b, d)
            if s >= 0:
                out.append(c)
            if s * t < 0:
                r = s / (s - t)
                out.append((c[0] + (d[0] - c[0]) * r, c[1] + (d[1] - c[1]) * r))
        p = out
    return p


def united_area(convex):
    total = Fraction(0)
    for n in range(1, len(convex) + 1):
        for chosen in combinations(convex, n):
            part = chosen[0]
            for other in chosen[1:]:
                part = clipped(part, other)
            total += (-1) ** (n + 1) * area(part)
    return total


def test_union_of_triangles(spark):
    draw, rows, want = random.Random(3), [], {}
    for k in range(40):
        shapes = []
        span = draw.choice([6, 12, 1000])  # ends, sides and crossings that agree in the small ones
        while len(shapes) < 5:
            p = [(Fraction(draw.randint(-span, span)), Fraction(draw.randint(-span, span))) for _ in range(3)]
            if area(p):
                shapes.append(p if area(p) > 0 else p[::-1])
        want[str(k)] = united_area(shapes)
        rows.append((str(k), [[ring(p if draw.random() < 0.5 else p[::-1])] for p in shapes]))
    sides = outlines.union_outlines(spark.createDataFrame(rows, SHAPES), ["k"], 1.0, crowd=4).cache()
    got = defaultdict(float)
    for r in outlines.ring_sums(sides, ["k"]).collect():
        got[r["k"]] += r["area"]
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(float(want[k]), rel=1e-5), k
    walks = defaultdict(list)
    for r in sides.collect():
        walks[r["k"], r["ring"]].append((r["n"], (r["x1"], r["y1"]), (r["x2"], r["y2"])))
    for walk in walks.values():
        walk.sort()
        assert [n for n, _, _ in walk] == list(range(len(walk))) and all(a[2] == b[1] for a, b in zip(walk, [*walk[1:], walk[0]], strict=True))


def test_rings_holes_and_odd_input(spark):
    rows = [
        ("hole", [[square(0, 0, 10), square(2, 2, 4)[::-1]], [square(3, 3, 1)]]),
        ("filled", [[square(0, 0, 10), square(2, 2, 4)]]),
        ("filled", [[square(2, 2, 4)]]),
        ("frame", [[ring([(0, 0), (9, 0), (9, 3), (0, 3)])], [ring([(0, 6), (9, 6), (9, 9), (0, 9)])], [ring([(0, 3), (3, 3), (3, 6), (0, 6)])], [ring([(6, 3), (9, 3), (9, 6), (6, 6)])]]),
        ("corner", [[square(0, 0, 2)], [square(2, 2, 2)]]),
        ("within", [[square(0, 0, 9)], [square(1, 1, 2)], [square(0, 0, 4)]]),
        ("none", None),
        ("short", [[[(0.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]]),
        (None, [[square(-5, -5, 2)]]),
        *[("copies", [[square(100, 100, 7)]])] * 300,
        *[("nested", [[square(-i, -i, 2 * i)]]) for i in range(1, 101)],
    ]
    sides = outlines.union_outlines(spark.createDataFrame(rows, SHAPES).repartition(3), ["k"], 1.0, crowd=8).cache()
    got = defaultdict(list)
    for r in outlines.ring_sums(sides, ["k"]).collect():
        got[r["k"]].append((r["area"], r["perimeter"], r["corners"]))
    assert {k: sorted(v) for k, v in got.items()} == {
        "hole": [(-16.0, 16.0, 4), (1.0, 4.0, 4), (100.0, 40.0, 4)],
        "filled": [(100.0, 40.0, 4)],
        "frame": [(-9.0, 12.0, 4), (81.0, 36.0, 4)],
        "corner": [(4.0, 8.0, 4), (4.0, 8.0, 4)],
        "within": [(81.0, 36.0, 4)],
        None: [(4.0, 8.0, 4)],
        "copies": [(49.0, 28.0, 4)],
        "nested": [(40000.0, 800.0, 4)],
    }
    frame = sorted(len(r["points"]) for r in outlines.ring_points(sides.where("k = 'frame'"), ["k"]).collect())
    assert frame == [5, 5]


def test_empty_and_too_wide(spark):
    none = outlines.union_outlines(spark.createDataFrame([], SHAPES), ["k"])
    assert none.count() == 0 and none.columns == ["k", "ring", "n", "x1", "y1", "x2", "y2", "corner"]
    with pytest.raises(ValueError, match="extend"):
        outlines.union_outlines(spark.createDataFrame([("a", [[square(0, 0, 1 << 26)]])], SHAPES), ["k"], 1.0)
