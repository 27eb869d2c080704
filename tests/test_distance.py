"""Distances against all pairs, and iso-lines as rings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from isohypse.operators import chains, distance


def test_envelope_is_the_least_of_all():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(1, 30))
        y = np.sort(rng.choice(90, n, replace=False))
        f = np.where(rng.random(n) < 0.5, -1, rng.integers(0, 900, n))
        got = distance._envelope(f, y)
        own = np.flatnonzero(f >= 0)
        assert (got == [min((int(y[i] - y[j]) ** 2 + int(f[j]) for j in own), default=-1) for i in range(n)]).all()


def test_distances_equal_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [(g, y, x, bool(rng.random() < 0.06)) for g in range(2) for y in range(-3, 22) for x in range(31) if rng.random() < 0.9] + [(2, 0, 0, False)]
    cells = spark.createDataFrame(rows, "g int, y int, x int, land boolean")
    got = {(r["g"], r["y"], r["x"]): r["d2"] for r in distance.squared_distance(cells, F.col("land"), ("g",)).collect()}
    assert len(got) == len(rows)
    for g, y, x, _ in rows:
        assert got[g, y, x] == min(((y - b) ** 2 + (x - c) ** 2 for a, b, c, land in rows if land and a == g), default=None)


def test_zones_go_in_front(spark):
    cells = spark.createDataFrame([(0, x, x == 4) for x in range(9)], "y int, x int, new boolean")
    old = spark.createDataFrame([(0, 0, 1), (1, 0, 2)], "zone_rank int, y int, x int")
    got = {(r["zone_rank"], r["x"]) for r in distance.prepend_zones(old, cells, F.col("new"), 1.5).collect()}
    assert got == {(1, 1), (2, 2), (0, 3), (0, 4), (0, 5)}


@pytest.mark.parametrize("size", [3, 1000])
def test_chains_over_blocks(spark, size):
    rng = np.random.default_rng(7)
    links, want = [], {}
    at = 0
    for n, ring in ((40, True), (1, True), (2, True), (25, False), (1, False), (60, True)):
        nodes = list(range(at, at + n + (not ring)))
        at += len(nodes)
        rng.shuffle(nodes)
        nodes = [int(v) for v in nodes]
        pairs = list(zip(nodes, [*nodes[1:], nodes[0]] if ring else nodes[1:]))
        k = min(range(len(pairs)), key=lambda i: pairs[i][0]) if ring else 0
        pairs = pairs[k:] + pairs[:k]
        for seq, (a, b) in enumerate(pairs):
            want[a] = (b, pairs[0][0] if ring else pairs[-1][1], seq, ring)
            links.append((a, b, (a * 7919 % 1009) // size, float(a)))
    got = chains.chains(spark.createDataFrame(links, "a long, b long, block long, x double")).collect()
    assert {r["a"]: (r["b"], r["chain"], r["seq"], r["closed"]) for r in got} == want and all(r["x"] == r["a"] for r in got)


def test_isolines_are_rings_about_what_they_enclose(spark):
    cone = [(y, x, float(np.hypot(y - 80, x - 70))) for y in range(160) for x in range(150)]
    saddle = [(y + 500, x, float((y - 5) * (x - 5))) for y in range(11) for x in range(11)]
    levels = spark.createDataFrame([(0, 9.7), (1, 33.3), (2, 1e9)], "level int, at double")
    got = distance.traced(spark.createDataFrame(cone + saddle, "y int, x int, v double"), levels).collect()
    rings = {}
    for r in got:
        rings.setdefault((r["level"], r["chain"], r["closed"]), []).append(r)
    closed = {k: sorted(v, key=lambda r: r["seq"]) for k, v in rings.items() if k[2] and v[0]["y1"] < 400}
    assert sorted(k[0] for k in closed) == [0, 1] and not any(k[0] == 2 for k in rings)
    for (level, *_), ring in closed.items():
        assert [r["seq"] for r in ring] == list(range(len(ring)))
        assert all((a["x2"], a["y2"]) == (b["x1"], b["y1"]) for a, b in zip(ring, [*ring[1:], ring[0]]))
        area = abs(sum(r["x1"] * r["y2"] - r["x2"] * r["y1"] for r in ring)) / 2
        radius = (9.7, 33.3)[level]
        assert abs(area - np.pi * radius**2) < 0.02 * np.pi * radius**2
    assert sum(1 for k, v in rings.items() if not k[2] and v[0]["y1"] > 400) == 2  # a hyperbola's branches; the other level is nowhere reached
