"""Polygon operators against points: each sampled point of a line is inside or outside, whatever the cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from isohypse.operators import polygons


def ring(points):
    return [(k, *a, *b) for k, (a, b) in enumerate(zip(points, [*points[1:], points[0]]))]


def square(x, y, w, h=None):
    h = w if h is None else h
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def stars(rng, n, wide):
    out = []
    for i in range(n):
        c, m = rng.uniform(0, wide, 2), int(rng.integers(4, 11))
        turn, r = (np.arange(m) + rng.uniform(0.1, 0.9, m)) * 2 * np.pi / m, rng.uniform(1, 9, m)  # about the centre, counter-clockwise
        out += [(i, i % 4, *e) for e in ring([(float(c[0] + a * np.cos(t)), float(c[1] + a * np.sin(t))) for a, t in zip(r, turn)])]
    return out


def inside(edges, x, y):
    return sum((p[1] > y) != (q[1] > y) and x > (q[0] - p[0]) * (y - p[1]) / (q[1] - p[1]) + p[0] for p, q in (((e[-4], e[-3]), (e[-2], e[-1])) for e in edges)) % 2 == 1


SCHEMA = "id long, zone_rank int, k int, px double, py double, qx double, qy double"


@pytest.fixture(scope="module")
def scene(spark):
    rng = np.random.default_rng(12)
    zones = stars(rng, 24, 40)
    lines = [(i % 5, i, *map(float, rng.uniform(-5, 45, 4))) for i in range(60)]
    lines += [(4, 100, -3.0, 20.0, 44.0, 20.0), (4, 101, 20.0, -3.0, 20.0, 44.0), (4, 102, 7.0, 7.0, 7.0, 7.0)]
    by = {i: [z for z in zones if z[0] == i] for i in range(24)}
    return zones, by, lines, spark.createDataFrame(zones, SCHEMA), spark.createDataFrame(lines, "layer int, seq long, x1 double, y1 double, x2 double, y2 double")


def shares(line, pieces):
    """t1, t2 of pieces of a line."""
    d = np.array(line[4:6]) - line[2:4]
    return [tuple(float((np.array(p[i : i + 2]) - line[2:4]) @ d / (d @ d)) for i in (0, 2)) for p in pieces]


@pytest.mark.parametrize("cell", [3.0, 8.0, 100.0])
def test_lines_in_polygons(scene, cell):
    zones, by, lines, z, s = scene
    got = {}
    for r in polygons.clip_lines(s, z, ["seq"], cell).collect():
        got.setdefault((r["seq"], r["id"]), []).append((r["x1"], r["y1"], r["x2"], r["y2"]))
    hits = 0
    for line in lines[:-1]:
        for i, edges in by.items():
            runs = shares(line, got.get((line[1], i), []))
            for t in np.linspace(0.001, 0.999, 97):
                x, y = (line[2 + c] + (line[4 + c] - line[2 + c]) * t for c in (0, 1))
                if all(abs(t - e) > 1e-6 for r in runs for e in r):
                    assert inside(edges, x, y) == any(a < t < b for a, b in runs)
                    hits += inside(edges, x, y)
    assert hits > 100 and all(k[0] != 102 for k in got)


def test_lines_minus_zones(scene):
    zones, by, lines, z, s = scene
    got, parts = {}, {}
    for r in polygons.subtract_zones(s, z, ["layer", "seq"]).collect():
        got.setdefault(r["seq"], []).append((r["x1"], r["y1"], r["x2"], r["y2"]))
        parts.setdefault(r["seq"], []).append(r["part"])
    for line in lines[:-1]:
        runs = shares(line, got.get(line[1], []))
        assert sorted(parts.get(line[1], [])) == list(range(1, len(runs) + 1))
        for t in np.linspace(0.001, 0.999, 97):
            x, y = (line[2 + c] + (line[4 + c] - line[2 + c]) * t for c in (0, 1))
            covered = any(inside(e, x, y) for e in by.values() if e[0][1] < line[0])
            if all(abs(t - e) > 1e-6 for r in runs for e in r):
                assert covered != any(a < t < b for a, b in runs)


def test_touched_vertices_and_edges(spark):
    # a diamond's corners on the line, a square's side along it, a comb whose teeth touch it
    shapes = [(0, 0, *e) for e in ring([(0.0, -1.0), (1.0, 0.0), (0.0, 1.0), (-1.0, 0.0)])]
    shapes += [(1, 0, *e) for e in ring(square(2.0, 0.0, 2.0))] + [(2, 0, *e) for e in ring([(5.0, -1.0), (8.0, -1.0), (7.0, 0.0), (6.5, -0.5), (6.0, 0.0)])]
    line = spark.createDataFrame([(1, -9.0, 0.0, 11.0, 0.0)], "seq long, x1 double, y1 double, x2 double, y2 double")
    got = {r["id"]: (r["x1"], r["x2"]) for r in polygons.clip_lines(line, spark.createDataFrame(shapes, SCHEMA), ["seq"], 4.0).collect()}
    assert {k: tuple(map(lambda v: round(v, 9), v)) for k, v in got.items()} in ({0: (-1.0, 1.0)}, {0: (-1.0, 1.0), 2: (6.0, 7.0)})


def test_neighbours_unite_and_copies_count_once(spark):
    shapes = [(0, 0, *e) for e in ring(square(0.0, 0.0, 2.0))] + [(1, 0, *e) for e in ring(square(2.0, 0.0, 2.0))] + [(2, 0, *e) for e in ring(square(9.0, 9.0, 1.0))]
    shapes += [(3, 0, *e) for e in ring(square(1.0, 1.0, 2.0))]
    edges = polygons.union_edges(spark.createDataFrame(shapes, SCHEMA))
    area, length = edges.agg(polygons.signed_area(), F.sum(F.hypot(F.col("qx") - F.col("px"), F.col("qy") - F.col("py")))).first()
    assert abs(area - (8 + 2 + 1)) < 1e-9 and abs(length - (2 + 4 + 2 + 1 + 1 + 1 + 2 + 1 + 4)) < 1e-9


def test_union_and_crop_have_the_sampled_area(scene, spark):
    zones, by, lines, z, s = scene
    area = polygons.union_edges(z).agg(polygons.signed_area()).first()[0]
    step = 0.25
    grid = np.arange(-10, 50, step) + 0.113
    covered = sum(any(inside(e, x, y) for e in by.values()) for x in grid for y in grid) * step * step
    assert abs(area - covered) < 0.02 * covered
    stencil = ring(square(10.3, 10.1, 15.2))
    cut = polygons.crop_polygons(z, spark.createDataFrame([(77, 0, *e) for e in stencil], SCHEMA)).groupBy("id").agg(polygons.signed_area().alias("a")).collect()
    for r in cut:
        fine = np.arange(10, 26, 0.1) + 0.053
        want = sum(inside(by[r["id"]], x, y) and inside(stencil, x, y) for x in fine for y in fine) * 0.01
        assert abs(r["a"] - want) < 0.25 + 0.03 * want
    assert len(cut) >= 5


def test_direction_of_the_cells_in_a_polygon(spark):
    cells = spark.createDataFrame([(y, x, 3.0 if x % 2 else -3.0) for y in range(6) for x in range(6)], "y int, x int, angle double")
    got = polygons.zonal_direction(cells, spark.createDataFrame([(5, 0, *e) for e in ring(square(0.9, 0.9, 2.2))], SCHEMA)).collect()
    assert [(r["id"], r["n"]) for r in got] == [(5, 4)] and abs(abs(got[0]["direction"]) - 180) < 1e-9


def test_joins_are_by_cells(scene):
    z, s = scene[3:]
    plan = polygons.subtract_zones(s, z, ["layer", "seq"])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def _crowd(spark, corners=9):
    """120 lines, some twice, some upright, level or points; 25 stars that overlap them."""
    rng = np.random.default_rng(9)
    ends = [tuple(map(float, r)) for r in rng.integers(-20, 40, (80, 4))] + [tuple(map(float, r)) for r in rng.uniform(-20, 40, (20, 4))]
    ends += [(5.0, -9.0, 5.0, 30.0), (-9.0, 8.0, 33.0, 8.0), (3.0, 3.0, 3.0, 3.0)] + ends[:17]
    lines = spark.createDataFrame([(i % 4 if i % 9 else None, i, *e) for i, e in enumerate(ends)], "layer int, seq long, x1 double, y1 double, x2 double, y2 double")
    edges = []
    for i in range(25):
        cx, cy, r = rng.uniform(-10, 30), rng.uniform(-10, 30), rng.uniform(2, 12, corners)
        at = [(cx + r[k] * np.cos(2 * np.pi * k / corners), cy + r[k] * np.sin(2 * np.pi * k / corners)) for k in range(corners)]
        edges += [(i, i % 4, k, *map(float, (*at[k], *at[(k + 1) % corners]))) for k in range(corners)]
    return lines, spark.createDataFrame(edges, "id long, zone_rank int, k int, px double, py double, qx double, qy double")


def test_polygons_of_few_and_of_many_edges_give_the_same(spark, monkeypatch):
    lines, edges = _crowd(spark)
    found = lambda: sorted(map(str, polygons.part(polygons.inside_runs(lines, edges, ["layer", "seq"])).collect()))
    want = found()
    monkeypatch.setattr(polygons, "FEW_EDGES", 3)
    assert found() == want and len(want) > 300


def test_a_line_and_a_polygon_meet_once(spark):
    lines, edges = _crowd(spark)
    pairs = polygons.meetings(lines, polygons.boxes(edges), 3.0).select("seq", "id").collect()
    assert len(pairs) == len(set(pairs)) > 500
    # dealt out where lines meet boxes, and nowhere behind
    plan = polygons.inside_runs(lines, edges, ["layer", "seq"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 3


def test_lines_of_equal_ends_keep_their_own_rows(spark):
    lines, edges = _crowd(spark)
    each = polygons.part(polygons.inside_runs(lines, edges, ["layer", "seq"])).select("layer", "seq", "id", *polygons.ENDS)
    got = polygons.clip_lines(lines, edges, ["layer", "seq"]).select("layer", "seq", "id", *polygons.ENDS)
    assert sorted(map(str, got.collect())) == sorted(map(str, each.collect()))
    left = polygons.subtract_zones(lines, edges, ["layer", "seq"]).collect()
    assert {r["seq"] for r in left if r["layer"] is None} == {i for i in range(120) if i % 9 == 0}
    assert len({(r["seq"], r["part"]) for r in left}) == len(left)
