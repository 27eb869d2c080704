"""Meshes by all triangles, tiles, padding, and small files."""

import types

import numpy as np

from isohypse.operators import lines, mesh, raster
from isohypse.sources import files


def test_heights_are_the_highest_of_all_triangles(spark):
    rng = np.random.default_rng(11)
    rows = [tuple(map(float, rng.uniform(-6, 9, 9))) for _ in range(40)] + [(0.0, 0.0, 1.0, 4.0, 0.0, 1.0, 8.0, 0.0, 5.0)]
    got = {(r["y"], r["x"]): r["z"] for r in mesh.heights(spark.createDataFrame(rows, ", ".join(f"{c} double" for c in mesh.CORNERS))).collect()}
    want = {}
    for x1, y1, z1, x2, y2, z2, x3, y3, z3 in rows:
        d = (y2 - y3) * (x1 - x3) + (x3 - x2) * (y1 - y3)
        for y in range(-8, 11):
            for x in range(-8, 11):
                if d:
                    a = ((y2 - y3) * (x + 0.5 - x3) + (x3 - x2) * (y + 0.5 - y3)) / d
                    b = ((y3 - y1) * (x + 0.5 - x3) + (x1 - x3) * (y + 0.5 - y3)) / d
                    if a >= 0 and b >= 0 and a + b <= 1:
                        want[y, x] = max(want.get((y, x), -np.inf), a * z1 + b * z2 + (1 - a - b) * z3)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_a_raster_comes_back_from_its_mesh(spark):
    cells = spark.createDataFrame([(y, x, 3.0 * y - x) for y in range(5) for x in range(6) if (y, x) != (4, 5)], "y int, x int, z double")
    faces = mesh.triangles(cells)
    assert faces.count() == 2 * (4 * 5 - 1)
    assert all(abs(r["z"] - (3 * (r["y"] + 0.5) - r["x"] - 0.5)) < 1e-9 for r in mesh.heights(faces).collect())
    flat = mesh.stl_facets(mesh.triangles(cells.selectExpr("y", "x", "0D as z"))).first()["facet"]
    assert flat.startswith("facet normal 0.0000 0.0000 -1.0000\nouter loop\nvertex 0.000 0.000 0.000") and flat.endswith("endloop\nendfacet")


def test_facets_print_ties_as_sql_does(spark):
    z = [0.0625, 12.6785, 1.0005, -17.3125]  # Java prints 0.063, 12.679, 1.001, -17.313
    cells = spark.createDataFrame([(i // 2, i % 2, v) for i, v in enumerate(z)], "y int, x int, z double")
    facet = mesh.stl_facets(mesh.triangles(cells)).where("half = 0").first()["facet"]
    assert [x.split()[-1] for x in facet.split("\n") if x.startswith("vertex")] == ["0.062", "1.000", "12.678"]
    # a normal's x of 0.70715, for which SQL's round gives 0.7071
    d = (1 / 0.70715**2 - 1) ** 0.5
    tilted = next(h for h in (d + k * 2**-53 for k in range(-400, 400)) if 1 / (1 + h * h) ** 0.5 == 0.70715)
    tri = spark.createDataFrame([(0, 0, 0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, tilted, 0.0, -1.0)], "y int, x int, half int, " + ", ".join(f"{c} double" for c in mesh.CORNERS))
    assert mesh.stl_facets(tri).first()["facet"].startswith("facet normal -0.7071 ")


def test_padding_holds_the_edge(spark):
    z = np.arange(6.0).reshape(2, 3)
    got = raster.pad_edge(spark.createDataFrame([(y, x, float(z[y, x])) for y in range(2) for x in range(3)], "y int, x int, z double"), 2)
    want = np.pad(z, 2, mode="edge")
    assert {(r["y"], r["x"]): r["z"] for r in got.collect()} == {(y - 2, x - 2): want[y, x] for y in range(6) for x in range(7)}
    one = raster.pad_edge(spark.createDataFrame([(7, 7, 1.0)], "y int, x int, z double"), 1)
    assert sorted((r["y"], r["x"]) for r in one.collect()) == [(y, x) for y in (6, 7, 8) for x in (6, 7, 8)]


def test_gazetteer_and_override(spark, tmp_path):
    row = lambda i, name, n: "\t".join([str(i), name, "", "", "1.5", "-2.5", *[""] * 8, str(n), *[""] * 4])
    (tmp_path / "g.txt").write_text("\n".join([row(1, 'A "quoted', 100_000), row(2, "B", 99_999)]))
    assert [tuple(r) for r in files.gazetteer(spark, str(tmp_path)).collect()] == [(1, 'A "quoted', 1.5, -2.5, 100_000)]
    target = types.SimpleNamespace(WIDTH=1, height=2)
    files.override(target, {"width": 5, "height": 6, "unknown": 7})
    assert vars(target) == {"WIDTH": 5, "height": 2}


def test_grid_positions_come_once(spark):
    got = lines.grid_positions(spark.createDataFrame([(1, 45.0), (2, 40.0), (3, 0.0)], "id long, limit double"), 20).collect()
    assert sorted((r["id"], r["position"]) for r in got) == [(1, v) for v in (-45, -40, -20, 0, 20, 40, 45)] + [(2, v) for v in (-40, -20, 0, 20, 40)] + [(3, 0)]
