"""Fonts, text along paths, frames, cleaning, resampling and whole documents."""

import math

import numpy as np
from pyspark.sql import Observation
from pyspark.sql import functions as F

from isohypse.operators import cleaning, raster, text
from isohypse.plans import output
from isohypse.sources import files

FONT = """<svg><defs><font id="f" horiz-adv-x="700"><font-face font-family="f" units-per-em="1000" cap-height="600"/>
<missing-glyph horiz-adv-x="9"/><glyph unicode=" " horiz-adv-x="350"/><glyph unicode="&lt;" horiz-adv-x="400" d="M 0 0 L 100 200 M 5 5 L 6 6 L 7 -7"/><glyph unicode="&#xe9;" d="M 10 20"/><glyph glyph-name="none"/></font></defs></svg>"""


def test_font_file(spark, tmp_path):
    (tmp_path / "f.svg").write_text(FONT)
    got = {r["char"]: r for r in text.read_font(spark, str(tmp_path)).collect()}
    assert set(got) == {" ", "<", "é"} and got[" "]["advance"] == 0.35 and got["é"]["advance"] == 0.7 and got["<"]["cap_height"] == 0.6
    assert [[(p["x"], p["y"]) for p in part] for part in got["<"]["parts"]] == [[(0, 0), (0.1, -0.2)], [(0.005, -0.005), (0.006, -0.006), (0.007, 0.007)]]
    assert got[" "]["parts"] == []


def test_glyphs_along_a_path(spark):
    ways = {1: [(i * 0.5, 0.0) for i in range(81)], 2: [(i * 0.5, 3.0) for i in range(81)], 3: [(0.0, i * 0.5) for i in range(81)], 4: [(0.0, 0.0), (1.0, 0.0)], 5: []}
    align = {1: "LEFT", 2: "CENTER", 3: "RIGHT", 4: "LEFT", 5: "LEFT"}
    paths = spark.createDataFrame([(i, k, *p) for i, w in ways.items() for k, p in enumerate(w)], "id long, seq int, x double, y double")
    t = spark.createDataFrame([(i, "abc?", a) for i, a in align.items()], "id long, label string, align string")
    advances = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("c", 3.0)], "char string, advance double")
    layout = text.laid_out(t, advances, 2.0)
    got = {(r["id"], r["char"]): (round(r["x"], 6), round(r["y"], 6), round(r["angle"], 6)) for r in text.along_paths(layout, paths).collect()}
    want, width = {}, {"a": 4.0, "b": 2.0, "c": 6.0}
    for i, w in ways.items():
        arc = np.concatenate(([0], np.cumsum(np.hypot(*np.diff(np.array(w), axis=0).T)))) if w else np.zeros(0)
        at = 0.0
        for c in "cba" if align[i] == "RIGHT" else "abc":
            ends = {"LEFT": (at, at + width[c]), "CENTER": tuple(v + arc[-1] / 2 - 6 for v in (at, at + width[c])) if len(arc) else (), "RIGHT": (arc[-1] - at - width[c], arc[-1] - at) if len(arc) else ()}[align[i]]
            at += width[c]
            if len(arc):
                p, q = (w[int(np.argmin(np.abs(arc - e)))] for e in ends)
                if p != q:
                    want[i, c] = (round(p[0] - (1.2 if align[i] == "LEFT" else 0), 6), p[1], round(math.atan2(q[1] - p[1], q[0] - p[0]), 6))
    assert got == want and len(got) == 10


def test_strokes_are_turned_and_moved(spark):
    glyph = spark.createDataFrame([("a", 1.0, [[(1.0, 0.0), (0.0, 2.0)]])], "char string, advance double, parts array<array<struct<x:double,y:double>>>")
    placed = spark.createDataFrame([(1, 0, "a", 10.0, 20.0, math.pi / 2)], "id long, pos int, char string, x double, y double, angle double")
    got = [(round(r["x"], 6), round(r["y"], 6)) for r in text.strokes(placed, glyph, 3.0).orderBy("i").collect()]
    assert got == [(10, 23), (4, 20)]


def test_frame_sides_end_at_the_first_that_is_missed(spark):
    paths = {1: [(5, -5), (5, 25)], 2: [(5, 5), (5, 25)], 3: [(5, -5), (5, 3), (7, -5), (7, 30)], 4: [(5, 0), (5, 20)], 5: [(50, -5), (50, 30)]}
    t = spark.createDataFrame([(i, k, float(x), float(y)) for i, p in paths.items() for k, (x, y) in enumerate(p)], "id long, seq int, x double, y double")
    got = {(r["id"], r["side"]): (r["x"], r["y"]) for r in text.frame_crossings(t, [(0, "y", 0.0, 0.0, 10.0), (1, "y", 20.0, 0.0, 10.0)]).collect()}
    assert got == {(1, 0): (5, 0), (1, 1): (5, 20), (4, 0): (5, 0)}


def test_cleaning_counts_what_it_takes(spark):
    box = lambda x, w: [(x, 0.0), (x + w, 0.0), (x + w, w), (x, w), (x, 0.0)]
    bow = [(0.0, 0.0), (20.0, 20.0), (20.0, 0.0), (0.0, 20.0), (0.0, 0.0)]
    shapes = [(1, [box(0.0, 9.0), bow]), (2, [box(5.0, 1.0), None, [(0.0, 0.0), (1.0, 1.0)], []]), (3, None), (4, [[(0.0, 0.0), (5.0, 0.0), (9.0, 0.0), (0.0, 0.0)]]), (5, [box(0.0, 30.0)])]
    t = spark.createDataFrame(shapes, "id long, rings array<array<struct<x:double,y:double>>>")
    for cell in (2.0, 50.0):
        seen = Observation("cleaning")
        kept = cleaning.cleaned(t, least_plane=2.0, cell=cell, counters=seen).collect()
        assert sorted((r["id"], r["part"]) for r in kept) == [(1, 0), (5, 0)]
        assert seen.get == {"input": 7, "invalid": 1, "empty": 3, "small": 1, "output": 2}


def test_cleaning_broadcasts_no_rows_of_rings(spark):
    ring = [(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0), (0.0, 0.0)]
    shapes = spark.createDataFrame([(i, [ring]) for i in range(50)], "id long, rings array<array<struct<x:double,y:double>>>")
    found = cleaning.marked(cleaning.unpack(shapes))
    assert {r["fate"] for r in found.collect()} == {"invalid"}
    found.write.format("noop").mode("overwrite").save()
    plan = found.select("id", "fate")
    plan.collect()
    assert "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString()


def test_bilinear_is_exact_on_a_plane(spark):
    cells = [(y + 3, x - 2, 2.0 * y + 5.0 * x) for y in range(6) for x in range(8)]
    got = {(r["y"], r["x"]): r["z"] for r in raster.bilinear(spark.createDataFrame(cells, "y int, x int, z double"), 12, 4).collect()}
    for i in range(12):
        for j in range(4):
            y, x = min(max((i + 0.5) / 2 - 0.5, 0), 5), min(max((j + 0.5) * 2 - 0.5, 0), 7)
            assert abs(got[i, j] - (2 * y + 5 * x)) < 1e-9
    same = {(r["y"] + 3, r["x"] - 2, r["z"]) for r in raster.bilinear(spark.createDataFrame(cells, "y int, x int, z double"), 6, 8).collect()}
    assert same == set(cells)


def test_document_is_read_back(spark, tmp_path):
    shapes = [(1, "a&b", 2, "M1.00 2.00 L3.00 4.00"), (1, "a&b", 1, "M0.00 0.00 L9.00 0.00 L9.00 9.00 Z M1.00 1.00 L2.00 1.00 L2.00 2.00 Z"), (0, "low", 7, "M5.00 5.00 L6.00 6.00"), (3, "none", 1, ""), (3, "none", 2, None)]
    doc = output.svg_document(spark.createDataFrame(shapes, "place int, layer string, seq int, d string"), 100, 50, {"low": "stroke: red"})
    output.write_svg(doc, str(tmp_path / "out"))
    whole = "\n".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))).replace("\n\n", "\n")
    assert whole.count("<g ") == 2 and whole.index('id="low"') < whole.index('id="a&amp;b"') and whole.rstrip().endswith("</svg>") and ".low { stroke: red }" in whole
    got = files.svg_shapes(spark.createDataFrame([("f", whole + '<circle r="1"/><line x1="1" y1="2" x2="3" y2="4"/>')], "file string, value string")).collect()
    assert sorted((r["layer"] or "", r["kind"], r["path_no"], r["ring"], r["part"]) for r in got) == [("", "line", 0, 0, 0)] + [("a&amp;b", "path", 0, i, k) for i in (0, 1) for k in range(3)] + [("a&amp;b", "path", 1, 0, 0), ("low", "path", 0, 0, 0)]
