"""Fixtures of FIXTURES.md, part A, and invariants."""

import math

import pytest
from pyspark.sql import functions as F

from isohypse.operators import lines, places, raster, segments
from isohypse.sources import files

#: Side of the fixtures' rasters here: a tenth of the original's.
RECTANGLES = [((10, 10), (90, 90), 100), ((20, 20), (80, 80), 150), ((30, 30), (70, 70), 200), ((40, 40), (60, 60), 250)]


def grid(spark, rectangles, height=100, width=100):
    z = F.lit(0.0)
    for (x0, y0), (x1, y1), value in rectangles:
        z = F.when(F.col("x").between(x0, x1) & F.col("y").between(y0, y1), float(value)).otherwise(z)
    return spark.range(height * width).select((F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x")).withColumn("z", z)


@pytest.mark.parametrize("overlap", [True, False])
def test_nested_levels_have_their_areas(spark, overlap):
    bands = [(0, 50.0, 125.0), (1, 125.0, 175.0), (2, 175.0, 225.0), (3, 225.0, 255.0)]
    got = {r["level"]: r["n"] for r in raster.slice_levels(grid(spark, RECTANGLES), bands, overlap).groupBy("level").agg(F.count("*").alias("n")).collect()}
    whole = [81**2, 61**2, 41**2, 21**2]
    want = whole if overlap else [a - b for a, b in zip(whole, [*whole[1:], 0])]
    assert [got[i] for i in range(4)] == want


def test_regions_and_holes(spark):
    cells = grid(spark, [((10, 10), (90, 90), 100), ((30, 30), (70, 70), 0), ((45, 45), (55, 55), 100)])
    land = raster.region_labels(cells.where("z > 50").select("y", "x")).groupBy("region").count().collect()
    assert sorted(r["count"] for r in land) == [11 * 11, 81 * 81 - 41 * 41]
    rest = raster.region_labels(cells.where("z <= 50").select("y", "x"), eight=False)
    inner = rest.groupBy("region").agg(F.min("x").alias("x"), F.min("y").alias("y")).where("x > 0 and y > 0")
    assert inner.count() == 1


def test_bands_must_divide_evenly():
    assert raster.level_bands([0, 500, 2000, 9000], 9)[3] == (3, 500.0, 1000.0)
    with pytest.raises(ValueError):
        raster.level_bands([0, 1, 2], 3)


@pytest.mark.parametrize("distance", [0, 1, 2, 4, 8, 16, 32, 32.5, -1])
def test_hatching_by_distance(spark, distance):
    box = spark.createDataFrame([(1, 0.0, 0.0, 200.0, 200.0)], "id long, xmin double, ymin double, xmax double, ymax double")
    assert (lines.hatch_lines(box, 45, distance).count() > 0) == (distance > 0)


def test_merge():
    base = {"a": 0, "b": 1, "c": {"i": 10, "j": 11}, "d": 5}
    assert files.merge(base, {"a": -1, "c": {"i": 12, "k": 13}, "e": 6}) == {"a": -1, "b": 1, "c": {"i": 12, "j": 11, "k": 13}, "d": 5, "e": 6}


def test_greedy_order_is_a_permutation(spark):
    rows = [(0, i, float(i * 7 % 5), float(i), float(i * 3 % 4), 1.0) for i in range(20)]
    s = spark.createDataFrame(rows, "layer int, seq long, x1 double, y1 double, x2 double, y2 double")
    got = segments.greedy_order(s).orderBy("place").collect()
    assert sorted(r["seq"] for r in got) == list(range(20)) and [r["place"] for r in got] == list(range(20))


@pytest.mark.parametrize("kind", ["grid", "plane", "few points"])
def test_greedy_by_tree_equals_the_scan(kind):
    import numpy as np

    rng = np.random.default_rng(7)
    for n in (64, 65, 300):
        p = {"grid": rng.integers(0, 9, (n, 4)) * 1.0, "plane": rng.random((n, 4)), "few points": rng.integers(0, 2, (n, 4)) * 1.0}[kind]
        for got, want in zip(segments._greedy(p), segments._greedy_by_scan(p)):
            assert got.tolist() == want.tolist()


def test_greedy_order_takes_no_square_of_a_layer():
    import time

    import numpy as np

    p = np.random.default_rng(5).integers(1, 50, (40_000, 4)) * 1.0  # looking at all free rows each time: over a minute
    began = time.process_time()
    assert sorted(segments._greedy(p)[0].tolist()) == list(range(len(p)))
    assert time.process_time() - began < 15


def test_groups_come_in_order_whole_and_apart(spark):
    """Batches of three rows: groups cross them, one key is null, and sums go on from batch to batch."""
    rows = [(layer, i, 0.0, 0.0, 4.0, 0.0) for layer in (None, 0, 1) for i in range(7)]
    s = spark.createDataFrame(rows[::-1], "layer int, seq long, x1 double, y1 double, x2 double, y2 double").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = segments.filed(s, 16.0, 8.0).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for layer in (None, 0, 1):
        own = sorted((r["seq"], r["file"], r["dip"]) for r in got if r["layer"] == layer)
        # a file's break isn't counted in the file's length, but drawn
        assert [x[1] for x in own] == [0, 0, 0, 0, 1, 1, 1] and [x[2] for x in own] == [False, False, True, False, False, False, True]


def test_long_lines_pass_in_pieces(spark, monkeypatch):
    """Smoothed and simplified in pieces as in one, an unknown height and lines of one and two points included."""
    import numpy as np

    rng = np.random.default_rng(3)
    p = [(layer, i, *map(float, rng.integers(0, 50, 2))) for layer, n in ((0, 700), (1, 1), (2, 2), (3, 33)) for i in range(n)]
    p[300] = (*p[300][:2], None, 5.0)
    t = spark.createDataFrame(p[::-1], "layer int, seq long, x double, y double").repartition(3)
    one = {(r["layer"], r["seq"]): (r["x"], r["y"]) for r in lines.taubin(t, 5).collect()}
    assert len(one) == len(p) and one[1, 0] == p[700][2:] and one[2, 1] == p[702][2:] and one[0, 300][0] is None
    way = np.array([q[2:] for q in p if q[0] == 3])
    for k in (0.7, -0.2) * 5:
        way[1:-1] += k * ((way[:-2] + way[2:]) / 2 - way[1:-1])
    assert [one[3, i] for i in range(33)] == [tuple(q) for q in way.tolist()]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    monkeypatch.setattr(lines, "BATCH", 40)
    try:
        assert {(r["layer"], r["seq"]): (r["x"], r["y"]) for r in lines.taubin(t, 5).collect()} == one
        s = t.where("x is not null").withColumnRenamed("layer", "id")
        many = sorted(map(tuple, lines.simplify(s, 10.0).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    monkeypatch.setattr(lines, "SPAN", 50)
    assert sorted(map(tuple, lines.simplify(s, 10.0).collect())) == many and 300 < len(many) < len(p)


@pytest.mark.parametrize("span", [1 << 20, 30])
def test_simplified_lines_keep_the_farthest_vertices(monkeypatch, span):
    import numpy as np

    def want(p, a, b):
        d, o = p[b] - p[a], p[a + 1 : b] - p[a]
        size = np.hypot(*d)
        far = (np.abs(o[:, 0] * d[1] - o[:, 1] * d[0]) / size if size else np.hypot(o[:, 0], o[:, 1])) if b - a > 1 else np.zeros(1)
        i = a + 1 + int(np.argmax(far))
        return {a, b} | (want(p, a, i) | want(p, i, b) if far.max() > 3 else set())

    monkeypatch.setattr(lines, "SPAN", span)
    rng = np.random.default_rng(2)
    for p in (rng.integers(0, 9, (200, 2)) * 1.0, np.cumsum(rng.normal(size=(300, 2)), 0), np.zeros((5, 2)), np.zeros((1, 2))):
        assert set(np.flatnonzero(lines._kept(p, 3.0)).tolist()) == want(p, 0, len(p) - 1)


def test_budget_restarts_without_the_segment_at_the_break(spark):
    rows = [(0, i, 0.0, 0.0, float(d), 0.0) for i, d in enumerate([4, 4, 4, 4, 4])]
    s = spark.createDataFrame(rows, "layer int, seq long, x1 double, y1 double, x2 double, y2 double")
    assert [r["file"] for r in segments.budgeted(s, 8.0).orderBy("seq").collect()] == [0, 0, 1, 1, 1]


def test_kept_labels_do_not_overlap(spark):
    rows = [(i, f"place {i}", float(i * 37 % 50), float(i * 11 % 30), 1000 - i, 0, 0.0) for i in range(40)]
    p = spark.createDataFrame(rows, "id long, label string, x double, y double, population long, region int, priority double").withColumn("region", F.col("region").cast("long"))
    boxes = places.candidates(p, width=0.1)
    kept = places.place_labels(boxes, p).where("kept").join(boxes, ["id", "key"]).collect()
    for i, a in enumerate(kept):
        for b in kept[:i]:
            assert a["xmax"] <= b["xmin"] or b["xmax"] <= a["xmin"] or a["ymax"] <= b["ymin"] or b["ymax"] <= a["ymin"]


def test_streamlines_keep_their_distance(spark):
    field = spark.range(900).select((F.col("id") / 30).cast("int").alias("y"), (F.col("id") % 30).cast("int").alias("x"), F.lit(0.3).alias("angle"), F.lit(False).alias("flat"))
    got = lines.streamlines(field).collect()
    own = {}
    for r in got:
        own.setdefault(r["line"], []).append((r["x"], r["y"]))
    assert len(own) > 3
    for a in own:
        for b in own:
            if a < b:
                assert min(math.dist(p, q) for p in own[a] for q in own[b]) >= 1.0 - 1e-9


def test_svg_paths(spark, tmp_path):
    (tmp_path / "a.svg").write_text('<svg><path class="x" d="M 0 0 L 10 0 L 10 5 Z"/><circle r="3"/></svg>')
    got = files.svg_segments(spark, str(tmp_path)).orderBy("part").collect()
    assert [(r["x1"], r["y1"], r["x2"], r["y2"]) for r in got] == [(0, 0, 10, 0), (10, 0, 10, 5), (10, 5, 0, 0)]


def test_city_and_label_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text("ascii_name;altname;population;lon;lat\nA;;5;1.5;2.5\nB;b;50;3;4\n")
    assert [r["label"] for r in files.cities(spark, str(tmp_path / "c.csv"), 10).collect()] == ["B"]
    (tmp_path / "l.json").write_text('{"labels": [[[1.0, 2.0], "one\\ntwo"]]}')
    assert [(r["lat"], r["row"], r["text"]) for r in files.labels(spark, str(tmp_path / "l.json")).orderBy("row").collect()] == [(1.0, 0, "one"), (1.0, 1, "two")]
