"""Places where a query once did less than its whole job."""

from isohypse import catalog
from isohypse.operators import places, raster, segments
from isohypse.plans import output


def test_kept_labels_of_the_query_do_not_overlap(spark):
    d = "/root/testdata/sf0.01"
    boxes = places.candidates(catalog._planar(spark, d))
    circles = catalog._planar(spark, d).select("id", "x", "y")
    kept = [tuple(r) for r in catalog.QUERIES["g11_g12_label_placement"](spark, d).where("kept").join(boxes, ["id", "key"]).join(circles, "id").select("xmin", "ymin", "xmax", "ymax", "x", "y").collect()]
    apart = lambda a, b: a[2] <= b[0] + 1e-8 or b[2] <= a[0] + 1e-8 or a[3] <= b[1] + 1e-8 or b[3] <= a[1] + 1e-8
    round_ = [(x - 1.5, y - 1.5, x + 1.5, y + 1.5) for *_, x, y in kept]
    assert len(kept) > 20
    for i, a in enumerate(kept):
        for j in range(i):
            assert apart(a, kept[j]) and apart(a, round_[j]) and apart(round_[i], kept[j])


def test_label_regions_come_from_the_boxes(spark):
    # labels 30 wide: the envelopes of 1 and 2 overlap, as do those of 2 and 3; 4 lies apart
    p = spark.createDataFrame([(i, "a" * 10, x, y) for i, x, y in ((1, 0.0, 0.0), (2, 60.0, 10.0), (3, 110.0, 0.0), (4, 55.0, 90.0))], "id long, label string, x double, y double")
    assert {r["id"]: r["region"] for r in places.label_regions(places.candidates(p)).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_box_pairs_equal_all_pairs(spark):
    rows = [(i, float(i * 37 % 101) - 50, float(i * 53 % 89) - 40, float(i * 37 % 101) - 50 + i % 7, float(i * 53 % 89) - 40 + i % 5) for i in range(120)]
    b = spark.createDataFrame(rows, "id long, xmin double, ymin double, xmax double, ymax double")
    want = sorted((a[0], c[0]) for a in rows for c in rows if a[0] < c[0] and a[1] < c[3] and c[1] < a[3] and a[2] < c[4] and c[2] < a[4])
    assert want and sorted(tuple(r) for r in places.box_pairs(b).select("a", "b").collect()) == want


def test_box_links_connect_what_pairs_connect(spark):
    import numpy as np

    def named(n, pairs):
        up = list(range(n))
        for a, b in pairs:
            u, v = up[a], up[b]
            up = [min(u, v) if x in (u, v) else x for x in up]
        return up

    rng = np.random.default_rng(4)
    for n, far, wide in ((60, 30, 4), (60, 90, 9), (200, 60, 3), (9, 5, 5)):
        for whole in (True, False):
            x0, y0, w, h = rng.integers(0, far, n), rng.integers(0, far, n), rng.integers(1, wide, n), rng.integers(1, wide, n)
            x0, y0, x1, y1 = (v * 1.0 if whole else v + rng.random(n) / 9 for v in (x0, y0, x0 + w, y0 + h))
            pairs = [(a, b) for a in range(n) for b in range(a) if x0[a] < x1[b] and x0[b] < x1[a] and y0[a] < y1[b] and y0[b] < y1[a]]
            tops = places._touching(x0, y0, x1, y1)
            assert [tops.index(t) for t in tops] == named(n, pairs)
    b = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(zip(x0, y0, x1, y1))], "id long, xmin double, ymin double, xmax double, ymax double")
    assert named(n, map(tuple, places.box_links(b).collect())) == named(n, pairs)


def test_links_of_a_crowd_are_not_its_pairs(spark):
    crowd = spark.range(3000).selectExpr("id", "id / 3000D as xmin", "id / 3000D as ymin", "id / 3000D + 2 as xmax", "id / 3000D + 2 as ymax")
    assert 2999 <= places.box_links(crowd).count() <= 4 * 3000  # of 4,498,500 pairs


def area(ring):
    return abs(sum(a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(ring, [*ring[1:], ring[0]]))) / 2


def test_region_polygons_have_their_holes(spark):
    # a ring with two holes, an island in one; a pair that touches at a corner; a bay at the edge is no hole
    rows = ["..........", ".#######..", ".#..#.##..", ".#....##..", ".#.##.##..", ".#.##.#.#.", ".#....##..", ".#######..", "........#.", "###......#", "..#...####", "..#...#..."]
    cells = spark.createDataFrame([(y, x, c == "#") for y, r in enumerate(rows) for x, c in enumerate(r)], "y int, x int, land boolean")
    got = {r["ymin"]: r for r in raster.region_polygons(cells.where("land").select("y", "x"), cells).collect()}
    assert sum(r["n_cells"] for r in got.values()) == sum(r.count("#") for r in rows)
    big, island, bay = got[1], got[4], got[9]
    assert sorted((h["n_cells"], area(h["ring"]), len(h["ring"])) for h in big["holes"]) == [(1, 1, 4), (15, 19, 8)]
    assert area(big["ring"]) == big["n_cells"] + 1 + 19 and not island["holes"] and not bay["holes"]
    assert area(island["ring"]) == 4 and len(island["ring"]) == 4


RECTANGLES = {
    # (x0, y0, x1, y1, value) in order, corners included; bounds; polygons' holes
    "single": ([(5, 5, 95, 45, 100), (10, 10, 90, 40, 200)], (50, 150), [1]),
    "hole": ([(5, 5, 95, 45, 100), (10, 10, 90, 40, 200), (15, 15, 85, 35, 0)], (50, 100), [1]),
    "island": ([(5, 5, 95, 45, 100), (10, 10, 90, 40, 200), (15, 15, 85, 35, 0), (20, 20, 80, 30, 250)], (50, 255), [0, 1]),
    "holes": ([(5, 5, 95, 45, 100), (10, 10, 15, 15, 0), (10, 20, 15, 25, 0), (10, 30, 15, 35, 0)], (50, 255), [3]),
}


def test_levels_of_rectangles(spark):
    """The fixed rectangle rasters at a twentieth of their size, all at once as levels of their own."""
    cells, mask, want = [], [], []
    for level, (boxes, (low, high), holes) in enumerate(RECTANGLES.values()):
        z = [[0] * 100 for _ in range(50)]
        for x0, y0, x1, y1, v in boxes:
            for y in range(y0, y1 + 1):
                z[y][x0 : x1 + 1] = [v] * (x1 + 1 - x0)
        mask += [(level, y, x) for y in range(50) for x in range(100) if low < z[y][x] <= high]
        want += [(level, n) for n in holes]
    cells = spark.createDataFrame([(y, x) for y in (0, 49) for x in (0, 99)], "y int, x int")
    got = raster.level_polygons(spark.createDataFrame(mask, "level int, y int, x int"), cells).collect()
    assert sorted((r["level"], len(r["holes"])) for r in got) == want
    assert all(area(r["ring"]) == r["n_cells"] + sum(area(h["ring"]) for h in r["holes"]) for r in got)


def test_rings_cross_blocks(spark, monkeypatch):
    rows = ["".join("#" if (y * 7 + x * 3) % 5 or y % 6 == 0 else "." for x in range(40)) for y in range(30)]
    cells = spark.createDataFrame([(y, x, c == "#") for y, r in enumerate(rows) for x, c in enumerate(r)], "y int, x int, land boolean")
    one = sorted(map(str, raster.region_polygons(cells.where("land"), cells).collect()))
    monkeypatch.setattr(raster, "RING_BLOCK", 7)
    assert sorted(map(str, raster.region_polygons(cells.where("land"), cells).collect())) == one and one


def test_dips_restart_behind_the_segment(spark):
    rows = [(0, i // 4, i, 0.0, 0.0, 50.0, 0.0) for i in range(8)]
    s = spark.createDataFrame(rows, "layer int, file int, seq long, x1 double, y1 double, x2 double, y2 double")
    assert [r["dip"] for r in segments.dips(s).orderBy("seq").collect()] == [False, False, True, False] * 2
    assert catalog.QUERIES["w09_w13_budgeted_files"](spark, "/root/testdata/sf0.001").where("dip").count() > 0


def test_gcode_is_ordered_and_dips(spark):
    rows = [(0, 0, 0.0, 0.0, 50.0, 0.0), (0, 1, 100.0, 0.0, 150.0, 0.0), (0, 2, 100.0, 0.0, 50.0, 0.0), (0, 3, 150.0, 0.0, 150.0, 9.0)]
    got = output.gcode(spark.createDataFrame(rows, "layer int, seq long, x1 double, y1 double, x2 double, y2 double")).orderBy("seq").collect()
    assert [r["lines"].count("Y-20") for r in got] == [0, 0, 1, 0] and [r["lines"].count("G1 Z0") for r in got] == [1, 0, 0, 1]
    assert ["G1 X50.000 Y0.000" in got[0]["lines"], got[1]["lines"], "G1 X150.000 Y0.000" in got[2]["lines"]] == [True, "G1 X100.000 Y0.000", True]
