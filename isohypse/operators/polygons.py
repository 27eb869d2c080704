"""Polygons as edges (id, k, px, py, qx, qy): clipping, subtraction, union and what lies inside.

A polygon is the set of its directed edges, outer rings counter-clockwise and holes clockwise; `k` tells
its edges apart. Lines are rows with ends x1, y1, x2, y2 and key columns.

Everything rests on one step, `inside_runs`: the crossings of a line, carried on beyond its ends, with a
polygon's edges, sorted along it, enclose the line's parts inside by twos. An edge crosses if its ends are on
different sides, an end on the line counting as left of it. So a touched vertex counts twice or not at all,
crossings are even in number, and a line along an edge counts as lying just to the right of it.

Lines meet polygons through grid cells by equality, each pair in one of the cells only. A polygon of few edges brings them
along, so its crossings with a line are counted where the two meet and nothing is dealt out again; those of more edges
are met through horizontal strips, so no large polygon is needed in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENDS = ["x1", "y1", "x2", "y2"]
EDGE = ["px", "py", "qx", "qy"]
#: Breadth of cells and strips, and what a line's reach is widened by against rounding.
CELL, SLACK = 8.0, 1e-6


def cells_between(low: Column, high: Column, cell: float) -> Column:
    return F.sequence(F.floor((low - SLACK) / cell), F.floor((high + SLACK) / cell))


def boxes(edges: DataFrame, *more: str) -> DataFrame:
    """id, columns that are equal within a polygon, xmin, ymin, xmax, ymax."""
    return edges.groupBy("id", *more).agg(*[f(g(f"p{c}", f"q{c}")).alias(f"{c}{n}") for c in "xy" for f, g, n in ((F.min, F.least, "min"), (F.max, F.greatest, "max"))])


def at(a: str, b: str, t: Column | str) -> Column:
    """The point of the way from column a to column b."""
    t = F.col(t) if isinstance(t, str) else t
    return F.col(a) + (F.col(b) - F.col(a)) * t


def line_cells(lines: DataFrame, cell: float) -> DataFrame:
    """Lines with the cells (row, col) that they pass: for each row the columns between their ends in it.

    _first is the row's least column, _before and _until are those of the row below, null for a line's first row.
    """
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = lines.withColumn("row", F.explode(cells_between(low, high, cell)))
    slope = (F.col("x2") - F.col("x1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))
    xs = lambda y: F.col("x1") + (y - F.col("y1")) * slope
    left, right = F.least("x1", "x2"), F.greatest("x1", "x2")
    level = slope.isNull()  # greatest and least pass over nulls
    inside = lambda x, other: F.when(level, other).otherwise(F.least(F.greatest(x, left), right))

    def columns(row: Column) -> tuple[Column, Column]:
        a, b = inside(xs(F.greatest(low, row * cell)), left), inside(xs(F.least(high, (row + 1) * cell)), right)
        return F.floor((F.least(a, b) - SLACK) / cell), F.floor((F.greatest(a, b) + SLACK) / cell)

    (first, last), (before, until) = columns(F.col("row")), columns(F.col("row") - 1)
    later = F.col("row") > F.floor((low - SLACK) / cell)
    rows = rows.withColumns({"_first": first, "_last": last, "_before": F.when(later, before), "_until": F.when(later, until)})
    return rows.withColumn("col", F.explode(F.sequence("_first", "_last"))).drop("_last")


def box_cells(found: DataFrame, cell: float) -> DataFrame:
    """Boxes (xmin, ymin, xmax, ymax) with the cells (row, col) that they touch."""
    return found.withColumn("row", F.explode(cells_between(F.col("ymin"), F.col("ymax"), cell))).withColumn("col", F.explode(cells_between(F.col("xmin"), F.col("xmax"), cell)))


def meetings(lines: DataFrame, found: DataFrame, cell: float, when: str = "true") -> DataFrame:
    """Each line with each polygon's box that lies in one of its cells, and whose columns satisfy `when`.

    A line passes a box in rows that follow each other; the pair is formed in the first one, in its least column that both have.
    """
    near = box_cells(found, cell)
    for name, c in (("_row", "ymin"), ("_left", "xmin")):
        near = near.withColumn(name, F.floor((F.col(c) - SLACK) / cell))
    near = near.withColumn("_right", F.floor((F.col("xmax") + SLACK) / cell))
    pairs = line_cells(lines, cell).join(near.hint("merge"), ["row", "col"]).where(when)
    pairs = pairs.where("col = greatest(_first, _left) and not coalesce(row > _row and _before <= _right and _until >= _left, false)")
    apart = "least(x1, x2) > xmax or greatest(x1, x2) < xmin or least(y1, y2) > ymax or greatest(y1, y2) < ymin"
    return pairs.where(f"not ({apart})").drop("row", "col", "_first", "_before", "_until", "_row", "_left", "_right")


#: Edges of a polygon that are brought along to where lines meet it.
FEW_EDGES = 64


def inside_runs(lines: DataFrame, edges: DataFrame, keys: list[str], cell: float = CELL, when: str = "true", more: tuple[str, ...] = (), own: bool = False) -> DataFrame:
    """Lines' columns, id, t1, t2: the parts of each line inside each polygon, as shares of its length from 0 to 1.

    keys name a line. `when` restricts the pairs by columns of the line and of the polygon, of which `more` are
    carried along. With `own`, lines have an `id` and meet that polygon only. Points have no parts.
    """
    lines = lines.where("x1 <> x2 or y1 <> y2")
    sizes = edges.groupBy("id").agg(F.count("*").alias("n"))
    if (sizes.agg(F.max("n")).first()[0] or 0) <= FEW_EDGES:
        return _few_edges_runs(lines, edges, cell, when, more, own)
    large = sizes.where(f"n > {FEW_EDGES}").select("id").hint("merge")
    few = _few_edges_runs(lines, edges.join(large, "id", "left_anti"), cell, when, more, own)
    return few.unionByName(_many_edges_runs(lines, edges.join(large, "id", "left_semi"), keys, cell, when, more, own))


def _few_edges_runs(lines: DataFrame, edges: DataFrame, cell: float, when: str, more: tuple[str, ...], own: bool) -> DataFrame:
    box = [f(g(f"p{c}", f"q{c}")).alias(f"{c}{n}") for c in "xy" for f, g, n in ((F.min, F.least, "min"), (F.max, F.greatest, "max"))]
    found = edges.groupBy("id", *more).agg(F.collect_list(F.struct(*EDGE)).alias("_edges"), *box)
    pairs = lines.join(found.hint("merge"), "id").where(when) if own else meetings(lines, found, cell, when)
    side = lambda p: f"(x2 - x1) * (e.{p}y - y1) - (y2 - y1) * (e.{p}x - x1)"
    on = lambda c: f"s.e.p{c} + (s.e.q{c} - s.e.p{c}) * (s.a / (s.a - s.b)) - {c}1"
    sides = f"filter(transform(_edges, e -> struct(e, {side('p')} as a, {side('q')} as b)), s -> (s.a >= 0) <> (s.b >= 0))"
    t = f"transform({sides}, s -> (({on('x')}) * (x2 - x1) + ({on('y')}) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))"
    hits = pairs.withColumn("_t", F.sort_array(F.expr(t))).where("size(_t) > 0").drop("_edges", "xmin", "ymin", "xmax", "ymax")
    runs = hits.withColumn("_r", F.explode(F.expr("transform(sequence(0, size(_t) - 1, 2), i -> struct(greatest(_t[i], 0D) as t1, least(get(_t, i + 1), 1D) as t2))"))).drop("_t")
    return runs.select(*[c for c in runs.columns if c != "_r"], "_r.t2", "_r.t1").where("t1 < t2")


def _many_edges_runs(lines: DataFrame, edges: DataFrame, keys: list[str], cell: float, when: str, more: tuple[str, ...], own: bool) -> DataFrame:
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    found = boxes(edges, *more)
    pairs = lines.join(found, "id").where(when) if own else meetings(lines, found, cell, when)
    # strips of the line as far as it runs through the polygon's box
    y_at = lambda x: F.col("y1") + (F.col(x) - F.col("x1")) * dy / F.nullif(dx, F.lit(0.0))
    low = F.greatest("ymin", F.coalesce(F.least(y_at("xmin"), y_at("xmax")), F.col("ymin")))
    high = F.least("ymax", F.coalesce(F.greatest(y_at("xmin"), y_at("xmax")), F.col("ymax")))
    pairs = pairs.withColumn("_low", low).withColumn("_high", high).where(F.col("_low") <= F.col("_high") + SLACK)
    pairs = pairs.withColumn("strip", F.explode(cells_between(F.least("_low", "_high"), F.greatest("_low", "_high"), cell))).drop("_low", "_high", "xmin", "ymin", "xmax", "ymax")
    parts = edges.select("id", *EDGE).withColumn("strip", F.explode(cells_between(F.least("py", "qy"), F.greatest("py", "qy"), cell)))
    side = lambda p: dx * (F.col(f"{p}y") - F.col("y1")) - dy * (F.col(f"{p}x") - F.col("x1"))
    hits = pairs.join(parts, ["id", "strip"]).withColumn("_a", side("p")).withColumn("_b", side("q")).where("(_a >= 0) <> (_b >= 0)")
    u = F.col("_a") / (F.col("_a") - F.col("_b"))
    hits = hits.withColumn("_x", F.col("px") + (F.col("qx") - F.col("px")) * u).withColumn("_y", F.col("py") + (F.col("qy") - F.col("py")) * u)
    # a crossing counts in the strip that it lies in
    y = F.least(F.greatest(F.col("_y"), F.least("py", "qy")), F.greatest("py", "qy"))
    hits = hits.where(F.floor(y / cell) == F.col("strip"))
    hits = hits.withColumn("t", ((F.col("_x") - F.col("x1")) * dx + (F.col("_y") - F.col("y1")) * dy) / (dx * dx + dy * dy)).drop("_a", "_b", "_x", "_y", "strip", *EDGE)
    w = Window.partitionBy(*keys, "id").orderBy("t")
    runs = hits.withColumn("_k", F.row_number().over(w)).withColumn("t2", F.least(F.lead("t").over(w), F.lit(1.0))).withColumn("t1", F.greatest("t", F.lit(0.0)))
    return runs.where("_k % 2 = 1 and t1 < t2").drop("_k", "t")


def part(runs: DataFrame) -> DataFrame:
    """Lines cut to t1..t2."""
    ends = [at("x1", "x2", "t1"), at("y1", "y2", "t1"), at("x1", "x2", "t2"), at("y1", "y2", "t2")]
    return runs.select(*[c for c in runs.columns if c not in (*ENDS, "t1", "t2")], *[e.alias(c) for e, c in zip(ends, ENDS)])


def by_shape(lines: DataFrame, more: list[str], found) -> DataFrame:
    """The lines' other columns with what `found` makes of their shapes: of each place and `more` once, however many lines have it."""
    keys = [*ENDS, *more]
    shapes = found(lines.where("x1 <> x2 or y1 <> y2").select(*keys).distinct(), keys)
    own, each = lines.alias("own"), shapes.alias("each").hint("merge")
    same = [F.col(f"own.{c}").eqNullSafe(F.col(f"each.{c}")) for c in keys]
    return own.join(each, same).select("own.*", *[f"each.{c}" for c in shapes.columns if c not in keys])


def clip_lines(lines: DataFrame, edges: DataFrame, keys: list[str], cell: float = CELL, own: bool = False) -> DataFrame:
    """The lines' parts inside each polygon, with its id; lines of equal ends are clipped once."""
    return part(by_shape(lines, ["id"] if own else [], lambda shapes, k: inside_runs(shapes, edges, k, cell, own=own)))


def outside_runs(lines: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Lines' columns, t1, t2: what the runs (t1, t2) leave of each line; runs may overlap."""
    columns = lines.columns
    ends = lines.where("x1 <> x2 or y1 <> y2").withColumn("t1", F.lit(1.0)).withColumn("t2", F.lit(1.0))
    w = Window.partitionBy(*keys).orderBy("t1", "t2")
    reached = F.coalesce(F.max("t2").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return runs.select(*columns, "t1", "t2").unionByName(ends).withColumn("_from", reached).where("t1 > _from").select(*columns, F.col("_from").alias("t1"), F.col("t1").alias("t2"))


def subtract_zones(lines: DataFrame, zones: DataFrame, keys: list[str], layer: str = "layer", cell: float = CELL) -> DataFrame:
    """The lines' parts outside all zones (edges with zone_rank) of layers drawn before theirs, numbered by `part`.

    One pass for all layers: what a line loses depends on the zones' ranks only, not on the order of subtraction. Lines of
    equal ends and layer are cut once.
    """
    def left(shapes: DataFrame, k: list[str]) -> DataFrame:
        rest = outside_runs(shapes, inside_runs(shapes, zones, k, cell, f"zone_rank < {layer}", ("zone_rank",)), k)
        return rest.withColumn("part", F.row_number().over(Window.partitionBy(*k).orderBy("t1")))

    return part(by_shape(lines, [layer], left))


def as_lines(edges: DataFrame, own: str) -> DataFrame:
    return edges.select(F.col("id").alias(own), "k", F.col("px").alias("x1"), F.col("py").alias("y1"), F.col("qx").alias("x2"), F.col("qy").alias("y2"))


def crop_polygons(edges: DataFrame, stencil: DataFrame, cell: float = CELL) -> DataFrame:
    """id, stencil, k, side, px, py, qx, qy: the edges of each polygon's intersection with each stencil polygon that it meets.

    They are the polygon's edges inside the stencil (side 0) and the stencil's inside the polygon (side 1). One
    that lies along the other's edge in the same direction counts from the polygon's side only.
    """
    one = part(inside_runs(as_lines(edges, "own"), stencil, ["own", "k"], cell)).select(F.col("own").alias("id"), F.col("id").alias("stencil"), "k", F.lit(0).alias("side"), *ENDS)
    two = part(inside_runs(as_lines(stencil, "own"), edges, ["own", "k"], cell)).select("id", F.col("own").alias("stencil"), "k", F.lit(1).alias("side"), *ENDS)
    both = one.unionByName(two)
    return both.select("id", "stencil", "k", "side", *[F.col(e).alias(a) for e, a in zip(ENDS, EDGE)])


def union_edges(edges: DataFrame, cell: float = CELL) -> DataFrame:
    """px, py, qx, qy: the boundary of the union of all polygons.

    Each edge without its parts inside other polygons; parts of the boundary that several polygons share in the same
    direction come once, those of neighbours that face each other not at all.
    """
    lines = as_lines(edges, "own")
    runs = inside_runs(lines, edges, ["own", "k"], cell, "id <> own")
    left = part(outside_runs(lines, runs, ["own", "k"]))
    return left.select(*[F.col(e).alias(a) for e, a in zip(ENDS, EDGE)]).distinct()


def signed_area() -> Column:
    """Sum over a polygon's edges; positive for counter-clockwise outer rings."""
    return F.sum((F.col("px") * F.col("qy") - F.col("qx") * F.col("py")) / 2)


def points_inside(points: DataFrame, edges: DataFrame, cell: float = CELL, more: tuple[str, ...] = ()) -> DataFrame:
    """Points (x, y) with the id of each polygon that they lie in (even-odd): edges that pass left of a point, in its strip."""
    cell_of = points.withColumn("row", F.floor(F.col("y") / cell)).withColumn("col", F.floor(F.col("x") / cell))
    near = cell_of.join(box_cells(boxes(edges, *more), cell), ["row", "col"]).where("x >= xmin and x <= xmax and y >= ymin and y <= ymax").drop("xmin", "ymin", "xmax", "ymax", "col")
    parts = edges.select("id", *EDGE).where("py <> qy").withColumn("row", F.explode(cells_between(F.least("py", "qy"), F.greatest("py", "qy"), cell)))
    left = near.join(parts, ["id", "row"]).where("(py > y) <> (qy > y) and x > (qx - px) * (y - py) / (qy - py) + px")
    return left.groupBy(*points.columns, "id", *more).agg((F.count("*") % 2).alias("_odd")).where("_odd = 1").drop("_odd")


def zonal_direction(cells: DataFrame, edges: DataFrame, angle: str = "angle", cell: float = CELL) -> DataFrame:
    """id, n, direction in degrees: the circular mean of the angles (radians) of the cells (y, x) whose centres lie in each polygon."""
    points = cells.select(F.col("x").alias("cell_x"), F.col("y").alias("cell_y"), (F.col("x") + 0.5).alias("x"), (F.col("y") + 0.5).alias("y"), F.col(angle).alias("angle"))
    inside = points_inside(points, edges, cell)
    return inside.groupBy("id").agg(F.count("*").alias("n"), F.degrees(F.atan2(F.sum(F.sin("angle")), F.sum(F.cos("angle")))).alias("direction"))
