"""Rasters as triangle meshes and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CORNERS = [f"{c}{i}" for i in (1, 2, 3) for c in "xyz"]


def triangles(cells: DataFrame, scale: float = 1.0) -> DataFrame:
    """y, x, half, x1, y1, z1 ... z3: two triangles for each square of four cells (y, x, z), corners at `scale` times the cells'."""
    row, col = Window.partitionBy("y").orderBy("x"), Window.partitionBy("x").orderBy("y")
    t = cells.select("y", "x", F.col("z").alias("a")).withColumn("b", F.when(F.lead("x").over(row) == F.col("x") + 1, F.lead("a").over(row)))
    under = F.lead("y").over(col) == F.col("y") + 1
    t = t.withColumn("c", F.when(under, F.lead("a").over(col))).withColumn("d", F.when(under, F.lead("b").over(col))).where("b is not null and c is not null and d is not null")
    at = lambda dx, dy, z: [(F.col("x") + dx) * F.lit(scale), (F.col("y") + dy) * F.lit(scale), F.col(z)]
    halves = [[*at(0, 0, "a"), *at(0, 1, "c"), *at(1, 0, "b")], [*at(1, 0, "b"), *at(0, 1, "c"), *at(1, 1, "d")]]
    face = F.explode(F.array(*[F.struct(F.lit(i).alias("half"), *[v.cast("double").alias(n) for v, n in zip(h, CORNERS)]) for i, h in enumerate(halves)]))
    return t.select("y", "x", face.alias("f")).select("y", "x", "f.half", *[f"f.{c}" for c in CORNERS])


def _decimals(*values: float | None) -> str | None:
    """Three decimals each, as C prints them: from the double's exact value, ties to even. Java rounds its shortest digits up."""
    return None if None in values else " ".join(f"{v:.3f}" for v in values)


def stl_facets(faces: DataFrame) -> DataFrame:
    """y, x, half, facet: each triangle as a facet of an ASCII STL file, with its unit normal; null where a height is."""
    ux, uy, uz = (F.col(f"{c}2") - F.col(f"{c}1") for c in "xyz")
    vx, vy, vz = (F.col(f"{c}3") - F.col(f"{c}1") for c in "xyz")
    t = faces.withColumn("nx", uy * vz - uz * vy).withColumn("ny", uz * vx - ux * vz).withColumn("nz", ux * vy - uy * vx)
    t = t.withColumn("n", F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz")))
    decimals = F.udf(_decimals, "string", useArrow=True)
    corner = lambda i: F.concat(F.lit("vertex "), decimals(f"x{i}", f"y{i}", f"z{i}"))
    # scaled, rounded and scaled back, as SQL's round does: its shortest digits alone would go up at ties
    normal = F.format_string("facet normal %.4f %.4f %.4f", *[F.round(F.col(f"n{c}") / F.col("n") * 10000) / 10000 + F.lit(0.0) for c in "xyz"])
    text = [normal, F.lit("outer loop"), corner(1), corner(2), corner(3), F.lit("endloop"), F.lit("endfacet")]
    return t.select("y", "x", "half", F.concat(*[p for x in text for p in (F.lit("\n"), x)][1:]).alias("facet"))


def heights(faces: DataFrame) -> DataFrame:
    """y, x, z: the highest point of a mesh above each cell's centre, by vertical rays.

    A triangle meets the cells of its box only, and gives its height there by the centre's barycentric
    coordinates. Cells that no triangle lies above have no row; upright triangles give none.
    """
    low, high = (lambda c: F.floor(F.least(*[f"{c}{i}" for i in (1, 2, 3)]) - 0.5)), (lambda c: F.ceil(F.greatest(*[f"{c}{i}" for i in (1, 2, 3)]) - 0.5))
    t = faces.withColumn("_d", F.expr("(y2 - y3) * (x1 - x3) + (x3 - x2) * (y1 - y3)")).where("_d <> 0").select("_d", *CORNERS)
    t = t.withColumn("y", F.explode(F.sequence(low("y"), high("y")))).withColumn("x", F.explode(F.sequence(low("x"), high("x"))))
    t = t.withColumn("_a", F.expr("((y2 - y3) * (x + 0.5D - x3) + (x3 - x2) * (y + 0.5D - y3)) / _d")).withColumn("_b", F.expr("((y3 - y1) * (x + 0.5D - x3) + (x1 - x3) * (y + 0.5D - y3)) / _d"))
    inside = t.where("_a >= 0 and _b >= 0 and _a + _b <= 1")
    return inside.groupBy("y", "x").agg(F.max(F.expr("_a * z1 + _b * z2 + (1 - _a - _b) * z3")).alias("z"))
