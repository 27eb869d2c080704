"""Polygons cleaned in a fixed order, with counters of what each step takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.geometry import ring_area, spherical_area
from .polygons import CELL, line_cells

#: Points of a ring that has an inside, its first one again at the end included.
LEAST_POINTS = 4


def unpack(shapes: DataFrame) -> DataFrame:
    """id, part, ring: a row for each ring of shapes (id, rings array<ring>); null shapes and rings have none."""
    return shapes.select("id", F.posexplode("rings").alias("part", "ring")).where("ring is not null")


def ring_edges(rings: DataFrame) -> DataFrame:
    """id, part, k, x1, y1, x2, y2 of closed rings."""
    t = rings.where("size(ring) >= 2").withColumn("k", F.explode(F.expr("sequence(0, size(ring) - 2)")))
    return t.selectExpr("id", "part", "k", "ring[k].x as x1", "ring[k].y as y1", "ring[k + 1].x as x2", "ring[k + 1].y as y2")


def crossing_rings(rings: DataFrame, cell: float = CELL) -> DataFrame:
    """id, part of the rings of which two edges cross inside both; edges meet through the cells that they pass."""
    edges = line_cells(ring_edges(rings), cell)
    a, b = edges.alias("a"), edges.alias("b")
    pts = {"p": ("a.x1", "a.y1"), "q": ("a.x2", "a.y2"), "r": ("b.x1", "b.y1"), "s": ("b.x2", "b.y2")}
    side = lambda u, v, t: f"sign(({pts[v][0]} - {pts[u][0]}) * ({pts[t][1]} - {pts[u][1]}) - ({pts[v][1]} - {pts[u][1]}) * ({pts[t][0]} - {pts[u][0]}))"
    crossed = f"a.k < b.k and {side('p', 'q', 'r')} * {side('p', 'q', 's')} < 0 and {side('r', 's', 'p')} * {side('r', 's', 'q')} < 0"
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("id", "part", "row", "col")]
    # rows of a few bytes that grow with the rings: their shuffles look small enough for a broadcast, which the driver then has to hold
    return a.join(b.hint("merge"), same).where(crossed).select("a.id", "a.part").distinct()


def marked(rings: DataFrame, least_sphere: float | None = None, least_plane: float | None = None, cell: float = CELL) -> DataFrame:
    """`rings` (id, part, ring) with fate: the first step that takes a ring (invalid, empty, small), or kept.

    Invalid: two edges cross. Empty: fewer than three corners, or no area. Small: under an area on the sphere (rings
    in degrees), or in the plane.
    """
    bad = crossing_rings(rings, cell).withColumn("_bad", F.lit(True))
    size, sphere = F.abs(ring_area(F.col("ring"))), F.abs(spherical_area(F.col("ring")))
    small = F.lit(False)
    if least_sphere is not None:
        small = small | (sphere < least_sphere)
    if least_plane is not None:
        small = small | (size < least_plane)
    fate = F.when(F.coalesce("_bad", F.lit(False)), "invalid").when((F.size("ring") < LEAST_POINTS) | (size == 0), "empty").when(small, "small").otherwise("kept")
    return rings.join(bad.hint("merge"), ["id", "part"], "left").withColumn("fate", fate).drop("_bad")


def cleaned(shapes: DataFrame, least_sphere: float | None = None, least_plane: float | None = None, cell: float = CELL, counters: Observation | None = None) -> DataFrame:
    """id, part, ring of the shapes' rings that `marked` keeps; `counters` gets input, invalid, empty, small, output
    when the result is computed, without a pass of their own."""
    found = marked(unpack(shapes), least_sphere, least_plane, cell)
    if counters is not None:
        found = found.observe(counters, F.count("*").alias("input"), *[F.count_if(F.col("fate") == f).alias(f) for f in ("invalid", "empty", "small")], F.count_if(F.col("fate") == "kept").alias("output"))
    return found.where("fate = 'kept'").drop("fate")
