"""Exact Euclidean distances on rasters, what grows by them, and iso-lines of any field.

A distance takes two passes: along each row the nearest source, by windows; then along each column the lower
envelope of the parabolas that the rows' distances are. A row and a column are what a task holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .chains import chains
from .raster import rectangle


def _envelope(f: np.ndarray, y: np.ndarray) -> np.ndarray:
    """min over j of (y[i] - y[j])^2 + f[j], of ascending whole numbers y; f is -1 where there's no parabola."""
    own = np.flatnonzero(f >= 0)
    if not len(own):
        return np.full(len(y), -1)
    v, z = [int(own[0])], [-np.inf]
    for q in own[1:].tolist():
        while True:
            p = v[-1]
            s = (int(f[q]) + int(y[q]) ** 2 - int(f[p]) - int(y[p]) ** 2) / (2 * int(y[q] - y[p]))
            if s > z[-1]:
                break
            v.pop(), z.pop()
        v.append(q)
        z.append(s)
    at = np.array(v)[np.searchsorted(np.array(z), y, "right") - 1]
    return (y - y[at]) ** 2 + f[at]


def squared_distance(cells: DataFrame, source: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """`by`, y, x, d2: each cell's squared distance to the nearest cell where `source` holds, of the same `by`; null without any.

    Whole numbers, exact. Cells may be missing; they are no sources, but distances reach across them. `by` has few values.
    """
    given = cells.select(*by, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.when(source, F.col("x").cast("int")).alias("_s"), F.lit(True).alias("_own"))
    grid = rectangle(cells)
    grid = grid.crossJoin(F.broadcast(given.select(*by).distinct())) if by else grid
    marked = grid.join(given, [*by, "y", "x"], "left")
    w = Window.partitionBy(*by, "y").orderBy("x")
    before = F.last("_s", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_s", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    near = F.least(F.col("x") - before, after - F.col("x")).cast("long")
    rows = marked.select(*by, "y", "x", F.coalesce(near * near, F.lit(-1)).cast("long").alias("d2"), "_own")

    def column(group: pa.Table) -> pa.Table:
        group = group.sort_by("y")
        d2 = _envelope(group["d2"].to_numpy(), group["y"].to_numpy().astype(np.int64))
        return group.set_column(group.schema.get_field_index("d2"), "d2", pa.array(d2.astype(np.int64), mask=d2 < 0))

    return rows.groupBy(*by, "x").applyInArrow(column, StructType([StructField(f.name, f.dataType) for f in rows.schema])).where("_own").drop("_own")


def grown(cells: DataFrame, source: Column, radius: float, by: tuple[str, ...] = ()) -> DataFrame:
    """`by`, y, x of the cells within `radius` of a source, sources included: the buffer of their union."""
    return squared_distance(cells, source, by).where(F.col("d2") <= radius * radius).select(*by, "y", "x")


def ring_cells(cells: DataFrame, source: Column, radius: float) -> DataFrame:
    """y, x, d2 of the buffer without what it grew from."""
    return squared_distance(cells, source).where((F.col("d2") > 0) & (F.col("d2") <= radius * radius))


def prepend_zones(zones: DataFrame, cells: DataFrame, source: Column, radius: float) -> DataFrame:
    """Zones (zone_rank, y, x) with the grown sources in front as rank 0, the others behind it."""
    return zones.select((F.col("zone_rank") + 1).alias("zone_rank"), "y", "x").unionByName(grown(cells, source, radius).select(F.lit(0).alias("zone_rank"), "y", "x"))


def isolines(field: DataFrame, levels: DataFrame, value: str = "v") -> DataFrame:
    """level, a, b, block, x1, y1, x2, y2: iso-lines of a field (y, x, value) at levels (level, at), by squares of four cells.

    A square's sides that the level passes between their ends are joined, from where the field falls to where it
    rises, clockwise (y down). In a square where all four are passed, its mean decides which two. a and b name the
    sides, so links of neighbouring squares meet; block is a stretch of 64 by 64 squares of one level. The
    levels are a short list, so their table is broadcast.
    """
    row, col = Window.partitionBy("y").orderBy("x"), Window.partitionBy("x").orderBy("y")
    t = field.select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col(value).alias("v0"))
    t = t.withColumn("v1", F.when(F.lead("x").over(row) == F.col("x") + 1, F.lead("v0").over(row)))
    below = F.lead("y").over(col) == F.col("y") + 1
    t = t.withColumn("v3", F.when(below, F.lead("v0").over(col))).withColumn("v2", F.when(below, F.lead("v1").over(col)))
    t = t.where("v1 is not null and v2 is not null and v3 is not null").withColumn("lo", F.least("v0", "v1", "v2", "v3")).withColumn("hi", F.greatest("v0", "v1", "v2", "v3"))
    t = t.join(F.broadcast(levels.select("level", F.col("at").cast("double").alias("at"))), (F.col("lo") <= F.col("at")) & (F.col("hi") > F.col("at")))
    # sides: 0 above, 1 right, 2 below, 3 left; falls from one end to the next, clockwise: 1, rises: -1
    turn = lambda p, q: f"int(v{p} > at) - int(v{q} > at)"
    t = t.withColumn("s", F.expr(f"array({turn(0, 1)}, {turn(1, 2)}, {turn(2, 3)}, {turn(3, 0)})"))
    step = F.when(F.aggregate("s", F.lit(0), lambda n, v: n + F.abs(v)) < 4, F.lit(0)).when(F.expr("(v0 + v1 + v2 + v3) / 4 > at"), F.lit(1)).otherwise(F.lit(-1))
    t = t.withColumn("step", step).withColumn("d", F.expr("explode(filter(sequence(0, 3), i -> s[i] = 1))"))
    t = t.withColumn("u", F.expr("if(step = 0, filter(sequence(0, 3), i -> s[i] = -1)[0], pmod(d + step, 4))"))
    share = lambda p, q: f"(at - v{p}) / (v{q} - v{p})"
    side = lambda i, c: F.expr(f"case {i} when 0 then {('x + ' + share(0, 1)) if c == 'x' else 'double(y)'} when 1 then {'double(x + 1)' if c == 'x' else ('y + ' + share(1, 2))} when 2 then {('x + ' + share(3, 2)) if c == 'x' else 'double(y + 1)'} else {'double(x)' if c == 'x' else ('y + ' + share(0, 3))} end")
    name = lambda i: F.expr(f"(((level * 33554432L + y + int({i} = 2)) * 33554432L + x + int({i} = 1)) * 2 + {i} % 2)")
    block = F.expr("(level * 524288L + (y div 64)) * 524288L + x div 64")
    return t.select("level", name("d").alias("a"), name("u").alias("b"), block.alias("block"), side("d", "x").alias("x1"), side("d", "y").alias("y1"), side("u", "x").alias("x2"), side("u", "y").alias("y2"))


def traced(field: DataFrame, levels: DataFrame, value: str = "v") -> DataFrame:
    """level, chain, seq, closed, x1, y1, x2, y2: iso-lines in order along each ring or open line."""
    return chains(isolines(field, levels, value)).select("level", "chain", "seq", "closed", "x1", "y1", "x2", "y2")
