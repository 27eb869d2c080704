"""Layer fold against exclusion zones, SVG and G-code text, and writing stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.polygons import CELL, box_cells
from ..operators.segments import drawn_order, filed, pen_lifts


def fold_zones(points: DataFrame, zones: DataFrame, cell: float = CELL) -> DataFrame:
    """Points (layer_rank, x, y, ...) outside the zones (zone_rank, xmin, ymin, xmax, ymax) of layers drawn before them.

    A zone meets points through the cells that it touches. `polygons.subtract_zones` does the same to lines.
    """
    inside = (F.col("x") >= F.col("xmin")) & (F.col("x") <= F.col("xmax")) & (F.col("y") >= F.col("ymin")) & (F.col("y") <= F.col("ymax"))
    at = points.withColumn("row", F.floor(F.col("y") / cell)).withColumn("col", F.floor(F.col("x") / cell)).alias("at")
    near = box_cells(zones, cell).alias("near")
    same = (F.col("at.row") == F.col("near.row")) & (F.col("at.col") == F.col("near.col"))
    return at.join(near, same & inside & (F.col("zone_rank") < F.col("layer_rank")), "left_anti").drop("row", "col")


def svg_lines(segments: DataFrame) -> DataFrame:
    """layer, seq, d: a path of two decimals for each segment."""
    return segments.select("layer", "seq", F.format_string("M%.2f %.2f L%.2f %.2f", "x1", "y1", "x2", "y2").alias("d"))


#: Sections of a document's layer: its beginning, shapes, end.
OPEN, SHAPE, CLOSE = 0, 1, 2


def svg_document(shapes: DataFrame, width: float, height: float, styles: dict[str, str] | None = None) -> DataFrame:
    """place, section, seq, line: an SVG document of shapes (place, layer, seq, d), a line a row, in the order of the first three.

    place puts the layers in order, a group for each; `styles` has the rules of a layer's class. Shapes without path
    data (null or empty) are left out, and so is a layer of only such shapes. The document's head has place -1, its foot the
    greatest long.
    """
    shapes = shapes.where("d is not null and d <> ''").select(F.col("place").cast("long").alias("place"), "layer", F.col("seq").cast("long").alias("seq"), "d")
    rules = " ".join(f".{k} {{ {v} }}" for k, v in (styles or {}).items())
    head = f'<?xml version="1.0" encoding="utf-8"?>\n<svg xmlns="http://www.w3.org/2000/svg" width="{width:g}mm" height="{height:g}mm" viewBox="0 0 {width:g} {height:g}">\n<style>{rules}</style>'
    layers = shapes.select("place", "layer").distinct()
    name = F.replace(F.replace(F.replace(F.col("layer"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    row = lambda place, section, seq, line: [place.cast("long").alias("place"), F.lit(section).alias("section"), seq.cast("long").alias("seq"), line.alias("line")]
    zero = F.lit(0)
    out = shapes.select(*row(F.col("place"), SHAPE, F.col("seq"), F.concat(F.lit('<path d="'), "d", F.lit('"/>'))))
    out = out.unionByName(layers.select(*row(F.col("place"), OPEN, zero, F.concat(F.lit('<g id="'), name, F.lit('" class="'), name, F.lit('">')))))
    out = out.unionByName(layers.select(*row(F.col("place"), CLOSE, zero, F.lit("</g>"))))
    ends = shapes.sparkSession.createDataFrame([(-1, OPEN, 0, head), (2**63 - 1, CLOSE, 0, "</svg>")], "place long, section int, seq long, line string")
    return out.unionByName(ends)


def write_svg(document: DataFrame, path: str) -> None:
    """The document as text files whose names' order is the lines' order; put together, they are one SVG file."""
    keys = ["place", "section", "seq"]
    document.repartitionByRange(*keys).sortWithinPartitions(*keys).select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def gcode(segments: DataFrame, most: float = 5000.0, dip: float | None = 120.0) -> DataFrame:
    """layer, seq, file, lines: each segment's commands in the order drawn; a travel first where the pen is up.

    Order, split into files, lifts, dips, text. seq is the segment's place in its layer's greedy order. A
    file begins and ends with the pen up. Dips come behind the segment that passes `dip`; None: no dips.
    Fixed commands and speeds: travel F6000, write F3000, lift F5000; a dip goes up to Z7, to (0, -20),
    down to Z2 (F500) and up.
    """
    drawn = filed(drawn_order(segments).select("layer", F.col("place").alias("seq"), "x1", "y1", "x2", "y2"), most, dip)
    w = Window.partitionBy("layer", "file").orderBy("seq")
    lifted = pen_lifts(drawn, by=("layer", "file")).withColumn("up", F.coalesce(F.lag(F.col("lift") | F.col("dip")).over(w), F.lit(True)))
    move = F.format_string("G1 X%.3f Y%.3f", "x1", "y1")
    draw = F.format_string("G1 X%.3f Y%.3f", "x2", "y2")
    down = F.when(F.col("up"), F.concat_ws("\n", F.lit("G1 F6000"), move, F.lit("G1 Z0 F5000"), F.lit("G1 F3000")))
    dipped = F.when(F.col("dip"), F.lit("G1 Z7 F5000\nG1 F6000\nG1 X0.000 Y-20.000\nG1 Z2 F500\nG1 Z7 F5000\nG1 F6000"))
    return lifted.select("layer", "seq", F.concat_ws("\n", down, draw, F.when(F.col("lift"), F.lit("G1 Z7 F5000")), dipped).alias("lines"), "file")


def write_gcode(commands: DataFrame, path: str) -> None:
    """A folder for each layer and file, its lines in order in one file."""
    ordered = commands.repartition("layer", "file").sortWithinPartitions("layer", "file", "seq")
    ordered.select("layer", "file", F.col("lines").alias("value")).write.mode("overwrite").partitionBy("layer", "file").text(path)


def overwrite_stage(df: DataFrame, path: str) -> bool:
    """Replace a stage's table; an empty one leaves the old in place. Whether it wrote."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").parquet(path)
    return True
