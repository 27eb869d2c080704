"""Readers of the map formats, and the configuration merge."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def merge(base: dict, over: dict) -> dict:
    """`over` wins; maps on both sides merge."""
    return base | {k: merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def config(path: str, overlay: str | None = None) -> dict:
    with open(path, "rb") as f:
        base = tomllib.load(f)
    if not overlay:
        return base
    with open(overlay, "rb") as f:
        return merge(base, tomllib.load(f))


def cities(spark: SparkSession, path: str, least: int = 0) -> DataFrame:
    """label, population, lon, lat of a `;` file with a header."""
    schema = "ascii_name string, altname string, population long, lon double, lat double"
    rows = spark.read.option("sep", ";").option("header", True).schema(schema).csv(path)
    return rows.where(F.col("population") >= least).select(F.col("ascii_name").alias("label"), "population", "lon", "lat")


def labels(spark: SparkSession, path: str) -> DataFrame:
    """lat, lon, row, text of {"labels": [[[lat, lon], "text"], ...]}; a row for each line of a text."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "labels array<array<string>>")["labels"]).alias("e"))
    at = F.from_json(F.col("e")[0], "array<double>")
    return rows.select(at[0].alias("lat"), at[1].alias("lon"), F.posexplode(F.split(F.col("e")[1], "\n")).alias("row", "text"))


def svg_segments(spark: SparkSession, path: str) -> DataFrame:
    """`svg_shapes` of SVG files, file being a file's name."""
    return svg_shapes(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value"))


def svg_shapes(docs: DataFrame) -> DataFrame:
    """file, layer, path_no, kind, ring, part, x1, y1, x2, y2 of the shapes in SVG documents (file, value).

    layer: the id of the group that a shape stands in, null outside of groups; groups aren't nested. Shapes are rect (its
    four sides, as a closed ring), line, and path (M x y L x y ... [Z], several rings); path_no counts the shapes of a
    group. Other elements (circle, image) have no rows.
    """
    groups = docs.select("file", F.posexplode(F.split("value", "<g(?=[ >])")).alias("_g", "_t"))
    groups = groups.select("file", "_g", F.when((F.col("_g") > 0), F.nullif(F.regexp_extract("_t", r'^[^>]*\sid="([^"]*)"', 1), F.lit(""))).alias("layer"), F.split(F.col("_t"), "</g>").alias("_t"))
    # what follows a group's end stands outside of it
    groups = groups.select("file", "_g", F.posexplode("_t").alias("_after", "_t"), "layer").withColumn("layer", F.when(F.col("_after") == 0, F.col("layer")))
    shapes = groups.select("file", "layer", "_g", "_after", F.posexplode(F.regexp_extract_all("_t", F.lit(r"(<(?:rect|line|path)\s[^>]*>)"), F.lit(1))).alias("path_no", "e"))
    shapes = shapes.withColumn("kind", F.regexp_extract("e", r"^<(\w+)", 1))
    value = lambda n: F.regexp_extract("e", rf'\s{n}="(-?[0-9.eE+-]+)"', 1).cast("double")
    ends = F.concat(value("x1").cast("string"), F.lit(" "), value("y1").cast("string"), F.lit(" "), value("x2").cast("string"), F.lit(" "), value("y2").cast("string"))
    right, low = value("x") + value("width"), value("y") + value("height")
    corners = F.concat_ws(" ", *[v.cast("string") for v in (value("x"), value("y"), right, value("y"), right, low, value("x"), low)], F.lit("Z"))
    d = F.when(F.col("kind") == "rect", corners).when(F.col("kind") == "line", ends).otherwise(F.regexp_extract("e", r'\sd="([^"]*)"', 1))
    rings = shapes.withColumn("d", d).select("file", "layer", "path_no", "kind", F.posexplode(F.filter(F.split("d", "M"), lambda r: F.trim(r) != "")).alias("ring", "r"))
    numbers = F.transform(F.regexp_extract_all("r", F.lit(r"(-?[0-9.]+(?:[eE]-?[0-9]+)?)"), F.lit(1)), lambda s: s.cast("double"))
    rings = rings.withColumn("n", numbers).withColumn("n", F.when(F.upper("r").contains("Z"), F.concat("n", F.slice("n", 1, 2))).otherwise(F.col("n")))
    parts = rings.where("size(n) >= 4").withColumn("part", F.explode(F.expr("sequence(0, size(n) div 2 - 2)")))
    at = lambda k: F.expr(f"n[part * 2 + {k}]")
    return parts.select("file", "layer", "path_no", "kind", "ring", "part", at(0).alias("x1"), at(1).alias("y1"), at(2).alias("x2"), at(3).alias("y2"))


def gazetteer(spark: SparkSession, path: str, least: int = 100_000) -> DataFrame:
    """id, label, lat, lon, population of a gazetteer's tab-separated file of 19 unnamed columns, from `least` inhabitants on.

    By place: 1 the id, 2 the name, 5 and 6 latitude and longitude, 15 the population.
    """
    schema = ", ".join(f"c{i} string" for i in range(1, 20))
    rows = spark.read.option("sep", "\t").option("quote", "").schema(schema).csv(path)
    t = rows.select(F.col("c1").cast("long").alias("id"), F.col("c2").alias("label"), F.col("c5").cast("double").alias("lat"), F.col("c6").cast("double").alias("lon"), F.col("c15").cast("long").alias("population"))
    return t.where(F.col("population") >= least)


def override(target: object, values: dict) -> None:
    """Set the target's upper-case attributes of the values' names, upper-cased; unknown names are passed over."""
    for name, value in values.items():
        if hasattr(target, name.upper()):
            setattr(target, name.upper(), value)
