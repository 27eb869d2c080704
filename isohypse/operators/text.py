"""Fonts, text laid out straight or along paths, and labels where lines leave a frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What a font's file may leave out.
UNITS, ADVANCE, CAP_HEIGHT = 1000.0, 1000.0, 500.0
_POINT = "struct<x:double,y:double>"


def _attribute(element: Column, name: str) -> Column:
    return F.regexp_extract(element, rf'\s{name}="([^"]*)"', 1)


def _number(element: Column, name: str, otherwise: Column | float) -> Column:
    otherwise = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return F.coalesce(F.nullif(_attribute(element, name), F.lit("")).cast("double"), otherwise)


def _plain(text: Column) -> Column:
    for mark, char in (("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(mark), F.lit(char))
    code = F.conv(F.regexp_extract(text, "^&#x([0-9A-Fa-f]+);$", 1), 16, 10)
    point = F.decode(F.unhex(F.lpad(F.hex(code.cast("int")), 8, "0")), "UTF-32")
    return F.when(code != "", point).otherwise(text)


def glyphs(fonts: DataFrame) -> DataFrame:
    """font, char, advance, cap_height, parts of SVG fonts (font, xml): lengths as shares of the em, y downwards.

    parts: the polylines M x y L x y ... of a glyph's path. A glyph without an advance has the font's.
    """
    face = F.regexp_extract("xml", r"<font-face[^>]*>", 0)
    font = F.regexp_extract("xml", r"<font\s[^>]*>", 0)
    t = fonts.select("font", _number(face, "units-per-em", UNITS).alias("em"), _number(font, "horiz-adv-x", ADVANCE).alias("own"), _number(face, "cap-height", CAP_HEIGHT).alias("cap"), F.explode(F.regexp_extract_all("xml", F.lit(r"(<glyph\s[^>]*>)"), F.lit(1))).alias("g"))
    t = t.select("font", "em", "cap", _plain(_attribute(F.col("g"), "unicode")).alias("char"), _number(F.col("g"), "horiz-adv-x", F.col("own")).alias("advance"), _attribute(F.col("g"), "d").alias("d")).where("char <> ''")
    strokes = F.filter(F.split("d", "M"), lambda p: F.trim(p) != "")
    numbers = lambda p: F.transform(F.regexp_extract_all(p, F.lit(r"(-?[0-9.]+(?:[eE]-?[0-9]+)?)"), F.lit(1)), lambda v: v.cast("double"))
    points = lambda n: F.transform(F.sequence(F.lit(0), (F.size(n) / 2).cast("int") - 1), lambda i: F.struct((F.get(n, i * 2) / F.col("em")).alias("x"), (-F.get(n, i * 2 + 1) / F.col("em")).alias("y")))
    parts = F.transform(F.filter(F.transform(strokes, numbers), lambda n: F.size(n) >= 2), points)
    return t.select("font", "char", (F.col("advance") / F.col("em")).alias("advance"), (F.col("cap") / F.col("em")).alias("cap_height"), parts.cast(f"array<array<{_POINT}>>").alias("parts"))


def read_font(spark: SparkSession, path: str) -> DataFrame:
    """The glyphs of SVG font files."""
    return glyphs(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("font"), F.col("value").alias("xml")))


def laid_out(text: DataFrame, advances: DataFrame, size: float = 1.0) -> DataFrame:
    """`text`'s columns but label, pos, char, anchor, width, total: a row for each char of label that has a glyph (char, advance, more).

    With a column align, RIGHT reverses the text. A row of `text` is named by id.
    """
    right = F.col("align") == "RIGHT" if "align" in text.columns else F.lit(False)
    chars = text.withColumn("_t", F.when(right, F.reverse("label")).otherwise(F.col("label"))).select(*[c for c in text.columns if c != "label"], F.posexplode(F.split("_t", "")).alias("pos", "char"))
    found = chars.where("char <> ''").join(advances, "char").withColumn("width", F.col("advance") * size).drop("advance")
    w = Window.partitionBy("id").orderBy("pos")
    anchor = F.coalesce(F.sum("width").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return found.withColumn("anchor", anchor).withColumn("total", F.sum("width").over(Window.partitionBy("id")))


def vertices_at(paths: DataFrame, targets: DataFrame) -> DataFrame:
    """targets (id, at, more columns) with x, y: the vertex of the path (id, seq, x, y) whose arc length is nearest; ties to the first.

    Vertices and targets are sorted together along the path, so each target sees the vertex before and behind it only.
    """
    w = Window.partitionBy("id").orderBy("seq")
    step = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    run = paths.withColumn("_d", step).withColumn("at", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    more = [c for c in targets.columns if c not in ("id", "at")]
    both = run.select("id", "at", F.struct("at", "x", "y").alias("_v")).unionByName(targets.withColumn("_m", F.struct(*more) if more else F.struct(F.lit(1).alias("_"))), allowMissingColumns=True)
    along = Window.partitionBy("id").orderBy("at", F.col("_v").isNull())
    both = both.withColumn("_p", F.last("_v", True).over(along.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.first("_v", True).over(along.rowsBetween(0, Window.unboundedFollowing)))
    near = F.when(F.col("_n").isNull() | (F.col("at") - F.col("_p.at") <= F.col("_n.at") - F.col("at")), F.col("_p")).otherwise(F.col("_n"))
    return both.where("_v is null").withColumn("_q", F.coalesce(near, "_n")).where("_q is not null").select("id", "at", *more, F.col("_q.x").alias("x"), F.col("_q.y").alias("y"))


def along_paths(layout: DataFrame, paths: DataFrame) -> DataFrame:
    """id, pos, char, x, y, angle: where the glyphs of a layout (id, align, pos, char, anchor, width, total) stand on their path.

    A glyph stands at the vertex nearest to its beginning, turned towards the one nearest to its end. LEFT counts from
    the path's beginning, CENTER has the text in its middle, RIGHT counts from its end. A glyph whose two vertices
    are one place is left out, as where a path is too short. LEFT text is moved left by 0.3 of its first glyph.
    """
    w = Window.partitionBy("id").orderBy("seq")
    length = paths.withColumn("_d", F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))).groupBy("id").agg(F.sum("_d").alias("length"))
    t = layout.join(length, "id")
    begin, end = F.col("anchor"), F.col("anchor") + F.col("width")
    middle = F.col("length") / 2 - F.col("total") / 2
    start = F.when(F.col("align") == "LEFT", begin).when(F.col("align") == "CENTER", begin + middle).otherwise(F.col("length") - end)
    stop = F.when(F.col("align") == "LEFT", end).when(F.col("align") == "CENTER", end + middle).otherwise(F.col("length") - begin)
    shift = F.when(F.col("align") == "LEFT", F.first("width").over(Window.partitionBy("id").orderBy("pos")) * -0.3).otherwise(F.lit(0.0))
    t = t.withColumn("_shift", shift)
    targets = t.select("id", "pos", "char", "_shift", F.explode(F.array(F.struct(F.lit(0).alias("side"), start.alias("at")), F.struct(F.lit(1).alias("side"), stop.alias("at")))).alias("e")).select("id", "pos", "char", "_shift", "e.side", "e.at")
    ends = vertices_at(paths, targets).groupBy("id", "pos", "char", "_shift").agg(*[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}{s}") for s in (0, 1) for c in "xy"])
    ends = ends.where("x0 <> x1 or y0 <> y1")
    return ends.select("id", "pos", "char", (F.col("x0") + F.col("_shift")).alias("x"), F.col("y0").alias("y"), F.atan2(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")).alias("angle"))


def strokes(placed: DataFrame, advances: DataFrame, size: float = 1.0) -> DataFrame:
    """id, pos, part, i, x, y: the points of the strokes (char, parts) of glyphs placed at x, y, angle."""
    t = placed.join(advances.select("char", "parts"), "char").select("id", "pos", "x", "y", "angle", F.posexplode("parts").alias("part", "points"))
    t = t.select("id", "pos", "x", "y", "angle", "part", F.posexplode("points").alias("i", "p"))
    px, py = F.col("p.x") * size, F.col("p.y") * size
    return t.select("id", "pos", "part", "i", (F.col("x") + px * F.cos("angle") - py * F.sin("angle")).alias("x"), (F.col("y") + px * F.sin("angle") + py * F.cos("angle")).alias("y"))


def frame_crossings(paths: DataFrame, sides: list[tuple[int, str, float, float, float]]) -> DataFrame:
    """id, side, x, y: where paths (id, seq, x, y) cross a frame's sides (number, "x" or "y", its place, from, to).

    Sides are taken in the order of their numbers. A side that a path doesn't cross at just one point, and all
    sides behind it, have no row for that path. A path crosses where two neighbouring points are on different sides
    of the line, a point on it counting as before it.
    """
    w = Window.partitionBy("id").orderBy("seq")
    steps = paths.withColumn("nx", F.lead("x").over(w)).withColumn("ny", F.lead("y").over(w)).where("nx is not null and ny is not null")
    found = None
    for number, axis, place, low, high in sides:
        other = "y" if axis == "x" else "x"
        t = (F.lit(place) - F.col(axis)) / (F.col(f"n{axis}") - F.col(axis))
        at = F.col(other) + t * (F.col(f"n{other}") - F.col(other))
        one = steps.where((F.col(axis) <= place) != (F.col(f"n{axis}") <= place)).select("id", F.lit(number).alias("side"), F.lit(place).alias(axis), at.alias(other)).where(F.col(other).between(low, high))
        found = one if found is None else found.unionByName(one)
    order = [s[0] for s in sorted(sides)]
    single = found.groupBy("id", "side").agg(F.count("*").alias("n"), F.max("x").alias("x"), F.max("y").alias("y")).where("n = 1")
    before = F.row_number().over(Window.partitionBy("id").orderBy("side")) - 1
    place = F.element_at(F.array(*[F.lit(order.index(n)) if n in order else F.lit(-1) for n in range(max(order) + 1)]), F.col("side") + 1)
    return single.withColumn("_k", before).where(F.col("_k") == place).select("id", "side", "x", "y")
