"""Level slicing and focal (moving-window) operators on rasters (y, x, z), one row a cell.

Frames are cut at the raster's edge. Windows run along rows and along columns, so a raster's
partitions are its rows and its columns; no operator needs the whole raster in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def level_bands(anchors: list[float], n: int) -> list[tuple[int, float, float]]:
    """(level, low, high): every interval between anchors in n / intervals bands of one height."""
    splits = len(anchors) - 1
    if splits < 1 or n % splits:
        raise ValueError(f"{n} bands can't be dealt evenly to {splits} intervals")
    each = n // splits
    return [(i * each + j, a + (b - a) / each * j, a + (b - a) / each * (j + 1)) for i, (a, b) in enumerate(zip(anchors, anchors[1:])) for j in range(each)]


def level_mask(z: Column, low: Column, high: Column, overlap: bool) -> Column:
    """Land bands (low <= high) take cells above low, sea bands those below low; disjoint ones end at high, included."""
    if overlap:
        return F.when(low <= high, z > low).otherwise(z < low)
    return F.when(low <= high, (z > low) & (z <= high)).otherwise((z >= high) & (z < low))


def slice_levels(cells: DataFrame, bands: list[tuple[int, float, float]], overlap: bool = False) -> DataFrame:
    """level, low, high with each cell in the band. The bands are a short list, so their table is broadcast."""
    table = cells.sparkSession.createDataFrame(bands, "level int, low double, high double")
    return cells.join(F.broadcast(table), level_mask(F.col("z"), F.col("low"), F.col("high"), overlap))


def _rows(k: int, along: str = "x") -> "Window":
    other = "y" if along == "x" else "x"
    return Window.partitionBy(other).orderBy(along).rangeBetween(-(k // 2), k // 2)


def focal(cells: DataFrame, function, column: str, k: int, out: str) -> DataFrame:
    """A separable aggregate (sum, min, max) over k by k cells."""
    return cells.withColumn("_row", function(column).over(_rows(k, "x"))).withColumn(out, function("_row").over(_rows(k, "y"))).drop("_row")


def box_mean(cells: DataFrame, k: int, out: str = "mean", column: str = "z") -> DataFrame:
    both = focal(focal(cells.withColumn("_one", F.lit(1.0)), F.sum, column, k, "_sum"), F.sum, "_one", k, "_n")
    return both.withColumn(out, F.col("_sum") / F.col("_n")).drop("_one", "_sum", "_n")


def gradient(cells: DataFrame, column: str = "z") -> DataFrame:
    """dx, dy, angle, magnitude: central differences, one-sided at the edges."""
    def along(axis: str) -> Column:
        w = Window.partitionBy("y" if axis == "x" else "x").orderBy(axis)
        before, after, own = F.lag(column).over(w), F.lead(column).over(w), F.col(column)
        return F.coalesce((after - before) / 2, after - own, own - before, F.lit(0.0))

    out = cells.withColumn("dx", along("x")).withColumn("dy", along("y"))
    return out.withColumn("angle", F.atan2("dy", "dx")).withColumn("magnitude", F.hypot("dy", "dx"))


def laplacian(cells: DataFrame, column: str = "z") -> DataFrame:
    """Sum of the four neighbours less four times the cell; outside neighbours count as the cell."""
    out = F.lit(0.0)
    for axis in "xy":
        w = Window.partitionBy("y" if axis == "x" else "x").orderBy(axis)
        out = out + F.coalesce(F.lag(column).over(w), F.col(column)) + F.coalesce(F.lead(column).over(w), F.col(column))
    return cells.withColumn("laplacian", out - 4 * F.col(column))


def with_extent(cells: DataFrame, column: str = "z") -> DataFrame:
    """lo, hi: the raster's least and largest value beside each cell; one row is broadcast."""
    return cells.crossJoin(F.broadcast(cells.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))))


def normalize(cells: DataFrame, column: str = "z", out: str = "byte") -> DataFrame:
    """0 to 255 by the raster's extent, cut to whole numbers; 0 if all cells are equal."""
    value = F.coalesce(F.floor(255 * (F.col(column) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))), F.lit(0))
    return with_extent(cells, column).withColumn(out, value.cast("int")).drop("lo", "hi")


def local_variance(cells: DataFrame, k: int = 7, column: str = "z", most: float = 40000.0) -> DataFrame:
    """Variance of k by k cells, clipped to 0..most."""
    both = box_mean(box_mean(cells, k, "_m", column).withColumn("_q", F.col(column) * F.col(column)), k, "_mq", "_q")
    return both.withColumn("variance", F.greatest(F.lit(0.0), F.least(F.lit(most), F.col("_mq") - F.col("_m") * F.col("_m")))).drop("_m", "_q", "_mq")


def position_index(cells: DataFrame, k: int = 5, column: str = "z", unit: float = 1e6) -> DataFrame:
    """tpi: the cell less the mean of its window without it; 0 where the window is the cell alone.

    Heights are summed as whole numbers of 1 / unit, so the result doesn't depend on the order of the sum.
    """
    whole = cells.withColumn("_one", F.lit(1).cast("long")).withColumn("_z", F.round(F.col(column) * unit).cast("long"))
    both = focal(focal(whole, F.sum, "_z", k, "_sum"), F.sum, "_one", k, "_n")
    above = (F.col("_z") * F.col("_n") - F.col("_sum")) / (F.nullif(F.col("_n") - 1, F.lit(0)) * F.lit(unit))
    return both.withColumn("tpi", F.coalesce(above, F.lit(0.0)) + F.lit(0.0)).drop("_one", "_z", "_sum", "_n")


def adaptive_smooth(cells: DataFrame, near: int = 3, far: int = 7, k: int = 5) -> DataFrame:
    """smooth: the near and far blurs, blended by the size of the position index against its largest; whole numbers."""
    out = box_mean(box_mean(position_index(cells, k), far, "_far"), near, "_near")
    top = out.agg(F.nullif(F.abs(F.max("tpi")), F.lit(0.0)).alias("top"))
    w = F.coalesce(F.abs("tpi") / F.col("top"), F.lit(0.0))
    cut = lambda c: F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("double")
    return out.crossJoin(F.broadcast(top)).withColumn("smooth", cut(w * cut(F.col("_far")) + (1 - w) * cut(F.col("_near"))).cast("int")).drop("_far", "_near", "top")


def open_close(mask: DataFrame, k: int = 3, column: str = "m") -> DataFrame:
    """Morphological opening, then closing, by a k by k square."""
    out = focal(focal(mask, F.min, column, k, "_a"), F.max, "_a", k, "_b")
    return focal(focal(out, F.max, "_b", k, "_c"), F.min, "_c", k, "clean").drop("_a", "_b", "_c")


def decimate(cells: DataFrame, factor: int) -> DataFrame:
    """Means of factor by factor cells."""
    return cells.groupBy(F.floor(F.col("y") / factor).cast("int").alias("y"), F.floor(F.col("x") / factor).cast("int").alias("x")).agg(F.avg("z").alias("z"))


def mosaic(tiles: DataFrame) -> DataFrame:
    """Cells of overlapping tiles (tile, y, x, z): the tile of the least number wins."""
    return tiles.groupBy("y", "x").agg(F.min_by("z", "tile").alias("z"))


def encode_angle(angle: Column) -> Column:
    return F.floor((angle + F.lit(3.141592653589793)) / F.lit(6.283185307179586) * 255).cast("int")


def decode_angle(code: Column) -> Column:
    return code / 255 * F.lit(6.283185307179586) - F.lit(3.141592653589793)


def flat_mask(magnitude: Column, least: float) -> Column:
    return F.when(magnitude < least, 255).otherwise(0)


def highest_level(cells: DataFrame, bands: list[tuple[int, float, float]]) -> DataFrame:
    """Each cell in the highest of the overlapping bands that hold it: what is left of each after all higher ones."""
    return slice_levels(cells, bands, overlap=True).groupBy("y", "x").agg(F.max("level").alias("level"))


def checkpoints(spark) -> None:
    """Use the folder of spark.checkpoint.dir. Where that is unset: the warehouse, which executors share, or with a local
    master, as in tests, a temporary folder."""
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        import tempfile

        local = spark.sparkContext.master.split("[")[0] == "local"
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="isohypse-") if local else spark.conf.get("spark.sql.warehouse.dir"))


def region_labels(mask: DataFrame, eight: bool = True) -> DataFrame:
    """y, x, region: connected cells (y, x), named by their least cell y * 2^32 + x.

    Least labels spread to neighbours round by round and jump along what the label itself has found, so
    rounds grow with the logarithm of a region's breadth; each is cut by a written checkpoint.
    """
    checkpoints(mask.sparkSession)
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (eight or not (a and b))]
    key = lambda y, x: y.cast("long") * 4294967296 + x
    now = mask.select("y", "x", key(F.col("y"), F.col("x")).alias("id")).withColumn("region", F.col("id")).checkpoint()
    moves = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps])
    while True:
        sent = now.select(F.explode(moves).alias("m"), "y", "x", "region").select(key(F.col("y") + F.col("m.a"), F.col("x") + F.col("m.b")).alias("id"), "region")
        least = sent.groupBy("id").agg(F.min("region").alias("seen"))
        spread = now.join(least, "id", "left").withColumn("near", F.least("region", F.coalesce("seen", "region")))
        jump = spread.groupBy("region").agg(F.min("near").alias("root"))
        step = spread.join(jump, "region").withColumn("next", F.least("near", "root"))
        up = step.select(F.col("id").alias("next"), F.col("next").alias("above"))
        after = step.join(up, "next", "left").select("y", "x", "id", F.least("next", F.coalesce("above", "next")).alias("region"), (F.col("next") < F.col("region")).alias("moved")).checkpoint()
        if after.where("moved").isEmpty():
            return after.select("y", "x", "region")
        now = after.drop("moved")


def rectangle(cells: DataFrame) -> DataFrame:
    """y, x of all cells of the rectangle about the given ones, made row by row in as many tasks as Spark deals them to."""
    y0, y1, x0, x1 = cells.agg(F.min("y"), F.max("y"), F.min("x"), F.max("x")).first()
    spark = cells.sparkSession
    if y0 is None:
        return spark.createDataFrame([], "y int, x int")
    return spark.range(y0, y1 + 1).select(F.col("id").cast("int").alias("y"), F.explode(F.sequence(F.lit(int(x0)).cast("int"), F.lit(int(x1)).cast("int"))).alias("x"))


#: Sides of a cell, clockwise (y down): the way along it, and the side it faces.
WAYS, FACES = [(0, 1), (1, 0), (0, -1), (-1, 0)], [(-1, 0), (0, 1), (1, 0), (0, -1)]
#: Cells of a square block along whose boundaries sides are chained in one task.
RING_BLOCK = 256


def boundary_sides(mask: DataFrame) -> DataFrame:
    """a, b, block, y, x, side, turns: the sides of the cells (y, x) that face none, each with the side that follows clockwise.

    Cells that touch at a corner are neighbours, so a ring goes on along the cell that it faces. a and b name the
    sides; turns: whether the way changes behind this one.
    """
    around = [(p, q) for p in (-1, 0, 1) for q in (-1, 0, 1) if p or q]
    bit = {d: 1 << i for i, d in enumerate(around)}
    moves = F.array(*[F.struct(F.lit(-p).alias("p"), F.lit(-q).alias("q"), F.lit(bit[p, q]).alias("bit")) for p, q in around])
    cells = mask.select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))
    seen = cells.select("y", "x", F.explode(moves).alias("m")).select((F.col("y") + F.col("m.p")).alias("y"), (F.col("x") + F.col("m.q")).alias("x"), "m.bit")
    seen = seen.groupBy("y", "x").agg(F.bit_or("bit").alias("bits"))
    have = lambda d: F.col("bits").bitwiseAND(bit[d]) != 0
    name = lambda y, x, s: ((F.col("y") + y) * 1073741824 + F.col("x") + x) * 4 + s
    sides = []
    for s, ((wy, wx), (fy, fx)) in enumerate(zip(WAYS, FACES)):
        left, ahead = have((wy + fy, wx + fx)), have((wy, wx))
        after = F.when(left, name(wy + fy, wx + fx, (s + 3) % 4)).when(ahead, name(wy, wx, s)).otherwise(name(0, 0, (s + 1) % 4))
        sides.append(F.when(~have((fy, fx)), F.struct(name(0, 0, s).alias("a"), after.alias("b"), F.lit(s).alias("side"), (left | ~ahead).alias("turns"))))
    found = cells.join(seen, ["y", "x"], "left").withColumn("bits", F.coalesce("bits", F.lit(0))).withColumn("e", F.explode(F.array_compact(F.array(*sides))))
    return found.select("e.a", "e.b", F.expr(f"(y div {RING_BLOCK}) * 4194304L + x div {RING_BLOCK}").alias("block"), "y", "x", "e.side", "e.turns")


def region_rings(mask: DataFrame) -> DataFrame:
    """ring, y, x, side, seq, corner_y, corner_x: the boundary sides of the cells (y, x), ring by ring, clockwise about the cells.

    The corner is where the side ends, and null where the ring goes straight on. Cell (y, x) is the square up to (y + 1, x + 1).
    """
    from .chains import chains

    ends = [(0, 1), (1, 1), (1, 0), (0, 0)]  # of each side
    at = lambda i: F.element_at(F.array(*[F.lit(e[i]) for e in ends]), F.col("side") + 1)
    out = chains(boundary_sides(mask)).withColumnRenamed("chain", "ring")
    return out.select("ring", "y", "x", "side", "seq", F.when(F.col("turns"), F.col("y") + at(0)).alias("corner_y"), F.when(F.col("turns"), F.col("x") + at(1)).alias("corner_x"))


def region_polygons(mask: DataFrame, cells: DataFrame) -> DataFrame:
    """`level_polygons` of one mask (y, x), without level."""
    return level_polygons(mask.select(F.lit(0).alias("level"), "y", "x"), cells).drop("level")


def level_polygons(mask: DataFrame, cells: DataFrame) -> DataFrame:
    """level, region, n_cells, ymin, ymax, xmin, xmax, ring, holes (hole, n_cells, ring): polygons of each level's cells (level, y, x).

    Regions are 8-connected, what a level leaves of the rectangle about `cells` is 4-connected; its parts that
    touch no edge of the rectangle are holes, of the region above their topmost cell. Rings are corners (y, x), cell
    (y, x) being the square up to (y + 1, x + 1). Levels are whole numbers from 0; they are laid below each other, two rows
    apart, so that all are labelled and traced in the same rounds. `cells` has whole coordinates of which few are negative.
    """
    spark = mask.sparkSession
    y0, y1, x0, x1 = cells.agg(F.min("y"), F.max("y"), F.min("x"), F.max("x")).first()
    kind = "level int, region long, n_cells long, ymin int, ymax int, xmin int, xmax int, ring array<struct<y:int,x:int>>, holes array<struct<hole:bigint,n_cells:bigint,ring:array<struct<y:int,x:int>>>>"
    if y0 is None:
        return spark.createDataFrame([], kind)
    page = y1 - y0 + 3
    down = F.col("level") * F.lit(page).cast("long")
    land = mask.select("level", "y", "x").distinct().select((F.col("y") + down).alias("y"), "x")
    grid = rectangle(cells).crossJoin(F.broadcast(mask.select("level").distinct())).select((F.col("y") + down).alias("y"), "x")
    level = F.expr(f"(y - {y0}) div {page}")
    regions = region_labels(land)
    rest = region_labels(grid.join(land, ["y", "x"], "left_anti"), eight=False)
    box = [f(c).alias(f"{c}{n}") for c in "yx" for f, n in ((F.min, "min"), (F.max, "max"))]
    own = (F.col("y") - F.col("level") * page).alias("y")
    holes = rest.withColumn("level", level).select("region", "level", own, "x").groupBy(F.col("region").alias("hole"), "level").agg(F.count("*").alias("hole_cells"), F.min(F.struct("y", "x")).alias("top"), *box)
    holes = holes.where(f"ymin > {y0} and ymax < {y1} and xmin > {x0} and xmax < {x1}").select("hole", "hole_cells", (F.expr("top.y") - 1 + down).alias("y"), F.col("top.x").alias("x"))
    holes = holes.join(regions, ["y", "x"]).select("hole", "hole_cells", F.col("region").alias("parent"))
    # a ring belongs to the region of its cells, and to the hole that its first side faces
    sides = region_rings(land)
    face = lambda i: F.element_at(F.array(*[F.lit(f[i]) for f in FACES]), F.col("side") + 1)
    first = sides.where("seq = 0").select("ring", "y", "x", (F.col("y") + face(0)).alias("fy"), (F.col("x") + face(1)).alias("fx"))
    of = first.join(regions, ["y", "x"]).join(rest.select(F.col("y").alias("fy"), F.col("x").alias("fx"), F.col("region").alias("hole")), ["fy", "fx"], "left")
    of = of.join(holes, (of.hole == holes.hole) & (of.region == holes.parent), "left").select("ring", "region", holes.hole, "hole_cells")
    corners = sides.where("corner_y is not null").withColumn("level", level)
    corner = F.struct("seq", (F.col("corner_y") - F.col("level") * page).cast("int").alias("y"), F.col("corner_x").cast("int").alias("x"))
    rings = corners.groupBy("ring").agg(F.sort_array(F.collect_list(corner)).alias("c")).select("ring", F.expr("transform(c, p -> struct(p.y as y, p.x as x))").alias("points"))
    rings = of.join(rings, "ring")
    inner = rings.where("hole is not null").groupBy("region").agg(F.array_sort(F.collect_list(F.struct("hole", F.col("hole_cells").alias("n_cells"), F.col("points").alias("ring")))).alias("holes"))
    out = regions.withColumn("level", level).select("region", "level", own, "x").groupBy("region", "level").agg(F.count("*").alias("n_cells"), *box)
    out = out.join(rings.where("hole is null").select("region", F.col("points").alias("ring")), "region").join(inner, "region", "left")
    none = F.array().cast("array<struct<hole:bigint,n_cells:bigint,ring:array<struct<y:int,x:int>>>>")
    return out.select(F.col("level").cast("int").alias("level"), "region", "n_cells", *[F.col(c).cast("int").alias(c) for c in ("ymin", "ymax", "xmin", "xmax")], "ring", F.coalesce("holes", none).alias("holes"))


def bilinear(cells: DataFrame, height: int, width: int) -> DataFrame:
    """y, x, z of the raster at height by width cells, pixel centres aligned; beyond the outer centres the edge's values hold.

    Each new cell lies in one square of four old ones, so it is joined once; it is null where one of them that counts is
    missing. The raster has at least two rows and columns.
    """
    y0, y1, x0, x1 = cells.agg(F.min("y"), F.max("y"), F.min("x"), F.max("x")).first()
    spark = cells.sparkSession
    if y0 is None:
        return spark.createDataFrame([], "y int, x int, z double")
    row, col = Window.partitionBy("y").orderBy("x"), Window.partitionBy("x").orderBy("y")
    square = rectangle(cells).join(cells.select("y", "x", "z"), ["y", "x"], "left").withColumn("right", F.lead("z").over(row))
    square = square.withColumn("low", F.lead("z").over(col)).withColumn("cross", F.lead("right").over(col)).where((F.col("y") < y1) & (F.col("x") < x1))

    def at(i: Column, n: int, low: int, high: int) -> tuple[Column, Column]:
        place = F.least(F.greatest((i + 0.5) * F.lit((high - low + 1) / n) - 0.5, F.lit(0.0)), F.lit(float(high - low)))
        first = F.least(F.floor(place), F.lit(high - low - 1))
        return (first + low).cast("int"), place - first

    new = spark.range(height).select(F.col("id").cast("int").alias("_y"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("_x"))
    (y, v), (x, u) = at(F.col("_y"), height, y0, y1), at(F.col("_x"), width, x0, x1)
    found = new.select("_y", "_x", y.alias("y"), x.alias("x"), v.alias("v"), u.alias("u")).join(square, ["y", "x"])
    part = lambda w, c: F.when(w == 0, F.lit(0.0)).otherwise(w * F.col(c))
    u, v = F.col("u"), F.col("v")
    z = part((1 - v) * (1 - u), "z") + part((1 - v) * u, "right") + part(v * (1 - u), "low") + part(v * u, "cross")
    return found.select(F.col("_y").alias("y"), F.col("_x").alias("x"), z.alias("z"))


def transpose(cells: DataFrame) -> DataFrame:
    """Rows as columns; further columns stay."""
    return cells.select(F.col("x").alias("y"), F.col("y").alias("x"), *[c for c in cells.columns if c not in ("y", "x")])


def pad_edge(cells: DataFrame, by: int) -> DataFrame:
    """y, x, z of the rectangle about the cells, widened by `by` on all sides; new cells have the nearest old one's value."""
    y0, y1, x0, x1 = cells.agg(F.min("y"), F.max("y"), F.min("x"), F.max("x")).first()
    if y0 is None:
        return cells.select("y", "x", "z")
    reach = lambda c, low, high: F.explode(F.when(F.col(c) == low, F.sequence(F.lit(low - by), F.lit(low if low < high else high + by))).when(F.col(c) == high, F.sequence(F.lit(high), F.lit(high + by))).otherwise(F.array(F.col(c))))
    return cells.withColumn("_y", reach("y", y0, y1)).withColumn("_x", reach("x", x0, x1)).select(F.col("_y").alias("y"), F.col("_x").alias("x"), "z")


def whole_tiles(cells: DataFrame, tile: int, least: int = 3) -> DataFrame:
    """tile_y, tile_x, rows, columns, n of the tiles of tile by tile cells that are at least `least` wide and high."""
    key = [F.floor(F.col(c) / tile).cast("int").alias(f"tile_{c}") for c in "yx"]
    size = lambda c, n: (F.max(c) - F.min(c) + 1).cast("int").alias(n)
    return cells.groupBy(*key).agg(size("y", "rows"), size("x", "columns"), F.count("*").alias("n")).where(F.least("rows", "columns") >= least)
