"""The registered queries of the map engine, and DuckDB's SQL for them."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry as geo
from .operators import lines, places, raster, segments
from .plans import output
from .sources import relations as rel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

ANCHORS = ([0.0, 100.0, 400.0, 1300.0], 3), ([0.0, -150.0, -1300.0], 4)
BANDS = [(i, low, high) for i, (_, low, high) in enumerate(b for anchors, n in ANCHORS for b in raster.level_bands(anchors, n))]
_BANDS_SQL = "bands(level, low, high) as (values " + ", ".join(f"({i}, {a!r}e0, {b!r}e0)" for i, a, b in BANDS) + ")"


def query(sql: str | None = None, *needs: str):
    """Register a function under its name; `needs`: relations that the SQL reads."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            head = ", ".join([*(rel.SQL[n] for n in needs if n in rel.SQL), *(n for n in needs if n not in rel.SQL)])
            ORACLE_SQL[f.__name__] = f"with {head} {sql}" if head else sql
        return f

    return put


def _round(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Rounded, and without negative zeros."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


def _r(e: str, digits: int = 4) -> str:
    return f"round({e}, {digits}) + 0e0"


# ---- levels


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g01_p05_level_slices(spark, sf_dir)


@query("select level, cast(count(*) as bigint) n_cells, min(z) lowest, max(z) highest from cells join bands on case when low <= high then z > low and z <= high else z >= high and z < low end group by level", "cells", _BANDS_SQL)
def g01_p05_level_slices(spark, d):
    return raster.slice_levels(rel.cells(spark, d), BANDS).groupBy("level").agg(F.count("*").alias("n_cells"), F.min("z").alias("lowest"), F.max("z").alias("highest"))


@query("select level, cast(count(*) as bigint) n_cells from cells join bands on case when low <= high then z > low else z < low end group by level", "cells", _BANDS_SQL)
def p05_overlapping_levels(spark, d):
    return raster.slice_levels(rel.cells(spark, d), BANDS, overlap=True).groupBy("level").agg(F.count("*").alias("n_cells"))


@query("select y, x, max(level) as level from cells join bands on case when low <= high then z > low else z < low end group by y, x", "cells", _BANDS_SQL)
def w12_highest_level(spark, d):
    return raster.highest_level(rel.cells(spark, d), BANDS)


# ---- focal


@query("""select y, x, round(coalesce((lead(z) over r - lag(z) over r) / 2, lead(z) over r - z, z - lag(z) over r, 0e0), 4) + 0e0 dx,
 round(coalesce((lead(z) over c - lag(z) over c) / 2, lead(z) over c - z, z - lag(z) over c, 0e0), 4) + 0e0 dy from cells window r as (partition by y order by x), c as (partition by x order by y)""", "cells")
def w01_gradient(spark, d):
    return _round(raster.gradient(rel.cells(spark, d)).select("y", "x", "dx", "dy"), 4, "dx", "dy")


def _box(k: int, value: str = "z", out: str = "s") -> str:
    h = k // 2
    return f"select y, x, z, sum(rs) over (partition by x order by y range between {h} preceding and {h} following) {out}, sum(rn) over (partition by x order by y range between {h} preceding and {h} following) n from (select y, x, z, sum({value}) over (partition by y order by x range between {h} preceding and {h} following) rs, count(*) over (partition by y order by x range between {h} preceding and {h} following) rn from cells)"


@query(f"select y, x, {_r('s / n')} mean from ({_box(5)})", "cells")
def w02_box_blur(spark, d):
    return _round(raster.box_mean(rel.cells(spark, d), 5).select("y", "x", "mean"), 4, "mean")


@query(f"select a.y, a.x, round(greatest(0e0, least(40000e0, b.s / b.n - (a.s / a.n) * (a.s / a.n))), 2) + 0e0 variance from ({_box(7)}) a join ({_box(7, 'z * z')}) b using (y, x)", "cells")
def w03_local_variance(spark, d):
    return _round(raster.local_variance(rel.cells(spark, d)).select("y", "x", "variance"), 2, "variance")


@query(f"select y, x, coalesce((cast(round(z * 1e6) as bigint) * n - cast(s as bigint)) / (nullif(n - 1, 0) * 1e6), 0e0) + 0e0 tpi from ({_box(5, 'cast(round(z * 1e6) as bigint)')})", "cells")
def w04_position_index(spark, d):
    return raster.position_index(rel.cells(spark, d)).select("y", "x", "tpi")


@query()
def w05_adaptive_smoothing(spark, d):
    return raster.adaptive_smooth(rel.cells(spark, d)).select("y", "x", "smooth")


def _extreme(source: str, f: str, column: str, out: str) -> str:
    return f"select y, x, {f}(r) over (partition by x order by y range between 1 preceding and 1 following) {out} from (select y, x, {f}({column}) over (partition by y order by x range between 1 preceding and 1 following) r from ({source}))"


@query(f"select y, x, clean from ({_extreme(_extreme(_extreme(_extreme('select y, x, case when z > 0 then 1 else 0 end m from cells', 'min', 'm', 'a'), 'max', 'a', 'b'), 'max', 'b', 'c'), 'min', 'c', 'clean')})", "cells")
def w06_open_close(spark, d):
    return raster.open_close(rel.cells(spark, d).withColumn("m", F.when(F.col("z") > 0, 1).otherwise(0))).select("y", "x", "clean")


@query("select y, x, round(coalesce(lag(z) over r, z) + coalesce(lead(z) over r, z) + coalesce(lag(z) over c, z) + coalesce(lead(z) over c, z) - 4 * z, 4) + 0e0 laplacian from cells window r as (partition by y order by x), c as (partition by x order by y)", "cells")
def w14_laplacian(spark, d):
    return _round(raster.laplacian(rel.cells(spark, d)).select("y", "x", "laplacian"), 4, "laplacian")


@query("select y, x, cast(floor(255 * (z - lo) / (hi - lo)) as int) byte from cells, (select min(z) lo, max(z) hi from cells)", "cells")
def a03_normalize(spark, d):
    return raster.normalize(rel.cells(spark, d)).select("y", "x", "byte")


@query("select y, x, cast(floor((atan2(v, u) + pi()) / (2 * pi()) * 255) as int) code, case when sqrt(u * u + v * v) < 40 then 255 else 0 end flat, round(greatest(0e0, least(100e0, u)), 4) clipped, round(least(v, 50e0), 4) + 0e0 clamped from uv", "uv")
def f35_p07_p08_p09_field_codes(spark, d):
    t = rel.uv(spark, d)
    return t.select("y", "x", raster.encode_angle(F.atan2("v", "u")).alias("code"), raster.flat_mask(F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v")), 40).alias("flat"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), "u")), 4).alias("clipped"), (F.round(F.least("v", F.lit(50.0)), 4) + 0.0).alias("clamped"))


@query("select cast(floor(y / 2e0) as int) y, cast(floor(x / 2e0) as int) x, round(avg(z), 4) + 0e0 z from cells group by 1, 2", "cells")
def s04_decimate(spark, d):
    return _round(raster.decimate(rel.cells(spark, d), 2), 4, "z")


@query("select y, x, min_by(z, tile) z from (select y, x, z, 1 tile from cells where x < 40 union all select y, x, z + 1, 0 tile from cells where x >= 30) group by y, x", "cells")
def a11_mosaic(spark, d):
    c = rel.cells(spark, d)
    return raster.mosaic(c.where("x < 40").withColumn("tile", F.lit(1)).unionByName(c.where("x >= 30").withColumn("z", F.col("z") + 1).withColumn("tile", F.lit(0))))


@query("select c.y, c.x, cast(floor((z + u) / 2) as bigint) mean from cells c join uv using (y, x)", "cells", "uv")
def a14_blend(spark, d):
    return rel.cells(spark, d).join(rel.uv(spark, d), ["y", "x"]).select("y", "x", F.floor((F.col("z") + F.col("u")) / 2).alias("mean"))


# ---- segments


@query("select distinct layer, x1, y1, x2, y2 from segments", "segments")
def a09_u05_distinct_segments(spark, d):
    return segments.distinct_segments(rel.segments(spark, d))


@query("select layer, cast(count(*) as bigint) n from segments group by layer", "segments")
def a15_layer_counts(spark, d):
    return rel.segments(spark, d).groupBy("layer").agg(F.count("*").alias("n"))


@query("select layer, seq, x1, y1, x2, y2 from segments order by layer, x1, y1, x2, y2, seq limit 100", "segments")
def o02_o05_first_segments(spark, d):
    return rel.segments(spark, d).orderBy("layer", "x1", "y1", "x2", "y2", "seq").limit(100)


@query("""select layer, seq from (select *, lag(seq) over w is null or lead(seq) over w is null as e, lag(x2) over w = x1 and lag(y2) over w = y1 and lead(x1) over w = x2 and lead(y1) over w = y2 as j
 from segments window w as (partition by layer order by seq)) where sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) >= 9 or e or coalesce(j, false)""", "segments")
def p12_drop_short(spark, d):
    return segments.drop_short_unconnected(rel.segments(spark, d), 9).select("layer", "seq")


_LIFT = "select *, not coalesce(abs(lead(x1) over w - x2) <= 2.5 and abs(lead(y1) over w - y2) <= 2.5, false) lift from segments window w as (partition by layer order by seq)"


@query(f"select layer, seq, lift from ({_LIFT})", "segments")
def w08_pen_lifts(spark, d):
    return segments.pen_lifts(rel.segments(spark, d), 2.5).select("layer", "seq", "lift")


@query(f"select layer, cast(count(*) as bigint) draws, cast(count(*) filter (lift) + 1 as bigint) ups, cast(count(*) filter (lift) as bigint) travels, round(sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))), 4) drawn from ({_LIFT.replace('2.5', '0.2')}) group by layer", "segments")
def a10_pen_counters(spark, d):
    return segments.pen_counters(rel.segments(spark, d))


@query("""select layer, seq, round(x1 + (x2 - x1) * t0 - 10, 4) + 0e0 x1, round(y1 + (y2 - y1) * t0 - 2, 4) + 0e0 y1, round(x1 + (x2 - x1) * t1 - 10, 4) + 0e0 x2, round(y1 + (y2 - y1) * t1 - 2, 4) + 0e0 y2 from (
 select *, greatest(0e0, case when x2 > x1 then (10 - x1) / (x2 - x1) when x2 < x1 then (40 - x1) / (x2 - x1) else 0 end, case when y2 > y1 then (2 - y1) / (y2 - y1) when y2 < y1 then (30 - y1) / (y2 - y1) else 0 end) t0,
 least(1e0, case when x2 > x1 then (40 - x1) / (x2 - x1) when x2 < x1 then (10 - x1) / (x2 - x1) else 1 end, case when y2 > y1 then (30 - y1) / (y2 - y1) when y2 < y1 then (2 - y1) / (y2 - y1) else 1 end) t1
 from segments where (x1 <> x2 or x1 between 10 and 40) and (y1 <> y2 or y1 between 2 and 30) and (x1 <> x2 or y1 <> y2)) where t0 < t1""", "segments")
def p18_crop(spark, d):
    return _round(segments.crop(rel.segments(spark, d), 10, 2, 40, 30), 4, *segments.ENDS)


@query("select layer, seq, degrees(atan2(y2 - y1, x2 - x1)) > 65 and degrees(atan2(y2 - y1, x2 - x1)) < 205 bright from segments", "segments")
def p16_g19_bright_and_dark(spark, d):
    return segments.orientation_split(rel.segments(spark, d)).select("layer", "seq", "bright")


@query("""select layer, seq, cast(i as int) part, round(x1 + (x2 - x1) * i / n, 4) + 0e0 x1, round(y1 + (y2 - y1) * i / n, 4) + 0e0 y1 from (select *, greatest(1, ceil(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) / 10)) n from segments), lateral (select unnest(range(0, cast(n as bigint))) i)""", "segments")
def f03_segmentize(spark, d):
    return _round(lines.segmentize(rel.segments(spark, d), 10).select("layer", "seq", "part", "x1", "y1"), 4, "x1", "y1")


@query("select layer, seq, printf('M%.2f %.2f L%.2f %.2f', x1, y1, x2, y2) d from segments", "segments")
def k03_svg_lines(spark, d):
    return output.svg_lines(rel.segments(spark, d))


@query()
def w09_w13_budgeted_files(spark, d):
    return segments.filed(rel.segments(spark, d), 5000.0, 120.0, keep=())


@query()
def g24_gcode(spark, d):
    return output.gcode(rel.segments(spark, d))


@query()
def j12_o04_greedy_order(spark, d):
    return segments.greedy_order(segments.distinct_segments(rel.segments(spark, d)).withColumn("seq", F.expr("((x1 * 50 + y1) * 50 + x2) * 50 + y2").cast("long")))


# ---- joins and places


def _planar(spark, d):
    p = rel.places(spark, d)
    return p.withColumns({"x": F.col("lon"), "y": F.col("lat")})


@query("select c.id, n.n_name nation, r.r_name region from (select c_custkey id, c_nationkey from customer) c join nation n on c.c_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey")
def j01_j02_key_joins(spark, d):
    c, n, r = (rel.table(spark, d, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.col("c_custkey").alias("id"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


@query("select id, label, population from places where population >= 3000000", "places")
def p02_population_filter(spark, d):
    return rel.places(spark, d).where("population >= 3000000").select("id", "label", "population")


@query("select id, population from places p where not exists (select 1 from places o where abs(o.lon - p.lon) <= 4 and abs(o.lat - p.lat) <= 4 and (o.population > p.population or o.population = p.population and o.id < p.id))", "places")
def j04_crowding(spark, d):
    return places.drop_crowded(_planar(spark, d), 4.0).select("id", "population")


@query("select p.id, cast(count(o.id) as bigint) as overlaps from places p left join places o on o.id <> p.id and abs(o.lon - p.lon) <= 3 and abs(o.lat - p.lat) <= 3 group by p.id", "places")
def j06_overlap_counts(spark, d):
    return places.overlap_counts(_planar(spark, d), 3.0)


_POS = "positions(key, angle, align, error) as (values " + ", ".join(f"('{k}', {a}, '{al}', {e})" for k, a, al, e in places.POSITIONS) + ")"


@query("""select id, key, error, round(x - 1, 4) + 0e0 xmin, round(y - 3.5e0, 4) + 0e0 ymin, round(x + w + 1, 4) + 0e0 xmax, round(y + 3.5e0, 4) + 0e0 ymax from (select id, key, error, lat + 5 * sin(radians(angle)) y, length(label) * 3e0 w,
 lon + 5 * cos(radians(angle)) - case align when 'LEFT' then 0e0 when 'RIGHT' then length(label) * 3e0 else length(label) * 1.5e0 end x from places, positions)""", "places", _POS)
def j09_g10_label_candidates(spark, d):
    return _round(places.candidates(_planar(spark, d)), 4, "xmin", "ymin", "xmax", "ymax")


@query()
def g11_g12_label_placement(spark, d):
    p = _planar(spark, d)
    top = p.agg(F.min("population").alias("lo"), F.max("population").alias("hi"))
    kept = places.drop_crowded(p, 4.0).crossJoin(F.broadcast(top)).withColumn("priority", F.coalesce((F.col("population") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0)), F.lit(0.0)))
    boxes = places.candidates(kept)
    return places.place_labels(boxes, kept.join(places.label_regions(boxes), "id"))


@query("select n_nationkey id, n_name name, coalesce(r_name, '') altname from nation left join (select * from region where r_name <> 'ASIA') r on n_regionkey = r_regionkey")
def j10_altnames(spark, d):
    n, r = rel.table(spark, d, "nation"), rel.table(spark, d, "region").where("r_name <> 'ASIA'")
    return n.join(r, n.n_regionkey == r.r_regionkey, "left").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.coalesce("r_name", F.lit("")).alias("altname"))


@query("select id, round((population - lo) / cast(hi - lo as double), 6) priority from places, (select min(population) lo, max(population) hi from places)", "places")
def a04_priority(spark, d):
    p = rel.places(spark, d)
    top = p.agg(F.min("population").alias("lo"), F.max("population").alias("hi"))
    return p.crossJoin(F.broadcast(top)).select("id", F.round((F.col("population") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0)), 6).alias("priority"))


@query("select id, population, cast(row_number() over (partition by id % 10 order by population desc, id desc) as int) rank from places", "places")
def o01_w16_population_rank(spark, d):
    return rel.places(spark, d).select("id", "population", F.expr("row_number() over (partition by id % 10 order by population desc, id desc)").alias("rank"))


@query("""select layer, cast(target as double) target, min_by(seq, (abs(arc - target), seq)) seq from (select layer, seq, sum(d) over (partition by layer order by seq rows unbounded preceding) arc from
 (select layer, seq, coalesce(sqrt((x1 - lag(x1) over w) * (x1 - lag(x1) over w) + (y1 - lag(y1) over w) * (y1 - lag(y1) over w)), 0e0) d from segments window w as (partition by layer order by seq))), (values (100), (777), (2500)) t(target) group by layer, target""", "segments")
def j11_w07_nearest_vertex(spark, d):
    p = rel.segments(spark, d).select(F.col("layer").alias("id"), "seq", F.col("x1").alias("x"), F.col("y1").alias("y"))
    t = p.select("id").distinct().withColumn("target", F.explode(F.array(F.lit(100.0), F.lit(777.0), F.lit(2500.0))))
    return lines.nearest_vertex(p, t).withColumnRenamed("id", "layer")


# ---- projection, grids, hatching, text


_MERC = "round(radians(lon) * 6378137, 2) + 0e0 mx, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137, 2) + 0e0 my, round(radians(lon) * cos(radians(lat)) * 6378137, 2) + 0e0 sx, round(radians(lat) * 6378137, 2) + 0e0 sy"


@query(f"select id, {_MERC} from places", "places")
def f23_f24_mercator_sinusoidal(spark, d):
    mx, my = geo.mercator(F.col("lon"), F.col("lat"))
    sx, sy = geo.sinusoidal(F.col("lon"), F.col("lat"))
    return _round(rel.places(spark, d).select("id", mx.alias("mx"), my.alias("my"), sx.alias("sx"), sy.alias("sy")), 2, "mx", "my", "sx", "sy")


_VDG = """select id, round(6378137 * case when phi = 0 then lam when lam = 0 or p >= 1 then 0 else sign(lam) * px end, 1) + 0e0 x, round(6378137 * case when phi = 0 then 0 when lam = 0 or p >= 1 then sign(phi) * pi() * tan(asin(p) / 2)
 else sign(phi) * pi() * sqrt(greatest(0e0, 1 - (px / pi()) * (px / pi()) - 2 * a * (px / pi()))) end, 1) + 0e0 y from (select *, pi() * abs(a * (g - q * q) + sqrt(greatest(0e0, a * a * (g - q * q) * (g - q * q) - (q * q + a * a) * (g * g - q * q)))) / (q * q + a * a) px
 from (select *, g * (2 / p - 1) q from (select *, sqrt(greatest(0e0, 1 - p * p)) / (p + sqrt(greatest(0e0, 1 - p * p)) - 1) g from (select id, radians(lon) lam, radians(lat) phi, abs(2 * radians(lat) / pi()) p, abs(pi() / radians(lon) - radians(lon) / pi()) / 2 a from places))))"""


@query(_VDG, "places")
def f22_van_der_grinten(spark, d):
    x, y = geo.van_der_grinten(F.col("lon"), F.col("lat"))
    return _round(rel.places(spark, d).select("id", x.alias("x"), y.alias("y")), 1, "x", "y")


@query()
def f24_eckert_iv(spark, d):
    x, y = geo.eckert_iv(F.col("lon"), F.col("lat"))
    return _round(rel.places(spark, d).select("id", x.alias("x"), y.alias("y")), 1, "x", "y")


@query("select id, position from (select id, cast(unnest(range(-cast(floor(abs(lon) / 20) as bigint), cast(floor(abs(lon) / 20) as bigint) + 1)) as double) * 20 position from places union select id, abs(lon) from places union select id, -abs(lon) + 0e0 from places)", "places")
def g02_grid_positions(spark, d):
    """Lines every 20 degrees up to each place's longitude, and at it, on both sides."""
    return lines.grid_positions(rel.places(spark, d).select("id", F.abs("lon").alias("limit")), 20)


@query("select grid.id, cast(seq as int) seq, round(x * (750 / 40075016.68557849e0) + 375, 3) + 0e0 x, round(-y * (750 / 40075016.68557849e0) + 250, 3) + 0e0 y from grid join projected p on p.id = grid.pid",
 "grid as (select c_custkey id, c_custkey * 100 + seq pid, seq, floor(c_custkey * 137.508e0 % 360 - 180) lon, seq * 5e0 - 85 lat from customer, (select unnest(range(0, 35)) seq))", "points as (select pid id, lon, lat from grid)",
 "projected as (" + _VDG.replace("from places", "from points").replace("round(6378137 * case", "(6378137 * case").replace(", 1) + 0e0", ")") + ")")
def g03_meridians(spark, d):
    """Each place's meridian, to the whole degree, on the page."""
    lons = rel.places(spark, d).select("id", F.floor("lon").cast("double").alias("lon"))
    return _round(lines.meridians(lons, 750, 500), 3, "x", "y")


@query("select id, round(case when l > 180 then l - 360 when l < -180 then l + 360 else l end, 6) + 0e0 wrapped, round(l * 2e0 + lat * 0.5e0 + 3, 4) + 0e0 ax, round(l * -1e0 + lat * 3e0 - 7, 4) + 0e0 ay from (select id, lon * 1.4e0 l, lat from places)", "places")
def f01_f42_affine_wrap(spark, d):
    p = rel.places(spark, d).withColumn("l", F.col("lon") * 1.4)
    ax, ay = geo.affine(F.col("l"), F.col("lat"), (2.0, 0.5, -1.0, 3.0, 3.0, -7.0))
    return _round(p.select("id", geo.wrap_longitude(F.col("l")).alias("wrapped"), ax.alias("ax"), ay.alias("ay")), 6, "wrapped").transform(lambda t: _round(t, 4, "ax", "ay"))


@query("select id, round(lon + s, 6) + 0e0 lon, lat from places, (values (0e0), (-360e0), (360e0)) t(s) where s = 0 or s = 360 and lon <= -120 or s = -360 and lon >= 120", "places")
def u01_wrap_over(spark, d):
    return _round(lines.wrap_over(rel.places(spark, d).select("id", "lon", "lat")).select("id", "lon", "lat"), 6, "lon")


def _boxes(spark, d):
    s = rel.segments(spark, d)
    return s.groupBy(F.col("layer").alias("id")).agg(F.min("x1").alias("xmin"), F.min("y1").alias("ymin"), F.max("x2").alias("xmax"), F.max("y2").alias("ymax"))


@query("select layer id, min(x1) xmin, min(y1) ymin, max(x2) xmax, max(y2) ymax from segments group by layer", "segments")
def a16_f10_bounds(spark, d):
    return _boxes(spark, d)


_C = repr(math.cos(math.radians(45))) + "e0"


@query(f"""select id, cast(i as int) i, round(cx - diag * {_C} - (4e0 * i - diag / 2) * {_C}, 4) + 0e0 x1, round(cy - diag * {_C} + (4e0 * i - diag / 2) * {_C}, 4) + 0e0 y1, round(cx + diag * {_C} - (4e0 * i - diag / 2) * {_C}, 4) + 0e0 x2, round(cy + diag * {_C} + (4e0 * i - diag / 2) * {_C}, 4) + 0e0 y2 from (
 select layer id, (a + c) / 2 cx, (b + d) / 2 cy, sqrt((c - a) * (c - a) + (d - b) * (d - b)) diag from (select layer, floor(min(x1) / 4) * 4 a, floor(min(y1) / 4) * 4 b, ceil(max(x2) / 4) * 4 c, ceil(max(y2) / 4) * 4 d from segments group by layer)), lateral (select unnest(range(0, cast(floor(diag / 4) as bigint))) i)""", "segments")
def g06_hatch_lines(spark, d):
    return _round(lines.hatch_lines(_boxes(spark, d), 45, 4.0), 4, *segments.ENDS)


@query("select id, round(12 * 6, 4) + 0e0 planar, round((6378137e0 * 6378137e0 / 2) * radians(12) * 2 * (sin(radians(lat + 6)) - sin(radians(lat))), -3) + 0e0 sphere from places where lat < 80", "places")
def f07_f20_areas(spark, d):
    p = rel.places(spark, d).where("lat < 80")
    corner = lambda a, b: F.struct((F.col("lon") + a).cast("double").alias("x"), (F.col("lat") + b).cast("double").alias("y"))
    ring = F.array(corner(0, 0), corner(12, 0), corner(12, 6), corner(0, 6), corner(0, 0))
    return _round(_round(p.select("id", geo.ring_area(ring).alias("planar"), (-geo.spherical_area(ring)).alias("sphere")), 4, "planar"), -3, "sphere")


@query("""select id, cast(pos as int) pos, char, round(coalesce(sum(a) over (partition by id order by pos rows between unbounded preceding and 1 preceding), 0e0), 4) + 0e0 anchor, round(sum(a) over (partition by id), 4) total from (select id, pos - 1 pos, label[pos] char, (ascii(label[pos]) % 7 + 4) / 10e0 a
 from (select p_partkey id, p_name as label, unnest(range(1, length(p_name) + 1)) pos from part))""")
def w10_a06_text_layout(spark, d):
    t = rel.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"))
    return _round(lines.text_layout(t), 4, "anchor", "total")


@query("select p_partkey id, lower(regexp_replace(p_name, '\\W+', '', 'g')) slug, reverse(p_name) backwards, upper(p_brand) brand, cast(regexp_replace(cast(p_size as varchar) || 'mm', '[a-z]+', '') as int) size, cast(len(string_split(p_type, ' ')) as int) words from part")
def f50_f55_strings(spark, d):
    return rel.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lower(F.regexp_replace("p_name", r"\W+", "")).alias("slug"), F.reverse("p_name").alias("backwards"), F.upper("p_brand").alias("brand"), F.regexp_replace(F.concat(F.col("p_size").cast("string"), F.lit("mm")), "[a-z]+", "").cast("int").alias("size"), F.size(F.split("p_type", " ")).alias("words"))


@query("select id, population from places p where not exists (select 1 from places z where z.id % 40 = 0 and p.lon between z.lon - 5 and z.lon + 5 and p.lat between z.lat - 5 and z.lat + 5 and z.id % 3 < p.id % 3)", "places")
def u02_j03_zone_fold(spark, d):
    p = rel.places(spark, d)
    zones = p.where("id % 40 = 0").select((F.col("lon") - 5).alias("xmin"), (F.col("lon") + 5).alias("xmax"), (F.col("lat") - 5).alias("ymin"), (F.col("lat") + 5).alias("ymax"), (F.col("id") % 3).alias("zone_rank"))
    return output.fold_zones(p.select("id", "population", F.col("lon").alias("x"), F.col("lat").alias("y"), (F.col("id") % 3).alias("layer_rank")), zones).select("id", "population")


@query()
def f04_simplify(spark, d):
    p = rel.segments(spark, d).select(F.col("layer").cast("long").alias("id"), "seq", F.col("x1").alias("x"), F.col("y1").alias("y"))
    return lines.simplify(p, 10.0)


@query()
def f05_taubin_smoothing(spark, d):
    p = rel.segments(spark, d).select("layer", "seq", F.col("x1").alias("x"), F.col("y1").alias("y"))
    return _round(lines.taubin(p, 5), 6, "x", "y")


@query()
def g13_streamlines(spark, d):
    t = raster.gradient(rel.cells(spark, d))
    return _round(lines.streamlines(t.select("y", "x", "angle", (F.col("magnitude") < 0.001).alias("flat"))), 6, "x", "y")


# ---- scales, tiles, zones, regions


@query("select id, round(pow(t, 2.5e0), 6) power, round(sin(t * pi() / 2), 6) sine, round(1 / (1 + exp(-10 * (t - 0.5e0))), 6) sigmoid, cast(floor(t * 7) as int) as bin, cast(least(255, floor(t * 256)) as int) colour, round(6 * t / (5 * t + 1), 6) unlogged from (select id, (lat + 80) / 160 t from places)", "places")
def f38_f39_f40_scales(spark, d):
    t = (F.col("lat") + 80) / 160
    return rel.places(spark, d).select("id", F.round(F.pow(t, 2.5), 6).alias("power"), F.round(F.sin(t * math.pi / 2), 6).alias("sine"), F.round(1 / (1 + F.exp(-10 * (t - 0.5))), 6).alias("sigmoid"), F.floor(t * 7).cast("int").alias("bin"), F.least(F.lit(255), F.floor(t * 256)).cast("int").alias("colour"), F.round(geo.unlog(t, 5), 6).alias("unlogged"))


@query("select p_partkey id, cast(100 + p_size * 10 as double) width, 'Scale: 1:' || cast(floor(40075000000e0 / (100 + p_size * 10)) as bigint) as scale from part")
def f41_scale_text(spark, d):
    width = (F.lit(100) + F.col("p_size") * 10).cast("double")
    return rel.table(spark, d, "part").select(F.col("p_partkey").alias("id"), width.alias("width"), geo.scale_text(width).alias("scale"))


@query("select p_partkey id, cast(i as int) i, round(p_size + i * ((p_retailprice - p_size) / 10), 6) + 0e0 open_end, round(p_size + i * ((p_retailprice - p_size) / 9), 6) + 0e0 closed_end from part, (select unnest(range(0, 10)) i)")
def f37_linspace(spark, d):
    t = rel.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("a"), F.col("p_retailprice").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i"))
    return _round(t.select("id", "i", geo.linspace(F.col("a"), F.col("b"), 10, F.col("i"), False).alias("open_end"), geo.linspace(F.col("a"), F.col("b"), 10, F.col("i")).alias("closed_end")), 6, "open_end", "closed_end")


@query("select floor(lon / 20e0) * 20 + 0e0 lon1, floor(lon / 20e0) * 20 + 20 lon2, floor(lat / 20e0) * 20 + 0e0 lat1, floor(lat / 20e0) * 20 + 20 lat2, cast(count(*) as bigint) places, round(min(lon), 6) + 0e0 west, round(max(lon), 6) + 0e0 east, round(min(lat), 6) + 0e0 south, round(max(lat), 6) + 0e0 north from places group by floor(lon / 20e0), floor(lat / 20e0)", "places")
def g04_j08_grid_tiles(spark, d):
    """Tiles of 20 degrees with the places in them, and what of the tile these take up."""
    tile = lambda c: F.floor(F.col(c) / 20) * 20.0 + F.lit(0.0)
    t = rel.places(spark, d).groupBy(tile("lon").alias("lon1"), tile("lat").alias("lat1")).agg(F.count("*").alias("places"), F.min("lon").alias("west"), F.max("lon").alias("east"), F.min("lat").alias("south"), F.max("lat").alias("north"))
    return _round(t.withColumn("lon2", F.col("lon1") + 20).withColumn("lat2", F.col("lat1") + 20), 6, "west", "east", "south", "north")


@query("select layer, round(avg(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))), 4) mean_length, cast(count(*) filter (sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) > 20) as bigint) long_ones from segments group by layer", "segments")
def a12_p14_lengths(spark, d):
    return rel.segments(spark, d).groupBy("layer").agg(F.round(F.avg(segments.length()), 4).alias("mean_length"), F.count_if(segments.length() > 20).alias("long_ones"))


@query("select cast(floor(y / 10e0) as int) zone_y, cast(floor(x / 20e0) as int) zone_x, round(avg(z), 4) + 0e0 mean_z, cast(count(*) as bigint) n from cells where y < 40 and x < 60 group by 1, 2", "cells")
def j15_a08_zonal_means(spark, d):
    """Cells joined to the box they lie in by the box's own cell keys."""
    zone = rel.cells(spark, d).groupBy(F.floor(F.col("y") / 10).cast("int").alias("zone_y"), F.floor(F.col("x") / 20).cast("int").alias("zone_x"))
    return _round(zone.agg(F.avg("z").alias("mean_z"), F.count("*").alias("n")), 4, "mean_z")


@query("select y - 5 y, x - 10 x, z from cells where y between 5 and 24 and x between 10 and 49", "cells")
def s15_raster_crop(spark, d):
    return rel.cells(spark, d).where("y between 5 and 24 and x between 10 and 49").select((F.col("y") - 5).alias("y"), (F.col("x") - 10).alias("x"), "z")


@query("select y, x, u, v from uv", "uv")
def s05_current_grid(spark, d):
    return rel.uv(spark, d)


@query()
def w15_orientation_mask(spark, d):
    g = raster.gradient(rel.cells(spark, d))
    inside = (F.degrees("angle") > 65) & (F.degrees("angle") < 205) & (F.col("magnitude") >= 50)
    return raster.open_close(g.select("y", "x", F.when(inside, 1).otherwise(0).alias("m"))).select("y", "x", "clean")


@query()
def j05_label_regions(spark, d):
    """Places whose labels may overlap, in connected regions."""
    return places.label_regions(places.candidates(_planar(spark, d)))


@query()
def g25_blob_centres(spark, d):
    c = rel.cells(spark, d)
    blobs = raster.region_labels(c.where("z > 200").select("y", "x"))
    return _round(blobs.groupBy("region").agg(F.avg("y").alias("y"), F.avg("x").alias("x"), F.count("*").alias("n")), 4, "y", "x")


# ---- polygons, distances, resampling and text register themselves here

from . import catalog_shapes  # noqa: E402, F401
