"""Registered queries on polygons, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _BANDS_SQL, _VDG, BANDS, ORACLE_SQL, _box, _extreme, _r, _round, query
from .functions import geometry as geo
from .operators import cleaning, distance, lines, mesh, places, polygons, raster, segments, text
from .plans import output
from .sources import files
from .sources import relations as rel


def _runs(of: str, edges: str, keys: str, when: str = "true", more: str = "") -> str:
    """Parts t1..t2 of the lines `of` (x1, y1, x2, y2, columns `keys`) inside the polygons `edges`; `when` sees l and e."""
    return f"""(select *, greatest(t, 0e0) t1, least(t_next, 1e0) t2 from (
 select *, lead(t) over w t_next, row_number() over w n from (
  select *, ((px + (qx - px) * (sa / (sa - sb)) - x1) * dx + (py + (qy - py) * (sa / (sa - sb)) - y1) * dy) / (dx * dx + dy * dy) t from (
   select l.*, e.id polygon, {more} e.px, e.py, e.qx, e.qy, l.x2 - l.x1 dx, l.y2 - l.y1 dy, dx * (e.py - l.y1) - dy * (e.px - l.x1) sa, dx * (e.qy - l.y1) - dy * (e.qx - l.x1) sb
   from ({of}) l join {edges} e on {when} where l.x1 <> l.x2 or l.y1 <> l.y2) where (sa >= 0) <> (sb >= 0))
 window w as (partition by {keys}, polygon order by t)) where n % 2 = 1 and greatest(t, 0e0) < least(t_next, 1e0))"""


def _part(t1: str = "t1", t2: str = "t2", names: tuple[str, ...] = ("x1", "y1", "x2", "y2")) -> str:
    return ", ".join(f"{_r(e)} as {n}" for e, n in zip((f"x1 + (x2 - x1) * {t1}", f"y1 + (y2 - y1) * {t1}", f"x1 + (x2 - x1) * {t2}", f"y1 + (y2 - y1) * {t2}"), names))


def _left(of: str, runs: str, keys: str) -> str:
    """What the runs leave of the lines `of`: t1, t2."""
    return f"""(select * exclude (t1, reached), reached t1, t1 t2_end from (
 select *, coalesce(max(t2) over (partition by {keys} order by t1, t2 rows between unbounded preceding and 1 preceding), 0e0) reached from (
  select {keys}, x1, y1, x2, y2, t1, t2 from {runs} union all select {keys}, x1, y1, x2, y2, 1e0, 1e0 from ({of}) where x1 <> x2 or y1 <> y2)) where t1 > reached)"""


# ---- clipping and subtraction


@query(f"select layer, seq, polygon id, {_part()} from {_runs('select * from segments', 'zones', 'layer, seq')}", "segments", "zones")
def u03_g17_lines_in_polygons(spark, d):
    return _round(polygons.clip_lines(rel.segments(spark, d), rel.zones(spark, d), ["layer", "seq"]).select("layer", "seq", "id", *segments.ENDS), 4, *segments.ENDS)


_LATER = _runs("select * from segments", "zones", "layer, seq", "e.zone_rank < l.layer")


@query(f"select layer, seq, cast(row_number() over (partition by layer, seq order by t1) as int) part, {_part('t1', 't2_end')} from {_left('select * from segments', _LATER, 'layer, seq')}", "segments", "zones")
def j03_lines_minus_zones(spark, d):
    left = polygons.subtract_zones(rel.segments(spark, d), rel.zones(spark, d), ["layer", "seq"])
    return _round(left.select("layer", "seq", "part", *segments.ENDS), 4, *segments.ENDS)


_AS_LINES = "select id own, k, px x1, py y1, qx x2, qy y2 from "
_AREA = "round(sum((ex1 * ey2 - ex2 * ey1) / 2), 3) + 0e0"
_WHOLE = "x1 + (x2 - x1) * t1 ex1, y1 + (y2 - y1) * t1 ey1, x1 + (x2 - x1) * t2 ex2, y1 + (y2 - y1) * t2 ey2"


@query(f"""select id, stencil, cast(count(*) as bigint) n_edges, {_AREA} area from (
 select own id, polygon stencil, {_WHOLE} from {_runs(_AS_LINES + 'zones', 'stencils', 'own, k')}
 union all select polygon id, own stencil, {_WHOLE} from {_runs(_AS_LINES + 'stencils', 'zones', 'own, k')}) group by id, stencil""", "zones", "stencils")
def u03_polygons_in_polygons(spark, d):
    """Polygons cropped by polygons: edges and area of what is left."""
    cut = polygons.crop_polygons(rel.zones(spark, d), rel.stencils(spark, d))
    return _round(cut.groupBy("id", "stencil").agg(F.count("*").alias("n_edges"), polygons.signed_area().alias("area")), 3, "area")


_OTHERS = _runs(_AS_LINES + "zones", "zones", "own, k", "e.id <> l.own")


@query(f"""select distinct {_part('t1', 't2_end', ('px', 'py', 'qx', 'qy'))} from {_left(_AS_LINES + 'zones', _OTHERS, 'own, k')}""", "zones")
def a01_union_boundary(spark, d):
    edges = polygons.union_edges(rel.zones(spark, d))
    return _round(edges, 4, *polygons.EDGE).distinct()


# ---- hatching


_HATCH = """select id, i, cx - diag * o - (gap * i - diag / 2) * s x1, cy - diag * s + (gap * i - diag / 2) * o y1, cx + diag * o - (gap * i - diag / 2) * s x2, cy + diag * s + (gap * i - diag / 2) * o y2
 from (select *, sin(radians(angle)) s, cos(radians(angle)) o, (a + c) / 2 cx, (b + d) / 2 cy, sqrt((c - a) * (c - a) + (d - b) * (d - b)) diag
  from (select id, gap, angle, floor(xmin / gap) * gap a, floor(ymin / gap) * gap b, ceil(xmax / gap) * gap c, ceil(ymax / gap) * gap d from ({boxes}))), lateral (select unnest(range(0, cast(floor(diag / gap) as bigint))) i)"""
_ZONE_BOXES = "select id, {} gap, {} angle, min(least(px, qx)) xmin, min(least(py, qy)) ymin, max(greatest(px, qx)) xmax, max(greatest(py, qy)) ymax from zones group by id"


@query(f"select id, cast(i as int) i, {_part()} from {_runs(_HATCH.format(boxes=_ZONE_BOXES.format('0.5e0', '30e0')), 'zones', 'id, i', 'e.id = l.id')}", "zones")
def g07_hatch_clip(spark, d):
    """Hatching of polygons that aren't rectangles."""
    zones = rel.zones(spark, d)
    return _round(lines.hatch_clip(lines.hatch_lines(polygons.boxes(zones), 30, 0.5), zones), 4, *segments.ENDS)


_STEEP = "select y, x, atan2(coalesce((lead(z) over c - lag(z) over c) / 2, lead(z) over c - z, z - lag(z) over c, 0e0), coalesce((lead(z) over r - lag(z) over r) / 2, lead(z) over r - z, z - lag(z) over r, 0e0)) angle from cells window r as (partition by y order by x), c as (partition by x order by y)"
_MEAN = f"""select id, cast(count(*) as bigint) n, degrees(atan2(sum(sin(angle)), sum(cos(angle)))) direction from (
 select p.y, p.x, p.angle, e.id from ({_STEEP}) p join zones e on (e.py > p.y + 0.5e0) <> (e.qy > p.y + 0.5e0) and p.x + 0.5e0 > (e.qx - e.px) * (p.y + 0.5e0 - e.py) / (e.qy - e.py) + e.px
 group by p.y, p.x, p.angle, e.id having count(*) % 2 = 1) group by id"""


@query(f"select id, n, round(direction, 3) + 0e0 direction from ({_MEAN})", "cells", "zones")
def j15_a08_zonal_direction(spark, d):
    """Mean direction of the slope in each polygon, of the cells whose centres lie in it."""
    return _round(polygons.zonal_direction(raster.gradient(rel.cells(spark, d)), rel.zones(spark, d)), 3, "direction")


@query(f"""select id, cast(i as int) i, {_part()} from {_runs(_HATCH.format(boxes="select id, 0.5e0 gap, round(direction) + 0e0 angle, xmin, ymin, xmax, ymax from (" + _MEAN + ") join (" + _ZONE_BOXES.format('0', '0') + ") using (id)"), 'zones', 'id, i', 'e.id = l.id')}""", "cells", "zones")
def g21_slope_hatching(spark, d):
    """Each polygon hatched along the mean direction of the slope in it, in whole degrees."""
    zones = rel.zones(spark, d)
    boxes = polygons.boxes(zones).join(polygons.zonal_direction(raster.gradient(rel.cells(spark, d)), zones), "id")
    hatch = lines.hatch_lines(boxes, F.round("direction") + F.lit(0.0), 0.5)
    return _round(lines.hatch_clip(hatch, zones), 4, *segments.ENDS)


@query(f"""select id, cast(i as int) i, {', '.join(_r(e) + ' ' + e for e in segments.ENDS)} from ({_HATCH.format(boxes='select cast(level as bigint) id, 4e0 - 0.2e0 * level gap, 45e0 angle, cast(min(x) as double) xmin, cast(min(y) as double) ymin, cast(max(x) as double) xmax, cast(max(y) as double) ymax from cells join bands on case when low <= high then z > low and z <= high else z >= high and z < low end group by level')})""", "cells", _BANDS_SQL)
def g22_level_hatching(spark, d):
    """Boxes of each level's cells, hatched at 4 - 0.2 * level; one pass over the cells."""
    boxes = raster.slice_levels(rel.cells(spark, d), BANDS).groupBy(F.col("level").cast("long").alias("id")).agg(*[f(c).cast("double").alias(f"{c}{n}") for c in "xy" for f, n in ((F.min, "min"), (F.max, "max"))])
    return _round(lines.hatch_lines(boxes, 45, F.lit(4.0) - F.lit(0.2) * F.col("id")), 4, *segments.ENDS)


# ---- distances and iso-lines


def _distance(source: str, cells: str = "cells", by: str = "") -> str:
    same = f"s.{by} = c.{by} and " if by else ""
    return f"select {'c.' + by + ', ' if by else ''}c.y, c.x, min(cast((c.y - s.y) * (c.y - s.y) + (c.x - s.x) * (c.x - s.x) as bigint)) d2 from {cells} c join {cells} s on {same}s.{source} group by all"


@query(_distance("z > 0"), "cells")
def f09_distance_to_land(spark, d):
    """Squared distance of each cell to the nearest above 0."""
    return distance.squared_distance(rel.cells(spark, d), F.col("z") > 0)


@query(f"select y, x, d2 from ({_distance('z > 0')}) where d2 between 1 and 9", "cells")
def a02_buffer_without_land(spark, d):
    return distance.ring_cells(rel.cells(spark, d), F.col("z") > 0, 3.0)


_LEVEL_CELLS = "level_cells as (select level, y, x, (case when low <= high then z > low and z <= high else z >= high and z < low end) own from cells, bands)"


@query(f"select y, x, cast(min(6 - level) as int) zone_rank from ({_distance('own', 'level_cells', 'level')}) where d2 <= 4 group by y, x", "cells", _BANDS_SQL, _LEVEL_CELLS)
def u04_g27_zone_growth(spark, d):
    """Each level's cells, grown by 2, as zones in front of those of the levels before; the foremost zone of each cell."""
    cells = rel.cells(spark, d)
    of_level = cells.join(F.broadcast(spark.createDataFrame(BANDS, "level int, low double, high double")))
    of_level = of_level.withColumn("own", raster.level_mask(F.col("z"), F.col("low"), F.col("high"), False))
    zones = distance.grown(of_level, F.col("own"), 2.0, ("level",)).withColumn("zone_rank", F.lit(len(BANDS) - 1) - F.col("level"))
    return zones.groupBy("y", "x").agg(F.min("zone_rank").alias("zone_rank"))


def _isolines(field: str, levels: str) -> str:
    share = lambda p, q: f"(bound - v{p}) / (v{q} - v{p})"
    x = lambda i: f"case {i} when 0 then x + {share(0, 1)} when 1 then x + 1e0 when 2 then x + {share(3, 2)} else x + 0e0 end"
    y = lambda i: f"case {i} when 0 then y + 0e0 when 1 then y + {share(1, 2)} when 2 then y + 1e0 else y + {share(0, 3)} end"
    name = lambda i: f"((cast(level as bigint) * 33554432 + y + cast({i} = 2 as int)) * 33554432 + x + cast({i} = 1 as int)) * 2 + {i} % 2"
    turn = lambda p, q: f"cast(v{p} > bound as int) - cast(v{q} > bound as int)"
    return f"""field as materialized ({field}), levels(level, bound) as ({levels}),
 squares as (select a.y, a.x, a.v v0, b.v v1, c.v v2, e.v v3 from field a join field b on b.y = a.y and b.x = a.x + 1 join field c on c.y = a.y + 1 and c.x = a.x + 1 join field e on e.y = a.y + 1 and e.x = a.x),
 passed as (select *, [{turn(0, 1)}, {turn(1, 2)}, {turn(2, 3)}, {turn(3, 0)}] s from squares, levels where least(v0, v1, v2, v3) <= bound and greatest(v0, v1, v2, v3) > bound),
 falls as (select *, case when len(list_filter(s, lambda i: i <> 0)) < 4 then 0 when (v0 + v1 + v2 + v3) / 4 > bound then 1 else -1 end step, unnest(list_filter([0, 1, 2, 3], lambda i: s[i + 1] = 1)) d from passed),
 joined as (select *, case when step = 0 then list_filter([0, 1, 2, 3], lambda i: s[i + 1] = -1)[1] else (d + step + 4) % 4 end u from falls),
 links as materialized (select level, {name('d')} a, {name('u')} b, {x('d')} x1, {y('d')} y1, {x('u')} x2, {y('u')} y2 from joined)"""


_TRACED = f"""walk as (select level, a first, a, b, 0 n from links union all select w.level, w.first, l.a, l.b, n + 1 from walk w join links l on l.level = w.level and l.a = w.b where l.a <> w.first),
 rings as (select level, first, min(a) least, max_by(b, n) finish, bool_or(b = first) closed from walk group by level, first),
 begun as (select * from rings r where case when closed then first = least else not exists (select 1 from links l where l.level = r.level and l.b = r.first) end)
 select w.level, case when closed then least else finish end as chain, cast(n as bigint) seq, closed, {', '.join(_r(c) + ' as ' + c for c in segments.ENDS)}
 from begun join walk w on w.level = begun.level and w.first = begun.first join links l on l.level = w.level and l.a = w.a"""


def _recursive(ctes: str, body: str) -> str:
    """One WITH clause: recursive, the relations' own texts before."""
    return f"with recursive {', '.join(rel.SQL[n] for n in ('cells',))}, {ctes}, {body}"


@query(_recursive(_isolines(f"select y, x, sqrt(d2) v from ({_distance('z <= 0')})", "select cast(i as int), i * 1e0 from (select unnest(range(1, 1 + (select cast(floor(max(sqrt(d2))) as int) from (" + _distance("z <= 0") + ")))) i)"), _TRACED))
def g20_concentric_hatching(spark, d):
    """Land hatched by rings a cell apart: iso-lines of the distance to what isn't land, as far inwards as it goes."""
    field = distance.squared_distance(rel.cells(spark, d), F.col("z") <= 0).select("y", "x", F.sqrt("d2").alias("v"))
    levels = field.agg(F.floor(F.max("v")).cast("int").alias("n")).where("n > 0").select(F.explode(F.expr("sequence(1, n)")).alias("level")).withColumn("at", F.col("level") * 1.0)
    return _round(distance.traced(field, levels), 4, *segments.ENDS)


@query(_recursive(_isolines(f"select y, x, sqrt(d2) v from ({_distance('z > 0')})", "values (1, 1.5e0), (2, 3e0), (3, 4.5e0)"), _TRACED))
def g18_coast_rings(spark, d):
    """Lines along the coast at three distances from it, as rings."""
    field = distance.squared_distance(rel.cells(spark, d), F.col("z") > 0).select("y", "x", F.sqrt("d2").alias("v"))
    return _round(distance.traced(field, spark.createDataFrame([(1, 1.5), (2, 3.0), (3, 4.5)], "level int, at double")), 4, *segments.ENDS)


@query(f"""select level, a, b, {', '.join(_r(c) + ' as ' + c for c in segments.ENDS)}, degrees(atan2(y2 - y1, x2 - x1)) > 65 and degrees(atan2(y2 - y1, x2 - x1)) < 205 bright from links""", "cells", _BANDS_SQL, _isolines("select y, x, z v from cells", "select level, low from bands"))
def g19_w11_lit_contours(spark, d):
    """Contours at each band's lower bound, those that face the light apart from the others."""
    levels = spark.createDataFrame([(i, low) for i, low, _ in BANDS], "level int, at double")
    found = distance.isolines(rel.cells(spark, d), levels, "z")
    return _round(segments.orientation_split(found).select("level", "a", "b", *segments.ENDS, "bright"), 4, *segments.ENDS)


# ---- polygons of levels


def _touching(name: str, cells: str, diagonal: bool) -> str:
    """name (level, y, x, region): connected cells, named by the least of them; the rows' runs of cells are what is gone through."""
    wide = int(diagonal)
    return f"""{name}_runs as materialized (select level, y, min(x) x0, max(x) x1 from (select level, y, x, x - row_number() over (partition by level, y order by x) g from {cells}) group by level, y, g),
 {name}_met as materialized (select a.level, a.y ay, a.x0 ax, b.y ny, b.x0 nx from {name}_runs a join {name}_runs b on a.level = b.level and abs(a.y - b.y) = 1 and a.x0 <= b.x1 + {wide} and b.x0 <= a.x1 + {wide}),
 {name}_reach as (select level, y, x0 x, y fy, x0 fx from {name}_runs union
  select b.level, b.ny, b.nx, a.fy, a.fx from {name}_reach a join {name}_met b on a.level = b.level and a.y = b.ay and a.x = b.ax and (b.ny, b.nx) >= (a.fy, a.fx)),
 {name} as (select level, y, unnest(range(x0, x1 + 1)) x, region from (select r.level, r.y, r.x0, r.x1, min(fy * 100000 + fx) region from {name}_reach f join {name}_runs r on f.level = r.level and f.y = r.y and f.x = r.x0 group by r.level, r.y, r.x0, r.x1))"""


_LEVEL_POLYGONS = f"""land as (select level, y, x from cells join bands on case when low <= high then z > low and z <= high else z >= high and z < low end),
 edge as (select min(y) y0, max(y) y1, min(x) x0, max(x) x1 from cells),
 sea as (select l.level, g.y, g.x from (select distinct level from land) l, (select unnest(range(y0, y1 + 1)) y, x from edge, (select unnest(range(x0, x1 + 1)) x from edge)) g
  where not exists (select 1 from land o where o.level = l.level and o.y = g.y and o.x = g.x)),
 {_touching('regions', 'land', True)}, {_touching('waters', 'sea', False)},
 holes as (select level, region, count(*) n, min(y * 100000 + x) top from waters, edge group by level, region having min(y) > any_value(y0) and max(y) < any_value(y1) and min(x) > any_value(x0) and max(x) < any_value(x1)),
 inside as (select h.level, r.region, count(*) n_holes, sum(h.n) hole_cells from holes h join regions r on r.level = h.level and r.y = h.top // 100000 - 1 and r.x = h.top % 100000 group by h.level, r.region)
 select level, cast(count(*) as bigint) n_cells, min(y) ymin, max(y) ymax, min(x) xmin, max(x) xmax, cast(any_value(coalesce(n_holes, 0)) as int) n_holes, cast(any_value(coalesce(hole_cells, 0)) as bigint) hole_cells
 from regions left join inside using (level, region) group by level, region"""


@query(_recursive(_BANDS_SQL, _LEVEL_POLYGONS))
def g08_level_polygons(spark, d):
    """Each level's polygons, with what is in their holes."""
    c = rel.cells(spark, d)
    found = raster.level_polygons(raster.slice_levels(c, BANDS).select("level", "y", "x"), c)
    whole = F.aggregate("holes", F.lit(0).cast("long"), lambda n, h: n + h["n_cells"])
    return found.select("level", "n_cells", "ymin", "ymax", "xmin", "xmax", F.size("holes").alias("n_holes"), whole.alias("hole_cells"))


# ---- resampling


def _bilinear(height: int, width: int) -> str:
    place = lambda i, n, a, b: f"least(greatest(({i} + 0.5e0) * (({b} - {a} + 1) / {n}e0) - 0.5e0, 0e0), {b} - {a} + 0e0)"
    value = " + ".join(f"case when {w} = 0 then 0e0 else ({w}) * {t}.z end" for w, t in (("(1 - v) * (1 - u)", "a"), ("(1 - v) * u", "b"), ("v * (1 - u)", "c"), ("v * u", "d")))
    return f"""select ny y, nx x, {_r(value)} z from (select *, py - fy v, px - fx u, cast(fy as int) + y0 oy, cast(fx as int) + x0 ox from (
  select *, least(floor(py), y1 - y0 - 1) fy, least(floor(px), x1 - x0 - 1) fx from (
   select *, {place('ny', height, 'y0', 'y1')} py, {place('nx', width, 'x0', 'x1')} px from (select cast(unnest(range(0, {height})) as int) ny), (select cast(unnest(range(0, {width})) as int) nx), (select min(y) y0, max(y) y1, min(x) x0, max(x) x1 from cells))))
 left join cells a on a.y = oy and a.x = ox left join cells b on b.y = oy and b.x = ox + 1 left join cells c on c.y = oy + 1 and c.x = ox left join cells d on d.y = oy + 1 and d.x = ox + 1"""


@query(_bilinear(64, 90), "cells")
def f60_bilinear_resize(spark, d):
    return _round(raster.bilinear(rel.cells(spark, d), 64, 90), 4, "z")


@query(_bilinear(16, 24), "cells")
def s04_bilinear_scan(spark, d):
    return _round(raster.bilinear(rel.cells(spark, d), 16, 24), 4, "z")


# ---- text

_ADVANCE = "(ascii({}) % 7 + 4) / 10e0"


def _letters(t):
    """char, advance of all characters in column label; the advances are synthetic."""
    chars = t.select(F.explode(F.split("label", "")).alias("char")).where("char <> ''").distinct()
    return chars.withColumn("advance", (F.ascii("char") % 7 + 4) / 10)


_GRID_POINTS = """grid as (select c_custkey * 2 + kind line, kind, seq, case kind when 0 then floor(c_custkey * 137.508e0 % 360 - 180) else seq * 5e0 - 180 end lon, case kind when 0 then seq * 5e0 - 85 else floor(c_custkey * 61.803e0 % 160 - 80) end lat
  from customer, (values (0, 34), (1, 72)) k(kind, n), lateral (select unnest(range(0, n + 1)) seq)),
 points as (select line * 1000 + seq id, lon, lat from grid)"""
_PROJECTED = "projected as (" + _VDG.replace("from places", "from points").replace("round(6378137 * case", "(6378137 * case").replace(", 1) + 0e0", ")") + ")"
_FRAME = [(0, "y", 20.0, 20.0, 730.0), (1, "y", 485.0, 20.0, 730.0), (2, "x", 25.0, 10.0, 490.0), (3, "x", 725.0, 10.0, 490.0)]


def _side_sql(number: int, axis: str, place: float, low: float, high: float) -> str:
    other = "y" if axis == "x" else "x"
    value = f"{other} + ({place}e0 - {axis}) / (n{axis} - {axis}) * (n{other} - {other})"
    return f"select line, {number} side, {f'{place}e0 x, {value} y' if axis == 'x' else f'{value} x, {place}e0 y'} from steps where kind = {number // 2} and ({axis} <= {place}) <> (n{axis} <= {place}) and {value} between {low} and {high}"


@query(f"""select line, side, label, round(case side when 2 then x when 3 then x - width else x - width / 2 end, 2) + 0e0 x, round(case when side >= 2 then y + 2.5e0 else y end, 2) + 0e0 y from (
 select c.line, side, x, y, cast(cast(case when side < 2 then lon else lat end as int) as varchar) as label, (select sum({_ADVANCE.format('u')}) * 5 from (select unnest(string_split(cast(cast(case when side < 2 then lon else lat end as int) as varchar), '')) u)) width
 from (select *, row_number() over (partition by line order by side) - 1 + 2 * (line % 2) k from (select line, side, max(x) x, max(y) y from crossed group by line, side having count(*) = 1)) c
 join (select line, any_value(lon) lon, any_value(lat) lat from grid where seq = 0 group by line) g on g.line = c.line where k = side)""", _GRID_POINTS, _PROJECTED,
 """steps as (select line, kind, x, y, lead(x) over w nx, lead(y) over w ny from (select line, kind, seq, x * (750 / 40075016.68557849e0) + 375 x, -y * (750 / 40075016.68557849e0) + 250 y from grid join projected on id = line * 1000 + seq) window w as (partition by line order by seq))""",
 "crossed as (" + " union all ".join(_side_sql(*s) for s in _FRAME) + ")")
def g05_j14_grid_labels(spark, d):
    """Labels where each place's meridian leaves the page above and below, and its parallel left and right."""
    p = rel.places(spark, d)
    kind = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.lit(34).alias("n")), F.struct(F.lit(1).alias("kind"), F.lit(72).alias("n"))))
    grid = p.select("id", F.floor("lon").cast("double").alias("lon"), F.floor("lat").cast("double").alias("lat"), kind.alias("k")).select((F.col("id") * 2 + F.col("k.kind")).alias("id"), "k.kind", "lon", "lat", F.explode(F.sequence(F.lit(0), F.col("k.n"))).alias("seq"))
    upright = F.col("kind") == 0
    x, y = geo.to_map(*geo.van_der_grinten(F.when(upright, F.col("lon")).otherwise(F.col("seq") * 5.0 - 180), F.when(upright, F.col("seq") * 5.0 - 85).otherwise(F.col("lat"))), 750.0, 500.0)
    points = grid.select("id", "kind", "seq", x.alias("x"), y.alias("y"))
    found = [text.frame_crossings(points.where(f"kind = {k}").drop("kind"), [s for s in _FRAME if s[0] // 2 == k]) for k in (0, 1)]
    label = F.when(F.col("side") < 2, F.col("lon")).otherwise(F.col("lat")).cast("int").cast("string")
    at = found[0].unionByName(found[1]).join(grid.where("seq = 0").select("id", "lon", "lat"), "id").select("id", "side", "x", "y", label.alias("label"))
    names = at.select("label").distinct().withColumn("id", F.col("label"))
    width = text.laid_out(names, _letters(names), 5.0).groupBy(F.col("id").alias("label")).agg(F.max("total").alias("width"))
    at = at.join(width, "label")
    left = F.when(F.col("side") == 2, F.col("x")).when(F.col("side") == 3, F.col("x") - F.col("width")).otherwise(F.col("x") - F.col("width") / 2)
    return _round(at.select(F.col("id").alias("line"), "side", "label", left.alias("x"), F.when(F.col("side") >= 2, F.col("y") + 2.5).otherwise(F.col("y")).alias("y")), 2, "x", "y")


_TEXT_AT = """texts as (select p_partkey id, ['LEFT', 'CENTER', 'RIGHT'][p_partkey % 3 + 1] align, case when p_partkey % 3 = 2 then reverse(p_name) else p_name end label from part),
 chars as (select *, sum(width) over (partition by id order by pos) - width anchor, sum(width) over (partition by id) total, first(width) over (partition by id order by pos) head
  from (select id, align, pos - 1 pos, label[pos] char, (ascii(label[pos]) % 7 + 4) / 10e0 * 3 width from (select *, unnest(range(1, length(label) + 1)) pos from texts))),
 ways as (select p_partkey id, seq, (20 + p_partkey % 7) * cos(seq * 0.05e0) x, (20 + p_partkey % 7) * sin(seq * 0.05e0) y from part, (select unnest(range(0, 61)) seq)),
 run as (select *, sum(d) over (partition by id order by seq) arc from (select *, coalesce(sqrt((x - lag(x) over w) * (x - lag(x) over w) + (y - lag(y) over w) * (y - lag(y) over w)), 0e0) d from ways window w as (partition by id order by seq))),
 ends as (select c.*, length, case align when 'LEFT' then anchor when 'CENTER' then anchor + (length / 2 - total / 2) else length - (anchor + width) end t0, case align when 'LEFT' then anchor + width when 'CENTER' then anchor + width + (length / 2 - total / 2) else length - anchor end t1
  from chars c join (select id, sum(d) length from run group by id) l on c.id = l.id),
 near as (select e.id, e.pos, e.char, any_value(case when align = 'LEFT' then head * -0.3e0 else 0e0 end) shift, min_by(r.seq, (abs(arc - t0), r.seq)) s0, min_by(r.seq, (abs(arc - t1), r.seq)) s1 from ends e join run r on e.id = r.id group by e.id, e.pos, e.char)"""


@query("select n.id, cast(n.pos as int) pos, char, round(a.x + shift, 3) + 0e0 x, round(a.y, 3) + 0e0 y, round(atan2(b.y - a.y, b.x - a.x), 3) + 0e0 angle from near n join ways a on a.id = n.id and a.seq = s0 join ways b on b.id = n.id and b.seq = s1 where s0 <> s1", _TEXT_AT)
def g09_text_along_paths(spark, d):
    """Part names along arcs, from the left, in the middle, from the right."""
    t = rel.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"))
    ways = t.select("id", F.explode(F.sequence(F.lit(0), F.lit(60))).alias("seq"))
    radius, turn = F.lit(20) + F.col("id") % 7, F.col("seq") * F.lit(0.05)
    ways = ways.select("id", "seq", (radius * F.cos(turn)).alias("x"), (radius * F.sin(turn)).alias("y"))
    align = F.element_at(F.array(F.lit("LEFT"), F.lit("CENTER"), F.lit("RIGHT")), (F.col("id") % 3 + 1).cast("int"))
    found = text.along_paths(text.laid_out(t.withColumn("align", align), _letters(t), 3.0), ways)
    return _round(found.select("id", "pos", "char", "x", "y", "angle"), 3, "x", "y", "angle")


@query("""select font, char, round(case when k % 3 = 0 then 600 else 100 + k % 9 * 50 end / 800e0, 4) + 0e0 advance, cast(case when k % 5 = 0 then 0 else 2 end as int) n_parts, round(case when k % 5 = 0 then null else k % 11 * 10 / 800e0 end, 4) + 0e0 last_x, round(case when k % 5 = 0 then null else -(k % 13 - 5) * 10 / 800e0 end, 4) + 0e0 last_y
 from (select p_partkey font, unnest(['a', '&', '"', 'é']) as char, p_partkey + unnest([0, 1, 2, 3]) k from part)""")
def s09_svg_fonts(spark, d):
    """Glyph tables of SVG fonts, a small one for each part."""
    k = lambda i: f"(p_partkey + {i})"
    glyph = lambda i, mark: f"""concat('<glyph unicode="', '{mark}', '"', if({k(i)} % 3 = 0, '', concat(' horiz-adv-x="', 100 + {k(i)} % 9 * 50, '"')), if({k(i)} % 5 = 0, '', concat(' d="M0 0 L 5 -7.5 M1 1 L ', {k(i)} % 11 * 10, ' ', ({k(i)} % 13 - 5) * 10, '"')), '/>')"""
    xml = "concat('<svg><font id=\"f\" horiz-adv-x=\"600\"><font-face units-per-em=\"800\" cap-height=\"500\"/>', " + ", ".join(glyph(i, m) for i, m in enumerate(("a", "&amp;", "&quot;", "&#xe9;"))) + ", '</font></svg>')"
    found = text.glyphs(rel.table(spark, d, "part").select(F.col("p_partkey").alias("font"), F.expr(xml).alias("xml")))
    last = F.element_at(F.flatten("parts"), -1)
    return _round(found.select("font", "char", "advance", F.size("parts").alias("n_parts"), F.when(F.size("parts") > 0, last["x"]).alias("last_x"), F.when(F.size("parts") > 0, last["y"]).alias("last_y")), 4, "advance", "last_x", "last_y")


# ---- cleaning

_RINGS = """corners as (select p_partkey id, k, p_partkey % 50 + u * r x, p_partkey // 50 % 40 + v * r y from (select *, p_partkey * (k + 3) % 7 - 1e0 r from part, (values (0, 1e0, 0e0), (1, 0.5e0, 0.9e0), (2, -0.5e0, 0.9e0), (3, -1e0, 0e0), (4, -0.5e0, -0.9e0), (5, 0.5e0, -0.9e0)) t(k, u, v))),
 sides as (select a.id, a.k, a.x x1, a.y y1, b.x x2, b.y y2 from corners a join corners b on a.id = b.id and b.k = (a.k + 1) % 6),
 crossed as (select distinct a.id from sides a join sides b on a.id = b.id and a.k < b.k
  where sign((a.x2 - a.x1) * (b.y1 - a.y1) - (a.y2 - a.y1) * (b.x1 - a.x1)) * sign((a.x2 - a.x1) * (b.y2 - a.y1) - (a.y2 - a.y1) * (b.x2 - a.x1)) < 0
  and sign((b.x2 - b.x1) * (a.y1 - b.y1) - (b.y2 - b.y1) * (a.x1 - b.x1)) * sign((b.x2 - b.x1) * (a.y2 - b.y1) - (b.y2 - b.y1) * (a.x2 - b.x1)) < 0),
 measured as (select id, abs(list_sum(list(x1 * y2 - x2 * y1 order by k)) / 2) area, abs(list_sum(list(radians(x2 - x1) * (2 + sin(radians(y1)) + sin(radians(y2))) order by k)) * (6378137e0 * 6378137e0 / 2)) sphere from sides group by id)"""


@query("select fate, cast(count(*) as bigint) n, round(sum(area), 2) + 0e0 area from (select *, case when id in (select id from crossed) then 'invalid' when area < 1e-9 then 'empty' when sphere < 2e10 or area < 3 then 'small' else 'kept' end fate from measured) group by fate", _RINGS)
def p06_a05_p01_p15_cleaning(spark, d):
    """What each step of cleaning takes, of a polygon for each part, some of which cross themselves."""
    ways = [(1.0, 0.0), (0.5, 0.9), (-0.5, 0.9), (-1.0, 0.0), (-0.5, -0.9), (0.5, -0.9), (1.0, 0.0)]
    corner = lambda k, u, v: f"struct(p_partkey % 50 + {u!r}D * (p_partkey * {k % 6 + 3} % 7 - 1D) as x, floor(p_partkey / 50) % 40 + {v!r}D * (p_partkey * {k % 6 + 3} % 7 - 1D) as y)"
    shapes = rel.table(spark, d, "part").selectExpr("p_partkey as id", f"array(array({', '.join(corner(k, u, v) for k, (u, v) in enumerate(ways))})) as rings")
    found = cleaning.marked(cleaning.unpack(shapes), 2e10, 3.0)
    return _round(found.groupBy("fate").agg(F.count("*").alias("n"), F.sum(F.abs(geo.ring_area(F.col("ring")))).alias("area")), 2, "area")


# ---- documents

_HEAD = '<?xml version="1.0" encoding="utf-8"?>\n<svg xmlns="http://www.w3.org/2000/svg" width="750mm" height="500mm" viewBox="0 0 750 500">\n<style>.layer0 { fill: none; stroke: black }</style>'


@query(f"""select place, section, seq, line from (
 select cast(layer as bigint) place, 1 section, seq, '<path d="' || printf('M%.2f %.2f L%.2f %.2f', x1, y1, x2, y2) || '"/>' line from segments
 union all select 99, 1, id, '<path d="' || string_agg(printf('%s%.2f %.2f', case k when 0 then 'M' else 'L' end, px, py), ' ' order by k) || ' Z"/>' from zones group by id
 union all select distinct cast(layer as bigint), 0, 0, '<g id="layer' || layer || '" class="layer' || layer || '">' from segments union all select distinct cast(layer as bigint), 2, 0, '</g>' from segments
 union all select 99, 0, 0, '<g id="zones" class="zones">' union all select 99, 2, 0, '</g>'
 union all select -1, 0, 0, '{_HEAD}' union all select 9223372036854775807, 2, 0, '</svg>')""", "segments", "zones")
def k03_svg_document(spark, d):
    """Strokes by layer and zones as polygons in one document."""
    own = output.svg_lines(rel.segments(spark, d)).select(F.col("layer").cast("long").alias("place"), F.concat(F.lit("layer"), "layer").alias("layer"), "seq", "d")
    ring = F.transform(F.sort_array(F.collect_list(F.struct("k", "px", "py"))), lambda p: F.struct(p["px"].alias("x"), p["py"].alias("y")))
    zones = rel.zones(spark, d).groupBy("id").agg(ring.alias("ring")).select(F.lit(99).cast("long").alias("place"), F.lit("zones").alias("layer"), F.col("id").alias("seq"), geo.polygon_data(F.array("ring")).alias("d"))
    return output.svg_document(own.unionByName(zones), 750, 500, {"layer0": "fill: none; stroke: black"})


_SHAPES = [("edges", "line", 0, 0, "x1, y1, x2, y2"), ("boxes", "path", 0, 0, "x1, y1, x2, y2"), ("boxes", "path", 0, 1, "x2, y2, x1, y2"), ("boxes", "path", 0, 2, "x1, y2, x1, y1")]
_SHAPES += [("boxes", "rect", 1, i, e) for i, e in enumerate(("x1, y1, x1 + 5, y1", "x1 + 5, y1, x1 + 5, y1 + 2.5e0", "x1 + 5, y1 + 2.5e0, x1, y1 + 2.5e0", "x1, y1 + 2.5e0, x1, y1"))]


@query("select * from (" + " union all ".join(f"select layer || ' ' || seq, '{g}', '{kind}', {no}, {i}, {ends} from segments" for g, kind, no, i, ends in _SHAPES) + ") t(file, layer, kind, path_no, part, x1, y1, x2, y2)", "segments")
def s10_p03_svg_shapes(spark, d):
    """Shapes of small documents, one for each stroke, in the layers that are asked for."""
    t = rel.segments(spark, d)
    line = F.format_string('<svg><g id="edges"><circle r="3"/><line x1="%.1f" y1="%.1f" x2="%.1f" y2="%.1f"/></g><path d="M1 1 L 2 2"/>', *segments.ENDS)
    path = F.format_string('<g id="boxes"><path d="M%.1f %.1f L %.1f %.1f L %.1f %.1f Z"/><rect x="%.1f" y="%.1f" width="5" height="2.5"/></g></svg>', "x1", "y1", "x2", "y2", "x1", "y2", "x1", "y1")
    found = files.svg_shapes(t.select(F.concat_ws(" ", "layer", "seq").alias("file"), F.concat(line, path).alias("value")))
    return found.where(F.col("layer").isin("edges", "boxes")).drop("ring").withColumn("part", F.col("part").cast("int"))


# ---- meshes, tiles and arithmetic

_FACES = """faces as (select a.y, a.x, half, case half when 0 then a.x else a.x + 1 end * {s} x1, a.y * {s} y1, case half when 0 then a.z else b.z end z1, a.x * {s} x2, (a.y + 1) * {s} y2, c.z z2,
 (a.x + 1) * {s} x3, case half when 0 then a.y else a.y + 1 end * {s} y3, case half when 0 then b.z else d.z end z3
 from cells a join cells b on b.y = a.y and b.x = a.x + 1 join cells c on c.y = a.y + 1 and c.x = a.x join cells d on d.y = a.y + 1 and d.x = a.x + 1, (values (0), (1)) h(half))"""


@query("""select y, x, half, printf('facet normal %.4f %.4f %.4f', round(nx / n, 4) + 0e0, round(ny / n, 4) + 0e0, round(nz / n, 4) + 0e0) || chr(10) || 'outer loop' || chr(10) || printf('vertex %.3f %.3f %.3f', x1, y1, z1) || chr(10) || printf('vertex %.3f %.3f %.3f', x2, y2, z2) || chr(10) || printf('vertex %.3f %.3f %.3f', x3, y3, z3) || chr(10) || 'endloop' || chr(10) || 'endfacet' facet
 from (select *, sqrt(nx * nx + ny * ny + nz * nz) n from (select *, (y2 - y1) * (z3 - z1) - (z2 - z1) * (y3 - y1) nx, (z2 - z1) * (x3 - x1) - (x2 - x1) * (z3 - z1) ny, (x2 - x1) * (y3 - y1) - (y2 - y1) * (x3 - x1) nz from faces))""", "cells", _FACES.format(s="1e0"))
def k06_stl_facets(spark, d):
    return mesh.stl_facets(mesh.triangles(rel.cells(spark, d)))


@query("""select y, x, round(max(p * z1 + q * z2 + (1 - p - q) * z3), 4) + 0e0 z from (
 select *, ((y2 - y3) * (gx + 0.5e0 - x3) + (x3 - x2) * (gy + 0.5e0 - y3)) / det p, ((y3 - y1) * (gx + 0.5e0 - x3) + (x1 - x3) * (gy + 0.5e0 - y3)) / det q, gy y, gx x from (
  select * exclude (y, x), (y2 - y3) * (x1 - x3) + (x3 - x2) * (y1 - y3) det, unnest(range(cast(floor(least(x1, x2, x3)) as bigint) - 1, cast(ceil(greatest(x1, x2, x3)) as bigint) + 1)) gx from faces), lateral (select unnest(range(cast(floor(least(y1, y2, y3)) as bigint) - 1, cast(ceil(greatest(y1, y2, y3)) as bigint) + 1)) gy))
 where p >= 0 and q >= 0 and p + q <= 1 group by y, x""", "cells", _FACES.format(s="1.7313e0"))
def s16_mesh_heights(spark, d):
    """The raster as a mesh of another scale, and its height above each cell's centre."""
    return _round(mesh.heights(mesh.triangles(rel.cells(spark, d), 1.7313)), 4, "z")


@query("select tile_y, tile_x, rows, columns, n from (select cast(floor(y / 7e0) as int) tile_y, cast(floor(x / 7e0) as int) tile_x, cast(max(y) - min(y) + 1 as int) rows, cast(max(x) - min(x) + 1 as int) columns, cast(count(*) as bigint) n from cells group by 1, 2) where least(rows, columns) >= 3", "cells")
def p13_whole_tiles(spark, d):
    return raster.whole_tiles(rel.cells(spark, d), 7)


@query("""select gx + 0 y, gy + 0 x, z from (select *, unnest(case when x = x0 then range(x0 - 2, x0 + 1) when x = x1 then range(x1, x1 + 3) else [x] end) gx from (
 select *, unnest(case when y = y0 then range(y0 - 2, y0 + 1) when y = y1 then range(y1, y1 + 3) else [y] end) gy from cells, (select min(y) y0, max(y) y1, min(x) x0, max(x) x1 from cells)))""", "cells")
def f61_pad_transpose(spark, d):
    """The raster widened by two cells of its edge's values, rows and columns exchanged."""
    padded = raster.transpose(raster.pad_edge(rel.cells(spark, d), 2))
    return padded.select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "z")


@query("""select y, x, round(a - 2 * pi() * floor(a / (2 * pi())), 6) + 0e0 turned, 255 - code inverse, round(code / 255e0 * (2 * pi()) - pi(), 6) + 0e0 decoded, round(0.3e0 + code / 255e0 * (5 - 0.3e0), 6) distance
 from (select *, atan2(v, u) a, cast(floor((atan2(v, u) + pi()) / (2 * pi()) * 255) as int) code from uv)""", "uv")
def f32_f34_f35_f36_bytes(spark, d):
    """Angles turned to 0..2 pi, bytes inverted, decoded to angles, and mapped to a range."""
    t = rel.uv(spark, d).withColumn("a", F.atan2("v", "u"))
    t = t.withColumn("code", raster.encode_angle(F.col("a")))
    return _round(t.select("y", "x", geo.turn(F.col("a")).alias("turned"), (F.lit(255) - F.col("code")).alias("inverse"), raster.decode_angle(F.col("code")).alias("decoded"), geo.from_byte(F.col("code"), 0.3, 5.0).alias("distance")), 6, "turned", "decoded", "distance")


@query(r"select page_id, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '^(.+)\.[^.]*$', '\1') stem, regexp_extract(url, '[^/](\.[^./]*)$', 1) suffix from pages")
def f56_file_names(spark, d):
    t = rel.table(spark, d, "pages")
    return t.select("page_id", geo.stem(F.col("url")).alias("stem"), geo.suffix(F.col("url")).alias("suffix"))


@query("select level, y, x, z from cells join bands on case when low <= high then z > low and z <= high else z >= high and z < low end where level >= 2 and z < 900", "cells", _BANDS_SQL)
def p04_levels_by_parameter(spark, d):
    """A filter behind a join, its bounds given as parameters of the statement."""
    sliced = raster.slice_levels(rel.cells(spark, d), BANDS)
    return spark.sql("select level, y, x, z from {sliced} where level >= :least and z < :below", args={"least": 2, "below": 900.0}, sliced=sliced)


@query(f"""select level, y, x, side from (select l.level, l.y, l.x, f.side from land l, (values (0, -1, 0), (1, 0, 1), (2, 1, 0), (3, 0, -1)) f(side, dy, dx)
 where not exists (select 1 from land o where o.level = l.level and o.y = l.y + f.dy and o.x = l.x + f.dx))""", "cells", _BANDS_SQL, "land as (select level, cast(y as bigint) y, cast(x as bigint) x from cells join bands on case when low <= high then z > low and z <= high else z >= high and z < low end)")
def g23_level_outlines(spark, d):
    """Shells and holes of all levels as lines: the sides of cells, of which each is in a ring."""
    page = 1_000_000
    shifted = raster.slice_levels(rel.cells(spark, d), BANDS).select((F.col("y") + F.col("level") * page).alias("y"), "x")
    rings = raster.region_rings(shifted).where("ring is not null and seq >= 0")
    return rings.select(F.floor(F.col("y") / page).cast("int").alias("level"), (F.col("y") % page).alias("y"), "x", "side")


# ---- SQL for queries of `catalog` that need a statement of several parts


def _also(name: str, body: str, *needs: str, recursive: bool = False) -> None:
    """Give a query of `catalog` its SQL; `needs` as in `query`."""
    head = ", ".join([*(rel.SQL[n] for n in needs if n in rel.SQL), *(n for n in needs if n not in rel.SQL)])
    ORACLE_SQL[name] = f"with {'recursive ' if recursive else ''}{head} {body}"


_SLOPES = "select y, x, coalesce((lead(z) over r - lag(z) over r) / 2, lead(z) over r - z, z - lag(z) over r, 0e0) dx, coalesce((lead(z) over c - lag(z) over c) / 2, lead(z) over c - z, z - lag(z) over c, 0e0) dy from cells window r as (partition by y order by x), c as (partition by x order by y)"
_MASK = f"select y, x, case when degrees(atan2(dy, dx)) > 65 and degrees(atan2(dy, dx)) < 205 and sqrt(dx * dx + dy * dy) >= 50 then 1 else 0 end m from ({_SLOPES})"
_also("w15_orientation_mask", f"select y, x, clean from ({_extreme(_extreme(_extreme(_extreme(_MASK, 'min', 'm', 'a'), 'max', 'a', 'b'), 'max', 'b', 'c'), 'min', 'c', 'clean')})", "cells")
_TPI = ORACLE_SQL["w04_position_index"].split(" select y, x, coalesce", 1)[1]
_also("w05_adaptive_smoothing", f"""select t.y, t.x, cast(trunc(coalesce(abs(tpi) / top, 0e0) * trunc(f.s / f.n) + (1 - coalesce(abs(tpi) / top, 0e0)) * trunc(a.s / a.n)) as int) smooth
 from tpi t join ({_box(7)}) f on t.y = f.y and t.x = f.x join ({_box(3)}) a on t.y = a.y and t.x = a.x, (select nullif(abs(max(tpi)), 0e0) top from tpi)""", "cells", f"tpi as materialized (select y, x, coalesce{_TPI})")
_also("g25_blob_centres", "select cast((region // 100000) * 4294967296 + region % 100000 as bigint) region, round(avg(y), 4) + 0e0 y, round(avg(x), 4) + 0e0 x, cast(count(*) as bigint) n from blobs group by region", "cells", "high as (select 0 level, y, x from cells where z > 200)", _touching("blobs", "high", True), recursive=True)

_WAY = "select layer, cast(row_number() over (partition by layer order by seq) - 1 as int) seq, x1 x, y1 y from segments"
for _k in (0.7, -0.2) * 5:
    _mean = lambda c: f"coalesce({c} + {_k!r}e0 * ((lag({c}) over w + lead({c}) over w) / 2 - {c}), {c})"
    _WAY = f"select layer, seq, {_mean('x')} x, {_mean('y')} y from ({_WAY}) window w as (partition by layer order by seq)"
_also("f05_taubin_smoothing", f"select layer, seq, round(x, 6) + 0e0 x, round(y, 6) + 0e0 y from ({_WAY})", "segments")

_NEWTON = "list_reduce([phi / 2] || range(12)::double[], lambda t, i: t - (t + sin(t) * cos(t) + 2 * sin(t) - (2 + pi() / 2) * sin(phi)) / greatest(2 * cos(t) * (1 + cos(t)), 1e-12))"
_also("f24_eckert_iv", f"""select id, round(2 * 6378137 / sqrt(pi() * (4 + pi())) * radians(lon) * (1 + cos(theta)), 1) + 0e0 x, round(2 * 6378137 * sqrt(pi() / (4 + pi())) * sin(theta), 1) + 0e0 y
 from (select id, lon, {_NEWTON} theta from (select id, lon, radians(lat) phi from places))""", "places")

_also("w09_w13_budgeted_files", "select layer, seq, file, dip from fold where n > 0", "segments",
 "strokes as materialized (select *, row_number() over (partition by layer order by seq) n, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) d from segments)",
 """fold as (select distinct layer, cast(null as bigint) seq, cast(0 as int) file, false dip, cast(0 as bigint) n, 0e0 run, 0e0 ink from strokes union all
 select layer, seq, file, ink + d > 120, n, run, case when ink + d > 120 then 0e0 else ink + d end from (
  select s.layer, s.seq, f.file + cast(f.run + s.d > 5000 as int) file, case when f.run + s.d > 5000 then 0e0 else f.run + s.d end run, case when f.run + s.d > 5000 then 0e0 else f.ink end ink, s.n, s.d
  from fold f join strokes s on s.layer = f.layer and s.n = f.n + 1))""", recursive=True)

_also("j05_label_regions", "select p.id, coalesce(min(r.f), p.id) region from places p left join reach r on r.id = p.id group by p.id", "places",
 "positions(angle, align) as (values " + ", ".join(f"({a}, '{al}')" for _, a, al, _ in places.POSITIONS) + ")",
 """envelopes as materialized (select id, min(x - 1) a, max(x + w + 1) b, min(y - 3.5e0) c, max(y + 3.5e0) d from (select id, lat + 5 * sin(radians(angle)) y, length(label) * 3e0 w,
  lon + 5 * cos(radians(angle)) - case align when 'LEFT' then 0e0 when 'RIGHT' then length(label) * 3e0 else length(label) * 1.5e0 end x from places, positions) group by id)""",
 "met as materialized (select p.id, o.id other from envelopes p join envelopes o on p.id <> o.id and p.a < o.b and o.a < p.b and p.c < o.d and o.c < p.d)",
 "reach as (select id, id f from envelopes union select m.other, r.f from reach r join met m on m.id = r.id and m.other > r.f)", recursive=True)
