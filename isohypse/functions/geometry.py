"""Projections, polygon measures and text along paths as Spark columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6378137.0
EQUATOR = 40075016.68557849


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def van_der_grinten(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Spherical Van der Grinten I (Snyder 1987, 29-1 to 29-6); beyond 180 degrees A is negated, which continues the curve."""
    zero = F.lit(0.0)

    def base(v):
        half = F.abs(F.lit(math.pi) / F.nullif(v["lam"], zero) - v["lam"] / math.pi) / 2
        cos = F.sqrt(F.greatest(zero, 1 - v["p"] * v["p"]))
        a = F.when(F.abs(v["lam"]) > math.pi, -half).otherwise(half)
        return F.struct(v["lam"].alias("lam"), v["phi"].alias("phi"), v["p"].alias("p"), a.alias("a"), (cos / F.nullif(v["p"] + cos - 1, zero)).alias("g"))

    def inner(v):
        return F.struct(*[v[c].alias(c) for c in ("lam", "phi", "p", "a", "g")], (v["g"] * (2 / F.nullif(v["p"], zero) - 1)).alias("q"))

    def across(v):
        a, g, q = v["a"], v["g"], v["q"]
        root = F.sqrt(F.greatest(zero, a * a * (g - q * q) * (g - q * q) - (q * q + a * a) * (g * g - q * q)))
        return F.struct(*[v[c].alias(c) for c in ("lam", "phi", "p", "a")], (F.abs(a * (g - q * q) + root) / (q * q + a * a)).alias("r"))

    def ends(v):
        up = F.sqrt(F.greatest(zero, 1 - v["r"] * v["r"] - 2 * v["a"] * v["r"]))
        pole = F.tan(F.asin(F.least(v["p"], F.lit(1.0))) / 2)
        on_axis = (v["lam"] == 0) | (v["p"] >= 1)
        x = F.when(v["phi"] == 0, v["lam"]).when(on_axis, zero).otherwise(F.signum(v["lam"]) * v["r"] * math.pi)
        y = F.when(v["phi"] == 0, zero).otherwise(F.signum(v["phi"]) * math.pi * F.when(on_axis, pole).otherwise(up))
        return F.struct((x * RADIUS).alias("x"), (y * RADIUS).alias("y"))

    start = F.struct(F.radians(lon).alias("lam"), F.radians(lat).alias("phi"), F.abs(2 * F.radians(lat) / math.pi).alias("p"))
    out = _let(_let(_let(_let(start, base), inner), across), ends)
    return out["x"], out["y"]


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * RADIUS, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * RADIUS


def sinusoidal(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * F.cos(F.radians(lat)) * RADIUS, F.radians(lat) * RADIUS


def eckert_iv(lon: Column, lat: Column, rounds: int = 12) -> tuple[Column, Column]:
    """Newton's method for theta + sin theta cos theta + 2 sin theta = (2 + pi / 2) sin phi, a fixed number of rounds."""
    phi = F.radians(lat)
    k = 2 + math.pi / 2
    theta = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), phi / 2, lambda t, _: t - (t + F.sin(t) * F.cos(t) + 2 * F.sin(t) - k * F.sin(phi)) / F.greatest(2 * F.cos(t) * (1 + F.cos(t)), F.lit(1e-12)))
    return 2 * RADIUS / math.sqrt(math.pi * (4 + math.pi)) * F.radians(lon) * (1 + F.cos(theta)), 2 * RADIUS * math.sqrt(math.pi / (4 + math.pi)) * F.sin(theta)


def to_map(x: Column, y: Column, width: float, height: float) -> tuple[Column, Column]:
    """Projected metres to millimetres on a page, origin top left."""
    k = width / EQUATOR
    return x * k + width / 2, -y * k + height / 2


def affine(x: Column, y: Column, m: tuple[float, float, float, float, float, float]) -> tuple[Column, Column]:
    a, b, d, e, xoff, yoff = m
    return x * a + y * b + xoff, x * d + y * e + yoff


def wrap_longitude(lon: Column) -> Column:
    return F.when(lon > 180, lon - 360).when(lon < -180, lon + 360).otherwise(lon)


def unlog(x: Column, n: float) -> Column:
    return (n + 1) * x / (n * x + 1)


def scale_text(width_mm: Column) -> Column:
    """The page's scale, equator and page both in millimetres."""
    return F.concat(F.lit("Scale: 1:"), F.floor(F.lit(40075.0 * 1000 * 1000) / width_mm).cast("string"))


def linspace(low: Column, high: Column, n: int, i: Column, closed: bool = True) -> Column:
    """The i-th of n equal steps from low; closed: the last one is high."""
    return low + i * ((high - low) / (n - 1 if closed else n))


def ring_area(ring: Column) -> Column:
    """Signed planar area of a closed ring array<struct<x,y>>."""
    pairs = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v) / 2


def spherical_area(ring: Column) -> Column:
    """Signed area on the sphere of a closed ring in degrees: within half a percent of the ellipsoid's."""
    pairs = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda p, q: F.radians(q["x"] - p["x"]) * (2 + F.sin(F.radians(p["y"])) + F.sin(F.radians(q["y"]))))
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v) * (RADIUS * RADIUS / 2)


def path_data(points: Column, closed: bool = False) -> Column:
    """An SVG path of two decimals: M, L ..., Z if closed."""
    steps = F.transform(points, lambda p, i: F.concat(F.when(i == 0, "M").otherwise("L"), F.format_string("%.2f %.2f", p["x"], p["y"])))
    return F.concat(F.array_join(steps, " "), F.lit(" Z" if closed else ""))


def polygon_data(rings: Column) -> Column:
    """An SVG path of a polygon's rings array<array<struct<x,y>>>, its holes as further closed parts."""
    return F.array_join(F.transform(rings, lambda r: path_data(r, True)), " ")


def turn(angle: Column) -> Column:
    """An angle in 0..2 pi: the remainder has the divisor's sign."""
    return F.pmod(angle, F.lit(2 * math.pi))


def from_byte(code: Column, low: float, high: float) -> Column:
    """0..255 mapped to low..high."""
    return F.lit(low) + code / 255 * F.lit(high - low)


def stem(name: Column) -> Column:
    """A path's last part without its suffix; a name that begins with its only dot has none."""
    last = F.regexp_extract(name, r"([^/]*)$", 1)
    return F.regexp_replace(last, r"(?<=.)\.[^.]*$", "")


def suffix(name: Column) -> Column:
    """The last dot of a path's last part and what follows, if anything stands before it."""
    return F.regexp_extract(name, r"[^/](\.[^./]*)$", 1)
