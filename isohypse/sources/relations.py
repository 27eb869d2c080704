"""Map relations derived from the star-schema tables; see FIXTURES.md, part C."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y, x, z: a dense elevation grid. l_quantity is integral, so the average doesn't depend on the order."""
    t = table(spark, sf_dir, "lineitem")
    z = F.avg("l_quantity") * 100 - 2500
    return t.groupBy((F.col("l_suppkey") % 40).cast("int").alias("y"), (F.col("l_partkey") % 60).cast("int").alias("x")).agg(F.round(z, 6).alias("z"))


def uv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y, x, u, v: a current grid; absent components are 0, as masked cells are."""
    t = table(spark, sf_dir, "events")
    one = lambda kind: F.coalesce(F.round(F.avg(F.when(F.col("event_type") == kind, F.col("value"))), 6), F.lit(0.0))
    return t.groupBy(F.hour("ts").cast("int").alias("y"), (F.col("user_id") % 30).cast("int").alias("x")).agg(one("click").alias("u"), one("view").alias("v"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, lon, lat, population."""
    k = F.col("c_custkey").cast("double")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("label"),
        (k * 137.508 % 360 - 180).alias("lon"), (k * 61.803 % 160 - 80).alias("lat"),
        F.floor((F.col("c_acctbal") + 1000) * 500).cast("long").alias("population"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """layer, seq, x1, y1, x2, y2: pen strokes, with repeats; seq orders them within a layer."""
    d = lambda c, m: (F.col(c) % m).cast("double")
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 16).cast("int").alias("layer"), (((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100000 + F.col("l_partkey") % 100000) * 100 + F.col("l_quantity").cast("long")).alias("seq"),
        d("l_partkey", 50).alias("x1"), d("l_suppkey", 50).alias("y1"), d("l_orderkey", 50).alias("x2"), d("l_linenumber", 50).alias("y2"),
    )


#: Directions of a star's corners, counter-clockwise, as shares of its radius.
CORNERS = [(1.0, 0.0), (0.7071, 0.7071), (0.0, 1.0), (-0.7071, 0.7071), (-1.0, 0.0), (-0.7071, -0.7071), (0.0, -1.0), (0.7071, -0.7071)]


def _stars(rows: DataFrame, rank: str, cx: str, cy: str, radius: str) -> DataFrame:
    """id, zone_rank, k, px, py, qx, qy: the edges of a star about (cx, cy); `radius` is an expression of k."""
    corner = lambda k: [f"{cx} + {u!r}D * ({radius.replace('k', str(k))})" if u else f"{cx}" for u in CORNERS[k][:1]] + [f"{cy} + {v!r}D * ({radius.replace('k', str(k))})" if v else f"{cy}" for v in CORNERS[k][1:]]
    each = [f"struct({k} as k, {a[0]} as px, {a[1]} as py, {b[0]} as qx, {b[1]} as qy)" for k, (a, b) in enumerate((corner(k), corner((k + 1) % 8)) for k in range(8))]
    return rows.selectExpr("id", f"{rank} as zone_rank", f"explode(array({', '.join(each)})) as e").select("id", "zone_rank", "e.*")


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, zone_rank, k, px, py, qx, qy: a star-shaped polygon for each supplier, 40 in a row, five apart, so that neighbours overlap."""
    t = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    return _stars(t, "cast(id % 16 as int)", "(id % 40 * 5 + 0.3717D)", "(floor(id / 40) * 5 + 0.4139D)", "1.5137D + id * (k + 3) % 4 * 0.7519D")


def stencils(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same columns: a larger star for each nation."""
    t = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    return _stars(t, "cast(id % 16 as int)", "(id % 5 * 40 + 20.1379D)", "(floor(id / 5) * 3 + 4.2913D)", "5.0171D + id * (k + 2) % 5 * 1.5053D")


def _stars_sql(name: str, rows: str, cx: str, cy: str, radius: str) -> str:
    corners = ", ".join(f"({k}, {u!r}e0, {v!r}e0)" for k, (u, v) in enumerate(CORNERS))
    at = lambda c, t: f"{c} + {t}.u{'x' if c == cx else 'y'} * ({radius.replace('k', t + '.k')})"
    return (
        f"{name} as (select id, cast(id % 16 as int) zone_rank, a.k, {at(cx, 'a')} px, {at(cy, 'a')} py, {at(cx, 'b')} qx, {at(cy, 'b')} as qy"
        f" from ({rows}), (values {corners}) a(k, ux, uy), (values {corners}) b(k, ux, uy) where b.k = (a.k + 1) % 8)"
    )


#: The same relations in DuckDB's SQL.
SQL = {
    "zones": _stars_sql("zones", "select s_suppkey id from supplier", "(id % 40 * 5 + 0.3717e0)", "(id // 40 * 5 + 0.4139e0)", "1.5137e0 + id * (k + 3) % 4 * 0.7519e0"),
    "stencils": _stars_sql("stencils", "select cast(n_nationkey as bigint) id from nation", "(id % 5 * 40 + 20.1379e0)", "(id // 5 * 3 + 4.2913e0)", "5.0171e0 + id * (k + 2) % 5 * 1.5053e0"),
    "cells": "cells as (select cast(l_suppkey % 40 as int) y, cast(l_partkey % 60 as int) x, round(avg(l_quantity) * 100 - 2500, 6) z from lineitem group by 1, 2)",
    "uv": "uv as (select cast(hour(ts) as int) y, cast(user_id % 30 as int) x, coalesce(round(avg(case when event_type = 'click' then value end), 6), 0e0) u, coalesce(round(avg(case when event_type = 'view' then value end), 6), 0e0) v from events group by 1, 2)",
    "places": "places as (select c_custkey id, c_name label, c_custkey * 137.508e0 % 360 - 180 lon, c_custkey * 61.803e0 % 160 - 80 lat, cast(floor((c_acctbal + 1000) * 500) as bigint) population from customer)",
    "segments": "segments as (select cast(l_suppkey % 16 as int) layer, ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey % 100000) * 100 + cast(l_quantity as bigint) seq, cast(l_partkey % 50 as double) x1, cast(l_suppkey % 50 as double) y1, cast(l_orderkey % 50 as double) x2, cast(l_linenumber % 50 as double) y2 from lineitem)",
}
