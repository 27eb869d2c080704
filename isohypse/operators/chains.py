"""Directed links to ordered chains: rings and open paths, however long, without a group for each.

Links are chained inside blocks first. What crosses a block's edge is joined by pointer doubling on the
blocks' paths, in as many rounds as the logarithm of a chain's number of paths.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .raster import checkpoints


def _walk(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each link a -> b its path's first link, its place in the path, and whether the path is closed.

    No two links share a beginning or an end. A closed path begins at its least a.
    """
    order = np.argsort(a, kind="stable")
    at = np.minimum(np.searchsorted(a[order], b), max(0, len(a) - 1))
    following = np.where(a[order][at] == b, order[at], -1).tolist() if len(a) else []
    first, place, closed = np.full(len(a), -1), np.zeros(len(a), np.int64), np.zeros(len(a), bool)
    led = np.zeros(len(a), bool)
    led[[i for i in following if i >= 0]] = True
    for start in [*np.flatnonzero(~led).tolist(), *order.tolist()]:  # open paths from their beginnings, then rings from the least a
        if first[start] < 0:
            i, n, seen = start, 0, []
            while i >= 0 and first[i] < 0:
                first[i], place[i] = start, n
                seen.append(i)
                i, n = following[i], n + 1
            closed[seen] = i == start
    return first, place, closed


def chains(links: DataFrame) -> DataFrame:
    """`links` (a long, b long, block long, more columns) with chain, seq and closed.

    a and b are nodes; each begins one link and ends one at most. seq is a link's place in its chain, from 0.
    A ring (closed) is named by its least node and begins there; an open chain is named by its last node.
    Links of one block are chained in one task; blocks are to be of bounded size.
    """
    checkpoints(links.sparkSession)
    kind = StructType([StructField(f.name, f.dataType) for f in links.schema]).add("path", "long").add("place", "long").add("whole", "boolean")

    def inside(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        a = group["a"].to_numpy()
        first, place, closed = _walk(a, group["b"].to_numpy())
        for name, values in (("path", a[first]), ("place", place), ("whole", closed)):
            group = group.append_column(name, pa.array(values))
        return group

    walked = links.groupBy("block").applyInArrow(inside, kind).checkpoint()
    w = F.max(F.struct("place", "b"))
    paths = walked.where("not whole").groupBy("path").agg(w.alias("last")).selectExpr("path as start", "last.b as end", "last.place + 1 as n").checkpoint()
    # rings: the least start that is reached, by doubling; a path behind which none begins ends its chain
    now = paths.select("start", F.col("end").alias("to"), F.col("start").alias("low"), F.lit(False).alias("done")).checkpoint()
    while True:
        ahead = now.selectExpr("start as to", "to as next", "low as low2", "done as done2")
        step = now.join(ahead, "to", "left").selectExpr(
            "start", "coalesce(next, to) as to", "least(low, low2) as low", "done or next is null or done2 as done",
            "not done and next is not null and (done2 or low2 < low) as moved",
        ).checkpoint()
        if step.where("moved").isEmpty():
            break
        now = step.drop("moved")
    rings = step.where("not done").select("start", "low")
    # steps to the chain's end, a ring being cut before its least node
    cut = paths.join(rings, "start", "left").withColumn("stop", F.coalesce(F.col("end") == F.col("low"), F.lit(False)))
    now = cut.selectExpr("start", "end as to", "n as steps", "stop", "coalesce(low, end) as chain", "low is not null as ring").checkpoint()
    while True:
        ahead = now.selectExpr("start as to", "to as next", "steps as more", "stop as stop2", "chain as chain2")
        step = now.join(ahead, "to", "left").selectExpr(
            "start", "if(stop or next is null, to, next) as to", "if(stop or next is null, steps, steps + more) as steps", "stop or next is null or stop2 as stop",
            "if(stop or next is null, chain, chain2) as chain", "ring", "not stop and next is not null as moved",
        ).checkpoint()
        if step.where("moved").isEmpty():
            break
        now = step.drop("moved")
    ends = step.withColumn("total", F.max("steps").over(Window.partitionBy("chain"))).selectExpr("start as path", "chain as name", "total - steps as offset", "ring")
    columns = links.columns
    out = walked.join(ends, "path", "left").select(*columns, F.coalesce("name", "path").alias("chain"), (F.coalesce("offset", F.lit(0)) + F.col("place")).alias("seq"), F.coalesce("ring", F.lit(True)).alias("closed"))
    # a ring that was cut at a path begins at its least node instead
    turned = out.where("closed").groupBy("chain").agg(F.min("a").alias("least"), F.min_by("seq", "a").alias("shift"), F.count("*").alias("links"))
    out = out.join(turned, "chain", "left")
    return out.select(*columns, F.coalesce("least", "chain").alias("chain"), F.coalesce(F.expr("pmod(seq - shift, links)"), "seq").alias("seq"), "closed")
