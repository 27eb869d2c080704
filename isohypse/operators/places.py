"""Label placement on places (id, label, x, y, population): band joins on grid cells, candidates, elimination."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components

# Fixed positions of a label about its point: key, angle in degrees, alignment, error.
POSITIONS = [
    ("top-right", 315, "LEFT", 0), ("top-left", 225, "RIGHT", 1), ("bottom-right", 45, "LEFT", 2), ("bottom-left", 135, "RIGHT", 3),
    ("center-right", 0, "LEFT", 4), ("center-top", 270, "CENTER", 5), ("center-left", 180, "RIGHT", 6), ("center-bottom", 90, "CENTER", 7),
]


def band_pairs(left: DataFrame, right: DataFrame, reach: float) -> DataFrame:
    """Rows of `left` (id, x, y, ...) with those of `right` (o_id, o_x, o_y, ...) within `reach` on both axes.

    `right` is put in the 3 by 3 cells about its own, so the join is by equal cells.
    """
    cell = lambda c: F.floor(F.col(c) / reach)
    a = left.withColumn("cx", cell("x")).withColumn("cy", cell("y"))
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    b = right.withColumn("cx", cell("o_x")).withColumn("cy", cell("o_y")).withColumn("_a", F.explode(near)).withColumn("_b", F.explode(near))
    b = b.withColumn("cx", F.col("cx") + F.col("_a")).withColumn("cy", F.col("cy") + F.col("_b")).drop("_a", "_b")
    return a.join(b, ["cx", "cy"]).where((F.abs(F.col("x") - F.col("o_x")) <= reach) & (F.abs(F.col("y") - F.col("o_y")) <= reach)).drop("cx", "cy")


def box_pairs(boxes: DataFrame) -> DataFrame:
    """a, b: ids, a < b, of boxes (id, xmin, ymin, xmax, ymax) that overlap.

    Boxes are put in all cells they touch, cells as wide and high as the largest box, so in four at most.
    A pair is formed only in the cell of its overlap's least corner. The one row of extents is broadcast.
    """
    sides = [F.greatest(F.max(F.col(f"{c}max") - F.col(f"{c}min")), F.lit(1.0)).alias(f"_{c}") for c in "xy"]
    b = boxes.select("id", "xmin", "ymin", "xmax", "ymax")
    b = b.crossJoin(F.broadcast(b.agg(*sides)))
    for c in "xy":
        b = b.withColumn(f"c{c}", F.explode(F.sequence(F.floor(F.col(f"{c}min") / F.col(f"_{c}")), F.floor(F.col(f"{c}max") / F.col(f"_{c}")))))
    other = b.select("cx", "cy", *[F.col(c).alias(f"o_{c}") for c in ("id", "xmin", "ymin", "xmax", "ymax")])
    hit = F.col("id") < F.col("o_id")
    for c in "xy":
        hit = hit & (F.col(f"{c}min") < F.col(f"o_{c}max")) & (F.col(f"o_{c}min") < F.col(f"{c}max")) & (F.floor(F.greatest(f"{c}min", f"o_{c}min") / F.col(f"_{c}")) == F.col(f"c{c}"))
    return b.join(other, ["cx", "cy"]).where(hit).select(F.col("id").alias("a"), F.col("o_id").alias("b"))


def _touching(x0, y0, x1, y1) -> list[int]:
    """For each box one box of those that it is connected with by overlaps, the same for all of them.

    A sweep along x over a tree of intervals in y. A node keeps, of the boxes that take up its whole interval, the one that reaches
    furthest, as these overlap as long as they last; and those that take up any part of it, of which two that follow each other
    and are connected already count as one. So n boxes take n log n steps, however many pairs overlap.
    """
    import numpy as np

    ys = np.unique(np.concatenate((y0, y1)))
    size = 1 << max(1, int(len(ys) - 1).bit_length())
    low, high, order = np.searchsorted(ys, y0).tolist(), np.searchsorted(ys, y1).tolist(), np.argsort(x0, kind="stable").tolist()
    begin, end = x0.tolist(), x1.tolist()
    whole, some = [-1] * (2 * size), [None] * (2 * size)
    up = list(range(len(begin)))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i in order:
        if low[i] >= high[i] or begin[i] >= end[i]:
            continue
        root, x = i, begin[i]
        paths, own = set(), []
        for node in (low[i] + size, high[i] - 1 + size):
            while node and node not in paths:
                paths.add(node)
                node >>= 1
        a, b = low[i] + size, high[i] + size
        while a < b:
            if a & 1:
                own.append(a)
                a += 1
            if b & 1:
                b -= 1
                own.append(b)
            a >>= 1
            b >>= 1
        for node in (*paths, *own):
            j = whole[node]
            if j >= 0 and end[j] > x:
                up[top(j)] = root
        for node in own:
            if some[node]:
                left = [j for j in some[node] if end[j] > x]
                for j in left:
                    up[top(j)] = root
                some[node] = [max(left, key=end.__getitem__)] if left else None
            if whole[node] < 0 or end[whole[node]] < end[i]:
                whole[node] = i
        for node in paths:
            if not some[node]:
                some[node] = [i]
            elif top(some[node][-1]) == root:
                if end[some[node][-1]] < end[i]:
                    some[node][-1] = i
            else:
                some[node].append(i)
    return [top(i) for i in range(len(up))]


def box_links(boxes: DataFrame) -> DataFrame:
    """a, b: links by which boxes (id, xmin, ymin, xmax, ymax) are connected just as by all pairs that overlap, four at most for each box.

    Boxes are put in all cells they touch, as in `box_pairs`; in a cell each box is linked with the least id that overlaps lead to.
    """
    import numpy as np
    import pyarrow as pa

    def run(group: pa.Table) -> pa.Table:
        ids = group["id"].to_numpy()
        tops = np.array(_touching(*(group[c].to_numpy() for c in ("xmin", "ymin", "xmax", "ymax"))), np.int64)
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, tops, ids)
        link = least[tops] < ids
        return pa.table({"a": least[tops][link], "b": ids[link]})

    sides = ["xmin", "ymin", "xmax", "ymax"]
    b = boxes.select(F.col("id").cast("long").alias("id"), *sides).dropna()
    b = b.crossJoin(F.broadcast(b.agg(*[F.greatest(F.max(F.col(f"{c}max") - F.col(f"{c}min")), F.lit(1.0)).alias(f"_{c}") for c in "xy"])))
    for c in "xy":
        b = b.withColumn(f"c{c}", F.explode(F.sequence(F.floor(F.col(f"{c}min") / F.col(f"_{c}")), F.floor(F.col(f"{c}max") / F.col(f"_{c}")))))
    return b.select("cx", "cy", "id", *sides).groupBy("cx", "cy").applyInArrow(run, "a long, b long")


def label_regions(boxes: DataFrame) -> DataFrame:
    """id, region: places connected by overlaps of the envelopes of their candidate boxes (id, xmin, ymin, xmax, ymax)."""
    whole = boxes.groupBy("id").agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))
    return components(whole.select("id"), box_links(whole))


def drop_crowded(places: DataFrame, reach: float) -> DataFrame:
    """Without places within `reach` on both axes of a more populous one (equals: the smaller id), dropped or not."""
    other = places.select(F.col("id").alias("o_id"), F.col("x").alias("o_x"), F.col("y").alias("o_y"), F.col("population").alias("o_population"))
    over = (F.col("o_population") > F.col("population")) | ((F.col("o_population") == F.col("population")) & (F.col("o_id") < F.col("id")))
    crowded = band_pairs(places, other, reach).where(over).select("id").distinct()
    return places.join(crowded, "id", "left_anti")


def overlap_counts(places: DataFrame, reach: float) -> DataFrame:
    """id, overlaps: other places within `reach` on both axes."""
    other = places.select(F.col("id").alias("o_id"), F.col("x").alias("o_x"), F.col("y").alias("o_y"))
    n = band_pairs(places.select("id", "x", "y"), other, reach).where("id <> o_id").groupBy("id").agg(F.count("*").alias("overlaps"))
    return places.select("id").join(n, "id", "left").select("id", F.coalesce("overlaps", F.lit(0)).cast("long").alias("overlaps"))


def candidates(places: DataFrame, offset: float = 5.0, width: float = 0.6, height: float = 5.0, margin: float = 1.0) -> DataFrame:
    """id, key, error, xmin, ymin, xmax, ymax: eight boxes a place; the positions are a fixed list, broadcast."""
    table = places.sparkSession.createDataFrame(POSITIONS, "key string, angle int, align string, error int")
    wide = F.length("label") * F.lit(width * height)
    x = F.col("x") + offset * F.cos(F.radians("angle"))
    x = F.when(F.col("align") == "LEFT", x).when(F.col("align") == "RIGHT", x - wide).otherwise(x - wide / 2)
    y = F.col("y") + offset * F.sin(F.radians("angle"))
    out = places.crossJoin(F.broadcast(table))
    return out.select("id", "key", "error", (x - margin).alias("xmin"), (y - height / 2 - margin).alias("ymin"), (x + wide + margin).alias("xmax"), (y + height / 2 + margin).alias("ymax"))


def _overlap(a, b):
    return (a[:, 0, None] < b[None, :, 2]) & (b[None, :, 0] < a[:, 2, None]) & (a[:, 1, None] < b[None, :, 3]) & (b[None, :, 1] < a[:, 3, None])


def place_labels(boxes: DataFrame, places: DataFrame, rounds: int = 10000, seed: int = 1, radius: float = 1.5) -> DataFrame:
    """id, key, kept: per region (column `region` of places), the state of least error found, then greedy elimination.

    A state takes one box a place. A place's error is 100 for each other place's box and for each circle
    about a point, its own included, that its box overlaps, and the position's error; all weighted by
    1 + priority. Circles count by the squares about them. Each round tries another box for one place,
    drawn from a seed by region. By population, a label is kept if its box hits no kept box or circle,
    and its circle no kept box.
    """
    import numpy as np
    import pandas as pd

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["population", "id", "error"], ascending=[False, True, True])
        ids = group.id.drop_duplicates().to_numpy()
        n = len(ids)
        # rounded, so that boxes that touch don't overlap by an error of the last digit
        box = group[["xmin", "ymin", "xmax", "ymax"]].to_numpy().round(9).reshape(n, 8, 4)
        at = group[["x", "y"]].to_numpy().reshape(n, 8, 2)[:, 0]
        circle = np.concatenate((at - radius, at + radius), 1).round(9)
        weight = 1 + group.priority.to_numpy().reshape(n, 8)[:, 0]
        rng = np.random.default_rng(seed + int(group.region.iloc[0]) % 2**31)
        state, rows = np.zeros(n, int), np.arange(n)
        # what each box costs whatever the others are
        fixed = group.error.to_numpy().reshape(n, 8) + 100.0 * np.stack([[_overlap(b[None], circle).sum() for b in own] for own in box])
        own = box[rows, state]
        hits = np.array([_overlap(own[i : i + 1], own)[0].sum() - 1 for i in rows])
        best = float(((100 * hits + fixed[rows, state]) * weight).sum())
        for _ in range(rounds if n > 1 or best >= 1 else 0):
            i, k = int(rng.integers(n)), int(rng.integers(8))
            before, after = _overlap(own[i : i + 1], own)[0], _overlap(box[i, k][None], own)[0]
            before[i] = after[i] = False
            # an overlap counts for both places
            change = 100 * float((after * (weight + weight[i])).sum() - (before * (weight + weight[i])).sum()) + float(fixed[i, k] - fixed[i, state[i]]) * weight[i]
            if change < -1e-9:
                state[i], own[i], best = k, box[i, k], best + change
            if best < 1:
                break
        kept = []
        for i in range(n):
            if not kept or not (_overlap(own[i : i + 1], own[kept]).any() or _overlap(own[i : i + 1], circle[kept]).any() or _overlap(circle[i : i + 1], own[kept]).any()):
                kept.append(i)
        keys = group.key.to_numpy().reshape(n, 8)
        return pd.DataFrame({"id": ids, "key": keys[rows, state], "kept": np.isin(rows, kept)})

    return boxes.join(places.select("id", "x", "y", "region", "population", "priority"), "id").groupBy("region").applyInPandas(run, "id long, key string, kept boolean")
