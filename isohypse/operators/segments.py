"""Pen strokes (layer, seq, x1, y1, x2, y2): dedup, filters, lifts and counters.

Order matters within a layer only, so windows are partitioned by layer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENDS = ["x1", "y1", "x2", "y2"]


def is_close(a: Column, b: Column, tolerance: float) -> Column:
    """Within the tolerance, or a billionth of the larger value."""
    return F.abs(a - b) <= F.greatest(F.lit(1e-9) * F.greatest(F.abs(a), F.abs(b)), F.lit(tolerance))


def distinct_segments(segments: DataFrame) -> DataFrame:
    """Distinct by exact ends; a reversed segment is another one."""
    return segments.select("layer", *ENDS).distinct()


def length() -> Column:
    return F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))


def drop_short_unconnected(segments: DataFrame, least: float = 0.10) -> DataFrame:
    """Without segments shorter than `least` that don't meet both neighbours exactly; a layer's first and last stay."""
    w = Window.partitionBy("layer").orderBy("seq")
    before = (F.lag("x2").over(w) == F.col("x1")) & (F.lag("y2").over(w) == F.col("y1"))
    after = (F.lead("x1").over(w) == F.col("x2")) & (F.lead("y1").over(w) == F.col("y2"))
    out = segments.withColumn("_edge", F.lag("seq").over(w).isNull() | F.lead("seq").over(w).isNull()).withColumn("_joined", F.coalesce(before & after, F.lit(False)))
    return out.where((length() >= least) | F.col("_edge") | F.col("_joined")).drop("_edge", "_joined")


def pen_lifts(segments: DataFrame, tolerance: float = 0.20, by: tuple[str, ...] = ("layer",)) -> DataFrame:
    """lift: whether the pen goes up behind the segment, as the next one of the layer doesn't begin at its end."""
    w = Window.partitionBy(*by).orderBy("seq")
    joined = is_close(F.lead("x1").over(w), F.col("x2"), tolerance) & is_close(F.lead("y1").over(w), F.col("y2"), tolerance)
    return segments.withColumn("lift", ~F.coalesce(joined, F.lit(False)))


def pen_counters(segments: DataFrame) -> DataFrame:
    """layer, draws, ups (one more at the start), travels, drawn length."""
    lifted = pen_lifts(segments)
    return lifted.groupBy("layer").agg(F.count("*").alias("draws"), (F.count_if("lift") + 1).alias("ups"), F.count_if("lift").alias("travels"), F.round(F.sum(length()), 4).alias("drawn"))


def crop(segments: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Segments' parts in a box (Liang and Barsky), moved to its corner; points go."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    sides = ((-dx, F.col("x1") - xmin), (dx, xmax - F.col("x1")), (-dy, F.col("y1") - ymin), (dy, ymax - F.col("y1")))
    # greatest and least pass over nulls: a side that isn't entered, or left, has no ratio
    t0 = F.greatest(F.lit(0.0), *[F.when(d < 0, room / d) for d, room in sides])
    t1 = F.least(F.lit(1.0), *[F.when(d > 0, room / d) for d, room in sides])
    inside = F.lit(True)
    for d, room in sides:
        inside = inside & ((d != 0) | (room >= 0))
    out = segments.withColumn("_t0", t0).withColumn("_t1", t1).where(inside & (F.col("_t0") < F.col("_t1")))
    at = lambda a, b, t, o: F.col(a) + (F.col(b) - F.col(a)) * F.col(t) - o
    out = out.where((dx != 0) | (dy != 0))
    return out.select(*[c for c in segments.columns if c not in ENDS], at("x1", "x2", "_t0", xmin).alias("x1"), at("y1", "y2", "_t0", ymin).alias("y1"), at("x1", "x2", "_t1", xmin).alias("x2"), at("y1", "y2", "_t1", ymin).alias("y2"))


def orientation_split(segments: DataFrame, angle: float = 135.0, width: float = 70.0) -> DataFrame:
    """bright: whether the segment's direction is strictly within `width` degrees of `angle`."""
    d = F.degrees(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")))
    return segments.withColumn("bright", (d > angle - width) & (d < angle + width))


#: Rows that come out of `in_order`'s functions at a time.
BATCH = 1 << 16


def in_order(rows: DataFrame, run, kind: str, by: tuple[str, ...] = ("layer",), order: str = "seq") -> DataFrame:
    """What the generator `run` makes of each group's rows, which it gets in order, as record batches one after the other.

    A group's rows are sorted by Spark, beyond memory too; what `run` doesn't keep is never in memory at once.
    """
    from itertools import groupby

    import numpy as np
    import pyarrow as pa

    at = [rows.columns.index(c) for c in by]

    def slices(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            new[0] = True
            for i in at:
                own = batch.column(i)
                v, none = own.fill_null(0).to_numpy(zero_copy_only=False), own.is_null().to_numpy(zero_copy_only=False)
                new[1:] |= (v[1:] != v[:-1]) | (none[1:] != none[:-1])
            first = [*np.flatnonzero(new).tolist(), batch.num_rows]
            for a, b in zip(first, first[1:]):
                yield tuple(batch.column(i)[a].as_py() for i in at), batch.slice(a, b - a)

    def go(batches):
        for _, group in groupby(slices(batches), lambda s: s[0]):
            yield from run(part for _, part in group)

    return rows.repartition(*by).sortWithinPartitions(*by, F.asc_nulls_last(order)).mapInArrow(go, kind)


def filed(segments: DataFrame, most: float, dip: float | None = None, keep: tuple[str, ...] = tuple(ENDS)) -> DataFrame:
    """layer, seq, the columns `keep`, file, dip: `budgeted` and, unless `dip` is None, `dips` in one pass.

    Sums that restart are no window function: a layer's lengths are folded in order, batch by batch.
    """
    import numpy as np
    import pyarrow as pa

    def fold(parts):
        file, run, ink = 0, 0.0, 0.0
        for part in parts:
            files, dipped = np.empty(part.num_rows, np.int32), np.zeros(part.num_rows, bool)
            for i, d in enumerate(part.column("d").to_numpy(zero_copy_only=False).tolist()):
                if run + d > most:
                    file, run, ink = file + 1, 0.0, 0.0
                else:
                    run += d
                files[i] = file
                ink += d
                if dip is not None and ink > dip:
                    dipped[i], ink = True, 0.0
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(files), pa.array(dipped)], [*columns, "file", "dip"])

    columns = ["layer", "seq", *keep]
    rows = segments.select(*columns, F.sqrt(F.expr("(x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)")).alias("d"))
    kinds = dict(segments.dtypes)
    return in_order(rows, fold, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", file int, dip boolean")


def budgeted(segments: DataFrame, most: float) -> DataFrame:
    """layer, seq, x1, y1, x2, y2, file: a new file begins where the running length would pass `most`; the segment at the break isn't counted."""
    return filed(segments, most).drop("dip")


def dips(segments: DataFrame, most: float = 120.0) -> DataFrame:
    """`segments` (layer, file, seq, x1, y1, x2, y2) with dip: whether the pen is dipped behind the segment.

    It is where the length drawn in the file since the last dip, the segment included, passes `most`; the
    sum then restarts at 0. A file's lengths are folded in order, batch by batch.
    """
    import numpy as np
    import pyarrow as pa

    def fold(parts):
        run = 0.0
        for part in parts:
            x1, y1, x2, y2 = (part.column(c).to_numpy(zero_copy_only=False) for c in ENDS)
            out = np.zeros(part.num_rows, bool)
            for i, d in enumerate(np.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)).tolist()):
                run += d
                if run > most:
                    out[i], run = True, 0.0
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out)], [*part.schema.names, "dip"])

    kind = "layer int, file int, seq long, x1 double, y1 double, x2 double, y2 double, dip boolean"
    return in_order(segments.select("layer", "file", "seq", *ENDS), fold, kind, ("layer", "file"))


def _greedy_by_scan(p) -> tuple:
    """`_greedy` by looking at all free rows each time."""
    import numpy as np

    n = len(p)
    free, rows, back = np.ones(n, bool), np.zeros(n, np.int64), np.zeros(n, bool)
    free[0] = False
    at = p[0, 2:]
    for place in range(1, n):
        own = np.flatnonzero(free)
        d = np.abs(p[own][:, :2] - at).sum(1), np.abs(p[own][:, 2:] - at).sum(1)
        i, j = int(np.argmin(d[0])), int(np.argmin(d[1]))
        back[place] = d[1][j] < d[0][i]
        rows[place] = k = own[j if back[place] else i]
        free[k] = False
        at = p[k, :2] if back[place] else p[k, 2:]
    return rows, back


class _Free:
    """Free rows by their points (x, y): the nearest point, and at equal distance the least row.

    Distinct points are the leaves' entries of a k-d tree; a node knows how many of its points have free rows. Rows leave by `take`.
    """

    LEAF = 8

    def __init__(self, x, y):
        import numpy as np
        from array import array

        packed = lambda v: array("q", np.ascontiguousarray(v, np.int64).tobytes())
        order = np.lexsort((y, x))  # stable, so a point's rows ascend
        x, y = x[order], y[order]
        new = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
        first = np.flatnonzero(new)
        of = np.empty(len(x), np.int64)
        of[order] = np.cumsum(new) - 1
        self.rows, self.of, self.next = packed(order), packed(of), packed(first)
        self.left = packed(np.diff(np.r_[first, len(x)]))
        x, y = x[first], y[first]
        self.x, self.y = array("d", x.tobytes()), array("d", y.tobytes())
        self.place = {p: i for i, p in enumerate(zip(x.tolist(), y.tolist()))}
        self.box, self.points, self.alive, self.above = [], [], [], []
        self.leaf = array("q", bytes(8 * len(x)))
        todo = [(np.arange(len(x)), -1)]
        while todo:
            own, above = todo.pop()
            node = len(self.box)
            px, py = x[own], y[own]
            x0, x1, y0, y1 = float(px.min()), float(px.max()), float(py.min()), float(py.max())
            self.box.append((x0, x1, y0, y1))
            self.alive.append(len(own))
            self.above.append(above)
            self.points.append(None)
            if above >= 0:
                self.points[above] = (*(self.points[above] or ()), node)  # an inner node's are its children
            if len(own) <= self.LEAF:
                self.points[node] = own.tolist()
                for i in self.points[node]:
                    self.leaf[i] = node
            else:
                half = len(own) // 2
                own = own[np.argpartition(px if x1 - x0 >= y1 - y0 else py, half)]
                todo += [(own[:half], node), (own[half:], node)]

    def take(self, row: int) -> None:
        i = self.of[row]
        self.left[i] -= 1
        if not self.left[i]:
            node = self.leaf[i]
            while node >= 0:
                self.alive[node] -= 1
                node = self.above[node]

    def head(self, i: int, free: bytearray) -> int:
        """The least free row of a point that has one."""
        k = self.next[i]
        while not free[self.rows[k]]:
            k += 1
        self.next[i] = k
        return self.rows[k]

    def nearest(self, ax: float, ay: float, free: bytearray, under: float) -> tuple[float, int]:
        """Distance and row; a row of -1 if none is nearer than `under`."""
        i = self.place.get((ax, ay), -1)
        if i >= 0 and self.left[i] and under > 0:
            return 0.0, self.head(i, free)
        best, row, todo = under, -1, [(0.0, 0)]
        while todo:
            bound, node = todo.pop()
            if bound > best or bound >= under:
                continue
            own = self.points[node]
            if type(own) is tuple:
                pair = []
                for child in own:
                    if self.alive[child]:
                        x0, x1, y0, y1 = self.box[child]
                        pair.append(((x0 - ax if ax < x0 else ax - x1 if ax > x1 else 0.0) + (y0 - ay if ay < y0 else ay - y1 if ay > y1 else 0.0), child))
                if len(pair) == 2 and pair[0][0] < pair[1][0]:
                    pair.reverse()
                todo += pair
            else:
                for i in own:
                    if self.left[i]:
                        d = abs(self.x[i] - ax) + abs(self.y[i] - ay)
                        if d < best or d == best and row >= 0:
                            k = self.head(i, free)
                            if d < best or k < row:
                                best, row = d, k
        return best, row


def _greedy(p) -> tuple:
    """Rows of the ends `p` in greedy order from the first on, and whether each is reversed."""
    import numpy as np
    from array import array

    n = len(p)
    if n < 64 or not np.isfinite(p).all():
        return _greedy_by_scan(p)
    starts, ends = (_Free(np.ascontiguousarray(p[:, k]), np.ascontiguousarray(p[:, k + 1])) for k in (0, 2))
    free, rows, back = bytearray(b"\1") * n, array("q", bytes(8 * n)), bytearray(n)
    k = 0
    for place in range(n):
        if place:
            d, k = starts.nearest(ax, ay, free, float("inf"))
            if d > 0 and (near := ends.nearest(ax, ay, free, d)[1]) >= 0:
                k, back[place] = near, 1
        rows[place] = k
        free[k] = 0
        starts.take(k)
        ends.take(k)
        side = starts if back[place] else ends
        i = side.of[k]
        ax, ay = side.x[i], side.y[i]
    return np.frombuffer(rows, np.int64), np.frombuffer(back, np.uint8).astype(bool)


def greedy_order(segments: DataFrame) -> DataFrame:
    """layer, place, seq, reversed: each layer from its least seq on, always to the nearest free end (Manhattan).

    A chain of choices that can't be split: a layer is one group's work.
    """
    return drawn_order(segments).select("layer", "place", "seq", "reversed")


def drawn_order(segments: DataFrame) -> DataFrame:
    """`greedy_order` with the ends x1, y1, x2, y2 as drawn: swapped where a segment is reversed."""
    import numpy as np
    import pyarrow as pa

    def order(parts):
        parts = pa.Table.from_batches(parts)
        p = np.stack([parts[c].to_numpy() for c in ENDS], 1)
        layer, seq = parts["layer"], parts["seq"].combine_chunks()
        del parts
        rows, back = _greedy(p)
        for at in range(0, len(p), BATCH):
            own, turned = rows[at : at + BATCH], back[at : at + BATCH]
            ends = np.where(turned[:, None], p[own][:, [2, 3, 0, 1]], p[own])
            yield pa.RecordBatch.from_arrays([pa.array([layer[0].as_py()] * len(own), pa.int32()), pa.array(np.arange(at, at + len(own))), seq.take(pa.array(own)), pa.array(turned), *[pa.array(np.ascontiguousarray(e)) for e in ends.T]], ["layer", "place", "seq", "reversed", *ENDS])

    return in_order(segments.select("layer", "seq", *ENDS), order, "layer int, place long, seq long, reversed boolean, x1 double, y1 double, x2 double, y2 double")
