"""Embedding near-dedup by cross-polytope hashing (9) and nearest neighbours by sharded HNSW graphs (2)."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, partitions
from .components import components, union_find


def _fine(vec_id: str, embedding: str):
    v = F.col(embedding).cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists(v, lambda x: x != 0)
    return F.coalesce(F.col(vec_id).isNotNull() & v.isNotNull() & whole, F.lit(False)), v


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """id long, v array<double> without null ids, and without null, empty and zero vectors and those with null or non-finite components."""
    fine, v = _fine(vec_id, embedding)
    return vectors.where(fine).select(F.col(vec_id).cast("long").alias("id"), v.alias("v"))


def unusable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id of the other rows."""
    return vectors.where(~_fine(vec_id, embedding)[0]).select(F.col(vec_id).cast("long").alias("vec_id"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one width."""
    values = np.asarray(column.flatten())
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)


def distinct(good: DataFrame) -> DataFrame:
    """`good` with the hashes h and g that stand for the vector itself."""
    return good.select("id", "v", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(7), F.col("v")).alias("g"))


# ---------------------------------------------------------------- cross-polytope near-dedup

#: Tables where two rotations are joined; probes by vector in each, the first its own bucket.
TABLES, PROBES = 16, 5
#: Vectors compared with as many others at a time; and pairs of two components that are formed one by one.
BLOCK, FEW = 1024, 64


def fast_hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the Hadamard matrix, scaled to keep lengths; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotations(rows: int, width: int) -> int:
    """Rotations joined in a table's code: with as many, unrelated vectors have a bucket each on average."""
    return max(2, int(np.ceil(np.log(max(rows, 2)) / np.log(2 * max(width, 2)))))


def tables_for(together: int, width: int = 64, least: float = 0.9) -> int:
    """Tables for codes of `together` rotations, TABLES at least, so that two vectors of cosine `least` share no table in one of a million pairs.

    How often they meet in a table is measured on 4,000 pairs from a fixed seed, as it depends on the width and
    on the probes: at width 64, 16 tables of two rotations and about twice as many for each further one.
    """
    rng = np.random.default_rng(23)
    x, z = rng.normal(size=(2, 4000, width))
    x /= np.sqrt((x * x).sum(1))[:, None]
    z -= (z * x).sum(1)[:, None] * x
    y = least * x + np.sqrt(1 - least * least) * z / np.sqrt((z * z).sum(1))[:, None]
    a, b = (buckets(v, together, 4, seed=29) for v in (x, y))
    meet = np.mean((a[:, :, :1] == b).any(2) | (b[:, :, :1] == a).any(2))
    return max(TABLES, int(np.ceil(np.log(1e-6) / np.log1p(-min(meet, 0.999)))) if meet else TABLES * 64)


def buckets(x: np.ndarray, together: int, tables: int | None = None, probes: int = PROBES, seed: int = 11) -> np.ndarray:
    """(rows, tables, probes) codes from the nearest signed axes of pseudo-random rotations.

    A rotation is three rounds of random signs and a fast Hadamard transform. A table's code joins the
    axes of `together` rotations. Probes after the first replace one rotation's axis by its second or
    third nearest, in the order of what that costs.
    """
    tables = tables_for(together) if tables is None else tables
    n, d = x.shape
    width = 1 << max(2, int(d - 1).bit_length())
    scale = np.sqrt((x * x).sum(1, keepdims=True))
    x = np.pad(x / scale, ((0, 0), (0, width - d)))
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, together, 3, width))
    out = np.empty((n, tables, probes), np.uint64)
    rows = np.arange(n)
    for t in range(tables):
        own = np.full(n, np.uint64(t + 1))
        choices, costs = [], []
        for r in range(together):
            y = x
            for s in signs[t, r]:
                y = fast_hadamard(y * s)
            size = np.abs(y)
            top = np.argpartition(-size, 3, axis=1)[:, :3]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(size, top, 1), axis=1, kind="stable"), 1)
            axis = [(top[:, j] * 2 + (y[rows, top[:, j]] < 0) + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 * (2 * r + 1) & (2**64 - 1)) for j in range(3)]
            own = own + mix64(axis[0])
            for j in (1, 2):
                choices.append(mix64(axis[j]) - mix64(axis[0]))
                costs.append(size[rows, top[:, 0]] - size[rows, top[:, j]])
        order = np.argsort(np.stack(costs, 1), axis=1, kind="stable")[:, : probes - 1]
        out[:, t, 0] = own
        out[:, t, 1:] = own[:, None] + np.take_along_axis(np.stack(choices, 1), order, 1)
        out[:, t] = mix64(out[:, t] + np.uint64(0xD6E8FEB86659FD93 * t & (2**64 - 1)))
    return out


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * y).sum(1) / np.sqrt((x * x).sum(1)) / np.sqrt((y * y).sum(1))


def near_duplicates(vectors: DataFrame, least: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row of `vectors`.

    Links are pairs of cosine >= `least`, in double precision, among vectors that meet in a bucket;
    the tables grow with the rotations and the width (see `tables_for`), so size doesn't change which pairs meet.
    Unusable vectors (see `usable`) link with nothing. Equal vectors are one class, with cosine 1 among
    themselves; they are compared as one and counted as many. component_id is the least vec_id
    reachable by links, itself included; kept: whether that is its own id. Rows that repeat an id are
    vectors of their own with that id; a null id comes back with no links and a null component. All
    vectors have one width. No vectors give no rows.

    A group of copies is never written as pairs. Each vector is first checked against one other of
    its bucket, which joins copies to components. Then each two components that meet in some bucket,
    and each component with itself, are compared in full and once: few pairs one by one, more in
    blocks of BLOCK by BLOCK vectors, one block pair a task's group, which gives each vector's number
    of links.
    """
    spark = vectors.sparkSession
    good = materialize(distinct(usable(vectors, vec_id, embedding)), "vectors")
    reps = materialize(good.groupBy("h", "g").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("v").alias("v")), "distinct-vectors")
    n = partitions(spark)
    wide = reps.agg(F.max(F.size("v"))).first()[0] or 2
    together = rotations(reps.count(), wide)
    tables = tables_for(together, max(2, wide), least) if least < 1 else TABLES

    def put(rows):
        for batch in rows:
            x = matrix(batch.column(1))
            for at in range(0, len(x), 2000):
                code = buckets(x[at : at + 2000], together, tables)
                m, t, probes = code.shape
                yield pa.RecordBatch.from_arrays([pa.array(code.ravel().view(np.int64)), pa.array(np.tile(np.arange(probes) == 0, m * t)), batch.column(0).slice(at, m).take(pa.array(np.repeat(np.arange(m), t * probes)))], ["bucket", "own", "id"])

    window = "(partition by bucket order by own desc, id"
    met = reps.select("id", "v").repartition(n, "id").mapInArrow(put, "bucket long, own boolean, id long")
    met = met.selectExpr("bucket", "id", f"first(id) over {window} rows between unbounded preceding and current row) as head", f"first(own) over {window} rows between unbounded preceding and current row) as used", f"lag(id) over {window}) as before", f"lead(id) over {window}) as after")
    met = materialize(met.where("used and (before is not null or after is not null)").select("bucket", "id", "head"), "met")

    def check(pairs: DataFrame) -> DataFrame:
        def run(rows):
            for batch in rows:
                x, y = matrix(batch.column(2)), matrix(batch.column(3))
                keep = _cosines(x, y) >= least if len(x) else np.empty(0, bool)
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], ["a", "b"])

        full = pairs.join(reps.select(F.col("id").alias("a"), F.col("v").alias("x")), "a").join(reps.select(F.col("id").alias("b"), F.col("v").alias("y")), "b")
        return full.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")

    star = met.where("id <> head").selectExpr("least(id, head) as a", "greatest(id, head) as b").distinct()
    links = materialize(check(star), "star-links")
    labels = components(links)
    members = reps.select("id", "copies").join(labels, "id", "left").select("id", "copies", F.coalesce("component", "id").alias("label"))
    members = materialize(members, "members")
    sizes = members.groupBy("label").agg(F.count("*").alias("size"))
    # which components meet: labels in pairs, never their members
    named = met.select("bucket", "id").join(members.select("id", "label"), "id").select("bucket", "label").distinct()
    two = named.join(named.select("bucket", F.col("label").alias("other")), "bucket").where("label < other").select("label", "other").distinct()
    two = two.unionByName(sizes.where("size > 1").select("label", F.col("label").alias("other")))
    two = two.join(sizes, "label").join(sizes.select(F.col("label").alias("other"), F.col("size").alias("other_size")), "other")
    two = materialize(two.select("label", "other", "size", "other_size"), "meetings")
    mine, yours = members.select("label", F.col("id").alias("a")), members.select(F.col("label").alias("other"), F.col("id").alias("b"))
    few = two.where(f"size * other_size <= {FEW}").join(mine, "label").join(yours, "other").where("label <> other or a < b").select("a", "b")
    found = materialize(check(few), "few-links")
    # blocks
    many = two.where(f"size * other_size > {FEW}").selectExpr("label", "other", f"cast(ceil(size / {BLOCK}) as int) as p", f"cast(ceil(other_size / {BLOCK}) as int) as q")
    many = many.withColumn("i", F.expr("explode(sequence(0, p - 1))")).withColumn("j", F.expr("explode(sequence(0, q - 1))")).where("label <> other or i <= j")
    many = materialize(many.withColumn("unit", F.expr("xxhash64(label, other, i, j)")), "units")
    sides = many.selectExpr("unit", "0 as side", "label", "i as block", "p as blocks").unionByName(many.selectExpr("unit", "1 as side", "other as label", "j as block", "q as blocks"))
    full = sides.join(members.join(reps.select("id", "v"), "id"), "label").where("pmod(xxhash64(id), blocks) = block").select("unit", "side", "label", "block", "id", "copies", "v")

    def compare(group):
        import pandas as pd

        a, b = group[group.side == 0], group[group.side == 1]
        empty = pd.DataFrame({"id": np.empty(0, np.int64), "n": np.empty(0, np.int64), "other": np.empty(0, np.int64)})
        if not len(a) or not len(b):
            return empty
        x, y = np.stack(a.v.to_numpy()), np.stack(b.v.to_numpy())
        p, q = (z / np.sqrt((z * z).sum(1))[:, None] for z in (x, y))
        cos = p @ q.T
        close = cos >= least
        i, j = np.nonzero(np.abs(cos - least) < 1e-9)  # too near to tell by a product of matrices
        close[i, j] = _cosines(x[i], y[j]) >= least
        u, v = a.id.to_numpy(), b.id.to_numpy()
        if a.label.iloc[0] == b.label.iloc[0]:
            close &= u[:, None] < v[None, :] if a.block.iloc[0] == b.block.iloc[0] else True
        ids = np.concatenate((u, v))
        n = np.concatenate((close @ b.copies.to_numpy(), a.copies.to_numpy() @ close)).astype(np.int64)
        hit = np.argwhere(close)
        other = np.full(len(ids), -1)
        if len(hit):  # both are components: one link joins them
            other[hit[0][0]] = v[hit[0][1]]
        keep = n > 0
        return pd.DataFrame({"id": ids[keep], "n": n[keep], "other": other[keep]})

    counted = materialize(full.repartition(n, "unit").groupBy("unit").applyInPandas(compare, "id long, n long, other long"), "block-links")
    own = members.select("id", "copies")
    pairs = found.join(own.select(F.col("id").alias("a"), F.col("copies").alias("ca")), "a").join(own.select(F.col("id").alias("b"), F.col("copies").alias("cb")), "b")
    sums = pairs.select(F.col("a").alias("id"), F.col("cb").alias("n")).unionByName(pairs.select(F.col("b").alias("id"), F.col("ca").alias("n"))).unionByName(counted.select("id", "n"))
    sums = sums.groupBy("id").agg(F.sum("n").alias("links"))
    edges = links.unionByName(found).unionByName(counted.where("n > 0").join(members.select("id", "label"), "id").select(F.col("id").alias("a"), F.col("label").alias("b")))
    edges = edges.unionByName(counted.where("other >= 0 or other < -1").select(F.col("id").alias("a"), F.col("other").alias("b")))
    final = components(edges)
    of_rep = reps.select("h", "g", "id", "copies").join(sums, "id", "left").join(final, "id", "left")
    of_rep = of_rep.select("h", "g", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = good.select("id", "h", "g").join(of_rep, ["h", "g"]).select(F.col("id").alias("vec_id"), "n_links", "component_id")
    rest = unusable(vectors, vec_id, embedding)
    out = linked.unionByName(rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


# ---------------------------------------------------------------- nearest neighbours

#: Distinct vectors of a shard on average; links that a node chooses, and that it has at most above and on the lowest layer.
SHARD, LINKS, HIGH_LINKS, LOW_LINKS = 16_384, 16, 32, 32
#: Nearest nodes that a node's links are chosen from; candidates kept on the way down and on the lowest layer.
BUILD_WIDTH, DESCENT_WIDTH, SEARCH_WIDTH = 48, 64, 64
#: Nodes whose distances to a shard are held at a time while it is built.
BUILD_BLOCK = 256
#: Queries that search a shard at a time.
QUERY_BLOCK = 2048


class Graph:
    """Hierarchical navigable small-world graph over rows of `x`.

    The neighbours are flat arrays: node i's on layer 0 are low[i * LOW_LINKS:][:low_n[i]]; the layers
    above hold few nodes, and node i's on layer l are high[(start[i] + l - 1) * HIGH_LINKS:][:high_n[start[i] + l - 1]].
    """

    def __init__(self, x: np.ndarray, level: np.ndarray):
        n = len(x)
        self.x, self.level = x, level.astype(np.int8)
        self.start = np.concatenate(([0], np.cumsum(level)))[:-1].astype(np.int32)
        self.low, self.low_n = np.zeros(n * LOW_LINKS, np.int32), np.zeros(n, np.int32)
        self.high, self.high_n = np.zeros(int(level.sum()) * HIGH_LINKS, np.int32), np.zeros(int(level.sum()), np.int32)
        self.entry = 0

    def around(self, i: int, layer: int) -> np.ndarray:
        if layer == 0:
            return self.low[i * LOW_LINKS : i * LOW_LINKS + self.low_n[i]]
        at = self.start[i] + layer - 1
        return self.high[at * HIGH_LINKS : at * HIGH_LINKS + self.high_n[at]]

    def link(self, i: int, layer: int, to: np.ndarray) -> None:
        if layer == 0:
            self.low[i * LOW_LINKS : i * LOW_LINKS + len(to)] = to
            self.low_n[i] = len(to)
        else:
            at = self.start[i] + layer - 1
            self.high[at * HIGH_LINKS : at * HIGH_LINKS + len(to)] = to
            self.high_n[at] = len(to)

    def search(self, far, entries: list[tuple[float, int]], width: int, layer: int, seen: np.ndarray, mark: int) -> list[tuple[float, int]]:
        """The `width` nearest found from the entries, nearest first; far(rows) gives distances."""
        for _, i in entries:
            seen[i] = mark
        todo = list(entries)
        heapq.heapify(todo)
        best = [(-d, i) for d, i in entries]
        heapq.heapify(best)
        while todo:
            d, i = heapq.heappop(todo)
            if d > -best[0][0] and len(best) >= width:
                break
            near = self.around(i, layer)
            near = near[seen[near] != mark]
            if not len(near):
                continue
            seen[near] = mark
            for e, j in zip(far(near).tolist(), near.tolist()):
                if len(best) < width:
                    heapq.heappush(best, (-e, j))
                    heapq.heappush(todo, (e, j))
                elif e < -best[0][0]:
                    heapq.heapreplace(best, (-e, j))
                    heapq.heappush(todo, (e, j))
        return sorted((-d, i) for d, i in best)


def _nearest_nodes(x: np.ndarray, square: np.ndarray, at: int, end: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the nodes at..end the `most` nearest others, nearest first, and their squared distances."""
    d = square[at:end, None] + square[None, :] - 2 * (x[at:end] @ x.T)
    d[np.arange(end - at), np.arange(at, end)] = np.inf
    near = np.argpartition(d, most - 1, axis=1)[:, :most] if most < d.shape[1] else np.tile(np.arange(d.shape[1]), (end - at, 1))
    far = np.take_along_axis(d, near, 1)
    order = np.argsort(far, axis=1, kind="stable")[:, : min(most, len(x) - 1)]
    return np.take_along_axis(near, order, 1), np.take_along_axis(far, order, 1)


def _diverse(x: np.ndarray, square: np.ndarray, near: np.ndarray, far: np.ndarray, most: int) -> np.ndarray:
    """Which of each node's nearest are linked: those that no chosen one is nearer to than the node is, filled up with the nearest others."""
    own = x[near]
    among = square[near][:, :, None] + square[near][:, None, :] - 2 * (own @ own.transpose(0, 2, 1))
    chosen = np.zeros(near.shape, bool)
    for k in range(near.shape[1]):
        hidden = ((among[:, k] < far[:, k, None]) & chosen).any(1)
        chosen[:, k] = ~hidden & (chosen.sum(1) < most)
    rest = np.cumsum(~chosen, 1) <= (most - chosen.sum(1))[:, None]
    return chosen | rest


def _layer_links(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links a -> b of one layer's nodes, ascending by a: a's own choices, then those that chose it, the nearest first, `most` of them."""
    square = (x * x).sum(1)
    ends: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(x), BUILD_BLOCK):
        near, far = _nearest_nodes(x, square, at, min(at + BUILD_BLOCK, len(x)), BUILD_WIDTH)
        i, k = np.nonzero(_diverse(x, square, near, far, LINKS))
        ends.append((i + at, near[i, k], far[i, k]))
    a, b, d = (np.concatenate(v) for v in zip(*ends))
    rank = np.concatenate((np.zeros(len(a), np.int8), np.ones(len(a), np.int8)))
    a, b, d = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((d, d))
    first = np.lexsort((rank, b, a))  # a pair that chose each other counts once
    first = first[np.concatenate(([True], (a[first][1:] != a[first][:-1]) | (b[first][1:] != b[first][:-1])))]
    order = first[np.lexsort((d[first], rank[first], a[first]))]
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    return a[place < most], b[place < most]


def build(x: np.ndarray, seed: int = 5) -> Graph:
    """Layers of ever fewer nodes; on each, a node is linked with diverse ones among its nearest, in both directions.

    A layer's nearest nodes come from products of blocks of BUILD_BLOCK nodes with the layer, so memory stays with the
    block. A part of a layer that hangs together and has no node above gets one there, so that each is reached from above.
    """
    n = len(x)
    level = np.minimum((-np.log(np.maximum(np.random.default_rng(seed).random(n), 1e-12)) / np.log(LINKS)).astype(np.int64), 8)
    small = (x - x.mean(0)).astype(np.float32) if n else x
    layers: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    nodes = np.arange(n)
    while len(nodes) > 1:
        a, b = _layer_links(small[nodes], HIGH_LINKS if layers else LOW_LINKS)
        layers.append((nodes, a, b))
        own, root = union_find(a, b)
        above = np.unique(root[level[nodes[own]] >= len(layers)])
        alone = np.setdiff1d(root, above)
        if len(above) + len(alone) > 1:
            level[nodes[alone]] = len(layers)
        nodes = np.flatnonzero(level >= len(layers))
    g = Graph(x, level)
    g.entry = int(np.argmax(level)) if n else 0
    for layer, (nodes, a, b) in enumerate(layers):
        starts = np.searchsorted(a, np.arange(len(nodes) + 1))
        for i, (p, q) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
            g.link(int(nodes[i]), layer, nodes[b[p:q]])
    return g


def find(g: Graph, query: np.ndarray, k: int, seen: np.ndarray, mark: int, width: int = SEARCH_WIDTH) -> np.ndarray:
    """Rows of the k nearest found; seen and marks: an array of the graph's size, and two unused numbers a layer from `mark`."""
    x = g.x

    def far(rows: np.ndarray) -> np.ndarray:
        d = x[rows] - query
        return np.einsum("ij,ij->i", d, d)

    entries = [(float(far(np.array([g.entry]))[0]), g.entry)]
    for layer in range(int(g.level[g.entry]), 0, -1):
        entries = g.search(far, entries, DESCENT_WIDTH, layer, seen, mark + layer)
    return np.array([i for _, i in g.search(far, entries, max(width, k), 0, seen, mark)[:k]])


INDEX = "shard int, ids array<array<long>>, x binary, level binary, low binary, low_n binary, high binary, high_n binary, entry int"


def build_index(vectors: DataFrame, keep: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """A row for each shard: the graph's flat arrays, its vectors, and for each the `keep` least ids that have it.

    Equal vectors are one node, so copies can't crowd a graph; ids beyond `keep` can't be among a
    query's keep nearest. Shards are dealt by hash and hold SHARD vectors on average at any size.
    """
    good = distinct(usable(vectors, vec_id, embedding))
    # the least ids of each vector: of 64 parts of its copies first, so that a common vector's ids never meet
    once = good.groupBy("h", "g", "id").agg(F.first("v").alias("v")).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)))
    least = once.withColumn("n", F.expr("row_number() over (partition by h, g, part order by id)")).where(f"n <= {keep}")
    reps = least.groupBy("h", "g").agg(F.expr(f"slice(array_sort(collect_list(id)), 1, {keep})").alias("ids"), F.first("v").alias("v"))
    reps = materialize(reps.select("h", "ids", "v"), "distinct-vectors")
    shards = max(1, -(-reps.count() // SHARD))

    def make(group):
        import pandas as pd

        order = np.argsort([i[0] for i in group.ids], kind="stable")
        x = np.stack(group.v.to_numpy())[order]
        g = build(x)
        ids = [group.ids.iloc[i] for i in order]
        return pd.DataFrame([{"shard": group.shard.iloc[0], "ids": ids, "x": x.tobytes(), "level": g.level.tobytes(), "low": g.low.tobytes(), "low_n": g.low_n.tobytes(), "high": g.high.tobytes(), "high_n": g.high_n.tobytes(), "entry": g.entry}])

    dealt = reps.withColumn("shard", F.pmod(F.col("h"), F.lit(shards)).cast("int"))
    return materialize(dealt.repartition(max(shards, 1), "shard").groupBy("shard").applyInPandas(make, INDEX), "graphs")


def nearest(index: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: of each query the k nearest found over all shards, the query's own id left out.

    score is the Euclidean distance in double precision; ties go to the smaller vec_id. Unusable
    queries (see `usable`) give no rows, an index of fewer than k other vectors gives them all. Queries meet
    shards in blocks of QUERY_BLOCK; a shard hands on k + 1 nodes a query.
    """
    spark = queries.sparkSession
    asked = usable(queries, vec_id, embedding).dropDuplicates(["id"])
    asked = materialize(asked, "queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    asked = asked.groupBy("block").agg(F.collect_list(F.struct("id", "v")).alias("asked"))
    last = index.agg(F.max("shard")).first()[0] or 0
    units = index.join(asked.withColumn("shard", F.expr(f"explode(sequence(0, {last}))")), "shard")

    def run(rows):
        for batch in rows:
            for r in range(batch.num_rows):
                cell = {name: batch.column(c)[r] for c, name in enumerate(batch.schema.names)}
                level = np.frombuffer(cell["level"].as_buffer(), np.int8).astype(np.int64)
                g = Graph(np.frombuffer(cell["x"].as_buffer()).reshape(len(level), -1), level)
                for name in ("low", "low_n", "high", "high_n"):
                    setattr(g, name, np.frombuffer(cell[name].as_buffer(), getattr(g, name).dtype))
                g.entry = cell["entry"].as_py()
                ids = cell["ids"].as_py()
                out = ([], [], [])
                seen, mark = np.full(len(level), -1, np.int32), 0
                for q in cell["asked"].as_py():
                    v = np.array(q["v"])
                    rows_found = find(g, v, k + 1, seen, mark)
                    mark += 16
                    d = g.x[rows_found] - v
                    score = np.sqrt((d * d).sum(1)).tolist()
                    for i, s in zip(rows_found.tolist(), score):
                        for j in ids[i]:
                            if j != q["id"]:
                                out[0].append(q["id"])
                                out[1].append(j)
                                out[2].append(s)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    n = max(partitions(spark), 1)
    found = units.repartition(n, "shard", "block").select("shard", "ids", "x", "level", "low", "low_n", "high", "high_n", "entry", "asked").mapInArrow(run, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.expr("row_number() over (partition by query_id order by score, vec_id)")).where(f"rank <= {k}")
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def self_search(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """`nearest` of the rows whose vec_id is divisible by `every` against all rows."""
    return nearest(build_index(vectors, k + 1), vectors.where(F.col("vec_id") % every == 0), k)
