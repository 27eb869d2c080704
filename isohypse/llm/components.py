"""Distributed union-find, and links within groups that share a key.

`components` contracts edges inside each task (union-find on the task's own edges). Then rounds follow until
every node points at its component's least id: a large-star step, and again union-find in tasks, now by
the hash of the edges' larger ends, where the tasks also see whether anything was left to do. In a forest of few
nodes, each one's least neighbour is broadcast instead, and the tasks follow it several steps without dealing edges
out. A task holds a forest of its own nodes only. More links later are joined on the components' labels, not on all links again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize, partitions, written


#: Pairs that each id is tried in before its groups' other pairs.
TRIES = 3
#: Nodes that a task of a union-find round takes, and the tasks of a small round.
NODES_A_TASK, LEAST_TASKS = 200_000, 4
#: Rows of two or three longs that may be broadcast; more are joined by a shuffle. Steps to least neighbours in a round by broadcast.
BROADCAST_ROWS, STEPS = 300_000, 4


def union_find(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, ascending, and the least node of each one's component."""
    nodes, code = np.unique(np.concatenate((left, right)), return_inverse=True)
    a, b = code[: len(left)], code[len(left) :]
    root = np.arange(len(nodes))
    while True:  # hook each root to the least neighbour's root, then halve the paths
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            return nodes, nodes[root]
        low, high = np.minimum(ra, rb)[differ], np.maximum(ra, rb)[differ]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def small(table: DataFrame) -> DataFrame:
    """A written table of a few longs a row, to be broadcast if it has few rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _contract(edges: DataFrame) -> DataFrame:
    """Edges (a, b) to (id, component): their nodes, each with the least node of its component in the task.

    With a column `moved`, the edges are a round's and hold each node as an a. If an edge has moved or a node points at two,
    a row of nulls comes too. If none comes from any task, all rows are final, and each node's only one if edges were dealt by a.
    """
    later = "moved" in edges.columns

    def run(rows):
        kept, came, left = [np.empty(0, np.int64), np.empty(0, np.int64)], np.empty(0, bool), False
        for batch in rows:
            a, b = (np.concatenate((x, batch.column(i).to_numpy())) for i, x in enumerate(kept))
            nodes, root = union_find(a, b)
            at = np.searchsorted(nodes, a)
            own = np.zeros(len(nodes), bool)
            own[at[: len(came)][came]] = own[at[len(came) :]] = True
            if later:
                left = left or bool((root[at] != b).any()) or pc.any(batch.column(2)).as_py()
            kept, came = [nodes, root], own
        if later:  # a node that is none of the a's is known elsewhere, unless it was found to lead on
            keep = came | (kept[0] != kept[1])
            kept = [x[keep] for x in kept]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in kept], ["id", "component"])
        if left:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 2, ["id", "component"])

    return edges.mapInArrow(run, "id long, component long")


def _jump(forest: DataFrame) -> DataFrame:
    """Edges (a, b, moved) of a forest (id, component): each edge's smaller end has given way to its own least smaller
    neighbour, if it has one (the large-star step)."""
    least = forest.groupBy("id").agg(F.min("component").alias("m")).where("m <> id").selectExpr("id as component", "m")
    return forest.join(least, "component", "left").selectExpr("id as a", "coalesce(m, component) as b", "m is not null as moved")


def _follow(forest: DataFrame) -> DataFrame:
    """Edges (a, b, moved) of a forest (id, component) of few nodes: both ends point at what least neighbours lead to from the larger one."""
    least = forest.groupBy("id").agg(F.min("component").alias("m")).where("m <> id").selectExpr("id as b", "m")
    out = forest.selectExpr("id", "component", "id as b")
    for _ in range(STEPS):
        out = out.join(F.broadcast(least), "b", "left").selectExpr("id", "component", "coalesce(m, b) as b")
    return out.selectExpr("explode(if(component = b, array(id), array(id, component))) as a", "b", "component <> b as moved")


def components(edges: DataFrame) -> DataFrame:
    """id, component: the nodes of the edges (a long, b long), each with its component's least id; a written table.

    Repeated edges, either direction and loops are allowed; edges with a null end are left out. A
    component's least id comes with itself. No edges give no rows.
    """
    edges = edges.filter("a is not null and b is not null and a <> b")
    now = materialize(_contract(edges.select("a", "b")), "forest")
    rows, settled = now.count(), False
    few = rows <= BROADCAST_ROWS
    while rows and not settled:
        # a task has a node once as the larger end, so a bucket gets no more of its rows than there are tasks
        edges = _follow(now) if few else _jump(now).repartition(max(LEAST_TASKS, -(-rows // NODES_A_TASK)), "a")
        after = materialize(_contract(edges), "forest")
        drop(now)
        now = after
        rows, left = now.agg(F.count("*"), F.count_if(F.col("id").isNull())).first()
        settled = not left
        if left:
            now = now.where("id is not null")
            now._isohypse_path = after._isohypse_path
    if rows and few:
        after = materialize(now.distinct(), "components")
        drop(now)
        now = after
    return now


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The components (id, component) of `labels` after more links (a, b): only their labels' graph is gone through."""
    one, two = labels.selectExpr("id as a", "component as p"), labels.selectExpr("id as b", "component as q")
    edges = links.join(one, "a", "left").join(two, "b", "left").selectExpr("coalesce(p, a) as a", "coalesce(q, b) as b")
    moved = components(edges)
    hint = F.broadcast if moved.count() <= BROADCAST_ROWS else lambda x: x
    out = labels.join(hint(moved.selectExpr("id as component", "component as to")), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    # a label is an id of its own component; ids without label so far come from the links
    known = labels.join(hint(moved.select("id")), "id", "left_semi").select("id")
    after = materialize(out.unionByName(moved.join(hint(known), "id", "left_anti").select("id", "component")), "labels")
    drop(moved)
    return after


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) whose ends are in different components."""
    one, two = labels.selectExpr("id as a", "component as p"), labels.selectExpr("id as b", "component as q")
    return pairs.join(one, "a", "left").join(two, "b", "left").where("coalesce(p, a) <> coalesce(q, b)").select("a", "b")


def shared_keys(keys: DataFrame) -> DataFrame:
    """The distinct rows of keys (key, id, perhaps n) whose key has several ids, with c, the key's rows; a written table."""
    names = [x for x in ("key", "id", "n") if x in keys.columns]
    shared = keys.selectExpr(*names, "count(*) over (partition by key) as c", "min(id) over (partition by key) as least", "max(id) over (partition by key) as most")
    return materialize(shared.where("least < most").select(*names, "c").distinct(), "shared-keys")


def star_pairs(shared: DataFrame, size_ratio: float = 0.0) -> DataFrame:
    """Pairs (a < b): each id with the centres of its keys (the member that shares most with others, all keys
    counted) and with its neighbours by that order; of these the TRIES with which it shares most keys.
    With `size_ratio`, pairs whose smaller n is under that part of the larger are left out."""
    degree = shared.groupBy("id").agg(F.sum("c").alias("degree"))
    window = "over (partition by key order by degree desc, id"
    running = "rows between unbounded preceding and current row"
    n = "n" if size_ratio else "1"
    star = shared.join(degree, "id").selectExpr(
        "id", f"{n} as n", f"first(id) {window} {running}) as head", f"first({n}) {window} {running}) as head_n", f"lag(id) {window}) as before", f"lag({n}) {window}) as before_n",
    ).where("before is not null")
    star = star.selectExpr("id", "n", "explode(array(struct(head as other, head_n as m), struct(before as other, before_n as m))) as o").selectExpr("id", "o.other", "n", "o.m")
    star = star.where(f"least(n, m) >= {size_ratio!r} * greatest(n, m)").groupBy("id", "other").agg(F.count("*").alias("s"))
    star = star.withColumn("place", F.expr("row_number() over (partition by id order by s desc, other)")).where(f"place <= {TRIES}")
    return star.selectExpr("least(id, other) as a", "greatest(id, other) as b").distinct()


def linked(shared: DataFrame, star: DataFrame, verify: Callable[[DataFrame], DataFrame], crosses: list[Callable[[DataFrame, DataFrame], DataFrame]]) -> DataFrame:
    """Components (id, component) of the links among ids that share a key; ids without link don't come.

    `shared` is from `shared_keys`, `star` from `star_pairs`, perhaps thinned. `verify` takes a written table
    of pairs (a < b) and returns those that link, as a written table.

    Pairs are not formed within keys at once. First each id is tried in its star pairs, one of them, then the others
    if still apart; that settles groups of copies at a few pairs an id. Only ids of one key that are still in
    different components can add links between components: each of `crosses` in turn takes the rows (key, id, label, main,
    perhaps n; main: the key's most frequent label) of keys whose ids have several labels, and the pairs tried before, and returns pairs to verify. One may
    leave out pairs that may link; then a row of nulls comes too. Others follow only then, and the last one must leave out none.
    """
    star, mixed = materialize(star, "star"), shared
    first = materialize(star.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "star-first")
    links = verify(first)
    drop(first)
    labels = components(links)
    drop(links)
    rest = materialize(apart(star, labels), "star-rest")
    for cross in (None, *crosses):
        if cross:
            named = materialize(mixed.drop("c", "label", "main").join(labels, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component"), "named")
            # a key whose ids are all in one component has nothing left to try, now or later
            by_label = named.groupBy("key", "label").agg(F.count("*").alias("m"))
            keys = by_label.groupBy("key").agg(F.max(F.struct("m", "label")).alias("main"), F.count("*").alias("labels"))
            keys = keys.where("labels > 1").selectExpr("key", "main.label as main")
            if mixed is not shared:
                drop(mixed)
            mixed = materialize(named.join(keys, "key"), "mixed")
            drop(named)
            rest = cross(mixed, star)
        pairs = rest.where("a is not null")
        if not pairs.isEmpty():
            more = verify(pairs)
            if not more.isEmpty():
                after = joined(labels, more)
                drop(labels)
                labels = after
            drop(more)
        whole = cross and rest.where("a is null").isEmpty()
        drop(rest)
        if whole:
            break
    for x in (shared, star, *([] if mixed is shared else [mixed])):
        drop(x)
    return labels


#: Members of a family that are compared with as many others at a time, and bits of a set's parity sketch.
BLOCK, SKETCH_BITS = 1024, 2048
#: Likeliest partners of an id in a block that are tried before others.
LIKELY = 4
#: Rows of sketches that a task compares, block by block; fewer tasks than shuffle partitions where there is little to do.
SKETCHES_A_TASK = 4096


def parity(hashes: np.ndarray, bits: int = SKETCH_BITS) -> bytes:
    """For each of `bits` classes of hashes, whether the set of distinct hashes has an odd number of them."""
    odd = np.bincount((hashes.view(np.uint64) >> np.uint64(17)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def parities(hashes: np.ndarray, row: np.ndarray, rows: int, bits: int = SKETCH_BITS) -> list[bytes]:
    """`parity` of each row's set; `row` has the place of each hash."""
    odd = np.bincount(row * bits + ((hashes.view(np.uint64) >> np.uint64(17)).astype(np.int64) & (bits - 1)), minlength=rows * bits) & 1
    return [x.tobytes() for x in np.packbits(odd.astype(np.uint8).reshape(rows, bits), axis=1)]


def cross_by_sketch(mixed: DataFrame, tried: DataFrame, sketches: Callable[[DataFrame], DataFrame], threshold: float, best: bool = False) -> DataFrame:
    """Pairs (a < b) of ids that share a key of `mixed` (key, id, label, main) under different labels and may have Jaccard similarity
    `threshold`; `sketches` takes ids and returns their (id, n, parity), n being the set's size, or a written table that holds
    them, which stays. Pairs of `tried` don't come again.

    The ids of all keys with one `main` label are a family, in which each pair is looked at once. No pair is
    lost: two sets' parity sketches differ in at most as many bits as the sets in elements. The ids outside the
    family's label are compared with all members, in blocks of BLOCK by BLOCK that go to tasks of their own. With
    `best`, only the LIKELY likeliest partners of an id in each block come, and a row of nulls if one has more. A sketch's bits are a power of two; similar sets'
    lengths differ by a factor of two at most, and the longer one is folded; that holds for thresholds from 0.5 on, and a
    lower one is an error.
    """
    if threshold < 0.5:
        raise ValueError("sketches of sets that differ twofold in length are compared, which a threshold of 0.5 or more needs")
    spark = mixed.sparkSession
    family = materialize(mixed.select("main", "id", "label").distinct(), "family")
    size = materialize(family.groupBy("main").agg(F.count("*").alias("c"), F.count_if(F.col("label") != F.col("main")).alias("r")), "family-sizes")
    many = family.join(small(size), "main")
    ids = family.select("id")
    given = sketches(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids.distinct())
    own = given if written(given) else materialize(given, "sketches")
    many = many.selectExpr("main as key", "id", "label", "label <> main as outside", f"cast(ceil(r / {BLOCK}) as int) as p", f"cast(ceil(c / {BLOCK}) as int) as q")
    many = many.selectExpr("*", "cast(pmod(xxhash64(id, 1), p) as int) as i", "cast(pmod(xxhash64(id, 2), q) as int) as j")
    # an id outside the family's label meets all blocks of members, and is met as a member by all blocks of outsiders
    many = many.withColumn("u", F.expr("explode(array_union(if(outside, transform(sequence(0, q - 1), x -> struct(i as i, x as j)), array()), transform(sequence(0, p - 1), x -> struct(x as i, j as j))))"))
    many = many.selectExpr("id", "key", "u.i as i", "u.j as j", "label", "outside and u.i = i as s", "u.j = j as t").join(own, "id")
    rows = size.agg(F.sum(F.expr(f"r * ceil(c / {BLOCK}) + c * ceil(r / {BLOCK})"))).first()[0] or 0
    tasks = min(partitions(spark), max(LEAST_TASKS, -(-int(rows) // SKETCHES_A_TASK)))
    dealt = many.select("key", "i", "j", "id", "label", "s", "t", "n", "parity").repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def compare(rows):
        carry = None
        for batch in rows:
            table = pa.Table.from_batches([batch]) if carry is None else pa.concat_tables([carry, pa.Table.from_batches([batch])]).combine_chunks()
            unit = np.stack([table.column(c).to_numpy() for c in ("key", "i", "j")], 1)
            starts = np.flatnonzero(np.concatenate(([True], (unit[1:] != unit[:-1]).any(1))))
            yield _unlike(table.slice(0, starts[-1]), starts[:-1], threshold, best)
            carry = table.slice(starts[-1])
        if carry is not None:
            yield _unlike(carry, np.zeros(1, np.int64), threshold, best)

    found = dealt.mapInArrow(compare, "a long, b long").distinct()
    out = materialize(found.join(tried, ["a", "b"], "left_anti"), "crossing")
    drop(family)
    drop(size)
    if own is not given:
        drop(own)
    return out


def fold(x: np.ndarray, words: int) -> np.ndarray:
    """Sketches (rows, 64-bit words) at a shorter length; both lengths are powers of two."""
    return np.bitwise_xor.reduce(x.reshape(len(x), -1, words), 1)


def _unlike(table: pa.Table, starts: np.ndarray, threshold: float, best: bool) -> pa.RecordBatch:
    """The pairs of each unit, a run of rows from one start to the next, that sketches don't rule out; with `best`, as in `cross_by_sketch`."""
    left_out = False
    out: tuple[list[np.ndarray], list[np.ndarray]] = ([np.empty(0, np.int64)], [np.empty(0, np.int64)])
    if len(starts):
        ids, label, n = (table.column(c).to_numpy() for c in ("id", "label", "n"))
        s, t = (table.column(c).to_numpy(zero_copy_only=False) for c in ("s", "t"))
        parities = table.column("parity").to_pylist()
        words = np.array([len(x) // 8 for x in parities])
        place, bits = np.empty(len(ids), np.int64), {}
        for w in np.unique(words).tolist():
            own = np.flatnonzero(words == w)
            place[own] = np.arange(len(own))
            bits[w] = np.frombuffer(b"".join(parities[i] for i in own.tolist()), np.uint64).reshape(-1, w)
        for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)]):
            left, right = at + np.flatnonzero(s[at:end]), at + np.flatnonzero(t[at:end])
            for w in set(words[left].tolist()):
                for v in {w // 2, w, 2 * w} & set(words[right].tolist()):
                    one, two, short = left[words[left] == w], right[words[right] == v], min(v, w)
                    y_bits = fold(bits[v][place[two]], short)
                    step = max(1, (1 << 20) // (len(two) * short))
                    for k in range(0, len(one), step):
                        u = one[k : k + step]
                        differ = np.bitwise_count(fold(bits[w][place[u]], short)[:, None, :] ^ y_bits[None, :, :]).sum(2, dtype=np.int64)
                        # with i = |A and B| and d = |A or B| - i: n + m = d + 2 i, and i >= t (i + d)
                        keep = (differ * (1 + threshold) <= (n[u][:, None] + n[two][None, :]) * (1 - threshold)) & (label[u][:, None] != label[two][None, :])
                        if best and (crowded := keep.sum(1) > LIKELY).any():
                            left_out = True
                            likely = np.where(keep[crowded], (n[u[crowded]][:, None] + n[two][None, :]) / (1.0 + differ[crowded]), -1.0)
                            few = np.zeros(likely.shape, bool)
                            np.put_along_axis(few, np.argpartition(-likely, LIKELY - 1, 1)[:, :LIKELY], True, 1)
                            keep[crowded] = few
                        x, y = np.nonzero(keep)
                        out[0].append(np.minimum(ids[u[x]], ids[two[y]]))
                        out[1].append(np.maximum(ids[u[x]], ids[two[y]]))
    columns = [pa.array(np.concatenate(x)) for x in out]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([x, pa.nulls(1, pa.int64())]) if left_out else x for x in columns], ["a", "b"])
