"""Best-fit packing (3): documents' pieces into as few sequences as can be, by linear grouping.

All decisions are made on counts by length, of which there are at most as many as a sequence has
tokens; a run of equal sequences is one entry of the plan. Entries grow with the lengths that occur and their
combinations, more slowly than the documents (9,178 for 10,267 pieces, 24,594 for 308,010).

1. Full pieces are sequences of their own.
2. Large pieces (over a part of the capacity) are sorted by length and cut into equal-cardinality groups; each
   counts as its group's longest. Over these few sizes, column generation (a knapsack for each
   round's prices) finds how many sequences of each configuration to use.
3. Actual lengths take the configurations' places: sequences whose places get the same lengths form
   a run, an interval of sequence numbers.
4. All other pieces - small ones, and the large ones that the configurations' fractions leave - go, longest first,
   where they leave the least room; runs with as much room take them together. What finds no room opens sequences.

That is done for a few settings (number of groups, bound of large, part of the configurations used), and the
plan of fewest sequences is kept.

A plan's entry (length, first rank, count, first sequence, offset) says where the pieces of one
length with these ranks go. Ranks come from counts by task and length, so no task sees more than its
own pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import materialize, text_or_empty, views
from .tokens import END_ID, token_batches

CAPACITY = 4096
#: Plans to choose from: groups of large lengths, large being over CAPACITY / the second number, and the part of the configurations' sequences used.
SETTINGS = ((16, 4, 1.0), (16, 3, 1.0), (32, 4, 1.0), (32, 8, 0.8), (16, 4, 0.5), (1, 1, 0.0))


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's ids and end id, with part and rank:
    the task, and the place among the task's pieces of this length."""
    end = np.array([end_id], "<u4").tobytes()

    def run(rows):
        from pyspark import TaskContext

        part_no, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for part, (ids,) in token_batches(rows, path, (bpe.ids_bytes,)):
            offsets, data = views(ids)
            size = np.diff(offsets) // 4 + 1
            pieces = -(-size // capacity)
            owner = np.repeat(np.arange(len(size)), pieces)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(size[owner] - start, capacity)
            view = memoryview(np.ascontiguousarray(data))
            last = start + length == size[owner]
            crc = []
            for a, n, whole in zip((offsets[owner] + 4 * start).tolist(), length.tolist(), last.tolist()):
                crc.append(zlib.crc32(end, zlib.crc32(view[a : a + 4 * (n - 1)])) if whole else zlib.crc32(view[a : a + 4 * n]))
            order = np.argsort(length, kind="stable")
            own = length[order]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else own
            rank = np.empty(len(own), np.int64)
            rank[order] = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own)))) + seen[own]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(own), part_no, np.int32)), pa.array(rank)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty()).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long")


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(pieces of each size in a sequence, sequences), of at most `counts` pieces.

    Gilmore and Gomory's column generation on the fractional problem, rounded down; what that leaves, less than
    a sequence for each size, goes with the small pieces.
    """
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(40 * k):
        inverse = np.linalg.inv(basis)
        amounts = inverse @ counts
        worth = inverse.sum(0)
        value, column = _knapsack(sizes, worth, capacity)
        if value <= 1 + 1e-7:
            break
        step = inverse @ column
        up = step > 1e-9
        if not up.any():
            break
        ratio = np.where(up, np.maximum(amounts, 0) / np.where(up, step, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    left, out = counts.copy(), []
    for j in np.argsort(-amounts):
        column = np.rint(basis[:, j]).astype(np.int64)
        n = int(max(0, np.floor(amounts[j] + 1e-9)))
        used = column > 0
        if used.any():
            n = min(n, int((left[used] // column[used]).min()))
        if n:
            left -= n * column
            out.append((column, n))
    return out


def _knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within the capacity."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for g in np.argsort(sizes):
        s, v = int(sizes[g]), worth[g]
        if v <= 0:
            continue
        for a in range(s, capacity + 1, s):  # within a block no entry depends on another
            b = min(a + s, capacity + 1)
            more = best[a - s : b - s] + v
            better = more > best[a:b] + 1e-12
            best[a:b][better], last[a:b][better] = more[better], g
    column = np.zeros(len(sizes))
    at = int(np.argmax(best))
    while at > 0 and last[at] >= 0:
        column[last[at]] += 1
        at -= int(sizes[last[at]])
    return float(best.max()), column


def plan(counts: np.ndarray, capacity: int = CAPACITY, settings: tuple = SETTINGS) -> np.ndarray:
    """Entries (length, first rank, count, first sequence, offset) for counts[length] pieces of each length.

    The plan of fewest sequences among the settings, the first of these; none is tried after one that meets the volume bound.
    The last setting uses no configuration, so the plan never needs more sequences than best fit of all pieces, longest first.
    """
    bound = -(-int((counts * np.arange(len(counts))).sum()) // capacity)
    best, fewest = np.zeros((0, 5), np.int64), None
    for groups, small, share in settings:
        entries = grouped_plan(counts, capacity, groups, small, share)
        used = sequences_of(entries)
        if fewest is None or used < fewest:
            best, fewest = entries, used
        if used <= bound:
            break
    return best


def sequences_of(entries: np.ndarray) -> int:
    return int((entries[:, 3] + entries[:, 2]).max()) if len(entries) else 0


def grouped_plan(counts: np.ndarray, capacity: int, groups: int, small: int, share: float) -> np.ndarray:
    """The plan of one setting: `groups` of lengths over capacity / small, and the fullest configurations up to `share` of their sequences."""
    counts = counts.astype(np.int64).copy()
    given = np.zeros(capacity + 1, np.int64)
    entries: list[tuple[int, int, int, int, int]] = []
    rooms: dict[int, list[tuple[int, int]]] = {}  # by room left: (first sequence, sequences)
    keys: list[int] = []
    sequences = 0

    def take(length: int, n: int, seq: int, offset: int) -> None:
        entries.append((length, int(given[length]), n, seq, offset))
        given[length] += n
        counts[length] -= n

    def leave(room: int, seq: int, n: int) -> None:
        if room:
            if room not in rooms:
                rooms[room] = []
                insort(keys, room)
            rooms[room].append((seq, n))

    if counts[capacity]:
        n = int(counts[capacity])
        take(capacity, n, 0, 0)
        sequences = n
    large = np.flatnonzero(counts > 0)
    large = large[large > capacity // small]
    if len(large):
        total = int(counts[large].sum())
        runs: list[list[list[int]]] = []  # for each group, its lengths and how many
        ends = [total * (i + 1) // groups for i in range(groups)]
        done, group = 0, []
        for length in large.tolist():
            n = int(counts[length])
            while n:
                while ends and ends[0] <= done:
                    ends.pop(0)
                    if group:
                        runs.append(group)
                        group = []
                part = min(n, (ends[0] if ends else total) - done)
                group.append([length, part])
                n -= part
                done += part
        if group:
            runs.append(group)
        sizes = np.array([g[-1][0] for g in runs])
        number = np.array([sum(x[1] for x in g) for g in runs])
        chosen = sorted(configurations(sizes, number, capacity) if share else [], key=lambda x: -int(x[0] @ sizes))
        most = int(share * sum(n for _, n in chosen))
        for column, times in chosen:
            times = min(times, most)
            most -= times
            if not times:
                break
            places = [g for g in range(len(sizes)) for _ in range(int(column[g]))][::-1]
            # place p takes the next `times` pieces of its group
            queues = []
            for g in places:
                need, queue = times, []
                while need:
                    length, n = runs[g][-1]
                    m = min(n, need)
                    queue.append([length, m])
                    need -= m
                    runs[g][-1][1] -= m
                    if not runs[g][-1][1]:
                        runs[g].pop()
                queues.append(queue[::-1])
            rest = times
            while rest:
                n = min(q[-1][1] for q in queues)
                offset = 0
                for q in queues:
                    take(q[-1][0], n, sequences, offset)
                    offset += q[-1][0]
                    q[-1][1] -= n
                    if not q[-1][1]:
                        q.pop()
                leave(capacity - offset, sequences, n)
                sequences += n
                rest -= n
    for length in range(capacity, 0, -1):
        while counts[length]:
            i = bisect_left(keys, length)
            if i == len(keys):
                n = max(1, int(counts[length]) // (capacity // length))
                leave(capacity, sequences, n)
                sequences += n
                continue
            room = keys[i]
            seq, n = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                keys.pop(i)
            m = min(n, int(counts[length]))
            if m < n:
                leave(room, seq + m, n - m)
            take(length, m, seq, capacity - room)
            leave(room - length, seq, m)
    return np.array(entries, np.int64).reshape(-1, 5)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece.

    Only documents of more than `capacity` ids, the end id included, are cut. A null or empty text is
    a piece of its end id alone; repeated rows are packed as often as they come; a null id stays null.
    No documents give no rows.
    """
    spark = docs.sparkSession
    pieces = materialize(cut_pieces(docs, path, capacity), "pieces")
    by_part = materialize(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    # at most `capacity` rows
    histogram = by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(capacity + 1, np.int64)
    for r in histogram:
        counts[r["length"]] = r["n"]
    entries = plan(counts, capacity)
    entries = entries[np.lexsort((entries[:, 1], entries[:, 0]))]
    table = spark.sparkContext.broadcast(entries)
    first = by_part.select("part", "length", F.expr("coalesce(sum(n) over (partition by length order by part rows between unbounded preceding and 1 preceding), 0)").alias("first"))

    def place(rows):
        e = table.value
        key = e[:, 0] << 44 | e[:, 1]
        for batch in rows:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(key, length << 44 | rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(e[at, 3] + rank - e[at, 1]), pa.array(e[at, 4])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(first, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
