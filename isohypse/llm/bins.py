"""Vector bin packing (12): examples into sequences under limits on tokens, segments and loss-bearing tokens.

An example is a run of ids of which spans bear loss, as the answers in a conversation do. The
dot-product heuristic fills one sequence at a time: of the examples that fit under all three limits it
takes the one whose demands, weighted by how scarce each resource is, have the largest product with
what the sequence has left. So a sequence with much loss left to bear takes answers, one with few segments
left takes long examples.

What no whole example fits is filled by the beginning of one; its rest is an example again. A
sequence that can't be filled (no segments left, no loss left, or no examples) is cut back to a power of two,
the length at which sequences needn't be padded, so none holds padding.

Packing needs no shuffle: a task packs its own examples in blocks of BLOCK_TOKENS ids as it encodes
them, and a block leaves a few short sequences at most. Memory is that of one block.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import bpe
from .common import text_or_empty, views
from .tokens import END_ID, token_batches


@dataclass(frozen=True)
class Limits:
    """Most tokens, segments and loss-bearing tokens of a sequence."""

    tokens: int = 2048
    segments: int = 64
    loss: int = 2048


#: Ids of a block of examples; a longer example is a block of its own.
BLOCK_TOKENS = 4 << 20
SCHEMA = "piece int, start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long, sequence_id long, segment int, offset long"


class _Pool:
    """Examples not yet placed, by their demands (tokens, loss); each a stack of (example, start)."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.at: dict[tuple[int, int], int] = {}
        self.stacks: list[list[tuple[int, int]]] = []
        self.size = 0
        self.demand = np.zeros((3, 1024), np.int64)
        self.live = np.zeros(1024, bool)
        self.longest: list[int] = []
        self.count = 0
        self.sums = np.zeros(3)

    def put(self, example: int, start: int, tokens: int, loss: int) -> None:
        k = self.at.get((tokens, loss))
        if k is None:
            k = self.at[tokens, loss] = self.size
            if k == self.demand.shape[1]:
                self.demand = np.concatenate((self.demand, np.zeros_like(self.demand)), 1)
                self.live = np.concatenate((self.live, np.zeros_like(self.live)))
            self.demand[:, k] = tokens, 1, loss
            self.stacks.append([])
            self.size += 1
        self.stacks[k].append((example, start))
        self.live[k] = True
        self.count += 1
        self.sums += (tokens, 1, loss)

    def pop(self, k: int) -> tuple[int, int]:
        item = self.stacks[k].pop()
        if not self.stacks[k]:
            self.live[k] = False
        self.count -= 1
        self.sums -= self.demand[:, k]
        return item

    def best(self, room: np.ndarray) -> int:
        """The example of the largest weighted product of demand and room among those that fit, or -1; ties to more tokens."""
        d = self.demand[:, : self.size]
        fits = self.live[: self.size] & (d[0] <= room[0]) & (d[1] <= room[1]) & (d[2] <= room[2])
        if not fits.any():
            return -1
        most = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], float)
        scarce = self.sums / most
        weight = scarce / max(scarce.sum(), 1e-300) * room / most / most
        score = np.where(fits, weight @ d, -1.0)
        top = np.flatnonzero(score >= score.max() * (1 - 1e-12))
        return int(top[np.argmax(d[0, top])])

    def to_cut(self) -> int:
        """The longest example of one that a sequence can't hold whole, else the longest of all."""
        d = np.where(self.live[: self.size], self.demand[0, : self.size], -1)
        return int(np.argmax(d))


def pack_block(sizes: np.ndarray, loss_before, limits: Limits) -> list[tuple[int, int, int, int, int, int, int]]:
    """(example, start, length, loss, sequence, segment, offset) of all pieces.

    sizes: tokens of each example; loss_before(example, place): its loss-bearing tokens before `place`.
    """
    if min(limits.tokens, limits.segments, limits.loss) < 1:
        raise ValueError("limits are at least 1")
    pool = _Pool(limits)
    out: list[tuple[int, int, int, int, int, int, int]] = []

    def loss(example: int, a: int, b: int) -> int:
        return loss_before(example, b) - loss_before(example, a)

    def cut_to(example: int, start: int, most: int, most_loss: int) -> int:
        """The longest beginning of at most so many tokens and loss-bearing ones."""
        low, high = 0, most
        while low < high:
            mid = (low + high + 1) // 2
            if loss(example, start, start + mid) <= most_loss:
                low = mid
            else:
                high = mid - 1
        return low

    for i, n in enumerate(sizes.tolist()):
        if n:
            pool.put(i, 0, n, loss(i, 0, n))
    sequence = 0
    while pool.count:
        placed: list[tuple[int, int, int, int]] = []
        room = np.array([limits.tokens, limits.segments, limits.loss], np.int64)

        def place(example: int, start: int, length: int) -> None:
            own = loss(example, start, start + length)
            if placed and placed[-1][0] == example and placed[-1][1] + placed[-1][2] == start:  # the same segment goes on
                before = placed.pop()
                placed.append((example, before[1], before[2] + length, before[3] + own))
                room[:] = room - (length, 0, own)
            else:
                placed.append((example, start, length, own))
                room[:] = room - (length, 1, own)

        def cut() -> bool:
            """Fill the room with the beginning of a long example."""
            k = pool.to_cut()
            tokens = int(pool.demand[0, k])
            example, start = pool.stacks[k][-1]
            length = cut_to(example, start, min(tokens, int(room[0])), int(room[2]))
            if not length:
                return False
            pool.pop(k)
            place(example, start, length)
            if length < tokens:
                pool.put(example, start + length, tokens - length, loss(example, start + length, start + tokens))
            return True

        k = pool.to_cut()
        if pool.demand[0, k] > limits.tokens or pool.demand[2, k] > limits.loss:
            cut()
        while room[0] and room[1] and pool.count and (k := pool.best(room)) >= 0:
            length = int(pool.demand[0, k])
            place(*pool.pop(k), length)
        if room[0] and room[1] and pool.count:
            cut()
        total = limits.tokens - int(room[0])
        if room[0]:  # back to a power of two; what comes off is an example again
            spare = total - (1 << (total.bit_length() - 1))
            while spare:
                example, start, length, _ = placed.pop()
                off = min(spare, length)
                if off < length:
                    placed.append((example, start, length - off, loss(example, start, start + length - off)))
                pool.put(example, start + length - off, off, loss(example, start + length - off, start + length))
                spare -= off
        offset = 0
        for segment, (example, start, length, own) in enumerate(placed):
            out.append((example, start, length, own, sequence, segment, offset))
            offset += length
        sequence += 1
    return out


def _rows(values: np.ndarray, ends: np.ndarray, loss_before, keys: pa.Array, limits: Limits, first_sequence: int) -> tuple[pa.RecordBatch, int]:
    """The pieces of a block: values are all ids in a row, ends where each example ends."""
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    sizes = ends - starts
    table = np.array(pack_block(sizes, loss_before, limits), np.int64).reshape(-1, 7)
    view = memoryview(np.ascontiguousarray(values.astype("<u4"))).cast("B")
    at = starts[table[:, 0]] + table[:, 1]
    crc = [zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), table[:, 2].tolist())]
    order = np.lexsort((table[:, 1], table[:, 0]))
    number = np.empty(len(table), np.int32)
    first = np.flatnonzero(np.concatenate(([True], np.diff(table[order, 0]) > 0))) if len(table) else np.empty(0, np.int64)
    number[order] = np.arange(len(table)) - np.repeat(first, np.diff(np.append(first, len(table))))
    columns = [pa.array(number), pa.array(table[:, 1]), pa.array(table[:, 2]), pa.array(crc, pa.int64()), pa.array(sizes[table[:, 0]]), pa.array(table[:, 3]), pa.array(table[:, 4] + first_sequence), pa.array(table[:, 5].astype(np.int32)), pa.array(table[:, 6])]
    used = int(table[:, 4].max()) + 1 if len(table) else 0
    return pa.RecordBatch.from_arrays([keys.take(pa.array(table[:, 0])), *columns], ["doc_id", *(x.split(" ")[0] for x in SCHEMA.split(", "))]), used


def _first_of_task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId() << 36


def pack_documents(docs: DataFrame, path: str, limits: Limits = Limits(), end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, doc_tokens, loss_tokens, sequence_id, segment, offset: a row for each piece.

    All ids of a document bear loss, the end id included. A null or empty text is its end id alone;
    repeated rows are packed as often as they come; a null id stays null. No documents give no rows.
    Other columns are ignored, whatever their names. Sequence ids are unique, not gapless.
    """

    def run(rows):
        base, held, keys, total = _first_of_task(), [], [], 0

        def flush():
            nonlocal base, held, keys, total
            values = np.concatenate([v for v, _ in held])
            sizes = np.concatenate([s for _, s in held])
            batch, used = _rows(values, np.cumsum(sizes), lambda _, place: place, pa.concat_arrays(keys), limits, base)
            base, held, keys, total = base + used, [], [], 0
            return batch

        for part, (ids,) in token_batches(rows, path, (bpe.ids_bytes,)):
            offsets, data = views(ids)
            values = np.frombuffer(np.ascontiguousarray(data), "<u4")
            sizes = np.diff(offsets) // 4 + 1
            held.append((np.insert(values, offsets[1:] // 4, np.uint32(end_id)), sizes))
            keys.append(part.column(0))
            total += int(sizes.sum())
            if total >= BLOCK_TOKENS:
                yield flush()
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty()).mapInArrow(run, f"doc_id long, {SCHEMA}")


def pack_examples(examples: DataFrame, path: str, limits: Limits = Limits(loss=1024), key: str = "example_id", end_id: int = END_ID) -> DataFrame:
    """`key` and the columns of `pack_documents` but doc_id, for examples of several spans, a row each.

    examples: `key` long and `spans` array<struct<text string, bears_loss boolean>>, as a conversation's turns.
    An example's ids are its spans' in order, each with the end id behind it, which bears loss if its span
    does. Null texts count as empty, null flags as false; an example without spans has no piece.
    """
    schema = StructType.fromDDL(f"`{key}` long, {SCHEMA}")

    def run(rows):
        base, held, keys, total = _first_of_task(), [], [], 0

        def flush():
            nonlocal base, held, keys, total
            before = [np.concatenate(([0], np.cumsum(m))) for _, m in held]
            sizes = np.array([len(v) for v, _ in held], np.int64)
            batch, used = _rows(np.concatenate([v for v, _ in held]), np.cumsum(sizes), lambda e, place: int(before[e][place]), pa.array(keys, pa.int64()), limits, base)
            base, held, keys, total = base + used, [], [], 0
            return batch.rename_columns(schema.names)

        for batch in rows:
            spans = batch.column(1)
            (ids,) = bpe.encode_texts(path, spans.flatten().field(0), (bpe.ids_bytes,))
            offsets, data = views(ids)
            values = np.insert(np.frombuffer(np.ascontiguousarray(data), "<u4"), offsets[1:] // 4, np.uint32(end_id))
            ends = offsets // 4 + np.arange(len(offsets))  # behind each span, its end id counted
            loss = np.repeat(spans.flatten().field(1).to_numpy(zero_copy_only=False).astype(bool), np.diff(ends))
            of = np.asarray(spans.offsets) - spans.offsets[0].as_py()
            for k, a, b in zip(batch.column(0).to_pylist(), ends[of[:-1]].tolist(), ends[of[1:]].tolist()):
                held.append((values[a:b], loss[a:b]))
                keys.append(k)
                total += b - a
                if total >= BLOCK_TOKENS:
                    yield flush()
        if held:
            yield flush()

    spans = F.coalesce("spans", F.array().cast("array<struct<text: string, bears_loss: boolean>>"))
    spans = F.transform(spans, lambda s: F.struct(F.coalesce(s["text"], F.lit("")).alias("text"), F.coalesce(s["bears_loss"], F.lit(False)).alias("bears_loss")))
    return examples.select(F.col(key).cast("long").alias(key), spans.alias("spans")).mapInArrow(run, schema)
