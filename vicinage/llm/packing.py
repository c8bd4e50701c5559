"""Cost-balanced packing of documents into sequences of fixed length.

A document costs a linear part and, for attention, a quadratic part in its tokens. A task packs shards of consecutive
documents: the shard's sequences number as few as hold its tokens; pieces go in order of falling length to the sequence
of lowest cost that has room, and where none has room a piece is cut to fill the roomiest. So padding is less than one
sequence a shard, and nothing is shuffled.

Cases: a null or empty text is its end id alone; documents of any length are cut into full sequences and a rest; repeated
rows are packed each; an empty table gives an empty table; only the named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .encoding import SeenPieces, encoded_slabs, encoder

CAPACITY = 2048
#: Cost of n tokens of one document: n * LINEAR + n * n. The linear part stands for the layers' width.
LINEAR = 6 * 1024
#: Tokens of a shard.
SHARD_TOKENS = 1 << 21


class _Room:
    """Sequences by free tokens; finds the cheapest with at least so many."""

    def __init__(self, capacity: int, n: int):
        self.size = 1 << capacity.bit_length()
        self.best = [None] * (2 * self.size)
        self.held = [[] for _ in range(capacity + 1)]
        self.held[capacity] = [(0, k) for k in range(n)]
        self._fresh(capacity)

    def _fresh(self, free: int) -> None:
        best, at = self.best, self.size + free
        best[at] = self.held[free][0] if self.held[free] else None
        while at > 1:
            at >>= 1
            a, b = best[2 * at], best[2 * at + 1]
            best[at] = a if b is None or (a is not None and a <= b) else b

    def cheapest(self, least: int):
        """(cost, sequence) of the cheapest with ``least`` or more free tokens."""
        best, found, at = self.best, None, self.size + least
        found = best[at]
        while at > 1:
            if not at & 1 and best[at + 1] is not None and (found is None or best[at + 1] < found):
                found = best[at + 1]
            at >>= 1
        return found

    def roomiest(self) -> int:
        at = 1
        while at < self.size:
            at = 2 * at + 1 if self.best[2 * at + 1] is not None else 2 * at
        return at - self.size

    def take(self, free: int) -> tuple[int, int]:
        got = heapq.heappop(self.held[free])
        self._fresh(free)
        return got

    def put(self, free: int, cost: int, k: int) -> None:
        if free:
            heapq.heappush(self.held[free], (cost, k))
            self._fresh(free)


def pack(lengths: list[int], capacity: int = CAPACITY, linear: int = LINEAR) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (document, start, length, sequence, offset) and the number of sequences for documents of these lengths."""
    out, k, rests = [], 0, []
    for doc, n in enumerate(lengths):
        whole = n // capacity
        out.extend((doc, j * capacity, capacity, k + j, 0) for j in range(whole))
        k += whole
        if n % capacity:
            rests.append((-(n % capacity), doc, whole * capacity))
    n = -(-sum(-x[0] for x in rests) // capacity)
    room, free = _Room(capacity, n), [capacity] * n
    heapq.heapify(rests)
    while rests:
        length, doc, start = heapq.heappop(rests)
        length = -length
        found = room.cheapest(length)
        if found is None:
            space = room.roomiest()
            cost, s = room.take(space)
            heapq.heappush(rests, (space - length, doc, start + space))
            length = space
        else:
            cost, s = found
            room.take(free[s])
        out.append((doc, start, length, k + s, capacity - free[s]))
        free[s] -= length
        room.put(free[s], cost + length * linear + length * length, s)
    return out, k + n


def pack_documents(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: key, ``start`` and ``length`` in the document's ids, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id`` and ``offset`` in the sequence; with ``with_ids`` also the ids."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        encode, added = encoder(path, pattern)
        seen = SeenPieces()
        keys, held, total = [], [], 0

        def shard(key_type):
            nonlocal made
            pieces, n = pack([len(x) for x in held], capacity)
            first = (part << 40) + made
            made += n
            for j in range(0, len(pieces), 20_000):
                some = pieces[j : j + 20_000]
                cut = [held[d][a : a + m] for d, a, m, _, _ in some]
                d, a, m, s, o = (np.array(x, np.int64) for x in zip(*some))
                columns = [pa.array([keys[x] for x in d.tolist()], key_type), pa.array(a), pa.array(m), pa.array([zlib.crc32(x.tobytes()) for x in cut], pa.int64()), pa.array([len(held[x]) for x in d.tolist()], pa.int64()), pa.array(first + s), pa.array(o)]
                names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                if with_ids:
                    columns, names = [*columns, pa.array([x.astype(np.int32) for x in cut], pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

        key_type = pa.int64()
        for batch in batches:
            key_type = batch.column(0).type
            for row, ids, at in encoded_slabs(batch.column(1), encode, added, seen):
                keys.extend(batch.column(0).slice(row, len(at) - 1).to_pylist())
                ids = ids.astype("<u4")
                held.extend(np.append(ids[a:b], np.array(end_id, "<u4")) for a, b in zip(at[:-1].tolist(), at[1:].tolist()))
                total += len(ids) + len(at) - 1
                if total >= SHARD_TOKENS:
                    yield from shard(key_type)
                    keys, held, total = [], [], 0
        if keys:
            yield from shard(key_type)

    schema = f"{key} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return df.select(key, text).mapInArrow(run, schema + ", ids array<int>" * with_ids)


def packed(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def query(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
