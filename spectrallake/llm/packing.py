"""Cost-balanced packing of token sequences.

The cost of a piece of n tokens is linear + quadratic, 6 * width * n + n * n in units of 4 * width operations: the dense
layers and the attention of a transformer of that width. Documents go, longest first, to the sequence of least cost that
has room; what does not fit goes on to the next one. Sequences hold `capacity` tokens. What is left over at the end of a
group makes sequences whose lengths are powers of two, so no padding is needed.

Each task packs its own rows in groups of bounded size: no shuffle, no state that grows with the input, and a lost task
is repeated with the same result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, release
from .wordcache import encoder

#: Tokens that a task gathers before it packs them.
GROUP_TOKENS = 4_000_000


def pack(lengths: list[int], capacity: int = 2048, width: int = 1024) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of the pieces; each token is in one piece, offsets have no gap."""
    pieces, n_full, rest = [], 0, []
    for d, n in enumerate(lengths):
        whole = n // capacity
        for k in range(whole):
            pieces.append((d, k * capacity, capacity, n_full, 0))
            n_full += 1
        if n % capacity:
            rest.append((n % capacity, d, whole * capacity))
    total = sum(r[0] for r in rest)
    room = [capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if (total % capacity) >> b & 1]
    # The short sequences at the end come last whatever their cost.
    heap = [(room[s] < capacity, 0, s) for s in range(len(room))]
    heapq.heapify(heap)
    used = [0] * len(room)
    for n, d, start in sorted(rest, key=lambda r: (-r[0], r[1])):
        while n:
            short, cost, s = heapq.heappop(heap)
            take = min(n, room[s] - used[s])
            pieces.append((d, start, take, n_full + s, used[s]))
            used[s] += take
            start += take
            n -= take
            if used[s] < room[s]:
                heapq.heappush(heap, (short, cost + 6 * width * take + take * take, s))
    return pieces


def _run(path: str, capacity: int, width: int, end_id: int, group_tokens: int):
    def flush(ids: list, data: list[bytes], number: int):
        pieces = pack([len(x) // 4 for x in data], capacity, width)
        pieces.sort(key=lambda p: (p[3], p[4]))
        base = TaskContext.get().partitionId() << 36
        for k in range(0, len(pieces), 2000):
            part = pieces[k : k + 2000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[p[0]] for p in part], pa.int64()),
                    pa.array([p[1] for p in part], pa.int64()),
                    pa.array([p[2] for p in part], pa.int64()),
                    pa.array([data[p[0]][4 * p[1] : 4 * (p[1] + p[2])] for p in part], pa.binary()),
                    pa.array([len(data[p[0]]) // 4 for p in part], pa.int64()),
                    pa.array([base + number + p[3] for p in part], pa.int64()),
                    pa.array([p[4] for p in part], pa.int64()),
                ],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path).encode, end_id.to_bytes(4, "little")
        ids, data, size, number = [], [], 0, 0
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                for doc_id, b in zip(part.column("doc_id").to_pylist(), encode(part.column("text").to_pylist()), strict=True):
                    ids.append(doc_id)
                    data.append(b + end)
                    size += len(b) // 4 + 1
                    if size >= group_tokens:
                        yield from flush(ids, data, number)
                        number += size
                        ids, data, size = [], [], 0
        if ids:
            yield from flush(ids, data, number)
        encoder(path).forget()
        release()

    return run


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, width: int = 1024, end_id: int = 1, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Pieces of docs(doc_id, text, ...) in sequences: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    tokenizer: a file of the tokenizers library that every worker can open. Each document ends with end_id, so null and
    empty texts make one piece of one token. Rows that repeat are packed as often as they occur; a null doc_id stays
    null; other columns are ignored; an empty table has no pieces. capacity is a power of two. sequence_id is unique
    and the same whenever the input is split alike.
    """
    bound_batches(docs.sparkSession)
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _run(tokenizer, capacity, width, end_id, group_tokens),
        "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long",
    )


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
