"""Packing documents into sequences of one capacity by Karmarkar-Karp multiway differencing.

Runs of capacity ids of a long document are sequences of their own. What is left of each document is cut into blocks of
BLOCK ids and one of what remains, before anything is packed: many sizes make sums near equal. The blocks of a bounded number
of neighbouring documents (CHUNK) are packed together, where the documents are: nothing is shuffled, and a lost task makes
the same sequences again.

Differencing keeps partial partitions into k windows. It merges the two whose largest and smallest window differ most,
the largest windows of one with the smallest of the other, until one is left, with near-equal windows. k begins at the
least that could do and rises whenever a window is over the capacity, until all fit; nothing is cut after that. Where sizes
are such that this pads more than PADDING and one sequence (all documents being equally long, say), blocks are made half as
large and differenced anew, down to LEAST ids. Blocks of one document that follow each other in a window are one piece.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import store, tokens
from .text_block import blocks

CAPACITY, CHUNK, BLOCK, LEAST, PADDING = 2048, 2048, 512, 16, 0.01


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """The items (their positions) of k windows of near-equal sums."""
    if k == 1:
        return [list(range(len(sizes)))]
    # A partial partition: (-sum, serial, items) of its windows, the largest first; windows at zero are left out.
    heap = [(-s, i, [(-s, i, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    count = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        meet = min(max(0, len(a) + len(b) - k), len(a), len(b))
        if meet == 0:
            for window in b:
                insort(a, window)
        else:
            # The windows of the two that must share: the smallest of the longer with the largest of the shorter.
            if len(a) < len(b):
                a, b = b, a
            a[-meet:] = [(x[0] + y[0], x[1], x[2] + y[2]) for x, y in zip(a[-meet:], reversed(b[:meet]), strict=True)]
            a += b[meet:]
            a.sort()
        count += 1
        least = a[-1][0] if len(a) == k else 0
        heapq.heappush(heap, (a[0][0] - least, count, a))
    windows = [items for _, _, items in heap[0][2]] if heap else []
    return windows + [[] for _ in range(k - len(windows))]


def blocks_of(sizes: list[int], block: int) -> list[tuple[int, int, int]]:
    """(item, start in the item, length) of the items cut into blocks."""
    return [(i, at, min(block, s - at)) for i, s in enumerate(sizes) for at in range(0, s, block)]


def fitting(lengths: list[int], capacity: int) -> list[list[int]]:
    """The windows of differencing at the count that the rise from the least one ends at; none is over the capacity."""
    total = sum(lengths)
    k = -(-total // capacity)
    while True:
        windows = difference(lengths, k)
        most = max((sum(lengths[i] for i in w) for w in windows), default=0)
        if most <= capacity:
            return windows
        # If windows kept their distance from the mean, this count would do; go half the way, lest it be more than it takes.
        room = capacity - (most - total / k)
        k += max(1, (-int(-total // room) - k) // 2) if room > 0 else k


def pack(sizes: list[int], capacity: int = CAPACITY, block: int = BLOCK) -> list[list[tuple[int, int, int]]]:
    """Windows of (item, start in the item, length); each at most capacity, sizes being at least 1."""
    total = sum(sizes)
    while True:
        cut = blocks_of(sizes, min(block, capacity))
        windows = fitting([c[2] for c in cut], capacity)
        if block <= LEAST or len(windows) * capacity - total <= PADDING * total + capacity:
            break
        block //= 2
    out = []
    for w in windows:
        pieces: list[tuple[int, int, int]] = []
        for item, start, length in sorted(cut[i] for i in w):
            if pieces and pieces[-1][0] == item and pieces[-1][1] + pieces[-1][2] == start:
                pieces[-1] = (item, pieces[-1][1], pieces[-1][2] + length)
            else:
                pieces.append((item, start, length))
        if pieces:
            out.append(pieces)
    return out


PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _packer(path: str, end_id: int, capacity: int, with_ids: bool, plain: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path, plain).encode
        end = np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 33
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
        rows: list[list] = [[] for _ in names]
        held: list[tuple[int, bytes, int, int]] = []  # place of the id, ids, start, ids of the document
        places: list = []

        def put(place: int, ids: bytes, start: int, whole: int, offset: int) -> None:
            for k, v in enumerate((place, start, len(ids) // 4, zlib.crc32(ids), whole, sequence, offset, *[ids] * with_ids)):
                rows[k].append(v)

        def flush() -> None:
            nonlocal sequence, held
            for window in pack([len(h[1]) // 4 for h in held], capacity):
                offset = 0
                for i, a, n in window:
                    place, ids, start, whole = held[i]
                    put(place, ids[4 * a : 4 * (a + n)], start + a, whole, offset)
                    offset += n
                sequence += 1
            held = []

        def batch_of(kind: pa.DataType) -> pa.RecordBatch:
            arrays = [pa.array([places[i] for i in rows[0]], kind)] + [pa.array(c, pa.int64()) for c in rows[1:7]]
            if with_ids:
                ends = np.cumsum([0] + [len(x) // 4 for x in rows[7]]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows[7]), "<i4"))))
            for c in rows:
                c.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for row, to, block in blocks(batch.column(1), tokens.BLOCK):
                flat, bounds = encode(block)
                for n, doc_id in enumerate(batch.column(0).slice(row, to - row).to_pylist()):
                    ids = flat[bounds[n] : bounds[n + 1]].astype("<u4").tobytes() + end
                    whole, place = len(ids) // 4, len(places)
                    places.append(doc_id)
                    full = whole - whole % capacity
                    for start in range(0, full, capacity):
                        put(place, ids[4 * start : 4 * (start + capacity)], start, whole, 0)
                        sequence += 1
                    if full < whole:
                        held.append((place, ids[4 * full :], full, whole))
                    if len(held) == CHUNK:
                        flush()
                        yield batch_of(kind)
                        places.clear()
        if kind is not None:
            flush()
            yield batch_of(kind)

    return run


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, plain: bool = False
) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids if asked for.

    A document is the ids of its text and end_id. start: its ids before the piece; offset: ids before it in its
    sequence, gapless. ids_crc32: of the ids as little-endian unsigned 32-bit integers. Null text counts as empty
    and leaves one id, end_id. Repeated rows are documents each; a null id stays null. An empty table gives an
    empty result. plain: strings of the tokenizer's own tokens in a text are ordinary text. Sequences are whole within a partition of docs, so the same partitions give the same sequences.
    """
    rows = docs.select(store.col(id_col).alias("doc_id"), store.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(_packer(tokenizer_path, end_id, capacity, with_ids, plain), f"doc_id {kind}, {PIECE}" + (", ids array<int>" if with_ids else ""))
    return out.withColumnRenamed("doc_id", id_col)
