"""Sequence packing by Karmarkar-Karp multiway differencing.

Each task packs its own partition: no shuffle, and its memory is one block of rests.  A document's ids are cut into
full sequences; what is left over stays whole, and differencing spreads the rests of a block over near-equal windows.
Where a window exceeds the capacity, ids are cut from its end, so few documents are cut and those once or twice; what
is cut off fills the windows with room.  Where there is not enough of that, the number of windows rises.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import TEXT_BYTES, doc_columns, slices, tokenizer_words

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Windows in a block of fragments that are packed together.
BLOCK_WINDOWS = 96


def difference(sizes: list[int], k: int) -> np.ndarray:
    """Window of each size after k-way differencing: the two partial partitions of widest spread are merged, the
    fullest windows of one with the emptiest of the other, until one partition is left.  Ties: the older first."""
    leaves = len(sizes)
    if k <= 1 or leaves <= 1:
        return np.zeros(leaves, dtype=np.int64)
    sums: list[np.ndarray | None] = []
    for size in sizes:
        s = np.zeros(k, dtype=np.int64)
        s[0] = size
        sums.append(s)
    heap = [(-size, i) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = sums[a] + sums[b][::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        sums[a] = sums[b] = None
        merges.append((a, b, order))
        sums.append(both)
        heapq.heappush(heap, (int(both[-1] - both[0]), len(sums) - 1))
    slots: list[np.ndarray | None] = [None] * len(sums)
    slots[-1] = np.arange(k)
    out = np.zeros(leaves, dtype=np.int64)
    for i in range(len(merges) - 1, -1, -1):
        a, b, order = merges[i]
        own, slots[leaves + i] = slots[leaves + i], None
        left = np.empty(k, dtype=np.int64)
        left[order] = own
        for child, at in ((a, left), (b, left[::-1])):
            if child < leaves:
                out[child] = at[0]
            else:
                slots[child] = at
    return out


def windows(sizes: list[int], capacity: int) -> tuple[np.ndarray, int]:
    """Window of each size, uncut, and the number of windows; no window holds more than ``capacity``."""
    if not sizes:
        return np.zeros(0, dtype=np.int64), 0
    if max(sizes) > capacity:
        raise ValueError("a rest exceeds the capacity")
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        at = difference(sizes, k)
        if np.bincount(at, weights=sizes, minlength=k).max() <= capacity:
            return at, k
        k += 1


def place(sizes: list[int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(item, start, length, window, offset) of the pieces of all items, and the number of windows.

    Items are spread by differencing over as few windows as their sum allows.  From a window that is too full the
    surplus is cut off the end of its largest items; the windows with room, widest first, take the cut-off ids.
    """
    if not sizes:
        return [], 0
    if max(sizes) > capacity:
        raise ValueError("a rest exceeds the capacity")
    k = max(1, -(-sum(sizes) // capacity))
    members: list[list[int]] = [[] for _ in range(k)]
    for item, w in enumerate(difference(sizes, k).tolist()):
        members[w].append(item)
    left = list(sizes)
    surplus: list[tuple[int, int, int]] = []  # (item, start, length)
    fill = [sum(sizes[i] for i in own) for own in members]
    for w, own in enumerate(members):
        for item in sorted(own, key=lambda i: (-sizes[i], i)):
            if (over := fill[w] - capacity) <= 0:
                break
            off = min(over, left[item] - 1) if len(own) > 1 else over
            if off > 0:
                left[item] -= off
                fill[w] -= off
                surplus.append((item, left[item], off))
    out, at = [], [0] * k
    for w, own in enumerate(members):
        for item in own:
            out.append((item, 0, left[item], w, at[w]))
            at[w] += left[item]
    room = [(-(capacity - f), w) for w, f in enumerate(at) if f < capacity]
    heapq.heapify(room)
    for item, start, length in sorted(surplus, key=lambda x: (-x[2], x[0], x[1])):
        while length:
            if not room:  # differencing left no room: one window more
                room, k = [(-capacity, k)], k + 1
                at.append(0)
            free, w = heapq.heappop(room)
            part = min(length, -free)
            out.append((item, start, part, w, at[w]))
            at[w] += part
            start, length = start + part, length - part
            if at[w] < capacity:
                heapq.heappush(room, (free + part, w))
    return out, k


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the full sequences of ``total`` ids and of the rest behind them."""
    return [(a, min(capacity, total - a)) for a in range(0, total, capacity)]


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0, special_as_text: bool = False) -> DataFrame:
    """Pieces of all documents, each in one sequence of at most ``capacity`` ids.

    Null and empty texts are the end id alone; a null ``doc_id`` stays null; repeated rows are packed each for itself;
    an empty table gives no row; other columns are ignored.  ``sequence_id`` is unique over all tasks.  Strings of
    special tokens get the library's ids (``special_as_text``: they are ordinary text).
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        encoder = tokenizer_words(tokenizer_path, True, special_as_text)
        base = TaskContext.get().partitionId() << 40
        used, rows, small, held = 0, [], [], 0

        def settle():
            nonlocal used, small, held
            pieces, k = place([p[2] for p in small], capacity)
            for item, begin, length, w, offset in pieces:
                doc, start, _, own, total = small[item]
                part = own if length == len(own) // 4 else own[4 * begin : 4 * (begin + length)]
                rows.append((doc, start + begin, length, zlib.crc32(part), total, base + used + w, offset))
            used, small, held = used + k, [], 0

        def batch():
            nonlocal rows
            cols = list(zip(*rows)) if rows else [[]] * 7
            rows = []
            return pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in slices(texts, TEXT_BYTES):
                for doc, own in zip(ids[i:j], encoder.encode(texts[i:j])):
                    own += end
                    total = len(own) // 4
                    for start, length in cut(total, capacity):
                        part = own[4 * start : 4 * (start + length)]
                        if length == capacity:
                            rows.append((doc, start, length, zlib.crc32(part), total, base + used, 0))
                            used += 1
                        else:
                            small.append((doc, start, length, part, total))
                            held += length
                            if held >= BLOCK_WINDOWS * capacity:
                                settle()
                if len(rows) >= 20_000:
                    yield batch()
        settle()
        yield batch()

    return doc_columns(docs).mapInArrow(run, SCHEMA)
