"""Packing of tokenised documents into fixed windows by minimum bin slack.

Every document's ids are cut into full windows and one remainder shorter than a window. The remainders of a partition
form pools; a pool is only its multiset of lengths. For the longest length left, a subset-sum over a bit set (bit s of
an integer: some multiset of the lengths left sums to s) finds the multiset that fills the rest of the window closest
to capacity, and walking the bit sets back gives how often each length is used. That pattern is taken as often as the
counts allow. Lengths that no multiset completes wait for later pools; what is left at the end is laid in a row and
cut at window edges, and the last, shorter stretch becomes sequences whose lengths are powers of two, so nothing is
padded unless a tolerance is asked for.

A partition is packed on its own: no shuffle, memory for one pool, and any split of the input gives full windows.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from stratacloud.llm.common import slices
from stratacloud.llm.tokens import encoder

CAPACITY = 2048
POOL = 8192         # remainders held at once by a task
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "ids binary")


def best_fill(counts: dict[int, int], room: int) -> tuple[int, dict[int, int]]:
    """The multiset of lengths, at most counts of each, whose sum is nearest to room without passing it: its sum and how
    often it uses each length. Longer lengths are tried first, and the search stops at an exact fill."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((n for n in counts if 0 < n <= room), reverse=True):
        most = min(counts[length], room // length)
        if not most:
            continue
        steps.append((length, most, reach))
        left, chunk = most, 1
        while left:
            take = min(chunk, left)
            reach |= (reach << (length * take)) & mask
            left -= take
            chunk *= 2
        if reach >> room & 1:
            break
    best = need = reach.bit_length() - 1
    used = {}
    for length, most, before in reversed(steps):
        times = next(k for k in range(most + 1) if k * length <= need and before >> (need - k * length) & 1)
        if times:
            used[length] = times
            need -= times * length
    return best, used


def plan(counts: dict[int, int], capacity: int = CAPACITY, tolerance: int = 0) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """Patterns (times used per length, number of windows) whose slack is at most tolerance, and the counts left over."""
    left, patterns, over = {n: c for n, c in counts.items() if c}, [], {}
    while left:
        seed = max(left)
        left[seed] -= 1
        filled, used = best_fill(left, capacity - seed)
        left[seed] += 1
        if capacity - seed - filled > tolerance:
            over[seed] = left.pop(seed)
            continue
        used[seed] = used.get(seed, 0) + 1
        times = min(left[n] // k for n, k in used.items())
        for n, k in used.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
        patterns.append((used, times))
    return patterns, over


class _Packer:
    """Packs one partition. A piece is (doc_id, start, ids, tokens of its document)."""

    def __init__(self, first_sequence: int, capacity: int, tolerance: int, keep_ids: bool):
        self.sequence, self.capacity, self.tolerance, self.keep_ids = first_sequence, capacity, tolerance, keep_ids
        self.pool: list[tuple] = []
        self.rows: list[tuple] = []

    def _window(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            raw = ids.astype("<u4").tobytes()
            self.rows.append((doc, start, len(ids), zlib.crc32(raw), total, self.sequence, offset, raw if self.keep_ids else None))
            offset += len(ids)
        self.sequence += 1

    def _cut(self, pieces: list[tuple], size: int) -> list[tuple]:
        """Lay pieces in a row, emit windows of size, return the pieces of the last incomplete one."""
        window, filled = [], 0
        for doc, start, ids, total in pieces:
            while len(ids):
                part, ids = ids[:size - filled], ids[size - filled:]
                window.append((doc, start, part, total))
                start, filled = start + len(part), filled + len(part)
                if filled == size:
                    self._window(window)
                    window, filled = [], 0
        return window

    def add(self, doc, ids: np.ndarray) -> None:
        total, full = len(ids), len(ids) - len(ids) % self.capacity
        for start in range(0, full, self.capacity):
            self._window([(doc, start, ids[start:start + self.capacity], total)])
        if full < total:
            self.pool.append((doc, full, ids[full:].copy(), total))

    def settle(self, last: bool = False) -> None:
        by_length: dict[int, deque] = {}
        for piece in self.pool:
            by_length.setdefault(len(piece[2]), deque()).append(piece)
        patterns, _ = plan({n: len(q) for n, q in by_length.items()}, self.capacity, self.tolerance)
        for used, times in patterns:
            for _ in range(times):
                self._window([by_length[n].popleft() for n, k in used.items() for _ in range(k)])
        self.pool = [p for n in sorted(by_length, reverse=True) for p in by_length[n]]
        if last or len(self.pool) > POOL // 2:
            self.pool = self._cut(self.pool, self.capacity)
        if last:
            size = self.capacity
            while self.pool:
                size //= 2
                if sum(len(p[2]) for p in self.pool) >= size:
                    self.pool = self._cut(self.pool, size)


def pack(docs: DataFrame, tokenizer: str, end: int = 1, capacity: int = CAPACITY, tolerance: int = 0, keep_ids: bool = True) -> DataFrame:
    """Pack the texts of docs (doc_id, text) into sequences of at most capacity tokens; capacity is a power of two.

    One row per piece: doc_id, start (ids of its document before it), length, ids_crc32, doc_tokens, sequence_id, offset
    (gapless from 0 in its sequence), ids (little-endian unsigned 32-bit; null unless keep_ids). Null and empty texts
    give one piece holding the id end. Each row of docs is packed for itself: repeated rows and null ids keep their own
    pieces. Other columns are ignored; an empty table gives no rows. Sequence ids are unique, not consecutive.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        types = [pa.int64()] * 7 + [pa.binary()]
        packer = _Packer(TaskContext.get().partitionId() << 40, capacity, tolerance, keep_ids)

        def out() -> pa.RecordBatch:
            columns = list(zip(*packer.rows, strict=True)) or [()] * len(names)
            packer.rows = []
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        ids_of = encoder(tokenizer)
        for batch in slices(batches, 1 << 20):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), ids_of.encode(batch, end), strict=True):
                packer.add(doc, ids)
                if len(packer.pool) >= POOL:
                    packer.settle()
            yield out()
        packer.settle(last=True)
        yield out()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
