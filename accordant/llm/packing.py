"""Packing documents into sequences by minimum bin slack.

Whole windows are cut off long documents first.  What remains of each document
is a length below the capacity; windows are filled from the counts of those
lengths.  A bitset of reachable sums finds the multiset that comes closest to
capacity, and a walk back through its stages says how many of each length to
take.  A window that no multiset fills is completed with a cut from one more
document; the last window of a task is cut at powers of two, which need no
padding.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.llm import bpe

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Remainders that wait in a task before windows are filled: at most this many times the capacity in ids.
WAITING = 4096
DOCS_AT_ONCE = 1024
ROWS_AT_ONCE = 4096


class Rest(NamedTuple):
    """A stretch of a document that has no sequence yet."""

    doc_id: int | None
    start: int
    ids: bytes
    doc_tokens: int


def closest_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length to take so that their sum is as near ``room`` as can be.

    Lengths are tried from the longest; the first multiset that reaches the best
    sum is taken, which keeps the pieces few.  ``counts`` is not changed.
    """
    mask = (1 << (room + 1)) - 1
    reach, stages = 1, []
    for length in sorted((n for n in counts if n <= room and counts[n]), reverse=True):
        # Blocks of 1, 2, 4, ... copies stand for any number up to the count.
        left, block = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            block = min(block, left)
            stages.append((length, block, reach))
            reach |= reach << (length * block) & mask
            left -= block
            block *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    taken: dict[int, int] = {}
    for length, block, earlier in reversed(stages):
        if not earlier >> total & 1:
            taken[length] = taken.get(length, 0) + block
            total -= length * block
    return taken


class Packer:
    """Fills windows from a bounded pool of remainders."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.sequence = capacity, first_sequence
        self.pool: dict[int, deque[Rest]] = {}
        self.waiting = 0
        self.pieces: list[tuple] = []

    def put(self, rest: Rest) -> None:
        self.pool.setdefault(len(rest.ids) // 4, deque()).append(rest)
        self.waiting += 1

    def take(self, length: int) -> Rest:
        line = self.pool[length]
        rest = line.popleft()
        if not line:
            del self.pool[length]
        self.waiting -= 1
        return rest

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """Cut whole windows off a document; the remainder waits."""
        tokens, window = len(ids) // 4, self.capacity
        whole = tokens - tokens % window
        for start in range(0, whole, window):
            self.emit([Rest(doc_id, start, ids[4 * start : 4 * (start + window)], tokens)])
        if whole < tokens:
            self.put(Rest(doc_id, whole, ids[4 * whole :], tokens))
        if self.waiting >= WAITING:
            self.fill(WAITING // 2)

    def emit(self, window: list[Rest]) -> None:
        offset = 0
        for r in window:
            length = len(r.ids) // 4
            self.pieces.append((r.doc_id, r.start, length, zlib.crc32(r.ids), r.doc_tokens, self.sequence, offset))
            offset += length
        self.sequence += 1

    def fill(self, down_to: int = 0) -> None:
        """Fill windows until so few remainders wait, or too few ids for a window."""
        while self.waiting > down_to and self.fill_one():
            pass

    def fill_one(self) -> bool:
        window = [self.take(max(self.pool))]
        room = self.capacity - len(window[0].ids) // 4
        for length, n in closest_fill({n: len(line) for n, line in self.pool.items()}, room).items():
            window += [self.take(length) for _ in range(n)]
            room -= n * length
        if room:
            if not self.pool:
                for r in window:
                    self.put(r)
                return False
            # No multiset fills it: every remainder left is longer than the room.
            r = self.take(min(n for n in self.pool if n > room))
            window.append(r._replace(ids=r.ids[: 4 * room]))
            self.put(r._replace(start=r.start + room, ids=r.ids[4 * room :]))
        self.emit(window)
        return True

    def finish(self) -> None:
        """The ids too few for a window become sequences of 1024, 512, 256 ... ids."""
        self.fill()
        rest = [self.take(n) for n in sorted(self.pool, reverse=True) for _ in range(len(self.pool[n]))]
        total = sum(len(r.ids) // 4 for r in rest)
        while total:
            room = 1 << (total.bit_length() - 1)
            total -= room
            window = []
            while room:
                r = rest.pop(0)
                length = min(room, len(r.ids) // 4)
                window.append(r._replace(ids=r.ids[: 4 * length]))
                if 4 * length < len(r.ids):
                    rest.insert(0, r._replace(start=r.start + length, ids=r.ids[4 * length :]))
                room -= length
            self.emit(window)

    def drain(self, at_least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.pieces) >= at_least:
            arrays = [pa.array(column, pa.int64()) for column in zip(*self.pieces)]
            self.pieces = []
            yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in PIECES.split(", ")])


def pack(docs: DataFrame, vocab: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece of a document, with its sequence and place there.

    Each partition packs its own documents while it reads them, so nothing is
    shuffled and a lost task only repeats its part.  Every sequence is exactly
    full, but for less than one window per partition, whose sequences have
    lengths that are powers of two.  Null and empty texts are documents of the
    end id alone; repeated rows are packed as separate documents; a null id
    stays null.  Other columns are left out.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    end = np.uint32(end_id).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.vocabulary(vocab)
        packer = Packer(capacity, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(at, DOCS_AT_ONCE)
                for doc_id, ids in zip(part["doc_id"].to_pylist(), coder.encode(part["text"])):
                    packer.add(doc_id, ids + end)
                yield from packer.drain(ROWS_AT_ONCE)
        packer.finish()
        yield from packer.drain()

    return plain.mapInArrow(run, PIECES)
