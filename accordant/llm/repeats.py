"""Passages that stand earlier in the corpus, found by a logarithmic family of suffix arrays.

A window is a stretch of a fixed number of bytes; every byte of a window that
also starts earlier is to go.  Windows are dealt by an anchor, the short gram in
them whose hash is smallest: equal windows have equal anchors, and neighbours
mostly share theirs, so a text falls into runs of windows with one anchor.  Runs
whose anchor occurs once cannot hold a repeat and stay where they are.  The
others go, with the bytes they cover, to the bucket of their anchor.

A bucket takes its runs in the order of documents, batch by batch.  Each batch
gets a suffix array of its windows, which is merge-scanned against the levels the
bucket already has; windows that are new become a level, and levels of like size
are merged, so their number stays logarithmic.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordant.llm.common import keep, shuffle_width

WIDTH = 100
GRAM = 32
#: Bytes whose windows are looked at together; a longer text is taken in stretches.
STRETCH = 1 << 18
#: Windows of one run that travel in one row, and windows of one batch.
WINDOWS_PER_ROW = 4096
WINDOWS_PER_BATCH = 1 << 17
#: Rows a bucket takes on average; their number grows with the input.
ROWS_PER_BUCKET = 25_000
#: Anchors with more runs than this are collapsed in salted groups first.
HOT = 1024

_POSITION = np.uint64(0xFFFFFF)
_FACTOR = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` bytes; ``size`` is a power of two."""
    h, factor, half = data.astype(np.uint64) + np.uint64(1), _FACTOR, 1
    while half < size:
        n = len(h) - half
        h = h[:n] * np.uint64(factor) + h[half:]
        factor, half = factor * factor % 2**64, 2 * half
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def smallest_within(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours."""
    span = 1
    while 2 * span <= width:
        values, span = np.minimum(values[:-span], values[span:]), 2 * span
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def runs(pieces: Sequence[bytes], width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: piece, first window there, windows, anchor, and
    whether the anchor stands in the run more than once.

    Of equal hashes in a window the leftmost counts, so that anchors depend on
    nothing but the window.
    """
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    start = np.cumsum(size) - size
    data = np.frombuffer(b"".join(pieces), np.uint8)
    if not (size >= width).any():
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(bool)
    h = gram_hashes(data, gram)
    spot = np.arange(len(h), dtype=np.uint64)
    q = smallest_within(h & ~_POSITION | spot, width - gram + 1) & _POSITION
    edges = np.zeros(len(q) + 1, np.int8)
    enough = size >= width
    np.add.at(edges, start[enough], 1)
    np.add.at(edges, (start + size)[enough] - width + 1, -1)
    at = np.flatnonzero(np.cumsum(edges, dtype=np.int8)[:-1])
    q = q[at].astype(np.int64)
    anchor = h[q]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    piece = np.searchsorted(start, at[first], "right") - 1
    return piece, at[first] - start[piece], count, anchor[first].view(np.int64), q[first] != q[first + count - 1]


def stretches(texts: Sequence[bytes], width: int = WIDTH) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts a few at a time: number and offset of each piece, and the pieces.

    A long text is cut so that each window lies in exactly one piece.
    """
    numbers: list[int] = []
    offsets: list[int] = []
    pieces: list[bytes] = []
    waiting = 0
    for number, text in enumerate(texts):
        for offset in range(0, max(1, len(text) - width + 1), STRETCH):
            piece = text[offset : offset + STRETCH + width - 1]
            numbers.append(number)
            offsets.append(offset)
            pieces.append(piece)
            waiting += len(piece)
            if waiting >= STRETCH:
                yield numbers, offsets, pieces
                numbers, offsets, pieces, waiting = [], [], [], 0
    if pieces:
        yield numbers, offsets, pieces


class IndexFamily:
    """Distinct windows, as sorted suffix arrays of geometrically growing size."""

    def __init__(self, width: int = WIDTH):
        self.width = width
        self.levels: list[np.ndarray] = []

    def add(self, data: bytes, at: np.ndarray) -> np.ndarray:
        """Take in the windows that start at ``at``, in reading order.

        Returns which of them stand earlier, in this batch or in one before.
        """
        windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), self.width)[at]
        # Fixed width: bytes compare as they are, and zeros at the end make no difference.
        keys = np.ascontiguousarray(windows).view(f"S{self.width}").ravel()
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        earlier = np.zeros(len(keys), bool)
        earlier[1:] = keys[1:] == keys[:-1]
        fresh = np.flatnonzero(~earlier)
        for level in self.levels:
            wanted = keys[fresh]
            place = np.minimum(np.searchsorted(level, wanted), len(level) - 1)
            found = level[place] == wanted
            earlier[fresh[found]] = True
            fresh = fresh[~found]
        if len(fresh):
            self.levels.append(keys[fresh])
            while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
                small, large = sorted((self.levels.pop(), self.levels.pop()), key=len)
                self.levels.append(np.insert(large, np.searchsorted(large, small), small))
        out = np.empty(len(keys), bool)
        out[order] = earlier
        return out


# --- tables ---------------------------------------------------------------------------


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, row, bytes``; the row number is a hash of id and text."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return plain.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.col("text").cast("binary").alias("bytes"))


def _anchors(rows: DataFrame, width: int, gram: int) -> DataFrame:
    """``anchor, row``: one row per run, two where the anchor stands in it twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch["row"].to_numpy()
            for numbers, _, pieces in stretches(batch["bytes"].to_pylist(), width):
                piece, _, _, anchor, twice = runs(pieces, width, gram)
                times = 1 + twice.astype(np.int64)
                owner = row[np.array(numbers, np.int64)[piece]]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(anchor, times)), pa.array(np.repeat(owner, times))], names=["anchor", "row"])

    return rows.select("row", "bytes").where(F.length("bytes") >= width).mapInArrow(run, "anchor long, row long")


def _snippets(rows: DataFrame, width: int, gram: int) -> DataFrame:
    """The runs whose anchors are wanted, with the bytes they cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = {c: (batch[c].offsets.to_numpy(), batch[c].flatten().to_numpy()) for c in ("wanted", "hot")}

            def of(column: str, numbers: list[int]) -> np.ndarray:
                offsets, values = lists[column]
                base = offsets[0]
                return values[offsets[numbers[0]] - base : offsets[numbers[-1] + 1] - base]

            row, doc = batch["row"], batch["doc_id"]
            for numbers, offsets, pieces in stretches(batch["bytes"].to_pylist(), width):
                piece, first, count, anchor, _ = runs(pieces, width, gram)
                here = np.isin(anchor, of("wanted", numbers))
                piece, first, count, anchor = piece[here], first[here], count[here], anchor[here]
                # A long run travels in several rows.
                parts = -(-count // WINDOWS_PER_ROW)
                again = np.repeat(np.arange(len(count)), parts)
                skip = (np.arange(len(again)) - np.repeat(np.cumsum(parts) - parts, parts)) * WINDOWS_PER_ROW
                piece, first, anchor = piece[again], first[again] + skip, anchor[again]
                count = np.minimum(count[again] - skip, WINDOWS_PER_ROW)
                text = [pieces[p][a : a + n + width - 1] for p, a, n in zip(piece.tolist(), first.tolist(), count.tolist())]
                owner = pa.array(np.array(numbers, np.int64)[piece])
                made = [pa.array(anchor), pa.array(np.isin(anchor, of("hot", numbers))), doc.take(owner), row.take(owner)]
                made += [pa.array(first + np.array(offsets, np.int64)[piece]), pa.array(count), pa.array(text, pa.binary())]
                yield pa.RecordBatch.from_arrays(made, names=["anchor", "hot", "doc_id", "row", "first", "windows", "bytes"])

    return rows.mapInArrow(run, "anchor long, hot boolean, doc_id long, row long, first long, windows long, bytes binary")


def _scan(runs_: DataFrame, width: int) -> DataFrame:
    """``doc_id, row, start, end``: bytes that stand earlier, from sorted buckets of runs."""
    names = ["doc_id", "row", "start", "end"]

    def marks(family: IndexFamily, fresh: list[tuple]) -> list[tuple]:
        """Take runs into the family; the stretches of each that stand earlier."""
        size = np.fromiter((r[4] for r in fresh), np.int64, len(fresh))
        start = np.cumsum(size + width - 1) - (size + width - 1)
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        earlier = family.add(b"".join(r[5] for r in fresh), np.repeat(start, size) + within)
        owner = np.repeat(np.arange(len(fresh)), size)
        at = np.flatnonzero(earlier)
        if not len(at):
            return []
        opens = np.append(True, (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]]))
        closes = np.append(opens[1:], True)
        out = []
        for a, b in zip(at[opens].tolist(), at[closes].tolist()):
            _, doc_id, row, first, _, _ = fresh[owner[a]]
            out.append((doc_id, row, first + int(within[a]), first + int(within[b]) + width))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, before = object(), None
        family, seen = IndexFamily(width), set()
        fresh: list[tuple] = []
        waiting = 0

        def packed(found: list[tuple]) -> Iterator[pa.RecordBatch]:
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=names)

        for batch in batches:
            found: list[tuple] = []
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if r[0] != bucket or waiting >= WINDOWS_PER_BATCH:
                    found += marks(family, fresh) if fresh else []
                    fresh, waiting = [], 0
                if r[0] != bucket:
                    bucket, before = r[0], None
                    family, seen = IndexFamily(width), set()
                if r[1:4] == before:  # an equal row of an equal document
                    continue
                before = r[1:4]
                _, doc_id, row, first, windows, text = r
                digest = None if text is None else hashlib.blake2b(text, digest_size=16).digest()
                if digest is None or digest in seen:
                    found.append((doc_id, row, first, first + windows + width - 1))
                    continue
                seen.add(digest)
                fresh.append(r)
                waiting += windows
            yield from packed(found)
        yield from packed(marks(family, fresh) if fresh else [])

    return runs_.mapInArrow(run, "doc_id long, row long, start long, end long")


def repeated(rows: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, row, start, end``: stretches of each row that stand earlier; they may overlap."""
    anchors = _anchors(rows, width, gram)
    often = anchors.withColumn("n", F.count("*").over(Window.partitionBy("anchor"))).where("n > 1")
    wanted = often.groupBy("row").agg(F.collect_set("anchor").alias("wanted"), F.collect_set(F.when(F.col("n") > HOT, F.col("anchor"))).alias("hot"))
    snippets = keep(_snippets(rows.join(wanted.hint("merge"), "row"), width, gram), "runs")
    # Equal runs of a hot anchor: only the first of each salted group keeps its bytes.
    order = ["doc_id", "row", "first"]
    salted = Window.partitionBy("anchor", F.pmod("row", F.lit(shuffle_width(rows.sparkSession))), "bytes").orderBy(*order)
    plain = ["anchor", *order, "windows"]
    hot = snippets.where("hot").withColumn("place", F.rank().over(salted))
    hot = hot.select(*plain, F.when(F.col("place") == 1, F.col("bytes")).alias("bytes"))
    every = snippets.where("not hot").select(*plain, "bytes").union(hot)
    buckets = 1 + snippets.count() // ROWS_PER_BUCKET
    every = every.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
    every = every.repartition("bucket").sortWithinPartitions("bucket", *order)
    return _scan(every.select("bucket", *order, "windows", "bytes"), width)


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one each."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def drop_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_bytes, spans, kept``: the removed spans of each text's bytes, and the other bytes.

    A byte goes if a window of ``width`` bytes over it also starts earlier: in a
    document of smaller id, or in the same one before.  Matches stay within
    documents.  Null texts are empty; a null id comes before all others;
    documents with one id go by a hash of their text, and of equal rows the
    first stays.  Texts shorter than a window lose nothing.  ``kept`` is binary,
    since a cut may fall inside of a letter.  Other columns are left out.
    """
    if not width >= gram > 0 or gram & (gram - 1):
        raise ValueError("gram must be a power of two within the width")
    rows = _rows(docs, id_col, text_col)
    found = repeated(rows, width, gram)
    spans = found.groupBy("row", F.col("doc_id").alias("of")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    by_row = Window.partitionBy("row").orderBy("doc_id")
    copy: Column = (F.row_number().over(by_row) > F.rank().over(by_row)).alias("copy")
    joined = rows.select("*", copy).join(spans.hint("merge"), "row", "left")
    joined = joined.select("doc_id", "bytes", "copy", F.when(F.col("of").eqNullSafe(F.col("doc_id")), F.col("spans")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, copies, lists = (batch[c].to_pylist() for c in ("doc_id", "bytes", "copy", "spans"))
            cut, kept = [], []
            for text, is_copy, spans in zip(texts, copies, lists):
                gone = [(0, len(text))] if is_copy and len(text) >= width else _union([(s["start"], s["end"]) for s in spans or ()])
                cut.append([{"start": a, "end": b} for a, b in gone])
                ends = [0, *(x for span in gone for x in span), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2])))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            arrays = [pa.array(ids, pa.int64()), pa.array(list(map(len, texts)), pa.int64()), pa.array(cut, kind), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
