"""Token files: independent zstandard frames, a document index and a seek table.

Layout of a file::

    frame of document 0 | frame of document 1 | ...   zstandard, one per document
    index                                             a skippable frame
    seek table                                        a skippable frame, last

The index holds one 9-byte record per document: its id (signed, 8 bytes) and
whether it has one (1 byte).  The seek table is the public seekable-format
table: per frame its compressed size, its plain size and the low half of the
xxh64 of its plain bytes, then a 9-byte footer.  Any zstandard reader can expand
a whole file; a reader of some documents fetches the footer, the table, the
index and those documents' frames only.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accordant.llm import bpe
from accordant.llm.common import shuffle_width

# Fixed values of the public seekable format.
SEEK_FRAME, INDEX_FRAME, SEEKABLE = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1
CHECKSUMS = 0x80
FOOTER, FOOTER_BYTES = "<IBI", 9
SKIPPABLE, SKIPPABLE_BYTES = "<II", 8
ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("sum", "<u4")])
INDEX = np.dtype([("id", "<i8"), ("known", "u1")])

WRITTEN = "file string, first_id long, last_id long, n_docs long, n_tokens long, n_bytes long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"
READ_IDS = "doc_id long, start long, ids binary"
DOCS_AT_ONCE = 256
DOCS_ENCODED = 1024


class Damaged(ValueError):
    """A frame does not hold what its checksum says."""


class Frame(NamedTuple):
    doc_id: int | None
    offset: int
    packed: int
    plain: int
    checksum: int


def _checksum(plain: bytes) -> int:
    return xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF


def write_file(out, documents: Iterable[tuple[int | None, bytes]], level: int = 1) -> dict[str, int | None]:
    """Write (id, bytes) pairs in their order; returns what a manifest needs."""
    packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
    entries, index, size = [], [], 0
    for doc_id, plain in documents:
        frame = packer.compress(plain)
        out.write(frame)
        size += len(frame)
        entries.append((len(frame), len(plain), _checksum(plain)))
        index.append((doc_id or 0, doc_id is not None))
    body = np.array(index, INDEX).tobytes()
    table = np.array(entries, ENTRY).tobytes()
    tail = struct.pack(SKIPPABLE, INDEX_FRAME, len(body)) + body
    tail += struct.pack(SKIPPABLE, SEEK_FRAME, len(table) + FOOTER_BYTES) + table + struct.pack(FOOTER, len(entries), CHECKSUMS, SEEKABLE)
    out.write(tail)
    known = [i for i, has in index if has]
    return {
        "first_id": min(known, default=None),
        "last_id": max(known, default=None),
        "n_docs": len(entries),
        "n_tokens": sum(e[1] for e in entries) // 4,
        "n_bytes": size + len(tail),
    }


def read_frames(file, size: int) -> list[Frame]:
    """The frames of a file, from its last bytes alone."""
    file.seek(size - FOOTER_BYTES)
    count, flags, magic = struct.unpack(FOOTER, file.read(FOOTER_BYTES))
    if magic != SEEKABLE or flags != CHECKSUMS:
        raise Damaged("no seek table")
    table_at = size - FOOTER_BYTES - count * ENTRY.itemsize
    index_at = table_at - SKIPPABLE_BYTES - count * INDEX.itemsize
    file.seek(index_at)
    index = np.frombuffer(file.read(count * INDEX.itemsize), INDEX)
    file.seek(table_at)
    table = np.frombuffer(file.read(count * ENTRY.itemsize), ENTRY)
    offset = np.cumsum(table["packed"], dtype=np.int64) - table["packed"]
    return [
        Frame(i if has else None, at, packed, plain, checksum)
        for i, has, at, (packed, plain, checksum) in zip(index["id"].tolist(), index["known"].tolist(), offset.tolist(), table.tolist())
    ]


def read_document(file, frame: Frame) -> bytes:
    """Expand one frame and hold it against its checksum."""
    file.seek(frame.offset)
    try:
        plain = zstandard.ZstdDecompressor().decompress(file.read(frame.packed), max_output_size=frame.plain)
    except zstandard.ZstdError as error:
        raise Damaged(str(error)) from error
    if len(plain) != frame.plain or _checksum(plain) != frame.checksum:
        raise Damaged(f"document {frame.doc_id}")
    return plain


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write(
    docs: DataFrame, folder: str, vocab: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, files: int | None = None, level: int = 1
) -> DataFrame:
    """Encode documents and write them in ascending id order; returns the manifest.

    Rows are dealt out by ranges of the id, so each file holds a range and files
    in order of their first id hold all documents in order.  Null ids come
    first; rows with equal ids are kept in the order of their texts.  Null and
    empty texts are documents of the end id alone.  Other columns are left out.

    A task writes under a name of its own attempt and then renames, so a repeated
    attempt replaces the file of a lost one.  ``folder`` is a URI that all
    executors reach.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = plain.repartitionByRange(files or shuffle_width(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    end = np.uint32(end_id).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        coder = bpe.vocabulary(vocab)

        def documents() -> Iterator[tuple[int | None, bytes]]:
            for batch in batches:
                for at in range(0, batch.num_rows, DOCS_ENCODED):
                    part = batch.slice(at, DOCS_ENCODED)
                    ids = coder.encode(part["text"])
                    yield from zip(part["doc_id"].to_pylist(), (i + end for i in ids))

        store, place = _open(folder)
        name = f"tokens-{context.partitionId():06d}.zst"
        own = f"{place}/.{name}.{context.taskAttemptId()}"
        with store.open_output_stream(own) as out:
            made = write_file(out, documents(), level)
        if not made["n_docs"]:
            store.delete_file(own)
            return
        store.move(own, f"{place}/{name}")
        row = {"file": f"{folder}/{name}"} | made
        yield pa.RecordBatch.from_pylist([row], schema=_arrow(WRITTEN))

    store, place = _open(folder)
    store.create_dir(place, recursive=True)
    return dealt.mapInArrow(run, WRITTEN)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


def read(manifest: DataFrame, *, wanted: DataFrame | None = None, ids: bool = False) -> DataFrame:
    """One row per document of the files: its id, place in the whole and ids or their digest.

    ``start`` counts the ids of all documents before it.  Only the manifest, one
    row per file, is summed in one place.  With ``wanted`` (a column ``doc_id``)
    only the frames of those documents are expanded; each file is sent the
    wanted ids in its range.
    """
    before = Window.orderBy(F.col("first_id").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("file", "n_bytes", "first_id", "last_id", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    if wanted is None:
        jobs = placed.select("file", "n_bytes", "base", F.lit(None).cast("bigint").alias("doc_id"))
    else:
        near = wanted.select("doc_id").distinct().join(F.broadcast(placed), F.col("doc_id").between(F.col("first_id"), F.col("last_id")))
        jobs = near.select("file", "n_bytes", "base", "doc_id")
    jobs = jobs.repartition(shuffle_width(manifest.sparkSession), "file").sortWithinPartitions("file")
    some, schema = wanted is not None, READ_IDS if ids else READ

    def one_file(uri: str, size: int, base: int, chosen: set[int]) -> Iterator[pa.RecordBatch]:
        store, place = _open(uri)
        rows = []
        with store.open_input_file(place) as file:
            start = base
            for frame in read_frames(file, size):
                if not some or frame.doc_id in chosen:
                    plain = read_document(file, frame)
                    last = plain if ids else len(plain) // 4
                    rows.append((frame.doc_id, start, last) if ids else (frame.doc_id, start, last, zlib.crc32(plain)))
                start += frame.plain // 4
                if len(rows) == DOCS_AT_ONCE:
                    yield _rows(rows, schema)
                    rows = []
        if rows:
            yield _rows(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, chosen = None, set()
        for batch in batches:
            for row in batch.to_pylist():
                job = (row["file"], row["n_bytes"], row["base"])
                if job != current:
                    if current:
                        yield from one_file(*current, chosen)
                    current, chosen = job, set()
                chosen.add(row["doc_id"])
        if current:
            yield from one_file(*current, chosen)

    return jobs.mapInArrow(run, schema)


def _rows(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    schema = _arrow(ddl)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
