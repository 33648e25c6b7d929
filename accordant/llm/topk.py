"""Exact top-k by inner product with vector-approximation files.

Every block of vectors keeps, besides its exact numbers, a few bits per
dimension that say in which cell the number lies.  Scanning the cells bounds
every score from both sides; exact vectors are then read from the best bound on,
until no bound left can reach the k-th score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordant.llm.common import shuffle_width

FOUND = "query_id long, vec_id long, score long"
SCAN_ROWS = 8192
EXACT_AT_ONCE = 32
EXACT_DOUBLE = 2.0**53


def usable(vector: Column) -> Column:
    """Not null, and only finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


class CellFile:
    """Cells and exact numbers of one stretch of vectors."""

    def __init__(self, ids: np.ndarray, exact: np.ndarray, bits: int):
        self.ids, self.exact = ids, exact
        low, high = exact.min(0, initial=0), exact.max(0, initial=0)
        self.width = np.maximum((high - low) / (1 << bits), 1e-300)
        self.cells = np.minimum((exact - low) / self.width, (1 << bits) - 1).astype(np.uint8)
        self.middle = low + self.width / 2
        self.far = np.maximum(np.abs(low), np.abs(high)) + self.width

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Middle of each score's bounds, and how far they reach to either side."""
        middle = (queries * self.width) @ self.cells.T.astype(np.float64) + (queries @ self.middle)[:, None]
        reach = np.abs(queries) @ (self.width / 2)
        spread = np.abs(queries) @ self.far
        return middle, reach + 1e-9 * (reach + spread) + 1e-9  # and rounding

    def scores(self, query: np.ndarray, rows: np.ndarray) -> list[int]:
        chosen = self.exact[rows]
        if np.abs(chosen).max(initial=0) * np.abs(query).max(initial=0) * len(query) < EXACT_DOUBLE:
            return (chosen @ query).astype(np.int64).tolist()
        whole = [int(x) for x in query]
        return [sum(int(x) * y for x, y in zip(row, whole)) for row in chosen.tolist()]

    def search(self, query_ids: list[int], queries: np.ndarray, k: int, best: list[list[tuple[int, int]]]) -> None:
        """Improve each query's list of (-score, id) with what this stretch holds."""
        middle, reach = self.bounds(queries)
        for q, query_id in enumerate(query_ids):
            # However many rows carry the query's own id, none is a candidate or sets a bound.
            rows = np.flatnonzero(self.ids != query_id)
            upper = middle[q] + reach[q]
            found = best[q]
            if len(found) == k:
                rows = rows[upper[rows] >= -found[-1][0]]
            elif len(rows) > k:
                lower = middle[q][rows] - reach[q]
                rows = rows[upper[rows] >= np.partition(lower, len(lower) - k)[len(lower) - k]]
            rows = rows[np.argsort(-upper[rows], kind="stable")]
            for at in range(0, len(rows), EXACT_AT_ONCE):
                if len(found) == k and upper[rows[at]] < -found[-1][0]:
                    break
                part = rows[at : at + EXACT_AT_ONCE]
                found = sorted([*found, *((-s, i) for s, i in zip(self.scores(queries[q], part), self.ids[part].tolist()))])[:k]
            best[q] = found


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, bits: int = 4) -> DataFrame:
    """Each query's k highest scores: ``query_id, rank, vec_id, score``.

    A score is the inner product of ``floor(scale * x)``; ties go to the smaller
    id.  Candidates are dealt into about ``sqrt(rows) / 12`` blocks, and each
    block meets every query as it streams by, so that neither a block nor the
    queries need to fit with the other.  Every block gives its own k best; a
    window over those, k rows per block and query, gives the result.

    Vectors that are null, or hold null or non-finite numbers, take no part, nor
    do rows with a null id; vectors meet only those of their own length.  Rows
    with the query's id are its own.  A repeated query row counts once; repeated
    candidates are listed each.  Scores beyond 64 bits are an error.
    """
    spark = vectors.sparkSession
    clean = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    clean = clean.where(usable(F.col("vector")) & F.col("vec_id").isNotNull()).withColumn("dim", F.size("vector"))
    blocks = max(1, math.ceil(math.sqrt(clean.count()) / 12))
    stored = clean.select("dim", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asks"), "vec_id", "vector")
    asked = clean.where("asks").dropDuplicates(["vec_id"])
    asked = asked.select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), "vec_id", "vector")
    dealt = stored.unionByName(asked).repartition(max(blocks, shuffle_width(spark)), "dim", "block").sortWithinPartitions("dim", "block", "asks")

    def numbers(batch: pa.RecordBatch, rows: np.ndarray, dim: int) -> np.ndarray:
        picked = batch["vector"].take(pa.array(rows))
        return np.floor(scale * picked.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, parts, files = None, [], [], None
        for batch in batches:
            dims, blocks_, asks, vec_ids = (batch[n].to_numpy(zero_copy_only=False) for n in ("dim", "block", "asks", "vec_id"))
            change = np.flatnonzero((np.diff(dims) != 0) | (np.diff(blocks_) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for rows in np.split(np.arange(batch.num_rows), change):
                if not len(rows):
                    continue
                key = (int(dims[rows[0]]), int(blocks_[rows[0]]))
                if key != current:
                    current, ids, parts, files = key, [], [], None
                for at in range(0, len(rows), SCAN_ROWS if not asks[rows[0]] else 256):
                    part = rows[at : at + (SCAN_ROWS if not asks[rows[0]] else 256)]
                    exact = numbers(batch, part, key[0])
                    if not asks[rows[0]]:
                        ids.append(vec_ids[part])
                        parts.append(exact)
                        continue
                    if files is None:
                        files = [CellFile(i, p, bits) for i, p in zip(ids, parts)]
                    query_ids = vec_ids[part].tolist()
                    best: list[list[tuple[int, int]]] = [[] for _ in query_ids]
                    for file in files:
                        file.search(query_ids, exact, k, best)
                    flat = [(q, i, -s) for q, found in zip(query_ids, best) for s, i in found]
                    if flat:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*flat)], names=["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(run, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
