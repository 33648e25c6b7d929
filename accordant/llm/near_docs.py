"""Near-duplicate documents: banded MinHash, Bayesian verification, exact check.

Documents with the same shingles form one class and are compared once.  Bands of
a signature propose pairs; a pair's signatures are compared batch by batch and
given up as soon as the posterior chance of reaching the similarity falls below
the miss probability; what survives is settled on the full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.llm.clusters import cluster
from accordant.llm.common import keep, worker_cache

SIGNED = "doc_id long, n_shingles long, class binary, keys array<long>"
EVIDENCE = "doc_id long, n_shingles long, signature binary, shingles binary"
WORDS_KEPT = 400_000
SHINGLES_AT_ONCE = 4096
TEXTS_AT_ONCE = 256


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers so that any of their bits may be compared."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORDS_KEPT:
            self[word] = value
        return value


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's runs of words, A-Z lower-cased.

    A text with fewer words is one run; a text without words has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    known = worker_cache("word hashes", WordHashes)
    hashed = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(width, len(words))
    run = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        run = run * np.uint64(0x9E3779B97F4A7C15) + hashed[i : len(hashed) - size + 1 + i]
    return np.unique(_mix(run))


class MinHash:
    """Smallest hashes of a set under ``size`` fixed functions."""

    def __init__(self, size: int):
        seeds = _mix(np.arange(1, 2 * size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.flip, self.factor = seeds[:size, None], seeds[size:, None] | np.uint64(1)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self.flip), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(shingles), SHINGLES_AT_ONCE):
            hashed = shingles[at : at + SHINGLES_AT_ONCE] ^ self.flip
            hashed *= self.factor
            np.minimum(least, hashed.min(1), out=least)
        return (least >> np.uint64(32)).astype("<u4")


def least_matches(compared: int, similarity: float, miss: float) -> int:
    """Fewest equal values of ``compared`` that keep a pair.

    With a uniform prior the similarity after m of n matches is Beta(m+1, n-m+1);
    its chance to reach the threshold is that of at most m successes in n+1.
    """
    chance = 0.0
    for m in range(compared + 1):
        chance += math.comb(compared + 1, m) * similarity**m * (1 - similarity) ** (compared + 1 - m)
        if chance >= miss:
            return m
    return compared


def likely_similar(left: Column, right: Column, size: int, similarity: float, miss: float, batch: int) -> Column:
    """Whether two signatures outlive the comparison of all their batches."""
    steps = [(n, least_matches(n, similarity, miss)) for n in range(batch, size + 1, batch)]

    @F.arrow_udf("boolean")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        x, y = (np.frombuffer(b"".join(c.to_pylist()), "<u4").reshape(-1, size) for c in (a, b))
        alive, matches = np.arange(len(x)), np.zeros(len(x), np.int64)
        for upto, least in steps:
            part = slice(upto - batch, upto)
            matches[alive] += (x[alive, part] == y[alive, part]).sum(1)
            alive = alive[matches[alive] >= least]
        return pa.array(np.isin(np.arange(len(x)), alive))

    return run(left, right)


def truly_similar(left: Column, right: Column, percent: int) -> Column:
    """Whether 100 * intersection >= percent * union holds for two full sets."""

    @F.arrow_udf("boolean")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for p, q in zip(a, b):
            x, y = (np.frombuffer(s.as_buffer(), "<u8") for s in (p, q))
            common = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * common >= percent * (len(x) + len(y) - common))
        return pa.array(out, pa.bool_())

    return run(left, right)


def signed(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """Set size, class key and bucket keys of each document; both null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = worker_cache(("minhash", bands * rows), lambda: MinHash(bands * rows))
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                sets = [shingle_set(t, width) for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part["doc_id"],
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([bucket_keys(sign(s), bands) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "class", "keys"],
                )

    return docs.mapInArrow(run, SIGNED)


def bucket_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band, for one signature or for each row of a matrix."""
    out = np.broadcast_to(np.arange(bands, dtype=np.uint64), (*signature.shape[:-1], bands))
    for column in np.moveaxis(signature.reshape(*signature.shape[:-1], bands, -1), -1, 0):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64) + np.uint64(1))
    return out.view(np.int64)


def _evidence(docs: DataFrame, width: int, size: int) -> DataFrame:
    """Signature and full shingle set of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = worker_cache(("minhash", size), lambda: MinHash(size))
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                sets = [shingle_set(t, width) for t in part["text"].to_pylist()]
                columns = [[sign(s).tobytes() for s in sets], [s.astype("<u8").tobytes() for s in sets]]
                arrays = [part["doc_id"], pa.array([len(s) for s in sets], pa.int64()), *(pa.array(c, pa.binary()) for c in columns)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "signature", "shingles"])

    return docs.mapInArrow(run, EVIDENCE)


class Unit:
    """Members of one bucket, or of two parts of it, that are to be compared."""

    def __init__(self, reps: np.ndarray, roots: np.ndarray, signatures: np.ndarray, sets: list[np.ndarray]):
        self.reps, self.signatures, self.sets = reps, signatures, sets
        self.root = np.unique(roots, return_inverse=True)[1]
        self.size = np.array(list(map(len, sets)), np.int64)

    def links(self, left: np.ndarray, right: np.ndarray | None, key: int, bands: int, percent: int, steps: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Links that join components, pair by pair until none is left to join.

        A pair that shares several buckets is left to the first of them.
        """
        keys = bucket_keys(self.signatures, bands)
        out = []
        for place, i in enumerate(left.tolist()):
            others = left[place + 1 :] if right is None else right
            sizes = self.size[others]
            fits = np.minimum(sizes, self.size[i]) * 100 >= np.maximum(sizes, self.size[i]) * percent
            others = others[fits & (self.root[others] != self.root[i])]
            if not len(others):
                continue
            equal_keys = keys[others] == keys[i]
            others = others[keys[i][equal_keys.argmax(1)] == key]
            begin, matches = 0, np.zeros(len(others), np.int64)
            for upto, least in steps:
                matches += (self.signatures[others, begin:upto] == self.signatures[i, begin:upto]).sum(1)
                others, matches, begin = others[matches >= least], matches[matches >= least], upto
            for j in others.tolist():
                if self.root[j] != self.root[i]:
                    common = len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True))
                    if 100 * common >= percent * (self.size[i] + self.size[j] - common):
                        out.append((int(self.reps[i]), int(self.reps[j])))
                        self.root[self.root == self.root[j]] = self.root[i]
        return out


def compared(apart: DataFrame, evidence: DataFrame, bands: int, size: int, percent: int, steps: list[tuple[int, int]], chunk: int) -> DataFrame:
    """Links between components of a bucket, found inside tasks.

    Buckets beyond ``chunk`` members are split by hash, and every part meets
    every part, so a task holds two parts at most and returns no more links than
    they have members.
    """
    parts = F.ceil(F.col("n") / chunk).cast("int")
    placed = apart.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    units = placed.select("key", "rep", "root", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    units = units.select("key", "rep", "root", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part")
    seen = evidence.select(F.col("doc_id").alias("rep"), "signature", "shingles").dropDuplicates(["rep"])
    full = units.join(seen.hint("merge"), "rep")

    def run(unit: pa.Table) -> pa.Table:
        sets = [np.frombuffer(s, "<u8") for s in unit["shingles"].to_pylist()]
        signatures = np.frombuffer(b"".join(unit["signature"].to_pylist()), "<u4").reshape(-1, size)
        low, high, part = (unit[n].to_numpy() for n in ("low", "high", "part"))
        one = Unit(unit["rep"].to_numpy(), unit["root"].to_numpy(), signatures, sets)
        every = np.arange(len(sets))
        same = low[0] == high[0]
        left, right = (every, None) if same else (every[part == low], every[part == high])
        found = one.links(left, right, unit["key"][0].as_py(), bands, percent, steps)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return full.groupBy("key", "low", "high").applyInArrow(run, "a long, b long")


def near_docs(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 75,
    width: int = 5,
    bands: int = 32,
    rows: int = 5,
    batch: int = 32,
    miss: float = 1e-6,
    chunk: int = 256,
) -> DataFrame:
    """Each document's shingle count, component and whether it is kept.

    Documents are linked where the Jaccard similarity of their sets of
    ``width``-word shingles is at least ``percent`` hundredths.  The smallest id
    of a component is kept.  A pair at the threshold escapes all bands with
    probability (1 - s**rows)**bands, 0.0002 by default and 2e-6 at 0.8.

    Null, empty and wordless texts have no shingles and link with nothing.  Rows
    that repeat an id are one document where links are concerned.  A row with a
    null id stays, with a null component, and takes no part.  Extra columns are
    left out.

    Only documents that share a bucket are read again, once, for their
    signatures and sets.  Joins that grow with the documents are merge joins.
    """
    size = bands * rows
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    all_signed = keep(signed(plain, width, bands, rows), "signed")
    some = all_signed.where(F.col("class").isNotNull() & F.col("doc_id").isNotNull())
    reps = some.groupBy("class").agg(F.min("doc_id").alias("rep"))
    nodes = some.select("class", F.col("doc_id").alias("rep"), "keys").join(reps.hint("merge"), ["class", "rep"])
    keys = nodes.select("rep", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("key")
    members = keep(keys.join(shared.hint("merge"), "key").distinct(), "members")
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    evidence = keep(_evidence(plain.join(wanted.hint("merge"), "doc_id", "left_semi"), width, size), "evidence")

    def verified(pairs: DataFrame) -> DataFrame:
        def side(name: str, what: str) -> DataFrame:
            return evidence.select(F.col("doc_id").alias(name), F.col("n_shingles").alias(f"n{name}"), F.col(what).alias(f"x{name}")).hint("merge")

        near = pairs.join(side("a", "signature"), "a").join(side("b", "signature"), "b")
        near = near.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
        near = keep(near.where(likely_similar(F.col("xa"), F.col("xb"), size, percent / 100, miss, batch)).select("a", "b").distinct(), "likely")
        full = near.join(side("a", "shingles"), "a").join(side("b", "shingles"), "b")
        return full.where(truly_similar(F.col("xa"), F.col("xb"), percent)).select("a", "b").distinct()

    steps = [(n, least_matches(n, percent / 100, miss)) for n in range(batch, size + 1, batch)]
    roots = cluster(members, verified, rounds=0, compare=lambda apart: compared(apart, evidence, bands, size, percent, steps, chunk))
    roots = roots.withColumnRenamed("id", "rep")
    ends = reps.join(roots.hint("merge"), "rep", "left").select("class", F.coalesce("root", "rep").alias("root"))
    out = all_signed.select("doc_id", "n_shingles", "class").join(ends.hint("merge"), "class", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
