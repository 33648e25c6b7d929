"""Bootstrap replicates of panel alphas.

A replicate is a weight per row, or per set of identical rating rows.  Weights of
all replicates of a batch meet the rows as one matrix product, and only sums per
replicate leave a task: coincidences of the values that occur (nominal, ordinal,
ratio), or five moments (interval, for any number of values).

Random weights come from a tree.  The identical rows of a group are the leaves of
a binary tree over the bits of their hash, and each node splits its draws by one
binomial from a stream of its own.  A node's draws are the same wherever the tree
is cut into tasks, so one rule holds for groups of every size.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from accordant.operators.alpha import (
    RUN_KEYS,
    _train_rows,
    alphas_from_coincidences,
    compare_panels,
    human_and_model_panels,
    train_patterns,
)
from accordant.operators.spread import match
from accordant.schema import Ratings

#: Leaves a task takes on average, replicates it takes, and rows it weighs at once.
LEAVES_PER_BUCKET = 2048
REPLICATES_PER_TASK = 250
ROWS_AT_ONCE = 256
HASH_BITS = 63

Panels = Mapping[str, Sequence[int]]
#: Panel, pair of values or nulls, and an array of sums per replicate.
Sums = Iterator[tuple[str, float | None, float | None, np.ndarray]]


def _given(values: np.ndarray, columns: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    part = values[:, columns]
    there = ~np.isnan(part)
    return part, there, there.sum(axis=1)


def coincidence_sums(values: np.ndarray, weights: np.ndarray, panels: Panels) -> Sums:
    """Per panel and pair of values that occurs: weighted coincidences and, once, weighted items.

    ``values`` has a row per set of ratings and nan for gaps, ``weights`` a row per
    replicate.
    """
    for panel, columns in panels.items():
        part, there, m = _given(values, columns)
        yield panel, None, None, np.stack([np.zeros(len(weights)), weights @ (m > 0)], axis=1)
        domain, code = np.unique(part[there], return_inverse=True)
        codes = np.full(part.shape, -1)
        codes[there] = code
        rows, cells = [], []
        for x in range(len(columns)):
            for y in range(len(columns)):
                at = np.flatnonzero(there[:, x] & there[:, y]) if x != y else ()
                if len(at):
                    rows.append(at)
                    cells.append(codes[at, x] * len(domain) + codes[at, y])
        if not rows:
            continue
        row = np.concatenate(rows)
        cell, place = np.unique(np.concatenate(cells), return_inverse=True)
        share = np.zeros((len(values), len(cell)))
        np.add.at(share, (row, place), 1.0 / (m[row] - 1))
        total = weights @ share
        for i, (c, k) in enumerate(zip(domain[cell // len(domain)].tolist(), domain[cell % len(domain)].tolist())):
            yield panel, c, k, np.stack([total[:, i], np.zeros(len(weights))], axis=1)


def moment_sums(values: np.ndarray, weights: np.ndarray, panels: Panels) -> Sums:
    """Per panel: weighted items, ratings that can agree, squared gaps within items, sum and squares."""
    for panel, columns in panels.items():
        part, there, m = _given(values, columns)
        x = np.where(there, part, 0.0)
        shared = m > 1
        mean = x.sum(axis=1) / np.maximum(m, 1)
        gaps = 2.0 * m * (np.where(there, part - mean[:, None], 0.0) ** 2).sum(axis=1) / np.maximum(m - 1, 1)
        parts = [m > 0, np.where(shared, m, 0), np.where(shared, gaps, 0.0), np.where(shared, x.sum(axis=1), 0.0), np.where(shared, (x * x).sum(axis=1), 0.0)]
        yield panel, None, None, weights @ np.stack(parts, axis=1).astype(float)


def _summed(level: str) -> tuple[Callable[..., Sums], int]:
    return (moment_sums, 5) if level == "interval" else (coincidence_sums, 2)


def _shape(keys: Sequence[StructField]) -> StructType:
    sums = ArrayType(ArrayType(DoubleType()))
    rest = [("first", IntegerType()), ("panel", StringType()), ("c", DoubleType()), ("k", DoubleType()), ("sums", sums)]
    return StructType([*keys, *(StructField(n, t) for n, t in rest)])


def _rows(shape: StructType, found: list[tuple]) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(shape)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)


def _alphas(parts: DataFrame, keys: Sequence[str], level: str, width: int) -> DataFrame:
    """``keys, rep, alpha_human, alpha_model, difference`` from the sums of all tasks."""
    per_rep = parts.select(*keys, "first", "panel", "c", "k", F.posexplode("sums").alias("at", "s"))
    rep_keys = [*keys, "rep"]
    total = per_rep.withColumn("rep", (F.col("first") + F.col("at")).cast("int")).groupBy(*rep_keys, "panel", "c", "k")
    total = total.agg(*[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width)])
    if level == "interval":
        items, n, gaps, one, two = (F.col(f"s{i}") for i in range(5))
        expected = 2.0 * (n * two - one * one)
        # A value that is alone leaves nothing but rounding.
        alpha = F.when((F.round(items) >= 2) & (expected > 1e-9 * n * two), 1.0 - F.try_divide((n - 1.0) * gaps, expected))
        return compare_panels(total.select(*rep_keys, "panel", alpha.alias("alpha")), rep_keys)
    cells = total.where("c is null or s0 > 0").select(*rep_keys, "panel", "c", "k", F.col("s0").alias("o"), F.col("s1").alias("items"))
    return compare_panels(alphas_from_coincidences(cells, rep_keys, level), rep_keys)


def _seats(ratings: Ratings) -> dict[str, list[int]]:
    return {name: [ratings.columns.index(c) for c in cols] for name, cols in human_and_model_panels(ratings).items()}


def _matrix(batch: pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    """Rating columns as floating numbers, nan for null."""
    return np.column_stack([batch[c].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns])


# --- repeatable draws ------------------------------------------------------------------

_PRIME = 2147483647
# Poisson(1) cumulative probabilities of 0..6, in millionths.
POISSON_STEPS = (367879, 735759, 919699, 981012, 996340, 999406, 999917)


def poisson_weights(keys: np.ndarray, reps: np.ndarray) -> np.ndarray:
    """The draws of :func:`accordant.operators.alpha.poisson_weight`, a row per replicate."""
    first = (keys % _PRIME * 48271 + reps[:, None] * 104729 + 11) % _PRIME
    second = (first * first + 12345) % _PRIME
    return np.searchsorted(POISSON_STEPS, (second * second + first) % _PRIME % 1_000_000, side="right").astype(float)


def hashed_bootstrap(
    facts: DataFrame, key: str, n_replicates: int, ratings: Ratings, level: str = "ordinal", keys: Sequence[str] = RUN_KEYS
) -> DataFrame:
    """``keys, rep, alpha_human, alpha_model, difference`` for draws by hash of an item's key.

    Rows are read once.  Each batch weighs its rows for all replicates and adds up;
    no row is repeated per replicate.  Rows without a key are not drawn.
    """
    make, width = _summed(level)
    keys, columns, panels = list(keys), ratings.columns, _seats(ratings)
    rows = _train_rows(facts, ratings).where(F.col(key).isNotNull()).select(*keys, F.col(key).cast("long").alias("_key"), *columns)
    shape = _shape([facts.schema[k] for k in keys])
    reps = np.arange(1, n_replicates + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = pa.Table.from_batches([batch.select(keys)]).append_column("_at", pa.array(np.arange(batch.num_rows)))
            for group in groups.group_by(keys).aggregate([("_at", "list")]).to_pylist() if keys else [{"_at_list": list(range(batch.num_rows))}]:
                part = batch.take(pa.array(group["_at_list"]))
                values, key_ = _matrix(part, columns), part["_key"].to_numpy()
                # Identical rows share their sums, so they are weighed together.
                kinds, kind = np.unique(values, axis=0, return_inverse=True)
                for at in range(0, len(reps), REPLICATES_PER_TASK):
                    some = reps[at : at + REPLICATES_PER_TASK]
                    drawn = poisson_weights(key_, some)
                    weights = np.zeros((len(some), len(kinds)))
                    np.add.at(weights.T, kind.ravel(), drawn.T)
                    found = []
                    for low in range(0, len(kinds), ROWS_AT_ONCE):
                        for panel, c, k, sums in make(kinds[low : low + ROWS_AT_ONCE], weights[:, low : low + ROWS_AT_ONCE], panels):
                            found.append((*(group[g] for g in keys), int(some[0]), panel, c, k, sums.tolist()))
                    yield _rows(shape, found)

    return _alphas(rows.mapInArrow(run, shape), keys, level, width)


# --- random draws ----------------------------------------------------------------------


def split_draws(spots: np.ndarray, sizes: np.ndarray, draws: np.ndarray, level: int, seed: Sequence[int]) -> np.ndarray:
    """Deal a node's draws among the leaves below it: a row per replicate, a column per leaf.

    ``spots`` are the leaves' hashes in ascending order, all with the same first
    ``level`` bits; ``sizes`` are their rows and ``draws`` the node's draws.  Each
    node with leaves on both sides gives the left one a binomial share.
    """
    out = np.empty((len(draws), len(spots)))
    upto = np.append(0, np.cumsum(sizes))
    stack = [(0, len(spots), level, draws)]
    while stack:
        low, high, depth, drawn = stack.pop()
        if high - low == 1:
            out[:, low] = drawn
            continue
        if depth == HASH_BITS:  # leaves with one hash go one by one
            prefix, middle, depth = int(spots[low]), low + 1, HASH_BITS + high - low
            left = split_node(drawn, int(sizes[low]), int(upto[high] - upto[low]), depth, prefix, seed)
            out[:, low] = left
            stack.append((middle, high, HASH_BITS, drawn - left))
            continue
        shift = HASH_BITS - 1 - depth
        prefix = int(spots[low]) >> shift >> 1
        middle = low + int(np.searchsorted(spots[low:high], ((prefix << 1) + 1) << shift))
        if low < middle < high:
            left = split_node(drawn, int(upto[middle] - upto[low]), int(upto[high] - upto[low]), depth, prefix, seed)
            stack += [(low, middle, depth + 1, left), (middle, high, depth + 1, drawn - left)]
        else:
            stack.append((low, high, depth + 1, drawn))
    return out


def split_node(draws: np.ndarray, left: int, size: int, depth: int, prefix: int, seed: Sequence[int]) -> np.ndarray:
    """How many of a node's draws go left, from the node's own stream."""
    if left in (0, size):
        return draws * (left > 0)
    stream = np.random.default_rng([*seed, depth, prefix])
    return stream.binomial(draws.astype(np.int64), left / size).astype(float)


def _tree(patterns: DataFrame, keys: Sequence[str], ratings: Ratings) -> DataFrame:
    """One row per bucket of leaves: ``keys, bucket, depth, rows, size, path``.

    ``path`` has, for each node from the root down to the bucket, the rows below
    it and below its left side; ``size`` is the rows of the group.
    """
    sizes = patterns.groupBy(*keys).agg(F.count("*").alias("leaves"), F.sum("n").alias("size"))
    depth = F.greatest(F.lit(0), F.ceil(F.log2(F.col("leaves") / F.lit(float(LEAVES_PER_BUCKET))))).cast("int")
    sizes = sizes.select(*keys, "size", depth.alias("depth"))
    # Hashes pass over nulls, so where the gaps are is hashed as well.
    spot = F.shiftrightunsigned(F.xxhash64(*ratings.columns, *[F.col(c).isNull() for c in ratings.columns]), 1)
    placed = match(patterns.withColumn("spot", spot), sizes, keys).withColumn("bucket", F.expr(f"shiftright(spot, {HASH_BITS} - depth)"))
    row = F.struct("spot", *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(ratings.columns)], "n")
    buckets = placed.groupBy(*keys, "depth", "size", "bucket").agg(F.sort_array(F.collect_list(row)).alias("rows"), F.sum("n").alias("n"))
    light = buckets.select(*keys, "depth", "bucket", "n")
    # Every node above a bucket, by its level and the bits that lead to it.
    above = light.select(*keys, "bucket", "depth", "n", F.explode(F.sequence(F.lit(0), F.col("depth"))).alias("level"))
    above = above.withColumn("node", F.expr("shiftright(bucket, depth - level)"))
    totals = above.groupBy(*keys, "level", "node").agg(F.sum("n").alias("total"))
    steps = match(above.where("level < depth").drop("n"), totals, [*keys, "level", "node"])
    lefts = totals.select(*keys, (F.col("level") - 1).alias("level"), F.shiftright("node", 1).alias("node"), F.col("total").alias("left")).where(totals["node"] % 2 == 0)
    steps = match(steps, lefts, [*keys, "level", "node"], "left")
    path = F.sort_array(F.collect_list(F.struct("level", "total", F.coalesce("left", F.lit(0)).alias("left"))))
    paths = steps.groupBy(*keys, "bucket").agg(path.alias("path"))
    return match(buckets, paths, [*keys, "bucket"], "left").select(*keys, "bucket", "depth", "size", "rows", "path")


def bootstrap(
    facts: DataFrame,
    ratings: Ratings,
    level: str = "ordinal",
    n_bootstrap: int = 2000,
    seed: int = 42,
    keys: Sequence[str] = RUN_KEYS,
) -> DataFrame:
    """``keys, rep, alpha_human, alpha_model, difference`` for random resamples.

    Resampling N rows with replacement is a multinomial draw over the sets of
    identical rows, here by binomial splits down a tree.  Draws depend on seed,
    group and replicate only, not on the partitioning.  The interval level holds
    for any number of values; for the others the coincidences of one replicate of
    one panel, which are as many as pairs of values that occur, meet in one row.
    """
    if not keys:
        raise ValueError("bootstrap needs at least one grouping column")
    make, width = _summed(level)
    keys, columns, panels = list(keys), ratings.columns, _seats(ratings)
    tree = _tree(train_patterns(facts, ratings, keys), keys, ratings)
    # Each bucket and range of replicates is one unit of work.  Their number of tasks
    # is given, since these rows are few and would otherwise be merged into one.
    starts = F.sequence(F.lit(1), F.lit(n_bootstrap), F.lit(REPLICATES_PER_TASK))
    tasks = 4 * facts.sparkSession.sparkContext.defaultParallelism
    work = tree.withColumn("first", F.explode(starts)).repartition(tasks, *keys, "bucket", "first")
    shape = _shape([facts.schema[k] for k in keys])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                group = [row[k] for k in keys]
                first = row["first"]
                streams = [seed, zlib.crc32(repr(group).encode()), first]
                drawn = np.full(min(REPLICATES_PER_TASK, n_bootstrap + 1 - first), float(row["size"]))
                for step in row["path"] or ():
                    above = row["depth"] - step["level"]
                    left = split_node(drawn, step["left"], step["total"], step["level"], row["bucket"] >> above, streams)
                    drawn = drawn - left if row["bucket"] >> (above - 1) & 1 else left
                leaves = row["rows"]
                spots = np.array([r["spot"] for r in leaves], np.int64)
                sizes = np.array([r["n"] for r in leaves], np.int64)
                values = np.array([[np.nan if r[f"v{i}"] is None else r[f"v{i}"] for i in range(len(columns))] for r in leaves], float)
                weights = split_draws(spots, sizes, drawn, row["depth"], streams)
                for low in range(0, len(values), ROWS_AT_ONCE):
                    part = slice(low, low + ROWS_AT_ONCE)
                    yield _rows(shape, [(*group, first, panel, c, k, sums.tolist()) for panel, c, k, sums in make(values[part], weights[:, part], panels)])

    return _alphas(work.mapInArrow(run, shape), keys, level, width)
