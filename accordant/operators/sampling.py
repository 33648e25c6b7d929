"""Exact-size seeded samples, splits and run grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordant.functions.labels import mix
from accordant.schema import TRAIN, VAL

_BLOCK_BITS = 16
EVERYTHING = ("all", "annotated", -1)


def _block_holding(counts: DataFrame, rank: int) -> tuple[int, int, int] | None:
    """From ``(block, n)`` rows: the block holding the rank-th row, the rank left
    inside it and its size.  There are at most 2**16 blocks, so one task may order
    them; one row comes back."""
    upto = F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, 0))
    hit = (
        counts.withColumn("upto", upto).where(F.col("upto") >= rank).orderBy("block").limit(1).first()
    )
    return None if hit is None else (hit["block"], rank - hit["upto"] + hit["n"], hit["n"])


def smallest_n(df: DataFrame, key: str, n: int, seed: int, use: str = "") -> Column:
    """Predicate true for exactly the n rows with the smallest ``(mix, key)``.

    The n-th value is located by two rounds of block counts over the key column
    instead of ranking rows, so no task ever sorts the table or holds n rows.  The
    cut is then a pair of constants: the predicate is a plain filter that later
    branches of a plan repeat at no cost.  Keys may be of any type, but must be unique,
    as row identities are; a row without one is never chosen.
    """
    mixed = mix(F.col(key), seed, use)
    keyed = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), mixed.alias("mixed"))
    high = F.shiftright(F.col("mixed"), _BLOCK_BITS)

    def sizes(rows: DataFrame, block: Column) -> DataFrame:
        return rows.groupBy(block.alias("block")).agg(F.count(F.lit(1)).alias("n"))

    coarse = _block_holding(sizes(keyed, high), n)
    if coarse is None:  # fewer than n rows with a key: all of them qualify
        return F.col(key).isNotNull()
    inside = keyed.where(high == coarse[0])
    value, left, size = _block_holding(sizes(inside, F.col("mixed")), coarse[1])
    if left == size:
        return mixed <= value
    # Keys that coincide in 32 bits: the few rows at the cut are told apart by key.
    at_cut = inside.where(F.col("mixed") == value).orderBy("key").limit(left)
    last = at_cut.agg(F.max("key")).first()[0]
    return (mixed < value) | ((mixed == value) & (F.col(key) <= last))


def exact_sample(df: DataFrame, key: str, size: int | str, seed: int = 42) -> DataFrame:
    """Seeded sample of exactly ``size`` rows, or the whole table for ``'all'``."""
    if size in EVERYTHING:
        return df
    if int(size) <= 0:
        raise ValueError("sample size must be positive")
    return df.where(smallest_n(df, key, int(size), seed, "sample"))


def train_val_split(df: DataFrame, key: str, validation_size: int, seed: int = 42) -> DataFrame:
    """Add ``split``: exactly ``validation_size`` rows are ``val``."""
    if validation_size <= 0:
        return df.withColumn("split", F.lit(TRAIN))
    chosen = smallest_n(df, key, validation_size, seed, "split")
    return df.withColumn("split", F.when(chosen, VAL).otherwise(TRAIN))


def replicate_runs(df: DataFrame, n_runs: int) -> DataFrame:
    """The same rows once per run, tagged 1..n; a narrow map, no join."""
    return df.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(n_runs))))


def scenario_grid(
    df: DataFrame, scenarios: Sequence[Mapping[str, object]], n_runs: int
) -> DataFrame:
    """Rows x scenarios x prompt iterations x runs.

    Scenario settings are driver-side constants, so the grid is one explode of a
    literal array.  ``prompt_iteration`` is null for scenarios run once.
    """
    cells = []
    for s in scenarios:
        last = int(s.get("max_iterations", 1))
        for it in range(1, last + 1):
            for run in range(1, n_runs + 1):
                cells.append(
                    F.struct(
                        F.lit(s["prompt_name"]).alias("prompt_name"),
                        F.lit(int(s.get("iteration", 1))).alias("iteration"),
                        F.lit(it if last > 1 else None).cast("int").alias("prompt_iteration"),
                        F.lit(run).alias("run"),
                        F.lit(bool(s.get("use_validation_set", True))).alias("use_validation_set"),
                        F.lit(it == last if last > 1 else None)
                        .cast("boolean")
                        .alias("is_best_iteration"),
                    )
                )
    return df.select("*", F.inline(F.array(*cells)))
