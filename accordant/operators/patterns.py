"""Counts of identical rating rows: the one aggregate every statistic starts from.

All agreement statistics depend on the rows only through how often each
combination of ratings occurs per scenario, run and split.  That table has at
most ``(labels + 1) ** (raters + 1)`` rows per group and is built with map-side
combination, so a frequent group or label adds no load to any single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.functions.labels import majority_vote
from accordant.schema import AGGREGATED, Ratings, require_columns

GROUP = ["prompt_name", "iteration", "run_label"]
GT = "gt"


def rating_patterns(
    facts: DataFrame, ratings: Ratings, keys: Sequence[str], listwise: bool
) -> DataFrame:
    """``keys, raters, model, n`` where n counts rows with these very ratings.

    ``listwise`` keeps complete rows only (kappa, classification); otherwise gaps
    stay (alpha, alternative-annotator test).
    """
    require_columns(facts, [*keys, *ratings.columns])
    rows = facts.na.drop("any", subset=ratings.columns) if listwise else facts
    counted = rows.groupBy(*keys, *ratings.columns).agg(F.count(F.lit(1)).alias("n"))
    # Always true, but it keeps n in every branch of a plan.  Branches then agree up
    # to the shuffle, which Spark runs once and reuses: facts are read one time.
    return counted.where(F.col("n") > 0)


def scenario_keys(facts: DataFrame) -> list[str]:
    keys = ["prompt_name", "iteration", "run", "split"]
    return keys + ["prompt_iteration"] if "prompt_iteration" in facts.columns else keys


def effective_iteration(df: DataFrame) -> Column:
    """The prompt iteration where there is one."""
    if "prompt_iteration" in df.columns:
        return F.coalesce(F.col("prompt_iteration"), F.col("iteration"))
    return F.col("iteration")


def with_grains(patterns: DataFrame, per_run: bool) -> DataFrame:
    """Add ``run_label``: every pattern counts for the pooled grain and, if asked,
    for its own run.  Counts are additive, so raw rows are not read again."""
    improved = per_run and "prompt_iteration" in patterns.columns
    step = F.col("prompt_iteration") if improved else F.lit(None)

    def grain(iteration: Column, run_label: Column, shown: Column) -> Column:
        fields = [iteration.alias("iteration"), run_label.alias("run_label")]
        if improved:
            fields.append(shown.cast("int").alias("prompt_iteration"))
        return F.struct(*fields)

    grains = [grain(F.col("iteration"), F.lit(AGGREGATED), F.lit(None))]
    if per_run:
        grains.append(
            grain(effective_iteration(patterns), F.col("run").cast("string"), step)
        )
    rest = [c for c in patterns.columns if c not in ("iteration", "prompt_iteration")]
    return patterns.select(*rest, F.inline(F.array(*grains)))


def with_ground_truth(patterns: DataFrame, ratings: Ratings) -> DataFrame:
    """Add ``gt``, the majority of the raters."""
    return patterns.withColumn(GT, majority_vote([F.col(r) for r in ratings.raters]))


def pair_structs(ratings: Ratings, ground_truth: bool) -> list[Column]:
    """One struct ``(pair, kind, a, b)`` per compared pair of columns."""

    def entry(name: str, kind: str, a: str, b: str) -> Column:
        return F.struct(
            F.lit(name).alias("pair"),
            F.lit(kind).alias("kind"),
            F.col(a).alias("a"),
            F.col(b).alias("b"),
        )

    names = ratings.raters
    pairs = [entry(f"model_vs_{r}", "model_human", ratings.model, r) for r in names]
    pairs += [
        entry(f"{r}_vs_{s}", "human_human", r, s)
        for i, r in enumerate(names)
        for s in names[i + 1 :]
    ]
    if ground_truth:
        pairs.append(entry(f"{GT}_vs_model", "gt_model", GT, ratings.model))
        pairs += [entry(f"{GT}_vs_{r}", "gt_human", GT, r) for r in names]
    return pairs


def pair_counts(
    patterns: DataFrame, ratings: Ratings, keys: Sequence[str], ground_truth: bool = False
) -> DataFrame:
    """``keys, pair, kind, a, b, n``: the confusion counts of every pair."""
    source = with_ground_truth(patterns, ratings) if ground_truth else patterns
    return (
        source.select(*keys, "n", F.inline(F.array(*pair_structs(ratings, ground_truth))))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull())
        .groupBy(*keys, "pair", "kind", "a", "b")
        .agg(F.sum("n").alias("n"))
    )
