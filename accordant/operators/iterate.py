"""Comparing prompt iterations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordant.functions.labels import majority_vote, rated
from accordant.operators import alttest
from accordant.operators.classification import rater_accuracy
from accordant.operators.kappa import kappas
from accordant.operators.patterns import GT, rating_patterns, with_ground_truth
from accordant.schema import TRAIN, VAL, Ratings

# Wording of the effect of a prompt change.
IMPROVED = "Those changes improved the classification"
DECREASED = "Those changes decreased the classification"
UNCHANGED = "No change in classification performance"
NOT_APPLICABLE = "N/A"


def best_row(rows: DataFrame, keys: Sequence[str], order: str = "iteration") -> DataFrame:
    """Best row per group: by validation accuracy, else training accuracy, else
    the first.  The earliest row wins a tie."""
    lowest = F.lit(float("-inf"))
    # The training accuracy decides only among rows without a validation accuracy.
    fallback = F.when(F.col("accuracy_val").isNull(), F.coalesce("accuracy_train", lowest))
    rank = F.struct(
        F.coalesce("accuracy_val", lowest), F.coalesce(fallback, F.lit(0.0)), -F.col(order)
    )
    best = F.max_by(F.struct(*rows.columns), rank)
    return rows.groupBy(*keys).agg(best.alias("_best")).select("_best.*")


def best_prompt(rows: DataFrame, keys: Sequence[str], order: str = "iteration") -> DataFrame:
    """Prompt with the highest accuracy per scenario, the earliest on a tie."""
    accuracy = F.coalesce("accuracy_val", "accuracy_train")
    best = F.max_by(F.struct(order, accuracy.alias("best_accuracy")), F.struct(accuracy, -F.col(order)))
    return rows.groupBy(*keys).agg(best.alias("_best")).select(
        *keys, F.col("_best")[order].alias("best_iteration"), F.col("_best")["best_accuracy"].alias("best_accuracy")
    )


def effect_of_change(rows: DataFrame, keys: Sequence[str], order: str = "iteration") -> DataFrame:
    """Add ``effect_of_changes``: this iteration against the previous one."""
    now = F.col("accuracy_val")
    before = F.lag("accuracy_val").over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn(
        "effect_of_changes",
        F.when(now > before, IMPROVED)
        .when(now < before, DECREASED)
        .when(now == before, UNCHANGED)
        .otherwise(NOT_APPLICABLE),
    )


def pick_examples(
    rows: DataFrame,
    keys: Sequence[str],
    order: str,
    truth: str = GT,
    model: str = "model_pred",
    n_examples: int = 4,
    error_share: float = 0.5,
) -> DataFrame:
    """First mistakes and first correct rows per group, in the wanted mix.

    A filter on ``row_number`` is applied by Spark before the shuffle as well, so
    each task sends on at most k rows per group and class.
    """
    wanted_bad = int(round(n_examples * error_share))
    right = F.coalesce(F.col(model) == F.col(truth), F.lit(False))
    classed = rows.withColumn("is_mistake", ~right)
    most = max(wanted_bad, n_examples - wanted_bad)
    ranks = Window.partitionBy(*keys, "is_mistake").orderBy(order)
    wanted = F.when(F.col("is_mistake"), wanted_bad).otherwise(n_examples - wanted_bad)
    return (
        classed.withColumn("pick", F.row_number().over(ranks))
        .where(F.col("pick") <= most)
        .where(F.col("pick") <= wanted)
    )


def before_early_stop(
    facts: DataFrame,
    ratings: Ratings,
    keys: Sequence[str],
    order: str = "prompt_iteration",
) -> DataFrame:
    """``keys, order, n_mistakes`` of the iterations that run: the first one without
    a training mistake is the last."""
    counts = with_ground_truth(
        rating_patterns(facts.where(F.col("split") == TRAIN), ratings, [*keys, order], listwise=False),
        ratings,
    )
    wrong = ~F.coalesce(F.col(ratings.model) == F.col(GT), F.lit(False))
    per_iteration = counts.groupBy(*keys, order).agg(
        F.sum(F.when(wrong, F.col("n")).otherwise(0)).alias("n_mistakes")
    )
    clean = per_iteration.where(F.col("n_mistakes") == 0).groupBy(*keys).agg(
        F.min(order).alias("_stop")
    )
    return (
        per_iteration.join(clean, list(keys), "left")
        .where(F.col("_stop").isNull() | (F.col(order) <= F.col("_stop")))
        .drop("_stop")
    )


def iteration_rows(
    facts: DataFrame,
    ratings: Ratings,
    labels: Sequence[object],
    epsilon: float = 0.2,
    order: str = "prompt_iteration",
    usage: DataFrame | None = None,
) -> DataFrame:
    """One row per scenario and prompt iteration: accuracy, kappa, test and raters.

    All columns derive from one table of rating patterns.  Labels may be numbers or
    texts.  A missing prediction equals no label.
    """
    keys = ["prompt_name", order]
    split_keys = [*keys, "split"]
    patterns = rating_patterns(facts, ratings, split_keys, listwise=False)
    truth = with_ground_truth(patterns, ratings)

    # Rows nobody rated count for nothing.  They are not filtered: a filter would
    # sink below the patterns and the facts would be read a second time.
    judged = F.when(F.col(GT).isNotNull(), F.col("n"))
    cells = truth.groupBy(
        *split_keys,
        F.lit("gt_vs_model").alias("pair"),
        F.lit("gt_model").alias("kind"),
        F.col(GT).alias("a"),
        F.col(ratings.model).alias("b"),
    ).agg(F.sum(judged).alias("n"))
    agreement = kappas(cells, split_keys, labels).withColumn(
        "accuracy", F.col("n_equal") / F.col("n_rows")
    )
    tests = alttest.by_correction(
        alttest._rater_tests(patterns, ratings, split_keys, epsilon, "accuracy"), split_keys
    )
    outcome = alttest.summarise(tests, split_keys)
    people = rater_accuracy(truth, ratings, split_keys)

    def pick(name: str, split: str) -> Column:
        return F.max(F.when(F.col("split") == split, F.col(name)))

    left = agreement.join(outcome, split_keys, "left").groupBy(*keys).agg(
        *[
            pick(name, split).alias(f"{shown}_{split}")
            for split in (TRAIN, VAL)
            for name, shown in (
                ("kappa", "kappa"),
                ("accuracy", "accuracy"),
                ("winning_rate", "winning_rate"),
                ("passed", "passed_alt_test"),
                ("avg_adv_prob", "avg_adv_prob"),
            )
        ]
    )
    right = people.groupBy(*keys).agg(
        *[
            F.max(F.when((F.col("split") == s) & (F.col("rater") == r), F.col("accuracy"))).alias(
                f"{r}_{s}_acc"
            )
            for r in ratings.raters
            for s in (TRAIN, VAL)
        ]
    )
    out = left.join(right, keys)
    return out.join(usage, keys, "left") if usage is not None else out
