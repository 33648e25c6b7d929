"""Classification metrics of the model against the majority of the raters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.operators.kappa import finish_summary
from accordant.operators.patterns import (
    GROUP,
    GT,
    rating_patterns,
    scenario_keys,
    with_grains,
    with_ground_truth,
)
from accordant.schema import TRAIN, VAL, Ratings, require_columns

CLASS_METRICS = ("recall", "error_rate", "correct_count", "missed_count", "false_positives")
GLOBAL_METRICS = ("accuracy", "recall", "error_rate")


def human_accuracy(facts: DataFrame, ratings: Ratings, keys: Sequence[str] = ()) -> DataFrame:
    """Share of each rater's labels that equal the majority; gaps do not count."""
    patterns = with_ground_truth(rating_patterns(facts, ratings, keys, listwise=False), ratings)
    return rater_accuracy(patterns, ratings, keys)


def rater_accuracy(patterns: DataFrame, ratings: Ratings, keys: Sequence[str]) -> DataFrame:
    """``keys, rater, n_rated, accuracy`` from patterns that carry ``gt``."""
    entries = F.array(
        *[F.struct(F.lit(r).alias("rater"), F.col(r).alias("label")) for r in ratings.raters]
    )
    given = F.col("label").isNotNull() & (F.col("label").cast("string") != "")
    n_rated = F.sum(F.when(given, F.col("n")).otherwise(0))
    n_equal = F.sum(F.when(given & (F.col("label") == F.col(GT)), F.col("n")).otherwise(0))
    return (
        patterns.select(*keys, GT, "n", F.inline(entries))
        .groupBy(*keys, "rater")
        .agg(n_rated.alias("n_rated"), F.try_divide(n_equal, n_rated).alias("accuracy"))
    )


def truth_counts(facts: DataFrame, ratings: Ratings, keys: Sequence[str]) -> DataFrame:
    """``keys, actual, predicted, n`` over complete rows."""
    patterns = rating_patterns(facts, ratings, keys, listwise=True)
    return _truth_counts(patterns, ratings, keys)


def _truth_counts(patterns: DataFrame, ratings: Ratings, keys: Sequence[str]) -> DataFrame:
    return (
        with_ground_truth(patterns, ratings)
        .groupBy(*keys, F.col(GT).alias("actual"), F.col(ratings.model).alias("predicted"))
        .agg(F.sum("n").alias("n"))
    )


def _per_label(counts: DataFrame, keys: Sequence[str], labels: Sequence[object]) -> DataFrame:
    """``keys, label`` with support and hit counts, labels without rows included."""
    known = [F.lit(v).cast(counts.schema["actual"].dataType) for v in labels]
    n, actual, predicted = F.col("n"), F.col("actual"), F.col("predicted")
    both = actual.isin(*known) & predicted.isin(*known)

    def rows(condition: Column) -> Column:
        return F.sum(F.when(condition, n).otherwise(0))

    return (
        counts.select("*", F.explode(F.array(*known)).alias("label"))
        .groupBy(*keys, "label")
        .agg(
            rows(actual == F.col("label")).alias("support"),
            rows((actual == F.col("label")) & (predicted == F.col("label"))).alias("correct_count"),
            rows(both & (actual == F.col("label")) & (predicted != F.col("label"))).alias(
                "missed_count"
            ),
            rows(both & (actual != F.col("label")) & (predicted == F.col("label"))).alias(
                "false_positives"
            ),
            F.sum("n").alias("n_rows"),
            rows(actual == predicted).alias("n_equal"),
        )
    )


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def class_distribution(counts: DataFrame, keys: Sequence[str], labels: Sequence[object]) -> DataFrame:
    """Rows per majority label; a label nobody gave is listed with 0."""
    return _per_label(counts, keys, labels).select(
        *keys, "label", F.col("support").alias("n_rows")
    )


def per_class(counts: DataFrame, keys: Sequence[str], labels: Sequence[object]) -> DataFrame:
    """Recall, error rate, hits, misses, false alarms and false-alarm share per label."""
    tp, fn, fp = F.col("correct_count"), F.col("missed_count"), F.col("false_positives")
    recall = _share(tp, tp + fn)
    return _per_label(counts, keys, labels).select(
        *keys,
        "label",
        recall.alias("recall"),
        (F.lit(1.0) - recall).alias("error_rate"),
        "correct_count",
        "missed_count",
        "false_positives",
        _share(fp, tp + fp).alias("fp_rate"),
    )


def global_metrics(counts: DataFrame, keys: Sequence[str], labels: Sequence[object]) -> DataFrame:
    """Accuracy, macro recall over the label list and error rate."""
    accuracy = F.max("n_equal") / F.max("n_rows")
    return (
        _per_label(counts, keys, labels)
        .groupBy(*keys)
        .agg(
            F.max("n_rows").alias("n_rows"),
            accuracy.alias("accuracy"),
            F.avg(_share(F.col("correct_count"), F.col("support"))).alias("recall"),
            (F.lit(1.0) - accuracy).alias("error_rate"),
        )
    )


def accuracy(facts: DataFrame, ratings: Ratings, keys: Sequence[str]) -> DataFrame:
    """Share of rows where the model gives the majority label."""
    equal = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    return (
        truth_counts(facts, ratings, keys)
        .groupBy(*keys)
        .agg(F.sum("n").alias("n_rows"), (equal / F.sum("n")).alias("accuracy"))
    )


def classification_summary(
    facts: DataFrame,
    ratings: Ratings,
    labels: Sequence[object],
    show_runs: bool = False,
) -> DataFrame:
    """Wide table: ``global_<metric>_<split>`` and ``class_<label>_<metric>_<split>``."""
    require_columns(facts, ["prompt_name", "iteration", "run", "split", *ratings.columns])
    patterns = rating_patterns(facts, ratings, scenario_keys(facts), listwise=True)
    grained = with_grains(patterns, show_runs)
    counts = _truth_counts(grained, ratings, [*GROUP, "split"])
    table = _per_label(counts, [*GROUP, "split"], labels)

    tp, fn = F.col("correct_count"), F.col("missed_count")
    recall = _share(tp, tp + fn)
    values = {
        "recall": recall,
        "error_rate": F.lit(1.0) - recall,
        "correct_count": tp,
        "missed_count": fn,
        "false_positives": F.col("false_positives"),
    }
    wide: list[Column] = []
    for split in (TRAIN, VAL):
        here = F.col("split") == split
        n_rows = F.max(F.when(here, F.col("n_rows")))
        share = F.max(F.when(here, F.col("n_equal"))) / n_rows
        macro = F.avg(F.when(here, _share(tp, F.col("support"))))
        wide += [
            F.coalesce(n_rows, F.lit(0)).cast("bigint").alias(f"N_{split}"),
            share.alias(f"global_accuracy_{split}"),
            macro.alias(f"global_recall_{split}"),
            (F.lit(1.0) - share).alias(f"global_error_rate_{split}"),
        ]
        for label in labels:
            wide += [
                F.max(F.when(here & (F.col("label") == F.lit(label)), values[m])).alias(
                    f"class_{label}_{m}_{split}"
                )
                for m in CLASS_METRICS
            ]
    return finish_summary(table.groupBy(*GROUP).agg(*wide), grained)
