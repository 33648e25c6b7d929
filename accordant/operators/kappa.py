"""Cohen's kappa from confusion counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.functions.labels import bind
from accordant.operators.patterns import (
    GROUP,
    pair_counts,
    rating_patterns,
    scenario_keys,
    with_grains,
)
from accordant.operators.spread import match, running_sums
from accordant.schema import AGGREGATED, TRAIN, VAL, Ratings, require_columns
from accordant.session import settle

WEIGHTS = (None, "linear", "quadratic")


def _weight(i: Column, j: Column, weights: str | None) -> Column:
    if weights == "linear":
        return F.abs(i - j).cast("double")
    if weights == "quadratic":
        return ((i - j) * (i - j)).cast("double")
    return F.when(i == j, 0.0).otherwise(1.0)


def _total(array: Column, value) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + value(x))


def kappa_from_cells(cells: Column, domain: Column, weights: str | None) -> Column:
    """Kappa of one pair from its array of ``(a, b, n)`` cells.

    Weights use the position of a label in ``domain``; cells with a label outside
    it do not count.  Null when chance disagreement is zero.
    """
    if weights not in WEIGHTS:
        raise ValueError(f"weights must be one of {WEIGHTS}")
    placed = F.filter(
        F.transform(
            cells,
            lambda c: F.struct(
                F.array_position(domain, c["a"]).alias("i"),
                F.array_position(domain, c["b"]).alias("j"),
                c["n"].cast("double").alias("n"),
            ),
        ),
        lambda c: (c["i"] > 0) & (c["j"] > 0),
    )
    places = F.sequence(F.lit(1).cast("bigint"), F.size(domain).cast("bigint"))

    def margin(inside: Column, side: str) -> Column:
        return F.transform(
            places,
            lambda p: _total(inside, lambda c: F.when(c[side] == p, c["n"]).otherwise(0.0)),
        )

    def chance(rows: Column, cols: Column) -> Column:
        return _total(
            places,
            lambda p: F.element_at(rows, p.cast("int"))
            * _total(places, lambda q: F.element_at(cols, q.cast("int")) * _weight(p, q, weights)),
        )

    def result(inside: Column) -> Column:
        observed = _total(inside, lambda c: c["n"] * _weight(c["i"], c["j"], weights))
        n = _total(inside, lambda c: c["n"])
        margins = F.struct(margin(inside, "i").alias("rows"), margin(inside, "j").alias("cols"))
        expected = bind(margins, lambda m: chance(m["rows"], m["cols"]))
        return F.lit(1.0) - F.try_divide(observed * n, expected)

    return bind(placed, result)


def open_kappas(counts: DataFrame, keys: Sequence[str], weights: str | None = None) -> DataFrame:
    """``keys, n_rows, n_equal, kappa`` from confusion counts ``keys, a, b, n`` without a label list.

    A label's position is its rank among those the pair of raters uses.  Chance
    agreement follows from margins: by label (unweighted), from sums of positions
    and of their squares (quadratic), or from both raters' cumulative margins,
    since two positions differ by the number of steps between them (linear).  No
    pair of labels is listed beyond those that occur.
    """
    if weights not in WEIGHTS:
        raise ValueError(f"weights must be one of {WEIGHTS}")
    keys, n = list(keys), F.col("n")
    none = F.lit(0).cast("bigint")
    sides = F.array(*[F.struct(F.col(x).alias("label"), r.alias("r"), c.alias("c")) for x, r, c in (("a", n, none), ("b", none, n))])
    margins = counts.select(*keys, F.inline(sides)).groupBy(*keys, "label").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    rows = F.sum("n").alias("n_rows")
    equal = F.sum(F.when(F.col("a") == F.col("b"), n).otherwise(0)).alias("n_equal")
    r, c = F.col("r").cast("double"), F.col("c").cast("double")
    if weights is None:
        seen = counts.groupBy(*keys).agg(rows, equal, F.sum(F.when(F.col("a") != F.col("b"), n).otherwise(0)).cast("double").alias("observed"))
        chance = margins.groupBy(*keys).agg((F.sum(r) * F.sum(c) - F.sum(r * c)).alias("expected"))
    else:
        ranked = settle(running_sums(margins.withColumn("one", F.lit(1).cast("bigint")), keys, ["label"], ["r", "c", "one"]))
        place = ranked.select(*keys, "label", F.col("one_upto").alias("place"))
        placed = counts
        for side in ("a", "b"):
            placed = match(placed, place.select(*keys, F.col("label").alias(side), F.col("place").alias(f"{side}_place")), [*keys, side])
        gap = (F.col("a_place") - F.col("b_place")).cast("double")
        weight = F.abs(gap) if weights == "linear" else gap * gap
        seen = placed.groupBy(*keys).agg(rows, equal, F.sum(n * weight).alias("observed"))
        p = F.col("one_upto").cast("double")
        if weights == "quadratic":
            square = F.sum(r) * F.sum(c * p * p) + F.sum(c) * F.sum(r * p * p) - 2.0 * F.sum(r * p) * F.sum(c * p)
            chance = ranked.groupBy(*keys).agg(square.alias("expected"))
        else:
            # A step lies between two labels where one is at or below it and the other above.
            totals = ranked.groupBy(*keys).agg(F.sum("r").cast("double").alias("all"))
            low_r, low_c, whole = F.col("r_upto").cast("double"), F.col("c_upto").cast("double"), F.col("all")
            step = low_r * (whole - low_c) + low_c * (whole - low_r)
            chance = match(ranked, totals, keys).groupBy(*keys).agg(F.sum(step).alias("expected"))
    kappa = 1.0 - F.try_divide(F.col("observed") * F.col("n_rows"), F.col("expected"))
    return match(seen, chance, keys).select(*keys, "n_rows", "n_equal", kappa.alias("kappa"))


def kappas(
    counts: DataFrame,
    keys: Sequence[str],
    labels: Sequence[object] | None = None,
    weights: str | None = None,
) -> DataFrame:
    """``keys, pair, kind, n_rows, n_equal, kappa`` per compared pair.

    ``n_rows`` and ``n_equal`` ignore the label list.  Without a label list the
    labels seen in the pair, in order, are used, see :func:`open_kappas`.
    """
    if labels is None:
        return open_kappas(counts, [*keys, "pair", "kind"], weights)
    cells = F.collect_list(F.struct("a", "b", "n"))
    domain = F.array(*[F.lit(v) for v in labels])
    return (
        counts.groupBy(*keys, "pair", "kind")
        .agg(
            cells.alias("cells"),
            F.sum("n").alias("n_rows"),
            F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("n_equal"),
        )
        .withColumn("domain", domain.cast(_array_type(counts)))
        .withColumn("kappa", kappa_from_cells(F.col("cells"), F.col("domain"), weights))
        .drop("cells", "domain")
    )


def _array_type(counts: DataFrame) -> str:
    return f"array<{counts.schema['a'].dataType.simpleString()}>"


def pairwise_kappas(
    facts: DataFrame,
    ratings: Ratings,
    labels: Sequence[object] | None = None,
    weights: str | None = None,
    keys: Sequence[str] = ("prompt_name", "iteration", "run", "split"),
) -> DataFrame:
    """Kappa of the model with each rater and of each pair of raters."""
    patterns = rating_patterns(facts, ratings, keys, listwise=True)
    return kappas(pair_counts(patterns, ratings, keys), keys, labels, weights)


def mean_kappas(per_pair: DataFrame, keys: Sequence[str], *extra: Column) -> DataFrame:
    """Mean model-human and human-human kappa; null when there is no such pair."""
    return per_pair.groupBy(*keys).agg(
        F.avg(F.when(F.col("kind") == "model_human", F.col("kappa"))).alias("mean_kappa_llm_human"),
        F.avg(F.when(F.col("kind") == "human_human", F.col("kappa"))).alias(
            "mean_human_human_agreement"
        ),
        *extra,
    )


def kappa_summary(
    facts: DataFrame,
    ratings: Ratings,
    labels: Sequence[object],
    weights: str | None = None,
    show_runs: bool = False,
) -> DataFrame:
    """One row per scenario, and per run if asked, with train and val columns."""
    require_columns(facts, ["prompt_name", "iteration", "run", "split", *ratings.columns])
    patterns = rating_patterns(facts, ratings, scenario_keys(facts), listwise=True)
    grained = with_grains(patterns, show_runs)
    counts = pair_counts(grained, ratings, [*GROUP, "split"], ground_truth=True)
    per_pair = kappas(counts, [*GROUP, "split"], labels, weights)

    def pick(value: str, split: str, column: str, match: str, agg=F.max) -> Column:
        here = (F.col("split") == split) & (F.col(column) == match)
        return agg(F.when(here, F.col(value)))

    wide: list[Column] = []
    for split, tail in ((TRAIN, ""), (VAL, "_val")):
        gt = "gt_vs_model"
        n_rows = pick("n_rows", split, "pair", gt)
        wide += [
            F.coalesce(n_rows, F.lit(0)).cast("bigint").alias(f"N_{split}"),
            (pick("n_equal", split, "pair", gt) / n_rows).alias(f"accuracy_GT_{split}"),
            pick("kappa", split, "pair", gt).alias(f"kappa_GT_{split}"),
            pick("kappa", split, "kind", "model_human", F.avg).alias(f"mean_kappa_llm_human{tail}"),
            pick("kappa", split, "kind", "human_human", F.avg).alias(
                f"mean_human_human_agreement{tail}"
            ),
        ]
        wide += [
            pick("kappa", split, "pair", f"gt_vs_{r}").alias(f"{r}_kappa_GT{tail}")
            for r in ratings.raters
        ]
    summary = per_pair.groupBy(*GROUP).agg(*wide)
    return finish_summary(summary, grained)


def finish_summary(summary: DataFrame, grained: DataFrame) -> DataFrame:
    """Add ``n_runs`` of pooled rows, ``use_validation_set`` and, for run rows of an
    improved prompt, ``prompt_iteration``."""
    extra = [
        F.max(c).alias(c) for c in ("prompt_iteration",) if c in grained.columns
    ]
    runs = grained.groupBy(*GROUP).agg(F.count_distinct("run").alias("n_runs"), *extra)
    return (
        summary.join(runs, GROUP)
        .withColumn("n_runs", F.when(F.col("run_label") == AGGREGATED, F.col("n_runs")))
        .withColumn("use_validation_set", F.col("N_val") > 0)
        .withColumnRenamed("run_label", "run")
    )


def run_consistency(
    facts: DataFrame,
    ratings: Ratings,
    labels: Sequence[object],
    weights: str | None = None,
    split: str | None = None,
) -> DataFrame:
    """Mean and population deviation over runs of the per-run mean kappas."""
    chosen = facts if split is None else facts.where(F.col("split") == split)
    keys = ["prompt_name", "iteration", "run"]
    per_pair = pairwise_kappas(chosen, ratings, labels, weights, keys)
    per_run = mean_kappas(per_pair, keys, F.max("n_rows").alias("samples"))
    return per_run.groupBy("prompt_name", "iteration").agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.sum("samples").alias("samples"),
        F.avg("mean_kappa_llm_human").alias("mean_llm_human"),
        F.stddev_pop("mean_kappa_llm_human").alias("std_llm_human"),
        F.avg("mean_human_human_agreement").alias("mean_human_human"),
        F.stddev_pop("mean_human_human_agreement").alias("std_human_human"),
    )
