"""Krippendorff's alpha, panels with the model, and the non-inferiority test."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.functions.labels import bind
from accordant.operators.patterns import rating_patterns
from accordant.schema import TRAIN, Ratings

LEVELS = ("nominal", "ordinal", "interval", "ratio")
HUMAN_PANEL = "human"


def human_and_model_panels(ratings: Ratings) -> dict[str, list[str]]:
    """All raters, and every set of all-but-one raters joined by the model."""
    if len(ratings.raters) < 3:
        raise ValueError("need at least 3 human raters")
    panels = {HUMAN_PANEL: list(ratings.raters)}
    for left_out in ratings.raters:
        rest = [r for r in ratings.raters if r != left_out]
        panels[f"model_for_{left_out}"] = [*rest, ratings.model]
    return panels


def _panel_structs(panels: Mapping[str, Sequence[str]]) -> Column:
    """Array of ``(panel, given)``: the ratings present on each panel."""
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("panel"),
                F.filter(F.array(*[F.col(c) for c in cols]), lambda x: x.isNotNull()).alias("given"),
            )
            for name, cols in panels.items()
        ]
    )


def coincidences(
    patterns: DataFrame, panels: Mapping[str, Sequence[str]], keys: Sequence[str]
) -> DataFrame:
    """``keys, panel, c, k, o``: how often values c and k meet within an item.

    An item with m ratings spreads each of its m(m-1) ordered pairs with weight
    1/(m-1).  Pairs are first counted as integers per m.  Items with one rating
    contribute a row without values so that items can be counted.
    """
    rated = patterns.select(*keys, "n", F.inline(_panel_structs(panels))).where(F.size("given") > 0)

    def pairs(given: Column) -> Column:
        return F.flatten(
            F.transform(
                given,
                lambda x, p: F.transform(
                    F.filter(given, lambda _, q: q != p),
                    lambda y: F.struct(x.alias("c"), y.alias("k")),
                ),
            )
        )

    counted = (
        rated.select(
            *keys,
            "panel",
            "n",
            F.size("given").alias("m"),
            F.inline_outer(pairs(F.col("given"))),
        )
        .groupBy(*keys, "panel", "m", "c", "k")
        .agg(F.sum("n").alias("n"))
    )
    # n counts every item of size m once per ordered pair; c, k null means m = 1.
    share = F.when(F.col("m") > 1, F.col("n").cast("double") / (F.col("m") - 1))
    return counted.groupBy(*keys, "panel", "c", "k").agg(
        F.sum(share).alias("o"),
        F.sum(F.when(F.col("m") > 1, F.col("n") / (F.col("m") * (F.col("m") - 1))).otherwise(F.col("n"))).alias("items"),
    )


def _sum(array: Column, value) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + value(x))


def _at(array: Column, place: Column) -> Column:
    return F.element_at(array, place.cast("int"))


def _square(x: Column) -> Column:
    return x * x


def _ratio_distance(a: Column, b: Column) -> Column:
    return F.when(a == b, 0.0).otherwise(_square((a - b) / (a + b)))


def _mid_ranks(margin: Column) -> Column:
    """Ranks of the values with ties sharing their middle.

    The ordinal distance of two values is the difference of their mid-ranks.
    """
    upto = F.sequence(F.lit(1), F.size(margin))
    return F.transform(
        upto, lambda i: _sum(F.slice(margin, F.lit(1), i), lambda x: x) - _at(margin, i) / 2.0
    )


def _disagreements(cells: Column, domain: Column, margin: Column, level: str) -> Column:
    """``(observed, expected)``: both sums of squared distances, on the scale of n."""
    total = _sum(margin, lambda x: x)
    if level == "nominal":
        return F.struct(
            _sum(cells, lambda x: F.when(x["c"] == x["k"], 0.0).otherwise(x["o"])).alias("observed"),
            (total * total - _sum(margin, lambda x: x * x)).alias("expected"),
        )
    values = F.transform(domain, lambda v: v.cast("double"))
    if level == "ratio":
        places = F.sequence(F.lit(1), F.size(domain))
        return F.struct(
            _sum(
                cells,
                lambda x: x["o"] * _ratio_distance(x["c"].cast("double"), x["k"].cast("double")),
            ).alias("observed"),
            _sum(
                places,
                lambda i: _at(margin, i)
                * _sum(
                    places,
                    lambda j: _at(margin, j) * _ratio_distance(_at(values, i), _at(values, j)),
                ),
            ).alias("expected"),
        )

    def spread(score: Column) -> Column:
        weighted = F.zip_with(margin, score, lambda m, s: F.struct(m.alias("m"), s.alias("s")))
        mean = _sum(weighted, lambda w: w["m"] * w["s"]) / total
        return bind(
            mean,
            lambda mu: F.struct(
                _sum(
                    cells,
                    lambda x: x["o"]
                    * _square(
                        _at(score, F.array_position(domain, x["c"]))
                        - _at(score, F.array_position(domain, x["k"]))
                    ),
                ).alias("observed"),
                (2.0 * total * _sum(weighted, lambda w: w["m"] * _square(w["s"] - mu))).alias(
                    "expected"
                ),
            ),
        )

    return bind(values if level == "interval" else _mid_ranks(margin), spread)


def alpha_from_cells(cells: Column, level: str) -> Column:
    """Alpha of one panel from its array of ``(c, k, o)`` coincidences."""
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}")
    values = F.array_sort(F.array_distinct(F.transform(cells, lambda x: x["c"])))

    def result(domain: Column) -> Column:
        margins = F.transform(
            domain, lambda v: _sum(cells, lambda x: F.when(x["c"] == v, x["o"]).otherwise(0.0))
        )

        def ratio(margin: Column) -> Column:
            scaled = _sum(margin, lambda x: x) - 1.0
            return bind(
                _disagreements(cells, domain, margin, level),
                lambda d: F.lit(1.0) - F.try_divide(scaled * d["observed"], d["expected"]),
            )

        return bind(margins, ratio)

    return F.when(F.size(values) > 1, bind(values, result))


def alphas_from_coincidences(table: DataFrame, keys: Sequence[str], level: str) -> DataFrame:
    """``keys, panel, alpha``; null with fewer than two items or one value."""
    cells = F.collect_list(F.when(F.col("c").isNotNull(), F.struct("c", "k", "o")))
    return (
        table.groupBy(*keys, "panel")
        .agg(cells.alias("cells"), F.sum("items").alias("items"))
        .withColumn(
            "alpha",
            F.when(F.round("items") >= 2, alpha_from_cells(F.col("cells"), level)),
        )
        .drop("cells", "items")
    )


def krippendorff_alpha(
    facts: DataFrame,
    columns: Sequence[str],
    level: str = "ordinal",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Alpha over the given rating columns per group; gaps are allowed."""
    patterns = rating_patterns(
        facts, Ratings(tuple(columns[:-1]), columns[-1]), keys, listwise=False
    )
    return alphas_from_coincidences(
        coincidences(patterns, {HUMAN_PANEL: columns}, keys), keys, level
    ).drop("panel")


def compare_panels(alphas: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``alpha_human``, mean ``alpha_model`` over panels, and their difference.

    A panel without an alpha leaves the mean undefined.
    """
    human = F.max(F.when(F.col("panel") == HUMAN_PANEL, F.col("alpha")))
    of_model = F.col("panel") != HUMAN_PANEL
    whole = F.count_if(of_model & F.col("alpha").isNull()) == 0
    model = F.when(whole, F.avg(F.when(of_model, F.col("alpha"))))
    return (
        alphas.groupBy(*keys)
        .agg(human.alias("alpha_human"), model.alias("alpha_model"))
        .withColumn("difference", F.col("alpha_model") - F.col("alpha_human"))
    )


RUN_KEYS = ("prompt_name", "iteration", "run")


def train_patterns(
    facts: DataFrame, ratings: Ratings, keys: Sequence[str] = RUN_KEYS
) -> DataFrame:
    """Rating patterns of the training rows; rows without any rating drop out."""
    return rating_patterns(_train_rows(facts, ratings), ratings, keys, listwise=False)


def panel_alphas(
    facts: DataFrame, ratings: Ratings, level: str = "ordinal", keys: Sequence[str] = RUN_KEYS
) -> DataFrame:
    """Alpha of the human panel and of each panel with the model, per run."""
    patterns = train_patterns(facts, ratings, keys)
    return alphas_from_coincidences(
        coincidences(patterns, human_and_model_panels(ratings), keys), keys, level
    )


# --- resampling -----------------------------------------------------------


_PRIME = 2147483647


def poisson_weight(key: Column, rep: Column) -> Column:
    """How often an item is drawn in a replicate: Poisson with mean 1.

    Repeatable arithmetic any engine has: a hash of item and replicate by squaring
    modulo a prime, compared with fixed cut points.
    """
    # Poisson(1) cumulative probabilities of 0..6, in millionths.
    steps = (367879, 735759, 919699, 981012, 996340, 999406, 999917)
    prime = F.lit(_PRIME)
    first = (F.pmod(key, prime) * 48271 + rep * F.lit(104729).cast("bigint") + 11) % prime
    second = (first * first + 12345) % prime
    place = ((second * second + first) % prime) % 1_000_000
    weight = F.when(place < steps[0], 0)
    for n, step in enumerate(steps[1:], start=1):
        weight = weight.when(place < step, n)
    return weight.otherwise(len(steps))


def hashed_resamples(items: DataFrame, key: str, n_replicates: int) -> DataFrame:
    """``rep, key, weight``: the draws of :func:`poisson_weight` as a table."""
    reps = F.sequence(F.lit(1), F.lit(n_replicates))
    return items.select(key, F.explode(reps).alias("rep")).withColumn(
        "weight", poisson_weight(F.col(key), F.col("rep"))
    )


def _train_rows(facts: DataFrame, ratings: Ratings) -> DataFrame:
    return facts.where(F.col("split") == TRAIN).na.drop("all", subset=ratings.columns)


def _replicate_patterns(
    weighted: DataFrame, ratings: Ratings, keys: Sequence[str]
) -> DataFrame:
    return (
        weighted.groupBy(*keys, "rep", *ratings.columns)
        .agg(F.sum("weight").cast("bigint").alias("n"))
        .where(F.col("n") > 0)
    )


def resampled_patterns(
    facts: DataFrame, resamples: DataFrame, key: str, ratings: Ratings, keys: Sequence[str] = RUN_KEYS
) -> DataFrame:
    """Rating patterns of every replicate of a supplied table ``key, rep, weight``."""
    rows = _train_rows(facts, ratings).select(*keys, key, *ratings.columns)
    return _replicate_patterns(rows.join(resamples, key), ratings, keys)


def fixed_bootstrap(
    patterns: DataFrame,
    ratings: Ratings,
    level: str = "ordinal",
    keys: Sequence[str] = RUN_KEYS,
) -> DataFrame:
    """``keys, rep, alpha_human, alpha_model, difference`` from resampled patterns."""
    rep_keys = [*keys, "rep"]
    table = coincidences(patterns, human_and_model_panels(ratings), rep_keys)
    return compare_panels(alphas_from_coincidences(table, rep_keys, level), rep_keys)


def intervals(
    replicates: DataFrame, keys: Sequence[str] = RUN_KEYS, confidence: float = 90.0
) -> DataFrame:
    """Percentile interval of the difference, with linear interpolation.

    A replicate without a difference leaves the interval undefined.
    """
    tail = (100.0 - confidence) / 200.0
    bounds = F.when(
        F.count("difference") == F.count(F.lit(1)),
        F.percentile("difference", F.array(F.lit(tail), F.lit(1.0 - tail))),
    )
    return (
        replicates.groupBy(*keys)
        .agg(bounds.alias("bounds"), F.count(F.lit(1)).alias("n_bootstrap"))
        .select(
            *keys,
            F.col("bounds")[0].alias("ci_lower"),
            F.col("bounds")[1].alias("ci_upper"),
            "n_bootstrap",
        )
    )


def non_inferiority(
    facts: DataFrame,
    ratings: Ratings,
    replicates: DataFrame,
    level: str = "ordinal",
    margin: float = -0.05,
    confidence: float = 90.0,
    keys: Sequence[str] = RUN_KEYS,
) -> DataFrame:
    """Per run: alphas, difference, interval and whether the model is non-inferior."""
    observed = compare_panels(panel_alphas(facts, ratings, level, keys), keys)
    return (
        observed.join(intervals(replicates, keys, confidence), list(keys))
        .withColumn("margin", F.lit(margin))
        .withColumn("non_inferior", F.coalesce(F.col("ci_lower") > F.lit(margin), F.lit(False)))
    )


def across_runs(per_run: DataFrame, keys: Sequence[str] = ("prompt_name", "iteration")) -> DataFrame:
    """Means and population deviations over runs, and the count of passing runs."""
    passed = F.count_if("non_inferior")
    columns: list[Column] = [F.count(F.lit(1)).alias("n_runs")]
    for name in ("alpha_human", "alpha_model", "difference"):
        columns += [F.avg(name).alias(f"{name}_mean"), F.stddev_pop(name).alias(f"{name}_std")]
    columns += [
        F.avg("ci_lower").alias("ci_lower_mean"),
        F.avg("ci_upper").alias("ci_upper_mean"),
        passed.alias("n_non_inferior"),
        (passed / F.count(F.lit(1))).alias("non_inferiority_ratio"),
    ]
    return per_run.groupBy(*keys).agg(*columns)


def verdict(summary: DataFrame) -> DataFrame:
    """``all``, ``some`` or ``none`` of the runs, and whether the model is superior."""
    return summary.withColumn(
        "verdict",
        F.when(F.col("n_non_inferior") == F.col("n_runs"), "all")
        .when(F.col("n_non_inferior") > 0, "some")
        .otherwise("none"),
    ).withColumn("superior", F.col("ci_lower_mean") > 0)
