"""The alternative-annotator test: may the model replace a rater?"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordant.functions.labels import rated
from accordant.functions.student import one_sided_p
from accordant.operators.patterns import effective_iteration, rating_patterns, scenario_keys
from accordant.schema import TRAIN, VAL, Ratings, require_columns

METRICS = ("accuracy", "rmse")
MIN_RATINGS = 3
PASS_SHARE = 0.5
RUN_KEYS = ("prompt_name", "iteration", "run", "split")


def row_wins(df: DataFrame, ratings: Ratings, keep: Sequence[str], metric: str = "accuracy") -> DataFrame:
    """One row per input row and rater left out: ``keep, rater, w_f, w_h``.

    Model and left-out rater are each compared with the remaining raters of the
    row; the better one wins and a tie is a win for both.  Both scores share their
    denominator, so counts (accuracy) or sums of squares (rmse) are compared and
    ties are exact.  Rows with fewer than three ratings do not take part.  Under
    rmse a row without a model label cannot be scored and has null wins.
    """
    if len(ratings.raters) < MIN_RATINGS:
        raise ValueError("need at least 3 annotator columns")
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    require_columns(df, ratings.columns)
    guess = F.col(ratings.model)

    def total(others: Sequence[str], value) -> Column:
        """Sum over the other raters who rated; plain arithmetic, compiled by Spark."""
        given = [F.when(rated(F.col(s)), value(F.col(s))).otherwise(0) for s in others]
        return reduce(lambda a, b: a + b, given)

    def score(source: Column, others: Sequence[str]) -> Column:
        if metric == "accuracy":
            return total(others, lambda x: F.when(x == source, 1).otherwise(0))
        gap = lambda x: x.cast("double") - source.cast("double")
        return -total(others, lambda x: gap(x) * gap(x))

    def entry(r: str) -> Column:
        others = [s for s in ratings.raters if s != r]
        takes_part = rated(F.col(r)) & (total(others, lambda _: F.lit(1)) >= MIN_RATINGS - 1)
        return F.when(
            takes_part,
            F.struct(
                F.lit(r).alias("rater"),
                score(guess, others).alias("score_f"),
                score(F.col(r), others).alias("score_h"),
            ),
        )

    scored = df.select(*keep, F.explode(F.array(*[entry(r) for r in ratings.raters])).alias("_s"))
    score_f, score_h = F.col("_s.score_f"), F.col("_s.score_h")
    return scored.where(F.col("_s").isNotNull()).select(
        *keep,
        F.col("_s.rater").alias("rater"),
        (score_f >= score_h).cast("int").alias("w_f"),
        (score_h >= score_f).cast("int").alias("w_h"),
    )


def win_sums(
    patterns: DataFrame, ratings: Ratings, keys: Sequence[str], metric: str = "accuracy"
) -> DataFrame:
    """Integer sums per group and rater, from counts of identical rating rows."""
    wins = row_wins(patterns, ratings, [*keys, "n"], metric)
    scored = F.col("w_f").isNotNull()
    n, d = F.col("n"), F.col("w_h") - F.col("w_f")

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(F.when(scored, n * value)), F.lit(0))

    return wins.groupBy(*keys, "rater").agg(
        total(F.lit(1)).alias("n"),
        total(F.col("w_f")).alias("wins_f"),
        total(F.col("w_h")).alias("wins_h"),
        total(d).alias("sum_d"),
        total(d * d).alias("sum_d2"),
        F.coalesce(F.sum(F.when(~scored, n)), F.lit(0)).alias("skipped"),
    )


def rater_tests(
    facts: DataFrame,
    ratings: Ratings,
    keys: Sequence[str] = RUN_KEYS,
    epsilon: float = 0.2,
    metric: str = "accuracy",
) -> DataFrame:
    """``keys, rater, n, rho_f, rho_h, mean_d, t, p``.

    Every rater has a row in every group that has any row; a rater without scored
    rows has nulls.
    """
    patterns = rating_patterns(facts, ratings, keys, listwise=False)
    return _rater_tests(patterns, ratings, keys, epsilon, metric)


def _rater_tests(
    patterns: DataFrame, ratings: Ratings, keys: Sequence[str], epsilon: float, metric: str
) -> DataFrame:
    sums = win_sums(patterns, ratings, keys, metric)
    # The test is refused for groups without a single eligible row.
    grid = (
        sums.select(*keys)
        .distinct()
        .select(
            *keys,
            F.posexplode(F.array(*[F.lit(r) for r in ratings.raters])).alias("rater_no", "rater"),
        )
    )
    return tests_from_sums(grid.join(sums, [*keys, "rater"], "left"), keys, epsilon)


def tests_from_sums(sums: DataFrame, keys: Sequence[str], epsilon: float) -> DataFrame:
    """The tests of numbered raters from their win sums; null sums are no scored rows."""
    test = one_sided_p(F.col("n"), F.col("sum_d"), F.col("sum_d2"), epsilon)
    return sums.withColumn("n", F.coalesce("n", F.lit(0))).select(
        *keys,
        "rater_no",
        "rater",
        "n",
        F.try_divide("wins_f", "n").alias("rho_f"),
        F.try_divide("wins_h", "n").alias("rho_h"),
        test["mean"].alias("mean_d"),
        test["t"].alias("t"),
        test["p"].alias("p"),
    )


def by_correction(
    tests: DataFrame, keys: Sequence[str], alpha: float = 0.05, keep_missing: bool = True
) -> DataFrame:
    """Benjamini-Yekutieli: add ``rejected`` per row of a group.

    The first k hypotheses in order of p are rejected, k being the last rank whose
    p is at most ``k * alpha / (m * (1 + 1/2 + ... + 1/m))``.  A missing p counts in
    m and is never rejected; with ``keep_missing=False`` it does not count.
    """
    group = Window.partitionBy(*keys)
    ranked = group.orderBy(F.col("p").asc_nulls_last(), "rater_no")
    m = F.count(F.lit(1) if keep_missing else F.col("p")).over(group)
    harmonic = F.aggregate(
        F.sequence(F.lit(1), F.col("_m").cast("int")), F.lit(0.0), lambda acc, i: acc + F.lit(1.0) / i
    )
    within = F.col("p") <= F.col("_k") * F.lit(alpha) / (F.col("_m") * harmonic)
    last = F.max(F.when(within, F.col("_k"))).over(group)
    return (
        tests.withColumn("_k", F.row_number().over(ranked))
        .withColumn("_m", m)
        .withColumn("_last", last)
        .withColumn("rejected", F.coalesce(F.col("_k") <= F.col("_last"), F.lit(False)))
        .drop("_k", "_m", "_last")
    )


def _outcome(keep_missing: bool = True) -> list[Column]:
    """Winning rate, pass flag and p-values of a group of corrected tests."""
    wins = F.when(F.col("rejected"), 1.0).otherwise(0.0)
    rate = F.avg(wins if keep_missing else F.when(F.col("p").isNotNull(), wins))
    p_list = F.transform(
        F.array_sort(F.collect_list(F.struct("rater_no", "p"))), lambda x: x["p"]
    )
    return [
        rate.alias("winning_rate"),
        (rate >= PASS_SHARE).alias("passed"),
        p_list.alias("p_values"),
    ]


def alt_summary(
    facts: DataFrame,
    ratings: Ratings,
    keys: Sequence[str] = RUN_KEYS,
    epsilon: float = 0.2,
    alpha: float = 0.05,
    metric: str = "accuracy",
) -> DataFrame:
    """Per group: winning rate, whether the model passes, mean advantage, p-values."""
    tests = by_correction(rater_tests(facts, ratings, keys, epsilon, metric), keys, alpha)
    return summarise(tests, keys)


def summarise(tests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per group of corrected tests."""
    return tests.groupBy(*keys).agg(*_outcome(), F.avg("rho_f").alias("avg_adv_prob"))


def alt_across_runs(
    facts: DataFrame,
    ratings: Ratings,
    epsilon: float = 0.2,
    alpha: float = 0.05,
    per_run: bool = True,
) -> DataFrame:
    """Per-run rows and pooled rows, with ``_train`` and ``_val`` columns.

    Pooled rows average each rater's p over the runs and correct again over the
    raters that have one; with a single run they repeat its result.
    """
    require_columns(facts, ["prompt_name", "iteration", "run", "split", *ratings.columns])
    keys = ["prompt_name", "iteration", "run", "split"]
    patterns = rating_patterns(facts, ratings, scenario_keys(facts), listwise=False)
    patterns = patterns.withColumn("iteration", effective_iteration(patterns))
    step = (
        F.max("prompt_iteration")
        if "prompt_iteration" in patterns.columns
        else F.lit(None).cast("int")
    )
    sizes = patterns.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"), step.alias("prompt_iteration")
    )

    tests = by_correction(_rater_tests(patterns, ratings, keys, epsilon, "accuracy"), keys, alpha)
    run_rows = sizes.join(summarise(tests, keys), keys, "left")

    pooled_keys = ["prompt_name", "iteration", "split"]
    mean_p = tests.groupBy(*pooled_keys, "rater_no", "rater").agg(
        F.avg("p").alias("p"),
        F.count_distinct("run").alias("runs"),
        F.bool_or("rejected").alias("own"),
    )
    again = by_correction(mean_p, pooled_keys, alpha, keep_missing=False).withColumn(
        "rejected", F.when(F.col("runs") == 1, F.col("own")).otherwise(F.col("rejected"))
    )
    # One run keeps its own rate, in which missing p-values count.
    counted = F.when(F.col("p").isNotNull() | (F.col("runs") == 1), F.col("rejected").cast("double"))
    outcome = again.groupBy(*pooled_keys).agg(
        F.avg(counted).alias("winning_rate"),
        (F.avg(counted) >= PASS_SHARE).alias("passed"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("rater_no", "p"))), lambda x: x["p"]
        ).alias("p_values"),
    )
    pooled = (
        run_rows.groupBy(*pooled_keys)
        .agg(
            F.sum("n_rows").alias("n_rows"),
            F.count_distinct("run").alias("n_runs"),
            F.avg("avg_adv_prob").alias("avg_adv_prob"),
        )
        .join(outcome, pooled_keys, "left")
    )
    columns = ["prompt_name", "iteration", "run", "n_runs", "split", "n_rows"]
    columns += ["winning_rate", "passed", "avg_adv_prob", "p_values"]
    columns.append("prompt_iteration")
    grains = (
        pooled.withColumn("run", F.lit("aggregated"))
        .withColumn("prompt_iteration", F.lit(None).cast("int"))
        .select(*columns)
    )
    if per_run:
        grains = grains.unionByName(
            run_rows.withColumn("run", F.col("run").cast("string"))
            .withColumn("n_runs", F.lit(None).cast("bigint"))
            .select(*columns)
        )
    wide = _by_split(grains)
    keep_step = per_run and "prompt_iteration" in facts.columns
    return wide if keep_step else wide.drop("prompt_iteration")


def _by_split(grains: DataFrame) -> DataFrame:
    """Train and val of one scenario side by side."""
    wide: list[Column] = [
        F.max("n_runs").alias("n_runs"),
        F.max("prompt_iteration").alias("prompt_iteration"),
    ]
    for split in (TRAIN, VAL):
        here = F.col("split") == split

        def pick(name: str) -> Column:
            return F.max_by(F.when(here, F.col(name)), F.when(here, 1))

        wide += [
            F.coalesce(F.sum(F.when(here, F.col("n_rows"))), F.lit(0)).alias(f"N_{split}"),
            pick("winning_rate").alias(f"winning_rate_{split}"),
            pick("passed").alias(f"passed_alt_test_{split}"),
            pick("avg_adv_prob").alias(f"avg_adv_prob_{split}"),
            pick("p_values").alias(f"p_values_{split}"),
        ]
    return (
        grains.groupBy("prompt_name", "iteration", "run")
        .agg(*wide)
        .withColumn("use_validation_set", F.col("N_val") > 0)
    )


def rater_profile(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Valid labels per column, the kinds of value found, and whether kinds mix.

    Kinds of a text column: ``int``, ``float`` or ``str`` by spelling.
    """
    require_columns(df, names)

    def kind(name: str) -> Column:
        dtype = df.schema[name].dataType.typeName()
        col = F.col(name)
        if dtype in ("long", "integer", "short", "byte"):
            return F.lit("int")
        if dtype in ("double", "float") or dtype.startswith("decimal"):
            return F.lit("float")
        text = col.cast("string")
        return (
            F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), "int")
            .when(text.rlike(r"^\s*[+-]?(\d+\.\d*|\.\d+)\s*$"), "float")
            .otherwise("str")
        )

    entries = F.array(
        *[
            F.struct(
                F.lit(n).alias("rater"),
                rated(F.col(n)).alias("valid"),
                F.when(rated(F.col(n)), kind(n)).alias("kind"),
            )
            for n in names
        ]
    )
    per_rater = (
        df.select(F.inline(entries))
        .groupBy("rater")
        .agg(
            F.count_if("valid").alias("n_labels"),
            F.array_sort(F.collect_set("kind")).alias("kinds"),
        )
    )
    all_kinds = per_rater.agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("kinds")))) > 1
    ).scalar()
    return per_rater.withColumn("mixed_types", all_kinds)
