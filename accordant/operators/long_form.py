"""Agreement over ratings in long form: one row per item, rater and value.

Any number of raters and of different values is allowed.  Counts per item and
value come first; every statistic is then a sum over those counts, over the
margins of values, or over tiles of pairs, and none collects a group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from accordant.operators import alttest
from accordant.operators.alpha import LEVELS
from accordant.operators.kappa import open_kappas
from accordant.operators.spread import blocks, match, running_sums, tiles
from accordant.session import settle

#: Values, or raters of an item, that meet in one tile.
VALUES_PER_BLOCK = 1024
RATERS_PER_BLOCK = 64


def to_long(facts: DataFrame, columns: Sequence[str], keys: Sequence[str], item: str) -> DataFrame:
    """``keys, item, rater, value`` from one column per rater; gaps leave no row."""
    cells = F.array(*[F.struct(F.lit(c).alias("rater"), F.col(c).alias("value")) for c in columns])
    return facts.select(*keys, F.col(item).alias("item"), F.inline(cells)).where("value is not null")


def on_panels(ratings: DataFrame, panels: Mapping[str, Sequence[str]]) -> DataFrame:
    """Each rating once for every panel its rater sits on, in a column ``panel``."""
    seats = [F.when(F.col("rater").isin(list(members)), F.lit(name)) for name, members in panels.items()]
    return ratings.withColumn("panel", F.explode(F.array_compact(F.array(*seats))))


def value_counts(ratings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, item, value, n, m``: how often an item got a value, and its ratings in all.

    Written down, since several sums read it; a frequent item or value is combined
    before anything is shuffled.
    """
    counts = ratings.where("value is not null").groupBy(*keys, "item", "value").agg(F.count("*").alias("n"))
    return settle(counts.withColumn("m", F.sum("n").over(Window.partitionBy(*keys, "item"))))


def _ratio(a, b):
    gap, size = a - b, a + b
    return np.divide(gap, size, out=np.zeros(gap.shape), where=gap != 0) ** 2


@F.pandas_udf(DoubleType())
def _ratio_tile(v: pd.Series, n: pd.Series, w: pd.Series, k: pd.Series) -> pd.Series:
    """Sum over all pairs of a tile of the counts' product times the squared ratio distance."""
    return pd.Series([float(a @ _ratio(x[:, None], y[None, :]) @ b) for x, a, y, b in zip(v, n, w, k)])


def _ratio_expected(margins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, expected``: pairs of all values, tile by tile.

    The work is the square of the number of different values; a tile of 1024 by
    1024 takes some hundredths of a second and sends one number on.
    """
    entry = F.struct(F.col("value").cast("double").alias("v"), F.col("n").cast("double").alias("n"))
    met = tiles(blocks(margins, keys, F.col("value"), entry, VALUES_PER_BLOCK), keys)
    part = _ratio_tile("left.v", "left.n", "right.v", "right.n")
    both = met.select(*keys, F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0).alias("times"), part.alias("part"))
    return both.groupBy(*keys).agg(F.sum(F.col("times") * F.col("part")).alias("expected"))


def _centred(margins: DataFrame, keys: Sequence[str], level: str) -> DataFrame:
    """``keys, value, n, s``: a score per value, measured from the mean score of all ratings.

    Interval scores are the values; ordinal ones are mid-ranks, whose differences
    are the ordinal distances.
    """
    if level == "ordinal":
        ranked = running_sums(margins, keys, ["value"], ["n"])
        scored = ranked.select(*keys, "value", "n", (F.col("n_upto") - F.col("n") / 2.0).alias("s"))
    else:
        scored = margins.select(*keys, "value", "n", F.col("value").cast("double").alias("s"))
    means = scored.groupBy(*keys).agg((F.sum(F.col("n") * F.col("s")) / F.sum("n")).alias("mean"))
    return match(scored, means, keys, "left").select(*keys, "value", "n", (F.col("s") - F.col("mean")).alias("s"))


def alpha_long(ratings: DataFrame, level: str = "ordinal", keys: Sequence[str] = ()) -> DataFrame:
    """``keys, n_items, n_values, alpha`` of ``(keys, item, rater, value)``.

    Items with one rating count as items but say nothing about agreement.  Null
    with fewer than two items or fewer than two values among items with more.
    Ratio values must not be negative.  Linear in the ratings, but for the ratio
    level, which is quadratic in the number of different values.
    """
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}")
    group = list(keys) or ["_all"]
    rows = ratings if keys else ratings.withColumn("_all", F.lit(0))
    counts = value_counts(rows.select(*group, "item", "value"), group)
    shared = counts.where("m > 1")
    margins = settle(shared.groupBy(*group, "value").agg(F.sum("n").alias("n")))
    n, m = F.col("n"), F.col("m")
    if level == "nominal":
        observed = shared.groupBy(*group).agg(F.sum(n * (m - n) / (m - 1)).alias("observed"))
        expected = margins.groupBy(*group).agg((F.sum(n) * F.sum(n) - F.sum(n * n)).cast("double").alias("expected"))
    elif level == "ratio":
        entry = F.struct(F.col("value").cast("double").alias("v"), n.cast("double").alias("n"))
        met = tiles(blocks(shared, [*group, "item", "m"], F.col("value"), entry, VALUES_PER_BLOCK), [*group, "item", "m"])
        part = _ratio_tile("left.v", "left.n", "right.v", "right.n") * F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)
        observed = met.withColumn("part", part).groupBy(*group).agg(F.sum(F.col("part") / (m - 1)).alias("observed"))
        expected = _ratio_expected(margins, group)
    else:
        scores = settle(_centred(margins, group, level))
        s, weight = F.col("s"), F.col("n")
        # Every value has its score.  A left join, of which Spark never broadcasts the
        # counts: it takes them for as small as the file that they were unfolded from.
        scored = match(shared, scores.drop("n"), [*group, "value"], "left")
        items = scored.groupBy(*group, "item", "m").agg(F.sum(n * s).alias("sum"), F.sum(n * s * s).alias("squares"))
        gap = 2.0 * (m * F.col("squares") - F.col("sum") * F.col("sum")) / (m - 1)
        observed = items.groupBy(*group).agg(F.sum(gap).alias("observed"))
        total = F.sum(weight * s)
        expected = scores.groupBy(*group).agg((2.0 * (F.sum(weight) * F.sum(weight * s * s) - total * total)).alias("expected"))
    sizes = margins.groupBy(*group).agg(F.sum("n").alias("total"), F.count("*").alias("n_values"))
    out = counts.groupBy(*group).agg(F.round(F.sum(n / m)).cast("bigint").alias("n_items"))
    for part in (sizes, observed, expected):
        out = match(out, part, group, "left")
    known = (F.col("n_items") >= 2) & (F.col("n_values") >= 2)
    alpha = F.when(known, 1.0 - F.try_divide((F.col("total") - 1) * F.col("observed"), F.col("expected")))
    return out.select(*keys, "n_items", F.coalesce("n_values", F.lit(0)).alias("n_values"), alpha.alias("alpha"))


def panel_alphas_long(ratings: DataFrame, panels: Mapping[str, Sequence[str]], level: str = "ordinal", keys: Sequence[str] = ()) -> DataFrame:
    """``keys, panel, n_items, n_values, alpha``: alpha of each panel of raters."""
    return alpha_long(on_panels(ratings, panels), level, [*keys, "panel"])


# --- kappa ----------------------------------------------------------------------------


def rater_pairs(ratings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, rater_1, rater_2, a, b, n``: confusion counts of every two raters who share items.

    Raters of an item are dealt into blocks, and blocks meet in tiles, so an item
    with very many raters is spread over tasks.  A rater who rates an item twice
    counts with every rating, but never against themselves.
    """
    entry = F.struct("rater", F.col("value").alias("v"))
    met = tiles(blocks(ratings, [*keys, "item"], F.struct("rater", "value"), entry, RATERS_PER_BLOCK), [*keys, "item"])
    others = F.when(F.col("i") == F.col("j"), F.filter("right", lambda y: y["rater"] > F.col("x.rater"))).otherwise(F.filter("right", lambda y: y["rater"] != F.col("x.rater")))
    pairs = met.select(*keys, "i", "j", "right", F.explode("left").alias("x")).select(*keys, "x", F.explode(others).alias("y"))
    first = F.col("x.rater") < F.col("y.rater")
    low, high = F.when(first, F.col("x")).otherwise(F.col("y")), F.when(first, F.col("y")).otherwise(F.col("x"))
    pairs = pairs.select(*keys, low["rater"].alias("rater_1"), high["rater"].alias("rater_2"), low["v"].alias("a"), high["v"].alias("b"))
    return pairs.groupBy(*keys, "rater_1", "rater_2", "a", "b").agg(F.count("*").alias("n"))


def kappa_long(ratings: DataFrame, keys: Sequence[str] = (), weights: str | None = None) -> DataFrame:
    """``keys, rater_1, rater_2, n_rows, n_equal, kappa`` of every two raters who share items."""
    counts = settle(rater_pairs(ratings.where("value is not null").select(*keys, "item", "rater", "value"), keys))
    return open_kappas(counts, [*keys, "rater_1", "rater_2"], weights)


# --- alternative annotators -----------------------------------------------------------


def wins_long(ratings: DataFrame, guesses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, rater, n, wins_f, wins_h, sum_d, sum_d2, skipped`` by accuracy.

    ``ratings`` is ``(keys, item, rater, value)``, ``guesses`` one ``(keys, item,
    value)`` per item.  All raters of an item with the same label share their
    scores, so wins are found once per item and label.  An item without a guess
    counts as one the model gets wrong; items need three ratings.
    """
    group = list(keys)
    rows = ratings.where("value is not null").select(*group, "item", "rater", "value")
    counts = value_counts(rows, group)
    enough = counts.where(F.col("m") >= alttest.MIN_RATINGS)
    said = guesses.select(*group, "item", F.col("value").alias("guess"))
    with_guess = match(enough, said, [*group, "item"], "left")
    # Ratings that equal the guess: one row per item that has any.
    right = with_guess.where(F.col("value") == F.col("guess")).select(*group, "item", F.col("n").alias("hits"))
    scored = match(with_guess, right, [*group, "item"], "left")
    model = F.coalesce("hits", F.lit(0)) - F.when(F.col("value") == F.col("guess"), 1).otherwise(0)
    human = F.col("n") - 1
    labels = scored.select(*group, "item", "value", (model >= human).cast("bigint").alias("w_f"), (human >= model).cast("bigint").alias("w_h"))
    # A left join for the same reason as in alpha_long; rows of items with too few ratings count nowhere.
    won = match(rows, labels, [*group, "item", "value"], "left")
    d = F.col("w_h") - F.col("w_f")
    return won.groupBy(*group, "rater").agg(
        F.count("w_f").alias("n"),
        F.sum("w_f").alias("wins_f"),
        F.sum("w_h").alias("wins_h"),
        F.sum(d).alias("sum_d"),
        F.sum(d * d).alias("sum_d2"),
        F.lit(0).cast("bigint").alias("skipped"),
    ).where("n > 0")


def alt_long(ratings: DataFrame, guesses: DataFrame, keys: Sequence[str], epsilon: float = 0.2, alpha: float = 0.05) -> DataFrame:
    """Per group: winning rate, whether the model passes, p-values and mean advantage.

    Raters are numbered by name within a group, which decides ties of p; those
    without a scored item take no part.
    """
    sums = wins_long(ratings, guesses, keys)
    tests = alttest.tests_from_sums(sums.withColumn("rater_no", F.row_number().over(Window.partitionBy(*keys).orderBy("rater")) - 1), keys, epsilon)
    return alttest.summarise(alttest.by_correction(tests, keys, alpha), keys)
