"""Token and money accounting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.functions.labels import bind
from accordant.operators.spread import running_sums

# Dollars per 1000 tokens as (prompt, completion).
MODEL_PRICES: dict[str, tuple[float, float]] = {
    "gpt-4o": (0.0025, 0.01),
    "gpt-4o-mini": (0.00015, 0.0006),
    "gpt-5": (0.00125, 0.01),
    "gpt-5-mini": (0.00025, 0.002),
    "gpt-5-nano": (0.00005, 0.0004),
    "claude-3-7-sonnet-20250219": (0.0030, 0.0150),
    "claude-3-5-haiku-20241022": (0.0008, 0.0040),
    "gemini-2.0-flash-001": (0.00005, 0.0001),
    "gemini-2.5-pro-preview-03-25": (0.00005, 0.0001),
    "openai/gpt-4o": (0.0025, 0.01),
    "openai/gpt-4o-mini": (0.00015, 0.0006),
    "anthropic/claude-3.5-sonnet": (0.003, 0.015),
    "anthropic/claude-3.7-sonnet": (0.003, 0.015),
    "anthropic/claude-3-haiku": (0.00025, 0.00125),
    "meta-llama/llama-3.1-8b-instruct": (0.00018, 0.00018),
    "meta-llama/llama-3.1-70b-instruct": (0.00088, 0.00088),
    "google/gemini-2.0-flash-001": (0.000075, 0.0003),
}
# Fixed value: dollars per 1000 tokens of a model without a price.
DEFAULT_PRICE = 0.001


def round_binary(value: Column, digits: int) -> Column:
    """Round the exact binary value of a non-negative double, ties to even.

    Spark rounds the shortest decimal spelling instead, which moves about one in
    ten amounts that lie half way.  The rounding error of ``value * 10**digits``
    is recovered by splitting both factors, so the comparison with one half is exact.
    """
    scale = float(10**digits)
    split = 134217729.0  # 2**27 + 1

    def high(x):
        return x * split - (x * split - x)

    scale_high = scale * split - (scale * split - scale)
    scale_low = scale - scale_high

    def result(v: Column) -> Column:
        product, head = v * scale, high(v)
        tail = v - head
        error = (head * scale_high - product) + head * scale_low + tail * scale_high + tail * scale_low
        whole = F.floor(product)
        over = (product - whole - 0.5) + error
        up = (over > 0) | ((over == 0) & (whole % 2 == 1))
        return F.when(up, whole + 1).otherwise(whole) / F.lit(scale)

    return bind(value, result)


def row_cost(
    model: Column,
    prompt_tokens: Column,
    completion_tokens: Column,
    prices: Mapping[str, tuple[float, float]] = MODEL_PRICES,
) -> Column:
    """Dollars of one call, to six decimals.

    The price list is a constant of the job, so the lookup is a literal map and
    not a join.
    """
    entries = []
    for name, (per_prompt, per_completion) in prices.items():
        entries += [
            F.lit(name),
            F.struct(F.lit(per_prompt).alias("p"), F.lit(per_completion).alias("c")),
        ]
    price = F.try_element_at(F.create_map(*entries), model)
    known = prompt_tokens * price["p"] / 1000 + completion_tokens * price["c"] / 1000
    unknown = (prompt_tokens + completion_tokens) * F.lit(DEFAULT_PRICE) / 1000
    return round_binary(F.coalesce(known, unknown), 6)


def with_cost(
    df: DataFrame, prices: Mapping[str, tuple[float, float]] = MODEL_PRICES, as_name: str = "cost"
) -> DataFrame:
    """Add the cost of each reply."""
    return df.withColumn(
        as_name,
        row_cost(F.col("model"), F.col("prompt_tokens"), F.col("completion_tokens"), prices),
    )


def _dollars(cost: Column) -> Column:
    """Exact sum of six-decimal amounts, independent of the order of rows."""
    return F.sum(F.round(cost * 1_000_000).cast("bigint")) / F.lit(1_000_000.0)


def cost_totals(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tokens and dollars per group."""
    return df.groupBy(*keys).agg(
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens_used"),
        _dollars(F.col("cost")).alias("total_cost"),
    )


def estimate(df: DataFrame, key: str, n_runs: int = 1) -> DataFrame:
    """Cost of the first row by key, times rows, times runs."""
    return df.agg(
        F.min_by("cost", key).alias("cost_for_one"), F.count(F.lit(1)).alias("n_rows")
    ).withColumn("total_cost_estimate", F.col("cost_for_one") * F.col("n_rows") * n_runs)


def ledger(runs: DataFrame, when: str, run_id: str, cost: str = "total_cost") -> DataFrame:
    """Add ``cumulative_cost`` over runs in order of time, then of run id.

    Runs are sorted over all tasks; each task sums its stretch of that order, and
    only the sums of stretches meet.  Amounts are added as whole millionths.
    """
    micro = runs.withColumn("_micro", F.round(F.col(cost) * 1_000_000).cast("bigint"))
    summed = running_sums(micro, [], [when, run_id], ["_micro"])
    return summed.withColumn("cumulative_cost", F.col("_micro_upto") / F.lit(1_000_000.0)).drop("_micro", "_micro_upto")
