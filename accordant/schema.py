"""Canonical table shapes."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN, VAL = "train", "val"
AGGREGATED = "aggregated"

# What a results table gets when it carries no scenario columns.
FACT_DEFAULTS = {
    "prompt_name": "streamlit_analysis",
    "iteration": 1,
    "split": TRAIN,
    "run": 1,
}


@dataclass(frozen=True)
class Ratings:
    """Names of the rating columns of a results table."""

    raters: tuple[str, ...]
    model: str = "model_pred"

    @classmethod
    def of(cls, raters: Iterable[str], model: str = "model_pred") -> "Ratings":
        return cls(tuple(raters), model)

    @property
    def columns(self) -> list[str]:
        return [*self.raters, self.model]


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Fail early, with all missing names in the message."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def with_fact_columns(
    df: DataFrame, prediction: str | None = None, model: str = "model_pred"
) -> DataFrame:
    """Add scenario columns that are absent and name the chosen prediction."""
    out = df
    for name, value in FACT_DEFAULTS.items():
        if name not in out.columns:
            out = out.withColumn(name, F.lit(value))
    if prediction and prediction != model:
        require_columns(out, [prediction])
        out = out.withColumnRenamed(prediction, model)
    return out
