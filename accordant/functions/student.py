"""Lower tail of Student's t, for tables of a few rows per statistic."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Nodes of one panel.  The density is smooth over several panels' width, so that
# sixteen nodes leave nothing but rounding.
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(16)
_PANEL, _SPAN = 0.5, 60.0


def _mass(start: float, df: float) -> float:
    """Integral of the density from ``start`` >= 0 upwards, up to a constant.

    With x = sinh(u) the tail falls like exp(-df * u), for one degree of freedom
    as for many, and nothing is left beyond the span.
    """
    u0 = math.asinh(start)
    edges = np.arange(u0, u0 + _SPAN, _PANEL)
    u = edges[:, None] + _PANEL / 2 * (_NODES + 1)
    x = np.sinh(u)
    with np.errstate(over="ignore"):
        log_density = -(df + 1) / 2 * np.log1p(x * x / df) + np.log(np.cosh(u))
    return float((np.exp(log_density) * _WEIGHTS).sum() * _PANEL / 2)


def t_cdf(t: float, df: float) -> float:
    """P(T <= t) for ``df`` >= 1 degrees of freedom.

    The tail's share of the whole, both by the same quadrature; one method for
    all sizes, with an error below 1e-12.
    """
    if t is None or df is None or math.isnan(t) or math.isnan(df):
        return float("nan")
    if df < 1:
        raise ValueError("at least one degree of freedom is needed")
    if math.isinf(t):
        return 1.0 if t > 0 else 0.0
    tail = 0.5 * _mass(abs(t), df) / _mass(0.0, df)
    return tail if t < 0 else 1.0 - tail


@F.pandas_udf(T.DoubleType())
def _t_cdf_series(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_cdf(a, b) for a, b in zip(t, df)], dtype="float64")


def lower_tail(t: Column, df: Column) -> Column:
    """Column form of :func:`t_cdf`; meant for one row per (group, rater)."""
    return _t_cdf_series(t.cast("double"), df.cast("double"))


def one_sided_p(n: Column, total: Column, total_sq: Column, epsilon: float) -> dict[str, Column]:
    """Columns ``mean``, ``t`` and ``p`` of the test "mean below epsilon".

    Sums come in as integers.  With no spread the answer is certain: p is 0 below
    epsilon and 1 above it; with fewer than two values or a mean equal to epsilon
    there is no answer.
    """
    count = n.cast("double")
    mean = F.try_divide(total.cast("double"), count)
    spread = total_sq.cast("double") - total.cast("double") * mean
    variance = F.try_divide(spread, count - 1)
    flat = (variance <= 0) | variance.isNull()
    t = F.when(~flat, (mean - F.lit(epsilon)) / F.sqrt(variance / count))
    p = (
        F.when(n < 2, F.lit(None).cast("double"))
        .when(flat & (mean < epsilon), F.lit(0.0))
        .when(flat & (mean > epsilon), F.lit(1.0))
        .when(flat, F.lit(None).cast("double"))
        .otherwise(lower_tail(t, count - 1))
    )
    return {"mean": mean, "t": t, "p": p}
