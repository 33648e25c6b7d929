"""Queries: Krippendorff's alpha, panels, non-inferiority."""

from __future__ import annotations

from pyspark.sql import functions as F

from accordant.operators import alpha, resample
from accordant.operators.patterns import rating_patterns
from accordant.plans.registry import query
from accordant.plans.tables import FACTS_SQL, RATERS, RATINGS, facts

RUN = ["prompt_name", "iteration", "run"]
_K = ", ".join(RUN)
REPLICATES = 20

HUMAN = {"human": RATERS}
PANELS = HUMAN | {
    f"model_for_{out}": [*[r for r in RATERS if r != out], "model_pred"] for out in RATERS
}
WITH_MODEL = {"human": [*RATERS, "model_pred"]}

_DELTA = {
    "nominal": "CASE WHEN x.c = y.c THEN 0.0 ELSE 1.0 END",
    "interval": "CAST((x.c - y.c) * (x.c - y.c) AS DOUBLE)",
    "ratio": "CASE WHEN x.c = y.c THEN 0.0 ELSE pow(CAST(x.c - y.c AS DOUBLE) / (x.c + y.c), 2) END",
    "ordinal": "CASE WHEN x.c = y.c THEN 0.0 WHEN x.c < y.c THEN pow(y.cum - x.cum + (x.nc - y.nc) / 2, 2) ELSE pow(x.cum - y.cum + (y.nc - x.nc) / 2, 2) END",
}

EVERY_SQL = FACTS_SQL + ", ev AS (SELECT *, item_id AS iid, 1 AS w FROM d)"
TRAIN_SQL = FACTS_SQL + ", tr AS (SELECT *, item_id AS iid, 1 AS w FROM d WHERE split = 'train')"


def alpha_sql(keys: str, source: str, panels: dict[str, list[str]], level: str, tag: str = "") -> str:
    """CTEs ending in ``al{tag}(keys, panel, alpha)`` from rows ``(keys, iid, w, ratings)``."""
    union = " UNION ALL ".join(
        f"SELECT {keys}, iid, w, '{p}' AS panel, {c} AS v FROM {source} WHERE {c} IS NOT NULL"
        for p, cols in panels.items()
        for c in cols
    )
    return f"""u{tag} AS ({union}),
vc{tag} AS (SELECT {keys}, panel, iid, w, v, count(*) AS n FROM u{tag} GROUP BY ALL),
mm{tag} AS (SELECT *, sum(n) OVER (PARTITION BY {keys}, panel, iid) AS m FROM vc{tag}),
co{tag} AS (SELECT {keys}, a.panel, a.v AS c, b.v AS k, sum(CAST(a.w * a.n * (b.n - CASE WHEN a.v = b.v THEN 1 ELSE 0 END) AS DOUBLE) / (a.m - 1)) AS o
  FROM mm{tag} a JOIN mm{tag} b USING ({keys}, panel, iid) WHERE a.m >= 2 GROUP BY {keys}, a.panel, a.v, b.v),
nv{tag} AS (SELECT {keys}, panel, c, sum(o) AS nc FROM co{tag} GROUP BY ALL),
cu{tag} AS (SELECT *, sum(nc) OVER (PARTITION BY {keys}, panel ORDER BY c) AS cum, sum(nc) OVER (PARTITION BY {keys}, panel) AS tot FROM nv{tag}),
gd{tag} AS (SELECT {keys}, panel, x.c AS c, y.c AS k, x.tot AS tot, x.nc * y.nc AS e, {_DELTA[level]} AS dd FROM cu{tag} x JOIN cu{tag} y USING ({keys}, panel)),
al{tag} AS (SELECT {keys}, panel, 1 - (max(gd{tag}.tot) - 1) * sum(coalesce(o, 0) * dd) / nullif(sum(e * dd), 0) AS alpha
  FROM gd{tag} LEFT JOIN co{tag} USING ({keys}, panel, c, k) GROUP BY {keys}, panel)"""


def _level_query(level: str):
    keys = f"{_K}, split"
    sql = f"""WITH {EVERY_SQL}, {alpha_sql(keys, 'ev', HUMAN, level)}, {alpha_sql(keys, 'ev', WITH_MODEL, level, '2')}
    SELECT {keys}, round(al.alpha, 9) AS alpha_raters, round(al2.alpha, 9) AS alpha_with_model FROM al JOIN al2 USING ({keys})"""

    def run(spark, sf):
        groups = [*RUN, "split"]
        patterns = rating_patterns(facts(spark, sf), RATINGS, groups, listwise=False)
        panels = {"raters": RATERS, "with_model": RATINGS.columns}
        table = alpha.alphas_from_coincidences(alpha.coincidences(patterns, panels, groups), groups, level)
        return table.groupBy(*groups).agg(
            *[
                F.round(F.max(F.when(F.col("panel") == p, F.col("alpha"))), 9).alias(f"alpha_{p}")
                for p in panels
            ]
        )

    return sql, run


for _level in alpha.LEVELS:
    _text, _fn = _level_query(_level)
    query(f"alpha_{_level}", _text)(_fn)


def _compare(tag: str, keys: str) -> str:
    return f"""SELECT {keys}, max(alpha) FILTER (WHERE panel = 'human') AS alpha_human, avg(alpha) FILTER (WHERE panel <> 'human') AS alpha_model FROM al{tag} GROUP BY {keys}"""


@query(
    "alpha_panels",
    f"""WITH {TRAIN_SQL}, {alpha_sql(_K, 'tr', PANELS, 'ordinal')}, p AS ({_compare('', _K)})
    SELECT {_K}, round(alpha_human, 9) AS alpha_human, round(alpha_model, 9) AS alpha_model, round(alpha_model - alpha_human, 9) AS difference FROM p""",
)
def alpha_panels(spark, sf):
    table = alpha.compare_panels(alpha.panel_alphas(facts(spark, sf), RATINGS, "ordinal"), RUN)
    return _rounded(table)


def _rounded(df):
    return df.withColumns(
        {f.name: F.round(f.name, 9) for f in df.schema.fields if f.dataType.typeName() == "double"}
    )


_STEPS = (367879, 735759, 919699, 981012, 996340, 999406, 999917)
# Draw weights per (item, replicate), then rating patterns with summed weights.
BOOT_SQL = (
    FACTS_SQL
    + f""",
rs0 AS (SELECT item_id, rep, (item_id * 48271 + rep * 104729 + 11) % 2147483647 AS f FROM (SELECT DISTINCT item_id FROM d) CROSS JOIN (SELECT unnest(generate_series(1, {REPLICATES})) AS rep)),
rs1 AS (SELECT *, (f * f + 12345) % 2147483647 AS g FROM rs0),
rs2 AS (SELECT item_id, rep, ((g * g + f) % 2147483647) % 1000000 AS z FROM rs1),
rs AS (SELECT item_id, rep, {' + '.join(f'CASE WHEN z >= {s} THEN 1 ELSE 0 END' for s in _STEPS)} AS weight FROM rs2),
bp AS (SELECT {_K}, rep, model_pred, rater_a, rater_b, rater_c, sum(weight) AS w FROM d JOIN rs USING (item_id) WHERE split = 'train' AND weight > 0 GROUP BY ALL),
bq AS (SELECT *, row_number() OVER () AS iid FROM bp),
{alpha_sql(_K + ', rep', 'bq', PANELS, 'ordinal', 'b')},
bd AS (SELECT {_K}, rep, alpha_human, alpha_model, alpha_model - alpha_human AS difference FROM ({_compare('b', _K + ', rep')}))"""
)

_RUN_SQL = f"""tr AS (SELECT *, item_id AS iid, 1 AS w FROM d WHERE split = 'train'),
{alpha_sql(_K, 'tr', PANELS, 'ordinal')}, ob AS ({_compare('', _K)}),
ci AS (SELECT {_K}, quantile_cont(difference, 0.05) AS ci_lower, quantile_cont(difference, 0.95) AS ci_upper, count(*) AS n_bootstrap FROM bd GROUP BY ALL),
rr AS (SELECT {_K}, alpha_human, alpha_model, alpha_model - alpha_human AS difference, ci_lower, ci_upper, n_bootstrap, -0.05::DOUBLE AS margin, ci_lower > -0.05 AS non_inferior FROM ob JOIN ci USING ({_K}))"""

_ACROSS_SQL = """ac AS (SELECT prompt_name, iteration, count(*) AS n_runs,
  round(avg(alpha_human), 9) AS alpha_human_mean, round(stddev_pop(alpha_human), 9) AS alpha_human_std,
  round(avg(alpha_model), 9) AS alpha_model_mean, round(stddev_pop(alpha_model), 9) AS alpha_model_std,
  round(avg(difference), 9) AS difference_mean, round(stddev_pop(difference), 9) AS difference_std,
  round(avg(ci_lower), 9) AS ci_lower_mean, round(avg(ci_upper), 9) AS ci_upper_mean,
  count(*) FILTER (WHERE non_inferior) AS n_non_inferior, round(count(*) FILTER (WHERE non_inferior) / count(*), 9) AS non_inferiority_ratio
  FROM rr GROUP BY ALL)"""


def _fixed(spark, sf):
    rows = facts(spark, sf)
    return rows, resample.hashed_bootstrap(rows, "item_id", REPLICATES, RATINGS)


@query(
    "alpha_bootstrap_fixed",
    f"""WITH {BOOT_SQL} SELECT {_K}, rep, round(alpha_human, 9) AS alpha_human, round(alpha_model, 9) AS alpha_model, round(difference, 9) AS difference FROM bd""",
)
def alpha_bootstrap_fixed(spark, sf):
    return _rounded(_fixed(spark, sf)[1])


@query(
    "alpha_non_inferiority",
    f"""WITH {BOOT_SQL}, {_RUN_SQL} SELECT {_K}, round(alpha_human, 9) AS alpha_human, round(alpha_model, 9) AS alpha_model, round(difference, 9) AS difference,
    round(ci_lower, 9) AS ci_lower, round(ci_upper, 9) AS ci_upper, n_bootstrap, margin, non_inferior FROM rr""",
)
def alpha_non_inferiority(spark, sf):
    rows, replicates = _fixed(spark, sf)
    return _rounded(alpha.non_inferiority(rows, RATINGS, replicates))


@query("alpha_run_summary", f"WITH {BOOT_SQL}, {_RUN_SQL}, {_ACROSS_SQL} SELECT * FROM ac")
def alpha_run_summary(spark, sf):
    rows, replicates = _fixed(spark, sf)
    return _rounded(alpha.across_runs(alpha.non_inferiority(rows, RATINGS, replicates)))


@query(
    "alpha_verdict",
    f"""WITH {BOOT_SQL}, {_RUN_SQL}, {_ACROSS_SQL} SELECT prompt_name, iteration, n_runs, n_non_inferior,
    CASE WHEN n_non_inferior = n_runs THEN 'all' WHEN n_non_inferior > 0 THEN 'some' ELSE 'none' END AS verdict, ci_lower_mean > 0 AS superior FROM ac""",
)
def alpha_verdict(spark, sf):
    rows, replicates = _fixed(spark, sf)
    summary = alpha.across_runs(alpha.non_inferiority(rows, RATINGS, replicates))
    return alpha.verdict(summary).select(
        "prompt_name", "iteration", "n_runs", "n_non_inferior", "verdict", "superior"
    )


# Draws are random: their number, the point values and what must hold for any draws are fixed.
_SETTLED = ["alpha_human", "alpha_model", "difference", "n_bootstrap", "margin", "non_inferior", "around", "half_width_ok"]


def _settled(per_run, wide):
    """Columns of a bootstrap that do not depend on the draws.

    ``half_width_ok``: half the interval lies within ``wide``.
    """
    half = (F.col("ci_upper") - F.col("ci_lower")) / 2
    around = (F.col("ci_lower") < F.col("difference")) & (F.col("difference") < F.col("ci_upper"))
    marked = per_run.withColumn("around", around).withColumn("half_width_ok", half.between(*wide))
    return _rounded(marked).select(*[c for c in per_run.columns if not c.startswith("ci_")], "around", "half_width_ok")


@query(
    "alpha_bootstrap",
    f"""WITH {BOOT_SQL}, {_RUN_SQL} SELECT {_K}, round(alpha_human, 9) AS alpha_human, round(alpha_model, 9) AS alpha_model, round(difference, 9) AS difference,
    CAST(2000 AS BIGINT) AS n_bootstrap, margin, difference > 0 AS non_inferior, true AS around, true AS half_width_ok FROM rr""",
)
def alpha_bootstrap(spark, sf):
    """2000 random resamples; tests compare their intervals with brute force."""
    rows = facts(spark, sf)
    replicates = resample.bootstrap(rows, RATINGS, "ordinal", n_bootstrap=2000, seed=42)
    return _settled(alpha.non_inferiority(rows, RATINGS, replicates), (0.0005, 0.05))
