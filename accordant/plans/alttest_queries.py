"""Queries: the alternative-annotator test."""

from __future__ import annotations

from pyspark.sql import functions as F

from accordant.operators import alttest
from accordant.plans.registry import query
from accordant.plans.tables import FACTS_SQL, RATERS, RATINGS, RAW_SQL, facts, items, raw_labels

RUN = ["prompt_name", "iteration", "run", "split"]
_K = ", ".join(RUN)
EPSILON = 0.1

_ACCURACY = (
    "(CASE WHEN {x} = o1 THEN 1 ELSE 0 END + CASE WHEN {x} = o2 THEN 1 ELSE 0 END)"
)
_SQUARES = "(-(({x} - o1) * ({x} - o1) + ({x} - o2) * ({x} - o2)))"


def wins_sql(source: str, keys: str, score: str) -> str:
    """``wr(keys, rater, w_f, w_h)``: with three raters, complete rows take part."""
    rows = []
    for i, r in enumerate(RATERS):
        o1, o2 = (x for x in RATERS if x != r)
        rows.append(
            f"SELECT {keys}, '{r}' AS rater, {i} AS rater_no, model_pred AS f, {r} AS h, {o1} AS o1, {o2} AS o2 FROM {source} "
            "WHERE rater_a IS NOT NULL AND rater_b IS NOT NULL AND rater_c IS NOT NULL"
        )
    return f"""wx AS ({' UNION ALL '.join(rows)}),
wy AS (SELECT *, {score.format(x='f')} AS sf, {score.format(x='h')} AS sh FROM wx),
wr AS (SELECT {keys}, rater, rater_no, CASE WHEN sf >= sh THEN 1 ELSE 0 END AS w_f, CASE WHEN sh >= sf THEN 1 ELSE 0 END AS w_h FROM wy)"""


# The t distribution through x = atan(t / sqrt(v)): the density becomes a power of
# the cosine, summed by Simpson's rule where it is not negligible.
TEST_SQL = """ts0 AS (SELECT {k}, rater, rater_no, count(*) AS n, avg(w_f) AS rho_f, avg(w_h) AS rho_h, CAST(sum(w_h - w_f) AS DOUBLE) AS sd, CAST(sum((w_h - w_f) * (w_h - w_f)) AS DOUBLE) AS sd2 FROM wr GROUP BY ALL),
ts1 AS (SELECT *, sd / n AS mean_d, (sd2 - sd * (sd / n)) / (n - 1) AS var FROM ts0),
ts2 AS (SELECT *, (mean_d - {eps}) / sqrt(var / n) AS t, CAST(n - 1 AS DOUBLE) AS v FROM ts1),
ts3 AS (SELECT *, least(abs(atan(t / sqrt(v))), 14 / sqrt(v)) AS top FROM ts2),
ts4 AS (SELECT {k}, rater, max(top) / 3000 / 3 * sum(CASE WHEN i = 0 OR i = 3000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp((v - 1) * ln(cos(top * i / 3000)))) AS area
  FROM ts3 CROSS JOIN (SELECT unnest(generate_series(0, 3000)) AS i) GROUP BY {k}, rater),
tt AS (SELECT {k}, rater, rater_no, n, rho_f, rho_h, mean_d, t, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5 + sign(t) * area * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(pi()))) AS p FROM ts2 JOIN ts4 USING ({k}, rater)),
rk AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY p NULLS LAST, rater_no) AS kk, count(*) OVER (PARTITION BY {k}) AS m FROM tt),
ck AS (SELECT *, max(CASE WHEN p <= kk * 0.05 / (m * list_sum(list_transform(generate_series(1, m), lambda i: 1.0 / i))) THEN kk END) OVER (PARTITION BY {k}) AS last FROM rk),
te AS (SELECT *, coalesce(kk <= last, FALSE) AS rejected FROM ck)"""


def _tests(eps: float) -> str:
    return TEST_SQL.format(k=_K, eps=eps)


@query(
    "alt_row_wins",
    f"""WITH {FACTS_SQL}, {wins_sql('d', _K, _ACCURACY)} SELECT {_K}, rater, w_f, w_h, count(*) AS n_rows FROM wr GROUP BY ALL""",
)
def alt_row_wins(spark, sf):
    wins = alttest.row_wins(facts(spark, sf), RATINGS, RUN)
    return wins.groupBy(*RUN, "rater", "w_f", "w_h").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "alt_row_wins_rmse",
    f"""WITH {FACTS_SQL}, {wins_sql('d', _K, _SQUARES)} SELECT {_K}, rater, w_f, w_h, count(*) AS n_rows FROM wr GROUP BY ALL""",
)
def alt_row_wins_rmse(spark, sf):
    wins = alttest.row_wins(facts(spark, sf), RATINGS, RUN, metric="rmse")
    return wins.groupBy(*RUN, "rater", "w_f", "w_h").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "alt_rho",
    f"""WITH {FACTS_SQL}, {wins_sql('d', _K, _ACCURACY)} SELECT {_K}, rater, count(*) AS n, round(avg(w_f), 9) AS rho_f, round(avg(w_h), 9) AS rho_h FROM wr GROUP BY {_K}, rater""",
)
def alt_rho(spark, sf):
    tests = alttest.rater_tests(facts(spark, sf), RATINGS, RUN, EPSILON)
    return tests.select(
        *RUN, "rater", "n", F.round("rho_f", 9).alias("rho_f"), F.round("rho_h", 9).alias("rho_h")
    )


@query(
    "alt_ttest",
    f"""WITH {FACTS_SQL}, {wins_sql('d', _K, _ACCURACY)}, {_tests(EPSILON)} SELECT {_K}, rater, n, round(mean_d, 9) AS mean_d, round(t, 6) AS t, round(p, 7) AS p FROM te""",
)
def alt_ttest(spark, sf):
    tests = alttest.rater_tests(facts(spark, sf), RATINGS, RUN, EPSILON)
    return tests.select(
        *RUN,
        "rater",
        "n",
        F.round("mean_d", 9).alias("mean_d"),
        F.round("t", 6).alias("t"),
        F.round("p", 7).alias("p"),
    )


@query(
    "alt_by_correction",
    f"""WITH {FACTS_SQL}, {wins_sql('d', _K, _ACCURACY)}, {_tests(0.0)} SELECT {_K}, rater, round(p, 7) AS p, rejected FROM te""",
)
def alt_by_correction(spark, sf):
    tests = alttest.rater_tests(facts(spark, sf), RATINGS, RUN, epsilon=0.0)
    return alttest.by_correction(tests, RUN).select(
        *RUN, "rater", F.round("p", 7).alias("p"), "rejected"
    )


_SUMMARY = f"""su AS (SELECT {_K}, avg(CASE WHEN rejected THEN 1.0 ELSE 0.0 END) AS winning_rate, avg(rho_f) AS avg_adv_prob,
 string_agg(CAST(round(p, 6) AS VARCHAR), '|' ORDER BY rater_no) AS p_text FROM te GROUP BY {_K})"""


@query(
    "alt_summary",
    f"""WITH {FACTS_SQL}, {wins_sql('d', _K, _ACCURACY)}, {_tests(EPSILON)}, {_SUMMARY}
    SELECT {_K}, round(winning_rate, 9) AS winning_rate, winning_rate >= 0.5 AS passed, round(avg_adv_prob, 9) AS avg_adv_prob FROM su""",
)
def alt_summary(spark, sf):
    table = alttest.alt_summary(facts(spark, sf), RATINGS, RUN, EPSILON)
    return table.select(
        *RUN,
        F.round("winning_rate", 9).alias("winning_rate"),
        "passed",
        F.round("avg_adv_prob", 9).alias("avg_adv_prob"),
    )


@query(
    "alt_summary_rmse",
    f"""WITH {FACTS_SQL}, {wins_sql('d', _K, _SQUARES)}, {_tests(EPSILON)}, {_SUMMARY}
    SELECT {_K}, round(winning_rate, 9) AS winning_rate, winning_rate >= 0.5 AS passed, round(avg_adv_prob, 9) AS avg_adv_prob FROM su""",
)
def alt_summary_rmse(spark, sf):
    table = alttest.alt_summary(facts(spark, sf), RATINGS, RUN, EPSILON, metric="rmse")
    return table.select(
        *RUN,
        F.round("winning_rate", 9).alias("winning_rate"),
        "passed",
        F.round("avg_adv_prob", 9).alias("avg_adv_prob"),
    )


_POOLED = """pk AS (SELECT prompt_name, iteration, split, rater, rater_no, avg(p) AS p FROM te GROUP BY ALL),
pr2 AS (SELECT *, row_number() OVER (PARTITION BY prompt_name, iteration, split ORDER BY p, rater_no) AS kk, count(*) OVER (PARTITION BY prompt_name, iteration, split) AS m FROM pk),
pc AS (SELECT *, max(CASE WHEN p <= kk * 0.05 / (m * list_sum(list_transform(generate_series(1, m), lambda i: 1.0 / i))) THEN kk END) OVER (PARTITION BY prompt_name, iteration, split) AS last FROM pr2),
po AS (SELECT prompt_name, iteration, split, avg(CASE WHEN coalesce(kk <= last, FALSE) THEN 1.0 ELSE 0.0 END) AS winning_rate, list(round(p, 6) ORDER BY rater_no) AS ps FROM pc GROUP BY ALL),
sz AS (SELECT prompt_name, iteration, run, split, count(*) AS n_rows FROM d GROUP BY ALL),
sp AS (SELECT prompt_name, iteration, run, split, avg(CASE WHEN rejected THEN 1.0 ELSE 0.0 END) AS winning_rate, avg(rho_f) AS adv, list(round(p, 6) ORDER BY rater_no) AS ps FROM te GROUP BY ALL),
al AS (SELECT prompt_name, iteration, CAST(run AS VARCHAR) AS run, CAST(NULL AS BIGINT) AS n_runs, split, n_rows, winning_rate, adv, ps FROM sz JOIN sp USING (prompt_name, iteration, run, split)
  UNION ALL SELECT prompt_name, iteration, 'aggregated', count(DISTINCT run), split, CAST(sum(n_rows) AS BIGINT), max(po.winning_rate), avg(adv), max(po.ps) FROM sz JOIN sp USING (prompt_name, iteration, run, split) JOIN po USING (prompt_name, iteration, split) GROUP BY prompt_name, iteration, split)"""


@query(
    "alt_run_summary",
    f"""WITH {FACTS_SQL}, {wins_sql('d', _K, _ACCURACY)}, {_tests(0.0)}, {_POOLED}
    SELECT prompt_name, iteration, run, max(n_runs) AS n_runs, TRUE AS use_validation_set, """
    + ", ".join(
        f"""CAST(max(n_rows) FILTER (WHERE split = '{s}') AS BIGINT) AS "N_{s}", round(max(winning_rate) FILTER (WHERE split = '{s}'), 9) AS winning_rate_{s},
        max(winning_rate) FILTER (WHERE split = '{s}') >= 0.5 AS passed_alt_test_{s}, round(max(adv) FILTER (WHERE split = '{s}'), 9) AS avg_adv_prob_{s},
        list_extract(max(ps) FILTER (WHERE split = '{s}'), 1) AS p1_{s}, list_extract(max(ps) FILTER (WHERE split = '{s}'), 2) AS p2_{s}, list_extract(max(ps) FILTER (WHERE split = '{s}'), 3) AS p3_{s}"""
        for s in ("train", "val")
    )
    + " FROM al GROUP BY prompt_name, iteration, run",
)
def alt_run_summary(spark, sf):
    table = alttest.alt_across_runs(facts(spark, sf), RATINGS, epsilon=0.0)
    extra = {
        f"{c}_{s}": F.round(f"{c}_{s}", 9) for c in ("winning_rate", "avg_adv_prob") for s in ("train", "val")
    } | {
        f"p{i + 1}_{s}": F.round(F.col(f"p_values_{s}")[i], 6) for i in range(3) for s in ("train", "val")
    }
    return table.withColumns(extra).drop("p_values_train", "p_values_val")


@query(
    "agg_rater_profile",
    f"""WITH {FACTS_SQL}, {RAW_SQL},
    j AS (SELECT i.rater_a, CAST(i.rater_b AS DOUBLE) AS rater_b, r.raw_label FROM items i JOIN raw r USING (item_id)),
    u AS (SELECT 'rater_a' AS rater, count(rater_a) AS n_labels, 'int' AS kinds FROM j UNION ALL SELECT 'rater_b', count(rater_b), 'float' FROM j
      UNION ALL SELECT 'raw_label', count(*) FILTER (WHERE raw_label <> ''), string_agg(DISTINCT CASE WHEN raw_label = '' THEN NULL WHEN regexp_matches(raw_label, '^[0-9]+$') THEN 'int' WHEN regexp_matches(raw_label, '^[0-9]+\\.[0-9]+$') THEN 'float' ELSE 'str' END, '|' ORDER BY CASE WHEN raw_label = '' THEN NULL WHEN regexp_matches(raw_label, '^[0-9]+$') THEN 'int' WHEN regexp_matches(raw_label, '^[0-9]+\\.[0-9]+$') THEN 'float' ELSE 'str' END) FROM j)
    SELECT rater, n_labels, kinds, TRUE AS mixed_types FROM u""",
)
def agg_rater_profile(spark, sf):
    rows = (
        items(spark, sf)
        .withColumn("rater_b", F.col("rater_b").cast("double"))
        .join(raw_labels(spark, sf), "item_id")
    )
    profile = alttest.rater_profile(rows, ["rater_a", "rater_b", "raw_label"])
    return profile.withColumn("kinds", F.array_join("kinds", "|"))
