"""Queries: comparing prompt iterations."""

from __future__ import annotations

from pyspark.sql import functions as F

from accordant.functions.labels import majority_vote
from accordant.operators import classification, cost, iterate
from accordant.plans.agreement_queries import MAJORITY_SQL, PLAIN, kappa_sql
from accordant.plans.alttest_queries import _ACCURACY, TEST_SQL, wins_sql
from accordant.plans.registry import query
from accordant.plans.reply_queries import _COSTS
from accordant.plans.tables import (
    ITERATIVE_SQL,
    LABELS,
    PRICES,
    RATERS,
    RATINGS,
    REPLIES_SQL,
    iterative_facts,
    responses,
)

# Accuracy of every iteration; the second prompt has no validation set.
SCORES_SQL = (
    ITERATIVE_SQL
    + f""",
q AS (SELECT *, {MAJORITY_SQL} AS gt FROM it WHERE model_pred IS NOT NULL AND rater_a IS NOT NULL AND rater_b IS NOT NULL AND rater_c IS NOT NULL),
sc AS (SELECT prompt_name, prompt_iteration AS iteration,
  CAST(sum(CASE WHEN split = 'train' AND gt = model_pred THEN 1 ELSE 0 END) AS DOUBLE) / count(*) FILTER (WHERE split = 'train') AS accuracy_train,
  CASE WHEN prompt_name = 'p_a' THEN CAST(sum(CASE WHEN split = 'val' AND gt = model_pred THEN 1 ELSE 0 END) AS DOUBLE) / count(*) FILTER (WHERE split = 'val') END AS accuracy_val
  FROM q GROUP BY prompt_name, prompt_iteration)"""
)


def _scores(spark, sf):
    keys = ["prompt_name", "prompt_iteration", "split"]
    table = classification.accuracy(iterative_facts(spark, sf), RATINGS, keys)

    def of(split):
        return F.max(F.when(F.col("split") == split, F.col("accuracy")))

    return (
        table.groupBy("prompt_name", F.col("prompt_iteration").alias("iteration"))
        .agg(of("train").alias("accuracy_train"), of("val").alias("accuracy_val"))
        .withColumn("accuracy_val", F.when(F.col("prompt_name") == "p_a", F.col("accuracy_val")))
    )


def _rounded(df):
    return df.withColumns(
        {f.name: F.round(f.name, 9) for f in df.schema.fields if f.dataType.typeName() == "double"}
    )


@query(
    "win_best_run",
    f"""WITH {SCORES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY prompt_name ORDER BY accuracy_val DESC NULLS LAST, CASE WHEN accuracy_val IS NULL THEN accuracy_train END DESC NULLS LAST, iteration) AS k FROM sc)
    SELECT prompt_name, iteration, round(accuracy_train, 9) AS accuracy_train, round(accuracy_val, 9) AS accuracy_val FROM r WHERE k = 1""",
)
def win_best_run(spark, sf):
    return _rounded(iterate.best_row(_scores(spark, sf), ["prompt_name"]))


@query(
    "win_best_prompt",
    f"""WITH {SCORES_SQL}, r AS (SELECT *, coalesce(accuracy_val, accuracy_train) AS acc, row_number() OVER (PARTITION BY prompt_name ORDER BY coalesce(accuracy_val, accuracy_train) DESC, iteration) AS k FROM sc)
    SELECT prompt_name, iteration AS best_iteration, round(acc, 9) AS best_accuracy FROM r WHERE k = 1""",
)
def win_best_prompt(spark, sf):
    return _rounded(iterate.best_prompt(_scores(spark, sf), ["prompt_name"]))


@query(
    "win_effect_of_change",
    f"""WITH {SCORES_SQL}, r AS (SELECT *, lag(accuracy_val) OVER (PARTITION BY prompt_name ORDER BY iteration) AS before FROM sc)
    SELECT prompt_name, iteration, round(accuracy_train, 9) AS accuracy_train, round(accuracy_val, 9) AS accuracy_val,
    CASE WHEN accuracy_val > before THEN 'Those changes improved the classification' WHEN accuracy_val < before THEN 'Those changes decreased the classification'
      WHEN accuracy_val = before THEN 'No change in classification performance' ELSE 'N/A' END AS effect_of_changes FROM r""",
)
def win_effect_of_change(spark, sf):
    return _rounded(iterate.effect_of_change(_scores(spark, sf), ["prompt_name"]))


@query(
    "win_example_pick",
    f"""WITH {ITERATIVE_SQL}, q AS (SELECT *, {MAJORITY_SQL} AS gt FROM it WHERE split = 'train'),
    c AS (SELECT *, NOT coalesce(model_pred = gt, FALSE) AS is_mistake FROM q),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY prompt_name, prompt_iteration, is_mistake ORDER BY item_id) AS INTEGER) AS pick FROM c)
    SELECT prompt_name, prompt_iteration, item_id, is_mistake, pick, gt AS human_label, model_pred AS llm1_label FROM r WHERE pick <= CASE WHEN is_mistake THEN 2 ELSE 2 END""",
)
def win_example_pick(spark, sf):
    rows = (
        iterative_facts(spark, sf)
        .where("split = 'train'")
        .withColumn("gt", majority_vote([F.col(r) for r in RATERS]))
    )
    picked = iterate.pick_examples(rows, ["prompt_name", "prompt_iteration"], "item_id")
    return picked.select(
        "prompt_name",
        "prompt_iteration",
        "item_id",
        "is_mistake",
        "pick",
        F.col("gt").alias("human_label"),
        F.col("model_pred").alias("llm1_label"),
    )


@query(
    "win_early_stop",
    f"""WITH {ITERATIVE_SQL}, q AS (SELECT *, {MAJORITY_SQL} AS gt FROM it WHERE split = 'train'),
    m AS (SELECT prompt_name, prompt_iteration, CASE WHEN prompt_name = 'p_a' AND prompt_iteration = 2 THEN gt ELSE model_pred END AS g, gt FROM q WHERE gt IS NOT NULL),
    c AS (SELECT prompt_name, prompt_iteration, CAST(sum(CASE WHEN coalesce(g = gt, FALSE) THEN 0 ELSE 1 END) AS BIGINT) AS n_mistakes FROM m GROUP BY ALL),
    st AS (SELECT prompt_name, min(prompt_iteration) AS stop FROM c WHERE n_mistakes = 0 GROUP BY prompt_name)
    SELECT c.* FROM c LEFT JOIN st USING (prompt_name) WHERE stop IS NULL OR prompt_iteration <= stop""",
)
def win_early_stop(spark, sf):
    vote = majority_vote([F.col(r) for r in RATERS])
    perfect = (F.col("prompt_name") == "p_a") & (F.col("prompt_iteration") == 2)
    rows = (
        iterative_facts(spark, sf)
        .where(vote.isNotNull())
        .withColumn("model_pred", F.when(perfect, vote).otherwise(F.col("model_pred")))
    )
    return iterate.before_early_stop(rows, RATINGS, ["prompt_name"])


_KEYS = "prompt_name, prompt_iteration, split"


def _iteration_sql() -> str:
    def pick(split, expression, name, digits=9):
        value = f"max({expression}) FILTER (WHERE split = '{split}')"
        return f"round({value}, {digits}) AS {name}_{split}"

    cols = []
    for s in ("train", "val"):
        cols += [
            pick(s, "kappa", "kappa"),
            pick(s, "CAST(n_equal AS DOUBLE) / n_rows", "accuracy"),
            pick(s, "winning_rate", "winning_rate"),
            f"max(winning_rate) FILTER (WHERE split = '{s}') >= 0.5 AS passed_alt_test_{s}",
            pick(s, "adv", "avg_adv_prob"),
        ]
    people = [
        f"round(max(acc) FILTER (WHERE split = '{s}' AND rater = '{r}'), 9) AS {r}_{s}_acc"
        for r in RATERS
        for s in ("train", "val")
    ]
    rated = " UNION ALL ".join(
        f"SELECT {_KEYS}, '{r}' AS rater, {r} AS v, gt FROM q" for r in RATERS
    )
    return f"""WITH {ITERATIVE_SQL}, {REPLIES_SQL}, {_COSTS}, q AS (SELECT *, {MAJORITY_SQL} AS gt FROM it WHERE {MAJORITY_SQL} IS NOT NULL),
    {kappa_sql(_KEYS, 'q', PLAIN)}, {wins_sql('it', _KEYS, _ACCURACY)}, {TEST_SQL.format(k=_KEYS, eps=0.2)},
    su AS (SELECT {_KEYS}, avg(CASE WHEN rejected THEN 1.0 ELSE 0.0 END) AS winning_rate, avg(rho_f) AS adv FROM te GROUP BY {_KEYS}),
    lf AS (SELECT prompt_name, prompt_iteration, {', '.join(cols)} FROM (SELECT * FROM kap WHERE pair = 'gt_vs_model') JOIN su USING ({_KEYS}) GROUP BY prompt_name, prompt_iteration),
    hu AS (SELECT {_KEYS}, rater, CAST(sum(CASE WHEN v = gt THEN 1 ELSE 0 END) AS DOUBLE) / count(v) AS acc FROM ({rated}) GROUP BY ALL),
    rt AS (SELECT prompt_name, prompt_iteration, {', '.join(people)} FROM hu GROUP BY ALL),
    us AS (SELECT completion_no AS prompt_iteration, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens_used, CAST(sum(CAST(round(cost * 1000000) AS BIGINT)) AS DOUBLE) / 1000000 AS total_cost FROM costs GROUP BY ALL)
    SELECT * FROM lf JOIN rt USING (prompt_name, prompt_iteration) LEFT JOIN us USING (prompt_iteration)"""


@query("agg_iteration_row", _iteration_sql())
def agg_iteration_row(spark, sf):
    usage = cost.cost_totals(
        cost.with_cost(responses(spark, sf), PRICES).withColumnRenamed(
            "completion_no", "prompt_iteration"
        ),
        ["prompt_iteration"],
    )
    prompts = F.explode(F.array(F.lit("p_a"), F.lit("p_b"))).alias("prompt_name")
    table = iterate.iteration_rows(
        iterative_facts(spark, sf), RATINGS, LABELS, usage=usage.select("*", prompts)
    )
    return _rounded(table)
