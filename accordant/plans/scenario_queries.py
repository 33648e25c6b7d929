"""Queries: detailed results of scenarios."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from accordant.operators import iterate, scenarios
from accordant.plans.agreement_queries import MAJORITY_SQL
from accordant.plans.registry import query
from accordant.plans.sampling_queries import mix_sql
from accordant.plans.tables import table
from accordant.session import scratch_path

_N_SAMPLE, _N_VAL = 150, 40


def length_annotator(prompt: str):
    """Stand-in for a model: labels a text by its number of characters modulo 3."""
    text = prompt.split("Text:\n", 1)[1].rsplit("\n\nAnswer", 1)[0]
    return f'Sure. {{"Classification": {len(text) % 3}, "Reason": "length"}}', (len(prompt), 8)


@query(
    "scn_detailed_results",
    f"""WITH s AS (SELECT doc_id, text FROM documents ORDER BY {mix_sql('doc_id', 42, 'sample')}, doc_id LIMIT {_N_SAMPLE}),
    v AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY {mix_sql('doc_id', 42, 'split')}, doc_id) <= {_N_VAL} THEN 'val' ELSE 'train' END AS split FROM s),
    every AS (SELECT *, 'train' AS split FROM documents)
    SELECT 'p_sample' AS prompt_name, 1 AS iteration, run, split, doc_id, CAST(length(text) % 3 AS BIGINT) AS model_pred, 'length' AS "Reason", TRUE AS use_validation_set FROM v CROSS JOIN (VALUES (1), (2)) AS r(run)
    UNION ALL SELECT 'p_all', 1, run, split, doc_id, CAST(length(text) % 3 AS BIGINT), 'length', FALSE FROM every CROSS JOIN (VALUES (1), (2)) AS r(run)""",
)
def scn_detailed_results(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("verbatim"))
    common = {
        "template": "Text:\n{verbatim_text}",
        "response_template": "Answer as JSON",
        "json_output": True,
        "selected_fields": ("Classification", "Reason"),
        "prefix": "Classification",
    }
    wanted = [
        scenarios.Scenario("p_sample", subsample_size=_N_SAMPLE, validation_size=_N_VAL, **common),
        scenarios.Scenario("p_all", subsample_size="all", use_validation_set=False, **common),
    ]
    out = scenarios.run_scenarios(docs, wanted, "doc_id", [], length_annotator, n_runs=2)
    return out.select(
        "prompt_name", "iteration", "run", "split", "doc_id", "model_pred", "Reason", "use_validation_set"
    )


# --- prompt improvement over text labels ---------------------------------------------------

_ITERATIONS, _TRIAL_VAL = 3, 60
# How often the stand-in errs under each prompt: one text in so many, by length.
_ERRS = (3, 5, 7)
_PROMPTS = ["Label the text.", "Label the text with care.", "Label the text with great care."]


def careful_annotator(prompt: str):
    """Stand-in for a model that errs less, the more carefully it is asked."""
    head, text = prompt.split("\n---\n", 1)
    wrong = len(text) % _ERRS[_PROMPTS.index(head)] == 0
    return f"Label: {('even', 'odd')[(len(text) + wrong) % 2]}", (len(prompt), 3)


def careful_rewriter(prompt: str, examples: list[dict], history: list[dict]):
    """Stand-in for a second model: the next prompt of the list."""
    if not any(e["is_mistake"] for e in examples):
        return None
    return f"{_PROMPTS[len(history)]}\n---\n{{verbatim_text}}", f"change {len(history)}"


_FLIP = "CASE WHEN {when} THEN CASE y WHEN 'odd' THEN 'even' ELSE 'odd' END ELSE y END"
_PEOPLE = {"rater_a": "doc_id % 11 = 0", "rater_b": "doc_id % 13 = 0", "rater_c": "doc_id % 22 = 0"}

_TRIALS_SQL = f"""
b AS (SELECT doc_id, length(text) AS n, CASE WHEN length(text) % 2 = 0 THEN 'even' ELSE 'odd' END AS y FROM documents),
r AS (SELECT *, {', '.join(f'{_FLIP.format(when=w)} AS {name}' for name, w in _PEOPLE.items())},
  CASE WHEN row_number() OVER (ORDER BY {mix_sql('doc_id', 42, 'split')}, doc_id) <= {_TRIAL_VAL} THEN 'val' ELSE 'train' END AS split FROM b),
g AS (SELECT *, {MAJORITY_SQL} AS gt FROM r),
m AS (SELECT g.*, step, CASE WHEN n % errs = 0 THEN CASE y WHEN 'odd' THEN 'even' ELSE 'odd' END ELSE y END AS model_pred
  FROM g CROSS JOIN (VALUES {', '.join(f'({i + 1}, {e})' for i, e in enumerate(_ERRS))}) AS t(step, errs)),
k AS (SELECT step, split, count(*) AS n, sum(CASE WHEN gt = model_pred THEN 1 ELSE 0 END) AS ok, sum(CASE WHEN gt = 'odd' THEN 1 ELSE 0 END) AS g1, sum(CASE WHEN model_pred = 'odd' THEN 1 ELSE 0 END) AS m1,
  {', '.join(f"avg(CASE WHEN {name} = gt THEN 1.0 ELSE 0.0 END) AS {name}" for name in _PEOPLE)} FROM m GROUP BY ALL),
e AS (SELECT *, CAST(ok AS DOUBLE) / n AS accuracy, 1 - (n - ok) * CAST(n AS DOUBLE) / (CAST(g1 AS DOUBLE) * (n - m1) + CAST(n - g1 AS DOUBLE) * m1) AS kappa FROM k),
w AS (SELECT step, {', '.join(f"max({c}) FILTER (WHERE split = '{s}') AS {c}_{s}" for s in ('train', 'val') for c in ('accuracy', 'kappa', *_PEOPLE))} FROM e GROUP BY step),
l AS (SELECT *, lag(accuracy_val) OVER (ORDER BY step) AS before, max(accuracy_val) OVER () AS top FROM w)"""


@query(
    "scn_iterative",
    f"""WITH {_TRIALS_SQL}
    SELECT CAST(step AS INTEGER) AS prompt_iteration, CASE step {' '.join(f"WHEN {i + 1} THEN '{p}'" for i, p in enumerate(_PROMPTS))} END AS prompt,
    CASE step WHEN 1 THEN 'Initial prompt' ELSE concat('change ', step - 1) END AS changes,
    CASE WHEN accuracy_val > before THEN '{iterate.IMPROVED}' WHEN accuracy_val < before THEN '{iterate.DECREASED}' WHEN accuracy_val = before THEN '{iterate.UNCHANGED}' ELSE '{iterate.NOT_APPLICABLE}' END AS effect_of_changes,
    {', '.join(f"round({c}_{s}, 9) AS {c}_{s}" for c in ('accuracy', 'kappa') for s in ('train', 'val'))},
    {', '.join(f"round({c}_{s}, 9) AS {c}_{s}_acc" for c in _PEOPLE for s in ('train', 'val'))}, round(top, 9) AS best_accuracy FROM l""",
)
def scn_iterative(spark, sf):
    """Two iterations, and a third by a run that starts again from their ledger."""
    length = F.length("text")
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("verbatim"), F.when(length % 2 == 0, "even").otherwise("odd").alias("y"))
    docs = docs.select("doc_id", "verbatim", *[F.expr(_FLIP.format(when=w)).alias(name) for name, w in _PEOPLE.items()])
    ledger = scratch_path(spark, "ledger")
    settings = dict(prefix="Label", label_type="Text", subsample_size="all", validation_size=_TRIAL_VAL)
    history, best = [], 0.0
    for most in (2, _ITERATIONS):
        scenario = scenarios.Scenario("p_text", f"{_PROMPTS[0]}\n---\n{{verbatim_text}}", max_iterations=most, **settings)
        _, best, history = scenarios.improve_prompt(
            docs, scenario, "doc_id", list(_PEOPLE), ["even", "odd"], careful_annotator, careful_rewriter, ledger=ledger
        )
    numbers = [f"{c}_{s}" for c in ("accuracy", "kappa") for s in ("train", "val")] + [f"{c}_{s}_acc" for c in _PEOPLE for s in ("train", "val")]
    rows = [(h["prompt_iteration"], re.split("\n---", h["prompt"])[0], h["changes"], h["effect_of_changes"], *(round(h[c], 9) for c in numbers), round(best, 9)) for h in history]
    shape = "prompt_iteration int, prompt string, changes string, effect_of_changes string, " + ", ".join(f"{c} double" for c in [*numbers, "best_accuracy"])
    return spark.createDataFrame(rows, shape)
