"""Queries: human accuracy, confusion counts, kappa, classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from accordant.operators import classification, kappa, patterns
from accordant.plans.registry import query
from accordant.schema import with_fact_columns
from accordant.plans.tables import FACTS_SQL, ITEMS_SQL, LABELS, RATERS, RATINGS, facts, items

KEYS = ["prompt_name", "iteration", "run", "split"]

# Majority of three raters, the first one winning ties.
MAJORITY_SQL = """CASE WHEN rater_a IS NOT NULL AND (rater_a = rater_b OR rater_a = rater_c) THEN rater_a
 WHEN rater_b IS NOT NULL AND rater_b = rater_c THEN rater_b ELSE coalesce(rater_a, rater_b, rater_c) END"""

COMPLETE_SQL = (
    FACTS_SQL
    + f""",
lw AS (SELECT *, {MAJORITY_SQL} AS gt FROM d WHERE model_pred IS NOT NULL AND rater_a IS NOT NULL AND rater_b IS NOT NULL AND rater_c IS NOT NULL)"""
)

_PAIRS = (
    [(f"model_vs_{r}", "model_human", "model_pred", r) for r in RATERS]
    + [
        (f"{r}_vs_{s}", "human_human", r, s)
        for i, r in enumerate(RATERS)
        for s in RATERS[i + 1 :]
    ]
    + [("gt_vs_model", "gt_model", "gt", "model_pred")]
    + [(f"gt_vs_{r}", "gt_human", "gt", r) for r in RATERS]
)


def kappa_sql(keys: str, source: str, weight: str) -> str:
    """CTEs ending in ``kap(keys, pair, kind, n_rows, n_equal, kappa)``."""
    union = " UNION ALL ".join(
        f"SELECT {keys}, '{p}' AS pair, '{k}' AS kind, {a} AS a, {b} AS b FROM {source}"
        for p, k, a, b in _PAIRS
    )
    return f"""pr AS ({union}),
cnt AS (SELECT {keys}, pair, kind, a, b, CAST(count(*) AS BIGINT) AS n FROM pr GROUP BY ALL),
tot AS (SELECT {keys}, pair, kind, sum(n) AS n_rows, sum(CASE WHEN a = b THEN n ELSE 0 END) AS n_equal, sum(({weight}) * n) AS o FROM cnt GROUP BY ALL),
rm AS (SELECT {keys}, pair, a, sum(n) AS ra FROM cnt GROUP BY ALL),
cm AS (SELECT {keys}, pair, b, sum(n) AS cb FROM cnt GROUP BY ALL),
ex AS (SELECT {keys}, pair, sum(({weight}) * CAST(ra AS DOUBLE) * CAST(cb AS DOUBLE)) AS e FROM rm JOIN cm USING ({keys}, pair) GROUP BY ALL),
kap AS (SELECT {keys}, pair, kind, CAST(n_rows AS BIGINT) AS n_rows, CAST(n_equal AS BIGINT) AS n_equal, 1 - CAST(o AS DOUBLE) * CAST(n_rows AS DOUBLE) / nullif(e, 0) AS kappa FROM tot JOIN ex USING ({keys}, pair))"""


PLAIN = "CASE WHEN a = b THEN 0 ELSE 1 END"
LINEAR = "abs(a - b)"
QUADRATIC = "(a - b) * (a - b)"
_K = ", ".join(KEYS)


def _model_kappa(weights, sql_weight):
    sql = f"""WITH {COMPLETE_SQL}, {kappa_sql(_K, 'lw', sql_weight)}
    SELECT {_K}, pair, kind, n_rows, round(kappa, 9) AS kappa FROM kap WHERE kind IN ('model_human', 'human_human')"""

    def run(spark, sf):
        table = kappa.pairwise_kappas(facts(spark, sf), RATINGS, LABELS, weights)
        return table.select(*KEYS, "pair", "kind", "n_rows", F.round("kappa", 9).alias("kappa"))

    return sql, run


for _name, _weights, _sql in (
    ("kappa_unweighted", None, PLAIN),
    ("kappa_linear", "linear", LINEAR),
    ("kappa_quadratic", "quadratic", QUADRATIC),
):
    _text, _fn = _model_kappa(_weights, _sql)
    query(_name, _text)(_fn)


@query(
    "kappa_all_pairs",
    f"""WITH {COMPLETE_SQL}, {kappa_sql(_K, 'lw', PLAIN)}
    SELECT {_K}, pair, kind, n_rows, n_equal, round(kappa, 9) AS kappa FROM kap WHERE kind IN ('model_human', 'human_human')""",
)
def kappa_all_pairs(spark, sf):
    table = kappa.pairwise_kappas(facts(spark, sf), RATINGS)
    return table.withColumn("kappa", F.round("kappa", 9))


@query(
    "kappa_means",
    f"""WITH {COMPLETE_SQL}, {kappa_sql(_K, 'lw', QUADRATIC)}
    SELECT {_K}, round(avg(kappa) FILTER (WHERE kind = 'model_human'), 9) AS mean_kappa_llm_human,
    round(avg(kappa) FILTER (WHERE kind = 'human_human'), 9) AS mean_human_human_agreement FROM kap GROUP BY ALL""",
)
def kappa_means(spark, sf):
    per_pair = kappa.pairwise_kappas(facts(spark, sf), RATINGS, LABELS, "quadratic")
    means = kappa.mean_kappas(per_pair, KEYS)
    return means.withColumns(
        {c: F.round(c, 9) for c in ("mean_kappa_llm_human", "mean_human_human_agreement")}
    )


@query(
    "prj_fact_columns",
    f"""WITH {ITEMS_SQL} SELECT item_id, rater_a, rater_b, rater_c, y AS model_pred, 'streamlit_analysis' AS prompt_name, 1 AS iteration, 'train' AS split, 1 AS run FROM items""",
)
def prj_fact_columns(spark, sf):
    """Rated items as a results table: absent scenario columns get their defaults."""
    return with_fact_columns(items(spark, sf), "y").select("item_id", *RATERS, "model_pred", "prompt_name", "iteration", "split", "run")


GRAINS_SQL = """gr AS (SELECT prompt_name, iteration, 'aggregated' AS run, run AS r, split, model_pred, rater_a, rater_b, rater_c, gt FROM lw
  UNION ALL SELECT prompt_name, iteration, CAST(run AS VARCHAR), run, split, model_pred, rater_a, rater_b, rater_c, gt FROM lw)"""


def _summary_sql(per_run: bool) -> str:
    wide = []
    for split, tail in (("train", ""), ("val", "_val")):
        gt = f"FILTER (WHERE split = '{split}' AND pair = 'gt_vs_model')"
        wide += [
            f"CAST(coalesce(max(n_rows) {gt}, 0) AS BIGINT) AS \"N_{split}\"",
            f"round(CAST(max(n_equal) {gt} AS DOUBLE) / max(n_rows) {gt}, 9) AS \"accuracy_GT_{split}\"",
            f"round(max(kappa) {gt}, 9) AS \"kappa_GT_{split}\"",
            f"round(avg(kappa) FILTER (WHERE split = '{split}' AND kind = 'model_human'), 9) AS mean_kappa_llm_human{tail}",
            f"round(avg(kappa) FILTER (WHERE split = '{split}' AND kind = 'human_human'), 9) AS mean_human_human_agreement{tail}",
        ]
        wide += [
            f"round(max(kappa) FILTER (WHERE split = '{split}' AND pair = 'gt_vs_{r}'), 9) AS \"{r}_kappa_GT{tail}\""
            for r in RATERS
        ]
    keep = "" if per_run else "WHERE run = 'aggregated'"
    return f"""WITH {COMPLETE_SQL}, {GRAINS_SQL}, {kappa_sql('prompt_name, iteration, run, split', 'gr', QUADRATIC)},
    w AS (SELECT prompt_name, iteration, run, {', '.join(wide)} FROM kap GROUP BY ALL),
    nr AS (SELECT prompt_name, iteration, run, count(DISTINCT r) AS k FROM gr GROUP BY ALL)
    SELECT w.*, CASE WHEN run = 'aggregated' THEN k END AS n_runs, "N_val" > 0 AS use_validation_set FROM w JOIN nr USING (prompt_name, iteration, run) {keep}"""


def _rounded(df):
    return df.withColumns(
        {f.name: F.round(f.name, 9) for f in df.schema.fields if f.dataType.typeName() == "double"}
    )


@query("kappa_summary", _summary_sql(per_run=False))
def kappa_summary(spark, sf):
    return _rounded(kappa.kappa_summary(facts(spark, sf), RATINGS, LABELS, "quadratic"))


@query("kappa_summary_runs", _summary_sql(per_run=True))
def kappa_summary_runs(spark, sf):
    return _rounded(
        kappa.kappa_summary(facts(spark, sf), RATINGS, LABELS, "quadratic", show_runs=True)
    )


@query(
    "kappa_run_consistency",
    f"""WITH {COMPLETE_SQL}, {kappa_sql('prompt_name, iteration, run', 'lw', LINEAR)},
    pr2 AS (SELECT prompt_name, iteration, run, avg(kappa) FILTER (WHERE kind = 'model_human') AS m, avg(kappa) FILTER (WHERE kind = 'human_human') AS h, max(n_rows) AS s FROM kap GROUP BY ALL)
    SELECT prompt_name, iteration, count(*) AS n_runs, CAST(sum(s) AS BIGINT) AS samples, round(avg(m), 9) AS mean_llm_human, round(stddev_pop(m), 9) AS std_llm_human,
    round(avg(h), 9) AS mean_human_human, round(stddev_pop(h), 9) AS std_human_human FROM pr2 GROUP BY ALL""",
)
def kappa_run_consistency(spark, sf):
    return _rounded(kappa.run_consistency(facts(spark, sf), RATINGS, LABELS, "linear"))


@query(
    "agg_confusion_pairs",
    f"""WITH {COMPLETE_SQL}, {kappa_sql(_K, 'lw', PLAIN)} SELECT {_K}, pair, kind, a, b, n FROM cnt WHERE kind IN ('model_human', 'human_human')""",
)
def agg_confusion_pairs(spark, sf):
    table = patterns.rating_patterns(facts(spark, sf), RATINGS, KEYS, listwise=True)
    return patterns.pair_counts(table, RATINGS, KEYS)


@query(
    "agg_human_accuracy",
    f"""WITH {ITEMS_SQL}, g AS (SELECT *, {MAJORITY_SQL} AS gt FROM items),
    u AS (SELECT 'rater_a' AS rater, rater_a AS v, gt FROM g UNION ALL SELECT 'rater_b', rater_b, gt FROM g UNION ALL SELECT 'rater_c', rater_c, gt FROM g)
    SELECT rater, CAST(count(v) AS BIGINT) AS n_rated, round(CAST(sum(CASE WHEN v = gt THEN 1 ELSE 0 END) AS DOUBLE) / count(v), 9) AS accuracy FROM u GROUP BY rater""",
)
def agg_human_accuracy(spark, sf):
    from accordant.schema import Ratings

    people = Ratings.of(RATERS, model="y")
    return _rounded(classification.human_accuracy(items(spark, sf), people))


def _truth(spark, sf):
    return classification.truth_counts(facts(spark, sf), RATINGS, KEYS)


_LABELS_SQL = "lb AS (SELECT * FROM (VALUES (0), (1), (2), (3)) AS t(label))"
# The label list holds a label nobody gives, which must count as 0.
WIDE_LABELS = [0, 1, 2, 3]


def _class_sql(keys: str, source: str) -> str:
    return f"""{_LABELS_SQL},
cc AS (SELECT {keys}, CAST(label AS BIGINT) AS label,
  sum(CASE WHEN gt = label THEN 1 ELSE 0 END) AS support,
  sum(CASE WHEN gt = label AND model_pred = label THEN 1 ELSE 0 END) AS tp,
  sum(CASE WHEN gt = label AND model_pred <> label THEN 1 ELSE 0 END) AS fn,
  sum(CASE WHEN gt <> label AND model_pred = label THEN 1 ELSE 0 END) AS fp,
  count(*) AS n_rows, sum(CASE WHEN gt = model_pred THEN 1 ELSE 0 END) AS n_equal
  FROM {source} CROSS JOIN lb GROUP BY ALL)"""


_RECALL = "CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END"


@query(
    "cls_accuracy",
    f"""WITH {COMPLETE_SQL} SELECT {_K}, count(*) AS n_rows, round(CAST(sum(CASE WHEN gt = model_pred THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 9) AS accuracy FROM lw GROUP BY ALL""",
)
def cls_accuracy(spark, sf):
    return _rounded(classification.accuracy(facts(spark, sf), RATINGS, KEYS))


@query(
    "cls_distribution",
    f"WITH {COMPLETE_SQL}, {_class_sql(_K, 'lw')} SELECT {_K}, label, CAST(support AS BIGINT) AS n_rows FROM cc",
)
def cls_distribution(spark, sf):
    return classification.class_distribution(_truth(spark, sf), KEYS, WIDE_LABELS)


@query(
    "cls_global",
    f"""WITH {COMPLETE_SQL}, {_class_sql(_K, 'lw')} SELECT {_K}, CAST(max(n_rows) AS BIGINT) AS n_rows, round(CAST(max(n_equal) AS DOUBLE) / max(n_rows), 9) AS accuracy,
    round(avg({_RECALL}), 9) AS recall, round(1 - CAST(max(n_equal) AS DOUBLE) / max(n_rows), 9) AS error_rate FROM cc GROUP BY ALL""",
)
def cls_global(spark, sf):
    return _rounded(classification.global_metrics(_truth(spark, sf), KEYS, WIDE_LABELS))


@query(
    "cls_per_class",
    f"""WITH {COMPLETE_SQL}, {_class_sql(_K, 'lw')} SELECT {_K}, label, round({_RECALL}, 9) AS recall, round(1 - {_RECALL}, 9) AS error_rate,
    CAST(tp AS BIGINT) AS correct_count, CAST(fn AS BIGINT) AS missed_count, CAST(fp AS BIGINT) AS false_positives FROM cc""",
)
def cls_per_class(spark, sf):
    return _rounded(classification.per_class(_truth(spark, sf), KEYS, WIDE_LABELS)).drop("fp_rate")


@query(
    "cls_fp_rate",
    f"""WITH {COMPLETE_SQL}, {_class_sql(_K, 'lw')} SELECT {_K}, label, round(CASE WHEN tp + fp > 0 THEN CAST(fp AS DOUBLE) / (tp + fp) ELSE 0 END, 9) AS fp_rate FROM cc""",
)
def cls_fp_rate(spark, sf):
    return _rounded(
        classification.per_class(_truth(spark, sf), KEYS, WIDE_LABELS).select(*KEYS, "label", "fp_rate")
    )


def _cls_summary_sql(per_run: bool) -> str:
    wide = []
    for split in ("train", "val"):
        here = f"FILTER (WHERE split = '{split}')"
        acc = f"CAST(max(n_equal) {here} AS DOUBLE) / max(n_rows) {here}"
        wide += [
            f"CAST(coalesce(max(n_rows) {here}, 0) AS BIGINT) AS \"N_{split}\"",
            f"round({acc}, 9) AS global_accuracy_{split}",
            f"round(avg({_RECALL}) {here}, 9) AS global_recall_{split}",
            f"round(1 - {acc}, 9) AS global_error_rate_{split}",
        ]
        for label in LABELS:
            at = f"FILTER (WHERE split = '{split}' AND label = {label})"
            wide += [
                f"round(max({_RECALL}) {at}, 9) AS class_{label}_recall_{split}",
                f"round(max(1 - {_RECALL}) {at}, 9) AS class_{label}_error_rate_{split}",
                f"CAST(max(tp) {at} AS BIGINT) AS class_{label}_correct_count_{split}",
                f"CAST(max(fn) {at} AS BIGINT) AS class_{label}_missed_count_{split}",
                f"CAST(max(fp) {at} AS BIGINT) AS class_{label}_false_positives_{split}",
            ]
    keep = "" if per_run else "WHERE run = 'aggregated'"
    body = _class_sql("prompt_name, iteration, run, split", "gr").replace(", (3)", "")
    return f"""WITH {COMPLETE_SQL}, {GRAINS_SQL}, {body},
    w AS (SELECT prompt_name, iteration, run, {', '.join(wide)} FROM cc GROUP BY ALL),
    nr AS (SELECT prompt_name, iteration, run, count(DISTINCT r) AS k FROM gr GROUP BY ALL)
    SELECT w.*, CASE WHEN run = 'aggregated' THEN k END AS n_runs, "N_val" > 0 AS use_validation_set FROM w JOIN nr USING (prompt_name, iteration, run) {keep}"""


@query("cls_summary", _cls_summary_sql(per_run=False))
def cls_summary(spark, sf):
    return _rounded(classification.classification_summary(facts(spark, sf), RATINGS, LABELS))


@query("cls_summary_runs", _cls_summary_sql(per_run=True))
def cls_summary_runs(spark, sf):
    return _rounded(
        classification.classification_summary(facts(spark, sf), RATINGS, LABELS, show_runs=True)
    )
