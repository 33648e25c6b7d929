"""Queries: samples, splits, run grids, concatenation, sorting."""

from __future__ import annotations

from pyspark.sql import functions as F

from accordant.operators import annotate, sampling
from accordant.plans.registry import query
from accordant.plans.tables import FACTS_SQL, facts, items, table

# Large enough to need the block search, small enough for the smallest tables.
SAMPLE, VALIDATION = 700, 300


def mix_sql(key: str, seed: int, use: str) -> str:
    return f"substr(md5(concat({key}, ':{seed}:{use}')), 1, 8)"


@query(
    "smp_exact_n",
    f"SELECT o_orderkey AS item_id, o_orderpriority AS priority FROM orders ORDER BY {mix_sql('o_orderkey', 42, 'sample')}, o_orderkey LIMIT {SAMPLE}",
)
def smp_exact_n(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("item_id"), F.col("o_orderpriority").alias("priority")
    )
    return sampling.exact_sample(orders, "item_id", SAMPLE, 42)


@query(
    "smp_exact_n_text",
    f"SELECT c_name AS item_id, c_nationkey AS nation FROM customer ORDER BY {mix_sql('c_name', 43, 'sample')}, c_name LIMIT 100",
)
def smp_exact_n_text(spark, sf):
    """A text key, and another seed."""
    people = table(spark, sf, "customer").select(F.col("c_name").alias("item_id"), F.col("c_nationkey").alias("nation"))
    return sampling.exact_sample(people, "item_id", 100, 43)


@query(
    "smp_exact_n_other_seed",
    f"SELECT o_orderkey AS item_id, o_orderpriority AS priority FROM orders ORDER BY {mix_sql('o_orderkey', 43, 'sample')}, o_orderkey LIMIT {SAMPLE}",
)
def smp_exact_n_other_seed(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderpriority").alias("priority"))
    return sampling.exact_sample(orders, "item_id", SAMPLE, 43)


@query(
    "smp_train_val",
    f"""SELECT o_orderkey AS item_id, CASE WHEN row_number() OVER (ORDER BY {mix_sql('o_orderkey', 7, 'split')}, o_orderkey) <= {VALIDATION} THEN 'val' ELSE 'train' END AS split FROM orders""",
)
def smp_train_val(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("item_id"))
    return sampling.train_val_split(orders, "item_id", VALIDATION, 7)


@query(
    "smp_runs",
    "SELECT doc_id, lang, run FROM documents CROSS JOIN (VALUES (1), (2), (3)) AS t(run)",
)
def smp_runs(spark, sf):
    return sampling.replicate_runs(table(spark, sf, "documents").select("doc_id", "lang"), 3)


@query(
    "smp_grid",
    """WITH g AS (SELECT 'p_once' AS prompt_name, 1 AS iteration, CAST(NULL AS INTEGER) AS prompt_iteration, r.run, TRUE AS use_validation_set, CAST(NULL AS BOOLEAN) AS is_best_iteration FROM (VALUES (1), (2)) AS r(run)
      UNION ALL SELECT 'p_improve', 1, i.it, r.run, FALSE, i.it = 3 FROM (VALUES (1), (2), (3)) AS i(it) CROSS JOIN (VALUES (1), (2)) AS r(run))
    SELECT doc_id, g.* FROM documents CROSS JOIN g""",
)
def smp_grid(spark, sf):
    scenarios = [
        {"prompt_name": "p_once"},
        {"prompt_name": "p_improve", "max_iterations": 3, "use_validation_set": False},
    ]
    return sampling.scenario_grid(table(spark, sf, "documents").select("doc_id"), scenarios, 2)


@query(
    "set_union_results",
    f"""WITH {FACTS_SQL} SELECT item_id, run, model_pred, CAST(rater_a AS BIGINT) AS rater_a FROM d
    UNION ALL SELECT item_id, 4 AS run, y AS model_pred, CAST(NULL AS BIGINT) AS rater_a FROM items WHERE rater_b IS NULL""",
)
def set_union_results(spark, sf):
    before = facts(spark, sf).select("item_id", "run", "model_pred", "rater_a")
    added = items(spark, sf).where("rater_b IS NULL").select(
        "item_id", F.lit(4).alias("run"), F.col("y").alias("model_pred")
    )
    return before.unionByName(added, allowMissingColumns=True)


@query("srt_queue", "SELECT doc_id, lang, n_chars FROM documents ORDER BY n_chars NULLS LAST, doc_id")
def srt_queue(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return annotate.queue_order(docs, "n_chars", "doc_id")
