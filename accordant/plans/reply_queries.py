"""Queries: model replies to labels, costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from accordant.functions import text as X
from accordant.operators import cost, replies, reply_store
from accordant.plans.registry import query
from accordant.plans.tables import (
    BLOCKS_SQL,
    JUDGED_SQL,
    PRICES,
    REPLIES_SQL,
    judged,
    key_value_texts,
    responses,
    table,
)
from accordant.session import scratch_path

# The oracles know the eight reply shapes, so simple patterns are enough.
_OBJECT = r"regexp_extract(response_text, '\{[^{}]*\}')"
_FIELD = (
    rf"CASE WHEN json_valid({_OBJECT}) THEN json_extract_string({_OBJECT}, '$.Classification') END"
)
_REASON = rf"CASE WHEN json_valid({_OBJECT}) THEN json_extract_string({_OBJECT}, '$.Reasoning') END"
# The four accepted shapes of a prefixed code.
_PREFIX = (
    r"TRY_CAST(coalesce("
    r"nullif(regexp_extract(response_text, '(?im)\bclassification\s*[:\-]?\s*([+-]?\d+)\s*$', 1), ''),"
    r"nullif(regexp_extract(response_text, '(?i)\"classification\"\s*:\s*\"([+-]?\d+)\"', 1), ''),"
    r"nullif(regexp_extract(response_text, '(?i)\"classification\"\s*:\s*([+-]?\d+)', 1), ''),"
    r"nullif(regexp_extract(response_text, '(?i)\bclassification\s*[:\-]?\s*([+-]?\d+)', 1), '')) AS BIGINT)"
)
_LAST01 = r"list_extract(regexp_extract_all(response_text, '\b[01]\b'), -1)"
_LABEL = f"coalesce({_FIELD}, CAST({_PREFIX} AS VARCHAR), {_LAST01})"


@query(
    "rsp_json_fields",
    f"""WITH {REPLIES_SQL} SELECT item_id, completion_no, {_FIELD} AS "Classification", {_REASON} AS "Reasoning",
    CASE WHEN {_OBJECT} = '' THEN 'no_json' WHEN NOT json_valid({_OBJECT}) THEN 'bad_json' ELSE 'ok' END AS parse_status FROM responses""",
)
def rsp_json_fields(spark, sf):
    parsed = replies.parse_json_fields(responses(spark, sf), ["Classification", "Reasoning"])
    return parsed.select("item_id", "completion_no", "Classification", "Reasoning", "parse_status")


# Replies that a plain pattern cuts in the wrong place: addresses and braces in strings,
# comments, a second object, nested objects, an object that never ends.
_TANGLED = [
    """concat('{"url": "http://a.b/c?x=1#top", "Classification": ', y, '}')""",
    """concat('First {"draft": true} then {"Classification": ', y, '}')""",
    """concat('Reply: {"meta": {"source": {"id": 7}, "Reasoning": "inner"}, "Classification": ', y, ', "Reasoning": "outer"}')""",
    """concat('{"Classification": ', y, ', // chosen from {0, 1, 2}', chr(10), ' "Reasoning": "see http://x/*y*/" /* "Classification": 9 */ }')""",
    """concat('{"Reasoning": "use {x} or ', chr(92), '"}', chr(92), '" # no", "Classification": ', y, ' , }')""",
    """concat('# a heading', chr(10), '{"Classification": ', y, ' # a number', chr(10), '}')""",
    """concat('{"Classification": ', y, ', "Reasoning": "never closed')""",
    """concat('{not json} and {"Classification": ', y, ', "Reasoning": "later"}')""",
]
_TANGLED_CASE = " ".join(f"WHEN {i} THEN {reply}" for i, reply in enumerate(_TANGLED))
_TANGLED_REASON = {2: "outer", 3: "see http://x/*y*/", 4: 'use {x} or "}" # no', 7: "later"}


@query(
    "rsp_json_nested",
    f"""WITH t AS (SELECT doc_id, doc_id % 8 AS v, doc_id % 3 AS y FROM documents)
    SELECT doc_id, CASE WHEN v NOT IN (1, 6) THEN CAST(y AS VARCHAR) END AS "Classification",
    CASE v {' '.join(f"WHEN {i} THEN '{r}'" for i, r in _TANGLED_REASON.items())} END AS "Reasoning",
    CASE WHEN v = 0 THEN 'http://a.b/c?x=1#top' END AS url, CASE WHEN v = 6 THEN 'no_json' ELSE 'ok' END AS parse_status FROM t""",
)
def rsp_json_nested(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 8).alias("v"), (F.col("doc_id") % 3).alias("y"))
    texts = docs.withColumn("response_text", F.expr(f"CASE v {_TANGLED_CASE} END"))
    parsed = replies.parse_json_fields(texts, ["Classification", "Reasoning", "url"])
    return parsed.select("doc_id", "Classification", "Reasoning", "url", "parse_status")


@query(
    "rsp_json_or_block",
    f"""WITH {REPLIES_SQL} SELECT item_id, completion_no, coalesce({_FIELD}, '') AS "Classification", '' AS "Comment" FROM responses""",
)
def rsp_json_or_block(spark, sf):
    parsed = replies.fields_or_blank(responses(spark, sf), ["Classification", "Comment"])
    return parsed.select("item_id", "completion_no", "Classification", "Comment")


@query(
    "rsp_code_prefix",
    f"WITH {REPLIES_SQL} SELECT item_id, completion_no, {_PREFIX} AS code FROM responses",
)
def rsp_code_prefix(spark, sf):
    return responses(spark, sf).select(
        "item_id",
        "completion_no",
        replies.integer_code(F.col("response_text"), "Classification").alias("code"),
    )


@query(
    "rsp_code_first_int",
    rf"WITH {REPLIES_SQL} SELECT item_id, completion_no, TRY_CAST(nullif(regexp_extract(response_text, '[+-]?\d+'), '') AS BIGINT) AS code FROM responses",
)
def rsp_code_first_int(spark, sf):
    return responses(spark, sf).select(
        "item_id", "completion_no", replies.integer_code(F.col("response_text")).alias("code")
    )


@query(
    "rsp_label_chain",
    f"WITH {REPLIES_SQL} SELECT item_id, completion_no, {_LABEL} AS label FROM responses",
)
def rsp_label_chain(spark, sf):
    return responses(spark, sf).select(
        "item_id",
        "completion_no",
        replies.resolve_label(F.col("response_text"), "Classification").alias("label"),
    )


@query(
    "rsp_numeric_label",
    r"""SELECT event_id, TRY_CAST(nullif(regexp_extract(t, '\b\d+\b'), '') AS BIGINT) AS as_integer,
    TRY_CAST(nullif(regexp_extract(t, '[+-]?\b\d+(\.\d+)?\b'), '') AS DOUBLE) AS as_float,
    TRY_CAST(nullif(regexp_extract(t, '\b\d+\b'), '') AS DOUBLE) AS as_float_compat
    FROM (SELECT event_id, concat(event_type, ' scores -', CAST(event_id % 50 AS VARCHAR), CASE WHEN event_id % 3 = 0 THEN '.5' ELSE '' END, ' points') AS t FROM events)""",
)
def rsp_numeric_label(spark, sf):
    n = F.col("event_id")
    tail = F.when(n % 3 == 0, ".5").otherwise("")
    text = F.concat(F.col("event_type"), F.lit(" scores -"), (n % 50).cast("string"), tail, F.lit(" points"))
    return table(spark, sf, "events").select(
        "event_id",
        replies.numeric_label(text, "Integer").alias("as_integer"),
        replies.numeric_label(text, "Float").alias("as_float"),
        replies.numeric_label(text, "Float", compat=True).alias("as_float_compat"),
    )


@query(
    "rsp_numeric_or_text",
    r"""SELECT event_id, coalesce(CAST(TRY_CAST(nullif(regexp_extract(t, '\b\d+\b'), '') AS BIGINT) AS VARCHAR), t) AS as_integer,
    coalesce(nullif(regexp_extract(t, '[+-]?\b\d+\.\d+\b'), ''), nullif(regexp_extract(t, '[+-]?\b\d+\b'), '') || '.0', t) AS as_float
    FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN concat('no number, ', event_type) ELSE concat('scores -', CAST(event_id % 50 + 1 AS VARCHAR), CASE WHEN event_id % 3 = 0 THEN '.5' ELSE '' END, ' points') END AS t FROM events)""",
)
def rsp_numeric_or_text(spark, sf):
    """Replies without a number keep their text."""
    n = F.col("event_id")
    scores = F.concat(F.lit("scores -"), (n % 50 + 1).cast("string"), F.when(n % 3 == 0, ".5").otherwise(""), F.lit(" points"))
    text = F.when(n % 4 == 0, F.concat(F.lit("no number, "), F.col("event_type"))).otherwise(scores)
    return table(spark, sf, "events").select(
        "event_id", replies.numeric_or_text(text, "Integer").alias("as_integer"), replies.numeric_or_text(text, "Float").alias("as_float")
    )


@query(
    "rsp_key_values",
    rf"""WITH {BLOCKS_SQL}
    SELECT d.doc_id AS item_id, 3 AS n_keys, CAST(d.doc_id AS VARCHAR) AS "Id", d.lang AS "Lang",
    regexp_replace(array_to_string(list_transform(string_split(replace(d.text, ':', ''), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), chr(10)), '^\s+|\s+$', '', 'g') AS "Texte"
    FROM documents d JOIN kv ON kv.item_id = d.doc_id""",
)
def rsp_key_values(spark, sf):
    parsed = key_value_texts(spark, sf).select(
        "item_id", replies.key_value_blocks(F.col("block")).alias("fields")
    )
    return parsed.select(
        "item_id",
        F.size("fields").alias("n_keys"),
        *[F.col("fields")[k].alias(k) for k in ("Id", "Lang", "Texte")],
    )


def _labelled(spark, sf):
    label = replies.resolve_label(F.col("response_text"), "Classification")
    return responses(spark, sf).withColumn("label", label.try_cast("bigint"))


_VOTE_SQL = f"""
lab AS (SELECT item_id, completion_no, TRY_CAST({_LABEL} AS BIGINT) AS label FROM responses),
per AS (SELECT item_id, label, count(*) AS n, min(completion_no) AS f FROM lab GROUP BY item_id, label),
vote AS (SELECT item_id, label, n FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, f) AS rk FROM per) WHERE rk = 1)"""


@query(
    "rsp_completion_vote",
    f"WITH {REPLIES_SQL}, {_VOTE_SQL} SELECT v.item_id, v.label, (SELECT count(*) FROM lab l WHERE l.item_id = v.item_id) AS completions FROM vote v",
)
def rsp_completion_vote(spark, sf):
    return replies.completion_vote(_labelled(spark, sf), ["item_id"])


@query(
    "rsp_attach",
    f"""WITH {REPLIES_SQL}, {_VOTE_SQL},
    p AS (SELECT d.text AS verbatim, v.label, d.doc_id FROM documents d JOIN vote v ON v.item_id = d.doc_id WHERE d.lang <> 'de'),
    first AS (SELECT verbatim, label FROM (SELECT *, row_number() OVER (PARTITION BY verbatim ORDER BY doc_id) AS rk FROM p) WHERE rk = 1)
    SELECT d.doc_id AS item_id, f.label AS model_pred, CASE WHEN f.verbatim IS NULL THEN 1 ELSE f.label END AS model_pred_compat
    FROM documents d LEFT JOIN first f ON f.verbatim = d.text""",
)
def rsp_attach(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("item_id"), F.col("text").alias("verbatim"), "lang"
    )
    voted = replies.completion_vote(_labelled(spark, sf), ["item_id"])
    predictions = docs.where("lang <> 'de'").join(voted, "item_id")
    plain = replies.attach_by_verbatim(docs, predictions, order="item_id")
    return replies.attach_by_verbatim(
        plain, predictions, order="item_id", default=1, as_name="model_pred_compat"
    ).select("item_id", "model_pred", "model_pred_compat")


@query(
    "rsp_attach_key",
    f"""WITH {REPLIES_SQL}, {_VOTE_SQL} SELECT d.doc_id AS item_id, v.label AS model_pred FROM documents d LEFT JOIN (SELECT v.* FROM vote v JOIN documents e ON e.doc_id = v.item_id WHERE e.lang <> 'de') v ON v.item_id = d.doc_id""",
)
def rsp_attach_key(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "lang")
    voted = replies.completion_vote(_labelled(spark, sf), ["item_id"])
    predictions = docs.where("lang <> 'de'").join(voted, "item_id")
    return replies.attach_by_key(docs, predictions, "item_id").drop("lang")


def rule_annotator(prompt: str):
    """Stand-in for a model: the label is the parity of the number of words."""
    n = len(prompt.split())
    if n == 0:
        raise ValueError("empty prompt")
    return f'{{"Classification": {n % 2}}}', (n, 5)


@query(
    "rsp_annotate_batch",
    r"""WITH n AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS w FROM documents)
    SELECT doc_id, concat('{"Classification": ', w % 2, '}') AS response_text, CAST(w AS BIGINT) AS prompt_tokens, CAST(5 AS BIGINT) AS completion_tokens, CAST(NULL AS VARCHAR) AS error FROM n""",
)
def rsp_annotate_batch(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("prompt"))
    spread = replies.annotate_batch(docs, rule_annotator, partitions=spark.sparkContext.defaultParallelism)
    return spread.drop("prompt", "completion_no")


def moody_annotator(prompt: str):
    """The stand-in on a bad day: every fifth word count fails."""
    if len(prompt.split()) % 5 == 0:
        raise ValueError("service is busy")
    return rule_annotator(prompt)


@query(
    "rsp_annotate_store",
    r"""WITH n AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS w FROM documents)
    SELECT doc_id, CAST(completion_no AS INTEGER) AS completion_no, concat('{"Classification": ', w % 2, '}') AS response_text, CAST(w AS BIGINT) AS prompt_tokens,
    CAST(5 AS BIGINT) AS completion_tokens, CAST(NULL AS VARCHAR) AS error, CAST(CASE WHEN w % 5 = 0 THEN 2 ELSE 1 END AS INTEGER) AS calls
    FROM n CROSS JOIN (VALUES (1), (2)) AS c(completion_no)""",
)
def rsp_annotate_store(spark, sf):
    """Two runs over one store: the second asks only what failed in the first."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("prompt"))
    store = scratch_path(spark, "reply-store")
    reply_store.annotate_stored(docs, moody_annotator, store, n_completions=2, tag="stand-in")
    return reply_store.annotate_stored(docs, rule_annotator, store, n_completions=2, tag="stand-in").drop("prompt")


@query(
    "rsp_error_rows",
    r"""WITH n AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS w FROM documents)
    SELECT doc_id, CASE WHEN w % 5 <> 0 THEN CAST(w % 2 AS VARCHAR) END AS label, CASE WHEN w % 5 = 0 THEN 'no_json' ELSE 'ok' END AS parse_status,
    CASE WHEN w % 5 = 0 THEN 'service is busy' END AS error FROM n""",
)
def rsp_error_rows(spark, sf):
    """Failing calls keep their row, with a null label and the message."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("prompt"))
    answered = replies.annotate_batch(docs, moody_annotator, partitions=spark.sparkContext.defaultParallelism)
    parsed = replies.parse_json_fields(answered, ["Classification"])
    return parsed.select("doc_id", F.col("Classification").alias("label"), "parse_status", "error")


@query(
    "agg_global_validity",
    f"""WITH {JUDGED_SQL}, g AS (SELECT group_id, min(CASE WHEN coalesce(quality, 0) = 1 THEN 1 ELSE 0 END) AS global_validity FROM judged GROUP BY group_id)
    SELECT j.doc_id, j.group_id, coalesce(j.quality, 0) AS label, g.global_validity FROM judged j JOIN g ON g.group_id = j.group_id""",
)
def agg_global_validity(spark, sf):
    rows = judged(spark, sf).select("doc_id", "group_id", F.col("quality").alias("label"))
    return replies.group_validity(rows, "group_id")


# --- cost ---------------------------------------------------------------------

# The same error-free product as in the operator: halves are decided exactly.
_COSTS = """
x0 AS (SELECT *, CASE model WHEN 'm_small' THEN prompt_tokens * 0.00015::DOUBLE / 1000 + completion_tokens * 0.0006::DOUBLE / 1000
  WHEN 'm_large' THEN prompt_tokens * 0.0025::DOUBLE / 1000 + completion_tokens * 0.01::DOUBLE / 1000
  ELSE (prompt_tokens + completion_tokens) * 0.001::DOUBLE / 1000 END AS x FROM responses),
x1 AS (SELECT *, x * 1e6 AS p, x * 134217729e0 - (x * 134217729e0 - x) AS h FROM x0),
x2 AS (SELECT *, x - h AS t, floor(p) AS w FROM x1),
x3 AS (SELECT *, (p - w - 0.5::DOUBLE) + (((h * 1e6 - p) + h * 0e0 + t * 1e6) + t * 0e0) AS over FROM x2),
costs AS (SELECT *, (w + CASE WHEN over > 0 OR (over = 0 AND CAST(w AS BIGINT) % 2 = 1) THEN 1 ELSE 0 END) / 1e6 AS cost FROM x3)"""


@query(
    "cost_per_row",
    f"WITH {REPLIES_SQL}, {_COSTS} SELECT item_id, completion_no, cost FROM costs",
)
def cost_per_row(spark, sf):
    return cost.with_cost(responses(spark, sf), PRICES).select("item_id", "completion_no", "cost")


@query(
    "cost_totals",
    f"""WITH {REPLIES_SQL}, {_COSTS} SELECT model, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens_used,
    CAST(sum(CAST(round(cost * 1000000) AS BIGINT)) AS DOUBLE) / 1000000 AS total_cost FROM costs GROUP BY model""",
)
def cost_totals(spark, sf):
    return cost.cost_totals(cost.with_cost(responses(spark, sf), PRICES), ["model"])


@query(
    "cost_estimate",
    f"""WITH {REPLIES_SQL}, {_COSTS}, c1 AS (SELECT item_id * 4 + completion_no AS k, cost FROM costs)
    SELECT (SELECT cost FROM c1 ORDER BY k LIMIT 1) AS cost_for_one, count(*) AS n_rows,
    round((SELECT cost FROM c1 ORDER BY k LIMIT 1) * count(*) * 3, 9) AS total_cost_estimate FROM c1""",
)
def cost_estimate(spark, sf):
    every = cost.with_cost(responses(spark, sf), PRICES).withColumn("k", F.col("item_id") * 4 + F.col("completion_no"))
    return cost.estimate(every, "k", n_runs=3).withColumn(
        "total_cost_estimate", F.round("total_cost_estimate", 9)
    )


@query(
    "cost_token_estimate",
    r"""SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS INTEGER) AS tokens FROM documents""",
)
def cost_token_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.word_count(F.col("text")).alias("tokens"))


# Runs of one hour share their time, and are told apart by a run id.
@query(
    "win_cumulative_cost",
    """WITH runs AS (SELECT date_trunc('hour', ts) AS run_ts, user_id % 7 AS run_id, sum(CAST(floor(value) AS BIGINT)) AS micro FROM events GROUP BY ALL)
    SELECT run_ts, run_id, CAST(micro AS DOUBLE) / 1000000 AS total_cost, round(CAST(sum(micro) OVER (ORDER BY run_ts, run_id) AS DOUBLE) / 1000000, 6) AS cumulative_cost FROM runs""",
)
def win_cumulative_cost(spark, sf):
    per_run = [F.date_trunc("hour", "ts").alias("run_ts"), (F.col("user_id") % 7).alias("run_id")]
    runs = table(spark, sf, "events").groupBy(*per_run).agg((F.sum(F.floor("value")) / F.lit(1_000_000.0)).alias("total_cost"))
    return cost.ledger(runs, "run_ts", "run_id").withColumn("cumulative_cost", F.round("cumulative_cost", 6))
