"""Queries: preparation, filters, text projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from accordant.functions import labels as L
from accordant.functions import text as X
from accordant.operators import annotate, prep, prompts
from accordant.plans.registry import query
from accordant.plans.tables import (
    FACTS_SQL,
    ITEMS_SQL,
    JUDGED_SQL,
    RATERS,
    RATINGS,
    RAW_SQL,
    facts,
    items,
    judged,
    raw_labels,
    table,
)

_SPACE = r"[\s\x0b\x1c-\x1f]"


@query("prep_select_rename", 'SELECT doc_id AS item_id, text AS verbatim, lang AS "language" FROM documents')
def prep_select_rename(spark, sf):
    return prep.select_rename(
        table(spark, sf, "documents"),
        ["doc_id", "text", "lang"],
        {"doc_id": "item_id", "text": "verbatim", "lang": "language"},
    )


@query(
    "prep_clean_text",
    r"""SELECT doc_id, regexp_replace(strip_accents(regexp_replace(text, '^\s+|\s+$', '', 'g')), '[^\x00-\x7F]', '', 'g') AS text
    FROM documents""",
)
def prep_clean_text(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return prep.clean_columns(docs, ["text"])


@query(
    "prep_sanitize",
    r"""SELECT doc_id, regexp_replace(text, '[\n\r]', ' ', 'g') AS text, regexp_replace(lang, '[\n\r]', ' ', 'g') AS lang,
    regexp_replace(source, '[\n\r]', ' ', 'g') AS source, n_chars FROM documents""",
)
def prep_sanitize(spark, sf):
    return prep.sanitize(table(spark, sf, "documents"))


@query(
    "prep_coerce_int",
    f"""WITH {RAW_SQL}, n AS (SELECT item_id, CASE WHEN regexp_matches(raw_label, '^[0-9]+(\\.[0-9]+)?$')
    THEN CAST(floor(CAST(raw_label AS DOUBLE)) AS BIGINT) END AS v FROM raw)
    SELECT item_id, v AS nullable_label, coalesce(v, -1) AS filled_label FROM n""",
)
def prep_coerce_int(spark, sf):
    raw = raw_labels(spark, sf).select(
        "item_id", F.col("raw_label").alias("nullable_label"), F.col("raw_label").alias("filled_label")
    )
    return prep.numeric_columns(
        prep.numeric_columns(raw, ["nullable_label", "absent"]), ["filled_label"], nullable=False
    )


@query(
    "prep_missing_tokens",
    f"""WITH {RAW_SQL} SELECT item_id, CASE WHEN raw_label IN ('', ' ', 'None', 'nan', 'NaN') THEN NULL
    ELSE TRY_CAST(raw_label AS DOUBLE) END AS label FROM raw""",
)
def prep_missing_tokens(spark, sf):
    raw = raw_labels(spark, sf).withColumnRenamed("raw_label", "label")
    return prep.missing_to_null(raw, ["label"])


@query(
    "prep_label_type",
    f"""WITH {ITEMS_SQL}, {RAW_SQL},
    m AS (SELECT i.item_id, i.rater_a AS whole, CAST(o.o_totalprice AS DOUBLE) AS decimal_value, r.raw_label AS mixed_text, CAST(i.y AS VARCHAR) AS digit_text
      FROM items i JOIN orders o ON o.o_orderkey = i.item_id JOIN raw r ON r.item_id = i.item_id),
    t AS (SELECT 'whole' AS column_name, TRUE AS ok UNION ALL
      SELECT 'decimal_value', bool_and(decimal_value = floor(decimal_value) AND decimal_value <> -1) FROM m UNION ALL
      SELECT 'mixed_text', bool_and(regexp_matches(mixed_text, '^ *[+-]?[0-9]+ *$')) FROM m UNION ALL
      SELECT 'digit_text', bool_and(regexp_matches(digit_text, '^ *[+-]?[0-9]+ *$')) FROM m)
    SELECT column_name, CASE WHEN ok THEN 'int' ELSE 'str' END AS label_type FROM t""",
)
def prep_label_type(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("item_id"), F.col("o_totalprice").alias("decimal_value")
    )
    mixed = raw_labels(spark, sf).withColumnRenamed("raw_label", "mixed_text")
    rows = (
        items(spark, sf)
        .withColumn("whole", F.col("rater_a"))
        .withColumn("digit_text", F.col("y").cast("string"))
        .join(orders, "item_id")
        .join(mixed, "item_id")
    )
    return prep.label_types(rows, ["whole", "decimal_value", "mixed_text", "digit_text"])


@query(
    "prep_convert_labels",
    f"""WITH {ITEMS_SQL} SELECT item_id, y AS as_auto, CAST(y AS VARCHAR) AS as_str, rater_b AS as_int FROM items""",
)
def prep_convert_labels(spark, sf):
    rows = items(spark, sf).select(
        "item_id",
        F.col("y").cast("string").alias("as_auto"),
        F.col("y").alias("as_str"),
        F.col("rater_b").cast("double").alias("as_int"),
    )
    rows = prep.convert_labels(rows, ["as_auto"], "auto")
    return prep.convert_labels(prep.convert_labels(rows, ["as_str"], "str"), ["as_int"], "int")


@query(
    "prep_cast_labels",
    f"""WITH {RAW_SQL}, n AS (SELECT item_id, raw_label, CASE WHEN regexp_matches(raw_label, '^[0-9]+(\\.[0-9]+)?$')
    THEN CAST(raw_label AS DOUBLE) END AS v FROM raw)
    SELECT item_id, CAST(floor(v) AS BIGINT) AS as_integer, v AS as_float, raw_label AS as_text FROM n""",
)
def prep_cast_labels(spark, sf):
    raw = raw_labels(spark, sf)
    rows = raw.select("item_id", *[F.col("raw_label").alias(f"as_{t}") for t in ("integer", "float", "text")])
    for name, kind in (("as_integer", "Integer"), ("as_float", "Float"), ("as_text", "Text")):
        rows = prep.cast_labels(rows, [name], kind)
    return rows


@query(
    "flt_annotated_all",
    f"WITH {ITEMS_SQL} SELECT item_id, rater_a, rater_b, rater_c FROM items WHERE rater_a IS NOT NULL AND rater_b IS NOT NULL AND rater_c IS NOT NULL",
)
def flt_annotated_all(spark, sf):
    return prep.annotated(items(spark, sf), RATERS).drop("y")


@query(
    "flt_annotated_any",
    f"WITH {ITEMS_SQL} SELECT item_id, rater_a, rater_b, rater_c FROM items WHERE rater_a IS NOT NULL OR rater_b IS NOT NULL OR rater_c IS NOT NULL",
)
def flt_annotated_any(spark, sf):
    return prep.annotated(items(spark, sf), RATERS, allow_missing=True).drop("y")


@query(
    "flt_unlabeled",
    f"""WITH {ITEMS_SQL}, lab AS (SELECT item_id FROM items WHERE rater_a IS NOT NULL AND rater_b IS NOT NULL AND rater_c IS NOT NULL)
    SELECT item_id, rater_a, rater_b, rater_c FROM items WHERE item_id NOT IN (SELECT item_id FROM lab)""",
)
def flt_unlabeled(spark, sf):
    return prep.unlabeled(items(spark, sf), RATERS).drop("y")


@query(
    "agg_annotation_counts",
    f"""WITH {ITEMS_SQL}, f AS (SELECT (rater_a IS NOT NULL AND rater_b IS NOT NULL AND rater_c IS NOT NULL) AS ok FROM items)
    SELECT count(*) FILTER (WHERE ok) AS annotated, count(*) FILTER (WHERE NOT ok) AS unannotated, count(*) AS total FROM f""",
)
def agg_annotation_counts(spark, sf):
    return prep.annotation_counts(items(spark, sf), RATERS)


@query(
    "flt_remaining",
    f"""WITH {FACTS_SQL}, done AS (SELECT item_id FROM d WHERE run = 2 AND rater_a IS NOT NULL)
    SELECT item_id, rater_a, rater_c FROM items i WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.item_id = i.item_id)""",
)
def flt_remaining(spark, sf):
    done = facts(spark, sf).where("rater_a IS NOT NULL")
    return prep.remaining(
        items(spark, sf), done, "item_id", keep=["item_id", "rater_a", "rater_c", "other"], run=2
    )


@query(
    "prj_entry_text",
    """SELECT doc_id, concat('doc_id: ', doc_id, chr(10), 'language: ', coalesce(lang, ''), chr(10), 'size: ', CAST(n_chars AS BIGINT), chr(10), 'text: ', coalesce(text, '')) AS entry_text FROM documents""",
)
def prj_entry_text(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", F.col("lang").alias("language"), F.col("n_chars").cast("double").alias("size"), "text"
    )
    return docs.select(
        "doc_id", prep.entry_text(docs, ["doc_id", "language", "size", "text"]).alias("entry_text")
    )


@query(
    "prj_verbatim",
    """SELECT doc_id, concat('lang: ', lang, chr(10), chr(10), 'text: ', text, chr(10), chr(10)) AS verbatim FROM documents""",
)
def prj_verbatim(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", prep.verbatim(docs, ["lang", "text"]).alias("verbatim"))


_PROMPT_SQL = """SELECT doc_id, concat('
You are an assistant that evaluates data entries.

You are provided with data entries in the following format:

The data has the following columns:
- "lang": Language of the text
- "text": The text to judge


Here is an entry to evaluate:

lang: ', lang, chr(10), 'text: ', text, '

0: unsuitable
1: suitable

Text: good. Classification: 1

**Instructions:**

- Evaluate the entry according to the codebook and examples.
- Provide your evaluation in the specified format.

- Your response should include the following fields: Reasoning, Classification.
- **Your response must be in JSON format only. Do not include any explanations, greetings, or additional text.**

**Example response format:**

{
  "Reasoning": "Your text here",
  "Classification": "Your text here"
}

') AS prompt FROM documents"""


@query("prj_prompt", _PROMPT_SQL)
def prj_prompt(spark, sf):
    docs = table(spark, sf, "documents")
    prompt = prompts.annotation_prompt(
        prep.entry_text(docs, ["lang", "text"]),
        {"lang": "Language of the text", "text": "The text to judge"},
        codebook="0: unsuitable\n1: suitable",
        examples="Text: good. Classification: 1",
        fields=["Reasoning", "Classification"],
    )
    return docs.select("doc_id", prompt.alias("prompt"))


@query(
    "prj_template_fill",
    """SELECT doc_id, concat('Classify {strictly} this text:', chr(10), text, chr(10), chr(10), 'Answer as {"Classification": n}') AS prompt FROM documents""",
)
def prj_template_fill(spark, sf):
    docs = table(spark, sf, "documents")
    prompt = prompts.scenario_prompt(
        "Classify {{strictly}} this text:\n{verbatim_text}",
        F.col("text"),
        'Answer as {{"Classification": n}}',
    )
    return docs.select("doc_id", prompt.alias("prompt"))


@query(
    "agg_label_domain",
    f"""WITH {FACTS_SQL} SELECT DISTINCT label FROM (SELECT model_pred AS label FROM d UNION ALL SELECT rater_a FROM d UNION ALL SELECT rater_b FROM d UNION ALL SELECT rater_c FROM d) WHERE label IS NOT NULL""",
)
def agg_label_domain(spark, sf):
    return prep.label_domain(facts(spark, sf), RATINGS.columns)


@query(
    "flt_listwise",
    f"""WITH {FACTS_SQL} SELECT prompt_name, run, item_id FROM d WHERE model_pred IS NOT NULL AND rater_a IS NOT NULL AND rater_b IS NOT NULL AND rater_c IS NOT NULL""",
)
def flt_listwise(spark, sf):
    return prep.listwise(facts(spark, sf), RATINGS.columns).select("prompt_name", "run", "item_id")


@query("lim_head", "SELECT doc_id, lang, text FROM documents ORDER BY doc_id LIMIT 20")
def lim_head(spark, sf):
    return prep.head_rows(table(spark, sf, "documents").select("doc_id", "lang", "text"), 20, "doc_id")


@query(
    "flt_discrepancies",
    f"""WITH {JUDGED_SQL} SELECT verbatim, quality AS human_label, toxic AS llm1_label FROM judged
    WHERE quality IS NULL OR toxic IS NULL OR quality <> toxic""",
)
def flt_discrepancies(spark, sf):
    return prep.discrepancies(judged(spark, sf), "quality", "toxic")


@query(
    "flt_agreements",
    f"WITH {JUDGED_SQL} SELECT verbatim, quality AS human_label, toxic AS llm1_label FROM judged WHERE quality = toxic",
)
def flt_agreements(spark, sf):
    return prep.agreements(judged(spark, sf), "quality", "toxic")


@query(
    "prj_split_list",
    r"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, ','), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS parts FROM documents)
    SELECT doc_id, CAST(len(parts) AS INTEGER) AS n_parts, array_to_string(parts, '|') AS joined FROM p""",
)
def prj_split_list(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", X.split_list(F.col("text")).alias("parts"))
    return docs.select(
        "doc_id", F.size("parts").alias("n_parts"), F.array_join("parts", "|").alias("joined")
    )


@query(
    "agg_run_samples",
    f"WITH {FACTS_SQL} SELECT prompt_name, run, count(*) AS samples FROM d GROUP BY prompt_name, run",
)
def agg_run_samples(spark, sf):
    return prep.run_samples(facts(spark, sf), ["prompt_name", "run"])


@query(
    "flt_pick_run",
    f"WITH {FACTS_SQL} SELECT prompt_name, item_id, split, model_pred FROM d WHERE run = 2",
)
def flt_pick_run(spark, sf):
    return prep.pick_run(facts(spark, sf), 2).select("prompt_name", "item_id", "split", "model_pred")


@query(
    "agg_majority_vote",
    f"""WITH {ITEMS_SQL} SELECT item_id, CASE
      WHEN rater_a IS NOT NULL AND (rater_a = rater_b OR rater_a = rater_c) THEN rater_a
      WHEN rater_b IS NOT NULL AND rater_b = rater_c THEN rater_b
      ELSE coalesce(rater_a, rater_b, rater_c) END AS majority FROM items""",
)
def agg_majority_vote(spark, sf):
    vote = L.majority_vote([F.col(r) for r in RATERS])
    return items(spark, sf).select("item_id", vote.alias("majority"))


@query(
    "agg_coverage",
    f"""WITH {FACTS_SQL}, done AS (SELECT DISTINCT item_id FROM d WHERE rater_a IS NOT NULL),
    j AS (SELECT i.item_id, (rater_a IS NOT NULL AND rater_b IS NOT NULL AND rater_c IS NOT NULL) AS f, done.item_id IS NOT NULL AS a FROM items i LEFT JOIN done ON done.item_id = i.item_id)
    SELECT count(*) AS total_rows, count(*) FILTER (WHERE f) AS annotated_rows, count(*) FILTER (WHERE NOT f) AS non_annotated_rows,
    count(*) FILTER (WHERE a) AS analyzed_rows, round(count(*) FILTER (WHERE a) / count(*), 9) AS analyzed_share FROM j""",
)
def agg_coverage(spark, sf):
    done = facts(spark, sf).where("rater_a IS NOT NULL")
    out = annotate.coverage(items(spark, sf), done, "item_id", RATERS)
    return out.withColumn("analyzed_share", F.round("analyzed_share", 9))
