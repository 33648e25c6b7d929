"""Queries: generated content."""

from __future__ import annotations

from pyspark.sql import functions as F

from accordant.functions import text as X
from accordant.operators import generate, prompts
from accordant.plans.registry import query
from accordant.plans.reply_queries import _FIELD
from accordant.plans.tables import REPLIES_SQL, responses, table
from accordant.session import scratch_path
from accordant.sources import delimited

_PARTS = r"""list_filter(list_transform(string_split(text, '. '), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"""


def _docs(spark, sf):
    return table(spark, sf, "documents")


@query(
    "gen_blueprints",
    f"""WITH p AS (SELECT doc_id, {_PARTS} AS parts FROM documents),
    n AS (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i FROM p)
    SELECT doc_id, CAST(i AS INTEGER) AS blueprint_no, concat('Blueprint_', i) AS blueprint_id, list_extract(parts, i) AS text FROM n""",
)
def gen_blueprints(spark, sf):
    return prompts.blueprint_table(_docs(spark, sf), "doc_id", "text", ". ")


@query(
    "gen_prompts",
    f"""WITH p AS (SELECT doc_id, {_PARTS} AS parts FROM documents)
    SELECT doc_id, concat('**Generation Instructions:**
Write a similar text

', array_to_string(list_transform(parts, lambda b: concat(b, chr(10), chr(10))), ''), '

**IMPORTANT:** Your response must be valid JSON only, containing a single object with the specified columns. Do not include any explanations, greetings, or additional text.

**Example output format:**
{{
  "Title": "A short title",
  "Body": "Your generated Body"
}}') AS prompt FROM p""",
)
def gen_prompts(spark, sf):
    docs = _docs(spark, sf)
    prompt = prompts.generation_prompt(
        X.split_blocks(F.col("text"), ". "),
        "Write a similar text",
        ["Title", "Body"],
        {"Title": "A short title"},
    )
    return docs.select("doc_id", prompt.alias("prompt"))


def _generated(spark, sf):
    """Three replies per document as generated items, with two blueprint columns."""
    sources = _docs(spark, sf).select("doc_id", "text", "lang")
    work = generate.work_list(sources, 3)
    replies = responses(spark, sf).select(
        F.col("item_id").alias("doc_id"), F.col("completion_no").alias("generation_id"), "response_text"
    )
    rows = generate.generated_rows(
        work.join(replies, ["doc_id", "generation_id"], "left"), ["Classification", "Comment"]
    )
    return generate.with_blueprint_columns(rows, X.split_blocks(F.col("text"), ". "), 2)


@query(
    "gen_items",
    f"""WITH {REPLIES_SQL}, p AS (SELECT doc_id, {_PARTS} AS parts FROM documents)
    SELECT p.doc_id, r.completion_no AS generation_id, coalesce({_FIELD}, '') AS "Classification", '' AS "Comment",
    list_extract(parts, 1) AS "Blueprint_1", list_extract(parts, 2) AS "Blueprint_2"
    FROM p JOIN responses r ON r.item_id = p.doc_id""",
)
def gen_items(spark, sf):
    return _generated(spark, sf).drop("text", "lang", "response_text")


@query(
    "gen_annotation_prompt",
    """SELECT doc_id, concat('0: no
1: yes

Example: none

Here is the generated content to annotate:

**lang**: ', coalesce(lang, ''), '
**text**: ', coalesce(text, ''), '


For reference, here are the original correct blueprint examples:

', source, '



**Instructions:**
- Evaluate the generated content according to the codebook and examples.
- Your response should include the following fields: Similar, Valid.
- **Your response must be in JSON format only. Do not include any explanations, greetings, or additional text.**

**Example response format:**
{
  "Similar": "Your annotation for Similar",
  "Valid": "Your annotation for Valid"
}') AS prompt FROM documents""",
)
def gen_annotation_prompt(spark, sf):
    docs = _docs(spark, sf).withColumnRenamed("source", "Blueprint_1")
    prompt = prompts.content_annotation_prompt(
        docs, ["lang", "text"], ["Blueprint_1"], "0: no\n1: yes", "Example: none", ["Similar", "Valid"]
    )
    return docs.select("doc_id", prompt.alias("prompt"))


def _merged(spark, sf):
    every = F.explode(F.sequence(F.lit(1), F.lit(3)))
    rows = _docs(spark, sf).select("doc_id", "lang", every.alias("k")).select((F.col("doc_id") * 4 + F.col("k")).alias("generation_id"), "lang")
    replies = responses(spark, sf).select((F.col("item_id") * 4 + F.col("completion_no")).alias("generation_id"), "response_text")
    return generate.merge_annotations(rows, replies, "generation_id", ["Classification"])


_MERGED_SQL = f"""{REPLIES_SQL}, mg AS (SELECT d.doc_id * 4 + n.k AS generation_id, d.lang, coalesce({_FIELD}, '') AS "Classification", ({_FIELD}) IS NOT NULL AS annotated
 FROM documents d CROSS JOIN (SELECT * FROM (VALUES (1),(2),(3)) AS t(k)) n LEFT JOIN responses r ON r.item_id = d.doc_id AND r.completion_no = n.k)"""


@query("gen_annotate_merge", f"WITH {_MERGED_SQL} SELECT * FROM mg")
def gen_annotate_merge(spark, sf):
    return _merged(spark, sf)


@query(
    "gen_annotation_outcome",
    f"WITH {_MERGED_SQL} SELECT lang, count(*) FILTER (WHERE annotated) AS successful_annotations, count(*) FILTER (WHERE NOT annotated) AS failed_annotations FROM mg GROUP BY lang",
)
def gen_annotation_outcome(spark, sf):
    return generate.annotation_outcome(_merged(spark, sf), ["lang"])


@query(
    "exp_three_views",
    f"""WITH {_MERGED_SQL} SELECT 'annotated_content' AS view_name, generation_id, lang, "Classification" FROM mg
    UNION ALL SELECT 'original_generated', generation_id, lang, NULL FROM mg
    UNION ALL SELECT 'annotations_only', generation_id, NULL, "Classification" FROM mg""",
)
def exp_three_views(spark, sf):
    views = generate.export_views(_merged(spark, sf), ["generation_id", "lang"], ["Classification"])
    paths = delimited.export(views, scratch_path(spark, "export"))
    tables = [
        spark.read.parquet(path).withColumn("view_name", F.lit(name)) for name, path in paths.items()
    ]
    out = tables[0]
    for other in tables[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out
