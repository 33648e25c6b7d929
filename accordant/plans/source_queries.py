"""Queries: files written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from accordant.plans.registry import query
from accordant.plans.tables import FACTS_SQL, ITEMS_SQL, facts, items, table
from accordant.session import scratch_path
from accordant.sources import delimited
from accordant.sources.config import ProjectConfig


@query("src_csv_roundtrip", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def src_csv_roundtrip(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    path = scratch_path(spark, "documents-csv")
    delimited.write_csv(docs, path)
    return delimited.read_csv(spark, path, schema=docs.schema, multiline=True)


@query(
    "src_encoding_fallback",
    r"SELECT doc_id, lang, regexp_replace(text, '[^\x00-\x{FF}]', '', 'g') AS text FROM documents",
)
def src_encoding_fallback(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"),
        "lang",
        F.regexp_replace("text", r"[^\x00-\xFF]", "").alias("text"),
    )
    folder = scratch_path(spark, "mixed-encodings")
    french = F.col("lang") == "fr"
    delimited.write_csv(docs.where(french), f"{folder}/a", encoding="ISO-8859-1")
    delimited.write_csv(docs.where(~french), f"{folder}/b")
    back = delimited.load_table(spark, f"{folder}/*", delimiter=";", multiline=True)
    return back.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "text")


@query(
    "src_results_split",
    """SELECT text AS "Verbatim", CAST(NULL AS VARCHAR) AS code, 'verbatim' AS part FROM documents
    UNION ALL SELECT NULL, lang, 'coding' FROM documents""",
)
def src_results_split(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("text").alias("Verbatim"), F.col("lang").alias("code"))
    path = scratch_path(spark, "results-csv")
    delimited.write_csv(docs, path, delimiter=",")
    verbatims, coding = delimited.read_results(spark, path, multiline=True)
    return verbatims.withColumn("part", F.lit("verbatim")).unionByName(
        coding.withColumn("part", F.lit("coding")), allowMissingColumns=True
    )


@query(
    "src_results_parquet",
    f"WITH {FACTS_SQL} SELECT prompt_name, iteration, run, item_id, split, model_pred FROM d",
)
def src_results_parquet(spark, sf):
    path = scratch_path(spark, "detailed-results")
    delimited.write_results(facts(spark, sf), path)
    back = spark.read.parquet(path)
    return back.select("prompt_name", "iteration", "run", "item_id", "split", "model_pred")


@query(
    "src_annotated_dataset",
    f"WITH {ITEMS_SQL} SELECT item_id, y, rater_a, rater_b, rater_c FROM items",
)
def src_annotated_dataset(spark, sf):
    """Every row goes out, annotated or not, and comes back with its gaps."""
    rows = items(spark, sf)
    path = scratch_path(spark, "annotated-csv")
    delimited.write_csv(rows, path)
    return delimited.read_csv(spark, path, schema=rows.schema)


_CONFIG = {
    "selected_columns": ["text", "lang"],
    "column_renames": {"text": "answer", "source": "unused"},
    "column_descriptions": {"answer": "The answer", "unused": "Dropped"},
    "text_columns": ["text"],
    "annotation_columns": ["quality"],
    "label_column": "Classification",
    "label_type": "Integer",
}


@query(
    "prep_from_config",
    r"""WITH p AS (SELECT regexp_replace(strip_accents(regexp_replace(d.text, '^\s+|\s+$', '', 'g')), '[^\x00-\x7F]', '', 'g') AS answer, d.lang, l.quality
      FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS NOT NULL)
    SELECT answer, lang, quality, concat('answer: ', answer, chr(10), 'lang: ', lang) AS entry_text FROM p""",
)
def prep_from_config(spark, sf):
    path = scratch_path(spark, "project-config")
    ProjectConfig.from_dict(_CONFIG).save(spark, path)
    config = ProjectConfig.load(spark, path)
    marks = table(spark, sf, "labels").select("doc_id", "quality")
    docs = table(spark, sf, "documents").join(marks, "doc_id", "left")
    return config.entry(config.prepare(docs))
