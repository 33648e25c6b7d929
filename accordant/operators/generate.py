"""Generated content: work lists, parsed rows, annotation merge, export views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.operators.replies import fields_or_blank, reply_object
from accordant.session import settle

GENERATION_ID = "generation_id"


def work_list(sources: DataFrame, n_items: int) -> DataFrame:
    """Each source row n times, numbered 1..n in ``generation_id``."""
    return sources.withColumn(GENERATION_ID, F.explode(F.sequence(F.lit(1), F.lit(n_items))))


def with_blueprint_columns(df: DataFrame, blueprints: Column, count: int) -> DataFrame:
    """Spread an array of blueprint texts over ``Blueprint_1..count``."""
    return df.withColumns(
        {f"Blueprint_{i}": F.try_element_at(blueprints, F.lit(i)) for i in range(1, count + 1)}
    )


def generated_rows(replies: DataFrame, columns: Sequence[str], text: str = "response_text") -> DataFrame:
    """Reply fields as columns, missing ones empty."""
    return fields_or_blank(replies, columns, text)


def merge_annotations(
    rows: DataFrame,
    replies: DataFrame,
    key: str,
    fields: Sequence[str],
    text: str = "response_text",
) -> DataFrame:
    """Rows with their annotation fields; failed rows keep the empty text.

    ``annotated`` tells whether a reply arrived and could be read.
    """
    parsed = replies.select(
        key, reply_object(F.col(text)).alias("_fields")
    ).where(F.col("_fields").isNotNull())
    joined = rows.join(parsed, key, "left")
    return joined.withColumns(
        {f: F.coalesce(F.col("_fields")[f], F.lit("")) for f in fields}
        | {"annotated": F.col("_fields").isNotNull()}
    ).drop("_fields")


def annotation_outcome(merged: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows annotated and rows that failed."""
    return merged.groupBy(*keys).agg(
        F.count_if("annotated").alias("successful_annotations"),
        F.count_if(~F.col("annotated")).alias("failed_annotations"),
    )


def export_views(
    annotated: DataFrame, original_columns: Sequence[str], fields: Sequence[str]
) -> dict[str, DataFrame]:
    """The three tables written at the end: everything, generated part, annotations.

    The annotated table is made once, whichever of them are read.
    """
    annotated = settle(annotated.select(GENERATION_ID, *[c for c in original_columns if c != GENERATION_ID], *fields))
    return {
        "annotated_content": annotated.select(*original_columns, *fields),
        "original_generated": annotated.select(*original_columns),
        "annotations_only": annotated.select(GENERATION_ID, *fields),
    }
