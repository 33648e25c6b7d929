"""Manual annotation as a table of label events."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordant.schema import require_columns


def rater_column(name: str) -> str:
    return f"Rater_{name}"


def invalid_column(name: str) -> str:
    return f"Invalid_{name}"


def ensure_rater(df: DataFrame, name: str, label_type: str = "string") -> DataFrame:
    """Add an empty label column and a false flag for a new rater."""
    out = df
    if rater_column(name) not in df.columns:
        out = out.withColumn(rater_column(name), F.lit(None).cast(label_type))
    if invalid_column(name) not in df.columns:
        out = out.withColumn(invalid_column(name), F.lit(False))
    return out


def latest_labels(
    events: DataFrame, key: str, raters: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """``key, _label_<rater>, _flag_<rater>``: each rater's newest non-empty label,
    and whether they ever marked the row invalid.

    One aggregation by key, combined map-side, whose partitioning the join with
    the rows reuses.
    """
    columns: list[Column] = []
    for r in raters:
        own = F.col("rater") == r
        said = own & (F.col("label") != "")
        newest = F.max_by(F.when(said, F.col("label")), F.when(said, F.struct(*order)))
        columns += [
            newest.alias(f"_label_{r}"),
            F.bool_or(F.when(own, F.col("invalid"))).alias(f"_flag_{r}"),
        ]
    return events.groupBy(key).agg(*columns)


def apply_events(
    df: DataFrame,
    events: DataFrame,
    key: str,
    raters: Sequence[str],
    order: Sequence[str] = ("ts", "event_id"),
) -> DataFrame:
    """Write label events into the rater columns; rows without events stay.

    An event replaces an earlier label; a row without new label keeps its own.
    """
    out = reduce(ensure_rater, raters, df)
    wide = latest_labels(events.where(F.col("rater").isin(*raters)), key, raters, order)
    joined = out.join(wide, key, "left")
    values: dict[str, Column] = {}
    for r in raters:
        values[rater_column(r)] = F.coalesce(f"_label_{r}", rater_column(r))
        values[invalid_column(r)] = F.coalesce(
            F.col(f"_flag_{r}") | F.col(invalid_column(r)), F.col(invalid_column(r))
        )
    return joined.withColumns(values).drop(*[f"_{p}_{r}" for r in raters for p in ("label", "flag")])


def row_is_valid(names: Sequence[str]) -> Column:
    """True where all chosen annotation columns are filled; true for no columns."""
    return reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names], F.lit(True))


def unrated_queue(
    df: DataFrame, rater: str, order: str, annotation_columns: Sequence[str] = ()
) -> DataFrame:
    """Rows the rater has yet to label, optionally only rows others annotated."""
    require_columns(df, [rater, order, *annotation_columns])
    return df.where(row_is_valid(annotation_columns) & F.col(rater).isNull()).orderBy(order)


def next_unrated(
    df: DataFrame, rater: str, order: str, after: object, annotation_columns: Sequence[str] = ()
) -> DataFrame:
    """The first unrated row after a position."""
    queue = unrated_queue(df, rater, order, annotation_columns)
    return queue.where(F.col(order) > F.lit(after)).limit(1)


def progress(df: DataFrame, rater: str, annotation_columns: Sequence[str] = ()) -> DataFrame:
    """Rows left for a rater, in the chosen subset."""
    require_columns(df, [rater, *annotation_columns])
    inside = row_is_valid(annotation_columns)
    return df.agg(
        F.count_if(inside).alias("total_in_subset"),
        F.count_if(inside & F.col(rater).isNull()).alias("remaining_unannotated"),
    )


def coverage(
    df: DataFrame, results: DataFrame, key: str, raters: Sequence[str]
) -> DataFrame:
    """Total, annotated and unannotated rows, and rows labelled by the model."""
    full = row_is_valid(raters)
    done = results.select(key, F.lit(True).alias("_done")).distinct()
    return (
        df.select(key, full.alias("_full"))
        .join(done, key, "left")
        .agg(
            F.count(F.lit(1)).alias("total_rows"),
            F.count_if("_full").alias("annotated_rows"),
            F.count_if(~F.col("_full")).alias("non_annotated_rows"),
            F.count_if("_done").alias("analyzed_rows"),
        )
        .withColumn("analyzed_share", F.col("analyzed_rows") / F.col("total_rows"))
    )


def queue_order(df: DataFrame, column: str, key: str) -> DataFrame:
    """Rows sorted for display, missing values last."""
    return df.orderBy(F.col(column).asc_nulls_last(), F.col(key))
