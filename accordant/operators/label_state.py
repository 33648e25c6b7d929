"""Label events applied in increments to a snapshot that is never shuffled.

The snapshot has one row per item with the state of each rater: their newest label,
when it was given, and whether they marked the item invalid.  New events are
gathered per item and meet the snapshot bucket by bucket.  States are merged by
the order of events, so late events change nothing they should not.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.operators.annotate import ensure_rater, invalid_column, rater_column
from accordant.sources.buckets import write_bucketed

ORDER = ("ts", "event_id")


def states(events: DataFrame, key: str, order: Sequence[str] = ORDER) -> DataFrame:
    """``key, state``: a map from rater to ``(at, label, invalid)``.

    ``at`` is the place in the order of the newest event with a label.  Many events
    of one item are combined per rater before they are shuffled.
    """
    said = F.col("label") != ""
    place = F.struct(*order)
    newest = F.max(F.when(said, F.struct(place.alias("at"), "label")))
    per_rater = events.groupBy(key, "rater").agg(newest.alias("n"), F.coalesce(F.bool_or("invalid"), F.lit(False)).alias("invalid"))
    entry = F.struct("rater", F.struct(F.col("n.at").alias("at"), F.col("n.label").alias("label"), "invalid"))
    return per_rater.groupBy(key).agg(F.map_from_entries(F.collect_list(entry)).alias("state"))


def merged(old: Column, new: Column) -> Column:
    """Two maps of states as one; a null map is an empty one."""

    def both(_, a: Column, b: Column) -> Column:
        later = a["at"].isNull() | F.coalesce(b["at"] > a["at"], F.lit(False))
        flag = F.coalesce(a["invalid"], F.lit(False)) | F.coalesce(b["invalid"], F.lit(False))
        return F.struct(F.when(later, b["at"]).otherwise(a["at"]).alias("at"), F.when(later, b["label"]).otherwise(a["label"]).alias("label"), flag.alias("invalid"))

    return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(F.map_zip_with(old, new, both))


def snapshot(events: DataFrame, key: str, order: Sequence[str] = ORDER, buckets: int | None = None) -> DataFrame:
    """The first snapshot, in buckets of ``key``."""
    return write_bucketed(states(events, key, order), key, "labels", buckets)


def with_increment(before: DataFrame, events: DataFrame, key: str, order: Sequence[str] = ORDER) -> DataFrame:
    """The snapshot's rows after new events; only the events are shuffled."""
    new = states(events, key, order).withColumnRenamed("state", "_new")
    return before.join(new, key, "full").select(key, merged(F.col("state"), F.col("_new")).alias("state"))


def apply_increment(before: DataFrame, events: DataFrame, key: str, order: Sequence[str] = ORDER, buckets: int | None = None) -> DataFrame:
    """Write the next snapshot, with as many buckets as the one before."""
    return write_bucketed(with_increment(before, events, key, order), key, "labels", buckets)


def apply_snapshot(df: DataFrame, labels: DataFrame, key: str, raters: Sequence[str]) -> DataFrame:
    """Write the snapshot into the rater columns; rows without a state stay.

    A row whose rater gave no label keeps its own, and flags are never taken back.
    """
    out = reduce(ensure_rater, raters, df).join(labels, key, "left")
    values: dict[str, Column] = {}
    for r in raters:
        state = F.col("state")[r]
        own = F.col(invalid_column(r))
        values[rater_column(r)] = F.coalesce(state["label"], rater_column(r))
        values[invalid_column(r)] = F.coalesce(state["invalid"] | own, own)
    return out.withColumns(values).drop("state")
