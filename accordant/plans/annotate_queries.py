"""Queries: manual annotation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from accordant.operators import annotate, label_state
from accordant.plans.registry import query
from accordant.plans.tables import EVENTS_SQL, ITEMS_SQL, items, label_events, table

PEOPLE = ["r0", "r1", "r2"]

_WIDE = ", ".join(
    f"max(label) FILTER (WHERE rater = '{r}') AS \"Rater_{r}\", coalesce(bool_or(invalid) FILTER (WHERE rater = '{r}'), FALSE) AS \"Invalid_{r}\""
    for r in PEOPLE
)


_EVENTS_APPLIED = f"""WITH {EVENTS_SQL},
    last AS (SELECT item_id, rater, label FROM (SELECT *, row_number() OVER (PARTITION BY item_id, rater ORDER BY ts DESC, event_id DESC) AS k FROM ev WHERE label <> '') WHERE k = 1),
    flag AS (SELECT item_id, rater, bool_or(invalid) AS invalid FROM ev GROUP BY ALL),
    st AS (SELECT f.item_id, f.rater, l.label, f.invalid FROM flag f LEFT JOIN last l ON l.item_id = f.item_id AND l.rater = f.rater)
    SELECT d.doc_id AS item_id, {_WIDE} FROM documents d LEFT JOIN st ON st.item_id = d.doc_id GROUP BY d.doc_id"""


@query("ann_apply_events", _EVENTS_APPLIED)
def ann_apply_events(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"))
    return annotate.apply_events(docs, label_events(spark, sf), "item_id", PEOPLE)


@query("ann_apply_increment", _EVENTS_APPLIED)
def ann_apply_increment(spark, sf):
    """The same by three increments, each with events older than some before it."""
    events = label_events(spark, sf)
    parts = [events.where(F.col("event_id") % 3 == i) for i in range(3)]
    labels = label_state.snapshot(parts[0], "item_id")
    for part in parts[1:]:
        labels = label_state.apply_increment(labels, part, "item_id")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"))
    return label_state.apply_snapshot(docs, labels, "item_id", PEOPLE)


@query(
    "ann_unrated_queue",
    f"WITH {ITEMS_SQL} SELECT item_id, rater_b FROM items WHERE rater_a IS NULL AND rater_b IS NOT NULL",
)
def ann_unrated_queue(spark, sf):
    queue = annotate.unrated_queue(items(spark, sf), "rater_a", "item_id", ["rater_b"])
    return queue.select("item_id", "rater_b")


@query(
    "ann_next_unrated",
    f"""WITH {ITEMS_SQL} SELECT item_id, y FROM items WHERE rater_a IS NULL AND rater_b IS NOT NULL AND rater_c IS NOT NULL AND item_id > 100 ORDER BY item_id LIMIT 1""",
)
def ann_next_unrated(spark, sf):
    found = annotate.next_unrated(items(spark, sf), "rater_a", "item_id", 100, ["rater_b", "rater_c"])
    return found.select("item_id", "y")


@query(
    "ann_progress",
    f"""WITH {ITEMS_SQL} SELECT count(*) AS total_in_subset, count(*) FILTER (WHERE rater_a IS NULL) AS remaining_unannotated FROM items WHERE rater_b IS NOT NULL""",
)
def ann_progress(spark, sf):
    return annotate.progress(items(spark, sf), "rater_a", ["rater_b"])
