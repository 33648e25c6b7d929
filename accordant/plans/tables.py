"""Inputs derived from the test tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant.schema import Ratings

RATINGS = Ratings.of(["rater_a", "rater_b", "rater_c"])
RATERS = list(RATINGS.raters)
LABELS = [0, 1, 2]
SCENARIOS = [(p, 1, r) for p in ("p_a", "p_b") for r in (1, 2, 3)]
PRICES = {"m_small": (0.00015, 0.0006), "m_large": (0.0025, 0.01)}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- rated items and detailed results ---------------------------------------

ITEMS_SQL = """
b AS (SELECT o_orderkey AS item_id, CAST(floor(o_totalprice) AS BIGINT) % 3 AS y FROM orders),
items AS (SELECT item_id, y,
 CASE WHEN (item_id*7919+11)%100 < 8 THEN NULL WHEN (item_id*7919+11)%100 < 22 THEN (y+1)%3 ELSE y END AS rater_a,
 CASE WHEN (item_id*104729+37)%97 < 6 THEN NULL WHEN (item_id*104729+37)%97 < 25 THEN (y+2)%3 ELSE y END AS rater_b,
 CASE WHEN (item_id*15485863+5)%89 < 4 THEN NULL WHEN (item_id*15485863+5)%89 < 20 THEN (y+1)%3 ELSE y END AS rater_c FROM b)"""

FACTS_SQL = (
    ITEMS_SQL
    + """,
s AS (SELECT * FROM (VALUES ('p_a',1,1),('p_a',1,2),('p_a',1,3),('p_b',1,1),('p_b',1,2),('p_b',1,3)) AS t(prompt_name, iteration, run)),
d AS (SELECT s.prompt_name, s.iteration, s.run, r.item_id,
 CASE WHEN r.item_id % 10 < 8 THEN 'train' ELSE 'val' END AS split,
 CASE WHEN (r.item_id*31+s.run*17+CASE WHEN s.prompt_name='p_a' THEN 3 ELSE 50 END)%53 < CASE WHEN s.prompt_name='p_a' THEN 6 ELSE 15 END THEN (r.y+1)%3 ELSE r.y END AS model_pred,
 r.rater_a, r.rater_b, r.rater_c FROM items r CROSS JOIN s)"""
)


def _rater(factor: int, offset: int, modulus: int, gap: int, error: int, shift: int) -> str:
    spot = f"(item_id * {factor} + {offset}) % {modulus}"
    return (
        f"CASE WHEN {spot} < {gap} THEN NULL WHEN {spot} < {error} "
        f"THEN (y + {shift}) % 3 ELSE y END"
    )


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as items with a base label and three raters who miss and err."""
    base = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("item_id"),
        (F.floor("o_totalprice") % 3).alias("y"),
    )
    return base.select(
        "item_id",
        "y",
        F.expr(_rater(7919, 11, 100, 8, 22, 1)).alias("rater_a"),
        F.expr(_rater(104729, 37, 97, 6, 25, 2)).alias("rater_b"),
        F.expr(_rater(15485863, 5, 89, 4, 20, 1)).alias("rater_c"),
    )


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """Detailed results: every item under two prompts and three runs."""
    cells = F.array(
        *[
            F.struct(
                F.lit(p).alias("prompt_name"), F.lit(i).alias("iteration"), F.lit(r).alias("run")
            )
            for p, i, r in SCENARIOS
        ]
    )
    return items(spark, sf).select("*", F.inline(cells)).select(
        "prompt_name",
        "iteration",
        "run",
        "item_id",
        F.expr("CASE WHEN item_id % 10 < 8 THEN 'train' ELSE 'val' END").alias("split"),
        F.expr(
            "CASE WHEN (item_id * 31 + run * 17 + IF(prompt_name = 'p_a', 3, 50)) % 53"
            " < IF(prompt_name = 'p_a', 6, 15) THEN (y + 1) % 3 ELSE y END"
        ).alias("model_pred"),
        *RATERS,
    )


ITERATIVE_SQL = FACTS_SQL + ", it AS (SELECT *, run AS prompt_iteration FROM d)"


def iterative_facts(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows read as prompt iterations."""
    return facts(spark, sf).withColumn("prompt_iteration", F.col("run"))


# --- replies -----------------------------------------------------------------

REPLIES_SQL = """
c AS (SELECT d.doc_id AS item_id, n.k AS completion_no, (d.doc_id + CASE WHEN d.doc_id % 5 = 0 THEN n.k ELSE 0 END) % 3 AS y, d.doc_id % 8 AS v, length(d.text) AS nch
 FROM documents d CROSS JOIN (SELECT * FROM (VALUES (1),(2),(3)) AS t(k)) n),
responses AS (SELECT item_id, completion_no,
 CASE v WHEN 0 THEN concat('{"Reasoning": "ok", "Classification": ', y, '}')
  WHEN 1 THEN concat('```json', chr(10), '{"Reasoning": "ok", "Classification": "', y, '"}', chr(10), '```')
  WHEN 2 THEN concat('Here it is: {"Classification": ', y, ', "Reasoning": "a b"} Thanks')
  WHEN 3 THEN concat('Reasoning: fine', chr(10), 'classification: ', y)
  WHEN 4 THEN concat('Classification - ', y)
  WHEN 5 THEN concat('Options were 0 and 1, final answer ', y % 2)
  WHEN 6 THEN 'no code here'
  ELSE concat('{"Classification": oops} Classification: ', y) END AS response_text,
 100 + nch % 400 AS prompt_tokens, 20 + item_id % 30 AS completion_tokens,
 CASE item_id % 3 WHEN 0 THEN 'm_small' WHEN 1 THEN 'm_large' ELSE 'm_unknown' END AS model
FROM c)"""

_REPLY = r"""CASE v
  WHEN 0 THEN concat('{"Reasoning": "ok", "Classification": ', y, '}')
  WHEN 1 THEN concat('```json', chr(10), '{"Reasoning": "ok", "Classification": "', y, '"}', chr(10), '```')
  WHEN 2 THEN concat('Here it is: {"Classification": ', y, ', "Reasoning": "a b"} Thanks')
  WHEN 3 THEN concat('Reasoning: fine', chr(10), 'classification: ', y)
  WHEN 4 THEN concat('Classification - ', y)
  WHEN 5 THEN concat('Options were 0 and 1, final answer ', y % 2)
  WHEN 6 THEN 'no code here'
  ELSE concat('{"Classification": oops} Classification: ', y) END"""


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """Three replies per document in eight shapes."""
    doc = table(spark, sf, "documents").select(
        F.col("doc_id").alias("item_id"),
        F.length("text").alias("nch"),
        F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])).alias("completion_no"),
    )
    return (
        doc.withColumn("y", F.expr("(item_id + IF(item_id % 5 = 0, completion_no, 0)) % 3"))
        .withColumn("v", F.col("item_id") % 8)
        .select(
            "item_id",
            "completion_no",
            F.expr(_REPLY).alias("response_text"),
            (F.lit(100).cast("bigint") + F.col("nch") % 400).alias("prompt_tokens"),
            (F.lit(20) + F.col("item_id") % 30).alias("completion_tokens"),
            F.expr(
                "CASE item_id % 3 WHEN 0 THEN 'm_small' WHEN 1 THEN 'm_large' ELSE 'm_unknown' END"
            ).alias("model"),
        )
    )


# --- events, blocks, raw labels -----------------------------------------------

EVENTS_SQL = """
ev AS (SELECT event_id, event_id % (SELECT count(*) FROM documents) AS item_id, concat('r', user_id % 3) AS rater, ts,
 CASE WHEN event_type = 'error' THEN '' ELSE CAST(CAST(floor(value) AS BIGINT) % 3 AS VARCHAR) END AS label,
 event_type = 'signup' AS invalid
FROM events)"""


def label_events(spark: SparkSession, sf: str) -> DataFrame:
    """Label events of three people, on items drawn from all documents."""
    items_there = table(spark, sf, "documents").count()
    return table(spark, sf, "events").select(
        "event_id",
        (F.col("event_id") % items_there).alias("item_id"),
        F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string")).alias("rater"),
        "ts",
        F.when(F.col("event_type") == "error", "")
        .otherwise((F.floor("value") % 3).cast("string"))
        .alias("label"),
        (F.col("event_type") == "signup").alias("invalid"),
    )


RAW_SQL = """
raw AS (SELECT o_orderkey AS item_id, CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'nan' WHEN 2 THEN 'x' WHEN 3 THEN concat(o_orderkey % 3, '.0') WHEN 4 THEN 'None' ELSE CAST(o_orderkey % 3 AS VARCHAR) END AS raw_label FROM orders)"""


def raw_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels in seven spellings."""
    key = F.col("o_orderkey")
    digit = (key % 3).cast("string")
    kind = key % 7
    return table(spark, sf, "orders").select(
        key.alias("item_id"),
        F.when(kind == 0, "")
        .when(kind == 1, "nan")
        .when(kind == 2, "x")
        .when(kind == 3, F.concat(digit, F.lit(".0")))
        .when(kind == 4, "None")
        .otherwise(digit)
        .alias("raw_label"),
    )


BLOCKS_SQL = """
kv AS (SELECT doc_id AS item_id, concat('Id: ', doc_id, chr(10), 'Texte: ', replace(text, ':', ''), chr(10), 'Lang: ', lang) AS block FROM documents)"""


def key_value_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as ``Key: value`` blocks."""
    block = F.expr(
        "concat('Id: ', doc_id, chr(10), 'Texte: ', replace(text, ':', ''), chr(10), 'Lang: ', lang)"
    )
    return table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), block.alias("block"))


JUDGED_SQL = """
judged AS (SELECT d.doc_id, d.text AS verbatim, CAST(l.quality AS BIGINT) AS quality, CAST(l.toxic AS BIGINT) AS toxic, d.doc_id % 97 AS group_id
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def judged(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the two labels some of them have."""
    marks = table(spark, sf, "labels").select(
        "doc_id", F.col("quality").cast("bigint"), F.col("toxic").cast("bigint")
    )
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("verbatim"))
    return docs.join(marks, "doc_id", "left").withColumn("group_id", F.col("doc_id") % 97)
