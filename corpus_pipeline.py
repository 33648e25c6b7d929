"""A corpus from raw documents to packed sequences, stage by stage.

Each stage works on all rows the stage before it kept.  All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark import cloudpickle  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import accordant  # noqa: E402
from accordant.llm import line_dedup, near_docs, packing, secrets, toxicity  # noqa: E402
from accordant.llm.common import keep, table  # noqa: E402
from accordant.llm.queries import vocab_path  # noqa: E402

cloudpickle.register_pickle_by_value(accordant)

TOXIC_FROM = 0.3


def _measured(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns of ``docs``, with n_chars of what the text has become."""
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return changed.select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; empty and null texts stay."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.below(docs, model, TOXIC_FROM)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that resemble an earlier one."""
    return _measured(docs, line_dedup.dedup_lines(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, equal rows included, whatever their ids."""
    # Rows are told apart by a number of their own, written down with them.
    numbered = keep(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    gone = near_docs.near_docs(numbered, id_col="__row").where("not kept").select(F.col("doc_id").alias("__row"))
    return numbered.join(gone.hint("merge"), "__row", "left_anti").select(*docs.columns)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live secrets replaced by a mark; copied examples stay."""
    return _measured(docs, secrets.redact(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048."""
    return packing.pack(docs, vocab_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("secrets", hide_secrets),
    ("packing", pack_sequences),
]

#: Neither a trained model nor tokens can be had in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
