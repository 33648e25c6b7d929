"""Replies kept between runs: each prompt is asked once, and only failures again."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant.operators.replies import REPLY_COLUMNS, Annotator, annotate_batch
from accordant.schema import require_columns

STORED = f"prompt_hash string, completion_no int, {REPLY_COLUMNS}, attempt int"


def prompt_hash(prompt: Column, tag: str) -> Column:
    """What a reply is kept under: the prompt and the settings it was asked with."""
    return F.sha2(F.concat(F.lit(f"{tag}\n"), F.coalesce(prompt, F.lit(""))), 256)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """All attempts so far; none where nothing has been stored."""
    try:
        return spark.read.schema(STORED).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORED)


def latest(attempts: DataFrame) -> DataFrame:
    """One row per prompt and completion: its last attempt, and ``calls`` made in all."""
    fields = [c.split()[0] for c in REPLY_COLUMNS.split(", ")]
    last = F.max_by(F.struct(*fields), "attempt")
    kept = attempts.groupBy("prompt_hash", "completion_no").agg(last.alias("r"), F.max("attempt").alias("calls"))
    return kept.select("prompt_hash", "completion_no", "r.*", "calls")


def annotate_stored(
    df: DataFrame,
    annotator: Annotator,
    store: str,
    n_completions: int = 1,
    prompt: str = "prompt",
    tag: str = "",
    partitions: int | None = None,
) -> DataFrame:
    """Add ``completion_no``, the reply columns and ``calls`` from a store of replies.

    Equal prompts share one call per completion.  Prompts with a good reply in
    ``store`` (a folder all executors reach) are not asked; those never asked or
    failed so far are asked once, spread over ``partitions`` tasks, and what comes
    back is added to the store before anything reads it.  ``tag`` names model and
    settings: replies are not shared between tags.  A null prompt is an empty one.
    """
    require_columns(df, [prompt])
    spark = df.sparkSession
    numbers = F.explode(F.sequence(F.lit(1), F.lit(n_completions))).alias("completion_no")
    asked = df.select(prompt_hash(F.col(prompt), tag).alias("prompt_hash"), F.coalesce(prompt, F.lit("")).alias("prompt"))
    wanted = asked.groupBy("prompt_hash").agg(F.any_value("prompt").alias("prompt")).select("*", numbers)
    known = latest(stored(spark, store)).select("prompt_hash", "completion_no", "calls", F.col("error").isNull().alias("good"))
    open_ = wanted.join(known, ["prompt_hash", "completion_no"], "left").where("good is null or not good")
    # An even number of prompts a task, whatever the join left together.
    open_ = open_.select("prompt_hash", "completion_no", "prompt", (F.coalesce("calls", F.lit(0)) + 1).cast("int").alias("attempt"))
    spread = open_.repartition(partitions or spark.sparkContext.defaultParallelism, "prompt_hash", "completion_no")
    answered = annotate_batch(spread.withColumnRenamed("completion_no", "_no"), annotator, prompt="prompt")
    answered.withColumn("completion_no", F.col("_no")).select([c.split()[0] for c in STORED.split(", ")]).write.mode("append").parquet(store)
    replies = latest(stored(spark, store))
    rows = df.select("*", prompt_hash(F.col(prompt), tag).alias("prompt_hash"), numbers)
    return rows.join(replies, ["prompt_hash", "completion_no"], "left").drop("prompt_hash")
