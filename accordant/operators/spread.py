"""Work over whole groups without holding a group in one task: running sums and tiles of pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordant.session import settle


def running_sums(rows: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Add ``<value>_upto``: the sum over all rows of the group up to this one.

    Rows are sorted over all tasks by ``(keys, order)``.  Each stretch of that
    order is summed by itself, and the sums of the stretches before it, a few rows
    per task, are added.  ``order`` must tell the rows of a group apart; groups of
    any size are spread over tasks.
    """
    keys, order = list(keys), list(order)
    spread = settle(rows.repartitionByRange(*keys, *order).withColumn("_stretch", F.spark_partition_id()))
    here = [*keys, "_stretch"]
    inside = Window.partitionBy(*here).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = spread.groupBy(*here).agg(*[F.sum(v).alias(f"_{v}") for v in values])
    offsets = sums.select(*here, *[F.coalesce(F.sum(f"_{v}").over(earlier), F.lit(0)).alias(f"_{v}_before") for v in values])
    summed = spread.withColumns({f"{v}_upto": F.sum(v).over(inside) for v in values})
    # Every stretch has its offset.  Spark takes kept rows for smaller than they are; of a left join it never broadcasts them.
    joined = match(summed, offsets, here, "left")
    return joined.withColumns({f"{v}_upto": F.col(f"{v}_upto") + F.col(f"_{v}_before") for v in values}).drop("_stretch", *[f"_{v}_before" for v in values])


def match(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns of the same names, null equal to null."""
    same = right.select(*[F.col(c).alias(f"_m_{c}") if c in on else F.col(c) for c in right.columns])
    condition = [F.col(c).eqNullSafe(F.col(f"_m_{c}")) for c in on]
    return left.join(same, condition, how).drop(*[f"_m_{c}" for c in on])


def blocks(rows: DataFrame, keys: Sequence[str], spot: Column, entry: Column, size: int) -> DataFrame:
    """``keys, block, n_blocks, entries``: the rows of each group in arrays of about ``size``.

    ``spot`` decides where a row goes; it must differ among the rows of a group.
    """
    n_rows = rows.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(float(size))).cast("int").alias("n_blocks"))
    dealt = match(rows, n_rows, keys, "left").withColumn("block", F.pmod(F.xxhash64(spot), F.col("n_blocks")).cast("int"))
    return dealt.groupBy(*keys, "block", "n_blocks").agg(F.collect_list(entry).alias("entries"))


def tiles(dealt: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, i, j, left, right``: every two blocks of a group once, ``i <= j``.

    A tile is one row, so a group of any size is spread over as many tasks as it
    has tiles.  The only block of a small group meets itself without a join.
    """
    # Two readers, each of which would otherwise gather the blocks again.
    dealt = settle(dealt)
    plain = [*keys, F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("entries").alias("left"), F.col("entries").alias("right")]
    single = dealt.where("n_blocks = 1").select(*plain)
    many = dealt.where("n_blocks > 1")
    last = F.col("n_blocks") - 1
    rows = many.select(*keys, F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), last)).alias("j"), F.col("entries").alias("left"))
    columns = many.select(*keys, F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"), F.col("block").alias("j"), F.col("entries").alias("right"))
    # A block of no rows has no entry, and its tiles are not there either.
    return single.union(match(rows, columns, [*keys, "i", "j"]).select(*keys, "i", "j", "left", "right"))
