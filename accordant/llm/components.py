"""Connected components of any number of links, by random contraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.llm.common import keep


def components(links: DataFrame, left: str = "src", right: str = "dst") -> DataFrame:
    """The smallest id reachable from each linked id: columns ``id``, ``root``.

    Each round sends every node to the first of its neighbourhood in some order
    and joins the links of what has met.  The first round orders by id, which
    settles stars around their smallest id at once; later rounds order by a hash
    that changes per round, so that chains shrink by a constant share as well.
    Rounds are logarithmic in the longest path, and each is written to the
    shared folder.  Links of an id with itself and links with a null are left out.
    """
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    edges = links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where(a.isNotNull() & b.isNotNull() & (a != b))
    edges = keep(edges.distinct(), "links")
    steps: list[DataFrame] = []
    while edges.count():
        n = len(steps)

        def place(col: str):
            return F.col(col) if n == 0 else F.xxhash64(F.lit(n), F.col(col))

        both = edges.select(F.col("u").alias("id"), F.col("v").alias("other")).union(edges.select("v", "u"))
        near = both.groupBy("id").agg(F.min(F.struct(place("other").alias("place"), F.col("other").alias("to"))).alias("near"))
        own = F.struct(place("id").alias("place"), F.col("id").alias("to"))
        step = keep(near.select("id", F.least(F.col("near"), own)["to"].alias("to")), "step")
        steps.append(step)
        moved = edges.join(step.select(F.col("id").alias("u"), F.col("to").alias("u2")), "u")
        moved = moved.join(step.select(F.col("id").alias("v"), F.col("to").alias("v2")), "v")
        moved = moved.where("u2 <> v2").select(F.least("u2", "v2").alias("u"), F.greatest("u2", "v2").alias("v"))
        edges = keep(moved.distinct(), "links")

    def follow(later: DataFrame, step: DataFrame) -> DataFrame:
        """Where each id of an earlier step ends, given where its target ends."""
        ends = later.select(F.col("id").alias("to"), "last")
        return step.join(ends, "to", "left").select("id", F.coalesce("last", "to").alias("last"))

    if not steps:
        return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    last = steps[-1].select("id", F.col("to").alias("last"))
    last = keep(reduce(follow, reversed(steps[:-1]), last), "ends")
    least = last.groupBy("last").agg(F.min(F.least("id", "last")).alias("root"))
    return keep(last.join(least, "last").select("id", "root"), "roots")
