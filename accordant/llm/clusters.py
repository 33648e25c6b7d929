"""Components of nodes that share buckets, without listing a bucket's pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.llm.common import keep
from accordant.llm.components import components


def cluster(
    members: DataFrame,
    verified: Callable[[DataFrame], DataFrame],
    *,
    rounds: int = 1,
    leaders: int = 4,
    compare: Callable[[DataFrame], DataFrame] | None = None,
    first: Column | None = None,
) -> DataFrame:
    """Components (``id``, ``root``) of all verified pairs within buckets.

    ``members`` has ``key`` and ``rep``, each pair once; ``verified`` keeps the
    linked ones among pairs ``a < b``.  First everyone meets the bucket's
    smallest node, or the one that is smallest by ``first``, a column over
    ``members`` (of equal ones the smallest node).  Then, in buckets that still hold several components, nodes
    meet some leaders chosen by hash, ``rounds`` times.  What is still apart
    after that is compared in full, so no component is missed; pairs of one
    component need no check.

    ``compare`` does that last turn: it gets ``key, rep, root, n`` (members of
    the bucket) and returns enough links ``a, b`` to join what belongs together.
    Without it, pairs are joined and verified.
    """
    if first is None:
        firsts = members.groupBy("key").agg(F.min("rep").alias("lead"))
    else:
        firsts = members.groupBy("key").agg(F.min(F.struct(first.alias("place"), "rep"))["rep"].alias("lead"))
        members = members.select("key", "rep")
    pairs = members.join(firsts.hint("merge"), "key").where("rep <> lead").select(F.least("lead", "rep").alias("a"), F.greatest("lead", "rep").alias("b")).distinct()
    met = keep(pairs, "met")
    links = keep(verified(met), "linked")
    roots = components(links, "a", "b")
    for turn in range(rounds + 1):
        placed = members.join(roots.withColumnRenamed("id", "rep").hint("merge"), "rep", "left").select("key", "rep", F.coalesce("root", "rep").alias("root"))
        mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low < high").select("key", "n")
        apart = keep(placed.join(mixed.hint("merge"), "key"), "apart")
        if turn == rounds and compare is not None:
            links = links.union(keep(compare(apart), "linked"))
            return components(links, "a", "b")
        one = apart.select("key", F.col("rep").alias("a"), F.col("root").alias("ra"))
        if turn < rounds:
            by_hash = [F.min(F.struct(F.xxhash64(F.lit(turn * leaders + i), "rep"), F.col("rep").alias("b"), F.col("root").alias("rb"))) for i in range(leaders)]
            chosen = apart.groupBy("key").agg(F.array(*by_hash).alias("lead")).select("key", F.explode(F.array_distinct("lead")).alias("lead"))
            two = chosen.select("key", "lead.b", "lead.rb")
        else:
            two = apart.select("key", F.col("rep").alias("b"), F.col("root").alias("rb"))
        unmet = one.join(two.hint("merge"), "key").where("ra <> rb" + (" and a < b" if turn == rounds else ""))
        unmet = unmet.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        unmet = keep(unmet.join(met.hint("merge"), ["a", "b"], "left_anti"), "met")
        met = met.union(unmet)
        links = links.union(keep(verified(unmet), "linked"))
        roots = components(links, "a", "b")
    return roots
