"""Fuzzy duplicate lines across a corpus, by MinHash over character shingles.

Everything here is DataFrame and SQL functions.  Lines with the same normal form
are one node.  A line's shingles are hashed once, as rows, and one aggregate over
those rows gives its signature; bands of it propose pairs of nodes; signatures
drop most of them; and the Jaccard similarity of the whole sets, the very ones
that were signed, decides.  Nodes of a crowded band that are still apart are
joined by the rarest shingles of their sets instead of pair by pair.  The first
line of each component stays.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordant.llm.clusters import cluster
from accordant.llm.common import keep, keep_alone

#: Stand for a null id; an id of this very value shares its documents' fate only if the text is the same too.
NO_ID = -(2**63)
#: Fixed points on the hash circle; the hash nearest to one (by XOR) is a set's minimum there.
POINTS = [(i * 0x9E3779B1 + 0x632BE59B) % 2**31 for i in range(1, 65)]

#: Up to so many nodes of a band are compared pair by pair.
FEW = 16


def normal(line: Column) -> Column:
    return F.lower(F.trim(line))


def shingles(line: Column, width: int) -> Column:
    """The shingles of a line: ``width`` characters from every place that has as many after it."""
    return F.regexp_extract_all(line, F.lit(rf"(?s)(?=(.{{{width}}}))."), F.lit(1))


def minima(lines: DataFrame, width: int, points: list[int]) -> DataFrame:
    """For lines ``h, line`` of at least ``width`` characters: ``h``, the count ``n`` of its lines, a minimum ``m0, m1, ...`` for each of ``points``.

    In bytes (ASCII alone) or in UTF-32, all characters are equally wide, so a
    shingle is cut without reading what stands before it.  A row holds the hashes
    of eight places, so that a minimum is looked up once for eight.
    """
    plain = F.is_valid_utf8("line") & (F.octet_length("line") == F.char_length("line"))
    coded = lines.select("h", plain.alias("plain"), F.when(plain, F.col("line").cast("binary")).otherwise(F.encode("line", "UTF-32")).alias("b"))
    coded = coded.withColumn("last", F.when(F.col("plain"), F.octet_length("b")).otherwise(F.octet_length("b") / 4).cast("int") - width).where("last >= 0")
    places = coded.select("h", "plain", "b", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(8))).alias("at"))

    # Decoded once for the eight places of a row.
    stretch = F.decode(F.substring("b", F.col("at") * 4 + 1, F.lit(4 * (width + 7))), "UTF-32")
    places = places.withColumn("stretch", F.when(~F.col("plain"), stretch))

    def hashed(k: int) -> Column:
        # Past the end the last place is read again, which changes no minimum.
        at = F.least(F.lit(k), F.col("last") - F.col("at"))
        narrow, wide = F.substring("b", F.col("at") + at + 1, F.lit(width)), F.substring("stretch", at + 1, F.lit(width))
        return F.when(F.col("plain"), F.hash(narrow)).otherwise(F.hash(wide)).alias(f"x{k}")

    rows = places.select("h", F.when(F.col("at") == 0, 1).otherwise(0).alias("one"), *(hashed(k) for k in range(8)))
    least = [F.min(F.least(*(F.col(f"x{k}").bitwiseXOR(F.lit(p)) for k in range(8)))).alias(f"m{i}") for i, p in enumerate(points)]
    return rows.groupBy("h").agg(F.sum("one").alias("n"), *least)


def close_pairs(nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of ``nodes`` (``rep, root, s``) that may be similar and have different roots.

    Each set is put in one order, its rarest shingles first.  Sets of m and n
    shingles at the threshold have at least ``percent * (m + n) / (100 + percent)``
    in common, so the first common one stands early in both; the pairs that meet
    there are all that need a check.
    """
    rows = nodes.select("rep", "root", F.size("s").alias("n"), F.explode("s").alias("x"))
    often = rows.groupBy("x").agg(F.count("*").alias("f"), F.min("root").alias("low"), F.max("root").alias("high"))
    often = often.where("f > 1").select("x", "f", (F.col("low") < F.col("high")).alias("mixed"))
    ordered = rows.join(often.hint("merge"), "x", "left").withColumn("i", F.row_number().over(Window.partitionBy("rep").orderBy(F.coalesce("f", F.lit(1)), "x")))
    early = keep(ordered.where("mixed").where(f"100 * (n - i + 1) >= {percent} * n").select("x", "rep", "root", "n", "i"), "early")
    # The smaller set has the smaller share of it to look at.
    one = early.where(f"{100 + percent} * (n - i + 1) >= {2 * percent} * n").select("x", *(F.col(c).alias(f"{c}1") for c in ("rep", "root", "n", "i")))
    two = early.select("x", *(F.col(c).alias(f"{c}2") for c in ("rep", "root", "n", "i")))
    needed = f"{percent} * (n1 + n2)"
    met = one.join(two.hint("merge"), "x").where(
        f"root1 <> root2 AND (n1 < n2 OR n1 = n2 AND rep1 < rep2) AND {100 + percent} * (n1 - i1 + 1) >= {needed} AND {100 + percent} * (n2 - i2 + 1) >= {needed}"
    )
    return met.select(F.least("rep1", "rep2").alias("a"), F.greatest("rep1", "rep2").alias("b")).distinct()


def _binomial(n: int, k: int, p: float) -> float:
    return math.comb(n, k) * p**k * (1 - p) ** (n - k)


def dedup_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 80,
    width: int = 8,
    least_chars: int = 16,
    bands: int = 7,
    rows: int = 3,
) -> DataFrame:
    """The table with repeated lines taken out of ``text_col``; two columns are added.

    ``n_lines`` counts the lines of a text and ``n_removed`` those taken out.  Two
    lines are linked when their normal forms (trimmed, lower case) are equal, or
    the Jaccard similarity of their shingles, see :func:`shingles`, is at least
    ``percent`` hundredths; of a component the line that is first in the table's
    order stays.  Lines of fewer than ``least_chars`` characters and blank ones
    are left alone: brackets, bullets and short answers repeat in clean text.  A
    pair of similarity s shares no band with probability (1 - s**rows)**bands: by
    default 0.7 percent at the threshold, 0.1 percent at 0.85.

    Null texts stay null; of rows that repeat an id and a text one is the first and
    the others lose every line that is compared; rows and all other columns stay,
    but for columns named as the added ones, which are replaced.  ``docs`` is read
    four times, and must give the same rows each time.
    """
    size = bands * rows
    uid = [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text_col).alias("mix")]
    split = docs.select(*uid, F.posexplode(F.split(text_col, "\n")).alias("pos", "raw"))
    split = split.select("doc", "mix", "pos", normal(F.col("raw")).alias("line")).where(F.length("line") >= least_chars)
    split = split.select("doc", "mix", "pos", F.xxhash64("line").alias("h"), "line")
    # Where lines stand is written down; their texts are most of the table, and are cut again the two times they are read.
    lines = keep(split.select("doc", "mix", "pos", "h", F.monotonically_increasing_id().alias("place")), "lines", "zstd")
    classes = lines.groupBy("h").agg(F.min("place").alias("first"), F.count("*").alias("n"))

    texts = split.select("h", "line")

    def shared() -> DataFrame:
        """Signatures and buckets of the nodes that share a bucket."""
        signed = minima(texts, width, POINTS[:size])
        signed = keep(signed.select("h", "n", F.array(*(f"m{i}" for i in range(size))).alias("sig")), "signed")

        band = F.array(*(F.xxhash64(F.lit(b), *(F.col("sig")[b * rows + r] for r in range(rows))) for b in range(bands)))
        buckets = signed.select("h", F.explode(band).alias("key"))
        of_key = Window.partitionBy("key")
        buckets = buckets.select("h", "key", F.min("h").over(of_key).alias("low"), F.max("h").over(of_key).alias("high"))
        keys = keep(buckets.where("low < high").groupBy("h").agg(F.collect_list("key").alias("keys")), "keys")
        return signed.join(keys.hint("merge"), "h")

    def grouped() -> DataFrame:
        # A written table has a known size, by which Spark decides how to join it.
        wanted = keep_alone(docs.sparkSession, "wanted", shared)
        members = keep(wanted.select(F.col("h").alias("rep"), F.explode("keys").alias("key"), "n"), "members")
        found = texts.join(wanted.select("h"), "h", "left_semi").groupBy("h").agg(F.min("line").alias("line"))
        nodes = keep(found.join(wanted.hint("merge"), "h").select("h", "sig", "line"), "nodes", "zstd")
        # Of pairs at the threshold, fewer than one in 10,000 agree in so few places.
        least = next(k for k in range(size, -1, -1) if sum(_binomial(size, j, percent / 100) for j in range(k)) < 1e-4)

        def whole(name: str) -> Column:
            return F.array_distinct(F.transform(shingles(F.col(name), width), lambda s: F.xxhash64(s)))

        def verified(pairs: DataFrame) -> DataFrame:
            def side(name: str, column: str) -> DataFrame:
                return nodes.select(F.col("h").alias(name), F.col(column).alias(f"{column}{name}")).hint("merge")

            near = pairs.join(side("a", "sig"), "a").join(side("b", "sig"), "b")
            agree = F.size(F.filter(F.zip_with("siga", "sigb", lambda x, y: x == y), lambda same: same))
            near = keep(near.where(agree >= least).select("a", "b"), "near")
            both = near.join(side("a", "line"), "a").join(side("b", "line"), "b")
            # An array of one, so that both sets are cut once however often they are read.
            sets = F.array(F.struct(whole("linea").alias("a"), whole("lineb").alias("b")))
            return both.where(F.exists(sets, lambda p: F.size(F.array_intersect(p["a"], p["b"])) * (100 + percent) >= (F.size(p["a"]) + F.size(p["b"])) * percent)).select("a", "b")

        def compared(apart: DataFrame) -> DataFrame:
            few = apart.where(F.col("n") <= FEW)
            one, two = (few.select("key", F.col("rep").alias(c), F.col("root").alias(f"r{c}")) for c in ("a", "b"))
            pairs = one.join(two.hint("merge"), "key").where("ra <> rb AND a < b").select("a", "b")
            crowd = apart.where(F.col("n") > FEW).select("rep", "root").distinct()
            cut = nodes.join(crowd.hint("merge"), F.col("h") == F.col("rep")).select("rep", "root", whole("line").alias("s"))
            return verified(keep(pairs.union(close_pairs(cut, percent)).distinct(), "met"))

        # What stands most often is likely what others of its bucket were made from, and so the nearest to most of them.
        return cluster(members, verified, rounds=1, compare=compared, first=-F.col("n"))

    roots = keep_alone(docs.sparkSession, "roots", grouped).withColumnRenamed("id", "h")
    rooted = classes.select("h", "first", "n").join(roots.hint("merge"), "h", "left").where("n > 1 or root is not null").select("h", "first", F.coalesce("root", "h").alias("root"))
    stays = rooted.groupBy("root").agg(F.min("first").alias("stays"))
    chosen = rooted.select("h", "root").join(stays.hint("merge"), "root").select("h", "stays")
    # Of rows with one id and text, the first keeps the lines that stay in any of them.
    told = lines.select("h", "doc", "mix", "pos", "place").join(chosen.hint("merge"), "h")
    told = told.groupBy("doc", "mix", "pos").agg(F.bool_or(F.col("place") == F.col("stays")).alias("stays"), (F.count("*") > 1).alias("copied"))
    told = told.where("copied or not stays").groupBy("doc", "mix")
    gone = told.agg(F.collect_list(F.when(~F.col("stays"), F.col("pos"))).alias("__first"), F.collect_list("pos").alias("__later"))

    added = ("n_lines", "n_removed")
    kept_names = [c for c in docs.columns if c not in added]
    keyed = docs.select(*kept_names, *(c.alias(f"__{n}") for c, n in zip(uid, ("doc", "mix"))))
    copy = F.row_number().over(Window.partitionBy("__doc", "__mix").orderBy("__doc"))
    gone = gone.select(F.col("doc").alias("__doc"), F.col("mix").alias("__mix"), "__first", "__later")
    joined = keyed.withColumn("__copy", copy).join(gone.hint("merge"), ["__doc", "__mix"], "left")
    joined = joined.withColumn("__gone", F.when(F.col("__copy") > 1, F.col("__later")).otherwise(F.col("__first")))
    parts = F.split(text_col, "\n")
    clean = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("__gone", i)), "\n"))
    return joined.select(
        *(clean.alias(c) if c == text_col else F.col(c) for c in kept_names),
        F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
