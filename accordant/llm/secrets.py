"""Secrets in text, told from copied examples by who owns them.

Patterns propose spans; each span's value is hashed, and the corpus is asked how
many owners, and repositories where they are named, hold that hash.  What one
owner holds alone looks live, in however many documents; what many hold was
copied from an example.  All of it is column functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.llm.common import keep

# Kinds in their order, with pattern, group of the secret itself, and its least length.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
# A run that long is the only match worth keeping; shorter ones never reach the least length.
AT_LEAST = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
# What the method adds: provider prefixes, and long mixed tokens that one owner holds alone.
MORE = {
    "provider": r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})",
    "mixed": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{32,}+",
}
KINDS = [*BASE, *MORE]
EXAMPLE = r"(?i)example|sample|dummy|placeholder|changeme|your[_-]|xxxx|(.)\1{7,}"
SPAN = "array<struct<start:int,end:int,kind:string,value:string>>"


def spans_of(text: Column, matches: Column, values: Column, pattern: str, kind: str) -> Column:
    """Spans of all matches of a pattern, from the pieces of text between them."""
    pieces = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast(SPAN).alias("out"))

    def step(acc: Column, part: Column) -> Column:
        begin = acc["at"] + F.length(part["piece"])
        end = begin + F.length(part["match"])
        one = F.struct(begin.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), part["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(F.coalesce(acc["out"], F.array().cast(SPAN)), F.array(one)).alias("out"))

    parts = F.arrays_zip(matches.alias("match"), values.alias("value"), F.slice(pieces, 1, F.size(matches)).alias("piece"))
    return F.aggregate(parts, start, step)["out"]


def long_enough(spans: Column, least: int) -> Column:
    return F.filter(spans, lambda s: F.length(s["value"]) >= least)


def proposed(docs: DataFrame, carried: list[str]) -> DataFrame:
    """Base spans and further candidates of each row's ``text``, by start and kind."""
    found = docs
    for kind in KINDS:
        pattern, group, _ = BASE.get(kind, (MORE.get(kind), 0, 0))
        pattern = AT_LEAST.get(kind, pattern)
        found = found.withColumn(f"m_{kind}", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
        if group:
            some = F.size(f"m_{kind}") > 0
            found = found.withColumn(f"v_{kind}", F.when(some, F.regexp_extract_all("text", F.lit(pattern), F.lit(group))))
    none = F.array().cast(SPAN)
    for kind in KINDS:
        pattern, group, least = BASE.get(kind, (MORE.get(kind), 0, 0))
        pattern = AT_LEAST.get(kind, pattern)
        matches = F.col(f"m_{kind}")
        values = F.col(f"v_{kind}") if group else matches
        spans = spans_of(F.col("text"), matches, values, pattern, kind)
        found = found.withColumn(f"s_{kind}", F.when(F.size(matches) > 0, long_enough(spans, least)).otherwise(none))
    base = F.flatten(F.array(*[F.col(f"s_{k}") for k in BASE]))
    more = F.flatten(F.array(*[F.col(f"s_{k}") for k in MORE]))

    def free(span: Column) -> Column:
        return ~F.exists("base", lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))

    found = found.withColumn("base", base).withColumn("more", more)
    return found.select(*carried, "base", F.when(F.size("more") > 0, F.filter("more", free)).otherwise(none).alias("more"))


def scan(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repository_col: str | None = None,
    most_owners: int = 2,
    most_repositories: int = 20,
) -> DataFrame:
    """Secrets of each document: one row per row, with the spans and what they are.

    ``findings`` lists start, end, kind, value and whether it looks live, in order
    of start and kind; offsets count code points.  A value is live when at most
    ``most_owners`` owners hold it, in the whole table, and it doesn't call itself
    an example.  Where ``repository_col`` names repositories, at most
    ``most_repositories`` of them may hold it too; documents are none, so without
    that column owners alone decide.  Base spans are always listed, live or not;
    further candidates only if live and clear of base spans.

    Null and empty texts have no spans; a null owner counts as one owner;
    repeated rows are each scanned.  Frequencies are summed before they are
    shuffled, so a value in a third of all rows is one row per task.
    """
    owner = F.coalesce(F.col(owner_col).cast("string"), F.lit(""))
    homed = {"home": F.coalesce(F.col(repository_col).cast("string"), F.lit(""))} if repository_col else {}
    plain = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), owner.alias("owner"), *(c.alias(n) for n, c in homed.items()), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).withColumn("row", F.monotonically_increasing_id())
    # One row per document, small: written once, since frequencies and results both need it.
    found = keep(proposed(plain, ["row", "doc_id", "owner", *homed]), "secrets")
    each = found.select("row", "owner", *homed, F.explode(F.concat("base", "more")).alias("span")).withColumn("hash", F.sha2(F.col("span.value").cast("binary"), 256))
    counts = each.select("hash", "owner").distinct().groupBy("hash").agg(F.count("*").alias("owners"))
    few = F.col("owners") <= most_owners
    if homed:
        counts = counts.join(each.select("hash", "home").distinct().groupBy("hash").agg(F.count("*").alias("homes")), "hash")
        few = few & (F.col("homes") <= most_repositories)
    judged = each.select("row", "span", "hash").join(counts, "hash").withColumn("live", few & ~F.col("span.value").rlike(EXAMPLE))
    rank = reduce(lambda col, k: F.when(F.col("span.kind") == k, KINDS.index(k)).otherwise(col), KINDS, F.lit(len(KINDS)))
    base = F.col("span.kind").isin(*BASE)
    listed = judged.where(base | F.col("live")).select(
        "row", F.struct(F.col("span.start").alias("start"), rank.alias("rank"), F.col("span.end").alias("end"), F.col("span.kind").alias("kind"), F.col("span.value").alias("value"), "live").alias("f")
    )
    by_row = listed.groupBy("row").agg(F.sort_array(F.collect_list("f")).alias("findings"))
    none = F.array().cast(dict(by_row.dtypes)["findings"])
    return found.select("row", "doc_id").join(by_row, "row", "left").select("doc_id", F.coalesce("findings", none).alias("findings"))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, the base spans' digest and all spans as text."""

    def name(f: Column) -> Column:
        return F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))

    base = F.filter("findings", lambda f: f["kind"].isin(*BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")

    return scanned.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(F.concat_ws(",", F.transform(base, name)).cast("binary"), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("findings", name)).alias("spans"),
        F.size(F.filter("findings", lambda f: f["live"])).cast("long").alias("n_live"),
    )


def cut_out(text: Column, cuts: Column, mark: str) -> Column:
    """A text with sorted spans replaced; spans that overlap share one mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, cut: Column) -> Column:
        fresh = cut["start"] >= acc["at"]
        before = F.substring(text, acc["at"] + 1, cut["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], cut["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], before, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(cuts, start, step)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]", **options) -> DataFrame:
    """The table with every live secret's span replaced by a mark; all rows and columns stay.

    Copied examples stay as they are.  Every row is cut at its own spans, whatever
    its id, so ``id_col`` is not looked at.  Null texts stay null.
    """
    # Rows are told apart by a number of their own, written down with them.
    numbered = keep(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    found = scan(numbered, id_col="__row", text_col=text_col, **options)
    cuts = F.transform(F.filter("findings", lambda f: f["live"]), lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end")))
    cuts = found.select(F.col("doc_id").alias("__row"), cuts.alias("__cuts")).where(F.size("__cuts") > 0)
    joined = numbered.join(cuts, "__row", "left")
    clean = F.when(F.col("__cuts").isNotNull(), cut_out(F.col(text_col), F.col("__cuts"), mark)).otherwise(F.col(text_col))
    return joined.select(*(clean.alias(c) if c == text_col else F.col(c) for c in docs.columns))
