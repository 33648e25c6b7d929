"""Finding JSON objects in free text by reading it token by token.

A text is cut into lexical tokens, and one pass over them keeps track of strings,
comments and the depth of braces.  Braces, quotes and comment marks thus count
only where JSON means them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Escaped characters, marks that change what follows, and runs of all else.
TOKENS = r'(?s)\\.|"|\{|\}|/\*|\*/|//|#|\n|[^"\\{}/*#\n]+|.'

PROSE, CODE, STRING, BLOCK_COMMENT, LINE_COMMENT = range(5)

_CUT = "struct<a:int,b:int>"
_FOUND = f"array<struct<a:int,b:int,cuts:array<{_CUT}>>>"


def _spans(text: Column) -> Column:
    """Where objects begin and end, with the comments inside of each, as offsets from 0."""

    def step(state: Column, token: Column) -> Column:
        at, mode, depth = state["at"], state["mode"], state["depth"]
        after = at + F.length(token)
        prose, code, line = mode == PROSE, mode == CODE, mode == LINE_COMMENT
        opens = prose & (token == "{")
        closes = code & (token == "}") & (depth == 1)
        comment = code & token.isin("/*", "//", "#")
        block_ends, line_ends = (mode == BLOCK_COMMENT) & (token == "*/"), line & (token == "\n")
        next_mode = (
            F.when(opens | block_ends | line_ends, CODE)
            .when(closes, PROSE)
            .when(code & (token == '"'), STRING)
            .when((mode == STRING) & (token == '"'), CODE)
            .when(code & (token == "/*"), BLOCK_COMMENT)
            .when(comment, LINE_COMMENT)
            .otherwise(mode)
        )
        deeper = F.when(opens, 1).when(code & (token == "{"), depth + 1).when(code & (token == "}"), depth - 1).otherwise(depth)
        cut = F.struct(state["cut"].alias("a"), F.when(line_ends, at).otherwise(after).alias("b"))
        cuts = F.when(opens, F.array().cast(f"array<{_CUT}>")).when(block_ends | line_ends, F.concat(state["cuts"], F.array(cut))).otherwise(state["cuts"])
        whole = F.struct(state["start"].alias("a"), after.alias("b"), state["cuts"].alias("cuts"))
        return F.struct(
            after.cast("int").alias("at"),
            next_mode.cast("int").alias("mode"),
            deeper.cast("int").alias("depth"),
            F.when(opens, at).otherwise(state["start"]).cast("int").alias("start"),
            F.when(comment, at).otherwise(state["cut"]).cast("int").alias("cut"),
            cuts.cast(f"array<{_CUT}>").alias("cuts"),
            F.when(closes, F.concat(state["found"], F.array(whole))).otherwise(state["found"]).cast(_FOUND).alias("found"),
        )

    zero = F.lit(0)
    begin = F.struct(
        zero.alias("at"), F.lit(PROSE).alias("mode"), zero.alias("depth"), zero.alias("start"), zero.alias("cut"),
        F.array().cast(f"array<{_CUT}>").alias("cuts"), F.array().cast(_FOUND).alias("found"),
    )
    return F.aggregate(F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0)), begin, step, lambda s: s["found"])


def objects(text: Column) -> Column:
    """The outermost ``{...}`` of a text in order, without their comments.

    Braces and comment marks inside strings are text.  An object that is not
    closed is left out, and so is what follows it.  Null gives null.
    """

    def piece(a: Column, b: Column) -> Column:
        return F.substring(text, a + 1, b - a)

    def clean(span: Column) -> Column:
        begin = F.struct(span["a"].alias("at"), F.lit("").alias("out"))
        return F.aggregate(
            span["cuts"],
            begin,
            lambda acc, cut: F.struct(cut["b"].alias("at"), F.concat(acc["out"], piece(acc["at"], cut["a"])).alias("out")),
            lambda acc: F.concat(acc["out"], piece(acc["at"], span["b"])),
        )

    return F.transform(_spans(text), clean)
