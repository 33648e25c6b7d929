"""Text columns: cleaning, lists, templates, word counts."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters Python's str.strip removes.
SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Line boundaries other than \n.
OTHER_BREAKS = r"\r\n|[\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def strip(col: Column) -> Column:
    """Trim white space, line breaks included, from both ends."""
    return F.btrim(col, F.lit(SPACE))


@F.pandas_udf(T.StringType())
def _fold_to_ascii(texts: pd.Series) -> pd.Series:
    return texts.map(
        lambda t: unicodedata.normalize("NFKD", t.strip())
        .encode("ascii", "ignore")
        .decode("ascii"),
        na_action="ignore",
    )


def clean_text(col: Column) -> Column:
    """Trim, decompose accents and drop what is not ASCII; null stays null.

    Spark has no Unicode decomposition, so texts with non-ASCII characters visit
    an Arrow function.  Plain ASCII texts are trimmed in the JVM and reach the
    Python worker only as nulls.
    """
    text = col.cast("string")
    foreign = text.rlike(r"[^\x00-\x7F]")
    return F.coalesce(_fold_to_ascii(F.when(foreign, text)), strip(text))


def single_line(col: Column) -> Column:
    """Every line feed or carriage return becomes one space."""
    return F.translate(col, "\n\r", "  ")


def split_list(col: Column, sep: str = ",") -> Column:
    """Trimmed, non-empty elements of a separated list."""
    parts = F.transform(F.split(col, r"\Q" + sep + r"\E", -1), strip)
    return F.filter(parts, lambda x: x != "")


def split_blocks(col: Column, delimiter: str = "---") -> Column:
    """Trimmed, non-empty pieces between occurrences of a literal delimiter."""
    return split_list(col, delimiter)


def word_count(col: Column) -> Column:
    """Number of white-space separated words, the rough token estimate."""
    words = F.split(strip(col), r"\s+")
    return F.size(F.filter(words, lambda w: w != ""))


def plain_value(col: Column, dtype: str) -> Column:
    """Text of a cell; whole floating values print without a fraction."""
    if dtype in ("double", "float"):
        shown = F.when(col == F.floor(col), F.floor(col).cast("string")).otherwise(
            col.cast("string")
        )
    else:
        shown = col.cast("string")
    return F.coalesce(shown, F.lit(""))


def fill_template(template: str, fields: Mapping[str, Column]) -> Column:
    """``str.format`` with column arguments.

    The template is cut on the driver; cell text is only concatenated and never
    scanned for braces.
    """
    pieces: list[Column] = []
    literal = ""
    i = 0
    while i < len(template):
        pair = template[i : i + 2]
        if pair in ("{{", "}}"):
            literal += pair[0]
            i += 2
        elif template[i] == "{":
            end = template.find("}", i)
            name = template[i + 1 : end] if end > 0 else None
            if name not in fields:
                raise ValueError(f"unknown placeholder in template: {template[i:i + 40]}")
            pieces += [F.lit(literal), F.coalesce(fields[name], F.lit(""))]
            literal = ""
            i = end + 1
        elif template[i] == "}":
            raise ValueError("single '}' in template")
        else:
            literal += template[i]
            i += 1
    return F.concat(*pieces, F.lit(literal))


def sample_json(fields: Mapping[str, str], ascii_only: bool = False) -> str:
    """The example object shown at the end of a prompt."""
    return json.dumps(dict(fields), ensure_ascii=ascii_only, indent=2)


def join_names(names: Sequence[str]) -> str:
    return ", ".join(names)
