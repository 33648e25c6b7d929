"""Label columns: reading numbers, votes and portable hashing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings of a number, of an integer, and of "missing".
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INTEGER = r"^\s*[+-]?\d+\s*$"
MISSING_TOKENS = ("", " ", "None", "nan", "NaN")



def to_number(col: Column) -> Column:
    """Double, or null where the text is not a number (``'1d'`` is not one)."""
    text = col.cast("string")
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def to_integer(col: Column, on_fraction: str = "error") -> Column:
    """Nullable bigint.  A fractional value is an error unless asked otherwise."""
    number = to_number(col)
    whole = F.floor(number)
    if on_fraction == "floor":
        return whole
    bad = {
        "null": F.lit(None).cast("bigint"),
        "error": F.raise_error(
            F.concat(F.lit("not an integer label: "), col.cast("string"))
        ).cast("bigint"),
    }[on_fraction]
    return F.when(number.isNull() | (number == whole), whole).otherwise(bad)


def blank_to_null(col: Column) -> Column:
    """Null for the spellings of a missing cell."""
    return F.when(~col.isin(*MISSING_TOKENS), col)


def rated(col: Column) -> Column:
    """True where a rating is present: not null and not the empty text."""
    return col.isNotNull() & (col.cast("string") != "")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to a value that is computed once.

    An expression named inside a lambda is otherwise computed per element.
    """
    return F.transform(F.array(value), body)[0]


def present_ratings(cols: Sequence[Column]) -> Column:
    """Array of the ratings that are present, in rater order."""
    return F.filter(F.array(*cols), rated)


def majority_of(values: Column) -> Column:
    """Most frequent element of an array; the earliest one wins a tie."""

    def best(given: Column) -> Column:
        scored = F.transform(
            given,
            lambda x, i: F.struct(
                F.size(F.filter(given, lambda y: y == x)).alias("n"),
                (-i).alias("first"),
                x.alias("value"),
            ),
        )
        return F.array_max(scored)["value"]

    return bind(values, best)


def majority_vote(cols: Sequence[Column]) -> Column:
    """Row-wise majority over rater columns, null when nobody rated."""
    return majority_of(present_ratings(cols))


def mix(key: Column, seed: int, use: str = "") -> Column:
    """Spread a key of any type over ``[0, 2**32)``: the leading digits of an md5.

    ``use`` keeps draws for different ends apart, even under one seed.
    """
    salted = F.concat_ws(":", key.cast("string"), F.lit(str(seed)), F.lit(use))
    return F.when(key.isNotNull(), F.conv(F.substring(F.md5(salted.cast("binary")), 1, 8), 16, 10).cast("bigint"))
