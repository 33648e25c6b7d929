"""Preparing a table of texts and raters: projections, filters, coercions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accordant.functions import labels as L
from accordant.functions import text as X
from accordant.schema import require_columns

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATING = (T.FloatType, T.DoubleType, T.DecimalType)


def select_rename(df: DataFrame, selected: Sequence[str], renames: Mapping[str, str]) -> DataFrame:
    """Keep the chosen columns in the given order, renamed where asked."""
    require_columns(df, selected)
    return df.select([F.col(f"`{c}`").alias(renames.get(c, c)) for c in selected])


def clean_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """ASCII-fold and trim the named text columns."""
    require_columns(df, names)
    return df.withColumns({n: X.clean_text(F.col(n)) for n in names})


def sanitize(df: DataFrame) -> DataFrame:
    """Replace line breaks by spaces in every text column."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({n: X.single_line(F.col(n)) for n in texts})


def numeric_columns(
    df: DataFrame, names: Sequence[str], nullable: bool = True, on_fraction: str = "error"
) -> DataFrame:
    """Integer labels from whatever the columns hold; absent names are skipped."""
    fixes = {}
    for name in names:
        if name in df.columns:
            value = L.to_integer(F.col(name), on_fraction)
            fixes[name] = value if nullable else F.coalesce(value, F.lit(-1).cast("bigint"))
    return df.withColumns(fixes) if fixes else df


def missing_to_null(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Null for blank spellings, then double."""
    return df.withColumns({n: L.to_number(L.blank_to_null(F.col(n))) for n in names})


def _all_integral(name: str, dtype: T.DataType) -> Column:
    col = F.col(name)
    if isinstance(dtype, _INTEGRAL):
        return F.lit(True)
    if isinstance(dtype, _FLOATING):
        fits = (col == F.floor(col)) & (col != -1)
    else:
        fits = col.cast("string").rlike(L.INTEGER)
    return F.coalesce(F.bool_and(fits), F.lit(True))


def label_types(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(column_name, label_type)``: ``int`` if every present label is integral,
    else ``str``.  One aggregate over the table for all columns."""
    require_columns(df, names)
    one = df.agg(*[_all_integral(n, df.schema[n].dataType).alias(n) for n in names])
    return one.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(n).alias("column_name"),
                        F.when(F.col(n), "int").otherwise("str").alias("label_type"),
                    )
                    for n in names
                ]
            )
        )
    )


def convert_labels(
    df: DataFrame, names: Sequence[str], label_type: str = "auto", unreadable: str = "error"
) -> DataFrame:
    """Labels as bigint (``int``), string (``str``) or whichever fits (``auto``).

    ``auto`` decides per column and needs one aggregate; a given type does not.
    With ``int`` a label that is no whole number is an error, or becomes null if
    ``unreadable`` is ``null``; spellings of a missing cell are null either way.
    """
    if unreadable not in ("error", "null"):
        raise ValueError("unreadable must be error or null")

    def whole(name: str):
        value = F.trim(F.col(name).cast("string"))
        given = value.isNotNull() & ~value.isin(*L.MISSING_TOKENS)
        bad = F.lit(None).cast("bigint")
        if unreadable == "error":
            bad = F.raise_error(F.concat(F.lit("not an integer label: "), value)).cast("bigint")
        number = L.to_integer(F.col(name), "null")
        return F.when(given & number.isNull(), bad).otherwise(number)

    if label_type == "auto":
        kinds = {r["column_name"]: r["label_type"] for r in label_types(df, names).collect()}
    elif label_type in ("int", "str"):
        kinds = dict.fromkeys(names, label_type)
    else:
        return df
    return df.withColumns(
        {
            n: whole(n) if k == "int" else F.col(n).cast("string")
            for n, k in kinds.items()
        }
    )


def cast_labels(df: DataFrame, names: Sequence[str], label_type: str) -> DataFrame:
    """Declared type of rater and label columns: Integer, Float or Text."""
    casts = {
        "Integer": lambda c: L.to_integer(c, "floor"),
        "Float": L.to_number,
        "Text": lambda c: c.cast("string"),
    }
    if label_type not in casts:
        raise ValueError(f"unknown label type: {label_type}")
    return df.withColumns({n: casts[label_type](F.col(n)) for n in names if n in df.columns})


def _all_present(names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names], F.lit(True))


def annotated(df: DataFrame, raters: Sequence[str], allow_missing: bool = False) -> DataFrame:
    """Rows rated by all raters, or by at least one."""
    require_columns(df, raters)
    return df.na.drop("all" if allow_missing else "any", subset=list(raters))


def unlabeled(df: DataFrame, raters: Sequence[str]) -> DataFrame:
    """The complement of :func:`annotated`; the same predicate, so no join."""
    require_columns(df, raters)
    return df.where(~_all_present(raters))


def annotation_counts(df: DataFrame, raters: Sequence[str]) -> DataFrame:
    """Annotated, unannotated and total rows in one pass."""
    full = _all_present(raters)
    return df.agg(
        F.count_if(full).alias("annotated"),
        F.count_if(~full).alias("unannotated"),
        F.count(F.lit(1)).alias("total"),
    )


def remaining(
    df: DataFrame,
    processed: DataFrame,
    key: str,
    keep: Sequence[str] | None = None,
    run: int | None = None,
) -> DataFrame:
    """Rows whose key has no processed result (of the chosen run)."""
    done = processed if run is None else processed.where(F.col("run") == run)
    rest = df.join(done.select(key), key, "left_anti")
    return rest.select(*[c for c in keep if c in df.columns]) if keep else rest


def entry_text(df: DataFrame, names: Sequence[str]) -> Column:
    """``name: value`` lines of the chosen columns, in order."""
    parts: list[Column] = []
    for i, name in enumerate(n for n in names if n in df.columns):
        lead = ("" if i == 0 else "\n") + f"{name}: "
        parts += [F.lit(lead), X.plain_value(F.col(name), df.schema[name].dataType.typeName())]
    return F.concat(*parts) if parts else F.lit("")


def verbatim(df: DataFrame, names: Sequence[str]) -> Column:
    """``name: value`` paragraphs, each followed by a blank line."""
    parts: list[Column] = []
    for name in names:
        parts += [
            F.lit(f"{name}: "),
            X.plain_value(F.col(name), df.schema[name].dataType.typeName()),
            F.lit("\n\n"),
        ]
    return F.concat(*parts)


def label_domain(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Sorted distinct labels over several columns.

    Rows are first reduced to distinct combinations map-side; only those are
    unpivoted.
    """
    combos = df.select(*names).distinct()
    return (
        combos.select(F.explode(F.array(*[F.col(n) for n in names])).alias("label"))
        .where(F.col("label").isNotNull())
        .distinct()
        .orderBy("label")
    )


def listwise(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows where every essential column is present."""
    return df.na.drop("any", subset=list(names))


def head_rows(df: DataFrame, n: int, key: str) -> DataFrame:
    """First n rows by key."""
    return df.orderBy(key).limit(n)


def _compared(df: DataFrame, human: str, model: str, verbatim_col: str, keep: Column) -> DataFrame:
    require_columns(df, [human, model, verbatim_col])
    return df.where(keep).select(
        F.col(verbatim_col).alias("verbatim"),
        F.col(human).alias("human_label"),
        F.col(model).alias("llm1_label"),
    )


def discrepancies(
    df: DataFrame, human: str, model: str = "model_pred", verbatim_col: str = "verbatim"
) -> DataFrame:
    """Rows where model and human differ; a missing label differs from anything."""
    same = F.coalesce(F.col(human) == F.col(model), F.lit(False))
    return _compared(df, human, model, verbatim_col, ~same)


def agreements(
    df: DataFrame, human: str, model: str = "model_pred", verbatim_col: str = "verbatim"
) -> DataFrame:
    """Rows where model and human give the same label."""
    return _compared(df, human, model, verbatim_col, F.col(human) == F.col(model))


def pick_run(df: DataFrame, run: int) -> DataFrame:
    return df.where(F.col("run") == run)


def run_samples(df: DataFrame, keys: Sequence[str] = ("run",)) -> DataFrame:
    """Rows per run."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"))
