"""Delimited files: reading with encoding fallback, writing, exporting."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accordant.schema import require_columns

FALLBACK_ENCODING = "ISO-8859-1"
VERBATIM = "Verbatim"

_QUOTING = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    delimiter: str = ";",
    schema: T.StructType | str | None = None,
    encoding: str = "UTF-8",
    multiline: bool = False,
) -> DataFrame:
    """Read delimited files.

    Without a schema all columns are text: types are declared, not guessed, and
    no extra pass is made.  Files are split among tasks; those with line breaks
    inside cells need ``multiline``, which reads each by one task (``sanitize``
    takes such breaks out before writing).
    """
    reader = spark.read.options(**_QUOTING).option("sep", delimiter)
    reader = reader.option("encoding", encoding).option("multiLine", multiline)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path)


def write_csv(
    df: DataFrame, path: str, delimiter: str = ";", encoding: str = "UTF-8", mode: str = "errorifexists"
) -> None:
    """Write delimited files, one per partition, without an index column."""
    (
        df.write.mode(mode)
        .options(**_QUOTING)
        .option("quoteAll", "true")
        .option("nullValue", "")
        .option("emptyValue", "")
        .option("sep", delimiter)
        .option("encoding", encoding)
        .csv(path)
    )


def load_table(
    spark: SparkSession, path: str, file_type: str = "csv", delimiter: str = ",", **options
) -> DataFrame:
    """Read a table by type; delimited files with fallback for their encoding."""
    if file_type == "csv":
        return read_any_encoding(spark, path, delimiter, **options)
    if file_type == "parquet":
        return spark.read.parquet(path)
    raise ValueError("unsupported file type: use 'csv' or 'parquet'")


def file_encodings(spark: SparkSession, path: str) -> DataFrame:
    """``file, utf8``: which files below a path are valid UTF-8.

    Lines are checked as raw bytes where they are, so large files are split.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    valid = F.bool_and(F.is_valid_utf8(F.col("value")))
    return lines.groupBy(F.col("_metadata.file_path").alias("file")).agg(valid.alias("utf8"))


def _as_utf8(name: str) -> str:
    """A name read byte by byte, as UTF-8 where that is possible."""
    try:
        return name.encode(FALLBACK_ENCODING).decode("UTF-8")
    except UnicodeError:
        return name


def read_any_encoding(
    spark: SparkSession,
    path: str,
    delimiter: str = ";",
    schema: T.StructType | str | None = None,
    multiline: bool = False,
) -> DataFrame:
    """Read UTF-8 files as such and all others as ISO-8859-1.

    All files are read as ISO-8859-1, which keeps every byte.  The texts of files
    that are valid UTF-8 throughout are then read anew from those bytes.  Which
    files these are stays a table; no list of files is made.
    """
    raw = read_csv(spark, path, delimiter, schema, FALLBACK_ENCODING, multiline)
    if not raw.columns:
        raise ValueError(f"no readable file below {path}")
    columns = [f"c{i}" for i in range(len(raw.columns))]
    rows = raw.select(*[F.col(f"`{n}`").alias(c) for n, c in zip(raw.columns, columns)], F.col("_metadata.file_path").alias("file"))
    told = rows.join(file_encodings(spark, path), "file", "left")

    def text(c: str) -> Column:
        return F.when(F.col("utf8"), F.decode(F.encode(c, FALLBACK_ENCODING), "UTF-8")).otherwise(F.col(c))

    kinds = [f.dataType for f in raw.schema.fields]
    return told.select(
        *[(text(c) if isinstance(kind, T.StringType) else F.col(c)).alias(_as_utf8(name)) for c, name, kind in zip(columns, raw.columns, kinds)]
    )


def read_results(
    spark: SparkSession, path: str, delimiter: str = ",", multiline: bool = False
) -> tuple[DataFrame | None, DataFrame]:
    """Coding results as text: the verbatims, if there are any, and the codes."""
    table = read_csv(spark, path, delimiter, multiline=multiline)
    if not table.columns:
        raise ValueError(f"the file '{path}' is empty or corrupted")
    if VERBATIM not in table.columns:
        return None, table
    return table.select(VERBATIM), table.drop(VERBATIM)


def export(views: Mapping[str, DataFrame], folder: str, file_type: str = "parquet") -> dict[str, str]:
    """Write several views side by side; returns their paths."""
    paths = {}
    for name, view in views.items():
        paths[name] = f"{folder.rstrip('/')}/{name}"
        if file_type == "csv":
            write_csv(view, paths[name])
        else:
            view.write.parquet(paths[name])
    return paths


def write_results(df: DataFrame, path: str) -> None:
    """Detailed results as Parquet, laid out for pruning by scenario and run."""
    keys = ["prompt_name", "iteration", "run"]
    require_columns(df, keys)
    df.write.partitionBy(*keys).parquet(path)
