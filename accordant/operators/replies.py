"""Turning model replies into label columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.functions import labels as L
from accordant.functions import text as X
from accordant.functions.labels import bind
from accordant.operators.scanner import objects
from accordant.session import settle

# Shapes of a flat JSON block and of a dangling comma.
FIRST_BLOCK = r"(?s)\{.*?\}"
DANGLING_COMMA = r",\s*([}\]])"
BINARY_VALUE = r"^\s*\+?0*[01](\.0+)?\s*$|^(true|false)$"
DEFAULT_LABEL_FIELD = "Classification"

_JSON_OPTIONS = {
    "allowSingleQuotes": "false",
    "allowUnquotedFieldNames": "false",
    "allowNonNumericNumbers": "false",
}


def _object(text: Column) -> Column:
    """Map of a text that is one JSON object, else null."""
    shaped = F.when(text.rlike(r"(?s)^\{.*\}$"), text)
    return F.from_json(shaped, "map<string,string>", _JSON_OPTIONS)


def whole_object(text: Column) -> Column:
    """Fields of a reply that is nothing but a JSON object."""
    return _object(X.strip(text))


def block_object(text: Column) -> Column:
    """Fields of the first JSON object inside a reply that can be read.

    A flat block is tried as it is.  Otherwise objects are found by a scan that
    knows strings, comments and nesting; a comma before a closing bracket is let
    pass.
    """
    flat = F.regexp_extract(text, FIRST_BLOCK, 0)

    def read(block: Column) -> Column:
        return F.coalesce(_object(block), _object(F.regexp_replace(block, DANGLING_COMMA, "$1")))

    parsed = F.filter(F.transform(objects(text), read), lambda fields: fields.isNotNull())
    return F.coalesce(_object(flat), F.try_element_at(parsed, F.lit(1)))


def reply_object(text: Column) -> Column:
    """Whole reply as JSON, else the block inside it."""
    return F.coalesce(whole_object(text), block_object(text))


def _validity_ok(fields: Column) -> Column:
    value = fields["Validity"]
    return ~F.map_contains_key(fields, F.lit("Validity")) | F.coalesce(
        value.rlike(BINARY_VALUE), F.lit(False)
    )


def parse_json_fields(
    df: DataFrame, fields: Sequence[str], text: str = "response_text"
) -> DataFrame:
    """Add one column per field and ``parse_status``.

    Replies that do not parse stay in the table with null fields; the status says
    why: ``no_json``, ``bad_json`` or ``bad_validity``.
    """
    parsed = df.withColumn("_fields", reply_object(F.col(text)))
    good = F.col("_fields").isNotNull() & _validity_ok(F.col("_fields"))
    status = (
        F.when(F.col("_fields").isNull() & ~F.col(text).rlike(FIRST_BLOCK), "no_json")
        .when(F.col("_fields").isNull(), "bad_json")
        .when(~_validity_ok(F.col("_fields")), "bad_validity")
        .otherwise("ok")
    )
    return parsed.withColumns(
        {f: F.when(good, F.col("_fields")[f]) for f in fields}
        | {"parse_status": F.when(F.col(text).isNull(), "no_json").otherwise(status)}
    ).drop("_fields")


def fields_or_blank(
    df: DataFrame, fields: Sequence[str], text: str = "response_text"
) -> DataFrame:
    """Fields of the reply, with the empty text for whatever is absent."""
    parsed = df.withColumn("_fields", reply_object(F.col(text)))
    return parsed.withColumns(
        {f: F.coalesce(F.col("_fields")[f], F.lit("")) for f in fields}
    ).drop("_fields")


def _captured(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).try_cast("bigint")


def integer_code(text: Column, prefix: str | None = None) -> Column:
    """Integer label in free text.

    With a prefix: at a line end, as quoted JSON value, as bare JSON value, then
    anywhere.  Without: the first integer.
    """
    if not prefix:
        return _captured(text, r"[+-]?\d+", 0)
    name = r"\Q" + prefix + r"\E"
    # The four accepted shapes, in order of preference.
    shapes = [
        rf"(?imU)\b{name}\s*[:\-]?\s*([+-]?\d+)\s*$",
        rf'(?imU)"{name}"\s*:\s*"([+-]?\d+)"',
        rf'(?imU)"{name}"\s*:\s*([+-]?\d+)',
        rf"(?imU)\b{name}\s*[:\-]?\s*([+-]?\d+)",
    ]
    return F.coalesce(*[_captured(text, s) for s in shapes])


def text_code(text: Column, prefix: str | None = None) -> Column:
    """Text label in free text: what follows the prefix on its line, else the first line.

    Quotes, a final comma or full stop and surrounding blanks are left out; null
    where nothing remains.
    """
    name = r"\Q" + prefix + r"\E" if prefix else ""
    found = F.regexp_extract(text, rf"(?imU)\b{name}\"?\s*[:\-]\s*(.+?)\s*$" if prefix else r"(?mU)^\s*(\S.*?)\s*$", 1)
    return F.nullif(F.regexp_replace(found, r"""^["'\s]+|["'\s.,;]+$""", ""), F.lit(""))


def last_binary_digit(text: Column) -> Column:
    """Last standalone 0 or 1."""
    found = F.regexp_extract_all(text, F.lit(r"\b[01]\b"), F.lit(0))
    return F.try_element_at(found, F.lit(-1)).try_cast("bigint")


def resolve_label(text: Column, field: str | None = None) -> Column:
    """Label text: JSON field, then prefixed code, then the last 0 or 1."""
    from_json = reply_object(text)[field or DEFAULT_LABEL_FIELD]
    if field is None:
        return from_json
    return F.coalesce(
        from_json,
        integer_code(text, field).cast("string"),
        last_binary_digit(text).cast("string"),
    )


def numeric_label(value: Column, label_type: str, compat: bool = False) -> Column:
    """Number inside a label text, for label types Integer and Float.

    A Float label keeps sign and decimals.  ``compat`` takes the first run of
    digits in all cases, which turns ``3.7`` into 3.
    """
    if label_type not in ("Integer", "Float"):
        raise ValueError("label_type must be Integer or Float")
    text = value.cast("string")
    unsigned = F.nullif(F.regexp_extract(text, r"\b\d+\b", 0), F.lit(""))
    if label_type == "Integer":
        return unsigned.try_cast("bigint")
    if compat:
        return unsigned.try_cast("double")
    signed = F.nullif(F.regexp_extract(text, r"[+-]?\b\d+(\.\d+)?\b", 0), F.lit(""))
    return signed.try_cast("double")


def numeric_or_text(value: Column, label_type: str, compat: bool = False) -> Column:
    """The number inside a label text, as text; a text without one stays as it is."""
    return F.coalesce(numeric_label(value, label_type, compat).cast("string"), value.cast("string"))


def key_value_blocks(text: Column) -> Column:
    """``Key: value`` lines as a map; values may span lines.

    The text is cut where a line starts with ``Key:``, all inside one expression:
    no line ever leaves its row.  Leading lines without a key form ``Section_1``;
    of a repeated key the last block counts.
    """
    lines = F.split(F.regexp_replace(text, X.OTHER_BREAKS, "\n"), "\n")
    tidy = F.ltrim(F.array_join(F.transform(lines, X.strip), "\n"), F.lit("\n"))
    parts = F.filter(F.split(tidy, r"\n+(?=\S+[^\S\n]*:)"), lambda p: p != "")
    keyed = r"(?s)^(\S+)[^\S\n]*:[^\S\n]*(.*)$"
    pairs = F.transform(
        parts,
        lambda p: F.when(
            p.rlike(keyed),
            F.struct(
                F.regexp_extract(p, keyed, 1).alias("key"),
                X.strip(F.regexp_extract(p, keyed, 2)).alias("value"),
            ),
        ).otherwise(F.struct(F.lit("Section_1").alias("key"), X.strip(p).alias("value"))),
    )

    def newest(entries: Column) -> Column:
        """The entries with the last value of each key."""
        return F.filter(
            entries,
            lambda p, i: ~F.exists(
                F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == p["key"]
            ),
        )

    return bind(pairs, lambda entries: F.map_from_entries(newest(entries)))


def completion_vote(
    df: DataFrame,
    keys: Sequence[str],
    label: str = "label",
    order: str = "completion_no",
) -> DataFrame:
    """Majority label over completions; the label seen first wins a tie and a
    missing label is a candidate like any other.

    Counting happens before rows are brought together per key, so a key with very
    many completions costs one row per distinct label.
    """
    per_label = df.groupBy(*keys, label).agg(
        F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first")
    )
    best = F.max_by(F.struct(label), F.struct(F.col("_n"), -F.col("_first")))
    return per_label.groupBy(*keys).agg(
        best[label].alias(label), F.sum("_n").alias("completions")
    )


def attach_by_verbatim(
    rows: DataFrame,
    predictions: DataFrame,
    order: str,
    label: str = "label",
    verbatim: str = "verbatim",
    default: int | None = None,
    as_name: str = "model_pred",
) -> DataFrame:
    """Give each row the first prediction made for the same text.

    Texts are compared through their SHA-256, so long texts are not shuffled, and
    the first prediction per text is found by aggregation.  A text copied into a
    large share of the rows is one key, whose rows adaptive execution splits.
    """
    digest = F.sha2(F.col(verbatim), 256).alias("_digest")
    first = (
        predictions.select(digest, F.col(order).alias("_order"), F.col(label).alias("_label"))
        .groupBy("_digest")
        .agg(F.min_by("_label", "_order").alias("_label"))
        .withColumn("_found", F.lit(True))
    )
    joined = rows.select("*", digest).join(first, "_digest", "left")
    value = F.col("_label")
    if default is not None:
        value = F.when(F.col("_found"), value).otherwise(F.lit(default))
    return joined.withColumn(as_name, value).drop("_digest", "_label", "_found")


def attach_by_key(
    rows: DataFrame,
    predictions: DataFrame,
    key: str,
    label: str = "label",
    default: int | None = None,
    as_name: str = "model_pred",
) -> DataFrame:
    """Give each row the prediction with its key; the preferred form."""
    found = predictions.select(key, F.col(label).alias("_label"), F.lit(True).alias("_found"))
    value = F.col("_label")
    if default is not None:
        value = F.when(F.col("_found"), value).otherwise(F.lit(default))
    return rows.join(found, key, "left").withColumn(as_name, value).drop("_label", "_found")


Annotator = Callable[[str], tuple[str | None, tuple[int, int] | None]]

REPLY_COLUMNS = (
    "response_text string, prompt_tokens bigint, completion_tokens bigint, error string"
)


#: Prompts answered before their replies leave the task.
CALLS_AT_ONCE = 256


def annotate_batch(
    df: DataFrame,
    annotator: Annotator,
    n_completions: int = 1,
    prompt: str = "prompt",
    partitions: int | None = None,
    durable: bool = False,
) -> DataFrame:
    """Call ``annotator(prompt) -> (text, (prompt_tokens, completion_tokens))``.

    A failing call yields a row with a null reply and the message in ``error``.
    ``durable`` stores the replies in the shared folder, so that a lost executor
    does not repeat calls that cost money.
    """
    work = df.withColumn(
        "completion_no", F.explode(F.sequence(F.lit(1), F.lit(n_completions)))
    )
    if partitions:
        work = work.repartition(partitions)
    carried = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in work.schema.fields)

    def call(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        # A few prompts at a time, and what is only carried stays as it came: a task
        # holds the batch it was given and the replies of one slice.
        for batch in (whole.slice(at, CALLS_AT_ONCE) for whole in batches for at in range(0, whole.num_rows, CALLS_AT_ONCE)):
            replies = []
            for text in batch.column(batch.schema.names.index(prompt)):
                try:
                    reply, usage = annotator(text.as_py())
                    used = usage or (None, None)
                    replies.append((reply, used[0], used[1], None))
                except Exception as problem:  # one bad call must not fail the job
                    replies.append((None, 0, 0, str(problem)))
            names = ["response_text", "prompt_tokens", "completion_tokens", "error"]
            frame = pd.DataFrame(replies, columns=names).astype({"prompt_tokens": "Int64", "completion_tokens": "Int64"})
            types = (pa.string(), pa.int64(), pa.int64(), pa.string())
            read = [pa.Array.from_pandas(frame[n], type=t) for n, t in zip(names, types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *read], names=[*batch.schema.names, *names])

    out = work.mapInArrow(call, f"{carried}, {REPLY_COLUMNS}")
    return settle(out) if durable else out


def group_validity(
    df: DataFrame, group: str, label: str = "label", as_name: str = "global_validity"
) -> DataFrame:
    """Per group: 1 if every label is 1, else 0; a missing label counts as 0.

    A row without a group gets null.
    """
    filled = df.withColumn(label, F.coalesce(F.col(label), F.lit(0)))
    verdict = filled.groupBy(group).agg(F.min(F.when(F.col(label) == 1, 1).otherwise(0)).alias(as_name))
    return filled.join(verdict, group, "left")
