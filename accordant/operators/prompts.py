"""Prompt columns for annotation and generation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.functions import text as X

# Wording of the prompts, here and in the functions below.
FORMAT_HEADER = "The data has the following columns:\n"
DEFAULT_INSTRUCTIONS = "You are an assistant that evaluates data entries."
SAMPLE_VALUE = "Your text here"
JSON_ONLY = (
    "**Your response must be in JSON format only. Do not include any explanations, "
    "greetings, or additional text.**"
)
GENERATION_JSON_ONLY = (
    "**IMPORTANT:** Your response must be valid JSON only, containing a single object with "
    "the specified columns. Do not include any explanations, greetings, or additional text."
)


def format_description(descriptions: Mapping[str, str]) -> str:
    """Description of the data columns, one line each."""
    return FORMAT_HEADER + "".join(f'- "{c}": {d}\n' for c, d in descriptions.items())


def output_instructions(fields: Sequence[str], sample: Mapping[str, str] | None = None) -> str:
    """Closing part of an annotation prompt that asks for JSON."""
    shown = sample if sample is not None else {f: SAMPLE_VALUE for f in fields}
    return (
        f"\n- Your response should include the following fields: {X.join_names(fields)}.\n"
        f"- {JSON_ONLY}\n\n**Example response format:**\n\n{X.sample_json(shown)}\n"
    )


def annotation_prompt(
    entry: Column,
    descriptions: Mapping[str, str],
    codebook: str,
    examples: str = "",
    fields: Sequence[str] = (),
    instructions: str = DEFAULT_INSTRUCTIONS,
    closing: str | None = None,
) -> Column:
    """Prompt per row; everything but the entry is one literal on either side."""
    before = (
        f"\n{instructions}\n\nYou are provided with data entries in the following format:\n\n"
        f"{format_description(descriptions)}\n\nHere is an entry to evaluate:\n\n"
    )
    after = (
        f"\n\n{codebook}\n\n{examples}\n\n**Instructions:**\n\n"
        "- Evaluate the entry according to the codebook and examples.\n"
        "- Provide your evaluation in the specified format.\n"
        f"{closing if closing is not None else output_instructions(fields)}\n"
    )
    return F.concat(F.lit(before), entry, F.lit(after))


def scenario_prompt(
    template: str, verbatim: Column, response_template: str | None = None
) -> Column:
    """A scenario's template, with its reply template below, filled with the text."""
    whole = f"{template}\n\n{response_template}" if response_template else template
    return X.fill_template(whole, {"verbatim_text": verbatim})


def blueprint_table(df: DataFrame, key: str, text: str, delimiter: str = "---") -> DataFrame:
    """``key, blueprint_no, blueprint_id, text``: the numbered pieces of each text."""
    return df.select(key, F.posexplode(X.split_blocks(F.col(text), delimiter)).alias("_pos", "text")).select(
        key,
        (F.col("_pos") + 1).alias("blueprint_no"),
        F.concat(F.lit("Blueprint_"), F.col("_pos") + 1).alias("blueprint_id"),
        "text",
    )


def generation_prompt(
    blueprints: Column, request: str, columns: Sequence[str], descriptions: Mapping[str, str]
) -> Column:
    """Generation prompt from an array of blueprint texts."""
    sample = {c: descriptions.get(c) or f"Your generated {c}" for c in columns}
    shown = F.array_join(F.transform(blueprints, lambda b: F.concat(b, F.lit("\n\n"))), "")
    return F.concat(
        F.lit(f"**Generation Instructions:**\n{request}\n\n"),
        shown,
        F.lit(
            f"\n\n{GENERATION_JSON_ONLY}\n\n**Example output format:**\n{X.sample_json(sample)}"
        ),
    )


def content_annotation_prompt(
    df: DataFrame,
    content: Sequence[str],
    blueprints: Sequence[str],
    codebook: str,
    examples: str,
    fields: Sequence[str],
) -> Column:
    """Prompt that asks to annotate a generated row; id and blueprints are not content."""
    parts: list[Column] = [
        F.lit(f"{codebook}\n\n{examples}\n\nHere is the generated content to annotate:\n\n")
    ]
    for name in content:
        shown = F.coalesce(F.col(name).cast("string"), F.lit(""))
        parts += [F.lit(f"**{name}**: "), shown, F.lit("\n")]
    parts.append(
        F.lit("\n\nFor reference, here are the original correct blueprint examples:\n\n")
    )
    for name in blueprints:
        if name in df.columns:
            parts += [F.coalesce(F.col(name), F.lit("")), F.lit("\n\n")]
    sample = {f: f"Your annotation for {f}" for f in fields}
    parts.append(
        F.lit(
            "\n\n**Instructions:**\n- Evaluate the generated content according to the codebook "
            "and examples.\n- Your response should include the following fields: "
            f"{X.join_names(fields)}.\n- {JSON_ONLY}\n\n**Example response format:**\n"
            f"{X.sample_json(sample, ascii_only=True)}"
        )
    )
    return F.concat(*parts)
