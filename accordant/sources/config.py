"""Project configuration files."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from accordant.operators import prep


@dataclass
class ProjectConfig:
    """Column choice, wording and label settings of a project."""

    selected_columns: list[str] = field(default_factory=list)
    column_renames: dict[str, str] = field(default_factory=dict)
    column_descriptions: dict[str, str] = field(default_factory=dict)
    text_columns: list[str] = field(default_factory=list)
    annotation_columns: list[str] = field(default_factory=list)
    selected_fields: list[str] = field(default_factory=list)
    label_column: str | None = None
    label_type: str | None = None
    selected_model: str | None = None
    codebook: str = ""
    examples: str = ""

    def __post_init__(self) -> None:
        given = self.column_renames
        self.column_renames = {c: given.get(c, c) for c in self.selected_columns}
        shown = set(self.column_renames.values())
        self.column_descriptions = {
            c: d for c, d in self.column_descriptions.items() if c in shown
        }

    @classmethod
    def from_dict(cls, values: dict) -> "ProjectConfig":
        known = cls.__dataclass_fields__
        return cls(**{k: v for k, v in values.items() if k in known and v is not None})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "ProjectConfig":
        """Read one configuration file from any file system Spark can reach."""
        content = spark.read.text(path, wholetext=True).first()
        if content is None:
            raise ValueError(f"empty configuration: {path}")
        return cls.from_dict(json.loads(content["value"]))

    def save(self, spark: SparkSession, path: str) -> None:
        text = json.dumps(asdict(self), indent=4)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)

    def prepare(self, df: DataFrame, allow_missing: bool = False) -> DataFrame:
        """Filter annotated rows, choose and rename columns, clean the text ones."""
        rows = df
        if self.annotation_columns:
            rows = prep.annotated(rows, self.annotation_columns, allow_missing)
        keep = [*self.selected_columns, *self.annotation_columns]
        chosen = prep.select_rename(rows, list(dict.fromkeys(keep)), self.column_renames)
        texts = [self.column_renames.get(c, c) for c in self.text_columns]
        return prep.clean_columns(chosen, [t for t in texts if t in chosen.columns])

    def entry(self, df: DataFrame) -> DataFrame:
        """Add ``entry_text`` built from the selected columns."""
        names = list(self.column_renames.values())
        return df.withColumn("entry_text", prep.entry_text(df, names))


