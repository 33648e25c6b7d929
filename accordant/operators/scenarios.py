"""Scenarios: sample, split, annotate in several runs, and collect detailed results."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.functions.labels import majority_vote
from accordant.operators import iterate, replies, reply_store, sampling
from accordant.operators.patterns import GT
from accordant.operators.prompts import scenario_prompt
from accordant.schema import TRAIN, VAL, Ratings, require_columns
from accordant.session import settle

# (current prompt, example rows, history) -> (new prompt, description of the change)
Rewriter = Callable[[str, list[dict], list[dict]], tuple[str, str] | None]


@dataclass(frozen=True)
class Scenario:
    """One prompt with its sampling and reading rules."""

    prompt_name: str
    template: str
    response_template: str | None = None
    json_output: bool = False
    selected_fields: tuple[str, ...] = ()
    prefix: str | None = None
    # The defaults of a scenario.
    iteration: int = 1
    subsample_size: int | str = 20
    use_validation_set: bool = True
    validation_size: int = 10
    random_state: int = 42
    n_completions: int = 1
    max_iterations: int = 1
    examples_to_give: int = 4
    errors_examples: float = 0.5
    label_type: str = "Integer"

    def __post_init__(self) -> None:
        if self.label_type not in ("Integer", "Text"):
            raise ValueError("label_type must be Integer or Text")
        if self.json_output and not self.selected_fields:
            raise ValueError("json_output needs at least one selected field")

    def full_prompt(self, template: str) -> str:
        if self.json_output and self.response_template:
            return f"{template}\n\n{self.response_template}"
        return template


    def identity(self) -> str:
        """What an iteration's result depends on besides its prompt and its number."""
        rest = {k: v for k, v in self.__dict__.items() if k not in ("max_iterations",)}
        return hashlib.sha256(json.dumps(rest, sort_keys=True).encode()).hexdigest()


def split_sample(data: DataFrame, scenario: Scenario, key: str) -> DataFrame:
    """The scenario's sample with its ``split``."""
    sample = sampling.exact_sample(data, key, scenario.subsample_size, scenario.random_state)
    size = scenario.validation_size if scenario.use_validation_set else 0
    return sampling.train_val_split(sample, key, size, scenario.random_state)


def call_partitions(rows: DataFrame) -> int:
    """Calls wait on a service, so they are spread however few files the rows came in."""
    spark = rows.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def predict(
    rows: DataFrame,
    scenario: Scenario,
    prompt: str,
    annotator: replies.Annotator,
    ids: Sequence[str],
    verbatim: str = "verbatim",
    store: str | None = None,
) -> DataFrame:
    """Add ``model_pred``, ``error`` and the selected fields.

    Replies are stored before anything is read from them: each call happens once.
    With ``store``, a folder of replies, they are shared with every run that uses
    it, and equal prompts with each other.  The label is the majority over
    completions, null if a call failed; fields come from the last completion.
    """
    require_columns(rows, [*ids, verbatim])
    asked = rows.select(*ids, scenario_prompt(prompt, F.col(verbatim)).alias("prompt"))
    tasks = call_partitions(rows)
    if store is None:
        answered = replies.annotate_batch(asked, annotator, scenario.n_completions, partitions=tasks, durable=True).drop("prompt")
    else:
        answered = reply_store.annotate_stored(asked, annotator, store, scenario.n_completions, partitions=tasks).drop("prompt", "calls")
    text = F.col("response_text")
    if scenario.json_output:
        label = replies.resolve_label(text, scenario.prefix)
    elif scenario.label_type == "Text":
        label = replies.text_code(text, scenario.prefix)
    else:
        label = replies.integer_code(text, scenario.prefix).cast("string")
    voted = replies.completion_vote(answered.withColumn("label", label), ids)
    failed = answered.where("error IS NOT NULL").groupBy(*ids).agg(F.min("error").alias("error"))
    out = rows.join(voted.drop("completions"), list(ids), "left").join(failed, list(ids), "left")
    given = F.when(F.col("error").isNull(), F.col("label"))
    out = out.withColumn("model_pred", given if scenario.label_type == "Text" else given.try_cast("bigint")).drop("label")
    fields = [f for f in scenario.selected_fields if f not in out.columns]
    if scenario.json_output and fields:
        last = answered.where(F.col("completion_no") == scenario.n_completions)
        read = replies.parse_json_fields(last, fields).select(*ids, *fields, "parse_status")
        out = out.join(read, list(ids), "left")
    return out


def run_scenario(
    data: DataFrame,
    scenario: Scenario,
    key: str,
    annotator: replies.Annotator,
    n_runs: int = 2,
    verbatim: str = "verbatim",
    prompt: str | None = None,
) -> DataFrame:
    """Detailed results of one prompt: the same sample in every run."""
    rows = sampling.replicate_runs(split_sample(data, scenario, key), n_runs)
    done = predict(
        rows, scenario, scenario.full_prompt(prompt or scenario.template), annotator, [key, "run"], verbatim
    )
    return done.withColumns(
        {
            "prompt_name": F.lit(scenario.prompt_name),
            "iteration": F.lit(scenario.iteration),
            "use_validation_set": F.lit(scenario.use_validation_set),
        }
    )


LEDGER = "identity string, prompt_name string, step int, prompt string, changes string, metrics string, examples string, done boolean"


def ledger_rows(spark, path: str, identity: str) -> list[dict]:
    """The iterations of a scenario so far, in order; there are at most as many as iterations were asked for."""
    try:
        rows = spark.read.schema(LEDGER).parquet(path).where(F.col("identity") == identity).collect()
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(({r["step"]: r.asDict() for r in rows}).values(), key=lambda r: r["step"])


def _effect(before: float | None, now: float | None, judged: str) -> str:
    if judged != VAL or before is None or now is None:
        return iterate.NOT_APPLICABLE
    return iterate.IMPROVED if now > before else iterate.DECREASED if now < before else iterate.UNCHANGED


def improve_prompt(
    data: DataFrame,
    scenario: Scenario,
    key: str,
    raters: Sequence[str],
    labels: Sequence[object],
    annotator: replies.Annotator,
    rewriter: Rewriter,
    epsilon: float = 0.2,
    verbatim: str = "verbatim",
    ledger: str | None = None,
) -> tuple[str, float, list[dict]]:
    """Rewrite a prompt while it makes mistakes; best prompt, its accuracy, history.

    Each iteration is a distributed annotation and one metrics row; only that row
    and the few example rows reach the driver.  ``ledger``, a folder, takes a row
    per finished iteration and below it the replies of all prompts: a run that is
    started again, also with more iterations, goes on after the last finished one
    and repeats no good call.
    """
    spark, ratings = data.sparkSession, Ratings.of(raters)
    store = f"{ledger.rstrip('/')}/replies" if ledger else None
    table = f"{ledger.rstrip('/')}/iterations" if ledger else None
    judged = VAL if scenario.use_validation_set and scenario.validation_size > 0 else TRAIN
    kept = ledger_rows(spark, table, scenario.identity()) if table else []
    sample: DataFrame | None = None
    current, changes = scenario.template, "Initial prompt"
    best, best_accuracy, before = current, -1.0, None
    history: list[dict] = []
    for step in range(1, scenario.max_iterations + 1):
        if step <= len(kept):
            past = kept[step - 1]
            current, changes, done = past["prompt"], past["changes"], past["done"]
            row, shown = json.loads(past["metrics"]), json.loads(past["examples"])
        else:
            if sample is None:
                truth = majority_vote([F.col(r) for r in raters])
                sample = settle(split_sample(data, scenario, key)).withColumn(GT, truth)
            asked = scenario.full_prompt(current)
            facts = predict(sample, scenario, asked, annotator, [key], verbatim, store).withColumns(
                {"prompt_name": F.lit(scenario.prompt_name), "prompt_iteration": F.lit(step)}
            )
            row = iterate.iteration_rows(facts, ratings, labels, epsilon).first().asDict()
            trained = facts.where(F.col("split") == TRAIN)
            examples = iterate.pick_examples(
                trained, ["prompt_name"], key, n_examples=scenario.examples_to_give, error_share=scenario.errors_examples
            )
            shown = [
                r.asDict()
                for r in examples.select(
                    F.col(verbatim).alias("verbatim"), F.col(GT).alias("human_label"), F.col("model_pred").alias("llm1_label"), "is_mistake"
                ).collect()
            ]
            right = F.coalesce(F.col("model_pred") == F.col(GT), F.lit(False))
            done = trained.where(~right).limit(1).count() == 0
            if table:
                line = (scenario.identity(), scenario.prompt_name, step, current, changes, json.dumps(row), json.dumps(shown), done)
                spark.createDataFrame([line], LEDGER).write.mode("append").parquet(table)
        accuracy = row[f"accuracy_{judged}"]
        history.append(row | {"prompt": current, "changes": changes, "effect_of_changes": _effect(before, accuracy, judged)})
        if accuracy is not None and accuracy > best_accuracy:
            best, best_accuracy = current, accuracy
        before = accuracy
        if done:
            break
        if len(kept) <= step < scenario.max_iterations:
            answer = rewriter(current, shown, history)
            if answer is None:
                break
            current, changes = answer
    return best, best_accuracy, history


def run_scenarios(
    data: DataFrame,
    scenarios: Sequence[Scenario],
    key: str,
    raters: Sequence[str],
    annotator: replies.Annotator,
    n_runs: int = 2,
    labels: Sequence[object] = (),
    rewriter: Rewriter | None = None,
    verbatim: str = "verbatim",
    ledger: str | None = None,
) -> DataFrame:
    """Detailed results of all scenarios and runs in one table.

    A scenario with several iterations is first improved with ``rewriter``; its
    first iteration then uses the original prompt and the others the best one.
    ``ledger`` keeps finished iterations, see :func:`improve_prompt`.
    """
    require_columns(data, [key, verbatim, *raters])
    parts: list[DataFrame] = []
    for s in scenarios:
        if s.max_iterations <= 1:
            parts.append(run_scenario(data, s, key, annotator, n_runs, verbatim))
            continue
        if rewriter is None:
            raise ValueError("a scenario with several iterations needs a rewriter")
        best, accuracy, history = improve_prompt(
            data, s, key, raters, labels, annotator, rewriter, verbatim=verbatim, ledger=ledger
        )
        for step in range(1, s.max_iterations + 1):
            prompt = s.template if step == 1 else best
            part = run_scenario(data, s, key, annotator, n_runs, verbatim, prompt)
            parts.append(
                part.withColumns(
                    {
                        "prompt_iteration": F.lit(step),
                        "best_accuracy": F.lit(accuracy),
                        "total_iterations": F.lit(len(history)),
                        "is_best_iteration": F.lit(step == s.max_iterations),
                    }
                )
            )
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
