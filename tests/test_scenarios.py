"""Scenario runs with a rule in place of a model."""

from __future__ import annotations

import pytest

import pyarrow as pa

from accordant.operators import replies
from accordant.operators.scenarios import Scenario, improve_prompt, run_scenarios


def data(spark, n=60):
    rows = [(i, f"text {i}", i % 2, i % 2, i % 2 if i % 7 else None) for i in range(n)]
    return spark.createDataFrame(rows, "item_id long, verbatim string, a long, b long, c long")


def make_annotator(log=None):
    """Right when the prompt says "careful"; otherwise wrong on every third item."""

    def annotator(prompt):
        if log:
            with open(log, "a") as out:
                out.write("x")
        number = int(prompt.rsplit(" ", 1)[1])
        if number == 50:
            raise RuntimeError("no answer")
        wrong = "careful" not in prompt and number % 3 == 0
        return f"Label: {(number + wrong) % 2}", (10, 2)

    return annotator


annotator = make_annotator()


def rewriter(prompt, examples, history):
    assert 0 < len(examples) <= 4 and history[-1]["prompt"] == prompt
    return "Be careful: {verbatim_text}", "asked for care"


def test_single_iteration(spark, tmp_path):
    log = tmp_path / "calls"
    scenario = Scenario("p", "Judge: {verbatim_text}", prefix="Label", subsample_size=30, validation_size=12)
    out = run_scenarios(data(spark), [scenario], "item_id", ["a", "b", "c"], make_annotator(str(log)), n_runs=3)
    rows = out.collect()
    assert out.count() == len(log.read_text()) == 90  # reading again calls nobody
    assert len(rows) == 90
    assert sum(r["split"] == "val" for r in rows) == 36
    assert len({(r["item_id"], r["split"]) for r in rows}) == 30
    for r in rows:
        if r["item_id"] == 50:
            assert r["model_pred"] is None and r["error"] == "no answer"
        else:
            assert r["model_pred"] == (r["item_id"] + (r["item_id"] % 3 == 0)) % 2


def test_improvement_stops_without_mistakes(spark):
    scenario = Scenario(
        "p", "Judge: {verbatim_text}", prefix="Label", subsample_size="all", validation_size=20, max_iterations=4
    )
    rows = data(spark, 50)
    best, accuracy, history = improve_prompt(
        rows, scenario, "item_id", ["a", "b", "c"], [0, 1], annotator, rewriter
    )
    assert best.startswith("Be careful") and accuracy == 1.0
    assert [h["prompt_iteration"] for h in history] == [1, 2]
    assert history[1]["effect_of_changes"] == "Those changes improved the classification"
    out = run_scenarios(
        rows, [scenario], "item_id", ["a", "b", "c"], annotator, 1, [0, 1], rewriter
    )
    got = {
        (r["prompt_iteration"], r["is_best_iteration"], r["total_iterations"]): r["n"]
        for r in out.groupBy("prompt_iteration", "is_best_iteration", "total_iterations")
        .count().withColumnRenamed("count", "n").collect()
    }
    assert got == {(1, False, 2): 50, (2, False, 2): 50, (3, False, 2): 50, (4, True, 2): 50}
    later = out.where("prompt_iteration > 1 AND model_pred <> item_id % 2").count()
    assert later == 0


def test_improvement_goes_on_from_its_ledger(spark, tmp_path):
    log, ledger = tmp_path / "calls", str(tmp_path / "ledger")
    rows = data(spark, 50)
    plain = dict(prefix="Label", subsample_size="all", validation_size=20)
    asked = []

    def counting(prompt, examples, history):
        asked.append(len(history))
        return f"Try {len(history)}: {{verbatim_text}}", f"change {len(history)}"

    def improve(most, annotate, rewrite=counting):
        scenario = Scenario("p", "Judge: {verbatim_text}", max_iterations=most, **plain)
        return improve_prompt(rows, scenario, "item_id", ["a", "b", "c"], [0, 1], annotate, rewrite, ledger=ledger)

    whole = improve_prompt(
        rows, Scenario("p", "Judge: {verbatim_text}", max_iterations=3, **plain), "item_id", ["a", "b", "c"], [0, 1], annotator, counting
    )
    asked.clear()
    improve(2, make_annotator(str(log)))
    assert len(log.read_text()) == 100 and asked == [1]
    again = improve(3, make_annotator(str(log)))
    assert len(log.read_text()) == 150 and asked == [1, 2]  # only the third iteration is new
    assert again == whole
    assert improve(3, make_annotator(str(log))) == whole
    assert len(log.read_text()) == 150 and asked == [1, 2]


def test_text_labels(spark):
    rows = [(i, f"text {i}", *(["yes", "no"][i % 2],) * 3) for i in range(40)]
    table = spark.createDataFrame(rows, "item_id long, verbatim string, a string, b string, c string")
    scenario = Scenario("p", "Judge: {verbatim_text}", prefix="Label", label_type="Text", subsample_size="all", validation_size=10, max_iterations=2)

    def ask(prompt):
        number = int(prompt.rsplit(" ", 1)[1])
        if number == 3:
            raise RuntimeError("no answer")
        return f"Label: {['yes', 'no'][number % 2]}", (1, 1)

    best, accuracy, history = improve_prompt(table, scenario, "item_id", ["a", "b", "c"], ["yes", "no"], ask, lambda *_: None)
    assert len(history) == 1 and history[0]["a_train_acc"] == 1.0
    shares = [history[0]["accuracy_train"], history[0]["accuracy_val"]]
    assert sorted(shares) in ([0.9, 1.0], [29 / 30, 1.0])
    with pytest.raises(ValueError, match="label_type"):
        Scenario("p", "x", label_type="Number")


def test_iterations_need_a_rewriter(spark):
    scenario = Scenario("p", "{verbatim_text}", max_iterations=2)
    with pytest.raises(ValueError, match="rewriter"):
        run_scenarios(data(spark), [scenario], "item_id", ["a"], annotator)


def test_json_needs_fields():
    with pytest.raises(ValueError, match="selected field"):
        Scenario("p", "x", json_output=True)


def test_replies_leave_in_slices(spark, monkeypatch):
    """A task holds the replies of a few prompts, however many rows a batch has, and changes nothing it carries."""
    held, asked = [], []
    kind = type(spark.range(0))
    plain = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, schema, *a, **b: held.append(f) or plain(self, f, schema, *a, **b))
    big = 2**53 + 1
    rows = spark.createDataFrame([(big, "p"), (None, "q"), (1, None)], "k long, prompt string")

    def annotator(text):
        if text == "q":
            raise ValueError("no")
        return f"re {text}", None if text is None else (len(text), 1)

    got = {tuple(r) for r in replies.annotate_batch(rows, annotator).collect()}
    assert got == {(big, "p", 1, "re p", 1, 1, None), (None, "q", 1, None, 0, 0, "no"), (1, None, 1, "re None", None, None, None)}
    replies.annotate_batch(rows.select("prompt"), lambda text: (asked.append(text) or text, (1, 1)))
    batch = pa.RecordBatch.from_pydict({"prompt": [str(i) for i in range(1000)], "completion_no": [1] * 1000})
    out = held[-1](iter([batch]))
    assert next(out).num_rows == len(asked) == replies.CALLS_AT_ONCE
    assert sum(b.num_rows for b in out) == 1000 - replies.CALLS_AT_ONCE
