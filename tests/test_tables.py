"""Preparation, sampling, replies, annotation, iteration and files."""

from __future__ import annotations

import datetime
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from accordant.operators import (
    annotate,
    cost,
    generate,
    iterate,
    label_state,
    prep,
    prompts,
    replies,
    reply_store,
    sampling,
    scanner,
    spread,
)
from accordant.schema import Ratings, require_columns, with_fact_columns
from accordant.sources import delimited
from accordant.sources.config import ProjectConfig


def rows_of(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# --- preparation ------------------------------------------------------------------


def test_missing_columns_are_named(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match="b, c"):
        require_columns(df, ["a", "b", "c"])
    with pytest.raises(ValueError):
        prep.select_rename(df, ["b"], {})
    with pytest.raises(ValueError):
        prep.annotated(df, ["b"])


def test_fact_columns(spark):
    df = with_fact_columns(spark.createDataFrame([(1, 2)], "run int, guess int"), "guess")
    row = df.first().asDict()
    assert row == {
        "run": 1, "model_pred": 2, "prompt_name": "streamlit_analysis", "iteration": 1, "split": "train"
    }


def test_label_types(spark):
    df = spark.createDataFrame(
        [("1", "1.0", 1.0, -1.0, "x", None), ("-2", "2", 3.0, 2.0, "1", None)],
        "a string, b string, c double, d double, e string, f string",
    )
    kinds = {r["column_name"]: r["label_type"] for r in prep.label_types(df, list("abcdef")).collect()}
    assert kinds == {"a": "int", "b": "str", "c": "int", "d": "str", "e": "str", "f": "int"}
    out = prep.convert_labels(df, ["a", "c", "d"])
    assert rows_of(out.select("a", "c", "d"), "a") == [(-2, 3, "2.0"), (1, 1, "-1.0")]


def test_entry_text(spark):
    df = spark.createDataFrame([("a", 3.0, 2.5, None)], "t string, n double, m double, z string")
    text = df.select(prep.entry_text(df, ["t", "n", "m", "z", "absent"])).first()[0]
    assert text == "t: a\nn: 3\nm: 2.5\nz: "


def test_discrepancies_and_agreements(spark):
    df = spark.createDataFrame(
        [("a", 1, 1), ("b", 1, 0), ("c", None, 0), ("d", None, None)],
        "verbatim string, human int, model_pred int",
    )
    assert [r[0] for r in rows_of(prep.discrepancies(df, "human"), "verbatim")] == ["b", "c", "d"]
    assert [r[0] for r in rows_of(prep.agreements(df, "human"))] == ["a"]


def test_remaining_by_key(spark):
    data = spark.createDataFrame([(i, i * 2) for i in range(5)], "k int, v int")
    done = spark.createDataFrame([(0, 1), (1, 1), (2, 2)], "k int, run int")
    assert rows_of(prep.remaining(data, done, "k", run=1), "k") == [(2, 4), (3, 6), (4, 8)]


# --- sampling ---------------------------------------------------------------------


def brute_smallest(keys, n, seed):
    def mixed(k):
        return hashlib.md5(f"{k}:{seed}:sample".encode()).hexdigest()[:8]

    return set(sorted(keys, key=lambda k: (mixed(k), k))[:n])


@pytest.mark.parametrize("n", [1, 2, 17, 500, 999, 1000, 5000])
def test_exact_sample(spark, n):
    rng = random.Random(n)
    keys = rng.sample(range(2**31 - 1), 900) + rng.sample(range(2**31, 2**45), 100)
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(5)
    got = {r[0] for r in sampling.exact_sample(df, "k", n, 42).collect()}
    assert got == brute_smallest(keys, n, 42)


def test_exact_sample_with_keys_that_mix_alike(spark, monkeypatch):
    # Keys with one hash are told apart by the key itself.
    monkeypatch.setattr(sampling, "mix", lambda key, seed, use: F.pmod(key, F.lit(3)).cast("bigint"))
    df = spark.createDataFrame([(k,) for k in range(80)], "k long")
    for n in (1, 3, 40, 79):
        got = {r[0] for r in sampling.exact_sample(df, "k", n, 1).collect()}
        assert got == set(sorted(range(80), key=lambda k: (k % 3, k))[:n])


def test_seeds_overlap_as_chance_would(spark):
    keys = spark.range(15_000)
    picks = [{r[0] for r in sampling.exact_sample(keys, "id", 700, seed).collect()} for seed in (42, 43, 44)]
    for a, b in ((0, 1), (1, 2), (0, 2)):
        assert 10 <= len(picks[a] & picks[b]) <= 65  # 33 by chance


def test_sample_and_split_are_drawn_apart(spark):
    keys = spark.range(4000)
    sample = {r[0] for r in sampling.exact_sample(keys, "id", 400, 42).collect()}
    held = {r[0] for r in sampling.train_val_split(keys, "id", 400, 42).where("split = 'val'").collect()}
    assert 15 <= len(sample & held) <= 70  # 40 by chance


def test_text_keys(spark):
    names = [f"näme {i}" for i in range(300)]
    df = spark.createDataFrame([(n,) for n in names] + [(None,)], "k string")
    assert {r[0] for r in sampling.exact_sample(df, "k", 50, 7).collect()} == brute_smallest(names, 50, 7)


def test_sample_of_everything(spark):
    df = spark.range(10)
    for size in ("all", "annotated", -1):
        assert sampling.exact_sample(df, "id", size).count() == 10
    with pytest.raises(ValueError):
        sampling.exact_sample(df, "id", 0)


def test_split_sizes(spark):
    split = sampling.train_val_split(spark.range(100), "id", 30)
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {
        "train": 70, "val": 30
    }
    assert sampling.train_val_split(spark.range(5), "id", 0).where("split = 'val'").count() == 0


def test_rows_without_a_key_are_never_chosen(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "k long")
    for n in (1, 2, 3, 5):
        chosen = {r["k"] for r in sampling.exact_sample(df, "k", n).collect()}
        assert None not in chosen and len(chosen) == min(n, 2)
    split = {r["k"]: r["split"] for r in sampling.train_val_split(df, "k", 5).collect()}
    assert split == {1: "val", 2: "val", None: "train"}


# --- replies ----------------------------------------------------------------------

PARSED = [
    ('{"A": "x", "B": 1}', ("x", "1", "ok")),
    ('text ```json\n{"A": "x"}\n``` more', ("x", None, "ok")),
    ('{"A": "x", /* why */ "B": 2 // note\n}', ("x", "2", "ok")),
    ('{"A": "x", # remark\n "B": 3,\n}', ("x", "3", "ok")),
    ('see {"A": "http://host/p", "B": 4}', ("http://host/p", "4", "ok")),
    ('so {"A": {"deep": 1}, "B": 5} end', ('{"deep":1}', "5", "ok")),
    ("nothing here", (None, None, "no_json")),
    ("{'A': 'x'}", (None, None, "bad_json")),
    ('{"A": oops}', (None, None, "bad_json")),
    ('{"A": "x", "Validity": 1}', ("x", None, "ok")),
    ('{"A": "x", "Validity": "0"}', ("x", None, "ok")),
    ('{"A": "x", "Validity": 2}', (None, None, "bad_validity")),
    ('{"A": "x", "Validity": "maybe"}', (None, None, "bad_validity")),
    ('{"A": null}', (None, None, "ok")),
    (None, (None, None, "no_json")),
]


@pytest.mark.parametrize("reply, expected", PARSED)
def test_json_fields(spark, reply, expected):
    df = spark.createDataFrame([(reply,)], "response_text string")
    row = replies.parse_json_fields(df, ["A", "B"]).select("A", "B", "parse_status").first()
    assert tuple(row) == expected


def test_fields_or_blank(spark):
    df = spark.createDataFrame([('{"A": 1}',), ("no",)], "response_text string")
    got = replies.fields_or_blank(df, ["A", "B"]).select("A", "B")
    assert rows_of(got, "A") == [("", ""), ("1", "")]


def test_label_chain(spark):
    given = [
        '{"Score": 3}', '{"Score": "positive"}', "Score: 4", "first 0 and finally 1", "none", "Score: x 0"
    ]
    df = spark.createDataFrame([(t,) for t in given], "t string")
    got = [r[0] for r in df.select(replies.resolve_label(F.col("t"), "Score")).collect()]
    assert got == ["3", "positive", "4", "1", None, "0"]
    default = df.select(replies.resolve_label(F.lit('{"Classification": 2}'))).first()[0]
    assert default == "2"


def test_completion_vote(spark):
    data = [("a", 1, 5), ("a", 2, 6), ("b", 1, None), ("b", 2, None), ("b", 3, 1), ("c", 2, 9), ("c", 1, 8), ("c", 3, 9)]
    df = spark.createDataFrame(data, "k string, completion_no int, label int")
    assert rows_of(replies.completion_vote(df, ["k"]), "k") == [("a", 5, 2), ("b", None, 3), ("c", 9, 3)]


def test_attach_first_match_and_default(spark):
    texts = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "z"), (5, None)], "i int, verbatim string")
    made = spark.createDataFrame([(2, "x", 7), (1, "x", 6), (3, "y", None)], "i int, verbatim string, label int")
    plain = replies.attach_by_verbatim(texts, made, "i").select("i", "model_pred")
    assert rows_of(plain, "i") == [(1, 6), (2, 6), (3, None), (4, None), (5, None)]
    filled = replies.attach_by_verbatim(texts, made, "i", default=1).select("i", "model_pred")
    assert rows_of(filled, "i") == [(1, 6), (2, 6), (3, None), (4, 1), (5, 1)]
    by_key = replies.attach_by_key(texts, made, "i", default=1).select("i", "model_pred")
    assert rows_of(by_key, "i") == [(1, 6), (2, 7), (3, None), (4, 1), (5, 1)]


def test_annotate_keeps_failed_rows(spark):
    def annotator(prompt):
        if prompt == "bad":
            raise RuntimeError("refused")
        return prompt.upper(), (len(prompt), 1)

    df = spark.createDataFrame([(1, "ok"), (2, "bad")], "i int, prompt string")
    for durable in (False, True):
        out = replies.annotate_batch(df, annotator, n_completions=2, partitions=2, durable=durable)
        got = rows_of(out.select("i", "completion_no", "response_text", "prompt_tokens", "error"), "i", "completion_no")
        assert got == [
            (1, 1, "OK", 2, None), (1, 2, "OK", 2, None), (2, 1, None, 0, "refused"), (2, 2, None, 0, "refused")
        ]


def test_group_validity(spark):
    data = [("a", 1), ("a", 1), ("b", 1), ("b", None), ("c", 1), ("c", 0)]
    out = replies.group_validity(spark.createDataFrame(data, "g string, label int"), "g")
    assert rows_of(out.select("g", "label", "global_validity"), "g", F.desc("label")) == [
        ("a", 1, 1), ("a", 1, 1), ("b", 1, 0), ("b", 0, 0), ("c", 1, 0), ("c", 0, 0)
    ]


# --- annotation, iteration ----------------------------------------------------------


def test_new_rater_columns(spark):
    df = annotate.ensure_rater(spark.range(1), "Ana")
    assert rows_of(df) == [(0, None, False)]
    assert annotate.ensure_rater(df, "Ana").columns == df.columns


def test_events_overwrite_and_flag(spark):
    base = annotate.ensure_rater(spark.range(4).withColumnRenamed("id", "i"), "Ana").withColumn(
        "Rater_Ana", F.when(F.col("i") == 3, "old")
    )
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    events = spark.createDataFrame(
        [(1, 0, "Ana", at(2), "b", False), (2, 0, "Ana", at(1), "a", False), (3, 1, "Ana", at(1), "", True),
         (4, 0, "Ana", at(3), "", False), (5, 3, "Ben", at(3), "z", False), (6, 9, "Ana", at(3), "z", False)],
        "event_id long, i long, rater string, ts timestamp, label string, invalid boolean",
    )
    out = annotate.apply_events(base, events, "i", ["Ana"])
    assert rows_of(out, "i") == [(0, "b", False), (1, None, True), (2, None, False), (3, "old", False)]


def test_row_validity_of_no_columns(spark):
    assert spark.range(1).select(annotate.row_is_valid([])).first()[0] is True


def test_queue_and_next(spark):
    df = spark.createDataFrame([(1, None, 1), (2, 5, 1), (3, None, None), (4, None, 1)], "i int, r int, o int")
    assert [r[0] for r in rows_of(annotate.unrated_queue(df, "r", "i", ["o"]))] == [1, 4]
    assert annotate.next_unrated(df, "r", "i", 1, ["o"]).first()["i"] == 4
    assert annotate.next_unrated(df, "r", "i", 4).count() == 0
    assert rows_of(annotate.progress(df, "r")) == [(4, 3)]


def scores(spark, rows):
    return spark.createDataFrame(rows, "p string, iteration int, accuracy_train double, accuracy_val double")


def test_best_row_rules(spark):
    table = scores(spark, [
        ("val", 1, 0.9, None), ("val", 2, 0.1, 0.5), ("val", 3, 0.8, 0.5),
        ("train", 1, 0.4, None), ("train", 2, 0.6, None), ("train", 3, 0.6, None),
        ("none", 1, None, None), ("none", 2, None, None),
    ])
    got = {r["p"]: r["iteration"] for r in iterate.best_row(table, ["p"]).collect()}
    assert got == {"val": 2, "train": 2, "none": 1}


def test_best_prompt_keeps_the_earliest(spark):
    table = scores(spark, [("a", 1, 0.1, 0.7), ("a", 2, 0.9, 0.7), ("a", 3, 0.9, 0.6)])
    assert rows_of(iterate.best_prompt(table, ["p"])) == [("a", 1, 0.7)]


def test_effects(spark):
    table = scores(spark, [("a", i + 1, 0.0, v) for i, v in enumerate([0.5, 0.6, 0.6, 0.4, None, 0.3])])
    got = [r["effect_of_changes"] for r in iterate.effect_of_change(table, ["p"]).orderBy("iteration").collect()]
    assert got == [iterate.NOT_APPLICABLE, iterate.IMPROVED, iterate.UNCHANGED, iterate.DECREASED] + [
        iterate.NOT_APPLICABLE
    ] * 2


def test_examples(spark):
    rows = [("p", i, i % 4, 0 if i % 3 == 0 else i % 4) for i in range(300)]
    df = spark.createDataFrame(rows, "p string, i int, gt int, model_pred int")
    out = iterate.pick_examples(df, ["p"], "i", n_examples=10, error_share=0.6)
    wrong = [i for _, i, g, m in rows if g != m][:6]
    right = [i for _, i, g, m in rows if g == m][:4]
    got = out.collect()
    assert sorted(r["i"] for r in got if r["is_mistake"]) == wrong
    assert sorted(r["i"] for r in got if not r["is_mistake"]) == right


def test_ledger(spark):
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    # Two runs at each time, told apart by their id.
    runs = spark.createDataFrame([(day(n // 2 * 9), n, n / 1000) for n in range(20)], "at timestamp, run int, total_cost double")
    done = cost.ledger(runs.repartition(5), "at", "run")
    got = [r["cumulative_cost"] for r in done.orderBy("at", "run").collect()]
    assert got == pytest.approx([sum(range(n + 1)) / 1000 for n in range(20)])
    assert done.columns == ["at", "run", "total_cost", "cumulative_cost"]
    assert cost.ledger(runs.limit(0), "at", "run").count() == 0


def test_running_sums_over_many_stretches(spark):
    rows = [(g, i, (i * 7 + (g or 5)) % 11) for g in (None, 1, 2) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, i int, v long").repartition(6)
    got = {(r["g"], r["i"]): r["v_upto"] for r in spread.running_sums(df, ["g"], ["i"], ["v"]).collect()}
    for g in (None, 1, 2):
        total = 0
        for _, i, v in (r for r in rows if r[0] == g):
            total += v
            assert got[g, i] == total


def test_tiles_meet_every_pair_once(spark):
    rows = [(g, i) for g, n in ((None, 90), (1, 4), (2, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g int, i int").withColumn("at", F.col("i"))
    dealt = spread.blocks(df, ["g"], F.col("at"), F.col("at"), 16)
    seen = {}
    for r in spread.tiles(dealt, ["g"]).collect():
        same = r["i"] == r["j"]
        for x in r["left"]:
            for y in r["right"]:
                if not same or x < y:
                    pair = r["g"], min(x, y), max(x, y)
                    seen[pair] = seen.get(pair, 0) + 1
    want = {(g, x, y) for g, x in rows for h, y in rows if g == h and x < y}
    assert set(seen) == want and set(seen.values()) == {1}


# --- scanning replies -----------------------------------------------------------------


def test_scanner_knows_strings_comments_and_depth(spark):
    cases = {
        '{"a": 1} and {"b": {"c": 2}}': ['{"a": 1}', '{"b": {"c": 2}}'],
        '{"u": "http://x/*y*/#z"}': ['{"u": "http://x/*y*/#z"}'],
        '{"a": 1 // {one}\n, "b": 2 # }\n}': ['{"a": 1 \n, "b": 2 \n}'],
        '{"a": /* } */ 3}': ['{"a":  3}'],
        r'{"a": "quote \" and } brace"} tail }': [r'{"a": "quote \" and } brace"}'],
        '{"never": {"closed": 1}': [],
        'nothing': [],
        '': [],
        '{}': ['{}'],
        'é日 {"é": "日"} 😀': ['{"é": "日"}'],
    }
    for text, want in cases.items():
        row = spark.createDataFrame([(text,)], "t string").select(scanner.objects(F.col("t")).alias("o")).first()
        assert row["o"] == want, text
    assert spark.createDataFrame([(None,)], "t string").select(scanner.objects(F.col("t")).alias("o")).first()["o"] is None


def test_store_asks_each_prompt_once(spark, tmp_path):
    log, store = tmp_path / "calls", str(tmp_path / "store")

    def annotator(fails):
        def ask(prompt):
            with open(log, "a") as out:
                out.write(f"{prompt}\n")
            if fails and prompt.startswith("b"):
                raise RuntimeError("busy")
            return f"reply to {prompt}", (len(prompt), 1)

        return ask

    rows = [(i, p) for i, p in enumerate(["a1", "b1", "a1", "b2", "", None, "a2"])]
    df = spark.createDataFrame(rows, "i int, prompt string").repartition(3)
    first = reply_store.annotate_stored(df, annotator(True), store, n_completions=2, partitions=3)
    got = {(r["i"], r["completion_no"]): r for r in first.collect()}
    assert len(got) == 14 and sorted(log.read_text().split("\n")[:-1]) == sorted(["a1", "b1", "b2", "", "a2"] * 2)
    assert got[1, 2]["error"] == "busy" and got[1, 2]["response_text"] is None and got[0, 1]["response_text"] == "reply to a1"
    log.write_text("")
    again = reply_store.annotate_stored(df, annotator(False), store, n_completions=2)
    got = {(r["i"], r["completion_no"]): r for r in again.collect()}
    assert sorted(log.read_text().split()) == ["b1", "b1", "b2", "b2"]
    assert got[1, 1]["response_text"] == "reply to b1" and got[1, 1]["calls"] == 2 and got[0, 1]["calls"] == 1
    log.write_text("")
    reply_store.annotate_stored(df, annotator(False), store, n_completions=2).collect()
    assert log.read_text() == ""
    reply_store.annotate_stored(df.where("i = 0"), annotator(False), store, tag="other").collect()
    assert log.read_text().split() == ["a1"]


def test_text_and_number_labels(spark):
    texts = ["Label: Good.", 'label - "very good",', "no label", 'say {"Label": "x"}', None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(replies.text_code(F.col("t"), "Label")).collect()]
    assert got == ["Good", "very good", None, 'x"}', None]
    assert df.select(replies.text_code(F.col("t"))).first()[0] == "Label: Good"
    values = spark.createDataFrame([("score 3.5",), ("none",), ("-2",), (None,)], "v string")
    assert [r[0] for r in values.select(replies.numeric_or_text(F.col("v"), "Integer")).collect()] == ["3", "none", "2", None]
    assert [r[0] for r in values.select(replies.numeric_or_text(F.col("v"), "Float")).collect()] == ["3.5", "none", "-2.0", None]


# --- labels in increments -------------------------------------------------------------


def test_increments_do_not_shuffle_the_snapshot(spark):
    at = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=n)
    shape = "event_id long, item_id long, rater string, ts timestamp, label string, invalid boolean"
    first = spark.createDataFrame([(1, 1, "a", at(5), "x", False), (2, 1, "b", at(1), "", True), (3, 2, "a", at(1), "y", None)], shape)
    second = spark.createDataFrame([(4, 1, "a", at(3), "late", False), (5, 2, "a", at(1), "z", True), (6, 3, "b", at(2), "new", False), (7, 1, "b", at(9), "q", False)], shape)
    labels = label_state.snapshot(first, "item_id", buckets=4)
    merged = label_state.with_increment(labels, second, "item_id")
    plan = merged._jdf.queryExecution().executedPlan().toString()
    joined = plan.index("SortMergeJoin")
    # Events are dealt by rater and item, then by item; the snapshot is read as it lies.
    assert plan[joined:].count("Exchange") == 2 and plan.count("Exchange") == 2 and "Bucketed: true" in plan
    labels = label_state.apply_increment(labels, second, "item_id", buckets=4)
    docs = spark.createDataFrame([(1, "own"), (2, None), (3, None), (4, "own")], "item_id long, Rater_a string")
    got = {r["item_id"]: r for r in label_state.apply_snapshot(docs, labels, "item_id", ["a", "b"]).collect()}
    assert [(got[i]["Rater_a"], got[i]["Rater_b"]) for i in (1, 2, 3, 4)] == [("x", "q"), ("z", None), (None, "new"), ("own", None)]
    assert [(got[i]["Invalid_a"], got[i]["Invalid_b"]) for i in (1, 2, 3, 4)] == [(False, True), (True, False), (False, False), (False, False)]


# --- prompts, generation --------------------------------------------------------------


def test_prompt_ends_with_sample_object(spark):
    prompt = spark.range(1).select(
        prompts.annotation_prompt(F.lit("t: x"), {"t": "Text"}, "Book", "Ex", ["R", "C"])
    ).first()[0]
    assert "- \"t\": Text\n" in prompt and "\nt: x\n" in prompt
    tail = prompt[prompt.index("{") : prompt.rindex("}") + 1]
    assert json.loads(tail) == {"R": prompts.SAMPLE_VALUE, "C": prompts.SAMPLE_VALUE}


def test_work_list_and_blueprints(spark):
    src = spark.createDataFrame([("a --- b\n---\n\n--- c",)], "text string")
    table = prompts.blueprint_table(src.withColumn("k", F.lit(1)), "k", "text")
    assert rows_of(table, "blueprint_no") == [
        (1, 1, "Blueprint_1", "a"), (1, 2, "Blueprint_2", "b"), (1, 3, "Blueprint_3", "c")
    ]
    assert [r["generation_id"] for r in generate.work_list(src, 3).collect()] == [1, 2, 3]


def test_merge_keeps_failed_rows(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "generation_id int")
    got = spark.createDataFrame([(1, '{"A": 1}'), (2, "?")], "generation_id int, response_text string")
    merged = generate.merge_annotations(rows, got, "generation_id", ["A"])
    assert rows_of(merged, "generation_id") == [(1, "1", True), (2, "", False), (3, "", False)]
    assert rows_of(generate.annotation_outcome(merged)) == [(1, 2)]


# --- files ------------------------------------------------------------------------------


def test_encoding_fallback(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('id;t\n1;"café\nau lait"\n'.encode("utf-8"))
    (tmp_path / "b.csv").write_bytes("id;t\n2;déjà\n".encode("latin-1"))
    assert sorted(r["utf8"] for r in delimited.file_encodings(spark, str(tmp_path)).collect()) == [False, True]
    got = delimited.load_table(spark, str(tmp_path), delimiter=";", multiline=True)
    assert rows_of(got, "id") == [("1", "café\nau lait"), ("2", "déjà")]
    with pytest.raises(ValueError, match="unsupported"):
        delimited.load_table(spark, str(tmp_path), "xlsx")


def test_names_and_types_of_mixed_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("clé;t;n\n1;日本 é;7\n2;;\n".encode("utf-8"))
    got = delimited.read_any_encoding(spark, str(tmp_path))
    assert got.columns == ["clé", "t", "n"] and rows_of(got, "clé") == [("1", "日本 é", "7"), ("2", None, None)]
    (tmp_path / "b.csv").write_bytes("clé;t;n\n3;déjà;8\n".encode("latin-1"))
    typed = delimited.read_any_encoding(spark, str(tmp_path), schema="k int, t string, n double")
    assert rows_of(typed, "k") == [(1, "日本 é", 7.0), (2, None, None), (3, "déjà", 8.0)]


def test_large_files_are_split(spark, tmp_path):
    (tmp_path / "big.csv").write_text("a;b\n" + "".join(f"{i};{'x' * 80}\n" for i in range(40000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400000")
    try:
        assert delimited.read_csv(spark, str(tmp_path)).rdd.getNumPartitions() > 4
        assert delimited.read_any_encoding(spark, str(tmp_path)).count() == 40000
        assert delimited.read_csv(spark, str(tmp_path), multiline=True).rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_quotes_gaps_and_separators(spark, tmp_path):
    data = [(1, 'say "hi"; ok', None), (2, " padded ", 3), (3, "line\nbreak", None)]
    df = spark.createDataFrame(data, "i int, t string, n int")
    path = str(tmp_path / "out")
    delimited.write_csv(df, path)
    assert rows_of(delimited.read_csv(spark, path, schema=df.schema, multiline=True), "i") == data


def test_results_without_and_with_verbatim(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Verbatim,code\nhello,1\n")
    (tmp_path / "b.csv").write_text("code,note\n1,x\n")
    (tmp_path / "c.csv").write_text("Verbatim,code\n")
    (tmp_path / "d.csv").write_text("")
    verbatims, coding = delimited.read_results(spark, str(tmp_path / "a.csv"))
    assert rows_of(verbatims) == [("hello",)] and rows_of(coding) == [("1",)]
    verbatims, coding = delimited.read_results(spark, str(tmp_path / "b.csv"))
    assert verbatims is None and rows_of(coding) == [("1", "x")]
    verbatims, coding = delimited.read_results(spark, str(tmp_path / "c.csv"))
    assert rows_of(verbatims) == [] and coding.columns == ["code"]
    with pytest.raises(ValueError, match="empty or corrupted"):
        delimited.read_results(spark, str(tmp_path / "d.csv"))


def test_config_keeps_only_selected_columns(spark, tmp_path):
    config = ProjectConfig.from_dict({
        "selected_columns": ["a", "b"], "column_renames": {"a": "x", "z": "y"},
        "column_descriptions": {"x": "first", "b": "second", "a": "gone"}, "text_columns": ["a"],
        "annotation_columns": ["r"], "unknown_key": 1,
    })
    assert config.column_renames == {"a": "x", "b": "b"}
    assert config.column_descriptions == {"x": "first", "b": "second"}
    config.save(spark, str(tmp_path / "c"))
    assert ProjectConfig.load(spark, str(tmp_path / "c")) == config
    df = spark.createDataFrame([(" é ", 1, 1), ("u", 2, None)], "a string, b int, r int")
    assert rows_of(config.entry(config.prepare(df))) == [("e", 1, 1, "x: e\nb: 1")]


def test_scratch_uses_the_configured_folder():
    from types import SimpleNamespace

    from accordant.session import scratch_path, shared_dir

    conf = {"spark.checkpoint.dir": "hdfs://shared/area/"}
    session = SimpleNamespace(conf=SimpleNamespace(get=conf.get))
    assert shared_dir(session) == "hdfs://shared/area"
    assert scratch_path(session, "x").startswith("hdfs://shared/area/x-")


def test_rater_profile(spark):
    from accordant.operators.alttest import rater_profile

    df = spark.createDataFrame([(1, "2"), (None, "2.5"), (3, "")], "a int, b string")
    got = {r["rater"]: (r["n_labels"], r["kinds"], r["mixed_types"]) for r in rater_profile(df, ["a", "b"]).collect()}
    assert got == {"a": (2, ["int"], True), "b": (2, ["float", "int"], True)}


def test_early_stop(spark):
    rows = [("p", it, "train", 1, 1, 1, 1 if it == 2 else 0) for it in (1, 2, 3)]
    df = spark.createDataFrame(
        rows, "prompt_name string, prompt_iteration int, split string, a int, b int, c int, model_pred int"
    )
    out = iterate.before_early_stop(df, Ratings.of("abc"), ["prompt_name"])
    assert rows_of(out, "prompt_iteration") == [("p", 1, 1), ("p", 2, 0)]
