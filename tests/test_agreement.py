"""Agreement statistics against worked examples, brute force and invariants."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from accordant.operators import alpha, alttest, classification, kappa, long_form, patterns, resample, spread
from accordant.plans import tables
from accordant.schema import Ratings

KEYS = ["prompt_name", "iteration", "run", "split"]


def facts(spark, rows, raters, run_of=lambda i: 1, split_of=lambda i: "train", dtype="bigint"):
    """Rows of (rater..., model) as a results table."""
    names = [*raters, "model_pred"]
    data = [("p", 1, run_of(i), split_of(i), i, *row) for i, row in enumerate(rows)]
    schema = "prompt_name string, iteration int, run int, split string, item_id bigint, "
    schema += ", ".join(f"{n} {dtype}" for n in names)
    return spark.createDataFrame(data, schema)


def brute_kappa(a, b, labels, weights):
    place = {v: i for i, v in enumerate(labels)}
    pairs = [(place[x], place[y]) for x, y in zip(a, b) if x in place and y in place]
    k = len(labels)
    o = np.zeros((k, k))
    for i, j in pairs:
        o[i, j] += 1
    i, j = np.indices((k, k))
    w = {None: (i != j) * 1.0, "linear": abs(i - j) * 1.0, "quadratic": (i - j) ** 2.0}[weights]
    e = np.outer(o.sum(1), o.sum(0)) / o.sum()
    return 1 - (w * o).sum() / (w * e).sum()


def brute_alpha(matrix, level):
    """Alpha from the definition, over all pairable values."""
    units = [[v for v in unit if v is not None] for unit in matrix]
    units = [u for u in units if len(u) >= 2]
    values = sorted({v for u in units for v in u})
    n_of = {v: sum(u.count(v) for u in units) for v in values}
    n = sum(n_of.values())

    def delta(a, b):
        if a == b:
            return 0.0
        if level == "nominal":
            return 1.0
        if level == "interval":
            return (a - b) ** 2.0
        if level == "ratio":
            return ((a - b) / (a + b)) ** 2
        low, high = sorted((a, b))
        inside = sum(n_of[v] for v in values if low <= v <= high)
        return (inside - (n_of[a] + n_of[b]) / 2) ** 2

    observed = sum(
        sum(delta(a, b) for a, b in itertools.permutations(u, 2)) / (len(u) - 1) for u in units
    )
    expected = sum(n_of[a] * n_of[b] * delta(a, b) for a in values for b in values) / (n - 1)
    return 1 - observed / expected


def one_kappa(spark, a, b, labels=None, weights=None):
    rows = [(x, x, y) for x, y in zip(a, b)]
    table = kappa.pairwise_kappas(facts(spark, rows, ["r", "s"]), Ratings.of(["r", "s"]), labels, weights)
    return table.where("pair = 'model_vs_r'").first()["kappa"]


def test_kappa_examples(spark):
    a, b = [0, 1, 2, 1, 0], [0, 2, 2, 1, 0]
    assert one_kappa(spark, a, b) == pytest.approx(0.7059, abs=5e-5)
    assert one_kappa(spark, a, b, [0, 1, 2], "linear") == pytest.approx(0.7826, abs=5e-5)
    assert one_kappa(spark, a, a) == 1.0
    assert one_kappa(spark, a, [2, 0, 1, 2, 1]) == pytest.approx(-0.4706, abs=5e-5)


def test_kappa_undefined_is_null(spark):
    assert one_kappa(spark, [1, 1], [1, 1]) is None


@pytest.mark.parametrize("weights", [None, "linear", "quadratic"])
@pytest.mark.parametrize("labels", [[0, 1, 2, 3], [3, 1, 0], [2, 0, 9, 1, 3]])
def test_kappa_brute_force(spark, weights, labels):
    rng = random.Random(5)
    a = [rng.randrange(4) for _ in range(200)]
    b = [x if rng.random() < 0.6 else rng.randrange(4) for x in a]
    want = brute_kappa(b, a, labels, weights)
    assert one_kappa(spark, a, b, labels, weights) == pytest.approx(want, abs=1e-12)


def test_kappa_text_labels(spark):
    a, b = list("xyzyx"), list("xzzyx")
    rows = [(x, x, y) for x, y in zip(a, b)]
    table = kappa.pairwise_kappas(
        facts(spark, rows, ["r", "s"], dtype="string"), Ratings.of(["r", "s"]), ["x", "y", "z"], "linear"
    )
    assert table.where("pair = 'model_vs_r'").first()["kappa"] == pytest.approx(0.7826, abs=5e-5)


def test_kappa_symmetric(spark):
    rng = random.Random(9)
    a = [rng.randrange(3) for _ in range(60)]
    b = [rng.randrange(3) for _ in range(60)]
    for w in (None, "linear", "quadratic"):
        assert one_kappa(spark, a, b, [0, 1, 2], w) == pytest.approx(
            one_kappa(spark, b, a, [0, 1, 2], w), abs=1e-12
        )


def test_golden_kappa_and_alpha(spark):
    rows = tables.facts(spark, "/root/testdata/sf0.01").where("prompt_name = 'p_a' AND run = 1")
    table = kappa.pairwise_kappas(rows, tables.RATINGS, [0, 1, 2], "quadratic").where("split = 'train'")
    got = {r["pair"]: r["kappa"] for r in table.collect()}
    assert got["model_vs_rater_a"] == pytest.approx(0.637983316, abs=1e-9)
    assert got["model_vs_rater_b"] == pytest.approx(0.547146557, abs=1e-9)
    assert got["rater_a_vs_rater_b"] == pytest.approx(0.493352700, abs=1e-9)
    human = alpha.panel_alphas(rows, tables.RATINGS).where("panel = 'human'").first()["alpha"]
    assert human == pytest.approx(0.505719348, abs=1e-9)


KRIPPENDORFF = """
1 2 3 3 2 1 4 1 2 . . .
1 2 3 3 2 2 4 1 2 5 . 3
. 3 3 3 2 3 4 2 2 5 1 .
1 2 3 3 2 4 4 1 2 5 1 .
"""


@pytest.mark.parametrize(
    "level, expected", [("nominal", 0.743), ("ordinal", 0.815), ("interval", 0.849), ("ratio", 0.797)]
)
def test_alpha_published_example(spark, level, expected):
    coders = [
        [None if x == "." else int(x) for x in line.split()] for line in KRIPPENDORFF.strip().splitlines()
    ]
    rows = list(zip(*coders))
    table = facts(spark, rows, ["a", "b", "c"])
    got = alpha.krippendorff_alpha(table, ["a", "b", "c", "model_pred"], level).first()["alpha"]
    assert got == pytest.approx(expected, abs=5e-4)
    assert got == pytest.approx(brute_alpha(rows, level), abs=1e-12)


@pytest.mark.parametrize("level", alpha.LEVELS)
def test_alpha_brute_force_with_gaps(spark, level):
    rng = random.Random(3)
    rows = []
    for _ in range(150):
        y = rng.randrange(1, 6)
        rows.append(
            tuple(None if rng.random() < 0.3 else max(1, y + rng.choice((-1, 0, 0, 1))) for _ in range(4))
        )
    got = alpha.krippendorff_alpha(facts(spark, rows, ["a", "b", "c"]), ["a", "b", "c", "model_pred"], level)
    assert got.first()["alpha"] == pytest.approx(brute_alpha(rows, level), abs=1e-12)


def test_alpha_undefined_cases(spark):
    columns = ["a", "b", "c", "model_pred"]
    for rows in (
        [(1, 1, 1, 1), (1, 1, None, 1)],  # one value
        [(1, 2, 1, None)],  # one item
        [(1, None, None, None), (2, None, None, None)],  # one rater
    ):
        found = alpha.krippendorff_alpha(facts(spark, rows, ["a", "b", "c"]), columns, "nominal")
        assert found.first()["alpha"] is None
    # A second item with a single rating is enough.
    rows = [(1, 2, None, None), (1, None, None, None)]
    found = alpha.krippendorff_alpha(facts(spark, rows, ["a", "b", "c"]), columns, "nominal")
    assert found.first()["alpha"] == pytest.approx(brute_alpha(rows, "nominal"))


def test_model_that_copies_a_rater(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(80):
        r = [rng.randrange(3) for _ in range(3)]
        rows.append((*r, r[1]))
    table = alpha.panel_alphas(facts(spark, rows, ["a", "b", "c"]), Ratings.of("abc"))
    got = {r["panel"]: r["alpha"] for r in table.collect()}
    assert got["model_for_b"] == pytest.approx(got["human"], abs=1e-12)


def test_panels_need_three_raters():
    with pytest.raises(ValueError):
        alpha.human_and_model_panels(Ratings.of(["a", "b"]))


def noisy_rows(n, seed=1, gap=0.1):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        y = rng.randrange(3)
        rows.append(
            tuple(
                None if i < 3 and rng.random() < gap else y if rng.random() < 0.75 else rng.randrange(3)
                for i in range(4)
            )
        )
    return rows


def brute_bootstrap(rows, n_boot, seed=0, level="nominal"):
    rng = np.random.default_rng(seed)
    panels = [(0, 1, 2), (1, 2, 3), (0, 2, 3), (0, 1, 3)]
    out = []
    for _ in range(n_boot):
        drawn = [rows[i] for i in rng.integers(0, len(rows), len(rows))]
        a = [brute_alpha([[r[i] for i in p] for r in drawn], level) for p in panels]
        out.append(np.mean(a[1:]) - a[0])
    return np.percentile(out, [5, 50, 95])


@pytest.mark.parametrize("level", ["nominal", "ordinal", "interval"])
def test_bootstrap_against_brute_force(spark, monkeypatch, level):
    rows = noisy_rows(120)
    table = facts(spark, rows, ["a", "b", "c"]).repartition(3)
    ratings = Ratings.of("abc")
    reps = resample.bootstrap(table, ratings, level, n_bootstrap=1500, seed=4)
    key = lambda r: r["rep"]
    got = [r["difference"] for r in sorted(reps.collect(), key=key)]
    assert len(got) == 1500
    want = brute_bootstrap(rows, 1500, level=level)
    assert np.percentile(got, [5, 50, 95]) == pytest.approx(want, abs=0.012)
    # The same draws however rows are dealt and wherever the tree is cut.
    monkeypatch.setattr(resample, "LEAVES_PER_BUCKET", 3)
    again = resample.bootstrap(table.repartition(7), ratings, level, n_bootstrap=1500, seed=4)
    assert [r["difference"] for r in sorted(again.collect(), key=key)] == pytest.approx(got, abs=1e-9)


def test_tree_deals_all_draws():
    rng = np.random.default_rng(1)
    spots = np.sort(rng.integers(0, 2**63 - 1, 400))
    spots[20:23] = spots[20]  # one hash for several
    sizes = rng.integers(1, 30, 400)
    drawn = resample.split_draws(spots, sizes, np.full(300, float(sizes.sum())), 0, [7])
    assert (drawn.sum(axis=1) == sizes.sum()).all() and (drawn >= 0).all()
    assert drawn.mean(axis=0) == pytest.approx(sizes, rel=0.5, abs=1.0)
    assert drawn.sum(axis=0).sum() == 300 * sizes.sum()
    # Variance of a multinomial count is close to its mean here.
    assert (drawn.var(axis=0) / sizes).mean() == pytest.approx(1.0, abs=0.05)


@pytest.mark.parametrize("level", ["nominal", "ordinal", "interval", "ratio"])
def test_resample_table_equals_hashed_draws(spark, level):
    table = facts(spark, noisy_rows(90), ["a", "b", "c"])
    ratings = Ratings.of("abc")
    draws = alpha.hashed_resamples(table, "item_id", 6)
    left = alpha.fixed_bootstrap(alpha.resampled_patterns(table, draws, "item_id", ratings), ratings, level)
    right = resample.hashed_bootstrap(table, "item_id", 6, ratings, level)
    key = lambda r: r["rep"]
    a, b = (sorted(x.select("rep", "alpha_human", "alpha_model", "difference").collect(), key=key) for x in (left, right))
    assert [r["rep"] for r in a] == [r["rep"] for r in b] == list(range(1, 7))
    for x, y in zip(a, b):
        assert tuple(x) == pytest.approx(tuple(y), abs=1e-9)


def test_poisson_weights_have_mean_and_variance_one(spark):
    draws = alpha.hashed_resamples(spark.range(2000).withColumnRenamed("id", "item_id"), "item_id", 50)
    row = draws.agg(F.avg("weight"), F.var_pop("weight")).first()
    assert row[0] == pytest.approx(1.0, abs=0.02)
    assert row[1] == pytest.approx(1.0, abs=0.04)
    # Replicates must not move together: totals vary as sums of independent draws do.
    sums = [r[0] for r in draws.groupBy("rep").agg(F.sum("weight")).select("sum(weight)").collect()]
    assert 20 < np.std(sums) < 75


def test_percentile_interval_and_summary(spark):
    ratings = Ratings.of("abc")
    table = facts(spark, noisy_rows(200), ["a", "b", "c"], run_of=lambda i: i % 2 + 1)
    reps = resample.bootstrap(table, ratings, "nominal", n_bootstrap=200, seed=1)
    per_run = alpha.non_inferiority(table, ratings, reps, "nominal")
    got = {r["run"]: r for r in per_run.collect()}
    deltas = {
        run: [r["difference"] for r in reps.where(F.col("run") == run).collect()] for run in (1, 2)
    }
    for run, row in got.items():
        low, high = np.percentile(deltas[run], [5, 95])
        assert (row["ci_lower"], row["ci_upper"]) == pytest.approx((low, high))
        assert row["non_inferior"] == (low > -0.05)
    one = alpha.verdict(alpha.across_runs(per_run)).first()
    assert one["n_runs"] == 2
    assert one["alpha_human_std"] == pytest.approx(np.std([r["alpha_human"] for r in got.values()]))
    assert one["verdict"] in ("all", "some", "none")


# --- long form ------------------------------------------------------------------


#: Four people, twelve items, with gaps: the published example of Krippendorff's alpha.
PUBLISHED = ["123321412...", "12332241" + "25.3", ".33323422" + "51.", "12332441" + "251."]


def published_long(spark):
    rows = [(item, f"r{r}", int(v)) for r, line in enumerate(PUBLISHED) for item, v in enumerate(line) if v != "."]
    return spark.createDataFrame(rows, "item int, rater string, value long").repartition(3)


@pytest.mark.parametrize("level, want", [("nominal", 0.743), ("ordinal", 0.815), ("interval", 0.849), ("ratio", 0.797)])
def test_alpha_long_published(spark, monkeypatch, level, want):
    table = published_long(spark)
    row = long_form.alpha_long(table, level).first()
    assert row["alpha"] == pytest.approx(want, abs=6e-4) and row["n_items"] == 12 and row["n_values"] == 5
    monkeypatch.setattr(long_form, "VALUES_PER_BLOCK", 2)  # several tiles
    assert long_form.alpha_long(table, level).first()["alpha"] == pytest.approx(row["alpha"], abs=1e-12)


@pytest.mark.parametrize("level", ["nominal", "ordinal", "interval", "ratio"])
def test_alpha_long_equals_wide(spark, level):
    table = facts(spark, noisy_rows(150), ["a", "b", "c"], run_of=lambda i: i % 2 + 1)
    ratings = Ratings.of("abc")
    panels = alpha.human_and_model_panels(ratings)
    wide = alpha.panel_alphas(table, ratings, level, ["run"])
    long = long_form.panel_alphas_long(long_form.to_long(table.where("split = 'train'"), ratings.columns, ["run"], "item_id"), panels, level, ["run"])
    a, b = ({(r["run"], r["panel"]): r["alpha"] for r in x.collect()} for x in (wide, long))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def test_kept_counts_are_not_broadcast(spark):
    """Unfolded rows look as small as the file they came from; no join may send them to the driver."""
    base = spark.range(2000).selectExpr("id % 2 AS g", "id AS item", "id")
    rows = base.select("g", "item", F.explode(F.array(*[F.lit(c) for c in "abcd"])).alias("rater"), (F.col("id") * 7 % 5).alias("value"))
    plans = [long_form.alpha_long(rows, level, ["g"]) for level in ("ordinal", "interval")]
    plans.append(long_form.wins_long(rows, rows.where("rater = 'a'").select("g", "item", "value"), ["g"]))
    for made in plans:
        assert "BuildLeft" not in made._jdf.queryExecution().toString()


def test_wins_long_leaves_out_raters_of_small_items(spark):
    rows = [("x", "r1", 1), ("x", "r2", 1), ("x", "r3", 0), ("y", "r4", 1), ("y", "r1", 1)]
    ratings = spark.createDataFrame([(0, *r) for r in rows], "g int, item string, rater string, value int")
    guesses = spark.createDataFrame([(0, "x", 1), (0, "y", 1)], "g int, item string, value int")
    out = {r["rater"]: r["n"] for r in long_form.wins_long(ratings, guesses, ["g"]).collect()}
    assert out == {"r1": 1, "r2": 1, "r3": 1}


def test_alpha_long_without_enough(spark):
    shape = "g int, item int, rater string, value double"
    rows = [(1, 1, "a", 2.0), (1, 1, "b", 2.0), (1, 2, "a", 2.0), (1, 2, "b", 2.0)]  # one value
    rows += [(2, 1, "a", 1.0), (2, 1, "b", 3.0), (3, 1, "a", 1.0), (3, 2, "b", 2.0)]  # one item; nothing shared
    rows += [(None, 1, "a", 1e9), (None, 1, "b", 1e9 + 1), (None, 2, "a", 1e9 + 5), (None, 2, "b", 1e9 + 5), (4, 1, "a", None)]
    table = spark.createDataFrame(rows, shape)
    for level in alpha.LEVELS:
        got = {r["g"]: (r["n_items"], r["alpha"]) for r in long_form.alpha_long(table, level, ["g"]).collect()}
        assert got[1] == (2, None) and got[2] == (1, None) and got[3] == (2, None) and 4 not in got
        assert got[None][0] == 2 and 0 < got[None][1] < 1 or level == "nominal"
    near = long_form.alpha_long(table.where("g is null"), "interval").first()["alpha"]
    assert near == pytest.approx(brute_alpha([[0.0, 1.0], [5.0, 5.0]], "interval"), abs=1e-9)  # far from zero
    assert long_form.alpha_long(table.limit(0), "interval", ["g"]).count() == 0


@pytest.mark.parametrize("weights", [None, "linear", "quadratic"])
def test_open_kappa_equals_listed_labels(spark, weights):
    table = facts(spark, noisy_rows(200), ["a", "b", "c"])
    ratings = Ratings.of("abc")
    keys = ["run"]
    counts = patterns.pair_counts(patterns.rating_patterns(table, ratings, keys, listwise=True), ratings, keys)
    listed = {r["pair"]: r for r in kappa.kappas(counts, keys, [0, 1, 2], weights).collect()}
    opened = {r["pair"]: r for r in kappa.open_kappas(counts, ["run", "pair"], weights).collect()}
    assert listed.keys() == opened.keys()
    for pair, r in opened.items():
        assert (r["n_rows"], r["n_equal"]) == (listed[pair]["n_rows"], listed[pair]["n_equal"])
        assert r["kappa"] == pytest.approx(listed[pair]["kappa"], abs=1e-12)


def test_kappa_long_splits_crowded_items(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, f"r{r:02}", rng.choice("xyz")) for i in range(30) for r in range(40) if i < 3 or rng.random() < 0.1] + [(1, "r00", None)]
    table = spark.createDataFrame(rows, "item int, rater string, value string")
    key = lambda r: (r["rater_1"], r["rater_2"])
    whole = sorted(long_form.kappa_long(table, (), "linear").collect(), key=key)
    monkeypatch.setattr(long_form, "RATERS_PER_BLOCK", 7)
    tiled = sorted(long_form.kappa_long(table, (), "linear").collect(), key=key)
    assert len(whole) == 40 * 39 // 2 and whole == tiled


def test_alt_long_equals_wide(spark):
    table = facts(spark, noisy_rows(120), ["a", "b", "c"])
    ratings = Ratings.of("abc")
    long = long_form.to_long(table, ["a", "b", "c"], ["run"], "item_id")
    guesses = table.select("run", F.col("item_id").alias("item"), F.col(ratings.model).alias("value"))
    wide = alttest.alt_summary(table, ratings, ["run"], 0.2).first()
    got = long_form.alt_long(long, guesses, ["run"], 0.2).first()
    assert (got["winning_rate"], got["passed"]) == (wide["winning_rate"], wide["passed"])
    assert got["p_values"] == pytest.approx(wide["p_values"], abs=1e-12)
    assert got["avg_adv_prob"] == pytest.approx(wide["avg_adv_prob"], abs=1e-12)


# --- alternative-annotator test -------------------------------------------------


def brute_wins(rows, metric):
    out = {j: [] for j in range(3)}
    for *r, m in rows:
        for j in range(3):
            others = [r[k] for k in range(3) if k != j and r[k] is not None]
            if r[j] is None or len(others) < 2:
                continue
            if metric == "accuracy":
                f = sum(m == o for o in others) if m is not None else 0
                h = sum(r[j] == o for o in others)
            else:
                if m is None:
                    continue
                f = -sum((m - o) ** 2 for o in others)
                h = -sum((r[j] - o) ** 2 for o in others)
            out[j].append((int(f >= h), int(h >= f)))
    return out


@pytest.mark.parametrize("metric", ["accuracy", "rmse"])
def test_wins_brute_force(spark, metric):
    rows = [(*r[:3], None if i % 11 == 0 else r[3]) for i, r in enumerate(noisy_rows(300, 6))]
    tests = alttest.rater_tests(facts(spark, rows, ["a", "b", "c"]), Ratings.of("abc"), metric=metric)
    wins = brute_wins(rows, metric)
    for row in tests.collect():
        w = np.array(wins["abc".index(row["rater"])])
        assert row["n"] == len(w)
        assert row["rho_f"] == pytest.approx(w[:, 0].mean())
        assert row["rho_h"] == pytest.approx(w[:, 1].mean())
        assert row["rho_f"] + row["rho_h"] >= 1
        d = w[:, 1] - w[:, 0]
        assert row["t"] == pytest.approx((d.mean() - 0.2) / (d.std(ddof=1) / len(d) ** 0.5))


def test_flat_differences(spark):
    ratings = Ratings.of("abc")

    def p_values(rows, epsilon):
        table = alttest.rater_tests(facts(spark, rows, ["a", "b", "c"]), ratings, epsilon=epsilon)
        return [r["p"] for r in table.orderBy("rater_no").collect()]

    assert p_values([(1, 1, 1, 1)] * 5, 0.2) == [0.0] * 3  # always tied, mean 0
    assert p_values([(1, 1, 1, 2)] * 5, 0.2) == [1.0] * 3  # model always worse
    assert p_values([(1, 1, 1, 1)] * 5, 0.0) == [None] * 3  # mean equals epsilon
    assert p_values([(1, 1, 1, 1)], 0.2) == [None] * 3  # a single row


def corrected(spark, p_values, keep_missing=True):
    rows = [("g", i, p) for i, p in enumerate(p_values)]
    table = spark.createDataFrame(rows, "g string, rater_no int, p double")
    out = alttest.by_correction(table, ["g"], 0.05, keep_missing).orderBy("rater_no")
    return [r["rejected"] for r in out.collect()]


def test_by_correction(spark):
    assert corrected(spark, [0.01, 0.04, 0.03, 0.20]) == [False] * 4
    assert corrected(spark, [0.001, 0.03, 0.01]) == [True, False, True]
    # A missing p counts in m within a run (threshold .0227 / 3 * 1) but not across runs.
    assert corrected(spark, [0.012, None, 0.9]) == [False, False, False]
    assert corrected(spark, [0.012, None, 0.9], keep_missing=False) == [True, False, False]


def test_runs_are_averaged_then_corrected(spark):
    ratings = Ratings.of("abc")
    table = facts(
        spark, noisy_rows(400, 2), ["a", "b", "c"], run_of=lambda i: i % 2 + 1,
        split_of=lambda i: "val" if i % 5 == 0 else "train",
    )
    out = {r["run"]: r for r in alttest.alt_across_runs(table, ratings, epsilon=0.1).collect()}
    assert set(out) == {"1", "2", "aggregated"}
    pooled = out["aggregated"]
    for i in range(3):
        mean = np.mean([out[r]["p_values_train"][i] for r in "12"])
        assert pooled["p_values_train"][i] == pytest.approx(mean)
    assert pooled["n_runs"] == 2 and out["1"]["n_runs"] is None
    assert pooled["N_train"] == out["1"]["N_train"] + out["2"]["N_train"]
    assert pooled["avg_adv_prob_val"] == pytest.approx(
        np.mean([out[r]["avg_adv_prob_val"] for r in "12"])
    )


def test_single_run_is_copied(spark):
    table = facts(spark, noisy_rows(200, 2), ["a", "b", "c"])
    out = {r["run"]: r for r in alttest.alt_across_runs(table, Ratings.of("abc")).collect()}
    for name in ("winning_rate_train", "passed_alt_test_train", "avg_adv_prob_train", "p_values_train"):
        assert out["1"][name] == out["aggregated"][name]
    assert out["aggregated"]["N_val"] == 0 and out["aggregated"]["winning_rate_val"] is None


def test_alt_test_needs_three_raters(spark):
    with pytest.raises(ValueError):
        alttest.row_wins(facts(spark, [(1, 1, 1)], ["a", "b"]), Ratings.of("ab"), [])


# --- grains, classification -------------------------------------------------------


def test_per_run_counts_add_up(spark):
    table = tables.facts(spark, "/root/testdata/sf0.001")
    counted = patterns.with_grains(patterns.rating_patterns(table, tables.RATINGS, KEYS, True), True)
    got = {
        (r["prompt_name"], r["run_label"]): r["n"]
        for r in counted.groupBy("prompt_name", "run_label").agg(F.sum("n").alias("n")).collect()
    }
    for p in ("p_a", "p_b"):
        assert got[p, "aggregated"] == sum(got[p, r] for r in "123")


def test_prompt_iteration_names_the_run_rows(spark):
    table = tables.iterative_facts(spark, "/root/testdata/sf0.001")
    out = kappa.kappa_summary(table, tables.RATINGS, [0, 1, 2], show_runs=True).collect()
    rows = {(r["prompt_name"], r["iteration"], r["run"]) for r in out}
    assert ("p_a", 3, "3") in rows and ("p_a", 1, "aggregated") in rows
    assert ("p_a", 3, "aggregated") not in rows
    steps = {(r["iteration"], r["run"]): r["prompt_iteration"] for r in out}
    assert steps[3, "3"] == 3 and steps[1, "aggregated"] is None
    tests = alttest.alt_across_runs(table, tables.RATINGS).collect()
    assert {r["prompt_iteration"] for r in tests if r["run"] != "aggregated"} == {1, 2, 3}


def test_classification_counts(spark):
    truth = [0, 0, 1, 1, 2, 2, 2, 3]
    guess = [0, 1, 1, 9, 2, 0, 2, 0]
    rows = [(t, t, t, g) for t, g in zip(truth, guess)]
    counts = classification.truth_counts(facts(spark, rows, ["a", "b", "c"]), Ratings.of("abc"), KEYS)
    labels = [0, 1, 2, 7]
    per = {r["label"]: r for r in classification.per_class(counts, KEYS, labels).collect()}
    assert (per[1]["correct_count"], per[1]["missed_count"], per[1]["false_positives"]) == (1, 0, 1)
    assert (per[0]["correct_count"], per[0]["false_positives"]) == (1, 1)  # truth 3 is not listed
    assert per[7]["recall"] == 0.0 and per[7]["error_rate"] == 1.0 and per[7]["fp_rate"] == 0.0
    total = classification.global_metrics(counts, KEYS, labels).first()
    assert total["accuracy"] == pytest.approx(4 / 8)
    assert total["recall"] == pytest.approx((1 / 2 + 1 / 2 + 2 / 3 + 0) / 4)
    dist = {r["label"]: r["n_rows"] for r in classification.class_distribution(counts, KEYS, labels).collect()}
    assert dist == {0: 2, 1: 2, 2: 3, 7: 0}


def test_partitioning_changes_nothing(spark):
    table = tables.facts(spark, "/root/testdata/sf0.001")
    outs = []
    for n in (1, 13):
        summary = kappa.kappa_summary(table.repartition(n), tables.RATINGS, [0, 1, 2], show_runs=True)
        outs.append(sorted(map(tuple, summary.select(sorted(summary.columns)).collect()), key=repr))
    assert outs[0] == outs[1]
