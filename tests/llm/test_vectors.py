"""Vector operators against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from accordant.llm import near_vectors, topk
from accordant.llm.components import components

INF, NAN = float("inf"), float("nan")
BAD = [(900, None), (901, [0.0] * 8), (902, [1.0] * 7 + [NAN]), (903, [INF] + [0.0] * 7), (904, [1.0] * 7 + [None]), (905, [])]


def rows_with_copies(seed, n=300, dim=8):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    base[n // 2 : 3 * n // 4] = base[7] + 0.15 * rng.normal(size=(n // 4, dim))  # a dense group
    base[3 * n // 4 :: 3] = base[11]  # exact copies
    base[3 * n // 4 + 1 :: 3] *= 1e-150  # lengths don't matter
    return [(i, [float(x) for x in v]) for i, v in enumerate(base)]


@pytest.mark.parametrize("options", [{}, {"chunk": 16}, {"blocks": 3, "axes": 1, "chunk": 40}, {"blocks": 20, "axes": 1}])
def test_near_vectors(spark, options):
    rows = rows_with_copies(3)
    df = spark.createDataFrame([(*r, "x") for r in [*rows, *BAD, (None, [1.0] * 8), (906, [1.0, 2.0])]], "vec_id long, embedding array<double>, component_id string")
    got = {r["vec_id"]: r for r in near_vectors.near_vectors(df.repartition(3), **options).collect()}
    v = np.array([r[1] for r in rows])
    v = v / np.abs(v).max(1, keepdims=True)
    cosine = (v @ v.T) / np.linalg.norm(v, axis=1)[:, None] / np.linalg.norm(v, axis=1)
    link = cosine >= 0.9
    np.fill_diagonal(link, False)
    root = np.arange(len(v))
    for _ in range(len(v)):
        root = np.array([min([root[i], *root[link[i]]]) for i in range(len(v))])
    for i in range(len(v)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (link[i].sum(), root[i], root[i] == i), i
    for i in [b[0] for b in BAD] + [906]:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert (got[None]["n_links"], got[None]["component_id"], got[None]["kept"]) == (0, None, False)


def test_no_usable_vector(spark):
    df = spark.createDataFrame(BAD, "vec_id long, embedding array<float>")
    assert near_vectors.near_vectors(df).where("kept and n_links = 0").count() == len(BAD)
    assert near_vectors.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("k", [1, 5, 400])
def test_top_k(spark, k):
    rows = rows_with_copies(5)
    df = spark.createDataFrame([*rows, *BAD[2:5], (None, [1.0] * 8), (950, [1.0] * 3)], "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, k=k).collect()
    ids = [r[0] for r in rows]
    whole = [[math.floor(256 * x) for x in r[1]] for r in rows]
    want = set()
    for q in range(0, len(rows), 50):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], whole[c])), ids[c]) for c in range(len(rows)) if c != q)
        want |= {(q, n + 1, c, -s) for n, (s, c) in enumerate(scores[:k])}
    assert {tuple(r) for r in got} == want
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("repeats", [1, 4, 8])
def test_top_k_with_repeats_of_the_query(spark, repeats):
    rng = np.random.default_rng(repeats)
    vectors = rng.normal(size=(300, 64))
    vectors[1:40] = vectors[0] + 0.05 * rng.normal(size=(39, 64))  # near the query
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame([rows[0]] * (repeats - 1) + rows, "vec_id long, embedding array<double>")
    got = [(r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    whole = np.floor(256 * vectors).astype(np.int64)
    best = sorted((-int(whole[0] @ whole[i]), i) for i in range(1, 300))[:5]
    assert got == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(0)
    exact = np.floor(256 * rng.normal(size=(2000, 16)))
    file = topk.CellFile(np.arange(2000), exact, 4)
    queries = np.floor(256 * rng.normal(size=(5, 16)))
    middle, reach = file.bounds(queries)
    truth = queries @ exact.T
    assert (np.abs(truth - middle) <= reach[:, None]).all()
    assert (middle + reach[:, None] >= np.sort(truth)[:, -5:-4]).mean() < 0.5


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(200 - i, 199 - i) for i in range(40)]
    star = [(500, 500 + i) for i in range(1, 30)] + [(7000, 520)]
    links = spark.createDataFrame([*chain, *star, (9, 9), (None, 4)], "src long, dst long")
    got = {r["id"]: r["root"] for r in components(links).collect()}
    want = {i: 0 for i in range(61)} | {i: 160 for i in range(160, 201)} | {i: 500 for i in [*range(500, 530), 7000]}
    assert got == want
    assert components(links.limit(0)).count() == 0
