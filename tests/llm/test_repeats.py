"""Removal of repeated passages against a set of all windows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from accordant.llm import repeats


def expected(docs, width=100):
    """(id, bytes, removed, spans, digest of the rest) per document, in reading order."""
    seen, out = set(), []
    for doc_id, text in docs:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, np.int8)
        for i in range(len(data) - width + 1):
            window = data[i : i + width]
            if window in seen:
                gone[i : i + width] = 1
            seen.add(window)
        n_spans = int((np.diff(np.append(0, gone)) == 1).sum())
        rest = bytes(b for b, g in zip(data, gone) if not g)
        out.append((doc_id, len(data), int(gone.sum()), n_spans, hashlib.sha256(rest).hexdigest()))
    return out


def found(docs, **options):
    return [
        (r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest())
        for r in repeats.drop_repeats(docs, **options).collect()
    ]


def test_family_sees_what_came_before():
    rng = random.Random(1)
    data = bytes(rng.choice(b"ab\x00") for _ in range(6000))
    for width in (8, 11):
        family, seen, want, got = repeats.IndexFamily(width), set(), [], []
        at = 0
        while at + width <= len(data):
            n = min(rng.randint(1, 400), len(data) - width + 1 - at)
            got += family.add(data, np.arange(at, at + n)).tolist()
            for i in range(at, at + n):
                want.append(data[i : i + width] in seen)
                seen.add(data[i : i + width])
            at += n
        assert got == want
        sizes = list(map(len, family.levels))
        assert sum(sizes) == len(seen) and all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))
        assert all((level[1:] > level[:-1]).all() for level in family.levels)


def test_equal_windows_have_equal_anchors():
    rng = random.Random(2)
    shared = bytes(rng.choice(b"abcd ") for _ in range(300))
    pieces = [bytes(rng.choice(b"abcd ") for _ in range(rng.randint(0, 250))) + shared + bytes(rng.choice(b"abcd ") for _ in range(50)) for _ in range(20)]
    pieces += [b"", b"=" * 150, b"=" * 1000, b"x" * 99, b"ab" * 80]
    anchors, windows = {}, 0
    for piece, first, count, anchor, twice in zip(*repeats.runs(pieces)):
        inside = [pieces[piece][i : i + 100] for i in range(first, first + count)]
        assert twice or len(set(inside)) == len(inside)
        for w in inside:
            assert len(w) == 100 and anchors.setdefault(w, anchor) == anchor
        windows += count
    assert windows == sum(max(0, len(p) - 99) for p in pieces)


def test_long_texts_are_cut_between_windows(monkeypatch):
    monkeypatch.setattr(repeats, "STRETCH", 500)
    texts = [b"", bytes(range(256)) * 9, b"short", b"y" * 99, b"z" * 600]
    windows = [(n, o + i) for numbers, offsets, pieces in repeats.stretches(texts) for n, o, p in zip(numbers, offsets, pieces) for i in range(len(p) - 99)]
    assert sorted(windows) == [(n, i) for n, t in enumerate(texts) for i in range(len(t) - 99)] and len(set(windows)) == len(windows)


def test_registered_query(spark):
    import __spark_entry__ as contract

    sf = "/root/testdata/sf0.001"
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = [tuple(r) for r in contract.queries()["op12_repeats"](spark, sf).collect()]
    want = expected(docs)
    assert sorted(got) == want
    assert sum(r[2] for r in want) > 0


@pytest.mark.parametrize("hot", [1024, 3])
def test_odd_rows(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdé日") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, long = text(60), text(9000)
    docs = [(None, text(30) + shared), (1, shared + text(20)), (2, ""), (3, None), (4, "=" * 700), (5, "=" * 120 + text(5)), (6, long)]
    docs += [(7, text(3) + long[5000:20000] + text(3)), (8, shared[:99]), (9, shared[1:102]), (11, "same " * 40), (11, "same " * 40), (12, "\x00" * 300)]
    docs += [(20 + i, text(rng.randint(0, 9)) + shared[rng.randint(0, 60) :]) for i in range(30)]
    rows = docs[:]
    rng.shuffle(rows)
    df = spark.createDataFrame([(a, b, "theirs", 1) for a, b in rows], "doc_id long, text string, spans string, row int")  # clashing names
    key = lambda r: (r[0] is not None, r)
    assert sorted(found(df), key=key) == sorted(expected(docs), key=key)
    assert found(df.limit(0)) == []


def test_other_width_and_names(spark):
    docs = [(i, t) for i, t in enumerate(["the cat sat on the mat", "a cat sat on the hat", "the the the the the"])]
    df = spark.createDataFrame(docs, "k long, body string")
    assert sorted(found(df, id_col="k", text_col="body", width=8, gram=4)) == expected(docs, 8)
    with pytest.raises(ValueError):
        repeats.drop_repeats(df, id_col="k", text_col="body", gram=20)
