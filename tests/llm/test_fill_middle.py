"""Fill-in-the-middle against a plain regular expression."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from accordant.llm import fill_middle

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
ODD = [None, "", "a", "ab cd", "é", "日本語x한", "😀ab😀", "<P> here", "a<S>b", "x<M>", "<", "\x00\x00a\x00", "Zz" * 5000, " " * 9, "a\nb\r\n", "`{@[zZaA", "ab<" * 50]


def parts(text, doc_id, seed=1):
    text, n = text or "", len(UNIT.findall(text or ""))
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    units = UNIT.findall(text)
    form = "plain" if not text or any(m in text for m in fill_middle.MARKS) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
    return n, form, "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])


def test_cuts_of_random_bytes():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abZ é日😀\n<0\x00") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    one, two = (np.array([rng.randrange(2**32) for _ in texts]) for _ in range(2))
    n, a, b, before, inside = fill_middle.cuts([t.encode() for t in texts], one, two)
    for i, t in enumerate(texts):
        units = UNIT.findall(t)
        assert n[i] == len(units)
        low, high = sorted((one[i] % (n[i] + 1), two[i] % (n[i] + 1)))
        x, y = "".join(units[:low]), "".join(units[low:high])
        assert (a[i], b[i], before[i], inside[i]) == (len(x.encode()), len((x + y).encode()), len(x), len(y))


def test_rows_and_round_trip(spark):
    rows = [(i, t, "own", "theirs") for i, t in enumerate(ODD * 8)] + [(None, "no id at all", "own", "x"), (7, "same id", "own", "x"), (7, "same id", "own", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, form string")  # form clashes
    made = fill_middle.fill_in_middle(docs)
    assert made.columns == ["doc_id", "text", "lang", *fill_middle.ADDED]
    got = made.withColumn("again", fill_middle.restored()).collect()
    assert len(got) == len(rows)
    for r in got:
        n, form, x, y, z = parts(r["text"], r["doc_id"])
        assert (r["n"], r["form"], r["again"]) == (n, form, r["text"] or "")
        want = {"plain": r["text"] or "", "psm": f"<P>{x}<S>{z}<M>{y}", "spm": f"<S>{z}<P>{x}<M>{y}"}[form]
        assert r["output"] == want
        assert (r["prefix_chars"], r["middle_chars"]) == ((None, None) if form == "plain" else (len(x), len(y)))
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0


def test_other_settings(spark):
    docs = spark.createDataFrame([(i, "one two three four") for i in range(200)], "k long, body string")
    made = fill_middle.fill_in_middle(docs, id_col="k", text_col="body", seed=5, percent=100, spm_percent=100, marks=("[p]", "[s]", "[m]"))
    rows = made.withColumn("again", fill_middle.restored(("[p]", "[s]", "[m]"))).collect()
    assert {(r["form"], r["again"]) for r in rows} == {("spm", "one two three four")}
    assert len({r["output"] for r in rows}) > 5
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(docs, id_col="k", text_col="body", marks=("aa", "b", "c"))
