"""Column functions on worked examples."""

from __future__ import annotations

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from accordant.functions import labels as L
from accordant.functions import text as X
from accordant.functions.student import t_cdf
from accordant.operators import cost, replies


def values(spark, rows, column, schema="v string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def texts(spark, items, make):
    return values(spark, [(t,) for t in items], make(F.col("v")))


def test_clean_text(spark):
    given = ["  Café ", "Crème brûlée", "naïve", None, " plain\n", "\u2003ﬁn ½ \xa0", "日本"]
    expected = ["Cafe", "Creme brulee", "naive", None, "plain", "fin 12", ""]
    assert texts(spark, given, X.clean_text) == expected


def test_single_line(spark):
    assert texts(spark, ["Hello\nWorld", "Good\rMorning", "a\r\nb"], X.single_line) == [
        "Hello World",
        "Good Morning",
        "a  b",
    ]


def test_split_list(spark):
    assert texts(spark, [" a, b,,c ", "", ","], X.split_list) == [["a", "b", "c"], [], []]


def test_split_blocks(spark):
    got = texts(spark, ["a --- b\n---\n\n--- c"], X.split_blocks)
    assert got == [["a", "b", "c"]]


def test_word_count(spark):
    assert texts(spark, ["a b  c\n d", "", "   "], X.word_count) == [4, 0, 0]


def test_template(spark):
    fill = lambda c: X.fill_template("{{x}} <{verbatim_text}> {verbatim_text}!", {"verbatim_text": c})
    assert texts(spark, ["{a} {verbatim_text}"], fill) == [
        "{x} <{a} {verbatim_text}> {a} {verbatim_text}!"
    ]
    for broken in ("{other}", "a } b", "{verbatim_text"):
        with pytest.raises(ValueError):
            X.fill_template(broken, {"verbatim_text": F.lit("")})


def test_to_number(spark):
    given = ["1", " 2.5 ", "1e3", "-4", ".5", "1d", "NaN", "x", "", None, "7."]
    expected = [1.0, 2.5, 1000.0, -4.0, 0.5, None, None, None, None, None, 7.0]
    assert texts(spark, given, L.to_number) == expected


def test_to_integer(spark):
    assert texts(spark, ["3.0", "x", None], L.to_integer) == [3, None, None]
    assert texts(spark, ["2.7", "-2.7"], lambda c: L.to_integer(c, "floor")) == [2, -3]
    assert texts(spark, ["2.7"], lambda c: L.to_integer(c, "null")) == [None]
    with pytest.raises(Exception, match="not an integer label"):
        texts(spark, ["2.7"], L.to_integer)


def test_majority_first_seen_wins(spark):
    cols = [F.col(c) for c in "abcd"]
    rows = [(2, 1, 1, 2), (None, 3, None, 1), (None,) * 4, (0, 1, 1, None)]
    assert values(spark, rows, L.majority_vote(cols), "a int, b int, c int, d int") == [2, 3, None, 1]


def test_majority_ignores_empty_text(spark):
    cols = [F.col(c) for c in "abc"]
    rows = [("", "", "x"), ("y", "x", "")]
    assert values(spark, rows, L.majority_vote(cols), "a string, b string, c string") == ["x", "y"]


@pytest.mark.parametrize("df", [1, 2, 4, 30, 999, 99_999, 100_001, 5_000_000])
def test_t_cdf_against_integration(df):
    def reference(t):
        # Substituting t = sqrt(df) * tan(u) turns the density into a cosine power.
        top, steps = min(abs(math.atan(t / math.sqrt(df))), 14 / math.sqrt(df)), 4000
        total = 0.0
        for i in range(steps + 1):
            w = 1 if i in (0, steps) else 4 if i % 2 else 2
            total += w * math.exp((df - 1) * math.log(math.cos(top * i / steps)))
        area = total * top / steps / 3
        scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
        return 0.5 + math.copysign(area * scale, t)

    for t in (-6.0, -2.776445105, -1.0, -0.1, 0.0, 0.4, 3.0):
        assert t_cdf(t, df) == pytest.approx(reference(t), abs=1e-9 if df < 10_000 else 1e-8)


def test_t_cdf_has_no_seam():
    # One method at all sizes: neighbours differ by t (t^2 + 1) / (4 df^2) of the density, below 1e-10 here.
    for t in (-5.0, -2.0, -0.3, 1.0):
        for df in (99_999, 100_000, 100_001, 10**9):
            assert abs(t_cdf(t, df) - t_cdf(t, df + 1)) < 1e-10
    assert t_cdf(-1.959963984540054, 1e15) == pytest.approx(0.025, abs=1e-12)
    assert t_cdf(1.0, 1) == pytest.approx(0.75, abs=1e-14)


def test_t_cdf_known_value():
    assert t_cdf(-2.776445105, 4) == pytest.approx(0.025, abs=1e-9)


def test_integer_code(spark):
    given = ["Validity: 1", "Validity - 3", "validity: 4", "Validity: -1", "none", '{"Validity": "2"}']
    assert texts(spark, given, lambda c: replies.integer_code(c, "Validity")) == [1, 3, 4, -1, None, 2]
    given = ["The final decision is 2.", "No valid code here.", "-7 or 3"]
    assert texts(spark, given, replies.integer_code) == [2, None, -7]


def test_integer_code_prefers_line_end(spark):
    text = "Score: 1 of 5 points\nScore: 4"
    assert texts(spark, [text], lambda c: replies.integer_code(c, "Score")) == [4]


def test_integer_code_prefix_is_literal_and_unicode(spark):
    assert texts(spark, ["évaluation : 3"], lambda c: replies.integer_code(c, "Évaluation")) == [3]
    assert texts(spark, ["A.B: 1", "AxB: 1"], lambda c: replies.integer_code(c, "A.B")) == [1, None]


KEY_VALUES = [
    (
        "Id: 197\nTexte: Les yeux.\nIls voient: en meme temps\nEncore mieux!\nQuestion: Comment",
        {"Id": "197", "Texte": "Les yeux.\nIls voient: en meme temps\nEncore mieux!", "Question": "Comment"},
    ),
    ("Id: 198\nTexte: Sample\nAnother line", {"Id": "198", "Texte": "Sample\nAnother line"}),
    ("Id: 199\n\nTexte: A\nQuestion: What?\n\nScore: 5",
     {"Id": "199", "Texte": "A", "Question": "What?", "Score": "5"}),
    ("Just some random text without keys.", {"Section_1": "Just some random text without keys."}),
    ("lead\n\nmore\nKey : v\n\nw", {"Section_1": "lead\n\nmore", "Key": "v\n\nw"}),
    ("A: 1\r\nB: 2\r\nA: 3", {"A": "3", "B": "2"}),
    ("  A:\n  x  ", {"A": "x"}),
    ("http://x y", {"http": "//x y"}),
    ("", {}),
]


@pytest.mark.parametrize("text, expected", KEY_VALUES)
def test_key_values(spark, text, expected):
    assert texts(spark, [text], replies.key_value_blocks) == [expected]


def test_last_binary_digit(spark):
    given = ["0 then 1", "10 01", "final 0.", ""]
    assert texts(spark, given, replies.last_binary_digit) == [1, None, 0, None]


def test_numeric_label(spark):
    given = ["3.7", "-2", "about 4 of 5", "good", "-1.5 points"]
    assert texts(spark, given, lambda c: replies.numeric_label(c, "Float")) == [3.7, -2.0, 4.0, None, -1.5]
    compat = lambda c: replies.numeric_label(c, "Float", compat=True)
    assert texts(spark, given, compat) == [3.0, 2.0, 4.0, None, 1.0]
    assert texts(spark, given, lambda c: replies.numeric_label(c, "Integer")) == [3, 2, 4, None, 1]


def test_price(spark):
    rows = [("gpt-4o", 1000, 500), ("someone", 1000, 500)]
    price = cost.row_cost(F.col("m"), F.col("p"), F.col("c"))
    assert values(spark, rows, price, "m string, p long, c long") == [0.0075, 0.0015]


def test_rounding_matches_exact_binary_value(spark):
    amounts = [k * 5e-7 + j * 1e-9 for k in range(3000) for j in (-1, 0, 1) if k * 5e-7 + j * 1e-9 >= 0]
    got = values(spark, [(a,) for a in amounts], cost.round_binary(F.col("v"), 6), "v double")
    assert got == [round(a, 6) for a in amounts]


def test_mix_is_portable(spark):
    keys = [0, 1, 7, 123456789, 2**31 - 1, 2**31 + 5, 2**45 + 3]
    got = values(spark, [(k,) for k in keys], L.mix(F.col("v"), 42, "sample"), "v long")
    assert got == [int(hashlib.md5(f"{k}:42:sample".encode()).hexdigest()[:8], 16) for k in keys]
    named = values(spark, [("Ä b",), (None,)], L.mix(F.col("v"), 1), "v string")
    assert named == [int(hashlib.md5("Ä b:1:".encode()).hexdigest()[:8], 16), None]
