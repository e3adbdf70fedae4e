"""Linear equations and products of numbers, by hand."""

import pytest
from pyspark.sql import functions as F

from coverlens.operators.extract import extract_by_prompt_type, theoremqa_answer_sql
from coverlens.operators.grade import grade_answers

PAIRS = [
    ("x+y=3", "y+x=3", "linear"),
    ("x+y=3", "3=x+y", "equation_pair"),
    ("3-x=y", "x+y=3", "linear"),
    ("2x+3=7", "2x=4", "linear"),
    ("2x=4", "x=2", "linear_mismatch"),
    (r"\frac{1}{3}x+\frac{1}{6}x=y", "x/2=y", "linear"),
    ("0.5x - y = 0", r"y=\frac{1}{2}x", "linear"),
    ("2*x=y", r"2\cdot x - y = 0", "linear"),
    ("x+x=2", "2x=2", "linear"),
    ("x-x=0", "y-y=0", "linear"),
    ("x=1+2+3-5", "x-1=0", "linear"),
    ("x=1/0", "x=2", "residual"),
    ("x^2=4", "x^2-4=0", "residual"),
    ("xy=1", "yx=1", "residual"),
    ("x+y=3", "x+z=3", "linear_mismatch"),
    ("x+y=3", "X+z=3", "linear_mismatch"),
    ("/".join(["x", "999999999"]) + "=" + "+".join(f"{i}/{999999937 - i}" for i in range(1, 9)), "x=1", "residual"),
]


def test_two_linear_equations(spark):
    df = spark.createDataFrame(PAIRS, "p string, g string, want string")
    for r in grade_answers(df, "p", "g").collect():
        assert (r.p, r.g, r.tier) == (r.p, r.g, r.want) and r.is_correct == (r.want in ("linear", "equation_pair"))


def test_how_numbers_compare(spark):
    df = spark.createDataFrame([("50%", "50"), ("1.00005", "1"), ("7", "7.0"), ("nan", "1")], "p string, g string")
    tiers = lambda **k: [r.tier for r in grade_answers(df, "p", "g", **k).collect()]
    assert tiers() == ["numeric_percent", "numeric", "numeric", "numeric_mismatch"]
    assert tiers(include_percentage=False) == ["numeric_mismatch", "numeric", "numeric", "numeric_mismatch"]
    assert tiers(is_close=False) == ["numeric_percent", "numeric_mismatch", "numeric", "numeric_mismatch"]
    assert tiers(include_percentage=False, is_close=False) == ["numeric_mismatch", "numeric_mismatch", "numeric", "numeric_mismatch"]


@pytest.mark.parametrize("text,value", [
    ("12%", "0.12"), ("1/2", "0.5"), ("3*4", "12"), ("x = 4/2", "2"), (r"\boxed{\frac{3}{4}}", "0.75"), (r"2\times 10^{3}", "2000"), (r"2 \cdot 10^{-3}", "0.002"),
    ("2.50", "2.5"), ("2.0*3", "6.0"), ("10^3", "1000"), ("-2^2", "-4"), ("3 - 1", "3 - 1"), ("5 km", "5"), ("1/0", "1/0"), (r"2\pi", "6.28"), ("$7$", "7"), ("1/3", repr(1 / 3)),
    ("100/3/2*4", repr(100 / 3 / 2 * 4)), ("(b) 3", "(b) 3"), ("yes", "True"), (r"\sqrt{2}", r"\sqrt{2}"), ("99999999999999999999", "99999999999999999999"), ("0.00001", "0.00001"),
])
def test_theoremqa_values(spark, text, value):
    got = spark.createDataFrame([(text,)], "t string").select(F.expr(theoremqa_answer_sql("t")).alias("v")).first().v
    assert got == value or float(got) == pytest.approx(float(value), rel=1e-15)


def test_prompt_types(spark):
    code = "<llm-code>\nx\n</llm-code>\n<llm-code-output>\n7\n</llm-code-output> so \\boxed{8}"
    rows = [(code, "program_only_v1"), (code, "pal"), (code, "cot"), (code, None), ("error", "pot"), ("", "cot"), ("no output", "pot")]
    df = spark.createDataFrame(rows, "response string, kind string")
    assert [r.prediction for r in extract_by_prompt_type(df, prompt_type="kind").collect()] == ["7", "7", "8", "8", None, None, ""]
