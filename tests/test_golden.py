"""Golden rows hand-derived from the evaluated pipeline (FIXTURES.md §4)."""

import pytest
from pyspark.sql import functions as F

from coverlens.operators.estimators import estimate_pass_at_k
from coverlens.operators.extract import extract_answers, extract_boxed_reward_sql, extract_boxed_sql, last_number_sql
from coverlens.operators.grade import grade_answers, reward_int_match_sql
from coverlens.operators.normalize import fix_a_slash_b_sql, fix_fracs_sql, normalize_answers
from coverlens.operators.rollouts import group_advantages, log_softmax_gather, padded_batches, shifted_log_probs, token_loss_metrics


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols))
    return df.select(F.expr(expr).alias("v")).first()["v"]


def test_boxed_last_and_nested(spark):
    assert one(spark, extract_boxed_sql("t"), t=r"a \boxed{1} b \boxed{\frac{1}{2}}") == r"\frac{1}{2}"


def test_boxed_unbalanced_takes_rest(spark):
    assert one(spark, extract_boxed_sql("t"), t=r"\boxed{1{2") == "1{2"


def test_no_last_number_gives_empty(spark):
    df = spark.createDataFrame([("The answer: \\frac{386}{64", "x")], "response string, gt_answer string")
    out = extract_answers(df, use_last_number=False).first()
    assert out["pred_answer"] == ""
    assert one(spark, last_number_sql("t"), t="1,234 and then -5.5") == "-5.5"


@pytest.mark.parametrize("raw,expected", [(r"\frac12", r"\frac{1}{2}"), ("3/4", r"\frac{3}{4}")])
def test_fix_fractions(spark, raw, expected):
    assert one(spark, fix_a_slash_b_sql(fix_fracs_sql("t")), t=raw) == expected


def test_sqrt_braced(spark):
    df = spark.createDataFrame([(r"\sqrt3",)], "a string")
    assert normalize_answers(df, "a", "n").first()["n"] == r"\sqrt{3}"


def test_reward_boxed_after_think(spark):
    assert one(spark, extract_boxed_reward_sql("t"), t=r"<think>\boxed{1}</think> \boxed{2}") == "2"


@pytest.mark.parametrize("pred,gt,ok", [("50%", "0.5", True), ("50", "0.5", True), ("1.00005", "1", True), ("51", "50", False)])
def test_numeric_grading(spark, pred, gt, ok):
    df = spark.createDataFrame([(pred, gt)], "p string, g string")
    assert grade_answers(df, "p", "g").first()["is_correct"] is ok


def test_numeric_mismatch_is_final(spark):
    df = spark.createDataFrame([("51", "50")], "p string, g string")
    assert grade_answers(df, "p", "g").first()["tier"] == "numeric_mismatch"


@pytest.mark.parametrize("resp,reward", [(r"\boxed{12}", 1.0), (r"\boxed{12.0}", 0.0)])
def test_reward_int_match(spark, resp, reward):
    assert one(spark, reward_int_match_sql("t", "12"), t=resp) == reward


@pytest.mark.parametrize("n,c,k,expected", [(4, 1, 1, 0.25), (4, 1, 2, 0.5), (4, 1, 4, 1.0), (4, 0, 4, 0.0)])
def test_pass_at_k_estimator(spark, n, c, k, expected):
    v = spark.range(1).select(estimate_pass_at_k(F.lit(n), F.lit(c), F.lit(k)).alias("v")).first()["v"]
    assert v == pytest.approx(expected)


def test_counterfactual_base9(spark):
    v = spark.range(1).select(F.expr("conv(CAST(CAST(conv('16', 9, 10) AS BIGINT) + CAST(conv('37', 9, 10) AS BIGINT) AS STRING), 10, 9)").alias("v")).first()["v"]
    assert v == "54"


def test_group_advantages(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 0.0), (1, 0.0), (1, 1.0)], "g int, reward double")
    vals = sorted(r["advantage"] for r in group_advantages(df, ["g"]).collect())
    assert vals[0] == pytest.approx(-0.5 / (0.5 + 1e-4))
    assert vals[-1] == pytest.approx(0.5 / (0.5 + 1e-4))


def test_padding_docstring_case(spark):
    df = spark.createDataFrame(
        [(0, 0, [1, 2, 3], [6, 7], 0.5), (1, 0, [4, 5], [8], 0.3)],
        "seq_id int, batch int, query_ids array<int>, response_ids array<int>, advantage double",
    )
    rows = {r["seq_id"]: r for r in padded_batches(df).collect()}
    assert rows[0]["input_ids"] == [1, 2, 3, 6, 7] and rows[1]["input_ids"] == [4, 5, 8, 0, 0]
    assert rows[0]["labels"] == [-100, -100, -100, 6, 7] and rows[1]["labels"] == [-100, -100, 8, -100, -100]
    assert rows[1]["attention_mask"] == [1, 1, 1, 0, 0]
    assert rows[1]["advantages"] == [0.0, 0.0, 0.3, 0.0, 0.0]


def test_padding_with_token_advantages(spark):
    df = spark.createDataFrame(
        [(0, 0, [1, 2, 3], [6, 7], [0.5, 0.8]), (1, 0, [4, 5], [8], [0.3])],
        "seq_id int, batch int, query_ids array<int>, response_ids array<int>, advantage array<double>",
    )
    rows = {r["seq_id"]: r for r in padded_batches(df).collect()}
    assert rows[0]["advantages"] == [0.0, 0.0, 0.0, 0.5, 0.8] and rows[1]["advantages"] == [0.0, 0.0, 0.3, 0.0, 0.0]


def test_entropy_counts_masked_tokens_only(spark):
    df = spark.createDataFrame([(1, -1.0, -1.0, 1.0, 0), (1, -2.0, -2.0, 1.0, 1), (2, -1.0, -1.0, 1.0, 0)], "iteration int, logp double, ref_logp double, adv double, mask int")
    rows = {r["iteration"]: r for r in token_loss_metrics(df).collect()}
    assert rows[1]["entropy"] == 2.0 and rows[1]["policy_loss"] == 2.0
    assert rows[2]["entropy"] is None  # an iteration without response tokens keeps its row


def test_log_softmax(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], 2)], "z array<double>, i int")
    assert df.select(log_softmax_gather(F.col("z"), F.col("i")).alias("v")).first()["v"] == pytest.approx(-0.4076059644443804)
    seq = spark.createDataFrame([([[1.0, 2.0], [0.0, 0.0], [5.0, 5.0]], [0, -100, 1])], "z array<array<double>>, l array<int>")
    assert seq.select(shifted_log_probs(F.col("z"), F.col("l")).alias("v")).first()["v"] == pytest.approx([0.0, -0.6931471805599453])


@pytest.mark.parametrize("depth", [1, 11, 40])
def test_boxed_at_any_depth(spark, depth):
    body = "{" * depth + "x" + "}" * depth
    text = r"\boxed{" + body + "} and more}"
    assert one(spark, extract_boxed_sql("t"), t=text) == body
    assert one(spark, extract_boxed_reward_sql("t"), t=text) == body


@pytest.mark.parametrize("raw,expected", [
    ("one hundred", "100"), ("two hundred five", "205"), ("one thousand", "1000"), ("Twenty-one", "21"),
    ("two million three hundred thousand", "2300000"), ("two point five", "2.5"), ("12\n", "12"), ("12\r\n", "12"), ("\u3000007\u00a0", "7"),
])
def test_normalised_numbers(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "a string")
    assert normalize_answers(df, "a", "n").first()["n"] == expected


@pytest.mark.parametrize("pred,gt,ok", [
    ("f(x)=50", "f(x)=0.5", False), ("f(x)=10001", "f(x)=10000.5", False), ("f(x)=2y", "2y=f(x)", True), ("ab=4/2", "ab=2", True),
    ("(x=1,y=2)", "(1,2)", True), ("x=(1,2.0)", "(1,2)", True), ("(1,3)", "(1,2)", False),
])
def test_equations(spark, pred, gt, ok):
    df = spark.createDataFrame([(pred, gt)], "p string, g string")
    assert grade_answers(df, "p", "g").first()["is_correct"] is ok


def test_a_choice_is_final(spark):
    df = spark.createDataFrame([("The result is 12 cm", "A"), ("so the answer is (B).", "B")], "response string, gt_answer string")
    assert [r["pred_answer"] for r in extract_answers(df, "gaokao2023").collect()] == ["The result is 12 cm", "B"]


def test_rows_without_a_truth_or_a_group_stay(spark):
    from coverlens.operators.ranking import rank_within
    from coverlens.plans.evaluation import process_generations

    df = spark.createDataFrame([("\\boxed{1}", "1"), ("\\boxed{1}", None)], "response string, gt_answer string")
    assert process_generations(df).count() == 2
    g = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "g string, o int")
    assert sorted((r["g"] or "", r["rank"]) for r in rank_within(g, "g", ["o"]).collect()) == [("", 1), ("", 2), ("a", 1)]


def test_reward_of_a_truth_that_is_no_integer(spark):
    assert one(spark, reward_int_match_sql("t", "g"), t=r"\boxed{12}", g="1/2") == 0.0


def test_coverage_sets_keep_splits_apart(spark):
    from coverlens.operators.coverage import coverage_set_ops

    rows = [("d", "aime", 7, 0, 4, 1), ("r", "capital", 7, 0, 4, 0), ("r", "aime", 7, 0, 4, 0), ("r", "aime", 8, 0, 4, 2)]
    df = spark.createDataFrame(rows, "run string, split string, question_id int, prompt_id int, n int, c int")
    got = sorted((r["split"], r["question_id"], r["relation"]) for r in coverage_set_ops(df, "d").collect())
    assert got == [("aime", 7, "lost"), ("aime", 8, "gained")]


def test_instruction_template(spark):
    from coverlens.operators.prompts import build_prompt, render_messages

    df = spark.createDataFrame([("2+2?",)], "question string")
    text = df.select(build_prompt(F.col("question")).alias("p")).first()["p"]
    assert text.startswith("Below is an instruction") and text.endswith("### Input:\n2+2?\n\n### Response:\n")
    assert df.select(build_prompt(F.col("question"), "100% {} {}").alias("p")).first()["p"].count("100% 2+2? ") == 1
    m = spark.createDataFrame([([("user", "q"), ("assistant", " a")],)], "m array<struct<role: string, content: string>>")
    assert m.select(render_messages(F.col("m")).alias("t")).first()["t"].endswith("### Response:\n a\n")


def test_counterfact_filter_keeps_letter_digits(spark):
    from coverlens.plans.registry import queries
    from tests.conftest import SF_SMALL

    rows = queries()["counterfact_hard_filter"](spark, SF_SMALL).where("p LIKE '%A%' OR q LIKE '%B%'").count()
    assert rows > 0
