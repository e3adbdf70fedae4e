"""Fixture views derived from the driver's test tables (see FIXTURES.md §3).

Every view is built with modulus arithmetic over table keys so that the DuckDB
oracle can build exactly the same rows; sizes grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coverlens.sources.tables import ensure_parallelism, table


def _s(c):
    return c.cast("string")


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§3.1: one generation row per event; 12 response shapes by ``event_id % 12``."""
    ev = ensure_parallelism(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"))
    uid, eid = F.col("user_id"), F.col("event_id")
    g = uid * 7 + 3
    G = _s(g)
    m = (eid % 12).cast("int")
    response = (
        F.when(m == 0, F.concat(F.lit("The result is \\boxed{"), G, F.lit("}.")))
        .when(m == 1, F.concat(F.lit("So \\boxed{\\frac{"), _s(g * 2), F.lit("}{2}} done")))
        .when(m == 2, F.concat(F.lit("So the answer is "), G, F.lit(".")))
        .when(m == 3, F.concat(F.lit("The final answer is $"), G, F.lit("$. I hope it is correct.")))
        .when(m == 4, F.concat(F.lit("My final answer is "), G, F.lit("%")))
        .when(m == 5, F.concat(F.lit("答案是 "), _s(g + 1)))
        .when(m == 6, F.concat(F.lit("First 5, then 9 and last "), G, F.lit(" apples")))
        .when(m == 7, F.concat(F.lit("Wrong \\boxed{"), _s(g + 1), F.lit("}")))
        .when(m == 8, F.concat(F.lit("<think>maybe \\boxed{0}</think> so \\boxed{"), G, F.lit("}")))
        .when(m == 9, F.lit("no idea"))
        .when(
            m == 10,
            F.concat(F.lit("<llm-code>\nx = 1\nx\n</llm-code>\n<llm-code-output>\n"), G, F.lit("\n</llm-code-output>")),
        )
        .otherwise(F.concat(F.lit("Hence $\\boxed "), _s(g * 100), F.lit("$ ok")))
    )
    return ev.select(
        uid.alias("question_id"),
        uid.alias("prompt_id"),
        eid.alias("sample_id"),
        F.col("event_type").alias("run"),
        F.lit("all").alias("split"),
        G.alias("gt_answer"),
        response.alias("response"),
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded samples without the text work: correctness follows the
    generation fixture's response shapes (shapes 5, 7, 9 are wrong)."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("user_id").alias("question_id"),
        F.col("user_id").alias("prompt_id"),
        F.col("event_id").alias("sample_id"),
        F.col("event_type").alias("run"),
        F.lit("all").alias("split"),
        F.concat(F.lit("set"), (F.col("user_id") % 3).cast("string")).alias("subset"),
        F.pow(F.lit(2), F.col("event_id") % 5).cast("int").alias("epoch"),
        F.when(F.col("user_id") % 2 == 0, F.lit("forward")).otherwise(F.lit("reverse")).alias("direction"),
        (~(F.col("event_id") % 12).isin(5, 7, 9)).alias("is_correct"),
    )


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§3.2 without groups: reward 0/1, finish reason, iteration."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id"),
        F.col("user_id").alias("question_id"),
        F.when((F.col("event_id") % 12).isin(1, 5, 7, 9), F.lit(0.0)).otherwise(F.lit(1.0)).alias("reward"),
        F.when(F.col("value") > 100, F.lit("length")).otherwise(F.lit("stop")).alias("finish_reason"),
        F.dayofmonth("ts").alias("iteration"),
        (F.lit(1) + F.col("event_id") % 9).cast("int").alias("resp_len"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§3.2: ``episodes`` in groups of four samples of a question.

    Positions inside a question come from a distributed rank (a question
    holding a large share of the rows is split over tasks)."""
    from coverlens.operators.ranking import rank_within

    ranked = rank_within(episodes(spark, sf_dir).drop("ts"), "question_id", ["event_id"], "__pos")
    return ranked.withColumn("grp", F.floor((F.col("__pos") - 1) / 4).cast("int")).drop("__pos")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§3.5: logged per-token log-probs, advantages and masks (lineitem)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("seq_id"),
        F.col("l_linenumber").alias("pos"),
        F.to_date("l_shipdate").alias("iteration"),
        (-F.col("l_discount")).alias("logp"),
        (-F.col("l_tax")).alias("ref_logp"),
        (F.col("l_quantity") - 25).alias("adv"),
        (F.col("l_linestatus") == "O").cast("int").alias("mask"),
    )


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§3.7 ``batches``: query/response token arrays and a batch id (events)."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("seq_id"),
        F.floor(F.col("event_id") / 16).cast("bigint").alias("batch"),
        F.sequence(F.lit(1), (F.lit(1) + F.col("user_id") % 3).cast("int")).alias("query_ids"),
        F.sequence(F.lit(1), (F.lit(1) + F.col("event_id") % 4).cast("int")).alias("response_ids"),
        F.round((F.col("value") - 50) / 100, 6).alias("advantage"),
    )


def test_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§3.7 ``test_grades``: task, generation, one grade per test (lineitem)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_partkey").alias("task_id"),
        F.col("l_orderkey").alias("gen_id"),
        F.col("l_linenumber").alias("test_id"),
        (F.col("l_quantity") > 5).cast("int").alias("grade"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction/truth pairs, one answer shape per ``p_partkey % 10``:
    exact, percent, tuple, bracket, matrix, equation side, equation pair,
    fraction, choice, mismatch/residual."""
    part = ensure_parallelism(table(spark, sf_dir, "part").select("p_partkey", "p_size"))
    return part.select(
        "p_partkey",
        F.expr(
            r"""CASE CAST(p_partkey % 10 AS INT)
              WHEN 0 THEN CAST(p_size AS STRING)
              WHEN 1 THEN concat(CAST(p_size AS STRING), '%')
              WHEN 2 THEN concat('(', CAST(p_size AS STRING), ',', CAST(p_partkey AS STRING), ')')
              WHEN 3 THEN concat('[', CAST(p_size AS STRING), ']')
              WHEN 4 THEN concat('\\begin{pmatrix}', CAST(p_size AS STRING), '&', CAST(p_partkey % 7 AS STRING), '\\\\',
                                 CAST(p_partkey % 5 AS STRING), '&', CAST(p_partkey % 3 AS STRING), '\\end{pmatrix}')
              WHEN 5 THEN concat('x=', CAST(p_size AS STRING))
              WHEN 6 THEN concat('y=', CAST(p_size AS STRING))
              WHEN 7 THEN concat('\\frac{', CAST(2 * p_size AS STRING), '}{2}')
              WHEN 8 THEN concat('The answer is (', char(65 + CAST(p_partkey % 5 AS INT)), ')')
              ELSE CASE WHEN p_partkey % 20 = 9 THEN CAST(p_size + 1 AS STRING) ELSE concat('x^', CAST(p_size AS STRING)) END
            END"""
        ).alias("pred"),
        F.expr(
            r"""CASE CAST(p_partkey % 10 AS INT)
              WHEN 0 THEN CAST(p_size AS STRING)
              WHEN 1 THEN concat('0.', lpad(CAST(p_size AS STRING), 2, '0'))
              WHEN 2 THEN concat('(', CAST(p_size AS STRING), ', ', CAST(p_partkey + p_partkey % 2 AS STRING), ')')
              WHEN 3 THEN concat('{', CAST(p_size AS STRING), '}')
              WHEN 4 THEN concat('\\begin{pmatrix}', CAST(p_size AS STRING), '&', CAST(p_partkey % 7 AS STRING), '\\\\',
                                 CAST(p_partkey % 5 AS STRING), '&',
                                 CAST(p_partkey % 3 + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS STRING), '\\end{pmatrix}')
              WHEN 5 THEN CAST(p_size AS STRING)
              WHEN 6 THEN concat(CAST(p_size AS STRING), '=y')
              WHEN 7 THEN CAST(p_size AS STRING)
              WHEN 8 THEN char(65 + CAST(p_partkey % 5 AS INT))
              ELSE CAST(p_size AS STRING)
            END"""
        ).alias("gt"),
    )


def raw_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Un-normalised answer strings, one clean-up case per ``p_partkey % 12``
    (units, dollars, \\text, degrees, leading zeros, number words, decimal
    tails, \\dfrac, a/b, ``x =``, \\sqrt, percent)."""
    part = ensure_parallelism(table(spark, sf_dir, "part").select("p_partkey", "p_size"))
    return part.select(
        "p_partkey",
        F.expr(
            r"""CASE CAST(p_partkey % 12 AS INT)
              WHEN 0 THEN concat(CAST(p_size AS STRING), ' apples')
              WHEN 1 THEN concat('\\$', CAST(p_size AS STRING))
              WHEN 2 THEN concat(CAST(p_size AS STRING), ' \\text{ cm}')
              WHEN 3 THEN concat(CAST(p_size AS STRING), '^\\circ')
              WHEN 4 THEN concat('00', CAST(p_size AS STRING))
              WHEN 5 THEN element_at(array('seven', 'Twenty-one', 'one hundred', 'ninety nine', 'two hundred five', 'one thousand', 'three million two thousand one hundred and six', 'two point five'), CAST(p_size % 8 AS INT) + 1)
              WHEN 6 THEN concat(CAST(p_size AS STRING), '.000')
              WHEN 7 THEN concat('\\dfrac', CAST(p_size % 10 AS STRING), CAST(p_partkey % 10 AS STRING))
              WHEN 8 THEN concat(CAST(p_size AS STRING), '/', CAST(p_size + 1 AS STRING))
              WHEN 9 THEN concat('x = ', CAST(p_size AS STRING), '.')
              WHEN 10 THEN concat('\\sqrt', CAST(p_size AS STRING))
              ELSE concat(' ', CAST(p_size AS STRING), '\\%  ')
            END"""
        ).alias("raw"),
    )


def choice_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiple-choice responses (customer): trigger phrase, bare letters, few-shot repeats."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        "c_custkey",
        F.expr(
            r"""CASE CAST(c_custkey % 3 AS INT)
              WHEN 0 THEN concat('So the answer is (', char(65 + CAST(c_custkey % 5 AS INT)), ').')
              WHEN 1 THEN concat(c_mktsegment, ' maybe ', char(65 + CAST(c_custkey % 5 AS INT)))
              ELSE concat('answer is A', char(10), char(10), 'Problem: the answer is ', char(65 + CAST(c_custkey % 5 AS INT)))
            END"""
        ).alias("response"),
    )


def chain_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§3.3: ten additive steps per problem (part); premise letter at position 0."""
    part = table(spark, sf_dir, "part").select("p_partkey")
    k = F.col("p_partkey")
    steps = part.select(k.alias("id"), F.explode(F.sequence(F.lit(1), F.lit(10))).alias("pos"))
    i = F.col("pos").cast("bigint")
    return steps.select(
        "id", F.col("pos"),
        ((F.col("id") * (2 * i + 1) + i * i) % 20 + 1).cast("bigint").alias("cst"),
        ((F.col("id") * 7) % 20 + 1).cast("bigint").alias("p0"),
        F.expr("char(97 + CAST((pos * 3 + id) % 26 AS INT))").alias("var"),
        F.expr("char(97 + CAST(id % 26 AS INT))").alias("premise_var"),
    )


def counterfact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§3.4: two 2-digit numbers in base 7/9/11/12 per order (leading digit non-zero)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    base = F.element_at(F.array(*[F.lit(b) for b in [7, 9, 11, 12]]), (k % 4).cast("int") + 1)
    digit = lambda d: F.substring(F.lit("0123456789AB"), (d + 1).cast("int"), 1)
    return o.select(
        k.alias("id"), base.alias("base"),
        F.concat(digit(k % (base - 1) + 1), digit((k * 3) % base)).alias("p"),
        F.concat(digit((k * 7) % (base - 1) + 1), digit((k * 5) % base)).alias("q"),
    )
