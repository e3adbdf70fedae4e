"""Registered queries: the extraction operators one by one."""

from __future__ import annotations

from pyspark.sql import functions as F

from coverlens.operators import extract as X
from coverlens.operators.normalize import fix_a_slash_b_sql, fix_fracs_sql, normalize_answers
from coverlens.plans import fixtures
from coverlens.plans.evaluation import process_generations
from coverlens.plans.oracle import duck
from coverlens.plans.registry import register
from coverlens.sources.tables import table

_G = f"({duck.GENERATIONS})"


@register("extract_boxed", oracle=lambda: f"SELECT sample_id, {duck.boxed('response')} AS boxed FROM {_G} WHERE strpos(response, 'boxed') > 0")
def q_extract_boxed(spark, sf):
    """Content of the last ``boxed`` with balanced braces."""
    g = fixtures.generations(spark, sf).where(F.col("response").contains("boxed"))
    return g.select("sample_id", F.expr(X.extract_boxed_sql("response")).alias("boxed"))


@register("extract_last_number", oracle=lambda: f"SELECT sample_id, {duck.last_number('response')} AS last_number FROM {_G}")
def q_extract_last_number(spark, sf):
    """Last number of the response after comma removal."""
    return fixtures.generations(spark, sf).select("sample_id", F.expr(X.last_number_sql("response")).alias("last_number"))


@register("extract_choice", oracle=lambda: f"SELECT c_custkey, {duck.choice_answer_clean('response')} AS choice FROM ({duck.CHOICE_TEXTS})")
def q_extract_choice(spark, sf):
    """Choice letter (first after a trigger phrase, else last letter)."""
    return fixtures.choice_texts(spark, sf).select("c_custkey", F.expr(X.choice_answer_clean_sql("response")).alias("choice"))


@register("extract_multi_choice", oracle=lambda: f"SELECT c_custkey, {duck.multi_choice('response')} AS choice FROM ({duck.CHOICE_TEXTS})")
def q_extract_multi_choice(spark, sf):
    """E5: ``answer is (x)`` before any ``Problem:`` else 'placeholder'."""
    return fixtures.choice_texts(spark, sf).select("c_custkey", F.expr(X.multi_choice_answer_sql("response")).alias("choice"))


@register("normalize_answers", oracle=lambda: f"SELECT p_partkey, raw, norm FROM ({duck.stages(f'SELECT *, raw AS norm FROM ({duck.RAW_ANSWERS})', 'norm', duck.normalize_exprs('norm'))})")
def q_normalize_answers(spark, sf):
    """The ordered clean-up of answer text (units, LaTeX, words, fractions)."""
    a = fixtures.raw_answers(spark, sf)
    return normalize_answers(a.withColumn("norm", F.col("raw")), "norm", "norm").select("p_partkey", "raw", "norm")


@register("fix_fractions", oracle=lambda: f"""
SELECT p_partkey, raw, {duck.normalize_exprs('raw')[-1].replace('raw', 'f')} AS fixed FROM (
  SELECT *, {duck.normalize_exprs('raw')[-2]} AS f FROM ({duck.RAW_ANSWERS}))""")
def q_fix_fractions(spark, sf):
    """E8: \\frac12 -> \\frac{1}{2} and a/b -> \\frac{a}{b} on raw answers."""
    a = fixtures.raw_answers(spark, sf).withColumn("f", F.expr(fix_fracs_sql("raw")))
    return a.select("p_partkey", "raw", F.expr(fix_a_slash_b_sql("f")).alias("fixed"))


@register("extract_boxed_reward", oracle=lambda: f"SELECT sample_id, {duck.reward_boxed('response')} AS reward_answer FROM {_G}")
def q_extract_boxed_reward(spark, sf):
    """Reward-side boxed answer after the thinking block."""
    return fixtures.generations(spark, sf).select("sample_id", F.expr(X.extract_boxed_reward_sql("response")).alias("reward_answer"))


@register("recorded_code_output", oracle=lambda: f"SELECT sample_id, {duck.code_output('response')} AS code_output FROM {_G} WHERE strpos(response, '<llm-code>') > 0")
def q_recorded_code_output(spark, sf):
    """Stripped last ``<llm-code-output>`` block of code responses."""
    g = fixtures.generations(spark, sf).where(F.col("response").contains("<llm-code>"))
    return g.select("sample_id", F.expr(X.recorded_code_output_sql("response")).alias("code_output"))


@register("code_blocks", oracle=lambda: f"""
SELECT sample_id, CAST(i - 1 AS INTEGER) AS block_pos, trim(b[i], {duck.WS}) AS code
FROM (SELECT sample_id, regexp_extract_all(response, '(?s)<llm-code>(.*?)</llm-code>', 1) AS b FROM {_G}), range(1, len(b) + 1) t(i)""")
def q_code_blocks(spark, sf):
    """Every ``<llm-code>`` program block with its position (last = answer program)."""
    g = fixtures.generations(spark, sf).select("sample_id", F.expr(X.code_blocks_sql("response")).alias("b"))
    return g.select("sample_id", F.posexplode("b").alias("block_pos", "code"))


@register("solution_mode", oracle=lambda: f"SELECT sample_id, run, CASE WHEN strpos(response, '<llm-code>') > 0 THEN 'code' ELSE 'nl' END AS mode FROM {_G}")
def q_solution_mode(spark, sf):
    """Code vs natural-language response."""
    return fixtures.generations(spark, sf).select("sample_id", "run", F.expr(X.solution_mode_sql("response")).alias("mode"))


@register("response_length", oracle="SELECT doc_id, CAST(len(regexp_extract_all(text, '\\S+', 0)) AS INTEGER) AS n_tokens FROM documents")
def q_response_length(spark, sf):
    """Whitespace-token count of whole documents."""
    return table(spark, sf, "documents").select("doc_id", F.expr(X.response_length_sql("text")).alias("n_tokens"))


@register("answer_validity", oracle=lambda: f"SELECT run, split, CAST(count_if(is_valid) AS BIGINT) AS n_valid, CAST(count_if(NOT is_valid) AS BIGINT) AS n_invalid FROM ({duck.processed_generations()}) GROUP BY run, split")
def q_answer_validity(spark, sf):
    """Valid (non-empty) predicted answers per run."""
    p = process_generations(fixtures.generations(spark, sf))
    return p.groupBy("run", "split").agg(F.count_if("is_valid").alias("n_valid"), F.count_if(~F.col("is_valid")).alias("n_invalid"))


def theorem_texts(spark, sf):
    """Theorem-QA style responses (part): true/false words, option letters, boxed
    equations, values with units, percentages, quotients, products, powers of ten."""
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.expr(
            r"""CASE CAST(p_partkey % 8 AS INT)
              WHEN 0 THEN 'The statement is true.'
              WHEN 1 THEN 'Answer: (b)'
              WHEN 2 THEN concat('\\boxed{x = ', CAST(p_size AS STRING), '}')
              WHEN 3 THEN concat('The value = ', CAST(p_size AS STRING), ' m')
              WHEN 4 THEN concat(CAST(p_size AS STRING), '%')
              WHEN 5 THEN concat('\\boxed{\\frac{', CAST(p_size AS STRING), '}{8}}')
              WHEN 6 THEN concat('The product = ', CAST(p_size AS STRING), ' \\times 3')
              ELSE concat('$', CAST(p_size AS STRING), ' \\cdot 10^{-2}$')
            END"""
        ).alias("response"),
    )


@register("extract_theoremqa", oracle="""
SELECT p_partkey AS id, CASE CAST(p_partkey % 8 AS INTEGER) WHEN 0 THEN 'True' WHEN 1 THEN 'Answer: (b)' WHEN 2 THEN CAST(p_size AS VARCHAR) WHEN 3 THEN CAST(p_size AS VARCHAR)
  WHEN 5 THEN (CASE WHEN p_size % 8 = 0 THEN CAST(p_size // 8 AS VARCHAR) ELSE CAST(p_size / 8 AS VARCHAR) END) WHEN 6 THEN CAST(p_size * 3 AS VARCHAR)
  ELSE (CASE WHEN p_size % 100 = 0 THEN CAST(p_size // 100 AS VARCHAR) ELSE CAST(p_size / 100 AS VARCHAR) END) END AS answer
FROM part""")
def q_extract_theoremqa(spark, sf):
    """Theorem-QA answers (booleans, options, value after '=', units cleaned, products and quotients as values)."""
    return theorem_texts(spark, sf).select("id", F.expr(X.theoremqa_answer_sql("response")).alias("answer"))


_KIND = "CASE CAST(sample_id % 5 AS INTEGER) WHEN 0 THEN 'program_only' WHEN 1 THEN 'pot' WHEN 2 THEN 'pal' WHEN 3 THEN 'cot' END"


def _duck_by_prompt_type() -> str:
    branch, raw = duck.text_branch(duck.rep("response", "ки"))
    base = f"SELECT sample_id, response, {duck.clean(f'({raw})')} AS x FROM {_G}"
    once = duck.stages(base, "x", duck.normalize_exprs("x"))
    once = f"SELECT * REPLACE (CASE WHEN sample_id % 5 < 3 THEN coalesce({duck.code_output('response')}, '') ELSE x END AS x) FROM ({once})"
    twice = duck.stages(once, "x", duck.normalize_exprs("x"))
    return f"SELECT sample_id, CASE WHEN response IS NULL OR response = '' OR response = 'error' THEN NULL ELSE x END AS prediction FROM ({twice})"


@register("extract_by_prompt_type", oracle=lambda: _duck_by_prompt_type())
def q_extract_by_prompt_type(spark, sf):
    """The recorded program output or the text's answer, as the prompt type says, normalised again; empty/'error' -> NULL."""
    g = fixtures.generations(spark, sf).select("sample_id", "response", F.expr(_KIND).alias("prompt_type"))
    return X.extract_by_prompt_type(g, prompt_type="prompt_type").select("sample_id", "prediction")
