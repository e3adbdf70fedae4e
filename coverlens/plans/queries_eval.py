"""Registered queries: extraction, grading and pass@k."""

from __future__ import annotations

from pyspark.sql import functions as F

from coverlens.operators.estimators import pass_at_k
from coverlens.plans import fixtures
from coverlens.plans.evaluation import graded_counts, process_generations
from coverlens.plans.oracle import duck
from coverlens.plans.registry import register

PROCESSED_COLS = ["question_id", "prompt_id", "sample_id", "run", "split", "gt_answer", "response_len", "mode",
                  "branch", "raw_answer", "pred_answer", "gt_norm", "tier", "is_correct", "is_valid"]


def _pass_at_k_sql(run_keys: list[str], cutoff: int = 256) -> str:
    rk = ", ".join(run_keys)
    rk_ = rk + ", " if rk else ""
    part = ", ".join([*run_keys, "question_id", "prompt_id"])
    join = " USING (" + rk + ")" if rk else " ON true"
    return f"""
WITH g AS ({duck.processed_generations()}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY sample_id) AS rn FROM g),
counts AS (SELECT {part}, count(*) AS n, CAST(count_if(is_correct) AS BIGINT) AS c FROM ranked WHERE rn <= {cutoff} GROUP BY ALL),
mins AS (SELECT {rk_}least(2000, min(n)) AS m FROM counts {'GROUP BY ' + rk if rk else ''}),
ks AS (SELECT {rk_}CAST(unnest(range(1, m + 1)) AS INTEGER) AS k FROM mins),
det AS (
  SELECT {rk_}k, CASE WHEN n - c < k THEN 1.0 WHEN c = 0 THEN 0.0
    ELSE 1.0 - list_reduce(list_transform(range(CAST(n - c + 1 AS BIGINT), CAST(n + 1 AS BIGINT)), lambda i: 1.0 - k / i), lambda a, b: a * b) END AS p
  FROM counts JOIN ks{join})
SELECT {rk_}k, round(avg(p), 9) AS pass_at_k, count(*) AS n_questions FROM det GROUP BY ALL
"""


@register("extract_answers", oracle=lambda: f"SELECT {', '.join(PROCESSED_COLS)} FROM ({duck.processed_generations()})")
def q_extract_answers(spark, sf):
    """E1-E15 + E7 + F10 over the generation fixture (one row per generation)."""
    return process_generations(fixtures.generations(spark, sf)).select(*PROCESSED_COLS)


@register("pass_at_k", oracle=lambda: _pass_at_k_sql([]))
def q_pass_at_k(spark, sf):
    """Mean pass@k over all questions (first 256 samples each)."""
    counts = graded_counts(fixtures.generations(spark, sf), run_keys=())
    return pass_at_k(counts, [])


@register("pass_at_k_by_run", oracle=lambda: _pass_at_k_sql(["run", "split"]))
def q_pass_at_k_by_run(spark, sf):
    """pass@k for every run and split in one job."""
    counts = graded_counts(fixtures.generations(spark, sf), run_keys=("run", "split"))
    return pass_at_k(counts, ["run", "split"])
