"""T1 — the pass@k evaluation job as one DataFrame plan.

load -> extract (E1) -> normalise truth (E7) -> grade (F10) -> cutoff (G2)
-> counts (G1) -> k grid (G3) -> estimator (G4) -> mean (G5/G9).

The wide ``response`` column is consumed by the first projection; only short
answer strings and keys reach the exchanges (one on the question key, one on
the run key over a histogram that is at most cutoff^2 rows per run).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverlens.operators.estimators import DEFAULT_CUTOFF, correct_counts, first_n_cutoff, pass_at_k
from coverlens.operators.extract import extract_answers, extract_raw_answers, finish_answers
from coverlens.operators.grade import grade_answers
from coverlens.operators.normalize import normalize_answers

QUESTION_KEYS = ("question_id", "prompt_id")


def process_generations(gens: DataFrame, data_name: str = "math", keep_response: bool = False) -> DataFrame:
    """``process_df``: extract, normalise the truth, grade; drops ``response`` unless it is to be kept.

    Everything is a per-row projection over one scan, without an exchange:
    plain integers take the short way through normalisation, and the cheap
    grading tiers settle most rows.
    """
    ex = extract_raw_answers(gens, data_name=data_name)
    ex = ex if keep_response else ex.drop("response")
    return grade_answers(normalize_answers(finish_answers(ex, data_name), "gt_answer", "gt_norm"), "pred_answer", "gt_norm").drop("cleaned")


def graded_counts(
    gens: DataFrame,
    run_keys: Sequence[str] = ("run", "split"),
    data_name: str = "math",
    cutoff: int = DEFAULT_CUTOFF,
    order_col: str = "sample_id",
) -> DataFrame:
    """Per question ``(n, c)`` over its first ``cutoff`` samples.

    Extraction is per row; the cutoff only depends on sample order, so it runs
    before grading.  Samples are then counted per distinct (question, answer,
    truth) with map-side partial aggregation, and normalisation and grading
    run once per distinct answer of a question, not once per sample.  A hot
    question or answer is pre-aggregated before any shuffle.
    """
    keys = [*run_keys, *QUESTION_KEYS]
    ex = extract_raw_answers(gens, data_name=data_name).select(*keys, order_col, "mode", "cleaned", "gt_answer")
    kept = first_n_cutoff(ex, keys, order_col, cutoff)
    pairs = kept.groupBy(*keys, "mode", "cleaned", "gt_answer").agg(F.count(F.lit(1)).alias("__cnt"))
    pairs = finish_answers(pairs, data_name)
    pairs = normalize_answers(pairs, "gt_answer", "gt_norm")
    pairs = grade_answers(pairs, "pred_answer", "gt_norm")
    return pairs.groupBy(*keys).agg(
        F.sum("__cnt").alias("n"), F.sum(F.when(F.col("is_correct"), F.col("__cnt")).otherwise(F.lit(0))).alias("c")
    )


def evaluate_pass_at_k(
    gens: DataFrame,
    run_keys: Sequence[str] = ("run", "split"),
    data_name: str = "math",
    cutoff: int = DEFAULT_CUTOFF,
) -> DataFrame:
    """``(run_keys..., k, pass_at_k, n_questions)``."""
    counts = graded_counts(gens, run_keys, data_name, cutoff)
    return pass_at_k(counts, list(run_keys))

