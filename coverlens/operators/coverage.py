"""G8, G10-G14 — coverage comparisons across runs, checkpoints and subsets.

All inputs are per-question count tables ``(keys..., n, c)`` or graded rows;
every result is an aggregate or an equi-join on a key, never a cross product
of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def checkpoint_coverage(pass_by_ckpt: DataFrame, direction: str = "direction", epoch: str = "epoch") -> DataFrame:
    """pass@k along checkpoints with the change from the previous epoch."""
    w = Window.partitionBy(direction, "k").orderBy(epoch)
    return pass_by_ckpt.withColumn(
        "delta_prev", F.round(F.col("pass_at_k") - F.lag("pass_at_k").over(w), 9)
    )


def prefix_effect(pass_by_run: DataFrame, default_run: str, run: str = "run", keys: Sequence[str] = ("split", "k")) -> DataFrame:
    """pass@k of every run next to the default run's, with the difference."""
    base = pass_by_run.where(F.col(run) == default_run).select(*keys, F.col("pass_at_k").alias("default_pass_at_k"))
    return (
        pass_by_run.where(F.col(run) != default_run)
        .join(base, list(keys), "inner")
        .select(run, *keys, "pass_at_k", "default_pass_at_k", F.round(F.col("pass_at_k") - F.col("default_pass_at_k"), 9).alias("delta"))
    )


def coverage_set_ops(counts: DataFrame, default_run: str, run: str = "run", question: Sequence[str] = ("split", "question_id", "prompt_id")) -> DataFrame:
    """Questions a run solves (c > 0) that the default run does not
    ('gained'), and questions the default run solves that a run attempted
    without solving ('lost').

    Solved sets are aggregates; both comparisons are semi/anti joins on the
    question key against the default run's solved set, so no pairs of runs or
    run x question products are built.
    """
    question = list(question)
    per_q = counts.groupBy(run, *question).agg(F.max(F.col("c") > 0).alias("solved"))
    base = per_q.where(F.col("solved") & (F.col(run) == default_run)).select(*question)
    others = per_q.where(F.col(run) != default_run)
    gained = others.where("solved").join(base, question, "left_anti").withColumn("relation", F.lit("gained"))
    lost = others.where(~F.col("solved")).join(base, question, "left_semi").withColumn("relation", F.lit("lost"))
    return gained.select(run, *question, "relation").unionByName(lost.select(run, *question, "relation"))


def subset_rollup(graded: DataFrame, correct: str = "is_correct") -> DataFrame:
    """Accuracy per (split, subset), per split and overall."""
    return graded.rollup("split", "subset").agg(
        F.grouping_id().alias("level"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(correct)).alias("n_correct"),
        F.round(F.count_if(F.col(correct)) / F.count(F.lit(1)), 9).alias("accuracy"),
    )


def mode_distribution(extracted: DataFrame, run: str = "run") -> DataFrame:
    """Share of code vs text answers and of extraction branches per run, each with its accuracy."""
    counts = extracted.groupBy(run, "mode", "branch").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_correct").alias("n_correct"))
    total = F.sum("n").over(Window.partitionBy(run))
    return counts.withColumn("share", F.round(F.col("n") / total, 9)).withColumn("accuracy", F.round(F.col("n_correct") / F.col("n"), 9))


def run_summary(processed: DataFrame, run_keys: Sequence[str] = ("run", "split")) -> DataFrame:
    """Rows, mean response length, valid, correct and unsettled answers per run (an unsettled answer counts as wrong).

    Where the rows carry token counts, their totals too.
    """
    totals = [F.sum(c).cast("long").alias(c) for c in ("prompt_tokens", "completion_tokens") if c in processed.columns]
    return processed.groupBy(*run_keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.round(F.avg("response_len"), 9).alias("mean_response_len"),
        F.count_if("is_valid").alias("n_valid"),
        F.count_if("is_correct").alias("n_correct"),
        F.count_if(F.col("tier") == "residual").alias("n_residual"),
        F.round(F.count_if("is_correct") / F.count(F.lit(1)), 9).alias("accuracy"),
        *totals,
    )
