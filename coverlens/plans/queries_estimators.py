"""Registered queries: counts, pass@k variants and coverage views."""

from __future__ import annotations

from pyspark.sql import functions as F

from coverlens.operators import coverage as cov
from coverlens.operators.estimators import (
    correct_counts,
    estimate_pass_at_k,
    first_n_cutoff,
    instance_results,
    k_grid,
    metric_vectors,
    pass_at_k_multi_test,
    pass_at_k,
    pass_at_k_detail,
)
from coverlens.operators.grade import all_tests_pass
from coverlens.plans import fixtures
from coverlens.plans.evaluation import process_generations
from coverlens.plans.oracle import duck
from coverlens.plans.registry import register

QK = ["question_id", "prompt_id"]


def _duck_counts(keys: list[str], source: str = duck.OUTCOMES, cutoff: int = 256) -> str:
    part = ", ".join(keys + QK)
    return f"""(SELECT {part}, count(*) AS n, CAST(count_if(is_correct) AS BIGINT) AS c FROM (
      SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY sample_id) AS rn FROM ({source})) WHERE rn <= {cutoff} GROUP BY ALL)"""


def _duck_est(n: str = "n", c: str = "c", k: str = "k") -> str:
    return (
        f"CASE WHEN {n} - {c} < {k} THEN 1.0 WHEN {c} = 0 THEN 0.0 ELSE 1.0 - list_reduce(list_transform("
        f"range(CAST({n} - {c} + 1 AS BIGINT), CAST({n} + 1 AS BIGINT)), lambda i: 1.0 - {k} / i), lambda a, b: a * b) END"
    )


def _duck_detail(counts: str, keys: list[str]) -> str:
    rk = ", ".join(keys)
    return f"""(WITH counts AS {counts},
      mins AS (SELECT {rk}, least(2000, min(n)) AS m FROM counts GROUP BY {rk}),
      ks AS (SELECT {rk}, CAST(unnest(range(1, m + 1)) AS INTEGER) AS k FROM mins)
      SELECT {rk}, question_id, prompt_id, n, c, k, {_duck_est()} AS p FROM counts JOIN ks USING ({rk}))"""


def _duck_pass(counts: str, keys: list[str]) -> str:
    rk = ", ".join(keys)
    return f"SELECT {rk}, k, round(avg(p), 9) AS pass_at_k, count(*) AS n_questions FROM {_duck_detail(counts, keys)} GROUP BY ALL"


def _outcome_counts(spark, sf, keys, cutoff=256):
    o = fixtures.outcomes(spark, sf)
    return correct_counts(first_n_cutoff(o, [*keys, *QK], "sample_id", cutoff), [*keys, *QK])


# ------------------------------------------------------------------ G1-G4

@register("correct_counts", oracle=lambda: f"SELECT * FROM {_duck_counts(['run', 'split'])}")
def q_correct_counts(spark, sf):
    """G1: per (run, question) sample count n and correct count c."""
    return _outcome_counts(spark, sf, ["run", "split"])


@register("first_n_cutoff", oracle=lambda: f"""
SELECT run, question_id, prompt_id, sample_id FROM (
  SELECT *, row_number() OVER (PARTITION BY run, question_id, prompt_id ORDER BY sample_id) AS rn FROM ({duck.OUTCOMES}))
WHERE rn <= 16""")
def q_first_n_cutoff(spark, sf):
    """First 16 samples of every (run, question) by sample id."""
    o = fixtures.outcomes(spark, sf)
    return first_n_cutoff(o, ["run", *QK], "sample_id", 16).select("run", *QK, "sample_id")


@register("k_grid", oracle=lambda: f"""
SELECT run, split, CAST(unnest(range(1, least(2000, min(n)) + 1)) AS INTEGER) AS k FROM {_duck_counts(['run', 'split'])} GROUP BY run, split""")
def q_k_grid(spark, sf):
    """k = 1..min(2000, min n) per run."""
    return k_grid(_outcome_counts(spark, sf, ["run", "split"]), ["run", "split"])


@register("pass_at_k_detail", oracle=lambda: f"""
SELECT run, split, question_id, prompt_id, k, round(p, 9) AS pass_at_k FROM {_duck_detail(_duck_counts(['run', 'split']), ['run', 'split'])}""")
def q_pass_at_k_detail(spark, sf):
    """Per-question unbiased pass@k for every k of the run's grid."""
    d = pass_at_k_detail(_outcome_counts(spark, sf, ["run", "split"]), QK, ["run", "split"])
    return d.withColumn("pass_at_k", F.round("pass_at_k", 9))


@register("pass_at_k_outcomes", oracle=lambda: _duck_pass(_duck_counts(["run", "split"]), ["run", "split"]))
def q_pass_at_k_outcomes(spark, sf):
    """G5 over pre-graded outcomes (no text work): mean pass@k per run."""
    return pass_at_k(_outcome_counts(spark, sf, ["run", "split"]), ["run", "split"])


# ------------------------------------------------------------------ G6, G7, F13

_DUCK_GEN_OK = f"(SELECT task_id, gen_id, bool_and(grade > 0) AS ok FROM ({duck.TEST_GRADES}) GROUP BY task_id, gen_id)"


@register("all_tests_pass", oracle=lambda: f"SELECT * FROM {_DUCK_GEN_OK}")
def q_all_tests_pass(spark, sf):
    """a generation passes iff all its test grades are > 0."""
    return all_tests_pass(fixtures.test_grades(spark, sf), "task_id", "gen_id", "grade")


@register("pass_at_k_multi_test", oracle=lambda: f"""
WITH c AS (SELECT task_id, count(*) AS n, CAST(count_if(ok) AS BIGINT) AS c FROM {_DUCK_GEN_OK} GROUP BY task_id),
ks AS (SELECT CAST(k AS INTEGER) AS k FROM (VALUES (1), (5)) t(k) WHERE k <= (SELECT min(n) FROM c))
SELECT k, CAST(NULL AS BIGINT) AS task_id, round(avg({_duck_est()}), 9) AS pass_at_k, count(*) AS n_tasks FROM c, ks GROUP BY k
UNION ALL SELECT k, task_id, round({_duck_est()}, 9), 1 FROM c, ks""")
def q_pass_at_k_multi_test(spark, sf):
    """pass@1 and pass@5 over tasks whose generations pass all tests, each k kept
    only when every task has at least k generations: per task, and the mean (null task)."""
    ok = all_tests_pass(fixtures.test_grades(spark, sf), "task_id", "gen_id", "grade")
    return pass_at_k_multi_test(ok, "task_id", (1, 5))


@register("instance_results", oracle=lambda: f"SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY gen_id) - 1 AS pos, ok FROM {_DUCK_GEN_OK}")
def q_instance_results(spark, sf):
    """Per task, pass flags of its generations in generation order."""
    ok = all_tests_pass(fixtures.test_grades(spark, sf), "task_id", "gen_id", "grade")
    return instance_results(ok, "task_id", "gen_id")


# ------------------------------------------------------------------ G8, G10-G15

@register("run_summary", oracle=lambda: f"""
SELECT run, split, count(*) AS n_rows, round(avg(response_len), 9) AS mean_response_len,
       CAST(count_if(is_valid) AS BIGINT) AS n_valid, CAST(count_if(is_correct) AS BIGINT) AS n_correct, CAST(count_if(tier = 'residual') AS BIGINT) AS n_residual,
       round(count_if(is_correct) / count(*), 9) AS accuracy
FROM ({duck.processed_generations()}) GROUP BY run, split""")
def q_run_summary(spark, sf):
    """Mean response length, valid and correct answers per run."""
    return cov.run_summary(process_generations(fixtures.generations(spark, sf)))


@register("checkpoint_coverage", oracle=lambda: f"""
WITH p AS ({_duck_pass(_duck_counts(['direction', 'epoch']), ['direction', 'epoch'])})
SELECT *, round(pass_at_k - lag(pass_at_k) OVER (PARTITION BY direction, k ORDER BY epoch), 9) AS delta_prev FROM p""")
def q_checkpoint_coverage(spark, sf):
    """pass@k per (direction, epoch) and the change from the previous epoch."""
    p = pass_at_k(_outcome_counts(spark, sf, ["direction", "epoch"]), ["direction", "epoch"])
    return cov.checkpoint_coverage(p)


@register("prefix_effect", oracle=lambda: f"""
WITH p AS ({_duck_pass(_duck_counts(['run', 'split']), ['run', 'split'])}),
b AS (SELECT split, k, pass_at_k AS default_pass_at_k FROM p WHERE run = 'view')
SELECT run, split, k, pass_at_k, default_pass_at_k, round(pass_at_k - default_pass_at_k, 9) AS delta
FROM p JOIN b USING (split, k) WHERE run <> 'view'""")
def q_prefix_effect(spark, sf):
    """pass@k of each run against the default run ('view')."""
    p = pass_at_k(_outcome_counts(spark, sf, ["run", "split"]), ["run", "split"])
    return cov.prefix_effect(p, "view")


@register("coverage_set_ops", oracle=lambda: f"""
WITH q AS (SELECT run, split, question_id, prompt_id, bool_or(is_correct AND (question_id + length(run)) % 3 > 0) AS solved FROM ({duck.OUTCOMES}) GROUP BY ALL),
d AS (SELECT split, question_id, prompt_id FROM q WHERE solved AND run = 'view')
SELECT run, split, question_id, prompt_id, 'gained' AS relation FROM q ANTI JOIN d USING (split, question_id, prompt_id) WHERE solved AND run <> 'view'
UNION ALL
SELECT run, split, question_id, prompt_id, 'lost' AS relation FROM q SEMI JOIN d USING (split, question_id, prompt_id) WHERE NOT solved AND run <> 'view'""")
def q_coverage_set_ops(spark, sf):
    """Questions a run solves that the default run ('view') does not, and the reverse."""
    o = fixtures.outcomes(spark, sf).withColumn("is_correct", F.expr("is_correct AND (question_id + length(run)) % 3 > 0"))  # each run misses a third of the questions
    return cov.coverage_set_ops(correct_counts(o, ["run", "split", *QK]), "view")


@register("subset_rollup", oracle=lambda: f"""
SELECT split, subset, CAST(grouping(split, subset) AS BIGINT) AS level, count(*) AS n, CAST(count_if(is_correct) AS BIGINT) AS n_correct,
       round(count_if(is_correct) / count(*), 9) AS accuracy
FROM ({duck.OUTCOMES}) GROUP BY ROLLUP (split, subset)""")
def q_subset_rollup(spark, sf):
    """Accuracy per (split, subset), per split and overall."""
    return cov.subset_rollup(fixtures.outcomes(spark, sf))


@register("mode_distribution", oracle=lambda: f"""
WITH c AS (SELECT run, mode, branch, count(*) AS n, CAST(count_if(is_correct) AS BIGINT) AS n_correct FROM ({duck.processed_generations()}) GROUP BY ALL)
SELECT *, round(n / sum(n) OVER (PARTITION BY run), 9) AS share, round(n_correct / n, 9) AS accuracy FROM c""")
def q_mode_distribution(spark, sf):
    """Share of code vs text answers and of extraction branches per run, with accuracy."""
    return cov.mode_distribution(process_generations(fixtures.generations(spark, sf)))


@register("metric_vectors", oracle=lambda: f"""
SELECT run, split, k, row_number() OVER (PARTITION BY run, split, k ORDER BY question_id, prompt_id) - 1 AS pos, round(p, 9) AS value
FROM {_duck_detail(_duck_counts(['run', 'split']), ['run', 'split'])}""")
def q_metric_vectors(spark, sf):
    """Per run and k, per-question pass@k values in question order."""
    return metric_vectors(_outcome_counts(spark, sf, ["run", "split"]), ["run", "split"], QK).withColumn("value", F.round("value", 9))
