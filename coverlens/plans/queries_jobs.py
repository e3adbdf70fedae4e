"""Registered queries: the evaluation job from files, job list to metrics documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from coverlens.operators import coverage as cov
from coverlens.operators.ranking import rank_within
from coverlens.plans import file_jobs as J
from coverlens.plans import fixtures
from coverlens.plans.oracle import duck
from coverlens.plans.registry import register
from coverlens.session import ensure_checkpoint_dir
from coverlens.sources import readers as R
from coverlens.sources import sinks as S

CUTOFF = 4
_JOB = "CASE WHEN run < 'm' THEN 'jobs/first' ELSE 'jobs/second set' END"


def _staged(spark, sf):
    """Stand-in for what samplers leave behind: shards in run folders, two workers a run, and a job list.

    The list leaves one run out and names one that has no shards.  A shard is a folder
    of as many part files in order of samples as there are cores, for a multi-line file
    is written and read by one task.
    """
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/io/jobs-{uuid.uuid4().hex}"
    g = fixtures.generations(spark, sf).select(
        "run", "sample_id", "question_id", "prompt_id", "response", F.lit(None).cast("string").alias("pred_answer"), "gt_answer",
        F.lit('{"temperature": 0.6}').alias("sampler_config"), (F.col("question_id") % 5 + 20).cast("int").alias("prompt_tokens"),
        (F.col("sample_id") % 400).cast("int").alias("completion_tokens"))
    runs = [(r.run, r.job) for r in g.select("run", F.expr(_JOB).alias("job")).distinct().collect()]
    parts = max(2, spark.sparkContext.defaultParallelism)
    for run, job in runs:
        for w in range(2):
            rows = g.where((F.col("run") == run) & (F.col("sample_id") % 2 == w)).repartitionByRange(parts, "sample_id").sortWithinPartitions("sample_id")
            S.write_generation_shard(rows.drop("run", "sample_id"), f"{base}/runs/{job}/{run}", "test", w, "20260101_000000", w)
    lines = [f"{job}|{run}|test|8" for run, job in sorted(runs)[1:]] + ["jobs/first|never sampled|test|8"]
    spark.createDataFrame([(x,) for x in lines], "line string").write.text(f"{base}/job_list")
    return base


_RANKED = f"""(SELECT *, {_JOB} AS job_dir, row_number() OVER (PARTITION BY run, question_id, prompt_id ORDER BY sample_id % 2, sample_id) AS place
FROM ({duck.processed_generations()}) WHERE run > (SELECT min(event_type) FROM events))"""


@register("src_run_shards", oracle=lambda: f"""
SELECT {_JOB} AS job_dir, run, 'test' AS split, CAST(sample_id % 2 AS BIGINT) AS seed, '20260101_000000' AS ts, CAST(sample_id % 2 AS INTEGER) AS worker,
  row_number() OVER (PARTITION BY run ORDER BY sample_id % 2, sample_id) AS position, question_id, response, CAST(sample_id % 400 AS INTEGER) AS completion_tokens
FROM ({duck.GENERATIONS})""")
def q_src_run_shards(spark, sf):
    """A2/A3: shards of many run folders in one scan, run and lineage from the path, samples numbered in their order."""
    g = R.read_run_shards(spark, f"{_staged(spark, sf)}/runs")
    return rank_within(g, ["job_dir", "run"], ["place"], "position").select("job_dir", "run", "split", "seed", "ts", "worker", "position", "question_id", "response", "completion_tokens")


@register("file_job_metrics", oracle=lambda: f"""
WITH g AS {_RANKED},
counts AS (SELECT job_dir, run, question_id, prompt_id, count(*) AS n, count_if(is_correct) AS c FROM g WHERE place <= {CUTOFF} GROUP BY ALL),
pos AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY question_id, prompt_id) - 1 AS pos, least(2000, min(n) OVER (PARTITION BY run)) AS top FROM counts),
det AS (
  SELECT job_dir, run, pos, k, CASE WHEN n - c < k THEN 1.0 WHEN c = 0 THEN 0.0
    ELSE 1.0 - list_reduce(list_transform(range(CAST(n - c + 1 AS BIGINT), CAST(n + 1 AS BIGINT)), lambda i: 1.0 - k / i), lambda a, b: a * b) END AS p
  FROM (SELECT *, unnest(range(1, top + 1)) AS k FROM pos))
SELECT job_dir, run, 'test' AS split, 'pass@' || CAST(k AS VARCHAR) AS metric, pos, round(p, 9) AS value FROM det
UNION ALL SELECT job_dir, run, 'test', 'mean_pass@' || CAST(k AS VARCHAR), NULL, round(avg(p), 9) FROM det GROUP BY ALL
UNION ALL SELECT job_dir, run, 'test', 'mean_response_len', NULL, round(avg(response_len), 9) FROM g GROUP BY ALL""")
def q_file_job_metrics(spark, sf):
    """Job list -> shards -> processed rows -> metrics documents, written and read back."""
    base = _staged(spark, sf)
    processed = J.process_jobs(spark, f"{base}/runs", f"{base}/job_list", f"{base}/processed")
    path = J.write_metrics(processed, base, "20260102_000000", CUTOFF)
    return J.read_metrics(spark, path).withColumn("value", F.round("value", 9))


@register("file_job_summary", oracle=lambda: f"""
SELECT job_dir, run, 'test' AS split, count(*) AS n_rows, round(avg(response_len), 9) AS mean_response_len, CAST(count_if(is_valid) AS BIGINT) AS n_valid,
  CAST(count_if(is_correct) AS BIGINT) AS n_correct, CAST(count_if(tier = 'residual') AS BIGINT) AS n_residual, round(count_if(is_correct) / count(*), 9) AS accuracy,
  CAST(sum(question_id % 5 + 20) AS BIGINT) AS prompt_tokens, CAST(sum(sample_id % 400) AS BIGINT) AS completion_tokens
FROM {_RANKED} GROUP BY ALL
UNION ALL SELECT 'jobs/first', 'never sampled', 'test', 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL""")
def q_file_job_summary(spark, sf):
    """A9/G8 from files: each job of the list with its processed rows, their summary and token totals."""
    base = _staged(spark, sf)
    processed = J.process_jobs(spark, f"{base}/runs", f"{base}/job_list", f"{base}/processed")
    summary = cov.run_summary(processed, J.RUN).drop("n_rows")
    return J.job_status(spark, f"{base}/job_list", processed).join(summary, list(J.RUN), "left")
