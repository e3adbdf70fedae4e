"""Registered queries: streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from coverlens.operators.estimators import pass_at_k
from coverlens.plans import fixtures
from coverlens.plans.oracle import duck
from coverlens.plans.queries_eval import _pass_at_k_sql
from coverlens.plans.registry import register
from coverlens.sources.tables import table
from coverlens.streaming import monitors as M


@register("stream_pass_counts", oracle=lambda: f"""
SELECT run, split, question_id, prompt_id, count(*) AS n, CAST(count_if(is_correct) AS BIGINT) AS c FROM ({duck.processed_generations()}) GROUP BY ALL""")
def q_stream_pass_counts(spark, sf):
    """Per-question counts from a file stream whose shards come twice in part (equals batch G1 without cutoff)."""
    return _stream_counts(spark, sf, "pass-counts")


def _stream_counts(spark, sf, name):
    """Two runs of the stream: four shards, then one of them again together with new samples of another."""
    base = M.workdir(spark, name)
    gens = fixtures.generations(spark, sf).withColumn("shard", (F.col("sample_id") % 4).cast("int"))
    late = (F.col("shard") == 3) & (F.col("sample_id") % 8 == 7)
    M.stage_shards(gens.where(~late), f"{base}/shards")
    M.stream_pass_counts(spark, f"{base}/shards", f"{base}/out", f"{base}/ckpt")
    again = gens.where(late | (F.col("shard") == 1)).withColumn("shard", F.col("shard") + 4)
    M.stage_shards(again, f"{base}/shards")
    return M.stream_pass_counts(spark, f"{base}/shards", f"{base}/out", f"{base}/ckpt")


@register("stream_pass_at_k", oracle=lambda: _pass_at_k_sql(["run", "split"], 1 << 40))
def q_stream_pass_at_k(spark, sf):
    """Running pass@k by run from the streamed counts."""
    return pass_at_k(_stream_counts(spark, sf, "pass-at-k"), ["run", "split"])


@register("stream_reward_monitor", oracle=lambda: f"""
WITH r AS ({duck.ROLLOUTS.replace('FROM events', ', ts FROM events')}),
w AS (SELECT date_trunc('day', ts) AS d, count(*) AS n_episodes, round(avg(reward), 9) AS rewards,
             round(avg(CAST(finish_reason <> 'stop' AS DOUBLE)), 9) AS non_stop_rate FROM r GROUP BY 1)
SELECT strftime(d, '%Y-%m-%d %H:%M:%S') AS window_start, n_episodes, rewards, non_stop_rate
FROM w WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) FROM r) - INTERVAL 1 DAY""")
def q_stream_reward_monitor(spark, sf):
    """Watermarked daily reward windows; windows still open at the end are not emitted."""
    base = M.workdir(spark, "reward-monitor")
    r = fixtures.episodes(spark, sf).select(
        "event_id", "ts", "reward", "finish_reason", "resp_len", (F.col("event_id") % 4).cast("int").alias("shard")
    )
    M.stage_shards(r, f"{base}/shards")
    return M.stream_reward_monitor(spark, f"{base}/shards", f"{base}/out", f"{base}/ckpt")


@register("stream_reward_sliding", oracle=lambda: f"""
WITH r AS (SELECT *, event_id % 10 = 0 AS late FROM ({duck.ROLLOUTS.replace('FROM events', ', ts FROM events')})),
mark AS (SELECT max(ts) FILTER (NOT late) - INTERVAL 1 DAY AS first, max(ts) - INTERVAL 1 DAY AS last FROM r),
w AS (SELECT *, date_trunc('day', ts) - to_days(CAST(i AS INTEGER)) AS ws FROM r, range(2) s(i)),
counted AS (SELECT ws, ws + INTERVAL 2 DAY AS we, reward, finish_reason FROM w, mark WHERE NOT late OR ws + INTERVAL 2 DAY > first)
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(we, '%Y-%m-%d %H:%M:%S') AS window_end, count(*) AS n_episodes, round(avg(reward), 9) AS rewards,
  round(avg(CAST(finish_reason <> 'stop' AS DOUBLE)), 9) AS non_stop_rate
FROM counted, mark WHERE we <= last GROUP BY ws, we""")
def q_stream_reward_sliding(spark, sf):
    """Two-day windows every day; a tenth of the episodes comes in a second delivery, most of it too late for its windows."""
    base = M.workdir(spark, "reward-sliding")
    r = fixtures.episodes(spark, sf).select("event_id", "ts", "reward", "finish_reason", "resp_len", (F.col("event_id") % 4).cast("int").alias("shard"))
    late = F.col("event_id") % 10 == 0
    for rows in (r.where(~late), r.where(late).withColumn("shard", F.col("shard") + 4)):
        M.stage_shards(rows, f"{base}/shards")
        out = M.stream_reward_sliding(spark, f"{base}/shards", f"{base}/out", f"{base}/ckpt")
    return out
