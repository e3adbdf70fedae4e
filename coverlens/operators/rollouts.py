"""H1-H13 — group-relative rollout tables from logged episodes.

Rewards, advantages, padded batch layouts and loss diagnostics are computed
from logged tables (rewards, token log-probs, stored logits); no model runs.
Per-group statistics use windows partitioned by the group key (groups hold a
handful of samples); per-iteration metrics are partial+final aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coverlens.operators.ranking import rank_within

ADV_EPS = 1e-4
ZERO_TOL = 1e-8
PAD_ID = 0
IGNORE_INDEX = -100


def group_advantages(df: DataFrame, group: list[str], reward: str = "reward") -> DataFrame:
    """H1: (r - mean) / (population std + 1e-4) inside each sample group."""
    w = Window.partitionBy(*group)
    return df.withColumn("advantage", (F.col(reward) - F.avg(reward).over(w)) / (F.stddev_pop(reward).over(w) + F.lit(ADV_EPS)))


def token_advantages(adv: Column, response_len: Column) -> Column:
    """H2: the sample's advantage repeated once per response token."""
    return F.array_repeat(adv, response_len)


def rollout_stats(df: DataFrame, by: str = "iteration") -> DataFrame:
    """H3: mean reward, non-stop rate and response length per iteration.

    A metric is reported only when none of its inputs is NULL.
    """
    def mean_if_complete(c: Column, name: str) -> Column:
        return F.when(F.count(c) == F.count(F.lit(1)), F.round(F.avg(c), 9)).alias(name)

    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_episodes"),
        mean_if_complete(F.col("reward"), "rewards"),
        mean_if_complete((F.col("finish_reason") != "stop").cast("double"), "non_stop_rate"),
        mean_if_complete(F.col("resp_len").cast("double"), "response_lengths"),
    )


def padded_batches(df: DataFrame, batch: str = "batch") -> DataFrame:
    """H4: pad query+response to the batch maximum; ids 0, labels -100, masks 0/1,
    advantages 0.0 outside the response.

    ``advantage`` holds one number for each response token, or one for all.
    """
    per_token = F.col("advantage").cast("array<double>") if dict(df.dtypes)["advantage"].startswith("array") else F.array_repeat(F.col("advantage").cast("double"), F.size("response_ids"))
    q, r = F.col("query_ids"), F.col("response_ids")
    ql, rl = F.size(q), F.size(r)
    df = df.withColumn("__len", ql + rl).withColumn("__max", F.max(ql + rl).over(Window.partitionBy(batch)))
    pad = F.col("__max") - F.col("__len")
    return df.select(
        "*",
        F.concat(q, r, F.array_repeat(F.lit(PAD_ID), pad)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), F.col("__len")), F.array_repeat(F.lit(0), pad)).alias("attention_mask"),
        F.concat(F.array_repeat(F.lit(IGNORE_INDEX), ql), r, F.array_repeat(F.lit(IGNORE_INDEX), pad)).alias("labels"),
        F.concat(F.array_repeat(F.lit(0), ql), F.array_repeat(F.lit(1), rl), F.array_repeat(F.lit(0), pad)).alias("labels_mask"),
        F.concat(
            F.array_repeat(F.lit(0.0), ql), per_token, F.array_repeat(F.lit(0.0), pad)
        ).alias("advantages"),
    ).drop("__len", "__max")


def gradient_micro_batches(df: DataFrame, rank: str, order: str, size: int) -> DataFrame:
    """H5: consecutive slices of ``size`` rows inside each rank's shard."""
    ranked = rank_within(df, rank, [order], "__pos")
    return ranked.withColumn("micro_batch", F.floor((F.col("__pos") - 1) / size).cast("bigint")).drop("__pos")


def token_loss_metrics(tok: DataFrame, by: str = "iteration") -> DataFrame:
    """H6/H7: policy loss, KL penalty, entropy and zero-advantage ratio from
    logged log-probs, all divided by the number of response tokens."""
    m = F.col("mask").cast("double")
    delta = F.col("ref_logp") - F.col("logp")
    total = F.sum(m)
    return tok.groupBy(by).agg(
        F.round(F.try_divide(F.sum(-F.col("logp") * F.col("adv") * m), total), 9).alias("policy_loss"),
        F.round(F.try_divide(F.sum((F.exp(delta) - 1 - delta) * m), total), 9).alias("kl_penalty"),
        F.round(F.try_divide(-F.sum(F.col("logp") * m), total), 9).alias("entropy"),
        F.round(F.try_divide(F.sum(F.when(F.abs(F.col("adv")) < ZERO_TOL, m).otherwise(F.lit(0.0))), total), 9).alias("zero_advantages_ratio"),
    )


def log_softmax_gather(logits: Column, index: Column, temperature: float = 1.0) -> Column:
    """H8: ``log_softmax(logits / T)[index]`` with the max shift (index 0-based).

    The running maximum and the sum of exponentials relative to it are carried
    through one pass, so the cost is linear in the vocabulary.
    """
    scaled = lambda x: x.cast("double") / F.lit(temperature)
    start = F.struct(F.lit(float("-inf")).alias("m"), F.lit(0.0).alias("s"))

    def step(acc: Column, x: Column) -> Column:
        v = scaled(x)
        grown = F.struct(v.alias("m"), (acc["s"] * F.exp(acc["m"] - v) + 1.0).alias("s"))
        return F.when(v > acc["m"], grown).otherwise(F.struct(acc["m"].alias("m"), (acc["s"] + F.exp(v - acc["m"])).alias("s")))

    lse = F.aggregate(logits, start, step, lambda acc: acc["m"] + F.log(acc["s"]))
    return scaled(F.element_at(logits, index + 1)) - lse


def shifted_log_probs(logits: Column, labels: Column, temperature: float = 1.0) -> Column:
    """H8 over a sequence: position t scores label t + 1, and labels of -100 score 0 (the masked positions)."""
    at = F.sequence(F.lit(0), F.size(labels) - 2)
    score = lambda t: F.when(F.get(labels, t + 1) == IGNORE_INDEX, F.lit(0.0)).otherwise(log_softmax_gather(F.get(logits, t), F.get(labels, t + 1), temperature))
    return F.when(F.size(labels) > 1, F.transform(at, score)).otherwise(F.array().cast("array<double>"))


def sequence_log_probs(rows: DataFrame, *keys: str, logits: str = "logits", labels: str = "labels", temperature: float = 1.0) -> DataFrame:
    """H8 as a table: (keys, pos, logp) of every position but the last of sequences stored as a row each.

    ``logits`` holds one array per position.  A narrow projection: stored logits, the
    widest column there is, go through no exchange.
    """
    return rows.select(*keys, F.posexplode(shifted_log_probs(F.col(logits), F.col(labels), temperature)).alias("pos", "logp"))


KEY_METRICS = [
    # fixed values: metric names picked for the run log, in this order
    "train/kl_penalty",
    "train/rewards",
    "train/reward_metrics/format_reward",
    "train/reward_metrics/equation_reward",
    "train/response_lengths",
    "eval/rewards",
    "eval/reward_metrics/format_reward",
    "eval/reward_metrics/equation_reward",
]


def key_metrics(long_metrics: DataFrame) -> DataFrame:
    """Keep only the fixed key metric names that are present."""
    return long_metrics.where(F.col("metric").isin(KEY_METRICS))
