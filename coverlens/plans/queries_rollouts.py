"""Registered queries: rollout (RL) tables and rewards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from coverlens.operators import rollouts as ro
from coverlens.operators.grade import reward_int_match_sql
from coverlens.plans import fixtures
from coverlens.plans.oracle import duck
from coverlens.plans.registry import register
from coverlens.sources.tables import table

_DUCK_ADV = f"""(SELECT *, (reward - avg(reward) OVER w) / (stddev_pop(reward) OVER w + 1e-4) AS advantage
FROM ({duck.ROLLOUTS}) WINDOW w AS (PARTITION BY question_id, grp))"""


@register("group_advantages", oracle=lambda: f"SELECT event_id, question_id, grp, round(advantage, 9) AS advantage FROM {_DUCK_ADV}")
def q_group_advantages(spark, sf):
    """H1: group-normalised advantages, four samples per group."""
    df = ro.group_advantages(fixtures.rollouts(spark, sf), ["question_id", "grp"])
    return df.select("event_id", "question_id", "grp", F.round("advantage", 9).alias("advantage"))


@register("token_advantages", oracle=lambda: f"""
SELECT event_id, list_transform(range(resp_len), lambda i: round(advantage, 9)) AS token_advantages FROM {_DUCK_ADV}""")
def q_token_advantages(spark, sf):
    """H2: each sample's advantage repeated over its response tokens."""
    df = ro.group_advantages(fixtures.rollouts(spark, sf), ["question_id", "grp"])
    return df.select("event_id", ro.token_advantages(F.round("advantage", 9), F.col("resp_len")).alias("token_advantages"))


@register("rollout_stats", oracle=lambda: f"""
SELECT iteration, count(*) AS n_episodes, round(avg(reward), 9) AS rewards,
       round(avg(CAST(finish_reason <> 'stop' AS DOUBLE)), 9) AS non_stop_rate, round(avg(CAST(resp_len AS DOUBLE)), 9) AS response_lengths
FROM ({duck.ROLLOUTS}) GROUP BY iteration""")
def q_rollout_stats(spark, sf):
    """H3: mean reward, non-stop rate and response length per iteration."""
    return ro.rollout_stats(fixtures.episodes(spark, sf))


def _duck_rep(v: str, n: str) -> str:
    return f"list_transform(range(CAST({n} AS BIGINT)), lambda i: {v})"


@register("padded_batches", oracle=lambda: f"""
WITH b AS (SELECT *, len(query_ids) AS ql, len(response_ids) AS rl,
                  max(len(query_ids) + len(response_ids)) OVER (PARTITION BY batch) - len(query_ids) - len(response_ids) AS pad
           FROM ({duck.BATCHES}))
SELECT seq_id, batch,
  list_concat(list_concat(query_ids, response_ids), {_duck_rep('CAST(0 AS INTEGER)', 'pad')}) AS input_ids,
  list_concat({_duck_rep('CAST(1 AS INTEGER)', 'ql + rl')}, {_duck_rep('CAST(0 AS INTEGER)', 'pad')}) AS attention_mask,
  list_concat(list_concat({_duck_rep('CAST(-100 AS INTEGER)', 'ql')}, response_ids), {_duck_rep('CAST(-100 AS INTEGER)', 'pad')}) AS labels,
  list_concat(list_concat({_duck_rep('CAST(0 AS INTEGER)', 'ql')}, {_duck_rep('CAST(1 AS INTEGER)', 'rl')}), {_duck_rep('CAST(0 AS INTEGER)', 'pad')}) AS labels_mask,
  list_concat(list_concat({_duck_rep('0.0::DOUBLE', 'ql')}, {_duck_rep('advantage', 'rl')}), {_duck_rep('0.0::DOUBLE', 'pad')}) AS advantages
FROM b""")
def q_padded_batches(spark, sf):
    """H4: padded input ids, masks, labels and token advantages per batch."""
    df = ro.padded_batches(fixtures.batches(spark, sf))
    return df.select("seq_id", "batch", "input_ids", "attention_mask", "labels", "labels_mask", "advantages")


@register("gradient_micro_batches", oracle=lambda: f"""
SELECT seq_id, CAST(seq_id % 4 AS INTEGER) AS rank,
       CAST(floor((row_number() OVER (PARTITION BY seq_id % 4 ORDER BY seq_id) - 1) / 8) AS BIGINT) AS micro_batch
FROM ({duck.BATCHES})""")
def q_gradient_micro_batches(spark, sf):
    """H5: 8-row micro-batches inside each of 4 rank shards (consecutive by id)."""
    df = fixtures.batches(spark, sf).select("seq_id", (F.col("seq_id") % 4).cast("int").alias("rank"))
    return ro.gradient_micro_batches(df, "rank", "seq_id", 8).select("seq_id", "rank", "micro_batch")


@register("token_loss_metrics", oracle=lambda: f"""
SELECT iteration,
  round(sum(-logp * adv * mask) / nullif(sum(mask), 0), 9) + 0.0 AS policy_loss,
  round(sum((exp(ref_logp - logp) - 1 - (ref_logp - logp)) * mask) / nullif(sum(mask), 0), 9) + 0.0 AS kl_penalty,
  round(-sum(logp * mask) / nullif(sum(mask), 0), 9) + 0.0 AS entropy,
  round(sum(CASE WHEN abs(adv) < 1e-8 THEN CAST(mask AS DOUBLE) ELSE 0.0 END) / nullif(sum(mask), 0), 9) + 0.0 AS zero_advantages_ratio
FROM ({duck.TOKENS}) GROUP BY iteration""")
def q_token_loss_metrics(spark, sf):
    """H6: masked policy loss, KL penalty, entropy per iteration (logged log-probs)."""
    return ro.token_loss_metrics(fixtures.tokens(spark, sf))


@register("zero_advantage_ratio", oracle=lambda: f"""
SELECT iteration, round(count_if(abs(adv) < 1e-8 AND mask = 1) / nullif(sum(mask), 0), 9) AS zero_advantages_ratio
FROM ({duck.TOKENS}) GROUP BY iteration""")
def q_zero_advantage_ratio(spark, sf):
    """H7: share of response tokens whose advantage is ~0."""
    t = fixtures.tokens(spark, sf)
    return t.groupBy("iteration").agg(
        F.round(F.try_divide(F.count_if((F.abs("adv") < ro.ZERO_TOL) & (F.col("mask") == 1)), F.sum("mask")), 9).alias("zero_advantages_ratio")
    )


@register("score_stored_logits", oracle=lambda: """
WITH s AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / 0.7) AS z FROM embeddings),
m AS (SELECT *, list_max(z) AS mx FROM s)
SELECT vec_id, label, round(z[label + 1] - (mx + ln(list_sum(list_transform(z, lambda x: exp(x - mx))))), 6) AS logp FROM m""")
def q_score_stored_logits(spark, sf):
    """H8: temperature-scaled log-softmax of stored logits gathered at the chosen index."""
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "label", F.round(ro.log_softmax_gather(F.col("embedding"), F.col("label"), 0.7), 6).alias("logp"))


@register("score_sequences", oracle="""
WITH s AS (SELECT vec_id // 8 AS seq_id, vec_id, embedding AS logits, CASE WHEN vec_id % 5 = 0 THEN -100 ELSE label END AS label, row_number() OVER (PARTITION BY vec_id // 8 ORDER BY vec_id) - 1 AS pos FROM embeddings),
n AS (SELECT seq_id, pos, list_transform(logits, lambda x: CAST(x AS DOUBLE) / 0.7) AS z, lead(label) OVER (PARTITION BY seq_id ORDER BY pos) AS next FROM s),
m AS (SELECT *, list_max(z) AS mx FROM n WHERE next IS NOT NULL)
SELECT seq_id, pos, CASE WHEN next = -100 THEN 0.0 ELSE round(z[next + 1] - (mx + ln(list_sum(list_transform(z, lambda x: exp(x - mx))))), 6) END AS logp FROM m""")
def q_score_sequences(spark, sf):
    """H8 over sequences: position t scores label t + 1, masked labels (-100) score 0; one row per position.

    The stand-in makes sequences of eight rows of logits.
    """
    e = table(spark, sf, "embeddings").select((F.col("vec_id") / 8).cast("bigint").alias("seq_id"), F.struct(
        "vec_id", F.col("embedding").alias("logits"), F.when(F.col("vec_id") % 5 == 0, -100).otherwise(F.col("label")).cast("int").alias("label")).alias("r"))
    rows = e.groupBy("seq_id").agg(F.array_sort(F.collect_list("r")).alias("r")).select("seq_id", F.col("r.logits").alias("logits"), F.col("r.label").alias("labels"))
    return ro.sequence_log_probs(rows, "seq_id", temperature=0.7).withColumn("logp", F.round("logp", 6))


@register("holdout_split", oracle="""
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id) <= 10 THEN 'test' ELSE 'train' END AS split
FROM documents""")
def q_holdout_split(spark, sf):
    """H9: 10-row test hold-out by a seeded hash order; the rest is train."""
    docs = table(spark, sf, "documents").select("doc_id")
    order = F.md5(F.concat(F.lit("42|"), F.col("doc_id").cast("string")))
    test_ids = docs.orderBy(order, "doc_id").limit(10).select("doc_id", F.lit("test").alias("split"))
    return docs.join(F.broadcast(test_ids), "doc_id", "left").select("doc_id", F.coalesce("split", F.lit("train")).alias("split"))


@register("rank_shards", oracle="SELECT doc_id, CAST(doc_id % 4 AS INTEGER) AS rank FROM documents")
def q_rank_shards(spark, sf):
    """Train rows spread over 4 ranks by index modulus."""
    return table(spark, sf, "documents").select("doc_id", F.pmod(F.col("doc_id"), F.lit(4)).cast("int").alias("rank"))


@register("iteration_sample", oracle=lambda: f"""
SELECT iteration, event_id FROM (
  SELECT iteration, event_id, row_number() OVER (PARTITION BY iteration ORDER BY md5('42|' || CAST(iteration AS VARCHAR) || '|' || CAST(event_id AS VARCHAR)), event_id) AS rn
  FROM ({duck.ROLLOUTS})) WHERE rn <= 16""")
def q_iteration_sample(spark, sf):
    """Per iteration, 16 episodes sampled without replacement by a seeded hash."""
    r = fixtures.episodes(spark, sf)
    # row_number <= 16 becomes a per-task WindowGroupLimit before the exchange
    w = F.row_number().over(Window.partitionBy("iteration").orderBy(F.md5(F.concat_ws("|", F.lit("42"), F.col("iteration"), F.col("event_id"))), "event_id"))
    return r.withColumn("__rn", w).where(F.col("__rn") <= 16).select("iteration", "event_id")


@register("reward_int_match", oracle=lambda: f"""
SELECT sample_id, {duck.reward_boxed('response')} AS reward_answer,
       {duck.reward_int_match('response', 'gt_answer')} AS reward FROM ({duck.GENERATIONS})""")
def q_reward_int_match(spark, sf):
    """F12 (+E9): boxed answer read as an integer equal to the target -> 1.0."""
    from coverlens.operators.extract import extract_boxed_reward_sql

    g = fixtures.generations(spark, sf)
    return g.select(
        "sample_id",
        F.expr(extract_boxed_reward_sql("response")).alias("reward_answer"),
        F.expr(reward_int_match_sql("response", "gt_answer")).alias("reward"),
    )


@register("eval_rollouts", oracle=lambda: f"""
SELECT run, 'eval' AS phase, count(*) AS n_episodes, round(avg(r), 9) AS rewards,
       round(avg(CAST(regexp_count_words AS DOUBLE)), 9) AS response_lengths, round(avg(CAST(sample_id % 7 = 3 AS DOUBLE)), 9) AS non_stop_rate,
       MAP {{'equation_reward': round(avg(r), 9)}} AS reward_metrics
FROM (SELECT run, sample_id, {duck.reward_int_match('response', 'gt_answer')} AS r,
             len(regexp_extract_all(response, '\\S+', 0)) AS regexp_count_words FROM ({duck.GENERATIONS}))
GROUP BY run""")
def q_eval_rollouts(spark, sf):
    """Evaluation rollouts: reward, length, non-stop rate and named reward components per run."""
    g = fixtures.generations(spark, sf).select(
        "run",
        F.expr(reward_int_match_sql("response", "gt_answer")).alias("r"),
        F.expr("regexp_count(response, '(?U)\\\\S+')").alias("len"),
        F.when(F.col("sample_id") % 7 == 3, "length").otherwise("stop").alias("finish_reason"),
    )
    return g.groupBy("run").agg(
        F.lit("eval").alias("phase"),
        F.count(F.lit(1)).alias("n_episodes"),
        F.round(F.avg("r"), 9).alias("rewards"),
        F.round(F.avg(F.col("len").cast("double")), 9).alias("response_lengths"),
        F.round(F.avg((F.col("finish_reason") != "stop").cast("double")), 9).alias("non_stop_rate"),
        F.create_map(F.lit("equation_reward"), F.round(F.avg("r"), 9)).alias("reward_metrics"),
    )


@register("key_metrics", oracle=lambda: f"""
WITH s AS (SELECT iteration, round(avg(reward), 9) AS rewards, round(avg(CAST(resp_len AS DOUBLE)), 9) AS response_lengths,
                  round(avg(CAST(finish_reason <> 'stop' AS DOUBLE)), 9) AS non_stop_rate FROM ({duck.ROLLOUTS}) GROUP BY iteration)
SELECT iteration, metric, value FROM (
  UNPIVOT (SELECT iteration, rewards AS "train/rewards", response_lengths AS "train/response_lengths", non_stop_rate AS "train/non_stop_rate" FROM s)
  ON "train/rewards", "train/response_lengths", "train/non_stop_rate" INTO NAME metric VALUE value)
WHERE metric IN ('train/kl_penalty', 'train/rewards', 'train/reward_metrics/format_reward', 'train/reward_metrics/equation_reward',
                 'train/response_lengths', 'eval/rewards', 'eval/reward_metrics/format_reward', 'eval/reward_metrics/equation_reward')""")
def q_key_metrics(spark, sf):
    """Unpivot per-iteration metrics and keep the fixed key-metric names present."""
    s = ro.rollout_stats(fixtures.episodes(spark, sf))
    long = s.select(
        "iteration",
        F.expr("stack(3, 'train/rewards', rewards, 'train/response_lengths', response_lengths, 'train/non_stop_rate', non_stop_rate) AS (metric, value)"),
    )
    return ro.key_metrics(long)
