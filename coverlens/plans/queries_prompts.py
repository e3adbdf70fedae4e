"""Registered queries: prompt, job and training-text tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from coverlens.operators import prompts as P
from coverlens.plans.oracle import duck
from coverlens.plans.registry import register
from coverlens.session import ensure_checkpoint_dir
from coverlens.sources.readers import read_job_list, read_run_configs
from coverlens.sources.sinks import write_run_config
from coverlens.sources.tables import table


def items(spark, sf):
    """Benchmark items view: id, Question, answer, subset."""
    b = table(spark, sf, "benchmark")
    return b.select(
        F.col("item_id").alias("id"), F.col("text").alias("Question"),
        F.length("text").cast("string").alias("answer"), F.concat(F.lit("set"), (F.col("item_id") % 3).cast("string")).alias("subset"),
    )


ITEMS = "SELECT item_id AS id, text AS Question, CAST(length(text) AS VARCHAR) AS answer, 'set' || CAST(item_id % 3 AS VARCHAR) AS subset FROM benchmark"
_HEAD = duck.s(P.USER_HEAD)
_TAIL = duck.s(P.USER_TAIL)


def _duck_turn(role: str, content: str) -> str:
    return (
        f"(CASE WHEN {role} = 'user' THEN {_HEAD} || {content} || {_TAIL} "
        f"WHEN {role} IN ('system', 'assistant') THEN {content} || chr(10) ELSE '' END)"
    )


_PROMPTS = f"SELECT id AS question_id, id AS prompt_id, Question AS question, answer, {_duck_turn(chr(39) + 'user' + chr(39), 'Question')} AS prompt FROM ({ITEMS})"


def prompts(spark, sf):
    it = items(spark, sf)
    return it.select(
        F.col("id").alias("question_id"), F.col("id").alias("prompt_id"), F.col("Question").alias("question"), "answer",
        P.build_prompt(F.col("Question")).alias("prompt"),
    )


@register("build_prompts", oracle=lambda: _PROMPTS)
def q_build_prompts(spark, sf):
    """B1: benchmark items -> chat-templated prompt rows."""
    return prompts(spark, sf)


@register("render_alpaca", oracle=lambda: f"""
SELECT conv_id, string_agg({_duck_turn('role', 'text')}, '' ORDER BY turn) AS rendered FROM conversations GROUP BY conv_id""")
def q_render_alpaca(spark, sf):
    """B2: whole conversations rendered with the instruction template."""
    c = table(spark, sf, "conversations")
    msgs = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return msgs.select("conv_id", P.render_messages(F.col("m")).alias("rendered"))


_RUNS = "(VALUES ('default', NULL), ('prefix_Okay', 'Okay'), ('prefix_Let', 'Let'), ('prefix_Alright', 'Alright'), ('prefix_To', 'To')) r(run, prefix)"


def _run_table(spark):
    """The run dimension of the default runs, from config files as the job scripts leave them."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/io/runs-{uuid.uuid4().hex}"
    for run, prefix in P.RUN_PREFIXES:
        text = "sampler:\n  class: VLLMSampler\n  temperature: 0.6" + (f"\n  thinking_prefix: {prefix}" if prefix else "")
        write_run_config(spark.createDataFrame([(text,)], "value string"), base, run)
    return read_run_configs(spark, base)


@register("prefix_variants", oracle=lambda: f"SELECT question_id, run, prompt || coalesce(prefix, '') AS run_prompt FROM ({_PROMPTS}), {_RUNS}")
def q_prefix_variants(spark, sf):
    """Every prompt once per run of the run table with the run's thinking prefix appended."""
    return P.prefix_variants(prompts(spark, sf), runs=_run_table(spark)).select("question_id", "run", "run_prompt")


@register("job_matrix", oracle=lambda: f"SELECT subset, id AS question_id, run, CAST(s AS INTEGER) AS sample_idx FROM ({ITEMS}), {_RUNS}, range(1, 9) t(s)")
def q_job_matrix(spark, sf):
    """Items (of every dataset) x runs of the run table x 8 sample slots."""
    return P.job_matrix(items(spark, sf), 8, _run_table(spark)).select("subset", F.col("id").alias("question_id"), "run", "sample_idx")


@register("job_groups", oracle=lambda: f"""
SELECT 'jobs/' || subset AS job_dir, 'test' AS split, list(DISTINCT 'jobs/' || subset || '/' || run ORDER BY 'jobs/' || subset || '/' || run) AS run_dirs
FROM ({ITEMS}), {_RUNS} GROUP BY subset""")
def q_job_groups(spark, sf):
    """Run directories grouped by (job dir, split), from a job list file."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/io/job-list-{uuid.uuid4().hex}"
    j = P.job_matrix(items(spark, sf).select("subset").distinct(), 1)
    j.select(F.concat(F.lit("jobs/"), "subset", F.lit("|"), "run", F.lit("|test|8")).alias("line")).write.text(path)
    return P.job_groups(read_job_list(spark, path))


def _candidates(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_partkey").alias("prompt"), F.col("l_suppkey").alias("token")).agg(F.max(-F.col("l_extendedprice")).alias("logprob"))


_DUCK_CANDS = "SELECT l_partkey AS prompt, l_suppkey AS token, max(-l_extendedprice) AS logprob FROM lineitem GROUP BY ALL"
_DUCK_FANOUT = f"""
WITH top AS (SELECT prompt, list(token ORDER BY logprob DESC, token) AS c FROM (
   SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY logprob DESC, token) AS r FROM ({_DUCK_CANDS})) WHERE r <= 8 GROUP BY prompt)
SELECT prompt, CAST(row_number() OVER (PARTITION BY prompt ORDER BY md5('42|' || CAST(prompt AS VARCHAR) || '|' || CAST(s AS VARCHAR))) - 1 AS INTEGER) AS slot, c[(s % len(c)) + 1] AS first_token
FROM top, range(0, 10) t(s)"""


@register("first_token_fanout", oracle=lambda: _DUCK_FANOUT)
def q_first_token_fanout(spark, sf):
    """Top-8 first tokens per prompt repeated cyclically to 10 forced-prefix slots, in a seeded order."""
    return P.first_token_fanout(_candidates(spark, sf), 8, 10, seed=42)


def _flat(spark, sf):
    f = P.first_token_fanout(_candidates(spark, sf), 8, 10, seed=42)
    return f.select(
        "prompt", "slot", "first_token", F.concat(F.lit(" then "), F.col("slot").cast("string")).alias("text"),
        (F.col("slot") % 3 + 5).alias("completion_tokens"), F.lit(21).alias("prompt_tokens"),
    )


_DUCK_REGROUP = f"""
SELECT prompt, list(CAST(first_token AS VARCHAR) || ' then ' || CAST(slot AS VARCHAR) ORDER BY slot) AS choices,
       list(slot % 3 + 6 ORDER BY slot) AS completion_tokens, 20 AS prompt_tokens
FROM ({_DUCK_FANOUT}) GROUP BY prompt"""


@register("regroup_choices", oracle=lambda: _DUCK_REGROUP)
def q_regroup_choices(spark, sf):
    """Flat forced-prefix outputs regrouped per prompt in slot order."""
    return P.regroup_choices(_flat(spark, sf))


@register("attach_generation_meta", oracle=lambda: f"""
WITH p AS (SELECT question_id, question FROM ({_PROMPTS})), r AS ({_DUCK_REGROUP})
SELECT question_id, question, CAST(i - 1 AS INTEGER) AS sample_idx, choices[i] AS response,
       coalesce(prompt_tokens, 0) AS n_prompt_tokens, coalesce(completion_tokens[i], 0) AS n_completion_tokens
FROM p LEFT JOIN r ON p.question_id = r.prompt, range(1, coalesce(len(choices), 1) + 1) t(i)""")
def q_attach_generation_meta(spark, sf):
    """Prompts joined to their sampled choices by key; one row per choice."""
    p = prompts(spark, sf).select("question_id", "question")
    r = P.regroup_choices(_flat(spark, sf)).withColumnRenamed("prompt", "question_id")
    out = P.attach_generation_meta(p, r, "question_id")
    return out.withColumn("sample_idx", F.coalesce("sample_idx", F.lit(0)))


@register("flatten_conversations", oracle="""
SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id""")
def q_flatten_conversations(spark, sf):
    """Conversation turns joined as ``role: content`` lines."""
    return P.flatten_conversations(table(spark, sf, "conversations"))


def _sft(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", P.sft_messages(F.col("text"), F.col("text")).alias("messages"))


@register("sft_messages", oracle="""
SELECT doc_id, [{'role': 'user', 'content': text}, {'role': 'assistant', 'content': ' ' || text}] AS messages FROM documents""")
def q_sft_messages(spark, sf):
    """user/assistant message pairs from whole documents."""
    return _sft(spark, sf)


_DUCK_SFT_TEXT = f"SELECT doc_id, {_duck_turn(chr(39) + 'user' + chr(39), 'text')} || {_duck_turn(chr(39) + 'assistant' + chr(39), chr(39) + ' ' + chr(39) + ' || text')} AS text FROM documents"


@register("sft_render_text", oracle=lambda: _DUCK_SFT_TEXT)
def q_sft_render_text(spark, sf):
    """Training text rendered from the messages (no generation prompt)."""
    return _sft(spark, sf).select("doc_id", P.render_messages(F.col("messages")).alias("text"))


@register("response_only_span", oracle=lambda: f"""
SELECT doc_id, CAST(st AS INTEGER) AS span_start, CAST(ln AS INTEGER) AS span_len, round(ln / length(text), 9) AS trained_fraction FROM (
  SELECT doc_id, text, CASE WHEN strpos(text, {duck.s(P.RESPONSE_MARK)}) > 0 THEN strpos(text, {duck.s(P.RESPONSE_MARK)}) + {len(P.RESPONSE_MARK)} ELSE 0 END AS st,
         CASE WHEN strpos(text, {duck.s(P.RESPONSE_MARK)}) > 0 THEN length(text) - (strpos(text, {duck.s(P.RESPONSE_MARK)}) + {len(P.RESPONSE_MARK)}) + 1 ELSE 0 END AS ln
  FROM ({_DUCK_SFT_TEXT}))""")
def q_response_only_span(spark, sf):
    """The trained (response) span of each rendered training text."""
    t = _sft(spark, sf).select("doc_id", P.render_messages(F.col("messages")).alias("text"))
    st, ln = P.response_only_span(F.col("text"))
    return t.select("doc_id", st.alias("span_start"), ln.alias("span_len"), F.round(ln / F.length("text"), 9).alias("trained_fraction"))
