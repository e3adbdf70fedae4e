"""B1-B12 — prompt, job and training-text tables as projections and explodes.

Fan-outs (runs x samples, first-token slots) are ``explode`` over small,
fixed arrays inside each row, not joins; regrouping collects bounded lists
(one prompt's n samples, one conversation's turns).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: instruction template (system / user / assistant turns) ------
USER_HEAD = (
    "Below is an instruction that describes a task, paired with an input that provides further context. "
    "Write a response that appropriately completes the request.\n\n### Instruction:\n"
    "Solve the following math problem, and put your final answer within \\\\boxed{}.\n\n### Input:\n"
)
USER_TAIL = "\n\n### Response:\n"
RESPONSE_MARK = "### Response:\n"
# ------------------------------------------------------------------------------

# --- fixed values: thinking prefixes of the prefix study (None = default run) --
RUN_PREFIXES = [("default", None), ("prefix_Okay", "Okay"), ("prefix_Let", "Let"), ("prefix_Alright", "Alright"), ("prefix_To", "To")]
# ------------------------------------------------------------------------------


def render_turn(role: Column, content: Column) -> Column:
    """B2: one message of the instruction template.

    The chat renderer trims the line break after each block tag, so only the
    line breaks of the template's text and after a value remain.
    """
    return (
        F.when(role == "user", F.concat(F.lit(USER_HEAD), content, F.lit(USER_TAIL)))
        .when(role.isin("system", "assistant"), F.concat(content, F.lit("\n")))
        .otherwise(F.lit(""))
    )


def render_user_prompt(question: Column) -> Column:
    """B1: chat-templated prompt of a single user question."""
    return render_turn(F.lit("user"), question)


def render_messages(messages: Column) -> Column:
    """Render an ``array<struct<role, content>>`` in order."""
    return F.array_join(F.transform(messages, lambda m: render_turn(m["role"], m["content"])), "")


def build_prompt(question: Column, template: str | None = None) -> Column:
    """B1 ``build_prompt``: ``<question>`` substitution or positional format, then chat template."""
    if template:
        if "<question>" in template:
            question = F.replace(F.lit(template), F.lit("<question>"), question)
        else:
            question = F.format_string(template.replace("%", "%%").replace("{}", "%s"), question, F.lit(""))
    return render_user_prompt(question)


def _run_list(runs: DataFrame | None) -> Column:
    """(run, prefix) of a run dimension (A6, a handful of rows, each run once) in order of name, as one scalar list; without one the default runs."""
    if runs is None:
        return F.array(*[F.struct(F.lit(r).alias("run"), F.lit(p).cast("string").alias("prefix")) for r, p in RUN_PREFIXES])
    return runs.agg(F.array_sort(F.collect_set(F.struct("run", F.col("thinking_prefix").alias("prefix"))))).scalar()


def prefix_variants(prompts: DataFrame, prompt_col: str = "prompt", runs: DataFrame | None = None) -> DataFrame:
    """One row per (prompt, run) with the run's thinking prefix appended; ``runs`` is A6's run dimension."""
    runs = _run_list(runs)
    out = prompts.withColumn("__run", F.explode(runs))
    return out.select(
        "*", F.col("__run.run").alias("run"), F.concat(F.col(prompt_col), F.coalesce(F.col("__run.prefix"), F.lit(""))).alias("run_prompt")
    ).drop("__run")


def job_matrix(items: DataFrame, num_samples: int, runs: DataFrame | None = None) -> DataFrame:
    """Items x runs x sample slots as explodes; ``runs`` is A6's run dimension."""
    out = items.withColumn("__run", F.explode(_run_list(runs))).withColumn("run", F.col("__run.run")).drop("__run")
    return out.withColumn("sample_idx", F.explode(F.sequence(F.lit(1), F.lit(num_samples))))


def job_groups(jobs: DataFrame) -> DataFrame:
    """Run directories of an A5 job list grouped by (job dir, split), each once."""
    return jobs.groupBy("job_dir", "split").agg(F.array_sort(F.collect_set(F.concat_ws("/", "job_dir", "run_name"))).alias("run_dirs"))


def first_token_fanout(
    cands: DataFrame, topk: int, n: int, prompt: str = "prompt", token: str = "token", logprob: str = "logprob", seed: int | None = None
) -> DataFrame:
    """Top-``topk`` first tokens per prompt, repeated cyclically to exactly ``n`` slots.

    With a ``seed`` the slots of each prompt are permuted: they are ordered by the
    MD5 of seed, prompt and the slot before, inside the row.
    """
    w = Window.partitionBy(prompt).orderBy(F.col(logprob).desc(), F.col(token))
    top = cands.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= topk)
    lists = top.groupBy(prompt).agg(F.array_sort(F.collect_list(F.struct(F.col("__r"), F.col(token).alias("t")))).alias("__c"))
    toks = F.transform(F.col("__c"), lambda s: s["t"])
    filled = F.slice(F.flatten(F.array_repeat(toks, F.ceil(F.lit(n) / F.size(toks)).cast("int"))), 1, n)
    if seed is not None:
        drawn = F.transform(filled, lambda t, i: F.struct(F.md5(F.concat_ws("|", F.lit(seed), F.col(prompt), i)).alias("h"), i.alias("i"), t.alias("t")))
        filled = F.transform(F.array_sort(drawn), lambda s: s["t"])
    return lists.select(prompt, F.posexplode(filled).alias("slot", "first_token"))


def regroup_choices(flat: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Chunk flat outputs back per prompt: response = first token + text,
    completion tokens + 1, prompt tokens - 1."""
    rows = flat.select(
        prompt, "slot", F.concat(F.col("first_token").cast("string"), F.col("text")).alias("response"),
        (F.col("completion_tokens") + 1).alias("completion_tokens"), (F.col("prompt_tokens") - 1).alias("prompt_tokens"),
    )
    return rows.groupBy(prompt).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("slot", "response"))), lambda s: s["response"]).alias("choices"),
        F.transform(F.array_sort(F.collect_list(F.struct("slot", "completion_tokens"))), lambda s: s["completion_tokens"]).alias("completion_tokens"),
        F.min("prompt_tokens").alias("prompt_tokens"),
    )


def attach_generation_meta(prompts: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    """Key join prompt rows to their choices, one row per choice; a prompt
    without responses keeps one row with NULL response; token counts default 0."""
    joined = prompts.join(responses, key, "left")
    return joined.select(
        "*", F.posexplode_outer("choices").alias("sample_idx", "response")
    ).select(
        *[c for c in prompts.columns],
        "sample_idx",
        "response",
        F.coalesce(F.col("prompt_tokens"), F.lit(0)).alias("n_prompt_tokens"),
        F.coalesce(F.try_element_at("completion_tokens", F.col("sample_idx") + 1), F.lit(0)).alias("n_completion_tokens"),
    )


def flatten_conversations(msgs: DataFrame, conv: str = "conv_id") -> DataFrame:
    """``role: content`` lines in turn order, one text per conversation."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return msgs.groupBy(conv).agg(F.array_join(F.transform(ordered, lambda m: F.concat(m["role"], F.lit(": "), m["text"])), "\n").alias("prompt"))


def sft_messages(question: Column, response: Column) -> Column:
    """User question and assistant response (with a leading space)."""
    return F.array(
        F.struct(F.lit("user").alias("role"), question.alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.concat(F.lit(" "), response).alias("content")),
    )


def response_only_span(text: Column) -> tuple[Column, Column]:
    """(start, length) of the trained part after ``### Response:\\n`` (1-based start; 0 if absent)."""
    pos = F.instr(text, RESPONSE_MARK)
    start = F.when(pos > 0, pos + F.lit(len(RESPONSE_MARK))).otherwise(F.lit(0))
    length = F.when(pos > 0, F.length(text) - start + 1).otherwise(F.lit(0))
    return start, length
