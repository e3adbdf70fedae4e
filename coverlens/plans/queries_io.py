"""Registered queries: sources and sinks as write-then-read round trips.

Data is derived from the test tables, written with the library sinks into a
fresh folder under the shared checkpoint folder, and read back with the
library readers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from coverlens.operators import chains as CH
from coverlens.operators.estimators import correct_counts, pass_at_k
from coverlens.plans import fixtures
from coverlens.plans import queries_generate as chain
from coverlens.plans.oracle import duck
from coverlens.plans.queries_prompts import ITEMS, _PROMPTS, items, prompts
from coverlens.plans.registry import register
from coverlens.session import ensure_checkpoint_dir
from coverlens.sources import readers as R
from coverlens.sources import sinks as S
from coverlens.sources.tables import table


def _dir(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/io/{name}-{uuid.uuid4().hex}"


@register("src_benchmark_json", oracle=lambda: f"SELECT id, Question, answer, CAST(NULL AS VARCHAR) AS Solution, subset FROM ({ITEMS})")
def q_src_benchmark_json(spark, sf):
    """A1: benchmark items as files that hold one JSON array each, read back by registry name with a fixed schema."""
    d = _dir(spark, "benchmark")
    S.write_item_arrays(items(spark, sf), d)
    return R.read_benchmark(spark, "items", {"items": d})


def _gen_rows(spark, sf):
    g = fixtures.generations(spark, sf)
    return g.select(
        "question_id", "prompt_id", "response", F.lit(None).cast("string").alias("pred_answer"), "gt_answer",
        F.lit('{"temperature": 0.6}').alias("sampler_config"), F.lit(21).alias("prompt_tokens"),
        F.length("response").cast("int").alias("completion_tokens"),
        "sample_id",
    )


@register("src_generation_shards", oracle=lambda: f"""
SELECT question_id, prompt_id, response, CAST(NULL AS VARCHAR) AS pred_answer, gt_answer, '{{"temperature": 0.6}}' AS sampler_config,
       21 AS prompt_tokens, CAST(length(response) AS INTEGER) AS completion_tokens, sample_id,
       'all' AS shard_split, CAST(sample_id % 4 AS INTEGER) AS shard_seed, '20260101_000000' AS shard_ts, CAST(sample_id % 4 AS INTEGER) AS shard_worker
FROM ({duck.GENERATIONS})""")
def q_src_generation_shards(spark, sf):
    """Generation shards written as multi-line CSV folders and globbed back with lineage."""
    d = _dir(spark, "shards")
    g = _gen_rows(spark, sf)
    for w in range(4):  # four sampling workers, one shard each
        S.write_generation_shard(g.where(F.col("sample_id") % 4 == w), d, "all", w, "20260101_000000", w)
    return R.read_generation_shards(spark, d, "all")


@register("src_shard_lineage", oracle=lambda: f"""
SELECT 'all' AS shard_split, CAST(sample_id % 4 AS INTEGER) AS shard_seed, '20260101_000000' AS shard_ts,
       CAST(sample_id % 4 AS INTEGER) AS shard_worker, count(*) AS n_rows FROM ({duck.GENERATIONS}) GROUP BY ALL""")
def q_src_shard_lineage(spark, sf):
    """A3: rows per shard by the split, seed, timestamp and worker in the file name."""
    d = _dir(spark, "lineage")
    g = _gen_rows(spark, sf)
    for w in range(4):
        S.write_generation_shard(g.where(F.col("sample_id") % 4 == w), d, "all", w, "20260101_000000", w)
    r = R.read_generation_shards(spark, d, "all")
    return r.groupBy("shard_split", "shard_seed", "shard_ts", "shard_worker").agg(F.count(F.lit(1)).alias("n_rows"))


@register("src_examples_parquet", oracle="SELECT doc_id AS index, text AS question, lang FROM documents ORDER BY doc_id LIMIT 100")
def q_src_examples_parquet(spark, sf):
    """A4: Parquet examples, the first 100 by index."""
    d = _dir(spark, "examples")
    table(spark, sf, "documents").select(F.col("doc_id").alias("index"), F.col("text").alias("question"), "lang").write.parquet(d)
    return R.read_examples(spark, d, 100)


_RUN_NAMES = "(VALUES ('default'), ('prefix_Okay'), ('prefix_Let'), ('prefix_Alright'), ('prefix_To')) r(run)"


@register("src_job_list", oracle=lambda: f"""
SELECT 'jobs/' || subset AS job_dir, run AS run_name, 'test' AS split, CASE WHEN run = 'default' THEN NULL ELSE 8 END AS num_samples
FROM (SELECT DISTINCT subset FROM ({ITEMS})), {_RUN_NAMES}""")
def q_src_job_list(spark, sf):
    """A5: pipe-separated job lines (a missing sample count is tolerated)."""
    d = _dir(spark, "jobs")
    from coverlens.operators.prompts import job_matrix

    jobs = job_matrix(items(spark, sf).select("subset").distinct(), 1).select(
        F.concat(F.lit("jobs/"), "subset").alias("job_dir"), F.col("run").alias("run_name"), F.lit("test").alias("split"),
        F.when(F.col("run") == "default", F.lit(None)).otherwise(F.lit("8")).alias("num_samples"),
    )
    jobs.select(F.concat_ws("|", "job_dir", "run_name", "split", "num_samples").alias("line")).write.text(d)
    return R.read_job_list(spark, d)


@register("snk_prompts", oracle=lambda: _PROMPTS)
def q_snk_prompts(spark, sf):
    """Prompts written as fully quoted CSV (multi-line fields) and read back."""
    d = _dir(spark, "prompts")
    S.write_prompts(prompts(spark, sf), d)
    return R.read_prompts(spark, d)


@register("snk_generations", oracle=lambda: f"SELECT question_id, sample_id, run, split, gt_answer FROM ({duck.GENERATIONS})")
def q_snk_generations(spark, sf):
    """Two appends into a run/split-partitioned table; earlier rows stay."""
    d = _dir(spark, "generations")
    g = fixtures.generations(spark, sf).select("question_id", "sample_id", "run", "split", "gt_answer")
    S.append_generations(g.where(F.col("sample_id") % 2 == 0), d)
    S.append_generations(g.where(F.col("sample_id") % 2 == 1), d)
    return spark.read.parquet(d).select("question_id", "sample_id", "run", "split", "gt_answer")


@register("snk_processed", oracle=lambda: f"""
SELECT question_id, sample_id, run, split, CASE WHEN run = 'view' THEN NOT is_correct ELSE is_correct END AS is_correct FROM ({duck.OUTCOMES})""")
def q_snk_processed(spark, sf):
    """Dynamic partition overwrite replaces only the rewritten run."""
    d = _dir(spark, "processed")
    o = fixtures.outcomes(spark, sf).select("question_id", "sample_id", "run", "split", "is_correct")
    S.overwrite_processed(o, d)
    S.overwrite_processed(o.where(F.col("run") == "view").withColumn("is_correct", ~F.col("is_correct")), d)
    return spark.read.parquet(d).select("question_id", "sample_id", "run", "split", "is_correct")


@register("snk_metrics_json", oracle=lambda: f"""
WITH c AS (SELECT run, question_id, prompt_id, count(*) AS n, CAST(count_if(is_correct) AS BIGINT) AS c FROM ({duck.OUTCOMES}) GROUP BY ALL),
m AS (SELECT run, least(2000, min(n)) AS mx FROM c GROUP BY run),
k AS (SELECT run, unnest(range(1, mx + 1)) AS k FROM m)
SELECT run, 'pass@' || CAST(k AS VARCHAR) AS metric, round(avg(CASE WHEN n - c < k THEN 1.0 WHEN c = 0 THEN 0.0 ELSE 1.0 - list_reduce(list_transform(
  range(CAST(n - c + 1 AS BIGINT), CAST(n + 1 AS BIGINT)), lambda i: 1.0 - k / i), lambda a, b: a * b) END), 9) AS value
FROM c JOIN k USING (run) GROUP BY run, k""")
def q_snk_metrics_json(spark, sf):
    """A10: per-run metrics JSON ({"pass@k": value}) written and read back, flattened."""
    d = _dir(spark, "metrics")
    o = fixtures.outcomes(spark, sf)
    p = pass_at_k(correct_counts(o, ["run", "question_id", "prompt_id"]), ["run"])
    S.write_metrics_json(p, d)
    back = spark.read.schema("run STRING, pass_at_k MAP<STRING, DOUBLE>").json(d)
    return back.select("run", F.explode("pass_at_k").alias("metric", "value"))


@register("snk_dataset_splits", oracle=lambda: f"""
{chain._DUCK_RECORDS}
SELECT output, extra_info.index AS index, question, solution, answer, extra_info.direction AS direction FROM records
UNION ALL SELECT 'test_items', extra_info.index, question, NULL, answer, extra_info.data_source FROM records WHERE output = 'test'""")
def q_snk_dataset_splits(spark, sf):
    """The four outputs as Parquet and the test items as JSON, all read back."""
    d = _dir(spark, "splits")
    rows = CH.records(chain._placed(spark, sf), chain.WORLD)
    CH.write_outputs(rows, d)
    back = spark.read.schema(rows.schema).parquet(f"{d}/records")
    back = back.select("output", "extra_info.index", "question", "solution", "answer", "extra_info.direction")
    items = spark.read.schema("id BIGINT, Question STRING, answer BIGINT, subset STRING").json(f"{d}/test_items")
    return back.unionByName(items.select(
        F.lit("test_items").alias("output"), F.col("id").alias("index"), F.col("Question").alias("question"), F.lit(None).cast("string").alias("solution"),
        "answer", F.col("subset").alias("direction")))


@register("snk_episodes", oracle=lambda: f"""
SELECT CASE WHEN event_id % 5 = 0 THEN 'eval' ELSE 'train' END AS phase, iteration, 'q' || CAST(question_id AS VARCHAR) AS query, 'r' || CAST(event_id AS VARCHAR) AS response, reward
FROM ({duck.ROLLOUTS}) WHERE iteration % 10 = 0""")
def q_snk_episodes(spark, sf):
    """Every 10th iteration's training and evaluation episodes as JSON under phase/iteration folders."""
    d = _dir(spark, "episodes")
    r = fixtures.episodes(spark, sf).select(
        F.when(F.col("event_id") % 5 == 0, "eval").otherwise("train").alias("phase"), "iteration", F.concat(F.lit("q"), F.col("question_id").cast("string")).alias("query"),
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("response"), "reward",
    )
    S.write_episodes(r, d)
    back = spark.read.schema("query STRING, response STRING, reward DOUBLE, phase STRING, iteration INT").json(d)
    return back.select("phase", "iteration", "query", "response", "reward")


@register("src_run_config", oracle=lambda: f"""
SELECT 'jobs/aime' AS job_dir, 'run_' || event_type AS run, CASE WHEN event_type < 'm' THEN 'VLLMSampler' ELSE 'ChatCompletionSampler' END AS sampler_class, 'model-' || event_type AS model,
  CASE WHEN event_type = 'view' THEN NULL ELSE upper(substr(event_type, 1, 1)) || substr(event_type, 2) END AS thinking_prefix,
  CASE WHEN event_type < 'm' THEN NULL ELSE ['a b', 'c'] END AS stop, 0.6::DOUBLE AS temperature, 0.95::DOUBLE AS top_p, -1 AS top_k,
  CAST(max(length(props)) AS INTEGER) AS max_tokens, 32768 AS max_model_len, CASE WHEN event_type < 'm' THEN 8 END AS first_topk, true AS trust_remote_code,
  CASE WHEN event_type < 'm' THEN NULL ELSE 'tok/' || event_type END AS tokenizer_path, 'x=' || event_type AS note
FROM events GROUP BY event_type""")
def q_src_run_config(spark, sf):
    """Per-run sampler configs as whole YAML files in run folders, read into the run dimension."""
    d = _dir(spark, "run-configs")
    ev = table(spark, sf, "events").groupBy("event_type").agg(F.max(F.length("props")).alias("mx"))
    first = F.col("event_type") < "m"
    lines = F.concat_ws(
        "\n", F.lit("sampler:"), F.when(first, F.lit("  class: VLLMSampler")), F.concat(F.lit("  model_name: model-"), "event_type"),
        F.lit("  temperature: 0.6\n  top_p: 0.95  # nucleus\n  top_k: -1"), F.concat(F.lit("  max_tokens: "), F.col("mx").cast("string")),
        F.lit("  max_model_len: 32768\n  trust_remote_code: true"), F.when(first, F.lit("  first_topk: 8")).otherwise(F.lit("  stop: ['a b', \"c\"]")),
        F.when(F.col("event_type") != "view", F.concat(F.lit("  thinking_prefix: "), F.initcap("event_type"))),
        F.concat(F.lit('  note: "x='), "event_type", F.lit('"')), F.when(~first, F.concat(F.lit("tokenizer:\n  path: tok/"), "event_type")))
    rows = ev.select("event_type", lines.alias("value"))
    for r in rows.select("event_type").collect():
        S.write_run_config(rows.where(F.col("event_type") == r.event_type), f"{d}/jobs/aime", f"run_{r.event_type}")
    return R.read_run_configs(spark, d).withColumn("note", F.col("params")["note"]).drop("params")
