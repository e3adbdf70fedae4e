"""A7-A10, A12 — writers (A11 is ``operators.chains.write_outputs``).  Every sink is a distributed Spark write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_item_arrays(items: DataFrame, path: str, most: int = 1_000) -> None:
    """Benchmark items (a numeric ``id``) as JSON arrays of at most ``most`` neighbouring ids, one array a file."""
    fields = F.struct(*items.columns)
    groups = items.groupBy(F.floor(F.col("id") / most).alias("__g")).agg(F.to_json(F.array_sort(F.collect_list(fields))).alias("value"))
    groups.select("value").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def write_run_config(config: DataFrame, job_dir: str, run: str) -> None:
    """One run's config, a row with the whole text in ``value``, in its run folder."""
    config.select("value").coalesce(1).write.mode("errorifexists").text(f"{job_dir.rstrip('/')}/{run}/sampler_config.yaml")


def write_prompts(df: DataFrame, path: str) -> None:
    """Prompts CSV (header, every field quoted: prompts span lines)."""
    (df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def write_generation_shard(df: DataFrame, sample_dir: str, split: str, seed: int, ts: str, worker: int) -> str:
    """One shard folder ``{split}.generations_seed{seed}.{ts}_{worker}.csv``;
    existing shards are never overwritten (a new name per worker and time)."""
    path = f"{sample_dir.rstrip('/')}/{split}.generations_seed{seed}.{ts}_{worker}.csv"
    (df.write.mode("errorifexists").option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def append_generations(df: DataFrame, path: str) -> None:
    """A8 (Parquet form): append-only table partitioned by run and split."""
    df.write.mode("append").partitionBy("run", "split").parquet(path)


def overwrite_processed(df: DataFrame, path: str) -> None:
    """Replace only the (run, split) partitions present in ``df``."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "split").parquet(path))


def write_metrics_json(pass_by_run: DataFrame, path: str, run_keys: tuple[str, ...] = ("run",)) -> None:
    """A10: per run one JSON record ``{pass_at_k: {"pass@k": v}}`` (keys in k order)."""
    entries = F.array_sort(F.collect_list(F.struct(F.col("k"), F.concat(F.lit("pass@"), F.col("k").cast("string")).alias("key"), F.col("pass_at_k").alias("value"))))
    metrics = pass_by_run.groupBy(*run_keys).agg(
        F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], e["value"]))).alias("pass_at_k")
    )
    metrics.write.mode("overwrite").json(path)


def write_episodes(episodes: DataFrame, path: str, every: int = 10) -> None:
    """``{query, response, reward}`` JSON for every ``every``-th iteration,
    one folder per phase (train/eval) and iteration."""
    episodes.where(F.col("iteration") % every == 0).write.mode("overwrite").partitionBy("phase", "iteration").json(path)
