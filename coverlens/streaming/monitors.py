"""I1, I2 — Structured Streaming jobs over generation shards and rollout logs.

Shards land as files; the stream reads them with an explicit schema, does the
stateless text work per row and keeps only aggregation state.  Outputs go to
Parquet folders through Spark sinks (a folder for each epoch of updated counts, the
file sink for append-mode windows); nothing is collected to the driver.  Folders live under the shared checkpoint folder
named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coverlens.operators.extract import extract_raw_answers, finish_answers
from coverlens.operators.grade import grade_answers
from coverlens.operators.normalize import normalize_answers
from coverlens.session import ensure_checkpoint_dir

GEN_SCHEMA = (
    "question_id BIGINT, prompt_id BIGINT, sample_id BIGINT, run STRING, split STRING, gt_answer STRING, response STRING, shard INT"
)
ROLLOUT_SCHEMA = "event_id BIGINT, ts TIMESTAMP, reward DOUBLE, finish_reason STRING, resp_len INT, shard INT"


def workdir(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def stage_shards(df: DataFrame, path: str, shard_col: str = "shard") -> str:
    """Add a table's rows as one folder per shard (how sampling workers deliver files)."""
    df.write.mode("append").partitionBy(shard_col).parquet(path)
    return path


COUNT_KEYS = ("run", "split", "question_id", "prompt_id")
COUNT_SCHEMA = "run STRING, split STRING, question_id BIGINT, prompt_id BIGINT, n BIGINT, c BIGINT, epoch BIGINT"


def write_epoch(batch: DataFrame, epoch: int, out: str) -> None:
    """Updated counts of one epoch as a folder of its own.

    A replayed epoch replaces its folder with the same rows, so it is applied once;
    folders of other epochs, which a reader may be reading, are never touched.
    """
    batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")


def latest_counts(spark: SparkSession, out: str) -> DataFrame:
    """The counts now: of each question those of its last epoch (partial aggregation, no sort)."""
    log = spark.read.schema(COUNT_SCHEMA).parquet(out)
    return log.groupBy(*COUNT_KEYS).agg(F.max_by(F.struct("n", "c"), "epoch").alias("v")).select(*COUNT_KEYS, "v.n", "v.c")


def stream_pass_counts(
    spark: SparkSession, source: str, out: str, checkpoint: str, data_name: str = "math", files_per_trigger: int | None = None
) -> DataFrame:
    """Running per-question ``(n, c)`` as generation shards arrive, each sample once.

    Extraction is stateless and drops the response; a sample (run, split, question,
    prompt, sample id) that came before, in this batch or any earlier one, is
    dropped by a stateful deduplication of its key; only new samples are normalised
    and graded.  State is one key per sample and one count per question.  Update mode
    writes the counts that changed, an epoch at a time.  No cutoff: a later shard may
    hold earlier sample ids.  ``pass_at_k`` of the result is the running estimate.
    """
    reader = spark.readStream.schema(GEN_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    keys = list(COUNT_KEYS)
    x = extract_raw_answers(reader.parquet(source), data_name).select(*keys, "sample_id", "mode", "cleaned", "gt_answer")
    x = finish_answers(x.dropDuplicates([*keys, "sample_id"]), data_name)
    x = grade_answers(normalize_answers(x, "gt_answer", "gt_norm"), "pred_answer", "gt_norm")
    counts = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_correct").alias("c"))
    q = counts.writeStream.outputMode("update").foreachBatch(lambda batch, epoch: write_epoch(batch, epoch, out)).option("checkpointLocation", checkpoint)
    q.trigger(availableNow=True).start().awaitTermination()
    return latest_counts(spark, out)


def stream_reward_monitor(spark: SparkSession, source: str, out: str, checkpoint: str, delay: str = "1 day") -> DataFrame:
    """Daily reward / non-stop rate with a watermark; only closed windows are emitted."""
    ev = spark.readStream.schema(ROLLOUT_SCHEMA).parquet(source)
    agg = (
        ev.withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 day").alias("w"))
        .agg(
            F.count(F.lit(1)).alias("n_episodes"),
            F.round(F.avg("reward"), 9).alias("rewards"),
            F.round(F.avg((F.col("finish_reason") != "stop").cast("double")), 9).alias("non_stop_rate"),
        )
        .select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n_episodes", "rewards", "non_stop_rate")
    )
    q = agg.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    q.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("window_start STRING, n_episodes BIGINT, rewards DOUBLE, non_stop_rate DOUBLE").parquet(out)


WINDOW_SCHEMA = "window_start STRING, window_end STRING, n_episodes BIGINT, rewards DOUBLE, non_stop_rate DOUBLE"


def stream_reward_sliding(spark: SparkSession, source: str, out: str, checkpoint: str, width: str = "2 days", slide: str = "1 day", delay: str = "1 day") -> DataFrame:
    """I2 over sliding windows: an episode counts in each window that holds its time.

    A window is closed, and emitted once, when the watermark (latest time seen less
    ``delay``) reaches its end.  An episode that comes later counts in its windows that
    are still open and in no other.  Called again with the same checkpoint, it goes
    on with what has arrived since.
    """
    ev = spark.readStream.schema(ROLLOUT_SCHEMA).parquet(source)
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    agg = (
        ev.withWatermark("ts", delay)
        .groupBy(F.window("ts", width, slide).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("n_episodes"),
            F.round(F.avg("reward"), 9).alias("rewards"),
            F.round(F.avg((F.col("finish_reason") != "stop").cast("double")), 9).alias("non_stop_rate"),
        )
        .select(text("w.start").alias("window_start"), text("w.end").alias("window_end"), "n_episodes", "rewards", "non_stop_rate")
    )
    q = agg.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    q.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(WINDOW_SCHEMA).parquet(out)
