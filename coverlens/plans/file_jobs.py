"""T1 from files: job list -> generation shards -> processed rows -> metrics JSON, for all runs at once.

One scan reads the shards of every run in the job list.  Processing is a narrow
projection that is written by run (a rerun replaces only its own runs); metrics are
computed from the written rows.  A metrics document is a text that Spark sorts
together from short lines, so neither a vector over all questions nor a whole
document is ever one row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from coverlens.operators.estimators import DEFAULT_CUTOFF, K_CAP, correct_counts, first_n_cutoff, metric_vectors
from coverlens.plans.evaluation import QUESTION_KEYS, process_generations
from coverlens.session import scratch_dir
from coverlens.sources.readers import read_job_list, read_run_shards

RUN = ("job_dir", "run", "split")
#: Values of a detail vector on one line of the document.
LINE_VALUES = 1_000
METRICS_SCHEMA = (
    "overall STRUCT<detail_pass_at_k: MAP<STRING, ARRAY<DOUBLE>>, pass_at_k: MAP<STRING, DOUBLE>, mean_response_len: DOUBLE>, "
    "job_dir STRING, run STRING, split STRING"
)


def process_jobs(spark: SparkSession, root: str, job_list: str, out: str, data_name: str = "math") -> DataFrame:
    """Processed rows of the runs in ``job_list``, written below ``out`` by job folder, run and split.

    A job without a shard writes nothing, and its earlier results stay as they are.
    """
    jobs = read_job_list(spark, job_list).select("job_dir", F.col("run_name").alias("run"), "split").distinct()
    gens = read_run_shards(spark, root).join(jobs, list(RUN), "left_semi")
    rows = process_generations(gens.drop("pred_answer"), data_name, keep_response=True)
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*RUN).parquet(out))
    return read_processed(spark, out, rows.schema)


def job_status(spark: SparkSession, job_list: str, processed: DataFrame) -> DataFrame:
    """Every job of the list once, with its number of processed rows; 0 where no shard was found."""
    jobs = read_job_list(spark, job_list).select("job_dir", F.col("run_name").alias("run"), "split").distinct()
    counts = processed.groupBy(*RUN).agg(F.count(F.lit(1)).alias("n"))
    return jobs.join(counts, list(RUN), "left").select(*RUN, F.coalesce("n", F.lit(0).cast("long")).alias("n_rows"))


def read_processed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Processed rows; the schema keeps the folders' names strings."""
    return spark.read.schema(schema).parquet(path)


def question_vectors(processed: DataFrame, cutoff: int = DEFAULT_CUTOFF, k_cap: int = K_CAP) -> DataFrame:
    """G15 of every run: (run keys, k, pos, value), ``pos`` from 0 in question order."""
    keys = [*RUN, *QUESTION_KEYS]
    counts = correct_counts(first_n_cutoff(processed.select(*keys, "place", "is_correct"), keys, "place", cutoff), keys)
    return metric_vectors(counts, RUN, QUESTION_KEYS, k_cap)


def metrics_lines(vectors: DataFrame, lengths: DataFrame) -> DataFrame:
    """The documents ``{"overall": {detail_pass_at_k, pass_at_k, mean_response_len}}`` as lines: (run keys, section, k, chunk, value).

    ``vectors`` is ``question_vectors``; ``lengths`` has run keys and mean_response_len.
    """
    at = lambda section, k, chunk, text: F.struct(F.lit(section).alias("section"), k.cast("int").alias("k"), chunk.cast("long").alias("chunk"), text.alias("value"))
    zero, number = F.lit(0), lambda x: F.to_json(F.array(x)).substr(F.lit(2), F.length(F.to_json(F.array(x))) - 2)
    name = F.concat(F.lit('"pass@'), F.col("k").cast("string"), F.lit('": '))
    chunk = F.floor(F.col("pos") / LINE_VALUES)
    rows = vectors.groupBy(*RUN, "k", chunk.alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("v"))
    text = F.to_json(F.transform("v", lambda x: x["value"]))
    head = F.when(F.col("chunk") > 0, F.lit(", ")).otherwise(F.concat(F.when(F.col("k") > 1, F.lit("], ")).otherwise(F.lit("")), name, F.lit("[")))
    detail = rows.select(*RUN, at(1, F.col("k"), F.col("chunk"), F.concat(head, text.substr(F.lit(2), F.length(text) - 2))).alias("l"))
    mean = vectors.groupBy(*RUN, "k").agg(F.avg("value").alias("mean"))
    means = mean.select(*RUN, at(3, F.col("k"), zero, F.concat(F.when(F.col("k") > 1, F.lit(", ")).otherwise(F.lit("")), name, number(F.col("mean")))).alias("l"))
    frame = lengths.select(*RUN, F.explode(F.array(
        at(0, zero, zero, F.lit('{"overall": {"detail_pass_at_k": {')), at(2, zero, zero, F.lit(']}, "pass_at_k": {')),
        at(4, zero, zero, F.concat(F.lit('}, "mean_response_len": '), number(F.col("mean_response_len")), F.lit("}}"))))).alias("l"))
    return detail.unionByName(means).unionByName(frame).select(*RUN, "l.*")


def write_metrics(processed: DataFrame, out: str, timestamp: str, cutoff: int = DEFAULT_CUTOFF) -> str:
    """A10: one JSON document a run in ``{out}/metrics.{timestamp}``, by job folder, run and split; earlier ones stay."""
    spark = processed.sparkSession
    vectors = question_vectors(processed, cutoff)
    kept = scratch_dir(spark, f"vectors-{uuid.uuid4().hex}")
    vectors.write.parquet(kept)
    lengths = processed.groupBy(*RUN).agg(F.avg("response_len").alias("mean_response_len"))
    lines = metrics_lines(spark.read.schema(vectors.schema).parquet(kept), lengths)
    path = f"{out.rstrip('/')}/metrics.{timestamp}"
    (lines.repartition(*RUN).sortWithinPartitions(*RUN, "section", "k", "chunk").select(*RUN, "value")
     .write.mode("errorifexists").partitionBy(*RUN).text(path))
    return path


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metrics documents as rows (run keys, metric, pos, value); ``pos`` is null for the means and the response length."""
    m = spark.read.schema(METRICS_SCHEMA).option("multiLine", True).json(path)
    entry = lambda metric, pos, value: F.struct(metric.alias("metric"), pos.cast("long").alias("pos"), value.alias("value"))
    detail = m.select(*RUN, F.explode("overall.detail_pass_at_k").alias("metric", "v")).select(*RUN, "metric", F.posexplode("v").alias("pos", "value"))
    means = F.transform(F.map_entries("overall.pass_at_k"), lambda e: entry(F.concat(F.lit("mean_"), e["key"]), F.lit(None), e["value"]))
    length = F.array(entry(F.lit("mean_response_len"), F.lit(None), F.col("overall.mean_response_len")))
    rest = m.select(*RUN, F.explode(F.concat(means, length)).alias("e")).select(*RUN, "e.*")
    return detail.select(*RUN, "metric", F.col("pos").cast("long").alias("pos"), "value").unionByName(rest)
