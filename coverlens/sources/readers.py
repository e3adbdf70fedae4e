"""A1-A6 — readers with explicit schemas (no inference)."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM_SCHEMA = "id BIGINT, Question STRING, answer STRING, Solution STRING, subset STRING"
GENERATION_SCHEMA = (
    "question_id BIGINT, prompt_id BIGINT, response STRING, pred_answer STRING, gt_answer STRING, "
    "sampler_config STRING, prompt_tokens INT, completion_tokens INT, sample_id BIGINT"
)
#: Shards as sampling workers write them: no sample id, the order is that of the rows.
SHARD_SCHEMA = GENERATION_SCHEMA.rsplit(", ", 1)[0]
JOB_SCHEMA = "job_dir STRING, run_name STRING, split STRING, num_samples INT"
#: Fixed value: the sampler class of a config that names none.
DEFAULT_SAMPLER = "ChatCompletionSampler"
SHARD_NAME = r"([^/]+)\.generations_seed(\d+)\.(\d{8}_\d{6})_(\d+)\.csv"


def read_benchmark(spark: SparkSession, name: str, registry: dict[str, str], json_lines: bool = False) -> DataFrame:
    """A1: registry name -> item table; unknown names are an error.

    Benchmark files are JSON arrays (``multiLine``); JSON-lines files are
    read split-wise with ``json_lines=True``.
    """
    if name not in registry:
        raise ValueError(f"Unknown dataset: {name}")
    return spark.read.schema(ITEM_SCHEMA).option("multiLine", not json_lines).json(registry[name])


def read_generation_shards(spark: SparkSession, sample_dir: str, split: str) -> DataFrame:
    """A2/A3: every ``{split}.generations*.csv`` shard (multi-line quoted CSV) with
    its lineage (split, seed, timestamp, worker) parsed from the file name."""
    try:
        df = (
            spark.read.schema(GENERATION_SCHEMA)
            .option("header", True).option("multiLine", True).option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
            .csv(f"{sample_dir.rstrip('/')}/{split}.generations*.csv")
        )
    except AnalysisException as e:
        raise FileNotFoundError(f"No generation CSVs found in {sample_dir} for split '{split}'") from e
    path = F.col("_metadata.file_path")
    return df.select(
        "*",
        F.regexp_extract(path, SHARD_NAME, 1).alias("shard_split"),
        F.regexp_extract(path, SHARD_NAME, 2).try_cast("int").alias("shard_seed"),
        F.regexp_extract(path, SHARD_NAME, 3).alias("shard_ts"),
        F.regexp_extract(path, SHARD_NAME, 4).try_cast("int").alias("shard_worker"),
    )


#: What stands before a path in a URI.
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def _below(root: str) -> Column:
    """The path of a row's file below ``root``."""
    base = re.sub(SCHEME, "", root).rstrip("/")
    uri = F.regexp_replace(F.col("_metadata.file_path"), SCHEME, "")
    return F.substring(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), len(base) + 2, 1 << 20)


#: A shard of a run: job folder, run folder, split, seed, timestamp, worker; one file, or a folder of part files.
RUN_SHARD = r"^(?:(.*)/)?([^/]+)/([^/]+)\.generations_seed(\d+)\.(\d{8}_\d{6})_(\d+)\.csv(?:/[^/]+)?$"


def read_run_shards(spark: SparkSession, root: str) -> DataFrame:
    """A2/A3: all generation shards of all runs below ``root`` in one scan.

    Columns of the shards (without a sample id), and from each file's path
    ``job_dir`` (relative to ``root``), ``run``, ``split``, ``seed``, ``ts`` and
    ``worker``.  ``place`` = (shard, file, row) orders samples: shards by name, so by
    seed, time and worker, and rows as they stand in a file.  A multi-line file is
    read by one task from its start, so the order of ``row`` inside a file is that
    of its lines, whatever else the task reads.

    Paths are taken apart once a file, in the listing that a scan has anyway, and a
    row finds its file's parts by the path.
    """
    options = {"recursiveFileLookup": True, "pathGlobFilter": "{*.generations*.csv,part-*.csv}"}
    df = (
        spark.read.schema(SHARD_SCHEMA).options(**options)
        .option("header", True).option("multiLine", True).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(root)
    )
    df = df.select("*", F.col("_metadata.file_path").alias("__uri"), F.monotonically_increasing_id().alias("__row"))
    files = spark.read.format("binaryFile").options(**options).load(root)
    # from the listing's own column: a condition on the join's key would be made one on every row
    files = files.select(F.col("_metadata.file_path").alias("__uri"), F.substring(F.regexp_replace("path", SCHEME, ""), len(re.sub(SCHEME, "", root).rstrip("/")) + 2, 1 << 20).alias("__path"))
    part = lambda i: F.regexp_extract("__path", RUN_SHARD, i)
    shard = F.regexp_extract("__path", r"([^/]+\.csv)(?:/[^/]+)?$", 1)
    files = files.where(F.col("__path").rlike(RUN_SHARD)).select(
        "__uri", part(1).alias("job_dir"), part(2).alias("run"), part(3).alias("split"), part(4).cast("long").alias("seed"), part(5).alias("ts"), part(6).cast("int").alias("worker"),
        shard.alias("__shard"), F.col("__path").alias("__file"),
    )
    return df.join(F.broadcast(files), "__uri").select(
        "job_dir", "run", "split", "seed", "ts", "worker", F.struct(F.col("__shard").alias("shard"), F.col("__file").alias("file"), F.col("__row").alias("row")).alias("place"),
        *(c for c in df.columns if not c.startswith("__")),
    )


def read_examples(spark: SparkSession, path: str, n: int | None = None, index: str = "index") -> DataFrame:
    """A4: Parquet examples; the first ``n`` by index when given (a top-n read)."""
    df = spark.read.parquet(path)
    return df.orderBy(index).limit(n) if n is not None else df


def read_job_list(spark: SparkSession, path: str) -> DataFrame:
    """A5: ``job_dir|run_name|split|num_samples`` lines; missing fields become NULL."""
    return spark.read.schema(JOB_SCHEMA).option("sep", "|").option("mode", "PERMISSIVE").csv(path)


#: A run's config: job folder, run folder; one file, or a folder of one part file.
RUN_CONFIG = r"^(?:(.*)/)?([^/]+)/sampler_config\.yaml(?:/[^/]+)?$"
#: The settings that the run dimension names; others stay in ``params``.
CONFIG_COLUMNS = {"temperature": "double", "top_p": "double", "top_k": "int", "max_tokens": "int", "max_model_len": "int", "first_topk": "int", "trust_remote_code": "boolean"}


def _yaml_section(name: str) -> Column:
    """The ``key: value`` lines indented below ``name:`` as a map of unquoted strings; empty, ``~`` and ``null`` values are NULL.

    A quoted value ends at its closing quote, a plain one before `` #``; double quotes
    know ``\\n`` and ``\\t``.
    """
    body = F.regexp_extract("value", rf"(?m)^{name}:[ \t]*\r?\n((?:[ \t]+[^\n]*(?:\n|\z)|[ \t]*\r?\n)*)", 1)
    line = r"^[ \t]+([A-Za-z_][A-Za-z0-9_-]*):[ \t]*(.*?)[ \t]*$"

    def scalar(v: Column) -> Column:
        double = F.regexp_extract(v, r'^"((?:[^"\\]|\\.)*)"', 1)
        for mark, char in [("\\n", "\n"), ("\\t", "\t"), ('\\"', '"')]:
            double = F.replace(double, F.lit(mark), F.lit(char))
        plain = F.trim(F.regexp_replace(v, r"(^|[ \t])#.*$", ""))
        return F.when(v.startswith('"'), double).when(v.startswith("'"), F.regexp_extract(v, "^'([^']*)'", 1)).otherwise(
            F.when(~plain.isin("", "~", "null"), plain))

    keyed = F.transform(F.split(body, r"\r?\n"), lambda x: F.struct(F.regexp_extract(x, line, 1).alias("key"), scalar(F.regexp_extract(x, line, 2)).alias("value")))
    return F.map_from_entries(F.filter(keyed, lambda e: e["key"] != ""))


def read_run_configs(spark: SparkSession, root: str) -> DataFrame:
    """Every ``sampler_config.yaml`` below ``root``, read whole and parsed by Spark, as the run dimension.

    Configs have the sections ``sampler`` and ``tokenizer`` with one setting a line.
    ``stop`` is a string or a list in brackets.  Settings without a column of their
    own are in ``params``.
    """
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "{sampler_config.yaml,part-*}").text(root, wholetext=True)
    df = df.select("value", _below(root).alias("path")).where(F.col("path").rlike(RUN_CONFIG))
    df = df.select(F.regexp_extract("path", RUN_CONFIG, 1).alias("job_dir"), F.regexp_extract("path", RUN_CONFIG, 2).alias("run"), _yaml_section("sampler").alias("s"), _yaml_section("tokenizer").alias("t"))
    s = F.col("s")
    unquoted = F.transform(F.split(F.regexp_replace(s["stop"], r"^\[[ ]*|[ ]*\]$", ""), r"[ ]*,[ ]*"), lambda x: F.regexp_replace(x, "^['\"]|['\"]$", ""))
    stop = F.when(s["stop"].rlike(r"^\[.*\]$"), unquoted).when(s["stop"].isNotNull(), F.array(s["stop"]))
    named = ["class", "model_name", "thinking_prefix", "stop", *CONFIG_COLUMNS]
    return df.select(
        "job_dir", "run", F.coalesce(s["class"], F.lit(DEFAULT_SAMPLER)).alias("sampler_class"), s["model_name"].alias("model"), s["thinking_prefix"].alias("thinking_prefix"),
        stop.alias("stop"), *(s[c].cast(kind).alias(c) for c, kind in CONFIG_COLUMNS.items()), F.col("t")["path"].alias("tokenizer_path"),
        F.map_filter(s, lambda k, _: ~k.isin(named)).alias("params"),
    )


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """Prompts CSV written by ``write_prompts`` (quoted, multi-line, whitespace kept)."""
    schema = "question_id BIGINT, prompt_id BIGINT, question STRING, answer STRING, prompt STRING"
    return (
        spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )
