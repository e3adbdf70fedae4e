"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coverlens.session import scratch_dir

#: ASCII blanks that part words.
BLANK = r"[\x20\x09-\x0D]+"
#: Ids that may be broadcast (8 MB); more are shuffled.
MOST_BROADCAST = 1_000_000


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns ``names``, found by exact name first.

    A table may carry further columns, also some whose names differ from these
    in case alone; renaming by position keeps the choice unambiguous.
    """
    found = []
    for name in names:
        at = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
        if not at:
            raise ValueError(f"no column {name!r} in {df.columns}")
        found.append(at[0])
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.select(*(F.col(f"c{i}").alias(name) for i, name in zip(found, names)))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, and survives lost executors."""
    path = scratch_dir(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_semi_join(df: DataFrame, ids: DataFrame, key: str, anti: bool = False) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``ids`` (or is not): the ids are counted, and broadcast only if they are at most MOST_BROADCAST longs."""
    small = F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids
    return df.join(small, key, "left_anti" if anti else "left_semi")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and where each row begins (one entry more than rows); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, at - at[0] if len(at) else np.zeros(1, np.int64)


def by_size(batches: Iterator[pa.RecordBatch], column: str, most: int, most_rows: int = 1 << 30) -> Iterator[pa.Table]:
    """Rows of the incoming batches in order, regrouped so that a group's ``column`` holds about ``most`` bytes, in ``most_rows`` rows at most.

    A group ends once it reaches that size; a longer text is a group by itself.
    The grouping bounds memory only: callers get every row.
    """
    held: list[pa.RecordBatch] = []
    size = rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(np.diff(buffers(text)[1]))
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + most - size, side="right")))
            stop = min(stop, batch.num_rows, start + most_rows - rows)
            held.append(batch.slice(start, stop - start))
            size += int(ends[stop - 1] - done)
            rows += stop - start
            start = stop
            if size >= most or rows >= most_rows or start < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size, rows = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)
