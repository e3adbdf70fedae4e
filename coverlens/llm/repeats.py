"""What the two detectors of repeated passages share: copies, anchors, the filter of repeated keys, removal.

Both look for windows of ``width`` symbols that also start in a document of a
smaller id.  Of each window one short run of symbols, its *anchor*, is chosen
by the smallest hash, leftmost first; equal windows choose equal anchors, and
consecutive windows mostly share theirs, so there is about one anchor for every
twenty symbols.  A window can only repeat if its anchor's key does.

Repeated keys are found by one exchange of keys alone: each task sends, for
every bucket of the key space, the sorted keys of a block of texts as one row (a
key that several documents of the block hold twice, others once), and a bucket
keeps those that occur again.  The bits of the repeated keys make a filter of
``MOST_BITS`` bits at most, whatever the input, which goes to every executor.  A
false hit in it costs work, never a result; beyond that size more hits are
false.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverlens.llm.common import MOST_BROADCAST, by_size, pick, written

_U = np.uint64
KEY_BITS = 48
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 30
#: Bytes of text hashed at a time, and in a block of keys; documents in a block.
PIECE, BLOCK, BLOCK_ROWS = 2 << 20, 32 << 20, 60_000


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and text_key: rows of one id and one text have one pair (doc_id, text_key)."""
    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return d.withColumn("text_key", F.xxhash64("text"))


def copies(docs: DataFrame, least_bytes: int) -> DataFrame:
    """(doc_id, text_key) of the rows whose whole text is that of a smaller doc_id.

    Their windows all occur there, and what occurs in them occurs there too, so
    they need no further part in the search.
    """
    d = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= least_bytes)).select("doc_id", "text_key", F.unhex(F.md5("text")).alias("whole"))
    first = d.groupBy("whole").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last")
    found = d.join(first.select("whole", "first"), "whole").where("doc_id > first").select("doc_id", "text_key").distinct()
    return written(found, "copies")


def without(docs: DataFrame, found: DataFrame, least_bytes: int) -> DataFrame:
    """The rows to search: those with an id, at least ``least_bytes`` bytes, and not among the copies found."""
    small = F.broadcast(found) if found.count() * 2 <= MOST_BROADCAST else found
    return docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= least_bytes)).join(small, ["doc_id", "text_key"], "left_anti")


def smallest(keys: np.ndarray, width: int) -> np.ndarray:
    """Where the smallest of each run of ``width`` neighbours stands, leftmost first (33 bits of a key decide)."""
    n = len(keys) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = _U((1 << 31) - 1)
    m = (keys & ~low) | np.arange(len(keys), dtype=_U)
    step = 1
    while 2 * step <= width:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    return (np.minimum(m[:n], m[width - step : width - step + n]) & low).astype(np.int64)


def pack(keys: np.ndarray) -> bytes:
    """Ascending 48-bit keys as byte planes of their differences."""
    return np.diff(keys, prepend=_U(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8].T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(KEY_BITS // 8, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : KEY_BITS // 8] = planes.T
    return np.cumsum(out.view("<u8").ravel(), dtype=_U)


class Filter:
    """One bit for each range of keys; set where a repeated key lies."""

    def __init__(self, bits: int, data: bytes):
        self.shift, self.data = _U(KEY_BITS - bits.bit_length() + 1), np.frombuffer(data, np.uint8)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = (keys >> _U(64 - KEY_BITS)) >> self.shift
        return (self.data[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8)) & 1 == 1


def repeated_keys(docs: DataFrame, keys_of: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]):
    """A broadcast Filter of the keys that at least two rows of ``docs`` hold.

    ``keys_of`` gives the 64-bit keys of a table of texts and the row of each.
    """
    spark = docs.sparkSession
    buckets = 1 << max(4, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    types = pa.schema([("bucket", pa.int32()), ("keys", pa.binary())])

    def block(parts: list[np.ndarray]) -> pa.RecordBatch:
        found = np.concatenate(parts)  # key and row in one number: equal keys of one row are one
        found.sort()
        found = found[np.concatenate([[True], found[1:] != found[:-1]])] >> _U(64 - KEY_BITS)
        same = np.concatenate([[False], found[1:] == found[:-1]])
        found = found[~(same & np.concatenate([[False], same[:-1]]))]  # twice at most
        cut = np.searchsorted(found, np.arange(buckets, dtype=_U) << _U(KEY_BITS - buckets.bit_length() + 1))
        cut = np.append(cut, len(found))
        some = [b for b in range(buckets) if cut[b] < cut[b + 1]]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([pack(found[cut[b] : cut[b + 1]]) for b in some], pa.binary())], schema=types)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, rows = [], 0, 0
        for part in by_size(batches, "text", PIECE, BLOCK_ROWS):
            if rows + part.num_rows > BLOCK_ROWS and held:
                yield block(held)
                held, size, rows = [], 0, 0
            key, row = keys_of(part)
            held.append((key & ~_U(0xFFFF)) | (row + rows).astype(_U))
            size, rows = size + part["text"].nbytes, rows + part.num_rows
            if size >= BLOCK:
                yield block(held)
                held, size, rows = [], 0, 0
        if sum(map(len, held)):
            yield block(held)

    def again(f: pd.DataFrame) -> pd.DataFrame:
        k = np.sort(np.concatenate([unpack(x) for x in f["keys"]]))
        k = np.unique(k[1:][k[1:] == k[:-1]])
        return pd.DataFrame({"bucket": [f["bucket"].iloc[0]], "n": [len(k)], "keys": [pack(k)]})

    found = docs.mapInArrow(keys, "bucket int, keys binary").groupBy("bucket").applyInPandas(again, "bucket int, n long, keys binary")
    found = written(found, "repeated-keys")
    n = found.agg(F.sum("n")).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, 8 * buckets, 1 << (64 * n).bit_length()))
    width = bits // buckets

    def bitmap(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for b, data in zip(f["bucket"], f["keys"]):
                flags = np.zeros(width, np.uint8)
                flags[((unpack(data) >> _U(KEY_BITS - bits.bit_length() + 1)) - _U(int(b) * width)).astype(np.int64)] = 1
                out.append(np.packbits(flags, bitorder="little").tobytes())
            yield pd.DataFrame({"bucket": f["bucket"], "bits": out})

    data = bytearray(bits // 8)
    for r in found.where("n > 0").mapInPandas(bitmap, "bucket int, bits binary").toLocalIterator():
        data[r.bucket * width // 8 : (r.bucket + 1) * width // 8] = r.bits
    return spark.sparkContext.broadcast((bits, bytes(data)))


def merged(lo: np.ndarray, hi: np.ndarray, group: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Intervals of each group joined where they touch, as (lo, hi, group)."""
    group = np.zeros(len(lo), np.int64) if group is None else group
    if not len(lo):
        return lo, hi, group
    order = np.lexsort((lo, group))
    lo, hi, group = lo[order], hi[order], group[order]
    top = int(hi.max()) + 2
    reach = np.maximum.accumulate(hi + group * top)  # groups apart on one axis
    new = np.concatenate([[True], (lo + group * top)[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(lo)) - 1
    return lo[first], reach[last] - group[first] * top, group[first]


def removed(docs: DataFrame, spans: DataFrame, found: DataFrame, digest, schema: str, types: pa.Schema) -> DataFrame:
    """``digest(text, lo, hi)`` of every row of ``docs``, where [lo, hi) are the merged intervals to remove; lo is None for a copy.

    ``spans`` has doc_id, text_key, lo, hi.
    """
    whole = found.select("doc_id", "text_key", F.lit(-1).alias("lo"), F.lit(-1).alias("hi"))
    of = spans.unionByName(whole).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_size(batches, "text", PIECE):
            rows = []
            lists = part["spans"].combine_chunks()
            ends = lists.flatten()
            lo, hi = (ends.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy()
            at = np.concatenate([[0], np.cumsum(sizes)])
            for i, (key, text) in enumerate(zip(part["doc_id"].to_pylist(), part["text"].cast(pa.large_binary()).combine_chunks())):
                a, b = lo[at[i] : at[i + 1]].astype(np.int64), hi[at[i] : at[i + 1]].astype(np.int64)
                raw = text.as_py()
                rows.append((key, *(digest(raw, None, None) if len(a) and a.min() < 0 else digest(raw, *merged(a, b)[:2]))))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), types)], schema=types)

    both = docs.join(of, ["doc_id", "text_key"], "left").select("doc_id", "text", "spans")
    return both.mapInArrow(run, schema)


