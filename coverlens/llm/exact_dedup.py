"""Exact duplicates by two passes over a Bloom filter.

Texts are equal when they are the same after lower-casing A-Z alone; of equal
texts the row with the largest doc_id stays.  Every text is read once and becomes
its SHA-256, written with its id (40 bytes a row); no text is shuffled.

Pass one fills a Bloom filter whose positions count to two.  Each task sends the
positions of a block of rows as sorted offsets by segment of the filter, with
those it met twice apart, and one reducer a segment adds the blocks up: a
position counts two if a block met it twice or two blocks met it.  Pass two tests
every row: where all positions of a digest count two it may be repeated, else it
is alone in the table and passes straight through.  Only rows that may be
repeated are grouped; a false hit costs its shuffle and comes out as a group of one.

A filter serves at most ``FILTER_ROWS`` rows and holds ``BITS`` bits for each of
them, 128 MB at most.  A larger table is dealt into equal slices of the digests'
range, each with its own filter, one after the other, so that the share of false
hits (about 0.24 %) is the same at every size.

Hot texts: a block sends a repeated position once, groups are pre-aggregated before
the exchange, and groups that hold more than 1 in ``MOST_HOT`` of the rows found
(so fewer than ``MOST_HOT`` groups, whatever the table) are joined back by
broadcast; the rest meet their groups by a shuffle of digests.

Defined cases: a null text is the empty one, and all empty texts are equal.  A
null doc_id is smaller than any number; it stays only where its whole group has
none, and keep_id is null then.  Of several rows of one id and one text exactly one
stays.  An empty table gives an empty result.  Other columns, also those whose
names differ in case alone, do not matter; ``deduplicate`` returns them unchanged.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverlens.llm.common import pick, written
from coverlens.session import scratch_dir

#: Positions of a digest in the filter, bits of the filter for each row, rows that one filter serves.
HASHES, BITS, FILTER_ROWS = 4, 16, 1 << 26
#: Bits of a segment of the filter; rows of a block whose positions are sent together.
SEGMENT, BLOCK = 1 << 20, 1 << 19
#: Groups that are joined back by broadcast are fewer than this (about 60 bytes each).
MOST_HOT = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """The text that decides equality: A-Z lower-cased, every other character as it is; null is empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def _words(column: pa.Array) -> np.ndarray:
    """The digests of a batch as four 64-bit numbers each."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, "<u8").reshape(-1, 4)


def positions(words: np.ndarray, bits: int) -> np.ndarray:
    """``HASHES`` different positions below ``bits`` (a power of two) for each digest."""
    step = words[:, 1] | np.uint64(1)
    at = words[:, :1] + step[:, None] * np.arange(HASHES, dtype=np.uint64)[None, :]
    return at & np.uint64(bits - 1)


def _filter_bits(rows: int) -> int:
    return max(SEGMENT, 1 << (BITS * rows - 1).bit_length())


def repeated_positions(digests: DataFrame, rows: int) -> tuple[int, bytes]:
    """Pass one: the filter's size in bits, and the bits of the positions that count two.  ``digests`` has sha, at most about ``rows`` rows."""
    bits = _filter_bits(rows)

    def block(parts: list[np.ndarray]) -> pa.RecordBatch:
        at = np.sort(positions(np.concatenate(parts), bits).ravel())
        new = np.concatenate([[True], at[1:] != at[:-1]])
        ones = at[new]
        twos = ones[np.diff(np.append(np.flatnonzero(new), len(at))) > 1]
        edges = np.arange(bits // SEGMENT + 1, dtype=np.uint64) * np.uint64(SEGMENT)
        cuts = [np.searchsorted(x, edges) for x in (ones, twos)]
        some = np.flatnonzero(np.diff(cuts[0]))
        data = [[(x[c[s] : c[s + 1]] & np.uint64(SEGMENT - 1)).astype("<u4").tobytes() for s in some] for x, c in zip((ones, twos), cuts)]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(data[0], pa.binary()), pa.array(data[1], pa.binary())], names=["segment", "once", "twice"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(_words(batch.column(0)))
            n += batch.num_rows
            if n >= BLOCK:
                yield block(held)
                held, n = [], 0
        if held:
            yield block(held)

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        once, twice = np.zeros(SEGMENT, bool), np.zeros(SEGMENT, bool)
        for a, b in zip(frame["once"], frame["twice"]):
            at = np.frombuffer(a, "<u4")
            twice[at[once[at]]] = True
            once[at] = True
            twice[np.frombuffer(b, "<u4")] = True
        return pd.DataFrame({"segment": frame["segment"].iloc[:1], "bits": [np.packbits(twice, bitorder="little").tobytes()]})

    sent = digests.select("sha").mapInArrow(blocks, "segment int, once binary, twice binary")
    out = bytearray(bits // 8)
    for r in sent.groupBy("segment").applyInPandas(add, "segment int, bits binary").toLocalIterator():
        out[r.segment * SEGMENT // 8 : (r.segment + 1) * SEGMENT // 8] = r.bits
    return bits, bytes(out)


def _marked(digests: DataFrame, rows: int) -> tuple[DataFrame, object]:
    """Pass two: ``digests`` with the column ``possible``, and the broadcast filter, to be dropped once the rows are written."""
    held = digests.sparkSession.sparkContext.broadcast(repeated_positions(digests, rows))
    kept = digests.columns

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, data = held.value
        flags = np.frombuffer(data, np.uint8)
        for batch in batches:
            at = positions(_words(batch.column(kept.index("sha"))), bits)
            hit = ((flags[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit, pa.bool_())], names=[*kept, "possible"])

    return digests.mapInArrow(test, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in digests.schema) + ", possible boolean"), held


def _slices(rows: int) -> int:
    return max(1, -(-rows // FILTER_ROWS))


def possible(docs: DataFrame) -> DataFrame:
    """(doc_id, row, sha, possible) of every row: its digest, a number of its own, and whether the filter holds the digest twice."""
    spark = docs.sparkSession
    d = pick(docs, "doc_id", "text")
    d = written(d.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("sha")).withColumn("row", F.monotonically_increasing_id()), "digests")
    rows = d.count()
    slices = _slices(rows)
    path = scratch_dir(spark, f"possible-{uuid.uuid4().hex}")
    if slices > 1:  # each slice's digests in files of their own, so that a round reads no others
        dealt = scratch_dir(spark, f"slices-{uuid.uuid4().hex}")
        of = F.pmod(F.conv(F.hex(F.substring("sha", 21, 7)), 16, 10).cast("long"), F.lit(slices))
        d.withColumn("slice", of.cast("int")).write.partitionBy("slice").parquet(dealt)
        d = spark.read.parquet(dealt)
    for i in range(slices):
        part = d.where(F.col("slice") == i).drop("slice") if slices > 1 else d
        marked, held = _marked(part.select("doc_id", "row", "sha"), -(-rows // slices))
        marked.write.mode("append").parquet(path)
        held.destroy()
    return spark.read.schema("doc_id long, row long, sha binary, possible boolean").parquet(path)


def _grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, row, sha, keep_id, keep_row, group_size) of every row."""
    d = possible(docs)
    alone = d.where("not possible").select("doc_id", "row", "sha", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("group_size"))
    hits = d.where("possible").select("doc_id", "row", "sha")
    groups = hits.groupBy("sha").agg(F.max(F.struct("doc_id", "row")).alias("last"), F.count(F.lit(1)).alias("group_size"))
    groups = written(groups.select("sha", F.col("last.doc_id").alias("keep_id"), F.col("last.row").alias("keep_row"), "group_size"), "groups")
    bar = max(1, (groups.agg(F.sum("group_size")).first()[0] or 0) // MOST_HOT)
    hot = F.broadcast(groups.where(F.col("group_size") > bar))
    cold = groups.where(F.col("group_size") <= bar)
    rest = hits.join(hot.select("sha"), "sha", "left_anti")
    order = alone.columns
    return alone.unionByName(hits.join(hot, "sha").select(order)).unionByName(rest.join(cold.hint("shuffle_merge"), "sha").select(order))


def groups(docs: DataFrame) -> DataFrame:
    """One row per document: the id that stays of its group, the group's size, whether it stays itself, the digest in hex."""
    return _grouped(docs).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Of several rows of one id and one text any one stays, whatever their other columns.
    """
    names = docs.columns
    ids = pick(docs, "doc_id", "text")
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at = {n: next(i for exact in (True, False) for i, c in enumerate(names) if (c == n if exact else c.lower() == n)) for n in ids.columns}
    d = plain.withColumn("_id", F.col(f"c{at['doc_id']}").cast("long")).withColumn("_sha", digest(F.col(f"c{at['text']}")))
    gone = _grouped(docs).where("row <> keep_row").select(F.col("doc_id").alias("i"), F.col("sha").alias("s"), F.expr("doc_id <=> keep_id").alias("again")).distinct()
    gone = written(gone, "gone")
    same = F.expr("_id <=> i and _sha = s")
    stay = d.join(gone, same, "left_anti")
    one = d.join(gone.where("again"), same, "left_semi").dropDuplicates(["_id", "_sha"])
    return stay.unionByName(one).drop("_id", "_sha").toDF(*names)
