"""Bounded-space online packing of token streams into fixed windows.

Each task keeps at most ``open_windows`` unfinished windows.  A document's
stream is cut into whole windows and a rest; the rest goes to the open window
where it leaves the least room.  When it fits into none, a new window opens, or
once all are open the fullest is filled up with the head of the rest and
emitted, and what is left is placed again.  So a window leaves only when full,
and memory does not grow with the input.  At the end of a partition its
unfinished windows are joined into whole ones and less than one window that
remains; these remainders (one for each partition at most, with their ids) meet
by groups of partitions, are joined once more, and the last rest of a group is
cut at powers of two, which need no padding.

The first pass is written to the shared folder, so both passes see the same
windows whatever is recomputed.

Defined cases: a null or empty text is the end id alone; the characters of a mark
that the tokenizer knows as one token, such as `<|endoftext|>`, are that token, as in
the plain call of the library, wherever they stand in a word; equal rows and null
doc_ids are packed each for itself; further columns are ignored; an empty table
gives no sequences.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverlens.llm.common import buffers, by_size, pick, written

CAPACITY = 2_048
OPEN_WINDOWS = 32
END_ID = 1
#: Partitions whose remainders one task joins.
GROUP = 256
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Bytes of text encoded at a time, and distinct words whose ids a worker keeps.
BYTES_AT_ONCE = 4 << 20
MOST_WORDS = 1_000_000
#: A word that stands between words that are encoded together; words that hold it are encoded alone.
_MARK = "\x01"


class _Codes(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        return code


class WordIds:
    """Ids of texts, word by word: the tokenizer drops blanks, merges nothing across them, and no token it adds holds one, so a word has the same ids everywhere."""

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end_id = end_id
        ((self.mark,),) = self._encode([_MARK])
        self.forget()

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def forget(self) -> None:
        """Frees what has been learnt."""
        self.codes = _Codes({b" ": 0})  # no word is a blank: the code of a text's end
        self.ids, self.at = np.array([self.end_id], np.uint32), np.array([0, 1], np.int64)

    def _learn(self) -> None:
        """Ids of the words that are new, many to a text, a mark after each."""
        new = [w.decode("utf-8", "replace") for w in islice(self.codes, len(self.at) - 1, None)]
        ids, sizes = [self.ids], []
        for i in range(0, len(new), 512):
            part = new[i : i + 512]
            if any(_MARK in w for w in part):
                got = self._encode(part)
                ids.append(np.array([x for w in got for x in w], np.uint32))
                sizes.append(np.array([len(w) for w in got]))
            else:
                got = np.array(self._encode([f" {_MARK} ".join(part) + f" {_MARK}"])[0], np.uint32)
                marks = np.flatnonzero(got == self.mark)
                ids.append(np.delete(got, marks))
                sizes.append(np.diff(marks, prepend=-1) - 1)
        self.ids = np.concatenate(ids)
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.concatenate(sizes))])

    def __call__(self, raw: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each with the end id, and where each begins."""
        if len(self.codes) > MOST_WORDS:
            self.forget()
        data, words, ends = raw.tobytes(), [], []
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
            words += data[a:b].split()
            words.append(b" ")
            ends.append(len(words))
        codes = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
        if len(self.codes) > len(self.at) - 1:
            self._learn()
        first, n = self.at[codes], np.diff(self.at)[codes]
        upto = np.cumsum(n)
        ids = self.ids[np.repeat(first - (upto - n), n) + np.arange(upto[-1] if len(n) else 0)]
        return ids, np.concatenate([[0], upto[np.asarray(ends, np.int64) - 1]]) if ends else np.zeros(1, np.int64)


@cache
def word_ids(path: str, end_id: int) -> WordIds:
    """One for each Python worker."""
    return WordIds(path, end_id)


class Packer:
    """Open windows of one task; a piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, capacity: int, open_windows: int, first_sequence: int):
        self.capacity, self.most, self.sequence = capacity, open_windows, first_sequence
        self.open: list[tuple[int, list]] = []  # (room, pieces)
        self.done: list[tuple] = []

    def emit(self, pieces: list) -> None:
        offset = 0
        for doc_id, start, ids, doc_tokens in pieces:
            self.done.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), doc_tokens, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def place(self, doc_id, ids: np.ndarray) -> None:
        start, total = 0, len(ids)
        while total - start >= self.capacity:
            self.emit([(doc_id, start, ids[start : start + self.capacity], total)])
            start += self.capacity
        while start < total:
            need = total - start
            fits = [(room, i) for i, (room, _) in enumerate(self.open) if room >= need]
            if fits:
                at = min(fits)[1]
            elif len(self.open) < self.most:
                at = len(self.open)
                self.open.append((self.capacity, []))
            else:
                at = min((room, i) for i, (room, _) in enumerate(self.open))[1]
            room, pieces = self.open[at]
            take = min(room, need)
            pieces.append((doc_id, start, ids[start : start + take].copy(), total))
            start += take
            if take == room:
                self.emit(pieces)
                del self.open[at]
            else:
                self.open[at] = (room - take, pieces)

    def close(self) -> list:
        """Joins the open windows into whole ones; the pieces of the rest."""
        rest = cut([p for _, pieces in sorted(self.open, key=lambda w: w[0]) for p in pieces], self.capacity, self.emit)
        self.open = []
        return rest


def cut(pieces: list, size: int, emit) -> list:
    """Emits windows of ``size`` from the pieces in order; the pieces that remain."""
    held, room = [], size
    for doc_id, start, ids, total in pieces:
        while len(ids) >= room:
            emit([*held, (doc_id, start, ids[:room], total)])
            start, ids, held, room = start + room, ids[room:], [], size
        if len(ids):
            held.append((doc_id, start, ids, total))
            room -= len(ids)
    return held


def _first_pass(path: str, capacity: int, open_windows: int, end_id: int, types: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = word_ids(path, end_id), TaskContext.get().partitionId()
        packer = Packer(capacity, open_windows, task << 32)
        for part in by_size(batches, "text", BYTES_AT_ONCE):
            ids, begin = encode(*buffers(part["text"]))
            for key, a, b in zip(part["doc_id"].to_pylist(), begin[:-1].tolist(), begin[1:].tolist()):
                packer.place(key, ids[a:b])
            yield _batch(packer.done, types)
            packer.done = []
        encode.forget()  # the worker may go on with other work
        rest = packer.close()
        yield _batch(packer.done, types)
        yield _batch([(key, start, len(ids), None, total, None, None, task, i, ids.tobytes()) for i, (key, start, ids, total) in enumerate(rest)], types)

    return run


def _batch(rows: list[tuple], types: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(columns[i] if i < len(columns) else [None] * len(rows), f.type) for i, f in enumerate(types)], schema=types)


def _join_rests(capacity: int):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["task", "at"])
        keys = [None if pd.isna(k) else int(k) for k in f["doc_id"]]
        pieces = [(k, int(s), np.frombuffer(i, "<u4"), int(t)) for k, s, i, t in zip(keys, f["start"], f["ids"], f["doc_tokens"])]
        packer = Packer(capacity, 1, (1 << 62) + (int(f["task"].iloc[0]) // GROUP << 32))
        rest, size = cut(pieces, capacity, packer.emit), capacity
        while rest:
            size //= 2
            if sum(len(p[2]) for p in rest) >= size:
                rest = cut(rest, size, packer.emit)
        out = pd.DataFrame(packer.done, columns=[c.split()[0] for c in SCHEMA.split(", ")])
        return out.astype({"doc_id": "Int64"})

    return run


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, open_windows: int = OPEN_WINDOWS, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of a document in a sequence: SCHEMA."""
    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = SCHEMA + ", task long, at long, ids binary"
    types = pa.schema([(c.split()[0], pa.binary() if c.endswith("binary") else pa.int64()) for c in schema.split(", ")])
    first = written(d.mapInArrow(_first_pass(path, capacity, open_windows, end_id, types), schema), "packing")
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    rests = first.where(F.col("sequence_id").isNull())
    joined = rests.groupBy(F.floor(F.col("task") / F.lit(GROUP)).alias("g")).applyInPandas(_join_rests(capacity), SCHEMA)
    return first.where(F.col("sequence_id").isNotNull()).select(*names).unionByName(joined)
