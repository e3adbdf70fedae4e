"""Repeated byte strings by longest-previous-factor arrays over suffix order.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a
document with a smaller id.  Exact copies of whole texts are settled first, by
digest.  Of the rest, windows of LENGTH bytes are dealt to tasks by the content
around their anchor (see ``repeats``), so equal windows meet; only windows whose
key occurs in several documents travel, neighbours that share a key as one
fragment of text.  Within a block of texts, fragments that repeat are settled
at once and travel for their smallest document only, so a passage that a third
of all documents share reaches a task once for each block.

Each task sorts the suffixes that begin its windows (to LENGTH bytes, then by
document) and computes the longest common prefixes of neighbours; the previous
and the next smaller document of a suffix in that order give the longest factor
that an earlier document shares, and the window goes if it is LENGTH or more.
The first document that has a string keeps it.

Defined cases: a null or empty text has no bytes; rows with a null doc_id lose
nothing and take nothing from others; rows of one doc_id never take from each
other; equal rows give equal results; further columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from coverlens.llm.common import buffers, by_size
from coverlens.llm.repeats import BLOCK, BLOCK_ROWS, PIECE, Filter, copies, keyed, merged, removed, repeated_keys, smallest, without
from coverlens.llm.words import mix

LENGTH = 50
#: Bytes of an anchor, and of the content around it that makes its key.
ANCHOR = 8
_U = np.uint64
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_TYPES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
_MOVED = "key long, doc_id long, text_key long, lo int, hi int, starts binary, fragment binary"


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number, first byte highest; zeros follow the end."""
    x = raw.astype(_U)
    for step in (1, 2, 4):
        y = np.zeros_like(x)
        y[: len(x) - step] = x[step:]
        x = (x << _U(8 * step)) | (y if step == 1 else y)
    return x


def items(raw: np.ndarray, begin: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one key: (key, text, first window, number of windows), places counted in ``raw``."""
    size = np.diff(begin)
    n = np.maximum(size - length + 1, 0)
    none = np.zeros(0, np.int64)
    if not n.sum():
        return none.astype(_U), none, none, none
    x = eights(raw)
    anchor = smallest(mix(x), length - ANCHOR + 1)
    text = np.repeat(np.arange(len(n)), n)
    p = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n) + begin[text]
    a = anchor[p]
    half = (length - ANCHOR) // 2
    left = a - p > half  # the key reaches to the side on which the window has room
    new = np.ones(len(p), bool)
    new[1:] = (a[1:] != a[:-1]) | (left[1:] != left[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(p)))
    a, left, text, p = a[first], left[first], text[first], p[first]
    reach = length - ANCHOR - half  # bytes beyond the anchor that every window of the half holds
    low = np.where(left, a - half - 1, a)
    span = ANCHOR + np.where(left, half + 1, reach)
    key = np.where(left, _U(1), _U(2))
    for j in range(0, ANCHOR + max(half + 1, reach), 8):
        key = mix(key + x[low + np.minimum(j, span - 8)])
    return key, text, p, count


def longest_previous(doc: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """Of each suffix, in suffix order, the longest prefix that a suffix of a smaller document shares, 0 if less than ``least``.

    ``lcp[i]`` is what suffixes i - 1 and i share (lcp[0] = 0).  The previous and
    the next smaller document are found by jumping over those that are not
    smaller; the shared length is the least on the way.
    """
    n = len(doc)

    def previous(doc: np.ndarray, lcp: np.ndarray) -> np.ndarray:
        to, shared = np.arange(n) - 1, lcp.astype(np.int64).copy()
        shared[:1] = 0
        live = np.flatnonzero(shared >= least)
        while len(live):
            live = live[doc[to[live]] >= doc[live]]
            if not len(live):
                break
            over = to[live]
            shared[live] = np.minimum(shared[live], shared[over])
            to[live] = to[over]
            live = live[(shared[live] >= least) & (to[live] >= 0)]
        return np.where((shared >= least) & (to >= 0), shared, 0)

    after = np.append(lcp[1:], 0)
    return np.maximum(previous(doc, lcp), previous(doc[::-1], after[::-1])[::-1])


def repeated_windows(raw: np.ndarray, at: np.ndarray, doc: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of the windows that begin at ``at`` (of documents ``doc``) also begin in a smaller document."""
    x = eights(raw)
    offsets = [*range(0, length - 8, 8), length - 8]
    parts = [x[at + o] for o in offsets]
    order = np.lexsort((doc, *parts[::-1]))
    lcp = np.full(len(at), length, np.int64)
    lcp[:1] = 0
    for o, part in zip(offsets[::-1], parts[::-1]):
        part = part[order]
        differ = part[1:] ^ part[:-1]
        same = np.zeros(len(differ), np.int64)
        for shift in (8, 16, 24, 32, 40, 48, 56):
            same += (differ >> _U(64 - shift)) == 0
        lcp[1:] = np.where(differ != 0, o + same, lcp[1:])
    out = np.zeros(len(at), bool)
    out[order] = longest_previous(doc[order], lcp, length) >= length
    return out


def _fragments(bits, length: int):
    """Fragments that need a verdict, and intervals settled within a block of texts."""
    types = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("starts", pa.binary()), ("fragment", pa.binary())])

    def flush(held: dict, keys: dict) -> Iterator[pa.RecordBatch]:
        rows, settled = [], defaultdict(list)
        for content, places in held.items():
            first = min(doc for doc, _, _ in places)
            own = defaultdict(list)
            for doc, text_key, start in places:
                if doc > first:
                    settled[doc, text_key].append((start, start + len(content)))
                else:
                    own[text_key].append(start)
            rows += [(keys[content], first, t, None, None, np.array(s, "<i4").tobytes(), content) for t, s in own.items()]
        for (doc, t), spans in settled.items():
            lo, hi = np.array(spans, np.int64).T
            rows += [(t, doc, t, a, b, None, None) for a, b in zip(*(x.tolist() for x in merged(lo, hi)[:2]))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), types)], schema=types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Filter(*bits.value)
        held, keys, size = defaultdict(list), {}, 0
        for part in by_size(batches, "text", PIECE, BLOCK_ROWS):
            raw, begin = buffers(part["text"])
            key, text, p, count = items(raw, begin, length)
            some = np.flatnonzero(known(key))
            doc, text_key, data = part["doc_id"].to_pylist(), part["text_key"].to_pylist(), raw.tobytes()
            for k, t, s, n, b in zip(key[some].view(np.int64).tolist(), text[some].tolist(), p[some].tolist(), count[some].tolist(), begin[text[some]].tolist()):
                content = data[s : s + n + length - 1]
                held[content].append((doc[t], text_key[t], s - b))
                keys[content] = k
            size += len(raw)
            if size >= BLOCK:
                yield from flush(held, keys)
                held, keys, size = defaultdict(list), {}, 0
        yield from flush(held, keys)

    return run


def _verdicts(length: int):
    """Intervals to remove, from fragments sorted by key: whole keys at a time, about PIECE bytes of fragments."""
    types = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])

    def judge(t: pa.Table) -> pa.RecordBatch:
        raw, begin = buffers(t["fragment"])
        n = np.maximum(np.diff(begin) - length + 1, 0)
        row = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + begin[row]
        doc = t["doc_id"].to_numpy()
        gone = repeated_windows(raw, at, doc[row], length) if len(at) else np.zeros(0, bool)
        edge = np.ones(len(gone), bool)
        edge[1:] = (row[1:] != row[:-1]) | ~gone[:-1]
        first = np.flatnonzero(gone & edge)
        edge = np.ones(len(gone), bool)
        edge[:-1] = (row[1:] != row[:-1]) | ~gone[1:]
        last = np.flatnonzero(gone & edge)
        own = row[first]
        lo, hi = at[first] - begin[own], at[last] - begin[own] + length
        places, cut = buffers(t["starts"])
        places, cut = places.view("<i4").astype(np.int64), cut // 4
        times = np.diff(cut)[own]
        each = np.repeat(np.arange(len(own)), times)
        start = places[cut[own][each] + np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)] if len(each) else np.zeros(0, np.int64)
        own = own[each]
        text_key = t["text_key"].to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(doc[own]), pa.array(text_key[own]), pa.array(start + lo[each], pa.int32()), pa.array(start + hi[each], pa.int32())], schema=types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            settled = batch.filter(pa.compute.is_valid(batch["lo"]))
            if settled.num_rows:
                yield settled.select(["doc_id", "text_key", "lo", "hi"]).cast(types)
            batch = batch.filter(pa.compute.is_null(batch["lo"]))
            for start in range(0, batch.num_rows, 4_096):
                part = batch.slice(start, 4_096)
                held.append(part)
                size += int(buffers(part["fragment"])[1][-1])
                if size >= PIECE:
                    t = pa.Table.from_batches(held).combine_chunks()
                    key = t["key"].to_numpy()
                    cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
                    if cut:  # the last key may go on
                        yield judge(t.slice(0, cut))
                        held = t.slice(cut).to_batches()
                        size = sum(int(buffers(b["fragment"])[1][-1]) for b in held)
        if held:
            yield judge(pa.Table.from_batches(held).combine_chunks())

    return run


def spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, text_key, lo, hi: byte intervals of ``keyed`` texts, no copies among them, that occur in a smaller document."""

    def keys_of(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        key, text, _, _ = items(*buffers(part["text"]), length)
        return key, text

    bits = repeated_keys(docs.select("text"), keys_of)
    moved = docs.mapInArrow(_fragments(bits, length), _MOVED)
    return moved.repartition("key").sortWithinPartitions("key").mapInArrow(_verdicts(length), "doc_id long, text_key long, lo int, hi int")


def _digest(length: int):
    def run(raw: bytes, lo: np.ndarray | None, hi: np.ndarray | None):
        if lo is None:
            lo, hi = (np.array([0]), np.array([len(raw)])) if len(raw) >= length else (np.zeros(0, int),) * 2
        kept, at = hashlib.sha256(), 0
        for a, b in zip(lo.tolist(), hi.tolist()):
            kept.update(raw[at:a])
            at = b
        kept.update(raw[at:])
        return len(raw), int((hi - lo).sum()), len(lo), kept.hexdigest()

    return run


def deduplicate(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """SCHEMA for every row: its bytes, those that go, the runs they form, and the digest of the rest."""
    d = keyed(docs)
    found = copies(d, length)
    return removed(d, spans(without(d, found, length), length), found, _digest(length), SCHEMA, _TYPES)
