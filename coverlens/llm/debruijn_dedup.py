"""Repeated word sequences through a sparse de Bruijn graph.

A word goes if a window of ``LENGTH`` words that covers it also starts in a
document with a smaller id.  Exact copies of whole texts are settled first, by
digest.  The nodes of the graph are anchors: runs of ``ANCHOR`` words, of which
every window holds at least one (see ``repeats``); an edge is the word sequence
from one anchor of a document to the next, so a document is a path.  Only
anchors that occur in several documents become rows, each with the edge that
leads in, the edge that leads out, and the windows that chose it.

Spark counts a node's edges and its smallest document in one aggregation and
joins them to the occurrences.  A node is *simple* if all its occurrences come
in by one edge and leave by one edge: neighbouring simple nodes are one
nonbranching path, which every document that has any of them has whole, so the
windows over such a path need no look at their words: they repeat where the
node has a smaller document.  Windows over a branching node, or over a place
that is an anchor in one document alone, are compared by a 128-bit hash of
their words: counted first, then joined back to their source coordinates.
Windows whose own anchor no other document has cannot repeat.

A text that repeats itself (one word a thousand times) meets the same node with
the same windows again and again: these occurrences are one row with all their
places, and such a node counts as branching.

Rows of a common passage are combined before they are shuffled, and are joined
to one row each, which Spark splits where they are many.

Defined cases: a null text has no words; rows with a null doc_id lose nothing
and take nothing; rows of one doc_id never take from each other; equal rows
give equal results; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverlens.llm.common import buffers, by_size, written
from coverlens.llm.repeats import BLOCK_ROWS, PIECE, Filter, copies, keyed, merged, removed, repeated_keys, smallest, without
from coverlens.llm.words import mix, window_hashes, word_hashes, words

LENGTH = 50
ANCHOR = 24
_U = np.uint64
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_TYPES = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
#: An occurrence of a node: its edges, its place and its neighbours' (-1: none), its first window, the two hashes of each of its windows, and the first windows of all if it is several.
_NODE = "node long, edge_in long, edge_out long, doc_id long, text_key long, at int, before int, after int, window int, hashes binary, starts binary"
#: [lo, hi) is an interval of words, or with ``starts`` one from each of these.
_FOUND = "w1 long, w2 long, doc_id long, text_key long, lo int, hi int, starts binary"


def anchors(h: np.ndarray, n_words: np.ndarray, length: int, anchor: int):
    """(anchor hashes by word, text of each anchor, its word, its first window, its number of windows); places counted over all texts."""
    begin = np.concatenate([[0], np.cumsum(n_words)])
    n = np.maximum(n_words - length + 1, 0)
    none = np.zeros(0, np.int64)
    if not n.sum():
        return np.zeros(0, _U), none, none, none, none
    k = window_hashes(h, anchor)
    best = smallest(k, length - anchor + 1)
    text = np.repeat(np.arange(len(n)), n)
    p = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n) + begin[text]
    a = best[p]
    new = np.ones(len(p), bool)
    new[1:] = (a[1:] != a[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return k, text[first], a[first], p[first], np.diff(np.append(first, len(p)))


def _hashed(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    raw, begin = buffers(part["text"])
    start, stop, upto = words(raw, begin)
    return word_hashes(raw, start, stop), np.diff(upto)


def _range_hash(h: np.ndarray):
    """Function of (from, to): a hash of the words between, wherever they stand; neither end needs a fixed distance."""
    from coverlens.llm.words import _ODD, powers

    total = np.concatenate([np.zeros(1, _U), np.cumsum(mix(h + _U(9)) * powers(len(h)))])
    down = powers(len(h) + 1, pow(_ODD, -1, 1 << 64))
    return lambda a, b: mix((total[b] - total[a]) * down[a] + mix((b - a).astype(_U)))


def occurrences(bits, length: int = LENGTH, anchor: int = ANCHOR):
    """Rows _NODE of the anchors that the filter knows."""
    types = pa.schema([(c.split()[0], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]]) for c in _NODE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Filter(*bits.value)
        for part in by_size(batches, "text", PIECE, BLOCK_ROWS):
            h, n_words = _hashed(part)
            k, text, a, p, count = anchors(h, n_words, length, anchor)
            some = np.flatnonzero(known(k[a])) if len(a) else a
            if not len(some):
                continue
            begin = np.concatenate([[0], np.cumsum(n_words)])
            joined = np.concatenate([[False], text[1:] == text[:-1], [False]])  # this anchor and the one before are of one text
            low = np.where(joined[:-1], np.concatenate([[0], a[:-1]]), begin[text])
            high = np.where(joined[1:], np.concatenate([a[1:], [0]]) + anchor, begin[text + 1])
            of = _range_hash(h)
            edge_in = mix(of(low, a + anchor) + joined[:-1].astype(_U))  # an edge from a text's beginning is another edge
            edge_out = mix(of(a, high) + joined[1:].astype(_U))
            before = np.where(joined[:-1], low - begin[text], -1)
            after = np.where(joined[1:], high - anchor - begin[text], -1)
            w = np.stack([window_hashes(h, length, 1), window_hashes(h, length, 2)], axis=1)
            # occurrences of one text with equal windows: the first stands for all
            content = mix(k[a][some] + of(p[some], p[some] + count[some] + length - 1))
            order = np.lexsort((p[some], content, text[some]))
            new = np.ones(len(order), bool)
            new[1:] = (content[order][1:] != content[order][:-1]) | (text[some][order][1:] != text[some][order][:-1])
            first = np.flatnonzero(new)
            groups = np.split(some[order], first[1:])
            some, many = some[order][first], np.diff(np.append(first, len(order))) > 1
            starts = [(p[g] - begin[text[g[0]]]).astype("<i4").tobytes() if m else None for g, m in zip(groups, many)]
            edge_in[some[many]] = edge_out[some[many]] = 0
            hashes = [w[s : s + c].tobytes() for s, c in zip(p[some].tolist(), count[some].tolist())]
            t = text[some]
            take = pa.array(t)
            yield pa.RecordBatch.from_arrays([
                pa.array(k[a][some].view(np.int64)), pa.array(edge_in[some].view(np.int64)), pa.array(edge_out[some].view(np.int64)),
                part["doc_id"].combine_chunks().take(take), part["text_key"].combine_chunks().take(take),
                pa.array(a[some] - begin[t], pa.int32()), pa.array(before[some], pa.int32()), pa.array(after[some], pa.int32()), pa.array(p[some] - begin[t], pa.int32()), pa.array(hashes, pa.binary()), pa.array(starts, pa.binary()),
            ], schema=types)

    return run


def _paths(length: int, anchor: int):
    """Intervals settled by nonbranching paths, and windows whose words must be compared (with w1, w2), from occurrences in the order of their text."""
    types = pa.schema([(c.split()[0], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]]) for c in _FOUND.split(", ")])
    reach = length - anchor  # a window at p holds the anchors from p to p + reach

    def settle(t: pa.Table) -> pa.RecordBatch:
        doc, key, at = (t[c].to_numpy() for c in ("doc_id", "text_key", "at"))
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (at[1:] != at[:-1])])
        t = t.filter(pa.array(new)).combine_chunks()  # equal rows give equal occurrences
        doc, key, at, before, after, window = (t[c].to_numpy() for c in ("doc_id", "text_key", "at", "before", "after", "window"))
        several = t["starts"].is_valid().to_numpy(zero_copy_only=False)
        simple = t["simple"].to_numpy(zero_copy_only=False) & ~several
        earlier = t["first"].to_numpy() < doc
        raw, cut = buffers(t["hashes"])
        hashes, cut = raw.view("<i8").reshape(-1, 2), cut // 16
        row = np.repeat(np.arange(len(doc)), np.diff(cut))
        p = np.arange(len(row)) - cut[row] + window[row]
        # walk from the window's own anchor to the others that it holds: a path of simple nodes settles it
        linked = np.zeros(len(doc) + 1, bool)
        linked[1:-1] = (doc[1:] == doc[:-1]) & (key[1:] == key[:-1]) & (before[1:] == at[:-1])
        path = simple[row].copy()
        for to, step in ((before, -1), (after, 1)):
            live, here = np.arange(len(row)), row.copy()
            while len(live):
                held = (to[here] >= p[live]) if step < 0 else ((to[here] >= 0) & (to[here] <= p[live] + reach))
                live, here = live[held], here[held]
                there = linked[here] if step < 0 else linked[here + 1]
                path[live[~there]] = False
                live, here = live[there], here[there] + step
                path[live] &= simple[here]
        settled = path & earlier[row]
        lo, hi, of = merged(p[settled].astype(np.int64), p[settled].astype(np.int64) + length, row[settled])
        open_ = np.flatnonzero(~path)
        none = pa.nulls(len(lo), pa.int64())
        own = row[open_]
        base = np.where(several[own], window[own], 0)  # with starts, the interval counts from each of them
        starts = pa.concat_arrays([pa.nulls(len(lo), pa.binary()), t["starts"].combine_chunks().take(pa.array(own))])
        join = lambda a, b, kind: pa.concat_arrays([a, pa.array(b, kind)])
        return pa.RecordBatch.from_arrays([
            join(none, hashes[open_, 0], pa.int64()), join(none, hashes[open_, 1], pa.int64()), pa.array(doc[np.concatenate([of, own])]), pa.array(key[np.concatenate([of, own])]),
            pa.array(np.concatenate([lo, p[open_] - base]), pa.int32()), pa.array(np.concatenate([hi, p[open_] - base + length]), pa.int32()), starts,
        ], schema=types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, 4_096):
                held.append(batch.slice(start, 4_096))
                rows += held[-1].num_rows
                if rows >= 20_000:
                    t = pa.Table.from_batches(held).combine_chunks()
                    doc, key = t["doc_id"].to_numpy(), t["text_key"].to_numpy()
                    other = np.flatnonzero((doc != doc[-1]) | (key != key[-1]))
                    if len(other):  # the last text may go on
                        yield settle(t.slice(0, int(other[-1]) + 1).combine_chunks())
                        held = t.slice(int(other[-1]) + 1).to_batches()
                        rows = sum(b.num_rows for b in held)
        if held and rows:
            yield settle(pa.Table.from_batches(held).combine_chunks())

    return run


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An interval from each of ``starts``, joined where they touch."""
    types = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])
    for batch in batches:
        raw, cut = buffers(batch["starts"])
        at, cut = raw.view("<i4").astype(np.int64), cut // 4
        row = np.repeat(np.arange(batch.num_rows), np.diff(cut))
        lo, hi, row = merged(at + batch["lo"].to_numpy()[row], at + batch["hi"].to_numpy()[row], row)
        yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(row)), batch["text_key"].take(pa.array(row)), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], schema=types)


def spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, text_key, lo, hi: word intervals of ``keyed`` texts, no copies among them, that occur in a smaller document."""

    def keys_of(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        k, text, a, _, _ = anchors(*_hashed(part), length, anchor)
        return k[a], text

    bits = repeated_keys(docs.select("text"), keys_of)
    seen = written(docs.mapInArrow(occurrences(bits, length, anchor), _NODE), "nodes")
    nodes = seen.groupBy("node").agg(
        F.min("doc_id").alias("first"), (F.min("doc_id") < F.max("doc_id")).alias("shared"),
        ((F.min("edge_in") == F.max("edge_in")) & (F.min("edge_out") == F.max("edge_out"))).alias("simple"),
    ).where("shared")
    known = seen.join(nodes, "node").select("doc_id", "text_key", "at", "before", "after", "window", "hashes", "starts", "first", "simple")
    found = known.repartition("doc_id", "text_key").sortWithinPartitions("doc_id", "text_key", "at").mapInArrow(_paths(length, anchor), _FOUND)
    found = written(found, "windows")
    open_ = found.where("w1 IS NOT NULL")
    first = open_.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("w1", "w2", "first")
    verified = open_.join(first, ["w1", "w2"]).where("doc_id > first")
    names = ["doc_id", "text_key", "lo", "hi"]
    several = verified.where("starts IS NOT NULL").select(*names, "starts").mapInArrow(_places, "doc_id long, text_key long, lo int, hi int")
    return found.where("w1 IS NULL").select(*names).unionByName(verified.where("starts IS NULL").select(*names)).unionByName(several)


def _digest(length: int):
    def run(raw: bytes, lo: np.ndarray | None, hi: np.ndarray | None):
        own = raw.split()
        if lo is None:
            lo, hi = (np.array([0]), np.array([len(own)])) if len(own) >= length else (np.zeros(0, int),) * 2
        kept, at = [], 0
        for a, b in zip(lo.tolist(), hi.tolist()):
            kept += own[at:a]
            at = b
        kept += own[at:]
        return len(own), int((hi - lo).sum()), hashlib.sha256(b" ".join(kept)).hexdigest()

    return run


def deduplicate(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """SCHEMA for every row: its words, those that go, and the digest of the rest."""
    d = keyed(docs)
    found = copies(d, 2 * length - 1)
    return removed(d, spans(without(d, found, 2 * length - 1), length, anchor), found, _digest(length), SCHEMA, _TYPES)
