"""Secrets in whole texts: fixed patterns, and a character network over every candidate.

Patterns find assignments, access keys and hex runs.  A *candidate* is any
other run of key characters of at least ``CANDIDATE_CHARS``, or such a part of a
run beside a pattern finding.  A small convolutional network in numpy judges the
candidate with its surroundings; a long one by windows that overlap by half and by
its parts between marks, each between the candidate's own surroundings, of which
one has to pass.  What passes becomes a span of kind ``net``.

Training is the same at every size.  Labelled positives are the pattern findings
and the ``DRAWN`` fixed keys of usual shapes, as findings alone would teach the
patterns' own shape.  Candidates are unlabelled: among them are the very secrets
that no pattern knows.  So a first network learns from the positives and the fixed
clean windows, and only candidates that it takes for clean (probability below
``RELIABLE``) are negatives of the second one, with the fixed ones.  Every distinct
window of findings and candidates takes part: dealt by hash into shards of about
``SHARD``, each of which trains on its rows and the fixed ones from the same network,
whose results are averaged (as integers, so that the order of summing does not
matter) before the next pass.  Half of the training rows come a second time without
their surroundings, so that the shape of the key counts as well.  Scores are
calibrated on all rows held out from training (Platt scaling), and the threshold is
the highest probability that still finds ``RECALL`` of all held-out positives, both by
counts of scores to 1/``STEPS``; the precision there is logged.

One pass over the texts writes the findings and the candidates' windows, narrow
rows without the texts; training reads that table whole and scoring reads it again.

Defined cases: a null text is empty and has no spans; equal rows are scanned
each for itself; further columns are ignored (``redact`` keeps them); an empty
table gives an empty result; a table without candidates trains nothing.
"""

from __future__ import annotations

import hashlib
import logging
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverlens.llm.common import pick, written

_LOG = logging.getLogger(__name__)
KINDS = ("assign", "access", "hex", "net")
_ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")
CANDIDATE_CHARS = 16
_CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=.-]{%d,}" % CANDIDATE_CHARS)
_PART = re.compile(rb"[A-Za-z0-9+]{%d,}" % CANDIDATE_CHARS)
#: Bytes of the candidate and of the text on either side that the network sees.
INSIDE, AROUND = 48, 24
WIDTH = INSIDE + 2 * AROUND
#: Distinct windows a shard, passes over all of them where there is one shard and at least, steps of a score.
SHARD, PASSES, LEAST_PASSES, STEPS = 4_000, 12, 3, 256
RECALL = 0.95
#: Fixed windows of each class, at every size; below which probability a candidate counts as clean in training.
DRAWN = 400
RELIABLE = 0.5
FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base array<struct<start:long,kind:int,end:long>>, candidates array<struct<start:long,end:long,windows:array<binary>>>, positives array<binary>"
RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def base_spans(text: bytes) -> list[tuple[int, int, int, tuple[int, int]]]:
    """(start, kind, end, key) in bytes, by start and then kind; ``key`` is the part that holds the secret."""
    out = [(m.start(), 0, m.end(), m.span(1)) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    out += [(m.start(), 1, m.end(), m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), m.span()) for m in _HEX.finditer(text)]
    return sorted(out)


def window(text: bytes, start: int, end: int, outer: tuple[int, int] | None = None) -> bytes:
    """The first INSIDE bytes from ``start`` to ``end`` between AROUND bytes before and after it, or before and after the run ``outer``; padded with zero bytes."""
    first, last = outer or (start, end)
    before = text[max(0, first - AROUND) : first].rjust(AROUND, b"\0")
    return before + text[start : min(end, start + INSIDE)].ljust(INSIDE, b"\0") + text[last : last + AROUND].ljust(AROUND, b"\0")


def alone(w: bytes) -> bytes:
    """A window without its surroundings."""
    return b"\0" * AROUND + w[AROUND : AROUND + INSIDE] + b"\0" * AROUND


def windows(text: bytes, start: int, end: int) -> list[bytes]:
    """Windows over a whole candidate: INSIDE bytes each, overlapping by half, the last one up to the end, and its parts between marks; all between the candidate's surroundings."""
    more = [*range(start + INSIDE // 2, end - INSIDE, INSIDE // 2), end - INSIDE] if end - start > INSIDE else []
    parts = [m.span() for m in _PART.finditer(text, start, end)] if more else []
    spans = dict.fromkeys([(start, end), *((s, s + INSIDE) for s in more), *parts])
    return [window(text, *x, (start, end)) for x in spans]


def candidates(text: bytes, base: list) -> list[tuple[int, int]]:
    """Runs of key characters, or what pattern findings leave of them."""
    out, first = [], 0
    ends = np.maximum.accumulate([e for _, _, e, _ in base]) if base else []
    for m in _CANDIDATE.finditer(text):
        while first < len(base) and ends[first] <= m.start():
            first += 1
        at, i = m.start(), first
        while i < len(base) and base[i][0] < m.end():
            out.append((at, base[i][0]))
            at, i = max(at, base[i][2]), i + 1
        out.append((at, m.end()))
    return [(s, e) for s, e in out if e - s >= CANDIDATE_CHARS]


def _points(text: bytes):
    """From byte to code point offsets."""
    if text.isascii():
        return lambda i: i
    before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return lambda i: int(before[i])


def find(docs: DataFrame) -> DataFrame:
    """FOUND for every text; offsets are code points."""
    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    types = pa.schema([
        ("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
        ("base", pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))),
        ("candidates", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("windows", pa.list_(pa.binary()))]))),
        ("positives", pa.list_(pa.binary())),
    ])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                raw = text.as_py() or b""
                base = base_spans(raw)
                more = candidates(raw, base)
                at = _points(raw) if base or more else None
                n = [sum(k == kind for _, kind, _, _ in base) for k in range(3)]
                rows.append((
                    key, *n, [{"start": at(s), "kind": k, "end": at(e)} for s, k, e, _ in base],
                    [{"start": at(s), "end": at(e), "windows": windows(raw, s, e)} for s, e in more],
                    [window(raw, *span) for span in sorted({key for _, _, _, key in base})],
                ))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * 7, types)], schema=types)

    return d.mapInArrow(scan, FOUND)


# --- the network -------------------------------------------------------------

_SYMBOLS = 64
_FILTERS, _SPAN = 16, 5


def _symbol_table() -> np.ndarray:
    """Byte to symbol: 0 padding, letters in either case, digits, the other ASCII marks in groups, 63 bytes beyond ASCII."""
    table = np.full(256, 63, np.int64)
    table[0] = 0
    for i in range(26):
        table[65 + i] = table[97 + i] = 1 + i
    for i in range(10):
        table[48 + i] = 27 + i
    for i, c in enumerate(b" \n\t\"':=._-+/@,;!?()[]{}<>"):
        table[c] = 37 + i
    return table


_TABLE = _symbol_table()


def _inputs(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and letter case of each window."""
    raw = np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WIDTH)
    return _TABLE[raw], ((raw >= 65) & (raw <= 90)).astype(np.float32)


@dataclass
class Network:
    """Convolution over symbols, maximum over each of three regions, one logistic unit; then Platt's a, b and the threshold."""

    conv: np.ndarray  # _SPAN x _SYMBOLS x _FILTERS
    case: np.ndarray  # _SPAN x _FILTERS
    bias: np.ndarray
    out: np.ndarray  # 3 * _FILTERS
    out_bias: float
    a: float = 1.0
    b: float = 0.0
    threshold: float = 0.5
    precision: float = 1.0  # of the held-out rows at the threshold

    def forward(self, symbols: np.ndarray, case: np.ndarray):
        n = WIDTH - _SPAN + 1
        x = np.broadcast_to(self.bias, (len(symbols), n, _FILTERS)).copy()
        for t in range(_SPAN):
            x += self.conv[t][symbols[:, t : t + n]] + case[:, t : t + n, None] * self.case[t]
        regions = (slice(0, AROUND), slice(AROUND, AROUND + INSIDE - _SPAN + 1), slice(AROUND + INSIDE - _SPAN + 1, n))
        best = [x[:, r].argmax(1) + (r.start or 0) for r in regions]
        top = np.concatenate([np.take_along_axis(x, b[:, None, :], 1)[:, 0] for b in best], axis=1)
        hidden = np.maximum(top, 0)
        return hidden @ self.out + self.out_bias, hidden, best

    def passes(self, candidates: list[list[bytes]]) -> np.ndarray:
        """Whether one of each candidate's windows reaches the threshold."""
        if not candidates:
            return np.zeros(0, bool)
        first = np.cumsum([0] + [len(own) for own in candidates[:-1]])
        return np.logical_or.reduceat(self.probability([w for own in candidates for w in own]) >= self.threshold, first)

    def probability(self, windows: list[bytes]) -> np.ndarray:
        if not windows:
            return np.zeros(0)
        scores = np.concatenate([self.forward(*_inputs(windows[i : i + 1_024]))[0] for i in range(0, len(windows), 1_024)])
        return 1 / (1 + np.exp(-np.clip(self.a * scores + self.b, -30, 30)))


def _split(rows: list[bytes], held: bool) -> list[bytes]:
    """Every fourth row is held out from training."""
    return [w for i, w in enumerate(rows) if (i % 4 == 3) == held]


def _start(seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    normal = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    return Network(normal(_SPAN, _SYMBOLS, _FILTERS), normal(_SPAN, _FILTERS), np.zeros(_FILTERS, np.float32), normal(3 * _FILTERS), 0.0)


_PARAMS = ("conv", "case", "bias", "out")
_ONE = 2**32


def _packed(net: Network) -> np.ndarray:
    """The parameters as integers of 1/_ONE, whose sums are exact."""
    flat = np.concatenate([*(getattr(net, p).ravel().astype(np.float64) for p in _PARAMS), [net.out_bias]])
    return np.round(flat * _ONE).astype(np.int64)


def _unpacked(flat: np.ndarray) -> Network:
    net, at = _start(), 0
    for p in _PARAMS:
        old = getattr(net, p)
        setattr(net, p, flat[at : at + old.size].reshape(old.shape).astype(np.float32))
        at += old.size
    net.out_bias = float(flat[at])
    return net


def _pass(net: Network, positives: list[bytes], negatives: list[bytes], seed: list[int]) -> Network:
    """``net`` after one pass over the rows in steps of 64, classes balanced, moments from zero."""
    rng = np.random.default_rng(seed)
    fit = [(w, 1.0) for w in positives] + [(w, 0.0) for w in negatives]
    fit += [(alone(w), y) for w, y in fit[::2]]
    symbols, case = _inputs([w for w, _ in fit])
    labels = np.array([y for _, y in fit], np.float32)
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())).astype(np.float32)
    net = replace(net)
    first, second = ({p: np.zeros_like(getattr(net, p)) for p in _PARAMS} for _ in range(2))
    order = rng.permutation(len(labels))
    for step, i in enumerate(range(0, len(order), 64), 1):
        rows = order[i : i + 64]
        s, c = symbols[rows], case[rows]
        score, hidden, best = net.forward(s, c)
        d = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels[rows]) * weight[rows] / len(rows)
        grad = {"out": hidden.T @ d, "conv": np.zeros_like(net.conv), "case": np.zeros_like(net.case)}
        back = (d[:, None] * net.out) * (hidden > 0)
        grad["bias"] = back.reshape(-1, 3, _FILTERS).sum((0, 1))
        filters, each = np.arange(_FILTERS), np.arange(len(rows))[:, None]
        for region, at in enumerate(best):
            g = back[:, region * _FILTERS : (region + 1) * _FILTERS]
            for t in range(_SPAN):
                np.add.at(grad["conv"][t], (s[each, at + t], filters), g)
                grad["case"][t] += (g * c[each, at + t]).sum(0)
        for p in _PARAMS:
            first[p] = 0.9 * first[p] + 0.1 * grad[p]
            second[p] = 0.999 * second[p] + 0.001 * grad[p] ** 2
            setattr(net, p, (getattr(net, p) - 0.01 * (first[p] / (1 - 0.9**step)) / (np.sqrt(second[p] / (1 - 0.999**step)) + 1e-8)).astype(np.float32))
        net.out_bias -= 0.05 * float(d.sum())
    return net


def _counts(net: Network, rows: list[bytes]) -> dict[int, int]:
    """How many windows score in each step of 1/STEPS."""
    if not rows:
        return {}
    scores = np.concatenate([net.forward(*_inputs(rows[i : i + 1_024]))[0] for i in range(0, len(rows), 1_024)])
    steps, n = np.unique(np.floor(np.clip(scores, -64, 64) * STEPS).astype(np.int64), return_counts=True)
    return dict(zip(steps.tolist(), n.tolist()))


def _platt(scores: np.ndarray, labels: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit to held-out scores that come ``n`` times, by gradient steps."""
    a, b, share = 1.0, 0.0, n / n.sum()
    for _ in range(500):
        p = 1 / (1 + np.exp(-np.clip(a * scores + b, -30, 30)))
        a -= 0.1 * float(((p - labels) * scores * share).sum()) / (1 + float((scores**2 * share).sum()))
        b -= 0.5 * float(((p - labels) * share).sum())
    return a, b


def _calibrated(net: Network, positives: dict[int, int], negatives: dict[int, int]) -> Network:
    """``net`` with Platt's a and b, the threshold that finds RECALL of the held-out positives, and the precision there."""
    steps = np.array([*sorted(positives), *sorted(negatives)], np.float64)
    n = np.array([*(positives[k] for k in sorted(positives)), *(negatives[k] for k in sorted(negatives))], np.float64)
    labels = np.r_[np.ones(len(positives)), np.zeros(len(negatives))]
    net = replace(net)
    net.a, net.b = _platt((steps + 0.5) / STEPS, labels, n)
    sure = lambda x: 1 / (1 + np.exp(-np.clip(net.a * x + net.b, -30, 30)))
    least = np.minimum(sure(steps / STEPS), sure((steps + 1) / STEPS))  # of the scores of a step
    order = np.argsort(-least[labels == 1], kind="stable")
    found = np.cumsum(n[labels == 1][order])
    net.threshold = float(least[labels == 1][order][np.searchsorted(found, np.ceil(RECALL * found[-1]))])
    right, wrong = (float(n[(labels == y) & (least >= net.threshold)].sum()) for y in (1, 0))
    net.precision = right / (right + wrong)
    _LOG.info("threshold %.4f, precision %.3f", net.threshold, net.precision)
    return net


def train(positives: list[bytes], negatives: list[bytes], epochs: int = PASSES, seed: int = 7) -> Network:
    """The network fitted to one shard of labelled windows, four of each class at least."""
    net = _start(seed)
    for epoch in range(epochs):
        net = _pass(net, _split(positives, False), _split(negatives, False), [seed, epoch])
    return _calibrated(net, _counts(net, _split(positives, True)), _counts(net, _split(negatives, True)))


def drawn(n: int = DRAWN) -> tuple[list[bytes], list[bytes]]:
    """Fixed labelled windows: keys of usual shapes, and paths, names, words, numbers and dates of key characters."""
    r = random.Random(5)
    some = lambda chars, *sizes: "".join(r.choice(chars) for _ in range(r.choice(sizes)))
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    syllables = ("the", "er", "con", "tion", "data", "file", "in", "re", "ment", "path", "user", "al", "ing", "st", "or", "pro")
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    key = (lambda: some("0123456789abcdef", 32, 40, 64), lambda: some(upper + lower + digits, 20, 24, 32, 40), lambda: "AKIA" + some(upper + digits, 16), lambda: some(upper + lower + digits + "+/", 40, 44) + "=")
    name = (
        lambda: "/".join(word() for _ in range(6)), lambda: "_".join(word() for _ in range(5)), lambda: "-".join(word() for _ in range(5)), lambda: ".".join(word() for _ in range(5)),
        lambda: "//www." + word() + ".example/" + "/".join(word() for _ in range(4)) + ".html", lambda: some(digits, 16, 18), lambda: ".".join(some(digits, 2, 4) for _ in range(6)),
        lambda: "".join(word() for _ in range(6)), lambda: "".join(word() for _ in range(6)).upper(), lambda: r.choice("=-_.") * r.randint(16, 60), lambda: "//hooks." + word() + ".example/" + word() + "/T00000000/B00000000/" + word(),
    )
    lead = ("", " ", "key: ", 'token = "', "password=", " is ", "(")

    def seen(make) -> bytes:
        before, inside, after = (" ".join(word() for _ in range(8)) + r.choice(lead)).encode(), make().encode(), (r.choice((" ", '"', "\n", ", ")) + " ".join(word() for _ in range(8))).encode()
        return window(before + inside + after, len(before), len(before) + len(inside))

    return [seen(r.choice(key)) for _ in range(n)], [seen(r.choice(name)) for _ in range(n)]


def _shards(found: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Every distinct window once, ``known`` from findings and ``others`` from candidates: a row for each shard of about ``size`` windows, and how many shards."""
    distinct = lambda windows, known: found.select(F.explode(windows).alias("w")).select("w").distinct().withColumn("known", F.lit(known))
    rows = written(distinct(F.col("positives"), True).unionByName(distinct(F.flatten("candidates.windows"), False)), "windows")
    n = max(1, -(-rows.count() // size))
    of = lambda known: F.sort_array(F.collect_list(F.when(known, F.col("w"))))
    dealt = rows.groupBy(F.pmod(F.xxhash64("w"), F.lit(n)).alias("shard")).agg(of(F.col("known")).alias("known"), of(~F.col("known")).alias("others"))
    return written(dealt.repartition(min(n, 10_000), "shard"), "shards"), n


def _fitted(shards: DataFrame, passes: int, before: Network | None, seed: int = 7) -> Network:
    """A network trained on every shard; negatives are the fixed ones and, given the network ``before``, the candidates that it takes for clean."""
    keys, clean = drawn()

    def labelled(f: pd.DataFrame, held: bool) -> Iterator[tuple[int, list[bytes], list[bytes]]]:
        for shard, known, others in zip(f["shard"], f["known"], f["others"]):
            others = [bytes(w) for w in others] if before else []
            others = [w for w, p in zip(others, before.probability(others) if before else ()) if p < RELIABLE]
            yield int(shard), _split([bytes(w) for w in known], held), _split(others, held)

    net = _start(seed)
    for number in range(passes):

        def run(frames: Iterator[pd.DataFrame], net=net, number=number) -> Iterator[pd.DataFrame]:
            total, n = 0, 0
            for f in frames:
                for shard, positives, negatives in labelled(f, False):
                    total = total + _packed(_pass(net, positives + _split(keys, False), negatives + _split(clean, False), [seed, number, shard]))
                    n += 1
            if n:
                yield pd.DataFrame({"n": [n], "v": [total]})

        sums = shards.mapInPandas(run, "n long, v array<long>").select("n", F.posexplode("v").alias("pos", "v")).groupBy("pos").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
        net = _unpacked(np.array([r.v / r.n / _ONE for r in sorted(sums.collect(), key=lambda r: r.pos)]))  # as many rows as the network has parameters

    def held(frames: Iterator[pd.DataFrame], net=net) -> Iterator[pd.DataFrame]:
        for f in frames:
            for _, positives, negatives in labelled(f, True):
                for known, rows in ((True, positives), (False, negatives)):
                    counts = _counts(net, rows)
                    yield pd.DataFrame({"known": [known] * len(counts), "step": list(counts), "n": list(counts.values())}).astype({"known": bool, "step": "int64", "n": "int64"})

    counts = {True: _counts(net, _split(keys, True)), False: _counts(net, _split(clean, True))}
    for r in shards.mapInPandas(held, "known boolean, step long, n long").groupBy("known", "step").agg(F.sum("n").alias("n")).collect():  # at most 128 * STEPS steps
        counts[r.known][r.step] = counts[r.known].get(r.step, 0) + r.n
    return _calibrated(net, counts[True], counts[False])


def fit(found: DataFrame, shard: int = SHARD) -> Network | None:
    """Trains on every distinct window of the findings and of the candidates: the same for the same table, however it is partitioned."""
    if found.where(F.size("candidates") > 0).isEmpty():
        return None  # nothing to score
    shards, n = _shards(found, shard)
    passes = max(LEAST_PASSES, -(-PASSES // n))
    return _fitted(shards, passes, _fitted(shards, passes, None))


def _text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan_documents(docs: DataFrame) -> DataFrame:
    """RESULT for every text."""
    found = written(find(docs), "secrets")
    net = fit(found)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            flat = [c for row in f["candidates"] for c in row]
            hit = iter(net.passes([c["windows"] for c in flat]) if net else [False] * len(flat))
            base, spans = [], []
            for own, more in zip(f["base"], f["candidates"]):
                own = [(b["start"], b["kind"], b["end"]) for b in own]
                base.append(hashlib.sha256(_text(own).encode()).hexdigest())
                spans.append(_text(own + [(c["start"], 3, c["end"]) for c in more if next(hit)]))
            yield f[["doc_id", "n_assign", "n_access", "n_hex"]].assign(base_sha256=base, spans=spans).astype({"doc_id": "Int64"})

    return found.drop("positives").mapInPandas(score, RESULT)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mark``; all columns stay, a null text stays null.

    ``n_chars``, where present, is the length of the new text.
    """
    net = fit(written(find(docs), "secrets"))
    at = docs.columns.index("text") if "text" in docs.columns else [c.lower() for c in docs.columns].index("text")
    length = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    new = mark.encode()

    def clean(raw: bytes | None) -> bytes | None:
        if not raw:
            return raw
        base = base_spans(raw)
        more = candidates(raw, base)
        if more and net:
            hit = net.passes([windows(raw, *c) for c in more])
            more = [c for c, h in zip(more, hit) if h]
        elif more:
            more = []
        spans = sorted([(s, e) for s, _, e, _ in base] + more)
        out, done = [], 0
        for s, e in spans:
            if s >= done:
                out += [raw[done:s], new]
            done = max(done, e)
        return b"".join([*out, raw[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            texts = [clean(t.as_py()) for t in columns[at].cast(pa.large_binary())]
            columns[at] = pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(columns[at].type)
            if length is not None:
                columns[length] = pa.array([None if t is None else len(t.decode("utf-8", "replace")) for t in texts], columns[length].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
