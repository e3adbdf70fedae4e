"""Near duplicates by DartMinHash signatures and banded joins.

An element of weight w owns the strip [0, w) of a plane whose other axis is
rank.  Darts fall on that plane at unit rate, from the element's hash alone: the
strip is cut into the columns [0, 1), [1, 2), [2, 4), ... and in each column the
j-th dart's rank is a sum of exponential gaps drawn from hash(element, column,
j).  Only darts below a rank limit are thrown (for ``k`` coordinates about
k ln k + 2k in all, whatever the number of elements); each has a random
coordinate and the earliest dart of each coordinate is its value.  A set with an
empty coordinate raises its limit and goes on.  Two weighted sets agree on a
coordinate with the probability of their weighted Jaccard similarity.

Elements are runs of five words, of weight one (or of their multiplicity, with
``counted``).  Texts of fewer words have one element, the whole.  Equal word
sequences are one class from the start.  Of the signature, ``BANDS`` bands of
``ROWS`` coordinates each are joined: for a similarity of 0.8 or more, all bands
miss with probability of at most (1 - 0.8 ** 4) ** 24, about 3e-6.

No bucket is expanded into all pairs.  Round one compares each member with the
most central one of its bucket (the one whose buckets are largest in sum, as
the text is from which the others were copied); linked texts unite, and a pair
inside a component needs no look.  Round two does the same, where a bucket still
spans several components, with the most central member outside the first one's
component and with one that a hash chooses.  Among the texts that are
still in such buckets, few by now, pairs across components are found by an exact
prefix filter: of the elements in order of frequency, a similar pair shares one of
the first fifth of the larger set and the first ninth of the smaller.  So no pair
that the bands found is lost, and a text whose own elements fill that ninth, as
those of a copy too far from the hubs do, meets nobody.  Two such texts that meet
without being similar mostly differ in their sketches, one bit for each coordinate of a
longer signature: a pair whose agreement falls 4.5 standard deviations short of
what the similarity promises (chance of a similar pair: 3.4e-6, as of missing all
bands) is dropped where it meets.  The filter's frequencies
are those of the at most ``MOST_COMMON`` commonest elements; the others count as
equal, which costs work only.  A comparison is exact: the two sets' elements are
joined on the smaller id, then on the larger, and counted.

Defined cases: texts that are null or have no words are alone in their class;
rows with equal words are in one class whatever their blanks; rows of one
doc_id are one document for ``classes`` (of several texts the one with the
smallest hash stands for it), while ``deduplicate`` looks at each text of an id by
itself; a null doc_id is returned with a null class; further columns are ignored
by ``classes`` and kept by ``deduplicate``; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverlens.llm.common import MOST_BROADCAST, bounded_semi_join, buffers, by_size, pick, written
from coverlens.llm.words import mix, window_hashes, word_hashes, words
from coverlens.operators.ranking import global_rank

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4
#: Bits of the sketch that a candidate pair has to pass before it is compared, and how many standard deviations it may fall short.
SKETCH_BITS, SKETCH_SLACK = 2_048, 4.5
#: Elements whose frequency every task knows (16 bytes each).
MOST_COMMON = 100_000
#: Bytes of text hashed at a time, and darts thrown at a time.
BYTES_AT_ONCE, DARTS_AT_ONCE = 2 << 20, 1_000_000
#: Darts thrown in one step: so many strips, with about as many throws each as they need.
THROWS_AT_ONCE = 1 << 16
_U = np.uint64


def elements(raw: np.ndarray, begin: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ``shingle`` words of each text: (set of each element, element, multiplicity), sorted and distinct; and a hash of each text's words."""
    start, stop, upto = words(raw, begin)
    h = word_hashes(raw, start, stop)
    n = np.diff(upto)
    owner = np.repeat(np.arange(len(n)), n)
    # the whole word sequence: position-weighted sum, of which a text without words has zero
    at = np.arange(len(h)) - upto[owner] if len(h) else np.zeros(0, np.int64)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(mix(h ^ mix(at.astype(_U) + _U(77))))])
    whole = np.where(n > 0, mix(sums[upto[1:]] - sums[upto[:-1]] + n.astype(_U)), _U(0))
    runs = window_hashes(h, shingle)
    inside = owner[: len(runs)] == owner[shingle - 1 :] if len(runs) else np.zeros(0, bool)
    short = np.flatnonzero((n > 0) & (n < shingle))
    sets = np.concatenate([owner[: len(runs)][inside], short])
    values = np.concatenate([runs[inside], whole[short]])
    order = np.lexsort((values, sets))
    sets, values = sets[order], values[order]
    new = np.ones(len(sets), bool)
    new[1:] = (sets[1:] != sets[:-1]) | (values[1:] != values[:-1])
    first = np.flatnonzero(new)
    return sets[first], values[first], np.diff(np.append(first, len(sets))), whole


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1], from the upper 53 bits."""
    return ((x >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53


def dart_minhash(sets: np.ndarray, values: np.ndarray, weights: np.ndarray, n_sets: int, k: int) -> np.ndarray:
    """n_sets x k signature of weighted sets; rows of sets without elements are zero.

    ``sets`` ascend.  Weights are positive.  Strips are taken a few at a time, so
    that their darts stay in the processor's cache; a coordinate keeps its earliest
    dart so far, and needs no sort.
    """
    out, best = np.zeros(n_sets * k, _U), np.full(n_sets * k, np.inf)
    total = np.bincount(sets, weights=weights, minlength=n_sets)
    todo = total > 0
    limit = np.where(todo, (k * math.log(k) + 2 * k) / np.maximum(total, 1e-300), 0.0)
    step = _U(0x9E3779B97F4A7C15)
    while todo.any():
        own = np.flatnonzero(todo[sets])
        s, w = sets[own], weights[own].astype(np.float64)
        columns = np.maximum(0, np.ceil(np.log2(w))).astype(np.int64) + 1  # [0, 1), then [2 ** (c - 1), 2 ** c)
        at = np.repeat(np.arange(len(own)), columns)
        column = np.arange(len(at)) - np.repeat(np.cumsum(columns) - columns, columns)
        s, w, low = s[at], w[at], np.where(column > 0, 2.0 ** (column - 1), 0.0)
        width = np.where(column > 0, 2.0 ** (column - 1), 1.0)
        seed = mix(values[own][at] + mix(column.astype(_U) + _U(101)))
        throws = int(np.clip(np.ceil((limit[s] * width).mean()), 4, 64))
        strips = THROWS_AT_ONCE // throws
        for first in range(0, len(seed), strips):
            live, j = np.arange(first, min(first + strips, len(seed))), 0
            rank = np.zeros(len(live))
            while len(live):
                nth = np.arange(j + 1, j + 1 + throws).astype(_U) * step
                draw = mix(seed[live] + nth[:, None])
                ranks = -np.log(_uniform(draw)) / width[live]
                ranks[0] += rank
                ranks = np.cumsum(ranks, axis=0)
                early = ranks < limit[s[live]]
                of = live[np.nonzero(early)[1]]
                dart, when = mix(draw[early] ^ _U(0x6A09E667F3BCC909)), ranks[early]
                hit = low[of] + _uniform(dart) * width[of] <= w[of]
                of, dart, when = of[hit], dart[hit], when[hit]
                cell = s[of] * k + (mix(dart + _U(3)) % _U(k)).astype(np.int64)
                np.minimum.at(best, cell, when)
                won = np.flatnonzero(when == best[cell])
                out[cell[won]] = mix(dart[won] + _U(5))
                rank, live, j = ranks[-1][early[-1]], live[early[-1]], j + throws
        todo &= np.isfinite(best.reshape(n_sets, k)).sum(axis=1) < k
        limit *= 1.25  # the earliest darts stay what they are
    return out.reshape(n_sets, k)


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE, counted: bool = False) -> DataFrame:
    """doc_id, whole (hash of the word sequence, 0 without words) and the bands' hashes of every text."""
    types = pa.schema([("doc_id", pa.int64()), ("whole", pa.int64()), ("bands", pa.list_(pa.int64()))])

    k = bands * rows
    most_rows = max(1, int(DARTS_AT_ONCE / (k * math.log(k) + 2 * k)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_size(batches, "text", BYTES_AT_ONCE, most_rows):
            raw, begin = buffers(part["text"])
            sets, values, n, whole = elements(raw, begin, shingle)
            sig = dart_minhash(sets, values, n.astype(np.float64) if counted else np.ones(len(n)), len(whole), k)
            band = np.zeros((len(whole), bands), _U)
            for r in range(rows):
                band = mix(band + sig[:, r::rows] + _U(r))
            band = mix(band + np.arange(bands, dtype=_U))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, band.size + 1, bands), pa.int32()), pa.array(band.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([part["doc_id"].combine_chunks(), pa.array(whole.view(np.int64)), lists], schema=types)

    return docs.mapInArrow(run, "doc_id long, whole long, bands array<long>")


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``c``, the smallest id that it is connected with, of undirected links (a, b).

    Every vertex takes the smallest label around it, and then its label's
    label, until no link has two labels; labels are written each round.  ``links``
    is read each round, so it should be a written table; it may repeat a link.
    """
    links = links.select("a", "b").where("a <> b")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("c")).withColumnRenamed("a", "id"), "labels")
    of = lambda x: label.select(F.col("id").alias(x), F.col("c").alias(f"c{x}"))
    while links.join(of("a"), "a").join(of("b"), "b").where("ca <> cb").take(1):
        around = both.join(label.select(F.col("id").alias("b"), "c"), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("n"))
        near = label.join(around, "id").select("id", F.least("c", "n").alias("c"))
        up = label.select(F.col("id").alias("c"), F.col("c").alias("up"))
        label = written(near.join(up, "c", "left").select("id", F.least("c", F.coalesce("up", "c")).alias("c")), "labels")
    return label


def _prefixes(n: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """How many first elements a set of each size must show to a smaller or equal set, and to a larger or equal one."""
    shared = lambda share: np.ceil(n * share - 1e-9).astype(np.int64)  # noqa: E731  elements that a pair has in common at least
    return n - shared(similarity) + 1, n - shared(2 * similarity / (1 + similarity)) + 1


def _sketch(sets: np.ndarray, values: np.ndarray, n: np.ndarray, n_sets: int) -> np.ndarray:
    """n_sets x SKETCH_BITS / 64: the lowest bit of each coordinate."""
    some = max(1, int(DARTS_AT_ONCE / (SKETCH_BITS * math.log(SKETCH_BITS) + 2 * SKETCH_BITS)))
    out = []
    for lo in range(0, n_sets, some):
        part = slice(*np.searchsorted(sets, [lo, min(lo + some, n_sets)]))
        sig = dart_minhash(sets[part] - lo, values[part], n[part].astype(np.float64), min(some, n_sets - lo), SKETCH_BITS)
        out.append(np.packbits((sig & _U(1)).astype(np.uint8), axis=1).view(np.int64))
    return np.concatenate(out) if out else np.zeros((0, SKETCH_BITS // 64), np.int64)


def _sketch_bar(similarity: float) -> int:
    """How many bits may differ."""
    differ = (1 - similarity) / 2
    return math.floor(SKETCH_BITS * differ + SKETCH_SLACK * math.sqrt(SKETCH_BITS * differ * (1 - differ)))


def _prefix_pairs(docs: DataFrame, first: DataFrame, members: DataFrame, similarity: float, shingle: int, counted: bool) -> DataFrame:
    """Pairs (a, b) of different components among ``members`` (doc_id, c), with every pair that reaches ``similarity`` among them.

    Prefix filtering: with all elements in one order, the first ones of two similar
    sets meet; of the smaller set a shorter prefix will do.  Common elements come last
    in the order, so prefixes hold rare ones: a copy too far from the hub has so many
    elements of its own that its shorter prefix holds nothing else.
    """
    members = written(members, "open-members")
    members = written(first.select("doc_id", "whole").join(_bounded(members), "doc_id"), "open-members")
    some = docs.join(_bounded(members), "doc_id")

    def spread(sets, values, n, size):
        """Multiset elements as so many different ones."""
        if not counted:
            return sets, values
        at = np.repeat(np.arange(len(sets)), n)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        values = mix(values[at] + nth.astype(_U))
        order = np.lexsort((values, sets[at]))
        return sets[at][order], values[order]

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_size(batches, "text", BYTES_AT_ONCE):
            sets, values, n, whole = elements(*buffers(part["text"]), shingle)
            sets, values, n = _of_rows(_standing(part, whole), sets, values, n)
            _, values = spread(sets, values, n, len(whole))
            value, times = np.unique(values, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(times, pa.int64())], names=["value", "n"])

    counts = some.mapInArrow(alone, "value long, n long").groupBy("value").agg(F.sum("n").alias("n")).where("n > 1")
    counts = written(counts, "element-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    # fewer than MOST_COMMON elements can occur that often
    common = counts.where(F.col("n") > max(1, total // MOST_COMMON)).toArrow()
    value, times = common["value"].to_numpy().view(_U), common["n"].to_numpy()
    order = np.argsort(value)
    held = docs.sparkSession.sparkContext.broadcast((value[order], times[order]))
    types = pa.schema([("doc_id", pa.int64()), ("c", pa.int64()), ("size", pa.int64()), ("value", pa.int64()), ("short", pa.bool_()), ("sketch", pa.list_(pa.int64()))])

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = held.value
        for part in by_size(batches, "text", BYTES_AT_ONCE):
            sets, values, n, whole = elements(*buffers(part["text"]), shingle)
            sets, values, n = _of_rows(_standing(part, whole), sets, values, n)
            sketch = _sketch(sets, values, n if counted else np.ones(len(n)), len(whole))
            sets, values = spread(sets, values, n, len(whole))
            often = np.zeros(len(values), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, values), len(known) - 1)
                often = np.where(known[at] == values, times[at], 0)
            order = np.lexsort((values, often, sets))
            sets, values = sets[order], values[order]
            begin = np.searchsorted(sets, np.arange(len(whole) + 1))
            size = np.diff(begin)
            place = np.arange(len(sets)) - begin[sets]
            long, short = _prefixes(size, similarity)
            some = np.flatnonzero(place < long[sets])
            of = sets[some]
            ids, c = (part[x].combine_chunks().take(pa.array(of)) for x in ("doc_id", "c"))
            bits = pa.ListArray.from_arrays(pa.array(np.arange(len(of) + 1) * sketch.shape[1], pa.int32()), pa.array(sketch[of].ravel()))
            yield pa.RecordBatch.from_arrays([ids, c, pa.array(size[of], pa.int64()), pa.array(values[some].view(np.int64)), pa.array(place[some] < short[of]), bits], schema=types)

    rows = written(some.mapInArrow(prefixes, "doc_id long, c long, size long, value long, short boolean, sketch array<long>"), "prefixes")
    more = rows.select("value", F.col("doc_id").alias("x"), F.col("c").alias("cx"), F.col("size").alias("nx"), F.col("sketch").alias("sx"))
    less = rows.where("short").select("value", F.col("doc_id").alias("y"), F.col("c").alias("cy"), F.col("size").alias("ny"), F.col("sketch").alias("sy"))
    differ = " + ".join(f"bit_count(sx[{i}] ^ sy[{i}])" for i in range(SKETCH_BITS // 64))
    fits = F.expr(f"cx <> cy AND (ny < nx OR ny = nx AND y < x) AND {differ} <= {_sketch_bar(similarity)}") & (F.col("ny") >= F.col("nx") * F.lit(similarity) - 1e-9)
    return _ordered(more.join(less, "value").where(fits), "x", "y").distinct()


def _bounded(members: DataFrame) -> DataFrame:
    """``members`` (an id and one or two longs), broadcast if they are at most MOST_BROADCAST."""
    return F.broadcast(members) if members.count() <= MOST_BROADCAST else members


def _standing(part: pa.Table, whole: np.ndarray) -> np.ndarray:
    """Which rows hold the text that stands for their id."""
    return whole.view(np.int64) == part["whole"].to_numpy()


def _of_rows(rows: np.ndarray, sets: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Only the elements of the sets that ``rows`` marks."""
    return tuple(x[rows[sets]] for x in (sets, *columns))


def _united(label: DataFrame, links: DataFrame) -> DataFrame:
    """``label`` after further links: only the components that they join are connected anew."""
    of = lambda x: label.select(F.col("id").alias(x), F.col("c").alias(f"c{x}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    up = components(written(between.where("a <> b"), "links"))
    known = label.join(up.select(F.col("id").alias("c"), F.col("c").alias("u")), "c", "left").select("id", F.coalesce("u", "c").alias("c"))
    return written(known.unionByName(up.join(label.select("id"), "id", "left_anti")), "labels")


def compare(pairs: DataFrame, docs: DataFrame, first: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, counted: bool = False) -> DataFrame:
    """The pairs (a, b) of doc ids whose texts' elements have a Jaccard similarity of at least ``similarity``, exactly.

    ``first`` has doc_id and whole of the texts that take part.  A text's
    elements travel once, then once for each pair of which it is the smaller.
    """
    pairs = written(pairs.distinct(), "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    ids = written(first.select("doc_id", "whole").join(ids, "doc_id"), "pair-ids")
    types = pa.schema([("doc_id", pa.int64()), ("set", pa.binary())])

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_size(batches, "text", BYTES_AT_ONCE):
            sets, values, n, whole = elements(*buffers(part["text"]), shingle)
            cut = np.searchsorted(sets, np.arange(len(whole) + 1))
            data = np.stack([values, n.astype(_U)], axis=1) if counted else values
            stand = np.flatnonzero(_standing(part, whole))
            rows = pa.array([data[cut[i] : cut[i + 1]].tobytes() for i in stand], pa.binary())
            yield pa.RecordBatch.from_arrays([part["doc_id"].combine_chunks().take(pa.array(stand)), rows], schema=types)

    sets = written(docs.join(_bounded(ids), "doc_id").mapInArrow(sets_of, "doc_id long, set binary"), "element-sets")
    if sets.count() > ids.count():  # rows that repeat an id and its text; else no set has to travel for that
        sets = written(sets.dropDuplicates(["doc_id"]), "element-sets")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for batch in batches:
            a, b, x, y = (batch.column(i) for i in range(4))
            mask = pa.array([_jaccard(p.as_py(), q.as_py(), counted) >= similarity for p, q in zip(x, y)], pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], schema=out)

    with_a = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("x")), "a")
    return with_a.join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(weigh, "a long, b long")


def _jaccard(p: bytes, q: bytes, counted: bool) -> float:
    a, b = np.frombuffer(p, _U), np.frombuffer(q, _U)
    if counted:
        a, b = a.reshape(-1, 2), b.reshape(-1, 2)
        _, i, j = np.intersect1d(a[:, 0], b[:, 0], assume_unique=True, return_indices=True)
        both = float(np.minimum(a[i, 1], b[j, 1]).sum())
        return both / (float(a[:, 1].sum() + b[:, 1].sum()) - both)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def classes(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, counted: bool = False) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class) and class_size of every row."""
    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = d.where("doc_id IS NOT NULL")
    one = signatures(known, shingle=shingle, counted=counted).groupBy("doc_id").agg(F.min(F.struct("whole", "bands")).alias("s"))
    signed = written(one.select("doc_id", "s.whole", "s.bands"), "signatures").where("whole <> 0")
    # the smallest doc_id of each word sequence stands for its copies
    heads = signed.groupBy("whole").agg(F.min(F.struct("doc_id", "bands")).alias("s"), F.count(F.lit(1)).alias("n"))
    heads = written(heads.select("whole", "n", F.col("s.doc_id").alias("head"), "s.bands"), "heads")
    first = heads.select(F.col("head").alias("doc_id"), "whole", "bands")
    banded = first.select("doc_id", F.explode("bands").alias("bucket"))
    sizes = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    banded = written(banded.join(sizes, "bucket"), "buckets")
    # a text in the middle of its group shares the large buckets in most bands
    crowd = banded.groupBy("doc_id").agg(F.sum("n").alias("crowd"))
    banded = written(banded.select("bucket", "doc_id").join(crowd, "doc_id"), "buckets")
    check = lambda pairs: compare(pairs, known, first, similarity, shingle, counted)
    central = F.max_by("doc_id", F.struct("crowd", -F.col("doc_id")))
    hubs = banded.groupBy("bucket").agg(central.alias("hub"))
    label = components(written(check(_ordered(banded.join(hubs, "bucket"), "doc_id", "hub")), "links"))
    for rule in ("hubs", "rest"):
        now = banded.join(label.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("c", F.coalesce("c", "doc_id"))
        open_ = now.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max_by("c", F.struct("crowd", -F.col("doc_id"))).alias("top")).where("lo <> hi")
        open_ = written(now.join(open_.select("bucket", "top"), "bucket"), "open-buckets")
        if not open_.take(1):
            break
        if rule == "rest":
            pairs = _prefix_pairs(known, first, open_.select("doc_id", "c").distinct(), similarity, shingle, counted)
        else:  # the most central member beyond the component of the first hub, and any member
            orders = (F.struct((F.col("c") != F.col("top")).cast("int"), "crowd", -F.col("doc_id")), F.struct(F.xxhash64("doc_id", "bucket")))
            hubs = open_.groupBy("bucket").agg(F.array(*(F.max_by(F.struct(F.col("doc_id").alias("hub"), F.col("c").alias("hc")), o) for o in orders)).alias("hubs"))
            pairs = open_.join(hubs, "bucket").select("doc_id", "c", F.inline("hubs")).where("c <> hc")
            pairs = _ordered(pairs, "doc_id", "hub")
        links = written(check(pairs), "links")
        if links.take(1):
            label = _united(label, links)
    # a class has as many ids as its heads have copies
    sizes = label.join(heads.select(F.col("head").alias("id"), "n"), "id").groupBy("c").agg(F.sum("n").alias("size"))
    label = written(label.join(sizes, "c").select(F.col("id").alias("head"), "c", "size"), "labels")
    of = heads.select("whole", "head", "n").join(label, "head", "left").select("whole", F.coalesce("c", "head").alias("c"), F.coalesce("size", "n").alias("size"))
    own = signed.select("doc_id", "whole").join(of, "whole").select("doc_id", "c", "size")
    return d.select("doc_id").join(own, "doc_id", "left").select("doc_id", F.coalesce("c", "doc_id").alias("class_id"), F.coalesce("size", F.lit(1)).cast("long").alias("class_size"))


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without the rows whose text is a near duplicate of an earlier one, all columns.

    Of each class the row with the smallest doc_id stays, of several such texts the one
    with the smallest hash, of equal rows one; rows with a null doc_id stay.
    """
    names = docs.columns
    plain = pick(docs, "doc_id", "text")
    at = [next(i for exact in (True, False) for i, c in enumerate(names) if (c == n if exact else c.lower() == n)) for n in plain.columns]
    rows = docs.toDF(*(f"c{i}" for i in range(len(names)))).withColumn("_id", F.col(f"c{at[0]}").cast("long"))
    rows = rows.withColumn("_key", F.xxhash64(F.coalesce(F.col(f"c{at[1]}").cast("string"), F.lit(""))))
    texts = written(rows.where("_id IS NOT NULL").groupBy("_id", "_key").agg(F.count(F.lit(1)).alias("n")), "texts")
    several = bool(texts.groupBy("_id").count().where("count > 1").take(1))
    if several:  # each text of an id is numbered by itself, in order of ids
        number = written(global_rank(texts.select("_id", "_key"), ["_id", "_key"], "uid"), "numbers")
        keyed = rows.where("_id IS NOT NULL").dropDuplicates(["_id", "_key"]).join(number, ["_id", "_key"])
        found = classes(keyed.select(F.col("uid").alias("doc_id"), F.col(f"c{at[1]}").alias("text")), similarity, shingle)
        gone = found.where("doc_id <> class_id").select(F.col("doc_id").alias("uid")).join(number, "uid").select("_id", "_key")
        kept = rows.join(written(gone, "gone"), ["_id", "_key"], "left_anti")
    else:
        gone = classes(plain, similarity, shingle).where("doc_id <> class_id").select(F.col("doc_id").alias("_id")).distinct()
        kept = bounded_semi_join(rows, written(gone, "gone"), "_id", anti=True)
    again = texts.where("n > 1").select("_id", "_key")
    if again.take(1):
        one = kept.join(again, ["_id", "_key"], "left_semi").dropDuplicates(["_id", "_key"])
        kept = kept.join(again, ["_id", "_key"], "left_anti").select(one.columns).unionByName(one)
    return kept.select(*(F.col(f"c{i}") for i in range(len(names)))).toDF(*names)


def _ordered(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.where(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
