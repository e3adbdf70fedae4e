"""Nearest neighbours by cosine over balanced posting lists.

Fitting: at most ``SAMPLE`` distinct vectors (those with the smallest hash of
their id) are halved recursively at the median, so all lists get alike shares,
and a few rounds of k-means with a penalty on large lists settle the centroids.
The centroids and a graph that links each to its nearest ones stay in memory
(both are bounded by the sample); every vector finds its lists by a walk over
that graph, a query by comparison with all centroids.  The sample is written by
the executors, and the driver compares a few hundred of it with the centroids
at a time, so its memory grows with neither rows, tasks nor lists.

Indexing: *every* vector is posted to its nearest list and, if it lies near a
boundary, to further lists whose distance is within ``BOUNDARY`` times the
nearest one, unless such a centroid is closer to one already chosen than to the
vector.

Searching: a query reads the lists within ``PRUNE`` times its nearest
centroid's distance, ``LISTS`` of them at most, and in any case its ``depth``
nearest lists.  The depth is measured on the table itself: ``SAMPLE_QUERIES``
queries (those with the smallest hash) are compared with every vector, and the
depth is the least at which their lists hold ``RECALL`` of the neighbours so
found; it has no upper bound but the number of lists.  Up to ``TOGETHER``
neighbouring lists are a group, and a vector or query goes once to each group
that it has lists in, with these lists as bits.  A group that a sample says will
be large has parts; each part meets all queries of the group.  In a task, sorted
by part, a part's queries come first and are held, and its vectors stream past
in blocks: each is compared, as 32-bit floats, with the queries that read one of
its lists, and a query keeps its best.  What is best over all groups, ``SPARE``
more than needed, is scored anew from the original vectors.  A query that has
found too few reads all lists.

Equal vectors are one entry: only their smallest ``k + 1`` ids can be among the
``k`` nearest of any query, so a large group of copies costs one vector.

Defined cases: vectors that are null, zero, hold null or non-finite components,
or differ from the most frequent length take no part; rows with a null vec_id
take no part; repeated rows of one id and vector count once; ties go to the
smaller vec_id; further columns are ignored; an empty table, or one without
queries, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coverlens.llm.common import buffers, pick, written

K = 5
SAMPLE = 20_000
#: Distinct vectors for one list, and the most lists.
PER_LIST = 200
MOST_LISTS = 2_048
REPLICAS, BOUNDARY = 4, 1.15
LISTS, LEAST_LISTS, PRUNE = 48, 8, 1.35
#: The part of the sampled queries' true neighbours that the lists must hold, and the size of that sample.
RECALL, SAMPLE_QUERIES = 0.98, 256
BEAM, LINKS = 64, 16
#: Vectors that are compared with all centroids at once, and the sides of a block of queries times vectors.
ROWS, BLOCK = 256, 512
#: Neighbouring lists that one task reads together at most, the vectors and the queries that it should read, and how many more than k it keeps.
TOGETHER, MOST_POSTED, MOST_ASKED, SPARE = 16, 500_000, 200_000, 4
#: Bytes of vectors that a task sends at once.
SENT = 8 << 20


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _halves(x: np.ndarray, rows: np.ndarray, most: int, out: list[np.ndarray]) -> None:
    """Cuts at the median along the direction in which the rows spread most, until parts have ``most`` rows."""
    if len(rows) <= most:
        out.append(rows)
        return
    own = x[rows] - x[rows].mean(0)
    axis = own[np.argmax((own**2).sum(1))]
    for _ in range(4):
        axis = own.T @ (own @ axis)
        axis /= np.linalg.norm(axis) or 1.0
    order = rows[np.argsort(own @ axis, kind="stable")]
    half = len(order) // 2
    _halves(x, order[:half], most, out)
    _halves(x, order[half:], most, out)


@dataclass
class Centroids:
    """Unit centroids, their nearest-neighbour graph and where a walk starts."""

    points: np.ndarray
    graph: np.ndarray
    entries: np.ndarray

    @staticmethod
    def fit(sample: np.ndarray, lists: int, rounds: int = 6) -> Centroids:
        x = _unit(sample)
        parts: list[np.ndarray] = []
        _halves(x, np.arange(len(x)), max(1, -(-len(x) // lists)), parts)
        points = _unit(np.stack([x[p].mean(0) for p in parts]) + 1e-12)
        share = len(x) / len(points)
        size = np.full(len(points), share)
        for _ in range(rounds):
            penalty = 0.02 * (size / share - 1)
            own = np.concatenate([np.argmax(x[i : i + ROWS] @ points.T - penalty, axis=1) for i in range(0, len(x), ROWS)])
            size = np.bincount(own, minlength=len(points)).astype(float)
            total = np.zeros_like(points)
            np.add.at(total, own, x)
            points = _unit(np.where(size[:, None] > 0, total, points) + 1e-12)
        links = min(LINKS, len(points) - 1)
        graph = np.zeros((len(points), links), np.int64)
        for i in range(0, len(points), ROWS):
            near = points[i : i + ROWS] @ points.T
            near[np.arange(len(near)), np.arange(i, i + len(near))] = -np.inf
            graph[i : i + ROWS] = np.argsort(-near, axis=1, kind="stable")[:, :links]
        far = np.random.default_rng(1).integers(0, len(points), (len(points), 2))  # keeps the graph connected
        return Centroids(points, np.concatenate([graph, far], axis=1), np.unique(np.linspace(0, len(points) - 1, 24).astype(int)))

    def walk(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """The best centroids that the walk has visited and others, and the cosine to each, -inf for the others; x: unit vectors."""
        n, every, rows = len(self.points), x @ self.points.T, np.arange(len(x))
        beam = min(beam, n)
        seen, open_ = np.zeros(every.shape, bool), np.ones(every.shape, bool)
        first = np.unique(np.concatenate([self.entries, self.graph[self.entries].ravel()]))
        seen[:, first], open_[:, self.entries] = True, False
        # the beam only gets better: what is below its worst now is not looked at again
        least = np.partition(every[:, first], len(first) - beam, axis=1)[:, len(first) - beam] if len(first) >= beam else np.full(len(x), -np.inf)
        most = int((every >= least[:, None]).sum(1).max())
        near = np.argpartition(-every, most - 1, axis=1)[:, :most]
        every = np.take_along_axis(every, near, 1)
        while len(rows):  # all that the beam holds and that is not open yet is opened in one round
            score = np.where(seen[rows[:, None], near[rows]], every[rows], -np.inf)
            last = np.partition(score, most - beam, axis=1)[:, most - beam]
            r, c = np.nonzero((score >= last[:, None]) & np.isfinite(score))
            r, c = rows[r], near[rows[r], c]
            new = open_[r, c]
            r, c = r[new], c[new]
            open_[r, c] = False
            seen[r[:, None], self.graph[c]] = True
            rows = np.unique(r)
        return near, np.where(np.take_along_axis(seen, near, 1), every, -np.inf)


def _distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * cosine))


def postings(centroids: Centroids, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists of each unit vector: the nearest, and boundary ones; as places in ``x`` and lists, by place."""
    rows, lists = [], []
    for start in range(0, len(x), ROWS):
        near, score = centroids.walk(x[start : start + ROWS])
        most = min(4 * REPLICAS, score.shape[1])
        best = np.argpartition(-score, most - 1, axis=1)[:, :most]
        order, score = np.take_along_axis(near, best, 1), np.take_along_axis(score, best, 1)
        best = np.lexsort((order, -score), axis=1)
        order, d = np.take_along_axis(order, best, 1), _distance(np.take_along_axis(score, best, 1))
        chosen, held = np.full((len(score), REPLICAS), -1), np.ones(len(score), int)
        chosen[:, 0] = order[:, 0]
        for j in range(1, most):
            at = np.nonzero((held < REPLICAS) & (d[:, j] <= BOUNDARY * d[:, 0]))[0]
            own = centroids.points[order[at, j]]
            apart = np.ones(len(at), bool)
            for k in range(REPLICAS - 1):
                apart &= (held[at] <= k) | (_distance((own * centroids.points[chosen[at, k]]).sum(1)) > d[at, j])
            at = at[apart]
            chosen[at, held[at]] = order[at, j]
            held[at] += 1
        r, c = np.nonzero(chosen >= 0)
        rows.append(r + start)
        lists.append(chosen[r, c])
    return np.concatenate(rows), np.concatenate(lists)


def probes(centroids: Centroids, x: np.ndarray, depth: int = 0) -> list[np.ndarray]:
    """The lists that each unit query reads, nearest first: by distance ratio, and ``depth`` at least."""
    out = []
    for row in x @ centroids.points.T:
        order = np.argsort(-row, kind="stable")
        d = _distance(row[order[:LISTS]])
        out.append(order[: max(min(LEAST_LISTS, len(order)), int((d <= PRUNE * d[0]).sum()), depth)])
    return out


def least_hashed(rows: DataFrame, most: int, *seed: Column) -> DataFrame:
    """id and v of the ``most`` rows (of distinct ids) with the smallest hash of their id, as a written table.

    Each task of a plain top-k would send ``most`` rows to one place.  Hashes
    are spread evenly, so about twice ``most`` rows lie below a bound that
    follows from the number of rows; where they are fewer, the bound is raised.
    """
    hashed = F.xxhash64("id", *seed)
    part = 2 * most / max(1, rows.count())
    below = rows
    while part < 1:
        below = rows.where(hashed < F.lit(int(part * 2**64) - 2**63))
        if below.count() >= most:
            break
        below, part = rows, 2 * part
    return written(below.orderBy(hashed, "id").limit(most).select("id", "v"), "vector-sample")


def nearest_of_all(classes: DataFrame, qids: np.ndarray, x: np.ndarray, k: int) -> DataFrame:
    """q, id, v: the ``k`` vectors nearest to each of a few unit queries, by comparison with every one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, ids, vs = np.zeros((len(x), 0)), np.zeros((len(x), 0), np.int64), np.zeros((len(x), 0), object)
        for b in batches:
            for start in range(0, b.num_rows, 4_096):
                part = b.slice(start, 4_096)
                own = part.column("id").to_numpy()
                got = x @ _unit(_vectors(part.column("v"))).T
                got[qids[:, None] == own] = -np.inf
                at = np.argpartition(-got, k - 1, axis=1)[:, :k] if len(own) > k else np.broadcast_to(np.arange(len(own)), got.shape)
                held = np.array(part.column("v").to_pylist() + [b""], object)[:-1]
                score, ids, vs = np.concatenate([score, np.take_along_axis(got, at, 1)], axis=1), np.concatenate([ids, own[at]], axis=1), np.concatenate([vs, held[at]], axis=1)
                at = np.argsort(-score, axis=1, kind="stable")[:, :k]
                score, ids, vs = (np.take_along_axis(a, at, 1) for a in (score, ids, vs))
        fine = np.isfinite(score)
        yield pa.RecordBatch.from_arrays([np.broadcast_to(qids[:, None], ids.shape)[fine], ids[fine], score[fine], pa.array(list(vs[fine]), pa.binary())], ["q", "id", "score", "v"])

    best = classes.select("id", "v").mapInArrow(run, "q long, id long, score double, v binary")
    return best.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("r") <= k).select("q", "id", "v")


def fit_depth(centroids: Centroids, classes: DataFrame, some: pd.DataFrame, k: int, recall: float = RECALL) -> int:
    """The least number of nearest lists that hold ``recall`` of the true neighbours of a sample of queries."""
    x = _unit(_vectors(some["v"]))
    true = nearest_of_all(classes, some["id"].to_numpy(), x, k).collect()
    if not true:
        return 0
    at, lists = postings(centroids, _unit(_vectors(pa.array([bytes(r.v) for r in true], pa.binary()))))
    place = {q: np.argsort(np.argsort(-row, kind="stable")) for q, row in zip(some["id"], x @ centroids.points.T)}
    need = np.full(len(true), len(centroids.points))
    np.minimum.at(need, at, [int(place[true[i].q][c]) + 1 for i, c in zip(at, lists)])
    read = {q: len(own) for q, own in zip(some["id"], probes(centroids, x))}
    need = sorted(0 if n <= read[r.q] else int(n) for n, r in zip(need, true))
    return need[int(np.ceil(recall * len(need))) - 1]


def _binary(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as binaries."""
    width = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, len(x) * width + 1, width, dtype=np.int32) if width else np.zeros(len(x) + 1, np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


def _vectors(column: pa.Array | pd.Series) -> np.ndarray:
    """Binaries of one size as doubles; see ``valid``."""
    raw, at = buffers(column if isinstance(column, (pa.Array, pa.ChunkedArray)) else pa.array(column, pa.binary()))
    return raw.reshape(len(at) - 1, -1)[:, 1:].copy().view({4: "<f4", 8: "<f8"}[int(raw[0])]).astype(np.float64) if len(raw) else np.zeros((0, 0))


def _valid(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which rows of a column of lists hold finite numbers that are not all zero; their lengths, where they begin, and all numbers."""
    at = column.offsets.to_numpy().astype(np.int64)
    x = column.values.fill_null(float("nan")).to_numpy(zero_copy_only=False)
    bad, some = (np.concatenate([[0], np.cumsum(f)]) for f in (~np.isfinite(x), x != 0))
    ok = column.is_valid().to_numpy(zero_copy_only=False) & (bad[at[1:]] == bad[at[:-1]]) & (some[at[1:]] > some[at[:-1]])
    return ok, np.diff(at), at[:-1], x


def valid(vectors: DataFrame, is_query: Column, k: int) -> tuple[DataFrame, DataFrame]:
    """vec_id, v and q (whether it is a query) of the vectors that take part, and vec_id and v of all queries.

    v is binary: the size of a number in bytes, then the numbers (floats as they
    are, all else as doubles).  Of many copies in one batch only the ``k + 1``
    smallest ids go on, of queries and of others.
    """
    d = pick(vectors, "vec_id", "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    single = d.schema["embedding"].dataType.elementType == T.FloatType()
    d = d.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))
    kind = np.dtype("<f4" if single else "<f8")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, lengths, _, _ = _valid(b.column(0))
            n, c = np.unique(lengths[ok], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int64)), pa.array(c.astype(np.int64))], ["n", "c"])

    most = d.select("embedding").mapInArrow(sizes, "n long, c long").groupBy("n").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "n").first()
    size = most.n if most else 0

    def taking_part(copies: int | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ok, lengths, begin, x = _valid(b.column(1))
                rows = np.nonzero(ok & (lengths == size))[0]
                if not len(rows):
                    continue
                v = np.empty((len(rows), 1 + size * kind.itemsize), np.uint8)
                v[:, 0] = kind.itemsize
                v[:, 1:] = (x[begin[rows, None] + np.arange(size)] + kind.type(0)).astype(kind).view(np.uint8)  # -0.0 and 0.0 are one
                ids, q = b.column(0).to_numpy()[rows], b.column(2).to_numpy(zero_copy_only=False)[rows]
                keep = slice(None) if copies is None else _fewest(v, ids, q, copies)
                yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), _binary(v[keep]), pa.array(q[keep])], ["vec_id", "v", "q"])

        return run

    row = "vec_id long, v binary, q boolean"
    d = d.withColumn("q", F.coalesce(is_query, F.lit(False)))
    return d.mapInArrow(taking_part(k + 1), row), d.where("q").mapInArrow(taking_part(None), row).select("vec_id", "v").distinct()


def _fewest(v: np.ndarray, ids: np.ndarray, q: np.ndarray, most: int) -> np.ndarray | slice:
    """The rows with the ``most`` smallest ids of each vector, among queries and among others."""
    _, own, copies = np.unique(v.view(f"V{v.shape[1]}").ravel(), return_inverse=True, return_counts=True)
    if copies.max() <= most:
        return slice(None)
    order = np.lexsort((ids, q, own))
    new = np.concatenate([[True], (np.diff(own[order]) != 0) | (q[order][1:] != q[order][:-1])])
    fresh = new | np.concatenate([[True], np.diff(ids[order]) != 0])
    place = np.cumsum(fresh)
    first = place[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
    return order[fresh & (place - first < most)]


def _places(ids: np.ndarray, most: np.ndarray | int) -> np.ndarray:
    """A place below ``most`` for each id, by a hash."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype(np.int64) % most


@dataclass
class Deal:
    """Who reads what: ``together`` neighbouring lists are a group, a group's vectors have ``parts`` parts, all queries ``asked`` parts; each combination is a key."""

    together: int
    parts: np.ndarray
    asked: int

    @staticmethod
    def fit(centroids: Centroids, n: int, queries: int, sample: np.ndarray, some: np.ndarray, depth: int) -> Deal:
        """From where a sample of the vectors and of the queries goes."""
        rows, lists = postings(centroids, sample)
        most = len(rows) * n / len(sample) / len(centroids.points)
        together = max(t for t in (1, 2, 4, 8, TOGETHER) if t == 1 or t * most <= MOST_POSTED)
        groups = -(-len(centroids.points) // together)
        share = np.bincount(lists // together, minlength=groups) / len(sample)
        reached = [np.unique(own // together) for own in probes(centroids, some, depth)]
        asked = max(np.bincount(np.concatenate(reached), minlength=groups)) / len(some)
        return Deal(together, np.maximum(1, np.ceil(share * n / MOST_POSTED)).astype(np.int64), max(1, int(np.ceil(asked * queries / MOST_ASKED))))

    @property
    def keys(self) -> int:
        return int(self.parts.sum()) * self.asked

    def rows(self, ids: np.ndarray, at: np.ndarray, lists: np.ndarray, query: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """key, the lists of its group as bits, and place in ``ids`` for each key that the id goes to; ``at`` and ``lists`` say which lists."""
        group = lists // self.together
        pair = at * len(self.parts) + group
        order = np.argsort(pair, kind="stable")
        start = np.nonzero(np.concatenate([[True], np.diff(pair[order]) != 0]))[0]
        bits = np.bitwise_or.reduceat(1 << (lists % self.together)[order], start)
        at, group = at[order][start], group[order][start]
        first = np.concatenate([[0], np.cumsum(self.parts)])[group]
        times = self.parts[group] if query else np.full(len(at), self.asked)
        each = np.repeat(np.arange(len(at)), times)
        turn = np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
        at, first, bits, group = at[each], first[each], bits[each], group[each]
        part, asked = (turn, _places(ids[at], self.asked)) if query else (_places(ids[at], self.parts[group]), turn)
        return (first + part) * self.asked + asked, bits, at


def nearest(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """q, id, score: the ``k`` best of each query within each key.

    Rows (key, posted, bits, id, u) come in that order: a key's queries first,
    then its vectors, which are compared in blocks with the queries that read one
    of their lists.
    """
    key, asking, held = None, [], None

    def out():
        ids, best, score = held[0], held[3], held[4]
        r, c = np.nonzero(best >= 0)
        for i in range(0, len(r), 100_000):
            a, b = r[i : i + 100_000], c[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(held[5][a, b]), pa.array(score[a, b].astype(np.float64))], ["q", "id", "score"])

    for b in batches:
        if not b.num_rows:
            continue
        keys, posted, bits, ids = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        u = buffers(b.column(4))[0].view("<f4").reshape(b.num_rows, -1)
        cut = np.nonzero((np.diff(keys) != 0) | (np.diff(posted) != 0) | (np.diff(bits) != 0))[0] + 1
        for i, j in zip([0, *cut], [*cut, b.num_rows]):
            if keys[i] != key:
                if held:
                    yield from out()
                key, asking, held = keys[i], [], None
            if not posted[i]:
                asking.append((ids[i:j].copy(), bits[i:j].copy(), u[i:j].copy()))
                continue
            if not asking:
                continue
            if held is None:
                own = [np.concatenate(x) for x in zip(*asking)]
                held = (*own, np.full((len(own[0]), k), -1), np.full((len(own[0]), k), -np.inf, np.float32), np.zeros((len(own[0]), k), np.int64))
            reads = np.nonzero(held[1] & bits[i])[0]
            for q in range(0, len(reads), BLOCK):
                _meet(held, reads[q : q + BLOCK], ids[i:j], u[i:j], k)
    if held:
        yield from out()


def _meet(held: tuple, rows: np.ndarray, ids: np.ndarray, u: np.ndarray, k: int) -> None:
    """Puts the vectors that are among the ``k`` best of the queries ``rows`` in their place; equal scores go to the smaller id."""
    _, _, asked, used, best, near = held
    x = asked[rows]
    for i in range(0, len(ids), BLOCK):
        score, own = x @ u[i : i + BLOCK].T, ids[i : i + BLOCK]
        go = np.nonzero(score.max(1) >= best[rows, -1])[0]
        if not len(go):
            continue
        got, r = score[go], rows[go]
        at, c = np.nonzero(got >= best[r, -1:]) if np.isfinite(best[r, -1]).all() else (go[:0], go[:0])
        times = np.bincount(at, minlength=len(go))
        if len(at) and (most := int(times.max())) <= 4 * k:  # the few that are better
            to, new = np.zeros((len(go), most), np.int64), np.full((len(go), most), -np.inf, np.float32)
            place = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            to[at, place], new[at, place] = own[c], got[at, c]
        else:
            take = min(k, len(own))
            at = np.argpartition(-got, take - 1, axis=1)[:, :take]
            least = np.take_along_axis(got, at, 1).min(1)
            tied = np.nonzero((got >= least[:, None]).sum(1) > take)[0]
            at[tied] = np.argsort(-got[tied], axis=1, kind="stable")[:, :take]  # ids ascend
            to, new = own[at], np.take_along_axis(got, at, 1)
        score, to = np.concatenate([best[r], new], axis=1), np.concatenate([near[r], to], axis=1)
        fine = np.concatenate([used[r], np.where(np.isfinite(new), 0, -1)], axis=1)
        order = np.lexsort((to, -score), axis=1)[:, :k]
        best[r], near[r], used[r] = (np.take_along_axis(a, order, 1) for a in (score, to, fine))


def search(vectors: DataFrame, is_query: Column, k: int = K, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of each row for which ``is_query`` (over vec_id) holds."""
    spark = vectors.sparkSession
    every, queries = valid(vectors, is_query, k)
    # copies meet by one shuffle: sorted by the hash first, and grouped in the same partitions
    every = every.withColumn("h", F.xxhash64("v")).repartition("h")
    members = every.withColumn("rn", F.dense_rank().over(Window.partitionBy("h", "v", "q").orderBy("vec_id"))).where(F.col("rn") <= k + 1)
    ids = F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1)
    classes = members.groupBy("h", "v").agg(F.min("vec_id").alias("id"), ids.alias("ids"), F.max("q").alias("q"))
    classes = written(classes.select("id", "v", "ids", "q"), "vector-classes")
    asked = written(classes.where("q").select("id", "v"), "queries")
    n, questions = classes.count(), asked.count()
    if not questions:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    chosen = _vectors(least_hashed(classes, sample).orderBy(F.xxhash64("id"), "id").toPandas()["v"])
    centroids = Centroids.fit(chosen, max(1, min(MOST_LISTS, n // PER_LIST)))
    some = least_hashed(asked, SAMPLE_QUERIES, F.lit(1)).toPandas()
    depth = fit_depth(centroids, classes, some, k)
    deal = Deal.fit(centroids, n, questions, _unit(chosen[:4_096]), _unit(_vectors(some["v"])), depth)

    def sent(which, query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for start in range(0, b.num_rows, 2_048):
                    part = b.slice(start, 2_048)
                    own, x = part.column(0).to_numpy(), _unit(_vectors(part.column(1)))
                    key, bits, at = deal.rows(own, *which(x), query)
                    step = max(1, SENT // (4 * x.shape[1]))
                    for i in range(0, len(key), step):
                        to, few = at[i : i + step], slice(i, i + step)
                        yield pa.RecordBatch.from_arrays([pa.array(key[few]), pa.array(np.full(len(to), not query)), pa.array(bits[few]), pa.array(own[to]), _binary(x[to].astype("<f4"))], ["key", "posted", "bits", "id", "u"])

        return run

    def probed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = probes(centroids, x, depth)
        return np.repeat(np.arange(len(x)), [len(o) for o in own]), np.concatenate(own)

    def all_lists(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(x)), len(centroids.points)), np.tile(np.arange(len(centroids.points)), len(x))

    kept = k + 1 + SPARE

    def meet(asking: DataFrame, which) -> DataFrame:
        row = "key long, posted boolean, bits long, id long, u binary"
        posted = classes.select("id", "v").mapInArrow(sent(lambda x: postings(centroids, x), False), row)
        rows = asking.select("id", "v").mapInArrow(sent(which, True), row).unionByName(posted)
        rows = rows.repartition(deal.keys, "key").sortWithinPartitions("key", "posted", "bits", "id")
        pairs = rows.mapInArrow(lambda batches: nearest(batches, kept), "q long, id long, score double").repartition("q")
        one = pairs.groupBy("q", "id").agg(F.max("score").alias("score"))
        return one.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("r") <= kept).select("q", "id")

    found = written(meet(asked, probed), "neighbours")
    few = asked.join(found.groupBy("q").agg(F.count(F.lit(1)).alias("c")).withColumnRenamed("q", "id"), "id", "left").where(F.coalesce("c", F.lit(0)) < min(k + 1, n)).select("id", "v")
    few = written(few, "queries-left")
    if few.take(1):
        found = found.join(few.select(F.col("id").alias("q")), "q", "left_anti").unionByName(meet(few, all_lists))
    # the score of a pair anew from the original vectors, in one fixed order of summation
    exact = found.join(asked.select(F.col("id").alias("q"), F.col("v").alias("a")), "q").join(classes.select("id", F.col("v").alias("b"), "ids"), "id")

    def rescore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = _vectors(batch.column(1)), _vectors(batch.column(2))
                score = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), batch.column(3)], ["q", "score", "ids"])

    scored = exact.select("q", "a", "b", "ids").mapInArrow(rescore, "q long, score double, ids array<long>")
    asking = queries.join(asked.select("v", F.col("id").alias("q")), "v").select("q", F.col("vec_id").alias("query_id"))
    near = asking.join(scored, "q").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
