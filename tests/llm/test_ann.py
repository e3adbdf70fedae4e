"""Neighbours against brute force."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from coverlens.llm import ann


def brute(ids, x, queries, k=5):
    x = x.astype(np.float64)
    norm = np.sqrt((x * x).sum(1))
    out = {}
    for q in queries:
        i = ids.index(q)
        score = (x * x[i]).sum(1) / (norm * norm[i])
        order = sorted((j for j in range(len(ids)) if ids[j] != q), key=lambda j: (-score[j], ids[j]))[:k]
        out[q] = [(ids[j], score[j]) for j in order]
    return out


def _recall(rows, expected):
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = total = 0
    for q, near in expected.items():
        own = sorted(got.get(q, []))
        assert [r for r, _, _ in own] == list(range(1, len(near) + 1))
        assert [s for _, _, s in own] == sorted((s for _, _, s in own), reverse=True)
        hit += len({v for _, v, _ in own} & {v for v, _ in near})
        total += len(near)
    assert set(got) == set(expected)
    return hit / total


def test_given_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    t = df.toPandas()
    expected = brute(t.vec_id.tolist(), np.stack(t.embedding), [v for v in t.vec_id if v % 50 == 0])
    rows = ann.search(df, F.col("vec_id") % 50 == 0).collect()
    assert _recall(rows, expected) >= 0.95


def test_many_lists_copies_and_bad_vectors(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(3000, 16)) + 3 * r.normal(size=(30, 16))[r.integers(0, 30, 3000)]
    x[1000:1900] = x[0]
    x[2000] = 2 * x[0]
    ids = list(range(3000))
    rows = [(i, [float(c) for c in x[i]], "x") for i in ids]
    rows += [(9000, None, "x"), (9050, [0.0] * 16, "x"), (9100, [float("nan")] * 16, "x"), (9150, [1.0] * 3, "x"), (9200, [None] + [1.0] * 15, "x"), (9250, [float("inf")] * 16, "x"), (None, [1.0] * 16, "x"), rows[50]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, V string").repartition(7)
    got = ann.search(df, F.col("vec_id") % 50 == 0).collect()
    expected = brute(ids, x, [i for i in ids if i % 50 == 0])
    assert _recall(got, expected) >= 0.95
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 1500), key=lambda r: r.rank)][:5] == [v for v, _ in expected[1500]]


def test_small_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.rank, r.vec_id) for r in ann.search(df, F.col("vec_id") == 0).collect()] == [(1, 2), (2, 1)]
    assert ann.search(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert ann.search(df, F.lit(False)).count() == 0


@pytest.mark.parametrize("n", [20_000, 40_000])  # 1,000 and 2,000 lists
def test_recall_without_clusters_in_many_lists(spark, monkeypatch, n):
    monkeypatch.setattr(ann, "PER_LIST", 20)
    x = np.random.default_rng(n).normal(size=(n, 64))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(8)
    rows = ann.search(df, F.col("vec_id") % 100 == 0).collect()
    assert _recall(rows, brute(list(range(n)), x, range(0, n, 100))) >= 0.95


def test_fit_needs_little_memory_beside_the_sample():
    x = np.random.default_rng(5).normal(size=(20_000, 64))
    tracemalloc.start()
    try:
        centroids = ann.Centroids.fit(x, 2_048, rounds=1)
        assert tracemalloc.get_traced_memory()[1] < 120e6  # all scores at once: 20,000 x 2,048 doubles, twice
    finally:
        tracemalloc.stop()
    assert len(centroids.points) >= 1_024 and (centroids.graph[:, : ann.LINKS] != np.arange(len(centroids.points))[:, None]).all()


def test_driver_gets_written_samples_only(spark, monkeypatch):
    plans = []
    x = np.random.default_rng(6).normal(size=(2_000, 8))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(40)
    plain = type(df).toPandas
    monkeypatch.setattr(type(df), "toPandas", lambda self: plans.append(self._jdf.queryExecution().optimizedPlan().toString()) or plain(self))
    rows = ann.search(df, F.col("vec_id") % 50 == 0, sample=100).collect()
    assert _recall(rows, brute(list(range(2_000)), x, range(0, 2_000, 50))) >= 0.95
    assert len(plans) == 2 and not any("Limit" in p for p in plans)  # a limit sends that many rows of every task


@pytest.mark.parametrize("most", [1, 30, 900, 5_000])
def test_least_hashed_is_the_ordered_limit(spark, most):
    df = spark.range(1_000).select("id", F.array(F.col("id").cast("double")).alias("v")).repartition(9)
    for seed in ((), (F.lit(1),)):
        expected = df.orderBy(F.xxhash64("id", *seed), "id").limit(most).collect()
        assert sorted(ann.least_hashed(df, most, *seed).collect()) == sorted(expected)


def test_groups_in_parts_give_the_same_rows(spark, monkeypatch):
    x = np.random.default_rng(8).normal(size=(4_000, 16))
    x[100:400] = x[7]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>").repartition(5)
    plain = ann.search(df, F.col("vec_id") % 20 == 0).collect()
    monkeypatch.setattr(ann, "MOST_POSTED", 300)
    monkeypatch.setattr(ann, "MOST_ASKED", 30)
    assert sorted(ann.search(df, F.col("vec_id") % 20 == 0).collect()) == sorted(plain)
    monkeypatch.setattr(ann, "TOGETHER", 1)
    assert sorted(ann.search(df, F.col("vec_id") % 20 == 0).collect()) == sorted(plain)


def test_nearest_within_a_key_with_ties():
    r = np.random.default_rng(9)
    q, v = (r.integers(-2, 3, (n, 3)).astype("<f4") for n in (700, 2_600))  # small whole numbers: many equal scores

    def batches(*parts):
        for key, posted, bits, ids, u in parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), key)), pa.array(np.full(len(ids), posted)), pa.array(np.full(len(ids), bits)), pa.array(ids), ann._binary(u)], ["key", "posted", "bits", "id", "u"])

    ids = np.arange(2_600)
    got = ann.nearest(batches((3, False, 1, np.arange(700), q), (3, True, 1, ids[:1_500], v[:1_500]), (3, True, 2, ids, v), (3, True, 3, ids[1_500:], v[1_500:]), (4, True, 1, ids, v), (5, False, 1, ids[:2], q[:2])), 7)
    near = {}
    for b in got:
        for i, j, s in zip(*(b.column(c).to_pylist() for c in range(3))):
            near.setdefault(i, []).append((-s, j))
    score = -(q @ v.T)
    assert near == {i: sorted(zip(score[i].tolist(), ids.tolist()))[:7] for i in range(700)}
