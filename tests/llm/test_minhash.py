"""Signatures against weighted Jaccard, classes against all pairs."""

import math
import random
import time

import numpy as np
import pyarrow as pa

from coverlens.llm import minhash as M
from coverlens.llm.common import buffers


def brute(texts, least=0.8):
    """Smallest index of each text's class, by comparing all pairs."""
    words = [(t or "").split(" ") for t in texts]
    words = [[w for x in ws for w in x.split() if w] for ws in words]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in words]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= least * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def make(n=60, seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [None, "", " \n ", "one two", "one  two", "one two three four five"]
    for _ in range(n):
        base = [r.choice(vocabulary) for _ in range(r.choice([8, 60, 400]))]
        texts.append(" ".join(base))
        for _ in range(r.choice([0, 0, 1, 3])):
            own = list(base)
            for _ in range(r.randrange(0, 1 + len(own) // 30)):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            texts.append(" ".join(own))
    chain = [r.choice(vocabulary) for _ in range(200)]
    for i in range(40):  # each close to its neighbours, the ends far apart
        chain = list(chain)
        chain[5 * i] = "x"
        texts.append(" ".join(chain))
    r.shuffle(texts)
    return texts


def test_signature_agreement_is_the_weighted_similarity():
    a = {i: 1.0 + i % 3 for i in range(200)}
    b = {i: 1.0 + (i // 2) % 4 for i in range(60, 260)}
    keys = sorted(set(a) | set(b))
    true = sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
    k = 4096
    values = M.mix(np.array([*a, *b], np.uint64))
    sig = M.dart_minhash(np.repeat([0, 1], [len(a), len(b)]), values, np.array([*a.values(), *b.values()]), 3, k)
    assert abs((sig[0] == sig[1]).mean() - true) < 4 * (true * (1 - true) / k) ** 0.5
    assert not sig[2].any() and sig[:2].all()


def test_a_coordinate_is_its_earliest_dart(monkeypatch):
    r, k, u = random.Random(3), 24, lambda x: ((x >> 11) + 1.0) * 2.0**-53
    mix = lambda x: int(M.mix(np.array([x & (1 << 64) - 1], np.uint64))[0])
    rows = [(s, r.getrandbits(64), w) for s in (0, 2, 3) for w in ((1.0,) * 6, (0.3,), (1.0, 2.0, 3.5, 9.0))[s % 3] for _ in range(2)]
    best = {}
    for s, value, w in rows:  # one dart after the other, far beyond any limit
        for c in range(max(0, math.ceil(math.log2(w))) + 1):
            low, width = (2.0 ** (c - 1), 2.0 ** (c - 1)) if c else (0.0, 1.0)
            seed, rank = mix(value + mix(c + 101)), 0.0
            for j in range(1, 1_200):
                draw = mix(seed + j * 0x9E3779B97F4A7C15)
                rank -= np.log(u(draw)) / width
                dart = mix(draw ^ 0x6A09E667F3BCC909)
                if low + u(dart) * width <= w:
                    at = (s, mix(dart + 3) % k)
                    best[at] = min(best.get(at, (math.inf, 0)), (rank, mix(dart + 5)))
    sets, values, weights = (np.array([x[i] for x in rows], t) for i, t in enumerate((np.int64, np.uint64, np.float64)))
    for at_once in (M.THROWS_AT_ONCE, 64):
        monkeypatch.setattr(M, "THROWS_AT_ONCE", at_once)
        sig = M.dart_minhash(sets, values, weights, 4, k)
        assert sig.tolist() == [[best.get((s, c), (0, 0))[1] for c in range(k)] for s in range(4)] and not sig[1].any()


def test_a_dart_costs_a_few_hashes():
    """In times of one mix: 14; it was 69 with all darts sorted by coordinate and rank."""
    sets, values = np.repeat(np.arange(100), 300), M.mix(np.arange(30_000, dtype=np.uint64))

    def seconds(f, times=3):
        took = []
        for _ in range(times):
            start = time.process_time()
            f()
            took.append(time.process_time() - start)
        return min(took)

    block, darts = values[:16_384], 100 * M.SKETCH_BITS * (math.log(M.SKETCH_BITS) + 2)
    one = seconds(lambda: [M.mix(block) for _ in range(round(darts / len(block)))])
    assert seconds(lambda: M._sketch(sets, values, np.ones(len(values)), 100)) < 35 * one


def test_elements_do_not_depend_on_the_batch():
    texts = ["a b c d e f", "", None, "é b  c\td", "a b c d e f a b c d e f"]
    sets, values, n, whole = M.elements(*buffers(pa.array(texts)))
    for i, t in enumerate(texts):
        s, v, m, w = M.elements(*buffers(pa.array([t], pa.string())))
        assert (values[sets == i] == v).all() and (n[sets == i] == m).all() and whole[i] == w[0]
    assert n[sets == 4].tolist().count(2) == 2 and whole[1] == whole[2] == 0


def test_classes(spark):
    texts = make()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, Bucket string").repartition(4)
    rows = {r.doc_id: r for r in M.classes(docs).collect()}
    expected = brute(texts)
    assert [rows[i].class_id for i in range(len(texts))] == expected
    assert [rows[i].class_size for i in range(len(texts))] == [expected.count(c) for c in expected]
    kept = sorted(r.doc_id for r in M.deduplicate(docs).collect())
    assert kept == sorted(set(expected))


def test_prefixes_meet_for_every_similar_pair():
    r = random.Random(5)
    for t in (0.5, 0.8, 0.9):
        for _ in range(400):
            common, a, b = r.randrange(1, 60), r.randrange(0, 20), r.randrange(0, 20)
            x, y = (sorted([*range(common), *range(lo, lo + k)], key=lambda v: (v * 7919 + 13) % 1009) for lo, k in ((100, a), (200, b)))
            if len(y) > len(x):
                x, y = y, x
            if common >= t * (common + a + b):
                long, short = (int(p[0]) for p in (M._prefixes(np.array([len(x)]), t)[0], M._prefixes(np.array([len(y)]), t)[1]))
                assert set(x[:long]) & set(y[:short])


def test_pairs_of_what_is_left(spark):
    texts = make(30, seed=9)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for counted in (False, True):
        first = M.signatures(docs, counted=counted).where("whole <> 0").dropDuplicates(["whole"]).select("doc_id", "whole")
        members = first.selectExpr("doc_id", "doc_id AS c")
        pairs = {tuple(p) for p in M._prefix_pairs(docs, first, members, 0.8, 5, counted).collect()}
        everything = first.selectExpr("doc_id AS a").crossJoin(first.selectExpr("doc_id AS b")).where("a < b")
        similar = {tuple(p) for p in M.compare(everything, docs, first, 0.8, 5, counted).collect()}
        assert similar and similar <= pairs


def far_copies(n):
    r = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base)]
    for i in range(n):
        own = list(base)
        for j in r.sample(range(120), r.choice([1, 2, 4, 8])):
            own[j] = f"x{i}-{j}"
        texts.append(" ".join(own))
    return texts


def test_a_large_group_of_far_copies(spark):
    r = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base)]
    for i in range(300):
        own = list(base)
        for j in r.sample(range(120), r.choice([1, 2, 4, 8])):
            own[j] = f"x{i}-{j}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {x.doc_id: x.class_id for x in M.classes(docs).collect()}
    assert [rows[i] for i in range(len(texts))] == brute(texts)


def test_texts_of_one_id_are_looked_at_one_by_one(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(1, a, "k"), (1, b, "k"), (2, a, "k"), (2, a, "k"), (3, b + " x", "k"), (None, a, "k"), (4, None, "k"), (4, None, "k"), (4, "", "k")], "doc_id long, text string, Text2 string")
    left = M.deduplicate(docs)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id or 0), r.text or "") for r in left.collect()) == sorted([(0, a), (1, a), (1, b), (3, b + " x"), (4, "")])
    same = spark.createDataFrame([(5, a), (5, a), (6, a)], "doc_id long, text string")
    assert [tuple(r) for r in M.deduplicate(same).collect()] == [(5, a)]


def test_repeated_rows_null_ids_and_an_empty_table(spark):
    t = "one two three four five six seven"
    docs = spark.createDataFrame([(1, t), (1, t), (2, t), (None, t), (None, None), (3, "other")], "doc_id long, text string")
    assert sorted(((r.doc_id or 0), (r.class_id or 0), r.class_size) for r in M.classes(docs).collect()) == [(0, 0, 1), (0, 0, 1), (1, 1, 2), (1, 1, 2), (2, 1, 2), (3, 3, 1)]
    assert sorted((r.doc_id or 0) for r in M.deduplicate(docs).collect()) == [0, 0, 1, 3]
    assert M.classes(docs.limit(0)).count() == 0


def test_shuffles_are_few(spark):
    """Stages with tasks: 113; they were 139.  Each has as many tasks as there are partitions."""
    docs = spark.createDataFrame(list(enumerate(far_copies(100))), "doc_id long, text string").repartition(2)
    context, group = spark.sparkContext, "shuffles-are-few"
    context.setJobGroup(group, group)
    try:
        M.classes(docs).collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        context.setLocalProperty("spark.job.description", None)
    tracker = context.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    assert 0 < sum(s.numCompletedTasks > 0 for s in stages if s) < 125


def test_components_of_repeated_links_and_a_long_chain(spark):
    links = [(i, i + 1) for i in range(0, 40)] * 2 + [(100, 101), (101, 100), (103, 102)]
    rows = spark.createDataFrame(links, "a long, b long").transform(lambda x: M.written(x, "test-links"))
    label = {r.id: r.c for r in M.components(rows).collect()}
    assert label == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 102, 103: 102}


def test_rows_that_repeat_a_near_copy(spark):
    texts = far_copies(12)
    rows = [(i, t) for i, t in enumerate(texts)]
    other = "alpha beta gamma delta epsilon zeta"
    docs = spark.createDataFrame(rows * 2 + [(50, other), (51, other), (51, other)], "doc_id long, text string").repartition(3)
    expected = dict(enumerate(brute(texts))) | {50: 50, 51: 50}
    found = M.classes(docs).collect()
    assert len(found) == 2 * len(texts) + 3 and {r.doc_id: r.class_id for r in found} == expected
    assert all(r.class_size == list(expected.values()).count(r.class_id) for r in found)
