"""Exact duplicates against a dictionary, with the filter at its smallest."""

import hashlib
import random
from collections import defaultdict

from coverlens.llm import exact_dedup as X

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    by = defaultdict(list)
    for doc, text in rows:
        by[hashlib.sha256((text or "").translate(LOWER).encode()).hexdigest()].append(doc)
    out = []
    for sha, docs in by.items():
        order = sorted(docs, key=lambda d: (d is not None, d or 0), reverse=True)
        out += [(d, order[0], len(docs), i == 0, sha) for i, d in enumerate(order)]
    return sorted(out, key=str)


def make():
    r = random.Random(3)
    texts = [None, "", "", "A", "a", "É", "é", "İ", "ß", "SS", " a", "long " * 200_000, "LONG " * 200_000, "x\u0000y"]
    texts += [r.choice(["Same Text", "same text"]) for _ in range(200)]
    texts += ["".join(r.choice("abAB ") for _ in range(r.choice([2, 4, 30]))) for _ in range(500)]
    rows = list(zip(r.sample(range(10**12), len(texts)), texts))
    return [*rows, (7, "twice"), (7, "twice"), (7, "Twice"), (7, "other"), (None, "twice"), (None, "no id"), (None, "NO id"), (-5, "minus")]


SCHEMA = "doc_id long, text string, TEXT2 string, Doc_Id string"


def frame(spark, rows):
    return spark.createDataFrame([(*x, "clash", "clash") for x in rows], SCHEMA).repartition(5)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_groups(spark, monkeypatch):
    rows = make()
    docs = frame(spark, rows)
    assert got(X.groups(docs)) == brute(rows)
    # small blocks, several slices with a filter each, few hot groups: the same rows
    for name, value in [("BLOCK", 40), ("FILTER_ROWS", 300), ("MOST_HOT", 20)]:
        monkeypatch.setattr(X, name, value)
    assert X._slices(len(rows)) == 3
    assert got(X.groups(docs)) == brute(rows)
    # a crowded filter has many false hits, and no other rows
    monkeypatch.setattr(X, "positions", lambda w, bits, plain=X.positions: plain(w, bits) & X.np.uint64(255))
    assert got(X.groups(docs)) == brute(rows)


def test_only_possible_repeats_are_grouped(spark):
    rows = make()
    marked = X.possible(frame(spark, rows)).collect()
    size = {sha: n for _, _, n, _, sha in brute(rows)}
    assert all(r.possible for r in marked if size[r.sha.hex()] > 1)
    alone = [r for r in marked if size[r.sha.hex()] == 1]
    assert sum(not r.possible for r in alone) > 0.95 * len(alone) > 100


def test_rows_that_stay(spark):
    rows = make()
    left = X.deduplicate(frame(spark, rows))
    assert left.columns == ["doc_id", "text", "TEXT2", "Doc_Id"]
    kept = [(d, sha) for d, _, _, k, sha in brute(rows) if k]
    assert sorted(((r[0], hashlib.sha256((r[1] or "").translate(LOWER).encode()).hexdigest()) for r in left.collect()), key=str) == sorted(kept, key=str)


def test_empty_and_single(spark):
    docs = spark.createDataFrame([(1, None)], "doc_id int, text string")
    assert got(X.groups(docs)) == brute([(1, None)])
    assert X.groups(docs.limit(0)).count() == 0 and X.deduplicate(docs.limit(0)).count() == 0
