"""Removal of repeated word windows against brute force."""

import hashlib
import random

from coverlens.llm import debruijn_dedup as D
from coverlens.llm import repeats as R


def brute(rows, length=50):
    split = [(doc, (text or "").encode().split()) for doc, text in rows]
    first = {}
    for doc, w in split:
        if doc is not None:
            for i in range(len(w) - length + 1):
                key = tuple(w[i : i + length])
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, w in split:
        gone = set()
        for i in range(len(w) - length + 1):
            if doc is not None and first[tuple(w[i : i + length])] < doc:
                gone.update(range(i, i + length))
        out.append((doc, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return sorted(out, key=str)


def make(seed=0, length=50):
    r = random.Random(seed)
    prose = lambda n: [r.choice(["aa", "bé", "cat", "doggy", "of", "the", "漢字"]) + str(r.randrange(30)) for _ in range(n)]
    passages = [prose(n) for n in (length - 1, length, length + 1, length + 9, 2 * length, 5 * length)]
    texts = [None, "", " \n", "a " * (length - 1), "a " * length, "a\n" * length, "a " * 4 * length, "a b " * 2 * length, " ".join(passages[5]), " ".join(passages[5])]
    for _ in range(160):
        own = prose(r.choice([0, 3, 30])) + r.choice([*passages, []]) + prose(r.choice([0, 5])) + r.choice(passages) + prose(r.randrange(20))
        if r.random() < 0.3 and own:
            own[r.randrange(len(own))] = "changed"
        texts.append(r.choice([" ", "  ", "\n", "\t"]).join(own))
    texts += [t[5:-4] for t in texts[12:20]] + texts[30:40]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    rows = list(zip(ids, texts)) + [(None, texts[8]), (5, " ".join(passages[4])), (7, " ".join(passages[4]) + " x"), (7, " ".join(passages[4]) + " x")]
    r.shuffle(rows)
    return rows


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(D, "PIECE", 20_000)
    monkeypatch.setattr(R, "BLOCK", 60_000)
    rows = make()
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, NODE int").repartition(4)
    assert sorted((tuple(r) for r in D.deduplicate(docs).collect()), key=str) == brute(rows)


def test_short_windows_and_an_empty_table(spark):
    for seed, (length, anchor) in enumerate([(12, 3), (20, 2)]):
        rows = make(seed + 1, length)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert sorted((tuple(r) for r in D.deduplicate(docs, length, anchor).collect()), key=str) == brute(rows, length)
    assert D.deduplicate(docs.limit(0)).count() == 0
