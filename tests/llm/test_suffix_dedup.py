"""Removal of repeated bytes against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa

from coverlens.llm import repeats as R
from coverlens.llm import suffix_dedup as S
from coverlens.llm.common import buffers


def brute(rows, length=50):
    first = {}
    for doc, text in rows:
        raw = (text or "").encode()
        if doc is not None:
            for i in range(len(raw) - length + 1):
                w = raw[i : i + length]
                first[w] = min(first.get(w, doc), doc)
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            if doc is not None and first[raw[i : i + length]] < doc:
                gone[i : i + length] = True
        gone = gone[:-1]
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((doc, len(raw), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(raw) else 0, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def make(seed=0):
    r = random.Random(seed)
    prose = lambda n: " ".join(r.choice(["aa", "bé", "cat", "doggy", "of", "the", "漢字"]) + str(r.randrange(90)) for _ in range(n))
    passages = [prose(n) for n in (9, 10, 11, 14, 40, 200)]
    texts = [None, "", "a" * 49, "a" * 50, "a" * 50, "a" * 400, "a" * 333, "ab" * 100, passages[5], passages[5]]
    for _ in range(150):
        texts.append(prose(r.choice([0, 3, 30])) + r.choice(passages + [""]) + prose(r.choice([0, 5])) + r.choice(passages) + prose(r.randrange(20)))
    texts += [t[3:-4] for t in texts[12:20]] + texts[30:40]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    rows = list(zip(ids, texts)) + [(None, passages[5]), (5, passages[4]), (7, passages[4] + "x"), (7, passages[4] + "x")]
    r.shuffle(rows)
    return rows


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 6_000)
    monkeypatch.setattr(S, "PIECE", 2_000)
    monkeypatch.setattr(R, "BLOCK", 6_000)
    rows = make()
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, LO int").repartition(4)
    got = sorted((tuple(r) for r in S.deduplicate(docs).collect()), key=str)
    assert got == brute(rows)


def test_other_lengths_and_an_empty_table(spark):
    rows = make(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in S.deduplicate(docs, 32).collect()), key=str) == brute(rows, 32)
    assert S.deduplicate(docs.limit(0)).count() == 0


def test_longest_previous_factor():
    r = random.Random(1)
    for _ in range(30):
        texts = ["".join(r.choice("ab") for _ in range(r.randrange(1, 12))) for _ in range(6)]
        suffixes = sorted((t[i:], d) for d, t in enumerate(texts) for i in range(len(t)))
        shared = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        lcp = np.array([0, *(shared(suffixes[i - 1][0], suffixes[i][0]) for i in range(1, len(suffixes)))])
        doc = np.array([d for _, d in suffixes])
        got = S.longest_previous(doc, lcp, 3)
        for (s, d), x in zip(suffixes, got):
            best = max([shared(s, o) for o, e in suffixes if e < d], default=0)
            assert x == (best if best >= 3 else 0)


def test_equal_windows_have_equal_keys_wherever_they_stand():
    r = random.Random(2)
    same = "".join(r.choice("abc ") for _ in range(120))
    keys = []
    for pad in range(25):
        raw, begin = buffers(pa.array(["x", "".join(r.choice("abc ") for _ in range(pad)) + same + "z" * pad]))
        key, text, p, n = S.items(raw, begin)
        keys.append({w - 1 - pad: k for k, s, c in zip(key.tolist(), p.tolist(), n.tolist()) for w in range(s, s + c)})
    for w in range(71):
        assert len({k[w] for k in keys}) == 1


def test_packed_keys():
    k = np.sort(np.random.default_rng(1).integers(0, 1 << 48, 1000, dtype=np.uint64))
    assert (R.unpack(R.pack(k)) == k).all() and len(R.unpack(R.pack(k[:0]))) == 0
