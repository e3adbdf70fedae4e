"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from coverlens.llm import spelling as S


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def words_of(rows):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def brute(count):
    near = {w: [v for v in count if one_edit(w, v)] for w in count}
    form = {}
    for w, n in count.items():
        best = min(near[w], key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= 10 * n else None
    out = []
    for w, n in count.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), count.get(form[w])))
    return sorted(out)


def edited(r, w, letters):
    i = r.randrange(len(w) + 1)
    return r.choice([w[:i] + r.choice(letters) + w[i:], w[:i] + w[i + 1 :], w[:i] + r.choice(letters) + w[i + 1 :]])


def make(seed, letters, n):
    r = random.Random(seed)
    base = ["".join(r.choice(letters) for _ in range(r.randrange(6, 12))) for _ in range(n)]
    words = [*base, *(edited(r, w, letters) for w in base), "z" * 9, "z" * 10, "z" * 8, "y" * 300]
    words += [edited(r, w, letters) for w in words[:n]]
    rows = []
    for doc in range(60):
        text = []
        for w in r.choices(words, k=80):
            text += [w.upper() if r.random() < 0.1 else w] * r.choice([1, 1, 2, 30])
        rows.append((doc, r.choice([" ", "1", "\n", "ő"]).join(text)))
    return [*rows, (None, rows[0][1]), (3, rows[3][1]), (3, rows[3][1]), (100, None), (101, ""), (102, "q" * 20_000 + " " + "q" * 20_000 + " " + "qr" * 10_000 + " " + "qr" * 10_000)]


def check(spark, rows):
    docs = spark.createDataFrame([(*x, "w", 1) for x in rows], "doc_id long, text string, WORD string, Text2 int").repartition(3)
    count = words_of(rows)
    assert {r.word: r.n for r in S.noisy_words(docs).collect()} == count
    want = brute(count)
    assert sorted(map(tuple, S.variants(docs).collect())) == want
    return want


def test_few_letters_many_neighbours(spark):
    want = check(spark, make(0, "abé", 60))
    assert sum(w[4] for w in want) > 300 and any(w[1] for w in want)


def test_many_letters(spark):
    want = check(spark, make(1, "abcdefghijklmnÉÿ×", 150))
    assert any(w[4] for w in want) and any(w[1] for w in want)


def test_chain_of_forms(spark):
    chain = {"abcdefg": 2000, "abcdefgh": 200, "abcdefghi": 20, "abcdefghij": 2, "bbcdefg": 2000, "xbcdefg": 2, "lonelyéé": 5}
    df = spark.createDataFrame(list(chain.items()), "word string, n long")
    got = {r.word: r for r in S.groups(df).collect()}
    assert sorted(map(tuple, got.values())) == brute(chain)
    assert got["abcdefghij"].root == "abcdefg" and got["xbcdefg"].form == "abcdefg"


def test_pivots_are_the_cheapest_disjoint_pair():
    r = np.random.default_rng(0)
    for width in (3, 6, 9):
        rank = r.integers(0, 12, (200, width))
        cost = rank * rank
        last, inside, pivots = S.choose(rank, cost)
        for i in range(200):
            first = [j for _, j in sorted(zip(rank[i], range(width)))[:3]]
            ties = [j for j in range(width) if rank[i, j] == last[i]]
            assert last[i] == sorted(rank[i])[2] and set(np.flatnonzero(inside[i])) == {*first, *ties[:5]}
            pairs = [cost[i, a] + cost[i, b] for a in first for b in first if b - a >= 2]
            a, b = pivots[i]
            assert b - a >= 2 and {a, b} <= set(first) and cost[i, a] + cost[i, b] == min(pairs)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "short only")], "doc_id int, text string")
    assert S.variants(docs).count() == 0 and S.variants(docs.limit(0)).count() == 0
