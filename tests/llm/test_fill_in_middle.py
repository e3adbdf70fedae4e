"""Fill-in-the-middle against string slices, and the round trip."""

import hashlib
import random

from coverlens.llm import fill_in_middle as M


def brute(doc, text):
    t = text or ""
    n = len(t)
    h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not t or "<P>" in t or "<S>" in t or "<M>" in t or h3 % 100 >= 90:
        return doc, n, "plain", None, None, digest(t), digest(t)
    x, y, z = t[:a], t[a:b], t[b:]
    if h4 % 100 < 20:
        return doc, n, "spm", a, b - a, digest(f"<S>{z}<P>{x}<M>{y}"), digest(t)
    return doc, n, "psm", a, b - a, digest(f"<P>{x}<S>{z}<M>{y}"), digest(t)


def make():
    r = random.Random(1)
    texts = [None, "", "x", "<", "<P", "P>", "<P>", "a<S>b", "<M><M>", "\U0001f600é漢", "a\u0000b", "<<<SSPM>>>" * 30]
    texts += ["".join(r.choice("<>PSM é漢\U0001f600\n") for _ in range(r.choice([1, 2, 5, 40, 200]))) for _ in range(400)]
    texts += ["ab<é" * 100_000]
    rows = list(zip(r.sample(range(-5, 10**9), len(texts)), texts))
    return [*rows, (None, "no id, but a text"), (3, "same"), (3, "same"), (3, "other"), (4, None), (4, ""), (4, None)]


def test_documents(spark, monkeypatch):
    rows = make()
    docs = spark.createDataFrame([(*x, 1, "k") for x in rows], "doc_id long, text string, TEXT2 int, KEY string").repartition(4)
    want = sorted((brute(*x) for x in rows), key=str)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert sorted(map(tuple, M.transform(docs).collect()), key=str) == want
    for unit in (1, 2, 7):  # marks fall across pieces
        monkeypatch.setattr(M, "UNIT", unit)
        some = docs.where("length(text) < 1000 or text is null")
        assert sorted(map(tuple, M.transform(some).collect()), key=str) == sorted((brute(*x) for x in rows if len(x[1] or "") < 1000), key=str)


def test_a_mark_across_pieces():
    text = "ab<" + "<P>" + "P><" + "<S>" + "S" + "<M>" + "M>"
    for cut in range(1, len(text)):
        o = M._Output(b"", 1, "psm")
        found = [x for part in (text[:cut], text[cut:]) for x in o.feed(part)] + list(o.feed("", last=True))
        whole = ["".join(t for p, _, t in sorted(found) if p == i) for i in range(3)]
        assert whole == ["ab<P><", "M>", "S"] and o.digest.hexdigest() == hashlib.sha256(text.encode()).hexdigest()


def test_outputs_are_texts(spark):
    rows = [(i, f"text {i} of some length") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    by = {}
    for r in M.outputs(docs).collect():
        by[r.doc_id] = by.get(r.doc_id, "") + r.piece
    assert {d: hashlib.sha256(t.encode()).hexdigest() for d, t in by.items()} == {d: brute(d, t)[5] for d, t in rows}
    assert M.transform(docs.limit(0)).count() == 0
