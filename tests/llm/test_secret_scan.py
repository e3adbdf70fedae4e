"""Pattern spans against plain regular expressions; the network on held-out keys."""

import hashlib
import random
import re

import pytest

from coverlens.llm import secret_scan as S

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def plain(text):
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(1)) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(out, key=lambda x: (x[1], S.KINDS.index(x[0]))))


def _texts():
    r = random.Random(11)
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    prose = lambda n: " ".join(r.choice(["the", "über", "of", "naïve", "thththththththing", "2024.10.11.2024.10", "4111111111111111", "mail@host.example"]) for _ in range(n))
    texts = [None, "", "token=secret=abcdef", "secret:token :abcdef", "passſword=abcdefgh", "AKIA" + "A" * 15, "AKIA" + "A" * 16, "é" * 3 + "API_KEY : 'x1y2z3'", hexa(23), hexa(24)]
    for i in range(120):
        kind = i % 3
        key = f'token = "{hexa(40)}"' if kind == 0 else f"password={hexa(32)}" if kind == 1 else "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
        texts.append(f"{prose(20)} {key} {prose(20)}")
    return texts


def test_spans(spark):
    texts = _texts()
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, SPANS string").repartition(3)
    rows = {r.doc_id: r for r in S.scan_documents(docs).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        expected = plain(t or "")
        own = ",".join(x for x in rows[i].spans.split(",") if x and not x.startswith("net"))
        assert own == expected
        assert rows[i].base_sha256 == hashlib.sha256(expected.encode()).hexdigest()
        assert [rows[i].n_assign, rows[i].n_access, rows[i].n_hex] == [expected.count(k) for k in ("assign", "access", "hex")]
        if i >= 10:
            for x in rows[i].spans.split(","):
                kind, s, e = x.split(":")
                assert kind != "net" or "ththth" not in t[int(s) : int(e)]


def test_network_tells_held_out_keys_from_words():
    r = random.Random(2)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda: "".join(r.choice(alnum) for _ in range(32)).encode()
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "re"]) for _ in range(10)).encode()
    at = lambda w: S.window(b"some words " + w + b" and more", 11, 11 + len(w))
    net = S.train([at(key()) for _ in range(300)], [at(word()) for _ in range(300)])
    assert (net.probability([at(key()) for _ in range(100)]) >= net.threshold).mean() >= 0.9
    assert (net.probability([at(word()) for _ in range(100)]) >= net.threshold).mean() <= 0.02


def _planted(n_hex, seed):
    """Texts with keys of one shape that patterns know, paths, and 20 keys of other shapes that no pattern knows."""
    r = random.Random(seed)
    some = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    alnum, syllables = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", ["the", "er", "con", "data", "file", "in", "re", "ment", "user", "al", "st", "pro"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    texts = [f"key {some('0123456789abcdef', 32)} end {word()}" for _ in range(n_hex)]
    paths = ["open /" + "/".join(word() for _ in range(r.randint(4, 9))) + " now" for _ in range(280)] + [f"see {word()}_{word()}_{word()}_{word()}_{word()} there" for _ in range(20)]
    return texts, paths, [f"see {some(alnum, 24)} there" for _ in range(16)] + [f"at //hooks.{word()}.example/services/T00000000/B00000000/{some(alnum, 24)} ok" for _ in range(4)]


@pytest.mark.parametrize("n_hex", [0, 39, 41, 300])
def test_keys_that_no_pattern_knows(spark, n_hex):
    known, paths, planted = _planted(n_hex, n_hex)
    docs = spark.createDataFrame(list(enumerate(known + paths + planted)), "doc_id long, text string").repartition(3)
    hit = {r.doc_id: "net:" in r.spans for r in S.scan_documents(docs).collect()}
    found = sum(hit[i] for i in range(n_hex + len(paths), len(hit)))
    wrong = sum(hit[i] for i in range(n_hex, n_hex + len(paths)))
    assert found >= 18 and found / (found + wrong) >= 0.9, (found, wrong)


def test_a_table_without_candidates(spark):
    docs = spark.createDataFrame([(None, "token=abcdef"), (None, "token=abcdef")], "doc_id long, text string")
    assert [r.spans for r in S.scan_documents(docs).collect()] == ["assign:0:12"] * 2
    assert S.scan_documents(docs.limit(0)).count() == 0


def test_redaction_keeps_all_columns(spark):
    docs = spark.createDataFrame([(1, "a é token=abcdef z", "en", 18), (2, None, "en", 0), (3, "clean", None, 5)], "doc_id long, text string, lang string, n_chars int")
    rows = {r.doc_id: r for r in S.redact(docs).collect()}
    assert rows[1].text == "a é [SECRET] z" and rows[1].n_chars == 14 and rows[2].text is None and rows[3].text == "clean" and rows[3].lang is None


def _behind_paths(n, rest):
    r = random.Random(8)
    key = lambda: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(24))
    path = lambda: "/".join(r.choice(["services", "index", "about", "images", "library", "archive", "2024", "page"]) for _ in range(8))
    texts = [f"see //hooks.slack.com/services/T00000000/B00000000/{key()} there" for _ in range(n)]
    texts += [f"see {'0123456789abcdef' * 2}/{key()} there" for _ in range(n)]
    return texts + [f"some words password={key()} and more" if i % 3 == 0 else f"see //www.host.example/{path()} there" for i in range(rest)]


@pytest.mark.parametrize("n, rest", [(8, 600), (5, 0)])  # a network of the table's own rows, and one of the fixed rows
def test_keys_behind_a_long_path_and_beside_findings(spark, n, rest):
    texts = _behind_paths(n, rest)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    spans = {x.doc_id: x.spans for x in S.scan_documents(docs).collect()}
    assert sum("net:4:75" in spans[i] for i in range(n)) == n
    assert sum("net" in spans[i] for i in range(2 * n, len(texts))) <= 0.02 * rest
    if not rest:  # else the parts beside findings, short ones, are among the labelled negatives
        assert sum("net:36:61" in spans[i] for i in range(n, 2 * n)) == n
    redacted = {x.doc_id: x.text for x in S.redact(docs).collect()}
    assert {redacted[i] for i in range(n)} == {"see [SECRET] there"}
    if not rest:
        assert {redacted[i] for i in range(n, 2 * n)} == {"see [SECRET][SECRET] there"}


def test_windows_cover_the_candidate_and_base_spans_leave_parts():
    text = bytes(range(65, 91)) * 8
    for size in (16, 48, 49, 71, 72, 73, 200):
        seen = S.windows(text, 3, 3 + size)
        inside = [w[S.AROUND : S.AROUND + S.INSIDE].rstrip(b"\0") for w in seen]
        assert inside[0] == text[3 : 3 + min(size, S.INSIDE)] and inside[-1] == text[3 + max(0, size - S.INSIDE) : 3 + size]
        assert all(any(text[i : i + 16] in w for w in inside) for i in range(3, 3 + size - 15))
    run = b"a/" * 10 + b"0123456789abcdef" * 2 + b"/short z " + b"0" * 24 + b"g" * 16
    assert S.candidates(run, S.base_spans(run)) == [(0, 20), (85, 101)]


def test_recall_alone_sets_the_threshold():
    r = random.Random(3)
    rows = [S.window(w, 0, len(w)) for w in ("".join(r.choice("abcdefgh") for _ in range(20)).encode() for _ in range(1_000))]
    net = S.train(rows[:60], rows[60:])  # the classes do not differ
    held = net.probability([w for i, w in enumerate(rows[:60]) if i % 4 == 3])
    assert (held >= net.threshold).mean() >= S.RECALL and net.precision < 0.5


def test_every_window_trains(spark):
    known, paths, _ = _planted(60, 4)
    found = S.find(spark.createDataFrame(list(enumerate(known + paths)), "doc_id long, text string").repartition(3))
    rows = found.collect()
    shards, n = S._shards(found, 50)
    dealt = shards.collect()
    assert n > 3 and len(dealt) <= n
    assert sorted(bytes(w) for r in dealt for w in r.known) == sorted({bytes(w) for r in rows for w in r.positives})
    assert sorted(bytes(w) for r in dealt for w in r.others) == sorted({bytes(w) for r in rows for c in r.candidates for w in c.windows})
    a, b = S.fit(found, 50), S.fit(found.coalesce(1), 50)  # many shards, whatever the partitions
    assert (S._packed(a) == S._packed(b)).all() and a.threshold == b.threshold
    words = [w for r in rows for c in r.candidates for w in map(bytes, c.windows)]
    keys = [bytes(w) for r in rows for w in r.positives]
    assert (a.probability(words) >= a.threshold).mean() <= 0.05 and (a.probability(keys) >= a.threshold).mean() >= 0.9
