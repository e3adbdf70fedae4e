"""Packed pieces against encoding every text at once."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from coverlens.llm import packing

PATH = P.path("word_bpe_49k.json")


def _expected(texts):
    t = Tokenizer.from_file(PATH)
    return [np.asarray(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4") for x in texts]


def _check(rows, texts, capacity):
    ids = _expected(texts)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(range(len(texts)))
    for k, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[k])
            assert r.ids_crc32 == zlib.crc32(ids[k][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[k])
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert padding == 0


def test_marks_are_tokens(spark):
    texts = ["hello <|endoftext|> world", "hello<|endoftext|>world", "<|startoftext|>", "<|start oftext|>"]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH).collect()
    assert [r.doc_tokens for r in sorted(rows, key=lambda r: r.doc_id)][:3] == [4, 4, 2]
    _check(rows, texts, 2048)


def test_documents(spark):
    r = random.Random(3)
    words = ["the", "Of", "naïve", "12345", "don't", "ÉCLAIR", "漢字かな", "x y", "a b", "ΣΑΣ", "İstanbul", "<|endoftext|>", "a<|endoftext|><|startoftext|>b", "<|endoftext", "<|EndOfText|>", "éte"]
    texts = [None, "", " \n\t "] + [" ".join(r.choice(words) for _ in range(r.choice([1, 5, 40, 300]))) for _ in range(120)] + ["same text"] * 5
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, Start int").repartition(5)
    for windows in (1, 4):
        _check(packing.pack(docs, PATH, capacity=64, open_windows=windows).collect(), texts, 64)
    _check(packing.pack(docs, PATH).collect(), texts, 2048)


def test_an_empty_table_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "one two"), (None, "one two")], "doc_id long, text string")
    rows = packing.pack(docs, PATH).collect()
    assert sum(r.length for r in rows) == 6 and {r.doc_id for r in rows} == {None}
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_words_are_forgotten_without_a_trace(monkeypatch):
    monkeypatch.setattr(packing, "MOST_WORDS", 3)
    own = packing.WordIds(PATH, 1)
    for text in ("a b c d e", "d e f g", "", "a g"):
        ids, begin = own(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        assert ids.tolist() == _expected([text])[0].tolist() and begin.tolist() == [0, len(ids)]
