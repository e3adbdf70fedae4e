"""Tree reduction against encoding the whole text at once."""

import hashlib
import random

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from coverlens.llm import byte_bpe as B

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
encode = B._encoder(RANKS, P.PATTERN)
whole = B.encoding(RANKS, P.PATTERN).encode_ordinary


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab1'sre \n\t\r\x0b\x1c\x85 　.,é漢🙂")), max_size=80), st.integers(1, 9))
def test_any_tree_gives_the_ids_of_the_whole(text, leaf_chars):
    assert B.ids_of(B.element_of(text, encode, leaf_chars), encode).tolist() == whole(text)
    parts = [B.leaf(text[i : i + leaf_chars], encode) for i in range(0, len(text), leaf_chars)]
    assert B.ids_of(B.reduce_tree(parts, encode), encode).tolist() == whole(text)


def test_documents(spark):
    r = random.Random(5)
    long = " ".join(r.choice(["the", "of", "naïve", "12345", "don't", "…", "漢字"]) for _ in range(3000))
    texts = [None, "", " ", "a", "a", long, "x" * 4000, " " * 500 + "y", "don't\n\n  stop", long + long]
    docs = spark.createDataFrame([(i if i != 3 else None, t, "k", 1) for i, t in enumerate(texts)], "doc_id long, text string, TEXT2 string, n_tokens int")
    got = {(x.doc_id): x for x in B.encode_documents(docs, RANKS, P.PATTERN, piece_chars=1000).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        x = got[i if i != 3 else None]
        ids = whole(t or "")
        assert (x.n_tokens, x.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert x.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_ids_themselves_and_an_empty_table(spark):
    docs = spark.createDataFrame([(1, "one two  three")], "doc_id long, text string")
    (x,) = B.encode_documents(docs, RANKS, P.PATTERN, digest=False).collect()
    assert x.ids == whole("one two  three") and bytes(x.decoded) == b"one two  three"
    assert B.encode_documents(docs.limit(0), RANKS, P.PATTERN).count() == 0


@pytest.mark.parametrize("leaf_ids", [1, 2, 7, 4096])
def test_decode(leaf_ids):
    text = "Élan vital — 漢字 🙂\n" * 20
    ids = encode(text)
    assert B.decode(ids, B.vocabulary(RANKS, P.PATTERN), leaf_ids) == text.encode()
