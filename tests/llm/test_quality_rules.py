"""Measurements against plain Python, policies and ablations against the bits."""

import random
import re

from pyspark.sql import functions as F

from coverlens.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    windows = {}
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def texts():
    r = random.Random(7)
    out = [None, "", " \n\t\x0b", "word", "a " * 7, "a " * 8, "a " * 9, "x\n" * 30, "😀 é # $ %\r\n😀 é # $ %\r\n", "one\x0btwo\x0cthree\xa0four\x1cfive"]
    for _ in range(60):
        w = [r.choice(["the", "of", "naïve", "漢字", "###", "a|b"]) + str(r.randrange(40)) for _ in range(r.randrange(1, 120))]
        at = r.randrange(len(w))
        out.append(r.choice([" ", "\n", "  "]).join(w + w[at : at + r.randrange(20)]))
    return out


def test_measurements(spark):
    rows = [(i, t, 5) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows + [rows[20]], "doc_id long, text string, N_WORDS int")
    got = Q.apply_policy(Q.ledger(docs)).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        n = plain(rows[r.doc_id][1])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0])
        assert r.kept == (r.fail_bits == 0) and (r.kept or True) and not (r.kept and r.base_failed)


def test_filter_keeps_rows_whole(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts())], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in Q.apply_policy(Q.ledger(docs)).where("kept").collect()}
    rows = Q.filter_documents(docs).collect()
    assert {r.doc_id for r in rows} == kept and kept and all(r.text == texts()[r.doc_id] and r.lang == "x" for r in rows)


def test_ablation(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    book = Q.ledger(docs).cache()
    mask = Q.mask("web-1")
    bits = [r.fail_bits & mask for r in book.select("fail_bits").collect()]
    for r in Q.ablation(book).collect():
        bit = Q.BITS[r.rule]
        assert (r.n_failed, r.n_failed_alone) == (sum(b & bit != 0 for b in bits), sum(b == bit for b in bits))
        assert r.n_kept_without == sum(b & ~bit == 0 for b in bits)
    book.unpersist()


def test_labelled_documents(spark):
    """Of the labelled documents the good ones stay and most of the bad ones go."""
    sf = "/root/testdata/sf0.01"
    book = Q.apply_policy(Q.ledger(spark.read.parquet(f"{sf}/documents.parquet")))
    both = book.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("n_words >= 20")
    rate = {r.quality: r.kept for r in both.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert rate[1] >= 0.99 and rate[0] <= 0.2


def test_empty_table_and_native_plan(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert Q.ledger(docs.limit(0)).count() == 0
    plan = Q.apply_policy(Q.ledger(docs))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
