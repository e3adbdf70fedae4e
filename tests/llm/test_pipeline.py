"""Every stage against what it must do to its own input."""

import re

import corpus_pipeline as C
from coverlens.llm import line_dedup, quality_rules
from coverlens.llm.common import documents, written
from tests.llm.test_minhash import brute
from tests.llm.test_packing import _expected

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = documents(spark, SF)
    tables = [docs]
    for name, stage in C.STAGES:
        tables.append(written(stage(spark, tables[-1], SF), f"test-{name}"))
    assert all(t.columns == docs.columns for t in tables[:-1])
    raw, kept, lines, distinct, clean = ({r.doc_id: r for r in t.collect()} for t in tables[:-1])
    verdict = {r.doc_id: r.kept for r in quality_rules.apply_policy(quality_rules.ledger(docs)).collect()}
    assert set(kept) == {k for k, v in verdict.items() if v} and all(kept[k].text == raw[k].text for k in kept)
    assert set(lines) == set(kept)
    host_lines = {}
    for r in kept.values():
        host_lines.setdefault(r.source, []).append(frozenset(x.strip(" \t\n\x0b\x0c\r") for x in r.text.split("\n")) - {""})
    for k, r in lines.items():
        pages = host_lines[r.source]
        often = lambda x: (n := sum(x.strip(" \t\n\x0b\x0c\r") in p for p in pages)) > 1 and n > line_dedup.RATIO * len(pages)  # noqa: E731, B023
        assert r.text == "\n".join(x for x in kept[k].text.split("\n") if not often(x)) and r.n_chars == len(r.text)
    ids = sorted(lines)
    classes = brute([lines[k].text for k in ids])
    assert set(distinct) == {ids[c] for c in set(classes)}
    assert set(clean) == set(distinct)
    for k, r in clean.items():
        assert not re.search(r"[0-9a-f]{24,}|AKIA[A-Z0-9]{16,}", r.text)
        if "[SECRET]" not in r.text:
            assert r.text == distinct[k].text
    pieces = {}
    for r in tables[-1].collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    order = sorted(clean)
    for k, want in zip(order, _expected([clean[k].text for k in order])):
        assert sum(n for _, n, _ in pieces[k]) == len(want) == pieces[k][0][2]
    assert set(pieces) == set(clean)


def test_run(spark):
    rows = C.run(spark, SF)
    assert rows.columns[:3] == ["doc_id", "start", "length"] and rows.count() > 0 and C.ORACLE_SQL is None
