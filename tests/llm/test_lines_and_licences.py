"""Boilerplate lines and licence notices against plain Python, and the registered SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from coverlens.llm import license_scan, line_dedup
from coverlens.llm.queries import ORACLES, QUERIES
from coverlens.sources.tables import TABLES
from tests.test_entry import _digest

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", ["op1_line_dedup", "op4_license_scans", "op6_quality_rules", "op11_spelling_variants", "op12_fill_in_middle", "op13_exact_dedup", "quality_rule_ablation"])
def test_registered_sql(spark, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[key](spark, SF)
    cur = con.execute(ORACLES[key])
    assert _digest(df.columns, [tuple(r) for r in df.collect()]) == _digest([d[0] for d in cur.description], cur.fetchall())


def test_lines(spark):
    rows = [(i, "h", f"own {i}\n footer \n\nown {i}") for i in range(20)]
    rows += [(100 + i, "h", "copied text\nall of it") for i in range(50)]  # every copy is a page
    rows += [(200, None, "footer"), (201, "h", None), (202, "h", ""), (203, "small", "footer\nx"), (204, "small", "footer\ny"), (205, "one", "a\nb")]
    rows += [(300 + i, "shell", "consent" if i < 60 else f"page {i}\n" + ("rare" if i < 70 else "")) for i in range(100)]  # on 60, and on 10, of 100
    rows += [(500, "long", "line\n" * 200_000 + "end"), (501, "long", "line"), (502, "long", "end\u2003")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, host string, text string, LINES int")
    got = {r.page_id: r for r in line_dedup.drop_lines(df, F.col("host"), counts=True).collect()}
    assert got[3].text == "own 3\n\nown 3" and (got[3].n_lines, got[3].n_dropped) == (3, 1) and got[3].LINES == 1
    assert got[100].text == "" and got[100].n_dropped == 2
    assert got[200].text == "footer" and got[201].text is None and got[202].text == "" and got[203].text == "x" and got[205].text == "a\nb"
    assert got[310].text == "" and got[365].text == "page 65\nrare"
    assert got[500].text == "end" and got[500].n_dropped == 200_000 and got[501].text == "" and got[502].text == "end\u2003"
    assert len(got) == len(rows) and line_dedup.drop_lines(df.limit(0), F.col("host")).count() == 0


def test_pages(spark):
    html = "<html><head><style>p{}</style><script>var a='<p>no</p>'</script></head><body><nav><ul><li>Home</li></ul></nav><p>Text %d &amp; more</p></body></html>"
    rows = [(i, f"https://Site.example:80/{i}", html % i) for i in range(10)] + [(50, "no address", html % 50), (51, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in line_dedup.dedup_pages(df).collect()}
    assert got[4].host == "site.example" and got[4].text.split() == "Text 4 & more".split() and got[4].n_dropped == 1
    assert got[50].host is None and "Home" in got[50].text and got[51].text is None and got[51].n_lines == 0


def test_licences(spark):
    mit = license_scan.TEXTS["MIT"]
    rows = [
        (1, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(". ", ".\n")), (2, mit.replace("warranty", "guarantee").replace("WARRANTY", "GUARANTEE")),
        (3, "text\nReleased under the MIT Licence!\nmore"), (4, "Licensed under GNU GPL v3"), (5, None), (6, ""), (7, "SPDX-License-Identifier: Apache-2.0\nSPDX-License-Identifier: Apache-2.0"),
        (8, "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International Licence."), (None, "MIT"), (None, "MIT"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, Digest int").repartition(3)
    got = sorted(((r.doc_id or 0), r.unit, r.line, r.spdx) for r in license_scan.scan(df).collect())
    assert got == sorted([
        (1, "text", 0, "MIT"), (3, "line", 2, "MIT"), (4, "text", 0, "GPL-3.0"), (4, "line", 1, "GPL-3.0"), (7, "line", 1, "Apache-2.0"), (7, "line", 2, "Apache-2.0"),
        (8, "text", 0, "CC-BY-NC-4.0"), (8, "line", 1, "CC-BY-NC-4.0"), *[(0, "text", 0, "MIT"), (0, "line", 1, "MIT")] * 2,
    ])
    assert license_scan.scan(df.limit(0)).count() == 0


def test_whole_texts_with_titles_and_wrapped_lines(spark):
    isc, mit = license_scan.TEXTS["ISC"], license_scan.TEXTS["MIT"]
    bsd = license_scan.MORE_TEXTS["BSD-3-Clause"][0]
    rows = [
        (1, "MIT License\n\nCopyright (c) 2020 Someone\n\n" + mit, "MIT"),
        (2, "Copyright 2020 Someone\n" + isc.replace(" copyright notice", "\ncopyright notice"), "ISC"),
        (3, "copyright Someone Else\n" + mit.replace(" COPYRIGHT HOLDERS", "\nCOPYRIGHT HOLDERS"), "MIT"),
        (4, "BSD 3-Clause License\n\nCopyright (c) 2020, Someone\nAll rights reserved.\n\n" + bsd.replace(" copyright holder", "\ncopyright holder").replace("COPYRIGHT HOLDER ", "\nCOPYRIGHT HOLDER\n"), "BSD-3-Clause"),
        (5, license_scan.MORE_TEXTS["BSD-2-Clause"][3].replace("* ", "\n- "), "BSD-2-Clause"),
        (6, "Boost Software License - Version 1.0 - August 17th, 2003\n" + license_scan.MORE_TEXTS["BSL-1.0"][0], "BSL-1.0"),
        (7, license_scan.MORE_TEXTS["MIT-0"][0].replace(". ", ".\n"), "MIT-0"),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id: r.spdx for r in license_scan.scan(df).where("unit = 'text'").collect()}
    assert got == {i: spdx for i, _, spdx in rows}


def test_registered_sql_on_whole_licences(spark):
    own = license_scan.whole_texts()
    rows = [(i, f"Copyright (c) 20{i:02d} Some Holder\n{text}".replace(". ", ".\n")) for i, (_, text) in enumerate(own)]
    lines = [
        "Copyright 2020 Someone", "copyright notice and this permission notice appear in all copies.", "(c) 2001", "© Holder", "  Copyrights: A. Name", "copyright", "Copyright:", "copyrighted work",
        "Copyright, the authors", "copyright holders", "copyright holdersx", 'copyright "Name"', "Copyright. All", "copyright\tNotice", "&copy; x", "x copyright y", "Copyright\u2003Name",
    ]
    mit = license_scan.TEXTS["MIT"]
    rows += [(1_000 + i, f"{line}\n{mit}") for i, line in enumerate(lines)] + [(2_000, mit.replace("Software", "Softwares")), (2_001, "MIT"), (2_002, None), (2_003, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    cur = con.execute(ORACLES["op4_license_scans"])
    want = _digest([d[0] for d in cur.description], found := cur.fetchall())
    got = license_scan.scan(docs)
    assert _digest(got.columns, [tuple(r) for r in got.collect()]) == want
    assert {r[0] for r in found if r[1] == "text"} >= set(range(len(own))) | {1_000, 1_002, 1_003, 1_004}
