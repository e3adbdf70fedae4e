"""Registered queries of this subpackage: ``QUERIES`` and, where SQL can express them, ``ORACLES``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coverlens.llm import ann, byte_bpe, debruijn_dedup, exact_dedup, fill_in_middle, license_scan, line_dedup, minhash, packing, quality_rules, secret_scan, spelling, suffix_dedup
from coverlens.llm.common import documents


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every web page's text without the boilerplate lines of its host."""
    return line_dedup.dedup_pages(spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose id 50 divides, against all."""
    return ann.search(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and the bytes they decode to, as digests."""
    return byte_bpe.encode_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and line whose canonical text is a known licence or notice."""
    return license_scan.scan(documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token of every document in one piece of one sequence of at most 2,048."""
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measurements, failure bits and verdict under the policy web-1."""
    return quality_rules.apply_policy(quality_rules.ledger(documents(spark, sf_dir)))


def quality_rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy web-1 rejects, rejects alone, and what would be kept without it."""
    return quality_rules.ablation(quality_rules.ledger(documents(spark, sf_dir)))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 50-byte strings that a smaller document has."""
    return suffix_dedup.deduplicate(documents(spark, sf_dir))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 50-word windows that a smaller document has."""
    return debruijn_dedup.deduplicate(documents(spark, sf_dir))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the fixed patterns and of the network in every document."""
    return secret_scan.scan_documents(documents(spark, sf_dir))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near duplicates: five-word runs, similarity of 0.8 or more."""
    return minhash.classes(documents(spark, sf_dir))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word with its commoner near word, the root that those lead to, and how many words are one edit away."""
    return spelling.variants(documents(spark, sf_dir))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's output with its parts in another order, and the text rebuilt from it, as digests."""
    return fill_in_middle.transform(documents(spark, sf_dir))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its equal texts."""
    return exact_dedup.groups(documents(spark, sf_dir))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    """``license_scan.canonical`` line by line: RE2 has no look-ahead, so what follows the word is taken off and looked at."""
    after = r"regexp_replace(regexp_extract(x, '^[ \t]*copyrights?([^a-z].*)$', 1), '^[ \t:,]+', '')"
    word = r"'^(notices?|holders?|owners?|laws?|licen[cs]es?|statements?|interests?|and|or|in|of|to|on|is|are|shall|may|must)([^a-z]|$)'"
    named = rf"""({after} <> '' AND NOT regexp_matches({after}, '^(\s|[.;)"''])') AND NOT regexp_matches({after}, {word}))"""
    lines = rf"list_transform(string_split(lower({text}), chr(10)), lambda x: CASE WHEN regexp_matches(x, '^[ \t]*(\(c\)|©|&copy;)') OR {named} THEN ' ' ELSE x END)"
    out = f"regexp_replace(' ' || regexp_replace(array_to_string({lines}, chr(10)), '[^a-z0-9]+', ' ', 'g') || ' ', ' +', ' ', 'g')"
    for old, new in license_scan.SPELLINGS:
        out = f"replace({out}, {_quoted(old)}, {_quoted(new)})"
    return out


def _license_sql() -> str:
    rows = ", ".join(f"({i}, {_quoted(spdx)}, {_quoted(text)})" for i, (spdx, text) in enumerate(license_scan.notices() + license_scan.whole_texts()))
    return f"""
WITH k AS (SELECT sha256({_canonical_sql("t")}) AS digest, arg_min(spdx, i) AS spdx FROM (VALUES {rows}) AS v(i, spdx, t) GROUP BY 1),
d AS (SELECT doc_id, text FROM documents WHERE text <> ''),
u AS (
  SELECT doc_id, 'text' AS unit, CAST(0 AS BIGINT) AS line, text AS t FROM d
  UNION ALL
  SELECT doc_id, 'line', CAST(n AS BIGINT), parts[n] FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM d)))
SELECT doc_id, unit, line, k.spdx, digest FROM (SELECT doc_id, unit, line, sha256({_canonical_sql("t")}) AS digest FROM u) JOIN k USING (digest)
"""


def _line_dedup_sql() -> str:
    text = f"regexp_replace(regexp_replace(regexp_replace(html, {_quoted(line_dedup._UNSEEN)}, ' ', 'g'), {_quoted(line_dedup._BLOCK)}, chr(10), 'g'), {_quoted(line_dedup._TAG)}, '', 'g')"
    for name, char in line_dedup._ENTITIES:
        text = f"replace({text}, {_quoted(name)}, {_quoted(char)})"
    bare = "trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    return rf"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]+)', 1)), '') AS host, {text} AS t
  FROM pages),
u AS (SELECT r, page_id, host, unnest(range(1, len(l) + 1)) AS n, unnest(l) AS x FROM (SELECT *, string_split(t, chr(10)) AS l FROM p)),
v AS (SELECT *, {bare} AS bare FROM u),
total AS (SELECT host, count(DISTINCT r) AS total FROM v WHERE host IS NOT NULL GROUP BY host),
often AS (
  SELECT host, bare FROM (SELECT host, bare, count(DISTINCT r) AS n FROM v WHERE bare <> '' AND host IS NOT NULL GROUP BY host, bare) JOIN total USING (host)
  WHERE n > 1 AND n > total * CAST({line_dedup.RATIO} AS DOUBLE)),
m AS (SELECT v.*, o.bare IS NOT NULL AS gone FROM v LEFT JOIN often o USING (host, bare))
SELECT page_id, host, coalesce(string_agg(x, chr(10) ORDER BY n) FILTER (NOT gone), '') AS text,
       count(*) FILTER (bare <> '') AS n_lines, count(*) FILTER (gone) AS n_dropped
FROM m GROUP BY r, page_id, host
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_license_scans": op4_license_scans,
    "op5_packing": op5_packing,
    "op6_quality_rules": op6_quality_rules,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_secret_scans": op9_secret_scans,
    "op10_minhash": op10_minhash,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_exact_dedup": op13_exact_dedup,
    "quality_rule_ablation": quality_rule_ablation,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": _line_dedup_sql(),
    "op4_license_scans": _license_sql(),
    "op6_quality_rules": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w,
         [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
  FROM documents),
g AS (SELECT r, i, array_to_string(w[i:i+7], ' ') AS win FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM g) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest(range(8)) AS j) GROUP BY r),
m AS (
  SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
         length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS n_upper, length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS n_letters
  FROM d LEFT JOIN covered c USING (r)),
f AS (
  SELECT *, CAST(CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
         + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 5 * n_lines THEN 8 ELSE 0 END
         + CASE WHEN 10 * n_upper > 5 * n_letters THEN 16 ELSE 0 END
         + CASE WHEN word_chars < 2 * n_words OR word_chars > 40 * n_words THEN 32 ELSE 0 END
         + CASE WHEN 10 * n_letters < 4 * word_chars THEN 64 ELSE 0 END AS BIGINT) AS fail_bits
  FROM m)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, fail_bits = 0 AS kept, 'web-1' AS policy FROM f
""",
    "op11_spelling_variants": r"""
WITH RECURSIVE bits AS (
  SELECT i, list_reduce([i::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT],
         lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c
  FROM range(256) AS r(i)),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits),
runs AS (
  SELECT doc_id, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]{7,}')) AS x FROM documents)),
seen AS (SELECT run, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(strlen(s)), lambda i: ('0x' || substr(hex(s), 2 * i::BIGINT + 1, 2))::UBIGINT)),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) AS h
  FROM seen, tab),
noisy AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM noisy WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
v AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS d FROM (SELECT word, unnest(range(length(word))) AS i FROM w)),
near AS (
  SELECT v.word, w.word AS other FROM v JOIN w ON w.word = v.d
  UNION SELECT w.word, v.word FROM v JOIN w ON w.word = v.d
  UNION SELECT a.word, b.word FROM v AS a JOIN v AS b ON a.i = b.i AND a.d = b.d AND a.word <> b.word),
best AS (
  SELECT near.word, count(*) AS n_near, max(w.n) AS most, arg_min(near.other, struct_pack(a := -w.n, b := encode(near.other))) AS other
  FROM near JOIN w ON w.word = near.other GROUP BY near.word),
form AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * w.n THEN other END AS form, CASE WHEN most >= 10 * w.n THEN most END AS form_n FROM w LEFT JOIN best USING (word)),
walk AS (
  SELECT word, word AS root FROM form
  UNION ALL SELECT walk.word, form.form FROM walk JOIN form ON form.word = walk.root WHERE form.form IS NOT NULL),
steps AS (SELECT walk.word, root FROM walk JOIN form ON form.word = walk.root WHERE form.form IS NULL)
SELECT form.word, form, root, n, n_near, form_n FROM form JOIN steps USING (word)
""",
    "op12_fill_in_middle": """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (
  SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
  FROM t),
c AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
p AS (SELECT *, substr(t, 1, a) AS x, substr(t, a + 1, b - a) AS y, substr(t, b + 1) AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
       sha256(CASE WHEN form = 'plain' THEN t ELSE x || y || z END) AS restored_sha256
FROM p
""",
    "op13_exact_dedup": """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM d
""",
}

_RULES = ", ".join(f"('{r}', {quality_rules.BITS[r]})" for r in quality_rules.POLICIES["web-1"])
ORACLES["quality_rule_ablation"] = f"""
SELECT rule, CAST(count_if(fail_bits & bit <> 0) AS BIGINT) AS n_failed, CAST(count_if(fail_bits = bit) AS BIGINT) AS n_failed_alone,
  CAST(count_if(fail_bits = 0 OR fail_bits = bit) AS BIGINT) AS n_kept_without
FROM ({ORACLES["op6_quality_rules"]}), (VALUES {_RULES}) AS r(rule, bit) GROUP BY rule
"""
