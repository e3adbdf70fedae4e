"""Quality rules as a bitmask ledger (native expressions only).

Every rule is evaluated once for each document; the ledger keeps its
measurements and one long whose bit r says that rule r failed.  A policy is a
named, versioned set of rules, so to keep or reject under it is one bitwise
AND, and the ablation of a policy (what each rule rejects, alone or with
others) comes from counting distinct bitmasks, never from the texts again.

Defined cases: a null text has no words and fails ``few_words``; equal rows are
judged each for itself; further columns of the input are ignored; an empty
table gives an empty ledger.  No column but ``text`` affects the verdict.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverlens.llm.common import BLANK, pick

#: Rules in bit order; a rule never changes its bit.  Ratios are compared as integers.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "repeated_lines": "10 * n_dup_lines > 5 * n_lines",
    "upper_case": "10 * n_upper > 5 * n_letters",
    "word_length": "word_chars < 2 * n_words OR word_chars > 40 * n_words",
    "few_letters": "10 * n_letters < 4 * word_chars",
}
#: Versioned policies: the rules that reject a document.
POLICIES: dict[str, Sequence[str]] = {
    "base-1": ("few_words", "repeated_windows"),
    "web-1": ("few_words", "repeated_windows", "symbols", "repeated_lines", "upper_case", "word_length", "few_letters"),
}
BITS = {rule: 1 << i for i, rule in enumerate(RULES)}
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters")


def mask(policy: str) -> int:
    return sum(BITS[r] for r in POLICIES[policy])


def _pairs(hashes: str, step: int) -> Column:
    """Hash of each element with the one ``step`` further: doubles the width that a hash covers."""
    h = F.col(hashes)
    return F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step)))


def _same_as_neighbour(s: Column, x: Column, i: Column) -> Column:
    return F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False))


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id`` and MEASURES, from one scan without an exchange."""
    d = pick(docs, "doc_id", "text")
    return _measured(d.select("doc_id", F.col("text").alias("t")), "doc_id")


def _measured(d: DataFrame, *carried: str) -> DataFrame:
    """MEASURES of column ``t`` beside the columns ``carried``.

    The 8-word windows get a 64-bit hash by doubling (pairs, fours, eights);
    only texts in which a hash occurs twice have their windows sorted.
    """
    t = F.col("t")
    d = d.select(*carried, F.coalesce(t.cast("string"), F.lit("")).alias("t"))
    d = d.select(
        *carried,
        "t",
        F.array_remove(F.split(t, BLANK), "").alias("words"),
        F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0).alias("lines"),
    )
    d = d.select(
        *carried,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace(t, r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h1"),
    )
    for width in (1, 2, 4):
        d = d.withColumn(f"h{2 * width}", _pairs(f"h{width}", width)).drop(f"h{width}")
    d = d.withColumn("h8", F.expr(f"IF(n_words < {WINDOW}, array(), slice(h8, 1, CAST(n_words AS INT) - {WINDOW - 1}))"))
    some = F.size(F.array_distinct("h8")) < F.size("h8")
    d = d.withColumn("s", F.when(some, F.sort_array(F.transform("h8", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))).drop("h8")
    s = F.col("s")
    d = d.withColumn("at", F.array_sort(F.transform(F.filter(s, lambda x, i: _same_as_neighbour(s, x, i)), lambda x: x["i"]))).drop("s")
    at = F.col("at")
    gaps = F.transform(at, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW))).cast("long"))
    return d.withColumn("n_repeat_words", F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))).select(*carried, *MEASURES)


def _with_bits(measured: DataFrame, *carried: str) -> DataFrame:
    """``fail_bits`` beside the measurements.

    They pass through a generator of one row: else the optimizer would move a
    filter on them below the measuring steps and repeat those in it.
    """
    bits = [F.when(F.expr(rule), F.lit(BITS[name])).otherwise(F.lit(0)).cast("long") for name, rule in RULES.items()]
    book = measured.select(*carried, F.explode(F.array(F.struct(*MEASURES, reduce(lambda a, b: a.bitwiseOR(b), bits).alias("fail_bits")))).alias("m"))
    return book.select(*carried, "m.*")


def ledger(docs: DataFrame) -> DataFrame:
    """``measure`` with ``fail_bits``: bit r is set where rule r of RULES fails."""
    return _with_bits(measure(docs), "doc_id")


def filter_documents(docs: DataFrame, policy: str = "web-1") -> DataFrame:
    """The rows of ``docs`` that ``policy`` keeps, with all columns, from one scan."""
    names = docs.columns
    at = names.index("text") if "text" in names else [n.lower() for n in names].index("text")
    carried = [f"c{i}" for i in range(len(names))]
    plain = docs.toDF(*carried)
    book = _with_bits(_measured(plain.withColumn("t", F.col(f"c{at}")), *carried), *carried)
    return apply_policy(book, policy).where("kept").select(*(F.col(c).alias(n) for c, n in zip(carried, names)))


def apply_policy(book: DataFrame, policy: str = "web-1", base: str = "base-1") -> DataFrame:
    """The ledger with ``base_failed``, ``kept`` and the policy's name."""
    base_failed = F.col("fail_bits").bitwiseAND(F.lit(mask(base)).cast("long")) != 0
    failed = F.col("fail_bits").bitwiseAND(F.lit(mask(policy) | mask(base)).cast("long")) != 0
    return book.withColumn("base_failed", base_failed).withColumn("kept", ~failed).withColumn("policy", F.lit(policy))


def ablation(book: DataFrame, policy: str = "web-1") -> DataFrame:
    """One row for each rule of ``policy``: documents that fail it, that fail no other rule of the policy, and that the policy keeps without it.

    The documents are counted by bitmask first (at most two to the number of
    rules), so the rules are weighed on that small table.
    """
    whole = mask(policy)
    by_mask = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(whole).cast("long")).alias("m")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BITS[r]).cast("long").alias("bit")) for r in POLICIES[policy]))
    each = by_mask.withColumn("r", F.explode(rules)).select("m", "n", "r.rule", "r.bit")
    count = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
    m, bit = F.col("m"), F.col("bit")
    return each.groupBy("rule").agg(
        count(m.bitwiseAND(bit) != 0).alias("n_failed"),
        count(m == bit).alias("n_failed_alone"),
        count(m.bitwiseAND(F.lit(whole).cast("long").bitwiseXOR(bit)) == 0).alias("n_kept_without"),
    )
