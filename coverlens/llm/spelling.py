"""Spelling variants: pairs of words at edit distance one, by pivotal grams.

Words come from every whole text (``noisy_words``, native: a regular expression, an
explode, counts with map-side combine).  Pairs come from the pivotal-prefix filter
for one edit and grams of two code points:

- Grams are ordered by how many words hold them, rarest first, and a word's
  occurrences by gram, then position.  The first three always hold two that are
  disjoint, and one edit leaves one of those whole.
- Its *pivots* are the two disjoint ones of these three with the least total
  frequency, found by dynamic programming over positions.
- Its *prefix* is these three and, of the third one's gram, the first five
  occurrences: one edit adds at most two before one that is among the other word's
  first three.  So a word has at most seven, however long and repetitive it is.
- If two words are one edit apart, the word whose prefix ends at the rarer gram has
  a pivot that the edit leaves whole, and that gram stands in the other word's
  prefix.  So pivots are looked up in the prefixes of the other words alone.

Position limits make the lookup narrow: an edit right of the left pivot leaves all
up to that pivot's end as it is, and any other edit leaves all from the right
pivot's start.  The other side of the pivot has one edit in it, and half of that
side is as it was: its first half up to the same position, or its last half up to
the same distance from the end.  A key is therefore (side, everything on the whole
side with the gram, length of the other side, which half, that half), hashed to 64
bits.  Each word sends 12 keys for its two pivots (three lengths, two halves) and
four for each occurrence of its prefix.  Spark joins the keys; every candidate is
verified by its edit distance, so hash clashes cost work only.  No pair is lost,
none is capped.

Bounds: the alphabet has 90 letters, so there are at most 8,100 grams; their
frequencies are collected and go to every executor.  Hot words are counted before
they are shuffled; a join partition that is much larger than others is split by
AQE.

Defined cases: a null text has no words; a null doc_id draws from `:run`.  Repeated
rows count as often as they occur.  Equal frequencies of grams are ordered by the
gram, equal costs of pivots by position.  An empty table, or one without words,
gives an empty result.  Other columns, also those whose names differ in case alone,
do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverlens.llm.common import pick, written

LETTERS = r"A-Za-zÀ-ÿ"
#: Least code points and occurrences of a word; one in ``NOISE`` distinct (document, run) pairs loses a code point; how much commoner a form is.
LEAST_LENGTH, LEAST_COUNT, NOISE, COMMONER = 7, 2, 31, 10
_EDITS, _GRAM = 1, 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def noisy_words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, some with one code point deleted as a hash of document and run says."""
    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").cast("string").alias("doc"), F.col("text").cast("string").alias("text"))
    runs = F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least_length},}}+"), F.lit(0))
    d = d.select(F.coalesce("doc", F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    d = d.select("doc", F.translate("run", _UPPER, _LOWER).alias("run"))
    d = d.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run")))
    cut = F.expr("concat(left(run, cast(h % length(run) as int)), substr(run, cast(h % length(run) as int) + 2))")
    word = F.when(F.col("h") % NOISE == 0, cut).otherwise(F.col("run"))
    w = d.select(word.alias("word")).where(F.length("word") >= least_length)
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def gram_frequencies(words: DataFrame) -> dict[str, int]:
    """How many occurrences each gram has over the words; at most 90 * 90 grams."""
    grams = F.expr(f"transform(sequence(1, length(word) - {_GRAM - 1}), i -> substr(word, i, {_GRAM}))")
    rows = words.where(F.length("word") >= _GRAM).select(F.explode(grams).alias("gram")).groupBy("gram").count().collect()
    return {r["gram"]: r["count"] for r in rows}


def choose(rank: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words of one length: the rank of the third occurrence, which occurrences the prefix has, and the pivots' positions.

    ``rank`` and ``cost`` have a row for each word and a column for each gram
    occurrence.  best[k] is the least cost of k disjoint occurrences among those
    seen so far; an occurrence disjoint from the one at j ends at j - 2 or before.
    """
    rows, width = rank.shape
    order = rank * width + np.arange(width)
    third = np.partition(order, _EDITS * _GRAM, axis=1)[:, _EDITS * _GRAM]
    first, last = order <= third[:, None], third // width
    tied = rank == last[:, None]
    inside = first | tied & (np.cumsum(tied, axis=1) <= _EDITS * _GRAM + 1 + _GRAM * _EDITS)
    far = np.iinfo(np.int64).max // 4
    best = np.full((_EDITS + 2, width + _GRAM, rows), far, np.int64)  # best[k, j + _GRAM]: among occurrences 0..j
    best[0] = 0
    took = np.zeros((_EDITS + 2, width + _GRAM, rows), np.int64)  # where the last of them stands
    for j in range(width):
        here = np.where(first[:, j], cost[:, j], far)
        for k in range(1, _EDITS + 2):
            new = here + best[k - 1, j]  # among 0..j - _GRAM
            better = new < best[k, j + _GRAM - 1]
            best[k, j + _GRAM] = np.where(better, np.minimum(new, far), best[k, j + _GRAM - 1])
            took[k, j + _GRAM] = np.where(better, j, took[k, j + _GRAM - 1])
    pivots = np.zeros((rows, _EDITS + 1), np.int64)
    at = np.full(rows, width - 1)
    for k in range(_EDITS + 1, 0, -1):
        pivots[:, k - 1] = took[k, at + _GRAM, np.arange(rows)]
        at = pivots[:, k - 1] - _GRAM
    return last, inside, pivots


def signatures(words: DataFrame) -> DataFrame:
    """(word, n, last, pivots, prefix): the rank at which a word's prefix ends, its two pivots' positions, its prefix's positions.

    ``words`` has distinct words of at least four code points, all in U+0000 to U+00FF.
    """
    count = gram_frequencies(words)
    order = sorted(count, key=lambda g: (count[g], g))
    held = words.sparkSession.sparkContext.broadcast([(ord(g[0]) << 8 | ord(g[1]), count[g]) for g in order])
    types = pa.schema([("word", pa.string()), ("n", pa.int64()), ("last", pa.int32()), ("pivots", pa.list_(pa.int32())), ("prefix", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, costs = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        for i, (gram, n) in enumerate(held.value):
            ranks[gram], costs[gram] = i, n
        for batch in batches:
            text = np.array(batch.column(0).to_pylist(), object)
            lengths = np.array([len(x) for x in text], np.int64)
            for length in np.unique(lengths):
                some = np.flatnonzero(lengths == length)
                letters = np.frombuffer("".join(text[some]).encode("latin-1"), np.uint8).reshape(len(some), length).astype(np.int64)
                gram = letters[:, :-1] << 8 | letters[:, 1:]
                last, inside, pivots = choose(ranks[gram], costs[gram])
                where = np.nonzero(inside)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(inside.sum(axis=1))]), pa.int32()), pa.array(where[1], pa.int32()))
                pairs = pa.ListArray.from_arrays(pa.array(np.arange(0, pivots.size + 1, _EDITS + 1), pa.int32()), pa.array(pivots.ravel(), pa.int32()))
                picked = pa.array(some)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(picked), batch.column(1).take(picked), pa.array(last, pa.int32()), pairs, lists], schema=types)

    return words.select("word", "n").mapInArrow(run, "word string, n long, last int, pivots array<int>, prefix array<int>")


def _key(side: str, whole: str, length: str, half: int, part: str) -> str:
    return f"xxhash64('{side}', {whole}, {length}, {half}, {part})"


def _pivot_keys() -> Column:
    """Keys of the two pivots; ``m`` is how long the other side of the other word may be."""
    sides = {
        "L": ("substr(word, 1, pivots[0] + 2)", "substr(word, pivots[0] + 3)"),
        "R": ("substr(word, pivots[1] + 1)", "left(word, pivots[1])"),
    }
    keys = []
    for side, (whole, rest) in sides.items():
        for more in (-1, 0, 1):
            m = f"(length({rest}) + {more})"
            # an edit in the last half leaves the first m div 2 code points, one in the first half the others
            keys.append(f"if({m} >= 0, {_key(side, whole, m, 0, f'left({rest}, {m} div 2)')}, null)")
            keys.append(f"if({m} >= 0, {_key(side, whole, m, 1, f'right({rest}, {m} - {m} div 2)')}, null)")
    return F.expr(f"explode(array_distinct(filter(array({', '.join(keys)}), k -> k is not null)))")


def _prefix_keys() -> Column:
    sides = {
        "L": ("substr(word, 1, p + 2)", "substr(word, p + 3)"),
        "R": ("substr(word, p + 1)", "left(word, p)"),
    }
    keys = []
    for side, (whole, rest) in sides.items():
        m = f"length({rest})"
        keys += [_key(side, whole, m, 0, f"left({rest}, {m} div 2)"), _key(side, whole, m, 1, f"right({rest}, {m} - {m} div 2)")]
    return F.expr(f"explode(array_distinct(flatten(transform(prefix, p -> array({', '.join(keys)})))))")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): every ordered pair of words at edit distance one.  ``words`` has distinct (word, n), and is read more than once."""
    s = written(signatures(words), "signatures")
    a = s.select(_pivot_keys().alias("key"), "word", "n", "last")
    b = s.select(_prefix_keys().alias("key"), F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("last").alias("other_last"))
    near = "last <= other_last and word <> other and abs(length(word) - length(other)) <= 1 and levenshtein(word, other, 1) = 1"
    found = a.join(b, "key").where(near).select("word", "n", "other", "other_n")
    both = F.explode(F.array(F.struct("word", "n", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))))
    return found.select(both.alias("p")).select("p.*").distinct()


def groups(words: DataFrame) -> DataFrame:
    """One row per word: n, its form, the root that forms lead to, how many words are near it, its form's n."""
    words = written(words, "words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("word")))
    near = near_pairs(words).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    near = near.withColumn("is_form", -F.col("best.less") >= COMMONER * F.col("n"))
    near = written(
        near.select("word", "n_near", F.expr("if(is_form, best.word, null)").alias("form"), F.expr("if(is_form, -best.less, null)").alias("form_n")), "near"
    )
    out = words.join(near, "word", "left")
    links = near.where("form is not null").select("word", F.col("form").alias("root"))
    return out.join(_roots(links, words), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def _roots(links: DataFrame, words: DataFrame) -> DataFrame:
    """(word, root): each link followed to the last word.

    A form is ``COMMONER`` times as common, so a chain has at most log(largest n)
    links; every round halves the chains.
    """
    most, steps = words.agg(F.max("n")).first()[0] or 1, 1
    while most >= COMMONER * LEAST_COUNT:
        most, steps = most // COMMONER, steps + 1
    while steps > 1:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = written(links.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
        steps = -(-steps // 2)
    return links


def variants(docs: DataFrame) -> DataFrame:
    """Every word of ``docs`` with its form and root."""
    return groups(noisy_words(docs))
