"""G1-G7, G15 — unbiased pass@k over graded generations.

Plan shape (per evaluation key such as ``run, split``):

1. ``first_n_cutoff``: ``row_number() <= cutoff`` per question; Catalyst turns
   the filter into a partial *WindowGroupLimit* before the exchange, so a hot
   question ships at most ``cutoff`` rows per map task.
2. ``correct_counts``: one partial+final hash aggregate to ``(n, c)``.
3. ``k_grid``: per key ``k = 1..min(2000, min n)`` (tiny).
4. The estimator runs once per distinct ``(n, c, k)`` — at most
   cutoff^2/2 x cutoff rows per key, independent of the number of
   questions — and the mean over questions is a weighted average over the
   ``(n, c)`` histogram.

Nothing here collects per-question data to the driver or into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coverlens.operators.ranking import rank_within

K_CAP = 2000
DEFAULT_CUTOFF = 256


def estimate_pass_at_k(n: Column, c: Column, k: Column) -> Column:
    """``1 - comb(n-c, k) / comb(n, k)`` as ``1 - prod_{i=n-c+1..n} (1 - k/i)``.

    1.0 when ``n - c < k``; 0.0 when ``c = 0`` (``sequence`` would count down).
    """
    kd = k.cast("double")
    prod = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda acc, i: acc * (F.lit(1.0) - kd / i.cast("double")))
    return F.when(n - c < k, F.lit(1.0)).when(c == 0, F.lit(0.0)).otherwise(F.lit(1.0) - prod)


def first_n_cutoff(graded: DataFrame, keys: Sequence[str], order_col: str, cutoff: int = DEFAULT_CUTOFF) -> DataFrame:
    """Keep the first ``cutoff`` samples of every ``keys`` group by ``order_col``."""
    w = Window.partitionBy(*keys).orderBy(F.col(order_col))
    return graded.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= cutoff).drop("__rn")


def correct_counts(graded: DataFrame, keys: Sequence[str], correct_col: str = "is_correct") -> DataFrame:
    """G1: per group ``n`` samples and ``c`` correct ones."""
    return graded.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(correct_col)).alias("c")
    )


def k_grid(counts: DataFrame, run_keys: Sequence[str], k_cap: int = K_CAP) -> DataFrame:
    """``k = 1..min(k_cap, min n)`` for every ``run_keys`` value."""
    mins = counts.groupBy(*run_keys).agg(F.min("n").alias("__min_n"))
    return mins.select(*run_keys, F.explode(F.sequence(F.lit(1), F.least(F.lit(k_cap), F.col("__min_n")).cast("int"))).alias("k"))


def with_k_grid(df: DataFrame, mins: DataFrame, run_keys: Sequence[str], k_cap: int = K_CAP) -> DataFrame:
    """Attach ``k = 1..min(k_cap, min n)`` to every row: an equi-join with the
    one-row-per-run minimum table (AQE broadcasts it after a size check),
    then an explode inside each row.  No cross join."""
    if run_keys:
        joined = df.join(mins, list(run_keys), "inner")
    else:
        joined = df.withColumn("__min_n", mins.select("__min_n").scalar())  # scalar sub-query, no join
    return joined.withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.lit(k_cap), F.col("__min_n")).cast("int")))).drop("__min_n")


def pass_at_k_detail(counts: DataFrame, question_keys: Sequence[str], run_keys: Sequence[str], k_cap: int = K_CAP) -> DataFrame:
    """G4 per question: ``(run_keys, question_keys, k, pass_at_k)``."""
    mins = counts.groupBy(*run_keys).agg(F.min("n").alias("__min_n"))
    joined = with_k_grid(counts, mins, run_keys, k_cap)
    return joined.select(
        *run_keys, *question_keys, "k", estimate_pass_at_k(F.col("n"), F.col("c"), F.col("k")).alias("pass_at_k")
    )


def pass_at_k(counts: DataFrame, run_keys: Sequence[str] = (), k_cap: int = K_CAP, digits: int = 9) -> DataFrame:
    """Mean pass@k over questions for every ``run_keys`` value and k.

    Evaluated once per distinct ``(n, c, k)`` and weighted by how many
    questions share ``(n, c)``.  Each histogram row expands to its own
    ``k = 1..min(k_cap, n)``; a k is kept only if every question of the run
    reaches it (its question count equals the run's, i.e. ``k <= min n``), so
    no separate minimum, join or cross product is needed.
    """
    hist = counts.groupBy(*run_keys, "n", "c").agg(F.count(F.lit(1)).alias("__q"))
    est = hist.withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.lit(k_cap), F.col("n")).cast("int"))))
    est = est.withColumn("__p", estimate_pass_at_k(F.col("n"), F.col("c"), F.col("k")))
    per_k = est.groupBy(*run_keys, "k").agg(
        F.round(F.sum(F.col("__p") * F.col("__q")) / F.sum("__q"), digits).alias("pass_at_k"),
        F.sum("__q").alias("n_questions"),
    )
    # k = 1 is reached by every question, so the run's largest count is its total
    total = F.max("n_questions").over(Window.partitionBy(*run_keys)) if run_keys else F.max("n_questions").over(Window.partitionBy(F.lit(1)))
    return per_k.withColumn("__all", total).where(F.col("n_questions") == F.col("__all")).drop("__all")


def metric_vectors(counts: DataFrame, run_keys: Sequence[str], question_keys: Sequence[str], k_cap: int = K_CAP) -> DataFrame:
    """The per-question values of every (run, k) in question order, as a
    long table ``(run_keys, k, pos, value)``; ``pos`` is the 0-based place in the
    vector.  Questions are numbered once, by a distributed rank of the counts, before
    the k are spread over them; never one list in one task."""
    ranked = rank_within(counts, run_keys, question_keys, "__pos")
    mins = ranked.groupBy(*run_keys).agg(F.min("n").alias("__min_n"))
    grid = with_k_grid(ranked, mins, run_keys, k_cap)
    return grid.select(*run_keys, "k", (F.col("__pos") - 1).alias("pos"), estimate_pass_at_k(F.col("n"), F.col("c"), F.col("k")).alias("value"))


def instance_results(gen_ok: DataFrame, task: str, gen: str, ok: str = "ok") -> DataFrame:
    """Per task the pass flag of each generation at its place in generation
    order (long form ``task, pos, ok``; a hot task is split by range partitioning)."""
    ranked = rank_within(gen_ok, [task], [gen], "__pos")
    return ranked.select(task, (F.col("__pos") - 1).alias("pos"), F.col(ok).alias("ok"))


def pass_at_k_multi_test(gen_ok: DataFrame, task: str, k_list: Sequence[int] = (1, 5), ok: str = "ok") -> DataFrame:
    """pass@k for each k of ``k_list`` kept only when every task has at least k generations.

    One row per k and task (the detail), and one per k with a null task: the mean over all tasks.
    """
    counts = gen_ok.groupBy(task).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(ok)).alias("c"))
    min_n = counts.agg(F.min("n")).scalar()  # scalar sub-query, no join
    ks = counts.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in k_list])))
    est = ks.where(F.col("k") <= min_n)
    est = est.withColumn("p", estimate_pass_at_k(F.col("n"), F.col("c"), F.col("k")))
    both = est.rollup("k", task).agg(F.grouping_id().alias("__level"), F.round(F.avg("p"), 9).alias("pass_at_k"), F.count(F.lit(1)).alias("n_tasks"))
    return both.where(F.col("__level") < 3).drop("__level")
