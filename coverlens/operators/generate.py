"""C1, C4, C5, C11-C15 — deterministic synthetic problem tables (problems with their texts and outputs: ``chains``).

Randomness is a seeded hash of (seed, id, slot) (MD5, which every SQL engine
has), never a driver RNG, so a problem's content does not depend on partitioning.  Chains are
additive, so traces are running sums over the step positions (windows
partitioned by the problem id) instead of an algebra system.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 42
MAX_CONST = 20
STEPS = 10

# --- fixed values: problem and solution wording --------------------------------
PROBLEM_TEXT = ("Consider a system of variables where each variable is defined as follows: ", ". If ", ", determine the value of ", ".")
OPENINGS = [
    "To find the target value, we compute the following variables step by step:",
    "We compute the following variables step by step to obtain the target value.",
    "The target value is found by sequentially computing the following variables.",
]
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASES = [7, 9, 11, 12]
COT_TAIL = "Let's think step by step, and end the response with the result in \"\\boxed{result}\"."
PLAIN_TAIL = "End the response with the result in \"\\boxed{result}\"."
BASE_TEXT = ("You are a mathematician. Assuming that all numbers are in base-", ' where the digits are "', '", what is ', "? ")
TRIVIAL_TEXT = ("What is ", "? ")
# ------------------------------------------------------------------------------


def seeded(id_col: Column, slot: Column, seed: int = SEED) -> Column:
    """A number of 60 bits from MD5 of ``seed|id|slot``."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), id_col, slot)), 1, 15), 16, 10).cast("bigint")


def hashed_slots(id_col: Column, n: int, seed: int = SEED, modulo: int = MAX_CONST) -> Column:
    """``n`` constants in [1, modulo] drawn from a seeded hash per (id, slot)."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda s: seeded(id_col, s, seed) % F.lit(modulo).cast("bigint") + 1)


def letter_permutation(id_col: Column, seed: int = SEED) -> Column:
    """A per-problem shuffle of a..z ordered by a seeded hash."""
    keyed = F.transform(F.sequence(F.lit(0), F.lit(25)), lambda i: F.struct(F.md5(F.concat_ws("|", F.lit(seed), id_col, F.concat(F.lit("l"), i))).alias("h"), F.char(F.lit(97) + i).alias("l")))
    return F.transform(F.array_sort(keyed), lambda s: s["l"])


def forward_trace(steps: DataFrame) -> DataFrame:
    """C4: running evaluation ``var = prev + c = value`` along the chain."""
    w = Window.partitionBy("id").orderBy("pos")
    prev = F.coalesce(F.lag("var").over(w), F.col("premise_var"))
    return steps.select(
        "id", "pos", "var",
        F.concat(prev, F.lit(" + "), F.col("cst").cast("string")).alias("expr"),
        (F.col("p0") + F.sum("cst").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("value"),
    )


def reverse_trace(steps: DataFrame) -> DataFrame:
    """Back-substitution from the target.  The row at position ``pos``
    substitutes variable ``pos-1``; the expression left is
    ``var(pos-2) + suffix sum``, and substituting the premise gives the integer."""
    w = Window.partitionBy("id").orderBy("pos")
    suffix = F.sum("cst").over(Window.partitionBy("id").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, 0))
    var_sp = F.coalesce(F.lag("var", 1).over(w), F.col("premise_var"))
    var_before = F.coalesce(F.lag("var", 2).over(w), F.col("premise_var"))
    cst_sp = F.lag("cst", 1).over(w)
    first = F.col("pos") == 1
    return steps.select(
        "id",
        (F.lit(STEPS + 1) - F.col("pos")).alias("step"),
        var_sp.alias("var"),
        F.when(first, F.col("p0").cast("string")).otherwise(F.concat(var_before, F.lit(" + "), cst_sp.cast("string"))).alias("rule"),
        F.when(first, (F.col("p0") + suffix).cast("string")).otherwise(F.concat(var_before, F.lit(" + "), (suffix + cst_sp).cast("string"))).alias("result"),
    )


def problem_text(rules: Column, premise: Column, target: Column) -> Column:
    """Question text (template 2) with the rules joined by '; '."""
    head, given, wanted, end = map(F.lit, PROBLEM_TEXT)
    return F.concat(head, F.array_join(rules, "; "), given, premise, wanted, target, end)


def base_repr_sql(value: str, base: str) -> str:
    """Non-negative integer in the given base with digits 0-9A-Z (SQL ``conv``)."""
    return f"conv(CAST({value} AS STRING), 10, {base})"


def counterfact_prompt(expr: Column, base: Column, cot: bool = True) -> Column:
    """C14: the base-N addition question, with or without step-by-step."""
    digits = F.substr(F.lit(DIGITS), F.lit(1), base)
    head, of, what, end = map(F.lit, BASE_TEXT)
    return F.concat(head, base.cast("string"), of, digits, what, expr, end, F.lit(COT_TAIL if cot else PLAIN_TAIL))


def trivial_prompt(expr: Column) -> Column:
    what, end = map(F.lit, TRIVIAL_TEXT)
    return F.concat(what, expr, end, F.lit(PLAIN_TAIL))
