"""Registered queries: the grading tiers one by one and as a cascade."""

from __future__ import annotations

from pyspark.sql import functions as F

from coverlens.functions.sql import let, strip
from coverlens.operators import grade as G
from coverlens.plans import fixtures
from coverlens.plans.oracle import duck
from coverlens.plans.registry import register
from coverlens.sources.tables import ensure_parallelism, table

_A = f"({duck.ANSWERS})"


def _flag(spark, sf, sql: str):
    a = fixtures.answers(spark, sf)
    return a.select("p_partkey", "pred", "gt", F.expr(sql).alias("flag"))


@register("grade_exact", oracle=lambda: f"SELECT p_partkey, pred, gt, coalesce(lower({duck.strip('pred')}) = lower({duck.strip('gt')}), false) AS flag FROM {_A}")
def q_grade_exact(spark, sf):
    """trimmed, case-insensitive equality (NULL -> false)."""
    return _flag(spark, sf, f"coalesce(lower({strip('pred')}) = lower({strip('gt')}), false)")


@register("grade_choice", oracle=lambda: f"SELECT p_partkey, pred, gt, (gt IN ('A', 'B', 'C', 'D', 'E') AND {duck.choice_clean('pred')} = gt) AS flag FROM {_A}")
def q_grade_choice(spark, sf):
    """truth is a choice letter and the cleaned prediction's last letter equals it."""
    return _flag(spark, sf, f"gt IN {G.CHOICES} AND {G.choice_clean_sql('pred')} = gt")


@register("grade_numeric", oracle=lambda: f"""
SELECT p_partkey, pred, gt, CASE WHEN pv IS NOT NULL AND rv IS NOT NULL THEN
  (CASE WHEN {duck.is_close('pv', 'rv')} THEN 'numeric' WHEN {duck.is_close('pv', '(rv / 100.0)')} OR {duck.is_close('pv', '(rv * 100.0)')}
   THEN 'numeric_percent' ELSE 'numeric_mismatch' END) END AS flag
FROM (SELECT *, {duck.parse_digits('pred')} AS pv, {duck.parse_digits('gt')} AS rv FROM {_A})""")
def q_grade_numeric(spark, sf):
    """numeric verdict (with the x/100, x*100 variants) when both sides parse."""
    a = fixtures.answers(spark, sf).withColumn("pv", F.expr(G.parse_digits_sql("pred"))).withColumn("rv", F.expr(G.parse_digits_sql("gt")))
    return a.select("p_partkey", "pred", "gt", F.expr(f"CASE WHEN pv IS NOT NULL AND rv IS NOT NULL THEN {G.numeric_verdict_sql('pv', 'rv')} END").alias("flag"))


@register("grade_bracket_insensitive", oracle=lambda: f"SELECT p_partkey, pred, gt, {duck.bracket_equal(duck.strip('pred'), duck.strip('gt'))} AS flag FROM {_A}")
def q_grade_bracket(spark, sf):
    """equal after dropping outer []() and all {}()."""
    return _flag(spark, sf, G.bracket_equal_sql(strip("pred"), strip("gt")))


@register("grade_tuple", oracle=lambda: f"SELECT p_partkey, pred, gt, {duck.tuple_ok(duck.strip('pred'), duck.strip('gt'))} AS flag FROM {_A}")
def q_grade_tuple(spark, sf):
    """same-arity tuples with element-wise equal parts."""
    return _flag(spark, sf, f"coalesce({G.tuple_equal_sql(strip('pred'), strip('gt'))}, false)")


@register("grade_matrix", oracle=lambda: f"SELECT p_partkey, pred, gt, {duck.matrix_ok(duck.strip('pred'), duck.strip('gt'))} AS flag FROM {_A}")
def q_grade_matrix(spark, sf):
    """pmatrix rows and cells all equal."""
    return _flag(spark, sf, f"coalesce({G.matrix_equal_sql(strip('pred'), strip('gt'))}, false)")


@register("grade_equation_side", oracle=lambda: f"SELECT p_partkey, pred, gt, coalesce({duck.side_ok(duck.strip('pred'), duck.strip('gt'))}, false) AS flag FROM {_A}")
def q_grade_equation_side(spark, sf):
    """``x = v`` (short left side) against a plain value."""
    a = fixtures.answers(spark, sf).select("p_partkey", "pred", "gt")
    return a.join(_side(spark, sf), "p_partkey").select("p_partkey", "pred", "gt", "flag")


def _side(spark, sf):
    a = fixtures.answers(spark, sf).withColumn("__p", F.expr(strip("pred"))).withColumn("__r", F.expr(strip("gt")))
    pe = "(length(__p) - length(replace(__p, '=', '')))"
    re_ = "(length(__r) - length(replace(__r, '=', '')))"
    pl = strip("substring_index(__p, '=', 1)")
    rl = strip("substring_index(__r, '=', 1)")
    side = (
        f"coalesce(CASE WHEN {pe} = 1 AND length({pl}) <= 2 AND {re_} = 0 THEN {G.element_equal_sql('substring_index(__p, ' + chr(39) + '=' + chr(39) + ', -1)', '__r')} "
        f"WHEN {re_} = 1 AND length({rl}) <= 2 AND {pe} = 0 THEN {G.element_equal_sql('__p', 'substring_index(__r, ' + chr(39) + '=' + chr(39) + ', -1)')} ELSE false END, false)"
    )
    return a.select("p_partkey", F.expr(side).alias("flag"))


@register("grade_equation_pair", oracle=lambda: f"SELECT p_partkey, pred, gt, coalesce({duck.pair_ok(duck.strip('pred'), duck.strip('gt'))}, false) AS flag FROM {_A}")
def q_grade_equation_pair(spark, sf):
    """F8: both sides ``a = b``: side-wise (or swapped) equality."""
    a = fixtures.answers(spark, sf).withColumn("__p", F.expr(strip("pred"))).withColumn("__r", F.expr(strip("gt")))
    pe = "(length(__p) - length(replace(__p, '=', '')))"
    re_ = "(length(__r) - length(replace(__r, '=', '')))"
    pl, pr = strip("substring_index(__p, '=', 1)"), strip("substring_index(__p, '=', -1)")
    rl, rr = strip("substring_index(__r, '=', 1)"), strip("substring_index(__r, '=', -1)")
    ok = (
        f"coalesce({pe} = 1 AND {re_} = 1 AND (({G.element_equal_sql(pl, rl)} AND {G.element_equal_sql(pr, rr)}) OR "
        f"({G.element_equal_sql(pl, rr)} AND {G.element_equal_sql(pr, rl)})), false)"
    )
    return a.select("p_partkey", "pred", "gt", F.expr(ok).alias("flag"))


@register("grade_fraction_value", oracle=lambda: f"SELECT p_partkey, pred, gt, coalesce({duck.is_close(duck.fraction_value('pred'), duck.fraction_value('gt'))}, false) AS flag FROM {_A}")
def q_grade_fraction_value(spark, sf):
    """numeric value of \\frac{a}{b} / a/b forms compared at rel tol 1e-4."""
    fv = let({"a": G.fraction_value_sql("pred"), "b": G.fraction_value_sql("gt")}, lambda w: G.is_close_sql(w["a"], w["b"]))
    return _flag(spark, sf, f"coalesce({fv}, false)")


@register("grade_generations", oracle=lambda: f"SELECT p_partkey, pred, gt, tier, is_correct FROM ({duck.grade_query(duck.ANSWERS, 'pred', 'gt')})")
def q_grade_generations(spark, sf):
    """the whole cascade with the deciding tier per pair."""
    return G.grade_answers(fixtures.answers(spark, sf), "pred", "gt").select("p_partkey", "pred", "gt", "tier", "is_correct")


@register("symbolic_residual", oracle=lambda: f"""
SELECT pred AS pred_answer, gt AS gt_answer, count(*) AS n_rows FROM ({duck.grade_query(duck.ANSWERS, 'pred', 'gt')})
WHERE tier = 'residual' GROUP BY pred, gt""")
def q_symbolic_residual(spark, sf):
    """(pred, gt) pairs no tier settles, with their counts."""
    return G.symbolic_residual(G.grade_answers(fixtures.answers(spark, sf), "pred", "gt"), "pred", "gt")


_LINEAR = r"""(SELECT p_partkey, p_size % 9 + 1 AS a, p_partkey % 7 + 1 AS b, p_partkey % 50 AS c FROM part)"""


@register("grade_linear_equations", oracle=rf"""
WITH e AS (SELECT *, CAST(a AS VARCHAR) || 'x + ' || CAST(b AS VARCHAR) || 'y = ' || CAST(c AS VARCHAR) AS pred, [a, b, -c] AS pc,
  CASE p_partkey % 4 WHEN 0 THEN CAST(c AS VARCHAR) || ' - ' || CAST(b AS VARCHAR) || 'y = ' || CAST(a AS VARCHAR) || 'x'
    WHEN 1 THEN CAST(2 * a AS VARCHAR) || 'x + ' || CAST(2 * b AS VARCHAR) || 'y = ' || CAST(2 * c AS VARCHAR)
    WHEN 2 THEN '\frac{{' || CAST(a AS VARCHAR) || '}}{{2}}x + ' || CAST(b AS VARCHAR) || '*y + ' || CAST(a AS VARCHAR) || 'x/2 = ' || CAST(c AS VARCHAR)
    ELSE CAST(a AS VARCHAR) || 'x = ' || CAST(c AS VARCHAR) || ' + ' || CAST(b AS VARCHAR) || 'y' END AS gt,
  CASE p_partkey % 4 WHEN 0 THEN [-a, -b, c] WHEN 1 THEN [2 * a, 2 * b, -2 * c] WHEN 2 THEN [a, b, -c] ELSE [a, -b, -c] END AS gc
  FROM {_LINEAR})
SELECT p_partkey, pred, gt, CASE WHEN pc = gc OR pc = list_transform(gc, lambda v: -v) THEN 'linear' ELSE 'linear_mismatch' END AS tier,
  pc = gc OR pc = list_transform(gc, lambda v: -v) AS is_correct FROM e""")
def q_grade_linear_equations(spark, sf):
    """F8: two linear equations whose differences of sides are equal up to sign, whatever the order of their terms."""
    e = ensure_parallelism(table(spark, sf, "part").select("p_partkey", "p_size")).selectExpr("p_partkey", "CAST(p_size % 9 + 1 AS INT) AS a", "p_partkey % 7 + 1 AS b", "p_partkey % 50 AS c")
    gt = r"""CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN concat(c, ' - ', b, 'y = ', a, 'x') WHEN 1 THEN concat(2 * a, 'x + ', 2 * b, 'y = ', 2 * c)
      WHEN 2 THEN concat('\\frac{', a, '}{2}x + ', b, '*y + ', a, 'x/2 = ', c) ELSE concat(a, 'x = ', c, ' + ', b, 'y') END"""
    e = e.select("p_partkey", F.expr("concat(a, 'x + ', b, 'y = ', c)").alias("pred"), F.expr(gt).alias("gt"))
    return G.grade_answers(e, "pred", "gt").select("p_partkey", "pred", "gt", "tier", "is_correct")
