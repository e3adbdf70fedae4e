"""F1-F13 — grading as an ordered cascade of native predicates.

``grade_answers(df, pred, gt)`` adds ``tier`` and ``is_correct``.  Tiers run
cheapest first and the first tier that settles a row wins:

    null, exact, choice, numeric / numeric_percent / numeric_mismatch (final),
    empty, bracket, tuple, matrix, equation_pair, equation_side,
    fraction_value, linear / linear_mismatch (final), residual

``residual`` rows are those the evaluated pipeline hands to a computer-algebra
system; they grade false here and are listed by ``symbolic_residual`` (F11).
Everything is a per-row projection (no shuffle, no Python); the expressions
are Spark SQL text, parsed once per stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverlens.functions.sql import WS, let, q, rep, strip
from coverlens.operators.arithmetic import linear_equal_sql
from coverlens.operators.extract import extract_boxed_reward_sql

REL_TOL = 1e-4
CHOICES = "('A', 'B', 'C', 'D', 'E')"

# A number Python's ``float()`` accepts (ASCII forms, optional underscores
# between digits, inf/nan words), surrounded by optional whitespace.
FLOAT_TEXT = (
    r"^\s*[+-]?(?:(?:[0-9](?:_?[0-9])*(?:\.(?:[0-9](?:_?[0-9])*)?)?|\.[0-9](?:_?[0-9])*)"
    r"(?:[eE][+-]?[0-9](?:_?[0-9])*)?|(?i:inf|infinity|nan))\s*$"
)
INT_TEXT = r"^\s*[+-]?[0-9](?:_?[0-9])*\s*$"


def py_float_sql(x: str) -> str:
    """``float(x)`` or NULL where Python would raise."""
    return f"CASE WHEN {x} RLIKE {q(FLOAT_TEXT)} THEN try_cast(replace({strip(x)}, '_', '') AS DOUBLE) END"


def is_close_sql(a: str, b: str, rel_tol: float = REL_TOL) -> str:
    """``math.isclose(a, b, rel_tol)`` with Python's NaN/inf rules (NULL -> false)."""
    return (
        f"(CASE WHEN {a} IS NULL OR {b} IS NULL OR isnan({a}) OR isnan({b}) THEN false "
        f"WHEN {a} = {b} THEN true "
        f"WHEN abs({a}) = double('inf') OR abs({b}) = double('inf') THEN false "
        f"ELSE abs({a} - {b}) <= greatest(abs({a} * {rel_tol}D), abs({b} * {rel_tol}D)) END)"
    )


def parse_digits_sql(c: str) -> str:
    """F3 helper: number after comma removal; ``x%`` (and ``x\\%``) -> x/100; else NULL."""
    x = rep(c, ",")
    body = f"regexp_replace(regexp_replace({x}, {q(r'%\z')}, ''), {q(r'\\\z')}, '')"
    return f"coalesce({py_float_sql(x)}, CASE WHEN endswith({x}, '%') THEN {py_float_sql(body)} / 100.0D END)"


def choice_clean_sql(p: str) -> str:
    """F2 helper: last A-E letter of the cleaned prediction (grader variant)."""
    x = f"ltrim(':', btrim(rtrim('/', rtrim('.', {strip(p, chr(10))})), ' '))"
    letters = f"regexp_extract_all(upper({x}), {q(r'(?U)\b(A|B|C|D|E)\b')}, 1)"
    picked = f"CASE WHEN size({letters}) > 0 THEN element_at({letters}, -1) ELSE btrim({strip(x)}, '.') END"
    return f"rtrim('/', rtrim('.', {picked}))"


def numeric_verdict_sql(pv: str, rv: str, include_percentage: bool = True, is_close: bool = True) -> str:
    """'numeric', 'numeric_percent' or 'numeric_mismatch' for two parsed numbers.

    Without ``include_percentage`` a factor of 100 is a mismatch; without ``is_close``
    numbers must be the same double.
    """
    same = is_close_sql if is_close else lambda a, b: f"coalesce({a} = {b} AND NOT isnan({a}), false)"
    percent = f"WHEN {same(pv, f'({rv} / 100.0D)')} OR {same(pv, f'({rv} * 100.0D)')} THEN 'numeric_percent' " if include_percentage else ""
    return f"CASE WHEN {same(pv, rv)} THEN 'numeric' {percent}ELSE 'numeric_mismatch' END"


def bracket_equal_sql(p: str, r: str) -> str:
    """equal after removing outer ``[]()`` and every ``{}()``."""
    outer = (
        f"((startswith({p}, '[') AND endswith({p}, ']') AND NOT startswith({r}, '(')) OR "
        f"(startswith({p}, '(') AND endswith({p}, ')') AND NOT startswith({r}, '[')))"
    )
    ps = f"CASE WHEN {outer} THEN btrim({p}, '[]()') ELSE {p} END"
    rs = f"CASE WHEN {outer} THEN btrim({r}, '[]()') ELSE {r} END"
    return f"(lower(translate({ps}, '{{}}()', '')) = lower(translate({rs}, '{{}}()', '')))"


_FRAC = r"^(-?)\\frac\{([^{}]+)\}\{([^{}]+)\}$"
_SLASH = r"^([^/]+)/([^/]+)$"


def fraction_value_sql(c: str) -> str:
    """value of a number, ``\\frac{a}{b}``, ``-\\frac{a}{b}`` or ``a/b``."""
    x = strip(c)
    sign = f"CASE WHEN regexp_extract({x}, {q(_FRAC)}, 1) = '-' THEN -1.0D ELSE 1.0D END"
    num, den = py_float_sql(f"regexp_extract({x}, {q(_FRAC)}, 2)"), py_float_sql(f"regexp_extract({x}, {q(_FRAC)}, 3)")
    a, b = py_float_sql(f"regexp_extract({x}, {q(_SLASH)}, 1)"), py_float_sql(f"regexp_extract({x}, {q(_SLASH)}, 2)")
    return (
        f"coalesce({py_float_sql(x)}, CASE WHEN {x} RLIKE {q(_FRAC)} THEN {sign} * try_divide({num}, {den}) END, "
        f"CASE WHEN {x} RLIKE {q(_SLASH)} THEN try_divide({a}, {b}) END)"
    )


def element_equal_sql(p: str, r: str) -> str:
    """Element rule inside tuples, matrices and equations (one level of recursion)."""

    def body(v: dict[str, str]) -> str:
        pv, rv = v["pv"], v["rv"]
        numeric = f"({is_close_sql(pv, rv)} OR {is_close_sql(pv, f'({rv} / 100.0D)')} OR {is_close_sql(pv, f'({rv} * 100.0D)')})"
        fv = let({"a": fraction_value_sql(v["ps"]), "b": fraction_value_sql(v["rs"])}, lambda w: is_close_sql(w["a"], w["b"]))
        return (
            f"(CASE WHEN lower({v['ps']}) = lower({v['rs']}) THEN true "
            f"WHEN {v['r']} IN {CHOICES} AND {choice_clean_sql(v['p'])} = {v['r']} THEN true "
            f"WHEN {pv} IS NOT NULL AND {rv} IS NOT NULL THEN {numeric} "
            f"WHEN {v['p']} = '' THEN false "
            f"WHEN {bracket_equal_sql(v['ps'], v['rs'])} THEN true "
            f"ELSE {fv} END)"
        )

    return let(
        {"p": p, "r": r, "ps": strip(p), "rs": strip(r), "pv": parse_digits_sql(p), "rv": parse_digits_sql(r)},
        body,
    )


def tuple_equal_sql(p: str, r: str) -> str:
    """``(a,b)``/``[a,b]`` with the same arity and equal elements."""
    shaped = f"({p} RLIKE {q(r'^[(\[].+[)\]]')} AND {r} RLIKE {q(r'^[(\[].+[)\]]')})"
    pp = f"split(substr({p}, 2, length({p}) - 2), ',', -1)"
    rp = f"split(substr({r}, 2, length({r}) - 2), ',', -1)"
    return f"({shaped} AND size({pp}) = size({rp}) AND forall(zip_with({pp}, {rp}, (a, b) -> {part_equal_sql('a', 'b')}), ok -> ok))"


def side_equal_sql(a: str, b: str) -> str:
    """F8: sides of two equations that are the same text, or the same number exactly."""
    return let({"a": strip(a), "b": strip(b)}, lambda v: f"({v['a']} = {v['b']} OR coalesce({fraction_value_sql(v['a'])} = {fraction_value_sql(v['b'])}, false))")


def part_equal_sql(p: str, r: str) -> str:
    """An element of a tuple or matrix: the element rule, also for the side of a short equation against a plain value."""

    def short(x: str) -> str:
        return f"(length({x}) - length(replace({x}, '=', '')) = 1 AND length({strip(f'substring_index({x}, {q("=")}, 1)')}) <= 2)"

    def bare(x: str, other: str) -> str:
        return f"CASE WHEN {short(x)} AND instr({other}, '=') = 0 THEN substring_index({x}, '=', -1) ELSE {x} END"

    return let({"p": p, "r": r}, lambda v: let({"a": bare(v["p"], v["r"]), "b": bare(v["r"], v["p"])}, lambda w: element_equal_sql(w["a"], w["b"])))


def cascade_equal_sql(p: str, r: str) -> str:
    """the side of an equation against a value, which may be a tuple or a matrix."""
    return let({"p": strip(p), "r": strip(r)}, lambda v: f"({element_equal_sql(v['p'], v['r'])} OR {tuple_equal_sql(v['p'], v['r'])} OR {matrix_equal_sql(v['p'], v['r'])})")


_MAT_OPEN = r"^\\begin\{[pb]matrix\}"
_MAT_CLOSE = r"\\end\{[pb]matrix\}$"


def _matrix_lines(c: str) -> str:
    body = f"substr({c}, 16, length({c}) - 28)"
    return f"filter(transform(split({body}, {q(r'\\\\')}, -1), l -> {strip('l')}), l -> l <> '')"


def matrix_equal_sql(p: str, r: str) -> str:
    """pmatrix/bmatrix rows (``\\\\``) and cells (``&``) all equal."""
    shaped = " AND ".join(f"{x} RLIKE {q(pat)}" for x in (p, r) for pat in (_MAT_OPEN, _MAT_CLOSE))
    pl, rl = _matrix_lines(p), _matrix_lines(r)
    row = (
        f"(ra, rb) -> size(split(ra, '&', -1)) = size(split(rb, '&', -1)) AND "
        f"forall(zip_with(split(ra, '&', -1), split(rb, '&', -1), (ca, cb) -> {part_equal_sql('ca', 'cb')}), ok -> ok)"
    )
    return f"({shaped} AND size({pl}) = size({rl}) AND forall(zip_with({pl}, {rl}, {row}), ok -> ok))"


def to_pmatrix_sql(r: str) -> str:
    """Set-style truth ``{a,b}`` -> pmatrix text (each comma becomes one backslash)."""
    m = f"regexp_extract({strip(r)}, {q(r'\{.*,.*\}')}, 0)"
    return (
        f"CASE WHEN {m} <> '' THEN concat({q(chr(92) + 'begin{pmatrix}')}, replace(btrim({m}, '{{}}'), ',', {q(chr(92))}), "
        f"{q(chr(92) + 'end{pmatrix}')}) ELSE '' END"
    )


def grade_answers(df: DataFrame, pred: str = "pred_answer", gt: str = "gt_norm", include_percentage: bool = True, is_close: bool = True) -> DataFrame:
    """add ``tier`` and ``is_correct`` for columns ``pred`` and ``gt``.

    ``include_percentage`` and ``is_close`` rule how two plain numbers compare (F3);
    parts of tuples, matrices and equations compare by the default rule.
    """
    p0, r0 = f"`{pred}`", f"`{gt}`"
    df = df.withColumns({"__pv": F.expr(parse_digits_sql(p0)), "__rv": F.expr(parse_digits_sql(r0))})
    early = (
        f"CASE WHEN {p0} IS NULL OR {r0} IS NULL THEN 'null' "
        f"WHEN {p0} = {r0} OR lower({strip(p0)}) = lower({strip(r0)}) THEN 'exact' "
        f"WHEN {r0} IN {CHOICES} AND {choice_clean_sql(p0)} = {r0} THEN 'choice' "
        f"WHEN __pv IS NOT NULL AND __rv IS NOT NULL THEN {numeric_verdict_sql('__pv', '__rv', include_percentage, is_close)} "
        f"WHEN {p0} = '' THEN 'empty' END"
    )
    # symbolic part: stripped strings, set-style truth turned into a matrix
    df = df.withColumns({"__early": F.expr(early), "__p": F.expr(strip(p0)), "__r": F.expr(strip(r0))})
    df = df.withColumn(
        "__r", F.expr(f"CASE WHEN instr(__p, 'pmatrix') > 0 AND instr(__r, 'pmatrix') = 0 THEN {to_pmatrix_sql('__r')} ELSE __r END")
    )
    df = df.withColumns({
        "__pe": F.expr("length(__p) - length(replace(__p, '=', ''))"),
        "__re": F.expr("length(__r) - length(replace(__r, '=', ''))"),
        "__pl": F.expr(strip("substring_index(__p, '=', 1)")), "__pr": F.expr(strip("substring_index(__p, '=', -1)")),
        "__rl": F.expr(strip("substring_index(__r, '=', 1)")), "__rr": F.expr(strip("substring_index(__r, '=', -1)")),
    })
    pl, pr, rl, rr = "__pl", "__pr", "__rl", "__rr"
    # two equations: sides equal as text or as exact numbers, in either order; one equation: the side by the whole cascade below it
    sides = "array(named_struct('a', __pl, 'b', __rl), named_struct('a', __pr, 'b', __rr), named_struct('a', __pl, 'b', __rr), named_struct('a', __pr, 'b', __rl))"
    exact = f"transform({sides}, x -> {side_equal_sql('x.a', 'x.b')})"
    whole = "array(named_struct('a', substring_index(__p, '=', -1), 'b', __r), named_struct('a', __p, 'b', substring_index(__r, '=', -1)))"
    side = f"transform({whole}, x -> {cascade_equal_sql('x.a', 'x.b')})"
    p_side = f"(__pe = 1 AND length({pl}) <= 2 AND __re = 0)"
    r_side = f"(__re = 1 AND length({rl}) <= 2 AND __pe = 0)"
    equation = let(
        {"e": exact, "s": side},
        lambda v: (
            f"CASE WHEN __pe = 1 AND __re = 1 THEN (CASE WHEN ({v['e']}[0] AND {v['e']}[1]) OR ({v['e']}[2] AND {v['e']}[3]) "
            f"THEN 'equation_pair' END) "
            f"WHEN {p_side} AND {v['s']}[0] THEN 'equation_side' WHEN {r_side} AND {v['s']}[1] THEN 'equation_side' END"
        ),
    )
    needs_eq = f"((__pe = 1 AND __re = 1) OR {p_side} OR {r_side})"
    fraction = let({'a': fraction_value_sql('__p'), 'b': fraction_value_sql('__r')}, lambda w: is_close_sql(w['a'], w['b']))
    late = (
        f"CASE WHEN {bracket_equal_sql('__p', '__r')} THEN 'bracket' "
        f"WHEN {tuple_equal_sql('__p', '__r')} THEN 'tuple' "
        f"WHEN {matrix_equal_sql('__p', '__r')} THEN 'matrix' "
        f"ELSE coalesce(CASE WHEN {needs_eq} THEN {equation} END, "
        f"CASE WHEN {fraction} THEN 'fraction_value' ELSE 'residual' END) END"
    )
    df = df.withColumn("tier", F.expr(f"coalesce(__early, {late})"))
    # what is left of two equations: both linear, and the differences of their sides equal up to sign, or not
    open_pair = "tier = 'residual' AND __pe = 1 AND __re = 1"
    df = df.withColumn("__same", F.expr(f"CASE WHEN {open_pair} THEN {linear_equal_sql('__p', '__r')} END"))
    df = df.withColumn("tier", F.expr("CASE WHEN __same THEN 'linear' WHEN NOT __same THEN 'linear_mismatch' ELSE tier END")).drop("__same")
    df = df.withColumn("is_correct", F.expr("tier NOT IN ('null', 'numeric_mismatch', 'empty', 'linear_mismatch', 'residual')"))
    return df.drop("__pv", "__rv", "__early", "__p", "__r", "__pe", "__re", "__pl", "__pr", "__rl", "__rr")


def symbolic_residual(graded: DataFrame, pred: str = "pred_answer", gt: str = "gt_norm") -> DataFrame:
    """distinct (pred, gt) pairs no tier settles, with their row counts.

    The rows are taken by a generator: a filter is pushed below the projections of
    the cascade, where it repeats their expressions within each other.
    """
    pair = F.struct(F.col(pred).alias("pred_answer"), F.col(gt).alias("gt_answer"))
    open_rows = graded.select(F.explode(F.when(F.col("tier") == "residual", F.array(pair))).alias("pair"))
    return open_rows.select("pair.*").groupBy("pred_answer", "gt_answer").agg(F.count(F.lit(1)).alias("n_rows"))


def reward_int_match_sql(response: str, target: str) -> str:
    """1.0 when the boxed answer reads as an integer equal to ``target``."""
    ans = extract_boxed_reward_sql(response)
    as_int = f"CASE WHEN {ans} RLIKE {q(INT_TEXT)} THEN try_cast(replace({strip(ans)}, '_', '') AS BIGINT) END"
    return f"CASE WHEN abs(CAST({as_int} AS DOUBLE) - try_cast({target} AS DOUBLE)) < 1e-5D THEN 1.0D ELSE 0.0D END"


def all_tests_pass(grades: DataFrame, task: str, gen: str, grade: str) -> DataFrame:
    """a generation is correct iff every test grade is > 0."""
    return grades.groupBy(task, gen).agg(F.bool_and(F.col(grade) > 0).alias("ok"))


__all__ = ["WS", "all_tests_pass", "grade_answers", "reward_int_match_sql", "symbolic_residual"]
