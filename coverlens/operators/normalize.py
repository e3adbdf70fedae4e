"""E7/E8 — answer normalisation as a staged projection.

``normalize_answers(df, src, dst)`` rewrites one string column through the
ordered clean-up steps of the evaluated pipeline (whitespace, LaTeX spellings,
units, dollar signs, number words, ``\\text{}``, percent, infinity, decimal
tails, ``k=`` prefixes, sqrt/frac spelling, ``a/b``).

Each step is a native Spark SQL expression.  Steps that need the current
value more than once run in their own projection, so the expression tree
stays linear; the chain runs in one whole-stage-codegen span except the unit
fold, a single higher-order ``aggregate`` over a constant pattern array.
"""

from __future__ import annotations

import json
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverlens.functions.fixed_values import NUMBER_WORDS, UNIT_TEXTS_WITH_PLURALS
from coverlens.functions.sql import WS, let, q, rep, rx, strip

# A letter or any non-ASCII character: every unit text contains one, so a
# string without such a character cannot lose a unit.
_HAS_WORD_CHAR = r"[^\x00-\x40\x5b-\x60\x7b-\x7f]"


def unit_needle(unit: str) -> str:
    # '.' inside a unit is a regex wildcard; the longest literal piece must be present
    return max(unit.split("."), key=len)


def unit_pattern(unit: str) -> str:
    return r"(?U)(^|\W)" + unit + r"($|\W)"


@lru_cache(maxsize=1)
def unit_table_sql() -> str:
    """array<struct<needle, pat>> for two passes over the unit list, in order.

    Written as ``from_json`` of one literal: a single foldable expression the
    optimizer evaluates once, instead of thousands of struct nodes to analyse.
    """
    entries = [{"needle": unit_needle(u), "pat": unit_pattern(u)} for u in UNIT_TEXTS_WITH_PLURALS] * 2
    return f"from_json({q(json.dumps(entries, ensure_ascii=False))}, 'array<struct<needle:string,pat:string>>')"


def remove_units_sql(s: str) -> str:
    """Sequentially drop each unit word (a removal is kept only if text remains)."""
    fold = (
        f"aggregate({unit_table_sql()}, {s}, (acc, u) -> CASE WHEN instr(acc, u.needle) > 0 "
        f"THEN coalesce(nullif(regexp_replace(acc, u.pat, '$1$2'), ''), acc) ELSE acc END)"
    )
    # without a match of any unit the fold changes nothing: one constant pattern tells
    some = r"(?U)(?:^|\W)(?:" + "|".join(UNIT_TEXTS_WITH_PLURALS) + r")(?:$|\W)"
    return f"CASE WHEN {s} RLIKE {q(_HAS_WORD_CHAR)} AND {s} RLIKE {q(some)} THEN {fold} ELSE {s} END"


def _formation_sql(a: str) -> str:
    """Value of up to four words below a thousand (NULL for none or more): 'two hundred five', 'forty two', 'seven hundred'."""
    v = lambda i: f"element_at({a}, {i})"
    return (
        f"CASE size({a}) WHEN 4 THEN {v(1)} * {v(2)} + {v(3)} + {v(4)} WHEN 3 THEN {v(1)} * {v(2)} + {v(3)} "
        f"WHEN 2 THEN CASE WHEN array_contains({a}, 100L) THEN {v(1)} * {v(2)} ELSE {v(1)} + {v(2)} END WHEN 1 THEN {v(1)} END"
    )


def words_value_sql(words: str) -> str:
    """Integer that number words (an array of their values) spell, NULL where they spell none.

    The words are cut at billion, million and thousand, each allowed once and
    in this order; a single word is its own value.
    """

    def body(v: dict[str, str]) -> str:
        w, b, m, t = v["w"], v["b"], v["m"], v["t"]
        bad = (
            f"size(filter({w}, x -> x = 1000L)) > 1 OR size(filter({w}, x -> x = 1000000L)) > 1 OR size(filter({w}, x -> x = 1000000000L)) > 1 "
            f"OR ({t} > 0 AND ({t} < {m} OR {t} < {b})) OR ({m} > 0 AND {m} < {b})"
        )
        part = lambda lo, hi: let({"p": f"slice({w}, CAST({lo} + 1 AS INT), CAST(greatest({hi} - {lo} - 1, 0) AS INT))"}, lambda x: _formation_sql(x["p"]))
        last = f"greatest({b}, {m}, {t})"
        return (
            f"CASE WHEN size({w}) = 0 OR {bad} THEN NULL WHEN size({w}) = 1 THEN element_at({w}, 1) ELSE "
            f"CASE WHEN {b} > 0 THEN ({part('0', b)}) * 1000000000L ELSE 0L END + CASE WHEN {m} > 0 THEN ({part(b, m)}) * 1000000L ELSE 0L END "
            f"+ CASE WHEN {t} > 0 THEN ({part(f'greatest({b}, {m})', t)}) * 1000L ELSE 0L END "
            f"+ CASE WHEN {last} = size({w}) THEN 0L ELSE {part(last, f'(size({w}) + 1)')} END END"
        )

    at = lambda x: f"array_position({words}, {x}L)"
    return let({"w": words, "b": at(1000000000), "m": at(1000000), "t": at(1000)}, body)


def word_number_sql(s: str) -> str:
    """Digits-only text -> canonical integer; number words -> their number, with digits after 'point'."""
    w = f"lower(replace({s}, '-', ' '))"
    keys = ", ".join(q(k) for k in NUMBER_WORDS)
    vals = ", ".join(f"{v}L" for v in NUMBER_WORDS.values())
    found = f"transform(filter(split({strip(w)}, {q(r'\s+')}), t -> array_contains(array({keys}), t)), t -> element_at(map_from_arrays(array({keys}), array({vals})), t))"

    def spelt(v: dict[str, str]) -> str:
        n, p = v["n"], f"array_position({v['n']}, -1L)"
        whole = f"slice({n}, 1, CAST({p} - 1 AS INT))"
        digits = f"slice({n}, CAST({p} + 1 AS INT), size({n}))"
        bad = f"size(filter({n}, x -> x = -1L)) > 1 OR exists({digits}, x -> x > 9L)"
        value = words_value_sql(whole)
        tail = f"array_join(transform({digits}, x -> CAST(x AS STRING)), '')"
        return (
            f"CASE WHEN {p} = 0 THEN CAST(({words_value_sql(n)}) AS STRING) WHEN {bad} OR size({digits}) = 0 THEN NULL "
            f"ELSE concat(coalesce(CAST(({value}) AS STRING), CASE WHEN {p} = 1 THEN '0' END), '.', coalesce(nullif(regexp_replace({tail}, {q(r'0+$')}, ''), ''), '0')) END"
        )

    number = let({"n": found}, spelt)
    letters = f"{w} RLIKE '(?:one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|teen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|zero|hundred|thousand|million|billion)'"
    return (
        f"CASE WHEN {w} RLIKE {q(r'\A[0-9]+\z')} THEN {rx(w, r'^0+(?=[0-9])')} "
        f"WHEN {letters} THEN coalesce({number}, {s}) ELSE {s} END"
    )


def fix_fracs_sql(s: str) -> str:
    r"""``\frac12`` -> ``\frac{1}{2}``, ``\frac1{x}`` -> ``\frac{1}{x}``.

    A ``\frac`` followed by fewer than two characters (and no brace) leaves
    the whole string unchanged.
    """
    abort = f"{s} RLIKE {q(r'\\frac(?:\\frac|$)|\\frac[^{](?:\\frac|$)')}"
    fixed = rx(rx(s, r"(?s)\\frac([^{])\{", r"\\frac{$1}{"), r"(?s)\\frac([^{])([^{])", r"\\frac{$1}{$2}")
    return f"CASE WHEN {abort} THEN {s} ELSE {fixed} END"


_CANON_INT_OR_SQRT = r"(0|-?[1-9][0-9]*|[^/]*sqrt[^/]*)"


def fix_a_slash_b_sql(s: str) -> str:
    """``3/4`` -> ``\\frac{3}{4}`` when both sides are canonical ints (or contain sqrt)."""
    return rx(s, "^" + _CANON_INT_OR_SQRT + "/" + _CANON_INT_OR_SQRT + "$", r"\\frac{$1}{$2}")


def normalize_stages(s: str, skip_unit: bool = False) -> list[str]:
    """The ordered stages; each is an expression of the previous value ``s``."""
    st = strip(s)
    st = rep(st, "\n")
    st = f"rtrim('.', {st})"
    st = rep(st, "\\!")
    st = rx(st, r"\\begin\{array\}\{.*?\}", r"\\begin{pmatrix}")
    st = rx(st, r"\\end\{array\}", r"\\end{pmatrix}")
    st = rep(st, "bmatrix", "pmatrix")
    st = rep(rep(st, "tfrac", "frac"), "dfrac", "frac")
    st = rep(rep(rep(st, "\\neq", "\\ne"), "\\leq", "\\le"), "\\geq", "\\ge")
    st = rep(rep(st, "\\left"), "\\right")
    st = rep(rep(st, "\\{", "{"), "\\}", "}")
    stages = [st]
    # trailing \text{...} dropped when something remains
    t = strip(rx(s, r"\\text\{.*?\}$"))
    stages.append(f"CASE WHEN {t} <> '' AND {t} <> {s} THEN {t} ELSE {s} END")
    if not skip_unit:
        stages.append(remove_units_sql(s))
    st = rep(rep(s, "^{\\circ}"), "^\\circ")
    st = rep(rep(st, "\\$"), "$")
    st = rep(rep(st, "\\("), "\\)")
    stages.append(st)
    stages.append(word_number_sql(s))
    st = rx(s, r"\\text\{(.*?)\}", "$1")
    for key in ["x=", "y=", "z=", "x\\in", "y\\in", "z\\in", "x\\to", "y\\to", "z\\to"]:
        st = rep(st, key)
    st = rep(st, "\\emptyset", "{}")
    st = rep(st, "(-\\infty,\\infty)", "\\mathbb{R}")
    st = rep(rep(st, "\\%"), "%")
    st = rep(rep(st, " .", " 0."), "{.", "{0.")
    st = rep(st, "infinity", "\\infty")
    stages.append(st)
    st = f"CASE WHEN instr({s}, {q(chr(92) + 'infty')}) > 0 THEN {s} ELSE {rep(s, 'inf', chr(92) + 'infty')} END"
    st = rep(st, "+\\inity", "\\infty")
    st = rep(rep(st, "and"), "\\mathbf")
    st = rx(st, r"\\mbox\{.*?\}")
    stages.append(st)
    stages.append(f"CASE WHEN instr({s}, 'j') > 0 AND instr({s}, 'i') = 0 THEN replace({s}, 'j', 'i') ELSE {s} END")
    stages.append(rx(rx(s, r"(?U)(\d+)\.0*([^\d])", "$1$2"), r"(?U)(\d+)\.0*$", "$1"))
    stages.append(f"CASE WHEN startswith({s}, '.') THEN concat('0', {s}) ELSE {s} END")
    stages.append(f"CASE WHEN {s} RLIKE '^[^=]{{0,2}}=[^=]*$' THEN substring_index({s}, '=', -1) ELSE {s} END")
    stages.append(rep(rx(s, r"(?U)\\sqrt(\w+)", r"\\sqrt{$1}"), " "))
    stages.append(fix_fracs_sql(s))
    stages.append(fix_a_slash_b_sql(s))
    return stages


def _merged_stages(col: str, skip_unit: bool) -> list[str]:
    """Stages whose expression reads the current value once are folded into the
    previous stage (no duplication); the others keep their own projection."""
    out: list[str] = []
    for stage in normalize_stages(col, skip_unit):
        if out and stage.count(col) == 1:
            out[-1] = stage.replace(col, f"({out[-1]})")
        else:
            out.append(stage)
    return out


# Plain integers: the whole chain only strips leading zeros of unsigned ones.
_PLAIN_INT = r"\A-?[0-9]+\z"


def normalize_answers(df: DataFrame, src: str, dst: str, skip_unit: bool = False) -> DataFrame:
    """E7 ``strip_string``: add column ``dst`` with the normalised text of ``src``.

    Plain integers (the common answer) take an exact shortcut; every other
    value runs the ordered stages.
    """
    t, fast = "__norm", "__plain"
    df = df.withColumns({t: F.coalesce(F.col(src).cast("string"), F.lit("")), fast: F.coalesce(F.col(src).cast("string"), F.lit("")).rlike(_PLAIN_INT)})
    for stage in _merged_stages(f"`{t}`", skip_unit):
        df = df.withColumn(t, F.expr(f"CASE WHEN `{fast}` THEN `{t}` ELSE {stage} END"))
    final = F.expr(f"CASE WHEN `{fast}` AND `{t}` RLIKE '^[0-9]+$' THEN regexp_replace(`{t}`, '^0+(?=[0-9])', '') ELSE `{t}` END")
    df = df.withColumn(dst, final) if src != dst else df.drop(src).withColumn(dst, final)
    return df.drop(t, fast)


__all__ = ["WS", "normalize_answers", "normalize_stages", "unit_table_sql"]
