"""Arithmetic on answer text with native expressions: linear equations (F8) and products of numbers.

Both read a small grammar exactly and leave everything else alone: NULL means the
text is not of that form, or its numbers go beyond what DECIMAL(38,0) or exact
doubles hold.
"""

from __future__ import annotations

from coverlens.functions.sql import let, q, rep

_NUM = r"[0-9]{1,12}(?:\.[0-9]{1,6})?"
_TERM = rf"(?:{_NUM}(?:/[0-9]{{1,9}})?(?:\*?[a-zA-Z](?:/[0-9]{{1,9}})?)?|[a-zA-Z](?:/[0-9]{{1,9}})?)"
_SIDE = rf"^[+-]?{_TERM}(?:[+-]{_TERM})*$"
_FRACTION = r"\\[dt]?frac\{(-?[0-9]+)\}\{([0-9]+)\}"


def _plain(x: str) -> str:
    """Blanks away, fractions as ``a/b``, multiplication signs as ``*``."""
    x = f"regexp_replace({x}, {q(_FRACTION)}, '$1/$2')"
    for sign in ("\\cdot", "\\times"):
        x = rep(x, sign, "*")
    return f"replace(regexp_replace({x}, '[\\\\s]+', ''), '+-', '-')"


def linear_equal_sql(a: str, b: str) -> str:
    """F8: whether two equations with linear sides have equal differences of their sides, up to sign.

    Each term becomes (variable or '', coefficient times 10^6, denominator); all
    coefficients are brought to one denominator and compared as whole numbers, for each
    variable and the constant.  NULL where a side has another form, a denominator is
    zero, or a number does not fit.
    """
    dec = "DECIMAL(38,0)"
    number = f"regexp_extract(t, {q(rf'^[+-]?({_NUM})')}, 1)"
    below = " * ".join(f"coalesce(try_cast(regexp_extract(t, {q(p)}, 1) AS DECIMAL(18,0)), 1)" for p in (rf"^[+-]?{_NUM}/([0-9]+)", r"[a-zA-Z]/([0-9]+)"))
    n = f"CASE WHEN startswith(t, '-') THEN -side.sign ELSE side.sign END * CAST(coalesce(try_cast({number} AS DECIMAL(20,6)), 1) * 1000000 AS {dec})"
    made = f"named_struct('v', regexp_extract(t, '([a-zA-Z])', 1), 'n', CAST({n} AS {dec}), 'd', CAST({below} AS {dec}))"
    terms = f"CASE WHEN side.s RLIKE {q(_SIDE)} THEN transform(regexp_extract_all(side.s, {q('[+-]?' + _TERM)}, 0), t -> {made}) END"
    sides = f"array(named_struct('s', {_plain("substring_index(e, '=', 1)")}, 'sign', 1), named_struct('s', {_plain("substring_index(e, '=', -1)")}, 'sign', -1))"
    parsed = f"transform(array({a}, {b}), e -> flatten(transform({sides}, side -> {terms})))"

    def body(v: dict[str, str]) -> str:
        part = f"CAST(try_multiply(t.n, CAST(m / t.d AS {dec})) AS {dec})"
        sums = f"transform({v['e']}, e -> aggregate(filter(e, t -> t.v = x), CAST(0 AS {dec}), (s, t) -> CAST(try_add(s, {part}) AS {dec})))"
        every = f"flatten({v['e']})"
        whole = f"aggregate({every}, CAST(1 AS {dec}), (s, t) -> CAST(try_multiply(s, t.d) AS {dec}))"
        pairs = f"element_at(transform(array({whole}), m -> transform(array_distinct(transform({every}, t -> t.v)), x -> {sums})), 1)"
        verdict = let({"c": pairs}, lambda w: (
            f"CASE WHEN exists({w['c']}, c -> c[0] IS NULL OR c[1] IS NULL) THEN NULL "
            f"ELSE forall({w['c']}, c -> c[0] = c[1]) OR forall({w['c']}, c -> c[0] = -c[1]) END"))
        return f"CASE WHEN exists({every}, t -> t.d = 0) THEN NULL ELSE {verdict} END"

    return let({"e": parsed}, lambda v: f"CASE WHEN {v['e']}[0] IS NOT NULL AND {v['e']}[1] IS NOT NULL THEN {body(v)} END")


_FACTOR = r"-?[0-9]{1,15}(?:\.[0-9]{1,15})?(?:\^-?[0-9]{1,3})?"
_PRODUCT = rf"^{_FACTOR}(?:[*/]{_FACTOR})*$"


def product_value_sql(x: str) -> str:
    """A number, or numbers multiplied and divided from left to right, some with whole exponents, as text.

    Whole results of whole numbers stay whole, others are written as the shortest
    decimal.  NULL for another form, a division by zero, and results that a double
    does not hold exactly enough to be told apart.
    """
    plain = f"regexp_replace({_plain(x)}, {q(r'\^\{(-?[0-9]+)\}')}, {q('^$1')})"

    def body(v: dict[str, str]) -> str:
        p = v["p"]
        factor = rf"[*/]?{_FACTOR}"
        base = f"CAST(regexp_extract(f, {q(r'^[*/]?(-?[0-9.]+)')}, 1) AS DOUBLE)"
        power = f"regexp_extract(f, {q(r'\^(-?[0-9]+)$')}, 1)"
        exponent = f"CASE WHEN {power} = '' THEN 1 ELSE CAST({power} AS INT) END"
        up = f"(startswith(f, '/') = ({exponent} < 0))"
        # a minus before a power binds less than the power does
        value = f"CASE WHEN startswith(ltrim('*/', f), '-') THEN -1.0D ELSE 1.0D END * pow(abs({base}), abs({exponent}))"
        step = f"named_struct('n', CASE WHEN {up} THEN s.n * {value} ELSE s.n END, 'd', CASE WHEN {up} THEN s.d ELSE s.d * {value} END)"
        nd = f"aggregate(regexp_extract_all({p}, {q(factor)}, 0), named_struct('n', 1.0D, 'd', 1.0D), (s, f) -> {step})"
        return f"CASE WHEN {p} RLIKE {q(_PRODUCT)} THEN {let({'r': nd}, lambda w: _shown(p, w['r']))} END"

    return let({"p": plain}, body)


def _shown(p: str, r: str) -> str:
    big = "9007199254740992D"
    whole = f"(instr({p}, '.') = 0 AND {r}.n % {r}.d = 0)"
    text = let({"v": f"{r}.n / {r}.d"}, lambda v: (
        f"CASE WHEN {v['v']} = 0 THEN '0.0' WHEN abs({v['v']}) < 1e-4D OR abs({v['v']}) >= 1e15D THEN NULL "
        f"WHEN {v['v']} = floor({v['v']}) THEN concat(CAST(CAST({v['v']} AS BIGINT) AS STRING), '.0') "
        f"ELSE rtrim('0', CAST(CAST({v['v']} AS DECIMAL(38,20)) AS STRING)) END"))
    return (
        f"CASE WHEN {r}.d = 0 OR abs({r}.n) >= {big} OR abs({r}.d) >= {big} THEN NULL "
        f"WHEN {whole} THEN CAST(CAST({r}.n / {r}.d AS BIGINT) AS STRING) ELSE {text} END"
    )
