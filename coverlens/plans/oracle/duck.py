"""DuckDB SQL for the oracle side of the correctness gate.

It shares the fixed lists with the Spark builders, and follows the same
reading of the rules; what guards that reading are the hand-derived rows of
tests/test_golden.py.  RE2 regexes (ASCII ``\\W``/``\\d``), list lambdas.
Each builder takes DuckDB SQL text and returns DuckDB SQL text; stage chains
become nested ``SELECT * REPLACE`` sub-queries.
"""

from __future__ import annotations

from coverlens.functions.fixed_values import NUMBER_WORDS, UNIT_TEXTS_WITH_PLURALS

#: Python's blanks by code point.
WS = "(" + " || ".join(f"chr({c})" for c in [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]) + ")"
NL = "chr(10)"


def s(text: str) -> str:
    """DuckDB string literal (no escape processing; quotes doubled)."""
    return "'" + text.replace("'", "''") + "'"


def strip(x: str, chars: str = WS) -> str:
    return f"trim({x}, {chars})"


def rep(x: str, old: str, new: str = "") -> str:
    return f"replace({x}, {s(old)}, {s(new)})"


def rx(x: str, pat: str, repl: str = "") -> str:
    return f"regexp_replace({x}, {s(pat)}, {s(repl)}, 'g')"


def has(x: str, needle: str) -> str:
    return f"(strpos({x}, {s(needle)}) > 0)"


def after_first(x: str, d: str) -> str:
    return f"substr({x}, strpos({x}, {s(d)}) + {len(d)})"


def after_last(x: str, d: str) -> str:
    return f"string_split({x}, {s(d)})[-1]"


def before_first(x: str, d: str) -> str:
    return f"string_split({x}, {s(d)})[1]"


def stages(source: str, col: str, exprs: list[str]) -> str:
    """Nest ``SELECT * REPLACE (expr AS col)`` for each stage over ``source``."""
    q = source
    for e in exprs:
        q = f"SELECT * REPLACE ({e} AS {col}) FROM ({q})"
    return q


# ---------------------------------------------------------------- extraction

def closing(x: str) -> str:
    """Place in ``x`` (which begins with a brace) of the brace that closes the first one, NULL if none does: running depth over the characters."""
    chars = f"string_split({x}, '')"
    depth = f"list_transform(range(1, len({chars}) + 1), lambda i: len(list_filter({chars}[1:i], lambda c: c = '{{')) - len(list_filter({chars}[1:i], lambda c: c = '}}')))"
    return f"list_position({depth}, 0)"


def boxed(text: str) -> str:
    ans = after_last(text, "boxed")
    end = closing(ans)
    return (
        f"CASE WHEN starts_with({ans}, '{{') THEN substr({ans}, 2, coalesce({end} - 2, length({ans}))) "
        f"ELSE {strip(before_first(ans, '$'))} END"
    )


def last_number(text: str) -> str:
    return f"coalesce(regexp_extract_all({rep(text, ',')}, {s(r'-?\d*\.?\d+')}, 0)[-1], '')"


def code_output(text: str) -> str:
    blocks = f"regexp_extract_all({text}, {s(r'(?s)<llm-code-output>(.*?)</llm-code-output>')}, 1)"
    return strip(f"{blocks}[-1]")


def text_branch(r: str) -> tuple[str, str]:
    minerva = f"({has(r, 'final answer is $')} AND {has(r, '$. I hope')})"
    cases = [
        (minerva, "minerva", strip(before_first(after_first(r, "final answer is $"), "$. I hope"))),
        (has(r, "boxed"), "boxed", boxed(r)),
        (has(r, "he answer is"), "answer_is", strip(after_last(r, "he answer is"))),
        (has(r, "final answer is"), "final_answer_is", strip(after_last(r, "final answer is"))),
        (has(r, "答案是"), "zh_answer", strip(f"string_split({strip(f'string_split({r}, {s("答案是")})[2]')}, {NL} || {NL})[1]")),
    ]
    branch = "CASE " + " ".join(f"WHEN {c} THEN '{b}'" for c, b, _ in cases) + " ELSE 'last_number' END"
    raw = "CASE " + " ".join(f"WHEN {c} THEN {a}" for c, _, a in cases) + f" ELSE {last_number(r)} END"
    return branch, raw


def clean(pred: str) -> str:
    p = rx(pred, r"\n\s*")
    p = f"CASE WHEN starts_with({p}, ':') THEN substr({p}, 2) ELSE {p} END"
    p = f"CASE WHEN ends_with({p}, '.') THEN left({p}, length({p}) - 1) ELSE {p} END"
    return f"CASE WHEN ends_with({p}, '/') THEN left({p}, length({p}) - 1) ELSE {p} END"


# ------------------------------------------------------------- normalisation

def _units_list() -> str:
    items = []
    for u in UNIT_TEXTS_WITH_PLURALS:
        needle = max(u.split("."), key=len)
        items.append("{'needle': " + s(needle) + ", 'pat': " + s(r"(^|\W)" + u + r"($|\W)") + "}")
    one = ", ".join(items)
    return f"[{one}, {one}]"


UNITS = _units_list()


def _let(name: str, value: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def _formation(a: str) -> str:
    return (
        f"(CASE len({a}) WHEN 4 THEN {a}[1] * {a}[2] + {a}[3] + {a}[4] WHEN 3 THEN {a}[1] * {a}[2] + {a}[3] "
        f"WHEN 2 THEN CASE WHEN list_contains({a}, 100) THEN {a}[1] * {a}[2] ELSE {a}[1] + {a}[2] END WHEN 1 THEN {a}[1] END)"
    )


def _words_value(w: str) -> str:
    """Value of a list of number words' values: billions, millions, thousands and the rest."""
    at = lambda x: f"coalesce(list_position({w}, {x}), 0)"
    b, m, t = at(1000000000), at(1000000), at(1000)
    times = lambda x: f"len(list_filter({w}, lambda y: y = {x}))"
    last = f"greatest({b}, {m}, {t})"
    return (
        f"(CASE WHEN len({w}) = 0 OR {times(1000)} > 1 OR {times(1000000)} > 1 OR {times(1000000000)} > 1 "
        f"OR ({t} > 0 AND ({t} < {m} OR {t} < {b})) OR ({m} > 0 AND {m} < {b}) THEN NULL WHEN len({w}) = 1 THEN {w}[1] ELSE "
        f"CASE WHEN {b} > 0 THEN {_formation(f'{w}[1:{b} - 1]')} * 1000000000 ELSE 0 END "
        f"+ CASE WHEN {m} > 0 THEN {_formation(f'{w}[{b} + 1:{m} - 1]')} * 1000000 ELSE 0 END "
        f"+ CASE WHEN {t} > 0 THEN {_formation(f'{w}[greatest({b}, {m}) + 1:{t} - 1]')} * 1000 ELSE 0 END "
        f"+ CASE WHEN {last} = len({w}) THEN 0 ELSE {_formation(f'{w}[{last} + 1:]')} END END)"
    )


def word_number(c: str) -> str:
    """Digit-only text and number words, as integers or decimals."""
    w = f"lower(replace({c}, '-', ' '))"
    keys = "[" + ", ".join(s(k) for k in NUMBER_WORDS) + "]"
    vals = "[" + ", ".join(f"{v}::BIGINT" for v in NUMBER_WORDS.values()) + "]"
    found = f"list_transform(list_filter(regexp_split_to_array({strip(w)}, '\\s+'), lambda t: list_contains({keys}, t)), lambda t: {vals}[list_position({keys}, t)])"
    p = "coalesce(list_position(nw.n, -1), 0)"
    digits = f"nw.n[{p} + 1:]"
    tail = f"coalesce(nullif(regexp_replace(array_to_string(list_transform({digits}, lambda d: CAST(d AS VARCHAR)), ''), '0+$', ''), ''), '0')"
    spelt = (
        f"CASE WHEN {p} = 0 THEN CAST({_words_value('nw.n')} AS VARCHAR) "
        f"WHEN len(list_filter(nw.n, lambda y: y = -1)) > 1 OR len(list_filter({digits}, lambda y: y > 9)) > 0 OR len({digits}) = 0 THEN NULL "
        f"ELSE coalesce(CAST({_words_value(f'nw.n[1:{p} - 1]')} AS VARCHAR), CASE WHEN {p} = 1 THEN '0' END) || '.' || {tail} END"
    )
    value = _let("nw", f"{{'n': {found}}}", spelt)
    return f"CASE WHEN regexp_full_match({w}, '[0-9]+') THEN regexp_replace({w}, '^0+([0-9])', '\\1') ELSE coalesce({value}, {c}) END"


def normalize_exprs(c: str, skip_unit: bool = False) -> list[str]:
    x = strip(c)
    x = rep(x, "\n")
    x = f"rtrim({x}, '.')"
    x = rep(x, "\\!")
    x = rx(x, r"\\begin\{array\}\{.*?\}", r"\\begin{pmatrix}")
    x = rx(x, r"\\end\{array\}", r"\\end{pmatrix}")
    x = rep(x, "bmatrix", "pmatrix")
    x = rep(rep(x, "tfrac", "frac"), "dfrac", "frac")
    x = rep(rep(rep(x, "\\neq", "\\ne"), "\\leq", "\\le"), "\\geq", "\\ge")
    x = rep(rep(x, "\\left"), "\\right")
    x = rep(rep(x, "\\{", "{"), "\\}", "}")
    out = [x]
    t = strip(rx(c, r"\\text\{.*?\}$"))
    out.append(f"CASE WHEN {t} <> '' AND {t} <> {c} THEN {t} ELSE {c} END")
    if not skip_unit:
        fold = (
            f"list_reduce({UNITS}, lambda acc, u: CASE WHEN strpos(acc, u.needle) > 0 THEN "
            f"coalesce(nullif(regexp_replace(acc, u.pat, '\\1\\2', 'g'), ''), acc) ELSE acc END, {c})"
        )
        out.append(f"CASE WHEN regexp_matches({c}, '[^\\x00-\\x40\\x5b-\\x60\\x7b-\\x7f]') THEN {fold} ELSE {c} END")
    x = rep(rep(c, "^{\\circ}"), "^\\circ")
    x = rep(rep(x, "\\$"), "$")
    x = rep(rep(x, "\\("), "\\)")
    out.append(x)
    out.append(word_number(c))
    x = rx(c, r"\\text\{(.*?)\}", r"\1")
    for key in ["x=", "y=", "z=", "x\\in", "y\\in", "z\\in", "x\\to", "y\\to", "z\\to"]:
        x = rep(x, key)
    x = rep(x, "\\emptyset", "{}")
    x = rep(x, "(-\\infty,\\infty)", "\\mathbb{R}")
    x = rep(rep(x, "\\%"), "%")
    x = rep(rep(x, " .", " 0."), "{.", "{0.")
    x = rep(x, "infinity", "\\infty")
    out.append(x)
    x = f"CASE WHEN strpos({c}, '\\infty') > 0 THEN {c} ELSE {rep(c, 'inf', chr(92) + 'infty')} END"
    x = rep(x, "+\\inity", "\\infty")
    x = rep(rep(x, "and"), "\\mathbf")
    x = rx(x, r"\\mbox\{.*?\}")
    out.append(x)
    out.append(f"CASE WHEN strpos({c}, 'j') > 0 AND strpos({c}, 'i') = 0 THEN replace({c}, 'j', 'i') ELSE {c} END")
    out.append(rx(rx(c, r"(\d+)\.0*([^\d])", r"\1\2"), r"(\d+)\.0*$", r"\1"))
    out.append(f"CASE WHEN starts_with({c}, '.') THEN '0' || {c} ELSE {c} END")
    out.append(f"CASE WHEN regexp_full_match({c}, '[^=]{{0,2}}=[^=]*') THEN string_split({c}, '=')[2] ELSE {c} END")
    out.append(rep(rx(c, r"\\sqrt(\w+)", r"\\sqrt{\1}"), " "))
    abort = f"regexp_matches({c}, {s(r'\\frac(?:\\frac|$)|\\frac[^{](?:\\frac|$)')})"
    fixed = rx(rx(c, r"(?s)\\frac([^{])\{", r"\\frac{\1}{"), r"(?s)\\frac([^{])([^{])", r"\\frac{\1}{\2}")
    out.append(f"CASE WHEN {abort} THEN {c} ELSE {fixed} END")
    canon = r"(0|-?[1-9][0-9]*|[^/]*sqrt[^/]*)"
    out.append(f"regexp_replace({c}, {s('^' + canon + '/' + canon + '$')}, {s(r'\\frac{\1}{\2}')})")
    return out


# ------------------------------------------------------------------- grading

FLOAT = (
    r"^\s*[+-]?(?:(?:[0-9](?:_?[0-9])*(?:\.(?:[0-9](?:_?[0-9])*)?)?|\.[0-9](?:_?[0-9])*)"
    r"(?:[eE][+-]?[0-9](?:_?[0-9])*)?|(?i:inf|infinity|nan))\s*$"
)


def py_float(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, {s(FLOAT)}) THEN TRY_CAST(replace({strip(x)}, '_', '') AS DOUBLE) END"


def parse_digits(c: str) -> str:
    x = rep(c, ",")
    body = f"regexp_replace(regexp_replace({x}, '%$', ''), '\\\\$', '')"
    return f"coalesce({py_float(x)}, CASE WHEN ends_with({x}, '%') THEN {py_float(body)} / 100.0 END)"


def is_close(a: str, b: str) -> str:
    return (
        f"(CASE WHEN {a} IS NULL OR {b} IS NULL OR isnan({a}) OR isnan({b}) THEN false WHEN {a} = {b} THEN true "
        f"WHEN isinf({a}) OR isinf({b}) THEN false ELSE abs({a} - {b}) <= greatest(abs({a} * 1e-4), abs({b} * 1e-4)) END)"
    )


def choice_clean(p: str) -> str:
    x = f"ltrim(trim(rtrim(rtrim({strip(p, NL)}, '.'), '/'), ' '), ':')"
    letters = f"regexp_extract_all(upper({x}), '\\b(A|B|C|D|E)\\b', 1)"
    picked = f"CASE WHEN len({letters}) > 0 THEN {letters}[-1] ELSE trim({strip(x)}, '.') END"
    return f"rtrim(rtrim({picked}, '.'), '/')"


def bracket_equal(p: str, r: str) -> str:
    outer = (
        f"((starts_with({p}, '[') AND ends_with({p}, ']') AND NOT starts_with({r}, '(')) OR "
        f"(starts_with({p}, '(') AND ends_with({p}, ')') AND NOT starts_with({r}, '[')))"
    )
    ps = f"CASE WHEN {outer} THEN trim({p}, '[]()') ELSE {p} END"
    rs = f"CASE WHEN {outer} THEN trim({r}, '[]()') ELSE {r} END"
    return f"(lower(translate({ps}, '{{}}()', '')) = lower(translate({rs}, '{{}}()', '')))"


FRAC = r"^(-?)\\frac\{([^{}]+)\}\{([^{}]+)\}$"
SLASH = r"^([^/]+)/([^/]+)$"


def fraction_value(c: str) -> str:
    x = strip(c)
    sign = f"CASE WHEN regexp_extract({x}, {s(FRAC)}, 1) = '-' THEN -1.0 ELSE 1.0 END"
    num, den = py_float(f"regexp_extract({x}, {s(FRAC)}, 2)"), py_float(f"regexp_extract({x}, {s(FRAC)}, 3)")
    a, b = py_float(f"regexp_extract({x}, {s(SLASH)}, 1)"), py_float(f"regexp_extract({x}, {s(SLASH)}, 2)")
    return (
        f"coalesce({py_float(x)}, CASE WHEN regexp_matches({x}, {s(FRAC)}) THEN {sign} * (CASE WHEN {den} <> 0 THEN {num} / {den} END) END, "
        f"CASE WHEN regexp_matches({x}, {s(SLASH)}) THEN (CASE WHEN {b} <> 0 THEN {a} / {b} END) END)"
    )


def element_equal(p: str, r: str) -> str:
    pv, rv = parse_digits(p), parse_digits(r)
    ps, rs = strip(p), strip(r)
    numeric = f"({is_close(pv, rv)} OR {is_close(pv, f'({rv} / 100.0)')} OR {is_close(pv, f'({rv} * 100.0)')})"
    return (
        f"(CASE WHEN lower({ps}) = lower({rs}) THEN true "
        f"WHEN {r} IN ('A', 'B', 'C', 'D', 'E') AND {choice_clean(p)} = {r} THEN true "
        f"WHEN {pv} IS NOT NULL AND {rv} IS NOT NULL THEN {numeric} "
        f"WHEN {p} = '' THEN false WHEN {bracket_equal(ps, rs)} THEN true "
        f"ELSE coalesce({is_close(fraction_value(ps), fraction_value(rs))}, false) END)"
    )


def side_equal(a: str, b: str) -> str:
    """Sides of two equations: the same text, or exactly the same number."""
    return f"({a} = {b} OR coalesce({fraction_value(a)} = {fraction_value(b)}, false))"


def grade_query(source: str, pred: str = "pred_answer", gt: str = "gt_norm") -> str:
    """Adds ``tier`` and ``is_correct`` (F10) to the rows of ``source``."""
    early = (
        f"CASE WHEN {pred} IS NULL OR {gt} IS NULL THEN 'null' "
        f"WHEN lower({strip(pred)}) = lower({strip(gt)}) THEN 'exact' "
        f"WHEN {gt} IN ('A', 'B', 'C', 'D', 'E') AND {choice_clean(pred)} = {gt} THEN 'choice' "
        f"WHEN __pv IS NOT NULL AND __rv IS NOT NULL THEN (CASE WHEN {is_close('__pv', '__rv')} THEN 'numeric' "
        f"WHEN {is_close('__pv', '(__rv / 100.0)')} OR {is_close('__pv', '(__rv * 100.0)')} THEN 'numeric_percent' "
        f"ELSE 'numeric_mismatch' END) WHEN {pred} = '' THEN 'empty' END"
    )
    p, r = "__p", "__r"
    tuple_shape = f"(regexp_matches({p}, '^[(\\[].+[)\\]]') AND regexp_matches({r}, '^[(\\[].+[)\\]]'))"
    pp = f"string_split(substr({p}, 2, length({p}) - 2), ',')"
    rp = f"string_split(substr({r}, 2, length({r}) - 2), ',')"
    tuple_ok = (
        f"({tuple_shape} AND len({pp}) = len({rp}) AND "
        f"list_bool_and(list_transform(range(1, len({pp}) + 1), lambda i: {element_equal(f'{pp}[i]', f'{rp}[i]')})))"
    )
    mat = lambda x: f"(regexp_matches({x}, '^\\\\begin\\{{[pb]matrix\\}}') AND regexp_matches({x}, '\\\\end\\{{[pb]matrix\\}}$'))"
    lines = lambda x: f"list_filter(list_transform(string_split(substr({x}, 16, length({x}) - 28), '\\\\'), lambda l: {strip('l')}), lambda l: l <> '')"
    pl, rl = lines(p), lines(r)
    cells = lambda x: f"string_split({x}, '&')"
    row_ok = (
        f"len({cells(pl + '[i]')}) = len({cells(rl + '[i]')}) AND list_bool_and(list_transform(range(1, len({cells(pl + '[i]')}) + 1), "
        f"lambda j: {element_equal(cells(pl + '[i]') + '[j]', cells(rl + '[i]') + '[j]')}))"
    )
    matrix_ok = f"({mat(p)} AND {mat(r)} AND len({pl}) = len({rl}) AND list_bool_and(list_transform(range(1, len({pl}) + 1), lambda i: {row_ok})))"
    eq = lambda x: f"(length({x}) - length(replace({x}, '=', '')))"
    lhs = lambda x: strip(f"string_split({x}, '=')[1]")
    rhs = lambda x: strip(f"string_split({x}, '=')[-1]")
    pair_ok = f"(({side_equal(lhs(p), lhs(r))} AND {side_equal(rhs(p), rhs(r))}) OR ({side_equal(lhs(p), rhs(r))} AND {side_equal(rhs(p), lhs(r))}))"
    side_ok = (
        f"(CASE WHEN {eq(p)} = 1 AND length({lhs(p)}) <= 2 AND {eq(r)} = 0 THEN {element_equal(f'string_split({p}, {s(chr(61))})[-1]', r)} "
        f"WHEN {eq(r)} = 1 AND length({lhs(r)}) <= 2 AND {eq(p)} = 0 THEN {element_equal(p, f'string_split({r}, {s(chr(61))})[-1]')} ELSE false END)"
    )
    late = (
        f"CASE WHEN {bracket_equal(p, r)} THEN 'bracket' WHEN coalesce({tuple_ok}, false) THEN 'tuple' "
        f"WHEN coalesce({matrix_ok}, false) THEN 'matrix' "
        f"WHEN {eq(p)} = 1 AND {eq(r)} = 1 AND {pair_ok} THEN 'equation_pair' "
        f"WHEN NOT ({eq(p)} = 1 AND {eq(r)} = 1) AND {side_ok} THEN 'equation_side' "
        f"WHEN coalesce({is_close(fraction_value(p), fraction_value(r))}, false) THEN 'fraction_value' ELSE 'residual' END"
    )
    to_pm = (
        f"CASE WHEN regexp_extract({strip('__r0')}, '\\{{.*,.*\\}}', 0) <> '' THEN "
        f"'\\begin{{pmatrix}}' || replace(trim(regexp_extract({strip('__r0')}, '\\{{.*,.*\\}}', 0), '{{}}'), ',', '\\') || '\\end{{pmatrix}}' ELSE '' END"
    )
    return f"""
SELECT * EXCLUDE (__pv, __rv, __early, __p, __r, __r0),
       tier NOT IN ('null', 'numeric_mismatch', 'empty', 'residual') AS is_correct
FROM (
  SELECT *, coalesce(__early, {late}) AS tier
  FROM (
    SELECT *, CASE WHEN strpos(__p, 'pmatrix') > 0 AND strpos(__r0, 'pmatrix') = 0 THEN {to_pm} ELSE __r0 END AS __r
    FROM (
      SELECT *, {early} AS __early, {strip(pred)} AS __p, {strip(gt)} AS __r0
      FROM (SELECT *, {parse_digits(pred)} AS __pv, {parse_digits(gt)} AS __rv FROM ({source}))
    )
  )
)"""


# ------------------------------------------------------------------ fixtures

GENERATIONS = r"""
SELECT user_id AS question_id, user_id AS prompt_id, event_id AS sample_id, event_type AS run, 'all' AS split,
       CAST(user_id * 7 + 3 AS VARCHAR) AS gt_answer,
       CASE CAST(event_id % 12 AS INTEGER)
         WHEN 0 THEN 'The result is \boxed{' || CAST(user_id * 7 + 3 AS VARCHAR) || '}.'
         WHEN 1 THEN 'So \boxed{\frac{' || CAST((user_id * 7 + 3) * 2 AS VARCHAR) || '}{2}} done'
         WHEN 2 THEN 'So the answer is ' || CAST(user_id * 7 + 3 AS VARCHAR) || '.'
         WHEN 3 THEN 'The final answer is $' || CAST(user_id * 7 + 3 AS VARCHAR) || '$. I hope it is correct.'
         WHEN 4 THEN 'My final answer is ' || CAST(user_id * 7 + 3 AS VARCHAR) || '%'
         WHEN 5 THEN '答案是 ' || CAST(user_id * 7 + 4 AS VARCHAR)
         WHEN 6 THEN 'First 5, then 9 and last ' || CAST(user_id * 7 + 3 AS VARCHAR) || ' apples'
         WHEN 7 THEN 'Wrong \boxed{' || CAST(user_id * 7 + 4 AS VARCHAR) || '}'
         WHEN 8 THEN '<think>maybe \boxed{0}</think> so \boxed{' || CAST(user_id * 7 + 3 AS VARCHAR) || '}'
         WHEN 9 THEN 'no idea'
         WHEN 10 THEN '<llm-code>' || chr(10) || 'x = 1' || chr(10) || 'x' || chr(10) || '</llm-code>' || chr(10)
                      || '<llm-code-output>' || chr(10) || CAST(user_id * 7 + 3 AS VARCHAR) || chr(10) || '</llm-code-output>'
         ELSE 'Hence $\boxed ' || CAST((user_id * 7 + 3) * 100 AS VARCHAR) || '$ ok'
       END AS response
FROM events
"""


def processed_generations() -> str:
    """extract -> normalise prediction and truth -> grade, over the fixture."""
    branch, raw = text_branch(rep("response", "ки"))
    base = f"""
SELECT *, CASE WHEN mode = 'code' THEN (CASE WHEN starts_with(coalesce({code_output('response')}, ''), 'ERROR:') THEN ''
             ELSE coalesce({code_output('response')}, '') END) ELSE {raw} END AS raw_answer,
          CASE WHEN mode = 'code' THEN 'code_output' ELSE {branch} END AS branch
FROM (SELECT *, CASE WHEN {has('response', '<llm-code>')} THEN 'code' ELSE 'nl' END AS mode,
             CAST(len(regexp_extract_all(response, '\\S+', 0)) AS INTEGER) AS response_len
      FROM ({GENERATIONS}))"""
    cleaned = f"SELECT *, CASE WHEN mode = 'code' THEN raw_answer ELSE {clean('raw_answer')} END AS __n FROM ({base})"
    normed = stages(cleaned, "__n", normalize_exprs("__n"))
    with_pred = f"SELECT * EXCLUDE (__n), CASE WHEN mode = 'code' THEN raw_answer ELSE __n END AS pred_answer FROM ({normed})"
    with_gt = f"SELECT *, gt_answer AS gt_norm FROM ({with_pred})"
    with_gt = stages(with_gt, "gt_norm", normalize_exprs("gt_norm"))
    graded = grade_query(with_gt)
    return f"SELECT * EXCLUDE (response), length(pred_answer) > 0 AS is_valid FROM ({graded})"


OUTCOMES = """
SELECT user_id AS question_id, user_id AS prompt_id, event_id AS sample_id, event_type AS run, 'all' AS split,
       'set' || CAST(user_id % 3 AS VARCHAR) AS subset, CAST(pow(2, event_id % 5) AS INTEGER) AS epoch,
       CASE WHEN user_id % 2 = 0 THEN 'forward' ELSE 'reverse' END AS direction,
       NOT (event_id % 12 IN (5, 7, 9)) AS is_correct
FROM events
"""

ROLLOUTS = """
SELECT event_id, user_id AS question_id,
       CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) / 4) AS INTEGER) AS grp,
       CASE WHEN event_id % 12 IN (1, 5, 7, 9) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS reward,
       CASE WHEN value > 100 THEN 'length' ELSE 'stop' END AS finish_reason,
       CAST(day(ts) AS INTEGER) AS iteration, CAST(1 + event_id % 9 AS INTEGER) AS resp_len
FROM events
"""

TOKENS = """
SELECT l_orderkey AS seq_id, l_linenumber AS pos, CAST(l_shipdate AS DATE) AS iteration, -l_discount AS logp,
       -l_tax AS ref_logp, l_quantity - 25 AS adv, CAST(l_linestatus = 'O' AS INTEGER) AS mask
FROM lineitem
"""

BATCHES = """
SELECT event_id AS seq_id, CAST(floor(event_id / 16) AS BIGINT) AS batch,
       CAST(range(1, CAST(2 + user_id % 3 AS BIGINT)) AS INTEGER[]) AS query_ids,
       CAST(range(1, CAST(2 + event_id % 4 AS BIGINT)) AS INTEGER[]) AS response_ids,
       round((value - 50) / 100, 6) AS advantage
FROM events
"""

TEST_GRADES = """
SELECT l_partkey AS task_id, l_orderkey AS gen_id, l_linenumber AS test_id, CAST(l_quantity > 5 AS INTEGER) AS grade
FROM lineitem
"""


def reward_boxed(text: str) -> str:
    """E9 in DuckDB: after the first </think> (to a second one), last \\boxed{...}."""
    body = f"(CASE WHEN {has(text, '</think>')} THEN string_split({text}, '</think>')[2] ELSE {text} END)"
    tail = after_last(body, "\\boxed")
    end = closing(tail)
    group = f"CASE WHEN starts_with({tail}, '{{') AND {end} IS NOT NULL THEN substr({tail}, 2, {end} - 2) ELSE '' END"
    spaced = before_first(after_last(body, "\\boxed "), "$")
    return f"(CASE WHEN {has(body, chr(92) + 'boxed ')} THEN {spaced} WHEN {has(body, chr(92) + 'boxed')} THEN {group} ELSE '' END)"


def reward_int_match(text: str, target: str) -> str:
    ans = reward_boxed(text)
    as_int = f"CASE WHEN regexp_matches({ans}, {s(r'^\s*[+-]?[0-9](?:_?[0-9])*\s*$')}) THEN TRY_CAST(replace({strip(ans)}, '_', '') AS BIGINT) END"
    return f"(CASE WHEN abs(CAST({as_int} AS DOUBLE) - TRY_CAST({target} AS DOUBLE)) < 1e-5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"


ANSWERS = r"""
SELECT p_partkey,
  CASE CAST(p_partkey % 10 AS INTEGER)
    WHEN 0 THEN CAST(p_size AS VARCHAR)
    WHEN 1 THEN CAST(p_size AS VARCHAR) || '%'
    WHEN 2 THEN '(' || CAST(p_size AS VARCHAR) || ',' || CAST(p_partkey AS VARCHAR) || ')'
    WHEN 3 THEN '[' || CAST(p_size AS VARCHAR) || ']'
    WHEN 4 THEN '\begin{pmatrix}' || CAST(p_size AS VARCHAR) || '&' || CAST(p_partkey % 7 AS VARCHAR) || '\\'
                || CAST(p_partkey % 5 AS VARCHAR) || '&' || CAST(p_partkey % 3 AS VARCHAR) || '\end{pmatrix}'
    WHEN 5 THEN 'x=' || CAST(p_size AS VARCHAR)
    WHEN 6 THEN 'y=' || CAST(p_size AS VARCHAR)
    WHEN 7 THEN '\frac{' || CAST(2 * p_size AS VARCHAR) || '}{2}'
    WHEN 8 THEN 'The answer is (' || chr(CAST(65 + p_partkey % 5 AS INTEGER)) || ')'
    ELSE CASE WHEN p_partkey % 20 = 9 THEN CAST(p_size + 1 AS VARCHAR) ELSE 'x^' || CAST(p_size AS VARCHAR) END
  END AS pred,
  CASE CAST(p_partkey % 10 AS INTEGER)
    WHEN 0 THEN CAST(p_size AS VARCHAR)
    WHEN 1 THEN '0.' || lpad(CAST(p_size AS VARCHAR), 2, '0')
    WHEN 2 THEN '(' || CAST(p_size AS VARCHAR) || ', ' || CAST(p_partkey + p_partkey % 2 AS VARCHAR) || ')'
    WHEN 3 THEN '{' || CAST(p_size AS VARCHAR) || '}'
    WHEN 4 THEN '\begin{pmatrix}' || CAST(p_size AS VARCHAR) || '&' || CAST(p_partkey % 7 AS VARCHAR) || '\\'
                || CAST(p_partkey % 5 AS VARCHAR) || '&'
                || CAST(p_partkey % 3 + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS VARCHAR) || '\end{pmatrix}'
    WHEN 5 THEN CAST(p_size AS VARCHAR)
    WHEN 6 THEN CAST(p_size AS VARCHAR) || '=y'
    WHEN 7 THEN CAST(p_size AS VARCHAR)
    WHEN 8 THEN chr(CAST(65 + p_partkey % 5 AS INTEGER))
    ELSE CAST(p_size AS VARCHAR)
  END AS gt
FROM part
"""


def tuple_ok(p: str, r: str) -> str:
    shape = f"(regexp_matches({p}, '^[(\\[].+[)\\]]') AND regexp_matches({r}, '^[(\\[].+[)\\]]'))"
    pp = f"string_split(substr({p}, 2, length({p}) - 2), ',')"
    rp = f"string_split(substr({r}, 2, length({r}) - 2), ',')"
    return (
        f"coalesce({shape} AND len({pp}) = len({rp}) AND "
        f"list_bool_and(list_transform(range(1, len({pp}) + 1), lambda i: {element_equal(f'{pp}[i]', f'{rp}[i]')})), false)"
    )


def matrix_ok(p: str, r: str) -> str:
    mat = lambda x: f"(regexp_matches({x}, '^\\\\begin\\{{[pb]matrix\\}}') AND regexp_matches({x}, '\\\\end\\{{[pb]matrix\\}}$'))"
    lines = lambda x: f"list_filter(list_transform(string_split(substr({x}, 16, length({x}) - 28), '\\\\'), lambda l: {strip('l')}), lambda l: l <> '')"
    pl, rl = lines(p), lines(r)
    cells = lambda x: f"string_split({x}, '&')"
    row = (
        f"len({cells(pl + '[i]')}) = len({cells(rl + '[i]')}) AND list_bool_and(list_transform(range(1, len({cells(pl + '[i]')}) + 1), "
        f"lambda j: {element_equal(cells(pl + '[i]') + '[j]', cells(rl + '[i]') + '[j]')}))"
    )
    return f"coalesce({mat(p)} AND {mat(r)} AND len({pl}) = len({rl}) AND list_bool_and(list_transform(range(1, len({pl}) + 1), lambda i: {row})), false)"


def _eqc(x: str) -> str:
    return f"(length({x}) - length(replace({x}, '=', '')))"


def pair_ok(p: str, r: str) -> str:
    lhs = lambda x: strip(f"string_split({x}, '=')[1]")
    rhs = lambda x: strip(f"string_split({x}, '=')[-1]")
    return (
        f"({_eqc(p)} = 1 AND {_eqc(r)} = 1 AND (({side_equal(lhs(p), lhs(r))} AND {side_equal(rhs(p), rhs(r))}) OR "
        f"({side_equal(lhs(p), rhs(r))} AND {side_equal(rhs(p), lhs(r))})))"
    )


def side_ok(p: str, r: str) -> str:
    lhs = lambda x: strip(f"string_split({x}, '=')[1]")
    return (
        f"(CASE WHEN {_eqc(p)} = 1 AND length({lhs(p)}) <= 2 AND {_eqc(r)} = 0 THEN {element_equal(f'string_split({p}, {s(chr(61))})[-1]', r)} "
        f"WHEN {_eqc(r)} = 1 AND length({lhs(r)}) <= 2 AND {_eqc(p)} = 0 THEN {element_equal(p, f'string_split({r}, {s(chr(61))})[-1]')} ELSE false END)"
    )


RAW_ANSWERS = r"""
SELECT p_partkey,
  CASE CAST(p_partkey % 12 AS INTEGER)
    WHEN 0 THEN CAST(p_size AS VARCHAR) || ' apples'
    WHEN 1 THEN '\$' || CAST(p_size AS VARCHAR)
    WHEN 2 THEN CAST(p_size AS VARCHAR) || ' \text{ cm}'
    WHEN 3 THEN CAST(p_size AS VARCHAR) || '^\circ'
    WHEN 4 THEN '00' || CAST(p_size AS VARCHAR)
    WHEN 5 THEN ['seven', 'Twenty-one', 'one hundred', 'ninety nine', 'two hundred five', 'one thousand', 'three million two thousand one hundred and six', 'two point five'][CAST(p_size % 8 AS INTEGER) + 1]
    WHEN 6 THEN CAST(p_size AS VARCHAR) || '.000'
    WHEN 7 THEN '\dfrac' || CAST(p_size % 10 AS VARCHAR) || CAST(p_partkey % 10 AS VARCHAR)
    WHEN 8 THEN CAST(p_size AS VARCHAR) || '/' || CAST(p_size + 1 AS VARCHAR)
    WHEN 9 THEN 'x = ' || CAST(p_size AS VARCHAR) || '.'
    WHEN 10 THEN '\sqrt' || CAST(p_size AS VARCHAR)
    ELSE ' ' || CAST(p_size AS VARCHAR) || '\%  '
  END AS raw
FROM part
"""

CHOICE_TEXTS = r"""
SELECT c_custkey,
  CASE CAST(c_custkey % 3 AS INTEGER)
    WHEN 0 THEN 'So the answer is (' || chr(CAST(65 + c_custkey % 5 AS INTEGER)) || ').'
    WHEN 1 THEN c_mktsegment || ' maybe ' || chr(CAST(65 + c_custkey % 5 AS INTEGER))
    ELSE 'answer is A' || chr(10) || chr(10) || 'Problem: the answer is ' || chr(CAST(65 + c_custkey % 5 AS INTEGER))
  END AS response
FROM customer
"""


def choice_answer_clean(pred: str) -> str:
    """E4 (parser variant) in DuckDB."""
    icl = f"(len(string_split({pred}, 'choice is')) > 2 OR len(string_split({pred}, 'answer is')) > 2)"
    p = strip(pred, NL)
    p = f"(CASE WHEN {icl} THEN string_split({p}, {NL} || {NL})[1] ELSE {p} END)"
    flagged = f"regexp_matches({p}, 'choice is|answer is')"
    tail = f"regexp_extract({p}, '(?s)(?:.*)(?:choice is|answer is)(.*)$', 1)"
    p = f"(CASE WHEN {flagged} THEN {tail} ELSE {p} END)"
    p = f"ltrim(trim(rtrim(rtrim({strip(p, NL)}, '.'), '/'), ' '), ':')"
    letters = f"regexp_extract_all(upper({p}), '\\b(A|B|C|D|E)\\b', 1)"
    picked = f"CASE WHEN len({letters}) = 0 THEN trim({strip(p)}, '.') WHEN {flagged} THEN {letters}[1] ELSE {letters}[-1] END"
    return f"rtrim(rtrim({picked}, '.'), '/')"


def multi_choice(pred: str) -> str:
    p = f"(CASE WHEN strpos({pred}, 'Problem:') > 0 THEN string_split({pred}, 'Problem:')[1] ELSE {pred} END)"
    p = f"lower(replace({p}, 'choice is', 'answer is'))"
    letter = f"regexp_extract({p}, 'answer is \\(?([abcde])\\)?', 1)"
    return f"CASE WHEN {letter} <> '' THEN upper({letter}) ELSE 'placeholder' END"


CHAIN_STEPS = """
SELECT p_partkey AS id, CAST(i AS INTEGER) AS pos, CAST((p_partkey * (2 * i + 1) + i * i) % 20 + 1 AS BIGINT) AS cst,
       CAST((p_partkey * 7) % 20 + 1 AS BIGINT) AS p0, chr(CAST(97 + (i * 3 + p_partkey) % 26 AS INTEGER)) AS var,
       chr(CAST(97 + p_partkey % 26 AS INTEGER)) AS premise_var
FROM part, (SELECT unnest(range(1, 11)) AS i)
"""

COUNTERFACT = """
SELECT o_orderkey AS id, [7, 9, 11, 12][CAST(o_orderkey % 4 AS INTEGER) + 1] AS base,
       substr('0123456789AB', CAST(o_orderkey % (base - 1) + 2 AS INTEGER), 1) || substr('0123456789AB', CAST((o_orderkey * 3) % base + 1 AS INTEGER), 1) AS p,
       substr('0123456789AB', CAST((o_orderkey * 7) % (base - 1) + 2 AS INTEGER), 1) || substr('0123456789AB', CAST((o_orderkey * 5) % base + 1 AS INTEGER), 1) AS q
FROM orders
"""


def base_digits(v: str, b: str) -> str:
    """Non-negative integer < b^3 written in base b with 0-9A-B digits, no leading zeros."""
    d = "'0123456789AB'"
    v = f"({v})"
    three = (
        f"substr({d}, CAST({v} // ({b} * {b}) + 1 AS INTEGER), 1) || substr({d}, CAST(({v} // {b}) % {b} + 1 AS INTEGER), 1) "
        f"|| substr({d}, CAST({v} % {b} + 1 AS INTEGER), 1)"
    )
    return f"CASE WHEN {v} = 0 THEN '0' ELSE ltrim({three}, '0') END"


def base_value(x: str, b: str) -> str:
    d = "'0123456789AB'"
    return f"((strpos({d}, substr({x}, 1, 1)) - 1) * {b} + (strpos({d}, substr({x}, 2, 1)) - 1))"
