"""E1-E15 — answer extraction over the generation table.

``extract_answers`` adds ``response_len, mode, branch, raw_answer,
pred_answer, is_valid`` in narrow projections (no shuffle); the wide
``response`` column can be dropped right after, before any exchange.

The expressions are Spark SQL text (parsed once per stage); the small
``*_sql`` builders take the SQL text of their input and return SQL text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverlens.functions.fixed_values import CHOICE_DATASETS, CHOICE_NARROW_DATASETS, SKIP_UNIT_DATASETS
from coverlens.functions.sql import after_first, after_last, before_first, has, let, q, rep, rx, strip
from coverlens.operators.arithmetic import product_value_sql
from coverlens.operators.normalize import normalize_answers


def braced_sql(x: str) -> str:
    """``struct<d, n>`` for text that begins with a brace: ``n`` characters follow
    it up to the brace that closes it (``d`` = 0), or to the end (``d`` > 0).

    One pass over braces and the pieces between them, at any depth.
    """
    step = (
        "CASE WHEN a.d = 0 THEN a ELSE named_struct('d', a.d + CASE t WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END, "
        "'n', a.n + CASE WHEN t = '}' AND a.d = 1 THEN 0 ELSE length(t) END) END"
    )
    return f"aggregate(regexp_extract_all(substr({x}, 2), {q('[{}]|[^{}]+')}, 0), named_struct('d', 1, 'n', 0), (a, t) -> {step})"


LAST_NUMBER = r"(?U)-?\d*\.?\d+"
CHOICE_LETTER = r"(?U)\b(A|B|C|D|E)\b"


def boxed_content_sql(ans: str) -> str:
    """E2 on the text after the last ``boxed``: balanced ``{...}`` body, the
    rest when the brace never closes, or up to ``$`` without a brace."""
    return f"CASE WHEN startswith({ans}, '{{') THEN substr({ans}, 2, ({braced_sql(ans)}).n) ELSE {strip(before_first(ans, '$'))} END"


def extract_boxed_sql(text: str) -> str:
    """Content of the last ``boxed`` (empty when nothing follows it)."""
    return boxed_content_sql(after_last(text, "boxed"))


def last_number_sql(text: str) -> str:
    """Last ``-?\\d*\\.?\\d+`` after comma removal, or ''."""
    return f"coalesce(try_element_at(regexp_extract_all({rep(text, ',')}, {q(LAST_NUMBER)}, 0), -1), '')"


def choice_answer_clean_sql(pred: str) -> str:
    """Choice letter from a response (few-shot repeats cut at a blank line)."""
    icl = f"(size(split({pred}, 'choice is', -1)) > 2 OR size(split({pred}, 'answer is', -1)) > 2)"
    p = strip(pred, "\n")
    p = f"CASE WHEN {icl} THEN {before_first(p, chr(10) * 2)} ELSE {p} END"
    flagged = f"({p} RLIKE 'choice is|answer is')"
    tail = f"regexp_extract({p}, {q(r'(?s)(?:.*)(?:choice is|answer is)(.*)$')}, 1)"
    p = f"CASE WHEN {flagged} THEN {tail} ELSE {p} END"
    p = f"ltrim(':', btrim(rtrim('/', rtrim('.', {strip(p, chr(10))})), ' '))"
    letters = f"regexp_extract_all(upper({p}), {q(CHOICE_LETTER)}, 1)"
    picked = (
        f"CASE WHEN size({letters}) = 0 THEN btrim({strip(p)}, '.') "
        f"WHEN {flagged} THEN element_at({letters}, 1) ELSE element_at({letters}, -1) END"
    )
    return f"rtrim('/', rtrim('.', {picked}))"


def multi_choice_answer_sql(pred: str) -> str:
    """E5: ``answer is (x)`` letter before any ``Problem:``, else 'placeholder'."""
    p = f"CASE WHEN {has(pred, 'Problem:')} THEN {before_first(pred, 'Problem:')} ELSE {pred} END"
    p = f"lower({rep(p, 'choice is', 'answer is')})"
    letter = f"regexp_extract({p}, {q(r'answer is \(?([abcde])\)?')}, 1)"
    return f"CASE WHEN {letter} <> '' THEN upper({letter}) ELSE 'placeholder' END"


def recorded_code_output_sql(text: str) -> str:
    """Stripped content of the last ``<llm-code-output>`` block (NULL if none)."""
    blocks = f"regexp_extract_all({text}, {q(r'(?s)<llm-code-output>(.*?)</llm-code-output>')}, 1)"
    return strip(f"try_element_at({blocks}, -1)")


def code_blocks_sql(text: str) -> str:
    """Stripped ``<llm-code>`` program blocks in order."""
    return f"transform(regexp_extract_all({text}, {q(r'(?s)<llm-code>(.*?)</llm-code>')}, 1), b -> {strip('b')})"


def solution_mode_sql(text: str) -> str:
    """E12: 'code' when the response carries a program block."""
    return f"CASE WHEN {has(text, '<llm-code>')} THEN 'code' ELSE 'nl' END"


def response_length_sql(text: str) -> str:
    """Whitespace token count (``len(s.split())``)."""
    return f"CAST(regexp_count({text}, {q(r'(?U)\S+')}) AS INT)"


def extract_boxed_reward_sql(text: str) -> str:
    """Reward-side answer: text after the first ``</think>`` (up to a second
    one), then the last ``\\boxed{...}``; the ``\\boxed `` form runs to ``$``.
    Anything else (``\\fbox``, unclosed or detached braces) reads as ''."""
    body = f"(CASE WHEN {has(text, '</think>')} THEN {before_first(after_first(text, '</think>'), '</think>')} ELSE {text} END)"
    spaced = has(body, "\\boxed ")
    spaced_ans = before_first(after_last(body, "\\boxed "), "$")
    tail = after_last(body, "\\boxed")
    group = let(
        {"t": tail},
        lambda v: let({"b": braced_sql(v["t"])}, lambda w: f"CASE WHEN startswith({v['t']}, '{{') AND {w['b']}.d = 0 THEN substr({v['t']}, 2, {w['b']}.n) ELSE '' END"),
    )
    return f"CASE WHEN {spaced} THEN {spaced_ans} WHEN {has(body, chr(92) + 'boxed')} THEN {group} ELSE '' END"


def _text_branch_sql(r: str, data_name: str, use_last_number: bool) -> tuple[str, str]:
    """E1 branch label and raw (un-normalised) answer for non-code responses."""
    if data_name in CHOICE_DATASETS:
        return "'choice'", choice_answer_clean_sql(r)
    minerva = f"({has(r, 'final answer is $')} AND {has(r, '$. I hope')})"
    branches = [
        (minerva, "minerva", strip(before_first(after_first(r, "final answer is $"), "$. I hope"))),
        (has(r, "boxed"), "boxed", extract_boxed_sql(r)),
        (has(r, "he answer is"), "answer_is", strip(after_last(r, "he answer is"))),
        (has(r, "final answer is"), "final_answer_is", strip(after_last(r, "final answer is"))),
        (has(r, "答案是"), "zh_answer", strip(before_first(strip(before_first(after_first(r, "答案是"), "答案是")), "\n\n"))),
    ]
    number = last_number_sql(r) if use_last_number else "''"
    branch = "CASE " + " ".join(f"WHEN {c} THEN '{b}'" for c, b, _ in branches) + " ELSE 'last_number' END"
    raw = "CASE " + " ".join(f"WHEN {c} THEN {a}" for c, _, a in branches) + f" ELSE {number} END"
    return branch, raw


def clean_sql(pred: str, data_name: str) -> str:
    """Post-branch clean-up: choice narrowing, line breaks, one ':' / '.' / '/'."""
    if data_name in CHOICE_NARROW_DATASETS or "mmlu" in data_name:
        letters = f"regexp_extract_all(upper({pred}), {q(CHOICE_LETTER)}, 1)"
        pred = f"CASE WHEN size({letters}) > 0 THEN element_at({letters}, -1) ELSE btrim({strip(pred)}, '.') END"
    pred = rx(pred, r"(?U)\n\s*")
    pred = f"CASE WHEN startswith({pred}, ':') THEN substr({pred}, 2) ELSE {pred} END"
    return rx(rx(pred, r"\.\z"), r"/\z")


def extract_raw_answers(
    df: DataFrame,
    data_name: str = "math",
    response_col: str = "response",
    use_last_number: bool = True,
) -> DataFrame:
    """E1 + E10-E13 without normalisation.

    Adds ``response_len``, ``mode`` (code/nl), ``branch``, ``raw_answer`` and
    ``cleaned`` (the text handed to normalisation; code output as is).
    """
    df = df.withColumn("__r", F.coalesce(F.col(response_col).cast("string"), F.lit("")))
    df = df.withColumn("response_len", F.expr(response_length_sql("__r"))).withColumn("mode", F.expr(solution_mode_sql("__r")))
    branch, raw = _text_branch_sql(rep("__r", "ки"), data_name, use_last_number)
    code_out = f"coalesce({recorded_code_output_sql('__r')}, '')"
    code_out = f"CASE WHEN startswith({code_out}, 'ERROR:') THEN '' ELSE {code_out} END"
    df = df.withColumn("branch", F.expr(f"CASE WHEN mode = 'code' THEN 'code_output' ELSE {branch} END"))
    df = df.withColumn("raw_answer", F.expr(f"CASE WHEN mode = 'code' THEN {code_out} ELSE {raw} END")).drop("__r")
    cleaned = "raw_answer" if data_name in CHOICE_DATASETS else clean_sql("raw_answer", data_name)
    return df.withColumn("cleaned", F.expr(f"CASE WHEN mode = 'code' THEN raw_answer ELSE {cleaned} END"))


def finish_answers(df: DataFrame, data_name: str = "math") -> DataFrame:
    """E7 + E14 on ``cleaned``: ``pred_answer`` (code output kept verbatim) and ``is_valid``."""
    if data_name in CHOICE_DATASETS:  # the letter is final
        return df.withColumn("pred_answer", F.col("cleaned")).withColumn("is_valid", F.length("pred_answer") > 0)
    df = normalize_answers(df, "cleaned", "__normed", skip_unit=data_name in SKIP_UNIT_DATASETS)
    df = df.withColumn("pred_answer", F.expr("CASE WHEN mode = 'code' THEN cleaned ELSE __normed END"))
    return df.drop("__normed").withColumn("is_valid", F.length("pred_answer") > 0)


def extract_answers(
    df: DataFrame,
    data_name: str = "math",
    response_col: str = "response",
    use_last_number: bool = True,
) -> DataFrame:
    """E1 + E7 + E10-E15 over a generation table.

    Adds ``response_len``, ``mode`` (code/nl), ``branch``, ``raw_answer``,
    ``pred_answer`` and ``is_valid``.  Code responses take the recorded
    program output and are not normalised; an ``ERROR:`` output is invalid.
    """
    out = finish_answers(extract_raw_answers(df, data_name, response_col, use_last_number), data_name)
    return out.drop("cleaned")


def clean_units_sql(x: str) -> str:
    """E6 helper: pi -> 3.14 forms, % -> /100, currency and degree marks removed."""
    y = rep(x, "\\pi", "π")
    y = rx(y, r"(?<![\d}])\\?π", "3.14")
    y = rx(y, r"(\d)(\\?π)", "$1*3.14")
    y = rx(y, r"\{(\\?π)\}", "3.14")
    y = rx(y, r"\*(\\?π)", "*3.14")
    y = rep(y, "%", "/100")
    for mark in ["$", "¥", "°C", " C", "°"]:
        y = rep(y, mark)
    return y


def theoremqa_answer_sql(pred: str) -> str:
    """yes/true -> True, no/false -> False, option letters kept; else the
    boxed content's value after the last '=', units cleaned: a product or quotient
    of numbers as its value (``arithmetic.product_value_sql``), else without a
    trailing unit word (other LaTeX is not evaluated)."""
    low = f"lower({pred})"
    opts = " OR ".join(f"instr({low}, '({c})') > 0" for c in "abcdef")
    body = f"CASE WHEN instr({pred}, 'boxed') > 0 THEN {extract_boxed_sql(pred)} ELSE {pred} END"
    v = clean_units_sql(strip(f"substring_index({body}, '=', -1)"))
    tail = (
        f"CASE WHEN {v} RLIKE {q(r'^-?[\d\.]+\s\D+$')} OR {v} RLIKE {q(r'^-?[\d\.]+\s[^\s]+$')} "
        f"THEN substring_index({v}, ' ', 1) ELSE {v} END"
    )
    tail = f"coalesce({product_value_sql(v)}, {tail})"
    return (
        f"CASE WHEN instr({low}, 'yes') > 0 OR instr({low}, 'true') > 0 THEN 'True' "
        f"WHEN instr({low}, 'no') > 0 OR instr({low}, 'false') > 0 THEN 'False' "
        f"WHEN {opts} THEN {pred} ELSE {tail} END"
    )


def extract_by_prompt_type(df: DataFrame, data_name: str = "math", response_col: str = "response", prompt_type: str = "'cot'") -> DataFrame:
    """E15 ``run_execute``: empty or 'error' -> NULL; else the answer that the prompt
    type (an SQL expression, such as a column's name) calls for, normalised once more.

    Types that hold ``program_only``, and ``pot`` and ``pal``, take the recorded
    program output; all others the answer extracted from the text.
    """
    r = f"`{response_col}`"
    branch, raw = _text_branch_sql(rep(r, "ки"), data_name, True)
    program = f"(instr({prompt_type}, 'program_only') > 0 OR {prompt_type} IN ('pot', 'pal'))"
    df = df.withColumn("__program", F.expr(f"coalesce({program}, false)"))
    df = df.withColumn("__x", F.expr(f"CASE WHEN __program THEN '' ELSE {clean_sql(f'({raw})', data_name)} END"))
    df = normalize_answers(df, "__x", "__x", skip_unit=data_name in SKIP_UNIT_DATASETS)
    df = df.withColumn("__x", F.expr(f"CASE WHEN __program THEN coalesce({recorded_code_output_sql(r)}, '') ELSE __x END")).drop("__program")
    df = normalize_answers(df, "__x", "__x", skip_unit=data_name in SKIP_UNIT_DATASETS)
    return df.withColumn("prediction", F.expr(f"CASE WHEN {r} IS NULL OR {r} = '' OR {r} = 'error' THEN NULL ELSE __x END")).drop("__x")
