"""Registered queries: per-source ground truth and question text."""

from __future__ import annotations

from pyspark.sql import functions as F

from coverlens.operators import harmonize as H
from coverlens.plans.oracle import duck
from coverlens.plans.registry import register
from coverlens.sources.tables import ensure_parallelism, table

_NAMES = (
    "math minerva_math math500 gsm8k svamp asdiv mawps tabmwp carp_en mmlu_stem sat_math aqua gaokao2023en college_math gaokao_math_cloze "
    "gaokao_math_qa gaokao2024_mix cn_middle_school olympiadbench aime24 amc23 cmath gaokao2024_I gaokao2024_II imo2024"
).split()

# Fields of the union table, one record shape per ``p_partkey % 25``.  {S} is the
# string type, {A}...{Z} bracket an array, z the size as text, k the shape.
_FIELDS = {
    "question": "p_name",
    "answer": "CASE WHEN k = 3 THEN p_type || ' #### ' || z WHEN k = 5 THEN z || ' (apples)' "
    "WHEN k = 7 THEN CASE CAST(p_size % 4 AS INT) WHEN 0 THEN z || '/4' WHEN 1 THEN '1,2' || z WHEN 2 THEN z || '%' ELSE z || '.5' END "
    "WHEN k = 8 THEN z || '{B}neq x' "
    "WHEN k IN (12, 13, 14) THEN CASE WHEN p_size % 3 = 0 THEN 'Yes' WHEN p_size % 3 = 1 THEN 'False' ELSE '$' || z || '$' END "
    "WHEN k >= 16 THEN z || ' cm' END",
    "body_text": "CASE WHEN k = 5 THEN ' ' || p_type || ' ' END",
    "content": "CASE WHEN k = 8 THEN p_type END",
    "Body": "CASE WHEN k = 4 THEN CASE WHEN p_size % 2 = 0 THEN p_name || '.' ELSE p_name END END",
    "QuestionText": "CASE WHEN k = 4 THEN 'How many ' || p_brand || '?' END",
    "Equation": "CASE WHEN k = 4 THEN '( ' || z || ' + 0.0 )' END",
    "svamp_answer": "CASE WHEN k = 4 THEN z || '.0' END",
    "sat_answer": "CASE WHEN k = 10 THEN 'C' END",
    "choices": "CASE WHEN k = 9 THEN {A}p_type, ' b ', p_brand, z{Z} WHEN k = 7 AND p_size % 4 = 3 THEN {A}p_brand, z{Z} END",
    "answer_idx": "CASE WHEN k = 9 THEN CAST(p_size % 4 AS INT) END",
    "options": "CASE WHEN k = 11 THEN {A}'A)' || z, 'B)1', 'C)2', 'D)' || p_brand, 'E)none'{Z} END",
    "correct": "CASE WHEN k = 11 THEN 'D' END",
    "final_answer": "CASE WHEN k = 18 THEN {A}'$' || z || '$'{Z} END",
    "solution": "CASE WHEN k IN (0, 1, 2) THEN 'thus {B}boxed{{' || z || ' cm}} holds' WHEN k = 7 THEN p_name END",
    "formula": "CASE WHEN k = 5 THEN '(1+2)' END",
    "target": "CASE WHEN k = 6 THEN z || '.0' END",
    "steps": "CASE WHEN k = 8 THEN p_name END",
    "label": "CASE WHEN k = 15 THEN 'B' END",
    "choice_answer": "CASE WHEN k IN (16, 17) THEN CASE WHEN p_size % 2 = 0 THEN 'B' ELSE '' END END",
    "ans_type": "CASE WHEN k = 7 THEN CASE WHEN p_size % 5 = 0 THEN 'extractive_text' ELSE 'decimal_number' END END",
    "table_title": "CASE WHEN k = 7 THEN CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END END",
    "table_text": "CASE WHEN k = 7 THEN p_type || ' | ' || z END",
    "sat_options": "CASE WHEN k = 10 THEN 'A) ' || z || ' B) 2 C) 3 D) ' || p_brand END",
    "gt_cot": "CASE WHEN k IN (0, 1, 19) AND p_size % 5 = 0 THEN 'so {B}boxed{{' || z || '}} ' END",
    "gt": "CASE WHEN k IN (0, 1, 19) AND p_size % 5 = 0 THEN z || '.0 cm' END",
}


def _select(text: str, array: tuple[str, str], backslash: str) -> list[str]:
    fields = [f"{e.format(S=text, A=array[0], Z=array[1], B=backslash)} AS {n}" for n, e in _FIELDS.items()]
    return fields


def sources(spark, sf):
    """Union table of twenty-five benchmark record shapes, one per ``p_partkey % 25``."""
    p = ensure_parallelism(table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size"))
    p = p.select("*", (F.col("p_partkey") % 25).cast("int").alias("k"), F.col("p_size").cast("string").alias("z"))
    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), F.col("k") + 1)
    options = "CASE WHEN k = 15 THEN array(named_struct('key', 'A', 'value', z), named_struct('key', 'B', 'value', p_brand)) END AS option_map"
    return p.select(F.col("p_partkey").alias("id"), name.alias("data_name"), *(F.expr(e) for e in [*_select("STRING", ("array(", ")"), "\\\\"), options]))


_DUCK_SOURCES = (
    f"SELECT p_partkey AS id, {_NAMES!r}[k + 1] AS data_name, " + ", ".join(_select("VARCHAR", ("[", "]"), "\\")) + ", z, p_brand, k "
    "FROM (SELECT *, CAST(p_partkey % 25 AS INTEGER) AS k, CAST(p_size AS VARCHAR) AS z FROM part)"
)


def _duck_float(x: str) -> str:
    return f"(CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) || '.0' ELSE CAST({x} AS VARCHAR) END)"


def _duck_gt() -> str:
    num = lambda x: f"TRY_CAST(replace({x}, ',', '') AS DOUBLE)"
    value = (
        f"(CASE WHEN contains(answer, '/') THEN {num('string_split(answer, chr(47))[1]')} / {num('string_split(answer, chr(47))[2]')} "
        f"WHEN contains(answer, ',') THEN {num('answer')} WHEN contains(answer, '%') THEN {num('string_split(answer, chr(37))[1]')} / 100 ELSE {num('answer')} END)"
    )
    given = "(gt_cot IS NOT NULL AND gt IS NOT NULL)"
    in_ = lambda names: "data_name IN (" + ", ".join(duck.s(n) for n in names) + ")"
    worked = f"CASE WHEN {given} AND data_name = 'math' THEN gt_cot WHEN NOT {given} AND {in_(H.SOLUTION_SOURCES)} THEN solution END"
    _, raw = duck.text_branch("w")
    base = f"SELECT *, {duck.clean(raw)} AS n1, {duck.clean(raw)} AS n2 FROM (SELECT *, replace(coalesce({worked}, ''), 'ки', '') AS w, {worked} IS NOT NULL AS is_worked FROM ({_DUCK_SOURCES}))"
    base = duck.stages(duck.stages(base, "n1", duck.normalize_exprs("n1")), "n2", duck.normalize_exprs("n2", skip_unit=True))
    ans = (
        "CASE WHEN data_name = 'gsm8k' THEN string_split(answer, '####')[2] WHEN data_name = 'svamp' THEN svamp_answer "
        "WHEN data_name = 'asdiv' THEN regexp_replace(answer, '\\(.*?\\)', '', 'g') WHEN data_name = 'mawps' THEN target "
        f"WHEN data_name = 'tabmwp' THEN CASE WHEN ans_type IN ('integer_number', 'decimal_number') THEN {_duck_float(value)} ELSE answer END "
        "WHEN data_name = 'mmlu_stem' THEN ['A', 'B', 'C', 'D'][answer_idx + 1] WHEN data_name = 'sat_math' THEN sat_answer WHEN data_name = 'aqua' THEN correct "
        f"WHEN {in_(H.DOLLAR_SOURCES)} THEN {duck.strip(duck.rep('answer', '$'))} WHEN data_name = 'gaokao_math_qa' THEN label "
        f"WHEN {in_(H.CHOICE_OR_ANSWER_SOURCES)} THEN CASE WHEN length(choice_answer) > 0 THEN choice_answer ELSE answer END "
        "WHEN data_name = 'olympiadbench' THEN trim(final_answer[1], '$') ELSE answer END"
    )
    cot = (
        f"CASE WHEN {in_([*H.SOLUTION_SOURCES, 'tabmwp'])} THEN solution WHEN data_name = 'gsm8k' THEN string_split(answer, '####')[1] "
        "WHEN data_name = 'svamp' THEN Equation WHEN data_name = 'asdiv' THEN formula WHEN data_name = 'carp_en' THEN steps END"
    )
    keeps = in_(["carp_en", "minerva_math"])
    rawest = f"CASE WHEN is_worked THEN CASE WHEN {keeps} THEN n2 ELSE n1 END WHEN {given} THEN gt ELSE {ans} END"
    with_raw = f"SELECT * EXCLUDE (n1, n2, gt_cot), CASE WHEN {given} THEN gt_cot ELSE {duck.strip(f'coalesce({cot}, {duck.s("None")})')} END AS gt_cot, {rawest} AS raw, {rawest} AS n, {given} AS given FROM ({base})"
    normed = duck.stages(with_raw, "n", duck.normalize_exprs("n"))
    plain = duck.rep(duck.rep(duck.rep("raw", "\\neq", "\\ne"), "\\leq", "\\le"), "\\geq", "\\ge")
    final = f"CASE WHEN {keeps} THEN CASE WHEN given THEN raw ELSE {plain} END WHEN given AND data_name = 'math' THEN raw ELSE n END"
    return f"SELECT *, {final} AS gt_ans FROM ({normed})"


@register("ground_truth_union", oracle=lambda: f"SELECT id, data_name, gt_cot, gt_ans FROM ({_duck_gt()})")
def q_ground_truth_union(spark, sf):
    """Per-source (gt_cot, gt_ans), extracted, normalised or kept as the source demands."""
    return H.ground_truth(sources(spark, sf)).select("id", "data_name", "gt_cot", "gt_ans")


def _duck_hint(q: str) -> str:
    return (
        f"CASE WHEN lower(gt_ans) IN ('yes', 'no') THEN {q} || ' (Yes or No)' "
        f"WHEN lower(gt_ans) IN ('true', 'false') THEN {q} || ' (True or False)' ELSE {q} END"
    )


def _duck_question() -> str:
    body = duck.strip("Body")
    svamp = f"(CASE WHEN ends_with({body}, '.') THEN {body} ELSE {body} || '.' END) || ' ' || {duck.strip('QuestionText')}"
    opts = f"array_to_string(list_transform(range(1, len(choices) + 1), lambda i: '(' || ['A', 'B', 'C', 'D'][i] || ') ' || {duck.strip('choices[i]')}), ' ')"
    head = f"{duck.strip('question')} || chr(10) || 'Answer Choices: ' || "
    aqua = duck.strip("replace(replace('(' || array_to_string(options, '('), '(', ' ('), ')', ') ')")
    sat = f"'(' || {duck.strip('sat_options')}"
    for letter in "BCD":
        sat = f"replace({sat}, ' {letter}) ', ' ({letter}) ')"
    tab = (
        "'Read the following table ' || CASE WHEN length(table_title) > 0 THEN 'regarding \"' || table_title || '\" ' ELSE '' END || 'and answer a question:' || chr(10) "
        "|| table_text || chr(10) || question || CASE WHEN len(choices) > 0 THEN ' Please select from the following options: [''' || array_to_string(choices, ''', ''') || ''']' ELSE '' END"
    )
    q = (
        f"CASE data_name WHEN 'asdiv' THEN {duck.strip('body_text')} || ' ' || {duck.strip('question')} WHEN 'svamp' THEN {svamp} WHEN 'tabmwp' THEN {tab} WHEN 'carp_en' THEN content "
        f"WHEN 'mmlu_stem' THEN {head}{opts} WHEN 'sat_math' THEN {head}{sat} WHEN 'aqua' THEN {head}{aqua} "
        f"WHEN 'gaokao_math_qa' THEN {duck.strip('question')} || chr(10) || '选项: (A) ' || z || ' (B) ' || p_brand ELSE question END"
    )
    return f"SELECT id, data_name, {duck.strip(_duck_hint('q'))} AS question FROM (SELECT *, {q} AS q FROM ({_duck_gt()}))"


@register("question_union", oracle=lambda: _duck_question())
def q_question_union(spark, sf):
    """Per-source question text, with the boolean hint of D3."""
    return H.questions(sources(spark, sf)).select("id", "data_name", F.col("question_out").alias("question"))


@register("boolean_hint", oracle=lambda: f"SELECT id, gt_ans, {_duck_hint('question')} AS hinted FROM ({_duck_gt()})")
def q_boolean_hint(spark, sf):
    """D3: the True/False or Yes/No hint on boolean-answer items of every source."""
    g = H.ground_truth(sources(spark, sf))
    return g.select("id", "gt_ans", H.boolean_hint(F.col("question"), F.col("gt_ans")).alias("hinted"))


@register("options_block", oracle=lambda: f"""
SELECT id, CASE data_name WHEN 'mmlu_stem' THEN array_to_string(list_transform(range(1, 5), lambda i: '(' || ['A', 'B', 'C', 'D'][i] || ') ' || {duck.strip('choices[i]')}), ' ')
  WHEN 'sat_math' THEN '(A) ' || z || ' (B) 2 (C) 3 (D) ' || p_brand WHEN 'gaokao_math_qa' THEN '(A) ' || z || ' (B) ' || p_brand
  ELSE {duck.strip("replace(replace('(' || array_to_string(options, '('), '(', ' ('), ')', ') ')")} END AS options
FROM ({_DUCK_SOURCES}) WHERE data_name IN ('mmlu_stem', 'sat_math', 'gaokao_math_qa', 'aqua')""")
def q_options_block(spark, sf):
    """``(A) x (B) y ...`` from each of the four forms of choices."""
    s = sources(spark, sf).where(F.col("data_name").isin("mmlu_stem", "sat_math", "gaokao_math_qa", "aqua"))
    name = F.col("data_name")
    block = (
        F.when(name == "mmlu_stem", H.options_block(F.col("choices"))).when(name == "sat_math", H.sat_options(F.col("sat_options")))
        .when(name == "gaokao_math_qa", H.keyed_options(F.col("option_map"))).otherwise(H.aqua_options(F.col("options")))
    )
    return s.select("id", block.alias("options"))
