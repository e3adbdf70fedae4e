"""D1-D4 — per-source ground truth and question text, as projections.

Each benchmark source has its own record shape.  The union table carries every
shape's fields as columns (NULL where a source lacks them, and absent columns
count as NULL); one ``CASE`` over ``data_name`` picks the fields.  A name that
no rule knows is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverlens.functions.fixed_values import SKIP_UNIT_DATASETS
from coverlens.functions.sql import WS
from coverlens.operators.extract import extract_raw_answers
from coverlens.operators.normalize import normalize_answers

ABCD = ["A", "B", "C", "D"]
#: Sources whose truth is extracted from a worked solution, that give it plainly, and that wrap it in dollar signs.
SOLUTION_SOURCES = ["math", "minerva_math", "math500"]
PLAIN_SOURCES = ["aime24", "amc23", "cmath", "gaokao2024_I", "gaokao2024_II", "imo2024"]
DOLLAR_SOURCES = ["gaokao2023en", "college_math", "gaokao_math_cloze"]
CHOICE_OR_ANSWER_SOURCES = ["gaokao2024_mix", "cn_middle_school"]
FIELDS = (
    "question problem input answer body_text content Body QuestionText Equation svamp_answer sat_answer choices answer_idx options correct final_answer "
    "solution formula target steps label choice_answer ans_type table_title table_text sat_options option_map gt_cot gt"
).split()
_TYPES = {"choices": "array<string>", "options": "array<string>", "final_answer": "array<string>", "answer_idx": "int", "option_map": "array<struct<key:string,value:string>>"}


def py_strip(c: Column) -> Column:
    """``s.strip()``."""
    return F.btrim(c, F.lit(WS))


def with_all_fields(df: DataFrame) -> DataFrame:
    """The union table with a NULL column for each field that it lacks."""
    have = {c.lower() for c in df.columns}
    return df.withColumns({f: F.lit(None).cast(_TYPES.get(f, "string")) for f in FIELDS if f.lower() not in have})


def options_block(options: Column, letters: list[str] = ABCD) -> Column:
    """``(A) x (B) y ...`` from a choice list."""
    labelled = F.transform(options, lambda o, i: F.concat(F.lit("("), F.element_at(F.array(*[F.lit(x) for x in letters]), i + 1), F.lit(") "), py_strip(o)))
    return F.array_join(labelled, " ")


def sat_options(options: Column) -> Column:
    """``A) x B) y`` as ``(A) x (B) y``."""
    out = F.concat(F.lit("("), py_strip(options))
    for letter in ABCD[1:]:
        out = F.replace(out, F.lit(f" {letter}) "), F.lit(f" ({letter}) "))
    return out


def keyed_options(entries: Column) -> Column:
    """``(A) x (B) y`` from (key, value) entries in order."""
    return F.array_join(F.transform(entries, lambda e: F.concat(F.lit("("), e["key"], F.lit(") "), e["value"])), " ")


def aqua_options(options: Column) -> Column:
    """``A)x`` entries as ``(A) x (B) y``."""
    joined = F.concat(F.lit("("), F.array_join(options, "("))
    return py_strip(F.replace(F.replace(joined, F.lit("("), F.lit(" (")), F.lit(")"), F.lit(") ")))


def table_number(answer: Column) -> Column:
    """A numeric table answer as the text of its float: ``1/4``, ``1,200``, ``5%``, ``7``."""
    number = lambda c: F.replace(c, F.lit(","), F.lit("")).try_cast("double")
    value = (
        F.when(F.contains(answer, F.lit("/")), F.try_divide(number(F.substring_index(answer, "/", 1)), number(F.element_at(F.split(answer, "/"), 2))))
        .when(F.contains(answer, F.lit(",")), number(answer))
        .when(F.contains(answer, F.lit("%")), number(F.substring_index(answer, "%", 1)) / 100)
        .otherwise(number(answer))
    )
    whole = (value == F.floor(value)) & (F.abs(value) < 1e16)
    return F.when(whole, F.concat(value.cast("bigint").cast("string"), F.lit(".0"))).otherwise(value.cast("string"))


def ground_truth(df: DataFrame, data_name: str = "data_name") -> DataFrame:
    """``df`` with ``gt_cot`` and ``gt_ans`` of every source.

    A given (gt_cot, gt) pair comes first; worked solutions go through answer
    extraction; all but the sources that keep their units are normalised.
    """
    df = with_all_fields(df).withColumnsRenamed({"gt_cot": "__cot"})
    name = F.col(data_name)
    given = F.col("__cot").isNotNull() & F.col("gt").isNotNull()
    worked = F.when(given & (name == "math"), F.col("__cot")).when(~given & name.isin(SOLUTION_SOURCES), F.col("solution"))
    keeps = [c for c in df.columns]
    ex = extract_raw_answers(df.withColumn("__worked", worked), "math", "__worked")
    ex = normalize_answers(normalize_answers(ex, "cleaned", "__n"), "cleaned", "__m", skip_unit=True)
    taken = F.when(F.col("mode") == "code", F.col("cleaned")).when(name.isin(SKIP_UNIT_DATASETS), F.col("__m")).otherwise(F.col("__n"))
    gsm = F.split(F.col("answer"), "####", 2)
    numeric = F.col("ans_type").isin("integer_number", "decimal_number")
    cot = (
        F.when(name.isin([*SOLUTION_SOURCES, "tabmwp"]), F.col("solution"))
        .when(name == "gsm8k", F.element_at(gsm, 1))
        .when(name == "svamp", F.col("Equation"))
        .when(name == "asdiv", F.col("formula"))
        .when(name == "carp_en", F.col("steps"))
    )
    answer = (
        F.when(name == "gsm8k", F.element_at(gsm, 2))
        .when(name == "svamp", F.col("svamp_answer"))
        .when(name == "asdiv", F.regexp_replace("answer", r"\(.*?\)", ""))
        .when(name == "mawps", F.col("target"))
        .when(name == "tabmwp", F.when(numeric, table_number(F.col("answer"))).otherwise(F.col("answer")))
        .when(name == "mmlu_stem", F.element_at(F.array(*[F.lit(x) for x in ABCD]), F.col("answer_idx") + 1))
        .when(name == "sat_math", F.col("sat_answer"))
        .when(name == "aqua", F.col("correct"))
        .when(name.isin(DOLLAR_SOURCES), py_strip(F.replace(F.col("answer"), F.lit("$"), F.lit(""))))
        .when(name == "gaokao_math_qa", F.col("label"))
        .when(name.isin(CHOICE_OR_ANSWER_SOURCES), F.when(F.length("choice_answer") > 0, F.col("choice_answer")).otherwise(F.col("answer")))
        .when(name == "olympiadbench", F.btrim(F.element_at(F.col("final_answer"), 1), F.lit("$")))
        .when(name.isin([*PLAIN_SOURCES, "carp_en"]), F.col("answer"))
        .otherwise(F.raise_error(F.concat(F.lit("unknown data name: "), F.coalesce(name, F.lit("NULL")))).cast("string"))
    )
    raw = F.when(worked.isNotNull(), taken).when(given, F.col("gt")).when(name.isin(SOLUTION_SOURCES), F.lit("")).otherwise(answer)
    out = ex.select(*keeps, F.when(given, F.col("__cot")).otherwise(py_strip(F.coalesce(cot, F.lit("None")))).alias("gt_cot"), raw.alias("__raw"), given.alias("__given"))
    out = normalize_answers(out, "__raw", "__normed")
    units = F.col("__raw")
    for old, new in (("\\neq", "\\ne"), ("\\leq", "\\le"), ("\\geq", "\\ge")):
        units = F.replace(units, F.lit(old), F.lit(new))
    kept = F.when(F.col("__given"), F.col("__raw")).otherwise(units)
    # a given truth is normalised once; of a given 'math' pair the extracted answer stands
    ans = F.when(name.isin(SKIP_UNIT_DATASETS), kept).when(F.col("__given") & (name == "math"), F.col("__raw")).otherwise(F.col("__normed"))
    return out.withColumn("gt_ans", ans).drop("__raw", "__normed", "__given", "__cot")


def boolean_hint(question: Column, gt: Column) -> Column:
    """D3: append ``(True or False)`` / ``(Yes or No)`` when the truth is such a word."""
    low = F.lower(gt)
    q = F.when(low.isin("true", "false"), F.concat(question, F.lit(" (True or False)"))).otherwise(question)
    return F.when(low.isin("yes", "no"), F.concat(q, F.lit(" (Yes or No)"))).otherwise(q)


def question_text(data_name: Column) -> Column:
    """Per-source question text over ``with_all_fields`` columns."""
    body = py_strip(F.col("Body"))
    asked = py_strip(F.col("question"))
    svamp = F.concat(F.when(F.endswith(body, F.lit(".")), body).otherwise(F.concat(body, F.lit("."))), F.lit(" "), py_strip(F.col("QuestionText")))
    title = F.when(F.length("table_title") > 0, F.concat(F.lit('regarding "'), F.col("table_title"), F.lit('" '))).otherwise(F.lit(""))
    listed = F.concat(F.lit(" Please select from the following options: ['"), F.array_join("choices", "', '"), F.lit("']"))
    tab = F.concat(
        F.lit("Read the following table "), title, F.lit("and answer a question:\n"), F.col("table_text"), F.lit("\n"), F.col("question"),
        F.when(F.size("choices") > 0, listed).otherwise(F.lit("")),
    )
    return (
        F.when(data_name == "asdiv", F.concat(py_strip(F.col("body_text")), F.lit(" "), asked))
        .when(data_name == "svamp", svamp)
        .when(data_name == "tabmwp", tab)
        .when(data_name == "carp_en", F.col("content"))
        .when(data_name == "mmlu_stem", F.concat(asked, F.lit("\nAnswer Choices: "), options_block(F.col("choices"))))
        .when(data_name == "sat_math", F.concat(asked, F.lit("\nAnswer Choices: "), sat_options(F.col("sat_options"))))
        .when(F.contains(data_name, F.lit("aqua")), F.concat(asked, F.lit("\nAnswer Choices: "), aqua_options(F.col("options"))))
        .when(data_name == "gaokao_math_qa", F.concat(asked, F.lit("\n选项: "), keyed_options(F.col("option_map"))))
        .otherwise(F.coalesce("question", "problem", "input", F.lit("")))
    )


def questions(df: DataFrame, data_name: str = "data_name") -> DataFrame:
    """D2 + D3: ``ground_truth`` with ``question_text``, hint included, stripped."""
    out = ground_truth(df, data_name)
    hinted = boolean_hint(question_text(F.col(data_name)), F.col("gt_ans"))
    return out.withColumn("question_out", py_strip(hinted))
