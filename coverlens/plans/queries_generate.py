"""Registered queries: synthetic chain and counterfactual datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from coverlens.operators import chains as CH
from coverlens.operators import generate as GN
from coverlens.operators.ranking import global_rank
from coverlens.plans import fixtures
from coverlens.plans.oracle import duck
from coverlens.plans.registry import register
from coverlens.sources.tables import ensure_parallelism, table

_CS = f"({duck.CHAIN_STEPS})"
_CF = f"({duck.COUNTERFACT})"


_DUCK_HASH = lambda *parts: "('0x' || substr(md5(" + " || '|' || ".join(parts) + "), 1, 15))::BIGINT"
WORLD = CH.ARITHCHAIN_2_10
#: Of the problems, per cent in each split.
SHARES = {"sft": 64, "rlvr": 16, "test": 10}

#: The world's rules as relations: place in the text, letter of the variable, letter of its parent; both solutions' order of rules.
_L = {n: i for i, n in enumerate(sorted([f"{b}{i}" for b in "ab" for i in range(1, 11)] + ["p0"]), 1)}
_RULE_ROWS = ", ".join(f"({i}, {_L[f'{b}{k}']}, {_L[f'{b}{k - 1}' if k > 1 else 'p0']})" for i, (b, k) in enumerate([(b, k) for b in "ab" for k in range(1, 11)], 1))


def _chain_ctes(source: str) -> str:
    """CTEs over ``source`` (id, seed): base, rules, fsteps, rsteps, problem, solved."""
    draw = lambda slot: _DUCK_HASH(f"'{GN.SEED}'", "seed", slot) + f" % {GN.MAX_CONST} + 1"
    opening = lambda d: "[" + ", ".join(duck.s(o) for o in GN.OPENINGS) + "][CAST(" + _DUCK_HASH(f"'{GN.SEED}'", "seed", f"'opening-{d}'") + f" % {len(GN.OPENINGS)} AS INTEGER) + 1]"
    return f"""base AS (
  SELECT id, seed,
    list_transform(list_sort(list_transform(range(0, 26), lambda i: {{'h': md5('{GN.SEED}|' || seed || '|l' || CAST(i AS VARCHAR)), 'l': chr(CAST(97 + i AS INTEGER))}})), lambda x: x.l) AS letters,
    list_transform(range(1, 21), lambda i: {draw("CAST(i AS VARCHAR)")}) AS constants, {draw("'-1'")} AS premise_value
  FROM ({source})),
rule(i, v, p) AS (VALUES {_RULE_ROWS}),
said AS (SELECT id, i, letters[v] AS var, letters[p] || ' + ' || CAST(constants[i] AS VARCHAR) AS expr, constants[i] AS cst, letters[p] AS parent FROM base, rule),
rules AS (
  SELECT id, list({{'var': var, 'expr': expr}} ORDER BY i) AS rules
  FROM (SELECT id, i, var, expr FROM said UNION ALL SELECT id, 21, letters[{_L["p0"]}], CAST(premise_value AS VARCHAR) FROM base) GROUP BY id),
fsteps AS (SELECT id, i AS step, var, expr, CAST(premise_value + sum(cst) OVER (PARTITION BY id ORDER BY i) AS VARCHAR) AS value FROM said JOIN base USING (id) WHERE i <= 10),
rsteps AS (
  SELECT id, step, var, expr, CASE WHEN step = 10 THEN CAST(total + premise_value AS VARCHAR) ELSE parent || ' + ' || CAST(total AS VARCHAR) END AS value FROM (
    SELECT id, 10 - i AS step, var, expr, parent, premise_value, sum(cst) OVER (PARTITION BY id ORDER BY i DESC) AS total
    FROM (SELECT id, i, var, expr, cst, parent FROM said WHERE i <= 10 UNION ALL SELECT id, 0, letters[{_L["p0"]}], CAST(premise_value AS VARCHAR), 0, NULL FROM base) JOIN base USING (id))
  WHERE step > 0),
problem AS (
  SELECT id, letters[{_L["a10"]}] AS target, {duck.s(GN.PROBLEM_TEXT[0])} || array_to_string(list_transform(rules, lambda r: r.var || ' = ' || r.expr), '; ')
    || {duck.s(GN.PROBLEM_TEXT[1])} || letters[{_L["p0"]}] || ' = ' || CAST(premise_value AS VARCHAR) || {duck.s(GN.PROBLEM_TEXT[2])} || letters[{_L["a10"]}] || '.' AS question,
    premise_value + list_sum(constants[1:10]) AS answer
  FROM base JOIN rules USING (id)),
solved AS (
  SELECT id, 'forward' AS direction, {opening("forward")} || chr(10) || lines || chr(10) || chr(10) || 'Thus, ' || target || ' = \\boxed{{' || CAST(answer AS VARCHAR) || '}}.' AS solution, final
  FROM base JOIN problem USING (id) JOIN (SELECT id, string_agg(CAST(step AS VARCHAR) || '. ' || var || ' = ' || expr || ' = ' || value || '.', chr(10) ORDER BY step) AS lines, arg_max(value, step) AS final FROM fsteps GROUP BY id) USING (id)
  UNION ALL
  SELECT id, 'reverse', {opening("reverse")} || chr(10) || lines || chr(10) || chr(10) || 'Thus, ' || target || ' = \\boxed{{' || CAST(answer AS VARCHAR) || '}}.', final
  FROM base JOIN problem USING (id) JOIN (SELECT id, string_agg(CAST(step AS VARCHAR) || '. Substitute ' || var || ' = ' || expr || ' into the target expression, yielding ' || target || ' = ' || value || '.', chr(10) ORDER BY step) AS lines, arg_max(value, step) AS final
    FROM rsteps JOIN problem USING (id) GROUP BY id) USING (id))"""


_PARTS = "SELECT p_partkey AS id, CAST(p_partkey AS VARCHAR) AS seed FROM part"


def _parts(spark, sf):
    """Stand-in for a list of problems to make: an id, and a seed that decides its content."""
    return ensure_parallelism(table(spark, sf, "part").select(F.col("p_partkey").alias("id"))).select("id", F.col("id").cast("string").alias("seed"))


@register("gen_chain_problems", oracle=f"""
WITH {_chain_ctes(_PARTS)}
SELECT id, letters, constants, premise_value, rules, letters[{_L["p0"]}] AS premise, letters[{_L["a10"]}] AS target FROM base JOIN rules USING (id)""")
def q_gen_chain_problems(spark, sf):
    """Per seed a letter permutation, 20 constants, the premise's value, and the rules of both branches with the premise."""
    return CH.problems(_parts(spark, sf), WORLD).drop("seed")


_DRAWN = f"""SELECT p_partkey + r * 1000000000000 AS id, p_name || '|' || p_brand || '|' || p_type || '|' || CAST(p_size AS VARCHAR) || '|' || CAST(r AS VARCHAR) AS seed
FROM part, (SELECT unnest(range(4)) AS r)"""


@register("dedup_problems", oracle=lambda: f"""
WITH {_chain_ctes(_DRAWN)},
keyed AS (SELECT id, array_to_string(list_sort(list_distinct(list_transform(rules, lambda r: r.expr))), '|') AS key FROM rules),
firsts AS (SELECT key, min(id) AS id FROM keyed GROUP BY key)
SELECT id // 1000000000000 AS round, id % 1000000000000 AS id, key FROM firsts QUALIFY row_number() OVER (ORDER BY id) <= (SELECT count(*) FROM part)""")
def q_dedup_problems(spark, sf):
    """As many problems as parts, no two with one set of right-hand sides (both branches and the premise).

    Each round draws one problem a part, seeded by the part's description, which
    several parts share; rounds go on until the number is reached.
    """
    part = table(spark, sf, "part")
    said = ["p_name", "p_brand", "p_type", "p_size"]
    # parts of one description draw the same problem, of which the smallest id stays
    seeds = part.groupBy(*said).agg(F.min("p_partkey").alias("id"))

    def rounds(first, end):
        drawn = seeds.select("*", F.explode(F.sequence(F.lit(first).cast("bigint"), F.lit(end - 1).cast("bigint"))).alias("round"))
        drawn = drawn.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "id", "round")
        seed = F.concat_ws("|", "p_name", "p_brand", "p_type", F.col("p_size").cast("string"), F.col("round").cast("string"))
        return CH.problems(drawn.select("round", "id", seed.alias("seed")), WORLD).select("round", "id", CH.rule_set_key().alias("key"))

    return CH.unique_until(lambda r: rounds(r, r + 1), part.count(), ["round", "id"], draw_rounds=rounds)


def _sizes(ids):
    n = ids.count()
    return [(name, n * share // 100) for name, share in SHARES.items()]


_SPLIT = """(SELECT id, seed, split, rn FROM (
  SELECT p_partkey AS id, CAST(p_partkey AS VARCHAR) AS seed, rn,
    CASE WHEN rn <= n * 64 // 100 THEN 'sft' WHEN rn <= n * 64 // 100 + n * 16 // 100 THEN 'rlvr' WHEN rn <= n * 64 // 100 + n * 16 // 100 + n * 10 // 100 THEN 'test' END AS split
  FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS rn, count(*) OVER () AS n FROM part)) WHERE split IS NOT NULL)"""


@register("fixed_splits", oracle="""
SELECT id, split, rn - 1 AS split_index FROM (
  SELECT p_partkey AS id, rn, CASE WHEN rn <= n * 64 // 100 THEN 'sft' WHEN rn <= n * 64 // 100 + n * 16 // 100 THEN 'rlvr'
    WHEN rn <= n * 64 // 100 + n * 16 // 100 + n * 10 // 100 THEN 'test' ELSE 'unused' END AS split
  FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS rn, count(*) OVER () AS n FROM part))""")
def q_fixed_splits(spark, sf):
    """Prefix splits of given sizes by problem order (distributed global rank), every problem with its place; the rest is 'unused'."""
    ids = _parts(spark, sf)
    return CH.split_all(ids.select("id"), _sizes(ids)).select("id", "split", F.col("split_index").cast("bigint"))


_DUCK_FWD = f"""(SELECT id, pos, var, coalesce(lag(var) OVER w, premise_var) || ' + ' || CAST(cst AS VARCHAR) AS expr,
   CAST(p0 + sum(cst) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS value
 FROM {_CS} WINDOW w AS (PARTITION BY id ORDER BY pos))"""


@register("forward_trace", oracle=lambda: f"SELECT id, pos, var, expr, value FROM {_DUCK_FWD}")
def q_forward_trace(spark, sf):
    """C4: running evaluation along the chain: (var, expr, value)."""
    return GN.forward_trace(fixtures.chain_steps(spark, sf))


@register("reverse_trace", oracle=lambda: f"""
SELECT id, CAST(11 - pos AS INTEGER) AS step, coalesce(lag(var, 1) OVER w, premise_var) AS var,
  CASE WHEN pos = 1 THEN CAST(p0 AS VARCHAR) ELSE coalesce(lag(var, 2) OVER w, premise_var) || ' + ' || CAST(lag(cst, 1) OVER w AS VARCHAR) END AS rule,
  CASE WHEN pos = 1 THEN CAST(p0 + sum(cst) OVER s AS VARCHAR)
       ELSE coalesce(lag(var, 2) OVER w, premise_var) || ' + ' || CAST(sum(cst) OVER s + lag(cst, 1) OVER w AS VARCHAR) END AS result
FROM {_CS} WINDOW w AS (PARTITION BY id ORDER BY pos), s AS (PARTITION BY id ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def q_reverse_trace(spark, sf):
    """Back-substitution steps from the target down to the premise."""
    return GN.reverse_trace(fixtures.chain_steps(spark, sf))


@register("problem_text", oracle=lambda: f"WITH {_chain_ctes(_PARTS)} SELECT id, question FROM problem")
def q_problem_text(spark, sf):
    """Question text from the rules of both branches, the premise as rule and as given, and the target."""
    return CH.problems(_parts(spark, sf), WORLD).select("id", CH.question().alias("question"))


@register("solution_text", oracle=lambda: f"WITH {_chain_ctes(_PARTS)} SELECT id, direction, solution FROM solved")
def q_solution_text(spark, sf):
    """Both solutions as text: forward evaluation and back-substitution, with the boxed value."""
    p = CH.problems(_parts(spark, sf), WORLD)
    both = F.explode(F.array(*(F.struct(F.lit(d).alias("direction"), CH.solution(WORLD, d).alias("solution")) for d in ("forward", "reverse"))))
    return p.select("id", both.alias("s")).select("id", "s.*")


_OUTPUT_ROWS = "(VALUES " + ", ".join(f"('{o}', '{sp}', '{d}')" for o, sp, d in [("train_sft_forward", "sft", "forward"), ("train_sft_reverse", "sft", "reverse"), ("train_rlvr", "rlvr", "forward"), ("test", "test", "forward")]) + ") o(output, split, direction)"
_PLACED = f"""(SELECT output, direction, id, row_number() OVER (PARTITION BY output ORDER BY CASE WHEN output = 'test' THEN '' ELSE md5('{GN.SEED}|' || output || '|' || CAST(id AS VARCHAR)) END, id) - 1 AS index
FROM {_SPLIT} JOIN {_OUTPUT_ROWS} USING (split))"""
_DUCK_RECORDS = f"""WITH {_chain_ctes(_PARTS)},
records AS (SELECT output, id, question, solution, answer, {{'data_source': 'arithchain_2_10', 'direction': direction, 'split': output, 'index': index}} AS extra_info
  FROM {_PLACED} JOIN problem USING (id) JOIN solved USING (id, direction))"""


def _placed(spark, sf):
    ids = _parts(spark, sf)
    return CH.placed(CH.splits(ids, _sizes(ids)))


@register("example_records", oracle=lambda: f"{_DUCK_RECORDS} SELECT * FROM records")
def q_example_records(spark, sf):
    """Training and test records of all four outputs (question, solution, answer, extra_info with output and index)."""
    return CH.records(_placed(spark, sf), WORLD)


@register("paired_directions", oracle=lambda: f"""
WITH {_chain_ctes(_PARTS)}
SELECT id, question, f.solution AS forward_solution, r.solution AS reverse_solution, answer, f.final AS forward_value, r.final AS reverse_value, f.final = r.final AS same_answer
FROM problem JOIN solved f USING (id) JOIN solved r USING (id) WHERE f.direction = 'forward' AND r.direction = 'reverse'""")
def q_paired_directions(spark, sf):
    """Each problem with both solutions, and the value that either ends with."""
    p = CH.problems(_parts(spark, sf), WORLD)
    last = lambda d: F.element_at(CH.steps(WORLD, d), -1)["value"]
    return p.select(
        "id", CH.question().alias("question"), CH.solution(WORLD, "forward").alias("forward_solution"), CH.solution(WORLD, "reverse").alias("reverse_solution"),
        CH.answer(WORLD).alias("answer"), last("forward").alias("forward_value"), last("reverse").alias("reverse_value"), (last("forward") == last("reverse")).alias("same_answer"),
    )


@register("shuffle_rows", oracle=f"SELECT output, id, index FROM {_PLACED}")
def q_shuffle_rows(spark, sf):
    """Each training output in its own seeded hash order, the test output in problem order."""
    return _placed(spark, sf).select("output", "id", "index")


def _cf(spark, sf):
    c = fixtures.counterfact(spark, sf)
    a = F.expr("CAST(conv(p, base, 10) AS BIGINT)")
    b = F.expr("CAST(conv(q, base, 10) AS BIGINT)")
    return c.select("id", "base", "p", "q", F.expr("conv(CAST(CAST(conv(p, base, 10) AS BIGINT) + CAST(conv(q, base, 10) AS BIGINT) AS STRING), 10, base)").alias("label"),
                    (F.col("p").try_cast("bigint") + F.col("q").try_cast("bigint")).alias("__dec"), a.alias("__a"), b.alias("__b"))


_DUCK_CF = f"""(SELECT id, base, p, q, {duck.base_digits(duck.base_value('p', 'base') + ' + ' + duck.base_value('q', 'base'), 'base')} AS label,
   TRY_CAST(p AS BIGINT) + TRY_CAST(q AS BIGINT) AS dec FROM {_CF})"""


@register("counterfact_addition", oracle=lambda: f"SELECT id, base, p, q, label FROM {_DUCK_CF}")
def q_counterfact_addition(spark, sf):
    """C11: two-digit addition in base 7/9/11/12 with the base-N label."""
    return _cf(spark, sf).select("id", "base", "p", "q", "label")


@register("counterfact_hard_filter", oracle=lambda: f"""
SELECT id, base, p, q, label FROM {_DUCK_CF} WHERE regexp_matches(p || q, '[A-Z]') OR dec IS NULL OR label <> CAST(dec AS VARCHAR)""")
def q_counterfact_hard_filter(spark, sf):
    """Keep items where a letter digit appears or the base-N sum differs from the base-10 reading."""
    c = _cf(spark, sf)
    hard = F.concat("p", "q").rlike("[A-Z]") | F.col("__dec").isNull() | (F.col("label") != F.col("__dec").cast("string"))
    return c.where(hard).select("id", "base", "p", "q", "label")


@register("unordered_pair_dedup", oracle=lambda: f"""
SELECT least(p, q) AS lo, greatest(p, q) AS hi, base, min(id) AS id FROM {_DUCK_CF} GROUP BY ALL""")
def q_unordered_pair_dedup(spark, sf):
    """One item per unordered pair and base (lowest id kept)."""
    c = fixtures.counterfact(spark, sf)
    return c.groupBy(F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi"), "base").agg(F.min("id").alias("id"))


_BASED = " || ".join([duck.s(GN.BASE_TEXT[0]), "CAST(base AS VARCHAR)", duck.s(GN.BASE_TEXT[1]), f"substr({duck.s(GN.DIGITS)}, 1, base)", duck.s(GN.BASE_TEXT[2]), "p || ' + ' || q", duck.s(GN.BASE_TEXT[3])])


@register("counterfact_prompt", oracle=lambda: f"""
SELECT id, {_BASED} || {duck.s(GN.COT_TAIL)} AS cot_prompt, {_BASED} || {duck.s(GN.PLAIN_TAIL)} AS plain_prompt,
  {duck.s(GN.TRIVIAL_TEXT[0])} || p || ' + ' || q || {duck.s(GN.TRIVIAL_TEXT[1] + GN.PLAIN_TAIL)} AS trivial_prompt
FROM {_CF}""")
def q_counterfact_prompt(spark, sf):
    """C14: question text with and without step-by-step, and the trivial form."""
    c = fixtures.counterfact(spark, sf)
    expr = F.concat("p", F.lit(" + "), "q")
    return c.select("id", GN.counterfact_prompt(expr, F.col("base"), True).alias("cot_prompt"),
                    GN.counterfact_prompt(expr, F.col("base"), False).alias("plain_prompt"), GN.trivial_prompt(expr).alias("trivial_prompt"))


@register("diversity_mix", oracle="""
WITH ex AS (SELECT doc_id, doc_id // 2 AS pid, CASE WHEN doc_id % 2 = 0 THEN 'nl' ELSE 'code' END AS mode FROM documents),
full_pids AS (SELECT pid FROM ex GROUP BY pid HAVING count(DISTINCT mode) = 2),
npid AS (SELECT count(*) AS n FROM full_pids),
ds AS (SELECT 'dataset_level' AS mix, e.pid, mode, doc_id FROM ex e JOIN full_pids USING (pid) WHERE mode = CASE WHEN e.pid % 2 = 0 THEN 'nl' ELSE 'code' END),
pl AS (SELECT 'problem_level' AS mix, e.pid, mode, doc_id FROM ex e JOIN (SELECT pid, row_number() OVER (ORDER BY pid) AS r FROM full_pids) f USING (pid), npid
       WHERE f.r <= npid.n // 2)
SELECT * FROM ds UNION ALL SELECT * FROM pl""")
def q_diversity_mix(spark, sf):
    """NL/code mixes of equal size: one mode per problem vs both modes for half the problems."""
    ex = table(spark, sf, "documents").select("doc_id", F.floor(F.col("doc_id") / 2).cast("bigint").alias("pid"),
                                               F.when(F.col("doc_id") % 2 == 0, "nl").otherwise("code").alias("mode"))
    full = ex.groupBy("pid").agg(F.countDistinct("mode").alias("m")).where("m = 2").select("pid")
    ds = ex.join(full, "pid").where(F.col("mode") == F.when(F.col("pid") % 2 == 0, "nl").otherwise("code")).select(F.lit("dataset_level").alias("mix"), "pid", "mode", "doc_id")
    ranked = global_rank(full, ["pid"], "r")
    half = full.agg(F.floor(F.count(F.lit(1)) / 2)).scalar()  # scalar sub-query, no join
    keep = ranked.where(F.col("r") <= half).select("pid")
    pl = ex.join(keep, "pid").select(F.lit("problem_level").alias("mix"), "pid", "mode", "doc_id")
    return ds.unionByName(pl)
