"""C1-C9, A11 — chain problems on a rule graph with branches that share a premise.

A ``World`` declares rules ``node = parent + constant``, a premise, a target and
the order in which each direction visits the nodes.  Everything a problem holds
(letters, constants, rules, both solutions, the texts) is a function of its seed,
so it is computed by narrow projections from the seed alone; only ids and order
keys go through exchanges, and texts are made after the last one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverlens.operators.generate import MAX_CONST, OPENINGS, SEED, hashed_slots, letter_permutation, problem_text, seeded
from coverlens.operators.ranking import global_rank, rank_within
from coverlens.session import scratch_dir

# --- fixed values: solution wording, names of the outputs -----------------------
FORWARD_LINE = ("{i}. ", " = ", " = ", ".")
REVERSE_LINE = ("{i}. Substitute ", " = ", " into the target expression, yielding ", " = ", ".")
CLOSING = ("\nThus, ", " = \\boxed{", "}.")
OUTPUTS = {"train_sft_forward": ("sft", "forward"), "train_sft_reverse": ("sft", "reverse"), "train_rlvr": ("rlvr", "forward"), "test": ("test", "forward")}
# ------------------------------------------------------------------------------


@dataclass(frozen=True)
class World:
    """Rules in the order of the text, as (node, parent); the n-th rule adds the n-th constant."""

    name: str
    rules: tuple[tuple[str, str], ...]
    premise: str
    target: str
    forward: tuple[str, ...]
    reverse: tuple[str, ...]

    def __post_init__(self):
        known = {self.premise}
        for node in self.forward:  # a step may only use what stands before it
            if self.parent(node) not in known:
                raise ValueError(f"{self.name}: {node} needs {self.parent(node)} before it")
            known.add(node)
        if self.target not in known:
            raise ValueError(f"{self.name}: the forward solution does not reach {self.target}")
        open_node = self.parent(self.target)
        for node in self.reverse:
            if node != open_node:
                raise ValueError(f"{self.name}: {node} is not in the target expression")
            open_node = None if node == self.premise else self.parent(node)
        if open_node is not None:
            raise ValueError(f"{self.name}: the reverse solution does not end at the premise")
        if len(self.nodes) > 26:
            raise ValueError(f"{self.name}: more nodes than letters")

    @property
    def nodes(self) -> list[str]:
        """All nodes in the order in which they take letters."""
        return sorted({self.premise, *(n for n, _ in self.rules)})

    def parent(self, node: str) -> str:
        return dict(self.rules)[node]

    def slot(self, node: str) -> int:
        return [n for n, _ in self.rules].index(node)


def branches(name: str, n_branches: int, steps: int) -> World:
    """``n_branches`` chains of ``steps`` additive rules from one premise; the target ends the first."""
    rules = []
    for b in "abcdefghijklmno"[:n_branches]:
        rules += [(f"{b}{i}", f"{b}{i - 1}" if i > 1 else "p0") for i in range(1, steps + 1)]
    path = tuple(f"a{i}" for i in range(1, steps + 1))
    return World(name, tuple(rules), "p0", path[-1], path, (*path[-2::-1], "p0"))


ARITHCHAIN_2_10 = branches("arithchain_2_10", 2, 10)


def problems(seeds: DataFrame, world: World, max_const: int = MAX_CONST, seed: int = SEED) -> DataFrame:
    """``seeds`` (a column ``seed`` that decides the content) with letters, constants, the premise's value and the rules.

    Added: letters, constants, premise_value, ``rules`` (array of var, expr: every rule
    in order, the premise's value last), ``premise`` and ``target`` (letters).
    """
    s = F.col("seed")
    drawn = seeds.select(
        "*", letter_permutation(s, seed).alias("letters"), hashed_slots(s, len(world.rules), seed, max_const).alias("constants"),
        (seeded(s, F.lit(-1), seed) % max_const + 1).alias("premise_value"),
    )
    rules = [F.struct(_letter(world, n).alias("var"), _expr(world, n).alias("expr")) for n, _ in world.rules]
    rules.append(F.struct(_letter(world, world.premise).alias("var"), F.col("premise_value").cast("string").alias("expr")))
    return drawn.select("*", F.array(*rules).alias("rules"), _letter(world, world.premise).alias("premise"), _letter(world, world.target).alias("target"))


def _letter(world: World, node: str) -> Column:
    return F.col("letters")[world.nodes.index(node)]


def _expr(world: World, node: str) -> Column:
    return F.concat(_letter(world, world.parent(node)), F.lit(" + "), F.col("constants")[world.slot(node)].cast("string"))


def _sum(terms: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def steps(world: World, direction: str) -> Column:
    """The solution's steps in order, as an array of (var, expr, value).

    Forward evaluates each node of the path.  Reverse substitutes each node of the
    path into the target's expression; value is the expression then, the integer at last.
    """
    out, terms = [], {world.premise: [F.col("premise_value")]}
    constant = lambda n: F.col("constants")[world.slot(n)]
    if direction == "forward":
        for node in world.forward:
            terms[node] = [*terms[world.parent(node)], constant(node)]
            out.append((_letter(world, node), _expr(world, node), _sum(terms[node]).cast("string")))
    elif direction == "reverse":
        held = [constant(world.target)]
        for node in world.reverse:
            if node == world.premise:
                out.append((_letter(world, node), F.col("premise_value").cast("string"), _sum([F.col("premise_value"), *held]).cast("string")))
            else:
                held.append(constant(node))
                out.append((_letter(world, node), _expr(world, node), F.concat(_letter(world, world.parent(node)), F.lit(" + "), _sum(held).cast("string"))))
    else:
        raise ValueError(f"Unknown direction: {direction}")
    return F.array(*(F.struct(v.alias("var"), e.alias("expr"), x.alias("value")) for v, e, x in out))


def answer(world: World) -> Column:
    """The target's value, along the rules from the premise."""
    terms, node = [], world.target
    while node != world.premise:
        terms.append(F.col("constants")[world.slot(node)])
        node = world.parent(node)
    return _sum([F.col("premise_value"), *terms])


def question() -> Column:
    """The question from the columns of ``problems``; the premise stands both as a rule and as a given."""
    rules = F.transform("rules", lambda r: F.concat(r["var"], F.lit(" = "), r["expr"]))
    return problem_text(rules, F.concat("premise", F.lit(" = "), F.col("premise_value").cast("string")), F.col("target"))


def solution(world: World, direction: str, seed: int = SEED) -> Column:
    """An opening sentence drawn by seed and direction, a numbered line for each step, the boxed value."""
    number = lambda head, i: F.concat((i + 1).cast("string"), F.lit(head.removeprefix("{i}")))

    def line(s, i):
        if direction == "forward":
            head, a, b, end = FORWARD_LINE
            return F.concat(number(head, i), s["var"], F.lit(a), s["expr"], F.lit(b), s["value"], F.lit(end))
        head, a, b, c, end = REVERSE_LINE
        return F.concat(number(head, i), s["var"], F.lit(a), s["expr"], F.lit(b), F.col("target"), F.lit(c), s["value"], F.lit(end))

    opening = F.array(*map(F.lit, OPENINGS))[(seeded(F.col("seed"), F.lit(f"opening-{direction}"), seed) % len(OPENINGS)).cast("int")]
    a, b, end = CLOSING
    closing = F.concat(F.lit(a), F.col("target"), F.lit(b), answer(world).cast("string"), F.lit(end))
    return F.array_join(F.concat(F.array(opening), F.transform(steps(world, direction), line), F.array(closing)), "\n")


def rule_set_key() -> Column:
    """What makes two problems one: the set of right-hand sides of all rules, both branches and the premise."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform("rules", lambda r: r["expr"]))), "|")


def unique_until(
    draw: Callable[[int], DataFrame], size: int, order: Sequence[str], most_rounds: int = 100, draw_rounds: Callable[[int, int], DataFrame] | None = None,
) -> DataFrame:
    """Exactly ``size`` rows with different ``key``: the first of each key in the order of drawing, cut after ``size``.

    ``draw(r)`` gives round r's rows, of which ``order`` is a total order over all rounds;
    rows of a later round come after all rows of an earlier one.  ``draw_rounds(a, b)``,
    where given, draws the rounds from a up to b at once.  Rounds are drawn in steps: a step
    takes as many as the rest needs at the last step's rate of new keys, which falls, so
    the steps are few however many rounds it takes and none draws far beyond ``size``.
    A step keeps one row of each key (map-side first), drops the keys of earlier steps by an
    anti-join and is written to the shared folder, so the result depends neither on
    partitions nor on the steps.  ``most_rounds`` in a row without a new key are an error.
    """
    spark, path, have, r, step, barren = None, None, 0, 0, 1, 0
    while barren < most_rounds:
        rows = draw(r) if step == 1 else draw_rounds(r, r + step) if draw_rounds else reduce(DataFrame.unionByName, map(draw, range(r, r + step)))
        names = rows.columns
        if path is None:
            spark = rows.sparkSession
            path = scratch_dir(spark, f"unique-{uuid.uuid4().hex}")
            schema = rows.schema
        first = rows.groupBy("key").agg(F.min(F.struct(*order, *(n for n in names if n not in order and n != "key"))).alias("row")).select("key", "row.*").select(names)
        if r:
            first = first.join(spark.read.schema(schema).parquet(f"{path}/round=*").select("key"), "key", "left_anti")
        new = f"{scratch_dir(spark, f'drawn-{uuid.uuid4().hex}')}"
        first.write.parquet(new)
        found = spark.read.schema(schema).parquet(new)
        n = found.count()
        if have + n > size:
            found = global_rank(found, list(order), "__rank").where(F.col("__rank") <= size - have).drop("__rank")
        found.write.parquet(f"{path}/round={r}")
        r, have, barren = r + step, have + min(n, size - have), 0 if n else barren + step
        if have == size:
            return spark.read.schema(schema).parquet(f"{path}/round=*")
        step = max(1, -(-(size - have) * step // n)) if n else min(2 * step, most_rounds - barren)
    raise RuntimeError(f"{have} of {size} different problems after {r} rounds")


def split_all(ids: DataFrame, sizes: Sequence[tuple[str, int]], order: str = "id") -> DataFrame:
    """Every row with its prefix split of the given sizes in ``order``, 'unused' beyond them, and ``split_index``, its place in ``order`` from 0."""
    ranked, lo, split = global_rank(ids, [order], "__rank"), 0, F.lit("unused")
    for name, size in sizes:
        split, lo = F.when((F.col("__rank") > lo) & (F.col("__rank") <= lo + size), F.lit(name)).otherwise(split), lo + size
    return ranked.withColumn("split", split).withColumn("split_index", F.col("__rank") - 1).drop("__rank")


def splits(ids: DataFrame, sizes: Sequence[tuple[str, int]], order: str = "id") -> DataFrame:
    """The rows of the given splits alone, without those beyond them."""
    return split_all(ids, sizes, order).where(F.col("split").isin([name for name, _ in sizes])).drop("split_index")


def placed(split: DataFrame, seed: int = SEED) -> DataFrame:
    """One row for each output that a problem of a split stands in, with its place there from 0.

    An sft problem stands in both directions' outputs.  Training outputs are shuffled each
    by its own seeded hash order, the test output keeps the order of ids.
    """
    of = [F.struct(F.lit(o).alias("output"), F.lit(d).alias("direction"), F.lit(s).alias("of")) for o, (s, d) in OUTPUTS.items()]
    rows = split.select("*", F.explode(F.array(*of)).alias("o")).where("o.of = split").select("*", "o.output", "o.direction").drop("o", "split")
    h = F.when(F.col("output") == "test", F.lit("")).otherwise(F.md5(F.concat_ws("|", F.lit(seed), "output", "id")))
    return rank_within(rows.withColumn("__h", h), "output", ["__h", "id"], "index").withColumn("index", F.col("index") - 1).drop("__h")


def records(placed_rows: DataFrame, world: World, max_const: int = MAX_CONST, seed: int = SEED) -> DataFrame:
    """(output, id, question, solution, answer, extra_info) of placed rows with a column ``seed``; no exchange."""
    p = problems(placed_rows, world, max_const, seed)
    text = F.when(F.col("direction") == "forward", solution(world, "forward", seed)).otherwise(solution(world, "reverse", seed))
    info = F.struct(F.lit(world.name).alias("data_source"), "direction", F.col("output").alias("split"), "index")
    return p.select("output", "id", question().alias("question"), text.alias("solution"), answer(world).alias("answer"), info.alias("extra_info"))


def write_outputs(rows: DataFrame, path: str) -> None:
    """One Parquet folder for each output, and the test items as JSON records (id, Question, answer, subset)."""
    rows.write.mode("overwrite").partitionBy("output").parquet(f"{path}/records")
    test = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/records").where("output = 'test'")
    test.select(
        F.col("extra_info.index").alias("id"), F.col("question").alias("Question"), "answer", F.col("extra_info.data_source").alias("subset")
    ).write.mode("overwrite").json(f"{path}/test_items")
