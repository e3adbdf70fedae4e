"""Chain problems: worlds, hand-worked texts, exact sizes under collisions."""

import pytest
from pyspark.sql import functions as F

from coverlens.operators import chains as CH


def row(spark, world, letters, constants, premise):
    df = spark.createDataFrame([("s", letters, constants, premise)], "seed string, letters array<string>, constants array<long>, premise_value long")
    return df.select("*", F.lit(letters[world.nodes.index("p0")]).alias("premise"), F.lit(letters[world.nodes.index(world.target)]).alias("target"))


def test_hand_worked_chain(spark):
    w = CH.branches("two", 2, 3)  # nodes a1 a2 a3 b1 b2 b3 p0
    df = row(spark, w, list("xyzuvwp"), [4, 5, 6, 7, 8, 9], 3)
    got = df.select(CH.steps(w, "forward").alias("f"), CH.steps(w, "reverse").alias("r"), CH.answer(w).alias("a")).first()
    assert [tuple(s) for s in got.f] == [("x", "p + 4", "7"), ("y", "x + 5", "12"), ("z", "y + 6", "18")]
    assert [tuple(s) for s in got.r] == [("y", "x + 5", "x + 11"), ("x", "p + 4", "p + 15"), ("p", "3", "18")]
    assert got.a == 18
    text = df.select(CH.solution(w, "reverse").alias("t")).first().t.split("\n", 1)[1]
    assert text == (
        "1. Substitute y = x + 5 into the target expression, yielding z = x + 11.\n"
        "2. Substitute x = p + 4 into the target expression, yielding z = p + 15.\n"
        "3. Substitute p = 3 into the target expression, yielding z = 18.\n\nThus, z = \\boxed{18}."
    )


def test_both_branches_are_rules(spark):
    r = CH.problems(spark.createDataFrame([("1",)], "seed string"), CH.ARITHCHAIN_2_10).first()
    assert len(r.rules) == 21 and len({x["var"] for x in r.rules}) == 21
    a1, b1 = r.rules[0], r.rules[10]
    assert a1["expr"].split(" + ")[0] == b1["expr"].split(" + ")[0] == r.premise
    assert r.rules[-1]["expr"] == str(r.premise_value) and r.rules[9]["var"] == r.target


@pytest.mark.parametrize("forward,reverse", [(("a2", "a1"), ("a1", "p0")), (("a1",), ("a1", "p0")), (("a1", "a2"), ("b1", "p0")), (("a1", "a2"), ("a1",))])
def test_solutions_that_do_not_fit_are_errors(forward, reverse):
    with pytest.raises(ValueError):
        CH.World("bad", (("a1", "p0"), ("a2", "a1"), ("b1", "p0")), "p0", "a2", forward, reverse)


def expected(draws, size):
    seen, out = set(), []
    for r, rows in enumerate(draws):
        for i, key in sorted(rows):
            if key not in seen and len(out) < size:
                seen.add(key)
                out.append((r, i, key))
    return out


@pytest.mark.parametrize("size", [1, 7, 23, 30])
def test_exact_size_with_collisions(spark, size):
    draws = [[(i, f"k{i * i % 17 + r}") for i in range(40)] for r in range(40)]
    make = lambda parts: lambda r: spark.createDataFrame([(r, *x) for x in reversed(draws[r])], "round long, id long, key string").repartition(parts)
    want = expected(draws, size)
    for parts in (1, 5):
        got = CH.unique_until(make(parts), size, ["round", "id"])
        assert sorted(map(tuple, got.collect())) == want and len(want) == size


def test_too_few_problems_is_an_error(spark):
    with pytest.raises(RuntimeError):
        CH.unique_until(lambda r: spark.createDataFrame([(r, 1, "one")], "round long, id long, key string"), 2, ["round", "id"], most_rounds=3)


def test_every_problem_is_in_a_split_or_unused(spark):
    rows = CH.split_all(spark.range(30).select((F.col("id") * 7).alias("id")).repartition(4), [("sft", 19), ("rlvr", 4), ("test", 3)]).collect()
    names = ["sft"] * 19 + ["rlvr"] * 4 + ["test"] * 3 + ["unused"] * 4
    assert sorted((r.id, r.split, r.split_index) for r in rows) == [(i * 7, names[i], i) for i in range(30)]


def test_fixed_splits_returns_every_part(spark):
    from coverlens.plans import registry

    rows = registry.queries()["fixed_splits"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/part.parquet").count() and "unused" in {r.split for r in rows}


def test_more_rounds_than_most_rounds_when_each_brings_new_problems(spark):
    drawn = []

    def rounds(first, end):
        drawn.append((first, end))
        return spark.range(first, end).selectExpr("id AS round", "CAST(1 AS BIGINT) AS id", "concat('k', id) AS key")

    got = CH.unique_until(lambda r: rounds(r, r + 1), 150, ["round", "id"], draw_rounds=rounds)
    assert sorted(r.round for r in got.collect()) == list(range(150)) and drawn == [(0, 1), (1, 150)]
