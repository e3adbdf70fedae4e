"""Plan-shape checks: the properties the design relies on at scale."""

import pytest

from tests.conftest import SF_SMALL
from coverlens.plans import registry


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cutoff_uses_partial_window_group_limit(spark):
    from coverlens.operators.estimators import first_n_cutoff
    from coverlens.plans import fixtures

    df = first_n_cutoff(fixtures.outcomes(spark, SF_SMALL), ["run", "question_id"], "sample_id", 16)
    df._jdf.queryExecution().executedPlan()
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "WindowGroupLimit" in plan


def test_scan_prunes_columns_and_pushes_filters(spark):
    from pyspark.sql import functions as F

    from coverlens.sources.tables import table

    df = table(spark, SF_SMALL, "lineitem").where(F.col("l_quantity") > 5).select("l_partkey")
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,5.0)]" in plan
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double>" in plan


def test_no_cartesian_products_in_registered_queries(spark):
    for key in ["pass_at_k", "pass_at_k_by_run", "pass_at_k_multi_test", "coverage_set_ops", "diversity_mix", "prefix_variants", "job_matrix"]:
        df = registry.queries()[key](spark, SF_SMALL)
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, key


def test_streaming_counts_equal_batch(spark):
    q = registry.queries()
    stream = {tuple(r) for r in q["stream_pass_counts"](spark, SF_SMALL).select("run", "question_id", "n", "c").collect()}
    from pyspark.sql import functions as F

    from coverlens.plans import fixtures
    from coverlens.plans.evaluation import process_generations

    batch = process_generations(fixtures.generations(spark, SF_SMALL)).groupBy("run", "question_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_correct").alias("c")
    )
    assert stream == {tuple(r) for r in batch.collect()}


@pytest.mark.parametrize("key", ["problem_text", "paired_directions", "solution_text", "gen_chain_problems", "question_union", "grade_linear_equations"])
def test_texts_and_grades_of_a_small_file_use_every_core(spark, key):
    assert registry.queries()[key](spark, SF_SMALL).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_residual_rows_are_not_filtered_below_the_cascade(spark):
    plan = registry.queries()["symbolic_residual"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and "Filter" not in plan
