"""Counted samples and observed statistics."""

import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import stats, tuning


@pytest.mark.parametrize("n", [0, 1, 37, 500, 999, 1000, 5000])
def test_capped_takes_the_first_rows(spark, n):
    rng = random.Random(2)
    rows = [(rng.randrange(300) if rng.random() < 0.97 else None, i % 7, f"text {i}") for i in range(1000)]
    df = spark.createDataFrame(rows, "a int, b int, text string").repartition(6)
    got = tuning.capped(df, n, "a", "b").collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(map(key, got)) == sorted(map(key, rows))[:n]
    assert len(set(got)) == len(got) and set(map(tuple, got)) <= set(rows)


def test_capped_among_equal_rows(spark):
    df = spark.createDataFrame([(1, "same")] * 400 + [(0, "first")] * 3, "a int, text string").repartition(5)
    got = [tuple(r) for r in tuning.capped(df, 100, "a").collect()]
    assert sorted(got) == [(0, "first")] * 3 + [(1, "same")] * 97
    assert tuning.capped(df, None, "a").count() == 403
    assert tuning.capped(df.filter("false"), 5, "a").count() == 0


def test_capped_gathers_no_rows(spark):
    """Texts are only filtered: no sort, exchange or global limit lies above the rows before the last key."""
    df = spark.range(5000).select("id", F.repeat(F.lit("t"), 50).alias("text"))
    kept = tuning.capped(df, 2500, "id")
    plan = kept._jdf.queryExecution().optimizedPlan().children().apply(0).toString()
    assert "Sort" not in plan and "Repartition" not in plan and "Limit" not in plan
    assert kept.count() == 2500 and kept.agg(F.max("id")).first()[0] == 2499


def results(spark, rows):
    return spark.createDataFrame(rows, "severity string, source string, elapsed_ms double")


ROWS = [("P0_CRITICAL", "rule", None), ("P3_IGNORE", "rule", None), ("P1_HIGH", "llm", 12.0), ("P2_WARNING", "llm", 30.0), ("P1_HIGH", "default", 7.0)]


@pytest.mark.parametrize("rows", [[], ROWS, ROWS * 40])
def test_observed_statistics_equal_the_scans(spark, tmp_path, rows):
    told = results(spark, rows).repartition(3)
    run = stats.write_with_stats(told, f"{tmp_path}/r")
    kept = spark.read.schema(told.schema).parquet(f"{tmp_path}/r")
    for ours, theirs in (
        (run.by_severity(), stats.by_severity(kept)),
        (run.by_source(), stats.by_source(kept)),
        (run.run_totals(), stats.run_totals(kept)),
    ):
        assert ours.columns == theirs.columns and sorted(ours.collect()) == sorted(theirs.collect())


def jobs(spark, name, action):
    context = spark.sparkContext
    context.setJobGroup(name, name)
    try:
        action()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    return len(context.statusTracker().getJobIdsForGroup(name))


def test_statistics_cost_no_job(spark, tmp_path):
    told = results(spark, ROWS * 10).coalesce(2)
    plain = jobs(spark, "plain write", lambda: told.write.parquet(f"{tmp_path}/a"))

    def observed():
        run = stats.write_with_stats(told, f"{tmp_path}/b")
        assert run.metrics["total"] == 50 and run.metrics["source llm"] == 20

    assert jobs(spark, "observed write", observed) == plain
