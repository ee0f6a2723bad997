import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from spendlens.operators import budget, reports, scoring
from spendlens.sources.testdata import facts
from tests.conftest import SF01


def pandas_rank(vals):
    return pd.Series(vals, dtype="float64").rank(pct=True, na_option="bottom").tolist()


def test_pct_rank_matches_pandas_with_ties_and_nulls(spark):
    rnd = random.Random(7)
    vals = [rnd.choice([None, float("nan"), 1.0, 2.0, 2.0, 3.5, rnd.randint(0, 40) / 4])
            for _ in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, v double")
    got = {r.id: r.p for r in scoring.pct_rank_avg(df, "v", "p", parts=5).collect()}
    want = pandas_rank([None if (v is not None and math.isnan(v)) else v for v in vals])
    assert all(got[i] == want[i] for i in range(len(vals)))


def test_null_roas_ranks_best_quirk(spark):
    df = spark.createDataFrame([("a", None, None), ("b", 2.0, 0.1), ("c", 1.0, 0.2)],
                               "channel string, roas double, conversion_rate double")
    s = {r.channel: r.efficiency_score for r in scoring.efficiency_score(df).collect()}
    assert s == {"a": 100.0, "b": 56.67, "c": 43.33}


def test_efficiency_score_missing_column_gives_zero(spark):
    df = spark.createDataFrame([("a", 1.0)], "channel string, roas double")
    assert scoring.efficiency_score(df).first().efficiency_score == 0.0


def test_underperformers(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", None), ("c", 2.0)], "channel string, roas double")
    got = {r.channel: r.underperforming for r in scoring.flag_underperformers(df).collect()}
    assert got == {"a": True, "b": False, "c": False}
    no_col = spark.createDataFrame([("a",)], "channel string")
    assert scoring.flag_underperformers(no_col).first().underperforming is False


def _scored(spark, rows):
    return spark.createDataFrame(rows, "channel string, spend double, roas double, efficiency_score double")


def test_allocation_single_uniform_and_floor(spark):
    one = budget.suggest_allocation(_scored(spark, [("a", 1.0, 1.0, 10.0)])).first()
    assert one.suggested_pct == 1.0
    zero = budget.suggest_allocation(_scored(spark, [("a", 1.0, 1.0, 0.0), ("b", 1.0, 1.0, 0.0)]))
    assert {r.suggested_pct for r in zero.collect()} == {0.5}
    fl = {r.channel: r.suggested_pct for r in budget.suggest_allocation(
        _scored(spark, [("a", 1.0, 1.0, 99.0), ("b", 1.0, 1.0, 1.0)])).collect()}
    assert fl["b"] == pytest.approx(0.05 / (0.99 + 0.05))
    assert fl["a"] + fl["b"] == pytest.approx(1.0)


def test_golden_scores_and_shares_sf001(spark):
    """Expected values of the sf0.01 channel-grain adapter (FIXTURES §3)."""
    res = budget.run_optimization(reports.channel_summary(facts(spark, SF01)))
    got = {r.channel: (r.efficiency_score, round(r.current_pct, 6), round(r.suggested_pct, 6))
           for r in res.comparison.collect()}
    want = {"brand": (100.00, 0.0, 0.249109), "organic": (85.71, 0.0, 0.213512),
            "machinery": (67.14, 0.198537, 0.167252), "building": (61.43, 0.197693, 0.153028),
            "automobile": (42.86, 0.193123, 0.106768), "household": (24.29, 0.204958, 0.060509),
            "furniture": (18.57, 0.205689, 0.049822)}
    assert got == want
    lines = [r.insight for r in res.insights.orderBy("ord").collect()]
    assert lines[0].startswith("**Brand** shows the highest efficiency potential")
    assert lines[1].startswith("**Furniture** is currently over-funded")
    assert len(lines) == 2  # mean score 57.14: no portfolio line


def test_narrative_edges(spark):
    empty = _scored(spark, []).withColumn("suggested_pct", F.lit(0.0))
    cmp = budget.current_vs_suggested(empty, None)
    assert [r.insight for r in budget.optimization_insights(cmp).collect()] == [
        "No data available for optimization insights."]
    two = budget.run_optimization(spark.createDataFrame(
        [("a", 10.0, 50.0, 5.0, 0.1), ("b", 20.0, 30.0, 1.5, 0.05)],
        "channel string, total_spend double, total_revenue double, roas double, conversion_rate double"))
    lines = [r.insight for r in two.insights.orderBy("ord").collect()]
    assert lines[-1].startswith("Overall portfolio efficiency is strong")  # n=2: mean 75


def test_pct_rank_nulls_worst_matches_pandas_top(spark):
    vals = [None, 3.0, 1.0, None, 3.0, 2.0, float("nan")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, v double")
    got = {r.id: r.p for r in scoring.pct_rank_avg(df, "v", "p", parts=3,
                                                   nulls="worst").collect()}
    want = pd.Series(vals, dtype="float64").rank(pct=True, na_option="top").tolist()
    assert [got[i] for i in range(len(vals))] == want
