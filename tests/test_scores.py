import math

import pytest
from pyspark.sql import functions as F

from glosswork.functions import scores as s
from glosswork.operators import tuning


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("counts, want", [((8, 10, 10, 20), 0.397166), ((25, 50, 50, 100), -0.000385), ((5, 50, 50, 100), -1.466722), ((1, 1, 1, 0), 0.0)])
def test_pmi(spark, counts, want):
    assert value(spark, s.pmi(*map(F.lit, counts))) == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("counts, want", [((50, 50, 50, 100), 1.0), ((0, 50, 50, 100), 0.0), ((10, 20, 20, 100), 0.414095), ((99, 100, 100, 100), 0.0), ((100, 100, 100, 100), 1.0), ((0, 0, 0, 0), 0.0)])
def test_npmi(spark, counts, want):
    assert value(spark, s.npmi(*map(F.lit, counts))) == pytest.approx(want, abs=1e-6)


def test_association_without_documents(spark):
    assert value(spark, s.association(F.lit(1), F.lit(0), F.lit(3), F.lit(9))) == 0


@pytest.mark.parametrize("ratio, want", [(0.01, 1.0), (0.7, 0.1), (0.45, 0.55), (0.3, 1.0), (0.6, 0.1)])
def test_damping(spark, ratio, want):
    assert value(spark, s.damping(F.lit(ratio))) == pytest.approx(want)


def test_other_kernels(spark):
    assert value(spark, s.recency(F.lit(14.0), 14.0)) == pytest.approx(math.exp(-1))
    assert value(spark, s.recency(F.lit(14.0), 0)) == 0
    assert value(spark, s.rule_confidence(F.lit(1.4), F.lit(20))) == pytest.approx(0.787394, abs=1e-6)
    assert value(spark, s.surprise(F.lit(2.0), F.lit(1.8), F.lit(0.05))) == pytest.approx(0.898683, abs=1e-6)
    assert value(spark, s.authority(F.lit(0))) == 0
    assert value(spark, s.damped_pair(F.lit(2.0), F.lit(0.25), F.lit(1.0))) == 1
    assert value(spark, s.total(s.Weights(), F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1.0))) == pytest.approx(2.55)


def test_stop_candidates(spark):
    rows = [("the", 90.0, 0.05, 0.95), ("solar", 20.0, 1.8, 0.3), ("said", 85.0, 0.08, 0.88), ("python", 40.0, 1.5, 0.5)]
    df = spark.createDataFrame(rows, "token string, df_percent double, pmi_max double, entropy double")
    assert sorted(r["token"] for r in tuning.stop_candidates(df).collect()) == ["said", "the"]
    df = spark.createDataFrame([("source", 95.0, 0.0, 0.35), ("https", 90.0, 0.0, 0.2), ("rare", 10.0, 0.0, 0.9)], df.schema)
    got = tuning.stop_candidates(df).collect()
    assert sorted(r["token"] for r in got) == ["https", "source"] and all(r["bootstrap"] for r in got)
    assert {r["token"]: r["score"] for r in got}["https"] == pytest.approx((0.9 + 1 + 0.4) / 3)


def test_rules_and_lines(spark):
    df = spark.createDataFrame([("machine-learning", "neural-network", 20, 1.4), ("ai", "finance", 50, 0.4)], "t1 string, t2 string, n long, score double")
    out = tuning.rules(df)
    assert [r["subject"] for r in out.collect()] == ["machine-learning"]
    assert tuning.rule_lines(out).first()["line"] == "related_to(machine_learning, neural_network). % confidence 0.79 support 20"
