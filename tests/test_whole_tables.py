"""Registered queries take their tables whole, as delivered."""

import statistics
from datetime import datetime, timedelta

import pytest

from ledgerloom.operators.relational import scaled
from ledgerloom.plans import registry

QUERIES = registry.queries()


def test_price_regimes_keep_suppliers_apart(spark, tmp_path):
    # Suppliers 1 and 11 on the same days: one rises by half and falls back, the other stays.
    rows = [(s, 1.0, 10.0 * (1.5 if s == 1 and d % 2 else 1.0), datetime(2000, m, 1) + timedelta(days=d)) for s in (1, 11) for m in (1, 2) for d in range(4)]
    spark.createDataFrame(rows, "l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r["grp"], r["month"]): r["volatility"] for r in QUERIES["price_regimes"](spark, str(tmp_path)).collect()}
    assert set(got) == {(s, m) for s in (1, 11) for m in ("2000-01", "2000-02")}
    assert got[11, "2000-01"] == got[11, "2000-02"] == 0.0 and got[1, "2000-01"] == pytest.approx(statistics.pstdev([0.5, -1 / 3, 0.5]) * 252**0.5, abs=1e-6)


def test_feature_scaling_takes_balances_as_delivered(spark, tmp_path):
    spark.createDataFrame([(i, float(i)) for i in range(1, 15)], "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r["s_suppkey"]: r for r in QUERIES["feature_scaling"](spark, str(tmp_path)).collect()}
    assert all(r["bal_missing"] == 0 for r in got.values()) and [got[k]["bal_wins"] for k in (7, 14)] == [7.0, 14.0]


def test_scaling_imputes_the_median(spark):
    rows = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0), (4, 8.0)], "k long, x double")
    got = {r["k"]: (r["x_wins"], r["x_missing"]) for r in scaled(rows, "k", ["x"]).collect()}
    assert got == {1: (1.0, 0), 2: (3.0, 1), 3: (3.0, 0), 4: (8.0, 0)}


def test_brier_tracker_takes_a_thousand(spark, tmp_path):
    # The newest 1000 of 1200 are rated; of these the newest 300 agree, the 700 before don't.
    rows = [(i, "d", "m", "a", "a" if i >= 900 else "b", "a", 1.0, 1.0, datetime(2024, 1, 1) + timedelta(hours=i), 1) for i in range(1200)]
    spark.createDataFrame(
        rows, "label_id long, label_domain string, source_model string, proposed_label string, human_label string, second_label string, model_confidence double, human_confidence double, created_at timestamp_ntz, label_version int"
    ).write.parquet(f"{tmp_path}/labels.parquet")
    assert [tuple(r) for r in QUERIES["brier_tracker"](spark, str(tmp_path)).collect()] == [("d", 1000, 0.7)]
