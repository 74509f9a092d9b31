"""Operators on small cases whose results are known."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import concentration as C
from ledgerloom.operators import evaluation as E
from ledgerloom.operators import graph as G
from ledgerloom.operators import lots as L
from ledgerloom.operators import models as M
from ledgerloom.operators import series as S
from ledgerloom.operators.ranking import ranked

T0 = dt.datetime(2025, 1, 1)


def at(h):
    return T0 + dt.timedelta(hours=h)


def test_five_holders(spark):
    df = spark.createDataFrame([("m", w, b, 1.0) for w, b in zip("abcde", (30.0, 20.0, 15.0, 10.0, 5.0), strict=True)] + [("m", "z", 0.0, 1.0), ("m", "y", None, 1.0), ("n", "a", 7.0, 1.0)], "mint string, wallet string, balance double, hhi double")
    rows = {r.mint: r for r in C.snapshot_metrics(df, top=2).collect()}
    m = rows["m"]
    assert (m.holder_count, m.hhi, m.gini, m.entropy, m.wdr) == (5, 0.2578125, 0.3, 1.461472, 0.625)
    assert (rows["n"].gini, rows["n"].hhi, rows["n"].wdr) == (0.0, 1.0, 1.0)
    assert C.snapshot_metrics(df.limit(0)).count() == 0


def test_ranks_span_partitions(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "x", None]), i, float(rng.randrange(50))) for i in range(600)]
    out = ranked(spark.createDataFrame(rows, "g string, i int, v double").repartition(5), ["g"], [F.col("v"), F.col("i")], {"run": F.col("v")}).collect()
    for g in ("hot", "x", None):
        want = sorted((v, i) for k, i, v in rows if k == g)
        got = sorted((r.v, r.i, r.rank, r.run, r.size) for r in out if r.g == g)
        total = 0.0
        for n, ((v, i), r) in enumerate(zip(want, got, strict=True), 1):
            total += v
            assert r == (v, i, n, total, len(want))


def test_sessions_gap_of_exactly_the_limit_joins(spark):
    df = spark.createDataFrame([("a", at(0), 1), ("a", at(1), 2), ("a", at(2.5), 3), ("a", at(60), 4), (None, at(1), 5), ("b", None, 6)], "k string, t timestamp_ntz, i int")
    got = sorted((r.k or "", r.n) for r in S.sessions(df, ["k"], "t", ["i"], 3600).collect())
    assert got == [("", 1), ("a", 1), ("a", 1), ("a", 2)]


def test_fifo_ties_and_oversold(spark):
    df = spark.createDataFrame([("w", 1, 5.0, "b1"), ("w", 1, 3.0, "b2"), ("w", 2, -6.5, "s1"), ("w", 3, -4.0, "s2"), ("w", 4, 1.0, "b3"), ("v", 1, -2.0, "s3"), ("w", 5, 0.0, "n")], "w string, t int, a double, id string")
    m = L.fifo_matches(df, ["w"], ["t", "id"], "a", "id")
    # The line of amounts: s2 sells 1.5 of b2 and, as b3 is bought later, the next 1.0 falls on b3.
    assert sorted((r.buy, r.sell, r.matched) for r in m.collect()) == [("b1", "s1", 5.0), ("b2", "s1", 1.5), ("b2", "s2", 1.5), ("b3", "s2", 1.0)]
    assert L.open_lots(df, m, ["w"], "a", "id").count() == 0


def test_anchored_windows(spark):
    df = spark.createDataFrame([("f", at(h)) for h in (0, 10, 24, 25, 48.5, 49, 80)] + [("g", at(1)), ("g", None), (None, at(1))], "src string, ts timestamp_ntz")
    got = sorted((r.src, r.window_start, r.n) for r in G.anchored_windows(df, "src", "ts", 86_400).collect())
    assert got == [("f", at(0), 3), ("f", at(25), 3), ("f", at(80), 1), ("g", at(1), 1)]


def test_shared_items_are_transitive_and_need_two(spark):
    rows = [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("b", 3), ("c", 2), ("c", 3), ("d", 3), ("e", None), (None, 1)]
    got = {r.k: r.group for r in G.shared_item_groups(spark.createDataFrame(rows, "k string, i int"), "k", "i").collect()}
    assert got == {"a": "a", "b": "a", "c": "a"}


def test_components_and_triangles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (7, 8), (8, 7), (9, 9), (None, 1)], "u long, v long")
    assert {r.node: r.component for r in G.components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7}
    r = G.network_summary(e).first()
    assert (r.nodes, r.edges, r.triangles, r.largest_component) == (6, 5, 1, 4) and r.transitivity == pytest.approx(3 / 5)
    assert G.components(e.limit(0)).count() == 0


def test_cox_matches_a_plain_newton_step(spark):
    rng = np.random.default_rng(3)
    n = 300
    x = rng.normal(size=n)
    t = np.ceil(rng.exponential(30 / np.exp(0.8 * x)))
    ev = (rng.random(n) < 0.8).astype(int)
    df = spark.createDataFrame([(float(a), int(b), float(c)) for a, b, c in zip(t, ev, x, strict=True)] + [(None, 1, 0.0), (3.0, 1, None)], "d double, e int, x double")
    beta = 0.0
    for _ in range(30):
        g, h = -0.1 * beta, 0.1
        for i in np.flatnonzero(ev):
            risk = t >= t[i]
            w = np.exp(beta * x[risk])
            m = (w * x[risk]).sum() / w.sum()
            g += x[i] - m
            h += (w * x[risk] ** 2).sum() / w.sum() - m * m
        beta += g / h
    r = E.cox_fit(df, "d", "e", ["x"]).first()
    assert r.coefficient == pytest.approx(beta, abs=1e-4) and 0.5 < beta < 1.1


def test_auc_of_one_class_and_ties(spark):
    df = spark.createDataFrame([("a", 0.5, 1), ("a", 0.6, 1), ("b", 0.5, 0), ("b", 0.5, 1), ("b", 0.2, 0), ("b", 0.9, 1), ("b", None, 1)], "g string, p double, y int")
    got = {r.g: (r.auc, r.ks) for r in E.discrimination(df, "g").collect()}
    assert got["a"] == (0.5, None) and got["b"] == (0.875, 0.5)


def test_isotonic_is_monotone_and_isolation_finds_the_far_one(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(round(rng.random(), 2), int(rng.random() < 0.5)) for _ in range(500)], "p double, y int")
    fitted = [r.calibrated for r in M.isotonic(df).orderBy("p_from").collect()]
    assert fitted == sorted(fitted)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(300)] + [(999, 40.0, -40.0), (1000, None, None)]
    scores = {r.k: r.anomaly for r in M.isolation_scores(spark.createDataFrame(rows, "k int, a double, b double"), "k", ["a", "b"]).collect()}
    assert max(scores, key=scores.get) == 999 and len(scores) == 302


def test_regimes_of_two_levels(spark):
    rng = random.Random(6)
    rows = [("m", dt.date(2025, 1, 1) + dt.timedelta(days=i), (0.0 if i < 40 else 10.0) + rng.gauss(0, 0.5)) for i in range(80)] + [("n", dt.date(2025, 1, 1), 1.0)]
    got = {(r.m, r.day): r.regime for r in M.hidden_regimes(spark.createDataFrame(rows, "m string, day date, v double"), "m", "v", states=2).collect()}
    assert [got["m", r[1]] for r in rows[:80]] == [0] * 40 + [1] * 40 and got["n", dt.date(2025, 1, 1)] == 0
