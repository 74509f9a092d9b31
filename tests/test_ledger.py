"""Lots, rolling ranges, histories, calibration curves, paths and scratch folders on cases worked out by hand or by brute force."""

import datetime as dt
import random
from types import SimpleNamespace

import pytest

from ledgerloom.operators import evaluation as E
from ledgerloom.operators import graph as G
from ledgerloom.operators import lots as L
from ledgerloom.operators import models as M
from ledgerloom.operators import relational as R
from ledgerloom.operators import sequences as Q
from ledgerloom.operators import series as S
from ledgerloom.operators.ranking import mean_ranks, quantiles
from ledgerloom.scratch import Scratch, shared_folder

DAY = dt.date(2025, 1, 1)


def day(i):
    return DAY + dt.timedelta(days=i)


LOTS = "k string, day date, a double, p double, sold double, peak double, depth double"


def lot_rows():
    rows = [("x", 0, 10, 1.0), ("x", 1, 5, 2.0), ("x", 2, -7, 4.0), ("x", 3, -20, 3.0), ("x", 4, 4, 5.0), ("y", 0, -3, 1.0), ("y", 1, 6, 2.0), (None, 0, 2, 2.0), (None, 1, -1, 3.0), ("z", 0, None, 1.0)]
    return [(k, day(d), None if a is None else float(a), p, 0.0, 4.0, 100.0) for k, d, a, p in rows]


@pytest.mark.parametrize("method,want", [
    ("lifo", [("x", 1, 2, 5.0), ("x", 0, 2, 2.0), ("x", 0, 3, 8.0)]), ("fifo", [("x", 0, 2, 7.0), ("x", 0, 3, 3.0), ("x", 1, 3, 5.0)])])
def test_matched_lots(spark, method, want):
    got = L.matched_lots(spark.createDataFrame(lot_rows(), LOTS), ["k"], "day", "a", "p", method).collect()
    assert sorted((r.k, (r.buy_day - DAY).days, (r.sell_day - DAY).days, r.matched) for r in got if r.k) == sorted(want)
    assert L.matched_lots(spark.createDataFrame([], LOTS), ["k"], "day", "a", "p").count() == 0
    with pytest.raises(ValueError):
        L.matched_lots(spark.createDataFrame([], LOTS), ["k"], "day", "a", "p", "best")


def test_realised_and_unrealised(spark):
    d = spark.createDataFrame(lot_rows(), LOTS).where("k is not null")
    m = L.matched_lots(d, ["k"], "day", "a", "p")
    r = {(x.day - DAY).days: x for x in L.realised(m, d, ["k"], "day", "peak", "depth").collect()}
    # Day 2: 5 bought at 2 and 2 at 1, sold at 4: 28 - 12; a tenth of 28 % of the liquidity is lost.
    assert (r[2].sold, r[2].pnl, r[2].efficiency, r[2].drawdown, r[2].adjusted_pnl) == (7.0, 16.0, 1.0, 0.0, 15.55)
    assert (r[3].sold, r[3].pnl, r[3].efficiency) == (8.0, 16.0, 0.75)
    u = {x.k: x for x in L.unrealised(d, m, ["k"], "day", "a", "p").collect()}
    assert set(u) == {"x", "y"} and (u["x"].position, u["x"].basis, u["x"].value, u["x"].pnl) == (4.0, 20.0, 20.0, 0.0)


def test_rolling_ranges_across_buckets(spark):
    rng = random.Random(1)
    base = dt.datetime(2025, 1, 1)
    rows = [(rng.choice("ab"), base + dt.timedelta(seconds=rng.randrange(20_000)), float(rng.randrange(9)), i) for i in range(300)] + [("a", None, 1.0, 300), (None, base, 2.0, 301)]
    got = {r.i: r.m for r in S.rolling_ranges(spark.createDataFrame(rows, "k string, t timestamp_ntz, v double, i int"), ["k"], "t", "v", {"m": 3600}).collect()}
    for k, t, _, i in rows:
        if t is None:
            assert i not in got
            continue
        near = [v for k2, t2, v, _ in rows if k2 == k and t2 is not None and t - dt.timedelta(seconds=3600) <= t2 <= t]
        assert got[i] == pytest.approx(sum(near) / len(near))


def test_history_over_days_and_nulls(spark):
    base = dt.datetime(2025, 1, 1)
    rows = [("u", base + dt.timedelta(hours=10 * i), i, "abcdefgh"[i] if i != 3 else None) for i in range(8)] + [("v", base, 0, "z"), (None, base, 1, "y"), ("u", None, 99, "q")]
    out = {(r.k, r.i): (r.a1, r.a2, r.a3) for r in Q.with_history(spark.createDataFrame(rows, "k string, t timestamp_ntz, i int, x string"), "k", "t", "i", "x", 4).collect()}
    seq = [r[3] for r in rows[:8]]
    assert len(out) == 10
    for i in range(8):
        assert out["u", i] == tuple(seq[i - b] if i >= b else None for b in (1, 2, 3))
    assert out["v", 0] == out[None, 1] == (None, None, None)


def test_isotonic_curve_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(round(rng.random(), 3), int(rng.random() < 0.5), "x") for _ in range(300)] + [(None, 1, "x"), (0.4, None, "x"), (1.5, 1, "x")]
    points = sorted({p for p, y, _ in rows if p is not None and y is not None and p <= 1})
    n, k = ([sum(f(y) for q, y, _ in rows if q == p and y is not None) for p in points] for f in (lambda y: 1, lambda y: y))
    best = [max(min(sum(k[s : e + 1]) / sum(n[s : e + 1]) for e in range(i, len(points))) for s in range(i + 1)) for i in range(len(points))]
    steps = M.isotonic(spark.createDataFrame(rows, "p double, y int, n string")).orderBy("p_from").collect()
    for p, v in zip(points, best, strict=True):
        assert next(s.calibrated for s in steps if s.p_from <= p <= s.p_to) == pytest.approx(v, abs=1e-6)
    assert sum(s.n for s in steps) == sum(n) and M.isotonic(spark.createDataFrame([], "p double, y int")).count() == 0


def test_betweenness_of_small_graphs(spark):
    between = lambda pairs, **kw: {r.node: r.betweenness for r in G.betweenness(spark.createDataFrame(pairs, "u string, v string"), **kw).collect()}
    assert between([("a", "b"), ("b", "c"), ("b", "d"), ("b", "a"), ("c", None), ("c", "c")]) == {"a": 0.0, "b": 1.0, "c": 0.0, "d": 0.0}
    square = between([("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("x", "y")])
    assert square["a"] == pytest.approx(2 * 0.5 / 20) and square["x"] == 0.0
    assert between([]) == {}


def test_quantiles_ranks_and_rank_correlation(spark):
    df = spark.createDataFrame([(float(v), -float(v)) for v in (5, 1, 1, 4, 9)] + [(None, 1.0)], "a double, b double")
    assert quantiles(df, "a", [0.0, 0.25, 0.5, 0.9, 1.0]).first().q == pytest.approx([1.0, 1.0, 4.0, 7.4, 9.0])
    assert quantiles(df.where("a > 99"), "a", [0.5]).count() == 0
    assert {r.a: r.r for r in mean_ranks(df, [], "a", "r").collect()} == {1.0: 1.5, 4.0: 3.0, 5.0: 4.0, 9.0: 5.0}
    assert E.rank_correlation(df, "a", "b").first().rho == -1.0


def test_survival_and_distances(spark):
    rows = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, 1), (None, 1)], "duration int, event int")
    assert [(r.duration, r.at_risk, r.events, r.survival) for r in E.survival_curve(rows).orderBy("duration").collect()] == [(1, 4, 1, 0.75), (3, 2, 2, 0.0)]
    ks = spark.createDataFrame([("m", 0.1, False), ("m", 0.2, False), ("m", 0.8, True), ("m", 0.15, True), ("o", 0.5, True), ("m", None, True)], "g string, v double, late boolean")
    from pyspark.sql import functions as F

    assert {r.g: r.ks for r in E.ks_distance(ks, "g", "v", F.col("late")).collect()} == {"m": 0.5, "o": None}


def test_versions_conditions_and_health(spark):
    v = spark.createDataFrame([(1, dt.datetime(2025, 1, 1), "a"), (1, dt.datetime(2025, 3, 1), "b"), (2, dt.datetime(2025, 3, 1), "c"), (3, None, "d")], "id int, t timestamp_ntz, x string")
    assert [tuple(r) for r in R.as_of(v, ["id"], "t", "2025-02-01", ["x"]).collect()] == [(1, "a")]
    n = spark.createDataFrame([(1.0, None), (float("nan"), 0.0), (3.0, 0.0)], "a double, b double")
    assert n.where(R.meets({"a": (">=", 1.0), "b": ("==", 0.0)})).count() == 2  # NaN is the greatest number
    h = {r.column: (r.rows, r.nulls, r.zeros, r.distinct_values, r.constant) for r in R.column_health(n, ["a", "b"]).collect()}
    assert h == {"a": (3, 1, 0, 2, False), "b": (3, 1, 2, 1, True)}
    assert R.without(v, "x", spark.createDataFrame([("a",), (None,)], "x string")).count() == 3


def test_scratch(spark):
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="a"))
    with pytest.raises(ValueError):
        shared_folder(cluster)
    with Scratch(spark, "test") as s:
        kept = s.save(spark.range(3))
        assert kept.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(s.root + "/0").count()


def test_concordance_against_all_pairs(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(30), rng.randrange(2), float(rng.randrange(13)), "x") for _ in range(120)] + [(None, 1, 1.0, "x"), (1, None, 1.0, "x"), (1, 1, None, "x")]
    whole = [r for r in rows if None not in r[:3]]
    pairs = [(a[2], b[2]) for a in whole for b in whole if a[1] == 1 and b[0] > a[0]]
    r = E.concordance(spark.createDataFrame(rows, "t int, e int, s double, n string"), "t", "e", "s").first()
    assert (r.concordant, r.discordant, r.tied) == (sum(a > b for a, b in pairs), sum(a < b for a, b in pairs), sum(a == b for a, b in pairs))
    one = E.concordance(spark.createDataFrame(rows[:1], "t int, e int, s double, n string"), "t", "e", "s").first()
    assert (one.concordant, one.c_index) == (0, None)
    assert E.concordance(spark.createDataFrame([], "t int, e int, s double"), "t", "e", "s").first().c_index is None


def test_projection_split_and_forecast(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 2.0]), (4, None), (5, [1.0])], "k long, v array<float>")
    x = {(r.k, r.axis): r.x for r in M.random_projection(v, "k", "v", 2, 4).collect()}
    assert len(x) == 12 and all(abs(abs(x[1, j]) - 0.5) < 1e-6 and x[3, j] == pytest.approx(x[1, j] + x[2, j], abs=1e-5) for j in range(4))
    from pyspark.sql import functions as F

    b = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 0)], "g string, i int")
    assert {(r.g, r.i): r.part for r in G.split_blocks(b, "g", [F.col("i")], 2).collect()} == {("a", i): i // 2 for i in range(5)} | {("b", 0): 0}
    days = spark.createDataFrame([("a", day(i), 2.0 * i) for i in range(20)] + [("b", day(0), 1.0)], "g string, day date, v double")
    got = {r.g: (r.points, r.slope, r.next_value) for r in M.trend_forecast(days, "g", "v").collect()}
    assert got == {"a": (14, 2.0, 40.0), "b": (1, None, None)}
