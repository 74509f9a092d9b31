"""Trailing totals against loops over the calendar."""

import datetime as dt
import random

from ledgerloom.operators.rolling import counted_transactions, peak_days, trailing_totals

DAY = dt.date(2025, 1, 1)
SCHEMA = "w string, t timestamp_ntz, a double, total double, day string"


def run(spark, rows):
    df = spark.createDataFrame([(w, None if d is None else dt.datetime(2025, 1, 1, 13) + dt.timedelta(days=d), a, 1.0, "x") for w, d, a in rows], SCHEMA)
    return trailing_totals(df, "w", "t", "a", (7, 30))


def plain(rows):
    out = {}
    for w in {r[0] for r in rows}:
        days = {}
        for _, d, a in (r for r in rows if r[0] == w and r[1] is not None and r[2] is not None and r[2] == r[2]):
            days[d] = days.get(d, 0) + a
        if days:
            for d in range(min(days), max(days) + 1):
                out[w, d] = tuple(round(sum(days.get(x, 0) for x in range(d - n + 1, d + 1)), 2) for n in (7, 30))
    return out


def test_totals_averages_and_peaks(spark):
    rng = random.Random(2)
    rows = [(w, rng.choice([0, 1, 3, 5, 40, 41, 90, 91, 200]) + rng.randrange(3), round(rng.uniform(-50, 50), 2)) for w in "abc" for _ in range(30)]
    rows += [("a", None, 5.0), ("a", 3, None), ("b", 4, float("nan")), ("d", 7, 1.25), (None, 3, 2.0), (None, 5, 2.0)] + rows[:5]
    expected, totals = plain(rows), run(spark, rows)
    got = {(r.w, (r.day - DAY).days): (r.total_7, r.total_30) for r in totals.collect()}
    assert got == expected
    assert all(abs(r.avg_7 - r.total_7 / 7) < 1e-6 and abs(r.avg_30 - r.total_30 / 30) < 1e-6 for r in totals.collect())
    peaks = {(r.w, r.trailing_days): r.peak_day for r in peak_days(totals, "w").collect()}
    for w in {k[0] for k in expected}:
        for i, n in enumerate((7, 30)):
            best = min((-v[i], d) for (x, d), v in expected.items() if x == w)[1]
            assert peaks[w, n] == str(DAY + dt.timedelta(days=best))


def test_empty_and_minus_zero(spark):
    assert run(spark, []).count() == 0
    rows = run(spark, [("a", 0, 0.001), ("a", 1, -0.002)]).collect()
    assert {str(r.total_7) for r in rows} == {"0.0"}


def test_newest_version_of_a_signature_counts(spark):
    t = dt.datetime(2025, 1, 1)
    later = t + dt.timedelta(days=1)
    df = spark.createDataFrame(
        [("s", t, "w", 1.0, t, "k"), ("s", t, "w", 2.0, later, "k"), ("s", t, "w", 2.0, later, "k"), ("u", t, "w", 3.0, None, "k"), (None, t, "w", 9.0, t, "k")],
        "signature string, block_time timestamp_ntz, wallet_address string, amount_change double, cached_at timestamp_ntz, key string")
    assert sorted((r.signature, r.amount_change) for r in counted_transactions(df).collect()) == [("s", 2.0), ("u", 3.0)]
