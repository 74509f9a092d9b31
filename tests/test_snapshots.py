"""Differences of deliveries against a plain dictionary version."""

import datetime as dt
import random

from ledgerloom.operators.snapshots import diff_snapshots, holding_changes, number_deliveries

T0 = dt.datetime(2025, 1, 1, 22, 30)
SCHEMA = "id long, wallet_address string, token_mint string, raw_amount long, decimals int, ui_amount double, fetched_at timestamp_ntz"


def hours(h):
    return T0 + dt.timedelta(hours=h)


def changes(spark, rows):
    out = holding_changes(spark.createDataFrame(rows, SCHEMA))
    return sorted((r.snapshot_no, r.wallet_address, r.token_mint, r.change_kind) for r in out.collect())


def test_kinds_tolerance_restated_amounts_and_blanks(spark):
    nan = float("nan")
    rows = [
        (1, "a", "m", 100, 2, 1.0, hours(0)), (2, "b", "m", 5, 0, 5.0, hours(1)), (3, "c", "m", 7, 0, 7.0, hours(2)), (4, "z", "m", 0, 0, 0.0, hours(2)),
        (5, " a\t", "m", 100, 2, None, hours(30)), (6, "b", "m", 5, 0, 5.0 * (1 + 5e-10), hours(31)), (7, "c ", "m", 8, 0, nan, hours(31)), (8, "d", "m", 1, 0, 1.0, hours(32)),
        (9, "z", "m", 0, 0, 0.0, hours(32)),
    ]
    assert changes(spark, rows) == [(2, "c", "m", "changed"), (2, "d", "m", "added")]
    assert changes(spark, [*rows, (10, "d", "m", 0, 0, 0.0, hours(60))]) == [
        (2, "c", "m", "changed"), (2, "d", "m", "added"), (3, "a", "m", "removed"), (3, "b", "m", "removed"), (3, "c", "m", "removed"), (3, "d", "m", "changed"), (3, "z", "m", "removed")]


def test_last_fetched_row_of_a_delivery_counts_and_repeats_fold(spark):
    rows = [(1, "a", "m", 1, 0, 1.0, hours(0)), (2, "a", "m", 2, 0, 2.0, hours(1)), (2, "a", "m", 2, 0, 2.0, hours(1)), (3, "a", "m", 2, 0, 2.0, hours(20)), (4, "a", "m", 9, 0, 9.0, hours(19))]
    assert changes(spark, rows) == []


def test_gap_of_exactly_twelve_hours_opens_a_delivery(spark):
    df = spark.createDataFrame([(1, hours(0)), (2, hours(11.99)), (3, hours(23.99)), (4, None)], "id long, at timestamp_ntz")
    assert sorted((r.id, r.snapshot_no, r.is_last) for r in number_deliveries(df, "at").collect()) == [(1, 1, False), (2, 1, False), (3, 2, True)]


def test_nulls_anywhere_empty_tables_and_clashing_columns(spark):
    assert changes(spark, []) == []
    assert changes(spark, [(1, "a", "m", 1, 0, 1.0, hours(0))]) == []
    rows = [(None, None, None, None, None, None, hours(0)), (None, None, None, None, None, 3.0, hours(40)), (1, "a", None, None, None, None, None)]
    assert changes(spark, rows) == [(2, None, None, "changed")]
    df = spark.createDataFrame([("k", 1.0, "x", hours(0), 1), ("k", 1.0, "y", hours(40), 2)], "pair string, number double, other string, at timestamp_ntz, sign int")
    out = diff_snapshots(df, ["pair"], ["number", "other"], "at").collect()
    assert [(r.snapshot_no, r.pair, r.change_kind, r.changed_fields) for r in out] == [(2, "k", "changed", ["other"])]


def test_random_deliveries_match_a_plain_version(spark):
    rng, rows, state = random.Random(4), [], {}
    expected = set()
    for no in range(1, 6):
        before, state = state, {}
        for w in "abcdefgh":
            if rng.random() < 0.7:
                state[w] = rng.choice([0.0, 1.0, 2.5, before.get(w, 1.0)])
                rows.append((len(rows), w, "m", 0, 0, state[w], hours(50 * no + rng.random() * 5)))
        if no > 1:
            expected |= {(no, w, "m", "added") for w in state.keys() - before.keys()} | {(no, w, "m", "removed") for w in before.keys() - state.keys()}
            expected |= {(no, w, "m", "changed") for w in state.keys() & before.keys() if state[w] != before[w]}
    rng.shuffle(rows)
    assert set(changes(spark, rows)) == expected
