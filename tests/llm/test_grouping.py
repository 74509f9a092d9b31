"""Groups against union-find."""

import datetime as dt
import random

import pytest

from ledgerloom.llm.grouping import coordinated_pairs, group_pairs


def united(pairs):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {x: root(x) for x in up}


def grouped(spark, pairs, kind="string"):
    return {r.member: r.group_id for r in group_pairs(spark.createDataFrame(pairs, f"u {kind}, v {kind}, member int")).collect()}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "cliques"])
def test_shapes(spark, shape):
    rng = random.Random(3)
    name = [f"n{i:03d}" for i in rng.sample(range(400), 400)]
    pairs = {
        "chain": [(name[i], name[i + 1]) for i in range(60)], "star": [(name[0], name[i]) for i in range(1, 100)],
        "random": [(rng.choice(name), rng.choice(name)) for _ in range(260)], "cliques": [(name[10 * g + i], name[10 * g + j]) for g in range(6) for i in range(8) for j in range(i)],
    }[shape]
    want = united([p for p in pairs if p[0] != p[1]])
    got = grouped(spark, [(a, b, 1) for a, b in pairs] + [(b, a, 2) for a, b in pairs[:5]])
    assert set(got) == set(want)
    groups = {}
    for x, r in want.items():
        groups.setdefault(r, []).append(x)
    assert got == {x: min(groups[r]) for x, r in want.items()}


def test_numbers_nulls_loops_and_empty(spark):
    assert grouped(spark, [(10, 9, 1), (9, 2, 1), (7, 7, 1), (None, 3, 1), (4, None, 1)], "long") == {10: 2, 9: 2, 2: 2}
    assert grouped(spark, []) == {}


def test_newest_verdict_of_an_unordered_pair(spark):
    t = [dt.datetime(2025, 1, d) for d in (1, 2, 3)]
    rows = [
        (1, "a", "b", True, t[0], "x"), (2, "b", "a", False, t[1], "x"), (3, "c", "d", False, t[0], "x"), (4, "d", "c", True, t[2], "x"), (4, "d", "c", True, t[2], "x"),
        (5, "e", "f", True, t[0], "x"), (6, "e", "f", None, t[1], "x"), (7, "g", "g", True, t[1], "x"), (8, None, "h", True, t[1], "x"), (9, "i", "j", True, None, "x"), (10, "k", "l", True, t[0], "x"), (11, "l", "k", False, t[0], "x"),
    ]
    df = spark.createDataFrame(rows, "id long, a string, b string, yes boolean, at timestamp_ntz, u string")
    assert sorted(map(tuple, coordinated_pairs(df, "a", "b", "yes", "at", "id").collect())) == [("c", "d"), ("i", "j")]
