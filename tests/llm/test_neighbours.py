"""Nearest neighbours against brute force; exact at factor one, close to it when relaxed."""

import datetime as dt

import numpy as np
import pytest

from ledgerloom.llm.neighbours import VantageTree, nearest_neighbours, neighbour_pairs, search

SCHEMA = "a string, vec array<float>, at timestamp_ntz, rep string, similarity double, part int"
DIMS = 8


def rows_of(vectors, at=dt.datetime(2025, 1, 1)):
    return [(k, None if v is None else [None if x is None else float(x) for x in v], at, "r", 0.5, 1) for k, v in vectors]


def brute(vectors, k=5):
    names = sorted(vectors)
    x = np.array([vectors[n] for n in names], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i, n in enumerate(names):
        near = sorted((-round(float(x[i] @ x[j]), 9) + 0.0, names[j]) for j in range(len(names)) if j != i)[:k]
        out[n] = [b for _, b in near]
    return out


def found(df, **kw):
    out = {}
    for r in nearest_neighbours(df, "a", "vec", dims=DIMS, recency="at", **kw).orderBy("id", "rank").collect():
        out.setdefault(r.id, []).append(r.neighbour)
    return out


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, DIMS))
    return {f"w{i:04d}": centres[i % 6] + rng.normal(size=DIMS) * rng.choice([0.1, 0.6]) for i in range(n)}


@pytest.mark.parametrize("shard_rows,fit_rows", [(10_000, 10_000), (120, 200), (60, 40)])
def test_factor_one_is_exact_over_any_sharding(spark, shard_rows, fit_rows):
    v = clustered(500, 1)
    df = spark.createDataFrame(rows_of(v.items()), SCHEMA)
    assert found(df, relax=1.0, shard_rows=shard_rows, leaf_rows=20, fit_rows=fit_rows) == brute(v)


def test_relaxed_search_keeps_most(spark):
    """The tuned factor on vectors whose distances are all alike, where a fixed one loses a fifth."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 64))
    v = {f"w{i:04d}": centres[i % 6] + rng.normal(size=64) * rng.choice([0.3, 1.0]) for i in range(900)}
    df = spark.createDataFrame(rows_of(v.items()), SCHEMA)
    got, want = {}, brute(v)
    for r in nearest_neighbours(df, "a", "vec", recency="at", shard_rows=200, leaf_rows=32).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    assert sum(len(got.get(k, set()) & set(w)) for k, w in want.items()) >= 0.95 * sum(map(len, want.values()))


def test_copies_ties_unusable_and_repeated_rows(spark):
    v = clustered(60, 3)
    same = {f"copy{i:02d}": v["w0007"] for i in range(30)}
    scaled = {"big": np.array(v["w0009"]) * 4, "small": np.array(v["w0009"]) / 8}
    good = v | same | scaled
    bad = [("none", None), ("short", [1.0] * 7), ("hole", [None] + [1.0] * 7), ("zero", [0.0] * 8), ("nan", [float("nan")] + [1.0] * 7), (None, [1.0] * 8), ("inf", [float("inf")] * 8)]
    old = rows_of([(k, np.ones(DIMS)) for k in list(v)[:10]], dt.datetime(2024, 1, 1))
    newer_but_broken = rows_of([("w0003", [1.0])], dt.datetime(2026, 1, 1))
    df = spark.createDataFrame(rows_of([*good.items(), *bad, *list(v.items())[:5]]) + old + newer_but_broken, SCHEMA)
    assert found(df, relax=1.0, shard_rows=40, leaf_rows=10, fit_rows=50) == brute(good)


def test_few_and_no_rows(spark):
    df = spark.createDataFrame(rows_of([("a", np.ones(8)), ("b", np.arange(8))]), SCHEMA)
    assert found(df) == {"a": ["b"], "b": ["a"]}
    assert found(df.limit(0)) == {} and found(df.where("a = 'a'")) == {}
    assert [tuple(r) for r in neighbour_pairs(nearest_neighbours(df, "a", "vec", dims=DIMS)).collect()] == [("a", "b")]


def test_tree_bounds_never_exceed_distances():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = VantageTree(x, 30)
    low = tree.least(x[:50])
    for j, ids in enumerate(tree.rows):
        true = np.sqrt(np.maximum(0, 2 - 2 * x[:50] @ x[ids].T)).min(axis=1)
        assert (low[:, j] <= true + 1e-3).all()
    a, b, sims = search(x[:50].astype(float), np.full(50, -2.0), np.arange(50), x.astype(float), tree, 3, 1.0, np.arange(400))
    want = np.round(x[:50].astype(float) @ x.T.astype(float), 9)
    want[np.arange(50), np.arange(50)] = -9
    assert (b.reshape(50, 3) == np.argsort(-want, axis=1, kind="stable")[:, :3]).all() and (a == np.repeat(np.arange(50), 3)).all()
    assert (np.diff(sims.reshape(50, 3), axis=1) <= 0).all()


@pytest.mark.parametrize("spread", [1e-3, 1e-5, 0.0])
def test_factor_one_is_exact_in_dense_clusters(spark, spread):
    """Hundreds of vectors closer to each other than float32 can tell; at 0 they are scaled copies of one."""
    rng = np.random.default_rng(8)
    centre = rng.normal(size=DIMS)
    v = clustered(300, 4) | {f"d{i:03d}": (centre + rng.normal(size=DIMS) * spread) * (1 + i / 7) for i in range(400)}
    df = spark.createDataFrame(rows_of(v.items()), SCHEMA)
    assert found(df, relax=1.0, shard_rows=150, leaf_rows=20, fit_rows=200) == brute(v)
