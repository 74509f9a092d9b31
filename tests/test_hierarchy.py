"""Forests with circles against a walk, for every way of merging."""

import random

import numpy as np
import pytest

from ledgerloom.operators.hierarchy import compress, descendants, full_paths, roots_and_depths

SCHEMA = "id long, funded_by_id long, created_at timestamp_ntz, root long, steps string"


def forest(n, seed, deep=False):
    rng = random.Random(seed)
    ids = rng.sample(range(10 * n), n)
    up = {}
    for i, x in enumerate(ids):
        r = rng.random()
        if r < 0.1:
            up[x] = None
        elif r < 0.15:
            up[x] = 10 * n + rng.randrange(100)  # never delivered
        elif r < 0.2:
            up[x] = rng.choice(ids)  # may close a circle
        elif i:
            up[x] = ids[i - 1] if deep else ids[rng.randrange(i)]
        else:
            up[x] = x
    return up


def walked(up):
    out = {}
    for x, p in up.items():
        if p is None or p not in up:
            continue
        trail, cur = [x], p
        while cur not in trail and up.get(cur) is not None and up[cur] in up:
            trail.append(cur)
            cur = up[cur]
        out[x] = (min(trail[trail.index(cur):]), -1) if cur in trail else (cur, len(trail))
    return out


def rows_of(up):
    import datetime as dt

    old, new = dt.datetime(2024, 1, 1), dt.datetime(2025, 1, 1)
    rows = [(x, p, new, 1, "s") for x, p in up.items()]
    some = list(up)[:: max(1, len(up) // 20)]
    return rows + [(x, some[0], old, 1, "s") for x in some] + [(x, up[x], new, 1, "s") for x in some] + [(None, some[0], new, 1, None), (some[-1], None, None, None, None)]


@pytest.mark.parametrize("merge_links,parts,deep", [(10**6, 1, False), (10**6, 7, True), (40, 7, False), (15, 5, True), (0, 3, True)])
def test_roots_depths_and_circles(spark, merge_links, parts, deep):
    up = forest(400, merge_links + parts, deep)
    df = spark.createDataFrame(rows_of(up), SCHEMA).repartition(parts)
    got = {r.id: (r.root_id, r.tree_depth) for r in roots_and_depths(df, "id", "funded_by_id", "created_at", max(merge_links, 1)).collect()}
    assert got == walked(up)


def test_paths_and_descendants(spark):
    up = forest(200, 3, True)
    paths = full_paths(spark.createDataFrame(rows_of(up), SCHEMA).repartition(6), "id", "funded_by_id", "created_at", 30)
    expected = walked(up)
    rows = {r.id: r for r in paths.collect()}
    assert {i: (r.root_id, r.tree_depth) for i, r in rows.items()} == expected
    below = set()
    for i, r in rows.items():
        if r.tree_depth < 0:
            assert r.path is None
            continue
        assert r.path[0] == r.root_id and r.path[-1] == i and len(r.path) == r.tree_depth + 1
        assert all(up[b] == a for a, b in zip(r.path, r.path[1:], strict=False))
        below |= {(a, i, r.tree_depth - k) for k, a in enumerate(r.path[:-1])}
    assert {(r.ancestor_id, r.id, r.distance) for r in descendants(paths).collect()} == below


def test_circle_of_one_and_empty(spark):
    df = spark.createDataFrame([(5, 5, None, 1, ""), (6, 5, None, 1, ""), (7, None, None, 1, "")], SCHEMA)
    assert sorted(map(tuple, roots_and_depths(df, "id", "funded_by_id", "created_at").collect())) == [(5, 5, -1), (6, 5, -1)]
    assert roots_and_depths(df.limit(0), "id", "funded_by_id", "created_at").count() == 0
    assert full_paths(df.limit(0), "id", "funded_by_id", "created_at").count() == 0


def test_compression_of_a_long_chain():
    n = 5000
    node = np.arange(n, dtype=np.int64)
    out = compress(node, node + 1, np.ones(n, np.int64), node, np.zeros(n, bool))
    assert (out[1] == n).all() and (out[2] == n - np.arange(n)).all() and not out[4].any()
