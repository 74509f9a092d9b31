"""Iterated and sampled operators do the whole of their job."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import graph as G
from ledgerloom.operators import models as M
from ledgerloom.operators.arrays import Contexts, fitted


@pytest.mark.parametrize("growth", [4.0, 0.0])
def test_pagerank_settles_along_a_long_chain(spark, growth):
    links = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(40)] + [("hub", "n00"), ("n10", "hub"), ("hub", "n05")]
    names = sorted({x for e in links for x in e})
    n, at = len(names), {x: i for i, x in enumerate(names)}
    a = np.zeros((n, n))
    for s, d in links:
        a[at[d], at[s]] = 1
    a = np.where(a.sum(axis=0) > 0, a / np.maximum(a.sum(axis=0), 1), 1 / n)
    want = np.linalg.solve(np.eye(n) - 0.85 * a, np.full(n, 0.15 / n))
    got = {r["node"]: r["rank"] for r in G.pagerank(spark.createDataFrame(links, "src string, dst string"), growth=growth).collect()}
    assert set(got) == set(names) and all(abs(got[x] - want[at[x]]) < 1e-8 for x in names)


def test_eigenvector_settles_or_raises(spark):
    # A long path: its two largest eigenvalues lie close together.
    path = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(11)], "u string, v string")
    a = np.diag(np.ones(11), 1) + np.diag(np.ones(11), -1)
    want = np.abs(np.linalg.eigh(a)[1][:, -1])
    got = [r["centrality"] for r in M.eigenvector(path).orderBy("node").collect()]
    assert np.allclose(got, want, atol=2e-6)
    with pytest.raises(RuntimeError):
        M.eigenvector(path, rounds=10)


def test_walks_have_the_reference_size(spark):
    walks = G.random_walks(spark.createDataFrame([("a", "b"), ("b", "c")], "u string, v string"))
    assert [tuple(r) for r in walks.groupBy(F.col("nodes")[0], F.size("nodes")).count().orderBy("nodes[0]").collect()] == [(x, 30, 200) for x in "abc"]
    assert {len(r["vector"]) for r in G.node_vectors(walks).collect()} == {64}


def test_permutation_test_can_reach_small_p(spark):
    rows = spark.createDataFrame([("high" if i < 20 else "low", i, float(i < 20) * 100 + i % 7) for i in range(80)], "k string, i long, v double")
    got = {r["k"]: r for r in M.permutation_test(rows, "k", "i", F.col("v")).collect()}
    assert got["high"]["p"] == round(1 / 1001, 6) and got["low"]["p"] == 1.0 and got["high"]["z"] > 5
    assert abs(got["high"]["expected"] - 28) < 2


def test_betweenness_searches_from_all_nodes(spark):
    # A path of 601 nodes, more than any sample: a node i has i before it and 600 - i behind it.
    path = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(600)], "u string, v string")
    got = [r["betweenness"] for r in G.betweenness(path).orderBy("node").collect()]
    assert got == [round(2 * i * (600 - i) / (600 * 599), 8) for i in range(601)]


def test_betweenness_of_rings_and_trees_is_the_same_joined(spark):
    # Two rings that share a node, trees on both, a pair apart.
    ring = [(f"a{i}", f"a{(i + 1) % 7}") for i in range(7)] + [("a0", "b1"), ("b1", "b2"), ("b2", "b3"), ("b3", "a0")]
    pairs = spark.createDataFrame(ring + [("a3", "t1"), ("t1", "t2"), ("t1", "t3"), ("b2", "t4"), ("x", "y")], "u string, v string")
    for got in (G.betweenness(pairs), G._joined_betweenness(G.undirected(pairs, "u", "v"), 99)):
        got = {r["node"]: r["betweenness"] for r in got.collect()}
        assert len(got) == 16 and abs(got["t1"] - 2 * (1 + 2 * 11) / (15 * 14)) < 1e-8 and got["x"] == got["t2"] == 0.0 and abs(got["a0"] - 0.37619048) < 1e-8
    assert {r["node"]: r["betweenness"] for r in G.betweenness(pairs, 99).collect()} == got


def test_shared_items_list_neither_pairs_of_items_of_busy_keys_nor_pairs_of_all_keys(spark):
    # Two keys of 3000 items each make nine million pairs of items; 2000 keys of one item four million pairs of keys.
    items = [(k, i) for k in ("x", "y") for i in range(3000)] + [("z", i) for i in range(5000, 8000)]
    rows = items + [(f"s{n:04d}", -1) for n in range(2000)] + [(f"s{n:04d}", -2 - n) for n in range(2000)] + [("t", -2), ("s0000", -3)]
    held = spark.createDataFrame(rows, "k string, i int")
    got = {r.k: r.group for r in G.shared_item_groups(held, "k", "i").collect()}
    assert got["x"] == got["y"] == "x" and "z" not in got and "t" not in got
    assert got["s0000"] == got["s0001"] == "s0000" and set(got) == {"x", "y", "s0000", "s0001"}


@pytest.mark.parametrize("dear", [0.0, 1e9])
def test_shared_items_are_the_same_either_way(spark, dear):
    rng = np.random.default_rng(5)
    for keys, items in ((40, 90), (80, 12)):
        rows = sorted({(f"k{a}", int(b)) for a, b in zip(rng.integers(0, keys, 150) ** 2 // keys, rng.integers(0, items, 150), strict=True)})
        own = {k: {i for x, i in rows if x == k} for k, _ in rows}
        group = {k: k for k in own}
        for _ in own:
            for a in own:
                for b in own:
                    if a != b and len(own[a] & own[b]) > 1:
                        group[a] = group[b] = min(group[a], group[b])
        linked = {k for k in own if any(k != b and len(own[k] & own[b]) > 1 for b in own)}
        got = {r.k: r.group for r in G.shared_item_groups(spark.createDataFrame(rows, "k string, i int"), "k", "i", dear=dear).collect()}
        assert got == {k: group[k] for k in linked} and len(got) > 1


def test_eigenvector_of_many_rounds_takes_one_job(spark):
    # Two rings of equal degree, one with a chord: the rounds are many, the jobs a handful.
    ring = [(f"a{i:02d}", f"a{(i + 1) % 40:02d}") for i in range(40)] + [(f"b{i:02d}", f"b{(i + 1) % 40:02d}") for i in range(40)] + [("b00", "b20")]
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup
    spark.sparkContext.setJobGroup("eigenvector", "")
    got = {r["node"]: r["centrality"] for r in M.eigenvector(spark.createDataFrame(ring, "u string, v string")).collect()}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(got) == 80 and got["a00"] == 0.0 and got["b00"] == got["b20"] == max(got.values()) and len(jobs("eigenvector")) < 12


def test_values_are_dealt_in_tasks_as_by_ranks(spark):
    # Names of several lengths, beyond one block of MD5, and no row for each (row, replicate).
    rows = spark.createDataFrame([("abc"[n % 3], ("x" * (n % 60)) + str(n), float(n * n % 97)) for n in range(200)], "k string, i string, v double")
    same = [sorted(map(tuple, M.permutation_test(rows, "k", "i", F.col("v"), 20, most).collect())) for most in (200, 199)]
    assert same[0] == same[1] and len(same[0]) == 3
    assert M.permutation_test(rows.limit(0), "k", "i", F.col("v"), 20).count() == 0
    plan = M.permutation_test(rows, "k", "i", F.col("v"))._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "explode" not in plan


def test_walks_of_whole_graphs_are_those_joined_and_nothing_is_stored(spark):
    names = [f"n{'x' * (5 * i)}é{i}" for i in range(12)]
    pairs = spark.createDataFrame([(names[i], names[j]) for i in range(12) for j in range(i) if (i * j) % 3 == 1 or j == 0], "u string, v string")
    got = G.random_walks(pairs, 12, 30)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, G._joined_walks(G.undirected(pairs, "u", "v"), 12, 30, 42).collect())) and got.count() == 144
    plan = got._jdf.queryExecution().toString()
    assert "Join" not in plan and "parquet" not in plan
    assert G.random_walks(pairs.limit(0)).count() == 0


def test_node_vectors_are_learned_in_parts_and_tell_groups_apart(spark, monkeypatch):
    from pyspark.ml.feature import Word2Vec

    parts, fit = [], Word2Vec.fit
    monkeypatch.setattr(Word2Vec, "fit", lambda self, *a: (parts.append(self.getNumPartitions()), fit(self, *a))[1])
    clique = lambda k: [(f"{k}{i}", f"{k}{j}") for i in range(5) for j in range(i)]
    walks = G.random_walks(spark.createDataFrame(clique("a") + clique("b"), "u string, v string"))
    found = {r["node"]: np.array(r["vector"]) / np.linalg.norm(r["vector"]) for r in G.node_vectors(walks).collect()}
    assert parts == [spark.sparkContext.defaultParallelism] and parts[0] > 1 and len(found) == 10
    mean = lambda same: np.mean([found[x] @ found[y] for x in found for y in found if x < y and (x[0] == y[0]) == same])
    assert mean(True) > mean(False) + 0.3


def test_vectors_are_learned_from_counts_of_all_walks(spark, monkeypatch):
    from pyspark.ml.feature import Word2Vec

    clique = lambda k: [(f"{k}{i}", f"{k}{j}") for i in range(6) for j in range(i)]
    pairs = spark.createDataFrame(clique("a") + clique("bé") + [("c1", "c2")], "u string, v string")
    joined = G.learned_vectors(pairs, walks=2, length=4, most=0)
    monkeypatch.setattr(Word2Vec, "fit", None)  # a step for each of a billion pairs of words
    got = G.learned_vectors(pairs)
    assert got.dtypes == joined.dtypes and {r["node"] for r in joined.collect()} == {r["node"] for r in got.collect()}
    rows = got.collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, G.learned_vectors(pairs).collect()))
    found = {r["node"]: np.array(r["vector"]) / np.linalg.norm(r["vector"]) for r in rows}
    assert len(rows) == len(found) == 14 and {len(x) for x in found.values()} == {64}
    mean = lambda same: np.mean([found[x] @ found[y] for x in found for y in found if x < y and (x[0] == y[0]) == same])
    assert mean(True) > mean(False) + 0.3
    assert G.learned_vectors(pairs.limit(0)).count() == 0


@pytest.mark.parametrize("most", [1, 10**6])
def test_contexts_count_every_pair_within_the_window(most):
    rng = np.random.default_rng(2)
    paths = [rng.integers(0, 9, (4, 7)), rng.integers(0, 500, (2, 7)), np.full((1, 7), 3)]
    want = np.zeros((500, 500))
    for walk in (w for p in paths for w in p):
        for i in range(7):
            for j in range(7):
                if 0 < abs(i - j) <= 3:
                    want[walk[i], walk[j]] += (4 - abs(i - j)) / 3
    counted, got = Contexts(500, 7, 3, most), np.zeros((500, 500))
    for p in paths:
        counted.add(p)
    a, b, c = counted.take()
    assert len(set(zip(a, b, strict=True))) == len(a) and (np.diff(a) >= 0).all() and not len(counted.take()[0])
    got[a, b] = c
    assert np.allclose(got, want)


def test_descent_lowers_the_loss_of_every_row():
    rng = np.random.default_rng(3)
    seen, drawn, counts, weight = rng.standard_normal((40, 8)), rng.standard_normal((30, 8)), rng.integers(0, 50, (12, 40)), rng.random(12)
    loss = lambda x: (counts * np.logaddexp(0, -x @ seen.T)).sum(axis=1) + weight * np.logaddexp(0, x @ drawn.T).sum(axis=1)
    for scale in (0.01, 1, 30):
        x = rng.standard_normal((12, 8)) * scale
        for _ in range(6):
            x, was = fitted(x, seen, counts, drawn, weight, 1), x
            assert (loss(x) <= loss(was) + 1e-9).all()
        assert (loss(fitted(x, seen, counts, drawn, weight, 500)) <= loss(x)).all()
