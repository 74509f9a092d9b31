"""Graph operators over edge tables. All are joins and sums, and none gathers a vertex's neighbourhood; those that take many rounds
hand a graph of up to ``WHOLE_EDGES`` pairs whole to their tasks and join beyond."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ledgerloom.functions.numeric import hash31, safe_div, seconds
from ledgerloom.operators.arrays import WHOLE_EDGES, Contexts, Paths, by_depth, by_length, digests, fitted, neighbours, numbered, summed
from ledgerloom.operators.ranking import ranked
from ledgerloom.operators.series import fill
from ledgerloom.scratch import Scratch


def degrees(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node``, ``in_degree``, ``out_degree`` over distinct edges between two named ends."""
    e = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(src, dst).distinct()
    ends = e.select(F.explode(F.array(F.struct(F.col(src).alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col(dst).alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    return ends.groupBy("x.node").agg(F.sum("x.i").alias("in_degree"), F.sum("x.o").alias("out_degree"))


def undirected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct pairs (``u`` < ``v``) without loops and nulls."""
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    return ends.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``component``): the least node reachable over pairs (``u``, ``v``), by alternating stars.

    A large-star step links every node's larger neighbours to the least of its neighbourhood, a
    small-star step its smaller ones; both keep the connectivity and flatten it towards stars, which is
    what remains when no edge changes. The number of rounds grows with the logarithm of the longest path.
    """
    scratch = Scratch(edges.sparkSession, "components")

    def kept(e: DataFrame) -> tuple[DataFrame, tuple]:
        """The edges written, with their number and a fingerprint, both told by the write."""
        told = Observation()
        out = scratch.save(e.observe(told, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")))
        return out, (told.get["n"], told.get["h"])

    def least_of(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))

    state, was = kept(undirected(edges, "u", "v"))
    while was[0]:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = scratch.save(both.join(least_of(both), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct())
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        small = down.join(least_of(down), "u")
        after, now = kept(small.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("x")).select(F.least("x.a", "x.b").alias("u"), F.greatest("x.a", "x.b").alias("v")).where("u != v").distinct())
        scratch.discard(state, large)
        state = after
        if now == was:
            break
        was = now
    # Stars: every node but the centre occurs once as the larger end.
    return state.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(state.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()).groupBy("node").agg(F.min("component").alias("component"))


def converged(scratch: Scratch, state: DataFrame, step: Callable[[DataFrame], DataFrame], tolerance: float, rounds: int, at_once: int = 10, scaled: bool = False) -> DataFrame:
    """(``node``, ``x``) after so many ``step``s, ``at_once`` to a job, that the last job changed ``x`` by less than ``tolerance`` of its sum in all.

    ``scaled``: steps multiply ``x``, and only its direction counts; it is brought back to the sum 1 by each job. A job tells
    its change by the write itself. ``rounds`` steps without that are an error.
    """
    saved, growth = state, 1.0
    for _ in range(0, rounds, at_once):
        new = state
        for _ in range(at_once):
            new = step(new)
        told = Observation()
        both = new.join(state.select("node", (F.col("x") * growth).alias("was")), "node")
        new = scratch.save(both.observe(told, F.sum(F.abs(F.col("x") - F.col("was"))).alias("d"), F.sum("x").alias("s")).select("node", "x"))
        scratch.discard(saved)
        change, total = told.get["d"], told.get["s"]
        saved = state = new
        if not total:
            return state
        if scaled:
            state, growth = new.withColumn("x", F.col("x") / total), total
        if change <= tolerance * total:
            return state
    raise RuntimeError(f"no convergence within {rounds} rounds")


def pagerank(edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-9, rounds: int = 2000, src: str = "src", dst: str = "dst", growth: float = 4.0) -> DataFrame:
    """(``node``, ``rank``), ranks summing to 1; what dangling nodes hold is spread evenly. Iterated until it settles.

    What is spread evenly only scales the ranks, so the rounds leave it out and the sum is set to 1 at the end. The ranks are the sum of the
    base passed on over 0, 1, 2 .. links. While the links of double length stay within ``growth`` times the first ones, as in
    forests, each round composes them and so adds as many terms as all before it; otherwise rounds add as many as the links are long.
    """
    scratch = Scratch(edges.sparkSession, "pagerank")
    e = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct()
    out = e.groupBy("src").agg(F.count("*").alias("out"))
    links = scratch.save(e.join(out, "src").select("src", "dst", (damping / F.col("out")).alias("w")))
    nodes = scratch.save(links.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    n, first = nodes.count(), links.count()
    if not n:
        return nodes.select("node").withColumn("rank", F.lit(0.0))

    def passed(ranks: DataFrame, over: DataFrame) -> DataFrame:
        return over.join(ranks.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), (F.col("w") * F.col("x")).alias("x"))

    ranks, total = scratch.save(nodes.withColumn("x", F.lit(1.0 / n))), 1.0
    while True:
        told = Observation()
        more = scratch.save(ranks.unionByName(passed(ranks, links)).groupBy("node").agg(F.sum("x").alias("x")).observe(told, F.sum("x").alias("s")))
        before, total = total, told.get["s"]
        if total - before <= tolerance * total:  # nothing is ever taken away
            ranks = more
            break
        into, onward = links.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("i")), links.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("o"))
        paths = into.join(onward, "node").agg(F.sum(F.col("i") * F.col("o")).alias("p")).first()["p"] or 0
        if paths > growth * first:
            base, fixed = ranks, links
            ranks = converged(scratch, more, lambda x: passed(x, fixed).unionByName(base).groupBy("node").agg(F.sum("x").alias("x")), tolerance, rounds)
            total = ranks.agg(F.sum("x").alias("s")).first()["s"]
            break
        far = links.select(F.col("src").alias("mid"), F.col("dst").alias("to"), F.col("w").alias("w2"))
        double = links.join(far, F.col("dst") == F.col("mid")).groupBy("src", F.col("to").alias("dst")).agg(F.sum(F.col("w") * F.col("w2")).alias("w"))
        longer = scratch.save(double)
        scratch.discard(links, ranks)
        links, ranks = longer, more
    return ranks.select("node", F.round(F.col("x") / total, 8).alias("rank"))


def ancestors(edges: DataFrame, depth: int = 3, src: str = "src", dst: str = "dst") -> DataFrame:
    """(``node``, ``ancestor``, ``distance``) over at most ``depth`` steps up, the shortest distance, without the node itself."""
    up = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.col(dst).alias("node"), F.col(src).alias("ancestor")).distinct()
    level, levels = up.withColumn("distance", F.lit(1)), []
    for d in range(1, depth + 1):
        levels.append(level)
        step = up.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("next"))
        level = level.join(step, "ancestor").select("node", F.col("next").alias("ancestor"), F.lit(d + 1).alias("distance")).distinct()
    every = levels[0]
    for more in levels[1:]:
        every = every.unionByName(more)
    return every.where(F.col("node") != F.col("ancestor")).groupBy("node", "ancestor").agg(F.min("distance").alias("distance"))


def network_summary(edges: DataFrame) -> DataFrame:
    """One row of an undirected graph (``u``, ``v``): nodes, edges, density, triangles, transitivity, degree centralization, largest component.

    Each edge points from its end of lower degree to the other; triangles are paths of two such edges
    closed by a third, so a hub of a million neighbours makes no million pairs.
    """
    scratch = Scratch(edges.sparkSession, "network")
    e = scratch.save(undirected(edges, "u", "v"))
    ends = e.select(F.explode(F.array("u", "v")).alias("node"))
    deg = scratch.save(ends.groupBy("node").agg(F.count("*").alias("d")))
    d1, d2 = deg.select(F.col("node").alias("u"), F.col("d").alias("du")), deg.select(F.col("node").alias("v"), F.col("d").alias("dv"))
    up = F.struct("du", "u") < F.struct("dv", "v")
    orient = scratch.save(e.join(d1, "u").join(d2, "v").select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("lo"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("hi")))
    second = orient.select(F.col("lo").alias("lo"), F.col("hi").alias("hi2"))
    wedges = orient.join(second, "lo").where("hi < hi2").select(F.least("hi", "hi2").alias("u"), F.greatest("hi", "hi2").alias("v"))
    triangles = wedges.join(e, ["u", "v"]).agg(F.count("*").alias("triangles"))
    sizes = components(e).groupBy("component").agg(F.count("*").alias("size")).agg(F.max("size").alias("largest_component"))
    totals = deg.agg(F.count("*").alias("nodes"), (F.sum("d") / 2).cast("long").alias("edges"), F.sum(F.col("d") * (F.col("d") - 1) / 2).alias("open"), F.max("d").alias("dmax"), F.sum("d").alias("dsum"))
    n = F.col("nodes")
    one = totals.join(F.broadcast(triangles)).join(F.broadcast(sizes))  # single rows
    return one.select(
        "nodes", "edges", F.round(safe_div(2 * F.col("edges"), n * (n - 1)), 9).alias("density"), "triangles", F.round(safe_div(3 * F.col("triangles"), F.col("open")), 6).alias("transitivity"),
        F.round(safe_div(n * F.col("dmax") - F.col("dsum"), (n - 1) * (n - 2)), 6).alias("centralization"), "largest_component",
    )


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``modularity`` of a labelling (``node``, ``label``) of an undirected graph (``u``, ``v``)."""
    lu, lv = labels.select(F.col("node").alias("u"), F.col("label").alias("lu")), labels.select(F.col("node").alias("v"), F.col("label").alias("lv"))
    e = undirected(edges, "u", "v").join(lu, "u").join(lv, "v")
    per = e.select(F.explode(F.array(F.struct(F.col("lu").alias("label"), F.when(F.col("lu") == F.col("lv"), 0.5).otherwise(0.0).alias("inside")), F.struct(F.col("lv").alias("label"), F.when(F.col("lu") == F.col("lv"), 0.5).otherwise(0.0).alias("inside")))).alias("x")).groupBy("x.label").agg(F.sum("x.inside").alias("inside"), F.count("*").alias("degree"))
    total = per.agg(F.sum("degree").alias("m2"))
    return per.join(F.broadcast(total)).agg(F.round(F.sum(2 * F.col("inside") / F.col("m2") - F.pow(F.col("degree") / F.col("m2"), 2)), 6).alias("modularity"))


def label_communities(edges: DataFrame, rounds: int = 8) -> DataFrame:
    """(``node``, ``label``) by label propagation with a fixed number of rounds; ties go to the smaller label.

    A stand-in for modularity optimisation that needs only sums: each node takes the label most common
    among its neighbours and itself.
    """
    scratch = Scratch(edges.sparkSession, "communities")
    e = undirected(edges, "u", "v")
    both = scratch.save(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    labels = scratch.save(both.select(F.col("u").alias("node")).distinct().withColumn("label", F.col("node")))
    for _ in range(rounds):
        heard = both.join(labels.select(F.col("node").alias("v"), "label"), "v").select(F.col("u").alias("node"), "label").unionByName(labels)
        votes = heard.groupBy("node", "label").agg(F.count("*").alias("n"))
        most = votes.groupBy("node").agg(F.max("n").alias("n"))
        new = scratch.save(votes.join(most, ["node", "n"]).groupBy("node").agg(F.min("label").alias("label")))
        scratch.discard(labels)
        labels = new
    return labels


def anchored_windows(rows: DataFrame, key: str, time_col: str, window_s: float) -> DataFrame:
    """Greedy windows per key: one opens at the first time that no window holds and takes all within ``window_s`` (inclusive).

    Returns ``key``, ``window_start``, ``n``. Each time has one successor, the first time beyond its window, so the
    opening times are the chain of successors from the first; the chain is found by doubling, in rounds
    logarithmic in its length, and no key's times are gathered.
    """
    scratch = Scratch(rows.sparkSession, "windows")
    s = F.unix_micros(F.col(time_col).cast("timestamp"))
    times = scratch.save(rows.where(F.col(time_col).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k"), s.alias("t")).agg(F.count("*").alias("n")))
    span = int(window_s * 1_000_000)
    probes = times.select("k", F.col("t").alias("owner"), F.timestamp_micros(F.col("t") + span + 1).alias("at"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("v"))
    marks = times.select("k", F.lit(None).cast("long").alias("owner"), F.timestamp_micros("t").alias("at"), F.lit(1).alias("side"), F.col("t").alias("v"))
    nxt = scratch.save(fill(probes.unionByName(marks), ["k"], "at", ["side"], {"to": F.col("v")}, forward=False).where("side = 0 and to is not null").select("k", F.col("owner").alias("t"), "to"))
    opened = scratch.save(times.groupBy("k").agg(F.min("t").alias("t")))
    while True:
        more = opened.join(nxt, ["k", "t"]).select("k", F.col("to").alias("t")).join(opened, ["k", "t"], "left_anti")
        more = scratch.save(more.distinct())
        if more.isEmpty():
            break
        opened = scratch.save(opened.unionByName(more))
        far = nxt.select("k", F.col("t").alias("to"), F.col("to").alias("to2"))
        nxt = scratch.save(nxt.join(far, ["k", "to"]).select("k", "t", F.col("to2").alias("to")))
    # Every time belongs to the last opening at or before it.
    tagged = times.select("k", F.timestamp_micros("t").alias("at"), "n", F.lit(None).cast("long").alias("v"), F.lit(1).alias("side")).unionByName(
        opened.select("k", F.timestamp_micros("t").alias("at"), F.lit(None).cast("long").alias("n"), F.col("t").alias("v"), F.lit(0).alias("side")))
    return fill(tagged, ["k"], "at", ["side"], {"start": F.col("v")}, forward=True).where("side = 1").groupBy("k", "start").agg(F.sum("n").alias("n")).select(
        F.col("k").alias(key), F.timestamp_micros("start").alias("window_start"), "n")


def shared_item_groups(holdings: DataFrame, key: str, item: str, least_shared: int = 2, dear: float = 32.0) -> DataFrame:
    """(``key``, ``group``): keys linked, directly or through others, by holding at least two items in common.

    Links come from the pairs of keys of an item, or from the pairs of items of a key, each a hub to which its holders link: two keys that share two
    items share a pair of items. The fewer pairs are listed. Where even these are more than ``dear`` times the holdings, keys are linked first
    to the key of most items that holds an item with them. Only pairs that these groups leave apart are left to look at: those of a key outside of
    the largest group and one of any other. Only ``least_shared`` of 1 and 2 are offered.
    """
    held = holdings.select(key, item).where(F.col(key).isNotNull() & F.col(item).isNotNull()).distinct()
    scratch = Scratch(holdings.sparkSession, "shared")
    if least_shared == 1:
        # An item becomes the star of its least holder, which keeps items out of the result.
        held = scratch.save(held)
        shared = held.groupBy(item).agg(F.min(key).alias("u"), F.count("*").alias("n")).where("n > 1")
        return components(held.join(shared, item).select("u", F.col(key).alias("v"))).select(F.col("node").alias(key), F.col("component").alias("group"))
    if least_shared != 2:
        raise ValueError("least_shared must be 1 or 2")
    named = scratch.save(held.select(F.col(key).alias("name"), F.col(item).alias("thing")))
    keys = scratch.save(named.groupBy("name").agg(F.count("*").alias("r")).where("r > 1").select("name", "r", F.monotonically_increasing_id().alias("k")))
    held = scratch.save(named.join(keys, "name").select("thing", "k", "r"))
    wide = scratch.save(held.groupBy("thing").agg(F.count("*").alias("n")).where("n > 1").select("thing", F.monotonically_increasing_id().alias("i")))
    scratch.discard(named)
    held, named = scratch.save(held.join(wide, "thing").select("i", "k", "r")), held
    scratch.discard(named)

    def by_item(some: DataFrame, any_: DataFrame, once: Column) -> DataFrame:
        """Pairs of keys (``u``, ``v``) with two items in common."""
        pairs = some.join(any_, "i").where(once)
        return pairs.groupBy("u", "v").agg(F.count("*").alias("n")).where("n > 1").select("u", "v")

    def by_key(rows: DataFrame) -> DataFrame:
        """Keys that share pairs of items, each linked to the least."""
        hubs = scratch.save(rows.select("k", "i").join(rows.select("k", F.col("i").alias("j")), "k").where("i < j"))
        return hubs.join(hubs.groupBy("i", "j").agg(F.min("k").alias("u"), F.count("*").alias("n")).where("n > 1"), ["i", "j"]).select("u", F.col("k").alias("v")).where("u <> v")

    def cost(rows: DataFrame, of: str) -> float:
        """The pairs, ordered and with themselves, of rows of the same ``of``."""
        return rows.groupBy(of).agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n")).alias("s")).first()["s"] or 0.0

    pairs, hubs = cost(held, "i"), cost(held, "k")
    u, v = held.select("i", F.col("k").alias("u")), held.select("i", F.col("k").alias("v"))
    if min(pairs, hubs) <= dear * held.count():
        links = by_item(u, v, F.col("u") < F.col("v")) if pairs <= hubs else by_key(held)
    else:
        heads = held.groupBy("i").agg(F.max(F.struct("r", "k")).alias("h")).select("i", F.col("h.k").alias("u"))
        seeds = scratch.save(components(by_item(heads, v, F.col("u") != F.col("v"))))
        at = scratch.save(held.join(seeds.withColumnRenamed("node", "k"), "k", "left").select("i", "k", F.coalesce("component", "k").alias("c")))
        largest = at.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "c").first()["c"]
        outside = F.col("c") != largest
        open_ = scratch.save(at.join(at.groupBy("i").agg(F.count("*").alias("n"), F.count_if(outside).alias("o"), F.min("c").alias("a"), F.max("c").alias("z")).where("o > 0 and a < z"), "i"))
        pairs = open_.groupBy("i").agg(F.max(F.col("o").cast("double") * F.col("n")).alias("n")).agg(F.sum("n").alias("s")).first()["s"] or 0.0
        if pairs <= cost(open_, "k"):
            some, any_ = open_.where(outside).select("i", F.col("k").alias("u"), F.col("c").alias("cu")), open_.select("i", F.col("k").alias("v"), F.col("c").alias("cv"))
            rest = by_item(some, any_, (F.col("cu") != F.col("cv")) & ((F.col("u") < F.col("v")) | (F.col("cv") == largest)))
        else:
            rest = by_key(open_)
        links = seeds.select(F.col("component").alias("u"), F.col("node").alias("v")).unionByName(rest)
    found = scratch.save(components(links).join(keys.select(F.col("k").alias("node"), "name"), "node"))
    return found.join(found.groupBy("component").agg(F.min("name").alias("group")), "component").select(F.col("name").alias(key), "group")


def pair_overlaps(pairs: DataFrame, holdings: DataFrame, a: str, b: str, key: str, item: str) -> DataFrame:
    """Given pairs with ``shared`` items and their ``jaccard``; linear in pairs times items of the rarer side."""
    held = holdings.select(key, item).where(F.col(key).isNotNull() & F.col(item).isNotNull()).distinct()
    size = held.groupBy(key).agg(F.count("*").alias("n"))
    p = pairs.select(a, b).distinct()
    first = p.join(held.withColumnRenamed(key, a), a)
    both = first.join(held.select(F.col(key).alias(b), F.col(item)), [b, item]).groupBy(a, b).agg(F.count("*").alias("shared"))
    sized = p.join(both, [a, b], "left").join(size.select(F.col(key).alias(a), F.col("n").alias("na")), a, "left").join(size.select(F.col(key).alias(b), F.col("n").alias("nb")), b, "left")
    sh = F.coalesce("shared", F.lit(0))
    union = F.coalesce("na", F.lit(0)) + F.coalesce("nb", F.lit(0)) - sh
    return sized.select(a, b, sh.alias("shared"), F.round(safe_div(sh, union), 6).alias("jaccard"))


def random_walks(edges: DataFrame, walks: int = 200, length: int = 30, seed: int = 42) -> DataFrame:
    """(``walk``, ``nodes``): walks from every node of an undirected graph, each step chosen by a hash, so repeatable.

    A step takes the neighbour numbered ``hash mod degree``. Up to ``WHOLE_EDGES`` pairs of texts go whole to tasks, which walk from some of the
    nodes, and no walk is shuffled or stored; beyond, ``_joined_walks``.
    """
    spark = edges.sparkSession
    e = Scratch(spark, "walks").save(undirected(edges, "u", "v"))
    table = whole(e) if dict(e.dtypes)["u"] == "string" and walks > 0 and length > 0 else None
    if table is None:
        return _joined_walks(e, walks, length, seed)
    names, u, v = numbered(table)
    given = spark.sparkContext.broadcast((names, *neighbours(len(names), u, v)))
    at_once = max(1, 16_000 // walks)

    def walk(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, start, to = given.value
        for part in parts:
            own = part.column(0).to_numpy()
            for some in np.array_split(own, range(at_once, len(own), at_once)):
                for at, texts in by_length(names.take(pa.array(some))):
                    yield from from_nodes(some[at], texts, names, start, to)

    def from_nodes(some, texts, names, start, to):  # nodes whose names are of one length
        for heads, path in _walked(some, texts, start, to, walks, length, seed):
            width = heads.shape[1]
            walk = pa.Array.from_buffers(pa.string(), len(heads), [None, pa.py_buffer(np.arange(0, (len(heads) + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(heads))])
            nodes = pa.ListArray.from_arrays(pa.array(np.arange(0, path.size + 1, length, dtype=np.int32)), names.take(pa.array(path.reshape(-1))).cast(pa.string()))
            yield pa.record_batch([walk, nodes], ["walk", "nodes"])

    tasks = max(1, min(len(names), 8 * spark.sparkContext.defaultParallelism))
    return spark.range(0, len(names), 1, tasks).mapInArrow(walk, "walk string, nodes array<string>")


def _walked(some: np.ndarray, texts: np.ndarray, start: np.ndarray, to: np.ndarray, walks: int, length: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The walks from ``some`` nodes, whose names are ``texts``: names of walks, as rows of bytes, and their nodes, node by node, for walks numbered by as many digits at once."""
    degree, numbers = np.diff(start), [str(w).encode() for w in range(1, walks + 1)]
    for digits in sorted({len(x) for x in numbers}):
        tails = np.array([[*b"#", *x] for x in numbers if len(x) == digits], np.uint8)
        heads = np.hstack([np.repeat(texts, len(tails), axis=0), np.tile(tails, (len(texts), 1))])
        path = np.empty((len(heads), length), np.int64)
        path[:, 0] = np.repeat(some, len(tails))
        for step in range(length - 1):
            end = np.frombuffer(f":{step}:{seed}".encode(), np.uint8)
            h = digests(np.hstack([heads, np.broadcast_to(end, (len(heads), len(end)))]), words=1)[0] & 0x7FFFFFFF
            here = path[:, step]
            path[:, step + 1] = to[start[here] + h % degree[here]]
        yield heads, path


def _joined_walks(e: DataFrame, walks: int, length: int, seed: int) -> DataFrame:
    """``random_walks`` over any number of pairs: a step finds its neighbour by an equi-join on (node, number)."""
    scratch = Scratch(e.sparkSession, "walks")
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    numbered = scratch.save(both.select(F.col("u").alias("node"), F.col("v").alias("to"), (F.row_number().over(Window.partitionBy("u").orderBy("v")) - 1).alias("i")))
    deg = scratch.save(numbered.groupBy("node").agg(F.count("*").alias("d")))
    state = deg.select("node", F.explode(F.sequence(F.lit(1), F.lit(walks))).alias("w")).withColumn("walk", F.concat_ws("#", "node", "w")).withColumn("nodes", F.array("node"))
    saved = None
    for step in range(length - 1):
        pick = state.join(deg, "node").withColumn("i", F.pmod(hash31(F.concat_ws(":", "walk", F.lit(step), F.lit(seed))), F.col("d")).cast("int"))
        moved = pick.join(numbered, ["node", "i"]).select(F.col("to").alias("node"), "walk", F.concat("nodes", F.array("to")).alias("nodes"))
        state = moved
        if step % 3 == 2:
            state = scratch.save(moved)
            scratch.discard(saved)
            saved = state
    return state.select("walk", "nodes")


def node_vectors(walks: DataFrame, size: int = 64, window: int = 10, seed: int = 42, parts: int | None = None) -> DataFrame:
    """(``node``, ``vector``) learned from walks by skip-gram, in as many ``parts`` at once as the cluster has cores; what the parts learn of a node is averaged."""
    from pyspark.ml.feature import Word2Vec

    parts = parts or walks.sparkSession.sparkContext.defaultParallelism
    words = walks.select(F.transform("nodes", lambda x: x.cast("string")).alias("words"))
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=0, seed=seed, maxIter=1, numPartitions=parts, inputCol="words", outputCol="out").fit(words)
    return model.getVectors().select(F.col("word").alias("node"), "vector")


def learned_vectors(edges: DataFrame, size: int = 64, window: int = 10, walks: int = 200, length: int = 30, seed: int = 42, rounds: int = 12, steps: int = 4, most: int = 400_000) -> DataFrame:
    """(``node``, ``vector``) by skip-gram with five negative samples over all of ``random_walks``, for up to ``most`` pairs of texts; beyond, ``node_vectors``.

    Skip-gram's loss is a sum over pairs of nodes that meet within the window. Tasks walk and count how often each pair does, over every walk, and the
    loss is lowered over these counts: all inner vectors by ``steps`` of descent with the outer ones fixed, and the reverse, ``rounds`` times. Rows don't
    depend on each other within a step, so tasks share the nodes out, and nothing is averaged. Negatives are drawn anew each time, by counts to the 0.75.
    """
    from pyspark.ml.functions import vector_to_array

    spark = edges.sparkSession
    e = Scratch(spark, "vectors").save(undirected(edges, "u", "v"))
    table = whole(e, most) if dict(e.dtypes)["u"] == "string" and walks > 0 and length > 1 else None
    if table is None:
        return node_vectors(random_walks(e, walks, length, seed), size, window, seed).select("node", vector_to_array("vector").alias("vector"))
    if not table.num_rows:
        return spark.createDataFrame([], "node string, vector array<double>")
    names, u, v = numbered(table)
    n, block, negatives, drawn = len(names), 32, 5, 1024
    start, to = neighbours(n, u, v)
    order = by_depth(start, to)
    tasks = min(n, 8 * spark.sparkContext.defaultParallelism)
    given = spark.sparkContext.broadcast((names, start, to, order))

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, start, to, order = given.value
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        counted, at_once = Contexts(n, length, window), max(1, 16_000 // walks)
        for part in parts:
            own = order[part.column(0).to_numpy()]
            for some in np.array_split(own, range(at_once, len(own), at_once)):
                for at, texts in by_length(names.take(pa.array(some))):
                    for heads, path in _walked(some[at], texts, start, to, walks, length, seed):
                        few = 8 * len(heads) // len(at)  # walks from eight nodes
                        for k in range(0, len(path), few):
                            counted.add(place[path[k : k + few]])
                if counted.held > counted.most // 2:
                    yield by_block(counted)
        yield by_block(counted)

    def by_block(counted: Contexts) -> pa.RecordBatch:
        a, b, c = counted.take()
        blocks, first = np.unique(a // block, return_index=True)
        bounds = pa.array(np.append(first, len(a)), pa.int32())
        lists = [pa.ListArray.from_arrays(bounds, pa.array(x, kind)) for x, kind in ((a % block, pa.int32()), (b, pa.int32()), (c, pa.float64()))]
        return pa.record_batch([pa.array(blocks, pa.int32()), *lists], ["block", "i", "j", "c"])

    def merge(part: pa.Table) -> pa.Table:
        i, j, c = (part[x].combine_chunks().flatten().to_numpy() for x in ("i", "j", "c"))
        key, c = summed([(i.astype(np.int64) * n + j, c)])
        others, at = np.unique(key % n, return_inverse=True)
        columns = others.astype(np.int32), (key // n).astype(np.int32), at.astype(np.int32), c.astype(np.float32), np.bincount(key // n, c)
        return pa.table([part["block"][:1], *[pa.array([x.tobytes()]) for x in columns]], ["block", "others", "i", "at", "c", "mass"])

    met = spark.range(0, n, 1, tasks).mapInArrow(count, "block int, i array<int>, j array<int>, c array<double>")
    files = max(spark.sparkContext.defaultParallelism, n // 1000)  # small ones: readers take a file's counts into memory at once
    met = Scratch(spark, "contexts").save(met.repartition(files, "block").groupBy("block").applyInArrow(merge, "block int, others binary, i binary, at binary, c binary, mass binary"))
    mass = np.zeros(n)
    for k, c in zip(*met.select("block", "mass").toArrow().to_pydict().values(), strict=True):
        mass[k * block : (k + 1) * block] = np.frombuffer(c)
    noise = mass**0.75 / (mass**0.75).sum()
    sides = [np.zeros((n, size), np.float32), (np.random.default_rng(seed).standard_normal((n, size)) / size**0.5).astype(np.float32)]  # outer, inner

    def learn(turn: int, shared: tuple, named: bool):
        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (own, other), (mine, theirs) = (x.value for x in shared)
            upto, (names, _, _, order) = np.cumsum(theirs), given.value
            for part in parts:
                for k, *lists in zip(*(x.to_pylist() for x in part.columns), strict=True):
                    others, i, at, c = (np.frombuffer(x, kind) for x, kind in zip(lists, (np.int32, np.int32, np.int32, np.float32), strict=True))
                    rows = np.arange(k * block, min(n, (k + 1) * block))
                    counts = np.zeros((len(rows), len(others)), np.float32)
                    counts[i, at] = c
                    z = np.minimum(np.searchsorted(upto, np.random.default_rng([seed, turn, k]).random(drawn) * upto[-1]), n - 1)
                    x = fitted(own[rows], other[others], counts, other[z], (mine[rows] * (negatives / drawn)).astype(np.float32), steps)
                    if named:
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, size), pa.int32()), pa.array(x.reshape(-1).astype(float)))
                        yield pa.record_batch([names.take(pa.array(order[rows])).cast(pa.string()), lists], ["node", "vector"])
                    else:
                        yield pa.record_batch([pa.array([k], pa.int32()), pa.array([x.tobytes()])], ["block", "rows"])

        return met.drop("mass").mapInArrow(run, "node string, vector array<double>" if named else "block int, rows binary")

    total = mass.sum()
    for turn in range(2 * rounds):
        inner = turn % 2
        # A node draws negatives by its count, among outer vectors by noise; seen from these, by their noise among inner ones by count.
        weights = (mass, noise) if inner else (total * noise, mass / total)
        shared = tuple(spark.sparkContext.broadcast(x) for x in ((sides[inner], sides[1 - inner]), weights))
        if turn == 2 * rounds - 1:
            return learn(turn, shared, True)
        sides[inner] = np.empty_like(sides[inner])
        for k, x in zip(*learn(turn, shared, False).toArrow().to_pydict().values(), strict=True):
            sides[inner][k * block : (k + 1) * block] = np.frombuffer(x, np.float32).reshape(-1, size)
        for x in shared:
            x.destroy()


def funder_windows(edges: DataFrame, window_s: float = 86_400, least: int = 3) -> DataFrame:
    """Per funder its greedy windows of at least ``least`` fundings and a score of how synchronised they are."""
    w = anchored_windows(edges, "src", "ts", window_s).where(F.col("n") >= least)
    return w.groupBy("src").agg(F.count("*").alias("windows"), F.max("n").alias("largest"), F.sum("n").alias("funded")).withColumn("sync", F.round(F.least(F.col("largest") / 10.0, F.lit(1.0)), 6))


def first_funding_gap(edges: DataFrame) -> DataFrame:
    """Per funder: number funded, entropy of the times over hours of the day, seconds between first and last."""
    s: Column = seconds(F.col("ts"))
    hours = edges.where(F.col("ts").isNotNull()).groupBy("src", F.hour("ts").alias("h")).agg(F.count("*").alias("c"), F.min(s).alias("a"), F.max(s).alias("b"))
    c = F.col("c")
    return hours.groupBy("src").agg(F.sum(c).alias("funded"), F.round(F.log(F.sum(c)) - F.sum(c * F.log(c)) / F.sum(c) + 0.0, 6).alias("hour_entropy"), F.round(F.max("b") - F.min("a"), 6).alias("span_s"))


def weighted_degrees(edges: DataFrame, src: str, dst: str, weight: str) -> DataFrame:
    """Per node of a weighted directed graph: ``received``, ``sent``, ``largest_share`` and ``hhi`` of what it received by source, ``balance``, ``ratio``.

    Repeated edges add up; edges without an end or weight count as none. What is summed is pre-aggregated per edge.
    """
    e = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & F.col(weight).isNotNull() & ~F.isnan(F.col(weight).cast("double")))
    per = e.groupBy(F.col(src).alias("s"), F.col(dst).alias("d")).agg(F.sum(F.col(weight).cast("double")).alias("w"))
    w = F.col("w")
    side = lambda node, i, o: F.struct(F.col(node).alias("node"), i.alias("i"), o.alias("o"))
    zero = F.lit(0.0)
    ends = per.select(F.explode(F.array(side("s", zero, w), side("d", w, zero))).alias("x"))
    t = ends.groupBy("x.node").agg(F.sum("x.i").alias("r"), F.sum("x.o").alias("t"), F.max("x.i").alias("m"), F.sum(F.col("x.i") * F.col("x.i")).alias("q"))
    r, sent = F.col("r"), F.col("t")
    return t.select(
        "node", F.round(r, 6).alias("received"), F.round(sent, 6).alias("sent"), F.round(F.when(r > 0, F.col("m") / r).otherwise(0.0), 6).alias("largest_share"), F.round(F.when(r > 0, F.col("q") / (r * r)).otherwise(0.0), 6).alias("hhi"),
        (F.round(r - sent, 6) + 0.0).alias("balance"), F.round(F.when(r + sent > 0, r / (r + sent)).otherwise(0.5), 6).alias("ratio"))


def funder_concentration(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """One row: ``funders``, ``entropy`` (nats) of the funded wallets over them, the ``dominant`` funder (ties: the least) and its ``share``; none without edges."""
    out = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(src, dst).distinct().groupBy(F.col(src).alias("s")).agg(F.count("*").alias("c"))
    c = F.col("c")
    one = out.agg(F.count("*").alias("funders"), F.sum(c).alias("n"), F.sum(c * F.log(c)).alias("e"), F.max(c).alias("top")).where("funders > 0")
    lead = out.join(F.broadcast(one.select("top")), c == F.col("top")).agg(F.min("s").alias("dominant"))  # one row
    n = F.col("n")
    return one.join(F.broadcast(lead)).select("funders", F.round(F.log(n) - F.col("e") / n + 0.0, 6).alias("entropy"), "dominant", F.round(F.col("top") / n, 6).alias("share"))


def member_share(holdings: DataFrame, group: str, who: str, value: str, members: DataFrame) -> DataFrame:
    """Per group: ``holders``, ``members`` among them and the members' ``share`` of the value."""
    m = members.select(F.col(members.columns[0]).alias(who)).where(F.col(who).isNotNull()).distinct().withColumn("__in", F.lit(1))
    t = holdings.join(m, who, "left").groupBy(group).agg(F.count("*").alias("holders"), F.count("__in").alias("members"), F.sum(F.when(F.col("__in") == 1, F.col(value)).otherwise(0.0)).alias("a"), F.sum(value).alias("b"))
    return t.select(group, "holders", "members", F.round(safe_div(F.col("a"), F.col("b")), 6).alias("share"))


def whole(edges: DataFrame, most: int = WHOLE_EDGES) -> pa.Table | None:
    """Pairs (``u``, ``v``) on the driver, to be handed to tasks; None if there are more than ``most``."""
    return edges.select("u", "v").toArrow() if edges.count() <= most else None


def betweenness(edges: DataFrame, sources: int | None = None) -> DataFrame:
    """(``node``, ``betweenness``): the share of shortest paths between others that lead through a node, over pairs (``u``, ``v``).

    Paths start from all nodes, or from so many ``sources``, chosen by hash; the sampled sums are then scaled up. Trees that hang on
    the rest are counted by their sizes, and every task searches the rest, ``WHOLE_EDGES`` at most, from some of its nodes. Beyond, and for
    samples, ``_joined_betweenness``. Normalised by (n - 1)(n - 2); 0 for graphs of under three nodes.
    """
    spark = edges.sparkSession
    e = Scratch(spark, "pairs").save(undirected(edges, "u", "v"))
    table = None if sources else whole(e)
    if table is None:
        return _joined_betweenness(e, sources)
    names, u, v = numbered(table)
    n, paths = len(names), Paths(len(names), u, v)
    x = paths.inner
    if len(paths.core):
        tasks = min(len(paths.core), 4 * spark.sparkContext.defaultParallelism)
        given = spark.sparkContext.broadcast(paths)

        def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                for first in part.column(0).to_pylist():
                    p = given.value
                    got = p.passed(np.arange(first, len(p.core), tasks))
                    at = np.flatnonzero(got)
                    yield pa.record_batch([pa.array(p.core[at]), pa.array(got[at])], ["i", "x"])

        got = spark.range(0, tasks, 1, tasks).mapInArrow(search, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
        x[got["i"].to_numpy()] += got["x"].to_numpy()
        given.destroy()
    t = pa.table({"node": names, "x": x / max((n - 1) * (n - 2), 1)})
    kind = edges.schema["u"].dataType.simpleString()
    return spark.createDataFrame(t).select(F.col("node").cast(kind).alias("node"), F.round("x", 8).alias("betweenness"))


def _joined_betweenness(e: DataFrame, sources: int | None) -> DataFrame:
    """``betweenness`` of any number of pairs: one breadth-first search serves all sources.

    A level is a join and a sum over (source, node), and the way back adds up what each node passes on.
    """
    scratch = Scratch(e.sparkSession, "betweenness")
    both = scratch.save(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    nodes = scratch.save(both.select(F.col("u").alias("node")).distinct())
    n = nodes.count()
    sources = sources or n
    start = nodes.orderBy(hash31(F.col("node").cast("string")), "node").limit(sources).select(F.col("node").alias("s"), "node", F.lit(0).alias("d"), F.lit(1.0).alias("paths"))
    levels = [scratch.save(start)]
    while True:
        reached = levels[-1].join(both, F.col("node") == F.col("u")).groupBy("s", F.col("v").alias("node")).agg(F.sum("paths").alias("paths"))
        # On an undirected graph a step leads to the level before, the same or the next one.
        old = levels[-1].select("s", "node")
        if len(levels) > 1:
            old = old.unionByName(levels[-2].select("s", "node"))
        reached = reached.join(old, ["s", "node"], "left_anti")
        level = scratch.save(reached.select("s", "node", F.lit(len(levels)).alias("d"), "paths"))
        if level.isEmpty():
            break
        levels.append(level)
    passed = levels[-1].select("s", "node", F.lit(0.0).alias("x"))
    sums = [] if len(levels) == 1 else [passed]
    for near, far in zip(reversed(levels[:-1]), reversed(levels[1:]), strict=True):
        given = far.select("s", F.col("node").alias("v"), F.col("paths").alias("p2")).join(passed.select("s", F.col("node").alias("v"), "x"), ["s", "v"])
        up = given.join(both, "v").join(near.select("s", F.col("node").alias("u"), "paths"), ["s", "u"])
        got = up.groupBy("s", F.col("u").alias("node")).agg(F.sum(F.col("paths") / F.col("p2") * (1 + F.col("x"))).alias("x"))
        passed = scratch.save(near.select("s", "node").join(got, ["s", "node"], "left").select("s", "node", F.coalesce("x", F.lit(0.0)).alias("x")))
        sums.append(passed)
    every = nodes.select("node", F.lit(0.0).alias("x"))
    for part in sums:
        every = every.unionByName(part.where("s <> node").select("node", "x"))
    scale = n / max(min(n, sources), 1) / max((n - 1) * (n - 2), 1) if n else 0.0
    return every.groupBy("node").agg(F.round(F.sum("x") * scale, 8).alias("betweenness"))


def split_blocks(rows: DataFrame, block: str, order: list[Column], most: int) -> DataFrame:
    """Rows with ``part``: blocks of more than ``most`` rows are cut into parts of so many, in the given total order."""
    return ranked(rows, [block], order).withColumn("part", F.floor((F.col("rank") - 1) / most)).drop("rank", "size")
