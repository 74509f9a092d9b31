"""Parent-child links to full hierarchies: roots, depths, circles, paths, descendants.

Links are solved as a weighted disjoint-set forest: every node points to a representative further
up, the weight being the number of steps between. Each partition compresses its own links (numpy,
a vectorised form of path compression); nodes at which the chains of one partition enter another
form a contracted set of links, which is merged again in fewer partitions, until one bounded task
holds the rest. Where contraction doesn't shrink the set below that bound, the same compression
runs as joins (pointer jumping), so no size needs an unbounded task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.scratch import Scratch

SOLVED = "node long, root long, steps long, low long, circular boolean"
#: Links one merging task may hold (about 100 bytes each).
MERGE_LINKS = 1_000_000


def compress(node: np.ndarray, root: np.ndarray, steps: np.ndarray, low: np.ndarray, circular: np.ndarray) -> tuple[np.ndarray, ...]:
    """Follow links as far as the given nodes lead. ``low``: least id from a node up to its root (exclusive).

    Nodes that run into a circle come back with ``circular`` and the circle's least id as root;
    nodes that came in as circular are ends.
    """
    order = np.argsort(node, kind="stable")
    node, root, steps, low, circular = (x[order].copy() for x in (node, root, steps, low, circular))
    at = np.searchsorted(node, root)
    at[at == len(node)] = 0
    nxt = np.where((node[at] == root) & ~circular, at, -1) if len(node) else at
    jumped, rounds = np.flatnonzero(nxt >= 0), 0
    while len(jumped) and 1 << rounds <= 2 * len(node):
        to = nxt[jumped]
        # Computed from the old state, then written: both ends of a jump may be in the set.
        new = steps[jumped] + steps[to], np.minimum(low[jumped], low[to]), root[to], circular[to], nxt[to]
        steps[jumped], low[jumped], root[jumped], circular[jumped], nxt[jumped] = new
        jumped = jumped[nxt[jumped] >= 0]
        rounds += 1
    if len(jumped):  # more jumps than nodes: what still moves circles, and stands on the circle by now
        root[jumped] = low[nxt[jumped]]
        circular[jumped] = True
    return node, root, steps, low, circular


_FIELDS = ("node", "root", "steps", "low", "circular")


def _compress_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts)
    cols = compress(*(t[c].combine_chunks().to_numpy(zero_copy_only=False) for c in _FIELDS))
    yield from pa.table(dict(zip(_FIELDS, cols, strict=True))).to_batches(max_chunksize=200_000)


def _through(solved: DataFrame, above: DataFrame) -> DataFrame:
    """Continue each solved link at the representative that the level above found for its root."""
    a = above.select(*[F.col(c).alias(f"a_{c}") for c in ("node", "root", "steps", "low", "circular")])
    return solved.join(a, solved.root == a.a_node, "left").select(
        "node", F.coalesce("a_root", "root").alias("root"), (F.col("steps") + F.coalesce("a_steps", F.lit(0))).alias("steps"),
        F.least("low", F.coalesce("a_low", "low")).alias("low"), (F.col("circular") | F.coalesce("a_circular", F.lit(False))).alias("circular"),
    )


def _entries(solved: DataFrame) -> DataFrame:
    """The links of nodes at which another link's compressed chain ends: what is left to merge."""
    ends = solved.where(~F.col("circular")).select(F.col("root").alias("end")).distinct()
    return solved.join(ends, solved.node == ends.end, "left_semi")


def _jump(scratch: Scratch, links: DataFrame, n: int) -> DataFrame:
    """The compression as joins, for sets that no single task may hold."""
    state = links
    for _ in range(math.ceil(math.log2(max(2, n))) + 1):
        going = state.where(~F.col("circular"))
        pending = going.select(F.col("root").alias("node")).distinct().join(state.select("node"), "node", "left_semi")
        if pending.isEmpty():
            return state
        moved = scratch.save(_through(going, state).unionByName(state.where(F.col("circular"))))
        scratch.discard(*([] if state is links else [state]))
        state = moved
    # More steps than there are links: what still leads to a link circles, its root being on the circle.
    on = state.select(F.col("node").alias("o_node"), F.when(F.col("circular"), F.col("root")).otherwise(F.col("low")).alias("o_root"))
    going = state.where(~F.col("circular"))
    ended = going.join(on, going.root == on.o_node, "left").select(
        "node", F.coalesce("o_root", "root").alias("root"), "steps", "low", F.col("o_node").isNotNull().alias("circular")
    )
    return ended.unionByName(state.where(F.col("circular")))


def solve_forest(links: DataFrame, merge_links: int = MERGE_LINKS, scratch: Scratch | None = None) -> DataFrame:
    """From unique links (``node``, ``parent``): ``node``, ``root``, ``steps``, ``low``, ``circular``.

    ``root`` is the first ancestor that has no link itself. A node on a circle or below one gets the
    circle's least id and ``circular``. Null nodes and parents are no links. Each input partition is
    one task's share: hand in partitions of at most some millions of links.
    """
    scratch = scratch or Scratch(links.sparkSession, "forest")
    fresh = links.where(F.col("node").isNotNull() & F.col("parent").isNotNull()).select(
        F.col("node").cast("long"), F.col("parent").cast("long").alias("root"), F.lit(1).cast("long").alias("steps"), F.col("node").cast("long").alias("low"), F.lit(False).alias("circular")
    )
    return _solve(scratch, fresh, merge_links, None)


def _solve(scratch: Scratch, links: DataFrame, merge_links: int, before: int | None) -> DataFrame:
    solved = scratch.save(links.mapInArrow(_compress_batches, SOLVED))
    entries = scratch.save(_entries(solved))
    n = entries.count()
    if n == 0:
        return solved
    if n <= merge_links:
        above = scratch.save(entries.coalesce(1).mapInArrow(_compress_batches, SOLVED))
    elif before is None or n < 0.7 * before:
        above = _solve(scratch, entries.repartition(math.ceil(n / merge_links), "node"), merge_links, n)
    else:
        above = _jump(scratch, entries, n)
    return _through(solved, above)


def newest_parents(df: DataFrame, node: str, parent: str, recency: str) -> DataFrame:
    """(``node``, ``parent``) of each node's newest row; ties by the greatest parent, nulls lowest."""
    best = F.max(F.struct(F.col(recency).alias("r"), F.col(parent).cast("long").alias("p")))
    return df.where(F.col(node).isNotNull()).groupBy(F.col(node).cast("long").alias("node")).agg(best.alias("b")).select("node", F.col("b.p").alias("parent"))


def delivered_links(scratch: Scratch, df: DataFrame, node: str, parent: str, recency: str) -> DataFrame:
    """Links whose parent is itself a node of the table.

    The parents that were never delivered are found on the distinct parents and taken out by an
    anti join: a parent with a third of all children is one row there.
    """
    nodes = scratch.save(newest_parents(df, node, parent, recency))
    linked = nodes.where(F.col("parent").isNotNull())
    ghosts = linked.select(F.col("parent").alias("ghost")).distinct().join(nodes.select(F.col("node").alias("ghost")), "ghost", "left_anti")
    return linked.join(ghosts, linked.parent == ghosts.ghost, "left_anti")


def roots_and_depths(df: DataFrame, node: str, parent: str, recency: str, merge_links: int = MERGE_LINKS) -> DataFrame:
    """For each node whose parent is delivered: ``id``, ``root_id``, ``tree_depth`` (-1 at and below circles).

    A node that is its own parent is a circle of one. Nodes without a delivered parent (roots) give
    no row; so does a null id. Empty input gives no rows; other columns are ignored.
    """
    scratch = Scratch(df.sparkSession, "hierarchy")
    solved = solve_forest(delivered_links(scratch, df, node, parent, recency), merge_links, scratch)
    depth = F.when(F.col("circular"), F.lit(-1)).otherwise(F.col("steps")).cast("int")
    return solved.select(F.col("node").alias("id"), F.col("root").alias("root_id"), depth.alias("tree_depth"))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition: each node with the ids from itself up to where its chain leaves the partition."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts)
    node, parent = (t[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("node", "parent"))
    up = dict(zip(node.tolist(), parent.tolist(), strict=True))
    seen: dict[int, tuple[int, list[int]]] = {}
    for start in up:
        chain, x = [], start
        while x in up and x not in seen:
            chain.append(x)
            x = up[x]
        end, tail = seen.get(x, (x, []))
        for y in reversed(chain):
            tail = [y, *tail]
            seen[y] = (end, tail)
    keys = list(seen)
    for i in range(0, len(keys), 20_000):
        some = keys[i : i + 20_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int64()), pa.array([seen[k][0] for k in some], pa.int64()), pa.array([seen[k][1] for k in some], pa.list_(pa.int64()))],
            names=["node", "top", "up"],
        )


def full_paths(df: DataFrame, node: str, parent: str, recency: str, merge_links: int = MERGE_LINKS) -> DataFrame:
    """For each node with a delivered parent: ``id``, ``root_id``, ``tree_depth``, ``path`` (ids, root first).

    Circles have no path (null) and depth -1. Paths are materialised from an index of the parents of
    one partition at a time: segments up to the partition's edge, continued by joins whose number
    is logarithmic in the number of partitions that a chain crosses.
    """
    scratch = Scratch(df.sparkSession, "paths")
    links = scratch.save(delivered_links(scratch, df, node, parent, recency))
    solved = scratch.save(solve_forest(links, merge_links, scratch))
    open_links = links.join(solved.where(~F.col("circular")).select("node"), "node", "left_semi")
    state = scratch.save(open_links.mapInArrow(_segments, "node long, top long, up array<long>"))
    while True:
        nxt = state.select(F.col("node").alias("n_node"), F.col("top").alias("n_top"), F.col("up").alias("n_up"))
        tops = state.select(F.col("top").alias("node")).distinct().join(state.select("node"), "node", "left_semi")
        if tops.isEmpty():
            break
        state = scratch.save(
            state.join(nxt, F.col("top") == F.col("n_node"), "left").select(
                "node", F.coalesce("n_top", "top").alias("top"), F.when(F.col("n_node").isNull(), F.col("up")).otherwise(F.concat("up", "n_up")).alias("up")
            )
        )
    paths = state.select(F.col("node").alias("p_node"), F.concat(F.array("top"), F.reverse("up")).alias("path"))
    depth = F.when(F.col("circular"), F.lit(-1)).otherwise(F.col("steps")).cast("int")
    return solved.join(paths, solved.node == paths.p_node, "left").select(
        F.col("node").alias("id"), F.col("root").alias("root_id"), depth.alias("tree_depth"), "path"
    )


def descendants(paths: DataFrame) -> DataFrame:
    """(``ancestor_id``, ``id``, ``distance``) for every ancestor on each path of ``full_paths``.

    As many rows as the depths add up to, which is the size of the answer; no pairs of siblings arise.
    """
    return paths.where(F.col("path").isNotNull()).select(
        "id", "tree_depth", F.posexplode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("at", "ancestor_id")
    ).select("ancestor_id", "id", (F.col("tree_depth") - F.col("at")).alias("distance"))
