"""The most similar vectors of every vector: vantage-point trees per shard, with relaxed pruning."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.scratch import Scratch

#: Added to distances before a bound may prune: a float64 cosine of unit vectors errs by less than 1e-13, which near distance 0 is 4.5e-7.
SLACK = 1e-6
#: Similarities are compared rounded to nine decimals.
ROUNDED = 1e-9


def chord(sim: np.ndarray) -> np.ndarray:
    """Distance of unit vectors with the given cosine; obeys the triangle inequality."""
    return np.sqrt(np.maximum(0, 2 - 2 * sim))


def float32_error(dims: int) -> float:
    """Bound of the error of a cosine of unit vectors in float32: each product and sum errs by half a unit, as do the inputs."""
    return (dims + 4) * 2.0**-24


class VantageTree:
    """A vantage-point tree, flattened: per leaf the path of vantage points with the interval of distances to each."""

    def __init__(self, unit: np.ndarray, leaf_rows: int, seed: int = 7):
        self.rng = np.random.default_rng(seed)
        self.vantage: list[np.ndarray] = []
        self.cuts: list[float] = []
        self.kids: list[list[int]] = []  # child node, or -1 - leaf
        self.paths: list[list[int]] = []
        self.rows: list[np.ndarray] = []
        self.top = self._grow(unit, np.arange(len(unit)), leaf_rows, [])
        self.vantage = np.array(self.vantage, np.float64).reshape(-1, unit.shape[1])
        self.bounds = [self.interval(unit[r], p) for r, p in zip(self.rows, self.paths, strict=True)]

    def _grow(self, unit: np.ndarray, ids: np.ndarray, leaf_rows: int, path: list[int]) -> int:
        if len(ids) > leaf_rows:
            tried, seen = (ids[self.rng.integers(0, len(ids), n)] for n in (8, 256))
            point = unit[tried[chord(unit[tried] @ unit[seen].T).var(axis=1).argmax()]]
            d = chord(unit[ids] @ point)
            cut = float(np.median(d))
            inside = d <= cut
            if not inside.all():
                at = len(self.cuts)
                self.vantage.append(point)
                self.cuts.append(cut)
                self.kids.append([0, 0])
                self.kids[at] = [self._grow(unit, ids[inside], leaf_rows, [*path, at]), self._grow(unit, ids[~inside], leaf_rows, [*path, at])]
                return at
        self.rows.append(ids)
        self.paths.append(path)
        return -len(self.rows)

    def interval(self, unit: np.ndarray, path: list[int]) -> tuple[np.ndarray, np.ndarray]:
        d = chord(unit @ self.vantage[path].T) if len(unit) else np.zeros((1, len(path)))
        return d.min(axis=0), d.max(axis=0)

    def leaf_of(self, unit: np.ndarray) -> np.ndarray:
        """The leaf whose region holds each vector, also for vectors that weren't in the tree."""
        out = np.zeros(len(unit), np.int32)
        todo = [(self.top, np.arange(len(unit)))]
        while todo:
            at, ids = todo.pop()
            if at < 0:
                out[ids] = -1 - at
            elif len(ids):
                inside = chord(unit[ids] @ self.vantage[at]) <= self.cuts[at]
                todo += [(self.kids[at][0], ids[inside]), (self.kids[at][1], ids[~inside])]
        return out

    def least(self, unit: np.ndarray) -> np.ndarray:
        """Per vector and leaf the triangle inequality's lower bound of the distance to the leaf's vectors."""
        d = chord(unit @ self.vantage.T)
        out = np.zeros((len(unit), len(self.paths)))
        for j, (path, (lo, hi)) in enumerate(zip(self.paths, self.bounds, strict=True)):
            if path:
                out[:, j] = np.maximum(lo - d[:, path], d[:, path] - hi).max(axis=1)
        return out


def unit_rows(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    raw = flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64)
    raw /= np.abs(raw).max(axis=1, keepdims=True) if len(raw) else 1.0  # keeps tiny and huge vectors from under- and overflow
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def search(queries: np.ndarray, reach: np.ndarray, own: np.ndarray, data: np.ndarray, tree: VantageTree, k: int, relax: float, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row of ``data``, similarity) of the ``k`` best rows of each query, fewer where fewer reach.

    All in float64. Best is the greatest cosine rounded to nine decimals, then the least ``rank``. ``reach``: rounded
    cosine below which a row doesn't matter; ``own``: the query's own row, or -1. Leaves are compared in float32; whatever
    lies within its error of the k-th best there is compared again in float64, so nothing is lost to rounding.
    """
    error = float32_error(data.shape[1])
    q32, d32 = queries.astype(np.float32), data.astype(np.float32)
    leaves = [r[np.argsort(rank[r])] for r in tree.rows]
    blocks = [np.ascontiguousarray(d32[r].T) for r in leaves]
    # Where each row lies: a query's own one is left out.
    home, place = np.full(len(data) + 1, -1), np.zeros(len(data) + 1, np.int64)
    for j, r in enumerate(leaves):
        home[r], place[r] = j, np.arange(len(r))
    out = []
    for start in range(0, len(queries), 4096):
        part = slice(start, start + 4096)
        q, exact, mine = q32[part], queries[part], own[part]
        top = np.full((len(q), k), -9.0)  # the k best in float32 so far
        floor = reach[part] - error - ROUNDED
        pool, rough, held = [], [], 0

        def settled() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """The ``k`` best pairs so far; what float32 found counts if it is still in reach, by its float64 cosine."""
            if rough:
                a, b, sims = (np.concatenate(x) for x in zip(*rough, strict=True))
                still = sims >= floor[a]
                pool.append((a[still], b[still], _cosines(exact, data, a[still], b[still])))
            return _best(pool, k, rank)

        bound = tree.least(exact)
        # The leaf nearest by bound to most queries first, so that the reach shrinks early.
        for j in np.argsort(bound.sum(axis=0), kind="stable"):
            active = np.flatnonzero((bound[:, j] - SLACK) * relax < chord(np.clip(floor, -1, 1)))
            if not len(active):
                continue
            rows, got = leaves[j], q[active] @ blocks[j]
            itself = np.flatnonzero(home[mine[active]] == j)
            got[itself, place[mine[active][itself]]] = -9.0
            # Most queries find nothing in most leaves; only the others' cosines are looked at one by one.
            hit = got.max(axis=1) >= np.nextafter(floor[active].astype(np.float32), np.float32(-9))
            active, got = active[hit], got[hit].astype(np.float64)
            if not len(active):
                continue
            best = -np.partition(-got, k - 1, axis=1)[:, :k] if got.shape[1] > k else got
            top[active] = -np.sort(-np.concatenate([top[active], best], axis=1), axis=1)[:, :k]
            floor[active] = np.maximum(floor[active], top[active, -1] - 2 * error - ROUNDED)
            close = got >= np.maximum(floor[active], -2)[:, None]
            if close.sum() > close.size // 8:  # a dense cluster: whole rows in float64, of which the k best stay
                sims = np.where(close, np.round(exact[active] @ data[rows].T, 9), -9.0)
                order = np.argsort(-sims, axis=1, kind="stable")[:, :k]  # rows are in the order of their rank
                sims = np.take_along_axis(sims, order, 1)
                a, b = np.nonzero(sims > -9)
                pool.append((active[a], rows[order[a, b]], sims[a, b]))
            else:
                a, b = np.nonzero(close)
                rough.append((active[a], rows[b], got[a, b]))
            held += int(close.sum())
            if held > 2_000_000:
                pool, rough, held = [settled()], [], 0
        if pool or rough:
            a, b, sims = settled()
            enough = sims >= reach[part][a]
            out.append((a[enough] + start, b[enough], sims[enough]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _cosines(queries: np.ndarray, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rounded float64 cosines of pairs of rows, in bounded chunks."""
    parts = [np.einsum("ij,ij->i", queries[a[i : i + 100_000]], data[b[i : i + 100_000]]) for i in range(0, len(a), 100_000)]
    return np.round(np.concatenate(parts), 9) + 0.0 if parts else np.zeros(0)


def _best(pool: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best pairs of each query."""
    a, b, sims = (np.concatenate(x) for x in zip(*pool, strict=True))
    order = np.lexsort((rank[b], -sims, a))
    a, b, sims = a[order], b[order], sims[order]
    first = np.searchsorted(a, a, side="left")
    keep = np.arange(len(a)) - first < k
    return a[keep], b[keep], sims[keep]


def tuned_factor(whole: DataFrame, router: VantageTree, queries: list[tuple[str, np.ndarray]], dims: int, k: int, leaf_rows: int, recall: float, most: float = 8.0) -> float:
    """The factor at which pruning still reaches a share ``recall`` of the sample queries' true neighbours.

    Every shard answers the queries by brute force and tells the bound at which each hit's leaf, or the
    shard, would be left out. A neighbour stays reachable while the factor is below its distance limit
    over that bound, so the wanted factor is a quantile of these ratios.
    """
    names = np.array([q for q, _ in queries])
    asked = unit_rows(pa.array([v.tolist() for _, v in queries], pa.list_(pa.float32())), dims)

    def run(t: pa.Table) -> pa.Table:
        data, reps = unit_rows(t["vector"], dims), t["rep"].to_numpy(zero_copy_only=False)
        tree = VantageTree(data, leaf_rows)
        leaf = np.empty(len(data), np.int64)
        for j, rows in enumerate(tree.rows):
            leaf[rows] = j
        low, far = tree.least(asked), router.least(asked)[:, t["leaf"][0].as_py()]
        sims = asked @ data.T
        sims[reps[None, :] == names[:, None]] = -3
        top = np.argsort(-sims, axis=1)[:, :k]
        q = np.repeat(np.arange(len(names)), top.shape[1])
        hit = sims[q, top.ravel()] > -2
        bound = np.maximum(low[q, leaf[top.ravel()]], far[q])
        return pa.table({"q": pa.array(q[hit], pa.int32()), "sim": pa.array(sims[q, top.ravel()][hit]), "low": pa.array(bound[hit])})

    every = whole.groupBy("slot").applyInArrow(run, "q int, sim double, low double")
    # At most k rows a query come to the driver.
    best = every.withColumn("at", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "low"))).where(F.col("at") <= k).toPandas()
    if best.empty:
        return 1.0
    limit = chord(best.groupby("q")["sim"].transform("min").to_numpy())
    ratio = limit / np.maximum(best["low"].to_numpy() - SLACK, 1e-9)
    return float(np.clip(np.quantile(ratio, 1 - recall), 1.0, most))


ROWS = pa.schema([("slot", pa.int32()), ("kind", pa.int8()), ("rep", pa.string()), ("vector", pa.list_(pa.float32())), ("reach", pa.float64()), ("c", pa.list_(pa.string())), ("sim", pa.list_(pa.float64()))])
ROWS_SQL = "slot int, kind tinyint, rep string, vector array<float>, reach double, c array<string>, sim array<double>"
#: Kinds of rows on their way to a shard, in the order in which it takes them.
DATA, QUERY, RESULT = 0, 1, 2


class Shards:
    """Where vectors live and which shards a query visits; shared by the search's tasks, bounded by the routing tree's leaves."""

    def __init__(self, router: VantageTree, dims: int, k: int, leaf_rows: int):
        self.router, self.dims, self.k, self.leaf_rows, self.relax = router, dims, k, leaf_rows, 1.0
        self.first = self.splits = np.zeros(len(router.paths), np.int64)

    def size(self, counts: dict[int, int], most: int) -> None:
        """A leaf is a shard; one of more than ``most`` rows becomes several, cut by hash."""
        self.splits = np.array([math.ceil(counts.get(j, 0) / most) for j in range(len(self.router.paths))], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.splits)[:-1]])
        self.slots = int(self.splits.sum())

    def place(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(rep, vector, hash) to (rep, vector, leaf, slot)."""
        for b in batches:
            leaf = self.router.leaf_of(unit_rows(b["vector"], self.dims)) if b.num_rows else np.zeros(0, np.int32)
            slot = self.first[leaf] + b["hash"].to_numpy() % np.maximum(self.splits[leaf], 1)
            yield pa.RecordBatch.from_arrays([b["rep"], b["vector"], pa.array(leaf, pa.int32()), pa.array(slot, pa.int32())], names=["rep", "vector", "leaf", "slot"])

    def spans(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per leaf the number of its vectors (``at`` = -1) and the interval of distances to each vantage point of its path."""
        seen: dict[tuple[int, int], tuple[float, float, int]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            unit = unit_rows(b["vector"], self.dims)
            leaf = self.router.leaf_of(unit)
            for j in np.unique(leaf):
                mine = unit[leaf == j]
                lo, hi = self.router.interval(mine, self.router.paths[j])
                for p, x, y, n in zip([-1, *self.router.paths[j]], [0.0, *lo], [0.0, *hi], [len(mine)] + [0] * len(lo), strict=True):
                    was = seen.get((int(j), p), (9.0, 0.0, 0))
                    seen[int(j), p] = min(was[0], float(x)), max(was[1], float(y)), was[2] + n
        rows = [{"leaf": j, "at": p, "lo": lo, "hi": hi, "n": n} for (j, p), (lo, hi, n) in seen.items()]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("leaf", pa.int32()), ("at", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("n", pa.int64())]))

    def _results(self, slot: int, asked: np.ndarray, names: np.ndarray, found: tuple) -> Iterator[pa.RecordBatch]:
        a, b, sims = found
        who, starts = np.unique(a, return_index=True)
        ends = np.append(starts[1:], len(a))
        for i in range(0, len(who), 10_000):
            w, s, e = who[i : i + 10_000], starts[i : i + 10_000], ends[i : i + 10_000]
            offsets = pa.array(np.append(s, e[-1]) - s[0], pa.int32())
            n = len(w)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, slot), pa.int32()), pa.array(np.full(n, RESULT), pa.int8()), pa.array(asked[w], pa.string()), pa.nulls(n, pa.list_(pa.float32())), pa.nulls(n, pa.float64()),
                pa.ListArray.from_arrays(offsets, pa.array(names[b[s[0] : e[-1]]], pa.string())), pa.ListArray.from_arrays(offsets, pa.array(sims[s[0] : e[-1]])),
            ], schema=ROWS)

    def home(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's vectors search each other; what they found, they themselves and the queries to other shards go on."""
        t = pa.Table.from_batches(batches) if (batches := [b for b in batches if b.num_rows]) else None
        if t is None:
            return
        slot, leaf = t["slot"][0].as_py(), t["leaf"][0].as_py()
        data, names = unit_rows(t["vector"], self.dims), t["rep"].to_numpy(zero_copy_only=False)
        n, rank = len(data), np.argsort(np.argsort(names))
        found = search(data, np.full(n, -2.0), np.arange(n), data, VantageTree(data, self.leaf_rows), self.k, self.relax, rank)
        yield from self._results(slot, names, names, found)
        if self.slots == 1:
            return
        counts, reach = np.bincount(found[0], minlength=n), np.full(n, -2.0)
        full = np.flatnonzero(counts == self.k)
        reach[full] = found[2][np.searchsorted(found[0], full, side="right") - 1]
        flat = t.select(["rep", "vector"]).combine_chunks()

        def rows(at: np.ndarray, to: np.ndarray, kind: int) -> pa.RecordBatch:
            took, m = flat.take(pa.array(at)).combine_chunks(), len(at)
            column = lambda c: took[c].combine_chunks() if isinstance(took[c], pa.ChunkedArray) else took[c]
            return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(np.full(m, kind), pa.int8()), column("rep"), column("vector").cast(pa.list_(pa.float32())), pa.array(reach[at]), pa.nulls(m, pa.list_(pa.string())), pa.nulls(m, pa.list_(pa.float64()))], schema=ROWS)

        for i in range(0, n, 10_000):
            at = np.arange(i, min(i + 10_000, n))
            yield rows(at, np.full(len(at), slot), DATA)
        for i in range(0, n, 1000):
            limit = chord(np.clip(reach[i : i + 1000] - ROUNDED, -1, 1))
            go = (self.router.least(data[i : i + 1000]) - SLACK) * self.relax < limit[:, None]
            q, to = np.nonzero(go)
            times = self.splits[to]
            q, to = np.repeat(q, times), np.repeat(self.first[to], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            away = to != slot
            for j in range(0, int(away.sum()), 10_000):
                yield rows(i + q[away][j : j + 10_000], to[away][j : j + 10_000], QUERY)

    def visit(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard takes its vectors, then answers the queries that stream past; results found at home go through."""
        mine: list[pa.RecordBatch] = []
        tree = None
        for b in batches:
            kind = b["kind"].to_numpy()
            mine.append(b.filter(pa.array(kind == DATA)))
            if (kind == QUERY).any():
                if tree is None:
                    t = pa.Table.from_batches(mine)
                    data, names = unit_rows(t["vector"], self.dims), t["rep"].to_numpy(zero_copy_only=False)
                    tree, rank = VantageTree(data, self.leaf_rows), np.argsort(np.argsort(names))
                    mine = []
                ask = b.filter(pa.array(kind == QUERY))
                reach = ask["reach"].to_numpy()
                found = search(unit_rows(ask["vector"], self.dims), reach, np.full(len(reach), -1), data, tree, self.k, self.relax, rank)
                yield from self._results(ask["slot"][0].as_py(), ask["rep"].to_numpy(zero_copy_only=False), names, found)
            if (kind == RESULT).any():
                yield b.filter(pa.array(kind == RESULT))


def nearest_neighbours(
    df: DataFrame, id_col: str, vector_col: str, k: int = 5, relax: float | None = None, dims: int = 64, recency: str | None = None,
    shard_rows: int = 50_000, leaf_rows: int = 256, fit_rows: int = 20_000, recall: float = 0.98, tune_queries: int = 300,
) -> DataFrame:
    """For each id its ``k`` others of highest cosine: ``id``, ``neighbour``, ``similarity``, ``rank``.

    Similarities are rounded to nine decimals, ties go to the smaller id. ``relax`` is the factor by
    which a triangle-inequality bound is stretched before it is held against the distance of the
    k-th best so far; 1 is exact search. How much a factor loses depends on the vectors, so by default
    it is tuned: ``tune_queries`` vectors (a bounded sample, chosen by hash) are searched by brute force,
    and the factor is taken at which ``recall`` of their neighbours stay within reach.

    - A routing tree is fitted on at most ``fit_rows`` vectors or 64 a shard (the documented bound); all vectors
      are placed by it. A leaf is a shard, of about ``shard_rows`` vectors, fewer where that leaves cores idle;
      leaves that came out larger than twice that are split by hash into shards of their own.
    - Each shard is one task, builds its own tree and searches its own vectors. With the reach so gained they go, as
      queries, to each other shard that the bounds of the routing tree leave within reach. There they stream
      past the shard's vectors, which are the only thing a task holds.
    - Copies of one vector are searched once and then given to each other, so that a third of all
      rows being the same vector makes one query, not a hot shard. Copies are told by 128 bits of hashes.

    Rows with a null id or without ``dims`` finite numbers that aren't all zero take no part; of
    several usable rows of an id the newest by ``recency`` counts (ties: the greatest vector).
    Fewer than ``k`` others give fewer rows; an empty table gives none. Other columns are ignored.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "neighbours")
    v = F.col(vector_col)
    usable = (F.size(v) == dims) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    ready = df.where(F.col(id_col).isNotNull() & v.isNotNull()).where(usable)
    at = F.col(recency) if recency else F.lit(0)
    newest = ready.groupBy(F.col(id_col).cast("string").alias("id")).agg(F.max(F.struct(at.alias("t"), v.cast("array<float>").alias("vector"))).alias("m"))
    every = scratch.save(newest.select("id", F.col("m.vector").alias("vector"), F.xxhash64("m.vector").alias("a"), F.xxhash64(F.lit(1), "m.vector").alias("b")))
    n = every.count()
    if n == 0:
        return spark.createDataFrame([], "id string, neighbour string, similarity double, rank int")
    repeated = scratch.save(every.groupBy("a", "b").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).where("copies > 1").select("a", "b", "rep"))
    standing = every.join(repeated, ["a", "b"], "left").select("id", "vector", "rep")
    distinct = standing.where("rep is null or id = rep").select(F.col("id").alias("rep"), "vector", F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("hash"))
    copies = every.join(repeated, ["a", "b"]).select("rep", "id")
    # The first k + 1 of a group of copies are all that any query can need of it.
    first = copies.withColumn("at", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("at") <= k + 1).select("rep", "id")

    wanted = min(4096, max(math.ceil(n / shard_rows), min(spark.sparkContext.defaultParallelism, n // 2000), 1))
    fitted = max(fit_rows, 64 * wanted)
    sample = distinct.where(F.pmod("hash", F.lit(max(1, n // fitted))) == 0).orderBy("hash", "rep").limit(fitted)
    fit = unit_rows(sample.select("vector").toArrow()["vector"], dims)
    shards = Shards(VantageTree(fit, max(1, math.ceil(len(fit) / wanted))), dims, k, leaf_rows)
    seen = distinct.select("vector").mapInArrow(shards.spans, "leaf int, at int, lo double, hi double, n long").groupBy("leaf", "at").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    # One row per leaf and vantage point above it (at most 4096 leaves) comes to the driver, whatever the data's size.
    limits = {(r["leaf"], r["at"]): r for r in seen.collect()}
    router = shards.router
    router.bounds = [tuple(np.array([limits[j, p][side] if (j, p) in limits else unset for p in path]) for side, unset in (("lo", 9.0), ("hi", 0.0))) for j, path in enumerate(router.paths)]
    router.rows = []  # of the sample; not needed to route
    shards.size({j: r["n"] for (j, p), r in limits.items() if p == -1}, 2 * shard_rows)
    placed = distinct.mapInArrow(shards.place, "rep string, vector array<float>, leaf int, slot int")
    if relax is None:
        some = distinct.orderBy("hash", "rep").limit(tune_queries).select("rep", "vector").toArrow().to_pylist()
        relax = tuned_factor(placed, router, [(r["rep"], np.array(r["vector"], np.float32)) for r in some], dims, k, leaf_rows, recall)
    shards.relax = relax

    found = placed.repartitionById(shards.slots, "slot").mapInArrow(shards.home, ROWS_SQL)
    if shards.slots > 1:
        found = found.repartitionById(shards.slots, "slot").sortWithinPartitions("kind").mapInArrow(shards.visit, ROWS_SQL)
    near = found.select("rep", F.explode(F.arrays_zip("c", "sim")).alias("x")).select("rep", F.col("x.c").alias("c"), F.col("x.sim").alias("sim"))
    best_first = Window.partitionBy("rep").orderBy(F.desc("sim"), "c")
    near = near.withColumn("at", F.row_number().over(best_first)).where(F.col("at") <= k).drop("at")
    if repeated.isEmpty():
        lists = near.select(F.col("rep").alias("id"), "c", "sim")
    else:
        # A neighbour that has copies stands for them; copies of the query's own vector come first of all.
        wide = near.join(first.withColumnRenamed("rep", "c"), "c", "left").select("rep", F.coalesce("id", "c").alias("c"), "sim")
        own = first.select("rep", F.col("id").alias("c"), F.lit(1.0).alias("sim"))
        lists = wide.unionByName(own).withColumn("at", F.row_number().over(best_first)).where(F.col("at") <= k + 1).drop("at")
        asking = standing.select(F.coalesce("rep", "id").alias("rep"), "id")
        lists = asking.join(lists, "rep").where(F.col("id") != F.col("c")).select("id", "c", "sim")
    by_id = Window.partitionBy("id").orderBy(F.desc("sim"), "c")
    return lists.withColumn("rank", F.row_number().over(by_id)).where(F.col("rank") <= k).select("id", F.col("c").alias("neighbour"), F.col("sim").alias("similarity"), "rank")


def neighbour_pairs(neighbours: DataFrame) -> DataFrame:
    """Each unordered pair of which at least one is a neighbour of the other, once."""
    a, b = F.col("id"), F.col("neighbour")
    return neighbours.select(F.least(a, b).alias("wallet1"), F.greatest(a, b).alias("wallet2")).distinct()
