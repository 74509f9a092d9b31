"""Fitted models whose training needs only sums, bounded samples, or one bounded series per key."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ledgerloom.functions.numeric import seconds, tidy
from ledgerloom.operators.arrays import WHOLE_EDGES, by_length, digests, numbered, principal
from ledgerloom.operators.graph import converged, shared_item_groups, undirected
from ledgerloom.operators.ranking import ranked
from ledgerloom.scratch import Scratch


def permutation_test(rows: DataFrame, key: str, ident: str, value: Column, replicates: int = 1000, most: int = 8_000_000) -> DataFrame:
    """Per key: mean of ``value``, its mean and deviation when values are dealt out anew, ``z`` and ``p`` (at least as large).

    A replicate orders all rows by a hash of (row, replicate) and gives the i-th value to the i-th row, so it
    is repeatable anywhere; the least ``p`` is 1 / (``replicates`` + 1). Up to ``most`` rows are handed whole to tasks, each of which deals some
    replicates; of more, ranks are distributed. What is aggregated per replicate is one row a key.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "permutation")
    base = scratch.save(rows.select(F.col(key).alias("k"), F.col(ident).cast("string").alias("i"), value.cast("double").alias("v")).where("k is not null and v is not null"))
    if base.count() <= most:
        null = _dealt_in_tasks(base, replicates)
    else:
        each = base.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
        slots = ranked(base.select("k", "i"), [], [F.col("i")]).select("rank", "k")
        dealt = ranked(each.select("rep", "i", "v"), ["rep"], [F.md5(F.concat_ws(":", "i", "rep")), F.col("i")]).select("rep", "rank", "v")
        null = slots.join(dealt, "rank").groupBy("rep", "k").agg(F.avg("v").alias("m"))
    seen = base.groupBy("k").agg(F.count("*").alias("n"), F.avg("v").alias("observed"))
    joined = null.join(seen, "k").groupBy("k").agg(
        F.first("n").alias("n"), F.first("observed").alias("observed"), F.avg("m").alias("expected"), F.stddev_pop("m").alias("sd"), F.count_if(F.col("m") >= F.col("observed")).alias("above"))
    z = F.when(F.col("sd") > 0, (F.col("observed") - F.col("expected")) / F.col("sd"))
    return joined.select(F.col("k").alias(key), "n", F.round("observed", 6).alias("observed"), F.round("expected", 6).alias("expected"), F.round(z, 4).alias("z"), F.round((F.col("above") + 1) / (replicates + 1), 6).alias("p"))


def _dealt_in_tasks(base: DataFrame, replicates: int) -> DataFrame:
    """(``rep``, ``k``, ``m``): the mean of what each key (``k``) is dealt of the values (``v``) in each replicate, by rows' names (``i``)."""
    spark = base.sparkSession
    t = base.select("i", "v", "k").toArrow().combine_chunks()
    t = t.take(pc.sort_indices(t, [("i", "ascending"), ("v", "ascending")], null_placement="at_start")).combine_chunks()
    kind = f"rep long, k {base.schema['k'].dataType.simpleString()}, m double"
    if not t.num_rows:
        return spark.createDataFrame([], kind)
    names, keys = t["i"].chunk(0), t["k"].chunk(0).dictionary_encode()
    none = names.null_count
    given = spark.sparkContext.broadcast((none, list(by_length(names[none:])), t["v"].to_numpy(), keys.indices.to_numpy(), keys.dictionary))

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none, texts, values, slots, keys = given.value
        n = np.bincount(slots)
        for part in parts:
            for rep in part.column(0).to_pylist():
                words = np.empty((4, len(values)), np.uint32)
                words[:, :none] = digests(np.frombuffer(str(rep).encode(), np.uint8)[None])
                for at, text in texts:
                    words[:, none + at] = digests(np.hstack([text, np.broadcast_to(np.frombuffer(f":{rep}".encode(), np.uint8), (len(text), len(str(rep)) + 1))]))
                high = words[0].astype(np.uint64) << np.uint64(32) | words[1]
                order = np.argsort(high)
                sorted_ = high[order]
                if (sorted_[1:] == sorted_[:-1]).any():
                    order = np.lexsort((words[3], words[2], high))
                yield pa.record_batch([pa.array(np.full(len(n), rep)), keys, pa.array(np.bincount(slots, weights=values[order]) / n)], ["rep", "k", "m"])

    tasks = min(replicates, 8 * spark.sparkContext.defaultParallelism)
    return spark.range(1, replicates + 1, 1, tasks).mapInArrow(deal, kind)


def synchronised_groups(rows: DataFrame, item: str, who: str, time_col: str, tie: str, gap_s: float = 300.0, least: int = 2) -> DataFrame:
    """(``who``, ``group``): entities linked by acting in the same run of an item at least ``least`` times.

    A run is a gap session of the item. Entities act together ``least`` times if they share that many runs, which
    ``shared_item_groups`` resolves.
    """
    scratch, width = Scratch(rows.sparkSession, "runs"), max(int(gap_s * 1_000_000), 1)
    # Times of one bucket as wide as the gap are of one run, so runs are told by the buckets' first and last times.
    t = F.unix_micros(F.col(time_col).cast("timestamp"))
    timed = rows.select(F.col(item).alias("item"), F.col(who).alias("who"), t.alias("t")).where("t is not null and item is not null and who is not null")
    acts = scratch.save(timed.groupBy("item", "who", F.floor(F.col("t") / width).alias("bucket")).agg(F.min("t").alias("a"), F.max("t").alias("z")))
    buckets = scratch.save(acts.groupBy("item", "bucket").agg(F.min("a").alias("a"), F.max("z").alias("z")).withColumn("id", F.monotonically_increasing_id()))
    along = Window.partitionBy("item").orderBy("bucket")  # an item's buckets are bounded by the calendar
    opened = buckets.withColumn("o", F.when(F.coalesce(F.col("a") - F.lag("z").over(along) > gap_s * 1_000_000, F.lit(True)), F.col("id")))
    run = opened.select("item", "bucket", F.last("o", ignorenulls=True).over(along).alias("run"))
    return shared_item_groups(acts.join(run, ["item", "bucket"]).select(F.col("who").alias(who), "run"), who, "run", least)


def eigenvector(edges: DataFrame, tolerance: float = 1e-8, rounds: int = 20_000) -> DataFrame:
    """(``node``, ``centrality``) of an undirected graph by power iteration on A + I, length one; iterated until it settles.

    Up to ``WHOLE_EDGES`` pairs one task iterates over arrays; beyond, each round is a join and a sum.
    """
    scratch = Scratch(edges.sparkSession, "eigenvector")
    e = scratch.save(undirected(edges, "u", "v"))
    if e.count() <= WHOLE_EDGES:
        def iterate(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if found := list(parts):
                names, u, v = numbered(pa.Table.from_batches(found))
                x = principal(len(names), u, v, tolerance, rounds)
                yield pa.record_batch([names, pa.array(np.full(len(names), np.nan) if x is None else x)], ["node", "x"])

        told = Observation()
        state = scratch.save(e.coalesce(1).mapInArrow(iterate, f"node {e.schema['u'].dataType.simpleString()}, x double").observe(told, F.count_if(F.isnan("x")).alias("n")))
        if told.get["n"]:
            raise RuntimeError(f"no convergence within {rounds} rounds")
        return state.select("node", F.round("x", 6).alias("centrality"))
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = scratch.save(both.unionByName(both.select("u", F.col("u").alias("v")).distinct()))
    nodes = scratch.save(linked.select(F.col("u").alias("node")).distinct().withColumn("x", F.lit(1.0)))

    def step(state: DataFrame) -> DataFrame:
        return linked.join(state.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.sum("x").alias("x"))

    def unit(state: DataFrame) -> DataFrame:
        norm = state.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
        return state.join(F.broadcast(norm)).select("node", (F.col("x") / F.col("n")).alias("x"))  # one row

    state = converged(scratch, nodes, step, tolerance, rounds, scaled=True)
    return unit(state).select("node", F.round("x", 6).alias("centrality"))


def kmeans(rows: DataFrame, key: str, vector: str, k: int, seed: int = 42) -> DataFrame:
    """(``key``, ``cluster``, ``silhouette``): k-means by cosine, and each row's simplified silhouette (distances to centres)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ready = rows.select(key, F.transform(F.col(vector), lambda x: x.cast("double")).alias("a")).where(F.exists("a", lambda x: x != 0))
    data = ready.withColumn("features", array_to_vector("a"))
    model = KMeans(k=k, seed=seed, distanceMeasure="cosine", maxIter=20).fit(data)
    centres = [c / max(np.linalg.norm(c), 1e-12) for c in model.clusterCenters()]
    norm = F.sqrt(F.aggregate("a", F.lit(0.0), lambda s, x: s + x * x))
    distances = F.array(*[1 - F.aggregate(F.zip_with("a", F.array(*[F.lit(float(x)) for x in c]), lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x) / norm for c in centres])
    d = model.transform(data).select(key, F.col("prediction").alias("cluster"), F.array_sort(distances).alias("d"))
    own, other = F.col("d")[0], F.col("d")[1]
    return d.select(key, "cluster", F.round(F.when(F.greatest(own, other) > 0, (other - own) / F.greatest(own, other)).otherwise(0.0), 6).alias("silhouette"))


def isotonic(pred: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """The isotonic calibration curve in steps: ``p_from``, ``p_to``, ``n``, ``calibrated``; probabilities are taken as they are.

    Rows are pooled by probability, sorted by range, and adjacent violators are pooled within each partition as its rows stream by;
    the blocks left are pooled once more in one task, which then holds the steps of all partitions. Their number grows with about the cube root of the rows where outcomes are noisy.
    """
    def pool(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: list[list[float]] = []  # from, to, rows, sum
        for f in frames:
            for row in f[["a", "z", "n", "k"]].itertuples(index=False):
                done.append(list(row))
                while len(done) > 1 and done[-2][3] * done[-1][2] >= done[-1][3] * done[-2][2]:
                    _, z, n, k = done.pop()
                    done[-1] = [done[-1][0], z, done[-1][2] + n, done[-1][3] + k]
        yield pd.DataFrame(done, columns=["a", "z", "n", "k"])

    schema = "a double, z double, n long, k double"
    q = F.col(p).cast("double")
    points = pred.where(q.between(0, 1) & F.col(y).isNotNull()).groupBy(q.alias("a")).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("double")).alias("k"))
    some = points.select("a", F.col("a").alias("z"), "n", "k").repartitionByRange("a").sortWithinPartitions("a").mapInPandas(pool, schema)
    whole = some.repartition(1).sortWithinPartitions("a").mapInPandas(pool, schema)
    return whole.select(F.col("a").alias("p_from"), F.col("z").alias("p_to"), "n", F.round(F.col("k") / F.col("n"), 6).alias("calibrated"))


def recent_brier(pred: DataFrame, by: str, time_col: str, tie: str, p: str = "p", y: str = "y", last: int = 1000) -> DataFrame:
    """Brier score of each group's last ``last`` predictions; the limit is the tracker's definition and reaches the map side."""
    rows = pred.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    w = Window.partitionBy(by).orderBy(F.desc(time_col), F.desc(tie), F.desc(p), F.desc(y))
    kept = rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= last)
    return kept.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(F.pow(F.col(p) - F.col(y), 2)), 6).alias("brier"))


def walk_forward(rows: DataFrame, time_col: str, folds: int = 5, gap_days: int = 1) -> DataFrame:
    """Time-ordered folds: ``fold``, ``train``, ``test`` counts and the test span; training ends ``gap_days`` before its test begins."""
    span = rows.agg(F.min(seconds(F.col(time_col))).alias("a"), F.max(seconds(F.col(time_col))).alias("b"))
    placed = rows.where(F.col(time_col).isNotNull()).join(F.broadcast(span))  # one row
    s = seconds(F.col(time_col))
    part = F.when(F.col("b") > F.col("a"), F.least(F.floor((s - F.col("a")) * (folds + 1) / (F.col("b") - F.col("a"))), F.lit(folds))).otherwise(F.lit(0))
    per = placed.withColumn("part", part)
    edge = lambda i: F.col("a") + (F.col("b") - F.col("a")) * i / (folds + 1)
    out = []
    for i in range(1, folds + 1):
        out += [F.count_if(s < edge(i) - gap_days * 86_400).alias(f"train_{i}"), F.count_if(F.col("part") == i).alias(f"test_{i}")]
    one = per.agg(*out)
    return one.select(F.explode(F.array(*[F.struct(F.lit(i).alias("fold"), F.col(f"train_{i}").alias("train"), F.col(f"test_{i}").alias("test")) for i in range(1, folds + 1)])).alias("x")).select("x.*")


def conjugate_updates(rows: DataFrame, by: str, value: str, mean0: float = 0.0, weight0: float = 1.0, shape0: float = 2.0, rate0: float = 2.0) -> DataFrame:
    """Normal-gamma posterior of a group's values: ``n``, ``mean``, ``weight``, ``shape``, ``rate`` and the expected deviation, from three sums."""
    v = F.col(value)
    t = rows.where(v.isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("s2"))
    n, w = F.col("n"), F.lit(weight0)
    rate = rate0 + n * F.col("s2") / 2 + w * n * F.pow(F.col("m") - mean0, 2) / (2 * (w + n))
    shape = shape0 + n / 2
    return t.select(by, "n", F.round((w * mean0 + n * F.col("m")) / (w + n), 6).alias("mean"), (w + n).alias("weight"), shape.alias("shape"), F.round(rate, 4).alias("rate"), F.round(F.sqrt(rate / (shape - 1)), 6).alias("deviation"))


def hidden_regimes(days: DataFrame, by: str, value: str, states: int = 3, rounds: int = 25) -> DataFrame:
    """(``by``, ``day``, ``regime``): a Gaussian hidden Markov model per key, states ordered by mean, decoded by Viterbi.

    One key's series is one row a day, bounded by the calendar, and becomes one pandas frame.
    """
    kind = days.schema[by].dataType.simpleString()

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values("day")
        x = f["v"].to_numpy(float)
        n = len(x)
        if n < 2 * states or x.std() == 0:
            return pd.DataFrame({by: f["k"], "day": f["day"], "regime": np.zeros(n, np.int32)})
        mu = np.quantile(x, (np.arange(states) + 0.5) / states)
        sd = np.full(states, x.std())
        a, start = np.full((states, states), 0.1 / (states - 1)) + np.eye(states) * (0.9 - 0.1 / (states - 1)), np.full(states, 1 / states)

        def likelihood() -> np.ndarray:
            return np.exp(-0.5 * ((x[:, None] - mu) / sd) ** 2) / sd + 1e-300

        for _ in range(rounds):
            b = likelihood()
            alpha, scale, beta = np.zeros((n, states)), np.zeros(n), np.ones((n, states))
            for t in range(n):
                alpha[t] = (start if t == 0 else alpha[t - 1] @ a) * b[t]
                scale[t] = alpha[t].sum()
                alpha[t] /= scale[t]
            for t in range(n - 2, -1, -1):
                beta[t] = a @ (b[t + 1] * beta[t + 1]) / scale[t + 1]
            g = alpha * beta
            g /= g.sum(axis=1, keepdims=True)
            xi = np.zeros((states, states))
            for t in range(n - 1):
                xi += np.outer(alpha[t], b[t + 1] * beta[t + 1]) * a / scale[t + 1]
            start, a = g[0], (xi + 1e-6) / (xi + 1e-6).sum(axis=1, keepdims=True)
            mu = (g * x[:, None]).sum(axis=0) / g.sum(axis=0)
            sd = np.maximum(np.sqrt((g * (x[:, None] - mu) ** 2).sum(axis=0) / g.sum(axis=0)), 1e-3 * x.std())
        b, la = np.log(likelihood()), np.log(a)
        score, back = np.log(start + 1e-300) + b[0], np.zeros((n, states), int)
        for t in range(1, n):
            step = score[:, None] + la
            back[t] = step.argmax(axis=0)
            score = step.max(axis=0) + b[t]
        path = np.zeros(n, int)
        path[-1] = score.argmax()
        for t in range(n - 1, 0, -1):
            path[t - 1] = back[t, path[t]]
        rank = np.argsort(np.argsort(mu))
        return pd.DataFrame({by: f["k"], "day": f["day"], "regime": rank[path].astype(np.int32)})

    rows = days.select(F.col(by).alias("k"), "day", F.col(value).cast("double").alias("v")).where("v is not null")
    return rows.groupBy("k").applyInPandas(fit, f"`{by}` {kind}, day date, regime int")


def isolation_scores(rows: DataFrame, key: str, features: Sequence[str], trees: int = 50, sample: int = 256, seed: int = 42) -> DataFrame:
    """(``key``, ``anomaly``): isolation-forest score in (0, 1), larger for rows that few random cuts set apart.

    Trees are grown on samples of ``sample`` rows each (``trees`` * ``sample`` rows in all, the documented bound),
    chosen by hash; every row is scored, in vectorised batches. Nulls count as zero.
    """
    clean = rows.select(F.col(key), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])
    chosen = clean.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(trees * sample).toPandas()[list(features)].to_numpy(float)
    rng = np.random.default_rng(seed)
    harmonic = lambda n: 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def grow(x: np.ndarray, depth: int):
        spread = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) else []
        if len(x) <= 1 or depth <= 0 or not len(spread):
            return harmonic(len(x))
        j = int(rng.choice(spread))
        cut = float(rng.uniform(x[:, j].min(), x[:, j].max()))
        return j, cut, grow(x[x[:, j] < cut], depth - 1), grow(x[x[:, j] >= cut], depth - 1)

    forest = [grow(chosen[rng.integers(0, len(chosen), min(sample, len(chosen)))], int(np.ceil(np.log2(sample)))) for _ in range(trees)] if len(chosen) else []
    norm = max(harmonic(min(sample, len(chosen))), 1e-9)

    def depths(tree, x: np.ndarray, at: np.ndarray, level: int, out: np.ndarray) -> None:
        if not isinstance(tree, tuple):
            out[at] += level + tree
        elif len(at):
            left = x[at, tree[0]] < tree[1]
            depths(tree[2], x, at[left], level + 1, out)
            depths(tree[3], x, at[~left], level + 1, out)

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        x = np.stack([c.to_numpy(float) for c in columns], axis=1)
        total = np.zeros(len(x))
        for t in forest:
            depths(t, x, np.arange(len(x)), 0, total)
        return pd.Series(np.round(2.0 ** (-total / max(len(forest), 1) / norm), 6))

    return clean.select(key, score(*features).alias("anomaly"))


def evolution(changes: DataFrame, key: str, time_col: str, amount: str, step_days: int = 30) -> DataFrame:
    """State of each key on a grid of days: ``day``, ``position`` and ``active`` entities with rows so far (per key)."""
    days = changes.where(F.col(time_col).isNotNull()).groupBy(key, F.col(time_col).cast("date").alias("d")).agg(F.sum(amount).alias("net"), F.count("*").alias("n"))
    span = days.agg(F.min("d").alias("a"), F.max("d").alias("b"))
    grid = days.join(F.broadcast(span))  # one row
    # A day's change reaches every later grid day; folding to grid steps first bounds the rows by the grid.
    slot = F.ceil(F.datediff("d", "a") / step_days)
    steps = grid.groupBy(key, slot.alias("slot"), "a", "b").agg(F.sum("net").alias("net"), F.sum("n").alias("n"))
    w = Window.partitionBy(key).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    run = steps.select(key, "slot", "a", F.round(F.sum("net").over(w), 2).alias("position"), F.sum("n").over(w).alias("rows"), F.coalesce(F.lead("slot").over(Window.partitionBy(key).orderBy("slot")) - 1, F.ceil(F.datediff("b", "a") / step_days)).alias("until"))
    return run.withColumn("slot", F.explode(F.sequence("slot", "until"))).select(key, F.date_add("a", (F.col("slot") * step_days).cast("int")).alias("day"), (F.col("position") + 0.0).alias("position"), "rows")



def random_projection(rows: DataFrame, key: str, vector: str, dims: int, size: int, seed: int = 42) -> DataFrame:
    """(``key``, ``axis``, ``x``): vectors of ``dims`` numbers on ``size`` axes of random signs (by hash), scaled so that distances keep their mean."""
    signs = np.array([[1.0 if int(md5(f"{i}:{j}:{seed}".encode()).hexdigest()[:8], 16) % 2 else -1.0 for i in range(dims)] for j in range(size)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64)
            out = x @ signs.T / math.sqrt(size)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, size), pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[key, "v"])

    kind = rows.schema[key].dataType.simpleString()
    projected = rows.where(F.size(vector) == dims).select(key, F.col(vector).cast("array<double>")).mapInArrow(run, f"`{key}` {kind}, v array<double>")
    return projected.select(key, F.posexplode("v").alias("axis", "x")).select(key, "axis", tidy("x", 6).alias("x"))


def trend_forecast(days: DataFrame, by: str, value: str, window: int = 14) -> DataFrame:
    """Per key the line through its last ``window`` days: ``points``, ``slope``, ``next_value`` (of the day after the last; null below two points) and ``r2``."""
    w = Window.partitionBy(by).orderBy(F.desc("day"))  # one row a day
    end = Window.partitionBy(by)
    last = days.withColumn("i", F.row_number().over(w)).withColumn("end", F.max("day").over(end)).where(F.col("i") <= window)
    x, y = -F.datediff("end", "day").cast("double"), F.col(value).cast("double")
    t = last.groupBy(by).agg(F.count("*").alias("points"), F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"), F.regr_r2(y, x).alias("r2"))
    return t.select(by, "points", F.round("b", 6).alias("slope"), F.round(F.col("a") + F.col("b"), 4).alias("next_value"), F.round("r2", 6).alias("r2"))


def gamma_rates(rows: DataFrame, by: str, time_col: str, shape0: float = 1.0, rate0: float = 1.0) -> DataFrame:
    """Gamma posterior of each group's events a day over the span of the whole table: ``n``, ``shape``, ``rate``, ``mean``, ``deviation``."""
    s = seconds(F.col(time_col))
    span = rows.agg(((F.max(s) - F.min(s)) / 86_400).alias("days"))
    t = rows.where(F.col(time_col).isNotNull()).groupBy(by).agg(F.count("*").alias("n")).join(F.broadcast(span))  # one row
    a, b = shape0 + F.col("n"), rate0 + F.col("days")
    return t.select(by, "n", a.alias("shape"), F.round(b, 6).alias("rate"), F.round(a / b, 6).alias("mean"), F.round(F.sqrt(a) / b, 6).alias("deviation"))
