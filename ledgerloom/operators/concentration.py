"""Concentration of holdings: one row per group from one pass of mergeable sums, ranks only where needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.numeric import logistic, safe_div
from ledgerloom.operators.ranking import ranked

#: Weights of the z-scores in the stability score.
STABILITY_WEIGHTS = {"hhi": -0.20, "gini": -0.20, "wdr": -0.25}


def snapshot_metrics(holders: DataFrame, group: str = "mint", key: str = "wallet", balance: str = "balance", top: int = 10) -> DataFrame:
    """Per group: ``holder_count``, ``supply``, ``hhi``, ``entropy`` (nats), ``gini``, ``wdr`` (share of the ``top`` largest).

    Balances that are null or not above zero are left out; a group without others gives no row. HHI and
    entropy are written as sums over balances (``ln S - sum(b ln b) / S``), so shares need no second
    pass; Gini is the rank form ``2 sum(i b) / (n S) - (n + 1) / n``.
    """
    b = F.col(balance)
    held = holders.where(b > 0).select(group, key, balance)
    order = ranked(held, [group], [F.col(balance), F.col(key)])
    sums = order.groupBy(group).agg(
        F.count("*").alias("n"), F.sum(b).alias("s"), F.sum(b * b).alias("sq"), F.sum(b * F.log(b)).alias("bl"), F.sum(b * F.col("rank")).alias("ib"),
        F.sum(F.when(F.col("rank") > F.col("size") - top, b)).alias("t"),
    )
    s, n = F.col("s"), F.col("n")
    return sums.select(
        group, n.alias("holder_count"), F.round(s, 6).alias("supply"), F.round(F.col("sq") / (s * s), 9).alias("hhi"),
        (F.round(F.log(s) - F.col("bl") / s, 6) + 0.0).alias("entropy"), (F.round(2 * F.col("ib") / (n * s) - (n + 1) / n, 6) + 0.0).alias("gini"),
        F.round(F.col("t") / s, 6).alias("wdr"),
    )


def fit_baseline(metrics: DataFrame, columns: list[str], by: str | None = None, least: int = 1) -> DataFrame:
    """Long table ``grp`` (null: all), ``metric``, ``mean``, ``std`` (population, 0 becomes 1), ``n``, by one rollup."""
    long = metrics.select(F.col(by).alias("grp") if by else F.lit(None).cast("string").alias("grp"), F.explode(
        F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("grp", "x.metric", "x.v")
    rows = long.where(F.col("v").isNotNull() & ~F.isnan("v"))
    parts = rows.rollup("metric", "grp") if by else rows.groupBy("metric", "grp")
    fitted = parts.agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.count("*").alias("n"))
    return fitted.where(F.col("metric").isNotNull() & ((F.col("n") >= least) | F.col("grp").isNull())).select(
        "grp", "metric", F.round("mean", 6).alias("mean"), F.round(F.when(F.col("std") > 0, F.col("std")).otherwise(1.0), 6).alias("std"), "n"
    )


def stability_scores(metrics: DataFrame, group: str = "mint") -> DataFrame:
    """z-scores of the metrics against all groups, and ``stability_score`` = 100 / (1 + exp(weighted z)).

    The weights are negative, so a more concentrated group scores higher; the formula is kept so.
    """
    every = metrics.agg(*[f(c).alias(f"{c}_{n}") for c in STABILITY_WEIGHTS for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))])
    joined = metrics.join(F.broadcast(every))  # one row of totals
    z = {c: (F.col(c) - F.col(f"{c}_mean")) / F.when(F.col(f"{c}_std") > 0, F.col(f"{c}_std")).otherwise(1.0) for c in STABILITY_WEIGHTS}
    raw = sum((w * z[c] for c, w in STABILITY_WEIGHTS.items()), F.lit(0.0))
    return joined.select(*metrics.columns, *[F.round(v, 5).alias(f"{c}_z") for c, v in z.items()], F.round(100 * logistic(-raw), 4).alias("stability_score"))


def checksums(holders: DataFrame, group: str = "mint", key: str = "wallet", balance: str = "balance", first: int = 100) -> DataFrame:
    """Per group a 16-digit SHA-256 of its size and its ``first`` keys with whole balances, in key order.

    The row limit is the definition of the checksum; it is pushed below the shuffle.
    """
    counts = holders.groupBy(group).agg(F.count("*").alias("n"))
    head = holders.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(key))).where(F.col("rn") <= first)
    texts = head.groupBy(group).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, F.floor(balance).alias("b")))), lambda x: F.concat(F.lit(":"), F.substring(x[key], 1, 8), F.lit(":"), x["b"].cast("string"))), "").alias("body")
    )
    return texts.join(counts, group).select(group, F.substring(F.sha2(F.concat(F.col(group), F.lit(":"), F.col("n").cast("string"), F.col("body")), 256), 1, 16).alias("checksum"))


def churn(before: DataFrame, after: DataFrame, group: str = "mint", key: str = "wallet") -> DataFrame:
    """Per group of ``before`` the share of its keys that ``after`` no longer has."""
    gone = before.join(after.select(group, key).distinct().withColumn("kept", F.lit(1)), [group, key], "left")
    return gone.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col("kept").isNull()).alias("exited")).select(
        group, "n", "exited", F.round(safe_div(F.col("exited"), F.col("n")), 6).alias("churn")
    )


def percentile_tiers(holders: DataFrame, group: str = "mint", key: str = "wallet", balance: str = "balance") -> DataFrame:
    """``percentile`` = 100 (n - rank) / n by falling balance (100 for a single holder) and its tier."""
    r = ranked(holders, [group], [F.desc(balance), F.col(key)])
    pct = F.when(F.col("size") == 1, 100.0).otherwise(100 * (F.col("size") - F.col("rank")) / F.col("size"))
    tier = F.when(pct >= 99, "ultra").when(pct >= 95, "mega").when(pct >= 90, "whale").when(pct >= 75, "large").otherwise("regular")
    return r.select(group, key, "rank", F.round(pct, 6).alias("percentile"), tier.alias("tier"))


def breadth(changes: DataFrame, who: str, item: str, time_col: str, amount: str) -> DataFrame:
    """Per entity over all its items: ``items``, ``active_days``, ``turnover``, the ``largest_share`` of one item in it and their ``hhi``."""
    a = F.abs(F.col(amount))
    per = changes.where(F.col(amount).isNotNull()).groupBy(who, item).agg(F.sum(a).alias("v"))
    days = changes.where(F.col(time_col).isNotNull()).select(who, F.col(time_col).cast("date").alias("d")).distinct().groupBy(who).agg(F.count("*").alias("active_days"))
    v = F.col("v")
    t = per.groupBy(who).agg(F.count("*").alias("items"), F.sum(v).alias("t"), F.max(v).alias("m"), F.sum(v * v).alias("q"))
    share = lambda x, y: F.round(F.when(y > 0, x / y).otherwise(0.0), 6)
    return t.join(days, who, "left").select(who, "items", "active_days", F.round("t", 2).alias("turnover"), share(F.col("m"), F.col("t")).alias("largest_share"), share(F.col("q"), F.col("t") * F.col("t")).alias("hhi"))
