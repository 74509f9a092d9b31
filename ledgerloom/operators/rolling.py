"""Totals and averages over trailing periods, for every calendar day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, key: str, recency: str, keep: Sequence[str]) -> DataFrame:
    """Of each ``key`` the row with the greatest ``recency`` (nulls lowest; ties by the greatest kept values)."""
    best = F.max(F.struct(F.col(recency).alias("r"), *[F.col(c).alias(f"c_{i}") for i, c in enumerate(keep)]))
    return df.groupBy(F.col(key).alias("key")).agg(best.alias("b")).select(
        F.col("key").alias(key), *[F.col(f"b.c_{i}").alias(c) for i, c in enumerate(keep)]
    )


def trailing_totals(df: DataFrame, entity: str, time_col: str, amount: str, periods: Sequence[int] = (7, 30)) -> DataFrame:
    """For each entity and each day from its first to its last activity: ``total_N`` and ``avg_N``.

    ``total_N`` sums the day and the N-1 days before, rounded to two decimals; ``avg_N`` divides it
    by N, days without activity and days before the first one counting as zero. Rows whose time or
    amount is null or NaN are left out; a null entity is an entity. Empty input gives no rows.

    Daily totals are formed first, with partial aggregation, so that an entity has no more rows
    than days whatever its number of transactions. They are placed by entity once; in that placing
    each total is exploded onto every date that it influences, each day up to the next active one
    adds a calendar row of zero, and one grouped sum joins the two. Only contributions up to the
    entity's last day are made.
    """
    longest = max(periods)
    amt = F.col(amount).cast("double")
    daily = (
        df.where(F.col(time_col).isNotNull() & amt.isNotNull() & ~F.isnan(amt))
        .groupBy(F.col(entity).alias("entity"), F.col(time_col).cast("date").alias("day"))
        .agg(F.sum(amt).alias("total"))
        .repartition("entity")
    )
    whole = Window.partitionBy("entity")
    placed = daily.select(
        "entity", "day", "total", F.max("day").over(whole).alias("last"),
        F.lead("day").over(whole.orderBy("day")).alias("following"),
    )
    # Offsets 0..longest-1 carry the total; later offsets, up to the next active day, only the calendar's zero.
    reach = F.datediff("last", "day")
    until = F.least(reach, F.greatest(F.lit(longest - 1), F.coalesce(F.datediff("following", "day") - 1, F.lit(0))))
    spread = placed.select("entity", "day", "total", F.explode(F.sequence(F.lit(0), until)).alias("ahead"))
    sums = spread.groupBy("entity", F.date_add("day", F.col("ahead")).alias("day")).agg(
        *[F.round(F.sum(F.when(F.col("ahead") < n, F.col("total")).otherwise(0.0)), 2).alias(f"total_{n}") for n in periods]
    )
    # Adding 0.0 turns a rounded -0.0 into 0.0.
    return sums.select(
        F.col("entity").alias(entity), "day",
        *[c for n in periods for c in ((F.col(f"total_{n}") + 0.0).alias(f"total_{n}"), F.round(F.col(f"total_{n}") / n + 0.0, 6).alias(f"avg_{n}"))],
    )


def peak_days(totals: DataFrame, entity: str, periods: Sequence[int] = (7, 30)) -> DataFrame:
    """For each entity and period the first day on which the trailing total is highest."""
    best = [
        F.max(F.struct(F.col(f"total_{n}").alias("total"), (-F.datediff("day", F.lit("1970-01-01").cast("date"))).alias("back"))).alias(f"b_{n}")
        for n in periods
    ]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"b_{n}").alias("b")) for n in periods]))
    return totals.groupBy(entity).agg(*best).select(entity, each.alias("x")).select(
        entity, F.col("x.n").alias("trailing_days"),
        F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), -F.col("x.b.back")), "yyyy-MM-dd").alias("peak_day"),
    )


def counted_transactions(tx: DataFrame) -> DataFrame:
    """Of each signature the row with the newest ``cached_at`` (a null signature is none and keeps no row)."""
    return latest_by(
        tx.where(F.col("signature").isNotNull()), "signature", "cached_at", ["block_time", "wallet_address", "amount_change"]
    )
