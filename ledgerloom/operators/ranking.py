"""Ranks and running sums within groups of any size.

A window over a hot group is one task. Here rows are sorted by range over all groups, so that a group
with a third of all rows spans a third of the partitions; each partition ranks its own stretch, and
the totals of earlier stretches (one row per partition and group) are added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.scratch import Scratch


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[Column], sums: dict[str, Column] | None = None) -> DataFrame:
    """Add ``rank`` (1.. within ``group`` by ``order``), ``size`` (of the group) and, by name, running sums and ``{name}_all``.

    ``order`` must be total for reproducible ranks. Null groups are a group, nulls sort first; running
    sums skip null values. Empty input gives no rows.
    """
    sums = sums or {}
    scratch = Scratch(df.sparkSession, "ranked")
    valued = df.select("*", *[v.alias(f"__v_{n}") for n, v in sums.items()])
    by_range = valued.repartitionByRange(*[F.col(g) for g in group], *order)
    stretch = scratch.save(by_range.withColumn("__at", F.spark_partition_id()))
    local = Window.partitionBy("__at", *group).orderBy(*order)
    running = local.rowsBetween(Window.unboundedPreceding, 0)
    parts = stretch.groupBy("__at", *group).agg(F.count("*").alias("__n"), *[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    earlier, whole = Window.partitionBy(*group).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*group)
    zero = F.lit(0)
    offsets = parts.select(
        F.col("__at").alias("o_at"), *[F.col(g).alias(f"o_{g}") for g in group],
        F.coalesce(F.sum("__n").over(earlier), zero).alias("__before"), F.sum("__n").over(whole).alias("size"),
        *[c for n in sums for c in (F.coalesce(F.sum(f"__t_{n}").over(earlier), zero).alias(f"__b_{n}"), F.sum(f"__t_{n}").over(whole).alias(f"{n}_all"))],
    )
    here = stretch.select(
        "*", F.row_number().over(local).alias("__r"), *[F.coalesce(F.sum(f"__v_{n}").over(running), zero).alias(f"__s_{n}") for n in sums]
    )
    same = here["__at"] == offsets["o_at"]
    for g in group:
        same &= here[g].eqNullSafe(offsets[f"o_{g}"])
    return here.join(offsets, same).select(
        *df.columns, (F.col("__r") + F.col("__before")).alias("rank"), "size",
        *[c for n in sums for c in ((F.col(f"__s_{n}") + F.col(f"__b_{n}")).alias(n), F.col(f"{n}_all"))],
    )


def quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> DataFrame:
    """One row with the array ``q``: interpolated quantiles of the values that aren't null, from distributed ranks; no row if there are none."""
    rows = ranked(df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("__x")), [], [F.col("__x")])
    at = [F.lit(float(p)) * (F.col("size") - 1) for p in shares]
    # Of each quantile the value at or below its place, and the share of the way to the next one.
    parts = []
    for i, a in enumerate(at):
        low, part = F.floor(a) + 1, a - F.floor(a)
        parts += [F.sum(F.when(F.col("rank") == low, F.col("__x") * (1 - part)).when(F.col("rank") == low + 1, F.col("__x") * part)).alias(f"q{i}")]
    near = rows.where(sum(((F.col("rank") - 1 - a) < 1).cast("int") * ((F.col("rank") - 1 - a) > -1).cast("int") for a in at) > 0)
    one = near.agg(*parts, F.count("*").alias("n")).where("n > 0")
    return one.select(F.array(*[f"q{i}" for i in range(len(shares))]).alias("q"))


def mean_ranks(df: DataFrame, group: Sequence[str], column: str, name: str) -> DataFrame:
    """Each value of ``column`` in its group once, with ``name``: the mean of the ranks that its rows take."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*group, column).agg(F.count("*").alias("__c"))
    placed = ranked(counts, group, [F.col(column)], {"__to": F.col("__c")})
    return placed.select(*group, column, (F.col("__to") - (F.col("__c") - 1) / 2).alias(name))
