"""Differences between consecutive full snapshots of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_S = 3600


def trim_space(c: Column) -> Column:
    """Without surrounding white space of any kind (``trim`` alone drops only blanks)."""
    return F.regexp_replace(c, r"^[\s\p{Z}\x{85}\x{1C}-\x{1F}]+|[\s\p{Z}\x{85}\x{1C}-\x{1F}]+$", "")


def number_deliveries(df: DataFrame, time_col: str, gap_hours: int = 12) -> DataFrame:
    """Add ``snapshot_no`` (from 1, in time order) and ``is_last`` to rows delivered in batches.

    Rows with no gap of ``gap_hours`` or more between them form one delivery. A gap of a whole hour
    or more can't lie inside one clock hour, so the gaps are found on a table of one row per clock
    hour that has any row (8 760 a year however many rows are delivered), which is also all that
    the one unpartitioned window sees and all that is broadcast. Rows without a time belong to no
    delivery and are left out. ``gap_hours`` must be at least 1.
    """
    if gap_hours < 1:
        raise ValueError("gap_hours must be at least 1")
    us = F.unix_micros(F.col(time_col).cast("timestamp"))
    rows = df.where(F.col(time_col).isNotNull()).withColumn("__hour", F.floor(us / (HOUR_S * 1_000_000)).cast("long"))
    hours = rows.groupBy("__hour").agg(F.min(us).alias("lo"), F.max(us).alias("hi"))
    in_time = Window.orderBy("__hour")
    starts = F.coalesce(F.col("lo") - F.lag("hi").over(in_time) >= gap_hours * HOUR_S * 1_000_000, F.lit(True))
    numbered = (
        hours.withColumn("starts", starts.cast("int"))
        .withColumn("snapshot_no", F.sum("starts").over(in_time.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
        .withColumn("is_last", F.col("snapshot_no") == F.max("snapshot_no").over(Window.partitionBy()))
        .select("__hour", "snapshot_no", "is_last")
    )
    return rows.join(F.broadcast(numbered), "__hour").drop("__hour")


def diff_snapshots(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], time_col: str, tie_col: str | None = None,
    gap_hours: int = 12, tolerance: float = 1e-9,
) -> DataFrame:
    """Records added, removed or changed between each delivery and the one before.

    Returns ``snapshot_no`` (the later delivery), the keys, ``change_kind`` and ``changed_fields``
    (sorted names, empty unless ``changed``).

    Each record becomes signed cells (key, field, value): plus for its own delivery, minus for the
    next, with one cell more that only marks the key's presence. Grouped by key and field, a sum
    that isn't zero is a difference, and the sum of the markers (+1, -1, 0) tells added, removed
    and kept records apart. Numbers cancel if they differ by no more than ``tolerance`` of the
    larger one; other types cancel by exact equality.

    Within a delivery the record with the greatest ``time_col`` (then ``tie_col``, then values)
    counts. Nulls: a null key component is a key like any other; null and NaN values are one value,
    unlike any number. Zero is a value. Empty input and single deliveries give no rows. Columns of
    other names are ignored.

    One key is bounded by the number of deliveries after the first step, whose partial aggregation
    folds repeated rows before the shuffle. All groupings after it run on one partitioning by key.
    """
    base = number_deliveries(df, time_col, gap_hours)
    numeric = {c for c, t in df.dtypes if c in values and t in ("double", "float", "int", "bigint", "smallint", "tinyint")}
    # Signed sums of doubles give the difference; other values are counted by what they hold.
    typed = [
        (F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) if c in numeric else F.col(c).cast("string")).alias(f"v_{i}")
        for i, c in enumerate(values)
    ]
    recency = [F.col(time_col).alias("t"), *([F.col(tie_col).alias("tie")] if tie_col else []), *typed]
    latest = (
        base.groupBy("snapshot_no", "is_last", *[F.col(k).alias(f"k_{i}") for i, k in enumerate(keys)])
        .agg(F.max(F.struct(*recency)).alias("r"))
        .select("snapshot_no", "is_last", *[f"k_{i}" for i in range(len(keys))], *[f"r.v_{i}" for i in range(len(values))])
    )
    key_cols = [f"k_{i}" for i in range(len(keys))]
    placed = latest.repartition(*key_cols)

    def cell(field: str, number: Column, other: Column) -> Column:
        return F.struct(F.lit(field).alias("field"), number.alias("number"), other.alias("other"))

    none_num, none_str = F.lit(None).cast("double"), F.lit(None).cast("string")
    cells = [cell("", F.lit(1.0), none_str)] + [
        cell(c, F.col(f"v_{i}"), F.when(F.col(f"v_{i}").isNull(), "null")) if c in numeric
        else cell(c, none_num, F.coalesce(F.concat(F.lit("="), F.col(f"v_{i}")), F.lit("null")))
        for i, c in enumerate(values)
    ]
    sides = F.when(F.col("is_last"), F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(-1)))
    signed = (
        placed.withColumn("sign", F.explode(sides))
        .withColumn("pair", F.col("snapshot_no") + F.when(F.col("sign") > 0, 0).otherwise(1))
        .where(F.col("pair") > 1)
        .select("pair", *key_cols, "sign", F.explode(F.array(*cells)).alias("c"))
    )
    s, n = F.col("sign"), F.col("c.number")
    fields = signed.groupBy(*key_cols, "pair", F.col("c.field").alias("field")).agg(
        F.sum(s).alias("presence"), F.sum(s * n).alias("delta"), F.max(F.abs(n)).alias("scale"),
        F.sum(F.when(n.isNotNull(), s)).alias("numbers"),
        F.max(F.when(s > 0, F.col("c.other"))).alias("now"), F.max(F.when(s < 0, F.col("c.other"))).alias("before"),
    )
    differs = (
        (F.coalesce(F.col("numbers"), F.lit(0)) != 0)
        | (F.abs(F.coalesce(F.col("delta"), F.lit(0.0))) > tolerance * F.coalesce(F.col("scale"), F.lit(0.0)))
        | ~F.col("now").eqNullSafe(F.col("before"))
    )
    marker = F.col("field") == ""
    kinds = fields.groupBy(*key_cols, "pair").agg(
        F.max(F.when(marker, F.col("presence"))).alias("mark"),
        F.sort_array(F.collect_list(F.when(~marker & differs, F.col("field")))).alias("fields"),
    )
    kind = F.when(F.col("mark") > 0, "added").when(F.col("mark") < 0, "removed").when(F.size("fields") > 0, "changed")
    return (
        kinds.withColumn("change_kind", kind)
        .where(F.col("change_kind").isNotNull())
        .select(
            F.col("pair").alias("snapshot_no"), *[F.col(f"k_{i}").alias(k) for i, k in enumerate(keys)], "change_kind",
            F.when(F.col("change_kind") == "changed", F.col("fields")).otherwise(F.array().cast("array<string>")).alias("changed_fields"),
        )
    )


def holding_changes(balances: DataFrame, gap_hours: int = 12, tolerance: float = 1e-9) -> DataFrame:
    """``diff_snapshots`` of wallet balances by (wallet without surrounding blanks, mint).

    The amount is ``ui_amount``, or ``raw_amount / 10^decimals`` where that is null or NaN.
    """
    ui = F.col("ui_amount")
    restated = F.col("raw_amount").cast("double") / F.pow(F.lit(10.0), F.col("decimals"))
    ready = balances.select(
        trim_space(F.col("wallet_address")).alias("wallet_address"), "token_mint", "fetched_at", "id",
        F.when(ui.isNull() | F.isnan(ui), restated).otherwise(ui).alias("ui_amount"),
    )
    return diff_snapshots(ready, ["wallet_address", "token_mint"], ["ui_amount"], "fetched_at", "id", gap_hours, tolerance)
