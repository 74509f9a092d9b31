"""Table-level operators: upserts, differences, samples, pages, fingerprints, scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.ranking import quantiles


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], recency: str) -> DataFrame:
    """Rows of both by key, the newest by ``recency``; of equal age the new table's, then the greatest row."""
    rows = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    best = F.max(F.struct(F.col(recency).alias("__r"), "__new", *rest))
    return rows.groupBy(*keys).agg(best.alias("b")).select(*keys, *[F.col(f"b.{c}").alias(c) for c in rest])


def state_diff(before: DataFrame, after: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Full outer difference of two states: ``change`` new, exited, changed; unchanged keys give no row."""
    b, a = before.select(*keys, F.col(value).alias("old")), after.select(*keys, F.col(value).alias("new"))
    j = b.join(a, list(keys), "full_outer")
    change = F.when(F.col("old").isNull() & F.col("new").isNotNull(), "new").when(F.col("new").isNull() & F.col("old").isNotNull(), "exited").when(F.col("old") != F.col("new"), "changed")
    return j.withColumn("change", change).where(F.col("change").isNotNull())


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 0) of ``size`` rows in a total order."""
    return df.orderBy(*order).offset(number * size).limit(size)


def first_available(base: DataFrame, key: str, sources: Sequence[DataFrame], value: str) -> DataFrame:
    """``base`` with ``value`` from the first source that has one, and ``source`` (from 1); sources are unique in ``key``."""
    out = base
    for i, s in enumerate(sources, 1):
        out = out.join(s.select(key, F.col(value).alias(f"__s{i}")), key, "left")
    n = range(1, len(sources) + 1)
    which = F.coalesce(*[F.when(F.col(f"__s{i}").isNotNull(), F.lit(i)) for i in n])
    return out.select(*base.columns, F.coalesce(*[F.col(f"__s{i}") for i in n]).alias(value), which.alias("source"))


def order_hash(df: DataFrame, group: Sequence[str], cells: Sequence[str]) -> DataFrame:
    """Per group an order-independent fingerprint of its rows (count, and sum and xor of 64-bit row hashes)."""
    h = F.xxhash64(*cells)
    return df.groupBy(*group).agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("hash_sum"), F.bit_xor(h).alias("hash_xor"))


def scaled(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``key`` and, per column: ``{c}_std`` (population z), ``{c}_robust`` ((x - median) / IQR), ``{c}_wins`` (clipped to 1.5 IQR), ``{c}_missing``.

    Nulls are imputed with the median first. A spread of zero counts as one.
    """
    wide = df
    for c in columns:
        wide = wide.join(F.broadcast(quantiles(df, c, [0.25, 0.5, 0.75]).withColumnRenamed("q", f"q_{c}")), how="left")  # one row
    filled = wide.select(key, *[F.col(f"q_{c}") for c in columns], *[F.col(c).isNull().cast("int").alias(f"{c}_missing") for c in columns], *[F.coalesce(F.col(c).cast("double"), F.col(f"q_{c}")[1]).alias(c) for c in columns])
    m = filled.agg(*[e for c in columns for e in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))])
    out = [F.col(key)]
    for c in columns:
        x, lo, mid, hi = F.col(c), F.col(f"q_{c}")[0], F.col(f"q_{c}")[1], F.col(f"q_{c}")[2]
        iqr = hi - lo
        out += [
            F.round((x - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0), 5).alias(f"{c}_std"),
            F.round((x - mid) / F.when(iqr > 0, iqr).otherwise(1.0), 5).alias(f"{c}_robust"),
            F.round(F.least(F.greatest(x, lo - 1.5 * iqr), hi + 1.5 * iqr), 5).alias(f"{c}_wins"), F.col(f"{c}_missing"),
        ]
    return filled.join(F.broadcast(m)).select(*out)


def centroids(df: DataFrame, label: str, vector: str, dims: int) -> DataFrame:
    """Mean vector per label, summed component by component."""
    return df.groupBy(label).agg(F.array(*[F.avg(F.col(vector)[i].cast("double")) for i in range(dims)]).alias("centre"))


def nearest_centroid(df: DataFrame, key: str, vector: str, centres: DataFrame, label: str) -> DataFrame:
    """``key`` with the label of the centre of highest cosine (``assigned``) and that ``similarity``; ties to the smaller label.

    The centres are collected into one array row (labels times dimensions numbers), which is checked to be small.
    """
    from ledgerloom.functions.numeric import cosine

    n = centres.count()
    if n > 10_000:
        raise ValueError("more than 10 000 centres: use llm.neighbours over them instead")
    every = centres.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("l"), F.col("centre").alias("c")))).alias("centres"))
    scored = df.join(F.broadcast(every)).select(key, F.transform("centres", lambda c: F.struct(F.round(cosine(F.col(vector), c["c"]), 9).alias("s"), c["l"].alias("l"))).alias("s"))
    best = F.aggregate(F.slice("s", 2, F.size("s")), F.element_at("s", 1), lambda a, b: F.when(b["s"] > a["s"], b).otherwise(a))
    return scored.withColumn("b", best).select(key, F.col("b.l").alias("assigned"), F.round("b.s", 6).alias("similarity"))


def meets(conditions: dict[str, tuple[str, float]]) -> Column:
    """All of the conditions, by column: (one of ``>``, ``>=``, ``<``, ``<=``, ``==``, ``!=``; a number). Nulls meet none."""
    compare = {">": Column.__gt__, ">=": Column.__ge__, "<": Column.__lt__, "<=": Column.__le__, "==": Column.__eq__, "!=": Column.__ne__}
    out = F.lit(True)
    for c, (op, value) in conditions.items():
        out = out & F.coalesce(compare[op](F.col(c), F.lit(value)), F.lit(False))
    return out


def without(df: DataFrame, key: str, excluded: DataFrame) -> DataFrame:
    """Rows whose ``key`` isn't in the list; null keys stay."""
    return df.join(excluded.select(F.col(key)).distinct(), key, "left_anti")


def as_of(df: DataFrame, keys: Sequence[str], time_col: str, at: str, rest: Sequence[str]) -> DataFrame:
    """The version of each key that was the newest at time ``at``: the keys and ``rest``. Later versions and such without a time don't exist yet."""
    best = F.max(F.struct(F.col(time_col).alias("__t"), *rest))
    return df.where(F.col(time_col) <= F.lit(at).cast(df.schema[time_col].dataType)).groupBy(*keys).agg(best.alias("b")).select(*keys, *[F.col(f"b.{c}").alias(c) for c in rest])


def column_health(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per numeric column: ``rows``, ``nulls`` (NaN too), ``zeros``, ``distinct_values``, ``least``, ``greatest``, ``constant``; one scan and one shuffle of distinct values."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias("v")) for c in columns]))
    per = df.select(each.alias("x")).groupBy("x.c", "x.v").agg(F.count("*").alias("n"))
    v, n = F.col("v"), F.col("n")
    return per.groupBy(F.col("c").alias("column")).agg(
        F.sum(n).alias("rows"), F.coalesce(F.sum(F.when(v.isNull(), n)), F.lit(0)).alias("nulls"), F.coalesce(F.sum(F.when(v == 0, n)), F.lit(0)).alias("zeros"), F.count(v).alias("distinct_values"),
        F.min(v).alias("least"), F.max(v).alias("greatest"), (F.count(v) <= 1).alias("constant"))
