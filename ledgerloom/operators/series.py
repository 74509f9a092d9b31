"""Ordered computations per entity that hold for entities of any size.

A plain window keeps an entity's whole history in one task. The functions here cut time into
buckets: within (entity, bucket) an ordinary window does the work, and what must cross buckets comes
from a table of one row per entity and bucket. A bucket of a day bounds that table by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.numeric import seconds, tidy

DAY_S = 86_400


def _bucketed(df: DataFrame, time_col: str, bucket_s: int) -> DataFrame:
    return df.withColumn("__b", F.floor(seconds(F.col(time_col)) / bucket_s))


def _join_bucket(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    cond = rows["__b"] == table["__tb"]
    for k in keys:
        cond &= rows[k].eqNullSafe(table[f"__t_{k}"])
    return rows.join(table, cond, "left").drop("__tb", *[f"__t_{k}" for k in keys])


def fill(df: DataFrame, keys: Sequence[str], time_col: str, tie: Sequence[str], values: dict[str, Column], forward: bool = True, bucket_s: int = DAY_S, include_self: bool = True, bucket: Column | None = None) -> DataFrame:
    """Add, by name, the last (``forward``) or next value that isn't null, in the order (``time_col``, ``tie``).

    With ``include_self`` a row's own value counts. Rows without a time are left out. An order that isn't
    a time needs a ``bucket``: a number that never falls along the order.
    """
    kept = df.where(F.col(time_col).isNotNull())
    rows = (_bucketed(kept, time_col, bucket_s) if bucket is None else kept.withColumn("__b", bucket)).select("*", *[c.alias(f"__v_{n}") for n, c in values.items()])
    order = [time_col, *tie] if forward else [F.desc(time_col), *[F.desc(t) for t in tie]]
    near = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if include_self else -1)
    stamp = F.struct(F.col(time_col), *tie)
    pick = F.max_by if forward else F.min_by
    per = rows.groupBy(*keys, "__b").agg(*[pick(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), stamp)).alias(f"__l_{n}") for n in values])
    across = Window.partitionBy(*keys).orderBy("__b" if forward else F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    carried = per.select(F.col("__b").alias("__tb"), *[F.col(k).alias(f"__t_{k}") for k in keys], *[F.last(f"__l_{n}", True).over(across).alias(f"__c_{n}") for n in values])
    here = rows.select("*", *[F.last(f"__v_{n}", True).over(near).alias(f"__n_{n}") for n in values])
    return _join_bucket(here, carried, keys).select(*df.columns, *[F.coalesce(f"__n_{n}", f"__c_{n}").alias(n) for n in values])


def with_gaps(df: DataFrame, keys: Sequence[str], time_col: str, tie: Sequence[str], bucket_s: int = DAY_S) -> DataFrame:
    """Add ``gap_s``: seconds since the entity's previous row, null for its first."""
    s = seconds(F.col(time_col))
    return fill(df, keys, time_col, tie, {"__previous": s}, True, bucket_s, include_self=False).withColumn("gap_s", s - F.col("__previous")).drop("__previous")


def sessions(df: DataFrame, keys: Sequence[str], time_col: str, tie: Sequence[str], gap_s: float, bucket_s: int = DAY_S) -> DataFrame:
    """Per entity the runs of rows with no gap above ``gap_s`` (a gap of exactly that joins): ``session_start``, ``session_end``, ``n``."""
    starts = with_gaps(df, keys, time_col, tie, bucket_s).withColumn("__opens", F.when(F.col("gap_s").isNull() | (F.col("gap_s") > gap_s), F.col(time_col)))
    return (
        fill(starts, keys, time_col, tie, {"session_start": F.col("__opens")}, True, bucket_s)
        .groupBy(*keys, "session_start").agg(F.max(time_col).alias("session_end"), F.count("*").alias("n"))
    )


def activity(df: DataFrame, keys: Sequence[str], time_col: str, tie: Sequence[str]) -> DataFrame:
    """Per entity: ``n``, ``first_s``, ``last_s``, ``per_day`` (rows a day of its span) and ``burstiness`` of its gaps.

    Burstiness is (std - mean) / (std + mean) with the population deviation: -1 regular, 0 random,
    towards 1 bursty; null with fewer than two gaps.
    """
    g, s = F.col("gap_s"), seconds(F.col(time_col))
    out = with_gaps(df, keys, time_col, tie).groupBy(*keys).agg(
        F.count("*").alias("n"), F.min(s).alias("first_s"), F.max(s).alias("last_s"), F.count(g).alias("gaps"), F.avg(g).alias("mu"), F.stddev_pop(g).alias("sd")
    )
    span = (F.col("last_s") - F.col("first_s")) / DAY_S
    bursty = F.when((F.col("gaps") >= 2) & (F.col("sd") + F.col("mu") > 0), (F.col("sd") - F.col("mu")) / (F.col("sd") + F.col("mu")))
    return out.select(*keys, "n", "first_s", "last_s", F.round(F.when(span > 0, F.col("n") / span), 6).alias("per_day"), F.round(bursty, 6).alias("burstiness"))


def daily(df: DataFrame, keys: Sequence[str], time_col: str, sums: dict[str, Column]) -> DataFrame:
    """Sums per entity and day (``day``): what the day-granular functions below take."""
    return df.where(F.col(time_col).isNotNull()).groupBy(*keys, F.col(time_col).cast("date").alias("day")).agg(*[F.sum(c).alias(n) for n, c in sums.items()])


def with_calendar(days: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Add rows of zeros for the days between an entity's rows that it has none for."""
    w = Window.partitionBy(*keys).orderBy("day")
    until = F.coalesce(F.date_sub(F.lead("day").over(w), 1), F.col("day"))
    spread = days.withColumn("__until", until).withColumn("__d", F.explode(F.sequence("day", "__until")))
    return spread.select(*keys, F.col("__d").alias("day"), *[F.when(F.col("__d") == F.col("day"), F.col(c)).otherwise(0.0).alias(c) for c in columns])


def running_balances(days: DataFrame, keys: Sequence[str], change: str) -> DataFrame:
    """Per day: ``balance`` (running sum), ``clamped`` (sales beyond the holding leave zero), ``peak``, ``drawdown``.

    The clamped balance is the running sum less its running minimum where that is below zero, so it needs
    no row-by-row fold. ``drawdown`` is of the clamped balance against its peak so far.
    """
    w = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    total = days.withColumn("balance", F.sum(change).over(w))
    held = total.withColumn("clamped", F.col("balance") - F.least(F.min("balance").over(w), F.lit(0.0))).withColumn("peak", F.max("clamped").over(w))
    return held.select(*keys, "day", "balance", "clamped", "peak", F.when(F.col("peak") > 0, (F.col("peak") - F.col("clamped")) / F.col("peak")).otherwise(0.0).alias("drawdown"))


def first_sales(balances: DataFrame, keys: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Per entity: ``event`` (1 if its balance fell by ``threshold`` from the peak, else censored) and ``duration`` in days."""
    out = balances.groupBy(*keys).agg(
        F.min("day").alias("start"), F.max("day").alias("end"), F.min(F.when(F.col("drawdown") >= threshold - 1e-9, F.col("day"))).alias("sold")
    )
    return out.select(*keys, F.col("sold").isNotNull().cast("int").alias("event"), F.datediff(F.coalesce("sold", "end"), "start").alias("duration"))


def islands(days: DataFrame, keys: Sequence[str], state: Column) -> DataFrame:
    """Runs of rows with the same ``state``: ``state``, ``first_day``, ``last_day``, ``n``."""
    w = Window.partitionBy(*keys).orderBy("day")
    marked = days.withColumn("state", state).withColumn("__new", (~F.lag("state").over(w).eqNullSafe(F.col("state")) | (F.row_number().over(w) == 1)).cast("int"))
    numbered = marked.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "__run").agg(F.first("state").alias("state"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n")).drop("__run")


def smoothed(days: DataFrame, keys: Sequence[str], value: str, alpha: float = 0.3, outlier: float = 2.5) -> DataFrame:
    """Per day: ``rolling_median`` (centred, 3, shrinking at the edges), ``ewma``, ``cleaned``, ``velocity``, ``velocity_smooth``.

    ``cleaned`` replaces values more than ``outlier`` sample deviations from the entity's mean by the mean of
    their neighbours. ``velocity`` is the change a day, ``velocity_smooth`` its mean over five with reflected edges
    (null below five). Rows per entity are bounded by the calendar.
    """
    w = Window.partitionBy(*keys).orderBy("day")
    whole = Window.partitionBy(*keys)
    v = F.col(value)
    base = days.select(*keys, "day", v.alias("v"), F.lag(value).over(w).alias("before"), F.lead(value).over(w).alias("after"), F.lag("day").over(w).alias("day_before"),
                       F.avg(v).over(whole).alias("mu"), F.stddev_samp(v).over(whole).alias("sd"))
    three = F.array_sort(F.array_compact(F.array("before", "v", "after")))
    median = (F.element_at(three, ((F.size(three) + 1) / 2).cast("int")) + F.element_at(three, (F.size(three) / 2).cast("int") + 1)) / 2
    sides = F.array_compact(F.array("before", "after"))
    mean_side = F.aggregate(sides, F.lit(0.0), lambda a, x: a + x) / F.size(sides)
    step = base.select(
        *keys, "day", "v", tidy(median, 6).alias("rolling_median"),
        F.when((F.abs(F.col("v") - F.col("mu")) > outlier * F.col("sd")) & (F.size(sides) > 0), mean_side).otherwise(F.col("v")).alias("cleaned"),
        ((F.col("v") - F.col("before")) / F.datediff("day", "day_before")).alias("velocity"),
    )
    # Whole series as arrays, each bounded by the calendar: recursions and reflected edges are folds over them.
    lists = step.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("day", "v", "rolling_median", "cleaned", "velocity"))).alias("s"))
    first = lists["s"][0]["v"]
    fold = F.aggregate(F.slice("s", 2, F.size("s")), F.array(first), lambda acc, x: F.concat(acc, F.array(alpha * x["v"] + (1 - alpha) * F.element_at(acc, -1))))
    n = F.size("vel")

    def reflected(i: Column) -> Column:
        inside = F.when(i < 0, -i - 1).when(i >= n, 2 * n - 1 - i).otherwise(i)
        return F.element_at("vel", inside.cast("int") + 1)

    smooth = F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 1), lambda i: (reflected(i - 2) + reflected(i - 1) + reflected(i) + reflected(i + 1) + reflected(i + 2)) / 5))
    arrays = lists.withColumn("ewma", fold).withColumn("vel", F.filter(F.transform("s", lambda x: x["velocity"]), lambda x: x.isNotNull())).withColumn("vs", smooth)
    rows = arrays.select(*keys, "ewma", "vs", F.posexplode("s").alias("i", "x"))
    return rows.select(
        *keys, F.col("x.day").alias("day"), "x.rolling_median", tidy(F.element_at("ewma", F.col("i") + 1), 6).alias("ewma"), tidy("x.cleaned", 6).alias("cleaned"),
        tidy("x.velocity", 6).alias("velocity"), tidy(F.when((F.col("i") > 0) & F.col("vs").isNotNull(), F.element_at("vs", F.greatest(F.col("i"), F.lit(1)))), 6).alias("velocity_smooth"),
    )


def trends(days: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per entity: ``slope`` (least squares, a day), ``theil_sen`` (median of pair slopes), ``acceleration`` (second half's slope less the first's), ``trend``."""
    w = Window.partitionBy(*keys).orderBy("day")
    x = F.datediff("day", F.lit("2000-01-01").cast("date")).cast("double")
    rows = days.select(*keys, "day", F.col(value).alias("v"), x.alias("x"), F.row_number().over(w).alias("i"), F.count("*").over(Window.partitionBy(*keys)).alias("n"))
    late = F.col("i") > F.floor(F.col("n") / 2)
    sums = rows.groupBy(*keys).agg(
        F.regr_slope("v", "x").alias("slope"), F.regr_slope(F.when(late, F.col("v")), F.when(late, F.col("x"))).alias("s2"),
        F.regr_slope(F.when(~late, F.col("v")), F.when(~late, F.col("x"))).alias("s1"), F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd"), F.count("*").alias("points"),
        F.array_sort(F.collect_list(F.struct("x", "v"))).alias("p"),
    )
    # Pairs of days of one entity, bounded by the square of the calendar's length, within its row.
    pairs = F.flatten(F.transform("p", lambda a: F.transform(F.filter("p", lambda b: b["x"] > a["x"]), lambda b: (b["v"] - a["v"]) / (b["x"] - a["x"]))))
    q = F.array_sort(pairs)
    mid = F.size(q)
    median = F.when(mid > 0, (F.element_at(q, ((mid + 1) / 2).cast("int")) + F.element_at(q, (mid / 2).cast("int") + 1)) / 2)
    cv = F.col("sd") / F.abs(F.nullif("mu", F.lit(0.0)))
    trend = F.when(F.col("points") < 3, "unknown").when(cv > 0.3, "volatile").when(F.abs("slope") < 0.1 * F.col("sd"), "stable").when(F.col("slope") > 0, "rising").otherwise("falling")
    return sums.select(
        *keys, "points", F.round("slope", 6).alias("slope"), F.round(median, 6).alias("theil_sen"),
        F.round(F.when(F.col("points") >= 4, F.col("s2") - F.col("s1")), 6).alias("acceleration"), trend.alias("trend"),
    )


def nearest_within(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, right_tie: str, right_value: str, within_s: float) -> DataFrame:
    """Left rows with the nearest right row of the same key: ``{right_value}``, ``distance_s`` (null beyond ``within_s``).

    Ties go to the earlier one. Both sides become one stream in which the last and the next right row are
    carried to each left row: linear in the rows, however many fall within reach of each other.
    """
    lt, rt = F.col(left_time).cast("timestamp"), F.col(right_time).cast("timestamp")
    data = left.select(F.col(key).alias("k"), lt.alias("t"), F.lit(1).alias("side"), F.lit(None).cast("string").alias("tie"), F.struct(*left.columns).alias("row"), F.lit(None).cast(right.schema[right_value].dataType).alias("value"), F.lit(None).cast("timestamp").alias("rt"))
    ref = right.where(F.col(right_time).isNotNull()).select(
        F.col(key).alias("k"), rt.alias("t"), F.lit(0).alias("side"), F.col(right_tie).cast("string").alias("tie"),
        F.lit(None).cast(data.schema["row"].dataType).alias("row"), F.col(right_value).alias("value"), rt.alias("rt"))
    both = data.unionByName(ref)
    hit = F.when(F.col("side") == 0, F.struct(F.col("rt"), F.col("value")))
    before = fill(both, ["k"], "t", ["side", "tie"], {"p": hit}, True)
    around = fill(before, ["k"], "t", ["side", "tie"], {"n": hit}, False).where("side = 1")
    dp, dn = seconds(F.col("t")) - seconds(F.col("p.rt")), seconds(F.col("n.rt")) - seconds(F.col("t"))
    use_next = F.col("p").isNull() | (F.col("n").isNotNull() & (dn < dp))
    best = around.select("row", F.when(use_next, F.col("n.value")).otherwise(F.col("p.value")).alias("v"), F.when(use_next, dn).otherwise(dp).alias("d"))
    near = F.col("d") <= within_s
    return best.select("row.*", F.when(near, F.col("v")).alias(right_value), F.round(F.when(near, F.col("d")), 6).alias("distance_s"))


def interpolated(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, right_tie: str, right_value: str) -> DataFrame:
    """Left rows with ``value`` interpolated linearly between the right rows around them; one-sided at the ends."""
    lt, rt = F.col(left_time).cast("timestamp"), F.col(right_time).cast("timestamp")
    data = left.select(F.col(key).alias("k"), lt.alias("t"), F.lit(1).alias("side"), F.lit(None).cast("string").alias("tie"), F.struct(*left.columns).alias("row"), F.lit(None).cast("double").alias("v"))
    ref = right.where(F.col(right_time).isNotNull() & F.col(right_value).isNotNull()).select(
        F.col(key).alias("k"), rt.alias("t"), F.lit(0).alias("side"), F.col(right_tie).cast("string").alias("tie"), F.lit(None).cast(data.schema["row"].dataType).alias("row"), F.col(right_value).cast("double").alias("v"))
    hit = F.when(F.col("side") == 0, F.struct(seconds(F.col("t")).alias("s"), F.col("v")))
    both = fill(fill(data.unionByName(ref), ["k"], "t", ["side", "tie"], {"p": hit}, True), ["k"], "t", ["side", "tie"], {"n": hit}, False).where("side = 1")
    span, at = F.col("n.s") - F.col("p.s"), seconds(F.col("t"))
    between = F.col("p.v") + (F.col("n.v") - F.col("p.v")) * (at - F.col("p.s")) / F.nullif(span, F.lit(0.0))
    return both.select("row.*", F.round(F.coalesce(between, F.col("p.v"), F.col("n.v")), 6).alias("value"))


def rolling_ranges(df: DataFrame, keys: Sequence[str], time_col: str, value: str, ranges: dict[str, int]) -> DataFrame:
    """Add, by name, the mean of ``value`` over the trailing so many seconds (both ends and all rows of the same time included).

    Time is cut into buckets as long as the range. A row counts in its own bucket and as history in the next, so a
    window over (key, bucket) sees all it needs, and a key with a third of all rows spreads over its buckets. Rows without a
    time are left out; null values aren't averaged.
    """
    out = df.where(F.col(time_col).isNotNull()).withColumn("__t", F.unix_micros(F.col(time_col).cast("timestamp")))
    for name, s in ranges.items():
        width = s * 1_000_000
        two = out.withColumn("__own", F.floor(F.col("__t") / width)).withColumn("__b", F.explode(F.array(F.col("__own"), F.col("__own") + 1)))
        w = Window.partitionBy(*keys, "__b").orderBy("__t").rangeBetween(-width, 0)
        out = two.withColumn(name, F.avg(value).over(w)).where(F.col("__b") == F.col("__own")).drop("__own", "__b")
    return out.drop("__t")


def position_profiles(balances: DataFrame, keys: Sequence[str], life: Sequence[str]) -> DataFrame:
    """Per entity (``running_balances``): ``entry`` (first held day, as a share of the life of ``life``), ``holding_days``, ``volatility`` (of the balance over its peak).

    ``life`` are the keys whose first and last day bound the share. Entities that never held anything give no row.
    """
    span = balances.groupBy(*life).agg(F.min("day").alias("a"), F.max("day").alias("z"))
    held = F.col("clamped")
    per = balances.groupBy(*keys).agg(F.min(F.when(held > 0, F.col("day"))).alias("first"), F.stddev_pop(held).alias("sd"), F.max(held).alias("top")).where(F.col("first").isNotNull())
    j = per.join(span, list(life))
    days = F.datediff("z", "a")
    return j.select(*keys, F.round(F.when(days > 0, F.datediff("first", "a") / days).otherwise(0.0), 6).alias("entry"), F.datediff("z", "first").alias("holding_days"), F.round(F.col("sd") / F.col("top"), 6).alias("volatility"))


def flows(df: DataFrame, keys: Sequence[str], amount: str) -> DataFrame:
    """Per entity: ``inflow``, ``outflow``, ``net``, ``imbalance`` (net over turnover), ``turns`` (rows) and ``largest`` movement."""
    a = F.col(amount)
    t = df.where(a.isNotNull()).groupBy(*keys).agg(F.sum(F.when(a > 0, a).otherwise(0.0)).alias("i"), F.sum(F.when(a < 0, -a).otherwise(0.0)).alias("o"), F.count("*").alias("turns"), F.max(F.abs(a)).alias("largest"))
    net, turnover = F.col("i") - F.col("o"), F.col("i") + F.col("o")
    return t.select(*keys, F.round("i", 2).alias("inflow"), F.round("o", 2).alias("outflow"), (F.round(net, 2) + 0.0).alias("net"), (F.round(F.when(turnover > 0, net / turnover).otherwise(0.0), 6) + 0.0).alias("imbalance"), "turns", F.round("largest", 2).alias("largest"))


def cadence(df: DataFrame, keys: Sequence[str], time_col: str, tie: Sequence[str]) -> DataFrame:
    """Per entity: ``n``, ``mean_gap_s`` and ``irregularity`` (deviation of its gaps over their mean, null below two gaps)."""
    g = F.col("gap_s")
    t = with_gaps(df, keys, time_col, tie).groupBy(*keys).agg(F.count("*").alias("n"), F.count(g).alias("gaps"), F.avg(g).alias("mu"), F.stddev_pop(g).alias("sd"))
    return t.select(*keys, "n", F.round("mu", 4).alias("mean_gap_s"), F.round(F.when((F.col("gaps") >= 2) & (F.col("mu") > 0), F.col("sd") / F.col("mu")), 6).alias("irregularity"))
