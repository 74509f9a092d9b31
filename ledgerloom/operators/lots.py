"""Matching of sales to bought lots."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.ranking import ranked
from ledgerloom.operators.series import fill


def fifo_matches(trades: DataFrame, keys: Sequence[str], order: Sequence[str], amount: str, ident: str) -> DataFrame:
    """First in, first out: ``buy``, ``sell`` (identifiers) and ``matched`` amount, besides the keys.

    On the line of cumulated amounts a purchase covers one stretch and a sale another; a match is where
    they overlap. The ends of all stretches cut the line into pieces, and each piece belongs to the next
    purchase end and the next sale end. So the work is linear in the trades; what is sold beyond what
    was ever bought stays unmatched. Amounts are taken in millionths, which keeps the cuts exact.
    """
    a = F.round(F.col(amount) * 1_000_000).cast("long")
    rows = trades.select(*keys, *order, F.col(ident).alias("__id"), F.abs(a).alias("__q"), F.when(a > 0, "b").otherwise("s").alias("__side")).where(a != 0)
    placed = ranked(rows, [*keys, "__side"], [F.col(c) for c in order], {"__end": F.col("__q")})
    ends = placed.select(*keys, "__side", "__id", F.col("__end").alias("at"), F.col("rank").alias("no"))
    buy, sell = F.col("__side") == "b", F.col("__side") == "s"
    marks = {"buy": F.when(buy, F.struct("at", "__id")), "sell": F.when(sell, F.struct("at", "__id"))}
    # Buckets of the line: any number that never falls along it does; powers of two spread long lines.
    bucket = F.floor(F.log2(F.greatest(F.col("at"), F.lit(1)).cast("double")) * 64)
    cut = fill(ends, keys, "at", ["__side", "no"], marks, forward=False, bucket=bucket)
    # The piece that ends at a cut begins at the previous cut of the line.
    start = fill(cut, keys, "at", ["__side", "no"], {"from": F.col("at")}, forward=True, include_self=False, bucket=bucket)
    piece = F.col("at") - F.coalesce("from", F.lit(0))
    return start.where(F.col("buy").isNotNull() & F.col("sell").isNotNull() & (piece > 0)).groupBy(*keys, F.col("buy.__id").alias("buy"), F.col("sell.__id").alias("sell")).agg(
        (F.sum(piece) / 1_000_000).alias("matched"))


def open_lots(trades: DataFrame, matches: DataFrame, keys: Sequence[str], amount: str, ident: str) -> DataFrame:
    """What is left of each purchase: the keys, ``buy`` and ``remaining`` above zero."""
    used = matches.groupBy("buy").agg(F.sum("matched").alias("used"))
    bought = trades.where(F.col(amount) > 0)
    left = F.round(F.col(amount) - F.coalesce("used", F.lit(0.0)), 6)
    return bought.join(used, bought[ident] == used["buy"], "left").select(*keys, F.col(ident).alias("buy"), left.alias("remaining")).where("remaining > 0")


def average_cost(trades: DataFrame, keys: Sequence[str], order: Sequence[str], amount: str, price: str) -> DataFrame:
    """Running average cost per key and day row (ordered fold): ``position``, ``cost`` and ``realised`` at the end.

    Sales beyond the position sell what is there. The recursion has no closed form, so each key's rows
    become one array; keys must be bounded, as by one row a day (see ``series.daily``).
    """
    zero = F.struct(F.lit(0.0).alias("q"), F.lit(0.0).alias("c"), F.lit(0.0).alias("r"))

    def step(s, x):
        q, p = x["a"], x["p"]
        sold = F.least(-q, s["q"])
        avg = F.when(s["q"] > 0, s["c"] / s["q"]).otherwise(0.0)
        return F.when(q >= 0, F.struct((s["q"] + q).alias("q"), (s["c"] + q * p).alias("c"), s["r"].alias("r"))).otherwise(
            F.struct((s["q"] - sold).alias("q"), (s["c"] - sold * avg).alias("c"), (s["r"] + sold * (p - avg)).alias("r")))

    lists = trades.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(amount).alias("a"), F.col(price).alias("p")))).alias("x"))
    out = lists.select(*keys, F.aggregate("x", zero, step).alias("s"))
    return out.select(*keys, *[(F.round(f"s.{a}", 2) + 0.0).alias(b) for a, b in (("q", "position"), ("c", "cost"), ("r", "realised"))])


def matched_lots(days: DataFrame, keys: Sequence[str], day: str, amount: str, price: str, method: str = "lifo") -> DataFrame:
    """Sales matched to purchases, last in first out (or ``fifo``): the keys, ``buy_day``, ``sell_day``, ``matched``, ``buy_price``, ``sell_price``.

    ``days``: one row a key and day (see ``series.daily``). Rows stream through each task in the order of key and day, so of
    a key only its open lots are held. Sales beyond the holding are cut to it; rows with a null in any column count as none.
    """
    if method not in ("lifo", "fifo"):
        raise ValueError(f"no method {method}")
    names = [*keys, "day", "amount", "price"]
    rows = days.select(*keys, F.col(day).alias("day"), F.col(amount).cast("double").alias("amount"), F.col(price).cast("double").alias("price")).dropna()
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"buy_day {kinds['day']}", f"sell_day {kinds['day']}", "matched double", "buy_price double", "sell_price double"])
    out_names, end = [*keys, "buy_day", "sell_day", "matched", "buy_price", "sell_price"], 0 if method == "fifo" else -1

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, lots = None, deque()
        for frame in frames:
            out = []
            for *k, at, a, p in frame[names].itertuples(index=False):
                if k != key:
                    key, lots = k, deque()
                if a > 0:
                    lots.append([at, a, p])
                while a < 0 and lots:
                    lot = lots[end]
                    took = min(lot[1], -a)
                    out.append((*k, lot[0], at, took, lot[2], p))
                    lot[1] -= took
                    a += took
                    if lot[1] <= 1e-9:
                        lots.popleft() if end == 0 else lots.pop()
            yield pd.DataFrame(out, columns=out_names)

    return rows.repartition(*keys).sortWithinPartitions(*keys, "day").mapInPandas(run, schema)


def realised(matches: DataFrame, prices: DataFrame, keys: Sequence[str], day: str, peak: str, depth: str) -> DataFrame:
    """Per key and day of sale: ``sold``, ``entry_price``, ``exit_price``, ``pnl``, ``pnl_pct``, ``efficiency``, ``drawdown``, ``adjusted_pnl``.

    ``prices``: one row a key and day with the highest price so far (``peak``) and the day's liquidity (``depth``). Efficiency is the exit's
    share of the peak, drawdown the rest. A sale moves the price against itself by a tenth of its share of the liquidity, half at most.
    """
    per = matches.groupBy(*keys, F.col("sell_day").alias(day)).agg(
        F.sum("matched").alias("sold"), F.max("sell_price").alias("exit_price"), F.sum(F.col("matched") * F.col("buy_price")).alias("basis"))
    x, sold = F.col("exit_price"), F.col("sold")
    entry, pnl = F.col("basis") / sold, sold * x - F.col("basis")
    j = per.join(prices.select(*keys, day, F.col(peak).alias("peak"), F.col(depth).alias("depth")), [*keys, day])
    slip = F.least(F.lit(0.5), 0.1 * sold * x / F.col("depth"))
    r = lambda c, places: F.round(c + 10.0 ** (-places - 5), places) + 0.0  # noqa: E731 - exact halves go up whatever the order of sums
    return j.select(
        *keys, day, r(sold, 4).alias("sold"), r(entry, 6).alias("entry_price"), r(x, 6).alias("exit_price"), r(pnl, 2).alias("pnl"), r(F.when(entry > 0, (x - entry) / entry).otherwise(0.0), 6).alias("pnl_pct"),
        r(F.when(F.col("peak") > 0, x / F.col("peak")), 6).alias("efficiency"), r(F.when(F.col("peak") > 0, 1 - x / F.col("peak")), 6).alias("drawdown"),
        r(F.when(F.col("depth") > 0, pnl * (1 - slip)), 2).alias("adjusted_pnl"))


def unrealised(days: DataFrame, matches: DataFrame, keys: Sequence[str], day: str, amount: str, price: str) -> DataFrame:
    """Per key: ``position`` still held, its ``basis`` by the lots left, ``last_price``, ``value``, ``pnl`` and ``pnl_pct``; keys that hold nothing give no row."""
    d = days.select(*keys, day, F.col(amount).cast("double").alias("a"), F.col(price).cast("double").alias("p")).dropna()
    bought = F.when(F.col("a") > 0, F.col("a")).otherwise(0.0)
    whole = d.groupBy(*keys).agg(F.sum(bought).alias("q"), F.sum(bought * F.col("p")).alias("c"), F.max_by("p", day).alias("last_price"))
    used = matches.groupBy(*keys).agg(F.sum("matched").alias("uq"), F.sum(F.col("matched") * F.col("buy_price")).alias("uc"))
    zero = F.lit(0.0)
    t = whole.join(used, list(keys), "left").select(*keys, "last_price", (F.col("q") - F.coalesce("uq", zero)).alias("q"), (F.col("c") - F.coalesce("uc", zero)).alias("c")).where("q > 1e-9")
    value = F.col("q") * F.col("last_price")
    r = lambda c, places: F.round(c + 10.0 ** (-places - 5), places) + 0.0  # noqa: E731 - exact halves go up whatever the order of sums
    return t.select(*keys, r(F.col("q"), 4).alias("position"), r(F.col("c"), 2).alias("basis"), r(F.col("last_price"), 6).alias("last_price"), r(value, 2).alias("value"), r(value - F.col("c"), 2).alias("pnl"), r(F.when(F.col("c") > 0, (value - F.col("c")) / F.col("c")), 6).alias("pnl_pct"))
