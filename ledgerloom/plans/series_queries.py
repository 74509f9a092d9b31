"""Queries on time series of trades and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import series as S
from ledgerloom.sources.tables import table
from ledgerloom.sources.views import TRADES, trades


def _text(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in columns})


def wallet_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.activity(trades(spark, sf_dir), ["wallet"], "ts", ["signature"])


def trade_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sessions(trades(spark, sf_dir), ["mint"], "ts", ["signature"], gap_s=3600)


def _mint_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.daily(trades(spark, sf_dir), ["mint"], "ts", {"volume": F.abs("amount"), "net": F.col("amount")})


def daily_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = S.with_calendar(_mint_days(spark, sf_dir), ["mint"], ["volume", "net"])
    w = S.Window.partitionBy("mint").orderBy("day")
    v = full.withColumn("before", F.round(F.lag("volume").over(w), 4)).withColumn("volume", F.round("volume", 4))
    pct = F.when(F.col("before") > 0, 100 * (F.col("volume") - F.col("before")) / F.col("before")).otherwise(F.when(F.col("volume") > 0, 100.0).otherwise(0.0))
    return _text(v.where(F.col("before").isNotNull()).select("mint", "day", "volume", F.round(pct, 4).alias("change_pct")).where(F.abs("change_pct") >= 10), "day")


def balance_drawdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = S.daily(trades(spark, sf_dir), ["wallet", "mint"], "ts", {"net": F.col("amount")})
    out = S.running_balances(days, ["wallet", "mint"], "net")
    return _text(out.select("wallet", "mint", "day", *[F.round(F.col(c), 2).alias(c) for c in ("balance", "clamped", "peak")], F.round("drawdown", 4).alias("drawdown")), "day")


def sell_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = S.daily(trades(spark, sf_dir), ["wallet", "mint"], "ts", {"net": F.col("amount")})
    return S.first_sales(S.running_balances(days, ["wallet", "mint"], "net"), ["wallet", "mint"])


def flow_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.round("net", 2) > 0, "inflow").when(F.round("net", 2) < 0, "outflow").otherwise("flat")
    return _text(S.islands(S.with_calendar(_mint_days(spark, sf_dir), ["mint"], ["volume", "net"]), ["mint"], state), "first_day", "last_day")


def smoothed_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(S.smoothed(_mint_days(spark, sf_dir), ["mint"], "volume"), "day")


def volume_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.trends(_mint_days(spark, sf_dir), ["mint"], "volume")


def _events(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("event_type") == kind)


def nearest_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    bought = _events(spark, sf_dir, "purchase").select("event_id", "user_id", "ts")
    seen = _events(spark, sf_dir, "view").select("user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"))
    return S.nearest_within(bought, seen, "user_id", "ts", "view_ts", "view_id", "view_id", 6 * 3600).select("event_id", "view_id", "distance_s")


def interpolated_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    bought = _events(spark, sf_dir, "purchase").select("event_id", "user_id", "ts")
    seen = _events(spark, sf_dir, "view").select("user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"), F.col("value").alias("seen"))
    return S.interpolated(bought, seen, "user_id", "ts", "view_ts", "view_id", "seen").select("event_id", "value")


def balance_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net position at the end of the data and 7 and 30 days before it, with relative changes."""
    days = S.daily(trades(spark, sf_dir), ["mint"], "ts", {"net": F.col("amount")})
    end = days.agg(F.max("day").alias("last"))
    joined = days.join(F.broadcast(end))  # one row
    back = lambda n: F.sum(F.when(F.col("day") <= F.date_sub("last", n), F.col("net")).otherwise(0.0))
    out = joined.groupBy("mint").agg(*[F.round(back(n), 2).alias(f"position_{n}") for n in (0, 7, 30)])
    delta = lambda n: F.when(F.col(f"position_{n}") != 0, (F.col("position_0") - F.col(f"position_{n}")) / F.col(f"position_{n}")).otherwise(F.when(F.col("position_0") > 0, 1.0).otherwise(0.0))
    return out.select("mint", "position_0", *[(F.round(delta(n), 6) + 0.0).alias(f"delta_{n}") for n in (7, 30)])


def price_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly annualised volatility of daily mean unit prices per supplier (``grp``), and its percentile among the supplier's months.

    A month needs two returns, as a supplier's days are few.
    """
    line = table(spark, sf_dir, "lineitem")
    prices = line.where("l_quantity > 0").groupBy(F.col("l_suppkey").alias("grp"), F.col("l_shipdate").cast("date").alias("day")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    w = S.Window.partitionBy("grp").orderBy("day")
    returns = prices.withColumn("r", F.col("price") / F.lag("price").over(w) - 1).where(F.col("r").isNotNull())
    months = returns.groupBy("grp", F.date_format("day", "yyyy-MM").alias("month")).agg(F.round(F.stddev_pop("r") * F.sqrt(F.lit(252.0)), 6).alias("volatility"), F.count("*").alias("n")).where("n >= 2")
    m = S.Window.partitionBy("grp")
    by = m.orderBy("volatility")
    size, below = F.count("*").over(m), F.rank().over(by) - 1
    upto = F.count("*").over(by.rangeBetween(S.Window.unboundedPreceding, 0))
    return months.select("grp", "month", "volatility", F.round((below + upto + 1) * 50.0 / size, 4).alias("percentile"))


QUERIES = {f.__name__: f for f in (
    wallet_activity, trade_sessions, daily_changes, balance_drawdowns, sell_events, flow_regimes, smoothed_volume, volume_trends, nearest_view,
    interpolated_values, balance_lookback, price_regimes,
)}

_DAYS = TRADES + """,
    days AS (SELECT mint, CAST(ts AS DATE) AS day, sum(abs(amount)) AS volume, sum(amount) AS net FROM trades GROUP BY ALL)"""
_FULL = _DAYS + """,
    span AS (SELECT mint, min(day) AS a, max(day) AS b FROM days GROUP BY mint),
    calendar AS (SELECT mint, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM span),
    full_days AS (SELECT c.mint, c.day, coalesce(d.volume, 0) AS volume, coalesce(d.net, 0) AS net FROM calendar c LEFT JOIN days d ON d.mint = c.mint AND d.day = c.day)"""
_RUN = TRADES + """,
    days AS (SELECT wallet, mint, CAST(ts AS DATE) AS day, sum(amount) AS net FROM trades GROUP BY ALL),
    sums AS (SELECT *, sum(net) OVER (PARTITION BY wallet, mint ORDER BY day) AS balance FROM days),
    held AS (SELECT *, balance - least(min(balance) OVER (PARTITION BY wallet, mint ORDER BY day), 0) AS clamped FROM sums),
    run AS (SELECT *, max(clamped) OVER (PARTITION BY wallet, mint ORDER BY day) AS peak FROM held),
    drawn AS (SELECT *, CASE WHEN peak > 0 THEN (peak - clamped) / peak ELSE 0 END AS drawdown FROM run)"""
_SECONDS = "epoch_us({}) / 1000000.0"

SQL = {
    "wallet_activity": f"""WITH {TRADES},
    g AS (SELECT wallet, {_SECONDS.format('ts')} AS s, {_SECONDS.format('ts')} - lag({_SECONDS.format('ts')}) OVER (PARTITION BY wallet ORDER BY ts, signature) AS gap FROM trades),
    a AS (SELECT wallet, count(*) AS n, min(s) AS first_s, max(s) AS last_s, count(gap) AS gaps, avg(gap) AS mu, stddev_pop(gap) AS sd FROM g GROUP BY wallet)
    SELECT wallet, n, first_s, last_s, round(CASE WHEN last_s > first_s THEN n / ((last_s - first_s) / 86400) END, 6) AS per_day,
           round(CASE WHEN gaps >= 2 AND sd + mu > 0 THEN (sd - mu) / (sd + mu) END, 6) AS burstiness FROM a""",
    "trade_sessions": f"""WITH {TRADES},
    g AS (SELECT *, coalesce(ts - lag(ts) OVER w > INTERVAL 1 HOUR, true)::INT AS opens FROM trades WINDOW w AS (PARTITION BY mint ORDER BY ts, signature)),
    s AS (SELECT *, sum(opens) OVER (PARTITION BY mint ORDER BY ts, signature) AS no FROM g)
    SELECT mint, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n FROM s GROUP BY mint, no""",
    "daily_changes": f"""WITH {_FULL},
    v AS (SELECT mint, day, round(volume, 4) AS volume, round(lag(volume) OVER (PARTITION BY mint ORDER BY day), 4) AS before FROM full_days),
    c AS (SELECT mint, strftime(day, '%Y-%m-%d') AS day, volume, round(CASE WHEN before > 0 THEN 100 * (volume - before) / before WHEN volume > 0 THEN 100.0 ELSE 0.0 END, 4) AS change_pct FROM v WHERE before IS NOT NULL)
    SELECT * FROM c WHERE abs(change_pct) >= 10""",
    "balance_drawdowns": f"""WITH {_RUN}
    SELECT wallet, mint, strftime(day, '%Y-%m-%d') AS day, round(balance, 2) AS balance, round(clamped, 2) AS clamped, round(peak, 2) AS peak, round(drawdown, 4) AS drawdown FROM drawn""",
    "sell_events": f"""WITH {_RUN},
    e AS (SELECT wallet, mint, min(day) AS a, max(day) AS b, min(CASE WHEN drawdown >= 0.5 - 1e-9 THEN day END) AS sold FROM drawn GROUP BY ALL)
    SELECT wallet, mint, (sold IS NOT NULL)::INT AS event, CAST(coalesce(sold, b) - a AS INT) AS duration FROM e""",
    "flow_regimes": f"""WITH {_FULL},
    s AS (SELECT *, CASE WHEN round(net, 2) > 0 THEN 'inflow' WHEN round(net, 2) < 0 THEN 'outflow' ELSE 'flat' END AS state FROM full_days),
    i AS (SELECT *, row_number() OVER (PARTITION BY mint ORDER BY day) - row_number() OVER (PARTITION BY mint, state ORDER BY day) AS run FROM s)
    SELECT mint, state, strftime(min(day), '%Y-%m-%d') AS first_day, strftime(max(day), '%Y-%m-%d') AS last_day, count(*) AS n FROM i GROUP BY mint, state, run""",
    "smoothed_volume": f"""WITH RECURSIVE {_DAYS},
    n AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY mint) AS n, lag(volume) OVER w AS before, lead(volume) OVER w AS after, lag(day) OVER w AS day_before,
             avg(volume) OVER (PARTITION BY mint) AS mu, stddev_samp(volume) OVER (PARTITION BY mint) AS sd,
             median(volume) OVER (PARTITION BY mint ORDER BY day ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS rm FROM days WINDOW w AS (PARTITION BY mint ORDER BY day)),
    e AS (SELECT mint, i, volume AS ewma FROM n WHERE i = 1 UNION ALL SELECT n.mint, n.i, 0.3 * n.volume + 0.7 * e.ewma FROM e JOIN n ON n.mint = e.mint AND n.i = e.i + 1),
    vel AS (SELECT mint, i - 1 AS i, n - 1 AS n, (volume - before) / (day - day_before) AS velocity FROM n WHERE i > 1),
    five AS (
      SELECT a.mint, a.i, sum(b.velocity) / 5 AS vs FROM vel a CROSS JOIN (SELECT unnest([-2, -1, 0, 1, 2]) AS d) o
      JOIN vel b ON b.mint = a.mint AND b.i = CASE WHEN a.i + d < 1 THEN 1 - (a.i + d) WHEN a.i + d > a.n THEN 2 * a.n + 1 - (a.i + d) ELSE a.i + d END
      WHERE a.n >= 5 GROUP BY a.mint, a.i)
    SELECT n.mint, strftime(n.day, '%Y-%m-%d') AS day, round(rm + 1e-9, 6) + 0.0 AS rolling_median, round(e.ewma + 1e-9, 6) + 0.0 AS ewma,
           round(CASE WHEN abs(volume - mu) > 2.5 * sd AND (before IS NOT NULL OR after IS NOT NULL) THEN (coalesce(before, 0) + coalesce(after, 0)) / ((before IS NOT NULL)::INT + (after IS NOT NULL)::INT) ELSE volume END + 1e-9, 6) + 0.0 AS cleaned,
           round(v.velocity + 1e-9, 6) + 0.0 AS velocity, round(f.vs + 1e-9, 6) + 0.0 AS velocity_smooth
    FROM n JOIN e ON e.mint = n.mint AND e.i = n.i LEFT JOIN vel v ON v.mint = n.mint AND v.i = n.i - 1 LEFT JOIN five f ON f.mint = n.mint AND f.i = n.i - 1""",
    "volume_trends": f"""WITH {_DAYS},
    p AS (SELECT mint, volume AS v, CAST(day - DATE '2000-01-01' AS DOUBLE) AS x, row_number() OVER (PARTITION BY mint ORDER BY day) AS i, count(*) OVER (PARTITION BY mint) AS n FROM days),
    s AS (SELECT mint, count(*) AS points, regr_slope(v, x) AS slope, regr_slope(v, x) FILTER (WHERE i > n // 2) AS s2, regr_slope(v, x) FILTER (WHERE i <= n // 2) AS s1, avg(v) AS mu, stddev_pop(v) AS sd FROM p GROUP BY mint),
    t AS (SELECT a.mint, median((b.v - a.v) / (b.x - a.x)) AS theil_sen FROM p a JOIN p b ON a.mint = b.mint AND b.x > a.x GROUP BY a.mint)
    SELECT s.mint, points, round(CASE WHEN isnan(slope) THEN NULL ELSE slope END, 6) AS slope, round(theil_sen, 6) AS theil_sen, round(CASE WHEN points >= 4 THEN s2 - s1 END, 6) AS acceleration,
           CASE WHEN points < 3 THEN 'unknown' WHEN sd / abs(nullif(mu, 0)) > 0.3 THEN 'volatile' WHEN abs(slope) < 0.1 * sd THEN 'stable' WHEN slope > 0 THEN 'rising' ELSE 'falling' END AS trend
    FROM s LEFT JOIN t ON t.mint = s.mint""",
    "nearest_view": """WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), v AS (SELECT * FROM events WHERE event_type = 'view'),
    j AS (SELECT p.event_id, v.event_id AS view_id, abs(epoch_us(p.ts) - epoch_us(v.ts)) / 1000000.0 AS d, v.ts FROM p JOIN v ON p.user_id = v.user_id WHERE abs(epoch_us(p.ts) - epoch_us(v.ts)) <= 21600000000),
    b AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY d, ts) = 1)
    SELECT p.event_id, b.view_id, round(b.d, 6) AS distance_s FROM p LEFT JOIN b ON b.event_id = p.event_id""",
    "interpolated_values": """WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), v AS (SELECT * FROM events WHERE event_type = 'view'),
    b AS (SELECT p.*, v.ts AS t0, v.value AS v0 FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts),
    c AS (SELECT b.*, v.ts AS t1, v.value AS v1 FROM b ASOF LEFT JOIN v ON b.user_id = v.user_id AND b.ts <= v.ts)
    SELECT event_id, round(coalesce(v0 + (v1 - v0) * (epoch_us(ts) - epoch_us(t0)) / nullif(epoch_us(t1) - epoch_us(t0), 0), v0, v1), 6) AS value FROM c""",
    "balance_lookback": f"""WITH {_DAYS}, e AS (SELECT max(day) AS last FROM days),
    p AS (SELECT mint, round(sum(net), 2) AS position_0, round(sum(CASE WHEN day <= last - 7 THEN net ELSE 0 END), 2) AS position_7, round(sum(CASE WHEN day <= last - 30 THEN net ELSE 0 END), 2) AS position_30 FROM days, e GROUP BY mint)
    SELECT mint, position_0, round(CASE WHEN position_7 <> 0 THEN (position_0 - position_7) / position_7 WHEN position_0 > 0 THEN 1.0 ELSE 0.0 END, 6) + 0.0 AS delta_7,
           round(CASE WHEN position_30 <> 0 THEN (position_0 - position_30) / position_30 WHEN position_0 > 0 THEN 1.0 ELSE 0.0 END, 6) + 0.0 AS delta_30 FROM p""",
    "price_regimes": """WITH prices AS (SELECT l_suppkey AS grp, CAST(l_shipdate AS DATE) AS day, avg(l_extendedprice / l_quantity) AS price FROM lineitem WHERE l_quantity > 0 GROUP BY ALL),
    r AS (SELECT grp, day, price / lag(price) OVER (PARTITION BY grp ORDER BY day) - 1 AS r FROM prices),
    m AS (SELECT grp, strftime(day, '%Y-%m') AS month, round(stddev_pop(r) * sqrt(252.0), 6) AS volatility FROM r WHERE r IS NOT NULL GROUP BY ALL HAVING count(*) >= 2)
    SELECT grp, month, volatility, round((rank() OVER (PARTITION BY grp ORDER BY volatility) - 1 + count(*) OVER (PARTITION BY grp ORDER BY volatility RANGE UNBOUNDED PRECEDING) + 1) * 50.0 / count(*) OVER (PARTITION BY grp), 4) AS percentile FROM m""",
}
