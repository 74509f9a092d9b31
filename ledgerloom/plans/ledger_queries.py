"""Queries on lots, positions over time, concentration of links, comparisons of forecasts, versions and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.numeric import tidy
from ledgerloom.operators import concentration as C
from ledgerloom.operators import evaluation as E
from ledgerloom.operators import graph as G
from ledgerloom.operators import lots as L
from ledgerloom.operators import models as M
from ledgerloom.operators import relational as R
from ledgerloom.operators import series as S
from ledgerloom.operators.ranking import ranked
from ledgerloom.plans.evaluation_queries import _LABELS, _labels
from ledgerloom.plans.series_queries import _RUN
from ledgerloom.scratch import Scratch
from ledgerloom.sources import files
from ledgerloom.sources.tables import table
from ledgerloom.sources.views import FUNDING, HOLDERS, TRADES, funding, holders, trades


def _part_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per part and day of shipping: signed quantity (returns are sales), mean unit price, its peak so far, turnover."""
    line = table(spark, sf_dir, "lineitem").where("l_quantity > 0").select("l_partkey", F.col("l_shipdate").cast("date").alias("day"), "l_quantity", "l_extendedprice", "l_returnflag")
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    days = line.groupBy("l_partkey", "day").agg(F.sum(signed).alias("a"), tidy(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 6).alias("p"), F.sum("l_extendedprice").alias("depth"))
    w = S.Window.partitionBy("l_partkey").orderBy("day")  # one row a day
    return days.withColumn("peak", F.max("p").over(w))


def _text(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in columns})


def lifo_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = L.matched_lots(_part_days(spark, sf_dir), ["l_partkey"], "day", "a", "p")
    return _text(m.select("l_partkey", "buy_day", "sell_day", F.round("matched", 4).alias("matched")), "buy_day", "sell_day")


def realised_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _part_days(spark, sf_dir)
    return _text(L.realised(L.matched_lots(d, ["l_partkey"], "day", "a", "p"), d, ["l_partkey"], "day", "peak", "depth"), "day")


def open_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _part_days(spark, sf_dir)
    return L.unrealised(d, L.matched_lots(d, ["l_partkey"], "day", "a", "p"), ["l_partkey"], "day", "a", "p")


def trade_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean trade size of the trailing hour and day of a mint, at each trade."""
    t = trades(spark, sf_dir).select("signature", "mint", "ts", F.abs("amount").alias("a"))
    out = S.rolling_ranges(t, ["mint"], "ts", "a", {"mean_1h": 3600, "mean_24h": 86_400})
    return out.select("signature", *[tidy(F.col(c), 6).alias(c) for c in ("mean_1h", "mean_24h")])


def position_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = S.daily(trades(spark, sf_dir), ["wallet", "mint"], "ts", {"net": F.col("amount")})
    held = S.running_balances(days, ["wallet", "mint"], "net").withColumn("clamped", F.round("clamped", 6))
    return S.position_profiles(held, ["wallet", "mint"], ["mint"])


def mint_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.flows(trades(spark, sf_dir), ["mint"], "amount")


def trade_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cadence(trades(spark, sf_dir), ["mint"], "ts", ["signature"])


def pair_strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.weighted_degrees(table(spark, sf_dir, "wallet_similarities").where("is_coordinated"), "wallet1", "wallet2", "combined_similarity")


def funder_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.funder_concentration(funding(spark, sf_dir))


def funding_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of (wallet, funder above it) pairs by distance, up to five steps."""
    return G.ancestors(funding(spark, sf_dir), 5).groupBy("distance").agg(F.count("*").alias("n"))


def funder_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.funder_windows(funding(spark, sf_dir))


def coordination_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "wallet_similarities").where("is_coordinated and wallet1 <> wallet2").select(F.explode(F.array("wallet1", "wallet2")).alias("wallet"))
    return G.member_share(holders(spark, sf_dir), "mint", "wallet", "balance", members)


def order_rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spearman correlation of an order's total with its customer's balance."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return E.rank_correlation(o, "o_totalprice", "c_acctbal")


def sale_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = S.daily(trades(spark, sf_dir), ["wallet", "mint"], "ts", {"net": F.col("amount")})
    return E.survival_curve(S.first_sales(S.running_balances(days, ["wallet", "mint"], "net"), ["wallet", "mint"]))


_LATE = "2025-05-15"


def confidence_ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.ks_distance(_labels(spark, sf_dir), "source_model", "p", F.col("created_at") >= _LATE)


def confidence_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's confidence against the person's as forecasts of whether both agree."""
    return E.paired_comparison(_labels(spark, sf_dir).where("not isnan(hc)"), "domain", "p", "hc", "y")


def calibration_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.split_calibration(_labels(spark, sf_dir), "domain", "created_at", "id")


def label_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.label_shift(_labels(spark, sf_dir), "domain", "human", F.col("created_at") >= _LATE)


def uncertain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.most_uncertain(_labels(spark, sf_dir), "domain", "id", "p")


def balance_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.column_health(table(spark, sf_dir, "wallet_balances"), ["raw_amount", "decimals", "ui_amount"])


def wallets_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.as_of(table(spark, sf_dir, "wallets"), ["id"], "created_at", _LATE, ["funded_by_id", "is_exchange"])


def upper_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per mint the balance in the middle, the upper of two."""
    r = ranked(holders(spark, sf_dir), ["mint"], [F.col("balance"), F.col("wallet")])
    return r.where(F.col("rank") == F.floor(F.col("size") / 2) + 1).select("mint", "size", F.round("balance", 6).alias("balance"))


_TYPES = ["signup", "view", "click", "purchase", "error"]


def ordered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replay order of all events: by day, kind, user, time and identifier."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.col("ts").cast("date").alias("day"), F.array_position(F.array(*map(F.lit, _TYPES)), F.col("event_type")).alias("kind"))
    return ranked(e, [], [F.col(c) for c in ("day", "kind", "user_id", "ts", "event_id")]).select("event_id", F.col("rank").alias("place"))


def venue_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per wallet a map of its venues to rows, as text: its keys, greatest value and size; venues are few."""
    t = table(spark, sf_dir, "sweenee_transactions").select(F.col("wallet_address").alias("wallet"), F.lower(F.trim("dex_source")).alias("venue")).where("wallet is not null and venue is not null")
    per = t.groupBy("wallet", "venue").agg(F.count("*").alias("c"))
    m = per.groupBy("wallet").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("venue", "c")))).alias("m"))
    return m.select("wallet", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("venues"), F.array_max(F.map_values("m")).alias("most"), F.size("m").alias("n"))


def discovered_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large holdings of wallets that aren't tracked yet."""
    large = holders(spark, sf_dir).where(R.meets({"balance": (">=", 1000.0)}))
    return R.without(large, "wallet", table(spark, sf_dir, "tracked_wallets").select(F.col("address").alias("wallet"))).select("wallet", "mint")


def address_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses read back from a list with comments and lines that hold none."""
    scratch = Scratch(spark, "addresses")
    t = table(spark, sf_dir, "tracked_wallets")
    lines = t.select(F.concat_ws("  # ", "address", "label").alias("value")).union(t.select(F.concat(F.lit("# "), "address"))).union(t.select(F.concat(F.lit("0OIl"), "address")))
    lines.write.text(f"{scratch.root}/list")
    return files.read_addresses(spark, f"{scratch.root}/list", "txt").select("address")


def nested_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payer, receiver and amount out of nested records of balances before and after."""
    t = trades(spark, sf_dir).withColumn("c", F.round(F.col("amount") * 100).cast("long"))
    base = F.lit(10**12)
    meta = F.struct(F.lit(None).cast("string").alias("err"), F.array(base, base).alias("preBalances"), F.array(base + F.col("c"), base - F.col("c")).alias("postBalances"))
    message = F.struct(F.struct(F.array("wallet", "mint").alias("accountKeys")).alias("message"))
    records = t.select(F.to_json(F.struct("signature", F.unix_seconds(F.col("ts").cast("timestamp")).alias("blockTime"), message.alias("transaction"), meta.alias("meta"))).alias("json"))
    return files.transfers(files.balance_changes(records)).select("signature", "src", "dst", "amount")


def exported_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens written as json lines by decimals and read again."""
    scratch = Scratch(spark, "export")
    files.export(table(spark, sf_dir, "tokens").select("id", "mint", "token_name", F.coalesce("decimals", F.lit(-1)).alias("decimals")), f"{scratch.root}/tokens", "json", ["decimals"])
    return spark.read.schema("id long, mint string, token_name string, decimals int").json(f"{scratch.root}/tokens").select("id", "mint", "token_name", "decimals")


def sale_concordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the number of a wallet's mints orders the days until it sells half of a holding."""
    t = trades(spark, sf_dir)
    days = S.daily(t, ["wallet", "mint"], "ts", {"net": F.col("amount")})
    sold = S.first_sales(S.running_balances(days, ["wallet", "mint"], "net"), ["wallet", "mint"])
    return E.concordance(sold.join(t.groupBy("wallet").agg(F.count_distinct("mint").alias("mints")), "wallet"), "duration", "event", "mints")


def projected_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.random_projection(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64, 8)


def volume_outlook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.trend_forecast(S.daily(trades(spark, sf_dir), ["mint"], "ts", {"volume": F.abs("amount")}), "mint", "volume")


def event_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.gamma_rates(table(spark, sf_dir, "events"), "event_type", "ts")


def holder_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holders of a mint in blocks of at most fifty, the largest first."""
    return G.split_blocks(holders(spark, sf_dir), "mint", [F.desc("balance"), F.col("wallet")], 50).select("mint", "wallet", "part")


def wallet_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.breadth(trades(spark, sf_dir), "wallet", "mint", "ts", "amount")


QUERIES = {f.__name__: f for f in (
    lifo_lots, realised_exits, open_positions, trade_rolling, position_profiles, mint_flows, trade_cadence, pair_strengths, funder_concentration, funding_reach, funder_windows, coordination_share,
    order_rank_correlation, sale_survival, confidence_ks, confidence_comparison, calibration_split, label_shift, uncertain_labels, balance_health, wallets_as_of, upper_medians, ordered_events,
    venue_maps, discovered_holders, address_list, nested_transfers, exported_tokens, sale_concordance, projected_vectors, volume_outlook, event_rates, holder_blocks, wallet_breadth,
)}

# A unit sold from a holding of so many was bought when the holding last grew over that number.
_LIFO = """
    d AS (SELECT l_partkey, CAST(l_shipdate AS DATE) AS day, sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS a, round(avg(l_extendedprice / l_quantity) + 1e-9, 6) AS p, sum(l_extendedprice) AS depth FROM lineitem WHERE l_quantity > 0 GROUP BY ALL),
    r AS (SELECT *, sum(a) OVER w AS s, max(p) OVER w AS peak FROM d WINDOW w AS (PARTITION BY l_partkey ORDER BY day)),
    c AS (SELECT *, CAST(s - least(min(s) OVER (PARTITION BY l_partkey ORDER BY day), 0) AS BIGINT) AS held FROM r),
    h AS (SELECT *, coalesce(lag(held) OVER (PARTITION BY l_partkey ORDER BY day), 0) AS was FROM c),
    bought AS (SELECT l_partkey, day, p, unnest(generate_series(was + 1, held)) AS unit FROM h WHERE held > was),
    sold AS (SELECT l_partkey, day, p, unnest(generate_series(held + 1, was)) AS unit FROM h WHERE was > held),
    m AS (SELECT s.l_partkey, b.day AS buy_day, s.day AS sell_day, b.p AS bp, s.p AS sp FROM sold s ASOF JOIN bought b ON s.l_partkey = b.l_partkey AND s.unit = b.unit AND s.day >= b.day)"""

SQL = {
    "lifo_lots": f"WITH {_LIFO} SELECT l_partkey, strftime(buy_day, '%Y-%m-%d') AS buy_day, strftime(sell_day, '%Y-%m-%d') AS sell_day, CAST(count(*) AS DOUBLE) AS matched FROM m GROUP BY ALL",
    "realised_exits": f"""WITH {_LIFO}, e AS (SELECT l_partkey, sell_day AS day, count(*)::DOUBLE AS sold, sum(bp) AS basis, max(sp) AS x FROM m GROUP BY ALL), j AS (SELECT e.*, peak, depth, least(0.5, 0.1 * sold * x / depth) AS slip FROM e JOIN r USING (l_partkey, day))
    SELECT l_partkey, strftime(day, '%Y-%m-%d') AS day, round(sold + 1e-9, 4) AS sold, round(basis / sold + 1e-11, 6) + 0.0 AS entry_price, round(x + 1e-11, 6) + 0.0 AS exit_price, round(sold * x - basis + 1e-7, 2) + 0.0 AS pnl, round((x - basis / sold) / (basis / sold) + 1e-11, 6) + 0.0 AS pnl_pct,
           round(x / peak + 1e-11, 6) + 0.0 AS efficiency, round(1 - x / peak + 1e-11, 6) + 0.0 AS drawdown, round((sold * x - basis) * (1 - slip) + 1e-7, 2) + 0.0 AS adjusted_pnl FROM j""",
    "open_positions": f"""WITH {_LIFO}, w AS (SELECT l_partkey, sum(CASE WHEN a > 0 THEN a ELSE 0 END) AS q, sum(CASE WHEN a > 0 THEN a * p ELSE 0 END) AS c, arg_max(p, day) AS last_price FROM d GROUP BY l_partkey),
    u AS (SELECT l_partkey, count(*) AS uq, sum(bp) AS uc FROM m GROUP BY l_partkey), t AS (SELECT l_partkey, last_price, q - coalesce(uq, 0) AS q, c - coalesce(uc, 0) AS c FROM w LEFT JOIN u USING (l_partkey))
    SELECT l_partkey, round(q + 1e-9, 4) + 0.0 AS position, round(c + 1e-7, 2) + 0.0 AS basis, round(last_price + 1e-11, 6) + 0.0 AS last_price, round(q * last_price + 1e-7, 2) + 0.0 AS value, round(q * last_price - c + 1e-7, 2) + 0.0 AS pnl, round((q * last_price - c) / c + 1e-11, 6) + 0.0 AS pnl_pct FROM t WHERE q > 1e-9""",
    "trade_rolling": f"""WITH {TRADES} SELECT signature, round(avg(abs(amount)) OVER (PARTITION BY mint ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) + 1e-9, 6) + 0.0 AS mean_1h,
    round(avg(abs(amount)) OVER (PARTITION BY mint ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) + 1e-9, 6) + 0.0 AS mean_24h FROM trades""",
    "position_profiles": f"""WITH {_RUN}, x AS (SELECT wallet, mint, day, round(clamped, 6) AS clamped FROM drawn), s AS (SELECT mint, min(day) AS a, max(day) AS z FROM x GROUP BY mint),
    p AS (SELECT wallet, mint, min(CASE WHEN clamped > 0 THEN day END) AS first, stddev_pop(clamped) AS sd, max(clamped) AS top FROM x GROUP BY ALL)
    SELECT wallet, mint, round(CASE WHEN z > a THEN (first - a) / (z - a) ELSE 0.0 END, 6) AS entry, CAST(z - first AS INT) AS holding_days, round(sd / top, 6) AS volatility FROM p JOIN s USING (mint) WHERE first IS NOT NULL""",
    "mint_flows": f"""WITH {TRADES}, t AS (SELECT mint, sum(greatest(amount, 0)) AS i, sum(greatest(-amount, 0)) AS o, count(*) AS turns, max(abs(amount)) AS largest FROM trades GROUP BY mint)
    SELECT mint, round(i, 2) AS inflow, round(o, 2) AS outflow, round(i - o, 2) + 0.0 AS net, round(CASE WHEN i + o > 0 THEN (i - o) / (i + o) ELSE 0 END, 6) + 0.0 AS imbalance, turns, round(largest, 2) AS largest FROM t""",
    "trade_cadence": f"""WITH {TRADES}, g AS (SELECT mint, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY mint ORDER BY ts, signature)) / 1000000.0 AS gap FROM trades)
    SELECT mint, count(*) AS n, round(avg(gap), 4) AS mean_gap_s, round(CASE WHEN count(gap) >= 2 AND avg(gap) > 0 THEN stddev_pop(gap) / avg(gap) END, 6) AS irregularity FROM g GROUP BY mint""",
    "pair_strengths": """WITH e AS (SELECT wallet1 AS s, wallet2 AS d, sum(combined_similarity) AS w FROM wallet_similarities WHERE is_coordinated AND wallet1 IS NOT NULL AND wallet2 IS NOT NULL AND combined_similarity IS NOT NULL AND NOT isnan(combined_similarity) GROUP BY ALL),
    x AS (SELECT s AS node, 0.0::DOUBLE AS i, w AS o FROM e UNION ALL SELECT d, w, 0.0 FROM e), t AS (SELECT node, sum(i) AS r, sum(o) AS t, max(i) AS m, sum(i * i) AS q FROM x GROUP BY node)
    SELECT node, round(r, 6) AS received, round(t, 6) AS sent, round(CASE WHEN r > 0 THEN m / r ELSE 0 END, 6) AS largest_share, round(CASE WHEN r > 0 THEN q / (r * r) ELSE 0 END, 6) AS hhi, round(r - t, 6) + 0.0 AS balance, round(CASE WHEN r + t > 0 THEN r / (r + t) ELSE 0.5 END, 6) AS ratio FROM t""",
    "funder_concentration": f"""WITH {FUNDING}, o AS (SELECT src, count(DISTINCT dst) AS c FROM funding WHERE dst IS NOT NULL GROUP BY src)
    SELECT count(*) AS funders, round(ln(sum(c)) - sum(c * ln(c)) / sum(c) + 0.0, 6) AS entropy, arg_max(src, (c, -src)) AS dominant, round(max(c) / sum(c), 6) AS share FROM o""",
    "funding_reach": f"""WITH RECURSIVE {FUNDING}, walk AS (SELECT DISTINCT dst AS node, src AS top, 1 AS k FROM funding UNION ALL SELECT w.node, f.src, w.k + 1 FROM walk w JOIN funding f ON f.dst = w.top WHERE w.k < 5),
    m AS (SELECT node, top, min(k) AS distance FROM walk WHERE node <> top GROUP BY ALL) SELECT distance, count(*) AS n FROM m GROUP BY distance""",
    "funder_windows": f"""WITH RECURSIVE {FUNDING},
    f AS (SELECT src, ts FROM funding WHERE ts IS NOT NULL),
    opened AS (SELECT src, min(ts) AS start FROM f GROUP BY src
      UNION ALL SELECT o.src, (SELECT min(ts) FROM f WHERE f.src = o.src AND f.ts > o.start + INTERVAL 1 DAY) FROM opened o WHERE EXISTS (SELECT 1 FROM f WHERE f.src = o.src AND f.ts > o.start + INTERVAL 1 DAY)),
    w AS (SELECT o.src, o.start, count(*) AS n FROM opened o JOIN f ON f.src = o.src AND f.ts >= o.start AND f.ts <= o.start + INTERVAL 1 DAY GROUP BY ALL HAVING count(*) >= 3)
    SELECT src, count(*) AS windows, max(n) AS largest, CAST(sum(n) AS BIGINT) AS funded, round(least(max(n) / 10.0, 1.0), 6) AS sync FROM w GROUP BY src""",
    "coordination_share": f"""WITH {HOLDERS}, m AS (SELECT wallet1 AS wallet FROM wallet_similarities WHERE is_coordinated AND wallet1 <> wallet2 UNION SELECT wallet2 FROM wallet_similarities WHERE is_coordinated AND wallet1 <> wallet2)
    SELECT mint, count(*) AS holders, count(m.wallet) AS members, round(coalesce(sum(CASE WHEN m.wallet IS NOT NULL THEN balance ELSE 0 END) / nullif(sum(balance), 0), 0), 6) AS share FROM holders LEFT JOIN m USING (wallet) GROUP BY mint""",
    "order_rank_correlation": """WITH x AS (SELECT o_totalprice AS a, c_acctbal AS b FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice IS NOT NULL AND c_acctbal IS NOT NULL),
    r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM x) SELECT count(*) AS n, round(corr(ra, rb), 6) AS rho FROM r""",
    "sale_survival": f"""WITH {_RUN},
    e AS (SELECT wallet, mint, min(day) AS a, max(day) AS b, min(CASE WHEN drawdown >= 0.5 - 1e-9 THEN day END) AS sold FROM drawn GROUP BY ALL),
    f AS (SELECT (sold IS NOT NULL)::INT AS event, CAST(coalesce(sold, b) - a AS INT) AS duration FROM e),
    t AS (SELECT duration, sum(event) AS d, (SELECT count(*) FROM f g WHERE g.duration >= f.duration) AS r FROM f GROUP BY duration HAVING sum(event) > 0),
    s AS (SELECT duration, r AS at_risk, CAST(d AS BIGINT) AS events, product(1 - d / r) OVER (ORDER BY duration) AS s, sum(CASE WHEN r > d THEN d / (r * (r - d)) ELSE 0 END) OVER (ORDER BY duration) AS g FROM t)
    SELECT duration, at_risk, events, round(s, 6) AS survival, round(greatest(s - 1.959964 * s * sqrt(g), 0), 6) AS low, round(least(s + 1.959964 * s * sqrt(g), 1), 6) AS high FROM s""",
    "confidence_ks": f"""WITH {_LABELS}, c AS (SELECT source_model, p, count(*) FILTER (WHERE NOT coalesce(created_at >= '{_LATE}', false)) AS a, count(*) FILTER (WHERE created_at >= '{_LATE}') AS b FROM l WHERE p IS NOT NULL GROUP BY ALL),
    r AS (SELECT source_model, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY source_model) AS na, sum(b) OVER (PARTITION BY source_model) AS nb FROM c WINDOW w AS (PARTITION BY source_model ORDER BY p))
    SELECT source_model, CAST(max(na) AS BIGINT) AS n_first, CAST(max(nb) AS BIGINT) AS n_second, round(max(CASE WHEN na > 0 AND nb > 0 THEN abs(ca / na - cb / nb) END), 6) AS ks FROM r GROUP BY source_model""",
    "confidence_comparison": f"""WITH {_LABELS}, e AS (SELECT domain, pow(p - y, 2) AS e1, pow(hc - y, 2) AS e2 FROM l WHERE p IS NOT NULL AND hc IS NOT NULL AND NOT isnan(hc) AND y IS NOT NULL)
    SELECT domain, count(*) AS n, round(avg(e1), 6) AS brier_1, round(avg(e2), 6) AS brier_2, round(avg(e1 - e2), 6) + 0.0 AS difference, round(CASE WHEN stddev_samp(e1 - e2) > 0 THEN avg(e1 - e2) / (stddev_samp(e1 - e2) / sqrt(count(*))) END, 4) AS t FROM e GROUP BY domain""",
    "calibration_split": f"""WITH {_LABELS}, r AS (SELECT domain, p, y, row_number() OVER (PARTITION BY domain ORDER BY created_at, id, p, y) AS i, count(*) OVER (PARTITION BY domain) AS n FROM l WHERE p BETWEEN 0 AND 1 AND y IS NOT NULL AND created_at IS NOT NULL),
    h AS (SELECT *, i > n // 2 AS late, least(floor(p * 10), 9) AS bin FROM r), f AS (SELECT domain, bin, avg(y) AS rate FROM h WHERE NOT late GROUP BY ALL), b AS (SELECT domain, avg(p - y) AS bias FROM h WHERE NOT late GROUP BY domain)
    SELECT domain, count(*) AS n, round(avg(pow(p - y, 2)), 6) AS raw, round(avg(pow(coalesce(rate, p) - y, 2)), 6) AS binned, round(avg(pow(least(greatest(p - coalesce(bias, 0), 0), 1) - y, 2)), 6) AS shifted
    FROM h LEFT JOIN f USING (domain, bin) LEFT JOIN b USING (domain) WHERE late GROUP BY domain""",
    "label_shift": f"""WITH {_LABELS}, c AS (SELECT domain, human, count(*) FILTER (WHERE NOT coalesce(created_at >= '{_LATE}', false)) AS a, count(*) FILTER (WHERE created_at >= '{_LATE}') AS b FROM l WHERE human IS NOT NULL GROUP BY ALL),
    x AS (SELECT domain, (a + 0.5) / (sum(a) OVER w + 0.5 * count(*) OVER w) AS q, (b + 0.5) / (sum(b) OVER w + 0.5 * count(*) OVER w) AS p FROM c WINDOW w AS (PARTITION BY domain))
    SELECT domain, round(sum(p * ln(p / q)), 6) + 0.0 AS kl, round(sum(p * ln(2 * p / (p + q)) + q * ln(2 * q / (p + q))) / 2, 6) + 0.0 AS js FROM x GROUP BY domain""",
    "uncertain_labels": f"""WITH {_LABELS} SELECT domain, id, p, CAST(place AS INT) AS place FROM (SELECT domain, id, p, row_number() OVER (PARTITION BY domain ORDER BY round(abs(p - 0.5), 9), id, p) AS place FROM l WHERE p IS NOT NULL) WHERE place <= 10""",
    "balance_health": """WITH x AS (SELECT unnest([{'c': 'raw_amount', 'v': raw_amount::DOUBLE}, {'c': 'decimals', 'v': decimals::DOUBLE}, {'c': 'ui_amount', 'v': CASE WHEN NOT isnan(ui_amount) THEN ui_amount END}], recursive := true) FROM wallet_balances)
    SELECT c AS "column", count(*) AS rows, count(*) FILTER (WHERE v IS NULL) AS nulls, count(*) FILTER (WHERE v = 0) AS zeros, count(DISTINCT v) AS distinct_values, min(v) AS least, max(v) AS greatest, count(DISTINCT v) <= 1 AS constant FROM x GROUP BY c""",
    "wallets_as_of": f"""SELECT id, funded_by_id, is_exchange FROM wallets WHERE created_at <= '{_LATE}' QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC, funded_by_id DESC NULLS LAST, is_exchange DESC NULLS LAST) = 1""",
    "upper_medians": f"""WITH {HOLDERS} SELECT mint, size, round(balance, 6) AS balance FROM (SELECT *, row_number() OVER (PARTITION BY mint ORDER BY balance, wallet) AS i, count(*) OVER (PARTITION BY mint) AS size FROM holders) WHERE i = size // 2 + 1""",
    "ordered_events": f"""SELECT event_id, row_number() OVER (ORDER BY CAST(ts AS DATE), list_position({_TYPES}, event_type), user_id, ts, event_id) AS place FROM events""",
    "venue_maps": """WITH c AS (SELECT wallet_address AS wallet, lower(trim(dex_source)) AS venue, count(*) AS c FROM sweenee_transactions WHERE wallet_address IS NOT NULL AND dex_source IS NOT NULL GROUP BY ALL)
    SELECT wallet, string_agg(venue, ',' ORDER BY venue) AS venues, max(c) AS most, CAST(count(*) AS INT) AS n FROM c GROUP BY wallet""",
    "discovered_holders": f"WITH {HOLDERS} SELECT wallet, mint FROM holders WHERE balance >= 1000 AND wallet NOT IN (SELECT address FROM tracked_wallets WHERE address IS NOT NULL)",
    "address_list": "SELECT DISTINCT address FROM tracked_wallets WHERE regexp_full_match(address, '[1-9A-HJ-NP-Za-km-z]{32,44}')",
    "nested_transfers": f"""WITH {TRADES} SELECT signature, CASE WHEN amount < 0 THEN wallet ELSE mint END AS src, CASE WHEN amount < 0 THEN mint ELSE wallet END AS dst, CAST(round(abs(amount) * 100) AS BIGINT) AS amount FROM trades WHERE round(abs(amount) * 100) > 0""",
    "exported_tokens": "SELECT id, mint, token_name, coalesce(decimals, -1) AS decimals FROM tokens",
    "sale_concordance": f"""WITH {_RUN},
    e AS (SELECT wallet, mint, min(day) AS a, max(day) AS b, min(CASE WHEN drawdown >= 0.5 - 1e-9 THEN day END) AS sold FROM drawn GROUP BY ALL), k AS (SELECT wallet, count(DISTINCT mint) AS s FROM trades GROUP BY wallet),
    f AS (SELECT (sold IS NOT NULL)::INT AS event, CAST(coalesce(sold, b) - a AS INT) AS t, s FROM e JOIN k USING (wallet)),
    p AS (SELECT count(*) FILTER (WHERE x.s > y.s) AS c, count(*) FILTER (WHERE x.s < y.s) AS d, count(*) FILTER (WHERE x.s = y.s) AS t FROM f x JOIN f y ON x.event = 1 AND y.t > x.t)
    SELECT c AS concordant, d AS discordant, t AS tied, round((c + t / 2) / (c + d + t), 6) AS c_index FROM p""",
    "projected_vectors": """WITH x AS (SELECT vec_id, i - 1 AS i, embedding[i]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i) WHERE len(embedding) = 64),
    s AS (SELECT i, j, CASE WHEN CAST('0x' || substr(md5(i || ':' || j || ':42'), 1, 8) AS BIGINT) % 2 = 1 THEN 1 ELSE -1 END AS sign FROM (SELECT unnest(range(0, 64)) AS i), (SELECT unnest(range(0, 8)) AS j))
    SELECT vec_id, CAST(j AS INT) AS axis, round(sum(v * sign) / sqrt(8) + 1e-9, 6) + 0.0 AS x FROM x JOIN s USING (i) GROUP BY vec_id, j""",
    "volume_outlook": f"""WITH {TRADES}, days AS (SELECT mint, CAST(ts AS DATE) AS day, sum(abs(amount)) AS v FROM trades GROUP BY ALL),
    l AS (SELECT *, CAST(day - max(day) OVER (PARTITION BY mint) AS DOUBLE) AS x FROM days QUALIFY row_number() OVER (PARTITION BY mint ORDER BY day DESC) <= 14)
    SELECT mint, count(*) AS points, round(regr_slope(v, x), 6) AS slope, round(regr_intercept(v, x) + regr_slope(v, x), 4) AS next_value, round(regr_r2(v, x), 6) AS r2 FROM l GROUP BY mint""",
    "event_rates": """WITH d AS (SELECT (max(epoch_us(ts)) - min(epoch_us(ts))) / 86400000000.0 AS days FROM events), t AS (SELECT event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY event_type)
    SELECT event_type, n, 1.0 + n AS shape, round(1 + days, 6) AS rate, round((1 + n) / (1 + days), 6) AS mean, round(sqrt(1 + n) / (1 + days), 6) AS deviation FROM t, d""",
    "holder_blocks": f"WITH {HOLDERS} SELECT mint, wallet, (row_number() OVER (PARTITION BY mint ORDER BY balance DESC, wallet) - 1) // 50 AS part FROM holders",
    "wallet_breadth": f"""WITH {TRADES}, p AS (SELECT wallet, mint, sum(abs(amount)) AS v FROM trades GROUP BY ALL), d AS (SELECT wallet, count(DISTINCT CAST(ts AS DATE)) AS active_days FROM trades GROUP BY wallet),
    t AS (SELECT wallet, count(*) AS items, sum(v) AS t, max(v) AS m, sum(v * v) AS q FROM p GROUP BY wallet)
    SELECT wallet, items, active_days, round(t, 2) AS turnover, round(m / t, 6) AS largest_share, round(q / (t * t), 6) AS hhi FROM t JOIN d USING (wallet)""",
}
