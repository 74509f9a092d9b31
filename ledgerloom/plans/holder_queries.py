"""Queries on holdings: concentration, baselines, tiers, churn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.numeric import brief, is_base58
from ledgerloom.operators import concentration as C
from ledgerloom.operators.snapshots import number_deliveries
from ledgerloom.sources.tables import table
from ledgerloom.sources.views import HOLDERS, balance_rows, holders


def snapshot_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.stability_scores(C.snapshot_metrics(holders(spark, sf_dir)))


def metric_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = C.snapshot_metrics(holders(spark, sf_dir)).withColumn("size_class", F.when(F.col("holder_count") >= 50, "wide").otherwise("narrow"))
    return C.fit_baseline(m, ["hhi", "entropy", "gini", "wdr"], by="size_class")


def snapshot_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.checksums(holders(spark, sf_dir))


def holder_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.percentile_tiers(holders(spark, sf_dir))


def holder_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = number_deliveries(balance_rows(spark, sf_dir), "at").where("balance > 0")
    last = rows.where("is_last").select("wallet", "mint")
    return C.churn(rows.where(F.col("snapshot_no") == 1).select("wallet", "mint").distinct(), last)


def holder_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = holders(spark, sf_dir)
    return h.groupBy("mint").agg(
        F.count("*").alias("holder_count"), F.round(F.sum("balance"), 4).alias("total"), F.max("balance").alias("largest"),
        F.max_by("wallet", F.struct("balance", "wallet")).alias("largest_wallet"),
    ).withColumn("total_brief", brief(F.col("holder_count").cast("double")))


def address_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("wallet_address")
    rows = table(spark, sf_dir, "wallet_balances").select("id", a, F.length(a).alias("n"), "raw_amount", "ui_amount", "decimals")
    problems = F.array_compact(F.array(
        F.when(~is_base58(a), F.lit("address")), F.when(F.col("ui_amount").isNull() | F.isnan("ui_amount"), F.lit("amount")),
        F.when(F.col("raw_amount") < 0, F.lit("negative")), F.when(~F.col("decimals").between(0, 18), F.lit("decimals")),
    ))
    return rows.select(F.array_join(problems, ",").alias("problems")).groupBy("problems").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (snapshot_metrics, metric_baseline, snapshot_checksum, holder_tiers, holder_churn, holder_totals, address_checks)}

_METRICS = HOLDERS + """,
    ordered AS (SELECT *, row_number() OVER (PARTITION BY mint ORDER BY balance, wallet) AS i, row_number() OVER (PARTITION BY mint ORDER BY balance DESC, wallet DESC) AS j FROM holders),
    totals AS (SELECT mint, sum(balance) AS s, count(*) AS n FROM holders GROUP BY mint),
    metrics AS (
      SELECT mint, t.n AS holder_count, round(t.s, 6) AS supply, round(sum((balance / t.s) * (balance / t.s)), 9) AS hhi,
             round(-sum(balance / t.s * ln(balance / t.s)), 6) + 0.0 AS entropy, round(2 * sum(i * balance) / (t.n * t.s) - (t.n + 1.0) / t.n, 6) + 0.0 AS gini,
             round(sum(CASE WHEN j <= 10 THEN balance END) / t.s, 6) AS wdr
      FROM ordered JOIN totals t USING (mint) GROUP BY mint, t.n, t.s)"""

SQL = {
    "snapshot_metrics": f"""WITH {_METRICS},
    every AS (SELECT avg(hhi) AS ha, stddev_pop(hhi) AS hs, avg(gini) AS ga, stddev_pop(gini) AS gs, avg(wdr) AS wa, stddev_pop(wdr) AS ws FROM metrics),
    z AS (SELECT m.*, (hhi - ha) / CASE WHEN hs > 0 THEN hs ELSE 1 END AS hz, (gini - ga) / CASE WHEN gs > 0 THEN gs ELSE 1 END AS gz, (wdr - wa) / CASE WHEN ws > 0 THEN ws ELSE 1 END AS wz FROM metrics m, every)
    SELECT mint, holder_count, supply, hhi, entropy, gini, wdr, round(hz, 5) AS hhi_z, round(gz, 5) AS gini_z, round(wz, 5) AS wdr_z,
           round(100 / (1 + exp(-0.20 * hz - 0.20 * gz - 0.25 * wz)), 4) AS stability_score FROM z""",
    "metric_baseline": f"""WITH {_METRICS},
    classed AS (SELECT *, CASE WHEN holder_count >= 50 THEN 'wide' ELSE 'narrow' END AS grp FROM metrics),
    long AS (SELECT grp, unnest(['hhi', 'entropy', 'gini', 'wdr']) AS metric, unnest([hhi, entropy, gini, wdr]) AS v FROM classed),
    fitted AS (SELECT grp, metric, avg(v) AS mean, stddev_pop(v) AS std, count(*) AS n FROM long GROUP BY GROUPING SETS ((metric, grp), (metric)))
    SELECT grp, metric, round(mean, 6) AS mean, round(CASE WHEN std > 0 THEN std ELSE 1 END, 6) AS std, n FROM fitted""",
    "snapshot_checksum": f"""WITH {HOLDERS},
    numbered AS (SELECT *, row_number() OVER (PARTITION BY mint ORDER BY wallet) AS rn, count(*) OVER (PARTITION BY mint) AS n FROM holders)
    SELECT mint, substr(sha256(mint || ':' || n || string_agg(':' || substr(wallet, 1, 8) || ':' || CAST(floor(balance) AS BIGINT), '' ORDER BY wallet)), 1, 16) AS checksum
    FROM numbered WHERE rn <= 100 GROUP BY mint, n""",
    "holder_tiers": f"""WITH {HOLDERS},
    r AS (SELECT mint, wallet, row_number() OVER (PARTITION BY mint ORDER BY balance DESC, wallet) AS rank, count(*) OVER (PARTITION BY mint) AS n FROM holders),
    p AS (SELECT *, CASE WHEN n = 1 THEN 100.0 ELSE 100.0 * (n - rank) / n END AS pct FROM r)
    SELECT mint, wallet, rank, round(pct, 6) AS percentile,
           CASE WHEN pct >= 99 THEN 'ultra' WHEN pct >= 95 THEN 'mega' WHEN pct >= 90 THEN 'whale' WHEN pct >= 75 THEN 'large' ELSE 'regular' END AS tier FROM p""",
    "holder_churn": f"""WITH {HOLDERS},
    stepped AS (SELECT *, coalesce(fetched - lag(fetched) OVER (ORDER BY fetched, id) >= INTERVAL 12 HOUR, true) AS starts FROM balance_rows),
    numbered AS (SELECT *, sum(starts::INT) OVER (ORDER BY fetched, id) AS no FROM stepped),
    a AS (SELECT DISTINCT wallet, mint FROM numbered WHERE no = 1 AND balance > 0),
    b AS (SELECT DISTINCT wallet, mint FROM numbered WHERE no = (SELECT max(no) FROM numbered) AND balance > 0)
    SELECT a.mint, count(*) AS n, count(*) FILTER (WHERE b.wallet IS NULL) AS exited, round(count(*) FILTER (WHERE b.wallet IS NULL) / count(*), 6) AS churn
    FROM a LEFT JOIN b ON a.wallet = b.wallet AND a.mint = b.mint GROUP BY a.mint""",
    "holder_totals": f"""WITH {HOLDERS}
    SELECT mint, count(*) AS holder_count, round(sum(balance), 4) AS total, max(balance) AS largest, arg_max(wallet, (balance, wallet)) AS largest_wallet,
           CASE WHEN count(*) >= 1000 THEN format('{{:.1f}}K', count(*) / 1000.0) ELSE format('{{:.1f}}', count(*) * 1.0) END AS total_brief FROM holders GROUP BY mint""",
    "address_checks": """WITH p AS (
      SELECT array_to_string(list_filter([CASE WHEN coalesce(regexp_full_match(wallet_address, '[1-9A-HJ-NP-Za-km-z]{32,44}'), false) THEN NULL ELSE 'address' END,
        CASE WHEN ui_amount IS NULL OR isnan(ui_amount) THEN 'amount' END, CASE WHEN raw_amount < 0 THEN 'negative' END,
        CASE WHEN NOT (decimals BETWEEN 0 AND 18) THEN 'decimals' END], lambda x: x IS NOT NULL), ',') AS problems FROM wallet_balances)
    SELECT problems, count(*) AS n FROM p GROUP BY problems""",
}
