"""Queries of the general data-processing operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.hierarchy import descendants, full_paths, roots_and_depths
from ledgerloom.operators.rolling import counted_transactions, peak_days, trailing_totals
from ledgerloom.operators.snapshots import holding_changes
from ledgerloom.sources.tables import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = holding_changes(table(spark, sf_dir, "wallet_balances"))
    return changes.select("snapshot_no", "wallet_address", "token_mint", "change_kind")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roots_and_depths(table(spark, sf_dir, "wallets"), "id", "funded_by_id", "created_at")


def p5_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = full_paths(table(spark, sf_dir, "wallets"), "id", "funded_by_id", "created_at")
    return paths.withColumn("path", F.array_join("path", "/"))


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descendants(full_paths(table(spark, sf_dir, "wallets"), "id", "funded_by_id", "created_at"))


def p6_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = counted_transactions(table(spark, sf_dir, "sweenee_transactions"))
    totals = trailing_totals(counted, "wallet_address", "block_time", "amount_change")
    return totals.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = counted_transactions(table(spark, sf_dir, "sweenee_transactions"))
    return peak_days(trailing_totals(counted, "wallet_address", "block_time", "amount_change"), "wallet_address")


QUERIES = {
    "p3_found": p3_found, "p5_found": p5_found, "p5_paths": p5_paths, "p5_descendants": p5_descendants,
    "p6_found": p6_found, "p6_rolling": p6_rolling,
}

_DELIVERIES = r"""
    rows AS (
      SELECT regexp_replace(wallet_address, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS wallet_address, token_mint, id, fetched_at,
             CASE WHEN ui_amount IS NULL OR isnan(ui_amount) THEN raw_amount / pow(10.0, decimals) ELSE ui_amount END AS amount
      FROM wallet_balances),
    stepped AS (SELECT *, coalesce(fetched_at - lag(fetched_at) OVER (ORDER BY fetched_at, id) >= INTERVAL 12 HOUR, true) AS starts FROM rows),
    numbered AS (SELECT *, CAST(sum(starts::INT) OVER (ORDER BY fetched_at, id) AS INT) AS no FROM stepped),
    latest AS (
      SELECT no, wallet_address, token_mint, amount FROM numbered
      QUALIFY row_number() OVER (PARTITION BY no, wallet_address, token_mint ORDER BY fetched_at DESC, id DESC) = 1)"""

_WALK = """
    latest AS (
      SELECT id, funded_by_id FROM wallets WHERE id IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST, funded_by_id DESC NULLS LAST) = 1),
    links AS (SELECT c.id, c.funded_by_id AS up FROM latest c JOIN latest p ON p.id = c.funded_by_id),
    walk AS (
      SELECT id, up AS cur, [id, up] AS trail, id = up AS circ FROM links
      UNION ALL
      SELECT w.id, l.up, list_append(w.trail, l.up), list_contains(w.trail, l.up)
      FROM walk w JOIN links l ON l.id = w.cur WHERE NOT w.circ),
    ends AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY id ORDER BY len(trail) DESC) = 1),
    placed AS (
      SELECT id, trail, circ,
             CASE WHEN circ THEN list_min(trail[list_position(trail, cur):]) ELSE cur END AS root_id,
             CAST(CASE WHEN circ THEN -1 ELSE len(trail) - 1 END AS INT) AS tree_depth
      FROM ends)"""

_ROLLING = """
    counted AS (
      SELECT wallet_address, CAST(block_time AS DATE) AS day, amount_change FROM (
        SELECT * FROM sweenee_transactions
        QUALIFY row_number() OVER (PARTITION BY signature ORDER BY cached_at DESC, block_time DESC NULLS LAST, wallet_address DESC, amount_change DESC NULLS LAST) = 1)
      WHERE block_time IS NOT NULL AND amount_change IS NOT NULL AND NOT isnan(amount_change)),
    daily AS (SELECT wallet_address, day, sum(amount_change) AS total FROM counted GROUP BY ALL),
    span AS (SELECT wallet_address, min(day) AS a, max(day) AS b FROM daily GROUP BY ALL),
    calendar AS (SELECT wallet_address, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM span),
    filled AS (SELECT c.wallet_address, c.day, coalesce(d.total, 0) AS total FROM calendar c LEFT JOIN daily d ON d.wallet_address = c.wallet_address AND d.day = c.day),
    rolled AS (
      SELECT wallet_address, day,
             round(sum(total) OVER (PARTITION BY wallet_address ORDER BY day ROWS 6 PRECEDING), 2) + 0.0 AS total_7,
             round(sum(total) OVER (PARTITION BY wallet_address ORDER BY day ROWS 29 PRECEDING), 2) + 0.0 AS total_30
      FROM filled)"""

SQL = {
    "p3_found": f"""WITH {_DELIVERIES},
    counts AS (SELECT max(no) AS most FROM numbered),
    both_sides AS (
      SELECT coalesce(n.no, o.no + 1) AS snapshot_no, coalesce(n.wallet_address, o.wallet_address) AS wallet_address,
             coalesce(n.token_mint, o.token_mint) AS token_mint,
             CASE WHEN o.no IS NULL THEN 'added' WHEN n.no IS NULL THEN 'removed'
                  WHEN abs(n.amount - o.amount) > 1e-9 * greatest(abs(n.amount), abs(o.amount)) OR (n.amount IS NULL) <> (o.amount IS NULL) THEN 'changed' END AS change_kind
      FROM latest n FULL JOIN latest o ON o.no + 1 = n.no AND o.wallet_address = n.wallet_address AND o.token_mint = n.token_mint)
    SELECT CAST(snapshot_no AS INT) AS snapshot_no, wallet_address, token_mint, change_kind FROM both_sides, counts
    WHERE change_kind IS NOT NULL AND snapshot_no BETWEEN 2 AND most""",
    "p5_found": f"WITH RECURSIVE {_WALK} SELECT id, root_id, tree_depth FROM placed",
    "p5_paths": f"""WITH RECURSIVE {_WALK}
    SELECT id, root_id, tree_depth, CASE WHEN circ THEN NULL ELSE array_to_string(list_reverse(trail), '/') END AS path FROM placed""",
    "p5_descendants": f"""WITH RECURSIVE {_WALK}
    SELECT unnest(trail[2:]) AS ancestor_id, id, CAST(unnest(generate_series(1, len(trail) - 1)) AS INT) AS distance FROM placed WHERE NOT circ""",
    "p6_rolling": f"""WITH {_ROLLING}
    SELECT wallet_address, strftime(day, '%Y-%m-%d') AS day, total_7, round(total_7 / 7, 6) AS avg_7, total_30, round(total_30 / 30, 6) AS avg_30 FROM rolled""",
    "p6_found": f"""WITH {_ROLLING},
    long AS (SELECT wallet_address, 7 AS trailing_days, day, total_7 AS total FROM rolled UNION ALL SELECT wallet_address, 30, day, total_30 FROM rolled)
    SELECT wallet_address, CAST(trailing_days AS INT) AS trailing_days, strftime(day, '%Y-%m-%d') AS peak_day FROM long
    QUALIFY row_number() OVER (PARTITION BY wallet_address, trailing_days ORDER BY total DESC, day) = 1""",
}
