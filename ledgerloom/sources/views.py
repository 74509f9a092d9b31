"""Cleaned views of the delivered tables, on which the analytical operators work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.rolling import latest_by
from ledgerloom.operators.snapshots import trim_space
from ledgerloom.sources.tables import table


def balance_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``wallet``, ``mint``, ``at``, ``id``, ``balance``: the restated amount where ``ui_amount`` is null or NaN."""
    ui = F.col("ui_amount")
    restated = F.col("raw_amount").cast("double") / F.pow(F.lit(10.0), F.col("decimals"))
    return table(spark, sf_dir, "wallet_balances").select(
        trim_space(F.col("wallet_address")).alias("wallet"), F.col("token_mint").alias("mint"), F.col("fetched_at").alias("at"), "id",
        F.when(ui.isNull() | F.isnan(ui), restated).otherwise(ui).alias("balance"),
    )


def holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``wallet``, ``mint``, ``balance`` above zero: the last delivered row of each holding."""
    last = F.max(F.struct("at", "id", "balance"))
    rows = balance_rows(spark, sf_dir).groupBy("wallet", "mint").agg(last.alias("r"))
    return rows.select("wallet", "mint", F.col("r.balance").alias("balance")).where("balance > 0")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``signature``, ``wallet``, ``mint``, ``ts``, ``amount`` (signed, not zero): newest row of each signature; (ts, signature) is a total order."""
    kept = latest_by(
        table(spark, sf_dir, "sweenee_transactions").where(F.col("signature").isNotNull()), "signature", "cached_at",
        ["block_time", "wallet_address", "amount_change", "token_mint"],
    )
    amount = F.col("amount_change")
    return kept.where(F.col("block_time").isNotNull() & amount.isNotNull() & ~F.isnan(amount) & (amount != 0)).select(
        "signature", F.col("wallet_address").alias("wallet"), F.col("token_mint").alias("mint"), F.col("block_time").alias("ts"), amount.alias("amount")
    )


def funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src``, ``dst``, ``ts``: each wallet's funder by its newest row."""
    best = F.max(F.struct(F.col("created_at").alias("c"), F.col("funded_by_id").alias("src"), F.col("first_funded_at").alias("ts")))
    rows = table(spark, sf_dir, "wallets").groupBy("id").agg(best.alias("b"))
    return rows.where(F.col("b.src").isNotNull()).select(F.col("b.src").alias("src"), F.col("id").alias("dst"), F.col("b.ts").alias("ts"))


#: The same views for DuckDB, as common table expressions.
HOLDERS = r"""
    balance_rows AS (
      SELECT regexp_replace(wallet_address, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS wallet, token_mint AS mint, fetched_at AS fetched, id,
             CASE WHEN ui_amount IS NULL OR isnan(ui_amount) THEN raw_amount / pow(10.0, decimals) ELSE ui_amount END AS balance
      FROM wallet_balances),
    holders AS (
      SELECT wallet, mint, balance FROM (
        SELECT * FROM balance_rows QUALIFY row_number() OVER (PARTITION BY wallet, mint ORDER BY fetched DESC, id DESC) = 1)
      WHERE balance > 0)"""
TRADES = """
    trades AS (
      SELECT signature, wallet_address AS wallet, token_mint AS mint, block_time AS ts, amount_change AS amount FROM (
        SELECT * FROM sweenee_transactions WHERE signature IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY signature ORDER BY cached_at DESC NULLS LAST, block_time DESC NULLS LAST, wallet_address DESC NULLS LAST,
                                   amount_change DESC NULLS LAST, token_mint DESC NULLS LAST) = 1)
      WHERE block_time IS NOT NULL AND amount_change IS NOT NULL AND NOT isnan(amount_change) AND amount_change <> 0)"""
FUNDING = """
    funding AS (
      SELECT funded_by_id AS src, id AS dst, first_funded_at AS ts FROM (
        SELECT * FROM wallets
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST, funded_by_id DESC NULLS LAST, first_funded_at DESC NULLS LAST) = 1)
      WHERE funded_by_id IS NOT NULL)"""
