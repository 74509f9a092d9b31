"""File sources and sinks: address lists, nested transaction records, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.numeric import is_base58


def read_addresses(spark: SparkSession, path: str, kind: str | None = None, column: str = "address") -> DataFrame:
    """``address``, ``label``: distinct base58 addresses of a text, CSV or JSON file or folder; the kind from the name unless given.

    Text: one address a line, ``#`` opens a comment. CSV and JSON: column ``column`` and, if there, ``label``. Of
    repeated addresses the least label stays. What isn't an address is left out.
    """
    kind = kind or path.rsplit(".", 1)[-1].lower()
    if kind == "txt":
        rows = spark.read.text(path).select(F.trim(F.split("value", "#")[0]).alias("address"), F.lit(None).cast("string").alias("label"))
    elif kind == "csv":
        rows = spark.read.csv(path, header=True)
    elif kind in ("json", "jsonl"):
        rows = spark.read.json(path, multiLine=kind == "json")
    else:
        raise ValueError(f"no reader for {kind}")
    if kind != "txt":
        label = F.col("label") if "label" in rows.columns else F.lit(None)
        rows = rows.select(F.trim(F.col(column)).alias("address"), label.cast("string").alias("label"))
    return rows.where(is_base58(F.col("address"))).groupBy("address").agg(F.min("label").alias("label"))


TRANSACTION = (
    "signature string, blockTime long, transaction struct<message: struct<accountKeys: array<string>>>, "
    "meta struct<err: string, preBalances: array<long>, postBalances: array<long>>"
)


def balance_changes(records: DataFrame, json_col: str = "json") -> DataFrame:
    """(``signature``, ``at``, ``account``, ``change``) of each nested transaction record: post less pre balance, no zeros, no failures."""
    t = records.select(F.from_json(json_col, TRANSACTION).alias("t")).where(F.col("t.meta.err").isNull() & F.col("t.signature").isNotNull())
    cells = F.arrays_zip(F.col("t.transaction.message.accountKeys").alias("k"), F.col("t.meta.preBalances").alias("a"), F.col("t.meta.postBalances").alias("b"))
    rows = t.select(F.col("t.signature").alias("signature"), F.timestamp_seconds("t.blockTime").alias("at"), F.explode(cells).alias("x"))
    return rows.select("signature", "at", F.col("x.k").alias("account"), (F.col("x.b") - F.col("x.a")).alias("change")).where("change <> 0")


def transfers(changes: DataFrame) -> DataFrame:
    """(``src``, ``dst``, ``amount``) per transaction: the largest payer and the largest receiver."""
    return changes.groupBy("signature", "at").agg(
        F.min_by("account", F.struct("change", "account")).alias("src"), F.max_by("account", F.struct("change", "account")).alias("dst"), F.max("change").alias("amount"), F.min("change").alias("least")
    ).where("amount > 0 and least < 0").drop("least")


def export(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Write as parquet, csv (with header) or json lines; nested columns become JSON text in csv."""
    if kind == "csv":
        df = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    getattr(writer.option("header", True) if kind == "csv" else writer, kind)(path)
