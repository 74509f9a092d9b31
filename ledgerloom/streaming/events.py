"""Streaming forms of the stateful operators: declarative where Structured Streaming has the operator, keyed state where not.

Every function takes and returns streaming DataFrames; each equals its batch form on the same rows once
the stream has ended. ``run_available`` runs one over the files there are and returns what it wrote.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerloom.scratch import Scratch


def read_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 64) -> DataFrame:
    """The table as a file stream; a trigger takes at most ``files_per_trigger`` files."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    folder, leaf = path.rsplit("/", 1)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    is_dir = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    source = path if is_dir else f"{folder}/{leaf[:-1]}[{leaf[-1]}]"  # a pattern that matches the single file
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run over all available input into a table in the shared folder; its rows.

    With mode ``update`` a trigger writes the groups it changed; of a group the last written row counts, and the key
    is every column that isn't ``n`` or ``total``. State ends with the watermark, and no trigger rewrites the whole result.
    """
    spark = stream.sparkSession
    scratch = Scratch(spark, f"stream-{name}")
    out = f"{scratch.root}/out"

    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", out).outputMode("append")
    else:
        writer = stream.writeStream.outputMode("update").foreachBatch(lambda batch, i: batch.withColumn("trigger", F.lit(i).cast("long")).write.mode("overwrite").parquet(f"{out}/{i}"))
    writer.option("checkpointLocation", f"{scratch.root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(out)
    keys = [c for c in stream.columns if c not in ("n", "total")]
    rows = spark.read.schema(stream.schema.add("trigger", "long")).parquet(f"{out}/*")
    last = F.max_by(F.struct(*[c for c in stream.columns if c not in keys]), "trigger")
    return rows.groupBy(*keys).agg(last.alias("v")).select(*keys, "v.*")


def windowed_counts(events: DataFrame, time_col: str, by: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Tumbling windows with a watermark: ``start``, the group, ``n``, ``total``."""
    rows = events.withColumn("at", F.col(time_col).cast("timestamp")).withWatermark("at", late)
    return rows.groupBy(F.window("at", width).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def distinct_events(events: DataFrame, time_col: str, key: str, within: str = "10 days") -> DataFrame:
    """Each key once, whatever repeats arrive ``within`` the watermark."""
    return events.withColumn("at", F.col(time_col).cast("timestamp")).withWatermark("at", within).dropDuplicatesWithinWatermark([key]).drop("at")


def cooled_alerts(alerts: DataFrame, key: str, time_col: str, ident: str, cooldown_s: float = 3600.0, late: str = "10 days") -> DataFrame:
    """Alerts that open a pause of ``cooldown_s`` per key; others within the pause are dropped. State: the last alert's time.

    A key's rows of one trigger are sorted in memory, so triggers must be bounded (``read_stream``'s
    ``files_per_trigger``); rows that come after a trigger with newer ones find the newer state. A key's state
    ends once the watermark has passed its last alert by the pause, when it no longer matters.
    """
    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["at", "id"])
        last = state.get[0] if state.exists else -1e18
        kept = []
        for at, ident_ in zip(rows["at"], rows["id"], strict=True):
            if at - last >= cooldown_s:
                kept.append(ident_)
                last = at
        state.update((last,))
        state.setTimeoutTimestamp(max(int((last + cooldown_s) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [str(k[0])] * len(kept), "id": kept})

    timed = alerts.withColumn("__w", F.col(time_col).cast("timestamp")).withWatermark("__w", late)
    rows = timed.select("__w", F.col(key).cast("string").alias("k"), (F.unix_micros(F.col(time_col).cast("timestamp")) / 1e6).alias("at"), F.col(ident).cast("long").alias("id"))
    return rows.groupBy("k").applyInPandasWithState(run, "key string, id long", "last double", "append", GroupStateTimeout.EventTimeTimeout)


def balance_watch(changes: DataFrame, key: str, time_col: str, ident: str, amount: str, threshold: float) -> DataFrame:
    """Reports (``key``, ``id``, ``balance``) whenever the clamped running balance has moved by ``threshold`` since the last report."""
    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["at", "id"])
        balance, told = state.get if state.exists else (0.0, 0.0)
        out = []
        for ident_, a in zip(rows["id"], rows["a"], strict=True):
            balance = max(0.0, balance + a)
            if abs(balance - told) >= threshold:
                out.append((str(k[0]), ident_, round(balance, 4)))
                told = balance
        state.update((balance, told))
        yield pd.DataFrame(out, columns=["key", "id", "balance"])

    rows = changes.select(F.col(key).cast("string").alias("k"), (F.unix_micros(F.col(time_col).cast("timestamp")) / 1e6).alias("at"), F.col(ident).cast("long").alias("id"), F.col(amount).cast("double").alias("a"))
    return rows.groupBy("k").applyInPandasWithState(run, "key string, id long, balance double", "balance double, told double", "append", GroupStateTimeout.NoTimeout)
