"""Streaming forms of the keyed operators over an append-only stream of versions.

Each takes a streaming DataFrame, runs it over all data available now (or as configured by the
caller's trigger) and returns the last complete result, which a sink has written to the shared folder.
State is keyed and lives in the state store, so it is partitioned and survives lost executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cairn.operators import cache
from cairn.session import fresh_dir, ship


def read(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    """An append-only Parquet folder (or file) as a stream; ``max_files`` per micro-batch is the back-pressure."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def upserted(stream: DataFrame, label: str, *keys: str) -> DataFrame:
    """Run to the end of the available data; the newest row of each key.

    Each micro-batch writes only the rows that changed, as files of its own number, so state and
    output grow with what changes, and a repeated batch replaces its files.
    """
    spark = stream.sparkSession
    folder, checkpoint = fresh_dir(spark, label), fresh_dir(spark, f"{label}-state")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{folder}/b{number}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    rows = spark.read.schema(T.StructType([*stream.schema, T.StructField("_batch", T.LongType())])).option("recursiveFileLookup", "true").parquet(folder)
    kept = F.struct(*(c for c in stream.columns if c not in keys))
    return rows.groupBy(*keys).agg(F.max_by(kept, "_batch").alias("_m")).select(*keys, "_m.*")


def evictions(stream: DataFrame, key: str, seq: str, ts: str, exp: Column, delay: str = "0 seconds") -> DataFrame:
    """``k, seq`` of entries when their time to live has passed, by event time.

    The state is one version a key.  A newer version replaces it and sets the timer anew; when the
    watermark has gone beyond the expiry, the entry is evicted and its state is gone.
    """
    ship(stream.sparkSession)
    kind = stream.schema[key].dataType.simpleString()
    micros = F.unix_micros(exp.cast("timestamp"))
    rows = stream.select(F.col(key).alias("k"), F.col(seq).cast("long").alias("seq"), F.col(ts).cast("timestamp").alias("ts"), micros.alias("exp"))

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            held = state.get
            state.remove()
            yield pd.DataFrame({"k": [keys[0]], "seq": [held[0]]})
            return
        held = state.get if state.exists else None
        for batch in batches:
            at = batch["seq"].idxmax()
            if held is None or batch["seq"][at] > held[0]:
                left = batch["exp"][at]
                held = int(batch["seq"][at]), None if pd.isna(left) else int(left)
        state.update(held)
        if held[1] is not None:  # a timer can't lie before the watermark
            state.setTimeoutTimestamp(max(-(-held[1] // 1000), state.getCurrentWatermarkMs() + 1))

    return rows.withWatermark("ts", delay).groupBy("k").applyInPandasWithState(step, f"k {kind}, seq long", "seq long, exp long", "append", GroupStateTimeout.EventTimeTimeout)


def complete(stream: DataFrame, label: str, mode: str = "complete") -> DataFrame:
    """Run to the end of the available data; the rows of the last (complete) or of all (append) batches."""
    spark = stream.sparkSession
    folder, checkpoint = fresh_dir(spark, label), fresh_dir(spark, f"{label}-state")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(folder if mode == "complete" else f"{folder}/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(folder)


def latest(stream: DataFrame, key: str, seq: str, deleted: Column, value: str) -> DataFrame:
    """``k, seq, deleted, v``: the newest version of each key so far."""
    kept = F.struct(F.col(seq).alias("seq"), deleted.alias("deleted"), F.col(value).alias("v"))
    rows = stream.groupBy(F.col(key).alias("k")).agg(F.max_by(kept, F.col(seq)).alias("m"))
    return rows.select("k", "m.*")


def expiry_buckets(stream: DataFrame, exp: Column) -> DataFrame:
    """``bucket, n``: entries by the five-second window in which they expire."""
    rows = stream.select(exp.cast("timestamp").alias("exp")).where("exp is not null")
    rows = rows.groupBy(F.window("exp", f"{cache.BUCKET_SECONDS} seconds").alias("w")).agg(F.count("*").alias("n"))
    return rows.select((F.unix_seconds("w.start") / cache.BUCKET_SECONDS).cast("long").alias("bucket0"), "n").select((F.col("bucket0") + 1).alias("bucket"), "n")


def live_entries(stream: DataFrame, key: str, seq: str, exp: Column, value: str, now: Column) -> DataFrame:
    """``k, seq, v``: each key's newest version, if it is live at ``now``.

    The state is one version a key; expiry is judged on the result, so a late version can still
    replace an expired one.
    """
    kept = F.struct(F.col(seq).alias("seq"), exp.alias("exp"), F.col(value).alias("v"))
    rows = stream.groupBy(F.col(key).alias("k")).agg(F.max_by(kept, F.col(seq)).alias("m"))
    return rows.where(cache.is_live(F.col("m.exp"), now)).select("k", "m.seq", "m.v")
