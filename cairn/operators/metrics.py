"""Operational metrics as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators import cache

#: The names of the counters.
NAMES = ("hit", "miss", "keys-added", "keys-updated", "keys-evicted", "cost-added", "cost-evicted", "sets-dropped", "sets-rejected", "gets-dropped", "gets-kept")


def hits(df: DataFrame, key: str) -> DataFrame:
    """``hits, misses, hit_ratio`` of an access stream in which a key's first access misses.

    Misses are the distinct keys, so two counts do and no order is needed.
    """
    per_key = df.groupBy(key).agg(F.count("*").alias("n"))
    total = per_key.agg(F.sum(F.col("n") - 1).alias("hits"), F.count("*").alias("misses"))
    return total.select("hits", "misses", F.try_divide(F.col("hits").cast("double"), F.col("hits") + F.col("misses")).alias("hit_ratio"))


def ratios(df: DataFrame, key: str) -> DataFrame:
    """:func:`hits` and ``hit_miss_ratio``, the raw quotient of hits and misses: 0 if there are neither, infinite if only misses lack."""
    quotient = F.when(F.col("hits") + F.col("misses") == 0, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("misses")), F.lit(float("inf"))))
    return hits(df, key).select("*", quotient.alias("hit_miss_ratio"))


def of_hits(df: DataFrame, key: str) -> DataFrame:
    """``metric, value`` of the hits and misses of an access stream."""
    return hits(df, key).select(F.inline(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(c).cast("long").alias("value")) for n, c in (("hit", "hits"), ("miss", "misses"))))))


def stripes(df: DataFrame, hashed: Column, delta: Column) -> DataFrame:
    """``stripe, value``: a counter's additions by the stripe of their key's hash, ten slots apart, of which there are 25."""
    return df.groupBy((F.pmod(hashed, F.lit(25)) * 10).cast("long").alias("stripe")).agg(F.sum(delta).cast("long").alias("value"))


def of_replay(events: DataFrame) -> DataFrame:
    """``metric, value`` for every counter from the rows of an admission replay with its gets.

    Accesses reach the policy in batches of ``cache.BATCH`` a shard, so the gets of full batches are
    kept.  A table has no channel that could be full, so no get and no set is dropped.
    """
    event, cost = F.col("event"), F.col("cost")
    is_get = event.isin("hit", "miss")
    batches = events.where(is_get).groupBy("shard").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.floor(F.col("n") / cache.BATCH) * cache.BATCH), F.lit(0)).cast("long").alias("n"))
    values = {
        "hit": F.count_if(event == "hit"),
        "miss": F.count_if(event == "miss"),
        "gets-kept": F.max(batches.scalar()),
        "keys-added": F.count_if(event == "admit"),
        "keys-updated": F.count_if(event == "update"),
        "keys-evicted": F.count_if(event == "evict"),
        "cost-added": F.sum(F.when(event == "admit", cost)),
        "cost-evicted": F.sum(F.when(event == "evict", cost)),
        "sets-rejected": F.count_if(event == "reject"),
    }
    rows = F.array(*(F.struct(F.lit(n).alias("metric"), F.coalesce(values.get(n, F.lit(0)), F.lit(0)).cast("long").alias("value")) for n in NAMES))
    return events.agg(rows.alias("all")).select(F.inline("all"))


def report(metrics: DataFrame) -> DataFrame:
    """The counters, all gets and the hit ratio as one text."""
    value = lambda n: F.coalesce(F.max(F.when(F.col("metric") == n, F.col("value"))), F.lit(0))
    gets = value("hit") + value("miss")
    parts = [F.concat(F.lit(f"{n}: "), value(n).cast("string")) for n in NAMES]
    return metrics.agg(F.concat_ws(" ", *parts, F.concat(F.lit("gets-total: "), gets.cast("string")), F.concat(F.lit("hit-ratio: "), F.format_number(F.coalesce(F.try_divide(value("hit"), gets), F.lit(0.0)), 2))).alias("report"))
