"""Ordered key-value reads: lookups, seeks, range scans and positions in a global order.

Positions (row numbers, neighbours, running sums) are found without a single-task window and with one
shuffle of the rows: they are range-partitioned by key and sorted, one pass over each sorted
partition computes what it can see, and the rows are stored, so all later reads see the same
partition bounds.  One small row per partition then carries what lies before it.  A key with very
many rows is spread too, as long as further order columns tell its rows apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.session import ship, stored

#: Lists of probes up to this length are broadcast or unrolled; longer ones are joined as tables.
PROBE_LIMIT = 1000


def scan(df: DataFrame, key: str, value: str) -> DataFrame:
    """All entries as ``k, v``."""
    return df.select(F.col(key).alias("k"), F.col(value).alias("v"))


def get(df: DataFrame, key: str, target: object, value: str) -> DataFrame:
    """The entry of a key; the equality reaches the Parquet scan."""
    return scan(df.where(F.col(key) == F.lit(target)), key, value)


def probes(df: DataFrame, targets: Sequence[object], name: str = "k") -> DataFrame:
    """A table of probe keys, made inside the JVM."""
    kind = "string" if any(isinstance(t, str) for t in targets) else "long"
    return df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, targets)).cast(f"array<{kind}>")).alias(name))


def multi_get(df: DataFrame, key: str, wanted: DataFrame | Sequence[object], value: str) -> DataFrame:
    """``k, found, v`` for every probe.

    A short list is pushed down as a filter first; a probe table is joined as Spark sees fit.
    """
    entries = df
    if not isinstance(wanted, DataFrame):
        if len(wanted) <= PROBE_LIMIT:
            entries = df.where(F.col(key).isin(list(wanted)))
        wanted = probes(df, wanted)
    entries = entries.select(F.col(key).alias("k"), F.col(value).alias("v"), F.lit(True).alias("found"))
    return wanted.join(entries, "k", "left").select("k", F.coalesce("found", F.lit(False)).alias("found"), "v")


def _bound(df: DataFrame, key: str, targets: Sequence[str], below: bool) -> DataFrame:
    if len(targets) > PROBE_LIMIT:
        return nearest(df, key, probes(df, targets, "t"), "t", below)
    k = F.col(key)
    found = [(F.max(F.when(k < t, k)) if below else F.min(F.when(k >= t, k))) for t in targets]
    one = df.agg(F.array(*(F.struct(F.lit(t).alias("t"), c.alias("k")) for t, c in zip(targets, found, strict=True))).alias("all"))
    return one.select(F.inline("all"))


def ceiling(df: DataFrame, key: str, targets: Sequence[str]) -> DataFrame:
    """The least key of at least each target, null if none: one pass of partial aggregates."""
    return _bound(df, key, targets, below=False)


def floor_strict(df: DataFrame, key: str, targets: Sequence[str]) -> DataFrame:
    """The greatest key below each target, null if none."""
    return _bound(df, key, targets, below=True)


def first_last(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.min(key).alias("first_k"), F.max(key).alias("last_k"))


def forward(df: DataFrame, key: str, start: object, n: int, value: str) -> DataFrame:
    """The first ``n`` entries from a lower bound (a top-k, no full sort)."""
    return scan(df.where(F.col(key) >= F.lit(start)).orderBy(key).limit(n), key, value)


def backward(df: DataFrame, key: str, start: object, n: int, value: str) -> DataFrame:
    """The ``n`` entries up to an upper bound in descending order."""
    return scan(df.where(F.col(key) <= F.lit(start)).orderBy(F.desc(key)).limit(n), key, value)


# --- positions in the global order ---------------------------------------------------------


def _sorted(df: DataFrame, *keys: Column | str) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)


def ranged(df: DataFrame, *keys: Column | str) -> DataFrame:
    """``df`` in global key order with ``_part`` and ``_at``, the row's place in its partition; stored."""
    rows = _sorted(df, *keys).withColumn("_id", F.monotonically_increasing_id())
    rows = rows.withColumn("_part", F.shiftrightunsigned("_id", 33).cast("int")).withColumn("_at", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id")
    return stored(rows, "ordered")


def _passed(rows: DataFrame, added: str, step: Callable[[pa.RecordBatch, list], list[pa.Array]]) -> DataFrame:
    """One pass over each sorted partition: ``step`` returns a batch's further columns and keeps its state in a list; stored."""
    ship(rows.sparkSession)
    names = [c.split()[0].strip("`") for c in added.split(", ")]
    schema = T.StructType([*rows.schema, T.StructField("_part", T.IntegerType()), *T._parse_datatype_string(added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, state = TaskContext.get().partitionId(), []
        for batch in batches:
            if batch.num_rows:
                columns = [pa.array([part] * batch.num_rows, pa.int32()), *step(batch, state)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "_part", *names])

    return stored(rows.mapInArrow(run, schema), "ordered")


def _before(parts: DataFrame, **sums: Column) -> DataFrame:
    """Per partition, what the partitions before it add up to; one row a partition."""
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("_part", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(n) for n, c in sums.items()))


def row_numbers(df: DataFrame, *keys: Column | str, out: str = "rn") -> DataFrame:
    """``df`` with its row number (from 0) in the global key order."""
    rows = ranged(df, *keys)
    before = _before(rows.groupBy("_part").agg(F.count("*").alias("n")), _base=F.col("n"))
    return rows.join(F.broadcast(before), "_part").withColumn(out, F.col("_base") + F.col("_at")).drop("_part", "_at", "_base")


def running_sum(df: DataFrame, value: Column, *keys: Column | str, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` (a long, null: 0) over all rows up to and with this one."""
    rows = _sorted(df.withColumn("_v", F.coalesce(value.cast("long"), F.lit(0).cast("long"))), *keys)
    at = len(rows.columns) - 1

    def step(batch: pa.RecordBatch, state: list) -> list[pa.Array]:
        sums = np.cumsum(batch.column(at).to_numpy()) + (state.pop() if state else 0)
        state.append(int(sums[-1]))
        return [pa.array(sums, pa.int64())]

    rows = _passed(rows, "_upto long", step)
    before = _before(rows.groupBy("_part").agg(F.sum("_v").alias("s")), _base=F.col("s"))
    return rows.join(F.broadcast(before), "_part").withColumn(out, F.col("_upto") + F.col("_base")).drop("_part", "_upto", "_base", "_v")


def previous(df: DataFrame, columns: Sequence[str], *keys: Column | str, out: str = "_prev") -> DataFrame:
    """``df`` with ``out``: the struct of ``columns`` of the row before in the global key order, null for the first."""
    rows = _sorted(df.withColumn("_own", F.struct(*columns)), *keys)
    at, kind = len(rows.columns) - 1, rows.schema["_own"].dataType.simpleString()

    def step(batch: pa.RecordBatch, state: list) -> list[pa.Array]:
        own = batch.column(at)
        before = state.pop() if state else pa.nulls(1, own.type)
        state.append(own.slice(len(own) - 1))
        return [pa.concat_arrays([before, own.slice(0, len(own) - 1)]), pa.array(np.arange(len(own)) == (0 if before.null_count else -1))]

    rows = _passed(rows, f"_before {kind}, _first boolean", step)
    # the last row of each partition, carried to the first row of the next one that has rows
    last = rows.groupBy("_part").agg(F.max_by("_own", F.struct(*(F.col(c) if isinstance(c, str) else c for c in keys))).alias("_carry"))
    order = Window.orderBy("_part")
    last = last.select("_part", F.lag("_carry").over(order).alias("_carry"))
    rows = rows.join(F.broadcast(last), "_part")
    return rows.withColumn(out, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_before"))).drop("_part", "_own", "_before", "_first", "_carry")


def neighbours(df: DataFrame, key: str) -> DataFrame:
    """``k, prev_k, next_k``: each entry's predecessor and successor."""
    rows = _sorted(df.select(F.col(key).alias("k")), "k")
    kind = rows.schema["k"].dataType.simpleString()
    schema = f"k {kind}, p {kind}, n {kind}, _part int"
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), None  # the last key and the one before it wait for the next
        for batch in batches:
            k = batch.column(0)
            if not len(k):
                continue
            k = k if held is None else pa.concat_arrays([held[1], k])
            before = pa.concat_arrays([pa.nulls(1, k.type) if held is None else held[0], k.slice(0, len(k) - 1)])
            if len(k) > 1:
                yield pa.RecordBatch.from_arrays([k.slice(0, len(k) - 1), before.slice(0, len(k) - 1), k.slice(1), pa.array([part] * (len(k) - 1), pa.int32())], names=["k", "p", "n", "_part"])
            held = before.slice(len(k) - 1), k.slice(len(k) - 1)
        if held is not None:
            yield pa.RecordBatch.from_arrays([held[1], held[0], pa.nulls(1, held[1].type), pa.array([part], pa.int32())], names=["k", "p", "n", "_part"])

    rows = stored(rows.mapInArrow(run, schema), "ordered")
    edges = rows.groupBy("_part").agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    order = Window.orderBy("_part")  # one row a partition
    edges = edges.select("_part", F.lag("hi").over(order).alias("_prev"), F.lead("lo").over(order).alias("_next"))
    return rows.join(F.broadcast(edges), "_part").select("k", F.coalesce("p", "_prev").alias("prev_k"), F.coalesce("n", "_next").alias("next_k"))


def nearest(df: DataFrame, key: str, wanted: DataFrame, target: str, below: bool = True, or_equal: bool = False) -> DataFrame:
    """As-of join of a probe table of any size: the nearest key below (or at least) each target.

    Keys and probes are merged in one global order; a probe takes the last key before it in its
    partition, or else the last key of the partitions before.
    """
    strict = below and not or_equal
    kind = df.schema[key].dataType.simpleString()
    keys = df.select(F.col(key).alias("_k"), F.lit(None).cast(kind).alias(target), F.lit(1 if strict else 0 if below else 1).alias("_side"))
    asked = wanted.select(F.lit(None).cast(kind).alias("_k"), target, F.lit(0 if strict else 1 if below else 0).alias("_side"))
    rows = keys.unionByName(asked).withColumn("_place", F.coalesce("_k", target))
    rows = _sorted(rows, *(("_place", "_side") if below else (F.desc("_place"), F.desc("_side"))))

    def step(batch: pa.RecordBatch, state: list) -> list[pa.Array]:
        k = batch.column(0)
        k = pa.concat_arrays([state.pop() if state else pa.nulls(1, k.type), k])
        at = np.where(k.is_valid().to_numpy(zero_copy_only=False), np.arange(len(k)), 0)
        near = k.take(pa.array(np.maximum.accumulate(at)))
        state.append(near.slice(len(near) - 1))
        return [near.slice(1)]

    rows = _passed(rows, f"_near {kind}", step)
    pick = F.max if below else F.min
    edges = rows.groupBy("_part").agg(pick("_k").alias("_e"))
    edges = edges.select("_part", pick("_e").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    return rows.where(F.col("_k").isNull()).join(F.broadcast(edges), "_part").select(target, F.coalesce("_near", "_carry").alias("k"))
