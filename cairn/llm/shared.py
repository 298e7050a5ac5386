"""Helpers of the training-data operators: batches, materialised tables, row ids, components.

Intermediate results are cut from their lineage by writing Parquet below the folder that the
cluster names in ``spark.checkpoint.dir``.  Losing an executor therefore never loses them, and a
join that reads them has a plain shuffle on both sides, which adaptive execution may split if a
key is hot.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn import session
from cairn.session import discard, fresh_dir

__all__ = ["components", "discard", "fresh_dir", "give_back", "materialize", "numbered", "ship", "slices"]

#: Rows and bytes that go to Python at once: texts are long, and a batch is in memory on both sides.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
NARROW = 16
SLICE_ROWS, SLICE_BYTES = 512, 2 << 20


def ship(spark: SparkSession) -> None:
    """Give the executors this package, and keep the session's Arrow batches small (never larger than they were)."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if not 0 < int(str(spark.conf.get(key)).removesuffix("b")) <= most:
            spark.conf.set(key, str(most))
    session.ship(spark)


def slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most SLICE_ROWS rows and about SLICE_BYTES bytes in column ``text``; one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and (i - start >= SLICE_ROWS or held + n > SLICE_BYTES):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if len(sizes) > start:
            yield batch.slice(start)


def give_back() -> None:
    """At the end of a task that needed much memory: return what is free, as the worker stays for other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def materialize(df: DataFrame, label: str, narrow: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    ``narrow``: rows of a few numbers, made behind a shuffle.  They are written by a sixteenth as many
    tasks as there are shuffle partitions (eight at least), as many small files cost more than their content.
    """
    if narrow:
        df = df.coalesce(max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // NARROW))
    return session.stored(df, label)


def numbered(df: DataFrame, name: str, label: str) -> DataFrame:
    """``df`` stored once with a unique number per row, so that every later read sees the same numbers."""
    return materialize(df.withColumn(name, F.monotonically_increasing_id()), label)


def components(edges: DataFrame, a: str, b: str, label: str = "components") -> DataFrame:
    """Connected components of an undirected graph: rows ``(node, root)``, root the least node.

    Each round every node takes the neighbour (or itself) of the least hash as its label and the
    graph is contracted along the labels, so a chain shrinks by a constant factor whatever the
    order of its ids.  Neighbourhoods are only ever reduced by ``min`` with map-side combining; no
    list of neighbours is built and nothing is collected.
    """
    lo, hi = F.least(a, b), F.greatest(a, b)
    graph = edges.where(F.col(a) != F.col(b)).select(lo.alias("u"), hi.alias("v")).distinct()
    graph = materialize(graph, f"{label}-edges", narrow=True)
    maps: list[DataFrame] = []
    while not graph.isEmpty():
        both = graph.union(graph.select(F.col("v").alias("u"), F.col("u").alias("v")))
        rank = lambda c, salt=len(maps): F.struct(F.xxhash64(F.lit(salt), F.col(c)).alias("h"), F.col(c).alias("id"))
        best = both.groupBy("u").agg(F.min(rank("v")).alias("m"))
        step = materialize(best.select("u", F.least("m", rank("u"))["id"].alias("to")), f"{label}-map", narrow=True)
        maps.append(step)
        left, right = step.toDF("u", "tu"), step.toDF("v", "tv")
        moved = graph.join(left, "u").join(right, "v").where("tu != tv")
        moved = moved.select(F.least("tu", "tv").alias("u"), F.greatest("tu", "tv").alias("v")).distinct()
        old, graph = graph, materialize(moved, f"{label}-edges", narrow=True)
        discard(old)
    if not maps:
        return graph.select(F.col("u").alias("node"), F.col("v").alias("root"))
    found = maps.pop()
    while maps:
        below = found.toDF("to", "end")
        step = maps.pop()
        old, found = (found, step), materialize(step.join(below, "to", "left").select("u", F.coalesce("end", "to").alias("to")), f"{label}-map", narrow=True)
        for x in old:
            discard(x)
    least = materialize(found.groupBy("to").agg(F.min("u").alias("root")), f"{label}-roots", narrow=True)
    return materialize(found.join(least, "to").select(F.col("u").alias("node"), "root"), label, narrow=True)
