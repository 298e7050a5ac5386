"""Versioned entries: newest version wins, deletions hide a key; sets with insert-if-absent.

A version is ``key, seq`` and a value or a deletion mark.  The newest version of a key is an aggregate
(``max_by``), so versions combine before the shuffle and a hot key needs no large group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import codec
from cairn.operators import ordered


def versions(df: DataFrame, key: str, seq: str, deleted: Column, value: str) -> DataFrame:
    """``k, seq, vtype, tag, v`` for every version."""
    kind = F.when(deleted, codec.DELETION).otherwise(codec.VALUE)
    return df.select(F.col(key).alias("k"), F.col(seq).alias("seq"), kind.cast("int").alias("vtype"), codec.tag(F.col(seq), kind).alias("tag"), F.col(value).alias("v"))


def add(log: DataFrame, more: DataFrame) -> DataFrame:
    """A version log with further versions."""
    return log.unionByName(more)


def load(table: DataFrame, key: str, value: str, seq: int = 0) -> DataFrame:
    """A sorted table's entries as versions ``k, seq, vtype, tag, v``, all of one sequence: what is put later is newer."""
    return versions(table.withColumn("_seq", F.lit(seq).cast("long")), key, "_seq", F.lit(False), value)


def newest(df: DataFrame, key: str, seq: str, **columns: Column) -> DataFrame:
    """``k, seq`` and ``columns`` of each key's version of the greatest sequence."""
    kept = F.struct(F.col(seq).alias("seq"), *(c.alias(n) for n, c in columns.items()))
    return df.groupBy(F.col(key).alias("k")).agg(F.max_by(kept, F.col(seq)).alias("_m")).select("k", "_m.*")


def live(df: DataFrame, key: str, seq: str, deleted: Column, value: str) -> DataFrame:
    """``k, seq, v`` of keys whose newest version is no deletion."""
    return newest(df, key, seq, v=F.col(value), gone=deleted).where(~F.col("gone")).drop("gone")


def status(df: DataFrame, key: str, seq: str, deleted: Column, wanted: DataFrame) -> DataFrame:
    """``k, status`` for each probe of ``wanted.k``: ABSENT, DELETED or FOUND."""
    last = newest(df, key, seq, gone=deleted)
    found = F.when(F.col("gone").isNull(), "ABSENT").when(F.col("gone"), "DELETED").otherwise("FOUND")
    return wanted.join(last, "k", "left").select("k", found.alias("status"))


def insert_unique(df: DataFrame, key: str, arrival: str) -> DataFrame:
    """First arrivals: ``key`` and the least ``arrival``."""
    return df.groupBy(key).agg(F.min(arrival).alias(arrival))


def rejected(df: DataFrame, key: str, arrival: str) -> DataFrame:
    """Arrivals whose key had arrived before.

    Only first arrivals are shuffled by key, combined before; the rest is an anti-join on the unique arrival.
    """
    firsts = df.groupBy(key).agg(F.min(arrival).alias(arrival)).select(arrival)
    return df.select(arrival).join(firsts, arrival, "left_anti")


def contains(df: DataFrame, key: str, members: DataFrame, member: str) -> DataFrame:
    """``k, present`` for every key."""
    have = members.select(F.col(member).alias("k")).distinct().withColumn("_in", F.lit(True))
    return df.select(F.col(key).alias("k")).join(have, "k", "left").select("k", F.coalesce("_in", F.lit(False)).alias("present"))


def length(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.countDistinct(key).alias("n"))


def usage(df: DataFrame, key: str, value: str) -> DataFrame:
    """Entries and bytes of their encoded versions."""
    total = codec.version_layout(F.col(key), F.col(value))["total"]
    return df.agg(F.count("*").alias("n"), F.sum(total).alias("bytes"))


def previous_value(df: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    """``k, seq, v, old_v``: what each version replaces.

    Versions are in one global order by key and sequence, so the versions of a hot key are spread.
    """
    rows = df.select(F.col(key).alias("k"), F.col(seq).alias("seq"), F.col(value).alias("v"))
    rows = ordered.previous(rows, ["k", "v"], "k", "seq")
    return rows.select("k", "seq", "v", F.when(F.col("_prev.k").eqNullSafe(F.col("k")), F.col("_prev.v")).alias("old_v"))


def put(log: DataFrame | None, entries: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The write path: ``k, seq, vtype, tag, v, record`` of ``log`` (None: empty) and of ``entries`` appended to it.

    Entries get the sequences behind the last one of the log, in the order of column ``order``; a null
    value is a deletion.  ``record`` is the encoded version that goes to the log file.
    """
    last = F.lit(-1).cast("long") if log is None else log.agg(F.coalesce(F.max("seq"), F.lit(-1)).cast("long").alias("s")).scalar()
    rows = ordered.row_numbers(entries.select(F.col(key).alias("k"), F.col(value).alias("v"), F.col(order).alias("_order")), "_order")
    rows = rows.withColumn("seq", last + 1 + F.col("rn")).withColumn("vtype", F.when(F.col("v").isNull(), codec.DELETION).otherwise(codec.VALUE).cast("int"))
    rows = rows.withColumn("tag", codec.tag(F.col("seq"), F.col("vtype")))
    record = codec.encode_version(F.col("k").cast("binary"), F.col("tag"), F.coalesce(F.col("v").cast("binary"), F.unhex(F.lit(""))))
    rows = rows.select("k", "seq", "vtype", "tag", "v", record.alias("record"))
    return rows if log is None else log.unionByName(rows)
