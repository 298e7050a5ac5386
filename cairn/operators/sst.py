"""Sorted tables: packing into blocks, the sparse index, value offsets and block lookups.

A block holds entries in key order, then a 4-byte offset per entry, their count and a checksum.  A
block is closed when the next entry would bring data, offsets so far and the two closing words
above the target size; the entry's own offset is not counted, so a block may be 4 bytes larger.

With entries of one size a block number is a row number divided by a constant.  Entries of several sizes
need an ordered fold, which runs inside each range partition: partitions are separate files of a
sorted table, and each begins a block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import codec
from cairn.operators import bloom, ordered
from cairn.session import ship

BLOCK_SIZE = 4096
CLOSING = 8


def per_block(entry: int, block_size: int = BLOCK_SIZE) -> int:
    """Entries of one size in a block."""
    return max(1, (block_size - CLOSING + 4) // (entry + 4))


def numbered(df: DataFrame, key: str, entry: int, block_size: int = BLOCK_SIZE) -> DataFrame:
    """``k, block_id, i`` for entries of one size."""
    n = per_block(entry, block_size)
    rows = ordered.row_numbers(df.select(F.col(key).alias("k")), "k")
    return rows.select("k", F.floor(F.col("rn") / n).cast("long").alias("block_id"), (F.col("rn") % n).cast("long").alias("i"))


def index(blocks: DataFrame, entry: int, block_size: int = BLOCK_SIZE) -> DataFrame:
    """The sparse index: ``block_id, base_key, entries, offset_start, offset_end``."""
    full = per_block(entry, block_size) * (entry + 4) + CLOSING
    rows = blocks.groupBy("block_id").agg(F.min("k").alias("base_key"), F.count("*").alias("entries"))
    start = F.col("block_id") * full
    return rows.select("*", start.alias("offset_start"), (start + F.col("entries") * (entry + 4) + CLOSING).alias("offset_end"))


def value_offsets(blocks: DataFrame, entry: int, key_size: int, block_size: int = BLOCK_SIZE) -> DataFrame:
    """``k, block_id, entry_offset, value_start``: within the block, and in the file."""
    full = per_block(entry, block_size) * (entry + 4) + CLOSING
    at = F.col("i") * entry
    return blocks.select("k", "block_id", at.alias("entry_offset"), (F.col("block_id") * full + at + 8 + key_size).alias("value_start"))


def find_block(index_: DataFrame, targets: Sequence[str]) -> DataFrame:
    """``t, block_id``: the last block whose base key is not above the target; null below all."""
    one = index_.agg(F.array(*(F.struct(F.lit(t).alias("t"), F.max(F.when(F.col("base_key") <= t, F.col("block_id"))).alias("block_id")) for t in targets)).alias("all"))
    return one.select(F.inline("all"))


def block(blocks: DataFrame, n: int) -> DataFrame:
    return blocks.where(F.col("block_id") == n)


def find_key_block(index_: DataFrame, filters: DataFrame, targets: DataFrame, h: Column) -> DataFrame:
    """``t, block_id`` for each target ``t`` (distinct) whose block's filter may hold it.

    ``index_`` has the base keys, ``filters`` the blocks' filters; ``h``: the hash of ``t``.
    """
    found = ordered.nearest(index_, "base_key", targets.select("t"), "t", below=True, or_equal=True).withColumnRenamed("k", "base_key")
    rows = found.where("base_key is not null").join(index_.select("base_key", "block_id"), "base_key").join(filters, "block_id")
    return rows.where(bloom.matches(h, F.col("filter"))).select("t", "block_id")


def get(blocks: DataFrame, index_: DataFrame, filters: DataFrame, targets: DataFrame, h: Column) -> DataFrame:
    """``t, found, v``: targets looked up through index and filters, then in the entries ``block_id, k, v`` of their blocks only."""
    where = find_key_block(index_, filters, targets, h)
    hits = where.join(blocks, (where["block_id"] == blocks["block_id"]) & (where["t"] == blocks["k"])).select("t", "v", F.lit(True).alias("found"))
    return targets.select("t").join(hits, "t", "left").select("t", F.coalesce("found", F.lit(False)).alias("found"), "v")


def pack(df: DataFrame, key: str, size: Column, block_size: int = BLOCK_SIZE, files: int | None = 1) -> DataFrame:
    """``file, block_id, base_key, entries, bytes`` by the greedy fold, streamed through each file's range.

    Files are ranges of keys, each written by a task of its own that numbers its blocks from 0.  One table is
    one file; None makes as many as there are shuffle partitions.
    """
    ship(df.sparkSession)
    files = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(key).alias("k"), size.cast("long").alias("size"))
    rows = rows.repartitionByRange(files, "k").sortWithinPartitions("k")
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        number, base, count, used, out = 0, None, 0, 0, []
        for batch in batches:
            for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if count and used + n + 4 * count + CLOSING > block_size:
                    out.append((part, number, base, count, used + 4 * count + CLOSING))
                    number, count, used = number + 1, 0, 0
                if not count:
                    base = k
                count += 1
                used += n
            if len(out) > 10_000:
                yield _blocks(out, batch.schema.field(0).type)
                out = []
            key_type = batch.schema.field(0).type
        if count:
            out.append((part, number, base, count, used + 4 * count + CLOSING))
        if out:
            yield _blocks(out, key_type)

    return rows.mapInArrow(run, f"file int, block_id long, base_key {kind}, entries long, bytes long")


def _blocks(rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), key_type, pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "block_id", "base_key", "entries", "bytes"])


def block_bytes(df: DataFrame, key: str, value: str, block_id: str = "block_id") -> DataFrame:
    """``block_id, data``: each block's bytes with offsets, count and checksum.  A block is bounded, so it may be gathered."""
    entry = codec.encode_entry(F.col(key).cast("binary"), F.col(value).cast("binary"))
    rows = df.groupBy(block_id).agg(F.array_sort(F.collect_list(F.struct(F.col(key).cast("binary").alias("k"), entry.alias("e")))).alias("all"))
    parts = F.col("all.e")
    joined = F.aggregate(parts, F.unhex(F.lit("")), lambda a, e: F.concat(a, e))
    offsets = F.aggregate(
        parts,
        F.struct(F.lit(0).cast("long").alias("at"), F.unhex(F.lit("")).alias("out")),
        lambda a, e: F.struct((a["at"] + F.octet_length(e)).alias("at"), F.concat(a["out"], codec.encode_fixed32(a["at"])).alias("out")),
    )["out"]
    body = F.concat(joined, offsets, codec.encode_fixed32(F.size(parts).cast("long")))
    return rows.select(block_id, F.concat(body, codec.encode_fixed32(F.crc32(body))).alias("data"))


def verify_block(data: Column) -> Column:
    """Whether a block's checksum holds."""
    size = F.octet_length(data)
    body = F.substring(data, F.lit(1), (size - 4).cast("int"))
    return (size >= CLOSING) & (F.crc32(body) == codec.decode_fixed32(data, size - 4))


def read_block(df: DataFrame, data: str) -> DataFrame:
    """Entries ``key, value`` of verified blocks; damaged ones give none."""
    d, size = F.col(data), F.octet_length(data)
    count = codec.decode_fixed32(d, size - 8)
    offset = lambda i: codec.decode_fixed32(d, size - 8 - 4 * (count - i))
    rows = df.where(verify_block(d)).where(count > 0).select("*", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("_i"))
    at = offset(F.col("_i"))
    entry = codec.decode_entry(F.substring(d, (at + 1).cast("int"), F.lit(1 << 30)))
    return rows.select(*(c for c in df.columns if c != data), entry["key"].alias("key"), entry["value"].alias("value"))
