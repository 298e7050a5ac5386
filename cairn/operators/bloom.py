"""Bloom filters of a fixed layout: bit positions by double hashing of a 32-bit hash.

The filter of a large key set is a table of 64-bit words, built by ``bit_or`` with map-side
combining, so no executor holds it whole; a small one can be packed into bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions import codec
from cairn.session import ship

#: Fixed values of the hash: seed and multiplier.
SEED, FACTOR = 0xBC9F1D34, 0xC6A4A793
BITS_PER_KEY = 10
#: Up to here (1 MB) a filter goes to every task as a table, and up to here (64 MB) as an array.
SMALL_BITS, LARGE_BITS = 1 << 23, 1 << 29


def probes(bits_per_key: int = BITS_PER_KEY) -> int:
    return int(bits_per_key * 0.69)


def hash_bytes(data: Column) -> Column:
    """The 32-bit hash of bytes, as a long."""
    size = F.octet_length(data)
    start = F.lit(SEED).cast("long").bitwiseXOR((size.cast("long") * FACTOR).bitwiseAND(codec.M32))
    whole = F.floor(size / 4).cast("int")

    def step(h: Column, i: Column) -> Column:
        h = codec.times32((h + codec.decode_fixed32(data, 4 * (i - 1))).bitwiseAND(codec.M32), FACTOR)
        return h.bitwiseXOR(F.shiftrightunsigned(h, 16))

    words = F.when(whole > 0, F.sequence(F.lit(1), whole)).otherwise(F.array().cast("array<int>"))
    h = F.aggregate(words, start, step)
    rest = size % 4
    at = (whole * 4).cast("int")
    tail = sum((F.when(rest > i, F.shiftleft(codec.byte_at(data, at + i), 8 * i)).otherwise(F.lit(0).cast("long")) for i in range(3)), F.lit(0).cast("long"))
    last = codec.times32((h + tail).bitwiseAND(codec.M32), FACTOR)
    return F.when(rest > 0, last.bitwiseXOR(F.shiftrightunsigned(last, 24))).otherwise(h)


def hash_int32(key: Column) -> Column:
    """The hash of a key's low four bytes, without making bytes."""
    start = (SEED ^ (4 * FACTOR)) & codec.M32
    h = codec.times32((F.lit(start) + key.cast("long").bitwiseAND(codec.M32)).bitwiseAND(codec.M32), FACTOR)
    return h.bitwiseXOR(F.shiftrightunsigned(h, 16))


def filter_bits(n: Column | int, bits_per_key: int = BITS_PER_KEY) -> Column:
    """Bits of the filter of ``n`` keys: at least 64, whole bytes."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.greatest(F.lit(64).cast("long"), F.floor((n.cast("long") * bits_per_key + 7) / 8).cast("long") * 8)


def positions(h: Column, bits: Column, k: int) -> Column:
    """The ``k`` bit positions of a hash."""
    delta = F.shiftrightunsigned(h, 17).bitwiseOR(F.shiftleft(h, 15).bitwiseAND(codec.M32))
    return F.array(*((h + i * delta).bitwiseAND(codec.M32) % bits for i in range(k)))


def build(keys: DataFrame, h: Column, bits: Column | int, k: int) -> DataFrame:
    """``word, mask``: the filter as 64-bit words."""
    bits = F.lit(bits).cast("long") if isinstance(bits, int) else bits
    rows = keys.select(F.explode(positions(h, bits, k)).alias("p"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))
    return rows.groupBy(F.floor(F.col("p") / 64).cast("long").alias("word")).agg(F.bit_or(bit).alias("mask"))


def matches(h: Column, filter_: Column) -> Column:
    """Whether a filter's bytes (bits, then the number of probes) may hold a hash: no below 2 bytes, yes above 30 probes."""
    size = F.octet_length(filter_)
    bits = ((size - 1) * 8).cast("long")
    k = codec.byte_at(filter_, size - 1)
    delta = lambda x: F.shiftrightunsigned(x, 17).bitwiseOR(F.shiftleft(x, 15).bitwiseAND(codec.M32))
    places = codec.let(h, lambda x: F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda i: (x + i * delta(x)).bitwiseAND(codec.M32) % bits))
    is_set = lambda p: F.call_function("shiftright", codec.byte_at(filter_, F.floor(p / 8).cast("int")), (p % 8).cast("int")).bitwiseAND(1) == 1
    return F.when(size < 2, F.lit(False)).when(k > 30, F.lit(True)).when(k < 1, F.lit(True)).otherwise(F.forall(places, is_set))


def may_contain(probes_: DataFrame, key: str, h: Column, words: DataFrame, bits: int, k: int) -> DataFrame:
    """``k, may_contain`` for each (distinct) key.

    The words of a filter of at most ``SMALL_BITS`` go to every task, and a probe looks up its words
    there, without a shuffle.  One of at most ``LARGE_BITS`` is collected now and goes to every task as
    an array, where numpy looks it up.  A larger one is joined word by word.
    """
    if bits <= SMALL_BITS:
        rows = probes_.select(F.col(key).alias("k"), h.alias("_h")).distinct()
        at = positions(F.col("_h"), F.lit(bits).cast("long"), k)
        rows = rows.select("k", *(at[i].alias(f"_p{i}") for i in range(k)))
        hit = F.lit(True)
        for i in range(k):
            own = F.broadcast(words.select(F.col("word").alias(f"_w{i}"), F.col("mask").alias(f"_m{i}")))
            rows = rows.join(own, F.floor(F.col(f"_p{i}") / 64).cast("long") == F.col(f"_w{i}"), "left")
            bit = F.call_function("shiftrightunsigned", F.col(f"_m{i}"), (F.col(f"_p{i}") % 64).cast("int")).bitwiseAND(1) == 1
            hit = hit & F.coalesce(bit, F.lit(False))
        return rows.select("k", hit.alias("may_contain"))
    if bits <= LARGE_BITS:
        return _looked_up(probes_.select(F.col(key).alias("k"), h.cast("long").alias("_h")).distinct(), words, bits, k)
    rows = probes_.select(F.col(key).alias("k"), F.explode(positions(h, F.lit(bits).cast("long"), k)).alias("p"))
    rows = rows.select("k", F.floor(F.col("p") / 64).cast("long").alias("word"), (F.col("p") % 64).cast("int").alias("b")).join(words, "word", "left")
    hit = F.coalesce(F.call_function("shiftrightunsigned", F.col("mask"), F.col("b")).bitwiseAND(1) == 1, F.lit(False))
    return rows.groupBy("k").agg(F.min(hit).alias("may_contain"))


def _looked_up(rows: DataFrame, words: DataFrame, bits: int, k: int) -> DataFrame:
    """``k, may_contain`` of rows ``k, _h``."""
    spark = rows.sparkSession
    ship(spark)
    found = words.select("word", "mask").toArrow()
    filled = np.zeros((bits + 63) // 64, np.int64)
    filled[found["word"].to_numpy()] = found["mask"].to_numpy()
    held = spark.sparkContext.broadcast(filled.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = held.value
        for batch in batches:
            h = pc.fill_null(batch.column(1), 0).to_numpy().astype(np.uint64)
            delta = (h >> 17) | ((h << 15) & codec.M32)
            hit = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            for i in range(k):
                p = ((h + i * delta) & codec.M32) % bits
                hit = hit & ((filter_[p >> 6] >> (p & 63)) & 1).astype(bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hit)], names=["k", "may_contain"])

    return rows.mapInArrow(run, T.StructType([rows.schema["k"], T.StructField("may_contain", T.BooleanType())]))


def pack(words: DataFrame, bits: int, k: int) -> DataFrame:
    """One row with the filter's bytes: bits, then the number of probes.  For filters of one block or file."""
    every = words.sparkSession.range(0, (bits + 63) // 64).withColumnRenamed("id", "word").join(words, "word", "left")
    whole = every.agg(F.array_sort(F.collect_list(F.struct("word", F.coalesce("mask", F.lit(0).cast("long")).alias("mask")))).alias("all"))
    data = F.unhex(F.array_join(F.transform("all", lambda w: F.hex(codec.encode_fixed64(w["mask"]))), ""))
    return whole.select(F.concat(F.substring(data, 1, bits // 8), F.unhex(F.lit(f"{k:02x}"))).alias("filter"))


def sizing(items: int, rate: float) -> tuple[int, int]:
    """Bytes and probes for a false-positive rate; a rate above 1 is a number of bytes."""
    size = int(rate) if rate > 1 else math.ceil(items * math.log(rate) / (-8 * math.log(2) ** 2))
    return size, max(1, math.ceil(size * 8 / items * math.log(2)))


def block_filters(rows: DataFrame, block: str, h: Column, bits_per_key: int = BITS_PER_KEY) -> DataFrame:
    """``block, filter``: each block's filter as bytes; a block's keys are few, so they may be gathered."""
    k = probes(bits_per_key)
    keys = rows.select(block, h.alias("_h"))
    size = F.floor((F.greatest(F.lit(64), F.count("*") * bits_per_key) + 7) / 8).cast("long")
    keys = keys.join(keys.groupBy(block).agg(size.alias("size")), block)
    spread = keys.select(block, "size", F.explode(positions(F.col("_h"), F.col("size") * 8, k)).alias("p"))
    bit = F.call_function("shiftleft", F.lit(1), (F.col("p") % 8).cast("int"))
    set_ = spread.groupBy(block, "size", F.floor(F.col("p") / 8).cast("long").alias("at")).agg(F.bit_or(bit).alias("bits"))
    whole = set_.groupBy(block, "size").agg(F.map_from_entries(F.collect_list(F.struct("at", F.lpad(F.hex("bits"), 2, "0").alias("hex")))).alias("all"))
    hexed = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("size") - 1), lambda i: F.coalesce(F.try_element_at("all", i), F.lit("00"))), "")
    return whole.select(block, F.unhex(F.concat(hexed, F.lit(f"{k:02x}"))).alias("filter"))
