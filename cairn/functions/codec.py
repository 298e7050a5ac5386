"""Byte layouts as column expressions: fixed-width integers, checksums, versions and entries.

All run inside the JVM.  Unsigned 32-bit values are longs masked with ``M32``.  Unsigned 64-bit
values are the long with the same bits; :func:`unsigned64` shows them as decimals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

M32 = (1 << 32) - 1
#: The rotation's offset in masked checksums; the types of a version.
MASK_DELTA = 0xA282EAD8
DELETION, VALUE = 0, 1


def long(c: Column | str) -> Column:
    return F.col(c).cast("long") if isinstance(c, str) else c.cast("long")


def encode_fixed32(c: Column) -> Column:
    """The low 32 bits as 4 bytes, least significant first."""
    return F.unhex(F.concat(*(F.lpad(F.hex(F.shiftright(c, 8 * i).bitwiseAND(255)), 2, "0") for i in range(4))))


def encode_fixed64(c: Column) -> Column:
    """All 64 bits as 8 bytes, least significant first."""
    return F.unhex(F.concat(*(F.lpad(F.hex(F.shiftrightunsigned(c, 8 * i).bitwiseAND(255)), 2, "0") for i in range(8))))


def byte_at(data: Column, at: Column | int) -> Column:
    """The byte at an offset from 0, as a long."""
    return F.conv(F.hex(F.substring(data, (at + 1) if isinstance(at, int) else at.cast("int") + 1, 1)), 16, 10).cast("long")


def decode_fixed(data: Column, width: int, at: Column | int = 0) -> Column:
    """``width`` bytes from an offset, least significant first.  Eight bytes give the long of the same bits."""
    start = F.lit(at + 1) if isinstance(at, int) else (at + 1).cast("int")
    ordered = let(
        F.hex(F.substring(data, start, F.lit(width))), lambda digits: F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(width))))
    )
    if width < 8:
        return F.conv(ordered, 16, 10).cast("long")
    return let(ordered, lambda x: F.shiftleft(F.conv(F.substring(x, 1, 8), 16, 10).cast("long"), 32).bitwiseOR(F.conv(F.substring(x, 9, 8), 16, 10).cast("long")))


def decode_fixed32(data: Column, at: Column | int = 0) -> Column:
    return decode_fixed(data, 4, at)


def decode_fixed64(data: Column, at: Column | int = 0) -> Column:
    return decode_fixed(data, 8, at)


def read_exact(data: Column, at: Column | int, n: Column | int) -> Column:
    """``n`` bytes from an offset; raises where the data ends before."""
    at, n = (F.lit(x) if isinstance(x, int) else x for x in (at, n))
    part = F.substring(data, (at + 1).cast("int"), n.cast("int"))
    return F.when((at < 0) | (n < 0) | (at + n > F.octet_length(data)), F.raise_error(F.lit("read beyond the end"))).otherwise(part)


def unsigned64(c: Column) -> Column:
    """A long's bits as an unsigned number."""
    wide = c.cast("decimal(20,0)")
    return F.when(c < 0, (wide + F.lit("18446744073709551616").cast("decimal(20,0)")).cast("decimal(20,0)")).otherwise(wide)


def mask_crc(c: Column) -> Column:
    """A stored checksum: rotated by 15 bits and moved by a constant."""
    rotated = F.shiftrightunsigned(c, 15).bitwiseOR(F.shiftleft(c, 17).bitwiseAND(M32))
    return (rotated + MASK_DELTA).bitwiseAND(M32)


def unmask_crc(c: Column) -> Column:
    rotated = (c - MASK_DELTA).bitwiseAND(M32)
    return F.shiftrightunsigned(rotated, 17).bitwiseOR(F.shiftleft(rotated, 15).bitwiseAND(M32))


def tag(seq: Column, kind: Column) -> Column:
    """Sequence and type of a version in one long."""
    return F.shiftleft(seq.cast("long"), 8).bitwiseOR(kind.cast("long"))


def tag_seq(c: Column) -> Column:
    return F.shiftrightunsigned(c, 8)


def tag_kind(c: Column) -> Column:
    """0 for a deletion; any other type reads as a value."""
    return F.when(c.bitwiseAND(255) == DELETION, DELETION).otherwise(VALUE)


def encode_version(key: Column, tag_: Column, value: Column) -> Column:
    """``u32 key size + 8, key, u64 tag, u32 value size, value``; raises on an empty key."""
    data = F.concat(encode_fixed32((F.octet_length(key) + 8).cast("long")), key, encode_fixed64(tag_), encode_fixed32(F.octet_length(value).cast("long")), value)
    return F.when(F.octet_length(key) == 0, F.raise_error(F.lit("empty key"))).otherwise(data)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def decode_version(data: Column) -> Column:
    """Struct ``status, key, seq, kind, value``; status OK or CODEC_ERROR, then the rest is null."""
    size = F.octet_length(data)

    def fields(sizes: Column) -> Column:
        k, v = sizes["k"], sizes["v"]
        ok = F.coalesce((k > 8) & (size >= 8 + k + v), F.lit(False))
        parts = F.struct(
            F.lit("OK").alias("status"),
            F.substring(data, F.lit(5), (k - 8).cast("int")).alias("key"),
            decode_fixed64(data, k - 4).alias("tag"),
            F.substring(data, (9 + k).cast("int"), v.cast("int")).alias("value"),
        )
        return F.when(ok, parts)

    def shape(x: Column) -> Column:
        return F.struct(
            F.coalesce(x["status"], F.lit("CODEC_ERROR")).alias("status"),
            x["key"].alias("key"),
            tag_seq(x["tag"]).alias("seq"),
            F.when(x["tag"].isNotNull(), tag_kind(x["tag"])).alias("kind"),
            x["value"].alias("value"),
        )

    key_size = F.when(size >= 4, decode_fixed32(data))
    value_size = lambda k: F.when((size >= 8 + k) & (k > 8), decode_fixed32(data, 4 + k))
    sizes = let(key_size, lambda k: F.struct(k.alias("k"), value_size(k).alias("v")))
    return let(let(sizes, fields), shape)


def version_layout(key: Column, value: Column) -> dict[str, Column]:
    """Sizes and offsets inside an encoded version."""
    k, v = F.octet_length(key).cast("long"), F.octet_length(value).cast("long")
    return {"key_size": k + 8, "value_size": v, "tag_offset": k + 4, "value_offset": k + 16, "total": k + v + 16}


def entry_size(key: Column, value: Column) -> Column:
    """Bytes of a block entry: two sizes, key and value."""
    return (F.octet_length(key) + F.octet_length(value) + 8).cast("long")


def encode_entry(key: Column, value: Column) -> Column:
    return F.concat(encode_fixed32(F.octet_length(key).cast("long")), encode_fixed32(F.octet_length(value).cast("long")), key, value)


def decode_entry(data: Column) -> Column:
    """Struct ``key, value`` of a block entry."""
    k, v = decode_fixed32(data), decode_fixed32(data, 4)
    return F.struct(F.substring(data, F.lit(9), k.cast("int")).alias("key"), F.substring(data, (9 + k).cast("int"), v.cast("int")).alias("value"))


def cache_key(c: Column) -> Column:
    """A 64-bit id and eight zero bytes."""
    return F.concat(encode_fixed64(c), F.unhex(F.lit("00" * 8)))


def key_hash(c: Column, integral: bool) -> tuple[Column, Column]:
    """Key and conflict hash of a cache key: integers are their own hash with conflict 0."""
    if integral:
        return c.cast("long"), F.lit(0).cast("long")
    return F.xxhash64(c), F.hash(c).cast("long")


def times32(a: Column, factor: int) -> Column:
    """``a * factor`` modulo 2 ** 32 for unsigned 32-bit values, in halves that stay below 2 ** 63."""
    high = (F.shiftrightunsigned(a, 16) * factor).bitwiseAND(0xFFFF)
    return (F.shiftleft(high, 16) + a.bitwiseAND(0xFFFF) * factor).bitwiseAND(M32)
