"""Sorted tables on storage: range-partitioned, sorted Parquet with statistics and a bloom filter on the key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Compression codecs by name.
CODECS = ("snappy", "zstd", "lz4")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_sorted(df: DataFrame, path: str, key: str, files: int | None = None, codec: str = "zstd", bloom_keys: int | None = None) -> None:
    """Write a sorted table; fails if it exists.

    Files cover disjoint key ranges and row groups are sorted, so a lookup reads one row group; the
    optional bloom filter answers for absent keys.
    """
    if codec not in CODECS:
        raise ValueError(f"codec is one of {CODECS}")
    rows = (df.repartitionByRange(files, key) if files else df.repartitionByRange(key)).sortWithinPartitions(key)
    writer = rows.write.mode("errorifexists").option("compression", codec)
    if bloom_keys:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", str(bloom_keys))
    writer.parquet(path)


def open_sorted(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)
