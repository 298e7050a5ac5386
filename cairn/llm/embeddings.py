"""Near-duplicate embeddings by Euclidean p-stable hashing and exact cosine checks.

Vectors are normalised, so a cosine of ``c`` is a distance of ``sqrt(2 - 2c)``.  A table's bucket
is ``PROJECTIONS`` Gaussian projections, each quantised to steps of ``WIDTH``; close vectors share
it with a probability that is known for a distance, from which follow the number of projections
(so that a bucket holds about ``FILL`` vectors that are not close, as long as ``MAX_TABLES`` tables do)
and the number of tables (so that a pair at the least cosine meets in some table with probability
``RECALL``; closer pairs do more often).  Pairs that meet are checked by their exact cosine in
double precision, and counted in the first table where they meet: earlier buckets of linked
vectors are computed again from the vectors, by sums in a fixed order, so they are the same everywhere.

Equal vectors are one entry with a count.  A bucket of more than ``BLOCK`` entries is checked as
pairs of blocks in tasks of their own.  Only ids and buckets are placed; a vector travels once to each
bucket that holds another one, in its own precision.  A group returns, per vector, its number of links and a
representative of what it reaches inside the group; no pair leaves it.

Defined results.  Null, zero, empty vectors and those with null or non-finite components link with
nothing.  Vectors of different lengths do not link.  Null ids: the row is compared; it
takes part in no component id unless all ids are null (then null; ``kept`` is false).  Repeated
rows link with each other, however many.  Empty table: empty result.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.shared import components, materialize, ship

WIDTH, FILL, RECALL, BLOCK, SEED = 2.0, 1024, 0.97, 1024, 20_111
MAX_TABLES = 64


def collision(distance: float, width: float = WIDTH) -> float:
    """Probability that one quantised projection is equal at a distance."""
    c = width / distance
    return 1 - math.erfc(c / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


def tables_for(k: int, near: float) -> int:
    return math.ceil(math.log(1 - RECALL) / math.log(1 - near**k))


def plan(n: int, cosine: float) -> tuple[int, int]:
    """Numbers of projections and of tables for ``n`` vectors."""
    near, far = collision(math.sqrt(2 - 2 * cosine)), collision(math.sqrt(2))
    k = max(4, math.ceil(math.log(n / FILL) / -math.log(far))) if n > FILL else 4
    while k > 4 and tables_for(k, near) > MAX_TABLES:
        k -= 1
    return k, tables_for(k, near)


def in_order(columns: Iterator[np.ndarray]) -> np.ndarray:
    """The sum of arrays, one after the other: the same bits whatever else is computed along with a row."""
    total = next(columns).copy()
    for x in columns:
        total += x
    return total


def units(raw: list[bytes], code: str) -> np.ndarray:
    """Normalised vectors of packed ones of equal length, a row each."""
    v = np.frombuffer(b"".join(raw), dtype=code).reshape(len(raw), -1).astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)  # no overflow in the norm
    return v / np.sqrt(in_order(v[:, i] * v[:, i] for i in range(v.shape[1])))[:, None]


def comparable(raw: bytes | None, code: str) -> bool:
    if not raw:
        return False
    v = np.frombuffer(raw, dtype=code)
    return bool(np.isfinite(v).all() and v.any())


def bucket_keys(vectors: np.ndarray, k: int, tables: int) -> np.ndarray:
    """64-bit bucket of each vector in each table."""
    dim = vectors.shape[1]
    rng = np.random.default_rng([SEED, dim])
    out = np.empty((len(vectors), tables), dtype=np.int64)
    for t in range(tables):
        normals, offsets = rng.standard_normal((dim, k)), rng.uniform(0, WIDTH, k)
        places = in_order(vectors[:, i, None] * normals[i] for i in range(dim))
        cells = np.floor((places + offsets) / WIDTH).astype(np.int64).view(np.uint64)
        with np.errstate(over="ignore"):
            h = np.full(len(vectors), dim, dtype=np.uint64)
            for i in range(k):
                h = (h ^ cells[:, i]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
        out[:, t] = h.view(np.int64)
    return out


def _packed(df: DataFrame, id_col: str, vector: str, code: str) -> DataFrame:
    """``row, id, vec``: comparable vectors packed in their precision, others null."""
    kind = "float" if code == "<f4" else "double"
    source = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(vector).cast(f"array<{kind}>").alias("v"))  # stored once with its numbers
    id_kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for v in batch.column(2):
                values = v.values
                raw = None if values is None or values.null_count or not len(values) else np.asarray(values.to_numpy(zero_copy_only=False) + 0.0, dtype=code).tobytes()
                packed.append(raw if comparable(raw, code) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["row", "id", "vec"])

    return source.mapInArrow(run, f"row long, id {id_kind}, vec binary").withColumn("digest", F.unhex(F.md5("vec")))


def _by_length(raw: list[bytes]) -> list[np.ndarray]:
    sizes = np.array([len(r) for r in raw])
    return [np.flatnonzero(sizes == n) for n in np.unique(sizes)]


def _keyed(classes: DataFrame, k: int, tables: int, code: str) -> DataFrame:
    """``cls, keys``: the buckets of each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            keys = np.empty((len(raw), tables), dtype=np.int64)
            for rows in _by_length(raw):
                keys[rows] = bucket_keys(units([raw[i] for i in rows], code), k, tables)
            ends = pa.array(np.arange(0, (len(raw) + 1) * tables, tables, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))], names=["cls", "keys"])

    return classes.select("cls", "vec").mapInArrow(run, "cls long, keys array<long>")


def check_group(vectors: np.ndarray, counts: np.ndarray, k: int, t: int, left: np.ndarray, right: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Links per vector met here first, and the least index each reaches inside the group.

    ``left`` and ``right``: indices of the two blocks, the same for one block.
    """
    near = vectors[left] @ vectors[right].T >= cosine
    same = left is right
    if same:
        np.fill_diagonal(near, False)
    label, links = np.arange(len(vectors)), np.zeros(len(vectors), dtype=np.int64)
    a, b = np.nonzero(near)
    a, b = left[a], right[b]
    if not len(a):
        return links, label
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            break
    linked = np.unique(np.concatenate([a, b]))
    keys = np.zeros((len(vectors), t), dtype=np.int64)
    keys[linked] = bucket_keys(vectors[linked], k, t)
    for at in range(0, len(a), 1 << 18):
        x, y = a[at : at + (1 << 18)], b[at : at + (1 << 18)]
        first = np.ones(len(x), dtype=bool)
        for earlier in range(t):
            first &= keys[x, earlier] != keys[y, earlier]
        np.add.at(links, x[first], counts[y[first]])
        if not same:
            np.add.at(links, y[first], counts[x[first]])
    return links, label


def _checked(placed: DataFrame, cosine: float, k: int, code: str) -> DataFrame:
    """``cls, links, root`` per entry and group, for entries with a link there."""

    def solve(numbers: np.ndarray, raw: list[bytes]) -> np.ndarray:
        """``numbers``: t, bucket, i, j, block, cls, n per row."""
        out = []
        for rows in _by_length(raw):
            rows = rows[np.argsort(numbers[rows, 5], kind="stable")]
            t, _, i, j = numbers[rows[0], :4].tolist()
            block, cls, n = (numbers[rows, c] for c in (4, 5, 6))
            left = np.flatnonzero(block == i)
            right = left if i == j else np.flatnonzero(block == j)
            if not len(left) or not len(right):
                continue
            links, label = check_group(units([raw[r] for r in rows], code), n, k, t, left, right, cosine)
            found = np.flatnonzero((links > 0) | (label != np.arange(len(label))))
            out.append(np.stack([cls[found], links[found], cls[label[found]]], axis=1))
        return np.concatenate(out) if out else np.zeros((0, 3), dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, list[bytes]]] = []  # of the group that the next batch may go on with

        def done() -> np.ndarray:
            numbers, raw = np.concatenate([x for x, _ in held]), [r for _, x in held for r in x]
            return solve(numbers, raw) if len(raw) > 1 else np.zeros((0, 3), dtype=np.int64)

        def pack(rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows[:, c]) for c in range(3)], names=["cls", "links", "root"])

        for batch in batches:
            numbers = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(7)], axis=1)
            raw = batch.column(7).to_pylist()
            starts = [0, *(np.flatnonzero((numbers[1:, :4] != numbers[:-1, :4]).any(axis=1)) + 1).tolist(), len(raw)]
            ready = []
            for a, b in zip(starts, starts[1:], strict=False):
                if held and a < b and (held[-1][0][-1, :4] != numbers[a, :4]).any():
                    ready.append(done())
                    held = []
                if a < b:
                    held.append((numbers[a:b], raw[a:b]))
            if ready:
                yield pack(np.concatenate(ready))
        if held:
            yield pack(done())

    n = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = ["t", "bucket", "i", "j"]
    return placed.repartition(n, *group).sortWithinPartitions(*group).select(*group, "block", "cls", "n", "vec").mapInArrow(run, "cls long, links long, root long")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """Per row: id, ``n_links``, ``component`` (least id reachable) and ``kept``."""
    spark = df.sparkSession
    ship(spark)
    code = "<f4" if isinstance(df.select(vector).schema[0].dataType.elementType, T.FloatType) else "<f8"
    rows = materialize(_packed(df, id_col, vector, code), "embeddings-rows")
    classes = rows.where("vec is not null").groupBy("vec").agg(F.min("row").alias("cls"), F.count("*").alias("n"), F.min("id").alias("least"), F.min("digest").alias("digest"))
    classes = materialize(classes, "embeddings-classes")
    k, tables = plan(classes.count(), cosine)
    spread = materialize(_keyed(classes, k, tables, code), "embeddings-keys").select("cls", F.posexplode("keys").alias("t", "bucket"))
    sizes = materialize(spread.groupBy("t", "bucket").agg(F.count("*").alias("size")).where("size > 1"), "embeddings-buckets", narrow=True)
    # where an entry goes, without its vector: its blocks' pairs in each bucket that holds others
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    spread = spread.join(sizes, ["t", "bucket"]).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    spread = spread.select("t", "bucket", "cls", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    spread = spread.select("t", "bucket", "cls", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    met = materialize(_checked(spread.join(classes.select("cls", "n", "vec"), "cls"), cosine, k, code), "embeddings-met")
    links = met.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = components(met.select("cls", "root"), "cls", "root", "embeddings").toDF("cls", "top")
    merged = classes.select("cls", "digest", "n", "least").join(links, "cls", "left").join(roots, "cls", "left")
    merged = materialize(merged.select("digest", "n", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("top", "cls").alias("top")), "embeddings-merged", narrow=True)
    least = materialize(merged.groupBy("top").agg(F.min("least").alias("component")), "embeddings-least", narrow=True)
    merged = materialize(merged.join(least, "top").select("digest", (F.col("links") + F.col("n") - 1).alias("n_links"), "component"), "embeddings-linked", narrow=True)
    found = rows.where("vec is not null").select("id", "digest").join(merged, "digest").select("id", "n_links", "component")
    alone = rows.where("vec is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    out = found.union(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component", F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))
