"""Log framing: records in checksummed fragments inside fixed blocks, and their replay.

A fragment has a 7-byte header: masked CRC-32 of type and payload, length (2 bytes) and type (1:
full, 2: first, 3: middle, 4: last), little-endian.  A block's tail of fewer than 7 bytes is
zeros.  An empty record makes no frame.  A log is sequential by nature; several logs are framed in
parallel, each streamed in order with its offset as the only state.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import codec
from cairn.session import fresh_dir, ship, small_batches

#: Fixed values of the format: block and header sizes, fragment types.
BLOCK, HEADER = 32_768, 7
FULL, FIRST, MIDDLE, LAST = 1, 2, 3, 4
#: Rows and bytes of a batch that Python returns, rows that are Python objects at once.
ROWS, BYTES, SLICE = 1000, 4 << 20, 64


def split_sizes(size: int, offset: int, block: int = BLOCK) -> tuple[list[tuple[int, int, int, int]], int]:
    """Fragments ``(padding before, type, start, length)`` of a record of ``size`` bytes written at an offset, and the offset after."""
    out: list[tuple[int, int, int, int]] = []
    at, left = 0, offset % block
    while at < size:
        room = block - left
        padding = 0
        if room < HEADER:
            padding, left, room = room, 0, block
        n = min(size - at, room - HEADER)
        first, last = not out, at + n == size  # a first fragment may be empty
        kind = FULL if first and last else FIRST if first else LAST if last else MIDDLE
        out.append((padding, kind, at, n))
        offset += padding + HEADER + n
        left += HEADER + n
        at += n
    return out, offset


def split_record(record: bytes, offset: int, block: int = BLOCK) -> tuple[list[tuple[int, int, bytes]], int]:
    """Fragments ``(padding before, type, payload)`` of a record written at an offset, and the offset after."""
    parts, end = split_sizes(len(record), offset, block)
    return [(padding, kind, record[at : at + n]) for padding, kind, at, n in parts], end


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + codec.MASK_DELTA) & codec.M32


def write_log(records: list[bytes], offset: int = 0, block: int = BLOCK) -> bytes:
    """The bytes of records appended at an offset."""
    out = bytearray()
    for record in records:
        parts, offset = split_record(record, offset, block)
        for padding, kind, payload in parts:
            out += b"\x00" * padding + struct.pack("<IHB", masked(bytes([kind]) + payload), len(payload), kind) + payload
    return bytes(out)


def read_log(data: bytes, block: int = BLOCK, verify: bool = True) -> Iterator[tuple[str, bytes]]:
    """``(status, record)``: OK, CORRUPT (the next frame is read on) or, at the end, TRUNCATED."""
    return scan_log(io.BytesIO(data), block, verify)


def scan_log(source: BinaryIO, block: int = BLOCK, verify: bool = True) -> Iterator[tuple[str, bytes]]:
    """:func:`read_log` of an open file, a frame at a time: only the record that is put together is held."""
    at, held, open_ = 0, [], False
    while True:
        if block - at % block < HEADER:
            at += len(source.read(block - at % block))
        header = source.read(HEADER)
        if not header:
            break
        if len(header) < HEADER:
            yield "TRUNCATED", b"".join(held)
            return
        crc, n, kind = struct.unpack("<IHB", header)
        payload = source.read(n)
        if len(payload) < n:
            yield "TRUNCATED", b"".join(held)
            return
        at += HEADER + n
        if verify and crc != masked(bytes([kind]) + payload):
            held, open_ = [], False
            yield "CORRUPT", b""
            continue
        if kind in (FULL, FIRST):
            held, open_ = [payload], True
        elif kind in (MIDDLE, LAST) and open_:
            held.append(payload)
        if kind in (FULL, LAST) and open_:
            yield "OK", b"".join(held)
            held, open_ = [], False
    if open_:
        yield "TRUNCATED", b"".join(held)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of batches, of which few are Python objects at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            yield from zip(*(c.to_pylist() for c in batch.slice(start, SLICE).columns), strict=True)


def batched(rows: Iterable[tuple], schema: pa.Schema, data: str | None) -> Iterator[pa.RecordBatch]:
    """``rows`` in batches of at most ROWS rows and about BYTES bytes in column ``data`` (if there is one), one row at least."""
    make = lambda out: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
    at, out, held = schema.get_field_index(data) if data else None, [], 0
    for row in rows:
        out.append(row)
        held += len(row[at] or b"") if data else 0
        if len(out) >= ROWS or held >= BYTES:
            yield make(out)
            out, held = [], 0
    if out:
        yield make(out)


def frames(df: DataFrame, log: str, pos: str, record: str, block: int = BLOCK, offset: int = 0, payload: bool = True) -> DataFrame:
    """``log, pos, frag, begin, off, typ, len, crc, payload`` for the records of each log in order of ``pos``; ``begin``: the offset of a record's first frame.

    Without ``payload`` the last two are left out, and as sizes alone place the frames, no record is shuffled.
    """
    ship(df.sparkSession)
    small_batches(df.sparkSession)
    data = F.col(record).cast("binary")
    rows = df.select(F.col(log).cast("string").alias("log"), F.col(pos).cast("long").alias("pos"), data.alias("record") if payload else F.coalesce(F.octet_length(data), F.lit(0)).alias("size"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "log").sortWithinPartitions("log", "pos")

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        current, at = object(), offset
        for name, where, data in _rows(batches):
            if name != current:
                current, at = name, offset
            parts, end = split_sizes(len(data or b"") if payload else data, at, block)
            begin = at + parts[0][0] if parts else at
            for i, (padding, kind, start, size) in enumerate(parts):
                at += padding
                row = name, where, i, begin, at, kind, size
                if payload:
                    part = data[start : start + size]
                    row += masked(bytes([kind]) + part), part
                yield row
                at += HEADER + size
            at = end

    columns = [("log", "string"), ("pos", "long"), ("frag", "int"), ("begin", "long"), ("off", "long"), ("typ", "int"), ("len", "int"), ("crc", "long"), ("payload", "binary")]
    columns = columns if payload else columns[:-2]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    schema = pa.schema([(c, kinds[k]) for c, k in columns])
    return rows.mapInArrow(lambda batches: batched(framed(batches), schema, "payload" if payload else None), ", ".join(f"{c} {k}" for c, k in columns))


def intact(typ: Column, payload: Column, crc: Column) -> Column:
    """Whether a frame's checksum holds, without leaving the JVM."""
    kind = F.unhex(F.lpad(F.hex(typ), 2, "0"))
    return codec.unmask_crc(crc) == F.crc32(F.concat(kind, payload))


def replay(frames_: DataFrame, strict: bool = False) -> DataFrame:
    """``log, pos, status, record``: records put together from their frames.

    Frames name their record's first one, so records of one log are put together in parallel.  Status CORRUPT: a frame's checksum fails;
    TRUNCATED: the last frame is missing.  ``strict`` raises on a corrupt record.
    """
    ok = intact(F.col("typ"), F.col("payload"), F.col("crc"))
    rows = frames_.select("log", "pos", "begin", "off", "typ", "payload", ok.alias("ok"))
    whole = rows.groupBy("log", "begin").agg(
        F.min("pos").alias("pos"),
        F.min("ok").alias("ok"),
        F.max(F.col("typ").isin(FULL, LAST)).alias("ended"),
        F.array_sort(F.collect_list(F.struct("off", "payload"))).alias("parts"),
    )
    status = F.when(~F.col("ok"), F.raise_error(F.lit("corrupt frame")) if strict else F.lit("CORRUPT")).when(F.col("ended"), "OK").otherwise("TRUNCATED")
    record = F.aggregate("parts", F.unhex(F.lit("")), lambda a, p: F.concat(a, p["payload"]))
    return whole.select("log", "pos", status.alias("status"), F.when(F.col("ok") & F.col("ended"), record).alias("record"))


def read_files(spark: SparkSession, path: str, block: int = BLOCK, verify: bool = True) -> DataFrame:
    """``path, pos, status, record`` of log files, which Spark's binary file reader lists; each is read in order by one task, a frame at a time."""
    return _records(spark.read.format("binaryFile").load(path), path, block, verify)


def read_stream(spark: SparkSession, path: str, block: int = BLOCK, verify: bool = True, max_files: int | None = None) -> DataFrame:
    """The same for a folder of log files as a stream: each micro-batch has the records of files that came since."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return _records((reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path), path, block, verify)


def write_files(df: DataFrame, log: str, pos: str, record: str, folder: str, block: int = BLOCK) -> DataFrame:
    """Write each log of :func:`frames` to a file of its own in ``folder`` (a file or Hadoop URI); ``log, path, bytes``.

    The records are stored in order of log and position, dealt by ranges, so that no task sorts a
    whole log.  The task of a stored file writes the logs that begin there and follows its last log
    through the next ones.  A log's file is written under an attempt's name and moved, so a retried
    task leaves whole files only.
    """
    spark = df.sparkSession
    ship(spark)
    small_batches(spark)
    rows = df.select(F.col(log).cast("string").alias("log"), F.col(pos).cast("long").alias("pos"), F.col(record).cast("binary").alias("record")).where(F.octet_length("record") > 0)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stage = fresh_dir(spark, "log-records")
    rows = rows.repartitionByRange(n, "log", "pos").sortWithinPartitions("log", "pos").select("log", "record")
    rows.write.option("parquet.block.size", BYTES).parquet(stage)
    system, top = pafs.FileSystem.from_uri(stage)
    # named by their partitions, in this order
    found = [(int(f.base_name.split("-")[1]), f.path) for f in system.get_file_info(pafs.FileSelector(top)) if f.base_name.startswith("part-")]
    files = [path for _, path in sorted(found)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = pafs.FileSystem.from_uri(folder)
        system.create_dir(top, recursive=True)
        store = pafs.FileSystem.from_uri(stage)[0]
        for i in (i for batch in batches for i in batch.column(0).to_pylist()):
            done = list(_write_logs(store, files, i, system, top, block))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["log", "path", "bytes"])

    return spark.range(0, len(files), 1, max(1, len(files))).mapInArrow(run, "log string, path string, bytes long")


def _write_logs(store: pafs.FileSystem, files: list[str], i: int, system: pafs.FileSystem, top: str, block: int) -> Iterator[tuple[str | None, str, int]]:
    """Write the logs whose first record is in file ``i`` of the ordered ``files``; log, path and bytes of each."""

    def rows(path: str) -> Iterator[tuple[str | None, bytes]]:
        with store.open_input_file(path) as source:
            yield from _rows(pq.ParquetFile(source, buffer_size=1 << 20).iter_batches(SLICE))

    def last(path: str) -> list[str | None]:
        with store.open_input_file(path) as source:
            table = pq.ParquetFile(source)
            return table.read_row_group(table.num_row_groups - 1, ["log"]).column(0)[-1:].to_pylist() if table.metadata.num_rows else []

    before: list[str | None] = next((x for path in reversed(files[:i]) if (x := last(path))), [])
    current: list[str | None] = []  # the open log, if any
    sink, at, partial = None, 0, ""

    def close() -> tuple[str | None, str, int]:
        sink.close()
        name = b"\xff" if current[0] is None else current[0].encode()  # no text has this byte
        final = f"{top}/{hashlib.sha256(name).hexdigest()[:24]}.log"
        system.move(partial, final)
        return current[0], final, at

    for j in range(i, len(files)):
        for name, data in rows(files[j]):
            if [name] != current:
                if j > i:  # the next log is another task's
                    break
                if [name] == before:
                    continue
                if sink is not None:
                    yield close()
                current, at, partial = [name], 0, f"{top}/.{uuid.uuid4().hex}.part"
                sink = system.open_output_stream(partial, buffer_size=1 << 20)
            parts, end = split_record(data, at, block)
            for padding, kind, payload in parts:
                sink.write(b"\x00" * padding + struct.pack("<IHB", masked(bytes([kind]) + payload), len(payload), kind) + payload)
            at = end
        else:
            if sink is not None:
                continue
        break
    if sink is not None:
        yield close()


def _uri(path: str) -> str:
    """A path as Spark names it, for pyarrow."""
    return quote(path, safe="/:@")


def _streams(spark: SparkSession, path: str) -> bool:
    """Whether pyarrow finds the files of a path that Spark reads: not in every store."""
    name = spark._jvm.org.apache.hadoop.fs.Path(re.split(r"[*?\[{]", path)[0].rpartition("/")[0] if re.search(r"[*?\[{]", path) else path)
    try:
        system, top = pafs.FileSystem.from_uri(_uri(name.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(name).toString()))
        return system.get_file_info(top).type != pafs.FileType.NotFound
    except (pa.ArrowException, OSError):
        return False


def _records(files: DataFrame, path: str, block: int, verify: bool) -> DataFrame:
    ship(files.sparkSession)
    small_batches(files.sparkSession)
    streams = _streams(files.sparkSession, path)
    # without its content a file is only listed; a store that only Spark reads gives it whole
    files = files.select("path") if streams else files.select("path", "content")
    schema = pa.schema([("path", pa.string()), ("pos", pa.int64()), ("status", pa.string()), ("record", pa.binary())])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i, name in enumerate(batch.column(0).to_pylist()):
                if streams:
                    system, at = pafs.FileSystem.from_uri(_uri(name))
                    source = system.open_input_stream(at, buffer_size=1 << 20)
                else:
                    source = pa.BufferReader(batch.column(1)[i].as_buffer())
                with source:
                    for pos, (status, record) in enumerate(scan_log(source, block, verify)):
                        yield name, pos, status, record

    return files.mapInArrow(lambda batches: batched(records(batches), schema, "record"), "path string, pos long, status string, record binary")
