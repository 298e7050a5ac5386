"""Token-id shards: sorted-string-table files of tokenised documents, and their reader.

File layout (little-endian; ``varint`` is LEB128)::

    block*   entries sorted by key; an entry is
             varint shared, varint unshared, varint value length, key suffix, value
             a key shares its prefix with the entry before it, except at each RESTART-th entry
             block trailer: u32 offset of each restart, u32 number of restarts, u32 crc32 of the block
    filter   Bloom filter over the keys: bit array, then u8 number of probes
    index    sparse: per block varint key length, last key, u64 offset, u32 length; then u32 crc32
    footer   u64 filter offset, u64 filter length, u64 index offset, u64 index length,
             u64 documents, u64 ids, 8-byte magic

A key is the document id as big-endian unsigned 64-bit with the sign bit flipped (so byte order is
numeric order; a null id has the empty key and comes first) followed, for repeated ids, by a
big-endian 32-bit counter.  A value is the ids as little-endian unsigned integers and, as its last
byte, their width: 2 bytes if all ids of the document are below 65,536, else 4.

Documents are range-partitioned by id, sorted, tokenised and written one shard a partition through
``pyarrow.fs`` to the shared folder.  A shard is written under an attempt's own name and moved to
its final name, so a retried task leaves whole files only.  Sizes in the manifest give every
document's ``start``.

Defined results.  Null text: empty, so the end id alone.  Null id: first.  Repeated ids: one entry
each, in the order of their texts' hashes.  Very long texts are one entry in a block of its own.  Empty table: no
shard, empty result.  Other columns are not read.  Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.shared import fresh_dir, materialize, ship

MAGIC = b"CAIRNSS1"
BLOCK_BYTES, RESTART = 1 << 16, 16
FOOTER = struct.Struct("<6Q8s")
SIGN = 1 << 63


# --- keys and small codecs -----------------------------------------------------------------


def make_key(doc_id: int | None, repeat: int = 0) -> bytes:
    if doc_id is None:
        return b"" if not repeat else b"\x00" * 4 + struct.pack(">I", repeat)[1:]  # 7 bytes: before every 8-byte key with the sign bit set
    return struct.pack(">Q", (doc_id + SIGN) & (2 * SIGN - 1)) + (struct.pack(">I", repeat) if repeat else b"")


def key_id(key: bytes) -> int | None:
    return struct.unpack(">Q", key[:8])[0] - SIGN if len(key) >= 8 else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def pack_ids(ids: bytes) -> bytes:
    """A value of ids given as little-endian unsigned 32-bit integers."""
    wide = np.frombuffer(ids, dtype="<u4")
    return wide.astype("<u2").tobytes() + b"\x02" if not len(wide) or int(wide.max()) < 1 << 16 else ids + b"\x04"


def unpack_ids(value: bytes) -> bytes:
    """The ids of a value as little-endian unsigned 32-bit integers."""
    return value[:-1] if value[-1] == 4 else np.frombuffer(value[:-1], dtype="<u2").astype("<u4").tobytes()


# --- writer --------------------------------------------------------------------------------


class ShardWriter:
    """Writes one shard to a binary stream; keys must ascend."""

    def __init__(self, stream, bits_per_key: int = 10):
        self.stream, self.bits = stream, bits_per_key
        self.at = self.documents = self.ids = 0
        self.index: list[tuple[bytes, int, int]] = []
        self.hashes: list[int] = []
        self.last = b""
        self._open()

    def _open(self) -> None:
        self.block, self.restarts, self.entries, self.before = bytearray(), [], 0, b""

    def add(self, key: bytes, ids: bytes) -> None:
        """Add a document; ``ids`` are little-endian unsigned 32-bit integers."""
        if self.documents and key <= self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.entries % RESTART:
            shared = len(os.path.commonprefix([self.before, key]))
        else:
            self.restarts.append(len(self.block))
        value = pack_ids(ids)
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.entries += 1
        self.before = self.last = key
        self.documents += 1
        self.ids += len(ids) // 4
        self.hashes.append(xxhash.xxh64_intdigest(key))
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if not self.entries:
            return
        self.block += struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
        data = bytes(self.block) + struct.pack("<I", zlib.crc32(self.block))
        self.stream.write(data)
        self.index.append((self.last, self.at, len(data)))
        self.at += len(data)
        self._open()

    def close(self) -> None:
        self._flush()
        bloom = make_bloom(np.array(self.hashes, dtype=np.uint64), self.bits)
        rows = b"".join(varint(len(k)) + k + struct.pack("<QI", at, n) for k, at, n in self.index)
        index = rows + struct.pack("<I", zlib.crc32(rows))
        self.stream.write(bloom + index + FOOTER.pack(self.at, len(bloom), self.at + len(bloom), len(index), self.documents, self.ids, MAGIC))


def _probes(hashes: np.ndarray, k: int, bits: int) -> np.ndarray:
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return (hashes[:, None] + step[:, None] * np.arange(k, dtype=np.uint64)) % np.uint64(bits)


def make_bloom(hashes: np.ndarray, bits_per_key: int) -> bytes:
    k = max(1, min(30, int(bits_per_key * 0.69)))
    bits = max(64, (len(hashes) * bits_per_key + 7) // 8 * 8)
    flags = np.zeros(bits, dtype=np.uint8)
    flags[_probes(hashes, k, bits).ravel().astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").tobytes() + bytes([k])


# --- reader --------------------------------------------------------------------------------


class ShardReader:
    """Point lookups and scans of one shard; reads the footer, filter and index, then single blocks."""

    def __init__(self, stream, size: int):
        self.stream = stream
        stream.seek(size - FOOTER.size)
        f_at, f_len, i_at, i_len, self.documents, self.ids, magic = FOOTER.unpack(stream.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        stream.seek(f_at)
        self.bloom = stream.read(f_len)
        rows = stream.read(i_len)
        if zlib.crc32(rows[:-4]) != struct.unpack("<I", rows[-4:])[0]:
            raise ValueError("the index is damaged")
        self.index, at = [], 0
        while at < len(rows) - 4:
            n, at = read_varint(rows, at)
            self.index.append((rows[at : at + n], *struct.unpack_from("<QI", rows, at + n)))
            at += n + 12

    def _block(self, i: int) -> bytes:
        _, at, n = self.index[i]
        self.stream.seek(at)
        data = self.stream.read(n)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a block is damaged")
        return data[:-4]

    @staticmethod
    def _entries(block: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < end:
            shared, at = read_varint(block, at)
            rest, at = read_varint(block, at)
            n, at = read_varint(block, at)
            key = key[:shared] + block[at : at + rest]
            at += rest
            yield key, unpack_ids(block[at : at + n])
            at += n

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.index)):
            block = self._block(i)
            yield from self._entries(block, 0, len(block) - 4 - 4 * struct.unpack("<I", block[-4:])[0])

    def may_contain(self, key: bytes) -> bool:
        bits = np.frombuffer(self.bloom, dtype=np.uint8)[:-1]
        at = _probes(np.array([xxhash.xxh64_intdigest(key)], dtype=np.uint64), self.bloom[-1], 8 * len(bits))[0].astype(np.int64)
        return bool((bits[at >> 3] >> (at & 7) & 1).all())

    def get(self, key: bytes) -> bytes | None:
        """Filter, then binary search of the index, of the block's restarts and a scan of one run."""
        if not self.index or not self.may_contain(key):
            return None
        lo, hi = 0, len(self.index)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.index[mid][0] < key else (lo, mid)
        if lo == len(self.index):
            return None
        block = self._block(lo)
        n = struct.unpack("<I", block[-4:])[0]
        end = len(block) - 4 - 4 * n
        restarts = struct.unpack_from(f"<{n}I", block, end)
        lo, hi = 0, n - 1
        while lo < hi:
            mid = (lo + hi + 1) // 2
            first = next(self._entries(block, restarts[mid], end))[0]
            lo, hi = (lo, mid - 1) if first > key else (mid, hi)
        for found, value in self._entries(block, restarts[lo], end):
            if found >= key:
                return value if found == key else None
        return None


# --- tokenizer -----------------------------------------------------------------------------


class CachedEncoder:
    """Encodes texts with the tokenizers library, each distinct piece between single spaces once.

    A byte-level pre-tokenizer splits before every space that a non-space follows, so the pieces of
    a text without a double space are encoded independently; others go to the library whole.  A
    word and one punctuation mark behind it are independent too.  The cache is emptied when it
    holds ``most`` pieces.
    """

    def __init__(self, path: str, most: int = 1_200_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.most = most
        self.cache: dict[str, bytes] = {}  # of pieces behind a space
        self.heads: dict[str, bytes] = {}  # of first pieces
        self.feed = int(np.frombuffer(self._ids("\n"), dtype="<u4")[0])
        self.marks = {x: self._ids(x) for x in ",.;:!?"}

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, new: set[str]) -> None:
        cache, marks = self.cache, self.marks
        marked = [x for x in new if x[-1:] in marks and x[:-1].isalpha()]
        plain = new.difference(marked)
        plain.update(x for x in (y[:-1] for y in marked) if x not in cache)
        self._encode_joined(list(plain))
        for x in marked:
            cache[x] = cache[x[:-1]] + marks[x[-1]]

    def _encode_joined(self, pieces: list[str]) -> None:
        """Encode pieces as one text, a line each, and cut its ids at the line feeds' id.

        A line feed before a space is a piece of its own; pieces that hold one are encoded alone.
        """
        lines = [x for x in pieces if "\n" not in x]
        for at in range(0, len(lines), 4096):
            part = lines[at : at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + "\n ".join(part) + "\n "], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(ids == self.feed) * 4
            if len(cuts) != len(part):  # white space of other kinds met the line feeds
                for piece in part:
                    self.cache[piece] = self._ids(" " + piece)
                continue
            data, last = ids.tobytes(), 0
            for piece, cut in zip(part, cuts.tolist(), strict=True):
                self.cache[piece] = data[last:cut]
                last = cut + 4
        for piece in pieces:
            if "\n" in piece:
                self.cache[piece] = b"".join([self._ids(" " + piece)])

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for at in range(0, len(texts), 256):
            out += self._encode_some(texts[at : at + 256])
        return out

    def _encode_some(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        split: list[tuple[int, list[str]]] = []
        new: set[str] = set()
        for i, text in enumerate(texts):
            if "  " in text or text[:1] == " " or text[-1:] == " ":
                out[i] = self._ids(text)
            elif text:
                pieces = text.split(" ")
                head = pieces[0]
                pieces[0] = ""
                new.update(pieces)
                if head not in self.heads:
                    if len(self.heads) > 100_000:
                        self.heads.clear()
                    self.heads[head] = self._ids(head)
                out[i] = self.heads[head]
                split.append((i, pieces))
        known = self.cache
        missing = new.difference(known)
        if len(known) + len(missing) > self.most:
            known.clear()
            missing = new
        known[""] = b""
        missing.discard("")
        self._learn(missing)
        for i, pieces in split:
            out[i] += b"".join(map(known.__getitem__, pieces))
        return out


_encoders: dict[str, CachedEncoder] = {}


def encoder(path: str) -> CachedEncoder:
    if path not in _encoders:
        _encoders[path] = CachedEncoder(path)
    return _encoders[path]


# --- DataFrame operators -------------------------------------------------------------------


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_shards(df: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the shards; the manifest ``(path, shard, first_id, documents, ids, bytes)``, stored."""
    spark = df.sparkSession
    ship(spark)
    folder = folder or fresh_dir(spark, "shards")
    run_id = uuid.uuid4().hex
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = source.repartitionByRange(n, F.col("id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"))
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        shard = context.partitionId()
        fs, root = _filesystem(folder)
        writer = stream = None
        draft = f"{root}/.{shard}-{run_id}-{context.taskAttemptId()}"
        coder = encoder(tokenizer)
        last, repeat, first_id = object(), 0, None
        for batch in batches:
            texts = coder.encode_many([x or "" for x in batch.column(1).to_pylist()])
            for doc_id, content in zip(batch.column(0).to_pylist(), texts, strict=True):
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    stream = fs.open_output_stream(draft)
                    writer, first_id = ShardWriter(stream), doc_id
                repeat = repeat + 1 if doc_id == last else 0
                last = doc_id
                writer.add(make_key(doc_id, repeat), content + end)
        if writer is None:
            return
        writer.close()
        size = stream.tell()
        stream.close()
        final = f"{root}/{shard:06d}.sst"
        fs.move(draft, final)
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{shard:06d}.sst"], "shard": pa.array([shard], pa.int64()), "first_id": pa.array([first_id], pa.int64()), "documents": pa.array([writer.documents], pa.int64()), "ids": pa.array([writer.ids], pa.int64()), "bytes": pa.array([size], pa.int64())})

    return materialize(ordered.mapInArrow(run, "path string, shard long, first_id long, documents long, ids long, bytes long"), "shards-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Documents read back from the files: ``doc_id, start, n_tokens, ids`` (ids little-endian u32)."""
    ship(manifest.sparkSession)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    placed = manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long")).select("path", "bytes", "base")
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = _filesystem(row["path"])
                with fs.open_input_file(path) as stream:
                    start, held, rows = row["base"], 0, []
                    for key, value in ShardReader(stream, row["bytes"]).scan():
                        rows.append((key_id(key), start, len(value) // 4, value))
                        start += len(value) // 4
                        held += len(value)
                        if held > 1 << 22:
                            yield _rows(rows)
                            held, rows = 0, []
                    if rows:
                        yield _rows(rows)

    return placed.repartition(n, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])


def lookup(spark: SparkSession, manifest: DataFrame, doc_ids: list[int]) -> dict[int, np.ndarray]:
    """Point lookup of a few ids by binary search: manifest, index, block."""
    out: dict[int, np.ndarray] = {}
    for doc_id in doc_ids:
        row = manifest.where(F.col("first_id").isNull() | (F.col("first_id") <= doc_id)).orderBy(F.desc("shard")).limit(1).collect()
        if row:
            fs, path = _filesystem(row[0]["path"])
            with fs.open_input_file(path) as stream:
                value = ShardReader(stream, row[0]["bytes"]).get(make_key(doc_id))
            if value is not None:
                out[doc_id] = np.frombuffer(value, dtype="<u4")
    return out
