"""Secret scans with a recursive decoding worklist.

A text is scanned by the three base rules and then unwrapped: every URL-escaped, Unicode-escaped
or base64 run becomes a layer of its own, base64 bytes that are compressed are inflated first, and
each layer is scanned and unwrapped again until no layer is new.  Layers that were met before (by
content) are not entered again, which ends cycles.  Escapes that are nested more than ``STEPS`` deep
are decoded to their end in one pass, so a long chain of them costs no more than its length.  A finding in a layer is mapped to the span of
the run in the original text that held it; for escape layers, which keep positions, to the exact
characters.

Defined results.  Null or empty text: no finding.  Repeated rows: equal results.  Very long texts are
scanned whole, and so is each layer.  Empty table: empty result.  Other columns are kept by :func:`redact` and not read by :func:`scan`.  Inflated
data of any size are read to their end, all members of them, in windows of ``WINDOW`` bytes that
overlap by half, so a decompression bomb takes time but no memory.  Only a secret or run of over
half a window may be read in parts.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.shared import ship

KINDS = ("assign", "access", "hex")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32
WINDOW, CHUNK = 1 << 24, 1 << 20
#: Escape layers that are unwrapped one by one; deeper nesting is decoded to its end in one pass.
STEPS = 4

_assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_assign_hint = re.compile(r"passw(?:or)?d|secret|token|api_?key", re.IGNORECASE | re.ASCII)
_access = re.compile(r"AKIA[A-Z0-9]+")
_hex = re.compile(r"[0-9a-f]{32,}")  # a shorter maximal run fails, a longer one is taken whole
_url = re.compile(r"%[0-9A-Fa-f]{2}")
_url_run = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_unicode = re.compile(r"\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8}")
_base64 = (re.compile(r"[A-Za-z0-9+/]{16,}={0,2}"), re.compile(r"[A-Za-z0-9_-]{16,}={0,2}"))
_break = r"(?:\r\n?|\n|(?:\\r)?\\n)[ \t]*"
_wrapped = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{4,}}+{_break}[A-Za-z0-9+/_-]{{4,}}=*(?:{_break}[A-Za-z0-9+/_-]+=*)*")
_line = re.compile(rf"([A-Za-z0-9+/_-]+=*)(?:{_break})?")
_byte_escape = re.compile(r"""\\(?:x[0-9A-Fa-f]{2}|u00[0-9A-Fa-f]{2}|u\{0*[0-9A-Fa-f]{1,2}\}|U000000[0-9A-Fa-f]{2}|[0nrtabfv'"\\])""")
_braced = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}$")
_HEX = frozenset("0123456789abcdefABCDEF")
_simple = {"0": "\0", "n": "\n", "r": "\r", "t": "\t", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}
_packed = re.compile(r"\x1f\x8b|x[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")


class Finding(NamedTuple):
    start: int
    kind: int
    end: int
    layers: tuple[str, ...]


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` by the base rules, in code points."""
    out = []
    if _assign_hint.search(text):
        out += [(m.start(), 0, m.end()) for m in _assign.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _access.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in _hex.finditer(text)]
    out.sort()
    return out


def _as_text(data: bytes) -> str:
    """Bytes as text; those that are no UTF-8 as they are."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _damaged() -> tuple[type[Exception], ...]:
    """What the decompressors raise at data that they can't read."""
    import zstandard

    return zlib.error, lzma.LZMAError, OSError, EOFError, ValueError, zstandard.ZstdError


def _reader(data: bytes | memoryview):
    """A new decompressor for data of that beginning; none if they are not compressed."""
    if data[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if len(data) > 2 and data[0] == 0x78 and (data[0] * 256 + data[1]) % 31 == 0:
        return zlib.decompressobj()
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    if data[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj(write_size=CHUNK)
    return None


def _chunks(data: bytes | memoryview, used: list[int]) -> Iterator[bytes]:
    """The content of gzip, zlib, bzip2, xz or Zstandard data in chunks, all members; ``used[0]`` is how far they reach."""
    total, at = len(data), 0
    while (reader := _reader(data[at:])) is not None:
        fed = total
        try:
            if isinstance(reader, bz2.BZ2Decompressor | lzma.LZMADecompressor):
                part = reader.decompress(data[at:], CHUNK)
                while part:
                    yield part
                    part = b"" if reader.eof or reader.needs_input else reader.decompress(b"", CHUNK)
            elif hasattr(reader, "unconsumed_tail"):
                part = reader.decompress(data[at:], CHUNK)
                while part:
                    yield part
                    part = b"" if reader.eof else reader.decompress(reader.unconsumed_tail, CHUNK)
            else:  # no limit of output a call: little input at a time
                fed = at
                while fed < total and not reader.eof:
                    step, fed = fed, min(total, fed + (1 << 10))
                    yield reader.decompress(data[step:fed])
        except _damaged():
            used[0] = max(used[0], total if at == 0 else at)
            return
        at = used[0] = fed - len(reader.unused_data)
        if not reader.eof:
            return


def _inflated(data: bytes | memoryview, used: list[int]) -> Iterator[bytes]:
    """The content in windows that overlap by half; one window if it is small."""
    held = bytearray()
    more = False
    for chunk in _chunks(data, used):
        held += chunk
        while len(held) > WINDOW:
            yield bytes(held[:WINDOW])
            del held[: WINDOW // 2]
            more = True
    if held and not (more and len(held) <= WINDOW // 2):
        yield bytes(held)


def _unpacked(data: bytes | memoryview, used: list[int], seen: set[bytes]) -> Iterator[str]:
    """Texts of compressed data, packed again and again or not; bytes that are no UTF-8 are read as they are."""
    for part in _inflated(data, used):
        key = hashlib.blake2b(part, digest_size=16).digest()
        if key in seen:
            continue
        seen.add(key)
        if _reader(part) is not None:
            yield from _unpacked(part, [0], seen)
        if not part.strip(b"\0"):
            continue
        try:
            yield part.decode("utf-8")
        except UnicodeDecodeError:
            yield part.decode("utf-8", "ignore") if len(part) == WINDOW else part.decode("latin-1")


def _splice(text: str, places: list[int] | None, cuts: list[tuple[int, int, str]]) -> tuple[str, np.ndarray]:
    """``text`` with runs replaced, and for each character (and the end) where it began in the source."""
    parts, at, where = [], 0, []
    for start, end, new in cuts:
        parts += [text[at:start], new]
        where += [np.arange(at, start), np.linspace(start, end, len(new), endpoint=False).astype(np.int64)]
        at = end
    parts.append(text[at:])
    where.append(np.arange(at, len(text) + 1))
    return "".join(parts), np.concatenate(where)


def _url_layer(text: str) -> tuple[str, np.ndarray] | None:
    cuts = []
    for m in _url_run.finditer(text):
        new = bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace")
        cuts.append((m.start(), m.end(), new))
    return _splice(text, None, cuts) if cuts else None


def _unicode_layer(text: str) -> tuple[str, np.ndarray] | None:
    cuts = []
    for m in _unicode.finditer(text):
        code = int(m[0][2:].strip("{}"), 16)
        if code <= 0x10FFFF:
            cuts.append((m.start(), m.end(), chr(code)))
    if not cuts:
        return None
    joined, where = _splice(text, None, cuts)
    if any(0xD800 <= ord(c) < 0xE000 for c in joined):  # halves of one character
        fixed = joined.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        where = where[np.minimum(np.linspace(0, len(where) - 1, len(fixed) + 1).astype(np.int64), len(where) - 1)]
        joined = fixed
    return joined, where


def _escape_end(out: list[str]) -> tuple[int, int] | None:
    """Length and code of the escape that ends the characters, if one does."""
    last = out[-1]
    if last == "}":
        tail = "".join(out[-10:])
        m = _braced.search(tail)
        return (len(m[0]), int(m[1], 16)) if m and int(m[1], 16) <= 0x10FFFF else None
    if last not in _HEX:
        return None
    if len(out) > 2 and out[-3] == "%" and out[-2] in _HEX:
        return 3, int(out[-2] + last, 16)
    for n, mark in ((4, "x"), (6, "u"), (10, "U")):
        if len(out) >= n and out[-n] == "\\" and out[1 - n] == mark and all(c in _HEX for c in out[2 - n :]):
            code = int("".join(out[2 - n :]), 16)
            return (n, code) if code <= 0x10FFFF else None
    return None


def _all_escapes(text: str) -> tuple[str, np.ndarray]:
    """Escapes within escapes, however deep, in one pass: what a decoded character completes is decoded too."""
    out: list[str] = []
    where: list[int] = []
    for i, c in enumerate(text):
        out.append(c)
        where.append(i)
        while found := _escape_end(out):
            n, code = found
            begin = where[-n]
            del out[-n:], where[-n:]
            out.append(chr(code))
            where.append(begin)
    return "".join(out), np.array([*where, len(text)], dtype=np.int64)


def _embedded(text: str) -> Iterator[tuple[int, int, str]]:
    """Compressed bytes written with URL or byte escapes, and the span of each."""
    ways = []
    if "%" in text and _url.search(text):
        ways.append([(m.start(), m.end(), bytes.fromhex(m[0].replace("%", "")).decode("latin-1")) for m in _url_run.finditer(text)])
        if "+" in text:  # a space of form data
            ways.append(sorted(ways[0] + [(m.start(), m.end(), " ") for m in re.finditer(r"\+", text)]))
    if "\\" in text and _byte_escape.search(text):
        code = lambda x: chr(int(x[1:].strip("{}"), 16)) if x[0] in "xuU" else _simple.get(x, x)
        ways.append([(m.start(), m.end(), code(m[0][1:])) for m in _byte_escape.finditer(text)])
    for cuts in ways:
        joined, parts, at = "", [], 0
        for start, end, new in cuts:
            parts += [text[at:start], new]
            at = end
        joined = "".join([*parts, text[at:]])
        if not _packed.search(joined):
            continue
        where = _splice(text, None, cuts)[1]
        data = memoryview(joined.encode("latin-1", "replace"))
        for m in _packed.finditer(joined):
            used = [0]
            for inner in _unpacked(data[m.start() :], used, set()):
                yield int(where[m.start()]), int(where[min(m.start() + max(used[0], 1), len(joined))]), inner


def _base64_runs(text: str) -> Iterator[tuple[int, int, str]]:
    """Runs of either alphabet on a line, and over lines: ``start, end, characters``."""
    met = set()
    for pattern in _base64:
        for m in pattern.finditer(text):
            if m.span() not in met:
                met.add(m.span())
                yield m.start(), m.end(), m[0]
    for m in _wrapped.finditer(text):
        lines = [(x.start(1), x.end(1), x[1]) for x in _line.finditer(text, m.start(), m.end())]
        at = 0
        while at + 1 < len(lines):
            width = len(lines[at + 1][2])
            if len(lines[at][2]) < width and at + 2 < len(lines) and len(lines[at + 2][2]) > width:
                at += 1
                continue
            # lines of one width, the first may begin within its line and the last may be shorter
            if len(lines[at][2]) > width:
                width = len(lines[at][2])
            end = at + 1
            while end < len(lines) and len(lines[end][2]) == width and not lines[end - 1][2].endswith("="):
                end += 1
            ends = {end}
            if end < len(lines) and len(lines[end][2]) < width and not lines[end - 1][2].endswith("="):
                ends.add(end + 1)
            for first in {at, at + 1} if len(lines[at][2]) != width else {at}:
                for last in ends:
                    if last - first > 1:
                        yield lines[first][0], lines[last - 1][1], "".join(x[2] for x in lines[first:last])
            at = max(end, at + 1)


def _base64_layers(text: str) -> Iterator[tuple[int, int, str]]:
    for start, end, run in _base64_runs(text):
        raw = run.rstrip("=")
        if len(raw) % 4 == 1:  # no length of base64: the last character belongs to something else
            raw = raw[:-1]
        url_safe = "-" in raw or "_" in raw
        try:
            data = base64.b64decode(raw + "=" * (-len(raw) % 4), altchars=b"-_" if url_safe else None, validate=True)
        except (binascii.Error, ValueError):
            continue
        if _reader(data) is not None:
            for inner in _unpacked(data, [0], set()):
                yield start, end, inner
        yield start, end, _as_text(data)


def scan_text(text: str | None) -> tuple[list[tuple[int, int, int]], list[Finding]]:
    """Base findings, and the further ones of the decoded layers, with spans of ``text``."""
    text = text or ""
    base = base_findings(text)
    have = set(base)
    more: dict[tuple[int, int, int], tuple[str, ...]] = {}
    # a layer: its text, then either where each character began in the original, or the span of all
    work: list[tuple[str, np.ndarray | None, tuple[int, int], tuple[str, ...]]] = [(text, None, (0, len(text)), ())]
    seen = {hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()}

    def span(where: np.ndarray | None, whole: tuple[int, int], path: tuple[str, ...], start: int, end: int) -> tuple[int, int]:
        if where is not None:
            return int(where[start]), int(max(where[end], where[end - 1] + 1))
        return (start, end) if not path else whole

    while work:
        layer, where, whole, path = work.pop()
        if path:
            for start, kind, end in base_findings(layer):
                a, b = span(where, whole, path, start, end)
                if (a, kind, b) not in have:
                    more.setdefault((a, kind, b), path)
        found: list[tuple[str, np.ndarray | None, tuple[int, int], tuple[str, ...]]] = []
        steps = sum(x in ("url", "unicode") for x in path)
        ways = (("url", _url, _url_layer), ("unicode", _unicode, _unicode_layer))
        if steps >= STEPS:
            ways = tuple((n, h, _all_escapes) for n, h, _ in ways)
        for name, hint, unwrap in ways:
            if ("%" if name == "url" else "\\") in layer and hint.search(layer) and (x := unwrap(layer)):
                inner, inner_where = x
                if where is not None:
                    inner_where = where[inner_where]
                found.append((inner, inner_where if where is not None or not path else None, whole, (*path, name)))
        for name, pieces in (("base64", _base64_layers(layer)), ("packed", _embedded(layer))):
            for start, end, inner in pieces:
                found.append((inner, None, span(where, whole, path, start, end), (*path, name)))
        for x in found:
            key = hashlib.blake2b(x[0].encode("utf-8", "surrogatepass") + (b"" if x[1] is not None else repr(x[2]).encode()), digest_size=16).digest()
            if key not in seen:
                seen.add(key)
                work.append(x)
    return base, sorted(Finding(a, k, b, path) for (a, k, b), path in more.items())


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, ``n_assign, n_access, n_hex, base, spans, layered`` (spans that decoding added)."""
    ship(df.sparkSession)
    source = df.select(id_col, F.col(text).alias("__text"))
    schema = f"`{id_col}` {source.schema[0].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base string, spans string, layered long"
    names = [id_col, "n_assign", "n_access", "n_hex", "base", "spans", "layered"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], []]
            base_out, spans_out, layered = [], [], []
            for t in batch.column(1).to_pylist():
                base, more = scan_text(t)
                for k in range(3):
                    counts[k].append(sum(x[1] == k for x in base))
                base_out.append(render(base))
                spans_out.append(render(sorted({*base, *(x[:3] for x in more)})) if more else base_out[-1])
                layered.append(len(more))
            longs = [pa.array(x, pa.int64()) for x in counts]
            yield pa.RecordBatch.from_arrays([batch.column(0), *longs, pa.array(base_out, pa.string()), pa.array(spans_out, pa.string()), pa.array(layered, pa.int64())], names=names)

    return source.mapInArrow(run, schema)


def redact_text(text: str | None, mark: str = "[{}]") -> str | None:
    """``text`` with every found span replaced by its kind; overlapping spans are one."""
    if not text:
        return text
    base, more = scan_text(text)
    spans = sorted({*base, *(x[:3] for x in more)})
    if not spans:
        return text
    parts, at, i = [], 0, 0
    while i < len(spans):
        start, kind, end = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][2])
            i += 1
        parts += [text[at:start], mark.format(KINDS[kind].upper())]
        at = end
    return "".join([*parts, text[at:]])


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the secrets of its texts replaced; all rows and columns stay."""
    ship(df.sparkSession)
    names = df.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([redact_text(t) for t in columns[at].to_pylist()], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return df.mapInArrow(run, df.schema)
