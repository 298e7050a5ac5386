"""Quality rules by repetition coverage.

For n-gram lengths 2 to 10 a rolling hash over word numbers finds the n-grams of a document that
occur more than once.  For lengths 2 to 4 the characters in the most frequent n-gram are measured,
for 5 to 10 the characters inside any n-gram that occurred before, each character counted once
(coverage); for lines, the characters of lines equal to an earlier one.  A document fails where a
measure exceeds its limit as a share of all characters in words.

Defined results.  Null, empty or white text: zeros, fails the base (fewer than 50 words).
Documents are judged alone, so repeated rows get equal results, and very long texts are measured
whole.  Empty table: empty result.  Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.shared import ship

#: Published repetition limits (share of characters) by n-gram length, and for duplicate lines.
TOP_LIMITS = {2: 0.20, 3: 0.18, 4: 0.16}
DUPLICATE_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.20
MIN_WORDS = 50
REPEAT_PERCENT = 50

_symbols = re.compile(rb"[#*$%&|<>]")
_step = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, top_share double, dup_share double, line_share double, kept boolean"


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Equal words have equal numbers, counted from 0 in order of appearance."""
    numbers: dict[bytes, int] = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words))


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` words lie in a window of ``n`` words beginning at ``starts``."""
    edges = np.zeros(size + 1, dtype=np.int32)
    np.add.at(edges, starts, 1) if len(starts) < 64 else edges.__iadd__(np.bincount(starts, minlength=size + 1).astype(np.int32))
    ends = np.bincount(starts + n, minlength=size + 1)[: size + 1].astype(np.int32)
    return np.cumsum(edges - ends)[:size] > 0


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per key: its group, whether it came before; per group: how often."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.empty(len(keys), dtype=bool)
    new[0] = True
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    group = np.empty(len(keys), dtype=np.int64)
    group[order] = np.cumsum(new) - 1
    before = np.empty(len(keys), dtype=bool)
    before[order] = ~new
    return group, before, np.bincount(group)


def exact_windows(numbers: np.ndarray, n: int) -> np.ndarray:
    """Keys of all windows of ``n`` words that are equal exactly if the windows are."""
    key = numbers
    for i in range(1, n):
        key = key[:-1] * (int(numbers.max()) + 1) + numbers[i:]
        if i < n - 1 and int(key.max()) >= 1 << 31:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
    return key


def measure(text: bytes | None) -> tuple:
    """One row of ``SCHEMA``."""
    text = text or b""
    words = text.split()
    size = len(words)
    if not size:
        return 0, 0, len(_symbols.findall(text)), 0, 0, True, 0.0, 0.0, 0.0, False
    plain = text.isascii()
    chars = np.fromiter(map(len, words), dtype=np.int64, count=size)
    if not plain:  # code points: bytes less those that continue one
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        ahead = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])
        chars = np.diff(ahead[np.concatenate([[0], np.cumsum(chars)])])
    total = int(chars.sum())
    symbols = len(_symbols.findall(text))

    lines = [x for x in text.split(b"\n") if x.split()]
    seen: set[bytes] = set()
    dup_lines = dup_line_chars = 0
    for line in lines:
        if line in seen:
            dup_lines += 1
            dup_line_chars += sum(len(w.decode("utf-8", "replace")) for w in line.split())
        else:
            seen.add(line)

    numbers = word_numbers(words)
    repeat_words = 0
    if size >= 3:
        group, _, counts = repeated(exact_windows(numbers, 3))
        starts = np.flatnonzero(counts[group] > 1)
        if len(starts):
            repeat_words = int(covered(starts, 3, size).sum())
    base_failed = size < MIN_WORDS or 100 * repeat_words > REPEAT_PERCENT * size

    top = dup = 0.0
    bad = dup_line_chars > LINE_LIMIT * total
    ahead = np.concatenate([[0], np.cumsum(chars)])
    with np.errstate(over="ignore"):
        mixed = (numbers.astype(np.uint64) + np.uint64(1)) * _step
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        rolled = mixed
        for n in range(2, 11):
            if size < n:
                break
            rolled = rolled[:-1] * _step + mixed[n - 1 :]  # the window longer by one word
            group, before, counts = repeated(rolled)
            if counts.max() < 2:
                break  # no window of n words comes twice, so none of more words does
            if n in TOP_LIMITS:
                most = counts.max()
                at = np.flatnonzero(counts[group] == most)
                length = int((ahead[at + n] - ahead[at]).max())
                share = min(1.0, int(most) * length / total)
                top = max(top, share)
                bad |= share > TOP_LIMITS[n]
            else:
                inside = covered(np.flatnonzero(before), n, size)
                share = int(chars[inside].sum()) / total
                dup = max(dup, share)
                bad |= share > DUPLICATE_LIMITS[n]
    return size, total, symbols, dup_lines, repeat_words, base_failed, top, dup, dup_line_chars / total, not base_failed and not bad


def rules(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id and the measures of ``SCHEMA``."""
    ship(df.sparkSession)
    source = df.select(id_col, F.col(text).cast("binary").alias("__text"))
    schema = f"`{id_col}` {source.schema[0].dataType.simpleString()}, {SCHEMA}"
    names = [id_col, *(x.split()[0] for x in SCHEMA.split(", "))]
    kinds = [pa.int64()] * 5 + [pa.bool_()] + [pa.float64()] * 3 + [pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t) for t in batch.column(1).to_pylist()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return source.mapInArrow(run, schema)
