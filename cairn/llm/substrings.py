"""Removal of byte strings of ``min_len`` or more that occur elsewhere in the corpus.

Method: longest-previous-factor (LPF) arrays.  The suffix array of a text puts equal strings next
to each other; going out from a suffix to the previous and the next one in suffix order with a
*smaller position* gives its longest earlier match.  The same with larger positions gives the
longest later match.  With ``keep="first"`` a string goes if it has an earlier match, with
``keep="none"`` if it has any.

A corpus has no single suffix array, so its suffixes are dealt into small arrays that hold all
suffixes of equal beginnings:

1. Anchors.  Every string of ``min_len`` bytes has an anchor inside, the ``GRAM``-byte gram of least
   hash (the leftmost of equals), which depends on the string only; so equal strings have equal
   anchors.  An anchor stands for a run of neighbouring strings, its context.
2. Anchors that occur once are dropped (a count per hash with map-side combining).
3. Contexts that occur more than once, by anchor and a 64-bit hash each, are whole matches; each is
   looked at once, at its first place, whatever the number of copies.
4. The different contexts of an anchor are put into one text, in the order of their places, and
   its LPF arrays are made.  An anchor with more than ``BUCKET`` different contexts is not put into
   one text: its strings are dealt by their own 128-bit hashes, in stretches first, and counted
   with map-side combining, which gives the same answer without a large group.

Hashes that select candidates and identify contexts have 64 + 64 bits of different polynomials.

Defined results.  Null or empty text: nothing to remove.  A repeated row is a copy like any other.
Matches never cross rows.  Very long texts are read whole, in steps of bounded size.  Empty table:
empty result.  Other columns are kept.  Rows are stored once with their numbers, so an input that
comes in another order at each evaluation does no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.shared import materialize, numbered, ship

GRAM = 64
BUCKET = 256
TEXT_BYTES = 1 << 18
CHUNK = 1 << 19
STEP = 16

_BASES = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1)
_MASK = (1 << 64) - 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


# --- rolling hashes ------------------------------------------------------------------------


def _tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 14, 1 << (n - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            have = tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, x, dtype=np.uint64)])) for x in (base, inverse))
        _powers[base] = have
    return have[0][:n], have[1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Hashes:
    """Hashes of substrings of a byte array by one base."""

    def __init__(self, data: np.ndarray, base: int):
        up, self.down = _tables(base, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])

    def windows(self, n: int) -> np.ndarray:
        return _mix((self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n])


def anchors(data: np.ndarray, min_len: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchor hash, context hash, first and last string start of each context of one text."""
    none = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    if len(data) < min_len:
        return none
    parts = []
    span = min_len - gram + 1  # grams in a string
    for at in range(0, len(data) - min_len + 1, CHUNK):
        piece = data[at : at + CHUNK + min_len - 1]
        with np.errstate(over="ignore"):
            first, second = Hashes(piece, _BASES[0]), Hashes(piece, _BASES[1])
            grams = first.windows(gram)
            low = np.uint64((1 << 20) - 1)
            least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
            width = 1
            while 2 * width <= span:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            if width < span:
                least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
            where = (least & low).astype(np.int64)
            begin = np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1])
            end = np.concatenate([begin[1:], [len(where)]]) - 1
            place = where[begin]
            context = second.of(begin, end + min_len) ^ _mix((place - begin).astype(np.uint64) + np.uint64(77))
        parts.append((grams[place], context, begin + at, end + at))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


# --- suffix and LPF arrays -----------------------------------------------------------------


def suffix_array(data: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array by prefix doubling, and the ranks by 1, 2, 4 ... values.

    With ``depth`` suffixes that agree in their first ``depth`` (or more) values may stay in any order.
    """
    n = len(data)
    ranks = [np.unique(data, return_inverse=True)[1].astype(np.int64)]
    order = np.argsort(ranks[0], kind="stable")
    width = 1
    while width < min(n, depth or n):
        rank = ranks[-1]
        behind = np.full(n, -1, dtype=np.int64)
        behind[:-width] = rank[width:]
        key = rank * (n + 1) + behind + 1
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        new = np.empty(n, dtype=np.int64)
        new[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        ranks.append(new)
        width *= 2
        if new[order[-1]] == n - 1:
            break
    return order, ranks


def neighbours_lcp(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Length of the common beginning of each suffix with the one before it in suffix order."""
    n = len(order)
    a, b = order[1:].copy(), order[:-1].copy()
    length = np.zeros(n, dtype=np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        width = 1 << level
        for _ in range(2):  # equal suffixes at the top level may agree on one more width
            inside = (a + width <= n) & (b + width <= n)
            same = np.zeros(len(a), dtype=bool)
            same[inside] = ranks[level][a[inside]] == ranks[level][b[inside]]
            step = np.where(same, width, 0)
            length[1:] += step
            a, b = a + step, b + step
            if level < len(ranks) - 1:
                break
    return length


def previous_factors(order: np.ndarray, lcp: np.ndarray, floor: int = 1) -> np.ndarray:
    """LPF: per position the longest match (of ``floor`` or more, else 0) that begins earlier.

    Suffixes are visited in suffix order with a stack of ascending positions; a position leaves
    the stack when a smaller one comes, which is its next smaller position; the one below it is
    its previous smaller position.  The match is the larger of the least common beginnings on the
    ways to the two.  Only runs of suffixes whose neighbours agree in ``floor`` bytes are visited.
    """
    out = np.zeros(len(order), dtype=np.int64)
    close = np.concatenate([lcp[1:] >= floor, [False]])
    starts = np.flatnonzero(close & ~np.concatenate([[False], close[:-1]]))
    ends = np.flatnonzero(~close & np.concatenate([[False], close[:-1]]))
    positions, common = order.tolist(), lcp.tolist()
    for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True):
        stack: list[tuple[int, int]] = [(positions[lo], 0)]  # position, match with the one below
        for i in range(lo + 1, hi + 1):
            at, match = positions[i], common[i]
            while stack and stack[-1][0] > at:
                top, below = stack.pop()
                out[top] = max(below, match)
                match = min(below, match)
            stack.append((at, match if stack else 0))
        while stack:
            top, below = stack.pop()
            out[top] = below
    return out


def longest_matches(data: np.ndarray, floor: int = 1, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Longest earlier and longest later match of every position."""
    order, ranks = suffix_array(data, depth)
    lcp = neighbours_lcp(order, ranks)
    n = len(data)
    earlier = previous_factors(order, lcp, floor)
    later = previous_factors(n - 1 - order, lcp, floor)[::-1]
    return earlier, later


def text_matches(texts: list[bytes], floor: int, depth: int | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """:func:`longest_matches` within and across several texts, which are kept apart by separators."""
    sizes = [len(t) for t in texts]
    joined = np.zeros(sum(sizes) + len(texts), dtype=np.int64)
    at = 0
    for i, t in enumerate(texts):
        joined[at : at + len(t)] = np.frombuffer(t, dtype=np.uint8)
        joined[at + len(t)] = 256 + i
        at += len(t) + 1
    earlier, later = longest_matches(joined, floor, depth)
    out, at = [], 0
    for n in sizes:
        room = np.arange(n, 0, -1)  # a match ends where the text does
        out.append((np.minimum(earlier[at : at + n], room), np.minimum(later[at : at + n], room)))
        at += n + 1
    return out


# --- DataFrame operator --------------------------------------------------------------------

_ROW, _TEXT = "__cairn_row", "__cairn_text"


def _anchor_rows(texts: DataFrame, min_len: int) -> DataFrame:
    """``h`` (anchor), ``c`` (context), row, ``start`` (first string of the context) and ``more`` (further ones)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy(zero_copy_only=False)
            held: list[tuple[np.ndarray, ...]] = []
            size = 0
            for i, text in enumerate(batch.column(1)):
                raw = text.as_buffer()
                data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
                h, c, first, last = anchors(data, min_len)
                held.append((h.view(np.int64), c.view(np.int64), np.full(len(h), rows[i], dtype=np.int64), first, (last - first)))
                size += len(h)
                if size > 1 << 18 or i == batch.num_rows - 1:
                    columns = [np.concatenate(x) for x in zip(*held, strict=True)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns[:4]), pa.array(columns[4].astype(np.int32))], names=["h", "c", _ROW, "start", "more"])
                    held, size = [], 0

    return texts.mapInArrow(run, f"h long, c long, {_ROW} long, start long, more int")


def _contexts(exemplars: DataFrame, texts: DataFrame, min_len: int) -> DataFrame:
    """The bytes of each different context, cut from its first place."""
    wanted = exemplars.groupBy(_ROW).agg(F.collect_list(F.struct("h", "c", "start", "more", "copies")).alias("all"))
    joined = texts.join(wanted, _ROW).select(_ROW, _TEXT, "all")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text, wanted in zip(*(x.to_pylist() if i != 1 else x for i, x in enumerate(batch.columns)), strict=True):
                raw = text.as_buffer().to_pybytes()
                out = [(x["h"], x["c"], row, x["start"], x["copies"], raw[x["start"] : x["start"] + x["more"] + min_len]) for x in wanted]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["h", "c", "row", "start", "copies", "bytes"])

    return joined.mapInArrow(run, "h long, c long, row long, start long, copies long, bytes binary")


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _bucket_matches(contexts: DataFrame, min_len: int, keep: str) -> DataFrame:
    """Runs of matched strings ``(h, c, lo, hi, first)`` per context by LPF arrays of small texts.

    ``first``: whether the run counts for the first place of the context, or for its copies only.
    """

    def solve(group: list[tuple]) -> list[tuple]:
        group.sort(key=lambda x: (x[2], x[3]))
        out = []
        for (h, c, _, _, copies, _), (earlier, later) in zip(group, text_matches([x[5] for x in group], min_len, min_len), strict=True):
            n = len(earlier) - min_len + 1
            before, after = earlier[:n] >= min_len, later[:n] >= min_len
            gone = before if keep == "first" else before | after
            out += [(h, c, lo, hi, True) for lo, hi in _runs(gone)]
            if copies > 1 and keep == "first":
                out.append((h, c, 0, n, False))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            if rows := solve(held):
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["h", "c", "lo", "hi", "first"])

        for batch in batches:
            for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if size > TEXT_BYTES and row[0] != last:
                    yield from flush()
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
                last = row[0]
        if held:
            yield from flush()

    n = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return contexts.repartition(n, "h").sortWithinPartitions("h").select("h", "c", "row", "start", "copies", "bytes").mapInArrow(run, "h long, c long, lo int, hi int, first boolean")


def _stretches(values: np.ndarray, h: int, min_len: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """A context's strings in stretches of STEP by their distance to the anchor.

    Per stretch: number, first and last string, anchor, and begin and end of the core, the bytes
    that all strings of a whole stretch share.  Equal strings are in stretches of one number.
    """
    n = len(values) - min_len + 1
    with np.errstate(over="ignore"):
        place = int(np.flatnonzero(Hashes(values, _BASES[0]).windows(GRAM).view(np.int64) == h)[0])
    for b in range((place - n + 1) // STEP if place >= n else 0, place // STEP + 1):
        lo, hi = max(0, place - STEP * b - STEP + 1), min(n - 1, place - STEP * b)
        if lo <= hi:
            yield b, lo, hi, place, place - STEP * b, place - STEP * b - STEP + 1 + min_len


def _two_hashes(values: np.ndarray, start: list[int], end: list[int], salt: list[int]) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        extra = _mix(np.array(salt, dtype=np.int64).view(np.uint64) + np.uint64(1))
        return [(Hashes(values, base).of(np.array(start), np.array(end)) ^ extra).view(np.int64) for base in _BASES]


def _hot_matches(contexts: DataFrame, min_len: int, keep: str) -> DataFrame:
    """The same for anchors with many different contexts, by 128-bit hashes counted with map-side combining.

    First whole stretches of strings and their cores are counted.  A stretch that occurs elsewhere
    is a match of all its strings; one whose core occurs only once has none.  Only the strings of the
    others are counted one by one, together with those of each repeated stretch's first place.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for h, c, row, start, data in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                values = np.frombuffer(data, dtype=np.uint8)
                parts = list(_stretches(values, h, min_len))
                starts = [x for _, lo, _, _, core, _ in parts for x in (lo, core)]
                ends = [x for _, _, hi, _, _, end in parts for x in (hi + min_len, end)]
                salts = [x for b, lo, hi, place, _, _ in parts for x in ((b << 20) + ((place - lo) << 10) + (place - hi), -1 - b)]
                for column, found in zip(out, _two_hashes(values, starts, ends, salts), strict=False):
                    column += found.tolist()
                n = len(starts)
                out[2] += [h] * n
                out[3] += [c] * n
                out[4] += [row] * n
                out[5] += [start + x[1] for x in parts for _ in range(2)]
                out[6] += [2 * x[0] + k for x in parts for k in range(2)]
            kinds = [pa.int64()] * 6 + [pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["w1", "w2", "h", "c", "row", "place", "code"])

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, c, row, start, data, codes, later in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                values = np.frombuffer(data, dtype=np.uint8)
                open_ = [np.arange(lo, hi + 1) for b, lo, hi, _, _, _ in _stretches(values, h, min_len) if 2 * b + 1 in codes and 2 * b not in later]
                if not open_:
                    continue
                at = np.concatenate(open_)
                with np.errstate(over="ignore"):
                    w1, w2 = (Hashes(values, b).of(at, at + min_len).view(np.int64) for b in _BASES)
                n = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(w1), pa.array(w2), pa.array(np.full(n, h)), pa.array(np.full(n, c)), pa.array(np.full(n, row)), pa.array(start + at), pa.array(at.astype(np.int32))], names=["w1", "w2", "h", "c", "row", "place", "at"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for h, c, n, codes, later, data, singles in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                gone = np.zeros(n, dtype=bool)
                whole_ = later if keep == "first" else codes
                for b, lo, hi, _, _, _ in _stretches(np.frombuffer(data, dtype=np.uint8), h, min_len):
                    if 2 * b in whole_:
                        gone[lo : hi + 1] = True
                gone[np.array(singles or [], dtype=np.int64)] = True
                out += [(h, c, lo, hi, True) for lo, hi in _runs(gone)]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["h", "c", "lo", "hi", "first"])

    def repeated(rows: DataFrame, label: str) -> DataFrame:
        counts = rows.groupBy("w1", "w2").agg(F.min(F.struct("row", "place")).alias("origin"), F.count("*").alias("n"))
        return materialize(counts.where("n > 1").select("w1", "w2", "origin"), label)

    elsewhere = F.struct("row", "place") != F.col("origin")
    stretches = contexts.select("h", "c", "row", "start", "bytes").mapInArrow(whole, "w1 long, w2 long, h long, c long, row long, place long, code int")
    stretches = materialize(stretches, "substrings-stretches")  # read twice
    hits = stretches.join(repeated(stretches, "substrings-stretches"), ["w1", "w2"]).groupBy("h", "c")
    hits = hits.agg(F.collect_list("code").alias("codes"), F.collect_list(F.when(elsewhere, F.col("code"))).alias("later"))  # a few per context
    marked = materialize(contexts.join(hits, ["h", "c"]), "substrings-marked")
    strings = marked.select("h", "c", "row", "start", "bytes", "codes", "later").mapInArrow(single, "w1 long, w2 long, h long, c long, row long, place long, at int")
    strings = materialize(strings, "substrings-strings")
    found = strings.join(repeated(strings, "substrings-strings"), ["w1", "w2"])
    if keep == "first":
        found = found.where(elsewhere)
    singles = found.groupBy("h", "c").agg(F.collect_list("at").alias("singles"))  # at most one per string of the context
    n = (F.octet_length("bytes") - min_len + 1).cast("int")
    rows = marked.join(singles, ["h", "c"], "left").select("h", "c", n.alias("n"), "codes", "later", "bytes", "singles").mapInArrow(runs, "h long, c long, lo int, hi int, first boolean")
    if keep == "first":
        rows = rows.union(contexts.where("copies > 1").select("h", "c", F.lit(0).alias("lo"), n.alias("hi"), F.lit(False).alias("first")))
    return rows


def removed_spans(texts: DataFrame, min_len: int, keep: str) -> DataFrame:
    """``(row, start, end)`` of byte runs to remove; runs may overlap."""
    rows = _anchor_rows(texts, min_len)
    twice = materialize(rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "substrings-anchors")
    found = materialize(rows.join(twice, "h"), "substrings-repeated")
    place = F.struct(_ROW, "start")
    contexts = found.groupBy("h", "c").agg(F.count("*").alias("copies"), F.min(place).alias("place"), F.max("more").alias("more"))
    contexts = materialize(contexts.select("h", "c", "copies", f"place.{_ROW}", "place.start", "more"), "substrings-contexts")
    variants = materialize(contexts.groupBy("h").agg(F.count("*").alias("variants")), "substrings-variants")
    kinds = contexts.join(variants, "h")
    if keep == "none":  # a context with copies goes whole; the others need matches only where an anchor has more than one
        whole = kinds.where("copies > 1").select("h", "c", F.lit(0).alias("lo"), (F.col("more") + 1).alias("hi"), F.lit(True).alias("first"))
    else:
        whole = kinds.where("copies > 1 and variants = 1").select("h", "c", F.lit(0).alias("lo"), (F.col("more") + 1).alias("hi"), F.lit(False).alias("first"))
    mixed = materialize(_contexts(kinds.where("variants > 1"), texts, min_len).join(variants, "h"), "substrings-mixed")
    runs = whole.union(_bucket_matches(mixed.where(F.col("variants") <= BUCKET), min_len, keep)).union(_hot_matches(mixed.where(F.col("variants") > BUCKET), min_len, keep))
    runs = runs.join(contexts.select("h", "c", F.col(_ROW).alias("row0"), F.col("start").alias("start0")), ["h", "c"]) if keep == "first" else runs
    runs = materialize(runs, "substrings-runs")
    hits = found.join(runs, ["h", "c"])
    if keep == "first":
        hits = hits.where(F.col("first") | (F.col(_ROW) != F.col("row0")) | (F.col("start") != F.col("start0")))
    return hits.select(_ROW, (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi") - 1 + min_len).alias("hi"))


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def with_spans(df: DataFrame, text: str = "text", min_len: int = 200, keep: str = "first") -> DataFrame:
    """``df`` with ``__cairn_text`` (bytes) and ``__cairn_spans`` (unmerged runs to remove, null if none)."""
    if keep not in ("first", "none") or min_len < GRAM:
        raise ValueError("keep is 'first' or 'none'; min_len is at least GRAM")
    ship(df.sparkSession)
    rows = numbered(df, _ROW, "substrings-rows").withColumn(_TEXT, F.col(text).cast("binary"))
    spans = removed_spans(rows.select(_ROW, _TEXT), min_len, keep)
    lists = spans.groupBy(_ROW).agg(F.collect_list(F.struct("lo", "hi")).alias("__cairn_spans"))  # bounded by a row's text
    return rows.join(lists, _ROW, "left")


def remove(df: DataFrame, text: str = "text", min_len: int = 200, keep: str = "first") -> DataFrame:
    """``df`` with repeated strings cut from its texts (bytes that are no UTF-8 any more become U+FFFD)."""
    names = df.columns
    rows = with_spans(df, text, min_len, keep).select(*(F.col(f"`{c}`") for c in names), "__cairn_spans")
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)[:-1]
            new = []
            for value, spans in zip(columns[at].to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                new.append(value if not spans else cut(value.encode(), merge([(s["lo"], s["hi"]) for s in spans])).decode("utf-8", "replace"))
            columns[at] = pa.array(new, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(batch.schema)[:-1]))

    return rows.mapInArrow(run, df.schema)


def cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for lo, hi in spans:
        parts.append(data[at:lo])
        at = hi
    return b"".join([*parts, data[at:]])


def digest(df: DataFrame, id_col: str = "doc_id", text: str = "text", min_len: int = 200, keep: str = "none") -> DataFrame:
    """Per row: id, ``n_bytes, n_removed, n_spans, kept_sha256``."""
    rows = with_spans(df.select(id_col, text), text, min_len, keep).select(id_col, _TEXT, "__cairn_spans")
    kind = df.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, counts, hashes = [], [], [], []
            for value, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = value.as_buffer()
                data = raw.to_pybytes() if raw is not None else b""
                runs = merge([(s["lo"], s["hi"]) for s in spans or ()])
                sizes.append(len(data))
                removed.append(sum(b - a for a, b in runs))
                counts.append(len(runs))
                hashes.append(hashlib.sha256(cut(data, runs)).hexdigest())
            longs = [pa.array(x, pa.int64()) for x in (sizes, removed, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *longs, pa.array(hashes, pa.string())], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
