"""SimHash fingerprints and near-duplicate classes by multi-index hashing.

A 64-bit fingerprint has two segments of 32 bits.  Two fingerprints within ``d`` bits are within ``d // 2``
bits in one of them, so each segment has a table keyed by its value, and every fingerprint looks up
the small Hamming ball around each of its segments.  Whatever meets in a table entry is verified by
its complete distance.  Only *distinct* fingerprints enter the tables, so a group of copies is one
entry.  An entry that ``FEW`` fingerprints or less look up is verified as a whole; a dense one is divided
by the other segment first, where its fingerprints meet in a value between them, so that no list of
pairs is made however many texts resemble each other.

Defined results.  Null or empty text: no word, fingerprint zero, linked like any other.  Repeated
rows share a fingerprint and a component.  Null ids: a row keeps its fingerprint; the component id
is the least non-null id, null if there is none.  Empty table: empty result.  Columns of any other
name are ignored by :func:`near_duplicates` and kept by :func:`keep_one`.  Very long texts are hashed
whole; fingerprints are counted in steps of bounded size.

:func:`keep_one_similar` links by the exact Jaccard similarity of shingle sets instead, which 64 bits
cannot tell: at 0.8 fingerprints differ in 15 % of their bits.  So its fingerprints are longer, and multi-index
hashing over them finds the candidates: ``plan`` gives the number of segments, a table each, in which a set
looks up all values within one bit, so that sets meet whose segments differ in two bits or less.
A pair of sets at 0.8 meets in no table with a probability of 0.00003, one of four and five shingles,
where the share of bits is 19 %, with 0.01.  What meets is verified by a word of its own and then by the complete
distance (a pair at 0.8 is beyond with a probability of 0.00004), and
each other pair on the complete sets.  All pairs of an entry that at most ``ALL_PAIRS`` different sets look up are
candidates; what larger entries of a table connect is one group of it, of which each set is written once.
Sets that pairs and groups connect are a family.  One of at most ``BLOCK`` sets is compared in one place, without
a list of pairs: of two sets of that similarity, one of the rarest elements of each is common, and sets of one
component need no comparison.  A larger family is first divided: its fingerprints meet in blocks and are compared by
their complete distance, which gives smaller families.  What is still larger is joined by each set's nearest pair
and then compared in blocks of sets; blocks of the same component do not meet, so the many copies of a text are
sent once to each block of other components.  No family loses a link between components.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.shared import components, materialize, numbered, ship, slices

SEGMENTS, SEGMENT_BITS = 2, 32
MASK = (1 << SEGMENT_BITS) - 1
#: Fingerprints of a table entry that are verified against each other; a dense entry is divided first.
FEW = 32
ALL_PAIRS, BLOCK = 8, 512
#: Of long fingerprints: rows of a table that one task takes, the least bits that are looked up, and the probability that no table has a pair whose bits differ most.
TABLE_ROWS, LEAST_BITS, MISS = 1 << 22, 28, 0.01
#: Words of the filter that keeps other texts out of a shuffle: 1 MB of bits.
FILTER_WORDS = 1 << 17
_MIX = np.uint64(xxhash.xxh64_intdigest(b"mix", 7) | 1)


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """Hashes of a text's shingles, with repeats; a text of fewer words is one shingle."""
    words = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, dtype="<u8")
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(x, 42) for x in parts], dtype="<u8")


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The unsigned fingerprint of one text."""
    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(df: DataFrame, text: str, keep: list[str], shingle: int = 3, out: str = "fp") -> DataFrame:
    """``keep`` columns and the fingerprint as a signed long."""
    ship(df.sparkSession)
    source = df.select(*keep, F.col(text).cast("binary").alias("__text"))
    schema = source.drop("__text").withColumn(out, F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, len(keep)):
            values = np.array([fingerprint(t, shingle) for t in part.column(part.num_columns - 1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(values)], names=[*keep, out])

    return source.mapInArrow(run, schema)


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def _segment(fp: Column, s: int) -> Column:
    return F.shiftrightunsigned(fp, SEGMENT_BITS * s).bitwiseAND(MASK)


def _ball(value: Column, radius: int) -> Column:
    """All values of a segment within ``radius`` bits (2 at most)."""
    if not radius:
        return F.array(value)
    bits = F.sequence(F.lit(0), F.lit(SEGMENT_BITS - 1))
    one = F.concat(F.array(value), F.transform(bits, lambda i: value.bitwiseXOR(_bit(i))))
    return one if radius == 1 else F.array_distinct(F.flatten(F.transform(bits, lambda i: F.transform(one, lambda x: x.bitwiseXOR(_bit(i))))))


def _probed(value: Column, radius: int) -> Column:
    """The values whose table entry a segment looks up.

    Of two values that differ in one bit, one has it unset, so for radius 1 it is enough that each
    looks up itself and what it is with one more bit.
    """
    if radius != 1:
        return _ball(value, radius)
    return F.array_distinct(F.concat(F.array(value), F.transform(F.sequence(F.lit(0), F.lit(SEGMENT_BITS - 1)), lambda i: value.bitwiseOR(_bit(i)))))


def _probing(value: Column, radius: int) -> Column:
    """The inverse: the values that look up a table entry."""
    if radius != 1:
        return _ball(value, radius)
    return F.array_distinct(F.concat(F.array(value), F.transform(F.sequence(F.lit(0), F.lit(SEGMENT_BITS - 1)), lambda i: value.bitwiseAND(F.bitwise_not(_bit(i))))))


def _of_table(values: Column, s: int | Column) -> Column:
    """Table entries: a segment's value and, above it, the segment's number."""
    number = F.shiftleft(F.lit(s).cast("long") if isinstance(s, int) else s, SEGMENT_BITS)
    return F.transform(values, lambda v: v.bitwiseOR(number))


def _near(a: Column, b: Column, distance: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= distance


def _verified(groups: DataFrame, distance: int) -> DataFrame:
    """Links among ``all`` of each group, by the complete distance; only links leave it."""
    later = lambda a: F.transform(F.filter(F.col("all"), lambda b: (b > a) & _near(a, b, distance)), lambda b: F.struct(a.alias("a"), b.alias("b")))
    return groups.select(F.inline(F.flatten(F.transform("all", later))))


def links(nodes: DataFrame, distance: int = 2) -> DataFrame:
    """Links ``(a, b)`` that connect all fingerprints of ``nodes.fp`` (distinct) within ``distance`` bits."""
    if not 0 <= distance <= 4:
        raise ValueError("distance is at most 4: a segment's ball has radius 2 at most")
    radius, half = distance // SEGMENTS, (distance + 1) // 2
    spread = nodes.select("fp").repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    probes = F.concat(*(_of_table(_probed(_segment(F.col("fp"), s), radius), s) for s in range(SEGMENTS)))
    met = spread.select("fp", F.explode(probes).alias("key")).groupBy("key").agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.count("*").alias("n"))
    met = materialize(met.where("n > 1"), "simhash-keys", narrow=True)
    two = met.where("n = 2").select("a", "b").where(_near(F.col("a"), F.col("b"), distance))
    # what a table entry with more fingerprints was looked up by
    table = nodes.select("fp", F.explode(F.concat(*(_of_table(F.array(_segment(F.col("fp"), s)), s) for s in range(SEGMENTS)))).alias("own"))
    number, value = F.shiftrightunsigned("key", SEGMENT_BITS), F.col("key").bitwiseAND(MASK)

    def fetched(keys: DataFrame) -> DataFrame:
        return keys.select("key", F.explode(_of_table(_probing(value, radius), number)).alias("own")).join(table, "own").select("key", "fp")

    few = fetched(met.where((F.col("n") > 2) & (F.col("n") <= FEW)).select("key")).groupBy("key").agg(F.collect_list("fp").alias("all"))
    # a dense entry is divided by the other segment, in which its fingerprints meet between them
    mine = F.when(number == 0, _segment(F.col("fp"), 0)).otherwise(_segment(F.col("fp"), 1))
    other = F.when(number == 0, _segment(F.col("fp"), 1)).otherwise(_segment(F.col("fp"), 0))
    dense = fetched(met.where(F.col("n") > FEW).select("key")).select("key", "fp", F.bit_count(mine.bitwiseXOR(value)).alias("off"), other.alias("other"))
    away = F.array(F.lit(None).cast("long"))
    for off in range(radius, -1, -1):
        away = F.when(F.col("off") == off, _ball(F.col("other"), half if not off else max(0, distance - off - half))).otherwise(away)
    dense = dense.select("key", "fp", F.explode(away).alias("between"))
    if distance % 2:  # a group is bounded by the size of a ball
        parts = _verified(dense.groupBy("key", "between").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1), distance)
    else:  # all of a group are within the distance of each other
        least = materialize(dense.groupBy("key", "between").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n"), "simhash-dense", narrow=True)
        parts = dense.join(least, ["key", "between"]).select("a", F.col("fp").alias("b")).where("a != b").where(_near(F.col("a"), F.col("b"), distance))
    return two.union(_verified(few, distance)).union(parts).distinct()


def classes(marked: DataFrame, id_col: str, distance: int) -> DataFrame:
    """``(fp, component)`` for the distinct fingerprints of ``marked``; component: the least id of the component."""
    nodes = materialize(marked.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-nodes", narrow=True)
    roots = components(links(nodes, distance), "a", "b", "simhash").toDF("fp", "root")
    rooted = materialize(nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-rooted", narrow=True)
    least = materialize(rooted.groupBy("root").agg(F.min("least").alias("component")), "simhash-least", narrow=True)
    return materialize(rooted.join(least, "root").select("fp", "component"), "simhash-classes", narrow=True)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 2) -> DataFrame:
    """One row per document: id, ``fp`` (signed long), ``component`` (least reachable id)."""
    marked = materialize(fingerprints(df, text, [id_col], shingle), "simhash-marked")
    return marked.join(classes(marked, id_col, distance), "fp").select(id_col, "fp", "component")


def keep_one(df: DataFrame, text: str = "text", shingle: int = 5, distance: int = 2) -> DataFrame:
    """The rows of ``df`` with one row of each near-duplicate group: the one stored first."""
    row = "__cairn_row"
    rows = numbered(df, row, "simhash-rows")
    marked = materialize(fingerprints(rows.select(row, text), text, [row], shingle), "simhash-marked")
    firsts = classes(marked, row, distance).groupBy("component").agg(F.lit(1).alias("n")).select(F.col("component").alias(row))
    return rows.join(firsts, row, "left_semi").select(*(F.col(f"`{c}`") for c in df.columns))


# --- exact similarity of shingle sets ------------------------------------------------------


def plan(rows: int, least: float) -> tuple[int, int, int]:
    """Bits of a segment that are the same, bits that are looked up within one on both sides, and the number of segments."""
    size = max(1, rows - 1).bit_length()
    top = max(0, size - (TABLE_ROWS.bit_length() - 1))
    low = min(32, max(LEAST_BITS, size + 8))
    differ = _differ(least) + 0.036
    meet = (1 - differ) ** top * sum(math.comb(low, k) * differ**k * (1 - differ) ** (low - k) for k in range(3))
    return top, low, math.ceil(math.log(MISS) / math.log1p(-meet))


def _differ(least: float) -> float:
    """The share of bits in which fingerprints of sets of that similarity differ."""
    return math.acos(2 * least / (1 + least)) / math.pi


def plan_words(top: int, low: int, tables: int) -> int:
    """64-bit words of a long fingerprint: its segments and one word beside them."""
    return -(-(top + low) * tables // 64) + 1


def long_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """A SimHash fingerprint of ``words`` 64-bit words; bits are counted in planes, 64 at once."""
    factors = np.array([xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 7) | 1 for i in range(words)], dtype=np.uint64) if words not in _factors else _factors[words]
    _factors[words] = factors
    ones = np.zeros(64 * words, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 12):
        x = hashes[at : at + (1 << 12), None] * factors
        x ^= x >> np.uint64(32)
        x *= _MIX
        x ^= x >> np.uint64(29)
        planes = [x]
        while len(planes[0]) > 1:
            if len(planes[0]) % 2:
                planes = [np.vstack([p, np.zeros((1, words), dtype=np.uint64)]) for p in planes]
            out, carry = [], None
            for p in planes:
                a, b = p[0::2], p[1::2]
                s = a ^ b
                out.append(s if carry is None else s ^ carry)
                carry = a & b if carry is None else (a & b) | (carry & s)
            planes = [*out, carry]
        for k, p in enumerate(planes):
            ones += np.unpackbits(p.astype("<u8").view(np.uint8).ravel(), bitorder="little").astype(np.int64) << k
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


_factors: dict[int, np.ndarray] = {}


def farthest(bits: int, differ: float) -> int:
    """In how many of ``bits`` two fingerprints differ at the most, but for four standard deviations."""
    return int(bits * differ + 4 * (bits * differ * (1 - differ)) ** 0.5)


def _node(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), 42)


def _marks(rows: DataFrame, row: str, text: str, shingle: int, words: int) -> DataFrame:
    """``row, node, fp``: the hash of the row's shingle set, its long fingerprint and, behind it, the set's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            sets = [np.unique(shingle_hashes(t, shingle)) for t in part.column(1).to_pylist()]
            nodes = np.array([_node(x) for x in sets], dtype=np.uint64).view(np.int64)
            prints = pa.array([long_fingerprint(x, words).tobytes() + len(x).to_bytes(8, "little") for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(nodes), prints], names=["row", "node", "fp"])

    return rows.select(F.col(row), F.col(text).cast("binary")).mapInArrow(run, "row long, node long, fp binary")


def _print_rows(prints: pa.Array) -> np.ndarray:
    values = prints.to_pylist()
    return np.frombuffer(b"".join(values), dtype="<u8").reshape(len(values), -1)


def meetings(low: np.ndarray, node: np.ndarray, word: np.ndarray, bits: int, far: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one table: pairs ``a < b`` that meet in an entry, as far as their words differ in ``far`` bits at most, and ``node, first`` of what larger entries connect.

    Pairs that larger entries connect anyway are left out.
    """
    n, pairs, dense, starts_at = len(low), [], [], 0
    low = low.astype(np.uint64)
    split = max(0, (n * (bits + 1) >> 22).bit_length())  # entries are taken in ranges of bounded size
    index = np.arange(n, dtype=np.uint64)
    for part in range(1 << split):
        found = []
        for flip in (0, *(1 << k for k in range(bits))):
            value = low ^ np.uint64(flip)
            at = np.flatnonzero(value >> np.uint64(bits - split) == part) if split else slice(None)
            found.append(value[at] << np.uint64(32) | index[at])
        entries = np.sort(np.concatenate(found))
        value, who = entries >> np.uint64(32), (entries & np.uint64(0xFFFFFFFF)).astype(np.int64)
        starts = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
        sizes = np.diff(np.append(starts, len(value)))
        few = np.repeat(sizes <= ALL_PAIRS, sizes)
        for lag in range(1, ALL_PAIRS):
            at = np.flatnonzero((value[lag:] == value[:-lag]) & few[lag:])
            i, j = who[at], who[at + lag]
            ok = (np.bitwise_count(word[i] ^ word[j]) <= far) & (i != j)
            pairs.append(np.stack([i[ok], j[ok]], axis=1))
        many = sizes > ALL_PAIRS
        dense.append(np.stack([np.repeat(np.arange(many.sum()) + starts_at, sizes[many]), who[~few]], axis=1))
        starts_at += int(many.sum())
    group = _groups(np.concatenate(dense), n)
    both = np.concatenate(pairs)
    x, y = group[both[:, 0]], group[both[:, 1]]
    both = both[(x != y) | (x < 0)]
    both = np.unique(np.sort(node[both], axis=1), axis=0)
    of = np.flatnonzero(group >= 0)
    return both[:, 0], both[:, 1], node[of], node[group[of]]


def _groups(dense: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` the least that the entries ``entry, member`` connect it with, by increasing entries; -1 for those in none."""
    label = np.arange(n)
    entry, who = dense[:, 0], dense[:, 1]
    starts = np.flatnonzero(np.append(True, entry[1:] != entry[:-1])) if len(entry) else entry
    while len(entry):
        least = np.repeat(np.minimum.reduceat(label[who], starts), np.diff(np.append(starts, len(entry))))
        after = label.copy()
        np.minimum.at(after, label[who], least)  # the whole group of a member follows it
        np.minimum.at(after, who, least)
        while (after[after] != after).any():
            after = after[after]
        if (after == label).all():
            break
        label = after
    inside = np.zeros(n, dtype=bool)
    inside[who] = True
    return np.where(inside, label, -1)


def met_in_tables(nodes: DataFrame, least: float, top: int, low: int, tables: int) -> DataFrame:
    """``key, a, b``: without a key, pairs of nodes that meet in a table; with one, a node ``a`` that larger entries of the table connect with ``b``."""
    n, width, far = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), top + low, farthest(64, _differ(least) + 0.036)
    names = ["part", "low", "node", "word"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(width, dtype=np.int64)
        for batch in batches:
            prints = _print_rows(batch.column(1))
            full = prints[:, -1] > 0
            node, prints = batch.column(0).to_numpy()[full], prints[full, :-1]
            if not len(node):
                continue
            bits = np.unpackbits(np.ascontiguousarray(prints[:, :-1]).view(np.uint8), axis=1, bitorder="little")
            out: list[tuple] = []
            for t in range(tables):
                value = bits[:, t * width : (t + 1) * width] @ weights
                for high in np.unique(value >> low):
                    at = value >> low == high
                    out.append(((t << top) + int(high), (value[at] & ((1 << low) - 1)).astype("<u4").tobytes(), node[at].tobytes(), prints[at, -1].tobytes()))
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done() -> Iterator[pa.RecordBatch]:
            value, node, word = (np.frombuffer(b"".join(r[c] for r in held), dtype=k) for c, k in ((1, "<u4"), (2, "<i8"), (3, "<u8")))
            a, b, of, first = meetings(value, node, word, low, far)
            yield from pa.Table.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b)], names=["key", "a", "b"]).to_batches(1 << 16)
            yield from pa.Table.from_arrays([pa.array(np.full(len(of), held[0][0], dtype=np.int64)), pa.array(of), pa.array(first)], names=["key", "a", "b"]).to_batches(1 << 16)

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and r[0] != held[0][0]:
                    yield from done()
                    held = []
                held.append(r)
        if held:
            yield from done()

    dealt = nodes.select("node", "fp").mapInArrow(deal, "part long, low binary, node binary, word binary")
    return dealt.repartition(n, "part").sortWithinPartitions("part").mapInArrow(meet, "key long, a long, b long")


def joining_links(sets: list[np.ndarray], component: list[int], side: list[int], least: float) -> list[tuple[int, int]]:
    """Links between sets that join their components, each where components were still apart.

    Sets are sorted and distinct hashes.  Elements are ordered from the rarest: two sets of
    similarity ``least`` share one of the first ``size - ceil(least * size) + 1`` of each.  If there are
    two sides, only sets of different sides are compared.
    """
    root: dict[int, int] = {c: c for c in component}

    def top(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((number, count[number], owner))
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    first = order[place < np.repeat(sizes - np.ceil(least * sizes - 1e-9).astype(np.int64) + 1, sizes)]
    first = first[count[number[first]] > 1]
    first = first[np.argsort(number[first], kind="stable")]
    owners = np.split(owner[first], np.flatnonzero(np.diff(number[first])) + 1)
    both, out = len(set(side)) > 1, []
    compared: set[tuple[int, int]] = set()
    for group in owners:
        group = group.tolist()
        tops = [top(component[i]) for i in group]
        if len(set(tops)) < 2:
            continue
        for k, i in enumerate(group):
            for j in group[:k]:
                if (both and side[i] == side[j]) or (j, i) in compared or top(component[i]) == top(component[j]):
                    continue
                compared.add((j, i))
                small, large = sorted((len(sets[i]), len(sets[j])))
                if small < least * large - 1e-9:
                    continue
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if common >= least * (small + large - common) - 1e-9:
                    root[top(component[i])] = top(component[j])
                    out.append((i, j))
    return out


def _dealt(members: DataFrame) -> DataFrame:
    """``key, i, j, block, node, component``: the nodes of ``key, node, component`` in blocks of about BLOCK, a copy for each pair ``i <= j`` of blocks of a key that meet.

    A component of over BLOCK nodes has blocks of its own, which do not meet each other.
    """
    sizes = members.groupBy("key", "component").agg(F.count("*").alias("c"))
    small = sizes.groupBy("key").agg(F.coalesce(F.sum(F.when(F.col("c") <= BLOCK, F.col("c"))), F.lit(0)).alias("small"))
    sizes = sizes.join(small, "key").select("key", "component", (F.col("c") > BLOCK).alias("own"), F.ceil(F.greatest(F.when(F.col("c") > BLOCK, F.col("c")).otherwise(F.col("small")), F.lit(1)) / BLOCK).alias("blocks"))
    rows = members.join(sizes, ["key", "component"])
    lump = F.when(F.col("own"), F.col("component").cast("string")).otherwise("")
    number = F.pmod(F.when(F.col("own"), F.xxhash64("node")).otherwise(F.xxhash64("component")), F.col("blocks"))
    rows = materialize(rows.select("key", "node", "component", lump.alias("lump"), F.concat_ws("/", lump, number.cast("string")).alias("block")), "simhash-blocks", narrow=True)
    blocks = rows.select("key", "lump", "block").distinct()
    pairs = blocks.toDF("key", "x", "i").join(blocks.toDF("key", "y", "j"), "key").where("i <= j and (x != y or x = '')").select("key", "i", "j")
    pairs = materialize(pairs, "simhash-meeting", narrow=True)
    both = pairs.select("key", F.col("i").alias("block"), "i", "j").union(pairs.where("i < j").select("key", F.col("j").alias("block"), "i", "j"))
    return rows.join(both, ["key", "block"]).select("key", "i", "j", "block", "node", "component")


def _in_place(rows: DataFrame, values: DataFrame, kernel: Callable[[list[bytes], list[int], list[str]], list[tuple[int, int, int]]]) -> DataFrame:
    """``a, b, away``: what ``kernel`` finds among the nodes of each ``key, i, j``, by their values (``node, value``), components and blocks."""
    group = ["key", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done() -> pa.RecordBatch:
            found = kernel([r[6] for r in held], [r[5] for r in held], [r[3] for r in held])
            nodes = [r[4] for r in held]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([nodes[i] for i, _, _ in found], [nodes[j] for _, j, _ in found], [d for _, _, d in found])], names=["a", "b", "away"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and r[:3] != held[0][:3]:
                    yield done()
                    held = []
                held.append(r)
        if held:
            yield done()

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.join(values.hint("merge"), "node").select(*group, "block", "node", "component", "value")
    return rows.repartition(n, *group).sortWithinPartitions(*group).mapInArrow(run, "a long, b long, away long")


def _joined(rows: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links ``a, b`` between the components of the nodes of each ``key, i, j``."""

    def kernel(values: list[bytes], component: list[int], side: list[str]) -> list[tuple[int, int, int]]:
        return [(i, j, 0) for i, j in joining_links([np.frombuffer(v, dtype="<u8") for v in values], component, side, least)]

    return _in_place(rows, sets.withColumnRenamed("hashes", "value"), kernel).select("a", "b")


def near_forest(prints: np.ndarray, side: list[str], least: float) -> list[tuple[int, int, int]]:
    """Fingerprints, with the sizes of their sets behind, that are as near as those of sets of that similarity:
    pairs ``i, j, away`` that connect what such pairs connect, and the nearest of each.  If there are two sides, only pairs of different sides count.
    """
    sides, of = np.unique(np.array(side), return_inverse=True)
    sizes, prints = prints[:, -1].astype(np.int64), prints[:, :-1]
    n, bits = len(prints), 64 * prints.shape[1]
    far, farther = farthest(bits, _differ(least) + 0.006), farthest(bits, _differ(least) + 0.036)
    away = np.empty((n, n), dtype=np.int32)
    for i in range(n):
        d = np.bitwise_count(prints[i] ^ prints).sum(axis=1, dtype=np.int32)
        small, large = np.minimum(sizes[i], sizes), np.maximum(sizes[i], sizes)
        off = (d > np.where(small < 5, farther, far)) | (small < least * large - 1e-9)
        if len(sides) > 1:
            off |= of == of[i]
        d[off] = bits + 1
        d[i] = bits + 1
        away[i] = d
    out = [(i, int(j), int(away[i, j])) for i, j in enumerate(away.argmin(axis=1)) if away[i, j] <= bits]
    fresh = np.ones(n, dtype=bool)
    for first in range(n):
        todo = [first] if fresh[first] else []
        fresh[first] = False
        while todo:
            i = todo.pop()
            found = np.flatnonzero(fresh & (away[i] <= bits))
            fresh[found] = False
            out += [(i, int(j), int(away[i, j])) for j in found]
            todo += found.tolist()
    return out


def _ends(pairs: DataFrame, of: DataFrame, column: str) -> DataFrame:
    """``a, b, x, y``: pairs with the column of both nodes; by sorted shuffles at every size, which skewed nodes may split."""
    left, right = of.select(F.col("node").alias("a"), F.col(column).alias("x")), of.select(F.col("node").alias("b"), F.col(column).alias("y"))
    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "x", "y")


def _alike(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The ``pairs``, and how far ``away``, whose fingerprints are, by their complete distance, as near as those of sets of that similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (_print_rows(batch.column(c)) for c in (2, 3))
                away, bits = np.bitwise_count(x[:, :-1] ^ y[:, :-1]).sum(axis=1, dtype=np.int64), 64 * (x.shape[1] - 1)
                small = np.minimum(x[:, -1], y[:, -1]) < 5  # sets of four and five elements differ in more bits
                near = away <= np.where(small, farthest(bits, _differ(least) + 0.036), farthest(bits, _differ(least) + 0.006))
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(away)], names=["a", "b", "away"]).filter(pa.array(near))

    return _ends(pairs, nodes, "fp").mapInArrow(run, "a long, b long, away long")


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The ``pairs`` whose sets have at least that Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype="<u8") for v in (x, y))
                small, large = sorted((len(x), len(y)))
                both = 0 if small < least * large - 1e-9 else len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (small + large - both) - 1e-9)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _ends(pairs, sets, "hashes").mapInArrow(run, "a long, b long")


def _hinted(rows: DataFrame, row: str, some: DataFrame) -> DataFrame:
    """``rows`` with ``__cairn_in``: false only if the row is none of ``some``; by a Bloom filter of at most FILTER_WORDS words that goes to every task."""
    bit = F.pmod(F.xxhash64(row), F.lit(FILTER_WORDS * 64).cast("long"))
    word, mask = F.shiftright(bit, 6), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int"))
    words = some.select(word.alias("__cairn_word"), mask.alias("mask")).groupBy("__cairn_word").agg(F.bit_or("mask").alias("__cairn_bits"))
    rows = rows.withColumn("__cairn_word", word).join(F.broadcast(words), "__cairn_word", "left")
    return rows.withColumn("__cairn_in", F.coalesce(F.col("__cairn_bits").bitwiseAND(mask) != 0, F.lit(False))).drop("__cairn_word", "__cairn_bits")


def _sets(rows: DataFrame, asked: DataFrame, row: str, text: str, shingle: int) -> DataFrame:
    """``node, hashes``: the sorted shingle hashes of the nodes ``asked`` (``node, row``); stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            sets = [np.unique(shingle_hashes(t, shingle)).tobytes() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["node", "hashes"])

    asked = materialize(asked, "simhash-asked", narrow=True)
    texts = rows.select(F.col(row).alias("row"), F.col(text).cast("binary").alias("text"))
    texts = _hinted(texts, "row", asked).where("__cairn_in").drop("__cairn_in").join(asked.hint("merge"), "row")
    return materialize(texts.select("node", "text").mapInArrow(run, "node long, hashes binary"), "simhash-hashes")


def _families(edges: DataFrame) -> DataFrame:
    """``key, node, n``: the nodes that ``a, b`` connect, by family, and the size of the family; stored."""
    family = components(edges, "a", "b", "simhash").toDF("node", "key")
    return materialize(family.join(family.groupBy("key").agg(F.count("*").alias("n")), "key"), "simhash-families", narrow=True)


def _in_one(family: DataFrame) -> DataFrame:
    """Families in one place each, as :func:`_dealt` gives them; every node is a component."""
    return family.select("key", F.lit("").alias("i"), F.lit("").alias("j"), F.lit("").alias("block"), "node", F.col("node").alias("component"))


def _of_big_families(family: DataFrame, near: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links of families that are too large for one place: by the nearest of each set, then in blocks."""
    nearest = near.join(family.select(F.col("node").alias("a")), "a", "left_semi").groupBy("a").agg(F.min(F.struct("away", "b"))["b"].alias("b"))
    linked = materialize(_similar(nearest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), sets, least), "simhash-links", narrow=True)
    roots = components(linked, "a", "b", "simhash").toDF("node", "component")
    members = family.join(roots, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    return linked.union(materialize(_joined(_dealt(members), sets, least), "simhash-links", narrow=True))


def keep_one_similar(df: DataFrame, text: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``df`` with one row, the one stored first, of each group linked by Jaccard similarities of at least ``least``."""
    ship(df.sparkSession)
    row = "__cairn_row"
    rows = numbered(df, row, "simhash-rows")
    top, low, tables = plan(rows.count(), least)
    marked = materialize(_marks(rows, row, text, shingle, plan_words(top, low, tables)), "simhash-marks")
    nodes = materialize(marked.groupBy("node").agg(F.min("row").alias("row"), F.first("fp").alias("fp")), "simhash-sets", narrow=True)
    met = materialize(met_in_tables(nodes, least, top, low, tables), "simhash-met")
    pairs = materialize(_alike(met.where("key IS NULL").select("a", "b").distinct(), nodes, least), "simhash-candidates", narrow=True)
    # sets that candidates connect: a family of at most BLOCK is compared in one place, a larger one divided by its fingerprints
    family = _families(pairs.select("a", "b").union(met.where("key IS NOT NULL").select("a", "b")).distinct())
    big, family = family.where(F.col("n") > BLOCK), family.where(F.col("n") <= BLOCK)
    near = None
    if not big.isEmpty():
        prints = nodes.select("node", F.col("fp").alias("value")).join(big.select("node"), "node", "left_semi")
        kernel = lambda values, component, side: near_forest(np.frombuffer(b"".join(values), dtype="<u8").reshape(len(values), -1), side, least)
        near = materialize(_in_place(_dealt(big.select("key", "node", F.col("node").alias("component"))), prints, kernel), "simhash-near", narrow=True)
        parts = _families(near.select("a", "b"))
        big, family = parts.where(F.col("n") > BLOCK), family.union(parts.where(F.col("n") <= BLOCK))
    asked = (family if near is None else family.union(big)).select("node").join(nodes.select("node", "row"), "node")
    sets = _sets(rows, asked, row, text, shingle)
    linked = materialize(_joined(_in_one(family), sets, least), "simhash-links", narrow=True)
    if near is not None and not big.isEmpty():
        linked = linked.union(_of_big_families(big, near, sets, least))
    roots = components(linked, "a", "b", "simhash").toDF("node", "root")
    firsts = nodes.select("node", "row").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("row").alias(row)).select(row)
    firsts = materialize(firsts, "simhash-firsts", narrow=True)
    gone = materialize(marked.select(F.col("row").alias(row)).join(firsts, row, "left_anti"), "simhash-gone", narrow=True)
    # only the fewer of those that stay and those that go are shuffled
    if firsts.count() < gone.count():
        stay = _hinted(rows, row, firsts).where("__cairn_in").join(firsts, row, "left_semi")
    else:
        hinted = _hinted(rows, row, gone)
        stay = hinted.where("not __cairn_in").union(hinted.where("__cairn_in").join(gone, row, "left_anti").select(*hinted.columns))
    return stay.select(*(F.col(f"`{c}`") for c in df.columns))
