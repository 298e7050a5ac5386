"""Admission and eviction: frequency sketches, frequency estimates, room, and the admission replay.

Sketches are tables of counters, built by grouped counts with map-side combining; seeds are fixed
so that estimates repeat.  The replay of admissions is sequential by nature: it runs per shard,
streaming the shard's operations in order with the shard's residents as its only state.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators import ordered
from cairn.session import ship

SEEDS, COUNTER_MAX, SAMPLE = (11, 22, 37, 56), 15, 5


def sketch(df: DataFrame, key: Column, width: int, seeds: tuple[int, ...] = SEEDS) -> DataFrame:
    """Count-min counters ``r, b, c``; ``width`` is a power of two of at least 2."""
    rows = df.select(key.cast("long").alias("k")).groupBy("k").agg(F.count("*").alias("n"))  # equal keys count once per row of the sketch
    spread = rows.select("n", F.posexplode(_buckets(F.col("k"), width, seeds)).alias("r", "b"))
    return spread.groupBy("r", "b").agg(F.least(F.sum("n"), F.lit(COUNTER_MAX).cast("long")).alias("c"))


def _buckets(key: Column, width: int, seeds: tuple[int, ...]) -> Column:
    return F.array(*(key.bitwiseXOR(F.lit(s).cast("long")).bitwiseAND(width - 1) for s in seeds))


def estimate(counters: DataFrame, keys: DataFrame, key: str, width: int, seeds: tuple[int, ...] = SEEDS) -> DataFrame:
    """``k, est``: the least counter of each distinct key; a sketch has a fixed number of rows."""
    rows = keys.select(F.col(key).cast("long").alias("k")).distinct().select("k", F.posexplode(_buckets(F.col("k"), width, seeds)).alias("r", "b"))
    found = rows.join(F.broadcast(counters), ["r", "b"], "left") if width * len(seeds) <= 1 << 18 else rows.join(counters, ["r", "b"], "left")
    return found.groupBy("k").agg(F.min(F.coalesce("c", F.lit(0).cast("long"))).alias("est"))


def halve(counters: DataFrame, column: str = "c") -> DataFrame:
    """Aging: every counter by half."""
    return counters.withColumn(column, F.shiftright(column, 1))


def frequency(df: DataFrame, key: str) -> DataFrame:
    """``k, freq``: accesses beyond the first, which only the doorkeeper notes, up to the counters' limit."""
    return df.groupBy(F.col(key).alias("k")).agg(F.least(F.count("*") - 1, F.lit(COUNTER_MAX).cast("long")).alias("freq"))


def lfu_estimate(df: DataFrame, key: str) -> DataFrame:
    """``k, est``: frequency and one for the doorkeeper."""
    return frequency(df, key).select("k", (F.col("freq") + 1).alias("est"))


def victims(estimates: DataFrame, n: int = SAMPLE) -> DataFrame:
    """The ``n`` least frequent keys, ties by key."""
    return estimates.orderBy("est", "k").limit(n)


def room(df: DataFrame, key: str, cost: str, max_cost: int) -> DataFrame:
    """``k, cost, room``: what is left after each admission in key order."""
    rows = ordered.running_sum(df.select(F.col(key).alias("k"), F.col(cost).alias("cost")), F.col("cost").cast("long"), "k", out="_used")
    return rows.select("k", "cost", (F.lit(max_cost).cast("long") - F.col("_used")).alias("room"))


@dataclass
class Admission:
    """State of one policy: what is resident at what cost, and how often keys were accessed."""

    max_cost: int
    counters: int = 10_000
    residents: dict[int, int] = field(default_factory=dict)
    doorkeeper: set[int] = field(default_factory=set)
    counts: dict[int, int] = field(default_factory=dict)
    heap: list[tuple[int, int]] = field(default_factory=list)
    ranked: set[int] = field(default_factory=set)
    used: int = 0
    accesses: int = 0

    def access(self, key: int, times: int = 1) -> None:
        """First sight goes to the doorkeeper, later ones count; all counts halve after ``counters`` accesses."""
        while times > 0:
            n = min(times, max(1, self.counters - self.accesses))  # up to the next halving
            times -= n
            self.accesses += n
            if key not in self.doorkeeper:
                self.doorkeeper.add(key)
                n -= 1
            if n:
                self.counts[key] = min(COUNTER_MAX, self.counts.get(key, 0) + n)
            if self.accesses >= self.counters:
                self.accesses = 0
                self.doorkeeper.clear()
                self.counts = {k: c // 2 for k, c in self.counts.items() if c > 1}
                self._rebuild()

    def frequency(self, key: int) -> int:
        return self.counts.get(key, 0) + (key in self.doorkeeper)

    def _rank(self, key: int) -> tuple[int, int]:
        return self.frequency(key), key

    def _rebuild(self) -> None:
        self.ranked = set(self.residents)
        self.heap = [self._rank(k) for k in self.residents]
        heapq.heapify(self.heap)

    def _least(self) -> int:
        """The least frequent resident, ties by key.

        The heap holds a rank for each resident that is not above its present one, so those that have
        risen go back in.  It is built anew where residents are not in it, and after a halving.
        """
        if len(self.ranked) != len(self.residents):
            self._rebuild()
        while True:
            hits, key = self.heap[0]
            if key in self.residents and (rank := self._rank(key)) == (hits, key):
                return key
            heapq.heappop(self.heap)
            if key in self.residents:
                heapq.heappush(self.heap, rank)

    def add(self, key: int, cost: int) -> tuple[list[tuple[int, int]], bool]:
        """Evicted keys with their costs, and whether the key was admitted."""
        if cost > self.max_cost:
            return [], False
        if key in self.residents:
            self.used += cost - self.residents[key]
            self.residents[key] = cost
            return [], False
        gone: list[tuple[int, int]] = []
        hits = self.frequency(key)
        while self.used + cost > self.max_cost:
            victim = self._least()
            if hits < self.frequency(victim):
                return gone, False
            gone.append((victim, self.residents[victim]))
            self.remove(victim)
        self.residents[key] = cost
        self.used += cost
        self.ranked.add(key)
        heapq.heappush(self.heap, self._rank(key))
        return gone, True

    def remove(self, key: int) -> None:
        self.used -= self.residents.pop(key, 0)
        self.ranked.discard(key)

    def update(self, key: int, cost: int) -> bool:
        if key not in self.residents:
            return False
        self.used += cost - self.residents[key]
        self.residents[key] = cost
        return True


def cost_of(residents: DataFrame, wanted: DataFrame) -> DataFrame:
    """``k, cost`` for each ``k`` of ``wanted``: the cost of a resident, -1 for others."""
    return wanted.join(residents.select("k", F.col("cost").cast("long").alias("cost")), "k", "left").select("k", F.coalesce("cost", F.lit(-1).cast("long")).alias("cost"))


def replay(ops: DataFrame, max_cost: int, shards: int = 1, gets: bool = False) -> DataFrame:
    """Replay ``seq, op, key, cost`` (op: add, access, remove, update) in order of ``seq``, a policy per shard.

    Rows ``shard, seq, key, event, cost``: admit, reject, update, remove and evict; with ``gets`` also
    hit or miss for every access, by whether the key is resident.  A column ``times`` says how many equal
    accesses a row stands for, so that they are shuffled and sorted as one.
    """
    ship(ops.sparkSession)
    share = max(1, max_cost // shards)
    times = F.col("times") if "times" in ops.columns else F.lit(1)
    rows = ops.select(F.pmod("key", F.lit(shards)).cast("long").alias("shard"), F.col("seq").cast("long"), "op", F.col("key").cast("long"), F.col("cost").cast("long"), times.cast("int").alias("times"))
    rows = rows.repartition(shards, "shard").sortWithinPartitions("shard", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current = Admission(share), None
        for batch in batches:
            out: list[tuple] = []
            for shard, seq, op, key, cost, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != current:
                    state, current = Admission(share), shard
                if op == "access":
                    if gets:
                        out.append((shard, seq, key, "hit" if key in state.residents else "miss", 0, n))
                    state.access(key, n)
                elif op == "remove":
                    if key in state.residents:
                        out.append((shard, seq, key, "remove", state.residents[key], 1))
                    state.remove(key)
                elif op == "update":
                    if state.update(key, cost):
                        out.append((shard, seq, key, "update", cost, 1))
                else:
                    resident = key in state.residents
                    gone, added = state.add(key, cost)
                    out += [(shard, seq, v, "evict", lost, 1) for v, lost in gone]
                    out.append((shard, seq, key, "admit" if added else "update" if resident and cost <= share else "reject", cost, 1))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["shard", "seq", "key", "event", "cost", "times"])

    found = rows.mapInArrow(run, "shard long, seq long, key long, event string, cost long, times int")
    if gets and "times" in ops.columns:
        found = found.withColumn("_each", F.explode(F.array_repeat(F.lit(1), F.col("times"))))
    return found.select("shard", "seq", "key", "event", "cost")
