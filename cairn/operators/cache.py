"""Cache semantics on tables: upserts with cost and expiry, reads at a time, expiry buckets, shards, batches.

An entry lives while ``now <= exp``; a null ``exp`` never expires.  Expiry buckets are five seconds wide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import codec
from cairn.operators import memtable, ordered

BUCKET_SECONDS, SHARDS, BATCH = 5, 256, 64


def expiry(ts: Column, hours: Column) -> Column:
    """``ts`` and ``hours``; null (no expiry) for 0."""
    return F.when(hours != 0, ts + F.make_dt_interval(F.lit(0), hours.cast("int")))


def cost(given: Column, fallback: Column) -> Column:
    """A given cost above 0, else that of the cost function."""
    return F.when(given > 0, given).otherwise(fallback)


def is_live(exp: Column, now: Column) -> Column:
    return exp.isNull() | (exp >= now)


def get_at(df: DataFrame, key: str, seq: str, ts: str, exp: Column, value: str, now: Column) -> DataFrame:
    """``k, v`` of the entries live at ``now``, of what was inserted by then."""
    last = memtable.newest(df.where(F.col(ts) <= now), key, seq, v=F.col(value), exp=exp)
    return last.where(is_live(F.col("exp"), now)).select("k", "v")


def sweep(df: DataFrame, key: str, seq: str, ts: str, exp: Column, now: Column) -> DataFrame:
    """``k, seq`` of the entries that a sweep at ``now`` evicts: every bucket, no tick missed."""
    last = memtable.newest(df.where(F.col(ts) <= now), key, seq, exp=exp)
    return last.where(~is_live(F.col("exp"), now)).select("k", "seq")


def expiration(df: DataFrame, key: str, seq: str, exp: Column) -> DataFrame:
    """``k, exp`` with the epoch for entries that do not expire."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return memtable.newest(df, key, seq, exp=exp).select("k", F.coalesce("exp", epoch).alias("exp"))


def storage_bucket(exp: Column) -> Column:
    """The bucket that an expiry is stored in; the one to clean is the one before."""
    micros, width = F.unix_micros(exp.cast("timestamp")), BUCKET_SECONDS * 1_000_000
    return ((micros - F.pmod(micros, F.lit(width))) / width).cast("long") + 1


def clean_bucket(now: Column) -> Column:
    return storage_bucket(now) - 1


def bucket_sizes(df: DataFrame, exp: Column) -> DataFrame:
    return df.select(exp.alias("e")).where("e is not null").groupBy(storage_bucket(F.col("e")).alias("bucket")).agg(F.count("*").alias("n"))


def registered(df: DataFrame, key: str, seq: str, exp: Column) -> DataFrame:
    """``bucket, k``: the newest expiry of each key."""
    last = memtable.newest(df, key, seq, exp=exp).where("exp is not null")
    return last.select(storage_bucket(F.col("exp")).alias("bucket"), "k")


def removed(df: DataFrame, key: str, gone: DataFrame, gone_key: str) -> DataFrame:
    """Entries that stay after removing keys."""
    return df.join(gone.select(F.col(gone_key).alias(key)), key, "left_anti")


def update_cost(residents: DataFrame, updates: DataFrame) -> DataFrame:
    """``k, cost`` with new costs for the resident keys of ``updates``."""
    return residents.join(updates.select("k", F.col("cost").alias("_new")), "k", "left").select("k", F.coalesce("_new", "cost").alias("cost"))


def cleared(df: DataFrame, key: str, seq: str) -> DataFrame:
    """An eviction for every resident."""
    return df.groupBy(F.col(key).alias("k")).agg(F.max(seq).alias("seq")).withColumn("event", F.lit("evict"))


def shard(key: Column, shards: int = SHARDS) -> Column:
    return F.pmod(key, F.lit(shards))


def shard_sizes(df: DataFrame, key: str, shards: int = SHARDS) -> DataFrame:
    return df.groupBy(shard(F.col(key).cast("long"), shards).alias("shard")).agg(F.count("*").alias("n"))


def batches(df: DataFrame, order: str, size: int = BATCH) -> DataFrame:
    """``batch, n, first_id`` of the full access batches; a part batch is never delivered."""
    rows = ordered.row_numbers(df.select(order), order)
    full = rows.groupBy(F.floor(F.col("rn") / size).cast("long").alias("batch")).agg(F.count("*").alias("n"), F.min(order).alias("first_id"))
    return full.where(F.col("n") == size)


def gets(df: DataFrame, order: str, size: int = BATCH) -> DataFrame:
    """``kept, dropped, waiting`` accesses: those of full batches reach the policy, the rest waits; a table drops none."""
    total = df.agg(F.count(order).alias("n"))
    kept = (F.floor(F.col("n") / size) * size).cast("long")
    return total.select(kept.alias("kept"), F.lit(0).cast("long").alias("dropped"), (F.col("n") - kept).alias("waiting"))


def seen_before(df: DataFrame, key: str, seq: str) -> DataFrame:
    """``seq, k, seen``: whether a key was accessed before.

    A key's first access is an aggregate; comparing with it needs no window over a hot key.
    """
    firsts = df.groupBy(F.col(key).alias("k")).agg(F.min(seq).alias("_first"))
    return df.select(F.col(seq).alias("seq"), F.col(key).alias("k")).join(firsts, "k").select("seq", "k", (F.col("seq") > F.col("_first")).alias("seen"))


def residency(df: DataFrame, key: str, seq: str, ts: str) -> DataFrame:
    """``hours, n``: whole hours between a version and the one that replaces it."""
    rows = ordered.previous(df.select(F.col(key).alias("k"), F.col(seq).alias("seq"), F.unix_micros(F.col(ts).cast("timestamp")).alias("a")), ["k", "a"], "k", "seq")
    rows = rows.where(F.col("_prev.k").eqNullSafe(F.col("k")) & F.col("_prev").isNotNull())
    gap, hour = F.col("a") - F.col("_prev.a"), 3_600_000_000
    return rows.groupBy(((gap - F.pmod(gap, F.lit(hour))) / hour).cast("long").alias("hours")).agg(F.count("*").alias("n"))


# --- conflict hashes -----------------------------------------------------------------------


def hashed(df: DataFrame, key: str, integral: bool, **columns: Column) -> DataFrame:
    """``h, conflict`` of a cache key, and ``columns``."""
    h, conflict = codec.key_hash(F.col(key), integral)
    return df.select(h.alias("h"), conflict.alias("conflict"), *(c.alias(n) for n, c in columns.items()))


def set_checked(entries: DataFrame, seq: str) -> DataFrame:
    """What a map keyed by ``h`` holds after sets in order of ``seq``: a set with another conflict hash than the entry's is ignored.

    The first set of a hash fixes its conflict hash.  Later sets count if theirs is equal, or 0, which
    is the entry's from then on.  Both bounds are aggregates, so no hash needs its sets in order.
    """
    zero = F.min(F.when(F.col("conflict") == 0, F.col(seq)))
    first = entries.groupBy("h").agg(F.min_by("conflict", seq).alias("_c"), zero.alias("_z"))
    same = (F.col("conflict") == F.col("_c")) & (F.col("_z").isNull() | (F.col(seq) < F.col("_z")))
    rows = entries.join(first, "h").where((F.col("conflict") == 0) | same)
    kept = F.struct("conflict", seq, *(c for c in entries.columns if c not in ("h", "conflict", seq)))
    return rows.groupBy("h").agg(F.max_by(kept, seq).alias("_m")).select("h", "_m.*")


def get_checked(held: DataFrame, probes: DataFrame) -> DataFrame:
    """``probes`` (``h, conflict``) with the columns of the entry; null where there is none or the conflict hash differs; 0 asks for any."""
    entry = held.select(F.col("h"), F.col("conflict").alias("_c"), F.struct(*(c for c in held.columns if c not in ("h", "conflict"))).alias("_m"))
    rows = probes.join(entry, "h", "left")
    fits = (F.col("conflict") == 0) | (F.col("conflict") == F.col("_c"))
    return rows.withColumn("_m", F.when(fits, F.col("_m"))).select(*probes.columns, "_m.*")


def remove_checked(held: DataFrame, gone: DataFrame) -> DataFrame:
    """``held`` with ``removed``: whether a removal of ``gone`` (``h, conflict``) hits the entry, whose old value then stands there."""
    asked = gone.groupBy("h").agg(F.collect_set("conflict").alias("_cs"))  # few kinds: a hash has two conflict hashes or so
    hit = F.coalesce(F.array_contains("_cs", F.lit(0).cast("long")) | F.array_contains(F.col("_cs"), F.col("conflict")), F.lit(False))
    return held.join(asked, "h", "left").withColumn("removed", hit).drop("_cs")


def cleaned(df: DataFrame, key: str, seq: str, exp: Column, at: Column) -> DataFrame:
    """``k``: what a sweep of the single bucket to clean at ``at`` evicts."""
    return registered(df, key, seq, exp).where(F.col("bucket") == clean_bucket(at)).select("k")
