"""Mixing sources to target weights, in DataFrame operations only.

Each source gets a budget in words (:func:`targets`).  A document's hash decides how often it is
taken: ``whole = floor(target / source_size)`` times for all documents of the source and once
more where its hash lies below the source's threshold.  The threshold comes from histograms: words
summed by source and by the leading ``BITS`` bits of the hash; the bucket in which the budget ends
is the only one that is summed again, by the next ``BITS`` bits, and so on.  Documents are never
sorted, thresholds are nested (a larger budget takes a superset) and reruns agree.

Defined results.  Null text: size 0.  Null source: a source of its own, last in order.  Of rows that
are equal in id, source and text each gets a hash of its own, so a large group of them is taken in
part as other documents are; which of them does not matter.  A source without words has target 0 and
takes nothing.  Very long texts are read whole; one document is the least that can be taken.  Empty
table: empty result.  Other columns are ignored by :func:`taken` and kept by :func:`sample`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.shared import discard, materialize
from cairn.operators import ordered

BITS, LEVELS = 12, 4
WEIGHTS = (3, 1, 2)


def words(text: str) -> Column:
    """Number of words divided by ASCII white space."""
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """Targets of ``(src, source_size)``, one row a source: columns ``weight`` and ``target``.

    Sources in code point order, null last, take the weights in turn and share ``share`` times
    all words by weight.  A target stops at ``limit`` times its source's size and the excess is
    shared again by weight.  The fixed point of that has one level: every source below its limit
    gets ``level * weight``.  With sources in the order of ``limit / weight`` the first ``j`` are at
    their limit, where j is the least for which the level of the rest is below the next limit.
    The windows run over one row a source, not over documents.
    """
    order = Window.orderBy(F.col("src").isNull(), "src")
    turn = (F.row_number().over(order) - 1) % len(weights)
    rows = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double"))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(limit)))
    every = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("src").isNull(), "src")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "*",
        (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("left"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("open"),
    )
    rows = rows.withColumn("level", F.col("left") / F.col("open"))
    stays = F.col("level") * F.col("weight") <= F.col("cap")
    rows = rows.withColumn("level", F.min(F.when(stays, F.struct(F.col("cap") / F.col("weight"), "level"))).over(every)["level"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return rows.select("src", "source_size", "weight", target.alias("target"))


def _hash(*parts: Column) -> Column:
    """The leading 48 bits of the MD5 of the parts: BITS * LEVELS bits that SQL can compute too."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def row_hash(key: list[str], text: str) -> Column:
    return _hash(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (*key, text)))


def told_apart(rows: DataFrame, same: list[str], hashed: str) -> DataFrame:
    """``rows`` with a hash of its own for each of those that agree in ``same`` and their hash.

    Only repeated rows move.  They are numbered in a global order that ends with a number of the
    row, so a large group is spread over the partitions.
    """
    names = [*same, hashed]
    groups = materialize(rows.groupBy(*(F.col(f"`{c}`") for c in names)).agg(F.count("*").alias("__cairn_n")).where("__cairn_n > 1").toDF(*(f"__cairn_g{i}" for i in range(len(names))), "__cairn_n"), "mixing-repeated", narrow=True)
    if groups.isEmpty():
        discard(groups)
        return rows

    def agree(right: str) -> Column:
        found = F.lit(True)
        for i, c in enumerate(names):
            found = found & F.col(f"`{c}`").eqNullSafe(F.col(f"{right}{i}"))
        return found

    repeated = rows.join(groups, agree("__cairn_g"), "left_semi").withColumn("__cairn_tie", F.monotonically_increasing_id())
    placed = materialize(ordered.row_numbers(repeated, *(F.col(f"`{c}`") for c in names), "__cairn_tie", out="__cairn_at"), "mixing-placed")
    first = placed.groupBy(*(F.col(f"`{c}`") for c in names)).agg(F.min("__cairn_at").alias("__cairn_first")).toDF(*(f"__cairn_f{i}" for i in range(len(names))), "__cairn_first")
    turn = F.col("__cairn_at") - F.col("__cairn_first")
    own = F.when(turn == 0, F.col(hashed)).otherwise(_hash(F.col(hashed).cast("string"), turn.cast("string")))
    apart = placed.join(first, agree("__cairn_f")).withColumn(hashed, own).select(*(F.col(f"`{c}`") for c in rows.columns))
    return rows.join(groups, agree("__cairn_g"), "left_anti").unionByName(apart)


def _prefix(level: int) -> Column:
    """The leading bits of the hash up to and with ``level`` (from 1)."""
    return F.shiftright("hash", BITS * (LEVELS - level))


def thresholds(slim: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source ``whole`` (times each document is taken) and ``below`` (an unsigned hash bound of BITS * LEVELS bits).

    ``slim``: ``src, size, hash`` per document.  ``goals``: ``src, source_size, target``.
    """
    ratio = F.col("target") / F.col("source_size")
    state = goals.select(
        "src",
        F.when(F.col("source_size") > 0, F.floor(ratio)).otherwise(0).cast("long").alias("whole"),
        F.when(F.col("source_size") > 0, F.col("target") - F.floor(ratio) * F.col("source_size")).otherwise(0.0).alias("rest"),
        F.lit(0).cast("long").alias("at"),
    )
    state = materialize(state, "mixing-state")
    for level in range(1, LEVELS + 1):
        edge = state.select(F.col("src").alias("s"), "at", "rest")
        rows = slim.join(edge, F.col("src").eqNullSafe(F.col("s")))
        if level > 1:  # refine the boundary bucket only
            rows = rows.where(_prefix(level - 1) == F.col("at"))
        sums = rows.groupBy("src", "rest", "at", _prefix(level).alias("bucket")).agg(F.sum("size").alias("n"))
        upto = Window.partitionBy("src").orderBy("bucket")  # at most 2 ** BITS rows a source
        sums = sums.withColumn("sum", F.sum("n").over(upto))
        # the first bucket that would go beyond the budget is the boundary; what lies before it is taken
        over = F.col("sum") > F.col("rest")
        cut = sums.groupBy("src").agg(
            F.min(F.when(over, F.struct("bucket", "n"))).alias("edge"),
            F.coalesce(F.max(F.when(~over, F.col("sum"))), F.lit(0)).alias("used"),
        ).withColumnRenamed("src", "s")
        left = F.col("rest") - F.coalesce("used", F.lit(0))
        # no boundary: all of the source fits, so the bound is beyond every hash
        beyond = F.shiftleft("at", BITS) if level > 1 else F.lit(1 << BITS).cast("long")
        # the last boundary bucket holds single documents; it is taken if that ends nearer to the budget
        nearer = (2 * left >= F.col("edge.n")).cast("long") if level == LEVELS else F.lit(0).cast("long")
        state = state.join(cut, F.col("src").eqNullSafe(F.col("s")), "left").select(
            "src",
            "whole",
            left.alias("rest"),
            F.coalesce(F.col("edge.bucket") + nearer, beyond).cast("long").alias("at"),
        )
        state = materialize(state, "mixing-state")
    return state.select("src", "whole", F.col("at").alias("below"))


def mix(df: DataFrame, key: list[str], source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, limit: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """``(per document, per source)``.

    Per document: ``key`` columns as ``key0, key1, ...``, and ``src, size, hash``.  Per source: ``src, source_size, target,
    whole, below``; small (one row a source) and stored, so a join with it is broadcast by Spark
    if its size allows.
    """
    keys = [f"key{i}" for i in range(len(key))]
    slim = df.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(key, keys, strict=True)), F.col(f"`{source}`").alias("src"), words(text).alias("size"), row_hash(key, text).alias("hash"))
    slim = materialize(slim, "mixing-slim")
    whole, slim = slim, told_apart(slim, [*keys, "src"], "hash")
    slim = slim if slim is whole else materialize(slim, "mixing-slim")
    goals = materialize(targets(slim.groupBy("src").agg(F.sum("size").alias("source_size")), weights, share, limit), "mixing-goals")
    bounds = thresholds(slim, goals).withColumnRenamed("src", "s")
    per_source = goals.join(bounds, F.col("src").eqNullSafe(F.col("s"))).drop("s", "weight")
    return slim, materialize(per_source, "mixing-sources")


def times(hash_col: str = "hash", whole: str = "whole", below: str = "below") -> Column:
    """How often a document is taken."""
    return F.col(whole) + (F.col(hash_col) < F.col(below)).cast("long")


def taken(df: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Per document: id, ``size, source_size, target, taken``."""
    slim, per_source = mix(df, [id_col], source, text)
    rows = slim.join(per_source.withColumnRenamed("src", "s"), F.col("src").eqNullSafe(F.col("s")))
    return rows.select(F.col("key0").alias(id_col), "size", "source_size", "target", (F.col("size") * times()).alias("taken"))


def sample(df: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mixed rows of ``df``: each as often as it is taken, columns unchanged."""
    _, per_source = mix(df, [id_col], source, text)
    per_source = per_source.select(F.col("src").alias("__cairn_src"), "whole", "below").toDF("__cairn_src", "__cairn_whole", "__cairn_below")
    rows = told_apart(df.withColumn("__cairn_hash", row_hash([id_col], text)), [id_col, source], "__cairn_hash")
    rows = rows.join(per_source, F.col(f"`{source}`").eqNullSafe(F.col("__cairn_src")))
    n = times("__cairn_hash", "__cairn_whole", "__cairn_below")
    return rows.withColumn("__cairn_copy", F.explode(F.array_repeat(F.lit(1), n.cast("int")))).select(*(F.col(f"`{c}`") for c in df.columns))
