"""Quality classifier by co-training.

Two logistic classifiers look at two views of a document: its text (hashed byte trigrams and a few
ratios) and its metadata (source, language, length).  They start from labelled documents.  In
each round both classifiers score *all* unlabelled documents in one distributed pass; the documents
of which a classifier is surest join the other one's training rows at a lower weight, ``PER_ROUND``
more in each round, good and bad ones in the labels' shares.  At the end each view's score is
calibrated on scores that labelled documents got from classifiers that had not seen them, the
calibrated views are combined by a logistic rule fitted on the same scores, and every document
is scored.

Three pairs of classifiers are trained side by side, one on all labelled documents and one without
each of two folds, from the same scoring passes.  The only sample is that of the labelled rows: at
most about ``max_labelled`` of them, by the hash of the whole row.  Training runs in one executor task
over these and the pseudo-labelled rows, whose number is bounded too; the driver gets a few thousand
weights.

Defined results.  Null or empty text: a text of no words, scored like any other; very long texts are
read whole.  Null metadata: a value of its own.  Repeated rows get equal scores, and equal contents
are one pseudo-label.  No labels, or labels of one class only: every document gets that class's
share (0.5 without labels) as its score.  Conflicting labels of an id: the lower.  Null ids have no
label.  Empty table: empty result.  Other columns are kept; one named like a result is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.shared import give_back, materialize, ship, slices

BITS = 11
SIZE = 1 << BITS
MAX_LABELLED = 6000
ROUNDS, PER_ROUND, SURE, PSEUDO_WEIGHT = 3, 400, 0.9, 0.3
FOLDS = 2  # two: the rows without one fold are then one run of rows, which needs no copy
KEEP_FROM = 0.5

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[np.frombuffer(b"#*$%&|<>!{}[]~^=+_\\@", dtype=np.uint8)] = True
DENSE, SOURCES, LANGS, LENGTHS = 12, 64, 16, 12
META = SOURCES + LANGS + LENGTHS


def text_view(data: bytes | None) -> np.ndarray:
    """Features of a text: roots of the shares of hashed byte trigrams, and ratios."""
    data = data or b""
    out = np.zeros(SIZE + DENSE, dtype=np.float32)
    values = np.frombuffer(data, dtype=np.uint8)
    n = len(values)
    dense = out[SIZE:]
    if n >= 3:
        wide = values.astype(np.uint32)
        with np.errstate(over="ignore"):
            grams = (wide[:-2] * np.uint32(0x9E3779B1)) ^ (wide[1:-1] * np.uint32(0x85EBCA77)) ^ (wide[2:] * np.uint32(0xC2B2AE3D))
            grams = (grams * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)
        counts = np.bincount(grams, minlength=SIZE)
        out[:SIZE] = np.sqrt(counts / (n - 2))
        dense[0] = np.count_nonzero(counts) / min(n - 2, SIZE)
        dense[1] = counts.max() / (n - 2)
    if n:
        words = data.split()
        distinct = set(words)
        lines = [x for x in data.split(b"\n") if x]
        upper = np.count_nonzero((values >= 65) & (values <= 90))
        lower = np.count_nonzero((values >= 97) & (values <= 122))
        dense[2] = upper / max(1, upper + lower)
        dense[3] = np.count_nonzero(_SYMBOLS[values]) / n
        dense[4] = np.count_nonzero((values >= 48) & (values <= 57)) / n
        dense[5] = len(distinct) / max(1, len(words))
        dense[6] = min(1.0, n / max(1, len(words)) / 20)
        dense[7] = 1 - len(set(lines)) / max(1, len(lines))
        dense[8] = np.log1p(len(words)) / 10
        dense[9] = min(1.0, len(lines) / max(1, len(words)))
        dense[10] = min(1.0, len(words) / 20)
        same = sum(a == b for a, b in zip(words, words[1:], strict=False))
        dense[11] = same / max(1, len(words))
    return out


def metadata_view(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(META, dtype=np.float32)
    out[zlib.crc32(b"\x00" if source is None else b"s" + str(source).encode()) % SOURCES] = 1
    out[SOURCES + zlib.crc32(b"\x00" if lang is None else b"l" + str(lang).encode()) % LANGS] = 1
    out[SOURCES + LANGS + (LENGTHS - 1 if n_chars is None or n_chars < 0 else min(LENGTHS - 2, int(n_chars).bit_length() // 2))] = 1
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


Block = tuple[np.ndarray, np.ndarray, float]  # rows, labels and the weight of each row


def logistic(blocks: list[Block], ridge: float, steps: int = 120) -> tuple[np.ndarray, float]:
    """Weighted ridge-logistic regression by accelerated gradient steps; classes weigh alike.  Rows are not copied."""
    good = sum(w * float((y > 0.5).sum()) for _, y, w in blocks)
    bad = sum(w * float((y <= 0.5).sum()) for _, y, w in blocks)
    weights = [(w * np.where(y > 0.5, 0.5 / max(1e-9, good), 0.5 / max(1e-9, bad))).astype(np.float32) for _, y, w in blocks]
    bound = sum(float(np.einsum("i,ij,ij->", w, x, x)) for (x, _, _), w in zip(blocks, weights, strict=True)) + 1.0  # of the features' second moment
    rate = 1 / (0.25 * bound + ridge)
    w = np.zeros(blocks[0][0].shape[1], dtype=np.float32)
    b, v, vb = 0.0, w.copy(), 0.0
    for i in range(steps):
        slope, slope_b = ridge * v, 0.0
        for (x, y, _), weight in zip(blocks, weights, strict=True):
            error = ((sigmoid(x @ v + vb) - y) * weight).astype(np.float32)
            slope = slope + x.T @ error
            slope_b += float(error.sum())
        new, new_b = v - rate * slope, vb - rate * slope_b
        pace = i / (i + 3)
        v, vb = new + pace * (new - w), new_b + pace * (new_b - b)
        w, b = new, new_b
    return w, b


@dataclass
class Model:
    text: tuple[np.ndarray, float]
    meta: tuple[np.ndarray, float]
    text_scale: tuple[float, float]  # calibration of a view: probability = sigmoid(a * score + b)
    meta_scale: tuple[float, float]
    rule: tuple[float, float, float]  # combination of the calibrated views' log odds
    constant: float | None = None

    def views(self, x: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated log odds of both views."""
        t, u = x @ self.text[0] + self.text[1], m @ self.meta[0] + self.meta[1]
        return self.text_scale[0] * t + self.text_scale[1], self.meta_scale[0] * u + self.meta_scale[1]

    def scores(self, x: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.constant is not None:
            same = np.full(len(x), self.constant)
            return same, same, same
        t, u = self.views(x, m)
        return sigmoid(t), sigmoid(u), sigmoid(self.rule[0] * t + self.rule[1] * u + self.rule[2])


RIDGE_TEXT, RIDGE_META = 1e-4, 1e-3


def wanted(share: float, turn: int) -> tuple[int, int]:
    """How many bad and how many good pseudo-labels a classifier gives in a round (from 0)."""
    n = PER_ROUND * (turn + 1)
    return max(1, round(n * (1 - share))), max(1, round(n * share))


def platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """``a, b`` of ``sigmoid(a * score + b)`` by Newton steps on smoothed targets."""
    good, bad = float(y.sum()), float((1 - y).sum())
    target = np.where(y > 0.5, (good + 1) / (good + 2), 1 / (bad + 2))
    return tuple(newton(score[:, None], target, 1e-3))


def newton(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1).astype(np.float64)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= np.clip(step, -5, 5)
    return w


def groups(y: np.ndarray, fold: np.ndarray) -> list[slice]:
    """The training rows of each pair of classifiers: all rows, then all without each fold, if those have both classes often enough.

    Rows are in the order of their folds, of which there are two.
    """
    cut = int(np.searchsorted(fold, 1))
    every = [slice(0, len(y)), slice(cut, len(y)), slice(0, cut)]
    enough = all(min((y[g] > 0.5).sum(), (y[g] <= 0.5).sum()) >= 2 for g in every)
    return every if enough else every[:1]


Pair = tuple[tuple[np.ndarray, float], tuple[np.ndarray, float]]


def fit_pairs(x: np.ndarray, m: np.ndarray, y: np.ndarray, fold: np.ndarray, pseudo: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]) -> list[Pair]:
    """A text and a metadata classifier per group; ``pseudo``: per (group, view) rows and labels, which weigh less."""
    out = []
    for g, rows in enumerate(groups(y, fold)):
        pair = []
        for view, (data, ridge) in enumerate(((x, RIDGE_TEXT), (m, RIDGE_META))):
            blocks: list[Block] = [(data[rows], y[rows], 1.0)]
            if (g, view) in pseudo and len(pseudo[g, view][1]):
                blocks.append((*pseudo[g, view], PSEUDO_WEIGHT))
            pair.append(logistic(blocks, ridge))
        out.append(tuple(pair))
    return out


def calibrated(x: np.ndarray, m: np.ndarray, y: np.ndarray, fold: np.ndarray, pairs: list[Pair]) -> Model:
    text, meta = pairs[0]
    t, u = x @ text[0] + text[1], m @ meta[0] + meta[1]
    for f, (other_text, other_meta) in enumerate(pairs[1:]):
        held = fold == f
        t[held], u[held] = x[held] @ other_text[0] + other_text[1], m[held] @ other_meta[0] + other_meta[1]
    t, u = t.astype(np.float64), u.astype(np.float64)
    scale_t, scale_u = platt(t, y), platt(u, y)
    rule = newton(np.stack([scale_t[0] * t + scale_t[1], scale_u[0] * u + scale_u[1]], axis=1), y, 1.0)
    return Model(text, meta, scale_t, scale_u, tuple(rule))


def constant(value: float) -> Model:
    return Model((np.zeros(SIZE + DENSE, dtype=np.float32), 0.0), (np.zeros(META, dtype=np.float32), 0.0), (1.0, 0.0), (1.0, 0.0), (1.0, 1.0, 0.0), value)


# --- DataFrame operators -------------------------------------------------------------------

_INPUTS = ("text", "source", "lang", "n_chars")


def _view_batches(texts: list[bytes | None], sources: list, langs: list, chars: list) -> tuple[np.ndarray, np.ndarray]:
    x = np.array([text_view(t) for t in texts], dtype=np.float32).reshape(len(texts), SIZE + DENSE)
    m = np.array([metadata_view(*v) for v in zip(sources, langs, chars, strict=True)], dtype=np.float32).reshape(len(texts), META)
    return x, m


def _inputs(df: DataFrame, text: str, source: str, lang: str, n_chars: str) -> list:
    return [F.col(text).cast("binary").alias("text"), F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"), F.col(n_chars).cast("long").alias("n_chars")]


def _hash(*names: str) -> Column:
    return F.xxhash64(*(x for c in names for x in (F.col(c), F.col(c).isNull())))


def _features(df: DataFrame, key: str) -> DataFrame:
    """``key, x, m``: packed features of ``key`` and the inputs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            x, m = _view_batches(*(c.to_pylist() for c in part.columns[1:]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in m], pa.binary())], names=["key", "x", "m"])

    return df.select(key, *_INPUTS).mapInArrow(run, "key long, x binary, m binary")


def _labelled(inputs: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """``fold, y, x, m`` of about ``most`` labelled rows at most, by the hash of the row."""
    rows = inputs.withColumn("row", _hash("id", *_INPUTS)).withColumn("key", _hash(*_INPUTS))
    slim = materialize(rows.select("id", "row", "key").join(known, "id").groupBy("row").agg(F.min("key").alias("key"), F.min("y").alias("y")), "cotraining-known", narrow=True)
    n = slim.count()
    if n > most:  # about ``most``: rows are taken by a bound of their hash
        slim = slim.where(F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(1 << 31)) < int((1 << 31) * most / n))
    slim = materialize(slim, "cotraining-sample", narrow=True)
    texts = rows.join(F.broadcast(slim.select("row")), "row").groupBy("row").agg(*(F.first(c).alias(c) for c in _INPUTS))
    found = _features(texts, "row").withColumnRenamed("key", "row").join(slim, "row")
    return materialize(found.select(F.pmod("key", F.lit(FOLDS)).cast("int").alias("fold"), "row", "y", "x", "m"), "cotraining-labelled", narrow=True)


_TRAINING = "fold int, row long, y double, x binary, m binary, pair int, view int, turn int"
_WEIGHTS = "pair int, view int, w binary, b double, share double"


def _trained(labelled: DataFrame, pseudo: list[DataFrame], last: bool) -> list:
    """Train all pairs in one task.  Rows of weights; at last one of pair -1 with the calibration."""
    lit = lambda x, kind: F.lit(x).cast(kind)
    rows = labelled.select("fold", "row", "y", "x", "m", lit(None, "int").alias("pair"), lit(None, "int").alias("view"), lit(None, "int").alias("turn"))
    for more in pseudo:
        rows = rows.union(more.select(lit(None, "int"), F.col("key"), "y", "x", "m", "pair", "view", "turn"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[tuple] = []
        extra: dict[tuple[int, int], dict[int, tuple]] = {}
        view = lambda c, i: np.frombuffer(c[i].as_buffer(), dtype=np.float32).copy()
        for batch in batches:
            fold, row, y, pair, side, turn = (batch.column(c).to_pylist() for c in (0, 1, 2, 5, 6, 7))
            for i in range(batch.num_rows):
                if pair[i] is None:
                    known.append((fold[i], row[i], y[i], view(batch.column(3), i), view(batch.column(4), i)))
                else:  # the newest label of a row counts
                    held = extra.setdefault((pair[i], side[i]), {})
                    if row[i] not in held or held[row[i]][0] < turn[i]:
                        held[row[i]] = turn[i], y[i], view(batch.column(4 if side[i] else 3), i)
        known.sort(key=lambda r: r[:2])  # the order in which rows arrive must not matter
        x, m = np.array([r[3] for r in known]), np.array([r[4] for r in known])
        y, fold = np.array([r[2] for r in known], dtype=np.float32), np.array([r[0] for r in known])
        known.clear()
        given = {}
        for at in list(extra):
            held = extra.pop(at)
            taken = [held[k] for k in sorted(held)]
            given[at] = np.array([r[2] for r in taken]), np.array([r[1] for r in taken], dtype=np.float32)
        held = taken = None
        pairs = fit_pairs(x, m, y, fold, given)
        shares = [float(y[g].mean()) for g in groups(y, fold)]
        out = [(g, v, np.asarray(w, dtype=np.float32).tobytes(), float(b), shares[g]) for g, pair in enumerate(pairs) for v, (w, b) in enumerate(pair)]
        if last:
            c = calibrated(x, m, y, fold, pairs)
            out.append((-1, 0, np.array([*c.text_scale, *c.meta_scale, *c.rule]).tobytes(), 0.0, 0.0))
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["pair", "view", "w", "b", "share"])
        del x, m, given
        give_back()

    return rows.toDF(*(f.split()[0] for f in _TRAINING.split(", "))).coalesce(1).mapInArrow(run, _WEIGHTS).collect()


def _chosen(inputs: DataFrame, known: DataFrame, weights: list, turn: int) -> DataFrame:
    """``key, pair, view, y``: the pseudo-labels that each classifier gives to the other view, from all unlabelled documents."""
    order = sorted((r["pair"], r["view"], r["w"], r["b"], r["share"]) for r in weights)
    columns = [f"z{i}" for i in range(len(order))]
    texts = np.stack([np.frombuffer(w, dtype=np.float32) for _, v, w, _, _ in order if not v], axis=1)
    metas = np.stack([np.frombuffer(w, dtype=np.float32) for _, v, w, _, _ in order if v], axis=1)
    base = np.array([b for _, _, _, b, _ in order])
    sure = float(np.log(SURE / (1 - SURE)))
    kind = inputs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            x, m = _view_batches(*(c.to_pylist() for c in part.columns[2:]))
            z = np.empty((part.num_rows, len(order)))
            z[:, 0::2], z[:, 1::2] = x @ texts, m @ metas
            z = np.round(z + base, 4)
            keep = pa.array((np.abs(z) >= sure).any(axis=1))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(z[:, i]) for i in range(len(order)))], names=["id", "key", *columns]).filter(keep)
        give_back()

    rows = inputs.select("id", _hash(*_INPUTS).alias("key"), *_INPUTS)
    found = rows.mapInArrow(run, f"id {kind}, key long, " + ", ".join(f"{c} double" for c in columns))
    found = found.join(known.select("id"), "id", "left_anti").groupBy("key").agg(*(F.max(c).alias(c) for c in columns))
    found = materialize(found, "cotraining-scores", narrow=True)
    lists = []
    for c, (pair, view, _, _, share) in zip(columns, order, strict=True):
        bad, good = wanted(share, turn)
        for n, y, where, by in ((bad, 0.0, F.col(c) <= -sure, F.asc(c)), (good, 1.0, F.col(c) >= sure, F.desc(c))):
            best = found.where(where).select("key", c).orderBy(by, "key").limit(n)
            lists.append(best.select("key", F.lit(pair).alias("pair"), F.lit(1 - view).alias("view"), F.lit(y).alias("y")))
    every = lists[0]
    for x in lists[1:]:
        every = every.union(x)
    return materialize(every, "cotraining-chosen")


def _pseudo(inputs: DataFrame, chosen: DataFrame, turn: int) -> DataFrame:
    """The chosen rows with the features that they are chosen for; ``chosen`` is bounded by :func:`wanted`."""
    rows = inputs.select(_hash(*_INPUTS).alias("key"), *_INPUTS)
    texts = rows.join(F.broadcast(chosen.select("key").distinct()), "key").groupBy("key").agg(*(F.first(c).alias(c) for c in _INPUTS))
    found = _features(texts, "key").join(chosen, "key")
    only = lambda c, view: F.when(F.col("view") == view, F.col(c)).alias(c)
    return materialize(found.select("key", "pair", "view", "y", only("x", 0), only("m", 1), F.lit(turn).alias("turn")), "cotraining-pseudo", narrow=True)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality", text: str = "text", source: str = "source", lang: str = "lang", n_chars: str = "n_chars", max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on about ``max_labelled`` labelled rows at most, and on pseudo-labels chosen from all other documents."""
    ship(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.min(label).cast("double") > 0.5).cast("double").alias("y"))
    known = materialize(known, "cotraining-labels", narrow=True)
    inputs = docs.select(F.col(id_col).alias("id"), *_inputs(docs, text, source, lang, n_chars))
    labelled = _labelled(inputs, known, max_labelled)
    classes = {r["y"] for r in labelled.select("y").distinct().collect()}
    if len(classes) < 2:
        return constant(classes.pop() if classes else 0.5)
    pseudo: list[DataFrame] = []
    for turn in range(ROUNDS):
        weights = _trained(labelled, pseudo, last=False)
        pseudo.append(_pseudo(inputs, _chosen(inputs, known, weights, turn), turn))
    weights = {(r["pair"], r["view"]): (np.frombuffer(r["w"], dtype=np.float32 if r["pair"] >= 0 else np.float64), r["b"]) for r in _trained(labelled, pseudo, last=True)}
    scale = weights[-1, 0][0].tolist()
    return Model(weights[0, 0], weights[0, 1], tuple(scale[:2]), tuple(scale[2:4]), tuple(scale[4:]))


def score(df: DataFrame, model: Model, text: str = "text", source: str = "source", lang: str = "lang", n_chars: str = "n_chars", keep: list[str] | None = None, out: str = "quality") -> DataFrame:
    """``keep`` columns (all by default), ``<out>_text`` and ``<out>_meta`` (each view's probability), ``out`` and ``<out>_kept``."""
    ship(df.sparkSession)
    names = [f"{out}_text", f"{out}_meta", out, f"{out}_kept"]
    keep = [c for c in (df.columns if keep is None else keep) if c not in names]
    source_df = df.select(*(F.col(f"`{c}`") for c in keep), *(c.alias(f"__cairn_{i}") for i, c in enumerate(_inputs(df, text, source, lang, n_chars))))
    schema = T.StructType([*df.select(*(F.col(f"`{c}`") for c in keep)).schema, *(T.StructField(c, T.DoubleType()) for c in names[:3]), T.StructField(names[3], T.BooleanType())])
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, n):
            x, m = _view_batches(*(c.to_pylist() for c in part.columns[n:]))
            t, u, p = (v.astype(np.float64) for v in model.scores(x, m))
            yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(t), pa.array(u), pa.array(p), pa.array(p >= KEEP_FROM)], names=[*keep, *names])

    return source_df.mapInArrow(run, schema)


def accepted(df: DataFrame, model: Model, **columns: str) -> DataFrame:
    """The rows of ``df`` that the classifier keeps, columns unchanged."""
    out = "__cairn_quality"
    return score(df, model, out=out, **columns).where(F.col(f"{out}_kept")).select(*(F.col(f"`{c}`") for c in df.columns))
