"""N-best encoding with a SentencePiece model, and decoding.

Every way to cover a text with pieces of the model is a path through a lattice; its score is the
sum of its pieces' scores.  A forward Viterbi pass gives the best score up to every position.  These
scores are exact heuristics for an A-star search that goes backward from the end: the first
complete path it takes from its queue is the best one, the next the second best, and so on.

No piece holds a space mark behind another character, and no piece holds a character that is not
in the model's alphabet, so the lattice falls apart at words and line feeds.  The forward pass finds the best path of each part once per task, and the score of the second-best one;
the N best paths of a text follow from those of the N - 1 parts whose second-best path loses least, so
only these need the A-star search.

A character without a piece of its own is one edge made of byte pieces, and a literal U+2581 is
encoded by bytes too, so decoding gives back every text exactly.  The model's own normaliser must
be the identity with a leading space mark, which loading checks.

Defined results.  Null text: null ids; empty text: no ids; both with score 0.  Paths of equal score
come in the order in which the search meets them, which depends on the text only.  Repeated rows
get equal results.  Very long texts go through whole: a part is searched by itself, and rows reach
Python in slices of bounded bytes.  Empty table: empty result.  Other columns are kept; one with the
name of a result is replaced.
"""

from __future__ import annotations

import heapq
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.shared import give_back, ship, slices

#: The model's mark of a space.  Pieces are kept with plain spaces, so the mark itself has no piece and is written in bytes.
LITERAL, SPACE = "▁", " "
UNKNOWN_PENALTY = 10.0
#: Bytes, about, of the parts that a worker keeps within a task, and of a part without its characters and ids.
CACHE_BYTES, ENTRY = 96 << 20, 200
_NATIVE = sys.byteorder == "little" and array("I").itemsize == 4


def _pack(ids: tuple[int, ...] | list[int]) -> bytes:
    return array("I", ids).tobytes() if _NATIVE else np.array(ids, dtype="<u4").tobytes()


class PieceModel:
    """Pieces, scores and the lattice search of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = " a  é\tz \n"
        if model.normalize(probe) != (SPACE + probe).replace(SPACE, LITERAL):
            raise ValueError("the model's normaliser changes texts")
        self.prefixes: dict[str, tuple[int, float] | None] = {}
        self.bytes: list[int] = [0] * 256
        self.content: list[bytes] = []
        scores = []
        for i in range(model.get_piece_size()):
            marked = model.id_to_piece(i)
            piece = marked.replace(LITERAL, SPACE)
            if model.is_byte(i):
                value = int(marked[3:-1], 16)
                self.bytes[value] = i
                self.content.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i):
                self.content.append(b"")
            else:
                if SPACE in marked or SPACE in piece.lstrip(SPACE):
                    raise ValueError("a piece holds a space mark behind another character")
                score = float(model.get_score(i))
                scores.append(score)
                for n in range(1, len(piece)):
                    self.prefixes.setdefault(piece[:n], None)
                self.prefixes[piece] = (i, score)
                self.content.append(piece.encode())
        self.unknown = min(scores) - UNKNOWN_PENALTY
        self.trie: dict[str, tuple[dict, tuple[int, float] | None]] = {}
        for piece, found in self.prefixes.items():
            node = self.trie
            for c in piece[:-1]:
                node = node.setdefault(c, ({}, None))[0]
            node[piece[-1]] = (node[piece[-1]][0] if piece[-1] in node else {}, found)
        self.feeds = "\n" if not any("\n" in p for p in self.prefixes) else ""
        self.parts = re.compile(rf"{self.feeds}|{SPACE}+[^{SPACE}{self.feeds}]*|[^{SPACE}{self.feeds}]+" if self.feeds else rf"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.limit = CACHE_BYTES
        self.release()

    def lattice(self, part: str) -> tuple[list[list[tuple[int, tuple[int, ...], float]]], list[float]]:
        """Per end: edges ``(begin, ids, score)``; and the forward Viterbi scores."""
        n = len(part)
        prefixes, none = self.prefixes, ()
        ends: list[list[tuple[int, tuple[int, ...], float]]] = [[] for _ in range(n + 1)]
        forward = [float("-inf")] * (n + 1)
        forward[0] = 0.0
        for i in range(n):
            here = forward[i]
            j = i + 1
            found = prefixes.get(part[i:j], none)
            if not found:  # no piece of this character alone
                ends[j].append((i, tuple(self.bytes[b] for b in part[i].encode("utf-8")), self.unknown))
                if here + self.unknown > forward[j]:
                    forward[j] = here + self.unknown
            while found is not none:
                if found:
                    score = found[1]
                    ends[j].append((i, (found[0],), score))
                    if here + score > forward[j]:
                        forward[j] = here + score
                j += 1
                if j > n:
                    break
                found = prefixes.get(part[i:j], none)
        return ends, forward

    def n_best(self, part: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best paths ``(score, ids)`` of a part, by A-star from the end.

        The queue holds the places where a path leaves the best continuation of another one; each
        stands for a whole path of exactly its score.  A place that ``n`` others beat is not queued.
        Of equal scores the one nearest to its path's end goes first.
        """
        ends, forward = self.lattice(part)
        queue: list[tuple[float, int, int, float, tuple | None]] = [(-forward[-1], len(part), 0, 0.0, None)]
        out, tick = [], 0
        bounds: list[float] = []  # scores of the best places met, worst first
        while queue and len(out) < n:
            _, at, _, behind, tail = heapq.heappop(queue)
            while at:
                best = None
                top = float("-inf")
                for edge in ends[at]:
                    total = behind + edge[2]
                    score = forward[edge[0]] + total
                    if score > top:
                        edge, best, score, top, total, kept = best, edge, top, score, kept if best else 0.0, total
                    if edge is not None and (len(bounds) < n or score > bounds[0]):
                        (heapq.heappush if len(bounds) < n else heapq.heapreplace)(bounds, score)
                        tick += 1
                        heapq.heappush(queue, (-score, edge[0], tick, total, (edge[1], tail)))
                at, behind, tail = best[0], kept, (best[1], tail)
            ids: list[int] = []
            while tail is not None:
                ids += tail[0]
                tail = tail[1]
            out.append((behind, tuple(ids)))
        return out

    def viterbi(self, part: str) -> tuple[float, float, bytes]:
        """Scores of the best path and of the second-best one (-inf if there is none), and the best one's ids."""
        n = len(part)
        nothing = float("-inf")
        first, second = [nothing] * (n + 1), [nothing] * (n + 1)
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        first[0] = 0.0
        root, unknown = self.trie, self.unknown
        for i in range(n):
            here, here2, node, j = first[i], second[i], root, i
            hit = root.get(part[i])
            if hit is None or hit[1] is None:  # no piece of this character alone
                j += 1
                a, b = here + unknown, here2 + unknown
                if a > first[j]:
                    second[j] = max(first[j], b)
                    first[j], back[j] = a, (i, -1)
                elif a > second[j]:
                    second[j] = a
                j = i
            while hit is not None:
                node, edge = hit
                j += 1
                if edge is not None:
                    a = here + edge[1]
                    if a > first[j]:
                        b = here2 + edge[1]
                        second[j] = first[j] if first[j] > b else b
                        first[j], back[j] = a, (i, edge[0])
                    elif a > second[j]:
                        second[j] = a
                if j == n:
                    break
                hit = node.get(part[j])
        ids: list[int] = []
        at = n
        while at:
            at, piece = back[at]
            if piece < 0:
                ids += [self.bytes[x] for x in reversed(part[at].encode("utf-8"))]
            else:
                ids.append(piece)
        ids.reverse()
        return first[n], second[n], _pack(ids)

    def _add(self, part: str) -> int:
        """Keep a part's best path and what its second-best one loses."""
        best, second, packed = self.viterbi(part)
        at = len(self.packed)
        if at == len(self.best):
            grow = max(1 << 12, at)
            self.best, self.loss, self.size, self.again = (np.concatenate([x, np.zeros(grow, dtype=x.dtype)]) for x in (self.best, self.loss, self.size, self.again))
        self.best[at], self.loss[at], self.size[at], self.again[at] = best, best - second, len(packed), False
        self.packed.append(packed)
        self.index[part] = at
        self.held += ENTRY + 2 * len(part) + len(packed)
        return at

    def _others(self, part: str, at: int, n: int) -> list[tuple[float, bytes]]:
        """What the part's next best ``n - 1`` paths lose, and their ids."""
        found = self.others.get(at)
        if found is None:
            best, packed = float(self.best[at]), self.packed[at]
            found = [(best - score, ids) for score, ids in ((score, _pack(ids)) for score, ids in self.n_best(part, n)) if ids != packed][: n - 1]
            self.others[at] = found
            self.held += sum(ENTRY + len(ids) for _, ids in found)
        return found

    def release(self) -> None:
        """Forget all parts met so far."""
        self.index: dict[str, int] = {}
        self.packed: list[bytes] = []
        self.others: dict[int, list[tuple[float, bytes]]] = {}
        self.best, self.loss, self.size, self.again = np.zeros(0), np.zeros(0), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
        self.held, self.n = 0, 0

    def _sweep(self) -> None:
        """Forget the parts that no later text had since the last sweep."""
        kept = [(part, i) for part, i in self.index.items() if self.again[i]]
        at = np.array([i for _, i in kept], dtype=np.int64)
        packed = [self.packed[i] for _, i in kept]
        n, best, loss, size = self.n, self.best[at], self.loss[at], self.size[at]
        held = sum(ENTRY + 2 * len(part) + len(x) for (part, _), x in zip(kept, packed, strict=True))
        self.release()
        self.n = n
        if 2 * held <= self.limit:
            self.index, self.packed, self.held = {part: i for i, (part, _) in enumerate(kept)}, packed, held
            self.best, self.loss, self.size, self.again = best, loss, size, np.zeros(len(kept), dtype=bool)

    def encode(self, text: str, n: int = 1) -> list[tuple[float, bytes]]:
        """The ``n`` best encodings ``(score, ids as little-endian u32)`` of a text, best first."""
        if not text:
            return [(0.0, b"")]
        if n != self.n:
            self.release()
            self.n = n
        elif self.held > self.limit:
            self._sweep()
        parts = self.parts.findall(SPACE + text)
        index, old = self.index, len(self.packed)
        at = list(map(index.get, parts))
        if None in at:
            for i, x in enumerate(at):
                if x is None:
                    part = parts[i]
                    at[i] = index[part] if part in index else self._add(part)
        packed = self.packed
        ids = b"".join(map(packed.__getitem__, at))
        where = np.array(at)
        self.again[where[where < old]] = True
        score = float(self.best[where].sum())
        out = [(score, ids)]
        if n > 1:
            # a path beyond the n best changes a part whose change costs more than n - 1 others do
            loss = self.loss[where]
            if len(loss) > n - 1:
                few = np.flatnonzero(loss <= np.partition(loss, n - 2)[n - 2])
                few = few[np.argsort(loss[few], kind="stable")[: n - 1]]
            else:
                few = np.argsort(loss, kind="stable")
            best: list[tuple[float, tuple[tuple[int, bytes], ...]]] = [(0.0, ())]
            for i in few.tolist():
                options = [(cost, ((i, new),)) for cost, new in self._others(parts[i], at[i], n)]
                best = heapq.nsmallest(n, [*best, *((a + cost, change + new) for a, change in best for cost, new in options)], key=lambda x: x[0])
            if len(best) > 1:
                ends = np.cumsum(self.size[where])
                for cost, change in best[1:]:
                    other, done = [], 0
                    for i, new in sorted(change, key=lambda x: x[0]):
                        end = int(ends[i])
                        other += (ids[done : end - len(packed[at[i]])], new)
                        done = end
                    out.append((score - cost, b"".join([*other, ids[done:]])))
        return out

    def decode(self, ids: bytes) -> str:
        content = self.content
        data = b"".join([content[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


_models: dict[str, PieceModel] = {}


def load(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode(df: DataFrame, model: str, text: str = "text", n_best: int = 1, out: str = "ids", cache_bytes: int = CACHE_BYTES, decoded: str | None = None, keep: list[str] | None = None, paths: bool = True) -> DataFrame:
    """``df`` with ``out`` (binary, ids as little-endian u32), ``<out>_score`` and ``<out>_n_best`` (array of score and ids, best first).

    ``keep`` columns stay, all by default.  Without ``paths`` the array holds the scores alone.  ``decoded``
    names a further column: the text that the ids of ``out`` stand for.  A worker keeps the parts it
    has searched, up to ``cache_bytes``, and forgets them with its task.
    """
    ship(df.sparkSession)
    best = T.ArrayType(T.StructType([T.StructField("score", T.DoubleType()), *([T.StructField("ids", T.BinaryType())] if paths else [])]))
    extra = [T.StructField(out, T.BinaryType()), T.StructField(f"{out}_score", T.DoubleType()), T.StructField(f"{out}_n_best", best)]
    extra += [T.StructField(decoded, T.StringType())] if decoded else []
    names = [f.name for f in extra]
    held = [c for c in (df.columns if keep is None else keep) if c not in names]
    source = df.select(*(F.col(f"`{c}`") for c in held), F.col(f"`{text}`").alias("__cairn_text"))
    at = len(held)
    kind = pa.list_(pa.struct([("score", pa.float64()), *([("ids", pa.binary())] if paths else [])]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(model)
        coder.limit = cache_bytes
        try:
            for part in slices(batches, at):
                found = [None if t is None else coder.encode(t, n_best) for t in part.column(at).to_pylist()]
                columns = [pa.array([None if x is None else x[0][1] for x in found], pa.binary())]
                columns.append(pa.array([0.0 if x is None else x[0][0] for x in found], pa.float64()))
                columns.append(pa.array([None if x is None else [{"score": s, "ids": i} if paths else {"score": s} for s, i in x] for x in found], kind))
                if decoded:
                    columns.append(pa.array([None if x is None else coder.decode(x[0][1]) for x in found], pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns[:at], *columns], names=[*held, *names])
        finally:
            coder.release()
            give_back()

    return source.mapInArrow(run, T.StructType([*source.schema[:-1], *extra]))


def decode(df: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text that the ids stand for; null ids give null."""
    ship(df.sparkSession)
    source = df.select(*(F.col(f"`{c}`") for c in df.columns if c != out))
    at = source.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(model)
        for part in slices(batches, at):
            texts = pa.array([None if x is None else coder.decode(x) for x in part.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, out])

    return source.mapInArrow(run, T.StructType([*source.schema, T.StructField(out, T.StringType())]))
