"""Main text of web pages: markup names regions, host suffix arrays tell repeated runs from unique ones.

A page is read once into blocks.  Blocks inside an article or main landmark are protected; blocks
inside menus, headers, footers, sidebars, notices, adverts, forms, comments and the like are marked;
the others are open.  The token streams of a host's pages, all blocks of them with a mark at each
block's edges, are concatenated and a suffix array brings equal runs together.  ``MIN_RUN`` tokens
that stand on ``SHARE`` of the host's pages, and on ``LEAST_PAGES`` at least, are a repeated run.

Removed are marked blocks; of open blocks the tokens that repeated runs cover; and of protected blocks
those that runs on over ``PROTECTED_SHARE`` of the pages cover wholly, unless that is half of the
page's protected text or more: then the article itself is what repeats.  Other runs stay, such as an
article that was published twice or a phrase that some pages have in common.  What is left of open
blocks belongs to the text if it is longer than the protected text; otherwise the landmark decides.

A host of over ``HOST_PAGES`` pages or ``HOST_CHARS`` characters is dealt into parts of about that size by
a hash of the page, and a page that stands there more often by its occurrence too; each part has a
suffix array of its own.  How many pages have a run is then added up over the host's parts, so a
text depends on the whole host and not on how it was dealt: a run on ``need`` of the host's pages stands on
that share of a part's pages at least once.  So each part names the runs on half of that share,
runs that can't come to ``need`` with what the other parts may have are left out, and the others, which are few
(a host has at most ``2 / SHARE`` of them for each token of a middling page), are counted in every part.
Parts know a run by 64 bits of hash.  Neither a large host nor many copies of a page make a large
group.  Pages are shuffled once, as blocks of text, and that shuffle is read again.

Defined results.  Null or empty html: empty text.  Null url: host "".  Repeated rows are distinct
pages.  Very long pages are read whole.  Empty table: empty result.  Unclosed and stray tags are read
as browsers mostly do: an end tag closes up to its nearest open element, or nothing; of an
unclosed script or the like only the text up to the next tag goes.  Other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.shared import materialize, ship, slices
from cairn.llm.substrings import neighbours_lcp, suffix_array

MIN_RUN = 6
HOST_PAGES, HOST_CHARS = 256, 16 << 20
SHARE, LEAST_PAGES = 0.05, 3
PROTECTED_SHARE, PROTECTED_PAGES = 0.5, 5

#: Element names by their role.
RAW = frozenset("script style noscript template iframe object svg math canvas audio video textarea select title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER = frozenset("nav footer aside form button menu dialog fieldset label datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img".split())
LANDMARKS = frozenset(("article", "main"))
#: Words of class, id and role attributes that mark boilerplate.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead "
    "topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login register share sharing social comment comments disqus "
    "reply replies respond related recommended widget pagination pager search complementary contentinfo navigation".split()
)
#: Words that say where or in what form such a region stands; a name of several words is a mark if all are marks or these.
SHAPES = frozenset(
    "area bar block body bottom box btn button buttons col column container content count entry feed fixed float footer form group head header icons inner item items label left line link links list "
    "main mobile outer page panel post posts primary right row secondary section site slot sticky strip tab text title toggle top unit wrap wrapper".split()
)
_token = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>|[^<]+|<""", re.DOTALL)
_tag = re.compile(r"</?[A-Za-z]")
_attribute = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_hidden = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE)
_word = re.compile(r"[a-z]+|[A-Z][a-z]*")
#: A factor of each place in a run's key.
_FACTORS = [np.uint64(xxhash.xxh64_intdigest(bytes([i]), 5) | 1) for i in range(MIN_RUN)]
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_host = re.compile(HOST)

PROTECTED, OPEN, MARKED = 2, 1, 0


def is_mark(name: str) -> bool:
    """Whether a class, id or role name marks boilerplate: its words are marks, or marks and shapes."""
    words = [w.lower() for w in _word.findall(name)]
    return not MARKS.isdisjoint(words) and all(w in MARKS or w in SHAPES for w in words)


def _is_marked(name: str, attributes: str, protected: bool) -> bool:
    if name in BOILER or name == "header" and not protected:
        return True
    if not attributes or name in ("body", "html"):
        return False
    if name != "main":
        for m in _attribute.finditer(attributes):
            if any(map(is_mark, (m[1] or m[2] or m[3] or "").split())):
                return True
    return bool(_hidden.search(attributes))


def blocks(page: str | None) -> list[tuple[int, list[str]]]:
    """``(kind, words)`` of the page's blocks in order; kind PROTECTED, OPEN or MARKED.  White space divides words."""
    if not page:
        return []
    out: list[tuple[int, list[str]]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements and the kind of what is inside
    kind = OPEN
    unclosed: set[str] = set()  # raw elements without an end from here on

    def end_block() -> None:
        if parts:
            words = "".join(parts).split()
            if words:
                out.append((kind, words))
            parts.clear()

    at, size = 0, len(page)
    match = _token.match
    while at < size:
        m = match(page, at)
        at = m.end()
        name = m[2]
        if name is None:
            text = m[0]
            if text[0] != "<" or text == "<":
                parts.append(html.unescape(text) if "&" in text else text)
            continue
        name = name.lower()
        if m[1]:
            if name not in INLINE:
                end_block()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if stack[i][1] != kind or (i and stack[i - 1][1] != kind):
                        end_block()
                    del stack[i:]
                    kind = stack[-1][1] if stack else OPEN
                    break
            continue
        if name not in INLINE:
            end_block()
        if name in RAW and not m[3].endswith("/"):
            end = None if name in unclosed else re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(page, at)
            if end is None:
                unclosed.add(name)
                end = _tag.search(page, at)
                at = end.start() if end else size
            else:
                at = end.end()
            continue
        if name in VOID or m[3].endswith("/"):
            continue
        inside = kind
        if kind != MARKED:
            if name == "head" or _is_marked(name, m[3], kind == PROTECTED):
                inside = MARKED
            elif name in LANDMARKS or "main" in m[3] and re.search(r"""role\s*=\s*["']?main""", m[3]):
                inside = PROTECTED
        if inside != kind:
            end_block()
        stack.append((name, inside))
        kind = inside
    end_block()
    return out


def host(url: str | None) -> str:
    m = _host.match(url or "")
    return m[1].lower() if m else ""


def need(pages: int) -> int:
    """On how many of a host's pages a run is repeated."""
    return max(LEAST_PAGES, -int(-pages * SHARE // 1))


def run_pages(streams: list[np.ndarray]) -> list[np.ndarray]:
    """Per page and token, how many pages have the run of MIN_RUN tokens that begins there (0: none does): one suffix array of all pages.

    Streams are positive numbers.  No run goes over the end of a page.
    """
    sizes = [len(s) for s in streams]
    joined = np.concatenate([np.append(s, 0) for s in streams])
    page = np.repeat(np.arange(len(streams)), np.array(sizes) + 1)
    apart = np.flatnonzero(joined == 0)
    joined[apart] = joined.max() + 1 + np.arange(len(apart))
    order, ranks = suffix_array(joined, MIN_RUN)
    lcp = neighbours_lcp(order, ranks)
    group = np.cumsum(lcp < MIN_RUN) - 1
    pairs = np.unique(group.astype(np.int64) * len(streams) + page[order])  # a page counts once
    count = np.bincount(pairs // len(streams))
    found = np.zeros(len(joined), dtype=np.int64)
    found[order] = count[group]
    ends = apart[page]  # a run needs MIN_RUN tokens before its page's end
    found[np.arange(len(joined)) + MIN_RUN > ends] = 0
    bounds = np.concatenate([[0], np.cumsum(np.array(sizes) + 1)])
    return [found[bounds[i] : bounds[i + 1] - 1] for i in range(len(streams))]


def cover(begins: np.ndarray) -> np.ndarray:
    """Which tokens lie in runs of MIN_RUN tokens that begin where ``begins`` is true."""
    at = np.flatnonzero(begins)
    size = len(begins)
    edges = np.bincount(at, minlength=size + MIN_RUN) - np.bincount(at + MIN_RUN, minlength=size + MIN_RUN)
    return np.cumsum(edges)[:size] > 0


def main_text(page: list[tuple[int, list[str]]], runs: np.ndarray, pages: int) -> tuple[str, int]:
    """The page's text, and how many tokens beside it lie in repeated runs, in marked blocks too."""
    some, most = cover(runs >= need(pages)), cover(runs >= max(PROTECTED_PAGES, int(pages * PROTECTED_SHARE) + 1))
    kept: list[tuple[int, list[str], bool]] = []
    at = repeated = removed = 0
    for kind, words in page:
        at += 1  # the edge
        end = at + len(words)
        if kind == PROTECTED:
            whole = bool(most[at:end].all())
            repeated += len(words) if whole else 0
            kept.append((kind, words, whole))
        elif kind == OPEN:
            left = [w for w, gone in zip(words, some[at:end].tolist(), strict=True) if not gone]
            removed += len(words) - len(left)
            kept.append((kind, left, False))
        else:
            removed += int(some[at:end].sum())
        at = end
    size = {k: sum(len(w) for kind, w, _ in kept if kind == k) for k in (PROTECTED, OPEN)}
    if 2 * repeated < size[PROTECTED]:
        kept = [x for x in kept if not x[2]]
        removed += repeated
    if size[PROTECTED] and size[PROTECTED] >= size[OPEN]:
        kept = [x for x in kept if x[0] == PROTECTED]
    return " ".join([" ".join(words) for _, words, _ in kept if words]), removed


def joined(page: list[tuple[int, list[str]]]) -> str:
    """The words of a page's blocks as one text, with a line feed as a word at each block's edges."""
    return " ".join(["\n", *(x for _, words in page for x in (" ".join(words), "\n"))])


def token_streams(texts: pa.Array) -> tuple[list[np.ndarray], list[str]]:
    """The pages, given as joined texts, as streams of their tokens' numbers, and the tokens from number 1."""
    lists = pc.split_pattern(texts, " ")
    tokens, cuts = lists.flatten().dictionary_encode(), lists.offsets.to_numpy()
    return np.split(tokens.indices.to_numpy().astype(np.int64) + 1, cuts[1:-1]), tokens.dictionary.to_pylist()


def solve(group: list[list[tuple[int, list[str]]]]) -> list[tuple[str, int]]:
    """The texts of a host's pages, given as blocks."""
    streams, _ = token_streams(pa.array(list(map(joined, group)), pa.string()))
    runs = run_pages(streams) if len(group) >= LEAST_PAGES else [np.zeros(len(x), dtype=np.int64) for x in streams]
    return [main_text(page, r, len(group)) for page, r in zip(group, runs, strict=True)]


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word, 3)


def run_keys(streams: list[np.ndarray], words: list[str]) -> list[np.ndarray]:
    """Per page the keys of the runs that begin at its tokens, as far as there are MIN_RUN: the same on every part."""
    table = np.array([0, *map(_hash, words)], dtype=np.uint64)
    out = []
    for stream in streams:
        tokens, n = table[stream], max(0, len(stream) - MIN_RUN + 1)
        keys = np.zeros(n, dtype=np.uint64)
        for k, factor in enumerate(_FACTORS):
            keys += tokens[k : k + n] * factor
        out.append(keys.view(np.int64))
    return out


def part_runs(texts: pa.Array, pages: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and page counts of the runs that have, in this part of a host of ``pages`` pages, half of the share at least."""
    streams, words = token_streams(texts)
    keys, counts = [], []
    for key, r in zip(run_keys(streams, words), run_pages(streams), strict=True):
        often = 2 * pages * r[: len(key)] >= need(pages) * len(texts)
        keys.append(key[often])
        counts.append(r[: len(key)][often])
    found, at = np.unique(np.concatenate(keys), return_index=True)
    return found, np.concatenate(counts)[at]


def known_runs(own: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per token of a page with the keys ``own``, the count of the run that begins there (0: not among the sorted ``keys``)."""
    out = np.zeros(len(own) + MIN_RUN - 1, dtype=np.int64)
    if len(own) and len(keys):
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        out[: len(own)] = np.where(keys[at] == own, counts[at], 0)
    return out


def _parsed(pages: DataFrame, kind: str) -> DataFrame:
    """``id, url, host, salt, kinds, blocks``: the pages, read once; ``blocks`` is their :func:`joined` text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, int] = {}  # copies of a page go to different parts
        for part in slices(batches, 2):
            hosts, salts, kinds, texts = [], [], [], []
            for url, page in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                found = blocks(page)
                same = xxhash.xxh64_intdigest(page or "", 1)
                met[same] = met.get(same, -1) + 1
                hosts.append(host(url))
                salts.append(xxhash.xxh64_intdigest(b"%d %d" % (same, met[same])) >> 1)
                kinds.append(bytes(k for k, _ in found))
                texts.append(joined(found))
            columns = [pa.array(hosts, pa.string()), pa.array(salts, pa.int64()), pa.array(kinds, pa.binary()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=["id", "url", "host", "salt", "kinds", "blocks"])

    return pages.mapInArrow(run, f"id {kind}, url string, host string, salt long, kinds binary, blocks string")


def host_column(url: Column) -> Column:
    """:func:`host` inside the JVM."""
    return F.coalesce(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def _page(kinds: bytes, text: str) -> list[tuple[int, list[str]]]:
    return list(zip(kinds, (b.split(" ") for b in text[2:-2].split(" \n ")), strict=True)) if kinds else []


def _groups(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.Table]:
    """The sorted rows by host and part: hosts of one part, or else the parts of the others."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        one = pc.equal(batch.column("parts"), 1)
        batch = batch.filter(one if whole else pc.invert(one))
        keys = list(zip(batch.column("host").to_pylist(), batch.column("part").to_pylist(), strict=True))
        start = 0
        for i, key in enumerate(keys):
            if key != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, key
        if len(keys) > start:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _listed(runs: DataFrame, large: DataFrame, dealt: DataFrame) -> DataFrame:
    """``dealt`` with the arrays ``runs`` of its host's ``host, run, n``; each part gets them, so that ``dealt`` need not move."""
    lists = runs.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("run", "n"))).alias("runs")).join(large, "host")
    lists = lists.select("host", "runs", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    return dealt.join(lists.hint("merge"), ["host", "part"], "left").select(*dealt.columns, F.col("runs.run").alias("run"), F.col("runs.n").alias("n"))


def _by_page(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Per batch the rows of hosts of several parts, their keys and the counts of known runs."""
    for batch in batches:
        batch = batch.filter(pc.greater(batch.column("parts"), 1))
        lists = [batch.column(c) for c in ("run", "n")]
        rows = batch.drop_columns(["run", "n"]).to_pylist()
        out, last = [], None
        for i, own in enumerate(run_keys(*token_streams(batch.column("blocks"))) if rows else []):
            if last != rows[i]["host"]:  # all parts of a host have the same lists
                last = rows[i]["host"]
                keys, counts = (np.array(x[i].values, dtype=np.int64) if x[i].is_valid else np.zeros(0, dtype=np.int64) for x in lists)
            out.append((rows[i], own, known_runs(own, keys, counts)))
        if out:
            yield out


def extract(df: DataFrame, id_col: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Per page: id, url, ``text``, ``n_chars`` and ``n_repeated`` (tokens that are not in the text and lie in repeated runs)."""
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(id_col).alias("id"), F.col(url).alias("url"), F.col(page).alias("html"))
    kind = rows.schema["id"].dataType.simpleString()
    size = F.greatest(F.ceil(F.count("*") / F.lit(HOST_PAGES)), F.ceil(F.sum(F.char_length("html")) / F.lit(HOST_CHARS)))
    large = rows.groupBy(host_column(F.col("url")).alias("host")).agg(size.cast("long").alias("parts"), F.count("*").alias("pages")).where("parts > 1")
    large = materialize(large, "html-hosts", narrow=True)
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    placed = _parsed(rows, kind).join(large, "host", "left").withColumn("part", F.pmod("salt", parts))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.select("host", "part", "id", "url", "kinds", "blocks", parts.alias("parts"), "pages").repartition(n, "host", "part")
    # nothing is pushed below the shuffle: filters are in Python and joins are outer, so that all that follows reads the same one
    ordered = dealt.sortWithinPartitions("host", "part")
    schema = f"id {kind}, url string, text string, n_repeated long"

    def batch_of(rows: list[dict], found: list[tuple[str, int]], id_type: pa.DataType) -> pa.RecordBatch:
        ids, urls = pa.array([r["id"] for r in rows], id_type), pa.array([r["url"] for r in rows], pa.string())
        return pa.RecordBatch.from_arrays([ids, urls, pa.array([t for t, _ in found], pa.string()), pa.array([x for _, x in found], pa.int64())], names=["id", "url", "text", "n_repeated"])

    def typed(batches: Iterator[pa.RecordBatch], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types[:] = [batch.schema.field("id").type]
            yield batch

    def whole_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list[pa.DataType] = []
        for group in _groups(typed(batches, types), True):
            held = group.to_pylist()
            yield batch_of(held, solve([_page(r["kinds"], r["blocks"]) for r in held]), types[0])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, False):
            host, pages = group["host"][0].as_py(), group["pages"][0].as_py()
            keys, counts = part_runs(group["blocks"].combine_chunks(), pages)
            columns = [pa.array([host] * len(keys), pa.string()), pa.array(keys), pa.array(counts), pa.array(np.full(len(keys), len(group), dtype=np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "run", "n", "seen"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _by_page(batches):
            hosts: dict[str, list[np.ndarray]] = {}
            for r, own, runs in part:
                hosts.setdefault(r["host"], []).append(np.unique(own[runs[: len(own)] > 0]))
            for h, found in hosts.items():
                keys, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([h] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], names=["host", "run", "n"])

    def dealt_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list[pa.DataType] = []
        for part in _by_page(typed(batches, types)):
            yield batch_of([x[0] for x in part], [main_text(_page(r["kinds"], r["blocks"]), runs, r["pages"]) for r, _, runs in part], types[0])

    out = ordered.mapInArrow(whole_texts, schema)
    if not large.isEmpty():
        least = F.greatest(F.lit(LEAST_PAGES), F.ceil(F.col("pages") * F.lit(SHARE)))  # as need()
        runs = ordered.mapInArrow(named, "host string, run long, n long, seen long").groupBy("host", "run").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))
        # a part that did not name a run has it on less than half of the share of its pages
        runs = runs.join(large, "host").where(2 * F.col("pages") * F.col("n") + least * (F.col("pages") - F.col("seen")) >= 2 * F.col("pages") * least).select("host", "run", "n")
        runs = _listed(runs, large, dealt).mapInArrow(counted, "host string, run long, n long").groupBy("host", "run").agg(F.sum("n").alias("n"))
        runs = runs.join(large, "host").where(F.col("n") >= least).select("host", "run", "n")
        out = out.union(_listed(runs, large, dealt).mapInArrow(dealt_texts, schema))
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url), "text", F.char_length("text").cast("long").alias("n_chars"), "n_repeated")
