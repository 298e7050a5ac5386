import random

import numpy as np
import pytest
import xxhash

from cairn.llm import simhash as S


def plain_fingerprint(text, shingle=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in words.translate({i: " " for i in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, distance):
    """Least id reachable by links of at most ``distance`` bits, by plain search."""
    out = {}
    for i, p in prints:
        seen, todo = {(i, p)}, [(i, p)]
        while todo:
            _, q = todo.pop()
            for x in prints:
                if x not in seen and (q ^ x[1]).bit_count() <= distance:
                    seen.add(x)
                    todo.append(x)
        out[i] = min(j for j, _ in seen)
    return out


def test_fingerprints_match_the_definition():
    rng = random.Random(0)
    texts = ["", " \t\n", "one", "one Two", "Ä b\x1fc  D\x85e\xa0f", "a b c d e"] + [" ".join(rng.choice(["The", "cat", "sät", "ON", "mat"]) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    for t in [*texts, None]:
        assert S.fingerprint(None if t is None else t.encode()) == plain_fingerprint(t)


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
def test_links_connect_what_brute_force_connects(spark, distance):
    rng = random.Random(distance)
    prints = set()
    for _ in range(25):
        p = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            prints.add(p)
            for _ in range(rng.randint(1, 3)):
                p ^= 1 << rng.randrange(64)
    signed = {p - (1 << 64) if p >> 63 else p for p in prints}
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = [(r["a"], r["b"]) for r in S.links(nodes, distance).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= distance for a, b in found)
    want = components([(p, p & (1 << 64) - 1) for p in signed], distance)
    root = {p: p for p in signed}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    assert {p: top(p) for p in signed} == want


@pytest.mark.parametrize("distance", [2, 3, 4])
def test_dense_table_entries(spark, monkeypatch, distance):
    """Many fingerprints share a segment: entries are divided, and no link is lost or false."""
    monkeypatch.setattr(S, "FEW", 4)
    rng = random.Random(distance)
    prints = set()
    for _ in range(3):
        high = rng.getrandbits(32) << 32
        for _ in range(25):
            p = high | rng.getrandbits(32)
            for _ in range(3):
                prints.add(p)
                for _ in range(rng.randint(1, 3)):
                    p ^= 1 << rng.choice([rng.randrange(32), rng.randrange(64)])
    prints |= {1 << i for i in range(64)} | {0}
    signed = {p - (1 << 64) if p >> 63 else p for p in prints}
    found = [(r["a"], r["b"]) for r in S.links(spark.createDataFrame([(p,) for p in signed], "fp long"), distance).collect()]
    assert all(a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= distance for a, b in found)
    root = {p: p for p in signed}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    assert {p: top(p) for p in signed} == components([(p, p & (1 << 64) - 1) for p in signed], distance)


@pytest.mark.parametrize("keep", [S.keep_one, S.keep_one_similar])
def test_one_row_of_each_group_stays_however_rows_move(spark, keep):
    """The input is no stored table: rows arrive in another order at each evaluation."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    more = docs.union(docs.selectExpr("doc_id + 1000000", "text", "lang", "source", "n_chars"))
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4k")
    try:
        moved = keep(more.dropDuplicates(["doc_id"]), shingle=5)
        kept = [r["text"] for r in moved.select("text").collect()]
        want = [r["text"] for r in keep(docs.coalesce(1), shingle=5).select("text").collect()]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert len(kept) == len(want) > 50


def test_operator_on_odd_rows(spark):
    rows = [(4, "a b c d", "x"), (2, "A B C D", "y"), (9, None, None), (8, "", "z"), (7, "something else entirely here", ""), (7, "something else entirely here", ""), (None, "a b c d", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    found = {(r["doc_id"], r["component"]) for r in S.near_duplicates(df).collect()}
    assert found == {(4, 2), (2, 2), (None, 2), (9, 8), (8, 8), (7, 7)}
    assert S.near_duplicates(df.limit(0)).collect() == []
    kept = S.keep_one(df.coalesce(1), shingle=5).collect()
    assert [r["doc_id"] for r in sorted(kept, key=lambda r: r["doc_id"])] == [4, 7, 9] and kept[0].asDict().keys() == {"doc_id", "text", "fp"}


def test_components_of_long_chains(spark):
    from cairn.llm.shared import components as cc

    edges = [(i, i + 1) for i in range(0, 300)] + [(1000 + i, 1001 + i) for i in range(0, 40, 2)] + [(5, 5)] + [(2000, 2000 + i) for i in range(1, 200)]
    got = {r["node"]: r["root"] for r in cc(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[1000 + i] == 1000 + i // 2 * 2 for i in range(40)) and all(got[2000 + i] == 2000 for i in range(200))


def shingle_set(text, n=5):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def jaccard(x, y):
    return len(x & y) / len(x | y) if x | y else 1.0


def similar_groups(texts, least=0.8):
    """Rows kept by plain search over all pairs, and the number of linked pairs of different sets."""
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    links = 0
    for i in range(len(sets)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= least:
                links += sets[i] != sets[j]
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i for i in range(len(texts)) if top(i) == i}, links


def test_keep_one_similar_finds_every_pair_of_the_least_similarity(spark):
    rng = random.Random(5)
    word = lambda: "w%d" % rng.randint(0, 5000)
    passage = [word() for _ in range(90)]  # stands in many texts that are not similar enough
    texts = [None, "", "One two", "one TWO", "one two three"]
    for i in range(60):
        base = [*passage, *(word() for _ in range(40))] if i % 3 == 0 else [word() for _ in range(rng.randint(30, 200))]
        texts.append(" ".join(base))
        for changes in rng.sample(range(1, 8), 2):
            copy = list(base)
            for at in rng.sample(range(len(copy)), changes):
                copy[at] = word()
            texts.append(" ".join(copy))
    want, links = similar_groups(texts)
    assert links > 30 and len(want) > 60
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert {r["doc_id"] for r in S.keep_one_similar(df).collect()} == want
    assert S.keep_one_similar(df.limit(0)).collect() == []


def test_large_keys_lose_no_link_between_components(spark, monkeypatch):
    """Families around one passage meet in the same keys, far more sets than are compared at first."""
    rng = random.Random(8)
    word = lambda: "w%d" % rng.randint(0, 10**6)
    passage = [word() for _ in range(150)]
    texts = []
    for _ in range(30):  # families of similarity 0.7 or so to each other, chains of near copies inside
        text = [*passage, *(word() for _ in range(45))]
        for _ in range(4):
            texts.append(" ".join(text))
            for _ in range(2):
                text[rng.randrange(len(text))] = word()
    rng.shuffle(texts)
    want, links = similar_groups(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for block in (512, 16):
        monkeypatch.setattr(S, "BLOCK", block)
        assert {r["doc_id"] for r in S.keep_one_similar(df).collect()} == want
    assert links > 60 and len(want) >= 20


def test_joining_links_match_all_pairs():
    rng = np.random.default_rng(3)
    for turn in range(30):
        base = rng.integers(0, 1 << 60, 60).astype(np.uint64)
        sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(30, 60), replace=False), rng.integers(0, 1 << 60, rng.integers(0, 12)).astype(np.uint64)])) for _ in range(25)]
        component = [int(x) for x in rng.integers(0, 12, 25)]
        side = [i % 2 for i in range(25)] if turn % 2 else [0] * 25
        jac = lambda x, y: len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        root = {c: c for c in component}

        def top(c, root=root):
            while root[c] != c:
                c = root[c]
            return c

        for i in range(25):
            for j in range(i):
                if (not turn % 2 or side[i] != side[j]) and jac(sets[i], sets[j]) >= 0.6:
                    root[top(component[i])] = top(component[j])
        want = [[top(component[i]) == top(component[j]) for j in range(25)] for i in range(25)]
        for c in root:
            root[c] = c
        for i, j in S.joining_links(sets, component, side, 0.6):
            assert jac(sets[i], sets[j]) >= 0.6 and top(component[i]) != top(component[j])
            root[top(component[i])] = top(component[j])
        assert [[top(component[i]) == top(component[j]) for j in range(25)] for i in range(25)] == want


def test_distances_beyond_the_balls_are_refused():
    for distance in (-1, 5, 6):
        with pytest.raises(ValueError):
            S.links(None, distance)


def test_only_the_rows_asked_for_are_shuffled(spark, monkeypatch):
    """The filter leaves out nearly all other rows; a full one leaves out none, with the same rows kept."""
    rows = spark.range(20_000).withColumnRenamed("id", "row")
    some = spark.range(0, 20_000, 100).withColumnRenamed("id", "row")
    found = {r["row"] for r in S._hinted(rows, "row", some).where("__cairn_in").collect()}
    assert {r["row"] for r in some.collect()} <= found and len(found) < 300
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").coalesce(1)
    kept = sorted(map(repr, S.keep_one_similar(docs).collect()))
    monkeypatch.setattr(S, "FILTER_WORDS", 1)
    assert 0 < len(kept) < docs.count() and sorted(map(repr, S.keep_one_similar(docs).collect())) == kept
    assert sorted(map(repr, S.keep_one_similar(docs.union(docs).union(docs).coalesce(1)).collect())) == kept  # most rows go


def plain_long_fingerprint(hashes, words):
    x = hashes[:, None] * S._factors[words]
    x ^= x >> np.uint64(32)
    x *= S._MIX
    x ^= x >> np.uint64(29)
    ones = np.unpackbits(x.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def test_multi_index_hashing_finds_the_similar_sets(spark):
    """Long fingerprints are those of the definition, and their tables find 400 random pairs at exactly 0.8 and no list of all pairs."""
    rng = np.random.default_rng(9)
    top, low, tables = S.plan(1000, 0.8)
    words = S.plan_words(top, low, tables)
    rows, want = [], set()
    for i in range(400):
        union = rng.permutation(rng.integers(0, 1 << 63, 45 * int(rng.integers(1, 8))).astype(np.uint64))
        cut = len(union) // 10  # of each set the union has a tenth more, and the other set has not
        for k, x in ((0, np.delete(union, slice(0, cut))), (1, np.delete(union, slice(len(union) - cut, None)))):
            print_ = S.long_fingerprint(x, words)
            assert i > 20 or (print_ == plain_long_fingerprint(x, words)).all()
            rows.append((2 * i + k, bytearray(print_.tobytes() + len(x).to_bytes(8, "little"))))
        want.add((2 * i, 2 * i + 1))
    nodes = spark.createDataFrame(rows, "node long, fp binary")
    met = S.met_in_tables(nodes, 0.8, top, low, tables).where("key IS NULL").select("a", "b").distinct()
    found = {(r["a"], r["b"]) for r in met.collect()}
    assert want <= found and len(found) < 20_000
    assert {(r["a"], r["b"]) for r in S._alike(met, nodes, 0.8).collect()} == want


def test_plan_grows_slowly_with_the_rows():
    plans = [S.plan(10**k, 0.8) for k in range(10)]
    assert all(a <= b for a, b in zip(plans, plans[1:], strict=False)) and plans[5] == (0, 28, 54)
    assert S.plan(10**5, 0.5)[2] > 54


def test_large_groups_of_near_copies_make_no_list_of_pairs(spark):
    """Of 400 near copies what meets is written once a table and set, as groups, and connects all of them."""
    rng = np.random.default_rng(11)
    top, low, tables = S.plan(1000, 0.8)
    words = S.plan_words(top, low, tables)
    base = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(300) > 0.02], rng.integers(0, 1 << 63, 6).astype(np.uint64)])) for _ in range(400)]
    rows = [(i, bytearray(S.long_fingerprint(x, words).tobytes() + len(x).to_bytes(8, "little"))) for i, x in enumerate(sets)]
    met = S.met_in_tables(spark.createDataFrame(rows, "node long, fp binary"), 0.8, top, low, tables).collect()
    assert len(met) < 2 * tables * len(sets)
    root = list(range(len(sets)))
    for r in met:
        a, b = r["a"], r["b"]
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)
    assert sum(root[i] == i for i in range(len(sets))) == 1


def test_blocks_of_one_component_do_not_meet(spark, monkeypatch):
    """Every pair of nodes of different components meets in one place, and the copies of a large component are sent as often as other blocks ask."""
    monkeypatch.setattr(S, "BLOCK", 16)
    component = {i: 0 if i < 400 else 1 if i < 430 else i for i in range(450)}
    rows = [(7, i, c) for i, c in component.items()] + [(8, 1000 + i, 1000) for i in range(100)]
    dealt = S._dealt(spark.createDataFrame(rows, "key long, node long, component long")).collect()
    places = {}
    for r in dealt:
        assert r["key"] == 7 and r["component"] == component[r["node"]]
        places.setdefault((r["i"], r["j"]), []).append((r["node"], r["block"]))
    met = [frozenset((x, y)) for p in places.values() for k, (x, a) in enumerate(p) for y, b in p[:k] if component[x] != component[y] and (a != b or len({c for _, c in p}) == 1)]
    want = {frozenset((x, y)) for x in component for y in range(x) if component[x] != component[y]}
    assert set(met) == want and len(met) == len(want)
    assert len(dealt) < 450 * 6 + 50 * 30


def test_forest_connects_what_near_fingerprints_connect():
    rng = np.random.default_rng(2)
    for turn in range(10):
        prints = rng.integers(0, 1 << 62, (6, 24)).astype(np.uint64)[rng.integers(0, 6, 60)]
        for _ in range(4):  # few bits apart, or by chains
            prints[np.arange(60), rng.integers(0, 24, 60)] ^= rng.integers(0, 1 << 62, 60).astype(np.uint64)
        sizes = rng.integers(80, 110, 60).astype(np.uint64)
        side = ["x" if turn % 2 and k % 2 else "y" for k in range(60)]
        far = S.farthest(64 * 24, S._differ(0.8) + 0.006)
        away = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2)
        near = (away <= far) & (np.minimum(sizes[:, None], sizes) >= 0.8 * np.maximum(sizes[:, None], sizes) - 1e-9) & ~np.eye(60, dtype=bool)
        if turn % 2:
            near &= np.array(side)[:, None] != np.array(side)
        found = S.near_forest(np.column_stack([prints, sizes]), side, 0.8)
        assert all(near[i, j] and away[i, j] == d for i, j, d in found) and len(found) < 120

        def reach(edges):
            seen = np.eye(60, dtype=bool) | edges | edges.T
            for _ in range(7):
                seen = (seen.astype(int) @ seen.astype(int)) > 0
            return seen

        edges = np.zeros((60, 60), dtype=bool)
        for i, j, _ in found:
            edges[i, j] = True
        assert (reach(edges) == reach(near)).all()
        best = {i: min(d for k, _, d in found if k == i) for i in np.flatnonzero(near.any(axis=1)).tolist()}
        assert all(d == away[i][near[i]].min() for i, d in best.items())
