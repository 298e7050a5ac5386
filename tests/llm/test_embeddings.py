import numpy as np

from cairn.llm import embeddings as E
from cairn.llm import queries as Q

SCHEMA = "vec_id long, embedding array<float>, n_links string"


def brute(rows, cosine=0.9):
    """(id, links, component) by all pairs and a plain search."""
    units = []
    for _, v in rows:
        ok = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        x = np.array(v, dtype=np.float32).astype(float) if ok else None
        units.append(x / np.linalg.norm(x) if ok else None)
    near = [[j for j, b in enumerate(units) if j != i and a is not None and b is not None and len(a) == len(b) and a @ b >= cosine] for i, a in enumerate(units)]
    out = []
    for i, (vec_id, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((vec_id, len(near[i]), min(rows[j][0] for j in seen)))
    return sorted(out)


def groups(rng, blocks=12):
    rows = []
    for _ in range(blocks):
        centre = rng.standard_normal(16)
        for _ in range(rng.integers(1, 12)):
            rows.append((centre + rng.standard_normal(16) * 0.08).tolist())
    rows += [rows[0]] * 5 + [[2 * x for x in rows[0]], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, None, [], [1.0, 2.0], [1.0, 2.0]]
    return [(i, v) for i, v in enumerate(rows)]


def test_links_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = groups(rng)
    for block in (1024, 4):  # 4: buckets are checked in pairs of blocks
        monkeypatch.setattr(E, "BLOCK", block)
        monkeypatch.setattr(E, "RECALL", 0.99999)
        df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).coalesce(2)
        got = sorted((r["vec_id"], r["n_links"], r["component"]) for r in E.near_duplicates(df).collect())
        assert got == brute(rows)


def test_recall_of_the_plan():
    """Pairs at the least cosine, the hardest, meet in some table at least nine times in ten."""
    rng = np.random.default_rng(1)
    a = rng.standard_normal((3000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.standard_normal((3000, 64))
    b -= (a * b).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    b = 0.9 * a + np.sqrt(1 - 0.81) * b
    for n in (1_000, 100_000, 100_000_000, 10**12):
        k, tables = E.plan(n, 0.9)
        assert tables <= E.MAX_TABLES
        met = (E.bucket_keys(a, k, tables) == E.bucket_keys(b, k, tables)).any(axis=1)
        assert met.mean() >= 0.9


def test_keys_do_not_depend_on_what_else_is_computed():
    rng = np.random.default_rng(2)
    raw = [x.astype("<f4").tobytes() for x in rng.standard_normal((700, 48))]
    every = E.bucket_keys(E.units(raw, "<f4"), 7, 9)
    for rows in ([3], [699, 2], list(range(0, 700, 13))):
        assert (E.bucket_keys(E.units([raw[i] for i in rows], "<f4"), 7, 4) == every[rows, :4]).all()


def test_registered_query_matches_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    found = Q.op9_embeddings(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in found) == brute(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)


def test_empty_table_and_null_ids(spark):
    assert E.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = E.near_duplicates(spark.createDataFrame([(None, [1.0, 0.0], ""), (7, [1.0, 0.0], ""), (None, None, "")], SCHEMA).coalesce(1)).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component"] or 0, r["kept"]) for r in rows) == [(0, 0, 0, False), (0, 1, 7, False), (7, 1, 7, True)]
