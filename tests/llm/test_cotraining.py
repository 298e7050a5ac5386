import duckdb
import numpy as np

from cairn.llm import cotraining as C

SF = "/root/testdata/sf0.01"


def views(rows):
    return C._view_batches([None if x[0] is None else x[0].encode() for x in rows], *([x[i] for x in rows] for i in (1, 2, 3)))


def plain(x, m, y, fold, px, pm, turns=C.ROUNDS):
    """Co-training with everything in memory; the pool's rows are distinct and in key order."""
    order = np.argsort(fold, kind="stable")
    x, m, y, fold = x[order], m[order], y[order], fold[order]
    pseudo = {}
    for turn in range(turns):
        pairs = C.fit_pairs(x, m, y, fold, {k: ((pm if k[1] else px)[sorted(v)], np.array([v[i] for i in sorted(v)])) for k, v in pseudo.items()})
        for g, (pair, rows) in enumerate(zip(pairs, C.groups(y, fold), strict=True)):
            bad, good = C.wanted(float(y[rows].mean()), turn)
            for view, ((w, b), pool) in enumerate(zip(pair, (px, pm), strict=True)):
                z = np.round((pool @ w).astype(np.float64) + b, 4)
                to = pseudo.setdefault((g, 1 - view), {})
                sure = np.log(C.SURE / (1 - C.SURE))
                to |= {int(i): 0.0 for i in np.argsort(z, kind="stable")[:bad] if z[i] <= -sure}
                to |= {int(i): 1.0 for i in np.argsort(-z, kind="stable")[:good] if z[i] >= sure}
    pairs = C.fit_pairs(x, m, y, fold, {k: ((pm if k[1] else px)[sorted(v)], np.array([v[i] for i in sorted(v)])) for k, v in pseudo.items()})
    return C.calibrated(x, m, y, fold, pairs), pseudo


def test_held_out_accuracy():
    rows = duckdb.sql(f"SELECT text, source, lang, n_chars, quality FROM '{SF}/documents.parquet' JOIN '{SF}/labels.parquet' USING (doc_id) ORDER BY hash(doc_id)").fetchall()
    pool = duckdb.sql(f"SELECT DISTINCT text, source, lang, n_chars FROM '{SF}/documents.parquet' ANTI JOIN '{SF}/labels.parquet' USING (doc_id)").fetchall()
    (x, m), (px, pm) = views(rows), views(pool)
    y = np.array([r[4] for r in rows], dtype=np.float32)
    half = len(y) // 2
    model, _ = plain(x[:half], m[:half], y[:half], np.arange(half) % 2, px, pm)
    text, _, both = model.scores(x[half:], m[half:])
    truth = y[half:] > 0.5
    assert ((both >= C.KEEP_FROM) == truth).mean() >= 0.95 and ((both >= C.KEEP_FROM) & truth).sum() >= 0.99 * truth.sum()
    assert abs(both.mean() - truth.mean()) < 0.1  # calibrated


def test_rounds_use_the_pool():
    """Text decides; metadata alone learns it from pseudo-labels of the pool."""
    rng = np.random.default_rng(0)

    def draw(n, informative):
        y = (rng.random(n) < 0.5).astype(np.float32)
        x = np.zeros((n, C.SIZE + C.DENSE), dtype=np.float32)
        x[:, 0] = np.where(y > 0, 1, -1) * 3 + rng.standard_normal(n) * 0.3
        m = np.zeros((n, C.META), dtype=np.float32)
        m[np.arange(n), np.where(y > 0, 0, 1) if informative else rng.integers(2, 4, n)] = 1
        return x, m, y

    x, m, y = draw(60, False)
    px, pm, _ = draw(800, True)
    tx, tm, ty = draw(200, True)
    model, pseudo = plain(x, m, y, np.arange(60) % 2, px, pm)
    w, b = model.meta
    assert (((tm @ w + b) > 0) == (ty > 0.5)).mean() > 0.95
    assert len(pseudo[0, 1]) > 700


def test_fit_equals_the_plain_version(spark):
    """All unlabelled documents are candidates for pseudo-labels, copies once, whatever the partitions."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    copies = docs.where("doc_id % 50 = 0").withColumn("doc_id", docs["doc_id"] + 10**7)
    docs = docs.union(copies).union(copies).repartition(7)
    model = C.fit(docs, labels)
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    inputs = docs.select(docs["doc_id"].alias("id"), *C._inputs(docs, *C._INPUTS))
    rows = inputs.withColumn("key", C._hash(*C._INPUTS)).withColumn("row", C._hash("id", *C._INPUTS)).collect()
    of = lambda rs: C._view_batches(*([None if r[c] is None else bytes(r[c]) if c == "text" else r[c] for r in rs] for c in C._INPUTS))
    labelled = sorted({r["row"]: r for r in rows if r["id"] in known}.values(), key=lambda r: r["row"])
    pool = sorted({r["key"]: r for r in rows if r["id"] not in known}.values(), key=lambda r: r["key"])
    want, pseudo = plain(*of(labelled), np.array([known[r["id"]] for r in labelled], dtype=np.float32), np.array([r["key"] % 2 for r in labelled]), *of(pool))
    assert sum(map(len, pseudo.values())) > 100
    for got, plainly in ((model.text, want.text), (model.meta, want.meta)):
        assert np.abs(got[0] - plainly[0]).max() < 1e-3 * max(1, np.abs(plainly[0]).max()) and abs(got[1] - plainly[1]) < 1e-2
    x, m = of(pool)
    assert np.abs(model.scores(x, m)[2] - want.scores(x, m)[2]).max() < 0.01


def test_labelled_rows_are_sampled_by_the_whole_row(spark):
    """A third of the rows share an id: some of them are taken, not all or none."""
    rows = [(1 if i % 3 == 0 else i, f"text {i} " * 9, "en", "s", 5) for i in range(1, 901)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    known = docs.select(docs["doc_id"].alias("id")).distinct().selectExpr("id", "double(id % 2) as y")
    inputs = docs.select(docs["doc_id"].alias("id"), *C._inputs(docs, *C._INPUTS))
    found = C._labelled(inputs, known, 300).collect()
    assert 230 < len(found) < 370 and 60 < sum(bytes(r["m"]) is not None and r["y"] == 1.0 for r in found) < 300


def test_operator(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").limit(300), spark.read.parquet(f"{SF}/labels.parquet")
    odd = spark.createDataFrame([(-1, None, None, None, None), (-2, "", None, "x", -5), (-3, "w " * 200_000, "en", "src0", 9), (-3, "w " * 200_000, "en", "src0", 9)], docs.schema)
    docs = docs.union(odd).withColumn("quality", docs["lang"])
    model = C.fit(docs, labels)
    rows = C.score(docs, model, keep=["doc_id"]).collect()
    assert len(rows) == 304 and all(0 <= r["quality"] <= 1 for r in rows)
    assert len({r["quality"] for r in rows if r["doc_id"] == -3}) == 1
    kept = C.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["quality_kept"] for r in rows)
    assert {r["quality"] for r in C.score(docs, C.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert {r["quality"] for r in C.score(docs, C.fit(docs, labels.where("quality = 1"))).collect()} == {1.0}
    assert C.score(docs.limit(0), C.fit(docs.limit(0), labels)).collect() == []
