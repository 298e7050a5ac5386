"""The pipeline's stages against brute-force versions on a small corpus."""

import collections
import random
import re

import corpus_pipeline as C
import numpy as np
import pytest
import test_cotraining
from test_simhash import components, plain_fingerprint

from cairn.llm import cotraining, pieces

SF = "/root/testdata/sf0.001"


def small(spark):
    rng = random.Random(0)
    words = ["the", "ound", "edat", "hath", "ser", "mon", "tiv", "lor", "pen", "qua"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 40)) for _ in range(n))
    rows = [(i, text(rng.randint(1, 80)), "en", f"src{i % 4}", 0) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "src0", 0) for i in range(10)] + [(5, *rows[5][1:])] * 2
    rows += [(200, None, None, None, None), (201, "", "en", "src1", 0), (202, "password=hunter2hunter2 " + text(60), "en", "src2", 0), (None, text(70), "en", "src3", 7)]
    rows = [(*r[:4], None if r[1] is None else len(r[1])) for r in rows]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)


def test_near_duplicates_keep_one_of_each_group(spark):
    rows, docs = small(spark)
    kept = [tuple(r) for r in C.near_duplicates(spark, docs, SF).collect()]
    prints = [(i, plain_fingerprint(r[1], 5)) for i, r in enumerate(rows)]
    least = components(prints, 2)
    assert sorted(map(repr, kept)) == sorted(repr(rows[i]) for i in {*least.values()})


def test_near_duplicates_find_copies_at_similarity_0_8(spark):
    rng = random.Random(3)
    words = [f"w{rng.randint(0, 9999)}" for _ in range(204)]
    near, far = list(words), list(words)
    for at in (20, 60, 100, 140):  # 180 of 220 shingles
        near[at] = "new"
    for at in (20, 60, 100, 140, 180):  # 175 of 225
        far[at] = "other"
    rows = [(i, " ".join(t), "en", "src0", 0) for i, t in enumerate((words, near, far))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    assert [r["doc_id"] for r in C.near_duplicates(spark, docs, SF).collect()] == [0, 2]


def test_secrets_and_mixing(spark):
    rows, docs = small(spark)
    clean = C.without_secrets(spark, docs, SF)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    assert not [r for r in clean.collect() if "hunter2" in (r["text"] or "")]
    assert all(r["n_chars"] == len(r["text"]) for r in clean.where("text is not null").collect())
    mixed = C.mixed(spark, docs, SF)
    count = collections.Counter(tuple(r) for r in mixed.collect())
    have = collections.Counter(rows)
    assert mixed.columns == docs.columns and set(count) <= set(have) and all(n <= 2 * have[r] for r, n in count.items())


@pytest.mark.parametrize("name", [n for n, _ in C.STAGES])
def test_every_stage_takes_odd_rows_and_clashing_columns(spark, name):
    """Nulls, empty and very long texts, ties and repeated rows; further columns named like the operators' own."""
    long = " ".join(f"w{i % 1009}" for i in range(150_000))
    rows = [(1, None, None, None, None), (2, "", "en", None, 0), (2, "", "en", None, 0), (3, long, "en", "src0", len(long)), (3, long, "en", "src0", len(long)), (4, "tie tie", "en", "src1", 7), (None, "no id here", None, "src1", 5)]
    names = ["quality", "row", "node", "keys", "size", "hash", "src", "target", "ids_score", "part", "__cairn_row2"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names)
    docs = spark.createDataFrame([(*r, *names) for r in rows], schema)
    out = dict(C.STAGES)[name](spark, docs, SF)
    found = out.collect()
    if name == "encoding":
        assert len(found) == len(rows) and {r["n_pieces"] for r in found if r["doc_id"] == 2} == {0}
        model = pieces.load(C.piece_model_path())
        assert {model.decode(bytes(r["ids"])) for r in found if r["doc_id"] == 3} == {long}
        return
    assert out.columns == docs.columns and {tuple(r)[5:] for r in found} <= {tuple(names)}
    ids = collections.Counter(r["doc_id"] for r in found)
    if name == "near_duplicates":  # null and empty texts are one group
        assert ids[3] == 1 and ids[4] == 1 and ids[None] == 1 and ids[1] + ids[2] == 1
    if name == "secrets":
        assert ids == collections.Counter(r[0] for r in rows)
    if name == "mixing":
        assert all(n <= 2 * sum(r[0] == i for r in rows) for i, n in ids.items()) and ids[3] > 0


def test_quality_stage_matches_the_plain_classifier(spark):
    """The stage keeps what a classifier with all documents in memory keeps."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r["doc_id"] for r in C.quality(spark, docs, SF).collect()}
    known = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = docs.select(docs["doc_id"].alias("id"), *cotraining._inputs(docs, *cotraining._INPUTS)).withColumn("key", cotraining._hash(*cotraining._INPUTS)).withColumn("row", cotraining._hash("id", *cotraining._INPUTS)).collect()
    of = lambda rs: cotraining._view_batches(*([None if r[c] is None else bytes(r[c]) if c == "text" else r[c] for r in rs] for c in cotraining._INPUTS))
    labelled = sorted((r for r in rows if r["id"] in known), key=lambda r: r["row"])
    pool = sorted({r["key"]: r for r in rows if r["id"] not in known}.values(), key=lambda r: r["key"])
    model, _ = test_cotraining.plain(*of(labelled), np.array([known[r["id"]] for r in labelled], dtype=np.float32), np.array([r["key"] % 2 for r in labelled]), *of(pool))
    p = model.scores(*of(rows))[2]
    sure = {r["id"] for r, x in zip(rows, p, strict=True) if x >= cotraining.KEEP_FROM + 0.01}
    maybe = {r["id"] for r, x in zip(rows, p, strict=True) if x >= cotraining.KEEP_FROM - 0.01}
    assert sure <= found <= maybe and len(sure) > 100


def test_every_stage_takes_an_empty_table(spark):
    _, docs = small(spark)
    for _, stage in C.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == []


def test_whole_run(spark):
    out = C.run(spark, SF).collect()
    model = pieces.load(C.piece_model_path())
    source = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(out) > 100
    for r in out[:200]:
        text = model.decode(bytes(r["ids"]))
        assert r["n_pieces"] == len(r["ids"]) // 4 and r["n_best_scores"][0] == r["score"]
        assert text == source[r["doc_id"]] or re.search(r"\[(ASSIGN|ACCESS|HEX)\]", text)
    assert max(collections.Counter(r["doc_id"] for r in out).values()) <= 2
