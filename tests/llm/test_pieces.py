import random

import numpy as np
import public_tokenizers
import pytest

from cairn.llm import pieces as P

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return P.PieceModel(PATH)


def all_paths(model, part):
    """Every segmentation of a part, by plain recursion."""
    if not part:
        return [(0.0, ())]
    out = []
    for n in range(1, len(part) + 1):
        found = model.prefixes.get(part[:n])
        if found:
            out += [(found[1] + s, (found[0], *ids)) for s, ids in all_paths(model, part[n:])]
        elif n == 1:
            char = P.SPACE if part[0] == P.LITERAL else part[0]
            out += [(model.unknown + s, (*(model.bytes[b] for b in char.encode()), *ids)) for s, ids in all_paths(model, part[1:])]
    return out


def test_n_best_matches_all_segmentations(model):
    rng = random.Random(4)
    for _ in range(80):
        part = P.SPACE * rng.randint(0, 2) + "".join(rng.choice("aehtinré一\U0001f600.x") for _ in range(rng.randint(1, 6)))
        want = sorted(all_paths(model, part), reverse=True)
        got = model.n_best(part, 6)
        assert [s for s, _ in got] == [s for s, _ in want[:6]]
        assert set(got) <= set(want) and len(set(got)) == len(got)


def test_n_best_of_whole_texts(model):
    for text in ["the in", "to a  be", "on\nit", " x", "is "]:
        want = sorted((s for s, _ in all_paths(model, (P.SPACE + text).replace(" ", P.SPACE))), reverse=True)
        got = model.encode(text, 5)
        assert [s for s, _ in got] == want[:5]
        assert len({i for _, i in got}) == len(got) and all(model.decode(i) == text for _, i in got)


def test_round_trip(model):
    rng = random.Random(5)
    alphabet = "abc  \n\t▁éß中한\U0001f600\x00\x1f​.,|#"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(300)] + [" ", "  ", "▁", "a" * 20_000]
    for t in texts:
        for score, ids in model.encode(t, 3):
            assert model.decode(ids) == t and np.isfinite(score)


def test_operator(spark):
    rows = [(1, "the and of", "x"), (2, None, None), (3, "", "y"), (1, "the and of", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids_score string")
    out = P.decode(P.encode(df, PATH, n_best=3), PATH).collect()
    assert [r["decoded"] for r in out] == [r[1] for r in rows]
    assert [r["ids_score"] for r in out][1:3] == [0.0, 0.0] and out[0]["ids"] == out[3]["ids"] and len(out[0]["ids_n_best"]) == 3
    assert P.encode(df.limit(0), PATH).collect() == []


def test_a_small_cache_changes_no_result(spark):
    model = P.PieceModel(PATH)
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["the", "end"]) if rng.random() < 0.5 else "".join(rng.choice("aehtinr") for _ in range(8)) for _ in range(60)) for _ in range(200)]
    want = [model.encode(t, 3) for t in texts]
    model.release()
    model.limit = 100_000
    sizes = []
    for t, w in zip(texts * 2, want * 2, strict=True):
        assert model.encode(t, 3) == w
        sizes.append(model.held)
    assert max(sizes) < 150_000 and any(b < a for a, b in zip(sizes, sizes[1:], strict=False)) and " the" in model.index
    df = spark.createDataFrame([(1, texts[0], "x")], "doc_id long, text string, ids string")
    row = P.encode(df, PATH, n_best=2, keep=["doc_id"], paths=False, decoded="back").first().asDict()
    assert list(row) == ["doc_id", "ids", "ids_score", "ids_n_best", "back"] and row["back"] == texts[0] and [list(x.asDict()) for x in row["ids_n_best"]] == [["score"]] * 2
