import hashlib
import random

import numpy as np
import pytest

from cairn.llm import substrings as S


def brute(texts, n, keep):
    seen = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - n + 1):
            seen.setdefault(t[p : p + n], []).append((i, p))
    out = []
    for i, t in enumerate(texts):
        gone = np.zeros(len(t), dtype=bool)
        for p in range(len(t) - n + 1):
            places = seen[t[p : p + n]]
            if len(places) > 1 and (keep == "none" or places[0] != (i, p)):
                gone[p : p + n] = True
        runs = S._runs(gone)
        out.append((len(t), int(gone.sum()), len(runs), hashlib.sha256(S.cut(t, runs)).hexdigest()))
    return out


def test_longest_previous_factors_match_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        t = bytes(rng.choice(b"ab" if rng.random() < 0.5 else b"abcd") for _ in range(rng.randint(1, 40)))
        data = np.frombuffer(t, dtype=np.uint8).astype(np.int64)
        earlier, later = S.longest_matches(data)
        for i in range(len(t)):
            lcp = lambda j: next((k for k in range(len(t)) if max(i, j) + k >= len(t) or t[i + k] != t[j + k]), len(t))  # noqa: E731, B023
            assert earlier[i] == max([lcp(j) for j in range(i)], default=0)
            assert later[i] == max([lcp(j) for j in range(i + 1, len(t))], default=0)


def test_equal_strings_have_equal_anchors():
    rng = random.Random(2)
    core = bytes(rng.choice(b"abcdef ") for _ in range(300))
    texts = [bytes(rng.choice(b"abcdef ") for _ in range(rng.randint(0, 400))) + core + bytes(rng.choice(b"xyz") for _ in range(50)) for _ in range(4)]
    by_string = {}
    for t in texts:
        h, _, first, last = S.anchors(np.frombuffer(t, dtype=np.uint8), 200)
        assert (np.concatenate([[0], last[:-1] + 1]) == first).all() and last[-1] == len(t) - 200
        for a, lo, hi in zip(h.tolist(), first.tolist(), last.tolist(), strict=True):
            for p in range(lo, hi + 1):
                assert by_string.setdefault(t[p : p + 200], a) == a


def corpus():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 9))) for _ in range(200)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, hot = text(60), text(45)
    texts = [text(rng.randint(0, 150)) for _ in range(25)]
    texts += [text(20) + " " + passage + " " + text(rng.randint(0, 30)) for _ in range(6)]
    texts += [text(8) + hot + text(5) for _ in range(40)]
    texts += [texts[3]] * 3 + ["na " * 300, "x" * 900, "", None, "short", passage, passage + passage]
    near = text(120).split()
    for _ in range(12):
        w = list(near)
        w[rng.randrange(len(w))] = "CHANGED"
        texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("bucket", [256, 3])
def test_digest_matches_brute_force(spark, keep, bucket, monkeypatch):
    monkeypatch.setattr(S, "BUCKET", bucket)  # 3: most anchors take the way of hot ones
    texts = corpus()
    df = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "doc_id long, text string, n_spans string").coalesce(1)
    got = {r["doc_id"]: tuple(r)[1:] for r in S.digest(df, keep=keep).collect()}
    want = brute([(t or "").encode() for t in texts], 200, keep)
    assert got == dict(enumerate(want))


def test_remove_keeps_columns_and_empty_tables(spark):
    schema = "doc_id long, text string, start string, h int"
    assert S.remove(spark.createDataFrame([], schema)).collect() == []
    rng = random.Random(5)
    t = "".join(rng.choice("abcdefgh ") for _ in range(400))
    rows = S.remove(spark.createDataFrame([(1, t, None, 1), (2, t, "a", None), (2, t, "a", None)], schema).coalesce(1)).collect()
    assert sorted(len(r["text"]) for r in rows) == [0, 0, 400] and rows[0].asDict().keys() == {"doc_id", "text", "start", "h"}
