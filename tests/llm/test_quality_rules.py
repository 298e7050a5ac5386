import random
import re
from collections import Counter

from cairn.llm import quality_rules as Q


def plain(text):
    """Base columns and the method's shares by their definitions."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, total = len(words), sum(map(len, words))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup, dup_chars = set(), 0, 0
    for x in lines:
        if x in seen:
            dup += 1
            dup_chars += sum(map(len, re.findall(r"[^\x20\x09-\x0D]+", x)))
        seen.add(x)

    def windows(k):
        return [tuple(words[i : i + k]) for i in range(n - k + 1)]

    count = Counter(windows(3))
    repeated = {i + j for i, w in enumerate(windows(3)) if count[w] > 1 for j in range(3)}
    failed = n < 50 or 100 * len(repeated) > 50 * n
    bad = dup_chars > Q.LINE_LIMIT * total
    for k in range(2, 11):
        count = Counter(windows(k))
        if not count or max(count.values()) < 2:
            continue
        if k in Q.TOP_LIMITS:
            top = max(count.values())
            share = min(1.0, top * max(sum(map(len, w)) for w, c in count.items() if c == top) / total)
            bad |= share > Q.TOP_LIMITS[k]
        else:
            met, inside = set(), set()
            for i, w in enumerate(windows(k)):
                if w in met:
                    inside |= set(range(i, i + k))
                met.add(w)
            bad |= sum(len(words[i]) for i in inside) / total > Q.DUPLICATE_LIMITS[k]
    return n, total, len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated), failed, not failed and not bad


def test_measures_match_brute_force():
    rng = random.Random(1)
    texts = [None, "", " \n\t", "a", "#|* <x>", "é\x85ß \x1f"]
    for _ in range(300):
        vocabulary = [rng.choice(["the", "é", "x|y", "w%d" % i, "中文"]) + str(i) for i in range(rng.choice([2, 10, 60, 400]))]
        lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 25))]
        texts.append("\n".join(rng.choice(lines) if rng.random() < 0.3 else x for x in lines))
    for t in texts:
        m = Q.measure(None if t is None else t.encode())
        assert (*m[:6], m[-1]) == plain(t), t


def test_operator(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(1, good, "x"), (2, None, "y"), (3, "buy now " * 60, None), (1, good, "x"), (4, "x " * 200_000, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    out = Q.rules(df).collect()
    assert [r["kept"] for r in out] == [True, False, False, True, False] and [r["base_failed"] for r in out] == [False, True, True, False, True]
    assert Q.rules(df.limit(0)).collect() == []
