import re
from collections import defaultdict

from cairn.llm import mixing as M


def plain_targets(sizes, share=1.5, limit=2.0):
    """Targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: M.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(limit * sizes[s] for s in full)
        open_ = sum(weight[s] for s in order if s not in full)
        target = {s: limit * sizes[s] if s in full else rest * weight[s] / open_ for s in order}
        over = {s for s in order if s not in full and target[s] > limit * sizes[s]}
        if not over:
            return target
        full |= over


def corpus():
    rows = []
    for s, (src, n) in enumerate([("a", 400), ("b", 30), ("é", 200), (None, 90), ("z", 1), ("empty", 3), ("Z", 150)]):
        for i in range(n):
            rows.append((1000 * s + i, "" if src == "empty" else "w " * (1 + (i * 7919 + s) % 23), src, i))
    return [*rows, (9001, None, "a", 0), (9002, "x\x85y z\x1f\tq", "a", 0)]


def test_targets_and_takes(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    out = M.taken(df).collect()
    assert len(out) == len(rows)
    source = {r[0]: r[2] for r in rows}
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    sizes, takes = defaultdict(int), defaultdict(int)
    for i, n in size.items():
        sizes[source[i]] += n
    want = plain_targets(sizes)
    for r in out:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
        assert r["size"] == 0 or r["taken"] % r["size"] == 0
        assert r["taken"] <= 2 * r["size"]
        takes[s] += r["taken"]
    for s in sizes:
        assert abs(takes[s] - want[s]) <= 12 or sizes[s] <= 23
    again = M.taken(df.repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))
    mixed = M.sample(df).collect()
    assert sum(size[r["doc_id"]] for r in mixed) == sum(takes.values()) and mixed[0].asDict().keys() == {"doc_id", "text", "source", "size"}


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame(corpus()[:50], "doc_id long, text string, source string, size int")
    plan = M.taken(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_tables_and_repeated_rows(spark):
    schema = "doc_id long, text string, source string, src string, hash int, target int"
    assert M.taken(spark.createDataFrame([], schema)).collect() == [] and M.sample(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, "a b", "s", "", 1, 1)] * 5 + [(None, None, None, None, None, None)] * 2
    out = M.taken(spark.createDataFrame(rows, schema)).collect()
    assert len(out) == 7 and {r["taken"] for r in out if r["doc_id"] is None} == {0}
    assert sum(r["taken"] for r in out) in (14, 16) and {r["taken"] for r in out if r["doc_id"]} == {2, 4}  # 15 of 10 words


def test_a_large_group_of_repeated_rows_is_taken_in_part(spark):
    rows = [(7, "a b c", "s", i % 3, "x", 0) for i in range(600)] + [(i, "a b c", "t", 0, "", 0) for i in range(300)]
    df = spark.createDataFrame(rows, "src long, text string, source string, size int, hash string, key0 int")
    for at in (M.taken(df, "src"), M.taken(df.repartition(9), "src")):
        out = at.collect()
        takes = defaultdict(int)
        for r in out:
            takes["s" if r["src"] == 7 and r["source_size"] == 1800 else "t"] += r["taken"]
            target = {r["source_size"]: r["target"]}
        assert len(out) == 900 and abs(takes["s"] - next(r["target"] for r in out if r["source_size"] == 1800)) <= 6
        assert len({r["taken"] for r in out if r["source_size"] == 1800}) == 2 and target
    mixed = M.sample(df, "src").collect()
    assert abs(3 * sum(r["source"] == "s" for r in mixed) - takes["s"]) == 0 and mixed[0].asDict().keys() == {"src", "text", "source", "size", "hash", "key0"}
