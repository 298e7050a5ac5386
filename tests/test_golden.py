"""Golden values and scenarios of byte layouts, logs, filters, sketches, cursors and the policy."""

import io
import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.functions import codec
from cairn.operators import bloom, cache, memtable, metrics, ordered, policy, sst
from cairn.sources import wal
from cairn.streaming import versions

KV26 = [f"ab{c}" for c in "abcdefghijklmnopqrstuvwxyz"]


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def keys(spark, values=tuple(KV26)):
    return spark.createDataFrame([(v,) for v in values], "k string")


def test_checksums(spark):
    zero, full = F.unhex(F.lit("00" * 32)), F.unhex(F.lit("FF" * 32))
    row = one(spark, F.crc32(zero), F.crc32(full), codec.mask_crc(F.lit(zlib.crc32(b"abcde"))), codec.unmask_crc(codec.mask_crc(F.lit(0xFFFFFFFF))), codec.unmask_crc(codec.mask_crc(F.lit(0))))
    assert tuple(row) == (420107693, 4285311755, 1397618151, 0xFFFFFFFF, 0)
    assert wal.masked(b"abcde") == 1397618151


def test_fixed_width_round_trips(spark):
    values = [0, 1, -1, 255, 256, 2**31, 2**32 - 1, 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    rows = df.select("v", codec.decode_fixed64(codec.encode_fixed64(F.col("v"))).alias("w"), codec.decode_fixed32(codec.encode_fixed32(F.col("v"))).alias("x")).collect()
    assert all(r["w"] == r["v"] and r["x"] == r["v"] % 2**32 for r in rows)


def test_version_round_trip_and_damage(spark):
    key, value = F.unhex(F.lit("03" * 24)), F.unhex(F.lit("08" * 12))
    data = codec.encode_version(key, codec.tag(F.lit(1), F.lit(codec.VALUE)), value)
    row = one(spark, data.alias("d"), codec.decode_version(data).alias("e"), codec.decode_version(F.substring(data, 1, 20)).alias("bad"), codec.decode_version(F.unhex(F.lit("0100000000"))).alias("tiny"))
    assert len(row["d"]) == 24 + 12 + 16 and bytes(row["e"]["key"]) == b"\x03" * 24 and bytes(row["e"]["value"]) == b"\x08" * 12
    assert (row["e"]["seq"], row["e"]["kind"], row["e"]["status"]) == (1, 1, "OK")
    assert row["bad"]["status"] == row["tiny"]["status"] == "CODEC_ERROR" and row["bad"]["seq"] is None
    with pytest.raises(Exception, match="empty key"):
        one(spark, codec.encode_version(F.unhex(F.lit("")), F.lit(1).cast("long"), value))


def test_log_golden_sizes_and_offsets():
    records = [b"abcdefghi", b"123456789012", b"0101010101010101010101"]
    data = wal.write_log(records, block=17)
    assert len(data) == 93 and [r for _, r in wal.read_log(data, block=17)] == records
    damaged = bytes(data[:2]) + bytes([data[2] ^ 1]) + data[3:]
    assert list(wal.read_log(damaged, block=17)) == [("CORRUPT", b""), ("OK", records[1]), ("OK", records[2])]
    texts = [b"hello world. My first log entry.", b"and my second", b"and my third"]
    whole = wal.write_log(texts)
    assert len(whole) == sum(map(len, texts)) + 21
    first = wal.write_log(texts[:1])
    assert first + wal.write_log(texts[1:], offset=len(first)) == whole
    assert [s for s, _ in wal.read_log(whole[:-3])] == ["OK", "OK", "TRUNCATED"] and wal.write_log([b""]) == b""


@pytest.mark.parametrize("block", [17, 64, 32_768])
def test_frames_and_replay_of_several_logs(spark, block):
    rows = [(f"log{i % 2}", i, bytes([i % 251]) * (i * 7 % 90)) for i in range(60)]
    df = spark.createDataFrame(rows, "log string, pos long, record binary")
    framed = wal.frames(df, "log", "pos", "record", block=block)
    back = {r["pos"]: (r["status"], bytes(r["record"])) for r in wal.replay(framed).collect()}
    assert back == {p: ("OK", d) for _, p, d in rows if d}
    size = max(r["off"] + 7 + r["len"] for r in framed.where("log = 'log0'").collect())
    assert size == len(wal.write_log([d for n, _, d in rows if n == "log0"], block=block))
    spoilt = framed.withColumn("crc", F.when(F.col("pos") == 5, 1).otherwise(F.col("crc")))
    assert {r["pos"] for r in wal.replay(spoilt).where("status = 'CORRUPT'").collect()} == {5}
    with pytest.raises(Exception, match="corrupt frame"):
        wal.replay(spoilt, strict=True).collect()


def test_log_files(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(wal.write_log([b"one", b"x" * 40_000]))
    rows = wal.read_files(spark, f"file://{tmp_path}/*.log").collect()
    assert [(r["pos"], r["status"], len(r["record"])) for r in rows] == [(0, "OK", 3), (1, "OK", 40_000)]


def test_log_is_read_a_frame_at_a_time():
    """The first record is there before the file has been read beyond its frame and the next header."""

    class Counted(io.BytesIO):
        asked = 0

        def read(self, n=-1):
            out = super().read(n)
            Counted.asked += len(out)
            return out

    records = [bytes([i]) * 50_000 for i in range(40)]
    found = wal.scan_log(Counted(wal.write_log(records)))
    assert next(found) == ("OK", records[0]) and Counted.asked < 60_000
    assert [r for _, r in found] == records[1:]


def test_log_files_larger_than_a_batch_and_odd_names(spark, tmp_path):
    """Logs over several stored files, empty ones, a null name beside an empty one; read from a path with odd characters, in small batches."""
    rng = random.Random(8)
    rows = [(name, i, rng.randbytes(rng.choice([0, 1, 900, 70_000]))) for name, n in ((None, 7), ("", 5), ("hot", 300), ("zü", 1)) for i in range(n)] + [("none", 1, b""), ("none", 2, None)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "log string, pos long, record binary")
    folder = f"file://{tmp_path}/of%20logs"
    written = {r["log"]: r for r in wal.write_files(df, "log", "pos", "record", folder).collect()}
    for name in (None, "", "hot", "zü"):
        want = wal.write_log([d for k, _, d in rows if k == name])
        with open(written[name]["path"], "rb") as f:
            assert f.read() == want and written[name]["bytes"] == len(want)
    assert len(written) == 4
    odd = tmp_path / "a b%20c"
    (tmp_path / "of logs").rename(odd)
    for streams in (True, False):
        held, wal._streams = wal._streams, (wal._streams if streams else lambda spark, path: False)
        try:
            found = wal.read_files(spark, f"{odd}/*.log")
            by = {}
            for r in found.collect():
                by.setdefault(r["path"].rpartition("/")[2], {})[r["pos"]] = (r["status"], bytes(r["record"]))
        finally:
            wal._streams = held
        for name, file in written.items():
            assert [by[file["path"].rpartition("/")[2]][i] for i in range(len(by[file["path"].rpartition("/")[2]]))] == [("OK", d) for k, _, d in rows if k == name and d]
    assert wal._streams(spark, f"{odd}/*.log") and not wal._streams(spark, f"{odd}-none")


def test_frames_go_through_python_in_bounded_batches(spark):
    """Frames' places need no records; batches with records are small both ways."""
    from cairn.plans import catalog

    rows = [("a" if i % 3 else None, i, None if i == 5 else bytes([i % 251]) * (i * 97 % 40_000)) for i in range(400)]
    df = spark.createDataFrame(rows, "log string, pos long, record binary")
    full, places = wal.frames(df, "log", "pos", "record"), wal.frames(df, "log", "pos", "record", payload=False)
    assert places.columns == full.columns[:-2] and sorted(map(str, places.collect())) == sorted(map(str, full.drop("crc", "payload").collect()))
    assert 0 < int(str(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")).removesuffix("b")) <= 4 << 20
    plan = catalog.QUERIES["wal_frames"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "octet_length" in plan and "payload" not in plan
    schema = pa.schema([("pos", pa.int64()), ("payload", pa.binary())])
    found = list(wal.batched(((i, b"x" * 900_000) for i in range(20)), schema, "payload"))
    assert [b.num_rows for b in found] == [5] * 4


def test_seeks(spark):
    df = keys(spark)
    want = {"abf": "abf", "ab{": None, "aaa": "aba", "ab": "aba", "abc": "abc"}
    assert {r["t"]: r["k"] for r in ordered.ceiling(df, "k", list(want)).collect()} == want
    below = {"ab0": None, "abd": "abc", "ab{": "abz"}
    assert {r["t"]: r["k"] for r in ordered.floor_strict(df, "k", list(below)).collect()} == below
    table = ordered.probes(df, list(below), "t")
    assert {r["t"]: r["k"] for r in ordered.nearest(df, "k", table, "t").collect()} == below
    table = ordered.probes(df, list(want), "t")
    assert {r["t"]: r["k"] for r in ordered.nearest(df, "k", table, "t", below=False).collect()} == want
    at_most = {"ab0": None, "abd": "abd", "ab{": "abz"}
    table = ordered.probes(df, list(at_most), "t")
    assert {r["t"]: r["k"] for r in ordered.nearest(df, "k", table, "t", or_equal=True).collect()} == at_most
    members = memtable.contains(keys(spark, ("aby", "abc", "abz", "ab{", "123", "aaa", "456")), "k", df, "k")
    assert {r["k"] for r in members.where("present").collect()} == {"aby", "abc", "abz"}


def test_insert_unique_rejects(spark):
    df = spark.createDataFrame([(k, i) for i, k in enumerate([*KV26, "abc", "abf"])], "k string, at long")
    assert memtable.insert_unique(df, "k", "at").count() == 26
    assert sorted(r["at"] for r in memtable.rejected(df, "k", "at").collect()) == [26, 27]


@pytest.mark.parametrize(("block", "counts"), [(55, [2] * 13), (220, [12, 12, 2])])
def test_block_packing(spark, block, counts):
    df = keys(spark)
    rows = sorted(sst.pack(df, "k", codec.entry_size(F.col("k"), F.col("k")), block).collect(), key=lambda r: r["block_id"])
    assert [r["entries"] for r in rows] == counts and [r["bytes"] for r in rows] == [c * 18 + 8 for c in counts]
    fixed = sorted(sst.index(sst.numbered(df, "k", 14, block), 14, block).collect(), key=lambda r: r["block_id"])
    assert [r["entries"] for r in fixed] == counts and [r["base_key"] for r in fixed] == [r["base_key"] for r in rows]


def test_damaged_blocks_give_nothing(spark):
    df = keys(spark).withColumn("block_id", F.lit(0))
    packed = sst.block_bytes(df, "k", "k")
    assert sst.read_block(packed, "data").count() == 26
    spoilt = packed.withColumn("data", F.concat(F.unhex(F.lit("FF")), F.expr("substring(data, 2)")))
    assert sst.read_block(spoilt, "data").count() == 0


def reference_filter(hashes, bits_per_key=10):
    bits = max(64, (len(hashes) * bits_per_key + 7) // 8 * 8)
    out = bytearray(bits // 8)
    for h in hashes:
        delta = (h >> 17) | (h << 15) & 0xFFFFFFFF
        for i in range(6):
            p = (h + i * delta) % 2**32 % bits
            out[p // 8] |= 1 << p % 8
    return bytes(out) + b"\x06"


@pytest.mark.parametrize("n", [1, 10, 100, 5000])
def test_bloom_contract(spark, n):
    df = spark.range(n).toDF("key")
    h, k = bloom.hash_int32(F.col("key")), bloom.probes()
    assert k == 6
    bits = max(64, (n * 10 + 7) // 8 * 8)
    words = bloom.build(df, h, bits, k)
    data = bytes(bloom.pack(words, bits, k).first()["filter"])
    assert data == reference_filter([r["h"] for r in df.select(h.alias("h")).collect()]) and len(data) < n * 10 / 8 + 40
    probes = df.union(spark.range(1_000_000_000, 1_000_010_000).toDF("key"))
    found = bloom.may_contain(probes, "key", h, words, bits, k).groupBy((F.col("k") < 1_000_000_000).alias("present")).agg(F.count_if("may_contain").alias("yes")).collect()
    by = {r["present"]: r["yes"] for r in found}
    assert by[True] == n and by[False] < 200


def test_larger_filters_are_looked_up_without_a_join(spark, monkeypatch):
    """By table, by array and by join, a filter gives the same answers: of repeated, null and absent keys, also of a filter without keys."""
    for keys_ in (spark.range(0, 4000, 2).toDF("key"), spark.range(0).toDF("key")):
        h, k = bloom.hash_int32(F.col("key")), bloom.probes()
        bits = max(64, (keys_.count() * 10 + 7) // 8 * 8)
        words = bloom.build(keys_, h, bits, k)
        probes = spark.range(5000).toDF("key").union(spark.range(50).toDF("key")).union(spark.createDataFrame([(None,), (-7,)], "key long"))
        by = {}
        for name, small, large in (("table", 1 << 23, 1 << 29), ("array", 1, 1 << 29), ("join", 1, 1)):
            monkeypatch.setattr(bloom, "SMALL_BITS", small)
            monkeypatch.setattr(bloom, "LARGE_BITS", large, raising=False)
            found = bloom.may_contain(probes, "key", h, words, bits, k)
            assert name != "array" or "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
            by[name] = sorted(map(tuple, found.collect()), key=str)
        assert by["array"] == by["table"] == by["join"] and len(by["array"]) == 5002


def test_bloom_hash_of_bytes(spark):
    rows = spark.range(2000).select(bloom.hash_int32(F.col("id")).alias("a"), bloom.hash_bytes(codec.encode_fixed32(F.col("id"))).alias("b"))
    assert rows.where("a != b").count() == 0
    texts = spark.createDataFrame([("",), ("a",), ("hello",), ("world!!",)], "t string").select(bloom.hash_bytes(F.col("t").cast("binary")).alias("h"))
    assert len({r["h"] for r in texts.collect()}) == 4
    assert bloom.sizing(5, 17) == (17, 19)


def test_sketch_and_frequencies(spark):
    df = spark.createDataFrame([(1,), (1,)], "k long")
    counters = policy.sketch(df, F.col("k"), 16)
    asked = spark.createDataFrame([(0,), (1,)], "k long")
    assert {r["k"]: r["est"] for r in policy.estimate(counters, asked, "k", 16).collect()} == {1: 2, 0: 0}
    assert {r["c"] for r in policy.halve(counters).collect()} == {1}
    seen = spark.createDataFrame([(1,), (2,), (2,)], "k long")
    assert {r["k"]: r["est"] for r in policy.lfu_estimate(seen, "k").collect()} == {1: 1, 2: 2}


def test_admission_scenario(spark):
    p = policy.Admission(100, 1000)
    assert p.add(1, 101) == ([], False)
    p.residents, p.used = {1: 1}, 1
    for k in (1, 2, 3):
        p.access(k)
    assert p.add(1, 1) == ([], False) and p.add(2, 20) == ([], True)
    gone, added = p.add(3, 90)
    assert gone and added
    assert p.add(4, 20)[1] is False and p.used <= 100
    ops = [(1, "access", 2, 0), (2, "add", 2, 20), (3, "add", 3, 90), (4, "add", 9, 101), (5, "access", 3, 0), (6, "access", 3, 0), (7, "add", 3, 90), (8, "remove", 2, 0)]
    events = policy.replay(spark.createDataFrame(ops, "seq long, op string, key long, cost long"), 100)
    assert [(r["seq"], r["event"], r["key"]) for r in sorted(events.collect(), key=lambda r: r["seq"])] == [(2, "admit", 2), (3, "reject", 3), (4, "reject", 9), (7, "evict", 2), (7, "admit", 3)]
    counts = {r["metric"]: r["value"] for r in metrics.of_replay(events).collect()}
    assert counts["keys-added"] == 2 and counts["keys-evicted"] == 1 and counts["cost-evicted"] == 20 and counts["sets-rejected"] == 2
    assert "keys-added: 2" in metrics.report(metrics.of_replay(events)).first()["report"]


def test_pushdown_and_plans(spark):
    from cairn.plans import catalog

    plan = lambda n: catalog.QUERIES[n](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    point = plan("kv_point_get")
    assert "EqualTo(c_name,Customer#000000042)" in point and "ReadSchema: struct<c_name:string,c_mktsegment:string>" in point
    assert "In(c_name" in plan("kv_multi_get") and "TakeOrderedAndProject" in plan("kv_range_forward")
    assert "Window" not in plan("mem_live") and "Python" not in plan("mem_entry_layout") and "SinglePartition" not in plan("policy_room").split("Physical Plan")[0]


def test_expiry_boundaries(spark):
    df = spark.sql("SELECT * FROM VALUES (1, timestamp_ntz'2024-01-01 00:00:00'), (2, timestamp_ntz'2024-01-01 00:00:04.999'), (3, null) t(k, exp)")
    now = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    rows = {r["k"]: (r["live"], r["b"]) for r in df.select("k", cache.is_live(F.col("exp"), now).alias("live"), cache.storage_bucket(F.col("exp")).alias("b")).collect()}
    assert rows[1][0] and rows[2][0] and rows[3] == (True, None) and rows[1][1] == rows[2][1]


def plain_replay(ops, max_cost, counters=10_000):
    """Admission by lists and full scans, apart from the operator's own state."""
    held, seen, often, total, out = {}, set(), {}, 0, []
    for seq, op, key, cost in sorted(ops):
        rank = lambda k: often.get(k, 0) + (k in seen)  # noqa: E731, B023
        if op == "access":
            out.append((seq, key, "hit" if key in held else "miss", 0))
            if key in seen:
                often[key] = min(15, often.get(key, 0) + 1)
            seen.add(key)
            total += 1
            if total == counters:
                total, seen, often = 0, set(), {k: n // 2 for k, n in often.items()}
        elif op == "remove":
            if key in held:
                out.append((seq, key, "remove", held.pop(key)))
        elif cost > max_cost:
            out.append((seq, key, "reject", cost))
        elif key in held:
            held[key] = cost
            out.append((seq, key, "update", cost))
        else:
            while sum(held.values()) + cost > max_cost and rank(key) >= min(rank(k) for k in held):
                gone = min(held, key=lambda k: (rank(k), k))
                out.append((seq, gone, "evict", held.pop(gone)))
            if sum(held.values()) + cost > max_cost:
                out.append((seq, key, "reject", cost))
            else:
                held[key] = cost
                out.append((seq, key, "admit", cost))
    return out


def test_replay_matches_a_plain_one(spark):
    rng = random.Random(2)
    ops = []
    for seq in range(4000):
        kind = rng.choice(["access"] * 6 + ["add"] * 5 + ["remove"])
        ops.append((seq, kind, min(int(rng.expovariate(0.05)), 150), rng.randint(1, 130) if kind == "add" else 0))
    df = spark.createDataFrame(ops, "seq long, op string, key long, cost long")
    for shards in (1, 3):
        found = policy.replay(df, 300, shards, gets=True).collect()
        for s in range(shards):
            want = plain_replay([o for o in ops if o[2] % shards == s], 300 // shards)
            assert sorted((r["seq"], r["event"] != "evict", r["key"], r["event"], r["cost"]) for r in found if r["shard"] == s) == sorted((q, e != "evict", k, e, c) for q, k, e, c in want)
    counts = {r["metric"]: r["value"] for r in metrics.of_replay(policy.replay(df, 300, 1, gets=True)).collect()}
    want = plain_replay(ops, 300)
    assert counts["hit"] == sum(e == "hit" for _, _, e, _ in want) and counts["miss"] == sum(e == "miss" for _, _, e, _ in want) > 0
    assert counts["gets-kept"] == (counts["hit"] + counts["miss"]) // 64 * 64 and counts["gets-dropped"] == counts["sets-dropped"] == 0
    state = policy.Admission(300, 50)  # halving now and then
    for _, op, key, cost in ops:
        if op == "access":
            state.access(key)
        elif op == "add":
            state.add(key, cost)
        assert state.used == sum(state.residents.values())  # an update may go beyond the limit


def test_replay_of_counted_accesses(spark):
    """A row that stands for many accesses does as these do, over halvings too, and is one row of the shuffle."""
    from cairn.plans import catalog

    rng = random.Random(5)
    ops = [(2 * i, "access", min(int(rng.expovariate(0.03)), 90), 0, rng.choice([1, 2, 7, 40, 26_000 if i % 40 == 7 else 3])) for i in range(300)]
    ops += [(2 * i + 1, "add", min(int(rng.expovariate(0.03)), 90), rng.randint(1, 130), 1) for i in range(300)]
    df = spark.createDataFrame(ops, "seq long, op string, key long, cost long, times long")
    each = [o[:4] for o in ops for _ in range(o[4])]
    for shards in (1, 3):
        found = policy.replay(df, 300, shards, gets=True).groupBy("shard", "seq", "key", "event", "cost").count().collect()
        want = {}
        for s in range(shards):
            for q, k, e, c in plain_replay([o for o in each if o[2] % shards == s], 300 // shards):
                want[s, q, k, e, c] = want.get((s, q, k, e, c), 0) + 1
        assert {tuple(r)[:5]: r["count"] for r in found} == want and any(e == "evict" for _, _, _, e, _ in want)
        quiet = policy.replay(df, 300, shards).count()
        assert quiet == sum(n for (_, _, _, e, _), n in want.items() if e not in ("hit", "miss"))
    one, many = policy.Admission(300, 50), policy.Admission(300, 50)
    for _, op, key, cost, times in ops:
        for state, calls in ((one, [1] * times), (many, [times])):
            for n in calls if op == "access" else ():
                state.access(key, n)
            if op == "add":
                state.add(key, cost)
        assert (one.counts, one.doorkeeper, one.accesses, one.residents) == (many.counts, many.doorkeeper, many.accesses, many.residents)
    stream = catalog.operations(spark, "/root/testdata/sf0.001")
    assert stream.count() == 2 * stream.select("key").distinct().count()


def test_metrics_of_counted_accesses(spark):
    """Counted accesses have the metrics of single ones, full batches of a shard included."""
    ops = [(1, "access", 1, 0, 100), (2, "add", 1, 5, 1), (3, "access", 1, 0, 70), (4, "access", 2, 0, 29), (5, "add", 2, 300, 1)]
    df = spark.createDataFrame(ops, "seq long, op string, key long, cost long, times long")
    each = spark.createDataFrame([o[:4] for o in ops for _ in range(o[4])], "seq long, op string, key long, cost long")
    found, want = ({r["metric"]: r["value"] for r in metrics.of_replay(policy.replay(x, 200, 2, gets=True)).collect()} for x in (df, each))
    assert found == want and (found["hit"], found["miss"], found["gets-kept"], found["keys-added"], found["sets-rejected"]) == (70, 129, 128, 1, 1)


def test_checked_map_matches_a_plain_one(spark):
    rng = random.Random(4)
    ops = [(rng.randrange(12), rng.choice([0, 1, 2, 2, 2]) if i > 100 else rng.choice([1, 2]), i, f"v{i}") for i in range(300)]
    held = {}
    for h, c, i, v in ops:
        if h not in held or not c or held[h][0] == c:
            held[h] = (c, i, v)
    df = spark.createDataFrame(ops, "h long, conflict long, seq long, v string")
    for part in (ops, ops[:90]):
        held = {}
        for h, c, i, v in part:
            if h not in held or not c or held[h][0] == c:
                held[h] = (c, i, v)
        assert {r["h"]: (r["conflict"], r["seq"], r["v"]) for r in cache.set_checked(df.where(F.col("seq") < len(part)), "seq").collect()} == held
    two = cache.hashed(spark.createDataFrame([("a",), ("b",)], "k string"), "k", integral=False).collect()
    assert two[0]["h"] != two[1]["h"] and two[0]["conflict"] != two[1]["conflict"] and all(r["conflict"] for r in two)


def test_filter_edges(spark):
    def match(h, data):
        return spark.range(1).select(bloom.matches(F.lit(h).cast("long"), F.unhex(F.lit(data))).alias("m")).first()["m"]

    assert match(5, "") is False and match(5, "06") is False and match(5, "00" * 8 + "1F") is True and match(5, "00" * 8 + "06") is False and match(5, "FF" * 8 + "06") is True
    rows = spark.range(1000).select((F.col("id") % 7).alias("b"), F.col("id").alias("k"))
    filters = {r["b"]: bytes(r["filter"]) for r in bloom.block_filters(rows, "b", bloom.hash_int32(F.col("k"))).collect()}
    hashes = {r["k"]: r["h"] for r in rows.select("k", bloom.hash_int32(F.col("k")).alias("h")).collect()}
    assert filters == {b: reference_filter([hashes[k] for k in range(1000) if k % 7 == b]) for b in range(7)}


def test_positions_of_many_partitions(spark):
    """Hot keys, empty partitions, nulls: previous rows, running sums and as-of reads match plain ones."""
    rng = random.Random(6)
    rows = sorted((rng.choice(["a"] * 20 + ["b", "c", "dd"]), i, rng.choice([None, 1, 5])) for i in range(400))
    df = spark.createDataFrame(rows, "k string, seq long, v long").repartition(5)
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        found = {r["seq"]: r["old_v"] for r in memtable.previous_value(df, "k", "seq", "v").collect()}
        assert found == {b[1]: a[2] if a is not None and a[0] == b[0] else None for a, b in zip([None, *rows], rows, strict=False)}
        sums = {r["seq"]: r["s"] for r in ordered.running_sum(df, F.col("v"), "k", "seq", out="s").collect()}
        total, want = 0, {}
        for _, i, v in rows:
            total += v or 0
            want[i] = total
        assert sums == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)


def test_log_stream(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    for name in "ab":
        (tmp_path / "logs" / f"{name}.log").write_bytes(wal.write_log([name.encode() * 50_000, b"end"]))
    rows = versions.complete(wal.read_stream(spark, f"file://{tmp_path}/logs", max_files=1), "test-logs", mode="append").collect()
    assert sorted((r["status"], bytes(r["record"])[:3], len(r["record"])) for r in rows) == [("OK", b"aaa", 50_000), ("OK", b"bbb", 50_000), ("OK", b"end", 3), ("OK", b"end", 3)]


def test_put_continues_a_log(spark):
    one = memtable.put(None, spark.createDataFrame([("a", "x", 2), ("b", None, 1)], "k string, v string, at long"), "k", "v", "at")
    two = memtable.put(one, spark.createDataFrame([("a", None, 1)], "k string, v string, at long"), "k", "v", "at")
    rows = {r["seq"]: (r["k"], r["vtype"], r["tag"], bytes(r["record"])) for r in two.collect()}
    assert {s: r[:3] for s, r in rows.items()} == {0: ("b", 0, 0), 1: ("a", 1, 257), 2: ("a", 0, 512)}
    back = two.select(codec.decode_version(F.col("record")).alias("e")).select("e.*").collect()
    assert sorted((r["seq"], bytes(r["key"]), r["kind"], bytes(r["value"])) for r in back) == [(0, b"b", 0, b""), (1, b"a", 1, b"x"), (2, b"a", 0, b"")]
