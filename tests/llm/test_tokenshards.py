import io
import struct

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import tokenshards as S

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def coder():
    return S.CachedEncoder(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcé中 '.,\n\t\r\x85\xa0　\x1c12<|>")) | st.characters(exclude_categories=["Cs"]), max_size=40))
def test_cached_encoding_is_the_librarys(text):
    coder = S.encoder(PATH)
    assert np.frombuffer(coder.encode_many([text])[0], dtype="<u4").tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


def shard(items):
    stream = io.BytesIO()
    writer = S.ShardWriter(stream)
    for key, ids in items:
        writer.add(key, ids)
    writer.close()
    return S.ShardReader(stream, stream.tell())


def test_shard_round_trip_and_lookup(monkeypatch):
    monkeypatch.setattr(S, "BLOCK_BYTES", 300)  # many blocks
    rng = np.random.default_rng(0)
    ids = sorted(set(rng.integers(-1000, 3000, 700).tolist()))
    items = [(S.make_key(i), rng.integers(0, 70_000 if i % 7 == 0 else 60_000, rng.integers(0, 30)).astype("<u4").tobytes()) for i in ids]
    reader = shard(items)
    assert len(reader.index) > 20 and list(reader.scan()) == items and reader.documents == len(items)
    assert [S.key_id(k) for k, _ in items] == ids
    for i in range(-1010, 3010):
        assert reader.get(S.make_key(i)) == dict(items).get(S.make_key(i))
    absent = [S.make_key(i) for i in range(10_000, 20_000)]
    assert sum(map(reader.may_contain, absent)) < 200


def test_damage_is_found():
    stream = io.BytesIO()
    writer = S.ShardWriter(stream)
    writer.add(S.make_key(1), struct.pack("<I", 5))
    writer.close()
    data = bytearray(stream.getvalue())
    data[5] ^= 1
    with pytest.raises(ValueError):
        list(S.ShardReader(io.BytesIO(bytes(data)), len(data)).scan())
    with pytest.raises(ValueError):
        writer.add(S.make_key(0), b"")


def test_operator(spark, coder):
    rows = [(5, "hello there", "x"), (-3, None, "y"), (7, "", None), (None, "a  b", "z"), (9, "word " * 5000, ""), (5, "again", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    manifest = S.write_shards(df, PATH)
    found = sorted(S.read_shards(manifest).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == [None, -3, 5, 5, 7, 9]
    at = 0
    for r in found:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) // 4 and r["ids"][-4:] == struct.pack("<I", 2)
        at += r["n_tokens"]
    assert found[-1]["ids"][:-4] == np.array(coder.tokenizer.encode("word " * 5000).ids, dtype="<u4").tobytes()
    assert S.lookup(spark, manifest, [7, 9, 100])[7].tolist() == [2]
    assert S.read_shards(S.write_shards(df.limit(0), PATH)).collect() == []
