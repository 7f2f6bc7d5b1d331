import zlib
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ombra.llm import shards

PATH = shards.public_tokenizers.path(shards.RANKS)


def frame(spark):
    rows = [(i, "some words and ünïcode 🌸 " * (i * 13 % 300), "z") for i in range(60)] + [(100, None, "z"), (101, "", "z"), (None, "null id", "z"), (7, "twice", "z"), (7, "twice", "z"), (102, "<|endoftext|>", "z")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, slot string").repartition(5)


def test_permutation():
    for total in (1, 2, 3, 10, 64, 65, 1000, 4097):
        out = shards.feistel(np.arange(total), total)
        assert sorted(out.tolist()) == list(range(total))
        assert (shards.feistel(np.arange(total)[::-1], total)[::-1] == out).all()
    a, b = shards.feistel(np.arange(1000), 1000), shards.feistel(np.arange(1000), 1000, "other")
    assert (a != b).mean() > 0.9 and abs(np.corrcoef(np.arange(1000), a)[0, 1]) < 0.15


def test_shards_hold_every_sequence_once(spark, tmp_path):
    rows, docs = frame(spark)
    table, total = shards.write_shards(docs, shard=16)
    want = []
    for i, t, _ in rows:
        ids = shards.token_ids(t or "", PATH)
        for n, at in enumerate(range(0, len(ids), shards.LENGTH)):
            want.append((i, n, ids[at : at + shards.LENGTH].tobytes()))
    got = shards.read_slots(table, shard=16).collect()
    assert total == len(want) == len(got)
    assert sorted((r.id is None, r.id or 0, r.seq, bytes(r.ids)) for r in got) == sorted((i is None, i or 0, n, b) for i, n, b in want)
    assert sorted(r.slot for r in got) == list(range(total))
    assert all(r.shard == r.slot // 16 and r.offset == r.slot % 16 * shards.STRIDE for r in got)
    raw = {r.shard: bytes(r.payload) for r in table.collect()}
    assert all(len(p) % shards.STRIDE == 0 for p in raw.values()) and sum(map(len, raw.values())) == total * shards.STRIDE
    some = shards.read_slots(table, 20, 37, shard=16).collect()
    assert sorted(r.slot for r in some) == list(range(20, 37))
    text = shards.encoding(PATH).decode(np.frombuffer(next(r.ids for r in got if r.id == 102), "<u2")[:-1].tolist())
    assert text == "<|endoftext|>"
    bad = table.withColumn("crc32", F.col("crc32") + 1)
    with pytest.raises(Exception, match="damaged"):
        shards.read_slots(bad, shard=16).collect()


def test_slots_dont_depend_on_how_the_input_is_split(spark):
    rows, docs = frame(spark)
    seen = []
    for n in (1, 4, 16):
        table, _ = shards.write_shards(docs.orderBy(F.rand(n)).repartition(n), shard=16)
        seen.append(sorted((r.slot, r.id is None, r.id or 0, r.seq, bytes(r.ids)) for r in shards.read_slots(table, shard=16).collect()))
    assert seen[0] == seen[1] == seen[2]
    more, _ = shards.write_shards(docs, key="other", shard=16)
    assert sorted((r.slot, r.id is None, r.id or 0, r.seq, bytes(r.ids)) for r in shards.read_slots(more, shard=16).collect()) != seen[0]


def test_texts_longer_than_a_shard_and_more_shards_than_tasks(spark, monkeypatch):
    monkeypatch.setattr(shards, "RUN", 1)
    docs = spark.createDataFrame([(1, "long words " * 20000), (2, "short")], "doc_id long, text string")
    table, total = shards.write_shards(docs, shard=4)
    assert table.count() == -(-total // 4) > spark.sparkContext.defaultParallelism
    parts = sorted((r.seq, bytes(r.ids)) for r in shards.read_slots(table, shard=4).where("id = 1").collect())
    assert b"".join(p for _, p in parts) == shards.token_ids("long words " * 20000, PATH).tobytes()


def test_running_counts_cross_batches():
    rng = np.random.default_rng(1)
    buckets = np.sort(rng.integers(-3, 9, 300)).astype(np.int32)
    ns = rng.integers(1, 5, 300)
    whole = pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(ns), pa.array(ns), pa.array(ns), pa.array([b"x"] * 300)], names=["bucket", "key", "id", "n", "ids"])
    for step in (1, 7, 64, 300):
        got = [r for b in shards.before_in_bucket(whole.slice(at, step) for at in range(0, 300, step)) for r in b.to_pylist()]
        assert [r["before"] for r in got] == [int(ns[:i][buckets[:i] == b].sum()) for i, b in enumerate(buckets)]
    assert list(shards.before_in_bucket(iter([whole.slice(0, 0)]))) == []


def slow_slots(total, key):
    """The permutation one number at a time, in plain integers."""
    half = max(1, (max(1, total - 1).bit_length() + 1) // 2)
    keys = [int.from_bytes(blake2b(f"{key}:{r}".encode(), digest_size=8).digest(), "little") | 1 for r in range(shards.ROUNDS)]
    wide, out = (1 << 64) - 1, []
    for x in range(total):
        while True:
            left, right = x >> half, x & ((1 << half) - 1)
            for k in keys:
                y = (right + k) * 0x9E3779B97F4A7C15 & wide
                y = ((y ^ y >> 29) ^ k) * 0xBF58476D1CE4E5B9 & wide
                left, right = right, left ^ (y >> 32 & ((1 << half) - 1))
            x = left << half | right
            if x < total:
                break
        out.append(x)
    return out


def test_permutation_against_plain_integers():
    for total in (1, 7, 100, 3000):
        assert shards.feistel(np.arange(total), total, "k").tolist() == slow_slots(total, "k")


def test_query_and_empty_table(spark, tmp_path):
    rows, docs = frame(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = shards.op10_shards(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {r[0] for r in rows}
    one = next(r for r in out if r.doc_id == 101)
    assert (one.n_tokens, one.ids_crc32) == (1, zlib.crc32(np.array([shards.END], "<u2").tobytes()))
    table, total = shards.write_shards(docs.limit(0))
    assert total == 0 and shards.read_slots(table).count() == 0
