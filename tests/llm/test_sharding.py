import random
import zlib
from collections import defaultdict

from graphloom.llm import sharding as S


def check(rows, got, shards=24):
    want = sorted((i is None, i, len((t or "").encode()) + 8, None if t is None else zlib.crc32(t.encode())) for i, t, *_ in rows)
    assert sorted((r.doc_id is None, r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots, size = defaultdict(list), defaultdict(int)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return size


def test_sizes_are_nearly_equal(spark):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randrange(0, 400), 1, 2) for i in range(3000)]
    rows += [(5000 + i, "the copied text " * 12, 1, 2) for i in range(1500)]
    rows += [(None, None, 1, 2), (9, "", 1, 2), (9, "", 1, 2), (9999, "é" * 9000, 1, 2)]
    rows += [(7777, "one row again and again " * 8, 1, 2)] * 400
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, size int")
    got = S.shard(df).collect()
    size = check(rows, got)
    mean = sum(size.values()) / 24
    assert len(size) == 24 and max(size.values()) < 1.02 * mean and min(size.values()) > 0.98 * mean


def test_few_rows_and_none(spark):
    rows = [(1, "a"), (2, None), (3, "bbb")]
    check(rows, S.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert S.shard(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_equal_texts_share_a_shard_unless_they_are_too_many(spark):
    rng = random.Random(3)
    rows, total = [], 0
    for g in range(400):
        text = f"group {g} " * rng.randrange(5, 40)
        rows += [(len(rows) + k * 100_000, text) for k in range(rng.choice([1, 1, 2, 3, 9]))]
    rows += [(900_000 + i, "a text that a third of all rows share " * 4) for i in range(len(rows) // 2)]
    got = S.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    size = check(rows, got)
    text_of = dict(rows)
    groups, bytes_of = defaultdict(set), defaultdict(int)
    for r in got:
        groups[text_of[r.doc_id]].add(r.shard)
        bytes_of[text_of[r.doc_id]] += r.size
    total = sum(size.values())
    small = [t for t in groups if bytes_of[t] <= total / 96]
    assert len(small) > 300 and all(len(groups[t]) == 1 for t in small)
    assert max(size.values()) < 1.05 * total / 24 and min(size.values()) > 0.95 * total / 24
