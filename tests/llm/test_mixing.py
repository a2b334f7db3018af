import random
import re
from collections import defaultdict

from graphloom.llm import mixing as M


def water_fill(sizes, weights, share, most):
    """Targets by resharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        t = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if t[s] > most * sizes[s]}
        if not over:
            return t | {s: most * sizes[s] for s in capped}
        capped |= over


def test_mix_keeps_its_contract(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        s = rng.choice(["big"] * 6 + ["a", "B", "é", None])
        rows.append((i, " ".join("w" for _ in range(rng.randrange(0, 60))) + rng.choice(["", " ", "\n", " x"]), s, 1))
    rows += [(500, None, "empty", 1), (501, " \t\n", "empty", 1), (None, "a\x0bb\x0cc\rd  e", "a", 1), (3, "dup of an id", "a", 1), (502, "w w " * 20000, "long", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = M.mix(df).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, s, _ in rows:
        sizes[s] += words(t)
    want = water_fill(sizes, (5, 2, 1), 1.5, 2.0)
    assert sorted((r.doc_id is None, r.doc_id, r.size) for r in got) == sorted((i is None, i, words(t)) for i, t, *_ in rows)
    where = {(i, words(t)): s for i, t, s, _ in rows}
    taken, in_shard = defaultdict(int), defaultdict(int)
    for r in got:
        s = where[r.doc_id, r.size]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
        assert sum(r.shard_words) == r.taken and min(r.shard_words) >= 0
        for k, n in enumerate(r.shard_words):
            in_shard[s, k] += n
    block = sum(want.values()) / 24000
    assert all(abs(taken[s] - want[s]) <= block + 1 for s in want)
    # every shard has near to its part of each source's target
    assert all(abs(in_shard[s, k] - want[s] / 24) <= 2 * block + 1 for s in want for k in range(24))
    assert sorted(map(str, got)) == sorted(map(str, M.mix(df).collect()))


def test_sainte_lague(spark):
    rows = [("a", 53.0), ("b", 24.0), ("c", 23.0), (None, 0.0)]
    got = M.quotas(spark.createDataFrame(rows, "source string, target double"), 2, 10).collect()
    given = defaultdict(int)
    votes = {s: t for s, t in rows if t}
    want = defaultdict(int)
    for n in range(20):
        s = max(votes, key=lambda x: (votes[x] / (2 * given[x] + 1), -ord(x)))
        given[s] += 1
        want[s, n // 10] += 1
    assert {(r.source, r.shard): r.quota for r in got} == dict(want)


def test_highest_quotients_beyond_a_sources_share(spark):
    # the small ones' first quotients are below the large one's last
    rows = [("big", 23_600.0)] + [(f"s{i:04}", 0.4) for i in range(1000)]
    got = M.quotas(spark.createDataFrame(rows, "source string, target double"), 24, 1000).groupBy("source").sum("quota").collect()
    assert [tuple(r) for r in got] == [("big", 24_000)]


def test_mixed_documents_repeats_whole_rows(spark):
    rows = [(i, "one two three four", "a" if i < 5 else "b", i) for i in range(40)] + [(99, None, "a", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    out = M.mixed_documents(df)
    assert out.columns == df.columns
    taken = {r.doc_id: r.taken for r in M.mix(df).collect()}
    got = [r.doc_id for r in out.collect()]
    assert all(got.count(i) == int(taken[i] / 4 + 0.5) for i in range(40)) and got.count(99) == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mix(df).collect() == [] and M.mixed_documents(df).collect() == []
    zero = spark.createDataFrame([(1, None, None)], df.schema)
    assert [tuple(r) for r in M.mix(zero).collect()] == [(1, 0, 0, 0.0, 0, [0] * 24)]


def test_small_source_beside_a_huge_one_reaches_its_target(spark):
    rows = [(i, "w " * 100_000, "huge") for i in range(20)] + [(90, "one two three four five six seven", "small"), (91, "w " * 300, "two blocks")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {r.doc_id: (r.taken, r.target) for r in M.mix(df).collect()}
    assert taken[90] == (14, 14.0) and taken[91] == (600, 600.0)
    assert [r.doc_id for r in M.mixed_documents(df).collect()].count(90) == 2
