import random

import numpy as np

from graphloom.llm import simhash as S


def brute(fps: list[int], budget: int) -> list[int]:
    """Smallest index reachable, by comparing all pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_trie_links_span_the_same_components():
    rng = random.Random(7)
    for size in (1, 2, 50, 400):
        base = [rng.getrandbits(64) for _ in range(size)]
        near = [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) for b in base for _ in range(3)]
        values = np.unique(np.array(base + near, dtype=np.uint64))
        found = S.trie_links(values, [(0, len(values), 0, len(values), 0, 0)], 3)
        root = list(range(len(values)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for i, j in found:
            assert (int(values[i]) ^ int(values[j])).bit_count() <= 3
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
        assert [find(i) for i in range(len(values))] == brute([int(v) for v in values], 3)


def test_query_matches_brute_force(spark, tmp_path):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        words = [rng.choice(vocab) for _ in range(rng.randrange(0, 80))]
        rows.append((i * 3, " ".join(words)))
        if words and i % 3 == 0:
            words[rng.randrange(len(words))] = "Changed"
            rows.append((i * 3 + 1, "\t".join(words)))
    rows += [(500, None), (501, ""), (502, "one two"), (503, "ONE two"), (500, None), (None, "x"), (600, "long " * 30000)]
    df = spark.createDataFrame([(i, t, "fp", 1) for i, t in rows], "doc_id long, text string, fp string, first int")
    got = sorted(map(tuple, S.simhash_components(df).collect()), key=str)
    fps = [S.fingerprint(None if t is None else t.encode(), 3) for _, t in rows]
    comp = brute(fps, 3)
    ids: dict[int, int] = {}
    for (i, _), c in zip(rows, comp):
        if i is not None:
            ids[c] = min(ids.get(c, i), i)
    want = sorted([(i, f"{f:016x}", ids.get(c)) for (i, _), f, c in zip(rows, fps, comp)], key=str)
    assert got == want


def test_empty_table(spark):
    assert S.simhash_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def near_rows():
    rng = random.Random(12)
    vocab = [f"{a}{b}" for a in ("er", "th", "an", "ou", "in", "re") for b in ("tion", "ly", "ed", "st", "ing", "ble", "x", "q")]
    rows, group = [], {}
    for g in range(25):
        base = [rng.choice(vocab) + rng.choice(["", ",", "."]) for _ in range(rng.randrange(120, 400))]
        for k in range(rng.randrange(1, 6)):
            words = list(base)
            for _ in range(len(words) // 100 * (k > 0)):
                words[rng.randrange(len(words))] = "edit" + str(rng.randrange(9))
            group[len(rows)] = g
            rows.append((len(rows), " ".join(words)))
    return rows, group


def test_near_duplicates_are_found_and_clean_texts_stay(spark):
    rows, group = near_rows()
    sets = [set(S.shingles_of(S.words_of(t.encode()), 5)) for _, t in rows]
    extra = [(900, rows[0][1], "x"), (900, rows[0][1], "x"), (901, None, "x"), (902, "", "x"), (903, "two words", "x"), (904, "words two", "x"), (None, rows[3][1], "x")]
    df = spark.createDataFrame([(*r, "x") for r in rows] + extra, "doc_id long, text string, fp string")
    found = {r.doc_id: r.group for r in S.near_duplicate_groups(df).collect()}
    similar = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    assert len(similar) > 30 and sum(found[i] == found[j] for i, j in similar) >= 0.95 * len(similar)
    # every group is held together by links of at least the similarity
    for i, _ in rows:
        mates = [j for j, _ in rows if j != i and found[i] == found[j]]
        assert not mates or any((max(i, j), min(i, j)) in set(similar) for j in mates)
    kept = S.drop_near_duplicates(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {901, 903, 904} <= set(ids) and not {900, 902, None} & set(ids)
    first = {}
    for i, _ in rows:
        first.setdefault(found[i], i)
    assert set(ids) == set(first.values()) | {901, 903, 904}


def groups_by_brute_force(texts, similarity=0.8):
    sets = [set(S.shingles_of(S.words_of(t.encode()), 5)) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    similar = 0
    for i in range(len(texts)):
        for j in range(i):
            either = len(sets[i] | sets[j])
            if not either or len(sets[i] & sets[j]) / either >= similarity:
                similar += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], similar


def partition(labels):
    out = {}
    for i, g in enumerate(labels):
        out.setdefault(g, set()).add(i)
    return sorted(map(sorted, out.values()))


def test_groups_are_whole_where_a_candidate_fails(spark):
    # many copies around each base, so that most links of a forest or star are below the similarity
    rng = random.Random(31)
    vocab = [f"v{i}" for i in range(400)]
    texts = []
    for _ in range(6):
        base = [rng.choice(vocab) for _ in range(150)]
        for _ in range(40):
            words = list(base)
            for _ in range(rng.randrange(1, 7)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            texts.append(" ".join(words))
    want, similar = groups_by_brute_force(texts)
    assert similar > 200
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.group for r in S.near_duplicate_groups(df).collect()}
    assert partition([found[i] for i in range(len(texts))]) == partition(want)


def test_pairs_at_the_border_of_the_similarity(spark):
    # a run of words is replaced, which moves many bits of a fingerprint of words and few shingles
    rng = random.Random(32)
    texts = []
    for _ in range(40):
        base = [f"u{rng.randrange(3000)}" for _ in range(rng.randrange(180, 260))]
        for run in (0, len(base) // 12, len(base) // 11, len(base) // 9):
            at = rng.randrange(len(base) - run)
            texts.append(" ".join(base[:at] + [f"x{rng.randrange(3000)}" for _ in range(run)] + base[at + run :]))
    want, similar = groups_by_brute_force(texts)
    assert 40 <= similar
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.group for r in S.near_duplicate_groups(df).collect()}
    assert partition([found[i] for i in range(len(texts))]) == partition(want)


def test_drop_near_duplicates_on_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, fp string, root long")
    assert S.drop_near_duplicates(df).collect() == [] and S.drop_near_duplicates(df).columns == df.columns


def test_links_of_large_subtrees(spark, monkeypatch):
    # every subtree is too large at first, so all are dealt out by the blocks of their remaining bits
    monkeypatch.setattr(S, "SUBTREE", 20)
    rng = random.Random(21)
    top = 0xABCD << 48
    values = sorted({top | rng.getrandbits(48) for _ in range(60)})
    values += [v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in values[::2]]
    values = sorted(set(values))
    signed = [v - (1 << 64) * (v >> 63) for v in values]
    found = S.links(spark.createDataFrame([(v,) for v in signed], "fp long"), 3).collect()
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    place = {v: i for i, v in enumerate(signed)}
    for r in found:
        assert ((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 3
        a, b = find(place[r.a]), find(place[r.b])
        root[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(values))] == brute(values, 3)


def test_cells_bound_what_two_sets_share():
    rng = random.Random(5)
    for _ in range(50):
        words = [f"w{rng.randrange(200)}" for _ in range(rng.randrange(0, 300))]
        other = [w if rng.random() < 0.9 else "x" for w in words]
        a, b = (S.shingle_set(" ".join(w).encode(), 5) for w in (words, other))
        both = len(np.intersect1d(a, b))
        most = np.minimum(*(np.frombuffer(S.cells_of(x), dtype=np.uint8) for x in (a, b))).sum()
        assert both <= most <= min(len(a), len(b))
    assert S.cells_of(np.arange(0, 256 * 300, 256, dtype=np.uint64)) is None


def test_pairs_left_by_the_stars_are_tried_in_waves(spark, monkeypatch):
    # near copies whose fingerprints differ too much for the trie: the first wave joins them, so few of their pairs are tried
    monkeypatch.setattr(S, "STAR_ROUNDS", 0)
    rng = random.Random(41)
    base = [f"b{rng.randrange(5000)}" for _ in range(300)]
    texts = []
    for i in range(80):
        at = rng.randrange(290)
        texts.append(" ".join(base[:at] + [f"e{i}x{k}" for k in range(6)] + base[at + 6 :]))
    texts += texts[:5]
    want, similar = groups_by_brute_force(texts)
    assert similar > 2500
    tried, stored = [], S.Stored

    def counted(df, label):
        out = stored(df, label)
        if label == "near-pairs":
            tried.append(out.df.count())
        return out

    monkeypatch.setattr(S, "Stored", counted)
    found = {r.doc_id: r.group for r in S.near_duplicate_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert partition([found[i] for i in range(len(texts))]) == partition(want)
    assert sum(tried) < 1200
