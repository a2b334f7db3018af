import random

from graphloom.llm import decontam as D


def norm(t):
    import regex

    return [w for w in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if w]


def grams(words, k):
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def test_matches_brute_force(spark):
    rng = random.Random(11)
    vocab = [f"v{i}" for i in range(300)] + ["Été", "Señor"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 5, 9, 30, 60])))) for i in range(25)]
    items += [(90, None), (91, "..."), (92, items[3][1]), (None, items[4][1]), (93, "to be"), (3, items[3][1])]
    docs = []
    for i in range(80):
        words = [rng.choice(vocab) for _ in range(rng.randrange(0, 200))]
        if i % 2:
            part = rng.choice(items[:25])[1].split()
            for _ in range(rng.randrange(3)):
                part[rng.randrange(len(part))] = "edited"
            cut = rng.randrange(0, max(1, len(part) // 5 + 1))
            words[10:10] = part[cut:]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(words), 1, 2))
    docs += [(200, None, 1, 2), (201, "", 1, 2), (None, items[5][1], 1, 2), (202, "To BE!", 1, 2), (202, "To BE!", 1, 2), (203, "z " * 50000 + items[6][1], 1, 2)]
    d = spark.createDataFrame(docs, "doc_id long, text string, h int, item int")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for i, t, *_ in docs:
        for j, u in items:
            words = norm(u)
            if words:
                k = min(5, len(words))
                s, has = grams(words, k), grams(norm(t), k)
                if len(s & has) / len(s) >= 0.8 - 1e-9:
                    want[i, j] = max(want.get((i, j), (0, 0)), (len(s & has), len(s)))
    got = {(r.doc_id, r.item_id): (r.n_shared, r.n_item) for r in D.contained_items(d, b).collect()}
    assert got == want
    bad = {i for i, _ in want}
    kept = D.drop_contaminated(d, b)
    assert kept.columns == d.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == sorted((i is None, i) for i, *_ in docs if i not in bad)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert D.contained_items(d.limit(0), b).collect() == []
    assert D.contained_items(d, b.limit(0)).collect() == []
    assert D.contained_items(d, b).collect()[0].containment == 1.0


def test_drop_contaminated_on_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert D.drop_contaminated(d.limit(0), b).collect() == []
    assert [r.doc_id for r in D.drop_contaminated(d, b.limit(0)).collect()] == [1]
