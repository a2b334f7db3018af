import random
import tracemalloc
import zlib

import numpy as np

from graphloom.llm import langid as L


def rows(n=400):
    rng = random.Random(6)
    vocab = {"en": ["the", "thing", "with", "wh", "eating"], "de": ["der", "schön", "nicht", "über", "keit"], "fr": ["le", "été", "eaux", "que", "tion"]}
    out = []
    for i in range(n):
        lang = rng.choice(list(vocab))
        out.append((i, " ".join(rng.choice(vocab[lang]) for _ in range(rng.randrange(3, 60))), lang, "x"))
    return out


def test_held_out_accuracy_and_edges(spark):
    data = rows()
    extra = [(1000, None, "en", "x"), (1001, "", "en", "x"), (1002, "123 *** 456", "fr", "x"), (None, "the thing with", None, "x"),
             (1003, "über " * 50000, "de", "x"), (1004, "𝒶𝒷", "en", "x"), (1004, "𝒶𝒷", "en", "x")]
    df = spark.createDataFrame(data + extra, "doc_id long, text string, lang string, score string")
    got = L.identify(df).collect()
    assert len(got) == len(data) + len(extra)
    by_id = {r.doc_id: r for r in got}
    for i, *_ in data + extra:
        assert by_id[i].held_out == (zlib.crc32(b"" if i is None else str(i).encode()) % 3 == 1)
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (1000, 1001, 1002))
    assert by_id[None].lang_pred == "en" and by_id[1003].lang_pred == "de"
    tested = [(by_id[i].lang_pred, lang) for i, _, lang, _ in data if by_id[i].held_out]
    assert len(tested) > 80 and sum(a == b for a, b in tested) >= 0.98 * len(tested)
    assert all(0 <= r.score <= 1 for r in got)
    kept = L.identified(df, 0.4)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {i for i, *_ in data}


def test_labels_of_held_out_rows_do_not_matter(spark):
    data = rows(150)
    out = [zlib.crc32(str(i).encode()) % 3 == 1 for i, *_ in data]
    wrong = [(i, t, "zz" if h else n, s) for (i, t, n, s), h in zip(data, out)]
    schema = "doc_id long, text string, lang string, source string"
    a = L.train(spark.createDataFrame(data, schema))
    b = L.train(spark.createDataFrame(wrong, schema))
    assert a.languages == b.languages and np.allclose(a.weights, b.weights)


def test_nothing_to_learn(spark):
    schema = "doc_id long, text string, lang string"
    assert L.identify(spark.createDataFrame([], schema)).collect() == []
    got = L.identify(spark.createDataFrame([(1, "text", None)], schema)).first()
    assert (got.lang_pred, got.score) == ("und", 0.0)


def test_features_match_a_plain_count():
    rng = random.Random(7)
    for n in (0, 1, 2, 3, 40, 900):
        text = "".join(rng.choice("aBcé ß日\U00010400.1") for _ in range(n))
        chars = [ord(c) if c.isalpha() else 32 for c in text.lower()]
        want, m = [0] * L.FEATURES, 0xFFFFFFFF
        for k in range(1, 4):
            for i in range(len(chars) - k + 1):
                h = chars[i] * 0x9E3779B1 & m
                for j in range(1, k):
                    h = ((h ^ (h >> 15)) * 0x85EBCA6B + chars[i + j] * 0xC2B2AE35 + j) & m
                want[((h ^ (h >> 13)) * 0x27D4EB2F & m) >> 18] += 1
        assert L.counts(L.letters(text)).tolist() == want


def test_prediction_matches_a_dense_product():
    rng = np.random.default_rng(2)
    model = L.Model(["a", "b", "c"], rng.uniform(0.1, 3, L.FEATURES), rng.normal(size=(L.FEATURES, 3)), rng.normal(size=3), 0.7)
    for text in ("the thing", "x", "über alles " * 50):
        v = np.log1p(L.counts(L.letters(text))) * model.idf
        p = L.softmax((v / np.linalg.norm(v) @ model.weights + model.bias) / 0.7)
        lang, score = model.predict(text)
        assert lang == model.languages[int(p.argmax())] and abs(score - p.max()) < 1e-12


def test_fit_matches_plain_updates():
    # one pass coordinate by coordinate, the order and the kept-apart part drawn alike
    rng = np.random.default_rng(3)
    idf = rng.uniform(0.5, 2, L.FEATURES)
    rows_ = [(int(rng.integers(2)), np.sort(rng.choice(30, 5, replace=False)), rng.uniform(0.5, 2, 5)) for _ in range(25)]
    model = L.fit(["a", "b"], idf, rows_, seed=1)
    draw = np.random.default_rng(1)
    order = draw.permutation(25)
    z, n = {}, {}

    def weight(j, k):
        zz = z.get((j, k), 0.0)
        if abs(zz) <= L.L1:
            return 0.0
        return -(zz - np.sign(zz) * L.L1) / ((L.BETA + np.sqrt(n.get((j, k), 0.0))) / L.ALPHA + L.L2)

    for _ in range(L.EPOCHS):
        for i in draw.permutation(order[5:]):
            y, at, tf = rows_[i]
            x = tf * idf[at]
            x = [*(x / np.linalg.norm(x)), 1.0]
            js = [*at.tolist(), L.FEATURES]
            w = {(j, k): weight(j, k) for j in js for k in range(2)}
            e = np.exp([sum(w[j, k] * v for j, v in zip(js, x)) for k in range(2)])
            p = e / e.sum()
            for j, v in zip(js, x):
                for k in range(2):
                    g = (p[k] - (k == y)) * v
                    old = n.get((j, k), 0.0)
                    z[j, k] = z.get((j, k), 0.0) + g - (np.sqrt(old + g * g) - np.sqrt(old)) / L.ALPHA * w[j, k]
                    n[j, k] = old + g * g
    want = np.array([[weight(j, k) for k in range(2)] for j in range(30)])
    assert np.allclose(model.weights[:30], want) and np.allclose(model.bias, [weight(L.FEATURES, k) for k in range(2)])


def test_identified_on_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, score string")
    assert L.identified(df, 0.3).collect() == [] and L.identified(df, 0.3).columns == df.columns


def test_fit_holds_little_besides_its_rows():
    # the driver's memory is scarce: weighted copies of all rows would be 16 bytes a feature
    rng = np.random.default_rng(4)
    idf = rng.uniform(0.5, 2, L.FEATURES)
    own = [(i % 2, np.sort(rng.choice(L.FEATURES, 2000, replace=False)).astype(np.int16), rng.uniform(0.5, 2, 2000).astype(np.float32)) for i in range(600)]
    tracemalloc.start()
    try:
        L.fit(["a", "b"], idf, own)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < sum(at.nbytes + tf.nbytes for _, at, tf in own)


def test_train_holds_little_on_the_driver(spark):
    rng = random.Random(8)
    data = [(i, "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(500)), "ab"[i % 2]) for i in range(1000)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    tracemalloc.start()
    try:
        model = L.train(df)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert model.languages == ["a", "b"] and peak < 12_000_000
