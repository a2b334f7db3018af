import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import substrings as S


def reference(rows, width=20):
    """First starts of all windows in (id, text) order."""
    seen, out = {}, {}
    docs = sorted({(i, t) for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, t in docs:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            g = tuple(w[p : p + width])
            if seen.setdefault(g, (i, p)) != (i, p):
                gone[p : p + width] = [True] * width
        kept = [x for x, g in zip(w, gone) if not g]
        out[i, t] = (len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def test_matches_brute_force(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(40)] + ["é", "Ab"]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    passages = [text(n) for n in (20, 21, 35, 60, 120, 300)]
    rows = []
    for i in range(150):
        words = text(rng.randrange(0, 90))
        for _ in range(rng.randrange(3)):
            p = list(rng.choice(passages))
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = "odd"
            a = rng.randrange(0, max(1, len(p) - 18))
            at = rng.randrange(0, len(words) + 1)
            words[at:at] = p[a:] if rng.random() < 0.5 else p[: len(p) - a]
        rows.append((i * 2 - 100, rng.choice([" ", "\n", " \t"]).join(words)))
    rows += [(1001, None), (1003, ""), (None, " ".join(passages[3])), (1005, "same " * 3000), (1007, rows[4][1]), (1009, rows[4][1])]
    rows += [(1011, " ".join(text(30) * 3)), (1013, "a b " * 40), (1015, " ".join(["x"] * 19)), (1017, " ".join(["x"] * 20))]
    rows += [rows[7]]
    df = spark.createDataFrame([(i, t, 0, 1) for i, t in rows], "doc_id long, text string, start int, n_words int")
    want = reference(rows)
    got = S.remove_repeats(df).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted((str(i), *want[i, t]) for i, t in rows)
    assert sum(r.n_removed for r in got) > 1000


def check(spark, rows):
    want = reference(rows)
    got = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted((str(i), *want[i, t]) for i, t in rows)
    return got


def test_a_short_line_in_a_third_of_the_documents(spark):
    # 12 words with ever other neighbours: no window repeats but where the neighbours do
    rng = random.Random(11)
    line = [f"l{i}" for i in range(12)]
    text = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    tail = text(15)
    rows = []
    for i in range(300):
        words = text(40)
        if i % 3 == 0:
            words[20:20] = line + (tail if i % 30 == 0 else [])
        rows.append((i, " ".join(words)))
    got = check(spark, rows)
    assert sum(r.n_removed > 0 for r in got) == 9
    docs = spark.createDataFrame([(i, i, t.encode()) for i, t in rows], "doc_id long, text_hash long, text binary")
    assert len(S._frequent(docs, 20, 0)) > 0


def test_keys_of_several_documents_are_noticed(spark, monkeypatch):
    # with the first seed documents share keys: links go to wrong texts, which the digests show
    rng = random.Random(13)
    passage = [f"p{i}" for i in range(80)]
    rows = [(i, " ".join([f"v{rng.randrange(10**6)}" for _ in range(30)] + passage[i % 7 : 70])) for i in range(30)]
    real, seeds = S.key_of, []

    def weak(doc_id, text_hash, seed):
        seeds.append(seed)
        return real(doc_id, text_hash, seed) if seed else F.pmod(doc_id, F.lit(4))

    monkeypatch.setattr(S, "key_of", weak)
    check(spark, rows)
    assert seeds == [0, 1]


def test_paths_cover_all_windows():
    rng = np.random.default_rng(1)
    for n in (20, 21, 57, 400):
        w = rng.integers(0, 5, n).astype(np.uint64)
        _, _, start, count = S.paths(w, 20)
        assert start[0] == 0 and (start[1:] == (start + count)[:-1]).all() and start[-1] + count[-1] == n - 19


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
