import numpy as np

from graphloom.llm import ann as A


def brute(ids, x, k, every):
    out = {}
    for i, q in zip(ids, x):
        if i % every == 0:
            best = {}
            for j, v in zip(ids, x):
                if j != i:
                    best[j] = max(best.get(j, -np.inf), float(v @ q))
            out[i] = sorted(best.items(), key=lambda b: (-b[1], b[0]))[:k]
    return out


def test_recall_scores_and_edges(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 16)) * rng.uniform(0.2, 3, (3000, 1))
    x[100:140] = x[100]
    ids = list(range(3000))
    nan = float("nan")
    rows = [(i, v.tolist(), 1) for i, v in zip(ids, x)]
    rows += [(None, [1.0] * 16, 1), (4000, None, 1), (4020, [0.0] * 16, 1), (4040, [nan] * 16, 1), (4060, [None] + [1.0] * 15, 1), (4080, [1.0] * 3, 1), (7, x[7].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = A.nearest(df, sample=1000).collect()
    want = brute(ids, x, 20, 20)
    by_query = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by_query.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert abs(r.score - float(x[r.query_id] @ x[r.vec_id])) < 1e-9 and r.vec_id != r.query_id
    assert by_query.keys() == want.keys()
    hit = [len({a for a, _ in by_query[q]} & {a for a, _ in want[q]}) / 20 for q in want]
    assert np.mean(hit) >= 0.9
    for found in by_query.values():
        assert len(found) == 20 and found == sorted(found, key=lambda b: (-b[1], b[0]))


def test_few_candidates_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 1.0]), (2, [0.5, -1.0])], schema)
    assert [tuple(r) for r in A.nearest(df).orderBy("rank").collect()] == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    assert A.nearest(spark.createDataFrame([], schema)).collect() == []


def test_every_query_gets_k_rows_where_few_leaves_are_taken(spark):
    x = np.random.default_rng(9).normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in A.nearest(df, recall=0.01, leaf=8).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert found.keys() == {i for i in range(0, 2000, 20)}
    for q, rows in found.items():
        assert [r for r, _, _ in sorted(rows)] == list(range(1, 21)) and len({v for _, v, _ in rows}) == 20
        assert all(abs(s - x[q] @ x[v]) < 1e-9 for _, v, s in rows)


def test_repeated_ids_take_one_place_each(spark, monkeypatch):
    monkeypatch.setattr(A, "PART", 16)  # leaves over several blocks
    rng = np.random.default_rng(10)
    x = rng.normal(size=(300, 8))
    ids = list(range(300))
    # id 1 stands 25 times beside query 0, with other vectors; id 3 twice, the worse first
    more = [(1, x[0] * f) for f in np.linspace(0.1, 2.4, 25)] + [(3, -x[0]), (3, x[0] * 1.5), (20, x[20]), (20, x[21])]
    rows = [(i, v.tolist()) for i, v in [*zip(ids, x), *more]]
    got = {}
    for r in A.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), recall=1.0, leaf=12).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    every = [*zip(ids, x), *more]
    for q in range(0, 300, 20):
        best = {}
        for i, v in every:
            if i == q:
                for j, w in every:
                    if j != q:
                        best[j] = max(best.get(j, -np.inf), float(v @ w))
        want = sorted(best.items(), key=lambda b: (-b[1], b[0]))[:20]
        found = [(v, s) for _, v, s in sorted(got[q])]
        assert len(found) == 20 and len({v for v, _ in found}) == 20
        assert len({v for v, _ in found} & {v for v, _ in want}) >= 18
        assert found == sorted(found, key=lambda b: (-b[1], b[0]))
    assert [v for _, v, _ in sorted(got[0])][:2] == [1, 3]
