import random
import re

from graphloom.llm import licenses as L


def grams(t):
    w = [x for x in re.split("[^a-z0-9]+", t.lower()) if x]
    return {(a, b) for a, b in zip(w, w[1:])}


def reference(text):
    if text is None:
        return {}
    units = set(text.split("\n")) | {text} | {p for p in re.split(r"\n[ \t\r]*\n", text) if "\n" in p}
    out = {}
    for u in units:
        a = grams(u)
        hit = {}
        for name, t in L.TEMPLATES:
            b = grams(t)
            if a and 2 * len(a & b) / (len(a) + len(b)) >= 0.8:
                hit[name] = max(hit.get(name, 0), 2 * len(a & b) / (len(a) + len(b)))
        for name, d in hit.items():
            n, best = out.get(name, (0, 0))
            out[name] = (n + 1, max(best, d))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(2)
    rows = [(0, None), (1, ""), (2, "license"), (3, "\n\n\n"), (None, L.TEMPLATES[0][1]), (4, "a " * 100000 + "\n" + L.TEMPLATES[4][1])]
    for i, (_, t) in enumerate(L.TEMPLATES * 3):
        w = t.split()
        for _ in range(rng.randrange(0, 1 + len(w) // 6)):
            w[rng.randrange(len(w))] = "changed"
        body = " ".join(w) if i % 2 else "\n".join(" ".join(w[k : k + 9]) for k in range(0, len(w), 9))
        rows.append((10 + i, "Some prose first.\n\n" + body.upper() + "\n\nAnd more of it."))
    rows += [(200, rows[8][1]), (200, rows[8][1])]
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, n int, license string")
    got = {(r.doc_id, r.license): (r.n_units, round(r.dice, 9)) for r in L.scan_licenses(df).collect()}
    want = {(i, k): (n, round(d, 9)) for i, t in rows for k, (n, d) in reference(t).items()}
    assert got == want and len(want) > 20


def test_empty_table(spark):
    assert L.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []
