import hashlib
import re

from graphloom.llm import secrets as S

KEY = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"


def reference(text):
    """The contract, word by word: find all, then drop failing matches."""
    out = []
    for m in re.finditer(
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        text,
    ):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    for k, pattern, least in ((1, r"AKIA[A-Z0-9]+", 20), (2, r"[0-9a-f]+", 24)):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_spans_and_ownership(spark):
    loose = "Zk3" + "q9XbT7mLw2RcV5nYd8Hs"
    texts = [
        f'é Token = "{KEY}" end', f"API_KEY: '{KEY}'", f"secret:token='{'a' * 5}' passwd= ok12345", "AKIA" + "A1B2" * 4,
        "AKIA" + "A" * 15, "f" * 24 + " " + "f" * 23, "toKen=abcdefgh", f"see {loose} here", "token=AKIA" + "Z9" * 10,
        "password = = abcdefgh", "", None, "x" * 200000 + " secret=abc123def", f"see {loose} here",
    ]
    rows = [(i, t, f"s{i % 4}", 1) for i, t in enumerate(texts)]
    rows += [(100 + i, "token=commonexample1 copied", f"s{i}", 1) for i in range(5)] + [(None, "hex " + KEY, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, spans int")
    got = {(r.doc_id, r.spans): r for r in S.scan_secrets(df).collect()}
    assert len(got) == len(rows)
    for i, t, _, _ in rows:
        r = next(v for k, v in got.items() if k[0] == i)
        base = reference(t or "")
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert ",".join(s for s in r.spans.split(",") if not s.startswith("owned")) == base
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(base.count(k + ":") for k in S.KINDS[:3])
    assert all(r.n_example == 1 and r.n_live == 0 for (i, _), r in got.items() if i and i >= 100)
    # the loose token is held by two owners (7 and 13 are of s3 and s1): not owner-specific
    assert next(r for (i, _), r in got.items() if i == 7).n_owned == 0
    alone = spark.createDataFrame(rows[:8], df.schema)
    r = next(r for r in S.scan_secrets(alone).collect() if r.doc_id == 7)
    assert r.n_owned == 1 and r.spans == f"owned:4:{4 + len(loose)}"


def test_empty_table(spark):
    assert S.scan_secrets(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


def test_ownership_matches_a_plain_count(spark):
    import random
    from collections import defaultdict

    rng = random.Random(4)
    sign = "abcdefghkmnpqrstABCDEFGHKMNPQR23456789"
    values = ["".join(rng.choice(sign) for _ in range(28)) + "7Q" for _ in range(12)]
    rows = []
    for i in range(120):
        v = rng.choice(values[: rng.randrange(1, 13)])
        text = rng.choice(["see {} now", "token={} and {}", "secret: '{}'", "none here"]).replace("{}", v)
        rows.append((i, text, rng.choice(["s1", "s1", "s2", "s3", None])))
    rows.append((5, rows[5][1], rows[5][2]))
    repos, owners = defaultdict(set), defaultdict(set)
    held = []
    for i, t, s in rows:
        base = S.base_spans(t)
        held.append((base, S.loose_spans(t, base)))
        for _, _, _, v in held[-1][0] + held[-1][1]:
            owners[v].add(s or "")
            repos[v].add((s or "", str(i)))
    live = lambda v: S.looks_random(v) and len(owners[v]) == 1 and len(repos[v]) <= 5
    want = []
    for (i, *_), (base, loose) in zip(rows, held):
        spans = sorted((a, k, b) for k, a, b, v in base + [x for x in loose if live(x[3])])
        want.append((i, ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in spans), sum(len(owners[v]) >= 3 for *_, v in base), sum(live(v) for *_, v in base)))
    got = S.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((r.doc_id, r.spans, r.n_example, r.n_live) for r in got) == sorted(want)
    assert any(w[2] for w in want) and any(w[3] for w in want) and any("owned" in w[1] for w in want)


def test_loose_spans_touch_no_base_span():
    base = [(0, 10, 20, "x"), (2, 12, 40, "y"), (1, 50, 60, "z")]
    for start in range(0, 70):
        for end in range(start + 20, 75):
            text = " " * start + "a1" * ((end - start) // 2) + "a" * ((end - start) % 2) + " "
            assert bool(S.loose_spans(text, base)) == all(end <= b[1] or b[2] <= start for b in base)
