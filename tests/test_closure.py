import random

import pytest

from graphloom.operators import closure


def graph(case):
    rng = random.Random(case)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range((20, 34, 100)[case])] + [(5, None), (None, 3)]
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)

    def far(start):
        seen, todo = set(), list(after.get(start, ()))
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += after.get(n, ()) if n is not None else ()
        return seen

    return edges, far


def ids(spark, values):
    return spark.createDataFrame([(x,) for x in values], "id long")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("case, few", [(0, 500_000), (1, 500_000), (1, 0), (2, 0)])
def test_reach_against_a_search_from_each_source(spark, monkeypatch, case, few):
    # by one task and by rounds over the whole table; blocks of few nodes
    monkeypatch.setattr(closure, "FEW_EDGES", few)
    monkeypatch.setattr(closure, "BLOCK", 4)
    edges, far = graph(case)
    sources = [*range(0, 30, 2), 99, None, 4]
    got = rows(closure.reach(spark.createDataFrame(edges, "src long, dst long"), ids(spark, sources)))
    assert got == sorted({(a, b) for a in sources if a is not None for b in far(a)}, key=str)


def ring(spark, n):
    return spark.createDataFrame([(k, d) for k in range(n) for d in ((3 * k + 1) % n, (7 * k + 2) % n)], "src long, dst long")


def stored_rows(monkeypatch):
    written, cut = [], closure._cut

    def counted(df):
        out = cut(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(closure, "_cut", counted)
    return written


def test_pairs_of_a_cycle_are_not_stored(spark, monkeypatch):
    n, written = 300, stored_rows(monkeypatch)
    edges = ring(spark, n)
    found = closure.reach(edges, ids(spark, range(n)))
    assert found.count() == found.distinct().count() == n * n
    assert sum(written) < 10 * n


@pytest.mark.parametrize("case, few", [(0, 500_000), (1, 500_000), (2, 0)])
def test_pairs_against_a_search_from_each_source(spark, monkeypatch, case, few):
    monkeypatch.setattr(closure, "FEW_EDGES", few)
    monkeypatch.setattr(closure, "BLOCK", 4)
    edges, far = graph(case)
    sources, sinks = [*range(0, 30, 2), 99, None, 4], [*range(0, 30, 3), 99, 98, None, 6]
    got = rows(closure.reachable_pairs(spark.createDataFrame(edges, "src long, dst long"), ids(spark, sources), ids(spark, sinks)))
    assert got == sorted({(a, b) for a in sources if a is not None for b in far(a) | {a} if b is not None and b in sinks}, key=str)


def test_pairs_are_not_compared_in_a_shuffle(spark, monkeypatch):
    n, written = 300, stored_rows(monkeypatch)
    found = closure.reachable_pairs(ring(spark, n), ids(spark, range(n)), ids(spark, range(0, n, 2)))
    assert found.count() == found.distinct().count() == n * n // 2
    assert sum(written) < 10 * n
    # what is dealt out after the pairs are made would be as many rows
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Generate explode(nodes")].rpartition("Union")[2]
