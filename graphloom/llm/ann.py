"""Approximate nearest neighbours by a forest of random-projection trees.

Largest inner product becomes nearest direction by one more component,
sqrt(M^2 - |x|^2) with M the largest norm (0 for queries).  Trees are fit on a
bounded sample: a node's hyperplane lies midway between two random points.  All
vectors are then routed to a leaf of every tree.  A query walks all trees
through one shared priority queue, the node with the largest least margin first,
until it has taken its number of leaves, and the candidates of those leaves are
reranked by exact inner products.

How many leaves a query takes is measured, not fixed: the exact neighbours of
CALIBRATION queries are found by one pass over all vectors, and the forest is
asked at which leaf of the walk it meets them.  Clustered vectors need few
leaves; vectors without structure in many dimensions need a large share of all
leaves at any size of the table, as every index does.

Leaves are put together in blocks of about ``PART`` vectors, the groups of the
join: a query's vector goes to a block once, with the leaves it takes there.  A
leaf of more vectors (many equal ones, say) is dealt over several blocks and its
queries go to each.  A block returns at most k rows a query, and only scores
that can reach the k best: not below the k-th best score of the sample vectors
in the query's own leaves, which are among its candidates.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import Stored

#: Vectors the trees are fit on, trees, sample vectors in a leaf, vectors in a block.
SAMPLE, TREES, LEAF, PART = 16_384, 10, 48, 4_096
#: Queries that set the number of leaves, and the part of their neighbours that the leaves must hold.
CALIBRATION, RECALL = 100, 0.95


class Forest:
    """Trees as arrays: a node's normal, offset and children; child -1-i is leaf i."""

    def __init__(self, sample: np.ndarray, trees: int, leaf: int, seed: int = 42):
        self.top = float(np.sqrt((sample**2).sum(1).max())) if len(sample) else 1.0
        points = self.lift(sample)
        rng = np.random.default_rng(seed)
        normals, offsets, children, self.roots = [], [], [], []
        self.leaves = 0

        def grow(own: np.ndarray) -> int:
            for _ in range(3 if len(own) > leaf else 0):
                a, b = points[rng.choice(own, 2, replace=False)]
                normal = a - b
                length = np.linalg.norm(normal)
                if length == 0:
                    continue
                normal /= length
                offset = -float(normal @ (a + b)) / 2
                side = points[own] @ normal + offset > 0
                if 0.05 < side.mean() < 0.95:
                    at = len(normals)
                    normals.append(normal)
                    offsets.append(offset)
                    children.append([0, 0])
                    children[at] = [grow(own[~side]), grow(own[side])]
                    return at
            self.leaves += 1
            return -self.leaves

        for _ in range(trees):
            self.roots.append(grow(np.arange(len(points))))
        dim = points.shape[1]
        self.normals = np.array(normals).reshape(-1, dim)
        self.offsets, self.children = np.array(offsets), np.array(children, dtype=np.int64).reshape(-1, 2)

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.top**2 - (x**2).sum(1), 0)
        return np.hstack([x, np.sqrt(rest)[:, None]])

    def route(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree, shape (trees, vectors)."""
        points = self.lift(x)
        out = np.empty((len(self.roots), len(x)), dtype=np.int64)
        for t, root in enumerate(self.roots):
            node = np.full(len(x), root, dtype=np.int64)
            while (inner := np.flatnonzero(node >= 0)).size:
                at = node[inner]
                side = np.einsum("ij,ij->i", points[inner], self.normals[at]) + self.offsets[at] > 0
                node[inner] = self.children[at, side.astype(int)]
            out[t] = -1 - node
        return out

    def walk(self, query: np.ndarray) -> Iterator[int]:
        """All leaves in the order of a priority queue that the trees share."""
        lifted = np.append(query / (np.linalg.norm(query) or 1.0) * self.top, 0.0)
        margins = (self.normals @ lifted + self.offsets).tolist() if len(self.normals) else []
        queue = [(-np.inf, r) for r in self.roots]
        heapq.heapify(queue)
        children = self.children.tolist()
        while queue:
            bound, node = heapq.heappop(queue)
            if node < 0:
                yield -1 - node
                continue
            m = margins[node]
            low, high = children[node]
            heapq.heappush(queue, (max(bound, m), low))
            heapq.heappush(queue, (max(bound, -m), high))


class Sample:
    """The vectors the forest was fit on, with their leaves."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, forest: Forest):
        self.ids, self.points = ids, points
        self.leaf = forest.route(points)
        self.within = [set() for _ in range(forest.leaves)]
        for own in self.leaf:
            for i, n in zip(ids.tolist(), own.tolist()):
                self.within[n].add(i)

    def leaves(self, forest: Forest, own: int, query: np.ndarray, probes: int, k: int) -> list[int]:
        """``probes`` leaves of the walk, and more until they hold k ids other than the query's."""
        out, met = [], set()
        for leaf in forest.walk(query):
            if len(out) >= probes and len(met) >= k:
                break
            out.append(leaf)
            if len(met) < k:
                met |= self.within[leaf] - {own}
        return out

    def least(self, taken: list[int], own: int, query: np.ndarray, k: int) -> float:
        """k-th best score, over distinct ids, of the sample's vectors in these leaves; -inf with fewer."""
        mark = np.zeros(len(self.within), dtype=bool)
        mark[taken] = True
        here = np.flatnonzero(mark[self.leaf].any(0) & (self.ids != own))
        # ids ascend: rows that share one are side by side
        first = np.flatnonzero(np.append(True, self.ids[here][1:] != self.ids[here][:-1])) if len(here) else here
        if len(first) < k:
            return -np.inf
        best = np.maximum.reduceat(self.points[here] @ query, first)
        least = float(np.partition(best, len(best) - k)[len(best) - k])
        return least - 1e-9 * (1 + abs(least))  # another order of summation loses nothing


def probes_for(rows: DataFrame, queries: DataFrame, forest: Forest, k: int, recall: float) -> int:
    """Leaves a query must take so that ``recall`` of the calibration queries' neighbours lie in them."""
    asked = queries.orderBy(F.xxhash64("vec_id"), "v").limit(CALIBRATION).toPandas()
    own, q = asked["vec_id"].to_numpy(), np.array(asked["v"].tolist(), dtype=np.float64)
    if not len(own):
        return 0
    shared = rows.sparkSession.sparkContext.broadcast((own, q))  # CALIBRATION rows

    def exact(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, q = shared.value
        for pdf in frames:
            x, ids = np.array(pdf["v"].tolist(), dtype=np.float64).reshape(-1, q.shape[1]), pdf["vec_id"].to_numpy()
            scores = np.where(ids[None, :] != own[:, None], q @ x.T, -np.inf)
            near = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            r = np.repeat(np.arange(len(own)), near.shape[1])
            c = near.ravel()
            yield pd.DataFrame({"query": r, "vec_id": ids[c], "score": scores[r, c], "v": pdf["v"].iloc[c].to_numpy()})

    found = rows.mapInPandas(exact, "query int, vec_id long, score double, v array<double>").where("score > double('-inf')")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).toPandas()  # k a query
    if not len(best):
        return 0
    at = forest.route(np.array(best["v"].tolist(), dtype=np.float64))
    turns = []
    for i in range(len(own)):
        place = np.empty(forest.leaves, dtype=np.int64)
        order_ = list(forest.walk(q[i]))
        place[order_] = np.arange(len(order_))
        turns.append(place[at[:, (best["query"] == i).to_numpy()]].min(0))
    all_turns = np.sort(np.concatenate(turns))
    return int(all_turns[min(len(all_turns) - 1, int(np.ceil(recall * len(all_turns))))]) + 1


def nearest(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, every: int = 20,
    recall: float = RECALL, trees: int = TREES, sample: int = SAMPLE, leaf: int = LEAF,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest found of every query row.

    Queries are the rows whose id is divisible by ``every``, against all rows
    but their own.  Defined results: null, zero and non-finite vectors, vectors
    with null components and null ids take no part; nor do vectors whose length
    isn't the most frequent one (of equally frequent ones the longer); rows that
    share an id are one candidate with its best score, and one query with its
    best scores; ties go to the smaller id; a query goes on until its leaves
    hold k candidates, so it has fewer neighbours only if the table has fewer
    other ids; an empty table gives an empty result; other columns are not read.
    The forest is fit on about ``sample`` vectors, at most twice as many.
    """
    spark = df.sparkSession
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()
    ).where(~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if sizes is None:
        return none
    dim, many = sizes
    rows = Stored(rows.where(F.size("v") == dim), "vectors").df
    uniform = F.shiftrightunsigned(F.xxhash64("vec_id", "v"), 11) / float(1 << 53)
    drawn = rows.where(uniform < sample / many).select("vec_id", "v").toPandas()  # about `sample` rows
    drawn = drawn.sort_values("vec_id", kind="stable").head(2 * sample)
    points = np.array(drawn["v"].tolist(), dtype=np.float64).reshape(-1, dim)
    forest = Forest(points, trees, leaf)
    # the largest norm of all vectors, not only of the sample
    forest.top = float(rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0])
    queries = rows.where(F.col("vec_id") % every == 0)
    probes = probes_for(rows, queries, forest, k, recall)
    shared = spark.sparkContext.broadcast((forest, Sample(drawn["vec_id"].to_numpy(), points, forest)))  # bounded by sample, trees and leaf

    def leaves(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
        own = shared.value[0]
        for pdf in frames:
            if len(pdf):
                yield pdf, own.route(np.array(pdf["v"].tolist(), dtype=np.float64).reshape(-1, dim))

    counted = rows.mapInPandas(lambda frames: (pd.DataFrame({"leaf": at.ravel()}) for _, at in leaves(frames)), "leaf long")
    in_leaf = np.zeros(forest.leaves, dtype=np.int64)
    for n, c in counted.groupBy("leaf").count().collect():  # one row for each leaf
        in_leaf[n] = c
    parts = np.maximum(1, -(-in_leaf // PART))
    block = np.zeros(forest.leaves, dtype=np.int64)  # a leaf's first block
    at, filled = 0, 0
    for n in range(forest.leaves):
        if filled and (filled + in_leaf[n] > PART):
            at, filled = at + 1, 0
        block[n] = at
        filled += in_leaf[n]
        if parts[n] > 1:
            at, filled = at + int(parts[n]), 0

    def dealt(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, where in leaves(frames):
            ids = pdf["vec_id"].to_numpy()
            mark = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
            packed = [np.asarray(v, dtype=np.float64).tobytes() for v in pdf["v"]]
            for own in where:
                yield pd.DataFrame({"block": block[own] + mark % parts[own], "leaf": own, "vec_id": ids, "v": packed})

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, known = shared.value
        for pdf in frames:
            for i, v in zip(pdf["vec_id"], pdf["v"]):
                q = np.asarray(v, dtype=np.float64)
                taken = np.array(known.leaves(own, i, q, probes, k), dtype=np.int64)
                least = known.least(taken, i, q, k)
                taken = taken[in_leaf[taken] > 0]
                wide = parts[taken]
                taken = np.repeat(taken, wide)
                to = block[taken] + np.arange(len(taken)) - np.repeat(np.cumsum(wide) - wide, wide)
                order = np.argsort(to, kind="stable")
                to, taken = to[order], taken[order]
                first = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else to
                lists = [x.astype(np.int32).tobytes() for x in np.split(taken, first[1:])] if len(to) else []
                yield pd.DataFrame({"block": to[first], "query_id": i, "q": [q.tobytes()] * len(first), "least": least, "leaves": lists})

    def rerank(key: tuple, vecs: pd.DataFrame, wants: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [np.empty(0, np.int64)], "vec_id": [np.empty(0, np.int64)], "score": [np.empty(0)]}
        if len(vecs) and len(wants):
            order = np.argsort(vecs["leaf"].to_numpy(), kind="stable")
            leaf, ids = vecs["leaf"].to_numpy()[order], vecs["vec_id"].to_numpy()[order]
            x = np.frombuffer(b"".join(vecs["v"]), dtype=np.float64).reshape(-1, dim)[order]
            q = np.frombuffer(b"".join(wants["q"]), dtype=np.float64).reshape(-1, dim)
            own, least = wants["query_id"].to_numpy(), wants["least"].to_numpy()
            lists = [np.frombuffer(b, dtype=np.int32) for b in wants["leaves"]]
            taken, asks = np.concatenate(lists), np.repeat(np.arange(len(q)), list(map(len, lists)))
            by_leaf = np.argsort(taken, kind="stable")
            taken, asks = taken[by_leaf], asks[by_leaf]
            for n in np.unique(leaf):
                a, b = np.searchsorted(leaf, [n, n + 1])
                wanting = asks[slice(*np.searchsorted(taken, [n, n + 1]))]
                for since in range(0, len(wanting), 512):
                    w = wanting[since : since + 512]
                    scores = q[w] @ x[a:b].T
                    r, c = np.nonzero((scores >= least[w, None]) & (ids[None, a:b] != own[w, None]))
                    if len(r) > k:
                        # the k best of each query over distinct ids, the smaller first among equal scores
                        o = np.lexsort((-scores[r, c], ids[a + c], r))
                        r, c = r[o], c[o]
                        new = np.append(True, (r[1:] != r[:-1]) | (ids[a + c][1:] != ids[a + c][:-1]))
                        r, c = r[new], c[new]
                        o = np.lexsort((ids[a + c], -scores[r, c], r))
                        r, c = r[o], c[o]
                        start = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
                        rank = np.arange(len(r)) - np.repeat(start, np.diff(np.append(start, len(r))))
                        r, c = r[rank < k], c[rank < k]
                    out["query_id"].append(own[w[r]])
                    out["vec_id"].append(ids[a + c])
                    out["score"].append(np.einsum("ij,ij->i", q[w[r]], x[a + c]))
        return pd.DataFrame({c: np.concatenate(v) for c, v in out.items()})

    indexed = rows.mapInPandas(dealt, "block long, leaf long, vec_id long, v binary")
    asked = queries.mapInPandas(probe, "block long, query_id long, q binary, least double, leaves binary")
    pairs = indexed.groupBy("block").cogroup(asked.groupBy("block")).applyInPandas(rerank, "query_id long, vec_id long, score double")
    best = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
