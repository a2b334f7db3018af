"""SimHash near-duplicates by a binary trie self-join.

Fingerprints form an implicit binary trie: a sorted array, where a node is the
index range that shares a bit prefix.  The self-join walks *pairs* of nodes down
the trie together, adds one for each differing bit and drops a pair of subtrees
as soon as the sum exceeds the budget.  Two refinements keep the results whole:

* the walk is dealt out by the trie's upper part.  Of ``budget + 1`` blocks of
  bits, fingerprints within the budget agree in one, so the trie is built once
  for each block turned to the top, and every subtree below a block is walked
  by itself.  A fingerprint goes to ``budget + 1`` subtrees at any size of the
  table; a subtree of too many fingerprints is dealt out by the blocks of its
  remaining bits in the same way;
* inside a task a pair of subtrees is also dropped when all their fingerprints
  already are in one component, so a dense group of n near copies costs about n
  links, not n squared.  The links that remain are a spanning forest, which has
  the same connected components as all links.

Equal fingerprints are joined before the trie, with a map-side combine, so
copies never meet as pairs.

Near-duplicate texts (``near_duplicate_groups``) start from the same self-join.
Fingerprints of two texts at the border of the similarity may differ in any
number of bits, so what the trie joins is verified on the shingle sets, and a
prefix filter then lists every pair that it may have missed.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import Stored, components, sweep

BITS = 64
#: Fingerprints of a subtree that one task walks; a subtree of more is dealt out by the blocks of its remaining bits.
SUBTREE = 2_000_000
#: Node pairs that one vectorised step handles.
CHUNK = 1 << 18


def words_of(text: bytes | None) -> list[bytes]:
    """ASCII-lower-cased words: runs without space and ``\\t \\n \\v \\f \\r``."""
    return (text or b"").lower().split()


def shingles_of(words: list[bytes], width: int) -> list[bytes]:
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    if width == 1:
        return words
    return list(map(b" ".join, zip(*(words[i:] for i in range(width)))))


def fingerprint(text: bytes | None, width: int, seed: int = 42) -> int:
    """Fingerprint of the text's shingles, repeats included."""
    return majority(shingles_of(words_of(text), width), seed)


def majority(shingles: Collection[bytes], seed: int) -> int:
    """Bits set in over half of the shingles' XXH64, as an unsigned integer; 0 without shingles."""
    digest = xxhash.xxh64_intdigest
    return majority_bits(np.fromiter((digest(s, seed) for s in shingles), dtype="<u8", count=len(shingles)))


def majority_bits(hashes: np.ndarray) -> int:
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str, text_col: str, width: int, seed: int = 42) -> DataFrame:
    """``(doc_id, fp)`` for every row; fp is the fingerprint's bit pattern as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), width, seed) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"]
            )

    narrow = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, fp long")


def trie_links(values: np.ndarray, roots: np.ndarray | list[tuple[int, int, int, int, int, int]], budget: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sorted distinct ``values``.

    roots: pairs of trie nodes as (a_low, a_high, b_low, b_high, bits that
    already differ, depth); links are index pairs whose values differ in at most
    ``budget`` bits, restricted to value pairs below some root pair.
    """
    n = len(values)
    parent = np.arange(n)
    run_end = np.arange(1, n + 1)
    found: list[tuple[int, int]] = []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def unite(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal parent, run_end
        near = np.bitwise_count(values[i] ^ values[j]) <= budget
        i, j = i[near], j[near]
        apart = parent[i] != parent[j]
        i, j = i[apart], j[apart]
        if not len(i):
            return
        low, high = np.minimum(parent[i], parent[j]), np.maximum(parent[i], parent[j])
        _, first = np.unique(low * n + high, return_index=True)
        for k in first:
            a, b = find(int(i[k])), find(int(j[k]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                found.append((int(i[k]), int(j[k])))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        ends = np.flatnonzero(np.append(parent[1:] != parent[:-1], True)) + 1
        run_end = ends[np.searchsorted(ends, np.arange(n), side="right")]

    every = np.array(roots, dtype=np.int64).reshape(-1, 6)
    stack = [(int(d), every[every[:, 5] == d, :5].T) for d in np.unique(every[:, 5])]
    while stack:
        depth, pairs = stack.pop()
        if pairs.shape[1] > CHUNK:
            stack.append((depth, pairs[:, CHUNK:]))
            pairs = pairs[:, :CHUNK]
        al, ah, bl, bh, differ = pairs
        # both subtrees in one component: no link below adds anything
        joined = (run_end[al] >= ah) & (run_end[bl] >= bh) & (parent[al] == parent[bl])
        al, ah, bl, bh, differ = pairs[:, ~joined]
        rows, cols = ah - al, bh - bl
        few = rows * cols <= 16
        if few.any():
            many = rows[few] * cols[few]
            k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            width = np.repeat(cols[few], many)
            i, j = np.repeat(al[few], many) + k // width, np.repeat(bl[few], many) + k % width
            unite(i[i != j], j[i != j])
            al, ah, bl, bh, differ = (x[~few] for x in (al, ah, bl, bh, differ))
        if not len(al) or depth == BITS:
            continue
        high = np.uint64(1 << (BITS - 1 - depth))
        keep = np.uint64(((1 << depth) - 1) << (BITS - depth) if depth else 0)
        am = np.clip(np.searchsorted(values, (values[al] & keep) | high), al, ah)
        bm = np.clip(np.searchsorted(values, (values[bl] & keep) | high), bl, bh)
        same = al == bl
        children = np.concatenate(
            [
                [al, am, bm, bh, differ + 1],
                np.array([am, ah, bl, bm, differ + 1])[:, ~same],
                [al, am, bl, bm, differ],
                [am, ah, bm, bh, differ],
            ],
            axis=1,
        )
        full = (children[0] < children[1]) & (children[2] < children[3]) & (children[4] <= budget)
        children = children[:, full]
        if children.shape[1]:
            stack.append((depth + 1, children))
    return found


def turned(value: Column, depth: int, by: int) -> Column:
    """The bits below ``depth`` turned left by ``by``; those above stay."""
    if not by:
        return value
    low = BITS - depth
    mask = (1 << low) - 1
    signed = mask - (1 << 64) * (mask >> 63)
    rest = value.bitwiseAND(F.lit(signed))
    round_ = F.shiftleft(rest, by).bitwiseOR(F.shiftrightunsigned(rest, low - by)).bitwiseAND(F.lit(signed))
    return value.bitwiseAND(F.lit(~signed)).bitwiseOR(round_)


def subtrees(fps: DataFrame, budget: int) -> DataFrame:
    """``(turns, depth, head, value, fp)``: fingerprints with their subtrees.

    ``value`` is the fingerprint with its blocks turned to the top, ``turns``
    says which, and ``head`` are its top ``depth`` bits, which name the subtree.
    """
    rows = fps.select(F.lit(0).alias("turns"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("head"), F.col("fp").alias("value"), "fp")
    depth, done = 0, None
    while True:
        width = (BITS - depth) // (budget + 1)
        blocks = [F.struct((F.col("turns") * (budget + 1) + k + 1).alias("turns"), turned(F.col("value"), depth, k * width).alias("value")) for k in range(budget + 1)]
        depth += width
        rows = rows.select("fp", F.explode(F.array(*blocks)).alias("x")).select(
            "x.turns", F.lit(depth).alias("depth"), F.shiftrightunsigned("x.value", BITS - depth).alias("head"), "x.value", "fp"
        )
        if BITS - depth <= budget:
            break
        large = Stored(rows.groupBy("turns", "head").count().where(F.col("count") > SUBTREE).select("turns", "head"), "simhash-large")
        if large.df.isEmpty():
            large.drop()
            break
        # at most (budget + 1) * rows / SUBTREE of them
        small = rows.join(large.df, ["turns", "head"], "left_anti").select(*rows.columns)
        done = small if done is None else done.union(small)
        rows = rows.join(large.df, ["turns", "head"], "left_semi").select(*rows.columns)
    return rows if done is None else done.union(rows)


def _walk(budget: int):
    """Links of the subtrees in a partition sorted by turns, depth, head and value."""

    def joined(t: pa.Table) -> pa.RecordBatch:
        turns, head, value, fp = (t[c].to_numpy() for c in ("turns", "head", "value", "fp"))
        depth = t["depth"].to_numpy()
        value, a, b = value.view(np.uint64), [], []
        part = np.flatnonzero(np.append(True, (turns[1:] != turns[:-1]) | (depth[1:] != depth[:-1])))
        for low, high in zip(part, np.append(part[1:], len(turns))):
            h = head[low:high]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            last = np.append(first[1:], len(h))
            own = np.stack([first, last, first, last, np.zeros_like(first), np.full_like(first, depth[low])], axis=1)[last - first > 1]
            if len(own):
                found = np.array(trie_links(value[low:high], own, budget), dtype=np.int64).reshape(-1, 2)
                a.append(fp[low:high][found[:, 0]])
                b.append(fp[low:high][found[:, 1]])
        none = np.empty(0, dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *a])), pa.array(np.concatenate([none, *b]))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows > CHUNK:
                t = pa.Table.from_batches(held)
                turns, head = t["turns"].to_numpy(), t["head"].to_numpy()
                # the last subtree may go on in the next batch
                open_ = np.flatnonzero((turns != turns[-1]) | (head != head[-1]))
                whole = int(open_[-1]) + 1 if len(open_) else 0
                if whole:
                    yield joined(t.slice(0, whole))
                held = t.slice(whole).combine_chunks().to_batches()
                rows = t.num_rows - whole
        if rows:
            yield joined(pa.Table.from_batches(held))

    return run


def links(fps: DataFrame, budget: int) -> DataFrame:
    """``(a, b)``: a spanning forest of the distinct values of ``fp`` within the budget; a link may come twice."""
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = subtrees(fps, budget).repartition(n, "turns", "head").sortWithinPartitions("turns", "depth", "head", "value")
    return dealt.mapInArrow(_walk(budget), "a long, b long")


def simhash_components(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, budget: int = 3, seed: int = 42
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row for each row of ``df``.

    Words are lower-cased in A-Z only; shingles of ``width`` words count with
    repeats, a shorter text is one shingle.  Defined results: null and empty
    texts have fingerprint zero and link like any other; repeated rows give
    repeated results; a null id keeps its row, and a component whose ids are all
    null has a null component_id; an empty table gives an empty result; other
    columns of ``df``, whatever their names, are not read.
    """
    spark = df.sparkSession
    docs = Stored(fingerprints(df, id_col, text_col, width, seed), "simhash")
    each = Stored(docs.df.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-fp")
    near = Stored(links(each.df.select("fp"), budget), "simhash-links")
    sweep(spark)
    roots = components(near.df, "a", "b").withColumnRenamed("node", "fp")
    near.drop()
    rooted = each.df.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = rooted.join(least, "root").select("fp", "component_id")
    return docs.df.join(by_fp, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


#: Texts that tell common shingles from rare ones, and how many common ones are kept.
SAMPLE_TEXTS, COMMON = 5_000, 100_000
#: Rounds of stars at most, pairs for each listed row up to which all pairs are tried at once, and the part of a
#: star's pairs that must be similar for another round: similar texts grow together by stars, others never do.
STAR_ROUNDS, FEW_PAIRS, SIMILAR = 12, 0.5, 0.5
#: What the stars leave is tried in waves: the pairs of these parts of the nodes, the smallest first.
WAVES = (1 / 32, 1 / 8, 1.0)
#: Cells that a set's shingles are counted in, to bound how many two sets can share.
CELLS = 256
#: Rows of 8 bytes that are broadcast at most, as counted, and values that a task hands over at a time.
FEW_ROWS, HANDED = 1_000_000, 500_000


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """The distinct shingles' hashes, sorted."""
    own = {xxhash.xxh3_64_intdigest(s) for s in shingles_of(words_of(text), width)}
    return np.sort(np.fromiter(own, dtype=np.uint64, count=len(own)))


def _common(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a bounded sample hold, sorted, and in how many."""
    total = texts.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text.as_py(), width).view(np.int64))], names=["token"])

    uniform = F.shiftrightunsigned(F.xxhash64("text_hash"), 11) / float(1 << 53)
    drawn = texts.where(uniform < SAMPLE_TEXTS / max(total, 1)).select("text")
    most = drawn.mapInArrow(run, "token long").groupBy("token").count().where("count > 2").orderBy(F.desc("count"), "token").limit(COMMON).toArrow()
    tokens, counts = most["token"].to_numpy().view(np.uint64), most["count"].to_numpy()
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def cells_of(has: np.ndarray) -> bytes | None:
    """How many of a set's hashes fall in each cell, a byte each; None if one holds too many for that."""
    many = np.bincount((has % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
    return many.astype(np.uint8).tobytes() if many.max(initial=0) < 256 else None


def _may_be_alike(similarity: float):
    """Pairs (a, b) whose sets can reach the similarity: two sets share at most the lesser count of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = (batch["n_a"].to_numpy() + batch["n_b"].to_numpy()).astype(np.float64)
            left, right = batch["cells_a"], batch["cells_b"]
            known = pa.compute.and_(left.is_valid(), right.is_valid()).to_numpy(zero_copy_only=False)
            most = np.full(len(n), np.inf)
            counts = [np.frombuffer(b"".join(x.filter(pa.array(known)).to_pylist()), dtype=np.uint8).reshape(-1, CELLS) for x in (left, right)]
            most[known] = np.minimum(*counts).sum(1, dtype=np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(most >= similarity * (n - most) - 1e-6))

    return run


def _small(df: DataFrame) -> DataFrame:
    """``df`` for a broadcast if it has at most FEW_ROWS rows, as just counted."""
    return F.broadcast(df) if df.count() <= FEW_ROWS else df


def near_duplicate_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, budget: int = 3
) -> DataFrame:
    """``(doc_id, text_hash, group)``, one row for each distinct pair of id and text.

    Two texts belong together if the Jaccard coefficient of their sets of
    ``width``-word shingles is at least ``similarity``, and so do equal texts.
    First the trie self-join links texts whose SimHash fingerprints differ in at
    most ``budget`` bits; its links are verified on the sets.  Texts that are
    similar and differ in more bits are found by an exact search (up to equal
    64-bit hashes): in an order that all sets share, common shingles last, two
    similar sets have their first shared shingle among the first
    ``n - ceil(similarity * n) + 1`` of each, and from there on enough is left in
    both.  Sets that share such a shingle are listed under it; members of one
    verified component need no test, so the groups that the trie found cost
    nothing more.  Long lists are first tried as stars around a member, which is
    then done with, and what the stars leave is tried pair by pair, in waves.  At the end
    every listed pair of different components was verified on the exact sets.
    group is the smallest text hash reachable over verified links.
    """
    spark = df.sparkSession
    narrow = df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
    ).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    shared = spark.sparkContext.broadcast(_common(narrow, width))  # bounded by COMMON

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = shared.value
        listed_here: set[int] = set()
        for batch in batches:
            nodes, sizes, fps, firsts, cells = [], [], [], [], []
            for text in batch.column(2):
                has = shingle_set(text.as_py(), width)
                nodes.append(xxhash.xxh3_64_intdigest(has.tobytes()))
                sizes.append(len(has))
                fps.append(majority_bits(has))
                cells.append(cells_of(has))
                if nodes[-1] in listed_here:  # copies of a text list it once for each task
                    firsts.append(np.empty(0, dtype=np.int64))
                    continue
                listed_here.add(nodes[-1])
                seen = np.zeros(len(has), dtype=np.int64)
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, has), len(tokens) - 1)
                    seen = np.where(tokens[at] == has, counts[at], 0)
                need = int(np.ceil(similarity * len(has) - 1e-9))
                firsts.append(has[np.lexsort((has, seen))][: len(has) - need + 1].view(np.int64))
            longs = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (nodes, fps)]
            packed = [longs[0], longs[1], pa.array(sizes, pa.int32()), pa.array(cells, pa.binary()), pa.array(firsts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *packed], names=["doc_id", "text_hash", "node", "fp", "n", "cells", "tokens"])

    docs = Stored(narrow.mapInArrow(prefixes, "doc_id long, text_hash long, node long, fp long, n int, cells binary, tokens array<long>"), "near")
    listed = docs.df.select("node", "n", F.posexplode("tokens").alias("pos", "token"))
    # one shuffle: counting the tokens first would move every row twice once the counts are too many for a broadcast
    dealt = listed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "token")
    once = dealt.groupBy("token", "node").agg(F.min("n").alias("n"), F.min("pos").alias("pos"))
    same = Window.partitionBy("token")
    lone = once.select("token", "node", "n", "pos", F.min("node").over(same).alias("lo"), F.max("node").over(same).alias("hi"))
    live = Stored(lone.where("lo != hi").select("token", "node", "n", "pos"), "near-lists")
    held = [docs, live]
    sweep(spark)
    # one text for each node
    wanted = docs.df.join(_small(live.df.select("node").distinct()), "node", "left_semi").groupBy("node").agg(F.min(F.struct("text_hash", "fp", "n", "cells")).alias("w"))
    wanted = Stored(wanted.select("node", "w.*"), "near-wanted")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, since, many = [], 0, 0
            for i, text in enumerate(batch.column(1)):
                found.append(shingle_set(text.as_py(), width).view(np.int64))
                many += len(found[-1])
                if many > HANDED or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(since, len(found)), pa.array(found, pa.list_(pa.int64()))], names=["node", "has"])
                    found, since, many = [], i + 1, 0

    both = F.size(F.array_intersect("has_a", "has_b"))
    alike = both >= F.lit(similarity) * (F.size("has_a") + F.size("has_b") - both) - 1e-9

    def verify(pairs: DataFrame, known: Stored | None = None) -> tuple[Stored, float]:
        """Roots of the components once those of the pairs (a, b) that are similar join the known ones, and their part of the pairs.

        Sets are made anew for the nodes of these pairs only, so no set is moved that no pair asks for.
        """
        end = lambda c: wanted.df.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("cells").alias(f"cells_{c}"))
        tried = Stored(pairs.join(end("a"), "a").join(end("b"), "b").mapInArrow(_may_be_alike(similarity), "a long, b long"), "near-pairs")
        asked = Stored(tried.df.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(wanted.df, "node").select("node", "text_hash"), "near-asked")
        texts = narrow.select("text_hash", "text").join(_small(asked.df), "text_hash").select("node", "text")
        sets = texts.mapInArrow(hashed, "node long, has array<long>").dropDuplicates(["node"])
        left = sets.select(F.col("node").alias("a"), F.col("has").alias("has_a"))
        right = sets.select(F.col("node").alias("b"), F.col("has").alias("has_b"))
        found = Stored(tried.df.join(left, "a").join(right, "b").where(alike).select("a", "b"), "near-verified")
        part = found.df.count() / max(tried.df.count(), 1)
        tried.drop()
        asked.drop()
        sweep(spark)
        out = Stored(components(found.df if known is None else found.df.union(known.df.where("node != root")), "a", "b"), "near-roots")
        for table in [found, *([known] if known else [])]:
            table.drop()
        return out, part

    # the trie's links between the smallest nodes of their fingerprints, and equal fingerprints
    each = Stored(wanted.df.groupBy("fp").agg(F.min("node").alias("first")), "near-fp")
    near = Stored(links(each.df.select("fp"), budget), "near-links")
    end = lambda c: each.df.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}"))
    far = near.df.distinct().join(end("a"), "a").join(end("b"), "b").select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b"))
    equal = wanted.df.join(each.df, "fp").where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    roots, _ = verify(far.union(equal))
    each.drop()
    near.drop()
    held.append(wanted)

    # sizes and places leave room for the shared shingles that the similarity needs
    enough = F.expr(f"least(n - pos, n_b - pos_b) >= {similarity / (1 + similarity)!r}D * (n + n_b) - 1e-6D")
    part = 1.0
    rest = live.df
    old: list[Stored] = []  # what ``rest`` reads
    for turn in range(STAR_ROUNDS + 1):
        placed = rest.join(roots.df, "node", "left").withColumn("root", F.coalesce("root", "node"))
        lists = placed.groupBy("token", "root").agg(F.count("*").alias("c")).groupBy("token").agg(
            F.min("root").alias("lo"), F.max("root").alias("hi"), F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("own"),
        ).where("lo != hi")
        lists = Stored(lists, "near-open")
        rows, left_over = lists.df.agg(F.sum("c"), F.sum((F.col("c").cast("double") * F.col("c") - F.col("own")) / 2)).first()
        if not rows:
            lists.drop()
            break
        placed = Stored(placed.join(_small(lists.df.select("token")), "token", "left_semi").select("token", "node", "n", "pos", "root"), "near-placed")
        for table in [lists, *old]:
            table.drop()
        old = [placed]
        last = turn == STAR_ROUNDS or left_over <= FEW_PAIRS * rows or part < SIMILAR
        if last:
            # each pair once, in the wave of whichever end comes first; what a wave joins needs no test in the next
            drawn = placed.df.drop("root").withColumn("lot", F.shiftrightunsigned(F.xxhash64("node"), 11) / float(1 << 53))
            waves = WAVES if left_over > FEW_PAIRS * rows else WAVES[-1:]
            for low, high in zip((0.0, *waves), waves):
                open_ = drawn.where(F.col("lot") >= low).join(roots.df, "node", "left").withColumn("root", F.coalesce("root", "node"))
                centre = open_.where(F.col("lot") < high).select("token", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "pos", "root")])
                met = open_.join(centre, "token").where("root != root_b").where((F.col("lot") >= high) | (F.col("node") < F.col("node_b")))
                roots, part = verify(met.where(enough).select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b")).distinct(), roots)
            break
        lot = F.struct(F.xxhash64("node", F.lit(turn)), "node", "n", "pos", "root")
        pivot = placed.df.groupBy("token").agg(F.min(lot).alias("p")).select("token", *[F.col(f"p.{c}").alias(f"{c}_b") for c in ("node", "n", "pos", "root")])
        pivot = Stored(pivot, "near-pivots")
        old.append(pivot)
        met = placed.df.join(pivot.df, "token").where("root != root_b")
        rest = placed.df.join(pivot.df, "token").where("node != node_b").select("token", "node", "n", "pos")
        roots, part = verify(met.where(enough).select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b")).distinct(), roots)
    each = docs.df.select("doc_id", "text_hash", "node").distinct()
    rooted = each.join(roots.df, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("text_hash").alias("group"))
    out = Stored(rooted.join(least, "root").select("doc_id", "text_hash", "group"), "near-groups")
    for table in [*held, *old, roots]:
        table.drop()
    sweep(spark)
    return out.df


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One row of each group of near duplicates, the one with the smallest id; all columns stay.

    Null ids come after all others; among equal ids the smallest text hash stays,
    and one of the rows that repeat both.  Null and empty texts are equal texts.
    """
    groups = near_duplicate_groups(df, id_col, text_col, **kw)
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    kept = Stored(groups.groupBy("group").agg(F.min(place).alias("k")).select(F.col("k.doc_id").alias("__near_id"), F.col("k.text_hash").alias("__near_text")), "near-kept").df
    mark = F.xxhash64(F.coalesce(df[text_col].cast("string"), F.lit("")).cast("binary"))
    same = df[id_col].cast("long").eqNullSafe(kept["__near_id"]) & (mark == kept["__near_text"])
    once = df.join(kept, same, "left_semi")
    # rows that repeat id and text: few or none, found on narrow columns
    keys = df.select(df[id_col].cast("long").alias("i"), mark.alias("t"))
    again = Stored(keys.groupBy("i", "t").count().where("count > 1").select(F.col("i").alias("__again_id"), F.col("t").alias("__again_text")), "near-again").df
    if again.isEmpty():
        return once
    repeats = df[id_col].cast("long").eqNullSafe(again["__again_id"]) & (mark == again["__again_text"])
    single = once.join(again, repeats, "left_anti")
    return single.union(once.join(again, repeats, "left_semi").dropDuplicates([id_col, text_col]))
