"""Substring dedup by compacting a De Bruijn graph of word windows.

Edges of the graph are windows of ``width`` words, its nodes the runs they
overlap in.  One row for each edge would be many times the corpus, so edges that
follow each other without a branch travel as one path.

1. A window's minimiser (the smallest hash among its runs of ``ANCHOR`` words,
   its anchor) cuts every document into paths: the consecutive edges that share
   one anchor occurrence.  Equal edges have equal anchors, so paths meet over
   their anchors.  A path that has the spelling of its anchor's earliest one
   does not branch from it: all its edges repeat that path's.  Paths with other
   spellings branch there, and these few are expanded into edges.
2. A join of the edges with each edge's earliest coordinate gives the sources of
   the branching ones.
3. Paths and edges of one document that follow each other, with sources that
   follow each other too, compact into spans (start, windows, source).
4. Every span is verified at its coordinates: the words of the span and those at
   its source are digested (128 bits) where their texts are, and a join compares
   the digests.  Should one differ (two edges or keys with one 64-bit hash), all
   is done again with another seed, so a wrong link never removes a word.

Before the shuffle each map task keeps one row for each path spelling, its
earliest, and knows the others to repeat it.  An anchor that many documents have
with ever other neighbours (a short line in a third of them) is dealt over all
partitions; which anchors these are is told from a sample, and any way of
dealing gives the same result, for every part's first path goes to step 2.

A coordinate is (doc_id, hash of the text, word position), null ids first; a
document's key is a hash of its id and its text's hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import Stored, sweep

#: Words of an anchor.
ANCHOR = 8
#: Paths that a map task combines at a time.
COMBINED = 1 << 20
#: Documents that tell frequent anchors, and in how many of them a frequent one is.
SAMPLE, FREQUENT = 2_000, 10
#: Spans are cut where the source's window number is a multiple of this, so that a source is asked for few different ones.
PIECE = 64
#: Seeds that are tried at most; one fails with a chance of about pairs of edges / 2 ** 64.
SEEDS = 5

_BASE = np.uint64(0x9E3779B97F4A7C55)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes], seed: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), dtype=np.uint64, count=len(words))


def run_hashes(w: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` words."""
    n = len(w) - width + 1
    h = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            h = h * _BASE + w[k : k + n]
    return _mix(h)


def paths(w: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, spelling, first window, windows) of each path of one document.

    The anchor of a window is its smallest run hash, the leftmost of equals.
    """
    n = len(w) - width + 1
    runs = run_hashes(w, min(ANCHOR, width))
    within = width - min(ANCHOR, width) + 1  # runs in a window
    windows = np.lib.stride_tricks.sliding_window_view(runs, within)
    place = np.empty(n, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        place[at : at + (1 << 16)] = windows[at : at + (1 << 16)].argmin(axis=1) + np.arange(at, min(n, at + (1 << 16)))
    start = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    count = np.diff(np.append(start, n))
    anchor = runs[place[start]]
    # the spelling covers the path's words and where the anchor is among them
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(count.max()) + width, _BASE, dtype=np.uint64))
        total = np.zeros(len(start), dtype=np.uint64)
        span = count + width - 1
        for k in range(int(span.max())):
            live = span > k
            total[live] = total[live] + w[start[live] + k] * power[k]
        offset = (place[start] - start).astype(np.uint64)
        spelling = _mix(total + span.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + offset)
    return anchor, spelling, start, count


def key_of(doc_id: Column, text_hash: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), doc_id, F.coalesce(doc_id, F.lit(-1)), text_hash)


def _frequent(df: DataFrame, width: int, seed: int) -> np.ndarray:
    """Anchors that many documents of a bounded sample have, sorted."""
    total = df.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                words = (text.as_py() or b"").split()
                if len(words) >= width:
                    own = np.unique(paths(word_hashes(words, seed), width)[0])
                    yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64))], names=["anchor"])

    uniform = F.shiftrightunsigned(F.xxhash64("doc_id", "text_hash"), 11) / float(1 << 53)
    drawn = df.where(uniform < SAMPLE / max(total, 1)).select("text").mapInArrow(run, "anchor long")
    found = drawn.groupBy("anchor").count().where(F.col("count") >= FREQUENT).select("anchor").toArrow()  # at most the sample's paths / FREQUENT
    return np.sort(found["anchor"].to_numpy().view(np.uint64))


#: ``known``: the path repeats an earlier one; mark and place then are the source's key and start.
#: Else mark is the path's spelling, and place the part that a frequent anchor's path is dealt to.
_PATH = "anchor long, mark long, place int, doc_id long, text_hash long, key long, start int, windows int, known boolean"
#: A path or edge that repeats its source, or a branching path without one.
_LINK = "key long, start int, windows int, src_key long, src_start int, doc_id long, text_hash long"


def _find_paths(width: int, seed: int, frequent: np.ndarray, parts: int):
    """Paths of all documents; of those with one anchor and spelling in a task, all but the earliest are known."""

    def combined(held: list[tuple]) -> pa.RecordBatch:
        sizes = [len(x[3]) for x in held]
        ids = np.repeat(np.array([np.iinfo(np.int64).min if x[0] is None else x[0] for x in held], dtype=np.int64), sizes)
        null = np.repeat(np.array([x[0] is None for x in held]), sizes)
        c = {name: np.repeat(np.array([x[k] for x in held], dtype=np.int64), sizes) for k, name in ((1, "text_hash"), (2, "key"))}
        for k, name in enumerate(("anchor", "mark", "start", "windows"), 3):
            c[name] = np.concatenate([x[k] for x in held])
        order = np.lexsort((c["start"], c["text_hash"], ids, ~null, c["mark"], c["anchor"]))
        c = {k: v[order] for k, v in c.items()}
        ids, null = ids[order], null[order]
        same = lambda x: np.append(False, x[1:] == x[:-1])
        known = same(c["anchor"]) & same(c["mark"])
        first = np.maximum.accumulate(np.where(known, 0, np.arange(len(known))))
        # a row that repeats id and text is the same document
        new = ~(known & same(c["text_hash"]) & same(c["start"]) & same(ids) & same(null))
        new &= ~(known & (c["key"] == c["key"][first]) & (c["start"] == c["start"][first]))
        at = np.searchsorted(frequent, c["anchor"]) if len(frequent) else np.zeros(len(known), dtype=np.int64)
        often = frequent[np.minimum(at, len(frequent) - 1)] == c["anchor"] if len(frequent) else np.zeros(len(known), dtype=bool)
        part = np.where(often, (c["key"].view(np.uint64) >> np.uint64(20)) % np.uint64(parts), 0).astype(np.int32)
        mark = np.where(known, c["key"][first], c["mark"].view(np.int64))
        place = np.where(known, c["start"][first].astype(np.int32), part)
        anchor = np.where(known, c["key"], c["anchor"].view(np.int64))  # any value that spreads the known ones
        return pa.RecordBatch.from_arrays(
            [
                pa.array(anchor[new]), pa.array(mark[new]), pa.array(place[new]), pa.array(ids[new], mask=null[new]),
                pa.array(c["text_hash"][new]), pa.array(c["key"][new]), pa.array(c["start"][new].astype(np.int32)),
                pa.array(c["windows"][new].astype(np.int32)), pa.array(known[new]),
            ],
            names=["anchor", "mark", "place", "doc_id", "text_hash", "key", "start", "windows", "known"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        many = 0
        for batch in batches:
            for doc_id, mark, key, text in zip(*batch.columns):
                words = (text.as_py() or b"").split()
                if len(words) >= width:
                    found = paths(word_hashes(words, seed), width)
                    held.append((doc_id.as_py(), mark.as_py(), key.as_py(), *found))
                    many += len(found[0])
                    if many > COMBINED:
                        yield combined(held)
                        held, many = [], 0
        if held:
            yield combined(held)

    return run


def _resolve(frequent: np.ndarray):
    """Links of paths sorted by known, anchor, place and coordinate.

    One pass that remembers the first path of the group it is in.  A path of the
    first one's spelling repeats it; others branch, and then so does the first,
    as the first paths of a frequent anchor's parts always do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: pa.RecordBatch | None = None  # the first path of the last group seen, if it has not branched so far
        head: tuple = ()  # its anchor, place, spelling, key and start
        for batch in batches:
            t = batch.filter(pa.compute.invert(batch["known"]))
            k = batch.filter(batch["known"])
            if k.num_rows:
                none = pa.nulls(k.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([k["key"], k["start"], k["windows"], k["mark"], k["place"], none, none], names=_LINK_NAMES)
            if not t.num_rows:
                continue
            anchor, place, mark, key, start = (t[c].to_numpy() for c in ("anchor", "place", "mark", "key", "start"))
            new = np.append(not head or (head[0], head[1]) != (anchor[0], place[0]), (anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1]))
            at = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))  # row of the group's first path, -1: before this batch
            far = at < 0
            of = lambda x, i: np.where(far, head[i] if head else 0, x[at])
            first = [of(mark, 2), of(key, 3), of(start, 4)]
            # another row of the same document isn't a repeat, nor a branch
            itself = new | (first[1] == key) & (first[2] == start)
            repeats = ~itself & (first[0] == mark)
            branch = ~itself & ~repeats
            if len(frequent):
                i = np.minimum(np.searchsorted(frequent, anchor.view(np.uint64)), len(frequent) - 1)
                branch |= new & (frequent[i] == anchor.view(np.uint64))
            if open_ is not None and (branch & far).any():
                yield open_
                open_ = None
            with_branch = np.unique(at[branch & ~far])
            branch[with_branch] = True
            none = pa.nulls(t.num_rows, pa.int64())
            links = pa.RecordBatch.from_arrays([t["key"], t["start"], t["windows"], pa.array(first[1]), pa.array(first[2].astype(np.int32)), none, none], names=_LINK_NAMES)
            asks = pa.RecordBatch.from_arrays([t["key"], t["start"], t["windows"], none, none.cast(pa.int32()), t["doc_id"], t["text_hash"]], names=_LINK_NAMES)
            yield links.filter(pa.array(repeats))
            yield asks.filter(pa.array(branch))
            last = int(at[-1])
            if last >= 0:
                head = (anchor[last], place[last], mark[last], key[last], start[last])
                open_ = None if branch[last] else asks.slice(last, 1)

    return run


_LINK_NAMES = [x.split()[0] for x in _LINK.split(", ")]


def _edges(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, mark, key, text, spans in zip(*batch.columns):
                h = run_hashes(word_hashes((text.as_py() or b"").split(), seed), width)
                starts, many = (spans.values.field(c).to_numpy() for c in ("start", "windows"))
                at = np.concatenate([np.arange(a, a + n) for a, n in zip(starts, many)])
                at = np.unique(at[at < len(h)]).astype(np.int32)
                same = lambda x: pa.array(np.full(len(at), x.as_py() or 0, dtype=np.int64), mask=np.full(len(at), not x.is_valid))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[at].view(np.int64)), same(doc_id), same(mark), same(key), pa.array(at)],
                    names=["edge", "doc_id", "text_hash", "key", "start"],
                )

    return run


def _compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's links in order; those that follow each other, as their sources do, made one, in pieces."""
    for batch in batches:
        out = []
        for links in batch.column(1):
            start, many, src, src_start = (links.values.field(c).to_numpy() for c in ("start", "windows", "src_key", "src_start"))
            order = np.argsort(start, kind="stable")
            start, many, src, src_start = start[order], many[order], src[order], src_start[order]
            new = np.append(True, (start[1:] != (start + many)[:-1]) | (src[1:] != src[:-1]) | ((start - src_start)[1:] != (start - src_start)[:-1]))
            first = np.flatnonzero(new)
            end = (start + many)[np.append(first[1:], len(start)) - 1]
            own = []
            for a, b, k, p in zip(start[first].tolist(), end.tolist(), src[first].tolist(), src_start[first].tolist()):
                while a < b:
                    n = min(b - a, PIECE - p % PIECE)
                    own.append((a, n, k, p))
                    a, p = a + n, p + n
            out.append(own)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _SPANS)], names=["key", "spans"])


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("windows", pa.int32()), ("src_key", pa.int64()), ("src_start", pa.int32())]))


def repeated_spans(df: DataFrame, width: int, seed: int) -> Stored:
    """``(key, spans)`` of documents with windows that start earlier elsewhere.

    df: doc_id, text_hash, key, text (binary).  spans: (first window, windows, source's key, source's first window).
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frequent = _frequent(df, width, seed)
    found = df.select("doc_id", "text_hash", "key", "text").mapInArrow(_find_paths(width, seed, frequent, n), _PATH)
    dealt = found.repartition(n, "anchor", F.when(~F.col("known"), F.col("place")))
    order = ["known", "anchor", "place", F.col("doc_id").asc_nulls_first(), "text_hash", "start"]
    links = Stored(dealt.sortWithinPartitions(*order).mapInArrow(_resolve(frequent), _LINK), "links")
    sweep(spark)

    # edges of branching paths, each with its earliest coordinate
    asked = links.df.where("src_key IS NULL").groupBy("key").agg(F.collect_list(F.struct("start", "windows")).alias("spans"))
    spelled = df.join(asked, "key").select("doc_id", "text_hash", "key", "text", "spans")
    edges = Stored(spelled.mapInArrow(_edges(width, seed), "edge long, doc_id long, text_hash long, key long, start int"), "edges")
    sweep(spark)
    place = F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "text_hash", "start", "key")
    earliest = edges.df.groupBy("edge").agg(F.min(place).alias("first"))
    later = edges.df.join(earliest, "edge").where(place != F.col("first")).select(
        "key", "start", F.lit(1).alias("windows"), F.col("first.key").alias("src_key"), F.col("first.start").alias("src_start")
    )
    every = links.df.where("src_key IS NOT NULL").select("key", "start", "windows", "src_key", "src_start").union(later)
    by_doc = every.groupBy("key").agg(F.collect_set(F.struct("start", "windows", "src_key", "src_start")).alias("links"))
    spans = Stored(by_doc.mapInArrow(_compact, "key long, spans array<struct<start int, windows int, src_key long, src_start int>>"), "spans")
    links.drop()
    edges.drop()
    sweep(spark)
    return spans


def _remove(width: int, keep_text: bool):
    """Texts without their spans' words, and the digests of spans and of those that others ask for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, key, text, spans, asks in zip(*batch.columns):
                words = (text.as_py() or b"").split()
                digest = lambda a, n: xxhash.xxh3_128_digest(b" ".join(words[a : a + n + width - 1]))  # noqa: E731, B023
                own, own_digests = spans.as_py() or [], []
                gone = np.zeros(len(words) + 1, dtype=np.int64)
                for s in own:
                    gone[min(s["start"], len(words))] += 1
                    gone[min(s["start"] + s["windows"] + width - 1, len(words))] -= 1
                    own_digests.append({**s, "digest": digest(s["start"], s["windows"])})
                kept = [w for w, g in zip(words, np.cumsum(gone[:-1]) > 0) if not g] if own else words
                body = b" ".join(kept)
                shown = [{**a, "digest": digest(a["start"], a["windows"])} for a in asks.as_py() or []]
                rows.append((doc_id.as_py(), key.as_py(), len(words), len(words) - len(kept), hashlib.sha256(body).hexdigest(), body.decode() if keep_text else None, own_digests, shown))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _REMOVED)], schema=_REMOVED)

    return run


_REMOVED = pa.schema(
    [
        ("doc_id", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string()),
        ("own", pa.list_(pa.struct([*_SPANS.value_type, pa.field("digest", pa.binary())]))),
        ("shown", pa.list_(pa.struct([("start", pa.int32()), ("windows", pa.int32()), ("digest", pa.binary())]))),
    ]
)


def remove_repeats(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20, keep_text: bool = True
) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256, kept_text)``, one row for each row of ``df``.

    Words are runs without space and ``\\t \\n \\v \\f \\r``.  A word goes if a window
    of ``width`` words that covers it also starts earlier.  kept_text is null
    without ``keep_text``.  Defined results: a null text has no words; fewer than
    ``width`` words lose none; a null id comes before all others; rows with one
    id and different texts are ordered by their texts' hashes; rows that repeat
    both id and text are one document and get the same result; an empty table
    gives an empty result; other columns are not read.
    """
    spark = df.sparkSession
    text = F.col(text_col).cast("string").cast("binary")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    for seed in range(SEEDS):
        keyed = docs.withColumn("key", key_of(F.col("doc_id"), F.col("text_hash"), seed))
        spans = repeated_spans(keyed, width, seed)
        # what each document is asked for as a source, each piece once
        each = spans.df.select("key", F.explode("spans").alias("s"))
        asks = each.select(F.col("s.src_key").alias("key"), F.struct("s.src_start", "s.windows").alias("a")).distinct()
        asks = asks.groupBy("key").agg(F.collect_list(F.struct(F.col("a.src_start").alias("start"), "a.windows")).alias("asks"))
        plan = spans.df.join(asks, "key", "full")
        joined = keyed.join(plan, "key", "left").select("doc_id", "key", "text", "spans", "asks")
        out = Stored(joined.mapInArrow(_remove(width, keep_text), "doc_id long, key long, n_words long, n_removed long, kept_sha256 string, kept_text string, "
            "own array<struct<start int, windows int, src_key long, src_start int, digest binary>>, shown array<struct<start int, windows int, digest binary>>"), "removed")
        spans.drop()
        sweep(spark)
        own = out.df.select(F.explode("own").alias("o")).select("o.src_key", "o.src_start", "o.windows", "o.digest").distinct()
        shown = out.df.select(F.col("key").alias("src_key"), F.explode("shown").alias("o")).select("src_key", F.col("o.start").alias("src_start"), "o.windows", F.col("o.digest").alias("there")).distinct()
        verified = own.join(shown, ["src_key", "src_start", "windows"], "left").where("there IS NULL OR there != digest").isEmpty()
        sweep(spark)
        if verified:
            return out.df.select("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text")
        out.drop()
    raise ValueError(f"no seed of {SEEDS} gave spans that their sources verify")


#: DuckDB SQL of the query: every window against all others.
SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), x AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, len(w) - 18)) AS i)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM x) WHERE n > 1
), c AS (
  SELECT DISTINCT doc_id, i + k AS p FROM r, (SELECT unnest(range(0, 20)) AS k)
), e AS (
  SELECT doc_id, p, w[p] AS word FROM d, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS p)
), k AS (
  SELECT e.doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM e ANTI JOIN c ON e.doc_id = c.doc_id AND e.p = c.p GROUP BY e.doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
