"""Benchmark decontamination by size-partitioned MinHash containment search.

An item of m distinct shingles is contained at ``threshold`` t in a document
that holds at least need = ceil(t * m) of them.  The item's sketch is its
m - need + 1 smallest shingle hashes (a bottom-k MinHash): a document that holds
none of them lacks too many shingles to reach need, so sketch hits find every
contained item, at any document length.  Items are partitioned by size class
(the power of two of need).  The index is kept for each class of document
lengths and holds there the items of the classes that such a document can
reach, so the class is part of the join's key: a short document never meets a
long item's sketch, and every shingle is looked up once.  Candidates are then
verified by the exact containment of shingle strings.

Only DataFrame functions run: hashing, explode and equi-joins on the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import Stored, let

#: An index or candidate list up to so many rows (24 bytes each) is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Items up to so many bytes of shingles are broadcast for the verification.
BROADCAST_BYTES = 32 << 20
#: Size classes; the last has no upper end.
CLASSES = 16


def normal_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(words: Column, width: int, join: Callable[..., Column]) -> Column:
    """``join`` of each run of exactly ``width`` elements; none for a shorter array."""
    # get() reads one element; slice() would copy the array each time
    run = lambda a: F.transform(F.sequence(F.lit(0), F.size(a) - width), lambda i: join(*[F.get(a, i + k) for k in range(width)]))
    return let(words, lambda a: F.when(F.size(a) >= width, run(a)))


def shingle_strings(words: Column, width: int) -> Column:
    """Distinct shingles as strings."""
    found = shingles(words, width, lambda *w: F.concat_ws(" ", *w))
    return F.array_distinct(F.coalesce(found, F.array().cast("array<string>")))


def shingle_hashes(words: Column, width: int) -> Column:
    """Hash of each shingle, of its width and its words' hashes, repeats included."""
    return shingles(F.transform(words, lambda w: F.xxhash64(w)), width, lambda *w: F.xxhash64(F.lit(width), *w))


def size_class(n: Column) -> Column:
    return F.least(F.log2(F.greatest(n, F.lit(1))).cast("int"), F.lit(CLASSES - 1))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast ``df`` if it has at most BROADCAST_ROWS rows, as just counted."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contained_items(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", width: int = 5, threshold: float = 0.8,
) -> DataFrame:
    """``(doc_id, item_id, n_shared, n_item, containment)`` of every pair at or over the threshold.

    Shingles are runs of ``width`` normalised words; an item of fewer words is
    one shingle of all its words.  Defined results: an item without words is in
    no document; null and empty texts contain nothing; null ids stay null;
    rows repeated in either table give one row for each distinct pair of ids,
    that of the largest overlap; a pair at the threshold counts; texts of any
    length are read whole; empty tables give an empty result; other columns are
    not read.
    """
    bench = items.select(F.col(item_col).cast("long").alias("item_id"), normal_words(F.col(item_text_col)).alias("words")).where(F.size("words") > 0)
    bench = bench.select("item_id", "words", F.least(F.size("words"), F.lit(width)).alias("width"))
    widths = [r[0] for r in bench.select("width").distinct().orderBy("width").collect()]  # at most `width` rows
    if not widths:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_shared int, n_item int, containment double")
    sets = None
    for w in widths:
        own = bench.where(F.col("width") == w).select(
            "item_id", "width", shingle_strings(F.col("words"), w).alias("shingles"),
        )
        sets = own if sets is None else sets.union(own)
    # an item row is known by its id and its shingles: equal ids may have several texts
    sets = Stored(
        sets.withColumn("item", F.xxhash64("item_id", "shingles")).withColumn("n_item", F.size("shingles"))
        .withColumn("need", F.ceil(F.lit(threshold) * F.col("n_item") - 1e-9).cast("int")).dropDuplicates(["item"]),
        "decontam-items",
    ).df
    sketches = None
    for w in widths:
        hashes = F.transform("shingles", lambda g: F.get(shingle_hashes(F.split(g, " "), w), F.lit(0)))  # noqa: B023
        own = sets.where(F.col("width") == w).select(
            "item", size_class(F.col("need")).alias("item_class"), F.explode(F.slice(F.array_sort(hashes), 1, F.col("n_item") - F.col("need") + 1)).alias("h"),
        )
        sketches = own if sketches is None else sketches.union(own)
    index = sketches.select("item", F.explode(F.sequence("item_class", F.lit(CLASSES - 1))).alias("size_class"), "h")
    index = Stored(index, "decontam-index").df

    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    # one pass for all widths; a document has at most as many shingles as words
    each = lambda a: F.concat(*[F.coalesce(shingle_hashes(a, w), F.array().cast("array<long>")) for w in widths])
    hashed = texts.select("doc_id", "text_hash", let(normal_words(F.col("text")), lambda a: F.struct(size_class(F.size(a)).alias("size_class"), each(a).alias("hs"))).alias("x"))
    probes = hashed.select("doc_id", "text_hash", "x.size_class", F.explode("x.hs").alias("h"))
    hits = probes.join(_small(index, index.count()), ["size_class", "h"]).select("doc_id", "text_hash", "item")
    found = Stored(hits.distinct(), "decontam-hits")
    wanted = found.df.select("text_hash").distinct()
    n_wanted = wanted.count()
    texts = texts.select("text_hash", "text").join(_small(wanted, n_wanted), "text_hash", "left_semi").dropDuplicates(["text_hash"])
    pairs = found.df.select("text_hash", "item").distinct()
    spelled = texts.select("text_hash", normal_words(F.col("text")).alias("words"))
    size = sets.agg(F.sum(F.aggregate("shingles", F.lit(0), lambda a, x: a + F.octet_length(x) + 16))).first()[0]
    results = None
    for w in widths:
        doc_sets = spelled.select("text_hash", shingle_strings(F.col("words"), w).alias("has"))
        items_of = sets.where(F.col("width") == w)
        own = pairs.join(F.broadcast(items_of) if size <= BROADCAST_BYTES else items_of, "item").join(doc_sets, "text_hash").select(
            "text_hash", "item", "item_id", "n_item", "need", F.size(F.array_intersect("shingles", "has")).alias("n_shared")
        )
        results = own if results is None else results.union(own)
    good = results.where("n_shared >= need").drop("need")
    return (
        found.df.join(good, ["text_hash", "item"])
        .groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("containment"), "n_shared", "n_item")).alias("m"))
        .select("doc_id", "item_id", "m.n_shared", "m.n_item", "m.containment")
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs`` whose id and text contain no item at the threshold, all columns kept.

    A document with a null id is judged by its text through the same search.
    """
    id_col, text_col = kw.pop("id_col", "doc_id"), kw.pop("text_col", "text")
    # judged by text, so that null and repeated ids are right
    keyed = docs.select(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("doc_id"), F.col(text_col).alias("text"))
    bad = contained_items(keyed, items, **kw).select(F.col("doc_id").alias("__graphloom_text")).distinct()
    mark = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(bad, mark == bad["__graphloom_text"], "left_anti")


#: DuckDB SQL of the query: containment by brute force over all shingles.
SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS words FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS words FROM benchmark
), bw AS (SELECT item_id, words, least(len(words), 5) AS width FROM b WHERE len(words) > 0),
s AS (
  SELECT DISTINCT item_id, width, array_to_string(list_slice(words, i, i + width - 1), ' ') AS g
  FROM bw, LATERAL (SELECT unnest(range(1, len(words) - width + 2)) AS i)
), n AS (SELECT item_id, width, count(*) AS n_item FROM s GROUP BY ALL),
d AS (
  SELECT DISTINCT doc_id, width, array_to_string(list_slice(words, i, i + width - 1), ' ') AS g
  FROM w, (SELECT DISTINCT width FROM bw), LATERAL (SELECT unnest(range(1, len(words) - width + 2)) AS i)
)
SELECT d.doc_id, s.item_id, count(*)::INT AS n_shared, any_value(n_item)::INT AS n_item, count(*)::DOUBLE / any_value(n_item) AS containment
FROM d JOIN s USING (width, g) JOIN n USING (item_id, width)
GROUP BY d.doc_id, s.item_id HAVING count(*) >= ceil(0.8 * any_value(n_item) - 1e-9)
"""
