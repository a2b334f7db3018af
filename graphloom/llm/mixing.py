"""Mixing sources to target weights by Sainte-Lague apportionment.

The mix's words are equal blocks.  Each block goes to the source with the highest
quotient target / (2k + 1), k blocks given so far; the sequence of blocks is cut
into shards, so every shard has integer quotas close to the targets.  A source's
documents stand in a seeded order of their own; shard by shard its quota takes
the next blocks of that order, whole laps and then the first blocks of the last
lap, so the blocks a partial lap takes are a seeded choice.  A source of few
blocks takes its target to the word instead, an equal part in every shard, for
blocks grow with the corpus and may be larger than it.

Only DataFrame functions run.  Positions in a source are sums by (source, cell),
a cell being a prefix of the seeded hash, plus a running sum inside a cell, so a
source with a third of all rows is spread over all cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import Stored

#: Blocks below which a source's target is taken to the word: whole blocks would miss it by over half a hundredth.
FEW_BLOCKS = 100
#: Hex digits of the seeded hash that name a cell.
CELL_DIGITS = 3


def n_words(text: Column) -> Column:
    """Number of runs without space and \\t \\n \\v \\f \\r; a null text has none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    # a word ends where a non-blank meets a blank or the end
    return (F.size(F.split(F.concat(F.lit(" "), F.trim(spaced)), " +", -1)) - 1 - (F.length(F.trim(spaced)) == 0).cast("int")).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Add ``weight`` and ``target`` to rows of (source, source_size), one for each source.

    A target is its weight's part of ``share`` times all sizes, at most ``most``
    times the source's size; the excess goes to the others by weight until none
    is above.  With the sources in ascending order of cap / weight this ends
    where the first j are capped and the rest get (total - caps) / weights each.
    The table has one row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    capped = sources.withColumn("weight", cycle).withColumn("cap", F.lit(most) * F.col("source_size"))
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    )
    # the level of the first source that its cap does not bind holds for all that follow
    free = capped.withColumn("level", level)
    first = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level"))))
    named = free.withColumn("stop", first.over(everything)["level"])
    return named.withColumn("target", F.coalesce(F.least(F.col("cap"), F.col("stop") * F.col("weight")), F.col("cap"))).drop("level", "stop", "cap")


def quotas(sources: DataFrame, shards: int, blocks: int) -> DataFrame:
    """``(source, shard, quota)``: blocks of each source in each shard, by the highest quotients.

    ``sources`` has source and target, one row for each of m sources; shards *
    blocks = n blocks are given out.  A source of the part q of all targets gets
    at most q * (n + m / 2) + 1/2 blocks: with d the least quotient given, all
    sources together have at least the sum of target / d - 1/2 blocks.  So many
    quotients are listed for it, about n + 3m in all.
    """
    total = shards * blocks
    everything = Window.partitionBy()
    most = F.col("target") / F.col("all") * (F.lit(total) + F.col("m") / 2)
    listed = sources.where("target > 0").withColumn("all", F.sum("target").over(everything)).withColumn("m", F.count("*").over(everything)).select(
        "source", "target", F.explode(F.sequence(F.lit(0), most.cast("int") + 1)).alias("k"),
    )
    order = Window.orderBy((F.col("target") / (2 * F.col("k") + 1)).desc(), F.col("source").asc_nulls_last(), "k")
    given = listed.withColumn("n", F.row_number().over(order)).where(F.col("n") <= total)
    return given.groupBy("source", ((F.col("n") - 1) / blocks).cast("int").alias("shard")).agg(F.count("*").alias("quota"))


def mix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
    shards: int = 24, blocks: int = 1000, seed: int = 42,
) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, shard_words)``, one row for each row of ``df``.

    size counts words; taken is how many of the document's words the mix takes,
    repeats counted; shard_words lists how many of them lie in the blocks of each
    shard.  A source's blocks follow each other in its seeded order, the first
    ``quota`` of them in shard 0 and so on; past the last document the order
    starts again.  Defined results: a null text has size 0 and nothing is taken;
    a null source is a source, last in order; null ids are ordered like an empty
    id; rows that share id and text are interchangeable; if all sizes are 0 so
    are the targets; an empty table gives an empty result; other columns are not
    read.
    """
    src = F.col(source_col).cast("string")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # the text is part of the mark, so that null and repeated ids are spread too
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")), F.lit(":"), F.md5(text)))
    measured = df.select(F.col(id_col).cast("long").alias("doc_id"), src.alias("source"), n_words(text).alias("size"), mark.alias("mark"))
    docs = Stored(measured.withColumn("cell", F.substring("mark", 1, CELL_DIGITS)), "mix").df
    cells = docs.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    cells = Stored(cells, "mix-cells").df  # at most 16 ** CELL_DIGITS rows a source
    sizes = cells.groupBy("source").agg(F.sum("cell_size").alias("source_size"))
    named = Stored(targets(sizes, weights, share, most), "mix-sources").df
    given = quotas(named, shards, blocks).groupBy("source").agg(F.collect_list(F.struct("shard", "quota")).alias("given"))
    block = F.sum("target").over(Window.partitionBy()) / (shards * blocks)
    few = F.col("target") < FEW_BLOCKS * F.col("block")
    until = lambda s: F.aggregate("given", F.lit(0).cast("long"), lambda a, x: a + F.when(x["shard"] < s, x["quota"]).otherwise(0))
    # words of the source before each shard, and all that it takes at the end
    wanted = F.transform(F.sequence(F.lit(0), F.lit(shards)), lambda s: F.when(few, F.col("target") * s / shards).otherwise(F.coalesce(until(s), F.lit(0)) * F.col("block")))
    s = named.withColumn("block", block).alias("n").join(given.alias("t"), F.expr("n.source <=> t.source"), "left").select(
        F.col("n.source").alias("source"), "source_size", "target",
        F.transform(wanted, lambda w: F.least(F.round(w), F.lit(most) * F.col("source_size")).cast("long")).alias("words"),
    )
    in_order = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("source", "cell", F.coalesce(F.sum("cell_size").over(in_order), F.lit(0)).alias("cell_start"))
    starts = starts.alias("c").join(s.alias("s"), F.expr("c.source <=> s.source")).select("c.source", "cell", "cell_start", "source_size", "target", "words")
    in_cell = Window.partitionBy("source", "cell").orderBy("mark", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.withColumn("inside", F.coalesce(F.sum("size").over(in_cell), F.lit(0)))
    joined = placed.alias("d").join(starts.alias("c"), F.expr("d.source <=> c.source AND d.cell = c.cell")).select(
        "doc_id", "size", "source_size", "target", "words", (F.col("cell_start") + F.col("inside")).alias("start")
    )
    # of the first w words of the laps: whole laps, and the part of the last lap that lies in this document
    before = F.expr(
        "transform(words, w -> if(source_size > 0, (w div source_size) * size + greatest(0L, least(size, w % source_size - start)), 0L))"
    )
    return joined.withColumn("before", before).select(
        "doc_id", "size", "source_size", "target", F.get("before", F.lit(shards)).alias("taken"),
        F.expr(f"transform(sequence(0, {shards - 1}), s -> before[s + 1] - before[s])").alias("shard_words"),
    )


def mixed_documents(df: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, in whole copies.

    A document is repeated round(taken / size) times, halves up, so one that the
    last lap cuts is kept if at least half of it is taken.  All columns stay.
    Documents without words weigh nothing and are kept once.  Rows that share an
    id and a size get the same number of copies.
    """
    text_col = kw.get("text_col", "text")
    per_id = mix(df, id_col, **kw).groupBy("doc_id", "size").agg(F.max("taken").alias("taken"))
    copies = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5).cast("int"))
    plan = per_id.select(F.col("doc_id").alias("__mix_id"), F.col("size").alias("__mix_size"), copies.alias("__mix_copies"))
    same = df[id_col].cast("long").eqNullSafe(plan["__mix_id"]) & (n_words(df[text_col]) == plan["__mix_size"])
    joined = df.join(plan, same).where("__mix_copies > 0")
    kept = joined.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), "__mix_copies")))
    return kept.select(*[kept[c] for c in df.columns])


#: DuckDB SQL of the query: quotients past any that can be among the highest, and a sum over every shard's blocks.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('42:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS mark FROM documents
), z AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM z
), l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0.0)) AS level
  FROM w WINDOW o AS (ORDER BY cap / weight ASC, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, coalesce(least(cap, (SELECT arg_min(level, cap / weight) FROM l WHERE level <= cap / weight) * weight), cap) AS target FROM l
), q AS (
  SELECT source, target, unnest(range(0, (24000 + 5 * count(*) OVER ())::INT)) AS k FROM t WHERE target > 0
), g AS (
  SELECT source, (n - 1) // 1000 AS shard, count(*) AS quota
  FROM (SELECT source, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source ASC NULLS LAST, k) AS n FROM q) WHERE n <= 24000 GROUP BY ALL
), b AS (
  SELECT source, source_size, target, sum(target) OVER () / 24000 AS block FROM t
), s AS (
  SELECT b.source, source_size, target, h,
    least(round(CASE WHEN target < 100 * block THEN target * h / 24.0::DOUBLE
      ELSE coalesce((SELECT sum(quota) FROM g WHERE g.source IS NOT DISTINCT FROM b.source AND g.shard < h), 0) * block END), 2.0 * source_size)::BIGINT AS words
  FROM b, (SELECT unnest(range(0, 25)) AS h)
), p AS (
  SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY mark, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, row_number() OVER () AS r FROM d
), f AS (
  SELECT r, doc_id, size, source_size, target, h,
    (CASE WHEN source_size > 0 THEN (words // source_size) * size + greatest(0, least(size, words % source_size - start)) ELSE 0 END)::BIGINT AS before
  FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source
), e AS (
  SELECT *, before - lag(before) OVER (PARTITION BY r ORDER BY h) AS part FROM f
)
SELECT doc_id, size, source_size, target, max(before) AS taken, string_agg(part::VARCHAR, ',' ORDER BY h) FILTER (h > 0) AS shard_words
FROM e GROUP BY r, doc_id, size, source_size, target
"""
