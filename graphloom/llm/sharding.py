"""Sharding by sampled splitters, shards of nearly equal bytes.

A record's key is (hash of its text, id, row), so equal texts are neighbours.  A
size-weighted sample of the keys gives quantile boundaries; records are
range-partitioned by them.  Exact sizes of the ranges follow, and an overfull
range is cut again at exact size steps along its key order.  The pieces, at most
a few thousand, are then packed into the shards, largest first into the
emptiest, and a record's slot is its piece's first slot plus its rank in it.

Equal texts are a group and stay in one shard, as long as the group has no more
than a quarter of a shard's bytes and WHOLE_BYTES, or is no larger than a range.
A larger one (a text that a third of all rows share, say) takes many of the
boundaries, which then differ by id, so no range or window task holds more than
about one piece.  Only DataFrame functions run; the driver sees the bounded sample and one
row for each piece.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import Stored

#: Ranges aimed at for each shard, sampled keys for each range, and prefix cells of the range join.
RANGES, SAMPLES, CELL_BITS = 64, 8, 10
#: Bytes up to which a group of equal texts stays whole, if that is no more than a quarter of a shard.
WHOLE_BYTES = 64 << 20


def _pack(pieces: list[tuple], shards: int) -> dict[tuple[int, int], int]:
    """Shard of each (range, part): largest first into the emptiest shard."""
    load = [(0, k) for k in range(shards)]
    out = {}
    for size, r, part in sorted(((p[3], p[0], p[1]) for p in pieces), key=lambda x: (-x[0], x[1], x[2])):
        full, k = heapq.heappop(load)
        out[r, part] = k
        heapq.heappush(load, (full + size, k))
    return out


def shard(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 24) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``, one row for each row.

    size is the text's UTF-8 bytes plus 8; law is ``bytes``; slots are gapless
    from 0 in each shard; grown_shard is null.  Equal texts, null ones too, lie in one
    shard unless they are too many bytes, see above.  Defined results: a null text has
    size 8 and a null crc; a null id sorts first; repeated rows are told apart by
    their place in the stored key table, so they get slots of their own; with
    fewer rows than shards some shards stay empty; an empty table gives an empty
    result; other columns are not read.
    """
    spark = df.sparkSession
    text = F.col(text_col).cast("string")
    keyed = df.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row"),
    )
    # the cell is the hash's top bits in unsigned order of the signed value
    cell = F.shiftright("h", 64 - CELL_BITS).cast("int")
    rows = Stored(keyed.withColumn("cell", cell), "sharding").df
    total, most = rows.agg(F.sum("size"), F.max("size")).first()
    if not total:
        return rows.select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
        )
    n_ranges = shards * RANGES
    step = total / (n_ranges * SAMPLES)
    # a key is drawn with chance size / step, decided by its own hash; its weight makes up for that
    uniform = F.shiftrightunsigned(F.xxhash64("h", "doc_id", "row"), 11) / float(1 << 53)
    drawn = rows.where(uniform < F.col("size") / step).select(
        "h", "doc_id", "row", F.greatest(F.col("size").cast("double"), F.lit(step)).alias("weight")
    )
    sample = sorted(drawn.collect(), key=lambda r: (r.h, r.doc_id is not None, r.doc_id or 0, r.row))  # about n_ranges * SAMPLES keys
    goal = max(total / n_ranges, 1.0)
    whole = max(goal, min(total / (4 * shards), WHOLE_BYTES))
    # groups that may be too large, at most 4 * n_ranges of them, and which of them are
    weight_of: dict[int, float] = {}
    for r in sample:
        weight_of[r.h] = weight_of.get(r.h, 0.0) + r.weight
    maybe = spark.createDataFrame([(h,) for h, w in weight_of.items() if w >= whole / 4], "h long")
    large = {r[0] for r in rows.join(F.broadcast(maybe), "h").groupBy("h").agg(F.sum("size").alias("b")).where(F.col("b") > whole).collect()}
    last = (1 << 63) - 1
    bounds, full, quota = [], 0.0, sum(r.weight for r in sample) / n_ranges
    for r in sample:
        full += r.weight
        if full >= quota * (len(bounds) + 1):
            bounds.append((r.h, r.doc_id, r.row) if r.h in large else (r.h, last, last))
            while full >= quota * (len(bounds) + 1):  # one record over several quantiles
                full -= quota
    bounds = list(dict.fromkeys(bounds))
    # a range holds the keys after its low and up to its high bound; listed for each cell it meets
    edges = [(-(1 << 63), None, -1), *bounds, ((1 << 63) - 1, (1 << 63) - 1, (1 << 63) - 1)]
    shift = 64 - CELL_BITS
    table = [
        (c, r, *low, *high)
        for r, (low, high) in enumerate(zip(edges, edges[1:])) for c in range(low[0] >> shift, (high[0] >> shift) + 1)
    ]  # at most 2 ** CELL_BITS + n_ranges + 1 rows
    ranges = spark.createDataFrame(
        table, "cell int, range int, low_h long, low_id long, low_row long, high_h long, high_id long, high_row long"
    )
    after = lambda h, i, r: (  # noqa: E731  (h, id, row) of the record > the bound; null ids first
        f"(h > {h} OR h = {h} AND (coalesce(doc_id > {i}, doc_id IS NOT NULL AND {i} IS NULL) OR doc_id <=> {i} AND row > {r}))"
    )
    hit = F.expr(f"{after('low_h', 'low_id', 'low_row')} AND NOT {after('high_h', 'high_id', 'high_row')}")
    ranged = rows.join(F.broadcast(ranges), "cell").where(hit).select("doc_id", "size", "text_crc32", "h", "row", "range")

    sized = ranged.groupBy("range").agg(F.sum("size").alias("bytes"))
    overfull = sized.where(F.col("bytes") > 2 * goal).select("range")
    cut = [r[0] for r in overfull.collect()]  # at most n_ranges / 2 rows
    key_order = [F.col("h"), F.col("doc_id").asc_nulls_first(), F.col("row")]
    in_range = Window.partitionBy("range").orderBy(*key_order)
    before = F.sum("size").over(in_range.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    group = Window.partitionBy("range", "h")
    # a group that stays whole goes where it begins
    from_ = F.when(F.sum("size").over(group) <= whole, F.min("before").over(group)).otherwise(F.col("before"))
    part = F.when(F.col("range").isin(cut), (from_ / goal).cast("int")).otherwise(0) if cut else F.lit(0)
    cutup = Stored(
        ranged.withColumn("rank", F.row_number().over(in_range).cast("long") - 1).withColumn("before", before).withColumn("part", part)
        .select("doc_id", "size", "text_crc32", "range", "part", "rank"),
        "sharding-pieces",
    ).df
    pieces = [
        tuple(p) for p in cutup.groupBy("range", "part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("rank").alias("first")).collect()
    ]  # at most a few for each range
    place = _pack(pieces, shards)
    filled = [0] * shards
    listed = []
    for r, p, n, _, first in sorted(pieces):
        k = place[r, p]
        listed.append((r, p, k, filled[k] - first))
        filled[k] += n
    to = spark.createDataFrame(listed, "range int, part int, shard int, shift long")
    return cutup.join(F.broadcast(to), ["range", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") + F.col("shift")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
