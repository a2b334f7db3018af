"""Secret scan with corpus-wide ownership frequency.

Three base kinds are found by pattern.  The method adds candidates without a
telling context: long tokens that mix letters and digits.  Every candidate's
hash is counted over the distinct repositories and owners that hold it.  A value
that many owners hold is a copied *example*; one that a single owner holds in a
few repositories and that looks random is *live*.  Live context-free tokens
become spans of kind ``owned``; base spans stay whatever their class is.
Values leave the scan only as hashes.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import Stored

KINDS = ("assign", "access", "hex", "owned")
_WORDS = ("password", "passwd", "secret", "token", "api")
_ASSIGN = re.compile(
    r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_LOOSE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_PLACEHOLDER = re.compile(r"(?ai)example|changeme|placeholder|your|dummy|sample|xxxx|1234567")

_SPAN = pa.struct(
    [("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.int64()), ("random", pa.bool_())]
)


def looks_random(value: str, least_bits: float = 3.0) -> bool:
    """Entropy of the characters, a digit among them, and no placeholder word."""
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    return bits >= least_bits and any("0" <= c <= "9" for c in value) and not _PLACEHOLDER.search(value)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) of the base kinds, code points, end exclusive."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(0, m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(1, m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(2, m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    return out


def loose_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Long tokens with letters and digits that overlap no base span."""
    out = []
    starts, ends = sorted(b[1] for b in base), sorted(b[2] for b in base)
    for m in _LOOSE.finditer(text):
        value, start, end = m[0], m.start(), m.end()
        if any("0" <= c <= "9" for c in value) and any(c.isalpha() for c in value):
            # every base span begins at the end or later, or ends at the start or before
            if bisect.bisect_left(starts, end) == bisect.bisect_right(ends, start):
                out.append((3, start, end, value))
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, rows = [0], []
        for scalar in batch.column(3):
            text = scalar.as_py() or ""
            base = base_spans(text)
            for kind, start, end, value in base + loose_spans(text, base):
                digest = xxhash.xxh3_64_intdigest(value.encode())
                rows.append((kind, start, end, digest - (1 << 64) * (digest >> 63), looks_random(value)))
            offsets.append(len(rows))
        columns = list(zip(*rows)) or [()] * 5
        spans = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SPAN)], fields=list(_SPAN))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)],
            names=["doc_id", "repo", "owner", "found"],
        )


def ownership(candidates: DataFrame) -> DataFrame:
    """``(value, n_repos, n_owners)`` from rows of (value, repo, owner).

    Each step is a map-side combined count, so a value that a third of all rows
    holds costs each map task one row an owner.
    """
    by_repo = candidates.groupBy("value", "owner", "repo").agg(F.lit(1).alias("one"))
    by_owner = by_repo.groupBy("value", "owner").agg(F.count("*").alias("repos"))
    return by_owner.groupBy("value").agg(F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"))


def scan_secrets(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id",
    owner_col: str = "source", example_owners: int = 3, live_repos: int = 5,
) -> DataFrame:
    """Spans and ownership classes, one row for each row of ``df``.

    Columns: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned
    (spans the method adds), n_example (base spans whose value at least
    ``example_owners`` owners hold) and n_live (base spans that look random and
    belong to one owner in at most ``live_repos`` repositories).  Defined
    results: a null text is empty; a null owner or repository counts as one;
    repeated rows keep their own results and count once as a repository; an
    empty table gives an empty result; other columns are not read.
    """
    narrow = df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(repo_col).cast("string").alias("repo"),
        F.col(owner_col).cast("string").alias("owner"), F.col(text_col).cast("string").alias("text"),
    )
    found = narrow.mapInArrow(
        _scan,
        "doc_id long, repo string, owner string, "
        "found array<struct<kind int, start int, end int, value long, random boolean>>",
    )
    docs = Stored(found.withColumn("row", F.monotonically_increasing_id()), "secrets").df
    each = docs.where(F.size("found") > 0).select(
        "row", F.coalesce("repo", F.lit("")).alias("repo"), F.coalesce("owner", F.lit("")).alias("owner"),
        F.explode("found").alias("x"),
    ).select("row", "repo", "owner", "x.*")
    live = F.col("random") & (F.col("n_owners") == 1) & (F.col("n_repos") <= live_repos)
    judged = each.join(ownership(each), "value").groupBy("row").agg(
        F.collect_list(F.when((F.col("kind") == 3) & live, F.struct("start", "kind", "end"))).alias("owned"),
        F.count_if((F.col("kind") < 3) & (F.col("n_owners") >= example_owners)).alias("n_example"),
        F.count_if((F.col("kind") < 3) & live).alias("n_live"),
    )
    names = F.array(*map(F.lit, KINDS))

    def joined(spans):
        return F.array_join(
            F.transform(
                F.array_sort(spans),
                lambda s: F.concat_ws(
                    ":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string")
                ),
            ),
            ",",
        )

    base = F.transform(
        F.filter("found", lambda s: s["kind"] < 3),
        lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")),
    )
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return docs.join(judged, "row", "left").select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.concat(base, F.coalesce("owned", none))).alias("spans"),
        F.coalesce(F.size("owned"), F.lit(0)).cast("long").alias("n_owned"),
        F.coalesce("n_example", F.lit(0)).alias("n_example"), F.coalesce("n_live", F.lit(0)).alias("n_live"),
    )
