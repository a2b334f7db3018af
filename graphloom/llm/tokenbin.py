"""Token ids in binary shards with a minimal perfect hash index.

A shard is two files.  ``*.ids`` is the raw payload: the ids of its documents in
ascending key order, little-endian, two bytes each if the vocabulary fits and
four otherwise.  ``*.idx`` is an npz archive: ``meta`` (number of documents with
a null key, width of an id), ``offsets`` (ids before each document, and the
total), ``keys`` (of each document, null keys first), and the index itself:
``displace`` for each bucket, and for each slot the key's 32-bit fingerprint
(``prints``), its first document and its number of documents.

The index is a hash-and-displace minimal perfect hash: n distinct keys fill
exactly n slots, a lookup reads one displacement and one slot, and the stored
fingerprint tells foreign keys apart.
"""

from __future__ import annotations

import io
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import Stored, new_path, sweep

#: Distinct pieces that a worker remembers (beyond them it forgets those unused for longest), and characters encoded together.
REMEMBERED, TOGETHER = 1_000_000, 1_000_000
#: Keys to a bucket of the perfect hash, on average, displacements tried at a time, and UTF-8 bytes of the texts of a shard.
BUCKET, TRIED, SHARD_BYTES = 4, 128, 256 << 20

#: A piece starts where white space follows other characters, or where one of the
#: listed signs follows a run of Latin letters; no token crosses either place.
_PIECE = re.compile(r"[ \n\r\t]*[A-Za-zÀ-ÖØ-öø-ɏ]+(?=[ \n\r\t!-@\[-`{-~]|\Z)|[ \n\r\t]*[^ \n\r\t]+|[ \n\r\t]+")
_OTHER_SPACE = re.compile(r"[^\S \n\r\t]")


class _Numbers(dict):
    """Numbers of pieces; a new one gets the next and is listed in ``new``."""

    def __init__(self, pieces=()):
        super().__init__(zip(pieces, range(len(pieces))))
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.new.append(piece)
        return n


class Encoder:
    """Encodes whole texts with a byte-level BPE file of the tokenizers library.

    The library's splitting rule always separates at a change from a visible
    character to white space and from letters to other signs, so equal pieces
    between such places have equal ids and are encoded once.  A text with other
    white space than space, tab and line ends, or with the string of an added
    token (which the library takes as that token), is encoded in one call.

    Pieces have numbers; ``start`` and ``size`` say where the ids of each lie in
    ``ids``, so the ids of many texts are gathered at once.
    """

    _kept: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.numbers = _Numbers()
        self.ids = np.empty(1 << 16, dtype=self.kind)
        self.filled = 0
        self.start, self.size, self.used = (np.zeros(1 << 16, dtype=np.int64) for _ in range(3))
        self.turn = 0
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        #: Bytes of each id: a byte-level token has one character for each.
        self.bytes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, number in vocabulary.items():
            self.bytes[number] = len(token)

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, dtype=self.kind) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _store(self, numbers: list[int], ids: np.ndarray, ends: np.ndarray) -> None:
        """Ids of several pieces, each up to its end."""
        if self.filled + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.filled], np.empty(self.filled + len(ids), dtype=self.kind)])
        self.ids[self.filled : self.filled + len(ids)] = ids
        first = np.append(0, ends[:-1])
        self.start[numbers], self.size[numbers] = self.filled + first, ends - first
        self.filled += len(ids)

    def _learn(self) -> None:
        """Encode new pieces, many in one text, and cut the ids where the pieces end.

        Only pieces that start with white space and end with a visible character
        are put together: no token crosses such places.
        """
        pieces, self.numbers.new = self.numbers.new, []
        base = len(self.numbers) - len(pieces)
        if len(self.numbers) > len(self.start):
            self.start, self.size, self.used = (np.append(x, np.zeros(len(self.numbers), dtype=np.int64)) for x in (self.start, self.size, self.used))
        space = " \n\r\t"
        inner = [i for i, p in enumerate(pieces) if p[0] in space and p[-1] not in space]
        alone = [i for i, p in enumerate(pieces) if not (p[0] in space and p[-1] not in space)]
        groups = [inner[i : i + 256] for i in range(0, len(inner), 256)]
        for group, ids in zip(groups, self._whole(["".join([pieces[i] for i in g]) for g in groups])):
            ends = np.cumsum(self.bytes[ids])
            wanted = np.cumsum([len(pieces[i].encode()) for i in group])
            cut = np.searchsorted(ends, wanted) + 1
            if cut[-1] != len(ids) or (ends[cut - 1] != wanted).any():
                alone += group
            else:
                self._store([base + i for i in group], ids, cut)
        for i, ids in zip(alone, self._whole([pieces[i] for i in alone])):
            self._store([base + i], ids, np.array([len(ids)]))

    def _forget(self) -> None:
        """Keep the half of the pieces that were used last."""
        n = len(self.numbers)
        kept = np.sort(np.argsort(self.used[:n], kind="stable")[n // 2 :])
        names = list(self.numbers)
        size = self.size[kept]
        ids = self.ids[_spread(self.start[kept], size)]
        self.numbers = _Numbers([names[i] for i in kept.tolist()])
        self.ids, self.filled = ids, len(ids)
        self.start, self.size, self.used = np.cumsum(size) - size, size, self.used[kept]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; a null text has none."""
        whole = [bool(t) and (_OTHER_SPACE.search(t) is not None or any(x in t for x in self.added)) for t in texts]
        if len(self.numbers) > REMEMBERED:
            self._forget()
        number = self.numbers.__getitem__
        found = []
        for t, w in zip(texts, whole):
            pieces = _PIECE.findall(t) if t and not w else []
            found.append(np.fromiter(map(number, pieces), dtype=np.int64, count=len(pieces)))
        self._learn()
        every = np.concatenate(found) if found else np.empty(0, dtype=np.int64)
        self.turn += 1
        self.used[every] = self.turn
        size = self.size[every]
        raw = self.ids[_spread(self.start[every], size)].tobytes()
        ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum([len(f) for f in found]))] * self.kind.itemsize
        out = [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        return [self._whole([t])[0].tobytes() if w else x for t, w, x in zip(texts, whole, out)]


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, one run after the other."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


def _mix(keys: np.ndarray, salt: int | np.ndarray) -> np.ndarray:
    """A 64-bit mixing of int64 keys with a salt each (finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(np.uint64) + np.asarray(salt, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _slots(keys: np.ndarray, displace: np.ndarray, n: int) -> np.ndarray:
    """Slots of keys; a negative displacement names the slot itself."""
    moved = _mix(keys, np.maximum(displace, 0) + 8) % np.uint64(n)
    return np.where(displace < 0, -displace - 1, moved.astype(np.int64))


def build_index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(displace, slot of each key)`` for distinct keys; the slots are 0 to n-1."""
    n = len(keys)
    displace = np.zeros(max(1, -(-n // BUCKET)), dtype=np.int64)
    slot = np.zeros(n, dtype=np.int64)
    if not n:
        return displace, slot
    bucket = (_mix(keys, 1) % np.uint64(len(displace))).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    members = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)
    taken = np.zeros(n, dtype=bool)
    alone = []
    for own in sorted(members, key=len, reverse=True):
        if len(own) == 1:
            alone.append(own[0])
            continue
        d = tried = 0
        while tried is not None:  # TRIED displacements at a time; the first that fits
            at = (_mix(keys[own][None, :], np.arange(tried, tried + TRIED)[:, None] + 8) % np.uint64(n)).astype(np.int64)
            near = np.sort(at, axis=1)
            fits = np.flatnonzero(~taken[at].any(1) & (near[:, 1:] != near[:, :-1]).all(1))
            d, tried = (tried + int(fits[0]), None) if len(fits) else (0, tried + TRIED)
        at = _slots(keys[own], np.full(len(own), d), n)
        displace[bucket[own[0]]] = d
        slot[own] = at
        taken[at] = True
    for k, free in zip(alone, np.flatnonzero(~taken)):
        displace[bucket[k]], slot[k] = -free - 1, free
    return displace, slot


def index_bytes(keys: list[int | None], offsets: list[int], width: int) -> bytes:
    """The ``.idx`` file for documents in ascending key order, null keys first."""
    nulls = sum(k is None for k in keys)
    named = np.array(keys[nulls:], dtype=np.int64)
    distinct, first, many = np.unique(named, return_index=True, return_counts=True)
    displace, slot = build_index(distinct)
    put = np.argsort(slot)
    out = io.BytesIO()
    np.savez(
        out, meta=np.array([nulls, width]), offsets=np.array(offsets, dtype=np.uint64), keys=named,
        displace=displace, prints=(_mix(distinct, 4)[put] >> np.uint64(32)).astype(np.uint32),
        first=(first + nulls)[put].astype(np.uint64), many=many[put].astype(np.uint32),
    )
    return out.getvalue()


class Shard:
    """Keyed and sequential access to one shard's files."""

    def __init__(self, stem: str):
        self.fs, self.stem = pafs.FileSystem.from_uri(stem)
        with self.fs.open_input_file(self.stem + ".idx") as f:
            x = dict(np.load(io.BytesIO(f.read())))
        self.nulls, self.width = map(int, x["meta"])
        self.offsets, self.keys, self.displace = x["offsets"].astype(np.int64), x["keys"], x["displace"]
        self.prints, self.first, self.many = x["prints"], x["first"].astype(np.int64), x["many"]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First document and number of documents of each key; 0 documents if it isn't here."""
        keys = np.asarray(keys, dtype=np.int64)
        if not len(self.prints):
            return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        bucket = (_mix(keys, 1) % np.uint64(len(self.displace))).astype(np.int64)
        at = _slots(keys, self.displace[bucket], len(self.prints))
        here = self.prints[at] == (_mix(keys, 4) >> np.uint64(32)).astype(np.uint32)
        return np.where(here, self.first[at], 0), np.where(here, self.many[at], 0).astype(np.int64)

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of every document with this key: one index probe and one read each."""
        first, many = (int(x[0]) for x in self.find(np.array([key])))
        out = []
        with self.fs.open_input_file(self.stem + ".ids") as f:
            for i in range(first, first + many):
                low, high = int(self.offsets[i]) * self.width, int(self.offsets[i + 1]) * self.width
                out.append(np.frombuffer(f.read_at(high - low, low), dtype=f"<u{self.width}").astype("<u4"))
        return out

    def scan(self) -> Iterator[np.ndarray]:
        """The ids of all documents in order, read in one pass."""
        with self.fs.open_input_stream(self.stem + ".ids", buffer_size=1 << 22) as f:
            for many in np.diff(self.offsets):
                yield np.frombuffer(f.read(int(many) * self.width), dtype=f"<u{self.width}").astype("<u4")


def write_shards(
    df: DataFrame, to: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0
) -> list[tuple[str, int, int]]:
    """Write ``df`` as shards under ``to`` in ascending id order: (stem, documents, ids) of each.

    Rows are range-partitioned by id (ties by the text's hash), one shard for
    each partition, and as many that one has SHARD_BYTES of text or less on
    average, so a task holds the keys of so much text only.  A task writes files under a name of its own attempt and
    only the names of the attempts that Spark commits are returned, so lost and
    repeated tasks leave unread files at worst.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        end = np.array([end_id], dtype=encoder.kind).tobytes()
        number = TaskContext.get().partitionId()
        stem = f"{to}/shard-{number:05d}-{uuid.uuid4().hex[:12]}"
        keys: list[int | None] = []
        offsets = [0]
        fs, path = pafs.FileSystem.from_uri(stem)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        sink = None

        def together() -> Iterator[tuple[list[int | None], list[str | None]]]:
            own: list[int | None] = []
            texts: list[str | None] = []
            size = 0
            for batch in batches:
                for key, text in zip(*batch.columns[:2]):
                    own.append(key.as_py())
                    texts.append(text.as_py())
                    size += len(texts[-1] or "")
                    if size > TOGETHER:
                        yield own, texts
                        own, texts, size = [], [], 0
            if own:
                yield own, texts

        for own, texts in together():
            sink = sink or fs.open_output_stream(path + ".ids", buffer_size=1 << 22)
            for key, found in zip(own, encoder.encode(texts)):
                ids = found + end
                sink.write(ids)
                keys.append(key)
                offsets.append(offsets[-1] + len(ids) // encoder.kind.itemsize)
        if sink:
            sink.close()
            with fs.open_output_stream(path + ".idx") as f:
                f.write(index_bytes(keys, offsets, encoder.kind.itemsize))
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([stem]), pa.array([len(keys)]), pa.array([offsets[-1]])],
                names=["shard", "stem", "docs", "ids"],
            )

    narrow = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    size = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    ranged = narrow.repartitionByRange(n, *order).sortWithinPartitions(*order)
    listed = Stored(ranged.mapInArrow(run, "shard long, stem string, docs long, ids long"), "shards")
    rows = sorted(listed.df.collect())  # one row for each shard
    listed.drop()
    sweep(df.sparkSession)
    return [(r.stem, r.docs, r.ids) for r in rows]


def read_shards(df: DataFrame, shards: list[tuple[str, int, int]]) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` from the files, every key looked up in its index."""
    spark = df.sparkSession
    starts = np.cumsum([0, *(x[2] for x in shards)]).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stem, start in zip(*(c.to_pylist() for c in batch.columns)):
                shard = Shard(stem)
                first, many = shard.find(shard.keys)
                place = np.arange(len(shard.keys)) + shard.nulls
                if not ((first <= place) & (place < first + many)).all():
                    raise ValueError(f"{stem}: a key isn't found at its place")
                crcs = [zlib.crc32(ids.tobytes()) for ids in shard.scan()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([None] * shard.nulls + shard.keys.tolist(), pa.int64()),
                        pa.array(shard.offsets[:-1] + start), pa.array(np.diff(shard.offsets)),
                        pa.array(crcs, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    listed = spark.createDataFrame([(x[0], s) for x, s in zip(shards, starts)], "stem string, start long")
    spread = listed.repartition(max(1, len(shards)))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digest(
    df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", to: str | None = None
) -> DataFrame:
    """Write all texts as shards and return what reading them back gives, a row for each row.

    Defined results: a null or empty text has the end id alone; null ids come
    first; rows that share an id follow each other in the order of their texts'
    hashes and each has its own row; an empty table writes nothing and gives an
    empty result; other columns are not read.
    """
    to = to or new_path(df.sparkSession, "tokens")
    return read_shards(df, write_shards(df, to, tokenizer, id_col, text_col))
