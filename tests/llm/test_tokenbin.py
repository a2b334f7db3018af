import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from graphloom.llm import tokenbin as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


def whole(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize(
    "text",
    ["", "a", "Hello  world", " two\n\n three ", "tab\there\r\nand  \t  more", "it's they'll  'd", "x y  z",
     "\x1c a\x1fb ", "ünï çé 日本 語  \n", "a<|endoftext|>b <|endoftext|> c", "   \n  ", "12 345,67!! ?? ..."],
)
def test_pieces_encode_like_the_whole_text(text):
    e = T.Encoder(PATH)
    for _ in range(2):
        assert np.frombuffer(e.encode([text])[0], e.kind).tolist() == whole(text)


def test_random_texts_encode_like_whole_ones(monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 300)  # pieces are forgotten again and again
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    rng = random.Random(8)
    signs = ["a", "Be", "é", "ŵ", "Д", "ab", "1", "23", "'s", "'", "ll", ",", ".", "-", "_", "%%%", " ", " ", " ", "  ", "\n", "\t", "\r\n", "ß", "²", "日", "\u0301", "\xa0", "<|end"]
    e = T.Encoder(PATH)
    for _ in range(60):
        texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(40)] + [None]
        want = [x.ids for x in plain.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert [np.frombuffer(x, e.kind).tolist() for x in e.encode(texts)] == want


@pytest.mark.parametrize("n", [0, 1, 2, 7, 1000])
def test_perfect_hash_is_minimal(n):
    rng = random.Random(n)
    keys = np.unique(np.array([rng.getrandbits(63) * rng.choice((-1, 1)) for _ in range(n)], dtype=np.int64))
    displace, slot = T.build_index(keys)
    assert sorted(slot.tolist()) == list(range(len(keys)))
    if n:
        bucket = (T._mix(keys, 1) % np.uint64(len(displace))).astype(int)
        assert T._slots(keys, displace[bucket], len(keys)).tolist() == slot.tolist()


def test_round_trip(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i * 7 - 50, " ".join(rng.choice(["the", "Erly", "tion,", "\n", "é"]) for _ in range(rng.randrange(60))), 1)
            for i in range(120)]
    rows += [(None, "no key", 1), (None, None, 1), (7, "same key", 1), (7, "same key too", 1), (10**15, "", 1),
             (10**15 + 1, "word " * 20000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    to = f"file://{tmp_path}/shards"
    shards = T.write_shards(df, to, PATH)
    got = T.read_shards(df, shards).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted(
        (k is not None, k or 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        for k, t, _ in rows for ids in [whole(t) + [0]]
    )
    got.sort(key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    opened = [T.Shard(s) for s, _, _ in shards]
    for k in (7, -50, 10**15):
        found = sorted(tuple(x.tolist()) for s in opened for x in s.get(k))
        assert found == sorted(tuple(whole(t) + [0]) for i, t, _ in rows if i == k)
    assert all(not len(s.get(123456789)) for s in opened)


def test_empty_table(spark):
    assert T.token_digest(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
