import random

import corpus_pipeline as P
from graphloom.llm import mixing


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(2)
    vocab = {"en": ["the", "thing", "with", "wh", "eating", "ing"], "de": ["der", "schön", "nicht", "über", "keit", "ung"]}
    rows = []
    for i in range(200):
        lang = rng.choice(list(vocab))
        words = [rng.choice(vocab[lang]) + rng.choice(["", "en", "er", "is", "on"]) for _ in range(rng.randrange(20, 90))]
        rows.append((i, " ".join(words), lang, f"s{i % 3}", 0))
    item = "a benchmark question that nobody should ever see in any corpus at all"
    rows += [(300, "12345 %%% 678", "en", "s0", 0), (301, rows[5][1], "en", "s1", 0), (302, " ".join(rows[6][1].split()[:20]) + "\n" + item, "en", "s1", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in P.STAGES:
        at = stage(spark, at, str(tmp_path))
        at.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append([r.doc_id for r in at.select("doc_id").collect()])
        if name != "shards":
            assert at.columns == docs.columns
        if name == "decontaminate":
            taken = {r.doc_id: r.taken / r.size for r in mixing.mix(at).collect()}
    ids = {r[0] for r in rows}
    assert set(seen[0]) == ids - {300} and set(seen[1]) == ids - {300, 301} and set(seen[2]) == ids - {300, 301, 302}
    assert all(seen[3].count(i) == int(taken[i] + 0.5) for i in seen[2])
    assert sorted(seen[4]) == sorted(seen[3])
    assert sorted(r.doc_id for r in P.run(spark, str(tmp_path)).collect()) == sorted(seen[4])


def test_pipeline_on_an_empty_table_and_on_nulls(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, "a benchmark question that is long enough")], "item_id long, text string").write.parquet(f"{tmp_path}/a/benchmark.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/a/documents.parquet")
    assert P.run(spark, f"{tmp_path}/a").collect() == []
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/b/benchmark.parquet")
    rows = [(None, None, None, None, None), (1, None, "en", None, 0), (2, "the thing with the other thing", "en", None, 1), (None, "eating with the thing", "en", "s", None)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert {r.doc_id for r in P.run(spark, f"{tmp_path}/b").collect()} == {None, 2}
