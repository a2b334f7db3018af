from graphloom.sources.store import Store, json_rows
from graphloom.streaming.sources import stream_graphs


def test_store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/db")
    make = lambda *rows: spark.createDataFrame(list(rows), "k string, v int")
    rows = lambda: sorted(map(tuple, s.get("c").collect()))
    assert s.get("c") is None
    s.put("c", make(("a", 1), ("b", 2)))
    s.upsert("c", make(("b", 3), ("c", 4)), ["k"])
    assert rows() == [("a", 1), ("b", 3), ("c", 4)]
    s.append("c", make(("a", 1)))
    assert rows() == [("a", 1), ("a", 1), ("b", 3), ("c", 4)]
    s.dump("c", f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").count() == 4
    s.clear("c")
    assert s.get("c") is None
    assert json_rows(make(("a", 1))).first().json == '{"k":"a","v":1}'


def test_stream(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    (tmp_path / "src").mkdir()
    for name in ("One", "Two"):
        (tmp_path / "src" / f"{name}.java").write_text(f"class {name} {{ void m() {{ }} }}")
        stream_graphs(spark, src, out, check).awaitTermination(120)
    got = spark.read.parquet(out).where("rel = 'class'").select("name").collect()
    assert sorted(r.name for r in got) == ["One", "Two"]
