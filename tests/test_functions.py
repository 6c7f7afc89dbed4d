import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from noteloom.functions import ids
from noteloom.functions import providers as P
from noteloom.functions import vectors as V
from noteloom.operators import diff, fusion, graph, keyword, knn, queue, versions
from noteloom.sources import markdown as M
from noteloom.sources.corpus import Config
from noteloom.streaming import watch

NOTE = """---
title: Storage notes
tags: [Alpha, alpha, beta]
alias: The store
made: 2024-01-02
n: 3
---
Intro line with [a link](https://x.example.com/a) and ![pic](img/p.png "t").

# Storage notes

First part.

## Layout

```
# not a heading
```

### Deep

Deep text.

Other
-----

> # quoted

- # listed

Last.
"""


def test_names_have_two_keys(spark):
    names = ["  Crème-Brûlée / Tokens_x ", "Boxes & policies", "bus class gases", "A.B's", "ÀÉÎ"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(ids.normalize_name(F.col("n")), ids.match_key(F.col("n"))).collect()
    assert [r[0] for r in df] == [ids.normalize_py(n) for n in names] and [r[1] for r in df] == [ids.match_key_py(n) for n in names]
    assert df[0][0] == "creme brulee tokens x" and df[1][1] == "box policy" and df[2][1] == "bus class gas"


def test_markdown():
    p = M.parse(NOTE, "stem")
    assert p.title == "Storage notes" and p.metadata["tags"] == ["Alpha", "beta"] and p.metadata["aliases"] == ["The store"]
    assert p.metadata["additional"] == {"made": "2024-01-02", "n": 3.0}
    assert p.links == ["https://x.example.com/a", "img/p.png"]
    assert [h for h, _ in p.sections] == [["Storage notes"], ["Storage notes"], ["Storage notes", "Layout"], ["Storage notes", "Layout", "Deep"], ["Storage notes", "Other"]]
    assert "# not a heading" in p.sections[2][1] and p.sections[4][1].endswith("Last.")
    assert M.parse("---\na: b\nno end", "x").sections[0][1].startswith("---") and M.parse("---\n- 1\n---\nx", "s").warnings
    assert M.parse("", "stem").title == "stem" and M.parse("# A\n## B\ntext").sections == [(["A", "B"], "text")]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text("ab.\n `~#", max_size=60), max_size=6))
def test_chunks_lose_no_words(parts):
    text = "\n\n".join(parts)
    pieces = M.split(text, 5)
    assert " ".join(" ".join(pieces).split()) == " ".join(text.split())


def test_merge_and_split():
    assert M.merge([(["T"], "a"), (["T", "X"], "b"), (["T", "Y"], "c " * 60)], 50, 512) == [(["T"], f"a\n\n## X\n\nb\n\n## Y\n\n{'c ' * 60}")]
    fence = "```\n" + "x y z\n" * 40 + "```"
    assert fence in M.split(f"before\n\n{fence}\n\nafter", 20)
    assert all(ids.estimate_py(x) <= 120 for x in M.split("\n\n".join(["w " * 60] * 10), 120))


def test_vectors(spark):
    V.register(spark)
    one = lambda e: spark.sql(f"SELECT {e}").first()[0]
    assert one("vec_distance_l2(array(0F, 3F), array(4F, 0F))") == 5.0 and one("vec_distance_hamming(X'0F', X'F1')") == 7
    assert str(one("vec_distance_cosine(array(0F), array(1F))")) == "nan" and one("vec_to_json(vec_f32('[1, 2.5]'))") == "[1.000000,2.500000]"
    df = spark.createDataFrame([([127, -128, 5], [1, -1, 1])], "a array<tinyint>, b array<tinyint>")
    assert df.select(V.vec_add_int8(F.col("a"), F.col("b"))).first()[0] == [-128, 127, 6] and df.select(V.vec_sub_int8(F.col("b"), F.col("a"))).first()[0] == [-126, 127, -4]
    assert one("vec_type(typeof(vec_f32('[1]')))") == "float32" and one("vec_type(typeof(vec_int8('[1, -2]')))") == "int8" and one("vec_type(typeof(vec_bit(X'01')))") == "bit"
    assert one("vec_quantize_int8(array(0F, 1F, -1F))") == [0, 127, -128] and one("vec_quantize_binary(vec_f32('[1,-1,0,2,0,0,0,3]'))") == [True, False, False, True, False, False, False, True]
    assert V.VERSION in one("vec_debug()") and str(one("vec_normalize(array(0F, 0F))")) == "[nan, nan]"
    for wrong in ("vec_distance_l2(array(1F), array(1F, 2F))", "vec_distance_hamming(X'0F', X'F1F1')", "vec_add(array(1F), array(1F, 2F))", "vec_slice(array(1F, 2F), 1, 3)", "vec_slice(array(1F, 2F), 1, 1)", "vec_f32('[]')", "vec_f32('x')", "vec_int8('[300]')", "vec_bit(X'')", "vec_quantize_binary(array(1F))", "vec_type('string')"):
        with pytest.raises(PySparkException):
            one(wrong)
    blob = spark.createDataFrame([(bytearray(np.array([1.5, -2], "<f4").tobytes()), bytearray(b"\x01\xff"))], "f binary, i binary").select(V.vec_f32_blob(F.col("f")).alias("x"), V.vec_int8_blob(F.col("i")).alias("y"), V.vec_to_json_bit(F.col("i")).alias("z"))
    assert blob.first().x == [1.5, -2.0] and blob.first().y == [1, -1] and blob.first().z == "[1,0,0,0,0,0,0,0,1,1,1,1,1,1,1,1]" and blob.select(V.vec_to_json_int8(F.col("y"))).first()[0] == "[1,-1]"
    bits = spark.createDataFrame([([1.0, -1.0, 0.0, 2.0, 0.0, 0.0, 0.0, 3.0],)], "v array<float>").select(V.pack_bits(V.vec_quantize_binary(F.col("v"))).alias("b"))
    assert bytes(bits.first()[0]) == bytes([0b10001001]) and bits.select(V.vec_length_bits(F.col("b"))).first()[0] == 8
    with pytest.raises(PySparkException):
        df.select(V.vec_distance_l2(F.col("a"), F.array(F.lit(1)))).collect()
    with pytest.raises(PySparkException):
        spark.createDataFrame([("[300]",)], "j string").select(V.vec_int8(F.col("j"))).collect()
    with pytest.raises(ValueError):
        V.vec_slice(F.col("a"), 2, 2)


def test_json_rounds_as_its_sql_does(spark):
    import duckdb

    V.register(spark)
    given = [0.0078125, 0.0234375, -0.0078125, 0.5, 1e20, -0.0, -1e-9, None]  # the first three are ties of six decimals
    want = duckdb.connect().execute("SELECT '[' || array_to_string(list_transform(?::FLOAT[], lambda x: printf('%.6f', x::DOUBLE)), ',') || ']'", [given]).fetchone()[0]
    df = spark.createDataFrame([(given,), (None,), ([float("nan")],)], "v array<float>")
    for column in (V.vec_to_json(F.col("v")), F.expr("vec_to_json(v)")):
        assert [r[0] for r in df.select(column).collect()] == [want, None, "[null]"]
    assert want.startswith("[0.007812,0.023438,-0.007812,")
    exact = spark.createDataFrame([([5e-7, 123456789012.123456],)], "v array<double>").select(V.vec_to_json(F.col("v"))).first()[0]
    assert exact == "[0.000000,123456789012.123459]"


def test_knn_limits_and_table_definitions(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in knn.knn(v, [0.0, 0.0], 3).collect()] == [1, 2, 4] and knn.knn(v, [0.0, 0.0], 0).count() == 0
    with pytest.raises(ValueError):
        knn.knn(v, [0.0, 0.0], 4097)
    spec = knn.TableSpec.parse("id text primary key, e float[8] distance_metric=cosine, b bit[16], p text partition key, +note text, n int, chunk_size=64")
    assert (spec.key, spec.vectors[0].metric, spec.vectors[1].metric, spec.partitions, spec.auxiliary, spec.metadata, spec.chunk_size) == ("id", "cosine", "hamming", ["p"], ["note"], [("n", "int")], 64)
    for wrong in ("e float[0]", "e bit[9]", "n int", "e float[4], chunk_size=7"):
        with pytest.raises(ValueError):
            knn.TableSpec.parse(wrong)


def test_query_terms_and_stems():
    assert keyword.query_terms('What is the "NEAR" of a B+ tree?') == ["is", "near", "of", "tree"]
    assert keyword.query_terms("the and") == ["the", "and"] and keyword.query_terms("?!") == []
    words = "caresses ponies cats agreed plastered motoring hopping happy relational conditional digitizer triplicate hopeful adjustment controlling"
    assert [keyword.porter(w) for w in words.split()] == "caress poni cat agre plaster motor hop happi relat condit digit triplic hope adjust control".split()


def test_fusion_is_the_same_in_any_order(spark):
    a = spark.createDataFrame([(1, "keyword", 1), (2, "keyword", 2)], "chunk_id long, arm string, rank int")
    b = spark.createDataFrame([(2, "vector", 1), (3, "vector", 2)], "chunk_id long, arm string, rank int")
    one, two = (sorted(map(tuple, fusion.rrf(x).collect())) for x in ([a, b], [b, a]))
    assert one == two and max(one, key=lambda r: r[1])[0] == 2
    assert {r.chunk_id for r in fusion.rrf([a, b], {"keyword": 1.0, "vector": 0.0}).collect()} == {1, 2}


def test_queue(spark):
    jobs = queue.enqueue(spark.createDataFrame([], queue.SCHEMA), spark.createDataFrame([("embed", "a"), ("embed", "b"), ("embed", "a")], "kind string, target_id string"), 10.0)
    assert jobs.count() == 2 and queue.claimable(jobs, "embed", 1, 10.0).first().target_id == "a" and queue.claimable(jobs, "embed", 9, 9.0).count() == 0
    bad = spark.createDataFrame([("embed", "a", False, "x"), ("embed", "b", True, "y")], "kind string, target_id string, transient boolean, error string")
    for n in range(1, 4):
        jobs = queue.failed(jobs, bad, 10.0)
        a, b = jobs.orderBy("target_id").collect()
        assert a.attempts == n and a.state == ("failed" if n == 3 else "pending") and b.attempts == 0 and b.next_after == 12.0
    assert queue.retry_failed(jobs, 20.0).filter("state = 'pending' and attempts = 0").count() == 2
    assert queue.complete(jobs, bad.filter("target_id = 'a'")).count() == 1
    running = queue.mark_running(jobs, bad.select("kind", "target_id"))
    assert queue.depth(running).first().running == 2 and queue.depth(queue.reclaim(running)).first().pending == 2


def test_graph_rules(spark):
    raw = spark.createDataFrame([("c", 0, " A ", "person"), ("c", 1, "a", "Person"), ("c", 2, "B", "Concept"), ("c", 3, "C", "alien"), ("c", 4, "", "Person")], "chunk_id string, position int, name string, type string")
    e = graph.sanitized_entities(raw, F.lower("name"))
    assert sorted((r.name, r.type) for r in e.collect()) == [("A", "Person"), ("B", "Concept")]
    said = spark.createDataFrame([("c", "A", "USES", "b", 7.5), ("c", "a", "uses", "A", 0.5), ("c", "A", "uses", "C", 0.5), ("c", "A", "hates", "B", 0.5)], "chunk_id string, source string, type string, target string, confidence double")
    assert [(r.source, r.type, r.target, r.confidence) for r in graph.sanitized_relations(said, e, F.lower("source"), F.lower("target")).collect()] == [("A", "uses", "b", 1.0)]
    known = spark.createDataFrame([("1", "Person", "Ann", "ann"), ("2", "Concept", "Bob", "bob"), ("3", "Concept", "Cy", "cy")], "entity_id string, type string, canonical_name string, normalized_name string")
    alias = spark.createDataFrame([("1", "Annie", "annie")], "entity_id string, name string, normalized_name string")
    asked = spark.createDataFrame([(10, "annie", "Person", "n"), (11, "bob", "Person", "new11"), (12, "zed", "Concept", "new12"), (13, "yak", "Person", "new13")], "name_id long, key string, type string, new_id string")
    near = spark.createDataFrame([(12, "1", 0.0, 1), (12, "3", 0.01, 2), (13, "3", 0.0, 1), (11, "1", 0.0, 1)], "name_id long, entity_id string, distance double, rank int")
    assert {r.name_id: (r.entity_id, r.how) for r in graph.resolve(asked, known, alias, near).collect()} == {10: ("1", "exact"), 11: ("new11", "new"), 12: ("3", "similar"), 13: ("new13", "new")}


def test_renames_and_merges(spark):
    old = spark.createDataFrame([("1", "a.md", "h"), ("2", "b.md", "h"), ("3", "c.md", "k")], "document_id string, path string, content_hash string")
    new = spark.createDataFrame([("x.md", "h"), ("y.md", "h"), ("c.md", "k2")], "path string, content_hash string")
    assert {(r.path, r.outcome) for r in diff.documents(old, new).collect()} == {("x.md", "renamed"), ("y.md", "added"), ("b.md", "removed"), ("c.md", "modified")}
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "k int, v string, seq int")
    assert diff.last_wins(rows, ["k"], "seq").select("k", "v").first() == (1, "b")


def test_versions(spark):
    planned = spark.createDataFrame([("a", "reembed"), ("b", "rechunk")], "key string, action string")
    assert versions.widest(planned).first().action == "rechunk" and versions.widest(planned.limit(0)).first().action == "none"


def test_providers():
    x = P.HashEmbedder(8)
    v = x.embed(["a", "b", "a"])
    assert v[0] == v[2] != v[1] and abs(np.linalg.norm(v[0]) - 1) < 1e-6
    assert P.classify(None) is P.Transient and P.classify(503) is P.Transient and P.classify(404, True) is P.Transient and P.classify(400) is P.Permanent
    assert not P.HttpModel("http://127.0.0.1:9", "m", 1).health()["reachable"]
    assert P.extraction_schema(["A"], ["r"])["properties"]["entities"]["items"]["properties"]["type"] == {"type": "string", "enum": ["A"]}


def test_config(tmp_path):
    (tmp_path / ".noteloom.json").write_text('{"max_tokens": 100, "limit": 3}')
    c = Config.resolve(Config(roots=[str(tmp_path)], limit=7), home=str(tmp_path / "none"))
    assert (c.max_tokens, c.limit, c.min_tokens) == (100, 7, 64)
    (tmp_path / "bad.json").write_text('{"nonsense": 1}')
    with pytest.raises(ValueError):
        Config.resolve(explicit=str(tmp_path / "bad.json"))


def test_stream_equals_batch(spark, tmp_path):
    rows = [("vault", f"2024-01-01 00:00:{s:02d}", f"{p}.md", False) for s, p in ((1, "a"), (2, "b"), (3, "a"), (20, "c"), (40, "d"), (41, "e"))] + [("vault", "2024-01-01 00:10:00", "z.md", False)]
    events = spark.createDataFrame(rows, "root string, t string, path string, dropped boolean").selectExpr("root", "CAST(t AS TIMESTAMP) AS ts", "path", "dropped")
    events.write.parquet(str(tmp_path / "e"))
    want = sorted(map(tuple, watch.debounced(events, "5 seconds", 2).filter("start < '2024-01-01 00:05:00'").collect()))
    live = watch.stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")), "5 seconds", 2)
    q = live.writeStream.format("memory").queryName("batches").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("batches").collect())) == want and [r[3] for r in want] == ["bulk", "changed", "bulk"]
