"""Jobs whose cost once grew faster than their input."""

import datetime
import random

import oracle
import pytest
from pyspark.sql import functions as F

from noteloom.functions import ids as ids_
from noteloom.operators import graph, keyword
from noteloom.plans import catalog
from noteloom.plans import projection as P
from noteloom.sources import shared
from noteloom.streaming import watch


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("burst", [3, 1 << 30])
def test_a_batch_is_cut_into_sessions_in_many_tasks(spark, burst, monkeypatch):
    monkeypatch.setattr(watch, "SLOTS", 4, raising=False)  # sessions go over the ends of blocks
    rnd = random.Random(0)
    zero = datetime.datetime(2024, 1, 1)
    rows = [(root, zero + datetime.timedelta(milliseconds=rnd.choice([0, 250, 500]) + 500 * rnd.randrange(-40, 900)), rnd.choice("abcdef"), rnd.choice([False] * 30 + [True, None])) for root in ("x", "y", None) for _ in range(400)]
    rows += [("z", zero + datetime.timedelta(seconds=k), "a", False) for k in range(20)]  # each the whole gap after the one before
    want = []
    for root in ("x", "y", None, "z"):
        sessions = []
        for _, t, path, dropped in sorted((r for r in rows if r[0] == root), key=lambda r: r[1]):
            if not sessions or t - sessions[-1][-1][0] > datetime.timedelta(seconds=1):
                sessions.append([])
            sessions[-1].append((t, path, dropped))
        for s in sessions:
            paths = sorted({p for _, p, _ in s})
            bulk = any(d for *_, d in s) or len(paths) >= burst
            want.append((root, s[0][0], s[-1][0] + datetime.timedelta(seconds=1), "bulk" if bulk else "changed", len(paths), [] if bulk else paths))
    events = spark.createDataFrame(rows, "root string, ts timestamp, path string, dropped boolean")
    found = watch.debounced(events, "1 second", burst)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert len(want) > 40 and "Sessions" not in plan(found)  # a session's rows are never put in one task
    assert found.select("n_paths").schema == watch.debounced(events.limit(0), "1 second", burst).select("n_paths").schema and watch.debounced(events.limit(0)).count() == 0


def test_a_row_counts_its_own_terms(spark):
    rows = [(1, "Red fox", "Fox, fox! ÉTÉ x_y"), (2, None, ""), (3, "", "a " * 1000 + "b"), (4, "only head", None)]
    chunks = spark.createDataFrame(rows, "chunk_id long, heading string, content string")
    want = {("red", 1, 1, 0), ("fox", 1, 1, 2), ("ete", 1, 0, 1), ("x", 1, 0, 1), ("y", 1, 0, 1), ("a", 3, 0, 1000), ("b", 3, 0, 1), ("only", 4, 1, 0), ("head", 4, 1, 0)}
    found = keyword.postings(chunks)
    assert found.count() == len(want) and set(map(tuple, found.collect())) == want
    assert "Exchange" not in plan(found) and "Exchange" not in plan(keyword.posted(chunks))  # no count is moved
    assert set(map(tuple, keyword.postings(chunks, only=["fox", "b"]).collect())) == {("fox", 1, 1, 2), ("b", 3, 0, 1)} and keyword.postings(chunks, only=[]).count() == 0
    assert {(r.chunk_id, r.dl, r.version) for r in keyword.posted(chunks, version=F.lit("v")).collect()} == {(1, 7, "v"), (3, 1001, "v"), (4, 2, "v")}
    twice = chunks.union(chunks.filter("chunk_id = 1"))  # rows of one chunk are added up
    assert set(map(tuple, keyword.postings(twice).collect())) == {(t, c, h * (1 + (c == 1)), n * (1 + (c == 1))) for t, c, h, n in want}
    assert keyword.posted(twice).filter("term = 'fox'").select("tf_heading", "tf_content").collect() == [(2, 4)]


def test_small_batches_lose_no_counts(spark, monkeypatch):
    monkeypatch.setattr(keyword, "COUNTS", 1, raising=False)
    chunks = spark.range(300).selectExpr("id AS chunk_id", "'h' AS heading", "concat('x ', id, ' y') AS content").coalesce(1)
    assert keyword.postings(chunks).count() == 1200 and keyword.doc_freq(keyword.postings(chunks)).filter("df = 300").count() == 3


def test_an_index_is_written_in_equal_shares(spark, tmp_path):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.shuffle.partitions", 4 * keyword.BUCKETS)
    try:
        rows = keyword.posted(spark.range(4000).selectExpr("id AS chunk_id", "'' AS heading", "concat_ws(' ', transform(sequence(1, 64), k -> concat('t', k))) AS content"))
        keyword.write_index(rows, str(tmp_path / "index"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", n)
    files = sorted((tmp_path / "index").glob("bucket=*/*.parquet"))
    assert spark.read.parquet(str(tmp_path / "index")).count() == 64 * 4000
    written = {p.name.split("-")[1] for p in files}  # the tasks
    assert len(written) == len(files) == 4 * len({p.parent for p in files})  # one file a task, so that no task has several buckets' rows


@pytest.mark.parametrize("few", [200_000, 3])  # keys at hand, and keys in tables
def test_rows_near_entities_are_all_that_touch_them(spark, few, monkeypatch, tmp_path):
    monkeypatch.setattr(shared, "FEW", few, raising=False)
    monkeypatch.setitem(shared._own, "at", str(tmp_path))
    whole = P.tables(spark, oracle.SF)
    relations, mentions = P.relations(whole), P.mentions(whole)
    asked = [("part-of", 3), ("uses", 3), ("related-to", 3)]  # suppliers, customers, nations, regions and parts among their ends
    ends = [r for kind, n in asked for r in relations.filter(F.col("type") == kind).orderBy("relation_id").limit(n).collect()]
    ids = spark.createDataFrame([(x,) for x in sorted({x for r in ends for x in (r.source_id, r.target_id)})], "entity_id string")
    near = P.near(spark, oracle.SF, ids)
    known = {r.entity_id for r in ids.collect()}
    touching = lambda df: sorted(tuple(r) for r in df.collect() if {r.source_id, r.target_id} & known)
    assert touching(P.relations(near).select(relations.columns)) == touching(relations)
    assert sorted(map(tuple, P.mentions(near).join(ids, "entity_id", "left_semi").collect())) == sorted(map(tuple, mentions.join(ids, "entity_id", "left_semi").collect()))
    assert near("lineitem").count() < whole("lineitem").count() / 2
    orders = whole("orders").filter("o_orderkey < 7").select("o_orderkey")
    want = mentions.join(orders.select(ids_.digest(F.lit("chunk"), F.col("o_orderkey").cast("string")).alias("chunk_id")), "chunk_id", "left_semi").select(mentions.columns)
    assert sorted(map(tuple, P.mentions(P.near_orders(spark, oracle.SF, orders)).collect())) == sorted(map(tuple, want.collect())) != []


@pytest.mark.parametrize("name", ["graph_neighbors", "graph_chunk_rank", "graph_entity_lookup", "graph_chunk_seeds"])
def test_a_question_about_few_entities_does_not_shuffle_all_lines(spark, name):
    assert "lineitem" not in plan(catalog.QUERIES[name](spark, oracle.SF))  # it was scanned for the keys asked for, and nothing else


def test_entities_of_one_id_are_all_orphans(spark):
    entities = spark.createDataFrame([("1", "a"), ("1", "a"), ("1", "b"), ("2", "c"), ("3", "d"), ("4", "e")], "entity_id string, canonical_name string")
    mentions = spark.createDataFrame([("2",), ("2",), ("9",)], "entity_id string")
    relations = spark.createDataFrame([("3", "9")], "source_id string, target_id string")
    assert sorted(map(tuple, graph.orphans(entities, mentions, relations).collect())) == [("1", "a"), ("1", "a"), ("1", "b"), ("4", "e")]


def test_equal_relations_are_all_neighbors(spark):
    rows = [("r", "1", "2"), ("r", "1", "2"), ("q", "2", "1"), ("p", "2", "3"), ("o", "1", "1")]
    relations = spark.createDataFrame(rows, "relation_id string, source_id string, target_id string")
    seeds = spark.createDataFrame([("1",), ("1",)], "entity_id string")
    assert sorted(map(tuple, graph.neighbors(relations, seeds).collect())) == sorted(r for r in rows if r[0] != "p")
