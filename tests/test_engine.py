import json
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest

from noteloom import tools
from noteloom.engine import NO_VECTORS, Engine, Refused
from noteloom.functions import providers as P
from noteloom.operators import graph, keyword
from noteloom.sources import corpus
from noteloom.sources.corpus import Config
from noteloom.sources.store import Locked
from noteloom.streaming import watch

A = "---\ntitle: Harbour log\ntags: [sea, Boats]\naliases: [The log]\n---\n# Harbour log\n\nShips come and go.\n\n## Cranes\n\nThe crane lifts containers at dawn.\n\n## Tides\n\nTide tables are printed weekly.\n"
B = "---\ntitle: Kitchen\ntags: [food]\n---\n# Kitchen\n\nBread is baked with rye and water.\n"
FOUND = {
    "crane lifts": {"entities": [{"name": "Crane", "type": "component"}, {"name": "Dock Crew", "type": "Person"}, {"name": "x", "type": "alien"}], "relations": [{"source": "Dock Crew", "type": "uses", "target": "Crane", "confidence": 0.9}]},
    "Tide tables": {"entities": [{"name": "Cranes", "type": "Component"}, {"name": "Tide", "type": "Concept"}], "relations": [{"source": "Cranes", "type": "depends-on", "target": "Tide", "confidence": 3}]},
}


@pytest.fixture
def vault(spark, tmp_path):
    root = tmp_path / "vault"
    (root / "sub").mkdir(parents=True)
    (root / "a.md").write_text(A)
    (root / "sub" / "b.MD").write_text(B)
    (root / "c.draft.md").write_text("draft")
    (root / ".hidden.md").write_text("hidden")
    (root / "d.txt").write_text("no")
    config = Config(roots=[str(root)], store=str(tmp_path / "store"), ignore=["*.draft.md"], min_tokens=1, dimensions=8)
    engine = Engine(spark, str(tmp_path / "store"), config, extractor=P.FixtureExtractor(FOUND))
    yield root, engine, config
    engine.close()


def test_two_files_are_found(vault):
    root, engine, config = vault
    assert engine.sync() == {"added": 2}
    found = engine.search("crane containers")
    assert found.results.first().citation == "a.md — Harbour log > Cranes" and NO_VECTORS in found.degradations
    assert {r.citation for r in engine.search("cranes lifting").results.collect()} >= {"a.md — Harbour log > Cranes"}  # by stems
    with pytest.raises(Locked):
        Engine(engine.spark, config.store, config)


def test_life_of_a_vault(spark, vault, tmp_path):
    root, engine, config = vault
    assert engine.sync() == {"added": 2}
    assert engine.search("crane containers").degradations == [NO_VECTORS]
    assert engine.process_queues() == {"embedded": 4, "extracted": 4}
    d = engine.diagnostics()
    assert (d["documents"], d["chunks"], d["embedded"], d["extracted"], d["relations"], d["failures"]) == (2, 4, 4, 4, 2, [])
    # the plural is the same component, so both chunks hang together
    look = engine.lookup_entity("crane").collect()
    assert [(r.canonical_name, r.type, r.mentions) for r in look] == [("Crane", "Component", 2)]
    assert engine.lookup_entity("the log").first().canonical_name == "Harbour log"
    near, around = engine.traverse("Crane")
    crane = look[0].entity_id
    assert sorted((r.origin == crane, r.source, r.source_type, r.type, r.target, r.target_type) for r in near.collect()) == [(True, "Crane", "Component", "depends-on", "Tide", "Concept"), (True, "Dock Crew", "Person", "uses", "Crane", "Component")] and around.count() == 2
    full = engine.search("crane containers").results.first()
    assert full.graph_rank is not None and full.vector_rank is not None and full.matched == ["Crane"]
    assert {r.citation.split(" ")[0] for r in engine.search("bread crane", tags=["BOATS"]).results.collect()} == {"a.md"}
    assert engine.sync() == {"unchanged": 2} and engine.process_queues() == {"embedded": 0, "extracted": 0}
    got = engine.answer("How is bread baked?")
    assert got.text and any(c.startswith("sub/b.MD") for c in got.citations)
    assert "Crane (Component)" in tools.call(engine, "lookup", {"name": "crane"}) and "uses" in tools.call(engine, "traverse", {"name": "crane"}) and "a.md" in tools.call(engine, "search", {"query": "crane"})
    with pytest.raises(PermissionError):
        tools.call(engine, "answer", {"question": "x"}, tools.allowed("search, lookup"))
    # a rename keeps ids; an edit asks for one chunk again; what was derived from it is gone
    (root / "sub" / "b.MD").rename(root / "bread.md")
    (root / "a.md").write_text(A.replace("weekly", "daily"))
    assert engine.sync() == {"renamed": 1, "modified": 1}
    assert engine.diagnostics()["relations"] == 1 and engine.lookup_entity("tide").count() == 0
    assert engine.process_queues() == {"embedded": 1, "extracted": 1} and engine.diagnostics()["relations"] == 2
    # the index as it was added to holds what a rebuild would, and nothing of the former text is found
    live = engine._t("postings").join(engine._t("chunks").selectExpr("chunk_id", "posted version"), ["chunk_id", "version"], "left_semi")
    whole = keyword.posted(engine._t("chunks"), stem=True)
    columns = ["term", "chunk_id", "tf_heading", "tf_content", "dl"]
    assert sorted(map(tuple, live.select(columns).collect())) == sorted(map(tuple, whole.select(columns).collect()))
    assert not engine.search("weekly").results.filter("keyword_rank is not null").count()
    reader = Engine(spark, config.store, config, read_only=True)
    assert reader.search("rye").results.first().citation.startswith("bread.md")
    with pytest.raises(PermissionError):
        reader.sync()
    engine.remove(["a.md"])
    d = engine.diagnostics()
    assert (d["documents"], d["chunks"], d["entities"], d["relations"], d["mentions"]) == (1, 1, 0, 0, 0)
    engine.compact()
    assert engine.search("rye").results.count() == 1 and len(engine.store.paths("postings")) == 1


class Broken(P.HashEmbedder):
    def embed(self, texts):
        if any("rye" in t for t in texts):
            raise P.Permanent("poison")
        return super().embed(texts)


def test_failures_and_migrations(spark, vault, tmp_path):
    root, engine, config = vault
    engine.close()
    broken = Engine(spark, config.store, config, Broken(8), P.FixtureExtractor(FOUND))
    broken.sync()
    assert broken.process_queues() == {"embedded": 3, "extracted": 4}
    assert broken.diagnostics()["queues"]["embed"]["pending"] == 1
    broken.set_graph(False)
    broken.close()
    other = P.HashEmbedder(8)
    other.name = "other"
    asked = []
    with pytest.raises(Refused):
        Engine(spark, config.store, config, other, P.FixtureExtractor(FOUND), approve=lambda planned: asked.extend(planned))
    assert ("embedding_model", "reembed") in asked
    again = Engine(spark, config.store, config, other, P.FixtureExtractor(FOUND))
    assert again.diagnostics()["embedded"] == 0 and again.pending_migration() == []
    assert again.process_queues() == {"embedded": 4, "extracted": 0}
    assert again.rebuild() == {"added": 2}
    again.start()
    for _ in range(300):
        if again.diagnostics()["embedded"] == 4:
            break
        time.sleep(1)
    again.stop()
    assert again.diagnostics()["embedded"] == 4
    again.close()


def test_a_judge_decides_between_near_names(spark):
    row = lambda *x: x
    entities = spark.createDataFrame([row("1", "Person", "Ann Lee", "ann lee"), row("2", "Person", "Anne Leigh", "anne leigh"), row("3", "Concept", "Tide", "tide")], "entity_id string, type string, canonical_name string, normalized_name string")
    aliases = spark.createDataFrame([], "entity_id string, name string, normalized_name string")
    asked = spark.createDataFrame([(10, "an lee", "Person", "An Lee", "n10"), (11, "ana", "Person", "Ana", "n11"), (12, "tides", "Concept", "Tides", "n12")], "name_id long, key string, type string, name string, new_id string")
    near = spark.createDataFrame([(10, "1", 0.2, 1), (10, "2", 0.3, 2), (11, "1", 0.25, 1), (11, "3", 0.1, 2), (12, "3", 0.05, 1), (12, "1", 0.2, 2)], "name_id long, entity_id string, distance double, rank int")
    found = graph.resolve(asked.select("name_id", "key", "type", "new_id"), entities, aliases, near)
    assert {(r.name_id, r.entity_id, r.how, tuple(r.asked)) for r in found.collect()} == {(10, "n10", "new", ("1", "2")), (11, "n11", "new", ("1",)), (12, "3", "similar", ())}
    engine = Engine.__new__(Engine)
    engine.adjudicator = P.FixtureAdjudicator({"An Lee": "Anne Leigh", "Ana": "somebody else"})
    judged = engine._judged(found, asked.select("name_id", "name", "type"), entities)
    assert {(r.name_id, r.entity_id, r.how) for r in judged.collect()} == {(10, "2", "judged"), (11, "n11", "new"), (12, "3", "similar")}


def test_a_model_server_extracts_and_judges():
    said = []

    class Stub(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            said.append(body)
            same = "same" in body["format"]["properties"]
            answer = "no json" if body["prompt"] == "bad" else json.dumps({"same": "Ann Lee"} if same else {"entities": [{"name": "Tide", "type": "Concept"}], "relations": []})
            out = json.dumps({"response": answer}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    model = P.HttpModel(f"http://127.0.0.1:{server.server_port}", "m", 10)
    assert model.extract("a text")["entities"][0]["name"] == "Tide" and said[0]["format"]["properties"]["entities"]["items"]["properties"]["type"]["enum"] == [*P.ENTITY_TYPES]
    assert model.adjudicate("An Lee", "Person", ["Ann Lee"]) == "Ann Lee" and model.adjudicate("An Lee", "Person", ["Bob"]) is None
    with pytest.raises(P.Permanent):
        model.extract("bad")
    server.shutdown()


def test_a_stream_of_changes_is_dispatched(spark, tmp_path):
    rows = [("r", "2024-01-01 00:00:00", "a.md", False), ("r", "2024-01-01 00:00:00.2", "b.md", False), ("r", "2024-01-01 00:00:05", "c.md", True), ("r", "2024-01-01 01:00:00", "late.md", False)]
    (tmp_path / "in").mkdir()
    for k, r in enumerate(rows):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps(dict(zip(("root", "ts", "path", "dropped"), r))))
    events = spark.readStream.schema("root string, ts timestamp, path string, dropped boolean").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    got = []
    running = watch.dispatch(watch.stream(events), lambda kind, paths: got.append((kind, paths)), str(tmp_path / "check"), availableNow=True)
    running.awaitTermination(240)
    assert got[:2] == [("changed", ["a.md", "b.md"]), ("bulk", [])]


def test_sources(spark, tmp_path):
    np.save(tmp_path / "v.npy", np.arange(6, dtype=np.float64).reshape(3, 2))
    assert [(r.row, r.vector) for r in corpus.npy(spark, str(tmp_path / "v.npy")).orderBy("row").collect()] == [(0, [0.0, 1.0]), (1, [2.0, 3.0]), (2, [4.0, 5.0])]
    for d in ("one", "two"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "n.md").write_text(d)
    assert {r.path for r in corpus.scan(spark, [str(tmp_path / "one"), str(tmp_path / "two")]).collect()} == {"0/n.md", "1/n.md"}
