"""The engine: ingest, queues, search, answers, graph lookups and upkeep over a snapshot store."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noteloom.functions import ids
from noteloom.functions import providers as P
from noteloom.operators import chunking, diff, fusion, graph, keyword, knn, queue, versions
from noteloom.sources import corpus, markdown
from noteloom.sources.corpus import Config
from noteloom.sources.store import Store

NO_VECTORS, NO_EMBEDDING, NO_GRAPH = "vector index is empty", "no embedding for the query", "graph is empty"


@dataclass
class Response:
    results: DataFrame
    degradations: list[str] = field(default_factory=list)


@dataclass
class Answer:
    text: str
    citations: list[str]
    degradations: list[str]


class Refused(Exception):
    """A change of versions that was not approved; nothing was changed."""


class Engine:
    """approve: asked with the (key, action) pairs of a pending migration before it is applied; without it all are."""

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None, embedder=None, extractor=None, generator=None, adjudicator=None, read_only: bool = False, approve: Callable[[list[tuple[str, str]]], bool] | None = None):
        self.spark, self.config = spark, (config or Config()).over(Config.defaults())
        self.embedder = embedder or P.HashEmbedder(self.config.dimensions)
        self.extractor, self.generator, self.adjudicator = extractor or P.FixtureExtractor(), generator or P.FixedGenerator(), adjudicator
        self.store = Store(spark, path, read_only)
        self._pump: threading.Thread | None = None
        self._stop = threading.Event()
        self._turn = threading.RLock()  # one change of the store at a time
        if not read_only:
            planned = self.pending_migration()
            if planned and approve is not None and not approve(planned):
                self.store.close()
                raise Refused(", ".join(f"{k}: {a}" for k, a in planned))
            if not self.store.pointers.get("metadata"):
                self.store.commit(metadata=self._running(), jobs=self._t("jobs"))
            else:
                self.store.commit(jobs=queue.reclaim(self._t("jobs")))
                self._migrate(planned)

    def _t(self, name: str) -> DataFrame:
        return self.store.table(name)

    def close(self) -> None:
        self.stop()
        self.store.close()

    # In the background

    def start(self, watch: bool = False, least: float = 1.0) -> None:
        """Work on the queues, and on changes of the roots if watch, until stop(); it rests until the next job is due, for ``least`` seconds at least."""
        if self._pump is not None:
            return
        self._stop.clear()

        def run() -> None:
            while not self._stop.is_set():
                if watch:
                    self.sync()
                self.process_queues()
                rest = least if watch else queue.next_due(self._t("jobs"), time.time()).first().seconds
                self._stop.wait(max(least, rest))

        self._pump = threading.Thread(target=run, daemon=True)
        self._pump.start()

    def stop(self) -> None:
        if self._pump is not None:
            self._stop.set()
            self._pump.join()
            self._pump = None

    def changed(self, kind: str, paths: list[str]) -> dict[str, int]:
        """What a batch of the watcher asks for: the named files again, or everything."""
        if kind == "bulk" or not paths:
            return self.sync()
        found = corpus.scan(self.spark, self.config.roots, self.config.ignore)
        some = found.filter(F.col("path").isin(*paths))  # fewer than a burst
        have = {r.path for r in some.select("path").collect()}
        with self._turn:
            counts = self._apply(some, False, whole=False) if have else {}
            known = {r.path for r in self._t("documents").select("path").filter(F.col("path").isin(*paths)).collect()}
            if known - have:  # gone, or moved to a name that no batch has told yet
                return self.sync()
            return counts

    # Versions

    def _running(self) -> DataFrame:
        c = self.config
        vocabulary = "/".join(",".join(sorted(v.lower() for v in x)) for x in (graph.ENTITY_TYPES, graph.RELATION_TYPES))
        kv = {"schema": "1", "chunker": chunking.version(c.min_tokens, c.max_tokens), "embedding_model": self.embedder.name, "embedding_dimensions": str(c.dimensions), "extraction_model": self.extractor.name, "extraction_vocabulary": ids.digest_py(vocabulary)[:16]}
        return self.spark.createDataFrame([*kv.items()], "key string, value string")

    def pending_migration(self) -> list[tuple[str, str]]:
        """(key, action) of what differs from the stored versions: at most one for each key."""
        return [(r.key, r.action) for r in versions.plan(self._t("metadata"), self._running()).collect()]

    def _migrate(self, planned: list[tuple[str, str]]) -> None:
        actions = {a for _, a in planned}
        if not planned:
            return
        chunks, jobs, now = self._t("chunks"), self._t("jobs"), time.time()
        kinds = [k for k, a in (("embed", "reembed"), ("extract", "reextract")) if a in actions or "rechunk" in actions]
        for kind in kinds:
            chunks = chunks.withColumn("embedded_hash" if kind == "embed" else "extracted_hash", F.lit(None).cast("string"))
            jobs = queue.enqueue(jobs, chunks.select(F.lit(kind).alias("kind"), F.col("chunk_id").alias("target_id")), now)
        self.store.commit(chunks=chunks, jobs=jobs, metadata=self._running())
        if "rechunk" in actions and self.config.roots:
            self.sync(force=True)

    # Ingest

    def sync(self, force: bool = False) -> dict[str, int]:
        """The store as the roots are now: counts of documents by outcome."""
        with self._turn:
            return self._apply(corpus.scan(self.spark, self.config.roots, self.config.ignore), force, whole=True)

    def add(self, files: dict[str, str], force: bool = False) -> dict[str, int]:
        """Texts by path."""
        rows = [(p, t, None) for p, t in files.items()]
        df = self.spark.createDataFrame(rows, "path string, text string, modified_at timestamp").withColumn("modified_at", F.current_timestamp()).withColumn("content_hash", ids.content_hash(F.col("text")))
        return self._apply(df, force, whole=False)

    update = add

    def remove(self, paths: list[str]) -> dict[str, int]:
        gone = self.spark.createDataFrame([(p,) for p in paths], "path string")
        found = self._t("documents").join(gone, "path", "left_anti").select("path", F.lit(None).cast("string").alias("text"), "modified_at", "content_hash")
        return self._apply(found, False, whole=True)

    def _apply(self, found: DataFrame, force: bool, whole: bool) -> dict[str, int]:
        documents, chunks, now = self._t("documents"), self._t("chunks"), time.time()
        scope = documents if whole else documents.join(found.select("path"), "path", "left_semi")
        (found,) = self.store.stage(found)
        (outcome,) = self.store.stage(diff.documents(scope.select("document_id", "path", "content_hash"), found.select("path", "content_hash")))
        counts = {r.outcome: r["n"] for r in diff.summary(outcome).collect()}
        if not force and not set(counts) - {"unchanged"}:
            return counts
        removed = outcome.filter("outcome = 'removed'").select("document_id")
        moved = outcome.filter("outcome = 'renamed'").select("document_id", F.col("path").alias("new_path"))
        touched = ["added", "modified", *(["unchanged", "renamed"] if force else [])]
        work = outcome.filter(F.col("outcome").isin(*touched)).select("path", F.coalesce("document_id", ids.document_id("path")).alias("document_id"))
        (files,) = self.store.stage(found.join(work, "path").filter("text is not null"))
        (parsed,) = self.store.stage(markdown.parsed(files, self.config.min_tokens, self.config.max_tokens))
        each = parsed.select("document_id", F.posexplode("chunks").alias("ordinal", "c")).select("document_id", "ordinal", "c.heading_path", "c.content")
        ours = parsed.select("document_id")
        old = chunks.join(removed, "document_id", "left_anti")
        (before,) = self.store.stage(old.join(ours, "document_id", "left_semi"))
        (fresh,) = self.store.stage(chunking.mint(each).join(before.select("chunk_id", "embedded_hash", "extracted_hash", F.col("length").alias("__length"), F.col("posted").alias("__posted")), "chunk_id", "left"))
        (dirty,) = self.store.stage(diff.chunks(before, fresh).filter("change in ('added', 'modified')").select("chunk_id"))
        segment = uuid.uuid4().hex
        marked = fresh.join(dirty.withColumn("__new", F.lit(True)), "chunk_id", "left")
        marked = marked.withColumn("length", F.when(F.col("__new"), keyword.length(F.col("heading"), F.col("content"))).otherwise(F.col("__length"))).withColumn("posted", F.when(F.col("__new"), F.lit(segment)).otherwise(F.col("__posted")))
        rows = files.join(parsed.drop("path"), "document_id").select("document_id", "path", "content_hash", "modified_at", F.col("front_title").alias("title"), F.col("title").alias("resolved_title"), "tags", "aliases", "additional", "links")
        kept = documents.join(removed, "document_id", "left_anti").join(ours, "document_id", "left_anti").join(moved, "document_id", "left")
        kept = kept.withColumn("path", F.coalesce("new_path", "path")).select(*documents.columns)
        append = {} if dirty.isEmpty() else {"postings": self.store.put(postings=keyword.posted(fresh.join(dirty, "chunk_id", "left_semi"), stem=True, version=F.lit(segment)))[0]}
        all_chunks, all_documents = self.store.put(chunks=old.join(ours, "document_id", "left_anti").unionByName(marked.select(*old.columns)), documents=kept.unionByName(rows.select(*documents.columns)))
        # What hangs on chunks goes with them; a modified one loses what was derived from its former content.
        alive = all_chunks.select("chunk_id")
        mentions, relations = graph.clear_extraction(self._t("mentions").join(alive, "chunk_id", "left_semi"), self._t("relations"), dirty)
        relations = relations.join(alive.withColumnRenamed("chunk_id", "supporting_chunk_id"), "supporting_chunk_id", "left_semi").select(*self._t("relations").columns)
        vectors = self._t("chunk_vectors").join(alive, "chunk_id", "left_semi").join(dirty, "chunk_id", "left_anti")
        jobs = self._t("jobs").join(alive.withColumnRenamed("chunk_id", "target_id"), "target_id", "left_semi").select(*self._t("jobs").columns)
        kinds = ("embed", "extract") if self.config.graph else ("embed",)
        jobs = queue.enqueue(jobs, dirty.select(F.explode(F.array(*(F.lit(k) for k in kinds))).alias("kind"), F.col("chunk_id").alias("target_id")), now)
        # Documents with aliases are entities, named by their title, before orphans go.
        named = all_documents.join(ours, "document_id", "left_semi").filter(F.size("aliases") > 0).select("document_id", "aliases", F.col("resolved_title").alias("title"), ids.entity_id(F.lit("Document"), F.col("resolved_title")).alias("entity_id"))
        (named,) = self.store.stage(named)
        entities, aliases = self._t("entities"), self._t("aliases")
        if not named.isEmpty():
            entities = diff.merge(entities, named.select("entity_id", F.lit("Document").alias("type"), F.col("title").alias("canonical_name"), ids.match_key(F.col("title")).alias("normalized_name")).dropDuplicates(["entity_id"]), ["entity_id"])
            alias = named.select("entity_id", F.explode("aliases").alias("name")).withColumn("normalized_name", ids.match_key(F.col("name"))).dropDuplicates(["entity_id", "normalized_name"])
            aliases = diff.merge(aliases, alias, ["entity_id", "normalized_name"])
            mentions = diff.merge(mentions.select(*self._t("mentions").columns), graph.title_mentions(named, all_chunks).dropDuplicates(["entity_id", "chunk_id", "surface_form"]), ["entity_id", "chunk_id", "surface_form"])
        self._commit_graph(entities, aliases, mentions, relations, self._t("entity_vectors"), append=append, documents=all_documents, chunks=all_chunks, chunk_vectors=vectors, jobs=jobs)
        return counts

    def _commit_graph(self, entities, aliases, mentions, relations, vectors, append=None, **rest) -> None:
        """Entities that nothing holds go, and their aliases and vectors with them."""
        mentions, relations = self.store.put(mentions=mentions, relations=relations)
        entities, aliases = self.store.stage(entities, aliases)
        gone = graph.orphans(entities, mentions, relations).select("entity_id")
        (left,) = self.store.put(entities=entities.join(gone, "entity_id", "left_anti"))
        self.store.commit(append, entities=left, aliases=diff.cascade(aliases, left, "entity_id", "entity_id"), mentions=mentions, relations=relations, entity_vectors=diff.cascade(vectors, left, "entity_id", "entity_id"), **rest)

    def rebuild(self) -> dict[str, int]:
        empty = {n: self._t(n).limit(0) for n in ("documents", "chunks", "entities", "aliases", "mentions", "relations", "jobs", "chunk_vectors", "entity_vectors", "postings")}
        with self._turn:
            self.store.commit(**empty)
            return self.sync()

    # Queues

    def process_queues(self, limit: int = 10_000, seconds: float | None = None) -> dict[str, int]:
        """Passes over the queue until no job is left that was due when this began (a job that fails is due later), or the time is up: chunks embedded and extracted."""
        done, began = {"embedded": 0, "extracted": 0}, time.time()
        while seconds is None or time.time() - began < seconds:
            with self._turn:
                n = self._embed(limit, began), self._extract(limit, began)
            if n == (None, None):
                break
            done["embedded"] += n[0] or 0
            done["extracted"] += n[1] or 0
        return done

    def _claimed(self, kind: str, limit: int, due: float) -> DataFrame | None:
        """The due jobs, now running, with their chunks; none if there are none. A job whose chunk is gone goes."""
        jobs = self._t("jobs")
        (claim,) = self.store.stage(queue.claimable(jobs, kind, limit, due).select(*queue.KEYS))
        if claim.isEmpty():
            return None
        here = self._t("chunks").select(F.lit(kind).alias("kind"), F.col("chunk_id").alias("target_id"))
        self.store.commit(jobs=queue.complete(queue.mark_running(jobs, claim), claim.join(here, queue.KEYS, "left_anti")))
        running = self._t("jobs").filter((F.col("kind") == kind) & (F.col("state") == "running"))
        return running.join(self._t("chunks").withColumnRenamed("chunk_id", "target_id"), "target_id")

    def _settle(self, kind: str, found: DataFrame) -> DataFrame:
        """Jobs after an attempt: found (target_id, error)."""
        jobs = queue.complete(self._t("jobs"), found.filter("error is null").select(F.lit(kind).alias("kind"), "target_id"))
        bad = found.filter("error is not null").select(F.lit(kind).alias("kind"), "target_id", F.col("error").startswith("transient").alias("transient"), "error")
        return queue.failed(jobs, bad, time.time())

    def _embed(self, limit: int, due: float) -> int | None:
        claimed = self._claimed("embed", limit, due)
        if claimed is None:
            return None
        claimed = claimed.select("target_id", "content_hash", chunking.embedding_input(F.col("heading"), F.col("content")).alias("text"))
        (found,) = self.store.stage(P.embedded(claimed, self.embedder, dimensions=self.config.dimensions))
        n = found.filter("error is null").count()
        if not found.isEmpty():
            good = found.filter("error is null").select(F.col("target_id").alias("chunk_id"), "embedding", F.col("content_hash").alias("__h"))
            chunks = self._t("chunks").join(good.select("chunk_id", "__h"), "chunk_id", "left").withColumn("embedded_hash", F.coalesce("__h", "embedded_hash"))
            self.store.commit(chunk_vectors=diff.merge(self._t("chunk_vectors"), good.drop("__h"), ["chunk_id"]), chunks=chunks, jobs=self._settle("embed", found))
        return n

    def _extract(self, limit: int, due: float) -> int | None:
        claimed = self._claimed("extract", limit, due)
        if claimed is None:
            return None
        claimed = claimed.select("target_id", "content_hash", "content")
        extractor = self.extractor
        schema = "target_id string, content_hash string, error string, entities array<struct<name:string,type:string>>, relations array<struct<source:string,type:string,target:string,confidence:double>>"

        def run(frames):
            import pandas as pd

            for frame in frames:
                out = []
                for r in frame.itertuples():
                    try:
                        got, error = extractor.extract(r.content), None
                    except (P.Transient, P.Permanent) as e:
                        got, error = {}, f"{'transient' if isinstance(e, P.Transient) else 'permanent'}: {e}"
                    out.append((r.target_id, r.content_hash, error, [{k: e.get(k) for k in ("name", "type")} for e in got.get("entities", [])], [{k: e.get(k, 1.0 if k == "confidence" else None) for k in ("source", "type", "target", "confidence")} for e in got.get("relations", [])]))
                yield pd.DataFrame(out, columns=["target_id", "content_hash", "error", "entities", "relations"])

        (found,) = self.store.stage(claimed.mapInPandas(run, schema))
        n = found.filter("error is null").count()
        good = found.filter("error is null").withColumnRenamed("target_id", "chunk_id")
        raw = good.select("chunk_id", F.posexplode("entities").alias("position", "e")).select("chunk_id", "position", "e.name", "e.type")
        names = graph.sanitized_entities(raw, ids.normalize_name(F.col("name"))).withColumn("match", ids.match_key(F.col("name")))
        (names,) = self.store.stage(names)
        entities, aliases = self._t("entities"), self._t("aliases")
        asked = names.groupBy("type", "match").agg(F.min("name").alias("name")).withColumn("entity_id", ids.entity_id("type", F.col("name")))
        (asked,) = self.store.stage(asked.withColumn("name_id", F.xxhash64("entity_id")))
        (vectors,) = self.store.stage(P.embedded(asked.select("name_id", "entity_id", F.col("name").alias("text")), self.embedder, dimensions=self.config.dimensions).filter("error is null"))
        candidates = None
        if not self._t("entity_vectors").isEmpty():
            stored = self._t("entity_vectors").withColumn("vec_id", F.xxhash64("entity_id"))
            near = knn.knn_per_query(stored, vectors.select(F.col("name_id").alias("query_id"), "embedding"), graph.NEAREST)
            candidates = near.join(stored.select("vec_id", "entity_id"), "vec_id").select(F.col("query_id").alias("name_id"), "entity_id", "distance", "rank")
        resolved = graph.resolve(asked.select("name_id", F.col("match").alias("key"), "type", F.col("entity_id").alias("new_id")), entities, aliases, candidates)
        (resolved,) = self.store.stage(resolved)
        if candidates is not None:
            if self.adjudicator is not None:
                (resolved,) = self.store.stage(self._judged(resolved, asked, entities))
            resolved = resolved.drop("asked")
        (target,) = self.store.stage(names.join(asked.select("type", "match", "name_id"), ["type", "match"]).join(resolved, "name_id"))
        new = asked.drop("entity_id").join(resolved.filter("how = 'new'"), "name_id")
        all_entities = diff.merge(entities, new.select("entity_id", "type", F.col("name").alias("canonical_name"), F.col("match").alias("normalized_name")), ["entity_id"])
        other = target.join(all_entities.select("entity_id", "normalized_name"), "entity_id").filter("match <> normalized_name")
        all_aliases = diff.merge(aliases, other.select("entity_id", "name", F.col("match").alias("normalized_name")).dropDuplicates(["entity_id", "normalized_name"]), ["entity_id", "normalized_name"])
        mentions, relations = graph.clear_extraction(self._t("mentions"), self._t("relations"), good.select("chunk_id"))
        seen = target.select("entity_id", "chunk_id", F.col("name").alias("surface_form"), F.lit(graph.FROM_EXTRACTION).alias("source")).dropDuplicates(["entity_id", "chunk_id", "surface_form"])
        said = good.select("chunk_id", F.explode("relations").alias("r")).select("chunk_id", "r.*")
        clean = graph.sanitized_relations(said, names, ids.normalize_name(F.col("source")), ids.normalize_name(F.col("target")))
        first = target.groupBy("chunk_id", "key").agg(F.min_by("entity_id", "position").alias("entity_id"))
        clean = clean.join(first.select("chunk_id", F.col("key").alias("source_key"), F.col("entity_id").alias("source_id")), ["chunk_id", "source_key"]).join(first.select("chunk_id", F.col("key").alias("target_key"), F.col("entity_id").alias("target_id")), ["chunk_id", "target_key"])
        clean = clean.filter("source_id <> target_id").withColumn("relation_id", ids.relation_id("source_id", "type", "target_id", "chunk_id"))
        made = clean.groupBy("relation_id", "source_id", "type", "target_id", F.col("chunk_id").alias("supporting_chunk_id")).agg(F.max("confidence").alias("confidence"))
        stamped = self._t("chunks").join(good.select("chunk_id", F.col("content_hash").alias("__h")), "chunk_id", "left").withColumn("extracted_hash", F.coalesce("__h", "extracted_hash"))
        self._commit_graph(
            all_entities,
            all_aliases,
            diff.merge(mentions.select(*self._t("mentions").columns), seen, ["entity_id", "chunk_id", "surface_form"]),
            diff.merge(relations, made, ["relation_id"]),
            diff.merge(self._t("entity_vectors"), vectors.join(resolved.filter("how = 'new'").select("name_id"), "name_id").select("entity_id", "embedding"), ["entity_id"]),
            chunks=stamped,
            jobs=self._settle("extract", found.select("target_id", "error")),
        )
        return n

    def _judged(self, resolved: DataFrame, asked: DataFrame, entities: DataFrame) -> DataFrame:
        """resolved, with the names that are near known ones put before the adjudicator, each with its candidates' names."""
        adjudicator = self.adjudicator
        named = entities.select("entity_id", "canonical_name")
        doubt = resolved.filter(F.size("asked") > 0).join(asked.select("name_id", "name", "type"), "name_id")
        each = doubt.select("name_id", "name", "type", F.posexplode("asked").alias("place", "entity_id")).join(named, "entity_id")
        put = each.groupBy("name_id", "name", "type").agg(F.array_sort(F.collect_list(F.struct("place", "entity_id", "canonical_name"))).alias("c")).select("name_id", "name", "type", F.col("c.entity_id").alias("ids"), F.col("c.canonical_name").alias("names"))

        def run(frames):
            for frame in frames:
                out = []
                for r in frame.itertuples():
                    try:
                        meant = adjudicator.adjudicate(r.name, r.type, list(r.names))
                    except (P.Transient, P.Permanent):  # without an answer the name is a new one
                        meant = None
                    out.append(next((i for i, n in zip(r.ids, r.names) if n == meant), None))
                yield frame[["name_id"]].assign(meant=out)

        said = put.mapInPandas(run, "name_id long, meant string")
        both = resolved.join(said, "name_id", "left")
        return both.select("name_id", F.coalesce("meant", "entity_id").alias("entity_id"), F.when(F.col("meant").isNull(), F.col("how")).otherwise("judged").alias("how"), "asked")

    def retry_failed(self) -> None:
        self.store.commit(jobs=queue.retry_failed(self._t("jobs"), time.time()))

    def set_graph(self, on: bool) -> None:
        """Turning the graph off drops its jobs; turning it on asks for what is stale."""
        self.config.graph = on
        jobs = self._t("jobs")
        if on:
            jobs = queue.enqueue(jobs, versions.stale(self._t("chunks"), "extracted_hash").select(F.lit("extract").alias("kind"), F.col("chunk_id").alias("target_id")), time.time())
        self.store.commit(jobs=jobs if on else jobs.filter("kind <> 'extract'"))

    # Search

    def search(self, query: str, limit: int | None = None, tags: list[str] | None = None, hops: int | None = None, weights: dict[str, float] = fusion.WEIGHTS) -> Response:
        """(chunk_id, score, ranks by arm, citation, content, matched), best first."""
        limit, query = limit or self.config.limit, query.strip()
        chunks, documents = self._t("chunks"), self._t("documents")
        flags: list[str] = []
        arms: list[DataFrame] = []
        terms = list(dict.fromkeys(keyword.stem(t) for t in keyword.folded_terms(query)))
        if terms:
            size = chunks.agg(F.count("*").alias("n"), F.avg("length").alias("average")).first()
            alive = chunks.select("chunk_id", F.col("posted").alias("version"))
            found = keyword.bm25_index(self._t("postings"), size.n, size.average, terms, alive=alive)
            arms.append(self._few(fusion.ranked(found, "keyword", "chunk_id", F.desc("score"))))
        vectors = self._t("chunk_vectors")
        if query:
            if vectors.isEmpty():
                flags.append(NO_VECTORS)
            else:
                try:
                    near = knn.knn(vectors, self.embedder.embed([query])[0], fusion.CANDIDATES, key="chunk_id")
                    arms.append(self._few(fusion.ranked(near, "vector", "chunk_id", F.asc("distance"))))
                except (P.Transient, P.Permanent) as e:
                    flags.append(f"{NO_EMBEDDING}: {e}")
        mentions, relations = self._t("mentions"), self._t("relations")
        if query and self.config.graph:
            if mentions.isEmpty():
                flags.append(NO_GRAPH)
            else:
                seeds = graph.seeds(query, graph.names(self._t("entities"), self._t("aliases"))).select("entity_id")
                if arms:
                    ten = [r.chunk_id for arm in arms for r in arm.collect()][:10]  # the arms' rows are here already, keyword first
                    first = self.spark.createDataFrame([(c,) for c in dict.fromkeys(ten)], "chunk_id string")
                    seeds = seeds.unionByName(mentions.join(first, "chunk_id", "left_semi").select("entity_id"))
                expanded = graph.chunk_rank(graph.expand(mentions, relations, seeds, hops or self.config.hops), fusion.CANDIDATES)
                rank = F.row_number().over(W.orderBy("hop", F.desc("confidence"), "chunk_id"))
                arms.append(self._few(expanded.select("chunk_id", F.lit("graph").alias("arm"), rank.alias("rank"))))
        fused = fusion.rrf(arms, weights) if arms else fusion.rrf([chunks.select("chunk_id", F.lit("keyword").alias("arm"), F.lit(1).alias("rank")).limit(0)])
        full = fusion.hydrate(fused, chunks, documents.select("document_id", "path", "tags"), limit, tags)
        keys = sorted({k for _, _, k in graph.ngrams(query)})
        named = graph.names(self._t("entities"), self._t("aliases")).filter(F.col("key").isin(*keys) if keys else F.lit(False)).select("entity_id").distinct()
        matched = mentions.join(named, "entity_id", "left_semi").join(self._t("entities").select("entity_id", "canonical_name"), "entity_id").groupBy("chunk_id").agg(F.array_sort(F.collect_set("canonical_name")).alias("matched"))
        out = full.join(matched, "chunk_id", "left").select("chunk_id", "score", "keyword_rank", "vector_rank", "graph_rank", fusion.citation(F.col("path"), F.col("heading_path")).alias("citation"), "content", F.coalesce("matched", F.array().cast("array<string>")).alias("matched"))
        return Response(out.orderBy(F.desc("score"), "chunk_id"), flags)

    def _few(self, arm: DataFrame) -> DataFrame:
        """An arm's rows, at most as many as its candidates, worked out once."""
        return self.spark.createDataFrame(arm.orderBy("rank").collect(), "chunk_id string, arm string, rank int")

    def answer(self, question: str, budget: int = 3000, limit: int = 8) -> Answer:
        found = self.search(question, limit)
        packed = fusion.context(found.results, budget).orderBy("position").select("citation", "content").collect()  # at most limit rows
        if not packed:
            return Answer(" ".join(["Nothing in the notes answers this question.", *found.degradations]), [], found.degradations)
        text = P.collect(self.generator.generate(fusion.prompt(question, [(r.citation, r.content) for r in packed])))
        return Answer(text, [r.citation for r in packed], found.degradations)

    # Graph

    def lookup_entity(self, name: str) -> DataFrame:
        keys = self.spark.createDataFrame([(ids.match_key_py(name),)], "key string")
        return graph.lookup(self._t("entities"), self._t("aliases"), self._t("mentions"), keys)

    def traverse(self, name: str, hops: int = 1, limit: int = 20) -> tuple[DataFrame, DataFrame]:
        """(relations of each entity that goes by the name, with both ends; chunks around all of them in rank order).

        The relations have ``origin``, the entity that they hang on, and for both ends id, name and type.
        """
        seeds = self.lookup_entity(name).select("entity_id").distinct()
        hit = self._t("relations").select("*", F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("entity_id")).join(seeds, "entity_id", "left_semi")
        near = hit.withColumnRenamed("entity_id", "origin")
        for end in ("source", "target"):
            near = near.join(self._t("entities").select(F.col("entity_id").alias(f"{end}_id"), F.col("canonical_name").alias(end), F.col("type").alias(f"{end}_type")), f"{end}_id")
        around = graph.chunk_rank(graph.expand(self._t("mentions"), self._t("relations"), seeds, max(1, hops)), limit)
        return near, around.join(self._t("chunks").select("chunk_id", "heading", "content"), "chunk_id").orderBy("hop", F.desc("confidence"), "chunk_id")

    # Upkeep

    def diagnostics(self) -> dict:
        t = self._t
        sizes = {n: t(n).count() for n in ("documents", "entities", "mentions", "relations")}
        depth = {r.kind: r.asDict() for r in queue.depth(t("jobs")).collect()}
        failures = [(r.kind, r.target_id, r.last_error) for r in t("jobs").filter("state = 'failed'").orderBy("kind", "target_id").limit(20).collect()]
        stored = {r.key: r.value for r in t("metadata").collect()}
        return sizes | versions.coverage(t("chunks")).first().asDict() | {"queues": depth, "failures": failures, "versions": stored, "writable": not self.store.read_only}

    def compact(self, drop_failed: bool = False) -> None:
        if drop_failed:
            self.store.commit(jobs=self._t("jobs").filter("state <> 'failed'"))
        self.store.compact()

    def check_providers(self) -> dict[str, dict]:
        every = {"embedder": self.embedder, "extractor": self.extractor, "generator": self.generator}
        return {k: p.health() if hasattr(p, "health") else {"reachable": True, "missing": [], "reason": None} for k, p in every.items()}
