"""The entity graph: lookups, neighbours, expansion, clean-up, vocabulary and seeding."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noteloom.functions.ids import match_key_py
from noteloom.functions.providers import ENTITY_TYPES, RELATION_TYPES
from noteloom.operators.knn import similarity
from noteloom.sources import shared

#: Rows, or a function that gives at least those of some entities (entity_id): what a large source can find without making all its rows.
Rows = DataFrame | Callable[[DataFrame], DataFrame]

RESOLVE, ADJUDICATE, NEAREST = 0.92, 0.75, 10
FROM_EXTRACTION, FROM_FRONT_MATTER = "extraction", "front_matter"


def _of(rows: Rows, ids: DataFrame) -> DataFrame:
    return rows(ids) if callable(rows) else rows


def names(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(key, entity_id): every name an entity goes by."""
    return entities.select(F.col("normalized_name").alias("key"), "entity_id").unionByName(aliases.select(F.col("normalized_name").alias("key"), "entity_id")).distinct()


def lookup(entities: DataFrame, aliases: DataFrame, mentions: Rows, keys: DataFrame) -> DataFrame:
    """(key, entity_id, type, canonical_name, aliases, mentions) of the entities named by keys (key)."""
    settled = shared.settled if callable(mentions) else lambda rows: rows
    asked = settled(keys.select(F.col("key").alias("normalized_name")).distinct())
    hit = settled(names(*(x.join(asked, "normalized_name", "left_semi") for x in (entities, aliases))))
    found = settled(hit.select("entity_id").distinct())
    all_aliases = aliases.join(found, "entity_id", "left_semi").groupBy("entity_id").agg(F.array_sort(F.collect_list("name")).alias("aliases"))
    counted = _of(mentions, found).join(found, "entity_id", "left_semi").groupBy("entity_id").agg(F.count("*").alias("mentions"))
    out = hit.join(entities.select("entity_id", "type", "canonical_name"), "entity_id").join(all_aliases, "entity_id", "left").join(counted, "entity_id", "left")
    return out.select("key", "entity_id", "type", "canonical_name", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.coalesce("mentions", F.lit(0)).alias("mentions"))


def ends(relations: DataFrame) -> DataFrame:
    """Each relation under both its ends: (entity_id, other_id, supporting_chunk_id, confidence)."""
    way = lambda a, b: F.struct(F.col(a).alias("entity_id"), F.col(b).alias("other_id"))
    both = F.explode(F.array(way("source_id", "target_id"), way("target_id", "source_id"))).alias("e")
    return relations.select(both, "supporting_chunk_id", "confidence").select("e.*", "supporting_chunk_id", "confidence")


def neighbors(relations: Rows, seeds: DataFrame) -> DataFrame:
    """The relations that touch a seed (entity_id) at either end, each once."""
    ids = seeds.select("entity_id").distinct()
    if callable(relations):
        ids = shared.settled(ids)
    rows = _of(relations, ids)
    columns = rows.columns
    for end in ("source", "target"):
        rows = rows.join(ids.select(F.col("entity_id").alias(f"__{end}")), F.col(f"{end}_id") == F.col(f"__{end}"), "left")
    return rows.filter("__source is not null or __target is not null").select(*columns)


def expand(mentions: Rows, relations: Rows, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """(chunk_id, hop, confidence): chunks that mention a seed are hop 0; chunks that support a relation of the frontier are the next hop.

    A chunk keeps its first hop and its best confidence there. Edges are walked either way, and no entity twice.
    """
    settled = shared.settled if callable(mentions) or callable(relations) else lambda ids: ids
    frontier = settled(seeds.select("entity_id").distinct())
    visited = frontier
    found = [_of(mentions, frontier).join(frontier, "entity_id", "left_semi").select("chunk_id", F.lit(0).alias("hop"), F.lit(1.0).alias("confidence"))]
    for hop in range(1, hops + 1):
        step = ends(_of(relations, frontier)).join(frontier, "entity_id", "left_semi")
        found.append(step.select(F.col("supporting_chunk_id").alias("chunk_id"), F.lit(hop).alias("hop"), "confidence"))
        if hop < hops:
            frontier = settled(step.select(F.col("other_id").alias("entity_id")).distinct().join(visited, "entity_id", "left_anti"))
            visited = visited.unionByName(frontier)
    best = F.min(F.struct("hop", (-F.col("confidence")).alias("less"))).alias("x")
    return reduce(DataFrame.unionByName, found).groupBy("chunk_id").agg(best).select("chunk_id", "x.hop", (-F.col("x.less")).alias("confidence"))


def chunk_rank(expanded: DataFrame, limit: int = 50) -> DataFrame:
    return expanded.orderBy("hop", F.desc("confidence"), "chunk_id").limit(limit)


def orphans(entities: DataFrame, mentions: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """Entities that no mention (entity_id) and no relation holds, each row of them."""
    used = mentions.select("entity_id")
    if relations is not None:
        used = used.unionByName(relations.select(F.explode(F.array("source_id", "target_id")).alias("entity_id")))
    return entities.join(used.distinct(), "entity_id", "left_anti").select(*entities.columns)


def clear_extraction(mentions: DataFrame, relations: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the extracted mentions and the relations of the given chunks (chunk_id)."""
    gone = chunks.select("chunk_id").distinct()
    hit = mentions.join(gone.withColumn("__gone", F.lit(True)), "chunk_id", "left")
    kept = hit.filter(F.col("__gone").isNull() | (F.col("source") != FROM_EXTRACTION)).select(*mentions.columns)
    return kept, relations.join(gone.withColumnRenamed("chunk_id", "supporting_chunk_id"), "supporting_chunk_id", "left_anti").select(*relations.columns)


def canonical(kind: Column, vocabulary: tuple[str, ...]) -> Column:
    """The vocabulary's spelling of a type, or null."""
    spelled = F.create_map(*[F.lit(x) for v in vocabulary for x in (v.lower(), v)])
    return F.try_element_at(spelled, F.lower(F.trim(kind)))


def sanitized_entities(extracted: DataFrame, key: Column, vocabulary: tuple[str, ...] = ENTITY_TYPES) -> DataFrame:
    """extracted (chunk_id, position, name, type): known types, trimmed names, the first of each (type, key) in a chunk."""
    clean = extracted.withColumn("name", F.trim("name")).withColumn("type", canonical(F.col("type"), vocabulary)).filter("name <> '' and type is not null").withColumn("key", key)
    first = F.row_number().over(W.partitionBy("chunk_id", "type", "key").orderBy("position"))
    return clean.withColumn("__n", first).filter("__n = 1").drop("__n")


def sanitized_relations(extracted: DataFrame, entities: DataFrame, source: Column, target: Column, vocabulary: tuple[str, ...] = RELATION_TYPES) -> DataFrame:
    """extracted (chunk_id, source, type, target, confidence): known types, both ends declared in the chunk, no loops, confidence from 0 to 1."""
    clean = extracted.withColumn("type", canonical(F.col("type"), vocabulary)).withColumn("source_key", source).withColumn("target_key", target)
    clean = clean.filter("type is not null and source_key <> target_key").withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))))
    declared = entities.select("chunk_id", "key").distinct()
    for end in ("source_key", "target_key"):
        clean = clean.join(declared.withColumnRenamed("key", end), ["chunk_id", end], "left_semi")
    return clean.select("chunk_id", "source", "type", "target", "confidence", "source_key", "target_key")


def resolve(extracted: DataFrame, entities: DataFrame, aliases: DataFrame, candidates: DataFrame | None = None, threshold: float = RESOLVE, ask: float = ADJUDICATE) -> DataFrame:
    """(name_id, entity_id, how): exact by key and type; else the nearest of the first candidates of the type, if similar enough; else new.

    With candidates, a new name has ``asked``: those of its type that are between ask and threshold, nearest first, for a judge.
    extracted (name_id, key, type, new_id); candidates (name_id, entity_id, distance, rank), nearest first. A name whose key is known under
    another type only is new: no similarity is asked for it.
    """
    known = names(entities, aliases).join(entities.select("entity_id", "type"), "entity_id")
    exact = extracted.join(known, ["key", "type"]).groupBy("name_id").agg(F.min("entity_id").alias("entity_id")).withColumn("how", F.lit("exact"))
    rest = extracted.join(exact.select("name_id"), "name_id", "left_anti")
    open_ = rest.join(known.select("key").distinct(), "key", "left_anti")
    if candidates is None:
        return exact.unionByName(rest.select("name_id", F.col("new_id").alias("entity_id"), F.lit("new").alias("how")))
    near = candidates.filter(F.col("rank") <= NEAREST).join(entities.select("entity_id", "type"), "entity_id").join(open_.select("name_id", "type"), ["name_id", "type"])
    near = near.withColumn("s", similarity(F.col("distance")))
    best = near.groupBy("name_id").agg(  # at most NEAREST rows for each name
        F.min_by(F.when(F.col("s") >= threshold, F.col("entity_id")), F.when(F.col("s") >= threshold, F.struct("rank", "entity_id"))).alias("found"),
        F.array_sort(F.collect_list(F.when((F.col("s") >= ask) & (F.col("s") < threshold), F.struct("rank", "entity_id")))).alias("asked"),
    )
    rest = rest.join(best, "name_id", "left")
    none = F.array().cast("array<string>")
    return exact.withColumn("asked", none).unionByName(
        rest.select("name_id", F.coalesce("found", "new_id").alias("entity_id"), F.when(F.col("found").isNull(), "new").otherwise("similar").alias("how"), F.when(F.col("found").isNull(), F.coalesce(F.col("asked.entity_id"), none)).otherwise(none).alias("asked"))
    )


def title_mentions(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Front-matter mentions of documents with aliases (document_id, title, entity_id, aliases) on all their chunks."""
    seeded = documents.filter(F.size("aliases") > 0).select("document_id", "entity_id", F.col("title").alias("surface_form"))
    return chunks.select("chunk_id", "document_id").join(seeded, "document_id").select("entity_id", "chunk_id", "surface_form", F.lit(FROM_FRONT_MATTER).alias("source"))


def ngrams(query: str, most: int = 4) -> list[tuple[int, int, str]]:
    """(start, length, key) of the runs of up to four words, longest first, left to right."""
    import re

    words = [w for w in re.split(r"[^\w-]|_", query) if w]
    out = []
    for n in range(min(most, len(words)), 0, -1):
        for a in range(len(words) - n + 1):
            key = match_key_py(" ".join(words[a : a + n]))
            if len(key) > 1:
                out.append((a, n, key))
    return out


def seeds(query: str, known: DataFrame) -> DataFrame:
    """(entity_id, start, length) of the entities that the query names; a longer match takes its words. known: names()."""
    grams = ngrams(query)
    spark = known.sparkSession
    asked = spark.createDataFrame(grams or [(0, 0, "")], "start int, length int, key string")
    hit = known.join(F.broadcast(asked), "key").filter("length > 0")  # asked: four rows for each word of the query
    taken: set[int] = set()
    chosen = []
    keys = {r.key for r in hit.select("key").distinct().collect()}  # at most as many as the query has runs
    for a, n, key in grams:
        if key in keys and not taken & set(range(a, a + n)):
            taken |= set(range(a, a + n))
            chosen.append((a, n))
    picked = spark.createDataFrame(chosen or [(-1, -1)], "start int, length int")
    return hit.join(F.broadcast(picked), ["start", "length"], "left_semi").select("entity_id", "start", "length")
