"""Version keys of a store, what a change of each invalidates, and the coverage of derived data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACTIONS = {"schema": "none", "chunker": "rechunk", "embedding_model": "reembed", "embedding_dimensions": "reembed", "extraction_model": "reextract", "extraction_vocabulary": "reextract"}
SEVERITY = ("none", "reextract", "reembed", "rechunk")


def plan(stored: DataFrame, running: DataFrame) -> DataFrame:
    """(key, stored, running, action) of the keys (key, value) that were set and now differ."""
    actions = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])
    both = running.withColumnRenamed("value", "running").join(stored.withColumnRenamed("value", "stored"), "key")
    return both.filter("stored <> running").select("key", "stored", "running", F.coalesce(F.try_element_at(actions, F.col("key")), F.lit("none")).alias("action"))


def widest(planned: DataFrame) -> DataFrame:
    """(action): the one that does most."""
    order = F.array_position(F.array(*(F.lit(s) for s in SEVERITY)), F.col("action"))
    return planned.agg(F.coalesce(F.max_by("action", order), F.lit("none")).alias("action"))


def coverage(chunks: DataFrame) -> DataFrame:
    """(chunks, embedded, extracted): how many chunks there are, and whose derived data is of their present content."""
    return chunks.agg(F.count("*").alias("chunks"), F.count_if(F.col("embedded_hash") == F.col("content_hash")).alias("embedded"), F.count_if(F.col("extracted_hash") == F.col("content_hash")).alias("extracted"))


def stale(chunks: DataFrame, column: str) -> DataFrame:
    return chunks.filter(~F.col(column).eqNullSafe(F.col("content_hash"))).select("chunk_id")
