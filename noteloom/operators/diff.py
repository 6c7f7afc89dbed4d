"""What changed between an index and a corpus, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def vanished(indexed: DataFrame, found: DataFrame) -> DataFrame:
    return indexed.join(found.select("path"), "path", "left_anti")


def appeared(indexed: DataFrame, found: DataFrame) -> DataFrame:
    return found.join(indexed.select("path"), "path", "left_anti")


def renames(indexed: DataFrame, found: DataFrame) -> DataFrame:
    """(document_id, old_path, new_path, content_hash): for each hash the first vanished and the first appeared path, at most one pair."""
    first = lambda df: df.withColumn("__n", F.row_number().over(W.partitionBy("content_hash").orderBy("path"))).filter("__n = 1").drop("__n")
    old = first(vanished(indexed, found)).select("document_id", F.col("path").alias("old_path"), "content_hash")
    new = first(appeared(indexed, found)).select(F.col("path").alias("new_path"), "content_hash")
    return old.join(new, "content_hash").select("document_id", "old_path", "new_path", "content_hash")


def documents(indexed: DataFrame, found: DataFrame) -> DataFrame:
    """(path, document_id, outcome, old_path): added, modified, unchanged, renamed or removed."""
    moved = renames(indexed, found)
    both = indexed.select("document_id", "path", F.col("content_hash").alias("old")).join(found.select("path", F.col("content_hash").alias("new")), "path", "full_outer")
    left = both.join(moved.select(F.col("old_path").alias("path")), "path", "left_anti").join(moved.select(F.col("new_path").alias("path")), "path", "left_anti")
    outcome = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "unchanged").otherwise("modified")
    return left.select("path", "document_id", outcome.alias("outcome"), F.lit(None).cast("string").alias("old_path")).unionByName(moved.select(F.col("new_path").alias("path"), "document_id", F.lit("renamed").alias("outcome"), "old_path"))


def chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """(chunk_id, change, moved): added, modified, unchanged or removed chunks (chunk_id, ordinal, content_hash); moved ones need no work."""
    o = old.select("chunk_id", F.col("content_hash").alias("o"), F.col("ordinal").alias("oo"))
    n = new.select("chunk_id", F.col("content_hash").alias("n"), F.col("ordinal").alias("no"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") == F.col("n"), "unchanged").otherwise("modified")
    return o.join(n, "chunk_id", "full_outer").select("chunk_id", change.alias("change"), F.coalesce(F.col("oo") != F.col("no"), F.lit(False)).alias("moved"))


def summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


def duplicates(found: DataFrame) -> DataFrame:
    """(content_hash, copies, first_path) of contents at more than one path."""
    return found.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("path").alias("first_path")).filter("copies > 1")


def merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """A snapshot with new rows in place of old ones of the same keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the rows with equal keys, the last in the order."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("x")).select(*keys, "x.*")


def cascade(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """The children whose parent is still there."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_semi")
