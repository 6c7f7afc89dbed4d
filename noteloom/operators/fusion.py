"""Reciprocal rank fusion, hydration, tag filter, and packing of an answer's context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noteloom.functions.ids import estimate_tokens

WEIGHTS = {"keyword": 1.0, "vector": 1.0, "graph": 0.7}
K = 60
CANDIDATES = 50
DECIMALS = 9


def ranked(scored: DataFrame, arm: str, key: str, by: Column, limit: int = CANDIDATES) -> DataFrame:
    """(key, arm, rank) of an arm's best rows; ties by key. The limit comes first, so that the window sees no more than its rows."""
    best = scored.orderBy(by, key).limit(limit)
    return best.select(key, F.lit(arm).alias("arm"), F.row_number().over(W.orderBy(by, key)).alias("rank"))


def rrf(arms: list[DataFrame], weights: dict[str, float] = WEIGHTS, k: int = K, key: str = "chunk_id") -> DataFrame:
    """(key, score, keyword_rank, vector_rank, graph_rank); arms of no weight don't count."""
    used = reduce(DataFrame.unionByName, arms)
    names = ("keyword", "vector", "graph")
    best = [F.min(F.when((F.col("arm") == n) & F.lit(weights.get(n, 0.0) > 0), F.col("rank"))).alias(f"{n}_rank") for n in names]
    found = used.filter(F.col("arm").isin(*[n for n in names if weights.get(n, 0.0) > 0])).groupBy(key).agg(*best)
    parts = [F.coalesce(F.lit(float(weights.get(n, 0.0))) / (F.lit(k) + F.col(f"{n}_rank")), F.lit(0.0)) for n in names]
    return found.select(key, F.round(parts[0] + parts[1] + parts[2], DECIMALS).alias("score"), *(f"{n}_rank" for n in names))


def has_tags(tags: Column, required: list[str]) -> Column:
    """Whether all the required tags are among the tags, whatever their case."""
    return F.size(F.array_except(F.array(*(F.lit(t.lower()) for t in required)).cast("array<string>"), F.transform(F.coalesce(tags, F.array().cast("array<string>")), F.lower))) == 0


def hydrate(fused: DataFrame, chunks: DataFrame, documents: DataFrame, limit: int, tags: list[str] | None = None, key: str = "chunk_id") -> DataFrame:
    """The fused rows with their chunks and documents; fused is as small as its arms' limits, so it is the side that is broadcast."""
    if not tags:
        fused = fused.orderBy(F.desc("score"), key).limit(limit)
    full = chunks.join(F.broadcast(fused), key).join(documents, "document_id")
    if tags:
        full = full.filter(has_tags(F.col("tags"), tags))
    return full.orderBy(F.desc("score"), key).limit(limit)


def citation(path: Column, headings: Column) -> Column:
    return F.when(F.size(headings) > 0, F.concat(path, F.lit(" — "), F.array_join(headings, " > "))).otherwise(path)


def context(results: DataFrame, budget: int, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """The results, best first, that fit in the budget of tokens; the first one always does. A prefix: what comes after an overflow is left out."""
    order = W.orderBy(F.desc("score"), key)
    sized = results.withColumn("tokens", estimate_tokens(F.col(text))).withColumn("position", F.row_number().over(order))
    sized = sized.withColumn("used", F.sum("tokens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return sized.filter((F.col("used") <= budget) | (F.col("position") == 1))


def prompt(question: str, packed: list[tuple[str, str]]) -> str:
    """Numbered excerpts (label, text) and the question."""
    shown = "\n\n".join(f"[{i}] {label}\n{text}" for i, (label, text) in enumerate(packed, 1))
    return f"Excerpts from the notes:\n\n{shown}\n\nAnswer from these excerpts alone, cite them by number, and say so if they don't hold the answer.\n\nQuestion: {question}"


def excerpt(text: Column, most: int = 240) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)
