"""Chunks from sections of plain paragraphs, as JVM folds over one array for each document.

Sections are rows (document_id, ordinal, heading_path, text). Markdown goes through noteloom.sources.markdown first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noteloom.functions.ids import canonical_path, chunk_id, content_hash, estimate_tokens

MIN_TOKENS, MAX_TOKENS = 64, 512


def pack_groups(sizes: Column, most: int) -> Column:
    """For each size the number, from 0, of the greedy pack that it falls in: a pack closes when the next size would overflow it."""
    start = F.struct(F.lit(-1).alias("pack"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, n: Column) -> Column:
        opens = (acc["pack"] < 0) | (acc["used"] + n > most)
        pack = F.when(opens, acc["pack"] + 1).otherwise(acc["pack"])
        return F.struct(pack.alias("pack"), F.when(opens, n).otherwise(acc["used"] + n).alias("used"), F.concat(acc["out"], F.array(pack)).alias("out"))

    return F.aggregate(sizes, start, step, lambda acc: acc["out"])


def packed(sections: DataFrame, most: int = MAX_TOKENS) -> DataFrame:
    """(document_id, chunk, heading_path, first_ordinal, paragraphs, tokens, content): paragraphs packed in order."""
    sized = sections.withColumn("n", estimate_tokens(F.col("text")))
    one = sized.groupBy("document_id", "heading_path").agg(F.array_sort(F.collect_list(F.struct("ordinal", "n", "text"))).alias("p"))
    one = one.withColumn("pack", pack_groups(F.col("p.n"), most))
    each = one.select("document_id", "heading_path", F.explode(F.arrays_zip("p", "pack")).alias("x"))
    return each.groupBy("document_id", "heading_path", F.col("x.pack").alias("chunk")).agg(
        F.min("x.p.ordinal").alias("first_ordinal"),
        F.count("*").cast("int").alias("paragraphs"),
        F.sum("x.p.n").cast("int").alias("tokens"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("x.p.ordinal").alias("o"), F.col("x.p.text").alias("t")))), lambda y: y["t"]), "\n\n").alias("content"),
    )


def merge_small(sections: DataFrame, least: int = MIN_TOKENS, most: int = MAX_TOKENS) -> DataFrame:
    """Sections in order, with each that follows one of fewer than ``least`` tokens joined to it under its own heading, if both fit."""
    one = sections.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "heading_path", "text"))).alias("s"))
    kind = "array<struct<ordinal:int,heading_path:array<string>,text:string>>"

    def step(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        head = F.when(F.size(x["heading_path"]) > 0, F.concat(F.lit("## "), F.element_at(x["heading_path"], -1), F.lit("\n\n"))).otherwise(F.lit(""))
        both = F.concat(last["text"], F.lit("\n\n"), head, x["text"])
        joins = (F.size(acc) > 0) & (estimate_tokens(last["text"]) < least) & (estimate_tokens(last["text"]) + estimate_tokens(x["text"]) <= most)
        merged = F.concat(F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1)), F.array(F.struct(last["ordinal"].alias("ordinal"), last["heading_path"].alias("heading_path"), both.alias("text"))))
        return F.when(joins, merged).otherwise(F.concat(acc, F.array(x))).cast(kind)

    items = F.transform(F.col("s"), lambda x: F.struct(x["ordinal"].cast("int").alias("ordinal"), x["heading_path"].alias("heading_path"), x["text"].alias("text")))
    folded = F.aggregate(items.cast(kind), F.array().cast(kind), step)
    return one.select("document_id", F.posexplode(folded).alias("ordinal", "x")).select("document_id", "ordinal", "x.heading_path", "x.text")


def word_split(text: Column, most: int = MAX_TOKENS) -> Column:
    """The words in groups of as many as most tokens allow."""
    size = max(1, int(most / 1.3))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.floor((F.size(words) - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i * size + 1, size), " "))


def mint(chunks: DataFrame) -> DataFrame:
    """chunks (document_id, ordinal, heading_path, content) with occurrence, chunk_id, content_hash and heading."""
    path = canonical_path(F.col("heading_path"))
    order = W.partitionBy("document_id", path).orderBy("ordinal")
    out = chunks.withColumn("occurrence", F.row_number().over(order) - 1)
    out = out.withColumn("chunk_id", chunk_id("document_id", F.col("heading_path"), F.col("occurrence")))
    return out.withColumn("content_hash", content_hash(F.col("content"))).withColumn("heading", F.array_join("heading_path", " > "))


def embedding_input(heading: Column, content: Column) -> Column:
    return F.concat_ws("\n\n", heading, content)


def version(least: int = MIN_TOKENS, most: int = MAX_TOKENS) -> str:
    return f"heading-1:{least}:{most}"
