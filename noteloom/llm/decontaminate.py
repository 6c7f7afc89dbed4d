"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts and benchmark items are normalised to lower-cased words (ASCII letters,
digits and any non-ASCII character) between single spaces. The test strings are
all runs of WINDOW words of every item; an item of fewer words is one string. A
document is contaminated by an item if it holds one of its strings as whole words.

Search: blocks of BLOCK bytes are looked up in a shift table, which tells how far
the scan may move on before any string can end; where it may not move, the block's
suffix hash - of the block that ends the strings' first M bytes (M: the length of the shortest) - selects the
bucket of strings, of which those whose first M bytes have the text's hash are compared byte by byte. Many lanes of
the text advance together, each by its own shift.

Test strings are broadcast in shards of about SHARD_BYTES, one scan each. With several shards the scans follow one another and
each broadcast goes before the next comes, so what a task or an executor holds does not grow with the benchmark.

Cases: a null or empty text holds nothing; items without words or without item_id give
no strings; rows without doc_id are ignored; rows that repeat a doc_id are judged together
(the windows found count once); items with equal text are all reported, and so are all strings that end at one place. Very long texts
are searched whole. Empty tables give an empty result. Other columns, whatever their names, are kept by drop_contaminated() and not read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import cut, fresh, small, texts
from ._text import ALNUM, U64, blocks, large, mix, raw

WINDOW = 8
BLOCK = 8
SHARD_BYTES = 64 << 20
LANES = 8192


def normal(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows as " word word ", one space between rows too, and where each row begins."""
    data, at = raw(pc.utf8_lower(large(column)))
    # one break before every row, so that no word runs from one row to the next
    wide = np.full(len(data) + len(at), 32, np.uint8)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    wide[np.arange(len(data)) + row + 1] = data
    wide[~ALNUM[wide]] = 32
    keep = np.ones(len(wide), bool)
    keep[1:] = (wide[1:] != 32) | (wide[:-1] != 32)
    place = np.cumsum(keep) - 1
    starts = place[at[:-1] + np.arange(len(at) - 1)] if len(at) > 1 else np.zeros(0, np.int64)
    return wide[keep], starts


def strings(items: list[tuple[int, str | None]], window: int) -> tuple[list[bytes], list[list[tuple[int, int]]]]:
    """Distinct test strings, and for each the (item, window number) pairs that it belongs to."""
    found: dict[bytes, list[tuple[int, int]]] = {}
    for item, text in items:
        if item is None or not text:
            continue
        words = bytes(normal(pa.array([text]))[0]).split()
        for p in range(max(1, len(words) - window + 1) if words else 0):
            found.setdefault(b" " + b" ".join(words[p : p + window]) + b" ", []).append((item, p))
    return list(found), list(found.values())


def _eights(data: np.ndarray, at: np.ndarray, block: int) -> np.ndarray:
    """The bytes data[at : at + block] as integers; block is at most 8, and data has 8 bytes to spare."""
    v = np.ndarray((max(0, len(data) - 7),), U64, data, strides=(1,))[at]
    return v if block == 8 else v & U64((1 << (8 * block)) - 1)


class Searcher:
    """Shift table, buckets and direct comparison for one shard of strings."""

    def __init__(self, patterns: list[bytes], block: int = BLOCK):
        self.patterns = patterns
        self.m = min(map(len, patterns))
        self.block = min(block, self.m)
        self.bits = max(16, min(24, int(np.ceil(np.log2(len(patterns) * (self.m - self.block + 1) + 1))) + 3))
        self.longest = self.m - self.block + 1
        self.shift = np.full(1 << self.bits, self.longest, np.int32)
        heads = np.frombuffer(b"".join(p[: self.m] for p in patterns) + bytes(8), np.uint8)
        first = np.arange(len(patterns)) * self.m
        for q in range(self.longest):
            np.minimum.at(self.shift, self._slot(_eights(heads, first + q, self.block)), self.longest - 1 - q)
        key = self._head(heads, first)
        self.order = np.argsort(key, kind="stable")
        self.key = key[self.order]
        self.length = np.array([len(p) for p in patterns])[self.order]
        self.bytes = np.frombuffer(b"".join(patterns) + bytes(8), np.uint8)
        self.begin = np.cumsum([0, *map(len, patterns)])[:-1][self.order]

    def _slot(self, x: np.ndarray) -> np.ndarray:
        return (mix(x) >> U64(64 - self.bits)).astype(np.int64)

    def _head(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The bucket of data[at : at + m], which is its last block's suffix hash, and beneath it a hash of what precedes."""
        h = np.zeros(len(at), U64)
        for q in range(0, self.m - self.block, self.block):
            h = mix(h * U64(31) + _eights(data, at + q, self.block))
        return self._slot(_eights(data, at + self.m - self.block, self.block)).astype(U64) << U64(40) | h >> U64(24)

    def find(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, string number) of every occurrence."""
        size = len(text)
        data = np.concatenate([text, np.zeros(8, np.uint8)])
        ends = size - self.m + 1  # starts of candidate heads are below this
        if ends <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lanes = min(LANES, max(1, ends // 256))
        bounds = np.linspace(0, ends, lanes + 1).astype(np.int64)
        pos, stop = bounds[:-1].copy(), bounds[1:]
        hits = []
        while len(pos):
            s = self.shift[self._slot(_eights(data, pos + self.m - self.block, self.block))]
            hits.append(pos[s == 0])
            pos = pos + np.maximum(s, 1)
            live = pos < stop
            pos, stop = pos[live], stop[live]
        at = np.concatenate(hits)
        h = self._head(data, at)
        i, j = np.searchsorted(self.key, h, "left"), np.searchsorted(self.key, h, "right")
        at, i, n = at[j > i], i[j > i], (j - i)[j > i]
        at = np.repeat(at, n)
        which = np.repeat(i, n) + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        ok = at + self.length[which] <= size
        at, which = at[ok], which[ok]
        same = np.fromiter((np.array_equal(data[a : a + k], self.bytes[b : b + k]) for a, b, k in zip(at, self.begin[which], self.length[which])), bool, len(at))
        return at[same], self.order[which[same]]


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, item_id, n_windows): how many distinct test strings of the item the document holds."""
    spark = docs.sparkSession
    docs = texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    found = spark.createDataFrame(pa.table({"doc_id": pa.array([], pa.int64()), "item_id": pa.array([], pa.int64()), "window": pa.array([], pa.int32())}))
    shards = (strings(shard, window) for shard in _shards(items, shard_bytes))
    before = None
    for patterns, owners in shards:
        if not patterns:
            continue
        if before is not None:  # not the last one
            part, shared = before
            found = found.unionByName(cut(part))
            shared.unpersist()
        before = _scan(docs, patterns, owners)
    if before is not None:
        found = found.unionByName(before[0])
    return found.groupBy("doc_id", "item_id").agg(F.count_distinct("window").cast("int").alias("n_windows"))


def _shards(items: DataFrame, limit: int) -> Iterator[list[tuple[int, str]]]:
    """The items in shards of about ``limit`` bytes of test strings; rows come to the driver one partition at a time."""
    shard, size = [], 0
    for row in items.distinct().toLocalIterator():
        shard.append((row.item_id, row.text))
        size += WINDOW * len(row.text)
        if size >= limit:
            yield shard
            shard, size = [], 0
    if shard:
        yield shard


def _scan(docs: DataFrame, patterns: list[bytes], owners: list[list[tuple[int, int]]]) -> tuple[DataFrame, object]:
    """(doc_id, item_id, window) of what the texts hold, and the broadcast that this needs."""
    shared = docs.sparkSession.sparkContext.broadcast((Searcher(patterns), owners))

    def run(batches):
        searcher, owners = shared.value
        for batch in batches:
            for b in blocks(batch, "text"):
                text, starts = normal(b.column("text"))
                at, which = searcher.find(text)
                if len(at):
                    ids = b.column("doc_id").to_numpy(zero_copy_only=False)
                    row = np.searchsorted(starts, at, "right") - 1
                    out = sorted({(int(ids[r]), item, p) for r, w in zip(row, which) for item, p in owners[w]})
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32()))], ["doc_id", "item_id", "window"])

    return docs.mapInArrow(run, "doc_id long, item_id long, window int"), shared


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without those that hold a test string; rows without doc_id or text stay."""
    key = fresh(docs, "bad")
    bad = cut(occurrences(docs, benchmark, window).select(F.col("doc_id").alias(key)).distinct())
    return docs.join(small(bad), F.col("doc_id").cast("long") == F.col(key), "left_anti")


_WORDS = "regexp_extract_all(lower(text), '(?:[a-z0-9]|[^\\x00-\\x7F])+')"
SQL = f"""
WITH items AS (
  SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), strings AS (
  SELECT item_id, p, array_to_string(w[p:p + {WINDOW - 1}], ' ') AS s, least(len(w), {WINDOW}) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) AS p FROM items WHERE len(w) > 0)
), docs AS (
  SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
), windows AS (
  SELECT DISTINCT doc_id, n, array_to_string(w[p:p + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM docs, (SELECT DISTINCT n FROM strings))
)
SELECT doc_id, item_id, CAST(count(DISTINCT p) AS INTEGER) AS n_windows
FROM windows JOIN strings USING (n, s) GROUP BY doc_id, item_id
"""
