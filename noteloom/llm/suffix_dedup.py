"""Repeated passages by a depth-limited radix sort of token suffixes.

Suffixes are ordered through THRESHOLD tokens only, most significant digits
first; the groups that are equal after the last pass are exactly the windows
of THRESHOLD tokens that occur at two places or more. Digits are runs of tokens by their hashes:

First pass: the least-hashed run of DIGIT tokens of a window. Sorting every suffix by its first
run would move the whole corpus; two equal windows have the same least run, at the same place, so each window is
represented by it. Digits that occur once end there, and with them every window that they represent.
Second pass: windows whose first digit is left are split by it into buckets, and within a bucket sorted by it, then by
the digit of all their tokens; at each step groups of one end. Two digits of 64 bits tell windows
apart; tokens are not compared again.

Hot digits, at HOT places or more, would make large buckets. Their windows are grouped instead by aggregates that each task
begins on its own rows and by a join that splits where a key is hot; so no group that grows with the corpus comes to one task.

Tokens are runs of bytes above the space, compared as they are.

Cases: a null text is an empty one; rows without doc_id are ignored; texts shorter than
the threshold have no windows; rows that repeat a doc_id and text count once; rows that
repeat a doc_id with another text count as more windows of that document. The first
occurrence is the one of the lowest (doc_id, position). Very long texts are read whole. An empty table gives an empty
result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared as S
from ._text import SOLID, U64, Grid, blocks

THRESHOLD = 50
DIGIT = 8
#: Places from which a digit is hot: fewer make at most so many times THRESHOLD windows in one bucket.
HOT = 10_000

_PLACE = np.dtype([("low", "u8"), ("whole", "u8"), ("doc", "i8"), ("pos", "i4")])
_SPAN = np.dtype([("doc", "i8"), ("pos", "i4"), ("first", "i4")])
_TOP = U64(0xFFFFFFFFFFFFFFFF)


def _sliding(x: np.ndarray, w: int, ufunc) -> np.ndarray:
    """ufunc over each run of w values, in linear time; the result has len(x) - w + 1 values."""
    if len(x) < w:
        return x[:0]
    pad = -len(x) % w
    y = np.concatenate([x, np.full(pad, x[-1], x.dtype)]).reshape(-1, w)
    ahead = ufunc.accumulate(y, axis=1).ravel()
    back = ufunc.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return ufunc(back[: len(x) - w + 1], ahead[w - 1 : len(x)])


def _digits(grid: Grid, threshold: int, digit: int):
    """Digit hashes, each window's least digit (or the top value where no window begins), and the window test."""
    g, ok = grid.ngrams(digit)
    g = np.where(ok, g, _TOP)
    size = len(g)
    last = np.repeat(grid.row[1:], np.diff(grid.row)) - threshold
    window = np.arange(size) <= last
    low = np.full(size, _TOP)
    m = _sliding(g, threshold - digit + 1, np.minimum)
    low[: len(m)] = m
    return g, np.where(window, low, _TOP), window


def _row_of(grid: Grid) -> np.ndarray:
    return np.repeat(np.arange(len(grid.row) - 1), np.diff(grid.row))


def _read(docs: DataFrame) -> DataFrame:
    return S.texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")


def first_pass(docs: DataFrame, threshold: int, digit: int, hot: int = HOT) -> DataFrame:
    """(doc_id, places, hot): of each document the places of the representative digits that occur more than once, and which of them are hot."""
    w = threshold - digit + 1

    def run(batches):
        for batch in batches:
            for b in blocks(batch, "text"):
                grid = Grid(b.column("text"), SOLID, lower=False)
                g, low, window = _digits(grid, threshold, digit)
                if not window.any():
                    continue
                # A digit stands for a window if it is the least of one that it lies in.
                v = np.where(window, low, U64(0))
                most = np.zeros(len(g), U64)
                padded = np.concatenate([np.zeros(w - 1, U64), v])
                s = _sliding(padded, w, np.maximum)
                most[: len(s)] = s[: len(g)]
                at = np.flatnonzero((most == g) & (g != _TOP))
                row = _row_of(grid)[at]
                yield pa.RecordBatch.from_arrays([pa.array(g[at].view(np.int64)), b.column("doc_id").take(pa.array(row)), pa.array((at - grid.row[row]).astype(np.int32))], ["digit", "doc_id", "pos"])

    digits = S.cut(docs.mapInArrow(run, "digit long, doc_id long, pos int"))
    shared = digits.groupBy("digit").count().filter("count > 1").select("digit", (F.col("count") >= hot).alias("hot"))
    out = S.cut(digits.join(shared, "digit").groupBy("doc_id").agg(F.collect_list("pos").alias("places"), F.collect_list("hot").alias("hot")))
    S.drop(digits)
    return out


def _windows(b: pa.RecordBatch, threshold: int, digit: int, hot: bool) -> np.ndarray:
    """The windows of a block of documents whose least digit is left and is hot, or isn't."""
    grid = Grid(b.column("text"), SOLID, lower=False)
    g, low, window = _digits(grid, threshold, digit)
    lists = b.column("places")
    sizes = np.asarray(lists.value_lengths())
    own = np.asarray(b.column("hot").flatten()) == hot
    at = np.repeat(grid.row[:-1], sizes)[own] + lists.flatten().to_numpy(zero_copy_only=False)[own]
    at = np.unique(at[at < np.repeat(grid.row[1:], sizes)[own]])  # a repeated doc_id may have a shorter text
    alive = np.unique(g[at])
    if not len(alive):
        return np.zeros(0, _PLACE)
    i = np.minimum(np.searchsorted(alive, low), len(alive) - 1)
    starts = np.flatnonzero(window & (alive[i] == low))
    whole, _ = grid.ngrams(threshold)
    row = _row_of(grid)[starts]
    rec = np.empty(len(starts), _PLACE)
    rec["low"], rec["whole"] = low[starts], whole[starts]
    rec["doc"], rec["pos"] = b.column("doc_id").to_numpy(zero_copy_only=False)[row], starts - grid.row[row]
    return rec


def _passes(rec: np.ndarray) -> np.ndarray:
    """The windows of a bucket in order, without those that stand alone: by one digit after the other, the most significant first."""
    group = np.zeros(len(rec), np.int64)
    for digit in ("low", "whole"):
        order = np.lexsort((rec[digit], group))
        rec, group = rec[order], group[order]
        new = np.ones(len(rec), bool)
        new[1:] = (group[1:] != group[:-1]) | (rec[digit][1:] != rec[digit][:-1])
        group = np.cumsum(new) - 1
        left = np.bincount(group)[group] > 1 if len(rec) else new
        rec, group = rec[left], group[left]
    order = np.lexsort((rec["pos"], rec["doc"], group))
    rec, group = rec[order], group[order]
    same = np.zeros(len(rec), bool)  # equal rows are one place
    same[1:] = (rec["doc"][1:] == rec["doc"][:-1]) & (rec["pos"][1:] == rec["pos"][:-1]) & (group[1:] == group[:-1])
    rec, group = rec[~same], group[~same]
    out = np.empty(len(rec), _SPAN)
    out["doc"], out["pos"] = rec["doc"], rec["pos"]
    out["first"] = np.concatenate([[True], group[1:] != group[:-1]])[: len(rec)]
    return out[np.bincount(group)[group] > 1] if len(rec) else out


def second_pass(docs: DataFrame, places: DataFrame, threshold: int, digit: int) -> DataFrame:
    """(doc_id, start_token, end_token, is_first): the spans of the repeated windows."""
    spark = docs.sparkSession
    n = S.buckets(spark)
    wanted = docs.join(places, "doc_id").select("doc_id", "text", "places", "hot")

    def cold(batches):
        p = S.Packer(n)
        for batch in batches:
            for b in blocks(batch, "text"):
                rec = _windows(b, threshold, digit, False)
                if len(rec):
                    yield from p.add(rec["low"], rec)
        yield from p.flush()

    def equal(rec):
        parts = list(S.pack((got["doc"] % n).astype(np.int32), got)) if len(got := _passes(rec)) else []
        return pa.Table.from_batches(parts) if parts else pa.table({"bucket": pa.array([], pa.int32()), "blob": pa.array([], pa.binary())})

    packed = S.by_bucket(wanted.mapInArrow(cold, S.PACKED), equal, _PLACE, S.PACKED)
    if not places.filter(F.exists("hot", lambda x: x)).isEmpty():
        packed = packed.unionByName(_hot_windows(wanted, threshold, digit, n))

    def runs(rec):  # consecutive windows of one standing become one span
        rec = rec[np.lexsort((rec["pos"], rec["doc"]))]
        same = np.zeros(len(rec), bool)
        same[1:] = (rec["doc"][1:] == rec["doc"][:-1]) & (rec["pos"][1:] == rec["pos"][:-1])
        if same.any():  # a repeated doc_id with several texts: a place is first only if all its windows are
            low = np.minimum.reduceat(rec["first"], np.flatnonzero(~same))
            rec = rec[~same]
            rec["first"] = low
        cont = np.zeros(len(rec), bool)
        cont[1:] = (rec["doc"][1:] == rec["doc"][:-1]) & (rec["pos"][1:] == rec["pos"][:-1] + 1) & (rec["first"][1:] == rec["first"][:-1])
        at = np.flatnonzero(~cont)
        size = np.diff(np.append(at, len(rec)))
        return pa.table({"doc_id": rec["doc"][at], "start_token": rec["pos"][at], "end_token": (rec["pos"][at] + size - 1 + threshold).astype(np.int32), "is_first": rec["first"][at] == 1})

    return S.by_bucket(packed, runs, _SPAN, "doc_id long, start_token int, end_token int, is_first boolean")


def _hot_windows(wanted: DataFrame, threshold: int, digit: int, n: int) -> DataFrame:
    """The repeated windows of hot digits, packed by document."""
    names = ["low", "whole"]

    def hot(batches):
        for batch in batches:
            for b in blocks(batch, "text"):
                rec = _windows(b, threshold, digit, True)
                if not len(rec):
                    continue
                yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(rec[x]).view(np.int64)) for x in names), pa.array(np.ascontiguousarray(rec["doc"])), pa.array(np.ascontiguousarray(rec["pos"]))], [*names, "doc", "pos"])

    rows = S.cut(wanted.mapInArrow(hot, "low long, whole long, doc long, pos int"))
    place = F.struct("doc", "pos")
    ends = rows.groupBy(*names).agg(F.min(place).alias("x"), F.max(place).alias("y")).filter("x <> y").select(*names, "x")
    found = rows.join(ends, names).select("doc", "pos", (F.col("x") == place).cast("int").alias("first"))

    def packs(batches):
        p = S.Packer(n)
        for b in batches:
            rec = np.empty(len(b), _SPAN)
            for x in ("doc", "pos", "first"):
                rec[x] = b.column(x).to_numpy()
            yield from p.add((rec["doc"] % n).astype(U64), rec)
        yield from p.flush()

    return found.mapInArrow(packs, S.PACKED)


def repeated_passages(docs: DataFrame, threshold: int = THRESHOLD, digit: int = DIGIT, hot: int = HOT) -> DataFrame:
    """(doc_id, start_token, end_token, is_first): spans covered by consecutive repeated windows.

    ``is_first`` tells whether the span's windows occur here first; the other spans are what dedup removes.
    end_token is exclusive.
    """
    docs = _read(docs)
    return S.kept(lambda: second_pass(docs, first_pass(docs, threshold, digit, hot), threshold, digit))


SQL = f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(text, '[^\\x00-\\x20]+') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
), windows AS (
  SELECT doc_id, p - 1 AS pos, md5(array_to_string(w[p:p + {THRESHOLD - 1}], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {THRESHOLD - 2})) AS p FROM words)
), repeated AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) = 1 AS is_first
  FROM windows QUALIFY count(*) OVER (PARTITION BY h) > 1
), islands AS (
  SELECT *, pos - row_number() OVER (PARTITION BY doc_id, is_first ORDER BY pos) AS island FROM repeated
)
SELECT doc_id, CAST(min(pos) AS INTEGER) AS start_token, CAST(max(pos) + {THRESHOLD} AS INTEGER) AS end_token, is_first
FROM islands GROUP BY doc_id, is_first, island
"""
