"""Best-fit packing by exact-complement hashing.

Documents are cut into pieces of at most CONTEXT tokens; pieces are packed into
sequences of CONTEXT tokens. Only the number of pieces of each length matters for the
plan, so the plan is made from that histogram, whose size is bounded by CONTEXT and not
by the corpus:

1. From the longest length down, the gap that a piece leaves is looked up as a single
   length, then as the sum of a pair, then of a triple, in an index of the lengths that
   are still available (a bit set; two lengths make a sum if the set meets its own
   mirrored shift). A combination that fills the gap exactly is consumed as often as the
   counts of its lengths allow, which uses one of them up.
2. What is left is packed best-fit decreasing: each length goes into the open sequences
   with the least gap that takes it, many equal sequences at once.

A plan row stands for many equal sequences. Pieces are numbered within their length, in
(doc_id, piece) order, and a piece's number tells its sequence and its place; the
numbering is distributed over ranges of documents.

Tokens are those of a byte-pair vocabulary, VOCABULARY unless another file is named. The driver reads the file and broadcasts it.
The vocabulary's pattern never joins what white space parts, so a text's tokens are the sum of those of its words (each with the
space before it) and of the gaps between, and each distinct word is encoded once. pack() fails where the file that it is given is missing,
can't be read or is no such vocabulary. Lengths are estimated only for who asks for it with tokenizer None: one token for each started
PER_TOKEN bytes of a run of characters above the space. lengths() alone, given a path where nothing is, warns and estimates.

Cases: a null or empty text has no piece. Every row is a document, whether its doc_id
is null or repeated; equal rows are interchangeable. Long texts are cut and lose nothing. Ties between lengths go to the larger one. An
empty table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import warnings
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _shared as S
from ._text import SOLID, U64, Grid, blocks, large, raw

CONTEXT = 2048
PER_TOKEN = 4
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Distinct words whose counts a task remembers.
REMEMBERED = 500_000

#: White space of the pattern beyond ASCII, and control characters: texts that hold any are encoded as a whole.
_UNUSUAL = "[\\x00-\\x08\\x0e-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def vocabulary(path: str | None = VOCABULARY) -> bytes | None:
    """A vocabulary file's bytes; None where no file is. One that can't be read or is no byte-pair vocabulary is an error."""
    if not path:
        return None
    try:
        with open(path, "rb") as f:
            ranks = f.read()
    except FileNotFoundError:
        return None
    _ranks(ranks, path)
    return ranks


def _ranks(ranks: bytes, path: str = "the vocabulary") -> dict[bytes, int]:
    """Tokens and their ranks: every single byte, and no rank twice or left out."""
    import base64

    try:
        found = {base64.b64decode(a, validate=True): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    except ValueError as e:
        raise ValueError(f"{path} is no byte-pair vocabulary: {e}") from e
    if not all(bytes([b]) in found for b in range(256)) or sorted(found.values()) != [*range(len(found))]:
        raise ValueError(f"{path} is no whole byte-pair vocabulary: it lacks bytes or ranks")
    return found


@lru_cache(maxsize=2)
def _encoder(ranks: bytes):
    import tiktoken

    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=_ranks(ranks), special_tokens={})


class Counter:
    """Tokens of texts under a vocabulary, word by word."""

    def __init__(self, ranks: bytes):
        self.encode = _encoder(ranks).encode_ordinary
        self.known: dict[int, int] = {}

    def count(self, column: pa.Array) -> np.ndarray:
        column = large(column)
        out = np.zeros(len(column), np.int64)
        odd = np.asarray(pc.match_substring_regex(column, _UNUSUAL))
        for i in np.flatnonzero(odd):
            out[i] = len(self.encode(column[i].as_py()))
        if odd.any():
            column = pc.if_else(pa.array(odd), "", column)
        grid = Grid(column, SOLID, lower=False)
        data, at = grid.data, grid.at
        if not len(data):
            return out
        row = np.repeat(np.arange(len(column)), np.diff(grid.row))
        first = np.zeros(len(grid.start), bool)
        first[grid.row[:-1][np.diff(grid.row) > 0]] = True
        gap = grid.start - np.where(first, at[row], np.concatenate([[0], grid.end[:-1]])[: len(first)])  # white space before each word
        spaced = (gap > 0) & (data[np.maximum(grid.start - 1, 0)] == 32)
        out += np.bincount(row, self._words(grid, data, spaced), len(column)).astype(np.int64)
        # a gap's last sign stands alone unless it is a space, and what precedes it is one piece
        for k in np.flatnonzero((gap > 1) | (gap == 1) & ~spaced):
            body = bytes(data[grid.start[k] - gap[k] : grid.start[k]])
            out[row[k]] += self._gap(body[:-1]) + (0 if spaced[k] else self._gap(body[-1:]))
        last = np.where(np.diff(grid.row) > 0, grid.end[np.maximum(grid.row[1:] - 1, 0)] if len(grid.end) else 0, at[:-1])
        for i in np.flatnonzero(at[1:] > last):
            out[i] += self._gap(bytes(data[last[i] : at[i + 1]]))
        return out

    def _words(self, grid: Grid, data: np.ndarray, spaced: np.ndarray) -> np.ndarray:
        keys, one, back = np.unique(grid.hash ^ spaced.astype(U64), return_index=True, return_inverse=True)
        n = np.empty(len(keys), np.int64)
        for i, (key, k) in enumerate(zip(keys.tolist(), one.tolist())):
            found = self.known.get(key)
            if found is None:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                found = self.known[key] = len(self.encode(bytes(data[grid.start[k] - int(spaced[k]) : grid.end[k]]).decode()))
            n[i] = found
        return n[back]

    def _gap(self, body: bytes) -> int:
        if not body:
            return 0
        if len(body) > 7:
            return len(self.encode(body.decode()))
        key = -1 - int.from_bytes(body, "little")  # no word's hash is negative
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = len(self.encode(body.decode()))
        return found


def estimated(column: pa.Array, per_token: int = PER_TOKEN) -> np.ndarray:
    """Tokens of each text as estimated without a vocabulary."""
    data, at = raw(large(column))
    mask = np.zeros(len(data) + 1, bool)
    mask[:-1] = SOLID[data]
    edge = np.diff(mask.astype(np.int8), prepend=0)
    inner = at[1:-1][at[1:-1] < len(data)]
    start = np.flatnonzero(np.concatenate([edge == 1]))
    end = np.flatnonzero(edge == -1)
    split = inner[mask[inner] & (inner > 0) & mask[inner - 1]]  # a run may not go on in the next row
    if len(split):
        start, end = np.unique(np.concatenate([start, split])), np.unique(np.concatenate([end, split]))
    size = -(-(end - start) // per_token)
    total = np.concatenate([[0], np.cumsum(size)])
    return np.diff(total[np.searchsorted(start, at)])


def lengths(docs: DataFrame, tokenizer: str | None = VOCABULARY) -> DataFrame:
    """(doc_id, n): tokens of each row that has any."""
    ranks = vocabulary(tokenizer)
    if tokenizer is not None and ranks is None:
        warnings.warn(f"no vocabulary at {tokenizer!r}: lengths are estimates", stacklevel=2)
    return _lengths(docs, ranks)


def _lengths(docs: DataFrame, ranks: bytes | None) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        count = estimated if shared.value is None else Counter(shared.value).count
        for batch in batches:
            for b in blocks(batch, "text"):
                n = count(b.column("text"))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n)], ["doc_id", "n"]).filter(pa.array(n > 0))

    return S.texts(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long")


class Stock:
    """How many pieces of each length are left, and the index of the sums that they make."""

    def __init__(self, counts: dict[int, int], context: int):
        self.left = [0] * (context + 1)
        self.context, self.have, self.mirror = context, 0, 0
        for n, c in counts.items():
            self.left[n] = c
            if c:
                self.have |= 1 << n
                self.mirror |= 1 << (context - n)

    def take(self, n: int, c: int) -> None:
        self.left[n] -= c
        if not self.left[n]:
            self.have &= ~(1 << n)
            self.mirror &= ~(1 << (self.context - n))

    def pairs(self, total: int) -> int:
        """The lengths a with another length total - a, as a bit set."""
        shift = total - self.context
        return self.have & (self.mirror << shift if shift >= 0 else self.mirror >> -shift)

    def fits(self, parts: tuple[int, ...]) -> int:
        """How many times the parts can be taken together."""
        return min(self.left[p] // parts.count(p) for p in set(parts))

    def complement(self, n: int) -> tuple[int, ...] | None:
        """Lengths that fill the gap beside n: one, else two, else three; larger ones first."""
        gap = self.context - n
        if gap == 0:
            return ()
        if self.left[gap] and self.fits((n, gap)):
            return (gap,)
        below = self.have & ((1 << gap) - 1)
        found = self._pair(gap, (n,))
        if found:
            return found
        firsts = below
        while firsts:
            a = firsts.bit_length() - 1
            firsts ^= 1 << a
            if 3 * a < gap:  # the largest of three is a third at least
                break
            found = self._pair(gap - a, (n, a), a)
            if found:
                return (a, *found)
        return None

    def _pair(self, total: int, beside: tuple[int, ...], most: int | None = None) -> tuple[int, int] | None:
        bits = self.pairs(total) & ((1 << ((most or total) + 1)) - 1)
        while bits:
            a = bits.bit_length() - 1
            bits ^= 1 << a
            if 2 * a < total:
                break
            if self.fits((*beside, a, total - a)):
                return a, total - a
        return None


def plan(counts: dict[int, int], context: int) -> list[tuple[int, tuple[int, ...]]]:
    """(number of sequences, lengths in each): every piece once."""
    stock = Stock(counts, context)
    out: list[tuple[int, tuple[int, ...]]] = []
    for n in range(context, 0, -1):
        while stock.left[n]:
            rest = stock.complement(n)
            if rest is None:
                break
            parts = (n, *rest)
            times = stock.fits(parts)
            for p in parts:
                stock.take(p, times)
            out.append((times, parts))
    # Best fit decreasing on what no combination filled: open sequences by gap, as (times, parts).
    gaps: list[int] = []
    open_: dict[int, list[tuple[int, tuple[int, ...]]]] = {}

    def put(times: int, parts: tuple[int, ...], gap: int) -> None:
        if gap == 0:
            out.append((times, parts))
        elif times:
            if gap not in open_:
                open_[gap] = []
                insort(gaps, gap)
            open_[gap].append((times, parts))

    for n in range(context, 0, -1):
        left = stock.left[n]
        while left:
            i = bisect_left(gaps, n)
            if i == len(gaps):
                each = context // n  # an open sequence with room takes the next equal piece too
                full, last = divmod(left, each)
                if full:
                    put(full, (n,) * each, context - each * n)
                if last:
                    put(1, (n,) * last, context - last * n)
                left = 0
                continue
            gap = gaps[i]
            times, parts = open_[gap].pop()
            if not open_[gap]:
                del open_[gap]
                gaps.pop(i)
            each = gap // n
            full = min(times, left // each)
            left -= full * each
            if full:
                put(full, parts + (n,) * each, gap - each * n)
            if full < times and 0 < left < each:
                put(1, parts + (n,) * left, gap - left * n)
                put(times - full - 1, parts, gap)
                left = 0
            elif full < times:
                put(times - full, parts, gap)
    for gap in gaps:
        out.extend(open_[gap])
    return out


_ROW = np.dtype([("n", "i8"), ("from_", "i8"), ("to", "i8"), ("seq", "i8"), ("copies", "i8"), ("slot", "i8"), ("start", "i8")])


def intervals(made: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """For each length and plan row, which numbers of that length it uses, and for which sequences and places."""
    used: dict[int, int] = {}
    rows, seq = [], 0
    for times, parts in made:
        slot = start = 0
        while slot < len(parts):
            n, copies = parts[slot], 1
            while slot + copies < len(parts) and parts[slot + copies] == n:
                copies += 1
            at = used.get(n, 0)
            rows.append((n, at, at + times * copies, seq, copies, slot, start))
            used[n] = at + times * copies
            slot, start = slot + copies, start + copies * n
        seq += times
    return np.array(sorted(rows), _ROW)


def numbered(pieces: DataFrame) -> DataFrame:
    """pieces with ``number``, from 0 within each length in (doc_id, piece) order within ranges of documents."""
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.withColumn("range", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
    sizes = pieces.groupBy("n_tokens", "range").count()
    before = sizes.select("n_tokens", "range", (F.sum("count").over(W.partitionBy("n_tokens").orderBy("range")) - F.col("count")).alias("before"))
    own = pieces.withColumn("own", F.row_number().over(W.partitionBy("n_tokens", "range").orderBy("doc_id", "piece")))
    return own.join(S.small(S.cut(before)), ["n_tokens", "range"]).select("doc_id", "piece", "start_token", "n_tokens", (F.col("before") + F.col("own") - 1).alias("number"))


def pack(docs: DataFrame, context: int = CONTEXT, tokenizer: str | None = VOCABULARY) -> DataFrame:
    """(seq_id, slot, seq_start, doc_id, piece, start_token, n_tokens): every token of every document in one sequence.

    tokenizer: a vocabulary file, which must be there; None for estimated lengths.
    """
    ranks = vocabulary(tokenizer)
    if tokenizer is not None and ranks is None:
        raise FileNotFoundError(f"no vocabulary at {tokenizer!r}; tokenizer=None packs by estimated lengths")
    return S.kept(lambda: _packed(docs, context, ranks))


def _packed(docs: DataFrame, context: int, ranks: bytes | None) -> DataFrame:
    spark = docs.sparkSession
    sized = S.cut(_lengths(docs, ranks))
    pieces = sized.select("doc_id", "n", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / context).cast("int"))).alias("piece"))
    start = F.col("piece").cast("long") * context
    pieces = pieces.select("doc_id", "piece", start.alias("start_token"), F.least(F.lit(context), F.col("n") - start).alias("n_tokens"))
    counts = {r.n_tokens: r["count"] for r in pieces.groupBy("n_tokens").count().collect()}  # one row for each length: context rows at most
    shared = spark.sparkContext.broadcast(intervals(plan(counts, context)))

    def place(batches):
        rows = shared.value
        key = rows["n"] * (1 << 44) + rows["from_"]
        for b in batches:
            n, number = b.column("n_tokens").to_numpy(), b.column("number").to_numpy()
            r = rows[np.searchsorted(key, n * (1 << 44) + number, "right") - 1]
            nth, copy = np.divmod(number - r["from_"], r["copies"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(r["seq"] + nth), pa.array((r["slot"] + copy).astype(np.int32)), pa.array((r["start"] + copy * n).astype(np.int32)), b.column("doc_id"), b.column("piece"), b.column("start_token"), pa.array(n.astype(np.int32))],
                ["seq_id", "slot", "seq_start", "doc_id", "piece", "start_token", "n_tokens"],
            )

    return numbered(pieces).mapInArrow(place, "seq_id long, slot int, seq_start int, doc_id long, piece int, start_token long, n_tokens int")
