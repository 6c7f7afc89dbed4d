"""Toxicity of texts behind leetspeak, spacing and repetition, by a noisy channel.

1. A character language model (four letters deep, interpolated) is counted over the words of all
   documents.
2. Tokens that the channel could have changed - signs or digits of LEET in a token with letters, or other
   such signs side by side, letters repeated three times, single letters or signs set apart by any number of
   spaces or marks - become character lattices: each sign
   may stand for a letter, for nothing or for a word's end, each repetition for one, two or all its letters (a sign
   that is repeated more than three times too). The
   Viterbi path under the model and the channel's costs is the restored text. A number, without letters or
   other signs, is taken as it is. Every other token has a lattice of one path, which is itself, and needs no search.
3. Restored words are scored by their beginnings of LEAST bytes or more, up to the whole word (its end counts as one
   byte), so inflected forms count too. The beginnings are learnt from at most SAMPLE labelled documents of each class, from DRAW
   times as many drawn ones without near copies: kept are those whose toxic share among all
   labelled documents (the classes' sampling is undone) has a lower confidence bound of LEAST_SHARE at least, surer ones
   first, and of those that go on from one another what the surer ones leave.
4. A text's score is the chance that any of its distinct hits is toxic; toxic from THRESHOLD on.

Cases: a null or empty text scores 0; every row is scored, rows that repeat one by one, and a row without
doc_id under a null; labels that are null or contradict one another are ignored; without toxic labels every score is 0. Long texts
are scored whole, and long words too. Ties: equal paths go to the one found first, equal hashes of drawn documents to the lower doc_id. An
empty table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared as S
from ._text import SOLID, U64, Grid, blocks, large, mix, raw

#: Labelled documents of each class that the scores are learnt from.
SAMPLE = 4000
#: So many times SAMPLE are drawn of each class, before near copies are left out.
DRAW = 4
#: Least values of a document's shingles: of those that share one, only the lowest doc_id is learnt from.
LOWS = 8
LEAST_SHARE = 0.5
#: Standard deviations of the confidence bound.
SURE = 3.0
THRESHOLD = 0.5
#: Bytes of the shortest beginning that counts.
LEAST = 4

#: What a sign may stand for. None: a word's end.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
_SUBSTITUTE, _DROP, _BREAK, _FEWER = math.log(0.25), math.log(0.05), math.log(0.05), math.log(0.3)
_SEPARATORS = " .-_*~/'`"
_SEED, _PRIME = U64(0xCBF29CE484222325), U64(0x100000001B3)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_ASCII = np.zeros(256, bool)
_ASCII[[*range(65, 91), *range(97, 123)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
#: Signs of LEET: those of one byte, and the bytes of the others.
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in LEET if c.isascii()]] = True
_WIDE = [np.frombuffer(c.encode(), np.uint8) for c in LEET if not c.isascii()]
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".-_*~/'`"]] = True

_CODES = np.zeros(0x250, np.uint32)
_ALPHABET = "abcdefghijklmnopqrstuvwxyzäöüßàâáãåæçèéêëíìîïñóòôõøúùûýÿœ"
for _k, _c in enumerate(_ALPHABET):
    if ord(_c) < len(_CODES):
        _CODES[ord(_c)] = _k + 1
#: Any other letter.
_OTHER = len(_ALPHABET) + 1
_BASE = 64
_NUMBER = {c: k + 1 for k, c in enumerate(_ALPHABET)}


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the runs of four symbols of the words in a lower-cased text; 0 is a word's end."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    sym = np.where(points < len(_CODES), _CODES[np.minimum(points, len(_CODES) - 1)], np.uint32(_OTHER))
    sym = np.concatenate([np.zeros(3, np.uint32), sym, np.zeros(1, np.uint32)])
    code = sym[:-3]
    for k in (1, 2, 3):
        code = code * np.uint32(_BASE) + sym[k : len(sym) - 3 + k]
    last = sym[3:]
    before = sym[2:-1]
    use = (last > 0) | (before > 0)  # each letter, and the end of each word
    # what lies before a word's end is not the word's context
    code = code[use]
    b, c = (code >> 6) & 63, (code >> 12) & 63
    code = np.where(b == 0, code & np.uint32(0x3F), np.where(c == 0, code & np.uint32(0xFFF), code))
    return np.unique(code, return_counts=True)


def counted(docs: DataFrame) -> DataFrame:
    """(gram, n) over all documents."""

    def run(batches):
        codes, ns, size = [], [], 0

        def flush():
            got, back = np.unique(np.concatenate(codes), return_inverse=True)
            n = np.bincount(back, np.concatenate(ns)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(got.astype(np.int32)), pa.array(n)], ["gram", "n"])

        for batch in batches:
            for b in blocks(batch, "text"):
                c, n = grams("\n".join(t for t in b.column("text").to_pylist() if t).lower())
                codes.append(c)
                ns.append(n)
                size += len(c)
                if size > 2_000_000:
                    yield flush()
                    codes, ns, size = [], [], 0
        if codes:
            yield flush()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class Language:
    """log P(letter | up to three letters before it in the word), Witten-Bell interpolated; '' as a letter is the word's end.

    Counts are kept as sorted arrays, by the number of letters before: 12 bytes for each kind of run.
    """

    def __init__(self, codes: np.ndarray, ns: np.ndarray):
        codes, ns = codes.astype(np.int64), ns.astype(np.int64)
        self.codes, self.ns, self.contexts = [], [], []
        for k in range(4):
            use = np.ones(len(codes), bool) if k == 0 else (codes >> (6 * k)) & 63 > 0
            got, back = np.unique(codes[use] & ((1 << (6 * k + 6)) - 1), return_inverse=True)
            n = np.bincount(back, ns[use], len(got)).astype(np.int64)
            at = np.flatnonzero(np.diff(got >> 6, prepend=-1))
            total = np.add.reduceat(n, at) if len(at) else n
            self.codes.append(got.astype(np.int32))
            self.ns.append(n)
            self.contexts.append(((got >> 6)[at].astype(np.int32), np.diff(np.append(at, len(got))).astype(np.int32), total))
        self.memo: dict[tuple[str, str], float] = {}

    def __getstate__(self):
        return {**self.__dict__, "memo": {}}

    def p(self, context: list[int], letter: int) -> float:
        k = len(context)
        base = 1 / (len(_ALPHABET) + 2) if not k else self.p(context[1:], letter)
        key = 0
        for x in context:
            key = key << 6 | x
        names, kinds, totals = self.contexts[k]
        i = int(np.searchsorted(names, key))
        if i == len(names) or names[i] != key:
            return base
        key = key << 6 | letter
        j = int(np.searchsorted(self.codes[k], key))
        seen = int(self.ns[k][j]) if j < len(self.codes[k]) and self.codes[k][j] == key else 0
        return (seen + int(kinds[i]) * base) / (int(totals[i]) + int(kinds[i]))

    def log(self, context: str, letter: str) -> float:
        key = (context, letter)
        found = self.memo.get(key)
        if found is None:
            if len(self.memo) > 500_000:
                self.memo.clear()
            found = self.memo[key] = math.log(self.p([_NUMBER.get(x, _OTHER) for x in context], _NUMBER.get(letter, _OTHER) if letter else 0))
        return found


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each place of a token, what may have been meant there (' ' for a word's end) and its channel cost."""
    token = token.lower()
    spaced = _spaced(token)
    out, i = [], 0
    while i < len(token):
        c = token[i]
        j = i
        while j < len(token) and token[j] == c:
            j += 1
        k = j - i
        if c.isalpha():
            out.append([(c * k, 0.0)] if k < 3 else [(c, _FEWER), (c * 2, _FEWER), (c * k, _BREAK * 2)])
        elif c in LEET:
            if k > 3:
                out.append([*((x * n, _SUBSTITUTE + cost) for x in LEET[c] for n, cost in ((1, _FEWER), (2, _FEWER), (k, 2 * _BREAK))), ("", _DROP), (" ", _BREAK)])
            for _ in range(k if k <= 3 else 0):
                out.append([*((x, _SUBSTITUTE) for x in LEET[c]), ("", _DROP), (" ", _BREAK)])
        elif spaced and c in _SEPARATORS:
            out.append([("", 0.0), (" ", 0.0 if k > 1 else 2 * _BREAK)])
        else:
            out.append([(" ", 0.0)])
        i = j
    return out


def _spaced(token: str) -> bool:
    """Whether marks or spaces set single letters apart."""
    pieces = [p for p in "".join(" " if c in _SEPARATORS else c for c in token).split(" ") if p]
    return len(pieces) > 2 and all(len(p) == 1 or len(set(p)) == 1 for p in pieces)


def restore(token: str, language: Language) -> str:
    """The likeliest words behind a token."""
    best: dict[str, tuple[float, object]] = {"": (0.0, None)}  # the last three letters of the word: (cost, path)
    for choices in lattice(token):
        new: dict[str, tuple[float, object]] = {}
        for context, (cost, path) in best.items():
            for meant, channel in choices:
                c, total = context, cost + channel
                if meant == " ":
                    if c:
                        total += language.log(c, "")
                    c = ""
                else:
                    for letter in meant:
                        total += language.log(c, letter)
                        c = (c + letter)[-3:]
                if c not in new or total > new[c][0]:
                    new[c] = (total, (meant, path) if meant else path)
        best = new
    cost, path = max(((cost + (language.log(c, "") if c else 0), path) for c, (cost, path) in best.items()), key=lambda x: x[0])
    out = []
    while path is not None:
        out.append(path[0])
        path = path[1]
    return " ".join("".join(reversed(out)).split())


def _spans(mask: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of a mask, each within its row."""
    size = len(mask)
    first = np.zeros(size + 1, bool)
    first[at] = True
    before, after = np.zeros(size, bool), np.zeros(size, bool)
    before[1:], after[:-1] = mask[:-1], mask[1:]
    before[first[:-1]] = False
    after[first[1:]] = False
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


def _sums(mask: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(mask)])


def suspects(column: pa.LargeStringArray) -> list[tuple[int, str]]:
    """(row, token) of the tokens, and of the runs of single letters or signs, that the channel may have changed."""
    data, at = raw(pc.utf8_lower(column))
    size = len(data)
    if size < 3:
        return []
    sign = _SIGN[data]
    for code in _WIDE:
        n = len(code)
        found = np.logical_and.reduce([data[k : size - n + 1 + k] == code[k] for k in range(n)])
        for k in range(n):
            sign[k : size - n + 1 + k] |= found
    letter = _LETTER[data] & ~sign
    start, end = _spans(SOLID[data], at)
    if not len(start):
        return []
    has = lambda mask: (lambda n: n[end] > n[start])(_sums(mask))
    other = sign & ~_DIGIT[data]
    pair = np.zeros(size, bool)  # signs side by side, unless both are digits
    pair[:-1] = sign[:-1] & sign[1:] & (other[:-1] | other[1:])
    thrice = np.zeros(size, bool)
    thrice[:-2] = _ASCII[data[:-2]] & (data[:-2] == data[1:-1]) & (data[:-2] == data[2:])
    lead = np.flatnonzero(data >= 0xC0)
    for n, low, high in ((2, 0xC0, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0x100)):
        i = lead[(data[lead] >= low) & (data[lead] < high) & (lead + 3 * n <= size)]
        if len(i):
            thrice[i] = np.logical_and.reduce([(data[i + k] == data[i + n + k]) & (data[i + k] == data[i + 2 * n + k]) for k in range(n)])
    flagged = has(sign) & has(letter) | has(pair) | has(thrice)
    row = np.searchsorted(at, start, "right") - 1
    view = memoryview(data)
    text = lambda a, z: bytes(view[a:z]).decode("utf-8", "replace")
    out = [(int(row[i]), text(start[i], end[i])) for i in np.flatnonzero(flagged)]
    marks = _sums(_MARK[data])
    for i in np.flatnonzero(~flagged & (marks[end] - marks[start] > 1)):
        if _spaced(token := text(start[i], end[i])):
            out.append((int(row[i]), token))
    # Runs of three or more single letters or signs, or of one of them repeated, with spaces and marks between.
    piece = letter | sign
    head, tail = _spans(piece, at)
    if len(head) < 3:
        return out
    chars, same = _sums((data & 0xC0) != 0x80), _sums(np.concatenate([[False], data[1:] == data[:-1]]))
    single = (chars[tail] - chars[head] == 1) | (same[tail] - same[head + 1] == tail - head - 1)
    single |= (tail - head == 2) & (_ASCII[data[head]] & (data[tail - 1] == ord("!")) | _ASCII[data[tail - 1]] & (data[head] == ord("(")))
    row = np.searchsorted(at, head, "right") - 1
    blank, hard = _sums(~SOLID[data]), _sums(SOLID[data] & ~_MARK[data] & ~piece)
    joined, tight = np.zeros(len(head), bool), np.zeros(len(head), bool)
    joined[1:] = single[1:] & single[:-1] & (row[1:] == row[:-1]) & (hard[head[1:]] == hard[tail[:-1]])
    tight[1:] = joined[1:] & (blank[head[1:]] == blank[tail[:-1]])  # by marks alone
    runs = set()
    for link in (joined, tight):
        first = np.flatnonzero(single & ~link)
        last = np.append(np.flatnonzero(~link[1:]), len(head) - 1)
        last = last[np.searchsorted(last, first)]
        runs.update((int(a), int(z)) for a, z in zip(first, last) if z - a >= 2)
    for a, z in sorted(runs):
        gaps = head[a + 1 : z + 1] - tail[a:z]
        wide = gaps > gaps.min()  # the least gap is within words, a wider one may be a word's end
        parts = [text(h, t) for h, t in zip(head[a : z + 1], tail[a : z + 1])]
        parts = [x if len(set(x)) == 1 else x.strip("!(") for x in parts]
        out.append((int(row[a]), parts[0] + "".join(" " * (1 + int(w)) + x for w, x in zip(wide, parts[1:]))))
    return out


def beginnings(start: np.ndarray, end: np.ndarray, data: np.ndarray, longest: int | None = None):
    """(n, words, hashes): for each n from LEAST on the words with so many bytes, the end counting as one, and the hashes of these."""
    length = end - start
    words = np.arange(len(start))
    h = np.full(len(start), _SEED, U64)
    n = 1
    while len(words) and (longest is None or n <= longest):
        long = length[words] >= n
        h = (h ^ np.where(long, data[np.minimum(start[words] + n - 1, len(data) - 1)], 32).astype(U64)) * _PRIME
        if n >= LEAST:
            yield n, words, h
        words, h = words[long], h[long]
        n += 1


def _hash(feature: bytes) -> int:
    h = int(_SEED)
    for c in feature:
        h = (h ^ c) * int(_PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


def restored(column: pa.Array, language: Language, memo: dict[str, str]) -> tuple[pa.Array, np.ndarray]:
    """The restored texts of the suspect tokens, one for each row that has any, and these rows."""
    by: dict[int, list[str]] = {}
    for row, token in suspects(large(column)):
        text = memo.get(token)
        if text is None:
            if len(memo) > 200_000:
                memo.clear()
            text = memo[token] = restore(token, language)
        by.setdefault(row, []).append(text)
    return pa.array([" ".join(x) for x in by.values()], pa.large_string()), np.array([*by], np.int64)


def _words(column: pa.Array, language: Language, memo: dict[str, str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, bytes) of the plain words and of the restored ones."""
    again, which = restored(column, language, memo)
    rows, starts, ends, data, size = [], [], [], [], 0
    for col, names in ((column, None), (again, which)):
        grid = Grid(col)
        row = np.repeat(np.arange(len(grid.row) - 1), np.diff(grid.row))
        rows.append(row if names is None else names[row])
        starts.append(grid.start + size)
        ends.append(grid.end + size)
        data.append(grid.data)
        size += len(grid.data)
    return np.concatenate(rows), np.concatenate(starts), np.concatenate(ends), np.concatenate([*data, np.zeros(1, np.uint8)])


def learnt(column: pa.Array, toxic: np.ndarray, language: Language, memo: dict[str, str]) -> pa.RecordBatch:
    """(feature, toxic, total): every beginning of the rows' words, with the rows of each kind that hold it."""
    row, start, end, data = _words(column, language, memo)
    parts = [(np.full(len(w), n), start[w], end[w], row[w], h) for n, w, h in beginnings(start, end, data)]
    size, at, stop, row, h = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(5))
    _, one = np.unique(h ^ mix(row.astype(U64) + U64(1)), return_index=True)  # each beginning once for each row
    size, at, stop, row, h = size[one], at[one], stop[one], row[one], h[one]
    _, first, back = np.unique(h, return_index=True, return_inverse=True)
    size, at, stop = size[first], at[first], stop[first]
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(at, size)
    last = np.cumsum(size) - 1
    body = data[np.minimum(place, len(data) - 1)]
    body[last[at + size > stop]] = 32  # the word's end
    off = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    names = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(body))])
    return pa.RecordBatch.from_arrays([names, pa.array(np.bincount(back, toxic[row], len(size)).astype(np.int64)), pa.array(np.bincount(back, minlength=len(size)).astype(np.int64))], ["feature", "toxic", "total"])


def _read(docs: DataFrame) -> DataFrame:
    return S.texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _labelled(docs: DataFrame, labels: DataFrame, most: int) -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, text, toxic) of at most so many documents of each class, without near copies, by the hash of doc_id; and of each class the
    part of all its labelled documents, near copies left out, that this is."""
    sure = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("high")).filter("toxic = high and toxic in (0, 1)").select("doc_id", "toxic")
    sure = S.cut(sure)
    totals = {r.toxic: r["count"] for r in sure.groupBy("toxic").count().collect()}  # two rows
    by_hash = lambda df, t, n: df.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    drawn = S.cut(by_hash(sure, 0, DRAW * most).unionByName(by_hash(sure, 1, DRAW * most)))
    texts = S.cut(_read(docs).join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic")))

    def run(batches):
        for batch in batches:
            for b in blocks(batch, "text"):
                grid = Grid(b.column("text"))
                g, ok = grid.ngrams(3)
                row = np.repeat(np.arange(len(b)), np.diff(grid.row))[ok]
                g = mix(g[ok])
                order = np.lexsort((g, row))
                g, row = g[order], row[order]
                new = np.ones(len(g), bool)
                new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
                g, row = g[new], row[new]
                low = np.arange(len(g)) - np.searchsorted(row, row) < LOWS
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row[low])), b.column("toxic").take(pa.array(row[low])), pa.array(g[low].view(np.int64))], ["doc_id", "toxic", "low"])

    lows = S.cut(texts.mapInArrow(run, "doc_id long, toxic int, low long"))
    first = lows.groupBy("toxic", "low").agg(F.min("doc_id").alias("first"))
    copies = lows.join(first, ["toxic", "low"]).filter("doc_id <> first").select("doc_id").distinct()
    one = S.cut(texts.select("doc_id", "toxic").join(copies, "doc_id", "left_anti"))
    chosen = S.cut(by_hash(one, 0, most).unionByName(by_hash(one, 1, most)))
    size = lambda df: {r.toxic: r["count"] for r in df.groupBy("toxic").count().collect()}
    n_drawn, n_one, n_chosen = size(texts), size(one), size(chosen)
    part = {t: n_chosen[t] / (totals[t] * n_one[t] / n_drawn[t]) for t in n_chosen}
    out = S.cut(texts.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi"))  # at most two times most
    S.drop(sure, drawn, texts, lows, one, chosen)
    return out, part


def lower_bound(hit: np.ndarray, total: np.ndarray, z: float = SURE) -> np.ndarray:
    """Wilson's lower bound of a share."""
    p = hit / total
    return (p + z * z / (2 * total) - z * np.sqrt(p * (1 - p) / total + z * z / (4 * total * total))) / (1 + z * z / total)


def _closed(hit: dict[bytes, tuple[int, int]], low: dict[bytes, float], odds: float) -> set[bytes]:
    """What represents the beginnings that are sure enough, by their bounds and then their lengths.

    Of those that are hit alike the longest stands for all (without the word's end). One that goes on from another that is
    kept adds nothing, and one of which others go on is kept only if what these leave of its hits is toxic too.
    """
    kept = {f for f, n in hit.items() if not (f.endswith(b" ") and hit.get(f[:-1]) == n)}
    for f in [*kept]:
        kept -= {f[:k] for k in range(LEAST, len(f)) if hit.get(f[:k]) == hit[f]}
    out: set[bytes] = set()
    beneath: dict[bytes, list[int]] = {}  # hits of the kept ones that go on from a beginning
    for f in sorted(kept, key=lambda f: (-low[f], len(f), f)):
        if any(f[:k] in out for k in range(LEAST, len(f))):
            continue
        below = beneath.get(f, (0, 0))
        toxic, other = max(0, hit[f][0] - below[0]), max(0, hit[f][1] - hit[f][0] - (below[1] - below[0]))
        if not below[1] or toxic and toxic * odds >= LEAST_SHARE * (toxic * odds + other):
            out.add(f)
            for k in range(LEAST, len(f)):
                old = beneath.setdefault(f[:k], [0, 0])
                old[0] += hit[f][0]
                old[1] += hit[f][1]
    return out


class Model:
    """Features (beginnings of words) and the least share of toxic documents among those that hold each."""

    def __init__(self, language: Language, share: dict[bytes, float]):
        names = sorted(share, key=_hash)
        self.language, self.share_of, self.memo = language, share, {}
        self.features, self.share = np.array([_hash(f) for f in names], U64), np.array([share[f] for f in names])
        self.longest = max(map(len, names), default=0)

    def __getstate__(self):
        return {**self.__dict__, "memo": {}}

    def score(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        if not len(self.features):
            return out
        row, start, end, data = _words(column, self.language, self.memo)
        found = []
        for _, w, h in beginnings(start, end, data, self.longest):
            i = np.minimum(np.searchsorted(self.features, h), len(self.features) - 1)
            ok = self.features[i] == h
            found.append(row[w[ok]] * len(self.features) + i[ok])
        row, i = np.divmod(np.unique(np.concatenate(found)), len(self.features)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        np.add.at(out, row, np.log1p(-np.minimum(self.share[i], 0.999)))
        return np.round(1 - np.exp(out), 6)


def fitted(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    t = counted(docs).toArrow().sort_by("gram")  # the kinds of runs of four among 64 symbols: 64 ** 4 rows of 12 bytes at the very most
    language = Language(t.column("gram").to_numpy(), t.column("n").to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast(language)

    def run(batches):
        memo: dict[str, str] = {}
        for batch in batches:
            for b in blocks(batch, "text"):
                yield learnt(b.column("text"), b.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64), shared.value, memo)

    chosen, part = _labelled(docs, labels, most)
    sums = S.texts(chosen).mapInArrow(run, "feature binary, toxic long, total long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("total").alias("total"))
    odds = part.get(0, 1.0) / part.get(1, 1.0)  # what undoes the classes' sampling
    best = sums.filter((F.col("toxic") >= 2) & (F.col("toxic") * odds >= LEAST_SHARE * (F.col("toxic") * odds + F.col("total") - F.col("toxic")))).toArrow()
    S.drop(chosen)
    names, x, n = best.column("feature").to_pylist(), best.column("toxic").to_numpy(), best.column("total").to_numpy()
    low = np.minimum(lower_bound(x, n), 1 - 1e-9) if len(x) else np.zeros(0)
    low = low * odds / (low * odds + 1 - low)
    hit = {f: (int(a), int(b)) for f, a, b, s in zip(names, x, n, low) if s >= LEAST_SHARE}
    bound = {f: float(s) for f, s in zip(names, low) if f in hit}
    return Model(language, {f: bound[f] for f in _closed(hit, bound, odds)})


def scores(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """(doc_id, score, toxic) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, **params))

    def run(batches):
        model = shared.value
        for batch in batches:
            for b in blocks(batch, "text"):
                s = model.score(b.column("text"))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array(s >= THRESHOLD)], ["doc_id", "score", "toxic"])

    return _read(docs).mapInArrow(run, "doc_id long, score double, toxic boolean")


def flagged(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """(doc_id, score) of the toxic rows among all."""
    return scores(docs, labels, **params).filter("toxic").select("doc_id", "score")
