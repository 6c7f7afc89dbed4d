"""Substring dedup by hashing paragraphs of lines and sentences.

Words are runs of bytes above the space. A line ends at a line feed, and a line falls into units after words that
end in one of . ! ? , ; : | (behind it, a quote or bracket may follow). Each unit opens a paragraph: it and those after it
in the text, over line ends too, until there are RUN_WORDS words or more. A paragraph's normalised form is its words in
lower case with one space between; its digest has 128 bits. Digests are grouped over the whole corpus; the
earliest paragraph in (doc_id, unit) order stays and the others are removed, with the character offsets of the original text
retained. So what is removed are runs of consecutive lines and clauses of RUN_WORDS words that stand elsewhere too,
wherever they begin in a line (a run's first and last clause may stay); stock lines and sentences that are shorter stay, and so does a text of fewer words.

Cases: a null text is an empty one and has no units; rows without doc_id are
ignored; rows that repeat a doc_id have the same unit numbers, and of equal paragraphs with
equal numbers the one that starts first stays (all of them if they coincide, since
they are one place). Very long texts, and lines without any mark, are read whole. An empty table gives an empty result.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared as S
from ._text import _Q, _QINV, SOLID, U64, Grid, _powers, blocks, large, mix, raw

#: Words of a paragraph at least: of fifty words that repeat, the clauses at either end may be cut.
RUN_WORDS = 40

_R = 0xD6E8FEB86659FD93
_RINV = pow(_R, -1, 1 << 64)
_STOP, _CLOSE = np.zeros(256, bool), np.zeros(256, bool)
_STOP[[*b".!?,;:|"]] = True
_CLOSE[[*b"\"')]"]] = True


def paragraphs(column: pa.Array, run_words: int = RUN_WORDS) -> tuple[np.ndarray, ...]:
    """(row, unit, start, end, high, low): the paragraphs of some texts; start and end are characters of their rows, end exclusive."""
    column = large(column)
    grid = Grid(column, SOLID)
    n = len(grid.start)
    if not n:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, U64),) * 2
    data, at = raw(column)  # as it was: small letters may have other lengths
    head = (data & 0xC0) != 0x80
    if len(data) == len(grid.data) and np.array_equal(head, (grid.data & 0xC0) != 0x80):
        start, end = grid.start, grid.end
    else:
        as_it_was = Grid(column, SOLID, lower=False)
        start, end = as_it_was.start, as_it_was.end
    row = np.repeat(np.arange(len(at) - 1), np.diff(grid.row))
    feeds = np.flatnonzero(data == 10)
    ends = np.zeros(n, bool)
    ends[np.searchsorted(start, feeds[feeds > start[0]]) - 1] = True
    ends[np.searchsorted(start, at[1:][at[1:] > start[0]]) - 1] = True
    last, before = data[end - 1], data[np.maximum(end - 2, start)]
    ends |= _STOP[last] | _CLOSE[last] & _STOP[before]
    z = np.flatnonzero(ends) + 1  # behind each unit's last word
    a = np.concatenate([[0], z[:-1]])
    own = row[a]
    unit = np.arange(len(a)) - np.searchsorted(own, own)
    j = np.searchsorted(z, a + run_words)
    ok = j < len(z)
    ok[ok] = own[ok] == own[j[ok]]
    a, unit, own, z = a[ok], unit[ok], own[ok], z[j[ok]]
    digests = []
    for h, base, inverse in ((grid.hash, _Q, _QINV), (mix(grid.hash ^ U64(_R)), _R, _RINV)):
        total = np.zeros(n + 1, U64)
        np.cumsum(h * _powers(inverse, n), out=total[1:])
        digests.append(mix((total[z] - total[a]) * _powers(base, n + 1)[z] + (z - a).astype(U64)))
    chars = np.concatenate([[0], np.cumsum(head)])
    first = chars[at[own]]
    return own, unit, chars[start[a]] - first, chars[end[z - 1]] - first, *digests


def units(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """(high, low, doc_id, unit, start, end) of each paragraph."""

    def run(batches):
        for batch in batches:
            for b in blocks(batch, "text"):
                row, unit, start, end, high, low = paragraphs(b.column("text"), run_words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), b.column("doc_id").take(pa.array(row)), *(pa.array(x.astype(np.int32)) for x in (unit, start, end))],
                    ["high", "low", "doc_id", "unit", "start", "end"],
                )

    read = S.texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    return read.mapInArrow(run, "high long, low long, doc_id long, unit int, start int, end int")


def repeated_units(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """(doc_id, unit, start, end, kept_doc_id, kept_unit) of every paragraph to remove, with the place of the one that stays.

    A digest's first place is found with partial sums in each task; the join with them is an inner one, which
    splits where a digest is hot. Both sides make the paragraphs from the texts: that is cheaper than to store them.
    """
    found = units(docs, run_words)
    place = F.struct("doc_id", "unit", "start")
    first = found.groupBy("high", "low").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("high", "low", "first")
    return (
        found.join(first, ["high", "low"])
        .filter(place != F.col("first"))
        .select("doc_id", "unit", "start", "end", F.col("first.doc_id").alias("kept_doc_id"), F.col("first.unit").alias("kept_unit"))
        .distinct()
    )


def remove(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given spans, which may overlap, and without the white space behind each up to a line's end."""
    out, at = [], 0
    for a, b in sorted(spans):
        out.append(text[at:a] if a > at else "")
        at = max(at, b)
        while at < len(text) and text[at] in " \t":
            at += 1
        if at < len(text) and text[at] == "\n" and (a == 0 or text[a - 1] == "\n"):
            at += 1
    out.append(text[at:])
    return "".join(out)


SQL = f"""
WITH pieces AS (
  SELECT doc_id, regexp_extract_all(text, '[^\\x00-\\x20]+|[\\x00-\\x20]+') AS p FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
), each AS (
  SELECT doc_id, k, p[k] AS s, p[k + 1] AS gap FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS k FROM pieces)
), placed AS (
  SELECT *, coalesce(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM each
), words AS (
  SELECT doc_id, k, row_number() OVER w AS n, lower(s) AS word, place AS start, place + length(s) AS stop,
         (gap IS NULL OR contains(gap, chr(10)) OR regexp_matches(s, '[.!?,;:|]["'')\\]]?$'))::INT AS ends
  FROM placed WHERE NOT regexp_matches(s, '^[\\x00-\\x20]') WINDOW w AS (PARTITION BY doc_id ORDER BY k)
), numbered AS (
  SELECT *, coalesce(sum(ends) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS unit FROM words
), units AS (
  SELECT doc_id, unit, min(n) AS a, max(n) AS z, min(start) AS start, max(stop) AS stop, string_agg(word, ' ' ORDER BY n) AS body FROM numbered GROUP BY doc_id, unit
), reach AS (
  SELECT i.doc_id, i.unit, i.start, j.unit AS last, j.stop FROM units i ASOF JOIN units j ON i.doc_id = j.doc_id AND i.a + {RUN_WORDS - 1} <= j.z
), paragraphs AS (
  SELECT r.doc_id, r.unit, r.start, r.stop, md5(string_agg(u.body, ' ' ORDER BY u.unit)) AS digest
  FROM reach r JOIN units u ON u.doc_id = r.doc_id AND u.unit BETWEEN r.unit AND r.last GROUP BY r.doc_id, r.unit, r.start, r.stop
), ranked AS (
  SELECT *, first_value(doc_id) OVER w AS kept_doc_id, first_value(unit) OVER w AS kept_unit, row_number() OVER w AS nth
  FROM paragraphs WINDOW w AS (PARTITION BY digest ORDER BY doc_id, unit)
)
SELECT doc_id, CAST(unit AS INTEGER) AS unit, CAST(start AS INTEGER) AS "start", CAST(stop AS INTEGER) AS "end", kept_doc_id, CAST(kept_unit AS INTEGER) AS kept_unit
FROM ranked WHERE nth > 1
"""
