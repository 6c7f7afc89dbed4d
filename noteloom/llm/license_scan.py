"""Licence recognition by sentence rules.

Text is read as lower-cased words (ASCII letters, digits and any non-ASCII
character). A sentence begins and ends at a mark of MARKS or at an end of the text,
so line ends and comment signs may surround or split it; sentences that belong to one licence
only may stand anywhere. Known sentences are mapped to
identifiers; of nested ones the outermost counts. Then the document's sequence of
identifiers is read from left to right: at each place the first of the ordered rules whose
sequence follows takes it, and an identifier that begins no rule is passed. The SQL holds SENTENCES and
RULES alone; ALL_SENTENCES and ALL_RULES add the licences' own texts, headers and further names.

Cases: a null or empty text has no licence; rows without doc_id are ignored; rows that
repeat are scanned one by one and equal results appear once; long texts are scanned
whole. An empty table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import texts
from ._text import U64, Grid, blocks

MARKS = ".!?;:,()\"\n"
#: Identifiers have three letters. Words as the reader sees them; the longest has eleven.
SENTENCES = {
    "apl": "licensed under the apache license",
    "apt": "the apache license",
    "apr": "released under the apache license",
    "apd": "distributed under the apache license",
    "apw": "this work is licensed under the apache license",
    "v20": "version 2 0",
    "v11": "version 1 1",
    "ve3": "version 3",
    "ve2": "version 2",
    "lat": "or any later version",
    "lao": "or at your option any later version",
    "mit": "released under the mit license",
    "mil": "licensed under the mit license",
    "mid": "distributed under the mit license",
    "mih": "the mit license",
    "mip": "permission is hereby granted",
    "foc": "free of charge",
    "gpw": "this work is licensed under the gnu general public license",
    "gpl": "licensed under the gnu general public license",
    "gpr": "released under the gnu general public license",
    "gpf": "under the terms of the gnu general public license",
    "gpt": "gnu general public license",
    "lgp": "licensed under the gnu lesser general public license",
    "agp": "licensed under the gnu affero general public license",
    "mpl": "licensed under the mozilla public license",
    "mpt": "mozilla public license",
    "bs2": "licensed under the bsd 2 clause license",
    "bs3": "licensed under the bsd 3 clause license",
    "br2": "released under the bsd 2 clause license",
    "br3": "released under the bsd 3 clause license",
    "isc": "licensed under the isc license",
    "ccb": "licensed under cc by 4 0",
    "ccs": "licensed under cc by sa 4 0",
    "ccn": "licensed under cc by nc 4 0",
    "cnd": "licensed under cc by nd 4 0",
    "cns": "licensed under cc by nc sa 4 0",
    "ccd": "licensed under cc by nc nd 4 0",
    "cc0": "released under cc0 1 0",
    "unl": "released into the public domain",
    "arr": "all rights reserved",
    "spa": "spdx license identifier",
    "ida": "apache 2 0",
    "idm": "mit",
    "idg": "gpl 3 0 or later",
    "ido": "gpl 3 0 only",
    "id3": "bsd 3 clause",
    "id2": "bsd 2 clause",
}
#: (licence, identifiers), first come, first served.
RULES: list[tuple[str, tuple[str, ...]]] = [
    *[(name, ("spa", i)) for i, name in (("ida", "Apache-2.0"), ("idm", "MIT"), ("idg", "GPL-3.0-or-later"), ("ido", "GPL-3.0-only"), ("id3", "BSD-3-Clause"), ("id2", "BSD-2-Clause"))],
    *[("Apache-2.0", (i, "v20")) for i in ("apl", "apr", "apd", "apw", "apt")],
    *[(f"GPL-{v}.0-or-later", (i, s, later)) for i in ("gpw", "gpl", "gpr", "gpf", "gpt") for v, s in ((3, "ve3"), (2, "ve2")) for later in ("lat", "lao")],
    *[(f"GPL-{v}.0", (i, s)) for i in ("gpw", "gpl", "gpr", "gpf", "gpt") for v, s in ((3, "ve3"), (2, "ve2"))],
    ("LGPL-3.0", ("lgp", "ve3")),
    ("AGPL-3.0", ("agp", "ve3")),
    ("MPL-2.0", ("mpl", "v20")),
    ("MPL-2.0", ("mpt", "v20")),
    ("MIT", ("mih", "mip", "foc")),
    ("MIT", ("mip", "foc")),
    *[("MIT", (i,)) for i in ("mit", "mil", "mid")],
    *[("BSD-2-Clause", (i,)) for i in ("bs2", "br2")],
    *[("BSD-3-Clause", (i,)) for i in ("bs3", "br3")],
    ("ISC", ("isc",)),
    ("CC-BY-4.0", ("ccb",)),
    ("CC-BY-SA-4.0", ("ccs",)),
    ("CC-BY-NC-4.0", ("ccn",)),
    ("CC-BY-ND-4.0", ("cnd",)),
    ("CC-BY-NC-SA-4.0", ("cns",)),
    ("CC-BY-NC-ND-4.0", ("ccd",)),
    ("CC0-1.0", ("cc0",)),
    ("public-domain", ("unl",)),
    ("proprietary", ("arr",)),
]


# What SENTENCES and RULES, which make the SQL, leave out.
_V = {"3.0": ("version 3", "version 3 0", "v3", "v 3", "v3 0", "3 0", "3"), "2.0": ("version 2", "version 2 0", "v2", "v 2", "v2 0", "2 0", "2"), "2.1": ("version 2 1", "v2 1", "v 2 1", "2 1")}
_LATER = ("or any later version", "or at your option any later version", "or later")
_GNU = {"GPL": "gnu general public license", "LGPL": "gnu lesser general public license", "AGPL": "gnu affero general public license"}
_GNU_NAMES = {f"{k}-{v}": [f"{n} {x}" for n in (full, f"gnu {k.lower()}", k.lower()) for x in _V[v]] + [f"{k.lower()}v{v[0]}", f"gnu {k.lower()}v{v[0]}"] * (v != "2.1") for k, full in _GNU.items() for v in {"GPL": ("3.0", "2.0"), "LGPL": ("3.0", "2.1"), "AGPL": ("3.0",)}[k]}
#: Names as they stand after "licensed under".
NAMES: dict[str, list[str]] = {
    "Apache-2.0": ["apache license version 2 0", "apache license version 2", "apache license 2 0", "apache 2 0 license", "apache license v2 0", "apache license v 2 0", "apache 2 0"],
    "MIT": ["mit license", "mit licence", "mit"],
    "BSD-2-Clause": ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "bsd 2 clause"],
    "BSD-3-Clause": ["bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license", "revised bsd license", "bsd 3 clause"],
    "ISC": ["isc license", "isc licence"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v2 0", "mozilla public license v 2 0", "mpl 2 0", "mpl v2 0"],
    **_GNU_NAMES,
    **{f"{k}-or-later": [f"{n} {x}" for n in names for x in _LATER] for k, names in _GNU_NAMES.items()},
}
_UNDER = [f"{a}{verb} under {terms}{the}" for a in ("", *(f"{x} is " for x in ("this project", "this software", "this program", "this library", "this code", "this work", "this package", "it"))) for verb in ("licensed", "released", "distributed", "available", "made available") for terms in ("", "the terms of ") for the in ("", "the ")]
_SPDX = ["MPL-2.0", "ISC", "0BSD", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "MIT OR Apache-2.0", "Apache-2.0 OR MIT", *(f"{k}{x}" for k in _GNU_NAMES for x in ("", "-only", "-or-later") if k + x not in ("GPL-3.0-only", "GPL-3.0-or-later"))]
_FSF = "as published by the free software foundation"
_ISC = "permission to use copy modify {} distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
#: Sentences by identifier. Those of ANYWHERE belong to one licence only and need no marks around them.
MORE: dict[str, list[str]] = {
    **{f"under {k}": [f"{u}{n}" for u in _UNDER for n in names] for k, names in NAMES.items()},
    **{f"spdx {k}": [k.lower().replace("-", " ").replace(".", " ")] for k in _SPDX},
    **{f"header {k}": [f"under the terms of the {n} {_FSF}"] for k, n in _GNU.items()},
    **{f"header {k}": [f"under the terms of the {_GNU[k.split('-')[0]]} {x} {_FSF}" for x in _V[k[-3:]][:2]] for k in _GNU_NAMES},
    **{f"title {k}": [n] for k, n in _GNU.items() if k != "GPL"},
    **{i: [f"{e}{x}{z}" for e in ("", "either ") for x in _V[v][:2] for z in ("", " of the license", " of the license only")] for i, v in (("ve3", "3.0"), ("ve2", "2.0"), ("v21", "2.1"))},
    "title Apache": ["apache license"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd 2": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd 3": ["to endorse or promote products derived from this software without specific prior written permission"],
    "bsd 4": ["all advertising materials mentioning features or use of this software must display the following acknowledgement"],
    "body ISC": [_ISC.format("and or"), _ISC.format("and")],
    "header MPL": ["subject to the terms of the mozilla public license v 2 0", "subject to the terms of the mozilla public license version 2 0"],
    "title MPL": ["mozilla public license version 2 0"],
}
ANYWHERE = frozenset(x for x in MORE if x.split(" ")[0] in ("header", "bsd", "body"))
_BODIES: list[tuple[str, tuple[str, ...]]] = [
    ("BSD-4-Clause", ("bsd", "bsd 2", "bsd 4", "bsd 3")),
    ("BSD-3-Clause", ("bsd", "bsd 2", "bsd 3")),
    ("BSD-3-Clause", ("bsd", "bsd 3")),
    ("BSD-2-Clause", ("bsd", "bsd 2")),
    ("BSD", ("bsd",)),  # the conditions are not there or not known
    ("ISC", ("body ISC",)),
    ("MIT", ("mih", "mip", "foc")),
    ("MIT", ("mip", "foc")),
]
_HEADS = {"GPL": ("gpw", "gpl", "gpr", "gpf", "gpt", "header GPL"), "LGPL": ("lgp", "title LGPL", "header LGPL"), "AGPL": ("agp", "title AGPL", "header AGPL")}
_VERSIONS = [(k, i, f"{k[0]}-{v}") for k in ((x,) for x in _GNU) for v, i in (("3.0", "ve3"), ("2.0", "ve2"), ("2.1", "v21")) if f"{k[0]}-{v}" in _GNU_NAMES]
#: All sentences as (identifier, text); of equal texts the first counts. All rules, first come, first served.
ALL_SENTENCES: tuple[tuple[str, str], ...] = tuple((i, t) for t, i in {t: i for i, t in reversed([*SENTENCES.items(), *((i, t) for i, texts in MORE.items() for t in texts)])}.items())
ALL_RULES: list[tuple[str, tuple[str, ...]]] = [
    *[(k, ("spa", f"spdx {k}")) for k in _SPDX],
    *[(f"{name}-or-later", (head, i, later)) for (k,), i, name in _VERSIONS for head in _HEADS[k] for later in ("lat", "lao")],
    *[(f"{k}-or-later", (f"{how} {k}", later)) for k in _GNU_NAMES for how in ("under", "header") for later in ("lat", "lao")],
    *[(name, (head, i)) for (k,), i, name in _VERSIONS for head in _HEADS[k]],
    *[(k, (f"header {k}",)) for k in _GNU_NAMES],
    *[(k, (f"under {k}",)) for k in NAMES],
    ("Apache-2.0", ("title Apache", "v20")),
    ("MPL-2.0", ("header MPL",)),
    ("MPL-2.0", ("title MPL",)),
    *[(name, ("arr", *rule)) for name, rule in _BODIES],  # the copyright line above a text
    *_BODIES,
    *RULES,
]


@lru_cache(maxsize=8)
def _known(sentences: tuple[tuple[str, str], ...] | None) -> tuple[dict[int, dict[int, dict[bytes, str]]], np.ndarray, np.ndarray]:
    """Sentences by their first word's hash, then by length, longest first, then by the hashes of all their words; the first words, and which of them begin one of ANYWHERE."""
    sentences = ALL_SENTENCES if sentences is None else sentences
    by: dict[int, dict[int, dict[bytes, str]]] = {}
    grid = Grid(pa.array([text for _, text in sentences]))
    for (ident, _), a, z in zip(sentences, grid.row[:-1], grid.row[1:]):
        by.setdefault(int(grid.hash[a]), {}).setdefault(int(z - a), {})[grid.hash[a:z].tobytes()] = ident
    firsts = np.sort(np.array([*by], U64))
    free = {h for h, x in by.items() if any(i in ANYWHERE for texts in x.values() for i in texts.values())}
    return {h: dict(sorted(x.items(), reverse=True)) for h, x in by.items()}, firsts, np.array([int(h) in free for h in firsts], bool)


def _borders(grid: Grid) -> np.ndarray:
    """Whether a mark, a dash that stands by itself, or the row's begin, stands before each word; one more entry for the end."""
    marks = np.isin(grid.data, np.frombuffer(MARKS.encode(), np.uint8))
    if len(marks) > 2:
        marks[1:-1] |= (grid.data[1:-1] == ord("-")) & (grid.data[:-2] == 32) & (grid.data[2:] == 32)
    seen = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    out = np.ones(len(grid.start) + 1, bool)
    if len(grid.start):
        out[1:-1] = seen[grid.start[1:]] > seen[grid.end[:-1]]
        out[grid.row[:-1][grid.row[:-1] < len(grid.start)]] = True
        dash = np.isin(grid.hash, Grid(pa.array(["\u2013 \u2014"])).hash)  # these count as words
        out[:-1] |= dash
        out[1:] |= dash
    return out


def sentences_of(grid: Grid, sentences: tuple[tuple[str, str], ...] | None = None) -> dict[int, list[tuple[int, int, str]]]:
    """By row: (first word, end word, identifier) of the outermost known sentences, in order."""
    by, firsts, free = _known(sentences)
    if not len(grid.hash):
        return {}
    border = _borders(grid)
    i = np.minimum(np.searchsorted(firsts, grid.hash), len(firsts) - 1)
    at = np.flatnonzero((border[:-1] | free[i]) & (firsts[i] == grid.hash))
    rows = np.searchsorted(grid.row, at, "right") - 1
    out: dict[int, list] = {}
    for w, r in zip(at.tolist(), rows.tolist()):
        for n, texts in by[int(grid.hash[w])].items():
            if w + n > grid.row[r + 1]:
                continue
            ident = texts.get(grid.hash[w : w + n].tobytes())
            if ident is not None and (border[w] and border[w + n] or ident in ANYWHERE):
                found = out.setdefault(r, [])
                base = int(grid.row[r])
                if not found or w + n - base > found[-1][1]:  # longest first, so a later one inside is nested
                    found.append((w - base, w + n - base, ident))
                break
    return out


def licences(found: list[tuple[int, int, str]], rules: list[tuple[str, tuple[str, ...]]]) -> list[tuple[str, int, int]]:
    """(licence, first word, end word) of the rules that a sequence of sentences matches."""
    ids = [x[2] for x in found]
    out, i = [], 0
    while i < len(ids):
        for name, rule in rules:
            if tuple(ids[i : i + len(rule)]) == rule:
                out.append((name, found[i][0], found[i + len(rule) - 1][1]))
                i += len(rule)
                break
        else:
            i += 1
    return out


def scan(docs: DataFrame, sentences: tuple[tuple[str, str], ...] | None = None, rules: list[tuple[str, tuple[str, ...]]] = ALL_RULES) -> DataFrame:
    """(doc_id, licence, start_word, end_word) of every licence found; end_word is exclusive. Without sentences: ALL_SENTENCES."""

    def run(batches):
        for batch in batches:
            for b in blocks(batch, "text"):
                grid = Grid(b.column("text"))
                ids = b.column("doc_id")
                out = [(ids[r].as_py(), *x) for r, found in sentences_of(grid, sentences).items() for x in licences(found, rules)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.string(), pa.int32(), pa.int32()))], ["doc_id", "licence", "start_word", "end_word"])

    read = texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    return read.mapInArrow(run, "doc_id long, licence string, start_word int, end_word int").distinct()


def _sql() -> str:
    known = ", ".join(f"('{i}', '{s}', {len(s.split())})" for i, s in SENTENCES.items())
    pattern = "|".join("".join(f"{i};" for i in ids) for _, ids in RULES)
    names = dict.fromkeys(("".join(f"{i};" for i in ids), name) for name, ids in RULES)
    named = ", ".join(f"('{k}', '{v}')" for k, v in names)
    marks = re.escape(MARKS.replace("\n", "")) + "\\n"
    return f"""
WITH known(id, s, n) AS (VALUES {known}),
rules(ids, licence) AS (VALUES {named}),
docs AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
texts AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS k, doc_id, text FROM docs),
pieces AS (
  SELECT k, unnest(p) AS piece, generate_subscripts(p, 1) AS i
  FROM (SELECT k, regexp_extract_all(lower(text), '(?:[a-z0-9]|[^\\x00-\\x7F])+|[{marks}]') AS p FROM texts)
), marked AS (
  SELECT k, i, piece, regexp_matches(piece, '^(?:[a-z0-9]|[^\\x00-\\x7F])') AS is_word,
         coalesce(NOT regexp_matches(lag(piece) OVER w, '^(?:[a-z0-9]|[^\\x00-\\x7F])'), true) AS begins,
         coalesce(NOT regexp_matches(lead(piece) OVER w, '^(?:[a-z0-9]|[^\\x00-\\x7F])'), true) AS ends
  FROM pieces WINDOW w AS (PARTITION BY k ORDER BY i)
), lists AS (
  SELECT k, list(piece ORDER BY i) AS w, list(begins ORDER BY i) AS b, list(ends ORDER BY i) AS e FROM marked WHERE is_word GROUP BY k
), starts AS (
  SELECT k, w, e, unnest(range(1, len(w) + 1)) AS p, unnest(b) AS begins FROM lists
), found AS (
  SELECT k, p - 1 AS a, p - 1 + n AS z, id FROM starts JOIN known ON w[p] = split_part(s, ' ', 1) AND array_to_string(w[p:p + n - 1], ' ') = s
  WHERE begins AND p + n - 1 <= len(w) AND e[p + n - 1]
), outer_ones AS (
  SELECT k, a, z, id FROM found f
  WHERE NOT EXISTS (SELECT 1 FROM found o WHERE o.k = f.k AND o.a <= f.a AND o.z >= f.z AND (o.a < f.a OR o.z > f.z))
), sequences AS (
  SELECT k, string_agg(id || ';', '' ORDER BY a) AS ids, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z FROM outer_ones GROUP BY k
), matched AS (
  SELECT k, a, z, unnest(m) AS hit, generate_subscripts(m, 1) AS i FROM (SELECT k, a, z, regexp_extract_all(ids, '{pattern}|[a-z0-9]+;') AS m FROM sequences)
), placed AS (
  SELECT k, hit, a, z, CAST(sum(length(hit) // 4) OVER (PARTITION BY k ORDER BY i) AS BIGINT) AS last, length(hit) // 4 AS n FROM matched
)
SELECT DISTINCT doc_id, licence, CAST(a[last - n + 1] AS INTEGER) AS start_word, CAST(z[last] AS INTEGER) AS end_word
FROM placed JOIN rules ON hit = ids JOIN texts USING (k)
"""


SQL = _sql()
