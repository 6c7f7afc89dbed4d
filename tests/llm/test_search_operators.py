"""Suffix dedup, line dedup, decontamination and licences against brute force and their SQL; the stated cases."""

import re
from collections import defaultdict

import brute
import oracle
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from noteloom.llm import decontaminate, license_scan, line_dedup, packing, pii, queries, suffix_dedup

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
ODD = [(1, None), (2, ""), (3, "   \n "), (None, "no id but words here in a row"), (4, LONG), (5, LONG), (5, LONG), (6, "ÉTÉ straße ́ ok"), (7, "a"), (8, "one two three four five six\none two three four five six")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t in ODD], "doc_id long, text string, hash string")


@pytest.mark.parametrize("name", [*queries.SQL])
def test_sql(spark, name):
    assert oracle.of_spark(queries.QUERIES[name](spark, oracle.SF)) == oracle.of_sql(queries.SQL[name])


def _windows(rows, n):
    at = defaultdict(set)
    for doc, text in rows:
        if doc is not None and text:
            w = re.findall(r"[^\x00-\x20]+", text)
            for p in range(len(w) - n + 1):
                at[tuple(w[p : p + n])].add((doc, p))
    return {k: sorted(v) for k, v in at.items() if len(v) > 1}


@pytest.mark.parametrize("hot", [2, 4, 10_000])
def test_suffix_spans_cover_exactly_the_repeated_windows(spark, odd, hot):
    text = [(i, " ".join("ab"[(i * j) % 2] + str(j % (7 + i)) for j in range(120))) for i in range(9)] + ODD[:4] + [(30, "q r s t u v w"), (31, "zz q r s t u v w yy")]
    df = spark.createDataFrame([(i, t, 0) for i, t in text], "doc_id long, text string, first int")
    got = suffix_dedup.repeated_passages(df, threshold=6, digit=3, hot=hot).collect()
    places = {(r.doc_id, p) for r in got for p in range(r.start_token, r.end_token - 6 + 1)}
    windows = _windows(text, 6)
    assert places == {x for v in windows.values() for x in v}
    firsts = {(r.doc_id, p) for r in got if r.is_first for p in range(r.start_token, r.end_token - 6 + 1)}
    assert firsts == {v[0] for v in windows.values()}
    assert {r.doc_id for r in suffix_dedup.repeated_passages(odd).collect()} == {4, 5}


_PASSAGE = " ".join(f"Passage {i} says, in so many words, number {i}." for i in range(12))
_STOCK = "All rights reserved. Click here to read more."


def _removed(spark, rows):
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, unit int")
    text = {i: t for i, t in rows}
    found = line_dedup.repeated_units(df).collect()
    return found, {d: line_dedup.remove(text[d], [(r.start, r.end) for r in found if r.doc_id == d]) for d in {r.doc_id for r in found}}


def test_line_dedup_finds_passages_within_lines_and_over_line_ends(spark):
    rows = [
        (1, f"First comes this, then that\n{_STOCK}\n{_PASSAGE} Behind it goes on."),
        (2, f"In the middle of a long line it stands, and {_PASSAGE} with more behind. {_STOCK}"),
        (3, "Other lines.\n" + _PASSAGE.replace(". ", ".\n").replace(" in ", "  in\t").upper() + f"\nEnd.\n{_STOCK}"),
        (4, f"Only stock sentences are here.\n{_STOCK}\nThey stay where they are, however often they come."),
        (5, _STOCK + " " + " ".join(f"own{i}" for i in range(60))),
        (6, "ÉTÉ İx " + _PASSAGE),
    ]
    found, left = _removed(spark, rows)
    assert {r.doc_id for r in found} == {2, 3, 6} and {r.kept_doc_id for r in found} == {1}
    assert all("number 5" not in t.lower() for t in left.values())
    assert left[2].startswith("In the middle of a long line it stands, and") and left[2].endswith(f"with more behind. {_STOCK}")
    assert left[3].startswith("Other lines.") and left[3].endswith(f"End.\n{_STOCK}") and left[6].startswith("ÉTÉ İx") and max(len(left[3]), len(left[6])) < 110


def test_line_dedup_equals_brute_force(spark):
    import random

    rng = random.Random(4)
    said = [" ".join(rng.choice(["ab", "cd,", "ef.", "Gh", "é!", 'i."', "j"]) for _ in range(rng.randint(1, 9))) for _ in range(12)]
    rows = [(i, rng.choice(" \n").join(rng.choice(said) for _ in range(rng.randint(0, 14)))) for i in range(60)]
    at = defaultdict(set)
    for doc, text in rows:
        ends, start, bounds = [], 0, []
        words = [(m.start(), m.end()) for m in re.finditer(r"[^\x00-\x20]+", text)]
        for k, (a, b) in enumerate(words):
            if k + 1 == len(words) or "\n" in text[b : words[k + 1][0]] or re.search(r"[.!?,;:|][\"')\]]?$", text[a:b]):
                bounds.append((start, k + 1))
                start = k + 1
        for u, (a, _) in enumerate(bounds):
            z = next((z for _, z in bounds if z >= a + 10), None)
            if z:
                at[" ".join(text[x:y] for x, y in words[a:z]).lower()].add((doc, u, words[a][0], words[z - 1][1]))
    want = {(*p, *min(v)[:2]) for v in at.values() for p in v if p != min(v)}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in line_dedup.repeated_units(df, run_words=10).collect()} == want and len(want) > 50


def test_line_dedup_cases(spark, odd):
    assert {(r.doc_id, r.kept_doc_id) for r in line_dedup.repeated_units(odd).collect()} == {(5, 4)}
    assert line_dedup.repeated_units(odd.limit(0)).count() == 0
    assert line_dedup.remove("a\nb\nc", [(2, 3)]) == "a\nc"
    assert line_dedup.remove("one two three four", [(4, 7), (8, 13)]) == "one four"
    assert line_dedup.remove("a", [(0, 1)]) == ""


def test_decontamination_cases(spark, odd):
    items = spark.createDataFrame([(1, "W5X5 w6x6"), (1, "W5X5 w6x6"), (2, None), (3, ""), (4, "a"), (5, "été, STRASSE"), (6, "three four, five. six one"), (None, "a")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_windows) for r in decontaminate.occurrences(odd, items).collect()}
    assert got == {(4, 1, 1), (5, 1, 1), (7, 4, 1), (8, 6, 1)}
    kept = [r.doc_id for r in decontaminate.drop_contaminated(odd, items).collect()]
    assert sorted(kept, key=lambda x: (x is None, x)) == [1, 2, 3, 6, None]
    assert decontaminate.occurrences(odd, items.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab ", max_size=30), max_size=4), st.lists(st.text("ab ", min_size=1, max_size=12), min_size=1, max_size=5))
def test_wu_manber_finds_what_a_plain_search_finds(texts, items):
    import numpy as np
    import pyarrow as pa

    strings, owners = decontaminate.strings(list(enumerate(items)), 3)
    if not strings:
        return
    text, _ = decontaminate.normal(pa.array(texts, pa.string()))
    at, which = decontaminate.Searcher(strings).find(text)
    whole = bytes(text)
    plain = {(p, k) for k, s in enumerate(strings) for p in range(len(whole)) if whole.startswith(s, p)}
    assert set(zip(np.asarray(at).tolist(), np.asarray(which).tolist())) == plain


def test_licences(spark, odd):
    texts = [
        (1, "x\n# Licensed under the Apache License,\n# Version 2.0 (the thing)"),
        (2, "LICENSED UNDER THE APACHE LICENSE. Version 3."),
        (3, "Released under the MIT License. Licensed under CC BY-NC 4.0."),
        (4, "not released under the mit license"),
        (5, "Licensed under the GNU General Public License, version 3, or any later version."),
        (6, "SPDX-License-Identifier: MIT"),
        (7, None),
    ]
    got = {(r.doc_id, r.licence) for r in license_scan.scan(spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, licence int")).collect()}
    assert got == {(1, "Apache-2.0"), (3, "MIT"), (3, "CC-BY-NC-4.0"), (5, "GPL-3.0-or-later"), (6, "MIT")}
    assert license_scan.scan(odd).count() == 0 and license_scan.scan(odd.limit(0)).count() == 0


# PII

_PLAIN = {
    "EMAIL": r"(?<![\w.%+'-])[^\W_][\w.%+-]*@(?:[a-z0-9-]+\.)+[a-z]{2,}",
    "IP": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w])(?!\.\d)",
    "PHONE": r"\+1 \(\d{3}\) \d{3}-\d{4}",
    "CARD": r"(?<![\w.+-])\d{16}(?!\w)",
    "KEY": r"(?<!\w)AKIA[A-Z0-9]{16}(?!\w)",
    "SECRET": r'(?:token = "|password=)([0-9a-f]{18,40})',
}


def _regex_findings(text):
    """What plain regular expressions see of the kinds that the test documents hold."""
    out = set()
    for kind, rx in _PLAIN.items():
        for m in re.finditer(rx, text):
            body = m.group(m.lastindex or 0)
            if kind == "IP" and any(int(x) > 255 or x != "0" and x[0] == "0" for x in body.split(".")) or kind == "CARD" and not pii.luhn(body):
                continue
            out.add((*m.span(m.lastindex or 0), kind))
    return out


def test_pii_equals_plain_expressions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = defaultdict(set)
    for r in pii.findings(docs).collect():
        got[r.doc_id].add((r.start, r.end, r.kind))
    rows = docs.select("doc_id", "text").collect()
    want = {r.doc_id: _regex_findings(r.text) for r in rows if r.text and _regex_findings(r.text)}
    assert dict(got) == want and sum(map(len, want.values())) > 50


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("write to ann.b+c@mail.example.org.", {("ann.b+c@mail.example.org", "EMAIL")}),
        ("a@b, @x, x@, x@y..com, x@-y.com", set()),
        ("version 1.2.3.4.5 and 256.1.1.1 and 01.2.3.4", set()),
        ("see 10.0.0.1.", {("10.0.0.1", "IP")}),
        ("::1 at 12:30:45 or 2001:db8::ff00:42:8329", {("2001:db8::ff00:42:8329", "IP")}),
        ("4111 1111 1111 1111 and 4111111111111112", {("4111 1111 1111 1111", "CARD")}),
        ("call (212) 555-0100 or 212-555-0101 or +49 30 1234567", {("(212) 555-0100", "PHONE"), ("212-555-0101", "PHONE"), ("+49 30 1234567", "PHONE")}),
        ("078-05-1120 not 000-12-3456", {("078-05-1120", "SSN")}),
        ("GB82WEST12345698765432 not GB82WEST12345698765433", {("GB82WEST12345698765432", "IBAN")}),
        ("ftp://joe:pw1@host.example.com/x http://plain.example.com/x", {("ftp://joe:pw1@host.example.com/x", "URL")}),
        ("the token = of a password: none; tokens 123456789", set()),
        ("api_key: 'abcd1234efgh5678'", {("abcd1234efgh5678", "SECRET")}),
        ("9" * 5000, set()),
        (":" * 3000 + "@" * 3000 + "1." * 3000, set()),
    ],
)
def test_pii_parsers(text, found):
    assert {(text[a:b], k) for a, b, k in pii.find(text)} == found


def test_pii_cases(spark, odd):
    df = spark.createDataFrame([(1, None, 0, "k"), (2, "", 0, "k"), (None, "a@b.com", 7, "k"), (3, "x a@b.com", 9, "k"), (3, "x a@b.com", 9, "k"), (4, "né +1 (521) 555-6210 " + LONG, 5, "k")], "doc_id long, text string, n_chars long, kind string")
    assert {tuple(r) for r in pii.findings(df).collect()} == {(None, 0, 7, "EMAIL"), (3, 2, 9, "EMAIL"), (4, 3, 20, "PHONE")}
    out = pii.redact(df).collect()
    assert [r.text for r in out][:5] == [None, "", "[EMAIL]", "x [EMAIL]", "x [EMAIL]"] and out[5].text.startswith("né [PHONE] w0x0") and out[5].n_chars == len(out[5].text)
    assert all(r.kind == "k" for r in out) and len(out) == 6
    assert pii.findings(odd).count() == 0 and pii.redact(odd.limit(0)).count() == 0


# Packing


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(1, 9), max_size=12))
def test_plan_uses_every_piece_once(counts):
    made = packing.plan(counts, 24)
    used = defaultdict(int)
    for times, parts in made:
        assert times > 0 and sum(parts) <= 24
        for p in parts:
            used[p] += times
    assert dict(used) == counts


def test_plan_fills_exactly_where_it_can():
    assert packing.plan({10: 3, 6: 3}, 16) == [(3, (10, 6))]
    assert packing.plan({10: 2, 4: 2, 2: 2}, 16) == [(2, (10, 4, 2))]
    assert packing.plan({10: 1, 3: 1, 2: 1, 1: 1}, 16) == [(1, (10, 3, 2, 1))]
    assert packing.plan({9: 1, 8: 1, 5: 2}, 16) == [(1, (9, 5)), (1, (8, 5))]


@pytest.mark.parametrize("tokenizer", [packing.VOCABULARY, None])
def test_packing_round_trip(spark, odd, tokenizer):
    docs = spark.read.parquet(f"{oracle.SF}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    got = packing.pack(docs.withColumn("piece", docs.doc_id), tokenizer=tokenizer).toPandas()
    ranks = packing.vocabulary(tokenizer)
    size = (lambda t: len(packing._encoder(ranks).encode_ordinary(t))) if ranks else lambda t: sum(-(-len(w.encode()) // 4) for w in re.findall(r"[^\x00-\x20]+", t))
    want = sorted(((-1 if r.doc_id is None else r.doc_id), size(r.text or "")) for r in docs.collect())
    got["doc_id"] = got.doc_id.fillna(-1)
    # pieces of each document are its tokens, no more and no less
    have = defaultdict(list)
    for r in got.itertuples():
        have[r.doc_id].append((r.start_token, r.n_tokens))
    need = defaultdict(list)
    for doc, n in want:
        need[doc] += [(a, min(2048, n - a)) for a in range(0, n, 2048)]
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in need.items() if v}
    for _, seq in got.sort_values("slot").groupby("seq_id"):
        assert list(seq.slot) == list(range(len(seq)))
        assert (seq.seq_start == seq.n_tokens.cumsum() - seq.n_tokens).all() and seq.n_tokens.sum() <= 2048
    assert sorted(got.seq_id.unique()) == list(range(got.seq_id.nunique()))
    assert got.seq_id.nunique() <= -(-got.n_tokens.sum() // 2048) + 2
    assert packing.pack(odd.limit(0)).count() == 0


_SIGNS = ["a", "bc", "X", "1", "23", ".", ",", "'s", "'ll", "!", "é", "日本", " ", "  ", "\n", "\n\n", "\t", " \n", "\r\n", "\u00a0", "\u3000", "\x01", "\x1f", "\x85"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(_SIGNS), max_size=14).map("".join)), max_size=6))
def test_word_by_word_counts_are_those_of_whole_texts(texts):
    import pyarrow as pa

    ranks = packing.vocabulary()
    if ranks is None:
        pytest.skip("no vocabulary here")
    encode = packing._encoder(ranks).encode_ordinary
    assert packing.Counter(ranks).count(pa.array(texts, pa.string())).tolist() == [len(encode(t)) if t else 0 for t in texts]


def test_a_missing_vocabulary_means_estimates(spark):
    df = spark.createDataFrame([(1, "abcdefghi jk")], "doc_id long, text string")
    assert packing.lengths(df, "/nowhere/at/all").first().n == 4 and packing.lengths(df, None).first().n == 4


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 6), max_size=9))
def test_plan_equals_brute_force(counts):
    made = packing.plan(counts, 20)
    exact, gaps = brute.plan(counts, 20)
    assert made[: len(exact)] == exact
    assert sorted(20 - sum(parts) for times, parts in made[len(exact) :] for _ in range(times)) == gaps


def test_brute_helpers():
    assert brute.groups([1, 2, 3, 4], [(1, 2), (2, 3)]) == {frozenset({1, 2, 3})}
