"""Corpus jobs that once covered only a part of their input."""

import textwrap

import numpy as np
import pyarrow as pa
import pytest

from noteloom.llm import license_scan, pii, toxicity

HIDDEN = {
    "idiot": ["i.d.1.0.t", "1.d.1.o.7", "i d 1 0 t", "i  d  i  o  t", "i..d..i..o..t", "i--d--1--0--+", "i. d. i. o. t.", "i d i o t!", "(i d i o t", "idio+", "id!o+", "|di0t", "IDIO+", "i - d - i - o - t", "(i.d.i.o.t)"],
    "twit": ["twi+", "tw!+", "tw|t", "+w!+", "t.w.!.+", "t  w  !  t"],
    "scoundrel": ["$coundr€l", "scoundre£", "s.c.0.u.n.d.r.€.£", "scoundre|"],
    "nitwit": ["n1+w!t", "nitw1+", "n_i_t_w_i_t"],
    "größe": ["größßße", "gröööße", "GRÖÖÖßE", "größ€"],
}


@pytest.mark.parametrize(("word", "hidden"), [(w, h) for w, forms in HIDDEN.items() for h in forms])
def test_the_gate_lets_the_channel_through(word, hidden):
    language = toxicity.Language(*toxicity.grams(("the token then toast tested best stone notes for and with from that\n" * 3 + "idiot twit scoundrel nitwit größe\n" * 5)))
    column = pa.array(["", f"best notes, {hidden} with the token", "then"], pa.large_string())
    found = toxicity.suspects(column)
    assert {r for r, _ in found} == {1}
    assert word in {toxicity.restore(t, language) for _, t in found}


def test_the_gate_flags_what_has_several_paths():
    rng = np.random.default_rng(3)
    signs = [*"abit", *toxicity.LEET, *".-_*", "ä", ","]
    for _ in range(4000):
        token = "".join(rng.choice(signs, rng.integers(3, 8)))
        several = any(len(x) > 1 for x in toxicity.lattice(token))
        letters = any(c.isalpha() for c in token)
        if several and letters:
            assert toxicity.suspects(pa.array([token], pa.large_string())), token
    assert not toxicity.suspects(pa.array(["plain words, in a row. 100 2015 3.14"], pa.large_string()))


_DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.'
_BSD2 = """Copyright (c) 2020, Jo Doe. All rights reserved.
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
_FULL = {
    "BSD-2-Clause": [_BSD2 + _DISCLAIMER],
    "BSD-3-Clause": [_BSD2 + f"3. Neither the name of {who} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _DISCLAIMER for who in ("the copyright holder", "Acme")],
    "ISC": [f"Permission to use, copy, modify, {x} distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies." for x in ("and/or", "and")],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Mozilla Public License Version 2.0"],
    "Apache-2.0": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "Apache License\nVersion 2.0, January 2004"],
    "GPL-3.0-or-later": [_GNU.format("GNU General Public License", ",", 3)],
    "GPL-2.0-or-later": [_GNU.format("GNU General Public License", ";", 2)],
    "GPL-2.0": ["under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."],
    "LGPL-2.1-or-later": [_GNU.format("GNU Lesser General Public License", ";", "2.1")],
    "LGPL-3.0-or-later": [_GNU.format("GNU Lesser General Public License", ",", 3)],
    "AGPL-3.0-or-later": [_GNU.format("GNU Affero General Public License", ",", 3), "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "MIT": ["This project is licensed under the MIT License - see the LICENSE file.\nMore text", "This project is licensed under the MIT License \u2014 see LICENSE", "This software is released under the terms of the MIT license."],
    "GPL-3.0": ["This project is licensed under the GNU GPL v3.", "This software is licensed under the GNU General Public License v3.0."],
    "LGPL-2.1-only": ["SPDX-License-Identifier: LGPL-2.1-only"],
}


@pytest.mark.parametrize("width", [None, 40, 72])
@pytest.mark.parametrize(("name", "text"), [(n, t) for n, texts in _FULL.items() for t in texts])
def test_licence_texts(name, text, width):
    if width:
        text = "/*\n" + "\n".join(f" * {x}" for line in text.split("\n") for x in textwrap.wrap(line, width)) + "\n */"
    grid = license_scan.Grid(pa.array([text]))
    found = license_scan.sentences_of(grid).get(0, [])
    assert {x[0] for x in license_scan.licences(found, license_scan.ALL_RULES)} == {name}


def test_what_is_no_licence_text():
    for text in ("not released under the mit license", "permission to use, copy and modify", "mit, isc, version 3", "this is subject to the terms of the contract"):
        found = license_scan.sentences_of(license_scan.Grid(pa.array([text]))).get(0, [])
        assert not license_scan.licences(found, license_scan.ALL_RULES)


_JWT = ".".join("eyJ0" + "aB3_-x" * n for n in (6, 80, 60))


@pytest.mark.parametrize(
    ("text", "found"),
    [
        (f"token={_JWT} end", {(_JWT, "SECRET")}),
        (f"password: '{'a1' * 5000}'", {("a1" * 5000, "SECRET")}),
        (f"Authorization: Bearer {_JWT}\nnext", {(_JWT, "SECRET")}),
        ("authorization: bearer abcd1234efgh", {("abcd1234efgh", "SECRET")}),
        ("bearer: abcd1234efgh", {("abcd1234efgh", "SECRET")}),
        ("auth: Bearer abcd1234efgh", {("abcd1234efgh", "SECRET")}),
        ("the bearer of 12345678x, forbearer abcd1234efgh", set()),
        (f"see ftp://joe:pw1@host.example.com/{'x/' * 3000}end now", {(f"ftp://joe:pw1@host.example.com/{'x/' * 3000}end", "URL")}),
        ("http://a.example.com/http://joe:pw1@host.example.com/x", {("http://joe:pw1@host.example.com/x", "URL")}),
        ("token=" * 100_000, set()),
        ("token=" * 100_000 + "1", {("token=" * 99_999 + "1", "SECRET")}),
        ("a://" * 100_000, set()),
    ],
)
def test_long_values_are_found_whole(text, found):
    assert {(text[a:b], k) for a, b, k in pii.find(text)} == found
    assert not any(x in pii.redacted(text) for x, _ in found)
