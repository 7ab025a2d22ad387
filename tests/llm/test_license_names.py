"""Licenses that share most of their notice, whole notices, and candidates against aligning every template everywhere."""

import random

import pytest

from examloom.llm import licenses
from examloom.llm.decontam import tokens
from examloom.llm.ngramjoin import Hashes
from examloom.llm.templates import TEMPLATES

K, WINDOW, LEAST = 3, 2, 0.8


@pytest.fixture(scope="module")
def index():
    return licenses.Index(TEMPLATES, K, WINDOW)


def found(index, text):
    words = tokens(text.encode())
    return index.matches(words, licenses.hashes_of(words, K, Hashes()), LEAST)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Licensed under CC BY-SA 4.0.", ["cc-by-sa-4.0"]),
        ("Licensed under CC BY 4.0.", ["cc-by-4.0"]),
        ("Licensed under CC BY-NC 4.0.", ["cc-by-nc-4.0"]),
        ("Licensed under CC BY-ND 4.0.", []),
        ("This work is licensed under the GNU General Public License, version 2.", ["gpl-2.0"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["gpl-3.0"]),
        ("This work is licensed under the GNU Affero General Public License, version 3.", []),
        ("This project is licensed under the terms of the ISC license.", []),
        ("This project is licensed under the terms of the MIT license.", ["mit"]),
        ("Licensed under the MPL License, Version 2.0.", []),
        ("Licensed under the Apache License, Version 1.1.", []),
        ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", []),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["cc-by-sa-4.0"]),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", ["cc-by-4.0"]),
    ],
)
def test_own_license_or_none(index, text, expected):
    assert [m[0] for m in found(index, f"some words before it {text} and some more behind")] == expected


def test_whole_notices_name_themselves(index):
    for name, notice, _ in TEMPLATES:
        got = found(index, f"alpha beta gamma {notice} delta epsilon zeta")
        n = len(tokens(notice.encode()))
        assert [m[:4] for m in got] == [(name, 3, 3 + n, n)], name
        assert got[0][4] == 1.0


def test_candidates_against_every_place(index):
    rng = random.Random(7)
    vocabulary = sorted({w for ws in index.words for w in ws})
    for _ in range(12):
        words = [rng.choice(vocabulary) for _ in range(30)]
        for n in rng.sample(range(len(TEMPLATES)), 2):
            notice = list(index.words[n])
            for _ in range(rng.randint(0, len(notice) // 12)):
                notice[rng.randrange(len(notice))] = b"edited"
            words += notice + [rng.choice(vocabulary) for _ in range(20)]
        every = []
        for n, template in enumerate(index.words):
            band = max(2, len(template) // 8)
            for d in range(-len(template), len(words), band):
                matched, start, stop = licenses.align(words, template, d - band, d + band)
                if matched >= LEAST * len(template) and licenses.holds(words[start:stop], index.naming[n]):
                    every.append((index.names[n], start, stop, matched))
        got = index.matches(words, licenses.hashes_of(words, K, Hashes()), LEAST)
        # no notice is overlooked: each found by brute force meets a kept match of at least as many words
        for _, start, stop, matched in every:
            assert any(m[1] < stop and start < m[2] and m[3] >= matched for m in got)
        assert all(any(m[0] == e[0] and m[1] < e[2] and e[1] < m[2] for e in every) for m in got)
