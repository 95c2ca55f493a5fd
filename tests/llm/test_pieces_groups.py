"""Words that end where no piece goes on: solved once whatever stands beside them, and pairs told many at once."""

import random
import re

import numpy as np
import pytest

from opsboard.llm import pieces


@pytest.fixture
def lattice():
    with open(pieces.MODEL, "rb") as file:
        return pieces.Lattice(file.read())


def test_a_word_is_solved_once_whatever_punctuation_follows(lattice, monkeypatch):
    solved, plain = [], lattice._solved
    monkeypatch.setattr(lattice, "_solved", lambda words: solved.extend(words) or plain(words))
    names = [f"{a}{b}{c}tion" for a in ("ba", "ko", "mir") for b in ("lu", "sen") for c in ("te", "ga", "or")]
    text = " ".join(name + mark for name in names for mark in ("", ",", ".", "!!", ".\n", "):", "...x", "привет"))
    ids = next(lattice.encode_all([text]))
    assert ids.tolist() == lattice.numbers(lattice.merged(pieces.normal(text)))
    assert len(solved) == len(set(solved)) < 2 * len(names)


def test_no_piece_goes_across_words(lattice):
    chance, names = random.Random(5), sorted(lattice.ids)
    for piece in names:
        assert lattice.word.fullmatch(piece)
    letters = [c for c in "".join(names) if c != pieces.SPACE] + list("0123456789一取获🤖\n-]^[\\") * 50
    for _ in range(300):
        text = pieces.normal("".join(chance.choice([*chance.choices(letters, k=8), " "]) for _ in range(40)))
        words = lattice.word.findall(text)
        assert "".join(words) == text
        assert lattice.words(text).tolist() == lattice.numbers(lattice.merged(text))


def test_pattern_of_odd_pieces():
    word = re.compile(pieces.Lattice._pattern(["a]", "]^", "-x", "▁", "q", "▁▁"]))
    assert word.findall("▁▁a]^-x▁9q\n\\▁") == ["▁▁a]^", "-x", "▁9q", "\n", "\\", "▁"]
    assert re.compile(pieces.Lattice._pattern(["a", "▁"])).findall("▁ab\n▁▁") == ["▁ab", "\n", "▁▁"]
    many = [chr(0x4E00 + 2 * k) + chr(0x4E01 + 2 * k) for k in range(40)]  # more groups than are told apart
    text = "".join(many)
    found = re.compile(pieces.Lattice._pattern(many)).findall(text)
    assert "".join(found) == text and all(any(m in w for w in found) for m in many)


def test_pairs_told_at_once_are_those_told_one_by_one(lattice):
    chance, names = random.Random(6), sorted(lattice.ids)
    short = [p for p in names if len(p) <= 3]
    pairs = [(chance.choice(pool), chance.choice(pool)) for pool in (names, short) for _ in range(5000)]
    for word in chance.sample(names, 1000):
        parts = lattice.merged(word + chance.choice(names).lstrip(pieces.SPACE))
        pairs += zip(parts, parts[1:])
    want = [lattice.fits(a, b) for a, b in pairs]
    first, second = (np.array([lattice.ids.get(x, -1) for x in side]) for side in zip(*pairs))
    known = np.flatnonzero((first >= 0) & (second >= 0))
    assert lattice.fits_all(first[known], second[known]).tolist() == [want[k] for k in known]
    assert lattice._together(first[known], second[known]).tolist() == [want[k] for k in known]
    assert {True, False} == set(want) and not lattice.fits_all(first[:0], second[:0]).size


def test_ids_of_hashes(lattice):
    names = sorted(lattice.ids)
    other = [a + "\0" for a in names[:500]]
    found = lattice._id_of(np.array([lattice._hash(p) for p in names + other], np.uint64))
    assert found.tolist() == [lattice.ids[p] for p in names] + [-1] * len(other)
    assert lattice.most_in_slot < 8


def test_chunks_without_or_with_few_words(lattice):
    chance = random.Random(7)
    for text in ["a" * 300, "x y" * 60, " " * 200, "ab" * 40 + " " * 50 + "cd" * 40, "one two " + "z" * 90, " ".join("abc" * chance.randrange(1, 9) for _ in range(40))]:
        whole, size, rows = pieces.normal(text), 50, []
        for cut in range(0, len(whole), size):
            stop, offset = min(len(whole), cut + size), max(0, cut - lattice.longest)
            rows.append((whole[offset : min(len(whole), stop + lattice.longest)], cut - offset, stop - offset, cut == 0, stop == len(whole)))
        states = pieces.back([lattice.transfer(*r) for r in rows], 0, None)
        jobs = [(*r, *s) for r, s in zip(rows, states, strict=True)]
        got = np.concatenate(lattice.traced_all(jobs)).tolist()
        assert got == lattice.numbers(lattice.merged(whole)) == np.concatenate([lattice.traced(*j) for j in jobs]).tolist()
