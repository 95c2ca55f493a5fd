"""Whether two pieces may stand side by side, told without merging them; decoding many texts at once."""

import random

import numpy as np
import pytest

from opsboard.llm import pieces


@pytest.fixture(scope="module")
def lattice():
    with open(pieces.MODEL, "rb") as file:
        return pieces.Lattice(file.read())


def test_fits_is_what_merging_gives(lattice):
    chance, names = random.Random(1), sorted(lattice.ids)
    short = [p for p in names if len(p) <= 3]
    letters = [p for p in ["a", "aa", "aaa", "aaaa", "▁", "▁▁", "▁▁▁▁", "e", "ee", "é", "一", "🤖", "ß"] if len(p) == 1 or p in lattice.ids]
    seen = {True: 0, False: 0}
    for pool in (names, short, letters):
        for _ in range(6000):
            a, b = chance.choice(pool), chance.choice(pool)
            want = lattice.merged(a + b) == [a, b]
            assert lattice.fits(a, b) == want, (a, b)
            seen[want] += 1
    # neighbours that do occur, and the same ones shifted by a character
    for word in chance.sample(names, 1500):
        parts = lattice.merged(word + chance.choice(names).lstrip("▁"))
        for a, b in zip(parts, parts[1:]):
            assert lattice.fits(a, b)
            if len(b) > 1 and a + b[0] in lattice.ids and (len(b) == 2 or b[1:] in lattice.ids):
                assert lattice.fits(a + b[0], b[1:]) == (lattice.merged(a + b) == [a + b[0], b[1:]])
    assert min(seen.values()) > 1000


def test_paths_are_those_of_merging(lattice):
    chance = random.Random(2)
    words: set[str] = set()
    parts = ["er", "ing", "tion", "a", "é", "sch", "###", "x", "1", "▁", "🤖", "the", "ré"]
    for _ in range(3000):
        word = "▁" + "".join(chance.choice(parts) for _ in range(chance.randrange(1, 9)))
        words.add(word)
        assert lattice.merged(word) == lattice.path(word, 0, len(word), None)
    lattice.clear()
    lattice.learn([" ".join(words).replace(" ", "")])
    for word in words & lattice.keys():
        assert lattice[word] == np.array(lattice.numbers(lattice.merged(word)), np.int32).tobytes()
    assert len(lattice) > 1500


def test_decoding_together_is_decoding_apart(lattice):
    chance = random.Random(3)
    rows = [[chance.randrange(len(lattice.surface)) for _ in range(chance.randrange(0, 30))] for _ in range(200)]
    plain = [b"".join(lattice.surface[i] for i in r).decode("utf-8", "replace").replace("▁", " ").removeprefix(" ") for r in rows]
    flat = np.array([i for r in rows for i in r], np.int64)
    assert lattice.decode_all(flat, [len(r) for r in rows]) == plain == [lattice.decode(r) for r in rows]
    assert lattice.decode_all(np.zeros(0, np.int64), []) == [] and lattice.decode([]) == ""


def test_words_of_many_lengths_are_solved_together(lattice, monkeypatch):
    chance, names = random.Random(4), sorted(lattice.ids)
    words = list({"▁" + "".join(chance.choice(names) for _ in range(chance.randrange(1, 6))).replace("▁", "")[:31] for _ in range(1500)})
    words += ["x", "▁", "ab\0", "\0", "▁é\0\0"]
    words.sort(key=len, reverse=True)
    assert len({len(w) for w in words}) > 20
    for word, ids in zip(words, lattice._solved(words), strict=True):
        assert ids == np.array(lattice.numbers(lattice.path(word, 0, len(word), None)), np.int32).tobytes()


def test_caches_are_bounded_and_left_small(lattice, monkeypatch):
    monkeypatch.setattr(pieces, "MOST_CACHED", 50)
    monkeypatch.setattr(pieces, "MOST_KEPT", 20)
    lattice.clear()
    texts = [" ".join(f"w{k}x{n}" for n in range(30)) + " the" for k in range(5)]
    plain = [lattice.numbers([a for w in pieces._WORD.findall(pieces.normal(t)) for a in lattice.path(w, 0, len(w), None)]) for t in texts]
    for text, want in zip(texts, plain, strict=True):
        assert [x.tolist() for x in lattice.encode_all([text])] == [want]
        assert len(lattice) <= 50 and "▁the" in lattice
    lattice.rest()
    assert not len(lattice) and [x.tolist() for x in lattice.encode_all(texts)] == plain
