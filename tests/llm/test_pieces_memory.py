"""What the encoder holds at once: each word a single time, small arrays, one batch, no copies of pieces."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from opsboard.llm import pieces
from opsboard.llm.common import sliced


@pytest.fixture
def lattice():
    with open(pieces.MODEL, "rb") as file:
        return pieces.Lattice(file.read())


def peak_mb(lattice, texts):
    lattice.clear()
    tracemalloc.start()
    try:
        for _ in lattice.encode_all(texts):
            pass
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_words_that_come_often_are_held_once(lattice):
    chance, names = random.Random(1), ["alpha", "of", "beta", "the", "gamma,", "in", "a"]
    texts = [" ".join(chance.choice(names) for _ in range(2500)) for _ in range(150)]  # 375,000 words
    assert peak_mb(lattice, texts) < 20
    ids = list(lattice.encode_all([*texts[:3], None, "", texts[3]]))
    assert ids[3] is None and not len(ids[4])
    for text, got in zip(texts[:4], [*ids[:3], ids[5]], strict=True):
        assert got.tolist() == [k for w in pieces._WORD.findall(pieces.normal(text)) for k in lattice.numbers(lattice.merged(w))]


def test_new_words_are_solved_in_small_arrays(lattice):
    chance = random.Random(2)
    texts = [" ".join("".join(chance.choices("abcdefgh", k=7)) for _ in range(1000)) for _ in range(60)]
    assert peak_mb(lattice, texts) < 40
    got = next(lattice.encode_all([texts[7][:400]])).tolist()
    assert got == [k for w in pieces._WORD.findall(pieces.normal(texts[7][:400])) for k in lattice.numbers(lattice.merged(w))]


def test_a_batch_is_gone_before_the_next_one_is_read():
    held = []

    def batches():
        for k in range(4):
            held.append(pa.total_allocated_bytes())
            yield pa.RecordBatch.from_arrays([pa.array([str(k) * 1000] * 1000)], ["text"])

    seen = 0
    for part in sliced(batches(), 1 << 18):
        seen += part.num_rows
        del part
    assert seen == 4000 and max(held) - held[0] < 500_000


def test_remembered_pairs_hold_the_pieces_of_the_model(lattice):
    text = pieces.normal("internationalisation of words, 取 and ß again")
    lattice.walk(text, 0, len(text), None)
    known = [p for pair in lattice.pairs for p in pair if p in lattice.ids]
    assert known and all(p is lattice.piece[lattice.ids[p]] for p in known)


def test_pairs_in_few_slots_are_told_right(lattice):
    chance, n = random.Random(3), max(lattice.ids.values()) + 1
    ids = sorted(lattice.ids.values())
    before, after = (np.array(chance.choices(ids, k=300_000), np.int64) for _ in range(2))
    want = lattice.fits_all(before, after)
    for _ in range(2):
        assert (lattice._together(before, after) == want).all()
    assert len(lattice.pair_key) == len(lattice.pair_fits) <= 1 << 18 and n < 1 << 31
