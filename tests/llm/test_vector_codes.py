"""Codes of vector parts against a plain version, and the odd cases the docstring defines."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsboard.llm import vector_codes as vc

VEC = "vec_id long, embedding array<float>, label int"


def plain(rows, rounds=4):
    """The contract, one part at a time, for vectors of one length."""
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    size = len(kept[0][1])
    cut = [k * size // 4 for k in range(5)]
    books = [[list(v[a:b]) for _, v, _ in kept[:256]] for a, b in zip(cut, cut[1:])]

    def assign():
        out = []
        for _, v, _ in kept:
            parts = [v[a:b] for a, b in zip(cut, cut[1:])]
            out.append([min((sum((x - y) ** 2 for x, y in zip(p, e)), k) for k, e in enumerate(book)) for p, book in zip(parts, books)])
        return out

    for _ in range(rounds):
        found = assign()
        for part, book in enumerate(books):
            for k in range(len(book)):
                mine = [v[cut[part] : cut[part + 1]] for (_, v, _), f in zip(kept, found) if f[part][1] == k]
                if mine:
                    book[k] = [sum(x) // len(mine) for x in zip(*mine)]
    found = assign()
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {label: sum(e for e, (_, _, m) in zip(errors, kept) if m == label) for _, _, label in kept}
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in f), e, by_label[label], sha) for (i, _, label), f, e in zip(kept, found, errors)]


def test_against_a_plain_version(spark):
    chance = random.Random(1)
    centres = [[chance.gauss(0, 0.2) for _ in range(8)] for _ in range(40)]
    rows = [(3 * i, [x + chance.gauss(0, 0.01) for x in chance.choice(centres)], chance.choice([0, 1, None])) for i in range(330)]
    rows += [(1, rows[5][1], 0), (1, rows[5][1], 0), (2, None, 0), (4, [0.1, None] + [0.0] * 6, 1), (5, [float("nan")] * 8, 1), (7, [float("inf")] + [0.0] * 7, 1), (8, [0.0] * 8, 1), (None, [0.01] * 8, 1)]
    chance.shuffle(rows)
    df = spark.createDataFrame(rows, VEC).withColumns({"size": F.lit("x"), "items": F.lit(1), "near": F.lit(1)}).repartition(5)
    got = vc.report(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain(rows), key=repr)


def test_lengths_have_codebooks_of_their_own(spark):
    chance = random.Random(2)
    long = [(i, [chance.random() for _ in range(8)], 0) for i in range(0, 60, 2)]
    short = [(i, [chance.random() for _ in range(6)], 0) for i in range(1, 40, 2)]
    got = {r["vec_id"]: tuple(r)[1:3] + (r["codebooks_sha256"],) for r in vc.report(spark.createDataFrame(long + short + [(99, [], 0)], VEC)).collect()}
    for rows in (long, short):
        assert {i: (code, error, sha) for i, code, error, _, sha in plain(rows)} == {i: got[i] for i, _, _ in rows}
    assert got[99] == ("00000000", 0, hashlib.sha256(b"").hexdigest())


def test_ties_and_copies_take_the_lower_index():
    book = np.array([[4, 0], [0, 4], [4, 0], [-4, 0]])
    parts = np.array([[0, 0], [4, 0], [2, 2], [-9, 0]])
    pivots = vc.far_apart(book)
    index, best, _ = vc.nearest(parts, np.sqrt(vc.squares(parts, pivots)), book, np.sqrt(vc.squares(book, pivots)))
    assert index.tolist() == [0, 0, 0, 3] and best.tolist() == [16, 0, 8, 25]


def test_bounds_spare_distances():
    chance = np.random.default_rng(0)
    centres = chance.integers(-1000, 1000, (256, 16))
    parts = centres[chance.integers(0, 256, 3000)] + chance.integers(-20, 20, (3000, 16))
    pivots = vc.far_apart(centres)
    index, best, tried = vc.nearest(parts, np.sqrt(vc.squares(parts, pivots)), centres, np.sqrt(vc.squares(centres, pivots)))
    exact = ((parts[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (index == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all()
    assert tried < 0.2 * exact.size


def test_empty_and_refused(spark):
    empty = spark.createDataFrame([], VEC)
    assert vc.report(empty).collect() == []
    assert vc.report(spark.createDataFrame([(1, None, 0), (2, [None], 0)], VEC)).collect() == []
    with pytest.raises(Exception, match="a component beyond"):
        vc.report(spark.createDataFrame([(1, [1e9, 0.0, 0.0, 0.0], 0)], VEC)).collect()
    with pytest.raises(ValueError, match="lengths"):
        vc.first_books(spark.range(400).selectExpr("id AS vec_id", "cast(id * 1000 as int) AS size", "array(id) AS items"))
