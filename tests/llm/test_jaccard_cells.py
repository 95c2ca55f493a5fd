"""The recursion of the Jaccard join: rings, blocks and cells lose no pair, whatever their size."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsboard.llm import jaccard

DOC = "doc_id long, text string"


def edited(chance, words, share):
    return [f"e{chance.randrange(10**6)}" if chance.random() < share else w for w in words]


def plain(rows):
    """Smallest doc_id reachable, from all pairs."""
    sets = [set(jaccard.shingles(t).tolist()) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    return {(rows[i][0], len(sets[i]), min(groups[root(i)])) for i in range(len(rows))}


def crowd(seed):
    """A large group of near copies, some of them too far from all others, a passage that many texts share, and
    chains whose ends are far apart."""
    chance, rows = random.Random(seed), []
    base = [f"b{k}" for k in range(120)]
    rows += [" ".join(edited(chance, base, chance.choice([0.005, 0.02, 0.03, 0.05]))) for _ in range(110)]
    passage = [f"p{k}" for k in range(60)]
    rows += [" ".join(passage + [f"{seed}x{i}_{k}" for k in range(chance.randrange(5, 40))]) for i in range(60)]
    words = [f"c{k}" for k in range(90)]
    for _ in range(25):
        words[chance.randrange(90)] = f"d{chance.randrange(10**6)}"
        rows.append(" ".join(words))
    ids = chance.sample(range(5 * len(rows)), len(rows))
    return list(zip(ids, rows))


@pytest.mark.parametrize("hot, most", [(64, 256), (4, 8), (4, 40), (64, 20)])
def test_classes_are_those_of_all_pairs(spark, monkeypatch, hot, most):
    rows = crowd(hot + most)
    docs = spark.createDataFrame(rows, DOC).repartition(5)
    found = jaccard.classes(docs, hot, most)
    smallest = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.join(smallest, "component").collect()}
    want = plain(rows)
    assert got == want
    assert 20 < len({c for _, _, c in want}) < len(rows) - 60


def pairs_of(cells):
    """All pairs of different labels that meet."""
    by = {}
    for r in cells.collect():
        by.setdefault(r["cell"], []).append((r["sid"], r["label"]))
    return {(min(a, b), max(a, b)) for rows in by.values() for a, x in rows for b, y in rows if x != y}


def test_rings_and_blocks_bring_partners_together(spark):
    chance = np.random.default_rng(3)
    centre = chance.integers(0, 2, 64 * jaccard.FOLD).astype(bool)
    rows, bits = [], []
    for sid in range(300):
        flips = chance.random(len(centre)) < chance.choice([0.02, 0.1, 0.2])
        bits.append(centre ^ flips)
        fold = np.packbits(bits[-1], bitorder="little").view(np.int64).tolist()
        rows.append((sid % 2, sid, int(min(sid, chance.integers(0, 400))), 400, fold))
    df = spark.createDataFrame(rows, "cell long, sid long, label long, n long, fold array<long>")
    reach = 2 * 400 // 7
    for most in (10, 60):
        rings = jaccard.divided(df, 0, most)
        blocks = jaccard.blocked(rings, most)
        close = {
            (a, b)
            for a in range(300)
            for b in range(a + 2, 300, 2)
            if rows[a][2] != rows[b][2] and int((bits[a] ^ bits[b]).sum()) <= reach
        }
        assert close and close <= pairs_of(rings) and close <= pairs_of(blocks)
        assert {tuple(r) for r in jaccard.candidates(blocks).collect()} == close
        largest = blocks.groupBy("cell").count().agg(F.max("count")).first()[0]
        assert largest <= 3 * most
    assert jaccard.candidates(jaccard.blocked(jaccard.divided(df.limit(0), 0))).collect() == []


def test_cells_over_several_batches(spark):
    fold = [0] * jaccard.FOLD
    rows = [(cell, 1000 * cell + k, k, 10, fold) for cell in range(40) for k in range(7)]
    df = spark.createDataFrame(rows, "cell long, sid long, label long, n long, fold array<long>").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = {tuple(r) for r in jaccard.candidates(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(1000 * c + a, 1000 * c + b) for c in range(40) for b in range(7) for a in range(b)}
